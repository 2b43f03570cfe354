"""All queries of this subpackage."""

from poolsight.llm import page_queries, record_queries, spelling_queries, text_queries, vector_queries  # noqa: F401
from poolsight.llm.registry import QUERIES, SQL  # noqa: F401
