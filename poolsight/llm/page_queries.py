"""Query of the text extraction, next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolsight.llm import text_density
from poolsight.llm.registry import query, table

#: The pages of these tables mark their article, so SQL can cut it out; the operator reads any page.
PAGE_SQL = r"""
with pieces as (
  select page_id, url,
    list_transform(regexp_split_to_array(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1)>'),
      lambda x: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(
        regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&nbsp;', ' '), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as blocks
  from pages
),
joined as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from pieces)
select page_id, url, text, length(text) as n_chars from joined"""


@query("op12_text_density", PAGE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.main_texts(table(spark, sf_dir, "pages"))
