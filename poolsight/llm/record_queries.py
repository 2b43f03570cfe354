"""Queries of the chat and rollup operators, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolsight.llm import token_rollups, tool_calls
from poolsight.llm.registry import query, table
from poolsight.session import cut, scratch_path

#: Tools the conversations' user turns stand for; every third text length asks one that has no schema.
SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 8}, "text": {"type": "string"}},
        "required": ["limit", "text"],
        "additionalProperties": False,
    },
    "lookup": {"type": "object", "properties": {"limit": {"type": "integer"}, "text": {"type": "string"}}, "required": ["text"]},
}

CALLS_SQL = """
with recursive asked as (
  select conv_id, conv_id || '-' || turn as call_id, turn, text, length(text) as n,
         case length(text) % 3 when 0 then 'search' when 1 then 'lookup' else 'other' end as name,
         conv_id || '-' || (turn - 2 - 2 * (length(text) % 2)) as parent_id
  from conversations where role = 'user'
),
linked as (
  select a.conv_id, a.call_id, p.call_id as parent_id
  from asked a left join asked p on a.conv_id = p.conv_id and a.parent_id = p.call_id
),
depths as (
  select conv_id, call_id, 0 as depth from linked where parent_id is null
  union all
  select l.conv_id, l.call_id, d.depth + 1 from depths d join linked l on l.conv_id = d.conv_id and l.parent_id = d.call_id
),
answers as (
  select conv_id, conv_id || '-' || (turn - 1) as call_id, min(text) as result from conversations where role = 'assistant' group by all
),
checked as (
  select a.conv_id, a.call_id, a.name, a.turn, d.depth, r.call_id is not null as answered,
         case when a.name = 'other' then ['unknown tool']
              when a.name = 'search' and a.n % 10 < 1 then ['$.limit: below 1']
              when a.name = 'search' and a.n % 10 > 8 then ['$.limit: above 8'] else [] end as errors,
         '{"arguments":{"limit":' || (a.n % 10) || ',"text":' || to_json(a.text) || '},"id":"' || a.call_id || '","name":"' || a.name
           || '","result":' || coalesce(to_json(r.result)::varchar, 'null') || '}' as message
  from asked a join depths d on a.conv_id = d.conv_id and a.call_id = d.call_id
  left join answers r on a.conv_id = r.conv_id and a.call_id = r.call_id
)
select conv_id, call_id, name, turn,
       row_number() over (partition by conv_id order by depth, turn, call_id) - 1 as step, cast(depth as bigint) as depth,
       case when len(errors) > 0 then 'invalid' when not answered then 'pending' else 'done' end as status,
       array_to_string(errors, '; ') as errors, message
from checked"""


@query("op1_tool_calls", CALLS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls (each waits for an earlier user turn), the assistant's next turns as results."""
    turns = table(spark, sf_dir, "conversations")
    n = F.char_length("text")

    def key(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    calls = turns.filter("role = 'user'").select(
        "conv_id",
        key(F.col("turn")).alias("call_id"),
        key(F.col("turn") - 2 - 2 * (n % 2)).alias("parent_id"),
        "turn",
        F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("other").alias("name"),
        F.to_json(F.struct("text", (n % 10).alias("limit"))).alias("arguments"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return tool_calls.link_calls(calls, results, SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


ROLLUP_SQL = r"""
with counted as (
  select d.doc_id, d.source, d.lang, l.quality, coalesce(l.toxic, 0) as toxic,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words,
         coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]')), 0) as runs
  from documents d left join labels l on d.doc_id = l.doc_id
),
now as (
  select source, lang, 'words-1' as version, case when quality = 0 then runs else words end as tokens from counted where toxic <> 1
  union all
  select source, lang, 'runs-1', runs from counted where toxic <> 1
)
select source, lang, version, count(*) as documents, cast(sum(tokens) as bigint) as tokens from now group by all"""


@query("op9_token_rollups", ROLLUP_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizer versions, recount those of low quality, delete the toxic, replay two batches."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    counts = cut(
        docs.select(
            "doc_id",
            "source",
            "lang",
            token_rollups.pattern_count(F.col("text"), r"[^\x20\x09-\x0D]+").alias("words"),
            token_rollups.pattern_count(F.col("text"), r"[A-Za-z]+|[0-9]").alias("runs"),
        )
    )
    kinds = F.inline(
        F.array(
            F.struct(F.lit("words-1").alias("version"), F.col("words").alias("tokens")),
            F.struct(F.lit("runs-1").alias("version"), F.col("runs").alias("tokens")),
        )
    )
    load = counts.select("doc_id", "source", "lang", kinds)
    revised = counts.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "source", "lang", F.lit("words-1").alias("version"), F.col("runs").alias("tokens")
    )
    deleted = load.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("deleted", F.lit(True))
    store = token_rollups.RollupStore(spark, scratch_path(spark, "rollups"))
    for batch, changes in (("load", load), ("revise", revised), ("delete", deleted), ("load", load), ("revise", revised)):
        store.apply(batch, changes)
    return store.totals()
