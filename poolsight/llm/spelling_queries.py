"""Query of the spelling variants, next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.llm import spelling
from poolsight.llm.registry import query, table

#: The table of the CRC is computed bit by bit; 3988292384 is the polynomial of zlib.
SPELLING_SQL = """
with recursive bytes_left as (
  select i, i::ubigint as reg, 0 as step from range(256) t(i)
  union all
  select i, case when reg & 1 = 1 then xor(reg >> 1, 3988292384::ubigint) else reg >> 1 end, step + 1 from bytes_left where step < 8
),
crc_table as (select list(reg order by i) as entries from bytes_left where step = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
),
keyed as (select doc_id, run, count(*) as k from runs group by all),
hashed as (
  select run, k, xor(list_reduce(
    list_prepend(4294967295::ubigint, [('0x' || x)::ubigint for x in regexp_extract_all(hex(encode(concat(doc_id, ':', run))), '..')]),
    lambda reg, b: xor(reg >> 8, entries[((xor(reg, b) & 255) + 1)::bigint])), 4294967295::ubigint) as h
  from keyed, crc_table
),
made as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, k
  from hashed
),
vocabulary as (select word, sum(k)::bigint as n from made where length(word) >= 5 group by word having sum(k) >= 3),
cuts as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from vocabulary)),
pairs as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select c.word, v.word, v.n from cuts c join vocabulary v on c.rest = v.word
  union select v.word, c.word, c.n from cuts c join vocabulary v on c.rest = v.word
),
best as (select word, count(*) as n_near, max(near_n) as near_n, first(near order by near_n desc, near) as near from pairs group by word),
formed as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 2 * v.n then b.near end as form, case when b.near_n >= 2 * v.n then b.near_n end as form_n
  from vocabulary v left join best b using (word)
),
walk as (
  select word, word as at, form as onward from formed
  union all
  select w.word, f.word, f.form from walk w join formed f on w.onward = f.word
)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n from formed f join walk w on f.word = w.word and w.onward is null"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in 97, by a hash of document and run, loses a code point first: the misspellings to be found."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.runs_of_letters(F.col("text"))).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    made = runs.withColumn("h", F.crc32(key.cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    without = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = made.select(F.when(F.col("h") % 97 == 0, without).otherwise(F.col("run")).alias("word"))
    vocabulary = words.filter(F.length("word") >= 5).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    return spelling.variant_groups(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
