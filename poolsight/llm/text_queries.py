"""Queries of the text operators, each next to its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules, token_files
from poolsight.llm.registry import query, table
from poolsight.session import scratch_path


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return model.add_score(docs).select(
        "doc_id",
        quality_rules.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


NEAR_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
shingles as (
  select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from worded where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select u, v from (
    select a.doc_id as u, b.doc_id as v, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
    join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    group by all
  ) join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * common >= 80 * (x.n + y.n - common)
),
reach(u, v) as (select doc_id, doc_id from documents union select r.u, l.v from reach r join links l on r.v = l.u),
parts as (select u, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(s.n, 0) as n_shingles, p.component_id, d.doc_id = p.component_id as kept
from documents d join parts p on d.doc_id = p.u left join sizes s on d.doc_id = s.doc_id"""


@query("op3_minhash_dedup", NEAR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         row_number() over (partition by source order by
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), doc_id nulls first) - 1 as nr
  from documents
),
sources as (
  select *, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight,
         row_number() over (order by source is null, source) as place
  from (select source, cast(sum(size) as bigint) as source_size from sized group by source)
),
shared as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as share
  from sources
  window before as (order by source_size::double / weight::double, place rows between unbounded preceding and 1 preceding)
),
targets as (
  select source, source_size,
         least((select arg_min(share, (source_size::double / weight::double, place)) from shared where share * weight <= 3 * source_size) * weight,
               3.0e0 * source_size) as target,
         (('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 4))::bigint + 0.5e0) / 65536 as start
  from shared
),
taken as (
  select s.doc_id, s.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0e0 end as step, t.start, s.nr
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(size * least(3, floor(step * (nr + 1) + start) - floor(step * nr + start)) as bigint) as taken
from taken"""


@query("op4_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_token_planes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), path)
    return token_files.document_digests(spark, path)


LINES_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
),
keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
),
shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct coalesce(doc_id, -1)) >= 3
),
flagged as (
  select k.doc_id, k.line, k.pos, s.key is not null and k.doc_id is distinct from s.keeper as gone
  from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from flagged group by doc_id"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.with_kept_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select(
        "doc_id",
        F.size("_ld_lines").cast("long").alias("n_lines"),
        (F.size("_ld_lines") - F.size("_ld_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_ld_kept", "\n"), 256).alias("kept_sha256"),
    )
