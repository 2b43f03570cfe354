"""Queries of the vector operators, each next to its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.llm import cap_filters, maxscore, part_codes
from poolsight.llm.registry import query, table
from poolsight.session import cut

COSINE_SQL = """
with recursive valid as (
  select vec_id, [x::double for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    and len([1 for x in embedding if x <> 0]) > 0
),
links as (
  select a.vec_id as u, b.vec_id as v from valid a, valid b
  where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95e0
),
reach(u, v) as (select vec_id, vec_id from valid union select r.u, l.v from reach r join links l on r.v = l.u),
parts as (select u, min(v) as component_id from reach group by u),
counts as (select u, count(*) as n_links from links group by u)
select e.vec_id, coalesce(c.n_links, 0) as n_links, coalesce(p.component_id, e.vec_id) as component_id,
       coalesce(p.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join parts p on e.vec_id = p.u left join counts c on e.vec_id = c.u"""


@query("op6_cap_filters", COSINE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


TOP_SQL = """
with whole as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as vector from embeddings
  where embedding is not null
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
),
scored as (
  select q.vec_id as query_id, v.vec_id,
         list_sum([z[1] * z[2] for z in list_zip(q.vector, v.vector)])::bigint as score
  from whole q, whole v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5"""


@query("op10_maxscore", TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.whole_numbers(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of k-means per part, one pair of tables per round; products of these whole numbers are exact in double."""
    nearest = """
near{r} as (
  select x.vec_id, x.p, min({{d: x.square - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), e: c.e}}) as best
  from parts x join book{r} c using (p) group by all
)"""
    moved = """
sums{r} as (
  select n.p, n.best.e as e, pos, floor(sum(x.v[pos]) / count(*)) as y
  from near{r} n join parts x using (vec_id, p), range(1, (select any_value(len(v)) from parts) + 1) t(pos) group by all
),
book{s} as (
  select b.p, b.e, coalesce(m.v, b.v) as v
  from book{r} b left join (select p, e, list(y order by pos) as v from sums{r} group by all) m using (p, e)
)"""
    text = """
with valid as (
  select vec_id, label, [floor(1024 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
),
parts as (
  select vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as v, list_inner_product(v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4], v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4]) as square
  from valid, range(4) t(p)
),
book0 as (
  select p, e, v from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from valid qualify e < 256) using (vec_id)
)"""
    for r in range(rounds):
        text += "," + nearest.format(r=r) + "," + moved.format(r=r, s=r + 1)
    return text + "," + nearest.format(r=rounds) + f""",
coded as (
  select vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error from near{rounds} group by vec_id
),
digest as (select sha256(string_agg(y::bigint::varchar, ',' order by p, e, pos)) as h from (select p, e, unnest(v) as y, generate_subscripts(v, 1) as pos from book{rounds}))
select c.vec_id, c.code, c.error, sum(c.error) over (partition by l.label)::bigint as label_error, h as codebooks_sha256
from coded c join valid l using (vec_id), digest"""


@query("op11_part_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = part_codes.compress(table(spark, sf_dir, "embeddings"))
    return part_codes.label_errors(cut(codes)).select(
        "vec_id", "code", "error", "label_error", F.lit(part_codes.digest(codebooks)).alias("codebooks_sha256")
    )
