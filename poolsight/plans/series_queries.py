"""Series, clustering and validation queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from poolsight.operators import clustering, scores, segments, series
from poolsight.plans.fixtures import point_cloud, table
from poolsight.plans.registry import query, r, rounded
from poolsight.plans.segment_queries import segments_sql
from poolsight.session import cut

STEPS = 25
CLUSTERS = 4


def laser_off(spark, sf_dir) -> DataFrame:
    """Long form of all laser-off segments, which is what gets clustered."""
    cloud = point_cloud(spark, sf_dir)
    return segments.segment_rows(cloud, segments.segment_index(cloud, "1-0"))


def scaled_series(spark, sf_dir) -> DataFrame:
    return series.zscore_series(series.pad_or_truncate(laser_off(spark, sf_dir), STEPS))


PADDED_SQL = segments_sql("1-0") + f""",
padded as (
  select s.session, s.layer, s.seg_id, step, sensor0, sensor1
  from seg s cross join range({STEPS}) t(step)
  join seg_rows x on x.session = s.session and x.layer = s.layer and x.seg_id = s.seg_id
    and x.pos = least(step, s.seg_end - s.seg_id - 1)
)"""

UNFOLDED = ["session", "layer", "seg_id"]


@query(
    "pad_or_truncate",
    PADDED_SQL + " select session, layer, seg_id, cast(step as integer) as step, sensor0, sensor1 from padded",
)
def pad_or_truncate(spark, sf_dir):
    return series.unfold(series.pad_or_truncate(laser_off(spark, sf_dir), STEPS), UNFOLDED)


def _scaled_sql(s: str) -> str:
    w = "over (partition by session, layer, seg_id)"
    std = f"stddev_pop({s}) {w}"
    return r(f"({s} - avg({s}) {w}) / case when {std} > 0 then {std} else 1 end", s)


@query(
    "zscore_series",
    PADDED_SQL
    + f" select session, layer, seg_id, cast(step as integer) as step, {_scaled_sql('sensor0')}, {_scaled_sql('sensor1')} from padded",
)
def zscore_series(spark, sf_dir):
    return rounded(series.unfold(scaled_series(spark, sf_dir), UNFOLDED), ["sensor0", "sensor1"])


@query(
    "segment_cap",
    segments_sql("1-0") + " select session, layer, seg_id, seg_end from seg order by session, layer, seg_id limit 100",
)
def segment_cap(spark, sf_dir):
    index = segments.segment_index(point_cloud(spark, sf_dir), "1-0")
    return series.segment_cap(index, 100).select(*UNFOLDED, "seg_end")


def vectors(spark, sf_dir) -> DataFrame:
    """`embeddings` as labelled points."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


@query("cluster_sizes", "select label, count(*) as n from embeddings group by label")
def cluster_sizes(spark, sf_dir):
    return series.cluster_sizes(table(spark, sf_dir, "embeddings"))


@query(
    "cluster_sample",
    """select vec_id, label, cast(row_number() over (partition by label order by vec_id) as integer) as rank
from embeddings qualify rank <= 10""",
)
def cluster_sample(spark, sf_dir):
    return series.cluster_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), key="vec_id")


MEANS_SQL = """
dims as (select vec_id, label, unnest(embedding::double[]) as v, unnest(range(len(embedding))) as d from embeddings),
means as (select label, d, avg(v) as m from dims group by label, d)"""


@query(
    "assign_euclidean",
    f"""with {MEANS_SQL},
costs as (
  select vec_id, m.label, round(sum(pow(v - m, 2)), 9) as cost from dims join means m using (d) group by vec_id, m.label
)
select vec_id as id, label, {r('cost', 'cost')} from costs
qualify row_number() over (partition by vec_id order by cost, label) = 1""",
)
def assign_euclidean(spark, sf_dir):
    points = vectors(spark, sf_dir)
    means = points.groupBy("label").agg(Summarizer.mean(array_to_vector("vec")).alias("mean"))
    centroids = means.select("label", vector_to_array("mean").alias("vec"))
    return rounded(clustering.assign_euclidean(points, centroids), ["cost"])


def _silhouette_sql(distance: str, name: str) -> str:
    return f"""with pairs as (
  select a.vec_id, a.label, b.label as other, sum({distance}) as total, count(*) as n
  from embeddings a cross join embeddings b group by all
),
points as (
  select vec_id, max(case when label = other then n end) as size,
    max(case when label = other and n > 1 then total / (n - 1) end) as a, min(case when label <> other then total / n end) as b
  from pairs group by vec_id
)
select {r("avg(case when size = 1 then 0 else (b - a) / greatest(a, b) end)", name)} from points"""


DISTANCE_SQL = "list_distance(a.embedding::double[], b.embedding::double[])"


@query("silhouette_exact", _silhouette_sql(DISTANCE_SQL, "silhouette"))
def silhouette_exact(spark, sf_dir):
    return rounded(scores.quadratic_silhouette(vectors(spark, sf_dir)), ["silhouette"])


@query("silhouette_sq", _silhouette_sql(f"pow({DISTANCE_SQL}, 2)", "silhouette_sq"))
def silhouette_sq(spark, sf_dir):
    return rounded(scores.silhouette_sq(vectors(spark, sf_dir)), ["silhouette_sq"])


@query(
    "calinski_harabasz",
    f"""with {MEANS_SQL},
centre as (select d, avg(v) as c from dims group by d),
sizes as (select label, count(*) as n from embeddings group by label),
between_ as (select sum(n * pow(m - c, 2)) as b from means join centre using (d) join sizes using (label)),
within_ as (select sum(pow(v - m, 2)) as w from dims join means using (label, d)),
shape as (select cast(sum(n) as bigint) as n, count(*) as k from sizes)
select n, k, {r('b / w * (n - k) / (k - 1)', 'calinski_harabasz')} from shape, between_, within_""",
)
def calinski_harabasz(spark, sf_dir):
    return rounded(scores.calinski_harabasz(vectors(spark, sf_dir)), ["calinski_harabasz"])


# --- fitted models, and models from given starts: the first series in key order -----------------

PASSES = 3
_W = "over (partition by session, layer, seg_id)"


def _scaled_column(s: str) -> str:
    std = f"stddev_pop({s}) {_W}"
    return f"({s} - avg({s}) {_W}) / case when {std} > 0 then {std} else 1 end as {s}"


SCALED_SQL = PADDED_SQL + f""",
scaled as (select session, layer, seg_id, step, {_scaled_column('sensor0')}, {_scaled_column('sensor1')} from padded),
flat as (
  select session, layer, seg_id, dense_rank() over (order by session, layer, seg_id) - 1 as nr, step, sensor, v
  from (unpivot scaled on sensor0, sensor1 into name sensor value v)
)"""


def _lloyd_sql() -> str:
    parts = [SCALED_SQL, f"cent0 as (select cast(nr as integer) as label, step, sensor, v as m from flat where nr < {CLUSTERS})"]
    for i in range(PASSES):
        parts.append(
            f"""near{i} as (
  select nr, label, cost from (
    select nr, c.label, sum(pow(v - m, 2)) as cost from flat f join cent{i} c using (step, sensor) group by nr, c.label
  ) qualify row_number() over (partition by nr order by cost, label) = 1
),
cent{i + 1} as (select label, step, sensor, avg(v) as m from flat join near{i} using (nr) group by label, step, sensor)"""
        )
    return ",\n".join(parts)


def _first_series(spark, sf_dir) -> tuple[DataFrame, np.ndarray]:
    """All series, and the first ones in key order as centroids of one start."""
    prepared = clustering.prepare(scaled_series(spark, sf_dir))
    first = prepared.orderBy(*UNFOLDED).limit(CLUSTERS).select("series").collect()
    return prepared.select("series_id", *UNFOLDED, "series"), np.array([[r.series for r in first]], float)


@query(
    "lloyd_steps",
    _lloyd_sql()
    + f""" select label, count(*) as n, {r(f"(select avg(cost) from near{PASSES - 1})", "inertia")} from near{PASSES - 1} group by label""",
)
def lloyd_steps(spark, sf_dir):
    """Three passes from given centroids; `kmeans_euclidean` is the whole fit."""
    prepared, first = _first_series(spark, sf_dir)
    model = clustering.fit_from(prepared, "euclidean", first, PASSES)
    sizes = series.cluster_sizes(model.assign(prepared)).withColumn("inertia", F.lit(model.inertia))
    return rounded(sizes, ["inertia"])


@query("centroids", _lloyd_sql() + f" select label, cast(step as integer) as step, sensor, {r('m', 'value')} from cent{PASSES - 1}")
def centroids(spark, sf_dir):
    prepared, first = _first_series(spark, sf_dir)
    return rounded(clustering.fit_from(prepared, "euclidean", first, PASSES).centroid_rows(spark), ["value"])


def _fit_sql(metric: str, seed: int = clustering.SEED) -> str:
    """Seeding by the same hash, all passes of all starts, then each start up to where it settles."""
    passes, starts = clustering.METHODS[metric]
    dist = "select f.nr, c.s, c.pick, sum(pow(f.v - g.v, 2)) as cost from flat f join chosen{0} c on true join flat g on g.nr = c.nr and g.step = f.step and g.sensor = f.sensor group by all"
    parts = [
        SCALED_SQL.replace("flat as (", "flat as materialized (").replace("with ", "with recursive ", 1),
        "ids as (select distinct nr, session || '/1_c/1_j/-1/' || layer || '/' || seg_id as id from flat)",
    ]
    for p in range(CLUSTERS):
        u = f"(('0x' || substr(md5(id || '|{seed}|' || s || '|{p}'), 1, 13))::ubigint + 0.5e0) / 4503599627370496e0"
        near = "" if p == 0 else f"join (select s, nr, min(cost) as near from ({dist.format(p - 1)}) group by all) using (s, nr)"
        draw = f"-ln({u})" if p == 0 else f"case when near > 0 then -ln({u}) / near else 'infinity'::double end"
        free = "" if p == 0 else f"where (s, nr) not in (select (s, nr) from chosen{p - 1})"
        before = "" if p == 0 else f"select * from chosen{p - 1} union all "
        parts.append(
            f"""chosen{p} as materialized ({before}select s, {p} as pick, nr from (
  select s, nr, id, {draw} as draw from (select * from ids, range({starts}) t(s)) {near} {free}
) qualify row_number() over (partition by s order by draw, id) = 1)"""
        )
    parts.append(f"cent0 as materialized (select s, cast(pick as integer) as label, step, sensor, v as m from chosen{CLUSTERS - 1} join flat using (nr))")
    if metric != "euclidean":
        parts.append(
            """wide as materialized (
  select nr, list(v order by step) filter (sensor = 'sensor0') as a0, list(v order by step) filter (sensor = 'sensor1') as a1 from flat group by nr
)"""
        )
    for i in range(passes):
        if metric != "euclidean":
            parts.append(_aligned_pass_sql(metric, i))
            continue
        parts.append(
            f"""near{i} as materialized (
  select s, nr, label, cost from (
    select s, nr, label, sum(pow(v - m, 2)) as cost from flat join cent{i} using (step, sensor) group by all
  ) qualify row_number() over (partition by s, nr order by cost, label) = 1
),
cent{i + 1} as materialized (
  select s, c.label, step, sensor, coalesce(n.m, c.m) as m from cent{i} c
  left join (select s, label, step, sensor, avg(v) as m from flat join near{i} using (nr) group by all) n using (s, label, step, sensor)
)"""
        )
    every = " union all ".join(f"select {i} as i, s, nr, label, cost from near{i}" for i in range(passes))
    parts.append(
        f"""every as materialized ({every}),
history as (select s, i, avg(cost) as inertia, lag(avg(cost)) over (partition by s order by i) as past from every group by s, i),
settled as (select s, min(i) filter (past - inertia < 1e-6 * greatest(1, abs(past))) as stop from history group by s),
kept as (
  select s, i, inertia from history join settled using (s) where i <= coalesce(stop, {passes})
  qualify row_number() over (partition by s order by inertia, i) = 1
),
winner as (select * from kept order by printf('%.9e', inertia)::double, s limit 1)"""
    )
    return ",\n".join(parts)


def _walk_sql(name: str, pairs: str, best: str) -> str:
    """Alignment costs of all cells along the anti-diagonals; cur holds diagonal d by row, old the one before."""
    t, far = STEPS, "1e300"
    cell = "pow(p.c0[i] - p.a0[q.d + 2 - i], 2) + pow(p.c1[i] - p.a1[q.d + 2 - i], 2)"
    return f"""{name}(pair, d, cur, old) as (
  select pair, 1, [case when i = 1 then pow(c0[1] - a0[1], 2) + pow(c1[1] - a1[1], 2) else {far} end for i in range(1, {t + 1})],
    [{far} for i in range(1, {t + 1})] from {pairs}
  union all
  select q.pair, q.d + 1,
    [case when q.d + 2 - i between 1 and {t} then {cell} + {best} else {far} end for i in range(1, {t + 1})],
    q.cur
  from {name} q join {pairs} p on q.pair = p.pair where q.d < {2 * t - 1}
)"""


def _costs_sql(best: str) -> str:
    return f"""{SCALED_SQL.replace("with ", "with recursive ", 1)},
packed as (
  select session, layer, seg_id, dense_rank() over (order by session, layer, seg_id) - 1 as nr,
    list(sensor0 order by step) as a0, list(sensor1 order by step) as a1 from scaled group by session, layer, seg_id
),
pairs as materialized (
  select a.nr * {CLUSTERS} + c.nr as pair, a.*, cast(c.nr as integer) as label, c.a0 as c0, c.a1 as c1
  from (select * from packed) a, (select nr, a0, a1 from packed where nr < {CLUSTERS}) c
),
{_walk_sql("walk", "pairs", best)},
costs as (
  select p.pair, p.session, p.layer, p.seg_id, p.label, w.cur[{STEPS}] as cost
  from walk w join pairs p on w.pair = p.pair where w.d = {2 * STEPS - 1}
)"""


_NEAREST = "qualify row_number() over (partition by session, layer, seg_id order by cost, label) = 1"


def _aligned_sql(best: str) -> str:
    return f"{_costs_sql(best)} select session, layer, seg_id, label, {r('cost', 'cost')} from costs {_NEAREST}"


def _moved_sql(best: str, cells: str, weight: str) -> str:
    """Centroids after one M-step: the weighted mean of the samples aligned with each step."""
    return f"""{_costs_sql(best)},
won as materialized (select pair, label, cost from costs {_NEAREST}),
{cells}
select label, cast(i - 1 as integer) as step, sensor, {r("sum(" + weight + " * x) / sum(" + weight + ")", "value")}
from (
  select c.*, 'sensor0' as sensor, p.a0[c.j] as x from cells c join pairs p using (pair)
  union all select c.*, 'sensor1', p.a1[c.j] from cells c join pairs p using (pair)
) group by label, i, sensor"""


def _path_sql(name: str, won: str, walk: str) -> str:
    """The cheapest path back from the last cell; diagonal steps win ties, then steps along the centroid."""
    return f"""{name}(pair, label, i, j) as (
  select pair, label, {STEPS}, {STEPS} from {won}
  union all
  select b.pair, b.label, case when coalesce(o.cur[b.i - 1], 1e300) <= w.cur[b.i] or coalesce(w.cur[b.i - 1], 1e300) <= w.cur[b.i] then b.i - 1 else b.i end,
    case when coalesce(o.cur[b.i - 1], 1e300) <= coalesce(w.cur[b.i - 1], 1e300) and coalesce(o.cur[b.i - 1], 1e300) <= w.cur[b.i] then b.j - 1
      when coalesce(w.cur[b.i - 1], 1e300) <= w.cur[b.i] then b.j else b.j - 1 end
  from {name} b join {walk} w on w.pair = b.pair and w.d = b.i + b.j - 2
  left join {walk} o on o.pair = b.pair and o.d = b.i + b.j - 3
  where b.i + b.j > 2
)"""


def _soft_cells(best: str) -> str:
    """Expected alignment from the costs up to a cell and from the far end back to it."""
    t = STEPS
    return f"""turned as materialized (
  select pair, list_reverse(a0) as a0, list_reverse(a1) as a1, list_reverse(c0) as c0, list_reverse(c1) as c1 from pairs join won using (pair)
),
{_walk_sql("rewalk", "turned", best)},
cells as (
  select won.pair, won.label, i, j, exp(won.cost - w.cur[i] - v.cur[{t + 1} - i] + pow(p.c0[i] - p.a0[j], 2) + pow(p.c1[i] - p.a1[j], 2)) as weight
  from won join pairs p using (pair), range(1, {t + 1}) y(i), range(1, {t + 1}) x(j), walk w, rewalk v
  where w.pair = won.pair and w.d = i + j - 1 and v.pair = won.pair and v.d = {2 * t + 1} - i - j
)"""


_UP, _LEFT, _BOTH = "coalesce(q.cur[i - 1], 1e300)", "q.cur[i]", "coalesce(q.old[i - 1], 1e300)"
_LEAST = f"least({_UP}, {_LEFT}, {_BOTH})"
_SOFT = f"{_LEAST} - ln(" + " + ".join(f"exp({_LEAST} - {x})" for x in (_UP, _LEFT, _BOTH)) + ")"


def _aligned_pass_sql(metric: str, i: int) -> str:
    """One pass of all starts: nearest centroids by alignment cost, and the means of what is aligned with each step."""
    best = _LEAST if metric == "dtw" else _SOFT
    t, walk, pairs = STEPS, f"walk{i}", f"pairs{i}"
    text = f"""{pairs} as materialized (
  select (s * 1000000 + nr) * {CLUSTERS} + label as pair, s, nr, label, a0, a1, c0, c1 from wide, (
    select s, label, list(m order by step) filter (sensor = 'sensor0') as c0, list(m order by step) filter (sensor = 'sensor1') as c1 from cent{i} group by s, label
  )
),
{_walk_sql(walk, pairs, best)},
near{i} as materialized (
  select pair, s, nr, label, w.cur[{t}] as cost from {walk} w join {pairs} using (pair) where w.d = {2 * t - 1}
  qualify row_number() over (partition by s, nr order by cost, label) = 1
),
"""
    if metric == "dtw":
        text += _path_sql(f"back{i}", f"near{i}", walk) + f",\ncells{i} as (select pair, i, j, 1 as weight from back{i}),\n"
    else:
        text += f"""turned{i} as materialized (
  select pair, list_reverse(a0) as a0, list_reverse(a1) as a1, list_reverse(c0) as c0, list_reverse(c1) as c1 from {pairs} join near{i} using (pair)
),
{_walk_sql(f"rewalk{i}", f"turned{i}", best)},
cells{i} as (
  select n.pair, i, j, exp(n.cost - w.cur[i] - v.cur[{t + 1} - i] + pow(p.c0[i] - p.a0[j], 2) + pow(p.c1[i] - p.a1[j], 2)) as weight
  from near{i} n join {pairs} p using (pair), range(1, {t + 1}) y(i), range(1, {t + 1}) x(j), {walk} w, rewalk{i} v
  where w.pair = n.pair and w.d = i + j - 1 and v.pair = n.pair and v.d = {2 * t + 1} - i - j
),
"""
    return text + f"""cent{i + 1} as materialized (
  select s, c.label, step, sensor, coalesce(n.m, c.m) as m from cent{i} c left join (
    select s, label, i - 1 as step, sensor, sum(weight * x) / sum(weight) as m from (
      select s, label, i, weight, 'sensor0' as sensor, a0[j] as x from cells{i} join {pairs} using (pair)
      union all select s, label, i, weight, 'sensor1', a1[j] from cells{i} join {pairs} using (pair)
    ) group by all
  ) n using (s, label, step, sensor)
)"""


def _sizes(metric: str) -> None:
    sql = f"{_fit_sql(metric)} select label, count(*) as n, {r('any_value(w.inertia)', 'inertia')} from every join winner w using (s, i) group by label"

    @query(f"kmeans_{metric}", sql)
    def run(spark, sf_dir):
        prepared = clustering.prepare(scaled_series(spark, sf_dir).select("series_id", "series"))
        model = clustering.fit(prepared, metric, CLUSTERS)
        return rounded(series.cluster_sizes(model.assign(prepared)).withColumn("inertia", F.lit(model.inertia)), ["inertia"])


for _metric in clustering.METHODS:
    _sizes(_metric)


def _assigned(name: str, metric: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        prepared, first = _first_series(spark, sf_dir)
        labelled = clustering.SeriesModel(metric, first[0], 0.0).assign(prepared)
        return rounded(labelled.select(*UNFOLDED, "label", "cost"), ["cost"])


_assigned("assign_dtw", "dtw", _aligned_sql(_LEAST))
_assigned("assign_softdtw", "softdtw", _aligned_sql(_SOFT))


def _stepped(name: str, metric: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        prepared, first = _first_series(spark, sf_dir)
        moved = clustering.SeriesModel(metric, clustering.move(prepared, metric, first[0]), 0.0)
        return rounded(moved.centroid_rows(spark), ["value"])


_stepped("dtw_step", "dtw", _moved_sql(_LEAST, _path_sql("back", "won", "walk") + ",\ncells as (select * from back)", "1"))
_stepped("softdtw_step", "softdtw", _moved_sql(_SOFT, _soft_cells(_SOFT), "weight"))


@query("softdtw_descent", "select true as never_rises, true as no_worse_than_full_step")
def softdtw_descent(spark, sf_dir):
    """Whether the line-searched descent from the first series keeps what it promises at every pass."""
    prepared, first = _first_series(spark, sf_dir)
    costs = clustering.descend(prepared, "softdtw", first[0], 6).history
    full = clustering.fit_from(prepared, "softdtw", first, 2).history
    falls = all(b <= a for a, b in zip(costs, costs[1:]))
    kept = len(costs) < 2 or costs[1] <= full[1]
    return spark.createDataFrame([(falls, kept)], "never_rises boolean, no_worse_than_full_step boolean")


def _clustered(spark, sf_dir) -> clustering.ClusteringRun:
    cloud = point_cloud(spark, sf_dir)
    index = segments.segment_index(cloud, "1-0")
    return clustering.cluster_series(series.scaled_segments(cloud, index, STEPS), CLUSTERS)


def _chosen_sql() -> str:
    """The three fits, and the one with the most labels, at least two; earlier methods win ties."""
    fits = ",\n".join(
        f"{m} as materialized (\n{_fit_sql(m)} select '{m}' as method, {n} as place, nr, label from every join winner using (s, i))"
        for n, m in enumerate(clustering.METHODS)
    )
    every = " union all ".join(f"select * from {m}" for m in clustering.METHODS)
    return f"""with {fits},
fitted as ({every}),
chosen as (
  select method, count(distinct label) as n_labels, count(*) as n_series from fitted group by method, place
  having count(distinct label) > 1 order by n_labels desc, place limit 1
)"""


@query("select_model", _chosen_sql() + " select method, n_labels, n_series from chosen")
def select_model(spark, sf_dir):
    run = _clustered(spark, sf_dir)
    return run.labelled.groupBy(F.lit(run.chosen).alias("method")).agg(
        F.count_distinct("label").alias("n_labels"), F.count("*").alias("n_series")
    )


RUN_SQL = f"""{_chosen_sql()},
points as materialized (
  {SCALED_SQL} select nr, step, sensor, v, label, method from flat join fitted using (nr) join chosen using (method)
),
gaps as (
  select a.nr, a.label, b.label as other, sum(pow(a.v - b.v, 2)) as total, count(distinct b.nr) as n
  from points a join points b using (step, sensor) group by all
),
sides as (
  select nr, max(case when label = other then n end) as size,
    max(case when label = other and n > 1 then total / (n - 1) end) as a, min(case when label <> other then total / n end) as b
  from gaps group by nr
),
means as (select label, step, sensor, avg(v) as m from points group by all),
centre as (select step, sensor, avg(v) as c from points group by all),
sizes as (select label, count(distinct nr) as n from points group by label),
between_ as (select sum(n * pow(m - c, 2)) as b from means join centre using (step, sensor) join sizes using (label)),
within_ as (select sum(pow(v - m, 2)) as w from points join means using (label, step, sensor)),
shape as (select cast(sum(n) as bigint) as n, count(*) as k from sizes)
select (select {r("avg(case when size = 1 then 0 else (b - a) / greatest(a, b) end)")} from sides) as silhouette_sq,
  n, k, {r('b / w * (n - k) / (k - 1)', 'calinski_harabasz')}, method
from shape, between_, within_, chosen"""


@query("clustering_run", RUN_SQL)
def clustering_run(spark, sf_dir):
    """Segments, series, three fits, choice, and both validation scores over all series."""
    run = _clustered(spark, sf_dir)
    points = cut(run.labelled.select(F.col("series_id").alias("id"), F.flatten("series").alias("vec"), "label"))
    scored = scores.silhouette_sq(points).join(scores.calinski_harabasz(points)).withColumn("method", F.lit(run.chosen))
    return rounded(scored, ["silhouette_sq", "calinski_harabasz"])
