"""Segmentation and feature queries over the `events` point cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.operators import features, segments, signal_blocks
from poolsight.operators.mapping import map_segments
from poolsight.plans.fixtures import PC_SQL, point_cloud
from poolsight.plans.registry import query, r, rounded
from poolsight.session import cut, scratch_path
from poolsight.sources import tables

KEYS = ["session", "layer"]

#: Start and end conditions in SQL, over p (previous), c (current) and n (next state).
FLAGS_SQL = {
    "0-1": ("p = 0 and c = 1", "p = 1 and c = 0"),
    "1-0": ("p = 1 and c = 0", "p = 0 and c = 1"),
    "0-0": ("p <> 0 and c = 0", "c = 0 and n <> 0"),
    "1-1": ("p <> 1 and c = 1", "c = 1 and n <> 1"),
}


def segments_sql(grouping: str = "0-1", state: str = "state0", min_length: int = 10) -> str:
    """CTEs pc, seg and seg_rows. Each start is joined with all later ends and takes the least."""
    start, end = FLAGS_SQL[grouping]
    return f"""
with {PC_SQL},
states as (
  select session, layer, idx, {state} as c, lag({state}) over w as p, lead({state}) over w as n
  from pc window w as (partition by session, layer order by idx)
),
seg as (
  select s.session, s.layer, s.idx as seg_id, min(e.idx) as seg_end
  from (select * from states where {start}) s
  join (select * from states where {end}) e
    on s.session = e.session and s.layer = e.layer and e.idx > s.idx
  group by all having min(e.idx) - s.idx >= {min_length}
),
seg_rows as (
  select seg.session, seg.layer, seg_id, seg_end - seg_id as length, idx - seg_id as pos, sensor0, sensor1
  from seg join pc on seg.session = pc.session and seg.layer = pc.layer and idx >= seg_id and idx < seg_end
),
signal as (
  select session, layer, seg_id, length, pos, 'sensor0' as sensor, sensor0 as v from seg_rows
  union all
  select session, layer, seg_id, length, pos, 'sensor1', sensor1 from seg_rows
)"""


def rows_of(spark: SparkSession, sf_dir: str, grouping: str = "0-1") -> DataFrame:
    cloud = point_cloud(spark, sf_dir)
    return segments.segment_rows(cloud, segments.segment_index(cloud, grouping))


@query(
    "transition_flags",
    f"""with {PC_SQL},
states as (
  select session, layer, idx, state0 as c, lag(state0) over w as p, lead(state0) over w as n
  from pc window w as (partition by session, layer order by idx)
)
select session, layer, idx, c as state0, p as prev_state0, n as next_state0,
"""
    + ",\n".join(
        f"coalesce({start}, false) as start_{g.replace('-', '')}, coalesce({end}, false) as end_{g.replace('-', '')}"
        for g, (start, end) in FLAGS_SQL.items()
    )
    + " from states",
)
def transition_flags(spark, sf_dir):
    return segments.transition_flags(point_cloud(spark, sf_dir)).drop("config", "job", "part")


def _index_query(name: str, grouping: str, state: str, min_length: int) -> None:
    sql = segments_sql(grouping, state, min_length) + (
        " select session, layer, seg_id, seg_end, seg_end - seg_id as length from seg"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        index = segments.segment_index(point_cloud(spark, sf_dir), grouping, state, min_length)
        return index.select(*KEYS, "seg_id", "seg_end", "length")


for _grouping in segments.GROUPINGS:
    _index_query(f"seg_index_{_grouping.replace('-', '')}", _grouping, "state0", 10)
_index_query("seg_overlap", "0-1", "state_m", 3)


@query(
    "segment_rows",
    segments_sql("0-1", "state_m", 3) + " select session, layer, seg_id, pos, sensor0, sensor1 from seg_rows",
)
def segment_rows(spark, sf_dir):
    cloud = point_cloud(spark, sf_dir)
    index = segments.segment_index(cloud, "0-1", "state_m", 3)
    return segments.segment_rows(cloud, index).select(*KEYS, "seg_id", "pos", "sensor0", "sensor1")


@query(
    "segments_per_group",
    segments_sql()
    + """ select l.session, l.layer, count(seg_id) as n_segments
from (select distinct session, layer from pc) l left join seg on l.session = seg.session and l.layer = seg.layer
group by all""",
)
def segments_per_group(spark, sf_dir):
    cloud = point_cloud(spark, sf_dir)
    return segments.segments_per_group(cloud, segments.segment_index(cloud)).select(*KEYS, "n_segments")


@query(
    "segment_arrays",
    segments_sql()
    + """ select session, layer, seg_id, length, pos // 8 as seg_part,
  string_agg(cast(cast(sensor0 * 100 as bigint) as varchar) || ':' || cast(cast(sensor1 as bigint) as varchar), ' ' order by pos) as samples
from seg_rows group by all""",
)
def segment_arrays(spark, sf_dir):
    arrays = segments.segment_arrays(rows_of(spark, sf_dir), part_rows=8)
    text = F.transform(
        "samples",
        lambda s: F.concat(
            F.round(s["sensor0"] * 100).cast("long").cast("string"), F.lit(":"), s["sensor1"].cast("long").cast("string")
        ),
    )
    return arrays.select(*KEYS, "seg_id", "length", "seg_part", F.array_join(text, " ").alias("samples"))


# --- features ---------------------------------------------------------------------------------

SIGNAL = [*KEYS, "seg_id", "sensor"]
SIGNAL_SQL = "session, layer, seg_id, sensor"
BASIC_SQL = ",\n".join(
    [
        r("avg(v)", "mean"),
        r("stddev_pop(v)", "std"),
        r("case when avg(v) <> 0 then stddev_pop(v) / avg(v) end", "cv"),
        r("regr_slope(v, pos)", "slope"),
        "count(*) as segment_length",
    ]
)
BASIC = ["mean", "std", "cv", "slope"]
AUTOCOV = [f"autoco_{k}" for k in range(1, features.LAGS + 1)]
FIT = ["mse", "x_intercept", "y_intercept"]

LAGS_SQL = (
    "lagged as (select s.*, avg(v) over (partition by session, layer, seg_id, sensor) as m, "
    + ", ".join(f"lead(v, {k}) over w as l{k}" for k in range(1, features.LAGS + 1))
    + " from signal s window w as (partition by session, layer, seg_id, sensor order by pos))"
)
AUTOCOV_SQL = ",\n".join(
    r(f"sum((v - m) * (l{k} - m)) / count(*)", f"autoco_{k}") for k in range(1, features.LAGS + 1)
)


def spectrum_cte(first: int) -> str:
    # a segment of these layers has at most 500 rows, hence 251 bins
    return f"""bins as (
  select {SIGNAL_SQL}, k,
    round(sqrt(pow(sum(v * cos(2 * pi() * k * pos / length)), 2) + pow(sum(v * sin(2 * pi() * k * pos / length)), 2)), 6) as mag
  from signal, range({first}, 251) b(k) where k <= length // 2 group by {SIGNAL_SQL}, k
),
peaks as (
  select {SIGNAL_SQL}, k as dominant_freq from bins
  qualify row_number() over (partition by {SIGNAL_SQL} order by mag desc, k) = 1
)"""


def fit_sql(grid) -> str:
    values = ", ".join(f"({j}, {b!r}e0)" if "e" not in repr(b) else f"({j}, {b!r})" for j, b in enumerate(grid))
    return f"""grid(j, b) as (values {values}),
curves as (
  select {SIGNAL_SQL}, b, greatest(0, avg(v + exp(10 * pos / b))) as a from signal, grid group by {SIGNAL_SQL}, b
),
errors as (
  select {SIGNAL_SQL}, c.b, any_value(c.a) as a, avg(pow(v - c.a + exp(10 * pos / c.b), 2)) as mse
  from signal s join curves c using ({SIGNAL_SQL}) group by {SIGNAL_SQL}, c.b
),
fits as (
  select {SIGNAL_SQL}, mse, a as x_intercept, b as y_intercept from errors
  qualify row_number() over (partition by {SIGNAL_SQL} order by round(mse, 6), abs(log10(b / -0.1e0))) = 1
)"""


FIT_COLUMNS_SQL = ", ".join(r(c, c) for c in FIT)


@query("feat_basic", segments_sql() + f" select {SIGNAL_SQL}, {BASIC_SQL} from signal group by {SIGNAL_SQL}")
def feat_basic(spark, sf_dir):
    out = features.features(rows_of(spark, sf_dir), autocov=False, fit_grid=None)
    return rounded(out.select(*SIGNAL, *BASIC, "segment_length"), BASIC)


#: Signals of sensor0 with a missing, an unordered or an infinite value, and some with two rows only.
DAMAGED_SQL = """damaged as (
  select session, layer, seg_id, sensor,
    case when sensor = 'sensor0' and seg_id % 4 = 0 and pos = 3 then null when sensor = 'sensor0' and seg_id % 4 = 1 and pos = 1 then 'nan'::double
      when sensor = 'sensor0' and seg_id % 4 = 2 and pos = 0 then 'infinity'::double else v end as v
  from signal where seg_id % 7 > 0 or pos < 2
)"""


@query(
    "input_checks",
    segments_sql()
    + f""", {DAMAGED_SQL} select {SIGNAL_SQL}, count(*) as segment_length, bad as bad_signal,
  {r('case when not bad then avg(case when not bad then v end) end', 'mean')}
from damaged join (
  select {SIGNAL_SQL}, count(*) <= 2 or bool_or(v is null or isnan(v) or isinf(v)) as bad from damaged group by {SIGNAL_SQL}
) using ({SIGNAL_SQL}) group by {SIGNAL_SQL}, bad""",
)
def input_checks(spark, sf_dir):
    seg, pos = F.col("seg_id"), F.col("pos")
    broken = (
        F.when((seg % 4 == 0) & (pos == 3), None)
        .when((seg % 4 == 1) & (pos == 1), float("nan"))
        .when((seg % 4 == 2) & (pos == 0), float("inf"))
        .otherwise(F.col("sensor0"))
    )
    rows = rows_of(spark, sf_dir).withColumn("sensor0", broken).filter((seg % 7 > 0) | (pos < 2))
    out = features.features(rows, autocov=False, fit_grid=None)
    return rounded(out.select(*SIGNAL, "segment_length", "bad_signal", "mean"), ["mean"])


@query(
    "feat_autocov",
    segments_sql() + f", {LAGS_SQL} select {SIGNAL_SQL}, {AUTOCOV_SQL} from lagged group by {SIGNAL_SQL}",
)
def feat_autocov(spark, sf_dir):
    out = features.features(rows_of(spark, sf_dir), fit_grid=None)
    return rounded(out.select(*SIGNAL, *AUTOCOV), AUTOCOV)


@query("feat_domfreq", segments_sql() + f", {spectrum_cte(0)} select * from peaks")
def feat_domfreq(spark, sf_dir):
    return features.dominant_freq(rows_of(spark, sf_dir)).select(*SIGNAL, "dominant_freq")


@query("feat_domfreq_ac", segments_sql() + f", {spectrum_cte(1)} select * from peaks")
def feat_domfreq_ac(spark, sf_dir):
    return features.dominant_freq(rows_of(spark, sf_dir), skip_dc=True).select(*SIGNAL, "dominant_freq")


@query("feat_expfit_grid", segments_sql() + f", {fit_sql(features.FIT_GRID)} select {SIGNAL_SQL}, {FIT_COLUMNS_SQL} from fits")
def feat_expfit_grid(spark, sf_dir):
    out = features.features(rows_of(spark, sf_dir), autocov=False)
    return rounded(out.select(*SIGNAL, *FIT), FIT)


@query(
    "feat_expfit_fixed_b",
    segments_sql() + f", {fit_sql([features.FIT_START])} select {SIGNAL_SQL}, {FIT_COLUMNS_SQL} from fits",
)
def feat_expfit_fixed_b(spark, sf_dir):
    out = features.features(rows_of(spark, sf_dir), autocov=False, fit_grid=[features.FIT_START])
    return rounded(out.select(*SIGNAL, *FIT), FIT)


def refine_sql(passes: int = features.REFINE_PASSES, values: int = features.REFINE_VALUES, step: float = 0.125) -> str:
    """The passes of the refinement, each from the best fits of the one before."""
    text = f"""refined0 as (
  select {SIGNAL_SQL}, mse, x_intercept as a, y_intercept as b, log10(y_intercept / -0.1e0) as u, {step!r}e0 as step from fits
)"""
    for p in range(passes):
        text += f""",
asked{p} as (
  select {SIGNAL_SQL}, u, (high - low) / {values + 1} as step, -0.1e0 * pow(10e0, u) as b
  from (
    select *, low + (high - low) * k / {values + 1} as u
    from (select * exclude (u), greatest(0, u - step) as low, least(4, u + step) as high from refined{p}), range(1, {values + 1}) t(k)
  )
),
level{p} as (
  select {SIGNAL_SQL}, u, any_value(b) as b, any_value(step) as step, greatest(0, avg(v + exp(10 * pos / b))) as a
  from signal join asked{p} using ({SIGNAL_SQL}) group by {SIGNAL_SQL}, u
),
tried{p} as (
  select {SIGNAL_SQL}, avg(pow(v - a + exp(10 * pos / b), 2)) as mse, any_value(a) as a, any_value(b) as b, u, any_value(step) as step
  from signal join level{p} using ({SIGNAL_SQL}) group by {SIGNAL_SQL}, u
),
refined{p + 1} as (
  select * replace (max(step) over (partition by {SIGNAL_SQL}, true) as step)
  from (
    select {SIGNAL_SQL}, mse, a, b, u, null as step from refined{p} union all select {SIGNAL_SQL}, mse, a, b, u, step from tried{p}
  )
  qualify row_number() over (partition by {SIGNAL_SQL} order by round(mse, 6), u) = 1
)"""
    return text


@query(
    "feat_expfit_refined",
    segments_sql()
    + f", {fit_sql(features.FIT_GRID)}, {refine_sql()} select {SIGNAL_SQL}, {r('mse', 'mse')}, {r('a', 'x_intercept')}, "
    + f"{r('b', 'y_intercept', 4)} from refined{features.REFINE_PASSES}",
)
def feat_expfit_refined(spark, sf_dir):
    rows = cut(rows_of(spark, sf_dir))
    fits = cut(features.features(rows, autocov=False))
    out = features.refine_fit(fits, rows).select(*SIGNAL, *FIT)
    return rounded(rounded(out, FIT[:2]), FIT[2:], 4)


TABLE_SQL = (
    segments_sql()
    + f", {LAGS_SQL}, {spectrum_cte(0)}, {fit_sql(features.FIT_GRID)}, "
    + f"basics as (select {SIGNAL_SQL}, {BASIC_SQL} from signal group by {SIGNAL_SQL}), "
    + f"covs as (select {SIGNAL_SQL}, {AUTOCOV_SQL} from lagged group by {SIGNAL_SQL})"
)


@query(
    "feature_table",
    TABLE_SQL
    + f""" select {SIGNAL_SQL}, mean, std, cv, slope, dominant_freq, {', '.join(AUTOCOV)}, {FIT_COLUMNS_SQL},
  segment_length, false as bad_signal
from basics join covs using ({SIGNAL_SQL}) join peaks using ({SIGNAL_SQL}) join fits using ({SIGNAL_SQL})""",
)
def feature_table(spark, sf_dir):
    table = signal_blocks.segment_features(point_cloud(spark, sf_dir)).drop("config", "job", "part")
    return rounded(table, [*BASIC, *AUTOCOV, *FIT])


def _fits(spark, sf_dir) -> DataFrame:
    return features.features(rows_of(spark, sf_dir), autocov=False)


@query(
    "feat_mean_sd",
    segments_sql()
    + f", {fit_sql(features.FIT_GRID)} select {r('avg(x_intercept)', 'x_mean')}, {r('stddev_samp(x_intercept)', 'x_sd')}, "
    + f"{r('avg(y_intercept)', 'y_mean')}, {r('stddev_samp(y_intercept)', 'y_sd')} from fits",
)
def feat_mean_sd(spark, sf_dir):
    out = features.mean_sd(_fits(spark, sf_dir))
    return rounded(out, out.columns)


@query(
    "feat_neg_log10",
    segments_sql()
    + f""", {fit_sql(features.FIT_GRID)} select {SIGNAL_SQL}, {r('x_intercept', 'x_intercept')}, {r('-y_intercept', 'y_intercept')},
  {r('case when -y_intercept > 0 then log10(-y_intercept) end', 'log10_y')} from fits""",
)
def feat_neg_log10(spark, sf_dir):
    columns = ["x_intercept", "y_intercept", "log10_y"]
    return rounded(features.negated_log10(_fits(spark, sf_dir)).select(*SIGNAL, *columns), columns)


@query(
    "feat_histogram",
    segments_sql()
    + f""", {fit_sql(features.FIT_GRID)},
ends as (select min(y_intercept) as lo, (max(y_intercept) - min(y_intercept)) / 9 as width from fits),
slots as (
  select cast(greatest(0, least(9, ceil((y_intercept - lo) / width - 0.5e0))) as integer) as bin from fits, ends
  where y_intercept is not null
)
select cast(b.bin as integer) as bin, {r('lo + b.bin * width', 'center')}, count(slots.bin) as n
from range(10) b(bin) cross join ends left join slots on slots.bin = b.bin group by b.bin, lo, width""",
)
def feat_histogram(spark, sf_dir):
    return rounded(features.histogram(cut(_fits(spark, sf_dir)), "y_intercept"), ["center"])


@query(
    "csv_roundtrip",
    segments_sql() + f" select {SIGNAL_SQL}, {BASIC_SQL} from signal group by {SIGNAL_SQL}",
)
def csv_roundtrip(spark, sf_dir):
    table = feat_basic(spark, sf_dir)
    path = scratch_path(spark, "features-csv")
    tables.write_csv(table, path)
    return tables.read_csv(spark, path, table.schema)


@query(
    "map_segments",
    segments_sql()
    + f" select {SIGNAL_SQL}, arg_max(pos, (v, -pos)) as peak_pos, {r('max(v) - min(v)', 'spread')} from signal group by {SIGNAL_SQL}",
)
def map_segments_query(spark, sf_dir):
    def peak(frame):
        at = frame["v"].idxmax()
        head = {c: frame[c].iat[0] for c in SIGNAL}
        return head | {"peak_pos": frame["pos"].iat[at], "high": frame["v"].iat[at], "low": frame["v"].min()}

    signal = features.signals(rows_of(spark, sf_dir))
    best = F.max_by("peak_pos", F.struct("high", -F.col("peak_pos")))
    out = map_segments(
        signal,
        peak,
        "session string, layer int, seg_id long, sensor string, peak_pos long, high double, low double",
        call_rows=8,
        combine=[best.alias("peak_pos"), (F.max("high") - F.min("low")).alias("spread")],
    )
    return rounded(out, ["spread"])
