"""Session summaries, samples, grids, and file-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolsight.functions import scalars
from poolsight.operators import batches, ordered, sketches, viewer
from poolsight.plans.fixtures import PC_SQL, point_cloud, table
from poolsight.plans.registry import query, r, rounded
from poolsight.schema import MEASURES, STATES
from poolsight.session import cut, scratch_path
from poolsight.sources import pcd, sections, tables

LABEL_SQL = """case when rows >= 1000000000000 then cast(rows // 1000000000000 as varchar) || 'T'
  when rows >= 1000000000 then cast(rows // 1000000000 as varchar) || 'G'
  when rows >= 1000000 then cast(rows // 1000000 as varchar) || 'M'
  when rows >= 1000 then cast(rows // 1000 as varchar) || 'K' else cast(rows as varchar) end"""


def stored_sessions(spark, sf_dir) -> str:
    """The point cloud as one Parquet folder per session, each file in row order."""
    path = scratch_path(spark, "sessions")
    cloud = point_cloud(spark, sf_dir).repartition("session").sortWithinPartitions("session", "idx")
    cloud.drop("idx").write.partitionBy("session").parquet(path)
    return path


@query(
    "session_catalog",
    f"""with {PC_SQL}, files as (select session as filename, count(*) as rows from pc group by session)
select filename, rows, substr(filename, 1, 13) || '-' || {LABEL_SQL} as label, true as has_size, cast(null as varchar) as error from files""",
)
def session_catalog(spark, sf_dir):
    catalog = tables.session_catalog(spark, stored_sessions(spark, sf_dir))
    return catalog.select("filename", "rows", "label", (F.col("size_mb") > 0).alias("has_size"), "error")


@query(
    "scan_sessions",
    f"""with {PC_SQL} select session, layer, row_number() over (partition by session order by idx) - 1 as idx, sensor0, state0 from pc""",
)
def scan_sessions(spark, sf_dir):
    return tables.scan_sessions(spark, stored_sessions(spark, sf_dir)).select("session", "layer", "idx", "sensor0", "state0")


@query(
    "format_rows",
    f"""with sizes as (select o_orderkey, cast(floor(o_totalprice) as bigint) * case o_orderkey % 4
  when 0 then 1 when 1 then 1000 when 2 then 1000000 else 100000000 end as rows from orders)
select o_orderkey, rows, {LABEL_SQL} as label from sizes""",
)
def format_rows(spark, sf_dir):
    scale = F.element_at(F.array(*[F.lit(n).cast("long") for n in (1, 10**3, 10**6, 10**8)]), F.expr("cast(o_orderkey % 4 as int) + 1"))
    sized = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") * scale).alias("rows"))
    return sized.withColumn("label", scalars.format_rows(F.col("rows")))


SAMPLE_SQL = f"""with {PC_SQL},
numbered as (
  select *, row_number() over (partition by session order by idx) - 1 as row_nr, count(*) over (partition by session) as rows from pc
),
sampled as (
  select * from numbered where rows <= 1000 or row_nr % greatest(1, rows // 1000) = 0
)"""


@query("systematic_sample", SAMPLE_SQL + " select session, layer, idx, row_nr, x, y from sampled")
def systematic_sample(spark, sf_dir):
    sample = viewer.systematic_sample(point_cloud(spark, sf_dir), 1000)
    return sample.select("session", "layer", "idx", "row_nr", "x", "y")


LAYERED_SQL = f"""with {PC_SQL},
numbered as (
  select session, layer, idx - 500 * (layer // 30) as idx, x, y,
    row_number() over (partition by session order by layer, idx) - 1 as row_nr, count(*) over (partition by session) as rows from pc
)
select session, layer, idx, row_nr, x, y from numbered where rows <= 400 or row_nr % greatest(1, rows // 400) = 0"""


@query("systematic_sample_layers", LAYERED_SQL)
def systematic_sample_layers(spark, sf_dir):
    """Rows numbered anew in every layer, as `ingest` stores them."""
    cloud = point_cloud(spark, sf_dir).withColumn("idx", F.expr("idx - 500 * (layer div 30)"))
    sample = viewer.systematic_sample(cloud, 400, block_rows=128)
    return sample.select("session", "layer", "idx", "row_nr", "x", "y")


@query(
    "row_index",
    """select o_custkey % 10 as grp, o_orderkey,
  row_number() over (partition by o_custkey % 10 order by o_orderkey) - 1 as row_nr from orders""",
)
def row_index(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("grp"), "o_orderkey")
    return ordered.with_row_index(grouped, ["grp"], "o_orderkey", block_rows=4096)


def _iqr_sql(column: str) -> str:
    return f""",
ranked as (
  select session, {column} as v, row_number() over (partition by session order by {column}) - 1 as place,
    count(*) over (partition by session) - 1 as last from sampled
),
bounds as (
  select session, min(v) filter (place = floor(0.25e0 * last + 0.5e0)) as q1,
    min(v) filter (place = floor(0.75e0 * last + 0.5e0)) as q3 from ranked group by session
)
select s.session, layer, idx, x, y from sampled s join bounds b on s.session = b.session
where {column} between q1 - 3.0e0 * (q3 - q1) and q3 + 3.0e0 * (q3 - q1)"""


@query("iqr_filter", SAMPLE_SQL + _iqr_sql("layer"))
def iqr_filter(spark, sf_dir):
    sample = viewer.systematic_sample(point_cloud(spark, sf_dir), 1000)
    return viewer.iqr_filter(sample).select("session", "layer", "idx", "x", "y")


@query("iqr_filter_signal", f"with {PC_SQL}, sampled as (select * from pc)" + _iqr_sql("y"))
def iqr_filter_signal(spark, sf_dir):
    return viewer.iqr_filter(point_cloud(spark, sf_dir), "y").select("session", "layer", "idx", "x", "y")


@query(
    "layer_parity",
    f"""with {PC_SQL} select idx, layer, cast(layer // 30 % 2 as integer) as parity_30,
  cast(layer // 60 % 2 as integer) as parity_60, cast(layer // 100 % 2 as integer) as parity_100 from pc""",
)
def layer_parity(spark, sf_dir):
    heights = [scalars.layer_parity(F.col("layer"), h).alias(f"parity_{h}") for h in (30, 60, 100)]
    return point_cloud(spark, sf_dir).select("idx", "layer", *heights)


COUNTED = [*MEASURES, *STATES, "config", "job", "subfolder"]


@query(
    "n_unique_all",
    f"with {PC_SQL} select session, layer, "
    + ", ".join(f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_{c}" for c in COUNTED)
    + " from pc group by session, layer",
)
def n_unique_all(spark, sf_dir):
    return viewer.n_unique_all(point_cloud(spark, sf_dir), COUNTED, ["session", "layer"])


@query(
    "n_unique_approx",
    f"with {PC_SQL} select session, "
    + ", ".join(f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_{c}, true as close_{c}" for c in COUNTED)
    + " from pc group by session",
)
def n_unique_approx(spark, sf_dir):
    """Exact counts per session, and whether those merged from the sketches of layers are within the bound."""
    cloud = point_cloud(spark, sf_dir)
    merged = sketches.n_unique_approx(cut(sketches.layer_sketches(cloud, COUNTED)), COUNTED)
    exact = viewer.n_unique_all(cloud, COUNTED, ["session"])
    both = exact.join(merged.withColumnsRenamed({f"n_{c}": f"_{c}" for c in COUNTED}), "session")
    near = [(F.abs(F.col(f"_{c}") - F.col(f"n_{c}")) <= F.col(f"n_{c}") * sketches.DISTINCT_ERROR).alias(f"close_{c}") for c in COUNTED]
    return both.select("session", *[f"n_{c}" for c in COUNTED], *near)


@query(
    "quartiles_approx",
    f"with {PC_SQL} select session, count(*) as n_rows, " + ", ".join(f"true as close_{c}" for c in MEASURES) + " from pc group by session",
)
def quartiles_approx(spark, sf_dir):
    """Whether the ranks of both merged quartiles of every measure are within the bound, per session."""
    cloud = point_cloud(spark, sf_dir)
    stored = cut(sketches.layer_sketches(cloud, quantiles=MEASURES))
    found = cloud
    checks = [F.count("*").alias("n_rows")]
    for c in MEASURES:
        bounds = sketches.quantiles_approx(stored, c, {f"_{c}_1": 0.25, f"_{c}_3": 0.75})
        found = found.join(F.broadcast(bounds), "session")  # one row per session of the fixture
        close = F.lit(True)
        for name, q in ((f"_{c}_1", 0.25), (f"_{c}_3", 0.75)):
            below, upto = F.avg((F.col(c) < F.col(name)).cast("double")), F.avg((F.col(c) <= F.col(name)).cast("double"))
            close &= (below <= q + sketches.RANK_ERROR) & (upto >= q - sketches.RANK_ERROR)
        checks.append(close.alias(f"close_{c}"))
    return found.groupBy("session").agg(*checks)


@query(
    "unique_layers",
    f"with {PC_SQL} select session, count(*) as n_rows, count(distinct layer) as n_layers from pc group by session",
)
def unique_layers(spark, sf_dir):
    return viewer.unique_layers(point_cloud(spark, sf_dir))


@query(
    "extent",
    f"""with {PC_SQL} select session, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max
from pc group by session""",
)
def extent(spark, sf_dir):
    return viewer.extent(point_cloud(spark, sf_dir))


def grid_sql(bins: int) -> str:
    slot = lambda a: (
        f"cast(case when {a}1 > {a}0 then least({bins - 1}, floor(({a} - {a}0) / ({a}1 - {a}0) * {bins})) else {bins - 1} end as integer)"
    )
    return f"""
ends as (select session, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from cloud group by session),
grid as (
  select c.session, {slot('x')} as bx, {slot('y')} as by_, count(*) as n
  from cloud c join ends e on c.session = e.session group by all
)"""


BIG_SQL = "cloud as (select l_suppkey % 4 as session, l_quantity as x, l_extendedprice as y from lineitem)"


def _lineitem_cloud(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("session"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )


@query(
    "density_grid",
    f"with {PC_SQL}, cloud as (select session, x, y from pc), {grid_sql(1000)} select session, bx, by_ as by, n from grid",
)
def density_grid(spark, sf_dir):
    return viewer.density_grid(point_cloud(spark, sf_dir))


@query("density_grid_big", f"with {BIG_SQL}, {grid_sql(1000)} select session, bx, by_ as by, n from grid")
def density_grid_big(spark, sf_dir):
    return viewer.density_grid(_lineitem_cloud(spark, sf_dir))


@query(
    "density_clip",
    f"""with {BIG_SQL}, {grid_sql(100)},
cells as (
  select s.session, coalesce(n, 0) as n from (select distinct session from cloud) s
  cross join range(100) a(bx) cross join range(100) b(by_)
  left join grid g on g.session = s.session and g.bx = a.bx and g.by_ = b.by_
)
select session, {r('quantile_cont(n, 0.98)', 'clip')} from cells group by session""",
)
def density_clip(spark, sf_dir):
    grid = viewer.density_grid(_lineitem_cloud(spark, sf_dir), bins=100)
    return rounded(viewer.density_clip(grid, bins=100), ["clip"])


# --- files ------------------------------------------------------------------------------------

PATHS_SQL = """paths as (
  select event_id, 'log/session_2025_03_' || lpad(cast(event_id % 28 + 1 as varchar), 2, '0') || '_18-52-34.'
    || cast(event_id % 1000 as varchar) || '/config_' || cast(event_id % 20 as varchar) || '_ab' || cast(event_id % 10 as varchar)
    || 'f/job_' || cast(event_id % 7 as varchar) || '_0c' || cast(event_id % 10 as varchar) || 'd/sensors/ECAMPCDWriterSink__1/'
    || case when event_id % 3 = 0 then cast(event_id % 9 as varchar) || '/' else '' end
    || case when event_id % 2 = 0 then 'layer/' else '' end
    || lpad(cast(event_id % 1000 as varchar), 3, '0') || '.' || lpad(cast(30 * event_id % 1000 as varchar), 3, '0')
    || case when event_id % 11 = 0 then '.txt' else '.pcd' end as path
  from events
)"""


def log_paths(spark, sf_dir) -> DataFrame:
    event = F.col("event_id")
    text = lambda c: c.cast("string")
    path = F.concat(
        F.lit("log/session_2025_03_"), F.lpad(text(event % 28 + 1), 2, "0"), F.lit("_18-52-34."), text(event % 1000),
        F.lit("/config_"), text(event % 20), F.lit("_ab"), text(event % 10), F.lit("f/job_"), text(event % 7),
        F.lit("_0c"), text(event % 10), F.lit("d/sensors/ECAMPCDWriterSink__1/"),
        F.when(event % 3 == 0, F.concat(text(event % 9), F.lit("/"))).otherwise(""),
        F.when(event % 2 == 0, "layer/").otherwise(""),
        F.lpad(text(event % 1000), 3, "0"), F.lit("."), F.lpad(text(30 * event % 1000), 3, "0"),
        F.when(event % 11 == 0, ".txt").otherwise(".pcd"),
    )
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"), "value")


PATH_SQL_COLUMNS = """
  regexp_extract(path, 'session_(\\d{4}_\\d{2}_\\d{2}_\\d{2}-\\d{2}-\\d{2}\\.\\d+)/', 1) as session,
  regexp_extract(path, 'config_(\\d+_[a-f0-9]+)/', 1) as config,
  regexp_extract(path, 'job_(\\d+_[a-f0-9]+)/', 1) as job,
  cast(nullif(regexp_extract(path, 'Sink__1/(\\d+)/', 1), '') as integer) as subfolder,
  cast(replace(regexp_extract(path, '(\\d{3}\\.\\d{3})\\.pcd', 1), '.', '') as integer) as layer"""


@query(
    "parse_log_path",
    f"with {PATHS_SQL} select event_id, {PATH_SQL_COLUMNS} from paths where path like '%.pcd'",
)
def parse_log_path(spark, sf_dir):
    return pcd.parse_log_path(log_paths(spark, sf_dir)).select("event_id", "session", "config", "job", "subfolder", "layer")


@query(
    "tag_constants",
    f"with {PATHS_SQL} select e.event_id, value, {PATH_SQL_COLUMNS} from paths join events e using (event_id) where path like '%.pcd'",
)
def tag_constants(spark, sf_dir):
    return pcd.tag_constants(log_paths(spark, sf_dir)).drop("path")


@query(
    "warehouse_projection",
    f"""with {PC_SQL} select t, x, y, z, sensor0, sensor1, sensor2, sensor3, cast(state0 as varchar) as state0,
  cast(state1 as varchar) as state1, cast(layer as bigint) as layer, session, config, job, subfolder from pc""",
)
def warehouse_projection(spark, sf_dir):
    return tables.warehouse_rows(point_cloud(spark, sf_dir))


def layer_files(spark, sf_dir, damaged: bool = False) -> DataFrame:
    """The point cloud as ascii layer files (path, content); every fourth cut short if `damaged`."""
    fields = [*MEASURES, *STATES]
    n = len(fields)
    kinds = ["F"] * len(MEASURES) + ["I"] * len(STATES)
    sizes = ["8"] * len(MEASURES) + ["4"] * len(STATES)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in fields])
    lines = (
        point_cloud(spark, sf_dir)
        .withColumn("session", F.concat(F.lit("2025_03_25_18-52-34."), F.substring("session", 2, 20)))
        .groupBy("session", "layer")
        .agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    )
    total = F.size("lines").cast("string")
    header = F.concat(
        F.lit("# .PCD v0.7\nVERSION 0.7\n"),
        F.lit(f"FIELDS {' '.join(fields)}\nSIZE {' '.join(sizes)}\nTYPE {' '.join(kinds)}\nCOUNT {' '.join(['1'] * n)}\n"),
        F.lit("WIDTH "), total, F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), total, F.lit("\nDATA ascii\n"),
    )
    body = F.array_join("lines.line", "\n")
    if damaged:
        cut_short = F.expr("layer div 30 % 4") == 3
        body = F.when(cut_short, F.substring(body, F.lit(1), F.expr("length(array_join(lines.line, '\n')) div 2"))).otherwise(body)
    # the layer as ddd.ddd, in whole thousands before the dot
    number = F.lpad(F.col("layer").cast("string"), 6, "0")
    path = F.concat(
        F.lit("log/session_"), F.col("session"), F.lit("/config_1_c/job_1_a/sensors/ECAMPCDWriterSink__1/layer/"),
        F.substring(number, 1, 3), F.lit("."), F.substring(number, 4, 3), F.lit(".pcd"),
    )
    return lines.select(path.alias("path"), F.encode(F.concat(header, body), "UTF-8").alias("content"))


@query(
    "ingest_point_cloud",
    f"""with {PC_SQL} select '2025_03_25_18-52-34.' || substr(session, 2) as session, layer, '1_c' as config, '1_a' as job,
  cast(null as integer) as subfolder, idx - 500 * (layer // 30) as idx, t, x, y, z, sensor0, sensor1, sensor2, sensor3, state0, state1 from pc""",
)
def ingest_point_cloud(spark, sf_dir):
    """Decoded, written and read back twice: a second ingest changes nothing."""
    path = scratch_path(spark, "cloud")
    for _ in range(2):
        decoded = pcd.layout(pcd.decode_files(layer_files(spark, sf_dir)))
        pcd.store(decoded, path)
    return pcd.read_cloud(spark, path)


@query(
    "tolerant_read",
    f"""with {PC_SQL} select '2025_03_25_18-52-34.' || substr(session, 2) as session, layer, layer // 30 % 4 = 3 as failed,
  count(*) filter (layer // 30 % 4 <> 3) as n_points from pc group by session, layer""",
)
def tolerant_read(spark, sf_dir):
    decoded = pcd.decode_files(layer_files(spark, sf_dir, damaged=True))
    return decoded.groupBy("session", "layer").agg(
        F.max(F.col("error").isNotNull()).alias("failed"), F.count("idx").alias("n_points")
    )


LINES_SQL = """lines as (
  select event_id // 1000 as file, event_id % 1000 as line,
    case when event_id % 1000 = 700 then 'Monochrome (B)'
      when event_id % 1000 = 650 or (event_id // 1000 % 5 = 3 and event_id % 1000 = 1) then ' Monochrome (G) ,,'
      when event_id % 1000 = 5 then 'Monochrome (R),,'
      when event_id % 97 = 0 then ''
      when event_id % 89 = 0 then 'x, ,-4'
      else cast(user_id as varchar) || ',' || event_type || ', ' || cast(event_id % 256 as varchar) || ' ,,"' || cast(event_id % 11 as varchar) || '",1.5'
    end as value
  from events
)"""


def section_lines(spark, sf_dir) -> DataFrame:
    event = F.col("event_id")
    at, file = event % 1000, F.expr("event_id div 1000")
    text = lambda c: c.cast("string")
    numbers = F.concat(
        text(F.col("user_id")), F.lit(","), F.col("event_type"), F.lit(", "), text(event % 256), F.lit(' ,,"'),
        text(event % 11), F.lit('",1.5'),
    )
    value = (
        F.when(at == 700, "Monochrome (B)")
        .when((at == 650) | ((file % 5 == 3) & (at == 1)), " Monochrome (G) ,,")
        .when(at == 5, "Monochrome (R),,")
        .when(event % 97 == 0, "")
        .when(event % 89 == 0, "x, ,-4")
        .otherwise(numbers)
    )
    return table(spark, sf_dir, "events").select(file.alias("file"), at.alias("line"), value.alias("value"))


@query(
    "sectioned_csv",
    f"""with {LINES_SQL},
limits as (
  select file, min(line) filter (value like 'Monochrome (R)%') as opens,
    min(line) filter (value like '%Monochrome (G)%' or value like 'Monochrome (B)%') as closes from lines group by file
),
cells as (
  select file, line, pos, trim(replace(cell, '"', '')) as cell
  from (
    select l.file, line, unnest(string_split(value, ',')) as cell, unnest(range(len(string_split(value, ',')))) as pos
    from lines l join limits using (file) where line > opens and line < closes
  ) where regexp_full_match(trim(replace(cell, '"', '')), '[0-9]+')
)
select file, dense_rank() over (partition by file order by line) - 1 as row,
  cast(row_number() over (partition by file, line order by pos) - 1 as integer) as col, cast(cell as integer) as value from cells""",
)
def sectioned_csv(spark, sf_dir):
    return sections.section_pixels(section_lines(spark, sf_dir), block_rows=256)


@query(
    "size_batches",
    """with recursive files as (
  select lang as grp, doc_id as name, n_chars as size, row_number() over (partition by lang order by doc_id) as i from documents
),
walk as (
  select grp, i, name, size, size as acc, case when size > 20000 then 1 else 0 end as batch from files where i = 1
  union all
  select f.grp, f.i, f.name, f.size, case when acc + f.size > 20000 then f.size else acc + f.size end,
    batch + case when acc + f.size > 20000 then 1 else 0 end
  from walk w join files f on f.grp = w.grp and f.i = w.i + 1
)
select grp, name, size, cast(batch as bigint) as batch from walk""",
)
def size_batches(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("name"), F.col("n_chars").alias("size")
    )
    return batches.size_batches(files, 20_000)
