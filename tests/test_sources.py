import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from poolsight.operators import batches
from poolsight.schema import MEASURES, POINT_CLOUD, STATES
from poolsight.sources import pcd, sections, tables
from poolsight.sources.pcd_source import PcdReader, PcdSource
from poolsight.streaming.ingest import ingest_new, read_manifest

SESSION = "2025_03_25_18-52-34.763"
FOLDER = f"session_{SESSION}/config_12_ab3f/job_4_0c1d/sensors/ECAMPCDWriterSink__1"


def pcd_bytes(n, form="binary", seed=0, points=None):
    rng = np.random.default_rng(seed)
    fields = [*MEASURES, *STATES]
    layout = np.dtype([(m, "<f4") for m in MEASURES] + [(s, "<i4") for s in STATES])
    body = np.zeros(n, dtype=layout)
    for m in MEASURES:
        body[m] = rng.integers(0, 1000, n) / 4
    for s in STATES:
        body[s] = rng.integers(0, 2, n)
    header = (
        "# .PCD v0.7\nVERSION 0.7\n"
        f"FIELDS {' '.join(fields)}\nSIZE {' '.join(['4'] * 10)}\nTYPE {' '.join(['F'] * 8 + ['I'] * 2)}\nCOUNT {' '.join(['1'] * 10)}\n"
        f"WIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {points or n}\nDATA {form}\n"
    ).encode()
    if form == "binary":
        return body, header + body.tobytes()
    return body, header + "\n".join(" ".join(str(v) for v in row) for row in body.tolist()).encode()


def put(root, name, content):
    path = os.path.join(root, FOLDER, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def test_path(spark):
    paths = [f"/log/{FOLDER}/7/layer/000.030.pcd", f"/log/{FOLDER}/layer/012.345.pcd", f"/log/{FOLDER}/001.000.pcd", "/log/other/000.030.pcd"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.session, r.config, r.job, r.subfolder, r.layer) for r in pcd.parse_log_path(df).collect()]
    assert got == [
        (SESSION, "12_ab3f", "4_0c1d", 7, 30),
        (SESSION, "12_ab3f", "4_0c1d", None, 12345),
        (SESSION, "12_ab3f", "4_0c1d", None, 1000),
    ]


@pytest.mark.parametrize("form", ["binary", "ascii"])
def test_decode_round_trip(form):
    body, content = pcd_bytes(50, form)
    points = pcd.read_points(content)
    for c in (*MEASURES, *STATES):
        assert (points[c] == body[c]).all()
    assert (points["idx"] == np.arange(50)).all()


@pytest.mark.parametrize("content", [b"", b"FIELDS x\nDATA", b"FIELDS x\nSIZE 4\nTYPE F\nPOINTS 1\nDATA ascii\n1", pcd_bytes(5, points=9)[1], b"\xff\xfe\n"])
def test_damaged_files(content):
    with pytest.raises((ValueError, KeyError)):
        pcd.read_points(content)


def test_ingest_keeps_rejects_and_mixed_parts(spark, tmp_path):
    root, out = str(tmp_path / "log"), str(tmp_path / "cloud")
    bodies = {}
    for i, name in enumerate(["layer/000.030.pcd", "7/layer/000.030.pcd", "000.060.pcd"]):
        bodies[name], content = pcd_bytes(20 + i, ["binary", "ascii"][i % 2], seed=i)
        put(root, name, content)
    put(root, "000.090.pcd", b"not a point cloud")
    put(root, "notes.txt", b"ignored")
    pcd.ingest(spark, root, out)
    cloud = pcd.read_cloud(spark, out)
    assert [f.name for f in cloud.schema.fields] == POINT_CLOUD.names
    groups = {(r.layer, r.subfolder): r["n"] for r in cloud.groupBy("layer", "subfolder").agg(F.count("*").alias("n")).collect()}
    assert groups == {(30, None): 20, (30, 7): 21, (60, None): 22}
    rows = cloud.filter("layer = 60").orderBy("idx").collect()
    assert [r.sensor1 for r in rows] == bodies["000.060.pcd"]["sensor1"].tolist()
    rejects = pcd.read_rejects(spark, out).collect()
    assert len(rejects) == 1 and "000.090.pcd" in rejects[0].path


def test_second_ingest_changes_nothing(spark, tmp_path):
    root, out = str(tmp_path / "log"), str(tmp_path / "cloud")
    put(root, "layer/000.030.pcd", pcd_bytes(20)[1])
    put(root, "000.090.pcd", b"broken")
    for _ in range(2):
        pcd.ingest(spark, root, out)
        assert pcd.read_cloud(spark, out).count() == 20 and pcd.read_rejects(spark, out).count() == 1
    put(root, "layer/000.060.pcd", pcd_bytes(5)[1])
    pcd.ingest(spark, root, out)
    assert pcd.read_cloud(spark, out).count() == 25


@pytest.mark.parametrize("range_bytes", [1000, 1 << 20])
def test_ranges_and_whole_files_agree(spark, tmp_path, range_bytes):
    root, out = str(tmp_path / "log"), str(tmp_path / "cloud")
    body, content = pcd_bytes(500)
    put(root, "000.030.pcd", content)
    put(root, "000.060.pcd", pcd_bytes(300, "ascii", 1)[1])
    put(root, "000.090.pcd", pcd_bytes(0)[1])
    put(root, "000.120.pcd", pcd_bytes(200, points=201)[1])
    put(root, "000.150.pcd", pcd_bytes(200, "ascii", points=201)[1])
    put(root, "7/000.030.pcd", header(POINTS="1") + b"x" * 3000)
    pcd.ingest(spark, root, out, range_bytes)
    whole = pcd.decode_files(pcd.read_files(spark, root).select("path", "content"))
    got = pcd.read_cloud(spark, out, extra=True).orderBy("layer", "subfolder", "idx").collect()
    assert got == whole.filter("idx is not null").select(*POINT_CLOUD.names, "extra").orderBy("layer", "subfolder", "idx").collect()
    assert len(got) == 801
    rejects = {r.path.split("/")[-1]: r.error for r in pcd.read_rejects(spark, out).collect()}
    assert sorted(rejects) == ["000.120.pcd", "000.150.pcd"] and "shorter" in rejects["000.120.pcd"]
    assert spark.read.parquet(out).filter("layer = 90").count() == 1  # a valid file without points


def test_data_source_of_layer_files(spark, tmp_path):
    root = str(tmp_path / "log")
    put(root, "000.030.pcd", pcd_bytes(500)[1])
    put(root, "7/layer/000.060.pcd", pcd_bytes(40, "ascii")[1])
    put(root, "000.090.pcd", b"broken")
    spark.dataSource.register(PcdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("pcd").option("range_bytes", "1000").load(root)
    whole = pcd.decode_files(pcd.read_files(spark, root).select("path", "content"))
    key = lambda df: df.select(*POINT_CLOUD.names).orderBy("layer", "idx").collect()
    assert key(files.filter("error is null")) == key(whole.filter("error is null"))
    assert files.filter("error is not null").count() == 1
    assert files.filter("layer = 60").count() == 40 and files.filter("subfolder = 8").count() == 0
    reader = PcdReader({"path": root, "range_bytes": "1000"}, pcd.DECODED)
    assert list(reader.pushFilters([EqualTo(("layer",), 60), EqualTo(("t",), 1.0)])) == [EqualTo(("t",), 1.0)]
    assert {p.path.split("/")[-1] for p in reader.partitions()} == {"000.060.pcd"}


def test_batch_and_stream_in_one_folder(spark, tmp_path):
    root, out, seen = (str(tmp_path / d) for d in ("log", "cloud", "seen"))
    put(root, "000.030.pcd", pcd_bytes(5)[1])
    pcd.ingest(spark, root, out)
    put(root, "000.060.pcd", pcd_bytes(700)[1])
    ingest_new(spark, root, out, seen, range_bytes=5000).awaitTermination()
    assert pcd.read_cloud(spark, out).count() == 705
    pcd.ingest(spark, root, out)
    assert pcd.read_cloud(spark, out).count() == 705
    assert sorted(r.path.split("/")[-1] for r in read_manifest(spark, out).collect()) == ["000.030.pcd", "000.060.pcd"]
    # a file that turns out damaged, and a reject that is mended, replace what was stored of them
    put(root, "000.030.pcd", b"broken")
    put(root, "000.060.pcd", pcd_bytes(6)[1])
    pcd.ingest(spark, root, out)
    assert pcd.read_cloud(spark, out).count() == 6 and pcd.read_rejects(spark, out).count() == 1
    put(root, "000.030.pcd", pcd_bytes(4)[1])
    pcd.ingest(spark, root, out)
    assert pcd.read_cloud(spark, out).count() == 10 and pcd.read_rejects(spark, out).count() == 0


def test_a_killed_micro_batch_is_repeated(spark, tmp_path, monkeypatch):
    root, out, seen = (str(tmp_path / d) for d in ("log", "cloud", "seen"))
    for i in range(4):
        put(root, f"000.0{i}0.pcd", pcd_bytes(10, seed=i)[1])
    whole = pcd.store

    def half_way(decoded, path):
        whole(decoded, path)
        raise RuntimeError("killed after its points were stored")

    monkeypatch.setattr(pcd, "store", half_way)
    with pytest.raises(Exception, match="killed"):
        ingest_new(spark, root, out, seen, max_files=2).awaitTermination()
    monkeypatch.undo()
    ingest_new(spark, root, out, seen, max_files=2).awaitTermination()
    assert pcd.read_cloud(spark, out).count() == 40
    assert read_manifest(spark, out).count() == 4


def header(**lines):
    known = {"FIELDS": "t x y z sensor0 sensor1 state0 more", "SIZE": "8 8 8 8 8 8 8 8", "TYPE": "F F F F F F F F", "POINTS": "2", "DATA": "ascii"}
    known |= lines
    return "".join(f"{k} {v}\n" for k, v in known.items()).encode() + b"0 1 2 3 4 5 1 7\n0 1 2 3 4 5 nan 8\n"


@pytest.mark.parametrize(
    "lines",
    [{"POINTS": ""}, {"POINTS": "x"}, {"DATA": ""}, {"DATA": "lzf"}, {"COUNT": "2 1 1 1 1 1 1 1"}, {"COUNT": "1"}, {"SIZE": "3 3 3 3 3 3 3 3"},
     {"TYPE": "Q Q Q Q Q Q Q Q"}, {"FIELDS": ""}, {"FIELDS": "t t y z sensor0 sensor1 state0 more"}, {"POINTS": "3"}],
)
def test_damaged_headers_become_rejects(spark, lines):
    files = [(f"/{FOLDER}/000.030.pcd", bytearray(header(**lines))), (f"/{FOLDER}/000.060.pcd", bytearray(header()))]
    rows = pcd.decode_files(spark.createDataFrame(files, "path string, content binary")).collect()
    assert [r.layer for r in rows if r.error] == [30]
    good = [r for r in rows if not r.error]
    assert [(r.state0, r.state1, r.sensor2, r.extra) for r in good] == [(1, None, None, {"more": 7.0}), (None, None, None, {"more": 8.0})]


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out, seen = (str(tmp_path / d) for d in ("log", "cloud", "seen"))
    put(root, "000.030.pcd", pcd_bytes(5)[1])
    ingest_new(spark, root, out, seen).awaitTermination()
    assert pcd.read_cloud(spark, out).count() == 5
    put(root, "000.060.pcd", pcd_bytes(7)[1])
    put(root, "000.090.pcd", b"broken")
    ingest_new(spark, root, out, seen).awaitTermination()
    ingest_new(spark, root, out, seen).awaitTermination()
    assert pcd.read_cloud(spark, out).count() == 12
    assert pcd.read_rejects(spark, out).count() == 1


def test_sessions_and_catalog(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    body, content = pcd_bytes(30)
    frame = spark.createDataFrame([(f"/{FOLDER}/000.030.pcd", bytearray(content))], "path string, content binary")
    points = pcd.decode_files(frame).drop("idx", "path", "error", "extra").toPandas()
    points["subfolder"] = points["subfolder"].astype("Int32")
    points.to_parquet(folder / "2025_03_25_18-52.parquet")
    points.iloc[:0].to_parquet(folder / "2025_03_26_00-00.parquet")
    (folder / "bad.parquet").write_bytes(b"PAR1 nothing")
    (folder / "notes.txt").write_text("x")
    catalog = {r.filename: r for r in tables.session_catalog(spark, str(folder)).collect()}
    good = catalog["2025_03_25_18-52.parquet"]
    assert (good.rows, good.label, good.error) == (30, "2025_03_25_18-30", None) and good.size_mb > 0
    bad = catalog["bad.parquet"]
    assert bad.rows == 0 and bad.size_mb > 0 and bad.error.startswith("1 unreadable: ArrowInvalid")
    none = catalog["2025_03_26_00-00.parquet"]
    assert (none.rows, none.error) == (0, None)
    scanned = tables.scan_sessions(spark, str(folder), tolerant=True).orderBy("idx").collect()
    assert [r.idx for r in scanned] == list(range(30))
    assert [r.sensor0 for r in scanned] == body["sensor0"].tolist()


def test_warehouse_append(spark, tmp_path):
    frame = spark.createDataFrame([(f"/{FOLDER}/000.030.pcd", bytearray(pcd_bytes(4)[1]))], "path string, content binary")
    cloud = pcd.decode_files(frame)
    tables.warehouse_append(cloud, "pcd_rows")
    tables.warehouse_append(cloud, "pcd_rows")
    stored = spark.table("pcd_rows")
    assert stored.count() == 8 and stored.columns[-1] == "subfolder" and len(stored.columns) == 15
    assert dict(stored.dtypes)["state0"] == "string" and dict(stored.dtypes)["layer"] == "bigint"
    spark.sql("drop table pcd_rows")


def test_section_file(spark, tmp_path):
    head = "Header,1\nMonochrome (R)\n1,2,x,3\n\n4,5,,6\n"
    (tmp_path / "a.csv").write_text(head + "Monochrome (G)\n9\nMonochrome (R)\n8\n")
    (tmp_path / "b.csv").write_text("Monochrome (G)\n1\n" + head)
    (tmp_path / "c.csv").write_text('"Monochrome (R)",\n"12"," 7 ","1,5",3\n,,\n' + "".join(f"{i},{i % 7}\n" for i in range(3000)))
    lines = sections.read_lines(spark, str(tmp_path))
    found = {}
    for r in sections.section_pixels(lines, block_rows=64).collect():
        found.setdefault(r.file.split("/")[-1], {}).setdefault(r.row, {})[r.col] = r.value
    image = lambda name: [[row[c] for c in sorted(row)] for _, row in sorted(found[name].items())]
    assert image("a.csv") == [[1, 2, 3], [4, 5, 6]]
    assert "b.csv" not in found
    assert image("c.csv") == [[12, 7, 3]] + [[i, i % 7] for i in range(3000)]


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("Monochrome (R)\n" + "".join(f"{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = sections.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        rows = sections.section_pixels(lines, block_rows=1000).orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in rows] == list(range(20_000))


def walk(sizes, limit):
    acc, batch, out = 0, 0, []
    for s in sizes:
        if acc + s > limit:
            batch, acc = batch + 1, 0
        acc += s
        out.append(batch)
    return out


def test_size_batches(spark):
    rng = np.random.default_rng(4)
    cases = {
        "a": [40, 50, 20, 90, 10, 5],
        "b": [120, 10],
        "c": rng.integers(0, 130, 80).tolist(),
        "d": [0, 0, 150, 0, 0, 30, 70, 0, 1],
        "e": [100] * 9,
    }
    assert walk(cases["a"], 100) == [0, 0, 1, 2, 2, 3] and walk(cases["b"], 100) == [1, 2]
    rows = [(g, f"f{i:04d}", int(s)) for g, sizes in cases.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "grp string, name string, size long").repartition(3)
    got = {}
    for r in batches.size_batches(df, 100).orderBy("grp", "name").collect():
        got.setdefault(r.grp, []).append(r.batch)
    assert got == {g: walk(sizes, 100) for g, sizes in cases.items()}


@pytest.mark.parametrize("seed", range(40))
def test_functions_of_blocks(seed):
    draw = np.random.default_rng(seed)
    sizes, limit = draw.integers(0, draw.choice([3, 40, 130]), 60), 100
    cuts = np.sort(draw.choice(np.arange(1, 60), draw.integers(1, 9), replace=False))
    blocks = np.split(sizes, cuts)
    functions = [batches.transfer(b, limit) for b in blocks]
    entry, batch, whole, found = 0, 0, functions[0], []
    for b, f in zip(blocks, functions):
        found += batches.replay(b, limit, entry, batch).tolist()
        more, entry = f.apply(entry, limit)
        batch += more
    assert found == walk(sizes.tolist(), limit)
    for f in functions[1:]:
        whole = whole.then(f, limit)
    for start in range(0, 160, 7):
        step = (0, start)
        for f in functions:
            more, left = f.apply(step[1], limit)
            step = (step[0] + more, left)
        assert whole.apply(start, limit) == step


@pytest.mark.parametrize(("block_rows", "fan"), [(3, 2), (7, 256)])
def test_size_batches_over_many_blocks(spark, block_rows, fan):
    draw = np.random.default_rng(9)
    cases = {"a": draw.integers(0, 130, 90).tolist(), None: draw.integers(0, 20, 60).tolist(), "b": [500]}
    rows = [(g, f"f{i:04d}", int(s), "x") for g, sizes in cases.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "grp string, name string, size int, batch_of string").repartition(5)
    got = {}
    for r in batches.size_batches(df, 100, block_rows=block_rows, fan=fan).orderBy("name").collect():
        got.setdefault(r.grp, []).append(r.batch)
    assert got == {g: walk(sizes, 100) for g, sizes in cases.items()}
    assert batches.size_batches(df.limit(0), 100).count() == 0


def test_size_batches_of_the_null_group(spark):
    rows = [(None, "a", 60), (None, "b", 60), ("g", "a", 1)]
    got = batches.size_batches(spark.createDataFrame(rows, "grp string, name string, size long"), 100).collect()
    assert sorted((r.grp or "", r.name, r.batch) for r in got) == [("", "a", 0), ("", "b", 1), ("g", "a", 0)]


def test_numbers_beyond_32_bits(spark):
    rows = [("f", 0, "Monochrome (R)"), ("f", 1, "1,12345678901,3"), ("f", 2, "4")]
    lines = spark.createDataFrame(rows, "file string, line long, value string")
    got = sorted((r.row, r.col, r.value or -1) for r in sections.section_pixels(lines).collect())
    assert got == [(0, 0, 1), (0, 1, -1), (0, 2, 3), (1, 0, 4)]
    assert [tuple(r) for r in sections.section_rejects(lines).collect()] == [("f", 1, "12345678901")]


def test_catalog_of_ingested_sessions(spark, tmp_path):
    root, out = str(tmp_path / "log"), str(tmp_path / "cloud")
    put(root, "layer/000.030.pcd", pcd_bytes(20)[1])
    put(root, "000.090.pcd", b"broken")
    pcd.ingest(spark, root, out)
    found = tables.session_catalog(spark, out).collect()
    assert [(r.filename, r.rows, r.error) for r in found] == [(SESSION, 20, None)] and found[0].size_mb > 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, "a,b"), (2, None, 'q"q')], "i int, d double, s string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(back.collect(), key=lambda r: r.i) == sorted(df.collect(), key=lambda r: r.i)


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Monochrome (R)\n1,"a\n2",3\n"4",5\n"x\n\ny ""q"" 7\n",8\n')
    (tmp_path / "b.csv").write_text("Monochrome (R)\n1,2\n3\n")
    (tmp_path / "c.csv").write_text('Monochrome (R)\n1,"2\n3\n')
    lines = sections.read_lines(spark, str(tmp_path))
    found = {}
    for r in sections.section_pixels(sections.whole_records(lines, block_rows=5)).collect():
        found.setdefault(r.file.split("/")[-1], {}).setdefault(r.row, {})[r.col] = r.value
    rows = lambda name: [[row[c] for c in sorted(row)] for _, row in sorted(found[name].items())]
    assert rows("a.csv") == [[1, 3], [4, 5], [8]] and rows("b.csv") == [[1, 2], [3]]
    assert [(r.file.split("/")[-1], r.quotes) for r in sections.unbalanced_files(lines).collect()] == [("c.csv", 1)]
    assert sections.whole_records(lines).filter("file like '%c.csv'").count() == 3


def test_files_are_decoded_to_arrow(spark):
    """No frame is built per file."""
    plan = pcd.decode_files(spark.createDataFrame([], "path string, content binary"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
