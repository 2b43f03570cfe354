import pytest

from poolsight.llm import token_rollups, tool_calls
from poolsight.session import scratch_path

CHANGE = "doc_id long, version string, source string, lang string, tokens long, deleted boolean, seq long"


def totals(store):
    return sorted(map(tuple, store.totals().collect()), key=str)


def test_rollups(spark):
    store = token_rollups.RollupStore(spark, scratch_path(spark, "rollups"))
    assert totals(store) == []
    first = spark.createDataFrame(
        [(1, "v", "a", "en", 5, False, 1), (1, "v", "a", "en", 7, False, 2), (2, "v", None, None, None, None, None), (None, "v", "a", "en", 9, False, 1), (3, "w", "a", "en", 4, True, 1)],
        CHANGE,
    )
    assert store.apply("one", first)
    want = [("a", "en", "v", 1, 7), (None, None, "v", 1, 0)]
    assert totals(store) == sorted(want, key=str)
    assert not store.apply("one", first) and totals(store) == sorted(want, key=str)
    second = spark.createDataFrame([(1, "v", "b", "en", 3, False, 1), (2, "v", None, None, 0, True, 1), (4, "v", "b", "en", 2, False, 1)], CHANGE)
    assert store.apply("two", second)
    assert totals(store) == [("b", "en", "v", 2, 5)]
    assert store.apply("none", second.limit(0)) and totals(store) == [("b", "en", "v", 2, 5)]
    again = token_rollups.RollupStore(spark, store.path)
    assert not again.apply("two", second) and totals(again) == [("b", "en", "v", 2, 5)]


def test_half_written_batch_is_done_again(spark, tmp_path):
    store = token_rollups.RollupStore(spark, str(tmp_path / "rollups"))
    rows = spark.createDataFrame([(1, "v", "a", "en", 5, False, 1)], CHANGE)
    store.apply("one", rows)
    (tmp_path / "rollups/totals/000000001-one/_SUCCESS").unlink()
    assert store.committed() == []
    assert store.apply("one", rows) and totals(store) == [("a", "en", "v", 1, 5)]


def test_a_small_batch_reads_its_buckets_only(spark):
    store = token_rollups.RollupStore(spark, scratch_path(spark, "rollups"), buckets=8)
    rows = [(i, "v", "a", "en", i, False, 1, "x") for i in range(200)]
    store.apply("load", spark.createDataFrame(rows, CHANGE + ", bucket string"))
    assert len(store.entries([3]).inputFiles()) >= 1
    assert store.entries([3]).count() == sum(1 for r in store.entries().select(store.bucket().alias("b")).collect() if r.b == 3)
    plan = store.entries([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.apply("one", spark.createDataFrame([(7, "v", "b", "en", 1000, False, 1), (8, "v", "a", "en", 0, True, 1)], CHANGE))
    assert totals(store) == [("a", "en", "v", 198, sum(range(200)) - 15), ("b", "en", "v", 1, 1000)]
    with pytest.raises(ValueError):
        token_rollups.RollupStore(spark, store.path, buckets=16)


SCHEMAS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}}
CALL = "conv_id long, call_id string, parent_id string, turn long, name string, arguments string, depth string"


def linked(spark, calls, results):
    frame = tool_calls.link_calls(
        spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame(results, "conv_id long, call_id string, result string"), SCHEMAS
    )
    return {(r.conv_id, r.call_id): r for r in frame.collect()}


def test_linked_and_ordered(spark):
    calls = [
        (1, "c", "b", 0, "f", '{"n": 1.0}'),
        (1, "b", "a", 1, "f", '{"n": -1}'),
        (1, "a", None, 2, "f", '{"n": 2, "m": 0}'),
        (1, "a", None, 3, "f", '{"n": 3}'),
        (1, "x", "y", 0, "f", '{"n": 1}'),
        (1, "y", "x", 0, "f", '{"n": 1}'),
        (1, "d", "gone", 9, "g", "{}"),
        (2, "a", None, 0, "f", '{"n": NaN}'),
        (2, "e", None, 0, "f", None),
        (2, None, None, 0, "f", "{}"),
        (None, "a", None, 0, "f", "{}"),
        (3, "z", None, None, None, '{"é": "\\u00e9\\n", "a": [1.0, 2.5, true, null]}'),
    ]
    got = linked(spark, calls, [(1, "c", "late"), (1, "c", "early"), (1, "nobody", "r"), (2, "e", None), (None, "a", "r")])
    assert {k: (r.step, r.depth) for k, r in got.items() if k[0] == 1} == {
        (1, "a"): (0, 0),
        (1, "d"): (1, 0),
        (1, "b"): (2, 1),
        (1, "c"): (3, 2),
        (1, "x"): (4, None),
        (1, "y"): (5, None),
    }
    assert got[1, "c"].status == "done" and got[1, "c"].message == '{"arguments":{"n":1},"id":"c","name":"f","result":"early"}'
    assert got[1, "b"].status == "invalid" and got[1, "b"].errors == ["$.n: below 0"]
    assert got[1, "a"].errors == ["$.m: not allowed"] and got[1, "x"].status == "cycle"
    assert got[1, "d"].errors == ["unknown tool"]
    assert got[2, "a"].errors == ["$: not JSON"] and got[2, "e"].errors == ["$: not JSON"]
    assert got[3, "z"].message == '{"arguments":{"a":[1,2.5,true,null],"é":"é\\n"},"id":"z","name":null,"result":null}'
    assert len(got) == 9


def test_long_chain_and_nothing(spark):
    calls = [(1, str(i), str(i - 1) if i else None, 1000 - i, "f", '{"n": 1}') for i in range(300)]
    got = linked(spark, calls, [(1, str(i), "r") for i in range(0, 300, 2)])
    assert all(r.depth == int(k[1]) == r.step for k, r in got.items())
    assert sum(r.status == "pending" for r in got.values()) == 150
    assert linked(spark, [], []) == {}


@pytest.mark.parametrize(
    ("value", "schema", "errors"),
    [
        ([1, "a"], {"type": "array", "items": {"type": "integer"}}, ["$[1]: not integer"]),
        (True, {"type": ["integer", "null"]}, ["$: not integer or null"]),
        ("x", {"enum": ["a"]}, ["$: not one of the listed values"]),
        ({}, {"required": ["k"]}, ["$.k: missing"]),
    ],
)
def test_schema_errors(value, schema, errors):
    assert tool_calls.schema_errors(value, schema) == errors


def test_text_that_utf8_cannot_hold_and_long_arguments(spark):
    calls = [
        (1, "a", None, 0, "tool", '{"a":"\\ud800"}', 7),
        (1, "b", None, 0, "tool", '{"a":"' + "x" * 200_000 + '"}', 7),
        (1, "c", None, 0, "tool", '{"\\udfff":1}', 7),
    ]
    table = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, turn int, name string, arguments string, depth int")
    results = spark.createDataFrame([], "conv_id long, call_id string, result string")
    got = {r.call_id: r for r in tool_calls.link_calls(table, results, {"tool": {"type": "object"}}).collect()}
    assert [got[c].status for c in "abc"] == ["invalid", "pending", "invalid"]
    assert got["a"].errors == ["$: not JSON"] and len(got["b"].message) > 200_000
    assert tool_calls.link_calls(table.limit(0), results, {}).count() == 0


@pytest.mark.parametrize("schema", [{"type": "text"}, {"pattern": "a"}, {"properties": {"a": {"type": "int"}}}, {"items": {"oneOf": []}}, {"additionalProperties": {}}])
def test_schemas_that_cannot_be_checked(spark, schema):
    empty = spark.createDataFrame([], "conv_id long, call_id string, parent_id string, turn int, name string, arguments string")
    with pytest.raises(ValueError):
        tool_calls.link_calls(empty, spark.createDataFrame([], "conv_id long, call_id string, result string"), {"t": schema})
