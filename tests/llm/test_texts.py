"""Line dedup, mixing, packing, token files and the classifier on awkward rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm_data import WORD, awkward, empty
from poolsight.llm import line_dedup, mixing, packing, quality_rules, token_files
from poolsight.llm.tokens import END_ID, default_tokenizer, encoder
from poolsight.session import scratch_path

SHARED = "A line that is found in three texts"


def library_ids(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_lines(spark):
    docs = awkward(spark)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[5] == "other\nend"
    assert text[6] == SHARED.replace("A line", "A LINE")
    assert text[4].endswith("w59\n\n") and text[7] is None and text[9] == " \n\t "
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


def test_long_texts_of_lines(spark):
    lines = [f"the line with number {i} of them" for i in range(200)]
    docs = spark.createDataFrame([(i, "\n".join(lines + [f"own {i}"])) for i in range(3)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert kept[0] == "own 0" and kept[1] == "own 1" and kept[2].count("\n") == 200


def test_slices_change_nothing(spark):
    docs = awkward(spark)
    one, many = (sorted(map(str, line_dedup.keep_bitmaps(docs, slices=s).collect())) for s in (1, 256))
    assert one == many


def test_mix(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)


def test_pack(spark):
    docs = awkward(spark)
    pieces = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        n = sum(p.length for p in parts)
        assert n == parts[0].sequence_tokens <= 4096 and n & (n - 1) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, parts in by_doc.items():
        ids = np.array(library_ids(texts[doc]), "<u4").tobytes()
        if doc != 11:
            assert b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start)) == ids
    assert sum(p.length for p in by_doc[11]) == 2 * len(library_ids("one"))
    assert packing.pack(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_pack_group(lengths):
    pieces = packing.pack_group(lengths, 64)
    room, seen = defaultdict(int), defaultdict(int)
    for doc, start, n, at, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == room[at] and n > 0
        room[at] += n
    for doc, start, n, at, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == seen[doc]
        seen[doc] += n
    assert dict(seen) == dict(enumerate(lengths))
    assert sorted(room.values()) == sorted(packing.sequence_sizes(sum(lengths), 64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["byte", "bit"]))
def test_blocks(ids, planes):
    assert token_files.decode_block(token_files.encode_block(np.array(ids, np.uint32), planes)).tolist() == ids


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=400))
def test_join_crc(a, b):
    assert token_files.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, planes):
    docs = awkward(spark)
    path = scratch_path(spark, "ids-test")
    token_files.write_ids(docs, path, block_ids=256, planes=planes, shards=4)
    got = token_files.document_digests(spark, path).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = library_ids(r.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = scratch_path(spark, "ids-test")
    token_files.write_ids(empty(spark), path)
    assert token_files.document_digests(spark, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_chunk_encoder(text):
    encode = encoder(default_tokenizer())
    assert np.frombuffer(encode.encode(text.encode()), "<u4").tolist() == library_ids(text)[:-1]


def test_quality_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_rules.fit(docs, labels)
    got = model.add_score(docs).filter(quality_rules.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    right = (got.score >= 0.5) == (got.quality == 1)
    assert right.mean() > 0.98
    assert ((got.score >= 0.5) & (got.quality == 1)).sum() / (got.quality == 1).sum() > 0.99


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (5, 1), (99, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        scored = quality_rules.fit(docs, some).add_score(docs)
        assert scored.columns == docs.columns or set(scored.columns) == set(docs.columns)
        scores = [r.score for r in scored.collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality_rules.fit(empty(spark), labels).weights == ()


def brute_statistics(text):
    t = text or ""
    n, lines = float(len(t)), t.split("\n")
    words, chars = max(float(len(regex.findall(r"[^ \t\n\x0b\f\r]+", t))), 1.0), max(n, 1.0)
    count = lambda pattern: float(len(regex.findall(pattern, t)))
    return {
        "log_chars": math.log1p(n), "word_length": chars / words, "capitals": count(r"\p{Lu}") / chars,
        "capital_words": count(r"\b\p{Lu}{2,}\b") / words, "digits": count("[0-9]") / chars, "marks": count("[!?]") / words,
        "stops": count("[.,;:]") / words, "symbols": count("[#$%&*+=~^@_]") / words, "bars": count(r"[|<>{}()\[\]/\\]") / words,
        "short_words": count(r"\b\p{L}{1,3}\b") / words, "long_words": count(r"\p{L}{13,}") / words,
        "links": count(r"https?:|www\.|[A-Za-z0-9_]@[A-Za-z0-9_]") / words, "line_words": words / len(lines),
        "distinct_words": len(set(regex.split(r"[ \t\n\x0b\f\r]+", t))) / words, "distinct_lines": len(set(lines)) / len(lines),
    }


def test_quality_query_matches_brute_force(spark):
    """Statistics, rules and scores of the whole query against plain Python, rule by rule."""
    from poolsight.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_rules.fit(docs, labels)
    assert len(model.weights) > 3
    extra = awkward(spark).select("doc_id", "text")
    numbers = docs.select("doc_id", "text").unionByName(extra).select("text", quality_rules.statistics(F.col("text")).alias("s")).collect()
    for r in numbers:
        want = brute_statistics(r.text)
        assert r.s.asDict() == pytest.approx(want, rel=1e-12), r.text
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        s, total = brute_statistics(r.text), model.intercept
        for rule, weight in model.weights:
            if all((low is None or s[n] > low) and (high is None or s[n] <= high) for n, low, high in rule.bounds):
                total += weight
        score = 1 / (1 + math.exp(-total))
        assert got[r.doc_id].score == pytest.approx(score, rel=1e-9)
        assert got[r.doc_id].predicted == int(score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), encoder(path)
    assert encode.by_chunks == (name == "word_bpe_49k.json")
    for text in ("a b", "  Two  words\n", "", "Ünï ½ çödé 12 日本", "don't stop"):
        assert np.frombuffer(encode.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tree_rules():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    rules = quality_rules.tree_rules(text, ["a", "b"])
    assert [r.bounds for r in rules] == [
        (("a", None, 0.5),),
        (("a", None, 0.5), ("b", None, 2.0)),
        (("a", None, 0.5), ("b", 2.0, None)),
        (("a", 0.5, None),),
    ]


def test_sha_of_dropped_lines(spark):
    """The empty rest of a text hashes as the empty string."""
    docs = spark.createDataFrame([(i, SHARED) for i in range(4)], "doc_id long, text string")
    kept = line_dedup.with_kept_lines(docs, line_dedup.keep_bitmaps(docs))
    got = {r[0]: r[1] for r in kept.select("doc_id", F.sha2(F.array_join("_ld_kept", "\n"), 256)).collect()}
    assert got[0] == hashlib.sha256(b"").hexdigest() and got[3] == hashlib.sha256(SHARED.encode()).hexdigest()
    assert WORD.findall(SHARED)
