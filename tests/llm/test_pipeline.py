"""The stages on their own inputs, against plain Python."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from llm_data import WORD, awkward, brute_components, empty


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def brute_lines(rows):
    """doc_id -> text without repeated lines, for unique ids."""
    held = defaultdict(set)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {
        i: None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in rows
    }


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mix", "pack"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stored(spark, stage(spark, docs, sf_dir), tmp_path / name)
        if name != "pack":
            assert out[name].columns == docs.columns
        docs = out[name]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    first = {r.doc_id: r.text for r in out["quality"].collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in first for i in clean) >= 0.98 * len(clean)
    assert sum(labels.get(i) == 0 for i in first) <= 0.1 * sum(q == 0 for q in labels.values())
    lines = {r.doc_id: r.text for r in out["lines"].collect()}
    assert lines == brute_lines(list(first.items()))
    unique = {r.doc_id: r.text for r in out["near_duplicates"].collect()}
    parts = brute_components(list(lines.items()), 5)
    assert unique == {i: t for i, t in lines.items() if parts[i][1] == i}
    mixed = [(r.doc_id, r.text) for r in out["mix"].collect()]
    assert all(unique[i] == t for i, t in mixed) and max(Counter(i for i, _ in mixed).values()) <= 3
    total = sum(len(WORD.findall(t or "")) for t in unique.values())
    assert abs(sum(len(WORD.findall(t or "")) for _, t in mixed) - total) <= 0.2 * total
    pieces = out["pack"].collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in mixed)
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)


def test_awkward_rows(spark, tmp_path):
    for n, docs in enumerate((awkward(spark), empty(spark))):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(spark, stage(spark, docs, "/root/testdata/sf0.001"), tmp_path / f"{n}-{name}")
            assert name == "pack" or docs.columns == columns
