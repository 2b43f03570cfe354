import random
from collections import Counter
from zlib import crc32

import pytest

from poolsight.llm import spelling
from poolsight.llm.queries import QUERIES
from poolsight.llm.suffix_index import WordIndex, near_pairs


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(vocabulary, ratio=2):
    out = {}
    for w, n in vocabulary.items():
        around = [v for v in vocabulary if near(w, v)]
        best = min(around, key=lambda v: (-vocabulary[v], v), default=None)
        form = best if best is not None and vocabulary[best] >= ratio * n else None
        out[w] = [n, len(around), form, vocabulary.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row.append(root)
    return out


def words_of(seed, letters, count, longest):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(12))
def test_both_searches_find_each_pair_once(seed):
    words = words_of(seed, ["ab", "aé", "abÿ日"][seed % 3], [1, 6, 60][seed // 4], 7)
    index, asked, found = WordIndex(words), words + ["zzz", "q", "aab"], set()
    for right in (True, False):
        here = set()
        for mine, others in near_pairs(index, asked, right):
            for i, j in zip(mine.tolist(), others.tolist()):
                assert (i, j) not in here
                here.add((i, j))
        half = {(i, j) for i, j in here if words[j].startswith(asked[i][: len(asked[i]) // 2])}
        assert half == here if right else True
        found |= here
    assert found == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("limits", [{}, {"shard_words": 40, "half_words": 8}])
def test_groups_match_brute_force(spark, limits):
    draw = random.Random(3)
    vocabulary = {w: draw.choice([1, 2, 2, 4, 9, 40]) for w in words_of(5, "abcé", 250, 6) + ["x" * 3000, "x" * 2999]}
    rows = [(w, n, "x") for w, n in vocabulary.items()]
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n long, half string"), **limits).collect()
    assert {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in got} == brute(vocabulary)
    assert len(got) == len(vocabulary)


def test_awkward_vocabularies(spark):
    rows = [("abc", 1), ("abc", 2), ("abd", None), (None, 5), ("", 5), ("abe", 6)]
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r.word: (r.n, r.form) for r in got} == {"abc": (3, "abe"), "abd": (0, "abe"), "abe": (6, None)}
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.variant_groups(spark.createDataFrame([("lone", 3)], "word string, n long")).first().root == "lone"
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame(rows, "word string, n long"), ratio=1)


def test_query_on_awkward_texts(spark, tmp_path):
    texts = [(i, "Thought thoughT thougt Àcorn àcorn Acorn. " * (i % 3 + 1) + "x" * (i % 7)) for i in range(200)]
    texts += [(900, None), (901, ""), (902, "12 -- ...\n"), (None, "thought"), (903, "thoughts " * 40000), (903, "thoughts")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as word", "'n' as n").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for doc_id, text in texts:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in got} == brute(vocabulary)
