"""Small tables with the awkward cases every operator has to handle."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double"


def awkward(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1, 7, "x", 0.5),
        (2, base.upper(), "en", "a", 1, 7, "x", 0.5),
        (3, base + " more", "en", "b", 1, 7, "x", 0.5),
        (4, base + "\nA line that is found in three texts\n\n", "en", None, 1, 7, "x", 0.5),
        (5, "other\n a line that is found in three texts \nend", None, "b", 1, 7, "x", 0.5),
        (6, "A LINE that is found in three texts", "en", "b", None, 7, "x", 0.5),
        (7, None, "en", "b", None, 7, "x", 0.5),
        (8, "", "en", "c", 0, None, None, None),
        (9, " \n\t ", "en", "c", 0, None, None, None),
        (10, "one", "en", "c", 3, None, None, None),
        (11, "one", "en", "c", 3, None, None, None),
        (11, "one", "en", "c", 3, None, None, None),
        (None, base, "en", "a", 1, 7, "x", 0.5),
        (12, "long " * 30000 + "é日本 <|endoftext|> don't", "en", "d", 1, 7, "x", 0.5),
        (-3, "Ünï ½ çödé 12", "fr", "", 1, 7, "x", 0.5),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows: list[tuple[int, str | None]], width: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) by comparing every pair."""
    sets = {i: shingles(t, width) for i, t in rows}
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                part[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}
