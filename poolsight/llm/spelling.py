"""Spelling variants: words of a vocabulary that differ by one code point, found in suffix indexes.

Two words one error apart share the first or the second half of either of them. Every word is dealt
to the shards named by its possible halves, and is looked up in the two shards named by its own
halves. A shard holds a bidirectional FM-index of its words (`suffix_index`): one half is matched
exactly, and the search goes on across the other half with one error.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolsight.llm.runs import key_runs
from poolsight.llm.suffix_index import WordIndex, near_pairs
from poolsight.session import cut

#: Index entries of a shard on average, and of one half before its words are dealt to several shards.
SHARD_WORDS, HALF_WORDS = 1 << 15, 1 << 16
MAX_ROUNDS = 64

_FOUND = "word string, n_near long, near string, near_n long"
_DATA, _FIRST, _SECOND = 0, 1, 2


def _halves(lengths: list[Column]) -> Column:
    """(side, half) of `word` for each word length in `lengths`, once each."""
    def of(length: Column) -> list[Column]:
        first = (length / 2).cast("int")
        rest = length - first
        return [
            F.struct(F.lit(_FIRST).alias("side"), F.substring("word", F.lit(1), first).alias("half")),
            F.struct(F.lit(_SECOND).alias("side"), F.substring("word", F.length("word") - rest + 1, rest).alias("half")),
        ]

    return F.array_distinct(F.array(*[half for length in lengths for half in of(length)]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in key_runs(batches, 1):
        role = rows.column("role").to_numpy()
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        own = {words[i]: n[i] for i in np.flatnonzero(role == _DATA)}
        asked = np.flatnonzero(role != _DATA)
        if not own or not len(asked):
            continue
        known = sorted(own)
        counts = np.array([own[w] for w in known], np.int64)
        index = WordIndex(known)
        slices, part = rows.column("slices").to_numpy(), rows.column("part").to_numpy()
        for side in (_FIRST, _SECOND):
            who = asked[role[asked] == side]
            queries = [words[i] for i in who]
            for mine, found in near_pairs(index, queries, right=side == _FIRST):
                keep = np.ones(len(mine), bool)
                if side == _SECOND:  # what the first half has found already
                    keep = np.array([not known[b].startswith(queries[a][: len(queries[a]) // 2]) for a, b in zip(mine, found)], bool)
                split = keep & (slices[who[mine]] > 1)
                for i in np.flatnonzero(split):  # words of another slice, here for another half
                    keep[i] = crc32(known[found[i]].encode()) % int(slices[who[mine[i]]]) == part[who[mine[i]]]
                mine, found = mine[keep], found[keep]
                if not len(mine):
                    continue
                order = np.lexsort((found, -counts[found], mine))
                mine, found = mine[order], found[order]
                first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([queries[i] for i in mine[first]], pa.string()),
                        pa.array(np.diff(np.append(first, len(mine))), pa.int64()),
                        pa.array([known[i] for i in found[first]], pa.string()),
                        pa.array(counts[found[first]], pa.int64()),
                    ],
                    ["word", "n_near", "near", "near_n"],
                )


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, half_words: int = HALF_WORDS) -> DataFrame:
    """word, n_near, near, near_n for every word that has near words.

    `vocabulary` holds `word` (distinct; nulls and empty words take no part, nor may words hold U+0000)
    and `n`. Near words differ by exactly one inserted, deleted or replaced code point; `near` is the one
    with the largest n, ties to the smallest in code-point order. Words may have any length. An empty
    vocabulary gives no rows. A half shared by more than `half_words` entries is cut into slices, and
    the words that ask for it are copied to each.
    """
    words = vocabulary.select(F.col("word").cast("string"), F.col("n").cast("long")).filter("word is not null and word <> ''")
    size = F.length("word")
    entries = cut(words.select("word", "n", F.inline(_halves([size - 1, size, size + 1]))))
    total = entries.count()
    if not total:
        return entries.sparkSession.createDataFrame([], _FOUND)
    shards = -(-total // shard_words)
    crowded = cut(
        entries.groupBy("side", "half")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > half_words)
        .select("side", "half", F.ceil(F.col("_n") / half_words).cast("int").alias("slices"))
    )
    asked = words.select("word", "n", F.inline(_halves([size])))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(crowded, ["side", "half"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))

    def shard() -> Column:
        return F.pmod(F.xxhash64("side", "half", "part"), F.lit(shards))

    data = (
        dealt(entries)
        .withColumn("part", F.pmod(F.crc32(F.col("word").cast("binary")), F.col("slices").cast("long")).cast("int"))
        .select(shard().alias("shard"), F.lit(_DATA).alias("role"), "word", "n", F.lit(1).alias("slices"), F.lit(0).alias("part"))
    )
    queries = (
        dealt(asked)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(shard().alias("shard"), F.col("side").alias("role"), "word", "n", "slices", "part")
    )
    found = (
        data.union(queries)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_search, _FOUND)
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached along (word, form); no cycles, as n grows along forms."""
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ahead.join(onward, "root", "left")
        ahead = cut(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            return ahead.select("word", "root")
    raise RuntimeError(f"forms did not settle in {MAX_ROUNDS} rounds")


def variant_groups(vocabulary: DataFrame, ratio: float = 2, shard_words: int = SHARD_WORDS, half_words: int = HALF_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of `vocabulary` (word, n).

    `form` is the near word of largest n (ties: smallest), if that n is at least `ratio` times the
    word's n (`ratio` above 1), else null. `root` is reached by following forms; a word without form
    is its own. Rows with a null or empty word are left out, repeated words are added up first, a null
    n counts as 0; other columns of `vocabulary` are ignored, an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    counted = cut(
        vocabulary.filter("word is not null and word <> ''")
        .groupBy(F.col("word").cast("string").alias("word"))
        .agg(F.sum(F.coalesce(F.col("n").cast("long"), F.lit(0))).alias("n"))
    )
    near = near_words(counted, shard_words, half_words)
    enough = (F.col("near_n") >= F.col("n") * ratio) & (F.col("near_n") > F.col("n"))
    formed = cut(
        counted.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("near")).alias("form"),
            F.when(enough, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs_of_letters(text: Column) -> Column:
    """Maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), only A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.translate(w, upper, upper.lower()))
