"""Lines repeated across documents, with built-in functions only.

A line's key is hashed to 128 bits. Occurrences are dealt by ranges of (hash, slice of the
document) and sorted there by document and position, so that a line found everywhere fills many
ranges. A window streams over each slice and marks the first occurrence in each document; the marks
are summed per slice and per hash. Hashes found in enough documents meet their occurrences slice by
slice, and what goes comes back as one bitmap per document. Texts are read twice but only the caller's last join moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolsight.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICES = 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), UPPER, LOWER)


def text_name(text: Column) -> Column:
    """Tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slices: int = SLICES) -> DataFrame:
    """doc_id, text_name, words: which lines of each text go.

    Keys of at least `min_chars` code points that `min_docs` documents hold lose their lines in all
    of them but the largest doc_id. `words` maps i to the bits of lines 64*i .. 64*i+63, a set bit
    meaning that the line stays; words whose lines all stay are left out, and so are texts that
    lose nothing. Null and empty texts are one empty line. Rows without doc_id count as one
    document below all others; rows that repeat a doc_id are one document.
    """
    lines = docs.select(
        F.col("doc_id").cast("long"),
        text_name(F.col("text")).alias("text_name"),
        F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"),
    ).filter(F.char_length("key") >= min_chars)
    hashed = cut(
        lines.select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"),
            "doc_id",
            "text_name",
            "pos",
        )
    )
    slice_of = ["h1", "h2", "slice"]
    stream = Window.partitionBy(*slice_of).orderBy(F.desc("doc_id"), "pos")
    sorted_lines = hashed.repartitionByRange(*slice_of).withColumn("before", F.lag(F.struct("doc_id")).over(stream))
    first = sorted_lines.filter(F.col("before").isNull() | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id")))
    parts = cut(first.groupBy(*slice_of).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
    shared = (
        parts.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.max("last").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    shared_slices = parts.select(*slice_of).join(shared, ["h1", "h2"])
    gone = hashed.join(shared_slices, slice_of).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = gone.groupBy("doc_id", "text_name", F.expr("pos div 64").alias("word")).agg(
        F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    return words.groupBy("doc_id", "text_name").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").cast("int"), "bits"))).alias("words")
    )


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame, kept: str = "_ld_kept") -> DataFrame:
    """Add the array of each text's lines that stay. Row by row: repeated rows stay repeated."""
    maps = bitmaps.select(F.col("doc_id").alias("_ld_id"), F.col("text_name").alias("_ld_name"), F.col("words").alias("_ld_words"))
    joined = docs.withColumn("_ld_own", text_name(F.col("text"))).join(
        maps, F.col("doc_id").cast("long").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_own") == F.col("_ld_name")), "left"
    )
    all_lines = lines_of(F.col("text"))
    stays = F.expr(
        "filter(_ld_lines, (line, i) -> _ld_words[cast(i div 64 as int)] is null"
        " or (shiftright(_ld_words[cast(i div 64 as int)], cast(i % 64 as int)) & 1) = 1)"
    )
    return (
        joined.withColumn("_ld_lines", all_lines)
        .withColumn(kept, F.when(F.col("_ld_words").isNull(), F.col("_ld_lines")).otherwise(stays))
        .drop("_ld_id", "_ld_name", "_ld_words", "_ld_own")
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with each text reduced to the lines that stay, in its own columns; null texts stay null."""
    kept = with_kept_lines(docs, keep_bitmaps(docs, min_chars, min_docs))
    text = F.when(F.col("text").isNotNull(), F.array_join("_ld_kept", "\n"))
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
