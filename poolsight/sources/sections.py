"""Microscope exports: one CSV file with a section of numbers per colour channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from poolsight.operators import ordered
from poolsight.operators.joins import join_summary

#: Section headings in the file.
WANTED = "Monochrome (R)"
STOPS = ("Monochrome (G)", "Monochrome (B)")

#: A cell of a CSV line, quoted or not.
CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
DIGITS = r'^(?:\s*\d+\s*|"\s*\d+\s*")$'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (file, line, value); `line` grows along the file.

    Large files are read in splits. A line holds at least its line break, so the byte offset
    of the split plus the line's place in it never meets the next split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    split = Window.partitionBy("file", "start")
    return raw.select("file", (F.col("start") + F.col("at") - F.min("at").over(split)).alias("line"), "value")


def whole_records(lines: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Lines with quoted cells that hold line breaks put together, as (file, line, value) of each record's first line.

    A line starts a record if the quotes before it in its file are even in number. Only files in which a
    line leaves a quote open are looked at more closely. A file whose quotes are odd in all cannot be
    put together; it stays as it is and is listed by `unbalanced_files`.
    """
    counted = lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    files = _quotes(counted)
    marked = join_summary(counted, files, ["file"], ["line"])
    plain = marked.filter(~F.col("_joins")).select("file", "line", "value")
    blocked = marked.filter("_joins").select("file", "line", "value", "_quotes", ordered.block_of("line", block_rows).alias("_blk"))
    summed = ordered.running_sum(blocked, ["file"], "line", F.col("_quotes"), "_until", "_blk")
    first = F.when((F.col("_until") - F.col("_quotes")) % 2 == 0, 1).otherwise(0)
    numbered = ordered.running_sum(summed, ["file"], "line", first, "_record", "_blk")
    joined = numbered.groupBy("file", "_record").agg(
        F.min("line").alias("line"),
        F.array_join(F.array_sort(F.collect_list(F.struct("line", "value")))["value"], "\n").alias("value"),
    )
    return plain.unionByName(joined.drop("_record"))


def unbalanced_files(lines: DataFrame) -> DataFrame:
    """(file, quotes) of files whose number of quotes is odd."""
    counted = lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    return _quotes(counted).filter("quotes % 2 = 1").select("file", "quotes")


def _quotes(counted: DataFrame) -> DataFrame:
    odd = F.col("_quotes") % 2 == 1
    total = counted.groupBy("file").agg(F.sum("_quotes").alias("quotes"), F.max(odd).alias("_open"))
    return total.withColumn("_joins", F.col("_open") & (F.col("quotes") % 2 == 0))


def section_pixels(lines: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Pixels (file, row, col, value) of the wanted section.

    The section runs from its first heading to the first heading of another channel, which
    ends the file wherever it stands. Cells that are not all digits are dropped, and rows and
    columns numbered anew. Cells with line breaks need `whole_records` first. A number beyond 32 bits keeps its place with a null value; see
    `section_rejects`.
    """
    rows = _section_cells(lines).select(
        "file", "line", F.transform("cells", lambda c: c.try_cast("int")).alias("numbers")
    )
    numbered = ordered.with_row_index(rows, ["file"], "line", "row", block_rows)
    return numbered.select("file", "row", F.posexplode("numbers").alias("col", "value"))


def section_rejects(lines: DataFrame) -> DataFrame:
    """(file, line, cell) of numbers in the wanted section that do not fit 32 bits."""
    cells = _section_cells(lines).select("file", "line", F.explode("cells").alias("cell"))
    return cells.filter(F.col("cell").try_cast("int").isNull())


def _section_cells(lines: DataFrame) -> DataFrame:
    """Lines of the wanted section with the digits of their numeric cells, lines without any left out."""
    first_cell = F.trim(F.regexp_replace(F.regexp_extract("value", CELL, 1), '^"|"$', ""))
    headed = lines.withColumn("head", first_cell)
    limits = headed.filter(F.col("head").isin(WANTED, *STOPS)).groupBy("file").agg(
        F.min(F.when(F.col("head") == WANTED, F.col("line"))).alias("opens"),
        F.min(F.when(F.col("head").isin(*STOPS), F.col("line"))).alias("closes"),
    )
    inside = (F.col("line") > F.col("opens")) & (F.col("closes").isNull() | (F.col("line") < F.col("closes")))
    cells = F.filter(
        F.regexp_extract_all("value", F.lit(CELL), F.lit(1)), lambda c: c.rlike(DIGITS)
    )
    digits = F.transform(cells, lambda c: F.regexp_replace(c, r"\D", ""))
    return (
        join_summary(headed, limits, ["file"], ["line"])
        .filter(inside & (F.col("head") != WANTED))
        .select("file", "line", digits.alias("cells"))
        .filter(F.size("cells") > 0)
    )
