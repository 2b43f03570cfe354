"""Token totals kept up to date from signed changes.

A store is a folder with one ledger part per batch (signed entries per document and tokenizer
version: +1 document and +n tokens, or -1 and -n) and one totals part per batch. A batch looks up
what its documents count so far in the ledger, takes that back, adds the new counts, and writes its
entries; then the totals of the last batch plus the entries' sums by source, language and version.
The totals part's success marker is the commit: a batch that has it is not applied again, one that
lost it half-way is overwritten. Ledger parts are split into buckets by a hash of the document, and a
batch reads the buckets of its own documents only. Sums are combined before the shuffle, so a group that holds a third
of all rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolsight.session import cut

ENTRY = "doc_id long, version string, source string, lang string, documents long, tokens long"
TOTAL = "source string, lang string, version string, documents long, tokens long"
GROUP = ["source", "lang", "version"]
#: Buckets of a ledger by default, and tasks that share a bucket in writing.
BUCKETS, WRITERS = 32, 4


class RollupStore:
    """One writer at a time; batches are applied in the order of the calls."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """A store keeps the number of buckets it was made with; others of the same path are refused."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        other = [n for n in self._names(self.path) if n.startswith("entries-") and n != f"entries-{buckets}"]
        if other:
            raise ValueError(f"this store was made with {other[0].removeprefix('entries-')} buckets")

    def _names(self, folder: str) -> list[str]:
        top = self._file(folder)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _exists(self, name: str) -> bool:
        where = self._file(name)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def committed(self) -> list[tuple[int, str]]:
        """(number, batch_id) of the committed batches, in order."""
        done = [n for n in self._names(f"{self.path}/totals") if self._exists(f"{self.path}/totals/{n}/_SUCCESS")]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in done)

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """The signed entries of all committed batches, or of some buckets of theirs."""
        parts = [f"{self._ledger()}/part={n:09d}-{b}" for n, b in self.committed()]
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        reader = self.spark.read.schema(f"{ENTRY}, part string, bucket int").option("basePath", self._ledger())
        found = reader.parquet(*parts)
        return (found if buckets is None else found.filter(F.col("bucket").isin(buckets))).drop("part", "bucket")

    def _ledger(self) -> str:
        return f"{self.path}/entries-{self.buckets}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens; groups without documents are absent."""
        last = self.committed()[-1:]
        if not last:
            return self.spark.createDataFrame([], TOTAL)
        return self.spark.read.schema(TOTAL).parquet(f"{self.path}/totals/{last[0][0]:09d}-{last[0][1]}")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before.

        `changes`: doc_id, version, source, lang, tokens, and optionally `deleted` (boolean) and `seq`.
        A row sets the count of a document under a tokenizer version, or removes it. Of several rows
        for one document and version the one with the largest seq counts (then the largest count).
        Removing what is not there changes nothing. A null count is 0, null sources and languages are
        groups of their own; rows without doc_id or version name no document and are ignored, and so
        are other columns, also one named `bucket`. An empty batch is committed and changes nothing.
        """
        done = self.committed()
        if batch_id in {b for _, b in done}:
            return False
        if "/" in batch_id or not batch_id:
            raise ValueError("batch_id must be a plain name")
        part = f"{(done[-1][0] if done else 0) + 1:09d}-{batch_id}"
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        row = F.struct(
            seq.alias("seq"),
            F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"),
            (~deleted).alias("stays"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
        )
        last = cut(
            changes.select(F.col("doc_id").cast("long"), F.col("version").cast("string"), row.alias("row"))
            .dropna(subset=["doc_id", "version"])
            .groupBy("doc_id", "version")
            .agg(F.max("row").alias("row"))
            .select("doc_id", "version", "row.*")
        )
        columns = ["doc_id", "version", "source", "lang", "documents", "tokens"]
        added = last.filter("stays").select("doc_id", "version", "source", "lang", F.lit(1).cast("long").alias("documents"), "tokens")
        signed = added
        if done:
            touched = [r.bucket for r in last.select(self.bucket().alias("bucket")).distinct().collect()]  # as many as buckets at most
            before = self.entries(touched if len(touched) < self.buckets else None).join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            signed = added.union(before.select(*columns[:4], (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
        entries = (
            signed.groupBy(*columns[:4])
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents <> 0 or tokens <> 0")
        )
        folder = f"{self._ledger()}/part={part}"
        dealt = entries.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(WRITERS)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{ENTRY}, bucket int").parquet(folder)
        sums = [F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")]
        delta = written.groupBy(*GROUP).agg(*sums)
        after = delta.union(self.totals()).groupBy(*GROUP).agg(*sums).filter("documents <> 0 or tokens <> 0")
        after.write.mode("overwrite").parquet(f"{self.path}/totals/{part}")
        return True


def pattern_count(text: Column, pattern: str) -> Column:
    """Matches of a pattern in a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
