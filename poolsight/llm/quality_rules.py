"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are built-in column expressions. Shallow trees are grown on labelled texts;
every path from a root, to a leaf or not, is one rule: a conjunction of bounds on statistics.
The trees grow in Spark; lasso logistic regression on the same bounded sample (`fit_rows`) gives most
rules weight zero. The rest is compiled into one column expression, so scoring is a projection that needs no model object, Python or shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from poolsight.functions.scalars import let
from poolsight.session import cut

#: Labelled texts used to fit, at most about this many, chosen by a hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0003, 11


def statistics(text: Column) -> Column:
    """A struct of numbers that describe a text; null counts as empty, and all are finite.

    Counts that several numbers share are bound once, so no optimizer rule can repeat them.
    """

    def basics(t: Column) -> Column:
        return F.struct(
            t.alias("t"),
            F.char_length(t).cast("double").alias("n"),
            F.greatest(F.regexp_count(t, F.lit(r"\S+")).cast("double"), F.lit(1.0)).alias("words"),
            F.split(t, "\n", -1).alias("lines"),
        )

    def numbers(b: Column) -> Column:
        t, words, lines = b["t"], b["words"], b["lines"]
        chars = F.greatest(b["n"], F.lit(1.0))

        def count(pattern: str) -> Column:
            return F.regexp_count(t, F.lit(pattern)).cast("double")

        found = {
            "log_chars": F.log1p(b["n"]),
            "word_length": chars / words,
            "capitals": count(r"\p{Lu}") / chars,
            "capital_words": count(r"\b\p{Lu}{2,}\b") / words,
            "digits": count(r"[0-9]") / chars,
            "marks": count(r"[!?]") / words,
            "stops": count(r"[.,;:]") / words,
            "symbols": count(r"[#$%&*+=~^@_]") / words,
            "bars": count(r"[|<>{}()\[\]/\\]") / words,
            "short_words": count(r"\b\p{L}{1,3}\b") / words,
            "long_words": count(r"\p{L}{13,}") / words,
            "links": count(r"https?:|www\.|\w@\w") / words,
            "line_words": words / F.size(lines),
            "distinct_words": F.size(F.array_distinct(F.split(t, r"\s+"))) / words,
            "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        }
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return let(let(F.coalesce(text, F.lit("")), basics), numbers)


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, all of which must hold: (name, lower or None, upper or None), lower < value <= upper."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, numbers: Column) -> Column:
        tests = []
        for name, low, high in self.bounds:
            value = numbers[name]
            tests += [value > F.lit(low)] if low is not None else []
            tests += [value <= F.lit(high)] if high is not None else []
        return reduce(lambda a, b: a & b, tests)

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        tests = [values[n] > low for n, low, _ in self.bounds if low is not None]
        tests += [values[n] <= high for n, _, high in self.bounds if high is not None]
        return np.logical_and.reduce(tests)


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The rules of a printed tree ensemble: one for every branch below a root."""
    path: list[tuple[int, str, str, float]] = []
    rules = []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(found[2])], found[3], float(found[4]))]
        bounds: dict[str, tuple[float | None, float | None]] = {}
        for _, name, side, value in path:
            low, high = bounds.get(name, (None, None))
            if side == ">":
                low = value if low is None else max(low, value)
            else:
                high = value if high is None else min(high, value)
            bounds[name] = (low, high)
        rules.append(Rule(tuple(sorted((n, *b) for n, b in bounds.items()))))
    return list(dict.fromkeys(rules))


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; `score` compiles them to a column over the text."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def add_score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """`docs` with a column 0..1, higher where label 1 is likelier. Other columns stay as they are."""
        def scored(numbers: Column) -> Column:
            total = F.lit(float(self.intercept))
            for rule, weight in self.weights:
                total = total + F.when(rule.column(numbers), F.lit(float(weight))).otherwise(0.0)
            return 1 / (1 + F.exp(-total))

        return docs.withColumn(name, let(statistics(F.col("text")), scored))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics and label of at most about `fit_rows` labelled texts that may be learned from."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_qr_id"))
        .agg((F.avg(label) >= 0.5).cast("double").alias("_qr_label"))
    )
    n = known.count()
    place = F.pmod(F.xxhash64("_qr_id"), F.lit(1 << 30))
    chosen = known.filter(place < int((1 << 30) * min(1.0, fit_rows / max(n, 1))))
    joined = docs.select(F.col("doc_id").cast("long").alias("_qr_id"), "text").join(F.broadcast(chosen), "_qr_id")
    numbers = joined.select(F.col("_qr_label").alias("label"), statistics(F.col("text")).alias("numbers"))
    return numbers.select("label", "numbers.*")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    fit_rows: int = FIT_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    lasso: float = LASSO,
) -> RuleModel:
    """Fit on `docs` (doc_id, text) joined with `labels` (doc_id, `label` 0 or 1).

    Only the text enters the statistics. Repeated labels of a document are averaged. Without rows of
    both classes the model has no rules and scores every text with the smoothed share of label 1.
    """
    rows = cut(labelled(docs, labels, label, fit_rows)).coalesce(4)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = log((ones + 1) / (n - ones + 1))
    if ones == 0 or ones == n:
        return RuleModel(prior, ())
    names = rows.columns[1:]
    features = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED
    ).fit(features.select("label", "features"))
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        return RuleModel(prior, ())
    sample = rows.toPandas()
    values = {n: sample[n].to_numpy() for n in names}
    holds = np.stack([rule.holds(values) for rule in rules], axis=1)
    weights, intercept = lasso_logistic(holds, sample["label"].to_numpy(), lasso)
    return RuleModel(intercept, tuple((rule, float(w)) for rule, w in zip(rules, weights) if w != 0.0))


def lasso_logistic(holds: np.ndarray, label: np.ndarray, penalty: float, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty * sum |weight|, by accelerated proximal steps."""
    x = np.concatenate((holds.astype(np.float32), np.ones((len(holds), 1), np.float32)), axis=1)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step = 4 * len(x) / float(np.linalg.norm(v))
    shrink = np.append(np.full(holds.shape[1], step * penalty), 0.0)
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slope = x.T @ ((1 / (1 + np.exp(-(x @ ahead.astype(np.float32))))) - label).astype(np.float32) / len(x)
        moved = ahead - step * slope
        after = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0.0)
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = after + (t - 1) / t_after * (after - w)
        if np.abs(after - w).max() < 1e-5:
            w = after
            break
        w, t = after, t_after
    return w[:-1], float(w[-1])
