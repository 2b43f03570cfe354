"""Exact spectrum peaks of signals too long for one task.

A transform of any length n is a convolution with a chirp (Bluestein 1970), and a transform of
power-of-two length M = R * C splits into transforms of its columns, a twiddle, and transforms
of its rows (Cooley and Tukey 1965). Each column and row is one small group, so a signal of
2^36 samples needs groups of 2^19 only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def long_spectrum_peak(signal: DataFrame, keys: Sequence[str], skip_dc: bool, digits: int) -> DataFrame:
    """Largest |rfft| bin per key, for rows (keys, length, pos, v); the first bin on ties."""
    keys = list(keys)
    n, pos = F.col("length"), F.col("pos")
    bits = "cast(ceil(log2(2D * length)) as int)"
    sized = signal.withColumns(
        {"size": F.expr(f"shiftleft(1L, {bits})"), "width": F.expr(f"shiftleft(1L, {bits} div 2)")}
    )
    cos, sin = _chirp("pos")
    base = [*keys, "length", "size", "width"]
    # the signal times the chirp, padded with (implied) zeros
    first = sized.select(*base, "pos", (F.col("v") * cos).alias("re"), (-F.col("v") * sin).alias("im"))
    # the conjugate chirp at 0..n-1 and mirrored at size-1, size-2, ..
    chirp = sized.select(*base, "pos", cos.alias("re"), sin.alias("im"))
    mirrored = chirp.filter(pos > 0).withColumn("pos", F.col("size") - pos)
    left = _transform(first, base, -1)
    right = _transform(chirp.unionByName(mirrored), base, -1)
    product = left.alias("a").join(right.withColumnsRenamed({"re": "re2", "im": "im2"}).alias("b"), [*base, "pos"])
    spectrum = _transform(
        product.select(
            *base,
            "pos",
            (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
            (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
        ),
        base,
        +1,
    )
    # the last chirp factor has modulus one and drops out of the magnitude
    magnitude = F.round(F.sqrt(F.pow("re", 2) + F.pow("im", 2)) / F.col("size"), digits)
    bins = spectrum.filter((F.col("pos") <= F.floor(n / 2)) & (F.col("pos") >= (1 if skip_dc else 0)))
    best = F.max(F.struct(magnitude.alias("m"), (-F.col("pos")).alias("at")))
    return bins.groupBy(*keys).agg(best.alias("best")).select(*keys, (-F.col("best.at")).cast("long").alias("dominant_freq"))


def _chirp(position: str) -> tuple[Column, Column]:
    """cos and sin of pi * k^2 / n, with k^2 reduced modulo 2n in exact decimals."""
    squared = F.expr(f"pmod(cast({position} as decimal(19,0)) * {position}, cast(2 * length as decimal(19,0)))")
    angle = squared.cast("double") * np.pi / F.col("length")
    return F.cos(angle), F.sin(angle)


def _transform(points: DataFrame, base: list[str], sign: int) -> DataFrame:
    """Unnormalised transform of sparse points over `size` positions; `width` columns."""
    width = F.col("width")
    split = points.withColumns({"col": F.col("pos") % width, "row": F.expr("pos div width")})
    columns = split.groupBy(*base, "col").applyInPandas(_lines("row", "col", sign, True), _schema(points, base, "row", "col"))
    # full columns arrive; absent ones are all zero
    rows = columns.groupBy(*base, "row").applyInPandas(_lines("col", "row", sign, False), _schema(points, base, "row", "col"))
    height = F.expr("size div width")
    return rows.select(*base, (F.col("row") + F.col("col") * height).alias("pos"), "re", "im")


def _lines(along: str, fixed: str, sign: int, twiddle: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        width, size = int(frame["width"].iloc[0]), int(frame["size"].iloc[0])
        count = size // width if along == "row" else width
        line = np.zeros(count, dtype=complex)
        line[frame[along].to_numpy()] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        out = np.fft.fft(line) if sign < 0 else np.fft.ifft(line) * count
        index = np.arange(count)
        place = int(frame[fixed].iloc[0])
        if twiddle:
            out = out * np.exp(sign * 2j * np.pi * ((index * place) % size) / size)
        head = frame.drop(columns=["re", "im", "pos", "row", "col"], errors="ignore").iloc[[0] * count]
        return head.assign(**{along: index, fixed: place, "re": out.real, "im": out.imag}).reset_index(drop=True)

    return run


def _schema(points: DataFrame, base: list[str], *positions: str) -> str:
    types = dict(points.dtypes)
    fields = [f"{c} {types[c]}" for c in base] + [f"{p} long" for p in positions] + ["re double", "im double"]
    return ", ".join(fields)
