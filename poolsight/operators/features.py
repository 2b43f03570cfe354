"""Statistical, spectral, autocovariance and decay-fit features per segment and sensor.

All features but the spectral one come out of a single `groupBy`, so Spark combines them
map-side and a long segment is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from poolsight.functions.scalars import let
from poolsight.operators.joins import join_on, join_summary
from poolsight.operators.spectrum import long_spectrum_peak
from poolsight.schema import LAYER, SENSORS
from poolsight.session import cut

LAGS = 9
#: Rows of a segment that one lag window sees; the next `LAGS` rows are added as a margin.
WINDOW_ROWS = 1 << 12
#: Longest segment whose spectrum one task computes; longer ones use the distributed transform.
FFT_ROWS = 1 << 20

#: Fixed values of the decay fit: sample spacing on its x axis, the start and the bound of b.
FIT_STEP = 10.0
FIT_START = -0.1
FIT_LOWER = -1000.0
#: Eight values of b per decade from the start to the bound. Every |b| below 0.27 gives the
#: same curve in double precision, so nothing is gained below the start.
FIT_GRID = tuple(FIT_START * 10.0 ** (j / 8) for j in range(32)) + (FIT_LOWER,)
FIT_DIGITS = 6
#: A pass of the refinement tries this many values of b between the neighbours of a signal's best one.
REFINE_VALUES, REFINE_PASSES = 16, 3

SIGNAL = [*LAYER, "seg_id", "sensor"]
TABLE_ORDER = [
    *["mean", "std", "cv", "slope", "dominant_freq"],
    *[f"autoco_{k}" for k in range(1, LAGS + 1)],
    *["mse", "x_intercept", "y_intercept", "segment_length", "bad_signal"],
]


def signals(rows: DataFrame, sensors: Sequence[str] = tuple(SENSORS)) -> DataFrame:
    """One row per segment, sensor and position: columns `sensor`, `v`."""
    return rows.unpivot([*LAYER, "seg_id", "length", "pos"], list(sensors), "sensor", "v")


def lagged_signals(
    rows: DataFrame, sensors: Sequence[str] = tuple(SENSORS), lags: int = LAGS, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """`signals` plus `lead_1` .. `lead_<lags>`, the values that many rows later.

    The window covers both sensors at once and runs over bounded stretches of a segment; rows
    near the start of a stretch are repeated at the end of the one before.
    """
    home = F.expr(f"pos div {window_rows}L")
    margin = (F.col("pos") % window_rows < lags) & (home > 0)
    within = Window.partitionBy(*LAYER, "seg_id", "stretch").orderBy("pos")
    sample = F.struct(*sensors)
    spread = rows.withColumn(
        "stretch", F.explode(F.when(margin, F.array(home - 1, home)).otherwise(F.array(home)))
    ).withColumn("_at", sample)
    led = spread.select("*", *[F.lead("_at", k).over(within).alias(f"_lead_{k}") for k in range(1, lags + 1)])
    per_sensor = F.array(
        *[
            F.struct(
                F.lit(s).alias("sensor"),
                F.col(s).alias("v"),
                *[F.col(f"_lead_{k}")[s].alias(f"lead_{k}") for k in range(1, lags + 1)],
            )
            for s in sensors
        ]
    )
    return led.filter(F.col("stretch") == home).select(*LAYER, "seg_id", "length", "pos", F.inline(per_sensor))


def is_bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def basic_aggregates() -> list[Column]:
    v, pos = F.col("v"), F.col("pos")
    return [
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.regr_slope(v, pos.cast("double")).alias("slope"),
    ]


def autocov_aggregates(lags: int = LAGS) -> list[Column]:
    """Per lag: covariance of the overlapping parts and the means of both parts."""
    out = []
    for k in range(1, lags + 1):
        lead = F.col(f"lead_{k}")
        out += [
            F.covar_pop("v", lead).alias(f"_cov_{k}"),
            F.avg(F.when(lead.isNotNull(), F.col("v"))).alias(f"_head_{k}"),
            F.avg(lead).alias(f"_tail_{k}"),
        ]
    return out


def autocov_columns(lags: int = LAGS) -> dict[str, Column]:
    """Biased autocovariance about the global mean, from centred parts (no cancellation)."""
    n, mean = F.col("segment_length"), F.col("mean")
    return {
        f"autoco_{k}": F.when(
            n > k,
            (n - k)
            / n
            * (F.col(f"_cov_{k}") + (F.col(f"_head_{k}") - mean) * (F.col(f"_tail_{k}") - mean)),
        )
        for k in range(1, lags + 1)
    }


def fit_aggregates(grid: Sequence[float]) -> list[Column]:
    """Sum of v * exp(x / b) for each b: all the fit needs from the samples besides mean and std."""
    x = F.col("pos") * FIT_STEP
    sums = [F.sum(F.col("v") * F.exp(x / F.lit(b))) for b in grid]
    return [F.array(*sums).alias("weighted")] if sums else []


def grid_curves(grid: Sequence[float]) -> Column:
    """The same curves for every signal: exp(x / b) as ratio of neighbouring samples, distance from the start, b."""
    return F.array(
        *[
            F.struct(
                F.lit(float(np.exp(FIT_STEP / b))).alias("ratio"),
                F.lit(abs(float(np.log10(b / FIT_START)))).alias("distance"),
                F.lit(float(b)).alias("b"),
            )
            for b in grid
        ]
    )


def bracket_curves(values: int) -> Column:
    """Curves at `values` even steps of log b inside the columns `low` and `high`, in decades from the start."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(values)),
        lambda k: let(
            F.col("low") + (F.col("high") - F.col("low")) * k / (values + 1),
            lambda u: let(
                F.lit(FIT_START) * F.pow(F.lit(10.0), u),
                lambda b: F.struct(F.exp(F.lit(FIT_STEP) / b).alias("ratio"), u.alias("distance"), b.alias("b")),
            ),
        ),
    )


def trials(curves: Column) -> Column:
    """Least squares of `a - exp(x / b)`, a >= 0, for each curve, given `weighted` sums in the same order.

    With w = exp(x / b) the best a is max(0, mean(v + w)); the error is the variance of v + w
    plus the squared clipping of a. Mean and variance of w are geometric sums. The least struct
    is the best fit: errors equal after rounding go to the b nearest to the start.
    """
    n, mean, std = F.col("segment_length"), F.col("mean"), F.col("std")

    def trial(weighted: Column, j: Column) -> Column:
        curve = F.get(curves, j)
        r = curve["ratio"]
        sums = F.struct(
            ((1 - F.pow(r, n)) / (n * (1 - r))).alias("mean"),
            ((1 - F.pow(r, 2 * n)) / (n * (1 - r * r))).alias("square"),
        )

        def with_curve(w: Column) -> Column:
            a = F.greatest(F.lit(0.0), mean + w["mean"])
            cov = weighted / n - mean * w["mean"]
            clip = a - mean - w["mean"]
            error = std * std + 2 * cov + w["square"] - w["mean"] * w["mean"] + clip * clip
            return let(
                F.greatest(F.lit(0.0), error),
                lambda mse: F.struct(
                    F.round(mse, FIT_DIGITS).alias("rank"),
                    curve["distance"].alias("distance"),
                    mse.alias("fit_mse"),
                    a.alias("fit_a"),
                    curve["b"].alias("fit_b"),
                ),
            )

        return let(sums, with_curve)

    return F.transform("weighted", trial)


def best_fit(grid: Sequence[float]) -> Column:
    """The best fit over the values of b in `grid`."""
    return F.array_min(trials(grid_curves(grid)))


def refine_fit(
    table: DataFrame,
    rows: DataFrame,
    sensors: Sequence[str] = tuple(SENSORS),
    passes: int = REFINE_PASSES,
    values: int = REFINE_VALUES,
    step: float = 1 / 8,
) -> DataFrame:
    """Fits of `features` with b moved off the grid, whose points are `step` decades apart.

    Each pass puts `values` values of b between the neighbours of a signal's best one, at even steps
    of log b, and sums v * exp(x / b) for each of them in one pass over the samples; the next bracket
    is (values + 1) / 2 times narrower. The best fit so far is kept, so the error never rises. b stays
    between the start and the bound of the grid. Bad signals keep their nulls.
    """
    far = float(np.log10(FIT_LOWER / FIT_START))
    least = F.lit(0.0)
    distance = F.log10(F.col("y_intercept") / FIT_START)
    best = F.struct(
        F.round("mse", FIT_DIGITS).alias("rank"),
        distance.alias("distance"),
        F.col("mse").alias("fit_mse"),
        F.col("x_intercept").alias("fit_a"),
        F.col("y_intercept").alias("fit_b"),
    )
    now = table.filter(F.col("mse").isNotNull()).select(
        *SIGNAL, "segment_length", "mean", "std", best.alias("best"), F.lit(float(step)).alias("step")
    )
    samples = cut(signals(rows, sensors).select(*SIGNAL, "pos", "v"))
    for _ in range(passes):
        at = F.col("best.distance")
        now = now.withColumns(
            {"low": F.greatest(least, at - F.col("step")), "high": F.least(F.lit(far), at + F.col("step"))}
        )
        now = cut(now.withColumn("curves", bracket_curves(values)))
        asked = join_summary(samples, now.select(*SIGNAL, F.col("curves.b").alias("b")), SIGNAL, ["pos"])
        x = F.col("pos") * FIT_STEP
        sums = asked.groupBy(*SIGNAL).agg(
            F.array(*[F.sum(F.col("v") * F.exp(x / F.get("b", F.lit(k)))) for k in range(values)]).alias("weighted")
        )
        now = join_on(now, sums, SIGNAL).select(
            *SIGNAL,
            "segment_length",
            "mean",
            "std",
            F.array_min(F.concat(F.array("best"), trials(F.col("curves")))).alias("best"),
            ((F.col("high") - F.col("low")) / (values + 1)).alias("step"),
        )
    fitted = cut(
        now.select(
            *SIGNAL,
            F.col("best.fit_mse").alias("mse"),
            F.col("best.fit_a").alias("x_intercept"),
            F.col("best.fit_b").alias("y_intercept"),
        )
    )
    return join_on(table.drop("mse", "x_intercept", "y_intercept"), fitted, SIGNAL, "left").select(*table.columns)


def features(
    rows: DataFrame,
    sensors: Sequence[str] = tuple(SENSORS),
    autocov: bool = True,
    fit_grid: Sequence[float] | None = FIT_GRID,
    signs: bool = False,
) -> DataFrame:
    """Features of each (segment, sensor) except the dominant frequency.

    A signal with NaN, infinite or missing values, or with fewer than three rows, gets
    `bad_signal` and null features instead of failing the job.
    """
    source = lagged_signals(rows, sensors) if autocov else signals(rows, sensors)
    grid = [] if fit_grid is None else list(fit_grid)
    sums = source.groupBy(*SIGNAL).agg(
        *sign_aggregates(), *basic_aggregates(), *(autocov_aggregates() if autocov else []), *fit_aggregates(grid)
    )
    return finish(sums, autocov, grid, signs=signs)


def finish(
    sums: DataFrame, autocov: bool, grid: Sequence[float], more: Sequence[str] = (), signs: bool = False
) -> DataFrame:
    """Features from one row of aggregates per signal; columns in `more` are passed on."""
    bad = F.col("has_bad") | (F.col("segment_length") <= 2)
    columns = {
        "mean": F.col("mean"),
        "std": F.col("std"),
        "cv": F.when(F.col("mean") != 0, F.col("std") / F.when(F.col("mean") != 0, F.col("mean"))),
        "slope": F.col("slope"),
        **(autocov_columns() if autocov else {}),
    }
    fit: dict[str, Column] = {}
    if grid:
        # a generator runs once per signal; a struct column would be searched for once per field
        sums = sums.select("*", F.inline(F.array(F.when(~bad, best_fit(grid)))))
        fit = {"mse": F.col("fit_mse"), "x_intercept": F.col("fit_a"), "y_intercept": F.col("fit_b")}
    return sums.select(
        *SIGNAL,
        *more,
        bad.alias("bad_signal"),
        *[F.when(~bad, column).alias(name) for name, column in columns.items()],
        *[column.alias(name) for name, column in fit.items()],
        *(sign_columns() if signs else ["segment_length"]),
    )


def dominant_freq(
    rows: DataFrame,
    sensors: Sequence[str] = tuple(SENSORS),
    skip_dc: bool = False,
    digits: int = 6,
    fft_rows: int = FFT_ROWS,
) -> DataFrame:
    """Index of the largest |rfft| bin (rounded to `digits`), the first on ties.

    Without `skip_dc` a signal of one sign needs no transform: |sum of v| is then the sum of
    |v|, which no other bin exceeds. Only signals of mixed sign are gathered and transformed.
    """
    known = cut(signals(rows, sensors).groupBy(*SIGNAL).agg(*sign_aggregates()).select(*SIGNAL, *sign_columns()))
    return with_spectrum(known, rows, sensors, skip_dc, digits, fft_rows).select(*SIGNAL, "dominant_freq")


def sign_aggregates() -> list[Column]:
    v = F.col("v")
    return [
        F.count("*").alias("segment_length"),
        F.max(is_bad(v)).alias("has_bad"),
        F.min(v).alias("_lowest"),
        F.max(v).alias("_highest"),
    ]


def sign_columns() -> list[Column]:
    one_sign = (F.col("_lowest") >= 0) | (F.col("_highest") <= 0)
    return [F.col("segment_length"), F.col("has_bad"), (one_sign & ~F.col("has_bad")).alias("one_sign")]


def with_spectrum(
    known: DataFrame, rows: DataFrame, sensors: Sequence[str], skip_dc: bool, digits: int, fft_rows: int
) -> DataFrame:
    """Add `dominant_freq` to a stored table with `segment_length`, `has_bad` and `one_sign`.

    One task transforms a signal of up to `fft_rows` rows; longer ones go through the
    distributed transform. Neither is planned when no signal needs it.
    """
    settled = F.lit(False) if skip_dc else F.col("one_sign")
    pending = known.filter(~F.col("has_bad") & ~settled).select(*SIGNAL, "segment_length")
    peaks = []
    short, long = F.col("segment_length") <= fft_rows, F.col("segment_length") > fft_rows
    if not pending.filter(short).isEmpty():
        gathered = (
            signals(rows, sensors)
            .join(pending.filter(short).select(*SIGNAL), SIGNAL, "left_semi")
            .groupBy(*SIGNAL)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
        )
        peaks.append(gathered.select(*SIGNAL, _rfft_peak(skip_dc, digits)(F.col("s.v")).alias("dominant_freq")))
    if not pending.filter(long).isEmpty():
        signal = signals(rows, sensors).join(pending.filter(long).select(*SIGNAL), SIGNAL, "left_semi")
        peaks.append(long_spectrum_peak(signal, SIGNAL, skip_dc, digits))
    zero = F.when(settled, F.lit(0).cast("long"))
    if not peaks:
        return known.withColumn("dominant_freq", zero)
    found = peaks[0] if len(peaks) == 1 else peaks[0].unionByName(peaks[1])
    joined = known.join(found.withColumnRenamed("dominant_freq", "_peak"), SIGNAL, "left")
    return joined.withColumn("dominant_freq", F.coalesce(zero, "_peak")).drop("_peak")


def _rfft_peak(skip_dc: bool, digits: int):
    @F.pandas_udf(T.LongType())
    def peak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            lengths = batch.map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                magnitude = np.abs(np.fft.rfft(np.stack(batch.iloc[at].to_list()).astype(float), axis=1))
                magnitude = np.round(magnitude, digits)
                first = 1 if skip_dc and n > 1 else 0
                out[at] = first + np.argmax(magnitude[:, first:], axis=1)
            yield pd.Series(out)

    return peak


def feature_table(rows: DataFrame, sensors: Sequence[str] = tuple(SENSORS), fft_rows: int = FFT_ROWS) -> DataFrame:
    """The full feature row per (layer, segment, sensor).

    The table is written once; the signals are read again only where a spectrum needs them.
    """
    stored = cut(features(rows, sensors, signs=True))
    table = with_spectrum(stored, rows, sensors, False, 6, fft_rows)
    spectrum = F.when(~F.col("bad_signal"), F.col("dominant_freq")).alias("dominant_freq")
    return table.select(*SIGNAL, *[spectrum if c == "dominant_freq" else c for c in TABLE_ORDER])


def mean_sd(table: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the two fit parameters."""
    return table.agg(
        F.avg("x_intercept").alias("x_mean"),
        F.stddev_samp("x_intercept").alias("x_sd"),
        F.avg("y_intercept").alias("y_mean"),
        F.stddev_samp("y_intercept").alias("y_sd"),
    )


def negated_log10(table: DataFrame) -> DataFrame:
    """`y_intercept` negated, and its log10 where it is positive."""
    flipped = -F.col("y_intercept")
    return table.withColumns(
        {"y_intercept": flipped, "log10_y": F.when(flipped > 0, F.log10(F.when(flipped > 0, flipped)))}
    )


def histogram(table: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width right-closed bins, the first centred on the minimum, the last on the maximum.

    Returns every bin with its centre and count, empty ones included.
    """
    ends = table.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).withColumn(
        "width", (F.col("hi") - F.col("lo")) / (bins - 1)
    )
    all_bins = ends.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    # one row of limits on the broadcast side
    binned = table.filter(F.col(column).isNotNull()).join(F.broadcast(ends))
    slot = F.when(
        F.col("width") > 0,
        F.ceil((F.col(column) - F.col("lo")) / F.when(F.col("width") > 0, F.col("width")) - 0.5),
    ).otherwise(F.lit(0))
    counts = (
        binned.select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), slot)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("center"), F.coalesce("n", F.lit(0)).alias("n")
    )
