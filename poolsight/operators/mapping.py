"""User functions over the signal of a segment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from poolsight.operators.features import SIGNAL

def map_segments(
    signal: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame | dict],
    schema: T.StructType | str,
    call_rows: int,
    combine: Sequence[Column],
) -> DataFrame:
    """Apply `fn` to the frame (keys, seg_part, pos, v) of every part of a segment and sensor.

    Signals are cut into parts of `call_rows` positions, sorted by pos. Tasks stream the sorted rows and
    call `fn` part by part, so that none holds more than a part and a batch, and a part costs a call only.
    `fn` returns rows with the columns of `schema`, the keys among them, as a frame, or one row as a dict,
    which costs less; the aggregates `combine` then make one row per segment and sensor of its parts' rows.
    They are applied to segments of one part as well, so results do not depend on how a segment is cut.
    """
    parts = signal.withColumn("seg_part", F.expr(f"pos div {call_rows}L"))
    columns = [*SIGNAL, "length", "seg_part"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # pieces of the last part, which may go on in the next frame
        for frame in frames:
            if frame.empty:
                continue
            starts = np.flatnonzero(_starts(frame, columns, held[-1] if held else None)).tolist()
            held.append(frame.iloc[: starts[0]] if starts else frame)
            out = []
            for begin, end in zip(starts, [*starts[1:], len(frame)]):
                out.append(_called(fn, held))
                held = [frame.iloc[begin:end]]
            yield from _gathered(out)
        yield from _gathered([_called(fn, held)])

    ordered = parts.select(*columns, "pos", "v").repartition(*columns).sortWithinPartitions(*columns, "pos")
    rows = ordered.mapInPandas(run, schema)
    return rows.groupBy(*[c for c in SIGNAL if c in rows.columns]).agg(*combine)


def _starts(frame: pd.DataFrame, keys: Sequence[str], before: pd.DataFrame | None) -> np.ndarray:
    """Whether a row is the first of its part, given the frame that came before; null keys are equal."""
    new = np.zeros(len(frame), bool)
    for key in keys:
        values = frame[key].to_numpy()
        previous = np.roll(values, 1)
        if before is not None:
            previous[:1] = before[key].to_numpy()[-1:]
        new |= (values != previous) & ~(pd.isna(values) & pd.isna(previous))
    if before is None:
        new[0] = True
    return new


def _called(fn: Callable[[pd.DataFrame], pd.DataFrame | dict], pieces: list[pd.DataFrame]) -> pd.DataFrame | dict:
    pieces = [piece for piece in pieces if len(piece)]
    if not pieces:
        return {}
    part = pieces[0].copy(deep=False) if len(pieces) == 1 else pd.concat(pieces)
    part.index = pd.RangeIndex(len(part))
    return fn(part)


def _gathered(results: list[pd.DataFrame | dict]) -> Iterator[pd.DataFrame]:
    rows = [result for result in results if isinstance(result, dict) and result]
    frames = [result for result in results if not isinstance(result, dict) and len(result)]
    if rows:
        frames.append(pd.DataFrame(rows))
    if frames:
        yield pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
