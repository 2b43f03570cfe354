"""Scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Unit suffixes of a row count.
UNITS = [(10**12, "T"), (10**9, "G"), (10**6, "M"), (10**3, "K")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute `value` once and use it many times, also inside lambdas.

    A column computed in an earlier select may be merged into the expressions that use it; a
    lambda variable is not.
    """
    return F.transform(F.array(value), use)[0]


def format_rows(rows: Column) -> Column:
    """Row count with a K/M/G/T suffix, each divided by its own unit."""
    text = rows.cast("string")
    for size, suffix in reversed(UNITS):
        text = F.when(rows >= size, F.concat(F.floor(rows / size).cast("string"), F.lit(suffix))).otherwise(text)
    return text


def session_label(filename: Column, rows: Column) -> Column:
    """Menu label of a session: the first 13 characters of its file name and its size."""
    return F.concat(F.substring(filename, 1, 13), F.lit("-"), format_rows(rows))


def layer_parity(layer: Column, layer_height: int) -> Column:
    """Alternating 0/1 colour of a layer, for layer heights of 30, 60 or 100 micrometres."""
    return F.pmod(F.floor(layer / layer_height), F.lit(2)).cast("int")


def roi_role(name: Column, magnification: Column) -> Column:
    """Role of a mark by name: `defect`, `scale`, `anchor`, `line` or `unhandled`."""
    defect, scale = name.contains("-"), name.contains("1mm")
    anchor = name.contains("top") | name.contains("bottom") | name.contains("middle")
    at_20 = F.when(scale, "scale").otherwise("line")
    at_150 = F.when(name == "1mm", "scale").when(defect, "defect").when(anchor, "anchor").otherwise("unhandled")
    at_500 = F.when(defect, "defect").when(scale, "scale").otherwise("anchor")
    return (
        F.when(magnification == 20, at_20)
        .when(magnification == 150, at_150)
        .when(magnification == 500, at_500)
        .otherwise("unhandled")
    )


def mark_name(name: Column) -> Column:
    """Mark name without its file suffix, with the known misspelling `bottm` put right."""
    return F.regexp_replace(F.regexp_replace(name, r"\.roi$", ""), "^bottm", "bottom")
