"""Column expressions over array columns; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def _double_sql(v) -> str:
    v = float(v)
    if v != v:
        return "double('NaN')"
    if v in (float("inf"), float("-inf")):
        return f"double('{'Infinity' if v > 0 else '-Infinity'}')"
    return f"{v!r}D"


def literal_array(values: Iterable[float]) -> Column:
    """A constant ARRAY<DOUBLE>; built by one parse rather than one call per item."""
    return F.expr("cast(array(" + ",".join(_double_sql(v) for v in values) + ") AS array<double>)")


def center(y: Column, mean: Iterable[float]) -> Column:
    return F.zip_with(y, literal_array(mean), lambda a, m: a - m)


def densify(entries: str, d: int, missing: str = "0D") -> Column:
    """Array of ``d`` values from a sorted array of structs ``(c, v)``.

    Each entry is preceded by as many fill values as columns were skipped, so
    the cost is linear in ``d`` (a map lookup per column would be quadratic).
    """
    fill = f"cast({missing} AS double)"
    return F.expr(
        f"""concat(
          flatten(transform({entries}, (x, p) -> concat(
            array_repeat({fill}, x.c - coalesce(get({entries}, p - 1).c, -1) - 1), array(x.v)))),
          array_repeat({fill}, {d} - 1 - coalesce(get({entries}, size({entries}) - 1).c, -1)))"""
    )


def parse_numbers(text: Column) -> Column:
    """Whitespace-separated numbers -> ARRAY<DOUBLE>."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ").cast("array<double>")


def parse_bracketed(text: Column) -> Column:
    """``[1.0 2.0 ...]`` (line breaks allowed) -> ARRAY<DOUBLE>."""
    return parse_numbers(F.regexp_replace(text, r"[\[\]]", " "))


def parse_vector_text(text: Column) -> Column:
    """``(size,[i,..],[v,..])`` -> STRUCT<size, indices, values>."""
    shape = r"^\s*\(\s*(\d+)\s*,\s*(\[[^\]]*\])\s*,\s*(\[[^\]]*\])\s*\)\s*$"
    return F.struct(
        F.regexp_extract(text, shape, 1).cast("int").alias("size"),
        F.from_json(F.regexp_extract(text, shape, 2), "array<int>").alias("indices"),
        F.from_json(F.regexp_extract(text, shape, 3), "array<double>").alias("values"),
    )


def format_dense(y: Column) -> Column:
    return F.array_join(y.cast("array<string>"), " ", "NaN")


def format_lil(y: Column) -> Column:
    """``{j:v,...}``; zeros become NULL, which array_join leaves out."""
    cells = F.transform(
        y, lambda v, j: F.when(v != 0, F.concat(j.cast("string"), F.lit(":"), v.cast("string")))
    )
    return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))


def format_coo(row: Column, col: Column, value: Column) -> Column:
    return F.concat_ws(",", row.cast("string"), col.cast("string"), value.cast("string"))


def format_vector(y: Column) -> Column:
    """Dense array as ``(size,[i,..],[v,..])`` with its non-zero entries."""
    kept = F.filter(
        F.transform(y, lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda s: s["v"] != 0
    )
    part = lambda name: F.array_join(F.transform(kept, lambda s: s[name].cast("string")), ",")
    return F.concat(
        F.lit("("), F.size(y).cast("string"), F.lit(",["), part("j"), F.lit("],["), part("v"), F.lit("])")
    )
