"""Structured values to text, the way a spreadsheet row is flattened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _float_text(c: Column) -> Column:
    """Shortest round-trip text where the JVM would use an exponent, in Python's form."""
    plain = c.cast("string")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(plain, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.replace(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("."), F.lit(""))
    shifted_right = F.concat(
        sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))
    )
    four_zeros = F.concat(sign, F.lit("0.000"), digits)
    scientific = F.concat(
        sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    magnitude = F.abs(c)
    return (
        F.when(magnitude >= 1e7, shifted_right)
        .when(magnitude >= 1e-4, four_zeros)
        .otherwise(scientific)
    )


def _special(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def cell_to_str(c: Column, dtype: T.DataType) -> Column:
    """Integral floats lose their fraction; other values print as they would in a cell."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A float column goes through its own text, so 0.1f does not become 0.10000000149.
        wide = c.cast("string").cast("double") if isinstance(dtype, T.FloatType) else c
        small_whole = wide.try_cast("bigint")

        def rare(v: Column) -> Column:
            return (
                F.when(_special(v), F.lower(F.replace(v.cast("string"), F.lit("Infinity"), F.lit("inf"))))
                .when((F.abs(v) >= 1e15) & (F.abs(v) < 1e37), v.cast(T.DecimalType(38, 0)).cast("string"))
                .otherwise(_float_text(v))
            )

        magnitude = F.abs(wide)
        # The rare forms go through an array function, which keeps them out of the generated
        # code: with several float cells per row that code would be too long to be compiled.
        return (
            F.when((magnitude < 1e15) & (wide == small_whole), small_whole.cast("string"))
            .when((magnitude >= 1e-3) & (magnitude < 1e7), wide.cast("string"))
            .otherwise(F.transform(F.array(wide), rare)[0])
        )
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.when(micros.endswith(".000000"), seconds).otherwise(micros)
    return c.cast("string")


def join_cells(cells: Sequence[Column], skip_empty: bool = False) -> Column:
    """Join with one space. Nulls never print; ``skip_empty`` also drops empty strings."""
    kept = [F.nullif(c, F.lit("")) for c in cells] if skip_empty else list(cells)
    return F.concat_ws(" ", *kept)
