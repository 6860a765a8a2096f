"""Field coercions as Column expressions (no Python runs per row).

The raw reader keeps loosely typed JSON fields as VARIANT, where three absences
differ: a missing key is SQL NULL, an explicit ``null`` is a VOID variant, and a
falsy value (empty text, zero, false, empty list) is a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _as(value: Column, dtype: str) -> Column:
    return F.try_variant_get(value, "$", dtype)


def is_truthy(value: Column) -> Column:
    """True unless missing, null, empty text, zero, false or an empty list or object."""
    kind = _kind(value)
    return F.coalesce(
        F.when(kind == "VOID", False)
        .when(kind == "STRING", _as(value, "string") != "")
        .when(kind == "BOOLEAN", _as(value, "boolean"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"),
              ~F.to_json(value).isin("[]", "{}"))
        .otherwise(_as(value, "double") != 0),
        F.lit(False),
    )


def first_truthy(*values: Column) -> Column:
    """The first truthy variant, NULL when there is none."""
    return F.coalesce(*[F.when(is_truthy(v), v) for v in values])


def to_text(value: Column) -> Column:
    return _as(value, "string")


def to_double(value: Column) -> Column:
    """Number or numeric text as double; anything else, and NaN, is NULL."""
    number = F.when(_kind(value) == "STRING", _as(value, "string").try_cast("double")).otherwise(
        _as(value, "double")
    )
    return drop_nan(number)


def drop_nan(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def to_whole(value: Column, dtype: str) -> Column:
    """Integer text, or a number cut towards zero; text such as ``"3.5"`` is NULL."""
    return F.when(_kind(value) == "STRING", _as(value, "string").try_cast(dtype)).otherwise(
        _as(value, dtype)
    )


def helpful_votes(*fields: Column) -> Column:
    """First field whose key is present, as int; unusable values count as 0."""
    return F.coalesce(to_whole(F.coalesce(*fields), "int"), F.lit(0))


def first_double(*fields: Column) -> Column:
    """First field that can be read as a number."""
    return F.coalesce(*[to_double(f) for f in fields])


def clip_high(value: Column, high: int) -> Column:
    return F.least(value, F.lit(high).cast("int"))


def clip_low(value: Column, low: int = 0) -> Column:
    return F.greatest(value, F.lit(low))


def flat_categories(*fields: Column) -> Column:
    """Category labels of an item as ``array<string>``.

    A scalar becomes one label. In a list, a null element becomes the text
    ``None``; in a list inside the list, nulls are dropped. Repeats keep their
    first position.
    """
    raw = first_truthy(*fields)
    elements = F.transform(
        _as(raw, "array<variant>"),
        lambda e: F.when(
            _kind(e).startswith("ARRAY"),
            F.filter(_as(e, "array<string>"), lambda x: x.isNotNull()),
        ).otherwise(F.array(F.coalesce(_as(e, "string"), F.lit("None")))),
    )
    return F.when(
        _kind(raw).startswith("ARRAY"), F.array_distinct(F.flatten(elements))
    ).when(raw.isNotNull(), F.array(to_text(raw)))


def normalise_time(value: Column, unit: str = "s") -> Column:
    """Epoch ticks of the given unit as whole seconds."""
    ticks = TICKS_PER_SECOND[unit]
    return value if ticks == 1 else F.floor(value / F.lit(ticks)).cast("long")


TICKS_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000}
