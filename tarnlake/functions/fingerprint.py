"""Order-independent fingerprints of groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with every map in it, at any depth, as its entries sorted by their JSON text."""
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                _ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value")
            ),
        )
        texts = F.transform(entries, lambda e: F.to_json(e, {"ignoreNullFields": "false"}))
        return F.sort_array(texts)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType)) if _holds_map(kind) else value
    if isinstance(kind, T.StructType) and _holds_map(kind):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """64-bit hash of the named columns of a row.

    ``xxhash64`` skips NULLs, so ('a', NULL) and (NULL, 'a') would hash alike; the NULL flags are
    hashed too. Nested values are hashed as JSON text, which spells their NULLs out; maps do not depend on
    the order of their entries.
    """
    parts: list[Column] = [F.lit(0)]
    for name in columns:
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, _NESTED):
            ordered = _ordered(value, df.schema[name].dataType)
            value = F.to_json(F.struct(ordered.alias("value")), {"ignoreNullFields": "false"})
        parts += [value, value.isNull()]
    return F.xxhash64(*parts)


def spread_hash(hashed: Column) -> list[Column]:
    """Three small non-negative parts of a 64-bit hash.

    Summing the hash itself overflows a long within a few rows and a decimal sum is some seven times
    slower. Sums of the parts stay in range for 2^41 rows per group and carry the same 64 bits.
    """
    mask = F.lit((1 << 22) - 1)
    return [
        hashed.bitwiseAND(mask),
        F.shiftrightunsigned(hashed, 22).bitwiseAND(mask),
        F.shiftrightunsigned(hashed, 44),
    ]
