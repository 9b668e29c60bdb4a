"""Logical schemas of the engine's tables and the mapping from an installation's physical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def table(columns: str) -> T.StructType:
    """Schema from `name type, …`; unlike the DDL parser it needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CONSUMPTION = table(
    "line_id string, ts timestamp_ntz, day date, case_id bigint, case_no string, hospital string, doctor string, "
    "technician string, sublocation string, warehouse string, product_id bigint, product string, lot string, "
    "expiry timestamp_ntz, qty double, unit string, amount double, amount_estimated boolean, weight_start double, "
    "weight_end double, measured_ml double, weighable boolean, duration_min double, source string"
)

STOCK = table(
    "product_id bigint, product string, location string, warehouse string, lot string, expiry timestamp_ntz, "
    "qty double, reserved double, available double, expired boolean, usable double"
)

PENDING_SUPPLY = table(
    "kind string, ref string, supplier string, product_id bigint, qty double, qty_doc double, unit_doc string, "
    "to_location string, from_location string, due_at timestamp_ntz, confirmed boolean, late boolean"
)


def map_columns(df: DataFrame, mapping: dict[str, str], schema: T.StructType) -> DataFrame:
    """Physical to logical names in one projection; a column the installation lacks becomes a typed NULL."""

    def one(field: T.StructField) -> Column:
        physical = mapping.get(field.name)
        source = F.col(physical) if physical and physical in df.columns else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def split_reference(df: DataFrame, *columns: str) -> DataFrame:
    """An (id, name) reference struct becomes `<name>_id` and `<name>`; a missing reference gives NULL and ''."""
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        out += [F.col(c)["id"].cast("bigint").alias(f"{c}_id"), F.coalesce(F.col(c)["name"], F.lit("")).alias(c)]
    return df.select(*out)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every double column."""
    from stockwarden.functions.maths import finite

    return df.select(*[finite(F.col(f.name)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
                       for f in df.schema.fields])
