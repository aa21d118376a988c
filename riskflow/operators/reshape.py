"""Wide records to events and back, nested records to flat columns and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import catalog

MEASURES = ("pay_status", "bill_amt", "pay_amt")


def unfold(
    df: DataFrame,
    key: str,
    periods: Sequence[tuple] = tuple(catalog.PERIODS),
    time: str = "statement_month",
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """One row per key and period. All measures move in one pass, without a shuffle."""
    rows = [
        F.struct(
            F.lit(period).alias(time),
            *[F.col(c).alias(m) for m, c in zip(measures, columns, strict=True)],
        )
        for period, *columns in periods
    ]
    return df.select(key, F.inline(F.array(*rows)))


def entities(
    df: DataFrame, key: str, static: Sequence[str] = tuple(catalog.STATIC), target: str | None = None
) -> DataFrame:
    """The attributes without a time axis that the frame has, and the target if it has one."""
    wanted = [*static, *([target] if target else [])]
    return df.select(key, *[c for c in wanted if c in df.columns])


def refold(
    events: DataFrame,
    entity_rows: DataFrame,
    key: str,
    periods: Sequence[tuple] = tuple(catalog.PERIODS),
    time: str = "statement_month",
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Events back to wide records; the periods are known, so no pass to find them."""
    cells = [
        F.max(F.when(F.col(time) == F.lit(period), F.col(m))).alias(column)
        for period, *columns in periods
        for m, column in zip(measures, columns, strict=True)
    ]
    wide = events.groupBy(key).agg(*cells)
    return entity_rows.join(wide, key, "left")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested fields become columns named by their path."""
    return df.select(*_flat(df.schema, "", separator))


def _flat(schema: T.StructType, path: str, separator: str) -> list[Column]:
    columns: list[Column] = []
    for field in schema.fields:
        at = f"{path}.`{field.name}`" if path else f"`{field.name}`"
        if isinstance(field.dataType, T.StructType):
            columns += _flat(field.dataType, at, separator)
        else:
            name = at.replace("`.`", separator).strip("`")
            columns.append(F.col(at).alias(name))
    return columns


def strip_prefix(df: DataFrame, prefix: str = "features.") -> DataFrame:
    """Drop a path prefix from flattened column names."""
    return df.withColumnsRenamed(
        {c: c.split(prefix, 1)[1] for c in df.columns if c.startswith(prefix)}
    )


def parse_documents(df: DataFrame, document: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents to columns, next to the columns that were there."""
    rest = [c for c in df.columns if c != document]
    return df.withColumn("_doc", F.from_json(document, schema)).select(*rest, "_doc.*")


#: Types of values that a column keeps; numbers of several kinds meet as double, the rest as text.
_KEPT = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string", "VOID": "string"}


def document_keys(df: DataFrame, document: str) -> DataFrame:
    """Keys of JSON objects of unknown shape: (key, type, n), one row per key and type met."""
    objects = df.select(_object(document).alias("_map")).where("_map is not null")
    pairs = objects.select(F.explode("_map").alias("key", "_value"))
    kind = F.regexp_replace(F.schema_of_variant("_value"), r"[(<].*$", "")
    return pairs.groupBy("key", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def discover_documents(df: DataFrame, document: str) -> DataFrame:
    """JSON documents of unknown shape to columns, next to the columns that were there.

    The keys and their types come from one aggregate over the rows; only those pairs reach
    the driver. A key missing from a document is null. A key with whole numbers in one
    document and fractions in another is a double; with values of unlike kinds it is
    text, nested values as JSON. A key named like a column, whatever the case, gets the
    document's name in front. Documents whose keys are data, such as ids, belong in
    ``document_keys`` alone: they would make a column each. Null and broken documents, arrays and bare values have no keys.
    """
    rest = [c for c in df.columns if c != document]
    types: dict[str, set[str]] = {}
    for row in document_keys(df, document).collect():
        types.setdefault(row["key"], set()).add(row["type"])
    names, taken = {}, {c.lower() for c in rest}
    for key in sorted(types):
        name = key
        while name.lower() in taken:
            name = f"{document}.{name}"
        names[key] = name
        taken.add(name.lower())
    found = df.withColumn("_map", _object(document))
    return found.select(
        *rest,
        *[
            F.try_variant_get(F.element_at("_map", F.lit(key)), "$", _common(types[key])).alias(name)
            for key, name in names.items()
        ],
    )


def _object(document: str) -> Column:
    return F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")


def _common(kinds: set[str]) -> str:
    known = kinds - {"VOID"} or {"VOID"}
    if len(known) == 1:
        return _KEPT.get(next(iter(known)), "double" if known == {"DECIMAL"} else "string")
    return "double" if known <= {"BIGINT", "DECIMAL", "DOUBLE"} else "string"


def to_document(columns: Sequence[str]) -> Column:
    """The named columns as one JSON text; nulls are left out."""
    return F.to_json(F.struct(*columns))
