"""JSON text columns: compact writing, and reading that never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MALFORMED = "__malformed"


def dump(value: Column) -> Column:
    return F.to_json(value)


def load(text: Column, schema: T.StructType, default: Column | None = None) -> Column:
    """The struct that JSON text holds; what can't be read is the default, or null."""
    got = F.from_json(text, T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})
    out = F.when(text.isNotNull() & got[MALFORMED].isNull(), F.struct(*[got[n].alias(n) for n in schema.names]))
    return out if default is None else F.coalesce(out, default)
