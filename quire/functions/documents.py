"""JSON texts that may be cut off or damaged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_kind(raw: Column) -> Column:
    """object, list or other for a text that is one JSON value from end to end; null for any other text.

    The value is parsed as the only member of a list and of an object: a parser that stops after the first value
    would overlook what follows it."""
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    kind = F.schema_of_variant(F.variant_get(named, "$.v", "variant"))
    whole = listed.isNotNull() & named.isNotNull() & (F.trim(raw) != "")
    return F.when(whole, F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").otherwise("other"))
