"""Flight events as nested documents: parsed with their whole schema, broken ones apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def parsed(texts: DataFrame, schema: T.StructType, text: str = "document") -> DataFrame:
    """Rows with `event` (the document as nested columns) and `error`, null where it is sound.

    The schema is declared, so a document that is cut off, is no object, or has a value of
    another type anywhere is told apart and stops nothing; fields that the schema lacks are
    ignored, missing ones are null.
    """
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = F.from_json(F.col(text), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # Generated, not projected: a filter on `error` would otherwise be pushed below and parse the document for each field.
    rows = texts.select("*", F.explode(F.array(read)).alias("_read"))
    error = F.when(F.col(text).isNull(), "no document").when(F.col("_read").isNull() | F.col(f"_read.{CORRUPT}").isNotNull(), "not readable")
    event = F.when(error.isNull(), F.struct(*[F.col("_read")[f.name].alias(f.name) for f in schema.fields]))
    return rows.withColumns({"error": error, "event": event}).drop("_read")


def accepted(rows: DataFrame) -> DataFrame:
    """The nested columns of the sound documents."""
    return rows.filter("error IS NULL").select("event.*")


def quarantined(rows: DataFrame, text: str = "document") -> DataFrame:
    """The broken documents as they came, with the reason."""
    return rows.filter("error IS NOT NULL").select(text, "error")


def written(events: DataFrame) -> DataFrame:
    """Nested events as documents; every 61st is cut off, every 67th has a text for its number, every 71st is missing."""
    whole = F.to_json(F.struct(*events.columns))
    e = F.col("event_id")
    broken = (
        F.when(e % 61 == 0, F.substring(whole, 1, 40))
        .when(e % 67 == 0, F.concat(F.lit('{"event_id":"none",'), F.regexp_replace(whole, '^[{]"event_id":[0-9]+,', "")))
        .when(e % 71 == 0, F.lit(None).cast("string"))
        .otherwise(whole)
    )
    return events.select("event_id", broken.alias("document"))
