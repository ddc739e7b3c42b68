"""What queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions.expressions import safe_double


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """A double brought to six places, so that engines that add in another order agree."""
    named = name or (c if isinstance(c, str) else None)
    out = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)
    return out.alias(named) if named else out


def props_value() -> Column:
    """The number in the properties of an event."""
    return safe_double(F.get_json_object("props", "$.k"))
