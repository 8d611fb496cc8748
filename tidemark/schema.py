"""The version log: one row for each immutable version of an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lamport", T.LongType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("wall_clock", T.TimestampType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)
COLUMNS = LOG_SCHEMA.fieldNames()


def normalised(rows: DataFrame) -> DataFrame:
    """Rows in the log's columns: empty vectors and maps become null, a null text an empty one."""
    return rows.withColumns(
        {
            "embedding": F.when(F.size("embedding") > 0, F.col("embedding")),
            "metadata": F.when(F.size("metadata") > 0, F.col("metadata")),
            "text": F.coalesce("text", F.lit("")),
            "tombstone": F.coalesce("tombstone", F.lit(False)),
        }
    ).select(*[F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA])


def checked(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows of which a blank id, a wrong dimension or a vector that isn't finite raises when they are read."""
    wrong = [(F.trim(F.coalesce("id", F.lit(""))) == "", "blank id")]
    vector = ~F.col("tombstone") & F.col("embedding").isNotNull()
    if dim is not None:
        wrong.append((vector & (F.size("embedding") != dim), f"embedding isn't of dimension {dim}"))
    wrong.append((vector & F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "embedding isn't finite"))
    raised = F.lit(None).cast("string")
    for condition, message in reversed(wrong):
        raised = F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(raised)
    return rows.withColumn("id", F.coalesce(raised, "id"))
