"""Weather files landing as a stream, merged into the keep-latest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glebe.operators.latest import WEATHER_KEYS
from glebe.schemas import GRID_MEASURES
from glebe.sources.records import weather_payload_schema, weather_rows
from glebe.sources.tables import last_days, upsert_table

POINT = ["latitude", "longitude"]


def accept_recent(new: DataFrame, existing: DataFrame | None, lookback_days: int) -> DataFrame:
    """New rows not older than the lookback before their point's last known day; unknown points keep all.

    ``existing`` needs the points and their days, or just their last days.
    """
    if existing is None:
        return new
    last = existing.groupBy(*POINT).agg(F.max("date").alias("_last"))
    joined = new.join(last, POINT, "left")
    return joined.filter(F.col("_last").isNull() | (F.col("date") >= F.date_sub("_last", lookback_days))).drop("_last")


def merge_batch(spark: SparkSession, rows: DataFrame, table: str, lookback_days: int = 30) -> None:
    """Merge one batch of weather rows; running it again leaves the same table."""
    dated = rows.filter(F.col("date").isNotNull())
    recent = accept_recent(dated, last_days(spark, table, POINT), lookback_days)
    upsert_table(spark, table, recent, WEATHER_KEYS)


def stream_weather(spark: SparkSession, landing: str, table: str, checkpoint: str, lookback_days: int = 30,
                   measures: tuple[str, ...] = GRID_MEASURES, max_files: int | None = None) -> StreamingQuery:
    """Merge all payload files that have landed since the last run, batch by batch, then stop.

    ``checkpoint`` must be on storage all executors reach; it holds which files are done.
    """
    source = spark.readStream.schema(weather_payload_schema(measures))
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    rows = weather_rows(source.json(landing), measures)
    return (
        rows.writeStream.foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, table, lookback_days))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
