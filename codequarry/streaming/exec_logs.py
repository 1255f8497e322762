"""Execution logs as a stream: rounds arrive in any order, the latest per unit is kept.

An extension for continuous evaluation; batch operators give the same answer over the
stored rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "unit_id string, round_no long, ts timestamp, passing boolean, coverage double, error string"


def read_logs(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Log files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(path)


def pass_rates(logs: DataFrame, window: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Per window: rounds, passing ones and mean coverage; rounds later than `late` are dropped,
    which bounds the state. None: logs have a watermark already."""
    marked = logs if late is None else logs.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_rounds"), F.count_if("passing").alias("n_passing"), F.avg("coverage").alias("coverage")).select("window.start", "n_rounds", "n_passing", "coverage")


def first_reports(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (unit, round) once, however often it is delivered within `late`."""
    return logs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["unit_id", "round_no"])


def latest_per_unit(logs: DataFrame) -> DataFrame:
    """The last round of each unit in one batch: ties of round_no by ts."""
    return logs.groupBy("unit_id").agg(F.max_by(F.struct("round_no", "ts", "passing", "coverage", "error"), F.struct("round_no", "ts")).alias("r")).select("unit_id", "r.*")


def keep_latest(logs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes the latest round of each unit to table/<version> after every batch.

    A batch that is delivered again writes the same version again, so the sink is
    idempotent; the version before it is its only input.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_per_unit(batch)
        if number:
            new = latest_per_unit(spark.read.parquet(f"{table}/version={number - 1}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{table}/version={number}")

    return logs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
