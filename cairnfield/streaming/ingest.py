"""Incremental ingestion: micro-batches of arrivals are folded into a stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnfield.operators import downsample, mutate
from cairnfield.storage import removed


def _state_path(folder: str, batch: int) -> str:
    return f"{folder}/state-{batch:012d}"


def ingest(arrivals: DataFrame, folder: str, voxel: float | None = None, empty: DataFrame | None = None) -> int:
    """Fold the stream ``arrivals`` (point columns and ``seq``) into states below ``folder``.

    Batch n reads the state that batch n - 1 wrote and overwrites its own, so a batch that
    runs again after a failure gives the same state; the last two are kept. With a ``voxel``
    edge arrivals are thinned.
    Takes what is available and ends; a later call goes on from the stream's checkpoint in
    the same folder. Returns the number of the last batch, -1 if there was none.
    """
    last = [-1]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(_state_path(folder, number - 1)) if number else mutate.build(batch.drop("seq").limit(0))
        after = downsample.add_points(before, batch, voxel) if voxel else mutate.add_points(before, batch)[0]
        after.write.mode("overwrite").parquet(_state_path(folder, number))
        removed(spark, _state_path(folder, number - 2))
        last[0] = number

    query = arrivals.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0]


def state_after(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.parquet(_state_path(folder, batch))
