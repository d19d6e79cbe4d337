"""Thinned ingestion with keyed state: Spark's state store holds one point of each voxel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairnfield.functions.geometry import axes, dist_sq, voxel_centre, voxel_key
from cairnfield.operators.downsample import KEYS
from cairnfield.operators.mutate import arriving

#: The store that keyed state needs; its checkpoints hold what a batch changed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ORDER = [*((k, "ascending") for k in KEYS), ("d", "ascending"), ("seq", "descending"), ("point_id", "ascending")]


def _winners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch one row a voxel, so that a crowded voxel's rows aren't all shuffled."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by(ORDER)
        keys = np.stack([rows.column(k).to_numpy() for k in KEYS]) if len(rows) else np.zeros((len(KEYS), 0), np.int64)
        first = np.ones(len(rows), bool)
        first[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        yield from rows.filter(pa.array(first)).combine_chunks().to_batches()


def _rank(point: Row) -> tuple:
    """Nearest to the centre first, then the latest, then the smallest identifier."""
    d, seq, name = point["d"], point["seq"], point["point_id"]
    return (math.isnan(d), 0.0 if math.isnan(d) else d, seq is None, -(seq or 0), name is None, name or 0)


class Holders(StatefulProcessor):
    """Holds the best point of a voxel; emits it, numbered, whenever it changes."""

    def __init__(self, names: list[str], schema: T.StructType):
        self.names, self.schema = names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.held.get()
        change, old = (old[0], Row(*self.names)(*old[1:])) if old is not None else (0, None)
        best = min(rows, key=_rank)
        if old is None or _rank(best) < _rank(old):
            point = tuple(best[c] for c in self.names)
            self.held.update((change + 1, *point))
            yield Row("change", *self.names)(change + 1, *point)

    def close(self) -> None:
        pass


def ingest(arrivals: DataFrame, folder: str, voxel: float) -> list[int]:
    """Fold the stream ``arrivals`` (point columns, with or without ``seq``) into changes
    below ``folder``: a row whenever a voxel gets its first or a better point.

    A voxel's point is the nearest to its centre; among equals the one with the largest
    ``seq``, then the smallest identifier. That doesn't depend on how rows fall into
    micro-batches. A micro-batch reads and writes the state of its own voxels only; tasks
    reduce their rows to one a voxel and Arrow batch before they are shuffled, so a crowded voxel
    costs one task a row of each batch. Takes what is available and ends; a later call goes on
    from the checkpoint in the same folder. A batch that runs again after a failure leaves
    one copy of its changes. The number of state partitions is that of the first call. Returns
    the number of voxels that each of the call's last batches wrote.

    Defined cases: rows with null or NaN coordinates aren't points; a repeated row changes
    nothing; without arrivals there are no changes; a null ``seq`` or identifier loses
    among equals.
    """
    spark = arrivals.sparkSession
    # state rows are never null, so that names and types are all that schemas tell
    points = arriving(arrivals).drop("status").withColumns(dict(zip(KEYS, voxel_key(voxel), strict=True))).withColumn("d", dist_sq(axes(), voxel_centre(voxel)))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in points.schema])
    changes = T.StructType([T.StructField("change", T.LongType()), *schema])
    reduced = points.mapInArrow(_winners, schema)
    out = reduced.groupBy(*KEYS).transformWithState(Holders(schema.names, changes), changes, "Append", "None")
    with_store = _configured(spark, STORE)
    try:
        query = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        with_store()
    query.awaitTermination()
    return [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"][:1]]


def _configured(spark: SparkSession, settings: dict[str, str]) -> Callable[[], None]:
    """Sets ``settings``; call what it returns to have the session as it was."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)

    def back() -> None:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)

    return back


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    changes = spark.read.parquet(f"{folder}/changes")
    last = changes.groupBy(*(F.col(k).alias(f"l_{k}") for k in KEYS)).agg(F.max("change").alias("last"))
    here = F.lit(True)
    for k in KEYS:
        here = here & (F.col(k) == F.col(f"l_{k}"))
    return changes.join(last, here)


def _points(rows: DataFrame) -> DataFrame:
    return rows.drop("seq", "change", "last", "d", *KEYS, *(f"l_{k}" for k in KEYS))


def live_points(spark: SparkSession, folder: str) -> DataFrame:
    """The point that each voxel holds after all batches so far."""
    return _points(_latest(spark, folder).where(F.col("change") == F.col("last")))


def thinned_out(spark: SparkSession, folder: str) -> DataFrame:
    """Points that a voxel held and gave up for a better one; arrivals that never held a
    voxel aren't among them."""
    return _points(_latest(spark, folder).where(F.col("change") < F.col("last")))
