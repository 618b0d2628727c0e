"""Statement logs as they arrive: a file stream whose latest state by table is kept by upserts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from granary.operators.statements import drop_noise


def arriving(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Statements from Parquet files that appear in a folder; a new file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """The last statement of each table so far, without noise; works for a stream in update or complete mode and for a table."""
    rest = [c for c in log.columns if c != "table_name"]
    return drop_noise(log).groupBy("table_name").agg(F.max_by(F.struct(*rest), "pos").alias("last")).select("table_name", "last.*")


def keep_latest(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's latest statement a table to path; `current` reads the state. A batch that runs again writes the same folder."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"))


def changes_per_window(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Statements of each type in windows of the time `ts`; rows later than the watermark are left out of closed windows."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))


class LatestStatement(StatefulProcessor):
    """Keeps the last statement of a table by position as a value that expires; each batch puts out the tables whose last statement changed."""

    def __init__(self, schema: StructType, ttl_ms: int | None) -> None:
        self.schema, self.ttl_ms = schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        names = self.schema.fieldNames()
        best, held = max(rows, key=lambda r: r["pos"]), self.last.get()
        if held is None or held[names.index("pos")] < best["pos"]:
            self.last.update(tuple(best[n] for n in names))
            yield Row(**{n: best[n] for n in names})

    def close(self) -> None:
        pass


def latest_by_state(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The changes of the last statement of each table, from a stream of statements without noise: one row for a table whenever a batch brings a later statement.

    The state is one row for each table, whatever the number of batches, in RocksDB (spark.sql.streaming.stateStore.providerClass must name it); late and repeated statements change nothing. With
    `ttl_ms` a table's state goes when it was not changed for so long. For a stream in update mode; positions must not be null.
    """
    schema = log.schema
    timed = "None" if ttl_ms is None else "ProcessingTime"
    return drop_noise(log).groupBy("table_name").transformWithState(LatestStatement(schema, ttl_ms), schema, "Update", timed)
