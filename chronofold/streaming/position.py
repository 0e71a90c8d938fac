"""Reading positions as streams: state per book, folded as reports arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.operators.folds import POSITION, Position, report_of

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def reports(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """A stream over event files. The files' time stamps have no zone; event time is UTC."""
    raw = spark.readStream.format("parquet").schema(SCHEMA).option("pathGlobFilter", files).option("maxFilesPerTrigger", 1).load(folder)
    return raw.select(F.col("user_id").alias("book_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def high_water(stream: DataFrame) -> DataFrame:
    """``book_id, epoch, bookmark``: the running maximum; a ``purchase`` resets it and opens an epoch. Reports
    of one batch are taken in the order of time and identifier."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, high = state.get if state.exists else (0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, k in zip(pdf["event_type"], pdf["k"]):
            # A report without a position tells nothing new.
            epoch, high = (epoch + 1, 0) if kind == "purchase" else (epoch, high if pd.isna(k) else max(high, int(k)))
        state.update((epoch, high))
        yield pd.DataFrame({"book_id": [key[0]], "epoch": [epoch], "bookmark": [high]})

    return stream.groupBy("book_id").applyInPandasWithState(fold, "book_id long, epoch long, bookmark long", "epoch long, bookmark long", "update", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Merge(StatefulProcessor):
    """A book's position as one composite value."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", POSITION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        now = Position(*self.position.get()) if self.position.exists() else Position()
        outcomes = [now.take(**report_of(row)) for row in pdf.to_dict("records")]
        self.position.update(now.values())
        yield pd.DataFrame({"book_id": key[0], "event_id": pdf["event_id"].to_numpy(), "outcome": outcomes})

    def close(self) -> None:
        pass


def device_merge(reports: DataFrame, order: list[str]) -> DataFrame:
    """``book_id, event_id, outcome``: the streaming twin of ``folds.merged_positions``; ``order`` sorts the reports of one batch."""
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = "book_id long, event_id long, outcome string"
    return reports.groupBy("book_id").transformWithStateInPandas(_Merge(order), out, "append", "none")


def request_windows(stream: DataFrame, seconds: int, limit: int) -> DataFrame:
    """``event_id, allowed``: fixed windows that start at a key's first request, not at the clock's."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-1, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for at in pdf["ts"].astype("datetime64[us]").astype("int64") // 1_000_000:
            if start < 0 or at - start >= seconds:
                start, used = int(at), 0
            used += 1
            allowed.append(used <= limit)
        state.update((start, used))
        yield pd.DataFrame({"event_id": pdf["event_id"], "allowed": allowed})

    return stream.groupBy("book_id").applyInPandasWithState(admit, "event_id long, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """An extension beyond positions: event-time windows with a watermark (tumbling, or sliding by ``slide``)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there into files below ``folder``, a part a batch (column ``batch``), and
    reads them. A batch that runs again overwrites its own part; of a complete output the last part counts."""
    out = f"{folder}/out"

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(out)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]) if mode == "complete" else rows


def ingest(stream: DataFrame, facts: str, receipts: str, checkpoint: str):
    """Chapters to files, one folder a batch, with receipts last. A batch that runs again finds its receipt and writes
    nothing; one that broke off before its receipt overwrites its own folder. Read through ``ingested``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema("batch_id long").parquet(receipts) if _exists(spark, receipts) else None
        if done is not None and done.where(F.col("batch_id") == batch_id).limit(1).count():
            return
        batch.write.mode("overwrite").parquet(f"{facts}/batch_id={batch_id}")
        spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("append").parquet(receipts)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, facts: str, receipts: str) -> DataFrame:
    """The facts of the batches that have a receipt."""
    done = spark.read.schema("batch_id long").parquet(receipts)
    rows = spark.read.option("basePath", facts).parquet(facts)
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(done.distinct(), "batch_id", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
