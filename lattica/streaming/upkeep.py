"""Continuous upkeep of graphs with Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import EDGE_SCHEMA, NODE_SCHEMA
from ..operators.merge import _one
from ..sources.commits import Commits

#: Slots of a kept table; a batch rewrites those of its ids. Versions that readers may still hold.
SLOTS, KEEP = 256, 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_graph_upsert(rows: DataFrame, target: str, checkpoint: str, *, schema: str = NODE_SCHEMA, keys: tuple[str, ...] = ("id",), slots: int = SLOTS, keep: int = KEEP) -> StreamingQuery:
    """Keeps at target a table of nodes, or of edges by src, dst and type: each batch's rows replace those of their keys. Read it with latest().

    The table is dealt to slots by its keys. A batch writes the slots that it touches to a folder of
    its own, then commits a manifest of all slots to the target's log. The manifest also names the
    last batch of each query, by the query's id, so a batch that is run again changes nothing, and
    any number of queries can keep one table: one that loses the race for a version begins anew from
    the winner's. Slots are a table's own; all its queries must use the same number. The newest
    ``keep`` versions stay.
    """
    log = Commits(rows.sparkSession, target)
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            _put(log, batch.withColumn("slot", slot), _query_id(batch.sparkSession, checkpoint), epoch, schema, keys, slots)
        finally:
            batch.unpersist()
        log.expire(keep, lambda m: m["slots"].values())

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """A query's id, which its checkpoint keeps over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"]


def _put(log: Commits, new: DataFrame, query: str, epoch: int, schema: str, keys: tuple[str, ...], slots: int) -> None:
    spark = new.sparkSession
    touched = None
    while True:
        version, manifest = log.head()
        done, held = manifest.get("epochs", {}), manifest.get("slots", {})
        if done.get(query, -1) >= epoch:
            return
        if manifest.get("n", slots) != slots:
            raise ValueError(f"{log.root} has {manifest['n']} slots")
        if touched is None:
            touched = [r["slot"] for r in new.select("slot").distinct().collect()]  # slots rows at most
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            old = _read(spark, log.root, [held[str(s)] for s in touched if str(s) in held], schema)
            both = old.withColumn("layer", F.lit(0)).unionByName(new.select(*old.columns).withColumn("layer", F.lit(1)))
            kept = _one(both, list(keys), ["layer", "seq"], True).drop("layer")
            kept.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")).repartition("slot").write.partitionBy("slot").parquet(f"{log.root}/{folder}")
        if log.commit(version + 1, {"n": slots, "epochs": done | {query: epoch}, "slots": held | {str(s): f"{folder}/slot={s}" for s in touched}}):
            return
        log.delete(folder)


def _read(spark: SparkSession, root: str, parts: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def latest(spark: SparkSession, target: str, schema: str = NODE_SCHEMA, version: int | None = None) -> DataFrame:
    """The newest version of the table at target, or one that is still kept; an empty table before the first."""
    log = Commits(spark, target)
    manifest = log.head()[1] if version is None else log.read(version)
    return _read(spark, target, list(manifest.get("slots", {}).values()), schema)


def stream_edges_first(edges: DataFrame, *, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream of edges, each (src, dst, type) once: the first that arrives.

    With a time column an edge's key is kept until the watermark has passed its time by late, so the
    state does not grow without end; a key that comes again after that counts as new.
    """
    keys = ["src", "dst", "type"]
    return edges.dropDuplicates(keys) if time is None else edges.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class _Files(StatefulProcessor):
    """What is known of a path: its hash. A timer runs out if listings go on without it."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "sha256 string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row = max(rows, key=lambda r: (r.seen, r.sha256 or ""))
        old = self.known.get()
        self.known.update((row.sha256,))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(int(row.seen.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.patience)
        if old is None or old[0] != row.sha256:
            yield Row(path=key[0], sha256=row.sha256, change="new" if old is None else "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.known.get()
        self.known.clear()
        yield Row(path=key[0], sha256=old[0] if old else None, change="deleted")

    def close(self) -> None:
        pass


def stream_incremental_scan(files: DataFrame, *, patience_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """path, sha256, change of a stream of listings (path, sha256, seen): files that are new, changed or, given a patience, deleted.

    A path's hash is kept as keyed state in RocksDB, so a file that comes again as it was gives no
    row, over restarts too. Of a path's rows in a batch the last one by time counts. With a patience
    in milliseconds a path counts as deleted once listings are later than its last one by more than
    that (event time, with watermark late); it is new if it comes again. Null paths are passed over.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only one with keyed state of this kind
    rows = files.where("path is not null").select("path", "sha256", "seen")
    if patience_ms is not None:
        rows = rows.withWatermark("seen", late)
    return rows.groupBy("path").transformWithState(_Files(patience_ms), "path string, sha256 string, change string", "Append", "None" if patience_ms is None else "EventTime")


def stream_type_counts(rows: DataFrame, kind: str = "type", *, time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running counts by type. With a time column: counts by windows of event time, start, <kind>, n, once the watermark has closed them; later rows are dropped."""
    if time is None:
        return rows.groupBy(kind).agg(F.count("*").alias("n"))
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def to_table(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream gives to a Parquet folder, until its source has no more."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_to_table(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps running counts, those of each batch in a folder of its own; newest_counts() reads the last one."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return counts.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_counts(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(last), "epoch", "left_semi")  # one row


__all__ = ["EDGE_SCHEMA", "counts_to_table", "latest", "newest_counts", "stream_edges_first", "stream_graph_upsert", "stream_incremental_scan", "stream_type_counts", "to_table"]
