"""Keeping a store in step with a tree of files by Structured Streaming.

The file source reports new files only, so each micro-batch is a signal, and the
change itself is the difference between the tree and the store (``delta``).  A
batch without a difference publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.epochs import EpochStore, replace_files
from ..plans.lineage import cut
from ..sources.project import delta

#: Fixed value: seconds within which changes count as one.
DEBOUNCE = "250 milliseconds"


def sync(store: EpochStore, seen: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], keys: dict[str, str], force: bool = False, arrange: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> int:
    """Publishes the next version if files (path, content_hash, ...) differ from the store's ``files`` table.

    ``build(files)`` makes the tables of the changed files; ``keys`` names each table's file column.  Rows of
    unchanged files are taken over.  ``arrange`` puts tables in the order in which they are stored.  Returns the
    current version's number.
    """
    stored = lambda tables: {name: (arrange or {}).get(name, lambda t: t)(rows) for name, rows in tables.items()}

    def work(epoch: int) -> int:
        meta = store.meta()
        if "files" not in meta["tables"]:
            tables = build(seen) | {"files": seen.select("path", "content_hash")}
            return store.publish(stored(tables), epoch)
        changes = cut(delta(seen, store.read("files", meta), force))
        if changes.isEmpty():
            return epoch
        fresh = seen.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
        made = build(fresh)
        tables = {name: replace_files(store.read(name, meta), changes, rows, keys[name]) for name, rows in made.items()}
        return store.publish(stored(tables) | {"files": seen.select("path", "content_hash")}, epoch)

    return store.with_retry(work)


def watch(spark: SparkSession, folder: str, on_change: Callable[[], int], checkpoint: str, once: bool = False):
    """A streaming query that calls ``on_change`` for every micro-batch in which files arrived; ``once`` ends when all there is was seen."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.select("path").isEmpty():
            on_change()

    writer = stream.select("path", "modificationTime").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a stream of events (ts, event_type); rows later than ``late`` are left out by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
