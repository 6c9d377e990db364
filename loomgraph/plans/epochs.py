"""Atomic versions of a set of tables: Parquet folders and one pointer file.

``epoch=N`` folders are immutable; a pointer names the current one.  The pointer is
replaced by a rename on the file system that Spark writes to (through Hadoop's
file system API), so readers see the old version or the new one, whole.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: version of the table layout; a higher one on disk is refused.
SCHEMA_VERSION = 2
RETRIES, BACKOFF_S = 3, 0.005


class EpochError(RuntimeError):
    """The store is newer than this code, damaged, or was published meanwhile."""


class EpochStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _replace(self, name: str, text: str) -> None:
        temporary = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(temporary, self._path(f"{self.root}/{name}"), options)

    def meta(self) -> dict:
        text = self._read("current.json")
        if text is None:
            return {"epoch": 0, "tables": {}, "schema_version": SCHEMA_VERSION}
        try:
            meta = json.loads(text)
        except ValueError as e:
            raise EpochError("the pointer is damaged") from e
        if meta["schema_version"] > SCHEMA_VERSION:
            raise EpochError(f"store has schema version {meta['schema_version']}, this code knows {SCHEMA_VERSION}")
        return meta

    @property
    def epoch(self) -> int:
        return self.meta()["epoch"]

    def publish(self, tables: dict[str, DataFrame], based_on: int, **more) -> int:
        """Writes all tables and then moves the pointer; fails if another version was published since ``based_on``.

        A version's number is claimed by a file that can be made only once, so of two writers one wins.  Tables are
        written before the claim: a writer that dies early leaves no claim behind.  One that dies between claim and
        pointer leaves a claim that nothing stands for; ``repair`` gives it up.
        """
        number = based_on + 1
        folder = f"{self.root}/epoch={number}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        meta = self.meta()
        if meta["epoch"] != based_on or not self._claim(number):
            self._fs.delete(self._path(folder), True)
            raise EpochError(f"a version after {based_on} was published meanwhile")
        where = meta["tables"] | {name: f"{folder}/{name}" for name in tables}
        self._replace("current.json", json.dumps({"epoch": number, "tables": where, "schema_version": SCHEMA_VERSION} | more))
        return number

    def _claim(self, number: int) -> bool:
        path = self._path(f"{self.root}/.claim-{number}")
        self._fs.mkdirs(path.getParent())
        if self._fs.getUri().getScheme() == "file":  # whose ``create`` looks and then writes
            return self.spark._jvm.java.io.File(self._path(self.root).toUri().getPath(), f".claim-{number}").createNewFile()
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def repair(self) -> None:
        """Gives up a claim on the next version; only when no writer is at work."""
        self._fs.delete(self._path(f"{self.root}/.claim-{self.epoch + 1}"), False)

    def read(self, table: str, meta: dict | None = None) -> DataFrame:
        """A table of one version; pass ``meta`` to stay with that version over several reads."""
        return self.spark.read.parquet((meta or self.meta())["tables"][table])

    def with_retry(self, work) -> int:
        """Runs ``work(epoch)`` again if another version was published meanwhile, with a growing pause."""
        for attempt in range(RETRIES):
            try:
                return work(self.epoch)
            except EpochError:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(BACKOFF_S * 2**attempt)
        raise AssertionError

    def quarantine(self) -> str | None:
        """Sets a damaged pointer aside, so that the next publication starts anew."""
        path = self._path(f"{self.root}/current.json")
        if not self._fs.exists(path):
            return None
        aside = f"{self.root}/damaged-{int(time.time() * 1000)}.json"
        self._fs.rename(path, self._path(aside))
        for status in self._fs.globStatus(self._path(f"{self.root}/.claim-*")) or []:
            self._fs.delete(status.getPath(), False)
        return aside

    def backup(self, target: str) -> None:
        """A consistent copy of the current version."""
        meta = self.meta()
        other = EpochStore(self.spark, target)
        if other.epoch:
            raise EpochError("the target already has a version")
        other.publish({name: self.spark.read.parquet(path) for name, path in meta["tables"].items()}, 0, source_epoch=meta["epoch"], rows={name: self.spark.read.parquet(path).count() for name, path in meta["tables"].items()})

    def validate(self) -> dict[str, int]:
        """Rows per table of the current version; an error if one can't be read or, in a backup, has other rows than were written."""
        meta, out = self.meta(), {}
        for name, path in meta["tables"].items():
            if not self._fs.exists(self._path(path)):
                raise EpochError(f"table {name} is missing")
            out[name] = self.read(name, meta).count()
        if meta.get("rows", out) != out:
            raise EpochError("the tables are not those that were written")
        return out

    def restore(self, source: str, force: bool = False) -> int:
        """Publishes a backup's version here, after it was validated; over versions of our own only if forced."""
        other = EpochStore(self.spark, source)
        if not other.epoch:
            raise EpochError("the backup has no version")
        if self.epoch and not force:
            raise EpochError("the store already has a version")
        other.validate()
        meta = other.meta()
        return self.publish({name: other.read(name, meta) for name in meta["tables"]}, self.epoch, restored_from=meta["epoch"])


def replace_files(table: DataFrame, changed: DataFrame, new: DataFrame, file_col: str = "file") -> DataFrame:
    """A table's next version: rows of the files in ``changed`` (path) go, ``new`` ones come."""
    gone = changed.select(F.col("path").alias(file_col))
    return table.join(gone, file_col, "left_anti").select(*table.columns).unionByName(new)


def drop_edges_of(relationships: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges without those whose evidence, source or target is of a deleted file."""
    gone = deleted.select("path")
    ids = symbols.join(gone.withColumnRenamed("path", "file"), "file", "left_semi").select("id")
    left = relationships.join(gone.withColumnRenamed("path", "evidence_file"), "evidence_file", "left_anti")
    for end in ("source_id", "target_id"):
        left = left.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return left.select(*relationships.columns)


def snapshot(files: DataFrame, symbols: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """The graph in a fixed order: files by path, symbols by id, edges by their key."""
    key = ["source_id", "target_id", "kind", "provenance", "evidence_file", "evidence_line", "evidence_site"]
    return {"files": files.orderBy("path"), "symbols": symbols.orderBy("id"), "relationships": relationships.orderBy(*key)}


def fingerprint(rows: DataFrame, file_col: str = "file", spans: tuple[str, ...] = ("start_byte", "end_byte", "start_line", "end_line", "evidence_line")) -> DataFrame:
    """(file, semantic_fingerprint): a hash of a file's facts that ignores their order and spans."""
    columns = [c for c in rows.columns if c not in spans]
    per = F.sha2(F.to_json(F.struct(*columns)), 256)
    return rows.groupBy(file_col).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(per)), ""), 256).alias("semantic_fingerprint"))
