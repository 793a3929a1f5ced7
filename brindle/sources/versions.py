"""Tables that are stored as versions, and the stored job table.

A commit writes the rows that change as Parquet and then publishes the next version by renaming a manifest into its place;
the rename fails where that version exists, so of two writers who read the same version one commits and the other sees a
``Conflict``, reads again and decides anew. Readers see whole versions only. A version is the last row of each key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "_version"
#: Folders of changes after which a commit writes the whole table anew.
MERGE_AFTER = 32

JOB_SCHEMA = (
    "id string, job_type string, recording_id string, status string, input_url string, callback_url string, result_json string, "
    "error string, attempts int, skip_enhancement boolean, skip_transcription boolean, existing_transcript string, max_tags int, "
    "custom_tags string, created_at timestamp, started_at timestamp, completed_at timestamp, callback_delivered boolean"
)
#: What rows written before a column existed have in it.
JOB_DEFAULTS = {"callback_delivered": False, "max_tags": 8}


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class VersionedTable:
    """A table of one row a key at ``path``, any file system of Hadoop's with an atomic rename."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", defaults: dict | None = None) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema, self.defaults = StructType.fromDDL(schema), defaults or {}
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The last version; 0 where nothing was committed."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _manifest(self, version: int) -> list[str]:
        """The folders that make up a version."""
        opened = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self._hadoop.io.IOUtils.readFullyToByteArray(opened).decode())
        finally:
            opened.close()

    def _publish(self, version: int, folders: list[str]) -> None:
        draft = self._path(f"versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(folders).encode())
        out.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._path(f"versions/{version:012d}.json"), options)
        except Exception as fault:
            self._fs.delete(draft, False)
            if self.version() >= version:
                raise Conflict(f"{self.path}: version {version} exists") from fault
            raise

    def changes(self, version: int | None = None) -> DataFrame:
        """The rows that commits wrote since the last whole one, with the version that each came in."""
        version = self.version() if version is None else version
        wide = StructType.fromDDL(f"{VERSION} long")
        schema = StructType([*self.schema.fields, *wide.fields])
        folders = [f"{self.path}/{x}" for x in self._manifest(version)] if version else []
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in self.defaults.items()})

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last by default; columns that came later have their defaults."""
        rest = [c for c in self.schema.names if c != self.key]
        last = self.changes(version).groupBy(self.key).agg(F.max_by(F.struct(*rest), VERSION).alias("_row"))
        return last.select(*[F.col(c) if c == self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def commit(self, base: int, changed: DataFrame, whole: bool = False) -> int:
        """Publish the rows of ``changed``, one for a key, as the version after ``base``; or all rows, if ``whole``.

        Raises Conflict if ``base`` isn't the last version any more. Columns that ``changed`` lacks are null.
        """
        before = [] if whole or not base else self._manifest(base)
        if len(before) >= MERGE_AFTER:
            kept = self.read(base).join(changed.select(self.key), self.key, "left_anti")
            changed, before = kept.unionByName(changed, allowMissingColumns=True), []
        have = set(changed.columns)
        row = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        name = f"rows/{base + 1:012d}-{uuid.uuid4().hex}"
        changed.select(*row, F.lit(base + 1).cast("long").alias(VERSION)).write.parquet(f"{self.path}/{name}")
        try:
            self._publish(base + 1, [*before, name])
        except Conflict:
            self._fs.delete(self._path(name), True)
            raise
        return base + 1

    def update(self, change: Callable[[DataFrame], DataFrame], retries: int = 1) -> int:
        """Commit the rows that ``change`` makes of the table; a loser reads the winner's version and decides anew."""
        while True:
            base = self.version()
            try:
                return self.commit(base, change(self.read(base)))
            except Conflict:
                if not retries:
                    raise
                retries -= 1


def job_table(spark: SparkSession, path: str) -> VersionedTable:
    """The stored jobs: one row an id, in its last version."""
    return VersionedTable(spark, path, JOB_SCHEMA, "id", JOB_DEFAULTS)
