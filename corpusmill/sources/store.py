"""Snapshot store: each table is a folder of Parquet snapshots, and one manifest names the current ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Staged:
    """A written part of a table that no reader sees before it is published."""

    table: str
    folder: str
    added: bool  # to the current parts, instead of in their place


class Store:
    """Tables under ``root``. Readers keep the snapshot they opened; one writer at a time flips the manifest.

    A snapshot is one folder or, for tables that grow by segments, several. A change of several tables is
    one file of the manifest, so it is there as a whole or not at all. The manifest is written through
    Spark's file system, so ``root`` may be any path that Spark can write.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> dict[str, tuple[int, str]]:
        """Version and folders of each table: entries are only added, and the highest version counts."""
        try:
            rows = self.spark.read.schema("table string, version bigint, snapshot string").json(f"{self.root}/manifest")
            newest = rows.where("snapshot is not null").groupBy("table").agg(F.max(F.struct("version", "snapshot")).alias("n"))
            return {r["table"]: tuple(r["n"]) for r in newest.collect()}
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return {}

    def parts(self, table: str) -> list[str]:
        """Folders of the current snapshot."""
        return [p for p in self._current().get(table, (0, ""))[1].split(",") if p]

    def opened(self) -> dict[str, list[str]]:
        """Folders of all tables at one moment: what a reader that keeps to one snapshot reads."""
        return {table: [p for p in folders.split(",") if p] for table, (_, folders) in self._current().items()}

    def read_parts(self, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
        """Some folders of a table; columns that one lacks are null, no folders are an empty table."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{f}" for f in folders])
        return rows.select(*schema.fieldNames())  # without the name of the segment, where it is not asked for

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The current snapshot; an absent table is empty."""
        return self.read_parts(table, self.parts(table), schema)

    def stage(self, table: str, rows: DataFrame, segment: bool = False, by: tuple[str, ...] = (), **options: str) -> Staged:
        """Write a part of a table; a ``segment`` joins the current ones and has its name as a column when it is read."""
        name = uuid.uuid4().hex[:12]
        staged = Staged(table, f"segment={name}" if segment else f"v-{name}", segment)
        writer: DataFrameWriter = rows.write.options(**options)
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/{staged.folder}")
        return staged

    def publish(self, staged: list[Staged]) -> None:
        """All staged parts become current at once."""
        now, folders = self._current(), {}
        for part in staged:
            before = folders.get(part.table, now.get(part.table, (0, ""))[1] if part.added else "")
            folders[part.table] = ",".join(x for x in (before, part.folder) if x)
        entries = [(t, 1 + now.get(t, (0, ""))[0], f) for t, f in folders.items()]
        self.spark.createDataFrame(entries, "table string, version bigint, snapshot string").coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """New snapshots of tables; the manifest is flipped once, after all files of all of them are written."""
        self.publish([self.stage(table, rows) for table, rows in tables.items()])

    def write(self, table: str, rows: DataFrame) -> None:
        self.commit({table: rows})

    def append(self, table: str, rows: DataFrame, schema: T.StructType) -> None:
        self.write(table, self.read(table, schema).unionByName(rows, allowMissingColumns=True))
