"""Stored tables whose batches and versions become visible by one commit (IO3, IO4, IO11).

A table is a folder of data folders, which are written once and never changed,
and of a log with one small file per commit. A commit names its data folder and
either adds it to the table (a batch) or makes it the whole table (a new
version). Rows are written first and committed after, so a writer that is killed
leaves a folder that nobody reads: readers see the last commit, and a reader that
has begun keeps its folders. A batch that is committed already is not written
again, so a retry neither doubles nor loses rows. One writer at a time: two
commits of one number are an error for all later readers and writers, not a
silent merge. Everything goes through Spark's own readers and writers; the
single file of a commit appears by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from delaylens.sources.files import balanced_for_write, high_water_mark_value, incremental_rows, upsert_stops

FOLDER = "stored_folder"  # data folders are partitions of this name, so that date partitions below them are found
LOG_SCHEMA = "number long, batch string, folder string, whole boolean, schema string"
MAX_RECORDS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class Commit:
    number: int
    batch: str | None
    folder: str
    whole: bool      # the folder is the whole table, else one batch of it
    schema: str


class StoredTable:
    """A table at ``path``, partitioned by ``partition_by`` where it has these columns."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)

    def commits(self) -> list[Commit]:
        """All commits in order (one small row each); none where the table does not exist."""
        try:
            rows = self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/log").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        found = sorted((Commit(*r) for r in rows), key=lambda c: c.number)
        if [c.number for c in found] != list(range(len(found))):
            raise ValueError(f"{self.path}: the log holds commits {[c.number for c in found]}; were there two writers?")
        return found

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table as of a commit (the last one); None before the first."""
        commits = self.commits()
        if number is not None:
            commits = commits[: number + 1]
        if not commits:
            return None
        start = max((k for k, c in enumerate(commits) if c.whole), default=0)
        return self._rows(commits[start:])

    def batch(self, batch: str) -> DataFrame | None:
        """The rows of one committed batch."""
        found = [c for c in self.commits() if c.batch == batch]
        return self._rows(found) if found else None

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add a batch; False where it is committed already (nothing is written then)."""
        commits = self.commits()
        if any(c.batch == batch for c in commits):
            return False
        self._commit(Commit(len(commits), batch, self._write(rows), False, rows.schema.json()))
        return True

    def replace(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Make ``rows`` (which may read the table itself) the whole table; as ``append`` where the batch is known."""
        commits = self.commits()
        if batch is not None and any(c.batch == batch for c in commits):
            return False
        self._commit(Commit(len(commits), batch, self._write(rows), True, rows.schema.json()))
        return True

    def _rows(self, commits: Sequence[Commit]) -> DataFrame:
        out = None
        for schema in dict.fromkeys(c.schema for c in commits):
            folders = [self._folder(c.folder) for c in commits if c.schema == schema]
            kind = StructType.fromJson(json.loads(schema))
            part = self.spark.read.schema(kind).option("basePath", f"{self.path}/data").parquet(*folders).select(*kind.names)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/{FOLDER}={name}"

    def _write(self, rows: DataFrame) -> str:
        folder = f"f{uuid.uuid4().hex}"
        cols = [c for c in self.partition_by if c in rows.columns]
        w = balanced_for_write(rows, cols).write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        (w.partitionBy(*cols) if cols else w).parquet(self._folder(folder))
        return folder

    def _commit(self, c: Commit) -> None:
        (self.spark.createDataFrame([(c.number, c.batch, c.folder, c.whole, c.schema)], LOG_SCHEMA)
         .coalesce(1).write.mode("append").json(f"{self.path}/log"))


def append_incremental(table: StoredTable, source: DataFrame, batch: str, exact: bool = False) -> DataFrame:
    """IO3+IO4 that can be repeated: the source's rows after the mark of the committed
    rows, added as ``batch``; returns the batch's rows. The mark does not see
    half-written batches, and a batch that is committed is returned as it is."""
    done = table.batch(batch)
    if done is not None:
        return done
    table.append(incremental_rows(table.read(), source, exact=exact), batch)
    return table.batch(batch)


def upsert_table(table: StoredTable, updates: DataFrame, key: str = "base_stop_id", order_col: str | None = None,
                 batch: str | None = None) -> DataFrame:
    """IO11 on a stored table: new keys inserted, known ones replaced, as one new version."""
    existing = table.read()
    new = upsert_stops(existing if existing is not None else updates.limit(0), updates, key, order_col)
    table.replace(new, batch)
    return table.read()


def high_water_mark(table: StoredTable):
    """Newest departure of the committed rows (None: no rows)."""
    rows = table.read()
    return None if rows is None else high_water_mark_value(rows)
