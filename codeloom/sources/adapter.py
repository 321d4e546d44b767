"""Where a model's tables come from, behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.tables import table
from codeloom.sources.versions import VersionedTables

T = TypeVar("T")


class Adapter(Protocol):
    """Tables that can be queried, and written all at once or not at all."""

    def init(self) -> None: ...

    def query(self, sql: str, params: Mapping[str, object] | None = None) -> DataFrame: ...

    def transaction(self, work: Callable[[dict[str, DataFrame]], T]) -> T: ...

    def close(self) -> None: ...

    def path(self) -> str: ...


class FolderAdapter:
    """Parquet tables of a folder, by the names of their files, and as later transactions have left them."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]) -> None:
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), names
        self._store, self._version = VersionedTables(spark, self.folder), 0
        self._tables: dict[str, DataFrame] = {}

    def init(self) -> None:
        self._version = self._store.version()
        stored = self._store.folders(self._version)
        self._tables = {n: self._store.read(n, self._version) if n in stored else table(self.spark, self.folder, n) for n in self.names}

    def query(self, sql: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """Rows of a query that names tables in braces and parameters with a colon before them."""
        if not self._tables:
            raise RuntimeError("the adapter is not open")
        used = {n: t for n, t in self._tables.items() if f"{{{n}}}" in sql}
        return self.spark.sql(sql, args=dict(params or {}), **used)

    def transaction(self, work: Callable[[dict[str, DataFrame]], T]) -> T:
        """Runs work on a copy of the tables' names; the frames that it puts there are stored as one version afterwards.

        Nothing changes if work or storing fails, or if another writer has
        committed since init (`versions.Conflict`).
        """
        given = dict(self._tables)
        out = work(given)
        changed = {n: f for n, f in given.items() if f is not self._tables.get(n)}
        if changed:
            self._version = self._store.commit(changed, self._version)
            self._tables |= {n: self._store.read(n, self._version) for n in changed}
        return out

    def close(self) -> None:
        self._tables = {}

    def path(self) -> str:
        return self.folder
