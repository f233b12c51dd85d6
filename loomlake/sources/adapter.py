"""Document adapters as a Python data source: anything that lists and fetches documents becomes a table, one task per slice of the list, and a stream whose offset is the revision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship

SCHEMA = "doc_id string, title string, content string, revision string"


class Adapter:
    """What a source has to offer: ids to list and documents to fetch."""

    def list_ids(self) -> list[str]:
        raise NotImplementedError

    def fetch(self, doc_id: str) -> dict:
        raise NotImplementedError

    def fetch_many(self, ids: list[str]) -> Iterator[tuple[str, dict]]:
        """Those of the documents that can be fetched."""
        for i in ids:
            try:
                yield i, self.fetch(i)
            except (KeyError, OSError):
                continue

    def latest(self) -> int:
        """The newest revision; revisions are whole numbers that grow."""
        raise NotImplementedError

    def changed(self, after: int, until: int) -> list[str]:
        """Ids of documents whose revision is above `after` and not above `until`."""
        raise NotImplementedError


class TableAdapter(Adapter):
    """Documents of a Parquet table that pyarrow can open: id, title, content and revision are columns of it (revision: 1 where there is none)."""

    def __init__(self, path: str, id_col: str, title: str, content: str, revision: str | None = None):
        self.path, self.cols, self.revision = path, (id_col, title, content), revision

    def _table(self, columns: list[str], where=None):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet").to_table(columns=list(dict.fromkeys(columns)), filter=where)

    def list_ids(self) -> list[str]:
        return sorted(map(str, self._table([self.cols[0]])[self.cols[0]].to_pylist()))

    def fetch_many(self, ids: list[str]) -> Iterator[tuple[str, dict]]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        wanted = pc.is_in(ds.field(self.cols[0]).cast(pa.string()), pa.array(ids, pa.string()))
        i, title, content = self.cols
        for r in self._table([*self.cols, *([self.revision] if self.revision else [])], wanted).to_pylist():
            yield str(r[i]), {"title": r[title], "content": r[content], "revision": str(r[self.revision] if self.revision else 1)}

    def latest(self) -> int:
        import pyarrow.compute as pc

        return (pc.max(self._table([self.revision])[self.revision]).as_py() or 0) if self.revision else 1

    def changed(self, after: int, until: int) -> list[str]:
        import pyarrow.dataset as ds

        if not self.revision:
            return self.list_ids() if after < 1 <= until else []
        f = ds.field(self.revision)
        return sorted(map(str, self._table([self.cols[0]], (f > after) & (f <= until))[self.cols[0]].to_pylist()))


class MemoryAdapter(Adapter):
    """Documents held in a dict of id to (title, content, revision)."""

    def __init__(self, docs: dict[str, tuple[str, str, str]]):
        self.docs = docs

    def list_ids(self) -> list[str]:
        return sorted(self.docs)

    def fetch(self, doc_id: str) -> dict:
        return dict(zip(("title", "content", "revision"), self.docs[doc_id]))


class _Slice(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


def source(name: str, make: Callable[[], Adapter], slices: int = 8) -> type[DataSource]:
    """A data source class over an adapter; documents that cannot be fetched are left out, a failed fetch does not fail the task."""

    class Reader(DataSourceReader):
        def partitions(self):
            ids = make().list_ids()
            return [_Slice(ids[i::slices]) for i in range(min(slices, len(ids)))] or [_Slice([])]

        def read(self, partition) -> Iterator[tuple]:
            for i, d in make().fetch_many(partition.ids):
                yield i, d.get("title"), d.get("content"), d.get("revision")

    class Stream(DataSourceStreamReader):
        """A batch has the documents whose revision lies between two offsets, in slices; nothing else is fetched."""

        def initialOffset(self) -> dict:
            return {"revision": 0}

        def latestOffset(self) -> dict:
            return {"revision": make().latest()}

        def partitions(self, start: dict, end: dict):
            ids = make().changed(start["revision"], end["revision"])
            return [_Slice(ids[i::slices]) for i in range(min(slices, len(ids)))] or [_Slice([])]

        def read(self, partition) -> Iterator[tuple]:
            for i, d in make().fetch_many(partition.ids):
                yield i, d.get("title"), d.get("content"), d.get("revision")

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return Stream()

    return Source


def read(spark: SparkSession, name: str, make: Callable[[], Adapter], slices: int = 8) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source(name, make, slices))
    return spark.read.format(name).load()


def stream(spark: SparkSession, name: str, make: Callable[[], Adapter], slices: int = 8) -> DataFrame:
    """The documents of an adapter as they change."""
    ship(spark)
    spark.dataSource.register(source(name, make, slices))
    return spark.readStream.format(name).load()
