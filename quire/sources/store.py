"""Several tables published together.

Each change writes new table folders and then one small pointer row naming the folders that belong together. A reader
takes the newest pointer, so it sees all tables of one state; a change that dies before its pointer leaves the old state.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.library import embedder_decision, replace_rows, unfinished, without
from quire.sources.files import derived_names, remove_files


class Conflict(RuntimeError):
    """Another writer published in between; nothing of this change is visible."""


class _Nothing(Exception):
    """There is nothing to publish."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[tuple[int, int]]:
        """(version, bytes) of the pointers, newest first, from their names alone."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder)]
        return sorted(((int(n[1:-5]), size) for n, size in found if n.startswith("v") and n.endswith(".json")), reverse=True)

    def _state(self) -> tuple[int, dict[str, str]]:
        """The highest version that was begun, and the tables of the last one that was ended."""
        versions = self._versions()
        for version, size in versions:
            if size:
                rows = self.spark.read.schema("version long, tables map<string,string>").json(f"{self.path}/pointers/v{version}.json").where("version IS NOT NULL").collect()
                if rows:
                    return versions[0][0], dict(rows[0].tables)
        return (versions[0][0] if versions else 0), {}

    def read(self, table: str) -> DataFrame | None:
        where = self._state()[1].get(table)
        return self.spark.read.parquet(where) if where else None

    def publish(self, changes: dict[str, DataFrame], since: int | None = None) -> int:
        """All changes or none. A change may read the tables that it replaces: its folder is a new one.

        The pointer's file is created exclusively, so of two writers that start from one version the later fails with
        ``Conflict``. ``since`` is the version that the changes were made from, if that was read before.
        """
        version, tables = self._state()
        if since is not None and since != version:
            raise Conflict(f"version {version} was published after {since}")
        wrote = {}
        for name, rows in changes.items():
            wrote[name] = f"{self.path}/{name}/{version + 1}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(wrote[name])
        tables |= wrote
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/v{version + 1}.json")
        fs = pointer.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(pointer, False)
        except Py4JJavaError as e:
            if "already exists" in str(e.java_exception):
                for where in wrote.values():  # nobody else knows these folders
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where), True)
                raise Conflict(f"version {version + 1} was published meanwhile") from None
            raise
        try:
            out.write(bytearray(json.dumps({"version": version + 1, "tables": tables}).encode()))
        finally:
            out.close()
        return version + 1

    def change(self, make: Callable[[Callable[[str], DataFrame | None]], dict[str, DataFrame]], tries: int = 10) -> int:
        """Publishes what ``make`` makes of the tables that it reads (by the function it is given), all of one version. If
        another writer came before, it is made again from the new version, ``tries`` times at most."""
        for left in reversed(range(tries)):
            version, tables = self._state()
            read = lambda name: self.spark.read.parquet(tables[name]) if name in tables else None  # noqa: B023, E731
            try:
                return self.publish(make(read), version)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def guard(self, fingerprint: str, reset: bool = False) -> str:
        """Refuses to mix vectors of two embedders; stamps an empty store; with ``reset`` drops the vectors first."""
        said = []

        def make(read) -> dict[str, DataFrame]:
            meta, vectors = read("index_meta"), read("vectors")
            stored = meta.first()[0] if meta is not None else None
            n = vectors.count() if vectors is not None else 0
            row = self.spark.createDataFrame([(stored, fingerprint, n, reset)], "a string, b string, n long, r boolean")
            what = row.select(embedder_decision(F.col("a"), F.col("b"), F.col("n"), F.col("r"))).first()[0]
            said.append(what)
            if what == "refuse":
                raise ValueError(f"the index holds vectors of {stored}, not of {fingerprint}")
            changes = {"index_meta": self.spark.createDataFrame([(fingerprint,)], "fingerprint string")}
            if what == "ok":
                raise _Nothing
            if what == "rebuild" and vectors is not None:
                changes["vectors"] = vectors.limit(0)
            return changes

        with contextlib.suppress(_Nothing):
            self.change(make)
        return said[-1]

    def put(self, changes: dict[str, DataFrame]) -> int:
        """Replaces all rows of the documents in the changes, in every named table at once."""
        return self.change(lambda read: {n: rows if (old := read(n)) is None else replace_rows(old, rows) for n, rows in changes.items()})

    def delete(self, doc_ids: DataFrame, tables: tuple[str, ...] = ("vectors", "chunks", "postings", "documents"), fail: Callable[[], None] | None = None) -> int:
        """Marks the documents, then removes them from every table; ``purge`` ends what broke off between the two."""
        gone = doc_ids.select("doc_id").distinct().withColumn("__gone", F.lit(True))

        def mark(read) -> dict[str, DataFrame]:
            marked = read("documents").join(gone, "doc_id", "left")
            return {"documents": marked.withColumn("status", F.when(F.col("__gone"), "deleting").otherwise(F.col("status"))).drop("__gone")}

        self.change(mark)
        if fail:
            fail()
        return self.purge(tables)

    def purge(self, tables: tuple[str, ...] = ("vectors", "chunks", "postings", "documents")) -> int:
        def make(read) -> dict[str, DataFrame]:
            gone = unfinished(read("documents"))
            return {t: without(rows, gone) for t in tables if (rows := read(t)) is not None}

        return self.change(make)

    def visible(self, table: str) -> DataFrame:
        """A table without documents that wait for deletion."""
        return without(self.read(table), unfinished(self.read("documents")))

    def sweep(self, keep: int = 1) -> list[str]:
        """Removes what no kept version names: table folders of versions up to the newest (a writer that is under way has a
        higher number) and older pointers. The newest ``keep`` ended versions stay; gives the removed paths. Fails if
        anything that a kept version names is gone. Run again after a break, it ends the rest."""
        jvm = self.spark._jvm
        of = lambda path: jvm.org.apache.hadoop.fs.Path(path)
        fs = of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        ended: dict[int, dict[str, str]] = {}
        for version, size in self._versions():
            if size and len(ended) < keep:
                rows = self.spark.read.schema("version long, tables map<string,string>").json(f"{self.path}/pointers/v{version}.json").where("version IS NOT NULL").collect()
                ended |= {version: dict(r.tables) for r in rows}
        if not ended:
            return []
        named = {where.rpartition("/")[2] for tables in ended.values() for where in tables.values()}
        gone = []
        for table in fs.listStatus(of(self.path)):
            name = table.getPath().getName()
            if not table.isDirectory() or name == "pointers":
                continue
            for f in fs.listStatus(table.getPath()):
                folder = f.getPath().getName()
                number = folder.partition("-")[0]
                if number.isdigit() and int(number) <= max(ended) and folder not in named:
                    fs.delete(f.getPath(), True)
                    gone.append(f"{name}/{folder}")
        for version, _ in self._versions():
            if version < min(ended):
                fs.delete(of(f"{self.path}/pointers/v{version}.json"), False)
                gone.append(f"pointers/v{version}.json")
        lost = [where for tables in ended.values() for where in tables.values() if not fs.exists(of(where))]
        if lost:
            raise RuntimeError(f"named, but not there: {lost}")
        return gone

    def erase(self, doc_ids: DataFrame, folder: str, tables: tuple[str, ...] = ("vectors", "chunks", "postings", "documents"), fail: Callable[[], None] | None = None) -> list[str]:
        """Deletes documents to the end: their rows, the files in ``folder`` that extraction made of them, and the versions
        that still held them. Marked documents of a deletion that broke off go with them. Fails if anything stays; the file
        names that were removed. The ids of one call are bounded: their files are removed by the driver."""
        gone = []

        def files() -> None:
            for r in unfinished(self.read("documents")).distinct().toLocalIterator():
                gone.extend(remove_files(self.spark, folder, derived_names(r.doc_id)))
            if fail:
                fail()

        self.delete(doc_ids, tables, fail=files)
        self.sweep()
        left = {t: n for t in tables if (rows := self.read(t)) is not None and (n := rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").count())}
        if left:
            raise RuntimeError(f"rows of deleted documents stay: {left}")
        return gone
