"""Tables that are published together, and state that takes batches as runs.

A table is a list of runs, each a folder of Parquet files that never changes.  A manifest names the runs
of every table; it is written last and moved into place, so a set of tables appears at once or not at all,
empty ones included, and a failure in between leaves the set before as it was.  Listing costs the manifests
and runs that are kept, however many there have been.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    """A folder of a table, its bytes, and its schema as JSON."""

    name: str
    bytes: int
    schema: str


class Published:
    """Tables below ``root``.  Manifests are numbered; the newest ``keep`` stay for readers that have begun."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, before: int | None = None) -> tuple[int, dict[str, list[Run]]]:
        """The newest manifest (of a number below ``before``) and its number; -1 and no tables where there is none."""
        found = [n for n in self.numbers() if before is None or n < before]
        return (found[-1], self._load(found[-1])) if found else (-1, {})

    def _load(self, number: int) -> dict[str, list[Run]]:
        stream = self._fs.open(self._at(f"manifests/{number}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {t: [Run(**r) for r in runs] for t, runs in json.loads(text).items()}

    def stage(self, df: DataFrame, table: str, number: int) -> Run:
        """Write a run of ``table`` that manifest ``number`` is to name."""
        name = f"{number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/tables/{table}/{name}")
        return Run(name, self._fs.getContentSummary(self._at(f"tables/{table}/{name}")).getLength(), df.schema.json())

    def publish(self, number: int, tables: dict[str, list[Run]], again: bool = False) -> None:
        """Make ``tables`` the set that readers see.  ``again`` lets a repeated batch replace its own manifest; without
        it a number that another writer has taken is an error."""
        target, draft = self._at(f"manifests/{number}.json"), self._at(f"manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({t: [asdict(r) for r in runs] for t, runs in tables.items()}).encode()))
        out.close()
        if self._fs.exists(target):
            if not again:
                self._fs.delete(draft, False)
                raise FileExistsError(f"{self.root}: manifest {number} is taken")
            self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise FileExistsError(f"{self.root}: manifest {number} is taken")
        self._purge()

    def _purge(self) -> None:
        """Delete older manifests, and runs of theirs or of failed attempts that no kept manifest names."""
        numbers = self.numbers()
        named: dict[str, set[str]] = {}
        for n in numbers[-self.keep :]:
            for t, runs in self._load(n).items():
                named.setdefault(t, set()).update(r.name for r in runs)
        for n in numbers[: -self.keep]:
            self._fs.delete(self._at(f"manifests/{n}.json"), False)
        for t in self._names("tables"):
            for run in self._names(f"tables/{t}"):
                if run not in named.get(t, ()) and int(run.split("-")[0]) <= numbers[-1]:
                    self._fs.delete(self._at(f"tables/{t}/{run}"), True)

    def rows(self, table: str, runs: list[Run]) -> DataFrame:
        schema = StructType.fromJson(json.loads(runs[0].schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/tables/{table}/{r.name}" for r in runs])

    def read(self, table: str) -> DataFrame:
        found = self.manifest()[1].get(table)
        if not found:
            raise FileNotFoundError(f"{self.root} has no table {table}")
        return self.rows(table, found)


class StateTable:
    """State that batches are merged into.  A batch is merged with itself and written as a run of its own; runs that
    are no larger than what came after them are merged into one, so a row is written about log2(batches) times and a
    reader merges about as many runs.  ``merge`` gives the same result for any grouping and order of the rows.
    ``expire`` may drop rows when the oldest run is rewritten, which is the only time that nothing older can need them."""

    NAME = "state"

    def __init__(self, spark: SparkSession, path: str, merge: Merge, expire: Callable[[DataFrame], DataFrame] | None = None):
        self.store, self.merge, self.expire = Published(spark, path), merge, expire

    def apply(self, new: DataFrame, number: int) -> None:
        """Batch ``number``; run again after a failure, it changes nothing."""
        if new.isEmpty():
            return
        runs = self.store.manifest(before=number)[1].get(self.NAME, [])
        run = self.store.stage(self.merge(None, new), self.NAME, number)
        first, total = len(runs), run.bytes
        while first and runs[first - 1].bytes <= total:
            first -= 1
            total += runs[first].bytes
        if first < len(runs):
            merged = self.merge(None, self.store.rows(self.NAME, [*runs[first:], run]))
            run = self.store.stage(self.expire(merged) if self.expire and not first else merged, self.NAME, number)
        self.store.publish(number, {self.NAME: [*runs[:first], run]}, again=True)

    def runs(self) -> list[Run]:
        return self.store.manifest()[1].get(self.NAME, [])

    def read(self) -> DataFrame | None:
        """The state; None before the first batch."""
        runs = self.runs()
        if not runs:
            return None
        rows = self.store.rows(self.NAME, runs)
        return rows if len(runs) == 1 else self.merge(None, rows)


def upsert_stream(stream: DataFrame, table: StateTable, checkpoint: str, **trigger):
    """Fold a stream into ``table``, batch by batch."""
    return stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
