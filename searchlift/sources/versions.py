"""Tables of whole days in versions: a commit writes new folders beside the old ones and then moves one pointer.

A table is a folder with data/<load>/day=<day>/ and manifests/<version>.json. A manifest names, for each
day, the folder that holds it, so a version is whole the moment its manifest appears, and a load
that is killed before that leaves the version before it as it was. The manifest is written under another
name and renamed without overwriting, so of two loads that start from one version the second is refused.
The driver holds one entry for each day of the table, never a row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitRefused(RuntimeError):
    """The commit would be of an older state: another one was first, or its lease is lost."""


@dataclass(frozen=True)
class Day:
    """The folders of a day's rows, how many rows, and the number of the load that brought them."""

    folders: list[str]
    rows: int
    load: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    days: dict[str, Day] = field(default_factory=dict)
    #: The last micro-batch that each stream has committed.
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(found["version"], found["schema"], {d: Day(**x) for d, x in found["days"].items()}, found["batches"])


class _Pointed:
    """A folder whose newest manifest says what is in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_text(self, version: int | None = None) -> str | None:
        """The newest manifest, or that of a version; none where nothing was committed."""
        folder, fs = self._hadoop(f"{self.path}/manifests")
        if version is None:
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            known = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
            if not known:
                return None
            version = max(known)
        stream = fs.open(self._hadoop(f"{self.path}/manifests/{version:012d}.json")[0])
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _point(self, version: int, text: str) -> None:
        jvm, name = self.spark._jvm, f"{version:012d}.json"
        temp, fs = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(self._hadoop(f"{self.path}/manifests/{name}")[0]), options)
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitRefused(f"version {version} was committed by another load") from None
            raise

class VersionedTable(_Pointed):
    def __init__(self, spark: SparkSession, path: str, day: str = "metric_date"):
        super().__init__(spark, path)
        self.day = day

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one where nothing was committed."""
        text = self._manifest_text(version)
        return Manifest.of(text) if text else Manifest()

    def read(self, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
        """A version's rows; first and last choose days by the manifest, so that others are not even listed."""
        m = self.manifest(version)
        if not m.schema:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.path}/{f}" for day, d in sorted(m.days.items()) if (first is None or day >= first) and (last is None or day <= last) for f in d.folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, new: DataFrame, *, start: str | None = None, end: str | None = None, load: int = 0, based_on: Manifest | None = None, most: int | None = None, held: Callable[[], bool] = lambda: True, batch: tuple[str, int] | None = None, newest: bool = False) -> Manifest:
        """Replace whole days by those of `new`, and all days of [start, end] if these are given, even by none.

        most: rows of a day from which on the load counts as cut off and is refused. held: asked once
        all is written, right before the pointer moves; a lease that is lost by then refuses the commit.
        batch: (stream, number) of a micro-batch; one that is committed already changes nothing.
        newest: `new` has a column `load`; of each day only the rows of its newest load count: a day stays
        if its own load is newer, and grows if it is the same, which came in parts.
        """
        before = based_on or self.manifest()
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return before
        name = f"data/{uuid.uuid4().hex}"
        rows = new.withColumn("__day", F.date_format(self.day, "yyyy-MM-dd"))
        if newest:
            loads = {r["__day"]: r["load"] for r in rows.groupBy("__day").agg(F.max("load").alias("load")).collect()}  # one row for each day
            loads = {d: n for d, n in loads.items() if d is not None and (d not in before.days or before.days[d].load <= n)}
            chosen = self.spark.createDataFrame(list(loads.items()), f"__day string, load {new.schema['load'].dataType.simpleString()}")
            rows = rows.join(F.broadcast(chosen), ["__day", "load"], "left_semi").drop("load")
        schema = rows.drop("__day").schema
        rows.where("__day IS NOT NULL").write.partitionBy("__day").parquet(f"{self.path}/{name}")
        counts = self.spark.read.schema(f"__day string, `{self.day}` date").parquet(f"{self.path}/{name}").groupBy("__day").count()
        days = {r["__day"]: Day([f"{name}/__day={r['__day']}"], r["count"], loads[r["__day"]] if newest else load) for r in counts.collect()}
        for d, x in before.days.items():
            if newest and d in days and x.load == days[d].load:
                days[d] = Day(x.folders + days[d].folders, x.rows + days[d].rows, x.load)
        over = sorted(d for d, x in days.items() if most is not None and x.rows > most)
        if over:
            raise CommitRefused(f"daily row cap reached on {over[0]}: the load may be cut off")
        kept = {d: x for d, x in before.days.items() if d not in days and not (start is not None and end is not None and start <= d <= end)}
        batches = before.batches | ({batch[0]: batch[1]} if batch else {})
        after = Manifest(before.version + 1, schema.json(), kept | days, batches)
        if not held():
            raise CommitRefused("the lease was lost while the load was written")
        self._point(after.version, after.text())
        return after

    def drop_unused(self, keep: Iterable[int] = ()) -> int:
        """Delete folders that neither the newest version nor one to keep names; returns how many. Not to be run beside a load."""
        live = {f.split("/")[1] for v in {self.manifest().version, *keep} - {0} for d in self.manifest(v).days.values() for f in d.folders}
        folder, fs = self._hadoop(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in live] if fs.exists(folder) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


class TableSet(_Pointed):
    """Tables that belong together, such as the outputs of a run: all of a version are there, or none."""

    def _manifest(self, version: int | None = None) -> dict:
        text = self._manifest_text(version)
        return json.loads(text) if text else {"version": 0, "tables": {}}

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def begin(self) -> NewTables:
        return NewTables(self, self._manifest()["version"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self._manifest(version)["tables"][name]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['folder']}")


class NewTables:
    """The next version while it is made; nothing of it shows before commit."""

    def __init__(self, tables: TableSet, based_on: int):
        self.tables, self.based_on, self.folder, self.made = tables, based_on, f"data/{uuid.uuid4().hex}", {}

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of the version, once, and read it back for those that are made from it."""
        path = f"{self.tables.path}/{self.folder}/{name}"
        rows.write.parquet(path)
        self.made[name] = {"folder": f"{self.folder}/{name}", "schema": rows.schema.jsonValue()}
        return self.tables.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> int:
        version = self.based_on + 1
        self.tables._point(version, json.dumps({"version": version, "tables": self.made}))
        return version
