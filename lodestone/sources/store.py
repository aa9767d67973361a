"""Tables that outlive a run: reuse of what was built from the same inputs, and keyed upserts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def files(self) -> list[tuple[str, int, int]]:
        """Every file below with its size and time, hidden ones left out."""
        if not self.exists():
            return []
        found, each = [], self.fs.listFiles(self._path(""), True)
        while each.hasNext():
            s = each.next()
            if not s.getPath().getName().startswith(("_", ".")):
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is taken."""
        return not self.exists(new) and self.fs.rename(self._path(old), self._path(new))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        self.fs.mkdirs(self._path(name).getParent())
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def fingerprint(spark: SparkSession, name: str, inputs: Sequence[str], parameters: dict) -> str:
    """What a result depends on: its name, its parameters, and the path, size and time of every input file."""
    known = [name, sorted((k, repr(v)) for k, v in parameters.items()), [(p, Folder(spark, p).files()) for p in inputs]]
    return hashlib.sha256(json.dumps(known).encode()).hexdigest()[:24]


def reused(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], inputs: Sequence[str], **parameters) -> DataFrame:
    """The table that ``build`` makes, written below ``root`` once for all runs with the same parameters and input files.

    A table counts from its success mark on; one without it was left half-written and is made anew. It is written under another name
    and renamed, so that of two runs that build at once both get a whole one. A changed file or parameter asks for another table; the
    older ones of the name go with ``forget``.
    """
    folder, table = Folder(spark, root), f"{name}-{fingerprint(spark, name, inputs, parameters)}"
    if not folder.exists(f"{table}/_SUCCESS"):
        if folder.exists(table):
            folder.delete(table)
        fresh = f".{table}-{uuid.uuid4().hex}"
        build().write.parquet(f"{folder.path}/{fresh}")
        if not folder.rename(fresh, table):
            folder.delete(fresh)
    return spark.read.parquet(f"{folder.path}/{table}")


def forget(spark: SparkSession, root: str, name: str, inputs: Sequence[str] = (), **parameters) -> None:
    """Remove the tables of a name, but for that of the inputs and parameters as they are now."""
    folder, current = Folder(spark, root), f"{name}-{fingerprint(spark, name, inputs, parameters)}"
    for old in folder.names():
        if old.lstrip(".").startswith(f"{name}-") and old != current:
            folder.delete(old)


class KeyedTable:
    """A stored table with one row for each key, in buckets of keys.

    An upsert writes only the buckets that its keys fall in, beside the old ones, and then a list of which folders are the table now;
    the list's number is taken by a rename, so a crash at any point leaves the old table or the new one, and of two upserts at once
    the later fails and may be repeated. Readers go on reading the folders of their list until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.keys, self.folder = spark, list(keys), Folder(spark, path)
        self.buckets = self._state()[1].get("buckets", buckets)

    def _state(self) -> tuple[int, dict]:
        versions = [int(v.removesuffix(".json")) for v in self.folder.names("versions") if v.endswith(".json") and not v.startswith(".")]
        return (max(versions), json.loads(self.folder.text(f"versions/{max(versions):08d}.json"))) if versions else (0, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame | None:
        """The table as it is now; None before the first upsert."""
        _, state = self._state()
        return self._parts(state, state["parts"]) if state else None

    def _parts(self, state: dict, buckets: Sequence[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        paths = [f"{self.folder.path}/{state['parts'][b]}" for b in buckets]
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*paths)

    def upsert(self, rows: DataFrame, order: Column | str | None = None) -> None:
        """Rows take the place of those with the same keys, or are added; of several with the same keys the last in ``order`` counts.
        Null keys are keys like others. Columns have to be those of the table."""
        number, state = self._state()
        if order is not None:
            last = Window.partitionBy(*self.keys).orderBy((F.col(order) if isinstance(order, str) else order).desc())
            rows = rows.withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place")
        else:
            rows = rows.dropDuplicates(self.keys)
        if state and sorted(f["name"] for f in state["schema"]["fields"]) != sorted(rows.columns):
            raise ValueError(f"columns differ: {sorted(rows.columns)}")
        new = rows.withColumn("bucket", self._bucket())
        changed = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        if not changed:
            return
        old = [b for b in changed if state and b in state["parts"]]
        if old:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            stay = self._parts(state, old).withColumn("bucket", self._bucket()).alias("o").join(new.alias("n"), same, "left_anti")
            new = stay.select("o.*").unionByName(new)
        data = f"data/{uuid.uuid4().hex}"
        new.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/{data}")
        parts = {**(state["parts"] if state else {}), **{b: f"{data}/bucket={b}" for b in changed}}
        schema = state["schema"] if state else json.loads(rows.schema.json())
        fresh = f"versions/.{uuid.uuid4().hex}"
        self.folder.put(fresh, json.dumps({"buckets": self.buckets, "parts": parts, "schema": schema}))
        if not self.folder.rename(fresh, f"versions/{number + 1:08d}.json"):
            self.folder.delete(fresh)
            raise RuntimeError("the table was changed meanwhile")

    def vacuum(self) -> None:
        """Remove folders and lists that are not of the table as it is now, such as those of a run that broke off."""
        number, state = self._state()
        used = {p.split("/")[1] for p in state.get("parts", {}).values()}
        for name in self.folder.names("data"):
            if name not in used:
                self.folder.delete(f"data/{name}")
        for name in self.folder.names("versions"):
            if name != f"{number:08d}.json":
                self.folder.delete(f"versions/{name}")
