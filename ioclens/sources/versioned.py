"""Several Parquet tables under one version.

Every table lies in folders by version, keyed tables also by bucket (a hash of
their key):  <path>/<table>/v=<version>/bucket=<b>/.  One small file per
version, <path>/_versions/<version>.json, names for all tables the folders
that make them up.  A batch writes new folders only -- the buckets it touches
of keyed tables, its own rows of append tables -- and then its version file,
renamed into place: that rename commits all tables at once.  Until then
readers see the old version of all of them; folders of a batch that died are
overwritten when it is replayed, and a batch that is already in does nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


class Tables:
    """``schemas``: name -> (DDL, key columns; none for an append table)."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, tuple[str, list[str]]], buckets: int = BUCKETS):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # small files and folders, through the session's file system
    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def state(self) -> dict:
        """The newest version: its number, its batch and its folders."""
        numbers = [int(n[:-5]) for n in self._names(f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return {"version": 0, "batch": None, "folders": {name: {} for name in self.schemas}}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{max(numbers)}.json", wholetext=True).first()[0])

    def done(self, batch: int) -> bool:
        last = self.state()["batch"]
        return last is not None and batch <= last

    def bucket(self, name: str):
        """The bucket of a row of a keyed table."""
        keys = self.schemas[name][1]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int") if keys else F.lit(0)

    def columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name][0]).columns

    def touched(self, name: str, *rows: DataFrame) -> list[int]:
        """The buckets of rows; at most as many numbers as there are buckets."""
        found = [df.select(self.bucket(name).alias("b")) for df in rows]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return sorted(r.b for r in every.distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some of its buckets."""
        folders = self.state()["folders"][name]
        chosen = folders if buckets is None else {str(b): folders[str(b)] for b in buckets if str(b) in folders}
        paths = [f"{self.path}/{name}/{f}" for own in chosen.values() for f in own]
        ddl = self.schemas[name][0]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def commit(self, batch: int, appends: dict[str, DataFrame] | None = None,
               replaces: dict[str, tuple[DataFrame, list[int]]] | None = None) -> bool:
        """One version with the rows of ``appends`` added and the ``replaces``
        buckets (rows, bucket numbers) made anew.  False if the batch is in."""
        now = self.state()
        if now["batch"] is not None and batch <= now["batch"]:
            return False
        version = now["version"] + 1
        folders = {name: dict(own) for name, own in now["folders"].items()}
        for name, df, gone in [*((n, df, []) for n, df in (appends or {}).items()), *((n, df, b) for n, (df, b) in (replaces or {}).items())]:
            rows = df.select(*self.columns(name), self.bucket(name).alias("bucket"))
            rows = rows.repartition("bucket") if self.schemas[name][1] else rows
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}")
            for b in gone:
                folders[name].pop(str(b), None)
            for folder in self._names(f"{self.path}/{name}/v={version}"):
                if folder.startswith("bucket="):
                    folders[name].setdefault(folder[7:], []).append(f"v={version}/{folder}")
        self._publish({"version": version, "batch": batch, "folders": folders})
        return True

    def _publish(self, state: dict) -> None:
        path = f"{self.path}/_versions/{state['version']}.json"
        new, fs = self._at(path + ".new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = self._at(path)
        if fs.exists(final) or not fs.rename(new, final):
            raise OSError(f"version {state['version']} of {self.path} was written by another batch")
