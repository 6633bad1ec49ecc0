"""Versioned snapshots of stored tables: data written first, a manifest that says what counts switched last; merges that rewrite only the buckets they touch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.sources.tables import SLICE, _remove, drop_slices, exists

#: A manifest of up to this many parts is broadcast to the scan, which then lists those parts only.
PARTS = 100_000
MANIFEST = "table string, part string, repo string, branch string, run string, n long"


class Conflict(RuntimeError):
    """Another writer has switched the version first; nothing of this write is visible."""


class Snapshots:
    """Tables below ``root`` that change together.

    Rows lie in ``table/run=.../part=...``: a run is one write, a part a slice (repo and branch) or a bucket of ids. A version's manifest names the run that counts for
    each part of each table, with its rows, and holds the tables' schemas and the vectors' dimension. A write adds runs, then puts the next manifest in place by a rename, so that readers see all of it
    or nothing: a run that fails or is repeated half-way leaves the version before as it was. Old runs stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version, 0 before the first write."""
        p, fs = self._path(f"{self.root}/manifest")
        if not fs.exists(p):
            return 0
        return max((int(name[1:]) for s in fs.listStatus(p) if (name := s.getPath().getName()).startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:09d}/parts")

    def facts(self, version: int | None = None) -> dict:
        """``dim`` of the vectors, ``schemas`` of the tables, ``buckets`` of merged ones."""
        v = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v{v:09d}/facts").first()[0]) if v else {"dim": None, "schemas": {}, "buckets": {}}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows at a version: only the parts and runs that its manifest names are scanned."""
        v = self.version() if version is None else version
        schema = T.StructType.fromJson(self.facts(v)["schemas"][table])
        live = self.manifest(v).where(F.col("table") == table).select("run", "part")
        if not exists(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("run", T.StringType()), T.StructField("part", T.StringType())])).parquet(f"{self.root}/{table}")
        return rows.join(F.broadcast(live) if live.count() <= PARTS else live, ["run", "part"], "left_semi").select(*schema.names)

    def _write(self, table: str, df: DataFrame) -> DataFrame:
        """Writes rows with a column ``part``; their lines of the manifest."""
        run = uuid.uuid4().hex
        df.withColumn("run", F.lit(run)).hint("rebalance", "part").write.mode("append").partitionBy("run", "part").parquet(f"{self.root}/{table}")
        own = f"{self.root}/{table}/run={run}"
        if not exists(self.spark, own):  # no rows
            return self.spark.createDataFrame([], MANIFEST)
        found = self.spark.read.schema(T.StructType([*df.drop("part").schema, T.StructField("part", T.StringType())])).parquet(own)
        place = [F.first(c).alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in SLICE]
        return found.groupBy("part").agg(*place, F.count("*").alias("n")).select(F.lit(table).alias("table"), "part", *SLICE, F.lit(run).alias("run"), "n")

    def _switch(self, before: int, parts: DataFrame, facts: dict) -> int:
        made = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        parts.write.parquet(f"{made}/parts")
        self.spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(f"{made}/facts")
        to = f"{self.root}/manifest/v{before + 1:09d}"
        source, fs = self._path(made)
        target, _ = self._path(to)
        if fs.exists(target) or not fs.rename(source, target) or fs.exists(self._path(f"{to}/{source.getName()}")[0]):
            raise Conflict(f"version {before + 1} of {self.root} is there already")
        return before + 1

    def replace(self, tables: dict[str, DataFrame], slices: DataFrame, dim: int | None = None) -> int:
        """The slices (repo, branch; a null branch: all of the repo) of all given tables by their new rows, at once; a slice without new rows becomes empty. Returns the version.

        ``dim``: the dimension of vectors. Where another was stored, all slices of the given tables that aren't written now are dropped with it, as their vectors don't fit any more.
        """
        before = self.version()
        facts, old = self.facts(before), self.manifest(before)
        other = dim is not None and facts["dim"] not in (None, dim)
        new = None
        for name, df in tables.items():
            part = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SLICE])
            made = self._write(name, df.withColumn("part", part))
            new = made if new is None else new.unionByName(made)
            facts["schemas"][name] = df.schema.jsonValue()
        given = F.col("table").isin(*tables)
        kept = old.where(~given) if other else old.where(~given).unionByName(drop_slices(old.where(given), slices.select(*SLICE)).join(new.select("table", "part"), ["table", "part"], "left_anti"))
        return self._switch(before, kept.unionByName(new), facts | {"dim": dim if dim is not None else facts["dim"]})

    def merge(self, table: str, rows: DataFrame, key: list[str], new_wins: bool = True, buckets: int = 64) -> int:
        """Rows by key into a table that is kept in buckets of the key's hash: only buckets that get rows are read and rewritten. Of an old and a new row of one key the new one
        stays, or the old one (``new_wins`` off); new rows of equal keys should be one. ``buckets`` holds for a table's first merge."""
        before = self.version()
        facts, old = self.facts(before), self.manifest(before)
        buckets = facts["buckets"].setdefault(table, buckets)
        part = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")
        new = rows.withColumn("part", part)
        touched = new.select("part").distinct()
        if table in facts["schemas"]:
            schema = T.StructType.fromJson(facts["schemas"][table])
            live = old.where(F.col("table") == table).join(F.broadcast(touched), "part", "left_semi").select("run", "part")
            there = self.spark.read.schema(T.StructType([*schema, T.StructField("run", T.StringType()), T.StructField("part", T.StringType())])).parquet(f"{self.root}/{table}") if exists(self.spark, f"{self.root}/{table}") else None
            if there is not None:
                there = there.join(F.broadcast(live), ["run", "part"], "left_semi").drop("run").select(*rows.columns, "part")
                new = there.join(new.select(*key), key, "left_anti").unionByName(new) if new_wins else there.unionByName(new.join(there.select(*key), key, "left_anti"))
        facts["schemas"][table] = rows.schema.jsonValue()
        made = self._write(table, new)
        kept = old.where(F.col("table") != table).unionByName(old.where(F.col("table") == table).join(F.broadcast(touched), "part", "left_anti"))
        return self._switch(before, kept.unionByName(made), facts)

    def ensure_dim(self, dim: int, table: str = "chunks") -> bool:
        """Whether the vectors of ``table`` were dropped because the manifest names another dimension; no vector is read."""
        facts = self.facts()
        if facts["dim"] in (None, dim):
            return False
        self._switch(self.version(), self.manifest().where(F.col("table") != table), facts | {"dim": dim})
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last ``keep``, and runs that none of these names. Returns how many runs went. No write may run meanwhile."""
        last = self.version()
        live: set[tuple[str, str]] = set()
        for v in range(max(1, last - keep + 1), last + 1):
            live |= {(r["table"], r["run"]) for r in self.manifest(v).select("table", "run").distinct().collect()}  # one row a run
        for v in range(1, last - keep + 1):
            _remove(self.spark, f"{self.root}/manifest/v{v:09d}")
        gone = 0
        for table in self.facts()["schemas"] if last else ():
            p, fs = self._path(f"{self.root}/{table}")
            for s in fs.listStatus(p) if fs.exists(p) else ():
                name = s.getPath().getName()
                if name.startswith("run=") and (table, name[4:]) not in live:
                    _remove(self.spark, s.getPath().toString())
                    gone += 1
        return gone
