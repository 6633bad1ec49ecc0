"""Stored tables: replacing, dropping and merging the slice of a repo and branch."""

from __future__ import annotations

import tempfile
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from siltloom.operators.graph import Links

SLICE = ["repo", "branch"]


def drop_slices(table: DataFrame, slices: DataFrame) -> DataFrame:
    """``table`` without the slices (repo, branch); a null branch stands for all branches."""
    s = slices.select(F.col("repo").alias("__r"), F.col("branch").alias("__b")).distinct()
    return table.join(s, (F.col("repo") == F.col("__r")) & (F.col("__b").isNull() | (F.col("branch") == F.col("__b"))), "left_anti")


def _own_folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or f'{tempfile.gettempdir()}/siltloom').rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; where that is unset in local mode below the temporary folder, on a cluster an error."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` wrote in this application; results that weren't written or read yet can't be read any more."""
    _remove(spark, _own_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder once, and read back: for what is costly and used several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_slice(df: DataFrame, path: str, slices: DataFrame | None = None) -> None:
    """Write ``df`` over its slices of the Parquet table at ``path``, which is partitioned by repo and branch; other slices stay.

    ``slices`` lists what is replaced, so that a slice without new rows becomes empty: dynamic overwriting alone would keep its old rows. Rows are
    rebalanced by slice: adaptive execution splits a large slice over several tasks by its bytes, and joins small ones.
    """
    spark = df.sparkSession
    df.hint("rebalance", *SLICE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SLICE).parquet(path)
    if slices is not None:
        gone = slices.select(*SLICE).distinct().join(df.select(*SLICE).distinct(), SLICE, "left_anti")
        for r in gone.toLocalIterator():  # one row a slice to clear, not data
            _remove(spark, f"{path}/repo={_escaped(r['repo'])}" + (f"/branch={_escaped(r['branch'])}" if r["branch"] is not None else ""))


def _escaped(value: str) -> str:
    """The value as it stands in a partition folder's name."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear_graph(nodes: DataFrame, edges: DataFrame | Links, slices: DataFrame) -> tuple[DataFrame, DataFrame | Links, DataFrame]:
    """Nodes and edges without the slices' nodes and whatever touches them, and a row with the number of nodes deleted.

    Edges may be resolved ones or links by name, whose two parts lose these nodes without being multiplied out.
    """
    kept = drop_slices(nodes, slices)
    gone = nodes.join(kept.select("id"), "id", "left_anti")
    if not isinstance(edges, DataFrame):
        return kept, edges.without(gone), gone.agg(F.count("*").alias("n_deleted"))
    ids = gone.select(F.col("id").alias("__id"))
    rest = edges.join(ids, F.col("src_id") == F.col("__id"), "left_anti").join(ids, F.col("dst_id") == F.col("__id"), "left_anti")
    return kept, rest, gone.agg(F.count("*").alias("n_deleted"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id; a new one overwrites all attributes."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by source, type and destination; the old one's properties stay."""
    key = ["src_id", "rel_type", "dst_id"]
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def ensure_vectors(spark: SparkSession, path: str, dim: int, schema: str) -> bool:
    """Make sure that the vector table at ``path`` exists and holds vectors of ``dim`` numbers; else start it anew, empty. Whether it was (re)made."""
    if exists(spark, path):
        found = spark.read.parquet(path)
        if "embedding" in found.columns and found.where(F.size("embedding") != dim).isEmpty():
            return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return True
