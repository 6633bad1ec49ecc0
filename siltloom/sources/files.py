"""Repository files, catalogues and push events as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.functions.paths import in_mirror, is_sql

EVENT = T.StructType([
    T.StructField("delivery", T.StringType()), T.StructField("event", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("payload", T.StringType()),
])
PAYLOAD = "ref string, repository struct<full_name:string>, pusher struct<name:string>, action string, number bigint, pull_request struct<merged:boolean,base:struct<ref:string>,head:struct<ref:string>>, sender struct<login:string>"

from siltloom.sources.tables import stored


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root/org/name/branch/... with size and sha1; ``raw`` holds the bytes. Splits follow the file sizes."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace("path", r"^.*?" + escape(root.rstrip("/")) + "/", "")
    parts = F.split(inner, "/")
    return d.select(
        F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)).alias("repo"), F.get(parts, 2).alias("branch"), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/").alias("file_path"),
        F.sha1("content").alias("sha"), F.col("length").alias("size"), F.col("content").alias("raw"),
    )


def escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in text)


def with_text(files: DataFrame) -> DataFrame:
    """``content`` as UTF-8 text; bytes that aren't valid are replaced."""
    return files.withColumn("content", F.make_valid_utf8(F.col("raw").cast("string"))).drop("raw")


def non_blank(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").rlike(r"\S"))


def sql_files(files: DataFrame) -> DataFrame:
    return files.where(is_sql(F.col("file_path")))


def mirror_files(files: DataFrame) -> DataFrame:
    """The local mirror's listing, with forward slashes."""
    d = files.withColumn("file_path", F.replace("file_path", F.lit("\\"), F.lit("/")))
    return d.where(in_mirror(F.col("file_path")))


def fetch_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contents of the wanted (repo, branch, file_path); null where there is no such file."""
    return wanted.join(files.select("repo", "branch", "file_path", "content"), ["repo", "branch", "file_path"], "left")


def read_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """Catalogue rows of all installations, as JSON lines; rows aren't made distinct."""
    schema = "full_name string, name string, owner struct<login:string>, default_branch string, private boolean, html_url string, description string"
    return spark.read.schema(schema).json(list(paths))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of deliveries as JSON files."""
    return spark.readStream.schema(EVENT).json(path)


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


def content_store(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (repo, branch, file_path, content) as paths (repo, branch, file_path, h) and texts (h, content), each text once, both stored: equal files of branches and repos are read, scanned
    and chunked once. h is the text's SHA-256; files without content have no h."""
    hashed = files.withColumn("h", F.sha2("content", 256))
    paths = stored(hashed.drop("content"))
    return paths, stored(hashed.where("h is not null").groupBy("h").agg(F.first("content").alias("content")))
