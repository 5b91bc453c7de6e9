"""A tree of files kept in step: what is new, changed, touched or gone since the last run, by a stored manifest.

The manifest (path, modified, length, digest) is a folder of versions; the newest one written whole is current. A run lists the
tree without contents and compares time and length; only files that differ are read and digested in tasks. A file whose digest
is as before was only touched. What the run found is written before the manifest, so a run that fails is repeated whole, and
a run without changes writes nothing. Empty files aren't there, as for all of Spark's file readers: one that becomes empty is
removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsense.operators.staging import staged

SCHEMA = "path string, modified timestamp, length long, digest string"
#: Paths that are named to the reader at most; with more, the tree is read and joined with them.
NAMED = 10_000


def listing(spark: SparkSession, tree: str, pattern: str = "*") -> DataFrame:
    """path, modified and length of every file in the tree whose name matches; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(tree)
    return files.where("length > 0").select("path", F.col("modificationTime").alias("modified"), "length")


def contents(spark: SparkSession, tree: str, paths: DataFrame, pattern: str = "*") -> DataFrame:
    """path, modified, length, digest (SHA-256) and content of the files named in ``paths``."""
    source = spark.read.format("binaryFile")
    few = [r.path for r in paths.limit(NAMED + 1).collect()]
    if not few:
        return spark.createDataFrame([], f"{SCHEMA}, content binary")
    if len(few) <= NAMED:
        files = source.load([p.replace("{", "\\{").replace("*", "\\*").replace("?", "\\?").replace("[", "\\[") for p in few])
    else:
        files = source.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(tree).join(paths.select("path"), "path", "left_semi")
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("digest"), "content")


def _versions(spark: SparkSession, store: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    path = hadoop(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop(f"{store}/{n}/_SUCCESS")))


def current(spark: SparkSession, store: str) -> DataFrame:
    """The manifest of the last run that ended; empty before the first."""
    numbers = _versions(spark, store)
    return spark.read.schema(SCHEMA).parquet(f"{store}/v{numbers[-1]}") if numbers else spark.createDataFrame([], SCHEMA)


@dataclass
class Synced:
    """``changed``: path, action (new or changed), digest and content. ``counts``: files by action."""

    changed: DataFrame
    counts: dict[str, int]


def sync(spark: SparkSession, tree: str, store: str, pattern: str = "*") -> Synced:
    """Compare the tree with the manifest in ``store``, read what differs, and bring the manifest up to date.

    Files that were listed but are gone before they are read fail the run; it can be run again.
    """
    was = current(spark, store)
    listed = staged(listing(spark, tree, pattern), "manifest-listing")
    before = was.select("path", F.col("modified").alias("_modified"), F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    both = listed.join(before, "path", "left")
    same = F.coalesce((F.col("modified") == F.col("_modified")) & (F.col("length") == F.col("_length")), F.lit(False))
    read = staged(contents(spark, tree, both.where(~same).select("path"), pattern), "manifest-contents")
    action = F.when(F.col("_digest").isNull(), "new").when(F.col("digest") != F.col("_digest"), "changed").otherwise("touched")
    told = read.join(before.select("path", "_digest"), "path", "left").withColumn("action", action)
    gone = was.join(listed.select("path"), "path", "left_anti")
    counts = {"new": 0, "changed": 0, "touched": 0} | {r.action: r.n for r in told.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts |= {"removed": gone.count(), "unchanged": both.where(same).count()}
    if any(counts[k] for k in ("new", "changed", "touched", "removed")):
        kept = both.where(same).select("path", "modified", "length", F.col("_digest").alias("digest"))
        number = (_versions(spark, store) or [0])[-1] + 1
        kept.unionByName(read.select("path", "modified", "length", "digest")).write.mode("overwrite").parquet(f"{store}/v{number}")
    return Synced(told.where(F.col("action").isin("new", "changed")).select("path", "action", "digest", "content"), counts)
