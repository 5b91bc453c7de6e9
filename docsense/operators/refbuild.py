"""Cross-references kept up to date: postings and pair sums in a folder, refreshed by what changed.

A version of the store is a folder with documents (doc, digest), postings (concept, doc, freq, importance) and pairs (`graph.pair_sums`);
the newest version whose documents are written, which is done last, is the current one. A refresh compares digests.
Postings and pairs of changed and removed documents go, and those of changed and new ones come: pairs among them, and of
them with the postings that stay. Nothing else is paired again, and without a change nothing is written. A refresh that fails
leaves the current version as it was and can be run again.

Documents are (doc, concept) rows, a row an occurrence. Null docs and concepts are left out; a document without concepts isn't
known to the store. Versions older than the one before the current are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsense.operators import graph
from docsense.operators.staging import staged


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the whole versions in a store, ascending."""
    fs, path = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit() and fs.exists(_fs(spark, f"{folder}/{x}/documents/_SUCCESS")[1]))


def postings(occurrences: DataFrame) -> DataFrame:
    """concept, doc, freq and importance (1 where the rows have none) of (doc, concept) rows."""
    held = occurrences if "importance" in occurrences.columns else occurrences.withColumn("importance", F.lit(1.0))
    return held.where("doc is not null and concept is not null").groupBy("concept", "doc").agg(F.count(F.lit(1)).alias("freq"), F.max("importance").alias("importance"))


def digests(posts: DataFrame) -> DataFrame:
    """doc and digest: a sum over the document's postings that no order changes."""
    one = F.xxhash64("concept", "freq", "importance").cast("decimal(20,0)")
    two = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("concept").cast("string"), "freq", "importance").cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return posts.groupBy("doc").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(one), F.sum(two)).alias("digest"))


def read(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """``documents``, ``postings`` or ``pairs`` of the current version."""
    return spark.read.parquet(f"{folder}/v{versions(spark, folder)[-1]}/{part}")


def _pairs(least: int) -> str:
    return "pairs" if least == 1 else f"pairs-{least}"


def refresh(spark: SparkSession, occurrences: DataFrame, folder: str, least: int = 1) -> dict[str, int]:
    """Bring the store to the given documents; how many were new, changed and removed.

    A store keeps pairs that share ``least`` concepts, 1 or 2, all its life; with 2 no others are made (`graph.strong_pair_sums`).
    """
    if least not in (1, 2):
        raise ValueError("least is 1 or 2")
    posts = staged(postings(occurrences), "reference-postings")
    now = staged(digests(posts), "reference-documents")
    numbers = versions(spark, folder)
    if numbers:
        was = read(spark, folder, "documents")
        both = now.join(was.withColumnRenamed("digest", "was"), "doc", "full_outer")
        kind = F.when(F.col("was").isNull(), "new").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("was"), "changed")
        moved = staged(both.select("doc", kind.alias("kind")).where("kind is not null"), "reference-changes")
    else:
        moved = now.select("doc", F.lit("new").alias("kind"))
    told = {"new": 0, "changed": 0, "removed": 0} | {r.kind: r.n for r in moved.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if numbers and not any(told.values()):
        return told
    target = f"{folder}/v{(numbers or [0])[-1] + 1}"
    if numbers:
        stays = read(spark, folder, "postings").join(moved, "doc", "left_anti")
        comes = posts.join(moved.where("kind <> 'removed'"), "doc", "left_semi")
        gone = lambda side: moved.select(F.col("doc").alias(side))
        kept = read(spark, folder, _pairs(least)).join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti")
        made = graph.pair_sums(comes).unionByName(graph.cross_sums(comes, stays)) if least == 1 else graph.strong_pair_sums(posts, among=moved)
        pairs = kept.unionByName(made)
    else:
        pairs = graph.pair_sums(posts) if least == 1 else graph.strong_pair_sums(posts)
    posts.write.mode("overwrite").parquet(f"{target}/postings")
    pairs.write.mode("overwrite").parquet(f"{target}/{_pairs(least)}")
    now.write.mode("overwrite").parquet(f"{target}/documents")
    for old in numbers[:-1]:
        fs, path = _fs(spark, f"{folder}/v{old}")
        fs.delete(path, True)
    return told


def relationships(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """source, target, shared and strength of the current version, both ways."""
    return graph.relationships(read(spark, folder, _pairs(least)))
