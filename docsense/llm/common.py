"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the fingerprint and token-count rules: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docsense-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a folder of our own in local mode (one machine, as in tests); on a cluster an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = _own_dir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsense/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table_ in tables:
        spark = table_.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table_.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_remainder(doc_id, modulus) == F.lit(remainder), F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """``label`` and ``text`` of at most ``bound`` rows: labelled documents outside the held-out fold.

    Several labels of one document count as their mean, rounded half up; of several texts that share an id the smallest
    is taken, so the bound holds for rows and not only for ids. The sample is the ``bound`` ids of smallest hash and so
    depends on neither file nor partition order. The chosen ids are a broadcast of at most ``bound`` rows.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("label", "text")
