"""Readers of document trees (JSON, YAML, Markdown), file filters, and sinks of document tables.

All readers list files with Spark and parse them in tasks; a file is one row, so its size is bounded by what the file
filter admits (1 MiB unless told otherwise).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20
#: Fields of a document record, all text but for tags.
FIELDS = "id string, title string, category string, description string, version string, content string, tags array<string>"
RESERVED = ("con", "prn", "aux", "nul")


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_json(spark: SparkSession, path: str, skip: Sequence[str] = ("manifest", "index")) -> DataFrame:
    """Document records of JSON files that hold one record or a list under ``standards``; one row for each record.

    Files named in ``skip`` are left out; unreadable files give no row. A record without an id gets the file's name.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("name", stem(F.input_file_name())).where(~F.col("name").isin(*skip))
    record = F.from_json("value", f"standards array<struct<{_struct(FIELDS)}>>, {FIELDS}")
    parsed = files.select("name", record.alias("r")).where("r IS NOT NULL")
    one = F.struct(*[F.col(f"r.{x.split()[0]}") for x in FIELDS.split(", ")])
    rows = parsed.select("name", F.explode(F.when(F.col("r.standards").isNotNull(), F.col("r.standards")).otherwise(F.array(one))).alias("d"))
    return _named(rows)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Document records of YAML files: one record, a list under ``standards``, or records nested in its sections.

    Needs PyYAML on the executors. Unreadable files give no row.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for name, value in zip(batch["name"], batch["value"]):
                try:
                    loaded = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                out += [(name, json.dumps({k: r[k] for k in names if r.get(k) is not None}, default=str)) for r in records(loaded)]
            yield pd.DataFrame(out, columns=["name", "record"])

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.y*ml").withColumn("name", stem(F.input_file_name()))
    rows = files.select("name", "value").mapInPandas(parse, "name string, record string")
    return _named(rows.select("name", F.from_json("record", FIELDS).alias("d")))


def records(loaded: object) -> list[dict]:
    """Records within a loaded file: the file itself, or every mapping in lists called ``standards`` at any depth."""
    if not isinstance(loaded, dict):
        return []
    if "standards" not in loaded:
        return [loaded]
    found, open_nodes = [], [loaded["standards"]]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, list):
            found += [r for r in node if isinstance(r, dict)]
        elif isinstance(node, dict):
            open_nodes += list(node.values())
    return found


def read_markdown(spark: SparkSession, path: str, indexed: DataFrame | None = None) -> DataFrame:
    """Markdown files as documents ``doc:<name>`` with the first heading as title; ids in ``indexed`` are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    docs = files.select(F.concat(F.lit("doc:"), stem(F.input_file_name())).alias("id"), F.regexp_extract("value", r"(?m)^#[ \t]+([^\n]+)", 1).alias("title"), F.col("value").alias("content"))
    return docs if indexed is None else docs.join(indexed.select("id"), "id", "left_anti")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ddl.split(", ")))


def _named(rows: DataFrame) -> DataFrame:
    rest = [F.col(f"d.{x.split()[0]}") for x in FIELDS.split(", ")[1:]]
    return rows.select(F.coalesce("d.id", "name").alias("id"), *rest)


def glob_pattern(glob: str) -> str:
    """Regular expression of a file glob with ``*``, ``**`` and ``?``."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", glob)) + "$"


def path_safe(path: Column) -> Column:
    """Relative, without control characters, back slashes, parent or hidden parts; null is not safe."""
    parts = F.split(path, "/")
    bad = path.rlike(r"[\x00-\x1f\\]") | path.startswith("/") | path.rlike(r"^[A-Za-z]:") | F.exists(parts, lambda x: x.startswith(".") | (x == ""))
    return F.coalesce(~bad, F.lit(False))


def admitted(path: Column, size: Column, include: Sequence[str], exclude: Sequence[str], max_bytes: int = MAX_BYTES) -> Column:
    """Whether a listed file is synchronised: safe, not reserved, included, not excluded and small enough."""
    name = F.lower(stem(path))
    matches = lambda globs: F.coalesce(*[F.when(path.rlike(glob_pattern(g)), True) for g in globs], F.lit(False))
    return path_safe(path) & ~name.isin(*RESERVED) & matches(include) & ~matches(exclude) & F.coalesce(size <= max_bytes, F.lit(False))


def write_index(docs: DataFrame, path: str) -> None:
    """Documents and metadata as JSON lines, one file per task."""
    docs.write.mode("overwrite").json(path)


def markdown_lines(docs: DataFrame) -> DataFrame:
    """One Markdown text for each document, for a text sink."""
    return docs.select(F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "id")), "description", "content").alias("value"))
