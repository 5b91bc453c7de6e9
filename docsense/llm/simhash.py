"""SimHash near-duplicates by multi-index hashing (operator 9).

A text is lower-cased (A-Z only), cut into words at ASCII white space and into shingles of four words, repeats
included. Each shingle votes with its XXH64 (seed 42); a fingerprint bit is set if it is set in over half the hashes.
Fewer than four words make one shingle of the whole sequence, no words (or null text) the fingerprint zero.

Fingerprints at most ``radius`` bits apart are linked. They are cut into ``segments`` parts; by the pigeonhole
principle two linked fingerprints differ in at most ``radius // segments`` bits of some part. Each distinct fingerprint
puts one row per part into the table and looks up the small Hamming ball around each part; every match is verified on
all 64 bits inside the join. Copies collapse into one distinct fingerprint before any lookup, so a hot group of copies
costs one row. Three segments of 21 or 22 bits cost 70 rows a distinct fingerprint at every size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import materialise
from docsense.llm.components import connected_components

SEED = 42
RADIUS = 4
SEGMENTS = 3
SHINGLE = 4
BITS = 64


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, in order and with repeats; none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as an unsigned number.

    Votes are counted in slices so that a very long text needs no large bit matrix.
    """
    votes = sum((np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 8192)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    return majority(shingle_hashes(text, words))


def _fingerprint_batches(batches):
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def parts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; the widths add up to 64."""
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ball(width: int, radius: int) -> list[int]:
    """Masks that flip at most ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def link(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``prints.fp`` that are at most ``radius`` bits apart."""
    probes_radius = radius // segments
    stored, sought = [], []
    for number, (shift, width) in enumerate(parts(segments)):
        value, tag = _segment(F.col("fp"), shift, width), number << 40
        stored.append(value.bitwiseOR(F.lit(tag)))
        sought += [value.bitwiseXOR(F.lit(mask | tag)) for mask in ball(width, probes_radius)]
    stored_rows = prints.select(F.col("fp").alias("b"), F.explode(F.array(*stored)).alias("key"))
    sought_rows = prints.select(F.col("fp").alias("a"), F.explode(F.array(*sought)).alias("key"))
    close = (sought_rows["a"] < stored_rows["b"]) & (F.bit_count(sought_rows["a"].bitwiseXOR(stored_rows["b"])) <= radius)
    return sought_rows.join(stored_rows.hint("shuffle_hash"), (sought_rows["key"] == stored_rows["key"]) & close).select("a", "b")


def groups(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """fp, first and root of the distinct fingerprints of ``prints`` (fp, doc_id): the smallest doc_id of the fingerprint,
    and the smallest reachable over links.

    Nodes are numbered by doc_id before they are contracted, so the root of a component carries the id that names it and
    no group ever meets in one task. A null doc_id counts as larger than any other.
    """
    last = F.lit((1 << 63) - 1)
    nodes = materialise(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), last).alias("first")), "nodes")
    pairs = link(nodes.select("fp"), radius, segments)
    head = lambda side: nodes.select(F.col("fp").alias(side), F.struct("first", "fp").alias(f"node_{side}"))
    edges = pairs.join(head("a"), "a").join(head("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = connected_components(edges).select(F.col("node.fp").alias("fp"), F.col("root.first").alias("root"))
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "first").alias("root"))
    return named.select("fp", F.nullif("first", last).alias("first"), F.nullif("root", last).alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of ``docs``.

    Only doc_id and text are read, so other columns may have any names. Repeated rows, ties and empty or null texts are
    ordinary rows: equal fingerprints belong together. A null doc_id takes part but names a group only if no other does.
    An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    # Written before the last join: with plain scans on both sides Spark can split the partition of a hot fingerprint.
    named = materialise(groups(prints, radius, segments).select("fp", F.col("root").alias("component_id")), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Ids of removed documents that are broadcast at most, some 64 MB; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id; columns unchanged.

    Near copies have five-word shingles with a Jaccard index of at least ``similarity``; see `resemblance` for how they
    are found from this operator's groups. Rows that share a doc_id are one document. A null doc_id is kept.
    """
    from docsense.llm.resemblance import near_copies

    extra = materialise(near_copies(docs, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_extra")).distinct(), "near-copies")
    few = extra.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(extra) if few else extra, docs["doc_id"] == extra["_extra"], "left_anti")
