"""Near copies: SimHash links, completed by minima of shingle sets, every link verified exactly.

Two texts are near copies if the Jaccard index of their sets of five-word shingles is at least 0.8. Words are those of the
fingerprint rule (`simhash`); fewer than five words make one shingle, texts without words are copies of each other.

Operator 9 comes first, with fingerprints of five-word shingles: each text is compared with the first of those whose
fingerprints its own is linked with. A pair at 0.8 differs in about nine of 64 bits, though, and Hamming balls that wide
would fetch a fixed share of the whole table. So candidates also share one of ``BANDS`` keys, each a digest of ``ROWS``
minima of random hashes over the set; a pair of index J shares none with probability (1 - J**ROWS)**BANDS, 3e-6 at 0.8.

Candidates are verified on the whole sets of shingles, but only while they can still join two components: first each text
with the smallest text it meets, then the pairs of a key that are still apart. Of these only pairs leave the join that an
exact bound lets pass: two sets have no more in common than the lesser of their counts in each of ``PARTS`` parts of the
hash range, counting only shingles that some other candidate has. In a large group of copies of one text, whose members each
differ from it in places of their own, hardly a pair passes that isn't a link. The components are those of all links among
the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.llm import simhash
from docsense.llm.common import discard, materialise
from docsense.llm.components import connected_components

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 32, 5
SEED = 42
#: Pairs of one text that meet in one task.
HUB = 64
#: Parts of the hash range in which shingles are counted for the bound.
PARTS = 32
#: Texts whose shingles a task holds at once.
SLICE = 512
#: Shingles of hubs that are broadcast at most, some 48 MB; more are joined by shuffles.
BROADCAST_GRAMS = 6_000_000

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def bands(grams: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    low = grams.astype(np.uint32)
    for i in range(0, len(low), 512):
        mixed = low[i : i + 512, None] ^ _MASKS
        mixed *= _FACTORS
        np.minimum(least, mixed.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _slices(batches):
    """Batches of at most ``SLICE`` rows, so that memory holds the shingles of a few texts and not of a whole batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def _signed_batches(batches):
    for batch in _slices(batches):
        hashes = [simhash.shingle_hashes(x, WORDS) for x in batch.column("text").to_pylist()]
        grams = [np.unique(h) for h in hashes]
        prints = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(map(len, grams), pa.int64()), pa.array(prints), pa.array([bands(g) for g in grams], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "fp", "bands"])


def _shingle_batches(batches):
    for batch in _slices(batches):
        grams = [np.unique(simhash.shingle_hashes(x, WORDS)) for x in batch.column("text").to_pylist()]
        counts = [np.bincount((g % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for g in grams]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["key", "grams", "counts"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b: the pairs (spoke, hub) of nodes whose sets have at least ``similarity``.

    The sets of hubs are a broadcast if they are small together, else the set of a hub in many pairs is dealt over tasks.
    """
    sought = pairs.select("hub").distinct()
    of_hubs = materialise(sets.join(sought, sets["key"] == sought["hub.key"]).select("hub", F.col("grams").alias("h")), "hub-sets")
    if (of_hubs.agg(F.sum(F.size("h"))).first()[0] or 0) <= BROADCAST_GRAMS:
        both = pairs.join(sets.select(F.col("key").alias("own"), F.col("grams").alias("s")), F.col("spoke.key") == F.col("own")).join(F.broadcast(of_hubs), "hub")
        return _alike(both, similarity)
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("parts")).alias("part"))
    hubs = parts.join(sets, parts["hub.key"] == sets["key"]).select("hub", F.col("grams").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(hubs, ["hub", "part"]).join(sets.select(F.col("key").alias("own"), F.col("grams").alias("s")), F.col("spoke.key") == F.col("own"))
    return _alike(both, similarity)


def _alike(both: DataFrame, similarity: float) -> DataFrame:
    sized = both.select("spoke", "hub", F.size("s").alias("ns"), F.size("h").alias("nh"), F.size(F.array_intersect("s", "h")).alias("common"))
    alike = (F.col("common") >= similarity * (F.col("ns") + F.col("nh") - F.col("common")))
    return sized.where(alike).select(F.col("spoke").alias("a"), F.col("hub").alias("b"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable over links) of every row of ``docs`` with a doc_id.

    Only doc_id and text are read. Equal texts (by 64-bit hash) are one node.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    signed = materialise(texts.mapInArrow(_signed_batches, "doc_id long, key long, n long, fp long, bands array<long>"), "signed")
    named = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    nodes = materialise(named.select("key", F.struct("first", "key").alias("node"), "n", "fp"), "copy-nodes")
    sized = F.struct("node", "n")

    # Every text with the first text among those whose fingerprints are linked with its own.
    heads = materialise(nodes.groupBy("fp").agg(F.min(sized).alias("head")), "copy-heads")
    near = simhash.link(heads.select("fp"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = both.join(heads.select(F.col("fp").alias("b"), "head"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("head").alias("near"))
    hubs = heads.join(firsts, "fp", "left").select("fp", F.least("head", "near").alias("hub"))
    pairs = nodes.join(hubs, "fp").select(sized.alias("spoke"), "hub")

    # Keys that two texts at least share.
    members = materialise(signed.select("key", F.explode("bands").alias("band")).distinct().join(nodes.select("key", "node", "n"), "key").select("band", sized.alias("own")), "band-members")
    tops = members.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
    met = materialise(members.join(tops.select("band", "low"), "band"), "band-met")
    pairs = pairs.unionByName(met.groupBy(F.col("own").alias("spoke")).agg(F.min("low").alias("hub")))
    wanted = met.select("own.node.key").unionByName(pairs.where("spoke <> hub").select("spoke.node.key")).unionByName(pairs.where("spoke <> hub").select("hub.node.key")).distinct()
    sets = materialise(texts.join(materialise(wanted, "wanted"), "key", "left_semi").dropDuplicates(["key"]).mapInArrow(_shingle_batches, "key long, grams array<long>, counts array<long>"), "shingles")

    # What each text can have in common with another: its shingles less those that no other candidate has, by part.
    rare = sets.select("key", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key")).where("c = 1")
    own = rare.groupBy("key", F.pmod(F.col("gram"), F.lit(PARTS)).alias("part")).agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("own"))
    less = F.transform("counts", lambda c, i: c - F.coalesce(F.try_element_at("own", i.cast("long")), F.lit(0).cast("long")))
    parts = sets.select("key", F.size("grams").alias("n"), "counts").join(own, "key", "left").select("key", "n", F.when(F.col("own").isNull(), F.col("counts")).otherwise(less).alias("parts"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, c: t + c)
    bounds = materialise(parts.select("key", "n", total(F.col("parts")).alias("shared"), "parts"), "bounds")

    def enough(a: str, b: str, common: Column) -> Column:
        return common >= similarity * (F.col(f"{a}n") + F.col(f"{b}n") - common)

    def links_of(found: DataFrame, name: str) -> DataFrame:
        """The links among pairs (spoke, hub) of nodes."""
        kept = found.where(F.col("spoke") != F.col("hub")).distinct()
        return materialise(verified(materialise(kept, f"{name}-pairs"), sets, similarity), f"{name}-links")

    bound = lambda side: bounds.select(F.col("key").alias(f"{side}_key"), F.col("n").alias(f"{side}_n"), F.col("shared").alias(f"{side}_shared"))
    could = pairs.select(F.col("spoke.node").alias("spoke"), F.col("hub.node").alias("hub")).where(F.col("spoke") != F.col("hub")).distinct()
    could = could.join(bound("a"), F.col("spoke.key") == F.col("a_key")).join(bound("b"), F.col("hub.key") == F.col("b_key")).where(enough("a_", "b_", F.least("a_shared", "b_shared")))
    links = links_of(could.select("spoke", "hub"), "first")
    roots = materialise(connected_components(links), "roots")

    # Rows of keys whose texts are in several components, without texts that can't have a near copy.
    alone = bounds.where(F.col("shared") < similarity * F.col("n")).select("key")
    open_rows = met.select("band", "own.node").join(alone, F.col("node.key") == alone["key"], "left_anti").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = materialise(open_rows.select("band", "node", F.coalesce("root", "node").alias("root")), "band-roots")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    apart = placed.join(mixed, "band").join(bounds, F.col("node.key") == bounds["key"]).select("band", "node", "root", "n", "shared", "parts")
    apart = materialise(apart, "band-apart")
    discard(placed)
    if not apart.isEmpty():
        a, b = (apart.select("band", F.struct("node", "root", "n", "shared", "parts").alias(side)) for side in "ab")
        # Spelled out part by part, since compiled code is much faster here than a function over arrays.
        common = sum((F.least(F.col("a.parts")[i], F.col("b.parts")[i]) for i in range(PARTS)), F.lit(0).cast("long"))
        two = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & enough("a.", "b.", F.least("a.shared", "b.shared")) & enough("a.", "b.", common)
        rest = a.join(b, "band").where(two).select(F.col("a.node").alias("spoke"), F.col("b.node").alias("hub"))
        roots = connected_components(links.unionByName(links_of(rest, "rest")))
    roots = roots.select(F.col("node.key").alias("key"), F.col("root.first").alias("root"))
    found = materialise(nodes.join(roots, "key", "left").select("key", F.coalesce("root", F.col("node.first")).alias("component_id")), "copy-components")
    return signed.select("doc_id", "key").join(found, "key").select("doc_id", "component_id")
