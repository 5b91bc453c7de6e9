"""The prefix trie of conversations by sorted sequences and their common prefixes (operator 13).

A turn is a digest of its role and text, a conversation the sequence of its turns' digests, equal conversations one sequence
with a count. The distinct sequences are range-partitioned and sorted; ``lcp[i]`` is the number of turns that sequence i has
in common with the one before it. Sequence i is the first to hold its prefixes of more than ``lcp[i]`` turns: these are the
trie's nodes. Over a sparse table of range minima of ``lcp`` every such prefix searches the right end of its members by
halving steps, and the first node of each sequence the left end of its parent, each by itself and without a stack. All else
are sums and range minima over the interval: with P(i, k) the words in the first k turns of sequence i, T(i) those in all
and m(i) its count, the words saved below a node of depth d with members L..R are
``sum((m - 1) T, L..R) + sum(P(i, lcp[i]), L+1..R) - (sum(m, L..R) - 1) P(L, d - 1)``.

Intervals may run over any number of partitions, so one common first turn is no single task. A partition tells its totals
and, for each depth up to what it has in common with its predecessor, the sums over its leading rows; nodes that leave
their partition search a second sparse table, over the minima of whole partitions, and add both. Only that table (a row a
partition) is collected.

Texts are read once and never shuffled. A conversation is one row of some 40 bytes a turn; sums over equal conversations
stream their ids through one task, as a digest of all of them in order demands. Turns are ordered by turn, null first, ties
by the digest of role and text; null role and text are empty; repeated rows are turns of their own; rows of null conv_id
belong to no conversation; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsense.llm.common import WORD_PATTERN, materialise

#: Characters of a turn's digest in a path.
WIDTH = 32
NONE_SHA = hashlib.sha256(b"").hexdigest()


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, at (place in the conversation, from 1), digest (of role and text) and words (of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.select("conv_id", F.row_number().over(order).alias("at"), "digest", "words")


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, path (the digests in order) and words (of each turn) of every conversation in ``ids``; ``turns`` are
    conv_id, at, digest and words, ordered by at."""
    told = turns.select("conv_id", F.struct("at", "digest", "words").alias("said"))
    none = ids.select("conv_id", F.lit(None).cast(told.schema["said"].dataType).alias("said"))
    rows = told.unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return rows.select("conv_id", F.array_join(F.transform("said", lambda t: t["digest"]), "").alias("path"), F.transform("said", lambda t: t["words"]).alias("words"))


def _ends(batches):
    """key, n, first and sha of every run of rows with one key, whose conv_ids ascend; memory holds one batch."""
    now, digest, n, first, out = None, None, 0, None, []

    def rows():
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "first", "sha"])

    for batch in batches:
        for key, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, n, first, digest.hexdigest()))
                now, digest, n, first = key, hashlib.sha256(), 0, conv_id
            digest.update(f",{conv_id}".encode() if n else str(conv_id).encode())
            n += 1
        yield rows()
    if now is not None:
        out.append((now, n, first, digest.hexdigest()))
    yield rows()


def common_turns(a: str | None, b: str | None) -> int:
    """The number of turns with which both paths begin; -1 if there is no such path."""
    if a is None or b is None:
        return -1
    m = min(len(a), len(b))
    x, y = np.frombuffer(a.encode(), np.uint8)[:m], np.frombuffer(b.encode(), np.uint8)[:m]
    different = x != y
    at = int(different.argmax()) if m else 0
    return (at if m and different[at] else m) // WIDTH


class Minima:
    """A sparse table of range minima; row k holds the minimum of 2**k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.int64)]
        while 2 << len(self.rows) - 1 <= len(values):
            half, last = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of values[low..high], ends included."""
        power = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k, row in enumerate(self.rows):
            own = power == k
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k) + 1])
        return out

    def rightmost(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place r >= start with values[start + 1..r] all at ``least`` or more."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, room = self.rows[k], at + 1 + (1 << k) <= len(self.rows[0])
            step = np.flatnonzero(room)
            at[step] += (row[at[step] + 1] >= least[step]) << k
        return at

    def leftmost(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place l <= start with values[l + 1..start] all at ``least`` or more."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            step = np.flatnonzero(at >= 1 << k)
            at[step] -= (row[at[step] - (1 << k) + 1] >= least[step]) << k
        return at


NODE, LEADING, WHOLE = 0, 1, 2
#: How a node's parent is known: here, by its partition's right or left neighbour, or there is none.
HERE, RIGHT, LEFT, ROOT = 0, 1, 2, 3
SCAN = "kind int, pid int, at long, depth long, n long, first long, leaves long, saved long, base long, open boolean, side int, parent long, kids long, ends string"
_NAMES = [x.split()[0] for x in SCAN.split(", ")]
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _table(**columns) -> pa.RecordBatch:
    size = max(len(v) for v in columns.values() if isinstance(v, (np.ndarray, list, pa.Array)))
    held = [columns[c] if c in columns else None for c in _NAMES]
    arrays = [pa.nulls(size, k) if v is None else pa.array(np.full(size, v), k) if isinstance(v, int) else pa.array(v, k) for v, k in zip(held, _KINDS)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def scan(pid: int, rows: list[dict], before: str | None, after: str | None) -> list[pa.RecordBatch]:
    """Nodes, leading sums and totals of one partition: ``rows`` of distinct sequences in order, and the paths beside them."""
    paths, size = [r["path"] for r in rows], len(rows)
    m, first = (np.array([r[c] for r in rows], np.int64) for c in ("n", "first"))
    length = np.array([len(p) // WIDTH for p in paths], np.int64)
    lcp = np.array([common_turns(a, b) for a, b in zip([before, *paths], paths)], np.int64)
    beyond = common_turns(paths[-1], after)
    words = _sums(np.fromiter((w for r in rows for w in r["words"]), np.int64))
    start = _sums(length)[:-1]
    total, shared = words[start + length] - words[start], words[start + np.maximum(lcp, 0)] - words[start]
    c_m, c_extra, c_shared, c_leaf = (_sums(x) for x in (m, (m - 1) * total, shared, np.append(lcp[1:], beyond) < length))
    lcps, firsts = Minima(lcp), Minima(first)

    count = length - lcp
    offset = _sums(count)[:-1]
    row = np.repeat(np.arange(size), count)
    depth = np.arange(len(row)) - offset[row] + lcp[row] + 1
    right = lcps.rightmost(row, depth)
    is_open = (right == size - 1) & (beyond >= depth)
    least = firsts.over(row, right)

    parent = np.arange(len(row)) - 1
    heads = np.flatnonzero(depth == lcp[row] + 1)
    left = lcps.leftmost(row[heads], depth[heads] - 1)
    parent[heads] = offset[left] + depth[heads] - 1 - (lcp[left] + 1)
    outside = (left == 0) & (lcp[0] >= depth[heads] - 1)
    side = np.full(len(row), HERE)
    side[heads[outside]] = LEFT
    side[depth == 0] = ROOT
    held = side == HERE
    kids = np.bincount(parent[held], minlength=len(row))
    side[held] = np.where(is_open[parent[held]], RIGHT, HERE)
    known = side == HERE
    named = pa.array(np.where(known, least[np.where(known, parent, 0)], 0), mask=~known)

    full = depth == length[row]
    ends = pa.array([r["sha"] for r in rows]).take(pa.array(row, mask=~full))
    saved = c_extra[right + 1] - c_extra[row] + c_shared[right + 1] - c_shared[row + 1]
    base = np.where(depth > 0, words[start[row] + np.maximum(depth - 1, 0)] - words[start[row]], 0)
    out = [_table(kind=NODE, pid=pid, at=row, depth=depth, n=c_m[right + 1] - c_m[row], first=least, leaves=c_leaf[right + 1] - c_leaf[row], saved=saved, base=base, open=is_open, side=side, parent=named, kids=kids, ends=ends)]
    if before is not None:
        deep = np.arange(lcp[0] + 1)
        till = (np.minimum.accumulate(lcp)[None, :] >= deep[:, None]).sum(1) if size * len(deep) < 1 << 22 else np.array([int((np.minimum.accumulate(lcp) >= d).sum()) for d in deep])
        out.append(_table(kind=LEADING, pid=pid, depth=deep, n=c_m[till], first=np.minimum.accumulate(first)[till - 1], leaves=c_leaf[till], saved=c_extra[till] + c_shared[till]))
    out.append(_table(kind=WHOLE, pid=pid, depth=[int(lcp.min())], n=[int(c_m[-1])], first=[int(first.min())], leaves=[int(c_leaf[-1])], saved=[int(c_extra[-1] + c_shared[-1])]))
    return out


def _scan_batches(batches):
    held: list[dict] = []

    def flush():
        own = [r for r in held if r["n"]]
        marks = [r["path"] for r in held if not r["n"]]
        before = next((p for p in marks if p < own[0]["path"]), None)
        after = next((p for p in marks if p > own[0]["path"]), None)
        found = scan(held[0]["pid"], own, before, after)
        held.clear()
        return found

    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["pid"] != r["pid"]:
                yield from flush()
            held.append(r)
    if held:
        yield from flush()


def _resolver(whole: list):
    """For nodes that leave their partition: the sums over the whole partitions that follow and the one in which they end."""
    pids, depth, n, first, leaves, saved = (np.array([r[c] for r in whole], np.int64) for c in ("pid", "depth", "n", "first", "leaves", "saved"))
    schema = "pid int, at long, depth long, n long, first long, leaves long, saved long, base long, side int, kids long, ends string, ended int, crossed array<int>"

    def resolve(frames):
        table, firsts, sums = Minima(depth), Minima(first), [_sums(x) for x in (n, leaves, saved)]
        for frame in frames:
            own = np.searchsorted(pids, frame["pid"].to_numpy(np.int64))
            last = table.rightmost(own, frame["depth"].to_numpy(np.int64))
            for name, c in zip(("n", "leaves", "saved"), sums):
                frame[name] += c[last + 1] - c[own + 1]
            some = last > own
            least = frame["first"].to_numpy(np.int64).copy()
            least[some] = np.minimum(least[some], firsts.over(own[some] + 1, last[some]))
            frame["first"] = least
            frame["ended"] = np.where(last + 1 < len(pids), pids[np.minimum(last + 1, len(pids) - 1)], -1)
            frame["crossed"] = [pids[a : b + 1].tolist() for a, b in zip(own, last)]
            yield frame[[x.split()[0] for x in schema.split(", ")]]

    return resolve, schema


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie over ``paths`` (conv_id, path and words of `sequences`), with the columns ``RESULT``."""
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialise(paths.withColumn("key", F.md5("path")), "trie-paths")
    groups = keyed.select("key", "conv_id").repartition(parts, "key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key string, n long, first long, sha string")
    distinct = keyed.join(groups.select("n", "first", "sha"), keyed["conv_id"] == F.col("first")).select("path", "words", "n", "first", "sha")
    ranged = materialise(distinct.repartitionByRange(parts, "path").withColumn("pid", F.spark_partition_id()), "trie-sorted")

    edges = ranged.groupBy("pid").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    beside = Window.orderBy("pid")  # a row a partition
    near = edges.select("pid", F.array(F.lag("high").over(beside), F.lead("low").over(beside)).alias("near"))
    marks = near.select("pid", F.explode("near").alias("path")).where("path is not null")
    rows = ranged.unionByName(marks.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    found = materialise(rows.repartitionById(parts, "pid").sortWithinPartitions("pid", "path").mapInArrow(_scan_batches, SCAN), "trie-scan")

    whole = found.where(F.col("kind") == WHOLE).orderBy("pid").collect()
    if not whole:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    inner = found.where(F.col("kind") == NODE)
    leading = found.where(F.col("kind") == LEADING).select(F.col("pid").alias("ended"), "depth", *[F.col(c).alias(f"_{c}") for c in ("n", "first", "leaves", "saved")])
    resolve, schema = _resolver(whole)
    reached = inner.where("open").select("pid", "at", "depth", "n", "first", "leaves", "saved", "base", "side", "kids", "ends").mapInPandas(resolve, schema)
    more = reached.join(leading, ["ended", "depth"], "left")
    plus = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in ("n", "leaves", "saved")}
    across = F.when(F.col("_n").isNotNull(), F.array_append("crossed", F.col("ended"))).otherwise(F.col("crossed"))
    spans = materialise(more.withColumns(plus | {"first": F.least("first", "_first"), "crossed": across}).drop("ended", "_n", "_first", "_leaves", "_saved"), "trie-spans")

    # Where a node that spans partitions is the parent: at a partition's left or right edge there is one of each depth.
    at_left, at_right = F.slice("crossed", F.lit(2), F.size("crossed")), F.slice("crossed", F.lit(1), F.size("crossed") - 1)
    of = [F.struct(F.col("pid").alias("pid"), "at").alias("of"), F.col("depth").alias("up"), F.col("first").alias("named")]
    doors = spans.select(*of, F.lit(LEFT).alias("side"), F.explode(at_left).alias("door")).unionByName(spans.select(*of, F.lit(RIGHT).alias("side"), F.explode(at_right).alias("door")))
    columns = ["pid", "at", "depth", "n", "first", "leaves", "saved", "base", "side", "kids", "ends"]
    rest = inner.where(~F.col("open")).select(*columns, "parent", F.lit(False).alias("spanning")).unionByName(spans.select(*columns, F.lit(None).cast("long").alias("parent"), F.lit(True).alias("spanning")))
    linked = rest.where(F.col("side").isin(LEFT, RIGHT)).join(doors.withColumnRenamed("side", "_side"), (F.col("pid") == F.col("door")) & (F.col("side") == F.col("_side")) & (F.col("depth") - 1 == F.col("up")))
    linked = materialise(linked.select(*columns, F.col("named").alias("parent"), "spanning", "of", "up"), "trie-linked")
    settled = rest.where(F.col("side").isin(HERE, ROOT)).select(*columns, "parent", "spanning").unionByName(linked.select(*columns, "parent", "spanning"))
    extra = linked.where(F.col("side") == LEFT).groupBy(F.col("of.pid").alias("pid"), F.col("of.at").alias("at"), F.col("up").alias("depth")).agg(F.count(F.lit(1)).alias("more"))
    grown = settled.where("spanning").join(extra, ["pid", "at", "depth"], "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    every = settled.where(~F.col("spanning")).unionByName(grown)
    return every.select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("base")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations in ``turns`` (conv_id, turn, role, text)."""
    said = materialise(placed(turns), "trie-turns")
    return nodes(sequences(said, said.select("conv_id").distinct()))


def rebuilt(said: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Sequences of conversations that begin with turns of another: of conversation c the first h = crc32(c) % ``heads`` turns
    become those of conversation c - c % ``every``, as far as there are any. ``said`` are turns of `placed`."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    ids = materialise(said.select("conv_id").distinct(), "trie-ids")
    own = said.where(F.col("at") > head(F.col("conv_id")))
    lent = said.where((F.col("conv_id") % every == 0) & (F.col("at") < heads)).withColumnRenamed("conv_id", "lender")
    borrowers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("lender"), head(F.col("conv_id")).alias("h"))
    begun = borrowers.join(lent, "lender").where(F.col("at") <= F.col("h"))
    return sequences(own.unionByName(begun.select("conv_id", "at", "digest", "words")), ids)
