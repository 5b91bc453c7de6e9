"""Token sequences in a keyed global order, in fixed-stride binary shards (operator 8).

Each text is tokenised whole, followed by the end token, and cut into sequences of ``SEQUENCE`` token ids (little-endian
uint16 if the vocabulary allows it, else uint32), the last one padded with the end token. Documents are range-partitioned
and sorted by doc_id and text digest before they are tokenised, and the sequences are written once: a sequence's index,
its file's offset plus its row number there, is its rank by (doc_id, text digest, part), whatever the number of files and
tasks, so the order can be made again on any cluster. A Feistel network with cycle walking, keyed by the seed, maps the
indexes 0..N-1 onto the slots 0..N-1. Slot ranges are partitions, in slot order; ``write_shards`` turns them into binary
files in which sequence ``slot`` starts at byte ``(slot % rows) * stride``.

A null or empty text is one sequence with nothing but the end token. Repeated rows are sequences of their own; doc_id may
be null. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsense.llm.common import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEQUENCE = 512
SHARD_ROWS = 8192
ROUNDS = 6
SEED = 2024
#: Tokeniser's split rule, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def dtype_for(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary < 1 << 16 else "<u4")


def sequences(text: str | None, path: str, length: int) -> tuple[list[int], list[bytes]]:
    """Token counts (end token included) and unpadded bytes of the sequences of one text."""
    encoding, end = tokenizer(path)
    kind = dtype_for(end)
    ids = np.array(encoding.encode_ordinary(text or "") + [end], kind).tobytes()
    step = length * kind.itemsize
    cut = [ids[i : i + step] for i in range(0, len(ids), step)]
    return [len(x) // kind.itemsize for x in cut], cut


def tokenised(docs: DataFrame, path: str = TOKENIZER, length: int = SEQUENCE) -> DataFrame:
    """doc_id, part (from 0), n_tokens and tokens (unpadded) of every sequence."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for low in range(0, len(texts), 512):
                rows = [sequences(x, path, length) for x in texts[low : low + 512]]
                of = pa.array([low + i for i, (n, _) in enumerate(rows) for _ in n], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(of), pa.array([j for n, _ in rows for j in range(len(n))], pa.int64()), pa.array([k for n, _ in rows for k in n], pa.int32()), pa.array([b for _, x in rows for b in x], pa.binary())],
                    names=["doc_id", "part", "n_tokens", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, part long, n_tokens int, tokens binary")


def _round(half: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    mixed = half + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % (1 << 64))
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))) & mask


def _network(values: np.ndarray, bits: int, key: int, numbers) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & mask
    for number in numbers:
        left, right = right, left ^ _round(right, key, number, mask)
    return right << np.uint64(bits) | left  # halves swapped, so that the reversed keys undo it


def _walk(values: np.ndarray, n: int, key: int, numbers) -> np.ndarray:
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = np.asarray(values, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], bits, key, numbers)
        todo = todo[out[todo] >= np.uint64(n)]
    return out


def permute(index: np.ndarray, n: int, key: int = SEED) -> np.ndarray:
    """Slots of the indexes 0..n-1: a bijection chosen by ``key``."""
    return _walk(index, n, key, range(ROUNDS))


def unpermute(slot: np.ndarray, n: int, key: int = SEED) -> np.ndarray:
    """The indexes of slots."""
    return _walk(slot, n, key, range(ROUNDS - 1, -1, -1))


def training_order(docs: DataFrame, path: str = TOKENIZER, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, key: int = SEED, partitions: int = 10_000) -> DataFrame:
    """slot, shard, row, doc_id, part, n_tokens and tokens (padded to the stride), range-partitioned and sorted by slot."""
    # The last key parts equal rows, of which one document may have any number; their order changes nothing.
    texts = docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("copy"))
    table = materialise(tokenised(texts.repartitionByRange("doc_id", "digest", "copy").sortWithinPartitions("doc_id", "digest"), path, length), "tokens")
    rows = table.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("held"))
    bases = materialise(files.select("file", (F.sum("held").over(Window.orderBy("file")) - F.col("held")).alias("base"), F.sum("held").over(Window.partitionBy()).alias("n")), "token-files")
    n = bases.agg(F.max("n")).first()[0] or 0
    end = tokenizer(path)[1]
    kind = dtype_for(end)
    stride = length * kind.itemsize

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(np.uint64), n, key).astype(np.int64))

    shards = max(1, -(-n // shard_rows))
    parts = min(shards, partitions)
    slotted = rows.join(bases.select("file", "base"), "file").select(slot_of(F.col("base") + F.col("at")).alias("slot"), "doc_id", "part", "n_tokens", "tokens")
    with_shard = slotted.select("slot", F.expr(f"slot div {shard_rows}").alias("shard"), (F.col("slot") % shard_rows).alias("row"), "doc_id", "part", "n_tokens", "tokens")
    ranged = with_shard.repartitionById(parts, F.expr(f"int(shard * {parts} div {shards})")).sortWithinPartitions("slot")
    padding = F.lit(np.full(length, end, kind).tobytes())
    return ranged.withColumn("tokens", F.substring(F.concat("tokens", padding), 1, stride))


SHARD_SCHEMA = "shard long, path string, rows long, bytes long, crc32 long"


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write each shard of ``training_order`` to ``folder`` (a URI that every executor reaches) and return their manifest.

    A shard is written under a name of its own and renamed when whole, so a repeated or speculative task does no harm
    and a present file is a finished one.
    """

    def write(batches):
        import os

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        current, held, done = None, [], []

        def close():
            if current is not None:
                body = b"".join(held)
                final = f"{root}/shard-{current:08d}.bin"
                scratch = f"{final}.{os.urandom(8).hex()}"
                with store.open_output_stream(scratch) as out:
                    out.write(body)
                store.move(scratch, final)
                done.append((current, final, len(held), len(body), zlib.crc32(body)))

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist()):
                if shard != current:
                    close()
                    current, held = shard, []
                held.append(tokens)
        close()
        columns = list(zip(*done)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "path", "rows", "bytes", "crc32"])

    return ordered.select("shard", "tokens").mapInArrow(write, SHARD_SCHEMA)


def read_slots(folder: str, start: int, count: int, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, kind: str = "<u2") -> np.ndarray:
    """Sequences start..start+count-1 of written shards, one row each: how a training run resumes at any slot."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride, out = length * np.dtype(kind).itemsize, []
    while count > 0:
        shard, row = divmod(start, shard_rows)
        take = min(count, shard_rows - row)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(row * stride)
            body = file.read(take * stride)
        if not body:
            break
        out.append(np.frombuffer(body, kind).reshape(-1, length))
        got = len(body) // stride
        start, count = start + got, count - got
        if got < take:
            break
    return np.concatenate(out) if out else np.empty((0, length), kind)
