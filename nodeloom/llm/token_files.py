"""Token ids in files: canonical, length-limited Huffman codes in independent blocks.

One code, from the counts of all ids, serves all files. A file is a Parquet file without compression whose rows are blocks of
consecutive documents, in ascending order; a block has

* ``first``: the number of ids before it in its file; ``docs``, ``sizes``: its documents and their numbers of ids;
* ``n``: its ids; ``bits``: their codes, first bit highest, in big-endian 64-bit words;
* ``stops``: the bit offset of every STEP-th id, where decoding can begin.

The code is canonical: the lengths alone, 0 for unused ids, give it. They are a file of their own beside the blocks. Decoding
looks up the next MAX_BITS bits in a table of (id, length), at all stops of a block at once.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm import arrow_words as A
from nodeloom.llm.scratch import light_batches, new_path, partitions, save
from nodeloom.llm.tokens import WordEncoder, encoder, with_end
from nodeloom.llm.workers import trim

MAX_BITS, STEP, BLOCK = 20, 128, 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal code of at most ``limit`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for this limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    plain = _huffman(weights)
    if plain.max() <= limit:
        out[order] = plain
        return out
    # Each level merges the symbols with the pairs of the level before; ``from_symbols`` marks, in order, which are which.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * (len(weights) - 1), np.zeros(len(weights), np.int64)
    for from_symbols in reversed(levels):
        symbols = int(from_symbols[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


def _huffman(weights: np.ndarray) -> np.ndarray:
    """Unlimited lengths of sorted weights."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    parent = np.zeros(2 * n - 1, np.int64)
    for new in range(n, 2 * n - 1):
        a, i = heapq.heappop(heap)
        b, j = heapq.heappop(heap)
        parent[i] = parent[j] = new
        heapq.heappush(heap, (a + b, new))
    depth = np.zeros(2 * n - 1, np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[:n]


class Code:
    """The canonical code of some lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        n = self.lengths[order]
        begin = np.concatenate([[0], np.cumsum(np.int64(1) << (self.limit - n))])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin[:-1] >> (self.limit - n)).astype(np.uint64)
        # An entry is an id and, in its lowest five bits, its length. A code of one symbol leaves half of the table unused.
        self.table = np.ones(1 << self.limit, np.uint64)
        self.table[: begin[-1]] = np.repeat(order.astype(np.uint64) << np.uint64(5) | n.astype(np.uint64), np.int64(1) << (self.limit - n))
        self.table = self.table.astype(np.uint32) if len(lengths) < 1 << 27 else self.table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, stops)"""
        n = self.lengths[ids]
        end = np.cumsum(n)
        begin = end - n
        total = int(end[-1]) if len(end) else 0
        words = np.zeros((total >> 6) + 2, np.uint64)
        code, at = self.codes[ids], begin >> 6
        room = 64 - (begin & 63) - n
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] |= np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(room < 0)  # at most one code passes into each word
            words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), begin[::STEP]

    def decode(self, bits: bytes, stops: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u8").astype(np.uint64)
        out, at = np.zeros((STEP, len(stops)), np.uint32), stops.astype(np.int64)
        full = len(stops) - 1
        for i in range(STEP):
            if full >= 0 and full * STEP + i >= n:  # the last stretch is shorter
                at = at[:full]
                if not len(at):
                    break
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            ahead = words[word] << shift | (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift)
            entry = self.table[(ahead >> np.uint64(64 - self.limit)).astype(np.int64)]
            out[i, : len(at)] = entry >> 5
            at = at + (entry & 31)
        return out.T.ravel()[:n]


def id_kind(size: int) -> str:
    """How the ids of a vocabulary of this size are packed between steps."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(path: str, end: int, kind: str):
    """Rows with the packed ids of their text in place of it."""

    def run(batches):
        words = encoder(WordEncoder, path)
        for part in A.slices(batches):
            ids, offsets = with_end(*words.flat(part.column(1)), end)
            yield pa.RecordBatch.from_arrays([part.column(0), A.packed_column(ids.astype(kind), offsets)], ["doc_id", "ids"])
        trim()

    return run


def _count(size: int, kind: str):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(A.packed_values(batch.column(0), kind)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return run


_BLOCKS = "file int, first long, docs binary, sizes binary, n long, bits binary, stops binary"


def _blocks(lengths: np.ndarray, kind: str):
    """Blocks of documents that follow each other in a file, each of BLOCK ids and the rest of its last document."""

    def run(batches):
        code = Code(lengths)
        file, first, docs, sizes, ids, held = -1, 0, [], [], [], 0

        def flush():
            bits, stops = code.encode(np.concatenate(ids).astype(np.int64))
            return pa.RecordBatch.from_pylist([{"file": file, "first": first, "docs": np.concatenate(docs).tobytes(), "sizes": np.concatenate(sizes).tobytes(), "n": held, "bits": bits, "stops": stops.astype(np.int64).tobytes()}], _SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = A.packed_values(batch.column(1), kind)
            own, n = batch.column(0).fill_null(_NULL).to_numpy(), np.diff(offsets)
            file, at = batch.column(2)[0].as_py(), 0
            while at < len(own):
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK - held))
                to = min(max(to, at + 1), len(own))
                docs.append(own[at:to])
                sizes.append(n[at:to])
                ids.append(values[offsets[at] : offsets[to]])
                held, at = held + len(ids[-1]), to
                if held >= BLOCK:
                    yield flush()
                    first, docs, sizes, ids, held = first + held, [], [], [], 0
        if held:
            yield flush()

    return run


_NULL = -(2**63)
_SCHEMA = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("bits", pa.binary()), ("stops", pa.binary())])


def write(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1) -> None:
    """Write the ids of every text, each with ``end`` after it, to ``path``/blocks and the code to ``path``/code.

    Files are in ascending order of the ids of documents: a null id first, equal ids by their contents. Null and empty texts have
    the one id ``end``. Bytes of a text that are no UTF-8 count as U+FFFD.
    """
    spark = docs.sparkSession
    light_batches(spark)
    size = encoder(WordEncoder, vocabulary).tokenizer.get_vocab_size()
    kind = id_kind(max(size, end + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    ids = save(rows.mapInArrow(_ids(vocabulary, end, kind), "doc_id long, ids binary"), "ids", "zstd")
    size = max(size, end + 1)
    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(_count(size, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    # A file is a range of ids; where one id has very many rows they are parted by their contents.
    order = ["doc_id", F.xxhash64("ids")]
    ordered = ids.repartitionByRange(max(partitions(spark), 1), *order).sortWithinPartitions(*order).withColumn("file", F.spark_partition_id())
    ordered.mapInArrow(_blocks(lengths, kind), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(lengths: np.ndarray, checks: bool):
    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for b in batch.to_pylist():
                ids = code.decode(b["bits"], np.frombuffer(b["stops"], np.int64), b["n"]).astype("<u4")
                docs, sizes = np.frombuffer(b["docs"], np.int64), np.frombuffer(b["sizes"], np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d if d != _NULL else None for d in docs.tolist()], pa.int64()), pa.array(b["first"] + b["before"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64()) if checks else pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if checks else "ids"],
                )

    return run


def read(spark: SparkSession, path: str, checks: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the ids as little-endian unsigned 32-bit integers; start counts the ids of all documents before.

    With ``checks``, ids_crc32 of these bytes in place of the ids.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first().lengths, np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # A row for each file.
    sizes = blocks.groupBy("file").agg(F.sum("n").alias("ids"))
    before = sizes.withColumn("before", F.coalesce(F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("ids")
    return blocks.join(F.broadcast(before), "file").mapInArrow(_read(lengths, checks), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if checks else "ids binary"))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files that are written and read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, vocabulary, path)
    return read(spark, path, checks=True)
