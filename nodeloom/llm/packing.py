"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps.

Documents longer than a sequence are cut; each other piece, and each first piece, is placed by best fit. Pieces are
range-sorted by length: a piece's place is its rank among the pieces of its length, from counts by length and bucket. Lengths
are whole numbers up to ``capacity``, so the sorted pieces are that many runs of equal ones, and open sequences with
the same gap are runs of consecutive numbers: a sweep over the runs does at once what a sweep over the rows does. In a sweep
the longest pieces left find their successor, the smallest gap that takes them; where more pieces than gaps meet, ranks decide
and the rest go to the next gap or open new sequences; gaps shrink, and the next sweep begins. The sweeps give a table of
rules (length, ranks, first sequence, offset), from which every task places its own pieces. Its size depends on the number
of lengths, not on that of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm import arrow_words as A
from nodeloom.llm.scratch import light_batches, save
from nodeloom.llm.tokens import ByteEncoder, encoder, with_end
from nodeloom.llm.workers import trim

#: Tokens of a sequence, and pieces of one length that a task ranks at once.
CAPACITY, BUCKET = 2048, 1 << 12


def _pieces(path: str, capacity: int):
    def run(batches):
        words = encoder(ByteEncoder, path)
        for part in A.slices(batches):
            ids, offsets = with_end(*words.flat(part.column(1)), 0)
            sizes = np.diff(offsets)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            end = sizes[row] - (n[row] - 1 - piece) * capacity
            start = np.maximum(end - capacity, 0)
            data, base = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), offsets[row]
            checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((base + start).tolist(), (base + end).tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array(checks, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return run


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) of runs of pieces, longest pieces first."""
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs of (first sequence, sequences)
    open_gaps = np.zeros(capacity + 2, bool)
    rules, opened = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = int(open_gaps[length : capacity + 1].argmax()) + length
            if fits <= capacity and open_gaps[fits]:
                first, n = gaps[fits].pop()
                take = min(n, left)
                if take < n:
                    gaps[fits].append([first + take, n - take])
                open_gaps[fits] = bool(gaps[fits])
            else:
                # New sequences, for as many pieces as are left, each taking as many of them as it holds.
                fits, first, take = capacity, opened, -(-left // (capacity // length))
                opened += take
            rules.append((length, rank, take, first, capacity - fits))
            gap = fits - length
            rank, left = rank + take, left - take
            if gap:
                gaps[gap].append([first, take])
                open_gaps[gap] = True
    return rules


def _place(rules: list[tuple[int, int, int, int, int]]):
    def run(batches):
        table = np.array(rules, np.int64).reshape(-1, 5)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        # One sorted number for (length, rank): lengths are far under 2**15, ranks under 2**48.
        begin = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(begin, (length << 48) + rank, "right") - 1
            own = table[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    A document's ids end with a 0, so null and empty texts are pieces of length 1. Documents with over ``capacity`` ids are
    cut so that only their first piece is shorter. A sequence's pieces follow each other from offset 0 without gaps. Repeated
    rows are packed as often as they are there. Bytes of a text that are no UTF-8 count as U+FFFD. Other columns are ignored.
    """
    light_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    pieces = save(texts.mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    # At most a row for each length. A length has buckets of about BUCKET pieces, so the most common one is dealt over many.
    totals = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = docs.sparkSession.createDataFrame([(n, -(-m // BUCKET)) for n, m in totals.items()], "length long, buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("bucket", bucket).drop("buckets")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = save(counts.withColumn("before", before), "lengths")
    rules = sweep(totals, capacity)
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = pieces.withColumn("within", within).join(counts.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(rules), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
