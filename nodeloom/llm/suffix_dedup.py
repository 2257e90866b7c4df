"""Repeated passages, from common-prefix interval trees over enhanced suffix arrays.

A string of ``length`` bytes that starts at two places has, at both, the same least hash among its inner ``GRAM``-byte
windows: its anchor. So the suffixes are dealt out by anchor, and equal strings meet. The work is in four steps:

1. every text gives its anchors and, for the run of starts that share one, a hash of the bytes of the run's strings; packed
   arrays of these are counted in hash buckets. A run with the same bytes elsewhere repeats as a whole; an anchor with unlike
   runs is open;
2. each open anchor sends its unlike runs, once each, to a bucket. There prefix doubling sorts the suffixes, longest common
   prefixes follow, and a stack scan visits the tree's intervals of ``length`` bytes and more;
3. an interval whose suffixes have unlike bytes on their left, or start a run, is a maximal repeat: it goes out with all its
   occurrences;
4. texts get the union of their occurrences.

Step 3 gives what step 4 needs and no more. ``maximal_repeats`` goes on from there: of the starts of repeated strings only those
whose occurrences have unlike bytes on their left begin a maximal repeat, so these are dealt by their string, with all
occurrences and the bytes up to the end of the repeated span, and each string's suffixes are sorted and scanned.

Texts that are equal as a whole are found by a 128-bit hash and worked on once. An anchor with more unlike runs than
``SUFFIXES`` allows is decided by 128-bit hashes of its strings instead, which are dealt by the string and so meet in no one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm import hashing as H
from nodeloom.llm.scratch import light_batches, partitions, save
from nodeloom.llm.workers import free, trim

#: Bytes of the inner windows, texts' bytes worked on at once, rows of a bucket, and the most unlike runs of an anchor that one suffix array takes.
GRAM, PIECE, BUCKET, SUFFIXES = 100, 1 << 19, 1 << 20, 1 << 14
FULL, OPEN, HOT, MIXED = 1, 2, 4, 8
_RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("at", "<u4"), ("back", "u1"), ("more", "u1")])


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, bytes, rows' offsets in them): whole small texts together, long texts in overlapping parts."""
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] > PIECE:
            for a in range(int(offsets[row]), int(offsets[row + 1]) - length + 1, PIECE):
                b = min(a + PIECE + length - 1, int(offsets[row + 1]))
                yield row, a, data[a:b], np.array([0, b - a])
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield row, int(offsets[row]), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _sums(data: np.ndarray, table: np.ndarray = H.BYTES) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * H.powers(H.BASE, len(data)), out=out[1:])
    return out


#: Values of bytes in a second hash, independent of the first.
_OTHER = np.random.default_rng(99).permutation(H.BYTES) ^ np.uint64(0x5851F42D4C957F2C) | np.uint64(1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all rows, with the row of each: ``at`` is the anchor's place in its row, the run's starts are ``at - back`` and ``more`` further."""
    rows, out = [], []
    for row, a, part, cuts in _pieces(data, offsets, length):
        if len(part) < length:
            continue
        sums, inverse = _sums(part), H.powers(H.INVERSE, len(part))
        grams = H.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(part) - GRAM + 1])
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams & ~np.uint64(0xFFFFFF)) | place, length - GRAM + 1)
        which = np.searchsorted(cuts, np.arange(len(least)), "right") - 1
        fits = np.arange(len(least)) + length <= cuts[which + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(least)) - 1
        first, last = first[fits[first]], last[fits[first]]
        anchor = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        run = np.zeros(len(first), _RUN)
        run["key"] = grams[anchor]
        run["content"] = H.mix((sums[last + length] - sums[first]) * inverse[first] + (anchor - first).astype(np.uint64) * np.uint64(H.BASE))
        run["at"] = anchor + a - offsets[row + which[first]]
        run["back"], run["more"] = anchor - first, last - first
        rows.append(row + which[first])
        out.append(run)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _RUN)
    return np.concatenate(rows), np.concatenate(out)


def _packed(bucket: np.ndarray, owner: np.ndarray, prints: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: prints of the owners, how many values each has, the values."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner, values = bucket[order], owner[order], values[order]
    cuts, out = np.flatnonzero(np.diff(bucket, prepend=-1)), ([], [], [], [])
    for a, b in zip(cuts, [*cuts[1:], len(values)]):
        who, n = np.unique(owner[a:b], return_counts=True)
        for column, value in zip(out, (int(bucket[a]), prints[who].tobytes(), n.astype(np.uint32).tobytes(), values[a:b].tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "prints", "counts", "vals"])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((H.mix(keys + np.uint64(1)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _unseen(batches, size: int = 500):
    """Parts of the batches without rows whose (f1, f2) the task has met."""
    seen = set()
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            take = []
            for i, p in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                if p not in seen:
                    seen.add(p)
                    take.append(i)
            if take:
                yield part.take(pa.array(take))


def _prints(part) -> np.ndarray:
    return np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1).astype(np.int64)


def _deal(length: int, buckets: int):
    def run(batches):
        free()
        prints, owners, runs, rows, held = [], [], [], 0, 0
        for part in _unseen(batches):
            owner, some = _runs(*H.text_bytes(part.column(2)), length)
            prints.append(_prints(part))
            owners.append(owner + rows)
            runs.append(some)
            rows += part.num_rows
            held += len(some)
            if held >= BUCKET:
                yield _packed(_bucket((r := np.concatenate(runs))["key"], buckets), np.concatenate(owners), np.concatenate(prints), r)
                prints, owners, runs, rows, held = [], [], [], 0, 0
        if held:
            yield _packed(_bucket((r := np.concatenate(runs))["key"], buckets), np.concatenate(owners), np.concatenate(prints), r)
        trim()

    return run


def _unpacked(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prints = np.frombuffer(b"".join(table["prints"].to_pylist()), np.int64).reshape(-1, 2)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
    sets, which = np.unique(prints, axis=0, return_inverse=True)
    return sets, np.repeat(which.ravel(), counts), np.frombuffer(b"".join(table["vals"].to_pylist()), kind)


def _by_owner(sets: np.ndarray, owner: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return pa.table(
        {
            "f1": pa.array(sets[owner[cuts], 0], pa.int64()),
            "f2": pa.array(sets[owner[cuts], 1], pa.int64()),
            "vals": pa.array([values[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(values)])], pa.binary()),
        }
    )


_FLAGGED = np.dtype([("key", "<u8"), ("content", "<u8"), ("start", "<u4"), ("back", "u1"), ("more", "u1"), ("flags", "u1")])


def _flag(most: int):
    """Of one bucket of anchors: the runs that repeat as a whole, and those that a suffix array has to compare; of anchors with over ``most`` unlike ones, strings."""

    def run(table: pa.Table) -> pa.Table:
        sets, owner, runs = _unpacked(table, _RUN)
        order = np.lexsort((runs["at"] - runs["back"], owner, runs["content"], runs["key"]))
        owner, runs = owner[order], runs[order]
        same = np.zeros(len(runs), bool)
        same[1:] = (runs[1:] == runs[:-1]) & (owner[1:] == owner[:-1])
        owner, runs = owner[~same], runs[~same]
        new_key = np.concatenate([[True], runs["key"][1:] != runs["key"][:-1]])
        new_run = new_key | np.concatenate([[True], runs["content"][1:] != runs["content"][:-1]])
        in_run = np.bincount(np.cumsum(new_run) - 1)[np.cumsum(new_run) - 1]
        unlike = np.bincount(np.cumsum(new_key) - 1, weights=new_run)[np.cumsum(new_key) - 1]
        flags = np.where(in_run > 1, FULL, 0) | np.where((unlike > 1) & new_run, np.where(unlike > most, HOT, OPEN), 0) | np.where(unlike > 1, MIXED, 0)
        take = flags > 0
        out = np.zeros(int(take.sum()), _FLAGGED)
        for name in ("key", "content", "back", "more"):
            out[name] = runs[name][take]
        out["start"], out["flags"] = runs["at"][take] - runs["back"][take], flags[take]
        return _by_owner(sets, owner[take], out)

    return run


def _send(length: int, buckets: int):
    """The bytes of open runs, by the anchor's bucket."""

    def run(batches):
        keys, prints, starts, mores, strings, held = [], [], [], [], [], 0

        def flush():
            bucket = _bucket(np.array(keys, np.uint64), buckets)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(starts, pa.int64()), pa.array(mores, pa.int32()), pa.array(strings, pa.binary())],
                ["bucket", "f1", "f2", "start", "more", "string"],
            )

        for part in _unseen(batches):
            data, offsets = H.text_bytes(part.column(2))
            for p, a, packed in zip(_prints(part).tolist(), offsets, part.column(3).to_pylist()):
                for x in np.frombuffer(b"".join(packed), _FLAGGED):
                    if x["flags"] & OPEN:
                        keys.append(x["key"])
                        prints.append(p)
                        starts.append(int(x["start"]))
                        mores.append(int(x["more"]))
                        strings.append(data[a + x["start"] : a + x["start"] + x["more"] + length].tobytes())
                        held += 1
            if held >= 1 << 14:
                yield flush()
                keys, prints, starts, mores, strings, held = [], [], [], [], [], 0
        if held:
            yield flush()

    return run


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _scan(suffix: np.ndarray, common: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats of ``least`` bytes and more, over suffixes in order.

    ``common[i]`` is the longest common prefix of suffixes i-1 and i; ``left[i]`` the byte left of suffix i, negative and
    different for each suffix that nothing can extend.
    """
    stack: list[list[int]] = []  # length, first, left byte or None when there are several
    for i in range(1, len(suffix) + 1):
        c = int(common[i]) if i < len(suffix) else 0
        c = c if c >= least else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > c:
            size, first, mixed = stack.pop()
            byte = mixed if mixed == byte else None
            if byte is None:
                yield size, first, i - 1
        if c:
            if stack and stack[-1][0] == c:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
            else:
                stack.append([c, first, byte])


_REPEAT = np.dtype([("group", "<i8"), ("start", "<u4"), ("size", "<u4")])


def repeats_of(strings: list[bytes], mores: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, string numbers, places in them) of each maximal repeat that starts at places 0 .. more of the strings."""
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(s + bytes(8) for s in strings) + bytes(256), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    n = len(data) - 256
    inside = np.zeros(n, bool)
    owner = np.repeat(np.arange(len(strings)), sizes + 8)
    inside[np.arange(n) - begin[owner] < sizes[owner]] = True
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | data[j : j + n].astype(np.uint64)
    rank, width = _ranks(eight), 8
    shifted = lambda r, by: np.concatenate([r[by:], np.zeros(by, np.int64)]) if by < len(r) else np.zeros(len(r), np.int64)
    while 2 * width <= length:
        rank = _ranks(rank, shifted(rank, width))
        width *= 2
    starts = np.repeat(begin, mores + 1) + np.arange(int((mores + 1).sum())) - np.repeat(np.cumsum(mores + 1) - mores - 1, mores + 1)
    tail = shifted(rank, length - width)[starts]
    deep = _ranks(rank[starts], tail)
    often = np.bincount(deep)[deep] > 1
    starts, deep = starts[often], deep[often]
    if not len(starts):
        return
    end = begin[owner[starts]] + sizes[owner[starts]]
    over = shifted(rank, length)[starts]
    order = np.lexsort((over, deep))
    starts, deep, end = starts[order], deep[order], end[order]
    common = np.zeros(len(starts), np.int64)
    a, b = starts[:-1], starts[1:]
    room = np.minimum(end[:-1] - a, end[1:] - b)
    alike = deep[1:] == deep[:-1]
    size = np.where(alike, length, 0)
    going = np.flatnonzero(alike)
    while len(going):
        x, y = a[going] + size[going], b[going] + size[going]
        more = (size[going] < room[going]) & (data[x] == data[y])
        size[going[more]] += 1
        going = going[more]
    common[1:] = size
    at = starts - begin[owner[starts]]
    left = np.where(at > 0, data[starts - 1].astype(np.int64), -1 - np.arange(len(starts)))
    for long, first, last in _scan(starts, common, left.tolist(), length):
        yield long, owner[starts[first : last + 1]], at[first : last + 1]


def _suffix_arrays(length: int):
    def run(table: pa.Table) -> pa.Table:
        prints, strings = np.stack([table["f1"].to_numpy(), table["f2"].to_numpy()], axis=1), table["string"].to_pylist()
        start, mores = table["start"].to_numpy(), table["more"].to_numpy().astype(np.int64)
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, _REPEAT)]
        for size, which, places in repeats_of(strings, mores, length):
            one = np.zeros(len(which), _REPEAT)
            text = strings[which[0]][places[0] : places[0] + size]
            one["group"] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            one["start"], one["size"] = start[which] + places, size
            owners.append(which)
            found.append(one)
        sets, which = np.unique(prints, axis=0, return_inverse=True)
        out = _by_owner(sets, which.ravel()[np.concatenate(owners)], np.concatenate(found))
        del owners, found, strings
        trim()
        return out

    return run


_STRING = np.dtype([("key", "<u8"), ("check", "<u8"), ("start", "<u4")])


def _strings(length: int, buckets: int):
    """Hashes of the strings of runs of hot anchors, two of 64 bits."""

    def run(batches):
        for part in _unseen(batches):
            data, offsets = H.text_bytes(part.column(2))
            owners, out = [], []
            for i, packed in enumerate(part.column(3).to_pylist()):
                for x in np.frombuffer(b"".join(packed), _FLAGGED):
                    if x["flags"] & HOT:
                        text = data[offsets[i] + x["start"] : offsets[i] + x["start"] + x["more"] + length]
                        one = np.zeros(int(x["more"]) + 1, _STRING)
                        for name, table in (("key", H.BYTES), ("check", _OTHER)):
                            sums = _sums(text, table)
                            one[name] = H.mix((sums[length:] - sums[:-length]) * H.powers(H.INVERSE, len(one)))
                        one["start"] = x["start"] + np.arange(len(one))
                        owners.append(np.full(len(one), i))
                        out.append(one)
            if out:
                values = np.concatenate(out)
                yield _packed(_bucket(values["key"], buckets), np.concatenate(owners), _prints(part), values)

    return run


def _equal_strings(length: int):
    def run(table: pa.Table) -> pa.Table:
        sets, owner, values = _unpacked(table, _STRING)
        which = _ranks(values["key"], values["check"])
        take = np.bincount(which)[which] > 1
        out = np.zeros(int(take.sum()), _REPEAT)
        out["group"], out["start"], out["size"] = values["key"][take].astype(np.int64), values["start"][take], length
        return _by_owner(sets, owner[take], out)

    return run


def spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end bytes of the union; runs that touch are one."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    a = starts[order].astype(np.int64)
    b = np.maximum.accumulate(a + sizes[order].astype(np.int64))
    new = np.concatenate([[True], a[1:] > b[:-1]])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:] - 1, len(a) - 1)]


def _spans_of(flagged: list[bytes] | None, found: list[bytes] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    runs = np.frombuffer(b"".join(flagged or []), _FLAGGED)
    runs = runs[(runs["flags"] & FULL) > 0]
    more = np.frombuffer(b"".join(found or []), _REPEAT)
    return spans(np.concatenate([runs["start"], more["start"]]), np.concatenate([runs["more"].astype(np.int64) + length, more["size"]]))


def _cut(length: int):
    """Each row's removed spans, from whole copies, whole runs and maximal repeats."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = H.text_bytes(part.column(1))
                rows = []
                for i, (copies, flagged, found) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))):
                    text = data[offsets[i] : offsets[i + 1]]
                    if (copies or 1) > 1:
                        a, b = (np.array([0]), np.array([len(text)])) if len(text) >= length else spans(np.zeros(0), np.zeros(0))
                    else:
                        a, b = _spans_of(flagged, found, length)
                    kept = np.ones(len(text), bool)
                    for x, y in zip(a, b):
                        kept[x:y] = False
                    left = text[kept].tobytes()
                    rows.append((len(text), len(text) - len(left), len(a), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.string())],
                    ["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text in place of the text.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes which covers it starts at another place too, in the same
    or any other text; strings do not cross texts. n_spans counts the longest runs of removed bytes; kept_sha256 is of the
    bytes that are left, kept_text these as text, without halves of a character that a cut has parted.

    A null text counts as an empty one; nothing is removed from texts under ``length`` bytes. Repeated rows are copies of each
    other and lose all bytes if they are long enough. Other columns pass through; one named like an output goes.
    """
    return _removal(docs, text_col, length)[0]


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(group, doc_id, start, size): every maximal repeat of ``length`` bytes and more, with all its occurrences.

    A group is a string, that no occurrence of can be made longer on either side and stay equal to all others; ``group`` is its
    64-bit hash. Rows of equal texts are occurrences each. Groups lie within each other, so a text of one character over and
    over has as many rows as half its length squared. One task takes all occurrences of a string of ``length`` bytes.
    """
    _, joined, found, buckets = _removal(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", length)
    owned = "f1 long, f2 long, vals binary"
    some = joined.where("flagged is not null or copies > 1").select("f1", "f2", "text", "copies", "flagged")
    starts = some.mapInArrow(_starts(length, buckets), "bucket int, prints binary, counts binary, vals binary").groupBy("bucket").applyInArrow(_begin, owned)
    starts = starts.groupBy("f1", "f2").agg(F.collect_list("vals").alias("starts"))
    per_text = found.groupBy("f1", "f2").agg(F.collect_list("vals").alias("found"))
    strings = some.join(starts, ["f1", "f2"]).join(per_text, ["f1", "f2"], "left").select("f1", "f2", "text", "copies", "flagged", "found", "starts")
    strings = strings.mapInArrow(_extend(length, buckets), "bucket int, f1 long, f2 long, key long, start long, left int, many boolean, string binary")
    whole = save(strings.groupBy("bucket").applyInArrow(_trees(length), owned), "maximal")
    unpacked = whole.mapInArrow(_listed, "f1 long, f2 long, group long, start long, size long")
    return joined.select("rest.doc_id", "f1", "f2").join(unpacked, ["f1", "f2"]).select("group", "doc_id", "start", "size")


#: A start of a repeated string: the string's hash, the byte on its left or -1, whether other rows have the same text.
_START = np.dtype([("key", "<u8"), ("start", "<u4"), ("left", "<i2"), ("many", "u1")])


def _starts(length: int, buckets: int):
    """Starts at which a maximal repeat may begin.

    Where all runs of an anchor are alike, only their first starts may: the others have the same byte on the left everywhere.
    """

    def run(batches):
        for part in _unseen(batches):
            data, offsets = H.text_bytes(part.column(2))
            owners, out = [], []
            for i, (copies, packed) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                text, many = data[offsets[i] : offsets[i + 1]], (copies or 1) > 1
                places = [(int(x["start"]), int(x["more"]) if x["flags"] & MIXED else 0) for x in np.frombuffer(b"".join(packed or []), _FLAGGED)]
                for at, more in [*places, *([(0, 0)] if many else [])]:
                    sums = _sums(text[at : at + more + length])
                    one = np.zeros(more + 1, _START)
                    one["key"] = H.mix((sums[length:] - sums[:-length]) * H.powers(H.INVERSE, len(one)))
                    one["start"], one["many"] = at + np.arange(more + 1), many
                    one["left"] = text[at - 1 : at + more] if at else np.concatenate([[-1], text[:more].astype(np.int16)])
                    owners.append(np.full(more + 1, i))
                    out.append(one)
            if out:
                values = np.concatenate(out)
                yield _packed(_bucket(values["key"], buckets), np.concatenate(owners), _prints(part), values)

    return run


def _begin(table: pa.Table) -> pa.Table:
    """Of one bucket of strings: the starts of those that are there twice or more, with unlike bytes on their left."""
    sets, owner, values = _unpacked(table, _START)
    order = np.lexsort((values["start"], owner, values["left"], values["key"]))
    owner, values = owner[order], values[order]
    key, left = values["key"], values["left"]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values, key, left = owner[new], values[new], key[new], left[new]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    which = np.cumsum(new_key) - 1
    n = np.bincount(which, weights=1 + values["many"])
    lefts = np.bincount(which, weights=new_key | np.concatenate([[True], left[1:] != left[:-1]]))
    take = ((n > 1) & ((lefts > 1) | (np.bincount(which, weights=left < 0) > 0)))[which]
    return _by_owner(sets, owner[take], values[take])


def _extend(length: int, buckets: int):
    """The starts with their bytes up to the end of the repeated span, beyond which no repeat goes."""
    names = ["bucket", "f1", "f2", "key", "start", "left", "many", "string"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        out, held = [], 0
        for part in _unseen(batches):
            data, offsets = H.text_bytes(part.column(2))
            for i, (p, copies, flagged, found, packed) in enumerate(zip(_prints(part).tolist(), *(part.column(c).to_pylist() for c in (3, 4, 5, 6)))):
                text = data[offsets[i] : offsets[i + 1]]
                a, b = _spans_of(flagged, found, length) if (copies or 1) == 1 else (np.array([0]), np.array([len(text)]))
                starts = np.frombuffer(b"".join(packed), _START)
                for x, to, k in zip(starts, _bucket(starts["key"], buckets).tolist(), starts["key"].astype(np.int64).tolist()):
                    span = int(np.searchsorted(a, x["start"], "right")) - 1
                    if span >= 0 and x["start"] < b[span]:
                        out.append((to, *p, k, int(x["start"]), int(x["left"]), bool(x["many"]), text[x["start"] : b[span]].tobytes()))
                        held += len(out[-1][-1])
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _same(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    unlike = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
    return int(unlike[0]) if len(unlike) else n


def _trees(length: int):
    """Maximal repeats that begin with the same string: its suffixes in order, their common prefixes, the scan."""

    def run(table: pa.Table) -> pa.Table:
        prints = np.stack([table["f1"].to_numpy(), table["f2"].to_numpy()], axis=1)
        sets, owner = np.unique(prints, axis=0, return_inverse=True)
        owner, start, strings = owner.ravel(), table["start"].to_numpy(), table["string"].to_pylist()
        left, many = table["left"].to_pylist(), table["many"].to_pylist()
        groups: dict[int, dict[tuple[int, int], int]] = {}
        for i, (k, o, s) in enumerate(zip(table["key"].to_pylist(), owner.tolist(), start.tolist())):
            groups.setdefault(k, {})[o, s] = i
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, _REPEAT)]
        for group in groups.values():
            rows = [i for i in sorted(group.values(), key=strings.__getitem__) for _ in range(1 + many[i])]
            common = np.array([0, *(_same(strings[x], strings[y]) for x, y in zip(rows, rows[1:]))])
            lefts = [left[i] if left[i] >= 0 else -1 - n for n, i in enumerate(rows)]
            for size, first, last in _scan(np.array(rows), common, lefts, length):
                which = np.unique(rows[first : last + 1])
                one = np.zeros(len(which), _REPEAT)
                one["group"] = int.from_bytes(hashlib.blake2b(strings[rows[first]][:size], digest_size=8).digest(), "little", signed=True)
                one["start"], one["size"] = start[which], size
                owners.append(owner[which])
                found.append(one)
        return _by_owner(sets, np.concatenate(owners), np.concatenate(found))

    return run


def _listed(batches):
    for batch in batches:
        values = [np.frombuffer(v, _REPEAT) for v in batch.column(2).to_pylist()]
        n = np.array([len(v) for v in values], np.int64)
        all_ = np.concatenate(values) if values else np.zeros(0, _REPEAT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array(all_["group"]), pa.array(all_["start"].astype(np.int64)), pa.array(all_["size"].astype(np.int64))],
            ["f1", "f2", "group", "start", "size"],
        )


def _removal(docs: DataFrame, text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    if length < GRAM + 1 or length > GRAM + 200:
        raise ValueError(f"length is from {GRAM + 1} to {GRAM + 200}")
    spark = docs.sparkSession
    light_batches(spark)
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    rest = [c for c in docs.columns if c != text_col and c not in out]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__")).alias("rest"), text.alias("text"))
    rows = rows.withColumns({"f1": F.xxhash64("text"), "f2": F.xxhash64(F.lit(7), "text")})
    long = rows.where(F.octet_length("text") >= length)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // 40 // BUCKET))
    packed = "bucket int, prints binary, counts binary, vals binary"
    owned = "f1 long, f2 long, vals binary"
    dealt = long.select("f1", "f2", "text").mapInArrow(_deal(length, buckets), packed)
    flags = dealt.groupBy("bucket").applyInArrow(_flag(SUFFIXES), owned)
    flags = flags.groupBy("f1", "f2").agg(F.collect_list("vals").alias("flagged"))
    copies = long.groupBy("f1", "f2").agg(F.count("*").alias("copies")).where("copies > 1")
    info = save(flags.join(copies, ["f1", "f2"], "full_outer"), "runs")
    joined = save(rows.join(info, ["f1", "f2"], "left"), "texts")
    flagged = joined.where("flagged is not null").select("f1", "f2", "text", "flagged")
    arrays = flagged.mapInArrow(_send(length, buckets), "bucket int, f1 long, f2 long, start long, more int, string binary").groupBy("bucket").applyInArrow(_suffix_arrays(length), owned)
    hot = flagged.mapInArrow(_strings(length, buckets), packed).groupBy("bucket").applyInArrow(_equal_strings(length), owned)
    found = save(arrays.unionByName(hot), "repeats")
    per_text = found.groupBy("f1", "f2").agg(F.collect_list("vals").alias("found"))
    cut = joined.join(per_text, ["f1", "f2"], "left").select("rest", "text", "copies", "flagged", "found")
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__")).alias("rest")).schema["rest"].dataType.simpleString()
    cut = cut.mapInArrow(_cut(length), f"rest {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return cut.select(*[F.col(f"rest.`{c}`") for c in rest], *out), joined, found, buckets


#: The rows of the query in SQL: every string of 200 bytes is counted, and those that are there twice are laid over the texts.
SQL = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
sized AS (SELECT doc_id, t, octet_length(t) AS n, row_number() OVER () AS r FROM texts),
strings AS (SELECT r, i, md5(t[i:i + 199]) AS h FROM (SELECT r, t, unnest(range(1, n - 198)) AS i FROM sized WHERE n >= 200)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM strings) WHERE c > 1),
islands AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT r, island, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY 1, 2),
cuts AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM spans GROUP BY 1),
kept AS (SELECT r, list_transform(range(1, len(a) + 2), lambda k: CASE WHEN k = 1 THEN t[1:a[1] - 1] WHEN k > len(a) THEN t[b[k - 1]:n] ELSE t[b[k - 1]:a[k] - 1] END) AS pieces FROM cuts JOIN sized USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN pieces IS NULL THEN t ELSE list_reduce(pieces, lambda x, y: x || y) END) AS kept_sha256
FROM sized LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)
"""
