"""The document operators against plain versions of themselves, on texts with nulls, ties, copies and junk."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from nodeloom.llm import bpe, hashing, jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup, token_files
from nodeloom.llm.tokens import ByteEncoder, WordEncoder

SCHEMA = "doc_id long, text string, lang string, n_bytes string, band string"


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    base = [" ".join(word() for _ in range(rnd.randint(3, 120))) for _ in range(12)]
    shared = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 3])):
            words[rnd.randrange(len(words))] = word()
        text = " ".join(words) + ("\n" + shared if rnd.random() < 0.3 else "")
        out.append((i, text.upper() if rnd.random() < 0.1 else text))
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "a b"), (104, "a b"), (105, "x" * 5000), (106, "x" * 300 + " " + "y " * 300), (107, "\x1cq <|endoftext|> z"), (103, "a b"), (None, "a b c d e f g h")]
    return [(i, t, rnd.choice(["en", "fr", None]), "z", "z") for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, percent=75):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def test_jaccard(docs, rows):
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    assert got == components(rows)


def test_jaccard_recursion(spark, monkeypatch):
    """Regions that never fit a task are split until nothing is open."""
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(40)] = f"v{rnd.randrange(6)}"
        rows.append((i, " ".join(words)))
    # A core shared by all, with different numbers of words of their own.
    rows += [(100 + i, " ".join([f"c{j}" for j in range(50)] + [f"own{i}_{j}" for j in range(i)])) for i in range(25)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == components(rows)


def test_large_groups_of_near_copies_take_few_rounds(spark, monkeypatch):
    """A region that no task finishes closes after rounds of 8, 64 and 512 pivots, not after one round for every 8 of its sets."""
    monkeypatch.setattr(jaccard_join, "SMALL_WORK", 0)
    rounds, opened = [], jaccard_join._open
    monkeypatch.setattr(jaccard_join, "_open", lambda *a: rounds.append(1) or opened(*a))
    rnd = random.Random(17)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(160):
        words = base[: rnd.randint(40, 60)]
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:12] + [f"z{i}"] * (i % 3))) for i in range(40)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == components(rows)
    assert 2 <= len(rounds) <= 4


def test_groups_of_sets_that_link_to_nothing_take_two_rounds(spark, monkeypatch):
    """Near copies of one text too far from each other for a link leave their region only as pivots: 8 in the first round, the others in the second."""
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64, raising=False)
    rounds, opened = [], jaccard_join._open

    def counted(*a):
        rounds.append(1)
        assert len(rounds) <= 3
        return opened(*a)

    monkeypatch.setattr(jaccard_join, "_open", counted)
    rnd = random.Random(23)
    base, rows = [f"w{i}" for i in range(80)], []
    # Two copies of each change, so that the changed shingles are shared, too.
    changes = [[(p, f"v{p}_{i % 3}") for p in rnd.sample(range(80), rnd.randint(1, 6))] for i in range(80)]
    for i in range(320):
        words = list(base)
        for p, v in changes[i % 80] + changes[rnd.randrange(80)] * (i >= 80):
            words[p] = v
        rows.append((i, " ".join(words)))
    got = Counter(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == components(rows)
    assert len({c for _, _, c in got}) > 100
    assert len(rounds) == 3


def test_nodes_meet_pivots_as_sets_do():
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 300, rnd.integers(1, 120))).astype(np.uint64) for _ in range(70)]
    keys, owner = np.concatenate(sets[:30]), np.repeat(np.arange(30), [len(s) for s in sets[:30]])
    want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:30]]
    assert jaccard_join._same(keys, owner, 30, sets[20:]).tolist() == want
    table = pa.table({"region": ["r"] * 70, "node": list(range(70)), "n": [len(s) for s in sets], "wide": [False] * 70, "most": [9] * 70, "rank": pa.array([None] * 30 + list(range(40)), pa.int32()), "core": [s.tobytes() for s in sets], "is_pivot": [False] * 30 + [True] * 40})
    got = jaccard_join._meet(40)(table).to_pylist()
    same = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    assert {(r["node"], x["pivot"], x["same"]) for r in got for x in r["links"]} == {(a, b, same(a, b)) for a in range(30) for b in range(30, 70) if 100 * same(a, b) >= 40 * len(np.union1d(sets[a], sets[b]))}
    assert all(abs(r["far"][i] - 1 + same(r["node"], 30 + i) / len(np.union1d(sets[r["node"]], sets[30 + i]))) < 1e-12 for r in got for i in range(40))
    assert jaccard_join._meet(40)(table.slice(30)).num_rows == 0


def test_cells_within_a_task_lose_no_link():
    """Clusters of sets around a common core: regions split into cells, and what the links join stays joined."""
    rnd = random.Random(31)
    for _ in range(40):
        common = [rnd.randrange(1 << 60) for _ in range(rnd.choice([1, 3]))]
        centres = [[rnd.randrange(1 << 60) for _ in range(rnd.randint(8, 60))] for _ in range(rnd.randint(2, 12))]
        sets = []
        for _ in range(rnd.randint(5, 90)):
            c = rnd.choice(centres)
            sets.append(sorted(set(common) | set(rnd.sample(c, len(c) - rnd.randint(0, len(c) // 3))) | {rnd.randrange(1 << 60) for _ in range(rnd.randint(0, 3))}))
        wide = [rnd.random() < 0.1 for _ in sets]
        table = pa.table({"node": list(range(len(sets))), "part": list(range(len(sets))), "n": [len(s) for s in sets], "wide": wide, "core": [np.array(s, np.uint64).tobytes() for s in sets]})
        got = jaccard_join._finish(75)(table).to_pylist()
        links = {(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
        found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got}
        assert found <= links and all(r["same"] == len(set(sets[r["a"]]) & set(sets[r["b"]])) for r in got)
        assert {x for x in links if wide[x[0]] or wide[x[1]]} <= found

        def groups(pairs):
            part = list(range(len(sets)))  # noqa: B023
            for a, b in pairs:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
            return {frozenset(i for i, p in enumerate(part) if p == q) for q in part}

        assert groups(found) == groups(links)


def removed(rows, length=200):
    count = Counter()
    texts = [(t or "").encode() for _, t, *_ in rows]
    for b in texts:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = Counter()
    for (i, *_), b in zip(rows, texts):
        kept, spans, end, before = bytearray(), 0, 0, False
        for j in range(len(b)):
            if j <= len(b) - length and count[b[j : j + length]] > 1:
                end = j + length
            spans += j < end and not before
            before = j < end
            if not before:
                kept.append(b[j])
        out[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(docs, rows):
    got = suffix_dedup.remove_repeats(docs)
    assert {"lang", "band"} <= set(got.columns)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == removed(rows)


def test_hot_anchors_equal_brute_force(spark, monkeypatch):
    """One passage inside many unlike ones, with anchors that count as hot from 2 and from 5 unlike runs on."""
    rnd = random.Random(12)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    inner = letters(170)
    rows = [(i, letters(150) + inner[rnd.randint(0, 10) :] + letters(150)) for i in range(40)]
    rows += [(100 + i, rows[i][1][90:330] + letters(60)) for i in range(12)] + [(200, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (1, 4):
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", most)
        found = []
        strings = suffix_dedup._equal_strings
        monkeypatch.setattr(suffix_dedup, "_equal_strings", lambda n: found.append(n) or strings(n))
        got = suffix_dedup.remove_repeats(docs)
        assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == removed(rows)
        assert found
        monkeypatch.setattr(suffix_dedup, "_equal_strings", strings)


def test_maximal_repeats_are_all_there():
    rnd = random.Random(4)
    core = bytes(rnd.choice(b"ab") for _ in range(400))
    strings = [core[:260], core[20:280], b"z" + core[:258]]
    found = {(size, tuple(sorted(zip(w.tolist(), at.tolist())))) for size, w, at in suffix_dedup.repeats_of(strings, np.array([60, 60, 59]), 200)}
    assert (258, ((0, 0), (2, 1))) in found and (240, ((0, 20), (1, 0))) in found


def maximal(rows, length=200):
    """(string, doc_id, start) of every maximal repeat, from all suffixes."""
    starts, out = defaultdict(list), Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]].append((b[p:], b[p - 1] if p else None, i, p))
    for group in starts.values():
        group.sort(key=lambda g: g[0])
        common = {x[0][: next((j for j, (c, d) in enumerate(zip(x[0], y[0])) if c != d), min(len(x[0]), len(y[0])))] for x, y in zip(group, group[1:])}
        for w in common:
            have = [g for g in group if g[0].startswith(w)]
            if len({g[1] for g in have}) > 1 or have[0][1] is None:
                out.update((w, i, p) for _, _, i, p in have)
    return out


def test_maximal_repeats(spark, rows):
    """Groups are whole, with all occurrences: passages copied verbatim, copies of texts, anchors with unlike runs."""
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(2000)
    some = [r[:2] for r in rows if len(r[1] or "") < 2000]
    some += [(200 + i, noise(300) + passage + noise(300)) for i in range(5)] + [(300, passage[500:1500]), (301, "é" + passage[1400:]), (302, passage), (302, passage), (303, noise(250))]
    want = Counter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), i, p, len(w)) for (w, i, p), n in maximal(some).items() for _ in range(n))
    got = suffix_dedup.maximal_repeats(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r["size"] == 2000 for r in got) == 7


def test_hot_anchors_go_by_string():
    text = bytes(random.Random(1).choice(b"abc") for _ in range(3000))
    owner, runs = suffix_dedup._runs(np.frombuffer(text, np.uint8), np.array([0, 3000]), 200)
    covered = sorted(s for r in runs for s in range(int(r["at"]) - int(r["back"]), int(r["at"]) - int(r["back"]) + int(r["more"]) + 1))
    assert covered == list(range(2801)) and not owner.any()


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    text = bytes(random.Random(2).choice(b"abc") for _ in range(5000))
    _, runs = suffix_dedup._runs(np.frombuffer(text, np.uint8), np.array([0, 5000]), 200)
    covered = sorted(s for r in runs for s in range(int(r["at"]) - int(r["back"]), int(r["at"]) - int(r["back"]) + int(r["more"]) + 1))
    assert covered == list(range(4801))


def test_words_over_window_ends(monkeypatch):
    monkeypatch.setattr(hashing, "WINDOW", 50)
    texts = [b"ab cd " * 30 + b"x" * 300 + b" ab", b"", b"cd"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, begins, rows = hashing.words(data, offsets)
    assert np.diff(rows).tolist() == [62, 0, 1] and h[0] == h[61] and h[1] == h[62] and h[60] not in (h[0], h[1])


def cut(ids, capacity):
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = len(ids) % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, len(ids), capacity))]


def best_fit(lengths, capacity):
    """Sequences of plain best fit, longest pieces first, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweeps_place_as_plain_best_fit_does():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([10, 64, 100])
        lengths = [rnd.randint(1, rnd.choice([capacity, capacity // 2, 7])) for _ in range(rnd.randint(1, 300))]
        rules = packing.sweep(Counter(lengths), capacity)
        assert max(first + n for _, _, n, first, _ in rules) == best_fit(lengths, capacity)


@pytest.mark.parametrize("kind, name", [(WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json")])
def test_ids_of_odd_letters_and_white_space(kind, name):
    """Letters that Unicode has not given out, or that Python knows no case of; white space of every kind; special entries."""
    rnd = random.Random(6)
    points = [0x558, 0x58B, 0x88F, 0xC5C, 0x1C89, 0x208F, 0xA7CB, 0x130, 0x3A3, 0x1E9E, *rnd.sample([c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000], 8000)]
    parts = ["a", "B", "\xdc", "e\u0301", "1", ".", "'s", " ", " ", "\n", "\xa0", "\t", "  ", "\x1c", "\r\n", "\x85", "\u3000", "<|endoftext|>", "<|EndOfText|>"]
    points += [0x958, 0x95F, 0xFB1D, 0x1FBE, 0x149]  # letters that normalising or lower case parts
    texts = [f"a{chr(c)}b A{chr(c)} {chr(c)}1 x{chr(c)}. {chr(c)}!" for c in points] + ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(8000)]
    t = Tokenizer.from_file(P.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert kind(P.path(name)).encode(texts) == want
    if kind is WordEncoder:
        got = bpe.WordBpe(P.path(name)).digests(pa.array(texts))
        ids = [np.frombuffer(w, "<u4").tolist() for w in want]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got == [(len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for i in ids]


def test_packing(docs, rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=64).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (start, n) in enumerate(cut(ids, 64)):
            want[i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= sum(r.length for r in got) / 64 * 1.1 + 1


def test_code_lengths_and_codes():
    rng = np.random.default_rng(1)
    for trial in range(40):
        counts = np.zeros(300, np.int64)
        used = rng.choice(300, rng.integers(1, 300), replace=False)
        counts[used] = np.maximum(1, rng.pareto(0.3, len(used)).clip(0, 1e12)).astype(np.int64)
        limit = 9 if trial % 2 else 20
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (len(used) == 1 or abs(sum(2.0 ** -int(x) for x in lengths if x) - 1) < 1e-12)
        code = token_files.Code(lengths)
        ids = rng.choice(used, rng.integers(0, 3000))
        assert (code.decode(*code.encode(ids), len(ids)) == ids).all()


def test_short_way_of_plain_words_gives_the_same_ids():
    quick, slow = (WordEncoder(P.path("word_bpe_49k.json")) for _ in range(2))
    assert quick.simple
    slow.simple = False
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdEFxyz") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", ".", ",", "!", "?", ";", ":", "..", "'s", "<|endoftext|>", "é"]) for _ in range(2000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, 2000, 20)] + [". a .", "", ":"]
    got = quick.encode(texts)
    assert got == slow.encode(texts) == [slow.whole(t) for t in texts]


def test_token_files(docs, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_files.round_trip(docs, P.path("word_bpe_49k.json")).collect()), key=lambda r: r[1])
    ids = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")) for i, x, *_ in rows]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    order = [r[0] if r[0] is not None else -1 for r in got]
    assert order == sorted(order)


ODD = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\xa0", ".", "!", "'s", "1", "ß", "<|endoftext|>", "İ", "Σ", "漢", "é", "the", " in", "ing", "　"]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    some = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(14))) for _ in range(1500)]
    return some + [" ".join("".join(rnd.choice("abcdeinth") for _ in range(rnd.randrange(1, 9))) for _ in range(3)) for _ in range(1500)] + ["a" * 4000, ""]


@pytest.mark.parametrize("kind, name", [(WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json")])
def test_encoders_equal_the_library(odd_texts, kind, name):
    t = Tokenizer.from_file(P.path(name))
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd_texts]
    assert kind(P.path(name)).encode(odd_texts) == want


def test_bpe_equals_the_library(spark, docs, rows, odd_texts):
    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    digest = lambda x: (len(i := t.encode(x, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest())
    assert [own.whole(x) for x in odd_texts] == [t.encode(x, add_special_tokens=False).ids for x in odd_texts]
    assert own.digests(pa.array(odd_texts)) == list(map(digest, odd_texts))
    assert Counter(map(tuple, bpe.digests(docs, path).collect())) == Counter((i, *digest(x or "")) for i, x, *_ in rows)
    back = bpe.decode(bpe.encode(docs.where("doc_id = 103"), path), path).first().text
    assert back == t.decode(t.encode("a b", add_special_tokens=False).ids, skip_special_tokens=False)


def test_quality_classifier(spark, sf):
    read = lambda n: spark.read.parquet(f"{sf}/../sf0.01/{n}.parquet")
    docs, labels = read("documents"), read("labels")
    got = quality_classifier.score_quality(docs, labels)
    held = got.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


def test_quality_classifier_without_labels(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}


def test_quality_rules_base(docs, rows):
    got = quality_rules.judge(docs.select("doc_id", "text", "lang", "n_bytes"), P.path("piece_bpe_32k.model")).collect()
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        want[i, len(w), len(b"".join(w).decode()), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_rules_bands(spark, sf):
    """Junk that passes the fixed limits mostly goes, clean documents mostly stay."""
    read = lambda n: spark.read.parquet(f"{sf}/../sf0.01/{n}.parquet")
    judged = quality_rules.judge(read("documents"), P.path("piece_bpe_32k.model"), keep_text=False).where("not base_failed")
    kept = {(r.quality, r.kept): r["count"] for r in judged.join(read("labels"), "doc_id").groupBy("quality", "kept").count().collect()}
    junk, clean = (kept.get((q, True), 0) / (kept.get((q, True), 0) + kept.get((q, False), 0)) for q in (0, 1))
    assert junk <= 0.4 and clean >= 0.98, kept


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert token_files.round_trip(empty, P.path("word_bpe_49k.json")).count() == 0
    assert bpe.digests(empty, P.path("word_bpe_49k.json")).count() == 0
    assert quality_classifier.score_quality(empty, labels).count() == 0
    assert quality_rules.judge(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_quality_verdicts_equal_plain_bands(docs, spark, sf):
    """Measures word by word, and quartiles, bands and verdicts of sorted lists."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang"))
    got = quality_rules.judge(table, P.path("piece_bpe_32k.model")).collect()
    for r in got[::9]:
        ids = [i for w in (r.text or "").encode().split() for i in model.encode(w.decode("utf-8", "replace"))]
        share = [n / len(ids) for n in Counter(ids).values()]
        assert r.n_tokens == len(ids)
        assert r.entropy == pytest.approx(-sum(s * np.log2(s) for s in share) / np.log2(max(len(ids), 2)), abs=1e-9)
        assert r.byte_share == pytest.approx(sum(model.is_byte(i) for i in ids) / max(len(ids), 1))

    def quartiles(rows, m):
        return np.percentile([round(r[m], 3) for r in rows], [25, 75]) if rows else np.zeros(2)

    judged = [r for r in got if not r.base_failed]
    size = lambda r: int(np.log2(max(r.n_tokens, 1)))
    for r in got:
        fine = [x for x in judged if (x.lang or "", x.script, size(x)) == (r.lang or "", r.script, size(r))]
        rough = [x for x in judged if x.script == r.script]
        sized = [x for x in rough if size(x) == size(r)]
        inside = not r.base_failed
        for m, floor in quality_rules.FLOORS.items():
            q = quartiles(judged, m)
            for rows in (rough, sized, fine):
                q = (len(rows) * quartiles(rows, m) + quality_rules.PRIOR * q) / (len(rows) + quality_rules.PRIOR)
            below, above = (max(n * (q[1] - q[0]), floor) for n in quality_rules.SPREADS[m])
            if min(abs(r[m] - q[0] + below), abs(r[m] - q[1] - above)) < 1e-6:
                inside = r.kept  # at the very edge rounding decides
                break
            inside = inside and q[0] - below <= r[m] <= q[1] + above
        assert r.kept == inside
    again = quality_rules.judge(table.repartition(7), P.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.kept) for r in again) == Counter((r.doc_id, r.kept) for r in got)


def test_quality_classifier_equals_plain_ridge_and_isotonic(spark, sf):
    """The same statistics, with normal equations and pooling written out over whole arrays."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.unionByName(labels.limit(5))  # repeated labels count as often as they are there
    model, described = quality_classifier.train(docs, labels)
    x_of = {r.doc_id: r.x for r in described.collect()}
    known = [(r.doc_id, r.quality, zlib.crc32(str(r.doc_id).encode()) % 4) for r in labels.collect() if r.doc_id in x_of]
    rows = [(np.array(x_of[i]), y, k == 3) for i, y, k in known if k != 2]
    x = np.array([r[0] for r in rows])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    first = [(a, y) for a, y, second in rows if not second]
    z, y = model.features(np.array([a for a, _ in first])), np.array([y for _, y in first], float)
    weights = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(weights, model.weights, atol=1e-6)
    at = np.rint(np.clip(model.features(np.array([a for a, _, s in rows if s])) @ weights, -1, 2) * quality_classifier.BINS) / quality_classifier.BINS
    y = np.array([b for _, b, s in rows if s], float)
    places = sorted(set(at))
    # Isotonic regression by its minimax formula.
    mean = lambda a, b: y[(at >= a) & (at <= b)].mean()
    for p in places[::7]:
        level = max(min(mean(a, b) for b in places if b >= p) for a in places if a <= p)
        block = [q for q in places if abs(max(min(mean(a, b) for b in places if b >= q) for a in places if a <= q) - level) < 1e-12]
        n = ((at >= block[0]) & (at <= block[-1])).sum()
        got = np.interp(p, model.knots, model.levels)
        assert got == pytest.approx((level * n + 0.5) / (n + 1), abs=0.02)
