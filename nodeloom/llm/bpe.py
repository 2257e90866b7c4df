"""Exact BPE encoding by backtracking, and decoding from a table of offsets.

The ids of a word under BPE are the one sequence of vocabulary entries in which every two neighbours are compatible: undoing
the merges of both from the last one back never meets an earlier merge across their border. So the encoder takes the longest
entry at a place, which an Aho-Corasick automaton finds, keeps it if it goes
with the entry before, else tries its longest proper prefix, and steps back when none is left. A place from which no way on
was found is marked and not tried again; so a word takes linear time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm import arrow_words as A
from nodeloom.llm.scratch import light_batches
from nodeloom.llm.workers import held

#: Chunks of one generation that a worker keeps, of two.
CACHE = 300_000
#: Marks that are a piece of their own after a letter.
_MARKS = frozenset(".,!?;:")
_WORD_END = 0x1000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: its own if it has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def mark_apart(word: str) -> bool:
    """Whether a word ends in a mark that is a piece of its own: what normalising leaves before it is a letter."""
    if word[-1:] not in _MARKS:
        return False
    before = word[-2:-1]
    return before.isalpha() if before.isascii() else unicodedata.normalize("NFC", word[:-1]).lower()[-1:].isalpha()


class WordBpe:
    """A byte-level BPE vocabulary with word ends, as a tokenizer file has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, letters = parts["model"], byte_letters()
        self.suffix = model["end_of_word_suffix"]
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        from tokenizers import Tokenizer

        self.library, self.letters = Tokenizer.from_file(path), letters
        self.special_pattern = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)))
        self.white = regex.compile(r"\p{White_Space}+")

        def symbols(token: str) -> str:
            """One letter a byte; the last byte of a word has letters of its own."""
            if token.endswith(self.suffix):
                stem = token[: -len(self.suffix)]
                return "".join(chr(letters[c]) for c in stem[:-1]) + chr(_WORD_END + letters[stem[-1]])
            return "".join(chr(letters[c]) for c in token)

        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        text = {i: symbols(t) for t, i in vocab.items()}
        ids = {t: i for i, t in text.items()}
        self.length = [len(text.get(i, "")) for i in range(self.size)]
        # A merge's rank orders merges; an entry is undone into the parts of the merge that made it.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = [-1] * self.size
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a.removesuffix(self.suffix) + b if a.endswith(self.suffix) else a + b]
            self.pairs[x, y] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        self.compatible: dict[int, bool] = {}
        # Entries that BPE itself does not make of their own text are never part of a result.
        self.automaton = ahocorasick.Automaton()
        for i, t in text.items():
            if len(t) == 1 or self.rank[i] >= 0:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.prefix = [-1] * self.size
        for i, t in text.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.automaton:
                    self.prefix[i] = ids[t[:n]]
                    break
        self._offsets(vocab, letters)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _offsets(self, vocab: dict[str, int], letters: dict[str, int]) -> None:
        """Without a decoder the library joins entries as they are written, one space between them."""
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [by_id.get(i, "").encode() for i in range(self.size)]
        self.bytes = b"".join(texts)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, from the entries' places in one buffer."""
        texts, at = self.bytes, self.offset
        return b" ".join([texts[at[i] : at[i + 1]] for i in ids])

    def goes_with(self, a: int, b: int) -> bool:
        """Whether a border between entries a and b survives all merges."""
        key = a << 20 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1 << 19:
                self.compatible.clear()
            known = self.compatible[key] = self._border_stays(a, b)
        return known

    def _border_stays(self, a: int, b: int) -> bool:
        # Undo the later of the two merges, again and again. A merge over the border wins if it comes before whatever is still
        # to be made on either side; of equal ones, the one further left comes first.
        before = len(self.pairs) + 1
        x, y, on_left = a, b, False
        while True:
            rank = self.pairs.get((x, y))
            if rank is not None and (rank < before or (rank == before and not on_left)):
                return False
            if self.rank[x] < 0 and self.rank[y] < 0:
                return True
            if self.rank[x] > self.rank[y]:
                before, x, on_left = self.rank[x], self.right[x], True
            else:
                before, y, on_left = self.rank[y], self.left[y], False

    def makes_itself(self, i: int, data: bytes, last: bool) -> bool:
        """Whether BPE makes this entry of its own bytes, which end a word or don't."""
        return self._symbols(data[:-1].decode("latin-1") + chr((_WORD_END if last else 0) + data[-1])) == [i]

    def word(self, data: bytes) -> list[int]:
        """The ids of one word's bytes."""
        return self._symbols(data[:-1].decode("latin-1") + chr(_WORD_END + data[-1]))

    def _symbols(self, text: str) -> list[int]:
        longest, known = self.automaton.iter_long, self.compatible
        # The longest entries one after the other are right up to the first border that a merge crosses.
        greedy = [token for _, token in longest(text)]
        for i in range(1, len(greedy)):
            ok = known.get(greedy[i - 1] << 20 | greedy[i])
            if not (self.goes_with(greedy[i - 1], greedy[i]) if ok is None else ok):
                break
        else:
            return greedy
        out, token, dead, n = greedy[:i], greedy[i], set(), len(text)
        at = sum([self.length[t] for t in out])
        while at < n:
            end = at + self.length[token]
            if end not in dead and (not out or self.goes_with(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = next(longest(text[at : at + self.longest]))[1]
                continue
            while self.prefix[token] < 0:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
            token = self.prefix[token]
        return out

    def plain(self, text: str, word: Callable[[bytes], list[int]]) -> list[int]:
        """The ids of a text without special entries; ``word`` gives those of a word's bytes."""
        if not text.isascii():
            if not text.isprintable():  # letters that Python's tables may not know yet: the library's tables cut and lower them
                return [i for piece in self.pieces(text) for i in word(piece)]
            # The library lowers each letter by itself: a sigma at the end of a word is none of its own.
            text = self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("\u03a3", "\u03c3")
        text = text.lower()
        if text.isalpha() and text.isascii():
            return word(text.encode())
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += word(piece.encode())
        return out

    def pieces(self, text: str) -> list[bytes]:
        """The words that the library's own normaliser and splitter make of a text."""
        normal = self.library.normalizer.normalize_str(text)
        return [bytes([self.letters[c] for c in piece]) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def whole(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.plain(text[at : m.start()], self.word) + [self.special[m.group()]]
            at = m.end()
        return out + self.plain(text[at:], self.word)

    def _new(self, word: str) -> tuple[int, str, bytes]:
        found = self.older.get(word) or self._made(word)
        self.known[word] = found
        return found

    def _made(self, word: str) -> tuple[int, str, bytes]:
        if any(s in word for s in self.special):
            return self._entry(self.whole(word))
        if mark_apart(word) and (word.isascii() or word.isprintable()):
            n, ids, decoded = self.known.get(word[:-1]) or self._new(word[:-1])
            if n:
                more, mark, mark_decoded = self.known.get(word[-1]) or self._new(word[-1])
                return n + more, f"{ids} {mark}", b"%b %b" % (decoded, mark_decoded)
        if word.isascii() and (low := word.lower()) != word and not any(s in low for s in self.special):
            return self.known.get(low) or self._new(low)
        return self._entry(self.plain(word, self.word))

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the decimal ids with spaces between, sha256 of the decoded text) of each text."""
        texts = A.plain(texts)
        words, which, offsets = A.by_white_space(texts)
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, new = self.known.get, self._new
        entries = [known(w) or new(w) for w in words]
        # An entry takes a place only if it has ids: a word of marks that normalising drops has none.
        n = np.array([e[0] for e in entries], np.int64)
        ids, decoded = np.empty(len(entries), object), np.empty(len(entries), object)
        ids[:], decoded[:] = [e[1] for e in entries], [e[2] for e in entries]
        odd = pc.match_substring_regex(texts, UNUSUAL).to_pylist()
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if odd[i]:
                count, id_text, decoded_text = self._entry(self.whole(texts[i].as_py()))
            else:
                own = which[a:b]
                count = n[own]
                own, count = own[count > 0], int(count.sum())
                id_text, decoded_text = " ".join(ids[own].tolist()), b" ".join(decoded[own].tolist())
            out.append((count, hashlib.sha256(id_text.encode()).hexdigest(), hashlib.sha256(decoded_text).hexdigest()))
        return out


#: Python takes these for white space and Unicode does not.
UNUSUAL = "[\x1c-\x1f]"


def vocabulary(path: str) -> WordBpe:
    """One for each worker process, which keeps its words from task to task."""
    return held(("bpe", path), lambda: WordBpe(os.fspath(path)))


def _digests(path: str):
    def run(batches):
        bpe = vocabulary(path)
        for part in A.slices(batches):
            rows = bpe.digests(part.column(1))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded.

    Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD. Each row stands for itself: null and repeated ids pass through, other columns don't.
    """
    light_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str):
    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.whole(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(i or []).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
