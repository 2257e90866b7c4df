"""Ids of whole texts as the tokenizers library gives them, with the ids of words kept.

Both vocabularies split a text before they merge, so the ids of a text are those of its words in order, as long as the cuts are
where the library cuts too; a word that is new is merged by rank. Texts in which the cuts can't be told, and words whose
merges or letters are not beyond doubt, go to the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nodeloom.llm import arrow_words as A
from nodeloom.llm.bpe import _MARKS, UNUSUAL, WordBpe, byte_letters, mark_apart
from nodeloom.llm.workers import held

#: Words of one generation that a worker keeps, of two.
CACHE = 300_000


class _Words(dict):
    """Ids of words; what comes again moves to the new generation, the rest goes with the old one."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def doubtful(self, word: str) -> bool:
        """Whether a word has a special entry in it, or letters of which Python's tables may be older than the library's."""
        return any(s in word for s in self.special) or not (word.isascii() or word.isprintable())

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the texts' offsets among them."""
        texts = A.plain(texts)
        ids, offsets, odd = self._by_words(texts)
        if not len(odd):
            return ids, offsets
        parts, at = [], 0
        sizes = np.diff(offsets)
        for row in odd.tolist():
            own = np.frombuffer(self.whole(texts[row].as_py()), "<u4")
            parts += [ids[at : offsets[row]], own]
            at, sizes[row] = offsets[row + 1], len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.flat(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets, and the rows that are to go to the library."""
        raise NotImplementedError


def _joined(packed: list[bytes], which: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows from those of their words."""
    n = np.array([len(p) for p in packed], np.int64) // 4
    places, ends = A.gathered(np.cumsum(n) - n, n, which)
    return np.frombuffer(b"".join(packed), "<u4")[places], np.concatenate([[0], ends])[offsets]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids with ``end`` after them."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _merger(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordEncoder(Encoder):
    """For vocabularies with word ends, which drop white space: words are what stands between white space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.bpe = WordBpe(path)
        # The merger knows bytes only; two of them make a symbol, the first of which no symbol's second is mixed up with.
        self.plain = [bytes((0xFE, b)) for b in range(256)]
        self.final = [bytes((0xFF, b)) for b in range(256)]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters, end = byte_letters(), self.bpe.suffix
        ranks = {}
        for token, i in vocab.items():
            stem = [letters[c] for c in token.removesuffix(end)]
            last = token.endswith(end)
            # The merger joins whatever makes an entry; the library joins listed pairs only. In any word both pass through the
            # same states if BPE makes each entry of its own text, so other entries are left out: nothing makes them.
            if len(stem) == 1 or self.bpe.makes_itself(i, bytes(stem), last):
                ranks[b"".join([self.plain[b] for b in stem[:-1]]) + (self.final if last else self.plain)[stem[-1]]] = i
        self.merge = _merger(ranks)
        self.words = _Words(self._new)
        # No special entry can be within letters that at most one mark follows.
        self.simple = all(len(s) > 1 and not s[:-1].isalpha() for s in self.special)

    def _new(self, word: str) -> bytes:
        if not word:
            return b""
        if self.simple and word.isascii():  # most words; the same as below, in fewer steps
            if word.isalpha():
                return _packed(self._word(word.lower().encode()))
            if word[-1] in _MARKS and word[:-1].isalpha():
                return self.words[word[:-1]] + self.words[word[-1]]
        if self.doubtful(word):
            return self.whole(word)
        low = word.replace("Σ", "σ").lower()
        if mark_apart(word):
            return self.words[word[:-1]] + self.words[word[-1]]
        if low.isalpha() and (low.isascii() or unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)):
            return _packed(self._word(low.encode()))
        return _packed(self.bpe.plain(word, self._word))

    def _word(self, data: bytes) -> list[int]:
        pairs = bytearray(b"\xfe" * (2 * len(data)))
        pairs[1::2] = data
        pairs[-2] = 0xFF
        return self.merge(bytes(pairs))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.words.turn()
        words, which, offsets = A.by_white_space(texts)
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False))
        return *_joined(list(map(self.words.__getitem__, words)), which, offsets), odd


class ByteEncoder(Encoder):
    """For byte-level vocabularies, whose words begin with the space before them: lines, and words that spaces part."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes([letters[c] for c in token]): i for token, i in vocab.items()}
        import tiktoken

        self.ranked = tiktoken.Encoding("bytes", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Words(lambda w: self._new("", w)), _Words(lambda w: self._new(" ", w))

    def _new(self, before: str, word: str) -> bytes:
        """The ids of a word with the space before it, if any; none for a word that is no word, which makes its row odd."""
        if word == "\n":
            return _packed(self.ranked.encode_ordinary(word))
        if word.split() != [word]:
            return b""
        return self.whole(before + word) if self.doubtful(word) else _packed(self.ranked.encode_ordinary(before + word))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.first.turn()
        self.rest.turn()
        words, which, offsets = A.by_spaces(texts)
        begins_line = np.zeros(len(which), bool)
        begins_line[offsets[:-1][offsets[:-1] < len(which)]] = True
        if "\n" in words:
            begins_line[1:] |= which[:-1] == words.index("\n")
        which = 2 * which + begins_line
        there = np.zeros(2 * len(words), bool)
        there[which] = True
        first, rest = self.first.__getitem__, self.rest.__getitem__
        packed = [b""] * (2 * len(words))
        for i in np.flatnonzero(there).tolist():
            packed[i] = (first if i & 1 else rest)(words[i >> 1])
        bad = np.array([not p for p in packed])[which]
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)
        return *_joined(packed, which, offsets), odd


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One for each worker process, which keeps its words from task to task."""
    return held((kind.__name__, path), lambda: kind(path))
