"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from nodeloom.llm import hashing as H

UPPER, LOWER, DIGIT, SYMBOL, BANG, POINT, BLANK, LINE, HIGH, INNER, OTHER = range(11)
_CLASS = np.full(256, OTHER, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[ord(c) for c in "!?"]] = BANG
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = POINT
_CLASS[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
_CLASS[[0x20, 9, 11, 12, 13]] = BLANK
_CLASS[10] = LINE
_CLASS[0x80:0xC0] = INNER
_CLASS[0xC0:] = HIGH


@dataclass
class Counts:
    """Of some rows: bytes by class, word hashes with the rows' offsets among them, and the bytes themselves."""

    data: np.ndarray
    offsets: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    begins: np.ndarray
    rows: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.rows)

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return self.classes.sum(axis=1) - self.classes[:, [BLANK, LINE, INNER]].sum(axis=1)


def count(data: np.ndarray, offsets: np.ndarray) -> Counts:
    n = len(offsets) - 1
    classes = np.zeros((n, 11), np.int64)
    for a in range(0, len(data), H.WINDOW):
        b = min(a + H.WINDOW, len(data))
        lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        lengths = np.diff(np.clip(offsets[lo : hi + 1], a, b))
        at = np.repeat(np.arange(hi - lo) * 11, lengths)
        classes[lo:hi] += np.bincount(at + _CLASS[data[a:b]], minlength=(hi - lo) * 11).reshape(-1, 11)
    return Counts(data, offsets, classes, *H.words(data, offsets, H.BYTES))


def _row_of(rows: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def run_counts(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each value, how often its row has it."""
    if not len(values):
        return np.zeros(0, np.int64)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    run = np.cumsum(new) - 1
    out = np.empty(len(values), np.int64)
    out[order] = np.bincount(run)[run]
    return out


def repeated_words(c: Counts, k: int) -> np.ndarray:
    """Words of each row that lie in a k-word window which the row has twice or more."""
    n = c.n_words
    have = np.maximum(n - k + 1, 0)
    windows, rows = H.windows_of_words(c.words, c.rows, k)
    short = np.repeat((n > 0) & (n < k), np.diff(rows))
    windows, owner = windows[~short], np.repeat(np.arange(len(n)), have)
    often = run_counts(windows, owner) > 1
    at = np.arange(len(windows)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(c.rows[:-1], have)
    edge = np.zeros(len(c.words) + 1, np.int64)
    np.add.at(edge, at[often], 1)
    np.add.at(edge, at[often] + k, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(_row_of(c.rows)[covered], minlength=len(n))


def line_counts(c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that are equal to an earlier line of the row."""
    n = len(c.offsets) - 1
    lines, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        text = c.data[c.offsets[i] : c.offsets[i + 1]].tobytes()
        with_word = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines[i], same[i] = len(with_word), len(with_word) - len(set(with_word))
    return lines, same
