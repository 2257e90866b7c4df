"""Quality rules: fixed limits on words, and bands of tokeniser fertility by language and script.

A public vocabulary with byte fallback tells how usual a text's words are: junk takes more tokens a character, falls back to
bytes, or spreads its tokens unlike other texts of its language. Over all documents each group of language, script and
length gets its quartiles of the three measures; a text far outside them is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm import hashing as H
from nodeloom.llm import textstats as T
from nodeloom.llm.scratch import light_batches, save
from nodeloom.llm.workers import held, trim

#: Words whose tokens a worker keeps, and rows of a wider group that each group counts as its own.
CACHE, PRIOR = 200_000, 10
#: Widths of a band: so many spreads between the quartiles below and above them, and this much at least. Junk takes more tokens a
#: character and repeats them, so it lies on the low side of both measures; the high side is for what is unlike everything else.
SPREADS = {"chars_per_token": (2.0, 3.0), "byte_share": (3.0, 3.0), "entropy": (1.5, 3.0)}
FLOORS = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.02}
_SCRIPTS = [(0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0E00, 0x0E7F, "thai"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul")]


class Vocabulary:
    """Tokens of words, by the words' hashes; words that come again are looked up."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.tokens: list[np.ndarray] = []

    def ids(self, c: T.Counts) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows' words, and the row of each."""
        if len(self.place) > CACHE:
            self.clear()
        distinct, first, which = np.unique(c.words, return_index=True, return_inverse=True)
        at = np.array([self.place.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            texts = []
            for i in first[new]:
                begin = c.begins[i]
                end = c.begins[i + 1] if i + 1 < len(c.begins) else len(c.data)
                texts.append(_word(c.data[begin:end].tobytes()))
            for start in range(0, len(texts), 4096):
                for ids in self.model.encode(texts[start : start + 4096], num_threads=1):
                    self.tokens.append(np.array(ids, np.int32))
            at[new] = len(self.place) + np.arange(len(new))
            self.place.update(zip(distinct[new].tolist(), at[new].tolist()))
        own = [self.tokens[i] for i in at]
        n = np.array([len(t) for t in own], np.int64)
        flat = np.concatenate(own) if own else np.zeros(0, np.int32)
        begin = np.cumsum(n) - n
        count = n[which]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[which], count)
        return flat[place], np.repeat(T._row_of(c.rows), count)


def _word(data: bytes) -> str:
    return data.split(None, 1)[0].decode("utf-8", "replace")


def _script(text: bytes) -> str:
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    found = {name: int(((points >= a) & (points <= b)).sum()) for a, b, name in _SCRIPTS}
    found["latin"] = int((((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xC0) & (points < 0x250)).sum())
    return max(found, key=found.get)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, script string, chars_per_token double, byte_share double, entropy double"


def _measure(path: str, column: int):
    def run(batches):
        vocabulary = held(("pieces", path), lambda: Vocabulary(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                c = T.count(*H.text_bytes(part.column(column)))
                n = len(c.n_words)
                tokens, owner = vocabulary.ids(c)
                total = np.bincount(owner, minlength=n)
                often = T.run_counts(tokens, owner)
                entropy = np.bincount(owner, weights=-np.log2(often / total[owner]), minlength=n) / np.maximum(total, 1) / np.log2(np.maximum(total, 2))
                fallback = np.bincount(owner, weights=vocabulary.is_byte[tokens], minlength=n) / np.maximum(total, 1)
                scripts = [_script(c.data[a:b].tobytes()) for a, b in zip(c.offsets[:-1], c.offsets[1:])]
                arrays = [c.n_words, c.word_chars, c.classes[:, T.SYMBOL], T.line_counts(c)[1], T.repeated_words(c, 8), total, scripts, c.word_chars / np.maximum(total, 1), fallback, entropy]
                names = [x.split()[0] for x in MEASURES.split(", ")]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in arrays)], [*part.schema.names, *names])
        trim()

    return run


def _quartiles(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of rows that pass the fixed limits and quartiles of each measure, by group; exact, of measures to three places."""
    quartiles = [F.percentile(F.round(m, 3), [0.25, 0.75]).alias(m) for m in FLOORS]
    return rows.where("not base_failed").groupBy(*keys).agg(F.struct(F.count("*").alias("n"), *quartiles).alias(name))


def _toward(own: Column, wider: Column, m: str, i: int) -> Column:
    """A group's quartile, drawn toward that of the wider group, if there is one, as PRIOR rows of it would draw it."""
    mine = F.coalesce(own["n"], F.lit(0))
    drawn = (mine * own[m][i] + PRIOR * wider) / (mine + PRIOR)
    return F.coalesce(drawn, own[m][i], wider)


def judge(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
    """``docs`` with their measures, base_failed and kept.

    base_failed: under 20 words, or over 30 per cent of the words in 8-word windows that the text has twice or more. kept: not
    base_failed and within the bands of characters per token, share of byte fallback and token entropy (a share of the most
    that so many tokens can have) of texts of this language, script and length. A group's quartiles are drawn toward those of its
    script and length, these toward those of its script, and these toward those of all texts, the more the fewer its texts are.
    Results don't depend on how rows are parted.

    A null text has no words. A null language is a group of its own. Repeated rows count as often as they are there. Columns
    named like a measure are replaced.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    light_batches(docs.sparkSession)
    own = docs.drop(*names, "base_failed", "kept", "__lang")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in own.columns else F.lit("")
    own = own.withColumn("__lang", lang)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    rows = own.mapInArrow(_measure(vocabulary, own.columns.index(text_col)), f"{fields}, {MEASURES}")
    if not keep_text:
        rows = rows.drop(text_col)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    rows = rows.withColumns({"base_failed": failed, "__size": F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1))))})
    rows = save(rows, "measures")
    # Groups are languages by scripts by lengths; Spark broadcasts their bands if the table is small, and joins by key if not.
    groups = {"__every": ["__all"], "__rough": ["script"], "__sized": ["script", "__size"], "__fine": ["__lang", "script", "__size"]}
    rows = rows.withColumn("__all", F.lit(1))
    joined, within = rows, F.lit(True)
    for name, keys in groups.items():
        joined = joined.join(save(_quartiles(rows, keys, name), "bands"), keys, "left")
    for m, floor in FLOORS.items():
        low, high = (F.lit(None), F.lit(None))
        for name in groups:
            low, high = (_toward(F.col(name), wider, m, i) for i, wider in ((0, low), (1, high)))
        below, above = (F.greatest(n * (high - low), F.lit(floor)) for n in SPREADS[m])
        within = within & F.col(m).between(low - below, high + above)
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("__lang", "__size", "__all", *groups)
