"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of the most frequent n-grams of a language, most frequent first.
A document is compared by the out-of-place distance: for each of its own most frequent
n-grams how far its rank is from the rank in the profile, or the length of a profile
where it has none. N-grams are one to three lower-case letters of a word, which has
a blank on both sides. They are packed into integers, 21 bits a letter, so counting is
sorting of flat arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywarden.llm.common import text_chunks
from paywarden.llm.quality_trees import held_out

# No letter has the number of the blank, so grams of one, two and three letters never share a code.
BLANK = 1
BITS = 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _plain(text: str) -> str:
    text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return f" {text.lower()} "


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of the n-grams of n = 1, 2, 3 letters, each with the text it is in, ascending by text."""
    low = [_plain(t) for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    letter = _letters()[points]
    # The first of a run of other characters stands for the run, also across two texts.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    code, text, letter = np.where(letter, points, BLANK)[keep].astype(np.int64), text[keep], letter[keep]
    pair = (code[:-1] << BITS) | code[1:]
    triple = (pair[:-1] << BITS) | code[2:]
    inner = letter[1:-1]
    return [(code[letter], text[letter]), (pair, text[1:]), (triple[inner], text[1:-1][inner])]


def top_grams(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of every text, most frequent first, the smaller code of equals; and their number per text."""
    parts = grams(texts)
    bounds = [np.searchsorted(text, np.arange(len(texts) + 1)) for _, text in parts]
    out, sizes = [np.empty(0, np.int64)], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        if bounds[0][i] == bounds[0][i + 1]:
            continue
        codes, n = np.unique(np.concatenate([c[b[i] : b[i + 1]] for (c, _), b in zip(parts, bounds)]), return_counts=True)
        out.append(codes[np.argsort(-n, kind="stable")[:length]])
        sizes[i] = len(out[-1])
    return np.concatenate(out), sizes


@dataclass(frozen=True)
class Profiles:
    """Languages, ascending; all codes of their profiles, ascending; and the rank of a code in each, `length` if absent."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], length: int) -> Profiles:
        """From (language, rank, code)."""
        languages = sorted({r[0] for r in rows}, key=lambda s: s.encode())
        place = {s: k for k, s in enumerate(languages)}
        codes = np.unique(np.array([r[2] for r in rows], np.int64))
        ranks = np.full((len(codes) + 1, len(languages)), length, np.int64)
        for s, rank, code in rows:
            ranks[np.searchsorted(codes, code), place[s]] = rank
        return Profiles(languages, codes, ranks, length)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language, and the number of its n-grams that were compared."""
        found, sizes = top_grams(texts, self.length)
        ends = np.cumsum(sizes)
        own = np.arange(len(found)) - np.repeat(ends - sizes, sizes)
        at = np.searchsorted(self.codes, found)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == found[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        there = self.ranks[at]
        apart = np.where(there == self.length, self.length, np.abs(there - own[:, None]))
        total = np.concatenate([np.zeros((1, len(self.languages)), np.int64), np.cumsum(apart, axis=0)])
        return total[ends] - total[ends - sizes], sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Nearest language (the first of equals) and 1 less the distance's share of the greatest possible; `und` and 0 without letters."""
        far, sizes = self.distances(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = far.argmin(axis=1)
        score = 1 - far[np.arange(len(texts)), best] / np.maximum(sizes * self.length, 1)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist())], np.where(sizes > 0, score, 0.0)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _count(limit: int = 1_000_000):
    """Counts of n-grams by language; what a task holds is emitted when it passes `limit` entries."""

    def rows(held: dict) -> pa.RecordBatch:
        names = [s for s, parts in held.items() for c, _ in parts for _ in range(len(c))]
        columns = [np.concatenate([np.empty(0, np.int64), *(p[k] for parts in held.values() for p in parts)]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            texts, langs = _texts(b.column(0)), b.column(1).to_pylist()
            for i, j in text_chunks(texts):
                here = sorted(set(langs[i:j]))
                of_text = np.array([here.index(s) for s in langs[i:j]])
                for codes, text in grams(texts[i:j]):
                    of_gram = of_text[text]
                    for k, s in enumerate(here):
                        held.setdefault(s, []).append(np.unique(codes[of_gram == k], return_counts=True))
                held = {s: [_merged(parts)] for s, parts in held.items()}
                if sum(len(c) for parts in held.values() for c, _ in parts) > limit:
                    yield rows(held)
                    held = {}
        yield rows(held)

    return run


def train_profiles(docs: DataFrame, length: int = 300, max_languages: int = 1_000) -> Profiles:
    """Profiles of all languages of the rows that are not held out and have one, from all their texts.

    The model is `length` numbers a language; more than `max_languages` of them are
    refused, since that column then holds something else.
    """
    learned = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = learned.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang")).mapInArrow(_count(), "lang string, code long, n long")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    rows = totals.select("lang", rank.alias("rank"), "code").where(F.col("rank") < length)
    got = rows.limit(max_languages * length + 1).collect()
    if len(got) > max_languages * length:
        raise ValueError(f"more than {max_languages} languages")
    return Profiles.of([(r["lang"], r["rank"], r["code"]) for r in got], length)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row; reads doc_id and text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(1))
            for i, j in text_chunks(texts):
                names, score = profiles.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predicted_languages(docs: DataFrame, length: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out.

    A null or empty text, or one without a letter, is `und` with score 0, and so is every
    row if nothing was learned. Rows without a language are only predicted; a null
    doc_id is not held out. Repeated rows count each. Equal distances go to the
    language that sorts first.
    """
    scored = identify(docs, train_profiles(docs, length))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
