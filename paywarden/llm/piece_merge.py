"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A text is normalised as the model says (blank to U+2581, one in front), cut into words
where no piece of the vocabulary can reach across, and every distinct word of a
chunk is merged once: all words lie in one flat array of symbols. A round takes the
lowest pair rank of each word (a segmented minimum), merges its leftmost
non-overlapping occurrences at the same time, compacts the array and looks up only
the pairs that changed; words without a pair leave. Merging at the same time equals
the library's queue as long as no merge makes a pair of equal or lower rank; where one
does, the word's later occurrences wait for the next round.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from paywarden.llm.common import text_chunks

MARK = "▁"
NONE = np.int32(2**31 - 1)

# A broken byte becomes one replacement character, as in the library's decoder.
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """Pieces, ranks and pair table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        # A symbol is a piece, or size + code point for a character that is no piece.
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda s: normal.get(s, n + ord(s) if len(s) == 1 else -1)
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a >= 0 and b >= 0:
                    pairs[a * self.STRIDE + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = np.append(self.rank_of[self.made], NONE)
        self.made = np.append(self.made, np.int32(-1))
        # Cut before a run of marks, and around line feeds, if no piece reaches across.
        inside = any(MARK in p.lstrip(MARK) or "\n" in p for p in normal if len(p) > 1)
        self.across = inside
        self.words = re.compile(".+" if inside else f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+", re.S)
        raw = [self._surface(sp, i, p) for i, p in enumerate(pieces)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([not s and p.startswith(MARK) for p, s in zip(pieces, special)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])

    STRIDE = 1 << 22

    @staticmethod
    def _surface(sp, i: int, piece: str) -> bytes:
        if sp.is_control(i):
            return b""
        if sp.is_unknown(i):
            return " ⁇ ".encode()
        if sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; the last place is that of no pair."""
        keys = left.astype(np.int64) * self.STRIDE + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.full(len(keys), 0)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in one array, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.of_char[points]
        word = np.repeat(np.arange(len(words)), lengths)
        at = np.full(len(sym), len(self.keys))
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            at[inner] = self.pair(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            rank = self.rank[at]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            low = np.repeat(best, sizes)
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, at, rank, low = sym[live], word[live], at[live], rank[live], low[live]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == low)
            # Every other one of a run of overlapping occurrences, from its left end.
            first = np.concatenate([[True], np.diff(p) != 1])
            run = np.flatnonzero(first)[np.cumsum(first) - 1]
            p = p[(np.arange(len(p)) - run) % 2 == 0]
            new = self.made[at[p]]
            # Pairs that a merge makes, seen with the merges left of it done and those right of it not.
            before = np.concatenate([[-9], p[:-1]])
            left = np.where(before == p - 2, np.concatenate([[-1], new[:-1]]), sym[p - 1])
            has_left = (p > 0) & (word[p - 1] == word[p])
            beyond = np.minimum(p + 2, len(sym) - 1)
            has_right = (p + 2 < len(sym)) & (word[beyond] == word[p])
            lowest = np.full(len(p), NONE)
            lowest[has_left] = self.rank[self.pair(left[has_left], new[has_left])]
            lowest[has_right] = np.minimum(lowest[has_right], self.rank[self.pair(new[has_right], sym[beyond[has_right]])])
            stops = (lowest <= low[p]).astype(np.int64)
            earlier = np.cumsum(stops) - stops
            head = np.concatenate([[True], word[p][1:] != word[p][:-1]])
            base = earlier[np.flatnonzero(head)[np.cumsum(head) - 1]]
            go = earlier == base
            p, new = p[go], new[go]
            sym[p] = new
            stay = np.ones(len(sym), bool)
            stay[p + 1] = False
            q = (np.cumsum(stay) - 1)[p]
            sym, word, at = sym[stay], word[stay], at[stay]
            near = np.zeros(len(sym), bool)
            near[q] = near[q[q > 0] - 1] = True
            changed = np.flatnonzero(near)
            at[changed] = len(self.keys)
            changed = changed[changed + 1 < len(sym)]
            changed = changed[word[changed] == word[changed + 1]]
            at[changed] = self.pair(sym[changed], sym[changed + 1])
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: str) -> np.ndarray:
        """One word by a queue: for words so long that rounds with few merges would cost a square."""
        sym = self.of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        table = {k: (int(self.rank[i]), int(self.made[i])) for i, k in enumerate(self.keys.tolist())} if not hasattr(self, "_table") else self._table
        self._table = table
        queue = []

        def offer(i):
            j = after[i]
            if j < n and (found := table.get(sym[i] * self.STRIDE + sym[j])):
                heapq.heappush(queue, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, a, b, made = heapq.heappop(queue)
            if not (alive[i] and alive[j] and after[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s, a in zip(sym, alive) if a], np.int32)

    LONG = 1024

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has; unknown characters become bytes."""
        long = [i for i, w in enumerate(words) if len(w) > self.LONG]
        if long:
            parts = [None] * len(words)
            for i in long:
                parts[i] = self.merge_long(words[i])
            rest = [i for i, p in enumerate(parts) if p is None]
            sym, sizes = self.merge_words([words[i] for i in rest])
            for i, s in zip(rest, np.split(sym, np.cumsum(sizes)[:-1])):
                parts[i] = s
            sym, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        else:
            sym, sizes = self.merge_words(words)
        unknown = sym >= self.size
        if unknown.any():
            points = np.where(unknown, sym - self.size, 0)
            width = np.where(unknown, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
            raw = np.frombuffer("".join(map(chr, points[unknown].tolist())).encode(), np.uint8)
            out = np.repeat(sym, width)
            out[np.repeat(unknown, width)] = self.byte_ids[raw]
            ends = np.concatenate([[0], np.cumsum(width)])
            bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
            return out, np.diff(bounds)
        return sym, sizes

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id lists that lie one after another in `ids`."""
        width = self.piece_at[ids + 1] - self.piece_at[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.repeat(self.piece_at[ids] - (ends - width), width) + np.arange(total)].tobytes()
        at = np.concatenate([[0], ends])
        out, i = [], 0
        for n in counts.tolist():
            a, j = i, i + n
            while a < j and self.silent[ids[a]]:
                a += 1
            text = raw[at[a] : at[j]]
            # The blank that the encoder put in front goes.
            if a < j and self.marked[ids[a]]:
                text = text[1:]
            out.append(text.decode("utf-8", "each_byte"))
            i = j
        return out


class PieceEncoder(dict):
    """Words to places in a growing list of their ids; emptied when it grows past LIMIT."""

    LIMIT = 400_000

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.starts, self.flat, self.decimal = np.zeros(1, np.int64), np.empty(0, np.int32), []

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = k = len(self)
        return k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in one array, their number per text, and per text its ids in decimal, joined by commas."""
        if len(self) > self.LIMIT:
            self.reset()
        find = self.model.words.findall
        split = [list(map(self.__getitem__, find(MARK + t.replace(" ", MARK)))) if t else [] for t in texts]
        if self.waiting:
            ids, n = self.model.encode_words(self.waiting)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
            self.flat, self.waiting = np.concatenate([self.flat, ids]), []
            names, i = list(map(str, ids.tolist())), 0
            for k in n.tolist():
                self.decimal.append(",".join(names[i : i + k]))
                i += k
        decimal = [",".join(map(self.decimal.__getitem__, s)) for s in split]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((k for s in split for k in s), np.int64, int(sizes.sum()))
        starts, lengths = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(bounds), decimal


class PieceCounter(dict):
    """Blank-separated parts of texts to their number of ids; emptied when it grows past LIMIT.

    Arrow cuts the texts and finds the distinct parts of a chunk; only those are looked
    up in Python, and only new ones are merged.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str):
        self.model = PieceModel(path)

    def parts(self, texts: pa.Array) -> pa.ListArray:
        """The parts of each text behind a first empty one: a part begins at a blank or at a run of line feeds.

        Of a run of blanks the first one parts, the others are marks in front of the next
        part. A part without a line feed in front stands for itself behind a mark.
        """
        if self.model.across:
            return pc.split_pattern(pc.binary_join_element_wise("\0", texts, ""), "\0", max_splits=1)
        cut = pc.binary_join_element_wise(" ", texts, "")
        for old, new in (("  ", f" {MARK}"), (f"{MARK} ", MARK * 2), ("\n", " \n"), ("\n \n", "\n\n"), ("\n \n", "\n\n")):
            cut = pc.replace_substring(cut, old, new)
        return pc.split_pattern(cut, " ")

    def _learn(self, new: list[str]) -> None:
        find = self.model.words.findall
        words = [find(p if p.startswith("\n") and not self.model.across else MARK + p.replace(" ", MARK)) for p in new]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = self.model.encode_words([w for ws in words for w in ws])[1]
        self.update(zip(new, np.add.reduceat(n, np.cumsum(sizes) - sizes).tolist()))

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Number of ids of each text, as `PieceEncoder.encode` gives them."""
        if len(self) > self.LIMIT:
            self.clear()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = self.parts(column)
        sizes = split.value_lengths().to_numpy(zero_copy_only=False)
        found = split.flatten().dictionary_encode()
        parts = found.dictionary.to_pylist()
        n = np.fromiter(map(self.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(n < 0)
        if len(missing):
            new = [parts[i] for i in missing.tolist()]
            self._learn(new)
            n[missing] = np.fromiter(map(self.__getitem__, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(n[found.indices.to_numpy()])])
        # The first part is the beginning of the text, which is no part of its own.
        return np.where(pc.binary_length(column).to_numpy(zero_copy_only=False) > 0, total[ends] - total[ends - sizes + 1], 0)


_counters: dict[str, PieceCounter] = {}
_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _by_text(make):
    """A mapInArrow function that applies make(texts) to the texts (second column) of bounded chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in text_chunks(texts):
                columns = make(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns.values()], ["doc_id", *columns])

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text as the model encodes it; null and empty texts have no ids."""

    def make(texts):
        ids, n, _ = _encoder(model).encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
        return {"ids": lists}

    return docs.selectExpr("doc_id", "text").mapInArrow(_by_text(make), "doc_id long, ids array<int>")


def count_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n) of every row: the number of ids of its text; the ids themselves are not made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PieceCounter(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            # Whole texts of about four megabytes at a time.
            run_of = np.cumsum(sizes, dtype=np.int64) // 4_000_000
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
            for i, j in zip(cuts, cuts[1:]):
                n = _counters[model].count(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64())], ["doc_id", "n"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, "doc_id long, n long")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches):
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = _encoder(model).model.decode_many(flat, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per row of `docs`, whatever its id; a null text counts as empty. The ids
    never leave the task, so nothing is shuffled.
    """

    def make(texts):
        encoder = _encoder(model)
        ids, n, decimal = encoder.encode(texts)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        decoded = encoder.model.decode_many(ids, n)
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(map(sha, decimal)), "decoded_sha256": pa.array(map(sha, decoded))}

    return docs.selectExpr("doc_id", "text").mapInArrow(
        _by_text(make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
