"""Token ids as directly addressable codes: any token by position, without decoding a block.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of
every id that has one; a bitmap beside it marks ids that go on in level k + 1. Where
an id goes on is a rank in that bitmap: a directory counts the marks before each
block of 512 bits, so a lookup costs one directory entry and at most eight words a
level.

One segment, little-endian:
    "DAC1", u32 levels, u64 ids
    per level: u64 codes | codes u8, padded to 8 | bitmap, padded to 64 bytes | directory u32 per 512 bits, padded to 8
The last level has no bitmap or directory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywarden.llm.common import blank, shared_folder

MAGIC = b"DAC1"
BLOCK = 512


def _padded(raw: bytes, to: int = 8) -> bytes:
    return raw + b"\0" * (-len(raw) % to)


def encode_codes(ids: np.ndarray) -> bytes:
    """The segment of an array of ids below 2^32."""
    left = np.ascontiguousarray(ids, dtype=np.uint32)
    out, levels = [], 0
    while levels == 0 or len(left):
        levels += 1
        more = left > 0xFF
        out += [np.uint64(len(left)).tobytes(), _padded((left & 0xFF).astype(np.uint8).tobytes())]
        if not more.any():
            break
        bits = _padded(np.packbits(more, bitorder="little").tobytes(), BLOCK // 8)
        counts = np.bitwise_count(np.frombuffer(bits, dtype=np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        out += [bits, _padded(before.tobytes())]
        left = left[more] >> 8
    return MAGIC + np.uint32(levels).tobytes() + np.uint64(len(ids)).tobytes() + b"".join(out)


class Codes:
    """A segment opened for reading; arrays are views of its bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        levels, self.n = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0])
        self.levels, at = [], 16
        for k in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            codes = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n + (-n % 8)
            bits = before = None
            if k + 1 < levels:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(raw, np.uint64, blocks * BLOCK // 64, at)
                at += blocks * BLOCK // 8
                before = np.frombuffer(raw, np.uint32, blocks, at)
                at += blocks * 4 + (blocks * 4) % 8
            self.levels.append((codes, bits, before))

    def __getitem__(self, i: int) -> int:
        """The id at position i, by ranks alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for codes, bits, before in self.levels:
            value |= int(codes[i]) << shift
            shift += 8
            if bits is None or not int(bits[i // 64]) >> (i % 64) & 1:
                break
            first = i // BLOCK * (BLOCK // 64)
            rank = int(before[i // BLOCK]) + int(np.bitwise_count(bits[first : i // 64]).sum())
            i = rank + (int(bits[i // 64]) & ((1 << (i % 64)) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = self.levels[0][0].astype(np.uint32)
        at = None
        for k in range(1, len(self.levels)):
            bits = self.levels[k - 1][1]
            marks = np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(self.levels[k - 1][0])].view(bool)
            at = np.flatnonzero(marks) if at is None else at[marks]
            out[at] |= self.levels[k][0].astype(np.uint32) << (8 * k)
        return out


# Letters whose lower case and normal form are one code point each, and ASCII marks behind
# them (no apostrophe, which can begin a word of its own): such a piece is one word of the
# model, or two with the run of marks.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(_MARKS)}]*")
_BORDER = re.compile(f"([a-zß-öø-ÿ])([{re.escape(_MARKS)}])")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells the plain letters that are not ASCII."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    spelt = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)} | {1: spelt[1]}


class WordCache(dict):
    """Ids of blank-separated pieces of text, found once by the tokenizer and kept while they are in use.

    The tokenizer drops white space, and neither its normaliser nor its merges look
    across a blank or line feed, so the ids of a text are those of its pieces in
    order. New pieces go to the tokenizer in lines of many, parted by a control
    character whose id marks where each ends; pieces that hold that character go
    alone. Plain words skip the normaliser and the word pattern, which would leave
    them as they are. When the cache is full, pieces that were not used more than
    twice since the last time leave it. Arrow splits the texts and finds the distinct
    pieces of a chunk, so only those are looked up in Python.
    """

    LIMIT = 400_000
    LINE = 256
    BLOCK = 64 * LINE
    PART = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.lean = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelling = _byte_letters()
        part = self._ids(self.tokenizer, [self.PART])[0]
        self.part_id = part[0] if len(part) == 1 else None
        # The short cut holds only for a model that spells and parts plain words alike both ways.
        probe = ["Étude", "straße,", "The.", "THE!!", "of%%%", "a(&"]
        self.plain = self.part_id is not None and self._parted(self.lean, probe)[1].tolist() == sum(self._ids(self.tokenizer, probe), [])
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.empty(0, np.uint32)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_spelt(self, line: str) -> str:
        """A line of plain words as the vocabulary spells it: no spelling holds a letter that has one."""
        line = _BORDER.sub(r"\1 \2", line.lower())
        for c in {self.PART} if line.isascii() else set(line):
            if c > "\x7f" or c == self.PART:
                line = line.replace(c, self.spelling[ord(c)])
        return line

    def _parted(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them."""
        end = f" {self.PART} "
        lines = [end.join(pieces[k : k + self.LINE]) + end for k in range(0, len(pieces), self.LINE)]
        if tokenizer is self.lean:
            lines = [self._bytes_spelt(x) for x in lines]
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(r, np.uint32) for r in self._ids(tokenizer, lines))])
        ends = np.flatnonzero(ids == self.part_id)
        return np.diff(np.concatenate([[-1], ends])) - 1, ids[ids != self.part_id]

    def _learn(self, new: list[str]) -> None:
        """Give each new piece a number and its ids: plain words first, the odd ones last."""
        if self.part_id is None:
            plain, usual, odd = [], [], new
        else:
            is_plain = _PLAIN.fullmatch if self.plain else lambda p: None
            plain, rest = list(filter(is_plain, new)), list(filterfalse(is_plain, new))
            usual, odd = [p for p in rest if self.PART not in p], [p for p in rest if self.PART in p]
        self.update(zip(chain(plain, usual, odd), count(len(self))))
        found = [self._parted(self.lean, plain[i : i + self.BLOCK]) for i in range(0, len(plain), self.BLOCK)]
        found += [self._parted(self.tokenizer, usual[i : i + self.BLOCK]) for i in range(0, len(usual), self.BLOCK)]
        if odd:
            ids = self._ids(self.tokenizer, odd)
            found.append((np.array([len(x) for x in ids]), np.array(sum(ids, []), np.uint32)))
        lengths = np.concatenate([n for n, _ in found])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *(x for _, x in found)])
        self.used = np.pad(self.used, (0, len(new)))

    def _shrink(self) -> None:
        kept = [p for p, n in zip(self, self.used.tolist()) if n > 2]
        at = np.flatnonzero(self.used > 2)
        starts, lengths, flat = self.starts[at], self.lengths[at], self.flat
        self._reset()
        if len(kept) < self.LIMIT // 2:
            self.update(zip(kept, count()))
            self.starts, self.lengths, self.flat = np.cumsum(lengths) - lengths, lengths, flat[_spread(starts, lengths)]
            self.used = np.zeros(len(kept), np.int64)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        if len(self) > self.LIMIT:
            self._shrink()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        sizes = split.value_lengths().to_numpy(zero_copy_only=False)
        found = split.flatten().dictionary_encode()
        pieces = found.dictionary.to_pylist()
        codes = np.fromiter(map(self.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            missed = [pieces[i] for i in missing.tolist()]
            self._learn(missed)
            codes[missing] = np.fromiter(map(self.__getitem__, missed), np.int64, len(missed))
        codes = codes[found.indices.to_numpy()]
        self.used += np.bincount(codes, minlength=len(self))
        lengths = self.lengths[codes]
        ids = self.flat[_spread(self.starts[codes], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(bounds)


def _runs(sizes: np.ndarray, limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of whole texts of about `limit` bytes."""
    run = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if j > i)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_caches: dict[str, WordCache] = {}


def _cache(tokenizer: str) -> WordCache:
    # A module's function is sent to tasks by name, so all tasks of a worker share the module's cache.
    if tokenizer not in _caches:
        _caches[tokenizer] = WordCache(tokenizer)
    return _caches[tokenizer]


SEGMENT = "part int, segment int, before long, doc_ids array<long>, lengths array<int>, payload binary"


def write_token_codes(docs: DataFrame, tokenizer: str, end_id: int, folder: str, segment_tokens: int = 1 << 18) -> None:
    """Encode texts and write their ids in ascending doc_id order.

    `folder`/segments holds the segments (whole documents, about `segment_tokens`
    ids each, uncompressed so that a reader can address them in place) and
    `folder`/parts where each part begins among all ids. A null text has only the
    end id; a null id comes first; rows with one id follow each other in text order.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _cache(tokenizer)
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        names, ids, lengths, held = [], [], [], 0

        def flush():
            nonlocal segment, before, names, ids, lengths, held
            raw = encode_codes(np.concatenate(ids))
            row = [[part], [segment], [before], [names], [np.concatenate(lengths)], [raw]]
            segment, before, names, ids, lengths, held = segment + 1, before + held, [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))],
                ["part", "segment", "before", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in _runs(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                found, n = cache.encode(texts.slice(i, j - i))
                ids.append(np.insert(found, np.cumsum(n), np.uint32(end_id)))
                lengths.append((n + 1).astype(np.int32))
                names += doc_ids[i:j]
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield flush()
        if names:
            yield flush()

    ordered = (
        docs.select("doc_id", blank("text").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    writer = ordered.mapInArrow(encode, SEGMENT).write.option("compression", "none")
    writer.option("parquet.enable.dictionary", "false").parquet(f"{folder}/segments")
    # One row per part: their number is that of the tasks, whatever they hold.
    totals = (
        spark.read.parquet(f"{folder}/segments").select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        .groupBy("part").agg(F.sum("n").alias("n"))
    )
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    totals.select("part", before.alias("first"), "n").coalesce(1).write.parquet(f"{folder}/parts")


def read_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with their place among all ids: SEGMENT's columns and `first`, of the part."""
    parts = spark.read.parquet(f"{folder}/parts").select("part", "first")
    return spark.read.schema(SEGMENT).parquet(f"{folder}/segments").join(F.broadcast(parts), "part")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 of its ids as u32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = memoryview(Codes(r["payload"]).ids().astype("<u4").tobytes())
                n = np.asarray(r["lengths"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                starts = r["first"] + r["before"] + ends - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read_token_codes(spark, folder).select("first", "before", "doc_ids", "lengths", "payload").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_at(spark: SparkSession, folder: str, position: int) -> int:
    """The id at a position among all ids: one segment is read, by its directory entry."""
    segs = read_token_codes(spark, folder).withColumn("start", F.col("first") + F.col("before"))
    row = segs.where(F.col("start") <= position).orderBy(F.desc("start")).select("start", "payload").first()
    return Codes(bytes(row["payload"]))[position - row["start"]]


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the codes to a new shared folder and read the files back."""
    folder = shared_folder(docs.sparkSession)
    write_token_codes(docs, tokenizer, end_id, folder)
    return token_digests(docs.sparkSession, folder)
