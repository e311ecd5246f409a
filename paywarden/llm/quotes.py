"""Quotation linking: nested quotes of messages, joined to the messages they quote.

A message is cut into runs of lines of one quote level. Quoted passages (a run, its
paragraphs, its lines) are hashed after normalising and joined, within the
conversation, to the first message that has the passage as its own words. What is left
of a message without quotes is its body; messages follow in reply order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywarden.llm.common import blank, components, written

_PREFIX = re.compile(r"((?:[ \t]*[A-Z]{0,3}>)+)[ \t]?(.*)", re.S)
# How mail programs announce a quote.
_SAYS = re.compile(r"(?:on|am|le|el)\b.{4,200}\b(?:wrote|schrieb\b.{0,80}|a écrit|écrit|escribió)\s*:", re.I)
_BELOW = re.compile(r"-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,}", re.I)
_HEAD = re.compile(r"(?:from|to|cc|sent|date|subject|von|an|gesendet|betreff|de|à|objet|para|enviado|asunto)\s*:", re.I)
WHOLE, PARAGRAPH, LINE = 3, 2, 1


def quote_levels(text: str) -> list[tuple[int, str]]:
    """(level, line) of the lines of a message, markers taken off; announcing lines are left out."""
    out: list[tuple[int, str]] = []
    base, heading = 0, False
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if _BELOW.fullmatch(line.strip()):
            base, heading = base + 1, True
            continue
        if heading and (_HEAD.match(line) or not line.strip()):
            continue
        heading = False
        m = _PREFIX.fullmatch(line)
        out.append((base + m[1].count(">"), m[2]) if m else (base, line))
    # Level of the next line that is not blank or has another level, found from the end; -1 if none.
    below = [-1] * (len(out) + 1)
    for k in range(len(out) - 2, -1, -1):
        level, line = out[k + 1]
        below[k] = below[k + 1] if level == out[k][0] and not line.strip() else level
    keep = []
    for k, (level, line) in enumerate(out):
        # "On ... wrote:", in one or two lines, right above a deeper quote.
        last = below[k] > level and line.rstrip().endswith(":")
        if last and _SAYS.fullmatch(line.strip()):
            continue
        if last and keep and keep[-1][0] == level and _SAYS.fullmatch(f"{keep[-1][1].strip()} {line.strip()}"):
            keep.pop()
            continue
        keep.append((level, line))
    return keep


def normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def passages(lines: list[str]) -> dict[int, int]:
    """Hash to kind of the passages of a run: itself, its paragraphs, its lines; the largest kind of equal ones."""
    found = [(LINE, x) for x in lines]
    found += [(PARAGRAPH, p) for p in re.split(r"\n[ \t]*\n", "\n".join(lines))]
    found.append((WHOLE, "\n".join(lines)))
    out: dict[int, int] = {}
    for kind, x in found:
        if x := normal(x):
            out[xxhash.xxh3_64_intdigest(x) - (1 << 63)] = kind
    return out


def parse_message(text: str) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """(body, hashes of its own passages, quoted passages as (run, level, kind, hash))."""
    lines = quote_levels(text)
    runs: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line)
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(x for level, x in lines if level == 0)).strip()
    quoted = [
        (k, level, kind, h) for k, (level, run) in enumerate(runs) if level for h, kind in passages(run).items()
    ]
    return body, list(passages(body.split("\n"))), quoted


_PARSED = "conv_id long, turn long, role string, body string, own array<long>, quotes array<struct<run:int,level:int,kind:int,hash:long>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("run", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64())]))
    for batch in batches:
        got = [parse_message(t) for t in batch.column(3).to_pylist()]
        quotes = [[dict(zip(("run", "level", "kind", "hash"), q)) for q in x[2]] for x in got]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in got], pa.string()),
             pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array(quotes, quote)],
            ["conv_id", "turn", "role", "body", "own", "quotes"],
        )


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, parent_turn, thread_turn, position of every message.

    n_quotes counts quoted runs and n_linked those with a passage of an earlier
    message. The parent is the message that the shallowest, then largest linked
    passage comes from, the latest of equal ones; a message without a linked quote
    opens a thread. Reply order is by thread (its first turn), then turn; position
    counts from 1 in the conversation. A null text is empty; a message without
    conv_id or turn belongs to no conversation and has null links and position;
    messages that share conv_id and turn share their links and follow each other by
    role and body.
    """
    raw = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        blank("text").alias("text"),
    )
    parsed = written(raw.mapInArrow(_parse, _PARSED))
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    # One row per passage of a conversation, combined before the shuffle; the quotes of a hot one may be split.
    own = placed.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))
    hits = quotes.join(own, ["conv_id", "hash"]).where("first < turn")
    links = written(
        hits.groupBy("conv_id", "turn").agg(
            F.max(F.struct((-F.col("level")).alias("near"), "kind", "first")).alias("best"),
            F.max("run").alias("last_run"), F.collect_set("run").alias("runs"),
        ).select("conv_id", "turn", F.col("best.first").alias("parent_turn"), F.size("runs").alias("n_linked"))
    )
    # A thread is a component of the parent links, and its smallest message the first.
    message = lambda turn: F.struct("conv_id", F.col(turn).alias("turn"))
    threads = components(links.select(message("turn").alias("a"), message("parent_turn").alias("b"))).select(
        F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), F.col("component.turn").alias("thread")
    )
    runs = F.size(F.array_distinct(F.transform("quotes", lambda q: q["run"])))
    full = placed.join(links, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", runs.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_turn", F.coalesce("thread", "turn").alias("thread_turn"),
    )
    # Numbered part by part of a global order, so a conversation of any size is spread over many tasks.
    order = ["conv_id", "thread_turn", "turn", "role", "body"]
    parts = written(written(full).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:]))
    sizes = parts.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    out = parts.withColumn("inside", inside).join(before, ["conv_id", "part"])
    out = out.select(*order[:2], "turn", "role", "body", "n_quotes", "n_linked", "parent_turn", (F.col("before") + F.col("inside")).alias("position"))
    none = F.lit(None).cast("long")
    alone = parsed.where("conv_id IS NULL OR turn IS NULL").select(
        "conv_id", none.alias("thread_turn"), "turn", "role", "body", runs.alias("n_quotes"), F.lit(0).alias("n_linked"),
        none.alias("parent_turn"), none.alias("position"),
    )
    return out.union(alone).select(
        "conv_id", "turn", "role", "body", "n_quotes", "n_linked", "parent_turn", "thread_turn", "position"
    )
