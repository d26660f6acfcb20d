"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of at most `budget` tokens by the prefix sums of the
turns' tokens. Each window holds the conversation's first system turn, then the last turns before its own
ones as history (whole turns, up to `history` tokens), then turns of its own, at least one, however long.
Every turn is a window's own exactly once. Only a window's own assistant turns are targets; repeated ones
are masked, so each is learnt once.

The template marks a turn as <turn role="R">, a line end, the text, and </turn> with a line end. Inside
roles and texts, \\ and < become \\\\ and \\<, and in roles " becomes \\"; no control string survives
that, and reading back undoes it.

A conversation of more than `block` turns is cut into blocks, each a task's work of its own: turns are counted in
spans of 256 turn numbers, the prefix sums of these counts say in which block a span is, and a window ends where its
block does. A block gets the spans ahead of it that its history can reach into, and the conversation's first system turn.

Null texts and roles count as empty. Turns sort by number (null first), role and text, so ties have an order;
repeated rows are turns of their own. Rows with a null conversation form one. Empty tables give empty
results. Other columns are not read. A task streams the turns of its blocks in order and holds one window and its
history. Turns of one number are never parted, so a block is longer where more than `block` turns have the same one. Only
chat_facts()'s digests of a conversation are one task's, which streams what was read back in other tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import written

BUDGET, HISTORY = 512, 128
#: Turns of a block, and, as a power of two, turn numbers of a span.
BLOCK, SPAN = 4096, 8
TARGET = "assistant"
#: Tokens of a text: words and single other signs.
TOKEN = re.compile(r"\w+|[^\w\s]")
TURN = re.compile(r'<turn role="([^"\\]*(?:\\.[^"\\]*)*)">\n([^<\\]*(?:\\.[^<\\]*)*)</turn>\n', re.DOTALL)


def tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


Turn = tuple[str, str]


def windows(turns: Iterable[Turn], budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = tokens, ahead: Iterable[Turn] = (), system: Turn | None = None) -> Iterator[tuple[list[Turn], int]]:
    """(turns, how many of them at the start are repeated) of each window. `ahead` are turns before these, `system` the first system turn if it is before these: the same object where it is among `ahead`."""
    system_size = count(system[1]) + 1 if system else 0
    before: deque[tuple[Turn, int]] = deque()  # turns that may be repeated, with the prefix sum ahead of each
    total = 0
    for turn in ahead:
        before.append((turn, total))
        total += count(turn[1]) + 1
    own: list[Turn] = []
    for turn in turns:
        size = count(turn[1]) + 1
        if own and total + size - base > room:
            yield head + own, len(head)
            own = []
        if not own:
            while before and total - before[0][1] > history:
                before.popleft()
            head = ([system] if system else []) + [t for t, _ in before if t is not system]
            room, base = budget - system_size - (total - before[0][1] if before else 0), total  # base: the prefix sum where the window's own turns begin
        own.append(turn)
        before.append((turn, total))
        while len(before) > 1 and total - before[1][1] > history:
            before.popleft()
        total += size
        if system is None and turn[0] == "system":
            system, system_size = turn, size
    if own:
        yield head + own, len(head)


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[int], list[int]]:
    """The formatted text, and where (code points) its targets begin and end."""
    parts, begins, ends, at = [], [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f'<turn role="{escape(role).replace(chr(34), chr(92) + chr(34))}">\n', escape(text)
        if i >= repeated and role == TARGET:
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn that the formatted text marks."""
    found, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batched(found: Iterator[tuple], schema: pa.Schema, most: int = 2000, most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows or, if that is less, of little more than so many characters."""
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in found:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) == most or chars >= most_chars:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def spans_of_long(turns: DataFrame, block: int, history: int) -> DataFrame:
    """(conv, no_conv, span, own_block, reach, last_block) of the spans of conversations that have more than `block` turns: their block, and the last block whose history can reach into them. Written, so that its size is known."""
    counts = turns.groupBy("conv", "no_conv", "span").agg(F.count("*").alias("here"))
    w = W.partitionBy("conv", "no_conv")
    before = F.coalesce(F.sum("here").over(w.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"before": before, "all": F.sum("here").over(w)}).where(F.col("all") > block)
    counts = counts.withColumn("own_block", F.floor(F.col("before") / block)).withColumn("last_block", F.max("own_block").over(w))
    reach = F.least("last_block", F.greatest("own_block", F.floor((F.col("before") + F.col("here") + history - 1) / block)))
    return written(counts.select("conv", "no_conv", "span", "own_block", reach.alias("reach"), "last_block"), "chat-spans")


def in_blocks(conversations: DataFrame, block: int, history: int) -> DataFrame:
    """(conv_id, block, place, turn, role, text), sorted inside partitions: place is 0 for the conversation's first system turn, which each block but the first has a copy of, 1 for copies of turns ahead, and 2 for a block's own turns."""
    turns = conversations.selectExpr("coalesce(cast(conv_id as long), 0) conv", "cast(conv_id as long) is null no_conv", "cast(turn as long) turn", "role", "text")
    turns = turns.withColumn("span", F.coalesce(F.shiftright("turn", SPAN), F.lit(-(2**62))))  # null turns come first
    spans = spans_of_long(turns, block, history)
    placed = turns.join(spans, ["conv", "no_conv", "span"], "left").withColumn("block", F.explode(F.expr("sequence(coalesce(own_block, 0), coalesce(reach, 0))")))
    placed = placed.withColumn("place", F.when(F.coalesce("own_block", F.lit(0)) == F.col("block"), 2).otherwise(1))
    first = turns.where(F.col("role") == "system").join(spans.select("conv", "no_conv", "last_block").distinct(), ["conv", "no_conv"]).groupBy("conv", "no_conv", "last_block").agg(F.min(F.struct("turn", "text")).alias("first"))
    first = first.where("last_block > 0").select("conv", "no_conv", F.explode(F.expr("sequence(1, last_block)")).alias("block"), F.lit(0).alias("place"), "first.turn", F.lit("system").alias("role"), "first.text")
    cols = ["conv", "no_conv", "block", "place", "turn", "role", "text"]
    rows = placed.select(cols).union(first.select(cols)).repartition("conv", "no_conv", "block").sortWithinPartitions(*cols)
    return rows.select(F.expr("if(no_conv, null, conv)").alias("conv_id"), *cols[2:])


def block_windows(turns: Iterator[tuple], budget: int, history: int) -> Iterator[tuple[list[Turn], int]]:
    """windows() of the rows of one block, as in_blocks() sorts them."""
    first: tuple | None = None
    system: Turn | None = None
    met = False
    ahead: deque[Turn] = deque(maxlen=max(history, 1))  # a turn has one token or more
    order = lambda row: tuple((False,) if x is None else (True, x) for x in row)  # noqa: E731  Spark's, null first
    for _, _, place, *row in turns:
        turn = (row[1] or "", row[2] or "")
        if place == 0:
            first, system = row, turn
        elif place == 1:
            if row == first and not met:
                turn, met = system, True
            ahead.append(turn)
        else:
            if first is not None and order(first) >= order(row):  # not ahead of the block; equal rows may be either
                system = None
            own = ((r[4] or "", r[5] or "") for r in turns)
            yield from windows(chain([turn], own), budget, history, tokens, ahead, system)


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, window, n_turns, n_repeated, formatted, loss_begin, loss_end) of each window, windows numbered in their block."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("formatted", pa.string()), ("loss_begin", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (conv, number), turns in groupby(rows(batches), key=lambda r: r[:2]):
                for i, (window, repeated) in enumerate(block_windows(turns, budget, history)):
                    yield conv, number, i, len(window), repeated, *render(window, repeated)

        return batched(found(), schema)

    return in_blocks(conversations, block, history).mapInArrow(cut, "conv_id long, block long, window int, n_turns int, n_repeated int, formatted string, loss_begin array<int>, loss_end array<int>")


def chat_facts(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their texts wherever they are; only the digests take a conversation's windows in order, in one task that holds one at a time."""
    said_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("turns", pa.int64()), ("said", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, block, window, repeated, text, begins, ends in rows(batches):
                own = parse(text)[repeated:]
                loss = "".join(unescape(text[a:b]) for a, b in zip(begins, ends, strict=True))
                yield conv, block, window, len(own), "".join(f"{role}\n{said}\n" for role, said in own), loss, len(text)

        return batched(found(), said_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, parts in groupby(rows(batches), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = total = windows_seen = 0
                for _, own, said, learnt, size in parts:
                    turns.update(said.encode())
                    loss.update(learnt.encode())
                    n, chars, total, windows_seen = n + own, chars + len(learnt), total + size, windows_seen + 1
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, windows_seen

        return batched(found(), schema)

    said = formatted.select("conv_id", "block", "window", "n_repeated", "formatted", "loss_begin", "loss_end").mapInArrow(read, "conv_id long, block long, window int, turns long, said string, loss string, chars long")
    in_order = said.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").drop("block", "window")
    return in_order.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
