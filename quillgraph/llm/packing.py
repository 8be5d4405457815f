"""Filling containers of fixed capacity with items: bounded-space online packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bpe import Encoder, rank_file
from quillgraph.plans.skew import join_unique
from quillgraph.session import written

#: Open windows of one partition.
WINDOWS = 128
#: Partitions of one round whose leftovers meet in one task of the next round.
FAN_IN = 32


class Windows:
    """At most `most` open windows; an item goes where it leaves least room, and if it fits nowhere the fullest is closed."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        """The window of an item of at most the capacity."""
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            if len(self.room) >= self.most:
                self.closed.append(self.room.pop(0)[1])
            window, left = self.next, self.capacity
            self.next += 1
        else:
            left, window = self.room.pop(at)
        left -= size
        if left:
            insort(self.room, (left, window))
        else:
            self.closed.append(window)
        return window


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens of every row; 0 for null and empty texts."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            sizes = [encoder.count(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def pack(items: DataFrame, key: str, size: str, capacity: int, windows: int = WINDOWS) -> DataFrame:
    """Where each item lies: key, piece (0-based), start, n, container_id (unique), over the columns key and size.

    An item is cut only if it is larger than the capacity: into full containers and one rest, which is packed like
    other items. Each partition keeps a fixed number of windows open, so memory doesn't grow with the data; closed
    windows are final. The windows still open at a partition's end are leftovers: FAN_IN partitions' leftovers meet in
    one task of the next round, which merges whole windows, largest first, under the same bound of open windows, and
    hands on what is then open, until one task is left. So no task, the last one included, takes more than
    FAN_IN x windows leftovers. Items of size 0 (or null) take no room and lie in some window. No rows give no rows;
    equal keys are separate items. Each round is a written table, so a lost executor repeats only its own tasks.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        state = Windows(capacity, windows, base)
        for batch in batches:
            rows, keys = [], batch.column(0)
            for n, length in enumerate(batch.column(1).to_pylist()):
                length, start, piece = length or 0, 0, 0
                while length - start > capacity:
                    rows.append((n, piece, start, capacity, state.next))
                    state.closed.append(state.next)
                    state.next += 1
                    piece, start = piece + 1, start + capacity
                rows.append((n, piece, start, length - start, state.place(length - start)))
            if rows:
                at, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:]), pa.nulls(len(at), pa.int64())], ["key", "piece", "start", "n", "window", "room"])
        if state.room:
            left, window = zip(*state.room, strict=True)
            count = len(left)
            yield pa.RecordBatch.from_arrays([pa.nulls(count, keys.type), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()), pa.array(window, pa.int64()), pa.array(left, pa.int64())], ["key", "piece", "start", "n", "window", "room"])

    placed = written(items.select(key, size).mapInArrow(first, f"key {kind}, piece int, start bigint, n bigint, window bigint, room bigint"), "placed")
    open_ = placed.filter(F.col("room").isNotNull()).select("window", "room")
    rows = placed.filter(F.col("room").isNull()).drop("room")
    parts = placed.select(F.shiftright("window", 32).alias("p")).agg(F.max("p")).first()[0]
    if parts is None:
        return rows.select(F.col("key").alias(key), "piece", "start", "n", F.col("window").alias("container_id"))
    moved, parts, digits = None, parts + 1, 32
    while moved is None or parts > 1:
        parts, digits = -(-parts // FAN_IN), digits + FAN_IN.bit_length() - 1
        step = written(_merge_round(open_, parts, digits, capacity, windows), "merged")
        links = step.filter(F.col("room").isNull()).select("window", "into")
        # a window merged again follows its new place: the chain is short, one link a round
        moved = links if moved is None else moved.alias("m").join(links.alias("l"), F.col("m.into") == F.col("l.window"), "left").select("m.window", F.coalesce("l.into", "m.into").alias("into"))
        open_ = step.filter(F.col("room").isNotNull()).select(F.col("into").alias("window"), "room")
    # very many items of size 0 may lie in one window
    out = join_unique(rows, moved, "window", "left").withColumn("container_id", F.coalesce("into", "window"))
    return out.select(F.col("key").alias(key), "piece", "start", "n", "container_id")


def _merge_round(open_: DataFrame, parts: int, digits: int, capacity: int, windows: int) -> DataFrame:
    """window, into, room: the open windows of FAN_IN partitions merged whole in each of `parts` tasks.

    They come fullest first, and each goes to the open window it fills best; at most `windows` stay open at any time,
    the fullest being closed. A merged window keeps the name of its first; room is set once for each window that is
    open at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = Windows(capacity, windows, 0), {}
        for batch in batches:
            found, into = batch.column(0).to_pylist(), []
            for window, room in zip(found, batch.column(1).to_pylist(), strict=True):
                at = state.place(capacity - room)
                into.append(names.setdefault(at, window))
                while state.closed:
                    names.pop(state.closed.pop(), None)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(into, pa.int64()), pa.nulls(len(found), pa.int64())], ["window", "into", "room"])
        left = [(names[at], room) for room, at in state.room]
        if left:
            name, room = (pa.array(x, pa.int64()) for x in zip(*left, strict=True))
            yield pa.RecordBatch.from_arrays([name, name, room], ["window", "into", "room"])

    task = F.shiftright("window", digits).cast("int")
    return open_.repartitionById(parts, task).sortWithinPartitions("room", "window").mapInArrow(run, "window bigint, into bigint, room bigint")
