"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import materialize, with_word_counts

#: Permitted sequence lengths, in words.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Rows that are packed together, on average.
GROUP_ROWS = 20_000
PIECES = "bin_id string, capacity int, used int, doc_id long, piece int, start long, length int, offset int"
ARROW = [("bin_id", pa.string()), ("capacity", pa.int32()), ("used", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32())]


def sequence_cost(length: int) -> float:
    """Cost of a sequence: its words, attention that grows with the square, and a fixed share."""
    return length * (1 + length / 16384) + 256


class Left:
    """The sizes of items not packed yet, by size."""

    def __init__(self, sizes: list[int]):
        self.counts = Counter(sizes)
        self.sizes = sorted(self.counts)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fill(self, room: int) -> int:
        """What of the room the largest items that fit, one after the other, would leave."""
        k = bisect_right(self.sizes, room)
        while k and room >= self.sizes[0]:
            size = self.sizes[k - 1]
            room -= size * min(room // size, self.counts[size])
            k = bisect_right(self.sizes, room, 0, k - 1)
        return room


def least_cost(size: int, lengths: tuple[int, ...], left: Left) -> int:
    """The length to open for an item: that of the least cost per word, once filled from what is left and cut down to its contents."""
    best = None
    for length in lengths[bisect_left(lengths, size) :]:
        held = length - left.fill(length - size)
        cost = sequence_cost(lengths[bisect_left(lengths, held)]) / held
        if best is None or cost < best[0]:
            best = cost, length
    return best[1]


def best_fit(sizes: list[int], lengths: tuple[int, ...], first: int | None = None) -> tuple[list[list[int]], list[int]]:
    """Best-fit decreasing: each item goes to the open bin that it fills best; else it opens a bin.

    A new bin has the length of the least cost (see least_cost), or, if given, the length
    `first`, or the least length that holds the item if that is longer. sizes come in falling
    order. Returns each bin's items, and what each bin holds.
    """
    bins, used = [], []
    waiting: list[list[int]] = [[] for _ in range(max(lengths) + 1)]  # open bins by room left
    rooms: list[int] = []  # the rooms for which there are any, in order
    left = Left(sizes)
    for item, size in enumerate(sizes):
        left.take(size)
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            bin_ = waiting[room].pop()
            if not waiting[room]:
                rooms.pop(k)
        else:
            bin_ = len(bins)
            room = least_cost(size, lengths, left) if first is None else first if first >= size else lengths[bisect_left(lengths, size)]
            bins.append([])
            used.append(0)
        bins[bin_].append(item)
        used[bin_] += size
        if room := room - size:
            if not waiting[room]:
                insort(rooms, room)
            waiting[room].append(bin_)
    return bins, used


def pack(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[list[int]], list[int], list[int]]:
    """Items, contents and capacities of the bins: all lengths are opened side by side, each where it costs least.

    Packings that open one length throughout are tried as well, and the cheapest of all is kept (the joint one, in a
    tie): a choice bin by bin sees what is left, not how later bins will share it. In every packing, each bin
    is at last cut down to the least permitted length that holds its contents, before costs are compared.
    """
    best = None
    for first in (None, *sorted(lengths, key=lambda c: sequence_cost(c) / c)):
        bins, used = best_fit(sizes, lengths, first)
        caps = [lengths[bisect_left(lengths, u)] for u in used]
        cost = sum(map(sequence_cost, caps))
        if best is None or cost < best[0]:
            best = cost, bins, used, caps
    return best[1:]


def pack_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack whole documents, measured in words, into sequences of several permitted lengths.

    A document longer than the longest length is cut into pieces of that length and a rest.
    Rows are dealt by a hash of their id and text to groups of about group_rows (repeated rows
    by their number as well, so that they spread), and each group is packed on its own: groups
    stay that large however many rows there are, and the loss to their last bins is one in
    thousands. Rerun or dealt otherwise over partitions, the same rows come out.

    Returns a row for each piece: bin_id, capacity, used (of the bin), doc_id, piece, start
    (in the document), length, offset (in the bin). Null, empty and blank texts have no words
    and no piece. Repeated rows are packed one by one; a null id stays null. Empty table: no
    rows. Other columns are ignored, whatever their names.
    """
    lengths = tuple(sorted(set(lengths)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("of"))
    sized = with_word_counts(rows, "text", "size", ["doc_id", "of"]).filter("size > 0").groupBy("doc_id", "of", "size").agg(F.count(F.lit(1)).alias("copies"))
    sized = materialize(sized, "sizes")
    groups = max(1, -(-(sized.agg(F.sum("copies")).first()[0] or 0) // group_rows))
    sized = sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    group = F.pmod(F.xxhash64("doc_id", "of", "copy"), F.lit(groups))

    def each(key, part):  # no hints: Spark would read them
        longest, group = lengths[-1], key[0].as_py()
        items = [(min(longest, n - at), d, k, at) for d, n in zip(part["doc_id"].to_pylist(), part["size"].to_pylist(), strict=True) for k, at in enumerate(range(0, n, longest))]
        items.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        bins, used, caps = pack([x[0] for x in items], lengths)
        out = []
        for b, (members, u, c) in enumerate(zip(bins, used, caps, strict=True)):
            offset = 0
            for i in members:
                size, doc, k, at = items[i]
                out.append((f"{group}-{b}", c, u, doc, k, at, size, offset))
                offset += size
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), ARROW, strict=True)], names=[n for n, _ in ARROW])

    return sized.groupBy(group.alias("group")).applyInArrow(each, PIECES).withColumnRenamed("doc_id", id_col)
