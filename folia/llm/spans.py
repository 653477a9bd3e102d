"""Keyed places in documents: routed as packed records, resolved to repeats, applied as spans.

A place is a record (h, check, doc, at, to): the key (h, check) names a content, doc the
document and [at, to) what of it the place covers. Of the places with one key the first, by
(doc, at), is kept; all others are repeats. Mappers settle what repeats within their own
buffer, so that however often a key occurs, a reducer gets one record of it from a buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import data_partitions, materialize, odd_ids

PLACE = np.dtype([("h", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("to", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("at", "<u4"), ("to", "<u4")])
#: [at, to) of doc is what stands in document `of` from of_at on, and goes if that goes.
RIDER = np.dtype([("doc", "<i8"), ("at", "<u4"), ("to", "<u4"), ("of", "<i8"), ("of_at", "<u4")])
#: Records that a mapper gathers before it settles and routes them.
BUFFER = 1 << 20
ROUTED = "bucket int, places binary, spans binary"


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text) with a unique number doc, in the order of the ids.

    The id itself serves if no id is repeated or null. Otherwise the rows are sorted by id
    (null last) and text, numbered, and written once: each row is then a document of its own.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not odd_ids(rows, "id"):
        return rows.select(F.col("id").alias("doc"), "id", "text")
    rows = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), "text").withColumn("doc", F.monotonically_increasing_id())
    return materialize(rows.select("doc", "id", "text"), "numbered")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def settle(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each key, sorted by key, and the repeats. One place named twice is no repeat of itself."""
    if not len(places):
        return places, places
    p = places[np.lexsort((places["at"], places["doc"], places["check"], places["h"]))]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p["h"][1:] != p["h"][:-1]) | (p["check"][1:] != p["check"][:-1])
    same = np.zeros(len(p), bool)
    same[1:] = ~fresh[1:] & (p["doc"][1:] == p["doc"][:-1]) & (p["at"][1:] == p["at"][:-1])
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    own = (p["doc"] == p["doc"][first]) & (p["at"] == p["at"][first])
    return p[fresh], p[~fresh & ~own & ~same]


def spans_of(places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), SPAN)
    for k in SPAN.names:
        out[k] = places[k]
    return out


def routed(places: np.ndarray, repeats: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of keys that has any of these places or repeats."""

    def cut(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        return x[order], np.searchsorted(of[order], np.arange(buckets + 1))

    p, at = cut(places, (places["h"] % np.uint64(buckets)).astype(np.int32))
    s, to = cut(spans_of(repeats), (repeats["h"] % np.uint64(buckets)).astype(np.int32))
    used = np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([p[at[k] : at[k + 1]].tobytes() for k in used], pa.binary()), pa.array([s[to[k] : to[k + 1]].tobytes() for k in used], pa.binary())], names=["bucket", "places", "spans"]
    )


def buffered(parts: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Gather places up to BUFFER records, settle them, and route what is left."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= BUFFER:
            yield routed(*settle(np.concatenate(held)), buckets)
            held, n = [], 0
    if n:
        yield routed(*settle(np.concatenate(held)), buckets)


def bucket_count(df: DataFrame, grow: float = 1.0) -> int:
    """Buckets for a shuffle of `grow` times the bytes of df; four make a partition."""
    return 4 * data_partitions(df, grow)


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Bring the rows of a bucket together; buckets are several times as many as partitions."""
    return rows.repartition(buckets // 4, "bucket")


def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one bucket after the other: a task holds its partition as it came, packed, and unpacks a bucket at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        of = b.column("bucket").to_numpy()
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True):
            held.setdefault(int(of[order[a]]), []).append(b.take(pa.array(order[a:z])))
    for bucket in sorted(held):
        yield held.pop(bucket)


def blobs(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid and len(x.as_buffer())]])


def joined(spans: np.ndarray) -> np.ndarray:
    """The same cover by maximal runs, in order of document and place; touching spans make one run."""
    s = spans[np.lexsort((spans["at"], spans["doc"]))]
    if not len(s):
        return s
    rank = np.cumsum(np.r_[0, s["doc"][1:] != s["doc"][:-1]]) << 33
    reach = np.maximum.accumulate(rank + s["to"])
    fresh = np.flatnonzero(np.r_[True, rank[1:] + s["at"][1:] > reach[:-1]])
    out = s[fresh].copy()
    out["to"] = (reach[np.r_[fresh[1:] - 1, len(s) - 1]]) & ((1 << 33) - 1)
    return out


def to_docs(records: np.ndarray, buckets: int, column: str, key: str = "doc") -> pa.RecordBatch:
    """Records packed by bucket of the document that their field `key` names."""
    of = (mixed(records[key].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    records, at = records[order], np.searchsorted(of[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([records[at[k] : at[k + 1]].tobytes() for k in used], pa.binary())], names=["bucket", column])


def packed_spans(parts: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Gather spans up to BUFFER, join those that touch, and pack them by bucket of documents."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= BUFFER:
            held = [joined(np.concatenate(held))]
            if (n := len(held[0])) >= BUFFER // 2:
                yield to_docs(held[0], buckets, "spans")
                held, n = [], 0
    if n:
        yield to_docs(joined(np.concatenate(held)), buckets, "spans")


def per_doc(packed: DataFrame, column: str, dtype: np.dtype, buckets: int, prepare=None) -> DataFrame:
    """One row (doc, records) for each document, from the rows of to_docs; prepare may thin out or sort the records of a bucket."""

    def gather(batches):
        for held in each_bucket(batches):
            r = np.concatenate([blobs(b.column(column), dtype) for b in held])
            r = prepare(r) if prepare else r[np.argsort(r["doc"], kind="stable")]
            cut = np.flatnonzero(np.r_[True, r["doc"][1:] != r["doc"][:-1]]) if len(r) else np.zeros(0, int)
            for k in range(0, len(cut), 10_000):
                ends = np.r_[cut, len(r)][k : k + 10_001]
                packed_rows = [r[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc"][ends[:-1]]), pa.array(packed_rows, pa.binary())], names=["doc", column])

    return by_bucket(packed.select("bucket", column), buckets).mapInArrow(gather, f"doc long, {column} binary")


def witnesses(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two places of each key, sorted by key, and all others as riders on the second: runs of what moves alike are one rider."""
    if not len(places):
        return places, np.zeros(0, RIDER)
    p = places[np.lexsort((places["at"], places["doc"], places["check"], places["h"]))]
    other = (p["h"][1:] != p["h"][:-1]) | (p["check"][1:] != p["check"][:-1])
    p = p[np.r_[True, other | (p["doc"][1:] != p["doc"][:-1]) | (p["at"][1:] != p["at"][:-1])]]  # one place named twice is one place
    first = np.flatnonzero(np.r_[True, (p["h"][1:] != p["h"][:-1]) | (p["check"][1:] != p["check"][:-1])])
    rank = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
    late = np.flatnonzero(rank > 1)
    second = late - rank[late] + 1
    out = np.empty(len(late), RIDER)
    for k in SPAN.names:
        out[k] = p[k][late]
    out["of"], out["of_at"] = p["doc"][second], p["at"][second]
    return p[rank < 2], chained(out)


def chained(riders: np.ndarray) -> np.ndarray:
    """The same riders with those joined that touch and stand in one document at one distance."""
    if not len(riders):
        return riders
    shift = riders["of_at"].astype(np.int64) - riders["at"]
    order = np.lexsort((riders["at"], shift, riders["of"], riders["doc"]))
    r, shift = riders[order], shift[order]
    group = np.cumsum(np.r_[0, (r["doc"][1:] != r["doc"][:-1]) | (r["of"][1:] != r["of"][:-1]) | (shift[1:] != shift[:-1])]) << 33
    reach = np.maximum.accumulate(group + r["to"])
    fresh = np.flatnonzero(np.r_[True, group[1:] + r["at"][1:] > reach[:-1]])
    out = r[fresh].copy()
    out["to"] = reach[np.r_[fresh[1:] - 1, len(r) - 1]] & ((1 << 33) - 1)
    return out


def ridden(riders: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans of the riders' documents that stand, in the documents they ride on, inside these spans."""
    spans = joined(spans)
    docs = np.unique(np.r_[spans["doc"], riders["of"]])
    of_span, of_rider = np.searchsorted(docs, spans["doc"]) << 33, np.searchsorted(docs, riders["of"]) << 33
    length = riders["to"].astype(np.int64) - riders["at"]
    lo = np.searchsorted(of_span + spans["to"], of_rider + riders["of_at"], "right")
    hi = np.searchsorted(of_span + spans["at"], of_rider + riders["of_at"] + length, "left")
    n = np.maximum(hi - lo, 0)
    r = np.repeat(np.arange(len(riders)), n)
    x = spans[np.repeat(lo, n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]
    at, of_at = riders["at"][r].astype(np.int64), riders["of_at"][r].astype(np.int64)
    out = np.empty(len(r), SPAN)
    out["doc"] = riders["doc"][r]
    out["at"] = at + np.maximum(x["at"].astype(np.int64) - of_at, 0)
    out["to"] = at + np.minimum(x["to"].astype(np.int64) - of_at, length[r])
    return out


def union_of(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans of one document cover; touching spans make one run."""
    order = np.argsort(spans["at"], kind="stable")
    at, to = spans["at"][order].astype(np.int64), np.maximum.accumulate(spans["to"][order].astype(np.int64))
    if not len(at):
        return at, to
    fresh = np.r_[True, at[1:] > to[:-1]]
    starts = np.flatnonzero(fresh)
    return at[starts], to[np.r_[starts[1:] - 1, len(at) - 1]]
