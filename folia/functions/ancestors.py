"""Pairs of a node and its ancestors, from paths alone, an item at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of items, of which a task unpacks one at a time, and the partitions that they lie in.
BUCKETS, PARTITIONS = 256, 128
#: Nodes packed at once, and pairs handed on at once.
PACKED, PAIRS = 1 << 20, 1 << 16
NODE = pa.schema([("item_id", pa.string()), ("id", pa.string()), ("node_path", pa.string())])
#: As packed: items and paths, which repeat, once each.
BLOB = pa.schema([("item_id", pa.dictionary(pa.int32(), pa.string())), ("id", pa.string()), ("node_path", pa.dictionary(pa.int32(), pa.string()))])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, nodes) of nodes (bucket, *NODE): those of a bucket in one compressed blob."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACKED:
            yield _pack(held)
            held, n = [], 0
    if n:
        yield _pack(held)


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    nodes = pa.Table.from_batches(held).combine_chunks()
    bucket = nodes["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    nodes = nodes.select(NODE.names).take(order).cast(NODE).combine_chunks()
    used, blobs = np.flatnonzero(np.diff(at)), []
    for u in used.tolist():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, BLOB, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            item, own, path = nodes.slice(at[u], at[u + 1] - at[u]).columns
            out.write_table(pa.table([item.combine_chunks().dictionary_encode(), own, path.combine_chunks().dictionary_encode()], schema=BLOB))
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "nodes"])


def prefixes(paths: list[str]) -> np.ndarray:
    """For each distinct path the places, in the list, of its prefixes: the nearest first, -1 where there is none."""
    place = {p: k for k, p in enumerate(paths)}
    found = []
    for p in paths:
        ups, at = [], p.rfind("/")
        while at > 0:
            ups.append(place.get(p[:at], -1))
            at = p.rfind("/", 0, at)
        found.append(ups)
    out = np.full((len(paths), max(map(len, found), default=0)), -1, np.int64)
    for k, ups in enumerate(found):
        out[k, : len(ups)] = ups
    return out


def ancestor_pairs(nodes: pa.Table) -> Iterator[pa.RecordBatch]:
    """(item_id, anc_id, des_id, dist) of whole items; of several nodes with one path each is an ancestor."""
    nodes = nodes.combine_chunks()
    item, path = [nodes[c].combine_chunks().dictionary_encode() for c in ("item_id", "node_path")]
    ups = prefixes(path.dictionary.to_pylist())
    of, code = [x.indices.to_numpy().astype(np.int64) for x in (item, path)]
    key = of * len(ups) + code
    order = np.argsort(key, kind="stable")
    key, of, code = key[order], of[order], code[order]
    nodes = nodes.take(order)
    for k in range(ups.shape[1]):
        up = ups[code, k]
        below = np.flatnonzero(up >= 0)
        wanted = of[below] * len(ups) + up[below]
        first, n = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
        n -= first
        des = np.repeat(below, n)
        anc = np.repeat(first, n) + np.arange(len(des)) - np.repeat(np.cumsum(n) - n, n)
        for a in range(0, len(des), PAIRS):
            d, u = des[a : a + PAIRS], anc[a : a + PAIRS]
            ids = [nodes["item_id"].take(d), nodes["id"].take(u), nodes["id"].take(d), pa.chunked_array([pa.array(np.full(len(d), k + 1, np.int32))])]
            yield from pa.Table.from_arrays(ids, names=["item_id", "anc_id", "des_id", "dist"]).combine_chunks().to_batches()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of packed nodes that come in the order of their buckets."""
    held, now = [], None
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("nodes"), strict=True):
            if held and bucket != now:
                yield from ancestor_pairs(_unpack(held))
                held = []
            held.append(blob.as_py())
            now = bucket
    if held:
        yield from ancestor_pairs(_unpack(held))


def _unpack(held: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all().cast(NODE) for x in held])


def ancestors(nodes: DataFrame) -> DataFrame:
    """(item_id, anc_id, des_id, dist) of all strict ancestors of nodes (item_id, id, node_path): one shuffle, of packed nodes.

    Nodes without item or path have none.
    """
    rows = nodes.filter("item_id is not null and node_path is not null").select(F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), *NODE.names)
    blobs = rows.mapInArrow(packed, "bucket int, nodes binary").repartition(PARTITIONS, "bucket").sortWithinPartitions("bucket")
    return blobs.mapInArrow(unpacked, "item_id string, anc_id string, des_id string, dist int")
