"""Removal of repeated byte strings through merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.bwt import merge_shards
from folia.llm.common import bytes_of, materialize, row_slices
from folia.llm.spans import BUFFER, PLACE, RIDER, SPAN, blobs, bucket_count, by_bucket, chained, each_bucket, joined, mixed, numbered, packed_spans, per_doc, ridden, to_docs, union_of, witnesses

#: Bytes of the k-grams that anchor strings; at most the string length.
GRAM = 24
#: Contexts of one anchor that a task merges; if there are more, each string is an anchor of its own.
HOT = 1 << 15
#: Symbols merged at once (so few that the arrays stay in a core's cache), and shards they are dealt to.
MERGED, SHARDS = 1 << 16, 4
#: Text bytes looked at in one piece; strings of a pair that are merged together.
PIECE, TILE = 1 << 20, 1 << 10
#: Bytes of asks up to which they are broadcast to the texts.
BROADCAST_BYTES = 32 << 20
_M, _M2 = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93
#: Bytes to be fetched. Of kind CONTEXT_ASK for the merge under anchor h; WINDOWS_ASK, each string as an anchor of its
#: own; PAIR_ASK, for the merge with what stands in document `of` at of_at.
ASK = np.dtype([("doc", "<i8"), ("at", "<u4"), ("to", "<u4"), ("of", "<i8"), ("of_at", "<u4"), ("h", "<u8"), ("kind", "u1")])
CONTEXT_ASK, WINDOWS_ASK, PAIR_ASK = 0, 1, 2
CONTEXT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
ROUTED = "bucket int, places binary, riders binary, contexts binary, bodies binary"
FOUND = "bucket int, spans binary, asks binary, riders binary, level int"
_OFF = 16  # `check` keeps the anchor's place in its top bits


class Powers:
    """Powers of a multiplier and of its inverse, as many as were ever asked for."""

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, n: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
        if multiplier not in cls.held or len(cls.held[multiplier][0]) < n:
            found = []
            for m in (multiplier, pow(multiplier, -1, 1 << 64)):
                x = np.full(n, m, np.uint64)
                x[0] = 1
                found.append(np.multiply.accumulate(x))
            cls.held[multiplier] = tuple(found)
        up, down = cls.held[multiplier]
        return up[:n], down[:n]


class Hashes:
    """Hashes of substrings of one piece of bytes, all from one prefix sum."""

    def __init__(self, data: np.ndarray, multiplier: int = _M):
        up, self.down = Powers.get(len(data) + 1, multiplier)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def every(self, n: int) -> np.ndarray:
        """Of the n bytes at each position."""
        count = len(self.prefix) - n
        return mixed((self.prefix[n:] - self.prefix[:count]) * self.down[:count]) if count > 0 else np.zeros(0, np.uint64)

    def some(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[to] - self.prefix[at]) * self.down[at] + (to - at).astype(np.uint64))


def anchors(hashes: Hashes, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For strings of `length` bytes at the sorted `starts`: runs of neighbours with one anchor.

    A string's anchor is the leftmost of its k-grams with the least hash, which depends on
    nothing but the string. Returns hash and place of each run's anchor, and the first and
    the number of the strings in the run. The low 7 bits of a hash make room for the place.
    """
    key = hashes.every(gram) & ~np.uint64(127)
    width, have = length - gram + 1, 1
    while have < width:  # windowed minimum by doubling; the place inside the window rides in the low bits
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:] + np.uint64(step))
        have += step
    key = key[starts]
    place = starts + (key & np.uint64(127)).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return (key >> np.uint64(7))[fresh], place[fresh], starts[fresh], np.diff(np.r_[fresh, len(starts)])


def pieces(batch: pa.RecordBatch, length: int):
    """(data, starts of strings, document of each start, offset of the piece in its document).

    Short documents share a piece; a long one is cut into pieces that overlap by length - 1.
    """
    for b in row_slices(batch, most=PIECE):
        data, offsets = bytes_of(b.column("text"))
        docs = b.column("doc").to_numpy()
        if b.num_rows == 1 and len(data) > 2 * PIECE:
            for at in range(0, len(data) - length + 1, PIECE):
                x = data[at : at + PIECE + length - 1]
                n = len(x) - length + 1
                yield x, np.arange(n), np.full(n, docs[0]), np.full(n, -at)
        else:
            n = np.maximum(np.diff(offsets) - length + 1, 0)
            if n.sum():
                base = np.repeat(offsets[:-1], n)
                starts = base + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield data, starts, np.repeat(docs, n), base


def anchored_places(batch: pa.RecordBatch, length: int, gram: int):
    """A place for each run of strings with one anchor, keyed by anchor and hash of the run's bytes."""
    for data, starts, docs, base in pieces(batch, length):
        h, place, at, n = anchors(hashes := Hashes(data), starts, length, gram)
        k = np.searchsorted(starts, at)
        out = np.empty(len(h), PLACE)
        # equal only if bytes, length and the anchor's offset are
        out["h"], out["check"], out["doc"] = h, mixed(hashes.some(at, at + n + length - 1) + ((place - at) << _OFF).astype(np.uint64)), docs[k]
        out["at"] = at - base[k]
        out["to"] = out["at"] + n + length - 1
        yield out


def window_places(data: np.ndarray, doc: int, at: int, n: int, length: int) -> np.ndarray:
    """A place for each of n strings of a context, each an anchor of its own."""
    out = np.empty(n, PLACE)
    out["h"], out["check"], out["doc"], out["at"] = Hashes(data).every(length)[:n], Hashes(data, _M2).every(length)[:n], doc, at + np.arange(n)
    out["to"] = out["at"] + length
    return out


def rows_of(used: list, **columns) -> pa.RecordBatch:
    """A row of ROUTED for each bucket."""
    none = pa.nulls(len(used), pa.binary())
    names = ["bucket", "places", "riders", "contexts", "bodies"]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[columns.get(c, none) for c in names[1:]]], names=names)


def by_anchor(records: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket of the anchor, where each bucket begins in it, and the buckets that there are."""
    of = (records["h"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(buckets + 1))
    return order, at, np.flatnonzero(np.diff(at))


def routed(parts, buckets: int):
    """Places gathered up to BUFFER: two of each key, by bucket of the anchor, and what rides on the second, by bucket of its document."""

    def flush(held):
        places, riders = witnesses(np.concatenate(held))
        order, at, used = by_anchor(places, buckets)
        yield rows_of(used, places=pa.array([places[order[at[k] : at[k + 1]]].tobytes() for k in used], pa.binary()))
        out = to_docs(riders, buckets, "riders", "of")
        yield rows_of(out.column("bucket").to_pylist(), riders=out.column("riders"))

    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= BUFFER:
            yield from flush(held)
            held, n = [], 0
    if n:
        yield from flush(held)


def asks_of(places: np.ndarray, length: int, hot: int | None) -> tuple[np.ndarray, np.ndarray]:
    """What to fetch of the places of a bucket, and what rides on it.

    Of places with one key the first two are a pair, each asked for the merge with the other.
    The first places of different keys under one anchor are asked for the anchor's merge.
    """
    two, riders = witnesses(places)
    if not len(two):
        return np.zeros(0, ASK), riders
    fresh = np.r_[True, (two["h"][1:] != two["h"][:-1]) | (two["check"][1:] != two["check"][:-1])]
    first = two[fresh]
    anchor = np.flatnonzero(np.r_[True, first["h"][1:] != first["h"][:-1]])
    under = np.diff(np.r_[anchor, len(first)])
    under = np.repeat(under, under)
    first, under = first[under > 1], under[under > 1]
    second = np.flatnonzero(~fresh)
    asks = np.zeros(len(first) + 2 * len(second), ASK)
    for k in ("doc", "at", "to", "h"):
        asks[k][: len(first)] = first[k]
    asks["kind"][: len(first)] = np.where(under > hot, WINDOWS_ASK, CONTEXT_ASK) if hot else CONTEXT_ASK
    for part, mine, other in ((asks[len(first) : len(first) + len(second)], second - 1, second), (asks[len(first) + len(second) :], second, second - 1)):
        for k in SPAN.names:
            part[k] = two[k][mine]
        part["of"], part["of_at"], part["kind"] = two["doc"][other], two["at"][other], PAIR_ASK
    return asks, riders


def tiles(pairs: np.ndarray, length: int) -> np.ndarray:
    """Contexts of a document's pairs: runs of pairs with one document at one distance, cut every TILE strings.

    Both documents of a pair make the same cuts, and name each by the same anchor.
    """
    r = np.empty(len(pairs), RIDER)
    for k in RIDER.names:
        r[k] = pairs[k]
    r = chained(r)
    n = r["to"].astype(np.int64) - r["at"] - (length - 1)
    pieces_ = -(-n // TILE)
    k = np.repeat(np.arange(len(r)), pieces_)
    off = (np.arange(len(k)) - np.repeat(np.cumsum(pieces_) - pieces_, pieces_)) * TILE
    out = np.empty(len(k), CONTEXT)
    out["doc"], out["at"], out["n"] = r["doc"][k], r["at"][k] + off, np.minimum(TILE, n[k] - off)
    mine, other = (r["doc"], r["at"].astype(np.int64)), (r["of"], r["of_at"].astype(np.int64))
    swap = (r["doc"] > r["of"]) | ((r["doc"] == r["of"]) & (r["at"] > r["of_at"]))
    key = off.astype(np.uint64)
    for x, y in zip(mine, other, strict=True):
        for z in (np.where(swap, y, x), np.where(swap, x, y)):
            key = mixed(key ^ z[k].astype(np.uint64)) * np.uint64(_M2)
    out["h"] = key
    return out


def merged_repeats(contexts: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """Spans of the strings in these contexts that start earlier in another of them.

    The contexts are dealt to shards, the shards' transforms merged, and each block of
    rotations with `length` leading symbols in common is a repeated interval: its first
    string stays.
    """
    if not texts:
        return np.zeros(0, SPAN)
    found = []
    used = np.zeros(257, bool)
    used[0] = True
    for t in texts:
        used[np.frombuffer(t, np.uint8).astype(np.int64) + 1] = True
    code = (np.cumsum(used) - 1).astype(np.uint8)  # UTF-8 leaves some byte values out: there is room for the sentinel
    lengths = np.array([len(t) + 1 for t in texts])
    # Neighbours have one anchor; they go to different shards, and are merged in one batch.
    batch = (np.cumsum(lengths) - lengths) // MERGED
    anchor_first = np.r_[True, contexts["h"][1:] != contexts["h"][:-1]]
    batch = batch[np.flatnonzero(anchor_first)[np.cumsum(anchor_first) - 1]]
    for k in np.unique(batch):
        mine = np.flatnonzero(batch == k)
        shards, members, offsets = [], [], []
        for s in range(min(SHARDS, len(mine))):
            own = sorted(mine[s :: min(SHARDS, len(mine))], key=texts.__getitem__)
            starts = np.cumsum([0, *[lengths[i] for i in own]])
            symbols = np.zeros(starts[-1], np.uint8)
            body = np.ones(len(symbols), bool)
            body[starts[1:] - 1] = False
            symbols[body] = code[np.frombuffer(b"".join(texts[i] for i in own), np.uint8).astype(np.int64) + 1]
            shards.append((symbols, starts[:-1]))
            members.append(np.repeat(own, np.diff(starts)))
            offsets.append(np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts)))
        shard, at, block = merge_shards(shards, length)
        twin = np.r_[False, block[1:] == block[:-1]]
        twin[:-1] |= twin[1:]
        shard, at, block = shard[twin], at[twin], block[twin]
        base = np.cumsum([0, *[len(m) for m in members]])[:-1][shard] + at
        who, off = np.concatenate(members)[base], np.concatenate(offsets)[base]
        keep = off < contexts["n"][who]
        who, off, block = who[keep], off[keep], block[keep]
        start, doc = contexts["at"][who] + off, contexts["doc"][who]
        order = np.lexsort((start, doc, block))
        start, doc, block = start[order], doc[order], block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        first = np.repeat(first, np.diff(np.r_[first, len(block)]))
        late = (doc != doc[first]) | (start != start[first])
        out = np.empty(late.sum(), SPAN)
        out["doc"], out["at"] = doc[late], start[late]
        out["to"] = out["at"] + length
        found.append(joined(out))
    return np.concatenate(found) if found else np.zeros(0, SPAN)


def repeats_below(docs: DataFrame, rows: DataFrame, buckets: int, length: int, hot: int | None) -> DataFrame:
    """(bucket, spans) of all repeated strings, from the rows of routed(): settle, fetch, merge, and again for hot anchors."""

    def search(hot: int | None):
        """Of each bucket: what its places ask for and what rides on them, and the repeats in its contexts.

        Riders are of level 0 on a place of one buffer, of level 1 on a second place of all.
        """

        def row(records, column, level, key="doc"):
            out = to_docs(records, buckets, column, key)
            none, n = pa.nulls(out.num_rows, pa.binary()), out.num_rows
            return pa.RecordBatch.from_arrays([out.column(0), *[out.column(1) if c == column else none for c in ("spans", "asks", "riders")], pa.array([level] * n, pa.int32())], names=["bucket", "spans", "asks", "riders", "level"])

        def flush(held):
            spans, asks, level0, level1 = (np.concatenate(x) for x in zip(*held, strict=True))
            for x in (row(joined(spans), "spans", None), row(asks, "asks", None), row(level0, "riders", 0, "of"), row(chained(level1), "riders", 1, "of")):
                if x.num_rows:
                    yield x

        def each(batches):
            held, n = [], 0
            for of_bucket in each_bucket(batches):
                asks, riders = asks_of(np.concatenate([blobs(b.column("places"), PLACE) for b in of_bucket]), length, hot)
                contexts, texts = [np.zeros(0, CONTEXT)], []
                for b in of_bucket:
                    for c, body in zip(b.column("contexts"), b.column("bodies"), strict=True):
                        if c.is_valid:
                            c = np.frombuffer(c.as_buffer(), CONTEXT)
                            body, at = body.as_buffer().to_pybytes(), np.r_[0, np.cumsum(c["n"].astype(np.int64) + length - 1)]
                            contexts.append(c)
                            texts += [body[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                contexts = np.concatenate(contexts)
                order = np.argsort(contexts["h"], kind="stable")
                spans = merged_repeats(contexts[order], [texts[i] for i in order], length)
                held.append((spans, asks, np.concatenate([blobs(b.column("riders"), RIDER) for b in of_bucket]), riders))
                n += sum(map(len, held[-1]))
                if n >= BUFFER:
                    yield from flush(held)
                    held, n = [], 0
            if held:
                yield from flush(held)

        return each

    def fetch(batches):
        """The bytes of contexts by bucket of the anchor, and the strings of hot anchors' contexts as places of their own."""

        def flush(records, texts):
            c = np.concatenate(records)
            order, at, used = by_anchor(c, buckets)
            blob = [c[order[at[k] : at[k + 1]]].tobytes() for k in used]
            body = [b"".join(texts[i] for i in order[at[k] : at[k + 1]]) for k in used]
            return rows_of(used, contexts=pa.array(blob, pa.binary()), bodies=pa.array(body, pa.binary()))

        records, texts, windows, n = [], [], [], 0
        for b in batches:
            for doc, text, asked in zip(b.column("doc").to_pylist(), b.column("text"), b.column("asks").to_pylist(), strict=True):
                data, asks = text.as_buffer().to_pybytes(), np.frombuffer(asked, ASK)
                plain = asks[asks["kind"] == CONTEXT_ASK]
                c = np.empty(len(plain), CONTEXT)
                c["h"], c["doc"], c["at"], c["n"] = plain["h"], doc, plain["at"], plain["to"] - plain["at"] - (length - 1)
                c = np.concatenate([c, tiles(asks[asks["kind"] == PAIR_ASK], length)])
                records.append(c)
                texts += [data[a : a + k + length - 1] for a, k in zip(c["at"].tolist(), c["n"].tolist(), strict=True)]
                for x in asks[asks["kind"] == WINDOWS_ASK]:
                    a, k = int(x["at"]), int(x["to"] - x["at"]) - (length - 1)
                    windows.append(window_places(np.frombuffer(data, np.uint8, k + length - 1, a), doc, a, k, length))
                    n += k
                if len(texts) > 1 << 16:
                    yield flush(records, texts)
                    records, texts = [], []
                if n >= BUFFER:
                    yield from routed(iter(windows), buckets)
                    windows, n = [], 0
        if texts:
            yield flush(records, texts)
        yield from routed(iter(windows), buckets)

    def resolve(batches):
        def each():
            for of_bucket in each_bucket(batches):
                yield ridden(np.concatenate([blobs(b.column("riders"), RIDER) for b in of_bucket]), np.concatenate([blobs(b.column("spans"), SPAN) for b in of_bucket]))

        yield from packed_spans(each(), buckets)

    def found_in(rows: DataFrame, name: str, hot: int | None) -> DataFrame:
        return materialize(by_bucket(rows, buckets).mapInArrow(search(hot), FOUND), name)

    def fetched(found: DataFrame) -> DataFrame:
        asked = per_doc(found.filter("asks is not null"), "asks", ASK, buckets)
        size = found.agg(F.sum(F.octet_length("asks"))).first()[0] or 0
        return docs.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "doc").select("doc", "text", "asks").mapInArrow(fetch, ROUTED)

    rounds = [found_in(rows, "asks", hot)]
    for name, limit in (("repeats", None), ("hot-repeats", None)):
        if rounds[-1].filter("asks is not null").limit(1).count():
            rounds.append(found_in(fetched(rounds[-1]), name, limit))
    spans = None
    for found in reversed(rounds):
        of_round = found.filter("spans is not null").select("bucket", "spans")
        spans = of_round if spans is None else spans.unionByName(of_round)
        for level in (1, 0):
            riders = found.filter(f"riders is not null and level = {level}").select("bucket", "riders")
            both = spans.unionByName(riders, allowMissingColumns=True)
            spans = spans.unionByName(by_bucket(both, buckets).mapInArrow(resolve, "bucket int, spans binary"))
    return spans


def repeated_strings(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts earlier.

    1. Routing. Each string is anchored at its least k-gram; a run of strings with one anchor
       is a context. Of contexts with equal hashes the first two are a pair; any other rides on
       the second one's fate, so that a phrase of a third of all documents is two contexts to a
       buffer. Pairs that follow each other in two documents make one long string in each.
       Different contexts under one anchor are brought together. No hash removes anything.
    2. Merge. The strings of pairs, and the contexts of each anchor, are fetched and dealt to
       shards, and the shards' Burrows-Wheeler transforms merged; blocks of `length` common
       symbols are the repeated intervals, of which the first string stays.
    3. An anchor with more than `hot` contexts is taken again with each whole string as an
       anchor of its own, which splits it into as many merges as it has strings.

    Earlier is by (id, start). Strings are judged on the input and never cross documents.

    Returns a row for each row: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that
    stay), kept_sha256. Null text counts as empty. Texts shorter than `length` lose nothing.
    Rows with a repeated or null id are documents of their own, ordered by id (null last) and
    text. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    docs = numbered(df, id_col, text_col)
    gram = min(gram, length)
    buckets = bucket_count(docs, 2)

    def places(batches):
        yield from routed((x for b in batches for x in anchored_places(b, length, gram)), buckets)

    def apply(batches):
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        for whole in batches:
            for b in row_slices(whole):
                rows = []
                for id_, text, spans in zip(b.column("id").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    kept, gone, runs = data, 0, 0
                    if spans:
                        at, to = union_of(np.frombuffer(spans, SPAN))
                        edges = [0, *np.stack([at, to], 1).ravel().tolist(), len(data)]
                        kept, gone, runs = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)), int((to - at).sum()), len(at)
                    rows.append((id_, len(data), gone, runs, kept, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=names)

    found = repeats_below(docs, docs.select("doc", "text").mapInArrow(places, ROUTED), buckets, length, hot)
    spans = per_doc(found, "spans", SPAN, buckets, joined)
    out = docs.join(spans, "doc", "left").select("id", "text", "spans").mapInArrow(apply, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
