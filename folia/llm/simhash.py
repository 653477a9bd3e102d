"""SimHash fingerprints, their links by a grid over segment bit counts, and the groups they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import SEED, join_groups, materialize, release, row_slices
from folia.llm.spans import bucket_count, by_bucket, each_bucket

#: Segments of a fingerprint: the embedding has as many dimensions, each with a count from 0 to BITS // segments.
BITS, SEGMENTS = 64, 32
#: Distinct fingerprints beyond which segments of one bit make smaller cells, and as many more records: found are the same links.
MANY = 1 << 26
#: Shingles hashed at once.
SHINGLES = 1 << 18
#: Pairs compared at once, and records of a grid cell beyond which it is searched point by point.
PAIRS, DENSE = 1 << 20, 2048
RECORD = np.dtype([("cell", "<u8"), ("print", "<u8"), ("home", "u1")])


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in runs of bounded length; nothing if there is no word."""
    split = text.lower().split()
    if split and len(split) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(split), seed)], np.uint64)
        return
    for k in range(0, len(split) - words + 1 if split else 0, SHINGLES):
        part = split[k : k + SHINGLES + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.r_[0, ends[:-1]].tolist()
        yield np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """64 bits. A bit is 1 if it is set in over half the hashes, repeats included; no word: 0."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text, words, seed):
        n += len(h)
        ones += _ones(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, print) of every row, the print as a signed long. Null text counts as empty."""

    def prints(batches):
        for whole in batches:
            for b in row_slices(whole):
                found = [fingerprint(t.as_buffer().to_pybytes(), words, seed) if t.is_valid else 0 for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "print"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(prints, "id long, print long")


def embed(prints: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The bit count of each segment: an n x segments array. Its Manhattan distance is at most the Hamming distance."""
    width = BITS // segments
    shifts = (np.arange(segments) * width).astype(np.uint64)
    return np.bitwise_count((prints[:, None] >> shifts) & np.uint64((1 << width) - 1))


def grid_records(prints: np.ndarray, radius: int, segments: int = SEGMENTS) -> np.ndarray:
    """Where each point meets its neighbours.

    Half the dimensions differ by radius // 2 in sum at most, in one half or the other; a cell
    is a half's count vector. With a radius of 2 or 3 that sum is 0 or 1: a point is at home in
    its own cell, and calls at the cells one step up in one dimension, so that two cells one
    step apart meet in the upper one.
    """
    if radius // 2 > 1:
        raise ValueError("the grid looks one step away: radius is 3 at most")
    counts, half, width = embed(prints, segments), segments // 2, BITS // segments
    place = (np.uint64(2) ** (np.arange(half, dtype=np.uint64) * np.uint64(width)))[None, :]
    out = []
    for side in range(2):
        c = counts[:, side * half : (side + 1) * half]
        home = (c.astype(np.uint64) * place).sum(1, dtype=np.uint64) | np.uint64(side << 63)
        calls = [(home, prints, 1)]
        if radius >= 2:
            calls += [(home[up] + place[0, k], prints[up], 0) for k in range(half) if (up := c[:, k] < width).any()]
        for cell, fp, at_home in calls:
            r = np.empty(len(cell), RECORD)
            r["cell"], r["print"], r["home"] = cell, fp, at_home
            out.append(r)
    return np.concatenate(out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Links that join different trees, among the values seen so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def add(self, a: int, b: int) -> bool:
        """Whether the link joined two trees."""
        if (x := self.root(a)) == (y := self.root(b)):
            return False
        self.parent[max(x, y)] = min(x, y)
        self.links.append((a, b))
        return True


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Candidates by the Manhattan distance of the count vectors, then by the bits themselves."""
    counts_a, counts_b = embed(a).astype(np.int8), embed(b).astype(np.int8)
    keep = np.flatnonzero(np.abs(counts_a - counts_b).sum(1) <= radius)
    return keep[distance(a[keep], b[keep]) <= radius]


def link_cells(records: np.ndarray, radius: int, forest: Forest) -> None:
    """Links between the points of each cell, one of which at least is at home there."""
    r = records[np.lexsort((records["print"], 1 - records["home"], records["cell"]))]
    starts = np.flatnonzero(np.r_[True, r["cell"][1:] != r["cell"][:-1]])
    sizes = np.diff(np.r_[starts, len(r)])
    homes = np.add.reduceat(r["home"].astype(np.int64), starts)
    prints = r["print"]
    for s, n, h in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), homes[sizes > DENSE].tolist(), strict=True):
        if h:
            link_dense(prints[s : s + h], prints[s + h : s + n], radius, forest)
    keep = (sizes > 1) & (sizes <= DENSE) & (homes > 0)
    starts, sizes, homes = starts[keep], sizes[keep], homes[keep]
    # a home at place i of its cell meets the records after it
    first = np.repeat(starts, homes) + np.arange(homes.sum()) - np.repeat(np.cumsum(homes) - homes, homes)
    after = np.repeat(starts + sizes, homes) - first - 1
    bounds = np.searchsorted(np.cumsum(after), np.arange(PAIRS, after.sum() + PAIRS, PAIRS), "left") + 1 if len(after) else []
    at = 0
    for to in bounds:
        f, n = first[at:to], after[at:to]
        at = to
        if not len(f):
            continue
        i = np.repeat(f, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        hit = _near(prints[i], prints[j], radius)
        for a, b in zip(prints[i[hit]].tolist(), prints[j[hit]].tolist(), strict=True):
            forest.add(a, b)


def link_dense(home: np.ndarray, calling: np.ndarray, radius: int, forest: Forest) -> None:
    """Links of a large cell: points reached are not compared again, so that n alike points take n comparisons."""
    left = home
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            x = queue.pop()
            near = distance(left, x) <= radius
            for y in left[near].tolist():
                forest.add(int(x), y)
                queue.append(np.uint64(y))
            left = left[~near]
    for y in calling:
        for x in home[distance(home, y) <= radius].tolist():
            forest.add(x, int(y))


def fingerprint_links(prints: DataFrame, radius: int, segments: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a table, within `radius` bits: enough of them to connect all that are linked."""
    segments = segments or (SEGMENTS if prints.count() <= MANY else BITS)
    # a print makes records in about so many cells as it has segments, of 17 bytes, in each half
    buckets = bucket_count(prints, 2 * segments)

    def route(batches):
        for b in batches:
            points = b.column("print").to_numpy().view(np.uint64)
            for k in range(0, len(points), 1 << 15):
                r = grid_records(points[k : k + (1 << 15)], radius, segments)
                of = ((r["cell"] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(of.astype(np.int32), kind="stable")
                at = np.searchsorted(of[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([r[order[at[u] : at[u + 1]]].tobytes() for u in used], pa.binary())], names=["bucket", "records"])

    def link(batches):
        for held in each_bucket(batches):
            forest = Forest()
            link_cells(np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for b in held for x in b.column("records")]), radius, forest)
            pairs = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return by_bucket(prints.mapInArrow(route, "bucket int, records binary"), buckets).mapInArrow(link, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a link; the root is the smallest node of the component.

    Rounds of large-star and small-star (Kiveris and others, 2014): every node sends its
    larger, then its smaller neighbours to the least of them, until nothing changes. Each
    round is written to the shared folder.
    """
    links = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        old, links = links, materialize(small, "links")
        release(old)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.scratch_folder = links.scratch_folder
            return out
        before = now


def simhash_groups(df: DataFrame, *, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Fingerprint of every row, and the group of rows linked by fingerprints within `radius` bits.

    Texts are lower-cased (A-Z), cut at [\x20\x09-\x0D]+, and their `words`-word shingles,
    repeats included, hashed by XXH64; a shorter text is one shingle. Only distinct
    fingerprints are compared. Each is embedded as its bit counts in 32 segments; the
    Manhattan distance of the counts is a lower bound of the Hamming distance. A range join
    over a grid of half-vectors brings points within the radius together, the bound thins
    them out, and the bits decide. Tasks return spanning forests, not pairs.

    Returns a row for each row: id, fingerprint (16 hex digits), component_id (smallest id
    reachable). Null, empty and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows share a group. Null ids are smaller than none: a group of them alone has a
    null component_id. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = materialize(fingerprints(df, words, id_col=id_col, text_col=text_col, seed=seed), "prints")
    points = materialize(rows.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    roots = components(fingerprint_links(points.select("print"), radius))
    named = points.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", "n", F.coalesce("root", "print").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(groups, "root").select(F.col("print").alias("of"), "n", "component_id"), "groups")
    out = join_groups(rows, named, "print")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
