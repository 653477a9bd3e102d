"""Groups of near copies by the Jaccard similarity of word shingles, with no link lost at any size.

The segment-popcount embedding of the fingerprint operator, at a similarity that fingerprints
of 64 bits cannot decide: a text's set of shingle hashes is cut into segments of the hash space,
and the embedding is the number of shingles in each. The Manhattan distance of two embeddings
is a lower bound of the sets' symmetric difference, which a similarity bounds from above.
Candidates come from a grid over the embedding, at its finest (a segment for each hash value):
a cell is a part of the dimensions and what a set has there, as half vectors are for
fingerprints. The bound thins candidates out; the sets decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import IS_SPACE, SEED, join_groups, materialize, maybe_broadcast, odd_ids, release, row_slices, whole_row
from folia.llm.simhash import Forest, components
from folia.llm.spans import bucket_count, by_bucket, each_bucket, mixed

#: Segments of the embedding: one byte a segment, counts of 255 and more alike.
SEGMENTS = 256
#: Texts of a cell of which all pairs are compared at once; of more, at first one text with the rest.
SMALL = 4
#: Texts of a cell of which all pairs that are in different groups are compared at last; of more, blocks meet.
MEDIUM = 64
#: Texts of a cell that are held at once where block meets block.
BLOCK = 1024
#: Texts counted to tell common shingles from rare ones, and the shingles kept of that count.
SAMPLED, COMMON = 5_000, 1 << 16
#: First size of each band of sizes, each of which has a grid.
BANDS = 4 ** np.arange(31, dtype=np.int64)
#: Bytes of a shingle beyond which its hash is XXH64, and bytes of a text that are summed up at once.
LONG, WINDOW = 512, 1 << 17
#: Bytes as they count: lower case, any space alike.
LINE = np.frombuffer(bytes(0x20 if IS_SPACE[k] else k for k in range(256)).lower(), np.uint8)
#: What a byte stands for, powers of an odd number, and their inverses, modulo 2^64.
BASE = 0xD1342543DE82EF95
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))
POWERS, INVERSE = (np.cumprod(np.r_[np.uint64(1), np.full(WINDOW + LONG - 1, x, np.uint64)], dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
#: A text's place in a cell: what its bucket leaves open of the cell's hash, and the text's place in the batch's list.
TOKEN = np.dtype([("low", "<u4"), ("high", "<u2"), ("text", "<u2")])
TEXT = np.dtype([("id", "<i8"), ("n", "<u4")])
MEMBER = np.dtype([("id", "<i8"), ("n", "<u4")])


def shingle_set(text: bytes, words: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted.

    A shingle is the bytes from a word to the end of another, with one space between words. Its hash is a
    polynomial in its bytes, from sums over the line, spread over all bits; that of a long one is XXH64.
    """
    data = np.frombuffer(text, np.uint8)
    space = IS_SPACE[data]
    # of a run of spaces the last stays, and none before the first word
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]
    if len(keep):
        keep[0] &= not space[0]
    data, space = LINE[data[keep]], space[keep]
    if not len(data):
        return np.zeros(0, np.uint64)
    if space[0]:
        data, space = data[1:], space[1:]
    gaps = np.flatnonzero(space)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    n = min(len(starts), words)
    starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    found = np.zeros(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + WINDOW, WINDOW)).tolist()
    for k, at in enumerate(range(0, len(data), WINDOW)):
        part = data[at : at + WINDOW + LONG]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * POWERS[: len(part)], out=sums[1:])
        of = slice(cuts[k], cuts[k + 1])
        found[of] = (sums[np.minimum(ends[of] - at, len(part))] - sums[starts[of] - at]) * INVERSE[starts[of] - at]
    found = mixed(found ^ np.uint64(seed))
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        found[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]]


def embed_set(s: np.ndarray) -> np.ndarray:
    """Shingles in each segment of the hash space, up to 255."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.intp), minlength=SEGMENTS), 255).astype(np.uint8)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings (last axis): no more than the sets' symmetric difference."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(-1, dtype=np.int64)


def most_apart(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Symmetric difference that sets of these sizes and this similarity can have at most."""
    return (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-6


def size_bands(n: np.ndarray) -> np.ndarray:
    """The bands of sizes: from each power of four to the next."""
    return np.searchsorted(BANDS, np.asarray(n, np.int64), "right") - 1


def grid_cells(s: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of the cells of the grid at which a set meets all sets of this similarity or more.

    There is a grid for each band of sizes, for pairs whose larger set is of that band: a set is at
    home in its own, and calls at the next one if so much larger sets can be similar. The last bit of a cell
    is that of its band. Sets that similar differ in at most `most` hashes, given the size of one; the
    hash space is cut into half as many parts again as the largest of the band may differ in, and a set's
    cell in a part is all that it has there. All but `most` cells of the two are alike, so that in any
    one order of all cells the first most + 1 of each have one in common: those are enough. Cells come in
    the order of their rarest shingle, by sampled count (0 if not in common), empty ones last.
    """
    if not len(s):
        return s
    weight = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        weight = np.where(common[at] == s, counts[at], 0)
    hashes = mixed(s)
    largest = math.floor(len(s) / similarity + 1e-9)
    out = []
    for grid in range(int(size_bands(len(s))), int(size_bands(largest)) + 1):
        top = int(BANDS[grid]) * 4 - 1
        most = int(most_apart(top, top, similarity))
        parts = most + 1 + most // 2
        of = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        used = of[starts]
        most = int(most_apart(len(s), min(largest, top), similarity))
        cells, rank = np.add.reduceat(hashes, starts), np.minimum.reduceat(weight, starts)
        if len(used) <= most:
            empty = np.setdiff1d(np.arange(parts), used)
            used, cells, rank = np.r_[used, empty], np.r_[cells, np.zeros(len(empty), np.uint64)], np.r_[rank, np.full(len(empty), np.iinfo(np.int64).max)]
        cells = mixed(cells + mixed(used.astype(np.uint64) + np.uint64(grid + 1 << 40))) >> np.uint64(1) << np.uint64(1) | np.uint64(grid & 1)
        out.append(cells[np.lexsort((cells, rank))[: most + 1]])
    return np.concatenate(out)


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """False where sizes rule a pair out."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9


def first_pairs(m: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs (a, b) of ids, a < b, of the texts of one cell: all of a few, else of one with the rest.

    That one has the least mixed id, so that cells of the same texts mostly choose the same.
    """
    if len(m) <= SMALL:
        i, j = np.triu_indices(len(m), 1)
    else:
        head = int(np.argmin(mixed(m["id"].view(np.uint64))))
        j = np.delete(np.arange(len(m)), head)
        i = np.full(len(j), head)
    keep = may_be_similar(m[i], m[j], similarity)
    x, y = m["id"][i[keep]], m["id"][j[keep]]
    return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)


def pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def common_shingles(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a seeded sample of texts have, sorted, and their counts: COMMON of them at most.

    They order cells, and so decide the work, not the result.
    """
    share = min(1.0, SAMPLED / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def each(batches):
        for whole in batches:
            for b in row_slices(whole):
                sets = [shingle_set(t.as_buffer().to_pybytes(), words, seed) for t in b.column("text") if t.is_valid]
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = sample.mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    return h[(order := np.argsort(h))], n[order]


def shared_tokens(points: DataFrame) -> DataFrame:
    """(token, m, members) of each cell in which several points (id, n, cells) are, one of them at home; of those with the same points one.

    A cell is sent as 48 bits of its hash beside its bucket. Two that are taken for one
    only make more candidates.
    """
    buckets = bucket_count(points, 2)

    def route(batches):
        for whole in batches:
            for part in row_slices(whole, "cells"):
                for k in range(0, part.num_rows, 1 << 16):
                    b = part.slice(k, 1 << 16)
                    held = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("cells")]
                    sizes = np.array([len(x) for x in held], np.int64)
                    cells = np.concatenate([np.zeros(0, np.uint64), *held])
                    h = mixed(cells) >> np.uint64(1) << np.uint64(1) | cells & np.uint64(1)
                    texts = np.empty(len(held), TEXT)
                    texts["id"], texts["n"] = b.column("id").to_numpy(), b.column("n").to_numpy()
                    r = np.empty(len(h), TOKEN)
                    r["low"], r["high"] = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) & np.uint64(0xFFFF)
                    r["text"] = np.repeat(np.arange(len(held)), sizes)
                    of = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
                    order = np.argsort(of, kind="stable")
                    at = np.searchsorted(of[order], np.arange(buckets + 1))
                    used = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *zip_records(r[order], at, used, texts)], names=["bucket", "records", "texts"])

    def gather(batches):
        for rows in each_bucket(batches):
            held = []
            for b in rows:
                for r, t in zip(b.column("records"), b.column("texts"), strict=True):
                    r, t = np.frombuffer(r.as_buffer(), TOKEN), np.frombuffer(t.as_buffer(), TEXT)
                    m = np.empty(len(r), [("token", "<u8"), *[(k, MEMBER[k]) for k in MEMBER.names]])
                    m["token"] = r["low"].astype(np.uint64) | r["high"].astype(np.uint64) << np.uint64(32)
                    m["id"], m["n"] = t["id"][r["text"]], t["n"][r["text"]]
                    held.append(m)
            r = np.concatenate(held)
            # in the order of ids, for cells of the same texts to be alike
            r = r[np.lexsort((r["id"], r["token"]))]
            cut = np.flatnonzero(np.r_[True, r["token"][1:] != r["token"][:-1]])
            sizes = np.diff(np.r_[cut, len(r)])
            keep = (sizes > 1) & np.logical_or.reduceat(size_bands(r["n"]) & 1 == (r["token"] & np.uint64(1)).astype(np.int64), cut)
            cut, sizes = cut[keep], sizes[keep]
            m = np.empty(len(r), MEMBER)
            for k in MEMBER.names:
                m[k] = r[k]
            token = r["token"] | np.uint64((int(rows[0].column("bucket")[0].as_py()) & 0xFFFF) << 48)
            for k in range(0, len(cut), 10_000):
                part = slice(k, k + 10_000)
                members = [m[a : a + n].tobytes() for a, n in zip(cut[part].tolist(), sizes[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(token[cut[part]].view(np.int64)), pa.array(sizes[part]), pa.array(members, pa.binary())], names=["token", "m", "members"])

    packed = points.select("id", "n", "cells").mapInArrow(route, "bucket int, records binary, texts binary")
    cells = by_bucket(packed, buckets).mapInArrow(gather, "token long, m long, members binary")
    return cells.groupBy("members").agg(F.min("token").alias("token"), F.max("m").alias("m")).select("token", "m", "members")


def zip_records(r: np.ndarray, at: np.ndarray, used: np.ndarray, texts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The records of each bucket, with only the texts they name."""
    records, named = [], []
    for u in used:
        part = r[at[u] : at[u + 1]].copy()
        of, part["text"] = np.unique(part["text"], return_inverse=True)
        records.append(part.tobytes())
        named.append(texts[of].tobytes())
    return pa.array(records, pa.binary()), pa.array(named, pa.binary())


def bounded_pairs(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose embeddings are not too far apart."""

    def near(batches):
        for b in batches:
            ea, eb = [np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in b.column(c)), np.uint8).reshape(-1, SEGMENTS) for c in ("ea", "eb")]
            keep = apart(ea, eb) <= most_apart(b.column("na").to_numpy(), b.column("nb").to_numpy(), similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    def side(k):
        return points.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("emb").alias(f"e{k}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ea", "eb").mapInArrow(near, "a long, b long")


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """Those of the pairs (a, b), a table, whose shingle sets have this similarity or more, by the sets themselves."""

    def sets(batches):
        for whole in batches:
            for b in row_slices(whole):
                found = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed).tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    held = materialize(texts.join(named, F.col("id") == F.col("of"), "left_semi").mapInArrow(sets, "id long, shingles binary"), "sets")
    first = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    links = materialize(first.join(held.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    release(held)
    return links


def block_pairs(rows: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Pairs across labels of the texts (token, m, id, n, label, emb) of each token that embeddings leave: block against block.

    All such pairs, or as a forest the closest ones that would join all labels that any pair joins.
    A token's texts are cut into blocks of about BLOCK by their ids, and each two of its blocks meet in one
    group, so that no task holds more, however many texts a token has.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "n", "label", "emb")

    def each(key, part):
        lo, hi = key[1].as_py(), key[2].as_py()
        m = np.empty(len(part), MEMBER)
        for k in MEMBER.names:
            m[k] = part[k].to_numpy()
        label, block = part["label"].to_numpy(), part["block"].to_numpy()
        emb = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in part["emb"]), np.uint8).reshape(-1, SEGMENTS)
        found, slack = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for k in np.flatnonzero(block == lo).tolist():
            other = np.flatnonzero(((block == hi) if lo != hi else (np.arange(len(m)) > k)) & (label != label[k]))
            other = other[may_be_similar(m[np.full(len(other), k)], m[other], similarity)]
            share = apart(emb[other], emb[k]) / most_apart(m["n"][other].astype(np.int64), int(m["n"][k]), similarity)
            other = other[share <= 1]
            found.append(np.stack([np.full(len(other), k), other], 1))
            slack.append(share[share <= 1])
        found = np.concatenate(found)
        if forest:
            trees = Forest()
            joins = [trees.add(x, y) for x, y in label[found[np.argsort(np.concatenate(slack), kind="stable")]].tolist()]
            found = found[np.argsort(np.concatenate(slack), kind="stable")][joins]
        ends = np.sort(m["id"][found], axis=1)
        return pa.Table.from_batches([pairs_batch([ends])])

    return rows.groupBy("token", "lo", "hi").applyInArrow(each, "a long, b long").distinct()


def cell_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) across labels of the texts (token, id, n, label) of each token, of sizes that may be similar."""
    a, b = rows.alias("a"), rows.alias("b")
    fit = F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - 1e-9
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label")) & fit).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def set_links(points: DataFrame, texts: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """Links (a, b) between points, each of this similarity or more: enough of them to connect all that are linked.

    Two sets that similar meet in a cell of the grid (see grid_cells). Of a
    cell with many texts one text is compared with the rest, twice, which settles most of a
    group of near copies in as many comparisons as it has texts. Among what is not in one group then
    block meets block: first only the closest pairs that could join groups are verified,
    and at last all that are left across groups.
    """
    tokens = materialize(shared_tokens(points), "tokens")

    def start(batches):
        for b in batches:
            yield pairs_batch([first_pairs(np.frombuffer(x.as_buffer(), MEMBER), similarity) for x in b.column("members")])

    def unpack(batches):
        for b in batches:
            for token, x in zip(b.column("token").to_pylist(), b.column("members"), strict=True):
                m = np.frombuffer(x.as_buffer(), MEMBER)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), token)), pa.array(np.full(len(m), len(m))), *[pa.array(m[k].astype(np.int64)) for k in MEMBER.names]], names=["token", "m", *MEMBER.names])

    def verified(pairs: DataFrame) -> DataFrame:
        near = materialize(bounded_pairs(pairs, points, similarity), "pairs")
        found = similar_pairs(near, texts, similarity, words, seed)
        release(near)
        return found

    links = verified(tokens.select("members").mapInArrow(start, "a long, b long").distinct())
    if not tokens.filter(F.col("m") > SMALL).limit(1).count():
        return links
    large = tokens.filter(F.col("m") > SMALL).select("token", "members").mapInArrow(unpack, "token long, m long, id long, n long")
    for turn in ("head", "forest", "all"):
        roots = components(links)
        labelled = large.join(roots, F.col("id") == F.col("node"), "left").select("token", "m", "id", "n", F.coalesce("root", "id").alias("label"))
        labelled = materialize(labelled, "labelled")
        open_ = materialize(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"), "open")
        before, large = large, materialize(labelled.join(maybe_broadcast(open_), "token", "left_semi"), "large")
        release(before, roots, labelled, open_)
        if not large.limit(1).count():
            break
        if turn == "head":
            heads = materialize(large.groupBy("token").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id")).alias("h")), "heads")
            pairs = large.join(maybe_broadcast(heads), "token").filter(F.col("label") != F.col("h.label")).select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct()
        else:
            many = large.filter(F.col("m") > MEDIUM)
            crowded = bool(many.limit(1).count())
            turn = turn if crowded else "all"
            pairs = block_pairs(many.join(points.select("id", "emb"), "id"), similarity, turn == "forest") if crowded else None
            if turn == "all":
                few = cell_pairs(large.filter(F.col("m") <= MEDIUM), similarity)
                pairs = pairs.union(few).distinct() if crowded else few
        more = verified(pairs)
        links, old = materialize(links.union(more), "links"), (links, more)
        release(*old)
        if turn == "all":
            break
    return links


def similar_groups(df: DataFrame, *, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Groups of rows linked by sets of shingles whose Jaccard similarity is at least `similarity`.

    Shingles as in simhash_groups, each once, by 64 bits of hash. Of texts with one set the
    least id stands for all. Candidates are texts that share a cell of the grid (see
    grid_cells), which every pair of that similarity does, at any number of rows; a candidate
    is a link only if the bound of its embeddings and then the sets themselves say so.

    Returns id and component_id (smallest id of the group) of every row. Ids are distinct and
    not null (one_of_each_group numbers others). Null, empty and blank texts have the empty
    set, and are one group. Repeated texts share a group. Empty table: no rows. Other columns
    are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common, counts = common_shingles(texts, words, seed)

    def placed(batches):
        for whole in batches:
            for b in row_slices(whole):
                keys, sizes, found, embedded = [], [], [], []
                for t in b.column("text"):
                    s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    found.append(grid_cells(s, common, counts, similarity).tobytes())
                    embedded.append(embed_set(s).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(embedded, pa.binary())], names=["id", "key", "n", "cells", "emb"])

    rows = materialize(texts.mapInArrow(placed, "id long, key binary, n long, cells binary, emb binary"), "placed")
    classes = materialize(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    points = rows.join(classes.select("least"), F.col("id") == F.col("least"), "left_semi").select("id", "n", "cells", "emb")
    links = set_links(points, texts, similarity, words, seed)
    named = classes.join(components(links), F.col("least") == F.col("node"), "left").select(F.col("key").alias("of"), "n", F.coalesce("root", "least").alias("component_id"))
    return join_groups(rows.select("id", "key"), materialize(named, "groups"), "key").select(F.col("id").alias(id_col), "component_id")


def one_of_each_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df of which each is the one with the smallest id in its group, unchanged.

    Of rows with one id, or of a group without ids, one stays. Null, empty and blank texts are
    one group. Empty table: no rows. Columns are passed on whatever their names. Groups and
    options are those of similar_groups.
    """
    if odd_ids(df, id_col):
        rows = df.orderBy(F.col(id_col).asc_nulls_last()).select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"), whole_row(df).alias("row"))
        rows = materialize(rows, "rows")
    else:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), whole_row(df).alias("row"))
    groups = similar_groups(rows.select("id", "text"), id_col="id", text_col="text", **options)
    return rows.join(groups.filter("id = component_id").select("id"), "id", "left_semi").select("row.*")
