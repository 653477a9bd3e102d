"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import IS_SPACE, SEED, bytes_of, materialize, order_key, row_slices, whole_row
from folia.llm.spans import mixed

#: Buckets of hashed n-grams, and the n-grams added to each, in both models, at the size of the target sample.
BUCKETS, SMOOTHING = 1 << 16, 10.0
#: A document weighs as this many n-grams at most: the n-grams of one text are not independent, and as a plain
#: sum the weights of all but the shortest texts would lie so far apart that no draw could change their order.
EFFECTIVE = 32
#: Labelled rows that the target model is fitted on at most: those first in a seeded order.
TARGET_ROWS = 20_000
_M = 0x9FB21C651E98DF25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0 space, 1 word (letters, digits, _ and all of UTF-8 beyond ASCII), 2 mark
_CLASS = np.full(256, 2, np.uint8)
_CLASS[IS_SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every token and every pair of neighbouring tokens.

    A token is a run of word characters or a run of marks, in lower case. All pairs of a token
    with itself share a bucket: a text that says one word over and over is told by that,
    whatever the word.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    token = kind[start] > 0
    start, end = start[token], end[token]
    up = np.full(len(data) + 1, _M, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.add.accumulate((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    down = np.full(len(data) + 1, pow(_M, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    h = mixed((prefix[end] - prefix[start]) * down[start])
    doc = np.searchsorted(offsets, start, "right") - 1
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = np.where(h[pair] == h[pair + 1], np.uint64(1), mixed(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]))
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([h & mask, two & mask]).astype(np.int64), np.concatenate([doc, doc[pair]])


def _weights(batch: pa.RecordBatch, ratio: np.ndarray) -> np.ndarray:
    """The log ratio of each text's probabilities, tempered: its mean over n-grams, EFFECTIVE times at most."""
    bucket, doc = ngrams(*bytes_of(batch.column("text")))
    n = np.maximum(np.bincount(doc, minlength=batch.num_rows), 1)
    return np.bincount(doc, ratio[bucket], minlength=batch.num_rows) / n * np.minimum(n, EFFECTIVE)


def fit_ratio(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log(target / raw) of every n-gram bucket: raw from all docs, target from the docs whose id is in `target`.

    docs has id and text, target a bounded set of ids. Counts are summed per task and then by
    bucket; the driver gets BUCKETS rows however large the corpus.
    """

    def count(batches):
        raw, of_target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in row_slices(whole):
                bucket, doc = ngrams(*bytes_of(b.column("text")))
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = b.column("chosen").to_numpy(zero_copy_only=False)
                of_target += np.bincount(bucket[chosen[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(of_target[some])], names=["bucket", "raw", "target"])

    chosen = docs.join(F.broadcast(target.select(F.col("id").alias("t")).distinct()), F.col("id") == F.col("t"), "left").select("text", F.col("t").isNotNull().alias("chosen"))
    rows = chosen.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, of_target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in rows:
        raw[bucket], of_target[bucket] = r, t
    if not of_target.any():
        return np.zeros(BUCKETS)
    # Both models are smoothed alike: a bucket that the target should have seen seldom says little.
    return np.log(of_target + SMOOTHING) - np.log(raw * (of_target.sum() / raw.sum()) + SMOOTHING)


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def score(docs: DataFrame, ratio: np.ndarray, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, log_weight, and the place in the resampling order: log_weight plus seeded Gumbel noise, as a long that sorts alike."""

    def each(batches):
        for whole in batches:
            for b in row_slices(whole):
                w = _weights(b, ratio)
                u = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in b.column("id").to_pylist()], np.uint64)
                noise = -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0**64))
                yield pa.RecordBatch.from_arrays([b.column("id"), *[b.column(c) for c in carry], pa.array(w), pa.array(_ordered_bits(w + noise))], names=["id", *carry, "log_weight", "place"])

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("id", "text", *carry).mapInArrow(each, f"id long, {kept + ', ' if kept else ''}log_weight double, place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting 16 bits at a time; None if there are fewer rows."""
    found, left = None, k
    for shift in (48, 32, 16, 0):
        part = rows if found is None else rows.filter(F.shiftright(column, shift + 16) == found)
        counts = part.groupBy(F.shiftright(column, shift).alias("v")).count().collect()
        for v, n in sorted(counts, reverse=True):
            if left <= n:
                found = v
                break
            left -= n
        else:
            return None
    return found


class Selection:
    """A fitted model and the least place that is still kept."""

    def __init__(self, ratio: np.ndarray, least: int, seed: int, scores: DataFrame):
        self.ratio, self.least, self.seed, self.scores = ratio, least, seed, scores


def fit_selection(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", keep_good: float = 0.995, rows: int | None = None, target_rows: int = TARGET_ROWS, seed: int = SEED
) -> Selection:
    """Fit the target and raw models and find which rows a Gumbel top-k sample of the corpus takes.

    The target model is fitted on every other of at most target_rows good labelled rows, taken
    in a seeded order; the raw model on all rows of df. A row's importance weight is the ratio
    of its n-grams' probabilities under the two, tempered to EFFECTIVE n-grams. The rest of the
    labelled rows set the size of the sample: k is the number of rows whose weight reaches that
    of the keep_good share of them (or `rows`, if given). The k rows with the largest log weight
    plus Gumbel noise are a sample without replacement in proportion to the weights: rows well
    above the last one taken are in any sample, those near it come and go with the seed.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = order_key(seed, F.col("id"))
    known = labels.filter(good).select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("key", order).orderBy("key").limit(target_rows)
    known = materialize(known.withColumn("half", F.crc32(F.col("key").cast("binary")) % 2), "labelled")
    ratio = fit_ratio(docs, known.filter("half = 0"))
    scores = materialize(score(docs, ratio, seed), "scores")
    if rows is None:
        held = docs.join(F.broadcast(known.filter("half = 1").select("id")), "id", "left_semi")
        weights = [r[0] for r in score(held, ratio, seed).select("log_weight").collect()]
        cut = float(np.quantile(weights, 1 - keep_good)) if weights else -np.inf
        rows = scores.filter(F.col("log_weight") >= cut).count()
    least = kth_largest(scores, "place", rows) if rows else 2**63 - 1
    return Selection(ratio, -(2**63) if least is None else least, seed, scores)


def select_quality(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of df that the resampling takes, unchanged. Options as in fit_selection.

    Null or empty text: no n-grams, weight 1. Without good labels every weight is 1 and
    chance decides nothing: all rows are kept. Rows with one id and text share their noise, so repeated
    rows go together; rows tied with the last one taken are taken too. Empty table: no rows.
    Columns are passed on whatever their names.
    """
    fitted = fit_selection(df, labels, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), whole_row(df).alias("row"))
    return score(docs, fitted.ratio, fitted.seed, ("row",)).filter(F.col("place") >= fitted.least).select("row.*")
