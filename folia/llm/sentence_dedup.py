"""Removal of repeated sentence spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import row_slices
from folia.llm.spans import PLACE, ROUTED, SPAN, blobs, bucket_count, buffered, by_bucket, each_bucket, joined, mixed, numbered, packed_spans, per_doc, settle, spans_of, union_of

#: A run is at least so many sentences, and goes on until it also has so many words.
SENTENCES = 3
WORDS = 15
#: A sentence of more words is read clause by clause.
LONG = 25
# A sentence ends after these marks and white space, or at a line end; a clause after commas and the like.
_END, _CLAUSE = re.compile(rb"[.!?]+[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n\s*"), re.compile(rb"[,;:]+[ \t\r\x0b\x0c]+")
# Beyond ASCII: marks of Arabic, Ethiopic and the ellipsis need white space as well, which may be a wide one; East Asian marks and dandas need none.
_SPACE = r"[ \t\r\x0b\x0c\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_WIDE_END, _WIDE_CLAUSE = r"[\u3002\uff01\uff0e\uff1f\uff61\u0964\u0965]", r"[\u3001\uff0c\uff1a\uff1b\uff64]"
_ANY_END = re.compile(rf"[.!?\u2026\u061f\u06d4\u1362\u1367\u1368]+{_SPACE}+|{_WIDE_END}+[.!?]*{_SPACE}*|{_SPACE}*[\n\u0085\u2028\u2029]\s*")
_ANY_CLAUSE = re.compile(rf"[,;:\u060c\u061b\u1361\u1363-\u1366]+{_SPACE}+|{_WIDE_CLAUSE}+[,;:]*{_SPACE}*")
# Scripts without spaces: kana, ideographs.
_UNSPACED = re.compile(r"[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
_M1, _M2 = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def _cut(text, end: re.Pattern, clause: re.Pattern, most: int) -> list[int]:
    """Ends of sentences, and of clauses in those of more than `most` words, kana or ideographs."""
    ends, at = [], 0
    for to in [*[m.end() for m in end.finditer(text)], len(text)]:
        part = text[at:to]
        if len(part) > most and (len(part.split()) > most or (isinstance(part, str) and len(_UNSPACED.findall(part)) > most)):
            ends += [at + m.end() for m in clause.finditer(part) if m.end() < len(part)]
        if to > at:
            ends.append(to)
        at = to
    return ends


def sentence_bounds(data: bytes, most: int = LONG) -> list[int]:
    """0, the ends of all sentences, and the length of the text; each end includes what separates."""
    if data.isascii():
        return [0, *_cut(data, _END, _CLAUSE, most)] if data else [0, 0]
    text, at, place, out = data.decode("utf-8", "surrogateescape"), 0, 0, [0]
    for to in _cut(text, _ANY_END, _ANY_CLAUSE, most):
        place += len(text[at:to].encode("utf-8", "surrogateescape"))
        at = to
        out.append(place)
    return out


def sentence_runs(data: bytes, sentences: int, words: int, long: int | None = None) -> tuple[np.ndarray, ...]:
    """h, check, first and end sentence of each run: from every sentence, the shortest run that is long enough.

    With `long`, also the shortest such run up to the end of every sentence, so that nothing
    is left of a repeated stretch that holds a run; each sentence of so many words; and the
    whole of a text that has no run; kana and ideographs then count as words. Sentences are compared by their words (white
    space does not count); sentences without a word count for nothing and are skipped over.
    """
    bounds = sentence_bounds(data)
    split = [data[a:b].split() for a, b in zip(bounds, bounds[1:], strict=False)]
    real = [k for k, w in enumerate(split) if w]
    n = np.array([len(split[k]) for k in real], np.int64)
    if not len(n):
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64), z.astype(np.int64)
    u = np.array([xxhash.xxh3_64_intdigest(b" ".join(split[k])) for k in real], np.uint64)
    if long and not data.isascii():
        n = np.maximum(n, [len(_UNSPACED.findall(data[bounds[k] : bounds[k + 1]].decode("utf-8", "surrogateescape"))) for k in real])
    total = np.r_[0, np.cumsum(n)]
    end = np.maximum(np.arange(len(n)) + sentences, np.searchsorted(total, total[:-1] + words))
    start = np.flatnonzero(end <= len(n))
    end = end[start]
    if long:
        alone, last = np.flatnonzero(n >= long), np.arange(1, len(n) + 1)
        back = np.minimum(last - sentences, np.searchsorted(total, total[1:] - words, "right") - 1)
        last, back = last[back >= 0], back[back >= 0]
        start, end = np.unique(np.stack([np.r_[start, back, alone], np.r_[end, last, alone + 1]]), axis=1)
        if not len(start):
            start, end = np.zeros(1, np.int64), np.full(1, len(n))
    keys = []
    for m in (_M1, _M2):
        power = np.ones(len(n), np.uint64)
        power[1:] = np.uint64(m)
        power = np.multiply.accumulate(power)
        back = np.ones(len(n), np.uint64)
        back[1:] = np.uint64(pow(m, -1, 1 << 64))
        back = np.multiply.accumulate(back)
        prefix = np.r_[np.zeros(1, np.uint64), np.add.accumulate(mixed(u) * power)]
        keys.append(mixed((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64)))
    real = np.array(real)
    return keys[0], keys[1], real[start], real[end - 1] + 1


def sentence_span_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, long: int | None = None) -> DataFrame:
    """Remove sentences that lie in a run which an earlier document, or an earlier place, also has.

    From each sentence on, the shortest run of at least `sentences` sentences and `words`
    words is hashed. Of the places of one hash in all documents the first, by (id, place),
    stays; the sentences of all other places go. Sentences end at .!? before white space, at the
    like marks of other scripts and at line ends; one of over 25 words is read as its clauses,
    which end at ,;: and the like, because a passage's cut ends lie within such sentences. With `long`, runs are also taken back from the end of each sentence, a sentence
    of that many words is a run of its own, and a text too short for any run is one as a whole.

    Mappers settle repeats inside their own buffers and send one place of each hash; a hash
    in a third of all documents thus reaches its reducer once per buffer.

    Returns a row for each row: id, text (what stays), n_sentences, n_removed. Null text: null,
    0, 0. Empty text: empty, 0, 0. Texts shorter than a run lose nothing without `long`. Rows with a repeated
    or null id are documents of their own, ordered by id (null last) and text. Empty table: no
    rows. Other columns are ignored, whatever their names.
    """
    docs = numbered(df, id_col, text_col)
    buckets = bucket_count(docs)

    def places(batches):
        def each():
            for b in batches:
                for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                    if text.is_valid:
                        h, check, at, to = sentence_runs(text.as_buffer().to_pybytes(), sentences, words, long)
                        if len(h):
                            out = np.empty(len(h), PLACE)
                            out["h"], out["check"], out["doc"], out["at"], out["to"] = h, check, doc, at, to
                            yield out

        yield from buffered(each(), buckets)

    def repeats(batches):
        def each():
            for held in each_bucket(batches):
                yield np.concatenate([blobs(b.column("spans"), SPAN) for b in held])
                yield spans_of(settle(np.concatenate([blobs(b.column("places"), PLACE) for b in held]))[1])

        yield from packed_spans(each(), buckets)

    def apply(batches):
        for whole in batches:
            for b in row_slices(whole):
                texts, total, gone = [], [], []
                for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    bounds = sentence_bounds(data)
                    total.append(len(bounds) - 1 if data else 0)
                    if not spans:
                        texts.append(data if text.is_valid else None)
                        gone.append(0)
                        continue
                    at, to = union_of(np.frombuffer(spans, SPAN))
                    edges = [0, *[x for a, z in zip(at, to, strict=True) for x in (bounds[a], bounds[z])], len(data)]
                    texts.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    gone.append(int((to - at).sum()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["id", "text", "n_sentences", "n_removed"])

    routed = docs.select("doc", "text").mapInArrow(places, ROUTED)
    packed = by_bucket(routed, buckets).mapInArrow(repeats, "bucket int, spans binary")
    out = docs.join(per_doc(packed, "spans", SPAN, buckets, joined), "doc", "left").select("id", "text", "spans").mapInArrow(apply, "id long, text string, n_sentences long, n_removed long")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "n_removed")
