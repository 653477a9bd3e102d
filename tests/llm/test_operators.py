"""Each operator against a plain version of itself, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folia.llm import bwt
from folia.llm.exact_dedup import exact_dedup
from folia.llm.line_dedup import dedup_document_lines, dedup_page_lines
from folia.llm.media import ArchiveReader, ArchiveSource, ByteRange, features, from_wav, media_features, padded, read_features, to_wav, write_media
from folia.llm.mixing import mix_sources, mixed_rows
from folia.llm.packing import LENGTHS, best_fit, pack, pack_documents, sequence_cost
from folia.llm.quality import fit_selection, kth_largest, ngrams, select_quality
from folia.llm.sentence_dedup import sentence_bounds, sentence_span_dedup
from folia.llm.sharding import interleave_shards
from folia.llm.simhash import components, embed, fingerprint, fingerprint_links, simhash_groups
from folia.llm.similar import one_of_each_group
from folia.llm.suffix_dedup import repeated_strings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASHES = {"id": 7, "size": 8, "key": "k", "row": "r", "doc": 9, "spans": "s", "part": 1, "group": 2, "print": 3, "host": "h", "lines": "l", "slice": "x", "place": 4, "copy": 5, "shard": 6, "kept": True}
LONG = " ".join(f"w{k}." if k % 9 == 0 else f"w{k}" for k in range(20_000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward():
    same = "The same text, again. It has some sentences, and it repeats. All of it is as it was before, word for word."
    texts = [None, "", " \t\n", "one", same, same, same, LONG, LONG + " tail", "ÄÖ ü é\n ß 漢字", "a\x00b", same + " More.", None, ""]
    rows = [(k, t, "en", "s1" if k % 3 else "s0", 0) for k, t in enumerate(texts)]
    rows += [(4, same, "en", "s1", 0), (None, "no id", None, None, None), (None, None, None, None, None), (2**53 + 1, "big id", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward(), SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    make = lambda k: " ".join(rng.choice(words) + rng.choice(("", "", "", ".", ",", "\n")) for _ in range(k))
    docs = [make(rng.randint(1, 120)) for _ in range(n)]
    passage = make(60)
    for k in range(0, n, 10):
        docs[k] = make(20) + ". " + passage + ". " + make(10)
    for k in range(5, n, 12):
        docs[k] = docs[k - 1]
    for k in range(7, n, 12):
        docs[k] = docs[k - 1].replace("w1", "q1", 1)
    return [(k, t, "en", f"s{int(rng.random() ** 2 * 4)}", len(t)) for k, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


# sharding


def test_shards(docs, rows, none):
    got = interleave_shards(docs, 7, group_rows=5).collect()
    want = defaultdict(list)
    for d, _, _, s, _ in corpus():
        want[s].append(hashlib.md5(f"42:{d}".encode()).hexdigest() + f"/{d}")
    order = sorted(((k + 0.5) / len(v), key, int(key.split("/")[1])) for v in want.values() for k, key in enumerate(sorted(v)))
    places = {d: k for k, (*_, d) in enumerate(order)}
    for r in got:
        at = places[r.doc_id]
        assert r.shard == at * 7 // len(order) and r.slot == at - -(-r.shard * len(order) // 7)
    text = {d: t for d, t, *_ in corpus()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    odd = interleave_shards(rows, 40).collect()
    assert len(odd) == len(awkward()) and all(r.size == 16 and r.text_crc32 == 0 for r in odd if r.doc_id in (0, 1))
    assert max(Counter(r.shard for r in odd).values()) == 1 and interleave_shards(none, 40).count() == 0


# quality


def test_ngrams():
    data = "Ab ab!! é_1\n".encode()
    bucket, doc = ngrams(np.frombuffer(data + b"ab", np.uint8), np.array([0, len(data), len(data) + 2]))
    assert doc.tolist() == [0, 0, 0, 0, 1, 0, 0, 0] and bucket[0] == bucket[1] == bucket[4] and bucket[5] == 1 and len(set(bucket.tolist())) == 6


def test_quality(spark, rows, none):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(("the", "of", "and", "river", "stone", "green")) + rng.choice(("", ".")) for _ in range(rng.randint(20, 60)))
    junk = lambda: " ".join(rng.choice(("ZX", "QQ", "buy")) + "!!" for _ in range(rng.randint(20, 60)))
    table = [(k, junk() if k % 5 == 0 else good(), "en", "s", 0) for k in range(400)]
    df = spark.createDataFrame(table, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in select_quality(df, labels).collect()}
    junk_ids = {k for k in range(400) if k % 5 == 0}
    assert len(kept & junk_ids) <= 2 and len(kept - junk_ids) >= 312
    fitted = fit_selection(df, labels, rows=100)
    # the plain form of Gumbel top-k over the same weights
    noise = {k: -np.log(-np.log((xxhash.xxh64_intdigest(str(k), 42) + 0.5) / 2.0**64)) for k in range(400)}
    scores = {r.id: r.log_weight for r in fitted.scores.collect()}
    best = sorted(scores, key=lambda k: -(scores[k] + noise[k]))[:100]
    assert {r.id for r in fitted.scores.collect() if r.place >= fitted.least} == set(best)
    # the draw decides near the last row taken: samples differ by seed, and heavier rows are in more of them
    draws = [{r.id for r in f.scores.filter(f"place >= {f.least}").collect()} for f in (fit_selection(df, labels, rows=100, seed=k) for k in (1, 2, 3))]
    assert all(len(a & b) < 95 for a in draws for b in draws if a is not b)
    out = select_quality(rows, labels.limit(0))
    assert out.columns == rows.columns and out.count() == len(awkward())
    assert select_quality(none, labels).count() == 0
    assert kth_largest(spark.createDataFrame([(x,) for x in (-5, 3, 3, 2**62, -(2**63))], "v long"), "v", 3) == 3


def plain_quality(table, labelled, seed=42, effective=32, keep_good=0.995):
    """Log weights of all rows and the ids taken, with dictionaries of tokens and whole-number arithmetic."""
    m64, mult = (1 << 64) - 1, 0x9FB21C651E98DF25

    def stir(x):
        for shift, by in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
            x = ((x ^ x >> shift) * by) & m64
        return x ^ x >> 32

    def grams(text):
        tokens = re.findall(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\x20\x09-\x0d]+", (text or "").encode().lower())
        h = [stir(sum((c + 1) * pow(mult, i, 1 << 64) for i, c in enumerate(t)) & m64) for t in tokens]
        pairs = [1 if a == b else stir((a * 0x9E3779B97F4A7C15 + b) & m64) for a, b in zip(h, h[1:], strict=False)]
        return [x & 0xFFFF for x in h + pairs]

    key = {d: hashlib.md5(f"{seed}:{d}".encode()).hexdigest() for d in labelled}
    half = {d: zlib.crc32(key[d].encode()) % 2 for d in labelled}
    held_grams = {d: grams(t) for d, t, *_ in table}
    raw, target = Counter(), Counter()
    for d, g in held_grams.items():
        raw.update(g)
        target.update(g if half.get(d) == 0 else ())
    scale = sum(target.values()) / sum(raw.values())
    weight = {}
    for d, g in held_grams.items():
        ratios = [np.log(target[x] + 10) - np.log(raw[x] * scale + 10) for x in g]
        weight[d] = sum(ratios) / max(1, len(g)) * min(len(g), effective)
    cut = np.quantile([weight[d] for d in labelled if half[d] == 1], 1 - keep_good)
    k = sum(w >= cut - 1e-9 for w in weight.values())
    noise = {d: -np.log(-np.log((xxhash.xxh64_intdigest(str(d), seed) + 0.5) / 2.0**64)) for d in weight}
    return weight, set(sorted(weight, key=lambda d: -(weight[d] + noise[d]))[:k])


def test_quality_equals_a_plain_version(spark):
    table = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} & {r.doc_id for r in table}
    weight, taken = plain_quality(table, good)
    df = spark.createDataFrame(table, "doc_id long, text string")
    labels = labels.filter(f"quality = 0 or doc_id in ({', '.join(map(str, good))})")
    fitted = fit_selection(df, labels)
    scores = {r.id: r.log_weight for r in fitted.scores.collect()}
    assert scores.keys() == weight.keys() and all(abs(scores[d] - weight[d]) < 1e-6 for d in weight)
    assert {r.doc_id for r in select_quality(df, labels).collect()} == taken and 0 < len(taken) < len(table)


# lines


def plain_lines(table, ratio):
    """(id, text) of rows (id, text, source) less their source's lines, by counting pages with sets."""
    strip = " \t\n\x0b\x0c\r"
    pages, having = Counter(s for _, _, s in table), Counter()
    for _, t, s in table:
        having.update({(s, x.strip(strip)) for x in (t or "").split("\n")})

    def goes(line, s):
        return line.strip(strip) != "" and having[s, line.strip(strip)] - 1 > (pages[s] - 1) * ratio

    return Counter((d, None if t is None else "\n".join(x for x in t.split("\n") if not goes(x, s))) for d, t, s in table)


def test_document_lines(spark, rows, none):
    table = [(k, f"head\nbody {k}\n\n tail \nrare {k % 5}", "en", "a" if k < 60 else "b", 0) for k in range(100)]
    df = spark.createDataFrame(table, SCHEMA)
    got = {r.doc_id: r.text for r in dedup_document_lines(df, ratio=0.5).collect()}
    assert got == {k: f"body {k}\n\nrare {k % 5}" for k in range(100)}
    from folia.llm.line_dedup import drop_site_lines
    from pyspark.sql import functions as F

    salted = drop_site_lines(df, F.col("source"), F.split("text", "\n"), ratio=0.5, broadcast_bytes=0).select("row.doc_id", F.array_join("kept_lines", "\n").alias("text")).collect()
    assert {r.doc_id: r.text for r in salted} == got
    for ratio in (0.05, 0.1, 0.4):
        out = dedup_document_lines(rows, ratio=ratio)
        assert out.columns == rows.columns and Counter((r.doc_id, r.text) for r in out.collect()) == plain_lines([(d, t, s) for d, t, _, s, _ in awkward()], ratio)
        mixed_lines = [(k, "\n".join(random.Random(k).choices(("a", " b", "c ", "d\t", "e", "", f"own {k}"), k=4)), f"s{k % 3}") for k in range(60)]
        got = dedup_document_lines(spark.createDataFrame(mixed_lines, "doc_id long, text string, source string"), ratio=ratio).collect()
        assert Counter((r.doc_id, r.text) for r in got) == plain_lines(mixed_lines, ratio)
    assert dedup_document_lines(none).count() == 0


def test_document_lines_of_a_twelfth_of_a_source(spark):
    df = spark.createDataFrame([(k, ("shared line\n" if k % 25 < 2 else "") + ("seldom\n" if k % 25 == 3 else "") + f"body {k}") for k in range(200)], "doc_id long, text string").selectExpr("*", "'s' source")
    got = {r.doc_id: r.text for r in dedup_document_lines(df).collect()}
    assert got == {k: ("seldom\n" if k % 25 == 3 else "") + f"body {k}" for k in range(200)}


def test_page_lines(spark):
    page = lambda k: f"<html><head><script>x</p></script></head><body><nav>Home &amp; more</nav><p>Text  {k}<br>b</p><footer>&copy; site</footer></body></html>"
    table = [(k, f"http://User@A.b:80/{k}", page(k)) for k in range(20)] + [(20, None, None), (21, "x", "plain")]
    got = {r.page_id: (r.host, r.text, r.n_lines, r.n_dropped) for r in dedup_page_lines(spark.createDataFrame(table, "page_id long, url string, html string"), ratio=0.3).collect()}
    assert got[3] == ("a.b", "Text 3", 4, 3) and got[20] == ("", "", 0, 0) and got[21] == ("", "plain", 1, 0)


def test_awkward_pages(spark):
    schema = "page_id long, url string, html string, host string, lines string, line string, row string, drop string"
    odd = [(None, None, None), (1, "http://h/", ""), (1, "http://h/", " <p> \t</p>"), (2, "http://h/a", "<p>x"), (2, "http://h/a", "<p>x"), (3, "https://H/b", "<p>x<p>own"), (4, "//h/", "<p>y"), (5, "http://h/c", "x &amp;amp;<br>" + "long " * 50_000)]
    table = spark.createDataFrame([(*r, "h", "l", "i", "r", "d") for r in odd], schema)
    got = Counter((r.page_id, r.host, r.text[:12], r.n_lines, r.n_dropped) for r in dedup_page_lines(table, ratio=0.3).collect())
    # of host h 6 pages, of which 3 have x: of the 5 beside one of them 2 do
    assert got == Counter([(None, "", "", 0, 0), (1, "h", "", 0, 0), (1, "h", "", 0, 0), (2, "h", "", 1, 1), (2, "h", "", 1, 1), (3, "h", "own", 2, 1), (4, "", "y", 1, 0), (5, "h", "x &amp;\nlong", 2, 0)])
    assert dedup_page_lines(table.limit(0)).count() == 0


# packing


def test_best_fit():
    bins, used = best_fit([7, 6, 5, 3, 2, 2], (4, 8, 16), 8)
    assert bins == [[0], [1, 4], [2, 3], [5]] and used == [7, 8, 8, 2]
    # one of 16 holds all but one of 8, for less than three of 8 and one of 4
    assert best_fit([12, 4, 3, 3, 2], (8, 16))[1] == [16, 8]
    _, used, caps = pack([7, 6, 5, 3, 2, 2], (4, 8, 16))
    assert all(c >= u and not any(u <= x < c for x in (4, 8, 16)) for u, c in zip(used, caps, strict=True))


def test_packing(spark, docs, rows, none):
    lengths = (64, 128, 256)
    got = pack_documents(docs, lengths=lengths, group_rows=50).collect()
    check_packing(got, corpus(), lengths)
    sizes = sorted((len(WORD.findall(t)) for _, t, *_ in corpus()), reverse=True)
    cost = sum(sequence_cost(c) for c in {r.bin_id: r.capacity for r in pack_documents(docs, lengths=lengths).collect()}.values())
    pieces = sorted((min(256, n - a) for n in sizes for a in range(0, n, 256)), reverse=True)
    for first in lengths:
        _, used = best_fit(pieces, lengths, first)
        assert cost <= sum(sequence_cost(min(c for c in lengths if c >= u)) for u in used)
    odd = pack_documents(rows).collect()
    check_packing(odd, awkward(), LENGTHS)
    assert pack_documents(none).count() == 0
    same = spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 300, SCHEMA)
    check_packing(pack_documents(same, group_rows=20, lengths=(4, 8)).collect(), [(1, "a b c", "en", "s", 0)] * 300, (4, 8))


def plain_packing(sizes, lengths, first):
    """Bins as lists of sizes, by searching all bins and all that is left for every item; first: the length to open, or None for the cheapest."""
    room, bins = [], []
    for i, size in enumerate(sizes):
        fits = [b for b in range(len(bins)) if room[b] >= size]
        if fits:
            b = max((b for b in fits if room[b] == min(room[x] for x in fits)), key=lambda x: (touched[x], x))
        else:
            if first is None:
                offers = []
                for c in lengths:
                    if c >= size:
                        free, rest = c - size, sorted(sizes[i + 1 :], reverse=True)
                        for x in rest:
                            if x <= free:
                                free -= x
                        held = c - free
                        offers.append((sequence_cost(min(x for x in lengths if x >= held)) / held, c))
                opened = min(offers)[1]
            else:
                opened = max(first, min(c for c in lengths if c >= size))
            b = len(bins)
            bins.append([])
            room.append(opened)
            if b == 0:
                touched = {}
        bins[b].append(size)
        room[b] -= size
        touched[b] = i
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_a_plain_search(seed):
    rng = random.Random(seed)
    lengths = (8, 16, 32, 64)
    sizes = sorted((min(64, int(rng.paretovariate(0.7))) for _ in range(150)), reverse=True)
    plain = {first: plain_packing(sizes, lengths, first) for first in (None, *lengths)}
    for first, bins in plain.items():
        got, used = best_fit(sizes, lengths, first)
        assert sorted(sorted(sizes[i] for i in b) for b in got) == sorted(map(sorted, bins)) and used == [sum(sizes[i] for i in b) for b in got]
    cost = {f: sum(sequence_cost(min(c for c in lengths if c >= sum(b))) for b in bins) for f, bins in plain.items()}
    _, used, caps = pack(sizes, lengths)
    assert sum(map(sequence_cost, caps)) == min(cost.values()) and caps == [min(c for c in lengths if c >= u) for u in used]


def test_packing_does_not_depend_on_partitions(spark, docs):
    def bins(df):
        return Counter((r.doc_id, r.piece, r.capacity, r.used, r.length) for r in pack_documents(df, group_rows=30, lengths=(64, 128, 256)).collect())

    assert bins(docs) == bins(docs.repartition(7)) == bins(docs.orderBy("text"))


def check_packing(got, table, lengths):
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == [sum(x.length for x in b[:k]) for k in range(len(b))]
        assert b[0].used == sum(r.length for r in b) and b[0].capacity == min(c for c in lengths if c >= b[0].used)
    want = Counter((d, a, min(max(lengths), n - a)) for d, t, *_ in table for n in [len(WORD.findall(t or ""))] for a in range(0, n, max(lengths)))
    assert Counter((r.doc_id, r.start, r.length) for r in got) == want


# exact duplicates


@pytest.mark.parametrize("heavy", [1, 4096])
def test_exact(docs, rows, none, heavy):
    for df, table in ((docs, corpus()), (rows, awkward())):
        got = exact_dedup(df, heavy=heavy).collect()
        groups = defaultdict(list)
        for d, t, *_ in table:
            groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), d is None, d))
        assert len(got) == len(table)
        for r in got:
            g = groups[r.text_sha256]
            assert r.group_size == len(g) and r.keep_id == min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    assert exact_dedup(none).count() == 0


# media


def test_media(spark, docs, rows, none, tmp_path):
    assert from_wav(to_wav(b"\x00\xff" * 32)) == b"\x00\xff" * 32 and [len(padded(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]
    with pytest.raises(ValueError):
        from_wav(to_wav(b"x" * 64)[:-1])
    for df, table in ((docs, corpus()), (rows, awkward())):
        got = media_features(df).collect()
        want = Counter()
        for d, t, *_ in table:
            data = (t or "").encode()
            p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            m = to_wav(p)
            want[(d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(p))] += 1
        assert Counter(tuple(r) for r in got) == want
    assert media_features(none).count() == 0
    path = f"file://{tmp_path}/m"
    write_media(docs.coalesce(1), path)
    split = spark.read.format("archive").option("splitBytes", 2000).load(path)
    assert split.count() == len(corpus()) and split.rdd.getNumPartitions() > 3


def test_archives_are_added_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "archives")
    table = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").coalesce(1)
    write_media(table(1, 2), path)
    (tmp_path / "archives" / "_of-another-job").write_bytes(b"x")
    write_media(table(3), path)
    read = lambda: sorted(r.doc_id for r in read_features(spark, path).collect())
    assert read() == [1, 2, 3]
    assert (tmp_path / "archives" / "_of-another-job").exists() and len(list((tmp_path / "archives").iterdir())) == 3
    rows = spark.createDataFrame([("4.6.wav", to_wav(padded(b"text 4")))], "member string, media binary")
    rows.write.format("archive").mode("overwrite").save(path)
    assert read() == [4]


def test_damaged_archives_are_reported(spark, tmp_path):
    write_media(spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string").coalesce(1), str(tmp_path))
    whole = next(tmp_path.glob("*.zip"))
    (tmp_path / "cut.zip").write_bytes(whole.read_bytes()[:200])
    spark.dataSource.register(ArchiveSource)
    load = lambda **o: spark.read.format("archive").options(splitBytes=100, retries=2, **o).load(str(tmp_path)).collect()
    rows = load(onError="report")
    assert sum(r.media is not None for r in rows) == 9
    (bad,) = [r for r in rows if r.media is None]
    assert bad.archive.endswith("cut.zip") and bad.member is None and "BadZipFile" in bad.error
    with pytest.raises(Exception, match="BadZipFile"):
        load()


def test_members_are_retried(spark, docs, tmp_path):
    path = f"file://{tmp_path}/m"
    write_media(docs.coalesce(1), path)
    name = next(p for p in (tmp_path / "m").iterdir() if p.suffix == ".zip")
    whole = bytearray(name.read_bytes())
    whole[200] ^= 255  # inside the first member
    name.write_bytes(bytes(whole))
    reported = spark.read.format("archive").option("onError", "report").option("retries", 2).load(path).collect()
    assert len(reported) == len(corpus()) and sum(r.error is not None for r in reported) == 1
    reader = ArchiveReader({"path": path, "retries": "2"})
    with pytest.raises((OSError, zlib.error)):
        list(reader.read(ByteRange(f"{path}/{name.name}", 0, 100)))
    assert len(reader.partitions()) == 1


# repeated strings


def plain_suffix(table, length):
    seen, out = set(), []
    for d, t in table:
        x = (t or "").encode()
        covered = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if (w := x[s : s + length]) in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(x, covered, strict=True) if not c)
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((d, len(x), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "hot"), [(100, 4096), (100, 1), (40, 2), (200 - 80, 4096)])
def test_suffix(docs, rows, none, length, hot):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in repeated_strings(docs, length=length, hot=hot).select(*cols).collect()) == plain_suffix([r[:2] for r in corpus()], length)
    ordered = sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    got = Counter(tuple(r) for r in repeated_strings(rows, length=length, hot=hot).select(*cols).collect())
    assert got == plain_suffix([r[:2] for r in ordered], length)
    assert repeated_strings(none).count() == 0


def test_suffix_in_long_and_periodic_texts(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choice("abcd ") for _ in range(30_000))
    table = [(1, base, "", "", 0), (2, "x" + base[5000:9000] + base[4000:8000], "", "", 0), (3, "ab" * 400, "", "", 0), (4, "ba" * 300, "", "", 0), (5, "z" * 500, "", "", 0)]
    got = Counter(tuple(r) for r in repeated_strings(spark.createDataFrame(table, SCHEMA)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == plain_suffix([r[:2] for r in table], 100)


def test_nothing_goes_but_by_the_merge(docs, monkeypatch):
    from folia.llm import suffix_dedup as s

    monkeypatch.setattr(s, "merged_repeats", lambda contexts, texts, length: np.zeros(0, s.SPAN))
    assert repeated_strings(docs).agg({"n_removed": "sum"}).first()[0] == 0


def test_long_texts_are_cut_into_pieces(monkeypatch):
    import pyarrow as pa

    from folia.llm import suffix_dedup as s

    text = "".join(random.Random(4).choice("abc") for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"doc": [7], "text": [text]})
    whole = np.concatenate(list(s.anchored_places(batch, 100, 32)))
    monkeypatch.setattr(s, "PIECE", 1000)
    cut = np.concatenate(list(s.anchored_places(batch, 100, 32)))
    covers = lambda p: sorted({x for a, z in zip(p["at"].tolist(), p["to"].tolist(), strict=True) for x in range(a, z - 99)})
    assert covers(whole) == covers(cut) == list(range(4901))


@pytest.mark.parametrize("seed", range(4))
def test_bwt_merge(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"\1\2") for _ in range(rng.randint(5, 40))) for _ in range(60)]
    shards, names = [], []
    for s in range(3):
        own = sorted(strings[s::3])
        starts = np.cumsum([0, *[len(w) + 1 for w in own]])[:-1]
        shards.append((np.frombuffer(b"".join(w + b"\0" for w in own), np.uint8), starts))
        names.append([(w, o) for w in own for o in range(len(w) + 1)])
    shard, at, block = bwt.merge_shards(shards, 12)
    cyclic = [((w + b"\0")[o:] + (w + b"\0") * 9)[:12] for w, o in (names[s][a] for s, a in zip(shard, at, strict=True))]
    assert cyclic == sorted(cyclic) and len(cyclic) == sum(len(w) + 1 for w in strings)
    assert [a == b for a, b in zip(cyclic, cyclic[1:], strict=False)] == (block[1:] == block[:-1]).tolist()


# near duplicates


def plain_print(text, words):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(table, words, radius):
    prints = [plain_print(t, words) for _, t, *_ in table]
    group = list(range(len(table)))
    for _ in table:
        for i in range(len(table)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((table[k][0] for k in range(len(table)) if group[k] == g and table[k][0] is not None), default=None) for g in set(group)}
    return Counter((table[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(table)))


def test_simhash(docs, rows, none):
    near = corpus(n=60)
    assert Counter(tuple(r) for r in simhash_groups(docs.filter("doc_id < 60"), words=3).collect()) == plain_groups([r for r in corpus() if r[0] < 60], 3, 3) and near
    assert Counter(tuple(r) for r in simhash_groups(rows, words=5).collect()) == plain_groups(awkward(), 5, 3)
    assert simhash_groups(none).count() == 0
    kept = one_of_each_group(rows).collect()
    prints = {plain_print(t, 5) for _, t, *_ in awkward()}
    assert 0 < len(kept) <= len(prints) and one_of_each_group(rows).columns == rows.columns
    texts = {t for _, t, *_ in corpus()}
    assert len(one_of_each_group(docs).collect()) <= len(texts) and one_of_each_group(none).count() == 0


def test_heavy_groups_are_broadcast(docs, monkeypatch):
    from folia.llm import common

    want = sorted(map(tuple, simhash_groups(docs, words=3).collect()))
    near = sorted(r.doc_id for r in one_of_each_group(docs).collect())
    monkeypatch.setattr(common, "HEAVY_ROWS", 1)
    assert sorted(map(tuple, simhash_groups(docs, words=3).collect())) == want
    assert sorted(r.doc_id for r in one_of_each_group(docs).collect()) == near


def test_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    assert (np.abs(embed(a).astype(int) - embed(b).astype(int)).sum(1) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("dense", [2, 2048])
def test_links(spark, monkeypatch, dense):
    from folia.llm import simhash

    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(30)]
    points = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centers for _ in range(20)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "print long"), 3)
    got = {r.node: r.root for r in components(links).collect()}
    group = {p: p for p in points}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = root(p), root(q)
                group[max(a, b)] = min(a, b)
    want, have = defaultdict(set), defaultdict(set)
    for p, s in zip(points, signed, strict=True):
        want[root(p)].add(p)
        have[got.get(s, s)].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 140)) and got[201] == 200
    assert fingerprint(b"", 3, 42) == 0


# sentences


def plain_sentences(table, sentences, words):
    seen, out = set(), []
    for d, t in table:
        data = (t or "").encode()
        bounds = sentence_bounds(data)
        parts = [data[a:b].split() for a, b in zip(bounds, bounds[1:], strict=False)]
        real, gone = [k for k, p in enumerate(parts) if p], set()
        for i in range(len(real)):
            j = i
            while j < len(real) and (j - i < sentences or sum(len(parts[real[k]]) for k in range(i, j)) < words):
                j += 1
            if j - i < sentences or sum(len(parts[real[k]]) for k in range(i, j)) < words:
                continue
            run = tuple(tuple(parts[real[k]]) for k in range(i, j))
            if run in seen:
                gone |= set(range(real[i], real[j - 1] + 1))
            seen.add(run)
        text = b"".join(data[bounds[k] : bounds[k + 1]] for k in range(len(parts)) if k not in gone).decode()
        out.append((d, None if t is None else text, len(parts) if data else 0, len(gone)))
    return Counter(out)


def test_sentences(docs, rows, none):
    got = Counter(tuple(r) for r in sentence_span_dedup(docs).collect())
    assert got == plain_sentences([r[:2] for r in corpus()], 3, 15) and any(k[3] for k in got)
    ordered = sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert Counter(tuple(r) for r in sentence_span_dedup(rows).collect()) == plain_sentences([r[:2] for r in ordered], 3, 15)
    assert sentence_span_dedup(none).count() == 0


def test_short_repeats_of_sentences(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    two, one = f"{words('a', 30)}. {words('b', 26)}. ", f"{words('c', 55)}. "
    tail = f"{words('d', 9)}. {words('e', 9)}. No more. "
    wide = "".join(chr(0x4E00 + k) for k in range(20)) + "。" + "".join(chr(0x5E00 + k) for k in range(10)) + "！"
    texts = [two + "First end.", "Other start. " + two + "Other end.", one + "x.", "y. " + one, words("f", 30), words("f", 30), "Only few.", "Only few.", tail + "Some other.", tail + "Yet more of it.", "天地。" + wide, "人。" + wide + "山。"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_span_dedup(rows, sentences=2, long=25).collect()}
    left = {1: "Other start. Other end.", 3: "y. ", 5: "", 7: "", 9: "Yet more of it.", 11: "人。山。"}
    assert got == dict(enumerate(texts)) | left


def test_ends_of_sentences():
    def ends(t):
        bounds = sentence_bounds(t.encode())
        return [t.encode()[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]

    assert ends("One. Two, 3.5 x\nEnd") == ["One. ", "Two, 3.5 x\n", "End"]
    long = " ".join(f"w{k}" for k in range(20))
    assert ends(f"{long}, {long}. {long}, x.") == [f"{long}, ", f"{long}. ", f"{long}, x."]
    assert ends("天" * 20 + "，" + "地" * 10 + "。人，天。") == ["天" * 20 + "，", "地" * 10 + "。", "人，天。"]
    assert ends("") == [""] and ends("\n\n") == ["\n\n"]
    assert ends("天地。人！ x؟ y…\u00a0é. z") == ["天地。", "人！ ", "x؟ ", "y…\u00a0", "é. ", "z"]


def test_op9_takes_short_repeats(spark, tmp_path):
    from folia.llm.queries import op9_sentence_dedup

    text = " ".join(f"w{k}" for k in range(55)) + "."
    spark.createDataFrame([(1, text), (2, "Before. " + text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in op9_sentence_dedup(spark, str(tmp_path)).collect()} == {1: text, 2: "Before. "}


# mixing


def test_mixing(spark, docs, rows, none):
    got = mix_sources(docs).collect()
    size = {d: len(WORD.findall(t)) for d, t, *_ in corpus()}
    totals = defaultdict(int)
    for d, _, _, s, _ in corpus():
        totals[s] += size[d]
    target, left, open_ = {}, 1.5 * sum(totals.values()), sorted(totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(open_)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * totals[s]]
        for s in over or open_:
            target[s] = 2 * totals[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1.001 for s in totals)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs).collect()))
    mixed = mixed_rows(docs).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(taken.values())
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(words[r.doc_id] == r.taken for r in got)
    odd = mix_sources(rows).collect()
    assert len(odd) == len(awkward()) and {r.source for r in odd} == {"s0", "s1", None}
    assert mixed_rows(rows).columns == rows.columns and mix_sources(none).count() == mixed_rows(none).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, "", "a", 0), (2, " ", "", "b", 0)], SCHEMA)).collect()] == [0, 0]
