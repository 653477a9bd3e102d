import hashlib
from collections import Counter, defaultdict
from math import floor

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from test_operators import SCHEMA, WORD, awkward, plain_lines, plain_packing, plain_quality
from test_similar import plain_groups

from folia.llm.common import materialize
from folia.llm.packing import LENGTHS, sequence_cost

SF = "/root/testdata/sf0.001"


def plain_mix(rows):
    """(id, text) of all copies in the mix of rows (id, text, source), by clamping and resharing in rounds and a walk in seeded order."""
    words = [WORD.findall(t or "") for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), w in zip(rows, words, strict=True):
        total[s] += len(w)
    open_ = sorted(total, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(open_)}, 1.5 * sum(total.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        target |= {s: 2 * total[s] if over else level * weight[s] for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if over and s not in over]
    out, rest = Counter(), {s: floor(t) - floor(floor(t) / total[s]) * total[s] if total[s] else 0 for s, t in target.items()}
    for k in sorted(range(len(rows)), key=lambda k: hashlib.md5(f"42:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()):
        d, text, s = rows[k]
        if words[k]:
            part = min(rest[s], len(words[k]))
            rest[s] -= part
            out[d, text] += floor(floor(target[s]) / total[s]) + (part == len(words[k]))
            if 0 < part < len(words[k]):
                out[d, " ".join(words[k][:part])] += 1
    return +out


def plain_bins(texts):
    """Sorted sizes in each bin, of the cheapest of the packings that open one length or the cheapest."""
    sizes = sorted((min(LENGTHS[-1], n - a) for n in (len(WORD.findall(t or "")) for t in texts) for a in range(0, n, LENGTHS[-1])), reverse=True)
    cost = lambda bins: sum(sequence_cost(min(c for c in LENGTHS if c >= sum(b))) for b in bins)
    return Counter(tuple(sorted(b)) for b in min((plain_packing(sizes, LENGTHS, f) for f in (None, *sorted(LENGTHS, key=lambda c: sequence_cost(c) / c))), key=cost))


def check_stages(spark, docs, sf_dir, good):
    """Each stage against its plain version, on what its predecessor kept."""
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = materialize(stage(spark, docs, sf_dir), name)
        if name == "packing":
            bins = defaultdict(list)
            for r in docs.collect():
                bins[r.bin_id].append(r.length)
            assert Counter(tuple(sorted(b)) for b in bins.values()) == plain_bins([t for _, t, _ in before])
            return
        assert docs.columns == columns
        got = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        if name == "quality" and good:
            taken = plain_quality(before, good & {d for d, *_ in before})[1]
            assert got == Counter((d, t) for d, t, _ in before if d in taken) and 0 < len(got) < len(before)
        elif name == "quality":  # nothing to learn from: all rows stay
            assert got == Counter((d, t) for d, t, _ in before)
        elif name == "site_lines":
            assert got == plain_lines(before, 0.05)
        elif name == "near_duplicates":
            rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
            group = plain_groups([(k, t) for k, (_, t, _) in enumerate(rows)])
            # of rows with one id either may stay
            kept = Counter(group.values())
            assert sum(got.values()) == len(kept)
            if len({d for d, *_ in rows}) == len(rows):
                assert got == Counter((rows[k][0], rows[k][1]) for k in kept)
        else:
            assert got == plain_mix(before)
            assert docs.filter("n_chars <> length(text)").count() == 0


def test_stages(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, {r.doc_id for r in labels.filter("quality = 1").collect()})


def test_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    check_stages(spark, spark.createDataFrame(awkward(), SCHEMA), str(tmp_path), set())
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
