import random
from collections import defaultdict

import numpy as np

from folia.llm import similar
from folia.llm.similar import apart, embed_set, most_apart, one_of_each_group, similar_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def groups(links, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def test_near_copies_are_one_group(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows, base = [], {}
    for k in range(40):
        text = [rng.choice(words) for _ in range(300)]
        base[k] = text
        rows.append((3 * k, " ".join(text), "en", "s", 0))
        near = list(text)
        for at in rng.sample(range(0, 300, 30), 4):
            near[at] = "changed"
        rows.append((3 * k + 1, " ".join(near), "en", "s", 0))
        rows.append((3 * k + 2, " ".join(rng.choice(words) for _ in range(rng.randint(3, 300))), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    found = defaultdict(list)
    for r in similar_groups(df).collect():
        found[r.component_id].append(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted([[3 * k, 3 * k + 1] for k in range(40)] + [[3 * k + 2] for k in range(40)])
    assert {r.doc_id for r in one_of_each_group(df).collect()} == {d for k in range(40) for d in (3 * k, 3 * k + 2)}


def plain_groups(rows, similarity=0.8, words=5):
    """Least id of each row's group, by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and sets[i] and sets[j]]
    return {rows[k][0]: rows[g][0] for k, g in enumerate(groups(links, len(rows)))}


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.random()}"
    return out


def test_less_than_the_similarity_is_no_link(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):  # 2 to 11 changed words of 200, on both sides of 0.8
        text = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited(rng, text, 2 + k // 6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert 10 < sum(want[2 * k + 1] == 2 * k for k in range(60)) < 50
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == want


def test_every_pair_at_the_similarity_is_a_link(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):  # most at 0.77 to 0.85: of those at 0.8 cells and bits missed some
        text = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited(rng, text, rng.randint(4, 5))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == plain_groups(rows)


def test_large_groups_go_round_by_round(spark):
    rng = random.Random(7)
    text = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, text, rng.randint(0, 5)))) for k in range(300)] + [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == want and len(set(want.values())) > 3


def test_embedding_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.0, 0.1, 0.2, 0.5, 1.0):
            b = np.unique(np.where(rng.random(len(a)) < share, rng.integers(0, 2**64, len(a), dtype=np.uint64), a))
            both = len(np.intersect1d(a, b))
            assert apart(embed_set(a), embed_set(b)) <= len(a) + len(b) - 2 * both
            if both >= 0.8 * (len(a) + len(b) - both):
                assert apart(embed_set(a), embed_set(b)) <= most_apart(len(a), len(b), 0.8)
    # segments that are full say less, never more
    assert apart(embed_set(np.arange(400, dtype=np.uint64)), embed_set(np.arange(300, dtype=np.uint64))) == 0


def test_similar_sets_meet_in_the_grid():
    """Two sets at the similarity share a cell, at every size and whatever else is frequent; others mostly share none."""
    rng = np.random.default_rng(6)
    common = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    counts = rng.integers(2, 500, len(common))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for trial in range(20):
            new = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            a = np.unique(np.r_[rng.choice(common, min(n // 2, 1500), replace=False), rng.choice(new, n - min(n // 2, 1500), replace=False)])
            # as many go as may, and as many come: all of one kind, or some of both
            go = rng.integers(0, int(n * 0.2 + 1e-9) + 1) if trial % 2 else int(n * 0.2 + 1e-9)
            stay = rng.permutation(a)[go:]
            come = max(0, int(len(stay) / 0.8 + 1e-9) - n)
            b = np.unique(np.r_[stay, np.setdiff1d(new, a)[:come]])
            both = len(np.intersect1d(a, b))
            assert both >= 0.8 * (len(a) + len(b) - both) - 1e-9
            for order in ((common, counts), none):
                assert len(np.intersect1d(similar.grid_cells(a, *order, 0.8), similar.grid_cells(b, *order, 0.8)))
    a, b = np.unique(rng.integers(0, 2**64, (2, 400), dtype=np.uint64), axis=1)
    assert not len(np.intersect1d(similar.grid_cells(np.sort(a), *none, 0.8), similar.grid_cells(np.sort(b), *none, 0.8)))


def test_blocks_find_what_heads_leave(spark, monkeypatch):
    """Texts that share passages without being near copies: no pair of blocks may be left out."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for k in range(70):  # pairs of near copies, all with one passage in the middle
        own = [f"w{rng.randrange(5000)}" for _ in range(60)]
        text = own[:30] + shared + own[30:]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited(rng, text, rng.randint(0, 3))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == want and 70 <= len(set(want.values())) < 140


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, " \n "), (3, "a b c"), (3, "a b c"), (None, "a b c d e f"), (4, "A B C")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, id string, row long")
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.text or "").strip().lower() for r in kept.collect()) == ["", "a b c", "a b c d e f"]
    assert one_of_each_group(df.limit(0)).count() == 0


def test_shingle_hashes_tell_shingles_apart():
    """As many hashes as there are different shingles, the same wherever a shingle stands, for long words and windows as well."""
    rng = random.Random(8)
    seen = {}
    for n in [0, 1, 4, 5, 6] * 40 + [60_000]:
        text = b"".join(rng.choice([b" ", b"\t", b" \r\n ", b"\x0b\x0c"]) + bytes(rng.choices(b"aBc\xc3\xa9\x00", k=700 if rng.random() < 0.002 else rng.randint(1, 4))) for _ in range(n))
        w = text.lower().split()
        plain = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        found = similar.shingle_set(text, 5, 42)
        assert len(plain) == len(found) and np.all(found[1:] > found[:-1])
        alone = {int(similar.shingle_set(s, 5, 42)[0]): s for s in list(plain)[:5000]}
        assert alone.keys() <= set(found.tolist()) and all(seen.setdefault(h, s) == s for h, s in alone.items())


def test_cells_are_few():
    """Up to a quarter as many as a set has shingles, and as many again only for a set that larger ones of the next band may be similar to."""
    rng = np.random.default_rng(9)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n, most in ((300, 0.25), (700, 0.25), (900, 0.5), (3000, 0.25), (3500, 0.5)):
        assert len(similar.grid_cells(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), *none, 0.8)) <= most * n + 2


def test_cells_of_the_same_texts_are_sent_once(spark):
    """Texts that share a passage share many cells; callers alone share none."""
    rng = np.random.default_rng(10)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def tokens(n, shared):
        passage = rng.integers(0, 2**64, shared, dtype=np.uint64)
        sets = [np.unique(np.r_[passage, rng.integers(0, 2**64, n - shared, dtype=np.uint64)]) for _ in range(6)]
        rows = [(k, len(s), bytearray(similar.grid_cells(s, *none, 0.8).tobytes())) for k, s in enumerate(sets)]
        found = similar.shared_tokens(spark.createDataFrame(rows, "id long, n long, cells binary")).collect()
        assert all(r.m == len(r.members) // similar.MEMBER.itemsize > 1 for r in found)
        return [bytes(r.members) for r in found]

    for n in (400, 950):
        found = tokens(n, n - 10)
        assert found and len(found) == len(set(found))
    # cells of the next band, where all six call
    assert len(tokens(950, 950)) == 1
