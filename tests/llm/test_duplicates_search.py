"""Fingerprints, links, substring removal and search against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from loomtrace.llm import graph, rlz, simhash, topk, words


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBé \t\n  x", max_size=40))
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 4)) == plain_fingerprint(text)


def plain_components(prints, limit):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def noisy_prints(n, seed, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = {}
    for i in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out[i] = x
    return out


@pytest.mark.parametrize("radius,segments,flips", [(4, 3, 4), (0, 1, 1), (3, 4, 3), (8, 3, 7), (11, 4, 8), (5, 2, 6)])
def test_links_connect_as_all_pairs_do(spark, radius, segments, flips):
    if (radius - segments + 1) / segments > 2:
        pytest.skip("needs more segments")
    prints = noisy_prints(300, radius, flips)
    distinct = {}
    for i, x in prints.items():
        distinct[x] = min(i, distinct.get(x, i))
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for x, i in distinct.items()], "id long, f0 long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(nodes, radius, segments, radius, 1).collect()]
    want = plain_components({i: x for x, i in distinct.items()}, radius)
    parent = {i: i for i in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (prints[a] ^ prints[b]).bit_count() <= radius
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {i: find(i) for i in want} == want


def test_a_dense_group_gives_a_forest():
    rng = random.Random(5)
    f = np.array([[sum(1 << b for b in rng.sample(range(64), 2))] for _ in range(900)] + [[2**64 - 1]], np.uint64)
    links = simhash.forest(f, 4)
    assert len(links) == 899
    assert len(simhash.forest(f, 0)) == len(f) - len(np.unique(f))


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    df = spark.createDataFrame([*path, *star, (100, 101), (200, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(df.limit(0), "a", "b").count() == 0


def near_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(25)]
    out = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w)))
    return [*out, (500, None), (501, ""), (502, "  \n"), (503, "one two"), (503, "one two"), (504, "One TWO"), (505, "w " * 100_000)]


def test_near_components(spark):
    data = near_texts()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, f0 string, id int")
    got = simhash.near_components(df).collect()
    want = plain_components({i: plain_fingerprint(t) for i, t in data}, 4)
    assert len(got) == len(data) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert want[502] == want[501] == 500 and want[504] == 503
    kept = simhash.keep_one(df).collect()
    assert {r["doc_id"] for r in kept} == set(want.values()) and kept[0]["f0"] == "clash"
    assert simhash.near_components(df.limit(0)).count() == 0


def test_null_ids_are_kept(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u")], "doc_id long, text string")
    got = sorted((r["component_id"] or -1 for r in simhash.near_components(df).collect()))
    assert got == [-1, 7, 7]
    assert simhash.keep_one(df).count() == 3


def plain_removal(rows, window=20):
    first, out = {}, []
    keyed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in keyed:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i is None, i or 0))
    for i, t in rows:
        w, seen, gone = (t or "").encode().split(), set(), set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen or first[k] < (i is None, i or 0):
                gone |= set(range(p, p + window))
            seen.add(k)
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def substring_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "The", "é x"]
    passages = [rng.choices(words, k=n) for n in (19, 20, 21, 45, 90)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 5)
            parts += p[cut : len(p) - rng.randint(0, 3)] if rng.random() < 0.7 else rng.choices(words, k=rng.randint(1, 40))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (102, None), (103, ""), (104, "x " * 400), (105, "x " * 30), (7, rows[7][1])]


@pytest.mark.parametrize("how", [{}, {"shingle": 5, "limit": 96, "words": 4, "repeats": False, "least": 0.8}])
def test_repeated_ids_lose_no_text(spark, how):
    """Each text of an id is a document; of equal rows one stays."""
    a, b, c, t = (" ".join(f"{x}{i}" for i in range(60)) for x in "abct")
    rows = [(5, a, "x"), (9, a, "x"), (9, b, "x"), (9, c, "x"), (30, t, "y"), (30, t, "y"), (30, t, "a"), (31, t.upper(), "y"), (None, a, "n"), (None, a, "n"), (40, None, "e"), (40, "", "e"), (41, "", "e")]
    for parts in (1, 4):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts), **how).collect()
        found = sorted(((r["doc_id"], r["text"], r["source"]) for r in kept), key=repr)
        empty = [r for r in found if r[0] in (40, 41)]
        assert len(empty) == 1 and empty[0][0] == 40
        assert [r for r in found if r[0] not in (40, 41)] == sorted([(5, a, "x"), (9, b, "x"), (9, c, "x"), (30, t, "a"), (None, a, "n"), (None, a, "n")], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    rows = substring_rows(seed)
    df = spark.createDataFrame([(i, t, "clash", 3, True) for i, t in rows], "doc_id long, text string, d string, r int, first boolean")
    got = rlz.dedup_substrings(df).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got), key=str)
    assert mine == plain_removal(rows)
    for r in got:
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= rlz.WINDOW
            covered |= set(range(f["start"], f["start"] + f["length"]))
        assert len(covered) == r["n_removed"]
    assert rlz.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 20])
def test_hashes_of_runs(width):
    h = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    b = 0x9E3779B97F4A7C15
    want = np.array([sum(int(h[i + j]) * pow(b, width - 1 - j, 1 << 64) for j in range(width)) % (1 << 64) for i in range(50 - width + 1)], np.uint64)
    assert (words.runs(h, width, b) == words.remix(want)).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé\t\n  xy\x1f", max_size=25)), max_size=6))
def test_words_of_many_texts(texts):
    w, low = words.split(pa.array(texts, pa.string())), words.split(pa.array(texts, pa.string()), lower=True)
    plain = [(t or "").encode().split() for t in texts]
    assert np.diff(w.starts).tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert [[a == b for b in flat] for a in flat] == (w.hashes[:, None] == w.hashes).tolist()
    assert [[a.lower() == b.lower() for b in flat] for a in flat] == (low.hashes[:, None] == low.hashes).tolist()
    for i, p in enumerate(plain):
        assert w.text(i) == b" ".join(p)
        assert w.text(i, np.arange(len(p)) % 2 == 0) == b" ".join(p[::2])


@pytest.mark.parametrize("size", [1, 3000])
def test_factors_stand_whole_in_their_sources(spark, monkeypatch, size):
    """Blocks of a few texts or of one: every factor's words are its source's, and the removal is the same."""
    monkeypatch.setattr(rlz, "BLOCK_BYTES", size)
    rows = substring_rows(3)
    got = rlz.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got), key=str)
    assert mine == plain_removal(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    for r in got:
        for f in r["factors"]:
            a, n, b = f["start"], f["length"], f["source_start"]
            assert any(x[a : a + n] == y[b : b + n] for x in texts[r["doc_id"]] for y in texts[f["source"]])


def plain_topk(codes, queries, k):
    out = []
    for q, c in queries:
        best = sorted(((c ^ d).bit_count(), i) for i, d in codes if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "few"])
def test_topk_is_exact(spark, kind):
    rng = random.Random(4)
    n = 8 if kind == "few" else 300
    codes = {i: rng.getrandbits(64) if kind != "clustered" else [0, 2**64 - 1, 0xF0F0F0F0F0F0F0F0][i % 3] ^ (1 << rng.randrange(64) if i % 5 == 0 else 0) for i in range(n)}
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in codes.items()]
    df = spark.createDataFrame(signed, "id long, code long")
    got = topk.nearest(df, df.where("id % 20 = 0"), 10)
    mine = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got.collect())
    assert mine == plain_topk(list(codes.items()), [(i, c) for i, c in codes.items() if i % 20 == 0], 10)


def test_binarize_odd_vectors(spark):
    data = [(1, [1.0] * 64), (2, None), (3, []), (4, [None, 1.0]), (5, [1.0, -1.0] * 64), (1, [1.0] * 64), (None, [1.0])]
    got = {r["id"]: r["code"] for r in topk.binarize(spark.createDataFrame(data, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    assert got == {1: -1, 4: 2, 5: 0x5555555555555555}


def test_op10_and_op8_and_op5_over_files(spark, tmp_path):
    spark.createDataFrame([(i, [float((i * 7 + j * j) % 5 - 2) for j in range(64)]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame(near_texts(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(r["query_id"] for r in topk.op10_hamming_topk(spark, str(tmp_path)).collect()) == {0: 10, 20: 10, 40: 10}
    assert simhash.op8_simhash_mih(spark, str(tmp_path)).columns == ["doc_id", "fingerprint", "component_id"]
    assert rlz.op5_rlz_substrings(spark, str(tmp_path)).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = shingles(a or ""), shingles(b or "")
    return len(x & y) / len(x | y) if x | y else 1.0


def test_least_similarity_is_exact(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(900)]
    data = []
    for g in range(15):
        base = rng.choices(words, k=200)
        for c in range(4):
            w = list(base)
            for _ in range(c * 4):
                w[rng.randrange(200)] = rng.choice(words)
            data.append((g * 10 + c, " ".join(w)))
    data += [(900, ""), (901, None), (902, "same"), (903, "Same")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, shingle=5, radius=11, segments=4, limit=52, words=4, repeats=False, least=0.8).collect()}
    parent = {i: i for i, _ in data}
    for i, a in data:
        for j, b in data:
            if i < j and jaccard(a, b) >= 0.8:
                x, y = sorted((parent[i], parent[j]))
                parent = {k: x if v == y else v for k, v in parent.items()}
    right = sum(got[i] == parent[i] for i in parent)
    assert right >= len(parent) - 2  # fingerprints may miss a pair
    texts = dict(data)
    for i, c in got.items():
        if c != i:
            assert any(got[j] == c and j != i and jaccard(texts[i], texts[j]) >= 0.8 for j in texts)
    assert got[901] == got[900] and got[903] == 902


def test_closest_forest_keeps_nearest_links():
    rng = random.Random(6)
    f = np.array([[rng.getrandbits(64) & 0xFFF] for _ in range(120)], np.uint64)
    f = np.unique(f, axis=0)
    links = simhash.forest(f, 4)
    d = simhash.distances(f, f).astype(int) + np.eye(len(f), dtype=int) * 99
    for i in range(len(f)):
        if d[i].min() <= 4:
            assert any(i in x and d[x[0], x[1]] == d[i].min() for x in links)


def exact_components(data, least=0.8, k=5):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, t in data if (w := t.split())}
    parent = {i: i for i, _ in data}
    ids = sorted(parent)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if parent[i] != parent[j] and (both := len(sets[i] & sets[j])) >= least * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((parent[i], parent[j]))
                parent = {a: x if b == y else b for a, b in parent.items()}
    return parent


HOW = {"shingle": 5, "radius": 11, "segments": 4, "words": 4, "repeats": False, "least": 0.8}


def test_large_family_of_pairs_keeps_every_pair(spark):
    """Over 512 texts near one centre, of which only pairs are similar enough: no link to the centre may stand for a pair."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(900)]
    base = rng.choices(words, k=200)

    def changed(w, n):
        w = list(w)
        for at in rng.sample(range(200), n):
            w[at] = rng.choice(words)
        return w

    data = [(0, " ".join(base))]
    for i in range(300):
        b = changed(base, 9)
        data += [(2 * i + 1, " ".join(b)), (2 * i + 2, " ".join(changed(b, 2)))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, limit=50, **HOW).collect()}
    assert got == exact_components(data)


def test_search_goes_on_past_many_rejected(spark, monkeypatch):
    """Parts of few rows and rounds give what one look at all pairs gives."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(10)
    words = [f"v{i}" for i in range(300)]
    base = rng.choices(words, k=60)
    data = [(i, " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base)) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, limit=96, **HOW).collect()}
    assert got == exact_components(data)


def test_short_texts_and_pairs_at_the_least_similarity(spark):
    """Texts of 8 words and one word more, and of 200 words at 0.8 to 0.85: none is lost."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(5000)]
    data = []
    for i in range(300):
        w = rng.choices(words, k=8)
        data += [(4 * i, " ".join(w)), (4 * i + 1, " ".join([*w, rng.choice(words)]))]
        w = rng.choices(words, k=100)
        data += [(4 * i + 2, " ".join(w)), (4 * i + 3, " ".join([*w, *rng.choices(words, k=23)]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, _ in data if i % 2 == 0}


def test_heavy_keys_are_split(spark, monkeypatch):
    """200 fingerprints that share a segment: no task sees them together, and they are connected as before."""
    monkeypatch.setattr(simhash, "BLOCK", 30, raising=False)
    plain = simhash.bucket_links

    def bounded(key, ids, f, limit):
        if np.unique(key, return_counts=True)[1].max() > 120:
            raise ValueError("too many rows under a key")
        return plain(key, ids, f, limit)

    monkeypatch.setattr(simhash, "bucket_links", bounded)
    rng = random.Random(12)
    prints = sorted({rng.getrandbits(7) for _ in range(600)} | {(1 << 20) + rng.getrandbits(7) for _ in range(600)})
    nodes = spark.createDataFrame(list(enumerate(prints)), "id long, f0 long")
    found = simhash.components(simhash.near_links(nodes, 4, 3, 4, 1), "a", "b")
    assert {r["component"] for r in found.collect()} == {0} and found.count() == len(prints) > 200


def test_a_round_looks_at_few_links_a_text_and_begins_with_multi_index_hashing(spark, monkeypatch):
    """Near copies that share many keys: the new links of a round are a fixed number for each text, not for each key."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(900)]
    base = rng.choices(words, k=100)
    data = [(i, " ".join(rng.choice(words) if rng.random() < 0.05 else w for w in base)) for i in range(150)]
    looked, dealt, similar, near_links = [], [], simhash.similar, simhash.near_links
    monkeypatch.setattr(simhash, "similar", lambda links, *rest: looked.append(links.count()) or similar(links, *rest))
    monkeypatch.setattr(simhash, "near_links", lambda nodes, *rest: dealt.append(nodes.count()) or near_links(nodes, *rest))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, limit=96, **HOW).collect()}
    assert got == exact_components(data)
    assert dealt == [len({t for _, t in data})] and looked[1] <= 4 * len(data)


def test_odd_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(14)
    for n, changed in [(1, 0), (3, 1), (146, 16), (146, 40), (5000, 300)]:
        s = rng.integers(0, 2**63, n + changed, dtype=np.uint64)
        a, b = np.unique(s[:n]), np.unique(s[changed:])
        d = int(simhash.distances(simhash.odd_sketch(a)[None], simhash.odd_sketch(b)[None])[0, 0])
        only_one = len(np.setxor1d(a, b))
        assert d <= only_one and (d - only_one) % 2 == 0
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert d <= simhash.most_odd(0.8) * (len(a) + len(b)) + 1e-9
    assert not simhash.odd_sketch(np.empty(0, np.uint64)).any()


def test_a_family_of_near_copies_costs_few_links_a_text(spark, monkeypatch):
    """Near copies of one text of which half are not similar enough to any other: the rounds after the first look take a link a text at most, not all pairs."""
    rng = random.Random(15)
    words = [f"v{i}" for i in range(5000)]
    base = rng.choices(words, k=150)
    data = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(0, 12)):
            w[at] = rng.choice(words)
        data.append((i, " ".join(w)))
    looked, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda links, *rest: looked.append(links.count()) or similar(links, *rest))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, limit=96, **HOW).collect()}
    want = exact_components(data)
    assert got == want and len(set(want.values())) > 100
    assert sum(looked[1:]) <= len(data) and looked[0] <= 16 * len(data)
