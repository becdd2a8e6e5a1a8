"""Scores against plain counts and held-out accuracy, and the pipeline by what must hold after each stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomtrace.llm import common, lm, mixing, pii, queries, toxicity


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "of", "and", "É", "x y", *(f"w{int(rng.paretovariate(0.6))}" for _ in range(400))]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def write_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_op2_base_scores(spark, tmp_path):
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts(200))] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (901, "", "en", "s", 0), (902, "w1 " * 60_000, "en", "s", 0)]
    write_documents(spark, tmp_path, data)
    got = lm.op2_log_bloom_lm(spark, str(tmp_path)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i, t, *_ in data if not held(i) for w in tokens(t))
    total, types = sum(seen.values()), len(seen)
    want = sorted((i, held(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), total, round(sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in tokens(t)), 6)) for i, t, *_ in data)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def plain_scores(learned, asked, order):
    """The model by dictionaries, with counts as the levels give them: the least of a level above, the greatest below."""
    tokens = lambda t: ["<s>", "<s>", *(t or "").encode().lower().split(), b""]
    steps = [int(x) for x in lm.STEPS]
    low = lambda c: max((x for x in steps if x <= c), default=0)
    high = lambda c: next(x for x in steps if x > c) - 1 if c else 0
    counts = [Counter() for _ in range(order + 1)]
    for t in learned:
        w = tokens(t)
        for k in range(1, order + 1):
            for i in range(1 if k < order else 2, len(w)):
                counts[k][tuple(w[i - k + 1 : i + 1])] += 1
    total = sum(c for (g,), c in counts[1].items() if g != "<s>")
    types = sum(g != "<s>" for (g,) in counts[1])
    distinct = [types, *(len([g for g in counts[k] if g[-1] != "<s>"]) + (k < order) for k in range(2, order + 1))]
    out = []
    for t in asked:
        w, score = tokens(t), 0.0
        for i in range(2, len(w)):
            p = (low(counts[1][w[i],]) + 1) / (total + types + 1)
            for k in range(2, order + 1):
                m = max(1.0, distinct[k - 1] / max(1, distinct[k - 2]))
                p = min(1.0, (low(counts[k][tuple(w[i - k + 1 : i + 1])]) + m * p) / (high(counts[k - 1][tuple(w[i - k + 1 : i])]) + m))
            score += math.log10(p)
        out.append(score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_a_plain_model_both_ways(spark, monkeypatch, order):
    """A filter of many bits has no false hits, so scores are those of plain counts; dealt by key they are the same."""
    monkeypatch.setattr(lm, "BITS", 200)
    data = [*texts(120, 3), None, "", "w1 " * 3000]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(data)], "doc_id long, text string, segment string, score double").repartition(3)
    model = lm.learn(df.select("text"), order=order, segment_text=1 << 11)
    want = plain_scores(data, data, order)
    for limit in (lm.BROADCAST_BYTES, 0):
        got = {r["doc_id"]: r["score"] for r in lm.score(df, model, "doc_id", "text", limit).collect()}
        assert all(abs(got[i] - w) < 1e-6 * max(1, -w) for i, w in enumerate(want))


def rows_shuffled(df):
    """Rows that each exchange of a plan that has run wrote."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.length())]
    return found


def test_buckets_ask_groups_of_segments(spark):
    """Of 4096 segments 16 are a group: a bucket sends each group a row and gets a row back, however many segments it asks. Scores are those of the broadcast."""
    data = texts(400, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc_id long, text string").coalesce(1)
    model = lm.learn(df.select("text"), segment_text=12)
    n_segments = model.segments.count()
    assert model.bits == 12 and n_segments > 1000
    by_group = lm.score(df, model, "doc_id", "text", 0)
    got = {r["doc_id"]: r["score"] for r in by_group.collect()}
    assert got == {r["doc_id"]: r["score"] for r in lm.score(df, model, "doc_id", "text").collect()}
    answers, asked = sorted(rows_shuffled(by_group))  # those with the texts, and with the segments
    assert answers <= 256 + 1 and asked <= 256 + n_segments


def test_probabilities_add_up_to_one_at_most(spark):
    data = texts(60, 5)
    model = lm.learn(spark.createDataFrame([(t,) for t in data], "text string"))
    vocabulary = sorted({w for t in data for w in t.lower().split()})
    for context in vocabulary[:3]:
        asked = spark.createDataFrame([(i, f"{context} {w}") for i, w in enumerate([*vocabulary, context])], "doc_id long, text string")
        rows = {r["doc_id"]: r["score"] for r in lm.score(asked, model, "doc_id", "text").collect()}
        alone = {r["doc_id"]: r["score"] for r in lm.score(asked.selectExpr("doc_id", f"'{context}' AS text"), model, "doc_id", "text").collect()}
        assert all(rows[i] < 0 for i in rows) and max(rows.values()) <= max(alone.values())


def test_filter_reads_back_levels():
    keys = lm.remix(np.arange(1, 2001, dtype=np.uint64))
    counts = np.r_[np.arange(1, 1001), np.arange(1, 1001)].astype(np.uint64)
    part = lm.build_part(keys, counts)
    held = lm.Filter(2, part, np.zeros(4, np.int64), np.full(4, 8 * len(part)))
    kept = lm.narrow(keys, 2)
    part = lm.build_part(kept, counts)
    held = lm.Filter(2, part, np.zeros(4, np.int64), np.full(4, 8 * len(part)))
    level = np.searchsorted(lm.STEPS, counts, "right")
    read = held.levels(keys)
    assert (read >= level).all() and (read == level).mean() > 0.95
    assert (held.levels(lm.remix(keys)) == 0).mean() > 0.95


def test_keys_survive_packing():
    keys = np.sort(lm.remix(np.arange(5000, dtype=np.uint64)))
    for bits in (2, 8, 20):
        for segment, own in lm.cut_by(lm.narrow(keys, bits), bits):
            assert (lm.from_bytes(lm.to_bytes(keys[own], bits), segment, bits) == lm.narrow(keys[own], bits)).all()


def test_lm_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = lm.learn(df.limit(0).select("text"))
    for limit in (lm.BROADCAST_BYTES, -1):
        row = lm.score(df, model, "doc_id", "text", limit).first()
        assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["base_score"] == 0.0
        assert lm.score(df.limit(0), model, "doc_id", "text", limit).count() == 0


INSULTS = ["blorgel", "snarkit", "grumpus"]


def labelled(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(3, 60))
        toxic = int(rng.random() < 0.2)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        docs.append((i, " ".join(w) + ".", "en", f"s{i % 4}", 0))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("toxic"))
    docs, labels = labelled(1500)
    docs += [(5000, None, "en", "s0", 0), (5001, "", "en", "s0", 0), (5002, "a" * 200_000, "en", "s0", 0), (5003, "lorem " * 40_000, "en", None, 0), (5004, docs[0][1], "en", "s0", 0)]
    labels += [(5000, 1, None), (None, 1, 1), (7, 1, 0)]
    write_documents(spark, path, docs)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, labels


def test_op3_held_out_accuracy(spark, toxic_tables):
    path, docs, labels = toxic_tables
    got = {r["doc_id"]: r for r in toxicity.op3_string_kernel_svm(spark, path).collect()}
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels[:1500]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] < 0.5


def test_gapped_and_inserted_letters(spark, toxic_tables):
    path, _, _ = toxic_tables
    model = toxicity.fitted(spark, common.table(spark, path, "documents"), path)
    said = ["you b l o r g e l you", "bl-or-gel", "blorrgel", "sn.ark.it", "snarkkit", "GRUMPUS", "grummpus"]
    clean = ["you are", "some more of the rest", "storm lines are", "", None]
    score = model.score([*said, *clean])
    assert (score[: len(said)] > 0.5).all() and (score[len(said) :] < 0.5).all()


def plain_kernel(s, t):
    def features(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(a[x] * b[x] for x in a) / norm if norm else 0.0


def test_kernel_matches_the_definition():
    words = [b"idiot", b"idixot", b"aaaa", b"ab", b"abcabcabc", b"{{xx{", b"stupidity"]
    got = toxicity.Landmarks([b"idiot", b"abcabc", b"xx{"]).kernel(words)
    for i, w in enumerate(words):
        for j, z in enumerate([b"idiot", b"abcabc", b"xx{"]):
            want = plain_kernel(w, z) ** toxicity.POWER
            assert abs(got[i, j] - want) < 1e-5


def test_texts_add_up_their_words_and_the_kernel_is_positive():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 20))) for _ in range(60)]
    said = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(40)] + ["", None]
    marks = toxicity.Landmarks(sorted(w for w in toxicity.words_of(" ".join(words)) if 3 <= len(w) <= toxicity.LONGEST))
    got = toxicity.Memo(marks.kernel, len(marks.words)).sums(said)
    for i, t in enumerate(said):
        own = sorted(toxicity.words_of(t))
        assert np.allclose(got[i], marks.kernel(own).sum(0) if own else 0, atol=1e-4)
    assert np.linalg.eigvalsh(marks.kernel(marks.words).astype(float)).min() > -1e-4
    counts = np.array([[w in toxicity.words_of(t) for w in marks.words] for t in said], float)
    assert np.linalg.eigvalsh(counts @ marks.kernel(marks.words) @ counts.T).min() > -1e-3


def test_capital_and_accented_letters():
    assert toxicity.words_of("ÉTÉ") == toxicity.words_of("été") != toxicity.words_of("ôtô")
    assert toxicity.words_of("a.b-c i d i o t") == {b"abc", b"idiot"}
    assert toxicity.landmark_words("ass") == {b"ass"}


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1]])
def test_labels_of_one_kind(spark, toxic):
    docs = spark.createDataFrame([(0, "a b"), (1, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    want = sum(toxic) / len(toxic) if toxic else 0.0
    assert [r["score"] for r in toxicity.score_texts(docs, model, ["doc_id"]).collect()] == [want, want]


def near_copy(text, rng):
    w = text.split()
    w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


def test_pipeline_stages(spark, toxic_tables, tmp_path):
    path, docs, labels = toxic_tables
    rng = random.Random(9)
    long = [" ".join(rng.choices([f"u{i}" for i in range(3000)], k=400)) for _ in range(12)]
    extra = [(6000 + i, t, "en", "s1", len(t)) for i, t in enumerate(long)]
    extra += [(6100 + i, t, "en", "s2", len(t)) for i, t in enumerate(long)]
    extra += [(6200 + i, near_copy(t, rng), "en", "s3", len(t)) for i, t in enumerate(long)]
    extra += [(6300, long[0][:0] + "write to bob@mail.example.com about all of this and nothing else", "en", "s1", 1)]
    write_documents(spark, tmp_path, docs + extra)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "doc_id AS score", "text AS i", "doc_id AS rate")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = common.stored(stage(spark, frame, str(tmp_path)))
        seen[name] = frame.collect()
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "i", "rate"]
    assert all(list(seen[s][0].asDict()) == names for s in ("toxicity", "near_duplicates", "personal_data", "mixing"))
    ids = {s: {r["doc_id"] for r in rows} for s, rows in seen.items()}
    toxic = {i for i, _, t in labels[:1500] if t}
    assert len(ids["toxicity"] & toxic) < 0.05 * len(toxic) and len((set(range(1500)) - toxic) - ids["toxicity"]) < 15
    assert {6000 + i for i in range(12)} <= ids["near_duplicates"] and not any(i // 100 in (61, 62) for i in ids["near_duplicates"])
    assert "<email>" in next(r["text"] for r in seen["personal_data"] if r["doc_id"] == 6300)
    assert ids["personal_data"] == ids["near_duplicates"]
    rows = {r["doc_id"]: r["text"] for r in seen["personal_data"]}
    assert all(r["text"] == rows[r["doc_id"]] for r in seen["mixing"])
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert Counter(r["doc_id"] for r in seen["packing"] if r["piece"] == 0) == copies
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_empty_pipeline(spark, tmp_path):
    write_documents(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert mixing.ORACLE and pii.KINDS
