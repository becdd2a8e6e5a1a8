"""License phrases and texts against a plain model, and their odd inputs."""

import random
import re

from loomtrace.llm import licenses

FIELDS = "doc_id long, text string, id string, template string, words int"
MIT = licenses.TEMPLATES["mit"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    w = words(text)
    base = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels, score = {lab for _, lab in base}, licenses.PHRASE_SCORE if base else 0.0
    for label, template in licenses.TEMPLATES.items():
        t = words(template)
        votes = {}
        for i in range(len(w) - 3):
            for j in range(len(t) - 3):
                if w[i : i + 4] == t[j : j + 4]:
                    votes.setdefault(i - j, set()).add(j)
        span, before = set(), None
        for d in sorted(votes):
            span = span | votes[d] if before is not None and d - before <= licenses.GAP else votes[d]
            before = d
            share = len(span) / (len(t) - 3)
            score = max(score, share)
            if share >= licenses.SHARE:
                labels.add(label)
    ends = [i for i, _ in base]
    return len(w), len(base), min(ends, default=None), max(ends, default=None), ",".join(sorted({lab for _, lab in base})), ",".join(sorted(labels)), score


def got(df):
    return sorted((tuple(r) for r in licenses.labelled(df, "doc_id", "text").collect()), key=repr)


def test_labels_match_a_plain_model(spark):
    rng = random.Random(5)
    pieces = ["the MIT", "License", "mit license", "Apache-License", "general public", "license", "and", "word", "Straße", *(" ".join(t.split()[a : a + n]) for t in licenses.TEMPLATES.values() for a, n in ((0, 12), (0, 200), (5, 9)))]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))), "x", "y", 1) for i in range(150)]
    cut = words(MIT)
    for i in range(40):  # copies of a text with words dropped and put in
        own = [x for w in cut for x in ([] if rng.random() < 0.02 else ["extra", w] if rng.random() < 0.03 else [w])]
        rows.append((1000 + i, " ".join(["before"] * i + own + ["after"]), "x", "y", 1))
    want = sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)
    assert got(spark.createDataFrame(rows, FIELDS).repartition(3)) == want
    assert sum(1 for r in want if r[0] >= 1000 and "mit" in r[6].split(",")) > 30


def test_labels_of_odd_rows(spark):
    long = " ".join(["MIT License"] * 3000)
    texts = [None, "", "...", "mit", "MIT License", "MIT license", MIT.upper(), "Kind mit.license!", long, "apache license mit license", "émit license"]
    rows = [(i, t, "a", "b", 2) for i, t in enumerate(texts)] + [(5, "MIT license", "a", "b", 2)] * 2 + [(5, "other", "a", "b", 2), (None, "gnu general public license", "", "", 0), (None, "mit license", "", "", 0)]
    want = sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)
    assert got(spark.createDataFrame(rows, FIELDS)) == want
    by = {r[0]: r for r in want if r[0] is not None}
    assert by[8][2:5] == (3000, 0, 5998)
    assert by[6][6] == "mit"
    assert got(spark.createDataFrame([], FIELDS)) == []


def test_spans_tell_where(spark):
    text = "one two " + MIT + " three " + "licensed under the Apache License, version 2.0"
    found = licenses.spans(spark.createDataFrame([(1, text, "", "", 0)], FIELDS), "doc_id", "text").where("found >= 0.6").collect()
    n = len(words(MIT))
    assert {(r["label"], r["phrase"], r["first_word"], r["last_word"]) for r in found} == {("mit", False, 2, n + 1), ("apache-2.0", False, n + 3, n + 10), ("apache", True, n + 6, n + 7)}


def test_only_native_expressions_run(spark):
    plan = licenses.labelled(spark.createDataFrame([(1, "mit license", "", "", 0)], FIELDS), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
