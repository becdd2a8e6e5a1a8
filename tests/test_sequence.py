"""Sequence features against plain models written from their definitions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import sequence as S
from loomtrace.functions.compat import matches

EDGES = ["", "A", "AC", "ACD", "GGXA", "AAAAA", "AAAAAAAA", "KRDEKR", "XBZ", "VVVVVVIIIIII", "GPGGPGGPGAA", "ACACACACAC", "GGGGG", "GGAGGA", "RRRRDDDD", "PAPAPAA"]


def sequences():
    rng = random.Random(1)
    pieces = ["GGX", "GPGQQ", "AAAAAA", "AP", "K", "D", "V", "S", "X"]
    return EDGES + ["".join(rng.choices(pieces if i % 2 else "ACDEFGHIKLMNPQRSTVWYBX", k=rng.randint(1, 60))) for i in range(120)]


@pytest.fixture(scope="module")
def tools(spark):
    rows = [(i, s) for i, s in enumerate(sequences())]
    got = S.with_tools(spark.createDataFrame(rows, "id int, s string"), "s").collect()
    return [(dict(rows)[r["id"]], r) for r in got]


def clean(s):
    return "".join(c for c in s.upper() if c.isalpha())


def test_motifs(tools):
    for s, r in tools:
        want = {n: [(m.start(), m.end() - 1) for m in re.finditer(p, clean(s))] for n, p in S.MOTIFS.items()}
        got = {n: [tuple(x) for x in v] for n, v in r["motif_detector"]["spans"].items()}
        assert got == {n: v for n, v in want.items() if v}
        assert r["motif_detector"]["motifs"] == [n for n, v in want.items() if v]


def exact(values, scale):
    return [round(v * scale) for v in values]


def test_hydropathy(tools):
    for s, r in tools:
        v = exact([S.HYDROPATHY.get(c, 0.0) for c in clean(s)], 10)
        w = max(1, min(9, len(v)))
        sums = [sum(v[i : i + w]) for i in range(len(v) - w + 1)] if v else []
        x = r["hydropathy_profile"]
        assert x["window_size"] == w and x["mean_hydropathy"] == (round(sum(v) / 10 / len(v), 3) if v else 0.0)
        if not v:
            assert x["most_hydrophobic_span"] is None and x["max_window_value"] is None
            continue
        i, j = sums.index(max(sums)), sums.index(min(sums))
        assert tuple(x["most_hydrophobic_span"]) == (i, i + w - 1) and tuple(x["most_hydrophilic_span"]) == (j, j + w - 1)
        assert x["max_window_value"] == round(sums[i] / 10 / w, 3) and x["min_window_value"] == round(sums[j] / 10 / w, 3)


def test_charge_and_disorder(tools):
    for s, r in tools:
        c = clean(s)
        plus, minus = sum(x in "KR" for x in c), sum(x in "DE" for x in c)
        net = round((plus - minus) / len(c), 4) if c else 0.0
        q = r["charge_profile"]
        assert (q["positive_residues"], q["negative_residues"], q["net_charge"], q["mean_net_charge_per_residue"]) == (plus, minus, plus - minus, net)
        d = r["disorder_prediction_chplot"]
        if not c:
            assert tuple(d) == (0.0, 0.0, 0.0, False)
            continue
        h = (sum(exact([S.HYDROPATHY.get(x, 0.0) for x in c], 10)) / 10 / len(c) + 4.5) / 9
        b = (abs(net) + 1.151) / 2.785
        assert d["mean_charge"] == round(abs(net), 4) and abs(d["mean_hydropathy_normalized"] - h) < 6e-5 and d["predicted_disordered"] == (h < b)


def test_propensity(tools):
    for s, r in tools:
        v = exact([S.PROPENSITY.get(c, (1.0,) * 3)[1] for c in clean(s)], 100)
        hot = [sum(v[i : i + 6]) >= 630 for i in range(len(v) - 5)] if len(v) >= 6 else []
        spans, start = [], None
        for i, h in enumerate([*hot, False]):
            if h and start is None:
                start = i
            if not h and start is not None:
                spans.append((start, i - 1 + 5))
                start = None
        x = r["beta_sheet_propensity"]
        assert [tuple(t) for t in x["beta_rich_spans"]] == spans
        assert abs(x["mean_beta_propensity"] - (sum(v) / 100 / len(v) if v else 0)) < 6e-4 and x["beta_threshold"] == 1.05


def test_period(tools):
    for s, r in tools:
        c, best = clean(s), None
        for p in range(2, min(50, len(c) // 2) + 1) if len(c) >= 4 else []:
            score = sum(c[i] == c[i + p] for i in range(len(c) - p)) / (len(c) - p)
            if score > 0 and (best is None or score > best[0]):
                best = score, p
        x = r["repeat_pattern_analyzer"]
        assert tuple(x) == ((best[1], round(best[0], 3), c[: best[1]]) if best else (None, 0.0, None))


def test_known_controls(spark):
    assert all(r["passed"] for r in S.validate(spark).collect())
    r = S.with_tools(spark.createDataFrame([(S.MASP_UNIT * 3,)], "s string"), "s").first()
    assert r["repeat_pattern_analyzer"]["dominant_period"] == 35  # beyond the old limit of 20
    assert list(S.TOOLS) == ["motif_detector", "hydropathy_profile", "charge_profile", "beta_sheet_propensity", "repeat_pattern_analyzer", "disorder_prediction_chplot"]


def test_null_sequences(spark):
    r = S.with_tools(spark.createDataFrame([(None,)], "s string"), "s").first()
    assert r["seq"] is None


@pytest.mark.parametrize("pattern", [r"\d+", "a+", r"(?<=b)a"])
def test_match_offsets(spark, pattern):
    texts = ["", "aaa", "ba12a3", "é1a2", "xbabaa99", "no"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), pattern).alias("m")).collect()
    for r in got:
        assert [tuple(m) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r["t"])]


def test_expectations(spark):
    rows = [("a", "a" * 12, ["poly_alanine", "GGX_repeat"], ["proline_rich_turn"]), ("b", "", None, ["poly_alanine"]), ("c", None, ["poly_alanine"], []), ("d", "GG", None, None), ("a", "A" * 12, [], ["poly_alanine"])]
    got = S.expectations(spark.createDataFrame(rows, "name string, seq string, wanted array<string>, unwanted array<string>"), "name", "seq", "wanted", "unwanted").collect()
    # Runs of alanine count as the turn too.
    said = sorted((r["name"], r["check"], r["passed"]) for r in got if r["name"] != "c")
    assert said == [("a", "GGX_repeat detected", False), ("a", "poly_alanine absent", False), ("a", "poly_alanine detected", True), ("a", "proline_rich_turn absent", False), ("b", "poly_alanine absent", True)]
    assert [bool(r["passed"]) for r in got if r["name"] == "c"] == [False]
    assert S.passed_fraction(spark.createDataFrame(got, "name string, check string, passed boolean")).first()["n_checks"] == 6


def test_long_sequences_take_linear_time(spark):
    """Two million letters in one task; other alphabets' letters are no residues, but come again."""
    unit = "".join(random.Random(5).choices("ACDEFGHIKLMNPQRSTVWY", k=40)) * 500
    rows = spark.createDataFrame([(i, unit) for i in range(100)], "i int, s string").coalesce(1)
    S.with_tools(rows.limit(1), "s").collect()
    began = time.perf_counter()
    r = S.with_tools(rows, "s").agg(F.min("repeat_pattern_analyzer").alias("low"), F.max("repeat_pattern_analyzer").alias("high")).first()
    S.with_tools(rows, "s").select(F.max("beta_sheet_propensity"), F.max("hydropathy_profile"), F.max("disorder_prediction_chplot")).collect()
    assert r["low"] == r["high"] and (r["low"]["dominant_period"], r["low"]["repeat_score"]) == (40, 1.0)
    assert time.perf_counter() - began < 30
    r = S.with_tools(spark.createDataFrame([("ÄÖÜ" * 4 + "V",)], "s string"), "s").first()
    assert (r["repeat_pattern_analyzer"]["dominant_period"], r["repeat_pattern_analyzer"]["example_repeat_unit"]) == (3, "ÄÖÜ")
    assert r["hydropathy_profile"]["mean_hydropathy"] == round(4.2 / 13, 3) and r["hydropathy_profile"]["window_size"] == 9


def test_terms_are_found_as_by_their_plain_alternation_in_less_time(spark):
    """Odd letters count as before; most texts have no term, and going through these took three passes of all terms at each letter."""
    import time

    from loomtrace.functions import text

    plain = "(?iu)" + "|".join(re.escape(t) for t in text.MOTIF_TERMS)
    odd = ["POLY-ALANINE poly-ala polyalanine", "ſpidroin repeat", "cryſtalline region, blocK copolymer", "Β-ſheet ϐ-turn ΑLPHA-HELIX Α-helix", "gggxggx ggggx GPGXX gpgq", "İntrinsically disordered", "", "glycine  rich glycine rich-spacer", None]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(matches(F.col("t"), text._any(text.MOTIF_TERMS)).alias("a"), matches(F.col("t"), plain).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and [len(r["a"]) for r in got[:5]] == [3, 1, 2, 3, 4]

    prose = spark.range(400).selectExpr("repeat(concat('the green archive of a big region bears no such phrase ', id, ' '), 150) AS t").cache()
    prose.count()

    def took(pattern):
        began = time.perf_counter()
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        gaps = F.split(F.regexp_replace("t", pattern, "|"), "|")
        prose.select((F.size(found) + F.size(gaps)).alias("n") if pattern is plain else F.size(matches(F.col("t"), pattern)).alias("n")).agg(F.sum("n")).collect()
        return time.perf_counter() - began

    before, after = (min(took(p) for _ in range(4)) for p in (plain, text._any(text.MOTIF_TERMS)))
    assert after < 0.7 * before
