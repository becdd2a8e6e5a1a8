"""Claims, grounding, rewards, pairs, sources and streams: the odd cases, one by one."""

import json
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.functions.sequence import TOOLS as TOOL_NAMES
from loomtrace.functions.sequence import with_tools
from loomtrace.operators import grounding, pairs, rewards, stats, traces
from loomtrace.sources import completions, datasets, sinks
from loomtrace.streaming.audit import audit_stream


def claims(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", T.claims(F.col("t")).alias("c")).collect()
    return [r["c"] for r in sorted(rows, key=lambda r: r["id"])]


def of(found, kind):
    return [c for c in found if c["kind"] == kind]


def test_numeric_claims(spark):
    a, b, c, d, e = claims(spark, "1. First is 0.5.\n12. Then -5 and -12 and 7 %", "residue 0.0194 holds", "spans 16-23, 123-456", "45kcal/mol, 3 percent, 12", "")
    assert [(x["raw"], x["num"]) for x in of(a, "numeric")] == [("0.5", 0.5), ("-12", -12.0), ("7 %", 7.0)]
    assert [x["num"] for x in of(b, "numeric")] == [0.0194] and not of(b, "position")
    assert [x["num"] for x in of(c, "numeric")] == [123.0]  # the second number follows a hyphen
    assert [(x["raw"], x["num"]) for x in of(d, "numeric")] == [("45kcal/mol", 45.0), ("3 percent", 3.0)]
    assert e == []


def test_position_claims(spark):
    a, b, c = claims(spark, "Residues 3-9 and positions at 10 to 12, residue 900; regions of 5–7.", "at 16-23, 23-35, 4 - 8", "domain 5 turn 6")
    assert [(x["lo"], x["hi"]) for x in of(a, "position")] == [(3, 9), (10, 12), (900, 900), (5, 7)]
    assert [(x["lo"], x["hi"]) for x in of(b, "position")] == [(16, 23), (23, 35), (4, 8)]
    assert of(c, "position") == []


def test_motif_claims_and_roles(spark):
    a, b = claims(spark, "Β-SHEET, poly-Ala", "This disrupts beta-sheet order. " + "x" * 70 + " A random coil forms")
    assert [x["term"] for x in of(a, "motif")] == ["β-sheet", "poly-ala"]
    assert [(x["term"], x["role"]) for x in of(b, "motif")] == [("beta-sheet", "contrastive"), ("random coil", "direct")]


def blanked(text):
    """A number of one or two digits and its dot, alone between a line's leading white space and more of it, give way to spaces."""
    out = list(text)
    for start in [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]:
        first = start
        while first < len(text) and text[first].isspace():
            first += 1
        last = first
        while last < len(text) and text[last].isdigit():
            last += 1
        if 1 <= last - first <= 2 and text[last : last + 1] == "." and text[last + 1 : last + 2].isspace():
            out[first : last + 1] = " " * (last + 1 - first)
    return "".join(out)


def numbers_in(text):
    """Signed decimals that don't begin behind a digit or a hyphen, with the unit behind them."""
    i = 0
    while i < len(text):
        start = i + 1 if text[i] == "-" and text[i + 1 : i + 2].isdigit() else i
        if not text[start].isdigit() or i and (text[i - 1].isdigit() or text[i - 1] == "-"):
            i += 1
            continue
        end = start
        while end < len(text) and text[end].isdigit():
            end += 1
        end += text[end : end + 1] == "."
        while end < len(text) and text[end].isdigit():
            end += 1
        rest = text[end:].lstrip()
        unit = next((u for u in ("%", "percent", "kcal/mol", "kcal") if rest.startswith(u)), "")
        if unit or "." in text[i:end] or end - i > 2:
            yield float(text[i:end])
        i = end


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="1. \na-9", max_size=25), min_size=8, max_size=8))
def test_claims_reproduce_the_text(spark, texts):
    for t, found in zip(texts, claims(spark, *texts), strict=True):
        masked = blanked(t)
        for c in found:
            assert masked[c["start"] : c["end"]].strip() == c["raw"].strip()
        assert [c["num"] for c in of(found, "numeric")] == list(numbers_in(masked))


TOOLS = "array<struct<name:string,numbers:array<double>,ranges:array<struct<lo:int,hi:int>>,text:string,keys:array<string>>>"


def grounded(spark, text, tools):
    df = spark.createDataFrame([(1, text, tools)], f"id int, t string, tools {TOOLS}")
    return grounding.ground(grounding.explode_claims(df, "t")).orderBy("claim_ord").collect()


def test_closest_number_of_the_latest_tool(spark):
    first, second = ("first", [10.0, 10.2, 0.954], [], "", []), ("second", [0.4851, 100.0], [(40, 12)], "polyalanine", ["meanbetapropensity"])
    rows = grounded(spark, "0.954 then 10.15 then 101.9 then 9.9 then 0.50", [first, second])
    assert [(r["grounded"], r["evidence_tool"], r["matched"]) for r in rows] == [(True, "first", 0.954), (True, "first", 10.2), (True, "second", 100.0), (True, "first", 10.0), (True, "second", 0.4851)]
    rows = grounded(spark, "residues 12-40, residue 41, poly-alanine, beta-sheet, random coil", [first, second])
    assert [r["grounded"] for r in rows] == [True, False, True, True, False]


def test_tolerance_scales_with_the_tool(spark):
    rows = grounded(spark, "103.0 97.0 97.1 0.02", [("t", [100.0, 0.0], [], "", [])])
    assert [r["grounded"] for r in rows] == [True, True, True, True]
    assert not grounded(spark, "103.1", [("t", [100.0], [], "", [])])[0]["grounded"]
    assert not grounded(spark, "0.5", [])[0]["grounded"]


STEP = f"struct<step_type:string,text:string,tool:{TOOLS[6:-1]}>"


def test_long_traces_by_rows_and_short_ones_within(spark):
    """Both give the same claims and evidence."""
    rng = random.Random(4)
    number = lambda: rng.choice([0.5, -0.5, 12.25, 100.0, 103.0, 106.1, 0.0, 0.02, 0.041, 1e6, 1.03e6, -97.0, float("nan")])

    def step():
        if rng.random() < 0.5:
            texts = [f"value {number()!r}.", f"residues {rng.randint(1, 30)}-{rng.randint(1, 60)} fold.", f"a {rng.choice(['poly-alanine', 'beta-sheet', 'amorphous region', 'GGX'])} run.", "nothing."]
            return ("reasoning", rng.choice([None, " ".join(rng.choice(texts) for _ in range(3))]), None)
        tool = (rng.choice("abc"), [number() for _ in range(rng.randint(0, 5))], [(rng.randint(0, 20), rng.randint(0, 50)) for _ in range(rng.randint(0, 2))], rng.choice(["", "polyalanine", "ggxrepeat"]), rng.choice([[], ["meanbetapropensity"], ["turn"]]))
        return ("tool_call", None, tool)

    rows = [(i, [step() for _ in range(rng.randint(0, 14))]) for i in range(60)] + [(98, None), (99, [("tool_call", None, ("a", [1.5], [], "", []))] * 3)]
    df = spark.createDataFrame(rows, f"id int, trace array<{STEP}>")
    got = [sorted((tuple(r) for r in traces.structured_claims(df, "id", short=n).drop("matched").collect()), key=repr) for n in (100, 5, 0)]
    assert len(got[0]) > 300 and sum(1 for r in got[0] if r[-3]) > 40
    assert all(len(g) == len(got[0]) for g in got[1:])
    has_steps = lambda g: [r for r in g if r[1] is not None]
    assert has_steps(got[0]) == has_steps(got[1]) == has_steps(got[2])


def test_a_trace_of_ten_thousand_steps(spark):
    tool, said = "named_struct('name', concat('t', i), 'numbers', array(cast(i AS double) * 10), 'ranges', array(named_struct('lo', 0, 'hi', cast(i AS int))), 'text', 'none', 'keys', array('turn'))", "concat('It is ', i * 5, '.0 at residue 9 here.')"
    step = f"transform(sequence(0, 9999), i -> named_struct('step_type', IF(i % 2 = 0, 'tool_call', 'reasoning'), 'text', IF(i % 2 = 1, {said}, NULL), 'tool', IF(i % 2 = 0, {tool}, NULL)))"
    df = spark.range(1).selectExpr("id", f"{step} AS trace")
    began = time.monotonic()
    rows = traces.structured_claims(df, "id").where("kind = 'numeric'").collect()
    assert time.monotonic() - began < 90 and len(rows) == 5000
    # The number 5 i was told by tool i / 2, and by others within 3 %, of which the latest before step i counts.
    for r in rows:
        hits = [t for t in range(0, r["step_index"], 2) if abs(10 * t - r["num"]) <= max(0.02, 0.3 * t)] if r["step_index"] < 400 else None
        assert hits is None or r["evidence_tool"] == (f"t{hits[-1]}" if hits else None)


def leaves(x):
    """A plain walk: leaves, keys, and lists of two numbers."""
    if isinstance(x, dict):
        parts = [leaves(v) for v in x.values()]
        return sum((p[0] for p in parts), []), [k for key, p in zip(x, parts, strict=True) for k in (key, *p[1])], sum((p[2] for p in parts), [])
    if isinstance(x, list):
        parts = [leaves(v) for v in x]
        own = [(int(x[0]), int(x[1]))] if len(x) == 2 and all(isinstance(v, int | float) for v in x) else []
        return sum((p[0] for p in parts), []), sum((p[1] for p in parts), []), own + sum((p[2] for p in parts), [])
    return [x], [], []


def plain_facts(text):
    try:
        found, keys, ranges = leaves(json.loads(text))
    except (TypeError, ValueError):
        return [], [], "", []
    flat = lambda t: re.sub(r"[-_\s]+", "", t.lower())
    return [float(v) for v in found if isinstance(v, int | float) and not isinstance(v, bool)], ranges, flat(" ".join(str(v) for v in found)), [flat(k) for k in keys]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.sampled_from([0.5, -2.25, 17.125]) | st.text(alphabet="aB-_ 1{[\"", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="Kk_-z", max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(VALUES, min_size=12, max_size=12))
def test_facts_of_any_output(spark, values):
    texts = [json.dumps(v) for v in values] + [None, "oops", '{"b": 1, "a": {"d": [1, 2], "c": [[3, 4.9], [5, "6"], [true, 2]]}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", grounding.facts(F.lit("x"), F.col("t"), 12).alias("f")).orderBy("i").collect()
    for t, r in zip(texts, rows, strict=True):
        f = r["f"]
        assert (f["numbers"], [tuple(x) for x in f["ranges"]], f["text"], f["keys"]) == plain_facts(t), t


def test_facts_of_the_six_tools(spark):
    """The walk of their JSON, and what is put together from their fields."""
    seqs = ["", "A", "GGAGQGGYGGLGSQGAGAAAAAAAAGPGQQGPGGYGPG", "PAPAPAPPAPKRDE" * 3, "VVVVVVIIIIII", "ACD" * 40]
    rows = with_tools(spark.createDataFrame([(s,) for s in seqs], "s string"), "s").select(grounding.tool_outputs().alias("a"), F.array(*[F.struct(F.lit(n).alias("name"), grounding.output_json(n).alias("output")) for n in TOOL_NAMES]).alias("b")).collect()
    opened = spark.createDataFrame([(i, r["b"]) for i, r in enumerate(rows)], "i int, b array<struct<name:string,output:string>>").select("i", F.transform("b", lambda o: grounding.facts(o["name"], o["output"])).alias("b")).orderBy("i").collect()
    for a, b in zip(rows, opened, strict=True):
        assert a["a"] == b["b"]
    with pytest.raises(Exception, match="nested deeper"):
        spark.range(1).select(grounding.facts(F.lit("x"), F.lit("[[[1]]]"), 2)).collect()


def test_tools_run_once_for_each_sequence(spark, tmp_path):
    """Slots of one sequence share a row of tools' outputs, and prompts and grounding read it: no tool is left in their plans."""
    samples = spark.createDataFrame([(str(i), s, "f", "g", "s", "c", {"strength": 0.5, "toughness": 0.5}) for i, s in enumerate(["GGAGGQAAAA", "GGAGGQAAAA", "AAAAAAA", ""])], "prompt_id string, sequence string, family string, genus string, species string, protein_category string, ground_truth map<string,double>")
    tools = traces.tool_table(samples, str(tmp_path / "tools"))
    assert tools.count() == 3
    wanted = traces.slots(samples, 2, 1)
    asked = traces.answered(wanted, tools, lambda p: p)
    rows = {(r["prompt_id"], r["trace_kind"], r["k"]): r["completion"] for r in asked.collect()}
    assert len(rows) == 12
    said = json.loads(rows["0", "grounded", 0].partition("Tool outputs: ")[2])
    assert list(said) == list(TOOL_NAMES) and said["motif_detector"]["spans"]["GGX_repeat"] == [[0, 5]] and said["beta_sheet_propensity"]["beta_rich_spans"] == []
    assert "Tool outputs" not in rows["0", "shortcut", 0] and rows["1", "grounded", 1] == rows["0", "grounded", 0]
    for df in (asked, traces.score(asked, tools)):
        assert "regexp_extract_all(seq" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_mock_completion_is_caught(spark):
    samples = spark.createDataFrame([("p", "GGAGQGGYGGLGSQGAG", "f", "g", "s", "c")], "id string, sequence string, family string, genus string, species string, protein_category string")
    out = traces.pilot_batch(samples, "id")
    rows = {(r["kind"], r["raw"]): r["grounded"] for r in out["claims"].collect()}
    assert rows[("motif", "glycine-rich spacer")] and not rows[("numeric", "98765.4")] and not rows[("position", "residue 9876")]
    audit = out["audit"].first()
    assert audit["n_traces"] == 1 and audit["fully_grounded_fraction"] == 0.0 and out["errors"].count() == 0


def test_hints_with_all_tools_hold_but_one(spark):
    df = with_tools(spark.createDataFrame([("VVVV", "alpha-helix beta-turn crystalline region amorphous region")], "s string, t string"), "s").select("t", grounding.tool_outputs().alias("tools"))
    rows = grounding.ground(grounding.explode_claims(df, "t")).collect()
    assert {r["term"]: r["grounded"] for r in rows} == {"alpha-helix": True, "beta-turn": True, "crystalline region": True, "amorphous region": False}


def test_empty_audit(spark):
    empty = spark.createDataFrame([], "id int, kind string, role string, grounded boolean")
    a = grounding.audit(grounding.report(empty, "id")).first()
    assert (a["n_traces"], a["mean_grounding_score"], a["fully_grounded_fraction"], a["contrastive_ungrounded_fraction"]) == (0, 1.0, 1.0, None)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "body,want",
    [
        ('{"a": 1, "b": "0.6", "c": true, "d": null, "e": [1], "f": {"x": 1}}', {"a": 1.0, "b": 0.6, "c": 1.0}),
        ('{"a": "x"}', None), ("[1]", None), ("{", None), ('{"a": 1} x', None), ('{"a": "1d"}', None), ("{}", {}), (' \n{"a": -1e-3}\n', {"a": -0.001}),
    ],
)
def test_answers(spark, body, want):
    assert one(spark, f"x <answer>{body}</answer> <answer>{{}}</answer>", T.answer) == want


def test_answers_without_tags(spark):
    assert one(spark, "no", T.answer) is None and one(spark, None, T.answer) is None


@pytest.mark.parametrize("text,want", [("Confidence: 85%", 0.85), ("confident of 250 %", 1.0), ("very low confidence", 0.1), ("High Confidence", 0.75), ("none", None), ("moderate confidence, confidence 5%", 0.5)])
def test_confidence(spark, text, want):
    assert one(spark, text, T.confidence) == want


def test_steps_and_coherence(spark):
    assert one(spark, " One is\nwrapped. Two!\n \nThree", T.steps) == ["One is wrapped.", "Two!", "Three"]
    tag = lambda t: f"<reasoning>{t}</reasoning>"
    for text, want in [("none", 0.0), (tag("one"), 0.5), (tag(""), 0.5), (tag("Silk holds. Silk breaks."), 0.0), (tag("Fibres hold. Fibres break."), 1.0), (tag("A b. Thus c. D e."), 0.5), (None, 0.0)]:
        assert one(spark, text, T.coherence) == want, text


def test_rewards(spark):
    rows = [(0, {"s": 0.5, "t": 0.5}, {"s": 0.6, "t": 0.4}), (1, {"s": 0.5}, {"s": 0.5, "t": 0.1}), (2, None, {"s": 1.0}), (3, {"s": 9.0}, {"s": 0.0}), (4, {"s": 1.0}, {})]
    df = spark.createDataFrame(rows, "id int, p map<string,double>, t map<string,double>")
    p, t = F.col("p"), F.col("t")
    got = {r["id"]: r for r in df.select("id", rewards.outcome(p, t).alias("o"), rewards.mean_abs_error(p, t).alias("m"), rewards.is_correct(p, t, 0.11).alias("c")).collect()}
    assert abs(got[0]["o"] - 0.9) < 1e-9 and got[0]["c"] and [got[i]["o"] for i in (1, 2, 3, 4)] == [0.0] * 4
    assert got[1]["m"] is None and not got[2]["c"] and got[4]["m"] is None


def test_stages():
    assert {s: round(sum(w for n, w in v.items() if n != "calibration"), 2) for s, v in rewards.STAGES.items()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.85}
    with pytest.raises(ValueError):
        rewards.staged_reward(5)


def test_judge(spark):
    df = spark.createDataFrame([(1, "<reasoning>Aa. Bbb.</reasoning>"), (2, "none")], "id int, t string")
    got = {r["id"]: r["reasoning_quality"] for r in rewards.reasoning_quality(df, "id", "t", judge=lambda s, c: len(s)).collect()}
    assert got == {1: 3.5, 2: 0.0}
    with pytest.raises(Exception, match="pass a judge"):
        rewards.reasoning_quality(df, "id", "t").collect()


def test_a_step_is_judged_once(spark, tmp_path):
    """Steps that many completions share, and repeat, are rated once for each context; the means stay those of all steps."""

    def judge(step, context):
        (tmp_path / f"{step}-{context}-{random.random()}").write_text("")
        return float(len(step) + (context == "y"))

    rows = [(i, f"<reasoning>Same. Other{i % 3}. Same.</reasoning>", "x" if i % 2 else "y") for i in range(60)] + [(60, "<reasoning>Same.</reasoning>", None), (61, None, "x")]
    got = {r["id"]: r["reasoning_quality"] for r in rewards.reasoning_quality(spark.createDataFrame(rows, "id int, t string, c string").repartition(5), "id", "t", judge, "c").collect()}
    assert len(got) == 62 and got[60] == 5.0 and got[61] == 0.0
    assert all(abs(got[i] - (5 + 7 + 5 + 3 * (i % 2 == 0)) / 3) < 1e-12 for i in range(60))
    assert Counter(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == Counter([f"{s}-{c}" for s in ("Same.", "Other0.", "Other1.", "Other2.") for c in "xy"] + ["Same.-None"])


def test_truth_without_the_property_raises(spark):
    run = lambda truth, text: spark.createDataFrame([(text, {"strength": 0.5}, truth)], "t string, p map<string,double>, u map<string,double>").select(rewards.calibration(F.col("t"), F.col("p"), F.col("u"), "strength").alias("x")).first()["x"]
    assert run({"strength": 0.5}, "confidence: 100%") == 1.0
    assert run({"toughness": 0.5}, "says nothing") == 0.5  # not looked at
    with pytest.raises(Exception, match="no strength"):
        run({"toughness": 0.5}, "confidence: 100%")


def test_answers_must_have_both_properties(spark, tmp_path):
    def read(*answers):
        (tmp_path / "p.json").write_text(json.dumps({"scored_traces": [{"metadata": {"sequence": "AC", "trace_kind": "grounded"}, "final_answer": a} for a in answers]}))
        return [tuple(r) for r in sinks.read_scored_traces(spark, str(tmp_path / "p.json")).collect()]

    assert read({"strength": 0.1, "toughness": 0.2}, None, {}) == [("AC", "grounded", 0.1, 0.2)]
    with pytest.raises(Exception, match="without toughness"):
        read({"strength": 0.1, "toughness": 0.2}, {"strength": 0.3})


def test_datasets_are_read_once(spark, tmp_path):
    """The samples are a table; the file may go."""
    path = tmp_path / "d.jsonl"
    path.write_text("".join(json.dumps({"seq": "" if i % 4 == 0 else f"A{'C' * i}", "strength": 1, "toughness": i}) + "\n" for i in range(40)))
    samples, dropped = datasets.load_dataset(spark, str(path))
    path.unlink()
    assert dropped == 10 and samples.count() == 30 and samples.where("ground_truth['toughness'] = 7").first()["sequence"] == "A" + "C" * 7


def random_traces(seed):
    rng = random.Random(seed)
    return [(f"p{rng.randrange(12)}", f"k{i}", rng.choice(["grounded_correct", "shortcut_correct", "grounded_incorrect", "shortcut_incorrect"]), {"s": rng.choice([0.1, 0.2, 0.9])}) for i in range(90)]


@pytest.mark.parametrize("budget,ratio", [(4, 0.25), (2, 0.25), (6, 0.5), (1, 1.0), (0, 0.25)])
def test_pair_rules(spark, budget, ratio):
    rows = random_traces(budget)
    df = spark.createDataFrame(rows, "prompt string, key string, bucket string, final_answer map<string,double>")
    found = pairs.build_pairs(df, "prompt", "key", pairs.PairConfig(max_pairs=budget, anti_ratio=ratio, agree=pairs.same_answer(0.05)))
    bucket, prompt, answer = ({r[1]: r[i] for r in rows} for i in (2, 0, 3))
    anti = max(0, round(budget * ratio))
    by = {}
    for r in found.collect():
        assert prompt[r["chosen"]] == prompt[r["rejected"]] == r["prompt"]
        by.setdefault(r["prompt"], Counter())[r["pair_type"]] += 1
    count = Counter((r[0], r[2]) for r in rows)
    for p in {r[0] for r in rows}:
        a, b, c, d = (count[p, k] for k in ("grounded_correct", "shortcut_correct", "grounded_incorrect", "shortcut_incorrect"))
        same = sum(abs(answer[x]["s"] - answer[y]["s"]) <= 0.05 for x in bucket for y in bucket if prompt[x] == prompt[y] == p and bucket[x] == "grounded_correct" and bucket[y] == "shortcut_correct")
        anti_n = min(anti, c * d)
        left = max(0, budget - anti - same)
        standard = min(left, a * d)
        full = [("same_answer", same), ("anti_shortcut", anti_n), ("standard", standard), ("standard_fallback", min(left - standard, b * c))]
        want, room = Counter(), budget or 10**9
        for kind, n in full:
            want[kind] += min(n, room)
            room -= min(n, room)
        assert by.get(p, Counter()) == +want, p
    types, total = pairs.summarize(found)
    t = total.first()
    n = {r["pair_type"]: r["n_pairs"] for r in types.collect()}
    assert t["n_pairs"] == sum(n.values()) and abs(t["chosen_incorrect_fraction"] - (n.get("anti_shortcut", 0) / t["n_pairs"] if t["n_pairs"] else 0)) < 1e-12


def test_pairs_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(random_traces(3), "prompt string, key string, bucket string, final_answer map<string,double>")
    config = pairs.PairConfig(agree=pairs.same_answer(0.05))
    a, b = (sorted(map(tuple, pairs.build_pairs(x, "prompt", "key", config).collect())) for x in (df, df.repartition(7)))
    assert a == b


def test_traces_of_small_prompts_are_shuffled_once(spark, monkeypatch):
    """With the same pairs as where traces meet as rows."""
    df = spark.createDataFrame(random_traces(5), "prompt string, key string, bucket string, final_answer map<string,double>")
    config = pairs.PairConfig(agree=pairs.same_answer(0.05))
    found = pairs.build_pairs(df, "prompt", "key", config)
    plan = found.where("chosen is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1 and plan.count("md5(") < 20
    want = sorted(map(tuple, found.collect()))
    for small in (0, 7):
        monkeypatch.setattr(pairs, "SMALL", small)
        assert sorted(map(tuple, pairs.build_pairs(df, "prompt", "key", config).collect())) == want


@pytest.mark.parametrize("p,d", [(1, 1), (3, 5), (7, 7), (1, 40), (16, 2)])
def test_pair_numbers_are_permuted(spark, p, d):
    rows = spark.range(p * d).select(F.col("id").alias("r"), F.lit(p).cast("bigint").alias("p"), F.lit(d).cast("bigint").alias("d"))
    got = [(x["i"], x["j"]) for x in pairs.permuted(rows, F.lit("0")).orderBy("r").collect()]
    assert sorted(got) == [(i, j) for i in range(p) for j in range(d)]
    assert p * d < 10 or got != sorted(got)


def test_a_prompt_of_many_traces(spark):
    """100,000 traces of one prompt: some billion pairs of each limited type, of which none but those kept are made."""
    n = 100_000
    kinds = F.element_at(F.array(*[F.lit(b) for b in ("grounded_correct", "shortcut_correct", "grounded_incorrect", "shortcut_incorrect")]), (F.col("id") % 4 + 1).cast("int"))
    df = spark.range(n).select(F.lit("hot").alias("prompt"), F.concat(F.lit("k"), F.col("id")).alias("key"), kinds.alias("bucket"), F.create_map(F.lit("s"), F.col("id") % 4 * 1000.0 + F.col("id")).alias("final_answer"))
    began = time.monotonic()
    found = pairs.build_pairs(df, "prompt", "key", pairs.PairConfig(max_pairs=40, agree=pairs.same_answer(0.05))).collect()
    assert time.monotonic() - began < 60
    assert Counter(r["pair_type"] for r in found) == {"anti_shortcut": 10, "standard": 30}
    assert len({(r["chosen"], r["rejected"]) for r in found}) == 40 and sorted(r["pair_rank"] for r in found) == list(range(1, 41))
    assert all(int(r["chosen"][1:]) % 4 in (0, 2) and int(r["rejected"][1:]) % 4 == 3 for r in found)


def test_equal_answers_meet_by_cells(spark):
    """Values at edges of cells, of several properties, infinite, null or without any in common."""
    rng = random.Random(8)
    value = lambda: rng.choice([rng.uniform(0, 0.5), round(rng.uniform(-1, 1), 1), 1e300, float("inf"), float("nan"), None])
    rows = [("p", f"k{i}", rng.choice(["grounded_correct", "shortcut_correct"]), {k: value() for k in rng.sample("abc", rng.randint(0, 3))}) for i in range(120)]
    df = spark.createDataFrame(rows, "prompt string, key string, bucket string, final_answer map<string,double>")
    for tolerance in (0.05, 0.0):
        agree = lambda a, b, t=tolerance: bool(shared := set(a) & set(b)) and all(a[k] is not None and b[k] is not None and abs(a[k] - b[k]) <= t for k in shared)
        want = {(x[1], y[1]) for x in rows for y in rows if x[2] == "grounded_correct" and y[2] == "shortcut_correct" and agree(x[3], y[3])}
        got = pairs.build_pairs(df, "prompt", "key", pairs.PairConfig(max_pairs=0, agree=pairs.same_answer(tolerance))).collect()
        assert len(got) == len(want) and {(r["chosen"], r["rejected"]) for r in got} == want


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "d.CSV", 'Seq,FASTA,Family,strength,strength_norm,toughness\n" ACD ",GGG,"a\nb",5,0.5,0.25\n,,x,1,1,1\nKK,VVV,,,,0.1\nKK,LLL,f,9,abc,0.1\nKK,MMM,f,9,,0.1\n')
    got, dropped = datasets.load_dataset(spark, path)
    rows = {r["sequence"]: r for r in got.collect()}
    assert set(rows) == {"GGG", "VVV", "LLL", "MMM"} and dropped == 1
    assert rows["GGG"]["ground_truth"] == {"strength": 0.5, "toughness": 0.25} and rows["GGG"]["family"] == "a\nb" and rows["VVV"]["family"] == ""
    assert rows["LLL"]["ground_truth"] is None and rows["MMM"]["ground_truth"] is None  # an empty norm does not fall back
    assert datasets.with_truth(got).count() == 1


def test_json_and_jsonl(spark, tmp_path):
    for name, text in [("a.json", json.dumps([{"sequence": "AC", "category": "m"}, {"seq": "GG"}])), ("b.json", json.dumps({"data": [{"sequence": "AC", "category": "m"}, {"seq": "GG"}]})), ("c.jsonl", '{"sequence": "AC", "category": "m"}\n\n{"seq": "GG"}\n')]:
        got, dropped = datasets.load_dataset(spark, write(tmp_path / name, text))
        assert sorted((r["sequence"], r["protein_category"]) for r in got.collect()) == [("AC", "m"), ("GG", "")] and dropped == 0


def test_ragged_records(spark, tmp_path):
    rows = [{"FASTA": "AC", "family": None, "strength_norm": "", "strength": 1, "toughness": 2}, {"seq": "GG", "Sequence": "first", "toughness": "0.5", "strength": 0.25}, {"seq": None, "genus": "g"}, {"genus": 7, "seq": " K "}]
    got, dropped = datasets.load_dataset(spark, write(tmp_path / "r.jsonl", "\n".join(map(json.dumps, rows))))
    found = {r["sequence"]: r for r in got.collect()}
    assert set(found) == {"AC", "first", "K"} and dropped == 1
    assert found["AC"]["family"] == "None" and found["first"]["family"] == "" and found["K"]["genus"] == "7"
    assert found["AC"]["ground_truth"] is None and found["first"]["ground_truth"] == {"strength": 0.25, "toughness": 0.5}


def test_bad_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, write(tmp_path / "x.txt", "a"))
    with pytest.raises(Exception):  # noqa: B017
        datasets.load_dataset(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(Exception):  # noqa: B017
        datasets.load_dataset(spark, write(tmp_path / "bad.jsonl", '{"sequence": "AC"}\n{oops\n'))
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, write(tmp_path / "none.csv", "sequence,family\n,x\n"))
    assert datasets.demo(spark).count() == 2


def test_retry():
    calls, slept = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert completions.with_retry(flaky, sleep=slept.append)("p") == "ok" and slept == [2.0, 4.0]
    calls.clear()
    with pytest.raises(RuntimeError) as e:
        completions.with_retry(lambda p: 1 / 0, sleep=slept.append)("p")
    assert isinstance(e.value.__cause__, ZeroDivisionError) and slept[2:] == [2.0, 4.0, 8.0]
    with pytest.raises(completions.NotConfigured):
        completions.with_retry(completions.no_llm, sleep=slept.append)("p")
    assert len(slept) == 5


def test_errors_are_rows(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def call(p):
        if p == "bad":
            raise ValueError("odd")
        return p.upper()

    got = {r["prompt"]: (r["completion"], r["error"]) for r in completions.complete(df, "prompt", call).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "ValueError: odd")}
    with pytest.raises(Exception, match="pass a function"):
        completions.complete(df, "prompt").collect()


def test_fan_out_and_resume(spark):
    prompts = spark.createDataFrame([("a", "S1"), ("b", "S2")], "prompt_id string, sequence string")
    slots = completions.fan_out(prompts, 2, 1)
    assert slots.count() == 6 and completions.fan_out(prompts, 0, 0).count() == 0 and completions.fan_out(prompts, 0, 1).count() == 2
    errors = spark.createDataFrame([("a", "grounded", 1)], "prompt_id string, trace_kind string, k int")
    again, kept = completions.resume(slots, slots.where("not (prompt_id = 'a' and k = 1)"), errors)
    assert [(r["prompt_id"], r["k"]) for r in again.collect()] == [("a", 1)] and kept.count() == 5
    with pytest.raises(ValueError):
        completions.resume(slots, slots.withColumn("sequence", F.lit("other")), errors)


def test_pool_and_sinks(spark, tmp_path):
    truth = {"strength": 0.5, "toughness": 0.5}
    samples = spark.createDataFrame([("a", "GGAGQGG", "f", "g", "s", "c", truth), ("b", "AAAAAA", "f", "g", "s", "c", None)], "prompt_id string, sequence string, family string, genus string, species string, protein_category string, ground_truth map<string,double>")
    pool = traces.scored_pool(samples, 2, 1)
    rows = pool.collect()
    assert len(rows) == 3 and all(r["is_correct"] and r["error"] is None for r in rows) and {r["trace_kind"] for r in rows} == {"grounded", "shortcut"}
    run = traces.preference_run(pool)
    assert run["diversity"].first()["n_prompts"] == 1 and run["pairs"].count() == 0
    sinks.write_pool(str(tmp_path / "pool"), {"n_prompts": 1, "k": 2}, {"traces": run["traces"], "pairs": run["pairs"]})
    back, _ = sinks.read_pool(spark, str(tmp_path / "pool"), "traces", "pairs")
    assert back.count() == 3
    sinks.check_same_run(spark, str(tmp_path / "pool"), n_prompts=1)
    with pytest.raises(ValueError):
        sinks.check_same_run(spark, str(tmp_path / "pool"), k=3)
    claims_ = traces.grounded_claims(completions.complete(traces.with_outputs(samples, traces.tool_table(samples), "outputs", "tools").withColumn("p", traces.prompt(F.col("outputs"))), "p", completions.mock_llm), "prompt_id").withColumnRenamed("prompt_id", "trace_id")
    sinks.write_pilot(str(tmp_path / "pilot"), grounding.report(claims_, "trace_id"), claims_, spark.createDataFrame([], "trace_id string, error string"), grounding.audit(grounding.report(claims_, "trace_id")))
    assert spark.read.json(str(tmp_path / "pilot/traces")).count() == 2
    (tmp_path / "old.json").write_text(json.dumps({"scored_traces": [{"metadata": {"sequence": "AC", "trace_kind": "grounded"}, "final_answer": {"strength": 0.1, "toughness": 0.2}}, {"metadata": {"sequence": "AC", "trace_kind": "shortcut"}, "final_answer": None}]}))
    assert [tuple(r) for r in sinks.read_scored_traces(spark, str(tmp_path / "old.json")).collect()] == [("AC", "grounded", 0.1, 0.2)]
    sinks.write_comparison(str(tmp_path / "cmp"), spark.createDataFrame([("x", 0.5)], "predictor string, rho double"))
    assert spark.read.json(str(tmp_path / "cmp")).count() == 1


def test_assembled_trace(spark):
    samples = with_tools(spark.createDataFrame([("ac-d", "x <reasoning> why </reasoning> <reasoning>no</reasoning>"), ("GG", "plain")], "sequence string, completion string"), "sequence")
    got = {r["sequence"]: r["trace"] for r in traces.assemble(samples).collect()}
    assert [s["step_type"] for s in got["ac-d"]] == ["tool_call"] * 6 + ["reasoning"] and got["ac-d"][0]["sequence_length"] == 4
    assert got["ac-d"][-1]["text"] == "why" and got["GG"][-1]["text"] == "plain"


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 9.0), ("b", 1.0, 5.0), ("b", 1.0, 7.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in stats.spearman(df, "x", "y", "g").collect()}
    assert abs(got["a"] - 0.8660254037844387) < 1e-12 and got["b"] is None
    with pytest.raises(ValueError):
        stats.align(df, df, "g")


def test_audit_stream(spark, tmp_path):
    schema = f"at timestamp, t string, tools {TOOLS}"
    tools = [("t", [0.5], [], "", [])]
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "0.5 and 9.9", tools), (at(12), "0.51", tools), (at(13), "none", tools)], schema).write.parquet(str(tmp_path / "in"))
    stream = audit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "t", "at")
    q = stream.writeStream.format("memory").queryName("audited").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["window_start"].minute, r["n_claims"], r["n_ungrounded"]) for r in spark.table("audited").collect())
    assert got == [(0, 2, 1), (10, 1, 0)]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "seq_composition" in e.queries()
