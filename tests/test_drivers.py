"""The three runs, end to end with injected completions."""

import csv
import json
import math

import pytest

from loomtrace.operators import drivers
from loomtrace.sources import completions


def dataset(path, n=6):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["sequence", "family", "category", "strength_norm", "toughness_norm"])
        for i in range(n):
            w.writerow(["GGAGQGG" + "AP" * (i + 3), "f", "c", 0.1 * i, 0.2 if i < n - 1 else ""])
    return str(path)


def test_pilot(spark, tmp_path):
    run = drivers.run_pilot(spark, n_samples=5, output=str(tmp_path / "out"), llm=completions.mock_llm)
    assert run["audit"].first()["n_traces"] == 2 and run["worst"].count() == 2
    assert {r["kind"] for r in run["by_kind"].collect()} == {"numeric", "position", "motif"}
    assert spark.read.json(str(tmp_path / "out/traces")).count() == 2
    with pytest.raises(Exception, match="pass a function"):
        drivers.run_pilot(spark)["audit"].collect()


def test_pairs_and_resume(spark, tmp_path):
    path = dataset(tmp_path / "d.csv")

    def llm(prompt):
        if "Tool outputs" in prompt and "APAPAPAPAPAP" in prompt:
            raise OSError("busy")
        good = "Tool outputs" in prompt
        said = "A glycine-rich spacer shows." if good else "The value 98765.4 stands out."
        return f'<reasoning>{said}</reasoning><answer>{{"strength": 0.2, "toughness": 0.2}}</answer>'

    make = lambda fn, out, **more: drivers.run_pairs(spark, str(tmp_path / out), path, n_prompts=9, k_samples=2, k_shortcut_samples=1, llm=fn, max_retries=1, **more)
    first = make(llm, "one")
    pool = first["pool"].collect()
    assert len(pool) == 15 and sum(r["error"] is not None for r in pool) == 4  # two prompts, two tries each
    assert first["pairs_total"].first()["n_pairs"] > 0
    again = make(completions.mock_llm, "two", resume_from=str(tmp_path / "one"))
    rows = {r["trace_id"]: r for r in again["pool"].collect()}
    assert len(rows) == 15 and not any(r["error"] for r in rows.values())
    kept = [r for r in pool if r["error"] is None]
    assert all(rows[r["trace_id"]]["trace_text"] == r["trace_text"] for r in kept)
    with pytest.raises(ValueError):
        drivers.run_pairs(spark, str(tmp_path / "three"), path, n_prompts=2, k_samples=1, k_shortcut_samples=1, llm=completions.mock_llm, resume_from=str(tmp_path / "one"))


def test_compare(spark, tmp_path):
    seqs = ["A" * (3 + i) + "C" for i in range(12)]
    truth = [math.sin(i * 5) for i in range(12)]
    traces = [{"metadata": {"sequence": s, "trace_kind": k}, "final_answer": {"strength": t * sign, "toughness": 0.1 * i}} for i, (s, t) in enumerate(zip(seqs, truth, strict=True)) for k, sign in (("grounded", 1), ("shortcut", -1))]
    traces.append({"metadata": {"sequence": seqs[0], "trace_kind": "grounded"}, "final_answer": None})
    (tmp_path / "pool.json").write_text(json.dumps({"scored_traces": traces}))
    with open(tmp_path / "oof.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["seq", "strength", "log10_toughness", "pred_strength", "pred_log10_toughness"])
        w.writerows([[s, t, i, t / 2, -i] for i, (s, t) in enumerate(zip(seqs, truth, strict=True))])
    with open(tmp_path / "data.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["seq", "strength_norm", "toughness_norm"])
        w.writerows([[s.lower(), 0.5, 0.1 * i] for i, s in enumerate(seqs)] + [["gg", 0.3, 0.4], ["kk", 0.5, 0.6]])
    inputs = drivers.read_comparison_inputs(spark, str(tmp_path / "pool.json"), {"ridge": str(tmp_path / "oof.csv")}, str(tmp_path / "data.csv"))
    got = {(r["section"], r["label"], r["target"], r["metric"]): r["value"] for r in drivers.compare(*inputs, reps=40).collect()}
    near = lambda key, value: abs(got[key] - value) < 1e-9
    assert near(("spearman", "grounded", "strength", "rho"), 1) and near(("spearman", "shortcut", "strength", "rho"), -1) and near(("spearman", "ridge", "toughness", "rho"), -1)
    assert near(("spearman", "length", "toughness", "rho"), 1) and near(("spearman", "ridge", "strength", "n"), 12) and near(("length", "grounded", "toughness", "pred_vs_length"), 1)
    assert near(("length", "shortcut", "strength", "partial_rho"), -1) and got["spearman", "grounded", "strength", "ci_low"] > 0.99
    assert near(("absolute_error", "constant_mean", "strength", "mae"), 0.1) and near(("absolute_error", "grounded", "toughness", "mae"), 0)
    assert 0 <= got["within_tolerance", "constant_mean", "both", "share"] <= 1 and len(got) == len([k for k in got])
    twice = inputs[1]["ridge"].unionByName(inputs[1]["ridge"])
    with pytest.raises(ValueError):
        drivers.compare(inputs[0], {"ridge": twice}, inputs[2])
