"""Completions are asked for once, though tasks fail and runs start again."""

import os
import tracemalloc
from collections import Counter
from pathlib import Path

import pytest

from loomtrace.sources import completions
from loomtrace.sources.ledger import complete_once


def counting(folder, fail=None):
    """Answers, and leaves a file for each call; ``fail`` may end the process."""

    def call(prompt):
        with open(os.path.join(folder, f"{prompt.replace(' ', '_')}-{os.getpid()}-{os.urandom(4).hex()}"), "w"):
            pass
        if fail:
            fail(prompt)
        return prompt.upper()

    return call


def calls(folder):
    return Counter(name.rpartition("-")[0].rpartition("-")[0] for name in os.listdir(folder))


def slots(spark, n):
    return spark.range(n).selectExpr("id AS slot", "concat('prompt ', id) AS prompt", "'kept' AS more")


def test_a_task_that_fails_half_way_asks_for_the_rest_only(spark, tmp_path):
    seen, ledger = tmp_path / "seen", tmp_path / "ledger"
    seen.mkdir()

    def die_at_seven(prompt):
        if prompt == "prompt 7":
            raise completions.NotConfigured("gone")

    with pytest.raises(Exception, match="gone"):
        complete_once(slots(spark, 30), "prompt", ["slot"], str(ledger), counting(seen, die_at_seven), buckets=2).collect()
    before = calls(seen)
    assert 0 < sum(before.values()) < 31
    rows = {r["slot"]: r for r in complete_once(slots(spark, 30), "prompt", ["slot"], f"file://{ledger}", counting(seen), buckets=2).collect()}
    assert len(rows) == 30 and all(r["completion"] == f"PROMPT {i}" and r["attempts"] == 1 and r["more"] == "kept" for i, r in rows.items())
    after = calls(seen)
    assert after.pop("prompt_7") == 1 + before.get("prompt_7", 0)  # it had no answer
    assert set(after.values()) == {1} and len(after) == 29
    # Finished buckets have a file each, and nothing is asked for again however slots are dealt.
    assert all(len(list(d.iterdir())) == 1 for d in Path(ledger).iterdir())
    again = complete_once(slots(spark, 30).repartition(7), "prompt", ["slot"], str(ledger), completions.no_llm, buckets=2).collect()
    assert sorted(r["completion"] for r in again) == sorted(f"PROMPT {i}" for i in range(30))


def test_an_executor_that_is_lost_half_way(spark, tmp_path):
    """The answers that stood before are kept; a partial file counts for nothing."""
    seen, ledger = tmp_path / "seen", tmp_path / "ledger"
    seen.mkdir()
    one = spark.range(12).selectExpr("id AS slot", "concat('prompt ', id) AS prompt").coalesce(1)

    def die(prompt):
        if len(os.listdir(seen)) == 6:
            os._exit(1)

    with pytest.raises(Exception):  # noqa: B017
        complete_once(one, "prompt", ["slot"], str(ledger), counting(seen, die), buckets=1).collect()
    (ledger / "bucket-00000" / "0.part").write_text("{")
    got = complete_once(one, "prompt", ["slot"], str(ledger), counting(seen), buckets=1).collect()
    assert sorted(r["completion"] for r in got) == sorted(f"PROMPT {i}" for i in range(12))
    assert sorted(calls(seen).values()) == [1] * 11 + [2]


def test_failures_and_odd_slots(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def bad(prompt):
        if prompt.startswith("bad"):
            raise ValueError("no")

    pauses = tmp_path / "pauses"
    pauses.mkdir()
    sleep = lambda s: (pauses / f"{s}-{os.urandom(3).hex()}").write_text("")
    rows = [(1, "bad one"), (2, None), (3, "good"), (3, "good"), (3, "other prompt"), (None, "good")]
    ask = lambda call: sorted((tuple(r) for r in complete_once(spark.createDataFrame(rows, "slot int, prompt string"), "prompt", ["slot"], str(tmp_path / "l"), call, retries=3, base_delay=0.5, sleep=sleep).collect()), key=repr)
    want = sorted([(1, "bad one", None, "ValueError: no", 3), (2, None, None, "no prompt", 0), (3, "good", "GOOD", None, 1), (3, "good", "GOOD", None, 1), (3, "other prompt", "OTHER PROMPT", None, 1), (None, "good", "GOOD", None, 1)], key=repr)
    assert ask(counting(seen, bad)) == want
    assert sorted(p.name.partition("-")[0] for p in pauses.iterdir()) == ["0.5", "1.0", "2.0"]
    assert calls(seen) == {"bad_one": 3, "good": 2, "other_prompt": 1}
    assert ask(completions.no_llm) == want  # all of it is in the ledger
    assert complete_once(spark.createDataFrame([], "slot int, prompt string"), "prompt", ["slot"], str(tmp_path / "none"), completions.no_llm).count() == 0


def test_a_task_holds_few_answers_however_many_its_bucket_has(spark, tmp_path):
    """60,000 answers of 1000 letters in one bucket: the worker's peak, as its last calls tell it, is that of a batch of slots. An earlier run's ledger is merged as it is read."""

    def call(prompt):
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        return f"{tracemalloc.get_traced_memory()[1]:012d}" + prompt + "-" * 1000

    many = spark.range(60000).selectExpr("id AS slot", "concat('prompt ', id) AS prompt")
    ask = lambda some, how: complete_once(some, "prompt", ["slot"], str(tmp_path / "l"), how, buckets=1, every=500)
    assert ask(many.where("slot < 20000"), call).where("attempts = 1").count() == 20000
    peak, n = ask(many, call).selectExpr("max(substring(completion, 1, 12)) AS peak", "count_if(completion LIKE '%prompt ' || slot || '---%') AS n").first()
    assert n == 60000 and int(peak) < 45_000_000
    assert len(list((tmp_path / "l" / "bucket-00000").iterdir())) == 1
    again = ask(many, completions.no_llm)
    assert again.where("completion LIKE '%prompt ' || slot || '---%'").count() == 60000


def test_each_bucket_is_a_task_of_its_own_and_no_pause_is_no_sleep(spark, tmp_path):
    """Of 16 buckets no two share a task while there are tasks for all, and a pause of 0 s calls nothing. Columns keep their types, nulls among numbers too."""
    sleeps = tmp_path / "sleeps"
    sleeps.mkdir()
    sleep = lambda s: (sleeps / os.urandom(6).hex()).write_text("")

    def bad(prompt):
        raise ValueError(prompt)

    rows = spark.range(400).selectExpr("id AS slot", "concat('prompt ', id) AS prompt", "IF(id % 2 = 0, id, NULL) AS even", "DATE'2020-02-29' AS day", "array(named_struct('x', id)) AS deep")
    done = complete_once(rows, "prompt", ["slot"], str(tmp_path / "l"), bad, base_delay=0.0, sleep=sleep, buckets=16, every=500)
    assert done.selectExpr("spark_partition_id() AS task").distinct().count() == 16
    assert not list(sleeps.iterdir())
    again = complete_once(rows, "prompt", ["slot"], str(tmp_path / "l"), completions.no_llm, buckets=16)
    assert again.where("error = 'ValueError: ' || prompt AND completion IS NULL AND attempts = 3").select(rows.columns).exceptAll(rows).count() == 0 and again.count() == 400
