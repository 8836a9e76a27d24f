"""Completion with a journal: no answered call is repeated."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import complete
from tessera.operators.journal import Journal


def counting(log, deadly=None):
    """Answers in upper case and notes every answered call; dies, once, at one prompt."""
    def run(prompt):
        if prompt == deadly and not os.path.exists(log + ".dead"):
            open(log + ".dead", "w").close()
            os._exit(1)  # the worker process is gone, as with a lost executor
        if prompt == "bad":
            raise ValueError("no")
        with open(log, "a") as f:
            f.write(f"{prompt}\n")
        return prompt.upper()
    return run


def test_a_task_that_dies_halfway_repeats_no_answered_call(spark, tmp_path):
    log, journal = str(tmp_path / "calls"), str(tmp_path / "journal")
    todo = spark.range(300).select(F.col("id").alias("raw"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    run = lambda: complete.journaled_complete(todo, "raw", "prompt", counting(log, "p211"), journal, 3, 1)
    with pytest.raises(Exception):
        run().toDF("k", "raw", "error").collect()
    answered = open(log).read().split()
    assert 0 < len(answered) < 300
    got = run().toDF("k", "raw", "error").collect()
    assert sorted((r["k"], r["raw"], r["error"]) for r in got) == [(i, f"P{i}", None) for i in range(300)]
    assert Counter(open(log).read().split()) == Counter(f"p{i}" for i in range(300))  # every call once, in two runs


def test_errors_and_changed_prompts_are_called_again(spark, tmp_path):
    log, journal = str(tmp_path / "calls"), str(tmp_path / "journal")

    def run(rows):
        df = spark.createDataFrame(rows, "k string, prompt string, entry int")
        return sorted(map(tuple, complete.journaled_complete(df, "k", "prompt", counting(log), journal, 2).collect()), key=str)

    rows = [("a", "x\ny", 1), ("b", "bad", 2), (None, "z", 3), ("c", "bad", 4)]
    want = [("a", "X\nY", None), ("b", None, "ValueError: no"), (None, "Z", None), ("c", None, "ValueError: no")]
    assert run(rows) == sorted(want, key=str)
    assert run(rows[:1] + [("b", "good", 2)] + rows[2:]) == sorted([want[0], ("b", "GOOD", None)] + want[2:], key=str)
    assert sorted(open(log).read().split()) == ["good", "x", "y", "z"]
    assert run([]) == []


def test_a_line_cut_off_is_left_out(tmp_path):
    folder = str(tmp_path / "part")
    with Journal(folder) as j:
        j.add("a", "one\ntwo é")
        j.add("b", None)
    (name,) = os.listdir(folder)
    with open(f"{folder}/{name}", "ab") as f:
        f.write(b'["c", "hal')
    with Journal("file:" + folder) as j:
        assert j.answers == {"a": "one\ntwo é", "b": None}
