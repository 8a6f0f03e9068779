"""Stored model replies: one call for each distinct prompt, also when tasks die, calls fail or runs overlap."""

import hashlib
import os

import pytest

from tidelog.operators import replies_store as S


def counting(folder):
    """A model that leaves a line for each call, from whichever process."""
    os.makedirs(folder, exist_ok=True)

    def call(text):
        with open(f"{folder}/{os.getpid()}", "a") as out:
            out.write(repr(text) + "\n")
        return f"reply to {text}"

    return call


def calls(folder):
    return sorted(line.rstrip("\n") for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


def rows_of(spark, prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id int, prompt string").repartition(3)


def test_distinct_prompts_once(spark, tmp_path):
    prompts = ["hot"] * 40 + [f"p{i}" for i in range(20)] + ["", None, None, "x" * 200_000]
    store, told = str(tmp_path / "store"), str(tmp_path / "told")
    out = S.answered(rows_of(spark, prompts), counting(told), store, "m", buckets=4, group=3)
    assert out.columns == ["id", "prompt", "raw", "seconds"]
    got = out.collect()
    assert len(got) == len(prompts)
    assert all(r["raw"] == (None if r["prompt"] is None else f"reply to {r['prompt']}") for r in got)
    assert calls(told) == sorted(repr(p) for p in set(prompts) - {None})
    # A second run that overlaps asks for the new prompts only; another model asks for all.
    again = S.answered(rows_of(spark, ["hot", "p1", "new"]), counting(told), store, "m", buckets=4).collect()
    assert {r["raw"] for r in again} == {"reply to hot", "reply to p1", "reply to new"}
    assert len(calls(told)) == len(set(prompts) - {None}) + 1
    other = str(tmp_path / "other")
    S.ask(rows_of(spark, ["hot"]), counting(other), store, "n")
    assert calls(other) == [repr("hot")]


def test_a_run_that_died_goes_on(spark, tmp_path):
    """The model takes its process's task down halfway: the next run asks only for what no file holds."""
    prompts = [f"p{i}" for i in range(40)]
    store, told, mark = str(tmp_path / "store"), str(tmp_path / "told"), str(tmp_path / "mark")
    tell = counting(told)
    halfway = sorted(prompts, key=lambda p: hashlib.sha256(p.encode()).hexdigest())[20]

    def dying(text):
        if text == halfway and not os.path.exists(mark):
            open(mark, "w").close()
            raise SystemExit("lost")
        return tell(text)

    with pytest.raises(Exception):  # noqa: B017
        S.ask(rows_of(spark, prompts), dying, store, "m", buckets=1, group=1)
    before = calls(told)
    assert len(before) == 20
    out = S.answered(rows_of(spark, prompts), dying, store, "m", buckets=1, group=1).collect()
    assert all(r["raw"] == f"reply to {r['prompt']}" for r in out)
    assert calls(told) == sorted(repr(p) for p in prompts)


def test_second_attempt_of_a_task(spark, tmp_path, monkeypatch):
    """A bucket's file that the plan did not know (it came from an attempt before this one) is not asked for again."""
    store, told = str(tmp_path / "store"), str(tmp_path / "told")
    rows = rows_of(spark, ["a", "b", "c"])
    key = rows.filter("prompt = 'a'").select(S.digest("prompt")).first()[0]
    fs, root = S._filesystem(store)
    S._put(fs, f"{root}/model=m/bucket=0", [(key, "from before", 0.0)])
    nothing = spark.createDataFrame([], "digest string, raw string, seconds double")
    with monkeypatch.context() as planned:
        planned.setattr(S, "stored", lambda *_: nothing)
        S.ask(rows, counting(told), store, "m", buckets=1)
    assert calls(told) == [repr("b"), repr("c")]
    out = {r["prompt"]: r["raw"] for r in S.answered(rows, counting(told), store, "m", buckets=1).collect()}
    assert out == {"a": "from before", "b": "reply to b", "c": "reply to c"}
    assert calls(told) == [repr("b"), repr("c")]


def test_calls_that_fail_are_asked_again(spark, tmp_path):
    store = str(tmp_path / "store")

    def failing(text):
        if text == "bad":
            raise ValueError("no")
        return None if text == "none" else ""

    rows = rows_of(spark, ["bad", "none", "good"])
    assert {r["prompt"]: r["raw"] for r in S.answered(rows, failing, store, "m").collect()} == {"bad": None, "none": None, "good": ""}
    told = str(tmp_path / "told")
    assert {r["raw"] for r in S.answered(rows, counting(told), store, "m").collect()} == {"reply to bad", "reply to none", ""}
    assert calls(told) == [repr("bad"), repr("none")]


def test_no_rows_and_clashes(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, prompt string")
    assert S.answered(empty, str, str(tmp_path / "store"), "m").collect() == []
    with pytest.raises(ValueError, match="raw"):
        S.answered(spark.createDataFrame([("a", "b")], "prompt string, raw string"), str, str(tmp_path / "store"), "m")
    with pytest.raises(ValueError, match="folder"):
        S.ask(empty, str, str(tmp_path / "store"), "a/b")
