"""Answers are committed as they come: a job that dies loses what was in flight, and no committed text is asked again."""

import os
import threading
import time

import pytest

from cohortspark.operators import records


def client_of(log, poison=None, pause=0.0):
    """A client that notes each text it is asked, with the most calls that were in flight in its process."""

    def make():
        shared = threading.__dict__.setdefault("_calls_of_test", {"lock": threading.Lock(), "now": 0, "most": 0})  # one for all threads of a worker

        def ask(texts):
            with shared["lock"]:
                shared["now"] += 1
                shared["most"] = max(shared["most"], shared["now"])
            with open(f"{log}/{os.getpid()}-{threading.get_ident()}-{time.monotonic_ns()}", "w") as f:
                f.write("\n".join([str(shared["most"]), *texts]))
            time.sleep(pause)
            with shared["lock"]:
                shared["now"] -= 1
            if poison in texts:
                os._exit(1)  # the whole worker dies
            return [None if t.endswith("7") else {"n": len(t)} for t in texts]

        return ask

    return make


def asked(log):
    out, most = [], 0
    for name in os.listdir(log):
        head, *texts = (log / name).read_text().split("\n")
        out += texts
        most = max(most, int(head))
    return out, most


def test_a_killed_job_goes_on_where_it_was(spark, tmp_path):
    texts = [f"text {i}" for i in range(300)]
    pending = spark.createDataFrame([(t,) for t in [*texts, "text 5", None]], "token string")
    folder, one, two, three = str(tmp_path / "answers"), tmp_path / "one", tmp_path / "two", tmp_path / "three"
    for d in (one, two, three):
        d.mkdir()
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of a dead worker
        records.call_committed(pending, "token", client_of(one, "text 250", 0.01), folder, parts=3, flight=2, batch=4, rounds=2)
    kept = {r["token"]: r["status"] for r in records.answered(spark, folder, "token").collect()}
    assert 0 < len(kept) < 300 and set(kept) <= set(asked(one)[0])
    got = records.call_committed(pending, "token", client_of(two, None, 0.01), folder, parts=3, flight=2, batch=4, rounds=2).collect()
    again, most = asked(two)
    called = {t for t, s in kept.items() if s == "called"}
    assert called and not called & set(again) and sorted(again) == sorted(set(texts) - called)  # each pending text once
    assert most <= 2
    assert len(got) == 302 and {r["token"] for r in got if r["status"] == "fallback"} == {t for t in texts if t.endswith("7")}
    assert {r["response"] for r in got if r["token"] == "text 5"} == {'{"n": 6}'}
    records.call_committed(pending, "token", client_of(three), folder)
    assert set(asked(three)[0]) == {t for t in texts if t.endswith("7")}


def test_repeated_answers_count_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "fallback"), ("a", "{}", "called"), ("a", "{}", "called"), ("b", None, "fallback")], "token string, response string, status string")
    rows.write.parquet(str(tmp_path / "x"))
    assert sorted((r["token"], r["response"], r["status"]) for r in records.answered(spark, str(tmp_path / "x"), "token").collect()) == [("a", "{}", "called"), ("b", None, "fallback")]
