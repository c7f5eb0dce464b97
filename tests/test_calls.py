"""Model calls: window, order, retries, budget, and what an attempt that died leaves behind."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from convlytics.functions.calls import Caller, CallPolicy, Journal, in_order, local_path
from convlytics.operators.answers import call_model, evaluate_answers, staged_calls
from convlytics.session import scratch_path


def questions(spark, n, parts=1):
    return spark.range(n).select(F.concat(F.lit("q"), "id").alias("user"), F.lit("s").alias("system")).coalesce(parts)


def marking(folder, fail=None, kill=None):
    """A model that leaves a file for each call; it fails, or takes its process along, the first time at some row."""
    def model(system, user):
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "calls"), "a") as f:
            f.write(user + "\n")
        once = os.path.join(folder, "died")
        if user == (fail or kill) and not os.path.exists(once):
            time.sleep(0.5)  # the calls before it finish
            open(once, "w").close()
            if kill:
                os._exit(1)
            raise RuntimeError("no answer")
        return f"{system}:{user}"

    return model


def made(folder):
    with open(os.path.join(folder, "calls")) as f:
        return f.read().split()


def test_results_come_in_order_with_a_bounded_window():
    lock, now, most, taken = threading.Lock(), [0], [0], [0]

    def slow(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (7 - i % 8))
        with lock:
            now[0] -= 1
        return i

    def rows():
        for i in range(60):
            taken[0] = i
            yield (i,)

    got = []
    for x in in_order(slow, rows(), 5):
        assert taken[0] - len(got) <= 5
        got.append(x)
    assert got == list(range(60)) and 2 <= most[0] <= 5
    assert list(in_order(slow, rows(), 1)) == list(range(60))


def test_a_window_of_slow_calls_takes_less_time(spark):
    def slow(system, user):
        time.sleep(0.1)
        return user

    df = questions(spark, 40).cache()
    df.count()
    took = {}
    for window in (1, 8):
        t0 = time.time()
        rows = call_model(df, slow, "system", "user", policy=CallPolicy(window=window)).collect()
        took[window] = time.time() - t0
        assert [r.response for r in rows] == [r.user for r in df.collect()]
    assert took[8] < 0.5 * took[1]


def test_passing_errors_are_retried_within_the_budget():
    tries = {}

    def shaky(x):
        tries[x] = tries.get(x, 0) + 1
        if tries[x] < 3:
            raise ConnectionError(x)
        return x

    policy = CallPolicy(wait_s=0.001)
    assert [Caller(shaky, policy)(x) for x in "abc"] == list("abc") and set(tries.values()) == {3}

    def down(x):
        tries[x] = tries.get(x, 0) + 1
        raise TimeoutError(x)

    call = Caller(down, CallPolicy(wait_s=0.001, attempts=4, retry_budget=5))
    for x in "uvwxyz":
        with pytest.raises(TimeoutError):
            call(x)
    assert [tries[x] for x in "uvwxyz"] == [4, 3, 1, 1, 1, 1]  # the budget of the task is spent

    def wrong(x):
        tries[x] = tries.get(x, 0) + 1
        raise ValueError(x)

    with pytest.raises(ValueError):
        Caller(wrong, policy)("k")
    assert tries["k"] == 1


@pytest.mark.parametrize("how", ["fail", "kill"])
def test_a_killed_attempt_repeats_no_finished_call(spark, tmp_path, how):
    folder, path = str(tmp_path / "marks"), scratch_path(spark, "staged")
    model = marking(folder, **{how: "q45"})
    df = questions(spark, 60, 2)

    def calls(journal):
        return call_model(df, model, "system", "user", policy=CallPolicy(window=4), journal=journal)

    with pytest.raises(Exception):  # noqa: B017 - the worker dies
        staged_calls(calls, spark, path)
    first = made(folder)
    got = staged_calls(calls, spark, path)
    assert {r.user: r.response for r in got.collect()} == {f"q{i}": f"s:q{i}" for i in range(60)}
    again = made(folder)[len(first):]
    unfinished = set(first) & set(again)
    # what the dead attempt had in flight is asked again, what it had finished is not
    assert "q45" in unfinished and len(unfinished) <= 2 * 4
    assert len(first) > 12 and set(first) | set(again) == {f"q{i}" for i in range(60)}
    assert not os.path.exists(f"{local_path(path)}.calls")


def test_equal_questions_have_calls_of_their_own(tmp_path):
    book = Journal(str(tmp_path), 3)
    keys = [book.key("s", "u"), book.key("s", "u"), book.key("s", None), book.key(None, "s")]
    assert len(set(keys)) == 4
    book.add(keys[1], "second", 0.5)
    book.close()
    with open(os.path.join(book.folder, "torn.jsonl"), "w") as f:
        f.write('{"key": "x", "answ')
    later = Journal(str(tmp_path), 3)
    assert [later.known.get(later.key("s", "u")) is not None for _ in range(2)] == [False, True]
    later.close()


def test_paths():
    assert local_path("file:///a/b") == local_path("file:/a/b") == local_path("/a/b") == "/a/b"
    assert local_path("hdfs://n/a") is None and local_path("viewfs://s/a") is None


def test_captured_errors_are_answers(spark):
    def model(system, user):
        raise ValueError("cannot " + user)

    master = spark.createDataFrame([(1, 2.0, 3)], "escalate_conversation int, duration_minutes double, msg_count long")
    qs = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "question_id int, question string")
    rows = evaluate_answers(qs, master, model, scratch_path(spark, "answers")).collect()
    assert len(rows) == 20 and not any(r.json_valido for r in rows)
