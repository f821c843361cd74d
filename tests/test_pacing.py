"""Call times of a paced provider under a simulated clock, and rows for what failed."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import pacing


def test_turns_and_waits_of_one_lane():
    plan = pacing.Plan(budget=60, lanes=2, attempts=4, wait=5, longest=8)
    clock, sleep = pacing.simulated_time()
    lane = pacing.Lane(plan.gap, clock, sleep)
    failing = {"a": 0, "b": 2, "c": 9}
    seen = Counter()

    def call(text):
        seen[text] += 1
        if seen[text] <= failing[text]:
            raise OSError(f"no {seen[text]}")
        return {"said": text}

    told = {t: pacing.attempts_of(call, t, lane, plan) for t in ("a", "b", "c")}
    assert told["a"] == ('{"said": "a"}', None, [0.0])
    assert told["b"] == ('{"said": "b"}', None, [2.0, 7.0, 15.0])  # a turn each 2 s; waits of 5 s and 8 s (10, capped)
    assert told["c"] == (None, "OSError: no 4", [17.0, 22.0, 30.0, 38.0])


def test_a_slow_call_delays_the_next_turn_only_as_long_as_it_takes():
    clock, sleep = pacing.simulated_time()
    lane = pacing.Lane(2.0, clock, sleep)
    times = []
    for seconds in (0, 5, 0, 0):
        times.append(lane.turn())
        sleep(seconds)
    assert times == [0, 2, 7, 9]


def _call(text):
    if text is None or "bad" in text:
        raise ValueError("unreadable")
    return {"n": len(text)}


def test_no_minute_has_more_calls_than_the_budget(spark):
    rows = [(i, None if i % 50 == 0 else f"text {i}" + (" bad" if i % 7 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    plan = pacing.Plan(budget=120, lanes=6, attempts=2)
    done = pacing.called(df, "id", "text", _call, plan, pacing.simulated_time).collect()
    assert len(done) == 400 and {r.lane for r in done} == set(range(6))
    starts = defaultdict(list)
    for r in done:
        failed = r.id % 50 == 0 or r.id % 7 == 0
        assert (r.payload is None, r.attempts) == ((True, 2) if failed else (False, 1))
        assert (r.error == "ValueError: unreadable") == failed
        starts[r.lane] += r.called_at
    for times in starts.values():
        times.sort()
        assert all(b - a >= plan.gap - 1e-9 for a, b in zip(times, times[1:], strict=False))
    every = sorted(t for times in starts.values() for t in times)
    assert all(sum(a <= t < a + 60 for t in every) <= 120 + 6 for a in every)
    again = pacing.called(df.repartition(3), "id", "text", _call, plan, pacing.simulated_time)
    assert sorted(map(tuple, again.collect()), key=lambda r: r[0]) == sorted(map(tuple, done), key=lambda r: r[0])
    assert pacing.dead_letters(again).count() == sum(r.payload is None for r in done)
    assert pacing.called(df.where(F.lit(False)), "id", "text", _call, plan, pacing.simulated_time).collect() == []
