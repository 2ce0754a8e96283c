"""Ranks, ledgers and breakers along an order, over several blocks, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contactmill.operators import breaker, prefix


@pytest.mark.parametrize("blocks", [None, 7])
def test_rank_and_batches_over_the_whole_table(spark, blocks):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(5)
    got = {r["id"]: r["rank"] for r in prefix.rank(df, [F.desc_nulls_last("score"), "id"], blocks=blocks).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}
    assert got == want
    batches = prefix.chunks(df, [F.desc_nulls_last("score"), "id"], 30, blocks=blocks)
    assert {r["id"]: r["batch"] for r in batches.collect()} == {i: (n - 1) // 30 for i, n in want.items()}
    assert prefix.rank(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("blocks", [None, 9])
def test_ledger_against_a_loop(spark, blocks):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 0, *range(-40, 30)]), rng.random() < 0.05) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, user string, amount long, refill boolean").repartition(4)
    balance, want = {}, {}
    for i, user, amount, refill in rows:
        left = balance.get(user, 25)
        used = 0
        if refill:
            left = max(0, amount or 0)
        elif (amount or 0) < 0:
            used = min(-amount, left)
            left -= used
        else:
            left += amount or 0
        balance[user] = left
        want[i] = (left, used)
    got = {r["id"]: (r["balance_after"], r["spent"]) for r in prefix.ledger(df, "user", "amount", ["id"], F.col("refill"), 25, blocks).collect()}
    assert got == want and min(b for b, _ in got.values()) >= 0


def _events(rng, n, hot):
    """Failures in streaks; times in seconds that repeat at places."""
    now, out = 0, []
    for i in range(n):
        now += rng.choice([0, 1, 20, 60, 200, 700]) if rng.random() < 0.9 else 5000
        out.append((i, "hot" if hot and rng.random() < 0.6 else rng.choice(["a", "b", None, "c"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now), rng.choice([True, True, True, False, None])))
    return out


def test_a_pieces_summary_is_its_fold():
    rng = random.Random(3)
    for _ in range(60):
        times, now = [], 10**9
        for _ in range(rng.randrange(1, 40)):
            now += rng.choice([0, 1, 30, 90, 300, 700]) * 10**6
            times.append(now)
        failed = [rng.random() < 0.75 for _ in times]
        table = breaker.summary(times, failed)
        states = [(r, 0, 0) for r in range(3)] + [(0, t, times[0] + w * 10**6) for t in (1, 2, 3, 4, 9) for w in (-5, 0, 40, 180, 599)]
        for s in states:
            assert breaker.apply(table, times[-1], s) == breaker.fold(times, failed, s)[1]


@pytest.mark.parametrize("blocks", [None, 8])
def test_circuits_against_a_loop(spark, blocks):
    rows = _events(random.Random(4), 900, hot=True)
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp_ntz, failed boolean").repartition(3)
    want, state = {}, {}
    for i, user, ts, failed in rows:
        found, state[user] = breaker.fold([int(ts.replace(tzinfo=dt.UTC).timestamp() * 10**6)], [bool(failed)], state.get(user, breaker.CLOSED))
        if found:
            want[i] = found[0][1:]
    got = {r["id"]: (r["state"], r["trips"]) for r in breaker.changes(df, "user", "ts", ["id"], F.col("failed"), blocks=blocks).collect()}
    assert got == want and len(want) > 100 and max(t for _, t in want.values()) >= 4
    assert breaker.changes(df.limit(0), "user", "ts", ["id"], F.col("failed")).count() == 0


def test_circuits_of_keys_without_a_change(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "quiet", at, False), (2, "once", at, True), (3, None, None, None), *[(4 + i, "hot", at + dt.timedelta(seconds=i), True) for i in range(3)]]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp_ntz, failed boolean").withColumn("kind", F.lit("k"))
    assert [tuple(r) for r in breaker.changes(df, "user", "ts", ["id"], F.col("failed")).select("id", "kind", "state", "trips").collect()] == [(6, "k", "OPEN", 1)]
    assert breaker.changes(df.where("user <> 'hot'"), "user", "ts", ["id"], F.col("failed"), blocks=3).collect() == []
