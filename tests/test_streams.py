"""Streams against plain loops over the same events, whatever the batches."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contactmill.plans import catalogue
from contactmill.session import new_folder
from contactmill.streaming import streams


def test_breaker_against_a_plain_loop(spark, sf):
    by_user = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").collect():
        by_user[r["user_id"]].append((r["ts"].timestamp(), r["event_type"] in ("error", "view")))
    want = []
    for user, events in by_user.items():
        run = trips = 0
        until = None
        for at, failed in events:
            if until is not None and at < until:
                continue
            if failed:
                run += 1
                if until is not None or run >= 3:
                    until, trips, run = at + min(600, 90 * 2**trips), trips + 1, 0
                    want.append((user, "OPEN", trips))
            elif until is not None:
                want.append((user, "CLOSED", trips))
                until, trips, run = None, 0, 0
            else:
                run = 0
    got = [(r["user_id"], r["state"], r["trips"]) for r in catalogue.QUERIES["stream_breaker"](spark, sf).collect()]
    assert want and sorted(got) == sorted(want)


def _rows(seed, n=240):
    """Events of a few keys over twelve days, more than a day of silence after one week."""
    rng = random.Random(seed)
    now, out = dt.datetime(2024, 1, 1), []
    for i in range(n):
        now += dt.timedelta(seconds=rng.choice([1, 30, 100, 400, 3000]), microseconds=i)
        if i == n // 2:
            now += dt.timedelta(days=8)
        out.append((rng.randrange(4), now, rng.random() < 0.7))
    return out, now


@pytest.mark.parametrize("name", ["breaker", "due"])
def test_the_same_rows_whatever_the_batching(spark, name):
    """Files of random events, none later than the lateness allows, in one batch or in many: the rows of a loop in order."""
    rows, last = _rows(5)
    rows.append((99, last + dt.timedelta(days=30), False))
    want = []
    for key in range(4):
        events = [(at, bad) for k, at, bad in rows if k == key]
        if name == "due":
            want += [(key, at, b is None or at - b > dt.timedelta(days=7)) for (at, _), b in zip(events, [None, *[at for at, _ in events]])]
        else:
            run, trips, until = 0, 0, None
            for at, bad in events:
                if until is not None and at < until:
                    continue
                if bad:
                    run += 1
                    if until is not None or run >= 3:
                        until, trips, run = at + dt.timedelta(seconds=min(600, 90 * 2**trips)), trips + 1, 0
                        want.append((key, at, "OPEN", trips))
                else:
                    if until is not None:
                        want.append((key, at, "CLOSED", trips))
                        trips = 0
                    run, until = 0, None
    make = {"breaker": lambda e: streams.breaker(e, "key", keep=90 * 86400, late="20 days"), "due": lambda e: streams.due(e, "key", late="20 days")}[name]
    for files, per in ((1, 1), (4, 1)):
        folder = new_folder(spark, "stream-test")
        dealt = rows[:-1]
        random.Random(files).shuffle(dealt)
        for i in range(files):
            spark.createDataFrame(dealt[i::files], "key long, ts timestamp_ntz, failed boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame(rows[-1:], "key long, ts timestamp_ntz, failed boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = make(streams.read_events(spark, f"{folder}/in", per))
        streams.run_once(out, folder)
        got = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").where("key < 99").withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]
        assert len(want) > 20 and sorted(got) == sorted(want), (name, files)


def test_keys_are_stored_once_and_read_by_part(spark):
    path = new_folder(spark, "keys")
    store = streams.persist(spark, path, ["k"], "ts", parts=8)
    batches = [[(1, 5), (2, 6), (1, 4)], [(2, 1), (3, 7)], [(2, 1), (3, 7)], []]
    for n, rows in enumerate(batches):
        store(spark.createDataFrame(rows, "k long, ts long"), n)
    assert sorted(tuple(r) for r in streams.persisted(spark, path).collect()) == [(1, 4), (2, 6), (3, 7)]


def test_formats_read_each_file_once(spark, tmp_path):
    """A stream that is started again takes only what has come since; batch and stream give the same rows."""
    from contactmill.sources import formats

    formats.register(spark)
    folder, out = tmp_path / "in", new_folder(spark, "format-test")
    folder.mkdir()
    line = lambda i: f"{'Fund ' + str(i):<62}D   {i:08d}  2024-01-0{i % 9 + 1}  f/{i}.txt\n"
    for n in range(3):
        (folder / f"{n}.idx").write_text("".join(line(10 * n + i) for i in range(5)) + "noise\n")
        (folder / "_hidden").write_text(line(99))
        streams.run_once(spark.readStream.format("filing_index").option("path", str(folder)).load(), out)
        got = [r["cik"] for r in spark.read.parquet(f"{out}/out").collect()]
        assert sorted(map(int, got)) == [10 * k + i for k in range(n + 1) for i in range(5)]
    batch = spark.read.format("filing_index").option("path", str(folder)).load()
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, spark.read.parquet(f"{out}/out").collect()))
    assert batch.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no adapter"):
        spark.read.format("adapter_cards").option("path", str(folder)).option("adapter", "x").load().count()
