"""W12, R5 in batch: each key's circuit over stored events.

`limit` failures in a row open a circuit for base * 2^trips seconds, `cap` at most; events before that are refused. The first one
after it closes the circuit, and forgets its trips, or opens it again. That is a fold over ordered events, so events are
sorted into blocks (`prefix.ordered`) and a key that lies in one block is folded there. What a block does to a key that goes on
into another block is a function of the state before it, and functions compose: of such a piece, one of at most two a block,
the end is computed for every state that can come in, the pieces' functions are applied one after another, and then
all pieces are folded at once, each from its own state.

A state is the failures in a row if the circuit is closed (fewer than `limit`), else its trips and the time it stays open until. An
open circuit meets a piece only by the event that probes it, and that is one of those within `cap` seconds of
the piece's first one, or the next, or outside the piece; from some number of trips on all wait equally long. So the function is a short table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import prefix

LIMIT, BASE, CAP = 3, 90, 600
_SECOND = 1_000_000
State = tuple[int, int, int]  # failures in a row, trips, microsecond until which it is open (0: closed)
CLOSED: State = (0, 0, 0)


def wait(trips: int, base: int = BASE, cap: int = CAP) -> int:
    """Microseconds that a circuit stays open when it opens after `trips` trips."""
    return int(min(cap, base * 2 ** min(trips, 60)) * _SECOND)


def fold(times, failed, state: State, limit: int = LIMIT, base: int = BASE, cap: int = CAP) -> tuple[list[tuple[int, str, int]], State]:
    """Changes (place of the event, OPEN or CLOSED, trips) of one circuit over ordered events, and its state after them."""
    run, trips, until = state
    out = []
    for i, (at, bad) in enumerate(zip(times, failed, strict=True)):
        if at < until:
            continue
        probe = until > 0
        if bad:
            run += 1
            if probe or run >= limit:
                until, trips, run = at + wait(trips, base, cap), trips + 1, 0
                out.append((i, "OPEN", trips))
        else:
            if probe:
                out.append((i, "CLOSED", trips))
                trips = 0
            run, until = 0, 0
    return out, (run, trips, until)


def _levels(base: int, cap: int) -> int:
    """Trips from which on every wait is the longest."""
    n = 0
    while wait(n, base, cap) < cap * _SECOND:
        n += 1
    return n


def summary(times: list[int], failed: list[bool], limit: int = LIMIT, base: int = BASE, cap: int = CAP) -> list[tuple]:
    """The state after a piece for every state before it, from the last event back.

    Rows (kind, entry, level, run, trips, until, fresh): kind "closed" with `entry` failures in a row, or "open" with the time
    of the probing event as `entry` and `level` trips; `fresh` tells that the circuit was closed on the way, else `trips`
    counts on from the trips before."""
    n, top = len(times), _levels(base, cap)
    at = np.asarray(times, np.int64)
    # ends[i][r]: from a closed circuit with r failures before event i; probes[i][t]: event i probes after t trips.
    ends: list[list[tuple]] = [[]] * (n + 1)
    probes: list[list[tuple]] = [[]] * n
    ends[n] = [(r, 0, 0, True) for r in range(limit)]

    def opened(i: int, trips: int, fresh: bool) -> tuple:
        """After event i has opened the circuit for the time that `trips` earlier trips ask for; trips count from before i."""
        until = int(at[i]) + wait(trips, base, cap)
        j = int(np.searchsorted(at, until, "left"))
        if j >= n:
            return (0, 1, until, fresh)
        run, more, end, closed = probes[j][min(trips + 1, top)]
        return (run, more if closed else more + 1, end, fresh or closed)

    for i in range(n - 1, -1, -1):
        if failed[i]:
            probes[i] = [opened(i, t, False) for t in range(top + 1)]
            first = opened(i, 0, True)
            ends[i] = [ends[i + 1][r + 1] if r + 1 < limit else first for r in range(limit)]
        else:
            probes[i] = [ends[i + 1][0]] * (top + 1)
            ends[i] = [ends[i + 1][0]] * limit
    rows = [("closed", r, 0, *ends[0][r]) for r in range(limit)]
    for i in range(n):
        if i == 0 or at[i] > at[i - 1]:
            rows += [("open", int(at[i]), t, *probes[i][t]) for t in range(top + 1)]
        if at[i] - at[0] >= cap * _SECOND:
            break
    return rows


def apply(rows: list[tuple], last: int, state: State, base: int = BASE, cap: int = CAP) -> State:
    """The state after a piece whose `summary` and last event's time are given."""
    run, trips, until = state
    if until == 0:
        r = next(x for x in rows if x[0] == "closed" and x[1] == run)
        return (r[3], r[4], r[5])
    if until > last:
        return state
    level = min(trips, _levels(base, cap))
    r = min((x for x in rows if x[0] == "open" and x[1] >= until and x[2] == level), key=lambda x: x[1])
    return (r[3], r[4] if r[6] else trips + r[4], r[5])


def changes(events: DataFrame, key: str, at: str, order: list[str], failed: Column, limit: int = LIMIT, base: int = BASE, cap: int = CAP, blocks: int | None = None) -> DataFrame:
    """Every event that opens or closes its key's circuit, with `state` (OPEN or CLOSED) and `trips` so far, the
    one that closes it included. `order` makes the
    times `at` total. Null times come first and count as the beginning of time; a null failure counts as none."""
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0))
    rows = prefix.ordered(events.select("*", micros.alias("_us"), F.coalesce(failed, F.lit(False)).alias("_bad")), [key, "_us", *order], blocks)
    # Two keys of a block at most go on into another; only those have more than one row here.
    ends = rows.groupBy("_block").agg(F.min_by(F.struct(key), "_at").alias("a"), F.max_by(F.struct(key), "_at").alias("z"))
    edges = ends.select("_block", F.explode(F.array_distinct(F.array("a", "z"))).alias("k")).select("_block", F.col(f"k.{key}").alias("_key"))
    many = edges.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_key").alias("_many"))
    pieces = edges.join(F.broadcast(many), F.col("_key").eqNullSafe(F.col("_many")), "left_semi")
    entered = _entries(rows, pieces, key, limit, base, cap)
    rows = rows.join(F.broadcast(entered), (F.col("_block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_b", "_key")
    names = [*events.columns, "state", "trips"]
    schema = T.StructType([*events.schema.fields, T.StructField("state", T.StringType()), T.StructField("trips", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at", ignore_index=True)
        first = frame.iloc[0]
        state = CLOSED if pd.isna(first["_run"]) else (int(first["_run"]), int(first["_trips"]), int(first["_until"]))
        found, _ = fold(frame["_us"].tolist(), frame["_bad"].tolist(), state, limit, base, cap)
        out = frame.iloc[[i for i, _, _ in found]].copy()
        # With their types: of a group without changes, pandas would make numbers of the states.
        out["state"], out["trips"] = pd.Series([s for _, s, _ in found], out.index, object), pd.Series([t for _, _, t in found], out.index, "int64")
        return out[names]

    return rows.groupBy("_block", key).applyInPandas(run, schema)


def _entries(rows: DataFrame, pieces: DataFrame, key: str, limit: int, base: int, cap: int) -> DataFrame:
    """(_b, _key, _run, _trips, _until) of the pieces of keys that lie in several blocks: their state before each."""
    mine = rows.select("_block", F.col(key).alias("_k"), "_at", "_us", "_bad").join(F.broadcast(pieces.withColumnRenamed("_block", "_b")), (F.col("_block") == F.col("_b")) & F.col("_k").eqNullSafe(F.col("_key")), "left_semi")
    kind = rows.schema[key].dataType.simpleString()

    def summed(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at")
        times = frame["_us"].tolist()
        out = pd.DataFrame(summary(times, frame["_bad"].tolist(), limit, base, cap), columns=["kind", "entry", "level", "run", "trips", "until", "fresh"])
        return out.assign(_b=group[0], _key=frame["_k"].iloc[0], last=times[-1])

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = CLOSED, []
        for block, piece in frame.groupby("_b", sort=True):
            out.append((block, piece["_key"].iloc[0], *state))
            table = list(piece[["kind", "entry", "level", "run", "trips", "until", "fresh"]].itertuples(index=False, name=None))
            state = apply(table, int(piece["last"].iloc[0]), state, base, cap)
        return pd.DataFrame(out, columns=["_b", "_key", "_run", "_trips", "_until"])

    tables = mine.groupBy("_block", "_k").applyInPandas(summed, f"_b long, _key {kind}, kind string, entry long, level long, run long, trips long, until long, fresh boolean, last long")
    return tables.groupBy("_key").applyInPandas(composed, f"_b long, _key {kind}, _run long, _trips long, _until long")

