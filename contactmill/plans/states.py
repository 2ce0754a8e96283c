"""Crawl state, ledgers, runs of failures, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.operators import analytics, breaker, prefix, state
from contactmill.session import new_folder
from contactmill.streaming import streams

from .base import Tables, query

AS_OF = "2024-01-30"


def _crawls(t: Tables) -> DataFrame:
    e = t.events
    last = state.latest(e, "user_id", F.desc("ts"), F.desc("event_id"))
    return last.select(F.col("user_id").alias("domain"), F.col("ts").alias("last_crawled_at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("leads_found"))


_LAST = "last as (select user_id as domain, ts, case when event_type = 'error' then 'failed' else 'completed' end as status, (props->>'$.k')::bigint as leads from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1)"


@query(f"""with {_LAST}, u as (select user_id as domain from events union select unnest(range(0, 200))), j as (select u.domain, l.ts, l.status, l.leads from u left join last l on u.domain = l.domain where l.ts is null or l.ts < timestamp '{AS_OF}' - interval 1 days)
select domain, case when status is null then 1 when status = 'failed' then 0 when leads >= 5 then 2 else 3 end::bigint as priority, coalesce(leads, 0) as leads, round(case when status is null then 0 else epoch(timestamp '{AS_OF}') - epoch(ts) end, 3) as staleness from j""")
def recrawl_priority(t: Tables) -> DataFrame:
    """All users, and the first 200 numbers, of which small tables have not seen all."""
    urls = t.events.select(F.col("user_id").cast("long").alias("domain")).union(t.spark.range(200)).distinct()
    return state.recrawl_order(urls, _crawls(t), AS_OF, 1).withColumn("staleness", F.round("staleness", 3))


@query(f"with {_LAST} select domain, status, leads as leads_found from last")
def crawl_state_upsert(t: Tables) -> DataFrame:
    """D5."""
    return _crawls(t).select("domain", "status", "leads_found")


@query("select event_id, user_id, sum(amount) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as balance_after, least(amount, 500)::bigint as spent from (select *, (round(value * 100) * case when event_type = 'purchase' then -1 else 1 end)::bigint as amount from events)")
def running_balance(t: Tables) -> DataFrame:
    """W10, in cents; `credit_ledger` spends from what is left."""
    rows = t.events.withColumn("amount", (F.round(F.col("value") * 100) * F.when(F.col("event_type") == "purchase", -1).otherwise(1)).cast("long"))
    return analytics.running_balance(rows, "user_id", "amount", "ts", "event_id").select("event_id", "user_id", "balance_after", analytics.spend(F.col("amount"), F.lit(500).cast("long")).alias("spent"))


_LEDGER = "e as (select event_id, user_id, event_type = 'signup' as refill, (round(value * 100) * case when event_type in ('purchase', 'click') then -1 else 1 end)::bigint as amount, row_number() over (partition by user_id order by ts, event_id) as n from events)"


@query(f"""with recursive {_LEDGER}, l as (select user_id, 0::bigint as n, null::bigint as event_id, 5000::bigint as balance, 0::bigint as spent from (select distinct user_id from e)
  union all select e.user_id, e.n, e.event_id, case when refill then amount when amount < 0 then balance - least(-amount, balance) else balance + amount end, case when not refill and amount < 0 then least(-amount, balance) else 0 end from l join e on e.user_id = l.user_id and e.n = l.n + 1)
select event_id, user_id, balance as balance_after, spent from l where n > 0""")
def credit_ledger(t: Tables) -> DataFrame:
    """Purchases and clicks spend at most what is left, a signup sets the balance anew; in cents, from 50.00."""
    amount = (F.round(F.col("value") * 100) * F.when(F.col("event_type").isin("purchase", "click"), -1).otherwise(1)).cast("long")
    rows = t.events.select("event_id", "user_id", "ts", "event_type", amount.alias("amount"))
    out = prefix.ledger(rows, "user_id", "amount", ["ts", "event_id"], F.col("event_type") == "signup", 5000)
    return out.select("event_id", "user_id", "balance_after", "spent")


def _circuits(types: str, columns: str) -> str:
    """Each user's circuit by recursion, event by event."""
    return f"""with recursive e as (select event_id, user_id, ts, epoch_us(ts) as us, event_type in ({types}) as bad, row_number() over (partition by user_id order by ts, event_id) as n from events),
c as (select user_id, 0::bigint as n, null::bigint as event_id, null::timestamp as ts, 0::bigint as run, 0::bigint as trips, 0::bigint as till, null::varchar as state, 0::bigint as said from (select distinct user_id from e)
  union all select user_id, n, event_id, ts, case when refused then run when not bad or opens then 0 else run + 1 end, case when refused then trips when opens then trips + 1 when not bad and probe then 0 else trips end,
    case when refused then till when opens then us + 1000000 * least({breaker.CAP}, {breaker.BASE} * 2 ** least(trips, 20))::bigint when bad then till else 0 end, case when opens then 'OPEN' when not refused and not bad and probe then 'CLOSED' end, case when opens then trips + 1 else trips end
  from (select e.user_id, e.n, e.event_id, e.ts, c.run, c.trips, c.till, us, bad, us < till as refused, till > 0 as probe, us >= till and bad and (till > 0 or run + 1 >= {breaker.LIMIT}) as opens from c join e on e.user_id = c.user_id and e.n = c.n + 1))
select {columns} from c where state is not null"""


@query(_circuits("'error', 'view', 'click'", "event_id, user_id, state, said as trips"))
def circuit_changes(t: Tables) -> DataFrame:
    """Events that open or close a user's circuit, with trips and growing waits."""
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    out = breaker.changes(e, "user_id", "ts", ["event_id"], F.col("event_type").isin("error", "view", "click"))
    return out.select("event_id", "user_id", "state", "trips")


@query("""with e as (select *, event_type in ('error', 'view') as f from events), g as (select *, sum(case when f then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as run from e)
select user_id, run, count(*) as failures, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from g where f group by user_id, run""")
def failure_runs(t: Tables) -> DataFrame:
    """Runs of failures, of one too."""
    out = state.failure_runs(t.events, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query("select event_id, coalesce(k <> lag(k) over (partition by user_id order by event_id), true) as changed from (select *, props as k from events)")
def content_changes(t: Tables) -> DataFrame:
    """R3."""
    return state.changed(t.events, "user_id", "event_id", "props").select("event_id", "changed")


@query("select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'archived' else c_mktsegment end as c_mktsegment, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then true end as opted_out from customer")
def bulk_update(t: Tables) -> DataFrame:
    """D1 to D3."""
    ids = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return state.mark(t.customer.select("c_custkey", "c_mktsegment"), ids, "c_custkey", c_mktsegment=F.lit("archived"), opted_out=F.lit(True))


@query("select o_orderkey from orders where o_orderdate < timestamp '2001-08-01' - interval 14 days or o_orderdate is null")
def needs_reverify(t: Tables) -> DataFrame:
    """D4."""
    return state.needs_check(t.orders, "o_orderdate", "2001-08-01").select("o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def delete_cascade(t: Tables) -> DataFrame:
    """What is left of the children."""
    gone = t.customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return state.delete_cascade(t.customer, t.orders, gone, "c_custkey", "o_custkey")[1].select("o_orderkey", "o_custkey")


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def idempotent_events(t: Tables) -> DataFrame:
    """D7."""
    rows = t.events.withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return state.once(rows, "key", "event_id").select("user_id", "event_type", "event_id")


#: Times that part the events into what a stream gets at once, and files of each part.
_CUTS, _FILES = ("2024-01-11", "2024-01-21"), 2
#: A user of whom there are no events; one far ahead lets the watermark pass all others.
_NOBODY = -1


def _arrive(t: Tables, path: str, end: bool = False) -> None:
    """The events as files, written one time range after another; with `end` an event of nobody after all."""
    edges = [None, *_CUTS, None]
    for lo, hi in zip(edges, edges[1:]):
        rows = t.events
        rows = rows if lo is None else rows.where(F.col("ts") >= lo)
        rows = rows if hi is None else rows.where(F.col("ts") < hi)
        rows.repartition(_FILES).write.mode("append").parquet(path)
    if end:
        t.events.groupBy().agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(*[F.col(c) if c == "ts" else F.lit(_NOBODY if c == "user_id" else None).cast(k).alias(c) for c, k in t.events.dtypes]).write.mode("append").parquet(path)


def _streamed(t: Tables, make, end: bool = False) -> DataFrame:
    folder = new_folder(t.spark, "stream")
    _arrive(t, f"{folder}/in", end)
    out = make(streams.read_events(t.spark, f"{folder}/in", _FILES))
    streams.run_once(out, folder)
    got = t.spark.read.schema(out.schema).parquet(f"{folder}/out")
    return got.where(F.col("user_id") != _NOBODY) if end else got


@query("select distinct user_id, event_type from events")
def stream_dedupe(t: Tables) -> DataFrame:
    """R1, D7 as a stream: with a lateness beyond the data's span, each key comes out once."""
    return _streamed(t, lambda e: streams.dedupe(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], late="60 days")).select("user_id", "event_type")


@query("""select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 4) as total from events
where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 day from events) group by all""")
def stream_window(t: Tables) -> DataFrame:
    """R8 as a stream: closed daily windows."""
    return _streamed(t, lambda e: streams.windowed(e, ["event_type"], "1 day")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total")


@query("select strftime(ts, '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def batch_window(t: Tables) -> DataFrame:
    """The batch twin, all windows."""
    out = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total")


@query(_circuits("'error', 'view'", "user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, state, said as trips"))
def stream_breaker(t: Tables) -> DataFrame:
    """R5 as a stream: changes of each user's circuit."""
    made = lambda e: streams.breaker(e.select("user_id", "ts", F.col("event_type").isin("error", "view").alias("failed")), "user_id", keep=90 * 86400)
    return _streamed(t, made, end=True).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "state", "trips")


@query("select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, coalesce(ts - before > interval 7 days, true) as due from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events)")
def stream_due(t: Tables) -> DataFrame:
    """R2 as a stream: events of users that were not seen for seven days."""
    return _streamed(t, lambda e: streams.due(e.select("user_id", "ts"), "user_id"), end=True).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "due")


@query("select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as ts from events group by all")
def stream_persist(t: Tables) -> DataFrame:
    """R1 as a stream: each user's first event of a kind, stored batch by batch as it is found."""
    folder = new_folder(t.spark, "stream")
    _arrive(t, f"{folder}/in")
    stream = streams.read_events(t.spark, f"{folder}/in", _FILES).select("user_id", "event_type", "ts")
    streams.run_once(stream, folder, each=streams.persist(t.spark, f"{folder}/out", ["user_id", "event_type"], "ts"))
    return streams.persisted(t.spark, f"{folder}/out").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
