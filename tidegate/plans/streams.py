"""Streaming queries: the events table as a stream of upload events, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.plans.registry import query, table
from tidegate.policy import Policy
from tidegate.sources.work import work_path
from tidegate.streaming import lifecycle as L


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events as upload events: user as upload key, event type as action."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the table may be one file or a folder of them
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return rows.select(
        F.col("user_id").cast("string").alias("upload_key"), L.action_of(F.col("event_type")).alias("action"), (F.col("user_id") % 7).cast("string").alias("owner"),
        F.floor("value").cast("long").alias("bytes"), F.lit(1000).cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def drained(spark: SparkSession, df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What a stream gives over all input that is there, as a table with its batch number."""
    out = work_path(spark, label)
    q = L.run_available(df, lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), work_path(spark, label + "-state"), mode)
    q.awaitTermination()
    return spark.read.schema(df.withColumn("batch", F.lit(0)).schema).parquet(out)


@query("select cast(user_id as varchar) upload_key, max(cast(floor(value) as bigint)) bytes, case when bool_and(event_type <> 'purchase') then least(max(cast(floor(value) as bigint)), 980) else max(cast(floor(value) as bigint)) end shown from events group by user_id")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes so far and as shown, per upload key, folded by a stream."""
    rows = drained(spark, L.progress(event_stream(spark, sf_dir)), "progress", "update")
    return rows.groupBy("upload_key").agg(F.max_by(F.struct("bytes", "shown"), "batch").alias("last")).select("upload_key", "last.bytes", "last.shown")


#: Deadlines of the queries below: a day to start, three to finish.
DEADLINES = Policy(start_seconds=86_400, finish_seconds=259_200)
_EVENTS = """ev as (select user_id k, user_id % 7 o, event_id seq, cast(floor(value) as bigint) b, ts,
  case event_type when 'signup' then 'create' when 'view' then 'progress' when 'click' then 'upload' when 'purchase' then 'complete' when 'error' then 'fail' end a from events)"""


@query(
    f"""with recursive {_EVENTS}, numbered as (select *, row_number() over (partition by k order by ts, seq) rn from ev),
rec as (select k, cast(0 as bigint) rn, cast(null as varchar) status, cast(null as timestamp) created, cast(0 as bigint) up, cast(null as bigint) size, cast(null as varchar) error, cast(null as timestamp) ts,
    false expired, cast(0 as bigint) was_up, cast(null as bigint) was_size, cast(null as timestamp) was_created from (select distinct k from ev)
  union all select k, rn, case when ok then target else status end, case when ok and a = 'create' then ts else created end, case when ok and b is not null then greatest(up, b) else up end,
    case when ok and a = 'create' then 1000 else size end, case when ok then null when target is null then 'unknown_action' when status is null then 'upload_key_not_found' when status = 'uploaded' then 'upload_already_completed' else 'illegal_transition' end,
    ts, expired, was_up, was_size, was_created from (
    select *, case a when 'create' then 'key_created' when 'progress' then 'uploading' when 'upload' then 'uploading' when 'complete' then 'uploaded' when 'fail' then 'failed' end target,
      coalesce(case when a = 'create' then status is null when a in ('progress', 'upload') then status in ('key_created', 'uploading', 'failed') when a = 'complete' then status = 'uploading' when a = 'fail' then status in ('key_created', 'uploading') end, false) ok from (
      select k, rn, a, b, ts, was_up, was_size, was_created, gone and live expired, case when not gone then was end status, case when not gone then was_created end created, case when gone then 0 else was_up end up, case when not gone then was_size end size from (
        select e.k, e.rn, e.a, e.b, e.ts, r.status was, r.up was_up, r.size was_size, r.created was_created, coalesce(r.status in ('key_created', 'uploading', 'failed'), false) live,
          coalesce(e.ts > r.created + case when r.status in ('key_created', 'uploading', 'failed') then interval 1 day else interval 3 day end, false) gone
        from rec r join numbered e on e.k = r.k and e.rn = r.rn + 1)))),
last as (select k, max(rn) rn from rec group by k)
select cast(k as varchar) upload_key, status, up uploaded_bytes, size size_bytes, ts, error from rec where rn > 0
union all select cast(k as varchar), 'expired', was_up, was_size, was_created + interval 1 day, null from rec where expired
union all select cast(k as varchar), 'expired', up, size, created + interval 1 day, null from rec join last using (k, rn)
  where status in ('key_created', 'uploading', 'failed') and created + interval 1 day < (select max(ts) - interval 1 minute from events)"""
)
def stream_upload_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload event with the state behind it or its error, and an expiry wherever a deadline passes."""
    return drained(spark, L.upload_state(event_stream(spark, sf_dir), DEADLINES), "states").drop("batch")


@query(
    f"""with recursive {_EVENTS}, numbered as (select *, row_number() over (partition by o order by ts, seq) rn from ev),
rec as (select o, cast(0 as bigint) rn, cast([] as struct(k bigint, e timestamp)[]) active, cast(null as bigint) k, cast(null as timestamp) ts, cast(null as varchar) a, false refused from (select distinct o from ev)
  union all select o, rn, case when a = 'create' and not refused then list_append(list_filter(left_, lambda x: x.k <> k), {{'k': k, 'e': ts + interval 1 day}})
    when a in ('complete', 'fail') then list_filter(left_, lambda x: x.k <> k) else left_ end, k, ts, a, refused from (
    select *, a = 'create' and len(left_) >= 5 refused from (
      select e.o, e.rn, e.k, e.ts, e.a, case when e.a = 'create' then list_filter(r.active, lambda x: x.e >= e.ts) else r.active end left_ from rec r join numbered e on e.o = r.o and e.rn = r.rn + 1)))
select cast(o as varchar) as "owner", cast(k as varchar) upload_key, cast(len(active) as bigint) active, ts, case when refused then 'too_many_upload_keys' end code from rec where a = 'create'"""
)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key creations per owner against a quota of 5 active keys, in order of time."""
    return drained(spark, L.quota_stream(event_stream(spark, sf_dir), 5, DEADLINES), "quota").drop("batch")


@query(
    """with r as (select user_id k, case event_type when 'signup' then 'watch' when 'view' then 'unwatch' else 'update' end kind, cast(event_id % 3 as varchar) client, event_type status, ts, event_id seq from events),
each_client as (select r.*, c from r cross join (values ('0'), ('1'), ('2')) x(c)),
seen as (select *, last_value(case when kind <> 'update' and client = c then kind end ignore nulls) over so_far asked, last_value(case when kind = 'update' then status end ignore nulls) over so_far known
  from each_client window so_far as (partition by k, c order by ts, seq rows between unbounded preceding and current row))
select c client, cast(k as varchar) upload_key, case when kind = 'update' then 'update' when known is null then 'error' else 'snapshot' end "type", known status,
  case when kind = 'watch' and known is null then 'upload key not found' end message, ts, seq from seen where (kind = 'update' and asked = 'watch') or (kind = 'watch' and client = c)"""
)
def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clients watch and leave uploads while these change: a snapshot or error for each watch, each update to who watches then."""
    schema = table(spark, sf_dir, "events").schema
    kind = F.when(F.col("event_type") == "signup", "watch").when(F.col("event_type") == "view", "unwatch").otherwise("update")
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").select(
        F.col("user_id").cast("string").alias("upload_key"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("client"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq")
    )
    return drained(spark, L.watch_stream(rows, 60 * 86_400), "watch").drop("batch")


@query(
    """with r as (select user_id, event_id, case when event_type in ('signup', 'view') then 'watch' else 'unwatch' end action, user_id % 3 client, ts from events),
last as (select client, user_id, arg_max(action, (ts, event_id)) action from r group by all)
select cast(client as bigint) client, cast(user_id as varchar) upload_key, action = 'watch' watching from last"""
)
def watch_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who still watches which key, after all watch and unwatch requests."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("client"), F.col("user_id").cast("string").alias("upload_key"), F.when(F.col("event_type").isin("signup", "view"), "watch").otherwise("unwatch").alias("action"), "ts", F.col("event_id").alias("seq")
    )
    on = L.subscriptions(rows).withColumn("watching", F.lit(True))
    return rows.select("client", "upload_key").distinct().join(on, ["client", "upload_key"], "left").select("client", "upload_key", F.coalesce("watching", F.lit(False)).alias("watching"))
