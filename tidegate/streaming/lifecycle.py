"""Upload lifecycles as streams: state per key, deadlines, quotas, progress, watches, screening, derived work.

Event streams have upload_key, action (create, progress, upload, complete, fail,
cancel), owner, bytes, size and an event time `ts`. A watermark on `ts` bounds lateness. Every
state has a time at which it ends, and an event behind that time finds none, whether or not
the timer has fired: results do not hang on how events fall into batches.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegate.functions.classify import TERMINAL, displayed_bytes
from tidegate.operators.catalog import latest_state, sweep
from tidegate.operators.extract import extract
from tidegate.operators.screen import screen
from tidegate.policy import Policy
from tidegate.sources.objects import extracted_bodies
from tidegate.sources.publish import publish

STATE = "status string, created double, uploaded long, size long, owner string"
OUTPUT = "upload_key string, status string, uploaded_bytes long, size_bytes long, ts timestamp, error string"

# By action, the states it may start from and the state it leads to.
MOVES = {
    "create": ((None,), "key_created"),
    "upload": (("key_created", "uploading", "failed"), "uploading"),
    "progress": (("key_created", "uploading", "failed"), "uploading"),
    "complete": (("uploading",), "uploaded"),
    "fail": (("key_created", "uploading"), "failed"),
    "cancel": (("key_created",), "canceled"),
}


#: Rows of a key that are held at once, rows of a part of a sorted run, and runs that are merged at once.
HELD, PART, FAN = 50_000, 5_000, 16


def _spill(frames: Iterable[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Write sorted frames to a file in parts; gives them back one by one."""
    writer = None
    with pa.OSFile(path, "wb") as sink:
        for frame in frames:
            batch = pa.Table.from_pandas(frame, schema=writer and schema, preserve_index=False)
            if writer is None:
                # a column that is null so far is one of strings
                schema = pa.schema([f.with_type(pa.string()) if pa.types.is_null(f.type) else f for f in batch.schema])
                batch = batch.cast(schema)
                writer = pa.ipc.new_file(sink, schema)
            writer.write_table(batch, PART)
        writer.close()

    def parts():
        with pa.memory_map(path) as source, pa.ipc.open_file(source) as reader:
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i).to_pandas()

    return parts()


def _merged(runs: list[Iterator[pd.DataFrame]], by: list[str]) -> Iterator[pd.DataFrame]:
    """One sorted run out of several, with one part of each in memory."""
    heads: dict[int, pd.DataFrame] = {}
    open_runs = dict(enumerate(runs))
    while True:
        for i in list(open_runs):
            if i not in heads:
                part = next(open_runs[i], None)
                if part is None:
                    del open_runs[i]
                else:
                    heads[i] = part
        if not heads:
            return
        order = pd.concat([heads[i].assign(_run=i) for i in sorted(heads)]).sort_values(by, kind="stable", ignore_index=True)
        # what stands behind the first part's end may be overtaken by that run's next part
        ends = [order.index[order["_run"] == i][-1] for i in heads if i in open_runs]
        cut = min(ends, default=len(order) - 1) + 1
        rest = order[cut:]
        heads = {i: part.drop(columns="_run") for i, part in rest.groupby("_run")}
        yield order[:cut].drop(columns="_run")


def in_order(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of all batches by `by`, frame by frame: a key with more than HELD rows is sorted on disk, as runs that are merged."""
    with tempfile.TemporaryDirectory() as folder:
        levels: list[list[Iterator[pd.DataFrame]]] = [[]]
        held, n, made = [], 0, 0

        def keep(frames, level: int) -> None:
            nonlocal made
            made += 1
            if level == len(levels):
                levels.append([])
            levels[level].append(_spill(frames, f"{folder}/{made}"))
            if len(levels[level]) == FAN:
                runs, levels[level] = levels[level], []
                keep(_merged(runs, by), level + 1)

        for batch in batches:
            for lo in range(0, len(batch), PART):
                held.append(batch[lo : lo + PART])
                n += len(held[-1])
                if n >= HELD:
                    keep([pd.concat(held).sort_values(by, kind="stable")], 0)
                    held, n = [], 0
        last = [iter([pd.concat(held).sort_values(by, kind="stable")])] if held else []
        runs = [run for level in reversed(levels) for run in level] + last
        if len(runs) == 1:
            yield from runs[0]
            return
        while len(runs) > FAN:
            made += 1
            runs = [_spill(_merged(runs[:FAN], by), f"{folder}/{made}"), *runs[FAN:]]
        yield from _merged(runs, by)


def _step(status, action: str):
    """(new status, error) of an action on a status."""
    allowed, target = MOVES.get(action, ((), None))
    if target is None:
        return status, "unknown_action"
    if status in allowed:
        return target, None
    return status, {"canceled": "upload_canceled", "uploaded": "upload_already_completed", None: "upload_key_not_found"}.get(status, "illegal_transition")


#: Statuses of an upload whose deadlines still count: a failed one may be tried again until then.
LIVE = ("key_created", "uploading", "failed")


def _timed(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def upload_state(events: DataFrame, policy: Policy = Policy(), watermark: str = "1 minute") -> DataFrame:
    """Per event the upload's state behind it, or the error of an action it does not allow; and an `expired` row where a deadline passes.

    Both deadlines count from creation, whatever has begun since: a live upload (created, uploading or failed)
    expires at the earlier one. An expired upload is gone, and so is an ended one once its finish deadline is past: the
    key may be created anew. Events of a key are taken in order of time, and one at a time.
    """
    start, finish = policy.start_seconds, policy.finish_seconds
    columns = ["upload_key", "status", "uploaded_bytes", "size_bytes", "ts", "error"]

    def ends(status: str, created: float) -> float:
        return created + (min(start, finish) if status in LIVE else finish)

    def fold(key, batches, state: GroupState):
        status, created, uploaded, size, owner = state.get if state.exists else (None, None, 0, None, None)

        def ended():
            return [(key[0], "expired", uploaded, size, _timed(ends(status, created)), None)] if status in LIVE else []

        if state.hasTimedOut:
            yield pd.DataFrame(ended(), columns=columns)
            state.remove()
            return
        for frame in in_order(batches, ["ts", "seq"]):
            rows = []
            for x in frame.itertuples(index=False):
                if status is not None and x.ts.timestamp() > ends(status, created):
                    rows += ended()
                    status, created, uploaded, size, owner = None, None, 0, None, None
                status, error = _step(status, x.action)
                if error is None and x.action == "create":
                    created, owner, size = x.ts.timestamp(), x.owner, None if pd.isna(x.size) else int(x.size)
                if error is None and not pd.isna(x.bytes):
                    uploaded = max(uploaded, int(x.bytes))
                rows.append((key[0], status, uploaded, size, x.ts, error))
            yield pd.DataFrame(rows, columns=columns)
        if status is None:
            if state.exists:
                state.remove()
            return  # a key that nobody created has no state and no deadline
        state.update((status, created, uploaded, size, owner))
        state.setTimeoutTimestamp(max(int(ends(status, created) * 1000), state.getCurrentWatermarkMs() + 1))

    rows = events.select("upload_key", "action", "owner", F.col("bytes").cast("double"), F.col("size").cast("double"), F.col("ts").cast("timestamp"), "seq")
    return rows.withWatermark("ts", watermark).groupBy("upload_key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Per key the bytes so far and what is shown of them; for update mode."""
    held = ~F.col("action").isin("complete")
    rows = events.select("upload_key", F.col("bytes").cast("long").alias("bytes"), F.col("size").cast("long").alias("size"), held.alias("held"), F.col("ts").cast("timestamp").alias("ts"))
    sums = rows.withWatermark("ts", watermark).groupBy("upload_key").agg(F.max("bytes").alias("bytes"), F.max("size").alias("size"), F.bool_and("held").alias("held"))
    return sums.select("upload_key", "bytes", "size", displayed_bytes(F.col("bytes"), F.col("size"), F.col("held")).alias("shown"))


def quota_stream(events: DataFrame, limit: int, policy: Policy = Policy(), watermark: str = "1 minute") -> DataFrame:
    """Per creation: how many keys the owner has active, and a refusal at the limit; other actions free the key they end, and so do deadlines.

    What is kept of an owner is the keys that are active, `limit` at most, with the time at which each expires; an
    owner whose last key has expired has no state. Blank owners have no limit, and their keys no state.
    """
    lasts = min(policy.start_seconds, policy.finish_seconds)

    def fold(key, batches, state: GroupState):
        active = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            return
        for frame in in_order(batches, ["ts", "seq"]):
            rows = []
            for x in frame.itertuples(index=False):
                if x.action == "create":
                    now = x.ts.timestamp()
                    active = {k: end for k, end in active.items() if end >= now}
                    refused = len(active) >= limit
                    if not refused:
                        active[x.upload_key] = now + lasts
                    rows.append((key[0], x.upload_key, len(active), x.ts, "too_many_upload_keys" if refused else None))
                elif x.action in ("complete", "fail", "cancel"):
                    active.pop(x.upload_key, None)
            yield pd.DataFrame(rows, columns=["owner", "upload_key", "active", "ts", "code"])
        if active:
            state.update((list(active), list(active.values())))
            state.setTimeoutTimestamp(max(int(max(active.values()) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    rows = events.select("owner", "upload_key", "action", F.col("ts").cast("timestamp"), "seq").where("owner <> ''")
    return rows.withWatermark("ts", watermark).groupBy("owner").applyInPandasWithState(
        fold, "owner string, upload_key string, active long, ts timestamp, code string", "keys array<string>, ends array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


WATCH_OUTPUT = "client string, upload_key string, type string, status string, message string, ts timestamp, seq long"


def watch_stream(rows: DataFrame, quiet_seconds: float, watermark: str = "1 minute") -> DataFrame:
    """Messages to the clients that watch an upload, from one stream of requests and updates.

    `rows` has upload_key, kind (`watch` or `unwatch` of a `client`; `update` with a `status`), ts and seq. A watch is answered by a
    snapshot, or an error where the key had no update yet; it counts from then on all the same, once for each client. An
    update goes to every client that watches then. A key that was quiet for `quiet_seconds` has no state.
    """
    columns = ["client", "upload_key", "type", "status", "message", "ts", "seq"]

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        status, clients, last = state.get if state.exists else (None, [], None)
        clients = dict.fromkeys(clients)
        for frame in in_order(batches, ["ts", "seq"]):
            out = []
            for x in frame.itertuples(index=False):
                now = x.ts.timestamp()
                if last is not None and now > last + quiet_seconds:
                    status, clients = None, {}
                last = now
                if x.kind == "watch":
                    clients[x.client] = None
                    known = status is not None
                    out.append((x.client, key[0], "snapshot" if known else "error", status, None if known else "upload key not found", x.ts, x.seq))
                elif x.kind == "unwatch":
                    clients.pop(x.client, None)
                elif x.kind == "update":
                    status = x.status
                    out += [(c, key[0], "update", status, None, x.ts, x.seq) for c in clients]
            yield pd.DataFrame(out, columns=columns)
        if last is not None:
            state.update((status, list(clients), last))
            state.setTimeoutTimestamp(max(int((last + quiet_seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    rows = rows.select("upload_key", "kind", "client", "status", F.col("ts").cast("timestamp"), F.col("seq").cast("long"))
    return rows.withWatermark("ts", watermark).groupBy("upload_key").applyInPandasWithState(
        fold, WATCH_OUTPUT, "status string, clients array<string>, last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def subscriptions(requests: DataFrame) -> DataFrame:
    """Who watches what: the last of watch and unwatch per (client, key). A second watch is not counted twice."""
    return latest_state(requests.withColumn("pair", F.struct("client", "upload_key")), "pair", ["ts", "seq"]).where("action = 'watch'").select("client", "upload_key")


def watch_messages(requests: DataFrame, items: DataFrame, updates: DataFrame) -> DataFrame:
    """Messages of one batch: a snapshot for each watch request (an error for an unknown key), then updates to the watching clients."""
    asked = requests.where("action = 'watch'").select("client", "upload_key").join(items.select("upload_key", "status").withColumn("known", F.lit(True)), "upload_key", "left")
    snapshot = asked.select("client", "upload_key", F.when(F.col("known"), "snapshot").otherwise("error").alias("type"), "status", F.when(F.col("known").isNull(), "upload key not found").alias("message"))
    sent = updates.join(subscriptions(requests), "upload_key").select("client", "upload_key", F.lit("update").alias("type"), "status", F.lit(None).cast("string").alias("message"))
    return snapshot.unionAll(sent)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None):
    """Start a query that hands each batch to `each`: once over what is there, or `every` so often."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def screen_stream(spark: SparkSession, path: str, accepted: str, quarantine: str, checkpoint: str, policy: Policy = Policy(), every: str | None = None):
    """Screen new files as they come: accepted ones to one place, the rest to quarantine with their code."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    objects = files.select(F.col("path").alias("object_key"), F.regexp_extract("path", "([^/]*)$", 1).alias("original_name"), F.lit("").alias("declared_type"), "content")

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.join(screen(batch, policy).drop("original_name", "declared_type"), "object_key").persist()
        try:
            publish(number, {accepted: rows.where("verdict is null").drop("verdict"), quarantine: rows.where("verdict is not null")}, f"{checkpoint}/published")
        finally:
            rows.unpersist()

    return run_available(objects, each, checkpoint, every=every)


def derive_stream(accepted: DataFrame, artifacts: str, tasks: str, checkpoint: str, policy: Policy = Policy(), every: str | None = None):
    """Extract text of accepted objects as they come; a task row says what is pending and, behind it, what is done."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("content_type", F.col("detected"))
        mark = lambda status: rows.select("object_key", F.lit("text").alias("kind"), F.lit(status).alias("status"), F.lit(number).alias("batch"))
        # what is pending shows at once; texts and what is done show together
        publish(number, {f"{tasks}/pending": mark("pending")})
        texts = extracted_bodies(extract(rows.select("object_key", "content_type", "content"), policy), policy)
        publish(number, {artifacts: texts, f"{tasks}/done": mark("done")}, f"{checkpoint}/published")

    return run_available(accepted, each, checkpoint, every=every)


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that have not been done: an anti-join, as presence means pending."""
    done = tasks.where("status = 'done'").select("object_key", "kind", "batch")
    return tasks.where("status = 'pending'").join(done, ["object_key", "kind", "batch"], "left_anti")


def sweep_stream(spark: SparkSession, markers: Callable[[], DataFrame], each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"):
    """Look through the upload markers every so often, and hand those whose deadline has passed to `each`.

    A clock stream gives the beat; `markers` reads the records anew each time, so what was deleted since is not
    seen again. A look that fails is taken again with the same number.
    """
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def look(ticks: DataFrame, number: int) -> None:
        now = ticks.agg(F.max("timestamp")).first()[0]
        if now is not None:
            each(sweep(markers(), now)[0], number)

    return beat.writeStream.option("checkpointLocation", checkpoint).foreachBatch(look).trigger(processingTime=every).start()


def action_of(event_type: Column) -> Column:
    """Lifecycle actions of a click stream's event types."""
    names = {"signup": "create", "view": "progress", "click": "upload", "purchase": "complete", "error": "fail"}
    return F.coalesce(*[F.when(event_type == k, v) for k, v in names.items()])
