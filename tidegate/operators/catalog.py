"""Catalog and control records: latest state, quotas, shares, tasks, readiness, deletes, lookups."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.classify import TERMINAL, blank_to_null, extraction_route, family_mode, file_extension, thumbnail_eligible
from tidegate.policy import EXECUTABLES, Policy, expand_types, file_types, policy_tables

TASK_KINDS = ("text", "metadata", "ocr")
DEFAULT_TASK = "image_thumbnail"


# --- lookups ---------------------------------------------------------------------


def mime_equivalent(df: DataFrame, a: str, b: str, equivalent: DataFrame, out: str = "equivalent") -> DataFrame:
    """`df` with whether columns a and b name equal or grouped MIME types; blank never does. The relation is a policy table."""
    side = F.broadcast(equivalent.select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct())
    joined = df.join(side, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    same = (F.col(a) != "") & (F.col(b) != "") & ((F.col(a) == F.col(b)) | F.col("_a").isNotNull())
    return joined.withColumn(out, F.coalesce(same, F.lit(False))).drop("_a", "_b")


def expected_mimes(df: DataFrame, name: str, expected: DataFrame, out: str = "expected") -> DataFrame:
    """`df` with the MIME types its extension stands for; an unknown extension has none, and no opinion."""
    side = F.broadcast(expected.groupBy("ext").agg(F.array_sort(F.collect_set("mime")).alias(out)))
    return df.withColumn("_ext", file_extension(F.col(name))).join(side.withColumnRenamed("ext", "_ext"), "_ext", "left").drop("_ext")


def in_list(df: DataFrame, mime: str, listed: DataFrame, equivalent: DataFrame, keep: bool) -> DataFrame:
    """Rows whose MIME type is (`keep`) or is not in a policy list, groups counting as one type."""
    wide = listed.join(F.broadcast(equivalent), listed["mime"] == equivalent["a"]).select(F.col("b").alias("mime")).union(listed.select("mime")).distinct()
    return df.join(F.broadcast(wide.withColumnRenamed("mime", "_mime")), F.col(mime) == F.col("_mime"), "left_semi" if keep else "left_anti")


def marker_scan(df: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """(row without the text, needle) for each needle in the lower-cased text; null texts hold none, and an empty needle is in every other.

    All needles are looked for in one pass over a text, by an automaton that each task builds from them: time grows with
    the texts, not with texts times needles. The needles are a policy table; some ten thousand make a few MB.
    """
    listed = sorted({r[0] for r in needles.select("needle").where("needle is not null").collect()})
    shared = df.sparkSession.sparkContext.broadcast(listed)
    names = [c for c in df.columns if c != text]

    def run(batches):
        machine, always = ahocorasick.Automaton(), [n for n in shared.value if not n]
        for n in shared.value:
            if n:
                machine.add_word(n, n)
        machine.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column("_low").to_pylist()):
                if value is None:
                    continue
                hits = sorted({n for _, n in machine.iter(value)}) if len(machine) else []
                rows += [i] * (len(hits) + len(always))
                found += always + hits
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), pa.array(found, pa.string())], [*names, "needle"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n != text), "needle string"])
    return df.withColumn("_low", F.lower(F.col(text))).drop(text).mapInArrow(run, schema)


# Script types by file type, and what each mode does to a file.
_SCRIPTS = {"sh": "shell", "py": "python", "js": "node"}
_ACTIONS = {
    "accept_as_is": "ok", "sanitize_metadata": "sanitize_metadata", "sanitize_when_supported": "sanitize_metadata", "reject": "reject", "reject_active_content": "reject_active_content",
    "reject_active_or_external_content": "reject_active_or_external_content", "reject_on_sensitive_metadata": "reject_sensitive_metadata",
}


def policy_action(policy: Policy) -> Column:
    """What becomes of files of a (file_type, mime, mode): refused as script, by the deny list or for want of a place in the allow list; else by mode."""
    mime = F.col("mime")
    allowed = expand_types(policy.allow_mime_types, policy.allow_file_types)
    denied = expand_types(policy.deny_mime_types, policy.deny_file_types)
    scripts = [t for t, kind in _SCRIPTS.items() if kind not in policy.allowed_script_types and t not in policy.allowed_script_extensions]
    by_mode = F.coalesce(*[F.when(F.col("mode") == m, a) for m, a in _ACTIONS.items()], F.when(F.col("mode") == "secure_default", F.when(mime.startswith("image/") | mime.startswith("video/"), "sanitize_metadata").otherwise("ok")), F.lit("unknown"))
    return (
        F.when(F.lit(policy.reject_scripts) & F.col("file_type").isin(*scripts), "reject_script")
        .when(mime.isin(*denied), "reject")
        .when(F.lit(bool(allowed)) & ~mime.isin(*allowed), "reject_not_allowed")
        .when(mime.isin(*EXECUTABLES), "reject")
        .when(F.lit(not policy.sanitize), "ok")
        .otherwise(by_mode)
    )


def policy_matrix(spark, policy: Policy) -> DataFrame:
    """Per file type and MIME type: resolved mode, action, whether thumbnails are made, and the way texts are extracted."""
    rows = spark.createDataFrame([(t, m) for t, mimes in file_types().items() for m in mimes], "file_type string, mime string")
    modes = policy_tables(spark, policy)["modes"]
    by_mime, by_type = modes.toDF("mime", "by_mime"), modes.select(F.ltrim("name", F.lit(".")).alias("file_type"), F.col("mode").alias("by_type")).groupBy("file_type").agg(F.max("by_type").alias("by_type"))
    rows = rows.join(F.broadcast(by_mime), "mime", "left").join(F.broadcast(by_type), "file_type", "left")
    mode = F.coalesce("by_mime", "by_type", family_mode(F.col("mime"), F.concat(F.lit("x."), "file_type"), policy))
    rows = rows.withColumn("mode", mode)
    return rows.select("file_type", "mime", "mode", policy_action(policy).alias("action"), thumbnail_eligible(F.col("mime")).alias("thumbnail"), extraction_route(F.col("mime")).alias("extraction"))


# --- state -------------------------------------------------------------------------


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. Reduced before the shuffle, so a busy key is no hot spot."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(last.alias("_last")).select(key, "_last.*").select(*events.columns)


def owner_quota(items: DataFrame, limit: int) -> DataFrame:
    """(owner, active, code): keys created or uploading per owner; at the limit the next is refused. A blank owner counts none."""
    active = F.col("status").isin("key_created", "uploading") & (F.coalesce("owner", F.lit("")) != "")
    counted = items.groupBy("owner").agg(F.count_if(active).alias("active"))
    return counted.withColumn("code", F.when(F.col("active") >= limit, "too_many_upload_keys"))


def content_digest(objects: DataFrame, content: str = "content") -> DataFrame:
    return objects.select("object_key", F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content), 256).alias("sha256"))


def best_frame(frames: DataFrame) -> DataFrame:
    """The largest frame per key, the first on ties."""
    return frames.groupBy("key").agg(F.max_by("frame", F.struct(F.col("size"), -F.col("seq"))).alias("frame"), F.max("size").alias("size"))


def token_counts(text: Column) -> dict[str, Column]:
    """Non-overlapping counts of `<`, `/type/page` and ` obj`."""
    return {"elements": F.regexp_count(text, F.lit("<")), "pages": F.regexp_count(text, F.lit("/type/page")), "objects": F.regexp_count(text, F.lit(" obj"))}


# --- requests ----------------------------------------------------------------------


def wait_uploads(requested: DataFrame, items: DataFrame) -> DataFrame:
    """Requested keys with their state, duplicates kept; an unknown key is failed, `upload key not found`."""
    joined = requested.join(items.select("upload_key", "status").withColumn("_known", F.lit(True)), "upload_key", "left")
    return joined.select(*requested.columns, F.coalesce("status", F.lit("failed")).alias("status"), F.when(F.col("_known").isNull(), "upload key not found").alias("error"))


def task_grid(keys: DataFrame, markers: DataFrame, kinds=(DEFAULT_TASK,)) -> DataFrame:
    """Every key with every kind; pending if and only if a marker exists. Blank keys are skipped."""
    wanted = [k.strip().lower() for k in kinds if k.strip()] or [DEFAULT_TASK]
    grid = keys.where(F.trim("object_key") != "").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in dict.fromkeys(wanted)])))
    found = markers.select("object_key", "kind").distinct().withColumn("_pending", F.lit(True))
    return grid.join(found, ["object_key", "kind"], "left").select(*grid.columns, F.when(F.col("_pending"), "pending").otherwise("ready").alias("status"))


def extracted_status(keys: DataFrame, markers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(object_key, status, reason): pending if any extraction task is, generated if an artifact exists, else skipped."""
    grid = task_grid(keys.select("object_key").distinct(), markers, TASK_KINDS)
    pending = grid.groupBy("object_key").agg(F.bool_or(F.col("status") == "pending").alias("pending"))
    have = artifacts.select("object_key").distinct().withColumn("_have", F.lit(True))
    status = F.when(F.col("pending"), "pending").when(F.col("_have"), "generated").otherwise("skipped")
    return pending.join(have, "object_key", "left").select("object_key", status.alias("status"), F.when(status == "skipped", "not_scheduled").alias("reason"))


def readiness(states: DataFrame, by: str, sequential: bool = False) -> DataFrame:
    """Per request: ready once every upload is terminal and, in sequential mode, no derived asset is pending."""
    done = F.col("status").isin(*TERMINAL)
    if sequential:
        done = done & ~F.coalesce(F.col("derived_pending"), F.lit(False))
    return states.groupBy(by).agg(F.bool_and(done).alias("ready"), F.count("*").alias("n_items"), F.count_if(~done).alias("n_open"))


def tasks_ready(grid: DataFrame, by: str) -> DataFrame:
    return grid.groupBy(by).agg(F.bool_and(F.col("status") != "pending").alias("ready"))


def resolve_shares(requested: DataFrame, shares: DataFrame, as_of) -> DataFrame:
    """Requested shared keys with target and error: missing, revoked, expired (or an unreadable expiry), no target."""
    now = F.lit(as_of).cast("timestamp")
    joined = requested.join(shares.withColumn("_known", F.lit(True)), "shared_key", "left")
    expiry = F.coalesce(blank_to_null(F.col("expires_at")), F.lit(None))
    late = expiry.isNotNull() & F.coalesce(F.try_to_timestamp(expiry) <= now, F.lit(True))
    error = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.coalesce("revoked", F.lit(False)), "revoked")
        .when(late, "expired")
        .when(F.coalesce("target_object_key", F.lit("")) == "", "no_target")
    )
    return joined.select(*requested.columns, F.when(error.isNull(), F.col("target_object_key")).alias("target_object_key"), error.alias("error"))


def cascade_delete(shares: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, kept) shares when objects are deleted."""
    gone = deleted.select(F.col("object_key").alias("target_object_key")).distinct()
    return shares.join(gone, "target_object_key", "left_semi"), shares.join(gone, "target_object_key", "left_anti")


def get_many(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is requested, each once, oldest first."""
    return files.join(ids.select("id").distinct(), "id", "left_semi").orderBy("created_at", "id")


def list_files(files: DataFrame) -> DataFrame:
    """Newest first, ties by id."""
    return files.orderBy(F.desc("created_at"), "id")


def first_available(*candidates: Column) -> Column:
    """The first usable candidate by preference."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def ordered_distinct(items: Column) -> Column:
    """Trimmed lower-case items without blanks, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def expand_mimes(enabled: DataFrame, types: DataFrame, expected: DataFrame) -> DataFrame:
    """Enabled MIME switches together with the MIME types of enabled file types, each once."""
    of_types = types.where("enabled").join(F.broadcast(expected), F.col("name") == F.col("ext")).select("mime")
    return enabled.where("enabled").select(F.lower(F.trim("mime")).alias("mime")).union(of_types).where("mime <> ''").distinct()


def deadline_expired(deadline: Column, as_of: Column, unreadable: bool = False) -> Column:
    """Strictly past; a blank deadline never is, and one that cannot be read is if `unreadable` says so."""
    parsed = F.try_to_timestamp(blank_to_null(deadline))
    return F.coalesce(as_of > parsed, F.lit(unreadable) & (F.coalesce(deadline, F.lit("")) != ""))


def share_expiry(explicit: Column, ttl: Column, created: Column, policy: Policy = Policy()) -> Column:
    """(expires_at, error): explicit time, else ttl seconds, else the policy's default, else none; beyond the longest ttl is an error."""
    after = lambda s: F.timestamp_seconds(F.unix_seconds(created) + s)
    default = after(F.lit(policy.share_default_seconds)) if policy.share_default_seconds > 0 else F.lit(None).cast("timestamp")
    text = blank_to_null(F.coalesce(explicit, F.lit("")))
    at = F.coalesce(F.try_to_timestamp(text), F.when(text.isNull() & (ttl > 0), after(ttl)), F.when(text.isNull(), default))
    bad = F.when(text.isNotNull() & F.try_to_timestamp(text).isNull(), "invalid_expires_at").when(text.isNotNull() & (F.try_to_timestamp(text) <= created), "invalid_expires_at")
    if policy.share_max_seconds > 0:
        limit = after(F.lit(policy.share_max_seconds))
        bad = F.coalesce(bad, F.when(at.isNull() | (at > limit), "share_ttl_too_long"))
    return F.struct(F.when(bad.isNull(), at).alias("expires_at"), bad.alias("error"))


def sweep(markers: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(expired, kept) markers: either deadline has passed, whatever the status."""
    now = F.lit(as_of).cast("timestamp")
    late = deadline_expired(F.col("upload_start_deadline"), now) | deadline_expired(F.col("upload_finish_deadline"), now)
    return markers.where(late), markers.where(~late)
