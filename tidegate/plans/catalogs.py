"""Catalog queries: orders as uploads, events as their history, labels as shares and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.classify import file_extension
from tidegate.operators import catalog as K
from tidegate.plans.registry import query, sql_in, sql_list, table
from tidegate.plans.screening import UPLOADS_SQL, uploads
from tidegate.policy import EXECUTABLES, Policy, file_types, policy_tables
from tidegate.sources.objects import object_heads, object_ranges, parse_control_records, scan_objects
from tidegate.sources.work import work_path

AS_OF = "1996-06-01 00:00:00"
_STATUS = "case o_orderstatus when 'P' then 'key_created' when 'O' then 'uploading' else 'uploaded' end"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upload items."""
    status = F.when(F.col("o_orderstatus") == "P", "key_created").when(F.col("o_orderstatus") == "O", "uploading").otherwise("uploaded")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_key"), F.col("o_custkey").cast("string").alias("owner"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query(f"select cast(o_custkey as varchar) as owner, count(*) filter (where {_STATUS} <> 'uploaded') active, case when count(*) filter (where {_STATUS} <> 'uploaded') >= 10 then 'too_many_upload_keys' end code from orders group by o_custkey")
def quota_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active upload keys per owner against a quota of 10."""
    return K.owner_quota(items(spark, sf_dir), 10)


@query("select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type from events group by user_id")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: last write wins."""
    return K.latest_state(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select doc_id, strlen(text) size, sha256(text) sha256 from documents where text is not null")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of every document's bytes."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("object_key"), F.encode("text", "UTF-8").alias("content"))
    return K.content_digest(rows).withColumnRenamed("object_key", "doc_id")


@query("select l_orderkey as key, arg_max(l_linenumber * 1000000 + l_partkey, (cast(floor(l_extendedprice) as bigint), -(l_linenumber * 1000000 + l_partkey))) frame, cast(max(floor(l_extendedprice)) as bigint) size from lineitem group by l_orderkey")
def best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest line of each order as its best frame, the first on ties."""
    seq = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    return K.best_frame(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), seq.alias("frame"), seq.alias("seq"), F.floor("l_extendedprice").cast("long").alias("size")))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    expires = F.when(F.col("doc_id") % 5 == 0, "1990-01-01T00:00:00Z").when(F.col("doc_id") % 5 == 1, "2030-01-01T00:00:00Z").when(F.col("doc_id") % 5 == 2, "soon").otherwise("")
    return labels.select(F.col("doc_id").alias("shared_key"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("target_object_key"), expires.alias("expires_at"), (F.col("toxic") == 1).alias("revoked"))


@query(
    """select d.doc_id shared_key, case when l.doc_id is not null and l.toxic <> 1 and l.doc_id % 5 not in (0, 2) and l.doc_id % 11 <> 0 then 'doc/' || d.doc_id end target_object_key,
  case when l.doc_id is null then 'not_found' when l.toxic = 1 then 'revoked' when l.doc_id % 5 in (0, 2) then 'expired' when l.doc_id % 11 = 0 then 'no_target' end error
  from documents d left join labels l using (doc_id)"""
)
def shares_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shared key resolved: missing, revoked, expired, without target, or found."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("shared_key"))
    return K.resolve_shares(asked, shares(spark, sf_dir), AS_OF)


@query("select l.doc_id shared_key, l.doc_id % 11 <> 0 and d.lang = 'fr' removed from labels l join documents d using (doc_id)")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shares go when all French documents are deleted."""
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("object_key"))
    removed, kept = K.cascade_delete(shares(spark, sf_dir), gone)
    return removed.select("shared_key", F.lit(True).alias("removed")).unionAll(kept.select("shared_key", F.lit(False).alias("removed")))


@query(
    f"""select k upload_key, pos, case when o_orderkey is null then 'failed' else {_STATUS} end status, case when o_orderkey is null then 'upload key not found' end as "error"
  from (select l_orderkey + case when l_linenumber = 3 then 100000000 else 0 end k, l_linenumber pos from lineitem) left join orders on k = o_orderkey"""
)
def uploads_waited_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested keys with duplicates kept; unknown ones have failed."""
    key = F.col("l_orderkey") + F.when(F.col("l_linenumber") == 3, 100000000).otherwise(0)
    asked = table(spark, sf_dir, "lineitem").select(key.alias("upload_key"), F.col("l_linenumber").alias("pos"))
    return K.wait_uploads(asked, items(spark, sf_dir))


@query(f"select cast(o_custkey as varchar) as owner, bool_and({_STATUS} = 'uploaded') ready, count(*) n_items, count(*) filter (where {_STATUS} <> 'uploaded') n_open from orders group by o_custkey")
def readiness_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of an owner's uploads have come to an end."""
    return K.readiness(items(spark, sf_dir), "owner")


_GRID = """grid as (select d.doc_id object_key, kind, case when l.doc_id is not null and kind = case when l.quality = 1 then 'text' else 'metadata' end then 'pending' else 'ready' end status
  from documents d cross join (select unnest(['text', 'metadata', 'ocr']) kind) left join labels l using (doc_id))"""


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("object_key"), F.when(F.col("quality") == 1, "text").otherwise("metadata").alias("kind"))


@query(f"with {_GRID} select object_key, kind, status from grid")
def task_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every kind of work: pending where a marker exists."""
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_key"))
    return K.task_grid(keys, _markers(spark, sf_dir), K.TASK_KINDS)


@query(f"with {_GRID} select object_key, bool_and(status <> 'pending') ready from grid group by object_key")
def tasks_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_key"))
    return K.tasks_ready(K.task_grid(keys, _markers(spark, sf_dir), K.TASK_KINDS), "object_key")


@query(
    f"""with {_GRID}, p as (select object_key, bool_or(status = 'pending') pending from grid group by object_key)
select object_key, case when pending then 'pending' when object_key % 4 = 0 then 'generated' else 'skipped' end status, case when not pending and object_key % 4 <> 0 then 'not_scheduled' end reason from p"""
)
def extraction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's text is pending, there, or was never asked for."""
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_key"))
    return K.extracted_status(keys, _markers(spark, sf_dir), keys.where("object_key % 4 = 0"))


@query("select o_orderkey id, cast(floor(o_totalprice) as bigint) size from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def files_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is asked for, repeated requests counting once."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("created_at"))
    return K.get_many(files, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))).select("id", "size")


@query("select o_orderkey id, row_number() over (order by o_orderdate desc, o_orderkey) pos from orders qualify pos <= 100")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest files, a top list."""
    from pyspark.sql.window import Window

    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    top = K.list_files(files).limit(100)  # a hundred rows from here on
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long").alias("pos"))


_DENIED = sorted(EXECUTABLES)


@query(f"with {UPLOADS_SQL} select object_key, declared, declared in {sql_in(_DENIED)} denied, declared in ('text/xml', 'application/xml', 'text/plain', 'image/jpeg', 'image/pjpeg') allowed from typed")
def lists_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow and deny lists as semi-joins, with groups of equal types."""
    from tidegate.functions.classify import normalize_mime

    tables = policy_tables(spark, Policy(allow_mime_types=("text/xml", "text/plain", "image/pjpeg")))
    rows = uploads(spark, sf_dir).select("object_key", normalize_mime(F.col("declared_type")).alias("declared"))
    flag = lambda listed, name: K.in_list(rows, "declared", listed, tables["equivalent"], True).select("object_key", F.lit(True).alias(name))
    out = rows.join(flag(tables["denied"], "denied"), "object_key", "left").join(flag(tables["allowed"], "allowed"), "object_key", "left")
    return out.select("object_key", "declared", F.coalesce("denied", F.lit(False)).alias("denied"), F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query(f"with {UPLOADS_SQL} select declared, count(*) n, declared <> '' and (declared = 'text/xml' or declared in ('application/xml')) equivalent from typed group by declared")
def equivalence_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which declared types equal `text/xml`, by join with the pairs of the policy."""
    from tidegate.functions.classify import normalize_mime

    counts = uploads(spark, sf_dir).groupBy(normalize_mime(F.col("declared_type")).alias("declared")).agg(F.count("*").alias("n")).withColumn("other", F.lit("text/xml"))
    return K.mime_equivalent(counts, "declared", "other", policy_tables(spark, Policy())["equivalent"]).drop("other")


_TYPE_COUNTS = {t: len(m) for t, m in file_types().items() if t in ("png", "jpeg", "pdf", "txt", "html")}


@query(f"select lang, len(list_distinct([{', '.join(repr(m) for m in dict.fromkeys(m for t in _TYPE_COUNTS for m in file_types()[t]))}])) n_types, count(*) n from documents where lang is not null group by lang")
def expanded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME switches with those of enabled file types, held against the documents of each language."""
    enabled = spark.createDataFrame([("image/png", True), (" Text/Plain ", True), ("image/gif", False)], "mime string, enabled boolean")
    types = spark.createDataFrame([(t, True) for t in _TYPE_COUNTS] + [("zip", False)], "name string, enabled boolean")
    wide = K.expand_mimes(enabled, types, policy_tables(spark, Policy())["expected"]).agg(F.count("*").alias("n_types"))
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(wide)).select("lang", "n_types", "n")


@query(f"with {UPLOADS_SQL} select ext file_type, count(*) n from typed where ext in {sql_in(['txt', 'jpg', 'md', 'csv', 'html', 'pdf'])} group by ext")
def uploads_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of every file type of the policy matrix that has a resolved mode."""
    matrix = K.policy_matrix(spark, Policy()).where("mode is not null and action <> ''").select("file_type").distinct()
    rows = uploads(spark, sf_dir).groupBy(file_extension(F.col("original_name")).alias("file_type")).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(matrix), "file_type", "left_semi")


@query(
    f"""with {UPLOADS_SQL} select object_key, case ext when 'csv' then 'reject' when 'md' then 'ok' when 'html' then 'reject_active_or_external_content' when 'pdf' then 'sanitize_metadata'
  when 'jpg' then 'sanitize_metadata' when 'txt' then 'ok' end action, ext in ('jpg', 'pdf') thumbnail, case ext when 'jpg' then 'image' when 'pdf' then 'pdf' else 'text' end extraction
from typed where ext in ('csv', 'md', 'html', 'pdf', 'jpg', 'txt')"""
)
def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy does to every upload of a known type, and what is derived from it."""
    policy = Policy(per_type={"md": "accept_as_is", "application/pdf": "sanitize_when_supported"}, deny_mime_types=("text/csv",))
    matrix = K.policy_matrix(spark, policy).groupBy("file_type").agg(F.min_by(F.struct("action", "thumbnail", "extraction"), "mime").alias("at"))
    rows = uploads(spark, sf_dir).select("object_key", file_extension(F.col("original_name")).alias("file_type"))
    known = rows.where(F.col("file_type").isin("csv", "md", "html", "pdf", "jpg", "txt"))
    return known.join(F.broadcast(matrix), "file_type").select("object_key", "at.action", "at.thumbnail", "at.extraction")


@query("select conv_id, to_json(list_distinct_keep) roles from (select conv_id, list(role order by first) list_distinct_keep from (select conv_id, role, min(turn) first from conversations group by all) group by conv_id)")
def roles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct: the roles of a conversation in the order they first speak."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(F.lit(" "), F.upper(t["role"])))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(K.ordered_distinct(turns)).alias("roles"))


@query("select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' else lang end, ''), nullif(source, ''), 'none') choice from documents")
def first_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable of several candidates."""
    lang = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", K.first_available(lang, F.col("source"), F.lit("none")).alias("choice"))


_DEADLINE = "case o_orderkey % 4 when 0 then o_orderdate + interval 10 second when 1 then o_orderdate + interval 400 day end"


@query(f"select o_orderkey, coalesce({_DEADLINE} < timestamp '{AS_OF}', false) expired, coalesce({_DEADLINE} < timestamp '{AS_OF}', o_orderkey % 4 = 2) expired_strict from orders")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines that have passed; unreadable ones count in the strict form only."""
    at = lambda s: F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    deadline = F.when(F.col("o_orderkey") % 4 == 0, at(10)).when(F.col("o_orderkey") % 4 == 1, at(400 * 86400)).when(F.col("o_orderkey") % 4 == 2, "soon").otherwise("")
    now = F.lit(AS_OF).cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.deadline_expired(deadline, now).alias("expired"), K.deadline_expired(deadline, now, unreadable=True).alias("expired_strict"))


@query(
    """select o_orderkey, cast(case when o_orderkey % 3 = 0 then 86400 when o_orderkey % 3 = 1 and 3600 * (1 + o_custkey % 40) <= 100000 then 3600 * (1 + o_custkey % 40) end as bigint) as "seconds",
  case when o_orderkey % 3 = 1 and 3600 * (1 + o_custkey % 40) > 100000 then 'share_ttl_too_long' when o_orderkey % 3 = 2 then 'invalid_expires_at' end as "error" from orders"""
)
def share_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When shares expire: explicit, by time to live, by default; too long and unreadable ones are errors."""
    third = F.col("o_orderkey") % 3
    policy = Policy(share_default_seconds=86400, share_max_seconds=100000)
    created = F.col("o_orderdate").cast("timestamp")
    made = K.share_expiry(F.when(third == 2, "soon").otherwise(""), F.when(third == 1, 3600 * (1 + F.col("o_custkey") % 40)).otherwise(0), created, policy)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", created.alias("created"), made.alias("made"))
    return rows.select("o_orderkey", (F.unix_seconds("made.expires_at") - F.unix_seconds("created")).alias("seconds"), F.col("made.error").alias("error"))


@query(f"select upload_key, late expired from (select o_orderkey upload_key, o_orderdate + interval 60 second < timestamp '{AS_OF}' or o_orderdate + interval 10 second < timestamp '{AS_OF}' late from orders where o_orderstatus <> 'F')")
def swept_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that a sweep expires: either deadline has passed, whatever the status."""
    at = lambda s: F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    markers = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("upload_key"), at(10).alias("upload_start_deadline"), at(60).alias("upload_finish_deadline"))
    gone, kept = K.sweep(markers, AS_OF)
    return gone.select("upload_key", F.lit(True).alias("expired")).unionAll(kept.select("upload_key", F.lit(False).alias("expired")))


@query("select doc_id, case when doc_id % 3 = 0 then null else 'doc/' || doc_id end object_key, case when doc_id % 2 = 0 then 'text' else 'from-metadata' end kind from documents where doc_id % 5 <> 0 union all select doc_id, null, 'from-metadata' from documents where doc_id % 5 = 0")
def control_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task records read from JSON bodies: empty fields fall back to object metadata, bad JSON to nothing else."""
    key = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    body = F.when(F.col("doc_id") % 5 == 0, "{oops").otherwise(F.to_json(F.struct(key.alias("object_key"), F.when(F.col("doc_id") % 2 == 0, "text").otherwise("").alias("kind"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.create_map(F.lit("Kind"), F.lit("from-metadata")).alias("metadata"))
    return parse_control_records(rows, "task").select("doc_id", "object_key", "kind")


_SLIDES = sql_list([f"ppt/slides/slide{i}.xml" for i in (2, 10, 1, 11)])


@query(f"select doc_id, to_json(list_sort(list_transform({_SLIDES}, lambda x: x || lang))) slides from documents where lang is not null")
def slide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide parts sort as text: 10 before 2."""
    names = F.array(*[F.concat(F.lit(f"ppt/slides/slide{i}.xml"), "lang") for i in (2, 10, 1, 11)])
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.to_json(F.array_sort(names)).alias("slides"))


@query("select doc_id, sha256(text) text_sha256 from documents where text is not null")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts put into a store, a folder for each language, and read back from the objects under a prefix."""
    path = _stored(spark, sf_dir)
    lines = scan_objects(spark, path, "lang=").where(F.col("object_key").endswith(".txt")).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return _digested(lines)


@query("select doc_id, sha256(text) text_sha256 from documents where text is not null")
def object_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store read in ranges of 10,000 bytes that its heads ask for, and put together again."""
    path = _stored(spark, sf_dir)
    heads = object_heads(spark, path, "lang=").where("size > 0 and object_key like '%.txt'")
    wanted = heads.select("object_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(10_000).cast("long"))).alias("start")).withColumn("end", F.col("start") + 9_999)
    pieces = object_ranges(spark, path, wanted)
    whole = pieces.groupBy("object_key").agg(F.array_sort(F.collect_list(F.struct("start", F.decode("piece", "UTF-8").alias("piece")))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return _digested(whole.select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A store of the texts, one to a line, in objects of a thousand at most."""
    path = work_path(spark, "store")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""))
    table(spark, sf_dir, "documents").where("text is not null").select(line.alias("value"), "lang").write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    return path


def _digested(lines: DataFrame) -> DataFrame:
    text = F.unbase64(F.substring_index("line", " ", -1))
    return lines.select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
