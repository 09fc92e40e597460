"""Classifier queries: types, scripts, names, keys, sizes and verdicts of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import classify as C
from tidegate.plans.registry import query, sql_list, table
from tidegate.plans.screening import NAMES, UPLOADS_SQL, uploads
from tidegate.policy import file_types

# contents: first bytes as hexadecimal, the type, and the archive kind they show
HEADS = (
    ("89504E470D0A1A0A", "image/png", None), ("FFD8FFE0", "image/jpeg", None), ("474946383961", "image/gif", None), ("255044462D312E34", "application/pdf", None),
    ("504B0304", "application/zip", "zip"), ("1F8B0800", "application/gzip", "gzip"), ("28B52FFD", "application/zstd", "zstd"), ("425A6839", "application/x-bzip2", "bzip2"),
    ("7F454C46", "application/x-elf", None), ("D0CF11E0A1B11AE1", "application/x-ole-storage", None), ("3C68746D6C3E", "text/html", None), ("", "text/plain", None),
)


def pick(values, of):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values) + 1).cast("int"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.unhex(pick([h for h, _, _ in HEADS], F.col("doc_id"))), F.encode("text", "UTF-8")).alias("content"))


_PICK = lambda values: f"{sql_list(values)}[cast(doc_id % {len(values)} + 1 as int)]"
_NULLS = lambda values: "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


@query(f"select doc_id, {_PICK([t for _, t, _ in HEADS])} mime, {_NULLS([k for _, _, k in HEADS])}[cast(doc_id % {len(HEADS)} + 1 as int)] kind from documents where text <> ''")
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and archive kinds by first bytes."""
    rows = contents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text <> ''")
    return rows.select("doc_id", C.detect_mime(F.col("content")).alias("mime"), C.archive_kind(F.lit(""), F.lit(""), F.col("content")).alias("kind"))


SHEBANGS = ("#!/bin/bash\n", "#!/usr/bin/env python3\n", "#!/usr/bin/node\n", "#!/opt/odd\n", "", "#! /usr/bin/perl -w\n", "")
_KIND_BY_EXT = {"Makefile": "make", "build.bat": "batch", "deploy.PS1": "powershell", "tool.py": "python"}


@query(
    f"""with {UPLOADS_SQL}, made as (select object_key, original_name, {sql_list(SHEBANGS)}[cast(cast(object_key as bigint) // 5 % {len(SHEBANGS)} + 1 as int)] head,
  case original_name {" ".join(f"when '{n}' then '{k}'" for n, k in _KIND_BY_EXT.items())} end by_ext from uploads)
select object_key, case when head = '' then by_ext when contains(head, 'bash') then 'shell' when contains(head, 'python') then 'python' when contains(head, 'node') then 'node'
  when contains(head, 'perl') then 'perl' else coalesce(by_ext, 'shell') end script from made"""
)
def detect_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script types by `#!` line and extension."""
    rows = uploads(spark, sf_dir)
    head = pick(SHEBANGS, F.floor(F.col("object_key").cast("long") / 5))
    script = C.detect_script(F.concat(F.encode(head, "UTF-8"), F.col("content")), F.col("original_name"))
    return rows.select("object_key", script["type"].alias("script"))


_ROUTE = "case when starts_with(declared, 'text/') or declared in ('application/json') then 'text' when declared = 'application/pdf' then 'pdf' when starts_with(declared, 'image/') then 'image' else 'other' end"


@query(
    f"""with {UPLOADS_SQL} select object_key, declared, ext, case when lower(original_name) = 'makefile' then 'makefile' else ext end script_ext, {_ROUTE} route,
  declared in ('image/png', 'application/pdf', 'image/svg+xml') thumbnail, len(list_filter([case when {_ROUTE} in ('text','pdf') then 'text' end, case when {_ROUTE} in ('pdf','image') then 'metadata' end], lambda x: x is not null)) n_tasks from typed"""
)
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME types, extensions, extraction routes and work of all uploads."""
    rows = uploads(spark, sf_dir)
    mime = F.col("declared_type")
    return rows.select(
        "object_key", C.normalize_mime(mime).alias("declared"), C.file_extension(F.col("original_name")).alias("ext"), C.script_extension(F.col("original_name")).alias("script_ext"),
        C.extraction_route(mime).alias("route"), C.thumbnail_eligible(mime).alias("thumbnail"), F.size(C.extraction_tasks(mime)).cast("long").alias("n_tasks"),
    )


RAW = ("../etc/pass wd", " My File (1).TXT ", "...", "a/b/", "x__--__", "ok.md", "täst.pdf", "-.-")
_SAFE = ("pass-wd", "My-File-1-.TXT", "file", "b", "x", "ok.md", "t-st.pdf", "file")


@query(f"select doc_id, {_PICK(_SAFE)} segment, source || '/' || doc_id || '/' || {_PICK(_SAFE)} object_key, sha256('text' || chr(0) || doc_id) task_key, sha256(source) owner from documents")
def keys_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names, object keys, task keys and owner hashes."""
    rows = table(spark, sf_dir, "documents").withColumn("name", pick(RAW, F.col("doc_id")))
    keys = C.object_keys(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("name"))
    return rows.select(
        "doc_id", C.safe_segment(F.col("name")).alias("segment"), keys["object_key"].alias("object_key"),
        C.task_key(F.lit("text"), F.col("doc_id").cast("string")).alias("task_key"), C.owner_hash(F.col("source")).alias("owner"),
    )


@query("select o_orderkey, cast(case when o_orderkey % 3 <> 0 and size > 0 then least(done, floor(size * 98 / 100.0)) else done end as bigint) shown, cast(least(case when size > 0 then size end, case when done > 0 then done end) as bigint) least_size from (select o_orderkey, cast(floor(o_totalprice) as bigint) size, cast(floor(o_totalprice) as bigint) - o_orderkey % 5 * 100 done from orders)")
def progress_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as displayed, and the smaller of two limits."""
    size = F.floor("o_totalprice").cast("long")
    done = size - F.col("o_orderkey") % 5 * 100
    rows = table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), done.alias("done"))
    return rows.select("o_orderkey", C.displayed_bytes(F.col("done"), F.col("size"), F.col("o_orderkey") % 3 != 0).alias("shown"), C.effective_limit(F.col("size"), F.col("done")).alias("least_size"))


_STATUS = "case o_orderstatus when 'P' then 'key_created' when 'O' then 'uploading' else 'uploaded' end"


@query(
    f"""select o_orderkey, case when action = 'cancel' and o_custkey % 3 = 0 then 'forbidden' when action = 'cancel' and status <> 'key_created' then 'upload_not_cancelable'
  when action = 'upload' and status = 'uploaded' then 'upload_already_completed' end code from (select *, {_STATUS} status, case when o_orderkey % 2 = 0 then 'cancel' else 'upload' end action from orders)"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an action on an upload in some state is told."""
    status = F.when(F.col("o_orderstatus") == "P", "key_created").when(F.col("o_orderstatus") == "O", "uploading").otherwise("uploaded")
    action = F.when(F.col("o_orderkey") % 2 == 0, "cancel").otherwise("upload")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.transition_check(status, action, F.col("o_custkey") % 3 != 0)["code"].alias("code"))


PATHS = ("/v1/uploads/keys/{}/content", "/v1/uploads/keys/{}", "/v1/objects/{}/extracted", "/v1/objects/{}", "/v1/shared/{}", "/healthz", "/other/{}", "/v1/uploads/wait?{}")
_ROUTES = ("/v1/uploads/keys/{key}/content", "/v1/uploads/keys/{key}", "/v1/objects/{key}/extracted", "/v1/objects/{key}", "/v1/shared/{key}", "/healthz", "other", "/v1/uploads/wait")


@query(f"select {sql_list(_ROUTES)}[cast(event_id % {len(_ROUTES)} + 1 as int)] route, event_type, count(*) n from events group by all")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access log counted by route pattern."""
    path = F.replace(pick(PATHS, F.col("event_id")), F.lit("{}"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").withColumn("route", C.route_template(path)).groupBy("route", "event_type").agg(F.count("*").alias("n"))


@query("select doc_id, '/a%20b/' || source || '/' || doc_id || '+x@1%25' public from documents")
def urls_of_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public URLs, escaped per segment."""
    key = F.concat(F.lit("a b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("+x@1%"))
    return table(spark, sf_dir, "documents").select("doc_id", C.object_urls(key)["public"].alias("public"))


ANSWERS = ("stream: OK", "stream: Eicar FOUND", "INSTREAM size limit exceeded. ERROR", "", "OK")
_CODES = (None, "malware_detected", "virus_scan_failed", "virus_scan_failed", None)


@query(f"select code, count(*) n from (select {_NULLS(_CODES)}[cast(event_id % {len(_CODES)} + 1 as int)] code from events) group by code")
def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner answers as verdicts, counted."""
    return table(spark, sf_dir, "events").select(C.scanner_verdict(pick(ANSWERS, F.col("event_id"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(greatest(floor(w * s + 0.5), 1) as int) width, cast(greatest(floor(h * s + 0.5), 1) as int) height
  from (select *, least(least(400.0 / w, 400.0 / h), 1.0) s from (select *, l_partkey % 3000 + 1 w, l_suppkey % 2000 + 1 h from lineitem))"""
)
def thumbnail_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails of many image sizes in a box of 400 x 400."""
    size = C.thumbnail_size((F.col("l_partkey") % 3000 + 1).cast("double"), (F.col("l_suppkey") % 2000 + 1).cast("double"), F.lit(400.0), F.lit(400.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size["width"].alias("width"), size["height"].alias("height"))


@query("select p_partkey, p_partkey % 12000 width, p_size height, case when p_partkey % 12000 > 10000 then 'resource_limit_exceeded' end code from part")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG headers of many sizes, read back and held against the limits."""
    from tidegate.operators.screen import rule_image_limits
    from tidegate.policy import Policy

    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.concat(F.lit(bytes.fromhex("89504E470D0A1A0A0000000D49484452")), number(F.col("p_partkey") % 12000), number(F.col("p_size")), F.lit(b"\x08\x02\0\0\0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", C.image_dimensions(head).alias("size"))
    return rows.select("p_partkey", F.col("size.width").cast("long").alias("width"), F.col("size.height").alias("height"), rule_image_limits(F.col("size"), Policy()).alias("code"))


UNITS = ("px", "", "in", "pc", "%", " px")
_SCALE = ("1.0", "1.0", "96.0", "16.0", "null", "1.0")


@query(f"select p_partkey, p_size * [{', '.join(_SCALE)}][cast(p_partkey % {len(UNITS)} + 1 as int)] width, cast(p_size + 1 as double) height from part")
def svg_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVG lengths in several units; a missing height comes from the view box, a percentage counts as absent."""
    width = F.concat(F.col("p_size").cast("string"), pick(UNITS, F.col("p_partkey")))
    size = C.svg_dimensions(width, F.lit(None).cast("string"), F.concat(F.lit("0 0 x "), (F.col("p_size") + 1).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("select doc_id, to_json(list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> '')) items from (select doc_id, source || ', ,' || lang || ',,' || doc_id line from documents)")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("source", F.lit(", ,"), "lang", F.lit(",,"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(C.split_list(line)).alias("items"))


@query("select doc_id, lang switch_name, doc_id % 2 = 0 switched from documents where lang <> ''")
def switch_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switch maps with names that differ only in case and blanks: the last one holds."""
    switches = F.map_from_arrays(F.array(F.concat(F.lit(" ."), F.upper("lang")), F.col("lang"), F.lit(" ")), F.array(F.lit(False), F.col("doc_id") % 2 == 0, F.lit(True)))
    rows = table(spark, sf_dir, "documents").where("lang <> ''").select("doc_id", F.explode(C.normalize_switches(switches, extensions=True)).alias("switch_name", "switched"))
    return rows


_EXPECTED = {n: file_types().get(n.rsplit(".", 1)[-1].lower(), ()) for n in NAMES}


@query(f"with {UPLOADS_SQL} select object_key, case original_name {' '.join(f'when {chr(39)}{n}{chr(39)} then {len(m)}' for n, m in _EXPECTED.items() if m)} end n_expected from uploads")
def expected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MIME types an extension stands for, by lookup join."""
    from tidegate.operators.catalog import expected_mimes
    from tidegate.policy import Policy, policy_tables

    rows = expected_mimes(uploads(spark, sf_dir), "original_name", policy_tables(spark, Policy())["expected"])
    return rows.select("object_key", F.when(F.col("expected").isNotNull(), F.size("expected")).alias("n_expected"))
