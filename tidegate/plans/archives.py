"""Archive queries: orders as archives of line items, conversations as ordered archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.classify import clean_archive_path
from tidegate.operators import archive as A
from tidegate.plans.registry import query, sql_list, table
from tidegate.policy import Policy

LIMITS = Policy(max_entry_bytes=1500, max_total_bytes=4000, max_entries=6, max_ratio=2.0, max_name_bytes=24)
PATHS = ("a/b.txt", "a/./b.txt", "../up.txt", "x/../y.md", "/abs.txt", "C:/t.txt", "d\\e.txt", "deep/a/../../z.bin", "", "very/long/name/of/an/entry.txt", "a//b.txt", "..")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the entries of an archive, in order."""
    rows = table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") + F.col("turn")) % len(PATHS)
    return rows.select(
        F.col("conv_id").cast("string").alias("object_key"), F.lit("").alias("level"), F.lit(1).alias("depth"), F.col("turn").alias("seq"),
        F.element_at(F.array(*[F.lit(p) for p in PATHS]), (n + 1).cast("int")).alias("name"),
        F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("compressed_size"), F.lit(900).cast("long").alias("archive_size"),
        (F.col("turn") % 11 == 10).alias("is_dir"), (F.col("conv_id") % 17 == 3).alias("is_link"), F.lit(False).alias("is_special"), (F.col("conv_id") % 19 == 4).alias("encrypted"),
        F.encode("text", "UTF-8").alias("prefix"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("error"),
    )


_CLEAN = ("a/b.txt", "a/b.txt", "../up.txt", "y.md", "abs.txt", "C:/t.txt", "d\\e.txt", "z.bin", "", "very/long/name/of/an/entry.txt", "a/b.txt", "..")
_SAFE = (True, True, False, True, False, False, False, True, False, True, True, False)
_ROWS = f"""entries as (select cast(conv_id as varchar) object_key, turn seq, {sql_list(PATHS)}[n] name, {sql_list(_CLEAN)}[n] clean_path,
  {str(list(_SAFE)).lower()}[n] safe, length(text) size, turn % 11 = 10 is_dir, conv_id % 17 = 3 is_link, conv_id % 19 = 4 encrypted
  from (select *, cast((conv_id + turn) % {len(PATHS)} + 1 as int) n from conversations)),
running as (select *, row_number() over (partition by object_key, clean_path order by seq) again,
  count(*) over (partition by object_key order by seq) run_entries,
  sum(case when is_dir then 0 else size end) over (partition by object_key order by seq) run_bytes from entries)"""


@query(f"with {_ROWS} select object_key, seq, clean_path, safe from entries")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry names cleaned, and whether they stay inside."""
    rows = entries(spark, sf_dir).withColumn("p", clean_archive_path(F.col("name")))
    return rows.select("object_key", "seq", F.col("p.path").alias("clean_path"), F.col("p.safe").alias("safe"))


@query(f"with {_ROWS} select object_key, seq, run_entries, cast(run_bytes as bigint) run_bytes, case when run_entries > 6 then 'archive_too_many_entries' end check_count, case when run_bytes > 4000 then 'archive_too_large' end check_total from running")
def archive_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running entries and bytes of each archive against its budget."""
    return A.archive_budget(entries(spark, sf_dir), LIMITS).select("object_key", "seq", "run_entries", "run_bytes", "check_count", "check_total")


_CODE = """case when strlen(trim(name)) > 24 then 'archive_path_unsafe' when not safe then 'archive_path_unsafe' when again > 1 then 'archive_path_unsafe'
  when encrypted then 'archive_unsupported_method' when is_link then 'archive_link_rejected' when not is_dir and size > 1500 then 'archive_too_large'
  when run_entries > 6 then 'archive_too_many_entries' when run_bytes > 4000 then 'archive_too_large' when not is_dir and run_bytes / 900.0 > 2 then 'archive_ratio_exceeded' end"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.compression_ratio(A.archive_budget(A.duplicate_paths(A.entry_checks(entries(spark, sf_dir), LIMITS)), LIMITS), LIMITS)
    used = ("name", "path", "duplicate", "encrypted", "link", "special", "entry_size", "count", "total", "ratio")
    return rows.withColumn("code", F.coalesce(*[F.col(f"check_{c}") for c in used]))


@query(f"with {_ROWS} select object_key, seq, {_CODE} code from running")
def archive_entry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check each entry fails."""
    return checked(spark, sf_dir).select("object_key", "seq", "code")


@query(f"with {_ROWS}, coded as (select object_key, seq, name, {_CODE} code from running) select object_key, arg_min(code, seq) filter (code is not null) code, arg_min(name, seq) filter (code is not null) entry from coded group by object_key")
def archive_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first breach of each archive."""
    return A.archive_verdict(checked(spark, sf_dir))


@query(
    """select l_orderkey, count(*) n_entries, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) total, cast(max(cast(floor(l_extendedprice) as bigint)) as bigint) largest,
  case when count(*) > 6 then 'archive_too_many_entries' when sum(cast(floor(l_extendedprice) as bigint)) > 200000 then 'archive_too_large'
  when sum(cast(floor(l_extendedprice) as bigint)) / (1000.0 * max(l_linenumber)) > 50 then 'archive_ratio_exceeded' end code from lineitem group by l_orderkey"""
)
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archives without entry order: totals, largest entry, ratio."""
    size = F.floor("l_extendedprice").cast("long")
    total = F.sum(size)
    code = F.when(F.count("*") > 6, "archive_too_many_entries").when(total > 200000, "archive_too_large").when(total / (1000.0 * F.max("l_linenumber")) > 50, "archive_ratio_exceeded")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_entries"), total.alias("total"), F.max(size).alias("largest"), code.alias("code"))


@query(
    """with asked as (select conv_id bundle_id, turn pos, cast(turn % 7 as varchar) || '/' || role || '.txt' object_key, length(text) size, role || '.txt' base from conversations where turn <> 5),
numbered as (select *, row_number() over (partition by bundle_id, base order by pos) n, row_number() over (partition by bundle_id order by pos) file_no, sum(size) over (partition by bundle_id order by pos) run_bytes from asked)
select bundle_id, pos, object_key, case when n = 1 then base else replace(base, '.txt', '-' || n || '.txt') end entry_name, cast(run_bytes as bigint) run_bytes,
  case when file_no > 8 then 'too_many_files' when run_bytes > 3000 then 'bundle_too_large' end code from numbered"""
)
def download_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as download bundles: unique entry names, running bytes, the row that breaks a limit."""
    rows = table(spark, sf_dir, "conversations").where("turn <> 5")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.concat("role", F.lit(".txt")))
    asked = rows.select(F.col("conv_id").alias("bundle_id"), F.col("turn").alias("pos"), key.alias("object_key"))
    heads = rows.select(key.alias("object_key"), F.length("text").cast("long").alias("size"), F.lit("").alias("original_name"))
    out = A.download_bundle(asked, heads, Policy(max_bundle_files=8, max_bundle_bytes=3000))
    short = F.concat((F.col("pos") % 7).cast("string"), F.lit("/"), F.regexp_extract("object_key", "([^/]*)$", 1))
    return out.select("bundle_id", "pos", short.alias("object_key"), "entry_name", "run_bytes", "code")
