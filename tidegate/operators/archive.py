"""Archive guard: per-entry checks, running budgets and one verdict per archive, over entry rows.

Entry rows have object_key, level, depth, seq, name, size, compressed_size,
archive_size, is_dir, is_link, is_special, encrypted, prefix, json (whether the prefix
may go on as JSON), kind (of an entry that is an archive itself), error, codec (of what
a single stream expands to). They
come from `jobs.archive_entries` or from any table in that shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegate.functions.classify import archive_kind, clean_archive_path, detect_mime, detect_script, file_extension, safe_segment, script_allowed
from tidegate.operators.jobs import archive_entries
from tidegate.operators.screen import declared_compatible, expected_types
from tidegate.policy import Policy


def entry_checks(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with a nullable code per check on the entry alone: name, path, encrypted, link, special, entry_size."""
    name = F.trim("name")
    path = clean_archive_path(name)
    plain = F.col("name").isNotNull()
    return entries.withColumn("clean_path", path["path"]).withColumns(
        {
            "check_name": F.when(plain & (F.octet_length(name) > policy.max_name_bytes), "archive_path_unsafe"),
            "check_path": F.when(plain & ~path["safe"], "archive_path_unsafe"),
            "check_encrypted": F.when(F.col("encrypted") & F.lit(not policy.allow_encrypted), "archive_unsupported_method"),
            "check_link": F.when(F.col("is_link"), "archive_link_rejected"),
            "check_special": F.when(F.col("is_special"), "archive_special_file_rejected"),
            "check_entry_size": F.when(~F.col("is_dir") & (F.col("size") > policy.max_entry_bytes), "archive_too_large"),
        }
    )


def duplicate_paths(entries: DataFrame, skip_tar: bool = True) -> DataFrame:
    """Entries with `check_duplicate`: the clean path was met before in the same archive level; not asked of tar."""
    first = Window.partitionBy("object_key", "level", "clean_path").orderBy("seq")
    again = F.row_number().over(first) > 1
    if skip_tar:
        again = again & (F.col("archive_size") > 0)
    return entries.withColumn("check_duplicate", F.when(F.col("name").isNotNull() & again, "archive_path_unsafe"))


def archive_budget(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with running counts over all nesting levels and running bytes of the level, and their checks."""
    whole = Window.partitionBy("object_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("object_key", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.col("name").isNotNull()
    size = F.when(counted & ~F.col("is_dir"), F.col("size")).otherwise(0)
    return entries.withColumns(
        {"run_entries": F.sum(counted.cast("long")).over(whole), "run_bytes": F.sum(size).over(whole), "level_bytes": F.sum(size).over(own)}
    ).withColumns(
        {
            "check_count": F.when(F.col("run_entries") > policy.max_entries, "archive_too_many_entries"),
            "check_total": F.when((F.col("run_bytes") > policy.max_total_bytes) | (F.col("level_bytes") > policy.max_total_bytes), "archive_too_large"),
        }
    )


def compression_ratio(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with `ratio`, the level's running bytes to the archive's size (none for tar), and its check."""
    ratio = F.when(F.col("archive_size") > 0, F.col("level_bytes") / F.col("archive_size"))
    return entries.withColumn("ratio", ratio).withColumn("check_ratio", F.when(~F.col("is_dir") & (F.col("ratio") > policy.max_ratio), "archive_ratio_exceeded"))


def stream_probe(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with `check_probe`: what a single-stream codec expands to, against the probe limit."""
    return entries.withColumn("check_probe", F.when(F.col("codec").isNotNull() & (F.col("size") > policy.max_probe_bytes), "archive_inspection_timeout"))


def entry_type_screen(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with `check_script` and `check_type`: scripts, and extensions against what was detected."""
    ext = file_extension(F.col("name"))
    expected = expected_types(ext, policy)
    body = F.col("name").isNotNull() & ~F.col("is_dir") & ~F.col("is_link") & ~F.col("is_special") & ~F.col("encrypted")
    script = detect_script(F.col("prefix"), F.col("name"), policy)
    # what is looked at is cut, so that it begins like JSON is for the reader to say
    detected = detect_mime(F.col("prefix"), policy, F.coalesce("json", F.lit(False)) if "json" in entries.columns else None)
    fits = F.coalesce(F.array_contains(expected, F.col("detected")), F.lit(False))
    stands_for = F.exists(expected, lambda e: declared_compatible(e, F.col("detected"), F.col("name")))
    empty = F.octet_length(F.coalesce("prefix", F.lit(b""))) == 0
    return entries.withColumns({"detected": detected, "script": script}).withColumns(
        {
            "check_script": F.when(body & F.lit(policy.reject_scripts) & F.col("script.detected") & ~script_allowed(F.col("script"), policy), "archive_entry_script_rejected"),
            "check_type": F.when(body & expected.isNotNull() & (empty | ~(fits | stands_for)), "archive_entry_type_mismatch"),
        }
    ).drop("script")


def nesting_depth(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with `check_depth`: an archive found at the deepest level allowed."""
    nested = F.col("kind").isNotNull() & F.col("name").isNotNull() & ~F.col("is_dir")
    return entries.withColumn("check_depth", F.when(nested & (F.col("depth") >= policy.max_depth), "archive_too_deep"))


#: Checks in the order in which an entry goes through them.
CHECKS = ("name", "path", "duplicate", "encrypted", "link", "special", "entry_size", "count", "total", "ratio", "probe", "script", "type", "depth")


def guard(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Entries with all checks and `code`, the first one that fails."""
    # types first: what an entry begins with need not go through the windows
    rows = nesting_depth(stream_probe(compression_ratio(archive_budget(duplicate_paths(entry_checks(entry_type_screen(entries, policy), policy)), policy), policy), policy), policy)
    return rows.withColumn("code", F.coalesce(F.col("error"), *[F.col(f"check_{c}") for c in CHECKS]))


def archive_verdict(checked: DataFrame) -> DataFrame:
    """(object_key, code, entry): the first breach of each archive in entry order; null if none."""
    bad = F.when(F.col("code").isNotNull(), F.col("seq"))
    return checked.groupBy("object_key").agg(F.min_by("code", bad).alias("code"), F.min_by("name", bad).alias("entry"), F.min(bad).alias("seq")).select(
        "object_key", F.when(F.col("seq").isNotNull(), F.col("code")).alias("code"), F.when(F.col("seq").isNotNull(), F.col("entry")).alias("entry")
    )


def inspect(objects: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(object_key, code, entry) for every object of (object_key, original_name, declared_type, content).

    Objects that are no archive have no breach; a kind that cannot be unpacked is
    rejected in strict mode only.
    """
    kinds = objects.withColumn("archive_kind", archive_kind(F.col("declared_type"), F.col("original_name"), F.col("content")))
    # package formats are screened by their own rules
    packed = kinds.where(F.col("archive_kind").isNotNull() & ~file_extension(F.col("original_name")).isin("docx", "xlsx", "pptx", "odt", "ods", "odp"))
    found = archive_verdict(guard(archive_entries(packed, policy), policy))
    lenient = F.lit(policy.archive_strict) | (F.col("code") != "archive_unsupported_method")
    return objects.select("object_key").join(found, "object_key", "left").select("object_key", F.when(lenient, F.col("code")).alias("code"), F.when(lenient, F.col("entry")).alias("entry"))


def unique_names(rows: DataFrame, name: str, order: list, within: list[str], out: str = "entry_name") -> DataFrame:
    """The nth use of a name becomes `base-n.ext`; the first stays. Made-up names are not themselves counted."""
    n = F.row_number().over(Window.partitionBy(*within, name).orderBy(*order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    return rows.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext))).drop("_n")


def download_bundle(requested: DataFrame, heads: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The manifest of a bundle per bundle_id: entry names, running bytes and a verdict.

    `requested` has bundle_id, pos, object_key; `heads` object_key, size,
    original_name. A missing object, too many files or too many bytes name
    their rejection on the row that breaks.
    """
    in_order = Window.partitionBy("bundle_id").orderBy("pos")
    rows = requested.join(heads, "object_key", "left")
    name = safe_segment(F.coalesce(F.nullif("original_name", F.lit("")), F.regexp_extract("object_key", "([^/]*)$", 1)))
    rows = unique_names(rows.withColumn("base", name), "base", ["pos"], ["bundle_id"])
    so_far = F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"file_no": F.row_number().over(in_order), "run_bytes": so_far})
    code = (
        F.when(F.col("file_no") > policy.max_bundle_files, "too_many_files")
        .when(F.col("size").isNull(), "object_not_found")
        .when(F.col("run_bytes") > policy.max_bundle_bytes, "bundle_too_large")
    )
    return rows.select("bundle_id", "pos", "object_key", "entry_name", "run_bytes", code.alias("code"))
