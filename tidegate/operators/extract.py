"""Text and metadata extraction for whole tables of objects, and the user-function hooks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.classify import extraction_route, normalize_mime, scanner_verdict
from tidegate.functions.text import core_properties, normalize_text, normalize_whitespace, pdf_info, pdf_literal_text, xmp_metadata
from tidegate.operators.jobs import media_chunks
from tidegate.operators.office import with_office_parts
from tidegate.operators.screen import latin1
from tidegate.policy import Policy

def png_text_metadata(chunks: DataFrame) -> DataFrame:
    """(object_key, title, description) from PNG tEXt chunks; later ones win."""
    raw = latin1(F.col("data"))
    key, value = F.lower(F.trim(F.substring_index(raw, "\0", 1))), F.trim(F.regexp_replace(raw, "(?s)^[^\\x00]*\\x00", ""))
    rows = chunks.where("type = 'tEXt'").select("object_key", "seq", key.alias("k"), value.alias("v")).where("v <> ''")
    last = lambda names: F.max_by(F.when(F.col("k").isin(*names), F.col("v")), F.when(F.col("k").isin(*names), F.col("seq")))
    return rows.groupBy("object_key").agg(last(["title"]).alias("title"), last(["description", "subject", "comment"]).alias("description"))


def ooxml_text(packages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`packages` (mime, content and others) with office_text, office_warnings, core and broken; contents are emptied.

    Parts are taken in order of name as text, their texts joined by spaces, 32 MB of a part at most; the archive limits
    do not count. What is no package is broken; a part that cannot be read ends where it does.
    """
    rows = with_office_parts(packages, policy)
    made = normalize_text(F.encode(F.coalesce("raw", F.lit("")), "UTF-8"), policy.max_output_bytes)
    rows = rows.withColumn("made", made).withColumn("core", F.when(F.col("core").isNotNull(), core_properties(F.decode("core", "UTF-8"))))
    warnings = F.concat("made.warnings", F.when(F.col("made.text") == "", F.array(F.lit("no_ooxml_text_found"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*packages.columns, F.col("made.text").alias("office_text"), warnings.alias("office_warnings"), "core", "broken")


def extract(objects: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Objects' texts, sources and metadata with a status.

    Takes object_key, content_type and content. Text-like types are normalised,
    office packages and PDFs parsed, images give their metadata, others are
    skipped. Returns object_key, content (texts, sources, metadata), status
    (generated, skipped, failed), error_code, has_text, has_ocr, has_metadata.
    Each row is worked out where it is read; only what images say comes back by key, after contents are left behind.
    """
    rows = objects.select("object_key", "content_type", "content").withColumn("mime", normalize_mime(F.col("content_type"))).withColumn("route", extraction_route(F.col("content_type")))
    rows = rows.withColumn("too_large", F.coalesce(F.octet_length("content") > policy.max_extract_bytes, F.lit(False)))
    png = png_text_metadata(media_chunks(rows.where("not too_large and route = 'image'"))).withColumnsRenamed({"title": "png_title", "description": "png_description"})
    is_office = F.coalesce(~F.col("too_large") & (F.col("route") == "ooxml"), F.lit(False))
    office = ooxml_text(rows.where(is_office), policy)
    none_of = [F.lit(None).cast(office.schema[c].dataType).alias(c) for c in office.columns[len(rows.columns) :]]
    rows = rows.where(~is_office).select("*", *none_of).unionAll(office)

    plain, pdf = normalize_text(F.col("content"), policy.max_output_bytes), pdf_literal_text(F.col("content"), policy.max_output_bytes)
    is_ = lambda route: F.col("route") == route
    none = F.array().cast("array<string>")
    # worked out while the content is there
    rows = rows.withColumns({
        "plain": F.when(is_("text") & ~F.col("too_large"), plain), "pdf": F.when(is_("pdf") & ~F.col("too_large"), pdf), "info": F.when(is_("pdf"), pdf_info(F.col("content"))),
        "xmp": F.when(F.col("mime").isin("image/jpeg", "image/pjpeg"), xmp_metadata(F.col("content"))),
    }).drop("content")
    # texts stay where they were made: no other row than an image has anything to fetch
    is_image = F.coalesce(F.col("route") == "image", F.lit(False))
    unsaid = [F.lit(None).cast("string").alias(c) for c in ("png_title", "png_description")]
    rows = rows.where(is_image).join(png, "object_key", "left").unionByName(rows.where(~is_image).select("*", *unsaid))
    plain, pdf, info, xmp = F.col("plain"), F.col("pdf"), F.col("info"), F.col("xmp")
    text = F.when(is_("text"), plain["text"]).when(is_("pdf"), pdf["text"]).when(is_("ooxml"), F.col("office_text"))
    warnings = F.when(is_("text"), F.coalesce(plain["warnings"], none)).when(is_("pdf"), F.concat(F.array(F.lit("pdftotext_unavailable")), F.coalesce(pdf["warnings"], none))).when(is_("ooxml"), F.coalesce("office_warnings", none)).when(is_("other"), F.array(F.lit("unsupported_content_type"))).otherwise(none)
    backend = F.when(is_("text"), "direct_text").when(is_("pdf"), "pdf_literal_parser").when(is_("ooxml"), "ooxml_parser").when(is_("image"), "image_metadata").otherwise("direct_text")
    meta = F.lit(policy.extract_metadata)
    title = F.when(meta, F.when(is_("pdf"), info["title"]).when(is_("ooxml"), F.col("core.title")).when(is_("image"), F.coalesce("png_title", xmp["title"])))
    description = F.when(meta, F.when(is_("pdf"), info["description"]).when(is_("ooxml"), F.col("core.description")).when(is_("image"), F.coalesce("png_description", xmp["description"])))
    rows = rows.withColumns({"text": text, "warnings": warnings, "backend": backend, "title": title, "description": description})
    key = F.when(is_("text"), "text").otherwise("extracted")
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    texts = F.map_filter(F.map_from_arrays(F.array(key, F.lit("title"), F.lit("description")), F.array(filled(F.col("text")), normalize_whitespace(filled(F.col("title"))), normalize_whitespace(filled(F.col("description"))))), lambda _, v: v.isNotNull())
    source = F.struct(F.col("backend").alias("backend"), F.col("mime").alias("content_type"), F.col("warnings").alias("warnings"))
    parsed = F.struct(F.lit("metadata_parser").alias("backend"), F.col("mime").alias("content_type"), none.alias("warnings"))
    sources = F.transform_values(F.col("texts"), lambda k, v: F.when(k.isin("title", "description"), parsed).otherwise(source))
    # warnings of an object without a text stand alone
    sources = F.when((F.size("texts") == 0) & (F.size("warnings") > 0), F.create_map(F.lit("extraction"), source)).otherwise(sources)
    rows = rows.withColumn("texts", texts).withColumn("metadata", F.coalesce("core.metadata", F.create_map().cast("map<string,string>")))
    broken = is_("ooxml") & F.coalesce("broken", F.lit(False))
    status = F.when(F.col("too_large") | broken, "failed").when(F.size("texts") + F.size("metadata") > 0, "generated").otherwise("skipped")
    return rows.select(
        "object_key",
        F.struct(F.col("texts"), sources.alias("sources"), F.col("metadata")).alias("content"),
        status.alias("status"),
        F.when(F.col("too_large"), "input_too_large").when(broken, "extract_failed").alias("error_code"),
        (filled(F.col("text")).isNotNull() & ~F.col("too_large")).alias("has_text"),
        F.lit(False).alias("has_ocr"),
        (F.col("title").isNotNull() | F.col("description").isNotNull() | (F.size("metadata") > 0)).alias("has_metadata"),
    )


# --- user functions ------------------------------------------------------------------


def with_function(df: DataFrame, fn: Callable[[bytes, str], str], out: str, content: str = "content", mime: str = "content_type") -> DataFrame:
    """`df` with what a user function makes of each content, and `<out>_error`: null, `timeout` or `extract_failed`.

    The function runs in the tasks, on one object after the other; an exception
    is kept as that row's error and stops nothing.
    """
    names = [*df.columns, out, f"{out}_error"]

    def run(batches):
        for batch in batches:
            values, errors = [], []
            for body, kind in zip(batch.column(content).to_pylist(), batch.column(mime).to_pylist()):
                try:
                    values.append(fn(body or b"", kind or ""))
                    errors.append(None)
                except TimeoutError:
                    values.append(None)
                    errors.append("timeout")
                except Exception:
                    values.append(None)
                    errors.append("extract_failed")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string()), pa.array(errors, pa.string())], names)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` string, `{out}_error` string"])
    return df.mapInArrow(run, schema)


def with_extractor(objects: DataFrame, fn: Callable[[bytes, str], str], policy: Policy = Policy()) -> DataFrame:
    """`extract` with a user extractor: for types without a route, and where the built-in text of a package or PDF is blank."""
    built_in = extract(objects, policy)
    route = objects.select("object_key", extraction_route(F.col("content_type")).alias("route"))
    blank = F.coalesce(F.col("content.texts")["extracted"], F.lit("")) == ""
    needed = built_in.join(route, "object_key").where(F.col("route").isin("other", "ooxml", "pdf") & blank).select("object_key", "route")
    made = with_function(objects.join(needed, "object_key"), fn, "external").select("object_key", "route", "external", "external_error")
    rows = built_in.join(made, "object_key", "left")
    got = F.trim(F.coalesce("external", F.lit(""))) != ""
    hard = (F.col("route") == "other") & F.col("external_error").isNotNull()
    texts = F.when(got, F.map_concat(F.map_filter("content.texts", lambda k, v: k != "extracted"), F.create_map(F.lit("extracted"), F.col("external")))).otherwise(F.col("content.texts"))
    by_hand = F.struct(F.lit("external_command").alias("backend"), F.lit(None).cast("string").alias("content_type"), F.array().cast("array<string>").alias("warnings"))
    sources = F.when(got, F.map_concat(F.map_filter("content.sources", lambda k, v: ~k.isin("extracted", "extraction")), F.create_map(F.lit("extracted"), by_hand))).otherwise(F.col("content.sources"))
    return rows.select(
        "object_key",
        F.struct(texts.alias("texts"), sources.alias("sources"), F.col("content.metadata").alias("metadata")).alias("content"),
        F.when(hard, "failed").when(got, "generated").otherwise(F.col("status")).alias("status"),
        F.when(hard, F.col("external_error")).when(got, None).otherwise(F.col("error_code")).alias("error_code"),
        (got | F.col("has_text")).alias("has_text"), "has_ocr", "has_metadata",
        F.when(F.col("external_error").isNotNull() & ~hard, "external_fallback_failed").alias("warning"),
    )


def with_ocr(objects: DataFrame, fn: Callable[[bytes, str], str]) -> DataFrame:
    """(object_key, ocr, ocr_error) of images by a user function."""
    return with_function(objects.where(extraction_route(F.col("content_type")) == "image"), fn, "ocr").select("object_key", "ocr", "ocr_error")


def with_scanner(objects: DataFrame, fn: Callable[[bytes, str], str]) -> DataFrame:
    """(object_key, response, code) by a user scanner; one that fails counts as a failed scan."""
    rows = with_function(objects, fn, "response")
    return rows.select("object_key", "response", scanner_verdict(F.col("response")).alias("code"))
