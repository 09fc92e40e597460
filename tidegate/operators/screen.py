"""Screening: ordered rules, each a nullable verdict column, to one verdict per object.

Rules over names, types and sizes are expressions on the object's row. Rules
that need a file's inside run on rows unpacked by the Arrow jobs and come back
as one small row per object, joined by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.classify import (
    OCTETS,
    archive_kind,
    detect_mime,
    detect_script,
    family_mode,
    file_extension,
    file_family,
    image_dimensions,
    normalize_mime,
    script_allowed,
    svg_dimensions,
)
from tidegate.operators.jobs import NAMING_BYTES, unpacked
from tidegate.policy import DOCX, ODP, ODS, ODT, PPTX, XLSX, Policy, expand_types, file_types


def _any(options) -> Column:
    return reduce(lambda a, b: a | b, options, F.lit(False))


def contains_any(text: Column, needles) -> Column:
    return _any(text.contains(n) for n in needles)


def latin1(content: Column) -> Column:
    """Bytes as text of as many characters, so that positions and counts are those of bytes."""
    return F.decode(F.coalesce(content, F.lit(b"")), "ISO-8859-1")


# --- types -------------------------------------------------------------------


def equivalent(a: Column, b: Column, policy: Policy = Policy()) -> Column:
    """Two MIME types are equal or in one group; blank never matches."""
    a, b = normalize_mime(a), normalize_mime(b)
    return (a != "") & (b != "") & ((a == b) | _any(a.isin(*g) & b.isin(*g) for g in policy.equivalent))


def matches_any(value: Column, listed, policy: Policy = Policy()) -> Column:
    """A MIME type is in the list, or in one group with a listed one."""
    wide = _wide(listed, policy)
    value = normalize_mime(value)
    return (value != "") & (value.isin(*wide) if wide else F.lit(False))


# Detected types that agree with a declared one.
_COMPATIBLE = {
    "text/plain": ("application/json", "application/x-python", "application/x-ndjson", "application/yaml", "application/x-yaml", "text/yaml", "text/x-yaml", "text/x-python", "text/x-script.python"),
    "text/markdown": ("text/plain", "text/html"),
    "application/octet-stream": (
        "text/plain", "application/vnd.microsoft.portable-executable", "application/x-coredump", "application/x-dosexec", "application/x-elf",
        "application/x-executable", "application/x-mach-binary", "application/x-msdownload", "application/x-object", "application/x-sharedlib",
    ),
}
# Declared types whose content may be detected as plain text.
_TEXT_DERIVED = (
    "text/plain", "text/csv", "text/markdown", "text/html", "text/xml", "text/yaml", "text/x-yaml", "application/json", "application/x-ndjson",
    "application/yaml", "application/x-yaml", "application/xml", "application/xhtml+xml", "text/x-python", "application/x-python",
    "text/x-script.python", "text/javascript", "application/javascript", "text/x-shellscript", "text/x-ruby", "text/x-perl",
    "application/x-httpd-php", "text/x-powershell", "text/x-makefile", "application/x-bat",
)


def declared_compatible(declared: Column, detected: Column, name: Column) -> Column:
    """A detected type may stand for the declared one, by pair, suffix or extension."""
    declared, detected, ext = normalize_mime(declared), normalize_mime(detected), file_extension(name)
    octets = declared == OCTETS
    by_ext = (
        (ext.isin("docx", "xlsx", "pptx", "odt", "ods", "odp") & (detected == "application/zip"))
        | (ext.isin("md", "markdown") & (declared == "text/markdown") & detected.isin("text/plain", "text/html"))
        | (ext.isin("rst", "rest") & (octets | (declared == "text/plain")) & (detected == "text/plain"))
        | (ext.isin("txt", "text") & octets & (detected == "text/plain"))
    )
    derived = declared.isin(*_TEXT_DERIVED) | declared.endswith("+json") | declared.endswith("+xml")
    pairs = _any((declared == d) & detected.isin(*found) for d, found in _COMPATIBLE.items())
    suffix = (declared == "text/plain") & detected.endswith("+json")
    return (declared != "") & (detected != "") & (suffix | ((detected == "text/plain") & derived) | by_ext | pairs)


def _wide(listed, policy: Policy) -> list[str]:
    """Listed MIME types and all that are in a group with one of them."""
    return sorted(set(listed) | {m for g in policy.equivalent if set(g) & set(listed) for m in g})


def expected_types(ext: Column, policy: Policy = Policy()) -> Column:
    """The MIME types an extension may have, from a constant map; null if it is unknown."""
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    entries = ", ".join(f"'{e}', array({listed(_wide(mimes, policy))})" for e, mimes in file_types().items())
    return F.try_element_at(F.expr(f"map({entries})"), ext)


def extension_agrees(name: Column, declared: Column, detected: Column, policy: Policy = Policy(), agree: Column | None = None) -> Column:
    """The extension, if known, fits what was detected, or what was declared where detection says nothing against it."""
    expected = expected_types(file_extension(name), policy)
    fits = lambda value: F.coalesce(F.array_contains(expected, value), F.lit(False))
    agree = equivalent(declared, detected, policy) | declared_compatible(declared, detected, name) if agree is None else agree
    open_ = (detected == "") | (detected == OCTETS) | agree
    return expected.isNull() | fits(detected) | (fits(declared) & open_)


# --- rules on one row ----------------------------------------------------------


def rule_size(size: Column, policy: Policy) -> Column:
    return F.when(size > min(policy.max_upload_bytes, policy.max_file_bytes), "resource_limit_exceeded")


def rule_script(script: Column, policy: Policy) -> Column:
    return F.when(F.lit(policy.reject_scripts) & script["detected"] & ~script_allowed(script, policy), "script_upload_rejected")


def rule_declared_mismatch(declared: Column, detected: Column, name: Column, allowed_script: Column, policy: Policy, agree: Column | None = None) -> Column:
    """`agree` may give what was worked out before: the types are equivalent or compatible."""
    agree = equivalent(declared, detected, policy) | declared_compatible(declared, detected, name) if agree is None else agree
    known = (declared != "") & (detected != "") & (detected != OCTETS)
    return F.when(known & ~allowed_script & ~agree, "content_type_mismatch")


def rule_extension_mismatch(name: Column, declared: Column, detected: Column, policy: Policy, agree: Column | None = None) -> Column:
    return F.when(~extension_agrees(name, declared, detected, policy, agree), "file_extension_mismatch")


def rule_deny(declared: Column, detected: Column, policy: Policy) -> Column:
    listed = expand_types(policy.deny_mime_types, policy.deny_file_types)
    return F.when(matches_any(detected, listed, policy) | matches_any(declared, listed, policy), "content_type_denied")


def rule_allow(declared: Column, detected: Column, policy: Policy) -> Column:
    listed = expand_types(policy.allow_mime_types, policy.allow_file_types)
    return F.when(F.lit(bool(listed)) & ~matches_any(detected, listed, policy) & ~matches_any(declared, listed, policy), "content_type_not_allowed")


# Markers in HTML and Markdown.
_ACTIVE = ("<object", "<embed", "<applet", "<frame", "<form")
_EXTERNAL = ("<link", "@import", "url(http:", "url(https:", "url(//", ' src="http:', " src='http:", ' src="https:', " src='https:")
EVENT_HANDLER = r"[ \t\r\n]on[a-z:-]+="


def markup_flags(text: Column) -> dict[str, Column]:
    """What a HTML or Markdown text holds, each a boolean; `text` in lower case."""
    return {
        "markup_script_detected": text.contains("<script"),
        "markup_iframe_detected": text.contains("<iframe"),
        "markup_active_content_rejected": contains_any(text, _ACTIVE),
        "markup_meta_refresh": text.contains("http-equiv") & text.contains("refresh"),
        "markup_event_handler_detected": text.rlike(EVENT_HANDLER),
        "markup_javascript_url_detected": text.contains("javascript:"),
        "markup_external_reference_detected": contains_any(text, _EXTERNAL),
    }


def rule_markup_html(text: Column, policy: Policy = Policy()) -> Column:
    """The first of the HTML rules a text (in lower case) breaks."""
    flags = markup_flags(text)
    codes = {"markup_meta_refresh": "markup_external_reference_detected"}
    objects = F.regexp_count(text, F.lit("<")) > policy.max_objects
    return F.coalesce(F.when(objects, "markup_parser_limit_exceeded"), *[F.when(c, codes.get(n, n)) for n, c in flags.items()])


# Tokens that a PDF may not hold.
PDF_TOKENS = ("/encrypt", "/javascript", "/js", "/launch", "/openaction", "/aa", "/embeddedfile", "/richmedia", "/3d", "/xfa", "/uri")


def rule_pdf(content: Column, policy: Policy = Policy()) -> Column:
    text = F.lower(latin1(content))
    return F.coalesce(
        F.when(contains_any(text, PDF_TOKENS), "document_active_content_rejected"),
        F.when(F.regexp_count(text, F.lit("/type/page")) > policy.max_pdf_pages, "resource_limit_exceeded"),
        F.when(F.regexp_count(text, F.lit(" obj")) > policy.max_objects, "resource_limit_exceeded"),
    )


_SPACE = "[\\t\\n\\x0B\\f\\r \\x85\\xA0]"


def rule_structure(content: Column, families: dict[str, Column]) -> Column:
    """JPEG begins and ends with its markers, PDF with its header, white space around aside. PNG has its own rule."""
    text = latin1(content)
    trimmed = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    bad_jpeg = families["jpeg"] & ~(text.startswith("\xff\xd8") & trimmed.endswith("\xff\xd9"))
    bad_pdf = families["pdf"] & ~families["jpeg"] & ~trimmed.startswith("%PDF-")
    return F.when(~families["png"] & (bad_jpeg | bad_pdf), "structural_validation_failed")


def rule_image_limits(size: Column, policy: Policy) -> Column:
    """`size` is (width, height)."""
    w, h = size["width"], size["height"]
    over = (w > policy.max_image_width) | (h > policy.max_image_height) | (w.cast("long") * h.cast("long") > policy.max_image_pixels)
    return F.when(over, "resource_limit_exceeded")


def rule_legacy(families: dict[str, Column], mode: Column) -> Column:
    keep = mode == "accept_as_is"
    return F.when(families["legacy_office"] & ~keep, "legacy_office_rejected").when(families["rtf"] & ~keep, "legacy_document_rejected")


def rule_mode_unavailable(families: dict[str, Column], mode: Column) -> Column:
    known = _any(families[f] for f in ("svg", "html", "markdown", "xml", "pdf", "ooxml", "odf", "image", "video"))
    return F.when((mode == "sanitize_when_supported") & known, "sanitizer_unavailable")


# --- rules on unpacked rows: one row per object ---------------------------------

# PNG chunks and WebP chunks that hold metadata, and markers in other media.
_PNG_METADATA, _WEBP_METADATA = ("eXIf", "tEXt", "zTXt", "iTXt", "tIME"), ("EXIF", "XMP ")
_VIDEO_MARKERS = ("exif", "xmp", "\xa9day", "\xa9mod", "\xa9xyz", "gps", "udta", "meta")


def media_aggregates() -> dict[str, Column]:
    """png_ok, has_metadata, width and height of each object's media chunks.

    A PNG is sound if every chunk is in bounds with a valid checksum, IHDR was
    seen, and IEND comes last. JPEG sizes come from its frame header.
    """
    own = F.col("part") == "media"
    png = F.col("type").isin(*_PNG_METADATA) & F.col("crc_ok").isNotNull()
    frame = F.col("type").rlike("^C[0-35-79-BD-F]$") & (F.octet_length("data") >= 5)
    number = lambda at: F.conv(F.hex(F.substring("data", at, 2)), 16, 10).cast("int")
    riff = F.col("type") == "VP8X"
    little = lambda at: (F.conv(F.concat(*[F.hex(F.substring("data", at + i, 1)) for i in (2, 1, 0)]), 16, 10) + 1).cast("int")
    sound = F.bool_and(F.when(own, F.coalesce("crc_ok", F.lit(False)) & F.col("error").isNull()))
    ended = F.max_by("type", F.when(own, F.col("seq"))) == "IEND"
    return {
        "png_ok": sound & F.bool_or(own & (F.col("type") == "IHDR")) & ended,
        "has_metadata": F.bool_or(own & (png | (F.col("type") == "E1") | F.col("type").isin(*_WEBP_METADATA))),
        "width": F.coalesce(F.max(F.when(own & frame, number(4))), F.max(F.when(own & riff, little(5)))),
        "height": F.coalesce(F.max(F.when(own & frame, number(2))), F.max(F.when(own & riff, little(8)))),
    }


def svg_code(policy: Policy = Policy()) -> Column:
    """The first rule an SVG breaks: an aggregate over its verdict, with the rules on its root and size."""
    get = lambda k: F.col("attributes")[k]
    size = svg_dimensions(get("width"), get("height"), get("viewbox"))
    over = F.lit(False)
    for limit, value in ((policy.max_image_width, size["width"]), (policy.max_image_height, size["height"]), (policy.max_image_pixels, size["width"] * size["height"])):
        over = over | F.coalesce(value > limit, F.lit(False)) if limit > 0 else over
    code = F.coalesce(F.when(F.col("name") != "svg", "structural_validation_failed"), F.when(over, "resource_limit_exceeded"), F.col("error"))
    return F.max(F.when(F.col("part") == "svg", code))


def xml_code() -> Column:
    """The first rule a parsed XML document breaks: an aggregate over its verdict."""
    return F.max(F.when(F.col("part") == "xml", F.col("error")))


def rule_xml_text(text: Column) -> Column:
    """What a look at the text (in lower case) shows before it is parsed."""
    doctype = text.contains("<!doctype") & contains_any(text, ("system", "public", "<!entity"))
    return F.when(doctype | text.contains("<!entity"), "xml_external_entity_detected").when(contains_any(text, ("<xi:include", "<xinclude:include")), "xml_xinclude_detected")


# Parts and markers an office package may not hold.
_OOXML_PARTS = ("vbaproject.bin", "/activex/", "/embeddings/", "oleobject", "externallinks/", "printersettings/")
_OOXML_MARKERS = ('targetmode="external"', "http://", "https://", "oleobject", "activex", "vba", "externallink", "attachedtemplate")
_ODF_PARTS = ("scripts/", "basic/", "event-listener")
_ODF_MARKERS = ("script:event-listener", "script:language", "ooo:script", "macro-name", "starbasic", "application/vnd.sun.star.script", 'xlink:href="http://', 'xlink:href="https://', 'xlink:href="file://')
_MAIN_PARTS = (("docx", DOCX), ("xlsx", XLSX), ("pptx", PPTX))
_ODF_TYPES = (("odt", ODT), ("ods", ODS), ("odp", ODP))


#: What to look for in the entries of a package, and in which.
_MARKERS = {k: (tuple(m.encode() for m in markers), suffixes) for k, markers, suffixes in (("ooxml", _OOXML_MARKERS, (".xml", ".rels")), ("odf", _ODF_MARKERS, (".xml",)))}


def _kind(options, mime: Column, name: Column) -> Column:
    return F.coalesce(*[F.when((normalize_mime(mime) == m) | (file_extension(name) == e), m) for e, m in options])


def package_aggregates(policy: Policy = Policy()) -> dict[str, Column]:
    """What `package_code` needs of an OOXML or ODF package's entries, which have the type it should be in `ooxml` or `odf`."""
    name = F.lower("name")
    own = F.col("part") == "package"
    # the main part named for this type by the content types, as text between quotes
    override = F.filter(
        F.regexp_extract_all(latin1(F.col("body")), F.lit(r"(?is)<(?:\w+:)?override\b[^>]*>"), 0),
        lambda t: F.lower(F.regexp_extract(t, r"(?is)\bcontenttype\s*=\s*[\"']\s*([^\"']*?)\s*[\"']", 1)) == F.concat(F.lower("ooxml"), F.lit(".main+xml")),
    )
    main = F.lower(F.regexp_extract(F.get(override, F.lit(0)), r"(?is)\bpartname\s*=\s*[\"']\s*/?([^\"']*?)\s*[\"']", 1))
    roots = F.exists(
        F.regexp_extract_all(latin1(F.col("body")), F.lit(r"(?is)<(?:\w+:)?file-entry\b[^>]*>"), 0),
        lambda t: (F.regexp_extract(t, r"(?is)\bfull-path\s*=\s*[\"']\s*([^\"']*?)\s*[\"']", 1) == "/") & (F.regexp_extract(t, r"(?is)\bmedia-type\s*=\s*[\"']\s*([^\"']*?)\s*[\"']", 1) == F.col("odf")),
    )
    over = F.col("size") > policy.max_part_bytes
    parts = F.when(F.col("ooxml").isNotNull(), contains_any(name, _OOXML_PARTS)).otherwise(contains_any(name, _ODF_PARTS) | name.endswith(".bas"))
    bad_part = parts | F.coalesce("marked", F.lit(False))
    bad = own & F.coalesce(over | bad_part, F.lit(False))
    return {
        "as_ooxml": F.max(F.when(own, F.col("ooxml"))),
        "as_odf": F.max(F.when(own, F.col("odf"))),
        "entries": F.count(F.when(own, F.col("name"))),
        "broken": F.bool_or(own & F.col("error").isNotNull()),
        "unnamed": F.bool_or(own & (F.octet_length("body") > NAMING_BYTES)),
        "main": F.max(F.when(own & (name == "[content_types].xml"), F.coalesce(main, F.lit("")))),
        "names": F.collect_set(F.when(own, F.ltrim(name, F.lit("/")))),
        "mimetype": F.max(F.when(own & (name == "mimetype"), F.trim(latin1(F.col("body"))))),
        "root": F.bool_or(own & (name == "meta-inf/manifest.xml") & roots),
        "content": F.min_by(F.when(over, "resource_limit_exceeded").otherwise("document_active_content_rejected"), F.when(bad, F.col("seq"))),
    }


def package_code(policy: Policy = Policy()) -> Column:
    """The rule a package breaks, from its aggregates.

    A package needs its declared parts, may hold no dangerous part or marker,
    and must keep to the part and entry limits.
    """
    has = lambda part: F.array_contains("names", part)
    bad_ooxml = F.col("as_ooxml").isNotNull() & (F.col("main").isNull() | (F.col("main") == "") | ~has(F.col("main")))
    bad_odf = F.col("as_odf").isNotNull() & (F.coalesce(F.col("mimetype") != F.col("as_odf"), F.lit(True)) | ~F.coalesce("root", F.lit(False)) | ~has("content.xml"))
    return F.coalesce(
        F.when(F.col("broken"), "structural_validation_failed"),
        F.when((F.col("entries") > policy.max_entries) | F.col("unnamed"), "resource_limit_exceeded"),
        F.when(bad_ooxml | bad_odf, "structural_validation_failed"),
        F.col("content"),
    )


# --- all rules -------------------------------------------------------------------

RULES = ("size", "script", "declared", "extension", "deny", "allow", "image", "structure", "legacy", "mode", "content", "metadata")


_FAMILIES = ("image", "video", "jpeg", "png", "webp", "svg", "pdf", "ooxml", "odf", "legacy_office", "rtf", "markdown", "html", "xml")


def _typed(objects: DataFrame, policy: Policy) -> DataFrame:
    """Objects with what name, declared type and first bytes tell: `detected`, `mode`, and `_` columns of the rules."""
    name, declared = F.col("original_name"), normalize_mime(F.col("declared_type"))
    rows = objects.withColumns({"_declared": declared, "detected": detect_mime(F.col("content"), policy)})
    rows = rows.withColumn("_mime", F.when(F.col("_declared") != "", F.col("_declared")).otherwise(F.col("detected")))
    mime = F.col("_mime")
    rows = rows.withColumns({f"_{n}": c for n, c in file_family(mime, name).items()})
    by_type = [F.when((mime == k) | (file_extension(name) == k.lstrip(".")), v) for k, v in policy.per_type.items()]
    rows = rows.withColumn("mode", F.coalesce(*by_type, family_mode(mime, name, policy)))
    return rows.withColumns(
        {
            "_on": F.lit(policy.sanitize) & (F.col("mode") != "accept_as_is"),
            "_is_xml": ~F.col("_svg") & F.col("_xml"),
            "_is_html": (F.col("_html") | F.col("_markdown")) & ~F.col("_xml") & ~F.col("_svg"),
            "_watched": (F.col("mode") == "reject_on_sensitive_metadata") & ((F.col("_image") & ~F.col("_svg")) | F.col("_video")),
        }
    )


def inside(objects: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per object that is unpacked: object_key, what its chunks tell, svg_code, xml_code, package_code.

    One pass over the contents of the families that need it, one grouping by key.
    """
    mime, name = F.col("_mime"), F.col("original_name")
    parts = F.array_compact(
        F.array(
            F.when(F.col("_image") | F.col("_video"), "media"), F.when(F.col("_svg"), "svg"), F.when(F.col("_is_xml"), "xml"), F.when(F.col("_ooxml") | F.col("_odf"), "package")
        )
    )
    wanted = _typed(objects.select("object_key", "original_name", "declared_type", "content"), policy).where("_on").withColumn("parts", parts).where("size(parts) > 0")
    rows = unpacked(wanted.withColumns({"ooxml": _kind(_MAIN_PARTS, mime, name), "odf": _kind(_ODF_TYPES, mime, name)}), policy, _MARKERS)
    made = {**media_aggregates(), "svg_code": svg_code(policy), "xml_code": xml_code(), **package_aggregates(policy)}
    summary = rows.groupBy("object_key").agg(*[c.alias(n) for n, c in made.items()])
    return summary.select("object_key", "png_ok", "has_metadata", "width", "height", "svg_code", "xml_code", package_code(policy).alias("package_code"))


def screen(objects: DataFrame, policy: Policy = Policy(), explain: bool = False) -> DataFrame:
    """Objects with `size`, `detected`, `mode` and `verdict`: the code of the first rule broken, null if accepted.

    Takes object_key, original_name, declared_type and content; all columns but
    the content are returned, which never leaves the tasks that read it: rules
    on one row are worked out where the row is read, and what is inside a file
    (unpacked only for the families that need it) comes back as one small row
    per key. Rows that repeat a key are judged each, but unpacked as one. With
    `explain`, each rule's own verdict is returned too (`rule_...`).
    """
    name, declared, detected, content = F.col("original_name"), F.col("_declared"), F.col("detected"), F.col("content")
    families = {n: F.col(f"_{n}") for n in _FAMILIES}
    rows = _typed(objects, policy).withColumns({"size": F.octet_length("content"), "_script": detect_script(content, name, policy)})
    # one step after the other, so that none outgrows what code generation takes
    strict = F.col("mode").isin("secure_default", "reject_active_or_external_content", "reject_active_content")
    plain = ~families["legacy_office"] & ~families["rtf"]
    looked_at = F.col("_on") & plain & ((strict & (F.col("_is_xml") | F.col("_is_html") | families["pdf"])) | F.col("_watched"))
    rows = rows.withColumns(
        {
            "_low": F.when(looked_at, F.lower(latin1(content))),
            "_same": equivalent(declared, detected, policy),
            "_compatible": declared_compatible(declared, detected, name),
            "_allowed_script": F.col("_script.detected") & script_allowed(F.col("_script"), policy),
        }
    )
    low = F.col("_low")
    rows = rows.withColumns(
        {
            "_html_code": F.when(F.col("_is_html"), rule_markup_html(low, policy)),
            "_xml_text": F.when(F.col("_is_xml"), rule_xml_text(low)),
            "_pdf_code": F.when(families["pdf"] & low.isNotNull(), rule_pdf(content, policy)),
            "_shape": F.when(F.col("_on") & F.lit(policy.structural), rule_structure(content, families)),
            "_pixels": F.when(F.col("_on") & families["image"], image_dimensions(content)),
            "_marked": F.when(families["video"] & ~families["image"], contains_any(low, _VIDEO_MARKERS)).when(
                ~(families["png"] | families["jpeg"] | families["webp"]), contains_any(low, ("exif", "xmp"))
            ),
        }
    )
    rows = rows.drop("content", "_low").withColumns(
        {
            "rule_size": rule_size(F.col("size"), policy),
            "rule_script": rule_script(F.col("_script"), policy),
            "rule_declared": rule_declared_mismatch(declared, detected, name, F.col("_allowed_script"), policy, F.col("_same") | F.col("_compatible")),
            "rule_extension": rule_extension_mismatch(name, declared, detected, policy, F.col("_same") | F.col("_compatible")),
            "rule_deny": rule_deny(declared, detected, policy),
            "rule_allow": rule_allow(declared, detected, policy),
            "rule_legacy": F.when(F.col("_on"), rule_legacy(families, F.col("mode"))),
            "rule_mode": F.when(F.col("_on") & plain, rule_mode_unavailable(families, F.col("mode"))),
        }
    )
    kept = [c for c in objects.columns if c != "content"]
    rules = [f"rule_{n}" for n in RULES]
    if policy.sanitize:
        summary = inside(objects, policy)
        rows = rows.join(summary.select("object_key", *[F.col(c).alias(f"_in_{c}") for c in summary.columns[1:]]), "object_key", "left")
        size = F.coalesce("_pixels", F.when(F.col("_in_width").isNotNull(), F.struct(F.col("_in_width").alias("width"), F.col("_in_height").alias("height"))))
        broken_png = F.when(families["png"] & ~F.coalesce("_in_png_ok", F.lit(False)), "structural_validation_failed")
        content_code = F.coalesce(
            F.when(families["svg"], F.col("_in_svg_code")), F.when(F.col("_is_xml"), F.coalesce("_xml_text", "_in_xml_code")), "_html_code", "_pdf_code", "_in_package_code"
        )
        own = {
            "rule_image": F.when(F.col("_on") & families["image"] & ~families["svg"], rule_image_limits(size, policy)),
            "rule_structure": F.when(F.col("_on") & F.lit(policy.structural), F.coalesce(broken_png, F.col("_shape"))),
            "rule_content": F.when(F.col("_on") & plain & strict, content_code),
            "rule_metadata": F.when(F.col("_on") & plain & F.col("_watched") & F.coalesce("_marked", "_in_has_metadata", F.lit(False)), "sensitive_metadata_detected"),
        }
    else:
        # sanitisation switched off needs nothing of the inside
        own = {n: F.lit(None).cast("string") for n in ("rule_image", "rule_structure", "rule_content", "rule_metadata")}
    out = rows.withColumns(own).withColumn("verdict", F.coalesce(*rules))
    return out.select(*kept, *[c for c in ("size", "detected", "mode") if c not in kept], *(rules if explain else []), "verdict")


def with_archive_kind(objects: DataFrame) -> DataFrame:
    return objects.withColumn("archive_kind", archive_kind(F.col("declared_type"), F.col("original_name"), F.col("content")))
