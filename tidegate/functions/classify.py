"""Columns that say what an object is: type, extension, script, archive, family, mode, keys and URLs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.text import let
from tidegate.policy import DOCX, ODP, ODS, ODT, PPTX, XLSX, Policy

OCTETS = "application/octet-stream"


def _any(options) -> Column:
    return reduce(lambda a, b: a | b, options, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_mime(c: Column) -> Column:
    """Without parameters, trimmed and lower-cased; null counts as blank."""
    return F.lower(F.trim(F.substring_index(F.coalesce(c, F.lit("")), ";", 1)))


def base_name(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)


def file_extension(name: Column) -> Column:
    """Behind the last dot of the last path segment, lower-cased; blank without a dot."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]*)$", 1))


def script_extension(name: Column) -> Column:
    """As `file_extension`, but a makefile's whole name."""
    base = F.lower(base_name(name))
    return F.when(base.isin("makefile", "gnumakefile"), base).otherwise(file_extension(name))


# Interpreters in the order they are looked for, and the script type of each.
_INTERPRETERS = (
    ("bash", "shell"), ("zsh", "shell"), ("dash", "shell"), ("ksh", "shell"), ("sh", "shell"), ("python3", "python"),
    ("python", "python"), ("nodejs", "node"), ("node", "node"), ("ruby", "ruby"), ("perl", "perl"), ("php", "php"),
)
# Script type, its extensions, its MIME type.
SCRIPTS = (
    ("shell", ("sh", "bash", "zsh", "ksh"), "text/x-shellscript"),
    ("python", ("py",), "text/x-python"),
    ("node", ("js", "mjs", "cjs"), "text/javascript"),
    ("ruby", ("rb",), "text/x-ruby"),
    ("perl", ("pl",), "text/x-perl"),
    ("php", ("php",), "application/x-httpd-php"),
    ("powershell", ("ps1", "psm1", "psd1"), "text/x-powershell"),
    ("batch", ("bat", "cmd"), "application/x-bat"),
    ("make", ("makefile", "gnumakefile"), "text/x-makefile"),
)


def detect_script(content: Column, name: Column, policy: Policy = Policy()) -> Column:
    """(detected, type, extension, mime): by a `#!` line of the inspected bytes, else by extension.

    A `#!` line of no known interpreter keeps the extension's type, else shell.
    """
    ext = script_extension(name)
    by_ext = F.coalesce(*[F.when(ext.isin(*exts), kind) for kind, exts, _ in SCRIPTS])
    first = F.decode(F.substring(F.coalesce(content, F.lit(b"")), 1, policy.inspected_bytes), "ISO-8859-1")
    has_line = first.startswith("#!")
    line = F.lower(F.substring_index(first, "\n", 1))
    by_line = F.coalesce(*[F.when(line.contains("/" + i) | line.contains("env " + i), kind) for i, kind in _INTERPRETERS], by_ext, F.lit("shell"))
    kind = F.when(has_line, by_line).otherwise(by_ext)
    mime = F.coalesce(*[F.when(kind == k, m) for k, _, m in SCRIPTS])
    return F.struct(kind.isNotNull().alias("detected"), kind.alias("type"), ext.alias("extension"), mime.alias("mime"))


def script_allowed(script: Column, policy: Policy) -> Column:
    by_type = script["type"].isin(*policy.allowed_script_types) if policy.allowed_script_types else F.lit(False)
    by_ext = script["extension"].isin(*policy.allowed_script_extensions) if policy.allowed_script_extensions else F.lit(False)
    return F.coalesce(by_type, F.lit(False)) | F.coalesce(by_ext, F.lit(False))


# Published file signatures as (offset, hexadecimal bytes, MIME type), first match wins.
_SIGNATURES = (
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (8, "57454250", "image/webp"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (0, "38425053", "image/vnd.adobe.photoshop"),
    (0, "FF0A", "image/jxl"),
    (0, "0000000C4A584C200D0A870A", "image/jxl"),
    (0, "0000000C6A5020200D0A870A", "image/jp2"),
    (4, "6674797061766966", "image/avif"),
    (4, "6674797068656963", "image/heic"),
    (4, "667479706D696631", "image/heif"),
    (4, "6674797071742020", "video/quicktime"),
    (4, "66747970", "video/mp4"),
    (0, "1A45DFA3", "video/x-matroska"),
    (8, "41564920", "video/x-msvideo"),
    (8, "57415645", "audio/wav"),
    (0, "4F676753", "audio/ogg"),
    (0, "664C6143", "audio/flac"),
    (0, "494433", "audio/mpeg"),
    (0, "000001BA", "video/mpeg"),
    (0, "25504446", "application/pdf"),
    (0, "504B0304", "application/zip"),
    (0, "504B0506", "application/zip"),
    (0, "1F8B", "application/gzip"),
    (0, "28B52FFD", "application/zstd"),
    (0, "425A68", "application/x-bzip2"),
    (0, "FD377A585A00", "application/x-xz"),
    (0, "377ABCAF271C", "application/x-7z-compressed"),
    (257, "7573746172", "application/x-tar"),
    (0, "7B5C727466", "text/rtf"),
    (0, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
    (0, "7F454C46", "application/x-elf"),
    (0, "FEEDFACE", "application/x-mach-binary"),
    (0, "FEEDFACF", "application/x-mach-binary"),
    (0, "CEFAEDFE", "application/x-mach-binary"),
    (0, "CFFAEDFE", "application/x-mach-binary"),
    (0, "4D5A", "application/vnd.microsoft.portable-executable"),
    (0, "424D", "image/bmp"),
)
_HTML_STARTS = ("<!doctype html", "<html", "<head", "<script", "<iframe", "<h1", "<div", "<font", "<table", "<a ", "<style", "<title", "<body", "<br", "<p>", "<!--")


def detect_mime(content: Column, policy: Policy = Policy(), is_json: Column | None = None) -> Column:
    """MIME type by the first bytes: published signatures, then markup and text; empty content gives blank.

    What begins like JSON is parsed as a whole, however long it is; where `content` is only the
    start of something, `is_json` says whether it may go on as JSON.

    Types without a signature here are `text/plain` if no byte is a control
    sign, else `application/octet-stream`.
    """
    most = policy.inspected_bytes
    # a signature takes its own bytes from the content, and the looks at the text share one
    options = [F.when(F.substring(content, at + 1, max(0, min(len(sig) // 2, most - at))) == F.lit(bytes.fromhex(sig)), mime) for at, sig, mime in _SIGNATURES]
    start = r"^(?:ï»¿)?[\t\n\f\r ]*"
    html = "|".join(re.escape(x) for x in _HTML_STARTS)

    def by_text(text: Column) -> Column:
        json = text.rlike(start + r"[{\[]") & F.try_parse_json(F.decode(content, "ISO-8859-1")).isNotNull() if is_json is None else is_json
        return F.coalesce(
            F.when(text.rlike(f"{start}(?i:{html})"), "text/html"),
            F.when(text.rlike(rf"(?s){start}(?i:<svg|<\?xml.*<svg)"), "image/svg+xml"),
            F.when(text.rlike(rf"{start}(?i:<\?xml)"), "text/xml"),
            F.when(
                ~text.rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"),
                F.when(json, "application/json").when(text.rlike(r"^#![^\n]*python"), "text/x-python").otherwise("text/plain"),
            ),
        )

    options.append(let(F.decode(F.substring(content, 1, most), "ISO-8859-1"), by_text))
    return F.when(F.coalesce(F.octet_length(F.substring(content, 1, most)), F.lit(0)) == 0, "").otherwise(F.coalesce(*options, F.lit(OCTETS)))


# Name suffixes, MIME types and first bytes of archive kinds.
_ARCHIVE_MIMES = (
    ("zip", ("application/zip", DOCX, XLSX, PPTX, ODT, ODS, ODP)),
    ("gzip", ("application/gzip", "application/x-gzip")),
    ("tar", ("application/x-tar",)),
    ("bzip2", ("application/x-bzip2",)),
    ("xz", ("application/x-xz",)),
    ("zstd", ("application/zstd", "application/x-zstd")),
    ("brotli", ("application/x-brotli", "application/br")),
    ("7z", ("application/x-7z-compressed",)),
)
_ARCHIVE_NAMES = (
    ("gzip", (".tar.gz", ".tgz", ".gz", ".gzip")),
    ("bzip2", (".tar.bz2", ".tbz2", ".bz2")),
    ("xz", (".tar.xz", ".txz", ".xz")),
    ("zstd", (".tar.zst", ".tzst", ".zst", ".zstd")),
    ("brotli", (".br",)),
    ("tar", (".tar",)),
    ("zip", (".zip", ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp")),
    ("7z", (".7z",)),
)
_ARCHIVE_STARTS = (("zip", "504B0304"), ("zip", "504B0506"), ("gzip", "1F8B"), ("bzip2", "425A68"), ("xz", "FD377A585A00"), ("zstd", "28B52FFD"), ("7z", "377ABCAF271C"))


def archive_kind(mime: Column, name: Column, content: Column) -> Column:
    """One of eight kinds by MIME type, then name suffix, then first bytes; null for no archive."""
    mime, low = normalize_mime(mime), F.lower(F.coalesce(name, F.lit("")))
    options = [F.when(mime.isin(*mimes), kind) for kind, mimes in _ARCHIVE_MIMES]
    options += [F.when(_any(low.endswith(s) for s in suffixes), kind) for kind, suffixes in _ARCHIVE_NAMES]
    options += [F.when(F.substring(content, 1, len(sig) // 2) == F.lit(bytes.fromhex(sig)), kind) for kind, sig in _ARCHIVE_STARTS]
    return F.coalesce(*options)


# Extensions and MIME types of each family; either is enough.
_FAMILIES = {
    "image": (("jpg", "jpeg", "png", "gif", "webp", "avif", "tif", "tiff", "bmp", "svg"), ()),
    "video": (("mp4", "mov", "m4v", "avi", "mkv", "webm"), ()),
    "jpeg": (("jpg", "jpeg"), ("image/jpeg", "image/pjpeg")),
    "png": (("png",), ("image/png",)),
    "webp": (("webp",), ("image/webp",)),
    "svg": (("svg",), ("image/svg+xml",)),
    "pdf": (("pdf",), ("application/pdf",)),
    "ooxml": (("docx", "xlsx", "pptx"), (DOCX, XLSX, PPTX)),
    "odf": (("odt", "ods", "odp"), (ODT, ODS, ODP)),
    "legacy_office": (("doc", "xls", "ppt"), ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint")),
    "rtf": (("rtf",), ("application/rtf", "text/rtf", "application/x-rtf", "text/richtext")),
    "markdown": (("md", "markdown"), ("text/markdown",)),
    "html": (("html", "htm", "xhtml"), ("text/html", "application/xhtml+xml")),
    "xml": (("xml",), ("application/xml", "text/xml")),
}


def file_family(mime: Column, name: Column) -> dict[str, Column]:
    """A boolean column for each of fourteen families."""
    mime, ext = normalize_mime(mime), file_extension(name)
    extra = {"image": mime.startswith("image/"), "video": mime.startswith("video/"), "xml": mime.endswith("+xml")}
    return {family: ext.isin(*exts) | (mime.isin(*mimes) if mimes else F.lit(False)) | extra.get(family, F.lit(False)) for family, (exts, mimes) in _FAMILIES.items()}


def family_mode(mime: Column, name: Column, policy: Policy) -> Column:
    """The sanitisation mode of an object's family, without per-type overrides."""
    f = file_family(mime, name)
    return (
        F.when(f["svg"], policy.svg_mode)
        .when(f["html"] | f["markdown"] | f["xml"], policy.markup_mode)
        .when(f["image"] | f["video"], policy.media_mode)
        .when(f["pdf"] | f["ooxml"] | f["odf"], policy.office_mode)
        .when(f["legacy_office"] | f["rtf"], policy.legacy_mode)
        .otherwise(policy.default_mode)
    )


def sanitization_mode(df: DataFrame, mime: str, name: str, modes: DataFrame, policy: Policy, out: str = "mode") -> DataFrame:
    """`df` with the mode of each object: by MIME type, by extension, by dotted extension, else its family's.

    `modes` is the policy's (name, mode) relation.
    """
    keys = {"_by_mime": normalize_mime(F.col(mime)), "_by_ext": file_extension(F.col(name)), "_by_dot": F.concat(F.lit("."), file_extension(F.col(name)))}
    found = df
    for key, value in keys.items():
        side = F.broadcast(modes.select(F.col("name").alias(f"{key}_name"), F.col("mode").alias(key)))
        found = found.withColumn(f"{key}_value", value).join(side, F.col(f"{key}_value") == F.col(f"{key}_name"), "left").drop(f"{key}_value", f"{key}_name")
    return found.withColumn(out, F.coalesce(*keys, family_mode(F.col(mime), F.col(name), policy))).drop(*keys)


def extraction_route(mime: Column) -> Column:
    """How text is taken from an object: text, ooxml, pdf, image or other."""
    mime = normalize_mime(mime)
    texts = ("application/json", "application/xml", "application/x-ndjson", "application/yaml", "application/x-yaml", "application/javascript", "application/xhtml+xml")
    return (
        F.when(mime.startswith("text/") | mime.isin(*texts), "text")
        .when(mime.isin(DOCX, XLSX, PPTX), "ooxml")
        .when(mime == "application/pdf", "pdf")
        .when(mime.startswith("image/"), "image")
        .otherwise("other")
    )


def extraction_tasks(mime: Column, has_ocr: bool = False, has_extractor: bool = False) -> Column:
    """The kinds of extraction work an object gets: text, metadata, ocr."""
    route = extraction_route(mime)
    text = route.isin("text", "ooxml", "pdf") | (F.lit(has_extractor) & (route == "other"))
    metadata = route.isin("ooxml", "pdf", "image")
    return F.array_compact(F.array(F.when(text, "text"), F.when(metadata, "metadata"), F.when((route == "image") & F.lit(has_ocr), "ocr")))


# Types a thumbnail is made for.
THUMBNAILS = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/avif", "image/tiff", "image/bmp", "image/heic", "image/heif", "image/svg+xml", "application/pdf", DOCX, XLSX, PPTX, "video/mp4", "video/quicktime", "video/webm", "video/x-matroska", "video/x-msvideo", "video/mpeg")


def thumbnail_eligible(mime: Column) -> Column:
    return normalize_mime(mime).isin(*THUMBNAILS)


def safe_segment(name: Column) -> Column:
    """A name fit for a key: last segment, unsafe runs to `-`, cut to 180, blank to `file`."""
    dashed = F.regexp_replace(base_name(F.trim(F.coalesce(name, F.lit("")))), "[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(dashed, "^[._-]+|[._-]+$", "")
    return F.substring(F.coalesce(blank_to_null(trimmed), F.lit("file")), 1, 180)


def task_key(kind: Column, key: Column) -> Column:
    return F.sha2(F.concat(kind.cast("binary"), F.lit(b"\0"), key.cast("binary")), 256)


def object_keys(upload: Column, name: Column, prefix: str = "", policy: Policy = Policy()) -> Column:
    """The keys of an upload: object, staged body, marker, thumbnail and extracted text."""
    head = F.lit(prefix.strip("/") + "/" if prefix.strip("/") else "")
    key = F.concat(head, upload, F.lit("/"), safe_segment(name))
    return F.struct(
        key.alias("object_key"),
        F.concat(F.lit(".uploading/"), upload, F.lit("/content")).alias("temp_key"),
        F.concat(F.lit(".uploading/"), upload, F.lit(".json")).alias("marker_key"),
        F.concat(key, F.lit(policy.thumbnail_suffix)).alias("thumbnail_key"),
        F.concat(key, F.lit(policy.text_suffix)).alias("text_key"),
    )


def owner_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def clean_archive_path(name: Column) -> Column:
    """(path, safe): the lexically cleaned entry name and whether it stays inside the archive.

    Unsafe: empty, absolute, with a backslash or drive prefix, or leading out.
    """
    name = F.coalesce(name, F.lit(""))
    parts = F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))
    cleaned = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(F.concat(s, F.array(F.lit(""))), F.greatest(F.size(s), F.lit(1))) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))),
        lambda s: F.array_join(s, "/"),
    )
    bad = (name == "") | name.startswith("/") | name.contains("\\") | name.rlike("^[A-Za-z]:") | (cleaned == "") | (cleaned == "..") | cleaned.startswith("../")
    return F.struct(cleaned.alias("path"), (~bad).alias("safe"))


def displayed_bytes(n: Column, size: Column, held: Column) -> Column:
    """Progress shown: while held, at most 98 % of a known size."""
    return F.when(held & (size > 0), F.least(n, F.expr("1L") * F.floor(size * 98 / 100))).otherwise(n).cast("long")


def effective_limit(a: Column, b: Column) -> Column:
    """The smaller of two positive limits, else 1 GiB."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(F.least(positive(a), positive(b)), F.lit(1 << 30)).cast("long")


TERMINAL = ("uploaded", "failed", "expired", "canceled")


def transition_check(status: Column, action: Column, is_owner: Column) -> Column:
    """The verdict (status, code) of an action on an upload, null if it may go on.

    Only the owner cancels, and only before any byte came; what is uploaded or
    canceled takes no further upload.
    """
    say = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    return (
        F.when((action == "cancel") & ~is_owner, say(403, "forbidden"))
        .when((action == "cancel") & (status != "key_created"), say(409, "upload_not_cancelable"))
        .when((action == "upload") & (status == "uploaded"), say(409, "upload_already_completed"))
        .when((action == "upload") & (status == "canceled"), say(410, "upload_canceled"))
    )


# Request paths as (prefix, suffix, route), first match wins.
_ROUTES = (
    ("/v1/uploads/keys/", "/content", "/v1/uploads/keys/{key}/content"),
    ("/v1/uploads/keys/", "/cancel", "/v1/uploads/keys/{key}/cancel"),
    ("/v1/uploads/keys/", "", "/v1/uploads/keys/{key}"),
    ("/v1/uploads/wait", "", "/v1/uploads/wait"),
    ("/v1/tasks/wait", "", "/v1/tasks/wait"),
    ("/v1/objects/", "/extracted", "/v1/objects/{key}/extracted"),
    ("/v1/objects/", "", "/v1/objects/{key}"),
    ("/v1/shared/", "", "/v1/shared/{key}"),
    ("/healthz", "", "/healthz"),
)


def route_template(path: Column) -> Column:
    options = [F.when(path.startswith(p) & path.endswith(s) if s else path.startswith(p), r) for p, s, r in _ROUTES]
    return F.coalesce(*options, F.lit("other"))


def path_escape(key: Column) -> Column:
    """Each path segment percent-encoded; `$&+=:@` stay."""
    kept = {"%24": "$", "%26": "&", "%2B": "+", "%3D": "=", "%3A": ":", "%40": "@", "%7E": "~"}

    def segment(s: Column) -> Column:
        out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
        for code, sign in kept.items():
            out = F.replace(out, F.lit(code), F.lit(sign))
        return F.replace(out, F.lit("*"), F.lit("%2A"))

    return F.array_join(F.transform(F.split(key, "/"), segment), "/")


def object_urls(key: Column, base: str = "", policy: Policy = Policy()) -> Column:
    base, escaped = base.rstrip("/"), path_escape(key)
    return F.struct(
        F.concat(F.lit(base + "/"), escaped).alias("public"),
        F.concat(F.lit(base + "/v1/objects/"), escaped).alias("proxy"),
        F.concat(F.lit(base + "/v1/objects/"), escaped, F.lit(policy.thumbnail_suffix)).alias("thumbnail"),
        F.concat(F.lit(base + "/v1/shared/"), escaped).alias("shared"),
    )


def scanner_verdict(response: Column) -> Column:
    """Null for a clean scan, else `malware_detected` or `virus_scan_failed`."""
    said = F.trim(F.regexp_replace(F.coalesce(response, F.lit("")), "\\x00", ""))
    return F.when(said.endswith(" OK") | (said == "OK"), None).when(said.contains("FOUND"), "malware_detected").otherwise("virus_scan_failed")


def thumbnail_size(w: Column, h: Column, box_w: Column, box_h: Column, fit: str = "contain", upscale: bool = False) -> Column:
    """(width, height) of a thumbnail in a box: contained whole, or covering it and cropped."""
    sx, sy = box_w / w, box_h / h
    scale = F.greatest(sx, sy) if fit == "cover" else F.least(sx, sy)
    if not upscale:
        scale = F.least(scale, F.lit(1.0))
    side = lambda x: F.greatest(F.floor(x * scale + 0.5), F.lit(1)).cast("int")
    tw, th = side(w), side(h)
    if fit == "cover":
        tw, th = F.least(tw, box_w.cast("int")), F.least(th, box_h.cast("int"))
    return F.when((w > 0) & (h > 0), F.struct(tw.alias("width"), th.alias("height")))


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    raw = F.hex(F.substring(content, at + 1, size))
    if little:
        raw = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(raw, 16, 10).cast("int")


def image_dimensions(content: Column) -> Column:
    """(width, height) from the header of a PNG, GIF or BMP; null for other types."""
    starts = lambda sig: F.substring(content, 1, len(sig) // 2) == F.lit(bytes.fromhex(sig))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return (
        F.when(starts("89504E470D0A1A0A") & (F.octet_length(content) >= 24), pair(_number(content, 16, 4), _number(content, 20, 4)))
        .when(starts("47494638") & (F.octet_length(content) >= 10), pair(_number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when(starts("424D") & (F.octet_length(content) >= 26), pair(_number(content, 18, 4, True), _number(content, 22, 4, True)))
    )


# Pixels of a length unit.
_UNITS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6, "pt": 96 / 72, "pc": 16.0}


def svg_length(value: Column) -> Column:
    """Pixels of a length, null for a percentage or a bad number."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    number = F.regexp_extract(low, r"^([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)\s*([a-z]*)$", 1)
    unit = F.regexp_extract(low, r"^([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)\s*([a-z]*)$", 2)
    scale = F.coalesce(*[F.when(unit == u, F.lit(x)) for u, x in _UNITS.items()])
    size = blank_to_null(number).try_cast("double") * scale
    return F.when(size > 0, size)


def svg_dimensions(width: Column, height: Column, view_box: Column) -> Column:
    """(width, height) of an SVG root; its view box fills a missing side."""
    box = F.split(F.trim(F.regexp_replace(F.coalesce(view_box, F.lit("")), "[,\\s]+", " ")), " ")
    side = lambda i: F.when(F.size(box) == 4, F.get(box, F.lit(i)).try_cast("double"))
    fill = lambda c, i: F.coalesce(svg_length(c), F.when(side(i) > 0, side(i)))
    return F.struct(fill(width, 2).alias("width"), fill(height, 3).alias("height"))


def split_list(c: Column) -> Column:
    """Comma-separated items, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def normalize_switches(switches: Column, extensions: bool = False) -> Column:
    """A map of switches with trimmed lower-case names, blanks dropped, the last of equal names kept."""
    name = lambda k: F.regexp_replace(F.lower(F.trim(k)), "^\\.", "") if extensions else F.lower(F.trim(k))
    entries = F.filter(F.transform(F.map_entries(switches), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(last)
