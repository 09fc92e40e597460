"""Screening cases: scripts, type and extension mismatches, markup, SVG, PDF, packages, images."""

import io
import struct
import zipfile
import zlib

import pytest

from tidegate.operators.screen import declared_compatible, screen
from tidegate.policy import DOCX, ODT, Policy

PAIRS = [
    ("text/plain", "application/json", "", True),
    ("text/plain", "application/geo+json", "", True),
    ("text/plain", "text/x-python", "", True),
    ("application/json", "text/plain", "", True),
    ("application/geo+json", "text/plain", "", True),
    ("image/svg+xml", "text/plain", "", True),
    ("text/csv", "text/plain", "", True),
    ("text/markdown", "text/html", "", True),
    ("application/octet-stream", "text/plain", "", True),
    ("application/octet-stream", "application/x-elf", "", True),
    ("image/png", "text/plain", "", False),
    ("text/plain", "text/html", "", False),
    ("", "text/plain", "", False),
    ("text/plain", "", "", False),
    ("application/octet-stream", "text/html", "README.rst", False),
    ("application/octet-stream", "text/plain", "README.rst", True),
    (DOCX, "application/zip", "a.docx", True),
    ("text/markdown", "text/html", "a.md", True),
]


def test_compatible_pairs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(PAIRS, "declared string, detected string, name string, want boolean")
    rows = df.withColumn("got", declared_compatible(F.col("declared"), F.col("detected"), F.col("name"))).collect()
    assert [(r.declared, r.detected, r.name) for r in rows if r.got != r.want] == []


def png(width, height, extra=b"", crc_ok=True):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) ^ (not crc_ok))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"\0" * 4)) + chunk(b"IEND", b"")


def text_chunk(key, value):
    data = key + b"\0" + value
    return struct.pack(">I", len(data)) + b"tEXt" + data + struct.pack(">I", zlib.crc32(b"tEXt" + data))


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


TYPES = f'<Types><Override PartName="/word/document.xml" ContentType="{DOCX}.main+xml"/></Types>'
GOOD_DOCX = {"[Content_Types].xml": TYPES, "word/document.xml": "<w:document xmlns:w='w'><w:t>hi</w:t></w:document>"}
MANIFEST = f'<manifest:manifest xmlns:manifest="m"><manifest:file-entry manifest:full-path="/" manifest:media-type="{ODT}"/></manifest:manifest>'
GOOD_ODT = {"mimetype": ODT, "META-INF/manifest.xml": MANIFEST, "content.xml": "<a/>"}
SVG = '<svg xmlns="http://www.w3.org/2000/svg" {}>{}</svg>'

CASES = {
    "Makefile": ("text/plain", b"echo hello\n", {}, "script_upload_rejected"),
    "build.bat": ("text/plain", b"echo hello\n", {}, "script_upload_rejected"),
    "deploy.ps1": ("text/plain", b"echo hello\n", {}, "script_upload_rejected"),
    "a/Makefile": ("text/plain", b"echo hello\n", {"allowed_script_types": ("make",)}, None),
    "fake.jpg": ("image/jpeg", b"\x7fELF\x02\x01\x01" + b"\0" * 64, {}, "content_type_mismatch"),
    "photo.jpg": ("image/png", png(2, 1), {}, "file_extension_mismatch"),
    "good.png": ("image/png", png(2, 1), {}, None),
    "crc.png": ("image/png", png(2, 1, crc_ok=False), {}, "structural_validation_failed"),
    "wide.png": ("image/png", png(2, 1), {"max_image_width": 1}, "resource_limit_exceeded"),
    "meta.png": ("image/png", png(2, 1, text_chunk(b"Title", b"x")), {"media_mode": "reject_on_sensitive_metadata"}, "sensitive_metadata_detected"),
    "note.md": ("text/markdown", b"# Title\n\n<script>alert(1)</script>\n", {}, "markup_script_detected"),
    "page.html": ("text/html", b"<html><script>alert(1)</script></html>", {}, "markup_script_detected"),
    "bad.html": ("text/html", b'<html><body><iframe src="https://example.test"></iframe></body></html>', {}, "markup_iframe_detected"),
    "on.html": ("text/html", b"<html><body><p onclick=x></p></body></html>", {}, "markup_event_handler_detected"),
    "fine.html": ("text/html", b"<html><body>hi</body></html>", {}, None),
    "doc.xml": ("application/xml", b'<?xml version="1.0"?><!DOCTYPE a [<!ENTITY xxe SYSTEM "file:///etc/passwd">]><a>&xxe;</a>', {}, "xml_external_entity_detected"),
    "broken.xml": ("application/xml", b'<?xml version="1.0"?><a><b></a>', {}, "structural_validation_failed"),
    "deep.xml": ("application/xml", b'<?xml version="1.0"?><a><b><c/></b></a>', {"max_xml_depth": 2}, "markup_parser_limit_exceeded"),
    "ok.xml": ("application/xml", b'<?xml version="1.0"?><a><b/></a>', {}, None),
    "bad.svg": ("image/svg+xml", SVG.format('onload="x()"', "<script/>").encode(), {}, "svg_active_content_rejected"),
    "script.svg": ("image/svg+xml", SVG.format("", "<script/>").encode(), {}, "svg_script_detected"),
    "ref.svg": ("image/svg+xml", SVG.format("", '<image href="https://x/y.png"/>').encode(), {}, "svg_external_reference_detected"),
    "wide.svg": ("image/svg+xml", SVG.format('width="11" height="1"', "").encode(), {"max_image_width": 10}, "resource_limit_exceeded"),
    "pixels.svg": ("image/svg+xml", SVG.format('viewBox="0 0 10 10"', "").encode(), {"max_image_pixels": 99}, "resource_limit_exceeded"),
    "active.pdf": ("application/pdf", b"%PDF-1.7\n<< /OpenAction << /S /JavaScript /JS (x) >> >>", {}, "document_active_content_rejected"),
    "fine.pdf": ("application/pdf", b"%PDF-1.7\n1 0 obj\n<<>>\nendobj\n%%EOF", {}, None),
    "macro.docx": (DOCX, zipped(GOOD_DOCX | {"word/vbaProject.bin": "x"}), {}, "document_active_content_rejected"),
    "good.docx": (DOCX, zipped(GOOD_DOCX), {}, None),
    "notypes.docx": (DOCX, zipped({"word/document.xml": "<a/>"}), {}, "structural_validation_failed"),
    "nomain.docx": (DOCX, zipped({"[Content_Types].xml": TYPES}), {}, "structural_validation_failed"),
    "good.odt": (ODT, zipped(GOOD_ODT), {}, None),
    "bad.odt": (ODT, zipped(GOOD_ODT | {"mimetype": ODT + "x"}), {}, "structural_validation_failed"),
    "active.odt": (ODT, zipped(GOOD_ODT | {"content.xml": "<a><script:event-listener/></a>"}), {}, "document_active_content_rejected"),
    "doc.rtf": ("application/rtf", b"{\\rtf1\\ansi hello}", {}, "legacy_document_rejected"),
    "kept.rtf": ("application/rtf", b"{\\rtf1\\ansi hello}", {"legacy_mode": "accept_as_is"}, None),
    "legacy.doc": ("application/msword", bytes.fromhex("D0CF11E0A1B11AE1") + b"doc", {}, "legacy_office_rejected"),
}


def test_cases(spark):
    groups = {}
    for name, (declared, content, limits, want) in CASES.items():
        groups.setdefault(tuple(sorted(limits.items())), []).append((name, name, declared, content, want))
    wrong = {}
    for limits, rows in groups.items():
        df = spark.createDataFrame([r[:4] for r in rows], "object_key string, original_name string, declared_type string, content binary")
        got = {r.object_key: r.verdict for r in screen(df, Policy(**dict(limits))).collect()}
        wrong |= {r[0]: (got.get(r[0]), r[4]) for r in rows if got.get(r[0]) != r[4]}
    assert wrong == {}


def test_explain_names_all_rules(spark):
    df = spark.createDataFrame([("k", "photo.jpg", "image/gif", png(2, 1))], "object_key string, original_name string, declared_type string, content binary")
    row = screen(df, explain=True).first()
    assert (row.rule_declared, row.rule_extension, row.verdict) == ("content_type_mismatch", "file_extension_mismatch", "content_type_mismatch")


def test_empty_table(spark):
    df = spark.createDataFrame([], "object_key string, original_name string, declared_type string, content binary")
    assert screen(df).count() == 0


@pytest.mark.parametrize("mode,want", [("sanitize_when_supported", "sanitizer_unavailable"), ("accept_as_is", None)])
def test_modes(spark, mode, want):
    df = spark.createDataFrame([("k", "a.html", "text/html", b"<html><script></script></html>")], "object_key string, original_name string, declared_type string, content binary")
    assert screen(df, Policy(markup_mode=mode)).first().verdict == want


def test_contents_stay_where_they_are_read(spark):
    """One job unpacks, and no exchange carries contents."""
    df = spark.createDataFrame([("k", "a.docx", DOCX, b"x")], "object_key string, original_name string, declared_type string, content binary")
    plan = screen(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = screen(df).sparkSession._jvm.PythonSQLUtils.explainString(screen(df)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    carried = [b for b in physical.split("\n\n") if b.split("\n")[0].endswith(("Exchange", "BroadcastExchange")) and ") " in b]
    assert carried and not any("content#" in b.split("Arguments")[0] for b in carried)


def test_repeated_keys_are_judged_each(spark):
    rows = [("k", "a.html", "text/html", b"<html><script></script></html>", 1), ("k", "a.html", "text/html", b"<html>fine</html>", 2), (None, "n.txt", None, None, 3)]
    df = spark.createDataFrame(rows, "object_key string, original_name string, declared_type string, content binary, _html int")
    got = screen(df).collect()
    assert sorted((r.object_key or "", r.verdict or "") for r in got) == [("", "file_extension_mismatch"), ("k", ""), ("k", "markup_script_detected")]
