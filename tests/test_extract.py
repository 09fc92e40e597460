"""Extraction, text functions and user functions."""

import subprocess
import sys

from pyspark.sql import functions as F

from tidegate.functions import text as T
from tidegate.functions.classify import detect_mime
from tidegate.operators.extract import extract, with_extractor, with_ocr, with_scanner
from tidegate.operators.office import read_package
from tidegate.policy import DOCX, PPTX, XLSX, Policy

from .conftest import ROOT
from .test_screen import png, text_chunk, zipped

CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Doc Title</dc:title><dc:description>Doc Description</dc:description><dc:creator>Ann</dc:creator></cp:coreProperties>'
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><a:t>{}</a:t></p:sld>'
OBJECTS = [
    ("txt", "text/plain; charset=utf-8", b"hello\n"),
    ("bad", "text/plain", b"a\xff\xfe b\x00 \n"),
    ("pdf", "application/pdf", b"%PDF-1.4\n(fallback literal) Tj /Title (My \\(T\\))"),
    ("docx", DOCX, zipped({"word/document.xml": '<w:d xmlns:w="w"><w:t>document</w:t><w:t> body </w:t></w:d>', "docProps/core.xml": CORE})),
    ("pptx", PPTX, zipped({f"ppt/slides/slide{i}.xml": SLIDE.format(f"s{i}") for i in (2, 10)})),
    ("broken", DOCX, b"no zip"),
    ("png", "image/png", png(2, 1, text_chunk(b"Title", b"first") + text_chunk(b"title", b"Pic") + text_chunk(b"Comment", b"seen"))),
    ("mp4", "video/mp4", b"\0\0\0\x18ftypmp42"),
    ("empty", "text/plain", b""),
]


def objects(spark):
    return spark.createDataFrame(OBJECTS, "object_key string, content_type string, content binary")


def test_extract(spark):
    got = {r.object_key: r for r in extract(objects(spark)).collect()}
    texts = {k: dict(r.content.texts) for k, r in got.items()}
    assert texts["txt"] == {"text": "hello"}
    assert texts["bad"] == {"text": "a? b"} and got["bad"].content.sources["text"].warnings == ["invalid_utf8_replaced"]
    assert texts["pdf"] == {"extracted": "fallback literal\nMy (T)", "title": "My (T)"} and got["pdf"].content.sources["extracted"].backend == "pdf_literal_parser"
    assert texts["docx"] == {"extracted": "document body", "title": "Doc Title", "description": "Doc Description"} and got["docx"].content.metadata == {"creator": "Ann"}
    assert texts["pptx"] == {"extracted": "s10\ns2"}
    assert texts["png"] == {"title": "Pic", "description": "seen"}
    assert {k: r.status for k, r in got.items() if r.status != "generated"} == {"mp4": "skipped", "empty": "skipped", "broken": "failed"}
    assert got["broken"].error_code == "extract_failed" and got["mp4"].content.sources["extraction"].warnings == ["unsupported_content_type"]
    assert got["docx"].content.sources["title"].backend == "metadata_parser" and got["docx"].content.sources["extracted"].backend == "ooxml_parser"


def test_nothing_is_cut(spark):
    """Texts just beyond what limits of other jobs would let through."""
    runs = "".join(f"<w:t>r{i}</w:t>" for i in range(150_000))
    many = {f"word/media/{i}": "x" for i in range(10_050)} | {"word/document.xml": f'<w:d xmlns:w="w">{runs}</w:d>'}
    long = text_chunk(b"Description", b"d" * 6000)
    rows = [("docx", DOCX, zipped(many)), ("png", "image/png", png(2, 1, long))]
    got = {r.object_key: r for r in extract(spark.createDataFrame(rows, "object_key string, content_type string, content binary")).collect()}
    assert got["docx"].content.texts["extracted"].split() == [f"r{i}" for i in range(150_000)]
    assert got["png"].content.texts["description"] == "d" * 6000
    json = "[" + "1, " * 3000 + "1]"
    kinds = spark.createDataFrame([(json.encode(),), (json[:-1].encode(),)], "content binary").select(detect_mime(F.col("content"))).collect()
    assert [r[0] for r in kinds] == ["application/json", "text/plain"]


def test_limits(spark):
    rows = {r.object_key: r for r in extract(objects(spark).where("object_key in ('txt', 'pdf')"), Policy(max_extract_bytes=10)).collect()}
    assert (rows["pdf"].status, rows["pdf"].error_code, rows["txt"].status) == ("failed", "input_too_large", "generated")


def test_cut_bytes(spark):
    df = spark.createDataFrame([("aé日🙂",)], "t string")
    assert [df.select(T.cut_bytes(F.col("t"), n)).first()[0] for n in range(11)] == ["", "a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日🙂"]


def test_user_functions(spark):
    def external(body, mime):
        if b"ftyp" in body:
            return "movie words"
        raise ValueError("no")

    got = {r.object_key: r for r in with_extractor(objects(spark), external).collect()}
    assert (got["mp4"].status, dict(got["mp4"].content.texts)) == ("generated", {"extracted": "movie words"})
    assert got["broken"].warning == "external_fallback_failed" and got["txt"].status == "generated"

    def slow(body, mime):
        raise TimeoutError

    ocr = with_ocr(objects(spark), slow).collect()
    assert [(r.object_key, r.ocr, r.ocr_error) for r in ocr] == [("png", None, "timeout")]
    codes = {r.object_key: r.code for r in with_scanner(objects(spark), lambda b, m: "stream: X FOUND" if b"fallback" in b else "stream: OK").collect()}
    assert codes.pop("pdf") == "malware_detected" and set(codes.values()) == {None}


def test_huge_parts_are_read_piece_by_piece():
    """300 MB in one part of a small package: 32 MB of it count, and a worker holds a fraction of that."""
    code = """
import io, resource, zipfile
from tidegate.operators.office import read_package
from tidegate.policy import DOCX, Policy
out, info = io.BytesIO(), zipfile.ZipInfo("word/document.xml")
info.compress_type = zipfile.ZIP_DEFLATED
with zipfile.ZipFile(out, "w") as z:
    with z.open(info, "w") as f:
        f.write(b"<d><t>first</t>")
        for _ in range(300):
            f.write(b"<t> </t>" * (1 << 17))
        f.write(b"<t>last</t></d>")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text, core, broken = read_package(out.getvalue(), DOCX, Policy())
print(len(out.getvalue()) < 1 << 21, text, core, broken, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "first", "None", "False", "True"], out.stderr


def test_office_texts_end_at_the_output_limit():
    words = "".join(f"<t>word{i}</t>" for i in range(200_000))
    data = zipped({"word/document.xml": f"<d>{words}</d>"})
    text, _, broken = read_package(data, DOCX, Policy(max_output_bytes=1000))
    assert not broken and text.startswith("word0 word1 ") and 1000 < len(text) < 200_000
    text, core, _ = read_package(zipped({"xl/sharedStrings.xml": "<s>a<!-- -->b<![CDATA[c]]> d<i> e\n</i>", "docProps/core.xml": CORE}), XLSX, Policy())
    assert text == "a b c d e" and core == CORE.encode()
    slides = {f"ppt/slides/slide{i}.xml": SLIDE.format(f"s{i}") for i in (3, 1)} | {"ppt/slides/_rels/slide1.xml.rels": "<r>no</r>", "word/document.xml": "<d>no</d>"}
    assert read_package(zipped(slides), PPTX, Policy())[0] == "s1\ns3"
    assert read_package(b"", PPTX, Policy()) == (None, None, True)


def test_repeated_keys_and_contents_left_behind(spark):
    """Rows of one key are worked out each; no exchange carries contents."""
    rows = [("a", DOCX, zipped({"word/document.xml": f"<d>{w}</d>"})) for w in ("one", "two")] + [("a", "text/plain", b"three"), ("b", "image/png", png(2, 1, text_chunk(b"Title", b"t"))), ("b", "image/png", b"x")]
    found = extract(spark.createDataFrame(rows, "object_key string, content_type string, content binary"))
    texts = sorted(str(dict(r.content.texts)) for r in found.collect())
    assert texts == ["{'extracted': 'one'}", "{'extracted': 'two'}", "{'text': 'three'}", "{'title': 't'}", "{'title': 't'}"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1, plan


def test_policy_limits_do_not_touch_packages_within_them(spark):
    many = {f"word/media/{i}": "x" for i in range(50)} | {"word/document.xml": "<d>text</d>"}
    rows = [("a", DOCX, zipped(many))]
    got = extract(spark.createDataFrame(rows, "object_key string, content_type string, content binary"), Policy(max_entries=3, max_entry_bytes=1, max_total_bytes=1)).first()
    assert got.content.texts["extracted"] == "text"
