"""Queries over files of many kinds, each made of a whole text: media, markup, packages and archives through the rules."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.archive import inspect
from tidegate.operators.extract import extract, with_extractor, with_ocr, with_scanner
from tidegate.operators.screen import screen
from tidegate.plans.registry import query
from tidegate.plans.texts import LETTERS, made_bytes, number_bytes, plain_texts, png_chunk, stored_zip
from tidegate.policy import DOCX, ODT, Policy
from tidegate.sources.objects import write_extracted
from tidegate.sources.publish import published
from tidegate.sources.work import stage, work_path

_ROWS = f"texts as (select doc_id, {LETTERS} c from documents where lang is not null and text is not null)"


def _choose(options: list[Column]) -> Column:
    """The option that doc_id chooses, in turn."""
    n = F.col("doc_id") % len(options)
    chosen = F.when(n == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        chosen = chosen.when(n == i, option)
    return chosen


def _text(head: str, tail: str = "") -> Column:
    return F.encode(F.concat(F.lit(head), "c", F.lit(tail)), "UTF-8")


def _objects(rows: DataFrame, kinds: list[tuple[str, str, Column]]) -> DataFrame:
    """Each text as a file of one of the kinds (name, declared type, content), written down."""
    names, types, contents = zip(*kinds)
    made = rows.select(
        F.col("doc_id").cast("string").alias("object_key"), _choose([F.lit(n) for n in names]).alias("original_name"), _choose([F.lit(t) for t in types]).alias("declared_type"), _choose(list(contents)).alias("content")
    )
    return stage(made, "files")


def _png(*chunks: Column) -> Column:
    header = png_chunk("IHDR", made_bytes("00000001000000010802000000"))
    return F.concat(made_bytes("89504e470d0a1a0a"), header, *chunks, png_chunk("IEND", F.lit(b"")))


#: Kept as bytes: a column needs a session, and this module is imported before there is one.
_TYPES = f'<Types><Override PartName="/word/document.xml" ContentType="{DOCX}.main+xml"/></Types>'.encode()
_MANIFEST = f'<m:manifest xmlns:m="m"><m:file-entry m:full-path="/" m:media-type="{ODT}"/></m:manifest>'.encode()


def _with_packages(rows: DataFrame) -> DataFrame:
    """`rows` with `package`, the text in an office package of three parts: Word for 11 to 13 of 18 documents, else ODF."""
    n = F.col("doc_id") % 18
    word = n <= 13
    document, content = _text('<w:document xmlns:w="w"><w:t>', "</w:t></w:document>"), _text("<a>", "</a>")
    parts = {
        "name_1": F.when(word, "[Content_Types].xml").otherwise("mimetype"),
        "body_1": F.when(word, F.lit(_TYPES)).when(n == 14, F.lit(ODT.encode())).otherwise(F.lit(f"{ODT}x".encode())),
        "name_2": F.when(n == 13, "word/other.xml").when(word, "word/document.xml").otherwise("content.xml"),
        "body_2": F.when(word, document).otherwise(content),
        "name_3": F.when(n == 12, "word/vbaProject.bin").when(word, "word/styles.xml").otherwise("META-INF/manifest.xml"),
        "body_3": F.when(word, F.lit(b"<a/>")).otherwise(F.lit(_MANIFEST)),
    }
    # parts are columns first, as each is used many times in the package
    return rows.withColumns(parts).withColumn("package", stored_zip([(F.col(f"name_{i}"), F.col(f"body_{i}")) for i in (1, 2, 3)]))


def _kinds() -> list[tuple[str, str, Column]]:
    note = F.concat(F.lit(b"Comment\0"), F.encode("c", "UTF-8"))
    spoilt = F.concat(F.substring(png_chunk("tEXt", note), F.lit(1), F.octet_length(note) + 8), made_bytes("00000000"))
    svg = lambda inner, head="": _text(f'<svg xmlns="http://www.w3.org/2000/svg"{head}><text>', f"</text>{inner}</svg>")
    xml = lambda inner: _text('<?xml version="1.0"?><a><b>', f"</b>{inner}</a>")
    return [
        ("a.png", "image/png", _png(png_chunk("tEXt", note))),
        ("a.png", "image/png", _png(spoilt)),
        ("a.jpg", "image/jpeg", F.concat(made_bytes("ffd8ffe00004"), F.encode("c", "UTF-8"), made_bytes("00"))),
        ("a.svg", "image/svg+xml", svg("<script/>")),
        ("a.svg", "image/svg+xml", svg("")),
        ("a.svg", "image/svg+xml", svg('<image href="https://x/y.png"/>')),
        ("a.svg", "image/svg+xml", svg("", ' width="5001" height="1"')),
        ("a.xml", "application/xml", xml("")),
        ("a.xml", "application/xml", _text('<?xml version="1.0"?><a>')),
        ("a.xml", "application/xml", xml("<c><d><e/></d></c>")),
        ("a.xml", "application/xml", xml('<i:include xmlns:i="http://www.w3.org/2001/XInclude"/>')),
        ("a.docx", DOCX, F.col("package")),
        ("a.docx", DOCX, F.col("package")),
        ("a.docx", DOCX, F.col("package")),
        ("a.odt", ODT, F.col("package")),
        ("a.odt", ODT, F.col("package")),
        ("a.rtf", "application/rtf", _text("{\\rtf1\\ansi ", "}")),
        ("a.doc", "application/msword", F.concat(made_bytes("d0cf11e0a1b11ae1"), F.encode("c", "UTF-8"))),
    ]


@query(
    f"""with {_ROWS}, low as (select doc_id, doc_id % 18 k, lower(c) c from texts)
select doc_id, case k when 1 then 'structural_validation_failed' when 2 then 'structural_validation_failed' when 3 then 'svg_script_detected' when 5 then 'svg_external_reference_detected'
  when 6 then 'resource_limit_exceeded' when 8 then 'structural_validation_failed' when 9 then 'markup_parser_limit_exceeded' when 10 then 'xml_xinclude_detected'
  when 11 then case when regexp_matches(c, 'oleobject|activex|vba|externallink|attachedtemplate') then 'document_active_content_rejected' end
  when 12 then 'document_active_content_rejected' when 13 then 'structural_validation_failed' when 14 then case when contains(c, 'starbasic') then 'document_active_content_rejected' end
  when 15 then 'structural_validation_failed' when 16 then 'legacy_document_rejected' when 17 then 'legacy_office_rejected' end verdict from low"""
)
def screen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as images, vector images, XML, office packages and old formats, sound and broken, through all rules."""
    found = screen(_objects(_with_packages(plain_texts(spark, sf_dir)), _kinds()), Policy(max_xml_depth=3, max_image_width=5000))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "verdict")


def _segment(marker: str, data: Column) -> Column:
    return F.concat(made_bytes("ff" + marker), number_bytes(F.octet_length(data) + 2, 2, False), data)


def _riff_chunk(kind: str, data: Column) -> Column:
    pad = F.when(F.octet_length(data) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    return F.concat(F.lit(kind.encode()), number_bytes(F.octet_length(data), 4, True), data, pad)


@query(
    f"""with {_ROWS}
select doc_id, case doc_id % 6 when 0 then 'sensitive_metadata_detected' when 2 then 'sensitive_metadata_detected' when 3 then case when length(c) % 200 >= 100 then 'resource_limit_exceeded' end
  when 4 then case when length(c) % 200 >= 100 then 'resource_limit_exceeded' else 'sensitive_metadata_detected' end
  when 5 then case when contains(lower(c), 'exif') or contains(lower(c), 'xmp') or contains(lower(c), 'gps') or contains(lower(c), 'udta') or contains(lower(c), 'meta') then 'sensitive_metadata_detected' end end verdict from texts"""
)
def screen_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in and beside images and videos under a policy against metadata: chunks, segments, sizes and markers."""
    letters, side = F.encode("c", "UTF-8"), F.length("c") % 200 + 1
    pixels = F.concat(made_bytes("ffda0002"), letters, made_bytes("ffd9"))
    frame = F.concat(made_bytes("080001"), number_bytes(side, 2, False), made_bytes("0101110000"))
    extended = F.concat(made_bytes("08000000"), number_bytes(side - 1, 3, True), made_bytes("000000"))
    webp = F.concat(F.lit(b"WEBP"), _riff_chunk("VP8X", extended), _riff_chunk("EXIF", letters))
    kinds = [
        ("a.png", "image/png", _png(png_chunk("tEXt", F.concat(F.lit(b"Comment\0"), letters)))),
        ("a.png", "image/png", _png(png_chunk("IDAT", letters))),
        ("a.jpg", "image/jpeg", F.concat(made_bytes("ffd8"), _segment("e1", F.lit(b"Exif\0\0II")), pixels)),
        ("a.jpg", "image/jpeg", F.concat(made_bytes("ffd8"), _segment("c0", frame), pixels)),
        ("a.webp", "image/webp", F.concat(F.lit(b"RIFF"), number_bytes(F.octet_length(webp), 4, True), webp)),
        ("a.mp4", "video/mp4", F.concat(made_bytes("00000010"), F.lit(b"ftypisom"), made_bytes("00000000"), F.lit(b"\0\0\0\0mdat"), letters)),
    ]
    found = screen(_objects(plain_texts(spark, sf_dir), kinds), Policy(media_mode="reject_on_sensitive_metadata", max_image_width=100))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "verdict")


def stored_gzip(content: Column) -> Column:
    """A gzip file of uncompressed members, each of 65,535 bytes at most."""

    def member(i: Column) -> Column:
        piece = F.substring(content, i * 65535 + 1, F.lit(65535))
        size = F.octet_length(piece)
        block = F.concat(made_bytes("01"), number_bytes(size, 2, True), number_bytes(65535 - size, 2, True), piece)
        return F.concat(made_bytes("1f8b08000000000000ff"), block, number_bytes(F.crc32(piece), 4, True), number_bytes(size, 4, True))

    last = F.greatest(F.octet_length(content) - 1, F.lit(0)).cast("int")
    members = F.transform(F.sequence(F.lit(0), F.floor(last / 65535).cast("int")), member)
    return F.aggregate(members, F.lit(b""), lambda made, m: F.concat(made, m))


@query(
    f"""with {_ROWS}, expected as (select doc_id, case when c = '' then 'archive_entry_type_mismatch' else case doc_id % 8 when 1 then 'archive_entry_script_rejected' when 2 then 'archive_entry_type_mismatch'
    when 3 then 'archive_too_deep' when 4 then 'archive_path_unsafe' when 5 then 'archive_path_unsafe' when 7 then case when length(c) > 2000 then 'archive_inspection_timeout' end end end code,
  case when c = '' then 'a.txt' else case doc_id % 8 when 1 then 'run.sh' when 2 then 'photo.png' when 3 then 'deep.zip' when 4 then '../up.txt' when 5 then 'a.txt' else 'a.txt' end end entry from texts)
select doc_id, code, case when code is not null then entry end entry from expected"""
)
def archive_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in zip and gzip archives, nested and alone: scripts, wrong types, depth, unsafe and repeated paths, long streams."""
    a, inner = ("a.txt", F.col("letters")), F.col("inner")
    # level by level, as each content is used many times in the next one
    rows = plain_texts(spark, sf_dir).withColumn("letters", F.encode("c", "UTF-8"))
    rows = rows.withColumn("deep", stored_zip([a])).withColumn("inner", stored_zip([("deep.zip", F.col("deep"))]))
    packed = lambda *more: ("a.zip", "application/zip", stored_zip([a, *more]))
    kinds = [
        packed(("b.txt", F.lit(b"b"))), packed(("run.sh", F.lit(b"echo"))), packed(("photo.png", F.lit(b"text"))), packed(("in.zip", inner)),
        packed(("../up.txt", F.lit(b"b"))), packed(a), packed(("b.txt.gz", stored_gzip(F.lit(b"short")))), ("a.txt.gz", "application/gzip", stored_gzip(a[1])),
    ]
    found = inspect(_objects(rows, kinds), Policy(max_depth=2, max_probe_bytes=2000))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "code", "entry")


_MOST = 400
_TAILS = ("", "<script/>", '<use href="https://x/y"/>', "", '<x:include xmlns:x="http://www.w3.org/2001/XInclude"/>', "<b><c/></b>")  # the last is too deep


@query(
    f"""with words as (select doc_id, doc_id % 6 k, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) n from documents)
select doc_id, case when n + 1 > {_MOST} or (k in (1, 2, 4, 5) and n + 2 > {_MOST}) then case when k < 3 then 'resource_limit_exceeded' else 'markup_parser_limit_exceeded' end
  when k = 1 then 'svg_script_detected' when k = 2 then 'svg_external_reference_detected' when k = 4 then 'xml_xinclude_detected' when k = 5 then 'markup_parser_limit_exceeded' end verdict from words"""
)
def screen_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of each whole text as an element with text within and behind it, something forbidden as the last one: SVG for three of six documents, else XML."""
    k = F.col("doc_id") % 6
    words = F.array_join(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0), lambda w: F.concat(F.lit("<g>"), w, F.lit("</g> "), w)), " ")
    tail = _choose([F.lit(t) for t in _TAILS])
    vector = k < 3
    head = F.when(vector, '<svg xmlns="http://www.w3.org/2000/svg">').otherwise('<?xml version="1.0"?><a>')
    content = F.encode(F.concat(head, words, tail, F.when(vector, "</svg>").otherwise("</a>")), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("object_key"), F.when(vector, "a.svg").otherwise("a.xml").alias("original_name"),
        F.when(vector, "image/svg+xml").otherwise("application/xml").alias("declared_type"), content.alias("content"),
    )
    found = screen(stage(rows, "markup"), Policy(max_objects=_MOST, max_xml_depth=2))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "verdict")


def _packed(number: int, text: bytes) -> tuple[str, bytes]:
    """The text as an entry of a tar, plain or within a codec, or as a single stream: (name, file)."""
    import zstandard

    codecs = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lambda b: lzma.compress(b, preset=0), "zst": zstandard.ZstdCompressor().compress}
    if number % 8 > 4:
        codec = ("bz2", "xz", "zst")[number % 8 - 5]
        return f"a.txt.{codec}", codecs[codec](text)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in (("a.txt", text), ("b/c.txt", b"more")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    if number % 8 == 0:
        return "a.tar", out.getvalue()
    codec = ("gz", "bz2", "xz", "zst")[number % 8 - 1]
    return f"a.tar.{codec}", codecs[codec](out.getvalue())


def _packed_texts(batches):
    for batch in batches:
        made = [_packed(n, t.encode()) for n, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t")))]
        columns = [[str(n) for n in batch.column("doc_id").to_pylist()], [n for n, _ in made], [""] * len(made), [b for _, b in made]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary()))], ["object_key", "original_name", "declared_type", "content"])


@query(
    """select doc_id, case when n > 4000 then 'archive_too_large' when doc_id % 8 > 4 and n > 2000 then 'archive_inspection_timeout' end code
  from (select doc_id, strlen('text ' || coalesce(text, '')) n from documents)"""
)
def archive_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in tars, tars within four codecs, and single streams of three, against the limits of an entry and of what is probed."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("text "), F.coalesce("text", F.lit(""))).alias("t"))
    objects = stage(texts.mapInArrow(_packed_texts, "object_key string, original_name string, declared_type string, content binary"), "archives")
    found = inspect(objects, Policy(max_entry_bytes=4000, max_probe_bytes=2000, max_ratio=1e9))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "code")


@query(
    """select doc_id, case when n > 3000 then 'resource_limit_exceeded' when doc_id % 3 = 0 then 'sanitizer_unavailable' when doc_id % 3 = 1 then 'legacy_document_rejected' end verdict
  from (select doc_id, strlen('{\\rtf1 ' || coalesce(text, '')) n from documents)"""
)
def screen_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pages, old documents and plain files, under a size limit and a mode that has no sanitizer."""
    k = F.col("doc_id") % 3
    content = F.encode(F.concat(F.when(k == 0, "<html> ").when(k == 1, "{\\rtf1 ").otherwise("plain: "), F.coalesce("text", F.lit(""))), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("object_key"), F.when(k == 0, "a.html").when(k == 1, "a.rtf").otherwise("a.txt").alias("original_name"),
        F.when(k == 0, "text/html").when(k == 1, "application/rtf").otherwise("text/plain").alias("declared_type"), content.alias("content"),
    )
    found = screen(rows, Policy(max_file_bytes=3000, markup_mode="sanitize_when_supported"))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), "verdict")


def _objects_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as plain files, images, and files of a type nothing is known of."""
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "text/plain").when(k == 1, "image/png").otherwise("application/x-unknown")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("object_key"), kind.alias("content_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _shout(body: bytes, mime: str) -> str:
    return str(len(body)) + ":" + body.decode()[:5]


def _see(body: bytes, mime: str) -> str:
    if len(body) > 5000:
        raise TimeoutError
    return "seen " + str(len(body))


@query(
    """select doc_id, case when k = 2 then n || ':' || left(t, 5) when k = 0 then null end extracted, case when k = 2 then 'generated' when k = 1 then 'skipped' when trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) = '' then 'skipped' else 'generated' end status,
  case when k = 1 and n <= 5000 then 'seen ' || n end ocr, case when k = 1 and n > 5000 then 'timeout' end ocr_error, case when contains(t, 'the') then 'malware_detected' end code
  from (select doc_id, doc_id % 3 k, coalesce(text, '') t, strlen(coalesce(text, '')) n from documents)"""
)
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor for unknown types, a reader of images that may time out, and a scanner of all files, each a function of the user."""
    objects = stage(_objects_of_texts(spark, sf_dir), "objects")
    made = with_extractor(objects, _shout).select("object_key", F.col("content.texts")["extracted"].alias("extracted"), "status")
    seen = with_ocr(objects, _see)
    scanned = with_scanner(objects, lambda body, mime: "stream: X FOUND" if b"the" in body else "stream: OK").select("object_key", "code")
    return made.join(seen, "object_key", "left").join(scanned, "object_key").select(F.col("object_key").cast("long").alias("doc_id"), "extracted", "status", "ocr", "ocr_error", "code")


@query(
    """select doc_id, case when strlen(t) > 3000 then 'failed' when k = 0 and trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) <> '' then 'generated' else 'skipped' end status,
  case when strlen(t) > 3000 then 'input_too_large' end error_code, k = 0 and strlen(t) <= 3000 and trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) <> '' has_body
  from (select doc_id, doc_id % 3 k, coalesce(text, '') t from documents)"""
)
def written_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was extracted, published and read again: a status for every file, a body for those that gave one."""
    path, policy = work_path(spark, "extracted"), Policy(max_extract_bytes=3000)
    write_extracted(extract(_objects_of_texts(spark, sf_dir), policy), path, 0, policy)
    status = published(spark, f"{path}/status", "object_key string, status string, error_code string", f"{path}/_batches")
    bodies = published(spark, f"{path}/texts", "object_key string, text_key string, body string", f"{path}/_batches").select("object_key", F.lit(True).alias("has_body"))
    return status.join(bodies, "object_key", "left").select(F.col("object_key").cast("long").alias("doc_id"), "status", "error_code", F.coalesce("has_body", F.lit(False)).alias("has_body"))
