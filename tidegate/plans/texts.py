"""Text queries: documents with dirt put in, normalised, cut, dressed as PDFs and packets, and extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import text as T
from tidegate.operators.extract import extract
from tidegate.plans.registry import query, table
from tidegate.policy import PPTX, Policy
from tidegate.sources.work import stage

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DIRTY = "case doc_id % 4 when 0 then '  ' || text || chr(9) || chr(10) || ' ' when 1 then replace(text, chr(10), ' ' || chr(9) || chr(10)) when 2 then replace(text, ' ', chr(1) || ' ') else text end"
_CLEAN = f"trim(regexp_replace({{0}}, '[ \\t\\v\\f\\r]+(\\n|$)', '\\1', 'g'), {_WS})"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    made = (
        F.when(kind == 0, F.concat(F.lit("  "), "text", F.lit("\t\n ")))
        .when(kind == 1, F.replace("text", F.lit("\n"), F.lit(" \t\n")))
        .when(kind == 2, F.replace("text", F.lit(" "), F.lit("\x01 ")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", made.alias("text"))


@query(f"select doc_id, sha256({_CLEAN.format(_DIRTY)}) sha from documents where text is not null")
def whitespace_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends and text ends trimmed."""
    return dirty(spark, sf_dir).select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("sha"))


@query("select doc_id, length(text) < 200 short, strlen(text) <= 200 whole from documents where text is not null")
def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 200 bytes on a character boundary: never longer, always valid, a prefix of the text."""
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("cut", T.cut_bytes(F.col("text"), 200))
    right = F.col("text").startswith(F.col("cut")) & (F.octet_length("cut") <= 200) & ((F.octet_length("text") <= 200) | (F.octet_length("cut") > 196))
    return rows.select("doc_id", (F.length("text") < 200).alias("short"), (right & (F.col("cut") == F.col("text"))).alias("whole"))


@query(
    f"""select doc_id, sha256({_CLEAN.format("case when contains(text, ' ') then regexp_replace(text, '[ ' || chr(65533) || ']+', '?', 'g') else text end")}) sha,
  case when contains(text, ' ') then 'invalid_utf8_replaced' end warning from documents where text is not null"""
)
def invalid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with invalid bytes for their spaces: each run becomes one `?`, with a warning."""
    bad = F.encode(F.replace(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), F.lit(" "), F.lit("\xff\xfe")), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.normalize_text(bad, _MOST).alias("made"))
    return rows.select("doc_id", F.sha2("made.text", 256).alias("sha"), F.get("made.warnings", F.lit(0)).alias("warning"))


#: More bytes than a text here has.
_MOST = 1 << 30


def _pdf_string(text: Column) -> Column:
    for sign in ("\\", "(", ")"):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return F.concat(F.lit("("), text, F.lit(")"))


_ASCII = "regexp_replace(text, '[^ -~]+', ' ', 'g')"


@query(f"select doc_id, sha256('U' || {_ASCII}) title, sha256('S' || {_ASCII}) description from documents where text is not null")
def pdf_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and description of PDFs that hold whole texts, escaped: the last title, the subject over the author."""
    text = F.regexp_replace("text", "[^ -~]+", " ")
    title, subject = _pdf_string(F.concat(F.lit("U"), text)), _pdf_string(F.concat(F.lit("S"), text))
    body = F.concat(F.lit("%PDF-1.4 /Title (T) /Author ("), "source", F.lit(") /Title "), title, F.lit(" /Subject "), subject, F.lit(" ( )"))
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.select("doc_id", T.pdf_info(F.encode(body, "UTF-8")).alias("info"))
    return rows.select("doc_id", F.sha2("info.title", 256).alias("title"), F.sha2("info.description", 256).alias("description"))


_LINES = "array_to_string(list_filter(string_split(text, chr(10))[1:10000], lambda x: trim(x, ' ') <> ''), chr(10))"


@query(
    f"""select doc_id, sha256(clean) sha, case when clean = '' then 'no_literal_pdf_text_found' end warning
  from (select doc_id, {_CLEAN.format(_LINES)} clean from documents where text is not null)"""
)
def pdf_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text as a literal of a PDF, escaped, and all read back: blank ones are left out."""
    body = F.concat(F.lit("%PDF-1.4 "), F.array_join(F.transform(F.split("text", "\n"), _pdf_string), "\n"))
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("made", T.pdf_literal_text(F.encode(body, "UTF-8"), _MOST))
    return rows.select("doc_id", F.sha2("made.text", 256).alias("sha"), F.get("made.warnings", F.lit(0)).alias("warning"))


@query(f"select doc_id, sha256(nullif({_CLEAN.format('text')}, '')) title, case when doc_id % 2 = 0 then source end description from documents where text is not null")
def xmp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as titles in XMP packets between other bytes, read back with the description."""
    title = F.col("text")
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(sign), F.lit(code))
    tail = F.when((F.col("doc_id") % 2 == 0) & F.col("source").isNotNull(), F.concat(F.lit("<dc:description><rdf:li>"), "source", F.lit("</rdf:li></dc:description>"))).otherwise("")
    body = F.concat(F.lit("junk<x:xmpmeta a='1'><dc:title><rdf:Alt><rdf:li>"), title, F.lit("</rdf:li></rdf:Alt></dc:title>"), tail, F.lit("</x:xmpmeta>rest"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.xmp_metadata(F.encode(body, "UTF-8")).alias("m"))
    return rows.select("doc_id", F.sha2("m.title", 256).alias("title"), "m.description")


_NAMES = ("text/plain", "text/markdown", "video/mp4", "application/json")


@query(
    f"""select doc_id object_key, case when doc_id % 4 = 2 or clean = '' then 'skipped' else 'generated' end status, doc_id % 4 <> 2 and clean <> '' has_text, case when doc_id % 4 <> 2 and clean <> '' then sha256(clean) end sha
  from (select doc_id, {_CLEAN.format("text")} clean from documents where text is not null)"""
)
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all documents as uploads of several types: one type has no route and is skipped."""
    kind = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 4 + 1).cast("int"))
    objects = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("object_key"), kind.alias("content_type"), F.encode("text", "UTF-8").alias("content"))
    rows = extract(objects.withColumn("object_key", F.col("object_key").cast("string")), Policy())
    return rows.select(F.col("object_key").cast("long").alias("object_key"), "status", "has_text", F.sha2(F.col("content.texts")["text"], 256).alias("sha"))


@query("select doc_id, '{\"title\":\"' || source || '\"}' texts, doc_id % 2 = 0 has_metadata from documents")
def content_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of extracted content kept, the others left out."""
    texts = F.create_map(F.lit("title"), F.col("source"), F.lit("text"), F.lit("body"))
    metadata = F.create_map(F.lit("k"), F.lit("v"))
    content = F.struct(texts.alias("texts"), metadata.alias("sources"), F.when(F.col("doc_id") % 2 == 0, metadata).alias("metadata"))
    rows = table(spark, sf_dir, "documents").withColumn("content", content).select("doc_id", T.filter_content(F.col("content"), ["title", "metadata", "other"]).alias("kept"))
    return rows.select("doc_id", F.to_json("kept.texts").alias("texts"), F.col("kept.metadata").isNotNull().alias("has_metadata"))


@query("select doc_id, least(10, len(regexp_extract_all(text, '[A-Za-z]+'))) n, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:10], ' ') words from documents where text is not null")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten matches of a pattern in each text."""
    found = T.first_matches(F.col("text"), "[A-Za-z]+", 10)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("words"))


# --- files made of each text -------------------------------------------------------


def number_bytes(n: Column, size: int, little: bool) -> Column:
    """A whole number as `size` bytes."""

    def spelled(digits: Column) -> Column:
        places = [F.substring(digits, 2 * i + 1, 2) for i in range(size)]
        return F.unhex(F.concat(*(reversed(places) if little else places)))

    return T.let(F.lpad(F.hex(n.cast("long")), 2 * size, "0"), spelled)


def made_bytes(hexed: str) -> Column:
    return F.lit(bytes.fromhex(hexed))


def stored_zip(parts: list[tuple[str | Column, Column]]) -> Column:
    """A zip file of uncompressed entries (name, content)."""
    little = lambda n, size: number_bytes(n, size, True)

    def entry(part: Column) -> Column:
        name, content = part["name"], part["content"]
        size = little(F.octet_length(content), 4)
        facts = F.concat(made_bytes("00002100"), little(F.crc32(content), 4), size, size, little(F.octet_length(name), 2), made_bytes("0000"))
        return T.let(facts, lambda f: F.struct(name.alias("name"), f.alias("facts"), F.concat(made_bytes("504b0304" + "140000000000"), f, name, content).alias("file")))

    def packed(entries: Column) -> Column:
        made = [F.get(entries, F.lit(i)) for i in range(len(parts))]
        files, listing, at = [], [], F.lit(0).cast("long")
        for e in made:
            files.append(e["file"])
            listing.append(F.concat(made_bytes("504b0102" + "1400140000000000"), e["facts"], made_bytes("00" * 10), little(at, 4), e["name"]))
            at = at + F.octet_length(e["file"])
        n = little(F.lit(len(parts)), 2)
        return T.let(F.concat(*listing), lambda c: F.concat(*files, c, made_bytes("504b050600000000"), n, n, little(F.octet_length(c), 4), little(at, 4), made_bytes("0000")))

    named = [F.struct((F.lit(n.encode()) if isinstance(n, str) else F.encode(n, "UTF-8")).alias("name"), content.alias("content")) for n, content in parts]
    return T.let(F.transform(F.array(*named), entry), packed)


def png_chunk(kind: str, data: Column) -> Column:
    body = F.concat(F.lit(kind.encode()), data)
    return T.let(body, lambda b: F.concat(number_bytes(F.octet_length(b) - 4, 4, False), b, number_bytes(F.crc32(b), 4, False)))


LETTERS = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    return docs.select("doc_id", "lang", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("c"))


@query(
    f"""select doc_id, trim('one ' || c) || chr(10) || trim('ten ' || c) || chr(10) || trim('two ' || c) extracted, 'T' || doc_id title, lang creator, 'generated' status
  from (select doc_id, lang, {LETTERS} c from documents where lang is not null and text is not null)"""
)
def office_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as three slides of a package, unpacked and parsed again: slide 10 comes before 2, and the core properties tell title and creator."""
    slide = lambda word: F.encode(F.concat(F.lit(f'<p:sld xmlns:p="p" xmlns:a="a"><a:t>{word} '), "c", F.lit("</a:t></p:sld>")), "UTF-8")
    core = F.concat(F.lit('<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T'), F.col("doc_id").cast("string"), F.lit("</dc:title><dc:creator>"), "lang", F.lit("</dc:creator></cp:coreProperties>"))
    parts = [("ppt/slides/slide2.xml", slide("two")), ("ppt/slides/slide10.xml", slide("ten")), ("docProps/core.xml", F.encode(core, "UTF-8")), ("ppt/slides/slide1.xml", slide("one"))]
    objects = plain_texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("object_key"), F.lit(PPTX).alias("content_type"), stored_zip(parts).alias("content"))
    found = extract(stage(objects, "packages"))
    return found.select(
        F.col("object_key").cast("long").alias("doc_id"), F.col("content.texts")["extracted"].alias("extracted"), F.col("content.texts")["title"].alias("title"),
        F.col("content.metadata")["creator"].alias("creator"), "status",
    )


@query(f"select doc_id, nullif(c, '') description, case when c = '' then 'skipped' else 'generated' end status from (select doc_id, {LETTERS} c from documents where lang is not null and text is not null)")
def png_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the description chunk of an image, read back whole."""
    header = F.lit(bytes.fromhex("00000002000000010802000000"))
    text = F.concat(F.lit(b"Description\0"), F.encode("c", "ISO-8859-1"))
    image = F.concat(made_bytes("89504e470d0a1a0a"), png_chunk("IHDR", header), png_chunk("tEXt", text), png_chunk("IEND", F.lit(b"")))
    objects = plain_texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("object_key"), F.lit("image/png").alias("content_type"), image.alias("content"))
    found = extract(stage(objects, "images"))
    return found.select(F.col("object_key").cast("long").alias("doc_id"), F.col("content.texts")["description"].alias("description"), "status")
