"""Text functions: whitespace, byte limits, PDF literals and info, XMP, and content filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space but line ends, as the inside of a class for regular expressions.
_BLANK = "\\t\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
# White space at the text's start, at its end and before a line's end. Printable ASCII, and one sign of space before it, are passed over
# by one look; a run is looked at from its first sign only, so that long ones take no longer.
_OUTER = f"\\A[{_BLANK}\\n]++|(?![!-~])(?![ \\n][!-~])(?:[{_BLANK}\\n](?<![{_BLANK}\\n]{{2}})[{_BLANK}\\n]*+\\z|[{_BLANK}](?<![{_BLANK}]{{2}})[{_BLANK}]*+(?=\\n))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_whitespace(c: Column) -> Column:
    """Without NUL, each line's end trimmed, the whole trimmed."""
    return F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), _OUTER, "")


def cut_bytes(text: Column, most: int) -> Column:
    """`text` cut to `most` bytes on a character boundary."""

    def whole(raw: Column) -> Column:
        # a cut may leave up to three bytes of a character behind
        options = [F.substring(raw, F.lit(1), F.octet_length(raw) - drop) for drop in range(4)]
        return F.coalesce(*[F.when(F.is_valid_utf8(o.cast("string")), o.cast("string")) for o in options], F.lit(""))

    return F.when(F.octet_length(text) <= most, text).otherwise(let(F.substring(F.encode(text, "UTF-8"), 1, most), whole))


def normalize_text(content: Column, most: int) -> Column:
    """(text, warnings) of bytes: each run of invalid UTF-8 is one `?`, white space is normalised, the length limited."""

    def clean(raw: Column) -> Column:
        valid = F.is_valid_utf8(raw)
        made = F.when(valid, raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "\\uFFFD+", "?"))
        return F.struct(normalize_whitespace(made).alias("text"), valid.alias("valid"))

    def limited(found: Column) -> Column:
        text, valid = found["text"], found["valid"]
        warnings = F.array_compact(F.array(F.when(~valid, "invalid_utf8_replaced"), F.when(F.octet_length(text) > most, "output_truncated")))
        return F.struct(cut_bytes(text, most).alias("text"), warnings.alias("warnings"))

    return let(let(content.cast("string"), clean), limited)


_ESCAPES = (("\\(", "("), ("\\)", ")"), ("\\n", "\n"), ("\\r", "\n"), ("\\t", "\t"), ("\\b", ""), ("\\f", ""))


def unescape_pdf(value: Column) -> Column:
    """PDF string escapes resolved from left to right; others stay as they are."""

    def plain(s: Column) -> Column:
        for code, sign in _ESCAPES:
            s = F.replace(s, F.lit(code), F.lit(sign))
        return s

    def resolved(v: Column) -> Column:
        pairs = F.split(v, "\\\\\\\\", -1)  # escaped backslashes first, so that none is read twice
        return F.when(v.contains("\\"), F.array_join(F.transform(pairs, plain), "\\")).otherwise(v)

    return let(value, resolved)


def first_matches(text: Column, pattern: str, n: int, group: int = 0) -> Column:
    """The first n matches of a pattern, or of a group of it, in order."""
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), group), 1, n)


# Patterns of a PDF's literals and information; possessive, so that a literal of any length is matched without recursion
_LITERAL = r"\(((?:[^\\)]++|\\.)*+)\)"


def pdf_literal_text(content: Column, most: int) -> Column:
    """(text, warnings) of the parenthesised literals of a PDF, at most 10000, one per line."""
    raw = F.decode(content, "ISO-8859-1")
    literals = first_matches(raw, "(?s)" + _LITERAL, 10_000, 1)
    parts = F.filter(F.transform(literals, unescape_pdf), lambda x: F.trim(x) != "")
    warned = lambda made: F.concat(made["warnings"], F.when(made["text"] == "", F.array(F.lit("no_literal_pdf_text_found"))).otherwise(F.array().cast("array<string>")))
    return let(normalize_text(F.encode(F.array_join(parts, "\n"), "ISO-8859-1"), most), lambda made: F.struct(made["text"].alias("text"), warned(made).alias("warnings")))


def pdf_info(content: Column) -> Column:
    """(title, description): Title and Subject, the last of each; Keywords or Author only where there is no description yet."""
    raw = F.decode(content, "ISO-8859-1")
    found = first_matches(raw, r"(?s)/(?:Title|Subject|Keywords|Author)\s*\((?:\\.|[^\\)])*+\)", 100)
    empty = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"))

    def take(s: Column, m: Column) -> Column:
        key, value = F.regexp_extract(m, r"^/(\w+)", 1), unescape_pdf(F.regexp_extract(m, r"(?s)^/\w+\s*\((.*)\)$", 1))
        blank = F.coalesce(s["description"], F.lit("")) == ""
        description = F.when((key == "Subject") | (key.isin("Keywords", "Author") & blank), value).otherwise(s["description"])
        return F.struct(F.when(key == "Title", value).otherwise(s["title"]).alias("title"), description.alias("description"))

    return F.aggregate(found, empty, take)


def first_element(xml: Column, name: str) -> Column:
    """The normalised text of the first element of a local name, null if there is none or it is blank."""
    inner = F.regexp_extract(xml, rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{name}\s*>", 1)
    text = F.regexp_replace(inner, "(?s)<[^>]*>", "")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.nullif(normalize_whitespace(text), F.lit(""))


def xmp_metadata(content: Column) -> Column:
    """(title, description) of the first XMP packet, by its own markers or RDF's."""
    raw = F.decode(content, "ISO-8859-1")
    packet = F.coalesce(*[F.nullif(F.regexp_extract(raw, f"(?s)<{tag}(.*?)</(?:x:xmpmeta|rdf:RDF)>", 1), F.lit("")) for tag in ("x:xmpmeta", "rdf:RDF")])
    text = F.decode(F.encode(packet, "ISO-8859-1"), "UTF-8")
    return F.struct(first_element(text, "title").alias("title"), first_element(text, "description").alias("description"))


def core_properties(xml: Column) -> Column:
    """(title, description, metadata) of an office core part: subject stands in for description."""
    value = lambda n: first_element(xml, n)
    metadata = F.map_filter(F.create_map(*[x for n in ("creator", "keywords", "lastModifiedBy") for x in (F.lit(n), value(n))]), lambda k, v: v.isNotNull())
    return F.struct(value("title").alias("title"), F.coalesce(value("description"), value("subject")).alias("description"), metadata.alias("metadata"))


def filter_content(content: Column, include: list[str]) -> Column:
    """Named texts, and metadata and sources if named; an empty list keeps all, unknown names are left aside."""
    if not include:
        return content
    keep = F.array(*[F.lit(i) for i in include])
    part = lambda n: F.when(F.array_contains(keep, F.lit(n)), content[n])
    return F.struct(F.map_filter(content["texts"], lambda k, _: F.array_contains(keep, k)).alias("texts"), part("sources").alias("sources"), part("metadata").alias("metadata"))
