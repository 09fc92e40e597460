"""Texts of office packages: the wanted parts are inflated and parsed piece by piece."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegate.operators.jobs import UNREADABLE
from tidegate.operators.markup import Texts
from tidegate.policy import DOCX, PPTX, XLSX, Policy

# Where a package's texts and properties stand, and how many bytes of these are read.
CORE_PART, PART_BYTES, CORE_BYTES = "docProps/core.xml", 32 << 20, 1 << 20
_ONE_PART = {DOCX: "word/document.xml", XLSX: "xl/sharedStrings.xml"}
_SLIDES = ("ppt/slides/slide", ".xml")

#: Bytes inflated at once, and signs of texts that are handed on at once.
_STEP, _HANDED_ON = 1 << 16, 1 << 22


def _pieces(source, most: int):
    """A stream's bytes up to `most`, piece by piece; one that turns out unreadable ends there."""
    try:
        while most > 0 and (piece := source.read(min(_STEP, most))):
            most -= len(piece)
            yield piece
    except UNREADABLE:
        return


def part_text(source, most: int) -> str:
    """Texts of an XML part, joined by one space; what stands before a mistake or the limit counts."""
    reader, size, counted = Texts(), 0, 0
    for _ in reader.parse(_pieces(source, PART_BYTES)):
        size += sum(map(len, reader.said[counted:]))
        counted = len(reader.said)
        if size > most:
            break
    return " ".join(" ".join(reader.said).split())


def read_package(data: bytes, mime: str, policy: Policy) -> tuple[str | None, bytes | None, bool]:
    """(text, core properties, broken) of a package: the parts its type has texts in, by name, each on a line of its own."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            listed = {i.filename: i for i in reversed(z.infolist())}  # the first of a name counts
            wanted = [_ONE_PART[mime]] if mime in _ONE_PART else sorted(n for n in listed if n.startswith(_SLIDES[0]) and n.endswith(_SLIDES[1])) if mime == PPTX else []
            texts, left = [], policy.max_output_bytes
            for name in wanted:
                if name not in listed or left < 0:
                    continue
                try:
                    with z.open(listed[name]) as f:
                        text = part_text(f, left)
                except UNREADABLE:
                    continue
                if text:
                    texts.append(text)
                    left -= len(text)  # a code point is a byte at least: what is beyond is cut anyhow
            core = None
            if CORE_PART in listed:
                try:
                    with z.open(listed[CORE_PART]) as f:
                        core = b"".join(_pieces(f, CORE_BYTES))
                except UNREADABLE:
                    pass
            return "\n".join(texts), core, False
    except UNREADABLE:
        return None, None, True


def with_office_parts(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`rows` (mime, content and others) with `content` emptied and `raw`, `core` and `broken` of the package it was.

    A row is one package, so nothing is joined and repeated keys stay apart. What a worker holds is a batch
    of packages and some 4 MB of texts made of them, or one of `max_output_bytes` at most; an inflated part is never held.
    """
    columns = rows.columns
    names = [*columns, "raw", "core", "broken"]

    def run(batches):
        for batch in batches:
            first, found, size = 0, [], 0
            for i in range(batch.num_rows):
                found.append(read_package(batch.column("content")[i].as_py() or b"", batch.column("mime")[i].as_py(), policy))
                size += sum(map(len, filter(None, found[-1][:2])))
                if size >= _HANDED_ON or i + 1 == batch.num_rows:
                    rows = batch.slice(first, len(found))
                    kept = [pa.nulls(len(found), rows.column(c).type) if c == "content" else rows.column(c) for c in columns]
                    made = [pa.array(values, t) for values, t in zip(zip(*found), (pa.string(), pa.binary(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names)
                    first, found, size = i + 1, [], 0

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "raw string, core binary, broken boolean"])
    return rows.mapInArrow(run, schema)
