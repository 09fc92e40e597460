"""Markup read as a stream: each document is folded to one verdict, or handed on in batches of rows.

A verdict holds the parser's state and the first rule broken, whatever the size of the
document; nothing counts but what the rules count.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegate.policy import Policy

NODE_SCHEMA = "object_key string, seq int, depth int, event string, name string, namespace string, attributes map<string,string>, text string"

#: Bytes the parser gets at once, and rows that are handed on at once.
_STEP, _ROWS = 1 << 16, 4096

# SVG elements that act, elements that load what they name, and how an outside address starts.
_ACTIVE = ("foreignobject", "iframe", "object", "embed")
_LOADING = ("image", "audio", "video", "use")
_OUTSIDE = ("http:", "https:", "//", "file:")
_XINCLUDE = ("http://www.w3.org/2001/xinclude", "xi")


class _Found(Exception):
    pass


class _Reader:
    """Element depth and number, and the names spaces of the elements that are open."""

    def __init__(self):
        self.parser = expat.ParserCreate()
        self.parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.spaces: list[dict] = [{}]
        self.depth = self.elements = 0

    def _start(self, name: str, attributes: dict) -> None:
        self.depth += 1
        self.elements += 1
        own = {k.partition(":")[2]: v for k, v in attributes.items() if k.split(":", 1)[0] == "xmlns"}
        self.spaces.append({**self.spaces[-1], **own} if own else self.spaces[-1])
        prefix, _, local = name.rpartition(":")
        self.start(local, self.spaces[-1].get(prefix, prefix), attributes)

    def _end(self, name: str) -> None:
        self.end()
        self.depth -= 1
        self.spaces.pop()

    def start(self, name: str, namespace: str, attributes: dict) -> None: ...

    def end(self) -> None: ...

    def read(self, data: bytes):
        """Parse bytes to their end, pausing after each step; False is the last value if the document is malformed."""
        yield from self.parse(data[at : at + _STEP] for at in range(0, len(data), _STEP))

    def parse(self, pieces):
        try:
            for piece in pieces:
                self.parser.Parse(piece, False)
                yield True
            self.parser.Parse(b"", True)
            yield True
        except (expat.ExpatError, ValueError, LookupError):
            yield False


def _outside(value: str, policy: Policy) -> bool:
    value = value.strip().lower()
    return not policy.svg_data_urls if value.startswith("data:") else value.startswith(_OUTSIDE)


class _Svg(_Reader):
    """The first rule an SVG breaks; its root's name and size are kept for rules on those."""

    def __init__(self, policy: Policy):
        super().__init__()
        self.policy, self.root, self.size, self.code = policy, None, {}, None

    def _broken(self, name: str, attributes: dict) -> str | None:
        policy = self.policy
        if 0 < policy.max_xml_depth < self.depth or 0 < policy.max_objects < self.elements:
            return "resource_limit_exceeded"
        name = name.lower()
        own = [(k.rpartition(":")[2].lower(), v) for k, v in attributes.items()]
        if self.root is None:
            self.root = name
            for k, v in own:
                self.size.setdefault(k, v)
        if name == "script":
            return "svg_script_detected"
        if name in _ACTIVE:
            return "svg_active_content_rejected"
        if name in _LOADING and any(k == "href" and _outside(v, policy) for k, v in own):
            return "svg_external_reference_detected"
        for k, v in own:
            if k.startswith("on"):
                return "svg_active_content_rejected"
            low = v.lower()
            bad = _outside(v, policy) if k in ("href", "src") else "url(" in low or "@import" in low if k == "style" else "javascript:" in low
            if bad:
                return "svg_active_content_rejected"
        return None

    def start(self, name: str, namespace: str, attributes: dict) -> None:
        self.code = self._broken(name, attributes)
        if self.code:
            raise _Found


class _Xml(_Reader):
    """The first rule a parsed XML document breaks."""

    def __init__(self, policy: Policy):
        super().__init__()
        self.policy, self.root, self.size, self.code = policy, None, {}, None
        self.parser.StartDoctypeDeclHandler = self._doctype

    def _doctype(self, *_) -> None:
        self.code = "xml_external_entity_detected"
        raise _Found

    def start(self, name: str, namespace: str, attributes: dict) -> None:
        policy = self.policy
        if 0 < policy.max_xml_depth < self.depth or 0 < policy.max_objects < self.elements:
            self.code = "markup_parser_limit_exceeded"
        elif name.lower() == "include" and namespace.lower() in _XINCLUDE:
            self.code = "xml_xinclude_detected"
        if self.code:
            raise _Found


def judged(kind: str, data: bytes, policy: Policy) -> tuple[str | None, str | None, dict[str, str]]:
    """(code, root, its width, height and viewbox) of an `svg` or `xml` document; the code of the first rule broken that needs no size."""
    reader = (_Svg if kind == "svg" else _Xml)(policy)
    try:
        for sound in reader.read(data):
            if not sound:
                reader.code = "structural_validation_failed"
    except _Found:
        pass
    return reader.code, reader.root, {k: v for k, v in reader.size.items() if k in ("width", "height", "viewbox")}


class Texts(_Reader):
    """Texts between markup, without white space around them."""

    def __init__(self):
        super().__init__()
        self.said: list[str] = []
        self.parts: list[str] = []
        self.parser.buffer_text, self.parser.buffer_size = True, _STEP
        self.parser.CharacterDataHandler = self.parts.append
        self.parser.CommentHandler = self.parser.ProcessingInstructionHandler = lambda *_: self.end()
        self.parser.StartCdataSectionHandler = self.parser.EndCdataSectionHandler = lambda: self.end()

    def _start(self, name: str, attributes: dict) -> None:
        self.end()
        super()._start(name, attributes)

    def end(self) -> None:
        if text := "".join(self.parts).strip():
            self.said.append(text)
        self.parts.clear()


class _Nodes(_Reader):
    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []
        self.inside, self.parts = None, []
        self.parser.CharacterDataHandler = self.parts.append
        self.parser.StartDoctypeDeclHandler = lambda name, *_: self.rows.append((self.depth, "doctype", name, None, None, None))

    def _text(self) -> None:
        said = "".join(self.parts).strip()
        if said and self.elements:
            self.rows.append((self.depth, "text", self.inside, None, None, said))
            self.inside = None
        self.parts.clear()

    def _start(self, name: str, attributes: dict) -> None:
        self._text()
        super()._start(name, attributes)

    def start(self, name: str, namespace: str, attributes: dict) -> None:
        plain = {k.rpartition(":")[2].lower(): v for k, v in attributes.items() if k.split(":", 1)[0] != "xmlns"}
        self.rows.append((self.depth, "start", name, namespace, plain, None))
        self.inside = name

    def end(self) -> None:
        self._text()
        self.inside = None


def nodes(data: bytes):
    """Lists of (depth, event, name, namespace, attributes, text) of a document, as it is read."""
    reader = _Nodes()
    for sound in reader.read(data):
        if not sound:
            reader.rows.append((reader.depth, "error", None, None, None, None))
        if len(reader.rows) >= _ROWS:
            yield reader.rows
            reader.rows = []
    if reader.rows:
        yield reader.rows


def markup_nodes(df: DataFrame) -> DataFrame:
    """One row for each start element, text, doctype or parse error of (object_key, content) rows, in order.

    Entities are not resolved. A text has the name of its element where it is that element's first content. Null
    contents are malformed. A document's rows are handed on while it is read, so its size bounds nothing but its bytes.
    """
    words = pa.string()
    kinds = [words, pa.int32(), pa.int32(), words, words, words, pa.map_(words, words), words]
    names = [f.split()[0] for f in NODE_SCHEMA.replace("map<string,string>", "map").split(", ")]

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                at = 0
                for rows in nodes(data.as_py() or b""):
                    columns = list(zip(*rows))
                    columns[4] = [None if a is None else list(a.items()) for a in columns[4]]
                    columns = [[key.as_py()] * len(rows), range(at, at + len(rows)), *columns]
                    at += len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return df.select("object_key", "content").mapInArrow(run, NODE_SCHEMA)
