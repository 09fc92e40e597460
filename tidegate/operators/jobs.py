"""Arrow jobs that unpack file formats into rows: archive entries, media chunks, and what a screening needs of a file.

Each takes (object_key, original_name, mime, content) rows and emits many small
ones; all limits and verdicts over them are DataFrame expressions elsewhere.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import stat
import struct
import tarfile
import time
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegate.operators.markup import judged
from tidegate.policy import Policy

ENTRY_SCHEMA = (
    "object_key string, level string, depth int, seq long, name string, size long, compressed_size long, archive_size long, is_dir boolean, is_link boolean,"
    " is_special boolean, encrypted boolean, prefix binary, json boolean, kind string, error string, codec string"
)
CHUNK_SCHEMA = "object_key string, seq int, depth int, type string, offset long, length long, crc_ok boolean, data binary, error string"
UNPACKED_SCHEMA = (
    "object_key string, part string, seq long, name string, error string, type string, crc_ok boolean, data binary,"
    " attributes map<string,string>, size long, body binary, marked boolean, ooxml string, odf string"
)

_FIELDS = [f.split()[0] for f in ENTRY_SCHEMA.replace("\n", " ").split(", ")]

# Name suffixes and first bytes by which nested archives are found.
_BY_NAME = (
    ((".tar.gz", ".tgz", ".gz", ".gzip"), "gzip"), ((".tar.bz2", ".tbz2", ".bz2"), "bzip2"), ((".tar.xz", ".txz", ".xz"), "xz"),
    ((".tar.zst", ".tzst", ".zst", ".zstd"), "zstd"), ((".br",), "brotli"), ((".tar",), "tar"),
    ((".zip", ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp"), "zip"), ((".7z",), "7z"),
)
_BY_START = ((b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"7z\xbc\xaf\x27\x1c", "7z"))


def kind_of(name: str, start: bytes) -> str | None:
    low = name.lower()
    by_name = next((k for ends, k in _BY_NAME if low.endswith(ends)), None)
    return by_name or next((k for sig, k in _BY_START if start.startswith(sig)), None)


#: Bytes expanded at once; rows, and bytes in them, that are handed on at once.
_STEP, _ROWS, _HANDED_ON = 1 << 16, 4096, 1 << 22
UNREADABLE = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, zlib.error, RuntimeError, NotImplementedError, ValueError, struct.error)


_JSON = re.compile(rb'("(?:[^"\\\x00-\x1f]|\\[^\x00-\x1f])*+")|([{}\[\],:])|(-?[0-9][0-9.eE+-]*)|(true|false|null)', re.S)
_NUMBER, _NUMBER_START = re.compile(rb"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), re.compile(rb"-?\d*(?:\d\.\d*)?(?:\d[eE][+-]?\d*)?")
_JSON_SPACE = b" \t\r\n"


def json_so_far(data: bytes, cut: bool) -> bool:
    """Whether bytes are a JSON object or list; if they are `cut` from more, whether they may go on as one."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    at, size, open_, want = 0, len(data), [], "value"
    while True:
        while at < size and data[at] in _JSON_SPACE:
            at += 1
        if at == size:
            return want == "end" or (cut and bool(open_))
        token = _JSON.match(data, at)
        if not token or (cut and token.end() == size and token[3]):
            rest = data[at:]
            part = rest[:1] == b'"' or (want in ("value", "first") and (any(x.startswith(rest) for x in (b"true", b"false", b"null")) or _NUMBER_START.fullmatch(rest)))
            return bool(cut and open_ and part and want in ("value", "first", "key", "first key"))
        if token[3] and not _NUMBER.fullmatch(token[3]):
            return False
        word, sign = token[1] or token[3] or token[4], token[2]
        if sign in (b"{", b"[") and want in ("value", "first"):
            open_.append(sign)
            want = "first key" if sign == b"{" else "first"
        elif (sign == b"}" and open_[-1:] == [b"{"] and want in ("first key", "more")) or (sign == b"]" and open_[-1:] == [b"["] and want in ("first", "more")):
            open_.pop()
            want = "more" if open_ else "end"
        elif sign == b"," and want == "more":
            want = "key" if open_[-1] == b"{" else "value"
        elif sign == b":" and want == "colon":
            want = "value"
        elif word and open_ and want in ("value", "first"):
            want = "more"
        elif token[1] and want in ("key", "first key"):
            want = "colon"
        else:
            return False
        at = token.end()


class _Expansion:
    """Entry rows of one object's archive and those nested in it, made while they are read.

    Of an entry its first bytes are expanded; more only of a nested archive, whose
    entries follow. A nested zip is read whole, as its list stands at its end, up to
    the limit of an entry. Reading stops where a limit of the policy is passed: entries,
    bytes by their headers, what a single stream expands to, its ratio, seconds of work.
    """

    def __init__(self, key: str, policy: Policy):
        self.key, self.policy = key, policy
        self.seq = self.entries = self.total = 0
        self.until = time.process_time() + policy.max_inspection_ms / 1000

    def row(self, level: str, depth: int, name=None, size=0, packed=0, archive=0, is_dir=False, link=False, special=False, encrypted=False, prefix=b"", kind=None, error=None, codec=None) -> tuple:
        json = json_so_far(prefix, size > len(prefix)) if prefix.lstrip(b"\xef\xbb\xbf\t\n\f\r ")[:1] in (b"{", b"[") else False
        made = (self.key, level, depth, self.seq, name, size, packed, archive, is_dir, link, special, encrypted, prefix, json, kind, error, codec)
        self.seq += 1
        if name is not None:
            self.entries += 1
            self.total += size
        return made

    @property
    def spent(self) -> bool:
        return self.entries > self.policy.max_entries or self.total > self.policy.max_total_bytes

    @property
    def late(self) -> bool:
        return time.process_time() > self.until

    def expand(self, kind: str, opened, size: int, level: str, depth: int, name: str):
        """Rows of an archive that `opened` gives from its start each time it is called."""
        try:
            if kind == "zip":
                yield from self.zip(opened, level, depth)
            elif kind == "tar":
                yield from self.tar(opened(), level, depth)
            elif kind in ("gzip", "bzip2", "xz", "zstd"):
                yield from self.stream(kind, opened, size, level, depth, name)
            else:
                yield self.row(level, depth, error="archive_unsupported_method")
        except UNREADABLE:
            yield self.row(level, depth, error="archive_unsupported_method")

    def nested(self, name: str, prefix: bytes, opened, size: int, level: str, depth: int):
        kind = kind_of(name, prefix)
        if kind and depth < self.policy.max_depth and not self.spent:
            yield from self.expand(kind, opened, size, f"{level}/{self.seq - 1}", depth + 1, name)

    def whole(self, source) -> io.BytesIO:
        """All of a source, one byte beyond the limit of an entry at most."""
        return io.BytesIO(source.read(self.policy.max_entry_bytes + 1))

    def zip(self, opened, level: str, depth: int):
        source = opened()
        if not isinstance(source, io.BytesIO):
            source = self.whole(source)
        size = source.getbuffer().nbytes
        if depth > 1 and size > self.policy.max_entry_bytes:
            yield self.row(level, depth, error="archive_too_large")
            return
        with zipfile.ZipFile(source) as z:
            for info in z.infolist():
                if self.spent:
                    return
                if self.late:
                    yield self.row(level, depth, error="archive_inspection_timeout")
                    return
                mode = info.external_attr >> 16 if info.create_system == 3 else 0
                encrypted, kind = bool(info.flag_bits & 1), stat.S_IFMT(mode)
                plain = not encrypted and not info.is_dir() and kind in (0, stat.S_IFREG) and info.file_size <= self.policy.max_entry_bytes
                prefix = b""
                if plain:
                    with z.open(info) as f:
                        prefix = f.read(self.policy.inspected_bytes)
                yield self.row(
                    level, depth, info.filename, 0 if info.is_dir() else info.file_size, info.compress_size, size, info.is_dir(), kind == stat.S_IFLNK,
                    kind not in (0, stat.S_IFREG, stat.S_IFLNK, stat.S_IFDIR), encrypted, prefix, kind_of(info.filename, prefix),
                )
                if plain:
                    yield from self.nested(info.filename, prefix, lambda info=info: z.open(info), info.file_size, level, depth)

    def tar(self, source, level: str, depth: int):
        # as a stream: an entry is passed over by reading it, so nothing is held
        with tarfile.open(fileobj=source, mode="r|", bufsize=_STEP) as t:
            for info in t:
                if self.spent:
                    return
                if self.late:
                    yield self.row(level, depth, error="archive_inspection_timeout")
                    return
                fits = info.isfile() and info.size <= self.policy.max_entry_bytes
                body = t.extractfile(info) if fits else None
                prefix = body.read(self.policy.inspected_bytes) if body else b""
                link, special = info.issym() or info.islnk(), info.isfifo() or info.isdev()
                yield self.row(level, depth, info.name, 0 if info.isdir() else info.size, 0, 0, info.isdir(), link, special, False, prefix, kind_of(info.name, prefix))
                if info.isfile() and not fits:
                    return  # beyond the limit of an entry: the verdict is made
                if body and kind_of(info.name, prefix) and depth < self.policy.max_depth:
                    held = io.BytesIO(prefix + body.read(info.size))
                    yield from self.nested(info.name, prefix, lambda held=held: held if held.seek(0) == 0 else held, info.size, level, depth)

    def stream(self, kind: str, opened, size: int, level: str, depth: int, name: str):
        policy = self.policy

        def expanded():
            source = opened()
            if kind == "zstd":
                return _Zstd(source)
            return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[kind](source)

        inner = name.rsplit(".", 1)[0] if "." in name else name
        if name.lower().endswith((".tgz", ".tbz", ".tbz2", ".txz", ".tzst")):
            inner += ".tar"
        source = expanded()
        head = b""
        while len(head) < policy.inspected_bytes and (piece := source.read(policy.inspected_bytes - len(head))):
            head += piece
        if inner.lower().endswith(".tar") or head[257:262] == b"ustar":
            yield self.row(level, depth, None, 0, size, size, prefix=head, codec=kind)
            yield from self.tar(_Joined(head, source), f"{level}/{self.seq - 1}", depth)
            return
        count = len(head)
        error = None
        while piece := source.read(_STEP):
            count += len(piece)
            # the checks of the guard name the limit; here reading only ends
            if count > min(policy.max_entry_bytes, policy.max_total_bytes, policy.max_probe_bytes) or (size and count / size > policy.max_ratio):
                break
            if self.late:
                error = "archive_inspection_timeout"
                break
        yield self.row(level, depth, inner, count, size, size, prefix=head, kind=kind_of(inner, head), error=error, codec=kind)
        if not error:
            yield from self.nested(inner, head, expanded, count, level, depth)


class _Joined(io.RawIOBase):
    """Bytes that were read already and the rest of their source."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if not self.head:
            return self.rest.read(n)
        out, self.head = (self.head, b"") if n < 0 else (self.head[:n], self.head[n:])
        return out


class _Zstd(io.RawIOBase):
    """A zstd stream that knows whether it came to its end; so little is taken in at once that what comes out is bounded."""

    def __init__(self, source):
        import zstandard

        self.new, self.error = zstandard.ZstdDecompressor().decompressobj, zstandard.ZstdError
        self.source, self.engine, self.held = source, self.new(), b""

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        out = []
        while n < 0 or sum(map(len, out)) < n:
            if not self.held and not self._more():
                break
            take = len(self.held) if n < 0 else n - sum(map(len, out))
            out.append(self.held[:take])
            self.held = self.held[take:]
        return b"".join(out)

    def _more(self) -> bool:
        while not self.held:
            left = self.engine.unused_data if self.engine.eof else b""
            piece = left or self.source.read(512)
            if not piece:
                if not self.engine.eof:
                    raise EOFError("a zstd frame has no end")
                return False
            if self.engine.eof:  # another frame follows
                self.engine = self.new()
            try:
                self.held = self.engine.decompress(piece)
            except self.error as e:
                raise OSError(str(e)) from e
        return True


def _batches(rows, kinds: list, names: list[str], weight: int):
    """Rows, of one object or many, as Arrow batches of bounded rows and bytes; `weight` is the column that holds the bytes."""

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if len(held) == _ROWS or size >= _HANDED_ON:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def archive_entries(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row for each entry of each archive, nested ones too, in the order they are met.

    Takes object_key, original_name, archive_kind and content. Rows are handed on
    while an archive is read, and reading stops at the policy's limits, so that no archive
    fills a task: what is held is the object itself and, at each level, one nested zip or entry
    of a tar that is an archive. What cannot be read gives a row with `archive_unsupported_method`, an archive that
    takes more than `max_inspection_ms` of work one with `archive_inspection_timeout`.
    """
    words, whole, flag = pa.string(), pa.int64(), pa.bool_()
    kinds = [words, words, pa.int32(), whole, words, whole, whole, whole, flag, flag, flag, flag, pa.binary(), flag, words, words, words]

    def entries(batch):
        for row in zip(*(batch.column(i) for i in range(4))):
            key, name, kind, content = (x.as_py() for x in row)
            data = content or b""
            yield from _Expansion(key, policy).expand(kind, lambda data=data: io.BytesIO(data), len(data), "", 1, name or "")

    def run(batches):
        for batch in batches:
            yield from _batches(entries(batch), kinds, _FIELDS, _FIELDS.index("prefix"))

    return df.select("object_key", "original_name", "archive_kind", "content").mapInArrow(run, ENTRY_SCHEMA)


#: Chunks of pixels; of these only the head is kept, which holds their size.
_PIXELS = ("IDAT", "fdAT", "VP8 ", "VP8L", "ALPH", "ANMF")


def _kept(kind: str, data: bytes) -> bytes:
    return data[:64] if kind in _PIXELS else data


def _png(data: bytes):
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            return (yield ("", at, 0, None, None, "truncated"))
        size = int.from_bytes(data[at : at + 4], "big")
        kind, end = data[at + 4 : at + 8].decode("latin-1"), at + 12 + size
        if end > len(data):
            return (yield (kind, at, size, None, None, "length"))
        crc_ok = zlib.crc32(data[at + 4 : end - 4]) == int.from_bytes(data[end - 4 : end], "big")
        yield (kind, at, size, crc_ok, _kept(kind, data[at + 8 : end - 4]), None)
        at = end


def _jpeg(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(data):
            return
        yield (f"{marker:02X}", at, size, None, data[at + 4 : at + 2 + size], None)
        at += 2 + size


def _webp(data: bytes):
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + 8 + size + size % 2
        if end > len(data):
            return (yield (data[at : at + 4].decode("latin-1"), at, size, None, None, "length"))
        yield (data[at : at + 4].decode("latin-1"), at, size, None, _kept(data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]), None)
        at = end


def _bmff(data: bytes):
    at = 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        size = int.from_bytes(data[at + 8 : at + 16], "big") if size == 1 else size or len(data) - at
        if size < 8 or at + size > len(data):
            return (yield (data[at + 4 : at + 8].decode("latin-1"), at, size, None, None, "length"))
        yield (data[at + 4 : at + 8].decode("latin-1"), at, size, None, None, None)
        at += size


def _chunks(data: bytes):
    """(type, offset, length, crc_ok, data, error) of each chunk of a known medium."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[4:8] == b"ftyp":
        return _bmff(data)
    return iter(())


def media_chunks(df: DataFrame) -> DataFrame:
    """One row for each PNG chunk, JPEG segment, WebP chunk or BMFF box of (object_key, content) rows.

    Other contents give no row; a chunk that leaves its file gives a row with an error and ends it.
    Data is whole, except of pixels, and null for boxes.
    """

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
    names = ["object_key", "seq", "depth", "type", "offset", "length", "crc_ok", "data", "error"]

    def chunks(batch):
        for key, data in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            for i, x in enumerate(_chunks(data.as_py() or b"")):
                yield (key, i, 1, *x)

    def run(batches):
        for batch in batches:
            yield from _batches(chunks(batch), kinds, names, names.index("data"))

    return df.select("object_key", "content").mapInArrow(run, CHUNK_SCHEMA)


# Parts of a package that name what it is, and the bytes of them that are read at most.
_NAMING = ("[content_types].xml", "mimetype", "meta-inf/manifest.xml")
NAMING_BYTES = 1 << 20


def _holds(source, markers: tuple[bytes, ...]) -> bool:
    """Whether a stream holds one of the markers, in any case; read piece by piece."""
    overlap, tail = max(map(len, markers)) - 1, b""
    while piece := source.read(_STEP):
        seen = tail + piece.lower()
        if any(m in seen for m in markers):
            return True
        tail = seen[-overlap:]
    return False


def _package(data: bytes, markers: tuple[bytes, ...], suffixes: tuple[str, ...], policy: Policy):
    """(name, error, size, body, marked) of each entry of a package; bodies of the naming parts only."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n, info in enumerate(z.infolist()):
                low, size = info.filename.lower(), 0 if info.is_dir() else info.file_size
                body = marked = None
                if n > policy.max_entries:
                    return
                if not info.is_dir() and not info.flag_bits & 1 and size <= policy.max_part_bytes:
                    if low in _NAMING:
                        with z.open(info) as f:
                            body = f.read(NAMING_BYTES + 1)
                    if low.endswith(suffixes):
                        with z.open(info) as f:
                            marked = _holds(f, markers)
                yield info.filename, None, size, body, marked
    except UNREADABLE:
        yield None, "archive_unsupported_method", None, None, None


def _unpacked_rows(key: str, part: str, data: bytes, ooxml, odf, policy: Policy, markers):
    """Rows of `UNPACKED_SCHEMA` of one object, as one part of a screening needs them."""
    if part == "media":
        for i, (kind, _, _, crc_ok, body, error) in enumerate(_chunks(data)):
            # sizes stand in the head of a chunk
            yield (key, part, i, None, error, kind, crc_ok, body and body[:64], *(None,) * 6)
    elif part == "package":
        for i, (name, error, size, body, marked) in enumerate(_package(data, *markers["ooxml" if ooxml else "odf"], policy)):
            yield (key, part, i, name, error, *(None,) * 4, size, body, marked, ooxml, odf)
    else:
        code, root, size = judged(part, data, policy)
        yield (key, part, 0, root, code, None, None, None, list(size.items()), *(None,) * 5)


def unpacked(df: DataFrame, policy: Policy, markers: dict[str, tuple[tuple[bytes, ...], tuple[str, ...]]]) -> DataFrame:
    """All rows a screening needs of (object_key, parts, ooxml, odf, content) rows, in one pass over the contents.

    `parts` lists what an object is read as: `media` (chunks), `svg` or `xml`
    (one row: the first rule broken in `error`, the root and its size)
    and `package` (zip entries; `marked` tells whether one holds a marker). `markers` gives for
    `ooxml` and `odf` packages what to look for, and the suffixes of entries to look in.
    """
    words, whole, raw = pa.string(), pa.int64(), pa.binary()
    kinds = [words, words, whole, words, words, words, pa.bool_(), raw, pa.map_(words, words), whole, raw, pa.bool_(), words, words]
    names = [f.split()[0] for f in UNPACKED_SCHEMA.replace("map<string,string>", "map").split(",")]

    def rows(batch):
        for row in zip(*(batch.column(i) for i in range(5))):
            key, parts, ooxml, odf, content = (x.as_py() for x in row)
            for part in parts:
                yield from _unpacked_rows(key, part, content or b"", ooxml, odf, policy, markers)

    def run(batches):
        for batch in batches:
            yield from _batches(rows(batch), kinds, names, names.index("body"))

    return df.select("object_key", "parts", "ooxml", "odf", "content").mapInArrow(run, UNPACKED_SCHEMA)
