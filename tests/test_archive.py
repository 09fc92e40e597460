"""Archive guard cases: one breach each, and archives that pass."""

import bz2
import gzip
import io
import json
import lzma
import random
import stat
import tarfile
import zipfile
import zlib

import pytest

from tidegate.operators.archive import inspect
from tidegate.operators.jobs import json_so_far
from tidegate.policy import Policy

PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 64


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body, *mode in entries:
            info = zipfile.ZipInfo(name)
            info.create_system, info.compress_type = 3, zipfile.ZIP_DEFLATED
            info.external_attr = (mode[0] if mode else stat.S_IFREG | 0o644) << 16
            z.writestr(info, body)
    return out.getvalue()


def tarred(entries, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body, *kind in entries:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            if kind:
                info.type, info.linkname, info.size = kind[0], "target", 0
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


TEXT = b"a" * 1024
CASES = {
    "huge.zip": (zipped([("huge.txt", TEXT)]), dict(max_total_bytes=512, max_entry_bytes=512), "archive_too_large"),
    "huge.gz": (gzip.compress(TEXT), dict(max_total_bytes=512, max_entry_bytes=512), "archive_too_large"),
    "small.bz2": (bz2.compress(TEXT), dict(max_total_bytes=2048, max_entry_bytes=2048), None),
    "links.zip": (zipped([("link", b"x", stat.S_IFLNK | 0o777)]), {}, "archive_link_rejected"),
    "special.zip": (zipped([("pipe", b"", stat.S_IFIFO | 0o644)]), {}, "archive_special_file_rejected"),
    "drive.zip": (zipped([("C:/temp/evil.txt", b"x")]), {}, "archive_path_unsafe"),
    "twice.zip": (zipped([("a/b.txt", b"x"), ("a/./b.txt", b"y")]), {}, "archive_path_unsafe"),
    "photos.zip": (zipped([("photo.jpg", PNG)]), {}, "archive_entry_type_mismatch"),
    "scripts.zip": (zipped([("run.sh", b"#!/bin/sh\n")]), {}, "archive_entry_script_rejected"),
    "allowed.zip": (zipped([("run.sh", b"#!/bin/sh\n")]), dict(allowed_script_types=("shell",)), None),
    "bomb.zip": (zipped([("inner.zip", zipped([("note.txt", TEXT)]))]), dict(max_total_bytes=512, max_entry_bytes=2048), "archive_too_large"),
    "deep.zip": (zipped([("inner.zip", zipped([("note.txt", b"x")]))]), dict(max_depth=1), "archive_too_deep"),
    "total.zip": (zipped([("a.zip", zipped([("a.txt", b"a" * 400)])), ("b.zip", zipped([("b.txt", b"b" * 400)]))]), dict(max_total_bytes=700, max_entry_bytes=2048), "archive_too_large"),
    "count.zip": (zipped([("a.zip", zipped([("a.txt", b"a")])), ("b.zip", zipped([("b.txt", b"b")]))]), dict(max_entries=3), "archive_too_many_entries"),
    "ratio.zip": (zipped([("a.txt", b"a" * 100_000)]), dict(max_ratio=100), "archive_ratio_exceeded"),
    "magic.zip": (zipped([("payload", zipped([("note.txt", TEXT)]))]), dict(max_total_bytes=512, max_entry_bytes=2048), "archive_too_large"),
    "bomb.tar": (tarred([("payload", zipped([("note.txt", TEXT)]))]), dict(max_total_bytes=512, max_entry_bytes=2048), "archive_too_large"),
    "links.tar": (tarred([("link", b"", tarfile.SYMTYPE)]), {}, "archive_link_rejected"),
    "hard.tar": (tarred([("link", b"", tarfile.LNKTYPE)]), {}, "archive_link_rejected"),
    "special.tar": (tarred([("pipe", b"", tarfile.FIFOTYPE)]), {}, "archive_special_file_rejected"),
    "photos.tar": (tarred([("photo.jpg", PNG)]), {}, "archive_entry_type_mismatch"),
    "scripts.tar": (tarred([("run.sh", b"#!/bin/sh\n")]), {}, "archive_entry_script_rejected"),
    "twice.tar": (tarred([("b.txt", b"x"), ("b.txt", b"y")]), {}, None),
    "links.tgz": (tarred([("link", b"", tarfile.SYMTYPE)], "w:gz"), {}, "archive_link_rejected"),
    "scripts.tgz": (tarred([("run.sh", b"#!/bin/sh\n")], "w:gz"), {}, "archive_entry_script_rejected"),
    "broken.zip": (b"PK\x03\x04nonsense", {}, "archive_unsupported_method"),
    "fine.zip": (zipped([("a/b.txt", b"hello"), ("c.csv", b"a,b\n")]), {}, None),
    "plain.txt": (b"hello", {}, None),
}


def test_cases(spark):
    wrong = {}
    groups = {}
    for name, (content, limits, want) in CASES.items():
        limits = {"max_ratio": 1000} | limits if limits else limits
        groups.setdefault(tuple(sorted(limits.items())), []).append((name, name, "", content, want))
    for limits, rows in groups.items():
        df = spark.createDataFrame([r[:4] for r in rows], "object_key string, original_name string, declared_type string, content binary")
        got = {r.object_key: r.code for r in inspect(df, Policy(**dict(limits))).collect()}
        wrong |= {r[0]: (got[r[0]], r[4]) for r in rows if got[r[0]] != r[4]}
    assert wrong == {}


def verdicts(spark, rows, policy=Policy()):
    df = spark.createDataFrame([(n, n, "", b) for n, b in rows.items()], "object_key string, original_name string, declared_type string, content binary")
    return {r.object_key: (r.code, r.entry) for r in inspect(df, policy).collect()}


def test_bombs_are_named_and_never_expanded(spark):
    """A gigabyte of zeros, as an entry, as a stream and in a tar: each names its limit after a few megabytes."""
    deflate = zlib.compressobj(9, zlib.DEFLATED, 31)
    zeros = b"".join(deflate.compress(bytes(1 << 24)) for _ in range(64)) + deflate.flush()
    one, info = io.BytesIO(), zipfile.ZipInfo("a.txt")
    info.compress_type = zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(one, "w") as z, z.open(info, "w", force_zip64=True) as f:
        for _ in range(64):
            f.write(bytes(1 << 24))
    header = tarfile.TarInfo("a.txt")
    header.size = 1 << 30
    deflate = zlib.compressobj(9, zlib.DEFLATED, 31)
    tar = deflate.compress(header.tobuf()) + b"".join(deflate.compress(bytes(1 << 24)) for _ in range(64)) + deflate.flush()
    rows = {"z.gz": zeros, "z.zip": one.getvalue(), "t.tar.gz": tar, "n.zip": zipped([("z.gz", zeros)])}
    got = verdicts(spark, rows)
    assert got == {"z.gz": ("archive_inspection_timeout", "z"), "z.zip": ("archive_too_large", "a.txt"), "t.tar.gz": ("archive_too_large", "a.txt"), "n.zip": ("archive_ratio_exceeded", "z.gz")}
    assert verdicts(spark, rows, Policy(max_ratio=10, max_entry_bytes=1 << 31, max_total_bytes=1 << 31)) == dict.fromkeys(rows, ("archive_ratio_exceeded", "z")) | {"n.zip": ("archive_ratio_exceeded", "z.gz"), "z.zip": ("archive_ratio_exceeded", "a.txt"), "t.tar.gz": ("archive_entry_type_mismatch", "a.txt")}
    many = zipped([(f"{i}.bin", b"\1\2") for i in range(2000)])
    assert verdicts(spark, {"m.zip": many, "z.gz": zeros}, Policy(max_inspection_ms=0, max_ratio=1e9))["m.zip"][0] == "archive_inspection_timeout"


@pytest.mark.parametrize("codec", ["gz", "bz2", "xz", "zst"])
def test_streams_of_every_codec(spark, codec):
    import zstandard

    pack = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.ZstdCompressor().compress}[codec]
    body = random.Random(1).randbytes(300_000)
    inner = zipped([("run.sh", b"#!/bin/sh\n")])
    rows = {
        f"a.bin.{codec}": pack(body), f"t.tar.{codec}": pack(tarred([("a.txt", b"words " * 50), ("b/c.txt", b"more " * 9)])), f"l.tar.{codec}": pack(tarred([("l", b"", tarfile.SYMTYPE)])),
        f"n.zip.{codec}": pack(inner), f"x.tar.{codec}": pack(tarred([("in.zip", inner)])), f"cut.bin.{codec}": pack(body)[:-20000],
    }
    got = {k.split(".")[0]: v for k, v in verdicts(spark, rows).items()}
    assert got == {"a": (None, None), "t": (None, None), "l": ("archive_link_rejected", "l"), "n": ("archive_entry_script_rejected", "run.sh"), "x": ("archive_entry_script_rejected", "run.sh"), "cut": ("archive_unsupported_method", None)}
    few = Policy(max_probe_bytes=1000)
    assert verdicts(spark, {f"a.bin.{codec}": pack(body)}, few)[f"a.bin.{codec}"][0] == "archive_inspection_timeout"


def test_types_do_not_hang_on_size(spark):
    """JSON, markup and text under several names: what fits when short fits when long."""
    for size in (10, 3000, 3060, 3072, 3100, 14_000):
        json = b'{"a": [' + b"1, " * (size // 3) + b'"x"]}'
        html = b"<html>" + b"a " * (size // 2)
        plain = b"word " * (size // 5 + 1)
        got = verdicts(spark, {f"{ext}.zip": zipped([(f"f.{ext}", body)]) for ext, body in (("txt", json), ("json", json), ("html", json), ("csv", plain), ("md", html), ("xml", plain), ("png", json))})
        bad = ("archive_entry_type_mismatch", "f.html"), ("archive_entry_type_mismatch", "f.png")
        assert got == {"txt.zip": (None, None), "json.zip": (None, None), "html.zip": bad[0], "csv.zip": (None, None), "md.zip": (None, None), "xml.zip": (None, None), "png.zip": bad[1]}, size


def test_json_so_far_agrees_with_the_parser():
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice(["a", 'q"\\', "é\n"]): value(depth - 1) for _ in range(rng.randrange(4))}
        return [1.5e-7, -12, True, None, "te\"x\\t"][kind]

    for _ in range(150):
        text = json.dumps([value(3)] if rng.random() < 0.5 else {"k": value(3)}, indent=rng.choice([None, 2]), ensure_ascii=False).encode()
        assert json_so_far(text, False) and json_so_far(b" \n" + text + b" ", False)
        for n in range(1, len(text)):
            assert json_so_far(text[:n], True) == (text[:n].strip() != b""), text[:n]
            assert not json_so_far(text[:n], False)
        at = rng.randrange(len(text))
        spoilt = text[:at] + b"\x01" + text[at:]
        assert not json_so_far(spoilt, False)
    for bad in (b"[1 2", b"{1: 2", b'{"a" 1', b"[tru3", b"[}", b"]", b"[1],", b'{"a":,', b"[,", b'{"a":1,,', b"[--1", b"{a"):
        assert not json_so_far(bad, True), bad
