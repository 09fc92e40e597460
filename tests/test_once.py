"""What a row's expensive steps cost: each is worked out once, in time that follows the text's length."""

import io
import random
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from tidegate.functions import text as T
from tidegate.functions.classify import detect_mime
from tidegate.operators import jobs
from tidegate.operators.archive import inspect
from tidegate.operators.extract import extract
from tidegate.plans import texts
from tidegate.policy import PPTX

from .test_extract import SLIDE
from .test_screen import png, text_chunk, zipped


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_literals_are_read_once(spark, data):
    plan = optimized(texts.pdf_literals(spark, data))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("make_valid_utf8") + plan.count("makeValid") <= 1


def test_white_space_as_line_by_line(spark):
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
    plain = lambda s: "\n".join(x.rstrip(space) for x in s.replace("\0", "").split("\n")).strip(space)
    pick = random.Random(3)
    made = ["", " ", "\n", " \n a", "a \n\n b \n", "a \r\n b ", "\0 a\0 \n", "a" + " " * 300_000 + "b \n" + " \n" * 100_000 + "c"]
    made += ["".join(pick.choices("ab\n \t\r\x85　\0é!", k=pick.randrange(12))) for _ in range(2000)]
    rows = spark.createDataFrame([(s,) for s in made], "s string").select("s", T.normalize_whitespace(F.col("s")), T.normalize_text(F.encode("s", "UTF-8"), 1 << 30)["text"]).collect()
    assert all(a == plain(s) and b == a for s, a, b in rows)


def test_pdf_escapes_with_and_without_backslashes(spark):
    body = rb"(plain) (a\(b\)) (\\n\n) (\\) () ( ) (x\)y\\\))"
    assert spark.createDataFrame([(body,)], "b binary").select(T.pdf_literal_text(F.col("b"), 100)["text"]).first()[0] == "plain\na(b)\n\\n\n\n\\\nx)y\\)"


def test_a_package_takes_each_content_once(spark):
    rows = spark.createDataFrame([(1, b"a" * 70_000), (2, b"")], "n long, b binary")
    made = rows.select("n", texts.stored_zip([("x", F.concat("b", F.lit(b"1"))), (F.concat(F.lit("y"), F.col("n").cast("string")), F.col("b")), ("z", F.lit(b""))]).alias("z"))
    assert optimized(made).count("crc32(") == 1
    for n, data in made.collect():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = b"a" * 70_000 if n == 1 else b""
            assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == [("x", body + b"1"), (f"y{n}", body), ("z", b"")]


def test_only_images_are_joined(spark):
    """Texts of packages do not go through an exchange; each row of a repeated key keeps its own."""
    made = [("k", PPTX, zipped({"ppt/slides/slide1.xml": SLIDE.format(f"s{i}")})) for i in range(5)] + [("k", "image/png", png(2, 1, text_chunk(b"Title", b"pic"))), ("t", "text/plain", b"t"), ("n", None, None)]
    found = extract(spark.createDataFrame(made, "object_key string, content_type string, content binary"))
    got = sorted((r.object_key, sorted(r.content.texts.items())) for r in found.collect())
    assert got == [("k", [("extracted", f"s{i}")]) for i in range(5)] + [("k", [("title", "pic")]), ("n", []), ("t", [("text", "t")])]
    assert "Union" in optimized(found).split("Join")[0]


def test_rows_of_many_objects_are_one_batch():
    kinds, names = [pa.string(), pa.binary()], ["k", "b"]
    small = list(jobs._batches(((str(i), b"x") for i in range(10_000)), kinds, names, 1))
    assert [b.num_rows for b in small] == [4096, 4096, 1808] and pa.Table.from_batches(small).column("k").to_pylist() == [str(i) for i in range(10_000)]
    large = list(jobs._batches(((str(i), bytes(1 << 21)) for i in range(5)), kinds, names, 1))
    assert [b.num_rows for b in large] == [2, 2, 1] and list(jobs._batches(iter(()), kinds, names, 1)) == []


def test_first_bytes_stay_out_of_the_windows(spark):
    rows = spark.createDataFrame([("k", "a.zip", "application/zip", zipped({"a.txt": "text", "run.sh": "echo"}))], "object_key string, original_name string, declared_type string, content binary")
    found = inspect(rows)
    assert tuple(found.first()) == ("k", "archive_entry_script_rejected", "run.sh")
    windows = [line for line in optimized(found).split("\n") if "Window [" in line]
    above = optimized(found).split("Window [")
    assert windows and not any("prefix" in part.split("\n")[0] for part in above) and all("prefix#" not in part for part in above[:-1])


def test_detection_takes_the_head_once(spark):
    made = spark.range(1).select(F.encode(F.concat(F.lit("<?xml "), F.col("id").cast("string")), "UTF-8").alias("b")).select(detect_mime(F.col("b")))
    assert optimized(spark.createDataFrame([(b"<?xml ",)], "b binary").select(detect_mime(F.col("b")))).count("decode(") <= 2
    assert made.first()[0] == "text/xml"
