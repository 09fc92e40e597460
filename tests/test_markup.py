"""Markup verdicts: folded while a document is read, against rules applied to the elements it was made of."""

import random

import pytest

from tidegate.operators import markup
from tidegate.operators.screen import screen
from tidegate.policy import Policy

POLICY = Policy(max_objects=12, max_xml_depth=4)
NAMES = ["g", "text", "use", "a", "rect"]
LAST = ["script", "foreignObject", "use href", "style", "onload", "js", "data"]


def made(rng, n):
    """A document of n elements with text around every one, and its (depth, what) in order."""
    elements, out, depth = [], ["<svg>"], 1
    elements.append((1, "g"))
    for _ in range(n):
        while depth > 1 and rng.random() < 0.4:
            out.append("</g>t")
            depth -= 1
        what = rng.choice(LAST) if rng.random() < 0.1 else "g"
        depth += 1
        elements.append((depth, what))
        start = {"script": "<script/>", "foreignObject": "<x:foreignObject xmlns:x='x'/>", "use href": "<use x:href=' HTTPS://y' xmlns:x='x'/>", "style": "<g style='a:URL(#b)'/>", "onload": "<g onLoad='1'/>", "js": "<g id='JavaScript:1'/>", "data": "<image href='data:,'/>"}
        if what == "g":
            out.append("t<g>t")
        else:
            out.append("t" + start[what] + "t")
            depth -= 1
    out.append("</g>t" * (depth - 1) + "</svg>")
    return "".join(out).encode(), elements


CODES = {"script": "svg_script_detected", "foreignObject": "svg_active_content_rejected", "use href": "svg_external_reference_detected", "data": "svg_external_reference_detected"}


@pytest.mark.parametrize("seed", range(300))
def test_svg_verdict_is_that_of_its_first_bad_element(seed):
    rng = random.Random(seed)
    data, elements = made(rng, rng.randint(0, 14))
    want = None
    for i, (depth, what) in enumerate(elements, 1):
        if depth > POLICY.max_xml_depth or i > POLICY.max_objects:
            want = "resource_limit_exceeded"
        elif what != "g":
            want = CODES.get(what, "svg_active_content_rejected")
        if want:
            break
    assert markup.judged("svg", data, POLICY)[:2] == (want, "svg")


GROUPS = "<g>t</g>t"


@pytest.mark.parametrize("n,tail,code", [
    (70_000, "<script/>", "svg_script_detected"), (99_998, "<script/>", "svg_script_detected"), (99_999, "<script/>", "resource_limit_exceeded"),
    (99_999, "", None), (100_000, "", "resource_limit_exceeded"), (70_000, "<g onload='x'/>", "svg_active_content_rejected"), (70_000, "<g", "structural_validation_failed"),
])
def test_svg_limit_counts_elements_only(n, tail, code):
    assert markup.judged("svg", f"<svg>t{GROUPS * n}{tail}</svg>".encode(), Policy())[0] == code


@pytest.mark.parametrize("n,tail,code", [
    (70_000, "<i:include xmlns:i='http://www.w3.org/2001/XInclude'/>", "xml_xinclude_detected"), (99_999, "", None), (100_000, "", "markup_parser_limit_exceeded"),
    (70_000, "<include xmlns='HTTP://www.w3.org/2001/xinclude'/>", "xml_xinclude_detected"), (70_000, "<include/>", None),
])
def test_xml_limit_counts_elements_only(n, tail, code):
    assert markup.judged("xml", f"<a>t{GROUPS * n}{tail}</a>".encode(), Policy())[0] == code


def test_depth_roots_and_doctypes():
    assert markup.judged("xml", b"<a>" * 65 + b"</a>" * 65, Policy())[0] == "markup_parser_limit_exceeded"
    assert markup.judged("xml", b"<!DOCTYPE a><a/>", Policy())[0] == "xml_external_entity_detected"
    assert markup.judged("svg", b"<!DOCTYPE svg><SVG width='1' viewBox='0 0 1 1'/>", Policy()) == (None, "svg", {"width": "1", "viewbox": "0 0 1 1"})
    assert markup.judged("svg", b"<p:svg xmlns:p='x' xmlns:onload='y'/>", Policy())[0] == "svg_active_content_rejected"
    assert markup.judged("svg", b"", Policy())[0] == "structural_validation_failed"


def test_screen_sees_what_stands_behind_much_text(spark):
    rows = [
        ("a", "a.svg", "image/svg+xml", f"<svg>{GROUPS * 70_000}<script/></svg>"), ("b", "a.svg", "image/svg+xml", f"<svg>{GROUPS * 70_000}</svg>"),
        ("c", "a.xml", "application/xml", f"<?xml version='1.0'?><a>{GROUPS * 70_000}<i:include xmlns:i='http://www.w3.org/2001/XInclude'/></a>"),
        ("d", "a.svg", "image/svg+xml", "<svg viewBox='0 0 99999 1'><script/></svg>"), ("e", "a.svg", "image/svg+xml", "<svgs><script/></svgs>"),
    ]
    df = spark.createDataFrame([(*r[:3], r[3].encode()) for r in rows], "object_key string, original_name string, declared_type string, content binary")
    got = {r.object_key: r.verdict for r in screen(df).collect()}
    assert got == {"a": "svg_script_detected", "b": None, "c": "xml_xinclude_detected", "d": "resource_limit_exceeded", "e": "structural_validation_failed"}


def test_nodes_are_handed_on_in_order(spark):
    n = 10_000
    df = spark.createDataFrame([("a", f"<a>{GROUPS * n}</a>".encode()), ("b", b"<x>one<y k='v'/>two</x>"), ("c", None), ("d", b"<x")], "object_key string, content binary")
    rows = markup.markup_nodes(df).collect()
    own = lambda k: [r for r in rows if r.object_key == k]
    assert [r.seq for r in own("a")] == list(range(1 + 3 * n))
    assert [(r.event, r.name, r.text, r.depth) for r in own("b")] == [("start", "x", None, 1), ("text", "x", "one", 1), ("start", "y", None, 2), ("text", None, "two", 1)]
    assert own("b")[2].attributes == {"k": "v"}
    assert [r.event for r in own("c")] == [r.event for r in own("d")] == ["error"]
