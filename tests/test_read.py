"""Scans read end to end, by a transcriber that fails in known ways and writes down what it was asked."""

import json

import pytest

from markloom.plans import read

PAGES = "doc_id string, page int, text string, source string, image string"
TYPED = "A typed page with quite enough text to be read as it is, so that nobody asks for it."


def line(text, k, **more):
    return {"text": text, "top": k * 100.0, "bottom": k * 100.0 + 60, "left": 50.0, "right": 900.0} | more


def page(lines, **more):
    return json.dumps({"lines": [line(t, k) if isinstance(t, str) else t for k, t in enumerate(lines)], "diagrams": [], "unclear": [], "struck": [], "questionNumbers": [], "legibility": "good"} | more)


DRAWING = {"marker": 1, "description": " a circuit ", "labels": ["A", "V"], "top": 110.0, "bottom": 190.0, "left": 100.0, "right": 800.0}
LOOP = [f"[diagram {k}]" for k in range(30)] + ["the very same long line of text again"] * 3


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    log = tmp_path_factory.mktemp("asked") / "log"
    pages = [
        ("a", 0, TYPED, "text-layer", None), ("a", 1, "", "text-layer", "first"), ("a", 2, None, None, "second"), ("a", 3, "", None, "third"),
        ("loop", 0, "", None, "looping"), ("calm", 0, "", None, "loops once"), ("big", 0, "", None, "huge"), ("flaky", 0, "", None, "flaky"),
        ("bad", 0, "", None, "misshapen"), ("bad", 1, "", None, "never asked"), ("typed", 0, TYPED, "text-layer", None), ("done", 0, "", "transcription", None), ("empty", 0, "", None, "empty"),
    ]
    tries = {}

    def ask(row):
        with log.open("a") as f:
            f.write(json.dumps([row["doc_id"], row["page"], row["previous_tail"], row["smaller"], row["focus"], row["page_count"]]) + "\n")
        image = row["image"]
        tries[image] = tries.get(image, 0) + 1
        if image == "first":
            if row["focus"]:
                return "ok", page([], diagrams=[DRAWING]), None
            return "ok", page(["Answer 31", "see [diagram 1]", "x" * 400], questionNumbers=[31], legibility="fair", unclear=["word"]), None
        if image == "second":
            return "ok", page(["g31 (b) more of it", "g77 no heading"], questionNumbers=[]), None
        if image == "third":
            return "ok", page(["plain [diagram 2] here"], diagrams=[DRAWING | {"marker": 2}, DRAWING | {"marker": 5}]), None
        if image == "looping" or image == "loops once" and not row["smaller"]:
            return "ok", page(LOOP), None
        if image == "huge" and not row["smaller"]:
            return "too_large", None, None
        if image == "flaky" and tries[image] < 3:
            return "transient", None, "busy"
        if image == "misshapen":
            return "ok", '{"lines": [{"top": 3}], "legibility": "fine"}', None
        return "ok", page([]) if image == "empty" else f"Here it is: {page(['short and sweet'])} done", None

    ink = spark.createDataFrame([("a", 1, 0.02, 0.05, 0.1, 0.8), ("a", 1, 0.21, 0.25, 0.1, 0.7), ("a", 2, 0.01, 0.06, 0.1, 0.5), ("a", 2, 0.12, 0.15, 0.1, 0.5)], "doc_id string, page int, top double, bottom double, left double, right double")
    out = read.read_documents(spark.createDataFrame(pages, PAGES).repartition(3), ask, ink, pause=lambda s: None)
    texts = {(r.doc_id, r.page): (r.text, r.source) for r in out.pages.collect()}
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    return texts, out.runs.collect(), {r.doc_id: r for r in out.documents.collect()}, asked


def test_pages_are_read_in_order_with_the_tail_of_the_one_before(got):
    texts, _, documents, asked = got
    assert texts["a", 0] == (TYPED, "text-layer") and texts["typed", 0] == (TYPED, "text-layer") and texts["done", 0] == ("", "transcription")
    of_a = [x for x in asked if x[0] == "a" and x[4] is None]
    assert [x[1] for x in of_a] == [1, 2, 3] and {x[5] for x in of_a} == {4}
    assert of_a[0][2] is None and of_a[1][2] == "x" * 300 and of_a[2][2].endswith("g77 no heading")
    assert {d for d, *_ in asked}.isdisjoint({"typed", "done"}) and set(documents) == {"a", "loop", "calm", "big", "flaky", "bad", "empty"}
    assert documents["a"].status == "done" and list(documents["a"].read) == [1, 2, 3] and documents["a"].legibility == "fair" and documents["a"].unclear == ["word"]


def test_drawings_and_headings(got):
    texts, runs, _, asked = got
    # Asked for its drawings alone, once, without the tail; the line takes the drawing's box, and is moved by no ink.
    assert [x for x in asked if x[4] == "diagrams"] == [["a", 1, None, False, "diagrams", 4]]
    first, source = texts["a", 1]
    assert first.split("\n")[1] == "see [Diagram 1: a circuit Labels: A | V.]" and source == "transcription"
    boxes = {r.text: r.rect for r in runs if (r.doc_id, r.page) == ("a", 1)}
    assert boxes["Answer 31"].y == 0.02
    # A number that one page told is expected on all of them; another stays.
    assert texts["a", 2][0] == "Q31 (b) more of it\ng77 no heading"
    # A description that nobody placed comes last; runs lie where the text has them.
    assert texts["a", 3][0].split("\n") == ["plain [Diagram 2: a circuit Labels: A | V.] here", "[Diagram 5: a circuit Labels: A | V.]"]
    at = [r for r in runs if (r.doc_id, r.page) == ("a", 3)]
    assert all(texts["a", 3][0][r.start : r.end] == r.text for r in at) and (at[0].rect.y, at[0].rect.height) == (0.11, pytest.approx(0.08))


def test_looping_refused_and_failing_pages(got):
    texts, _, documents, asked = got
    assert [x[3] for x in asked if x[0] == "loop"] == [False, True] and documents["loop"].legibility == "poor" and "unstable" in documents["loop"].unclear[0]
    assert texts["loop", 0][0].count("the very same long line") == 1 and texts["loop", 0][0].count("[Diagram") == 1
    assert texts["calm", 0][0] == "short and sweet" and documents["calm"].legibility == "good"
    assert texts["big", 0][0] == "short and sweet" and [x[3] for x in asked if x[0] == "big"] == [False, True]
    assert texts["flaky", 0][0] == "short and sweet" and len([x for x in asked if x[0] == "flaky"]) == 3
    assert documents["bad"].status == "failed" and "lines.0.text: Required" in documents["bad"].error and texts["bad", 0][0] == "" and [x[1] for x in asked if x[0] == "bad"] == [0, 0, 0]
    assert texts["empty", 0] == ("", "transcription") and documents["empty"].status == "done"


def test_without_a_transcriber(spark):
    out = read.read_documents(spark.createDataFrame([("a", 0, "", None, None), ("b", 0, TYPED, None, None)], PAGES), None)
    assert [(r.doc_id, r.status) for r in out.documents.collect()] == [("a", "unsupported")] and out.pages.count() == 2
