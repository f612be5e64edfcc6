"""Answers attributed over chunks: each departure from the plain case, and the plan with judges that fail."""

import json

import pandas as pd
import pytest

from markloom.operators import segment
from markloom.plans import attribute

CHUNKS = "doc_id string, path array<int>, text string"
TOLD = "doc_id string, place int, ordinal int, number int, begins boolean, first_words string"


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(f"q{n}", n, f"prompt {n}") for n in (1, 2, 3, 4)], "question_id string, number int, prompt string")


def table(df, doc):
    return {r.number: (r.text, r.start_page, r.approximate) for r in df.filter(df["doc_id"] == doc).collect()}


def test_each_case(spark, questions):
    pages = [("a", 0, "The bulb glows here."), ("a", 1, "Prices rise. The bulb   GLOWS again."), ("a", 2, "More of prices."), ("b", 0, "one"), ("c", 0, "same\nsame")]
    docs = segment.joined_pages(spark.createDataFrame(pages, "doc_id string, page int, text string"))
    chunks = [("a", [0], "The bulb glows here."), ("a", [1, 0], "Prices rise. The bulb   GLOWS again."), ("a", [2], "More of prices."), ("b", [0], "one"), ("c", [0], "same"), ("c", [1], "same")]
    placed = segment.placed_chunks(docs, spark.createDataFrame(chunks, CHUNKS))
    assert [(r.doc_id, r.place, r.start, r.start_page) for r in placed.orderBy("doc_id", "place").collect()] == [("a", 0, 0, 0), ("a", 1, 21, 1), ("a", 2, 58, 2), ("b", 0, 0, 0), ("c", 0, 0, 0), ("c", 1, 5, 0)]
    told = [
        ("a", 0, 0, 1, False, "The bulb glows"),  # seen, not begun
        ("a", 1, 0, 1, True, "the bulb glows"),  # begins in the second chunk: the same words in the first don't win
        ("a", 1, 1, 2, True, "words that are not there"),  # begins at the chunk's start
        ("a", 2, 0, 2, True, "More of"),  # only the first beginning counts
        ("a", 1, 2, 3, False, None), ("a", 2, 1, 3, False, None),  # mentioned twice, never begun
        ("a", 0, 1, 9, True, "The"),  # no such question
        ("c", 1, 0, 4, True, None),
    ]
    got = segment.attributed(placed, spark.createDataFrame(told, TOLD), questions)
    assert table(got, "a") == {
        1: ("The bulb   GLOWS again.\nMore of prices.", 1, False), 2: ("Prices rise.", 1, False),
        3: ("Prices rise. The bulb   GLOWS again.\nMore of prices.", 1, True), 4: ("", 0, True),
    }
    assert table(got, "b") == {} and table(got, "c")[4] == ("same", 0, False)


def test_plan(spark, questions):
    """Sheets with headings keep them; bare ones are attributed; one that can't be sent and one not understood fall back."""
    filler = " ".join(f"word{i}" for i in range(120))
    pages = [("head", 0, "Answer 1\nBy heading."), ("bare", 0, f"First about light.\n{filler}\n"), ("bare", 1, f"Then about sound.\n{filler}"), ("stuck", 0, "REFUSE"), ("dumb", 0, "GARBLE"), ("late", 0, "First slow.")]
    pages = spark.createDataFrame(pages, "doc_id string, page int, text string")

    def judge(batch):
        out = []
        for text, attempt, asked in zip(batch["text"], batch["attempt"], batch["questions"]):
            assert [q["number"] for q in asked] == [1, 2, 3, 4]
            if "REFUSE" in text:
                out.append(("too_large", None))
            elif text.startswith("First slow") and attempt == 1:
                out.append(("transient", None))
            elif "GARBLE" in text:
                out.append(("ok", "what?"))
            else:
                answers = [{"questionNumber": n, "beginsInThisChunk": True, "firstWords": w} for n, w in ((1, "First"), (2, "Then about")) if w in text]
                out.append(("ok", json.dumps({"answers": answers})))
        return pd.DataFrame(out, columns=["outcome", "raw"])

    waits = []
    got = attribute.answers_of(pages, questions, judge, 200, pause=waits.append)
    assert table(got, "head")[1] == ("By heading.", 0, False)
    bare = table(got, "bare")
    assert bare[1][0].startswith("First about light.") and bare[1][0].endswith("word119") and "sound" not in bare[1][0] and bare[2][0].startswith("Then about sound.") and not bare[2][2]
    assert table(got, "stuck") == {n: ("REFUSE", 0, True) for n in (1, 2, 3, 4)} and table(got, "dumb") == {n: ("GARBLE", 0, True) for n in (1, 2, 3, 4)}
    assert table(got, "late")[1] == ("First slow.", 0, False) and waits == [0.4]
    assert got.filter("doc_id = 'bare' AND number = 3").first().blank
