"""Rubrics read end to end, with judges that read headings by pattern and fail in known ways."""

import json
import re

import pandas as pd
import pytest

from markloom.functions.text import estimate_tokens
from markloom.plans import rubrics

DOC = "doc_id long, text string"
WORDS = lambda label, n: " ".join(f"{label}{i}" for i in range(n))
BULK = 900
PAPER = "\n".join([
    f"PHYSICS (Theory)\nSECTION – E\n31. (a) Derive the field of a dipole. {WORDS('qa', BULK)}\n(b) Calculate the force and torque. 5",
    f"32. (a) Derive the lens formula. {WORDS('qb', BULK)}\n(b) Find the image distance. 5",
    f"33. (a) State the induction law. {WORDS('qc', BULK)}\n(c) Find the emf induced in the rod. 5",
])
SCHEME = "\n".join([
    f"MARKING SCHEME\n31\nDeriving the expression 2½ {WORDS('ma', BULK)}\nCalculating force and torque 2",
    f"32\nDeriving the lens formula 3 {WORDS('mb', BULK)}\nFinding the image distance 2",
    f"33\nStating the law 1 {WORDS('mc', BULK)}\nDeriving self-inductance 2\nFinding the induced emf 2",
])
CRITERIA = {31: [("Deriving the expression", 2.5), ("The far field", 0.5), ("Force and torque", 2)], 32: [("Deriving the lens formula", 3), ("Finding the image distance", 2)], 33: [("Stating the law", 1), ("Deriving self-inductance", 2), ("Finding the induced emf", 2)]}
FLAGS = {"continuesFromPreviousChunk": False, "continuesIntoNextChunk": False}


def tokens(text):
    words, signs = re.findall(r"\S+", text), re.findall(r"[^\w\s]|_", text)
    return max(-(-len(text) * 10 // 32), len(words) * 1.3 + len(signs) * 0.5)


def readers(seen, refuse_above=None, garble=None, without=()):
    def numbers(text):
        return [int(n) for n in re.findall(r"(?:^|\n)\s*(3[1-3])\b", text)]

    def reply(batch, make):
        rows = []
        for _, r in batch.iterrows():
            if refuse_above and tokens(r["text"]) > refuse_above:
                rows.append(("too_large", None))
            elif garble and garble in r["text"] and tokens(r["text"]) > 400:
                rows.append(("ok", '{"questions": [{"number": 3'))
            else:
                seen(r)
                rows.append(("ok", json.dumps({"questions": [make(n) | FLAGS for n in numbers(r["text"])]})))
        return pd.DataFrame(rows, columns=["outcome", "raw"])

    paper = lambda b: reply(b, lambda n: {"number": n, "subject": "Physics", "prompt": f"Question {n} as set", "maxMarks": 5, "requiresDiagram": False})
    points = lambda n: [] if n in without else [{"description": d, "maxMarks": m} for d, m in CRITERIA[n]]
    scheme = lambda b: reply(b, lambda n: {"number": n, "maxMarks": 5, "modelAnswer": f"Worked answer {n}", "guidance": ["Accept any other method"], "requiresDiagram": False, "criteria": points(n)})
    return rubrics.Readers(scheme, paper)


def collect(got):
    return {r.doc_id: r for r in got.rubrics.collect()}, {(r.doc_id, r.number): r for r in got.questions.collect()}, sorted((r.doc_id, r.criterion_id, r.max_marks, r.source) for r in got.criteria.collect()), {r.doc_id: r.reasons for r in got.failures.collect()}


@pytest.fixture(scope="module")
def logged(tmp_path_factory):
    """A file that judges write what they read to, since they run in other processes."""
    path = tmp_path_factory.mktemp("seen") / "log"

    def seen(row):
        with path.open("a") as f:
            f.write(json.dumps({"text": row["text"], "known": [k["number"] for k in row["known"]] if "known" in row and row["known"] is not None else None, "path": [int(p) for p in row["path"]]}) + "\n")

    def read():
        lines = [json.loads(x) for x in path.read_text().splitlines()]
        path.write_text("")
        return lines

    return seen, read


def test_read_in_pieces_and_joined_by_number(spark, logged):
    seen, read = logged
    got = rubrics.read_rubrics(spark.createDataFrame([(1, SCHEME)], DOC), spark.createDataFrame([(1, PAPER)], DOC), readers(seen), 3000)
    heads, questions, criteria, failures = collect(got)
    log = read()
    assert not failures and heads[1].source == "model" and heads[1].total_marks == 15 and sorted(n for _, n in questions) == [31, 32, 33]
    assert heads[1].warnings[0].startswith("Read in pieces:") and rubrics.BY_MODEL in heads[1].warnings
    last = questions[1, 33]
    assert last.prompt == "Question 33 as set" and last.subject == "Physics" and last.guidance == ["Accept any other method"]
    # The worked answer is the scheme's own text of the question, not the judge's copy.
    assert "Stating the law 1" in last.model_answer and "Finding the induced emf 2" in last.model_answer and "lens formula" not in last.model_answer
    assert [(i, m) for d, i, m, s in criteria if i.startswith("q33")] == [("q33c1", 1.0), ("q33c2", 2.0), ("q33c3", 2.0)] and {s for *_, s in criteria} == {"instructor"}
    # Several requests a document, none with all of it; the scheme is read with the paper's questions.
    assert len([x for x in log if x["known"] is None]) > 1 and len([x for x in log if x["known"]]) > 1 and max(len(x["text"]) for x in log) < len(PAPER)
    assert all(x["known"] == [31, 32, 33] for x in log if x["known"])


def test_refused_and_unusable_pieces_are_split(spark, logged):
    """One document refused above 900 tokens; another whose middle is misread until it's small."""
    seen, read = logged
    schemes = spark.createDataFrame([(1, SCHEME)], DOC)
    got = rubrics.read_rubrics(schemes, spark.createDataFrame([(1, PAPER)], DOC), readers(seen, refuse_above=900), 3000)
    _, questions, _, failures = collect(got)
    log = read()
    assert sorted(n for _, n in questions) == [31, 32, 33] and not failures
    assert all(tokens(x["text"]) <= 900 for x in log) and any(len(x["path"]) > 1 for x in log)
    _, questions, criteria, failures = collect(rubrics.read_rubrics(schemes, None, readers(seen, garble="mb"), 3000))
    assert sorted(n for _, n in questions) == [31, 32, 33] and not failures and len(criteria) == 8
    read()


def test_what_can_not_be_read_is_a_failure_and_the_rest_is_kept(spark, logged):
    """A parsed scheme beside one without questions and one refused throughout; a question without criteria."""
    seen, read = logged
    parsed = "Q1 — Optics\nModel Answer — 3 marks\nLight bends.\nMarking rubric\nCriterion Marks\nNames refraction 1\nExplains it 2\nTotal 3\nImportant grading guidance\nAccept everyday words for bending."
    schemes = spark.createDataFrame([(1, parsed), (2, "nothing of use"), (3, SCHEME)], DOC)
    heads, questions, criteria, failures = collect(rubrics.read_rubrics(schemes, None, readers(seen, without=(32,)), 3000))
    assert heads[1].source == "parsed" and heads[3].source == "model" and set(heads) == {1, 3}
    assert failures == {2: ["No questions could be read from the marking scheme."]}
    assert [r for r in criteria if r[0] == 3 and r[1].startswith("q32")] == [(3, "q32c1", 5.0, "ai-inferred")] and questions[3, 31].prompt == ""
    assert any(w.startswith("Question 32: the scheme has no criteria") for w in heads[3].warnings)
    infer = lambda b: pd.DataFrame({"outcome": ["ok"] * len(b), "raw": [json.dumps({"criteria": [{"description": "one", "maxMarks": 1}, {"description": "two", "maxMarks": 3}]})] * len(b)})
    own = readers(seen, without=(32,))
    _, _, criteria, _ = collect(rubrics.read_rubrics(spark.createDataFrame([(3, SCHEME)], DOC), None, rubrics.Readers(own.scheme, None, infer), 3000))
    assert [(i, s) for d, i, m, s in criteria if i.startswith("q32")] == [("q32c1", "ai-inferred"), ("q32c2", "ai-inferred")] and sum(m for d, i, m, s in criteria if i.startswith("q32")) == 5
    assert set(collect(rubrics.read_rubrics(spark.createDataFrame([(2, "x")], DOC), None, None, 3000))[3]) == {2}
    read()


def test_token_estimate_of_these_tests(spark):
    df = spark.createDataFrame([(SCHEME,)], "t string")
    assert abs(df.select(estimate_tokens(df["t"])).first()[0] - tokens(SCHEME)) <= 2
