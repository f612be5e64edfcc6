"""Operators on authored fixtures, end to end and one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.operators import anchor, chunk, diagram, judge, passes, pixels, rubric, search, segment, transcript, validate
from markloom.plans import ask, grade
from markloom.sources import documents, report, store
from markloom.streaming import ingest, limits

RECT = "struct<page:int,x:double,y:double,width:double,height:double>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


PAGES = [
    ("a", 0, "Name: A\nAnswer 1\nThe circuit is one closed path in which current flows. The ammeter is conected in series with the bulb.\nAnswer 2\n(a)\nDemand falls when the price rises, all else equal."),
    ("a", 1, "It is shown by a curve.\nSee Answer 1 above."),
    ("b", 0, "Answer 1\nThe circuit is an open path so current leaps across.\nAnswer 2\nx"),
    ("c", 0, "no headings here but quite a few words about circuits and prices in general"),
]
QUESTIONS = [("q1", 1), ("q2", 2)]
CRITERIA = [("q1", "q1c1", 1, "States that the path is closed", 2.0), ("q1", "q1c2", 2, "Ammeter in series", 1.0), ("q2", "q2c1", 1, "Law of demand", 2.0)]
RULES = [
    ("q1c1", "States that the path is closed", "fault", 1, False, "circuit is an open path", "A circuit is closed.", "Say closed."), ("q1c1", "states that the path is CLOSED!", "award", 1, False, "one closed path", "Right.", None),
    ("q1c1", "States that the path is closed", "missing", 1, False, None, "Closed path missing.", "Say so."), ("q1c2", "Ammeter in series", "award", 1, False, "ammeter is connected in series", "Right.", None),
    ("q1c2", "Ammeter in series", "partial", 1, True, "conected", "Spelling of connected.", "connected"), ("q1c2", "Ammeter in series", "missing", 1, False, None, "Ammeter missing.", None),
    ("q2c1", "Law of demand", "award", 1, True, r"[Dd]emand falls", "Right.", None), ("q2c1", "Law of demand", "missing", 1, False, None, "Law missing.", None), ("q2c1", "Another paper's wording", "fault", 1, False, "demand falls", "Never fires.", None),
]


@pytest.fixture(scope="module")
def paper(spark):
    pages = spark.createDataFrame(PAGES, "doc_id string, page int, text string")
    questions = spark.createDataFrame(QUESTIONS, "question_id string, number int")
    criteria = spark.createDataFrame(CRITERIA, "question_id string, criterion_id string, ordinal int, description string, max_marks double")
    return pages, questions, criteria, spark.createDataFrame(RULES, judge.RULES)


def test_segments(paper):
    pages, questions, _, _ = paper
    got = {(r.doc_id, r.number): r for r in segment.segments(segment.joined_pages(pages), questions).collect()}
    assert got["a", 1].text.startswith("The circuit") and got["a", 1].text.endswith("bulb.") and not got["a", 1].approximate
    assert got["a", 2].text == "(a)\nDemand falls when the price rises, all else equal.\nIt is shown by a curve.\nSee Answer 1 above."
    assert got["c", 1].approximate and got["c", 2].text == PAGES[3][2] and got["a", 2].start_page == 0


@pytest.fixture(scope="module")
def graded(paper):
    pages, questions, criteria, rules = paper
    answers = grade.answers_of(pages, questions)
    return grade.grade(pages, questions, criteria, grade.rule_judged(answers, criteria, rules), answers=answers)


def test_grading_end_to_end(graded):
    out = graded
    assert rows(out["scores"], "doc_id", "criterion_id", "mark", "status") == [
        ("a", "q1c1", 2.0, "correct"), ("a", "q1c2", 0.5, "partial"), ("a", "q2c1", 2.0, "correct"), ("b", "q1c1", 0.0, "incorrect"), ("b", "q1c2", 0.0, "missing"),
        ("c", "q1c1", 0.0, "missing"), ("c", "q1c2", 0.0, "missing"), ("c", "q2c1", 0.0, "missing"),
    ]
    papers = {r.doc_id: r for r in out["papers"].collect()}
    assert papers["a"].total == 4.5 and papers["a"].max_marks == 5.0 and papers["b"].total == 0.0 and papers["b"].blank == 1 and papers["b"].needs_review
    assert out["violations"].count() == 0
    assert rows(out["audit"].filter("kind = 'blank_answer_detected'"), "doc_id", "question_id") == [("b", "q2")]
    notes = {(r.doc_id, r.criterion_id): r for r in out["annotations"].collect()}
    # Without text runs a quote is verified, but has no box: a note in the margin.
    assert {(r.doc_id, r.criterion_id): r.anchor for r in out["scores"].collect()}["a", "q1c2"] == "exact"
    assert notes["a", "q1c2"].anchor_status == "unresolved" and "conected" in notes["a", "q1c2"].quote and notes["a", "q1c1"].kind == "praise"
    assert notes["b", "q1c2"].rect.x == 0.8 and notes["b", "q1c2"].anchor_status == "unresolved"


LONG = "Plants take in light and water, and make sugar from them in the leaf. " * 6


@pytest.fixture(scope="module")
def examined(spark):
    """One document for each of SURVEY's vectors, one judged in two passages, a scan, an unread scan, an unusable judgement."""
    ids = ["near", "fake", "over", "two", "scan", "unread", "undone"]
    pages = spark.createDataFrame([(d, 0, f"Answer 1\n{LONG}The path is closed. The lamp is lit. The wire is bare. battery bulb switch") for d in ids] + [("near", 1, "It goes on here.")], "doc_id string, page int, text string")
    questions = spark.createDataFrame([("q1", 1)], "question_id string, number int")
    criteria = spark.createDataFrame([("q1", f"c{i}", i, f"point {i}", 1.0) for i in range(1, 6)], "question_id string, criterion_id string, ordinal int, description string, max_marks double")
    at = len(f"Answer 1\n{LONG}")
    runs = []
    for d in ids:
        runs += [(d, 0, 0, "The path is closed. ", at, at + 20, (0, 0.1, 0.3, 0.6, 0.02)), (d, 0, 1, "The lamp is lit. ", at + 20, at + 37, (0, 0.1, 0.33, 0.6, 0.02)), (d, 0, 2, "The wire is bare.", at + 37, at + 54, (0, 0.1, 0.36, 0.6, 0.02))]
        runs += [(d, 0, 3 + k, t, at + 55 + 8 * k, at + 55 + 8 * k + len(t), (0, x, y, 0.1, 0.02)) for k, (t, x, y) in enumerate([("battery", 0.3, 0.6), ("bulb", 0.5, 0.65), ("switch", 0.4, 0.7)])]
    runs = spark.createDataFrame(runs, f"doc_id string, page int, run_no int, text string, start int, end int, rect {RECT}")
    quotes, box = ["The path is closed", "The lamp is lit", "The wire is bare"], (0, 0.35, 0.62, 0.1, 0.1)
    said = []

    def judged(d, c, awarded, own, quote=None, seen=None, comment=None, region=None, pass_no=1, repairs=0):
        said.append((d, "q1", c, f"c{c}", awarded, "correct", quote, seen, comment, None, own, region, pass_no, repairs))

    for c in range(1, 6):
        comment = {1: "at the words", 4: "on the drawing", 5: "nowhere"}.get(c)
        judged("near", c, 1.0, 0.68, quotes[c - 1] if c < 4 else None, quotes[0] if c == 1 else None, comment, box if c == 4 else None)
        judged("fake", c, 1.0, 0.95, f"words {c} that nobody wrote in this answer")
        judged("over", c, 9.0, 0.99)
        judged("two", c, 0.5, 0.9, quotes[0], pass_no=1)
        judged("two", c, 1.0 if c < 3 else 0.5, 0.8, quotes[1], pass_no=2, repairs=1)
        judged("scan", c, 1.0, 0.9, quotes[0])
        judged("unread", c, 1.0, 0.9, quotes[0])
    kind = f"doc_id string, question_id string, ordinal int, criterion_id string, awarded double, status string, quote string, finding_quote string, comment string, correction string, self double, region {RECT}, pass_no int, repairs int"
    documents = spark.createDataFrame([(d, {"scan": "done", "unread": "failed"}.get(d), 4 if d == "scan" else 0) for d in ids], "doc_id string, transcription string, unclear int")
    ungraded = spark.createDataFrame([("undone", "q1", "The reply could not be read.")], "doc_id string, question_id string, reason string")
    return grade.grade(pages, questions, criteria, spark.createDataFrame(said, kind), runs, documents=documents, ungraded=ungraded)


def test_confidence_vectors_come_out_of_grading(examined):
    got = {r.doc_id: r for r in examined["questions"].collect()}
    assert [got[d].confidence for d in ("near", "fake", "over")] == [0.61, 0.57, 0.5415]
    # Two passages: least self-confidence, all quotes verified, one repair; the best mark of each point, not snapped.
    assert got["two"].awarded == 3.5 and got["two"].confidence == round(0.8 - 0.15, 4) and any("2 passages" in f for f in got["two"].factors)
    assert got["scan"].confidence == round(0.9 - 0.05 - 0.12, 4) and got["undone"].state == "ungraded" and got["undone"].confidence == 0.0
    assert got["undone"].awarded == 0.0 and got["undone"].max_marks == 5.0


def test_reviews_name_what_they_are_for(examined):
    papers = {r.doc_id: r for r in examined["papers"].collect()}
    assert papers["near"].reasons == ["Overall confidence is 61%.", "Question 1 has a confidence of only 61%."]
    assert papers["unread"].reasons[0].startswith("The script is a scan") and papers["unread"].needs_review
    assert any("(Q1)" in r and "could not be marked" in r for r in papers["undone"].reasons) and not papers["scan"].needs_review
    kinds = {(r.doc_id, r.kind) for r in examined["audit"].collect()}
    assert {("fake", "evidence_unverified"), ("over", "clamped_above_max"), ("two", "malformed_output_repaired"), ("undone", "malformed_output_unrecoverable"), ("near", "anchor_unresolved")} <= kinds
    assert examined["violations"].count() == 0


def test_annotations_stand_at_words_drawings_or_the_margin(examined):
    got = {r.criterion_id: r for r in examined["annotations"].filter("doc_id = 'near'").collect()}
    assert [got[c].anchor_status for c in ("c1", "c4", "c5")] == ["exact", "region", "unresolved"]
    assert got["c1"].rect.y == 0.3 and abs(got["c4"].rect.y - 0.585) < 1e-9 and got["c5"].rect.x == 0.8 and got["c5"].rect.page == 0 and got["c5"].slot == 2


def test_margin_notes_stand_on_the_last_page_touched(spark):
    pages = spark.createDataFrame([("d", 0, "Answer 1\nThe first words of it"), ("d", 1, "and the very last words of it")], "doc_id string, page int, text string")
    runs = spark.createDataFrame([("d", 0, 0, "The first words of it", 9, 30, (0, 0.1, 0.1, 0.6, 0.02)), ("d", 1, 0, "and the very", 0, 12, (1, 0.1, 0.1, 0.2, 0.02)), ("d", 1, 1, " last words of it", 12, 29, (1, 0.1, 0.2, 0.6, 0.02))], f"doc_id string, page int, run_no int, text string, start int, end int, rect {RECT}")
    said = spark.createDataFrame([("d", "q1", 1, "c1", 1.0, "correct", None, "the very last words of it", "there", None, 0.9), ("d", "q1", 2, "c2", 1.0, "missing", None, None, "nowhere", None, 0.9)], "doc_id string, question_id string, ordinal int, criterion_id string, awarded double, status string, quote string, finding_quote string, comment string, correction string, self double")
    answers = spark.createDataFrame([("d", "q1", 1, "x", 0, False, False)], "doc_id string, question_id string, number int, text string, start_page int, approximate boolean, blank boolean")
    got = {r.criterion_id: r for r in grade.place_annotations(said, answers, pages, runs)[0].collect()}
    assert got["c2"].rect.page == 1 and got["c1"].rect.width == 0.6 and [r.y for r in got["c1"].extra_rects] == [0.1]


def plain_search(quotes, texts, threshold=0.74):
    """Every window of every text, token by token."""
    fold = lambda w: w.replace("rn", "m").translate(str.maketrans("l1|05", "iiios"))

    def near(a, b):
        a, b = fold(a), fold(b)
        table = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return 1 - table[-1][-1] / max(len(a), len(b), 1)

    out = set()
    for q, quote in quotes:
        for d, text in texts:
            if len(quote) < 8 or not text:
                continue
            if quote in text:
                out.add((q, d, "exact", text.index(quote), 1.0))
                continue
            words, phrase, best = text.split(), quote.split(), (0.0, 0)
            for i in range(len(words) - len(phrase) + 1):
                sims = [near(p, w) for p, w in zip(phrase, words[i:])]
                score = 0.0 if min(sims) < 0.68 else sum(sims) / len(sims)
                best = max(best, (score, -i))
            if best[0] >= threshold:
                out.add((q, d, "fuzzy", -best[1], round(best[0], 9)))
    return out


def test_quotes_are_found_with_any_slips(spark):
    """Slips in every third word, or in every word, that share no run of words with the quote."""
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in ("ran", "modern", "l1ght", "water", "stem") for b in ("o", "ing", "tion", "s0") for c in ("", "al", "rn")]
    texts = [(d, " ".join(rng.choice(vocabulary, 60))) for d in range(12)] + [(50, ""), (51, "short")]
    quotes = [(90, "tiny"), (91, "nothing like it anywhere at all")]
    for d, t in texts[:12]:
        words = t.split()
        part = words[d : d + 3 + d % 6]
        quotes.append((d, " ".join(part)))
        quotes.append((100 + d, " ".join(w[:2] + w[3:] if len(w) > 5 else w for w in part)))
        quotes.append((200 + d, " ".join("z" + w[1:] if i % 3 == 1 else w for i, w in enumerate(part))))
    got = search.search_quotes(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string").repartition(3))
    found = {(*tuple(r)[:4], round(r.similarity, 9)) for r in got.collect()}
    assert found == plain_search(quotes, texts) and sum(r[2] == "fuzzy" for r in found) > 15


def test_far_tokens_are_ruled_out_without_an_edit_distance(monkeypatch):
    import itertools

    words = ["".join(w) for n in range(6) for w in itertools.product("abm", repeat=n)][::3] + ["photosynthesis", "fotosinthesis", "strasse", "straße", "über", "uber"]
    assert all(search.may_be_near(a, b) for a in words for b in words if search.similarity(a, b) >= search.TOKEN_FLOOR)
    called = []
    monkeypatch.setattr(search, "distance", lambda a, b: called.append((a, b)) or 9)
    held = search.Quotes([(1, "alpha beta")], 0.74, {})
    assert held._similar("alpha", "zzzzz") < search.TOKEN_FLOOR and held._similar("alpha", "alphabets") < search.TOKEN_FLOOR and not called


def test_fuzzy_anchors_query(spark):
    """The registered query against plain Python, on the small tables (ASCII items, to keep it short)."""
    import re

    import duckdb

    from markloom import queries

    normal = lambda t: " ".join("".join(c for c in re.sub(r"\s+", " ", t or "") if c.isalnum() or c == " ").lower().split())
    data = "/root/testdata/sf0.001"
    got = {(r.item_id, r.doc_id, r.word, r.similarity) for r in queries.fuzzy_anchors(spark, data).collect()}
    docs = [(d, normal(t)) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()]
    items = [(i, normal(re.sub(r"([^\W\d_]{3})[^\W\d_]([^\W\d_]{3,})", r"\1\2", t))) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()]
    near = {(i, d) for i, d, _, _ in got}
    some = [x for x in items if any(x[0] == i for i, _ in near)][:4] + items[:2]
    want = {(i, d, w, s) for i, d, status, w, s in plain_search(some, docs[:60] + [x for x in docs if x[0] in {d for _, d in near}]) if status == "fuzzy"}
    ids = {i for i, _ in some}
    checked = {d for d, _ in docs[:60]} | {d for _, d in near}
    assert {(i, d, w) for i, d, w, _ in got if i in ids and d in checked} == {(i, d, w) for i, d, w, _ in want}


def test_error_kinds(spark):
    rows_in = [(400, "quota exceeded"), (None, "Bad API key"), (401, "no"), (503, None), (404, "x"), (429, None), (None, "Too many requests")]
    got = judge.classify_errors(spark.createDataFrame(rows_in, "status int, message string")).collect()
    assert [(r.kind, r.retryable) for r in got] == [("rate_limit", False), ("transient", True), ("auth", False), ("transient", True), ("permanent", False), ("rate_limit", True), ("rate_limit", True)]


def test_untrusted_judgements(spark, paper):
    _, _, criteria, _ = paper
    rubric_rows = criteria.filter("question_id = 'q1'")
    said = spark.createDataFrame([("q1", 1, "q1c1", 6.0), ("q1", 2, "q1c1", 9.0), ("q1", 3, "zz", 4.0)], "question_id string, ordinal int, criterion_id string, awarded double")
    scores = validate.score_criteria(rubric_rows.withColumnRenamed("ordinal", "place"), said, ["question_id"])
    assert rows(scores, "criterion_id", "raw", "mark", "clamp", "missing") == [("q1c1", 9.0, 2.0, "clamped_above_max", False), ("q1c2", None, 0.0, None, True)]
    unknown = validate.unknown_judgements(rubric_rows, said, ["question_id"])
    totals = validate.question_totals(scores, ["question_id"])
    audit = validate.audit_rows(scores, unknown, totals, ["question_id"])
    assert [r.kind for r in audit.orderBy("kind").collect()] == ["clamped_above_max", "rubric_criterion_missing", "total_recomputed", "unknown_criterion_ignored"]
    raw = spark.createDataFrame([('Sure: {"questionId":"q","summary":"s","selfConfidence":0.5,"criteria":[{"criterionId":"c","awardedMarks":1,"status":"correct","reasoning":"r"}],"findings":[{"kind":"praise","comment":"k","severity":"minor"}]} ok',), ('{"questionId":"q"',), ('{"questionId":"q","summary":"s","selfConfidence":3,"criteria":[{"criterionId":"c","awardedMarks":1,"status":"partial","reasoning":""},{"status":"great"}],"findings":[{"kind":"presentation","comment":"k","severity":"major","region":{"page":0,"x":0,"width":1,"height":1}}]}',)], "raw string")
    got = [r.errors for r in validate.parse_judgements(raw).collect()]
    assert got[0] == [] and got[1] == ["(root): not a JSON object"]
    # A self-confidence out of range is clamped later, not refused.
    assert got[2] == ["criteria.1.criterionId: Required", "criteria.1.awardedMarks: Required", "criteria.1.status: Expected one of correct, partial, missing, incorrect", "criteria.1.reasoning: Required", "findings.0.kind: Expected one of incorrect, missing, spelling, grammar, layout, praise", "findings.0.region.y: Required"]
    found = spark.createDataFrame([("q", i, None, None) for i in range(4)] + [("q", 9, "a quote", None)], "question_id string, ordinal int, quote string, region string")
    assert [r.fate for r in validate.place_findings(found, ["question_id"]).orderBy("ordinal").collect()] == ["kept", "kept", "noted", "noted", "kept"]


def test_refused_answers_are_asked_in_smaller_passages(spark):
    line = "The answer goes on in words of some length, line after line of it.\n"
    answers = spark.createDataFrame([("a", "q1", line * 4), ("a", "q2", line * 60), ("a", "q3", "x" * 9000), ("a", "q4", "garbled")], "doc_id string, question_id string, text string")

    def judge(batch):
        # refuses over 1,500 characters, and all of one endless word; breaks on one answer
        bad = batch["text"].str.len() > 1500
        endless = ~batch["text"].str.contains(" ")
        return batch.assign(raw=batch["text"].str.len().astype(str), outcome=["invalid" if t == "garbled" else "too_large" if b or e else "ok" for t, b, e in zip(batch["text"], bad, endless)])

    replies, ungraded, outages, _ = ask.ask(answers, judge, 1000)
    got = replies.collect()
    assert {r.question_id for r in got} == {"q1", "q2"} and sum(r.chars for r in got if r.question_id == "q2") >= len(line) * 60 - 60
    passes_of = sorted(r.pass_no for r in got if r.question_id == "q2")
    assert passes_of == list(range(1, len(passes_of) + 1)) and len(passes_of) >= 3 and [r.raw for r in got if r.question_id == "q1"] == [str(len(line) * 4)]
    reasons = {r.question_id: r.reason for r in ungraded.collect()}
    assert set(reasons) == {"q3", "q4"} and "passages of about" in reasons["q3"] and outages.isEmpty()


def test_rubric_arithmetic(spark, paper):
    _, _, criteria, _ = paper
    c = criteria.withColumn("rubric_id", F.lit("r"))
    q = spark.createDataFrame([("r", "q1", 3.0), ("r", "q2", 5.0)], "rubric_id string, question_id string, max_marks double")
    assert [r.question_id for r in validate.rubric_errors(c, q, spark.createDataFrame([("r", 8.0)], "rubric_id string, total_marks double")).collect()] == ["q2"]


def test_rubric_arithmetic_deals_many_questions_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(validate, "TASK_QUESTIONS", 10)
    q = spark.range(95).select((F.col("id") % 7).alias("rubric_id"), F.col("id").alias("question_id"), F.lit(3.0).alias("max_marks"))
    c = q.select("rubric_id", "question_id", F.explode(F.array(F.lit(1), F.lit(2), F.when(F.col("question_id") % 5 == 0, 2))).alias("criterion_id"), F.lit(1.5).alias("max_marks")).filter("criterion_id IS NOT NULL")
    found = validate.rubric_errors(c, q, q.select("rubric_id", F.lit(0.0).alias("total_marks")).distinct())
    got = {r.error: r["count"] for r in found.groupBy("error").count().collect()}
    assert got == {"questions do not add up to the paper": 7, "a criterion id occurs twice": 19, "criteria do not add up to the question": 19}
    assert found._jdf.queryExecution().optimizedPlan().toString().count(", 10\n") == 2  # both sides, in ten tasks


def test_anchors(spark):
    pages = spark.createDataFrame([(1, 0, "The ammeter is connected in series, the voltmeter in parallel.", "text-layer"), (1, 1, "The armneter is conected in series here", "text-layer"), (2, 0, "short", "text-layer")], "doc_id int, page int, text string, source string")
    quotes = spark.createDataFrame([(1, 1, "ammeter is connected in series", None), (2, 1, "ammeter is connected in series here", 1), (3, 1, "short", None), (4, 1, "nowhere to be found at all", None), (5, 2, "voltmeter in parallel", None)], "quote_id int, doc_id int, quote string, hint int")
    runs = spark.createDataFrame([(1, 0, 0, "The ammeter is connected", 0, 24, (0, 0.1, 0.1, 0.4, 0.02)), (1, 0, 1, " in series, the voltmeter in parallel.", 24, 62, (0, 0.5, 0.1, 0.4, 0.02)), (1, 1, 0, "The armneter is conected in series here", 0, 39, (1, 0.1, 0.1, 0.8, 0.02))], f"doc_id int, page int, run_no int, text string, start int, end int, rect {RECT}")
    got = {r.quote_id: r for r in anchor.anchor_quotes(quotes, pages, runs).collect()}
    assert got[1].status == "exact" and got[1].matched_text == "ammeter is connected in series" and len(got[1].rects) == 1 and got[1].rects[0].x > 0.1
    assert got[2].status == "fuzzy" and got[2].page == 1 and 0.74 <= got[2].similarity < 1
    assert [got[k].status for k in (3, 4, 5)] == ["unresolved"] * 3
    boxless = {r.quote_id: r for r in anchor.anchor_quotes(quotes, pages).collect()}
    assert boxless[1].status == "exact" and boxless[1].rects == []


def test_drawings(spark):
    def run(n, text, x, y, w, page=0):
        return (1, page, n, text, 0, len(text), (page, x, y, w, 0.02))

    made = [run(0, "A line of prose that fills the page", 0.1, 0.05, 0.7), run(1, "Circuit diagram", 0.1, 0.17, 0.2), run(2, "battery", 0.3, 0.2, 0.1), run(3, "bulb", 0.5, 0.28, 0.1), run(4, "switch", 0.4, 0.35, 0.1), run(5, "More prose that fills the page", 0.1, 0.5, 0.7), run(6, "lonely", 0.4, 0.7, 0.1)]
    runs = spark.createDataFrame(made, f"doc_id int, page int, run_no int, text string, start int, end int, rect {RECT}")
    drawn = diagram.drawings(runs)
    got = drawn.collect()
    assert len(got) == 1 and got[0].caption == "Circuit diagram" and abs(got[0].x - 0.085) < 1e-9 and abs(got[0].y - 0.155) < 1e-9 and abs(got[0].y + got[0].height - 0.385) < 1e-9
    asked = spark.createDataFrame([(1, 1, 0, 0.35, 0.25, 0.1, 0.1), (2, 1, 0, 0.1, 0.45, 0.1, 0.02), (3, 1, 0, 0.1, 0.9, 0.1, 0.02)], "id int, doc_id int, page int, x double, y double, width double, height double")
    assert rows(diagram.ground(asked, drawn, ["id"]), "id", "region_no") == [(1, 0), (2, 0)]
    assert diagram.by_caption(drawn, spark.createDataFrame([(1, "CIRCUIT diagram ")], "doc_id int, caption string")).count() == 1


def test_chunks(spark):
    text = "SECTION A\n31. What is a vector here?\nIt is long.\n1. not a heading\n32. Next question text\nSECTION B\nmore"
    docs = spark.createDataFrame([(1, text), (2, "31\nseven\n7\nx\n32\ny")], "doc_id int, text string")
    assert rows(chunk.blocks(docs.filter("doc_id = 1")), "block", "number", "section") == [(0, None, "SECTION A"), (1, 31, "SECTION A"), (2, 32, "SECTION A")]
    assert [r.number for r in chunk.blocks(docs.filter("doc_id = 2")).collect()] == [None]
    want = F.array(F.lit(31), F.lit(32))
    assert [r.number for r in chunk.blocks(docs.filter("doc_id = 2"), expected=want).orderBy("block").collect()] == [31, 32]
    assert rows(chunk.question_texts(docs.filter("doc_id = 2"), want), "number", "text") == [(31, "31\nseven\n7\nx"), (32, "32\ny")]
    assert spark.range(1).select(chunk.pack(F.array(*map(F.lit, (40, 50, 30, 90, 10))), 100).alias("p")).first().p == [0, 0, 1, 2, 2]
    big = "\n".join(f"{n}. Question {n} asks something.\n" + "word " * 30 for n in range(1, 9))
    made = chunk.chunks(spark.createDataFrame([(1, big)], "doc_id int, text string"), 120).orderBy("chunk").collect()
    assert all(r.tokens <= 120 for r in made) and [r.chunk for r in made] == list(range(len(made))) and all(r.total == len(made) for r in made)
    assert "".join(r.text for r in made).replace("\n", "").replace(" ", "") == big.replace("\n", "").replace(" ", "")
    assert chunk.split_refused("a\nb\nc", 100) == ["a\nb", "c"] and chunk.split_refused("a", 100) == ["a"]
    huge = chunk.chunks(spark.createDataFrame([(1, "1. Q one\n(a) " + "w " * 200 + "\n(b) " + "v " * 200 + "\n2. Q two is short")], "doc_id int, text string"), 300).orderBy("chunk").collect()
    assert [(r.numbers, r.part, r.parts) for r in huge] == [([1], 0, 2), ([1], 1, 2), ([2], 0, 1)]
    assert chunk.split_text("x" * 3000, 100) and max(map(len, chunk.split_text("y " * 3000, 100))) <= 301


SCHEME = """Q1 — Science
Model Answer — 3 marks
The circuit is • closed.
- It has a diagram.
Marking rubric
Criterion Marks
Closed path that
wraps 1
Ammeter at Rs 30 and 60
units 2
Total 9
Important grading guidance
Accept synonyms for closed.
Do not
deduct for spelling.
Q2 - Economics
Model Answer 4 marks
Demand falls."""
PAPER = "Question 1 — Physics\n5 Marks\nDescribe a circuit.\nExpected answer: short\nUse words.\nQuestion 2: Economics\n4 Marks\nState the law."


def test_question_papers_are_read_without_an_exchange(spark):
    many = "above\n2 marks\n" + "\n".join(f"Question {n % 3} - S{n}\n{n} marks\n  a  {n}\u00a0\n\n\u2003b\n{n + 1}.5 Mark" for n in range(1, 9))
    papers = spark.createDataFrame([(1, many), (2, "no heading"), (3, None), (4, "Question 7: x")], "doc_id int, text string").repartition(3)
    found = rubric.parse_question_paper(papers)
    assert rows(found, "doc_id", "number", "subject", "max_marks", "prompt") == [(1, 0, "S6", 7.5, "a 6 b"), (1, 1, "S7", 8.5, "a 7 b"), (1, 2, "S8", 9.5, "a 8 b"), (4, 7, "x", None, "")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the test's own


def test_rubric_reading(spark):
    docs = spark.createDataFrame([(1, SCHEME)], "doc_id int, text string")
    questions, criteria = rubric.parse_scheme(docs)
    q = {r.number: r for r in questions.collect()}
    assert q[1].declared == 9 and q[1].model_answer == "The circuit is • closed. It has a diagram." and q[1].guidance == ["Accept synonyms for closed.", "Do not deduct for spelling."]
    assert rows(criteria, "description", "max_marks") == [("Ammeter at Rs 30 and 60 units", 2.0), ("Closed path that wraps", 1.0)]
    prompts = rubric.parse_question_paper(spark.createDataFrame([(1, PAPER)], "doc_id int, text string"))
    assert rows(prompts, "number", "subject", "max_marks", "prompt") == [(1, "Physics", 5.0, "Describe a circuit. Use words."), (2, "Economics", 4.0, "State the law.")]
    assert rows(rubric.reading_route(docs.unionByName(spark.createDataFrame([(2, "no headings"), (3, "x " * 9000)], "doc_id int, text string")), questions, 1000), "doc_id", "route") == [(1, "structural"), (2, "single"), (3, "chunked")]
    draft, named = rubric.assemble(questions, criteria, prompts)
    got = {r.number: r for r in draft.collect()}
    assert got[1].max_marks == 3 and got[2].max_marks == 4 and got[1].requires_diagram and any("9.0 marks but its criteria add up to 3.0" in w for w in got[1].warnings)
    assert [r.criterion_id for r in named.orderBy("ordinal").collect()] == ["q1c1", "q1c2"]
    filled = rubric.fill_missing(draft, named)
    assert rows(filled.filter("question_id = 'q2'"), "criterion_id", "max_marks", "source") == [("q2c1", 4.0, "ai-inferred")]
    assert rows(rubric.finalise(draft, filled), "question_id", "max_marks", "repaired") == [("q1", 3.0, False), ("q2", 4.0, False)]


def fate(spark, points, stated, words="point"):
    df = spark.createDataFrame([(1, i, float(m), words, float(stated)) for i, m in enumerate(points)], "q int, i int, max_marks double, description string, stated double")
    return "".join(r.fate[0] for r in rubric.trim_fate(df, ["q"], "i").orderBy("i").collect())


def test_totals_reconciled(spark):
    steps = (0.5, 0.5, 0.5, 1, 0.5, 1, 1)
    assert fate(spark, (2.5, 0.5, 2, *steps), 5) == "bbb" + "k" * 7 and fate(spark, (*steps, 2.5, 0.5, 2), 5) == "k" * 7 + "bbb"
    assert fate(spark, (3, 2, 1, 2, 2, 1), 5) == "kkeeee" and fate(spark, (1, 3, 2), 5) == "ekk" and fate(spark, (4, 4), 5) == "kk"
    assert fate(spark, (2, 3, 1, 4), 5, "OR this") == "kkee"
    scaled = rubric.rescale(spark.createDataFrame([(1, i, m, 4.0) for i, m in enumerate((3.0, 3.0, 4.0))], "q int, i int, max_marks double, target double"), ["q"], "i")
    assert scaled.agg(F.sum("scaled")).first()[0] == 4.0
    many = rubric.rescale(spark.createDataFrame([(1, i, 1.0, 1.0) for i in range(4)], "q int, i int, max_marks double, target double"), ["q"], "i")
    assert many.agg(F.sum("scaled")).first()[0] == 1.0


def test_parts_merge_and_join(spark):
    parts = spark.createDataFrame([(1, 1, 1, 0, "", "Explain the", None, False), (1, 1, 2, 1, "Science", "explain THE law", 3.0, True), (1, 2, 3, 1, "Art", "Draw", 2.0, False)], "doc_id int, number int, ordinal int, chunk int, subject string, prompt string, max_marks double, requires_diagram boolean")
    paper = rubric.merge_paper_parts(parts)
    assert rows(paper, "number", "subject", "prompt", "max_marks", "requires_diagram") == [(1, "Science", "explain THE law", 3.0, True), (2, "Art", "Draw", 2.0, False)]
    scheme = rubric.merge_scheme_parts(spark.createDataFrame([(1, 1, 1, 0, "Answer", 4.0, False), (1, 3, 2, 0, "Other", None, False)], "doc_id int, number int, ordinal int, chunk int, model_answer string, max_marks double, requires_diagram boolean"))
    criteria = spark.createDataFrame([(1, 1, 1, "A  b", 1.0), (1, 1, 2, "a b", 1.0), (1, 1, 3, "a b", 2.0), (1, 1, 4, "", 1.0)], "doc_id int, number int, ordinal int, description string, max_marks double")
    assert rubric.dedupe_criteria(criteria, ["doc_id", "number"], ["ordinal"]).count() == 2
    joined = rubric.join_questions(paper, scheme, criteria)
    assert rows(joined, "number", "max_marks", "dropped") == [(1, 4.0, False), (2, 2.0, False), (3, None, True)]
    over = rubric.overlay_texts(joined, spark.createDataFrame([(1, 2, "Verbatim")], "doc_id int, number int, text string"))
    assert rows(over.filter("overlaid"), "number", "prompt") == [(2, "Verbatim")]


def test_pass_merge(spark):
    s = spark.createDataFrame([("q", "a", 1, 1.0, False), ("q", "a", 2, 0.0, True), ("q", "b", 1, 2.0, False), ("q", "b", 2, 2.0, True), ("q", "c", 1, 0.0, None), ("q", "c", 2, 1.5, None)], "question_id string, criterion_id string, pass_no int, mark double, verified boolean")
    best = passes.best_scores(s, ["question_id"])
    assert rows(best, "criterion_id", "mark", "pass_no") == [("a", 1.0, 1), ("b", 2.0, 2), ("c", 1.5, 2)]
    assert passes.merged_totals(best, ["question_id"]).first().awarded == 4.5
    d = spark.createDataFrame([("q", 1, 0.9, 2, 1, 0, 0, 3, 100, False, "One", ["n"]), ("q", 2, 0.7, 1, 1, 1, 1, 2, 50, True, "One", ["n", "m"])], "question_id string, pass_no int, self double, quoted int, verified int, clamps int, repairs int, missing int, chars int, approximate boolean, summary string, notes array<string>")
    m = passes.merge_drafts(d, ["question_id"]).first()
    assert (m.self, m.quoted, m.clamps, m.repairs, m.missing, m.chars, m.approximate, m.summaries, m.notes[:2], m.passes) == (0.7, 3, 1, 1, 2, 150, True, ["One"], ["n", "m"], 2)
    assert "2 passages" in m.notes[2]


def test_transcripts(spark):
    lines = spark.createDataFrame([(1, 0, "See [diagram 1] and [Diagram 2]"), (1, 1, "end")], "doc_id int, line int, text string")
    drawn = spark.createDataFrame([(1, 1, 1, "old", []), (1, 2, 1, " A circuit ", ["bulb", "cell"]), (1, 3, 7, "loose", [])], "doc_id int, ordinal int, marker int, description string, labels array<string>")
    got = [r.text for r in transcript.expand_markers(lines, drawn, ["doc_id"]).orderBy("line").collect()]
    assert got[0].startswith("See [Diagram 1: A circuit Labels: bulb | cell.] and [Diagram 2: a drawing is present") and got[2] == "[Diagram 7: loose]"
    assert rows(transcript.undescribed_markers(lines, drawn, ["doc_id"]), "marker") == [(2,)]
    same = "this very line is longer than twenty-five characters "
    bad = [(1, i, "[diagram 3]") for i in range(9)] + [(2, i, same + str(i % 4)) for i in range(8)] + [(3, 0, "x" * 8000), (4, 0, "fine")]
    looped = spark.createDataFrame(bad, "doc_id int, line int, text string")
    assert rows(transcript.degenerate(looped, ["doc_id"]), "doc_id", "degenerate") == [(1, True), (2, True), (3, True), (4, False)]
    clean = transcript.sanitise(looped, drawn, ["doc_id"])
    assert rows(clean.groupBy("doc_id").count(), "doc_id", "count") == [(1, 1), (2, 4), (3, 1), (4, 1)]
    b = lambda t: {"top": t, "bottom": t + 0.05, "left": 0.1, "right": 0.9}
    kind = "doc_id int, page int, line int, text string, box struct<top:double,bottom:double,left:double,right:double>"
    three = spark.createDataFrame([(1, 0, 0, "one line", b(0.1)), (1, 0, 1, "two", None) , (1, 0, 2, "three", b(0.3))], kind)
    pages, runs = transcript.page_text(three, ["doc_id", "page"])
    assert pages.first().text == "one line\ntwo\nthree" and rows(runs, "start", "end") == [(0, 8), (13, 18)]
    mixed = spark.createDataFrame([(1, 0, i, "t", b(t)) for i, t in enumerate((0.9, 0.5, 0.1, 0.7))], kind)
    assert not transcript.trust_positions(mixed, ["doc_id", "page"]).first().trusted
    scale = spark.createDataFrame([(100.0, 200.0, 50.0, 900.0), (0.1, 0.2, 0.05, 0.9), (0.5, 0.5, 0.1, 0.9), (float("nan"), 1.0, 0.0, 1.0)], "t double, b double, l double, r double")
    boxes = [r.x for r in scale.select(transcript.normalise_box(*(F.col(c) for c in "tblr")).alias("x")).collect()]
    assert boxes[0] == boxes[1] and boxes[2] is None and boxes[3] is None


def test_ink_and_alignment(spark):
    image = np.full((400, 400, 3), 255, dtype=np.uint8)
    for y in (60, 104, 250):
        image[y : y + 12, 40:360:4] = 0
    image[300] = 0  # a ruled line
    got = pixels.ink_rows(image.tobytes(), 400, 400)
    assert [round(r[0] * 400) for r in got] == [60, 104, 250]
    df = spark.createDataFrame([(bytearray(image.tobytes()), 400, 400)], "p binary, w int, h int").select(pixels.detect(F.col("p"), F.col("w"), F.col("h")).alias("r"))
    assert len(df.first().r) == 3
    lines = spark.createDataFrame([(1, 0, i, t, t + 0.02, 0.1, 0.5) for i, t in enumerate((0.14, 0.24, 0.26, 0.45, 0.61))], "doc_id long, page int, line int, top double, bottom double, left double, right double")
    ink = spark.createDataFrame([(1, 0, t, t + 0.03, 0.2, 0.8) for t in (0.15, 0.25, 0.60)], "doc_id long, page int, top double, bottom double, left double, right double")
    tops = [r.top for r in transcript.snap_lines(lines, ink).orderBy("line").collect()]
    assert tops[0] == 0.15 and tops[-1] == 0.60 and len([t for t in tops if t in (0.15, 0.25, 0.60)]) == len(set(tops) & {0.15, 0.25, 0.60})


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"hello")
    files = documents.scan_files(spark, str(tmp_path))
    assert sorted(r.is_pdf for r in files.collect()) == [False, True] and [r.error for r in documents.rejected(files).collect()] == ["not_a_pdf"]
    parsed = documents.parse_files(files, lambda content: [(0, 0, content.decode(), 72.0, 700.0, 50.0, 12.0, False, 595.0, 842.0)])
    assert parsed.count() == 2
    items = spark.createDataFrame([("d", 0, 0, "Hello", 10.0, 700.0, 50.0, 12.0, False, 595.0, 842.0), ("d", 0, 1, "world", 65.0, 700.0, 50.0, 12.0, True, 595.0, 842.0), ("d", 0, 2, "next", 10.0, 680.0, 50.0, 12.0, False, 595.0, 842.0), ("d", 0, 3, "s", 60.5, 680.0, 5.0, 12.0, False, 595.0, 842.0)], documents.ITEMS.replace("path", "doc_id"))
    pages, runs = documents.pages_and_runs(items, ["doc_id", "page"])
    assert pages.first().text == "Hello world\nnexts" and [(r.start, r.end) for r in runs.orderBy("run_no").collect()] == [(0, 5), (6, 11), (12, 16), (16, 17)]
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.write("results", spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    s.upsert("results", spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"))
    assert rows(s.read("results"), "id", "v") == [("a", 1), ("b", 3), ("c", 4)] and s.get("results", "b").v == 3
    s.append("results", spark.createDataFrame([("d", 5)], "id string, v int"))
    # Nothing was rewritten: the first rows, the keys that the upsert hides, its rows, the appended ones.
    assert s.read("results").count() == 4 and [p["kind"] for p in s._latest("results")[1]] == ["rows", "deletes", "rows", "rows"]
    (tmp_path / "store" / "results" / ".part-crashed").write_text("left by a crash before its commit")
    assert s.read("results").count() == 4
    with pytest.raises(store.NotFound):
        s.get("results", "z")
    notes = spark.createDataFrame([("x", "r", "old", False, "t0", (0, 0.1, 0.1, 0.1, 0.1), [(0, 0.2, 0.2, 0.1, 0.1)])], f"id string, result_id string, comment string, edited_by_human boolean, updated_at string, rect {RECT}, extra_rects array<{RECT}>")
    new = store.patch_annotation(notes, "x", {"comment": "new", "rect": F.struct(F.lit(0).alias("page"), *[F.lit(0.5).alias(c) for c in ("x", "y", "width", "height")])}, "t1").first()
    assert new.comment == "new" and new.edited_by_human and new.updated_at == "t1" and new.extra_rects == [] and new.rect.x == 0.5
    with pytest.raises(ValueError):
        store.patch_annotation(notes, "x", {"id": "y"}, "t1")
    assert store.delete_annotation(notes, "x").count() == 0
    twins = spark.createDataFrame([(1, "h", 1, True), (2, "h", 2, True), (3, "h", 3, False), (4, "g", 1, True)], "doc_id int, sha256 string, created_at int, reusable boolean")
    assert rows(documents.content_twins(twins), "doc_id", "twin_id") == [(1, 2), (2, 1), (3, 2)]


def test_rubric_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id":"r","title":"T","totalMarks":2,"questions":[{"id":"q1","number":1,"subject":"S","prompt":"p","maxMarks":2,"modelAnswer":"m","criteria":[{"id":"c1","description":"d","maxMarks":2}]}]}')
    rubrics, questions, criteria = documents.load_rubrics(spark, str(tmp_path))
    assert questions.first().criteria_source == "instructor" and criteria.count() == 1 and validate.rubric_errors(criteria, questions, rubrics).count() == 0


def test_report(spark, graded):
    out = graded
    ren = lambda df: df.withColumnRenamed("doc_id", "result_id")
    lines = report.summary_lines(ren(out["papers"]), ren(out["questions"]), ren(out["scores"].withColumn("ordinal", F.col("place"))), ren(out["annotations"].withColumn("ordinal", F.col("slot"))))
    text = {r.result_id: r.value for r in report.report_text(lines).collect()}
    assert text["a"].startswith("Score: 4.5 / 5.0") and "Question 1: 2.5 / 3.0" in text["a"] and "(blank)" in text["b"]
    sheets = spark.createDataFrame([("a", 0, 595.0, 842.0), ("b", 0, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    drawn = report.drawn_boxes(out["annotations"].withColumn("result_id", F.col("doc_id")).withColumn("ordinal", F.col("slot")).drop("slot"), sheets, report.palette(spark))
    assert drawn.filter("shape = 'underline'").count() == 2 and drawn.filter("rgb IS NULL").count() == 0


def test_limits_and_streams(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    asked = spark.createDataFrame([("p", at(0), 5000), ("p", at(59), 3000), ("p", at(60), 5000), ("p", at(61), 9000)], "provider string, ts timestamp, tokens int")
    got = [(r.used, r.verdict) for r in limits.admission(asked, ["provider"], 8000).orderBy("ts").collect()]
    assert got == [(5000, "fits"), (8000, "fits"), (8000, "fits"), (17000, "too_large")]
    folder = tmp_path / "in"
    folder.mkdir()
    row = '{"doc_id":"%s","page":0,"text":"%s","source":"text-layer","sha256":"%s","arrived":"2024-01-01T00:00:00"}\n'
    (folder / "1.json").write_text(row % ("a", "x", "h1") + row % ("b", "x", "h1") + row % ("c", "plenty of text on this page", "h2"))
    seen = []
    q = ingest.transcribe_stream(ingest.arriving_pages(spark, str(folder)), lambda df, _: seen.extend(r.sha256 for r in df.collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert seen == ["h1"]
    stream = limits.usage_stream(spark.readStream.schema("provider string, ts timestamp, tokens int").json(str(folder)))
    assert stream.isStreaming


def test_judges(spark):
    answers = spark.createDataFrame([("r", "q1", "text")], "result_id string, question_id string, text string")

    def good(batch):
        import pandas as pd

        return pd.DataFrame({"result_id": batch["result_id"], "question_id": batch["question_id"], "pass_no": 1, "raw": '{"questionId":"q1","summary":"","selfConfidence":1,"criteria":[],"findings":[]}'})

    fine = lambda j: len(validate.parse_judgements(judge.judge_with(answers, j)).first().errors)
    assert [fine(j) for j in (good, judge.in_prose(good), judge.truncated(good), judge.not_json(good))] == [0, 0, 1, 1]
    tries = spark.createDataFrame([(1, 1, "transient", 0, 0), (2, 3, "transient", 0, 0), (3, 1, "invalid", 0, 0), (4, 2, "invalid", 1, 0), (5, 1, "too_large", 0, 1), (6, 1, "ok", 0, 0)], "id int, attempt int, outcome string, repairs int, shrinks int")
    assert rows(judge.attempt_fate(tries, ["id"]), "id", "fate", "wait_ms") == [(1, "retry", 400), (2, "outage", None), (3, "repair", None), (4, "ungraded", None), (5, "split", None), (6, "done", None)]
    errors = judge.surface_errors(spark.createDataFrame([("a", "the circut has a currant in it")], "doc_id string, text string"), spark.createDataFrame([(1, "circut", "circuit"), (2, "absent", "x"), (3, "currant", "current")], "ordinal int, wrong string, right string"), ["doc_id"])
    assert rows(errors, "wrong", "kind") == [("circut", "spelling"), ("currant", "spelling")] and errors.first().comment == '"circut" should be "circuit".'
    asked = spark.createDataFrame([("q1", "c1", "Known words", "instructor"), ("q1", "c2", "others", "instructor"), ("q2", "c1", "Not these", "instructor"), ("q3", "c1", "Known words", "ai-inferred")], "question_id string, criterion_id string, description string, source string")
    rules = spark.createDataFrame([("c1", "KNOWN words.", "award", 1, False, "x", "y", None)], judge.RULES)
    assert rows(judge.unjudgeable(asked, rules, ["question_id"]), "question_id", "reason") == [("q2", "unsupported"), ("q3", "inferred")]


def test_summary_box_is_guidance(spark):
    points = spark.createDataFrame([("q", 1, "Law", 2.0, 5.0), ("q", 2, "Proof", 3.0, 5.0), ("q", 3, "step a", 1.0, 5.0), ("q", 4, "step b", 1.0, 5.0), ("q", 5, "step c", 3.0, 5.0)], "q string, i int, description string, max_marks double, stated double")
    made = rubric.summary_guidance(rubric.trim_fate(points, ["q"], "i"), ["q"], "i").first()
    assert made.guidance == "Mark distribution from the scheme's summary: Law — 2; Proof — 3." and "(2 + 3 = 5)" in made.note


def test_unstable_pages_are_rated_poor(spark):
    pages = spark.createDataFrame([("d", 0, "good", ["x"]), ("d", 1, None, None)], "doc_id string, page int, legibility string, unclear array<string>")
    got = transcript.rated_unstable(pages, pages.filter("page = 1"), ["doc_id", "page"]).orderBy("page").collect()
    assert got[0].legibility == "good" and got[0].unclear == ["x"] and got[1].legibility == "poor" and len(got[1].unclear) == 1


def page_with(bands, width=1000, height=1000, column=None, line=None):
    """A white image with runs of dots in bands (top, bottom, dots a row)."""
    image = np.full((height, width, 3), 255, dtype=np.uint8)
    for k, (a, b, dots) in enumerate(bands):
        for y in range(a, b):
            image[y, 200 + k % 4 : 200 + 4 * dots : 4] = 0  # no column is inked often enough for a margin rule
    if column is not None:
        image[:, column] = 0
    if line is not None:
        image[line, 50:950] = 0
    return image


def test_ink_rows_split_after_the_valley():
    """The valley itself belongs to neither line; the second half begins behind it."""
    rows = pixels.ink_rows(page_with([(100, 120, 40), (300, 330, 40), (330, 331, 4), (331, 360, 40), (500, 520, 40)]).tobytes(), 1000, 1000)
    assert [r[:2] for r in rows] == [(0.1, 0.12), (0.3, 0.33), (0.331, 0.36), (0.5, 0.52)]


def test_ink_rows_limits():
    # Parts under the least height go, and a band under twice of it is never cut.
    rows = pixels.ink_rows(page_with([(100, 110, 40), (300, 304, 40), (304, 305, 4), (305, 315, 40)]).tobytes(), 1000, 1000)
    assert [r[:2] for r in rows] == [(0.1, 0.11), (0.3, 0.315)]
    # Of two heights the upper one is usual.
    rows = pixels.ink_rows(page_with([(100, 120, 40), (300, 320, 40), (320, 321, 4), (321, 340, 40)]).tobytes(), 1000, 1000)
    assert [r[:2] for r in rows] == [(0.1, 0.12), (0.3, 0.34)]
    # A margin rule counts with the ink of ruled lines: here it is inked on just over 35 % of the page with them.
    image = page_with([(100, 120, 40)])
    image[200:549, 30] = 0
    for y in range(600, 610):
        image[y, 0:950] = 0
    assert [round(r[2], 3) for r in pixels.ink_rows(image.tobytes(), 1000, 1000)] == [0.2]
    # Four levels of cuts: many touching lines give up to 16 parts, more than three levels can.
    lines = [(100, 115, 40), (700, 715, 40), (900, 915, 40), (930, 945, 40), (960, 975, 40)]
    touching = [x for k in range(32) for x in ((140 + 17 * k, 156 + 17 * k, 40), (156 + 17 * k, 157 + 17 * k, 4))]
    rows = pixels.ink_rows(page_with([*lines[:1], *touching, *lines[1:]]).tobytes(), 1000, 1000)
    assert 8 < len([r for r in rows if 0.13 < r[0] < 0.69]) <= 16
