"""Text and mark functions against vectors and plain versions of themselves."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from markloom.functions import marks, text


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def each(spark, f, pairs):
    """f over rows of inputs, in one job."""
    n = len(pairs[0])
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], ["i", *(f"c{k}" for k in range(n))])
    return [r["x"] for r in rows.select("i", f(*(F.col(f"c{k}") for k in range(n))).alias("x")).orderBy("i").collect()]


def test_normalise_and_offsets(spark):
    cases = ["  Hello, World! ", "a - b", "", "x", "Été—ÇA 12", "\n\t", "a b  c."]
    got = each(spark, text.normalise, [(c,) for c in cases])
    assert got == ["hello world", "a b", "", "x", "étéça 12", "", "a b c"]
    for case, norm, at in zip(cases, got, each(spark, text.source_offsets, [(c,) for c in cases])):
        assert len(at) == len(norm)
        assert all(case[k].lower() == n or (n == " " and case[k].isspace()) for k, n in zip(at, norm))


def test_ocr_fold_and_similarity(spark):
    pairs = [("dernand", "demand"), ("rny", "my"), ("vo1tmeter", "voltmeter"), ("paraliel", "parallel"), ("quantlty", "quantity")]
    assert all(a == b for a, b in zip(each(spark, text.ocr_fold, [(a,) for a, _ in pairs]), each(spark, text.ocr_fold, [(b,) for _, b in pairs])))
    high = [("currenl", "current"), ("arnmeter", "ammeter"), ("ballery", "battery"), ("resistarice", "resistance"), ("equiIibriurn", "equilibrium")]
    low = [("voltmeter", "ammeter"), ("right", "left")]
    assert all(0.7 < x <= 1 for x in each(spark, text.token_similarity, [(a.lower(), b) for a, b in high]))
    assert all(x < 0.7 for x in each(spark, text.token_similarity, low))
    assert each(spark, text.token_similarity, [("a", "b")]) == each(spark, text.token_similarity, [("b", "a")])


SENTENCE = "The voltmeter is connected in parallel across the bulb. The ammeter is in series."


def test_find_phrase(spark):
    find = lambda t, p: text.find_phrase(text.normalise(t), text.normalise(p))
    cases = [
        (SENTENCE, "ammeter is in series"), (SENTENCE, "ammeter is connected in parallel across the bulb"), (SENTENCE, "the volttmeter is conected in paralel"),
        ("the supply curve will shift towards the left side", "the supply curve shifts to the right"), ("", "x"), ("x", ""), ("one two", "one two three"),
    ]
    got = each(spark, find, cases)
    assert got[0]["exact"] and got[0]["similarity"] == 1.0
    assert got[1] is None and got[3] is None and got[4] is None and got[5] is None and got[6] is None
    assert not got[2]["exact"] and got[2]["start"] == 0 and 0.8 < got[2]["similarity"] < 1


def test_surroundings(spark):
    t = "First one. The second one has the circut misspelling in it. Third\nline"
    a = t.index("circut")
    got = each(spark, lambda x, s, e: F.array(text.sentence_around(x, s, e), text.window_around(x, s, e, 2)), [(t, a, a + 6)])[0]
    assert got == ["The second one has the circut misspelling in it.", "the circut misspelling"]
    edge = each(spark, lambda x, s, e: text.window_around(x, s, e, 4), [("ab cd", 0, 2), ("x\nab cd\ny", 2, 4), ("a b c d e f g h i j k", 10, 11)])
    assert edge[0] == "ab cd" and edge[1] == "ab cd" and edge[2] == "c d e f g h i"


def test_small_text_functions(spark):
    assert each(spark, lambda n: text.sanitise_filename(n), [("/a/b/c d?.pdf",), ("",), ("x" * 200,), ("a/b/",), ("/",), (" \u00e9 a .pdf ",)]) == ["c d_.pdf", "upload.pdf", "x" * 120, "b", "upload.pdf", "_ a .pdf"]
    assert each(spark, lambda n: text.duration_ms(n), [("1h2m3s",), ("7.66s",), ("5ms",), ("soon",)]) == [3723000, 7660, 5, None]
    assert each(spark, lambda n: text.error_summary(n), [('{"error":{"message":"too  many\\n requests"}}',), ("plain text",), ('400 {"error":{"message":"bad"},"details":[1]}',), ('{"message":"x"}',), ("y" * 300,), (" ",)]) == ["too many requests", "plain text", "bad", '{"message":"x"}', "y" * 199 + "…", None]
    assert each(spark, lambda n: text.truncate(n, 5), [("abcdef",), ("abc",)]) == ["abcd…", "abc"]
    assert each(spark, lambda n: text.trim_heading_remainder(n), [(" — (a)\nbody",), ("It has 3 parts.\nbody",), (" mitochondria",)]) == ["body", "It has 3 parts.\nbody", " mitochondria"]
    assert each(spark, lambda a, b: text.join_text(a, b), [("One two", "two"), ("a", "b"), ("", "b"), ("A  b", "a b")]) == ["One two", "a\nb", "b", "A  b"]
    assert each(spark, lambda n: text.ascii_fold(n), [("‘a’ – “b”… ₹5 é",)]) == ["'a' - \"b\"... Rs 5 "]
    assert each(spark, lambda n: text.normalise_headings(n, F.array(F.lit(32), F.lit(33))), [("g32 (a) x",), ("O 33 (a)",), ("q.31 (a)",), ("omega32 = 5",)]) == ["Q32 (a) x", "Q33 (a)", "Q31 (a)", "omega32 = 5"]
    assert each(spark, lambda t, o: text.locate(t, o), [("Hello  big\nWorld", "big world"), ("abc", "c"), ("abc", "z"), ("a+b c", "a+b  c")]) == [7, 2, None, 0]
    assert one(spark, text.rejoin_sentences(F.array(F.lit("This is a long sentence. Another"), F.lit("one follows here! No."))) ) == ["This is a long sentence.", "Another one follows here!"]
    assert each(spark, lambda n: text.salvage_json(n), [('ok: {"a": 1} bye',), ('{"a": 1',), ("none",)]) == ['{"a": 1}', None, None]
    assert each(spark, lambda n: text.derive_subject(n), [("a Physics paper",), ("other",), ("POLITICAL science 2",), ("Computer Science",)]) == ["Physics", "General", "POLITICAL science", "Computer Science"]


def test_token_estimates(spark):
    got = each(spark, lambda n: text.estimate_tokens(n), [("",), ("x" * 21000,), ("a b, c!",)])
    assert got == [0, math.ceil(21000 / 3.2), max(math.ceil(7 / 3.2), math.ceil(3 * 1.3 + 2 * 0.5))]
    plan = one(spark, text.plan_request(F.lit(5000), F.lit(3000), F.lit(0), 8000))
    assert plan["ceiling"] == 7360 and not plan["fits"] and plan["headroom"] == -640


def test_rounding_is_exact(spark):
    values = [0.61725, 0.00005, 0.00015, 2.5, 1.00005, 0.12345, 0.99995, 0.0, 7.77775, 123.45675, -0.61725] + [i / 100000 for i in range(5, 99999, 371)]
    got = each(spark, lambda v: F.array(marks.round4(v), marks.round4_exact(v)), [(v,) for v in values])
    want = [float(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]
    assert [g[0] for g in got] == want == [g[1] for g in got]


def test_clamp_and_snap(spark):
    cases = [(7.0, 5.0), (-2.0, 5.0), (2.3, 5.0), (2.25, 5.0), (float("nan"), 5.0), (float("inf"), 5.0), (0.75, 0.75), (None, 1.0)]
    got = each(spark, lambda r, m: F.struct(marks.clamp_mark(r, m).alias("v"), marks.clamp_kind(r, m).alias("k")), cases)
    assert [g["v"] for g in got] == [5.0, 0.0, 2.5, 2.5, 0.0, 0.0, 0.75, 0.0]
    assert [g["k"] for g in got] == ["clamped_above_max", "clamped_below_zero", None, None, "clamped_below_zero", "clamped_below_zero", None, "clamped_below_zero"]
    assert each(spark, lambda v: marks.snap(v), [(-2.75,), (0.24,), (0.25,)]) == [-2.5, 0.0, 0.5]


def draft(**over):
    base = {"self": 0.68, "quoted": 3, "verified": 3, "clamps": 0, "repairs": 0, "missing": 0, "chars": 900, "approximate": False, "transcribed": False, "unclear": 0, "unresolved": 0, "regions": 0}
    return {k: F.lit(v) for k, v in (base | over).items()}


def test_confidence_vectors(spark):
    got = [one(spark, marks.question_confidence(draft(**d)))["value"] for d in ({"unresolved": 1, "regions": 1}, {"self": 0.95, "quoted": 5, "verified": 0}, {"self": 0.99, "quoted": 0, "verified": 0, "clamps": 5})]
    assert got == [0.61, 0.57, 0.5415]
    papers = spark.createDataFrame([(0.61, 5.0), (0.80, 5.0), (0.90, 5.0)], "c double, m double")
    assert papers.agg(marks.paper_confidence(F.col("c"), F.col("m")).alias("x")).first()["x"] == 0.73
    assert papers.limit(0).agg(marks.paper_confidence(F.col("c"), F.col("m")).alias("x")).first()["x"] == 0.0


@pytest.mark.parametrize("name", ["plain", "anchor"])
def test_thresholds_are_three(name):
    assert (text.PHRASE_THRESHOLD, text.RULE_THRESHOLD, text.ANCHOR_THRESHOLD, text.TOKEN_FLOOR) == (0.8, 0.82, 0.74, 0.68)
    assert re.match(r"\\t", text.SPACES)


def test_words_are_wrapped_by_their_widths(spark):
    from pyspark.sql import functions as F

    from markloom.sources import report

    texts = ["", None, "  ", "one", "aa bb cc dd", "wide" * 40 + " i i i", "curly “quotes” — and so on", "iiii iiii MMMM MMMM"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(report.wrapped(F.col("t"), 10.0, 30.0)).collect()]

    def plain(text):
        lines, line = [], ""
        for word in (text or "").replace("“", '"').replace("”", '"').replace("—", "-").split():
            both = f"{line} {word}" if line else word
            if not line or sum(report.WIDTHS[ord(c) - 32] for c in both) <= 3000:
                line = both
            else:
                lines, line = [*lines, line], word
        return lines + [line] * (line != "")

    assert got == [plain(t) for t in texts] and len(report.WIDTHS) == 95 and got[5][0] == "wide" * 40


def test_seams_are_read_once(spark):
    """A reading that is costly to make is made once, however often joining looks at it."""
    from pyspark.sql import functions as F

    made = F.regexp_replace("t", "costly", "")
    df = spark.createDataFrame([("One costly two", "TWO")], "t string, b string").select(text.join_text(made, F.col("b")).alias("j"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("costly") == 1 and df.first().j == "One  two"


def test_long_texts_are_wrapped_without_a_fold_over_their_words(spark):
    from pyspark.sql import functions as F

    from markloom.sources import report

    words = [("i" * (k % 7 + 1), "M" * (k % 5 + 1))[k % 2] for k in range(60_000)]
    df = spark.createDataFrame([(" \n".join(words),)], "t string").select(report.wrapped(F.col("t"), 10.0, 30.0).alias("l"))
    width = lambda line: sum(report.WIDTHS[ord(c) - 32] for c in line)
    lines = df.first().l
    assert " ".join(lines).split(" ") == words
    assert all(width(a) <= 3000 or " " not in a for a in lines) and all(width(f"{a} {b.split(' ')[0]}") > 3000 for a, b in zip(lines, lines[1:]))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
