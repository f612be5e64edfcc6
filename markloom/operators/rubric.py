"""Rubrics read from question papers and marking schemes, merged, joined and reconciled.

Lines are rows; which question and section a line belongs to is a running count or the last marker seen, per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import round4
from ..functions.text import SPACES, join_text, let, rejoin_sentences, single_spaces, strip, wants_diagram

#: Lines of question papers and marking schemes. Fixed values.
QUESTION_HEADING = r"(?i)^\s*Question\s+(\d+)\s*[—–\-:]\s*(.+?)\s*$"
MARKS_LINE = r"(?i)^\s*(\d+(?:\.\d+)?)\s*Marks?\s*$"
EXPECTED_ANSWER = r"(?i)^\s*Expected answer\s*:"
SCHEME_HEADING = r"(?i)^\s*Q(?:uestion)?\s*(\d+)\s*[—–\-:]\s*(.+?)\s*$"
MODEL_ANSWER = r"(?i)^\s*Model Answer\s*[—–\-:]?\s*(\d+(?:\.\d+)?)?\s*marks?\s*$"
RUBRIC_HEADING = r"(?i)^\s*Marking\s+rubric\s*$"
TABLE_HEAD = r"(?i)^\s*Criterion\s+Marks\s*$"
TOTAL_LINE = r"(?i)^\s*Total\s+(\d+(?:\.\d+)?)\s*$"
GUIDANCE_HEADING = r"(?i)^\s*Important\s+grading\s+guidance\s*$"
TRAILING_MARK = r"^(.*?)\s*(\d+(?:\.\d+)?)\s*$"
#: The largest number at a criterion's end that is a mark. Fixed value.
MOST_MARK = 20


def _lines(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "t"))


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found.try_cast("double"))


def _flat(text: Column) -> Column:
    return strip(single_spaces(text))


def _gathered(condition: Column, value: Column) -> Column:
    """An aggregate: the values of the lines that meet the condition, in order of line."""
    return F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("line", value.alias("v"))))), lambda x: x["v"])


def parse_question_paper(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, number, subject, max_marks, prompt): of a number that occurs twice the last stands.

    A paper is one row, so its lines need no exchange; each line goes to one question.
    """
    heads = F.filter(F.transform("_l", lambda t, i: F.when(t.rlike(QUESTION_HEADING), F.struct(_number(t, QUESTION_HEADING).cast("int").alias("n"), i.alias("i"), strip(F.regexp_extract(t, QUESTION_HEADING, 2)).alias("s")))), lambda h: h.isNotNull())
    spans = lambda hs: F.transform(hs, lambda h, k: F.struct(h["n"].alias("n"), h["i"].alias("i"), F.coalesce(F.get(hs, k + 1)["i"], F.size("_l")).alias("upto"), h["s"].alias("s")))
    last = lambda hs: F.filter(hs, lambda h, k: F.coalesce(F.get(hs, k + 1)["n"] != h["n"], F.lit(True)))
    parts = F.transform(let(F.sort_array(let(heads, spans)), last), lambda h: F.struct(h["n"].alias("n"), h["s"].alias("s"), F.slice("_l", h["i"] + 2, h["upto"] - h["i"] - 1).alias("l")))
    found = docs.select("doc_id", F.split(text, "\n").alias("_l")).select("doc_id", F.explode(parts).alias("q")).select("doc_id", "q.n", "q.s", "q.l")
    body = F.filter("l", lambda t: ~t.rlike(MARKS_LINE) & ~t.rlike(EXPECTED_ANSWER))
    said = F.filter(F.transform(body, strip), lambda t: t != "")
    marks = F.try_element_at(F.filter(F.transform("l", lambda t: _number(t, MARKS_LINE)), lambda m: m.isNotNull()), F.lit(-1))
    return found.select("doc_id", F.col("n").alias("number"), F.col("s").alias("subject"), marks.alias("max_marks"), _flat(F.array_join(said, " ")).alias("prompt"))


def scheme_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines of marking schemes with their question (`q`) and section (answer, rubric, guidance)."""
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = _lines(docs, text).withColumn("t", strip(F.col("t"))).withColumn("_head", F.col("t").rlike(SCHEME_HEADING))
    rows = rows.withColumn("q", F.sum(F.col("_head").cast("int")).over(order)).filter("q > 0")
    marker = F.when(F.col("_head"), "answer").when(F.col("t").rlike(RUBRIC_HEADING), "rubric").when(F.col("t").rlike(GUIDANCE_HEADING), "guidance")
    return rows.withColumn("_marker", marker).withColumn("section", F.last("_marker", ignorenulls=True).over(order))


def parse_scheme(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(questions, criteria): (doc_id, q, number, subject, declared, model_answer, guidance) and (doc_id, q, ordinal, description, max_marks)."""
    rows = scheme_lines(docs, text)
    body = F.col("_marker").isNull()
    answer = body & (F.col("section") == "answer")
    total = F.when(body & (F.col("section") == "rubric"), _number(F.col("t"), TOTAL_LINE))
    stated = F.when(answer, _number(F.col("t"), MODEL_ANSWER))
    declared = F.coalesce(total, stated)
    said = answer & ~F.col("t").rlike(MODEL_ANSWER) & (F.col("t") != "")
    head = F.max(F.when(F.col("_head"), F.struct(_number(F.col("t"), SCHEME_HEADING).cast("int").alias("n"), strip(F.regexp_extract("t", SCHEME_HEADING, 2)).alias("s"))))
    questions = rows.groupBy("doc_id", "q").agg(
        head.alias("h"), F.max_by(declared, F.when(declared.isNotNull(), F.col("line"))).alias("declared"),
        _flat(F.array_join(_gathered(said, F.regexp_replace("t", r"^[•·▪\-*]\s*", "")), " ")).alias("model_answer"),
        rejoin_sentences(_gathered(body & (F.col("section") == "guidance") & (F.col("t") != ""), F.col("t"))).alias("guidance"),
    ).select("doc_id", "q", F.col("h.n").alias("number"), F.col("h.s").alias("subject"), "declared", "model_answer", "guidance")
    order = Window.partitionBy("doc_id", "q").orderBy("line")
    table = rows.filter(body & (F.col("section") == "rubric") & (F.col("t") != "") & ~F.col("t").rlike(TABLE_HEAD))
    mark = F.when(~F.col("t").rlike(TOTAL_LINE), _number(F.col("t"), TRAILING_MARK, 2))
    table = table.withColumn("_mark", F.when((mark > 0) & (mark <= MOST_MARK), mark)).withColumn("_total", F.col("t").rlike(TOTAL_LINE))
    # A criterion's lines run to the line that bears its mark; a total drops what was pending.
    ends = F.when(F.col("_mark").isNotNull() | F.col("_total"), 1).otherwise(0)
    group = F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("_mark").isNotNull(), F.regexp_extract("t", TRAILING_MARK, 1)).otherwise(F.col("t"))
    made = table.withColumn("_g", group).groupBy("doc_id", "q", "_g").agg(_flat(F.array_join(_gathered(~F.col("_total"), strip(part)), " ")).alias("description"), F.max("_mark").alias("max_marks"), F.max("line").alias("_at"))
    kept = made.filter("max_marks IS NOT NULL AND description != ''")
    place = F.row_number().over(Window.partitionBy("doc_id", "q").orderBy("_at"))
    return questions, kept.select("doc_id", "q", place.alias("ordinal"), "description", "max_marks")


def assemble(questions: DataFrame, criteria: DataFrame, prompts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(draft questions with warnings, criteria with ids): the criteria's sum is the question's worth, whatever is stated."""
    sums = criteria.groupBy("doc_id", "q").agg(F.sum("max_marks").alias("_sum"))
    q = questions.join(sums, ["doc_id", "q"], "left")
    if prompts is None:
        q = q.withColumns({"_ps": F.lit(None).cast("string"), "_pm": F.lit(None).cast("double"), "prompt": F.lit("")})
    else:
        q = q.join(prompts.select("doc_id", "number", F.col("subject").alias("_ps"), F.col("max_marks").alias("_pm"), "prompt"), ["doc_id", "number"], "left")
    declared = F.coalesce("declared", "_pm", "_sum", F.lit(0.0))
    has = F.col("_sum").isNotNull()
    said = lambda *parts: F.concat(F.lit("Question "), F.col("number"), F.lit(": "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    prompt = F.coalesce("prompt", F.lit(""))
    warnings = F.array_compact(F.array(
        F.when(~has & (declared > 0), said("the scheme defines no marking criteria. They will be inferred, to total ", declared, " marks.")),
        F.when(~has & (declared <= 0), said("the scheme defines no marking criteria and states no total.")),
        F.when(has & (F.abs(declared - F.col("_sum")) > 1e-9), said("the scheme states ", declared, " marks but its criteria add up to ", F.col("_sum"), ". Using the latter.")),
        F.when(prompt == "", said("no question text was found.")),
        F.when(has & (F.size("guidance") == 0), said("the scheme gives no grading guidance.")),
    ))
    subject = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).when(F.coalesce("_ps", F.lit("")) != "", F.col("_ps")).otherwise("General")
    draft = q.select(
        "doc_id", F.format_string("q%d", "number").alias("question_id"), "number", subject.alias("subject"), F.coalesce("_sum", declared).alias("max_marks"), prompt.alias("prompt"), "model_answer", "guidance",
        wants_diagram(F.concat_ws(" ", prompt, "model_answer")).alias("requires_diagram"), warnings.alias("warnings"),
    )
    named = criteria.join(questions.select("doc_id", "q", "number"), ["doc_id", "q"]).select("doc_id", F.format_string("q%d", "number").alias("question_id"), F.format_string("q%dc%d", "number", "ordinal").alias("criterion_id"), "ordinal", "description", "max_marks")
    return draft, named


# ---- parts read from chunks --------------------------------------------------------------------------------------

_FOLD_SPACES = f"[{SPACES}]+"


def _key(text: Column) -> Column:
    return F.lower(_flat(text))


def _joined(column: str) -> Column:
    """An aggregate: prose of all parts in order, overlapping seams joined."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", column))), lambda x: x[column])
    return F.aggregate(parts, F.lit(""), lambda a, b: join_text(a, b))


def _first(column: str, fine: Column | None = None) -> Column:
    """An aggregate: the first value, in order, that is there."""
    there = F.col(column).isNotNull() if fine is None else fine
    return F.min_by(column, F.when(there, F.col("ordinal")))


def merge_paper_parts(parts: DataFrame) -> DataFrame:
    """Question-paper parts (doc_id, number, ordinal, chunk, subject, prompt, max_marks, requires_diagram) by number."""
    return parts.groupBy("doc_id", "number").agg(
        F.coalesce(_first("subject", strip(F.col("subject")) != ""), F.lit("")).alias("subject"), _joined("prompt").alias("prompt"), _first("max_marks").alias("max_marks"),
        F.bool_or("requires_diagram").alias("requires_diagram"), F.sort_array(F.collect_set("chunk")).alias("chunks"),
    )


def merge_scheme_parts(parts: DataFrame) -> DataFrame:
    """Scheme parts (doc_id, number, ordinal, chunk, model_answer, max_marks, requires_diagram) by number."""
    return parts.groupBy("doc_id", "number").agg(_joined("model_answer").alias("model_answer"), _first("max_marks").alias("max_marks"), F.bool_or("requires_diagram").alias("requires_diagram"), F.sort_array(F.collect_set("chunk")).alias("chunks"))


def dedupe_lines(lines: DataFrame, keys: list[str], text: str, order: list[str], also: list[str] | None = None) -> DataFrame:
    """The first of lines that are equal in words (and the further columns), empty ones dropped."""
    keyed = lines.withColumn("_k", _key(F.col(text))).filter("_k != ''")
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_k", *(also or [])).orderBy(*order))).filter("_n = 1").drop("_k", "_n")


def dedupe_criteria(criteria: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of criteria equal in words and marks; those without words or marks go."""
    return dedupe_lines(criteria.filter("max_marks > 0"), keys, "description", order, ["max_marks"])


def join_questions(paper: DataFrame, scheme: DataFrame, criteria: DataFrame) -> DataFrame:
    """Paper and scheme by number: (doc_id, number, subject, prompt, model_answer, max_marks, requires_diagram, warnings, dropped).

    The stated total is the scheme's, else the paper's, else the criteria's sum; a question without any is dropped. A
    question that only one side has is a warning, if the other side has any.
    """
    sums = criteria.groupBy("doc_id", "number").agg(F.sum("max_marks").alias("_sum"))
    p = paper.select("doc_id", "number", "subject", "prompt", F.col("max_marks").alias("_pm"), F.col("requires_diagram").alias("_pd"), F.lit(True).alias("_p"))
    s = scheme.select("doc_id", "number", "model_answer", F.col("max_marks").alias("_sm"), F.col("requires_diagram").alias("_sd"), F.lit(True).alias("_s"))
    both = p.join(s, ["doc_id", "number"], "full_outer").join(sums, ["doc_id", "number"], "left")
    doc = Window.partitionBy("doc_id")
    both = both.withColumn("_np", F.count("_p").over(doc)).withColumn("_ns", F.count("_s").over(doc))
    most = F.coalesce("_sm", "_pm", F.when(F.col("_sum") > 0, F.col("_sum")))
    said = lambda text: F.concat(F.lit("Question "), F.col("number"), F.lit(text))
    warnings = F.array_compact(F.array(
        F.when(F.col("_p").isNotNull() & F.col("_s").isNull() & (F.col("_ns") > 0), said(" is on the question paper but the marking scheme has nothing for it.")),
        F.when(F.col("_s").isNotNull() & F.col("_p").isNull() & (F.col("_np") > 0), said(" is in the marking scheme but was not found on the question paper.")),
        F.when(F.coalesce(most, F.lit(0.0)) <= 0, said(": no marks were stated anywhere, so it was left out.")),
    ))
    return both.select(
        "doc_id", "number", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("model_answer", F.lit("")).alias("model_answer"), most.alias("max_marks"),
        (F.coalesce("_pd", F.lit(False)) | F.coalesce("_sd", F.lit(False))).alias("requires_diagram"), warnings.alias("warnings"), (F.coalesce(most, F.lit(0.0)) <= 0).alias("dropped"),
    )


def overlay_texts(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """Question texts sliced from the source replace a model's copies of them."""
    said = texts.select("doc_id", "number", F.col("text").alias("_text"))
    joined = questions.join(said, ["doc_id", "number"], "left")
    return joined.withColumn("overlaid", F.col("_text").isNotNull()).withColumn("prompt", F.coalesce("_text", "prompt")).drop("_text")


def trim_fate(criteria: DataFrame, keys: list[str], order: str, stated: str = "stated") -> DataFrame:
    """Adds `fate` to criteria of questions with a stated total: kept, box (a summary of the same marks) or extra.

    Sum twice the total, and a run from the start making the total: of the two runs the one with fewer points is the
    summary box (of equal ones the first), unless either speaks of an alternative. Else, over the total: the first run
    from the start that makes it is kept, else from the end. Else all stay.
    """
    w = Window.partitionBy(*keys)
    close = lambda a, b: F.abs(a - b) < 1e-6
    forward = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = w.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = criteria.withColumns({"_f": F.sum("max_marks").over(forward), "_b": F.sum("max_marks").over(backward), "_t": F.sum("max_marks").over(w), "_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(order)), "_j": F.row_number().over(w.orderBy(F.col(order).desc()))})
    total = F.col(stated)
    rows = rows.withColumns({
        "_head": F.min(F.when(close(F.col("_f"), total) & (F.col("_i") < F.col("_n")), F.col("_i"))).over(w),
        "_tail": F.min(F.when(close(F.col("_b"), total) & (F.col("_j") < F.col("_n")), F.col("_j"))).over(w),
        "_or": F.bool_or(F.col("description").rlike(r"\bOR\b|\balternative\b")).over(w),
    })
    twice = close(F.col("_t"), total * 2) & F.col("_head").isNotNull() & ~F.col("_or")
    box_last = F.col("_n") - F.col("_head") < F.col("_head")
    over = F.col("_t") > total + 1e-6
    fate = (
        F.when(total.isNull() | (F.col("_n") < 2), "kept")
        .when(twice, F.when((F.col("_i") > F.col("_head")) == box_last, "box").otherwise("kept"))
        .when(over & F.col("_head").isNotNull(), F.when(F.col("_i") <= F.col("_head"), "kept").otherwise("extra"))
        .when(over & F.col("_tail").isNotNull(), F.when(F.col("_j") <= F.col("_tail"), "kept").otherwise("extra"))
        .otherwise("kept")
    )
    return rows.withColumn("fate", fate).drop("_f", "_b", "_t", "_n", "_i", "_j", "_head", "_tail", "_or")


def plain_number(v: Column) -> Column:
    """Marks as text, whole ones without a decimal point."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def summary_guidance(fated: DataFrame, keys: list[str], order: str, stated: str = "stated") -> DataFrame:
    """(keys, guidance, note) of questions of which `trim_fate` found a summary box: the box as guidance, and what was done."""
    box = fated.filter("fate = 'box'").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "description", "max_marks"))).alias("_b"), F.max(stated).alias("_t"))
    listed = F.array_join(F.transform("_b", lambda x: F.concat(x["description"], F.lit(" — "), plain_number(x["max_marks"]))), "; ")
    added = F.array_join(F.transform("_b", lambda x: plain_number(x["max_marks"])), " + ")
    note = F.concat(F.lit("The scheme's summary of marks ("), added, F.lit(" = "), plain_number(F.col("_t")), F.lit(") stood beside its steps and would have doubled the question; the steps are the criteria, the summary is guidance."))
    return box.select(*keys, F.concat(F.lit("Mark distribution from the scheme's summary: "), listed, F.lit(".")).alias("guidance"), note.alias("note"))


def rescale(criteria: DataFrame, keys: list[str], order: str, target: str = "target") -> DataFrame:
    """Adds `scaled`: marks in halves, at least 0.5, that add up to the target; the last row takes up the rounding.

    Where there are more rows than halves in the target, halves can't add up to it; there all rows share it evenly.
    """
    w = Window.partitionBy(*keys)
    rows = criteria.withColumn("_sum", F.sum("max_marks").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    near = F.greatest(F.lit(0.5), F.floor(F.col("max_marks") / F.col("_sum") * F.col(target) * 2 + 0.5) / 2)
    rows = rows.withColumn("_s", near).withColumn("_r", F.row_number().over(w.orderBy(F.col(order).desc()))).withColumn("_total", F.sum("_s").over(w))
    last = round4(F.greatest(F.lit(0.5), F.col("_s") + F.col(target) - F.col("_total")))
    scaled = F.when((F.abs(F.col("_sum") - F.col(target)) < 1e-9) | (F.col("_sum") <= 0), F.col("max_marks")).when(F.col("_n") > 2 * F.col(target), F.col(target) / F.col("_n")).when(F.col("_r") == 1, last).otherwise(F.col("_s"))
    return rows.withColumn("scaled", scaled).drop("_sum", "_n", "_s", "_r", "_total")


#: The one criterion of a question that has none. Fixed value.
PLACEHOLDER = "Answer addresses the question and covers the substance of the model answer."


def fill_missing(questions: DataFrame, criteria: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """criteria, with inferred ones (doc_id, question_id, ordinal, description, max_marks) or one placeholder where a question has none."""
    have = criteria.withColumn("source", F.lit("instructor"))
    lacking = questions.join(criteria.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti")
    if inferred is not None:
        fit = rescale(lacking.select("doc_id", "question_id", F.col("max_marks").alias("target")).join(inferred.filter("description != '' AND max_marks > 0"), ["doc_id", "question_id"]), ["doc_id", "question_id"], "ordinal")
        made = fit.select("doc_id", "question_id", F.format_string("%sc%d", "question_id", F.row_number().over(Window.partitionBy("doc_id", "question_id").orderBy("ordinal"))).alias("criterion_id"), "ordinal", "description", F.col("scaled").alias("max_marks"), F.lit("ai-inferred").alias("source"))
        have = have.unionByName(made)
        lacking = lacking.join(made.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti")
    holder = lacking.select("doc_id", "question_id", F.concat("question_id", F.lit("c1")).alias("criterion_id"), F.lit(1).alias("ordinal"), F.lit(PLACEHOLDER).alias("description"), "max_marks", F.lit("ai-inferred").alias("source"))
    return have.unionByName(holder)


def finalise(questions: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, question_id, max_marks, repaired): a question is worth the sum of its criteria."""
    sums = criteria.groupBy("doc_id", "question_id").agg(F.sum("max_marks").alias("_sum"))
    return questions.join(sums, ["doc_id", "question_id"]).select("doc_id", "question_id", F.col("_sum").alias("max_marks"), (F.abs(F.col("_sum") - F.col("max_marks")) > 1e-9).alias("repaired"))


def reading_route(docs: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """(doc_id, route) of marking schemes: structural where the parser found questions, else chunked where a single request
    wouldn't fit the budget, else single."""
    from ..functions.text import estimate_tokens

    parsed = questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = docs.join(parsed, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("_n") > 0, "structural").when(estimate_tokens(F.col("text")) > budget, "chunked").otherwise("single").alias("route"))
