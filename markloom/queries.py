"""The engine's operators applied to the driver's tables, each with the SQL that must give the same rows.

The tables know nothing of examinations, so each query takes an analogue: orders are papers, their lines criteria,
quantities marks, documents answers, benchmark items quotes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import marks, text
from .operators import anchor, chunk, judge, passes, review, rubric, search, segment, transcript, validate
from .plans import steps
from .sources import documents, report, store
from .streaming import ledger, limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space as a character class of DuckDB's regular expressions.
W = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(column: str) -> str:
    spaced = rf"regexp_replace({column}, '[{W}]+', ' ', 'g')"
    return rf"lower(trim(regexp_replace(regexp_replace({spaced}, '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g')))"


def round4_sql(c: str) -> str:
    """Four places by the exact value of the double, as `marks.round4`."""
    low = f"floor(abs({c}) * 10000.0::DOUBLE)"
    odd = f"({low} * 2 + 1)"
    mid = f"({odd} / 20000.0::DOUBLE)"
    wide = f"({mid} * 134217729.0::DOUBLE)"
    high = f"({wide} - ({wide} - {mid}))"
    error = f"(({high} * 20000.0::DOUBLE - {odd}) + ({mid} - {high}) * 20000.0::DOUBLE)"
    return f"(sign({c}) * ({low} + CASE WHEN abs({c}) > {mid} OR (abs({c}) = {mid} AND {error} >= 0) THEN 1.0 ELSE 0.0 END) / 10000.0::DOUBLE)"


#: A total order of lineitem's rows; equal rows are interchangeable.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_SQL = ", ".join(LINE)
REST = [c for c in LINE if c not in ("l_orderkey", "l_linenumber")]


# ---- text ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def normalise_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@query(f"""WITH n AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS INTEGER) AS n_tokens,
  md5(translate(replace(norm, 'rn', 'm'), 'l1|05', 'iiios')) AS folded FROM n""")
def ocr_folded(spark, sf_dir):
    norm = text.normalise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(norm)).alias("n_tokens"), F.md5(text.ocr_fold(norm)).alias("folded"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS INTEGER) AS chars, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) < 25 AS blank FROM documents")
def blank_gate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.meaningful_chars(F.col("text")).alias("chars"), text.is_blank(F.col("text")).alias("blank"))


@query(rf"""WITH t AS (
  SELECT doc_id, greatest(ceil(length(text) / 3.2::DOUBLE), ceil(len(regexp_extract_all(text, '[^{W}]+')) * 1.3::DOUBLE + length(regexp_replace(text, '[\p{{L}}\p{{N}}{W}]', '', 'g')) * 0.5::DOUBLE))::BIGINT AS tokens FROM documents
), r AS (SELECT doc_id, tokens, (tokens + ceil(tokens * 1.4::DOUBLE + 900))::BIGINT AS requested FROM t)
SELECT doc_id, tokens, requested, requested <= 7360 AS fits, 7360 - requested AS headroom FROM r""")
def token_plan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))
    planned = docs.withColumn("p", text.plan_request(F.col("tokens"), text.transcription_reserve(F.col("tokens")), F.lit(0), 8000))
    return planned.select("doc_id", "tokens", "p.requested", "p.fits", "p.headroom")


@query(r"""WITH s AS (SELECT doc_id, text, least(60, length(text)) AS a, least(70, length(text)) AS b FROM documents)
SELECT doc_id, trim(regexp_extract(substr(text, 1, a), '[^.!?\n]*$') || substr(text, a + 1, b - a) || regexp_extract(substr(text, b + 1), '^[^.!?\n]*[.!?\n]?'), ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM s""")
def sentences(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("a", F.least(F.lit(60), F.length("text"))).withColumn("b", F.least(F.lit(70), F.length("text")))
    return docs.select("doc_id", text.sentence_around(F.col("text"), F.col("a"), F.col("b")).alias("sentence"))


@query(r"""SELECT page_id, CASE WHEN f = '' THEN 'upload.pdf' ELSE substr(f, 1, 120) END AS filename FROM (
  SELECT page_id, trim(regexp_replace(list_filter(string_split(rtrim(url, '/'), '/'), lambda x: true)[-1], '[^a-zA-Z0-9_.\- ]', '_', 'g')) AS f FROM pages)""")
def filenames(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.sanitise_filename(F.col("url")).alias("filename"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{W}]+|[{W}]+$', '', 'g')), lambda x: length(x) BETWEEN 7 AND 89) AS lines FROM documents)
SELECT doc_id, coalesce(lines[1], 'paper ' || doc_id) AS title FROM l""")
def titles(spark, sf_dir):
    name = F.concat(F.lit("paper "), F.col("doc_id").cast("string"), F.lit(".PDF"))
    return read(spark, sf_dir, "documents").select("doc_id", text.derive_title(F.col("text"), name).alias("title"))


#: Subjects as words of the synthetic tables, which have none: what a conversation's turn is made to speak of.
SPOKEN = ("Political Science", "computer science", "Maths", "Mathematics and Physics", "HISTORY", "unrelated", "scientists", "Business Studies", "English")
SUBJECT_SQL = "Physics|Chemistry|Biology|Mathematics|Maths|Economics|Science|English|History|Geography|Accountancy|Business Studies|Computer Science|Political Science"


@query(f"""WITH t AS (SELECT conv_id, turn, text || chr(10) || ([{', '.join("'" + s + "'" for s in SPOKEN)}])[1 + (conv_id + turn) % {len(SPOKEN)}] AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN s = '' THEN 'General' ELSE s END AS subject FROM (SELECT conv_id, turn, regexp_extract(t, '(?i)\\b({SUBJECT_SQL})\\b', 1) AS s FROM t)""")
def subjects(spark, sf_dir):
    spoken = F.get(F.array(*[F.lit(s) for s in SPOKEN]), ((F.col("conv_id") + F.col("turn")) % len(SPOKEN)).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.derive_subject(F.concat("text", F.lit("\n"), spoken)).alias("subject"))


@query(r"""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '429 {"error": {"message": "Rate limit  reached", "code": "x"}}' WHEN 1 THEN 'socket' || chr(10) || ' hang up ' || repeat('x', event_id::INT % 300) WHEN 2 THEN '400 {"error": {"message": 5}}' WHEN 3 THEN 'not {json' ELSE '  ' END AS m FROM events),
j AS (SELECT event_id, m, CASE WHEN strpos(m, '{') > 0 THEN TRY_CAST(substr(m, strpos(m, '{')) AS JSON) END AS b FROM e),
l AS (SELECT event_id, trim(regexp_replace(CASE WHEN json_type(b, '$.error.message') = 'VARCHAR' THEN json_extract_string(b, '$.error.message') ELSE m END, '\s+', ' ', 'g')) AS l FROM j)
SELECT event_id, CASE WHEN l = '' THEN NULL WHEN length(l) > 200 THEN substr(l, 1, 199) || '…' ELSE l END AS summary FROM l""")
def error_summaries(spark, sf_dir):
    e = F.col("event_id")
    said = (
        F.when(e % 5 == 0, '429 {"error": {"message": "Rate limit  reached", "code": "x"}}').when(e % 5 == 1, F.concat(F.lit("socket\n hang up "), F.repeat(F.lit("x"), (e % 300).cast("int"))))
        .when(e % 5 == 2, '400 {"error": {"message": 5}}').when(e % 5 == 3, "not {json").otherwise("  ")
    )
    return read(spark, sf_dir, "events").select("event_id", text.error_summary(said).alias("summary"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(diagram|graph|chart|plot|sketch|draw|drawn|axes|curve)\b') AS wants_diagram, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS short FROM documents")
def short_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.wants_diagram(F.col("text")).alias("wants_diagram"), text.truncate(F.col("text"), 60).alias("short"))


@query(r"""WITH e AS (SELECT event_id, (event_id % 3) || 'h' || (event_id % 50) || 'm' || (event_id % 7) || 's' || (event_id % 11) || 'ms' AS s FROM events)
SELECT event_id, (coalesce(regexp_extract(s, '(\d+)h', 1)::BIGINT, 0) * 3600000 + regexp_extract(s, '(\d+)m\d', 1)::BIGINT * 60000 + regexp_extract(s, '(\d+)s', 1)::BIGINT * 1000 + regexp_extract(s, '(\d+)ms$', 1)::BIGINT) AS ms FROM e""")
def durations(spark, sf_dir):
    e = F.col("event_id")
    said = F.concat((e % 3).cast("string"), F.lit("h"), (e % 50).cast("string"), F.lit("m"), (e % 7).cast("string"), F.lit("s"), (e % 11).cast("string"), F.lit("ms"))
    return read(spark, sf_dir, "events").select("event_id", text.duration_ms(said).alias("ms"))


@query(r"""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN 'Here it is: ' || props || ' as asked.' ELSE props END AS r FROM events),
j AS (SELECT event_id, coalesce(TRY_CAST(r AS JSON), TRY_CAST(nullif(regexp_extract(r, '(?s)\{.*\}'), '') AS JSON)) AS j FROM e)
SELECT event_id, json_extract_string(j, '$.k') AS k, j IS NOT NULL AS readable FROM j""")
def json_salvage(spark, sf_dir):
    e = F.col("event_id") % 3
    reply = F.when(e == 0, F.expr("left(props, length(props) - 1)")).when(e == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").withColumn("j", text.salvage_json(reply)).select("event_id", F.get_json_object("j", "$.k").alias("k"), F.col("j").isNotNull().alias("readable"))


# ---- anchoring ----------------------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT item_id, {norm_sql("text")} AS q FROM benchmark WHERE length(trim(text)) >= 8), d AS (SELECT doc_id, {norm_sql("text")} AS n FROM documents)
SELECT item_id, doc_id, CAST(strpos(n, q) - 1 AS INTEGER) AS at FROM b JOIN d ON q <> '' AND contains(n, q)""")
def exact_anchors(spark, sf_dir):
    found = search.search_quotes(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "text", fuzzy=False)
    return found.select("item_id", "doc_id", F.col("place").alias("at"))


@query()
def fuzzy_anchors(spark, sf_dir):
    """Quotes with slips: benchmark items of which every word of seven letters or more lost its fourth, in all documents.

    (DuckDB's edit distance counts bytes; a test holds this against plain Python.)
    """
    slipped = F.regexp_replace("text", r"(\p{L}{3})\p{L}(\p{L}{3,})", "$1$2")
    items = read(spark, sf_dir, "benchmark").select("item_id", slipped.alias("text"))
    found = search.search_quotes(items, read(spark, sf_dir, "documents"), "item_id", "text")
    return found.filter("status = 'fuzzy'").select("item_id", "doc_id", F.col("place").alias("word"), marks.round4(F.col("similarity")).alias("similarity"))


@query("""SELECT l_orderkey, l_linenumber, round(least(l_quantity / 100, 1), 6) AS x, round(842 - (least(l_discount * 5, 1) + l_tax) * 842, 6) AS y, 0.8::DOUBLE AS margin_x, round(0.08::DOUBLE + (l_linenumber % 9) * 0.095::DOUBLE, 6) AS margin_y FROM lineitem""")
def box_geometry(spark, sf_dir):
    one = lambda v: F.least(v, F.lit(1.0))
    rect = F.struct(F.lit(0).alias("page"), one(F.col("l_quantity") / 100).alias("x"), one(F.col("l_discount") * 5).alias("y"), F.lit(0.1).alias("width"), F.col("l_tax").alias("height"))
    li = read(spark, sf_dir, "lineitem").withColumn("r", rect).withColumn("p", anchor.to_points(F.col("r"), F.lit(595.0), F.lit(842.0))).withColumn("m", anchor.margin_rect(F.lit(0), F.col("l_linenumber")))
    return li.select("l_orderkey", "l_linenumber", F.round("r.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.col("m.x").alias("margin_x"), F.round("m.y", 6).alias("margin_y"))


# ---- marks --------------------------------------------------------------------------------------------------------

LINES_AS_MARKS = """SELECT l_orderkey, l_quantity / 4 - 1 AS raw, (l_linenumber + 2)::DOUBLE AS most FROM lineitem"""


@query(f"""WITH m AS ({LINES_AS_MARKS}), c AS (
  SELECT l_orderkey, raw, most, CASE WHEN raw < 0 THEN 0 WHEN raw > most THEN most ELSE least(most, floor(raw / 0.5 + 0.5) * 0.5) END AS mark, (raw < 0 OR raw > most)::INT AS clamped FROM m
), t AS (SELECT l_orderkey, floor(sum(mark) / 0.5 + 0.5) * 0.5 AS awarded, sum(most) AS max_marks, sum(raw) AS raw_total, sum(clamped)::BIGINT AS clamps FROM c GROUP BY l_orderkey)
SELECT *, abs(raw_total - awarded) > 1e-9 AS recomputed FROM t""")
def clamp_snap(spark, sf_dir):
    raw, most = F.col("l_quantity") / 4 - 1, (F.col("l_linenumber") + 2).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", raw.alias("raw"), most.alias("max_marks"), marks.clamp_mark(raw, most).alias("mark"), marks.clamp_kind(raw, most).alias("clamp"), F.lit(False).alias("missing"))
    return validate.question_totals(rows, ["l_orderkey"]).select("l_orderkey", "awarded", "max_marks", "raw_total", "clamps", "recomputed")


@query(f"""WITH j AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in LINE)}) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT p_partkey AS criterion_id, CASE WHEN l_quantity IS NULL THEN 0 WHEN l_quantity > p_size THEN p_size ELSE l_quantity END::DOUBLE AS mark,
  CASE WHEN l_quantity > p_size THEN 'clamped_above_max' END AS clamp, l_quantity IS NULL AS missing
FROM part LEFT JOIN (SELECT * FROM j WHERE n = 1) ON p_partkey = l_partkey""")
def missing_criteria(spark, sf_dir):
    said = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("criterion_id"), F.col("l_quantity").alias("awarded"), F.struct(*LINE).alias("ordinal"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("criterion_id"), F.col("p_size").cast("double").alias("max_marks"))
    return validate.score_criteria(parts, said, []).select("criterion_id", "mark", "clamp", "missing")


@query("SELECT l_suppkey AS criterion_id, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey")
def unknown_judgements(spark, sf_dir):
    said = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("criterion_id"))
    known = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("criterion_id"))
    return validate.unknown_judgements(known, said, []).groupBy("criterion_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity AS mark, l_returnflag = 'R' AS verified, l_partkey AS pass_no FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, (l_returnflag = 'R') DESC, l_partkey, {', '.join(c for c in REST if c not in ('l_quantity', 'l_partkey'))}) AS n FROM lineitem) WHERE n = 1""")
def pass_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumns({"mark": F.col("l_quantity"), "verified": F.col("l_returnflag") == "R", "pass_no": F.col("l_partkey")})
    best = passes.best_scores(rows, ["l_orderkey"], "l_linenumber", [c for c in REST if c not in ("l_quantity", "l_partkey")])
    return best.select("l_orderkey", "l_linenumber", "mark", "verified", "pass_no")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS papers, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def paper_rollup(spark, sf_dir):
    return read(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("papers"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


DRAFT_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey % 100) / 100.0::DOUBLE AS s, l_partkey % 6 AS quoted, least(l_partkey % 6, l_suppkey % 4) AS verified,
 l_linenumber % 4 AS clamps, l_partkey % 2 AS repairs, l_suppkey % 3 AS missing, l_partkey % 400 AS chars, l_suppkey % 5 = 0 AS approximate, l_linenumber % 3 = 0 AS scan, l_partkey % 9 AS unclear, l_suppkey % 6 AS unresolved, l_partkey % 5 AS regions FROM lineitem"""


@query(f"""WITH d AS ({DRAFT_SQL}), a AS (
  SELECT *, greatest(0, least(1, s)) * (CASE WHEN quoted > 0 THEN 0.6::DOUBLE + 0.4::DOUBLE * (verified::DOUBLE / quoted::DOUBLE) ELSE 1.0 END) * (CASE WHEN quoted <= 0 THEN 0.85::DOUBLE ELSE 1.0 END) AS v FROM d
), b AS (
  SELECT *, v + (CASE WHEN clamps > 0 THEN -least(0.3::DOUBLE, 0.1::DOUBLE * clamps) ELSE 0.0 END) + (CASE WHEN repairs > 0 THEN -0.15::DOUBLE * repairs ELSE 0.0 END) + (CASE WHEN missing > 0 THEN -least(0.4::DOUBLE, 0.12::DOUBLE * missing) ELSE 0.0 END)
   + (CASE WHEN chars > 0 AND chars < 200 THEN -0.1::DOUBLE ELSE 0.0 END) + (CASE WHEN approximate THEN -0.08::DOUBLE ELSE 0.0 END) + (CASE WHEN scan THEN -(0.05::DOUBLE + least(0.2::DOUBLE, 0.03::DOUBLE * unclear)) ELSE 0.0 END)
   + (CASE WHEN NOT scan AND unresolved > 0 THEN -least(0.15::DOUBLE, 0.04::DOUBLE * unresolved) ELSE 0.0 END) + (CASE WHEN NOT scan AND regions > 0 THEN -least(0.1::DOUBLE, 0.03::DOUBLE * regions) ELSE 0.0 END) AS w FROM a
), c AS (SELECT *, greatest(0, least(1, w)) AS x FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {round4_sql('x')} AS confidence,
  1 + (clamps > 0)::INT + (repairs > 0)::INT + (missing > 0)::INT + (chars > 0 AND chars < 200)::INT + approximate::INT + scan::INT + (NOT scan AND unresolved > 0)::INT + (NOT scan AND regions > 0)::INT AS factors FROM c""")
def question_confidence(spark, sf_dir):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    draft = {
        "self": (s % 100) / 100.0, "quoted": p % 6, "verified": F.least(p % 6, s % 4), "clamps": n % 4, "repairs": p % 2, "missing": s % 3, "chars": p % 400, "approximate": s % 5 == 0,
        "transcribed": n % 3 == 0, "unclear": p % 9, "unresolved": s % 6, "regions": p % 5,
    }
    return read(spark, sf_dir, "lineitem").withColumn("c", marks.question_confidence(draft)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("c.value").alias("confidence"), F.size("c.factors").alias("factors"))


@query(f"""WITH q AS (SELECT o_custkey, (o_orderkey % 64) / 64.0::DOUBLE AS c, (o_orderkey % 5 + 1)::DOUBLE AS m FROM orders), a AS (
  SELECT o_custkey, count(*) AS questions, greatest(0, least(1, 0.75::DOUBLE * (sum(c * m) / sum(m)) + 0.25::DOUBLE * min(c))) AS x FROM q GROUP BY o_custkey)
SELECT o_custkey, questions, {round4_sql('x')} AS confidence FROM a""")
def paper_confidence(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", ((F.col("o_orderkey") % 64) / 64.0).alias("c"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("m"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("questions"), marks.paper_confidence(F.col("c"), F.col("m")).alias("confidence"))


REVIEW_SQL = f"""WITH q AS (SELECT o_custkey, o_orderkey, (o_orderkey % 64) / 64.0::DOUBLE AS c, (o_orderkey % 5 + 1)::DOUBLE AS m, (o_orderkey % 5 + 1) / 2.0::DOUBLE AS a,
  CASE o_orderstatus WHEN 'F' THEN 'graded' WHEN 'O' THEN 'graded' ELSE 'blank' END AS state FROM orders), p AS (
  SELECT o_custkey, sum(a) AS t, sum(m) AS mm, greatest(0, least(1, 0.75::DOUBLE * (sum(c * m) / sum(m)) + 0.25::DOUBLE * min(c))) AS x,
    count(*) FILTER (state = 'graded' AND c < 0.65) AS unsure, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (state = 'blank') AS blanks, count(*) FILTER (state = 'blank') AS blank FROM q GROUP BY o_custkey
), e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clamped FROM events GROUP BY user_id), r AS (
  SELECT o_custkey, {round4_sql('t')} AS total, {round4_sql('mm')} AS max_marks, {round4_sql('x')} AS confidence, unsure, blank, coalesce(blanks, '') AS blanks, coalesce(clamped, 0) AS clamped FROM p LEFT JOIN e ON user_id = o_custkey)
SELECT *, (confidence < 0.65)::INT + unsure::INT + (blank > 0)::INT + (clamped > 0)::INT AS reasons, confidence < 0.65 OR unsure > 0 OR blank > 0 OR clamped > 0 AS needs_review FROM r"""


@query(REVIEW_SQL)
def review_decisions(spark, sf_dir):
    """The flagship: customers as papers, their orders as questions, clicks as corrected marks."""
    o = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus").isin("F", "O"), "graded").otherwise("blank")
    q = read(spark, sf_dir, "orders").select("o_custkey", o.alias("number"), ((o % 64) / 64.0).alias("confidence"), (o % 5 + 1).cast("double").alias("max_marks"), ((o % 5 + 1) / 2.0).alias("awarded"), state.alias("state"))
    audit = read(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("o_custkey"), F.lit("clamped_above_max").alias("kind"))
    out = review.decide(review.paper_totals(q, ["o_custkey"]), review.audit_counts(audit, ["o_custkey"]), ["o_custkey"])
    return out.select("o_custkey", "total", "max_marks", "confidence", "unsure", "blank", F.array_join(F.col("blanks").cast("array<string>"), ",").alias("blanks"), "clamped", F.size("reasons").alias("reasons"), "needs_review")


#: Audit kinds that events stand for.
AUDITED = {"click": "clamped_above_max", "view": "evidence_unverified", "purchase": "rubric_criterion_missing", "signup": "total_recomputed"}


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clamped, count(*) FILTER (event_type = 'view') AS unverified, count(*) FILTER (event_type = 'purchase') AS unmarked, count(*) FILTER (event_type = 'signup') AS recomputed FROM events GROUP BY user_id""")
def audit_pivot(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in AUDITED.items()], F.lit("other"))
    return review.audit_counts(read(spark, sf_dir, "events").select("user_id", kind.alias("kind")), ["user_id"])


#: Errors as an outside service gives them: a status or none, a message or none.
STATUSES, MESSAGES = (429, 503, 401, 404, 408, 403, None, 400, 500), (None, "Quota reached", "Bad API key", "socket hang up", "Too many requests", "quotas")
_sql_list = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(f"""WITH e AS (SELECT event_id, ({_sql_list(STATUSES)})[1 + event_id % 9] AS s, lower(coalesce(({_sql_list(MESSAGES)})[1 + (event_id // 9) % 6], '')) AS m FROM events)
SELECT event_id, CASE WHEN s = 429 OR m LIKE '%rate limit%' OR m LIKE '%too many requests%' OR m LIKE '%quota%' THEN 'rate_limit' WHEN s IN (401, 403) THEN 'auth' WHEN s IS NULL OR s IN (408, 409, 429, 500, 502, 503, 504) THEN 'transient' ELSE 'permanent' END AS kind,
 s IS NULL OR s IN (408, 409, 429, 500, 502, 503, 504) AS retryable, (400 * power(2, event_id % 3))::BIGINT AS wait_ms, floor((event_id % 7) * 100.0 / 7 + 0.5)::INT AS share FROM e""")
def error_kinds(spark, sf_dir):
    e = F.col("event_id")
    code = F.get(F.array(*[F.lit(c) for c in STATUSES]), (e % 9).cast("int"))
    said = F.get(F.array(*[F.lit(m) for m in MESSAGES]), (F.floor(e / 9) % 6).cast("int"))
    rows = judge.classify_errors(read(spark, sf_dir, "events").withColumns({"status": code, "message": said}))
    return rows.select("event_id", "kind", "retryable", marks.backoff_ms(e % 3 + 1).alias("wait_ms"), marks.percentage(e % 7, F.lit(7)).alias("share"))


# ---- joins, windows, sets -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS number, o_orderpriority AS subject, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7)::DOUBLE END AS pm FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT o_custkey AS doc_id, o_orderkey AS number, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 9)::DOUBLE END AS sm FROM orders WHERE o_orderkey % 7 <> 0),
c AS (SELECT o_custkey AS doc_id, o_orderkey AS number, sum(l_quantity) AS cm FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL),
b AS (SELECT coalesce(p.doc_id, s.doc_id) AS doc_id, coalesce(p.number, s.number) AS number, coalesce(subject, '') AS subject, pm, sm, p.number IS NOT NULL AS inp, s.number IS NOT NULL AS ins FROM p FULL JOIN s ON p.doc_id = s.doc_id AND p.number = s.number),
t AS (SELECT b.*, coalesce(sm, pm, cm) AS m, count(*) FILTER (inp) OVER (PARTITION BY b.doc_id) AS np, count(*) FILTER (ins) OVER (PARTITION BY b.doc_id) AS ns FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.number = c.number)
SELECT doc_id, number, subject, m AS max_marks, ((inp AND NOT ins AND ns > 0)::INT + (ins AND NOT inp AND np > 0)::INT + (coalesce(m, 0) <= 0)::INT) AS warnings, coalesce(m, 0) <= 0 AS dropped FROM t""")
def full_join_totals(spark, sf_dir):
    """Orders as questions: some only on the paper, some only in the scheme, stated totals on either, both or neither side."""
    o = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), o.alias("number"), F.col("o_orderpriority").alias("subject"), F.lit("").alias("prompt"), F.lit("").alias("model_answer"), F.lit(False).alias("requires_diagram"), "o_orderkey")
    paper = orders.filter(o % 4 != 0).withColumn("max_marks", F.when(o % 3 == 0, (o % 7).cast("double")))
    scheme = orders.filter(o % 7 != 0).withColumn("max_marks", F.when(o % 5 == 0, (o % 9).cast("double")))
    criteria = orders.filter(o % 2 == 0).join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == o).select("doc_id", "number", F.col("l_quantity").alias("max_marks"))
    out = rubric.join_questions(paper, scheme, criteria)
    return out.select("doc_id", "number", "subject", "max_marks", F.size("warnings").alias("warnings"), "dropped")


@query("SELECT o_orderkey, o_orderdate, o_totalprice, count(l_orderkey) AS annotation_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def result_history(spark, sf_dir):
    return store.result_history(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", ["o_totalprice"], "o_orderdate")


@query("""SELECT event_id, user_id, sum(event_id % 1000 + 1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW)::BIGINT AS used FROM events""")
def rolling_tokens(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 1000 + 1)
    return limits.rolling_usage(e, ["user_id"]).select("event_id", "user_id", "used")


@query("""WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Answer ' || turn || ' mitochondria' WHEN 1 THEN 'Q' || turn || ' - Science' || chr(10) || text ELSE 'Ans. ' || turn || ' 3.5 kg' || chr(10) || text END AS t,
  CASE turn % 3 WHEN 0 THEN 'mitochondria' WHEN 1 THEN text ELSE '3.5 kg' || chr(10) || text END AS body FROM conversations WHERE turn > 0 AND conv_id % 5 <> 0),
n AS (SELECT conv_id, max(turn) AS most FROM conversations WHERE turn > 0 AND conv_id % 5 <> 0 GROUP BY conv_id),
q AS (SELECT unnest(range(1, 6)) AS number)
SELECT n.conv_id, number, CASE WHEN s.turn IS NULL THEN '' ELSE trim(body, ' ' || chr(9) || chr(10) || chr(13)) END AS text, s.turn IS NULL AS approximate, coalesce(greatest(s.turn - 2, 0), 0)::INT AS start_page  -- a heading begins at the line end before it, on the page before
FROM n CROSS JOIN q LEFT JOIN s ON s.conv_id = n.conv_id AND s.turn = number""")
def heading_segments(spark, sf_dir):
    """Conversations as answer sheets: each turn a page of one answer, some of a single line, cut apart again for questions 1 to 5."""
    t = F.col("turn")
    said = F.when(t % 3 == 0, F.format_string("Answer %d mitochondria", t)).when(t % 3 == 1, F.concat(F.format_string("Q%d - Science\n", t), "text")).otherwise(F.concat(F.format_string("Ans. %d 3.5 kg\n", t), "text"))
    pages = read(spark, sf_dir, "conversations").filter("turn > 0 AND conv_id % 5 <> 0").select(F.col("conv_id").alias("doc_id"), t.alias("page"), said.alias("text"))
    questions = spark.range(1, 6).select(F.col("id").alias("number"), F.col("id").cast("string").alias("question_id"))
    return segment.segments(segment.joined_pages(pages), questions).select(F.col("doc_id").alias("conv_id"), "number", "text", "approximate", "start_page")


@query(r"""WITH l AS (SELECT doc_id, length(text) AS chars, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS k FROM documents), c AS (
  SELECT doc_id, chars, k, count(*) AS n FROM l GROUP BY ALL)
SELECT doc_id, any_value(chars)::BIGINT AS chars, count(*) FILTER (n > 1 AND length(k) >= 25) AS repeated, any_value(chars) > 7000 OR count(*) FILTER (n > 1 AND length(k) >= 25) >= 4 AS degenerate FROM c GROUP BY doc_id""")
def degenerate_pages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", transcript.degenerate_text(F.col("text")).alias("d")).select("doc_id", "d.chars", "d.repeated", "d.degenerate")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT h, max(doc_id) AS a FROM h GROUP BY h), s AS (
  SELECT h.h, max(doc_id) AS b FROM h JOIN r ON h.h = r.h AND doc_id < a GROUP BY h.h)
SELECT doc_id, h.h AS sha256, CASE WHEN doc_id <> a THEN a ELSE b END AS twin_id FROM h JOIN r ON h.h = r.h JOIN s ON h.h = s.h""")
def content_twins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit(True).alias("reusable"))
    twins = documents.content_twins(docs, order=[F.col("doc_id").desc()])
    return twins.join(docs, "doc_id").select("doc_id", "sha256", "twin_id")


@query(rf"""SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY role, lower(trim(regexp_replace(text, '[{W}]+', ' ', 'g'))) ORDER BY conv_id, turn) AS n FROM conversations WHERE trim(regexp_replace(text, '[{W}]+', ' ', 'g')) <> '') WHERE n = 1""")
def dedupe_guidance(spark, sf_dir):
    return rubric.dedupe_lines(read(spark, sf_dir, "conversations"), ["role"], "text", ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM documents), p AS (
  SELECT doc_id, n, 1 AS i, n[1] AS held, 1 AS groups FROM l
  UNION ALL SELECT doc_id, n, i + 1, CASE WHEN held + n[i + 1] > 1000 THEN n[i + 1] ELSE held + n[i + 1] END, groups + (held + n[i + 1] > 1000)::INT FROM p WHERE i < len(n))
SELECT doc_id, max(groups)::INT AS packs FROM p GROUP BY doc_id""")
def greedy_pack(spark, sf_dir):
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return read(spark, sf_dir, "documents").select("doc_id", (F.array_max(chunk.pack(sizes, 1000)) + 1).alias("packs"))


def _numbered_lines(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy(*LINE[1:])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("place"), F.col("l_quantity").alias("max_marks"), F.concat("l_returnflag", F.lit(" point")).alias("description"))


NUMBERED = f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE[1:])}) AS place, l_quantity AS m FROM lineitem"


@query(f"""WITH r AS ({NUMBERED}), w AS (
  SELECT *, sum(m) OVER f AS fs, sum(m) OVER b AS bs, sum(m) OVER p AS t, count(*) OVER p AS n, sum(m) OVER p - sum(CASE WHEN place = 1 THEN m END) OVER p AS stated FROM r
  WINDOW p AS (PARTITION BY l_orderkey), f AS (PARTITION BY l_orderkey ORDER BY place), b AS (PARTITION BY l_orderkey ORDER BY place DESC)
), h AS (SELECT *, n - place + 1 AS j, min(CASE WHEN abs(fs - stated) < 1e-6 AND place < n THEN place END) OVER (PARTITION BY l_orderkey) AS head,
  min(CASE WHEN abs(bs - stated) < 1e-6 AND n - place + 1 < n THEN n - place + 1 END) OVER (PARTITION BY l_orderkey) AS tail FROM w)
SELECT l_orderkey, place, CASE WHEN n < 2 THEN 'kept'
  WHEN abs(t - 2 * stated) < 1e-6 AND head IS NOT NULL THEN CASE WHEN (place > head) = (n - head < head) THEN 'box' ELSE 'kept' END
  WHEN t > stated + 1e-6 AND head IS NOT NULL THEN CASE WHEN place <= head THEN 'kept' ELSE 'extra' END
  WHEN t > stated + 1e-6 AND tail IS NOT NULL THEN CASE WHEN j <= tail THEN 'kept' ELSE 'extra' END ELSE 'kept' END AS fate FROM h""")
def trim_to_total(spark, sf_dir):
    rows = _numbered_lines(spark, sf_dir)
    w = Window.partitionBy("l_orderkey")
    stated = F.sum("max_marks").over(w) - F.sum(F.when(F.col("place") == 1, F.col("max_marks"))).over(w)
    return rubric.trim_fate(rows.withColumn("stated", stated), ["l_orderkey"], "place").select("l_orderkey", "place", "fate")


@query(f"""WITH r AS ({NUMBERED}), s AS (SELECT *, sum(m) OVER p AS t, count(*) OVER p AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY place DESC) AS k FROM r WINDOW p AS (PARTITION BY l_orderkey)),
h AS (SELECT *, greatest(0.5, floor(m / t * 10.0::DOUBLE * 2 + 0.5) / 2) AS v FROM s), z AS (SELECT *, sum(v) OVER (PARTITION BY l_orderkey) AS u FROM h)
SELECT l_orderkey, place, round(CASE WHEN abs(t - 10) < 1e-9 THEN m WHEN n > 20 THEN 10.0::DOUBLE / n WHEN k = 1 THEN greatest(0.5, v + 10 - u) ELSE v END, 4) AS scaled FROM z""")
def rescale_to_total(spark, sf_dir):
    out = rubric.rescale(_numbered_lines(spark, sf_dir).withColumn("target", F.lit(10.0)), ["l_orderkey"], "place")
    return out.select("l_orderkey", "place", F.round("scaled", 4).alias("scaled"))


@query("""WITH k AS (SELECT user_id, event_type, CASE event_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'fair' WHEN 2 THEN 'good' END AS l FROM events)
SELECT user_id, event_type, CASE max(CASE l WHEN 'poor' THEN 3 WHEN 'fair' THEN 2 WHEN 'good' THEN 1 END) WHEN 3 THEN 'poor' WHEN 2 THEN 'fair' WHEN 1 THEN 'good' END AS legibility FROM k GROUP BY user_id, event_type""")
def worst_legibility(spark, sf_dir):
    e = F.col("event_id") % 4
    pages = read(spark, sf_dir, "events").withColumn("legibility", F.when(e == 0, "poor").when(e == 1, "fair").when(e == 2, "good"))
    return passes.worst_legibility(pages, ["user_id", "event_type"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity / 60 - l_discount >= 0.002 AND l_tax + 0.1 >= 0.002 THEN round(l_quantity / 60, 6) END AS bottom FROM lineitem""")
def box_scales(spark, sf_dir):
    """Boxes that came as thousandths, read back as fractions."""
    thousand = [F.col("l_discount") * 1000, F.col("l_quantity") / 60 * 1000, F.lit(500.0), F.lit(500.0) + (F.col("l_tax") + 0.1) * 1000]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(transcript.normalise_box(*thousand)["bottom"], 6).alias("bottom"))


@query("""WITH p AS (SELECT * FROM (VALUES ('incorrect', 'Incorrect', 'D62E33'), ('missing', 'Missing', 'DB7A05'), ('spelling', 'Spelling', '1668C4'), ('grammar', 'Grammar', '4F4ECC'), ('layout', 'Layout', '8B45BD'), ('praise', 'Good', '0F8F56')) AS t(kind, label, h)),
d AS (SELECT kind, label, list_transform([1, 3, 5], lambda i: (('0x' || substr(h, i, 2))::INT) / 255.0::DOUBLE) AS v FROM p)
SELECT kind, label, round(v[1], 6) AS r, round(v[2], 6) AS g, round(v[3], 6) AS b FROM d""")
def annotation_palette(spark, sf_dir):
    return report.palette(spark).select("kind", "label", *[F.round(f"rgb.{c}", 6).alias(c) for c in "rgb"])


@query("SELECT doc_id, lang, source, n_chars, doc_id % 97 AS created_at FROM documents")
def document_listing(spark, sf_dir):
    """Documents without their texts: the scan reads no text column."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("doc_id") % 97).alias("created_at"), F.col("text").alias("full_text"))
    return store.document_listing(docs)


# ---- functions and operators one by one ---------------------------------------------------------------------------


#: Item numbers and names as ASCII words that are near each other.
NEAR_SQL = "SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS a, lower(p_type) || (p_partkey % 1000) AS b FROM part"


@query(f"""WITH w AS ({NEAR_SQL}), f AS (SELECT p_partkey, a, b, translate(replace(a, 'rn', 'm'), 'l1|05', 'iiios') AS fa, translate(replace(b, 'rn', 'm'), 'l1|05', 'iiios') AS fb FROM w)
SELECT p_partkey, levenshtein(a, b)::INT AS distance, CASE WHEN a = b THEN 1.0 ELSE 1.0::DOUBLE - levenshtein(fa, fb)::DOUBLE / greatest(length(fa), length(fb)) END AS similarity FROM f""")
def token_similarities(spark, sf_dir):
    """ASCII words: DuckDB's edit distance counts bytes."""
    a, b = F.lower(F.regexp_replace("p_name", "[^a-zA-Z0-9]", "")), F.concat(F.lower("p_type"), (F.col("p_partkey") % 1000).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), text.token_similarity(a, b).alias("similarity"))


@query(r"""WITH t AS (SELECT o_orderkey, (['x', 'the red lamp is lit', 'a rod lamp', 'red lnmp here', 'one more tall red lamp'])[1 + o_orderkey % 5] AS t, (['red lamp', 'rod lamb', 'red lamp is'])[1 + o_orderkey % 3] AS p FROM orders),
n AS (SELECT *, string_split(t, ' ') AS w, string_split(p, ' ') AS q FROM t),
o AS (SELECT *, unnest(range(0, greatest(0, len(w) - len(q) + 1)::BIGINT)) AS k FROM n),
s AS (SELECT o_orderkey, k, len(q) AS m, list_transform(range(1, len(q) + 1), lambda j: CASE WHEN q[j] = w[k + j] THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(translate(replace(q[j], 'rn', 'm'), 'l1|05', 'iiios'), translate(replace(w[k + j], 'rn', 'm'), 'l1|05', 'iiios'))::DOUBLE / greatest(length(translate(replace(q[j], 'rn', 'm'), 'l1|05', 'iiios')), length(translate(replace(w[k + j], 'rn', 'm'), 'l1|05', 'iiios'))) END) AS v FROM o),
b AS (SELECT o_orderkey, k, CASE WHEN list_min(v) < 0.68 THEN 0.0::DOUBLE ELSE list_sum(v) / m END AS x FROM s),
m AS (SELECT o_orderkey, max(x) AS x, min(k) FILTER (x = y) AS k FROM (SELECT *, max(x) OVER (PARTITION BY o_orderkey) AS y FROM b) GROUP BY o_orderkey)
SELECT n.o_orderkey, CASE WHEN contains(t, p) THEN strpos(t, p) - 1 WHEN x >= 0.8 THEN coalesce(list_sum(list_transform(w[1:k], lambda z: length(z) + 1)), 0) END::INT AS start,
  CASE WHEN contains(t, p) THEN 1.0 WHEN x >= 0.8 THEN round(x, 9) END AS similarity FROM n LEFT JOIN m USING (o_orderkey)""")
def phrases_found(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.get(F.array(*[F.lit(t) for t in ("x", "the red lamp is lit", "a rod lamp", "red lnmp here", "one more tall red lamp")]), (k % 5).cast("int"))
    phrase = F.get(F.array(*[F.lit(t) for t in ("red lamp", "rod lamb", "red lamp is")]), (k % 3).cast("int"))
    found = read(spark, sf_dir, "orders").select("o_orderkey", text.find_phrase(said, phrase).alias("f"))
    return found.select("o_orderkey", F.col("f.start").alias("start"), F.round("f.similarity", 9).alias("similarity"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Q' || (event_id % 40) || ' (a) x' WHEN 1 THEN CASE WHEN event_id % 40 IN (31, 33) THEN 'Q' || (event_id % 40) || ' x' ELSE 'O ' || (event_id % 40) || ' x' END
  WHEN 2 THEN 'omega' || (event_id % 40) || ' = 5' WHEN 3 THEN 'Q' || (event_id % 40) || ':' WHEN 4 THEN 'plain' || chr(10) || CASE WHEN event_id % 40 IN (31, 33) THEN 'Q' || (event_id % 40) ELSE '@' || (event_id % 40) END ELSE '' END AS fixed FROM events""")
def headings_normalised(spark, sf_dir):
    e, n = F.col("event_id"), (F.col("event_id") % 40).cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = F.when(e % 6 == 0, join("g", n, " (a) x")).when(e % 6 == 1, join("O ", n, " x")).when(e % 6 == 2, join("omega", n, " = 5")).when(e % 6 == 3, join("( q ) ", n, ":")).when(e % 6 == 4, join("plain\n@", n)).otherwise("")
    return read(spark, sf_dir, "events").select("event_id", text.normalise_headings(line, F.array(F.lit(31), F.lit(33))).alias("fixed"))


#: A passage read in overlapping pieces.
PIECES_SQL = "SELECT doc_id, trim(substr(n, 1, 80)) AS a, trim(CASE doc_id % 4 WHEN 0 THEN upper(substr(n, 1, 80)) WHEN 1 THEN substr(n, 20, 30) WHEN 2 THEN '' ELSE substr(n, 60, 60) END) AS b FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), ' +', ' ', 'g') AS n FROM documents)"


@query(f"""WITH p AS ({PIECES_SQL}) SELECT doc_id, CASE WHEN b = '' THEN a WHEN a = '' THEN b WHEN contains(lower(a), lower(b)) THEN a WHEN contains(lower(b), lower(a)) THEN b ELSE a || chr(10) || b END AS joined FROM p""")
def seams_joined(spark, sf_dir):
    d = F.col("doc_id") % 4

    def pieces(n):
        b = F.when(d == 0, F.upper(F.substring(n, 1, 80))).when(d == 1, F.substring(n, 20, 30)).when(d == 2, "").otherwise(F.substring(n, 60, 60))
        return text.join_text(F.substring(n, 1, 80), b)

    n = F.regexp_replace(F.regexp_replace("text", r"[^\p{Alnum} ]+", ""), "  +", " ")
    return read(spark, sf_dir, "documents").select("doc_id", text.let(n, pieces).alias("joined"))


@query(r"""WITH t AS (SELECT doc_id, text AS t, CASE doc_id % 3 WHEN 0 THEN substr(text, 11, 20) WHEN 1 THEN replace(upper(substr(text, 11, 20)), ' ', chr(10)) ELSE 'certainly not in it' END AS o FROM documents WHERE regexp_full_match(substr(text, 1, 40), '[A-Za-z ]+') AND substr(text, 11, 20) = trim(substr(text, 11, 20)))
SELECT doc_id, CASE WHEN contains(t, o) THEN strpos(t, o) - 1 WHEN contains(lower(t), lower(replace(o, chr(10), ' '))) AND o <> 'certainly not in it' THEN strpos(lower(t), lower(replace(o, chr(10), ' '))) - 1 END::INT AS at FROM t""")
def openings_located(spark, sf_dir):
    opening = F.substring("text", 11, 20)
    docs = read(spark, sf_dir, "documents").filter(F.substring("text", 1, 40).rlike(r"^[A-Za-z ]+\z") & (opening == F.trim(opening)))
    d = F.col("doc_id") % 3
    said = F.when(d == 0, opening).when(d == 1, F.replace(F.upper(opening), F.lit(" "), F.lit("\n"))).otherwise("certainly not in it")
    return docs.select("doc_id", text.locate(F.col("text"), said).cast("int").alias("at"))


FOLDED = "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2212\u00a0\u2022\u00d7", "''''''\"\"\"--- *x"  # quotes doubled, as SQL wants them


@query(f"""SELECT doc_id, md5(regexp_replace(translate(replace(replace(text, '…', '...'), '₹', 'Rs '), '{FOLDED[0]}', '{FOLDED[1]}'), '[^\\x20-\\x7E\\n]', '', 'g')) AS folded FROM documents""")
def ascii_folded(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("folded"))


@query(rf"""SELECT doc_id, (350 + list_sum(list_transform(string_split(text, chr(10)), lambda p: greatest(ceil(length(p) / 3.2::DOUBLE), ceil(len(regexp_extract_all(p, '[^{W}]+')) * 1.3::DOUBLE + length(regexp_replace(p, '[\p{{L}}\p{{N}}{W}]', '', 'g')) * 0.5::DOUBLE)) + 4)))::BIGINT AS request,
  length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) < 20 AND doc_id % 3 <> 0 AS unread FROM documents""")
def request_estimates(spark, sf_dir):
    source = F.when(F.col("doc_id") % 3 == 0, "transcription")
    return read(spark, sf_dir, "documents").select("doc_id", text.estimate_request(F.split("text", "\n")).alias("request"), text.needs_transcription(F.col("text"), source).alias("unread"))


@query(f"""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE[1:])}) AS n, l_returnflag || l_linestatus AS t, l_quantity * 4 AS x, 700 - floor(l_discount * 40) * 2 AS y, 20.0::DOUBLE AS wd, l_tax > 0.07 AS eol FROM lineitem),
s AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN '' WHEN lag(eol) OVER w OR abs(y - lag(y) OVER w) > 2.5 THEN chr(10) WHEN x - (lag(x) OVER w + lag(wd) OVER w) > 0.2::DOUBLE * 10 THEN ' ' ELSE '' END AS sep FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
SELECT l_orderkey, string_agg(sep || t, '' ORDER BY n) AS text FROM s GROUP BY l_orderkey""")
def page_texts(spark, sf_dir):
    """Order lines as text items of a page, put together as its text."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE[1:])
    items = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.row_number().over(order).alias("item_no"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_quantity") * 4).alias("x"), (700 - F.floor(F.col("l_discount") * 40) * 2).cast("double").alias("y"),
        F.lit(20.0).alias("width"), F.lit(10.0).alias("font"), (F.col("l_tax") > 0.07).alias("eol"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.lit(0).alias("page"),
    )
    return documents.pages_and_runs(items, ["l_orderkey", "page"])[0].select("l_orderkey", "text")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, (o_orderkey % 5 + 1)::DOUBLE AS m FROM orders), c AS (SELECT o_custkey, l_orderkey, sum(l_linenumber % 3 + 1)::DOUBLE AS s, count(*) - count(DISTINCT l_linenumber) AS twice FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
e AS (SELECT q.o_custkey, q.o_orderkey, 'sum' AS error FROM q LEFT JOIN c ON q.o_orderkey = c.l_orderkey WHERE abs(coalesce(s, 0) - m) > 1e-9
 UNION ALL SELECT q.o_custkey, q.o_orderkey, 'twice' FROM q JOIN c ON q.o_orderkey = c.l_orderkey WHERE twice > 0
 UNION ALL SELECT o_custkey, NULL, 'total' FROM (SELECT o_custkey, sum(m) AS m FROM q GROUP BY o_custkey) WHERE abs(m - 30) > 1e-9)
SELECT o_custkey, error, count(*) AS n FROM e GROUP BY ALL""")
def rubric_arithmetic(spark, sf_dir):
    """Customers as rubrics, orders as questions, lines as criteria: the sums that don't add up."""
    o = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    questions = orders.select(F.col("o_custkey").alias("rubric_id"), o.alias("question_id"), (o % 5 + 1).cast("double").alias("max_marks"))
    tasks = steps.tasks_for(orders, validate.TASK_QUESTIONS)
    lines = steps.dealt(read(spark, sf_dir, "lineitem"), tasks, "l_orderkey").join(steps.dealt(orders, tasks, "o_orderkey"), F.col("l_orderkey") == o)
    criteria = lines.select(F.col("o_custkey").alias("rubric_id"), o.alias("question_id"), F.col("l_linenumber").alias("criterion_id"), (F.col("l_linenumber") % 3 + 1).cast("double").alias("max_marks"))
    rubrics = orders.select(F.col("o_custkey").alias("rubric_id"), F.lit(30.0).alias("total_marks")).distinct()
    kind = F.when(F.col("error").contains("twice"), "twice").when(F.col("error").contains("paper"), "total").otherwise("sum")
    return validate.rubric_errors(criteria, questions, rubrics, tasks).groupBy(F.col("rubric_id").alias("o_custkey"), kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE[1:])}) AS n, (n - 1) * 10 AS s, (n - 1) * 10 + 8 AS e FROM lineitem), q AS (SELECT o_orderkey, o_orderkey % 25 AS f, o_orderkey % 25 + 3 + o_orderkey % 17 AS t FROM orders)
SELECT o_orderkey, count(l_orderkey)::INT AS met, (min(n) - 1)::INT AS first FROM q LEFT JOIN r ON l_orderkey = o_orderkey AND e > f AND s < t GROUP BY o_orderkey""")
def spans_met(spark, sf_dir):
    """Order lines as text runs of a page, each on a line of its own; orders as spans: which runs a span meets."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE[1:])
    rect = F.struct(F.lit(0).alias("page"), F.lit(0.1).alias("x"), (F.col("run_no") * 0.01).alias("y"), F.lit(0.5).alias("width"), F.lit(0.005).alias("height"))
    runs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), (F.row_number().over(order) - 1).alias("run_no"))
    runs = runs.withColumns({"start": F.col("run_no") * 10, "end": F.col("run_no") * 10 + 8, "text": F.lit("eightish"), "rect": rect})
    o = F.col("o_orderkey")
    spans = read(spark, sf_dir, "orders").select(o.alias("doc_id"), o.alias("quote_id"), F.lit(0).alias("page"), (o % 25).cast("int").alias("from"), (o % 25 + 3 + o % 17).cast("int").alias("to"))
    met = anchor.span_rects(spans, runs)
    first = F.round(F.array_min(F.transform("rects", lambda r: r["y"])) / 0.01).cast("int")
    return met.select(F.col("quote_id").alias("o_orderkey"), F.coalesce(F.size("rects"), F.lit(0)).alias("met"), first.alias("first"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT doc_id, doc_id % 7 + 1 AS number, 'Topic ' || (doc_id % 3) AS subject, (doc_id % 10 + 0.5)::DOUBLE AS marks FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(string_agg(regexp_replace(t, '^[{W}]+|[{W}]+$', '', 'g'), ' ' ORDER BY i), '[{W}]+', ' ', 'g')) AS prompt FROM l WHERE regexp_replace(t, '[{W}]', '', 'g') <> '' GROUP BY doc_id)
SELECT p.doc_id, number::INT AS number, subject, marks AS max_marks, md5(coalesce(prompt, '')) AS prompt FROM p LEFT JOIN b USING (doc_id)""")
def question_papers(spark, sf_dir):
    """Documents as question papers of one question: a heading, marks, the text as prompt, and a line that is skipped."""
    d = F.col("doc_id")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = join("preface\nQuestion ", d % 7 + 1, " - Topic ", d % 3, "\n", d % 10, ".5 Marks\n", F.coalesce("text", F.lit("")), "\nExpected answer: none")
    papers = read(spark, sf_dir, "documents").select("doc_id", said.alias("text"))
    return rubric.parse_question_paper(papers).select("doc_id", "number", "subject", "max_marks", F.md5("prompt").alias("prompt"))


@query("""WITH c AS (
  SELECT conv_id, row_number() OVER w - 1 AS place, text, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (
  SELECT *, length(text) % 4 + 1 AS number, length(text) % 5 < 3 AS begins, strpos(text, substr(text, 21, 12)) - 1 AS found FROM c WHERE length(text) % 7 > 0
), b AS (
  SELECT conv_id, number, min_by(start + CASE WHEN length(text) % 3 > 0 AND length(text) > 20 THEN found ELSE 0 END, place) AS at_, min(place) AS place FROM t WHERE begins GROUP BY 1, 2
), a AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY place) AS text FROM c GROUP BY 1), s AS (
  SELECT b.conv_id, number, at_, place, (SELECT min(o.at_) FROM b AS o WHERE o.conv_id = b.conv_id AND o.at_ > b.at_) AS upto FROM b
), m AS (
  SELECT t.conv_id, t.number, string_agg(t.text, chr(10) ORDER BY t.place) AS text, min(t.place) AS place FROM t ANTI JOIN b ON b.conv_id = t.conv_id AND b.number = t.number GROUP BY 1, 2
), f AS (
  SELECT s.conv_id, number, substr(a.text, CAST(at_ AS INT) + 1, CAST(coalesce(upto, length(a.text)) - at_ AS INT)) AS text, place, false AS approximate FROM s JOIN a USING (conv_id) UNION ALL SELECT conv_id, number, text, place, true FROM m
)
SELECT q.conv_id, q.number::INT AS number, md5(trim(coalesce(f.text, ''), ' ' || chr(9) || chr(10) || chr(13))) AS text, coalesce(f.place, 0)::INT AS start_page, coalesce(approximate, true) AS approximate
FROM (SELECT DISTINCT conv_id, unnest(range(1, 5)) AS number FROM t) AS q LEFT JOIN f USING (conv_id, number)""")
def attributed_answers(spark, sf_dir):
    """Turns as chunks of an answer sheet, of which a judge said which of four answers each holds and how it begins."""
    n = F.length("text")
    turns = read(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.select("conv_id", "place", "text", F.coalesce(F.sum(n + 1).over(before), F.lit(0)).cast("int").alias("start"), F.col("place").alias("start_page"))
    words = F.when(n % 3 > 0, F.substring("text", 21, 12)).otherwise("said nowhere in it")
    told = chunks.filter(n % 7 > 0).select("conv_id", "place", F.lit(0).alias("ordinal"), (n % 4 + 1).alias("number"), (n % 5 < 3).alias("begins"), words.alias("first_words"))
    questions = spark.range(1, 5).select(F.col("id").cast("string").alias("question_id"), F.col("id").cast("int").alias("number"))
    return segment.attributed(chunks, told, questions, "conv_id").select("conv_id", "number", F.md5("text").alias("text"), "start_page", "approximate")


WRAP_ROOM = int(495.0 * 1000 / 9.0)


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(translate(replace(replace(coalesce(text, ''), '…', '...'), '₹', 'Rs '), '{FOLDED[0]}', '{FOLDED[1]}'), '[^\\x20-\\x7E\\n]', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(t, '[ \\n]+'), lambda w: w <> ''), lambda w: {{'line': w, 'n': CAST(list_sum(list_transform(string_split(w, ''), lambda c: {list(report.WIDTHS)}[ord(c) - 31])) AS BIGINT), 'out': CAST([] AS VARCHAR[])}}) AS words FROM t),
r AS (SELECT doc_id, CASE WHEN len(words) > 0 THEN list_reduce(words, lambda a, b: CASE WHEN a.n + 278 + b.n <= {WRAP_ROOM} THEN {{'line': a.line || ' ' || b.line, 'n': a.n + 278 + b.n, 'out': a.out}} ELSE {{'line': b.line, 'n': b.n, 'out': list_append(a.out, a.line)}} END) END AS s FROM w)
SELECT doc_id, CASE WHEN s IS NULL THEN 0 ELSE len(s.out) + 1 END::BIGINT AS n_lines, md5(CASE WHEN s IS NULL THEN '' ELSE array_to_string(list_append(s.out, s.line), chr(10)) END) AS lines FROM r""")
def wrapped_lines(spark, sf_dir):
    """Whole documents as lines of a page 495 points wide, in nine points."""
    lines = report.wrapped(F.col("text"), 9.0, 495.0)
    return read(spark, sf_dir, "documents").select("doc_id", lines.alias("_l")).select("doc_id", F.size("_l").cast("long").alias("n_lines"), F.md5(F.array_join("_l", "\n")).alias("lines"))


#: A day's allowance of tokens for each user; what a request reserves, uses and hears of the provider comes from its event.
LEDGER_LIMIT, LEDGER_WINDOW = 4000, 86_400_000
LEDGER_SQL = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS asked, CAST(200 + 20 * floor(value) AS BIGINT) AS reserve, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
), q AS (
  SELECT *, (k + 1) * 60000 AS took, CASE WHEN k % 2 = 0 THEN reserve // 2 ELSE reserve END AS used, CASE WHEN k % 10 = 3 THEN k * 20 END AS remaining, k * 600000 AS reset_ms,
    row_number() OVER (PARTITION BY key ORDER BY asked, id) AS n FROM e
), r AS (
  SELECT DISTINCT key, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS free, CAST(NULL AS BIGINT) AS wakes, CAST(0 AS BIGINT) AS waited, CAST([] AS STRUCT(asked BIGINT, tokens BIGINT)[]) AS led,
    CAST(NULL AS BIGINT) AS server_at, CAST(NULL AS BIGINT) AS server_left, CAST(NULL AS BIGINT) AS resets, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS BIGINT) AS asked_ms,
    CAST(NULL AS BIGINT) AS started_ms, CAST(NULL AS BIGINT) AS waited_ms, CAST(NULL AS BIGINT) AS used_before
  FROM q
  UNION ALL
  SELECT key, CASE WHEN large OR fits THEN n + 1 ELSE n END, CASE WHEN NOT large AND fits THEN t + took ELSE free END, CASE WHEN large OR fits THEN NULL ELSE t + pause END, CASE WHEN large THEN waited WHEN fits THEN 0 ELSE waited + pause END,
    CASE WHEN NOT large AND fits THEN list_append(kept, {{'asked': t, 'tokens': used}}) ELSE kept END, CASE WHEN heard THEN t + took ELSE server_at END, CASE WHEN heard THEN remaining ELSE server_left END,
    CASE WHEN heard THEN t + took + reset_ms ELSE resets END, CASE WHEN large OR fits THEN qid END, CASE WHEN large THEN 'too_large' WHEN fits THEN 'admitted' END, asked,
    CASE WHEN NOT large AND fits THEN t END, CASE WHEN large THEN 0 ELSE waited END, CASE WHEN NOT large AND fits THEN charged END
  FROM (
    SELECT *, NOT large AND reserve <= least(room, coalesce(theirs, room)) AS fits, fits AND remaining IS NOT NULL AS heard,
      greatest(250, CASE WHEN theirs < room THEN resets ELSE coalesce(kept[1].asked + {LEDGER_WINDOW}, t) END - t) AS pause
    FROM (
      SELECT *, coalesce(list_sum(list_transform(kept, lambda c: c.tokens)), 0) AS charged, {LEDGER_LIMIT} - charged AS room,
        CASE WHEN resets > t THEN server_left - coalesce(list_sum(list_transform(list_filter(kept, lambda c: c.asked > server_at), lambda c: c.tokens)), 0) END AS theirs
      FROM (
        SELECT r.key, r.n, r.free, r.wakes, r.waited, r.server_at, r.server_left, r.resets, q.id AS qid, q.asked, q.reserve, q.took, q.used, q.remaining, q.reset_ms, q.reserve > {LEDGER_LIMIT} AS large,
          greatest(r.free, q.asked, coalesce(r.wakes, 0)) AS t, list_filter(r.led, lambda c: c.asked > greatest(r.free, q.asked, coalesce(r.wakes, 0)) - {LEDGER_WINDOW}) AS kept
        FROM r JOIN q ON q.key = r.key AND q.n = r.n
      )
    )
  )
)
SELECT key, id, verdict, asked_ms, started_ms, waited_ms, CAST(used_before AS BIGINT) AS used_before FROM r WHERE verdict IS NOT NULL
"""


@query(LEDGER_SQL)
def token_ledger(spark, sf_dir):
    """Events as requests of users to a provider: who starts when, charged before and corrected after."""
    k = F.get_json_object("props", "$.k").cast("long")
    reserve = (200 + 20 * F.floor("value")).cast("long")
    requests = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), reserve.alias("reserve"), ((k + 1) * 60_000).alias("took_ms"),
        F.when(k % 2 == 0, F.floor(reserve / 2)).otherwise(reserve).alias("used"), F.when(k % 10 == 3, k * 20).alias("remaining"), (k * 600_000).alias("reset_ms"),
    )
    return ledger.replay(requests, LEDGER_LIMIT, LEDGER_WINDOW)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_decisions(spark, sf_dir)
