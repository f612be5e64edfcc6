"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html, langid, mixing, pii, quality, records, repair, sharding, simhash, trie, vectors
from .common import table


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's file is: in TOKENIZERS_DIR, or beside the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, radius=2)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(4)) == 2, F.lit(False))
    dictionaries = langid.learn(docs, ~held_out)
    return langid.identify(spark, docs, dictionaries, carry={"held_out": held_out})


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.grafted_prefixes(table(spark, sf_dir, "conversations"), every=5, most=8)


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_mixing, op3_simhash, op4_pii, op5_language, op6_quality, op7_fingerprint, op8_records, op9_bpe, op10_html, op11_prefix_trie, op12_embeddings, op13_repair)
    return {f.__name__: f for f in (*ops, pipeline)}


#: DuckDB has no XXH64, zstandard, BPE or HTML parser: the other queries are tested against brute force.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, t, words, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(regexp_extract_all(t, '\p{L}+')) AS n_letter_runs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w
), g AS (
  SELECT doc_id, unnest(range(1, n_words - 1)) AS i, words FROM m WHERE n_words >= 3
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id
), x AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, n_letter_runs,
    coalesce(r.n, 0) AS n_repeat_words
  FROM m LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR n_symbols * 100 > word_chars * 5 OR n_dup_lines * 100 > n_lines * 50
    OR n_letter_runs * 100 < n_words * 50 OR n_repeat_words * 100 > n_words * 50) AS kept
FROM x
"""




def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB SQL: each byte, then each of its bits, folded in."""
    step = "list_reduce([xor(acc, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all({text}, '.'), lambda q: CAST(ord(q) AS BIGINT))), lambda acc, y: {step}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), c AS (
  SELECT conv_id, v, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS b FROM t
), w AS (
  SELECT c.conv_id, list_concat(coalesce(p.v[1:h], []), c.v[h + 1:]) AS v FROM c LEFT JOIN t AS p ON p.conv_id = c.b
), m AS (
  SELECT conv_id, d, v[1:d] AS k, d = len(v) AS ends FROM (SELECT conv_id, v, unnest(range(len(v) + 1)) AS d FROM w)
), n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS e FROM m GROUP BY k, d
), f AS (
  SELECT n.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d].x) END AS own
  FROM n LEFT JOIN (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2) AS kids USING (k, d)
), s AS (
  SELECT k[1:j] AS k, j AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM (SELECT k, n_children, own, unnest(range(d + 1)) AS j FROM f) GROUP BY 1, 2
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN s USING (k, d) LEFT JOIN n AS p ON f.d > 0 AND p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
"""

OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), low AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, low.c AS component_id, e.vec_id = low.c AS kept
FROM embeddings AS e JOIN low USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) AS k USING (vec_id)
"""


def _op13_sql() -> str:
    """Backward over each conversation's rows, each state with its least (cost, edits) and the lines that follow from them."""
    after, kept = (2, 2, 3, 2), ({1: "s", 2: "u"}, {2: "u"}, {3: "a"}, {2: "u"})
    role = ("user", "user", "assistant", "user")
    put = lambda cost, letter, line, to: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {line} || {to}.r}}"
    least = lambda options: f"list_aggregate([{', '.join(options)}], 'min')"
    nl = "chr(10) || "
    step = []
    for s in range(4):
        options = [put(4, "D", "''", f"e{s}")]
        options += [f"CASE WHEN f < 2 AND i0 = '{i}' THEN {put('3 * f', 'K', nl + 'role || chr(58) || text', f'e{to}')} END" for to, i in kept[s].items()]
        options += [f"CASE WHEN f < 2 THEN {put('3 + 3 * f', 'R', nl + chr(39) + role[s] + chr(39) + ' || chr(58) || text', f'e{after[s]}')} END"]
        step.append(f"{least(options)} AS g{s}")
    more = lambda a, b: ", ".join(f"{least([f'{a}{s}', put(3, 'I', nl + chr(39) + role[s] + ':' + chr(39), f'{a}{after[s]}')])} AS {b}{s}" for s in range(4))
    end = lambda c, a, r: f"{{'c': CAST({c} AS BIGINT), 'a': '{a}', 'r': {r}}}"
    line = lambda who: f"chr(10) || '{who}:'"
    ends = [end(0, "", "''"), end(6, "II", line("user") + " || " + line("assistant")), end(3, "I", line("assistant")), end(0, "", "''")]
    return f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || chr(58) || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS x FROM conversations
), w AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN x = 1 THEN '' WHEN x = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE x <> 0
), q AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS z, CASE WHEN role = '' THEN ' ' ELSE role[1:1] END AS i0 FROM w
), k AS (
  SELECT *, CASE WHEN z = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(z, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS why,
    lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS pair FROM q
), u AS (
  SELECT *, CASE why WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS f FROM k
), b AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {', '.join(f'{e} AS e{s}' for s, e in enumerate(ends))} FROM u
  UNION ALL
  SELECT conv_id, i, {', '.join(f'j{s}' for s in range(4))} FROM (SELECT conv_id, i, {more('h', 'j')} FROM (SELECT conv_id, i, {more('g', 'h')} FROM (
    SELECT u.conv_id, u.i, {', '.join(step)} FROM b JOIN u ON u.conv_id IS NOT DISTINCT FROM b.conv_id AND u.i = b.i - 1)))
), s AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE why = 'blank') AS blank,
    count(*) FILTER (WHERE why = 'duplicate') AS duplicate, count(*) FILTER (WHERE why = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM u GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.e0.c, 0) AS cost, coalesce(b.e0.a, '') AS audit, sha256(coalesce(substr(b.e0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_embeddings": OP12_SQL, "op13_repair": _op13_sql()}
