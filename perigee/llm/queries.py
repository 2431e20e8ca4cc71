"""The thin queries op<N>_<name>: each applies an operator with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import decontaminate, embeddings, langid, lines, lm, packing, quality, simhash, token_counts, urls
from perigee.llm.common import held_out, table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dropped_lines(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "line_no", F.col("kept_id").alias("kept_doc_id"), "kept_line_no", "edits")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, token_counts.redactions)
    return counted.drop("text_after").withColumnRenamed("id", "doc_id")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id").drop("known")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).withColumnRenamed("id", "page_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=("doc_id",))
    return scored.select("doc_id", (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "agreeing", "window")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lines": op1_lines, "op2_simhash": op2_simhash, "op3_token_counts": op3_token_counts, "op4_urls": op4_urls, "op5_language_id": op5_language_id, "op6_packing": op6_packing, "op7_embeddings": op7_embeddings, "op8_quality": op8_quality, "op9_lm_score": op9_lm_score, "op10_decontamination": op10_decontamination}

def _op4_sql(strength: float = 4.0, reject: float = 0.5, least: int = 5, z: float = 1.96, max_children: int = 24, share: float = 0.02) -> str:
    """The tree of `urls.judged` in DuckDB's SQL: a recursion down the paths, one along the places of the templates."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        own, _, below = text.partition("/")
        fits = f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{below}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    shaped = lambda c: rf"concat('*', regexp_extract({c}, '(\.[A-Za-z]{{1,5}})\z', 1))"
    double = lambda x: f"CAST({x} AS DOUBLE)"
    smooth = lambda bad, n, prior: f"(({bad} + {double(strength)} * {prior}) / ({n} + {double(strength)}))"
    ctes = [
        "u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages)",
        f"hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS decided FROM hp)",
        "paths AS (SELECT host, path, count(*) AS n, count(decided) AS known, count(*) FILTER (WHERE decided = 'block') AS bad FROM r GROUP BY host, path)",
        f"walk(host, path, n, rest, template) AS (SELECT host, path, n, CASE WHEN path = '' THEN [] ELSE list_transform(string_split(substr(path, 2), '/'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 40 THEN {shaped('x')} ELSE x END) END, '' FROM paths "
        f"UNION ALL SELECT host, path, n, rest[2:], concat(template, '/', CASE WHEN children > {max_children} AND m < {double(share)} * total AND NOT starts_with(rest[1], '*') THEN {shaped('rest[1]')} ELSE rest[1] END) "
        "FROM (SELECT *, sum(n) OVER (PARTITION BY host, template, rest[1]) AS m, sum(n) OVER (PARTITION BY host, template) AS total, count(DISTINCT rest[1]) OVER (PARTITION BY host, template) AS children FROM walk WHERE len(rest) > 0) w)",
        "named AS (SELECT host, path, template FROM walk WHERE len(rest) = 0)",
        "tree AS (SELECT paths.host, paths.path, known, bad, template FROM paths JOIN named ON paths.host = named.host AND paths.path = named.path)",
        "corpus AS (SELECT CAST(coalesce(sum(bad), 0) AS DOUBLE) / (coalesce(sum(known), 0) + 1) AS x FROM tree)",
        f"hosts AS (SELECT host, {smooth('sum(bad)', 'sum(known)', '(SELECT x FROM corpus)')} AS host_share FROM tree GROUP BY host)",
        "leaves AS (SELECT tree.host, template, any_value(host_share) AS host_share, sum(known) AS known, sum(bad) AS bad FROM tree JOIN hosts ON tree.host = hosts.host GROUP BY tree.host, template)",
        # One row a branch, with the templates in it; step k merges siblings that differ in place k alone.
        f"steps(k, host, branch, templates, host_share, known, bad) AS (SELECT 0, host, template, [template], host_share, known, bad FROM leaves UNION ALL SELECT k, host, CASE WHEN count(*) > 1 THEN concat('/', array_to_string(list_transform(any_value(pieces), lambda p, i: CASE WHEN i = k THEN concat('(', names, ')') ELSE p END), '/')) ELSE any_value(branch) END, "
        "flatten(list(templates)), any_value(host_share), sum(known), sum(bad) FROM (SELECT *, string_agg(piece, '|') OVER (PARTITION BY k, host, family, run ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS names FROM "
        "(SELECT *, sum(apart) OVER (PARTITION BY k, host, family ORDER BY p, piece ROWS UNBOUNDED PRECEDING) AS run FROM "
        f"(SELECT *, CASE WHEN p - lag(p) OVER f > {double(z)} * sqrt(v + lag(v) OVER f) THEN 1 ELSE 0 END AS apart FROM (SELECT *, p * (1 - p) / (known + {double(strength)}) AS v FROM "
        f"(SELECT k + 1 AS k, host, branch, templates, host_share, known, bad, pieces, pieces[k + 1] AS piece, {smooth('bad', 'known', 'host_share')} AS p, CASE WHEN known >= {least} AND len(pieces) > k AND NOT starts_with(pieces[k + 1], '*') "
        "THEN array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i = k + 1 THEN '*' ELSE p END), '/') ELSE concat('/alone/', branch) END AS family "
        "FROM (SELECT *, string_split(substr(branch, 2), '/') AS pieces FROM steps) s0 WHERE k < (SELECT max(len(string_split(substr(template, 2), '/'))) FROM leaves)) s1) s2 WINDOW f AS (PARTITION BY k, host, family ORDER BY p, piece)) s3) s4) s5 GROUP BY k, host, family, run, names)",
        "branches AS (SELECT host, branch, unnest(templates) AS template, host_share, known, bad, regexp_extract(branch, '^(/[^/]*)?', 0) AS head FROM steps WHERE k = (SELECT max(k) FROM steps))",
        f"heads AS (SELECT host, head, {smooth('sum(bad)', 'sum(known)', 'any_value(host_share)')} AS head_share FROM (SELECT DISTINCT host, branch, head, host_share, known, bad FROM branches) b GROUP BY host, head)",
        f"done AS (SELECT b.host, b.template, b.branch, b.known AS mk, {smooth('b.bad', 'b.known', 'head_share')} AS bad_share FROM branches b JOIN heads d ON b.host = d.host AND b.head = d.head)",
    ]
    return (
        f"WITH RECURSIVE {', '.join(ctes)} SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.decided, CASE WHEN d.mk >= {least} AND d.bad_share > {reject} THEN 'block' ELSE 'allow' END) AS verdict, d.branch AS template, CAST(d.bad_share AS DOUBLE) AS bad_share "
        "FROM r JOIN named n ON r.host = n.host AND r.path = n.path JOIN done d ON n.host = d.host AND n.template = d.template"
    )


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id AS d, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS n,
    list_filter(string_split(translate(unnest(string_split(text, chr(10))), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda x: x <> '') AS w
  FROM documents
), places AS (SELECT d, n, w FROM lines WHERE len(w) > 0),
firsts AS (SELECT w, min({'d': d, 'n': n}) AS f FROM places GROUP BY w),
variants AS (
  SELECT w, f, len(w) AS len, 0 AS hole, array_to_string(w, ' ') AS v FROM firsts
  UNION ALL
  SELECT w, f, len(w), i, array_to_string(list_concat(w[1:i - 1], w[i + 1:len(w)]), ' ') FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS i FROM firsts)
), near AS (
  SELECT a.w, min(b.f) AS f FROM variants a JOIN variants b
  ON a.v = b.v AND b.f < a.f AND greatest(a.len, b.len) >= 5
    AND (a.hole = b.hole AND a.hole > 0 AND a.len = b.len OR a.hole = 0 AND b.hole > 0 OR a.hole > 0 AND b.hole = 0)
  GROUP BY a.w
)
SELECT d AS doc_id, n AS line_no, coalesce(near.f, firsts.f).d AS kept_doc_id, coalesce(near.f, firsts.f).n AS kept_line_no,
  CAST(near.f IS NOT NULL AS INTEGER) AS edits
FROM places JOIN firsts USING (w) LEFT JOIN near USING (w)
WHERE near.f IS NOT NULL OR {'d': d, 'n': n} > firsts.f
"""

#: Plain brute force: every placement at which any token agrees, so it depends on no masks. A window that begins at an
#: agreeing token and hangs over the item's end has no more agreeing tokens than the last one inside.
OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS v FROM benchmark
), ds AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
bs AS (SELECT item_id, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS t, least(len(v), {decontaminate.WINDOW}) AS win FROM b),
same AS (SELECT doc_id, item_id, i - j AS start, j, win FROM ds JOIN bs USING (t)),
able AS (SELECT doc_id, item_id, start FROM same GROUP BY doc_id, item_id, start HAVING count(*) >= ceil(min(win) * {decontaminate.SIMILARITY})),
runs AS (
  SELECT doc_id, item_id, start, win, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY j RANGE BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING) AS n
  FROM same SEMI JOIN able USING (doc_id, item_id, start)
)
SELECT doc_id, item_id, CAST(arg_min(start, {{'a': -n, 'b': start}}) AS INTEGER) AS start, CAST(max(n) AS INTEGER) AS agreeing, CAST(max(win) AS INTEGER) AS "window"
FROM runs WHERE n >= ceil(win * {decontaminate.SIMILARITY}) GROUP BY doc_id, item_id
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(x, y) AS (
  SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), names AS (SELECT x, least(x, min(y)) AS name FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(name, vec_id) AS component_id, vec_id = coalesce(name, vec_id) AS kept
FROM v LEFT JOIN names ON names.x = vec_id LEFT JOIN degrees ON degrees.x = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op4_urls": _op4_sql(), "op7_embeddings": OP7_SQL, "op1_lines": OP1_SQL, "op10_decontamination": OP10_SQL}
