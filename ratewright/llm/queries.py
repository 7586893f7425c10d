"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import quality, toxicity
from ratewright.llm.ann import nearest
from ratewright.llm.common import table
from ratewright.llm.filter_audit import audited
from ratewright.llm.html_text import extracted
from ratewright.llm.langid import fit as fit_languages
from ratewright.llm.langid import held_out as language_held_out
from ratewright.llm.langid import identified
from ratewright.llm.mixing import BLOCK, REPEATS, SHARD_BLOCKS, mixed
from ratewright.llm.pq import near_duplicates
from ratewright.llm.segment import sampled
from ratewright.llm.simhash import simhash_classes
from ratewright.llm.substring import without_repeats
from ratewright.llm.subvectors import clustered
from ratewright.llm.tokens import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER () - {REPEATS} * coalesce(sum(source_size) OVER below, 0))::BIGINT)::DOUBLE
    / ((sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::BIGINT) AS level
  FROM weighed WINDOW below AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM levels WHERE level * weight <= {REPEATS} * source_size),
targets AS (
  SELECT source, source_size, coalesce(least((SELECT level FROM level) * weight, ({REPEATS} * source_size)::DOUBLE), 0.0) AS target FROM weighed),
house AS (SELECT round(sum(source_size)::DOUBLE / {BLOCK})::BIGINT AS house FROM targets),
won AS (
  SELECT source FROM targets, house, generate_series(0, house) s(i)
  ORDER BY target / (2 * i + 1) DESC, source ASC NULLS LAST LIMIT (SELECT house FROM house)),
quotas AS (SELECT t.*, (SELECT count(*) FROM won w WHERE w.source IS NOT DISTINCT FROM t.source) AS quota FROM targets t),
placed AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.quota,
    ('0x' || substr(md5('mix shard|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(ceil(q.source_size / {BLOCK * SHARD_BLOCKS}), 1)::BIGINT AS shard,
    ('0x' || substr(md5('mix order|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota FROM placed GROUP BY source, shard),
seated AS (
  SELECT source, shard FROM (
    SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * i + 1) DESC, shard) AS r
    FROM shards, generate_series(0, quota) s(i)) WHERE r <= quota),
blocks AS (
  SELECT s.*, ceil(shard_size / {BLOCK})::BIGINT AS cut,
    least((SELECT count(*) FROM seated x WHERE x.source IS NOT DISTINCT FROM s.source AND x.shard = s.shard), {REPEATS} * ceil(shard_size / {BLOCK}))::BIGINT AS blocks
  FROM shards s),
runs AS (
  SELECT source, shard, cut, CASE WHEN cut > 0 THEN blocks // cut ELSE 0 END AS whole, CASE WHEN cut > 0 THEN blocks % cut ELSE 0 END AS extra,
    CASE WHEN cut > 0 THEN ('0x' || substr(md5('mix start|' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END || '|' || shard), 1, 8))::BIGINT % cut ELSE 0 END AS start
  FROM blocks),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM placed)
SELECT doc_id, l.source, size, source_size, target,
  (whole * size + greatest(least(b, least((start + extra) * {BLOCK}, cut * {BLOCK})) - greatest(b - size, start * {BLOCK}), 0)
   + greatest(least(b, (start + extra - cut) * {BLOCK}) - greatest(b - size, 0), 0))::BIGINT AS taken
FROM laid l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND l.shard = r.shard
"""


@query("op5_source_mix", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s.i AS i, array_to_string(w[s.i : s.i + 12], ' ') AS win FROM worded, generate_series(1, len(w) - 12) s(i)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + j.j AS p FROM windows JOIN firsts USING (win), generate_series(0, 12) j(j) WHERE first < doc_id),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x for x, k in w if not list_contains(ps, k)] END, ' ')) AS kept_sha256
FROM worded d LEFT JOIN per p USING (doc_id)
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.label_grades(table(spark, sf_dir, "labels")))
    tails = F.col("tails")
    return quality.graded(docs, model).select(
        "doc_id", "expected_grade", tails[0].alias("p_good"), F.coalesce(F.try_element_at(tails, F.lit(2)), F.lit(0.0)).alias("p_best"), (tails[0] >= quality.KEEP).alias("kept")
    )


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query("op2_sampled_encodings")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


AUDIT_SQL = r"""
WITH labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
worded AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM worded d LEFT JOIN labelled USING (doc_id)),
kinds AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL),
one(i) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
met AS (
  SELECT k.*, o, s.i AS step, f[o[s.i]] AS fails, len([x for x in o[1:s.i - 1] if f[x]]) > 0 AS gone, len([x for x in f if x]) AS bad
  FROM kinds k, orders, one s),
counted AS (
  SELECT part, o, step, sum(CASE WHEN fails OR gone THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND bad = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, o, step)
SELECT part, array_to_string([substr('ABCDE', x, 1) for x in o], '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM counted
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_language")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit_languages(docs))
    return found.select("doc_id", language_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def _clusters_sql(rounds: int = 3) -> str:
    """Assignments and centroids round by round, a component a row."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""
gap{i} AS (SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM comps JOIN at{i} USING (j) GROUP BY rid, c),
near{i} AS (SELECT rid, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM gap{i} GROUP BY rid)"""
        )
        if i < rounds:
            steps.append(
                f"""
sum{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM near{i} JOIN comps USING (rid) GROUP BY c, j),
at{i + 1} AS (SELECT c, j, CASE WHEN n IS NULL THEN y ELSE (s - (s % n + n) % n) // n END AS y FROM at{i} LEFT JOIN sum{i} USING (c, j))"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
comps AS MATERIALIZED (SELECT rid, s.j, v[s.j] AS x FROM kept, generate_series(1, 64) s(j)),
first AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL),
at0 AS (SELECT c, s.j, v[s.j] AS y FROM first, generate_series(1, 64) s(j) WHERE c < 16),{",".join(steps)},
digest AS (SELECT c, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM at{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (rid) JOIN digest USING (c)
"""


@query("op13_subvector_clusters", _clusters_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
