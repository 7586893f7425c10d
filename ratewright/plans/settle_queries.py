"""Settlement in its three generations, and what is left to settle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators import settle as st
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.shapes import fixtures


def r(col, n=6):
    return F.round(col, n)


def log_inputs(spark, d):
    """Settleable team rows with gravity target and weight."""
    rows = st.settle_rows(fixtures(spark, d), frozen(spark, d))
    return rows.withColumns(
        {
            "surprise": F.col("actual_score_s") - F.col("e_kr"),
            "target": x.implied_strength("e_kr", F.lit(c.BASELINE_RATING), "is_home"),
            "gamma": F.when(F.col("competition") == "cup", c.GRAVITY_CUP).otherwise(c.GRAVITY_V3),
        }
    )


def log_v3(spark, d):
    return st.settle_v3(log_inputs(spark, d)).withColumn("oracle_version", F.lit("v3"))


fragment(
    "results",
    ("fixtures", "kr"),
    """
    SELECT f.*, k.home_expected_score, k.away_expected_score, k.bookmaker_count,
           TRY_CAST(regexp_extract(score, '^(\\d+)\\s*-\\s*(\\d+)$', 1) AS INTEGER) AS home_goals,
           TRY_CAST(regexp_extract(score, '^(\\d+)\\s*-\\s*(\\d+)$', 2) AS INTEGER) AS away_goals
    FROM fixtures f LEFT JOIN kr k USING (fixture_id)
    """,
)
fragment(
    "reasons",
    ("results",),
    """
    SELECT *, CASE WHEN status <> 'finished' THEN 'not_finished' WHEN home_goals IS NULL THEN 'unparseable_score'
                   WHEN home_expected_score IS NULL THEN 'no_frozen_kr'
                   WHEN home_expected_score NOT BETWEEN 0.02 AND 0.98 OR away_expected_score NOT BETWEEN 0.02 AND 0.98
                   THEN 'ekr_out_of_bounds' END AS skipped_reason
    FROM results
    """,
)
fragment(
    "sides",
    ("reasons",),
    """
    SELECT fixture_id, date, league, competition, score, status, skipped_reason, bookmaker_count, commence_time,
           home_team AS team_id, away_team AS opponent, TRUE AS is_home, home_goals AS own_goals, away_goals AS other_goals,
           home_expected_score AS e_kr,
           CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE AS actual_score_s
    FROM reasons
    UNION ALL
    SELECT fixture_id, date, league, competition, score, status, skipped_reason, bookmaker_count, commence_time,
           away_team, home_team, FALSE, away_goals, home_goals, away_expected_score,
           CASE WHEN away_goals > home_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE
    FROM reasons
    """,
)
fragment(
    "v1log",
    ("sides",),
    """
    SELECT *, coalesce(30.0::DOUBLE * (actual_score_s - e_kr), 0.0::DOUBLE) AS delta_b,
           1500.0::DOUBLE + sum(coalesce(30.0::DOUBLE * (actual_score_s - e_kr), 0.0::DOUBLE)) OVER (
             PARTITION BY team_id ORDER BY date, fixture_id ROWS UNBOUNDED PRECEDING) AS b_after
    FROM sides WHERE skipped_reason IS NULL OR skipped_reason = 'no_frozen_kr'
    """,
)
fragment(
    "v3in",
    ("sides",),
    """
    SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY date, fixture_id) AS rn,
           actual_score_s - e_kr AS u, CASE WHEN competition = 'cup' THEN 0.0 ELSE 0.08 END::DOUBLE AS gamma,
           1500.0::DOUBLE + 400.0::DOUBLE * log10(greatest(0.01, least(0.99, e_kr)) / (1 - greatest(0.01, least(0.99, e_kr))))
             + CASE WHEN is_home THEN -65.0 ELSE 65.0 END::DOUBLE AS target
    FROM sides WHERE skipped_reason IS NULL
    """,
)
fragment(
    "v3run(team_id, rn, b_before, delta_b)",
    ("v3in",),
    """
    SELECT team_id, 0::BIGINT, 1500.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT team_id FROM v3in)
    UNION ALL
    SELECT v.team_id, v.rn, p.b_before + p.delta_b,
           CASE WHEN u > 0.001 THEN greatest(0.0, 30 * u + gamma * (target - p.b_before - p.delta_b))
                WHEN u < -0.001 THEN least(0.0, 30 * u + gamma * (target - p.b_before - p.delta_b)) ELSE 0.0 END::DOUBLE
    FROM v3run p JOIN v3in v ON v.team_id = p.team_id AND v.rn = p.rn + 1
    """,
)
fragment(
    "v3log",
    ("v3run",),
    """
    SELECT v.*, b_before, delta_b, b_before + delta_b AS b_after, gamma * (target - b_before) AS gravity_component,
           CASE WHEN u > 0.001 THEN 30 * u + gamma * (target - b_before) < 0
                WHEN u < -0.001 THEN 30 * u + gamma * (target - b_before) > 0
                ELSE abs(30 * u + gamma * (target - b_before)) > 0.001 END AS clamp_applied
    FROM v3in v JOIN v3run USING (team_id, rn)
    """,
)


@query(
    "team_rows",
    sql(
        """SELECT fixture_id, team_id, opponent, is_home, league, CAST(own_goals AS INTEGER) AS own_goals,
                  CAST(other_goals AS INTEGER) AS other_goals, actual_score_s,
                  CASE WHEN actual_score_s >= 0.9 THEN 'W' WHEN actual_score_s >= 0.4 THEN 'D' ELSE 'L' END AS result,
                  CASE WHEN own_goals > other_goals THEN 3 WHEN own_goals = other_goals THEN 1 ELSE 0 END AS points
           FROM sides WHERE own_goals IS NOT NULL""",
        "sides",
    ),
)
def team_rows(spark, d):
    home, away = tx.goals("score")
    f = fixtures(spark, d).withColumns({"hg": home, "ag": away}).where(F.col("hg").isNotNull())
    rows = st.team_rows(f, {"own_goals": ("hg", "ag"), "other_goals": ("ag", "hg")})
    s = tx.result_score("own_goals", "other_goals")
    return rows.select(
        "fixture_id", "team_id", "opponent", "is_home", "league", "own_goals", "other_goals",
        s.alias("actual_score_s"), tx.result_label(s).alias("result"),
        tx.league_points("own_goals", "other_goals").alias("points"),
    )


@query(
    "settlement_outcomes",
    sql("SELECT league, coalesce(skipped_reason, 'settled') AS outcome, count(*) AS fixtures FROM reasons GROUP BY ALL", "reasons"),
)
def settlement_outcomes(spark, d):
    rows = st.with_results(fixtures(spark, d), frozen(spark, d))
    return rows.groupBy("league", F.coalesce("skipped_reason", F.lit("settled")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("fixtures")
    )


@query(
    "settle_v1",
    sql(
        f"""SELECT fixture_id, team_id, coalesce(e_kr, 0.0::DOUBLE) AS e_kr, actual_score_s, {rnd('delta_b', 6)} AS delta_b,
                   {rnd('b_after - delta_b', 6)} AS b_before, {rnd('b_after', 6)} AS b_after, e_kr IS NULL AS has_error
            FROM v1log""",
        "v1log",
    ),
)
def settle_v1(spark, d):
    rows = st.settle_rows(fixtures(spark, d), frozen(spark, d), (None, "no_frozen_kr"))
    return st.settle_v1(rows).select(
        "fixture_id", "team_id", F.coalesce("e_kr", F.lit(0.0)).alias("e_kr"), "actual_score_s",
        r("delta_b").alias("delta_b"), r("b_before").alias("b_before"), r("b_after").alias("b_after"), "has_error",
    )


@query(
    "settle_v3",
    sql(
        f"""SELECT fixture_id, team_id, e_kr, actual_score_s, competition, {rnd('delta_b', 6)} AS delta_b,
                   {rnd('b_before', 6)} AS b_before, {rnd('b_after', 6)} AS b_after,
                   {rnd('gravity_component', 6)} AS gravity_component, clamp_applied FROM v3log""",
        "v3log",
    ),
)
def settle_v3(spark, d):
    return log_v3(spark, d).select(
        "fixture_id", "team_id", "e_kr", "actual_score_s", "competition", r("delta_b").alias("delta_b"),
        r("b_before").alias("b_before"), r("b_after").alias("b_after"),
        r("gravity_component").alias("gravity_component"), "clamp_applied",
    )


fragment(
    "v2in",
    ("reasons",),
    """
    SELECT *, row_number() OVER (ORDER BY date, fixture_id) AS rn,
           CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE AS s,
           400 * log10(greatest(0.01, least(0.99, home_expected_score)) / (1 - greatest(0.01, least(0.99, home_expected_score)))) - 65 AS xh,
           400 * log10(greatest(0.01, least(0.99, away_expected_score)) / (1 - greatest(0.01, least(0.99, away_expected_score)))) + 65 AS xa
    FROM reasons WHERE skipped_reason IS NULL
    """,
)
fragment(
    "v2run(team, rn, before, b)",
    ("v2in",),
    """
    SELECT DISTINCT team, 0::BIGINT, 1500.0::DOUBLE, 1500.0::DOUBLE
    FROM (SELECT unnest([home_team, away_team]) AS team FROM v2in)
    UNION ALL
    SELECT p.team, f.rn, p.b,
           CASE WHEN p.team = f.home_team THEN p.b + 30 * (s - home_expected_score) + 0.05 * (o.b + xh - p.b)
                WHEN p.team = f.away_team THEN p.b + 30 * (1 - s - away_expected_score) + 0.05 * (o.b + xa - p.b)
                ELSE p.b END::DOUBLE
    FROM v2run p JOIN v2in f ON f.rn = p.rn + 1
    JOIN v2run o ON o.team = CASE WHEN p.team = f.home_team THEN f.away_team
                                                        WHEN p.team = f.away_team THEN f.home_team ELSE p.team END
    """,
)


@query(
    "settle_v2",
    sql(
        f"""SELECT f.fixture_id, f.league, {rnd('h.before', 5)} AS home_b_before, {rnd('a.before', 5)} AS away_b_before,
                   {rnd('h.b - h.before', 5)} AS home_delta_b, {rnd('a.b - a.before', 5)} AS away_delta_b
            FROM v2in f JOIN v2run h ON h.rn = f.rn AND h.team = f.home_team
            JOIN v2run a ON a.rn = f.rn AND a.team = f.away_team""",
        "v2run",
    ),
)
def settle_v2(spark, d):
    rows = st.with_results(fixtures(spark, d), frozen(spark, d)).where(F.col("skipped_reason").isNull())
    rows = rows.select(
        "fixture_id", "date", "league", "home_team", "away_team",
        tx.result_score("home_goals", "away_goals").alias("s_home"),
        F.col("home_expected_score").alias("e_home"), F.col("away_expected_score").alias("e_away"),
    )
    names = ("home_b_before", "away_b_before", "home_delta_b", "away_delta_b")
    return st.settle_v2(rows).select("fixture_id", "league", *[r(n, 5).alias(n) for n in names])


@query(
    "unsettled",
    sql(
        """SELECT fixture_id, league, competition, coalesce(n, 0) AS settled_rows
           FROM fixtures LEFT JOIN (SELECT fixture_id, count(*) AS n FROM sides WHERE skipped_reason IS NULL
                                    AND (competition = 'cup' OR is_home OR bookmaker_count % 2 = 0) GROUP BY 1) USING (fixture_id)
           WHERE status = 'finished' AND coalesce(n, 0) < CASE WHEN competition = 'cup' THEN 1 ELSE 2 END""",
        "fixtures",
        "sides",
    ),
)
def unsettled(spark, d):
    rows = log_inputs(spark, d).withColumn("oracle_version", F.lit("v3"))
    partial = rows.where((F.col("competition") == "cup") | F.col("is_home") | (F.col("bookmaker_count") % 2 == 0))
    return st.unsettled(fixtures(spark, d), partial, "v3").select("fixture_id", "league", "competition", "settled_rows")


@query(
    "append_log",
    sql(
        """SELECT fixture_id, team_id, 'v3' AS oracle_version, e_kr FROM sides
           WHERE skipped_reason IS NULL AND NOT (is_home AND fixture_id % 3 = 0)""",
        "sides",
    ),
)
def append_log(spark, d):
    rows = log_inputs(spark, d).select("fixture_id", "team_id", F.lit("v3").alias("oracle_version"), "e_kr", "is_home")
    already = rows.where(F.col("is_home") & (F.col("fixture_id") % 3 == 0))
    return st.append_log(already, rows).select("fixture_id", "team_id", "oracle_version", "e_kr")


@query("settlement_trace")
def settlement_trace(spark, d):
    traced = st.trace(log_v3(spark, d), frozen(spark, d))
    return traced.select("fixture_id", "team_id", F.to_json("trace_payload").alias("trace_payload"))


@query(
    "settlement_trace_rows",
    sql(
        f"""SELECT l.fixture_id, team_id, 30.0::DOUBLE AS k, gamma, score, {rnd('home_prob', 6)} AS home_prob, {rnd('draw_prob', 6)} AS draw_prob, actual_score_s AS s, e_kr, {rnd('b_before', 5)} AS b_before,
                   {rnd('target', 5)} AS r_market_frozen, {rnd('gravity_component', 5)} AS delta_gravity, clamp_applied, CASE WHEN is_home THEN 'home' ELSE 'away' END AS perspective
            FROM v3log l JOIN kr USING (fixture_id)""",
        "v3log",
        "kr",
    ),
)
def settlement_trace_rows(spark, d):
    """The trace of each settlement, its parts as columns."""
    p, side = F.col("trace_payload"), F.col("trace_payload.settlement_detail")
    rows = st.trace(log_v3(spark, d), frozen(spark, d))
    return rows.select(
        "fixture_id", "team_id", p["K"].alias("k"), p["gamma"].alias("gamma"), p["score"].alias("score"), r(p["consensus"]["home_prob"]).alias("home_prob"), r(p["consensus"]["draw_prob"]).alias("draw_prob"),
        side["S"].alias("s"), side["E_KR"].alias("e_kr"), r(side["B_before"], 5).alias("b_before"), r(side["R_market_frozen"], 5).alias("r_market_frozen"), r(side["delta_gravity"], 5).alias("delta_gravity"),
        side["clamp_applied"].alias("clamp_applied"), p["perspective"].alias("perspective"),
    )
