"""Settlement into stored state, whole cycles and the chronological replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import numeric as x
from ratewright.operators import consensus as k
from ratewright.operators import cycle as cy
from ratewright.operators import history as hs
from ratewright.operators import live as lv
from ratewright.operators import quality as ql
from ratewright.operators import replay as rp
from ratewright.operators import served as sv
from ratewright.operators import settle as st
from ratewright.operators import settlement as se
from ratewright.operators.tables import latest_quotes
from ratewright.plans import settle_queries  # noqa: F401  (its SQL fragments are used below)
from ratewright.plans.consensus_queries import frozen
from ratewright.plans.registry import fragment, query, rnd, sql
from ratewright.plans.shapes import as_of, fixtures, history, quotes
from ratewright.session import durable, new_folder
from ratewright.streaming import jobs

#: Contests before this day have made the stored state; those from it on are settled into it.
SETTLE_FROM = "1998-06-01"
#: What settling and replaying read of the frozen consensus.
SCORES = ["fixture_id", "home_expected_score", "away_expected_score", "bookmaker_count"]
#: A team of the contests that has no stored state.
UNKNOWN_TEAM = "NATION_7"


def r(col, n=6):
    return F.round(col, n) + 0.0


def stored_tables(spark, d):
    """(fixtures to settle, kr, state, log): B from plain settlement of earlier contests, the market rating from what their
    quotes implied on average (frozen for every other team), and a log that holds some of the contests, wholly or one side."""
    # Written once: the state, the reasons and the rows to settle all read it.
    f, kr = fixtures(spark, d), durable(frozen(spark, d).select(*SCORES))
    before = st.settle_rows(f, kr).where(F.col("date") < F.lit(SETTLE_FROM).cast("date"))
    strength = x.implied_strength("e_kr", F.lit(c.BASELINE_RATING), "is_home")
    base = before.groupBy("team_id").agg(
        F.round(c.BASELINE_RATING + F.sum(c.SETTLE_K * (F.col("actual_score_s") - F.col("e_kr"))), 4).alias("b_value"), F.round(F.avg(strength), 4).alias("r_market")
    )
    teams = st.team_rows(f).where("competition = 'league'").groupBy("team_id").agg(F.max_by("league", F.struct("date", "fixture_id")).alias("league"))
    state = teams.where(F.col("team_id") != UNKNOWN_TEAM).join(base, "team_id", "left")
    even = F.length("team_id") % 2 == 0
    state = state.select(
        "team_id", "league", F.coalesce("b_value", F.lit(c.BASELINE_RATING)).alias("b_value"), F.lit(5.0).alias("m1_value"), F.lit(2.0).alias("l_value"), "r_market",
        F.when(even, F.round("r_market", 0)).alias("r_market_frozen"), F.when(even, 5.0).alias("m1_locked"), F.coalesce("b_value", F.lit(c.BASELINE_RATING)).alias("published_index"),
        F.lit(0.5).alias("confidence_score"),
    )
    due = f.where(F.col("date") >= F.lit(SETTLE_FROM).cast("date"))
    sides = st.team_rows(due).where((F.col("fixture_id") % 13 == 0) | (F.col("is_home") & (F.col("fixture_id") % 3 == 0)))
    return due, kr, state, sides.select("fixture_id", "team_id", F.lit("v3").alias("oracle_version"))


def settled(spark, d):
    due, kr, state, log = stored_tables(spark, d)
    return se.settle_state(state, log, due, kr, as_of())


fragment(
    "st0",
    ("sides",),
    f"""
    SELECT l.team_id, league, coalesce(b.b_value, 1500.0::DOUBLE) AS b_value, r_market, CASE WHEN length(l.team_id) % 2 = 0 THEN round(r_market, 0) END AS r_frozen FROM (
      SELECT team_id, arg_max(league, (date, fixture_id)) AS league FROM sides WHERE competition = 'league' GROUP BY team_id) l
    LEFT JOIN (SELECT team_id, round(1500.0::DOUBLE + sum(30.0::DOUBLE * (actual_score_s - e_kr)), 4) AS b_value,
                 round(avg(1500.0::DOUBLE + 400.0::DOUBLE * log10(greatest(0.01, least(0.99, e_kr)) / (1 - greatest(0.01, least(0.99, e_kr)))) + CASE WHEN is_home THEN -65.0 ELSE 65.0 END::DOUBLE), 4) AS r_market
               FROM sides WHERE skipped_reason IS NULL AND date < DATE '{SETTLE_FROM}' GROUP BY team_id) b USING (team_id)
    WHERE l.team_id <> '{UNKNOWN_TEAM}'
    """,
)
fragment(
    "stfix",
    ("reasons", "st0"),
    f"""
    SELECT *, hs AND NOT hl AS home_open, vs AND NOT vl AS away_open, CASE
      WHEN status <> 'finished' THEN 'not_finished' WHEN home_goals IS NULL THEN 'unparseable_score' WHEN hl AND vl THEN 'already_settled' WHEN home_expected_score IS NULL THEN 'no_frozen_kr'
      WHEN home_expected_score NOT BETWEEN 0.02 AND 0.98 OR away_expected_score NOT BETWEEN 0.02 AND 0.98 THEN 'ekr_out_of_bounds'
      WHEN NOT hs AND NOT vs OR competition <> 'cup' AND NOT (hs AND vs) THEN 'missing_v3_state' WHEN NOT (hs AND NOT hl) AND NOT (vs AND NOT vl) THEN 'already_settled' END AS why
    FROM (SELECT r.*, fixture_id % 13 = 0 OR fixture_id % 3 = 0 AS hl, fixture_id % 13 = 0 AS vl, h.team_id IS NOT NULL AS hs, v.team_id IS NOT NULL AS vs
          FROM reasons r LEFT JOIN st0 h ON h.team_id = home_team LEFT JOIN st0 v ON v.team_id = away_team WHERE date >= DATE '{SETTLE_FROM}')
    """,
)
fragment(
    "strows",
    ("stfix", "st0", "sides"),
    """
    SELECT s.fixture_id, s.team_id, s.league, s.competition, s.e_kr, s.actual_score_s, s.actual_score_s - s.e_kr AS u, b_value AS b0, row_number() OVER w AS rn,
           CASE WHEN row_number() OVER w = 1 THEN coalesce(r_frozen, r_market) ELSE r_market END AS pull
    FROM stfix f JOIN sides s USING (fixture_id) JOIN st0 t ON t.team_id = s.team_id
    WHERE why IS NULL AND CASE WHEN s.is_home THEN home_open ELSE away_open END WINDOW w AS (PARTITION BY s.team_id ORDER BY s.fixture_id)
    """,
)
fragment(
    "strun(team_id, rn, b_before, delta_b)",
    ("strows",),
    """
    SELECT DISTINCT team_id, 0::BIGINT, b0, 0.0::DOUBLE FROM strows
    UNION ALL
    SELECT v.team_id, v.rn, p.b_before + p.delta_b,
           CASE WHEN u > 0.001 THEN greatest(0.0, 30 * u + CASE WHEN competition = 'cup' OR pull IS NULL THEN 0.0 ELSE 0.08 * (pull - p.b_before - p.delta_b) END)
                WHEN u < -0.001 THEN least(0.0, 30 * u + CASE WHEN competition = 'cup' OR pull IS NULL THEN 0.0 ELSE 0.08 * (pull - p.b_before - p.delta_b) END) ELSE 0.0 END::DOUBLE
    FROM strun p JOIN strows v ON v.team_id = p.team_id AND v.rn = p.rn + 1
    """,
)
fragment(
    "stlog",
    ("strun", "strows"),
    "SELECT v.*, b_before, delta_b, b_before + delta_b AS b_after, CASE WHEN competition = 'cup' OR pull IS NULL THEN 0.0 ELSE 0.08 * (pull - b_before) END::DOUBLE AS gravity FROM strows v JOIN strun USING (team_id, rn)",
)


@query(
    "settle_state",
    sql(
        f"""SELECT t.team_id, {rnd('coalesce(b_after, b_value)', 4)} AS b_value, 5.0::DOUBLE AS m1_value, CASE WHEN rn IS NULL THEN 2.0 ELSE 0.0 END::DOUBLE AS l_value,
                   CASE WHEN rn IS NULL THEN r_frozen END AS r_market_frozen, CASE WHEN rn IS NULL AND r_frozen IS NOT NULL THEN 5.0 END::DOUBLE AS m1_locked,
                   {rnd('CASE WHEN rn IS NULL THEN b_value ELSE b_after + 5 END', 4)} AS published_index, coalesce(fixture_id, -1) AS last_kr_fixture_id, 0.5::DOUBLE AS confidence_score
            FROM st0 t LEFT JOIN (SELECT * FROM stlog QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY rn DESC) = 1) s USING (team_id)""",
        "st0",
        "stlog",
    ),
)
def settle_state(spark, d):
    """The stored state of every team after all contests that can be settled are."""
    return settled(spark, d).state.select(
        "team_id", r("b_value", 4).alias("b_value"), "m1_value", "l_value", "r_market_frozen", "m1_locked", r("published_index", 4).alias("published_index"),
        F.coalesce("last_kr_fixture_id", F.lit(-1)).alias("last_kr_fixture_id"), "confidence_score",
    )


@query(
    "settle_state_log",
    sql(
        f"""SELECT fixture_id, team_id, competition, e_kr, actual_score_s, {rnd('delta_b', 6)} AS delta_b, {rnd('b_before', 6)} AS b_before, {rnd('b_after', 6)} AS b_after,
                   {rnd('gravity', 6)} AS gravity_component FROM stlog""",
        "stlog",
    ),
)
def settle_state_log(spark, d):
    rows = settled(spark, d).log
    return rows.select("fixture_id", "team_id", "competition", "e_kr", "actual_score_s", *[r(n, 6).alias(n) for n in ("delta_b", "b_before", "b_after", "gravity_component")])


@query(
    "settle_state_history",
    sql(
        f"""SELECT team_id AS team, league, fixture_id AS source_fixture_id, {rnd('b_after', 4)} AS b_value, 5.0::DOUBLE AS m1_value, {rnd('b_after + 5', 4)} AS published_index,
                   'settlement_v3' AS publish_reason, competition FROM stlog""",
        "stlog",
    ),
)
def settle_state_history(spark, d):
    rows = settled(spark, d).history
    return rows.select("team", "league", "source_fixture_id", r("b_value", 4).alias("b_value"), "m1_value", r("published_index", 4).alias("published_index"), "publish_reason", "competition")


@query("settle_state_skipped", sql("SELECT fixture_id, league, home_team, away_team, why AS skipped_reason FROM stfix WHERE why IS NOT NULL", "stfix"))
def settle_state_skipped(spark, d):
    return settled(spark, d).skipped


@query("settle_state_twice", sql("SELECT 'not settled again' AS outcome, 0::BIGINT AS log_rows, count(*) AS skipped FROM stfix", "stfix"))
def settle_state_twice(spark, d):
    """Settled again with the log of the first run: nothing is left to settle."""
    due, kr, state, log = stored_tables(spark, d)
    once = se.settle_state(state, log, due, kr, as_of())
    again = se.settle_state(once.state, log.unionByName(once.log.select(*log.columns)), due, kr, as_of())
    both = again.skipped.select(F.lit(0).alias("log"), F.lit(1).alias("skip")).union(again.log.select(F.lit(1), F.lit(0)))
    return both.agg(F.lit("not settled again").alias("outcome"), F.sum("log").alias("log_rows"), F.sum("skip").alias("skipped"))


# --- whole cycles ------------------------------------------------------------------

#: When the cycles run; each takes the results of all days before.
CYCLES = ["1998-06-01 18:00:00", "2000-06-01 18:00:00"]


def cycle_root(spark, d):
    """Run the cycles over a stream of clock ticks, one a batch; the folder their tables are in."""
    f, kr, q = durable(fixtures(spark, d)), durable(frozen(spark, d)), durable(quotes(spark, d))
    teams = st.team_rows(f).where("competition = 'league'").groupBy("team_id").agg(F.max_by("league", F.struct("date", "fixture_id")).alias("league"))
    seed = durable(cy.fresh_state(teams.withColumn("b_value", F.lit(c.BASELINE_RATING))))
    nothing = spark.createDataFrame([], "fixture_id long, team_id string, oracle_version string, date date")
    root, ticks = new_folder(spark, "cycles"), new_folder(spark, "cycle-ticks")

    def step(batch, number):
        now = F.lit(str(batch.agg(F.max("at")).first()[0])).cast("timestamp_ntz")
        state, recent = (cy.committed(spark, root, number - 1, n) for n in ("state", "recent")) if number else (seed, nothing)
        cy.commit(root, number, cy.run_cycle(state, recent, cy.as_known(f, now), kr, q, now), now)

    for at in CYCLES:
        spark.range(1).select(F.lit(at).cast("timestamp_ntz").alias("at")).write.mode("append").parquet(ticks)
        jobs.cycle(spark.readStream.schema("at timestamp_ntz").parquet(ticks), step, root=root)
    return root


def _cycle_sql(i: int, at: str) -> None:
    """One cycle as fragments: settlement, solve, overlay and locks, from the state fragment of the cycle before."""
    day, before = f"DATE '{at[:10]}'", f"DATE '{CYCLES[i - 2][:10]}'" if i > 1 else "DATE '0001-01-01'"
    fragment(f"cf{i}", ("fixtures",), f"SELECT * EXCLUDE (status), CASE WHEN status = 'finished' AND date >= {day} THEN 'upcoming' ELSE status END AS status FROM fixtures")
    fragment(
        f"cq{i}",
        ("starts", "quotes"),
        f"""SELECT * EXCLUDE (rn) FROM (SELECT q.*, row_number() OVER (PARTITION BY q.fixture_id, q.bookmaker ORDER BY q.snapshot_time DESC, q.home_odds DESC, q.draw_odds DESC, q.away_odds DESC) AS rn
            FROM quotes q JOIN starts s USING (fixture_id) WHERE q.snapshot_time < s.kickoff AND q.snapshot_time <= TIMESTAMP '{at}' AND s.date >= {day} - 45 AND least(q.home_odds, q.draw_odds, q.away_odds) >= 1.01) WHERE rn = 1""",
    )
    fragment(
        f"cb{i}(fixture_id, bookmaker, h, d, a, lo, hi, i)",
        (f"cq{i}",),
        f"""SELECT fixture_id, bookmaker, 1 / home_odds, 1 / draw_odds, 1 / away_odds, 0.01::DOUBLE, 10.0::DOUBLE, 0 FROM cq{i} UNION ALL
            SELECT fixture_id, bookmaker, h, d, a, CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
                   CASE WHEN pow(h, (lo + hi) / 2) + pow(d, (lo + hi) / 2) + pow(a, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM cb{i} WHERE i < 50""",
    )
    fragment(
        f"ce{i}",
        (f"cb{i}",),
        f"""SELECT fixture_id, greatest(0.01, least(0.99, (mh + 0.5 * md) / (mh + md + ma))) AS home_es FROM (
              SELECT fixture_id, median(p_home) AS mh, median(p_draw) AS md, median(p_away) AS ma FROM (
                SELECT fixture_id, CASE WHEN ok THEN pow(h, k) ELSE h / (h + d + a) END AS p_home, CASE WHEN ok THEN pow(d, k) ELSE d / (h + d + a) END AS p_draw, CASE WHEN ok THEN pow(a, k) ELSE a / (h + d + a) END AS p_away
                FROM (SELECT *, (lo + hi) / 2 AS k, pow(h, 0.01) + pow(d, 0.01) + pow(a, 0.01) >= 1 AND pow(h, 10) + pow(d, 10) + pow(a, 10) <= 1 AS ok FROM cb{i} WHERE i = 50))
              WHERE p_home > 0 AND p_home < 1 AND p_draw > 0 AND p_draw < 1 AND p_away > 0 AND p_away < 1 GROUP BY fixture_id HAVING count(*) >= 2)""",
    )
    if i == 1:
        fragment("cs0", ("sides",), "SELECT team_id, arg_max(league, (date, fixture_id)) AS league, 1500.0::DOUBLE AS b, 0.0::DOUBLE AS m1, NULL::DOUBLE AS market, NULL::DOUBLE AS frozen, NULL::DOUBLE AS locked FROM sides WHERE competition = 'league' GROUP BY team_id")
    fragment(
        f"cr{i}",
        ("sides", f"cs{i - 1}"),
        f"""SELECT s.fixture_id, s.team_id, s.league, s.competition, s.actual_score_s - s.e_kr AS u, t.b AS b0, row_number() OVER w AS rn, CASE WHEN row_number() OVER w = 1 THEN coalesce(frozen, market) ELSE market END AS pull
            FROM sides s JOIN cs{i - 1} t USING (team_id) WHERE skipped_reason IS NULL AND date < {day} AND date >= {before} WINDOW w AS (PARTITION BY s.team_id ORDER BY s.fixture_id)""",
    )
    fragment(
        f"cl{i}(team_id, rn, b)",
        (f"cr{i}",),
        f"""SELECT DISTINCT team_id, 0::BIGINT, b0 FROM cr{i} UNION ALL
            SELECT v.team_id, v.rn, p.b + CASE WHEN u > 0.001 THEN greatest(0.0, 30 * u + CASE WHEN competition = 'cup' OR pull IS NULL THEN 0.0 ELSE 0.08 * (pull - p.b) END)
                                               WHEN u < -0.001 THEN least(0.0, 30 * u + CASE WHEN competition = 'cup' OR pull IS NULL THEN 0.0 ELSE 0.08 * (pull - p.b) END) ELSE 0.0 END::DOUBLE
            FROM cl{i} p JOIN cr{i} v ON v.team_id = p.team_id AND v.rn = p.rn + 1""",
    )
    fragment(
        f"ct{i}",
        (f"cl{i}", f"cs{i - 1}"),
        f"""SELECT t.* EXCLUDE (b, frozen, locked), round(coalesce(n.b, t.b), 4) AS b, CASE WHEN n.b IS NULL THEN frozen END AS frozen, CASE WHEN n.b IS NULL THEN locked END AS locked
            FROM cs{i - 1} t LEFT JOIN (SELECT team_id, arg_max(b, rn) AS b FROM cl{i} GROUP BY 1) n USING (team_id)""",
    )
    fragment(
        f"cd{i}",
        (f"cf{i}", f"ce{i}", "kr", f"cr{i}"),
        f"""SELECT *, CASE WHEN ahead THEN 1 / (1 + greatest(0.0, -age) / 7) ELSE 1 / (1 + greatest(0.0, age) / 14) END::DOUBLE AS weight FROM (
              SELECT f.fixture_id, f.league, home_team, away_team, ahead, (epoch_us(TIMESTAMP '{at}') - epoch_us(coalesce(f.commence_time, CAST(f.date AS TIMESTAMP) + INTERVAL 12 HOURS))) / 8.64e10 AS age,
                     CASE WHEN ahead THEN e.home_es ELSE coalesce(kr.home_expected_score, e.home_es) END AS home_es
              FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY league) < 5 AND count(*) FILTER (wide) OVER (PARTITION BY league) > count(*) FILTER (near) OVER (PARTITION BY league) AS expand
                    FROM (SELECT *, status = 'finished' AND date BETWEEN {day} - 30 AND {day} AS near, status = 'finished' AND date BETWEEN {day} - 45 AND {day} AS wide, status = 'upcoming' AND date BETWEEN {day} AND {day} + 30 AS ahead
                          FROM cf{i} WHERE competition <> 'cup' AND league IN (SELECT league FROM cr{i} WHERE competition <> 'cup')) WHERE wide OR ahead) f
              LEFT JOIN kr USING (fixture_id) LEFT JOIN ce{i} e USING (fixture_id) WHERE ahead OR near OR expand) WHERE home_es IS NOT NULL""",
    )
    fragment(f"cp{i}", (f"cd{i}",), f"SELECT league, home_team, away_team, sum(weight) AS w, sum(weight * home_es) AS ws FROM cd{i} GROUP BY ALL")
    fragment(
        f"cn{i}",
        (f"cd{i}", f"ct{i}"),
        f"""SELECT e.league, e.team, coalesce(t.b, 1500.0) AS mu, CASE WHEN e.n < 5 THEN 200.0 ELSE 300.0 END::DOUBLE AS sigma
            FROM (SELECT DISTINCT league, unnest([home_team, away_team]) AS team, n FROM cd{i} JOIN (SELECT league, count(*) AS n FROM cd{i} GROUP BY 1) USING (league)) e LEFT JOIN ct{i} t ON t.team_id = e.team WHERE e.n > 2""",
    )
    fragment(
        f"ca{i}(i, league, team, r)",
        (f"cp{i}", f"cn{i}"),
        f"""SELECT 0, league, team, mu FROM cn{i} UNION ALL
            SELECT g.i + 1, g.league, g.team, g.r + 0.7 * (sum(g.pull) * ln(10) / 400 - (g.r - n.mu) / (n.sigma * n.sigma)) / (sum(g.bend) * pow(ln(10) / 400, 2) + 1 / (n.sigma * n.sigma))
            FROM (SELECT a.i, a.league, a.team, a.r, CASE WHEN p.home_team = a.team THEN 1 ELSE -1 END * (ws - w / (1 + pow(10, -(h.r - v.r + 65) / 400))) AS pull,
                         w / (1 + pow(10, -(h.r - v.r + 65) / 400)) * (1 - 1 / (1 + pow(10, -(h.r - v.r + 65) / 400))) AS bend
                  FROM ca{i} a JOIN cp{i} p ON p.league = a.league AND a.team IN (p.home_team, p.away_team) JOIN ca{i} h ON h.league = p.league AND h.team = p.home_team
                  JOIN ca{i} v ON v.league = p.league AND v.team = p.away_team WHERE a.i < 400) g
            JOIN cn{i} n USING (league, team) GROUP BY g.i, g.league, g.team, g.r, n.mu, n.sigma""",
    )
    fragment(
        f"cx{i}",
        (f"cf{i}", f"ce{i}"),
        f"""SELECT team_id, opponent, is_home, home_es FROM (
              SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY date, commence_time NULLS FIRST, fixture_id) AS rn FROM (
                SELECT fixture_id, date, commence_time, unnest([home_team, away_team]) AS team_id, unnest([away_team, home_team]) AS opponent, unnest([true, false]) AS is_home FROM cf{i}
                WHERE status = 'upcoming' AND date >= {day} AND competition = 'league')) JOIN ce{i} USING (fixture_id) WHERE rn = 1""",
    )
    fragment(
        f"co{i}",
        (f"ca{i}", f"cx{i}", f"ct{i}"),
        f"""SELECT s.team AS team_id, round(s.r, 4) AS network, round(0.85 * round(s.r, 4) + 0.15 * coalesce(CASE WHEN x.home_es IS NOT NULL THEN round(o.r, 4) + 400 * log10(e / (1 - e)) + CASE WHEN x.is_home THEN -65 ELSE 65 END END, round(s.r, 4)), 4) AS market
            FROM (SELECT * FROM ca{i} WHERE i = 400) s LEFT JOIN (SELECT *, greatest(0.01, least(0.99, CASE WHEN is_home THEN home_es ELSE 1 - home_es END)) AS e FROM cx{i}) x ON x.team_id = s.team
            LEFT JOIN (SELECT * FROM ca{i} WHERE i = 400) o ON o.team = x.opponent""",
    )
    fragment(
        f"cs{i}",
        (f"ct{i}", f"co{i}", f"cf{i}"),
        f"""SELECT team_id, league, b, m1, network, market, CASE WHEN live AND locked IS NULL THEN m1 ELSE locked END AS locked,
                   CASE WHEN live AND locked IS NULL THEN coalesce(market, b + m1) ELSE frozen END AS frozen, CASE WHEN was THEN NULL ELSE round(b + m1, 4) END AS published
            FROM (SELECT t.team_id, t.league, t.b, o.network, coalesce(o.market, t.market) AS market, t.frozen, t.locked, t.locked IS NOT NULL OR t.frozen IS NOT NULL AS was,
                         CASE WHEN o.market IS NOT NULL THEN round(greatest(-120.0, least(120.0, 0.4 * (o.market - t.b))), 4)::DOUBLE ELSE t.m1 END AS m1,
                         t.team_id IN (SELECT unnest([home_team, away_team]) FROM cf{i} WHERE commence_time < TIMESTAMP '{at}' AND commence_time > TIMESTAMP '{at}' - INTERVAL 4 HOURS AND status NOT IN ('finished', 'cancelled')) AS live
                  FROM ct{i} t LEFT JOIN co{i} o USING (team_id))""",
    )


for _i, _at in enumerate(CYCLES, 1):
    _cycle_sql(_i, _at)


@query(
    "cycle_full",
    sql(
        f"""SELECT team_id, {rnd('b', 2)} AS b_value, {rnd('network', 1)} AS r_network, {rnd('market', 1)} AS r_market, {rnd('m1', 1)} AS m1_value, {rnd('locked', 1)} AS m1_locked, {rnd('frozen', 1)} AS r_market_frozen
            FROM cs{len(CYCLES)}""",
        f"cs{len(CYCLES)}",
    ),
)
def cycle_full(spark, d):
    """The stored state after the last of the whole cycles, each of which went on from the one before."""
    state = cy.committed(spark, cycle_root(spark, d), len(CYCLES) - 1, "state")
    return state.select("team_id", r("b_value", 2).alias("b_value"), *[r(n, 1).alias(n) for n in ("r_network", "r_market", "m1_value", "m1_locked", "r_market_frozen")])


@query(
    "cycle_log",
    sql(" UNION ALL ".join(f"SELECT fixture_id, team_id, {i - 1} AS batch, CAST(floor(l.b) AS BIGINT) AS b_floor FROM cl{i} l JOIN cr{i} USING (team_id, rn)" for i in range(1, len(CYCLES) + 1)), *[f"cl{i}" for i in range(1, len(CYCLES) + 1)]),
)
def cycle_log(spark, d):
    """What each cycle settled: every contest once."""
    return spark.read.parquet(f"{cycle_root(spark, d)}/log").select("fixture_id", "team_id", "batch", F.floor("b_after").alias("b_floor"))



def solve_record(spark, d):
    root = cycle_root(spark, d)
    solves, edges = (spark.read.parquet(f"{root}/{n}") for n in ("solves", "edges"))
    return sv.latest_solves(solves, edges, 8)


@query(
    "latest_solves",
    sql(
        f"""SELECT league, solve_timestamp, team, {rnd('rating', 1)} AS rating, {rnd('prior', 2)} AS prior, fixtures, first_fixture, sigma AS sigma_prior FROM (
              SELECT *, dense_rank() OVER (ORDER BY solve_timestamp DESC, league) AS place FROM ({' UNION ALL '.join(
                f"SELECT n.league, TIMESTAMP '{at}' AS solve_timestamp, n.team, r AS rating, mu AS prior, fixtures, first_fixture, sigma FROM cn{i} n JOIN (SELECT * FROM ca{i} WHERE i = 400) a USING (league, team) JOIN (SELECT league, count(*) AS fixtures, min(fixture_id) AS first_fixture FROM cd{i} GROUP BY 1) USING (league)"
                for i, at in enumerate(CYCLES, 1))}))
            WHERE place <= 8""",
        *[f"ca{i}" for i in range(1, len(CYCLES) + 1)],
    ),
)
def latest_solves(spark, d):
    """The newest solves of the cycles with their ratings, priors and fixtures, a row per team."""
    rows = solve_record(spark, d).select("league", "solve_timestamp", "prior_means", F.size("fixtures_detail").cast("long").alias("fixtures"), F.col("fixtures_detail")[0]["fixture_id"].alias("first_fixture"), "sigma_prior", F.explode("ratings").alias("team", "rating"))
    return rows.select("league", "solve_timestamp", "team", r("rating", 1).alias("rating"), r(F.col("prior_means")[F.col("team")], 2).alias("prior"), "fixtures", "first_fixture", "sigma_prior")


@query("solve_iterations")
def solve_iterations(spark, d):
    """Solves of the cycles: how many, the newest, mean iterations, not converged."""
    return sv.solve_stats(solve_record(spark, d))


# --- chronological replay ---------------------------------------------------------------


def replayed(spark, d, every):
    f, kr, q = fixtures(spark, d), durable(frozen(spark, d).select(*SCORES)), quotes(spark, d)
    pre = k.pre_kickoff(q, f).where(F.least(*k.ODDS) >= 1.01)
    current = durable(k.current_expected(latest_quotes(pre)).select("fixture_id", "home_es"))
    teams = st.team_rows(f).where("competition = 'league'").groupBy("team_id").agg(F.max_by("league", F.struct("date", "fixture_id")).alias("league"))
    state = durable(teams.withColumn("b_value", F.lit(c.BASELINE_RATING)))
    return rp.replay(durable(f), kr, current, state, every)


@query("replay")
def replay(spark, d):
    """All settlements in time order with a solve of the affected leagues after every ten: the state at the end."""
    out = replayed(spark, d, 10)
    n = out["log"].groupBy("team_id").agg(F.count(F.lit(1)).alias("settled"))
    return out["state"].join(n, "team_id", "left").select("team_id", "league", r("b_value", 4).alias("b_value"), r("published_index", 2).alias("published_index"), "settled")


@query(
    "replay_steps",
    sql(
        """SELECT step, league, count(*) AS sides, count(DISTINCT fixture_id) AS contests FROM (
             SELECT s.fixture_id, t.league, f.step FROM sides s JOIN cs0 t USING (team_id)
             JOIN (SELECT fixture_id, (row_number() OVER (ORDER BY date, commence_time NULLS FIRST, fixture_id) - 1) // 10 AS step FROM reasons WHERE skipped_reason IS NULL) f USING (fixture_id))
           GROUP BY ALL""",
        "cs0",
        "reasons",
    ),
)
def replay_steps(spark, d):
    """How many sides each league settles in each step of the replay."""
    return replayed(spark, d, 10)["log"].groupBy("step", "league").agg(F.count(F.lit(1)).alias("sides"), F.countDistinct("fixture_id").alias("contests"))


@query("replay_days")
def replay_days(spark, d):
    """The replay by days: every solve and refresh of every team."""
    rows = replayed(spark, d, None)["history"]
    return rows.select("step", "league", "team_id", r("b_value", 4).alias("b_value"), r("r_market", 2).alias("r_market"), r("published_index", 2).alias("published_index"))


# --- trailing mean prices and their feedback -----------------------------------------------

#: Days between the price points of the test tables and the contests' as-of time.
POINTS_LAG = 9374
WINDOW_HOURS = 36
FEEDBACK_AT = "1998-06-01 15:00:00"


def price_points(spark, d):
    """Traded prices as if at the contests' time, a nation's from the users that fall to it."""
    number = F.regexp_extract("team", "([0-9]+)$", 1).cast("long") % 25
    shifted = F.col("ts") - F.make_interval(days=F.lit(POINTS_LAG))
    return history(spark, d).select(F.concat(F.lit("NATION_"), number.cast("string")).alias("team"), shifted.alias("ts"), "event_id", "price")


fragment("pricepoints", ("history",), f"SELECT 'NATION_' || CAST(CAST(substr(team, 6) AS BIGINT) % 25 AS VARCHAR) AS team, ts - INTERVAL {POINTS_LAG} DAYS AS ts, event_id, price FROM history")
fragment("pricesteps", ("pricepoints",), "SELECT team, ts AS a, coalesce(lead(ts) OVER (PARTITION BY team ORDER BY ts, event_id), TIMESTAMP '9999-01-01') AS z, price FROM pricepoints")


def _trailing_sql(requests: str) -> str:
    return f"""
    SELECT team, asked_at, n AS points, sum(price * (epoch_us(least(z, asked_at)) - epoch_us(greatest(a, asked_at - INTERVAL {WINDOW_HOURS} HOURS)))) / sum(epoch_us(least(z, asked_at)) - epoch_us(greatest(a, asked_at - INTERVAL {WINDOW_HOURS} HOURS))) AS twap_price
    FROM {requests} r JOIN pricesteps s USING (team)
    JOIN (SELECT team, asked_at, count(*) AS n FROM {requests} JOIN pricepoints USING (team) WHERE ts BETWEEN asked_at - INTERVAL {WINDOW_HOURS} HOURS AND asked_at GROUP BY ALL) c USING (team, asked_at)
    WHERE least(z, asked_at) > greatest(a, asked_at - INTERVAL {WINDOW_HOURS} HOURS) AND n >= 3 GROUP BY ALL"""


@query(
    "twap_trailing",
    sql(
        f"SELECT team, asked_at, points, {rnd('twap_price', 5)} AS twap_price, {rnd('twap_price * 5 + 800', 4)} AS twap_index FROM ({_trailing_sql('(SELECT DISTINCT team, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOURS AS asked_at FROM pricepoints)')})",
        "pricesteps",
    ),
)
def twap_trailing(spark, d):
    """At noon of each day with a price, the mean over the hours before, the price that came into the window included."""
    points = price_points(spark, d)
    asked = points.select("team", (F.date_trunc("DAY", "ts") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("at"))
    out = hs.twap_at(points, asked, WINDOW_HOURS * 3600)
    return out.select("team", F.col("at").alias("asked_at"), "points", r("twap_price", 5).alias("twap_price"), r("twap_index", 4).alias("twap_index"))


fragment(
    "fbstate",
    ("st0", "starts"),
    f"""
    SELECT s.team_id, b_value, coalesce(r_market, b_value) - b_value AS m1, 1.5::DOUBLE AS l, CASE WHEN length(s.team_id) % 2 = 0 THEN 2.5 END::DOUBLE AS locked, kick, live IS NOT NULL AS live
    FROM st0 s LEFT JOIN (SELECT team_id, min(commence_time) AS kick FROM (SELECT unnest([home_team, away_team]) AS team_id, commence_time FROM starts WHERE status = 'upcoming' AND commence_time >= TIMESTAMP '{FEEDBACK_AT}' - INTERVAL 3 HOURS) GROUP BY 1) USING (team_id)
    LEFT JOIN (SELECT DISTINCT unnest([home_team, away_team]) AS team_id, TRUE AS live FROM starts WHERE commence_time < TIMESTAMP '{FEEDBACK_AT}' AND commence_time > TIMESTAMP '{FEEDBACK_AT}' - INTERVAL 4 HOURS AND status NOT IN ('finished', 'cancelled')) USING (team_id)
    """,
)
fragment("fbtwap", ("pricesteps",), _trailing_sql(f"(SELECT team, TIMESTAMP '{FEEDBACK_AT}' AS asked_at FROM pricepoints WHERE team <> 'NATION_3' GROUP BY team)"))


@query(
    "feedback_pass",
    sql(
        f"""SELECT team_id, regime, CASE WHEN f <> 0 THEN {rnd('f', 3)} WHEN abs(b_value - naive) > 0.01 THEN 0.0 ELSE 7.0 END::DOUBLE AS f_value,
                   CASE WHEN f <> 0 THEN {rnd('naive + f', 3)} WHEN abs(b_value - naive) > 0.01 THEN {rnd('naive', 3)} ELSE {rnd('b_value', 3)} END AS published_index
            FROM (SELECT *, CASE WHEN twap_price IS NULL THEN 0.0 ELSE greatest(-20.0, least(20.0, CASE regime WHEN 'live' THEN 0.15 WHEN 'prematch' THEN 0.10 ELSE 0.05 END * (twap_price * 5 + 800 - naive))) END::DOUBLE AS f FROM (
              SELECT s.*, twap_price, b_value + CASE WHEN live THEN coalesce(locked, 0.0) ELSE m1 END + l AS naive, CASE WHEN live THEN 'live' WHEN kick IS NULL THEN 'offseason'
                     WHEN kick > TIMESTAMP '{FEEDBACK_AT}' AND kick <= TIMESTAMP '{FEEDBACK_AT}' + INTERVAL 3 HOURS THEN 'prematch' ELSE 'between' END AS regime
              FROM fbstate s LEFT JOIN fbtwap w ON w.team = s.team_id))""",
        "fbstate",
        "fbtwap",
    ),
)
def feedback_pass(spark, d):
    """F from trailing prices into the stored index, by regimes of the fixtures; one team has no price and gets its stale F taken back."""
    _, _, state, _ = stored_tables(spark, d)
    even = F.length("team_id") % 2 == 0
    state = state.select(
        "team_id", "b_value", (F.coalesce("r_market", "b_value") - F.col("b_value")).alias("m1_value"), F.lit(1.5).alias("l_value"), F.when(even, 2.5).alias("m1_locked"), F.lit(7.0).alias("f_value"), F.col("b_value").alias("published_index")
    )
    at = F.lit(FEEDBACK_AT).cast("timestamp_ntz")
    points = price_points(spark, d).where("team <> 'NATION_3'")
    twap = hs.twap_at(points, points.select("team", at.alias("at")).distinct(), WINDOW_HOURS * 3600).select(F.col("team").alias("team_id"), "twap_index")
    # Contests of long ago that never began are not a team's next ones.
    f = fixtures(spark, d)
    f = f.where((F.col("status") != "upcoming") | (F.col("commence_time") >= at - F.expr("INTERVAL 3 HOURS")))
    out = lv.feedback_pass(state, twap, f, ql.live_teams(fixtures(spark, d), at), at)
    return out.select("team_id", "regime", r("f_value", 3).alias("f_value"), r("published_index", 3).alias("published_index"))
