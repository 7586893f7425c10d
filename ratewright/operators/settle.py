"""Settling finished fixtures into permanent base ratings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ratewright import config as c
from ratewright.functions import numeric as x
from ratewright.functions import text as tx
from ratewright.operators.chains import Clamped
from ratewright.operators.ordered import BLOCK, in_blocks, ordered_scan
from ratewright.session import durable


def team_rows(fixtures: DataFrame, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Two rows per fixture, one per side; ``extra`` maps a new name to its (home, away) source columns."""
    keep = [n for n in fixtures.columns if n not in ("home_team", "away_team")]
    extra = extra or {}
    sides = []
    for own, other, i in (("home_team", "away_team", 0), ("away_team", "home_team", 1)):
        parts = [F.col(own).alias("team_id"), F.col(other).alias("opponent"), F.lit(i == 0).alias("is_home")]
        parts += [F.col(src[i]).alias(name) for name, src in extra.items()]
        sides.append(F.struct(*parts))
    return fixtures.select(*keep, F.inline(F.array(*sides)))


def settlement_reason() -> Column:
    """Why a fixture cannot be settled; null if it can. Needs goals and consensus columns."""
    return (
        F.when(F.col("status") != "finished", "not_finished")
        .when(F.col("home_goals").isNull(), "unparseable_score")
        .when(F.col("home_expected_score").isNull(), "no_frozen_kr")
        .when(~(x.sane_expected("home_expected_score") & x.sane_expected("away_expected_score")), "ekr_out_of_bounds")
    )


def with_results(fixtures: DataFrame, kr: DataFrame) -> DataFrame:
    """Fixtures with goals, frozen expected scores and the skip reason."""
    home, away = tx.goals("score")
    frozen = kr.select("fixture_id", "home_expected_score", "away_expected_score", "bookmaker_count")
    joined = fixtures.withColumns({"home_goals": home, "away_goals": away}).join(frozen, "fixture_id", "left")
    return joined.withColumn("skipped_reason", settlement_reason())


def settle_rows(fixtures: DataFrame, kr: DataFrame, reasons: tuple = (None,)) -> DataFrame:
    """Team rows with score S and expected score of the fixtures whose skip reason is listed."""
    allowed = F.col("skipped_reason").isNull() if None in reasons else F.lit(False)
    named = [n for n in reasons if n]
    if named:
        allowed = allowed | F.col("skipped_reason").isin(*named)
    rows = team_rows(
        with_results(fixtures, kr).where(allowed),
        {
            "own_goals": ("home_goals", "away_goals"),
            "other_goals": ("away_goals", "home_goals"),
            "e_kr": ("home_expected_score", "away_expected_score"),
        },
    )
    return rows.withColumn("actual_score_s", tx.result_score("own_goals", "other_goals"))


def settle_v1(rows: DataFrame, base: float = c.BASELINE_RATING, order=("date", "fixture_id")) -> DataFrame:
    """Plain steps K(S-E): a running sum. A missing consensus settles with no change, and is flagged."""
    step = F.coalesce(c.SETTLE_K * (F.col("actual_score_s") - F.col("e_kr")), F.lit(0.0))
    stepped = rows.withColumns({"delta_b": step, "has_error": F.col("e_kr").isNull()})
    run = ordered_scan(stepped, ["team_id"], list(order), sums={"_sum": F.col("delta_b")})
    return run.withColumns(
        {"b_before": base + F.col("_sum") - F.col("delta_b"), "b_after": base + F.col("_sum")}
    ).drop("_sum")


def unsettled(fixtures: DataFrame, log: DataFrame, version: str, since=None) -> DataFrame:
    """Finished fixtures with fewer log rows than expected: two, or one in a cup."""
    done = fixtures.where(F.col("status") == "finished")
    if since is not None:
        done = done.where(F.col("date") >= since)
    counts = log.where(F.col("oracle_version") == version).groupBy("fixture_id").agg(F.count(F.lit(1)).alias("settled_rows"))
    expected = F.when(F.col("competition") == "cup", 1).otherwise(2)
    joined = done.join(counts, "fixture_id", "left").withColumn("settled_rows", F.coalesce("settled_rows", F.lit(0)))
    return joined.where(F.col("settled_rows") < expected)


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """New log rows only: those whose (fixture, team, version) is not there yet."""
    key = ["fixture_id", "team_id", "oracle_version"]
    return rows.join(log.select(*key), key, "left_anti")


# --- chains whose step depends on the value reached ---------------------------

START = "_start"


def _with_doubles(df: DataFrame, *names: str) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])


def _v3_step(b, s_minus_e, pull_to, gamma):
    raw = c.SETTLE_K * s_minus_e + gamma * (pull_to - b)
    if s_minus_e > c.SURPRISE_EPS:
        return raw if raw > 0.0 else 0.0
    if s_minus_e < -c.SURPRISE_EPS:
        return raw if raw < 0.0 else 0.0
    return 0.0


def _fold_v3(starts: dict, base: float):
    """Walk sorted rows of one block, team after team, in Arrow batches; state is one number."""

    def run(batches):
        team, b = None, base
        for pdf in batches:
            if not len(pdf):
                continue
            block = int(pdf[BLOCK].iloc[0])
            teams, d, r, g, own = (pdf[n].to_numpy() for n in ("team_id", "surprise", "target", "gamma", START))
            before, delta = np.empty(len(pdf)), np.empty(len(pdf))
            for i in range(len(pdf)):
                if teams[i] != team:
                    b = starts.get(block, own[i]) if team is None else own[i]
                    team = teams[i]
                step = _v3_step(b, d[i], r[i], g[i])
                before[i], delta[i] = b, step
                b += step
            yield pdf.assign(b_before=before, delta_b=delta)

    return run


def _effects_v3(batches):
    """What a block does to its first and its last team: the only ones that other blocks may hold rows of."""
    first, team, f, done, block = None, None, None, [], None

    def row(name, f, own):
        return (block, name, own, f.borders.tolist(), f.slope.tolist(), f.level.tolist())

    for pdf in batches:
        if not len(pdf):
            continue
        block = int(pdf[BLOCK].iloc[0])
        teams = pdf["team_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(teams[1:] != teams[:-1]) + 1).tolist(), len(pdf)]
        d, r, g, own = (pdf[n].to_numpy() for n in ("surprise", "target", "gamma", START))
        for lo, hi in zip(cuts, cuts[1:]):
            if teams[lo] != team:
                if team is not None and team == first:
                    done.append(row(team, f, start))
                team, f, start = teams[lo], Clamped(), own[lo]
                first = team if first is None else first
            if team == first or hi == len(pdf):
                for i in range(lo, hi):
                    f.step(d[i], r[i], g[i])
    if team is not None:
        done.append(row(team, f, start))
    if done:
        yield pd.DataFrame(done, columns=["block", "team_id", "own", "borders", "slope", "level"])


EFFECTS = "block int, team_id string, own double, borders array<double>, slope array<double>, level array<double>"


def _chain_v3(pdf: pd.DataFrame) -> pd.DataFrame:
    """One team's value at the start of each of its blocks, from what the blocks before it do; a few numbers per block."""
    rows = pdf.sort_values("block")
    b, starts = rows["own"].iloc[0], []
    for borders, slope, level in zip(rows["borders"], rows["slope"], rows["level"]):
        starts.append(b)
        b = Clamped.of(borders, slope, level)(b)
    return pd.DataFrame({"block": rows["block"].iloc[1:], "b": starts[1:]})


def settle_v3(rows: DataFrame, base: float = c.BASELINE_RATING, order=("date", "fixture_id"), start: str | None = None) -> DataFrame:
    """Steps K(S-E) + gamma(R-B) with the cause-effect bound: each depends on the B reached.

    ``rows`` needs team_id, surprise (S-E), target and gamma, and may name a column with the team's B before its first
    row (else ``base``). A team's history may span many blocks. Two passes, whatever the data: the first finds what each
    block does to a rating that arrives at it (a function of straight pieces) and chains these per team, the second writes
    the rows from the right start. One number per block meets the driver.
    """
    # Written before its ranges are sampled, or what lies behind the rows (a consensus) is worked out for the sample too.
    given = durable(rows.withColumn(START, F.lit(base) if start is None else F.col(start).cast("double")))
    blocks = in_blocks(given, ["team_id"], list(order))
    starts: dict[int, float] = {}
    if blocks.rdd.getNumPartitions() > 1:
        effects = blocks.select("team_id", "surprise", "target", "gamma", START, BLOCK).mapInPandas(_effects_v3, EFFECTS)
        chained = effects.groupBy("team_id").applyInPandas(_chain_v3, "block int, b double")
        starts = {r.block: r.b for r in chained.collect()}
    done = blocks.mapInPandas(_fold_v3(starts, base), _with_doubles(blocks, "b_before", "delta_b"))
    parts = x.settlement_parts("actual_score_s", "e_kr", "b_before", "target", "gamma")
    return done.withColumns(
        {
            "b_after": F.col("b_before") + F.col("delta_b"),
            "gravity_component": parts["delta_gravity"],
            "clamp_applied": parts["clamped"],
        }
    ).drop(BLOCK, START)


# Second generation: a step is affine in both sides' values, so a block's effect on the teams it holds is one sparse map.


def _pull_v2(e: float) -> float:
    e = min(0.99, max(0.01, e))
    return 400.0 * np.log10(e / (1.0 - e))


def _steps_v2(s, eh, ea) -> tuple[float, float]:
    """What the two sides' changes hold besides gamma times the other's lead: the constants of the affine step."""
    g, k, adv = c.GRAVITY_V2, c.SETTLE_K, c.HOME_ADVANTAGE
    return k * (s - eh) + g * (_pull_v2(eh) - adv), k * (1.0 - s - ea) + g * (_pull_v2(ea) + adv)


MAP = "grp string, node int, team string, source string, weight double"
#: Neighbouring maps that are put together, or walked by a vector, in one task.
FAN = 16


def _map_rows(grp, node, maps: dict) -> list[tuple]:
    rows = []
    for team, (weights, const) in maps.items():
        rows += [(grp, node, team, source, w) for source, w in weights.items()]
        rows.append((grp, node, team, None, const))
    return rows


def _maps_of(pdf: pd.DataFrame) -> dict:
    maps: dict = {}
    for team, source, w in zip(pdf["team"], pdf["source"], pdf["weight"]):
        weights, const = maps.get(team, ({}, 0.0))
        if source is None:
            maps[team] = (weights, w)
        else:
            weights[source] = w
            maps[team] = (weights, const)
    return maps


def _mixed(parts: list[tuple], const: float) -> tuple[dict, float]:
    """A weighted sum of affine rows, (weight, (weights, constant)) each, and a constant."""
    weights: dict = {}
    for w, (row, k) in parts:
        const += w * k
        for source, x in row.items():
            weights[source] = weights.get(source, 0.0) + w * x
    return weights, const


def _effects_v2(batches):
    """Maps of a block's first and last group of teams: the only ones whose contests other blocks may hold too."""
    g = c.GRAVITY_V2
    first, group, maps, block = None, None, {}, None
    rows = []
    for pdf in batches:
        if not len(pdf):
            continue
        block = int(pdf[BLOCK].iloc[0])
        for grp, h, a, s, eh, ea in zip(*[pdf[n].tolist() for n in (GROUP, "home_team", "away_team", "s_home", "e_home", "e_away")]):
            if grp != group:
                if group is not None and group == first:
                    rows += _map_rows(group, block, maps)
                group, maps = grp, {}
                first = grp if first is None else first
            mh, ma = maps.get(h, ({h: 1.0}, 0.0)), maps.get(a, ({a: 1.0}, 0.0))
            kh, ka = _steps_v2(s, eh, ea)
            maps[h], maps[a] = _mixed([(1 - g, mh), (g, ma)], kh), _mixed([(1 - g, ma), (g, mh)], ka)
    if group is not None:
        rows += _map_rows(group, block, maps)
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MAP.split(", ")])


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """One map for a run of neighbouring ones."""
    total: dict = {}
    for _, part in pdf.sort_values("node").groupby("node"):
        maps = _maps_of(part)
        total |= {team: _mixed([(w, total.get(x, ({x: 1.0}, 0.0))) for x, w in weights.items()], const) for team, (weights, const) in maps.items()}
    return pd.DataFrame(_map_rows(pdf["grp"].iloc[0], int(pdf["parent"].iloc[0]), total), columns=[x.split()[0] for x in MAP.split(", ")])


ARRIVING = "grp string, node int, team string, b double"


def _arrivals(base: float):
    """The values at the start of each of a run of neighbouring blocks, of the teams these hold."""

    def run(key, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        value = dict(zip(start["team"], start["b"]))
        rows = []
        for node, part in pdf.sort_values("node").groupby("node"):
            maps = _maps_of(part)
            rows += [(pdf["grp"].iloc[0], node, team, value.get(team, base)) for team in maps]
            value |= {team: const + sum(w * value.get(x, base) for x, w in weights.items()) for team, (weights, const) in maps.items()}
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ARRIVING.split(", ")])

    return run


def _fold_v2(base: float, order: list[str]):
    """Walk one block's fixtures, group after group, from the values that arrive at it."""
    g, adv = c.GRAVITY_V2, c.HOME_ADVANTAGE

    def run(key, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([GROUP, *order])
        state = {(grp, team): b for grp, team, b in zip(start["grp"], start["team"], start["b"])}
        out = np.empty((len(pdf), 6))
        for i, (grp, h, a, s, eh, ea) in enumerate(zip(*[pdf[n].tolist() for n in (GROUP, "home_team", "away_team", "s_home", "e_home", "e_away")])):
            bh, ba = state.get((grp, h), base), state.get((grp, a), base)
            kh, ka = _steps_v2(s, eh, ea)
            dh, da = kh + g * (ba - bh), ka + g * (bh - ba)
            state[grp, h], state[grp, a] = bh + dh, ba + da
            out[i] = bh, ba, dh, da, g * (ba + _pull_v2(eh) - adv - bh), g * (bh + _pull_v2(ea) + adv - ba)
        return pdf.assign(**dict(zip(V2_COLUMNS, out.T)))

    return run


V2_COLUMNS = ("home_b_before", "away_b_before", "home_delta_b", "away_delta_b", "home_gravity", "away_gravity")

GROUP = "_group"


def team_groups(rows: DataFrame) -> DataFrame:
    """(team, _group): teams that meet, directly or through others, share a group, whatever leagues they are in.

    Works on distinct pairs of teams: the least name spreads over them, two steps a round, until nothing changes.
    """
    pairs = rows.select(F.col("home_team").alias("a"), F.col("away_team").alias("b"))
    pairs = durable(pairs.union(pairs.select("b", "a")).union(pairs.select("a", "a")).distinct())
    label = pairs.groupBy("a").agg(F.min("b").alias(GROUP))
    while True:
        label = durable(label)
        near = pairs.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min(GROUP).alias(GROUP))
        jump = near.join(label.select(F.col("a").alias(GROUP), F.col(GROUP).alias("_next")), GROUP)
        after = durable(jump.select("a", F.least(GROUP, "_next").alias(GROUP)))
        if after.join(label.withColumnRenamed(GROUP, "_old"), "a").where(F.col(GROUP) != F.col("_old")).isEmpty():
            return after.withColumnRenamed("a", "team")
        label = after


def settle_v2(rows: DataFrame, base: float = c.BASELINE_RATING, order=("date", "fixture_id")) -> DataFrame:
    """Steps with gravity to the strength the odds imply against the opponent's current B.

    ``rows`` is one per fixture: home_team, away_team, s_home, e_home, e_away. A team has one
    B in all its competitions, so the chain runs over teams that are connected by contests. A
    group's fixtures may span many blocks. One pass finds each block's affine effect as sparse
    rows (team, source, weight); neighbouring effects are put together ``FAN`` at a time until
    one run holds all, values are sent back down the same way, and one pass writes the rows.
    Nothing meets the driver.
    """
    groups = team_groups(rows)
    blocks = in_blocks(rows.join(groups, rows.home_team == groups.team).drop("team"), [GROUP], list(order))
    narrow = blocks.select(GROUP, "home_team", "away_team", "s_home", "e_home", "e_away", BLOCK)
    n = blocks.rdd.getNumPartitions()
    parent = F.floor(F.col("node") / FAN).cast("int").alias("parent")
    levels = [durable(narrow.mapInPandas(_effects_v2, MAP))]
    while n > FAN:
        levels.append(durable(levels[-1].select("*", parent).groupBy("grp", "parent").applyInPandas(_together, MAP)))
        n = -(-n // FAN)
    arriving = rows.sparkSession.createDataFrame([], ARRIVING)
    for level in reversed(levels):
        down = arriving.select(F.col("grp").alias("_grp"), F.col("node").alias("_node"), "team", "b")
        walked = level.select("*", parent).groupBy("grp", "parent").cogroup(down.groupBy("_grp", "_node"))
        arriving = durable(walked.applyInPandas(_arrivals(base), ARRIVING))
    start = arriving.select("grp", F.col("node").alias("_node"), "team", "b")
    return blocks.groupBy(BLOCK).cogroup(start.groupBy("_node")).applyInPandas(_fold_v2(base, list(order)), _with_doubles(blocks, *V2_COLUMNS)).drop(BLOCK, GROUP)


def trace(settled: DataFrame, kr: DataFrame) -> DataFrame:
    """Audit struct per log row: parameters, books, consensus and the side's components."""
    frozen = kr.select("fixture_id", "home_prob", "draw_prob", "away_prob", "raw_snapshots")
    joined = settled.join(frozen, "fixture_id")
    detail = F.struct(
        F.lit("v3").alias("oracle_version"),
        F.lit(c.SETTLE_K).alias("K"),
        F.col("gamma"),
        F.lit(c.ALPHA).alias("alpha"),
        F.col("competition"),
        F.col("score"),
        F.col("bookmaker_count"),
        F.col("raw_snapshots").alias("bookmakers"),
        F.struct("home_prob", "draw_prob", "away_prob").alias("consensus"),
        F.struct(
            F.col("actual_score_s").alias("S"),
            F.col("e_kr").alias("E_KR"),
            F.col("b_before").alias("B_before"),
            F.col("b_after").alias("B_after"),
            F.col("target").alias("R_market_frozen"),
            F.col("delta_b").alias("delta_final"),
            F.col("gravity_component").alias("delta_gravity"),
            F.col("clamp_applied"),
        ).alias("settlement_detail"),
        F.when(F.col("is_home"), "home").otherwise("away").alias("perspective"),
    )
    return joined.select("fixture_id", "team_id", detail.alias("trace_payload"))
