"""Bradley-Terry rating solves over aggregated pairings.

Both solvers only need, per (group, home, away), the summed weight and the
summed weighted score. Those sums are taken by Spark before any group reaches
Python, so a solve sees at most one row per ordered pair of a league's teams
however many fixtures there are. Systems over a league's teams are solved by
conjugate gradients along the pairs, so no matrix of teams by teams is formed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.session import durable

ELO = np.log(10.0) / 400.0


def _index(names: pd.Series, teams: pd.Index) -> np.ndarray:
    return teams.get_indexer(names)


# --- windowed MAP solve per league ---------------------------------------------


def solve_edges(fixtures: DataFrame, frozen: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Fixtures entering a solve at ``as_of``, with expected score and weight.

    Past: finished in the last 30 days (45 where a league has under five), frozen
    score first, current next. Ahead: upcoming in the next 30 days, current score.
    """
    noon = t.kickoff_or_default("commence_time", "date", "12:00:00")
    today = as_of.cast("date")
    past = (F.col("status") == "finished") & (F.col("date") <= today)
    near = past & (F.col("date") >= F.date_sub(today, c.WINDOW_DAYS))
    wide = past & (F.col("date") >= F.date_sub(today, c.WINDOW_EXPANDED_DAYS))
    ahead = (
        F.col("status").isin("upcoming", "scheduled", "not_started", "tbd")
        & (F.col("date") >= today)
        & (F.col("date") <= F.date_add(today, c.WINDOW_DAYS))
    )
    inside = fixtures.where((wide | ahead) & (F.col("competition") != "cup"))
    marked = inside.select(
        "fixture_id", "league", "home_team", "away_team", near.alias("_near"), wide.alias("_wide"), ahead.alias("is_ahead"),
        t.days_between(noon, as_of).alias("_age"),
    )
    counts = marked.groupBy("league").agg(
        F.count_if("_near").alias("_n_near"), F.count_if("_wide").alias("_n_wide")
    )
    expand = (F.col("_n_near") < c.MIN_FIXTURES) & (F.col("_n_wide") > F.col("_n_near"))
    chosen = (
        marked.join(counts, "league")
        .withColumn("window_days", F.when(expand, c.WINDOW_EXPANDED_DAYS).otherwise(c.WINDOW_DAYS))
        .where(F.col("is_ahead") | F.col("_near") | expand)
    )
    scored = (
        chosen.join(frozen.select("fixture_id", F.col("home_expected_score").alias("_fz")), "fixture_id", "left")
        .join(current.select("fixture_id", F.col("home_es").alias("_cur")), "fixture_id", "left")
        .withColumn("home_es", F.when(F.col("is_ahead"), F.col("_cur")).otherwise(F.coalesce("_fz", "_cur")))
        .where(F.col("home_es").isNotNull())
    )
    weight = F.when(F.col("is_ahead"), t.proximity(-F.col("_age"), c.AHEAD_SCALE_DAYS)).otherwise(
        t.proximity("_age", c.PAST_SCALE_DAYS)
    )
    return scored.select(
        "fixture_id", "league", "home_team", "away_team", "home_es", weight.alias("weight"), "is_ahead", "window_days"
    )


def pair_sums(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics per ordered pair."""
    return edges.groupBy(*keys, "home_team", "away_team").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("home_es")).alias("ws"), F.count(F.lit(1)).alias("n")
    )


SOLVED = (
    "league string, team string, rating double, std_error double, prior double, iterations int, max_step double, "
    "converged boolean, fixtures_used long, teams_count int, sigma_prior double"
)


MODES = (
    "league string, team string, rating double, prior double, _place int, iterations int, max_step double, converged boolean, fixtures_used long, teams_count int, sigma_prior double"
)
PANDAS_TYPES = {"string": "object", "double": "float64", "int": "int32", "long": "int64", "boolean": "bool"}


class Mode(NamedTuple):
    """A posterior mode and how it was reached."""

    rating: np.ndarray
    iterations: int
    max_step: float
    converged: bool


def _expect(r, h, a) -> np.ndarray:
    return 1.0 / (1.0 + 10.0 ** (-(r[h] - r[a] + c.HOME_ADVANTAGE) / 400.0))


def _bend(w, p) -> np.ndarray:
    return w * p * (1.0 - p) * ELO**2


def conjugate(h, a, bend, sigma: float, right: np.ndarray, tolerance: float = 1e-12, most: int = 1000) -> np.ndarray:
    """Solve (edge Laplacian of ``bend`` + 1/sigma^2) x = right, for each column of ``right``, by conjugate gradients.

    The matrix is never formed: a step is one sum over the edges. Scaled by the diagonal, as teams differ in contests.
    """
    n = len(right)
    x = np.zeros_like(right)
    diagonal = (np.bincount(h, bend, n) + np.bincount(a, bend, n) + sigma**-2)[:, None]

    def times(v):
        flow = bend[:, None] * (v[h] - v[a])
        out = v / sigma**2
        for j in range(v.shape[1]):
            out[:, j] += np.bincount(h, flow[:, j], n) - np.bincount(a, flow[:, j], n)
        return out

    rest = right.copy()
    z = rest / diagonal
    p, rho = z.copy(), (rest * z).sum(axis=0)
    least = np.maximum(rho, 1e-300) * tolerance**2
    for _ in range(most):
        open_ = rho > least
        if not open_.any():
            break
        q = times(p)
        alpha = np.where(open_, rho / np.where(open_, (p * q).sum(axis=0), 1.0), 0.0)
        x += alpha * p
        rest -= alpha * q
        z = rest / diagonal
        new = (rest * z).sum(axis=0)
        p = z + np.where(open_, new / np.where(rho > 0, rho, 1.0), 0.0) * p
        rho = np.where(open_, new, rho)
    return x


def newton(h, a, w, ws, prior: np.ndarray, sigma: float) -> Mode:
    """Newton ascent of the log-posterior with a Gaussian prior; ``h``, ``a`` index teams, ``ws`` is weight times score."""
    n, r = len(prior), prior.astype(float).copy()
    step, done, it = np.inf, False, 0
    while it < c.SOLVE_MAX_ITER and not done:
        it += 1
        p = _expect(r, h, a)
        pull = (ws - w * p) * ELO
        grad = np.bincount(h, pull, n) - np.bincount(a, pull, n) - (r - prior) / sigma**2
        move = np.clip(conjugate(h, a, _bend(w, p), sigma, grad[:, None])[:, 0], -c.SOLVE_STEP_CLAMP, c.SOLVE_STEP_CLAMP)
        r = r + move
        step = float(np.abs(move).max())
        done = step < c.SOLVE_TOL
    return Mode(r, it, step, done)


def _map_solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One league's mode, from its pair sums."""
    used = int(pdf["n"].sum())
    if used <= 2:
        return pd.DataFrame({n.split()[0]: pd.Series(dtype=PANDAS_TYPES[n.split()[1]]) for n in MODES.split(", ")})
    teams = pd.Index(sorted(set(pdf["home_team"]) | set(pdf["away_team"])))
    h, a = _index(pdf["home_team"], teams), _index(pdf["away_team"], teams)
    prior = np.full(len(teams), c.BASELINE_RATING)
    prior[h], prior[a] = pdf["home_prior"], pdf["away_prior"]
    sigma = c.SIGMA_SPARSE if used < c.MIN_FIXTURES else c.SIGMA_PRIOR
    mode = newton(h, a, pdf["w"].to_numpy(), pdf["ws"].to_numpy(), prior, sigma)
    about = {"iterations": mode.iterations, "max_step": mode.max_step, "converged": mode.converged, "fixtures_used": used, "teams_count": len(teams), "sigma_prior": sigma}
    return pd.DataFrame({"league": pdf["league"].iloc[0], "team": teams, "rating": mode.rating, "prior": prior, "_place": np.arange(len(teams)), **about})


def _errors(key, edges: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Standard errors of one block of a league's teams: columns of the inverse curvature, one solve for all of them."""
    if not len(block):
        return pd.DataFrame({"league": pd.Series(dtype=object), "team": pd.Series(dtype=object), "std_error": pd.Series(dtype=float)})
    teams = pd.Index(sorted(set(edges["home_team"]) | set(edges["away_team"])))
    h, a = _index(edges["home_team"], teams), _index(edges["away_team"], teams)
    r = np.zeros(len(teams))
    r[h], r[a] = edges["home_rating"], edges["away_rating"]
    bend = _bend(edges["w"].to_numpy(), _expect(r, h, a))
    mine = _index(block["team"], teams)
    unit = np.zeros((len(teams), len(mine)))
    unit[mine, np.arange(len(mine))] = 1.0
    variance = conjugate(h, a, bend, float(block["sigma_prior"].iloc[0]), unit)[mine, np.arange(len(mine))]
    return pd.DataFrame({"league": block["league"], "team": block["team"].to_numpy(), "std_error": np.sqrt(np.maximum(0.0, variance))})


#: Teams whose standard errors are worked out in one task.
ERROR_BLOCK = 128


def std_errors(sums: DataFrame, modes: DataFrame) -> DataFrame:
    """(league, team, std_error): roots of the inverse curvature's diagonal at the mode, a block of teams a task.

    A league's pair sums go to each of its blocks; no task holds a matrix over all teams, only the block's columns.
    """
    blocks = modes.select("league", "team", "sigma_prior", "_place", F.floor(F.col("_place") / ERROR_BLOCK).cast("int").alias("_block"))
    rated = [modes.select("league", F.col("team").alias(f"{s}_team"), F.col("rating").alias(f"{s}_rating")) for s in ("home", "away")]
    ready = sums.join(rated[0], ["league", "home_team"]).join(rated[1], ["league", "away_team"])
    ready = ready.join(blocks.select("league", F.col("_block").alias("_part")).distinct(), "league")
    pairs = ready.select("league", "_part", "home_team", "away_team", "w", "home_rating", "away_rating")
    return pairs.groupBy("league", "_part").cogroup(blocks.groupBy("league", "_block")).applyInPandas(_errors, "league string, team string, std_error double")


def map_ratings(edges: DataFrame, priors: DataFrame) -> DataFrame:
    """MAP ratings per league; leagues with two fixtures or fewer give no rows. ``priors``: team_id, b_value."""
    sums = durable(pair_sums(edges, ["league"]))
    home = priors.select(F.col("team_id").alias("home_team"), F.col("b_value").alias("home_prior"))
    away = priors.select(F.col("team_id").alias("away_team"), F.col("b_value").alias("away_prior"))
    base = F.lit(c.BASELINE_RATING)
    ready = sums.join(home, "home_team", "left").join(away, "away_team", "left")
    ready = ready.withColumns({"home_prior": F.coalesce("home_prior", base), "away_prior": F.coalesce("away_prior", base)})
    modes = durable(ready.groupBy("league").applyInPandas(_map_solve, MODES))
    errors = std_errors(sums, modes)
    return modes.join(errors, ["league", "team"]).select(*[n.split()[0] for n in SOLVED.split(", ")])


# --- daily batch solve ------------------------------------------------------------


def daily_edges(scored: DataFrame, start: str, end: str) -> DataFrame:
    """Decayed pair sums per as-of day. ``scored``: date, home_team, away_team, obs.

    Fixtures are summed per (day, pair) first; each of those rows then reaches the 61
    as-of days it can matter for, so the spread does not grow with the fixtures.
    """
    per_day = scored.groupBy("date", "home_team", "away_team").agg(F.sum("obs").alias("_o"), F.count(F.lit(1)).alias("_n"))
    lo = F.greatest(F.col("date"), F.lit(start).cast("date"))
    hi = F.least(F.date_add("date", c.PANEL_WINDOW_DAYS), F.lit(end).cast("date"))
    spread = per_day.where(lo <= hi).withColumn("as_of", F.explode(F.sequence(lo, hi)))
    weight = t.half_life(F.date_diff("as_of", "date"), c.PANEL_HALF_LIFE)
    return spread.groupBy("as_of", "home_team", "away_team").agg(
        F.sum(weight * F.col("_n")).alias("w"), F.sum(weight * F.col("_o")).alias("ws")
    )


def _batch_solve(home_adv: float, passes: int):
    """All days of one month at once: ratings are a (day, team) table, passes run on it as a whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds = pdf[pdf["away_team"].isna()]
        edges = pdf[pdf["away_team"].notna()]
        teams = pd.Index(sorted(seeds["home_team"].unique()))
        days = pd.Index(sorted(seeds["as_of"].unique()))
        n, m = len(teams), len(days)
        prior = np.full((m, n), c.BASELINE_RATING)
        prior[days.get_indexer(seeds["as_of"]), _index(seeds["home_team"], teams)] = seeds["w"]
        d = days.get_indexer(edges["as_of"])
        fh = d * n + _index(edges["home_team"], teams)
        fa = d * n + _index(edges["away_team"], teams)
        w, ws = edges["w"].to_numpy(), edges["ws"].to_numpy()
        seen = np.bincount(fh, ws, m * n) + np.bincount(fa, w - ws, m * n)
        live = np.zeros(m, bool)
        live[d] = True
        r = prior.copy()
        for _ in range(passes):
            flat = r.ravel()
            p = w / (1.0 + 10.0 ** ((flat[fa] - flat[fh] - home_adv) / 400.0))
            due = np.bincount(fh, p, m * n) + np.bincount(fa, w - p, m * n)
            gain = np.zeros(m * n)
            known = due > 0.001
            with np.errstate(divide="ignore"):
                gain[known] = c.PANEL_GAIN * np.log(seen[known] / due[known])
            r = r + gain.reshape(m, n)
            r = (1.0 - c.PRIOR_PULL) * r + c.PRIOR_PULL * prior
            r = r - r.mean(axis=1, keepdims=True) + c.BASELINE_RATING
        r[~live] = prior[~live]
        return pd.DataFrame({"as_of": np.repeat(days, n), "team": np.tile(teams, m), "rating": r.ravel()})

    return run


def daily_ratings(
    scored: DataFrame, priors: DataFrame, start: str, end: str, home_adv: float, passes: int = c.PANEL_PASSES
) -> DataFrame:
    """Batch ratings per (as_of day, team): decayed window, damped ratio updates, prior pull, re-centring.

    Every day restarts from the priors, so days are independent; a task holds one
    month of days times the teams.
    """
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    seeds = priors.select(
        days.alias("as_of"), F.col("team").alias("home_team"), F.lit(None).cast("string").alias("away_team"),
        F.col("prior").alias("w"), F.lit(0.0).alias("ws"),
    )
    rows = daily_edges(scored, start, end).unionByName(seeds)
    return rows.groupBy(F.trunc("as_of", "month").alias("_m")).applyInPandas(
        _batch_solve(home_adv, passes), "as_of date, team string, rating double"
    )
