"""Chronological replay: settle in time order, solve the affected leagues every so many settlements or every day.

Where the steps end follows from the results alone, so it is known before any rating is: it comes from one ordered scan
over all fixtures. After that a league's ratings depend on its own teams only, as cup settlements look at no opponent.
Leagues run side by side, each through its steps in order: a task reads a league's rows sorted by the day that needs
them and holds the fixtures of one solve's window only. The driver goes from epoch to epoch, a bounded number of
settlements each, and writes the state in between, from where a later call goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright import config as c
from ratewright.functions import calendar as t
from ratewright.functions import text as tx
from ratewright.operators import settle as st
from ratewright.operators.bradley_terry import ELO, newton
from ratewright.operators.ordered import ordered_scan
from ratewright.operators.settlement import with_reasons
from ratewright.session import durable, new_folder

#: Most settled fixtures of an epoch, after which the state is written. Each epoch is a few jobs of the driver's.
EPOCH = 1_000_000
#: Rows of log and history that a task gathers before it hands them on; new fixtures that it takes before it drops old ones.
CHUNK = 10_000
#: Teams up to which a league's curvature is kept as a matrix.
SMALL = 32
STATE = ["b_value", "r_network", "r_next", "r_market", "m1_value", "published_index"]
#: ``turn``: the first day that needs a row. A fixture comes when the windows reach it, a next contest after the one before it.
ROWS = "kind string, league string, turn int, step long, fixture_id long, team_id string, opponent string, is_home boolean, competition string, day int, start double, at double, e double, s double, status string, v array<double>"
OUT = "kind string, league string, step long, fixture_id long, team_id string, e_kr double, s double, b_before double, delta_b double, v array<double>"


def steps_of(settleable: DataFrame, every: int | None) -> DataFrame:
    """(fixture_id, step, epoch, until): which step settles a fixture, counted over all leagues, and the day after its last fixture.

    ``every`` settlements make a step, in the order of date, start and id; with none, every day does.
    """
    rows = settleable.select(F.lit(0).alias("_all"), "date", F.coalesce("commence_time", F.lit("0001-01-01").cast("timestamp_ntz")).alias("_start"), "fixture_id")
    counted = ordered_scan(rows, ["_all"], ["date", "_start", "fixture_id"], numbers="n")
    if every:
        stepped = counted.withColumn("step", F.floor((F.col("n") - 1) / every))
        size = max(EPOCH // every, 1)
        stepped = stepped.withColumn("epoch", F.floor(F.col("step") / size))
    else:
        stepped = counted.withColumn("step", F.unix_date("date").cast("long"))
        opened = stepped.groupBy("step").agg(F.floor(F.min("n") / EPOCH).alias("epoch"))
        stepped = stepped.join(opened, "step")
    ends = stepped.groupBy("step").agg((F.max(F.unix_date("date")) + 1).alias("until"))
    return stepped.join(ends, "step").select("fixture_id", "step", "epoch", "until")


def _r4(value: float) -> float:
    return round(value * 1e4) / 1e4 if value == value else value


class _Sums(NamedTuple):
    """What a day's solve of a league needs of its fixtures: how many there are, their teams, and sums per ordered pair."""

    used: int
    teams: np.ndarray
    home: np.ndarray
    away: np.ndarray
    w: np.ndarray
    ws: np.ndarray


def _mode(sums: _Sums, prior: np.ndarray, sigma: float) -> np.ndarray:
    """The steps of ``newton`` for a few teams, whose curvature is a small matrix."""
    n = len(prior)
    lead = np.zeros((len(sums.w), n))
    lead[np.arange(len(sums.w)), sums.home] += 1.0
    lead[np.arange(len(sums.w)), sums.away] -= 1.0
    r, own = prior.copy(), np.eye(n) / sigma**2
    for _ in range(c.SOLVE_MAX_ITER):
        p = 1.0 / (1.0 + 10.0 ** (-(lead @ r + c.HOME_ADVANTAGE) / 400.0))
        grad = lead.T @ ((sums.ws - sums.w * p) * ELO) - (r - prior) / sigma**2
        bend = sums.w * p * (1.0 - p) * ELO**2
        move = np.clip(np.linalg.solve(lead.T @ (bend[:, None] * lead) + own, grad), -c.SOLVE_STEP_CLAMP, c.SOLVE_STEP_CLAMP)
        r += move
        if np.abs(move).max() < c.SOLVE_TOL:
            break
    return r


class _League:
    """One league's teams while its steps are walked.

    Fixtures and what is weighed of them do not depend on ratings, so sums per pair and next contests are worked out once a
    day, however many steps end on it. Fixtures come in the order of days, and leave when the windows have passed them.
    """

    def __init__(self, teams: list[str], values: np.ndarray):
        self.b, self.network, self.next, self.market, self.m1, self.published = (x.tolist() for x in values.T)
        #: Codes below ``n`` are the league's teams; others, numbered as they come, play against them only.
        self.n, self.teams, self.codes = len(teams), teams, {name: i for i, name in enumerate(teams)}
        self.others = 0
        #: day, at, home, away, current and frozen score, whether finished: what the windows hold, and what came since.
        self.held, self.came, self.new = [np.empty(0, dtype=kind) for kind in ("i4", "f8", "i8", "i8", "f8", "f8", "?")], [], 0
        self.ahead: dict[int, tuple] = {}
        self.day, self.sums, self.nexts = None, None, []

    def _code(self, name: str) -> int:
        if name not in self.codes:
            self.codes[name] = self.n + self.others
            self.others += 1
        return self.codes[name]

    def _coded(self, names: np.ndarray) -> np.ndarray:
        """Codes of names, -1 for none."""
        at, found = pd.factorize(names)
        return np.array([*map(self._code, found), -1], dtype=np.int64)[at]

    def see(self, day, at, home, away, e, s, status) -> None:
        """Fixtures, finished or upcoming, that the windows reach; no day before that is solved any more."""
        self.came.append((day.astype("i4"), at.astype("f8"), self._coded(home), self._coded(away), e.astype("f8"), s.astype("f8"), status == "finished"))
        self.new += len(day)
        if self.new > max(CHUNK, len(self.held[0])):
            self._keep(int(day[-1]) - c.WINDOW_DAYS)

    def _keep(self, today: int) -> None:
        """What came is held, and what the windows have passed by ``today`` is not."""
        held = [np.concatenate(x) for x in zip(self.held, *self.came)]
        lo = np.searchsorted(held[0], today - c.WINDOW_EXPANDED_DAYS)
        self.held, self.came, self.new = [x[lo:] for x in held], [], 0

    def expect(self, team: str, day: int, opponent: str, at_home: bool, e: float) -> None:
        """A team's next contest, once the one before it has passed."""
        if team in self.codes and (own := self.codes[team]) < self.n:
            self.ahead[own] = (day, self.codes.get(opponent, -1) if opponent is not None else -1, at_home, e)

    def settle(self, i: int, e: float, s: float, cup: bool) -> tuple[float, float]:
        market = self.market[i]
        pull = 0.0 if cup or market != market else c.GRAVITY_V3
        before = self.b[i]
        step = st._v3_step(before, s - e, market if pull else 0.0, pull)
        self.b[i] = before + step
        self.published[i] = self.b[i] + self.m1[i]
        return before, step

    def store(self, touched: set[int]) -> None:
        """State is stored to four places after a step's settlements."""
        for i in touched:
            self.b[i], self.published[i] = _r4(self.b[i]), _r4(self.published[i])

    def _turn(self, today: int) -> None:
        if today == self.day:
            return
        self._keep(today)
        self.day, self.sums, self.nexts = today, self._sums(today), []
        for name in self.teams:
            day, other, at_home, e = self.ahead.get(self.codes[name], (today, -1, True, np.nan))
            if day < today or e != e:
                self.nexts.append(None)
                continue
            e = min(0.99, max(0.01, float(e if at_home else 1 - e)))
            self.nexts.append((other if other < self.n else -1, float(400.0 * np.log10(e / (1.0 - e))), -c.HOME_ADVANTAGE if at_home else c.HOME_ADVANTAGE))

    def _sums(self, today: int) -> _Sums:
        """Fixtures of a solve at midnight of ``today``, weighed and summed by ordered pair."""
        lo, hi = np.searchsorted(self.held[0], (today - c.WINDOW_EXPANDED_DAYS, today + c.WINDOW_DAYS + 1))
        day, at, home, away, current, frozen, done = (x[lo:hi] for x in self.held)
        wide = done & (day < today)
        near = wide & (day >= today - c.WINDOW_DAYS)
        chosen = wide if near.sum() < c.MIN_FIXTURES and wide.sum() > near.sum() else near
        ahead = day >= today
        es = np.where(ahead, current, np.where(np.isnan(frozen), current, frozen))
        age = today - at
        weight = np.where(ahead, 1 / (1 + np.maximum(0, -age) / c.AHEAD_SCALE_DAYS), 1 / (1 + np.maximum(0, age) / c.PAST_SCALE_DAYS))
        use = (chosen | ahead) & ~np.isnan(es) & (home >= 0) & (away >= 0)
        known = max(self.n + self.others, 1)
        pairs, at = np.unique(home[use] * np.int64(known) + away[use], return_inverse=True)
        home, away = pairs // known, pairs % known
        teams = np.unique(np.concatenate([home, away]))
        return _Sums(int(use.sum()), teams, np.searchsorted(teams, home), np.searchsorted(teams, away), np.bincount(at, weight[use], len(pairs)), np.bincount(at, weight[use] * es[use], len(pairs)))

    def _overlay(self, net: dict[int, float]) -> None:
        for i, own in net.items():
            nxt, game = own, self.nexts[i]
            if game is not None and game[0] in net:
                nxt = net[game[0]] + game[1] + game[2]
            market = (1.0 - c.W_NEXT) * own + c.W_NEXT * nxt
            m1 = min(c.OVERLAY_CLAMP, max(-c.OVERLAY_CLAMP, c.ALPHA * (market - self.b[i])))
            self.network[i], self.next[i], self.market[i], self.m1[i], self.published[i] = (_r4(x) for x in (own, nxt, market, m1, self.b[i] + m1))

    def solve(self, today: int) -> None:
        self._turn(today)
        sums = self.sums
        if sums.used <= 2:
            for i, b in enumerate(self.b):
                self.m1[i], self.market[i], self.next[i], self.published[i] = 0.0, b, b, _r4(b)
            return
        places = sums.teams.tolist()
        prior = np.array([self.b[i] if i < self.n else c.BASELINE_RATING for i in places])
        sigma = c.SIGMA_SPARSE if sums.used < c.MIN_FIXTURES else c.SIGMA_PRIOR
        rating = _mode(sums, prior, sigma) if len(prior) <= SMALL else newton(sums.home, sums.away, sums.w, sums.ws, prior, sigma).rating
        self._overlay({i: _r4(x) for i, x in zip(places, rating.tolist()) if i < self.n})

    def refresh(self, today: int) -> None:
        self._turn(today)
        self._overlay({i: self.b[i] if x != x else x for i, x in enumerate(self.network)})

    def rows(self) -> np.ndarray:
        return np.array([self.b, self.network, self.next, self.market, self.m1, self.published]).T


class _Walk:
    """A league on its way through its steps: rows go in as they come, ``out`` has frames of log, history and last state."""

    def __init__(self, league: str, daily: bool):
        self.league, self.daily = league, daily
        self.states, self.game, self.touched, self.solve = [], None, set(), False
        self.log, self.steps, self.held = [], [], []

    def take(self, cols: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        """Rows in the order of ``_sorted``: states, then fixtures and next contests ahead of the steps that look at them, a step's sides before its end."""
        kinds = cols["kind"]
        group = np.where(kinds == "step", "side", kinds)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(kinds)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = {n: x[lo:hi] for n, x in cols.items()}
            if group[lo] == "state":
                self.states += zip(part["team_id"], part["v"])
                continue
            game = self._begun()
            if group[lo] == "fixture":
                game.see(*(part[n] for n in ("day", "at", "team_id", "opponent", "e", "s", "status")))
            elif group[lo] == "next":
                for row in zip(*(part[n].tolist() for n in ("team_id", "day", "opponent", "is_home", "e"))):
                    game.expect(*row)
            else:
                yield from self._steps(game, part)

    def _begun(self) -> _League:
        if self.game is None:
            teams = [team for team, _ in self.states]
            self.game = _League(teams, np.array([[np.nan if x is None else x for x in v] for _, v in self.states], dtype=float).reshape(-1, len(STATE)))
        return self.game

    def _steps(self, game: _League, part: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for kind, step, fixture, team, competition, e, s, day in zip(*(part[n].tolist() for n in ("kind", "step", "fixture_id", "team_id", "competition", "e", "s", "day"))):
            if kind == "side":
                i, cup = game.codes[team], competition == "cup"
                self.log.append((step, fixture, team, e, s, *game.settle(i, e, s, cup)))
                self.touched.add(i)
                self.solve = self.solve or not cup
                continue
            game.store(self.touched)
            if self.solve:
                game.solve(int(day))
            elif self.daily:
                game.refresh(int(day))
            if self.solve or self.daily:
                self.steps.append(step)
                self.held.append(game.rows())
            self.touched, self.solve = set(), False
            if len(self.log) + len(self.steps) * game.n >= CHUNK:
                yield from self._gathered()

    def _gathered(self) -> Iterator[pd.DataFrame]:
        teams = self._begun().teams
        if self.log:
            yield self._frame("log", **dict(zip(("step", "fixture_id", "team_id", "e_kr", "s", "b_before", "delta_b"), zip(*self.log))))
        if self.steps and teams:
            yield self._frame("history", step=np.repeat(self.steps, len(teams)), team_id=teams * len(self.steps), v=list(np.concatenate(self.held)))
        self.log, self.steps, self.held = [], [], []

    def end(self) -> Iterator[pd.DataFrame]:
        game = self._begun()
        yield from self._gathered()
        yield self._frame("state", team_id=game.teams, v=list(game.rows()))

    def _frame(self, kind: str, **columns) -> pd.DataFrame:
        none = {n.split()[0]: None for n in OUT.split(", ")}
        kinds = {"step": "Int64", "fixture_id": "Int64", **{n: "float64" for n in ("e_kr", "s", "b_before", "delta_b")}}
        return pd.DataFrame({**none, "kind": kind, "league": self.league, **columns}, index=range(len(columns["team_id"]))).astype(kinds)


def _walks(daily: bool):
    """All steps of an epoch, league after league, over the batches of a task's sorted rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = None
        for pdf in frames:
            if not len(pdf):
                continue
            cols = {n: pdf[n].to_numpy() for n in pdf.columns}
            leagues = cols["league"]
            cuts = [0, *(np.flatnonzero(leagues[1:] != leagues[:-1]) + 1).tolist(), len(leagues)]
            for lo, hi in zip(cuts, cuts[1:]):
                if walk is None or walk.league != leagues[lo]:
                    if walk is not None:
                        yield from walk.end()
                    walk = _Walk(leagues[lo], daily)
                yield from walk.take({n: x[lo:hi] for n, x in cols.items()})
        if walk is not None:
            yield from walk.end()

    return run


def _walk(daily: bool):
    """The same for one league whose rows are in one frame, in any order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, nexts = pdf["kind"], pdf[pdf["kind"] == "next"].sort_values("day")
        until = pdf["step"].map(pdf[kind == "step"].set_index("step")["day"])
        after = (nexts.groupby("team_id")["day"].shift() + 1).fillna(pdf["day"].min()).reindex(pdf.index)
        turn = np.select([kind == "fixture", kind.isin(["side", "step"]), kind == "next"], [pdf["day"] - c.WINDOW_DAYS, until, after], np.nan)
        step = pdf["step"].where(kind.isin(["side", "step"]))
        rows = pdf.assign(_turn=turn, _step=step, _at=pdf["at"].where(kind == "fixture", pdf["start"]), _away=pdf["is_home"].ne(True))
        rows = rows.sort_values(["_turn", "_step", "kind", "day", "_at", "fixture_id", "_away", "team_id"], na_position="first")
        return pd.concat(_walks(daily)(iter([rows])))

    return run


def _by(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows written in the order of a column, so that an epoch reads its own part of them."""
    folder = new_folder(df.sparkSession, name)
    df.repartitionByRange(column).sortWithinPartitions(column).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _next_games(games: DataFrame) -> DataFrame:
    """(league, team_id, date, opponent, is_home, home_es, after): each team's first contest of each day, and the day of the one before."""
    first = F.min_by(F.struct("opponent", "is_home", "home_es"), F.struct("_start", "fixture_id", ~F.col("is_home")))
    days = st.team_rows(games.select("fixture_id", "league", "date", "_start", "home_es", "home_team", "away_team")).groupBy("league", "team_id", "date").agg(first.alias("_first"))
    return days.select("league", "team_id", "date", "_first.*", F.lag("date").over(Window.partitionBy("league", "team_id").orderBy("date")).alias("after"))  # a row a day


def _epoch_rows(sides: DataFrame, fixtures: DataFrame, nexts: DataFrame, state: DataFrame, clock: DataFrame, lo: int, hi: int) -> DataFrame:
    """What the leagues need for an epoch that settles days ``lo`` to ``hi``: states, sides, clock, the fixtures near it, and each team's next ones."""
    first, last = (F.date_from_unix_date(F.lit(x)) for x in (lo - c.WINDOW_EXPANDED_DAYS, hi + c.WINDOW_DAYS + 1))
    day = F.unix_date("date")
    near = fixtures.where(F.col("date").between(first, last))
    # Those that are some team's next one on a day after ``lo`` and up to the day after ``hi``.
    coming = nexts.where((day > lo) & (F.col("after").isNull() | (F.unix_date("after") <= hi)))
    names = [n.split()[0] for n in ROWS.split(", ")]

    def shaped(df, kind, **columns):
        every = {**{n: F.lit(None) for n in names}, "fixture_id": F.lit(0), "kind": F.lit(kind), **columns}
        return df.select([every[n].cast(k.split(" ", 1)[1]).alias(n) for n, k in zip(names, ROWS.split(", "))])

    start = F.unix_micros(F.col("_start").cast("timestamp"))
    parts = [
        shaped(state, "state", league=F.col("league"), team_id=F.col("team_id"), v=F.array(*[F.col(n).cast("double") for n in STATE])),
        shaped(sides, "side", turn=F.col("until"), start=start, day=day, e=F.col("e_kr"), s=F.col("actual_score_s"), **{n: F.col(n) for n in ("league", "step", "fixture_id", "team_id", "is_home", "competition")}),
        shaped(near, "fixture", turn=day - c.WINDOW_DAYS, day=day, team_id=F.col("home_team"), opponent=F.col("away_team"), at=F.col("_noon"), e=F.col("home_es"), s=F.col("home_expected_score"), **{n: F.col(n) for n in ("league", "fixture_id", "status")}),
        shaped(coming, "next", turn=F.greatest(F.unix_date("after") + 1, F.lit(lo)), day=day, e=F.col("home_es"), **{n: F.col(n) for n in ("league", "team_id", "opponent", "is_home")}),
        shaped(clock, "step", turn=F.col("until"), day=F.col("until"), **{n: F.col(n) for n in ("league", "step")}),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.where(F.col("league").isNotNull())


def _sorted(rows: DataFrame) -> DataFrame:
    """Whole leagues in a task, each in the order in which its walk needs the rows: by turn, and within it what has no step, then step after step.

    Kinds sort as they are needed: fixture before next, side before step. States have no turn, so they come first.
    """
    order = ["league", "turn", "step", "kind", "day", F.coalesce("at", "start"), "fixture_id", F.desc("is_home"), "team_id"]
    return rows.repartition("league").sortWithinPartitions(*order).drop("turn", "start")


def replay(fixtures: DataFrame, kr: DataFrame, current: DataFrame, state: DataFrame, every: int | None = 10, root: str | None = None) -> dict[str, DataFrame]:
    """Settle all finished fixtures in time order: ``state`` at the end, ``log`` (a row per side) and ``history`` (a row per team and solve).

    Every ``every`` settlements, counted over all leagues, the leagues that settled a league fixture in between are solved, as
    of the midnight after the step's last day: fixtures up to then are past, later ones ahead. Without ``every`` a step is a
    day, and leagues that do not solve refresh their overlay. ``current`` (fixture_id, home_es) are expected scores of the
    quotes as they stand, not as they stood. ``state``: team_id, league, b_value. Leagues with two fixtures or fewer in their
    window lose the overlay. Given the ``root`` of an earlier call, epochs that it wrote are not run again.
    """
    spark = fixtures.sparkSession
    root = root or new_folder(spark, "replay")
    none = spark.createDataFrame([], "fixture_id long, team_id string, oracle_version string")
    reasoned = durable(with_reasons(fixtures, kr, state, none, "v3"))
    settleable = reasoned.where(F.col("skipped_reason").isNull())
    steps = durable(steps_of(settleable, every))
    sides = st.team_rows(
        settleable.drop("league").join(steps, "fixture_id"),
        {"own_goals": ("home_goals", "away_goals"), "other_goals": ("away_goals", "home_goals"), "e_kr": ("home_expected_score", "away_expected_score"), "_open": ("home_open", "away_open")},
    )
    early = F.coalesce("commence_time", F.lit("0001-01-01").cast("timestamp_ntz"))
    homes = state.select("team_id", "league")
    sides = sides.where("_open").withColumns({"actual_score_s": tx.result_score("own_goals", "other_goals"), "_start": early}).join(homes, "team_id")
    sides = _by(sides.select("epoch", "step", "until", "league", "fixture_id", "team_id", "is_home", "competition", "date", "_start", "e_kr", "actual_score_s"), "epoch", "replay-sides")
    noon = F.unix_micros(t.kickoff_or_default("commence_time", "date", "12:00:00").cast("timestamp")) / 8.64e10
    leagues = homes.select("league").distinct()
    games = fixtures.where("competition = 'league' AND status IN ('finished', 'upcoming')").join(F.broadcast(leagues), "league", "left_semi").select("fixture_id", "date", "league", "home_team", "away_team", "status", early.alias("_start"), noon.alias("_noon"))
    games = games.join(kr.select("fixture_id", "home_expected_score"), "fixture_id", "left").join(current.select("fixture_id", "home_es"), "fixture_id", "left")
    games = _by(games, "date", "replay-games")
    nexts = durable(_next_games(games))
    # In daily steps every league has every step; else those in which it settles.
    clocks = sides.select("epoch", "step", "until", "league").distinct() if every else durable(steps.select("epoch", "step", "until").distinct()).join(F.broadcast(leagues))
    plan = sides.groupBy("epoch").agg(F.min(F.unix_date("date")).alias("lo"), F.max(F.unix_date("date")).alias("hi")).orderBy("epoch").collect()
    held = state.select("team_id", "league", *[(F.col(n) if n in state.columns else F.lit({"m1_value": 0.0}.get(n))).cast("double").alias(n) for n in STATE])
    held = durable(held.withColumn("published_index", F.coalesce("published_index", "b_value")))
    for e in plan:
        folder = f"{root}/epoch={e.epoch}"
        if not _written(spark, folder):
            due, clock = (x.where(F.col("epoch") == e.epoch) for x in (sides, clocks))
            rows = _epoch_rows(due, games, nexts, held, clock, e.lo, e.hi)
            _sorted(rows).mapInPandas(_walks(every is None), OUT).write.mode("overwrite").parquet(folder)
        states = spark.read.schema(OUT).parquet(folder).where("kind = 'state'")
        held = states.select("team_id", "league", *[F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]).alias(n) for i, n in enumerate(STATE)])
    empty = spark.createDataFrame([], OUT)
    done = spark.read.schema(OUT).parquet(*[f"{root}/epoch={e.epoch}" for e in plan]) if plan else empty
    value = [F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]).alias(n) for i, n in enumerate(STATE)]
    return {
        "state": held,
        "log": done.where("kind = 'log'").select("step", "league", "fixture_id", "team_id", "e_kr", F.col("s").alias("actual_score_s"), "b_before", "delta_b"),
        "history": done.where("kind = 'history'").select("step", "league", "team_id", *value),
    }


def _written(spark, folder: str) -> bool:
    """Whether a folder was written to its end: Spark leaves a mark there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
