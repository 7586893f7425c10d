"""Keyed state machines over streams: what is held per key lives in Spark's state store, and event-time timers act at kickoff."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

FROZEN_QUOTE = "fixture_id long, bookmaker string, snapshot_us long, home_odds double, draw_odds double, away_odds double"


class KickoffFreeze(StatefulProcessor):
    """Per kickoff: the latest quote of each of its fixtures' books, given out once by a timer at that time; nothing after that counts.

    The key is kickoff_us, as fixtures that start together are frozen by one timer. Input: fixture_id, kickoff_us,
    snapshot_us, bookmaker and three odds, quotes before kickoff only. A group's rows come in chunks and are reduced to one
    quote per fixture and book, so a fixture may have any number of rows. After it a kickoff keeps a mark and no quotes.
    """

    NAMES = [x.split()[0] for x in FROZEN_QUOTE.split(", ")]
    KEY, ODDS = ["fixture_id", "bookmaker"], ["home_odds", "draw_odds", "away_odds"]

    def init(self, handle) -> None:
        self.handle = handle
        arrays = [f"{n} array<{kind}>" for n, kind in (x.split() for x in FROZEN_QUOTE.split(", "))]
        self.held = handle.getValueState("held", ", ".join(["done boolean", *arrays]))

    def handleInputRows(self, key, rows, timerValues):
        old = self.held.get()
        if old is not None and old[0]:
            return
        best = [] if old is None else [pd.DataFrame(dict(zip(self.NAMES, old[1:])))]
        for pdf in rows:
            both = pd.concat([*best, pdf[self.NAMES]]) if best else pdf[self.NAMES]
            best = [both.sort_values(["snapshot_us", *self.ODDS]).drop_duplicates(self.KEY, keep="last")]
        if old is None:
            self.handle.registerTimer(int(key[0]) // 1000)
        self.held.update((False, *[best[0][n].tolist() for n in self.NAMES]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, *columns = self.held.get()
        self.held.update((True, *[[] for _ in self.NAMES]))
        yield pd.DataFrame(dict(zip(self.NAMES, columns)))

    def close(self) -> None:
        pass


#: Stands for a null among whole numbers; it comes after all others.
NONE = int(np.iinfo(np.int64).max)
LOCK_EVENT = "team string, us long, seq long, event string, r_market_frozen double, m1_locked double"


class KickoffLocks(StatefulProcessor):
    """Per team: market rating and M1 locked at kickoff, once until a settlement clears them.

    Input rows have team, us (event time), seq (order among equal times) and a kind:
    ``market`` r_market and m1_value from now on; ``fixture`` a start at kickoff_us, a timer being set for the next one;
    ``kickoff`` a start seen now, with or without values of its own; ``settlement``.
    A team's rows of one micro-batch are put in order in memory, as numbers; between batches only a few are kept. Starts that
    lie before a row are dealt with before that row, so the result does not depend on how the stream is cut into batches.
    """

    KINDS = {"fixture": 0, "kickoff": 1, "settlement": 2}
    #: Rows walked, and events given out, at once.
    SLAB = 1 << 16

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "locked boolean, r_market double, m1_value double, frozen double, m1_locked double, starts array<long>")

    def _begin(self, us, seq):
        """A start: locks the values, unless they are locked already."""
        if not self.locked:
            self.locked, self.frozen, self.m1_locked = True, self.market, self.m1
            self.out.append((us, seq, "frozen", self.frozen, self.m1_locked))

    def _due(self, us):
        while self.starts and self.starts[0] <= us:
            self._begin(self.starts.pop(0), -1)

    def _load(self):
        held = self.held.get()
        self.locked, self.market, self.m1, self.frozen, self.m1_locked, self.starts = held or (False, None, None, None, None, [])
        self.starts, self.out = sorted(self.starts), []

    def _save(self):
        if self.starts:
            self.handle.registerTimer(self.starts[0] // 1000)
        self.held.update((self.locked, self.market, self.m1, self.frozen, self.m1_locked, self.starts))

    def _events(self, key):
        out, self.out = self.out, []
        return pd.DataFrame([(key[0], *x) for x in out], columns=["team", "us", "seq", "event", "r_market_frozen", "m1_locked"])

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        # A row is held as six numbers; as Python objects, all of a team's rows would take ten times as much.
        whole, values = [], []
        for pdf in rows:
            kinds = pdf["kind"].map(self.KINDS).fillna(len(self.KINDS))
            numbers = [np.where(pdf[n].isna(), NONE, pdf[n].fillna(0).to_numpy(dtype=np.int64)) for n in ("us", "seq", "kickoff_us")]
            whole.append(np.stack([*numbers, kinds.to_numpy(dtype=np.int64)]))
            values.append(np.stack([pdf[n].to_numpy(dtype=float) for n in ("r_market", "m1_value")]))
        whole, values = np.concatenate(whole, axis=1), np.concatenate(values, axis=1)
        order = np.lexsort((whole[1], whole[0]))
        for lo in range(0, len(order), self.SLAB):
            part = order[lo : lo + self.SLAB]
            for us, seq, kickoff, kind, market, m1 in zip(*whole[:, part].tolist(), *values[:, part].tolist()):
                self._row(None if us == NONE else us, None if seq == NONE else seq, kind, market, m1, kickoff)
            yield self._events(key)
        self._save()

    def _row(self, us, seq, kind, market, m1, kickoff):
        if us is not None:
            self._due(us)
        if kind == self.KINDS["fixture"]:
            if kickoff != NONE:
                insort(self.starts, kickoff)
            return
        if kind != self.KINDS["settlement"] and market == market:
            self.market, self.m1 = market, m1 if m1 == m1 else self.m1
        if kind == self.KINDS["kickoff"]:
            self._begin(us, seq)
        elif kind == self.KINDS["settlement"] and self.locked:
            self.out.append((us, seq, "cleared", self.frozen, self.m1_locked))
            self.locked, self.frozen, self.m1_locked = False, None, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        self._due(timerValues.getCurrentWatermarkInMs() * 1000)
        self._save()
        yield self._events(key)

    def close(self) -> None:
        pass
