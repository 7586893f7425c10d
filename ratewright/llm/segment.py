"""Sampled sentencepiece encodings without replacement, and their decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice, weighted by exp(alpha * sum of piece scores).
Adding Gumbel noise to every path's log-probability and taking the k greatest draws k different paths in turn, each from
what is left. A-star search finds them without listing paths: a region (all paths that share a beginning and avoid one
continuation) has an exact log-probability from the lattice's backward sums, so the greatest noisy value in it can be
drawn at once, below that of the region it was cut from. The best region is popped, its best path is drawn from its
beginning on, and the rest of it falls into smaller regions, one for each step of that path. The (k+1)-th noisy value is
the threshold from which each drawn path's inclusion probability follows.

No piece of the vocabulary runs from one word to the next, so a text's lattice is a row of word lattices; a worker lays out
each distinct word once while its memory of lattices lasts, and all rows of a slice take their steps together. All noise
comes from the row's key, so a row is segmented alike wherever and whenever it is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from ratewright.llm.common import mix, slices
from ratewright.llm.tokens import MARK

STRIDE = np.uint64(0x589965CC75374CC3)
#: What a character outside the vocabulary costs beyond the rarest piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Characters of words whose lattices a worker keeps from slice to slice; beyond that it starts anew.
KEPT_CHARS = 1 << 20
#: Words laid out at once, so that the arrays at work stay in the processor's cache.
BLOCK_WORDS = 1 << 12
#: Times that beginnings of pieces draw room among others in the trie's arrays.
ROUNDS = 64
#: Steps of a path that are looked at first for the regions beside it; more only where they don't settle which are best.
FIRST_STEPS = 64
#: No logarithm of Gumbel noise drawn from 53 bits lies below this.
LEAST_EXPONENT = -37.5


class Vocabulary:
    """Pieces by length; a trie of them; scores; and what each id decodes to.

    A state of the trie is the place of its last character in two arrays: the state reached from ``s`` by a character of
    class c is ``base[s] + c``, if ``parent`` there says s. All places of a block of words step through it together.
    """

    def __init__(self, path: str):
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece runs from one word to the next")
        score = np.array([s for _, _, s in normal])
        if model.trainer_spec.model_type == 2:
            # Merge scores are ranks, not log-probabilities: take Zipf's law for the rank.
            rank = np.empty(len(score))
            rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
            score = -np.log(rank + 1) - np.log(np.sum(1 / np.arange(1, len(score) + 1)))
        self.unknown = float(score.min()) - UNKNOWN_PENALTY
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.ascii_ids = np.array([self.byte_ids.get(b, self.unk) for b in range(128)], dtype=np.int32)
        # What ids decode to; a byte piece gives its byte, control pieces nothing.
        self.bytes = [p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in model.pieces]
        self.bytes_of = np.empty(len(self.bytes), dtype=object)
        self.bytes_of[:] = self.bytes
        self.pieces = pa.array(self.bytes, pa.large_binary())
        self._grow_trie([p.replace(MARK, " ") for _, p, _ in normal])
        self.piece, self.score = np.full(len(self.base), -1, dtype=np.int32), np.zeros(len(self.base))
        self.piece[self.states], self.score[self.states] = [i for i, _, _ in normal], score
        # The root stands for a character outside the vocabulary.
        self.length, self.score[0] = np.ones(len(self.base), dtype=np.int64), self.unknown
        self.length[self.states] = [len(p) for _, p, _ in normal]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(p) for _, p, _ in normal])
        for n in sorted(set(lengths.tolist())):
            of = np.flatnonzero(lengths == n)
            self.by_length[n] = self.states[of], np.array([normal[i][0] for i in of], dtype=np.int32), score[of]

    def _grow_trie(self, pieces: list[str]) -> None:
        """Fill class_of, base, parent and the pieces' states. Beginnings with the most continuations draw their room first."""
        number, above, last = {"": 0}, [], []
        for p in pieces:
            for n in range(1, len(p) + 1):
                if p[:n] not in number:
                    above.append(number[p[: n - 1]])
                    last.append(ord(p[n - 1]))
                    number[p[:n]] = len(number)
        alphabet, kind = np.unique(np.array(last, dtype=np.int64), return_inverse=True)
        # Class 0, of characters outside the alphabet, is no child's; place 0 is the root's.
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[alphabet] = np.arange(1, len(alphabet) + 1)
        above, kind, span = np.array(above, dtype=np.int64), kind.astype(np.int64) + 1, len(alphabet) + 1
        order = np.argsort(above, kind="stable")
        degree = np.bincount(above, minlength=len(number))
        first = np.cumsum(degree) - degree
        room = 1 << (2 * len(number)).bit_length()
        taken = np.zeros(room + span, dtype=bool)
        taken[0] = True
        base, place, random = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64), np.random.default_rng(0)
        for some in (np.flatnonzero((degree >= lo) & (degree < hi)) for lo, hi in ((64, 1 << 30), (16, 64), (4, 16), (1, 4))):
            rounds = 0
            while len(some):
                count = degree[some]
                owner = np.repeat(np.arange(len(some)), count)
                child = order[np.arange(len(owner)) + np.repeat(first[some] - (np.cumsum(count) - count), count)]
                if rounds < ROUNDS:
                    base[some] = random.integers(0, room, len(some))
                else:
                    # What found no room among the others gets its own.
                    base[some] = len(taken) + np.arange(len(some)) * span
                    taken = np.concatenate([taken, np.zeros(len(some) * span, dtype=bool)])
                rounds += 1
                to = base[some][owner] + kind[child]
                # Of several that want a place the first may have it; each needs all of its places.
                winner = np.full(len(taken), len(some))
                np.minimum.at(winner, to, owner)
                lost = np.bincount(owner, taken[to] | (winner[to] != owner), minlength=len(some)) > 0
                kept = ~lost[owner]
                taken[to[kept]] = True
                place[child[kept] + 1] = to[kept]
                some = some[lost]
        self.base, self.parent = np.zeros(len(taken), dtype=np.int32), np.full(len(taken), -1, dtype=np.int32)
        self.base[place] = base
        self.parent[place[1:]] = place[above]
        self.states = place[[number[p] for p in pieces]]

    def decode(self, ids) -> bytes:
        """The text of an encoding: pieces joined, word marks as spaces, the first one left out."""
        raw = b"".join(self.bytes_of[np.asarray(ids, dtype=np.int64)].tolist())
        return raw[1:] if raw[:1] == b" " else raw

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The texts of encodings that lie one after the other."""
        found = self.pieces.take(pa.array(ids, pa.int32()))
        bounds = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset + cuts].tolist() if len(ids) else [0] * len(cuts)
        raw = memoryview(found.buffers()[2] or b"")
        return [bytes(raw[a + 1 : b] if a < b and raw[a] == 32 else raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Lattices of distinct words side by side, more added as they come.

    Word c's nodes run from start[c] to end[c]; edges are sorted by their node. ``reach`` sums the chances of a node's edges
    up to each one. What a word's lattice holds doesn't depend on the words beside it.
    """

    def __init__(self, words: list[str], vocab: Vocabulary, alpha: float):
        self.vocab, self.alpha = vocab, alpha
        self.room: dict[str, np.ndarray] = {}
        self.forget()
        self.add(words)

    def forget(self) -> None:
        """Start without words, in the same room."""
        self.of = self.target = self.piece = np.empty(0, dtype=np.int32)
        self.start = self.end = np.empty(0, dtype=np.int64)
        self.first, self.log_q, self.reach = np.zeros(1, dtype=np.int64), np.empty(0), np.empty(0)
        self.chars = 0

    def add(self, words: list[str]) -> None:
        arrays = {name: [] for name in ("of", "target", "piece", "log_q", "reach", "first", "start", "end")}
        nodes, edges = len(self.first) - 1, len(self.of)
        for i in range(0, len(words), BLOCK_WORDS):
            some = words[i : i + BLOCK_WORDS]
            of, target, piece, log_q, reach, first, start, end = self._laid_out(some)
            found = (of + nodes).astype(np.int32), (target + nodes).astype(np.int32), piece.astype(np.int32), log_q, reach, first[1:] + edges, start + nodes, end + nodes
            for parts, more in zip(arrays.values(), found, strict=True):
                parts.append(more)
            nodes, edges, self.chars = nodes + len(first) - 1, edges + len(of), self.chars + len(first) - 1 - len(some)
        for name, parts in arrays.items():
            self._append(name, parts)

    def _append(self, name: str, parts: list[np.ndarray]) -> None:
        """Lengthen an array within its room, which at least doubles when it is full."""
        now = getattr(self, name)
        at = len(now)
        size = at + sum(map(len, parts))
        room = self.room.get(name, now)
        if len(room) < size:
            room = self.room[name] = np.empty(max(size, 2 * len(room)), dtype=now.dtype)
        if not np.shares_memory(room, now):
            room[:at] = now
        for x in parts:
            room[at : at + len(x)] = x
            at += len(x)
        setattr(self, name, room[:size])

    def _laid_out(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """of, target, piece, log_q, reach, first, start and end of these words alone."""
        vocab, alpha = self.vocab, self.alpha
        length = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        n = len(chars)
        ends = np.cumsum(length)
        left = np.repeat(ends, length) - np.arange(n)
        node = np.arange(n) + np.repeat(np.arange(len(words)), length)
        kind = vocab.class_of[chars]
        nodes = n + len(words)
        degree = np.zeros(nodes, dtype=np.int64)
        found, at, state, size = [], np.arange(n), np.zeros(n, dtype=np.int32), 0
        single = np.zeros(n, dtype=bool)
        while len(at):
            to = vocab.base[state] + kind[at + size]
            going = np.flatnonzero(vocab.parent[to] == state)
            at, state, size = at[going], to[going], size + 1
            hit = np.flatnonzero(vocab.piece[state] >= 0)
            p = at[hit]
            if size == 1:
                single[p] = True
            found.append((node[p], state[hit]))
            degree[found[-1][0]] += 1
            more = np.flatnonzero(left[at] > size)
            at, state = at[more], state[more]
        # A character outside the vocabulary is spelt in bytes: -1 less its code point.
        alone = np.flatnonzero(~single)
        found.append((node[alone], 0))
        degree[node[alone]] += 1
        # Longest pieces first: they are the likelier ones, so choosing mostly ends at a node's first edge.
        first = np.concatenate([[0], np.cumsum(degree)])
        of, free = np.repeat(np.arange(nodes), degree), first[:-1].copy()
        by_state = np.empty(len(of), dtype=np.int32)
        for source, states in reversed(found):
            by_state[free[source]] = states
            free[source] += 1
        target, piece, weight = of + vocab.length[by_state], vocab.piece[by_state], alpha * vocab.score[by_state]
        piece[first[node[alone]]] = -1 - chars[alone].astype(np.int32)
        start = np.concatenate([[0], ends[:-1]]) + np.arange(len(words)) if len(words) else ends
        end = start + length
        # Backward log sums, all nodes at one distance from their word's end together.
        distance = np.zeros(nodes, dtype=np.int64)
        distance[node] = left
        top = int(distance.max(initial=0))
        by = np.argsort(distance.astype(np.uint16) if top < 1 << 16 else distance, kind="stable")
        cuts = np.searchsorted(distance[by], np.arange(top + 2))
        count = degree[by]
        begin = np.concatenate([[0], np.cumsum(count)])
        edges = np.arange(len(of)) + np.repeat(first[by] - begin[:-1], count)
        far, near = target[edges], weight[edges]
        beta = np.zeros(nodes)
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            lo, hi = begin[a], begin[b]
            t = near[lo:hi] + beta[far[lo:hi]]
            top = np.maximum.reduceat(t, begin[a:b] - lo)
            beta[by[a:b]] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, count[a:b])), begin[a:b] - lo))
        log_q = np.minimum(weight + beta[target] - beta[of], 0.0)
        reach, some, j = np.exp(log_q), np.flatnonzero(degree > 1), 1
        while len(some):
            reach[first[some] + j] += reach[first[some] + j - 1]
            j += 1
            some = some[degree[some] > j]
        return of, target, piece, log_q, reach, first, start, end

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by chance."""
        e = self.first[node]
        going = np.flatnonzero(u >= self.reach[e])
        now, last, u = e[going], self.first[node[going] + 1] - 1, u[going]
        while len(going):
            more = np.flatnonzero((u >= self.reach[now]) & (now < last))
            e[going] = now
            going, now, last, u = going[more], now[more] + 1, last[more], u[more]
        return e

    def walk(self, node: np.ndarray, end: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from nodes to ends: steps of each walker, and edges in the order of walkers and steps. Noise: a number for each walker."""
        steps, taken, active, step = np.zeros(len(node), dtype=np.int64), [], np.flatnonzero(node < end), 0
        node = node.copy()
        while len(active):
            e = self.choose(node[active], uniform(noise[active] + np.uint64(step)))
            taken.append((active, e))
            to = self.target[e]
            node[active] = to
            step += 1
            steps[active] = step
            active = active[to < end[active]]
        begin = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), dtype=np.int64)
        for step, (who, e) in enumerate(taken):
            edges[begin[who] + step] = e
        return steps, edges


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers within (0, 1) from 64-bit counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def exponents(place, u):
    """Logs of the exponential variables behind Gumbel noise at log masses ``place``: the smaller, the greater the noise."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.log(-np.log(u)) - place


def below(bound, exponent):
    """Gumbel noise of an exponent, given that it lies below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return -np.logaddexp(-bound, exponent)


@dataclass
class Path:
    edges: np.ndarray
    #: Word each edge belongs to, by its place in the row.
    word: np.ndarray
    log_prob: float
    noisy: float


@dataclass
class Row:
    """The search of one row."""

    seed: int
    words: np.ndarray
    paths: list[Path] = field(default_factory=list)
    #: (-noisy value, tie, path, step, edges to avoid there, log mass of the beginning)
    regions: list[tuple] = field(default_factory=list)

    def noise(self, leaf: int, purpose: int, n: int) -> np.ndarray:
        start = (self.seed + leaf * 0xA0761D6478BD642F + purpose * 0xE7037ED1A0B428DB) & (1 << 64) - 1
        return np.uint64(start) + np.arange(n, dtype=np.uint64) * STRIDE


def _cut_up(rows: list[Row], leaf: int, lattices: Lattices, since: list[int], avoided: list[tuple], k: int) -> None:
    """Push the regions beside each row's newest path from a step on: as many of the best as can still be popped.

    A region's mass falls with every step before it, and noise is bounded, so the first steps mostly hold the best ones;
    rows where later steps might reach them are looked at again, further on.
    """
    before = []
    for row in rows:
        # Sums run row by row, so that a row's values don't depend on the rows beside it.
        run = np.cumsum(lattices.log_q[row.paths[-1].edges])
        row.paths[-1].log_prob = float(run[-1]) if len(run) else 0.0
        before.append(np.concatenate([[0.0], run]))
    todo = [x for x in zip(rows, since, avoided, before, strict=True) if len(x[0].paths) <= k and len(x[0].paths[-1].edges) > x[1]]
    steps = FIRST_STEPS
    while todo:
        again = []
        for x, exponent in zip(todo, _beside(todo, leaf, lattices, steps), strict=True):
            row, a, shut, run = x
            edges, noisy, seen = row.paths[-1].edges, row.paths[-1].noisy, len(exponent)
            want = min(k + 1 - len(row.paths), len(edges) - a)
            if a + seen < len(edges) and (seen < want or np.partition(exponent, want - 1)[want - 1] >= LEAST_EXPONENT - run[a + seen]):
                again.append(x)
                continue
            for j in np.argpartition(exponent, want - 1)[:want].tolist():
                if exponent[j] < np.inf:
                    value, e = float(below(noisy, exponent[j])), int(edges[a + j])
                    heapq.heappush(row.regions, (-value, leaf, len(row.regions), len(row.paths) - 1, a + j, (*shut, e) if j == 0 else (e,), float(run[a + j])))
        steps, todo = 16 * steps, again


def _beside(some: list[tuple], leaf: int, lattices: Lattices, steps: int) -> Iterator[np.ndarray]:
    """For each (row, step, edges to avoid there, log masses of beginnings) the exponents of the regions beside its newest path, so many steps from that one on."""
    tails = [row.paths[-1].edges[a : a + steps] for row, a, _, _ in some]
    count = np.array([len(t) for t in tails])
    cuts = np.concatenate([[0], np.cumsum(count)])
    e = np.concatenate(tails)
    log_q, node = lattices.log_q[e], lattices.of[e]
    with np.errstate(divide="ignore"):
        aside = np.log1p(-np.minimum(np.exp(log_q), 1.0))
    # An only continuation leaves nothing beside it, whatever rounding says.
    aside[lattices.first[node + 1] - lattices.first[node] == 1] = -np.inf
    for at, (_, _, avoided, _) in zip(cuts.tolist(), some, strict=False):
        if avoided:
            shut = {*avoided, int(e[at])}
            rest = [x for x in range(int(lattices.first[node[at]]), int(lattices.first[node[at] + 1])) if x not in shut]
            aside[at] = np.log(np.exp(lattices.log_q[rest]).sum()) if rest else -np.inf
    place = np.concatenate([run[a : a + len(t)] for (_, a, _, run), t in zip(some, tails, strict=True)]) + aside
    begin = np.array([row.noise(leaf, 1, 1)[0] for row, _, _, _ in some], dtype=np.uint64)
    step = (np.arange(len(e)) - np.repeat(cuts[:-1], count)).astype(np.uint64)
    exponent = exponents(place, uniform(np.repeat(begin, count) + step * STRIDE))
    exponent[~np.isfinite(place)] = np.inf
    yield from np.split(exponent, cuts[1:-1])


def search(rows: list[Row], lattices: Lattices, k: int) -> None:
    """Fill each row's k best noisy paths, fewer if it has fewer."""
    for leaf in range(k):
        nodes, ends, noise, heads = [], [], [], {}
        for r, row in enumerate(rows):
            if leaf == 0:
                skip, first = 0, None
                noisy = float(-np.log(-np.log(uniform(row.noise(0, 2, 1))[0])))
                heads[r] = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), noisy, 0, ())
            elif row.regions:
                value, _, _, parent, step, avoided, _ = heapq.heappop(row.regions)
                old = row.paths[parent]
                some = old.edges[step]
                node = int(lattices.of[some])
                edges = [x for x in range(int(lattices.first[node]), int(lattices.first[node + 1])) if x not in avoided]
                chance = np.cumsum(np.exp(lattices.log_q[edges]))
                edge = edges[min(int(np.searchsorted(chance, uniform(row.noise(leaf, 3, 1))[0] * chance[-1], side="right")), len(edges) - 1)]
                skip, first = int(old.word[step]), int(lattices.target[edge])
                heads[r] = (np.append(old.edges[:step], edge), np.append(old.word[:step], skip), -value, step, avoided)
            else:
                continue
            words = row.words[skip:]
            begin = lattices.start[words]
            if first is not None:
                begin = begin.copy()
                begin[0] = first
            nodes.append(begin)
            ends.append(lattices.end[words])
            noise.append(row.noise(leaf, 4, len(row.words))[skip:])
        if not heads:
            return
        count = np.cumsum([0, *map(len, nodes)])
        steps, edges = lattices.walk(np.concatenate(nodes), np.concatenate(ends), mix(np.concatenate(noise)))
        bounds = np.concatenate([[0], np.cumsum(steps)])[count].tolist()
        for i, (r, (head, head_words, noisy, _, _)) in enumerate(heads.items()):
            row, tail = rows[r], edges[bounds[i] : bounds[i + 1]]
            of = steps[count[i] : count[i + 1]]
            word = np.repeat(np.arange(len(row.words) - len(of), len(row.words)), of)
            row.paths.append(Path(np.concatenate([head, tail]), np.concatenate([head_words, word]), 0.0, noisy))
        _cut_up([rows[r] for r in heads], leaf, lattices, [h[3] for h in heads.values()], [h[4] for h in heads.values()], k)


def spelt(pieces: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of pieces, characters outside the vocabulary as their bytes."""
    outside = np.flatnonzero(pieces < 0)
    if not len(outside):
        return pieces.astype(np.int32)
    code = -1 - pieces[outside]
    if code.max() < 128:
        out = pieces.astype(np.int32)
        out[outside] = vocab.ascii_ids[code]
        return out
    spelling = [np.array([vocab.byte_ids.get(b, vocab.unk) for b in chr(c).encode()], dtype=np.int32) for c in code.tolist()]
    cut = np.split(pieces.astype(np.int32), outside)
    return np.concatenate([cut[0], *(x for s, c in zip(spelling, cut[1:], strict=True) for x in (s, c[1:]))])


class Sampler:
    """Samples encodings slice by slice and remembers the lattices of words that it has met."""

    def __init__(self, vocab: Vocabulary, k: int, alpha: float, seed: int):
        self.vocab, self.k, self.alpha, self.seed = vocab, k, alpha, seed
        self.numbers: dict[str, int] = {}
        self.lattices = Lattices([], vocab, alpha)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words: spaces and what follows them, as a space before the text has it."""
        raw = [b" " + t.replace(MARK, " ").encode() if t else b"" for t in texts]
        data = b"".join(raw)
        space = np.frombuffer(data, dtype=np.uint8) == 32
        bounds = np.cumsum([0, *map(len, raw)])
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        begin = np.flatnonzero(begins)
        # Only different words meet the memory.
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.numbers.get, different, repeat(-1)), dtype=np.int64, count=len(different))
        new, known = np.flatnonzero(number < 0), len(self.numbers)
        number[new] = np.arange(known, known + len(new))
        self.numbers.update(zip(different[new].tolist(), number[new].tolist(), strict=True))
        return np.split(number[words.indices.to_numpy()], np.searchsorted(begin, bounds[1:-1])) if texts else []

    def segmented(self, texts: list[str], keys: list) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its sampled encodings: (ids, log-probability, noisy value, log of the inclusion probability), best noisy value first."""
        if self.lattices.chars > KEPT_CHARS:
            self.numbers.clear()
            self.lattices.forget()
        known = len(self.numbers)
        rows = [Row(xxhash.xxh64_intdigest(f"{self.seed}|{key}"), words) for key, words in zip(keys, self._words(texts), strict=True)]
        self.lattices.add(list(islice(self.numbers, known, None)))
        search(rows, self.lattices, self.k)
        out = []
        for row in rows:
            threshold = -row.regions[0][0] if row.regions else -np.inf
            out.append([(spelt(self.lattices.piece[p.edges], self.vocab), p.log_prob, p.noisy, log_inclusion(p.log_prob - threshold)) for p in row.paths])
        return out


@lru_cache(maxsize=1)
def sampler(path: str, k: int, alpha: float, seed: int) -> Sampler:
    """The worker's own sampler: its memory lasts from task to task."""
    return Sampler(vocabulary(path), k, alpha, seed)


def segmented(texts: list[str], keys: list, vocab: Vocabulary, k: int, alpha: float, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The sampled encodings of each text by themselves."""
    return Sampler(vocab, k, alpha, seed).segmented(texts, keys)


def log_inclusion(above: float) -> float:
    """Log of the chance that a path is drawn, 1 - exp(-exp(above)), from how far its log-probability lies above the threshold."""
    return above if above < -30 else float(np.log(-np.expm1(-np.exp(min(above, 700.0)))))


SAMPLES = "array<struct<ids: array<int>, log_prob: double, noisy: double, log_inclusion: double>>"


def sampled(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 0.5, seed: int = 1, model: str = "piece_bpe_32k.model") -> DataFrame:
    """All columns of ``df`` with samples, k different encodings of the whole text (fewer if it has fewer), and round_trip.

    Each sample has its ids, its log-probability, its noisy value and the log of the
    probability that it is among the k (probabilities of long texts are too small for a number). ``round_trip`` says that every sample decodes to the text. The noise depends on ``seed`` and the
    row's key alone, so repeated rows come out alike. A null or empty text has one encoding, the empty one. A literal word
    mark in a text is read as a space, as the library does, and fails the round trip. An empty table gives an empty one;
    columns of ``df`` named samples or round_trip are replaced.
    """
    df = df.select(*[c for c in df.columns if c.lower() not in ("samples", "round_trip")])
    at_text, at_key = df.columns.index(text), df.columns.index(key)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], f"samples {SAMPLES}", "round_trip boolean"])
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("noisy", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = sampler(public_tokenizers.path(model), k, alpha, seed)
        vocab = memory.vocab
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            found = memory.segmented(texts, batch.column(at_key).to_pylist())
            cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = [s for samples in found for s in samples]
            ids, bounds = np.concatenate([s[0] for s in flat]) if flat else np.empty(0, dtype=np.int32), np.cumsum([0, *(len(s[0]) for s in flat)])
            spelt_out = iter(vocab.decode_all(ids, bounds))
            good = [all([next(spelt_out) == whole for _ in samples]) for whole, samples in zip((t.encode() for t in texts), found, strict=True)]
            first = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            rest = [pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)]
            samples = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([first, *rest], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns, samples, pa.array(good, pa.bool_())], names=[*batch.schema.names, "samples", "round_trip"])

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """All columns of ``df`` with decoded, the text of a column of ids; null ids give null, bytes that are no UTF-8 a replacement mark."""
    df = df.select(*[c for c in df.columns if c.lower() != "decoded"])
    at = df.columns.index(ids)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(public_tokenizers.path(model))
        for batch in batches:
            texts = [None if x is None else vocab.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def encoder(model: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own encoder of the same vocabulary."""
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
