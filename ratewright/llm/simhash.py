"""SimHash near-duplicates: fingerprints, exact tiled comparison, classes.

Distinct fingerprints are laid in tiles by population counts. Two fingerprints that differ in at most r bits have counts
that differ by at most r in all, so a tile meets only the tiles whose counts lie that near; all other pairs of tiles are
skipped. For short radii the counts are those of the four 16-bit parts, which skip most pairs; else the whole count in
bands of r + 1. Pairs of tiles are compared whole, with exclusive-or and bit counts. Nothing is sampled or approximated:
every pair within the radius is found.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import mix, slices, stored, texts_of
from ratewright.llm.links import components, forest

#: Fingerprints in one tile, about: a 256th of all, within bounds. Fuller tiles are cut, and their pieces meet one another.
TILES, LEAST_TILE, MOST_TILE = 256, 16_384, 1 << 20
#: Pairs compared at once.
SLAB = 1 << 19
#: Radius from which all four words are compared at once.
WIDE = 60
#: Longest radius whose tiles go by the counts of four parts.
PARTED = 3
#: Hashes of one text whose bits are summed at once.
ROWS = 1 << 14
#: Texts of a class whose shingles are compared in one task.
PIECE = 1024
#: Band keys of a set of shingles, and the smallest images that make one up.
BANDS, ROWS_A_BAND = 20, 3
#: How often a fingerprint's bits are dealt into bands, the bits of a band, and those of them that name its cell.
TURNS, BAND_BITS, CELL_BITS = 2, 20, 8
#: Bits of a band nearest to even, which are read both ways: the fewer shingles, the more of them (size below which, bits).
UNSURE, MOST_UNSURE = 4, ((12, 7), (40, 5))
#: Rows of one cell that are compared in one task; fuller cells are cut into tiles.
BUCKET_TILE = 1 << 18
#: Rows that agree in a whole band and are compared pair by pair; of more, each found one leads on to those not found yet.
CROWD = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """Majority bits of the hashes of all word shingles, repeats included, in 64-bit words; no words give 0.

    The first word's hashes are XXH64 of the shingles; further words mix those anew.
    """
    return majority(shingle_hashes(text, shingle, seed), lanes)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle in text order; a shorter text is one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    spans = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(s), seed) for s in spans), dtype="<u8")


def balance(h: np.ndarray, lanes: int) -> np.ndarray:
    """Ones less zeros among the hashes, for each of the fingerprint's bits."""
    out = np.zeros((lanes, 64), dtype=np.int64)
    for lane in range(lanes if len(h) else 0):
        own = h if lane == 0 else mix(h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for i in range(0, len(own), ROWS):
            part = own[i : i + ROWS].view(np.uint8).reshape(-1, 8)
            out[lane] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = 2 * out[lane] - len(own)
    return out.ravel()


def majority(h: np.ndarray, lanes: int) -> np.ndarray:
    return packed(balance(h, lanes))


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprint words of bits' balances: a bit is 1 if ones prevail."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8")


def fingerprints(df: DataFrame, key: str, text: str, shingle: int, seed: int, lanes: int) -> DataFrame:
    """(key, fp array<long>): the fingerprint's bits as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.concatenate([fingerprint(t, shingle, seed, lanes) for t in texts_of(batch)]).view(np.int64)
            cuts = pa.array(np.arange(0, len(fps) + 1, lanes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(fps))], names=["key", "fp"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, fp array<long>")


def _cells(radius: int, lanes: int) -> tuple[Column, list[int]]:
    """A fingerprint's cell, and the steps from a cell to those it must meet, one of each pair of opposite ones."""
    if lanes == 1 and radius <= PARTED:
        # A part's count is 0 to 16: five bits hold it with room for a step beyond either end.
        parts = [F.bit_count(F.shiftrightunsigned(F.col("fp")[0], 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
        cell = sum(((p + radius).cast("long") * F.lit(32**i) for i, p in enumerate(parts)), F.lit(0).cast("long"))
        steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
        return cell, [sum(d * 32**i for i, d in enumerate(s)) for s in steps]
    count = sum((F.bit_count(F.col("fp")[i]) for i in range(lanes)), F.lit(0))
    return F.floor(count / (radius + 1)).cast("long"), [0, 1]


def near(one: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows (fingerprints by 64-bit words) that differ in at most radius bits."""
    found = []
    rows = max(1, SLAB // max(len(other), 1))
    for i in range(0, len(one), rows):
        part = one[i : i + rows]
        differ = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0])
        if part.shape[1] > 1:
            differ = differ + np.bitwise_count(part[:, None, 1] ^ other[None, :, 1])
        if part.shape[1] == 4 and radius > WIDE:
            # Two words tell little apart here; a sum of 256 wraps to 0 and is settled below.
            differ = differ + np.bitwise_count(part[:, None, 2] ^ other[None, :, 2])
            differ = differ + np.bitwise_count(part[:, None, 3] ^ other[None, :, 3])
        a, b = np.nonzero(differ <= radius)
        if part.shape[1] > 2:
            # What two words already tell apart needs no more of them.
            keep = np.bitwise_count(part[a] ^ other[b]).sum(axis=1, dtype=np.int64) <= radius
            a, b = a[keep], b[keep]
        found.append((a + i, b))
    return tuple(np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in zip(*found, strict=True))


def near_links(fps: DataFrame, radius: int, lanes: int = 1, tile: int | None = None) -> DataFrame:
    """(a, b) links between the nodes of distinct (fp, node) at most ``radius`` bits apart: enough of them to connect all that are linked."""
    cell, steps = _cells(radius, lanes)
    placed = fps.select("fp", "node", cell.alias("cell"))
    sizes = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tile = tile or min(max(total // TILES, LEAST_TILE), MOST_TILE)
    # There are 17^4 cells at most, so this table may be broadcast and no cell's rows meet in one task.
    cut = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / tile).cast("long").alias("cuts")))
    pieces = placed.join(cut, "cell").withColumn("piece", F.pmod(F.xxhash64("node"), "cuts"))
    tiles = pieces.groupBy("cell", "piece").agg(F.collect_list(F.struct("fp", "node")).alias("rows"))
    tiles = stored(tiles.select("cell", "piece", F.flatten("rows.fp").alias("fps"), F.col("rows.node").alias("nodes")), "tiles")
    # Pairs of tiles by name first; the fingerprints follow, each tile's to the pairs that it is in.
    names = sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / tile).cast("long") - 1)).alias("piece"))
    step = F.explode(F.array(*[F.lit(s).cast("long") for s in steps]))
    homes = names.select(F.col("cell").alias("home"), F.col("piece").alias("home_piece"), step.alias("step")).withColumn("cell", F.col("home") + F.col("step"))
    met = homes.join(names, "cell").where("step <> 0 or home_piece <= piece").select("home", "home_piece", "cell", "piece")
    own = tiles.select(F.col("cell").alias("home"), F.col("piece").alias("home_piece"), F.col("fps").alias("home_fps"), F.col("nodes").alias("home_nodes"))
    pairs = met.join(own, ["home", "home_piece"]).join(tiles, ["cell", "piece"])
    # A pair may be a task's work by itself, so they are dealt out one by one.
    pairs = pairs.repartition("home", "home_piece", "cell", "piece").select("home_fps", "home_nodes", "fps", "nodes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((2, 0), dtype=np.int64)]
            for row in range(batch.num_rows):
                one, one_nodes, other, other_nodes = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(4))
                a, b = near(one.view(np.uint64).reshape(-1, lanes), other.view(np.uint64).reshape(-1, lanes), radius)
                nodes, at = np.unique(np.concatenate([one_nodes[a], other_nodes[b]]), return_inverse=True)
                child, root = forest(len(nodes), at[: len(a)], at[len(a) :])
                found.append(np.stack([nodes[child], nodes[root]]))
            out = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def simhash_classes(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42, lanes: int = 1) -> DataFrame:
    """(key, fingerprint, component_id) of each row; component_id is the smallest key reachable over links of ``radius`` bits.

    Fingerprints have ``lanes`` 64-bit words. Null and wordless texts have fingerprint 0, which links like any other. Rows
    with equal fingerprints form one class, so repeated rows share it. A null key gets a row and is a component_id only
    if its class has no other. Keys are longs. An empty table gives an empty one; other columns are not read.
    """
    rows = stored(fingerprints(df, key, text, shingle, seed, lanes), "fingerprints")
    # One node for each distinct fingerprint: partial counts leave a hot one as one row a task. Numbers hold once written.
    nodes = stored(rows.groupBy("fp").agg(F.min("key").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    links = components(near_links(nodes, radius, lanes))
    named = nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "component").select("fp", "component_id"), "classes")
    hexed = F.concat(*[F.lower(F.lpad(F.hex(F.col("fp")[i]), 16, "0")) for i in range(lanes)])
    return rows.join(classes, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def alike_links(fps: tuple[np.ndarray, np.ndarray], sets: tuple[list, list], nodes: tuple[np.ndarray, np.ndarray], radius: int, share: float) -> list[tuple[int, int]]:
    """Links that connect all pairs, one row of each side, within the radius whose sets are alike."""
    names, at = np.unique(np.concatenate(nodes), return_inverse=True)
    left, right = at[: len(nodes[0])], at[len(nodes[0]) :]
    size = np.array([len(s) for s in sets[1]])
    values, owner = np.concatenate(sets[1]), np.repeat(np.arange(len(size)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root, links = np.arange(len(names)), []
    for i, own in enumerate(sets[0]):
        _, near_ = near(fps[0][i : i + 1], fps[1], radius)
        near_ = near_[root[right[near_]] != root[left[i]]]
        if not len(near_):
            continue
        # Rows of the other side by each of the row's shingles: how often a row comes is what they have in common.
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low
        places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        common = np.bincount(owner[places], minlength=len(size))[near_]
        for j in near_[common >= share * (len(own) + size[near_] - common)].tolist():
            if root[right[j]] != root[left[i]]:
                root[root == root[right[j]]] = root[left[i]]
                links.append((names[left[i]], names[right[j]]))
    return links


def band_keys(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """BANDS keys of each set, each from the ROWS_A_BAND smallest images of its members under as many orders; an empty set has keys of its own."""
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    turns = mix(np.arange(1, 2 * BANDS * ROWS_A_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    factors, shifts = turns[::2] | np.uint64(1), turns[1::2]
    filled = [i for i, s in enumerate(sets) if len(s)]
    out[[i for i, s in enumerate(sets) if not len(s)]] = mix(np.arange(BANDS, dtype=np.uint64))
    if filled:
        values = np.concatenate([sets[i] for i in filled])
        starts = np.cumsum([0, *[len(sets[i]) for i in filled[:-1]]])
        for band in range(BANDS):
            key = np.full(len(filled), band, dtype=np.uint64)
            for row in range(band * ROWS_A_BAND, (band + 1) * ROWS_A_BAND):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(values * factors[row] + shifts[row], starts))
            out[filled, band] = key
    return out


def within(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of one bucket (rows of a bucket follow one another) that differ in at most radius bits.

    A bucket's rows are laid out by population count, and distances beyond which all counts of a step differ by more than
    the radius are skipped.
    """
    count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.lexsort((count, bucket))
    bucket, fps, count = bucket[order], fps[order], count[order]
    found_a, found_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    at = np.arange(len(bucket))
    for k in range(1, len(bucket)):
        at = at[: np.searchsorted(at, len(bucket) - k)]
        # Counts rise within a bucket: a row whose k-th follower lies too far, or in another bucket, has no further one.
        at = at[(bucket[at] == bucket[at + k]) & (count[at + k] - count[at] <= radius)]
        if not len(at):
            break
        near_ = at[np.bitwise_count(fps[at] ^ fps[at + k]).sum(axis=1, dtype=np.int64) <= radius]
        found_a.append(order[near_])
        found_b.append(order[near_ + k])
    return np.concatenate(found_a), np.concatenate(found_b)


def bit_bands(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each text's bands of fingerprint bits, from its bits' balances and its number of shingles.

    A band is one number: its bits, and above them a mask of those nearest to even. What two texts differ in tips the bits
    that hang in the balance, so these are the ones to read both ways. All bits are dealt into bands, several times over.
    """
    n, bits = sums.shape
    rng = np.random.default_rng(bits)
    turns = [np.arange(bits), *[rng.permutation(bits) for _ in range(TURNS - 1)]]
    order = np.concatenate([t[: bits // BAND_BITS * BAND_BITS] for t in turns]).reshape(-1, BAND_BITS)
    dealt = sums[:, order]
    weight = np.int64(1) << np.arange(BAND_BITS)
    unsure = np.full(n, UNSURE)
    for below, m in reversed(MOST_UNSURE):
        unsure[sizes < below] = m
    # Of bits that are equally near, the first ones.
    near_even = np.abs(dealt) * BAND_BITS + np.arange(BAND_BITS)
    last = np.sort(near_even, axis=2)[np.arange(n), :, unsure - 1]
    return (dealt > 0) @ weight | (near_even <= last[:, :, None]) @ weight << BAND_BITS


def both_ways(names: np.ndarray, masks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, name): each name with its masked bits read either way, in all combinations."""
    at = np.arange(len(names))
    for bit in range(bits):
        turned = np.flatnonzero(masks[at] >> bit & 1)
        at, names = np.concatenate([at, at[turned]]), np.concatenate([names, names[turned] ^ (1 << bit)])
    return at, names


def cells(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of text, cell, rest): the cells that each text's bands lie in, and the bits and mask that the cell leaves open."""
    name, mask = bands & (1 << BAND_BITS) - 1, bands >> BAND_BITS
    low, left = (1 << CELL_BITS) - 1, BAND_BITS - CELL_BITS
    at, cell = both_ways((name & low).ravel(), (mask & low).ravel(), CELL_BITS)
    rest = (name >> CELL_BITS | mask >> CELL_BITS << left).ravel()[at]
    return at // bands.shape[1], at % bands.shape[1] << CELL_BITS | cell, rest


def led(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs of rows that differ in at most radius bits: who is found leads on to those not found yet."""
    left, found_a, found_b = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[one]).sum(axis=1, dtype=np.int64) <= radius
            hits, left = left[close], left[~close]
            found_a.append(np.full(len(hits), one))
            found_b.append(hits)
            queue.extend(hits.tolist())
    return tuple(np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (found_a, found_b))


def met(group: np.ndarray, rest: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that connect all pairs of a group (whose rows follow one another) that agree in the band and lie within the radius."""
    left = BAND_BITS - CELL_BITS
    at, key = both_ways(rest & (1 << left) - 1, rest >> left, left)
    bucket = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))[at] << left | key
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    n = np.diff(np.concatenate([starts, [len(bucket)]]))
    few = np.repeat((n > 1) & (n <= CROWD), n)
    a, b = within(bucket[few], fps[at[few]], radius)
    found_a, found_b = [at[few][a]], [at[few][b]]
    for i, size in zip(starts[n > CROWD].tolist(), n[n > CROWD].tolist(), strict=True):
        rows = at[i : i + size]
        a, b = led(fps[rows], radius)
        found_a.append(rows[a])
        found_b.append(rows[b])
    return np.concatenate(found_a), np.concatenate(found_b)


def banded_links(nodes: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b) links that connect all nodes of (node, fp, bands) that agree in a band's bits, but for those in the balance, and
    differ in at most radius bits.

    A band's first bits name a cell, whose rows meet in one task and are matched there by the others; a fuller cell is cut
    into tiles, which meet pair by pair.
    """

    def bands_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def words_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(cells(bands_of(batch, 0))[1], minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, cell, rest = cells(bands_of(batch, 2))
                fps = words_of(batch, 1)[at].view(np.int64)
                fp = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, lanes, dtype=np.int32)), pa.array(fps.ravel()))
                node = batch.column(0).to_numpy(zero_copy_only=False)[at]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node), pa.array(rest), fp], names=["cell", "node", "rest", "fp"])

    # There is a number of cells that no table changes, so what is known of the fuller ones may be broadcast.
    sizes = nodes.select("bands").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    fuller = stored(sizes.where(F.col("n") > BUCKET_TILE).select("cell", F.ceil(F.col("n") / BUCKET_TILE).cast("long").alias("cuts")), "fuller-cells")
    rows = nodes.select("node", "fp", "bands").mapInArrow(spread, "cell long, node long, rest long, fp array<long>")
    placed = rows.join(F.broadcast(fuller), "cell", "left").withColumn("piece", F.pmod(F.xxhash64("node"), "cuts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda k: k != F.col("piece"))
    pairs = F.transform(others, lambda k: F.least(k, "piece") * F.col("cuts") + F.greatest(k, "piece"))
    pair = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))
    dealt = placed.select("cell", pair.alias("pair"), "node", "rest", "fp").repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    dealt = dealt.select(F.xxhash64("cell", "pair").alias("group"), "node", "rest", "fp")

    def linked(nodes_a: np.ndarray, nodes_b: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([nodes_a, nodes_b]), return_inverse=True)
        child, root = forest(len(names), at[: len(nodes_a)], at[len(nodes_a) :])
        return pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[root])], names=["a", "b"])

    def match(held: list) -> pa.RecordBatch:
        group, node, rest, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = met(group, rest, fps, radius)
        return linked(node[a], node[b])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch's last group may go on in the next one.
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group, node, rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = words_of(batch, 3)
            cut = int(np.flatnonzero(group == group[-1])[0])
            if held and (cut or group[0] != held[-1][0][-1]):
                yield match([*held, (group[:cut], node[:cut], rest[:cut], fps[:cut])])
                held = []
            elif cut:
                yield match([(group[:cut], node[:cut], rest[:cut], fps[:cut])])
            held.append((group[cut:], node[cut:], rest[cut:], fps[cut:]))
        if held:
            yield match(held)

    return dealt.mapInArrow(inside, "a long, b long")


def shingle_classes(df: DataFrame, radius: int, share: float, key: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42, lanes: int = 4) -> DataFrame:
    """(key, component_id) of each row; component_id is the smallest key reachable over links.

    Texts link if they share at least ``share`` of their distinct word shingles. Candidates agree in a band of the bits of a
    fingerprint of distinct shingles, those in the balance read both ways, and differ in at most ``radius`` of all its bits;
    the shingles decide. Equal sets are one node; texts without words are alike, null texts among them. A null key gets a
    row, and is a component_id only if its class has no other. Other columns are not read.
    """

    def shingles(texts: list[bytes]) -> list[np.ndarray]:
        return [np.unique(shingle_hashes(t, shingle, seed)) for t in texts]

    def digests(sets: list[np.ndarray]) -> pa.Array:
        return pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(texts_of(batch))
            sums = np.stack([balance(s, lanes) for s in sets])
            bands = bit_bands(sums, np.array([len(s) for s in sets]))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (packed(sums).view(np.int64), bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), digests(sets), *lists], names=["key", "digest", "fp", "bands"])

    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(given.mapInArrow(describe, "key long, digest binary, fp array<long>, bands array<long>"), "described")
    # Equal digests have equal fingerprints and bands: any of them will do.
    nodes = rows.groupBy("digest").agg(F.min("key").alias("least"), F.min(F.struct("fp", "bands")).alias("_of"))
    nodes = stored(nodes.select("digest", "least", "_of.*").withColumn("node", F.monotonically_increasing_id()), "distinct")
    # Classes over candidates hold every link; texts that have no candidate are done.
    near_by = stored(components(banded_links(nodes.select("node", "fp", "bands"), radius, lanes)), "candidates")
    members = near_by.join(nodes.select("node", "digest", "least"), "node")
    cuts = near_by.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("cuts"))
    members = stored(members.join(cuts, "component"), "members")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(texts_of(batch))
            fps = np.concatenate([majority(s, lanes) for s in sets]).view(np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, lanes, dtype=np.int32)), pa.array(fps))
            yield pa.RecordBatch.from_arrays([digests(sets), fp, pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "fp", "set"])

    # Sets are worked out anew, for one row of each member alone: its smallest key's, or any where no row has a key.
    wanted = given.join(members.select(F.col("least").alias("key")).distinct(), "key", "left_semi")
    unkeyed = given.where("key is null")
    sets = wanted.unionByName(unkeyed).mapInArrow(again, "digest binary, fp array<long>, set binary")
    # Rows that repeat a set leave one a task, before they are moved to their members.
    once = sets.groupBy("digest").agg(F.min(F.struct("fp", "set")).alias("_of"))
    held = once.join(members.select("digest", "node", "component", "cuts"), "digest").select("node", "component", "cuts", "_of.fp", "_of.set")
    held = held.withColumn("piece", F.pmod(F.xxhash64("node"), "cuts"))
    grouped = held.groupBy("component", "piece", "cuts").agg(F.collect_list(F.struct("node", "fp", "set")).alias("rows"))

    def side(column):
        items = column.values
        fps = items.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
        return items.field("node").to_numpy(zero_copy_only=False), fps, [np.frombuffer(x, dtype="<u8") for x in items.field("set").to_pylist()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = side(batch.column(0)[row])
                (a, a_fps, a_sets), (b, b_fps, b_sets) = one, side(batch.column(1)[row]) if batch.num_columns > 1 else one
                found = alike_links((a_fps, b_fps), (a_sets, b_sets), (a, b), radius, share)
                yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # A class that fits a task meets itself there; only larger ones are cut into pieces that meet pair by pair.
    alone = grouped.where("cuts = 1").select("rows").mapInArrow(compare, "a long, b long")
    tiles = stored(grouped.where("cuts > 1"), "pieces")
    own = tiles.select("component", F.col("rows").alias("own_rows"), F.explode(F.sequence(F.col("piece"), F.col("cuts") - 1)).alias("piece"), F.col("piece").alias("own"))
    pairs = own.join(tiles.select("component", "piece", "rows"), ["component", "piece"])
    pairs = pairs.repartition("component", "own", "piece").select("own_rows", "rows")
    linked = components(alone.union(pairs.mapInArrow(compare, "a long, b long")))
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "component").select("digest", "component_id"), "classes")
    return rows.select("key", "digest").join(classes, "digest").select(F.col("key").alias(key), "component_id")
