"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection of blocks.

Sources, and the shards of each source, get whole blocks by the highest quotients target / (2 seats + 1). A shard lays
its documents end to end in seeded order and cuts them into equal blocks; its quota takes every block so many whole
times, and once more a run of blocks from a seeded place on, around the end. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import WORD, stored

#: Words in a block, blocks in a shard (about), and most times that a source's words may be taken.
BLOCK = 64
SHARD_BLOCKS = 1 << 14
REPEATS = 3


def draw(seed: str, *parts: Column) -> Column:
    """32 seeded bits of a key, as SQL engines have them in common."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weighted_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size): shares of all words by weight, none above REPEATS times its size.

    Weights repeat along sources by code point, null last. With x = REPEATS * size / weight, the sources of lowest x are
    those that stop at their limit; the level that the rest share is the first one that the next x reaches.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("long"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left_words = F.sum("source_size").over(everything) - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left_words / left_weight)
    level = F.min(F.when(F.col("level") * F.col("weight") <= REPEATS * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    stop = (REPEATS * F.col("source_size")).cast("double")
    return rows.withColumn("target", F.coalesce(F.least(level * F.col("weight"), stop), F.lit(0.0))).drop("level")


def sainte_lague(rows: DataFrame, party: list[str], within: list[str], claim: str, house: Column) -> DataFrame:
    """Adds ``seats``: whole seats of a house (a column that is the same all over a group) by highest quotients claim / (2 s + 1).

    Rounding claim * house / sum gives each party what a divisor near the right one gives, off by at most half a seat a
    party in all. What is left over or too much is settled by the next highest, or lowest, quotients: of those, a party
    can only win as many as lie beyond the needed one among its rivals' first ones. Ties go to the smaller party key.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy()
    total = F.sum(claim).over(group)
    first = rows.withColumn("_house", house.cast("long"))
    exact = F.when(total > 0, F.col(claim) * F.col("_house") / total).otherwise(F.lit(0.0))
    first = first.withColumn("_s", F.floor(exact + 0.5).cast("long"))
    first = first.withColumn("_off", F.when(total > 0, F.col("_house")).otherwise(F.lit(0)) - F.sum("_s").over(group))
    # The next quotient to win, or the last one won.
    claim_of = F.col(claim).cast("double")
    step = F.when(F.col("_off") > 0, claim_of / (2 * F.col("_s") + 1)).when(F.col("_s") > 0, claim_of / (2 * F.col("_s") - 1))
    first = first.withColumn("_q", step)
    up = group.orderBy(F.col("_q").desc_nulls_last(), *[F.col(p).asc_nulls_last() for p in party])
    down = group.orderBy(F.col("_q").asc_nulls_last(), *[F.col(p).desc_nulls_last() for p in party])
    place = F.when(F.col("_off") > 0, F.row_number().over(up)).otherwise(F.row_number().over(down))
    first = first.withColumn("_place", place)
    bar = F.max(F.when(F.col("_place") == F.abs("_off"), F.col("_q"))).over(group)
    first = first.withColumn("_bar", bar)
    # How many of the party's quotients, from the next on, reach the bar.
    more = F.floor((claim_of / F.col("_bar") + 1) / 2).cast("long") - F.col("_s") + 1
    less = F.col("_s") - F.floor((claim_of / F.col("_bar") - 1) / 2).cast("long") + 1
    reach = F.when(F.col("_off") > 0, more).when(F.col("_off") < 0, F.least(less, "_s")).otherwise(F.lit(0))
    reach = F.least(F.greatest(reach, F.lit(0)), F.abs("_off"))
    tries = first.where("_off <> 0 and _q is not null").withColumn("_reach", reach).where("_reach > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_reach") - 1)))
    quotient = F.when(F.col("_off") > 0, claim_of / (2 * (F.col("_s") + F.col("_i")) + 1)).otherwise(claim_of / (2 * (F.col("_s") - F.col("_i")) - 1))
    tries = tries.withColumn("_q", quotient)
    won = tries.withColumn("_place", place).where(F.col("_place") <= F.abs("_off"))
    same = [first[c].eqNullSafe(F.col(f"_w_{c}")) for c in [*within, *party]]
    change = won.groupBy(*[F.col(c).alias(f"_w_{c}") for c in [*within, *party]]).agg(F.sum(F.signum("_off")).cast("long").alias("_change"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = first.join(change, on, "left").withColumn("seats", F.col("_s") + F.coalesce("_change", F.lit(0).cast("long")))
    return out.select(*rows.columns, "seats")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(key, source, size, source_size, target, taken) of each row; ``taken`` is how many of its words the mix takes, repeats counted.

    Size is the number of words of the whole text (null: 0); a null source is a source. Wordless rows are taken 0 times.
    Repeated rows are laid out one after the other and each counts. The seed fixes the choice, so reruns agree. No row
    is taken more than REPEATS times. Words in a source's last, shorter block move its sum by less than a block a
    shard. An empty table gives an empty one; other columns are not read.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = stored(df.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = weighted_targets(sizes)
    house = F.round(F.sum("source_size").over(Window.partitionBy()) / block)
    quotas = stored(sainte_lague(targets, ["source"], [], "target", house).withColumnRenamed("seats", "quota"), "quotas")
    shards = F.greatest(F.ceil(F.col("source_size") / (block * shard_blocks)), F.lit(1)).cast("long")
    # A join on a code of the source, as null must meet null: a broadcast or a sorted join as sizes allow.
    code = F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("source", F.lit("")))
    about = quotas.select(code.alias("code"), "source_size", "target", "quota", shards.alias("shards"))
    placed = rows.withColumn("code", code).join(about, "code")
    placed = placed.withColumn("shard", F.pmod(draw(seed + " shard", F.col("key")), "shards"))
    shard_sizes = placed.groupBy("code", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    seats = sainte_lague(shard_sizes, ["shard"], ["code"], "shard_size", F.col("quota")).withColumnRenamed("seats", "blocks")
    count = F.ceil(F.col("shard_size") / block).cast("long")
    seats = seats.select("code", "shard", "shard_size", F.least("blocks", REPEATS * count).alias("blocks"), count.alias("cut"))
    full = F.when(F.col("cut") > 0, F.floor(F.col("blocks") / F.col("cut"))).otherwise(F.lit(0)).cast("long")
    seats = seats.withColumn("full", full).withColumn("extra", F.col("blocks") - F.col("full") * F.col("cut"))
    start = F.when(F.col("cut") > 0, F.pmod(draw(seed + " start", F.col("code"), F.col("shard")), "cut")).otherwise(F.lit(0))
    seats = stored(seats.withColumn("start", start.cast("long")), "seats")
    # A shard is bounded, so no window holds more than its documents, whatever the source's share.
    lay = Window.partitionBy("code", "shard").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("order", draw(seed + " order", F.col("key"))).withColumn("to", F.sum("size").over(lay))
    at = laid.join(seats.drop("shard_size"), ["code", "shard"])
    low, high = F.col("start") * block, (F.col("start") + F.col("extra")) * block
    around = F.col("cut") * block

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least("to", b) - F.greatest(F.col("to") - F.col("size"), a), F.lit(0))

    taken = F.col("full") * F.col("size") + overlap(low, F.least(high, around)) + overlap(F.lit(0), high - around)
    return at.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"))
