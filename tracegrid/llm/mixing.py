"""Mixing sources to target weights by Sainte-Lague apportionment (native).

The corpus is cut into blocks of equally many words. The blocks of the mix are
awarded to sources one after another by the highest quotient target / (2k - 1),
k being the number of the award within its source, until every source has as many as
its target fills; the last award of a source ends at its target. So small sources get
theirs too, in the later shards. A highest-quotient method is
monotone in the number of awards, so the awards up to the end of output shard j
less those up to shard j - 1 are the integer quota of each source in that shard.
A source's documents are laid end to end in an order drawn from a seed; its
quotas take its blocks from that stream one after another and start again at its
head when the stream is used up.

Scale: only one row per source passes through a single task (targets, awards).
The place of a document in its source's stream is the sum of whole slices of the
stream before it plus a running sum within its slice; a source is cut into 4096
slices by id and size, so a source with a third of all rows is spread like the rest.
(Only rows that repeat both, id and size, share a slice.)

Defined results: a null text has no words and is never taken; null sources form
one source, ranked last; repeated rows are documents of their own; no rows give
no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.llm.words import word_count

# Blocks that the words of all sources come to.
BLOCKS = 65536
SHARDS = 16
MAX_EPOCHS = 3
SEED = "mix-1"
# Hex digits of the drawn order that name a slice of a source's stream.
SLICE_DIGITS = 3


def one_two_three(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating by the rank of the source's name."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def source_targets(
    sized: DataFrame, weight: Callable[[Column], Column] = one_two_three, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Words each source is to give: one row per ``source`` (never null) with its ``size``, ``rank`` and ``target``.

    The targets share the words of all sources by weight; a source stops at
    ``max_epochs`` times its own words and the others share what it leaves.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    by_name = Window.orderBy("source")
    ranked = per_source.select(
        "source", "size", F.row_number().over(by_name).alias("rank"), (max_epochs * F.col("size")).alias("cap")
    ).withColumn("weight", weight(F.col("rank")).cast("double"))
    # The sources that stop are those with the least room per weight. Going up in that
    # order, a level is what the words left come to per weight left.
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    left = F.sum("size").over(Window.partitionBy()) - F.coalesce(
        F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    level = left / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    leveled = ranked.withColumn("level", level).withColumn("open", F.first(open_level, True).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("open"), F.lit(0.0)) * F.col("weight"))
    return leveled.select("source", "size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"), "cap")


def block_quotas(targets: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """Awards up to the end of each shard: ``source``, ``size``, ``target``, ``block``, ``ends`` (words, one per shard).

    Rounding each source's exact share misses the number of awards by less than
    one per source, spread over the sources by their shares, and sources that have all
    theirs leave no more than that to the others; so only the quotients around the
    exact share are compared, some six rows per source.
    """
    total = Window.partitionBy()
    base = targets.select("*", F.sum("size").over(total).alias("total"), F.count("*").over(total).alias("sources"))
    base = base.withColumn("block", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / blocks)))
    base = base.withColumn("most", F.ceil(F.col("target") / F.col("block")))
    base = base.withColumn("quota", F.least("cap", F.floor(F.col("target") + 0.5))).withColumn("awards", F.sum("most").over(total))
    houses = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn(
        "house", F.floor(F.col("awards") * F.col("shard") / shards)
    )
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    near = F.floor(share * F.col("house") + 0.5)
    slack = F.ceil(share * F.col("sources")) + 2
    bounds = houses.select(
        "*",
        F.least(F.col("most"), F.greatest(F.lit(0), near - slack)).alias("low"),
        F.least(F.col("most"), near + slack).alias("high"),
    )
    per_house = Window.partitionBy("shard")
    open_awards = bounds.withColumn("open", F.col("house") - F.sum("low").over(per_house))
    k = F.col("k")
    candidates = open_awards.where("high > low").select(
        "rank", "shard", "open", "target", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k")
    )
    order = Window.partitionBy("shard").orderBy((F.col("target") / (2 * k - 1)).desc(), "rank", "k")
    won = candidates.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy("rank", "shard").count()
    ended = open_awards.join(won, ["rank", "shard"], "left").withColumn(
        "end", F.least("quota", (F.col("low") + F.coalesce("count", F.lit(0))) * F.col("block"))
    )
    return ended.groupBy("rank", "source", "size", "target", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda e: e["end"]).alias("ends")
    )


def _tag(source_col: str) -> Column:
    """A name that is never null and sorts like the source, null last."""
    return F.coalesce(F.concat(F.lit("s"), named(source_col).cast("string")), F.lit("t"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = "text",
    size_col: str | None = None,
    seed: str = SEED,
    weight: Callable[[Column], Column] = one_two_three,
    blocks: int = BLOCKS,
    shards: int = SHARDS,
) -> DataFrame:
    """The documents with what the mix takes of them.

    Adds ``size`` (words), ``source_size``, ``target`` and ``draws``: for each pass
    over the source that reaches the document, the pass, the output shard in
    which its first word goes out, and the words taken.
    """
    results = ("size", "source_size", "target", "draws")
    kept = [named(c) for c in docs.columns if c not in results]
    size = named(size_col) if size_col else word_count(named(text_col))
    sized = docs.select(*kept, size.cast("long").alias("__size"), _tag(source_col).alias("__source"))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), named(id_col).cast("string"), F.col("__size").cast("string")))
    sized = sized.withColumn("__drawn", drawn)
    sized = sized.withColumn("__slice", F.substring("__drawn", 1, SLICE_DIGITS))

    slices = sized.groupBy("__source", "__slice").agg(F.sum("__size").alias("__words"))
    quotas = block_quotas(
        source_targets(slices.select(F.col("__source").alias("source"), F.col("__words").alias("size")), weight),
        blocks,
        shards,
    )
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = slices.select(
        F.col("__source").alias("__s"),
        F.col("__slice").alias("__p"),
        F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__head"),
    )
    plan = heads.join(quotas, F.col("__s") == F.col("source")).select(
        "__s", "__p", "__head", F.col("size").alias("source_size"), "target", F.col("ends").alias("__ends")
    )
    within = Window.partitionBy("__source", "__slice").orderBy("__drawn", named(id_col), "__size")
    placed = sized.withColumn(
        "__in", F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    )
    found = placed.join(plan, (F.col("__source") == F.col("__s")) & (F.col("__slice") == F.col("__p")))
    found = found.withColumn("__start", F.col("__head") + F.col("__in"))
    quota = F.element_at("__ends", -1)

    def draw(p: Column) -> Column:
        start = F.col("__start") + p * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(quota - start, F.col("__size")))
        shard = F.size(F.filter("__ends", lambda end: end <= start))
        return F.struct(p.cast("int").alias("pass"), shard.alias("shard"), words.cast("long").alias("words"))

    passes = F.transform(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)), draw)
    return found.select(
        *kept,
        F.col("__size").alias("size"),
        "source_size",
        "target",
        F.filter(passes, lambda d: d["words"] > 0).alias("draws"),
    )


def taken(draws: Column) -> Column:
    """Words taken in all passes."""
    return F.aggregate(draws, F.lit(0).cast("long"), lambda n, d: n + d["words"])
