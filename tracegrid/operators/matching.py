"""Best match between two sets of names by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grams(df: DataFrame) -> DataFrame:
    """Padded character pairs of each name; a repeated pair is told apart by its count."""
    padded = F.concat(F.lit("\x02"), F.col("name"), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("name") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    counted = F.transform(
        pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda x: x == g)).cast("string"))
    )
    return df.select("name", F.explode(counted).alias("gram"))


def _rare_grams(grams: DataFrame, frequency: DataFrame, cutoff: float) -> DataFrame:
    """Each name's rarest pairs, as many as an acceptable partner must share one of.

    Names of length up to L scoring above the cutoff are fewer than
    ``(1 - c) L`` edits apart and each edit breaks two pairs, so they share more
    than ``(2 c - 1) L + 1`` pairs; a name can miss at most the others.
    """
    length = F.char_length("name")
    needed = F.floor(F.lit(2 * cutoff / 100 - 1) * length + F.lit(1e-9)) + 1
    rank = F.row_number().over(Window.partitionBy("name").orderBy("n", "gram"))
    ranked = grams.join(frequency, "gram").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= length + 1 - needed + 1).select("name", "gram")


def similarity(a: Column, b: Column) -> Column:
    """100 for equal names, falling with the edits needed per character of the longer one."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise((1 - F.levenshtein(a, b) / longest) * 100)


def fuzzy_best_match(left: DataFrame, right: DataFrame, col: str, cutoff: float = 60.0) -> DataFrame:
    """For each distinct left name the most similar right name scoring above ``cutoff``, else "".

    Exact for the Levenshtein ratio: pairs are compared only if they share one
    of each other's rare character pairs, which every acceptable pair does.
    Names found as they are need no comparison. Ties by the right name.
    """
    if not 50 <= cutoff < 100:
        raise ValueError("the cutoff must be at least 50 and below 100")
    names = left.select(F.col(col).alias("name")).where("name is not null").distinct()
    pool = right.select(F.col(col).alias("name")).where("name is not null").distinct()
    equal = names.join(pool, "name", "left_semi")
    others = names.join(pool, "name", "left_anti")
    left_grams, right_grams = _grams(others), _grams(pool)
    frequency = left_grams.unionByName(right_grams).groupBy("gram").agg(F.count("*").alias("n"))
    a = _rare_grams(left_grams, frequency, cutoff).select(F.col("name").alias("l"), "gram")
    b = _rare_grams(right_grams, frequency, cutoff).select(F.col("name").alias("r"), "gram")
    shorter, longer = F.least(F.char_length("l"), F.char_length("r")), F.greatest(F.char_length("l"), F.char_length("r"))
    near = a.join(b, "gram").where(shorter > longer * (cutoff / 100)).select("l", "r").distinct()
    scored = near.withColumn("score", similarity(F.col("l"), F.col("r"))).where(F.col("score") > cutoff)
    best = scored.groupBy("l").agg(F.min_by(F.struct("r", "score"), F.struct(-F.col("score"), F.col("r"))).alias("b"))
    found = others.join(best, F.col("name") == F.col("l"), "left").select(
        "name", F.coalesce("b.r", F.lit("")).alias("match"), F.coalesce("b.score", F.lit(0.0)).alias("score")
    )
    return equal.select("name", F.col("name").alias("match"), F.lit(100.0).alias("score")).unionByName(found)
