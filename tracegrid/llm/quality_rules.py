"""Quality rules with adaptive thresholds (native).

Fixed cutoffs fit one kind of text and fail others. Here each statistic of a
document is compared with a fence around the middle of its own language and
source, taken from quantile sketches that merge. A group's quartiles are blended
with those of its language, and a language's with those of all documents, by n
against a constant, so that a small group leans on its parent and no document more
or less makes a step. Every document that passes the base rule takes part in the
sketches, and each sketch is a few kilobytes whatever its group holds.

Defined results: a null or empty text has zero counts and fails the base rule;
null languages and sources form groups of their own; repeated rows are judged
one by one, alike; no rows give no rows; other columns pass through, save those
named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.llm.words import SPACES, words
from tracegrid.operators.storage import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Items a sketch holds in its first level: small groups stay exact.
SKETCH_SIZE = 4096
# Documents that a group's parent counts for beside the group's own.
PARENT_WEIGHT = 10
# How far beyond the middle half of its group a statistic may lie, in widths of that half.
WIDTHS = 6.0


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def statistics() -> dict[str, tuple[Column, float, bool]]:
    """Name -> (value, slack, also from below)."""
    return {
        "symbol_share": (_share("n_symbols", "word_chars"), 0.05, False),
        "upper_share": (_share("n_upper", "word_chars"), 0.25, False),
        "dup_line_share": (_share("n_dup_lines", "n_lines"), 0.4, False),
        "repeat_share": (_share("n_repeat_words", "n_words"), 0.35, False),
        "word_length": (_share("word_chars", "n_words"), 2.0, True),
    }


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of each document's whole text (see ``COUNTS``)."""
    kept = [named(c) for c in docs.columns if c not in COUNTS]
    text = F.coalesce(named(text_col), F.lit(""))
    # Each step is a projection of its own, so that no list is worked out twice.
    lists = docs.select(
        *kept,
        words(text).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.ltrim(line, F.lit(SPACES)) != "").alias("__lines"),
        # What is left after one pass is short, so that counting in it is cheap.
        F.regexp_replace(text, r"[^#*$%&|<>A-Z]++", "").alias("__marks"),
    )
    word = lambda i: F.get("__words", i)
    hashes = F.transform("__words", lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    counted = lists.select(
        *kept,
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__marks", "[A-Z]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__marks", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__words") > 3, F.slice(hashes, 1, F.size("__words") - 2)).alias("__windows"),
    )
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = counted.withColumn("__placed", F.when(repeats, placed))
    hash_at = lambda j: F.get("__placed", j)["h"]
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    twice = F.filter("__placed", lambda e, j: same(e["h"], hash_at(j - 1)) | same(e["h"], hash_at(j + 1)))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "__starts",
        start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return ordered.withColumn("__starts", starts).select(
        *kept,
        *[c for c in COUNTS if c != "n_repeat_words"],
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def fences(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per language and source: the lowest and highest value each statistic may take."""
    stats = statistics()
    fits = counted.where(~base_failed()).select(
        named(lang_col).alias("__lang"), named(source_col).alias("__source"), *[v[0].alias(n) for n, v in stats.items()]
    )
    group = fits.groupBy("__lang", "__source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(n, SKETCH_SIZE).alias(n) for n in stats]
    )
    merged = lambda rows, *keys: rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(n, SKETCH_SIZE).alias(n) for n in stats]
    )
    group = materialize(group.withColumn("__all", F.lit(0)))
    # One row per language, then one row: aggregates of sketches, not of documents.
    lang = materialize(merged(group, "__lang", "__all"))
    every = materialize(merged(lang, "__all"))
    a, b, c = group.alias("a"), lang.alias("b"), every.alias("c")
    rows = a.join(b, F.col("a.__lang").eqNullSafe(F.col("b.__lang"))).join(c, F.col("a.__all") == F.col("c.__all"))
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    levels = rows.select(
        F.col("a.__lang"),
        F.col("a.__source"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
        *[F.kll_sketch_get_quantile_double(F.col(f"{x}.{n}"), quartiles).alias(f"{x}_{n}") for n in stats for x in "abc"],
    )

    def blend(own: Column, n: str, parent: Column) -> Column:
        return (F.col(n) * own + PARENT_WEIGHT * parent) / (F.col(n) + PARENT_WEIGHT)

    def quartile(n: str, i: int) -> Column:
        return blend(F.col(f"a_{n}")[i], "n_a", blend(F.col(f"b_{n}")[i], "n_b", F.col(f"c_{n}")[i]))

    rows = levels.select("__lang", "__source", *[F.array(quartile(n, 0), quartile(n, 1)).alias(n) for n in stats])
    reach = lambda n, slack: F.greatest(F.lit(slack), WIDTHS * (F.col(n)[1] - F.col(n)[0]))
    return rows.select(
        "__lang",
        "__source",
        *[(F.col(n)[1] + reach(n, slack)).alias(f"__max_{n}") for n, (_, slack, _) in stats.items()],
        *[(F.col(n)[0] - reach(n, slack)).alias(f"__min_{n}") for n, (_, slack, low) in stats.items() if low],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(counted: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to documents that carry their counts.

    A group of which every document fails the base rule has no fence and needs none.
    """
    inside = [
        (value <= F.col(f"__max_{n}")) & ((value >= F.col(f"__min_{n}")) if low else F.lit(True))
        for n, (value, _, low) in statistics().items()
    ]
    verdict = F.coalesce(reduce(lambda x, y: x & y, inside), F.lit(True))
    kept = [named(c) for c in counted.columns if c not in ("base_failed", "kept")]
    found = counted.join(
        limits,
        named(lang_col).eqNullSafe(F.col("__lang")) & named(source_col).eqNullSafe(F.col("__source")),
        "left",
    )
    return found.select(*kept, base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
    keep_counts: bool = True,
) -> DataFrame:
    """The documents with their counts, ``base_failed`` and ``kept``.

    ``carry``: the document columns to return, by default all. They are written
    with the counts in the shared folder, so that texts are read once; without
    ``keep_counts`` nothing as large as the texts is written, and texts are counted
    twice. The table of fences is written so that its true size decides how it is
    joined.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in COUNTS]
    counted = document_counts(docs, text_col).select(*map(named, carried), *COUNTS)
    # Counts are not to be worked out again inside a filter on them: a written table, or
    # a node that filters are not moved below, stands between.
    counted = materialize(counted) if keep_counts else counted.observe("counted", F.count(F.lit(1)).alias("documents"))
    limits = materialize(fences(counted, lang_col, source_col))
    return judge(counted, limits, lang_col, source_col)
