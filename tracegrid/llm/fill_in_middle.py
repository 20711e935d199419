"""Fill-in-the-middle training texts by one counted match per text.

A text is a run of units, by default lines with their line break. ``regexp_count``
gives their number n; two seeded draws choose after how many of them the prefix and
the middle end. A pattern made for the row, with the possessive groups ``unit{a}``
and ``unit{b-a}``, then captures prefix, middle and suffix in one match, and its
replacement is the new text. Possessive groups never step back, so a match takes
time in proportion to the text and no stack, however many lines it has.

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

Everything is a native expression per row: nothing is shuffled, and a long text costs
only its own task. Draws depend on seed and id alone, so a rerun or a recomputed task
gives the same texts; repeated ids are cut alike if their texts have as many units.

Defined results: a null text counts as an empty one; empty texts and texts with one of
the three marks stay as they are (``plain``); a null id draws like the empty string;
no rows give no rows. Other columns stay; the new ones replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import named

# One unit: a line with its line break, or what stands after the last one.
LINE = r"[^\n]*+\n|[^\n]++"
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
# Of a hundred texts, so many are rearranged, and of these so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 100, 50


def _draw(key: Column, i: int) -> Column:
    """The i-th group of eight hex digits of the key's sha256 as a whole number."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long")


def _literal(mark: str) -> str:
    """The mark as a pattern."""
    return r"\Q" + mark + r"\E"


def _as_is(mark: str) -> str:
    """The mark in a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = LINE,
    marks: tuple[str, str, str] = MARKS,
    seed: int = SEED,
    rearranged: int = REARRANGED,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Adds ``n`` (units), ``form``, ``output``, and the lengths ``prefix_chars`` and ``middle_chars`` (null if plain).

    ``unit`` is a pattern without groups whose units, one after the other, are the whole of any text.
    No mark may begin inside another one, nor one end as another begins.
    """
    prefix, suffix, middle = marks
    if len(set(m[0] for m in marks)) > 1 or any(m[0] in m[1:] for m in marks) or len(set(marks)) < 3:
        raise ValueError("marks must differ and begin with one character that they hold nowhere else")
    text = F.coalesce(named(text_col), F.lit(""))
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    kept = [named(c) for c in docs.columns if c not in new]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("")))
    drawn = docs.select(
        *kept,
        text.alias("__text"),
        F.regexp_count(text, F.lit(unit)).cast("long").alias("n"),
        F.array(*[_draw(key, i) for i in range(4)]).alias("__h"),
    )
    h, n = F.col("__h"), F.col("n")
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    stays = (F.col("__text") == "") | F.col("__text").rlike("|".join(map(_literal, marks))) | (h[2] % 100 >= rearranged)
    form = F.when(stays, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    formed = drawn.withColumn("form", form).withColumn("__a", F.least(one, two)).withColumn("__b", F.greatest(one, two))
    a, b = F.col("__a").cast("string"), (F.col("__b") - F.col("__a")).cast("string")
    counted = F.concat(F.lit(rf"\A((?:{unit}){{"), a, F.lit(rf"}}+)((?:{unit}){{"), b, F.lit(r"}+)((?s:.*+))\z"))
    p, s, m = map(_as_is, marks)
    psm, spm = F.lit(f"{p}$1{s}$3{m}$2"), F.lit(f"{s}$3{p}$1{m}$2")
    cut = F.regexp_replace("__text", counted, F.when(F.col("form") == "spm", spm).otherwise(psm))
    plain = F.col("form") == "plain"
    out = formed.withColumn("output", F.when(plain, F.col("__text")).otherwise(cut))
    # No mark begins in a text, so the first of each in the output is the one put there.
    at = {m: F.locate(m, F.col("output")) for m in marks}
    after_prefix = F.when(F.col("form") == "psm", at[suffix]).otherwise(at[middle])
    return out.select(
        *kept,
        "n",
        "form",
        "output",
        F.when(~plain, (after_prefix - at[prefix] - len(prefix)).cast("long")).alias("prefix_chars"),
        F.when(~plain, (F.length("output") - at[middle] + 1 - len(middle)).cast("long")).alias("middle_chars"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a rearranged one was made of."""
    prefix, suffix, middle = map(_literal, marks)
    psm = rf"(?s)\A{prefix}(.*?){suffix}(.*?){middle}(.*+)\z"
    spm = rf"(?s)\A{suffix}(.*?){prefix}(.*?){middle}(.*+)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(output)
    )
