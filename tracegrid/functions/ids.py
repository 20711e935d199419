"""Requirement ids, id lists, section numbers and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrid.functions.text import BLANK_CLASS, _col, clean_str, text

# The shape of a padded id and its digit width.
ID_PATTERN = r"^([A-Za-z]+)-0*(\d+)([A-Za-z]*)$"
ID_WIDTH = 5
LINK_ID_PATTERN = r"([A-Za-z]+-\d+[A-Za-z0-9]*)"
PRIMARY_LINK_PATTERN = r"Primary\\?=\s*([A-Za-z]+-\d+[A-Za-z0-9]*)"


def normalize_req_id(c) -> Column:
    """``ssg-34a`` -> ``SSG-00034A``; anything of another shape only loses its blanks.

    The number is widened first and surplus zeros are cut after, since ``lpad``
    would truncate numbers longer than the width.
    """
    token = F.regexp_replace(text(c), BLANK_CLASS + "+", "")
    widened = F.regexp_replace(token, ID_PATTERN, "$1-" + "0" * (ID_WIDTH - 1) + "$2$3")
    padded = F.regexp_replace(widened, r"^([A-Za-z]+)-0*(\d{%d,}[A-Za-z]*)$" % ID_WIDTH, "$1-$2")
    return F.when(token.rlike(ID_PATTERN), F.upper(padded)).otherwise(token)


def split_ids(c) -> Column:
    """Raw id tokens: split on newline, semicolon and comma, trimmed, blanks dropped."""
    tokens = F.transform(F.split(text(c), "[\n;,]"), clean_str)
    return F.filter(tokens, lambda t: t != "")


def parse_id_list(c) -> Column:
    """Normalised ids in order of first appearance."""
    ids = F.transform(split_ids(c), normalize_req_id)
    return F.array_distinct(F.filter(ids, lambda t: t != ""))


def normalized_ids(c) -> Column:
    """Every id of a cell in normal form, repeats included."""
    return F.transform(split_ids(c), normalize_req_id)


def first_id(ids) -> Column:
    """The first id of a list, else the empty string."""
    return F.coalesce(F.get(_col(ids), F.lit(0)), F.lit(""))


def other_ids(ids) -> Column:
    """Every id after the first, not deduplicated, joined by a comma."""
    return F.array_join(F.slice(_col(ids), 2, F.greatest(F.size(_col(ids)), F.lit(1))), ", ")


def primary_id(c) -> Column:
    return first_id(normalized_ids(c))


def alias_ids(c) -> Column:
    return other_ids(normalized_ids(c))


def extract_link_ids(c) -> Column:
    """Ids named in a link text: those marked as primary first, then all others."""
    body = clean_str(c)
    marked = F.regexp_extract_all(body, F.lit(PRIMARY_LINK_PATTERN), F.lit(1))
    every = F.regexp_extract_all(body, F.lit(LINK_ID_PATTERN), F.lit(1))
    ids = F.array_distinct(F.transform(F.concat(marked, every), normalize_req_id))
    none = F.array().cast("array<string>")
    return F.when(F.upper(body).isin("", "N/A"), none).otherwise(ids)


def make_srs_req_id(section, number) -> Column:
    sec = F.regexp_replace(F.regexp_replace(text(section), BLANK_CLASS + "+", ""), r"[\\/]", "_")
    return F.concat(F.lit("SRS-"), sec, F.lit("-"), F.regexp_replace(text(number), BLANK_CLASS + "+", ""))


def section_base(c) -> Column:
    """The section number before its first dash."""
    return clean_str(F.split_part(clean_str(c), F.lit("-"), F.lit(1)))


def _dotted(c) -> Column:
    tight = F.replace(clean_str(c), F.lit(" "), F.lit(""))
    dotted = F.regexp_extract(tight, r"\d+(?:\.\d+)+", 0)
    return F.when(dotted != "", dotted).otherwise(F.regexp_extract(tight, r"\d+", 0))


def major_key(c) -> Column:
    """First two parts of the first dotted number, or ``N/A``."""
    target = _dotted(c)
    return F.when(target == "", F.lit("N/A")).otherwise(F.substring_index(target, ".", 2))


def minor_key(c) -> Column:
    """First three parts of the first dotted number, or ``N/A`` where there are fewer."""
    target = _dotted(c)
    three = F.substring_index(target, ".", 3)
    return F.when(F.size(F.split(target, r"\.")) >= 3, three).otherwise(F.lit("N/A"))


def section_path(c, levels: int = 3) -> Column:
    """Prefixes of a section number: ``1.2.3-4`` -> ``[1, 1.2, 1.2.3]``."""
    base = F.split_part(text(c), F.lit("-"), F.lit(1))
    parts = F.slice(F.filter(F.split(base, r"\."), lambda p: p != ""), 1, levels)
    prefixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "."))
    return prefixes


def digits_key(c: Column) -> Column:
    """An orderable form of a run of digits of any length: how many without leading zeros, then which."""
    bare = F.ltrim(c, F.lit("0"))
    return F.struct(F.length(bare).alias("length"), bare.alias("digits"))


def natural_key(c) -> Column:
    """An orderable key: digit runs as numbers, other runs lower-cased, numbers first."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        runs,
        lambda r: F.struct(
            F.when(r.rlike(r"^\d"), F.lit(0)).otherwise(F.lit(1)).alias("kind"),
            F.when(r.rlike(r"^\d"), digits_key(r)).alias("number"),
            F.when(r.rlike(r"^\d"), F.lit("")).otherwise(F.lower(r)).alias("word"),
        ),
    )
