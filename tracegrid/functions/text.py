"""Column -> Column text functions.

Python and the JVM disagree on what a blank character is, so every function
here goes through one fixed set of blank characters: those Python's
``str.strip`` removes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = "[" + BLANKS + "]"
NON_BLANK_CLASS = "[^" + BLANKS + "]"

# Texts read as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def text(c) -> Column:
    """The value as text, null as the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def named(column: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def _col(c) -> Column:
    if not isinstance(c, str):
        return c
    return F.col(c) if c.startswith("`") else named(c)


def py_strip(c) -> Column:
    return F.btrim(_col(c).cast("string"), F.lit(BLANKS))


def clean_str(c) -> Column:
    """Stripped text; null becomes the empty string."""
    return F.coalesce(py_strip(c), F.lit(""))


def is_blank(c) -> Column:
    return clean_str(c) == ""


def blank_to_null(c) -> Column:
    """Null where the text is blank, else the value with its own type."""
    col = _col(c)
    # One side is enough to tell.
    return F.when(F.ltrim(col.cast("string"), F.lit(BLANKS)) != "", col)


def filled(c) -> Column:
    """Stripped text, or null where nothing is left."""
    return F.nullif(py_strip(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First non-blank stripped value, else the empty string."""
    return F.coalesce(*[filled(c) for c in cols], F.lit(""))


def value_or_na(c) -> Column:
    return F.coalesce(filled(c), F.lit("N/A"))


def single_line(c) -> Column:
    return py_strip(F.regexp_replace(text(c), BLANK_CLASS + "+", " "))


def truncate_text(c, limit: int = 300) -> Column:
    """Cut to ``limit`` characters, right-strip, and mark the cut with dots."""
    col = text(c)
    cut = F.rtrim(F.substring(col, 1, limit), F.lit(BLANKS))
    return F.when(F.char_length(col) <= limit, col).otherwise(F.concat(cut, F.lit("...")))


def bool_from_value(c) -> Column:
    return F.lower(clean_str(c)).isin(*TRUE_WORDS)


def formula_safe(c) -> Column:
    """Prefix an apostrophe where a spreadsheet would read the text as a formula."""
    col = text(c)
    return F.when(F.substring(col, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), col)).otherwise(col)


def slugify(c) -> Column:
    slug = F.btrim(F.regexp_replace(text(c), r"[^A-Za-z0-9_.\-]+", "_"), F.lit("._-"))
    return F.when(slug == "", F.lit("item")).otherwise(slug)


def word_count(c) -> Column:
    return F.coalesce(F.regexp_count(text(c), F.lit(NON_BLANK_CLASS + "+")), F.lit(0))


def label(key, cols: Sequence) -> Column:
    """Non-empty fields joined by a bar, or the key where all are empty."""
    joined = F.concat_ws(" | ", *[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols])
    return F.coalesce(F.nullif(joined, F.lit("")), _col(key).cast("string"))


def numbered_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with its named groups made plain, and where each name sits.

    Java group names allow no underscore, so names are resolved to numbers here.
    """
    names = dict(re.compile(pattern).groupindex)
    return re.sub(r"\(\?P<[^>]+>", "(", pattern), names


def metadata_from_name(c, patterns: Sequence[str]) -> dict[str, Column]:
    """One column per named group; a later matching pattern overrides an earlier one."""
    found: dict[str, list[Column]] = {}
    for pattern in patterns:
        plain, names = numbered_groups(pattern)
        for name, group in names.items():
            value = F.nullif(F.regexp_extract(text(c), r"^(?:" + plain + ")", group), F.lit(""))
            found.setdefault(name, []).append(value)
    return {name: F.coalesce(*reversed(values)) for name, values in found.items()}


def heading_block(c, heading: str, stop: str = "h1_h2") -> Column:
    """Trimmed text after the line ``## heading`` up to the next heading.

    ``stop`` is ``h1_h2`` (next H1 or H2), ``h2`` (next H2) or ``end``.
    """
    stops = {"h1_h2": r"(?=^\s*#{1,2}\s+|\z)", "h2": r"(?=^\s*##\s+|\z)", "end": r"\z"}
    quoted = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", heading)
    pattern = rf"(?ims)^##\s+{quoted}\s*$(.*?){stops[stop]}"
    return clean_str(F.regexp_extract(text(c), pattern, 1))


def content_sha(c) -> Column:
    return F.sha2(text(c), 256)


def fingerprint(path, body, req_id) -> Column:
    """``FINGERPRINT::<id>`` where an id is known, else the hashes of path and body."""
    hashed = F.concat(F.sha1(text(path)), F.sha1(text(body)))
    known = F.coalesce(F.nullif(_col(req_id).cast("string"), F.lit("")), hashed)
    return F.concat(F.lit("FINGERPRINT::"), known)


# Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text(name), "UTF-8")))
    variant_nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant_nibble.cast("long"))), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(path, index) -> Column:
    return uuid5_url(F.concat(text(path), F.lit("::"), _col(index).cast("string")))
