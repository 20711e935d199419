"""One document in, many rows out: blocks, chunks, tables, and what they are about."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import BLANKS, _col, chunk_id, content_sha, numbered_groups, py_strip, text
from tracegrid.operators.ordered import ordered_scan

FRAGMENTS = "array<struct<text:string,start:int,end:int>>"
BLOCKS = (
    "array<struct<text:string,heading_path:string,heading_text:string,start_char:int,end_char:int,index:int,"
    f"fragments:{FRAGMENTS},first_chunk:int>>"
)

# Documents in one Arrow batch of this session's Python functions: by default ten thousand, all of whose
# texts, blocks and fragments a Python worker would hold at once.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> None:
    """Whole documents pass to Python a few hundred at a time, or fewer where the session already asks for fewer."""
    conf = df.sparkSession.conf
    asked = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < asked <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


# --- chunking --------------------------------------------------------------------


BREAK = re.compile(r"[\n ]")


def _fragments(body: str, size: int, overlap: int) -> list[dict]:
    """Windows of ``size`` characters ending at the last blank or line break in them.

    Where such a break would not move the next window forward, the window is
    cut at its full size.
    """
    clean = body.strip()
    after_break = [m.end() for m in BREAK.finditer(clean)] if len(clean) > size else []

    def window(start: int) -> tuple[int, int]:
        full = start + size
        if full >= len(clean):
            return start, len(clean)
        nearest = bisect_right(after_break, full)
        soft = after_break[nearest - 1] if nearest else 0
        return start, soft if soft > start + overlap else full

    spans = [window(0)] if clean else []
    while spans and spans[-1][1] < len(clean):
        spans.append(window(spans[-1][1] - overlap))
    return [{"text": clean[x:y].strip(), "start": x, "end": y} for x, y in spans]


def fragments_of(c, max_chars: int = 1200, overlap: int = 200) -> Column:
    """Overlapping fragments of a text with their offsets in the stripped text."""
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")

    @F.pandas_udf(FRAGMENTS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _fragments(t, max_chars, overlap))

    return split(text(c))


def chunk_text(df: DataFrame, text_col: str, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    """One row per fragment: the other columns, ``chunk_index``, ``chunk``, ``start_char``, ``end_char``."""
    small_batches(df)
    rest = [c for c in df.columns if c != text_col]
    # The outer form: the plain one would add a filter that cuts every text a second time.
    pieces = F.posexplode_outer(fragments_of(text_col, max_chars, overlap)).alias("chunk_index", "f")
    return df.select(*rest, pieces).where("chunk_index is not null").select(
        *rest,
        "chunk_index",
        F.col("f.text").alias("chunk"),
        F.col("f.start").alias("start_char"),
        F.col("f.end").alias("end_char"),
    )


# --- front matter and blocks --------------------------------------------------------

_LINE_BLANKS = "[" + BLANKS.replace("\n", "") + "]*"
# The first line is ``---`` alone, or (loose) begins with it.
_CLOSING = rf"(.*?)^{_LINE_BLANKS}---{_LINE_BLANKS}$\n?"
_FRONT = rf"(?smd)\A{_LINE_BLANKS}---{_LINE_BLANKS}$\n{_CLOSING}"
_LOOSE_FRONT = rf"(?smd)\A---[^\n]*+\n{_CLOSING}"
_ITEM = rf"\A{_LINE_BLANKS}-[ \t]+"
_FLOW_LIST = r"(?s)\A\[(.*)\]\z"


def _unquoted(c: Column) -> Column:
    return F.btrim(F.btrim(py_strip(c), F.lit('"')), F.lit("'"))


def front_matter(c, loose: bool = False) -> tuple[Column, Column]:
    """What stands between two ``---`` lines as a map, and the body after them.

    Entries are ``key: value`` lines. A list, as ``- item`` lines under its key or
    as ``[a, b]``, is kept as a JSON array. Quotes around values are dropped, a key
    said twice keeps its last value, and an unclosed block is no front matter.
    """
    head = front_head(c, loose)
    return front_entries(head, loose), front_body(c, head)


def front_head(c, loose: bool = False) -> Column:
    """The lines up to the second ``---``, itself included; empty where the text has no front matter."""
    return F.regexp_extract(text(c), _LOOSE_FRONT if loose else _FRONT, 0)


def front_body(c, head) -> Column:
    """The text after its head, without a last line break; a text without a head as it is."""
    rest = F.substr(text(c), F.char_length(_col(head)) + 1)
    cut = F.when(F.endswith(rest, F.lit("\n")), F.substr(rest, F.lit(1), F.char_length(rest) - 1)).otherwise(rest)
    return F.when(_col(head) != "", cut).otherwise(text(c))


def front_entries(head, loose: bool = False) -> Column:
    """The entries of a head as a map."""
    head = _col(head)
    pattern = _LOOSE_FRONT if loose else _FRONT
    is_item = lambda x: x.rlike(_ITEM)
    lines = F.filter(F.split(F.regexp_extract(head, pattern, 1), "\n"), lambda x: is_item(x) | F.contains(x, F.lit(":")))

    def entry(line: Column) -> Column:
        key = py_strip(F.split_part(line, F.lit(":"), F.lit(1)))
        value = _unquoted(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))
        flow = F.regexp_extract(value, _FLOW_LIST, 1)
        listed = F.when(value.rlike(_FLOW_LIST), F.filter(F.transform(F.split(flow, ","), _unquoted), lambda x: x != ""))
        return F.struct(key.alias("key"), value.alias("value"), listed.alias("items"))

    def with_item(e: Column, line: Column) -> Column:
        none = F.array().cast("array<string>")
        item = _unquoted(F.regexp_replace(line, _ITEM, ""))
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), F.concat(F.coalesce(e["items"], none), F.array(item)).alias("items"))

    def step(done: Column, line: Column) -> Column:
        before, last = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.element_at(done, -1)
        taken = F.when(F.size(done) > 0, F.concat(before, F.array(with_item(last, line)))).otherwise(done)
        return F.when(is_item(line), taken).otherwise(F.concat(done, F.array(entry(line))))

    start = F.array().cast("array<struct<key:string,value:string,items:array<string>>>")
    # Without items every line is an entry of its own, which is cheaper than a step per line.
    entries = F.when(F.exists(lines, is_item), F.aggregate(lines, start, step)).otherwise(F.transform(lines, entry))
    shown = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["items"]), e["value"]).alias("value")),
    )
    keys = F.transform(shown, lambda e: e["key"])
    last = F.filter(
        shown,
        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]),
    )
    return F.when(head != "", F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


RULE_LINE = "---"


def _blocks(body: str, joiner: str) -> list[dict]:
    """Blocks between ``---`` lines, each with the last heading above its end.

    Works on line numbers: where lines start, which are rules, which are headings,
    and the path of titles that holds after each heading.
    """
    lines = body.splitlines()
    bare = [line.strip() for line in lines]
    starts = list(accumulate((len(line) + 1 for line in lines), initial=0))
    rules = [n for n, line in enumerate(bare) if line == RULE_LINE]
    headings = [n for n, line in enumerate(bare) if line.startswith("#")]
    titles = [(len(bare[n]) - len(bare[n].lstrip("#")), bare[n].lstrip("#").strip()) for n in headings]
    paths = list(accumulate(titles, lambda path, title: (*path[: title[0] - 1], title[1]), initial=()))
    found = []
    for first, end in zip([0, *(n + 1 for n in rules)], [*rules, len(lines)]):
        block = "\n".join(lines[first:end]).strip()
        above = bisect_left(headings, end)
        if block:
            found.append(
                {
                    "text": block,
                    "heading_path": joiner.join(paths[above]),
                    "heading_text": titles[above - 1][1] if above else "",
                    "start_char": starts[first],
                    "end_char": starts[end],
                    "index": len(found),
                }
            )
    return found


def blocks_of(c, joiner: str = " > ", max_chars: int = 1200, overlap: int = 200, chunked: bool = True) -> Column:
    """Blocks of a body, each with its fragments: both in one pass over the text."""

    @F.pandas_udf(BLOCKS)
    def split(bodies: pd.Series) -> pd.Series:
        def one(body: str) -> list[dict]:
            found, before = _blocks(body, joiner), 0
            for block in found:
                block["fragments"] = _fragments(block["text"], max_chars, overlap) if chunked else []
                block["first_chunk"] = before
                before += len(block["fragments"])
            return found

        return bodies.map(one)

    return split(text(c))


def markdown_blocks(df: DataFrame, text_col: str, joiner: str = " > ") -> DataFrame:
    """One row per block; offsets count in the body after the front matter."""
    small_batches(df)
    rest = [c for c in df.columns if c != text_col]
    _, body = front_matter(text_col)
    exploded = df.select(*rest, F.inline_outer(blocks_of(body, joiner, chunked=False)))
    return exploded.where("index is not null").drop("fragments", "first_chunk").withColumnRenamed("text", "block")


# --- what a chunk is about -------------------------------------------------------------

# Patterns for ids, numbers and levels, in order of preference.
DEFAULT_RULES: dict[str, list] = {
    "req_id": [
        r"(?mi)^Req_ID:\s*(?P<req_id>[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*-\d{1,6}[A-Za-z0-9_-]*)",
        r"(?mi)^##\s*(?P<req_id>[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*-\d{1,6}[A-Za-z0-9_-]*)",
        r"(?P<req_id>[A-Za-z]{2,}[A-Za-z0-9_-]*-\d{2,7}[A-Za-z0-9_-]*)",
    ],
    "object_number": [
        r"(?mi)^Object_Number:\s*(?P<object_number>\d+(?:\.\d+)*(?:[-/][A-Za-z0-9]+)?)",
        r"(?mi)^Section:\s*(?P<object_number>\d+(?:\.\d+)*(?:[-/][A-Za-z0-9]+)?)",
    ],
    "section_id": [
        r"(?mi)^Section:\s*(?P<section_id>\d+(?:\.\d+){0,4})",
        r"(?mi)^Object_Number:\s*(?P<section_id>\d+(?:\.\d+){0,4})",
        r"(?P<section_id>\d+(?:\.\d+){1,4})",
    ],
    "doc_level": [
        (r"(?i)\bSystem\b", "System"),
        (r"(?i)\bHLR\b", "HLR"),
        (r"(?i)\bLLR\b", "LLR"),
    ],
}

FIELDS = ("req_id", "object_number", "section_id")


def _always_filled(pattern: str, group: str) -> bool:
    """Can the pattern only match with something in its named group?"""
    body = re.search(rf"\(\?P<{group}>", pattern)
    depth, end = 1, body.end()
    while depth and end < len(pattern):
        if pattern[end] == "\\":
            end += 1
        else:
            depth += {"(": 1, ")": -1}.get(pattern[end], 0)
        end += 1
    optional = pattern[end : end + 1] in ("?", "*", "{") or "|" in pattern
    return not optional and re.fullmatch(pattern[body.end() : end - 1], "") is None


def _not_empty(c: Column) -> Column:
    """The value or null where it is empty; computes the value once, also inside a lambda."""
    return F.get(F.filter(F.array(c), lambda v: v != ""), F.lit(0))


def _extract(body: Column, patterns: Sequence[str], group_name: str) -> Column:
    """First pattern that matches: its named group, else all it matched."""
    found = []
    for pattern in patterns:
        plain, names = numbered_groups(pattern)
        if group_name in names:
            found.append(_not_empty(py_strip(F.regexp_extract(body, plain, names[group_name]))))
        if group_name not in names or not _always_filled(pattern, group_name):
            found.append(_not_empty(py_strip(F.regexp_extract(body, plain, 0))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def regex_metadata(
    body,
    heading_text,
    heading_path,
    rules: Mapping[str, list] = DEFAULT_RULES,
    known: Mapping[str, Column] | None = None,
    section_heading=None,
) -> dict[str, Column]:
    """Id, object number, section and level of a text; a known value wins, then text, then heading."""
    known = dict(known or {})
    whole, head = text(body), text(heading_text)
    out = {}
    for name in FIELDS:
        above = text(section_heading) if name == "section_id" and section_heading is not None else head
        patterns = rules.get(name, [])
        given = [F.nullif(known[name], F.lit(""))] if name in known else []
        out[name] = F.coalesce(*given, _extract(whole, patterns, name), _extract(above, patterns, name))
    given = [F.nullif(known["doc_level"], F.lit(""))] if "doc_level" in known else []
    levels = [
        F.when(target.rlike("(?U)" + pattern), F.lit(value))
        for target in (text(heading_path), whole)
        for pattern, value in rules.get("doc_level", [])
    ]
    out["doc_level"] = F.coalesce(*given, *levels, F.lit(None).cast("string"))
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?s).(\.[^.]*)\z", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*\z", "")


BASE_KEYS = ("source_path", "file_name", "file_ext", "doc_type", "doc_name", "doc_level", "tags", "doc_sha256")


def chunk_documents(
    df: DataFrame,
    path_col: str,
    text_col: str,
    rules: Mapping[str, list] = DEFAULT_RULES,
    doc_type: str = "md",
    max_chars: int = 1200,
    overlap: int = 200,
    joiner: str = " > ",
    ingest_timestamp: str | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Chunks of every document with their metadata and the hash of all chunk texts together.

    A document's blocks are exploded first, so that each rule runs once per block
    on plain columns; the fragments follow. Nothing is shuffled: a block brings
    the number of its first chunk. ``keep_empty`` gives a document without chunks
    one row with a null id.
    """
    small_batches(df)
    front, body = front_matter(text_col)
    path = _col(path_col)
    docs = df.select(
        path.alias("source_path"),
        front.alias("front"),
        content_sha(text_col).alias("doc_sha256"),
        blocks_of(body, joiner, max_chars, overlap).alias("blocks"),
    )
    texts = F.flatten(F.transform("blocks", lambda b: F.transform(b["fragments"], lambda f: f["text"])))
    # Hashed before the explode, else every piece would hash the whole document.
    hashed = docs.withColumn("content_sha256", content_sha(F.array_join(texts, "\n\n")))
    about_doc = ("source_path", "front", "doc_sha256", "content_sha256")
    blocks = hashed.select(*about_doc, F.explode_outer("blocks").alias("b")).select(*about_doc, "b.*")
    known = {n: F.col("front")[n] for n in (*FIELDS, "doc_level")}
    meta = regex_metadata(F.col("text"), F.col("heading_text"), F.col("heading_path"), rules, known)
    about_block = ("heading_path", "heading_text", "start_char", "first_chunk")
    described = blocks.select(*about_doc, *about_block, "fragments", *[c.alias(f"block_{n}") for n, c in meta.items()])
    pieces = described.select(
        *about_doc, *about_block, *[f"block_{n}" for n in meta], F.posexplode_outer("fragments").alias("at", "f")
    ).withColumn("chunk_index", F.col("first_chunk") + F.col("at"))
    if not keep_empty:
        pieces = pieces.where("chunk_index is not null")
    p = {
        "text": F.col("f.text"),
        "start_char": F.col("start_char") + F.col("f.start"),
        "end_char": F.col("start_char") + F.col("f.end"),
        "heading_path": F.col("heading_path"),
        "heading_text": F.col("heading_text"),
    }
    known = {n: F.col(f"block_{n}") for n in (*FIELDS, "doc_level")}
    above = F.coalesce(F.nullif(p["heading_text"], F.lit("")), p["heading_path"])
    meta = regex_metadata(p["text"], p["heading_text"], p["heading_path"], rules, known, section_heading=above)
    named = {*BASE_KEYS, *FIELDS}
    source = F.col("source_path")
    return pieces.select(
        F.when(F.col("chunk_index").isNotNull(), chunk_id(source, F.col("chunk_index"))).alias("id"),
        p["text"].alias("text"),
        "source_path",
        file_name(source).alias("file_name"),
        file_ext(source).alias("file_ext"),
        F.lit(doc_type).alias("doc_type"),
        F.coalesce(F.col("front")["doc_name"], file_stem(source)).alias("doc_name"),
        meta["doc_level"].alias("doc_level"),
        F.lit(ingest_timestamp).cast("string").alias("ingest_timestamp_utc"),
        "doc_sha256",
        "content_sha256",
        F.col("front")["tags"].alias("tags"),
        p["heading_path"].alias("heading_path"),
        meta["section_id"].alias("section_id"),
        meta["req_id"].alias("req_id"),
        meta["object_number"].alias("object_number"),
        "chunk_index",
        p["start_char"].alias("start_char"),
        p["end_char"].alias("end_char"),
        F.when(F.col("chunk_index").isNotNull(), content_sha(p["text"])).alias("chunk_sha256"),
        F.map_filter("front", lambda k, _: ~k.isin(*named)).alias("extra"),
    )


def heading_at_offset(chunks: DataFrame, headings: DataFrame, doc: str, start: str, position: str) -> DataFrame:
    """The last heading at or before each chunk's start; before the first one, the first.

    Headings and chunks go through one ordered scan per document, so nothing is
    joined row by row.
    """
    fields = [c for c in headings.columns if c not in (doc, position)]
    mark = F.struct(*fields)
    both = headings.select(
        doc, F.col(position).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__tie"), mark.alias("__head")
    ).unionByName(
        chunks.select(
            doc,
            F.col(start).alias("__at"),
            F.lit(1).alias("__kind"),
            # Chunks of one place see the same heading: the number only spreads them over ranges.
            F.xxhash64(F.to_json(F.struct(*chunks.columns))).alias("__tie"),
            F.struct(*chunks.columns).alias("__row"),
        ),
        allowMissingColumns=True,
    )
    scanned = ordered_scan(both, ["__at", "__kind", "__tie"], [doc], fills={"__seen": F.col("__head")})
    firsts = headings.groupBy(doc).agg(F.min_by(mark, position).alias("__first"))
    placed = scanned.where("__kind = 1").join(firsts, doc, "left").withColumn("__h", F.coalesce("__seen", "__first"))
    return placed.select(
        *[F.col("__row")[c].alias(c) for c in chunks.columns],
        *[F.coalesce(F.col("__h")[c], F.lit("")).alias(c) for c in fields],
    )


# --- pipe tables ---------------------------------------------------------------------

TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
# Fixed value: the line under a table's header.
SEPARATOR = re.compile(r"^\s*\|?\s*:?-+[-\s|:]*\|?\s*$")


def _cells(line: str) -> list[str]:
    bare = line.strip()
    bare = bare[1:] if bare.startswith("|") else bare
    bare = bare[:-1] if bare.endswith("|") else bare
    return [c.strip() for c in bare.split("|")]


def _tables(body: str) -> list[dict]:
    lines, out, at = body.split("\n"), [], 0
    while at + 1 < len(lines):
        if "|" not in lines[at] or not SEPARATOR.match(lines[at + 1]):
            at += 1
            continue
        end = at + 2
        while end < len(lines) and "|" in lines[end]:
            end += 1
        out.append({"headers": _cells(lines[at]), "rows": [_cells(x) for x in lines[at + 2 : end]]})
        at = end
    return out


def parse_pipe_tables(df: DataFrame, text_col: str) -> DataFrame:
    """One row per table row: table and row number, header cells and cells."""
    rest = [c for c in df.columns if c != text_col]

    @F.pandas_udf(TABLES)
    def find(bodies: pd.Series) -> pd.Series:
        return bodies.map(_tables)

    # Texts without a bar hold no table and never leave the JVM.
    holding = df.where(F.contains(text(text_col), F.lit("|")))
    tables = holding.select(*rest, F.posexplode_outer(find(text(text_col))).alias("table_index", "t"))
    return tables.where("table_index is not null").select(
        *rest, "table_index", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_index", "cells")
    )
