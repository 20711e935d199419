"""Requirement sheets -> one normalised table, its rejections and its star tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import ids as I
from tracegrid.functions.text import (
    BLANK_CLASS,
    BLANKS,
    clean_str,
    filled,
    first_filled,
    is_blank,
    named,
    text,
)
from tracegrid.operators.ordered import distinct_first, order_spans, order_value, ordered_scan, parts_of_group, row_number
from tracegrid.operators.storage import materialize

# Requirement types read as section headers, and object types never kept.
HEADER_WORDS = (
    "header",
    "heading",
    "section header",
    "section heading",
    "section title",
    "chapter header",
    "chapter heading",
)
SKIPPED_OBJECT_TYPES = ("info", "title")

NO_IDS = "<none>"


@dataclass(frozen=True)
class SectionRule:
    """Which columns of a sheet tell section headers from requirements."""

    text_columns: Sequence[str]
    object_number_column: str = "Object Number"
    type_column: str = "Requirement Type"
    header_types: Sequence[str] = ("header", "heading", "section header")


@dataclass(frozen=True)
class InferRule:
    """What may fill a blank section field, and which fields those are."""

    from_context: bool = True
    from_object_number: bool = True
    from_text: bool = True
    from_req_id: bool = True
    object_number: str = "Object_Number"
    section_number: str = "Section_Number"
    section_title: str = "Section_Title"
    section_type: str | None = "Section_Type"
    aliases: Sequence[str] = ("Section", "SectionTitle")


NO_INFERENCE = InferRule(False, False, False, False, aliases=())


@dataclass(frozen=True)
class DocKind:
    """How sheets of one document type are read."""

    doc_type: str
    normalizer: str
    ids: Sequence[str] = ("Requirement ID",)
    texts: Sequence[str] = ("Requirement Text",)
    required: Sequence[str] = ()
    optional: Sequence[str] = ()
    parents: Sequence[str] = ()
    children: Sequence[str] = ()
    sections: SectionRule | None = None
    infer: InferRule = field(default_factory=InferRule)
    aliases: Sequence[str] = ()


@dataclass(frozen=True)
class Document:
    """Name and level of the documents in a sheet; a Column where one sheet holds several."""

    name: str | Column
    doc_type: str | Column
    level: str | Column = ""

    def columns(self) -> dict[str, Column]:
        named = {"Doc_Name": self.name, "Doc_Type": self.doc_type, "Level": self.level}
        return {n: F.lit(v) if isinstance(v, str) else v for n, v in named.items()}


def missing_columns(df: DataFrame, kind: DocKind) -> list[str]:
    return [c for c in kind.required if c not in df.columns]


def validate_columns(sheets: Sequence[tuple[str, DataFrame, DocKind]]) -> DataFrame:
    """One row per document and required column it lacks, with the rows left unread for it."""
    reports = []
    for name, df, kind in sheets:
        lacking = F.array(*[F.lit(c) for c in missing_columns(df, kind)]).cast("array<string>")
        counted = df.agg(F.count("*").alias("rows")).where(F.size(lacking) > 0)
        reports.append(counted.select(F.lit(name).alias("Doc_Name"), F.explode(lacking).alias("missing_column"), "rows"))
    return reduce(DataFrame.unionByName, reports)


# --- section context -------------------------------------------------------


def _named(columns: Sequence[str], *words: str) -> list[str]:
    return [c for c in columns if all(w in c.lower() for w in words)]


def _title_columns(columns: Sequence[str]) -> list[str]:
    usable = [c for c in columns if "ole" not in c.lower()]

    def rank(c: str) -> int | None:
        low = c.lower()
        titled, headed = "title" in low or "name" in low, "heading" in low
        if ("section" in low or "chapter" in low) and (titled or headed):
            return 0
        return 1 if headed else 2 if titled else None

    return sorted([c for c in usable if rank(c) is not None], key=rank)


def header_parts(df: DataFrame, rule: SectionRule) -> dict[str, Column]:
    """Header test of a row with its text, object number and type."""
    has = set(df.columns)
    kind = clean_str(rule.type_column) if rule.type_column in has else F.lit("")
    number = clean_str(rule.object_number_column) if rule.object_number_column in has else F.lit("")
    words = [c for c in rule.text_columns if c in has]
    body = first_filled(*words) if words else F.lit("")
    low = F.lower(kind)
    typed = low.isin(*rule.header_types) if rule.header_types else F.lit(False)
    for word in HEADER_WORDS:
        typed = typed | F.contains(low, F.lit(word))
    by_number = (number != "") & ~F.contains(number, F.lit("-")) & (body != "")
    by_type = typed & (body != "") & (number == "")
    return {
        "header": by_number | by_type,
        "text": body,
        "number": number,
        "type": F.when(kind != "", kind).otherwise(F.when(by_number, "section").otherwise("header")),
    }


def section_context(
    df: DataFrame,
    rule: SectionRule,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    source_columns: Sequence[str] | None = None,
    counted: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add the section each row stands in, plus header flag, header count and row index.

    ``counted`` adds running counts of the rows where a condition, of the row alone, holds.

    A header assigns title, number and type; columns named after sections
    override it; every other row inherits. An assigned empty number is a value
    and resets what was inherited. Where several section number columns are
    filled the first one holds.
    """
    sheet = list(source_columns or [c for c in df.columns if c not in (*order_by, *partition_by)])
    parts = header_parts(df, rule)
    header = parts["header"]

    def assigned(columns: Sequence[str], from_header: Column) -> Column:
        own = [filled(c) for c in columns]
        return F.coalesce(*own, F.when(header, from_header))

    type_columns = _named(sheet, "section", "type")
    fills = {
        "ctx_title": assigned(_title_columns(sheet), parts["text"]),
        "ctx_number": assigned(_named(sheet, "section", "number"), parts["number"]),
        "ctx_type": assigned(type_columns, parts["type"]),
    }
    sums = {"ctx_headers": F.when(header, 1).otherwise(0).cast("long"), "ctx_row": F.lit(1).cast("long")}
    sums |= {n: F.when(c, 1).otherwise(0).cast("long") for n, c in (counted or {}).items()}
    if type_columns:
        df, fills["ctx_type"] = _type_runs(df, header, parts["type"], type_columns, order_by, partition_by)
    done = ordered_scan(df.withColumn("ctx_is_header", header), order_by, partition_by, fills, sums)
    return done.select(
        *[named(c) for c in done.columns if not c.startswith("ctx_") and c not in ("__type", "__before")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("ctx_title", "ctx_number", "ctx_type")],
        "ctx_is_header",
        "ctx_headers",
        (F.col("ctx_row") - 1).alias("Row_Index"),
    )


def _type_runs(df, header, header_type, type_columns, order_by, partition_by):
    """A type cell equal to the current type but for case leaves its spelling alone."""
    cell = F.coalesce(*[filled(c) for c in type_columns])
    latest = F.lower(F.coalesce(cell, F.when(header, header_type)))
    numbered = ordered_scan(df, order_by, partition_by, sums={"__at": F.lit(1).cast("long")})
    seen = ordered_scan(numbered, order_by, partition_by, fills={"__type": F.struct(latest.alias("t"), F.col("__at").alias("at"))})
    before = ordered_scan(
        seen.withColumn("__here", latest), order_by, partition_by,
        fills={"__prior": F.when(F.col("__here").isNotNull(), F.struct(F.col("__here").alias("t"), F.col("__at").alias("at")))},
    )
    shifted = before.withColumn("__next_at", F.col("__at") + 1)
    prior = shifted.select(*partition_by, F.col("__next_at").alias("__at"), F.col("__prior")["t"].alias("__before"))
    joined = before.drop("__prior", "__here", "__type").join(prior, [*partition_by, "__at"], "left").drop("__at")
    same = F.lower(F.coalesce(F.when(header, header_type), F.col("__before"))) == F.lower(cell)
    return joined, F.when(cell.isNotNull() & ~F.coalesce(same, F.lit(False)), cell).otherwise(F.when(header, header_type))


# --- filling blank section fields -------------------------------------------


def _leading_number(body: Column) -> tuple[Column, Column, Column]:
    """Does the text start with a section number; that number; the rest as a title."""
    pattern = r"^(\d+(?:[.\-]\d+)*[A-Za-z]?)[.\-" + BLANKS + r"]+([^\n]*)\z"
    number = F.regexp_extract(body, pattern, 1)
    return number != "", number, clean_str(F.regexp_extract(body, pattern, 2))


def _id_parts(req_id: Column) -> tuple[Column, Column]:
    """Section and object number hidden in an id such as ``DOC-3.2-1a``."""
    tokens = F.filter(F.split(text(req_id), "-"), lambda t: t != "")
    prefixed = F.coalesce(F.get(tokens, F.lit(0)).rlike(r"^\p{L}+$"), F.lit(False)) & (F.size(tokens) > 1)
    rest = F.when(prefixed, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)
    section = F.array_join(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), "-")
    return clean_str(section), clean_str(F.get(rest, F.size(rest) - 1))


def infer_sections(df: DataFrame, rule: InferRule, context: dict[str, Column] | None = None) -> DataFrame:
    """Fill blank section fields from context, object number, text and id, in that order.

    Each field takes its first non-blank candidate, so the rule is one
    ``coalesce`` per field. ``Section_Inferred`` is true where anything was set.
    """
    ctx = {k: text(v) for k, v in (context or {}).items()}
    title, number, kind = (ctx.get(k, F.lit("")) for k in ("title", "number", "type"))
    candidates: dict[str, list[Column]] = {}

    def field_name(target: str) -> str:
        spellings = [target, target.replace(" ", "_"), target.replace(" ", "_").replace("-", "_")]
        return next((s for s in spellings if s in df.columns), spellings[-1])

    def offer(target: str | None, value: Column) -> None:
        if target:
            candidates.setdefault(field_name(target), []).append(filled(value))

    def present(target: str) -> list[Column]:
        name = field_name(target)
        return ([filled(name)] if name in df.columns else []) + candidates.get(name, [])

    if rule.from_context:
        offer(rule.section_title, title)
        offer(rule.section_number, number)
        offer(rule.section_type, kind)
        for alias in rule.aliases:
            low = alias.lower()
            named = title if "title" in low else number if "number" in low else kind if "type" in low else None
            offer(alias, F.coalesce(filled(title), filled(number)) if named is None else named)
        offer(rule.object_number, number)
    if rule.from_object_number:
        offer(rule.section_number, F.coalesce(*present(rule.object_number), F.lit("")))
    if rule.from_text and "Requirement_Text" in df.columns:
        body = clean_str("Requirement_Text")
        numbered, lead, rest = _leading_number(body)
        offer(rule.section_number, F.when(numbered, lead))
        offer(rule.section_title, F.when(numbered, rest).otherwise(F.when(F.char_length(body) < 150, body)))
    if rule.from_req_id:
        section, number_part = _id_parts(F.col("Req_ID"))
        offer(rule.section_number, section)
        offer(rule.object_number, number_part)

    inferred = F.coalesce(F.col("Section_Inferred"), F.lit(False)) if "Section_Inferred" in df.columns else F.lit(False)
    new: dict[str, Column] = {}
    for name, values in candidates.items():
        offered = F.coalesce(*values)
        if name in df.columns:
            new[name] = F.when(is_blank(name) & offered.isNotNull(), offered).otherwise(F.col(name))
            inferred = inferred | (is_blank(name) & offered.isNotNull())
        else:
            new[name] = offered
            inferred = inferred | offered.isNotNull()
    return df.withColumns({**new, "Section_Inferred": inferred})


# --- the four kinds of sheet -------------------------------------------------


def _joined_texts(df: DataFrame, columns: Sequence[str]) -> Column:
    known = [filled(c) for c in columns if c in df.columns]
    return F.concat_ws(" | ", *known) if known else F.lit("")


def _id_list(df: DataFrame, columns: Sequence[str], dedupe: bool) -> Column:
    known = [I.parse_id_list(c) for c in columns if c in df.columns]
    if not known:
        return F.array().cast("array<string>")
    ids = F.concat(*known)
    return F.array_distinct(ids) if dedupe else ids


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), filled(value))


def combined_text(
    lines: Sequence[Column], parents: Column | None, children: Column | None, body: Column
) -> Column:
    """Labelled lines (nulls left out), trace lines, then the text after a blank line."""
    every = list(lines)
    for name, ids in (("Parent Requirements", parents), ("Child Requirements", children)):
        if ids is not None:
            every.append(F.concat(F.lit(f"{name}: "), F.coalesce(filled(ids), F.lit(NO_IDS))))
    tail = F.when(body != "", F.concat(F.lit("\nRequirement Text:\n"), body))
    return F.concat_ws("\n", *every, tail)


def _reject(df: DataFrame, doc: Document, raw_id: Column, object_number: Column) -> DataFrame:
    number = clean_str("Section_Number") if "Section_Number" in df.columns else F.lit("")
    return df.where(F.col("__reason").isNotNull()).select(
        *[e.alias(n) for n, e in doc.columns().items()],
        F.col("__reason").alias("Reason"),
        raw_id.alias("Raw_Requirement_ID"),
        object_number.alias("Object_Number"),
        number.alias("Section_Number"),
        "Row_Index",
    )


def normalize_traceable(
    df: DataFrame,
    kind: DocKind,
    doc: Document,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    source_columns: Sequence[str] | None = None,
    dedupe_links: bool = True,
    place: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sheets with one row per requirement and section headers in between.

    Returns the accepted rows and the rejections. ``dedupe_links=False`` keeps
    an id that appears in two trace columns twice. ``place`` names a column for the
    1-based number of an accepted row among those of its sheet, counted in the same scan.
    """
    rule = kind.sections or SectionRule(kind.texts)
    id_cell = clean_str(kind.ids[0]) if kind.ids[0] in df.columns else F.lit("")
    number_known = rule.object_number_column in df.columns
    number = clean_str(rule.object_number_column) if number_known else F.lit("")
    header = F.col("ctx_is_header")
    reason = F.when(~header & (F.size("__ids") == 0), "missing_requirement_id").when(
        ~header & (number == ""), "missing_object_number"
    )
    taken = header_parts(df, rule)["header"] | ((F.size(I.normalized_ids(id_cell)) > 0) & (number != ""))
    ctx = section_context(df, rule, order_by, partition_by, source_columns, {place: taken} if place else None)
    parsed = {
        "__ids": I.normalized_ids(id_cell),
        "__parents": _id_list(df, kind.parents, dedupe_links),
        "__children": _id_list(df, kind.children, dedupe_links),
    }
    # Both results read the scanned sheet, so it is kept, with its id lists parsed once.
    marked = materialize(ctx.withColumns(parsed).withColumn("__reason", reason), "zstd")
    rejected = _reject(marked, doc, id_cell, number)

    names = doc.columns()
    raw_type = [c for c in ("Requirement_Type", "Requirement Type") if c in df.columns][:1]
    req_type = clean_str(raw_type[0]) if raw_type else F.lit("")
    parents, children = F.array_join("__parents", ", "), F.array_join("__children", ", ")
    body = _joined_texts(df, kind.texts)
    primary, aliases = I.first_id("__ids"), I.other_ids("__ids")
    optional = [c for c in kind.optional if c in df.columns]
    of_document = F.concat(F.lit("Document: "), names["Doc_Name"], F.lit(" ("), names["Doc_Type"], F.lit(")"))
    of_level = F.concat(F.lit("Level: "), names["Level"])

    # Header texts are joined by a backslash and an n, not by a line break.
    header_text = F.concat_ws(
        "\\n",
        F.concat(F.lit("Section: "), F.coalesce(filled(number), F.lit("N/A"))),
        F.concat(F.lit("Title: "), F.col("ctx_title")),
        of_document,
        of_level,
    )
    row_text = combined_text(
        [
            F.concat(F.lit("Requirement ID: "), primary),
            of_document,
            of_level,
            _line("Section Title", F.col("ctx_title")),
            _line("Section Number", F.col("ctx_number")),
            _line("Aliases", aliases),
            *[_line(c, F.col(f"`{c}`")) for c in optional],
        ],
        parents,
        children,
        body,
    )
    header_id = F.coalesce(
        filled(id_cell), filled(number), F.concat(F.lit("SECTION_"), F.col("ctx_headers").cast("string"))
    )
    own_type = F.when(F.lower(req_type) == "header", F.col("ctx_type")).otherwise(
        F.coalesce(filled(req_type), F.col("ctx_type"))
    )

    def unless_header(c: Column) -> Column:
        return F.when(header, F.lit("")).otherwise(c)

    accepted = marked.where(F.col("__reason").isNull()).select(
        F.when(header, header_id).otherwise(primary).alias("Req_ID"),
        unless_header(aliases).alias("Aliases"),
        *[e.alias(n) for n, e in names.items()],
        number.alias("Object_Number"),
        body.alias("Requirement_Text"),
        unless_header(parents).alias("Parent_Req_IDs"),
        unless_header(children).alias("Child_Req_IDs"),
        F.when(header, header_text).otherwise(row_text).alias("Combined_Text"),
        F.col("ctx_title").alias("Section_Title"),
        F.col("ctx_number").alias("Section_Number"),
        F.when(header, F.col("ctx_type")).otherwise(own_type).alias("Section_Type"),
        header.alias("Is_Section_Header"),
        *[F.when(~header, clean_str(f"`{c}`")).alias(c.replace(" ", "_")) for c in optional],
        *[F.col(f"ctx_{k}") for k in ("title", "number", "type")],
        "Row_Index",
        *([place] if place else []),
    )
    context = {k: F.col(f"ctx_{k}") for k in ("title", "number", "type")}
    return infer_sections(accepted, kind.infer, context).drop("ctx_title", "ctx_number", "ctx_type"), rejected


def merge_duplicates(
    df: DataFrame,
    group_cols: Sequence[str],
    order_by: Sequence[str],
    id_columns: Sequence[str] = (),
    text_columns: Sequence[str] = (),
    part_size: int | None = None,
) -> DataFrame:
    """One row per group: its first row, plus maps of merged id and text columns.

    ``ids[c]``: distinct ids of column c over the group's rows in order.
    ``texts[c]``: distinct non-blank values. Values are made distinct before
    they are collected, so a group of many copies stays small. With ``part_size``
    a group whose columns have more distinct values comes in several rows, ``part``
    1, 2, ... of ``parts``, each with at most so many values of a column, in order:
    no cell and no task grows with a group.
    """
    gid = F.sha2(F.to_json(F.struct(*[text(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group_cols)])), 256)
    spans = order_spans(df, order_by)
    keyed = df.withColumn("__gid", gid).withColumn("__place", order_value(df, order_by, spans))
    ids = [c for c in id_columns if c in df.columns]
    texts = [c for c in text_columns if c in df.columns]
    firsts = keyed.groupBy("__gid").agg(F.min("__place").alias("__place"), F.count("*").alias("group_rows"))
    base = keyed.join(firsts, ["__gid", "__place"])
    known = base.drop("__place").withColumn("m", F.lit(None).cast("map<string,array<string>>"))
    if part_size:
        known = known.withColumn("part", F.lit(1)).withColumn("parts", F.lit(1))
    if ids or texts:
        maps = _merged_values(keyed, order_by, ids, texts, part_size, spans)
        known = base.drop("__place").join(maps, "__gid", "left")
        if part_size:
            known = known.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("part", "parts")})
    none = F.array().cast("array<string>")
    return known.select(
        *map(named, df.columns),
        "group_rows",
        *(["part", "parts"] if part_size else []),
        F.create_map(*[x for c in ids for x in (F.lit(c), F.coalesce(F.col("m")[f"i:{c}"], none))]).alias("ids")
        if ids else F.create_map().cast("map<string,array<string>>").alias("ids"),
        F.create_map(*[x for c in texts for x in (F.lit(c), F.array_join(F.coalesce(F.col("m")[f"t:{c}"], none), " | "))]).alias("texts")
        if texts else F.create_map().cast("map<string,string>").alias("texts"),
    )


def _merged_values(
    keyed: DataFrame, order_by: Sequence[str], ids: Sequence[str], texts: Sequence[str], part_size: int | None, spans: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Per group, and part, the map ``m`` from ``i:`` or ``t:`` and column to its distinct values in order."""

    def entry(name: str, pos: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), pos.cast("int").alias("__pos"), value.alias("value"))

    def id_entries(c: str) -> Column:
        return F.transform(I.parse_id_list(f"`{c}`"), lambda v, i: entry(f"i:{c}", i, v))

    lists = [id_entries(c) for c in ids]
    if texts:
        lists.append(F.array(*[entry(f"t:{c}", F.lit(0), clean_str(f"`{c}`")) for c in texts]))
    order = [f"__o{i}" for i, _ in enumerate(order_by)]
    places = [named(c).alias(o) for c, o in zip(order_by, order, strict=True)]
    values = keyed.select("__gid", *places, F.inline(F.concat(*lists))).where("value <> ''")
    known = {o: spans[c] for c, o in zip(order_by, order, strict=True) if c in spans} | {"__pos": (0, (1 << 31) - 1)}
    values = values.withColumn("at", order_value(values, [*order, "__pos"], known))
    firsts = values.groupBy("__gid", "name", "value").agg(F.min("at").alias("at"))
    part = []
    if part_size:
        # Values of one place in two texts of a column, as ids have, keep their order by place and value.
        firsts = parts_of_group(materialize(firsts), ["__gid", "name"], ["at", "value"], part_size)
        part = ["part"]
    joined = firsts.groupBy("__gid", "name", *part).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    entries = F.collect_list(F.struct("name", F.transform("v", lambda x: x["value"]).alias("v")))
    maps = joined.groupBy("__gid", *part).agg(F.map_from_entries(entries).alias("m"))
    if not part_size:
        return maps
    maps = materialize(maps)
    return maps.join(maps.groupBy(F.col("__gid").alias("__of")).agg(F.max("part").alias("parts")), F.col("__gid") == F.col("__of")).drop("__of")


def normalize_merged(
    df: DataFrame, kind: DocKind, doc: Document, order_by: Sequence[str], source_columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sheets where rows of one requirement repeat: merged, with an id built from section and number.

    The second frame holds ``duplicate_rows_collapsed`` per document.
    """
    sheet = list(source_columns or [c for c in df.columns if c not in order_by])
    section_col, number_col, text_col = kind.ids[0], kind.ids[1], kind.texts[0]
    names = doc.columns()
    numbered = row_number(df, order_by, "Row_Index").withColumn("Row_Index", F.col("Row_Index") - 1)
    titles = [c for c in sheet if "title" in c.lower() and "ole" not in c.lower()]
    optional = [c for c in kind.optional if c in df.columns]
    group = ["__Doc_Name", *[c for c in (section_col, number_col, text_col) if c in df.columns]]
    prepared = materialize(numbered.withColumns({f"__{n}": e for n, e in names.items()}))
    merged = merge_duplicates(
        prepared, group, ["Row_Index"], [*kind.parents, *kind.children], list(dict.fromkeys([*titles, *optional]))
    )
    section, number, body = (clean_str(f"`{c}`") for c in (section_col, number_col, text_col))
    title = F.coalesce(*[filled(F.col("texts")[c]) for c in titles], F.lit("")) if titles else F.lit("")
    none = F.array().cast("array<string>")

    def linked(columns: Sequence[str]) -> Column:
        known = [F.col("ids")[c] for c in columns if c in df.columns]
        return F.array_join(F.array_distinct(F.concat(*known)) if known else none, ", ")

    req_id = I.make_srs_req_id(section, number)
    parents, children = linked(kind.parents), linked(kind.children)
    doc_name, doc_type, level = (F.col(f"__{n}") for n in names)
    accepted = merged.select(
        req_id.alias("Req_ID"),
        F.lit("").alias("Aliases"),
        doc_name.alias("Doc_Name"),
        doc_type.alias("Doc_Type"),
        level.alias("Level"),
        section.alias("SRS_Section"),
        number.alias("SRS_Local_Req_No"),
        body.alias("Requirement_Text"),
        parents.alias("Parent_Req_IDs"),
        children.alias("Child_Req_IDs"),
        combined_text(
            [
                F.concat(F.lit("Requirement ID: "), req_id),
                F.concat(F.lit("Document: "), doc_name, F.lit(" ("), doc_type, F.lit(")")),
                F.concat(F.lit("Level: "), level),
                _line("SRS Section", section),
                _line("SRS Local Req Number", number),
                _line("Section Title", title),
                *[_line(c, F.col("texts")[c]) for c in optional],
            ],
            parents,
            children,
            body,
        ).alias("Combined_Text"),
        title.alias("Section_Title"),
        section.alias("Section_Number"),
        F.lit("").alias("Section_Type"),
        F.lit(False).alias("Is_Section_Header"),
        "Row_Index",
    )
    collapsed = merged.groupBy(doc_name.alias("Doc_Name"), doc_type.alias("Doc_Type")).agg(
        F.sum(F.col("group_rows") - 1).alias("duplicate_rows_collapsed")
    )
    context = {"title": F.col("Section_Title"), "number": F.col("Section_Number"), "type": F.lit("")}
    return infer_sections(accepted, kind.infer, context), collapsed


def normalize_guideline(
    df: DataFrame,
    kind: DocKind,
    doc: Document,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    skip_object_types: Sequence[str] = (),
    place: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Guideline sheets: no sections, rows of some object types are filtered out.

    ``place`` names a column for the 1-based number of an accepted row among those of its sheet.
    """
    id_cell = clean_str(f"`{kind.ids[0]}`") if kind.ids[0] in df.columns else F.lit("")
    body = clean_str(f"`{kind.texts[0]}`") if kind.texts[0] in df.columns else F.lit("")
    object_type = clean_str("`Object Type`") if "Object Type" in df.columns else F.lit("")
    number = clean_str("`Object Number`") if "Object Number" in df.columns else F.lit("")
    skipped = list(SKIPPED_OBJECT_TYPES) + [t.lower() for t in skip_object_types]
    dropped = (object_type != "") & F.lower(object_type).isin(*skipped)
    if any(t == "" for t in skip_object_types):
        dropped = dropped | (object_type == "")
    reason = F.when(F.size("__ids") == 0, F.lit("missing_requirement_id")).when(
        dropped, F.concat(F.lit("filtered_object_type:"), object_type)
    )
    sums = {"Row_Index": F.lit(1).cast("long")}
    if place:
        sums[place] = F.when((F.size(I.normalized_ids(id_cell)) > 0) & ~dropped, 1).otherwise(0).cast("long")
    numbered = ordered_scan(df, order_by, partition_by, sums=sums).withColumn("Row_Index", F.col("Row_Index") - 1)
    marked = materialize(numbered.withColumn("__ids", I.normalized_ids(id_cell)).withColumn("__reason", reason), "zstd")
    names = doc.columns()
    primary, aliases = I.first_id("__ids"), I.other_ids("__ids")
    optional = [c for c in kind.optional if c in df.columns]
    accepted = marked.where(F.col("__reason").isNull()).select(
        primary.alias("Req_ID"),
        aliases.alias("Aliases"),
        *[e.alias(n) for n, e in names.items()],
        body.alias("Requirement_Text"),
        combined_text(
            [
                F.concat(F.lit("Requirement ID: "), primary),
                F.concat(F.lit("Document: "), names["Doc_Name"], F.lit(" ("), names["Doc_Type"], F.lit(")")),
                F.concat(F.lit("Level: "), names["Level"]),
                _line("Aliases", aliases),
                *[_line(c, F.col(f"`{c}`")) for c in optional],
            ],
            None,
            None,
            body,
        ).alias("Combined_Text"),
        F.lit("").alias("Parent_Req_IDs"),
        F.lit("").alias("Child_Req_IDs"),
        "Row_Index",
        *([place] if place else []),
    )
    return infer_sections(accepted, kind.infer), _reject(marked, doc, id_cell, number)


# --- over the whole set of requirements --------------------------------------


def flag_header_types(reqs: DataFrame) -> DataFrame:
    """``Requirement_Type`` becomes ``Header`` where number fields look like a section's."""
    has = set(reqs.columns)
    kind = next((c for c in ("Requirement_Type", "Requirement Type") if c in has), None)
    current = text(f"`{kind}`") if kind else F.lit("")
    number = text("Object_Number") if "Object_Number" in has else F.lit("")
    section = text("Section_Number") if "Section_Number" in has else F.lit("")
    plain = (number != "") & ~F.contains(number, F.lit("-"))
    by_section = (number == "") & (section != "") & ~F.contains(section, F.lit("-"))
    marked = (plain | by_section) & (F.lower(clean_str(current)) != "requirement")
    return reqs.withColumn("Requirement_Type", F.when(marked, "Header").otherwise(current))


def build_star(reqs: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """Documents, requirements and traces with ids in order of first appearance."""
    order = list(order_by)
    first_docs = materialize(distinct_first(reqs.select("Doc_Name", "Doc_Type", "Level", *order), ["Doc_Name"], order))
    documents = row_number(first_docs, order, "id").select(
        "id", F.col("Doc_Name").alias("doc_name"), F.col("Doc_Type").alias("doc_type"), F.col("Level").alias("level")
    )
    wanted = {
        "requirement_text": "Requirement_Text",
        "combined_text": "Combined_Text",
        "section_number": "Section_Number",
        "section_title": "Section_Title",
        "aliases": "Aliases",
    }
    cells = [
        (F.col(c) if c in reqs.columns else F.lit("")).alias(n) for n, c in wanted.items()
    ]
    slim = reqs.where(F.col("Req_ID").isNotNull()).select(
        F.col("Req_ID").alias("req_id"), F.col("Doc_Name").alias("doc_name"), *cells, *order
    )
    unique = row_number(materialize(distinct_first(slim, ["req_id", "doc_name"], order)), order, "id")
    requirements = unique.join(
        documents.select(F.col("id").alias("doc_id"), "doc_name"), "doc_name"
    ).select("id", "req_id", "doc_id", *wanted)

    at = F.struct(*order)
    links = F.concat(
        F.transform(
            I.split_ids("Parent_Req_IDs"),
            lambda p, i: F.struct(F.lit(0).alias("side"), i.alias("pos"), F.col("Req_ID").alias("source_req_id"), p.alias("target_req_id")),
        ),
        F.transform(
            I.split_ids("Child_Req_IDs"),
            lambda c, i: F.struct(F.lit(1).alias("side"), i.alias("pos"), c.alias("source_req_id"), F.col("Req_ID").alias("target_req_id")),
        ),
    )
    edges = reqs.select(at.alias("at"), F.inline(links)).groupBy("source_req_id", "target_req_id").agg(
        F.min(F.struct("at", "side", "pos")).alias("first")
    )
    traces = row_number(materialize(edges), ["first"], "id").select(
        "id", "source_req_id", "target_req_id", F.lit("parent").alias("trace_type")
    )
    return {"documents": documents, "requirements": requirements, "traces": traces}


def normalization_summary(totals: DataFrame, reqs: DataFrame, rejects: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """Per document: rows read, rows produced, and rows skipped by reason."""
    doc = ["Doc_Name", "Doc_Type"]
    produced = reqs.groupBy(*doc).agg(
        F.count("*").alias("produced_rows"),
        F.count_if(F.coalesce(F.col("Is_Section_Header"), F.lit(False))).alias("section_headers"),
    )
    skipped = rejects.groupBy(*doc).agg(
        F.count_if(F.col("Reason") == "missing_requirement_id").alias("missing_requirement_id"),
        F.count_if(F.col("Reason") == "missing_object_number").alias("missing_object_number"),
        F.count_if(F.startswith("Reason", F.lit("filtered_object_type:"))).alias("filtered_object_type"),
    )
    joined = totals.join(produced, doc, "left").join(skipped, doc, "left")
    if collapsed is not None:
        joined = joined.join(collapsed, doc, "left")
    else:
        joined = joined.withColumn("duplicate_rows_collapsed", F.lit(0).cast("long"))
    counts = [c for c in joined.columns if c not in doc]
    return joined.select(*doc, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
