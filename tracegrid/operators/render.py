"""Requirements as text: tables of (doc_slug, folder, file_name, content), not files.

Documents that gather a whole group come in numbered parts, cut after a fixed
number of lines; the parts joined by a line break are the document. Only a very
large group has more than one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import ids as I
from tracegrid.functions.text import (
    bool_from_value,
    clean_str,
    filled,
    first_filled,
    heading_block,
    named,
    single_line,
    slugify,
    text,
    value_or_na,
    word_count,
)
from tracegrid.operators import ordered
from tracegrid.operators.storage import materialize
from tracegrid.operators.trace import (
    link_context,
    own_title,
    resolve_number,
    section_titles,
    with_section_title,
)
from tracegrid.operators.views import (
    ANCHOR,
    anchor,
    bucket_blocks,
    row_sort_key,
    neighbour_value,
    section_member,
    section_order,
    unique_names,
)

# Length limits of names.
MAX_STEM, MAX_FOLDER = 100, 80
PART_LINES = 1000
SHORT_TEXT = 100

L = F.lit


def cell(df: DataFrame, *names: str) -> Column:
    """Stripped text of the first of these columns that is filled."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_filled(*there) if there else L("")


def lines(*parts: Column) -> Column:
    """Lines joined by line breaks; nulls are left out, empty lines are kept."""
    return F.concat_ws("\n", *parts)


def quoted(name: str, value: Column) -> Column:
    return F.concat(L(f'{name}: "'), value, L('"'))


def optional(prefix: str, value: Column) -> Column:
    """The prefixed value, or null where it is empty."""
    return F.when(value != "", F.concat(L(prefix), value))


def block(condition: Column, *parts: Column) -> Column:
    return F.when(condition, lines(*parts))


# --- titles and folders ------------------------------------------------------------


def section_title_maps(reqs: DataFrame, order_by: Sequence[str], levels: int = 3, per_document: bool = False) -> DataFrame:
    """First title per section number and per section prefix, as (kind, section, title) rows.

    Keyed by number alone, across documents, unless ``per_document``.
    """
    keys = ["Doc_Name"] if per_document else []
    numbers = section_titles(reqs, order_by, per_document).select(L("number").alias("kind"), *keys, "section", "title")
    number, title = resolve_number(reqs), own_title(reqs)
    titled = reqs.where((number != "") & (title != ""))
    spread = titled.select(
        *keys, F.struct(*order_by).alias("o"), title.alias("t"), F.explode(I.section_path(number, levels)).alias("section")
    )
    prefixes = spread.groupBy(*keys, "section").agg(F.min_by("t", "o").alias("title"))
    return numbers.unionByName(prefixes.select(L("prefix").alias("kind"), *keys, "section", "title"))


def section_folders(reqs: DataFrame, order_by: Sequence[str], levels: int = 3) -> DataFrame:
    """Folder path of each distinct section number: ``1_Title/1_2_Title/...``."""
    prefixes = section_title_maps(reqs, order_by, levels).where("kind = 'prefix'").select(
        F.col("section").alias("prefix"), "title"
    )
    number = resolve_number(reqs)
    sections = reqs.where(number != "").select(number.alias("folder_section")).distinct()
    steps = sections.select("folder_section", F.posexplode(I.section_path("folder_section", levels)).alias("pos", "prefix"))
    plain = F.replace("prefix", L("."), L("_"))
    named = F.when(F.coalesce("title", L("")) != "", F.concat(plain, L("_"), slugify("title"))).otherwise(plain)
    joined = steps.join(prefixes, "prefix", "left").select("folder_section", "pos", F.substring(named, 1, MAX_FOLDER).alias("name"))
    return joined.groupBy("folder_section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "/").alias("section_folder")
    )


def _placed(reqs: DataFrame, order_by: Sequence[str], hierarchical: bool, extension: str) -> DataFrame:
    """Add ``doc_slug``, ``folder`` and a ``file_name`` unique within its folder."""
    doc = F.coalesce(filled("Doc_Name"), L("UNKNOWN"))
    slugged = reqs.withColumn("doc_slug", slugify(doc))
    if hierarchical:
        folders = section_folders(reqs, order_by)
        slugged = slugged.join(folders, F.col("resolved_number") == F.col("folder_section"), "left")
        slugged = slugged.withColumn("folder", F.concat_ws("/", "doc_slug", "section_folder")).drop(
            "folder_section", "section_folder"
        )
    else:
        slugged = slugged.withColumn("folder", F.col("doc_slug"))
    # Row numbers and names are worked out on ids and folders, not on the texts.
    slim = materialize(slugged.select(*order_by, "folder", "doc_slug", filled("Req_ID").alias("__id")))
    slim = ordered.row_number(slim, order_by, "__row")
    stem = slugify(F.coalesce("__id", F.concat(L("row_"), F.col("__row").cast("string"))))
    named = unique_names(slim, ["folder"], stem, order_by, "__name", MAX_STEM)
    file_name = F.concat("__name", L(f".{extension}")).alias("file_name")
    return reqs.join(named.select(*order_by, "doc_slug", "folder", "__row", file_name), list(order_by))


FILE_COLUMNS = ("doc_slug", "folder", "file_name", "content")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), L(False)) if name in df.columns else L(False)


# --- one document per requirement -----------------------------------------------------


def requirement_markdown(
    reqs: DataFrame, order_by: Sequence[str], hierarchical: bool = False, include_text: bool = False
) -> DataFrame:
    """Front matter, heading, summary, text and context of each requirement."""
    df = _placed(with_section_title(reqs, order_by), order_by, hierarchical, "md")
    get = lambda *names: cell(df, *names)
    req_id, doc, body, context = get("Req_ID"), get("Doc_Name"), get("Requirement_Text"), get("Combined_Text")
    section = first_filled(get("Object_Number"), F.col("resolved_number"))
    title, version, inferred = F.col("resolved_title"), get("Schema_Version"), _flag(df, "Section_Inferred")
    fields = {
        "Req_ID": req_id,
        "Doc_Name": doc,
        "Doc_Type": get("Doc_Type"),
        "Requirement_Type": get("Requirement_Type"),
        "Level": get("Level"),
        "Parents": get("Parent_Req_IDs"),
        "Children": get("Child_Req_IDs"),
        "Aliases": get("Aliases"),
        "SRS_Local_Req_No": get("SRS_Local_Req_No"),
        "Section": section,
        "Section_Title": title,
        "Section_Type": get("Section_Type"),
    }
    escaped = F.replace(F.replace(body, L('"'), L('\\"')), L("\n"), L("\\n"))
    front = [
        L("---"),
        *[quoted(n, v) for n, v in fields.items()],
        F.when(version != "", quoted("Schema_Version", version)),
        F.concat(L("Section_Inferred: "), inferred.cast("string")),
        F.when((body != "") & L(include_text), quoted("Requirement Text", escaped)),
        L("---"),
        L(""),
    ]
    heading = (
        F.when((doc != "") & (req_id != ""), F.concat(L("# ["), doc, L("] "), req_id))
        .when(req_id != "", F.concat(L("# "), req_id))
        .otherwise("# Requirement")
    )
    summary = F.concat_ws(
        "  \n",
        *[
            optional(f"**{label}:** ", fields[name])
            for label, name in (
                ("Level", "Level"),
                ("Doc Type", "Doc_Type"),
                ("Parents", "Parents"),
                ("Children", "Children"),
                ("Aliases", "Aliases"),
                ("Requirement Type", "Requirement_Type"),
                ("SRS Local Req No", "SRS_Local_Req_No"),
                ("Section", "Section"),
                ("Section Title", "Section_Title"),
                ("Section Type", "Section_Type"),
            )
        ],
        optional("**Schema Version:** ", version),
        F.when(inferred, L("**Section Context:** inferred")),
    )
    content = lines(
        *front,
        heading,
        L(""),
        block(summary != "", summary, L("")),
        block(body != "", L("## Requirement Text\n"), body, L("")),
        block(context != "", L("---\n\n## Combined Context\n"), context, L("")),
    )
    return df.select(*order_by, "doc_slug", "folder", "file_name", content.alias("content"))


def rag_text(reqs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Labelled plain text of each requirement; blank fields have no line."""
    df = _placed(with_section_title(reqs, order_by), order_by, False, "txt")
    get = lambda *names: cell(df, *names)
    shown_id = F.coalesce(filled("Req_ID"), F.concat(L("row_"), F.col("__row").cast("string")))
    labelled = (
        ("Requirement ID", shown_id),
        ("Doc Name", F.coalesce(filled("Doc_Name"), L("UNKNOWN"))),
        ("Doc Type", get("Doc_Type")),
        ("Level", get("Level")),
        ("Schema Version", get("Schema_Version")),
        ("Section", F.col("resolved_number")),
        ("Section Title", F.col("resolved_title")),
        ("Section Type", get("Section_Type")),
        ("Requirement Type", get("Requirement_Type")),
        ("Parents", get("Parent_Req_IDs")),
        ("Children", get("Child_Req_IDs")),
        ("Aliases", get("Aliases")),
        ("Requirement Text", get("Requirement_Text")),
    )
    body = lines(
        L("Tag: Info"), *[optional(f"{n}: ", v) for n, v in labelled], optional("\nCombined Text:\n", get("Combined_Text"))
    )
    return df.select(*order_by, "doc_slug", "folder", "file_name", F.concat(body, L("\n")).alias("content"))


def _numbered(side: int):
    """Link entries of one side, with their place in the list."""
    return lambda rid, i: F.struct(L(side).alias("side"), i.alias("pos"), rid.alias("rid"))


def _trace_lists(kept: DataFrame, short: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per row of ``short`` (as ``__to``) its linked ids, each with the text of the first row of that id.

    Rows and their link targets meet by row number first; a text then travels once
    to where it is read and once per link to the row that shows it.
    """
    entries = [F.transform(I.split_ids(c), _numbered(n)) for n, c in enumerate(("Parent_Req_IDs", "Child_Req_IDs"))]
    links = short.select(*order, F.inline(F.concat(*entries)))
    named_id = clean_str("Req_ID")
    first = short.where(named_id != "").groupBy(named_id.alias("__id")).agg(F.min_by("__at", F.struct(*order)).alias("__first"))
    # Ids no row carries keep apart by a number no row has.
    unknown = F.lit(-1) - F.pmod(F.xxhash64("rid"), F.lit(1 << 40))
    met = (
        links.join(short.select(*order, F.col("__at").alias("__to")), list(order))
        .join(first, F.col("rid") == F.col("__id"), "left")
        .select("__to", "side", "pos", "rid", F.coalesce("__first", unknown).alias("__from"))
    )
    texts = kept.select(F.col("__at").alias("__from"), single_line("Requirement_Text").alias("__text"))
    line = F.when(F.col("__text") != "", F.concat("rid", L(": "), F.col("__text"))).otherwise(F.col("rid"))
    found = met.join(texts, "__from", "left").select("__to", "side", "pos", line.alias("line"))
    return found.groupBy("__to").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "line"))).alias("__links"))


# Columns that say where a requirement stands and what it links to; its texts are not among them.
SHORT_COLUMNS = (
    "Req_ID", "Doc_Name", "Doc_Type", "Object_Number", "Section_Number", "SRS_Section", "Section", "Section_Title",
    "SRS_Title", "SectionTitle", "Parent_Req_IDs", "Child_Req_IDs",
)


def _with_surroundings(
    reqs: DataFrame, order_by: Sequence[str], k_prev: int, k_next: int, hierarchical: bool, include_trace_text: bool
) -> DataFrame:
    """Add section title, place, file name, neighbours and trace snippets.

    Sections, places and names are worked out on the short columns alone. A text
    moves once to meet them and once to its section, whatever is added to its row.
    """
    order = list(order_by)
    kept = materialize(reqs.withColumns({"__at": F.monotonically_increasing_id(), "__member": section_member(reqs)}))
    wanted = {c.lower() for c in (*SHORT_COLUMNS, *order, "__at", "__member")}
    short = kept.select(*[named(c) for c in kept.columns if c.lower() in wanted])
    titled = with_section_title(short, order)
    titled = materialize(titled.withColumns({**anchor(titled), "__sort": row_sort_key(titled)}))
    members = titled.where("__member").select("__at", *ANCHOR, "__sort", *order)
    places = ordered.row_number(members, ["__sort", *order], "__rn", ANCHOR).select("__at", "__rn")
    # Rows that share their order share their names, as a join by the order gives them.
    names = _placed(titled.drop("__sort"), order, hierarchical, "md").groupBy("__at").agg(
        F.collect_list(F.struct("doc_slug", "folder", "file_name", "__row")).alias("__names")
    )
    about = titled.select("__at", *ANCHOR, "resolved_number", "resolved_title").join(places, "__at", "left").join(names, "__at", "left")
    about = about.withColumn("__rn", F.coalesce("__rn", F.lit(-1) - F.col("__at")))
    rows = kept.join(about, "__at")
    sides = ("parent_snippets", "child_snippets")
    if include_trace_text:
        lists = _trace_lists(kept, short, order)
        rows = rows.join(lists, F.col("__at") == F.col("__to"), "left").drop("__to")
    around = ordered.around_numbered(rows, ANCHOR, neighbour_value(), k_prev, k_next)
    if include_trace_text:
        none = F.array().cast("array<string>")
        parents = F.transform(F.filter("__links", lambda x: x["side"] == 0), lambda x: x["line"])
        children = F.transform(F.filter("__links", lambda x: x["side"] == 1), lambda x: x["line"])
        shown = dict(zip(sides, (F.coalesce(parents, none), F.coalesce(children, none)), strict=True))
    else:
        shown = dict(zip(sides, (I.split_ids("Parent_Req_IDs"), I.split_ids("Child_Req_IDs")), strict=True))
    return around.withColumns(shown).select("*", F.inline("__names")).drop("__names", "__links", "__at", "__member", "__rn")


def neighbour_markdown(
    reqs: DataFrame,
    order_by: Sequence[str],
    k_prev: int = 2,
    k_next: int = 2,
    hierarchical: bool = False,
    include_trace_text: bool = False,
    include_text: bool = False,
) -> DataFrame:
    """Each requirement with the ones around it in its section and what it traces to."""
    df = _with_surroundings(reqs, order_by, k_prev, k_next, hierarchical, include_trace_text)
    get = lambda *names: cell(df, *names)
    req_id = F.coalesce(filled("Req_ID"), F.concat(L("row_"), F.col("__row").cast("string")))
    doc = F.coalesce(filled("Doc_Name"), L("UNKNOWN"))
    doc_type, number, base = get("Doc_Type"), get("Object_Number"), F.col("anchor_base")
    section = first_filled(number, F.col("resolved_number"))
    body, context, version = get("Requirement_Text"), get("Combined_Text"), get("Schema_Version")
    parents, children = (F.array_join(I.split_ids(c), ", ") for c in ("Parent_Req_IDs", "Child_Req_IDs"))
    anchor_id = F.when(base != "", slugify(F.concat_ws("__", doc, filled(doc_type), base))).otherwise("")
    sort_key = F.concat(doc_type, L("|"), base, L("|"), first_filled(number, req_id))

    def listed(name: str) -> tuple[Column, Column]:
        ids = F.array_join(F.transform(name, lambda x: x["id"]), ", ")
        bullets = F.array_join(F.transform(name, lambda x: F.concat(L("- "), x["id"], L(": "), x["text"])), "\n")
        return ids, bullets

    (prev_ids, prev_lines), (next_ids, next_lines) = listed("prev"), listed("next")
    fields = {
        "Req_ID": req_id,
        "Doc_Name": doc,
        "Doc_Type": doc_type,
        "Requirement_Type": get("Requirement_Type"),
        "Level": get("Level"),
        "Parents": parents,
        "Children": children,
        "Aliases": get("Aliases"),
        "SRS_Local_Req_No": get("SRS_Local_Req_No"),
        "Section": section,
        "Section_Title": F.col("resolved_title"),
        "Section_Type": get("Section_Type"),
        "Section_Anchor_ID": anchor_id,
        "Sort_Key": sort_key,
        "Neighbors_Prev": prev_ids,
        "Neighbors_Next": next_ids,
    }
    summary = F.concat_ws(
        "  \n",
        *[
            optional(f"**{label}:** ", fields[name])
            for label, name in (
                ("Doc Name", "Doc_Name"),
                ("Doc Type", "Doc_Type"),
                ("Level", "Level"),
                ("Section", "Section"),
                ("Section Title", "Section_Title"),
                ("Section Anchor ID", "Section_Anchor_ID"),
                ("Section Type", "Section_Type"),
                ("Requirement Type", "Requirement_Type"),
                ("Parents", "Parents"),
                ("Children", "Children"),
                ("Aliases", "Aliases"),
            )
        ],
        optional("**Schema Version:** ", version),
    )
    alone = (prev_ids == "") & (next_ids == "")

    def snippets(name: str) -> Column:
        bullets = F.array_join(F.transform(name, lambda s: F.concat(L("- "), s)), "\n")
        return F.coalesce(F.nullif(bullets, L("")), L("- None"))

    content = lines(
        L("---"),
        *[quoted(n, v) for n, v in fields.items()],
        F.when(version != "", quoted("Schema_Version", version)),
        F.when((body != "") & L(include_text), quoted("Requirement_Text", body)),
        L("---"),
        F.concat(L("# "), req_id),
        L(""),
        block(summary != "", summary, L("")),
        block(body != "", L("## Requirement Text\n"), body, L("")),
        L("## Local Neighbors (same section)\n"),
        F.when(alone, L("_No neighboring requirements found in this section._\n")),
        block(prev_ids != "", L("**Previous:**"), prev_lines, L("")),
        block(next_ids != "", L("**Next:**"), next_lines, L("")),
        L("## Trace Snippets\n\n**Parents:**"),
        snippets("parent_snippets"),
        L("\n**Children:**"),
        snippets("child_snippets"),
        L(""),
        block(context != "", L("---\n\n## Combined Context\n"), context, L("")),
    )
    return df.select(*order_by, "doc_slug", "folder", "file_name", content.alias("content"))


# --- one document per section ------------------------------------------------------------

# Header texts the fields come under.
INTRO_FIELDS = (
    "Section_Intro",
    "Section Intro",
    "Section_Narrative",
    "Section Narrative",
    "Section_Description",
    "Section Description",
)


def _joined_parts(rows: DataFrame, group: Sequence[str], order: Sequence[str], part_lines: int) -> DataFrame:
    """Lines of each group in order, as numbered parts of text."""
    parts = ordered.parts_of_group(rows, group, order, part_lines)
    gathered = parts.groupBy(*group, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), "line"))).alias("l")
    )
    return gathered.withColumn("content", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).drop("l")


def section_documents(
    reqs: DataFrame,
    order_by: Sequence[str],
    include_headers: bool = True,
    include_requirements: bool = True,
    include_intro: bool = True,
    max_levels: int = 6,
    part_lines: int = PART_LINES,
) -> DataFrame:
    """One document per section: details, intro, header and requirement bullets.

    Every line is a row until the parts are joined, so a section holding a
    third of all rows is spread like the others.
    """
    titled = with_section_title(reqs, order_by)
    key = ["anchor_doc", "anchor_type", "anchor_base"]
    rows = titled.withColumns({**anchor(titled), "__header": _flag(titled, "Is_Section_Header")})
    rows = rows.where(F.col("anchor_base") != "").withColumn("__at", F.struct(*order_by))
    used = ("Level", "Combined_Text", "Requirement_Text", "Object_Number", "Req_ID", "resolved_title", *INTRO_FIELDS)
    rows = materialize(rows.select(*key, "__header", "__at", *[F.col(f"`{c}`") for c in used if c in rows.columns]))
    level = cell(rows, "Level")
    heads = rows.groupBy(*key).agg(
        F.min("__at").alias("__first"),
        F.min_by("resolved_title", F.when(F.col("resolved_title") != "", F.col("__at"))).alias("title"),
        F.min(F.nullif(level, L(""))).alias("low"),
        F.max(F.nullif(level, L(""))).alias("high"),
        F.count_if(~F.col("__header")).alias("n"),
    )
    version = L("")
    if "Schema_Version" in reqs.columns:
        stated = clean_str("Schema_Version")
        found = reqs.where(stated != "").agg(F.min_by(stated, F.struct(*order_by))).first()[0]
        version = L(found or "")
    title = F.coalesce("title", L(""))
    shown_level = F.when(F.col("low").isNull(), "").when(F.col("low") == F.col("high"), F.col("low")).otherwise("Mixed")
    anchor_id = slugify(F.concat_ws("__", *[F.nullif(F.col(k), L("")) for k in key]))
    stem = F.concat_ws(
        "__",
        slugify("anchor_doc"),
        slugify(F.substring_index("anchor_base", ".", max_levels)),
        slugify(title),
    )
    heads = heads.withColumns(
        {"title": title, "level": shown_level, "anchor_id": anchor_id, "doc_slug": slugify("anchor_doc"), "version": version}
    )
    heads = materialize(unique_names(materialize(heads), ["doc_slug"], stem, ["__first"], "__name", MAX_STEM))
    count = F.col("n").cast("string")
    doc, kind, base, version = F.col("anchor_doc"), F.col("anchor_type"), F.col("anchor_base"), F.col("version")
    head_text = lines(
        L("---"),
        quoted("Doc_Name", doc),
        quoted("Doc_Type", kind),
        F.when(F.col("level") != "", quoted("Level", F.col("level"))),
        quoted("Section_Number", base),
        quoted("Section_Title", F.col("title")),
        quoted("Section_Anchor_ID", F.col("anchor_id")),
        quoted("Requirement_Count", count),
        F.when(version != "", quoted("Schema_Version", version)),
        L('Source: "section_export_v1"\n---'),
        F.rtrim(F.concat(L("# "), doc, L(" Section "), base, L("  "), F.col("title"))),
        L("\n## Section Details\n"),
        F.concat(L("- Doc Type: "), F.coalesce(F.nullif(kind, L("")), L("Unknown"))),
        optional("- Level: ", F.col("level")),
        F.concat(L("- Section Number: "), base),
        optional("- Section Title: ", F.col("title")),
        F.concat(L("- Section Anchor ID: "), F.col("anchor_id")),
        F.concat(L("- Requirement Count: "), count),
        optional("- Schema Version: ", version),
        L("- Source: section_export_v1\n"),
    )

    sort_type = rows.select(row_sort_key(rows).alias("s")).schema["s"].dataType
    at_type = rows.schema["__at"].dataType

    def line_rows(df: DataFrame, stage: int, line: Column, sort: Column | None = None, at: Column | None = None, sub: int = 0):
        return df.select(
            *key,
            L(stage).alias("stage"),
            (sort if sort is not None else L(None).cast(sort_type)).alias("sort"),
            (at if at is not None else L(None).cast(at_type)).alias("at"),
            L(sub).alias("sub"),
            line.alias("line"),
        )

    bullets = lambda c: F.concat(L("- "), c)
    out = [line_rows(heads, 0, head_text), line_rows(heads, 5, L("## Requirements in this Section\n")), line_rows(heads, 8, L(""))]
    if include_intro:
        context = cell(rows, "Combined_Text")
        snippets = rows.select(
            *key,
            "__at",
            F.posexplode(F.array(cell(rows, *INTRO_FIELDS), context)).alias("sub", "snippet"),
        ).where("snippet <> ''")
        firsts = snippets.groupBy(*key, "snippet").agg(F.min(F.struct("__at", "sub")).alias("place"))
        intro = firsts.select(
            *key,
            L(1).alias("stage"),
            L(None).cast(sort_type).alias("sort"),
            F.col("place.__at").alias("at"),
            F.col("place.sub").alias("sub"),
            bullets(single_line("snippet")).alias("line"),
        )
        sections = firsts.select(*key).distinct()
        out += [intro, line_rows(sections, 1, L("## Section Intro\n"), sub=-1), line_rows(sections, 2, L(""))]
    if include_headers:
        header = rows.where("__header")
        number = F.coalesce(F.nullif(cell(rows, "Object_Number"), L("")), base)
        name = first_filled(cell(rows, "Requirement_Text"), F.col("resolved_title"))
        context = cell(rows, "Combined_Text")
        line = lines(
            F.concat(L("- "), number, L(": "), single_line(name)),
            F.when((context != "") & (context != name), F.concat(L("  - Context: "), single_line(context))),
        )
        sections = header.select(*key).distinct()
        out += [
            line_rows(header, 3, line, row_sort_key(rows), F.col("__at")),
            line_rows(sections, 3, L("## Section Headers\n"), sub=-1),
            line_rows(sections, 4, L("")),
        ]
    empty = L("_No requirements captured for this section._")
    if include_requirements:
        members = rows.where("not __header")
        line = F.concat(L("- "), cell(rows, "Req_ID"), L(": "), single_line("Requirement_Text"))
        out += [line_rows(members, 6, line, row_sort_key(rows), F.col("__at")), line_rows(heads.where("n = 0"), 6, empty)]
    else:
        out.append(line_rows(heads, 6, empty))
    documents = _joined_parts(materialize(ordered.union_all(out)), key, ["stage", "sort", "at", "sub"], part_lines)
    return documents.join(heads.select(*key, "doc_slug", "__name"), key).select(
        "doc_slug",
        F.col("doc_slug").alias("folder"),
        F.concat("__name", L(".md")).alias("file_name"),
        "part",
        "content",
    )


# --- blocks for retrieval -----------------------------------------------------------------

# Header texts the links come under.
IN_LINK_FIELDS = (
    "In-links (Control System Requirements)",
    "In-links_(Control_System_Requirements)",
    "In_links_(Control_System_Requirements)",
)
OUT_LINK_FIELDS = ("Out-links (All modules)", "Out-links_(All_modules)", "Out_links_(All_modules)")


def rag_blocks(
    reqs: DataFrame,
    order_by: Sequence[str],
    in_links: Sequence[str] = IN_LINK_FIELDS,
    out_links: Sequence[str] = OUT_LINK_FIELDS,
    max_links: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Each requirement as one block with its statement, context and linked texts."""
    titled = with_section_title(reqs, order_by)
    df = link_context(titled, order_by, cell(titled, *in_links), cell(titled, *out_links), max_links, limit)
    na = lambda *names: value_or_na(cell(df, *names))
    req_id, doc = na("Req_ID", "Requirement ID"), na("Doc_Name", "Document")
    kind, safety = na("Requirement_Type", "Requirement Type"), na("Safety")
    number = value_or_na(first_filled(cell(df, "Object_Number", "Object Number"), F.col("resolved_number")))
    section_title = value_or_na("resolved_title")
    body = cell(df, "Requirement_Text", "Requirement Text")
    rationale = cell(df, "Rationale")
    derived = bool_from_value(cell(df, "Derived Requirement", "Derived_Requirement", "Is_Derived"))
    title = na("OLE Title", "OLE_Title")
    padding = F.concat_ws(
        "; ",
        *[
            F.when(v != "N/A", F.concat(L(f"{n}: "), v))
            for n, v in (
                ("Doc_Name", doc),
                ("Section_Title", section_title),
                ("Object_Number", number),
                ("Type", kind),
                ("Safety", safety),
                ("Title", title),
            )
        ],
    )
    short = F.char_length(body) < SHORT_TEXT
    statement = lines(
        F.nullif(body, L("")),
        F.when(short & (padding != ""), F.concat(L("Additional context: "), padding)),
        F.when((body == "") & (padding == ""), L("N/A")),
        F.nullif(F.array_join("referenced_lines", "\n"), L("")),
    )
    listed = lambda c: value_or_na(F.array_join(c, ", "))
    content = lines(
        F.concat(L("## "), req_id, F.when(section_title != "N/A", F.concat(L(": "), section_title)).otherwise("")),
        F.concat(L("Req_ID: "), req_id),
        F.concat(L("Type: "), kind),
        F.concat(L("Safety: "), safety),
        F.concat(L("Object_Number: "), number),
        F.concat(L("Has_Rationale: "), (rationale != "").cast("string")),
        F.concat(L("Is_Derived: "), derived.cast("string")),
        L("\n### Requirement Statement"),
        statement,
        L("\n### Engineering Context"),
        F.concat(L("Document: "), doc),
        F.concat(L("Section_Title: "), section_title),
        F.concat(L("Design_Note: "), na("Design Implementation Note", "Design_Implementation_Note")),
        F.concat(L("Rationale: "), value_or_na(rationale)),
        F.concat(L("OLE_Title: "), title),
        L("\n### Traceability"),
        F.concat(L("In-links: "), listed("in_ids")),
        F.concat(L("Out-links: "), listed("out_ids")),
        L("\n#### Linked Requirement Context (Injected)"),
        F.coalesce(F.nullif(F.array_join("linked_lines", "\n"), L("")), L("- N/A")),
    )
    return df.select(
        *order_by, F.col("Req_ID"), F.col("Doc_Name"), cell(df, "Object_Number", "Object Number").alias("Object_Number"),
        clean_str(content).alias("block"),
    )


def merged_sections(blocks: DataFrame, order_by: Sequence[str], max_per: int = 250) -> DataFrame:
    """Blocks of a document merged per section bucket, at most ``max_per`` in each.

    Numbers are read first, for the buckets, and blocks after them: keep blocks that
    are costly to compute. A block moves to its order, where it finds its bucket
    (not at all where it comes from there, as from ``rag_blocks``), and once to its
    section, in the order of the result.
    """
    bucketed = bucket_blocks(blocks, order_by, ["Doc_Name"], max_per)
    named_buckets = bucketed.select(
        slugify("Doc_Name").alias("doc_slug"), I.natural_key("bucket").alias("__natural"), "Doc_Name", "bucket", *order_by, "block"
    )
    place = ["doc_slug", "__natural"]
    gathered = named_buckets.repartitionByRange(*place).groupBy(*place, "Doc_Name", "bucket").agg(
        F.count("*").alias("blocks"),
        F.array_sort(F.collect_list(F.struct(F.struct(*order_by).alias("o"), "block"))).alias("b"),
    )
    body = clean_str(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n"))
    return gathered.orderBy(*place).select(
        "doc_slug",
        "bucket",
        "blocks",
        F.concat("doc_slug", L("__"), slugify("bucket"), L(".md")).alias("file_name"),
        F.when(body != "", F.concat(body, L("\n"))).otherwise("").alias("content"),
    )


def block_size_stats(blocks: DataFrame, group: Sequence[str] = ("Doc_Name",), block_col: str = "block") -> DataFrame:
    """Sizes of blocks in words: average, extremes and interpolated percentiles.

    Equal sizes are counted first; exact percentiles then work on the counts,
    so a group's buffer holds its distinct sizes, not its rows.
    """
    sizes = blocks.groupBy(*group, word_count(block_col).alias("w")).agg(F.count("*").alias("n"))
    percentiles = {f"p{p}": F.percentile("w", L(p / 100), F.col("n")).alias(f"p{p}") for p in (50, 90, 95)}
    return sizes.groupBy(*group).agg(
        F.sum("n").alias("blocks"),
        (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("avg_words"),
        F.min("w").alias("min_words"),
        *percentiles.values(),
        F.max("w").alias("max_words"),
    )


def largest_buckets(bucketed: DataFrame, group: Sequence[str] = ("Doc_Name",), n: int = 5) -> DataFrame:
    """The ``n`` buckets with most blocks per document; ties by bucket."""
    counted = bucketed.groupBy(*group, "bucket").agg(F.count("*").alias("blocks"))
    placed = ordered.row_number(counted.withColumn("__falling", -F.col("blocks")), ["__falling", "bucket"], "rank", list(group))
    return placed.where(F.col("rank") <= n).drop("__falling")


# --- printable export --------------------------------------------------------------------------


def printable_export(
    reqs: DataFrame,
    order_by: Sequence[str],
    heading: str,
    body_col: str | None = None,
    text_heading: str = "Requirement Text",
    part_lines: int = PART_LINES,
) -> DataFrame:
    """Requirements in section order under one heading per group, in numbered parts.

    Groups stand in the order their first requirement has; the parts joined by
    a line break are the document.
    """
    section = text("Section") if "Section" in reqs.columns else L(None).cast("string")
    shown = F.coalesce(section, F.col("Object_Number"), F.col("Section_Title"), L(""))
    lead = F.regexp_extract(clean_str(shown), r"^(\d+(?:\.\d+)*)", 1)
    key = section_order(F.when(lead != "", lead).otherwise(clean_str(shown)))
    group = F.coalesce(
        *[F.nullif(c, L("")) for c in (F.col("Section_Title"), section, F.col("Object_Number"))], L("Ungrouped")
    )
    number = F.coalesce(F.nullif(section, L("")), F.nullif(F.col("Object_Number"), L("")), L(""))
    body = F.col(body_col) if body_col else L("")
    wording = F.coalesce(F.nullif(F.col("Requirement_Text"), L("")), F.nullif(heading_block(body, text_heading), L("")))
    extra = F.nullif(heading_block(body, heading), L(""))
    parents, children = text("Parent_Req_IDs"), text("Child_Req_IDs")
    traced = (parents != "") | (children != "")
    entry = lines(
        F.concat(L("### "), F.coalesce(F.nullif(text("Req_ID"), L("")), L("No ID"))),
        L(""),
        F.concat(L(f"#### {text_heading}\n"), wording, L("\n")),
        F.concat(L(f"#### {heading}\n"), extra, L("\n")),
        optional("**Parents:** ", parents),
        optional("**Children:** ", children),
        F.when(traced, L("")),
        L("---\n"),
    )
    rows = reqs.select(
        clean_str(group).alias("group_title"),
        clean_str(number).alias("__number"),
        F.struct(key.alias("k"), text("Req_ID").alias("id"), F.struct(*order_by).alias("t")).alias("__key"),
        entry.alias("line"),
    )
    firsts = rows.groupBy("group_title").agg(F.min_by(F.struct("__key", "__number"), "__key").alias("f"))
    heads = firsts.select(
        "group_title",
        F.col("f.__key").alias("__group"),
        L(0).alias("__kind"),
        F.col("f.__key").alias("__key"),
        F.concat(
            L("## "), F.when(F.col("f.__number") != "", F.concat("f.__number", L(" — "), "group_title")).otherwise(F.col("group_title")), L("\n")
        ).alias("line"),
    )
    members = rows.join(firsts.select("group_title", F.col("f.__key").alias("__group")), "group_title").select(
        "group_title", "__group", L(1).alias("__kind"), "__key", "line"
    )
    every = materialize(heads.unionByName(members))
    placed = ordered.row_number(every, ["__group", "__kind", "__key"], "position")
    top = reqs.agg(
        F.concat(L("# Requirements Export (Printable)\n\n- Total: **"), F.count("*").cast("string"), L("**\n")).alias("line")
    ).select(L(0).cast("long").alias("position"), "line")
    every = placed.select("position", "line").unionByName(top)
    part = (F.floor(F.col("position") / part_lines) + 1).cast("int")
    return every.groupBy(part.alias("part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n"
        ).alias("content")
    )


# --- where a rendered document belongs -----------------------------------------------------------

# Front matter fields that may hold the section, in order, and texts that mean none.
SECTION_FIELDS = ("Section_Number", "Section", "Object_Number", "SRS_Section")
NO_SECTION = ("none", "null", "")


def front_section(md: Column) -> Column:
    """Section number in a document's front matter; a dashed object number is no section."""
    front = F.regexp_extract(md, r"(?s)\A---\s*\n(.*?)\n---", 1)

    def value(name: str) -> Column:
        found = clean_str(F.regexp_extract(front, name + r""":\s*"?([^"\n]+)"?""", 1))
        usable = ~F.lower(found).isin(*NO_SECTION)
        if name == "Object_Number":
            usable = usable & ~F.contains(found, L("-"))
        return F.when(usable, found)

    return F.coalesce(*[value(n) for n in SECTION_FIELDS])


def hierarchical_path(docs: DataFrame, doc_folder: Column, md: Column) -> DataFrame:
    """Add ``section`` and the nested ``folder`` of each rendered document."""
    base = clean_str(F.split_part(F.coalesce("section", L("")), L("-"), L(1)))
    parts = F.split(base, r"\.")
    steps = F.transform(parts, lambda _, i: F.regexp_replace(F.array_join(F.slice(parts, 1, i + 1), "."), r'[<>:"|?*]', "_"))
    path = F.when(base == "", L("_unsectioned")).otherwise(F.array_join(steps, "/"))
    placed = docs.withColumn("section", front_section(md))
    return placed.withColumn("folder", F.concat_ws("/", doc_folder, path))


def path_totals(placed: DataFrame) -> DataFrame:
    return placed.agg(
        F.count("*").alias("total"),
        F.count("section").alias("organized"),
        F.count_if(F.col("section").isNull()).alias("unsectioned"),
    )
