"""Packaging a document: metadata header, heading, body and fingerprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import content_sha, fingerprint, metadata_from_name, text
from tracegrid.operators.chunks import file_name, file_stem, front_body, front_entries, front_head


@dataclass(frozen=True)
class PackageRule:
    defaults: Mapping[str, str] = field(default_factory=dict)
    name_patterns: Sequence[str] = ()
    header_fields: Sequence[str] = ()
    header_format: str = "plain"
    read_front_matter: bool = True
    content_heading: str | None = "## Content"
    fingerprint_field: str = "fingerprint"
    fingerprint_by_req_id: bool = True
    fingerprint_in_body: bool = True
    prefix: str = ""
    suffix: str = ""
    companion: bool = False
    excerpt_chars: int | None = None  # of the companion; by default the whole text


def _entry(key, value) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(key).alias("key"), as_col(value).cast("string").alias("value"))


def _last_of_each(entries: Column) -> Column:
    """Keys in order of first appearance, each with its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))


def _json_text(value: Column) -> Column:
    """The value as a JSON string with its quotes."""
    array = F.to_json(F.array(value))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def header(entries: Column, style: str) -> Column:
    """Metadata entries as plain lines, JSON or XML."""
    if style == "json":
        items = F.transform(
            entries, lambda e: F.concat(F.lit("  "), _json_text(e["key"]), F.lit(": "), _json_text(e["value"]))
        )
        body = F.concat(F.lit("{\n"), F.array_join(items, ",\n"), F.lit("\n}"))
        return F.when(F.size(entries) == 0, F.lit("{}")).otherwise(body)
    if style == "xml":
        line = lambda e: F.concat(
            F.lit("  <"), e["key"], F.lit(">"), e["value"], F.lit("</"), e["key"], F.lit(">")
        )
    elif style in ("plain", "yaml"):
        line = lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    else:
        raise ValueError(f"unknown header format: {style}")
    opened, closed = F.array(F.lit("<document_metadata>")), F.array(F.lit("</document_metadata>"))
    return F.array_join(F.concat(opened, F.transform(entries, line), closed), "\n")


def package_documents(docs: DataFrame, path_col: str, text_col: str, rule: PackageRule = PackageRule()) -> DataFrame:
    """One packaged text per document with its metadata, fingerprint and hashes.

    Metadata comes from the defaults, then the file name, then the front
    matter, a later source overriding an earlier one.
    """
    # Each step reads columns of the step before several times, which keeps Spark from working a column out per use.
    read = docs.select(F.col(path_col).alias("path"), text(text_col).alias("__raw"))
    path, name = F.col("path"), file_name(F.col("path"))
    if rule.read_front_matter:
        read = read.withColumn("__head", front_head("__raw", loose=True))
        read = read.withColumns({"__body": front_body("__raw", "__head"), "__front": front_entries("__head", loose=True)})
    else:
        read = read.withColumns({"__body": F.col("__raw"), "__front": F.create_map().cast("map<string,string>")})
    named = [_entry(k, v) for k, v in metadata_from_name(name, rule.name_patterns).items()]
    found = F.filter(F.array(*named), lambda e: e["value"].isNotNull()) if named else None
    defaults = F.array(*[_entry(k, v) for k, v in rule.defaults.items()]) if rule.defaults else None
    own = F.transform(F.map_entries("__front"), lambda e: _entry(e["key"], e["value"]))
    entries = F.concat(*[e for e in (defaults, found, own) if e is not None], F.array(_entry("filename", name)))
    gathered = read.select("path", "__raw", "__body", entries.alias("__e"))
    has_source = F.exists("__e", lambda e: e["key"] == "source")
    sourced = F.when(has_source, F.col("__e")).otherwise(F.concat("__e", F.array(_entry("source", path))))
    merged = gathered.withColumn("__e", sourced).withColumn("__m", _last_of_each(F.col("__e"))).drop("__e")

    req_id = F.element_at(F.map_from_entries("__m"), "req_id") if rule.fingerprint_by_req_id else F.lit(None).cast("string")
    printed = merged.withColumn("fingerprint", fingerprint("path", "__raw", req_id))
    every = F.concat("__m", F.array(_entry(rule.fingerprint_field, F.col("fingerprint"))))
    marked = printed.withColumn("__every", every).withColumn("__all", _last_of_each(F.col("__every")))
    shown = F.col("__all")
    if rule.header_fields:
        shown = F.filter(shown, lambda e: e["key"].isin(*rule.header_fields))
    sections = [
        F.lit(rule.prefix) if rule.prefix else None,
        header(shown, rule.header_format),
        F.lit(rule.content_heading) if rule.content_heading else None,
        F.col("__body"),
        F.col("fingerprint") if rule.fingerprint_in_body else None,
        F.lit(rule.suffix) if rule.suffix else None,
    ]
    packaged = F.concat_ws("\n\n", *[s for s in sections if s is not None])
    done = marked.select(
        "path",
        packaged.alias("text"),
        F.map_from_entries("__all").alias("metadata"),
        "fingerprint",
        content_sha("__raw").alias("original_sha256"),
        F.lit("document").alias("kind"),
    ).withColumn("packaged_sha256", content_sha("text"))
    if not rule.companion:
        return done
    title = F.concat(F.coalesce(F.col("metadata")["title"], file_stem(path)), F.lit(" (summary)"))
    excerpt = F.concat(
        F.lit("Companion summary for "), name, F.lit("\n\nFingerprint: "), "fingerprint",
        F.lit("\n\nExcerpt:\n"), F.col("text") if rule.excerpt_chars is None else F.substring("text", 1, rule.excerpt_chars),
    )
    rest = F.map_filter("metadata", lambda k, _: k != "title")
    # Both rows of a document come out of one pass over its text.
    paired = done.withColumn("__excerpt", excerpt).withColumn("__sha", content_sha("__excerpt"))
    summary = {
        "path": path,
        "text": F.col("__excerpt"),
        "metadata": F.map_concat(rest, F.create_map(F.lit("title"), title)),
        "fingerprint": F.col("fingerprint"),
        "original_sha256": F.col("__sha"),
        "kind": F.lit("summary"),
        "packaged_sha256": F.col("__sha"),
    }
    both = F.array(F.struct(*map(F.col, done.columns)), F.struct(*[summary[c].alias(c) for c in done.columns]))
    return paired.select(F.inline(both))
