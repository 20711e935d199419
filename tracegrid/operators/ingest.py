"""Incremental ingest: what changed, what to do next, and what came of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import content_sha, text
from tracegrid.operators.chunks import DEFAULT_RULES, chunk_documents, file_ext, file_stem
from tracegrid.operators.storage import materialize

MANIFEST = (
    "source_path string, file_sha256 string, content_sha256 string, chunk_index int, chunk_id string, chunk_sha256 string"
)


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every path: new, changed, unchanged or deleted, by content hash."""
    old = manifest.select("source_path", F.col("content_sha256").alias("old_sha"), F.lit(True).alias("tracked"))
    new = current.select("source_path", F.col("content_sha256").alias("new_sha"), F.lit(True).alias("present"))
    status = (
        F.when(F.col("present").isNull(), "deleted")
        .when(F.col("tracked").isNull(), "new")
        .when(F.col("old_sha").eqNullSafe(F.col("new_sha")), "unchanged")
        .otherwise("changed")
    )
    return new.join(old, "source_path", "full_outer").select("source_path", status.alias("status"))


def metadata_only_update(chunks: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose metadata may be replaced in place, and the verdict per document.

    A document qualifies if it is tracked, its content is unchanged and every
    one of its chunks is found by hash; the id is that of the first such chunk.
    """
    tracked = manifest.groupBy("source_path").agg(F.max("content_sha256").alias("old_content"))
    stored = manifest.where(F.col("chunk_sha256").isNotNull()).groupBy("source_path", "chunk_sha256").agg(
        F.min_by("chunk_id", "chunk_index").alias("stored_id")
    )
    looked = materialize(chunks.join(stored, ["source_path", "chunk_sha256"], "left"))
    docs = looked.groupBy("source_path").agg(
        F.max("content_sha256").alias("content_sha256"), F.bool_and(F.col("stored_id").isNotNull()).alias("complete")
    )
    joined = docs.join(tracked.withColumn("known", F.lit(True)), "source_path", "left")
    reason = (
        F.when(F.col("known").isNull(), "not_tracked")
        .when(F.coalesce(F.col("old_content") != F.col("content_sha256"), F.lit(False)), "content_changed")
        .when(~F.col("complete"), "chunk_missing")
        .otherwise("ok")
    )
    verdicts = joined.select("source_path", reason.alias("verdict"))
    allowed = verdicts.where("verdict = 'ok'").select("source_path")
    updates = looked.join(allowed, "source_path", "left_semi")
    return updates.withColumn("id", F.col("stored_id")).drop("stored_id"), verdicts


# Input types a converter takes, and those a vision model may retry.
SUPPORTED_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".pptx", ".html", ".htm", ".md", ".csv", ".xlsx",
    ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp",
    ".vtt", ".wav", ".mp3", ".m4a", ".mp4", ".mov",
)
VISION_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def _place(path: str, root: str) -> tuple[Column, Column]:
    """Folder below the root, and file stem."""
    relative = F.regexp_replace(F.substr(F.col(path), F.lit(len(root.rstrip("/")) + 1)), r"\A/+", "")
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    relative = F.when(inside, relative).otherwise(F.regexp_extract(path, r"([^/]*)\z", 1))
    return F.regexp_extract(relative, r"(?s)\A(?:(.*)/)?[^/]*\z", 1), file_stem(relative)


def worklist(
    files: DataFrame,
    outputs: DataFrame,
    in_root: str,
    out_root: str,
    extensions: Sequence[str] = (),
    path: str = "path",
) -> DataFrame:
    """Supported inputs that have no output yet in the mirrored folder under the same stem."""
    asked = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    ext = file_ext(F.col(path))
    wanted = files.where(ext.isin(*SUPPORTED_EXTENSIONS))
    if asked:
        wanted = wanted.where(ext.isin(*asked))
    in_folder, in_stem = _place(path, in_root)
    out_folder, out_stem = _place(path, out_root)
    done = outputs.select(out_folder.alias("__folder"), out_stem.alias("__stem"))
    todo = wanted.withColumn("__folder", in_folder).withColumn("__stem", in_stem)
    return todo.join(done, ["__folder", "__stem"], "left_anti").drop("__folder", "__stem")


def quality_gate(
    df: DataFrame,
    text_col: str = "text",
    min_total: int = 800,
    min_alpha: int = 300,
    ext_col: str | None = None,
    retry_col: str | None = None,
) -> DataFrame:
    """Add ``route``: ``ok``, ``force_ocr``, or ``vlm`` where the retried text is still poor.

    A text is poor if it is short or has few letters. ``retry_col`` holds the
    text of the forced retry where there was one.
    """

    def poor(c: str) -> Column:
        letters = F.char_length(F.regexp_replace(text(c), r"[^\p{L}]+", ""))
        return (F.char_length(text(c)) < min_total) | (letters < min_alpha)

    route = F.when(poor(text_col), "force_ocr").otherwise("ok")
    if retry_col and ext_col:
        again = F.col(retry_col).isNotNull() & poor(retry_col) & F.lower(ext_col).isin(*VISION_EXTENSIONS)
        route = F.when(poor(text_col) & again, "vlm").otherwise(route)
    return df.withColumn("route", route)


# --- ingest -----------------------------------------------------------------------------------


def _chunked(docs: DataFrame, rules: Mapping, options: Mapping) -> DataFrame:
    return chunk_documents(docs, "source_path", "text", rules, keep_empty=True, **options)


def plan_ingest(
    docs: DataFrame, manifest: DataFrame, rules: Mapping = DEFAULT_RULES, options: Mapping | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunks of all documents to store, and (path, status) of every document.

    A document with the same file hash is not even chunked; one whose file
    changed but whose chunk texts did not is skipped as well.
    """
    tracked = manifest.groupBy("source_path").agg(
        F.max("file_sha256").alias("old_file"), F.max("content_sha256").alias("old_content")
    )
    # Only paths and hashes are joined. The paths to chunk are written down, so that
    # their true size decides how they pick their texts from the scan.
    hashed = docs.select("source_path", content_sha("text").alias("new_file"))
    same_file = F.coalesce(F.col("new_file") == F.col("old_file"), F.lit(False))
    seen = materialize(
        hashed.join(tracked.withColumn("known", F.lit(True)), "source_path", "left").select(
            "source_path", "known", "old_content", same_file.alias("same")
        )
    )
    read = materialize(seen.where("not same").select("source_path", "known", "old_content").distinct())
    texts = docs.select("source_path", "text").join(read.select("source_path"), "source_path", "left_semi")
    judged = _chunked(texts, rules, options or {}).join(read, "source_path")
    same_text = F.coalesce(F.col("content_sha256") == F.col("old_content"), F.lit(False))
    fresh = materialize(judged.where(~same_text).drop("old_content"))
    written = fresh.groupBy("source_path").agg(F.max("known").alias("k")).select(
        "source_path", F.when(F.col("k"), "changed").otherwise("new").alias("status")
    )
    status = seen.select("source_path").join(written, "source_path", "left").select(
        "source_path", F.coalesce("status", F.lit("unchanged")).alias("status")
    )
    return fresh.drop("known"), status


def manifest_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "source_path",
        F.col("doc_sha256").alias("file_sha256"),
        "content_sha256",
        "chunk_index",
        F.col("id").alias("chunk_id"),
        "chunk_sha256",
    )


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows without the mark of documents that have none."""
    return chunks.where(F.col("id").isNotNull())


def incremental_ingest(
    docs: DataFrame,
    manifest: DataFrame,
    store: DataFrame | None = None,
    rules: Mapping = DEFAULT_RULES,
    options: Mapping | None = None,
    prune: bool = False,
    reset: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New store, new manifest and (path, status).

    Stored chunks of a changed document are replaced by path, so a document
    that shrank leaves nothing behind. ``prune`` drops documents that are gone;
    ``reset`` starts from nothing.
    """
    if reset:
        manifest = manifest.where(F.lit(False))
        store = store.where(F.lit(False)) if store is not None else None
    fresh, status = plan_ingest(docs, manifest, rules, options)
    replaced = fresh.select("source_path").distinct()
    gone = manifest.select("source_path").distinct().join(docs.select("source_path"), "source_path", "left_anti")
    dropped = replaced.unionByName(gone) if prune else replaced
    new_manifest = manifest.join(dropped, "source_path", "left_anti").unionByName(manifest_rows(fresh))
    new_store = stored_chunks(fresh)
    if store is not None:
        new_store = store.join(dropped, "source_path", "left_anti").unionByName(new_store, allowMissingColumns=True)
    deleted = gone.withColumn("status", F.lit("deleted" if prune else "missing"))
    return new_store, new_manifest, status.unionByName(deleted)


def delete_chunks(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the chunks of these ids."""
    return store.join(ids.select("id"), "id", "left_anti")


# --- resumable stages ------------------------------------------------------------------------------


def resume_plan(packages: DataFrame, state: DataFrame, verify: bool = True, mode: str = "auto") -> DataFrame:
    """Which stages each package still needs; a changed package needs all of them."""
    old = state.select(
        "path",
        F.col("packaged_sha256").alias("old_sha"),
        "upload_status",
        "location",
        "embed_status",
        "verify_status",
        F.lit(True).alias("known"),
    )
    joined = packages.select("path", "packaged_sha256").join(old, "path", "left")
    changed = F.col("known").isNotNull() & ~F.col("old_sha").eqNullSafe(F.col("packaged_sha256"))

    def undone(c: str) -> Column:
        return changed | ~F.col(c).eqNullSafe(F.lit("ok"))

    upload = undone("upload_status") | (text("location") == "")
    check = undone("verify_status") if verify else F.lit(False)
    chosen = F.lit(mode)
    if mode == "auto":
        chosen = F.when(file_ext(F.col("path")).isin(".md", ".txt"), "raw-text").otherwise("upload")
    return joined.select(
        "path",
        upload.alias("needs_upload"),
        undone("embed_status").alias("needs_embed"),
        check.alias("needs_verify"),
        chosen.alias("mode"),
    ).withColumn("skip", ~(F.col("needs_upload") | F.col("needs_embed") | F.col("needs_verify")))


def verify_by_fingerprint(packages: DataFrame, hits: DataFrame) -> DataFrame:
    """``ok`` where a search hit carries the fingerprint or names the title, else ``unknown``."""
    low = F.lower(text("title"))
    named = (low != "") & (
        F.contains(F.lower(text("hit_title")), low) | F.contains(F.lower(text("hit_url")), low)
    )
    matched = F.contains(text("hit_text"), F.col("fingerprint")) | named
    judged = packages.select("path", "fingerprint", "title").join(hits, "path", "left").groupBy("path").agg(
        F.bool_or(F.coalesce(matched, F.lit(False))).alias("found")
    )
    return judged.select("path", F.when(F.col("found"), "ok").otherwise("unknown").alias("verify_status"))


def ingest_summary(status: DataFrame) -> DataFrame:
    """Outcome counts, and average and extremes of the positive durations."""
    taken = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))
    ok = F.col("outcome") == "succeeded"
    return status.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "skipped", "unknown")],
        F.count_if(ok & F.col("used_force_ocr")).alias("force_ocr"),
        F.count_if(ok & F.col("used_vlm")).alias("vlm"),
        F.coalesce(F.avg(taken), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.min(taken), F.lit(0.0)).alias("min_duration"),
        F.coalesce(F.max(taken), F.lit(0.0)).alias("max_duration"),
    )
