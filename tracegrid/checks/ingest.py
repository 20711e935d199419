"""Incremental ingest, resumable stages, matching, and results written and read back."""

import uuid

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.chunks import sql_cut
from tracegrid.checks.diffs import DIFF_SQL, KEYS, MAPPING, orders_diff
from tracegrid.checks.hierarchy import TABLES_SQL, normalized
from tracegrid.checks.text import sql_strip
from tracegrid.fixtures import fixture
from tracegrid.operators import ingest as i
from tracegrid.operators.matching import fuzzy_best_match
from tracegrid.operators.storage import empty_frame, shared_folder
from tracegrid.plans.compare import compare_files, diff_and_report
from tracegrid.plans.retrieval import rag_ingest
from tracegrid.sources import flat, sinks
from tracegrid.streaming.ingest import current_chunks, stream_ingest


def folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/tracegrid/{uuid.uuid4().hex}/{name}"


STATUS = """
status as (
  select coalesce(c.source_path, m.source_path) as source_path,
         case when c.source_path is null then 'deleted' when m.source_path is null then 'new' when text = old_text then 'unchanged' else 'changed' end as status
  from docs_current c full join docs_manifest m on c.source_path = m.source_path)
"""


@check("manifest_diff", f"with {STATUS} select * from status")
def _(spark, sf):
    now = fixture(spark, sf, "docs_current").select("source_path", F.sha2("text", 256).alias("content_sha256"))
    old = fixture(spark, sf, "docs_manifest").select("source_path", F.sha2("old_text", 256).alias("content_sha256"))
    return i.manifest_diff(now, old)


def ingested(spark, sf):
    first = fixture(spark, sf, "docs_manifest").withColumnRenamed("old_text", "text")
    empty = empty_frame(spark, i.MANIFEST)
    store, manifest, _ = i.incremental_ingest(first, empty)
    return i.incremental_ingest(fixture(spark, sf, "docs_current"), manifest, store, prune=True)


@check("incremental_ingest", f"with {STATUS} select * from status")
def _(spark, sf):
    return ingested(spark, sf)[2]


# Chunks of the current documents: plain texts are one block each.
CURRENT = f"""
src as (select source_path, {sql_strip('text')} as t from docs_current),
{sql_cut('src', 'source_path')}"""


@check(
    "ingest_store",
    f"with recursive {CURRENT} select source_path, count(*) as chunks, max(e) as last_char from pieces group by 1",
)
def _(spark, sf):
    store = ingested(spark, sf)[0]
    return store.groupBy("source_path").agg(F.count("*").alias("chunks"), F.max("end_char").alias("last_char"))


@check(
    "ingest_store_texts",
    f"with recursive {CURRENT} select source_path, idx as chunk_index, chunk as text, sha256(chunk) as chunk_sha256 from pieces",
)
def _(spark, sf):
    """Every stored text, and that store and manifest hold the same chunks."""
    store, manifest, _ = ingested(spark, sf)
    held = manifest.select("source_path", "chunk_index", "chunk_sha256", F.col("chunk_id").alias("id"))
    return store.join(held, ["source_path", "chunk_index", "chunk_sha256", "id"]).select(
        "source_path", "chunk_index", "text", "chunk_sha256"
    )


@check(
    "delete_chunks",
    f"with recursive {CURRENT} select source_path, idx as chunk_index from pieces where idx % 2 = 0",
)
def _(spark, sf):
    store = ingested(spark, sf)[0]
    return i.delete_chunks(store, store.where("chunk_index % 2 = 1").select("id")).select("source_path", "chunk_index")


@check(
    "rag_ingest",
    """select c.source_path, case when m.source_path is null then 'not_tracked' when c.text <> m.old_text then 'content_changed' else 'ok' end as status
from docs_current c left join docs_manifest m on c.source_path = m.source_path""",
)
def _(spark, sf):
    """The metadata-only way: which documents may take new metadata without new texts."""
    first = fixture(spark, sf, "docs_manifest").withColumnRenamed("old_text", "text")
    store, manifest, _ = rag_ingest(first, empty_frame(spark, i.MANIFEST))
    return rag_ingest(fixture(spark, sf, "docs_current"), manifest, store, metadata_only=True)[2]


@check(
    "stream_ingest",
    f"""with recursive src as (select '/docs/' || doc_id as source_path, {sql_strip('text')} as t from documents),
{sql_cut('src', 'source_path')}
select source_path, idx as chunk_index, chunk as text, sha256(chunk) as chunk_sha256 from pieces""",
)
def _(spark, sf):
    base = folder(spark, "stream")
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    fixture(spark, sf, "documents").select("doc_id", "text").write.parquet(f"{base}/in")
    stream_ingest(
        spark, f"{base}/in", "doc_id bigint, text string", f"{base}/store", f"{base}/checkpoint", path=path
    )
    return current_chunks(spark, f"{base}/store").select(
        "source_path", "chunk_index", "text", "chunk_sha256"
    )


@check(
    "stream_ingest_compacted",
    f"""with recursive src as (select '/docs/' || doc_id as source_path, {sql_strip('text')} as t from documents),
{sql_cut('src', 'source_path')}
select source_path, idx as chunk_index, chunk as text, sha256(chunk) as chunk_sha256 from pieces""",
)
def _(spark, sf):
    """Older texts first, then all of them, in five batches of a file each with a compaction after every second."""
    base = folder(spark, "stream")
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    docs = fixture(spark, sf, "documents").select("doc_id", "text")
    older = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("an older text "), "text"))
    for rows, files in ((older, 1), (docs, 4)):
        rows.repartition(files, "doc_id").write.mode("append").parquet(f"{base}/in")
        stream_ingest(
            spark, f"{base}/in", "doc_id bigint, text string", f"{base}/store", f"{base}/checkpoint", path=path,
            max_files_per_trigger=1, compact_every=2,
        )
    return current_chunks(spark, f"{base}/store").select("source_path", "chunk_index", "text", "chunk_sha256")


def two_chunks(df, text, second):
    pieces = F.array(
        *[F.struct(F.lit(n).alias("chunk_index"), c.alias("chunk")) for n, c in enumerate((text, second))]
    )
    whole = F.sha2(F.concat(text, F.col("source_path")), 256)
    return df.select("source_path", whole.alias("content_sha256"), F.inline(pieces)).select(
        "source_path", "content_sha256", "chunk_index", F.sha2("chunk", 256).alias("chunk_sha256")
    )


VERDICT = """
verdicts as (
  select c.source_path, case when m.source_path is null then 'not_tracked' when c.text <> m.old_text then 'content_changed'
         when c.source_path like '%7' then 'chunk_missing' else 'ok' end as verdict
  from docs_current c left join docs_manifest m on c.source_path = m.source_path)
"""


def updated(spark, sf):
    now = fixture(spark, sf, "docs_current")
    old = fixture(spark, sf, "docs_manifest")
    lost = F.when(F.endswith("source_path", F.lit("7")), F.lit("other")).otherwise(F.col("source_path"))
    stored = two_chunks(old, F.col("old_text"), lost).withColumn(
        "chunk_id", F.concat("source_path", F.lit("#"), F.col("chunk_index").cast("string"))
    )
    return i.metadata_only_update(two_chunks(now, F.col("text"), F.col("source_path")), stored)


@check("metadata_only_verdicts", f"with {VERDICT} select * from verdicts")
def _(spark, sf):
    return updated(spark, sf)[1]


@check(
    "metadata_only_update",
    f"""with {VERDICT}
select source_path, n as chunk_index, source_path || '#' || n as id from verdicts, (select unnest([0, 1]) as n) where verdict = 'ok'""",
)
def _(spark, sf):
    return updated(spark, sf)[0].select("source_path", "chunk_index", "id")


@check(
    "worklist",
    """select doc_id, path from (select doc_id, '/in/' || lang || '/' || doc_id || case doc_id % 4 when 0 then '.PDF' when 1 then '.md' when 2 then '.exe' else '.docx' end as path from documents)
where doc_id % 4 in (0, 1) and not (doc_id % 3 = 0)""",
)
def _(spark, sf):
    docs = fixture(spark, sf, "documents")
    number = F.col("doc_id").cast("string")
    d = F.col("doc_id") % 4
    ext = F.when(d == 0, ".PDF").when(d == 1, ".md").when(d == 2, ".exe").otherwise(".docx")
    files = docs.select("doc_id", F.concat(F.lit("/in/"), "lang", F.lit("/"), number, ext).alias("path"))
    outputs = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("/out/"), "lang", F.lit("/"), number, F.lit(".md")).alias("path"))
    return i.worklist(files, outputs, "/in", "/out", ["pdf", ".md"])


POOR = "(length({0}) < 800 or length(regexp_replace({0}, '[^\\p{{L}}]+', '', 'g')) < 300)"


@check(
    "quality_gate",
    f"""select doc_id, case when {POOR.format('text')} then case when doc_id % 3 = 0 and ext = '.pdf' and {POOR.format('text')} then 'vlm' else 'force_ocr' end else 'ok' end as route from doc_text""",
)
def _(spark, sf):
    df = fixture(spark, sf, "doc_text").withColumn("retry", F.when(F.col("doc_id") % 3 == 0, F.col("text")))
    return i.quality_gate(df, "text", ext_col="ext", retry_col="retry").select("doc_id", "route")


@check(
    "resume_plan",
    """with s as (select doc_id, '/docs/' || doc_id || case when doc_id % 2 = 0 then '.md' else '.pdf' end as path, doc_id % 4 <> 0 as known, doc_id % 4 <> 0 and doc_id % 13 = 0 as changed from documents),
n as (select path, doc_id, not known or changed or doc_id % 5 = 0 or doc_id % 7 = 0 as needs_upload, not known or changed or doc_id % 6 = 0 as needs_embed,
             not known or changed or doc_id % 8 = 1 as needs_verify from s)
select path, needs_upload, needs_embed, needs_verify, case when doc_id % 2 = 0 then 'raw-text' else 'upload' end as mode,
       not (needs_upload or needs_embed or needs_verify) as skip from n""",
)
def _(spark, sf):
    d = F.col("doc_id")
    path = F.concat(F.lit("/docs/"), d.cast("string"), F.when(d % 2 == 0, ".md").otherwise(".pdf"))
    docs = fixture(spark, sf, "documents")
    packages = docs.select(path.alias("path"), F.sha2("text", 256).alias("packaged_sha256"))

    def unless(n, left=0):
        return F.when(d % n == left, "failed").otherwise("ok")

    state = docs.where("doc_id % 4 <> 0").select(
        path.alias("path"),
        F.when(d % 13 == 0, "old").otherwise(F.sha2("text", 256)).alias("packaged_sha256"),
        unless(5).alias("upload_status"),
        F.when(d % 7 != 0, "somewhere").alias("location"),
        unless(6).alias("embed_status"),
        unless(8, 1).alias("verify_status"),
    )
    return i.resume_plan(packages, state)


@check(
    "verify_by_fingerprint",
    """select '/docs/' || doc_id as path, case when doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0 then 'ok' else 'unknown' end as verify_status from documents""",
)
def _(spark, sf):
    d = F.col("doc_id")
    number = d.cast("string")
    path = F.concat(F.lit("/docs/"), number).alias("path")
    mark = F.concat(F.lit("FINGERPRINT::"), F.sha1("text"))
    docs = fixture(spark, sf, "documents")
    packages = docs.select(path, mark.alias("fingerprint"), F.concat(F.lit("Title <"), number, F.lit(">")).alias("title"))
    shout = F.concat(F.lit("the TITLE <"), number, F.lit(">"))
    hit = F.struct(
        F.when(d % 3 == 0, F.concat("text", mark)).otherwise(F.col("text")).alias("hit_text"),
        F.when(d % 5 == 0, shout).alias("hit_title"),
        F.when(d % 7 == 0, shout).alias("hit_url"),
    )
    other = F.struct(F.lit("nothing").alias("hit_text"), F.lit("x").alias("hit_title"), F.lit("y").alias("hit_url"))
    hits = docs.where("doc_id % 11 <> 1 or doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0").select(path, F.inline(F.array(other, hit)))
    return i.verify_by_fingerprint(packages, hits)


OUTCOME = "['succeeded', 'failed', 'skipped', 'unknown'][cast(event_id % 4 as int) + 1]"


@check(
    "ingest_summary",
    f"""with s as (select {OUTCOME} as outcome, event_id % 8 = 0 as o, event_id % 12 = 0 as v, case when event_id % 5 = 0 then 0 else round(value * 100) end as dur from events)
select count(*) as total, count(*) filter (where outcome = 'succeeded') as succeeded, count(*) filter (where outcome = 'failed') as failed,
       count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'unknown') as unknown,
       count(*) filter (where outcome = 'succeeded' and o) as force_ocr, count(*) filter (where outcome = 'succeeded' and v) as vlm,
       avg(dur) filter (where dur > 0) as avg_duration, min(dur) filter (where dur > 0) as min_duration, max(dur) filter (where dur > 0) as max_duration from s""",
)
def _(spark, sf):
    e = F.col("event_id")
    names = F.array(*[F.lit(n) for n in ("succeeded", "failed", "skipped", "unknown")])
    status = fixture(spark, sf, "events").select(
        F.get(names, (e % 4).cast("int")).alias("outcome"),
        (e % 8 == 0).alias("used_force_ocr"),
        (e % 12 == 0).alias("used_vlm"),
        F.when(e % 5 == 0, F.lit(0.0)).otherwise(F.round(F.col("value") * 100)).alias("duration_sec"),
    )
    return i.ingest_summary(status)


@check(
    "fuzzy_best_match",
    """with p as (
  select l.name, r.name as r, (1 - levenshtein(l.name, r.name) / greatest(length(l.name), length(r.name))) * 100 as score from names_left l, names_right r),
b as (select name, min(struct_pack(s := -round(score, 9), r := r)) as best from p where score > 60 group by 1)
select l.name, coalesce(best.r, '') as match, coalesce(-best.s, 0) as score from names_left l left join b on l.name = b.name""",
)
def _(spark, sf):
    found = fuzzy_best_match(fixture(spark, sf, "names_left"), fixture(spark, sf, "names_right"), "name")
    return found.withColumn("score", F.round("score", 9))


# --- written and read back ---------------------------------------------------------------


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@check(
    "read_flat",
    "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority as \"Order Priority\", o_orderstatus as col_3 from orders",
)
def _(spark, sf):
    path = folder(spark, "orders.csv")
    named = fixture(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    named = named.toDF("o_orderkey", "Order Priority PRIORITY", " ")
    sinks.export_csv(named, path)
    return flat.read_flat(spark, path)


@check("read_flat_line_breaks", "select cast(doc_id as varchar) as doc_id, text from documents")
def _(spark, sf):
    """What ``export_csv`` wrote, line breaks and quotes in cells included."""
    path = folder(spark, "documents.csv")
    sinks.export_csv(fixture(spark, sf, "documents"), path, ["doc_id", "text"])
    return flat.read_flat(spark, path)


def in_files(df, path, order, files=40):
    """CSV files that hold the rows in order, the first rows in the first file."""
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.csv(path, header=True, escape='"', emptyValue="")


@check(
    "read_flat_positions",
    """select row_number() over (order by doc_id) as n, cast(doc_id as varchar) as doc_id, nullif(text, '') as text from documents""",
)
def _(spark, sf):
    """Records numbered as they stand in many files, whose cells span lines."""
    path = folder(spark, "numbered.csv")
    in_files(fixture(spark, sf, "documents").select("doc_id", "text"), path, "doc_id")
    return flat.read_flat(spark, path, position="n")


@check(
    "export_csv",
    "select cast(doc_id as varchar) as doc_id, text from documents",
)
def _(spark, sf):
    path = folder(spark, "documents.csv")
    sinks.export_csv(fixture(spark, sf, "documents"), path, ["doc_id", "text"])
    return spark.read.csv(path, header=True, multiLine=True, escape='"', emptyValue="")


@check(
    "write_diff_csv",
    f"""with {DIFF_SQL}
select o_orderkey, coalesce(cast(o_custkey as varchar), '') as o_custkey, coalesce(o_orderstatus_right, '') as o_orderstatus_right, changed_columns, _merge from diffed""",
)
def _(spark, sf):
    path = folder(spark, "diff.csv")
    chosen = orders_diff(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus_right", "changed_columns", "_merge")
    sinks.write_diff_csv(chosen, path)
    back = spark.read.csv(path, header=True, escape='"')
    filled = {c: F.coalesce(c, F.lit("")) for c in back.columns if c != "o_orderkey"}
    return back.withColumns(filled).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@check("write_normalized", f"with {TABLES_SQL} select ws_id, out_id, ws_name from t_wordstring")
def _(spark, sf):
    path = folder(spark, "normalized")
    done = normalized(spark, sf)
    sinks.write_normalized({"wordstring": done.tables["wordstring"]}, done.flat, path)
    back = spark.read.parquet(f"{path}/wordstring")
    return back.select(
        F.col("Wordstring_LOID").alias("ws_id"), F.col("OutputPort_LOID").alias("out_id"), F.col("Wordstring_Name").alias("ws_name")
    )


@check(
    "write_grouped_json",
    f"""with {DIFF_SQL}
select coalesce(o_orderpriority, 'N/A') as group_1, coalesce(o_orderstatus, o_orderstatus_right, 'N/A') as group_2, _merge as status, changed_columns,
       o_orderkey, coalesce(o_custkey, o_custkey_right) as o_custkey from diffed""",
)
def _(spark, sf):
    path = folder(spark, "grouped")
    sinks.write_grouped_json(orders_diff(spark, sf), ["o_orderpriority", "o_orderstatus"], 2, ["o_orderkey", "o_custkey"], path)
    schema = "status string, changed_columns string, o_orderkey bigint, o_custkey bigint, group_1 string, group_2 string"
    return spark.read.schema(schema).json(path)


@check(
    "publish_catalog",
    f"""with {DIFF_SQL}
select 'old' as name, count(*) as rows from orders_left union all select 'new', count(*) from orders_right union all select 'diff', count(*) from diffed""",
)
def _(spark, sf):
    prefix = f"check_{uuid.uuid4().hex[:12]}_"
    sinks.publish_catalog(
        spark, fixture(spark, sf, "orders_left"), fixture(spark, sf, "orders_right"), orders_diff(spark, sf), prefix
    )
    counts = [
        spark.table(f"{prefix}dataset_{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        for n in ("old", "new", "diff")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check(
    "publish_catalog_rows",
    f"""with {DIFF_SQL}
select 'old' as name, o_orderkey as key, o_orderstatus as status from orders_left
union all select 'new', r_key, r_status from orders_right union all select 'diff', o_orderkey, _merge from diffed""",
)
def _(spark, sf):
    """All three tables as first published: a second publication fails while it writes the last one."""
    prefix = f"check_{uuid.uuid4().hex[:12]}_"
    left, right = fixture(spark, sf, "orders_left"), fixture(spark, sf, "orders_right")
    diff = orders_diff(spark, sf)
    sinks.publish_catalog(spark, left, right, diff, prefix)
    broken = diff.withColumn("_merge", F.when(F.col("o_orderkey") < 0, "x").otherwise(F.raise_error(F.lit("stopped"))))
    try:
        sinks.publish_catalog(spark, left.limit(1), right.limit(1), broken, prefix)
    except Exception as e:  # noqa: BLE001 - whatever the writer makes of it
        if "stopped" not in str(e):
            raise
    columns = {"old": ("o_orderkey", "o_orderstatus"), "new": ("r_key", "r_status"), "diff": ("o_orderkey", "_merge")}
    rows = [
        spark.table(f"{prefix}dataset_{n}").select(F.lit(n).alias("name"), F.col(k).alias("key"), F.col(s).alias("status"))
        for n, (k, s) in columns.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@check(
    "diff_and_report",
    f"""with {DIFF_SQL}
select 1 - grouping(o_orderpriority) as level, o_orderpriority as h1, count(*) as total, count(*) filter (where _merge = 'changed') as changed,
       count(*) filter (where _merge = 'left_only') as left_only, count(*) filter (where _merge = 'right_only') as right_only,
       count(*) filter (where _merge = 'equal') as equal
from (select * replace (coalesce(o_orderpriority, 'N/A') as o_orderpriority) from diffed) group by rollup(o_orderpriority)""",
)
def _(spark, sf):
    done = diff_and_report(
        _as_text(fixture(spark, sf, "orders_left")),
        _as_text(fixture(spark, sf, "orders_right")),
        MAPPING,
        KEYS,
        KEYS,
        hierarchy=["o_orderpriority"],
    )
    return done.tree()


FILLED = """
l as (select event_id, last_value(nullif(trim(event_type), '') ignore nulls) over (order by event_id rows unbounded preceding) as event_type,
        last_value(value ignore nulls) over (order by event_id rows unbounded preceding) as value from events_sparse),
r as (select event_id as id, last_value(nullif(trim(event_type), '') ignore nulls) over (order by event_id rows unbounded preceding) as kind,
        last_value(case when event_id % 10 = 3 then value + 1 else value end ignore nulls) over (order by event_id rows unbounded preceding) as val
      from events_sparse where event_id % 50 <> 8)"""


@check(
    "diff_and_report_filled",
    f"""with {FILLED}
select coalesce(event_id, id) as event_id, event_type, kind as event_type_right, value, val as value_right,
       case when id is null then 'left_only' when event_type is distinct from kind or value is distinct from val then 'changed' else 'equal' end as _merge
from l full join r on event_id = id""",
)
def _(spark, sf):
    """Two folders of files with gaps, filled in the order of their records, and compared."""
    left, right = folder(spark, "left.csv"), folder(spark, "right.csv")
    events = fixture(spark, sf, "events_sparse")
    in_files(events.select("event_id", "event_type", "value"), left, "event_id")
    changed = F.when(F.col("event_id") % 10 == 3, F.col("value") + 1).otherwise(F.col("value"))
    other = events.where("event_id % 50 <> 8").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), changed.alias("val"))
    in_files(other, right, "id")
    mapping = {"event_id": "id", "event_type": "kind", "value": "val"}
    done = compare_files(spark, left, right, mapping, ["event_id"], ["event_type", "value"])
    return done.rows.select(F.col("event_id").cast("long").alias("event_id"), "event_type", "event_type_right", "value", "value_right", "_merge")


@check(
    "diff_and_report_rows",
    """with l as (select o_orderkey, case when o_orderkey <= 200 then cast(o_custkey as varchar) else 'c' || o_custkey end as mixed, o_orderstatus from orders_left),
r as (select r_key, case when r_key <= 200 then cast(r_cust as varchar) else 'c' || r_cust end as r_mixed, r_status from orders_right)
select coalesce(o_orderkey, r_key) as o_orderkey, mixed, r_mixed as mixed_right, o_orderstatus, r_status as o_orderstatus_right,
       case when r_key is null then 'left_only' when o_orderkey is null then 'right_only'
            when mixed is distinct from r_mixed or o_orderstatus is distinct from r_status then 'changed' else 'equal' end as _merge
from l full join r on o_orderkey = r_key""",
)
def _(spark, sf):
    """Every row and cell, with a column that looks numeric in its first rows only."""

    def mixed(key, customer):
        return F.when(F.col(key) <= 200, F.col(customer).cast("string")).otherwise(F.concat(F.lit("c"), F.col(customer).cast("string")))

    left = fixture(spark, sf, "orders_left").select("o_orderkey", mixed("o_orderkey", "o_custkey").alias("mixed"), "o_orderstatus")
    right = fixture(spark, sf, "orders_right").select("r_key", mixed("r_key", "r_cust").alias("r_mixed"), "r_status")
    mapping = {"o_orderkey": "r_key", "mixed": "r_mixed", "o_orderstatus": "r_status"}
    done = diff_and_report(left, right, mapping, ["o_orderkey"], ["o_orderkey"])
    return done.rows.select("o_orderkey", "mixed", "mixed_right", "o_orderstatus", "o_orderstatus_right", "_merge")
