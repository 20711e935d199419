"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A url that a rule fits gets the rule's verdict. The others get their host's:
personalised PageRank starts from the pages that rules allow and follows links;
distrust starts from the pages that rules block and follows links backwards (who
links to a bad host is suspect). A host is blocked when distrust makes up at least
``THRESHOLD`` of what reached it; a host that nothing reached is allowed.

Links are those of the pages (relative ones stay on their host) and those between
a host and the nearest domain above it that has pages too.

Scale: edges are counted per pair of hosts before the shuffle, so a host with a
third of all pages is one row here. Rounds work on hosts only, both spreads in
one join; every few rounds the state is written to the shared folder. Rules are a
short list and become one expression.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged as the host ''; null html has no links; repeated rows
are pages of their own; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import named
from tracegrid.operators.storage import materialize

# (verdict, host, path); a rule fits its host, the hosts below it, and paths that start with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ROUNDS = 15
DAMPING = 0.85
THRESHOLD = 0.8
WRITE_EVERY = 5
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to a slash, question mark, hash or the end."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; nulls where none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest_first]

    def first(values: list[str]) -> Column:
        pairs = list(zip(fits, values, strict=True))
        return reduce(lambda c, x: c.when(x[0], x[1]), pairs[1:], F.when(*pairs[0])) if pairs else F.lit(None).cast("string")

    return first([h + p for _, h, p in longest_first]), first([v for v, _, _ in longest_first])


def host_links(pages: DataFrame, hosts: DataFrame, html_col: str) -> DataFrame:
    """Links between different hosts that have pages: ``src``, ``dst``, ``n``."""
    target = F.col("link")
    absolute = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target).when(
        target.startswith("//"), F.concat(F.lit("http:"), target)
    )
    links = pages.select("host", F.explode(F.regexp_extract_all(named(html_col), F.lit(HREF), F.lit(1))).alias("link"))
    written = links.where(absolute.isNotNull()).select(F.col("host").alias("src"), host_of(absolute).alias("dst"))
    written = written.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    written = written.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    # Every domain above a host, the nearest first; those without pages fall out of the join.
    above = hosts.select(
        F.col("host").alias("src"),
        F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split("host", r"\.")))), _tail)).alias("far", "dst"),
    ).where("dst <> '' and dst <> src")
    known = above.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    up = known.groupBy("src").agg(F.min_by("dst", "far").alias("dst"), F.lit(1).cast("long").alias("n"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    every = written.unionByName(up.select("src", "dst", "n")).unionByName(down)
    return every.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _tail(i: Column) -> Column:
    """The host from its i-th label on."""
    labels = F.split("host", r"\.")
    return F.when(i <= F.size(labels), F.array_join(F.slice(labels, i, F.size(labels)), ".")).otherwise("")


def spread(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``kind``, ``host``, ``rank`` after some rounds: kind ``trust`` along the links, ``distrust`` against them."""
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = forward.unionByName(backward)
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    edges = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")))
    start = materialize(seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("rank")))
    ranks = start
    for i in range(1, rounds + 1):
        moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank")
        )
        ranks = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % WRITE_EVERY == 0 or i == rounds:
            ranks = materialize(ranks)
    return ranks


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
    carry: Sequence[str] = ("page_id",),
) -> DataFrame:
    """The ``carry`` columns of every page with ``host``, ``path``, ``rule``, ``verdict`` and ``distrust`` (its host's share)."""
    results = ("host", "path", "rule", "verdict", "distrust")
    kept = [c for c in carry if c not in results]
    parts = pages.select(
        *map(named, kept), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"), named(html_col).alias("__html")
    )
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = materialize(
        ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    )
    links = host_links(ruled, hosts.where("host <> ''"), "__html")
    masses = F.stack(F.lit(2), F.lit("trust"), F.col("good"), F.lit("distrust"), F.col("bad")).alias("kind", "mass")
    reached = spread(hosts.select("host", masses).where("mass > 0"), links)
    judged = reached.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("bad"), F.sum("rank").alias("all")
    )
    shares = materialize(judged.select(F.col("host").alias("__host"), (F.col("bad") / F.col("all")).alias("distrust")))
    found = ruled.join(shares, F.col("host") == F.col("__host"), "left")
    share = F.coalesce("distrust", F.lit(0.0))
    return found.select(
        *map(named, kept),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(share >= threshold, "block").otherwise("allow")).alias("verdict"),
        share.alias("distrust"),
    )
