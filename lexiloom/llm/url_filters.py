"""URL filters as of the time of fetching: dated list entries become validity intervals that captures are joined to.

An entry (list, kind, pattern, action, dated) adds a pattern to a list or removes it. A pattern is a domain, which covers its
subdomains, with an optional path, which covers what lies below it. The changes of one (list, kind, pattern), in order of
time, give the intervals [valid_from, valid_to) in which it was listed.

A capture has a key for each parent domain of its host with each leading part of its path, so the join is an equality
with an interval check: no theta join, and as many matches as entries that really cover it. Among the entries active at
fetch time the most specific wins. Keys go no deeper than the deepest entry does, so a long path has few; intervals are
broadcast if their measured size allows it, and joined by a shuffle of keys beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import lookup_join, materialize, scratch, small
from .common import need

_URL = r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """The host in lower case without port and closing dot; '' if there is none."""
    return F.regexp_extract(F.lower(url), _URL + r"([^/:?#\s]+?)\.*(?:[:/?#\s]|$)", 1)


def path_of(url: Column) -> Column:
    """The path without query, fragment and closing slashes; case counts in it."""
    return F.regexp_extract(url, "(?i)" + _URL + r"[^/?#]*(/[^?#\s]*?)/*(?:[?#\s]|$)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, domain, path, valid_from, valid_to) of entries; valid_to is null while the last change is an addition.

    Of changes at one time a removal wins. Rows with a null or an action other than add and remove, a kind other than
    block and allow, or an empty domain don't count; repeated rows count once. Adding what is listed changes nothing.
    """
    p = F.lower(F.trim("pattern"))
    clean = F.regexp_replace(F.trim("pattern"), r"(?i)^([a-z][a-z0-9+.-]*:)?//", "")
    rows = need(entries, ("list", "kind", "pattern", "action", "dated")).where("action in ('add', 'remove') and kind in ('block', 'allow') and list is not null and dated is not null")
    rows = rows.where(p.isNotNull()).withColumn("domain", F.regexp_extract(F.lower(clean), r"^(?:\*?\.)?([^/?#:]*?)\.*(?:[/?#:]|$)", 1)).withColumn("path", F.regexp_extract(clean, r"^[^/?#]*(/[^?#]*?)/*(?:[?#]|$)", 1))
    key = ("list", "kind", "domain", "path")
    changes = rows.where("domain <> ''").groupBy(*key, "dated").agg(F.max("action").alias("action"))
    order = Window.partitionBy(*key).orderBy("dated")
    turns = changes.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    turns = turns.withColumn("valid_to", F.lead("dated").over(order))
    return turns.where("action = 'add'").select(*key, F.col("dated").alias("valid_from"), "valid_to")


def _keys(host: Column, path: Column, labels_most: int, steps_most: int) -> Column:
    """Parent domains of up to labels_most labels, with leading parts of the path of up to steps_most steps (1: none)."""
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - labels_most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(steps_most))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    return F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.struct(d.alias("domain"), p.alias("path")))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each capture (page_id, url, fetched): page_id, url, fetched, blocked, list, pattern, since, active.

    The winning entry has the longest domain, then the longest path; on a tie allow wins over block, then the first list by name.
    blocked: it is of kind block. since: its valid_from. active: how many entries cover the capture at its time.
    Captures with a null or hostless url, a null time, or no active entry have blocked false, active 0 and nulls.
    Repeated captures have a row each; an entry that starts at the very fetch time is active, one that ends then isn't.
    """
    with scratch(captures.sparkSession):
        base = need(captures, ("page_id", "url", "fetched"))
        spans = materialize(intervals(entries), "url-intervals")
        deepest = spans.agg(F.max(F.size(F.split("domain", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/"))).alias("steps")).first()
        asked = base.where("url is not null and fetched is not null").select("url", "fetched").withColumn("host", host_of(F.col("url"))).where("host <> ''")
        keyed = asked.select("url", "fetched", F.explode(_keys(F.col("host"), path_of(F.col("url")), deepest["labels"] or 1, deepest["steps"] or 1)).alias("k")).select("url", "fetched", "k.domain", "k.path")
        found = keyed.join(small(spans), ["domain", "path"]).where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
        found = found.withColumn("rank", F.struct(-F.length("domain"), -F.length("path"), F.col("kind"), F.col("list")))
        won = F.min_by(F.struct("list", "kind", F.concat("domain", "path").alias("pattern"), F.col("valid_from").alias("since")), "rank").alias("won")
        verdict = found.groupBy("url", "fetched").agg(won, F.count_distinct("list", "kind", "domain", "path").alias("active"))
        verdict = materialize(verdict, "url-verdicts", keep=True)
    joined = lookup_join(base, verdict, ["url", "fetched"])
    return joined.select("page_id", "url", "fetched", F.coalesce(F.col("won.kind") == "block", F.lit(False)).alias("blocked"), "won.list", "won.pattern", "won.since", F.coalesce("active", F.lit(0)).cast("long").alias("active"))
