"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import load
from . import classifier, decontaminate, language_id, license_scan, line_dedup, near_dedup, packing, quality_rules, url_filters, warc


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
"""A public vocabulary of 50,256 byte sequences; only the driver reads it."""


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train_profiles(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(load(spark, sf_dir, "conversations"), TOKENIZER)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(load(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def list_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of captures: each is added, later removed, and some are added again; four sorts of entries."""
    host = url_filters.host_of(F.col("url"))
    hosts = captures.select(host.alias("host"), "page_id").where("host <> ''").groupBy("host").agg(F.min("page_id").alias("h"))
    sort = F.pmod("h", F.lit(4))
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)
    change = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("dated"))
    added = F.pmod(F.col("h") * 7, F.lit(200))
    changes = F.array(change("add", added), change("remove", added + 60), change("add", added + 60 + F.pmod("h", F.lit(90))))
    return hosts.select(
        F.when(sort == 3, "partners").otherwise("reported").alias("list"),
        F.when(sort == 3, "allow").otherwise("block").alias("kind"),
        F.when(sort == 1, F.regexp_replace("host", r"^[^.]*\.", "")).when(sort == 2, F.concat("host", F.lit("/en"))).otherwise(F.col("host")).alias("pattern"),
        F.explode(changes).alias("c"),
    ).select("list", "kind", "pattern", "c.*")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7_919, F.lit(366 * 24)) * 3_600).alias("fetched"))
    return url_filters.evaluate(pages, list_entries(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.assemble(warc.records_of_pages(load(spark, sf_dir, "pages")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents"))


_ALL = (op1_quality_classifier, op2_language_id, op3_packing, op4_minhash_dedup, op5_quality_rules, op6_url_filter, op7_decontamination, op8_license_scan, op9_warc_transactions, op10_line_dedup)
QUERIES = {f.__name__: f for f in _ALL}

_URL_SQL = r"""
with c as (
  select page_id, url, timestamp '2024-01-01' + to_hours((page_id * 7919) % 8784) as fetched,
    regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+?)\.*(?:[:/?#\s]|$)', 1) as host,
    regexp_extract(url, '(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#]*(/[^?#\s]*?)/*(?:[?#\s]|$)', 1) as path from pages),
h as (select host, min(page_id) as h from c where host <> '' group by host),
e as (
  select case when h % 4 = 3 then 'partners' else 'reported' end as list, case when h % 4 = 3 then 'allow' else 'block' end as kind,
    case when h % 4 = 1 then regexp_replace(host, '^[^.]*\.', '') else host end as domain, case when h % 4 = 2 then '/en' else '' end as path,
    unnest([{'action': 'add', 'dated': timestamp '2024-01-01' + to_days(((h * 7) % 200)::int)},
      {'action': 'remove', 'dated': timestamp '2024-01-01' + to_days(((h * 7) % 200 + 60)::int)},
      {'action': 'add', 'dated': timestamp '2024-01-01' + to_days(((h * 7) % 200 + 60 + h % 90)::int)}], recursive := true) from h),
g as (select list, kind, domain, path, dated, max(action) as action from e group by all),
b as (select *, lag(action) over (partition by list, kind, domain, path order by dated) as before from g),
v as (select *, lead(dated) over (partition by list, kind, domain, path order by dated) as valid_to from b where before is null or before <> action),
m as (select distinct c.url, c.fetched, v.list, v.kind, v.domain, v.path, v.dated as since from c join v on v.action = 'add'
  and (c.host = v.domain or ends_with(c.host, '.' || v.domain)) and (v.path = '' or c.path = v.path or starts_with(c.path, v.path || '/'))
  and v.dated <= c.fetched and (v.valid_to is null or c.fetched < v.valid_to)),
w as (select *, count(*) over (partition by url, fetched) as active from m qualify row_number() over (partition by url, fetched order by length(domain) desc, length(path) desc, kind, list) = 1)
select c.page_id, c.url, c.fetched, coalesce(w.kind = 'block', false) as blocked, w.list, w.domain || w.path as pattern, w.since, coalesce(w.active, 0) as active
from c left join w on w.url = c.url and w.fetched = c.fetched
"""

SQL: dict[str, str] = {"op2_language_id": language_id.SQL, "op5_quality_rules": quality_rules.SQL, "op6_url_filter": _URL_SQL}
