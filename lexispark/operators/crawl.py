"""The crawl's state machine as merges of whole tables: one round visits a batch of due pages.

Pages are not fetched here: a round takes a table of fetch results (url, status_code, body, content_type, etag,
last_modified, too_large, request_failed). Links found in a round are due from the next one. Every function takes `now`
(epoch seconds) and returns new tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import urls as U
from lexispark.storage import staged

DOCUMENTS = "url string, html string, source string, crawl_timestamp long, etag string, last_modified string, content_hash string, status_code long"
FRONTIER = "url string, status string, discovered_from string, fail_count long, last_crawled_at long, next_crawl_at long, created_at long, picked_at long"
FETCHED = "url string, status_code long, body string, content_type string, etag string, last_modified string, too_large boolean, request_failed boolean"
STATUSES = ("pending", "in_progress", "done", "failed")


@dataclass(frozen=True)
class Config:
    """All keys of a crawl configuration. The delay, the time limit and the agent's name are for whoever fetches."""

    allowed_domains: Sequence[str]
    seed_urls: Sequence[str] = ()
    recrawl_interval_seconds: int = 86400
    max_pages_per_run: int = 100
    max_html_bytes: int = 2_000_000
    crawl_delay_seconds: int = 1
    request_timeout_seconds: int = 15
    user_agent: str = ""
    db_path: str = ""
    seed_urls_file: str = ""


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _pending(urls: DataFrame, now: int) -> DataFrame:
    """Frontier rows for url, discovered_from."""
    none = F.lit(None).cast("long")
    return urls.select("url", F.lit("pending").alias("status"), "discovered_from", F.lit(0).cast("long").alias("fail_count"), none.alias("last_crawled_at"), F.lit(now).cast("long").alias("next_crawl_at"), F.lit(now).cast("long").alias("created_at"), none.alias("picked_at"))


def seed(frontier: DataFrame, urls: DataFrame, domains: Sequence[str], now: int) -> DataFrame:
    """Adds the allowed and useful of `urls` (url) that the frontier doesn't have."""
    # exploded, so that the optimizer doesn't repeat the normalization in each part of the filter
    u = urls.select(F.explode(F.array(U.normalize_url(F.col("url")))).alias("url"))
    u = u.where(U.is_allowed_domain(F.col("url"), domains) & U.is_useful_url(F.col("url"))).distinct()
    return frontier.unionByName(_pending(u.withColumn("discovered_from", F.lit(None).cast("string")), now).join(frontier.select("url"), "url", "left_anti"))


def reset_stale(frontier: DataFrame) -> DataFrame:
    """What a stopped run had picked is pending again."""
    return frontier.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def due(now: int) -> Column:
    return F.col("status").isin("pending", "done", "failed") & (F.col("next_crawl_at") <= now)


def pick(frontier: DataFrame, now: int, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frontier with the picked ones in progress, the k first due: next_crawl_at, created_at, url)."""
    chosen = frontier.where(due(now)).orderBy("next_crawl_at", "created_at", "url").limit(k)
    mark = F.broadcast(chosen.select("url", F.lit(True).alias("_picked")))
    out = frontier.join(mark, "url", "left").withColumns(
        {"status": F.when(F.col("_picked"), "in_progress").otherwise(F.col("status")), "picked_at": F.when(F.col("_picked"), F.lit(now).cast("long")).otherwise(F.col("picked_at"))}
    )
    return out.drop("_picked").select(*frontier.columns), chosen


def conditional(picked: DataFrame, documents: DataFrame) -> DataFrame:
    """What to ask for: url and the stored etag and last_modified, empty if there are none."""
    return picked.select("url").join(documents.select("url", "etag", "last_modified"), "url", "left").na.fill("", ["etag", "last_modified"])


def outcomes(fetched: DataFrame, documents: DataFrame, config: Config) -> DataFrame:
    """`fetched` with its hash and outcome: the first that holds."""
    stored = documents.select("url", F.col("content_hash").alias("stored_hash"))
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    too_large = F.coalesce(F.col("too_large"), F.lit(False)) | (F.octet_length("body") > config.max_html_bytes)
    out = fetched.join(stored, "url", "left").withColumn("content_hash", U.content_hash(F.coalesce("body", F.lit(""))))
    outcome = (
        F.when(F.coalesce("request_failed", F.lit(False)), "failed_request")
        .when(F.col("status_code") == 304, "not_modified")
        .when(~F.col("status_code").eqNullSafe(200), F.concat(F.lit("failed_http_"), F.coalesce(F.col("status_code"), F.lit(0)).cast("string")))
        .when(~kind.contains("text/html"), F.concat(F.lit("skipped_content_type_"), kind))
        .when(F.coalesce(too_large, F.lit(False)), "skipped_too_large")
        .when(F.col("stored_hash").eqNullSafe(F.col("content_hash")), "unchanged")
        .otherwise("changed")
    )
    return out.withColumn("outcome", outcome)


def succeeded(outcome: Column) -> Column:
    return outcome.isin("not_modified", "changed", "unchanged")


def upsert_documents(documents: DataFrame, judged: DataFrame, now: int) -> DataFrame:
    """Changed pages are written whole; unchanged ones refresh four columns; others leave what is stored."""
    new = judged.where(F.col("outcome").isin("changed", "unchanged"))
    new = new.select("url", F.col("outcome").alias("_o"), F.col("body").alias("_html"), U.host(F.col("url")).alias("_source"), F.coalesce("etag", F.lit("")).alias("_etag"), F.coalesce("last_modified", F.lit("")).alias("_modified"), F.col("content_hash").alias("_hash"), F.col("status_code").cast("long").alias("_code"))
    both = documents.join(new, "url", "full_outer")
    touched, changed = F.col("_o").isNotNull(), F.col("_o").eqNullSafe("changed")
    take = lambda when, value, old: F.when(when, value).otherwise(F.col(old)).alias(old)
    return both.select(
        "url",
        take(changed, F.col("_html"), "html"),
        take(changed, F.col("_source"), "source"),
        take(touched, F.lit(now).cast("long"), "crawl_timestamp"),
        take(touched, F.col("_etag"), "etag"),
        take(touched, F.col("_modified"), "last_modified"),
        take(changed, F.col("_hash"), "content_hash"),
        take(touched, F.col("_code"), "status_code"),
    )


def mark(frontier: DataFrame, judged: DataFrame, config: Config, now: int) -> DataFrame:
    """Visited pages are done, or failed with one more failure, and due again after the same interval."""
    seen = judged.select("url", succeeded(F.col("outcome")).alias("_ok"))
    out = frontier.join(seen, "url", "left")
    there = F.col("_ok").isNotNull()
    return out.select(
        "url",
        F.when(F.col("_ok"), "done").when(there, "failed").otherwise(F.col("status")).alias("status"),
        "discovered_from",
        (F.col("fail_count") + F.when(there & ~F.col("_ok"), 1).otherwise(0)).cast("long").alias("fail_count"),
        F.when(there, F.lit(now).cast("long")).otherwise(F.col("last_crawled_at")).alias("last_crawled_at"),
        F.when(there, F.lit(now + config.recrawl_interval_seconds).cast("long")).otherwise(F.col("next_crawl_at")).alias("next_crawl_at"),
        "created_at",
        "picked_at",
    )


def found_links(judged: DataFrame, config: Config) -> DataFrame:
    """url, discovered_from of the links on changed and unchanged pages; of several pages the first by address."""
    pages = judged.where(F.col("outcome").isin("changed", "unchanged"))
    links = pages.select(F.col("url").alias("page"), F.explode(U.extract_links(judged.sparkSession, F.col("url"), F.col("body"), config.allowed_domains)).alias("url"))
    return links.groupBy("url").agg(F.min("page").alias("discovered_from"))


def add_links(frontier: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """Adds those of `links` (url, discovered_from) that the frontier doesn't have."""
    return frontier.unionByName(_pending(links, now).join(frontier.select("url"), "url", "left_anti"))


def apply_fetch(documents: DataFrame, frontier: DataFrame, fetched: DataFrame, config: Config, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, frontier, outcomes) after a round."""
    judged = outcomes(fetched, documents, config)
    marked = add_links(mark(frontier, judged, config, now), found_links(judged, config), now)
    return upsert_documents(documents, judged, now), marked, judged.select("url", "outcome")


def crawl(documents: DataFrame, frontier: DataFrame, fetch: Callable[[DataFrame], DataFrame], config: Config, now: int, batch: int = 20, keep: Callable[[DataFrame, str], DataFrame] = staged) -> tuple[DataFrame, DataFrame]:
    """Rounds until config.max_pages_per_run are visited or nothing is due. `fetch` turns a batch (url, etag, last_modified) into
    fetch results; `keep` stores a table between rounds (in the shared folder, unless told otherwise), so that no round is run again and no
    page is fetched twice."""
    frontier, left = reset_stale(frontier), config.max_pages_per_run
    while left > 0:
        frontier, chosen = pick(frontier, now, min(batch, left))
        chosen = keep(chosen, "picked")
        n = chosen.count()
        if not n:
            break
        documents, frontier, _ = apply_fetch(documents, frontier, keep(fetch(conditional(chosen, documents)), "fetched"), config, now)
        documents, frontier, left = keep(documents, "documents"), keep(frontier, "frontier"), left - n
    return documents, frontier


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def newest_documents(documents: DataFrame, n: int = 10) -> DataFrame:
    return documents.orderBy(F.desc("crawl_timestamp"), "url").limit(n)


def next_due(frontier: DataFrame, n: int = 10) -> DataFrame:
    return frontier.orderBy("next_crawl_at", "url").limit(n)


def summary(documents: DataFrame, frontier: DataFrame) -> DataFrame:
    """name, n: the two tables' rows, and the frontier's by status."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count(documents, "documents").unionByName(count(frontier, "frontier")).unionByName(frontier.groupBy(F.concat(F.lit("frontier_"), "status").alias("name")).agg(F.count(F.lit(1)).alias("n")))
