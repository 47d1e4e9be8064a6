"""Read models over the document catalog, queues and stage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.urls import document_id, normalize_url

STAGES = {"cleaning": "SCRAPE", "indexer": "CLEAN", "graph": "EXTRACT"}
MOST_RESULTS, DEFAULT_RESULTS, MOST_TOPIC = 10, 5, 200
MOST_PAGE, DEFAULT_PAGE = 100, 25


def status_counts(catalog: DataFrame, status: str = "status") -> DataFrame:
    return catalog.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("documents"))


def list_documents(catalog: DataFrame, cursor: int = 0, limit: int = DEFAULT_PAGE, search: str = "", status: str | None = None) -> DataFrame:
    """One page in id order with next_cursor, set only if the page is full."""
    limit, needle = min(max(limit, 1), MOST_PAGE), search.lower()
    rows = catalog if status is None else catalog.filter(F.col("status") == status.upper())
    if needle:
        rows = rows.filter(F.contains(F.lower("source_url"), F.lit(needle)) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(needle)))
    page = rows.orderBy("id").offset(cursor).limit(limit)
    full = F.count("*").over(Window.partitionBy()) == limit
    return page.withColumn("next_cursor", F.when(full, F.lit(cursor + limit)))


def queue_items(queued: DataFrame, catalog: DataFrame) -> DataFrame:
    """Queued rows (id, stage) with their catalog entry; an unknown one is NEW without a title."""
    known = catalog.select("id", F.col("status").alias("known"), F.col("title").alias("named"))
    return queued.join(known, "id", "left").select("id", "stage", F.coalesce("known", F.lit("NEW")).alias("status"), F.coalesce("named", F.lit("")).alias("title"))


def discover(results: DataFrame, limit: int | None = None, order: str = "position") -> DataFrame:
    """Results (order, title, url) with normalized url, id and state: skipped, duplicate or enqueued (within the first `limit`)."""
    rows = results.withColumn("normalized", normalize_url(F.col("url"))).withColumn("document_id", document_id(F.col("normalized")))
    valid = F.col("normalized").isNotNull() & (F.trim(F.coalesce("title", F.lit(""))) != "")
    # minima are summed up before the shuffle, so an address that fills the input is no hot group
    firsts = rows.filter(valid).groupBy("normalized").agg(F.min(order).alias("first"))
    # rows meet firsts by place and address, so neither a frequent address nor rows without one are a hot key
    marked = rows.withColumn("valid", valid).join(firsts.select(F.col("first").alias(order), "normalized", F.lit(True).alias("is_first")), [order, "normalized"], "left")
    state = F.when(~F.col("valid"), "skipped").when(F.col("is_first"), "enqueued").otherwise("duplicate")
    marked = marked.withColumn("state", state).select(*rows.columns, "state")
    if limit is None:
        return marked
    first = marked.filter("state = 'enqueued'").orderBy(order).limit(limit)
    return first.unionByName(marked.filter("state != 'enqueued'"))


def against_catalog(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Enqueued results that the catalog has are duplicates."""
    known = catalog.select(F.col("id").alias("document_id")).distinct().withColumn("known", F.lit(True))
    joined = found.join(known, "document_id", "left")
    return joined.withColumn("state", F.when(F.col("known") & (F.col("state") == "enqueued"), "duplicate").otherwise(F.col("state"))).drop("known")


def scrape_counters(found: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return found.agg(F.count("*").alias("discovered"), count("enqueued"), count("duplicate"), count("skipped"))


def stage_pivot(jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Jobs (stage, status) counted per stage and status, with the total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return jobs.groupBy("stage").agg(*counts, F.count("*").alias("total"))


def stage_metrics(log: DataFrame) -> DataFrame:
    """Sums, last and greatest latency per process of log (process, ts, inputs, outputs, failures, latency)."""
    return log.groupBy("process").agg(
        F.sum("inputs").alias("input_count"), F.sum("outputs").alias("output_count"), F.sum("failures").alias("failure_count"), F.sum("latency").alias("total_latency"),
        F.max_by("latency", F.struct("ts", "latency")).alias("last_latency"), F.max("latency").alias("max_latency"), F.max("ts").alias("updated_at"),
    )


def health(workers: DataFrame, now, most_seconds: int = 15) -> DataFrame:
    """offline if no worker (beat) is alive, healthy if all are, else degraded."""
    alive = F.unix_timestamp(now) - F.unix_timestamp("beat") < most_seconds
    return workers.agg(F.when(~F.coalesce(F.bool_or(alive), F.lit(False)), "offline").when(F.bool_and(alive), "healthy").otherwise("degraded").alias("health"))


def raw_usage(pages: DataFrame, body: str = "html") -> DataFrame:
    return pages.agg(F.count(body).alias("files"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"))


def status_totals(jobs: DataFrame) -> DataFrame:
    """Jobs per status over all stages."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def overview(catalog: DataFrame, queued: DataFrame) -> DataFrame:
    """Documents and queued items per status, one row per status of either."""
    queue = queue_items(queued, catalog).groupBy("status").agg(F.count("*").alias("queued"))
    both = status_counts(catalog).join(queue, "status", "full_outer")
    return both.select("status", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("queued", F.lit(0)).alias("queued"))


def ingest(results: DataFrame, catalog: DataFrame, limit: int = DEFAULT_RESULTS, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """The new catalog rows that results (order, title, url) give, and the counters of all results."""
    found = against_catalog(discover(results, limit, order), catalog)
    new = found.filter("state = 'enqueued'").select(F.col("document_id").alias("id"), F.col("normalized").alias("source_url"), "title", F.lit("NEW").alias("status"))
    return new, scrape_counters(found)
