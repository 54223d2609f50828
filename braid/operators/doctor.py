"""Inspection of a table before it is searched."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.config import SearchConfig
from braid.functions import text as T
from braid.operators.search import HybridSearch, batch_vector_search, filter_column

RECALL_ERROR, RECALL_WARN, NULL_WARN, LOST_WARN = 0.75, 0.90, 0.01, 0.05
#: Rows up to which a sample is a sort, and from which a search that skips no list is worth a finding; queries timed for each number of lists.
ROWS_SORTED, ROWS_PROBED, TIMED = 200_000, 10_000, 5


@dataclass
class Finding:
    level: str
    what: str
    advice: str = ""


def duplicate_ids(table: DataFrame, id_column: str) -> DataFrame:
    """The id that occurs most, if any occurs twice."""
    return table.groupBy(F.col(id_column).alias("id")).count().where("count > 1").orderBy(F.desc("count"), "id").limit(1).select("id", F.col("count").alias("copies"))


def null_fraction(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.count("*").alias("row_count"), F.count_if(F.col(column).isNull()).alias("nulls"), F.avg(F.col(column).isNull().cast("double")).alias("null_fraction"))


def common_value(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count().orderBy(F.desc("count"), "value").limit(1).select("value", F.col("count").alias("n"))


def tokens_drift(table: DataFrame, tokens_column: str, text_column: str, language: str) -> DataFrame:
    """Rows whose stored tokens differ from those of their text now."""
    fresh = T.analyze(F.col(text_column), language)
    return table.agg(F.count("*").alias("row_count"), F.count_if(~F.col(tokens_column).eqNullSafe(fresh)).alias("drifted"))


def percentile(values: list[float], share: float) -> float:
    """Nearest rank."""
    return sorted(values)[max(1, math.ceil(share * len(values))) - 1]


def sample_rows(table: DataFrame, n: int, rows: int, seed: int = 3) -> DataFrame:
    """About random rows: by a sort up to ROWS_SORTED rows of the table, by a share of it beyond."""
    if rows > ROWS_SORTED:
        return table.sample(min(1.0, max(0.0001, 4 * n / rows)), seed).limit(n)
    return table.orderBy(F.rand(seed)).limit(n)


def batch_recall(rows: DataFrame, index, queries: DataFrame, k: int, probes: int, config: SearchConfig) -> float | None:
    """Mean recall of the index at ``probes`` lists over queries (query_id, vector) on ``rows``: two jobs for all queries. None without any."""
    truth = batch_vector_search(rows, queries, k, config.metric, config.id_column, config.vector_column).select("query_id", "id")
    kept = rows.select(F.col(config.id_column).alias("id"))
    got = index.search_batch(queries, k, probes, kept=kept).select("query_id", "id", F.lit(1).alias("hit"))
    each = truth.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return each.agg(F.avg("recall")).first()[0]


def prunes(page: DataFrame) -> bool:
    """Whether a plan skips lists of a vector index."""
    return "PartitionFilters: [list#" in page._jdf.queryExecution().executedPlan().toString()


def filter_probes(table: DataFrame, config: SearchConfig, filters: dict | None = None) -> list[tuple[dict, float]]:
    """The caller's filters, or two filter columns at their most common value, each with the exact share of rows that pass."""
    if filters:
        tried = [filters]
    else:
        common = [(c, common_value(table, c).first()) for c in config.filter_columns[:2]]
        tried = [{c: v["value"]} for c, v in common if v]
    if not tried:
        return []
    shares = [F.avg(F.coalesce(filter_column(f, config.filter_columns), F.lit(False)).cast("double")) for f in tried]
    return [(f, s or 0.0) for f, s in zip(tried, table.agg(*shares).first())]


def filtered_recall(table: DataFrame, config: SearchConfig, index, queries: DataFrame, k: int, filters: dict, plain: float, probes: int | None = None) -> list[Finding]:
    """What a filter costs the index, and the number of lists that brings it back."""
    rows, lists, probes = table.where(filter_column(filters, config.filter_columns)), len(index.centres), probes or index.probes
    value = batch_recall(rows, index, queries, k, probes, config)
    if value is None or plain - value <= LOST_WARN or value >= RECALL_WARN:
        return []
    wider, better = probes, value
    while better < RECALL_WARN and wider < lists:
        wider = min(2 * wider, lists)
        better = batch_recall(rows, index, queries, k, wider, config)
    return [Finding("warn", f"recall@{k} falls from {plain:.2f} to {value:.2f} under {filters}", f"{wider} of {lists} lists give {better:.2f}")]


def recall_verdict(value: float) -> str:
    return "error" if value < RECALL_ERROR else "warn" if value < RECALL_WARN else "ok"


def doctor(table: DataFrame, config: SearchConfig, index=None, sample: int = 20, k: int = 10, sweep: bool = False, filters: dict | None = None, probes: int | None = None) -> list[Finding]:
    """Findings on columns, ids, nulls, stored tokens, dimensions and an index: its plan, its recall, and that under filters."""
    if sample < 1 or k < 1:
        raise ValueError("sample and k must be positive")
    if filters and not config.filter_columns:
        raise ValueError("no filter_columns are configured")
    out = [Finding("error", f"no column {c}") for c in (config.id_column, config.text_column, config.vector_column) if c not in table.columns]
    if out:
        return out
    twice = duplicate_ids(table, config.id_column).first()
    if twice:
        out.append(Finding("error", f"id {twice['id']} occurs {twice['copies']} times", "make ids unique"))
    share = null_fraction(table, config.vector_column).first()
    if share["row_count"] and share["null_fraction"] > NULL_WARN:
        out.append(Finding("warn", f"{share['null_fraction']:.1%} of vectors are null", "rows without a vector are found by text only"))
    sizes = table.where(F.col(config.vector_column).isNotNull()).groupBy(F.size(config.vector_column).alias("d")).count().orderBy(F.desc("count")).limit(2).collect()
    if len(sizes) > 1:
        out.append(Finding("error", f"vectors have different dimensions, {sizes[0]['d']} and {sizes[1]['d']} among them"))
    if config.tokens_column:
        drift = tokens_drift(table, config.tokens_column, config.text_column, config.language).first()
        if drift["drifted"]:
            out.append(Finding("warn", f"{drift['drifted']} of {drift['row_count']} rows have stale tokens", "write the tokens again"))
    if index is None:
        out.append(Finding("info", "no vector index: every search scans all vectors"))
        return out
    if index.metric != config.metric:
        out.append(Finding("error", f"the index is for {index.metric}, the search uses {config.metric}"))
    if index.size != share["row_count"] - share["nulls"]:
        out.append(Finding("warn", "the index is stale: it has another number of rows", "build it again"))
    held = table.where(F.col(config.vector_column).isNotNull())
    vectors = [list(r[0]) for r in sample_rows(held.select(config.vector_column), sample, share["row_count"]).collect()]
    if not vectors:
        return out
    queries = table.sparkSession.createDataFrame(list(enumerate(vectors)), "query_id long, vector array<double>")
    lists, usual = len(index.centres), probes or index.probes
    if index.metric == config.metric:
        page = HybridSearch(table, config, index, probes=usual).candidates(None, vectors[0], None, k)
        if not prunes(page) and share["row_count"] >= ROWS_PROBED:
            out.append(Finding("warn", "a search skips no list of the index", "read fewer lists"))
    plain = None
    for n in sorted({1, 2, usual, max(1, lists // 4), max(1, lists // 2), lists}) if sweep else [usual]:
        value = batch_recall(held, index, queries, k, min(n, lists), config)
        plain = value if n == usual else plain
        times = ""
        if sweep:
            took = []
            for v in vectors[:TIMED]:
                start = time.perf_counter()
                index.search(v, k, n).collect()
                took.append(time.perf_counter() - start)
            times = f"; {sum(took) / len(took):.3f} s in the mean, p50 {percentile(took, 0.5):.3f}, p95 {percentile(took, 0.95):.3f}"
        if value is not None:
            out.append(Finding(recall_verdict(value) if n == usual else "info", f"recall@{k} is {value:.2f} at {n} of {lists} lists{times}"))
    for tried, passing in filter_probes(table, config, filters):
        out.append(Finding("info", f"{passing:.1%} of rows pass {tried}"))
        if plain is not None and passing:
            out.extend(filtered_recall(held, config, index, queries, k, tried, plain, usual))
    return out
