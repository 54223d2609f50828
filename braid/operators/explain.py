"""Why a search ranks as it does: near misses, what the weights really do, and where a missing row is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braid.functions import text as T
from braid.functions.vector import distance, literal
from braid.operators.search import HybridSearch, filter_column

LABELS = ("title", "name", "heading", "subject", "path", "url")


def candidate_stats(fused: DataFrame) -> DataFrame:
    """Counts of the fused candidates and the range of each signal's contribution where it retrieved."""
    v, t = F.col("vector_rank").isNotNull(), F.col("text_rank").isNotNull()
    return fused.agg(
        F.count("*").alias("fused"), F.count_if(v).alias("by_vector"), F.count_if(t).alias("by_text"), F.count_if(v & t).alias("by_both"),
        F.min(F.when(v, F.col("vector_contribution"))).alias("vector_min"), F.max(F.when(v, F.col("vector_contribution"))).alias("vector_max"),
        F.min(F.when(t, F.col("text_contribution"))).alias("text_min"), F.max(F.when(t, F.col("text_contribution"))).alias("text_max"),
    )


def effective_weights(search: HybridSearch, text: str | None, embedding, *, fusion: str | None = None, filters: dict | None = None, candidate_limit: int | None = None) -> DataFrame:
    """signal, nominal, span, effective, distortion: configured shares against the shares of the spans that contributions have."""
    pool = search.pool(1, 0, 0, candidate_limit)
    stats = candidate_stats(search.candidates(text, embedding, filters, pool, fusion))
    w = search.config.weights
    total = float(w.vector + w.text)
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), F.lit(x / total).alias("nominal"), F.coalesce(F.col(f"{n}_max") - F.col(f"{n}_min"), F.lit(0.0)).alias("span")) for n, x in (("vector", w.vector), ("text", w.text))]))
    spans = stats.select("vector_max", "vector_min", "text_max", "text_min").select(rows)
    both = F.sum("span").over(W.partitionBy())  # two rows
    return spans.withColumn("effective", F.when(both > 0, F.col("span") / both)).withColumn("distortion", F.abs(F.col("effective") - F.col("nominal")))


def contains(columns: list[str], needle: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.instr(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle.lower()) > 0)
    return out


def locate(search: HybridSearch, find: str, text: str | None, embedding, filters: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row on the row that ``find`` names (exact match first, then filter-passing, then smallest id), empty if none does.

    Says whether it has a vector, its distance, text match and score, whether filters
    and exclusions let it pass, how many rows match ``find``, and its rank on each
    signal in the whole table (null where it isn't ranked).
    """
    c = search.config
    columns = columns or list(dict.fromkeys([c.text_column, *c.extra_columns]))
    parsed, tree, by_vector, by_text = search.signals(text, embedding)
    bad = [n for n in (T.phrase_query(t, c.language) for t in parsed.negative) if n]
    passes = filter_column(filters, c.filter_columns) if filters else F.lit(True)
    tokens = search.tokens()
    score = (T.rank_cd if c.rank_function == "rank_cd" else T.rank_frequency)(F.col("_tokens"), tree) if tree else F.lit(None).cast("double")
    exact = F.lit(False)
    for name in columns:
        exact = exact | (F.coalesce(F.col(name).cast("string"), F.lit("")) == find)
    rows = search.table.withColumn("_tokens", tokens).select(
        F.col(c.id_column).alias("id"), exact.alias("exact"), contains(columns, find).alias("named"), F.coalesce(passes, F.lit(False)).alias("passes_filters"),
        (F.coalesce(T.matches(F.col("_tokens"), ("or", tuple(bad))), F.lit(False)) if bad else F.lit(False)).alias("excluded_by_query"),
        F.col(c.vector_column).isNull().alias("embedding_missing"), (distance(c.vector_column, literal(embedding), c.metric) if by_vector else F.lit(None).cast("double")).alias("vector_distance"),
        (T.matches(F.col("_tokens"), tree) if by_text else F.lit(False)).alias("text_matches"), score.alias("text_score"),
    )
    named = rows.where("named")
    target = named.orderBy(F.desc("exact"), F.desc("passes_filters"), "id").limit(1)
    open_ = rows.where("passes_filters and not excluded_by_query").select(F.col("vector_distance").alias("d"), F.col("text_matches").alias("m"), F.col("text_score").alias("s"))
    ranks = open_.join(F.broadcast(target.select(F.col("vector_distance").alias("td"), F.col("text_score").alias("ts"))), F.lit(True)).agg(
        F.count_if(F.col("d") < F.col("td")).alias("closer"), F.count_if(F.col("m") & (F.col("s") > F.col("ts"))).alias("better")
    )
    count = named.agg(F.count("*").alias("match_count"))
    valid = F.col("passes_filters") & ~F.col("excluded_by_query")
    out = target.join(F.broadcast(ranks), F.lit(True)).join(F.broadcast(count), F.lit(True))  # one row each
    return out.select(
        "id", "match_count", "passes_filters", "excluded_by_query", "embedding_missing", "vector_distance", "text_matches", F.when(F.col("text_matches"), F.col("text_score")).alias("text_score"),
        F.when(valid & F.col("vector_distance").isNotNull(), F.col("closer") + 1).alias("vector_rank"), F.when(valid & F.col("text_matches"), F.col("better") + 1).alias("text_rank"),
    )


@dataclass
class ExplainReport:
    rows: list[dict]
    limit: int
    near_miss: int
    stats: dict
    weights: dict[str, list[dict]]
    found: dict | None
    verdict: str | None

    def to_text(self) -> str:
        lines = [f"{self.stats['fused']} candidates: {self.stats['by_vector']} by vector, {self.stats['by_text']} by text, {self.stats['by_both']} by both"]
        for i, r in enumerate(self.rows):
            if i == self.limit:
                lines.append("-- near misses --")
            lines.append(f"{i + 1:>3}  {r['score']:.5f}  vector {r['vector_rank'] or '-'}  text {r['text_rank'] or '-'}  {str(r['label'])[:60]}")
        for method, signals in self.weights.items():
            for s in signals:
                if s["effective"] is not None:
                    lines.append(f"{method}: {s['signal']} counts for {s['effective']:.0%}, set to {s['nominal']:.0%}")
        return "\n".join(lines + ([self.verdict] if self.verdict else []))


def explain(search: HybridSearch, text: str | None, embedding, *, limit: int = 10, near_miss: int = 10, filters: dict | None = None, candidate_limit: int | None = None, fusion: str | None = None, find: str | None = None, label_column: str | None = None) -> ExplainReport:
    """The page with near misses, weights under both fusions, and a diagnosis of ``find``. Collects at most two pools of rows."""
    c = search.config
    pool = search.pool(limit, 0, near_miss, candidate_limit)
    label = label_column or next((x for x in LABELS if x in c.extra_columns), c.text_column)
    page = search.search(text, embedding, limit=pool, candidate_limit=pool, filters=filters, fusion=fusion)
    rows = [r.asDict() | {"label": r[label]} for r in page.collect()]
    stats = candidate_stats(search.candidates(text, embedding, filters, pool, fusion)).first().asDict()
    weights = {m: [r.asDict() for r in effective_weights(search, text, embedding, fusion=m, filters=filters, candidate_limit=pool).collect()] for m in ("rrf", "weighted")}
    found, verdict = None, None
    if find is not None:
        place = next((i for i, r in enumerate(rows) if str(r["label"]) == find), None)
        if place is None:
            place = next((i for i, r in enumerate(rows) if any(isinstance(v, str) and find.lower() in v.lower() for v in r.values())), None)
        if place is not None:
            found = rows[place]
            verdict = f"returned at position {place + 1}" if place < limit else f"a near miss at position {place + 1}" if place < limit + near_miss else f"entered the pool but lost, at position {place + 1}"
        else:
            row = locate(search, find, text, embedding, filters).first()
            found = row.asDict() if row else None
            verdict = diagnose(found, pool)
    return ExplainReport(rows[: limit + near_miss], limit, near_miss, stats, weights, found, verdict)


def diagnose(found: dict | None, pool: int) -> str:
    if found is None:
        return "no row of the table matches"
    if found["excluded_by_query"]:
        return "excluded by a -term of the query"
    if not found["passes_filters"]:
        return "removed by the filters"
    if found["vector_rank"] is None and found["text_rank"] is None:
        return "neither signal can reach it"
    best = min(x for x in (found["vector_rank"], found["text_rank"]) if x is not None)
    return f"past the cut-off: its best rank is {best}, the pool is {pool}" if best > pool else "entered the pool but fell outside the fused rows"
