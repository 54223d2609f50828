"""One hybrid search as one DataFrame.

Filters and exclusions stand below both candidate limits; each limit is a top-k with the
id as tiebreaker, and ranks are taken over what it leaves. The fused candidates, at most
twice the pool, are broadcast to fetch the columns of the page.

With postings the text side reads those of the query's lexemes, and with a vector index
the vector side reads the lists nearest to the query, in place of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braid.config import FUSIONS, METRICS, SearchConfig
from braid.functions import text as T
from braid.functions.vector import distance, literal
from braid.operators.nearest import SLICE_BYTES, nearest


def filter_column(filters: dict, allowed: tuple[str, ...]) -> Column:
    """AND of the filters: value, collection (any of; none of an empty one), or None (is null)."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in allowed:
            raise ValueError(f"{name!r} isn't in filter_columns")
        if value is None:
            part = F.col(name).isNull()
        elif isinstance(value, (list, tuple, set, frozenset)):
            part = F.col(name).isin(list(value)) if value else F.lit(False)
        else:
            part = F.col(name) == F.lit(value)
        out = out & part
    return out


@dataclass
class SearchResult:
    """A row of a page. ``get`` gives a computed or fetched column by name."""

    id: object
    score: float
    vector_rank: int | None
    text_rank: int | None
    matched_by: str
    columns: dict = field(default_factory=dict)

    def get(self, name: str, default=None):
        return self.columns.get(name, default)


class HybridSearch:
    """Searches ``table`` (any DataFrame) as ``config`` describes it. Ids must be unique and not null.

    ``index`` (an ``IvfIndex``) and ``postings`` (``Postings``) of the same rows replace scans of
    the table. ``probes`` lists of the index are read; where filters or exclusions leave fewer
    rows than the pool, twice as many, and so on to all.
    """

    def __init__(self, table: DataFrame, config: SearchConfig, index=None, postings=None, probes: int | None = None) -> None:
        needed = [config.id_column, config.text_column, config.vector_column, *config.filter_columns, *config.extra_columns]
        missing = [c for c in needed + ([config.recency.column] if config.recency else []) if c not in table.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")
        if index is not None and METRICS[index.metric] != METRICS[config.metric]:
            raise ValueError(f"the index is for {index.metric}, the search uses {config.metric}")
        self.table, self.config, self.index, self.postings, self.probes = table, config, index, postings, probes

    def tokens(self) -> Column:
        c = self.config
        return F.col(c.tokens_column) if c.tokens_column else T.analyze(F.col(c.text_column), c.language)

    def vector_of(self, row_id) -> list[float]:
        row = self.table.where(F.col(self.config.id_column) == F.lit(row_id)).select(self.config.vector_column).first()
        if row is None or row[0] is None:
            raise ValueError(f"no vector for id {row_id!r}")
        return list(row[0])

    def pool(self, limit: int, offset: int, near_miss: int, candidate_limit: int | None) -> int:
        if limit < 1 or offset < 0 or near_miss < 0 or (candidate_limit or 0) < 0:
            raise ValueError("limit must be positive; offset, near_miss and candidate_limit must not be negative")
        pool = max(candidate_limit or self.config.candidate_limit, limit + near_miss)
        if offset + limit + near_miss > pool and offset:
            raise ValueError(f"this page needs a candidate_limit of {offset + limit + near_miss}; it is {pool}")
        return pool

    def signals(self, text: str | None, embedding) -> tuple[T.ParsedQuery, object, bool, bool]:
        c, text = self.config, text if text and text.strip() else None
        if text is None and embedding is None:
            raise ValueError("give an embedding, a text, or both")
        parsed = T.parse_query(text)
        if embedding is None and not parsed.positive:
            raise ValueError("the text only excludes terms" if parsed.negative else "the text has no searchable terms")
        tree = T.build_tree(parsed, text or "", language=c.language, parser=c.query_parser, match=c.text_match, max_terms=c.max_query_terms, strict_phrases=c.strict_phrases)
        return parsed, tree, embedding is not None, bool(parsed.positive)

    def base(self, parsed: T.ParsedQuery, filters: dict | None) -> DataFrame:
        c = self.config
        out = self.table
        if filters:
            if not c.filter_columns:
                raise ValueError("no filter_columns are configured")
            out = out.where(filter_column(filters, c.filter_columns))
        bad = [n for n in (T.phrase_query(t, c.language) for t in parsed.negative) if n]
        if self.postings is not None:
            if bad:
                gone = self.postings.find(("or", tuple(bad))).select(F.col("id").alias("_gone"))
                out = out.join(gone, F.col(c.id_column) == F.col("_gone"), "left_anti")
            return out
        out = out.withColumn("_tokens", self.tokens())
        if bad:
            out = out.where(~F.coalesce(T.matches(F.col("_tokens"), ("or", tuple(bad))), F.lit(False)))
        return out

    def candidates(self, text: str | None, embedding, filters: dict | None, pool: int, fusion: str | None = None) -> DataFrame:
        """Fused candidates, at most two pools of them: id, ranks, raw scores, contributions, fused_score."""
        c, fusion = self.config, fusion or self.config.fusion
        if fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {fusion!r}; options: {', '.join(FUSIONS)}")
        parsed, tree, by_vector, by_text = self.signals(text, embedding)
        base = self.base(parsed, filters)
        base = base.withColumn("id", F.col(c.id_column))
        narrowed = bool(filters) or bool(parsed.negative)
        sides = []
        if by_vector:
            if self.index is not None:
                near = self._probed(embedding, base.select("id") if narrowed else None, pool)
            else:
                near = base.where(F.col(c.vector_column).isNotNull()).select("id", distance(c.vector_column, literal(embedding), c.metric).alias("vector_distance"))
            near = near.orderBy("vector_distance", "id").limit(pool)
            sides.append(near.withColumn("vector_rank", F.rank().over(W.orderBy("vector_distance")).cast("long")))
        if by_text:
            if tree and self.postings is not None and T.needs_presence(tree):
                found = self.postings.find(tree)
                found = found.join(base.select("id"), "id", "left_semi") if narrowed else found
                found = T.rank_places(found, tree, c.rank_function)
            else:
                rows = base if "_tokens" in base.columns else base.withColumn("_tokens", self.tokens())
                score = (T.rank_cd if c.rank_function == "rank_cd" else T.rank_frequency)(F.col("_tokens"), tree) if tree else F.lit(0.0)
                found = rows.where(T.matches(F.col("_tokens"), tree)).select("id", score.alias("text_score"))
            found = found.orderBy(F.desc("text_score"), "id").limit(pool)
            sides.append(found.withColumn("text_rank", F.rank().over(W.orderBy(F.desc("text_score"))).cast("long")))
        both = sides[0] if len(sides) == 1 else sides[0].join(sides[1], "id", "full_outer")
        for name, kind in (("vector_rank", "long"), ("vector_distance", "double"), ("text_rank", "long"), ("text_score", "double")):
            if name not in both.columns:
                both = both.withColumn(name, F.lit(None).cast(kind))
        if fusion == "rrf":
            v, t = (F.lit(float(w)) / (F.lit(float(c.k)) + F.col(r)) for w, r in ((c.weights.vector, "vector_rank"), (c.weights.text, "text_rank")))
        else:
            v, t = F.lit(float(c.weights.vector)) * (1 - F.col("vector_distance")), F.lit(float(c.weights.text)) * F.col("text_score")
        both = both.withColumn("vector_contribution", F.coalesce(v, F.lit(0.0))).withColumn("text_contribution", F.coalesce(t, F.lit(0.0)))
        return both.withColumn("fused_score", F.col("vector_contribution") + F.col("text_contribution"))

    def _probed(self, embedding, kept: DataFrame | None, pool: int) -> DataFrame:
        """id, vector_distance of the index's rows in the lists read, less those not in ``kept``."""
        vector, probes, lists = literal(embedding), self.probes or self.index.probes, len(self.index.centres)
        while True:
            rows = self.index.probe(embedding, probes)
            if kept is not None:
                rows = rows.join(kept, "id", "left_semi")
            if kept is None or probes >= lists or rows.limit(pool).count() >= pool:
                return rows.select("id", distance("v", vector, self.config.metric).alias("vector_distance"))
            probes = min(2 * probes, lists)

    def results(self, *args, **how) -> list[SearchResult]:
        """``search``, with the page's rows as objects."""
        page = self.search(*args, **how)
        rows = [r.asDict() for r in page.withColumn("matched_by", self.matched_by()).collect()]
        return [SearchResult(*(r[c] for c in ("id", "score", "vector_rank", "text_rank", "matched_by")), r) for r in rows]

    def search(
        self, text: str | None = None, embedding=None, *, limit: int = 10, offset: int = 0, filters: dict | None = None, candidate_limit: int | None = None, near_miss: int = 0, highlight: bool = False, fusion: str | None = None, as_of: datetime | None = None
    ) -> DataFrame:
        """The page, best first, with both ranks, raw scores and contributions of every row."""
        c = self.config
        pool = self.pool(limit, offset, near_miss, candidate_limit)
        fused = self.candidates(text, embedding, filters, pool, fusion)
        kept = list(dict.fromkeys([c.text_column, *c.extra_columns]))
        source = self.table.withColumn("id", F.col(c.id_column))
        computed = ["vector_rank", "vector_distance", "vector_contribution", "text_rank", "text_score", "text_contribution"]
        if c.recency:
            # the factor decides the order, so candidates (two pools at most) fetch their columns before the limit
            rows = source.join(F.broadcast(fused), "id").withColumn("recency_factor", self.recency(as_of)).withColumn("score", F.col("fused_score") * F.col("recency_factor"))
            computed.append("recency_factor")
            page = rows.orderBy(F.desc("score"), "id").offset(offset).limit(limit + near_miss)
        else:
            top = fused.withColumn("score", F.col("fused_score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit + near_miss)
            page = source.join(F.broadcast(top), "id").orderBy(F.desc("score"), "id")
        out = page.select("id", "score", "fused_score", *computed, *kept)
        if highlight:
            parsed, tree, _, by_text = self.signals(text, embedding)
            if by_text:
                wanted, language, escape = set(T.lexemes(tree)), c.language, c.escape_highlight

                @F.pandas_udf("string")
                def marked(rows: pd.Series) -> pd.Series:
                    return rows.map(lambda x: T.highlight(x or "", wanted, language, escape=escape))

                out = out.withColumn("highlight", marked(F.col(c.text_column)))
            else:
                out = out.withColumn("highlight", F.lit(None).cast("string"))
        return out

    def recency(self, as_of: datetime | None) -> Column:
        """Half after each half-life; 1 for null and future times."""
        r = self.config.recency
        now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
        age = F.timestamp_diff("MICROSECOND", F.col(r.column).cast("timestamp_ntz"), now) / F.lit(1e6)
        return F.coalesce(F.exp(F.lit(-0.6931471805599453) * F.greatest(age, F.lit(0.0)) / F.lit(r.half_life_days * 86400.0)), F.lit(1.0))

    @staticmethod
    def matched_by() -> Column:
        v, t = F.col("vector_rank").isNotNull(), F.col("text_rank").isNotNull()
        return F.when(v & t, "both").when(v, "vector").when(t, "text").otherwise("none")


def batch_vector_search(table: DataFrame, queries: DataFrame, k: int, metric: str, id_column: str = "id", vector_column: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """query_id, id, distance, rank for many queries (query_id, vector); see ``nearest``. Each slice of queries reads the table once."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    return nearest(rows, queries, k, metric, slice_bytes).select("query_id", "id", "distance", "rank")
