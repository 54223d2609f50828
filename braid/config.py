"""What a search needs to know of a table, checked when it is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

METRICS = {
    "cosine": "cosine", "l2": "l2", "euclidean": "l2", "inner_product": "inner_product", "ip": "inner_product", "l1": "l1", "manhattan": "l1",
}
PARSERS = ("websearch", "plain", "phrase")
RANKS = ("rank_cd", "rank")
LANGUAGES = ("simple", "english")
FUSIONS = ("rrf", "weighted")
COMPUTED = (
    "id", "score", "fused_score", "vector_rank", "vector_distance", "vector_contribution", "text_rank", "text_score", "text_contribution", "recency_factor", "highlight",
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*\Z")


class IdentifierError(ValueError):
    pass


def check_name(name: str) -> str:
    """A table or column name of one or two plain parts."""
    parts = name.split(".") if isinstance(name, str) else []
    if not 1 <= len(parts) <= 2 or not all(_NAME.match(p) for p in parts):
        raise IdentifierError(f"not a valid name: {name!r}")
    return name


def _one_of(what: str, value: str, options) -> None:
    if value not in options:
        raise ValueError(f"unknown {what} {value!r}; options: {', '.join(options)}")


@dataclass(frozen=True)
class Weights:
    vector: float = 1.0
    text: float = 1.0

    def __post_init__(self) -> None:
        if self.vector < 0 or self.text < 0 or self.vector + self.text == 0:
            raise ValueError("weights must not be negative, nor both 0")


@dataclass(frozen=True)
class Recency:
    column: str
    half_life_days: float

    def __post_init__(self) -> None:
        check_name(self.column)
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be positive")


@dataclass(frozen=True)
class SearchConfig:
    text_column: str
    vector_column: str
    id_column: str = "id"
    tokens_column: str | None = None
    language: str = "english"
    metric: str = "cosine"
    fusion: str = "rrf"
    k: int = 60
    weights: Weights = field(default_factory=Weights)
    candidate_limit: int = 50
    query_parser: str = "websearch"
    rank_function: str = "rank_cd"
    text_match: str = "any"
    max_query_terms: int = 200
    filter_columns: tuple[str, ...] = ()
    extra_columns: tuple[str, ...] = ()
    recency: Recency | None = None
    escape_highlight: bool = True
    strict_phrases: bool = False

    def __post_init__(self) -> None:
        for name in (self.text_column, self.vector_column, self.id_column, *self.filter_columns, *self.extra_columns, *([self.tokens_column] if self.tokens_column else [])):
            check_name(name)
        for name in (self.text_column, *self.extra_columns):
            if name in COMPUTED:
                raise ValueError(f"{name!r} is the name of a computed column")
        _one_of("metric", self.metric, METRICS)
        _one_of("fusion", self.fusion, FUSIONS)
        _one_of("query parser", self.query_parser, PARSERS)
        _one_of("rank function", self.rank_function, RANKS)
        _one_of("language", self.language, LANGUAGES)
        _one_of("text match", self.text_match, ("any", "all"))
        if self.k < 0 or self.candidate_limit < 1 or self.max_query_terms < 1:
            raise ValueError("k must not be negative; candidate_limit and max_query_terms must be positive")
