"""From a table's schema to a configuration and a plan of what to write for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braid.config import SearchConfig
from braid.functions.text import analyze
from braid.sources.ivf import ivf_lists

#: Names that are tried first, in this order.
VECTOR_NAMES = ("embedding", "embeddings", "vector", "vec", "emb")
TEXT_NAMES = ("content", "text", "body", "chunk", "description")
FILTER_NAMES = ("tenant_id", "source", "lang", "language", "category", "type", "status")
EXTRA_NAMES = ("title", "name", "url", "source", "path")


@dataclass(frozen=True)
class Step:
    what: str
    why: str
    required: bool


def _first(names: list[str], wanted: tuple[str, ...]) -> str | None:
    return next((w for w in wanted if w in names), names[0] if names else None)


def suggest_config(table: DataFrame) -> SearchConfig:
    """Columns chosen by type, then by name."""
    fields = table.schema.fields
    vectors = [f.name for f in fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    tokens = [f.name for f in fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    if not vectors or not texts:
        raise ValueError(f"the table has no {'vector' if not vectors else 'text'} column")
    names = [f.name for f in fields]
    id_column = next((c for c in ("id", *[n for n in names if n.endswith("_id")]) if c in names), names[0])
    text = _first(texts, TEXT_NAMES)
    taken = {id_column, text}
    return SearchConfig(
        text_column=text, vector_column=_first(vectors, VECTOR_NAMES), id_column=id_column, tokens_column=tokens[0] if tokens else None,
        filter_columns=tuple(n for n in names if n in FILTER_NAMES and n not in taken)[:8], extra_columns=tuple(n for n in EXTRA_NAMES if n in texts and n not in taken)[:2],
    )


def build_plan(table: DataFrame, config: SearchConfig, rows: int | None = None) -> list[Step]:
    """What to write, and why; nothing is written here."""
    steps = []
    if config.tokens_column is None:
        steps.append(Step("write the table with a tokens column", "else every search analyses every text", True))
    n = table.count() if rows is None else rows
    steps.append(Step("write postings", "a text search then reads those of its lexemes only", n >= 10_000))
    steps.append(Step(f"build an IVF index with {ivf_lists(n)} lists", f"{n} rows; a search then reads the nearest lists only", n >= 10_000))
    if config.filter_columns:
        steps.append(Step(f"partition or cluster by {', '.join(config.filter_columns)}", "filters then skip files", False))
    return steps


def with_tokens(table: DataFrame, config: SearchConfig, name: str = "tokens") -> DataFrame:
    return table.withColumn(name, analyze(F.col(config.text_column), config.language))
