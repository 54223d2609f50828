"""A full-text index: for each lexeme the rows that have it and where, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.config import SearchConfig
from braid.functions import text as T


def postings(table: DataFrame, config: SearchConfig) -> DataFrame:
    """lexeme, id, position. Ranges of all three, so a lexeme of a third of all rows is in many parts; a part is sorted, and packs well."""
    tokens = F.col(config.tokens_column) if config.tokens_column else T.analyze(F.col(config.text_column), config.language)
    rows = table.select(F.col(config.id_column).alias("id"), F.posexplode(tokens).alias("position", "lexeme")).where("lexeme <> ''")
    return rows.select("lexeme", "id", "position").repartitionByRange("lexeme", "id", "position").sortWithinPartitions("lexeme", "id", "position")


def write_postings(table: DataFrame, config: SearchConfig, path: str) -> "Postings":
    postings(table, config).write.parquet(path)
    return Postings(table.sparkSession, path)


class Postings:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(path)

    def places(self, words: list[str]) -> DataFrame:
        """id, places (a map from lexeme to positions) of the rows with any of the lexemes; the filter skips files and row groups."""
        found = self.rows.where(F.col("lexeme").isin(words)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lexeme", "position"))).alias("hits"))

        def of(word):
            return F.struct(word.alias("w"), F.transform(F.filter("hits", lambda h: h["lexeme"] == word), lambda h: h["position"]).alias("p"))

        places = F.map_from_entries(F.transform(F.array(*[F.lit(w) for w in words]), of))
        return found.select("id", F.map_filter(places, lambda _, p: F.size(p) > 0).alias("places"))

    def find(self, node) -> DataFrame:
        """id, places of the rows that satisfy a tree, for which a presence is needed."""
        if not T.needs_presence(node):
            raise ValueError("rows without any of the query's lexemes satisfy it; postings can't find those")
        return self.places(T.lexemes_all(node)).where(T.matches_places(F.col("places"), node))
