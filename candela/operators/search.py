"""Name search: an inverted index of 3-grams with a count filter, and gram intersection for substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from candela.functions.text import normalize_query, trigram_similarity, trigrams
from candela.operators import temporal
from candela.session import staged


def substring_grams(text: Column) -> Column:
    """All runs of three characters of a text, spaces included; a text with a substring has all of the substring's."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))))


def _short_grams(text: Column) -> Column:
    """All runs of one and of two characters, for queries that have no run of three."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.array_distinct(F.concat(F.coalesce(runs(1), F.array().cast("array<string>")), F.coalesce(runs(2), F.array().cast("array<string>"))))


def _postings(rows: DataFrame, grams: Column, kind: str) -> DataFrame:
    return rows.select("name_id", F.lit(kind).alias("kind"), F.size(grams).alias("size"), F.explode(grams).alias("gram"))


class NameIndex:
    """Distinct names and their postings: word 3-grams for similarity, character runs for substrings.

    The index is staged once and serves any number of query tables. A posting
    list is a key's rows, never an array, so a common gram is many rows.
    """

    def __init__(self, names: DataFrame, column: str = "normalized_name"):
        rows = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("name_id", F.xxhash64("name"))
        self.names = staged(rows.select("name_id", "name"), "names")
        similar = _postings(self.names, trigrams(F.col("name")), "similar")
        inside = _postings(self.names, F.array_distinct(F.concat(F.coalesce(substring_grams(F.col("name")), F.array().cast("array<string>")), _short_grams(F.col("name")))), "inside")
        self.postings = staged(similar.unionByName(inside), "postings")
        self.weights = staged(self.postings.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("names")), "weights")

    def similar(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(query_id, name_id) of names that share enough grams for a similarity of threshold.

        Similarity is shared / (a + b - shared), so a pair needs
        threshold / (1 + threshold) * (a + b) shared grams, and each size is
        at least threshold times the other. A query's least frequent
        b - ceil(threshold * b) + 1 grams are looked up first: a name that holds
        none of them can't reach the threshold. Sums of grams are then counted
        for what was met.
        """
        grams = queries.select("query_id", F.size("qg").alias("b"), F.explode("qg").alias("gram"))
        weighed = grams.join(self.weights.where("kind = 'similar'").select("gram", "names"), "gram", "left")
        place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.coalesce("names", F.lit(0)), "gram"))
        first = weighed.withColumn("place", place).where(F.col("place") <= F.col("b") - F.ceil(F.col("b") * threshold - 1e-9) + 1)
        own = self.postings.where("kind = 'similar'").select("name_id", F.col("size").alias("a"), "gram")
        fits = (F.col("a") >= F.col("b") * threshold - 1e-9) & (F.col("a") * threshold <= F.col("b") + 1e-9)
        met = first.join(own, "gram").where(fits).groupBy("query_id", "name_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        shared = met.join(queries.select("query_id", F.explode("qg").alias("gram")), "query_id").join(own.select("name_id", "gram"), ["name_id", "gram"])
        counted = shared.groupBy("query_id", "name_id").agg(F.count(F.lit(1)).alias("shared"), F.max("a").alias("a"), F.max("b").alias("b"))
        return counted.where(F.col("shared") >= (F.col("a") + F.col("b")) * (threshold / (1 + threshold)) - 1e-9).select("query_id", "name_id")

    def containing(self, queries: DataFrame) -> DataFrame:
        """(query_id, name_id) of names that hold the query's text: all its runs of three, then the text itself.

        Shorter queries have one run of their own length. The least frequent
        run is looked up, and what it meets is verified.
        """
        runs = F.when(F.length("q") >= 3, substring_grams(F.col("q"))).otherwise(F.array(F.col("q")))
        grams = queries.where("q <> ''").select("query_id", "q", F.explode(runs).alias("gram"))
        weighed = grams.join(self.weights.where("kind = 'inside'").select("gram", "names"), "gram", "left")
        rare = weighed.groupBy("query_id", "q").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
        own = self.postings.where("kind = 'inside'").select("name_id", "gram")
        met = rare.join(own, "gram").join(self.names, "name_id")
        return met.where(F.col("name").contains(F.col("q"))).select("query_id", "name_id")


def search(entities: DataFrame, queries: DataFrame, threshold: float = 0.3, index: NameIndex | None = None, include_demo: bool = True) -> DataFrame:
    """ER10/F4/F6/P8/T1: each query's hits, by similarity or substring, ranked within its limit.

    entities: entity_id, entity_type, normalized_name, and where demo rows are
    to be left out is_demo; queries: query_id (unique), query, entity_type (null for any),
    top. Both are joined by grams and hashes, none is broadcast by hand. A
    query of white space is part of every name, so it gets the first names.
    """
    known = index or NameIndex(entities)
    q = queries.withColumn("q", normalize_query(F.col("query"))).where("q is not null").withColumn("qg", trigrams(F.col("q")))
    q = staged(q, "queries")
    met = known.similar(q, threshold).unionByName(known.containing(q))
    hits = met.distinct().join(q, "query_id").join(known.names, "name_id").withColumn("score", trigram_similarity(trigrams(F.col("name")), F.col("qg")))
    # Names are met by their hash, so what they say is looked at once more.
    hits = hits.where((F.col("score") >= threshold) | F.col("name").contains(F.col("q")))
    scored = staged(hits.select("query_id", F.col("entity_type").alias("wanted"), "top", F.col("name").alias("normalized_name"), "score"), "scored")
    rows = entities if include_demo else entities.where(~F.coalesce(F.col("is_demo"), F.lit(False)))
    rows = rows.select("entity_id", "entity_type", "normalized_name")
    found = rows.join(scored, "normalized_name").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("entity_type")))
    blank = q.where("q = ''").select("query_id", F.col("entity_type").alias("wanted"), "top")
    most = blank.agg(F.max("top")).first()[0]
    if most:
        first = F.row_number().over(W.Window.partitionBy("entity_type").orderBy("normalized_name", "entity_id"))
        # At most so many rows a type.
        named = rows.where("normalized_name is not null").withColumn("n", first).where(F.col("n") <= most).drop("n")
        all_of = named.join(F.broadcast(blank), F.col("wanted").isNull() | (F.col("wanted") == F.col("entity_type"))).withColumn("score", F.lit(0.0))
        found = found.unionByName(all_of.select(*found.columns))
    w = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "normalized_name", "entity_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("top")).select("query_id", "entity_id", "normalized_name", "score", "rank")


def search_as_of(entity_log: DataFrame, queries: DataFrame, known_at: Column, threshold: float = 0.3, include_demo: bool = False) -> DataFrame:
    """ER10/W1: the search over the entities known at a cutoff; names of later or deleted versions don't count."""
    live = staged(temporal.snapshot(entity_log, known_at, keys=("entity_id",)), "live")
    return search(live, queries, threshold, include_demo=include_demo)
