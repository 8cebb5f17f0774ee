"""Text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_similarity, contains_any, trigrams
from .kept import kept


def fuzzy(df: DataFrame, query: str, columns: list[str], tie: str, least: float = 0.05, most: int = 50) -> DataFrame:
    """best trigram similarity over the columns, best first, ties by the key ``tie``; a top-k report."""
    score = best_similarity(F.lit(query), *map(F.col, columns))
    return df.withColumn("score", F.round(score, 6)).filter(F.col("score") > least).orderBy(F.desc("score"), tie).limit(most)


def similar_pairs(names: DataFrame, queries: DataFrame, id1: str, text1: str, id2: str, text2: str, least: float = 0.3) -> DataFrame:
    """F2 for a table of queries: (id1, id2, score) of all pairs whose trigram similarity is ``least`` (above 0) or more; scores have six places.

    An inverted index of trigrams, rarest first: with n trigrams, a partner must share one of the first n - ceil(least * n) + 1 and have between least * n and
    n / least, so frequent trigrams hardly ever become keys and most names are never scored. Ties in rarity go by hash, the same on both sides. Ids are distinct; texts without a
    letter or digit (null, empty) match nothing.
    """
    sides = names.select(F.lit(0).alias("side"), F.col(id1).cast("string").alias("id"), F.col(text1).alias("t")).unionByName(queries.select(F.lit(1), F.col(id2).cast("string"), F.col(text2)).toDF("side", "id", "t"))
    grams = sides.select("side", "id", F.explode(trigrams(F.col("t"))).alias("g"))
    ranked = grams.join(grams.groupBy("g").agg(F.count("*").alias("often")), "g").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("often", F.xxhash64("g").alias("h"), "g"))).alias("gs"))
    n = F.size("gs")
    keyed = ranked.select("side", "id", F.col("gs.g").alias("gs"), n.alias("n"), F.slice("gs", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1).alias("keys"))
    index = kept(keyed.select("side", "id", "n", "gs", F.explode("keys.g").alias("g")))
    a, b = (index.filter(F.col("side") == k).select("g", *(F.col(c).alias(f"{c}{k}") for c in ("id", "n", "gs"))) for k in (0, 1))
    sizes = (F.col("n0") >= F.col("n1") * least - 1e-9) & (F.col("n1") >= F.col("n0") * least - 1e-9)
    both = F.size(F.array_intersect("gs0", "gs1"))
    score = both / (F.col("n0") + F.col("n1") - both)
    met = a.join(b, "g").filter(sizes & (score >= least)).select("id0", "id1", F.round(score, 6).alias("score")).distinct()
    return met.select(F.col("id0").cast(names.schema[id1].dataType).alias(id1), F.col("id1").cast(queries.schema[id2].dataType).alias(id2), "score")


def substring(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """P5."""
    return df.filter(contains_any(query, *map(F.col, columns)))


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """L3: one page (from 1) in a total order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def page_with_totals(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """L3: one page with the number of all rows (``total_rows``), of all pages, and its own number on each row; a page beyond the last has no rows.

    The count is a subquery of one value: it needs no column of df and runs beside the page.
    """
    total = df.agg(F.count("*")).scalar()
    counted = page(df, order, size, number).withColumn("total_rows", total)
    return counted.withColumn("total_pages", F.ceil(F.col("total_rows") / size)).withColumn("page_number", F.lit(number))


def pages(total: int, size: int) -> int:
    return -(-total // size)
