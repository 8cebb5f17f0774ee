"""Operator 6: sharding by extendible hashing (DataFrame functions only).

A row's address is a string of hash bits: 60 from the key, then 60 from key, text and row number, which only
matter where rows share a key. The directory starts with one bucket; a bucket whose bytes exceed the limit and
that holds more than one row splits on the next bit. A row's shard is therefore the shortest prefix of its
address whose bucket fits. Sizes of all prefixes come from one histogram over fine cells (partial sums before the
shuffle); the cells of buckets that are still too large at the finest level get further bits in another round.

Null keys share the address of the empty string; null text has 0 bytes. A single row over the limit stands
alone in its shard with ``oversized``. Repeated rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LIMIT_BYTES = 16 << 20
WORD = 60
#: Bits of the first histogram beyond those that equal buckets would need, and bits of each later round.
SPARE_BITS = 6
ROUND_BITS = 8


def bits_of(text: Column) -> Column:
    """60 hash bits as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text), 1, WORD // 4), 16, 2), WORD, "0")


def assign(df: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, oversized) per row; shard is the bit prefix, depth its length."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = stored(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.concat(
                bits_of(key.cast("binary")),
                bits_of(
                    F.concat_ws(":", key, F.md5(F.col(text_col).cast("binary")), F.monotonically_increasing_id()).cast("binary")
                ),
            ).alias("bits"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    width = min(2 * WORD, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    over = (F.col("bytes") > limit) & (F.col("rows") > 1)
    cells, placed = [], []
    while True:
        celled = rows.withColumn("cell", F.substring("bits", 1, width))
        sizes = stored(celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
        large = sizes.filter(over).select("cell")
        if width == 2 * WORD or large.isEmpty():
            cells.append(sizes)
            placed.append(celled)
            break
        cells.append(sizes.filter(~over))
        placed.append(celled.join(large, "cell", "left_anti"))
        rows = celled.join(large, "cell", "left_semi").drop("cell")
        width = min(2 * WORD, width + ROUND_BITS)

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    directory = together(cells)
    prefixes = directory.withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("cell")))).withColumn(
        "bucket", F.substring("cell", F.lit(1), F.col("depth"))
    )
    split = prefixes.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).filter(over).select("bucket")
    depths = prefixes.join(split, "bucket", "left_semi").groupBy("cell").agg(F.count("*").alias("depth"))
    return (
        together(placed)
        .join(depths, "cell", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
            F.substring("bits", F.lit(1), F.coalesce("depth", F.lit(0)).cast("int")).alias("shard"),
            (F.col("n_bytes") > limit).alias("oversized"),
        )
    )


def write(df: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Parquet below path, one folder per shard. The id must be unique."""
    shards = assign(df, limit, id_col, text_col).select(F.col("doc_id").alias("__id"), F.concat(F.lit("b"), "shard").alias("shard"))
    df.join(shards, F.col(id_col) == F.col("__id")).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT), {WORD}, '0') AS bits
  FROM documents),
p AS (SELECT left(bits, d::INT) AS bucket, d FROM r, range(0, 40) t(d) GROUP BY ALL
      HAVING sum(n_bytes) > {LIMIT_BYTES} AND count(*) > 1),
q AS (SELECT r.doc_id, r.n_bytes, any_value(r.bits) AS bits, count(p.bucket)::INT AS depth
      FROM r LEFT JOIN p ON p.bucket = left(r.bits, p.d::INT) GROUP BY r.doc_id, r.n_bytes)
SELECT doc_id, n_bytes, depth, left(bits, depth) AS shard, n_bytes > {LIMIT_BYTES} AS oversized FROM q
"""
