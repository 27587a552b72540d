"""Sharding along a Hilbert curve (op5).

Several metadata dimensions are quantised to ``2**bits`` cells each, at quantiles, so
that cells hold like numbers of rows and keep the order of the values; a cell's place on
the Hilbert curve orders the rows, and the order is cut into runs. Rows that are near in
all dimensions land in the same run, so a file's minimum and maximum are narrow in each
dimension and filters on any of them skip most files.

Texts (source, language) are coded by their rank among all distinct values, as wholes, so
values with a long common beginning are told apart like any others.

The law is ``rows``: run s of n holds the ranks r with floor(r * n / rows) = s, so counts
are at most one apart. Ranks are exact and need no global sort: rows are counted by cell,
the counts are summed along the curve, and rows are numbered inside their cell. A cell
with many rows (a source with a third of the corpus, one text a million times) is split
into buckets by the hash of the row, each numbered on its own; rows that are repeated very
often are spread over the buckets of their cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchpoint.llm.stages import small_batches, text_or_empty, written
from touchpoint.operators.relational import frequent_values

SHARDS = 40
BITS = 6
#: Rows numbered by one task at a time, about.
BUCKET_ROWS = 50_000


#: Share of all rows from which equal rows are spread over buckets.
REPEATED_SHARE = 0.001
#: Distinct values up to which their ranks are broadcast; rows of one file of a shard.
BROADCAST_VALUES, FILE_ROWS = 100_000, 500_000


def ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): the dense rank of every distinct value, whole. Values are dealt by
    range and numbered in their part, so none of this is one task."""
    dealt = rows.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().repartitionByRange("value")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "values")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    numbered = dealt.withColumn("place", place).join(starts, "part")
    return written(numbered.select("value", (F.col("start") + F.col("place")).cast("long").alias("code")), "ranks")


def with_code(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_code``: the rank of the value, 0 for null."""
    found = ranks(rows, column)
    few = found.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    named = found.select(F.col("value").alias(column), F.col("code").alias(f"{column}_code"))
    joined = rows.join(F.broadcast(named) if few else named, column, "left")
    return joined.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(0)))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, each below 2**bits)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotation of every level
        top = 1 << level
        low = top - 1
        for k in range(n):
            set_ = (x[k] & top) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, n):  # binary reflected code
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | (((x[k] ^ flip) >> level) & 1)
    return out


def quantiles(df: DataFrame, dimensions: list[str], bits: int) -> list[np.ndarray]:
    """Ascending cell borders of each dimension: 2**bits - 1 numbers. A frequent value fills
    several, so few values still spread over all cells, and steer the curve's large turns."""
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(d, cuts, 1000).alias(d) for d in dimensions]).first()
    return [np.sort(np.array(row[d] or [], np.int64)) for d in dimensions]


def with_curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``, the place of each row's cell. ``dimensions`` are long columns."""
    small_batches(df.sparkSession)
    borders = quantiles(df, dimensions, bits)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [np.searchsorted(edge, b.column(d).to_numpy(zero_copy_only=False), "left") for d, edge in zip(dimensions, borders, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_index(np.stack(cells, 1), bits))], [*names, "curve"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", curve long")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve.

    Dimensions: source, lang and size. Every row is placed, repeated rows too; a null
    source or lang sorts first, a null text has size 16 and the checksum of no bytes.
    Equal rows are interchangeable; ties on the curve go by the hash of the row. An empty
    table gives no rows. Other columns are ignored.
    """
    text = text_or_empty().cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )
    rows = with_code(with_code(written(rows, "shard-rows"), "source"), "lang").drop("source", "lang")
    key = F.xxhash64("doc_id", "text_crc32", "size")
    placed = with_curve(written(rows, "coded-rows"), ["source_code", "lang_code", "size"], bits)
    placed = written(placed.select("doc_id", "size", "text_crc32", "curve", key.alias("key"), F.monotonically_increasing_id().alias("row")), "curve")

    cells = placed.groupBy("curve").agg(F.count("*").alias("n"))
    spread = cells.select("curve", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("buckets"))
    often = F.array_contains(frequent_values(placed, "key", REPEATED_SHARE), F.col("key"))
    mixed = F.when(often, F.xxhash64("row")).otherwise(F.col("key"))
    hashed = placed.join(spread, "curve").withColumn("bucket", F.pmod(mixed, F.col("buckets")).cast("int")).drop("buckets", "key", "row")
    counted = hashed.groupBy("curve", "bucket").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("curve").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**(bits * dimensions) cells, whatever the input
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    before_cell = cells.select("curve", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"))
    before = counted.withColumn("bucket_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before_cell, "curve")
    offsets = before.select("curve", "bucket", (F.col("cell_start") + F.col("bucket_start")).alias("start"))
    order = Window.partitionBy("curve", "bucket").orderBy("doc_id", "text_crc32", "size")
    n = placed.count()
    ranked = hashed.withColumn("k", F.row_number().over(order) - 1).join(offsets, ["curve", "bucket"]).withColumn("rank", F.col("start") + F.col("k"))
    cut = ranked.withColumn("shard", F.expr(f"CAST(rank * {shards}L DIV {n}L AS INT)"))
    # the first rank of shard s is the least r with r * shards >= s * n
    first = F.expr(f"(shard * {n}L + {shards - 1}L) DIV {shards}L")
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, file_rows: int = FILE_ROWS) -> None:
    """Writes ``docs`` with their shard, one folder per shard, in files of ``file_rows`` rows
    along the curve, each written by a task of its own. Rows meet their place by doc_id and
    text checksum."""
    key = ["doc_id", "text_crc32"]
    places = shard(docs, shards, bits).select(*key, "shard", "slot", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")).alias("copy"))
    own = docs.withColumn("text_crc32", F.crc32(text_or_empty().cast("binary")))
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    same = own["doc_id"].eqNullSafe(places["doc_id"]) & (own["text_crc32"] == places["text_crc32"]) & (own["copy"] == places["copy"])
    placed = own.join(places, same).select(*[own[f"`{c}`"] for c in docs.columns], places["shard"], places["slot"])
    piece = F.floor(F.col("slot") / file_rows)
    placed.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
