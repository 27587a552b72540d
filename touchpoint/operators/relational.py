"""Relational building blocks with exact SQL null semantics, shaped for scale.

Design rules used throughout:

* top-1 per group is an aggregate (``min``/``max`` of a struct whose leading
  fields are the sort keys), not a window: the aggregate combines map-side, so a
  group holding a third of all rows never lands whole in one task;
* rows whose join key is NULL can never match an equi-join; they get a salt
  column (1..NULL_SPREAD, from a hash of the row and its input partition, so it is
  the same on a task retry) while every other row and the other side get 0, and
  the join runs on (key, salt): NULL-key rows spread over many tasks instead of
  all hashing to one partition, and the input is read once;
* one-row global aggregates are attached as scalar subqueries (run once, inlined
  as a literal), never through a single-partition window or a cross join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def top1_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """First row per ``keys`` ordered by ``order`` then ``payload`` (all in one
    direction). Ascending puts NULL first, descending puts NULL last (SQL defaults).

    Deterministic: remaining columns break ties, so equal sort keys give the same
    answer on every run.
    """
    fields = list(order) + [c for c in payload if c not in order]
    packed = F.struct(*[F.col(c) for c in fields])
    agg = F.max(packed) if descending else F.min(packed)
    return df.groupBy(*keys).agg(agg.alias("_top")).select(
        *keys, *[F.col("_top")[c].alias(c) for c in fields]
    )


NULL_SPREAD = 1024
#: Tasks over which the rows of a hot key are spread.
HOT_SPREAD = 64
#: A value of more than this share of the rows is hot. Its sketch tracks so many values
#: that the error (3.5 over the size of its table) is far below the share.
HOT_SHARE, TRACKED_VALUES = 0.01, 10_000


def frequent_values(df: DataFrame, col: str, share: float = HOT_SHARE) -> Column:
    """The values that hold more than ``share`` of the non-NULL rows, as an array: a scalar
    subquery over a frequent-items sketch. Tasks send sketches of bounded size, never
    values in proportion to the data. Each such value is in it; one just below the share
    may be."""
    known = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v"))
    top = F.expr(f"approx_top_k(v, {math.ceil(1.3 / share)}, {TRACKED_VALUES})")
    sketch = known.agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    often = F.filter("top", lambda t: t["count"] > F.col("n") * share)
    return sketch.select(F.transform(often, lambda t: t["item"]).alias("values")).scalar()


def _has_map(t: T.DataType) -> bool:
    """Map values cannot be hashed; such columns are left out of the salt hash."""
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return False


def _null_salt(df: DataFrame, null_cond: Column, offset: int = 0) -> Column:
    """0 for rows with a usable key; 1+offset .. NULL_SPREAD+offset for NULL keys."""
    salt = F.pmod(_row_hash(df), F.lit(NULL_SPREAD)).cast("int") + (1 + offset)
    return F.when(null_cond, salt).otherwise(F.lit(0))


def _row_hash(df: DataFrame) -> Column:
    hashable = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*[F.col(c) for c in hashable], F.spark_partition_id())


def left_join_split_nulls(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    hot: Column | None = None,
) -> DataFrame:
    """``left LEFT JOIN right ON l.k = r.k`` (plain ``=``). NULL-key rows of the
    left are salted so they do not all land in one task; they get NULL right-hand
    columns. So are left rows whose first key is in the array ``hot``; the right's rows of
    those keys are repeated for each of the HOT_SPREAD salts. Output: the left columns
    plus the right's non-key columns."""
    right_keys = list(right_keys or left_keys)
    tmp = [f"_rk{i}" for i in range(len(right_keys))]
    renames = dict(zip(right_keys, tmp))
    salt, r_salt = _null_salt(left, _any_null(left_keys)), F.lit(0)
    if hot is not None:
        spread = F.pmod(_row_hash(left), F.lit(HOT_SPREAD)).cast("int")
        salt = F.when(~_any_null(left_keys) & F.array_contains(hot, F.col(left_keys[0])), spread).otherwise(salt)
        salts = F.when(F.array_contains(hot, F.col(right_keys[0])), F.sequence(F.lit(0), F.lit(HOT_SPREAD - 1)))
        r_salt = F.explode(salts.otherwise(F.array(F.lit(0))))
    r = right.where(~_any_null(right_keys)).select(
        *[F.col(c).alias(renames.get(c, c)) for c in right.columns], r_salt.alias("_rsalt")
    )
    l = left.withColumn("_salt", salt)
    cond = reduce(
        lambda a, b: a & b,
        [F.col(lk) == F.col(t) for lk, t in zip(left_keys, tmp)],
    ) & (F.col("_salt") == F.col("_rsalt"))
    return l.join(r, cond, "left").drop(*tmp, "_salt", "_rsalt")


def exclude_existing(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """``NOT EXISTS (SELECT 1 FROM existing e WHERE n.k1 = e.k1 AND ...)`` with plain
    ``=``: a row with a NULL in any key never matches, so it is always kept (and is
    salted so such rows spread over many tasks). ``null_safe`` lets NULL equal NULL."""
    keys = list(keys)
    if null_safe:
        r = existing.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)]).distinct()
        cond = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)],
        )
        return new.join(r, cond, "left_anti")
    l = new.withColumn("_salt", _null_salt(new, _any_null(keys)))
    r = existing.where(~_any_null(keys)).select(*keys).distinct().withColumn("_salt", F.lit(0))
    return l.join(r, keys + ["_salt"], "left_anti").drop("_salt")


def not_in(
    outer: DataFrame, outer_key: str, sub: DataFrame, sub_key: str
) -> DataFrame:
    """``outer WHERE outer_key NOT IN (SELECT sub_key FROM sub)`` with SQL's
    null-aware semantics, without the broadcast-only null-aware anti join:

    * sub empty -> every outer row, NULL keys included;
    * sub holds a NULL -> no row;
    * otherwise -> rows whose key is not NULL and not in sub (shuffled anti join).
    """
    keys = sub.select(F.col(sub_key).alias("_k"))
    n_total = keys.select(F.count(F.lit(1))).scalar()
    n_keys = keys.select(F.count("_k")).scalar()
    anti = outer.join(keys.where(F.col("_k").isNotNull()).distinct(),
                      outer[outer_key] == F.col("_k"), "left_anti")
    keep = (n_total == 0) | ((n_total == n_keys) & F.col(outer_key).isNotNull())
    return anti.where(keep)


def with_total_count(df: DataFrame, name: str = "total_count") -> DataFrame:
    """Every row plus the row count of ``df`` (``COUNT(*) OVER ()``), computed as a
    scalar subquery instead of a single-partition window."""
    return df.withColumn(name, df.select(F.count(F.lit(1))).scalar())


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def any_of(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct non-NULL keys present in any input (replaces a chain of
    ``FULL OUTER JOIN ... COALESCE(k1, k2, k3)``). Each branch is de-duplicated
    map-side before the one shuffle."""
    parts = [d.select(F.col(key)).where(F.col(key).isNotNull()) for d in dfs]
    return union_all(parts).distinct()


def full_outer_coalesce(
    left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]
) -> DataFrame:
    """``SELECT COALESCE(l.c, r.c) ... FROM l FULL OUTER JOIN r ON l.key = r.key``.

    NULL-key rows of either side cannot match; they are salted (disjoint salt
    ranges per side) so they spread over many tasks.
    """
    l = left.select(*cols)
    r = right.select(*cols)
    l = l.withColumn("_salt", _null_salt(l, F.col(key).isNull())).alias("l")
    r = r.withColumn("_salt", _null_salt(r, F.col(key).isNull(), NULL_SPREAD)).alias("r")
    cond = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._salt") == F.col("r._salt"))
    return l.join(r, cond, "full").select(
        *[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in cols]
    )
