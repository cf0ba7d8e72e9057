"""The N items of highest score within every group, by two-stage salted ranking.

Stage one hashes every hot group into subgroups, ranks within each and keeps N. The engine's window group limit applies the same
rank before the exchange, so each map task sends at most N items per subgroup and the shuffle does not grow with a group's size.
Stage two ranks the survivors of a group, at most N per subgroup, by score and identifier. A group of millions of rows is thus
spread over ``salts`` tasks and no task sees more than its share. Groups are counted by ``BUCKETS`` hashes; hot are those of a hash
with more than ``1 / HOT`` of all rows, of which there are fewer than ``HOT``. Other groups are one subgroup each, since every
further one would send N more rows per map task.

Copies of one item share their rank (``dense_rank``) and are folded after each stage. The subgroup hash mixes the identifier with
the input split, so that even an item copied into a third of all rows is spread; the result does not depend on the split.

An item that comes with several scores counts once, with its best. Such an item shows as two rows of the same identifier among a
group's N best; only groups where that happens are ranked again, after a fold to one row per item. The N best rows are written
to the shared folder once, so that this is known.

Defined results for edge cases: a null or NaN score is no score and the row cannot be kept; equal scores go by smaller identifier,
null identifiers last (they count as one item); a null group key is a group of its own; of copies that differ in other columns the
least by those columns, in their order, is kept; groups with fewer items come whole; empty input gives an empty result; a column
of the input already called like the rank makes the rank take the first free name with an underscore appended.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import InvalidOperation
from quillon.session import Workspace

_SALT = "__quillon_salt"
#: A group is hot with more than this share, 1 / HOT, of all rows.
HOT = 1000
BUCKETS = 4096


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _fold_copies(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per ``keys``; no exchange where ``df`` is already partitioned by some of them."""
    rest = [c for c in columns if c not in keys]
    if not rest:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    by = [c for c in rest if _orderable(df.schema[c].dataType)]
    held = F.struct(*[F.col(f"`{c}`") for c in rest])
    kept = F.min_by(held, F.struct(*[F.col(f"`{c}`") for c in by])) if by else F.first(held)
    return df.groupBy(*keys).agg(kept.alias("__held")).select(*keys, "__held.*")


def top_n(df: DataFrame, group: Sequence[str], score: str, row_id: str, n: int, *, ascending: bool = False, salts: int = 32, rank: str = "rank") -> DataFrame:
    """``df``'s rows among the ``n`` best of their group, each item once, with its place from 1 in column ``rank``."""
    if n < 1 or salts < 1:
        raise InvalidOperation("n and salts must be at least 1")
    while rank in df.columns:
        rank += "_"
    group, columns = list(group), df.columns
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = F.col(score).asc() if ascending else F.col(score).desc()
    order = [best, F.col(row_id).asc_nulls_last()]
    keys = [*group, row_id, score]

    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn(rank, F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)

    subgroup = F.lit(0)
    if salts > 1:
        bucket = F.pmod(F.xxhash64(*[F.col(g) for g in group]), F.lit(BUCKETS))
        counted = scored.groupBy(bucket.alias("bucket")).count().toArrow().to_pylist()  # a row per hash
        total = sum(r["count"] for r in counted)
        hot = [r["bucket"] for r in counted if r["count"] * HOT > total]
        subgroup = F.when(bucket.isin(hot), F.pmod(F.xxhash64(F.col(row_id), F.spark_partition_id()), F.lit(salts)).cast("int")).otherwise(0) if hot else subgroup
    salted = scored.withColumn(_SALT, subgroup)
    stage1 = _fold_copies(ranked(salted, [*group, _SALT]).drop(rank), [*keys, _SALT], columns).drop(_SALT)
    found = Workspace(df.sparkSession, "topn").write(_fold_copies(ranked(stage1, group), [*keys, rank], columns).select(*columns, rank), "best")
    twice = found.groupBy(*group, row_id).count().where("count > 1")
    again = twice.select(*[F.col(g).alias(f"__again{i}") for i, g in enumerate(group)]).distinct()
    if again.isEmpty():
        return found
    # Groups with an item of several scores among their best: one row per item, the best one, and the same ranking.
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"__again{i}")) for i, g in enumerate(group)])
    folded = _fold_copies(scored.join(again, same, "left_semi"), keys, columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    single = folded.groupBy(*group, row_id).agg((F.min_by if ascending else F.max_by)(whole, F.col(score)).alias("__best")).select("__best.*")
    return found.join(again, same, "left_anti").unionByName(ranked(single, group).select(*columns, rank))
