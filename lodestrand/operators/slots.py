"""Order-dependent operators that never sort a key in one task.

Rows are ordered inside (key, time slot); what the next slot needs of the one before is
carried by one row a slot. A key with a third of all rows is as many tasks as it has slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def with_previous(df: DataFrame, keys: list[str], us: str, tie: str, value: str, slot_us: int = HOUR) -> DataFrame:
    """``df`` with ``previous``: the value of the row before in the order (us, tie) of its key; null for the first.

    Rows without time are left out. ``has_previous`` tells a first row from a null value.
    """
    d = df.where(F.col(us).isNotNull()).withColumn("_slot", F.floor(F.col(us) / slot_us))
    inside = Window.partitionBy(*keys, "_slot").orderBy(us, tie)
    d = d.withColumn("_r", F.row_number().over(inside)).withColumn("_p", F.lag(value).over(inside))
    last = d.groupBy(*keys, "_slot").agg(F.max(F.struct(us, tie, F.col(value).alias("v")))["v"].alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_slot")  # one row a slot
    last = last.select(*keys, "_slot", F.lag("_last").over(over).alias("_carry"), (F.row_number().over(over) > 1).alias("_some"))
    k = [*keys, "_slot"]
    j = d.join(last.select(*[F.col(c).alias(f"{c}_k") for c in k], "_carry", "_some"), [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in k])
    first = F.col("_r") == 1
    out = j.withColumn("previous", F.when(first, F.col("_carry")).otherwise(F.col("_p"))).withColumn("has_previous", ~first | F.col("_some"))
    return out.select(*df.columns, "previous", "has_previous")


def changed_rows(df: DataFrame, keys: list[str], us: str, tie: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before of their key, and each key's first."""
    p = with_previous(df, keys, us, tie, value)
    return p.where(~F.col("has_previous") | ~F.col(value).eqNullSafe(F.col("previous"))).drop("previous", "has_previous")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, slot: float) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row of its key at or before ``left_at``; null where there is none.

    Both sides are ordered together inside (key, slot) and each slot hands its last value on, so
    no pairs are formed and no key is one task. ``right`` should hold one row a key and time.
    Null keys or times on the left keep their row with a null value.
    """
    rest = F.struct(*left.columns)
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), rest.alias("_row"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b).withColumn("_slot", F.floor(F.col("_at") / slot))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = both.where("_kind = 0 and _v is not null").groupBy(*keys, "_slot").agg(F.max_by("_v", "_at").alias("_end"))
    every = both.where("_kind = 1").select(*keys, "_slot").distinct().join(ends, [*keys, "_slot"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    carry = every.select(*keys, "_slot", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    k = [*keys, "_slot"]
    out = both.where("_kind = 1").join(carry.select(*[F.col(c).alias(f"{c}_k") for c in k], "_carry"), [F.col(c) == F.col(f"{c}_k") for c in k], "left")
    return out.select("_row.*", F.coalesce("_in", "_carry").alias(value))
