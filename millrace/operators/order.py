"""Ranks, running sums, neighbours, carried values and order statistics over a table or a hot group, without gathering it in one task.

The input is written once and counted. A table of more than ROWS rows is then dealt out by ranges of (group, key, ties) and written with
each row's range, its block: blocks follow one another in that order, so a group of all rows, or one key value of all rows, is spread
over many. Windows run inside a block; what comes before (or after) a block is carried from a table with a row a group and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.store import measured, written

ROWS = 250_000  #: of a block
FEW = 100_000  #: rows that may be broadcast
WIDE = 100  #: bytes of a wide row in a file
LARGE = 16 << 20  #: bytes of a table of wide rows whose order is found apart from them


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= FEW else df


def blocks(df: DataFrame, group: tuple[str, ...], by: tuple[str, ...], rows: int = ROWS, kept: bool = False) -> tuple[DataFrame, int]:
    """(df written (kept: it is already), with __block, and how many blocks there are). Rows of one group and block follow one another in order of `by`."""
    df = df if kept else written(df, "order-rows")
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df.withColumn("__block", F.lit(0)), 1
    return written(df.repartitionByRange(parts, *group, *by).withColumn("__block", F.spark_partition_id()), "order-blocks"), parts


def apart(df: DataFrame, needed: list[str], out: str, ordered: Callable[[DataFrame, bool], DataFrame], large: int | None = None) -> DataFrame:
    """ordered(df, whether it is written already), which adds out and reads the columns needed. A large table of wide rows (texts, arrays) is written with a number a row; only
    numbers and the columns needed are put in order, and out comes back by the number, so no task gets a block of wide rows."""
    if not set(df.columns) - set(needed):
        return ordered(df, False)
    rows, size = measured(df.withColumn("__row", F.monotonically_increasing_id()), "order-wide")
    if size <= (LARGE if large is None else large) or size <= WIDE * rows.count():
        return ordered(rows, True).drop("__row")
    found = ordered(rows.select("__row", *dict.fromkeys(needed)), True).select("__row", out)
    return rows.join(found, "__row").drop("__row")


def carried(df: DataFrame, table: DataFrame, group: tuple[str, ...], parts: int) -> DataFrame:
    """df with the columns of table (a row a group and __block, where there is something to carry) at its group and block."""
    names = [*group, "__block"]
    table = table.select(*[F.col(c).alias(f"__on_{c}") for c in names], *[c for c in table.columns if c not in names])
    few = F.broadcast(table) if parts <= FEW else table
    on = [F.col(f"__on_{c}").eqNullSafe(F.col(c)) for c in names]
    return df.join(few, on, "left").drop(*[f"__on_{c}" for c in names])


def spanning(df: DataFrame, group: tuple[str, ...], parts: int) -> tuple[DataFrame, Window]:
    """What blocks() gave, cut down to groups of several blocks (fewer rows of (group, block) than twice the blocks), and the order of a group's blocks."""
    order = Window.partitionBy(*group).orderBy("__block")
    if not group:
        return df, order
    several = df.groupBy(*group).agg(F.min("__block").alias("__a"), F.max("__block").alias("__b")).where("__a < __b")
    named = several.select(*[F.col(c).alias(f"__on_{c}") for c in group])  # fewer than blocks
    return df.join(F.broadcast(named) if parts <= FEW else named, [F.col(f"__on_{c}").eqNullSafe(F.col(c)) for c in group], "left_semi"), order


BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)


def running(df: DataFrame, key: str, out: str, value: Column | None = None, group: tuple[str, ...] = (), ties: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Adds out: the sum of value (1 if None, so a rank from 1) over the rows of the group up to this
    one in order of key, then ties. (key, ties) must tell rows apart, or those alike must be interchangeable."""
    value = F.lit(1).cast("bigint") if value is None else value
    return apart(df.withColumn("__v", value), [*group, key, *ties, "__v"], out, lambda own, kept: _running(own, kept, key, out, group, ties, rows)).select([*df.columns, out])


def _running(df: DataFrame, kept: bool, key: str, out: str, group: tuple[str, ...], ties: tuple[str, ...], rows: int) -> DataFrame:
    columns = [*df.columns, out]
    df, parts = blocks(df, group, (key, *ties), rows, kept)
    inside = Window.partitionBy(*group, "__block").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__in", F.sum("__v").over(inside))
    if parts == 1:
        return summed.withColumn(out, F.col("__in")).select(columns)
    own, order = spanning(df, group, parts)
    table = own.groupBy(*group, "__block").agg(F.sum("__v").alias("__s")).withColumn("__before", F.sum("__s").over(order.rowsBetween(*BEFORE))).drop("__s")
    return carried(summed, table, group, parts).withColumn(out, F.col("__in") + F.coalesce("__before", F.lit(0))).select(columns)


def neighbour(df: DataFrame, value: str, out: str, group: tuple[str, ...], by: tuple[str, ...], ahead: bool = False, rows: int = ROWS) -> DataFrame:
    """Adds out: the value of the group's row before (or after) in order of `by`, null for the first (last) one."""
    return apart(df, [*group, *by, value], out, lambda own, kept: _neighbour(own, kept, value, out, group, by, ahead, rows)).select([*df.columns, out])


def _neighbour(df: DataFrame, kept: bool, value: str, out: str, group: tuple[str, ...], by: tuple[str, ...], ahead: bool, rows: int) -> DataFrame:
    columns = [*df.columns, out]
    df, parts = blocks(df, group, by, rows, kept)
    inside = Window.partitionBy(*group, "__block").orderBy(*by)
    step = F.lead if ahead else F.lag
    near = df.withColumn("__edge", step(F.lit(1)).over(inside).isNull()).withColumn("__near", step(value).over(inside))
    if parts == 1:
        return near.withColumn(out, F.col("__near")).select(columns)
    own, order = spanning(df, group, parts)
    pick = F.min_by if ahead else F.max_by
    table = own.groupBy(*group, "__block").agg(pick(F.struct(F.col(value).alias("v")), F.struct(*by)).alias("__e"))
    table = table.withColumn("__far", step(F.col("__e.v")).over(order)).drop("__e")
    return carried(near, table, group, parts).withColumn(out, F.when(F.col("__edge"), F.col("__far")).otherwise(F.col("__near"))).select(columns)


def ranks_by(df: DataFrame, group: tuple[str, ...], value: Column, places: dict[str, Callable[[Column], Column]], rows: int = ROWS) -> DataFrame:
    """(group, n, a column a place): exact order statistics of every group at once, nulls left out.

    places: from the number of a group's values n, the place wanted, from 0. Equal values of a group are counted before they move; the counts
    are summed up in order of value, block by block, and the value at a place is the least whose sum passes it. So no task
    gets a group's values, however many it has.
    """
    counts = df.select(*group, value.alias("__x")).where(F.col("__x").isNotNull()).groupBy(*group, "__x").agg(F.count("*").alias("__c"))
    upto = written(running(counts, "__x", "__upto", F.col("__c"), group, rows=rows), "order-ranks")
    sizes = written(upto.groupBy(*group).agg(F.max("__upto").alias("n")), "order-sizes")
    named = sizes.select(*[F.col(c).alias(f"__on_{c}") for c in group], "n")
    on = [F.col(f"__on_{c}").eqNullSafe(F.col(c)) for c in group]
    both = upto.join(F.broadcast(named) if named.count() <= FEW else named, on) if group else upto.crossJoin(F.broadcast(named))  # one row
    picks = [F.min(F.when(F.col("__upto") > place(F.col("n")), F.col("__x"))).alias(name) for name, place in places.items()]
    return both.groupBy(*group).agg(F.max("n").alias("n"), *picks)


def indexed(df: DataFrame, key: str, out: str = "idx", group: tuple[str, ...] = (), ties: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Adds out: each row's place from 0, in the table or its group."""
    return running(df, key, out, None, group, ties, rows).withColumn(out, F.col(out) - 1)


def hash_key(seed: int, *cols: str) -> Column:
    """A number of 60 bits that orders rows at random, alike in each run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def quantiles(df: DataFrame, value: Column, shares: list[float], most: int = 1_000_000, cells: int = 4096) -> list[float | None]:
    """Exact quantiles (linear between neighbours) of the values that aren't null; nulls for an empty table.

    A table of more than `most` values is cut into equal cells between its bounds; the cells that hold the ranks asked for are cut
    again until they hold one value. Each round is a count by cell, combined on the map side; no task gets the values.
    """
    x = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n <= most:
        found = x.agg(F.percentile("x", F.array(*map(F.lit, map(float, shares))))).first()[0]
        return list(found) if found is not None else [None] * len(shares)
    at = [(n - 1) * s for s in shares]
    known: dict[int, float] = {}
    todo = {(low, high): (0, sorted({r for a in at for r in (math.floor(a), math.ceil(a))}))}  # bounds: rows below, ranks
    while todo:
        fresh = {}
        for (low, high), (below, ranks) in todo.items():
            inside = x.where(F.col("x").between(low, high))
            cell = F.least(F.floor((F.col("x") - low) / ((high - low) or 1.0) * cells), F.lit(cells - 1))
            counts = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("c").collect()  # `cells` rows
            for c in counts:
                own = [r for r in ranks if below <= r < below + c["n"]]
                if c["low"] == c["high"]:
                    known |= dict.fromkeys(own, c["low"])
                elif own:
                    fresh[c["low"], c["high"]] = (below, own)
                below += c["n"]
        todo = fresh
    return [known[math.floor(a)] + (known[math.ceil(a)] - known[math.floor(a)]) * (a - math.floor(a)) for a in at]
