"""Mixing sources to target weights by hash thresholds.

Each document has a fixed place in its source's order: the first 60 bits of the MD5 of its id, as a number, then, for rows of one id or of none,
60 bits of the MD5 of its text, and in mix() a number of its own. A mix
takes every document a whole number of times and, once more, those below a threshold. So budgets nest: a
larger budget keeps every document that a smaller one takes. The threshold is found without sorting rows: words are
summed by source and the next 12 bits of the hash (4,096 buckets), the bucket in which the budget
ends is found from running sums over these buckets, and only that bucket is split further, until one hash is left in it.

Rules: a size is the number of words; null text counts 0. Sources order by code point, null last, and weigh
3, 1, 2 in turn. They share 150 % of all words; a target stops at twice its source's words, and what is cut
off is shared by weight among the others. The document at the boundary is taken if that brings the sum nearer
to the target. Rows with one id, or with none, are told apart by their texts; mix() tells rows apart that are alike in both, mixed() takes these
together. A source without words gets target 0; an empty table gives no rows. Only id, text and source are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, WORD, attach, hash60, keep, small

BITS, STEP = 60, 12  #: of a hash, and those a round resolves


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: str) -> DataFrame:
    """(id, size, source key, hashes of id and text) of each row, and more of its columns. A key starts with = (a name) or ~ (null), so null is last."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("key"),
        hash60(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
        hash60(F.coalesce(F.col(text_col), F.lit(""))).alias("h2"),
        *more,
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size, source_rows, target): one row per source.

    With sources in the order in which they reach their caps as the level rises, the level is the
    first that the next source's cap does not stop. Windows run over sources, not rows.
    """
    by_key = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    rest = Window.orderBy("full_at", "key")
    before = rest.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        by_key.withColumn("w", w)
        .withColumn("top", F.col("source_size") * F.lit(cap))
        .withColumn("full_at", F.col("top") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("open", F.col("left") <= F.col("full_at") * F.col("w_left"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("full_at", "key", "left", "w_left"))).over(every))
    )
    level = F.col("w") * F.col("first.left") / F.col("first.w_left")
    capped = F.col("first").isNull() | (F.struct("full_at", "key") < F.struct("first.full_at", "first.key"))
    return rows.select("key", "source_size", "source_rows", F.when(capped, F.col("top")).otherwise(level).alias("target"))


def _met(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows joined to n rows of sources (key, source_rows); a source of a third of all rows stays spread however many sources there are."""
    return rows.join(small(plan, n), "key") if n <= BROADCAST_ROWS else attach(rows, plan, "key", "source_rows")


def thresholds(rows: DataFrame, budgets: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """budgets: key, source_rows, need (words below the source's sum). Adds tau (a struct of the places) and inclusive: a row is in if its
    places are below tau, or are tau and inclusive holds. Sources that need nothing get no threshold.

    places: hashes of 60 bits in order of weight; the next one is only looked at where several rows agree in those before.
    """
    n = budgets.count()
    state = budgets.where("need > 0").select("key", "source_rows", "need", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("prefix"), F.array().cast("array<bigint>").alias("fixed"))
    ended = None
    for depth, place in enumerate(places):
        for left in range(BITS - STEP, -STEP, -STEP):
            bucket = F.shiftright(place, left)
            same = [F.col(c) == F.element_at("fixed", i + 1) for i, c in enumerate(places[:depth])]
            in_prefix = _met(rows, state, n).where(reduce(lambda a, x: a & x, same, F.shiftright(bucket, STEP) == F.col("prefix")))
            hist = in_prefix.groupBy("key", "source_rows", "need", "below", "fixed", bucket.alias("bucket")).agg(
                F.sum("size").alias("words"), F.struct(*[F.min(c).alias(c) for c in places]).alias("lo"), F.struct(*[F.max(c).alias(c) for c in places]).alias("hi")
            )
            run = Window.partitionBy("key").orderBy("bucket")  # over at most 4,096 buckets a source
            hist = hist.withColumn("upto", F.col("below") + F.sum("words").over(run)).withColumn("below", F.col("upto") - F.col("words"))
            # The sums rise, so the bucket that the budget ends in is the one of a source that holds it.
            edge = keep(hist.where((F.col("upto") > F.col("need")) & (F.col("below") <= F.col("need"))).drop("words"), "mix-edge")
            over, under = F.col("upto") - F.col("need"), F.col("need") - F.col("below")
            done = edge.where("lo = hi").select("key", F.col("lo").alias("tau"), (over < under).alias("inclusive"))
            ended = done if ended is None else ended.unionByName(done)
            state = edge.where("lo <> hi").select("key", "source_rows", "need", "below", F.col("bucket").alias("prefix"), "fixed")
            if state.isEmpty():
                return ended
        # A bucket is one hash by now: the rows that share it are told apart by the next place. Rows alike in all places are taken together.
        alike = edge.where("lo <> hi") if depth + 1 < len(places) else edge.limit(0)
        state = alike.select("key", "source_rows", "need", "below", F.lit(0).cast("bigint").alias("prefix"), F.concat("fixed", F.array(F.col(f"lo.{place}"))).alias("fixed"))
    return ended


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """id_col, size, source_size, target, copies (times the mix takes the row), taken (words)."""
    rows = keep(sizes(docs, id_col, text_col, source_col).withColumn("node", F.monotonically_increasing_id()), "mix-sizes")
    places = ("h", "h2", "node")
    out = _copied(rows, _plan(rows, weights, share, cap, places), places)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, places: tuple[str, ...]) -> DataFrame:
    """rows: sizes(), written. What decides on each source's rows: key, source_size, source_rows, target, whole, tau, inclusive."""
    plan = targets(rows, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int"))
    plan = keep(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    return plan.join(thresholds(rows, plan.select("key", "source_rows", "need"), places), "key", "left")


def _below(places: tuple[str, ...]) -> Column:
    """A row's places lie below tau, or are tau and inclusive holds."""
    first, rest = places[0], places[1:]
    tau = F.col(f"tau.{first}")
    return (F.col(first) < tau) | ((F.col(first) == tau) & (_below(rest) if rest else F.col("inclusive")))


def _copied(rows: DataFrame, plan: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """rows (with key and places) with the plan's columns and copies."""
    plan = keep(plan, "mix-taken")
    more = _below(places)
    return _met(rows, plan, plan.count()).withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with each row as often as the mix takes it; columns unchanged. Copies are decided on and made row by row."""
    places = ("h", "h2")
    plan = _plan(keep(sizes(docs, id_col, text_col, source_col), "mix-sizes"), weights, share, cap, places)
    rows = sizes(docs.select("*", F.struct("*").alias("__row")), id_col, text_col, source_col, "__row")
    return _copied(rows, plan, places).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
