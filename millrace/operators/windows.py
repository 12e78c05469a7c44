"""Orders, budgets, schedules, spans and splits (W)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from millrace.operators.order import BEFORE, ROWS, blocks, carried, indexed, neighbour, running, spanning

PHI = 0.61803398875


def dedup_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key, by order. A grouped minimum, so a hot key combines on the map side."""
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(key.alias("__key")).agg(F.min(F.struct(*order)).alias("__o"), F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select("__o.*", "__r.*").select(df.columns)


def interleave(df: DataFrame, group: str, key: str, *ties: str, limit: int | None = None) -> DataFrame:
    """Adds turn (a row's place in its group, from 0) and group_rank (groups by name), which order the rows
    round-robin; with a limit the first so many rows, for which no group needs more than that many."""
    groups = df.select(group).distinct().withColumn("group_rank", F.row_number().over(Window.orderBy(group)))
    if limit is None:
        ranked = indexed(df, key, "turn", (group,), ties)
        return ranked.join(F.broadcast(groups) if groups.count() <= 100_000 else groups, group)
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key, *ties))).where(F.col("turn") <= limit)  # a limit by group before the shuffle, too
    return ranked.withColumn("turn", F.col("turn") - 1).join(groups, group).orderBy("turn", "group_rank").limit(limit)


def head_per_group(df: DataFrame, group: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each group; the limit holds before the shuffle, too."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def prefix_within(df: DataFrame, group: str, key: str, size: Column, quota: float, *ties: str) -> DataFrame:
    """Rows of each group in order until the first that would pass the quota."""
    return running(df, key, "__sum", size.cast("bigint"), (group,), ties).where(F.col("__sum") <= quota).drop("__sum")


def prefix_until(df: DataFrame, group: str, key: str, size: Column, quota: float, total: float, *ties: str) -> DataFrame:
    """Rows of each group until its sum reaches the quota, and of all groups (by name) until the total is reached; the row that
    reaches a bound is taken."""
    df = df.withColumn("__size", size.cast("bigint"))
    own = running(df, key, "__sum", F.col("__size"), (group,), ties).where(F.col("__sum") - F.col("__size") < quota)
    sums = own.groupBy(group).agg(F.sum("__size").alias("__g"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__g").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__g")
    return own.join(before, group).where(F.col("__before") + F.col("__sum") - F.col("__size") < total).drop("__size", "__sum", "__before")


def punctuate(words: Column, add_ms: float = 300.0) -> Column:
    """Text of array<struct(word, start, end)>: a comma where the gap to the next word is long, no other."""
    def one(w: Column, i: Column) -> Column:
        gap = (F.element_at(words, F.least(i + 2, F.size(words)))["start"] - w["end"]) * 1000
        bare = F.regexp_replace(F.trim(w["word"]), ",+$", "")
        return F.concat(bare, F.when((i + 1 < F.size(words)) & (gap >= add_ms), ",").otherwise(""))

    return F.trim(F.regexp_replace(F.array_join(F.transform(words, one), " "), r"\s+", " "))


BOUNDS = "struct<first:int,last:int,start:double,end:double>"


def _bounds(first: Column, last: Column, start: Column, end: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), start.cast("double").alias("start"), end.cast("double").alias("end"))


def _ended(acc: Column) -> Column:
    return F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))


def _greedy(words: Column, min_s: float, max_s: float, gap_s: float) -> Column:
    """array<struct(first, last, start, end)>: the greedy segments' first and last words, by place from 0.

    The fold holds the open segment's bounds; the list of segments grows once a segment, not once a word.
    """
    open_, none, nothing = _bounds, F.lit(None).cast(BOUNDS), F.array().cast(f"array<{BOUNDS}>")

    def add(acc: Column, w: Column) -> Column:
        now, place = acc["now"], acc["place"]
        close = ((w["start"] - now["end"] >= gap_s) & (now["end"] - now["start"] >= min_s)) | (w["end"] - now["start"] > max_s)
        fresh, grown = open_(place, place, w["start"], w["end"]), open_(now["first"], place, now["start"], w["end"])
        done = F.when(now.isNotNull() & close, F.array_append(acc["done"], now)).otherwise(acc["done"])
        return F.struct(F.when(now.isNull() | close, fresh).otherwise(grown).alias("now"), (place + 1).cast("int").alias("place"), done.alias("done"))

    return F.aggregate(words, F.struct(none.alias("now"), F.lit(0).alias("place"), nothing.alias("done")), add, _ended)


def _cut_words(words: Column, min_s: float, max_s: float, gap_s: float) -> Column:
    """The greedy segments, short ones joined to the one before."""

    def merge(acc: Column, s: Column) -> Column:
        now = acc["now"]
        short = now.isNotNull() & (s["end"] - s["start"] < min_s)
        done = F.when(now.isNull() | short, acc["done"]).otherwise(F.array_append(acc["done"], now))
        return F.struct(F.when(short, _bounds(now["first"], s["last"], now["start"], s["end"])).otherwise(s).alias("now"), done.alias("done"))

    none, nothing = F.lit(None).cast(BOUNDS), F.array().cast(f"array<{BOUNDS}>")
    return F.aggregate(_greedy(words, min_s, max_s, gap_s), F.struct(none.alias("now"), nothing.alias("done")), merge, _ended)


def segment_by_words(words: Column, min_s: float = 3.0, max_s: float = 15.0, gap_s: float = 0.3) -> Column:
    """array<struct(start, end, text)> of a sorted array<struct(start, end, word)>.

    A segment closes before a word that follows a gap, if it is long enough already, or that would make it
    too long. Then a segment that is too short joins the one before it; words are never lost.
    """
    said = lambda s: F.array_join(F.transform(F.slice(words, s["first"] + 1, s["last"] - s["first"] + 1), lambda w: w["word"]), " ")
    return F.transform(_cut_words(words, min_s, max_s, gap_s), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), said(s).alias("text")))


def split_long_segment(segment: Column, words: Column, max_s: float) -> Column:
    """A segment's pieces: cut at words by the cap alone; in equal slices if that gives one piece; a segment of
    fewer than two words stays."""
    own = F.filter(words, lambda w: (w["start"] >= segment["start"] - 1e-6) & (w["start"] < segment["end"]))
    pieces = segment_by_words(own, max_s / 4, max_s, 1e9)
    n = F.greatest(F.ceil((segment["end"] - segment["start"]) / max_s).cast("int"), F.lit(2))
    step = (segment["end"] - segment["start"]) / n

    def equal(i: Column) -> Column:
        a, b = segment["start"] + i * step, segment["start"] + (i + 1) * step
        text = F.array_join(F.transform(F.filter(own, lambda w: (w["start"] >= a) & (w["start"] < b)), lambda w: w["word"]), " ")
        return F.struct(a.alias("start"), b.alias("end"), F.when(text == "", segment["text"]).otherwise(text).alias("text"))

    whole = F.array(F.struct(segment["start"].cast("double").alias("start"), segment["end"].cast("double").alias("end"), segment["text"].alias("text")))
    return F.when((segment["end"] - segment["start"] <= max_s) | (F.size(own) < 2), whole).when(F.size(pieces) >= 2, pieces).otherwise(F.transform(F.sequence(F.lit(0), n - 1), equal))


def pieces(words: DataFrame, key: str, gap_s: float, rows: int = ROWS) -> DataFrame:
    """words: key, start, end, word. Adds piece: the number of gaps of over gap_s before a word, in its key's order of start, end, word.

    The order is cut into blocks; a block carries the end of the word before it and the number of gaps so far.
    """
    by = ("start", "end", "word")
    df, parts = blocks(words, (key,), by, rows)
    inside = Window.partitionBy(key, "__block").orderBy(*by)
    df = df.withColumn("__gap", F.coalesce((F.col("start") - F.lag("end").over(inside) > gap_s).cast("int"), F.lit(0)))
    counted = df.withColumn("__in", F.sum("__gap").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if parts == 1:
        return counted.withColumn("piece", F.col("__in")).select(*words.columns, "piece")
    own, order = spanning(df, (key,), parts)
    table = own.groupBy(key, "__block").agg(F.min("start").alias("__s"), F.max_by("end", F.struct(*by)).alias("__e"), F.sum("__gap").alias("__n"))
    table = table.withColumn("__first", F.coalesce((F.col("__s") - F.lag("__e").over(order) > gap_s).cast("int"), F.lit(0)))
    table = table.withColumn("__before", F.coalesce(F.sum(F.col("__n") + F.col("__first")).over(order.rowsBetween(*BEFORE)), F.lit(0)) + F.col("__first")).select(key, "__block", "__before")
    return carried(counted, table, (key,), parts).withColumn("piece", F.col("__in") + F.coalesce("__before", F.lit(0))).select(*words.columns, "piece")


def segment_recordings(words: DataFrame, key: str, min_s: float = 3.0, max_s: float = 15.0, gap_s: float = 0.3, rows: int = ROWS) -> DataFrame:
    """segment_by_words() for recordings of any length. words: key, start, end, word. (key, n, start, end, text, words): n from 0.

    A word after a gap of over max_s opens a segment whatever came before, so recordings are cut there, and the fold runs over one piece (a stretch
    without such a pause) at a time. The merge of short segments goes across pieces: a segment that is long enough, or
    a recording's first, starts a merged one, so merged segments are numbered by a running count.
    """
    cut = pieces(words.select(key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "word"), key, max(max_s, gap_s), rows)
    folded = cut.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("w"))
    each = folded.select(key, "piece", "w", F.posexplode(_greedy(F.col("w"), min_s, max_s, gap_s)).alias("k", "s"))
    own = F.slice("w", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1)
    each = each.select(key, "piece", "k", F.col("s.start").alias("start"), F.col("s.end").alias("end"), own.alias("words"))
    head = ((F.col("piece") == 0) & (F.col("k") == 0)) | (F.col("end") - F.col("start") >= min_s)
    placed = running(each, "piece", "n", head.cast("bigint"), (key,), ("k",), rows)
    parts = F.array_sort(F.collect_list(F.struct("piece", "k", "start", "end", "words")))
    merged = placed.groupBy(key, (F.col("n") - 1).alias("n")).agg(parts.alias("p"))
    merged = merged.select(key, "n", F.element_at("p", 1)["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"), F.flatten(F.transform("p", lambda x: x["words"])).alias("words"))
    return merged.select(key, "n", "start", "end", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"), "words")


def split_recordings(segments: DataFrame, key: str, max_s: float) -> DataFrame:
    """segment_recordings() with segments of over max_s split: (key, n, p, start, end, text), p the piece's place in its segment."""
    piece = F.posexplode(split_long_segment(F.struct("start", "end", "text"), F.col("words"), max_s))
    return segments.select(key, "n", piece.alias("p", "s")).select(key, "n", "p", "s.start", "s.end", "s.text")


def punctuated(words: DataFrame, key: str, by: tuple[str, ...], add_ms: float = 300.0, rows: int = ROWS) -> DataFrame:
    """punctuate() a word a row, for recordings of any length. words: key, start, end, word. Adds token."""
    after = neighbour(words, "start", "__next", (key,), by, ahead=True, rows=rows)
    bare = F.regexp_replace(F.trim("word"), ",+$", "")
    return after.withColumn("token", F.concat(bare, F.when((F.col("__next") - F.col("end")) * 1000 >= add_ms, ",").otherwise(""))).drop("__next")


def folded_means(df: DataFrame, key: str, by: tuple[str, ...], value: str, k: int, rows: int = ROWS) -> DataFrame:
    """(key, fold, mean): means of each k values in order; the rest is left out. by: its first column must be a number."""
    placed = indexed(df.select(key, *by, value), by[0], "__i", (key,), by[1:], rows)
    folds = placed.groupBy(key, F.floor(F.col("__i") / k).alias("fold")).agg(F.avg(value).alias("mean"), F.count("*").alias("__n"))
    return folds.where(F.col("__n") == k).drop("__n")


def gap_sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of rows no further apart than the gap; combines before and after the shuffle."""
    s = df.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return s.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def extend_to_midpoints(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Adds left and right: each word's window up to the middle of the silence on both sides."""
    w = Window.partitionBy(key).orderBy(start)
    return df.withColumn("left", F.coalesce((F.lag(end).over(w) + F.col(start)) / 2, F.col(start))).withColumn("right", F.coalesce((F.lead(start).over(w) + F.col(end)) / 2, F.col(end)))


def char_frames(df: DataFrame, key: str, window: str, seconds: str, sr: int = 24000, hop: int = 256) -> DataFrame:
    """A row a character, with its word window's number and seconds: adds frames, the window's share, 1 at least."""
    n = F.count("*").over(Window.partitionBy(key, window))
    return df.withColumn("frames", F.greatest(F.bround(F.col(seconds) * sr / hop / n), F.lit(1.0)).cast("int"))


def dense_index(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, idx): names numbered from 0 in order of their first row."""
    first = df.groupBy(name).agg(F.min(order).alias("__at"))
    return first.select(name, (F.row_number().over(Window.orderBy("__at", name)) - 1).alias("idx"))


def assign_voice(idx: Column, voices: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, voices)), (F.pmod(idx, F.lit(len(voices))) + 1).cast("int"))


def schedule(idx: Column, mix: list[tuple[str, float]]) -> Column:
    """The teacher whose share of [0, 1) holds the fraction of idx times the golden ratio."""
    total, upto, out = sum(w for _, w in mix), 0.0, F.lit(mix[-1][0])
    frac = idx * PHI - F.floor(idx * PHI)
    for name, weight in reversed(mix):
        upto = sum(w for _, w in mix[: [n for n, _ in mix].index(name) + 1]) / total
        out = F.when(frac < upto, name).otherwise(out)
    return out


def ar1(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds predicted: mean + slope (previous - mean) by keys, a first row predicts itself."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__p", F.lag(value).over(w))
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), (F.covar_pop(value, "__p") / F.nullif(F.var_pop("__p"), F.lit(0.0))).alias("__a"))
    pred = F.col("__m") + F.coalesce("__a", F.lit(0.0)) * (F.col("__p") - F.col("__m"))
    return rows.join(stats, keys).withColumn("predicted", F.coalesce(pred, F.col(value))).drop("__p", "__m", "__a")


def epoch_batches(df: DataFrame, id_col: str, size: int, seed: int, epoch: int, position: int = 0) -> DataFrame:
    """Adds batch and slot: rows in the epoch's hash order, the tail short of a batch left out; from batch `position` on."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_col).cast("string")))
    rows = df.withColumn("__h", h).withColumn("__k", F.conv(F.substring("__h", 1, 12), 16, 10).cast("bigint"))
    placed = indexed(rows, "__k", "__i", ties=("__h", id_col))
    n = df.count()
    batch = F.floor(F.col("__i") / size)
    return placed.where(F.col("__i") < n // size * size).withColumn("batch", batch).withColumn("slot", F.col("__i") % size).where(F.col("batch") >= position).drop("__h", "__k", "__i")


def pad_batch(df: DataFrame, batch: str, order: str, ids: str) -> DataFrame:
    """(batch, rows of ids padded with 0 to the batch's longest, lengths, masks)."""
    by = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(ids).alias("ids")))).alias("r"), F.max(F.size(ids)).alias("width"))
    rows = F.transform("r", lambda x: F.concat(x["ids"], F.array_repeat(F.lit(0).cast("int"), F.col("width") - F.size(x["ids"]))))
    lengths = F.transform("r", lambda x: F.size(x["ids"]))
    masks = F.transform("r", lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x["ids"])), F.array_repeat(F.lit(0), F.col("width") - F.size(x["ids"]))))
    return by.select(batch, rows.alias("ids"), lengths.alias("lengths"), masks.alias("masks"), "width")


def _zero(kind: DataType, width: Column) -> Column:
    """What a missing place of an array's elements is filled with: 0, or for vectors as many zeros as they are wide."""
    if isinstance(kind, ArrayType):
        return F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0).cast(kind.elementType))
    return F.lit(0).cast(kind)


def pad_columns(df: DataFrame, batch: str, order: str, axes: dict[str, list[str]], caps: dict[str, int] | None = None, scalars: tuple[str, ...] = ()) -> DataFrame:
    """Rectangular batches of ragged columns: a row a batch, its rows in order of `order`.

    axes: for each axis (tokens, frames, reference ...) its array columns, of numbers or of vectors. An axis is as wide as its first
    column's longest array in the batch, or caps[axis] if that is less. Every array is cut or filled with zeros to that
    width; <axis>_mask tells the first column's own places, <axis>_lengths how many they are, <axis>_width the width. A null array
    has no places, and a batch without any has width 0. scalars: columns given out as one array each.
    A batch is gathered in a row, as it has to be; its size is set by whoever numbered the batches.
    """
    kinds = {c: df.schema[c].dataType.elementType for cols in axes.values() for c in cols}
    first = {axis: cols[0] for axis, cols in axes.items()}
    sized = {axis: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for axis, c in first.items()}
    vectors = [c for c, kind in kinds.items() if isinstance(kind, ArrayType)]
    inner = [F.max(F.coalesce(F.array_max(F.transform(c, F.size)), F.lit(0))).alias(f"__in_{c}") for c in vectors]
    widths = [F.max(n if axis not in (caps or {}) else F.least(n, F.lit(caps[axis]))).alias(f"{axis}_width") for axis, n in sized.items()]
    rows = F.array_sort(F.collect_list(F.struct(order, *kinds, *[c for c in scalars if c != order])))
    by = df.groupBy(batch).agg(rows.alias("__r"), *widths, *inner)

    def places(axis: str) -> Callable[[Column], Column]:
        return lambda x: F.least(F.greatest(F.coalesce(F.size(x[first[axis]]), F.lit(0)), F.lit(0)), F.col(f"{axis}_width"))

    def filled(axis: str, c: str) -> Column:
        kind, width = df.schema[c].dataType, F.col(f"{axis}_width")
        zero = _zero(kinds[c], F.col(f"__in_{c}") if c in vectors else F.lit(0))
        fill = lambda x: F.slice(F.concat(F.coalesce(x[c], F.array().cast(kind)), F.array_repeat(zero, width)), F.lit(1), width)
        return F.when(width > 0, F.transform("__r", fill)).otherwise(F.transform("__r", lambda x: F.array().cast(kind)))

    def masked(axis: str) -> Column:
        there, width = places(axis), F.col(f"{axis}_width")
        return F.transform("__r", lambda x: F.concat(F.array_repeat(F.lit(1), there(x)), F.array_repeat(F.lit(0), width - there(x))))

    out = [F.col(batch)]
    for axis, cols in axes.items():
        out += [filled(axis, c).alias(c) for c in cols]
        out += [masked(axis).alias(f"{axis}_mask"), F.transform("__r", places(axis)).alias(f"{axis}_lengths"), F.col(f"{axis}_width")]
    return by.select(*out, *[F.col(f"__r.{c}").alias(c) for c in scalars])


def split_by_text(df: DataFrame, text: str, n_val: int) -> DataFrame:
    """Adds split: val for the first n_val distinct texts in order, train for the others; renditions stay together."""
    val = df.select(text).distinct().orderBy(text).limit(n_val).withColumn("__v", F.lit(True))
    return df.join(F.broadcast(val) if n_val <= 100_000 else val, text, "left").withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__v")


def split_by_group(df: DataFrame, group: Column, n_val: int, seed: int = 0) -> DataFrame:
    """Adds split: whole groups in hash order fill val until it has n_val rows; the others are train."""
    df = df.withColumn("__g", group)
    sizes = df.groupBy("__g").agg(F.count("*").alias("__n")).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__g").cast("string"), F.lit("")))))
    sizes = sizes.withColumn("__k", F.conv(F.substring("__h", 1, 12), 16, 10).cast("bigint"))
    ranked = running(sizes, "__k", "__upto", F.col("__n"), (), ("__h", "__g"))
    val = ranked.where(F.col("__upto") - F.col("__n") < n_val).select(F.col("__g").alias("__vg"))
    return df.join(val, F.col("__g").eqNullSafe(F.col("__vg")), "left").withColumn("split", F.when(F.col("__vg").isNotNull(), "val").otherwise("train")).drop("__g", "__vg")


def pick_variant(idx: Column, options: Column) -> Column:
    return F.when(F.size(options) > 0, F.element_at(options, (F.pmod(idx, F.greatest(F.size(options), F.lit(1))) + 1).cast("int")))
