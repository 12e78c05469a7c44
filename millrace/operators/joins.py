"""Joins and pairings (J). Every pairing joins on a key; none is a plain cross join of large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import AFTER, BEFORE, FEW, ROWS, blocks, carried, hash_key, indexed, spanning
from millrace.operators.store import written


def attach_share(df: DataFrame, mix: DataFrame, name: str = "teacher") -> DataFrame:
    """Adds share from mix (name, weight); 1 where the name is unknown."""
    return df.join(mix.select(F.col("name").alias(name), F.col("weight").alias("share")), name, "left").withColumn("share", F.coalesce("share", F.lit(1.0)))


def pair_by_ref(variants: DataFrame, base: DataFrame, ref: str = "variant_of", key: str = "utt_id") -> DataFrame:
    """Each variant with its base record's columns as base_*; variants without one are left out."""
    named = base.select([F.col(c).alias(f"base_{c}") for c in base.columns])
    return variants.join(named, F.col(ref) == F.col(f"base_{key}"))


def pair_by_offset(df: DataFrame, offset: int, idx: str = "idx") -> DataFrame:
    """Item j with item j + offset, whose columns are named other_*."""
    other = df.select([F.col(c).alias(f"other_{c}") for c in df.columns]).withColumn("__j", F.col(f"other_{idx}") - offset)
    return df.join(other, F.col(idx) == F.col("__j")).drop("__j")


def remap_keys(df: DataFrame, extra: DataFrame, merged: DataFrame, key: str = "voice") -> DataFrame:
    """Voice numbers of an incoming table (extra: voice, name) become those of the merged one (voice, name).

    Names that merged lacks come after its last number, in order of their first number; numbers that extra lacks are
    named voice_{n}. Dimension tables are small; windows run over names only.
    """
    used = df.select(key).distinct().join(extra.select(F.col("voice").alias(key), F.col("name")), key, "left")
    used = used.withColumn("name", F.coalesce("name", F.concat(F.lit("voice_"), F.col(key).cast("string"))))
    first = used.groupBy("name").agg(F.min(key).alias("at")).join(merged.select("name", F.col("voice").alias("known")), "name", "left")
    top = merged.agg(F.coalesce(F.max("voice"), F.lit(-1)).alias("top"))
    fresh = F.row_number().over(Window.partitionBy(F.col("known").isNull()).orderBy("at", "name"))
    placed = first.withColumn("n", fresh).crossJoin(F.broadcast(top))  # one row
    placed = placed.select("name", F.coalesce("known", F.col("top") + F.col("n")).alias("merged_voice"))
    return df.join(used.join(placed, "name"), key)


def apply_norm(df: DataFrame, by_voice_source: DataFrame, by_voice: DataFrame, value: str = "value") -> DataFrame:
    """Adds normed: by statistics (voice, source, dim, mean, std) before those of (voice, dim); raw without either."""
    a = by_voice_source.select("voice", "source", "dim", F.col("mean").alias("__m1"), F.col("std").alias("__s1"))
    b = by_voice.select("voice", "dim", F.col("mean").alias("__m2"), F.col("std").alias("__s2"))
    out = df.join(a, ["voice", "source", "dim"], "left").join(b, ["voice", "dim"], "left")
    mean, std = F.coalesce("__m1", "__m2"), F.coalesce("__s1", "__s2")
    return out.withColumn("normed", F.coalesce((F.col(value) - mean) / std, F.col(value))).drop("__m1", "__s1", "__m2", "__s2")


def exclude(df: DataFrame, *blocked: DataFrame, key: Column | str = "text") -> DataFrame:
    """Rows whose key is in none of the blocked tables (one column each, of keys)."""
    column = F.col(key) if isinstance(key, str) else key
    out = df.withColumn("__key", column)
    for table in blocked:
        out = out.join(table.select(F.col(table.columns[0]).alias("__key")).distinct(), "__key", "left_anti")
    return out.drop("__key")


def holdout_overlap(df: DataFrame, holdout: DataFrame, text: str = "text") -> DataFrame:
    """Held-out texts that occur in the corpus, compared trimmed and lower-cased. Should be empty."""
    own = df.select(F.lower(F.trim(F.col(text))).alias("__key"))
    keyed = holdout.withColumn("__key", F.lower(F.trim(F.col(text))))
    held = written(keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("__n")), "held-out-keys")
    if held.count() <= FEW:  # so are those of them that occur, and no row moves, however many share a key
        found = own.join(F.broadcast(held.select("__key")), "__key", "left_semi").distinct()
        return keyed.join(F.broadcast(found), "__key", "left_semi").drop("__key")
    found = written(held.join(own.distinct(), "__key", "left_semi"), "held-out-found")
    return join_classes(keyed, found, "__key", "__n").select(holdout.columns)


def pairs_within(df: DataFrame, key: str, id_col: str, most: int | None = None) -> DataFrame:
    """(key, a, b): unordered pairs a < b of one key. Quadratic in a key's rows by definition; most: only each row's
    next so many rows by id, which bounds it."""
    a = df.select(key, F.col(id_col).alias("a"))
    if most is not None:
        near = Window.partitionBy(key).orderBy("a")
        nexts = [F.lead("a", k).over(near) for k in range(1, most + 1)]
        listed = a.withColumn("__b", F.array_compact(F.array(*nexts)))
        return listed.select(key, "a", F.explode("__b").alias("b"))
    return a.join(df.select(key, F.col(id_col).alias("b")), key).where("a < b")


def asof_word(points: DataFrame, words: DataFrame, key: str, at: str = "pos", start: str = "start", word: str = "word", rows: int = ROWS) -> DataFrame:
    """Each point with the last word that starts at or before it; before the first, the first word. Of words with one start, the greatest.

    Points and words lie in one order, in blocks; a block carries the last word before it, and the first one after it, so a key of
    all rows is spread.
    """
    kind = points.select(F.struct(*points.columns)).schema[0].dataType
    both = points.select(key, F.col(at).alias("__at"), F.struct(*points.columns).alias("__p"), F.lit(1).alias("__o"), F.lit(None).cast(words.schema[word].dataType).alias("__w")).unionByName(
        words.select(key, F.col(start).alias("__at"), F.lit(None).cast(kind).alias("__p"), F.lit(0).alias("__o"), F.col(word).alias("__w"))
    )
    by = ("__at", "__o", "__w")
    both, parts = blocks(both, (key,), by, rows)
    order = Window.partitionBy(key, "__block").orderBy(*by)
    last = F.last("__w", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("__w", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("__last", last).withColumn("__first", first)
    if parts == 1:
        return found.where("__o = 1").select("__p.*", F.coalesce("__last", "__first").alias("word"))
    own, follow = spanning(both, (key,), parts)
    at_word = F.when(F.col("__w").isNotNull(), F.struct("__at", "__w"))
    table = own.groupBy(key, "__block").agg(F.max_by("__w", at_word).alias("__l"), F.min_by("__w", at_word).alias("__f"))
    table = table.withColumn("__before", F.last("__l", ignorenulls=True).over(follow.rowsBetween(*BEFORE)))
    table = table.withColumn("__after", F.first("__f", ignorenulls=True).over(follow.rowsBetween(*AFTER))).drop("__l", "__f")
    return carried(found, table, (key,), parts).where("__o = 1").select("__p.*", F.coalesce("__last", "__before", "__first", "__after").alias("word"))


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, parts: int = 1000) -> DataFrame:
    """Inner join of many rows to one class row a key, where a key may hold a third of all rows; size: the rows of a key.

    Keys of over 1/parts of all rows are fewer than `parts`, whatever the data: their classes are broadcast, and their rows
    stay where they are. Other keys meet in a shuffled join, also where the file of the classes is small: numbers in order
    take a few bits each there, and many bytes in the driver.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(1_000, total // parts)
    often = F.broadcast(classes.where(hot))
    rare = rows.join(F.broadcast(classes.where(hot).select(key)), key, "left_anti").join(classes.where(~hot).hint("merge"), key)
    return rows.join(often, key).unionByName(rare)


def frames_in_span(frames: DataFrame, spans: DataFrame, key: str, frame: str = "frame", start: str = "start", stop: str = "stop", width: int = 64) -> DataFrame:
    """Frames with the spans whose [start, stop) holds them. Spans are entered in each block of `width`
    frames that they touch, so that the join has an equality."""
    blocks = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)))
    entered = spans.where(F.col(stop) > F.col(start)).withColumn("__b", blocks)
    joined = frames.withColumn("__b", F.floor(F.col(frame) / width)).join(entered, [key, "__b"])
    return joined.where((F.col(frame) >= F.col(start)) & (F.col(frame) < F.col(stop))).drop("__b")


def _sized(df: DataFrame, key: str) -> DataFrame:
    """(key, size): rows of each key; broadcast if the keys, counted first, are few."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    return F.broadcast(sizes) if sizes.count() <= 100_000 else sizes


def positive_pair(df: DataFrame, key: str, id_col: str, seed: int = 0) -> DataFrame:
    """(id, partner): another item of the same key, itself if it is alone.

    Items of a key are put on a ring in hash order; the partner is the next one. So each item is drawn
    once, no key's pairs are formed, and items meet by key and place, so that a hot key is spread.
    """
    rows = df.select(key, id_col).withColumn("__h", hash_key(seed, id_col))
    ring = indexed(rows, "__h", "__i", (key,), (id_col,)).join(_sized(df, key), key)
    after = ring.select(key, (F.col("__i") - 1).alias("__i"), F.col(id_col).alias("partner"))
    first = ring.where("__i = 0").select(key, (F.col("size") - 1).alias("__i"), F.col(id_col).alias("partner"))
    return ring.join(after.where("__i >= 0").unionByName(first), [key, "__i"]).select(F.col(id_col).alias("id"), key, "partner")


def negative_pair(df: DataFrame, key: str, id_col: str, seed: int = 0) -> DataFrame:
    """(id, partner, other_key): an item of another key, over all other keys; null if there is none.

    The other key is the item's hash's pick among all other keys (a small table), the partner that key's item of
    the item's hashed place.
    """
    rows = df.select(key, id_col).withColumn("__h", hash_key(seed, id_col))
    ranked = indexed(rows, "__h", "__n", (key,), (id_col,))
    keys = df.groupBy(key).agg(F.count("*").alias("__size")).withColumn("__k", F.row_number().over(Window.orderBy(key)) - 1).withColumn("__keys", F.count("*").over(Window.partitionBy()))
    small = F.broadcast if keys.count() <= 100_000 else lambda x: x
    own = ranked.join(small(keys), key).where("__keys > 1").withColumn("__draw", hash_key(seed + 1, id_col))
    own = own.withColumn("__other", F.pmod(F.col("__k") + 1 + F.pmod("__draw", F.greatest(F.col("__keys") - 1, F.lit(1))), F.col("__keys")))
    other = keys.select(F.col(key).alias("other_key"), F.col("__size").alias("__other_size"), F.col("__k").alias("__other"))
    placed = own.join(small(other), "__other").withColumn("__place", F.pmod(F.shiftright("__draw", 16), F.col("__other_size")))
    target = ranked.select(F.col(key).alias("other_key"), F.col("__n").alias("__place"), F.col(id_col).alias("partner"))
    found = placed.join(target, ["other_key", "__place"]).select(F.col(id_col).alias("id"), "partner", "other_key")
    return df.select(F.col(id_col).alias("id"), key).join(found, "id", "left")


def grid(prompts: DataFrame, voices: DataFrame, limit: int = 10_000) -> DataFrame:
    """Prompts with each voice; voices are counted first and must be few."""
    n = voices.count()
    if n > limit:
        raise ValueError(f"{n} voices are more than {limit}")
    return prompts.crossJoin(F.broadcast(voices))


def control_pairs(df: DataFrame, id_col: str, n: int | None = 120, seed: int = 0) -> DataFrame:
    """(pair, a, b): disjoint pairs of items in hash order; the first n of them."""
    hashed = df.select(id_col).withColumn("h", hash_key(seed, id_col))
    if n is not None:
        hashed = hashed.orderBy("h", id_col).limit(2 * n)  # top-k: no full sort
    ranked = indexed(hashed, "h", "i", ties=(id_col,))
    even = ranked.where("i % 2 = 0").select(F.floor(F.col("i") / 2).alias("pair"), F.col(id_col).alias("a"))
    odd = ranked.where("i % 2 = 1").select(F.floor(F.col("i") / 2).alias("pair"), F.col(id_col).alias("b"))
    return even.join(odd, "pair")


def best_shift(a: DataFrame, b: DataFrame, key: str, window: int = 12, least: int = 20) -> DataFrame:
    """(key, shift, rho): the lag at which series a(frame, value) and b correlate best, with enough frames."""
    shifts = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("shift")
    x = a.select(key, F.col("frame"), F.col("value").alias("x"), shifts).withColumn("frame", F.col("frame") + F.col("shift"))
    y = b.select(key, "frame", F.col("value").alias("y"))
    rho = x.join(y, [key, "frame"]).groupBy(key, "shift").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).where((F.col("n") >= least) & F.col("rho").isNotNull())
    best = rho.groupBy(key).agg(F.max(F.struct("rho", -F.abs("shift"), -F.col("shift"))).alias("m"))
    return best.select(key, (-F.col("m.col3")).alias("shift"), F.col("m.rho").alias("rho"))


def shuffled_control(df: DataFrame, batch: str, order: str, text: str = "text") -> DataFrame:
    """Adds other_text: the text of the row before in the batch, by order (a number that tells its rows apart); the first
    row takes the last one's. Rows meet by batch and place, so that one large batch is spread."""
    placed = indexed(df, order, "__i", (batch,)).join(_sized(df, batch), batch)
    before = placed.select(batch, F.pmod(F.col("__i") + 1, F.col("size")).alias("__i"), F.col(text).alias("other_text"))
    return placed.join(before, [batch, "__i"]).select(*df.columns, "other_text")


def zip_min(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two series (keys, value) over the places that both have: columns x and y."""
    return a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys)
