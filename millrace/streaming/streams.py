"""Streams (T): file sources, checkpointed, so that a stopped job goes on where it was."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators import joins as J
from millrace.operators.store import written


def events_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of event files as a stream, ts as timestamp."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def append_manifest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """T1: each record written once, batch by batch; what is written stays after a crash."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def process_new(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """T2: fn over the files that arrived since the last run; the checkpoint is the ledger."""
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def process_until(spark: SparkSession, open_stream: Callable[[], DataFrame], fn: Callable[[DataFrame, int], None], checkpoint: str, marker: str, poll_s: float = 10.0) -> int:
    """T2: process_new() again and again until the producer's marker file is there; the number of runs. The marker is looked for
    before a run starts, so files written before it are always processed."""
    runs = 0
    while True:
        ended = exists(spark, marker)
        process_new(open_stream(), fn, checkpoint).awaitTermination()
        runs += 1
        if ended:
            return runs
        time.sleep(poll_s)


def ema_norm(stream: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", momentum: float = 0.01) -> DataFrame:
    """T3: the running mean and variance of each key after each batch: the first batch's are copied, later ones mixed in.

    A batch's rows of a key come in parts, of which only number, mean and squared deviations are held.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, dev = 0, 0.0, 0.0
        for part in parts:
            own = part[value].dropna().astype(float)
            if not len(own):
                continue
            gap, m = float(own.mean()) - mean, len(own)
            dev += float(((own - own.mean()) ** 2).sum()) + gap * gap * n * m / (n + m)
            mean += gap * m / (n + m)
            n += m
        if not n:
            return
        var = dev / n
        if state.exists:
            old = state.get
            mean, var = (1 - momentum) * old[0] + momentum * mean, (1 - momentum) * old[1] + momentum * var
        state.update((mean, var))
        yield pd.DataFrame({key: [k[0]], "mean": [mean], "var": [var]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, mean double, var double", "mean double, var double", "update", "NoTimeout")


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ema_norm_tables(stream: DataFrame, folder: str, checkpoint: str, key: str = "user_id", value: str = "value", momentum: float = 0.01) -> StreamingQuery:
    """T3 with its state in tables: folder/batch=n holds every key's (key, mean, var) after batch n; the last two stay.

    A batch's statistics are one aggregation, brought together with the table before by key, so no key costs a call of Python as in ema_norm(). A
    batch that runs again overwrites what it wrote.
    """
    spark, kind = stream.sparkSession, stream.schema[key].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        x = F.col(value).cast("double")
        own = batch.where(x.isNotNull() & ~F.isnan(x)).groupBy(key).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
        before = f"{folder}/batch={number - 1}"
        both = own.withColumns({"mean": F.lit(None).cast("double"), "var": F.lit(None).cast("double")})
        if exists(spark, before):
            old = spark.read.schema(f"{key} {kind}, mean double, var double").parquet(before)
            both = both.unionByName(old, allowMissingColumns=True)
        mixed = lambda old, new: F.coalesce((1 - momentum) * F.max(old) + momentum * F.max(new), F.max(old), F.max(new))  # noqa: E731  one of each
        both.groupBy(key).agg(mixed("mean", "m").alias("mean"), mixed("var", "v").alias("var")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        _drop(spark, f"{folder}/batch={number - 2}")

    return process_new(stream, step, checkpoint)


def sessions(stream: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """T4: runs of rows no further apart than the gap, given out once the watermark has passed them."""
    s = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Segments(StatefulProcessor):
    """State of a key: words that the watermark hasn't passed, the open segment, and the last closed one, which a short one may join."""

    def __init__(self, min_s: float, max_s: float, gap_s: float, hold_s: float):
        self.min_s, self.max_s, self.gap_s, self.hold_s = min_s, max_s, gap_s, hold_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        bounds = "start double, end double, n int, text string"
        self.handle = handle
        self.words = handle.getListState("words", "start double, end double, word string")
        self.open, self.last = handle.getValueState("open", bounds), handle.getValueState("last", bounds)

    def _closed(self, segment: tuple | None) -> Iterator[tuple]:
        """Takes in a closed segment; gives the one before it, if that is final now."""
        last = self.last.get() if self.last.exists() else None
        if segment is None or last is None:
            if segment is not None:
                self.last.update(segment)
        elif segment[1] - segment[0] < self.min_s:
            self.last.update((last[0], segment[1], last[2] + segment[2], f"{last[3]} {segment[3]}"))
        else:
            self.last.update(segment)
            yield tuple(last)

    def _flush(self) -> Iterator[tuple]:
        if self.open.exists():
            yield from self._closed(tuple(self.open.get()))
            self.open.clear()
        if self.last.exists():
            yield tuple(self.last.get())
            self.last.clear()

    def _advance(self, now: float) -> Iterator[tuple]:
        """Folds the words that start before `now` (the watermark), in order."""
        waiting = sorted(map(tuple, self.words.get())) if self.words.exists() else []
        ready, later = [w for w in waiting if w[0] < now], [w for w in waiting if w[0] >= now]
        held = tuple(self.open.get()) if self.open.exists() else None
        for start, end, word in ready:
            if held and ((start - held[1] >= self.gap_s and held[1] - held[0] >= self.min_s) or end - held[0] > self.max_s):
                yield from self._closed(held)
                held = None
            held = (held[0], end, held[2] + 1, f"{held[3]} {word}") if held else (start, end, 1, word)
        if ready:
            self.open.update(held)
            self.words.put(later) if later else self.words.clear()

    def _frame(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            out = pd.DataFrame(found, columns=["start", "end", "n", "text"])
            out.insert(0, "key", key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, ended = [], False
        for part in rows:
            spoken = part[part["word"].notna()]
            ended |= len(spoken) < len(part)
            if len(spoken):
                self.words.appendList(list(spoken[["start", "end", "word"]].itertuples(index=False, name=None)))
        if ended:
            found += [*self._advance(float("inf")), *self._flush()]
        else:
            found += self._advance(timerValues.getCurrentWatermarkInMs() / 1000)
            self._remind()
        yield from self._frame(key, found)

    def _remind(self) -> None:
        """A timer for the first waiting word, or else for the end of the silence; one that comes early finds nothing to do."""
        starts = [w[0] for w in self.words.get()] if self.words.exists() else []
        if starts:
            self.handle.registerTimer(int(min(starts) * 1000) + 1)
        elif self.open.exists():
            self.handle.registerTimer(int((self.open.get()[1] + self.max_s + self.hold_s) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        found = list(self._advance(now))
        if not self.words.exists() and self.open.exists() and now > self.open.get()[1] + self.max_s + self.hold_s:
            found += self._flush()
        else:
            self._remind()
        yield from self._frame(key, found)

    def close(self) -> None:
        pass


def capped_segments(stream: DataFrame, key: str = "key", ts: str = "ts", late: str = "1 hour", min_s: float = 3.0, max_s: float = 15.0, gap_s: float = 0.3, hold_s: float = 60.0) -> DataFrame:
    """T4: segments (key, start, end, n, text) of a stream of timed words (key, ts, start, end, word), as W7 cuts them: by pauses and by a cap
    on duration, short ones joining the one before.

    A word is folded once the watermark has passed it, so words may come out of order within `late`. A segment is given out when the
    next one that isn't short has closed, or when a key has been silent for max_s and hold_s (a short segment after such a
    silence stays by itself), or when a row without a word says that the key has ended. start and end are seconds since 1970, as ts.
    The session's state store must be RocksDB's when the stream starts (see rocksdb()).
    """
    kind = stream.schema[key].dataType.simpleString()
    words = stream.withWatermark(ts, late).select(F.col(key).alias("key"), ts, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "word")
    schema = f"key {kind}, start double, end double, n int, text string"
    return words.groupBy("key").transformWithStateInPandas(_Segments(min_s, max_s, gap_s, hold_s), schema, "Append", "EventTime")


#: Kinds of rows of a fold: an end marker, the last closed segment, the open one, a word; a segment that is given out.
MARKER, LAST, OPEN, WORD, DONE = range(5)


def _fold(now: float, min_s: float, max_s: float, gap_s: float, hold_s: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds rows sorted by key, kind, start, end and text, as _Segments does: words before `now` (all, if the key has ended) into segments."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, schema = ["key", "kind", "start", "end", "n", "text"], [], None
        key, ended, last, held, waits = None, False, None, None, False

        def close(segment: tuple) -> None:
            nonlocal last
            if last is not None and segment[1] - segment[0] < min_s:
                last = (last[0], segment[1], last[2] + segment[2], f"{last[3]} {segment[3]}")
                return
            if last is not None:
                found.append((key, DONE, *last))
            last = segment

        def finish() -> None:
            if ended or (held and not waits and now > held[1] + max_s + hold_s):
                if held:
                    close(held)
                if last:
                    found.append((key, DONE, *last))
                return
            found.extend((key, kind, *segment) for kind, segment in ((LAST, last), (OPEN, held)) if segment)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=names)

        for part in parts:
            part = part.select(names)
            first, schema = schema is None, part.schema
            for k, kind, start, end, n, text in zip(*(c.to_pylist() for c in part.columns)):
                if first or k != key:
                    if not first:
                        finish()
                    first, key, ended, last, held, waits = False, k, False, None, None, False
                if kind == MARKER:
                    ended = True
                elif kind == LAST:
                    last = (start, end, n, text)
                elif kind == OPEN:
                    held = (start, end, n, text)
                elif ended or start < now:
                    if held and ((start - held[1] >= gap_s and held[1] - held[0] >= min_s) or end - held[0] > max_s):
                        close(held)
                        held = None
                    held = (held[0], end, held[2] + 1, f"{held[3]} {text}") if held else (start, end, 1, text)
                else:
                    waits = True
                    found.append((k, WORD, start, end, 1, text))
            yield rows()
        if schema is not None:
            finish()
            yield rows()

    return run


def capped_segments_tables(stream: DataFrame, folder: str, checkpoint: str, key: str = "key", ts: str = "ts", late_s: float = 3600.0, min_s: float = 3.0, max_s: float = 15.0, gap_s: float = 0.3, hold_s: float = 60.0) -> StreamingQuery:
    """T4 as capped_segments(), with its state in tables: folder/done/batch=n holds the segments (key, start, end, n, text) that batch n gave out.

    A batch's words and what is left of the batches before (waiting words, open and last segments) are dealt out by key, sorted and folded in one pass a
    task, so no key costs a call of Python or of a state store. Words that the watermark had passed before the batch are dropped. A batch that runs
    again overwrites what it wrote.
    """
    spark, kind = stream.sparkSession, stream.schema[key].dataType.simpleString()
    schema = f"key {kind}, kind int, start double, end double, n int, text string"

    def step(batch: DataFrame, number: int) -> None:
        at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
        before = exists(spark, f"{folder}/seen/batch={number - 1}")
        seen = spark.read.schema("at double").parquet(f"{folder}/seen/batch={number - 1}").first()[0] if before else None
        past = float("-inf") if seen is None else seen - late_s
        newest = batch.agg(F.max(at)).first()[0]
        known = [x for x in (seen, newest) if x is not None]
        seen = max(known) if known else None
        now = float("-inf") if seen is None else seen - late_s
        words = batch.where(at >= F.lit(past)).select(F.col(key).alias("key"), F.when(F.col("word").isNull(), MARKER).otherwise(WORD).alias("kind"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(1).alias("n"), F.col("word").alias("text"))
        if before:
            words = words.unionByName(spark.read.schema(schema).parquet(f"{folder}/left/batch={number - 1}"))
        sorted_ = words.repartition("key").sortWithinPartitions("key", "kind", "start", "end", "text")
        folded = written(sorted_.mapInArrow(_fold(now, min_s, max_s, gap_s, hold_s), schema), "folded")
        folded.where(F.col("kind") == DONE).drop("kind").write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
        folded.where(F.col("kind") != DONE).write.mode("overwrite").parquet(f"{folder}/left/batch={number}")
        spark.range(1).select(F.lit(seen).cast("double").alias("at")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        for name in ("left", "seen"):
            _drop(spark, f"{folder}/{name}/batch={number - 2}")

    return process_new(stream, step, checkpoint)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs, for streams started within; the session's own one is set again afterwards."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def validate_stream(stream: DataFrame, holdout: DataFrame, id_col: str, text: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """T5: rows whose id wasn't seen within the watermark and whose text (trimmed, lower-cased) isn't held out."""
    fresh = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])
    held = holdout.select(F.lower(F.trim(text)).alias("__k")).distinct()
    return fresh.withColumn("__k", F.lower(F.trim(F.col(text)))).join(held, "__k", "left_anti").drop("__k")


def validation_counters(stream: DataFrame, holdout: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """T5: the checks of C12 over a corpus that is still being written, after each batch: (batch, check, bad) in folder/counters.

    stream: utt_id, text, sample_rate, duration_s, license. What was seen before is kept in folder/ids (id and number, by batch), folder/held (held-out
    texts met) and folder/rates. A batch looks up its own ids only; a batch that runs again overwrites what it wrote.
    """
    spark = stream.sparkSession
    kinds = {"ids": "utt_id string, n bigint", "held": "text string", "rates": "sample_rate bigint", "counters": "check string, bad bigint"}

    def read(name: str, before: int) -> DataFrame:
        schema = f"{kinds[name]}, batch int"
        paths = f"{folder}/{name}"
        found = spark.read.schema(schema).parquet(paths) if exists(spark, paths) else spark.createDataFrame([], schema)
        return found.where(F.col("batch") < before)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("utt_id", F.col("utt_id").cast("string"))
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        ids = rows.where("utt_id IS NOT NULL").groupBy("utt_id").agg(F.count("*").alias("n"))
        put(ids, "ids")
        own = spark.read.parquet(f"{folder}/ids/batch={number}")
        before = read("ids", number).join(own.select("utt_id"), "utt_id", "left_semi").groupBy("utt_id").agg(F.sum("n").alias("before"))
        repeated = own.join(before, "utt_id", "left").where("coalesce(before, 0) <= 1 AND coalesce(before, 0) + n > 1")
        met = J.exclude(J.holdout_overlap(rows, holdout).select(F.lower(F.trim("text")).alias("text")), read("held", number).select("text"), key=F.col("text"))
        put(met, "held")
        put(rows.select(F.col("sample_rate").cast("bigint").alias("sample_rate")).distinct().join(read("rates", number).select("sample_rate"), "sample_rate", "left_anti"), "rates")
        rates = spark.read.schema(kinds["rates"] + ", batch int").parquet(f"{folder}/rates").where(F.col("batch") <= number)
        one = lambda name, df: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
        plain = rows.agg(
            F.count_if(F.col("utt_id").isNull() | F.col("text").isNull() | F.col("license").isNull()).alias("missing fields"), F.count_if(~F.col("duration_s").between(3, 30)).alias("duration")
        ).select(F.expr("stack(2, 'missing fields', `missing fields`, 'duration', `duration`) AS (check, bad)"))
        fresh = plain.unionByName(one("repeated ids", repeated)).unionByName(one("held-out texts", spark.read.schema("text string").parquet(f"{folder}/held/batch={number}")))
        old = read("counters", number).where(F.col("batch") == number - 1).select("check", "bad").where(F.col("check") != "further sample rates")
        summed = fresh.unionByName(old).groupBy("check").agg(F.sum("bad").alias("bad"))
        put(summed.unionByName(one("further sample rates", rates.select("sample_rate").distinct().offset(1))), "counters")

    return process_new(stream, step, checkpoint)


def resume(batches: DataFrame, state: int) -> DataFrame:
    """T6: the batches of an epoch's order that come after a saved position."""
    return batches.where(F.col("batch") >= state)


def save_position(spark: SparkSession, folder: str, position: int) -> None:
    """The first batch that isn't done yet, added to a small table."""
    spark.range(1).select(F.lit(position).cast("bigint").alias("position")).write.mode("append").parquet(f"{folder}/position")


def position(spark: SparkSession, folder: str) -> int:
    return spark.read.schema("position bigint").parquet(f"{folder}/position").agg(F.max("position")).first()[0] if exists(spark, f"{folder}/position") else 0


def _drop_from(spark: SparkSession, folder: str, start: int) -> None:
    """Deletes the folder's subfolders first=n (or batch=n) of n >= start."""
    if exists(spark, folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            name, _, n = status.getPath().getName().partition("=")
            if name in ("first", "batch") and n.isdigit() and int(n) >= start:
                files.delete(status.getPath(), True)


def run_batches(batches: DataFrame, folder: str, stop: int | None = None) -> int:
    """T6: writes the batches from the saved position on, up to `stop`, to folder/batches, then saves the position, which it returns.

    A run writes a folder named by its first batch, in files of many batches each, in order of batch; what lies there from that position on, of a run
    that failed before it saved its own, is deleted first, so nothing is there twice.
    """
    spark = batches.sparkSession
    start = position(spark, folder)
    rows = resume(batches, start)
    rows = rows if stop is None else rows.where(F.col("batch") < stop)
    _drop_from(spark, f"{folder}/batches", start)
    rows.repartition("batch").sortWithinPartitions("batch").write.mode("overwrite").parquet(f"{folder}/batches/first={start}")
    done = stop if stop is not None else (batches.agg(F.max("batch")).first()[0] or 0) + 1
    save_position(spark, folder, done)
    return done
