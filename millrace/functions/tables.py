"""Table functions for SQL (X6): folds over a partition's rows in order that no window expresses.

    tables.register(spark)
    SELECT * FROM segment_words(TABLE(SELECT key, start, end, word FROM words) PARTITION BY key ORDER BY (start, end, word), 3.0D, 15.0D, 0.3D)

Spark deals the partitions out and sorts them; a function holds one open segment, and the merged one that may still grow.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row


class SegmentWords:
    """Greedy segments of timed words, as operators.windows.segment_by_words cuts them: (key, n, start, end, words, text).

    The table's columns are key, start, end and word. Rows without times or word are left out.
    """

    def __init__(self) -> None:
        self.key, self.n, self.open, self.last = None, 0, None, None

    def _closed(self) -> Iterator[tuple]:
        now, self.open = self.open, None
        if self.last is not None and now[1] - now[0] < self.min_s:
            self.last = (self.last[0], now[1], self.last[2] + now[2])
            return
        if self.last is not None:
            yield self._row()
        self.last = now

    def _row(self) -> tuple:
        start, end, words = self.last
        self.n += 1
        return self.key, self.n - 1, start, end, len(words), " ".join(words)

    def eval(self, words: Row, min_s: float, max_s: float, gap_s: float) -> Iterator[tuple]:
        self.min_s = float(min_s)
        start, end, word = words["start"], words["end"], words["word"]
        if start is None or end is None or word is None:
            return
        self.key = str(words["key"])
        held = self.open
        if held and ((start - held[1] >= gap_s and held[1] - held[0] >= min_s) or end - held[0] > max_s):
            yield from self._closed()
            held = None
        if held:
            held[2].append(word)
        self.open = (held[0], end, held[2]) if held else (start, end, [word])

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield from self._closed()
        if self.last:
            yield self._row()


def register(spark: SparkSession) -> None:
    """Makes segment_words(TABLE(...), min_s, max_s, gap_s) known to the session's SQL."""
    spark.udtf.register("segment_words", udtf(SegmentWords, returnType="key string, n int, start double, end double, words int, text string"))
