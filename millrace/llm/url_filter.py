"""URL rules by a sort-merge range join.

A host's labels are reversed and each is ended by a dot: a.example.net becomes net.example.a. -- then a host and
all its subdomains are the interval of keys from its own key up to that key with its last dot raised to a slash.
Intervals of hosts nest or are disjoint, so the rules active from an interval's start on are the stack of its host's
own rules on top of those of the hosts around it, and from its end on that stack without its own. A host has
few labels, so these stacks come from a join of each host with its ancestors. Pages and interval ends are then sorted
together by key, and the sweep gives each page the stack of the last end before it (a window, no join); the longest
rule of the stack whose path starts the page's path decides.

Rules of different last labels never meet, so the sweep runs by last label. A label with many pages is dealt over
salted groups, in each of which its ends are repeated: a group gets `each` pages on average (EACH at most), or as many as the
label has ends if these are more, so repeated ends never outnumber the pages. Rules are a configured list: the rules of one host
and of those around it are one row.

Definitions: the host is what follows the first :// up to / ? # or the end, A-Z lower-cased; the path is what
follows it up to ? # or the end. Null urls and urls without :// have both empty, and fit no rule. A port or
user name stays part of the host. A rule (host, path) fits a host that is it or ends with a dot and
it, if the page's path starts with the rule's path. The longest rule (host and path together) wins; of equally
long ones the smaller string; of one rule given twice, block before allow. Without a rule the verdict is `default`.
Rules with a null or empty host, or one with a slash (no page has it), are left out; a null path is empty. Repeated rows are judged alike.
Other columns are not read. Everything runs in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages of one label in a group of the sweep: so many, or a SHARE-th of all pages if that is less, but LEAST in any case.
EACH, SHARE, LEAST = 250_000, 64, 1_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def ancestors(host: Column) -> Column:
    """The host and every domain around it: a.example.net, example.net, net."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ends(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict. (label, key, stack): each interval end and the rules active from it on, outer hosts' first."""
    rules = rules.where("host <> '' AND NOT contains(host, '/')").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    rule = F.concat("host", "path")
    own = F.struct(F.length(rule).alias("size"), rule.alias("rule"), "path", "verdict")
    nodes = rules.groupBy("host").agg(F.collect_list(own).alias("own"))
    around = nodes.select("host", F.explode(ancestors(F.col("host"))).alias("up"))
    met = around.join(nodes.select(F.col("host").alias("up"), "own"), "up")
    stacks = met.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.length("up").alias("depth"), "own"))).alias("levels"))
    key, outer = host_key(F.col("host")), F.slice("levels", 1, F.size("levels") - 1)
    flat = lambda levels: F.flatten(F.transform(levels, lambda x: x["own"]))
    start, stop = F.struct(key.alias("key"), flat(F.col("levels")).alias("stack")), F.struct(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), flat(outer).alias("stack"))
    both = stacks.withColumn("key", key).select(last_label(F.col("host")).alias("label"), F.explode(F.array(start, stop)).alias("e"))
    return both.select("label", "e.key", "e.stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", each: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null without one), verdict of every row."""
    pages = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("label", last_label(F.col("host")))
    n = pages.count()
    each = each or max(LEAST, min(EACH, n // SHARE))
    bounds = ends(rules)
    per_label = pages.groupBy("label").agg(F.count("*").alias("pages")).where(F.col("pages") > each)
    per_label = per_label.join(bounds.groupBy("label").agg(F.count("*").alias("ends")), "label", "left")
    salts = F.floor(F.col("pages") / F.greatest(F.lit(each), F.coalesce("ends", F.lit(0)))).cast("int")
    # Labels with more than `each` pages: n / each of them at most.
    hot = per_label.select("label", F.greatest(salts, F.lit(1)).alias("salts"))
    salted = pages.join(F.broadcast(hot) if n // each <= 100_000 else hot, "label", "left")
    salt = F.pmod(F.xxhash64("id", "host", "path"), F.coalesce("salts", F.lit(1))).cast("int")
    none = F.lit(None).cast(bounds.schema["stack"].dataType)
    rows = salted.select("id", "host", "path", "label", salt.alias("salt"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), none.alias("stack"))
    dealt = bounds.join(hot, "label", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "host", "path")]
    both = rows.unionByName(dealt.select(*empty, "label", "salt", "key", F.lit(0).alias("kind"), "stack"))
    before = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(before)).where("kind = 1")
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    # The largest by size, then the smallest string.
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-r["size"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), 1)
    out = swept.withColumn("best", F.when(F.size(fits) > 0, best))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

