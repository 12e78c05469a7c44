r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
trainable. If turns follow a conversation's last assistant turn, or it has none, one more example without a target
holds the whole conversation, so that nothing is lost.

Template: an assistant turn is <s>ROLE newline TEXT</s>, any other is [INST]ROLE newline TEXT[/INST]. Inside
roles and texts, a backslash is doubled and a backslash is put inside each control string (<s> becomes
<\s>, [/INST] becomes [\/INST]; in roles also before a newline), so a marker is never part of a text; dropping
one backslash of each pair reverses it.

Rules: turns sort by turn, null first; repeated or tied turns stay, in order of role and text; null text and
role count as empty; rows with a null conv_id form one conversation. A row's formatted text grows with its
place in the conversation, as the method asks, and conversations are as large as one row can be. Other columns are
not read. Everything runs in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a turn, and a turn without it. The role's group is possessive, which Java matches in a loop: no stack grows
#: with its length.
END = r"\[/INST\]|</s>"
TURN = r"(?s)^(?:\[INST\]|<s>)((?:[^\\\n]|\\.)*+)\n(.*)$"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    named = F.concat(F.regexp_replace(escape(role), r"\n", "\\\\\\\n"), F.lit("\n"), escape(text))
    return F.when(role == "assistant", F.concat(F.lit("<s>"), named, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), named, F.lit("[/INST]")))


def format_examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars, is_last): the trainable text is the loss_chars
    characters of formatted from loss_start (from 0). is_last marks the example with all turns."""
    rows = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    shown = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(escape(t["text"])).alias("size"), render(t["role"], t["text"]).alias("shown"))).alias("turns"))
    n = F.size("turns")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    each = shown.select("conv_id", "turns", n.alias("n"), F.posexplode(places).alias("example", "k"))
    last = F.element_at("turns", F.col("k"))
    target = last["role"] == "assistant"
    formatted = F.array_join(F.transform(F.slice("turns", 1, F.col("k")), lambda t: t["shown"]), "")
    out = each.select("conv_id", "example", formatted.alias("formatted"), F.when(target, last["size"]).otherwise(0).alias("loss_chars"), (F.col("k") == F.col("n")).alias("is_last"))
    return out.select("conv_id", "example", "formatted", F.when(F.col("loss_chars") > 0, F.length("formatted") - F.col("loss_chars") - len("</s>")).otherwise(0).alias("loss_start"), "loss_chars", "is_last")


def _by_turn(a: Column, b: Column) -> Column:
    def less(x: Column, y: Column) -> Column:
        return (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))

    out = F.lit(0)
    for name in ("text", "role", "turn"):
        out = F.when(less(a[name], b[name]), -1).when(less(b[name], a[name]), 1).otherwise(out)
    return out


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted_chars): turns (role, text) parsed from the example with all turns, and the
    text under each example's loss mask, in order; both unescaped."""
    cut = F.split("formatted", END, -1)  # what follows the last end is empty
    turns = F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda t: F.struct(unescape(F.regexp_extract(t, TURN, 1)).alias("role"), unescape(F.regexp_extract(t, TURN, 2)).alias("text")))
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    read = examples.select("conv_id", "example", F.length("formatted").alias("chars"), F.when(F.col("is_last"), turns).alias("turns"), loss.alias("loss"))
    grouped = read.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "turns", F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")
