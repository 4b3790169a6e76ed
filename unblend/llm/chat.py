"""Chat formatting with Spark expressions only.

A block is one role's turn, or several of its turns in a row:

    ### User: </role>text</and>text</turn>

with a new line after it. ``#``, ``<`` and backslashes in roles and texts are
written as ``\\h``, ``\\l`` and ``\\b``, so no text can hold a mark and reading back
gives every text unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, ROLE_END, AND, CLOSE = "### ", ": </role>", "</and>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


#: Entries that a running sum copies at a time, and lengths in code points to which a text is cut.
FEW, LONG, SHORT = 64, 1 << 20, 1 << 13


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _cut(text: Column, size: int) -> Column:
    """A text in parts of ``size`` code points, the last one shorter; an empty text is one part."""
    last = F.greatest(F.lit(0), ((F.length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(text, k * size + 1, F.lit(size)))


def _scan(xs: Column) -> Column:
    """What lies before each entry, summed. Every step copies the sums so far, so ``xs`` should be short."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, start, lambda a, x: F.struct((a["n"] + x).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"])


def _starts(sizes: Column, levels: int = 2) -> Column:
    """What lies before each entry of any number of entries, summed: within groups of ``FEW``, and over the groups' sums alike."""
    if not levels:
        return _scan(sizes)
    last = F.greatest(F.lit(0), ((F.size(sizes) - 1) / FEW).cast("int"))
    groups = lambda xs: F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(xs, g * FEW + 1, F.lit(FEW)))
    total = lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x)
    own = lambda gs, before: F.flatten(F.transform(gs, lambda g, i: F.transform(_scan(g), lambda v: v + F.get(before, i))))
    return _let(_let(sizes, groups), lambda gs: _let(_let(F.transform(gs, total), lambda t: _starts(t, levels - 1)), lambda b: own(gs, b)))


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row a conversation: ``conv_col``, formatted and loss_spans, an array of
    (start, length) in code points of ``formatted``, one for each turn of ``trained_role``.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have
    one order and all stay. Null roles and texts count as empty. Turns with a null
    conversation form one conversation with a null id. Other columns are
    ignored. An empty table gives no rows. A conversation is one row of the
    result, so its turns are gathered in one array.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        joins = (i > 0) & (F.get(F.col("t"), i - 1)["role"] == x["role"])
        last = ~F.coalesce(F.get(F.col("t"), i + 1)["role"] == x["role"], F.lit(False))
        head = F.when(joins, F.lit(AND)).otherwise(F.concat(F.lit(OPEN), escape(x["role"]), F.lit(ROLE_END)))
        return F.struct(
            head.alias("head"),
            escape(x["text"]).alias("body"),
            F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            (x["role"] == F.lit(trained_role)).alias("trained"),
        )

    pieces = chats.select("conv", F.transform("t", piece).alias("p"))
    written = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    size = F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"]))
    mark = lambda starts: F.filter(
        F.transform(
            "p",
            lambda x, i: F.when(
                x["trained"], F.struct((F.get(starts, i) + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return pieces.select(F.col("conv").alias(conv_col), written.alias("formatted"), _let(_starts(size), mark).alias("loss_spans"))


def read_chats(chats: DataFrame, text_col: str = "formatted") -> DataFrame:
    """Read formatted conversations back: adds (or replaces) turns, an array of (role,
    text) in order. The inverse of ``format_chats``; null and empty texts have no turns."""
    blocks = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, ROLE_END)
        role = unescape(F.substring(parts[0], len(OPEN) + 1, 1 << 30))
        return F.transform(F.split(parts[1], AND), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return chats.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    Counting code points from the start of a long text for each span would be quadratic, so the
    text is cut into short parts first, and each span is taken from those that it lies in."""
    parts = F.flatten(F.transform(_cut(formatted, LONG), lambda x: _cut(x, SHORT)))

    def taken(parts: Column, s: Column) -> Column:
        start, end = s["start"], s["start"] + s["length"]
        at = F.sequence((start / SHORT).cast("int"), ((end - 1) / SHORT).cast("int"))
        part = lambda k: F.substr(
            F.get(parts, k), F.greatest(start - k * SHORT, F.lit(0)) + 1, F.least(end - k * SHORT, F.lit(SHORT)) - F.greatest(start - k * SHORT, F.lit(0))
        )
        return F.when(s["length"] > 0, unescape(F.array_join(F.transform(at, part), ""))).otherwise("")

    return F.array_join(_let(parts, lambda c: F.transform(spans, lambda s: taken(c, s))), "")


__all__ = ["escape", "unescape", "format_chats", "read_chats", "loss_text"]
