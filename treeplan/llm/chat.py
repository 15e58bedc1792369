"""Chat conversations as training windows of a bounded size, in DataFrame functions only.

Template: <|start|>role, a line end, text, <|end|>, a line end, for each turn. A control
string inside a role or text (the template's own, or one of the common templates below)
gets a backslash after its first character, one more if it had some already; reading back
removes one. Escaped texts hold no control string, and every text comes back as it was.

Windows: prefix sums of the turns' costs, in order, decide where a window ends: at the last
turn with which its new turns still fit what the system turn and the repeated history leave
of the budget. Windows after the first repeat the system turn and the last turns before, as
far as history_budget and max_history allow. The loss mask covers the assistant's texts in
a window's new turns only, so each is trained on exactly once. A single turn larger than
the room gets a window of its own, over the budget; texts are never cut.

A turn's cost is a bound of its tokens: its UTF-8 bytes, which no byte-level vocabulary
exceeds, or a column of token counts that is given.

A conversation is numbered as one sorted stream and gathered nowhere: windows are planned
from the numbers of STRETCH turns at a time (a window also ends where a stretch does),
texts are dealt by turn and meet again by window. Only the digests of read_back() need a
whole conversation in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings by first character and rest.
START, END = "<|start|>", "<|end|>\n"
#: Turns whose numbers are planned in one row.
STRETCH = 4096


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(<)(\\*)(?=\||/?s>|</?SYS>>)", r"$1\\$2"), r"(\[)(\\*)(?=/?INST\])", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(<)\\(\\*)(?=\||/?s>|</?SYS>>)", "$1$2"), r"(\[)\\(\\*)(?=/?INST\])", "$1$2")


def escaped_role(role: Column) -> Column:
    """Also on one line: a backslash is \\b, a line end \\n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def by_bytes(formatted: Column) -> Column:
    """A turn's cost: its bytes, so at least as many as its tokens."""
    return F.octet_length(formatted).cast("long")


def _starts(turns: Column) -> Column:
    """Places of the first new turn of each window; turns: array of struct(place, cost, room), where room is what a
    window that begins there has for new turns."""
    none = F.struct(F.array().cast("array<long>").alias("starts"), F.lit(-1).cast("long").alias("left"))

    def step(s: Column, t: Column) -> Column:
        opened = F.struct(F.concat(s["starts"], F.array(t["place"])).alias("starts"), (t["room"] - t["cost"]).alias("left"))
        return F.when(t["cost"] > s["left"], opened).otherwise(F.struct(s["starts"].alias("starts"), (s["left"] - t["cost"]).alias("left")))

    return F.aggregate(turns, none, step, lambda s: s["starts"])


def windows(turns: DataFrame, budget: int = 4096, history_budget: int = 1024, max_history: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cost_col: str | None = None) -> DataFrame:
    """One row for each window: conv_id, window (from 0), formatted, n_repeated (turns at its start that
    were in a window before), loss: array of (start, stop), code points of the assistant's texts to learn.

    cost_col: tokens of the formatted turn; without it or where it is null, bytes.

    Turns are ordered by turn, then role, then text (nulls first); a null role or text is empty; rows
    with a null conv_id are one conversation; repeated rows are turns of their own; an empty
    table gives no rows; other columns are not looked at. A very long text is a window of its own.
    """
    c = F.coalesce(F.col(conv_col).cast("string"), F.lit("null"))
    given = F.lit(None) if cost_col is None else F.col(cost_col)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), c.alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), given.cast("long").alias("cost"))
    shown = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = rows.withColumn("cost", F.coalesce("cost", by_bytes(shown))).withColumns({
        "place": (F.row_number().over(order) - 1).cast("long"), "system": F.first("role").over(order) == "system", "head": F.first("cost").over(order),
        **{f"back{k}": F.lag("cost", k).over(order) for k in range(1, max_history + 1)},
    })

    # the turns before a window that begins here: as many as fit, the system turn not among them
    least = F.when(F.col("system"), 1).otherwise(0)
    sums, past, spent = F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long")
    for k in range(1, max_history + 1):
        sums = sums + F.col(f"back{k}")
        fits = (F.col("place") - k >= least) & (sums <= history_budget)
        past, spent = F.when(fits, k).otherwise(past), F.when(fits, sums).otherwise(spent)
    room = F.when(F.col("place") == 0, budget).otherwise(budget - F.when(F.col("system"), F.col("head")).otherwise(0) - spent)
    numbers = placed.select("conv", "place", "system", "cost", past.alias("past"), room.cast("long").alias("room"))
    stretches = numbers.groupBy("conv", F.floor(F.col("place") / STRETCH).alias("stretch")).agg(F.first("system").alias("system"), F.sort_array(F.collect_list(F.struct("place", "cost", "room", "past"))).alias("t"))
    stretches = stretches.withColumn("starts", _starts(F.col("t")))
    base, after = F.element_at("t", 1)["place"], F.element_at("t", -1)["place"] + 1
    begun = lambda s, i: F.struct(s.alias("start"), (F.coalesce(F.get("starts", i + 1), after) - 1).alias("last"), F.get("t", (s - base).cast("int"))["past"].alias("past"))
    spans = stretches.select("conv", "system", F.inline(F.transform("starts", begun)))

    start, turn = F.col("start"), lambda p, again: F.struct(p.cast("long").alias("place"), F.lit(again).alias("again"))
    nothing = F.array().cast("array<struct<place:long,again:boolean>>")
    head = F.when(F.col("system") & (start > 0), F.array(turn(F.lit(0), True))).otherwise(nothing)
    before = F.when(F.col("past") > 0, F.transform(F.sequence(start - F.col("past"), start - 1), lambda p: turn(p, True))).otherwise(nothing)
    uses = spans.select("conv", "start", F.inline(F.concat(head, before, F.transform(F.sequence(start, F.col("last")), lambda p: turn(p, False)))))
    texts = uses.join(placed.select("conv", "place", "conv_id", "role", "text"), ["conv", "place"])
    gathered = texts.groupBy("conv", "start").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("place", "again", "role", "text"))).alias("t"))
    gathered = gathered.withColumn("window", (F.row_number().over(Window.partitionBy("conv").orderBy("start")) - 1).cast("int"))

    def said(t: Column) -> Column:
        return F.struct(t["again"].alias("again"), F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn"))

    parts = gathered.select("conv_id", "window", F.transform("t", said).alias("t"))

    def add(s: Column, t: Column) -> Column:
        at = s["at"] + F.char_length(t["head"])
        stop = at + F.char_length(t["body"])
        more = F.when(t["learn"] & ~t["again"], F.concat(s["loss"], F.array(F.struct(at.alias("start"), stop.alias("stop"))))).otherwise(s["loss"])
        return F.struct((stop + len(END)).alias("at"), more.alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))
    return parts.select(
        "conv_id", "window", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("t", lambda t: t["again"])).alias("n_repeated"), F.aggregate("t", zero, add, lambda s: s["loss"]).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The window's turns, read back: array of (role, text)."""
    bodies = F.slice(F.split(formatted, r"<\|start\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|start\|>", -1)))

    def one(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        text = F.substr(b, F.char_length(role) + 2, F.char_length(b) - F.char_length(role) - 1 - len(END))
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, one)


def read_back(made: DataFrame) -> DataFrame:
    """From windows alone, one row for each conversation: conv_id, n_turns, turns_sha256 (of role, line end,
    text, line end of each turn), loss_chars, loss_sha256 (of all text under the mask, unescaped),
    formatted_chars.

    Windows with a null conv_id are one conversation; no windows give no rows. A digest needs all text of its
    conversation, so that is one value."""
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    turns = turns_of(F.col("formatted"))
    rows = made.select("conv_id", "window", F.char_length("formatted").cast("long").alias("chars"), F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns), F.lit(1))).alias("turns"), F.array_join(learned, "").alias("learned"))
    rows = rows.select("conv_id", "window", "chars", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "learned")
    both = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"))
    said, learned = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learned"), "")
    return both.select("conv_id", "n_turns", F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(F.encode(learned, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
