"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of turn tokens deal a conversation into blocks of about `block_windows` budgets, so that no row ever
holds a long conversation. Within a block a fold over the turns' tokens lets every window run to the furthest turn
with which the window's system turn, repeated history and own turns fit the budget; no turn is cut. Every window
but a conversation's first repeats the system turn and the last turns before its start, as far as they fit the
history's own bounds and the budget. Repeated turns are context: the loss mask covers the text of assistant turns
where they stand for the first time, and nothing else.

A turn is written `<|im_start|>role NEWLINE text<|im_end|> NEWLINE`. In roles and texts `&` is written `&amp;` and `<|`
is written `&lt;|` (in a role a newline `&#10;`), so that no text can hold a control string; reading reverses
this exactly.

Defined cases: null texts and roles are empty; null turns come first; rows of equal turn are ordered by role
and text. Repeated rows are repeated turns. Only a window of one own turn (besides the system turn) can exceed the
budget, where that turn and the system turn alone do; it repeats no history. A null conversation id is a
conversation like others. An empty table gives no windows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What a turn's own marks count.
TURN_TOKENS = 4


@dataclass(frozen=True)
class ChatParams:
    #: Tokens of a window: system turn, repeated history and own turns.
    budget_tokens: int = 512
    #: Repeated history: at most so many turns and so many tokens.
    history_turns: int = 2
    history_tokens: int = 128
    #: A block of a conversation holds the turns that begin within so many budgets; windows end with their block.
    block_windows: int = 16
    target_role: str = "assistant"
    system_role: str = "system"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Words and single symbols, and the marks around a turn, as a budget measure."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + TURN_TOKENS


def turn_blocks(df: DataFrame, params: ChatParams, conv: str) -> DataFrame:
    """conv, block, turns: the block's turns in order (seq, role, text, tokens, system, own), behind the system turn and
    the turns that its windows may repeat (own is false)."""
    clean = df.select(conv, F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    turns = clean.select("*", F.row_number().over(in_order).cast("long").alias("seq"), token_count(F.col("text")).cast("long").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select("*", F.floor(before / (params.budget_tokens * params.block_windows)).alias("home"), ((F.col("seq") == 1) & (F.col("role") == params.system_role)).alias("system"))
    later = [F.lead("home", k).over(in_order) for k in range(1, params.history_turns + 1)]
    last = F.max("home").over(Window.partitionBy(conv))
    turns = turns.withColumn("blocks", F.array_compact(F.array("home", *later))).withColumn("blocks", F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array_distinct("blocks")))
    rows = turns.withColumn("block", F.explode("blocks")).select(conv, "block", F.struct("seq", "role", "text", "tokens", "system", (F.col("home") == F.col("block")).alias("own")).alias("t"))
    return rows.groupBy(conv, "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _repeated(turns: Column, t: Column, i: Column, params: ChatParams) -> Column:
    """n and tokens of the turns that a window would repeat if it began with turn t at place i."""
    first = F.element_at(turns, 1)
    system = F.when(first["system"] & (t["seq"] > 1), first["tokens"]).otherwise(0)

    def further(s: Column, k: Column) -> Column:
        back = F.get(turns, i - k)
        tokens = s["tokens"] + back["tokens"]
        fits = (s["n"] == k - 1) & ~back["system"] & (tokens - system <= params.history_tokens) & (tokens + t["tokens"] <= params.budget_tokens)
        return F.when(fits, F.struct(k.alias("n"), tokens.alias("tokens"))).otherwise(s)

    reach = F.array(*[F.lit(k) for k in range(1, params.history_turns + 1)]).cast("array<int>")
    return F.aggregate(reach, F.struct(F.lit(0).alias("n"), system.cast("long").alias("tokens")), further)


def format_conversations(df: DataFrame, params: ChatParams = ChatParams(), conv: str = "conv_id") -> DataFrame:
    """One row per window: conv, win (the number of its first own turn, from 1), formatted, n_context (leading
    repeated turns), tokens (of all its turns), loss (start and length, in code points, of each span under the mask)."""
    blocks = turn_blocks(df, params, conv)
    costs = F.transform("turns", lambda t, i: F.struct(t["tokens"].alias("tokens"), (t["own"] & (t["seq"] == 2)).alias("second"), t["own"].alias("own"), i.alias("i"), _repeated(F.col("turns"), t, i, params).alias("again")))
    blocks = blocks.select(conv, "turns", costs.alias("costs"))

    def place(s: Column, t: Column) -> Column:
        # The turn after a system turn always joins it.
        joined = s["used"] + t["tokens"]
        fits = (F.size(s["opens"]) > 0) & ((joined <= params.budget_tokens) | (t["second"] & F.element_at(F.col("turns"), 1)["system"]))
        opened = F.struct(F.concat(s["opens"], F.array(F.struct(t["i"].alias("i"), t["again"]["n"].alias("n")))).alias("opens"), (t["again"]["tokens"] + t["tokens"]).alias("used"))
        return F.when(~t["own"], s).when(fits, F.struct(s["opens"].alias("opens"), joined.alias("used"))).otherwise(opened)

    nothing = F.struct(F.array().cast("array<struct<i:int,n:int>>").alias("opens"), F.lit(0).cast("long").alias("used"))
    blocks = blocks.select(conv, "turns", F.aggregate("costs", nothing, place, lambda s: s["opens"]).alias("opens"))
    cuts = F.transform("opens", lambda o, w: F.struct(o["i"].alias("i"), o["n"].alias("n"), F.coalesce(F.get(F.col("opens"), w + 1)["i"], F.size("turns")).alias("end")))
    named = lambda c, mine: F.transform(c, lambda t: F.struct(F.lit(mine).alias("own"), t["seq"].alias("seq"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))

    def window(cut: Column) -> Column:
        system = F.filter("turns", lambda t: t["system"] & (F.get(F.col("turns"), cut["i"])["seq"] > 1))
        context = F.concat(system, F.slice("turns", cut["i"] - cut["n"] + 1, cut["n"]))
        return F.concat(named(context, False), named(F.slice("turns", cut["i"] + 1, cut["end"] - cut["i"]), True))

    windows = blocks.select(conv, F.explode(F.transform(cuts, window)).alias("turns"))
    own = F.filter("turns", lambda t: t["own"])
    windows = windows.select(conv, F.element_at(own, 1)["seq"].alias("win"), (F.size("turns") - F.size(own)).alias("n_context"), "turns")
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    head = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
    body = F.transform("turns", lambda t: escape(t["text"]))
    windows = windows.select(conv, "win", "n_context", tokens.alias("tokens"), "turns", head.alias("heads"), body.alias("bodies"))
    pieces = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END + "\n")))
    sizes = F.transform(pieces, lambda p: F.length(p).cast("long"))
    windows = windows.select(conv, "win", "n_context", "tokens", "turns", "heads", "bodies", F.array_join(pieces, "").alias("formatted"), sizes.alias("sizes"))
    starts = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    windows = windows.withColumn("starts", starts)
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(
            (F.element_at("starts", i + 1) + F.length(F.element_at("heads", i + 1))).alias("start"),
            F.length(F.element_at("bodies", i + 1)).cast("long").alias("length"),
            (t["own"] & (t["role"] == params.target_role)).alias("target"),
        ),
    )
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"], s["length"]))
    return windows.select(conv, "win", "formatted", "n_context", "tokens", loss.alias("loss"))


def read_turns(windows: DataFrame) -> Column:
    """The turns that stand in `formatted`, parsed from it: array of struct(role, text)."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    bodies = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1))
    return F.transform(
        bodies,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the windows alone: its turns, the text under the loss mask, and the sizes."""
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    whole = windows.select(conv, "win", read_turns(windows).alias("turns"), "n_context", F.array_join(masked, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    parsed = whole.withColumn("turns", F.slice("turns", F.col("n_context") + 1, F.size("turns")))
    per = parsed.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("win", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return per.select(conv, F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars", "n_windows")
