"""Chat formatting with budgeted windows, DataFrame functions only.

Turns get a token estimate and, per conversation, a prefix sum of it. The sum cuts the conversation into
windows at turn borders: a window's new turns take at most ``budget`` tokens, unless a single turn is longer, which then
is a window of its own. Every later window repeats the first system turn and, within ``history`` tokens, the turns before
it. Only assistant turns that are new in the window are under the loss mask, so each target counts once.

Template: ``<|im_start|>role LF text<|im_end|>LF`` for each turn. In roles and texts ``&`` becomes ``&amp;``, every control string (those of this
template and of common others) gets ``&;`` after its first character, and a line feed in a role becomes ``&n;``:
no text can open or close a turn, and :func:`read_windows` restores all of them exactly.

Long conversations: prefix sums run in blocks of ``BLOCK_TURNS`` turn numbers with block offsets, so one conversation
spreads over tasks; only a result that is one value per conversation (a digest) needs it in one place.

Results: null roles and texts are empty strings; a null conversation id is a conversation, null turn numbers come first; rows with the same
turn number are ordered by role and text and all kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailscope.llm.common import pick, store

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, TURN_TOKENS = 1024, 512, 4
BLOCK_TURNS = 256
#: First characters of control strings: ``<|...``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]``, ``[/INST]``.
_CONTROL = r"(<(?=\||/?s>|</?SYS>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), _CONTROL, "$1&;")


def unescape(text: Column) -> Column:
    steps = (("&n;", "\n"), ("&;", ""), ("&amp;", "&"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def turn_tokens(text: Column) -> Column:
    """Token estimate: words and single marks, plus the template's share."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + TURN_TOKENS).cast("long")


def _placed(turns: DataFrame, budget: int) -> DataFrame:
    """Turns with idx (1..n), start (tokens before) and their window's key; blockwise prefix sums."""
    half = budget // 2
    rows = pick(turns, conv="conv_id", turn="turn", role="role", text="text").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumn("tok", turn_tokens(F.col("text"))).withColumns({"blk": F.floor(F.col("turn") / BLOCK_TURNS), "long_turn": (F.col("tok") > half).cast("int")})
    sums = {"tok": "tok", "n": F.lit(1), "long": "long_turn"}
    blocks = rows.groupBy("conv", "blk").agg(*[F.sum(c).alias(f"b_{k}") for k, c in sums.items()])
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("b_conv"), F.col("blk").alias("b_blk"), *[F.coalesce(F.sum(f"b_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in sums])
    inside = Window.partitionBy("conv", "blk").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"r_{k}": F.sum(F.col(c) if isinstance(c, str) else c).over(inside) for k, c in sums.items()})
    rows = rows.join(blocks, F.expr("conv <=> b_conv AND blk <=> b_blk"))
    return rows.select(
        "conv", "role", "text", "tok", "long_turn",
        (F.col("o_n") + F.col("r_n")).alias("idx"),
        (F.col("o_tok") + F.col("r_tok") - F.col("tok")).alias("start"),
        (F.col("o_long") + F.col("r_long")).alias("longs"),
    ).withColumn("slot", F.floor(F.col("start") / half))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (1-based position of its first new turn), n_repeat, formatted, loss_spans (start, length in code points).

    A long turn is alone in its window, so the turns of a window start within half the budget of each other and
    the last one adds at most the other half.
    """
    placed = store(_placed(turns, budget), "chat-turns")  # read by each of the joins below
    key = ["conv", "slot", "longs", "long_turn"]
    fresh = placed.groupBy(*key).agg(F.min("idx").alias("window"), F.min("start").alias("w_start"), F.collect_list(F.struct(F.lit(2).alias("kind"), "idx", "role", "text")).alias("turns"))
    windows = fresh.select(F.col("conv").alias("w_conv"), "window", "w_start")
    system = placed.where("role = 'system'").groupBy("conv").agg(F.min_by(F.struct("idx", "role", "text"), "idx").alias("sys"))
    # Stored, so that the joins below start from plain exchanges and a hot conversation can be split.
    system = store(system.select(F.col("conv").alias("s_conv"), "sys"), "chat-system")
    # Earlier turns that end at the window's start and together take at most `history` tokens.
    buckets = F.array_distinct(F.array(F.floor((F.col("w_start") - 1) / history), F.floor(F.col("w_start") / history) - 1))
    wanted = windows.where("w_start > 0").withColumn("bucket", F.explode(buckets))
    earlier = placed.withColumn("e_bucket", F.floor(F.col("start") / history))
    near = earlier.join(wanted, F.expr("conv <=> w_conv AND e_bucket = bucket")).where(f"start < w_start AND w_start - start <= {int(history)} AND idx < window")
    near = near.join(system, F.expr("conv <=> s_conv"), "left").where("sys IS NULL OR sys.idx <> idx")
    old = near.select("conv", "window", F.struct(F.lit(1).alias("kind"), "idx", "role", "text").alias("t"))
    kept = windows.join(system, F.expr("w_conv <=> s_conv")).where("sys.idx < window")
    kept = kept.select(F.col("w_conv").alias("conv"), "window", F.struct(F.lit(0).alias("kind"), F.col("sys.idx").alias("idx"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text")).alias("t"))
    repeats = old.unionByName(kept).groupBy("conv", "window").agg(F.collect_list("t").alias("old")).withColumnsRenamed({"conv": "o_conv", "window": "o_window"})
    rows = fresh.join(repeats, F.expr("conv <=> o_conv AND window = o_window"), "left")
    rows = rows.withColumn("all", F.array_sort(F.concat(F.coalesce("old", F.array().cast("array<struct<kind:int,idx:bigint,role:string,text:string>>")), "turns")))
    pieces = F.transform("all", lambda t: F.struct(
        F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&n;")), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"),
        ((t["kind"] == 2) & (t["role"] == "assistant")).alias("loss"),
    ))
    rows = rows.withColumn("pieces", pieces)
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.lit(len(CLOSE))
    sizes = F.transform("pieces", size)
    spans = F.transform("pieces", lambda p, i: F.struct(
        (F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda x, y: x + y) + F.char_length(p["head"])).alias("start"),
        F.char_length(p["body"]).alias("length"), p["loss"].alias("loss"),
    ))
    return rows.select(
        F.col("conv").alias("conv_id"), "window",
        F.size(F.filter("all", lambda t: t["kind"] < 2)).alias("n_repeat"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse formatted windows back: conv_id, window, formatted, turns (role, text; repeats left out), loss (the unescaped text under the mask)."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p.startswith(OPEN))
    heads = F.transform(parts, lambda p: F.substring_index(p, "\n", 1))
    turns = F.zip_with(parts, heads, lambda p, h: F.struct(
        unescape(F.substr(h, F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(p, F.char_length(h) + 2)).alias("text"),
    ))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", "formatted", F.slice(turns, F.col("n_repeat") + 1, F.size(turns)).alias("turns"), F.array_join(loss, "").alias("loss"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: counts and digests of turns and targets."""
    read = read_windows(windows)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read.select("conv_id", F.size("turns").alias("n"), F.char_length("loss").alias("c"), F.char_length("formatted").alias("f"), F.struct("window", flat.alias("flat"), "loss").alias("w"))
    joined = lambda field: F.sha2(F.array_join(F.transform("ws", lambda w: w[field]), ""), 256)
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("c").alias("loss_chars"), F.sum("f").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    return whole.select("conv_id", "n_turns", joined("flat").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars")
