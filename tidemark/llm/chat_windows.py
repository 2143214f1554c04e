"""Chat formatting in budgeted windows, built from DataFrame functions only.

Prefix sums of turn tokens choose the spans: a turn belongs to the stride of tokens in which it starts, and one that
reaches more than half a stride beyond the end is a span of its own, so spans are turn-aligned and at most one and a
half strides long unless a single turn is longer. Each span becomes a window: the system turn again, then the
last earlier turns that fit the history limit and the budget, then its own turns. Only assistant texts of a window's own
turns are under the loss mask; repeated ones are masked, so every target counts once.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts, each control string gets one more backslash after its
first character (``<|`` becomes ``<\\|``), which is undone by taking one away; newlines in roles become ``%0A``.
Tokens are estimated as pieces of up to four characters that are not white space, plus ``TURN_TOKENS`` per turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import running

BUDGET = 512
HISTORY = 128
TURN_TOKENS = 4
BUCKET_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PIECE = "[^\\x20\\x09-\\x0D]{1,4}"
# What follows the first character of a control string: of the template's own kind, and of two other common templates.
_REST = "(?=\\||/?s>|/?INST\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[])(\\\\*)" + _REST, "$1$2\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[])(\\\\*)\\\\" + _REST, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(PIECE)) + TURN_TOKENS).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, n_tokens, text, loss) of all conversations.

    ``window`` is the number of the window's first own turn, ``n_turns`` counts its own turns, ``n_repeated`` the turns put
    again before them, ``loss`` lists (start, length) in code points of ``text``. The first turn is the system
    turn if its role is system. A window is over budget only if one turn and the system turn already are.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order; null roles
    and texts are empty; rows with a null conv_id form one conversation. Other columns are not read; no rows: no rows.
    """
    c = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    first = F.lit(-(1 << 62)).cast("long")
    rows = turns.select(
        c.alias("c"),
        F.coalesce(F.col("turn").cast("long"), first).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("bucket", F.floor(F.col("turn") / BUCKET_TURNS))
    rows = rows.withColumn("tokens", tokens(F.col("text")))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    placed = running(rows, "c", "bucket", order, {"n": F.lit(1), "before": F.col("tokens")}).drop("bucket", "turn")
    placed = placed.withColumn("system", (F.col("n") == 0) & (F.col("role") == "system"))
    heads = placed.where("system").select("c", F.col("role").alias("s_role"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens"))
    known = placed.join(heads.select("c", "s_tokens"), "c", "left").withColumn("s_tokens", F.coalesce("s_tokens", F.lit(0)))
    known = known.withColumn("stride", F.greatest(F.floor((budget - F.col("s_tokens")) / 2), F.lit(max(1, budget // 8))))
    known = known.withColumn("start", F.when(F.col("system"), F.lit(0)).otherwise(F.col("before") - F.col("s_tokens")))
    known = known.withColumn("end", F.when(F.col("system"), F.lit(0)).otherwise(F.col("start") + F.col("tokens"))).drop("before")
    cell = F.floor(F.col("start") / F.col("stride"))
    known = known.withColumn("cell", cell).withColumn("alone", F.col("end") > (cell + 1) * F.col("stride") + F.floor(F.col("stride") / 2))
    spans = known.groupBy("c", "cell", "alone").agg(
        F.min("n").alias("window"), F.min("start").alias("low"), F.max("end").alias("high"), F.max("s_tokens").alias("s_tokens")
    )
    own = known.join(spans.select("c", "cell", "alone", "window"), ["c", "cell", "alone"])
    own = own.select("c", "window", "n", F.lit(False).alias("again"), "role", "text", "tokens")
    # History: a turn is met by the few strides in which a span may begin within ``history`` tokens of it.
    reach = F.sequence(F.floor(F.col("end") / F.col("stride")), F.floor((F.col("start") + history) / F.col("stride")))
    near = known.where(~F.col("system") & (F.col("end") <= F.col("start") + history)).select("c", "n", "role", "text", "tokens", "start", "end", F.explode(reach).alias("cell"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("s_tokens") - (F.col("high") - F.col("low"))))
    limits = spans.select("c", "cell", "window", "low", room.alias("room"))
    past = near.join(limits, ["c", "cell"]).where((F.col("end") <= F.col("low")) & (F.col("start") >= F.col("low") - F.col("room")))
    past = past.select("c", "window", "n", F.lit(True).alias("again"), "role", "text", "tokens")
    system = spans.where("window > 0").select("c", "window").join(heads, "c")
    system = system.select("c", "window", F.lit(0).cast("long").alias("n"), F.lit(True).alias("again"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"))
    parts = own.unionByName(past).unionByName(system)
    parts = parts.select("c", "window", "n", "again", "tokens", F.col("role") == "assistant", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text")).toDF(
        "c", "window", "n", "again", "tokens", "target", "role", "text"
    )
    parts = parts.withColumn("piece", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)))
    line = Window.partitionBy("c", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(line), F.lit(0)) + len(OPEN) + F.length("role") + 1
    mask = F.when(F.col("target") & ~F.col("again"), F.struct(at.alias("start"), F.length("text").cast("long").alias("length")))
    parts = parts.withColumn("mask", mask)
    # A window holds no more turns than its budget has turn tokens, so its list is bounded.
    grouped = parts.groupBy("c", "window").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece", "mask"))).alias("turns"),
        F.sum((~F.col("again")).cast("long")).alias("n_turns"),
        F.sum(F.col("again").cast("long")).alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    )
    return grouped.select(
        F.when(F.col("c") != "null", F.col("c").cast("long")).alias("conv_id"),
        "window",
        "n_turns",
        "n_repeated",
        "n_tokens",
        F.array_join(F.col("turns.piece"), "").alias("text"),
        F.filter(F.col("turns.mask"), lambda m: m.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) from windows alone, one row per conversation.

    ``turns`` is role, newline, text, newline of every turn once, ``loss`` all text under the mask; both unescaped and in
    order. The whole text of a conversation must fit one value.
    """
    parsed = F.slice(F.split("text", "<\\|im_start\\|>"), F.col("n_repeated").cast("int") + 2, F.col("n_turns").cast("int"))

    def turn(part: Column) -> Column:
        cut = F.instr(part, F.lit("\n"))
        role, text = F.substr(part, F.lit(1), cut - 1), F.substr(part, cut + 1, F.length(part) - cut - len(CLOSE))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    under = F.transform("loss", lambda m: unescape(F.substr(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    rows = formatted.select(
        "conv_id", "window", "n_turns", F.array_join(F.transform(parsed, turn), "").alias("turns"), F.array_join(under, "").alias("loss"), F.length("text").alias("chars")
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return grouped.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
