"""Chat formatting in budgeted windows (DataFrame functions only).

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so control strings occur only where the
template put them, and reading back is exact.

Prefix sums of turn tokens choose the windows. Turns of up to ``stride`` tokens are grouped
by the stride in which they start, so that a window holds at most two strides; a longer
turn has a window of its own. Every window after the first repeats the leading system turn
and up to HISTORY turns (within HISTORY_TOKENS) before it. The stride leaves room for both
in the budget; a turn or system turn that is larger than the budget itself is never cut.

The loss mask lists the spans (code points) of assistant texts that are new in a window;
repeated turns are never under it.

Defined results: null text or role is empty; a null turn sorts first, equal turns by role
and text; a null conv_id is one conversation; repeated rows are turns of their own; empty
tables give no windows; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 2
HISTORY_TOKENS = 256
#: Tokens that the template adds to a turn.
MARKUP = 5
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(text: Column) -> Column:
    """An estimate that is never below the words: four characters a token, or the words if they are more."""
    return F.greatest(F.ceil(F.length(text) / 4), F.regexp_count(text, F.lit(r"\S+"))) + MARKUP


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window, repeated (turns at its beginning that aren't new), text and loss spans."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("tokens", tokens_of(F.col("text"))).withColumn("place", F.row_number().over(order))
    turns = turns.withColumn("start", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    first = F.first(F.struct("role", "text", "tokens")).over(order)
    turns = turns.withColumn("system", F.when(first["role"] == "system", first))
    room = F.greatest(F.lit(64), ((F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0))) / 2).cast("int"))
    turns = turns.withColumn("stride", room)
    turns = turns.withColumn("large", F.sum(F.when(F.col("tokens") > F.col("stride"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("group", F.struct((F.col("large") * 2 - F.when(F.col("tokens") > F.col("stride"), 1).otherwise(0)).alias("part"), F.when(F.col("tokens") > F.col("stride"), -1).otherwise(F.floor(F.col("start") / F.col("stride"))).alias("span")))
    turns = turns.withColumn("opens", F.coalesce(F.lag("group").over(order) != F.col("group"), F.lit(True)))
    turns = turns.withColumn("window", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # A turn is in its own window and, as history, in those that open within the next turns.
    uses = [F.struct(F.col("window").alias("window"), F.lit(True).alias("new"))]
    is_system = F.col("system").isNotNull() & (F.col("place") == 1)
    for k in range(1, history + 1):
        turns = turns.withColumn(f"later{k}", F.lead(F.struct("opens", "start", "window"), k).over(order))
        later = F.col(f"later{k}")
        near = later["opens"] & (later["start"] - F.col("start") <= history_tokens) & ~is_system
        uses.append(F.when(near, F.struct(later["window"].alias("window"), F.lit(False).alias("new"))))
    turns = turns.withColumn("use", F.explode(F.filter(F.array(*uses), lambda u: u.isNotNull())))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    rows = turns.select(
        "conv_id", F.col("use.window").alias("window"), F.col("use.new").alias("new"), "place", "system",
        head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"),
    )
    made = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "new", "head", "body", "target"))).alias("turns"), F.first("system", ignorenulls=True).alias("system")
    )
    lead_in = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.concat(F.lit(START + "system\n"), escape(F.col("system.text")), F.lit(END + "\n"))).otherwise(F.lit(""))
    made = made.withColumn("lead_in", lead_in)
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    text = F.concat(F.col("lead_in"), F.array_join(F.transform("turns", piece), ""))
    # The start of each text: running length over the turns before it.
    spans = F.aggregate(
        "turns",
        F.struct(F.length("lead_in").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("at"),
            F.when(t["new"] & t["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    repeated = F.size(F.filter("turns", lambda t: ~t["new"])) + F.when(F.col("lead_in") != "", 1).otherwise(0)
    return made.select("conv_id", "window", repeated.cast("int").alias("repeated"), text.alias("text"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests of the turns and of the text under the loss mask, and sizes, from the windows' texts alone."""
    pieces = F.slice(F.split("text", r"<\|im_end\|>\n"), F.col("repeated") + 1, F.lit(1 << 30))
    # split leaves an empty piece after the last turn
    new = F.filter(pieces, lambda p: F.startswith(p, F.lit(START)))
    turn = lambda p: F.concat(unescape(F.substring(p, len(START) + 1, F.length(p))), F.lit("\n"))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    parts = formatted.select("conv_id", "window", F.size(new).alias("n"), F.array_join(F.transform(new, turn), "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "n", "turns", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_turns"),
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def control_case(conversations: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    rows = conversations.sparkSession.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{CONTROL}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{CONTROL}'")
    return conversations.select("conv_id", "turn", "role", "text").union(rows)

