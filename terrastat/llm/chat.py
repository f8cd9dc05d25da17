"""Chat formatting in budgeted windows, with DataFrame functions alone.

A conversation becomes one or more windows of whole turns that a model can be trained on. Prefix
sums of turn tokens choose the spans: turns whose sum begins in the same slot of ``room`` tokens
stand together, and a turn longer than that stands alone. Each window repeats the system turn and
then the last turns of the window before, as many as fit in ``history`` tokens. The loss mask covers
the assistant turns that are new in the window; repeated ones are masked, so each is learned once.

A slot's turns take less than twice ``room``, which is half of what the system turn and the history
leave of the budget. So a window exceeds its budget only where one turn alone does.

A turn is written as ``<|im_start|>role``, a line break, its text and ``<|im_end|>``, a line break.
Wherever a text has ``<``, any number of backslashes and ``|``, one backslash more is written, so no
text can hold a control string, and taking that one out again gives the text back. In roles ``%``,
``|`` and the line break are written as ``%25``, ``%7C`` and ``%0A``.

Rows are dealt by conversation and block of BLOCK_TURNS turn numbers, so a conversation that holds a
third of all rows is many tasks. A block begins with a window of its own, without history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col

BUDGET = 1024
HISTORY = 128
BLOCK_TURNS = 1 << 16
#: Tokens of a turn besides its text: two markers, the role and the line breaks.
MARK_TOKENS = 4
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
_FIRST = -(1 << 63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def quarter_bytes(text: Column) -> Column:
    """An estimate of a text's tokens: one for each four bytes begun."""
    return F.shiftright(F.octet_length(text) + 3, 2)


def _written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens: Callable[[Column], Column]) -> DataFrame:
    role = F.coalesce(col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    plain = df.select(
        col(conv_col).alias("conv_id"),
        # A text that is never NULL, so that joins and groups treat a NULL conversation as one more.
        F.coalesce(F.concat(F.lit("="), col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.floor(col(turn_col).cast("double") / BLOCK_TURNS).cast("bigint"), F.lit(_FIRST)).alias("block"),
        col(turn_col).alias("turn"),
        escape_role(role).alias("role"),
        escape(text).alias("text"),
    )
    return plain.withColumn("tokens", tokens(F.col("text")).cast("bigint") + MARK_TOKENS)


def _blocks(turns: DataFrame, most_tokens: int) -> DataFrame:
    """(key, block, parts, first_block, system, system_tokens): a row for each block, few bytes each.

    ``system`` is the conversation's first turn if that is a system turn of at most ``most_tokens``;
    one of several first system turns is not retained if any of them is longer.
    """
    held = F.when((F.col("role") == SYSTEM) & (F.col("tokens") <= most_tokens), F.struct("text", "tokens"))
    blocks = turns.groupBy("key", "block").agg(F.min(F.struct("turn", "role", held.alias("held"))).alias("head"))
    whole = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = blocks.select(
        "key",
        "block",
        F.count(F.lit(1)).over(whole).alias("parts"),
        F.first("block").over(whole).alias("first_block"),
        F.first("head").over(whole).alias("head"),
    )
    return told.select(
        "key",
        "block",
        "parts",
        "first_block",
        F.col("head.held.text").alias("system"),
        F.coalesce(F.col("head.held.tokens"), F.lit(0)).alias("system_tokens"),
    )


def chat_windows(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Callable[[Column], Column] = quarter_bytes,
) -> DataFrame:
    """(conv_id, key, block, parts, window, formatted, turns, repeated, loss), a row for each window.

    ``turns`` counts the written turns, the first ``repeated`` of which are the system turn and the
    history; ``loss`` lists begin and end (code points of ``formatted``) of the texts to learn.
    ``key`` tells conversations apart, ``parts`` is the number of their blocks, ``window`` counts
    from 1 within a block. ``tokens`` gives the tokens of a (written) text.

    Turns stand in order of turn, role and text, so ties and repeated rows have a place; a NULL turn
    comes first. NULL roles and texts are empty, a NULL conversation is one conversation. Turn
    numbers must be whole. A system turn of more than half the budget is not repeated. Other columns
    are ignored, and an empty table has no window. Texts are shuffled once, besides them only a row
    for each block; of the turns with numbers in one block of a conversation one task takes care.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("the history may take a quarter of the budget at most")
    turns = _turns(df, conv_col, turn_col, role_col, text_col, tokens)
    joined = turns.join(_blocks(turns, budget // 2), ["key", "block"])

    # With the number of parts among the keys, a filter on it reaches the blocks, before any text.
    keys = ["key", "block", "parts"]
    place = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    sofar = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2)
    chars = F.length("role") + F.length("text") + len(f"{START}\n{END}\n")
    summed = joined.withColumn("chars", chars.cast("bigint")).select(
        "*",
        F.row_number().over(place).alias("n"),
        (F.sum("tokens").over(sofar) - F.col("tokens")).alias("before"),
        (F.sum("chars").over(sofar) - F.col("chars")).alias("chars_before"),
    )
    spans = summed.withColumns(
        {
            "slot": F.floor(F.col("before") / room),
            "long": F.col("tokens") > room,
            "is_head": (F.col("n") == 1) & (F.col("block") == F.col("first_block")) & F.col("system").isNotNull(),
        }
    )
    begins = (
        F.lag("slot").over(place).isNull()
        | (F.lag("slot").over(place) != F.col("slot"))
        | F.lag("long").over(place)
        | F.col("long")
    )
    numbered = spans.withColumn("begins", begins).withColumn("window", F.sum(F.col("begins").cast("bigint")).over(sofar))

    turn = F.struct("n", "role", "text", "before", "tokens", "chars_before", "is_head")
    windows = numbered.groupBy(*keys, "window").agg(
        F.sort_array(F.collect_list(turn)).alias("new"),
        *[F.first(c).alias(c) for c in ("conv_id", "system")],
    )
    last = F.element_at("new", -1)
    tail = F.filter("new", lambda t: (last["before"] + last["tokens"] - t["before"] <= history) & ~t["is_head"])
    follows = Window.partitionBy(*keys).orderBy("window")
    nothing = F.filter(F.transform("new", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), lambda t: F.lit(False))
    tailed = windows.withColumn("tail", F.transform(tail, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    system = F.array(F.struct(F.lit(SYSTEM).alias("role"), F.col("system").alias("text")))
    repeats = F.col("system").isNotNull() & ~F.col("new")[0]["is_head"]
    told = tailed.withColumn(
        "again", F.concat(F.when(repeats, system).otherwise(nothing), F.coalesce(F.lag("tail").over(follows), nothing))
    )
    parts = told.withColumn("prefix", F.array_join(F.transform("again", lambda t: _written(t["role"], t["text"])), "")).withColumn(
        "shift", F.length("prefix") - F.col("new")[0]["chars_before"] + len(START) + 1
    )
    begin = lambda t: F.col("shift") + t["chars_before"] + F.length(t["role"])
    return parts.select(
        "conv_id",
        "key",
        "block",
        "parts",
        "window",
        F.concat("prefix", F.array_join(F.transform("new", lambda t: _written(t["role"], t["text"])), "")).alias("formatted"),
        (F.size("again") + F.size("new")).alias("turns"),
        F.size("again").alias("repeated"),
        F.transform(
            F.filter("new", lambda t: t["role"] == TARGET),
            lambda t: F.struct(begin(t).alias("begin"), (begin(t) + F.length(t["text"])).alias("end")),
        ).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """(key, block, window, formatted, new, learned): what stands in ``formatted`` alone, given the counts and the mask.

    ``new`` are the (role, text) of the turns that are not repeated, ``learned`` the texts under the
    loss mask, both unescaped.
    """
    written = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("repeated") + 1, F.col("turns") - F.col("repeated"))
    line = lambda m: F.instr(m, F.lit("\n"))
    new = F.transform(
        written,
        lambda m: F.struct(
            unescape_role(F.substr(m, F.lit(len(START) + 1), line(m) - len(START) - 1)).alias("role"),
            unescape(F.substr(m, line(m) + 1)).alias("text"),
        ),
    )
    learned = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))
    )
    return windows.select("conv_id", "key", "block", "parts", "window", "formatted", new.alias("new"), learned.alias("learned"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows.

    A digest needs the whole conversation in one row, which Spark limits to 2 GB. Conversations of
    one block, all but the longest, are read where their windows are; only the others are shuffled.
    """
    lines = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_turns(windows).select(
        "conv_id",
        "key",
        "block",
        "parts",
        F.struct("block", "window", lines.alias("lines"), F.array_join("learned", "").alias("learned")).alias("said"),
        F.size("new").cast("bigint").alias("n_turns"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_turns", "formatted_chars")]
    in_order = F.sort_array(F.collect_list("said"))
    ones = read.where(F.col("parts") == 1).groupBy("key", "block").agg(F.first("conv_id").alias("conv_id"), in_order.alias("said"), *sums)
    several = read.where(F.col("parts") > 1).groupBy("key").agg(F.first("conv_id").alias("conv_id"), in_order.alias("said"), *sums)
    columns = ["conv_id", "said", "n_turns", "formatted_chars"]
    joined = lambda field: F.array_join(F.transform("said", lambda s: s[field]), "")
    return (
        ones.select(*columns)
        .unionAll(several.select(*columns))
        .withColumns({"lines": joined("lines"), "learned": joined("learned")})
        .select(
            "conv_id",
            "n_turns",
            F.sha2("lines", 256).alias("turns_sha256"),
            F.length("learned").cast("bigint").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
