"""Chat formatting by prefix-target expansion. DataFrame functions only.

Each assistant turn becomes an example of its own (``prefix_targets``): its
text is all turns before it, the context, and then its reply, which alone is
trainable. Examples are made one after the other, so a task holds one
conversation and one example; their whole length grows with the square of a
conversation's turns, as the method has it. ``examples`` is a shorter form for
storage: an example's text is that of the conversation's example before it, and
then ``fresh``, the turns since; ``written_out`` makes whole texts of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks of the template, and strings that other templates give a meaning (fixed values).
OPEN, END = "<|turn|>", "<|end|>"
CONTROL = r"<(?=\||s>|/s>)|\[(?=INST\]|/INST\])"


def escaped(text: Column) -> Column:
    r"""``\`` doubled, and a ``\`` after the first character of each control string, which so occurs in no text."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: ``conv_id, position, piece, start, example_end, loss_start, loss_end``.

    Turns go by ``turn`` (nulls first), ties by role and text; a row that is
    given twice is two turns. A null text or role is empty; a null conv_id is a
    conversation of its own. The last three columns are null for turns that
    aren't an assistant's. Columns beside the four are ignored.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("piece").cast("long")
    rows = rows.withColumns(
        {"position": F.row_number().over(order), "stop": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    )
    start = F.col("stop") - size
    target = F.col("role") == "assistant"
    loss = start + F.length("head")
    return rows.select(
        "conv_id",
        "position",
        "piece",
        start.alias("start"),
        F.when(target, F.col("stop")).alias("example_end"),
        F.when(target, loss).alias("loss_start"),
        F.when(target, loss + F.length("body")).alias("loss_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn: ``conv_id, example, fresh, example_end, loss_start, loss_end``.

    example: 1, 2, ... in a conversation. The example's whole text, of
    ``example_end`` code points, is the ``fresh`` of all examples up to it;
    ``loss_start`` to ``loss_end`` in the whole text are trained on. Turns
    after the last reply are in a last row without a target, whose ranges are
    null.
    """
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.when(F.col("example_end").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)) + 1
    parts = F.array_sort(F.collect_list(F.struct("position", "piece")))
    return (
        turns.withColumn("example", number)
        .groupBy("conv_id", "example")
        .agg(parts.alias("parts"), F.max("example_end").alias("example_end"), F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"))
        .select("conv_id", "example", F.array_join("parts.piece", "").alias("fresh"), "example_end", "loss_start", "loss_end")
    )


def prefix_targets(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn: ``conv_id, example, last, text, loss_start, loss_end``.

    example: 1, 2, ... in a conversation. text: all turns up to and with the
    reply; ``loss_start`` to ``loss_end`` in it are trained on. A conversation
    that doesn't end with a reply has a row more, of all its turns and without
    a target, whose range is null. ``last`` marks a conversation's last row.
    """
    turn = F.struct("position", "piece", "loss_start", "loss_end")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all")).withColumn("n", F.size("all"))
    cut = F.transform("all", lambda t, i: F.struct((i + 1).alias("upto"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end")))
    cut = F.filter(cut, lambda c: c["loss_start"].isNotNull() | (c["upto"] == F.col("n")))
    each = whole.select("conv_id", "n", F.col("all.piece").alias("pieces"), F.posexplode(cut).alias("example", "cut"))
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("cut.upto")), "")
    return each.select("conv_id", (F.col("example") + 1).alias("example"), (F.col("cut.upto") == F.col("n")).alias("last"), text.alias("text"), "cut.loss_start", "cut.loss_end")


def read_targets(expanded: DataFrame) -> DataFrame:
    """``conv_id, example, turns, trained, n_chars`` of each of ``prefix_targets``, from its own text and mask alone.

    turns: (role, text) of all turns, of a conversation's last row, null for others. trained: what the mask covers.
    n_chars: of the text, null without a target.
    """
    masked = F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return expanded.select(
        "conv_id",
        "example",
        F.when(F.col("last"), _turns(F.col("text"))).alias("turns"),
        unescaped(masked).alias("trained"),
        F.when(F.col("loss_start").isNotNull(), F.length("text").cast("long")).alias("n_chars"),
    )


def written_out(expanded: DataFrame) -> DataFrame:
    """Examples with their whole text; for conversations whose prefixes are small enough to be copied."""
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.array_join(F.collect_list("fresh").over(upto), "")
    return expanded.withColumn("text", text).where("example_end is not null").select("conv_id", "example", "text", "loss_start", "loss_end")


def _turns(text: Column) -> Column:
    """(role, text) of the turns of a formatted text."""

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^<\|turn\|>((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        return F.struct(unescaped(head).alias("role"), unescaped(F.substr(piece, F.length(head) + len(OPEN) + 2)).alias("text"))

    pieces = F.split(text, r"<\|end\|>", -1)  # the last part is what follows the last mark: nothing
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_back(expanded: DataFrame) -> DataFrame:
    """``conv_id, example, turns, trained, n_chars`` of each example, from its text and mask alone.

    turns: (role, text) of the turns that no example before it has. trained:
    what the mask covers in the whole text, found by the length of the texts
    that it continues. n_chars: of the whole text, null without a target.
    """
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.coalesce(F.sum(F.length("fresh").cast("long")).over(before), F.lit(0))
    out = expanded.withColumn("shared", shared)
    return out.select(
        "conv_id",
        "example",
        _turns(F.col("fresh")).alias("turns"),
        unescaped(F.substr("fresh", (F.col("loss_start") - F.col("shared") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("trained"),
        F.when(F.col("loss_start").isNotNull(), F.col("shared") + F.length("fresh")).alias("n_chars"),
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    back = read_targets(prefix_targets(format_turns(given.unionByName(own))))
    out = back.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("examples"),
        F.sum(F.length("trained")).alias("loss_chars"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("examples.trained", "")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.coalesce("loss_chars", zero).alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.coalesce("formatted_chars", zero).alias("formatted_chars"),
    )
