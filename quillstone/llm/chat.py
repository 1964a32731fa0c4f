"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn is an example: its context is all turns before it, and only its reply bears loss. As the text of
an example is a prefix of its conversation's formatted text, the output stores each formatted turn once, with its offset,
and an example is the turns up to its own with one loss span. Long conversations therefore cost space in proportion to
their turns, not to the square; ``expand`` writes examples out in full. ``conversation_digests`` writes the examples as
prefix bounds and loss span, reads them back and rebuilds each one's context and reply.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Roles are percent-encoded. In texts a backslash is put before the bar of
any ``<``, backslashes, ``|``; taking one out of each such run restores the text, and no control string remains inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import save

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_turns(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per turn, written to the shared folder and read back.

    Columns: conv_id, seq (from 0), formatted, start (its offset in the conversation's text), loss_start and loss_end
    (offsets of a reply's text there, else null) and example (from 0, else null). Turns are ordered by turn, then role,
    then text; repeated rows are turns each; null roles and texts count as empty; rows with a null conv_id are one
    conversation; an empty table gives no rows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    target = F.col("role") == target_role
    t = t.withColumn("body", escape(F.col("text"))).withColumn("formatted", F.concat(head, F.col("body"), F.lit(f"{END}\n")))
    t = t.withColumn("seq", F.row_number().over(order) - 1).withColumn("start", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)))
    loss = F.when(target, F.col("start") + F.length(head))
    example = F.when(target, F.coalesce(F.count(F.when(target, 1)).over(before), F.lit(0)))
    return save(t.select("conv_id", "seq", "formatted", "start", loss.alias("loss_start"), (loss + F.length("body")).alias("loss_end"), example.alias("example")), "chat-turns")


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its conversation, the turns and characters of context, and its loss span."""
    return turns.where("example is not null").select("conv_id", "example", F.col("seq").alias("context_turns"), F.col("start").alias("context_chars"), "loss_start", "loss_end", (F.col("start") + F.length("formatted")).alias("total_chars"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, text, loss_start, loss_end. Grows with the square of a conversation's turns."""
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("text", F.array_join(F.collect_list("formatted").over(upto), "")).where("example is not null").select("conv_id", "example", "text", "loss_start", "loss_end")


def read_turns(turns: DataFrame) -> DataFrame:
    """Role and text of each formatted turn, unescaped, and the text under its loss mask (null where there is none)."""
    layout = f"(?s)^{START}([^\n]*)\n(.*){END}\n$".replace("|", r"\|")
    role = F.url_decode(F.regexp_extract("formatted", layout, 1))
    text = unescape(F.regexp_extract("formatted", layout, 2))
    masked = F.substr(F.col("formatted"), (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return turns.select("conv_id", "seq", "formatted", role.alias("role"), text.alias("text"), unescape(masked).alias("loss"))


def write_examples(turns: DataFrame) -> DataFrame:
    """``examples`` written to the shared folder and read back: prefix bounds and loss span, a row an assistant turn."""
    return save(examples(turns), "chat-examples")


def conversation_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, body): the formatted text of each conversation, of which every example is a prefix."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "formatted")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["formatted"]), "").alias("body"))


def read_examples(texts: DataFrame, written: DataFrame) -> DataFrame:
    """Each written example rebuilt as context, reply and whole: (conv_id, example, context_sha256, loss, chars).

    The contexts pass through the tasks one at a time and are told by their digest; only the replies, which don't
    overlap, are kept as text.
    """
    t = texts.withColumnRenamed("conv_id", "of")
    part = lambda first, stop: F.substr(F.col("body"), (first + 1).cast("int"), (stop - first).cast("int"))
    context, loss = part(F.lit(0), F.col("context_chars")), part(F.col("loss_start"), F.col("loss_end"))
    whole = part(F.lit(0), F.col("total_chars"))
    return save(written.join(t, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "example", F.sha2(context, 256).alias("context_sha256"), unescape(loss).alias("loss"), F.length(whole).cast("long").alias("chars")), "chat-read")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation: numbers and digests of what its written examples hold.

    Turns are read from the text of the last example, which holds all others, and from the turns after it, which are in
    no example; replies from each example's loss span; ``formatted_chars`` is the length of all examples together.
    """
    texts = save(conversation_texts(turns), "chat-texts")
    read = read_examples(texts, write_examples(turns))
    rows = F.array_sort(F.collect_list(F.struct("example", "loss")))
    g = read.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n_examples"), rows.alias("rows"), F.sum("chars").alias("formatted_chars"), F.max("chars").alias("last_chars"))
    g = texts.join(g, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("last_chars", F.coalesce("last_chars", F.lit(0)).cast("int"))
    pieces = lambda text: F.filter(F.split(text, rf"{END}\n".replace("|", r"\|")), lambda x: x != "")
    last, after = F.substr(F.col("body"), F.lit(1), F.col("last_chars")), F.substr(F.col("body"), F.col("last_chars") + 1)
    head = len(START) + 1

    def told(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = unescape(F.substr(piece, F.length(role) + 2))
        return F.concat(F.url_decode(F.substr(role, F.lit(head))), F.lit("\n"), text, F.lit("\n"))

    g = g.withColumn("told", F.transform(F.concat(pieces(last), pieces(after)), told)).withColumn("loss", F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<example:bigint,loss:string>>")), lambda r: r["loss"]), ""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return g.select("conv_id", F.size("told").cast("long").alias("n_turns"), F.sha2(F.array_join("told", ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), zero("formatted_chars").alias("formatted_chars"), zero("n_examples").alias("n_examples"))
