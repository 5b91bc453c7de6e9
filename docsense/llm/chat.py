"""Chat formatting by prefix-target expansion (operator 5), in DataFrame functions only.

A conversation becomes one transcript: for each turn ``[TURN]role[TEXT]text[END]``. Every ``&``, ``[`` and ``<`` inside a
role or text is written as an entity, so no control string of this or another bracketed template survives in content and
the form is reversible. Every assistant turn is expanded into an example of its own: all preceding turns are the context
and only that reply is trainable. An example points into the transcript (end of context, target span, end of example),
so a conversation of n turns costs n spans and not n copies of its text; ``texts`` spells examples out.

An empty table gives an empty result; a conversation without assistant turns has a transcript and no examples. One
transcript is one row, so the turns of one conversation are put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "[TURN]", "[TEXT]", "[END]"
ENTITIES = (("&", "&amp;"), ("[", "&lb;"), ("<", "&lt;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def pieces(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, at (place in the conversation, from 1), reply, role and body (escaped), start (code points
    of the transcript before the turn) and example (replies before the turn).

    Turns are ordered by turn, ties by role and text, null turns first. Null roles and texts count as empty; rows of null
    conv_id are one conversation; repeated rows are turns of their own. Other columns are ignored. Offsets are running
    sums, so a conversation of n turns costs n steps.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("said_role"), F.coalesce("text", F.lit("")).alias("said"))
    rows = said.select("*", escape(F.col("said_role")).alias("role"), escape(F.col("said")).alias("body"), (F.col("said_role") == "assistant").alias("reply"))
    order = Window.partitionBy("conv_id").orderBy("turn", "said_role", "said")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("role") + F.length("body") + len(TURN + TEXT + END)
    return rows.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("at"),
        "reply",
        "role",
        "body",
        (F.sum(length).over(before) - length).alias("start"),
        (F.sum(F.col("reply").cast("long")).over(before) - F.col("reply").cast("long")).alias("example"),
    )


def transcripts(cut: DataFrame) -> DataFrame:
    """conv_id, n_turns and transcript of every conversation of ``pieces``."""
    piece = F.concat(F.lit(TURN), "role", F.lit(TEXT), "body", F.lit(END))
    told = cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", piece.alias("piece")))).alias("told"))
    return told.select("conv_id", "n_turns", F.array_join(F.transform("told", lambda t: t["piece"]), "").alias("transcript"))


def examples(cut: DataFrame) -> DataFrame:
    """One row for every assistant turn: conv_id, example (from 0), context_end, target_start, target_end and target.

    The context is the transcript up to context_end, all preceding turns; target is the reply as it stands there from
    target_start to target_end, the only trainable part. Contexts are named by their end and not copied, so the examples
    of a conversation together are no longer than its transcript; ``texts`` spells them out.
    """
    head = F.col("start") + F.length("role") + len(TURN + TEXT)
    return cut.where("reply").select("conv_id", "example", F.col("start").alias("context_end"), head.alias("target_start"), (head + F.length("body")).alias("target_end"), F.col("body").alias("target"))


def texts(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """Examples spelled out: conv_id, example, context (formatted turns and the reply's head), target (its escaped text)."""
    own = expanded.withColumnRenamed("conv_id", "of")
    rows = formatted.join(own, F.col("conv_id").eqNullSafe(F.col("of")))
    return rows.select(
        "conv_id",
        "example",
        F.expr("substring(transcript, 1, cast(target_start as int))").alias("context"),
        F.expr("substring(transcript, cast(target_start as int) + 1, cast(target_end - target_start as int))").alias("target"),
    )


def read_back(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """Digests of what the output says: turns parsed from the transcripts, and what stands in them under the examples' spans.

    The transcript is cut into turns again; an example finds the one that begins where its context ends, and its target is
    what stands there from target_start to target_end.
    """
    parsed = F.transform(F.split("transcript", r"\[END\]", -1), lambda x: F.split(x, r"\[TEXT\]", 2))
    turns = F.filter(parsed, lambda x: F.size(x) == 2)
    spoken = F.transform(turns, lambda x: F.concat(unescape(F.substring(x[0], len(TURN) + 1, 2147483647)), F.lit("\n"), unescape(x[1]), F.lit("\n")))
    told = formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("transcript").cast("long").alias("formatted_chars"),
        F.lit(None).cast("long").alias("loss_chars"),
        F.lit(None).cast("string").alias("loss_sha256"),
    )
    size = F.length("piece") + len(END)
    cut = formatted.select("conv_id", F.posexplode(F.split("transcript", r"\[END\]", -1)).alias("at", "piece")).where("piece <> ''")
    begun = cut.select("conv_id", "piece", (F.sum(size).over(Window.partitionBy("conv_id").orderBy("at")) - size).alias("begin"))
    spans = expanded.select(F.col("conv_id").alias("of"), "example", "context_end", "target_start", "target_end")
    masked = begun.join(spans, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("begin") == F.col("context_end")))
    said = unescape(F.expr("substring(piece, cast(target_start - begin as int) + 1, cast(target_end - target_start as int))"))
    replies = masked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", said.alias("said")))).alias("replies"))
    loss = replies.select("conv_id", F.array_join(F.transform("replies", lambda r: r["said"]), "").alias("loss"))
    learned = loss.select(
        "conv_id",
        F.lit(None).cast("long").alias("n_turns"),
        F.lit(None).cast("string").alias("turns_sha256"),
        F.lit(None).cast("long").alias("formatted_chars"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
    )
    # A union and one small aggregate instead of a join: null conversations meet too.
    both = told.unionByName(learned).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in told.columns[1:]])
    return both.select("conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("loss_sha256"), "formatted_chars")
