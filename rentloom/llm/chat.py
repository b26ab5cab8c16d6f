"""Conversations rebuilt from event logs and rendered with a reversible template.

Everything here is a DataFrame or SQL function: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"      # fixed marks of the template
TRAINED = "assistant"
MESSAGE, EDIT, REGENERATE, DELTA = "message", "edit", "regenerate", "delta"
RESETS = (MESSAGE, EDIT, REGENERATE)


def escape(text: Column) -> Column:
    """Text in which ``<|`` cannot occur: every run ``<``, backslashes, ``|`` gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def events_of_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """A table of finished turns as an event log, one ``message`` event per row.

    Repeated rows are counted before they meet, then numbered; rows that tie on
    the turn are ordered by role, then text.
    """
    counted = turns.groupBy(F.col(conversation).alias("conv"), F.col(turn).alias("seq"), F.col(role).alias("role"),
                            F.coalesce(F.col(text), F.lit("")).alias("text")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")
    number = F.row_number().over(Window.partitionBy("conv", "seq").orderBy("role", "text", "_copy"))
    return copies.select("conv", "seq", F.lit(MESSAGE).alias("kind"), F.struct(F.col("seq"), number.alias("n")).alias("message"),
                         "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log: ``conv``, ``message``, ``started``, ``role``, ``text``.

    Events (``conv``, ``seq``, ``kind``, ``message``, ``role``, ``text``) apply to
    one message each. ``message``, ``edit`` and ``regenerate`` set its text,
    ``delta`` appends; unknown kinds append nothing. ``regenerate`` also drops
    the messages that had followed the regenerated one by then. Events of a
    message are ordered by ``seq``, ties by kind (resets first), then text; a
    null text is empty, the last role that is not null counts, a missing one is
    empty. Null conversations form one conversation. Messages are folded before
    they meet their conversation, so a large conversation is many small groups here.
    """
    kind = F.coalesce(F.col("kind"), F.lit(""))
    rank = F.when(kind.isin(*RESETS), 0).otherwise(1)
    event = F.struct("seq", rank.alias("rank"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = events.groupBy("conv", "message").agg(
        F.sort_array(F.collect_list(event)).alias("_e"), F.min("seq").alias("started"),
        F.max(F.when(kind == REGENERATE, F.col("seq"))).alias("_again"))
    last = F.expr("greatest(1, aggregate(transform(_e, (e, i) -> if(e.rank = 0, i + 1, 0)), 0, (a, b) -> greatest(a, b)))")
    current = F.slice("_e", last, F.size("_e"))
    text = F.array_join(F.transform(current, lambda e: F.when((e["rank"] == 0) | (e["kind"] == DELTA), e["text"]).otherwise("")), "")
    roles = F.filter(F.transform("_e", lambda e: e["role"]), lambda r: r.isNotNull())
    folded = grouped.select("conv", "message", "started", "_again", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
                            text.alias("text"))
    earlier = Window.partitionBy("conv").orderBy("started", "message").rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.coalesce(F.max("_again").over(earlier) > F.col("started"), F.lit(False))
    return folded.withColumn("_replaced", replaced).where(~F.col("_replaced")).drop("_replaced", "_again")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and the pieces it consists of with their loss mask.

    ``pieces`` is an array of (``text``, ``loss``); joined they are the
    formatted string, and ``loss`` is true for the texts of the assistant.
    Control strings inside texts and roles are escaped, so the template can be
    read back. A conversation is one string by definition; nothing else of it
    is gathered.
    """
    parts = F.sort_array(F.collect_list(F.struct("started", "message", "role", "text")))

    def written(m: Column) -> Column:
        plain = F.lit(False)
        return F.array(F.struct(F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n")).alias("text"), plain.alias("loss")),
                       F.struct(escape(m["text"]).alias("text"), (m["role"] == TRAINED).alias("loss")),
                       F.struct(F.lit(END).alias("text"), plain.alias("loss")))

    pieces = messages.groupBy("conv").agg(parts.alias("_m")).select("conv", F.flatten(F.transform("_m", written)).alias("pieces"))
    return pieces.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def read_back(rendered: DataFrame) -> DataFrame:
    """The rendered rows with ``turns``, an array of (``role``, ``text``) parsed from ``formatted`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        return F.struct(_unescape_role(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(block, F.length(head) + 2)).alias("text"))

    return rendered.withColumn("turns", F.transform(blocks, turn))


def conversation_digest(read: DataFrame, name: str = "conv_id") -> DataFrame:
    """Per conversation: turns and loss text as digests, read back from the output."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    loss = read.withColumn("_loss", F.array_join(trained, ""))
    return loss.select(
        F.col("conv").alias(name), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Digests of all conversations of a table of turns, formatted and read back.

    Null texts and roles are empty, null turns come first, tied turns are
    ordered by role and text, repeated rows are turns of their own; an empty
    table gives no rows and other columns are not read.
    """
    return conversation_digest(read_back(render(fold_events(events_of_turns(turns)))))
