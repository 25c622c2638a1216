"""Chat formatting with typed content parts, in DataFrame functions alone (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What a part is. Text parts carry text; the others a reference and the tokens they expand to.
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"
END = "</turn>\n"


def escape(text: Column) -> Column:
    """Control characters as two characters each: a backslash, and b, l, g or h for backslash, <, > and #.
    Escaped text has none of <, > and #, so no control string can be read in it."""
    for raw, mark in (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape: backslashes come last, since every backslash in escaped text begins a pair."""
    for raw, mark in (("<", "\\l"), (">", "\\g"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens")))


def _visit_part(p: Column) -> Column:
    """A text part becomes its escaped text; any other part a placeholder that names its type."""
    kind = F.coalesce(p["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit("|>")))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, turns, attachments, expanded_tokens.

    rows has one message per row with its typed parts. A message becomes <turn role>content</turn> and a
    line end; its parts are visited in order, text escaped and every image, audio or document part a
    placeholder. turns holds for each message (start, end, loss_start, loss_end), offsets in code points from
    0, the loss range empty except for the trained role. attachments lists (turn, part, type, ref, tokens) in
    order; expanded_tokens is their sum of tokens.

    Rows are ordered by turn, ties by role and content; repeated rows are messages of their own. A null role
    counts as empty, null parts as none; null conversations are one conversation. Other columns don't
    matter. Empty tables give no rows. Offsets come from a running sum per conversation and the texts are
    gathered in the same shuffle, so work grows with the text, not with its square.
    """
    whole = F.coalesce(F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(PARTS)), _visit_part), ""), F.lit(""))
    base = rows.select(F.col(conv).alias("__c"), F.col(turn).alias("__n"), F.coalesce(F.col(role), F.lit("")).alias("__r"), whole.alias("__t"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("__p"))
    head = F.concat(F.lit("<turn "), escape(F.col("__r")), F.lit(">"))
    base = base.withColumn("__h", F.length(head)).withColumn("__m", F.concat(head, "__t", F.lit(END)))
    by = W.partitionBy("__c").orderBy("__n", "__r", "__t")
    base = base.withColumn("__i", F.row_number().over(by) - 1)
    base = base.withColumn("__s", F.coalesce(F.sum(F.length("__m").cast("long")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    end, inner = F.col("__s") + F.length("__m"), F.col("__s") + F.col("__h")
    loss_end = F.when(F.col("__r") == trained, inner + F.length("__t")).otherwise(inner)
    files = F.filter(F.transform("__p", lambda p, k: F.struct(k.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))), lambda x: F.coalesce(x["type"], F.lit("text")) != "text")
    one = F.struct(F.col("__i").alias("i"), F.col("__m").alias("m"), F.struct(F.col("__s").alias("start"), end.alias("end"), inner.alias("loss_start"), loss_end.alias("loss_end")).alias("t"), files.alias("f"))
    grouped = base.groupBy("__c").agg(F.sort_array(F.collect_list(one)).alias("x"))
    attached = F.flatten(F.transform("x", lambda x: F.transform(x["f"], lambda f: F.struct(x["i"].alias("turn"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return grouped.select(
        F.col("__c").alias(conv),
        F.size("x").cast("long").alias("n_turns"),
        F.array_join(F.transform("x", lambda x: x["m"]), "").alias("formatted"),
        F.transform("x", lambda x: x["t"]).alias("turns"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, messages of (role, text, loss), formatted_chars) parsed from the formatted text and its offsets.
    Placeholders stay in the text as they are."""
    pieces = F.split("formatted", END, -1)
    cut = chats.select(conv, F.length("formatted").cast("long").alias("formatted_chars"), F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), "turns")

    def one(p: Column, t: Column) -> Column:
        at = F.instr(p, ">")
        content = p.substr(at + 1, F.length(p))
        loss = p.substr((t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))
        return F.struct(unescape(p.substr(F.lit(7), at - 7)).alias("role"), unescape(content).alias("text"), unescape(loss).alias("loss"))

    return cut.select(conv, F.size("p").cast("long").alias("n_turns"), F.zip_with("p", "turns", one).alias("messages"), "formatted_chars")


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what read_back finds."""
    back = read_back(chats, conv)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("messages", lambda m: m["loss"]), "")
    return back.select(conv, "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
