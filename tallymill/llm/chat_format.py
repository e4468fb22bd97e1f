r"""Chat formatting that its own grammar reads back, in DataFrame functions alone.

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]</s>"

The four control strings inside a role or text would break the grammar.  Each turn is rendered as
it is, reparsed and compared; where the result differs, one backslash goes after the bracket of
every control string (and of every string that already looks so escaped), which the parser takes
away again.  The whole conversation is then reparsed and compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SPLIT, STOP, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string after any number of escapes.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
BARE = r"[<\[]/?(?:s>|INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(SPLIT), text, F.lit(STOP + END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, read from left to right.

    A control string inside a role or text is a grammar error: that part is null.
    """
    body = F.substring(formatted, F.lit(len(START) + 1), F.length(formatted) - len(START + STOP + END))
    turns = F.split(body, r"\[/INST\]</s><s>", -1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, SPLIT, 1)
        text = F.substring(x, F.length(role) + len(SPLIT) + 1, F.length(x))
        return F.struct(*(F.when(~y.rlike(BARE), unescape(y)).alias(n) for n, y in (("role", role), ("text", text))))

    return F.when(F.length(formatted) > 0, F.transform(turns, turn)).otherwise(F.expr("cast(array() AS array<struct<role:string,text:string>>)"))


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start and length, in code points,
    of the texts of role ``learn``, escapes included), escaped (whether any turn needed escapes).

    Turns stand in order of (turn, role, text), a null turn first.  Null text and null role are
    empty; rows with null conv_id are one conversation; repeated rows are turns each.  An empty
    table gives no row; other columns are ignored.  A conversation is one value, so it has to fit
    the 2 GB of a Spark string.  Turns are rendered and placed before they meet.

    One step of escaping makes the round trip identical: it adds a backslash within every control string, those
    with backslashes already included, so an escaped text holds no bare one for the parser to find, and
    unescaping takes exactly the added ones off.  The whole conversation is parsed again all the same.
    """
    raw = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain = render(role, text)
    same = parse(plain) == F.array(F.struct(role.alias("role"), text.alias("text")))
    kept = raw.withColumn("same", same).withColumn("r", F.when(F.col("same"), role).otherwise(escape(role))).withColumn("t", F.when(F.col("same"), text).otherwise(escape(text)))
    piece = kept.withColumn("piece", render(F.col("r"), F.col("t"))).withColumn("size", F.length("piece"))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = piece.withColumn("start", F.sum("size").over(w) - F.col("size"))
    one = F.struct(
        "start", "piece", "role", "text", "same",
        (F.col("start") + len(START + SPLIT) + F.length("r")).alias("at"), F.length("t").cast("long").alias("n"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda x: x["piece"]), ""))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    learned = F.filter("turns", lambda x: x["role"] == learn)
    return whole.select(
        "conv_id",
        checked.cast("string").alias("formatted"),
        F.transform(learned, lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length"))).alias("loss_spans"),
        F.exists("turns", lambda x: ~x["same"]).alias("escaped"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss spans hold."""
    turns = F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int"))))
    read = formatted.withColumn("parsed", parse(F.col("formatted"))).withColumn("loss", F.array_join(loss, ""))
    return read.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
