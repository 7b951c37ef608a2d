"""Chat formatting by grammar round trip, in DataFrame functions only.

Grammar: ``<s>`` then for each turn ``[INST]role[/INST]body</s>``. The parser
refuses a role or body that holds a control string and undoes escapes. Every
turn is first rendered as it stands, reparsed and compared with its source; a
turn that doesn't come back identical is rendered with its conflicting content
escaped (a backslash behind the first character of a control string, and one
more where a backslash follows such a character already). The escape is the
exact inverse of the parser's unescape and leaves no control string, so the
second round always ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"</?s>|\[/?INST\]"
CONFLICT = r"([\[<])(\\|/?INST\]|/?s>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONFLICT, "$1\\\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<])\\", "$1")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), body, F.lit(END))


def parse_turn(part: Column) -> Column:
    """Struct (role, text) of one rendered turn without its end mark; null where the grammar is broken."""
    inner = F.substring(part, len(OPEN) + 1, 2147483647)
    at = F.locate(CLOSE, inner)
    role = F.substring(inner, F.lit(1), at - 1)
    body = F.substring(inner, at + len(CLOSE), F.lit(2147483647))
    fine = part.startswith(OPEN) & (at > 0) & ~role.rlike(CONTROL) & ~body.rlike(CONTROL)
    return F.when(fine, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a rendered conversation."""
    parts = F.split(F.substring(formatted, len(BEGIN) + 1, 2147483647), END)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), parse_turn)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, formatted, loss_spans (array of start and length in code
    points of every body of ``loss_role``), n_escaped (turns that needed the
    second round) and identical (the reparsed turns equal the source).
    Turns go by turn, null first; ties by role and text, repeated rows stay. Null role or text:
    empty. A null conv_id is a conversation of its own. No rows: no rows. Other columns are ignored.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    raw = render_turn(F.col("role"), F.col("text"))
    parts = F.split(raw, END)
    again = parse_turn(parts[0])
    same = (F.size(parts) == 2) & again.isNotNull() & (again["role"] == F.col("role")) & (again["text"] == F.col("text"))
    rows = rows.withColumn("plain", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("out_role", F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"))))
    rows = rows.withColumn("body", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.length("out_role") + F.lit(len(OPEN) + len(CLOSE))
    whole = head + F.length("body") + F.lit(len(END))
    rows = rows.withColumn("seq", F.row_number().over(ordered)).withColumn(
        "end", F.lit(len(BEGIN)) + F.sum(whole.cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("end") - len(END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    turn = F.struct("seq", "role", "text", "plain", render_turn(F.col("out_role"), F.col("body")).alias("piece"),
                    F.when(F.col("role") == loss_role, span).alias("span"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    conv = conv.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.col("turns")["piece"], "")).alias("formatted"),
        F.filter(F.col("turns")["span"], lambda s: s.isNotNull()).alias("loss_spans"),
        F.size(F.filter("turns", lambda t: ~t["plain"])).alias("n_escaped"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return conv.withColumn("identical", parse(F.col("formatted")) == F.col("source")).drop("source")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns read from the formatted text and its loss spans alone."""
    df = formatted.withColumn("parsed", parse(F.col("formatted")))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return df.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
