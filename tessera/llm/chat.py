"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

Events are partitioned by conversation, sorted by sequence number and folded into final messages;
the messages are rendered with a template whose control strings cannot occur inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Control strings of the template and of its common relatives; texts never hold one after escaping.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
BEGIN, ROLE, TEXT, END = "<s>", "[ROLE]", "[/ROLE]", "</s>"
#: First character and rest of any of CONTROL. No control string begins inside another.
_CONTROL_RE = r"([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)"


def escape(text: Column) -> Column:
    r"""Double every backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of escape: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _fold(state: Column, event: Column) -> Column:
    """state: the messages of one turn; event: the next event of that turn."""
    message = F.struct(event["role"].alias("role"), event["text"].alias("text"))
    size = F.size(state)
    last = F.element_at(state, size)
    kept = F.slice(state, F.lit(1), F.greatest(size - 1, F.lit(0)))

    def replaced(text: Column) -> Column:
        return F.concat(kept, F.array(F.struct(F.when(last["role"] == "", event["role"]).otherwise(last["role"]).alias("role"), text.alias("text"))))

    return (
        F.when((event["kind"] == "message") | (size == 0), F.concat(state, F.array(message)))
        .when(event["kind"] == "delta", replaced(F.concat(last["text"], event["text"])))
        .otherwise(replaced(event["text"]))
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of each conversation.

    events: conv_id, turn, seq, kind, role, text; other columns are ignored. Within a turn, in order of seq (ties by
    kind, role, text): `message` adds a message, `delta` appends its text to the turn's last message, `edit` and
    `regenerate` replace that message's text (deltas after a regenerate stream into it). The first event of a turn
    opens a message whatever its kind. A null role or text is empty, a null kind is `message`; a null conv_id or turn
    is a key of its own and sorts first. Repeated `message` rows stay repeated.
    Returns conv_id, messages array<struct<role, text>>. Events meet by (conv_id, turn) first, so one long
    conversation is folded by many tasks; only its final messages come together.
    """
    order = ["seq", "kind", "role", "text"]
    rows = events.select(
        "conv_id",
        "turn",
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    nothing = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    turns = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("log"))
    turns = turns.select("conv_id", "turn", F.aggregate("log", nothing, _fold).alias("said"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("turns"))
        .select("conv_id", F.flatten(F.transform("turns", lambda t: t["said"])).alias("messages"))
    )


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, messages -> conv_id, formatted string, mask array<struct<skip, take>>.

    formatted: BEGIN, then for each message ROLE role TEXT text END. mask has an entry a message: of the message's
    rendering without END, skip characters are outside the loss and the take characters after them are in it
    (an assistant's text; nothing of other roles).
    """
    pieces = conversations.select(
        "conv_id",
        F.transform("messages", lambda m: F.struct(F.concat(F.lit(ROLE), escape(m["role"]), F.lit(TEXT)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss"))).alias("pieces"),
    )
    return pieces.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")).alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.char_length(p["head"]).alias("skip"), F.when(p["loss"], F.char_length(p["body"])).otherwise(0).alias("take"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask -> conv_id, messages array<struct<role, text>>, loss array<string> (unescaped)."""
    body = F.expr(f"substr(formatted, {len(BEGIN) + 1})")
    cut = F.split(body, END.replace("/", "\\/"), -1)
    turns = F.slice(cut, F.lit(1), F.size(cut) - 1)
    split = formatted.select("conv_id", "mask", turns.alias("turns"))

    def message(t: Column) -> Column:
        at = F.instr(t, TEXT)
        return F.struct(
            unescape(F.substring(t, F.lit(len(ROLE) + 1), at - len(ROLE) - 1)).alias("role"),
            unescape(F.substring(t, at + len(TEXT), F.char_length(t))).alias("text"),
        )

    masked = F.zip_with("turns", "mask", lambda t, m: F.when(m["take"] > 0, unescape(F.substring(t, m["skip"] + 1, m["take"]))).otherwise(""))
    return split.select("conv_id", F.transform("turns", message).alias("messages"), masked.alias("loss"))


def format_chat(events: DataFrame) -> DataFrame:
    """reconstruct, then render."""
    return render(reconstruct(events))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back; see reconstruct for nulls, ties and repeats."""
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    formatted = format_chat(rows.withColumns({"seq": F.col("turn"), "kind": F.lit("message")}))
    chars = formatted.select("conv_id", "mask", "formatted")
    back = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    read = read_back(chars.withColumn("conv_id", F.struct("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))))
    loss = F.array_join("loss", "")
    return read.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("conv_id.formatted_chars").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2', 'g') AS erole,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?ROLE\]|</?SYS>>)', '\1\\\2', 'g') AS etext
  FROM c
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(6 + length(erole) + 7 + length(etext) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
