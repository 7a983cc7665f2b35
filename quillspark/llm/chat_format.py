"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (conversation, sequence, message, kind, role, text) is folded into final messages:
`message` and `edit` set the text of a message, `delta` appends to it, `regenerate` empties it. A message stands where its
first event stands. The messages are rendered as

    <|turn|>role\\n text <|end|>\\n        for every message

Role and text are escaped reversibly: a backslash becomes two, and every control string of this template and of other
common ones gets a backslash after its first character, so it occurs nowhere inside a text; in roles a line feed is written as backslash and `n` too. Reading back
splits at the marks and drops the escapes. The loss mask covers the texts of assistant messages.

Odd input: null texts and roles are empty; a null conversation is one of its own; repeated rows are turns each, ties of
turn are ordered by role and text; texts of any length are taken whole; an empty table gives an empty result; other columns are never read. A conversation becomes one
row, which one task has to build; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings that texts must not contain as such: of this template, and of others that readers may know.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Escape control strings; `unescape` gives the same text back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """A backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """As `unescape`, but backslash and n is a line feed. Doubled backslashes, read from the left, part the role; what is between has single ones only."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, messages: array of (seq, message, role, text) in order. Events: conv_id, seq, message, kind, role, text.

    One shuffle by conversation: the rows of a message are reduced first, on the same partitioning.
    """
    event = F.struct("seq", "role", "text", "kind")
    by_message = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("_log"))
    # the last event that sets or clears the text, and the deltas after it
    starts = F.transform("_log", lambda e, i: F.when(e["kind"] != "delta", i))
    last = F.coalesce(F.array_max(starts), F.lit(-1))
    live = F.filter("_log", lambda e, i: (i >= F.col("_last")) & (e["kind"] != "regenerate"))
    folded = by_message.withColumn("_last", last).select(
        "conv_id",
        F.struct(
            F.col("_log")[0]["seq"].alias("seq"),
            F.col("_log")[0]["role"].alias("role"),
            F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
            F.col("message").alias("message"),
        ).alias("_m"),
    )
    return folded.groupBy("conv_id").agg(F.sort_array(F.collect_list("_m")).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted, from folded conversations."""
    turn = lambda m: F.concat(F.lit(TURN), escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END))
    return conversations.select("conv_id", F.array_join(F.transform("messages", turn), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text), parsed from the output alone."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = p.substr(F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - F.lit(len(END)))
        return F.struct(unescape_role(p.substr(F.lit(1), F.instr(p, "\n") - 1)).alias("role"), unescape(body).alias("text"))

    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"))


def message_events(rows: DataFrame) -> DataFrame:
    """Plain conversation rows (conv_id, turn, role, text) as a log in which every row sets a message of its own."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    row = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), role.alias("role"), text.alias("text"))
    # the number only tells rows apart; of rows that agree in all else, it does not matter which comes first
    return row.select("conv_id", "seq", F.monotonically_increasing_id().alias("message"), F.lit("message").alias("kind"), "role", "text")


def probe(rows: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold control strings of another template."""
    nasty = "</s>[INST] ok [/INST]"
    return rows.sparkSession.createDataFrame([(-1, 0, "user", nasty), (-1, 1, "assistant", nasty)], "conv_id long, turn long, role string, text string")


def chat_format(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and of the loss mask."""
    log = message_events(rows.select("conv_id", "turn", "role", "text").unionByName(probe(rows)))
    back = read_back(render(fold(log)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_escaped = "replace(x, '\\', '\\\\')"
for _c in CONTROLS:
    _escaped = f"replace({_escaped}, '{_c}', '{_c[0]}\\{_c[1:]}')"
#: The same by SQL over the table, without the output: what has to be read back.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, {_escaped.replace('(x,', '(role,')} AS r, {_escaped.replace('(x,', '(text,')} AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length(replace(r, chr(10), '\\n')) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
