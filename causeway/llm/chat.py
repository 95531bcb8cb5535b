"""Chat formatting: event logs folded into messages, rendered with a loss mask, and read back.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
# The control strings of the common chat templates, which a text must not forge.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_FORGED = "([<\\[])(?=" + "|".join("".join("\\" + c if not c.isalnum() else c for c in s[1:]) for s in CONTROL) + ")"
_HEADER = r"^<\|im_start\|>((?:[^\\\n]|\\[\s\S])*+)\n"
#: Kinds of event that start a message's text anew; "delta" adds to it.
ANEW = ("message", "edit", "regenerate")
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """A backslash before every backslash, and after the first character of every control string."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _FORGED, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the final messages of event logs.

    ``events`` has conv_id, seq, kind, msg_id, role, text; ``seq`` is of any orderable
    type. In its order a message's "message", "edit" and "regenerate" events set its text
    anew and its "delta" events add to it; a "delete" removes it, deltas after it
    included, unless a later event sets it anew. A message stands where its first event
    does and has the first role given. Events without a msg_id are whole messages of
    their own. Null text counts as empty, a null or unknown kind as "message"; equal seq
    are taken in the order of (role, text, kind). The events of one message meet in one task.
    """
    kind = F.when(F.col("kind").isin("delta", "delete"), F.col("kind")).otherwise("message")
    rows = events.select("conv_id", "seq", kind.alias("kind"), "msg_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.where("msg_id is null and kind <> 'delete'").select("conv_id", F.col("seq").alias("place"), "role", "text")
    logs = rows.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text", "kind"))).alias("log"))
    size = F.size("log")
    behind = F.array_position(F.reverse(F.transform("log", lambda e: e["kind"] != "delta")), True)  # 1: the last event; 0: deltas alone
    set_anew = logs.withColumn("start", F.when(behind > 0, (size - behind + 1).cast("int")).otherwise(1))
    folded = set_anew.where(F.element_at("log", F.col("start"))["kind"] != "delete").select(
        "conv_id", F.element_at("log", 1)["seq"].alias("place"), F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), 0).alias("role"),
        F.array_join(F.transform(F.slice("log", F.col("start"), size), lambda e: e["text"]), "").alias("text"),
    )
    return folded.unionByName(whole)


def format_chats(events: DataFrame) -> DataFrame:
    """Per conversation: conv_id, ``formatted`` text and its ``loss_runs``.

    Each message becomes its marks around the escaped role and text; see :func:`escape`,
    :func:`fold_events`. ``loss_runs`` cut ``formatted`` into consecutive runs (chars in
    code points, loss): three for each message, of which the text of an assistant has
    loss. Messages stand in the order of (place, role, text); repeated rows are messages
    of their own. A null role is an empty one, a null conv_id is a conversation, an
    empty table gives none. Other columns of ``events`` are ignored.
    """
    turn = F.struct(
        F.col("place"), F.coalesce("role", F.lit("")).alias("role"), F.col("text"),
        F.concat(F.lit(BEGIN), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    end = END + "\n"
    turns = fold_events(events).select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def runs(t: Column) -> Column:
        run = lambda chars, loss: F.struct(chars.alias("chars"), loss.alias("loss"))
        return F.array(run(F.length(t["head"]), F.lit(False)), run(F.length(t["body"]), t["role"] == LEARNT), run(F.lit(len(end)), F.lit(False)))

    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(end))), "").alias("formatted"),
        F.flatten(F.transform("turns", runs)).alias("loss_runs"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role, text) and ``learnt`` (texts under the mask), from what :func:`format_chats` wrote."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, _HEADER, 1)
        text = F.substr(piece, F.length(role) + len(BEGIN) + 2)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def masked(piece: Column, i: Column) -> Column:
        head, body = F.get("loss_runs", 3 * i), F.get("loss_runs", 3 * i + 1)
        return F.when(body["loss"], unescape(F.substr(piece, head["chars"] + 1, body["chars"])))

    cut = formatted.select("conv_id", "formatted", "loss_runs", pieces.alias("pieces"))
    return cut.select(
        "conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.filter(F.transform("pieces", masked), lambda x: x.isNotNull()).alias("learnt")
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as the event log by which its messages come about.

    A hash of the row says how: written whole; streamed in three deltas; drafted, then
    edited, with a second message that is deleted again; or streamed wrongly and
    regenerated. Only the first event gives the role. ``seq`` is (turn, step). Each row,
    repeated ones too, is a message of its own, and folding gives its text back.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    pieces = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1)]
    event = lambda step, kind, said, message=0: F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.lit(message).alias("message"), said.alias("text")
    )
    whole = F.array(event(0, "message", text))
    streamed = F.array(event(0, "message", F.lit("")), *[event(i + 1, "delta", p) for i, p in enumerate(pieces)])
    edited = F.array(event(0, "message", pieces[0]), event(1, "delta", pieces[2]), event(2, "message", text, 1), event(3, "edit", text), event(4, "delete", F.lit(""), 1))
    again = F.array(event(0, "message", pieces[2]), event(1, "delta", pieces[1]), event(2, "regenerate", pieces[0]), event(3, "delta", pieces[1]), event(4, "delta", pieces[2]))
    how = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(4))
    log = F.when(how == 0, whole).when(how == 1, streamed).when(how == 2, edited).otherwise(again)
    rows = conversations.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("row"), log.alias("log"))
    return rows.select("conv_id", "turn", "role", "row", F.explode("log").alias("e")).select(
        "conv_id", F.struct("turn", F.col("e.step").alias("step")).alias("seq"), F.col("e.kind").alias("kind"), (2 * F.col("row") + F.col("e.message")).alias("msg_id"),
        F.when(F.col("e.step") == 0, F.col("role")).alias("role"), F.col("e.text").alias("text"),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, as counts and SHA-256 digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read_chats(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
