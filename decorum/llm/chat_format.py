r"""Chat formatting with a grammar round trip.

The grammar of a formatted conversation, one alternative per kind of turn:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  [ROLE] role [TEXT] text [/ROLE]

(without the blanks). A backslash in a text takes the next character as it is.
A conversation is rendered as it stands, parsed again and compared with its
source; if a turn does not come back, or a text holds a control string, it is
rendered with escapes: every backslash doubled, and one put behind the first
character of each control string, which breaks it. The result is parsed and
compared again, and a conversation that still differs is an error.
"""

from pyspark.sql import functions as F

#: Role, opening and closing string of the turns with a role of their own.
ROLES = [("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>")]
OPEN, MIDDLE, CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\]"
TURN = (r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[TEXT\].*?\[/ROLE\]")


def escape(text):
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(text, rf"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns, code):
    """Formatted text of an array of (role, text), each text passed through ``code``."""
    def one(turn):
        role, text = turn["role"], code(turn["text"])
        out = F.concat(F.lit(OPEN), code(role), F.lit(MIDDLE), text, F.lit(CLOSE))
        for name, start, end in ROLES:
            out = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def body(piece):
    """What stands between the control strings of a piece that one turn matched, as
    (role, text), still escaped; role is null for turns of the fourth kind."""
    inner = F.regexp_extract(piece, r"(?s)^\[ROLE\](.*?)\[TEXT\](.*)\[/ROLE\]$", 2)
    role = F.regexp_extract(piece, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1)
    out = F.struct(role.alias("role"), inner.alias("text"))
    for name, start, end in ROLES:
        cut = F.substring(piece, F.lit(len(start) + 1), F.char_length(piece) - len(start) - len(end))
        out = F.when(piece.startswith(start), F.struct(F.lit(name).alias("role"), cut.alias("text"))).otherwise(out)
    return out


def parse(text):
    """Turns of a formatted text as an array of (role, text), or null if the grammar
    does not cover it or a text holds a bare control string."""
    pieces = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))
    bodies = F.transform(pieces, body)
    whole = F.array_join(pieces, "") == text
    bare = F.exists(bodies, lambda b: b["text"].rlike(CONTROL) | b["role"].rlike(CONTROL))
    turns = F.transform(bodies, lambda b: F.struct(unescape(b["role"]).alias("role"), unescape(b["text"]).alias("text")))
    return F.when(whole & ~bare, turns)


def loss_spans(text):
    """(start, length) in code points of each assistant's escaped text, in order."""
    pieces = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))
    start, end = next((s, e) for role, s, e in ROLES if role == "assistant")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, piece):
        span = F.struct((state["at"] + len(start)).alias("start"),
                        (F.char_length(piece) - len(start) - len(end)).alias("length"))
        return F.struct((state["at"] + F.char_length(piece)).alias("at"),
                        F.when(piece.startswith(start), F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, step, lambda state: state["spans"])


def format_chats(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per conversation: _conv, _text (formatted), _escaped, _turns (read
    back from _text) and _loss (start and length of each assistant's text in _text).

    Turns are ordered by turn, null first; rows of one turn by role and text, so
    repeated rows are turns of their own. Null roles and texts count as empty. A null conversation id is a
    conversation. Other columns are not read; an empty table gives no rows. The texts are shuffled
    once, by conversation, since a conversation is one value of the output.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.select(F.col(conv_col).alias("_conv"), turn.alias("_turn")).groupBy("_conv").agg(
        F.sort_array(F.collect_list("_turn")).alias("_rows"))
    source = F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    shown = chats.select("_conv", source.alias("_source")).withColumn("_plain", render(F.col("_source"), lambda t: t))
    shown = shown.withColumn("_escaped", ~F.coalesce(parse(F.col("_plain")) == F.col("_source"), F.lit(False)))
    shown = shown.withColumn("_text", F.when(F.col("_escaped"), render(F.col("_source"), escape)).otherwise(F.col("_plain")))
    back = parse(F.col("_text"))
    shown = shown.withColumn("_back", back)
    checked = F.when(F.col("_back") == F.col("_source"), F.col("_back")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("_conv").cast("string"), F.lit("null")))))
    return shown.select("_conv", "_text", "_escaped", checked.alias("_turns"), loss_spans(F.col("_text")).alias("_loss"))


def loss_text():
    """The unescaped text under the loss mask of a row of :func:`format_chats`."""
    return F.array_join(F.transform("_loss", lambda s: unescape(F.substring(F.col("_text"), s["start"] + 1, s["length"]))), "")
