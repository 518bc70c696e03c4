"""Chat formatting with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings a tokenizer may treat as control, here or in another template. Each is its first character and the rest.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<SYS>", "</SYS>")
_REST = "|".join("".join(f"\\{x}" if not x.isalnum() else x for x in s[1:]) for s in CONTROL)
_BARE = rf"[<\[]({_REST})"


def escape(c: Column) -> Column:
    """One more backslash behind the first character of each control string, escaped or not: a bijection."""
    return F.regexp_replace(c, rf"([<\[])(\\*)({_REST})", r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def escape_role(c: Column) -> Column:
    """As :func:`escape`, and a line break, which ends the role in the template, becomes ``<NL>``."""
    return F.replace(F.regexp_replace(escape(c), r"<(\\*)NL>", r"<$1\\NL>"), F.lit("\n"), F.lit("<NL>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(c, F.lit("<NL>"), F.lit("\n")), r"<\\(\\*)NL>", "<$1NL>"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse_turns(formatted: Column) -> Column:
    """The deterministic parser: array of (role, text), unescaped, of a rendered conversation.

    A bare control string inside a turn breaks the grammar and gives null for that part.
    """
    def plain(part: Column, decoded: Column) -> Column:
        return F.when(~part.rlike(_BARE), decoded)

    chunks = F.filter(F.split(formatted, "\\Q" + CLOSE + "\n\\E", -1), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(
        plain(_role_part(c), unescape_role(_role_part(c))).alias("role"), plain(_text_part(c), unescape(_text_part(c))).alias("text")))


def _role_part(chunk: Column) -> Column:
    return F.substring(F.substring_index(chunk, "\n", 1), len(OPEN) + 1, 2**31 - 1)


def _text_part(chunk: Column) -> Column:
    return F.substring(chunk, F.char_length(F.substring_index(chunk, "\n", 1)) + 2, F.lit(2**31 - 1))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 train_on: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted`` and ``loss_runs``.

    Each turn is rendered as it is, parsed again and compared with its source; where the parser
    recovers something else the conflicting strings are escaped and the turn is tried again, until
    it comes back identical. ``loss_runs`` has (skip, take) for each turn: of the code points up to
    the turn's end mark, ``take`` after ``skip`` are trained on, which is the text of ``train_on`` turns.

    Turns are rendered and escaped before the one shuffle. A conversation's text is one cell, which
    is the result asked for, and so must fit one (2 GB).

    Null roles and texts count as empty. Turns are ordered by turn (null first), then role and rendered text,
    so ties and repeated rows have a fixed order and are all kept. A null conversation id is a
    conversation of its own. Other columns are not used.
    """
    one = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("_llm_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_llm_role"), F.coalesce(F.col(text), F.lit("")).alias("_llm_text"))
    source = F.array(F.struct(F.col("_llm_role").alias("role"), F.col("_llm_text").alias("text")))
    one = one.withColumns({"_llm_head": F.col("_llm_role"), "_llm_body": F.col("_llm_text")})
    for again in (False, True):
        same = parse_turns(render_turn(F.col("_llm_head"), F.col("_llm_body"))).eqNullSafe(source)
        if again:  # escaping is a bijection onto texts without bare control strings, so this never fails
            failed = F.raise_error(F.lit("a turn does not survive its round trip")).cast("string")
            one = one.withColumn("_llm_body", F.when(same, F.col("_llm_body")).otherwise(failed))
        else:
            one = one.withColumn("_llm_same", same).withColumns({
                "_llm_head": F.when(F.col("_llm_same"), F.col("_llm_head")).otherwise(escape_role(F.col("_llm_role"))),
                "_llm_body": F.when(F.col("_llm_same"), F.col("_llm_body")).otherwise(escape(F.col("_llm_text")))})
    rendered = one.select(
        "conv_id", "_llm_turn", "_llm_role", "_llm_text", render_turn(F.col("_llm_head"), F.col("_llm_body")).alias("_llm_out"),
        (F.char_length("_llm_head") + len(OPEN) + 1).cast("long").alias("_llm_skip"),
        F.when(F.col("_llm_role") == train_on, F.char_length("_llm_body")).otherwise(0).cast("long").alias("_llm_take"))
    ordered = F.array_sort(F.collect_list(F.struct("_llm_turn", "_llm_role", "_llm_out", "_llm_skip", "_llm_take")))
    whole = rendered.groupBy("conv_id").agg(ordered.alias("_llm_turns"))
    return whole.select(
        "conv_id", F.size("_llm_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_llm_turns", lambda t: t["_llm_out"]), "").alias("formatted"),
        F.transform("_llm_turns", lambda t: F.struct(t["_llm_skip"].alias("skip"), t["_llm_take"].alias("take"))).alias("loss_runs"))


def loss_texts(formatted: Column, loss_runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order; turns without loss give an empty string."""
    chunks = F.filter(F.split(formatted, "\\Q" + CLOSE + "\n\\E", -1), lambda c: c != "")
    return F.zip_with(chunks, loss_runs, lambda c, r: unescape(F.substring(c, r["skip"].cast("int") + 1, r["take"].cast("int"))))
