r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Each turn is rendered as

    <s>[INST role]text[/INST]</s>

and a conversation is its turns one after another. Control strings (`<s>`, `</s>`, `[INST`, `[/INST`)
inside a text are escaped by one backslash after their first character; where backslashes already stand
there, one more is put in, so that the change can be undone. A role is written percent-encoded, so it
holds no bracket. Every rendered turn is reparsed by the same deterministic parser that reads whole
conversations; a turn whose text does not come back unchanged is rendered again in the next stronger
form, until it does: as it is (`[INST role]`), escaped (`[INST role e]`), percent-encoded
(`[INST role u]`). The whole conversation is parsed again too, and its turns compared with the source by a
hash of role and text each; a conversation that differed would end the job with an error.

The loss mask covers the text of assistant turns: `loss_spans` holds the (start, end) code points of
their rendered texts.

Defined cases: a null text is empty, a null role is empty; turns are ordered by turn, role and text, null
turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation; an
empty table gives no rows; a conversation is one row, as its digest asks for it whole; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>[INST ", "[/INST]</s>"
#: First character, backslashes, rest of a control string.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _forms(text: Column) -> list[tuple[str, Column]]:
    """(mark, rendered text), from the plainest."""
    return [("", text), (" e", escape(text)), (" u", F.url_encode(text))]


def _render(role: Column, mark: str, body: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(mark + "]"), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, form, body, text)."""
    segments = F.filter(F.split(formatted, CLOSE.replace("[", r"\["), -1), lambda s: s.startswith(OPEN))

    def turn(s: Column) -> Column:
        head = F.split_part(F.substr(s, F.lit(len(OPEN) + 1)), F.lit("]"), F.lit(1))
        body = F.substr(s, F.lit(len(OPEN) + 2) + F.length(head))
        form = F.split_part(head, F.lit(" "), F.lit(2))
        text = F.when(form == "e", unescape(body)).when(form == "u", F.url_decode(body)).otherwise(body)
        return F.struct(F.url_decode(F.split_part(head, F.lit(" "), F.lit(1))).alias("role"), form.alias("form"), body.alias("body"), text.alias("text"))

    return F.transform(segments, turn)


def rendered_turn(role: Column, text: Column) -> Column:
    """The plainest form of a turn that the parser gives back unchanged."""
    out = None
    for mark, body in reversed(_forms(text)):
        form = _render(role, mark, body)
        # control strings are what can differ; without any of their first characters the plain form stands
        back = parse(form)
        same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text) & (F.length(form) == F.length(back[0]["body"]) + F.lit(len(OPEN) + len(mark) + 1 + len(CLOSE)) + F.length(F.url_encode(role)))
        if not mark:
            same = ~text.rlike(_CONTROL) & same
        out = F.when(same, form).otherwise(F.raise_error(F.lit("a turn that no form brings back")).cast("string") if out is None else out)
    return out


def formatted(conversations: DataFrame) -> DataFrame:
    """Per conv_id: formatted text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", "text", rendered_turn(F.col("role"), F.col("text")).alias("out")).alias("t"))
    turns = turns.select("conv_id", F.struct("t.turn", "t.role", "t.out", F.xxhash64("t.role", "t.text").alias("sum")).alias("t"))
    made = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.array_join(F.col("t.out"), "").alias("formatted"), F.col("t.sum").alias("sums"))
    same = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"])) == F.col("sums")
    return made.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation that does not parse back")).cast("string")).alias("formatted"))


def _loss_spans(turns: Column) -> Column:
    """(start, end) of the rendered assistant texts, code points of the formatted text."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head = F.length(F.url_encode(t["role"])) + F.when(t["form"] == "", 0).otherwise(F.length(t["form"]) + 1) + len(OPEN) + 1
        a = (state["at"] + head).cast("long")
        b = (a + F.length(t["body"])).cast("long")
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + len(CLOSE)).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def read_back(texts: DataFrame) -> DataFrame:
    """formatted() with turns and loss_spans as the parser recovers them from the formatted text."""
    return texts.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_spans", _loss_spans(F.col("turns")))


def digests(texts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of read_back()'s rows."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # what the mask covers, cut from the formatted text, unescaped by its turn's form
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    cut = F.zip_with(own, F.col("loss_spans"), lambda t, s: F.struct(t["form"].alias("form"), F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("body")))
    loss = F.array_join(F.transform(cut, lambda c: F.when(c["form"] == "e", unescape(c["body"])).when(c["form"] == "u", F.url_decode(c["body"])).otherwise(c["body"])), "")
    out = texts.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
