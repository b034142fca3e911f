"""Chat formatting with a finite-state machine over roles.

The states of the machine are the roles: after a turn it is in the state of the turn's role, before the first one in START, and
a template says which roles may follow which state and in which states a request may end. A turn out of
order is reported, and the machine goes on from its role, so one slip is one breach. Segments need
nothing but their own turn, so texts never move; order is checked on request, position and role alone.

Column expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from itemnorm.session import cut_lineage

START = ""
#: Turns whose order is checked together; a longer request goes on in the next chunk.
SPAN_BITS = 16


@dataclass(frozen=True)
class ChatTemplate:
    """How a turn is written, which roles may follow which, and whose texts are learned from.

    A turn is `begin` role `after_role` text `end` `after_turn`. The marks are the control strings: where a role or
    text holds one it is written as `escape` and its number, and `escape` itself as `escape` and 0. A
    role holds no `after_role` either.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    escape: str = "␛"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.begin, self.end)
        if len(self.escape) != 1 or not all((*marks, self.after_role)) or self.begin == self.end:
            raise ValueError("the escape is one character, and the marks are different and not empty")
        if any(self.escape in m for m in (*marks, self.after_role, self.after_turn)) or self.begin in self.end + self.after_turn:
            raise ValueError("no mark holds the escape, and what ends a turn does not begin one")
        for a in marks:
            for b in marks:
                # Else a text and the mark after it could look like a mark that begins earlier.
                if (a != b and b in a) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) + (a != b)))):
                    raise ValueError("no end of a mark begins a mark")
        if any(self.after_role.endswith(self.after_role[:n]) for n in range(1, len(self.after_role))):
            raise ValueError("no end of a mark begins a mark")

    def codes(self, role: bool = False) -> list[tuple[str, str]]:
        """What is written for what; the escape first."""
        found = [self.escape, self.begin, self.end, *([self.after_role] if role else [])]
        return [(held, f"{self.escape}{n}") for n, held in enumerate(found)]

    def escaped(self, text: Column, role: bool = False) -> Column:
        for held, code in self.codes(role):
            text = F.replace(text, F.lit(held), F.lit(code))
        return text

    def unescaped(self, text: Column, role: bool = False) -> Column:
        for held, code in reversed(self.codes(role)):
            text = F.replace(text, F.lit(code), F.lit(held))
        return text


def chat_segments(messages: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """request_id, turn, segments: one line per message, in the template's words.

    messages(request_id, pos, role, content). turn orders the messages of a request: by pos, nulls first, then by role and a hash of the
    content. segments is an array of (text, loss): the mark and role, the escaped content, the end mark; loss is
    true for the content of a role that is learned from. The formatted request is the texts of all its
    segments one after the other.

    A null role or content counts as empty, a null request_id is a request of its own; repeated rows are turns
    each; an empty table gives an empty one; contents of any length are escaped whole. Other columns are ignored.
    """
    t = template or ChatTemplate()
    role, content = F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return messages.select(
        "request_id",
        F.struct(F.col("pos").alias("pos"), role.alias("role"), F.xxhash64(content).alias("key")).alias("turn"),
        F.array(
            segment(F.concat(F.lit(t.begin), t.escaped(role, role=True), F.lit(t.after_role)), F.lit(False)),
            segment(t.escaped(content), role.isin(*t.loss_roles)),
            segment(F.lit(t.end + t.after_turn), F.lit(False)),
        ).alias("segments"),
    )


def chat_checks(messages: DataFrame, template: ChatTemplate | None = None, span_bits: int = SPAN_BITS) -> DataFrame:
    """request_id, turns, breaches, first_breach, accepted: one line per request.

    breaches counts the messages whose role may not follow the state before them, first_breach is the 0-based number of the
    first of them, null without any. accepted: no breach, and the last state is a final one. Rows as in
    chat_segments. Messages are numbered in sorted parts of the whole table, so a request that
    holds a third of all of them is checked by many tasks; one line per chunk carries the state on.
    """
    t = template or ChatTemplate()
    role = F.coalesce("role", F.lit(""))
    turns = messages.select("request_id", "pos", role.alias("role"), F.xxhash64(F.coalesce("content", F.lit(""))).alias("key"))
    order = ["request_id", "pos", "role", "key"]
    numbered = cut_lineage(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("request_id", "role", F.monotonically_increasing_id().alias("n")))
    chunked = numbered.withColumn("chunk", F.shiftright("n", span_bits))
    inside = Window.partitionBy("chunk").orderBy("n")
    last = F.max_by(F.struct("request_id", "role"), F.col("n")).alias("last")
    edges = chunked.groupBy("chunk").agg(last).withColumn("before", F.lag("last").over(Window.orderBy("chunk"))).select("chunk", "before")
    before = F.coalesce(F.lag(F.struct("request_id", "role")).over(inside), F.col("before"))
    seen = chunked.join(edges, "chunk").withColumn("before", before)
    state = F.when(F.col("before").isNotNull() & F.col("before.request_id").eqNullSafe(F.col("request_id")), F.col("before.role")).otherwise(F.lit(START))
    first = ~(F.col("before").isNotNull() & F.col("before.request_id").eqNullSafe(F.col("request_id")))
    # An empty role is no start: it may not follow or be followed by anything the template does not name.
    allowed = F.lit(False)
    for held, roles in t.follows.items():
        allowed = allowed | ((first if held == START else ~first & (state == held)) & F.col("role").isin(*roles))
    judged = seen.select("request_id", "n", "role", (~allowed).alias("breach"))
    found = judged.groupBy("request_id").agg(
        F.count("*").alias("turns"), F.count_if("breach").alias("breaches"), F.min("n").alias("_from"),
        F.min(F.when(F.col("breach"), F.col("n"))).alias("_at"), F.max_by("role", "n").alias("_last"),
    )
    ends = F.col("_last").isin(*t.final) if t.final else F.lit(False)
    # Numbers have gaps between sorted parts, so the messages before the first breach are counted.
    early = judged.join(found.where(F.col("_at").isNotNull()).select(F.col("request_id").alias("_id"), "_at"), F.col("request_id").eqNullSafe(F.col("_id")) & (F.col("n") < F.col("_at")))
    firsts = early.groupBy("_id").agg(F.count("*").alias("_n"))
    return found.join(firsts, F.col("request_id").eqNullSafe(F.col("_id")), "left").select(
        "request_id", "turns", "breaches",
        F.when(F.col("_at").isNotNull(), F.coalesce("_n", F.lit(0).cast("bigint"))).alias("first_breach"),
        ((F.col("breaches") == 0) & ends).alias("accepted"),
    )


def format_chats(segments: DataFrame) -> DataFrame:
    """request_id, formatted, loss_text: each request as one string, and the escaped texts under its loss mask joined.

    One request becomes one value, as a model reads it; chat_segments is the form for requests that are too long for that.
    """
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "segments"))), lambda m: m["segments"]))
    held = segments.groupBy("request_id").agg(ordered.alias("_s"))
    return held.select(
        "request_id",
        F.array_join(F.transform("_s", lambda s: s["text"]), "").alias("formatted"),
        F.array_join(F.transform(F.filter("_s", lambda s: s["loss"]), lambda s: s["text"]), "").alias("loss_text"),
    )


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Array of (role, content) read back from a formatted request."""
    t = template or ChatTemplate()
    # What stands before the first mark is no turn.
    turns = F.filter(F.split(formatted, _literal(t.begin)), lambda p, n: n > 0)

    def turn(part: Column) -> Column:
        body = F.substring_index(part, t.end, 1)
        cut = F.locate(t.after_role, body)
        return F.struct(
            t.unescaped(F.substring(body, F.lit(1), cut - 1), role=True).alias("role"),
            t.unescaped(F.substring(body, cut + len(t.after_role), F.length(body))).alias("content"),
        )

    return F.transform(turns, turn)


def _literal(mark: str) -> str:
    """A pattern for exactly this text."""
    return "\\Q" + mark.replace("\\E", "\\E\\\\E\\Q") + "\\E"
