"""Chat formatting by incremental black-box rendering.

A template is any function from messages to text. The prefixes of a
conversation are rendered turn by turn; what a render adds to the one before is
that turn's span, and a render that does not begin with the one before shows a
template that rewrites history. Two probe texts tell, inside a span, the text
from the marks around it, so the loss mask covers assistant texts alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import tidy

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: Turns of history that an additive template's renders see; the whole conversation
#: is rendered once at its end and must equal its segments.
WINDOW = 32
#: Control strings of ``inst_template``: fixed values.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[/?ROLE")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PROBES = "\ue000", "\ue001"


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"\1", text)


def inst_template(messages: list[Message]) -> str:
    """``<s>``, then marked turns; roles besides user and assistant are named."""
    out = ["<s>"]
    for role, text in messages:
        if role == "user":
            out += "[INST] ", escape(text), " [/INST]"
        elif role == "assistant":
            out += " ", escape(text), " </s>"
        else:
            out += "[ROLE ", escape(role).replace("]", "\\]"), "] ", escape(text), " [/ROLE]"
    return "".join(out)


#: Each message adds to the render what depends on it alone.
inst_template.additive = True


def role_of(head: str) -> str:
    """The role that the marks before a text name."""
    head = head.removeprefix("<s>")
    if head == "[INST] ":
        return "user"
    return "assistant" if head == " " else unescape(head[len("[ROLE ") : -len("] ")])


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def turn_span(template: Template, history: list[Message], message: Message) -> tuple[str, int, int, bool]:
    """What a turn adds, where its text lies in that, and whether history was rewritten."""
    before = template(history) if history else ""
    probes = [template([*history, (message[0], probe)]) for probe in _PROBES]
    after = template([*history, message])
    base = _shared(before, after)
    head = _shared(*probes)
    tail = _shared(probes[0][::-1], probes[1][::-1])
    rewrites = base < len(before)
    start = max(head - base, 0)
    return after[base:], start, max(len(after) - base - tail, start), rewrites


def format_turns(conversations: DataFrame, template: Template = inst_template, loss_role: str = "assistant", window: int | None = None) -> DataFrame:
    """One row per turn, in partitions ordered by conversation and place.

    conv_id, place (from 0), role, segment (what the turn adds to the formatted
    conversation), text_start and text_end (the text's span in the segment),
    loss (whether it is under the loss mask), offset (of the segment) and
    rewrites (the template changed what it had rendered before).

    Turns are ordered by turn, role and text, so ties and repeated rows have a
    defined order; a null turn comes first, a null role or text is empty, bytes that
    are no UTF-8 count as U+FFFD, and
    turns with a null conv_id form one conversation. Other columns are ignored,
    an empty table gives no rows. Every prefix is rendered whole, which takes
    time by the square of a conversation's length, unless the template has a true
    attribute ``additive``: its renders see the last turns, and at the end of a
    conversation the whole render must equal the segments, or the job fails. With
    ``window``, renders see that many earlier turns only, and rewrites is null
    beyond them where no rewriting shows. A task holds one conversation, or
    ``window`` turns of it.
    """
    additive = window is None and getattr(template, "additive", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, offset = object(), 0, 0
        history: deque[Message] = deque(maxlen=WINDOW if additive else window)
        whole: list[Message] = []
        segments: list[str] = []

        def verified() -> None:
            if len(whole) > WINDOW and template(whole) != "".join(segments):
                raise ValueError("the template is marked additive but rewrites history")
            whole.clear()
            segments.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for key, *said in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    role, text = (s.decode("utf-8", "replace") for s in said)
                    if key != current:
                        verified()
                        current, place, offset = key, 0, 0
                        history.clear()
                    segment, start, end, rewrites = turn_span(template, list(history), (role, text))
                    unseen = window is not None and place > window and not rewrites
                    out.append((key, place, role, segment, start, end, role == loss_role, offset, None if unseen else rewrites))
                    history.append((role, text))
                    if additive:
                        whole.append((role, text))
                        segments.append(segment)
                    place, offset = place + 1, offset + len(segment)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
                names = ["conv_id", "place", "role", "segment", "text_start", "text_end", "loss", "offset", "rewrites"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        verified()

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string").cast("binary"), F.lit(b"")).alias(c) for c in ("role", "text")]
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(tidy(run), "conv_id long, place long, role string, segment string, text_start long, text_end long, loss boolean, offset long, rewrites boolean")


def digest(turns: DataFrame, read_role: Callable[[str], str] = role_of, read_text: Callable[[str], str] = unescape) -> DataFrame:
    """Per conversation, checksums of what its formatted segments say when read back.

    ``turns`` must come from ``format_turns``, whose partitions and order it uses; rows
    in any other order fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            values = (current, count, said.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        done: list[pa.RecordBatch] = []
        current, count = None, 0
        for batch in batches:
            for key, place, segment, start, end, under, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (count if count and key == current else 0):
                    raise ValueError("turns are not in the order of their conversations")
                if key != current or not count:
                    if count:
                        done.append(result())
                    current, count, loss_chars, chars, rewritten = key, 0, 0, 0, False
                    said, loss = hashlib.sha256(), hashlib.sha256()
                text = read_text(segment[start:end])
                said.update(f"{read_role(segment[:start])}\n{text}\n".encode())
                if under:
                    loss.update(text.encode())
                    loss_chars += len(text)
                count, chars, rewritten = count + 1, chars + len(segment), True if rewritten or rewrites else None if rewritten is None or rewrites is None else False
            if len(done) >= 1000:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if count:
            done.append(result())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    read = turns.select("conv_id", "place", "segment", "text_start", "text_end", "loss", "rewrites")
    return read.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def inst_sql(extra: list[tuple[int, int, str, str]] = ()) -> str:
    """DuckDB SQL for ``digest`` of ``conversations`` and extra turns under ``inst_template``."""
    said = "".join(f" UNION ALL SELECT {key}, {turn}, '{role}', '{text}'" for key, turn, role, text in extra)
    size = lambda column: f"length(regexp_replace({column}, '(\\\\|</?s>|\\[/?INST\\]|\\[/?ROLE)', '_\\1', 'g'))"
    marks = {"user": len("[INST]  [/INST]"), "assistant": len("  </s>"), "other": len("[ROLE ]  [/ROLE]")}
    turns = f"t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations{said})"
    shown = f"{size('text')} + CASE role WHEN 'user' THEN {marks['user']} WHEN 'assistant' THEN {marks['assistant']} ELSE {marks['other']} + {size('role')} + length(role) - length(replace(role, ']', '')) END"
    order = "ORDER BY turn NULLS FIRST, role, text"
    own = "FILTER (WHERE role = 'assistant')"
    return (
        f"WITH {turns} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(sum(length(text)) {own}, 0)::BIGINT AS loss_chars, "
        f"sha256(coalesce(string_agg(text, '' {order}) {own}, '')) AS loss_sha256, (3 + sum({shown}))::BIGINT AS formatted_chars, false AS rewrites FROM t GROUP BY conv_id"
    )


def formatted(turns: DataFrame) -> DataFrame:
    """Whole formatted conversations with their loss spans, for conversations that fit a row."""
    spans = F.struct("place", "segment", F.when(F.col("loss"), F.struct((F.col("offset") + F.col("text_start")).alias("start"), (F.col("offset") + F.col("text_end")).alias("end"))).alias("span"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(spans)).alias("parts"), F.when(F.max("rewrites"), True).when(F.count("rewrites") == F.count(F.lit(1)), False).alias("rewrites"))
    return grouped.select("conv_id", F.array_join("parts.segment", "").alias("formatted"), F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_spans"), "rewrites")
