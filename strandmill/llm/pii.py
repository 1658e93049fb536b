"""Personal data: exact base patterns, and spans that a BiLSTM-CRF adds.

Every whole text is cut into overlapping windows, each window is tagged by the
recurrent network, and the emissions of overlapping windows are blended by
distance from the window's edge before one path is decoded over the whole text.
The network reads every character and decides what is a span: disguised addresses,
numbers in forms that no base pattern has. A span is kept if what is left of it
without its disguise can be a value of its kind at all, and if it overlaps no base
span of its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandmill.llm import tagger
from strandmill.llm.common import numbered, restored, tidy
from strandmill.llm.tagger import KINDS, Tagger

Span = tuple[str, int, int]

#: Characters of a window and of two windows' overlap, windows to a call of the network,
#: and characters whose emissions are held at once.
WINDOW, OVERLAP, PER_CALL, HELD = 540, 36, 1000, 300_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT, _DOT = re.compile(r"\s*[\[({]at[\])}]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE), re.compile(r"\s*[\[({](?:dot|\.)[\])}]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Emissions of a position that is known to be outside.
_FIXED = np.where(np.arange(tagger.TAGS) > 0, np.float32(-1e6), np.float32(0))[None]


def _passes_luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, value: str) -> bool:
    """Whether a value satisfies its kind's check."""
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in value.split("."))
    digits = _NOT_DIGIT.sub("", value)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _passes_luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches by kind that pass their check, by kind and start.

    Every scan takes time in proportion to the text, whatever it holds.
    """
    found = [("email", start, end) for start, end in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


def bare(kind: str, value: str) -> str:
    """A value without its disguise: words and brackets for @ and dots undone."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", value))
    return _DOT.sub(".", value) if kind == "ip" else _NOT_DIGIT.sub("", value)


def possible(kind: str, value: str) -> bool:
    """Whether a span can be a value of its kind, in whatever form."""
    plain = bare(kind, value)
    if kind == "email":
        local, _, domain = plain.partition("@")
        return bool(local) and all(map(_LOCAL.match, local)) and _DOMAIN.fullmatch(domain) is not None
    if kind == "ip":
        return _IP.fullmatch(plain) is not None and valid(kind, plain)
    return valid(kind, plain)


def _blended(model: Tagger, texts: list[np.ndarray]) -> np.ndarray:
    """Emissions of texts given as classes, end to end, blended over the windows of each."""
    step, places, begin = WINDOW - OVERLAP, [], 0
    for classes in texts:
        places += [(min(WINDOW, len(classes) - at), begin + at, at > 0, at + WINDOW < len(classes)) for at in range(0, max(len(classes) - OVERLAP, 1), step)]
        begin += len(classes)
    places.sort(reverse=True)
    line = np.concatenate(texts)
    rise = np.arange(1, OVERLAP + 1, dtype=np.float32)[:, None] ** 2
    rise /= rise + rise[::-1]
    found = np.zeros((begin, tagger.TAGS), np.float32)
    even = -(-len(places) // -(-len(places) // PER_CALL))
    for start in range(0, len(places), even):
        some = places[start : start + even]
        x = np.full((len(some), some[0][0]), tagger.PADDING, np.uint8)
        for row, (n, at, _, _) in enumerate(some):
            x[row, :n] = line[at : at + n]
        for emit, (n, at, led, followed) in zip(model.emissions(x, np.array([n for n, *_ in some])), some, strict=True):
            if led:
                emit[:OVERLAP] *= rise
            if followed:
                emit[step:] *= rise[::-1]
            found[at : at + n] += emit[:n]
    return found


def _decoded(model: Tagger, emits: list[np.ndarray], ended: list[bool]) -> list[np.ndarray]:
    """Tag paths of stretches of texts. Those that do not end their text have the tag outside behind them."""
    if not emits:
        return []
    paths = model.paths([emit if last else np.concatenate([emit, _FIXED]) for emit, last in zip(emits, ended, strict=True)])
    return [path[: len(emit)] for path, emit in zip(paths, emits, strict=True)]


def _blended_part(model: Tagger, text: str, low: int, high: int) -> np.ndarray:
    """Emissions from one place of a text to another, from the same windows as those of the whole text."""
    step = WINDOW - OVERLAP
    begin, end = max(low - OVERLAP, 0) // step * step, -(-high // step) * step + OVERLAP
    return _blended(model, [tagger.char_classes(text[begin:end])])[low - begin : high - begin]


def network_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans that the network finds, text by text; it reads every character of every text."""
    found: list[list[Span]] = [[] for _ in texts]
    some, held = [], 0
    for i, text in enumerate(texts):
        if len(text) > HELD:
            found[i] = _spans_of_long(model, text)
        elif text:
            if held + len(text) > HELD:
                _spans_of_some(model, texts, some, found)
                some, held = [], 0
            some.append(i)
            held += len(text)
    if some:
        _spans_of_some(model, texts, some, found)
    return found


def _spans_of_some(model: Tagger, texts: list[str], some: list[int], found: list[list[Span]]) -> None:
    """Spans of texts whose emissions are held at once."""
    emit = _blended(model, [tagger.char_classes(texts[i]) for i in some])
    ends = np.cumsum([len(texts[i]) for i in some])
    begins = np.concatenate([[0], ends[:-1]])
    size = 20_000
    bounds = [model.bounds(emit[at : at + size], begins[(begins >= at) & (begins < at + size)] - at) for at in range(0, len(emit), size)]
    runs, emits = [], []
    for low, high in model.undecided(bounds, ends):
        at = int(np.searchsorted(ends, low, side="right"))
        lead = _FIXED[: int(low > begins[at])]
        runs.append((some[at], low - len(lead) - int(begins[at]), bool(high == ends[at])))
        emits.append(np.concatenate([lead, emit[low:high]]))
    for (i, start, _), tags in zip(runs, _decoded(model, emits, [ended for *_, ended in runs]), strict=True):
        found[i] += _read(texts[i], start, tags)


def _spans_of_long(model: Tagger, text: str) -> list[Span]:
    """Spans of one text of any length: bounds are kept of all of it, emissions are computed again where they matter."""
    size = max(HELD // (WINDOW - OVERLAP), 1) * (WINDOW - OVERLAP)
    bounds, found = [], []
    for low in range(0, len(text), size):
        bounds.append(model.bounds(_blended_part(model, text, low, min(low + size, len(text))), np.arange(int(low == 0))))
    for low, high in model.undecided(bounds, np.array([len(text)])):
        lead = _FIXED[: int(low > 0)]
        emit = np.concatenate([lead, _blended_part(model, text, low, high)])
        found += _read(text, low - len(lead), _decoded(model, [emit], [high == len(text)])[0])
    return found


def _read(text: str, start: int, tags: np.ndarray) -> list[Span]:
    """Spans of a tag path, without blanks at their ends, that can be values of their kind."""
    out, marked, tags = [], np.flatnonzero(tags).tolist(), tags.tolist()
    at = 0
    while at < len(marked):
        first = marked[at]
        kind = (tags[first] - 1) // 2
        last = at
        while last + 1 < len(marked) and marked[last + 1] == marked[last] + 1 and tags[marked[last + 1]] == 2 * kind + 2:
            last += 1
        low, high = start + first, start + marked[last] + 1
        value = text[low:high]
        low, high = low + len(value) - len(value.lstrip()), high - len(value) + len(value.rstrip())
        if low < high and possible(KINDS[kind], text[low:high]):
            out.append((KINDS[kind], low, high))
        at = last + 1
    return out


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, both by kind and start."""
    out = []
    for text, extra in zip(texts, network_spans(model, texts), strict=True):
        base = base_spans(text) if text else []
        added = [s for s in extra if not any(s[0] == b[0] and s[1] < b[2] and b[1] < s[2] for b in base)]
        out.append((base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base))
    return out


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans
    that overlap, the longer gives the name and the union goes."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += text[at:start], f"<{kind.upper()}>"
        at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: Tagger | None = None, redact: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Spans of personal data in every whole text.

    doc_id (or the columns to carry), n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (all, written) and, if asked for, ``redacted``; beside
    carried columns the results' names begin with ``_sm_``. Offsets are code points. Null and
    empty texts have no spans; repeated rows are treated alike; null ids are
    kept; bytes that are no UTF-8 count as U+FFFD; other columns are ignored; an empty
    table gives no rows. One narrow
    pass; the model's few kilobytes travel with the tasks.
    """
    model = model or tagger.trained()
    own = [F.col("doc_id").cast("long").alias("doc_id")] if carry is None else numbered(carry)
    rows = docs.select(*own, F.col("text").cast("string").cast("binary").alias("_sm_text"))
    kept = rows.columns[:-1]
    lead = "" if carry is None else "_sm_"
    made = [StructField(f"{lead}n_{kind}", LongType()) for kind in KINDS] + [StructField(lead + name, StringType()) for name in ("base_sha256", "spans", "redacted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = [(text or b"").decode("utf-8", "replace") for text in part.column(len(kept)).to_pylist()]
                found = all_spans(model, texts)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
                sums = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                columns = [*part.columns[: len(kept)], *counts, pa.array(sums), pa.array([written(spans) for _, spans in found])]
                names = [*kept, *(f.name for f in made[:6])]
                if redact:
                    columns.append(pa.array([redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string()))
                    names.append(made[6].name)
                yield pa.RecordBatch.from_arrays(columns, names)

    found = rows.mapInArrow(tidy(run), StructType([*rows.schema.fields[:-1], *made[: 6 + redact]]))
    return found if carry is None else restored(found, carry)
