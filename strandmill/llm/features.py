"""Document statistics for the quality classifier, from whole texts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

NAMES = (
    "log_bytes", "log_words", "word_length", "upper_share", "letter_share", "digit_share", "sign_share", "blank_share",
    "pipe_share", "junk_words", "shout_words", "distinct_words", "top_word", "line_length", "repeated_lines", "stop_signs",
    "other_script", "repeated_windows",
)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PROSE_SIGNS = b".,;:'\"()-"
_SIGNS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _PROSE_SIGNS)
_HIGH = bytes(range(128, 256))
_TAIL = re.compile(rb"[^\w\s.,;:'\"()\-\x80-\xff]{2,}(?:\s|$)")


def statistics(text: bytes) -> list[float]:
    """Raw statistics of one UTF-8 text; an empty text has defined values as well."""
    size = len(text)
    words = text.split()
    n = len(words)
    base = max(size, 1)
    count = lambda drop: size - len(text.translate(None, drop))
    letters, upper, high = count(_LETTERS), count(_UPPER), count(_HIGH)
    times = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    line_times = Counter(lines)
    repeated = sum(c - 1 for c in line_times.values())
    windows = Counter(zip(words[::3], words[1::3], words[2::3], strict=False))
    shout = sum(c for w, c in times.items() if w.endswith(b"!!")) if b"!!" in text else 0
    junk = len(_TAIL.findall(text))
    return [
        np.log1p(size),
        np.log1p(n),
        size / max(n, 1),
        upper / max(letters, 1),
        (letters + high) / base,
        count(_DIGITS) / base,
        count(_SIGNS) / base,
        (size - sum(map(len, words))) / base,
        text.count(b"|") / max(n, 1),
        junk / max(n, 1),
        shout / max(n, 1),
        len(times) / max(n, 1),
        max(times.values(), default=0) / max(n, 1),
        np.log1p(size / max(len(lines), 1)),
        repeated / max(len(lines), 1),
        (text.count(b".") + text.count(b",")) / max(n, 1),
        high / base,
        1 - len(windows) / max(sum(windows.values()), 1),
    ]


def transformed(raw: np.ndarray) -> np.ndarray:
    """Shares are bent by a logit so that rare and frequent values spread alike."""
    out = np.array(raw, dtype=float, copy=True)
    for i, name in enumerate(NAMES):
        if name not in ("log_bytes", "log_words", "line_length", "word_length"):
            share = np.clip(out[:, i], 0.0, 1.0)
            out[:, i] = np.log((share + 0.005) / (1.005 - share))
    out[:, NAMES.index("word_length")] = np.log1p(out[:, NAMES.index("word_length")])
    return out
