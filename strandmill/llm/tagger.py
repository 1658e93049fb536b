"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Training data are labelled windows made by ``labelled_window``: invented words
with addresses and numbers of four kinds among them, plain or disguised, and
look-alikes that are none. ``train`` fits the model; its weights lie beside this
module, written by ``python -m strandmill.llm.tagger``, so that every machine tags
alike.
"""

from __future__ import annotations

import functools
import os
import random
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Character classes: fixed values; letters, digits and high characters follow.
SIGNS = " \n.-()+@_%,=\":/[]{}"
CLASSES = len(SIGNS) + 5 + 26
WIDTH = 72
HIDDEN = 8
#: Allowance for rounding in the bound on paths.
SLACK = 0.01
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tagger_weights.npz")


def char_classes(text: str) -> np.ndarray:
    """Class of every code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(codes, 128)]


def _class_table() -> np.ndarray:
    table = np.zeros(129, np.uint8)
    table[ord("0") : ord("9") + 1] = 1
    table[128] = 2
    for i, sign in enumerate(SIGNS):
        table[ord(sign)] = 3 + i
    for case in "aA":
        table[ord(case) : ord(case) + 26] = 3 + len(SIGNS) + np.arange(26)
    return table


_TABLE = _class_table()
PADDING = CLASSES - 1


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random, least: int = 1, most: int = 9, letters: str = "eeeaaiinnoorrssttlldhcumpgbvkfwyzqxj") -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def _email(rng: random.Random) -> str:
    name = (_word(rng, 2, 9) + rng.choice(["", ".", "_", "-", "+"]) + rng.choice([_digits(rng, rng.randint(0, 4)), _word(rng, 1, 5)])).strip("._-+") or "a"
    host = _word(rng, 2, 8) + rng.choice(["", "", _digits(rng, 1), "-" + _word(rng, 2, 4)])
    ends = rng.choice([["com"], ["org"], ["de"], ["net"], ["example"], [_word(rng, 2, 7), "com"], [_word(rng, 2, 3)]])
    at, dot = rng.choice([("@", ".")] * 5 + [(" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", " . "), ("@", " dot ")])
    return name + at + dot.join([host, *ends])


def _personal(rng: random.Random) -> tuple[str, str]:
    kind = rng.choice(KINDS)
    if kind == "email":
        return kind, _email(rng)
    if kind == "ip":
        return kind, rng.choice([".", ".", ".", "[.]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = _digits(rng, rng.choice([16, 16, 16, 16, 17, 18, 19]))
        sign = rng.choice(["", "", " ", "-", ".", "  "])
        return kind, sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, a, b, land = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), rng.randint(1, 99)
    forms = (
        f"+{rng.randint(1, 9)} ({area}) {a}-{b}", f"+{rng.randint(1, 9)} ({area}) {a}-{b}", f"+{land} {area} {a}{b}", f"+{land}-{area}-{a}-{b}", f"+{_digits(rng, rng.randint(9, 13))}",
        f"+{land} {area[:2]} {b} {b}", f"({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"0{area[:2]} {a}{b}", f"0{area}/{a}{b}", f"00{land} {area} {a}{b}",
    )
    return kind, rng.choice(forms)


def _look_alike(rng: random.Random) -> str:
    year = str(rng.randint(1900, 2099))
    forms = (
        year, f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}",
        _digits(rng, rng.randint(1, 13)), _digits(rng, rng.randint(22, 40)), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 32, 40]))),
        "AKIA" + "".join(rng.choice("ABCDEFGHJKMNPQ23456789") for _ in range(16)), f"{rng.randint(1, 999)},{_digits(rng, 3)}", f"+{rng.randint(1, 99)}", f"@{_word(rng)}",
        f'token = "{_digits(rng, 6)}{_word(rng)}"', f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", f"({rng.randint(1, 99)})",
        f"{_word(rng)} at {_word(rng)}", f"the {_word(rng)} dot {_word(rng)}", f"{_word(rng)} at {rng.randint(1, 12)}:{rng.randint(10, 59)}", f"({year})", f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{year}",
        f"{rng.randint(1, 99)} {rng.randint(100, 999)}", f"{rng.randint(1, 9)} of {rng.randint(10, 99)}",
    )
    return rng.choice(forms)


def labelled_window(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A window of text and the (kind, start, end) spans of personal data in it."""
    text, spans = "", []
    lead = rng.randint(-12, 20)
    while len(text) < WIDTH - lead:
        pick = rng.random()
        if pick < 0.35:
            kind, value = _personal(rng)
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        elif pick < 0.5:
            text += _look_alike(rng)
        else:
            word = _word(rng)
            text += rng.choice([word, word, word.capitalize(), word + rng.choice(",.:"), "é" + word, word.upper()])
        text += rng.choice([" ", " ", " ", " ", ". ", ", ", "\n"])
    cut = rng.randint(0, max(len(text) - WIDTH, 0))
    inside = [(k, max(s - cut, 0), min(e - cut, WIDTH)) for k, s, e in spans if s - cut < WIDTH and e > cut]
    return text[cut : cut + WIDTH], inside


def _training_set(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    x = np.full((rows, WIDTH), PADDING, np.int64)
    y = np.zeros((rows, WIDTH), np.int64)
    for i in range(rows):
        text, spans = labelled_window(rng)
        x[i, : len(text)] = char_classes(text)
        for kind, start, end in spans:
            tag = 1 + 2 * KINDS.index(kind)
            y[i, start:end] = tag + 1
            y[i, start] = tag if start else y[i, start]
    return x, y


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * v))


def _both_ways(x: np.ndarray) -> np.ndarray:
    """A batch of class sequences, forwards and backwards."""
    return np.stack([x, x[:, ::-1]])


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (direction, row, step, unit) and what the gradient needs."""
    entered = np.stack([wx[d][x[d]] for d in (0, 1)])
    h = np.zeros((2, x.shape[1], HIDDEN), wx.dtype)
    c = np.zeros_like(h)
    out, kept = np.empty((*x.shape, HIDDEN), wx.dtype), []
    for t in range(x.shape[2]):
        gates = entered[:, :, t] + h @ wh
        ifo = _sigmoid(gates[..., : 3 * HIDDEN])
        g = np.tanh(gates[..., 3 * HIDDEN :])
        before = c
        c = ifo[..., HIDDEN : 2 * HIDDEN] * c + ifo[..., :HIDDEN] * g
        squashed = np.tanh(c)
        h = ifo[..., 2 * HIDDEN :] * squashed
        out[:, :, t] = h
        if keep:
            kept.append((before, ifo, g, squashed))
    return out, kept


def _lstm_gradient(x: np.ndarray, wh: np.ndarray, hidden: np.ndarray, kept: list, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turned = wh.transpose(0, 2, 1)
    all_gates = np.empty((*x.shape, 4 * HIDDEN), wh.dtype)
    d_h = np.zeros_like(up[:, :, 0])
    d_c = np.zeros_like(d_h)
    for t in range(x.shape[2] - 1, -1, -1):
        before, ifo, g, squashed = kept[t]
        i, f, o = ifo[..., :HIDDEN], ifo[..., HIDDEN : 2 * HIDDEN], ifo[..., 2 * HIDDEN :]
        d_h = d_h + up[:, :, t]
        d_c = d_c + d_h * o * (1 - squashed * squashed)
        gates = all_gates[:, :, t]
        gates[..., : 3 * HIDDEN] = np.concatenate([d_c * g, d_c * before, d_h * squashed], axis=2) * ifo * (1 - ifo)
        gates[..., 3 * HIDDEN :] = d_c * i * (1 - g * g)
        d_h, d_c = gates @ turned, d_c * f
    flat = all_gates.reshape(2, -1, 4 * HIDDEN)
    marks = np.eye(CLASSES, dtype=wh.dtype)[x].reshape(2, -1, CLASSES)
    before_h = np.concatenate([np.zeros_like(hidden[:, :, :1]), hidden[:, :, :-1]], axis=2).reshape(2, -1, HIDDEN)
    return marks.transpose(0, 2, 1) @ flat, before_h.transpose(0, 2, 1) @ flat


def _crf_gradient(emit: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by emissions and transitions."""
    rows, steps, _ = emit.shape
    own = np.exp(emit - emit.max(axis=2, keepdims=True))
    step = np.exp(move)
    ahead, back = np.empty_like(own), np.ones_like(own)
    ahead[:, 0] = own[:, 0] / own[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        v = (ahead[:, t - 1] @ step) * own[:, t]
        ahead[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        v = (own[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] = v / v.sum(axis=1, keepdims=True)
    d_emit = ahead * back
    d_emit /= d_emit.sum(axis=2, keepdims=True)
    pair = ahead[:, :-1, :, None] * step * (own * back)[:, 1:, None, :]
    d_move = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    d_emit[np.arange(rows)[:, None], np.arange(steps)[None], y] -= 1
    np.add.at(d_move, (y[:, :-1], y[:, 1:]), -1)
    return d_emit / rows, d_move / rows


def _emissions(x: np.ndarray, lengths: np.ndarray, wx: np.ndarray, wh: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What the output layer makes of both directions' states (row, step, tag), as of those of
    ``_lstm``. The second direction begins where its row ends, so padding has no influence,
    and rows at the end of the batch leave the loop when they have ended; their padding gets zeros.

    Gates lie one after another, so that every operation runs over a whole block, one small
    enough for the processor's cache where it can be. A sigmoid
    is 1 / (1 + exp(-z)), a tanh twice that of 2z, less one: numpy's exp takes about half of
    its tanh's time. Signs and factors are in the weights, cells are kept times -2 and states
    times 1/2; an exp that overflows gives the limit. States of all steps meet the output
    layer at once.
    """
    rows, steps = x.shape
    scale = np.array([-1, -1, -1, -2], wx.dtype)[:, None]
    tables = np.ascontiguousarray((wx.reshape(2, CLASSES, 4, HIDDEN) * scale).transpose(0, 2, 1, 3))
    turn = np.ascontiguousarray((2 * wh.reshape(2, HIDDEN, 4, HIDDEN) * scale).transpose(0, 2, 1, 3))
    out = 2 * out.reshape(2, HIDDEN, -1)
    back = np.arange(steps - 1, -1, -1)[None]
    if lengths.min() < steps:
        back = back - (steps - lengths[:, None])  # below zero: from the end
    turned = x[:, back[0]] if len(back) == 1 else np.take_along_axis(x, back, axis=1)
    forwards, backwards = np.ascontiguousarray(x.T), np.ascontiguousarray(turned.T)
    states = np.zeros((steps, 2, rows, HIDDEN), wx.dtype)
    all_gates, all_more = np.empty((2, 2, 4, rows, HIDDEN), wx.dtype)
    cells = np.zeros((2, 2, rows, HIDDEN), wx.dtype)
    one, two, half, top_of_g = np.array([1, 2, 0.5, -4], wx.dtype)
    # Rows up to the last that is longer than each step.
    running = np.searchsorted(-np.maximum.accumulate(lengths[::-1])[::-1], -np.arange(steps)).tolist()
    live = -1
    with np.errstate(over="ignore"):
        for t in range(steps):
            if running[t] != live:
                live = running[t]
                gates, more = all_gates[:, :, :live], all_more[:, :, :live]
                c, moved = cells[:, :, :live]
                i, f, o, g = gates[:, 0], gates[:, 1], gates[:, 2], gates[:, 3]
                blocks = [(gates[d, k], more[d, k], one if k < 3 else top_of_g) for d in (0, 1) for k in range(4)]
            tables[0].take(forwards[t, :live], axis=1, out=gates[0], mode="clip")
            tables[1].take(backwards[t, :live], axis=1, out=gates[1], mode="clip")
            if t:
                np.matmul(states[t - 1, :, None, :live], turn, out=more)
            for gate, extra, top in blocks:
                if t:
                    gate += extra
                np.exp(gate, out=gate)
                gate += one
                np.divide(top, gate, out=gate)
            g += two
            c *= f
            c += np.multiply(i, g, out=g)
            np.exp(c, out=moved)
            moved += one
            np.divide(one, moved, out=moved)
            moved -= half
            np.multiply(o, moved, out=states[t, :, :live])
    ahead = np.matmul(states[:, 0].transpose(1, 0, 2), out[0])
    for row, n in enumerate(lengths.tolist()):
        ahead[row, :n] += (states[:n, 1, row] @ out[1])[::-1]
    return ahead


@dataclass
class Tagger:
    """Parameters: input (x) and recurrent (h) weights of both directions, output layer, transitions."""

    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Emissions (row, step, tag) of windows, which are as long as they are wide unless lengths are given."""
        w = self.weights
        emit = _emissions(x, np.full(len(x), x.shape[1]) if lengths is None else lengths, w["x"], w["h"], w["out"])
        emit.reshape(len(x), -1)[:] += np.tile(w["bias"], x.shape[1])
        return emit

    def bounds(self, emit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By position of sequences laid end to end, the most that a path can gain by leaving
        the tag outside there, and by staying away from it there."""
        move = self.weights["move"] - self.weights["move"][0, 0]
        lead = np.ascontiguousarray(emit[:, 1:].T)
        lead -= np.ascontiguousarray(emit[:, 0])
        alone = lead[:, begins].max(axis=0)
        lead += move[0, 1:, None]
        first = lead.max(axis=0)
        first[begins] = alone
        lead += (move[1:, 1:].max(axis=0) - move[0, 1:])[:, None]
        later = lead.max(axis=0)
        later[begins] -= 1e5  # no path goes on into the next sequence
        return first, later

    def undecided(self, bounds: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of sequences, laid end to end, outside of which their best paths have the tag outside.

        A path that leaves that tag at one position and comes back after another gains no
        more than its first tag's emission and transition, the best of each later tag with
        the best transition into it, and the best transition back. Where no such sum over a
        position reaches zero, the tag is settled; so decoding the stretches alone, with the
        tag outside around them, gives the best path of the whole. Bounds come in parts,
        whose scans are as exact as one scan of all.
        """
        back = float((self.weights["move"][1:, 0] - self.weights["move"][0, 0]).max())
        reached, before = [], -np.inf
        for first, later in bounds:
            sums, top = np.cumsum(later, dtype=np.float64), first.astype(np.float64)
            top[0] = max(top[0], before + later[0])
            top = np.maximum.accumulate(top - sums) + sums
            reached.append(top.astype(np.float32))
            before = top[-1]
        marks = np.zeros(ends[-1] + 1, np.int8)
        high, after = int(ends[-1]), 0.0
        for (_, later), top in zip(reversed(bounds), reversed(reached), strict=True):
            low = high - len(later)
            sums = np.cumsum(later, dtype=np.float64)
            left = sums + back
            left[-1] = sums[-1] + after
            inner = ends[(ends > low) & (ends < high)] - 1 - low
            left[inner] = sums[inner]
            left = np.maximum.accumulate(left[::-1])[::-1] - sums
            marks[low:high] = top + left >= -SLACK
            high, after = low, max(back, float(later[0]) + left[0])
        edges = np.flatnonzero(np.diff(marks, prepend=np.int8(0)))
        cuts = ends[:-1][(marks[ends[:-1] - 1] > 0) & (marks[ends[:-1]] > 0)]
        edges = np.sort(np.concatenate([edges, cuts, cuts]))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """Best tag paths of a batch of emission sequences."""
        return np.stack(self.paths(list(emit)))

    def paths(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag paths of emission sequences of any lengths, none empty.

        All go through one loop, the longest first, and leave it when they have ended, so
        that it has as many steps as the longest and holds as much as all have positions.
        """
        lengths = np.array([len(emit) for emit in emits])
        order = np.argsort(-lengths, kind="stable")
        within = np.concatenate([np.arange(n) for n in lengths[order]])
        by_step = np.argsort(within, kind="stable")
        live = np.bincount(within)
        ends = np.cumsum(live).tolist()
        live = live.tolist()
        best = np.concatenate([emits[i] for i in order])[by_step]
        move, turned = self.weights["move"][:, None], self.weights["move"].T
        steps = [best[end - n : end] for n, end in zip(live, ends, strict=True)]
        for before, after in zip(steps, steps[1:]):
            after += (before[: len(after)].T[:, :, None] + move).max(axis=0)
        tags = np.empty(len(best), np.int64)
        path = np.empty(0, np.int64)
        for own, end in zip(reversed(steps), reversed(ends)):
            own[: len(path)] += turned[path]
            path = own.argmax(axis=1)
            tags[end - len(own) : end] = path
        in_order = np.empty_like(tags)
        in_order[by_step] = tags
        found: list[np.ndarray] = [in_order] * len(emits)
        for i, path in zip(order.tolist(), np.split(in_order, np.cumsum(lengths[order])[:-1]), strict=True):
            found[i] = path
        return found


@functools.lru_cache(maxsize=1)
def trained() -> Tagger:
    """The model whose weights lie beside this module."""
    with np.load(WEIGHTS) as stored:
        return Tagger({name: stored[name] for name in stored.files})


def train(seed: int = 7, rows: int = 25_600, batch: int = 32, epochs: int = 5, rate: float = 0.05) -> Tagger:
    """Fit a model by Adam with a falling rate."""
    x, y = _training_set(rows, seed)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(HIDDEN), shape).astype(np.float32)
    w = {"x": draw(2, CLASSES, 4 * HIDDEN), "h": draw(2, HIDDEN, 4 * HIDDEN), "out": draw(2 * HIDDEN, TAGS)}
    w |= {"bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
    w["x"][:, :, HIDDEN : 2 * HIDDEN] += 1.0
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, epochs * (rows // batch)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, rows - batch + 1, batch):
            step += 1
            ways, tags = _both_ways(x[order[at : at + batch]]), y[order[at : at + batch]]
            hidden, kept = _lstm(ways, w["x"], w["h"], keep=True)
            both = np.concatenate([hidden[0], hidden[1][:, ::-1]], axis=2)
            d_emit, d_move = _crf_gradient(both @ w["out"] + w["bias"], w["move"], tags)
            up = d_emit @ w["out"].T
            grads = {"move": d_move, "bias": d_emit.sum(axis=(0, 1)), "out": both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)}
            up = np.stack([up[:, :, :HIDDEN], up[:, ::-1, HIDDEN:]])
            grads["x"], grads["h"] = _lstm_gradient(ways, w["h"], hidden, kept, up)
            norm = np.sqrt(sum(np.square(g).sum() for g in grads.values()))
            pace = rate * min(1.0, 1.6 * (1 - step / (steps + 1))) * min(1.0, step / 40)
            for key, g in grads.items():
                g = g * min(1.0, 10.0 / (norm + 1e-9))
                first[key] = 0.9 * first[key] + 0.1 * g
                second[key] = 0.98 * second[key] + 0.02 * np.square(g)
                w[key] -= (pace * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return Tagger(w)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train().weights)
