"""The tagger's loops: one pass for what is held at once, and the results of the plain recurrences."""

from __future__ import annotations

import random
import warnings

import numpy as np

from strandmill.llm import pii, tagger


def _plain(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Emissions without bias from the states that training uses."""
    hidden, _ = tagger._lstm(tagger._both_ways(x), w["x"], w["h"], keep=False)
    return np.concatenate([hidden[0], hidden[1][:, ::-1]], axis=2) @ w["out"]


def _viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    best, back = emit[0], []
    for own in emit[1:]:
        sums = best[:, None] + move
        back.append(sums.argmax(axis=0))
        best = sums.max(axis=0) + own
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def test_texts_held_at_once_pass_the_network_and_the_decoder_once(monkeypatch):
    model, rng = tagger.trained(), random.Random(3)
    texts = [" ".join(tagger.labelled_window(rng)[0] for _ in range(n)) for n in (1, 3, 9, 30, 120, 240)] * 12
    some = [text for text, held in zip(texts, np.cumsum([len(text) for text in texts]), strict=True) if held <= pii.HELD]
    assert sum(map(len, some)) > 0.8 * pii.HELD
    plain = [pii.network_spans(model, [t])[0] for t in some[:6]]
    steps, emissions, decoded = [], tagger._emissions, []
    monkeypatch.setattr(tagger, "_emissions", lambda x, *rest: steps.append(x.shape[1]) or emissions(x, *rest))
    paths = tagger.Tagger.paths
    monkeypatch.setattr(tagger.Tagger, "paths", lambda self, emits: decoded.append(len(emits)) or paths(self, emits))
    assert pii.network_spans(model, some)[:6] == plain
    assert steps == [pii.WINDOW] and len(decoded) == 1 and decoded[0] > 20


def test_paths_of_any_lengths_are_the_best():
    model, rng = tagger.trained(), np.random.default_rng(11)
    emits = [rng.normal(0, 12, (n, tagger.TAGS)).astype(np.float32) for n in (1, 40, 7, 7, 2, 300, 1, 64)]
    before = [emit.copy() for emit in emits]
    got = model.paths(emits)
    assert [path.tolist() for path in got] == [_viterbi(emit, model.weights["move"]) for emit in emits]
    assert all((a == b).all() for a, b in zip(emits, before, strict=True))
    assert (model.decode(np.stack(emits[2:4])) == np.stack(got[2:4])).all()


def test_emissions_are_those_of_the_training_states_also_where_exp_overflows():
    w, rng = tagger.trained().weights, np.random.default_rng(12)
    x = rng.integers(0, tagger.CLASSES, (6, 50))
    steep = {key: value * np.float32(40 if key in "xh" else 1) for key, value in w.items()}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for weights in (w, steep):
            got = tagger._emissions(x, np.full(6, 50), weights["x"], weights["h"], weights["out"])
            assert np.isfinite(got).all() and np.abs(got - _plain(x, weights)).max() < 1e-2
