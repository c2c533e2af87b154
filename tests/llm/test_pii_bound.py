"""The bound by which texts are passed over, on texts that begin with an item of borderline score."""

from types import SimpleNamespace

import numpy as np

from quern.llm import pii


def test_no_text_with_an_item_is_passed_over():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 5, 3000)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    texts = SimpleNamespace(row_tokens=ends, row=np.repeat(np.arange(len(lengths)), lengths))
    transitions = pii._transitions()
    transitions[0, 0] = 2.0  # above every way from O into an item
    transitions[1:, 0] += 1.5
    score = rng.normal(size=(ends[-1], pii.N)) * 0.3
    score[:, 1:] -= 0.6
    score[ends[:-1], 1] = score[ends[:-1], 0] + rng.uniform(-0.5, 2, len(lengths))
    may = pii.may_hold_items(texts, score, transitions)
    found = [pii.viterbi(score[None, a:b], np.array([b - a]), transitions)[0].any() for a, b in zip(ends, ends[1:])]
    assert any(found) and not may.all()
    assert not (np.array(found) & ~may).any()
