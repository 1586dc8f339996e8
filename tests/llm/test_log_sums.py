"""Log-sums of scores within and beyond the range of floats, and probabilities by matrix products, against plain sums."""

from __future__ import annotations

import numpy as np
import pytest

from weekloom.llm import neurallm


def test_log_sums_of_any_scores():
    rows = [[0.5] * 9, [500] * 9, [-500] * 9, [-500] * 8 + [3], [70] + [0] * 8, [-90] * 9, [2, -1e30] + [1] * 7]
    want = [float(np.logaddexp.reduce(np.array(r, float))) for r in rows]
    assert neurallm._log_sum(np.array(rows, np.float32)) == pytest.approx(want, rel=1e-6)
    for r, x in zip(rows, want, strict=True):  # a row's sum doesn't follow the rows beside it
        assert neurallm._log_sum(np.array([r], np.float32)) == pytest.approx([x], rel=1e-6)


@pytest.mark.parametrize("scale", [0.3, 12.0])
def test_log_probabilities_equal_plain_sums(scale):
    draw = np.random.default_rng(3)
    n, size = 37, 8
    unit, context, places = (np.c_[draw.normal(0, scale, (k, size)), draw.normal(0, 1, k)].astype(np.float32) for k in (n, n + 1, neurallm.PLACES * size))
    share = np.full(n, 1 / n)
    class_of, members, group = neurallm._classes(unit, share)
    model = neurallm.LogBilinear(context, unit, group, places, class_of, members)
    before, units = draw.integers(0, n + 1, (3000, neurallm.PLACES)), draw.integers(0, n, 3000)
    guess = context.astype(float)[before][..., :-1].reshape(len(units), -1) @ places.astype(float)[:, :-1]
    kinds = guess @ group.astype(float)[:, :-1].T + group[:, -1]
    inner = guess @ unit.astype(float)[:, :-1].T + unit[:, -1]
    want = kinds[np.arange(3000), class_of[units]] - np.logaddexp.reduce(kinds, axis=1)
    want += [x[u] - np.logaddexp.reduce(x[class_of == class_of[u]]) for x, u in zip(inner, units, strict=True)]
    assert model.log_probabilities(before, units, block=1500) == pytest.approx(want / np.log(10), rel=1e-4, abs=scale * 2e-3)
