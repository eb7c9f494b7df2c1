"""Fidelity of exported vectors against brute force: groups beyond one block, large and tiny ones, ties."""

import math

import numpy as np
import pytest
from conftest import rows

from locusmith.operators import retrieval

SCHEMA = "label string, id long, reference array<double>, exported array<double>"


def brute(members, k):
    members = sorted(members)
    a, b = (np.array([m[side] for m in members]) for side in (1, 2))
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b)]
    cosines = (unit[0] * unit[1]).sum(1)
    scores = [np.round(u @ u.T, 12) for u in unit]
    same, margins = [], []
    for i in range(len(members)):
        others = np.delete(np.arange(len(members)), i)
        near = [others[np.lexsort((others, -s[i][others]))] for s in scores]
        same.append(near[0][:k].tolist() == near[1][:k].tolist())
        falls = -np.diff(scores[0][i][near[0]])[:k]
        margins += [falls.min()] if len(falls) else []
    below = sum(m < 1 - cosines.mean() for m in margins)
    return (len(members), cosines.mean(), cosines.min(), 1 - cosines.mean(), np.mean(same), np.mean(margins) if margins else None, below)


@pytest.mark.parametrize("block", [7, 2048])
def test_groups_of_all_sizes(spark, block):
    rng = np.random.default_rng(3)
    data = []
    for label, n in (("a", 60), ("b", 3), ("c", 2), ("d", 1), (None, 12)):
        for i in range(n):
            v = data[-3][2] if i % 10 == 9 else rng.normal(size=4).tolist()  # ties
            data.append((label, 1000 - len(data), v, np.round(v, 1).tolist()))
    got = {r[0]: tuple(r)[1:] for r in retrieval.fidelity(spark.createDataFrame(data, SCHEMA), 3, "label", block).collect()}
    want = {g: brute([x[1:] for x in data if x[0] == g], 3) for g in ("a", "b", "c", None)}
    assert got.keys() == want.keys()
    for g, figures in want.items():
        assert all(x == y or math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[g], figures, strict=True)), (g, got[g], figures)
    assert rows(retrieval.fidelity(spark.createDataFrame([], SCHEMA), 3, "label", block)) == []


def test_a_group_of_many_probes(spark):
    rng = np.random.default_rng(4)
    data = [("big", i, v.tolist(), np.round(v, 1).tolist()) for i, v in enumerate(rng.normal(size=(4200, 3)))]
    got = tuple(retrieval.fidelity(spark.createDataFrame(data, SCHEMA), 3, "label").first())[1:]
    assert np.allclose(got, brute([x[1:] for x in data], 3), atol=1e-9)
