import numpy as np
import pytest

from leaguelens.llm import nn_descent


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, label[None, :], len(x)).min(1)
        if np.array_equal(low, label):
            break
        label = low
    return [(i, int(near[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(x))]


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def clumps(rng, groups=20, size=30, dim=64):
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        away = rng.standard_normal(dim)
        away -= away @ base * base
        away /= np.linalg.norm(away)
        for angle in (0.0, np.arccos(0.92)):
            centre = np.cos(angle) * base + np.sin(angle) * away
            out.append(centre + 0.018 * rng.standard_normal((size, dim)))
    return np.concatenate(out)


@pytest.mark.parametrize("starts", [0, 3])
def test_clumps_with_links_across(spark, starts):
    x = clumps(np.random.default_rng(0))
    assert sorted(map(tuple, nn_descent.near_groups(rows(spark, x), starts=starts).collect())) == brute(x)


def test_audit_sees_missed_pairs(spark):
    x = np.random.default_rng(1).standard_normal((400, 64))
    x[200:240] = x[:40] + 0.2 * np.random.default_rng(2).standard_normal((40, 64))
    nodes = rows(spark, x).selectExpr("vec_id as id", "1L as m", "embedding as v")
    found = spark.createDataFrame([(i, 2) for i in [*range(20), *range(200, 220)]], "id long, n long")
    assert nn_descent._audit(nodes, found, 0.9, 4096) == pytest.approx(0.5)


def test_slices_leave_no_lists_behind(spark, monkeypatch):
    import os
    from urllib.parse import urlparse

    from leaguelens.llm.common import shared_dir

    folder = f"{urlparse(shared_dir(spark)).path}/leaguelens/{spark.sparkContext.applicationId}"
    passing = lambda: {f for f in os.listdir(folder) if f.startswith(("nn-lists", "nn-known", "nn-members"))}
    x = clumps(np.random.default_rng(5), groups=8)
    nn_descent.near_groups(rows(spark, x[:2])).count()
    monkeypatch.setattr(nn_descent, "SLICE", 150)
    before = passing()
    assert sorted(map(tuple, nn_descent.near_groups(rows(spark, x)).collect())) == brute(x)
    assert passing() == before
