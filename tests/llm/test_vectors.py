from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadframe.llm import nearest, neardup_vectors
from spreadframe.llm.queries import QUERIES


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, unit string, n_links int")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    out = []
    for i in range(400):
        v = centres[i % 6] + rng.standard_normal(16) * (0.12 if i % 3 else 0.9)
        out.append((i, [float(x) for x in v.astype(np.float32)]))
    out += [(1000 + i, out[3][1]) for i in range(40)] + [(2000, [2 * x for x in out[5][1]])]
    out += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 15 + [None]), (3005, []), (3006, [float("inf")] + [0.0] * 15)]
    # another length, with equal, near and far vectors; and finite vectors whose squares vanish or overflow
    out += [(4000, [1.0] * 7), (4001, [2.0] * 7), (4002, [1.0] * 6 + [1.3]), (4003, [1.0] + [-1.0] * 6), (4004, [3.0])]
    out += [(5000, [1e-200] + [0.0] * 15), (5001, [3e-200] * 2 + [0.0] * 14), (5002, [1e200] * 15 + [9e199]), (5003, [1e200] * 16), (5004, [1.7e308] * 16), (5005, [5e-324] * 16)]
    return out + [(None, out[9][1]), (11, out[11][1])]


def valid(rows, width=16):
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and len(v) == width and None not in v and np.isfinite(v).all() and any(v)]


def unit(x):
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vector_groups_equal_brute_force(spark, rows):
    want = [(i, 0, i, True) for i, v in rows if i is not None and 3000 <= i < 4000]
    for size in (1, 7, 16):
        good = valid(rows, size)
        u = unit(np.stack([v for _, v in good]))
        near = u @ u.T >= 0.95 - 1e-12
        links, label = near.sum(1) - 1, np.arange(len(u))
        while True:
            new = np.array([label[near[i]].min() for i in range(len(u))])
            if (new == label).all():
                break
            label = new
        name = {k: min((i for (i, _), m in zip(good, label) if m == k and i is not None), default=None) for k in set(label.tolist())}
        want += [(i, int(n), name[k], i == name[k]) for (i, _), n, k in zip(good, links, label.tolist())]
    for grid, block in ((neardup_vectors.GRID, neardup_vectors.BLOCK), (3, 64), (1, 128)):
        got = neardup_vectors.vector_groups(table(spark, rows), grid=grid, block=block).collect()
        assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert neardup_vectors.vector_groups(table(spark, [])).count() == 0
    assert neardup_vectors.vector_groups(table(spark, [(1, None)])).collect()[0]["kept"]


def test_parts_of_a_block_give_the_links_of_the_whole(spark, rows, monkeypatch):
    want = sorted(map(str, neardup_vectors.vector_groups(table(spark, rows)).collect()))
    monkeypatch.setattr(neardup_vectors, "PART", 50)
    assert sorted(map(str, neardup_vectors.vector_groups(table(spark, rows)).collect())) == want


def product(x, v):
    """Inner products, by exact fractions where doubles overflow."""
    with np.errstate(all="ignore"):
        out = (x * v).sum(1)
    for r in np.flatnonzero(~np.isfinite(out)):
        exact = sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(x[r], v))
        out[r] = float(exact) if abs(exact) < Fraction(1e308) else np.inf if exact > 0 else -np.inf
    return out


def test_nearest_recall_and_exact_scores(spark, rows):
    df = table(spark, rows)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, k=20, rows=128, queries=7).collect()
    hit = total = 0
    for size in (7, 16):
        good = [(i, v) for i, v in valid(rows, size) if i is not None]
        ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
        for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            score = product(x, x[list(ids).index(q)])
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
            assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
            exact = [score[list(ids).index(r["vec_id"])] for r in mine]
            assert all(r["score"] == s or abs(r["score"] - s) < 1e-9 * max(1.0, abs(s)) for r, s in zip(mine, exact))
            assert all((a["score"], -a["vec_id"]) >= (b["score"], -b["vec_id"]) for a, b in zip(mine, mine[1:]))
            hit += sum(r["score"] >= score[order[-1]] * (1 - 1e-9) - 1e-300 for r in mine)
            total += len(order)
    assert {5000, 4000, 400 - 20} <= {r["query_id"] for r in got}
    assert hit / total >= 0.9
    few = nearest.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.1])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert nearest.nearest(table(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_and_share_of_candidates_on_the_supplied_vectors(spark, scale):
    path = f"/root/testdata/{scale}"
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = vectors["vec_id"].to_numpy(), np.stack(vectors["embedding"]).astype(float)
    got = QUERIES["op1_nearest"](spark, path).toPandas()
    hit = 0
    for q, mine in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += (mine["score"] >= np.sort(score)[-20] - 1e-12).sum()
    assert len(got) == 20 * (ids % 20 == 0).sum() and hit / len(got) >= 0.9
    index = nearest.Index(unit(x), 3)
    found = index.candidates(unit(x[ids % 20 == 0]), 21)
    assert sum(map(len, found)) / len(found) <= max(0.06 * len(x), 2 * (21 + nearest.SPARE))
