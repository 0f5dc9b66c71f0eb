"""The distributed grower against a plain one, flat trees against nodes, and what training leaves behind."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binlens.operators import boost as bo
from binlens.operators.evaluate import auc_of_counts, binned_auc, metric_auc


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = (rng.choice([None, *range(8)]), rng.randint(0, 5), rng.random())
        y = int((a or 3) + 2 * b + 4 * c + rng.gauss(0, 2) > 9)
        out.append((i, None if a is None else float(a), float(b), c, y, 1.0 + (i % 3)))
    return out


EDGES = [[0.0, 2.0, 4.0, 6.0], [0.0, 1.0, 2.0, 3.0, 4.0], [0.1, 0.3, 0.5, 0.7, 0.9]]
P = bo.BoostParams(n_rounds=3, max_depth=3, max_leaves=6, min_data_in_leaf=15, max_bins=16, feature_fraction=1.0, bagging_fraction=1.0, learning_rate=0.3,
                   monotone={"b": 1, "c": -1}, checkpoint_interval=2)


def plain_tree(rows, margin, p):
    """One tree grown with lists and loops over all rows, splits, directions of missing values and cuts."""
    g = [(1 / (1 + math.exp(-m)) - r[4]) * r[5] for r, m in zip(rows, margin)]
    h = [1 / (1 + math.exp(-m)) * (1 - 1 / (1 + math.exp(-m))) * r[5] for r, m in zip(rows, margin)]
    mono = [p.monotone.get(f, 0) for f in "abc"]

    def leaf(members, lo, hi):
        G, H = sum(g[i] for i in members), sum(h[i] for i in members)
        w = -math.copysign(max(abs(G) - p.lambda_l1, 0), G) / (H + p.lambda_l2)
        w = min(max(w, lo), hi)
        return w, -(G * w + 0.5 * (H + p.lambda_l2) * w * w + p.lambda_l1 * abs(w))

    nodes = {0: (list(range(len(rows))), -math.inf, math.inf)}
    leaves, level, next_id, splits = [0], [0], 1, {}
    for _ in range(p.max_depth):
        found = []
        for nid in level:
            members, lo, hi = nodes[nid]
            parent = leaf(members, lo, hi)[1]
            best = None
            for f in range(3):
                for miss_left in (False, True):
                    for cut in [*range(len(EDGES[f])), p.max_bins - 1]:
                        edge = EDGES[f][cut] if cut < len(EDGES[f]) else math.inf
                        left = [i for i in members if (miss_left if rows[i][1 + f] is None else rows[i][1 + f] <= edge)]
                        if cut >= len(EDGES[f]) and miss_left:
                            continue
                        inside = set(left)
                        right = [i for i in members if i not in inside]
                        if min(len(left), len(right)) < p.min_data_in_leaf:
                            continue
                        (wl, sl), (wr, sr) = leaf(left, lo, hi), leaf(right, lo, hi)
                        gain = sl + sr - parent
                        if gain > p.min_gain_to_split and mono[f] * (wr - wl) >= 0 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, edge, miss_left, left, right, wl, wr)
            if best:
                found.append((nid, best))
        level = []
        for nid, (gain, f, edge, miss_left, left, right, wl, wr) in sorted(found, key=lambda x: -x[1][0]):
            if len(leaves) >= p.max_leaves:
                break
            _, lo, hi = nodes[nid]
            mid = (wl + wr) / 2
            lb, rb = ((lo, mid), (mid, hi)) if mono[f] > 0 else ((mid, hi), (lo, mid)) if mono[f] < 0 else ((lo, hi), (lo, hi))
            splits[nid] = (f, gain, next_id, next_id + 1, len(left), len(right))
            nodes[next_id], nodes[next_id + 1] = (left, *lb), (right, *rb)
            leaves.remove(nid)
            leaves += [next_id, next_id + 1]
            level += [next_id, next_id + 1]
            next_id += 2
        level.sort()
    out = list(margin)
    for nid in leaves:
        members, lo, hi = nodes[nid]
        w = leaf(members, lo, hi)[0]
        for i in members:
            out[i] += w * p.learning_rate
    return splits, out


def test_trees_of_a_plain_grower(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int, w double").repartition(5)
    m = bo.boost_monotone(df, ["a", "b", "c"], "label", "id", weight="w", params=P, edges=EDGES)
    prior = sum(r[4] * r[5] for r in rows) / sum(r[5] for r in rows)
    margin = [math.log(prior / (1 - prior))] * len(rows)
    for tree in m.trees:
        splits, margin = plain_tree(rows, margin, P)
        got = {n["node"]: n for n in tree if n["feature"] >= 0}
        assert set(got) == set(splits)
        for nid, (f, gain, left, right, cl, cr) in splits.items():
            n = got[nid]
            assert (n["feature"], n["left"], n["right"]) == (f, left, right) and abs(n["gain"] - gain) < 1e-6
            assert [next(x for x in tree if x["node"] == c)["count"] for c in (left, right)] == [cl, cr]
    raw = {r.id: r.s for r in bo.score(df, m, "s", raw=True).collect()}
    assert all(abs(raw[r[0]] - x) < 1e-6 for r, x in zip(rows, margin))


def test_flat_trees_walk_like_nodes():
    rng = random.Random(3)

    def grow(depth, nodes):
        nid = len(nodes)
        nodes.append(None)
        if depth == 0 or rng.random() < 0.2:
            nodes[nid] = {"node": nid, "feature": -1, "bin": -1, "missing_left": False, "left": -1, "right": -1, "value": rng.random()}
        else:
            f, b, ml = rng.randrange(4), rng.randrange(9), rng.random() < 0.5
            left = grow(depth - 1, nodes)
            right = grow(depth - 1, nodes)
            nodes[nid] = {"node": nid, "feature": f, "bin": b, "missing_left": ml, "left": left, "right": right, "value": 0.0}
        return nid

    trees = []
    for _ in range(20):
        nodes = []
        grow(4, nodes)
        trees.append(nodes)
    bins = np.array([[rng.choice([*range(10), 15]) for _ in range(4)] for _ in range(200)], np.uint8)
    want = []
    for row in bins:
        total = 0.0
        for t in trees:
            n = t[0]
            while n["feature"] >= 0:
                b = row[n["feature"]]
                n = t[n["left"] if (n["missing_left"] if b == 15 else b <= n["bin"]) else n["right"]]
            total += n["value"]
        want.append(total)
    assert np.allclose(bo.FlatTrees(trees).margins(bins, 15), want)
    assert bo.FlatTrees([]).margins(bins, 15).tolist() == [0.0] * 200


def test_training_leaves_nothing_behind(spark):
    df = spark.createDataFrame(rows_of(300), "id int, a double, b double, c double, label int, w double")
    folder = spark.sparkContext.getCheckpointDir().replace("file:", "")
    before, cached = set(os.listdir(folder)), spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    m = bo.boost_monotone(df.where("id % 4 > 0"), ["a", "b", "c"], "label", "id", params=bo.BoostParams(**{**P.__dict__, "n_rounds": 5}), valid=df.where("id % 4 = 0"))
    assert set(os.listdir(folder)) == before
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= cached
    assert all(0 <= h["valid_auc"] <= 1 and h["valid_auc_error"] <= 0.5 for h in m.history)
    last = m.history[-1]
    assert abs(last["valid_auc_exact"] - last["valid_auc"]) <= last["valid_auc_error"] + 1e-12
    with pytest.raises(ValueError):
        bo.boost_monotone(df, ["a"], "label", "id", params=P, edges=[[0.0], [1.0]])


def test_auc_of_bins_is_within_its_bound(spark):
    df = spark.range(3000).select((F.rand(3) < 0.3).cast("int").alias("label"), F.rand(4).alias("noise")).select(
        "label", ((F.col("noise") + 0.4 * F.col("label")) / 1.4).alias("score")).cache()
    exact = metric_auc(df).first().auc
    for bins in (4, 64, 4096):
        auc, off = binned_auc(df, bins=bins)
        assert abs(auc - exact) <= off + 1e-12
    assert off < 1e-3 and math.isnan(auc_of_counts({1: (3, 0)})[0])
