from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from binlens.llm.decontaminate import find_leaks, without_leaks
from binlens.llm.mixing import mix, pivotal, source_targets, take_copies
from binlens.llm.simhash import keep_one_of_each, simhash_components
from binlens.session import materialise

D = "/root/testdata/sf0.01"


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, full = share * sum(sizes.values()), set()
    while True:
        left, weight = want - sum(most * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        level = left / weight if weight else 0
        more = {s for s in order if s not in full and level * w[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


def check_mix(rows, out):
    sizes, size_of = defaultdict(int), Counter()
    for i, text, source in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        size_of[(i, n)] += 1
    assert Counter((r.id, r["size"]) for r in out) == size_of
    targets = slow_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.copies <= 2
        taken[round(r.target, 3), r.source_size] += r.copies * r["size"]
    assert {k[1] for k in taken} == set(sizes.values())
    for s, t in targets.items():
        longest = max((n for (_, n) in size_of), default=0)
        assert abs(taken[round(t, 3), sizes[s]] - t) <= longest * sum(v == sizes[s] for v in sizes.values())


def test_mix_of_odd_rows(odd, odd_rows, empty):
    out = mix(odd, rows_per_group=4).collect()
    check_mix([(r[0], r[1], r[3]) for r in odd_rows], out)
    again = mix(odd.repartition(3), rows_per_group=4).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mix(empty).count() == 0


def test_mix_query(spark):
    from binlens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    out = QUERIES["op7_mixing"](spark, D).toPandas()
    source = {r.doc_id: r.source for r in docs}
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    targets = slow_targets(sizes)
    out["source"] = out["doc_id"].map(source)
    for s, g in out.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(targets[s]) and g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - targets[s]) <= g["size"].max()
    assert (out["taken"] <= 2 * out["size"]).all()


def test_pivotal_keeps_mass_and_has_no_bias():
    rng = np.random.default_rng(2)
    p, size = rng.uniform(0.05, 0.95, 30), rng.integers(1, 500, 30).astype(float)
    total = np.zeros(30)
    for _ in range(4000):
        out = pivotal(p, size, rng.uniform(size=30))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert sum(x not in (0.0, 1.0) for x in out) <= 1
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_targets_cap_and_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 30, "": 0, "é": 70, "z": 69}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: r.target for r in source_targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_copies_are_rows(odd):
    mixed = mix(odd)
    out = take_copies(odd, mixed)
    assert out.columns == odd.columns
    want = Counter()
    for r in mixed.collect():
        want[r.id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


# Decontamination

ITEM = "A train leaves Boston at 9:30 and travels 120 km toward Albany while Mary waits for it there with her 2 dogs"
CLEAN = "the quick brown fox jumps over a lazy dog near the river bank while many birds sing in the trees at dawn"


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.id, r.item_id): r for r in find_leaks(d, b, **more).collect()}


def test_leaks_word_for_word_and_with_other_values(spark):
    other = ITEM.replace("Boston", "Denver").replace("120", "95").replace("Mary", "Susan").replace("9:30", "7:15")
    got = leaks(spark, [(1, f"Before it. {ITEM}. After it."), (2, f"{CLEAN} {other} {CLEAN}"), (3, CLEAN), (4, None), (5, ""), (None, ITEM), (None, CLEAN)], [(7, ITEM), (8, None), (None, CLEAN), (9, "")])
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7].n_changed == 0 and got[2, 7].n_changed == 4 and got[2, 7].n_slots >= 6


def test_inconsistent_slots_are_no_leak(spark):
    item = "so said Anna to the old man and then Anna went home to see if Anna was right about it all"
    same = item.replace("Anna", "Berta")
    torn = item.replace("Anna", "Berta", 1).replace("Anna", "Clara")
    assert set(leaks(spark, [(1, same), (2, torn)], [(1, item)])) == {(1, 1)}


def test_placeholders_alone_are_no_leak(spark):
    item = "results 1 2 3 4 5 6 7 8 9 10 11 12"
    assert set(leaks(spark, [(1, "other 4 5 6 7 9 9 1 2 3 0 8 7"), (2, f"x {item} y")], [(1, item)])) == {(2, 1)}


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_short_items_repeats_and_both_joins(spark, rows):
    got = leaks(spark, [(1, "see the small blue bird now"), (1, "see the small blue bird now"), (1, CLEAN), (2, CLEAN)], [(1, "small blue bird now"), (2, "blue bird"), (3, CLEAN), (3, CLEAN)], broadcast_rows=rows)
    assert set(got) == {(1, 1), (1, 3), (2, 3)}


def test_leaks_of_odd_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(1, odd_rows[20][1]), (2, "The same short text. And a second line of it.")], "item_id long, text string")
    found = find_leaks(odd, bench)
    left = without_leaks(odd, found)
    assert left.columns == odd.columns
    gone = Counter(r[0] for r in odd_rows) - Counter(r.doc_id for r in left.collect())
    assert {200 + i for i in range(25)} <= set(gone) and None not in gone and 7 not in gone
    assert find_leaks(empty, bench).count() == 0 and find_leaks(odd, bench.limit(0)).count() == 0


# Pipeline

def test_pipeline_against_brute_force(spark):
    """Each stage by its own input, and the whole."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = materialise(stages["quality classifier"](spark, docs, D), "t")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert np.mean([(i in ids) == bool(q) for i, q in label.items()]) > 0.95
    near = materialise(stages["simhash near-dedup"](spark, good, D), "t")
    comps = simhash_components(good).collect()
    assert Counter(r.doc_id for r in near.collect()) == Counter({r.component_id for r in comps})
    assert keep_one_of_each(near, simhash_components(near)).count() == near.count()
    clean = materialise(stages["benchmark decontamination"](spark, near, D), "t")
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in near.collect() if any(i in " ".join(r.text.split()) for i in items)}
    assert whole and Counter(r.doc_id for r in near.collect()) - Counter(r.doc_id for r in clean.collect()) == Counter(whole)
    mixed = materialise(stages["mixing to target weights"](spark, clean, D), "t")
    assert mixed.columns == docs.columns
    check_mix([(r.doc_id, r.text, r.source) for r in clean.collect()], mix(clean).collect())
    out = stages["token files"](spark, mixed, D).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(r.doc_id for r in out)
