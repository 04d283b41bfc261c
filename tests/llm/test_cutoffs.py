import math
import random
from datetime import datetime, timedelta

import pytest

from weftline.llm import cutoffs

CANDIDATES = "cand_id long, detector string, tag string, score double, written_at timestamp, other string"
TARGETS = "detector string, tag string, keep_permille int"
T0 = datetime(2025, 1, 1)


def brute(rows, targets):
    clean = lambda x: None if x is None else x.strip(" []\t\n").lower()
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[4] or datetime.min) >= (last[r[0]][4] or datetime.min)):
            last[r[0]] = r
    goal = {}
    for d, t, k in targets:
        if None not in (d, t, k):
            goal[clean(d), clean(t)] = max(k, goal.get((clean(d), clean(t)), 0))
    kept = set()
    for (d, t), k in goal.items():
        hits = [(r[3], r[0]) for r in last.values() if clean(r[1]) == d and clean(r[2]) == t and r[3] is not None and not math.isnan(r[3]) and 0 <= r[3] <= 1]
        cut = max((s for s, _ in hits if sum(x >= s for x, _ in hits) * 1000 >= k * len(hits)), default=None)
        kept |= {c for s, c in hits if cut is not None and s >= cut}
    return sorted(kept)


def run(spark, rows, targets):
    return sorted(r[0] for r in cutoffs.kept_hits(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(targets, TARGETS)).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        score = rng.choice([round(rng.random(), 2), rng.random(), 1.0, 0.0, None, float("nan"), -0.5, 1.5, 0.5 + i * 1e-9])
        rows.append((rng.randrange(1200), rng.choice(["a", " A", "[a]", "b", None]), rng.choice(["x", "[X]", " x ", "y", None]), score, T0 + timedelta(seconds=i), "z"))
    targets = [("a", "x", 333), ("A", "y", 1000), ("b", "[x]", 1), ("b", "y", 0), ("c", "x", 500), (None, "x", 500), ("a", None, 1), ("b", "x", None)]
    assert run(spark, rows, targets) == brute(rows, targets)


def test_ties_single_hits_and_close_scores(spark):
    rows = [(i, "a", "x", 0.5, T0, "") for i in range(10)] + [(20, "b", "x", 0.25, None, ""), (21, "c", "x", 0.25, T0, ""), (22, "c", "x", 0.25 + 1e-12, T0, "")]
    targets = [("a", "x", 100), ("b", "x", 1), ("c", "x", 500)]
    assert run(spark, rows, targets) == [*range(10), 20, 22]


def test_empty_tables(spark):
    assert run(spark, [], [("a", "x", 5)]) == []
    assert run(spark, [(1, "a", "x", 0.5, T0, "")], []) == []


def test_tree_of_batches_is_the_tree_of_all_and_rows_can_be_taken_back(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), "x", rng.random(), 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "detector string, tag string, score double, w int")
    keys = ["detector", "tag"]
    first, second = spark.createDataFrame(rows[:150], df.schema), spark.createDataFrame(rows[150:], df.schema)
    key = lambda t: sorted(map(tuple, t.select(*keys, "level", "node", "n").collect()))
    whole = key(cutoffs.count_tree(df, keys))
    both = cutoffs.add_batch(cutoffs.count_tree(first, keys), cutoffs.count_tree(second, keys), keys)
    assert key(both) == whole
    back = spark.createDataFrame([(*r[:3], -1) for r in rows[:150]], df.schema)
    assert key(cutoffs.add_batch(both, cutoffs.count_tree(back, keys, weight="w"), keys)) == key(cutoffs.count_tree(second, keys))
    assert max(r[2] for r in whole) == cutoffs.BITS and sum(r[4] for r in whole if r[2] == 0) == 400


def test_report(spark):
    rows = [(i, "a", "x", i / 10, T0, "") for i in range(10)]
    _, report = cutoffs.cutoffs(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([("a", "x", 300)], TARGETS))
    assert [tuple(r) for r in report.collect()] == [("a", "x", 300, 10, 0.7, 3)]


def test_stored_tree_survives_a_batch_written_twice(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), "x", rng.random()) for _ in range(300)]
    schema, keys = "detector string, tag string, score double", ["detector", "tag"]
    store = cutoffs.TreeStore(spark, str(tmp_path / "tree"), keys)
    for batch, part in ((0, rows[:100]), (1, rows[100:]), (1, rows[100:])):
        store.add(batch, spark.createDataFrame(part, schema))
    df = spark.createDataFrame(rows, schema)
    key = lambda t: sorted(map(tuple, t.select(*keys, "level", "node", "n").collect()))
    assert key(store.tree()) == key(cutoffs.count_tree(df, keys))
    goal = spark.createDataFrame([("a", "x", 250), ("b", "x", 500)], "detector string, tag string, keep_permille int")
    cut = {r.detector: r.cutoff for r in cutoffs.refine(df, cutoffs.descend(store.tree(), goal, keys), keys).collect()}
    for d, k in (("a", 250), ("b", 500)):
        mine = sorted((s for x, _, s in rows if x == d), reverse=True)
        assert cut[d] == mine[max(1, -(-k * len(mine) // 1000)) - 1]


def test_kept_tree_of_batches_with_rewritten_and_repeated_rows(spark, tmp_path):
    """Three batches, of which the second rewrites rows of the first, brings a late row and runs twice."""
    rng = random.Random(8)
    row = lambda c, day: (c, rng.choice(["a", "b"]), "x", rng.choice([round(rng.random(), 2), rng.random()]), T0 + timedelta(days=day), "")
    batches = [[row(i, 1) for i in range(200)], [*[row(i, 2) for i in range(100, 250)], row(5, 0)], [row(i, 3) for i in range(240, 300)]]
    batches[1] += batches[1][:20]
    store = cutoffs.TreeStore(spark, str(tmp_path / "tree"))
    known = spark.createDataFrame([], CANDIDATES)
    for number, rows in ((0, batches[0]), (1, batches[1]), (1, batches[1]), (2, batches[2])):
        so_far = [r for n in range(number) for r in batches[n]]
        last = {}
        for r in so_far:
            if r[0] not in last or r[4] >= last[r[0]][4]:
                last[r[0]] = r
        known = spark.createDataFrame(list(last.values()), CANDIDATES)
        store.add(number, cutoffs.changes(known, spark.createDataFrame(rows, CANDIDATES)), weight="w")
    rows = [r for b in batches for r in b]
    targets = [("a", "x", 300), ("b", "x", 500)]
    df, goal = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(targets, TARGETS)
    assert sorted(r[0] for r in cutoffs.kept_hits(df, goal, store.tree()).collect()) == brute(rows, targets)
    with_tree, without = cutoffs.cutoffs(df, goal, store.tree())[1], cutoffs.cutoffs(df, goal)[1]
    assert sorted(map(tuple, with_tree.collect())) == sorted(map(tuple, without.collect())) != []


def test_tree_of_other_hits_is_an_error(spark, tmp_path):
    store = cutoffs.TreeStore(spark, str(tmp_path / "tree"))
    store.add(0, spark.createDataFrame([("a", "x", 0.5)] * 3, "detector string, tag string, score double"))
    with pytest.raises(ValueError):
        cutoffs.kept_hits(spark.createDataFrame([(1, "a", "x", 0.5, T0, "")], CANDIDATES), spark.createDataFrame([("a", "x", 500)], TARGETS), store.tree())


def test_a_leaf_of_many_scores_is_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(cutoffs, "LEAF_SCORES", 3)
    close = [(i, "a", "x", 0.3 + i * 2**-45, T0, "") for i in range(60)] + [(100 + i, "b", "x", 1.0 - i * 2**-53, T0, "") for i in range(40)]
    tiny = [(200 + i, "c", "x", (i % 9 + 1) * 5e-324, T0, "") for i in range(30)] + [(300 + i, "d", "x", 1.0, T0, "") for i in range(9)]
    targets = [(d, "x", k) for d, k in zip("abcd", (333, 500, 700, 100))]
    assert run(spark, close + tiny, targets) == brute(close + tiny, targets)


def test_rows_are_taken_back_across_months(spark):
    rows = [(i % 30, "a", "x", (i * 37 % 101) / 100, T0 + timedelta(days=9 * i) if i % 7 else None, "") for i in range(90)] + [(3, "a", "x", None, T0 + timedelta(days=9999), "")]
    assert run(spark, rows, [("a", "x", 400)]) == brute(rows, [("a", "x", 400)])
