import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import splits

SCHEMA = "sample_id string, video_id string, extra int"
TARGETS = "split_name string, permille int"


def components(rows):
    """Union-find over the definition."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    import re

    present = set()
    for s, v, *_ in rows:
        nodes = []
        if v is not None and v.strip(" "):
            nodes.append(("v", v))
            present.add(v)
        if s is not None and s.strip(" "):
            nodes.append(("s", s))
            m = re.fullmatch(r"(.+)_SPEAKER_\d+_\d+", s)
            if m and m[1].strip(" "):
                nodes.append(("v", m[1]))
        for n in nodes:
            parent[find(n)] = find(nodes[0])
    return {v: find(("v", v)) for v in present}


def pairs(rows):
    of = components(rows)
    return sorted((a, b) for a in of for b in of if a < b and of[a] == of[b])


def found(spark, rows):
    return sorted(tuple(r) for r in splits.related_pairs(spark.createDataFrame(rows, SCHEMA)).collect())


def test_pairs_match_union_find_on_random_graphs(spark):
    rng = random.Random(5)
    for n, videos in ((60, 40), (200, 60)):
        rows = []
        for _ in range(n):
            v = rng.choice([None, "", "  ", *[f"v{rng.randrange(videos)}"] * 9])
            s = rng.choice([None, f"clip-{rng.randrange(n)}", f"v{rng.randrange(videos)}_SPEAKER_0{rng.randrange(3)}_00{rng.randrange(10, 99)}", f"{v or 'x'}_SPEAKER_01_0001"])
            rows.append((s, v, rng.randrange(3)))
        assert found(spark, rows) == pairs(rows)


def test_long_chain_and_hot_sample(spark):
    chain = [(f"clip-{i}", f"v{j:03d}", 0) for i in range(60) for j in (i, i + 1)]
    assert len(found(spark, chain)) == 61 * 60 // 2
    hot = [("clip-1", f"w{i:03d}", 0) for i in range(50)] + [(None, f"u{i}", 0) for i in range(9)]
    assert len(found(spark, hot)) == 50 * 49 // 2


def test_ids_compare_exactly_and_blank_ids_relate_nothing(spark):
    rows = [("clip-1", "a", 0), ("clip-1", "A", 0), ("clip-2", "", 0), ("clip-2", "b", 0), ("clip-3", None, 0), ("clip-3", "c", 0), ("clip-9", "", 0), ("", "d", 0), ("", "e", 0)]
    assert found(spark, rows) == [("A", "a")]


def test_recording_inside_a_clip_id_links(spark):
    rows = [("r1_SPEAKER_00_0001", "x", 0), ("r1_SPEAKER_02_0009", "y", 0), ("r2_SPEAKER_00_0001", "r2", 0)]
    assert found(spark, rows) == [("x", "y")]


def test_empty_table(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([], SCHEMA)
    assert splits.assign_splits(df, spark.createDataFrame([("train", 1000)], TARGETS)).count() == 0


@pytest.fixture(scope="module")
def many():
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        v = "hot" if i % 3 == 0 else f"v{rng.randrange(300):03d}"
        rows.append((f"{v}_SPEAKER_00_{i:04d}" if rng.random() < 0.97 else f"v{rng.randrange(300):03d}_SPEAKER_00_{i:04d}", v if rng.random() < 0.98 else rng.choice([None, ""]), i))
    return rows


def test_related_rows_stay_together_and_shares_are_near(spark, many):
    targets = spark.createDataFrame([("train", 500), ("validation", 250), ("test", 250)], TARGETS)
    out = splits.assign_splits(spark.createDataFrame(many, SCHEMA), targets).collect()
    assert sorted((r.sample_id, r.video_id, r.extra) for r in out) == sorted((*x,) for x in many) if all(x[1] is not None for x in many) else len(out) == len(many)
    split_of = {}
    for r in out:
        assert split_of.setdefault(r.split_unit, r.assigned_split) == r.assigned_split
    of = components(many)
    by_component = {}
    for r in out:
        if r.video_id and r.video_id.strip():
            assert by_component.setdefault(of[r.video_id], r.assigned_split) == r.assigned_split
    n = {s: sum(r.assigned_split == s for r in out) / len(out) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.5) < 0.05 and abs(n["validation"] - 0.25) < 0.05


def test_clashing_and_repeated_rows(spark):
    df = spark.createDataFrame([("clip-1", "a", 1), ("clip-1", "a", 1), (None, None, 2), (None, None, 2)], SCHEMA).withColumn("assigned_split", F.lit("old")).withColumn("_v", F.lit(3)).withColumn("_n", F.lit(4))
    out = splits.assign_splits(df, spark.createDataFrame([("train", 1000), (None, 5), ("zero", 0)], TARGETS))
    assert out.count() == 4 and {r.assigned_split for r in out.collect()} == {"train"}
    assert out.columns.count("assigned_split") == 1 and {(r["_v"], r["_n"]) for r in out.collect()} == {(3, 4)}


def test_no_targets_give_null(spark):
    out = splits.assign_splits(spark.createDataFrame([("clip-1", "a", 1)], SCHEMA), spark.createDataFrame([], TARGETS))
    assert [r.assigned_split for r in out.collect()] == [None]


def test_rendezvous_moves_few_when_a_split_is_added(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    a = splits.rendezvous(F.col("k"), {"x": 1.0, "y": 1.0})
    b = splits.rendezvous(F.col("k"), {"x": 1.0, "y": 1.0, "z": 2.0})
    rows = keys.select(a.alias("a"), b.alias("b")).collect()
    assert all(r.a == r.b or r.b == "z" for r in rows)
    assert abs(sum(r.b == "z" for r in rows) / 4000 - 0.5) < 0.04


def test_one_more_row_moves_no_other_component(spark, many):
    targets = spark.createDataFrame([("train", 900), ("validation", 50), ("test", 50)], TARGETS)
    before = splits.assign_splits(spark.createDataFrame(many, SCHEMA), targets, fitted=(5, {"train": 0.8, "validation": 0.1, "test": 0.1})).collect()
    after = splits.assign_splits(spark.createDataFrame([*many, *[("new-1", "brand new", i) for i in range(500)]], SCHEMA), targets, fitted=(5, {"train": 0.8, "validation": 0.1, "test": 0.1})).collect()
    of = {r.split_unit: r.assigned_split for r in before}
    now = {r.split_unit: r.assigned_split for r in after}
    assert set(now) - set(of) == {"brand new"} and all(now[u] == s for u, s in of.items())


def test_weights_are_fitted_around_a_large_component(spark):
    rng = random.Random(2)
    units = spark.createDataFrame([(f"u{i}", rng.choice([1, 2, 3])) for i in range(900)] + [("big", 800)], "u string, n long")
    shares = {"a": 500, "b": 250, "c": 250}
    salt, weights = splits.fit_weights(units, "u", "n", shares)
    rows = {r.s: r.n for r in units.groupBy(splits.rendezvous(F.col("u"), weights, salt).alias("s")).agg(F.sum("n").alias("n")).collect()}
    total = sum(rows.values())
    assert sum(abs(rows.get(k, 0) - total * w / 1000) for k, w in shares.items()) < 0.04 * total
    assert splits.fit_weights(units.limit(0), "u", "n", shares)[0] == 0


def test_pairs_of_a_component_in_parts(spark, monkeypatch):
    monkeypatch.setattr(splits, "PAIR_ROWS", 7)
    rows = [("clip-1", f"w{i:03d}", 0) for i in range(40)] + [("clip-2", "x", 0), ("clip-2", "y", 0), ("z_SPEAKER_00_0001", "only", 0)]
    assert found(spark, rows) == pairs(rows)
    members = {r.video_id: r.n_members for r in splits.related_members(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert members == {**{f"w{i:03d}": 40 for i in range(40)}, "x": 2, "y": 2}


def test_too_many_splits(spark):
    with pytest.raises(ValueError):
        splits.assign_splits(spark.createDataFrame([("clip-1", "a", 1)], SCHEMA), spark.createDataFrame([(f"s{i}", 1) for i in range(splits.MAX_SPLITS + 1)], TARGETS))
