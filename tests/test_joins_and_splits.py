import random

import pytest
from pyspark.sql import functions as F

from strainlens.operators import checks, joins, prefixes, splits


def test_prefix_lookup_matches_brute_force(spark):
    rng = random.Random(3)
    keys = [("".join(rng.choice("ab") for _ in range(rng.randint(3, 9))), rng.randint(0, 60)) for _ in range(120)]
    ids = list({"".join(rng.choice("ab") for _ in range(rng.randint(2, 11))) for _ in range(150)})
    got = {r.i: (r["index"], r.how) for r in joins.prefix_lookup(
        spark.createDataFrame([(i,) for i in ids], "i string"), spark.createDataFrame(keys, "k string, n int"), "i", "k", "n").collect()}
    for i in ids:
        exact = [n for k, n in keys if k == i]
        if exact:
            assert got[i] == (min(exact), "exact")
            continue
        hits = {n for k, n in keys if k.startswith(i) or i.startswith(k)}
        how = "missing" if not hits else "prefix" if len(hits) == 1 else "ambiguous"
        assert got[i] == (hits.pop() if how == "prefix" else None, how), i


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_prefixes_open_across_ranges(spark, parts):
    rng = random.Random(parts)
    # one id begins most keys, and keys that begin most ids nest
    keys = [("ab" * rng.randint(0, 12) + rng.choice(["", "a", "c", "é", "\U0001F600"]), rng.randint(0, 30)) for _ in range(300)] + [("", 3), (None, 1)]
    ids = [("ab" * rng.randint(0, 14) + rng.choice(["", "a", "b", "cz", "é"]),) for _ in range(200)] + [("ab",), ("a",), ("zz",), ("",), (None,)]
    got = {r.id: r for r in prefixes.prefix_sums(spark.createDataFrame(keys, "k string, n bigint"), spark.createDataFrame(ids, "i string"), "k", "n", "i", parts).collect()}
    assert set(got) == {i for i, in ids if i is not None}
    low, high = {}, {}
    for k, n in keys:
        if k is not None:
            low[k], high[k] = min(low.get(k, 99), n), max(high.get(k, -1), n)
    for i, r in got.items():
        below = [k for k in low if k.startswith(i) and k != i]
        above = [k for k in low if k and i.startswith(k) and k != i]
        for hits, name in ((below, "below"), (above, "above"), ([i] if i in low else [], "own")):
            best = min((low[k], k) for k in hits) if hits else (None, None)
            assert (r[f"{name}_n"], r[f"{name}_low"], r[f"{name}_key"], r[f"{name}_high"]) == (len(hits), *best, max((high[k] for k in hits), default=None)), (i, name)
        assert r.copies == sum(k == i for k, _ in keys)


def test_prefix_lookup_plan(spark):
    ids, keys = spark.createDataFrame([("a",)], "i string"), spark.createDataFrame([("ab", 1)], "k string, n int")
    out = joins.prefix_lookup(ids, keys, "i", "k", "n")
    # two exchanges before the stored ranges, the rest here; no side is joined by anything but whole ids
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in out.collect()] == [("a", 1, "prefix", 1)]


def test_numbering_of_text_and_sparse_ids(spark):
    rng = random.Random(2)
    f = spark.createDataFrame([(rng.choice("ab"), f"p{rng.random():.9f}", i) for i in range(400)], "id string, fpos string, n int")
    t = spark.createDataFrame([(rng.choice("ab"), rng.randint(-2**62, 2**62), i) for i in range(380)], "id string, tpos bigint, m int")
    got = {r.m: r.n for r in joins.occurrence_join(f, t, ["id"], "fpos", "tpos").filter("status = 'matched'").collect()}
    for k in "ab":
        one = [r.n for r in sorted(f.collect(), key=lambda r: r.fpos) if r.id == k]
        two = [r.m for r in sorted(t.collect(), key=lambda r: r.tpos) if r.id == k]
        assert all(got[m] == n for m, n in zip(two, one, strict=False)) and len(got) <= 380
    rows = [("x", f"cluster {rng.random()}", j) for i in range(90) for j in range(1 + i % 3)]
    names = {r[1] for r in rows}
    folds = splits.cluster_folds(spark.createDataFrame(rows, "c string, k string, j int"), "c", "k", 4)
    assert {r.k for r in folds.collect()} == names


def test_heavy_records_and_many_draws(spark):
    w = spark.createDataFrame([(i, 10_000 if i == 7 else i % 3) for i in range(300)], "i bigint, w bigint")
    got = splits.weighted_draws(w, "w", 3000, "i").collect()
    n = [sum(r.i == 7 for r in got), len({r.draw for r in got})]
    assert n[1] == len(got) == 3000 and abs(n[0] / 3000 - 10_000 / 10_299) < .02 and all(r.w > 0 for r in got)
    assert splits.weighted_draws(w.filter("w < 0"), "w", 5, "i").count() == 0


def test_occurrence_join_orders_duplicates(spark):
    f = spark.createDataFrame([(0, "b", 1), (1, "a", 0), (2, "dup", 1), (3, "dup", 0)], "fpos int, id string, label int")
    t = spark.createDataFrame([(0, "a", 0), (1, "dup", 0), (2, "b", 1), (3, "dup", 1)], "tpos int, id string, label int")
    got = {r.tpos: r.fpos for r in joins.occurrence_join(f, t, ["id", "label"], "fpos", "tpos").collect()}
    assert got == {0: 1, 1: 3, 2: 0, 3: 2}


@pytest.mark.parametrize("seed", range(6))
def test_fold_filling_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    rows, cid = [], 0
    for c in ("x", "y"):
        for _ in range(rng.randint(1, 60)):
            size = rng.choice([1, 1, 1, 1, 2, 2, 3, 5, 8, rng.randint(10, 60)])
            rows += [(c, cid, k) for k in range(size)]
            cid += 1
    if seed == 0:  # one cluster above all others together, then many of one size
        rows += [("x", cid, k) for k in range(500)] + [("x", cid + 1 + j, 0) for j in range(300)]
    got = {(r.c, r.cid): r.cluster_fold for r in splits.cluster_folds(spark.createDataFrame(rows, "c string, cid bigint, k int"), "c", "cid", 5).collect()}
    for c in ("x", "y"):
        sizes = {}
        for cc, i, _ in rows:
            if cc == c:
                sizes[i] = sizes.get(i, 0) + 1
        load = [0] * 5
        for i in sorted(sizes, key=lambda i: (-sizes[i], i)):
            best = min(range(5), key=lambda b: load[b])
            load[best] += sizes[i]
            assert got[(c, i)] == f"fold_{best + 1}"


def test_validation_sizes_and_quota(spark):
    rows = [(i, "abc"[i % 3], "g1" if i % 4 else "g2") for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, c string, g string")
    s = splits.leave_one_group_out(df, "i", "c", "g", ["g1", "g2", "absent"])
    assert {r.fold for r in s.select("fold").distinct().collect()} == {"g1", "g2"}
    n = {(r.fold, r.split): r.n for r in s.groupBy("fold", "split").agg(F.count("*").alias("n")).collect()}
    assert n[("g2", "test")] == 50 and n[("g2", "val")] == 15 and n[("g1", "val")] == 5
    assert {r.status for r in checks.split_validity(s, 200).collect()} == {"PASS"}
    per = [r.n for r in s.filter("fold = 'g2' and split = 'val'").groupBy("class").agg(F.count("*").alias("n")).collect()]
    assert per == [5, 5, 5]


def test_unstratified_and_one_row_pools(spark):
    q = splits.validation_quota(spark.createDataFrame([("a", "x", 9), ("a", "y", 1), ("b", "x", 1)], "f string, c string, n bigint"), "f", "c")
    assert {(r.f, r.stratified, r.quota) for r in q.collect()} == {("a", False, 1), ("b", False, 0)}
    df = spark.createDataFrame([(i, "x" if i else "y", "g1" if i < 3 else "g2") for i in range(12)], "i bigint, c string, g string")
    s = splits.leave_one_group_out(df, "i", "c", "g", ["g2"])
    assert {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 9, "val": 1, "train": 2}


def test_cluster_aware_group_is_own_fold(spark):
    m = spark.createDataFrame([(i, "x" if i < 30 else "y", i // 3) for i in range(60)], "i bigint, c string, k bigint")
    s = splits.cluster_aware_splits(m, splits.cluster_folds(m, "c", "k"), "i", "c", "k")
    assert s.count() == 300
    assert s.filter("(split = 'test') <> (fold = `group`)").count() == 0
    assert s.groupBy("cluster_id").agg(F.countDistinct("group").alias("n")).filter("n > 1").count() == 0


def test_samples_are_bounded_and_whole(spark):
    df = spark.createDataFrame([(i, "hot" if i > 20 else "few") for i in range(500)], "i bigint, c string")
    n = {r.c: r.n for r in splits.sample_per_class(df, "c", 40, "i").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert n == {"hot": 40, "few": 21}
    w = spark.createDataFrame([(0, 0), (1, 1), (2, 9)], "i bigint, w bigint")
    got = {r.i: r.n for r in splits.weighted_draws(w, "w", 2000, "i").groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 2000 and 0 not in got and 150 < got[1] < 250


def test_cutoffs_do_not_broadcast_the_records(spark):
    # records of a small estimated size: the one row per group is the side to send, not the records
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    quota = spark.createDataFrame([("a", 100), ("b", 7)], "g string, quota bigint")
    cut = splits.seeded_cutoffs(rows, ["g"], quota, 1, ["id"])
    assert "BuildLeft" not in cut._jdf.queryExecution().executedPlan().toString()
    kept = rows.join(cut, "g").where(splits.inside_quota(1, ["id"])).groupBy("g").count().collect()
    assert sorted(map(tuple, kept)) == [("a", 100), ("b", 7)]
