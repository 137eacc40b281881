"""Plans that hold at size: searches that keep the nearest rows while blocks pass, and all pairs in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.operators import exact, kernel
from vicinage.operators.pivots import PivotIndex
from vicinage.plans import describe
from vicinage.queries import QUERIES


def brute(kind, qids, q, ids, x, k, exclude_self):
    out = []
    for qid, v in zip(qids, q, strict=True):
        d = kernel.exact_distances(kind, np.broadcast_to(v, x.shape), x)
        fine = np.isfinite(d) & ((ids != qid) | (not exclude_self))
        i, f = ids[fine], d[fine]
        out += [(int(qid), int(i[b]), float(f[b])) for b in np.lexsort((i, f))[:k]]
    return out


@pytest.mark.parametrize("kind,dim", [("l2", 3), ("l2", 20), ("l2sq", 20), ("l1", 3), ("l1", 20), ("linf", 20), ("hamming", 1), ("hamming", 5)])
@pytest.mark.parametrize("offset", [0.0, 1e4, 1e17])
def test_nearest_equals_brute_force(kind, dim, offset):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 32, (5000, dim)) if kind == "hamming" else rng.standard_normal((5000, dim)) + offset
    x[::7] = x[3]  # copies: ties go to the smaller id, however the rows are cut
    if kind != "hamming" and offset > 1e16:
        x[5, 0], x[6, 0] = np.nan, np.inf
    ids = rng.permutation(5000).astype(np.int64)
    for k, own in ((1, False), (10, True)):
        near = kernel.Nearest(kind, ids[:30], x[:30], k, own)
        for at in range(0, 5000, 1300):
            near.add(ids[at : at + 1300], x[at : at + 1300])
        assert list(zip(*[c.tolist() for c in near.rows()], strict=True)) == brute(kind, ids[:30], x[:30], ids, x, k, own)


@pytest.mark.parametrize("name", ["dist_l2", "dist_l1", "dist_linf", "dist_l2sq", "dist_l2sq_norms"])
def test_all_pairs_of_long_vectors_are_tiles_over_many_tasks(name, spark):
    # a nested loop's code for 64 components is too large for the JVM to compile, and one file made one task
    df = QUERIES[name](spark, "/root/testdata/sf0.1")
    assert not describe.plan_facts(df)["BroadcastNestedLoopJoin"] and df.rdd.getNumPartitions() > 1


def test_digest_words_are_made_once_a_row(spark):
    plan = QUERIES["dist_hamming_binary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan.split("Join")[0] and not describe.plan_facts(QUERIES["dist_hamming_binary"](spark, "/root/testdata/sf0.001"))["CartesianProduct"]


@pytest.mark.parametrize("name", ["knn_hamming", "kneighbors_own", "knn_l1_pruned", "knn_filtered"])
def test_searches_sort_no_pairs(name, spark):
    # a nested loop or a join of rows and queries sorted every pair for the top k
    df = QUERIES[name](spark, "/root/testdata/sf0.1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not describe.plan_facts(df)["BroadcastNestedLoopJoin"] and "MapInArrow" in plan


def test_a_task_sends_on_k_rows_a_query(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        d = spark.range(0, 2000, 1, 2).select("id", F.array(*[F.rand(i).cast("double") for i in range(12)]).alias("vec"))
        q = d.where("id < 20").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
        assert exact._block(q, d, 5, "l2", False).count() == 2 * 20 * 5  # by batches of 100 rows it was 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_the_grid_are_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact, "GRID_BYTES", 2000)
    d = spark.range(300).select("id", F.array(*[F.col("id") * (i + 1) % 17 / 17.0 for i in range(12)]).alias("vec"))
    q = d.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    pairs = exact.grid(q, d, "l1", 12, digits=6)
    assert pairs.count() == 60 * 300 and pairs.select("qid", "id").distinct().count() == 60 * 300
    assert pairs.rdd.getNumPartitions() >= 10
    rows = lambda plan: sorted(map(tuple, exact.knn_join(q, d, 4, "l1", dim=12, plan=plan).collect()))
    assert rows("grid") == rows("cross")


def test_neighbours_of_the_own_part(spark, monkeypatch):
    monkeypatch.setattr(exact, "GRID_BYTES", 2000)
    monkeypatch.setattr(exact, "GROUP_BUCKETS", 2)
    d = spark.range(400).select("id", F.array(*[F.col("id") * (i + 3) % 19 / 19.0 for i in range(10)]).alias("vec"), F.when(F.col("id") % 9 > 0, F.col("id") % 9 % 5).alias("part"))
    q = d.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"), "part")
    got = sorted(map(tuple, exact.knn_within(q, d, 3, "l2", dim=10).collect()))
    rows = d.collect()
    want = []
    for one in rows[::10]:
        near = sorted((float(kernel.exact_distances("l2", np.array([one["vec"]]), np.array([r["vec"]]))[0]), r["id"]) for r in rows if r["part"] is not None and r["part"] == one["part"])[:3]
        want += [(one["id"], i, f, n + 1) for n, (f, i) in enumerate(near)]
    assert got == sorted(want)


@pytest.mark.parametrize("metric", ["l2", "l1", "linf"])
def test_pivot_search_with_copies(spark, metric):
    d = spark.range(600).select("id", F.array(*[F.col("id") * (i + 1) % 50 / 50.0 for i in range(3)]).alias("vec"))  # twelve copies of each row
    q = d.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    for own in (False, True):
        got = PivotIndex(metric, 5).fit(d).search(q, 15, exclude_self=own)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.knn_join(q, d, 15, metric, dim=3, exclude_self=own).collect()))


@pytest.mark.parametrize("asked", [3, 40])
@pytest.mark.parametrize("offset,scale", [(0.0, 1.0), (1e4, 1e-3), (0.0, 1e200), (3.0, 1e-15)])
def test_linf_bitmaps_equal_brute_force(monkeypatch, asked, offset, scale):
    for name, n in (("UNRANGED", 50), ("RANGED", 300), ("RANGED_ASKED", 8)):
        monkeypatch.setattr(kernel, name, n)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 12)) * scale + offset
    x[::7], x[200:900, 4] = x[3], x[2, 4]  # copies, and a component that hardly differs
    x[1::9] = np.round(x[1::9], 1)  # rows on the edge of a range
    ids, seen = rng.permutation(1500).astype(np.int64), []
    passed = kernel.Nearest._ranges
    monkeypatch.setattr(kernel.Nearest, "_ranges", lambda self, i, v: (seen.append(len(i)), passed(self, i, v)))
    for k, own in ((1, False), (10, True), (2000, False)):
        near = kernel.Nearest("linf", ids[:asked], x[:asked], k, own)
        for at in range(0, 1500, 700):
            near.add(ids[at : at + 700], x[at : at + 700])
        assert list(zip(*[c.tolist() for c in near.rows()], strict=True)) == brute("linf", ids[:asked], x[:asked], ids, x, k, own)
    assert bool(seen) == (asked > 30)  # few queries are screened pair by pair


@pytest.mark.parametrize("k", [1, 10])
def test_linf_looks_at_few_pairs(k, monkeypatch):
    # every pair went through 64 passes in single precision
    rng = np.random.default_rng(7)
    x, pairs = rng.standard_normal((40000, 64)), [0]
    single = kernel.Nearest._single
    monkeypatch.setattr(kernel.Nearest, "_single", lambda self, v: (pairs.__setitem__(0, pairs[0] + len(v) * len(self.qids)), single(self, v))[1])
    near = kernel.Nearest("linf", np.arange(600), x[:600], k)
    near.add(np.arange(40000), x)
    assert pairs[0] <= 600 * 40000 // 20


@pytest.mark.parametrize("kind,dim", [("linf", 4), ("l1", 4), ("l2", 20), ("hamming", 2)])
def test_copies_are_looked_at_k_times(kind, dim, monkeypatch):
    # a query that lies next to many copies took the distance of each of them
    rng, taken = np.random.default_rng(8), [0]
    x = rng.integers(0, 1 << 32, (3000, dim)) if kind == "hamming" else rng.standard_normal((3000, dim))
    x[::2], x[1::8] = x[0], x[1]
    ids = rng.permutation(3000).astype(np.int64)
    ids[:600:2] = ids[0]  # rows of one id, too
    held = kernel.Nearest._hold
    for k, own in ((1, False), (10, False), (10, True)):
        want = brute(kind, ids[:80], x[:80], ids, x, k, own)
        monkeypatch.setattr(kernel.Nearest, "_hold", lambda self, rows, *a: (taken.__setitem__(0, taken[0] + len(rows)), held(self, rows, *a)))
        taken[0], near = 0, kernel.Nearest(kind, ids[:80], x[:80], k, own)
        near.add(ids, x)
        assert list(zip(*[c.tolist() for c in near.rows()], strict=True)) == want
        assert own or taken[0] < 80 * 1500 / 2


def test_equal_hashes_are_no_proof_of_copies(monkeypatch):
    monkeypatch.setattr(kernel.np.random, "default_rng", lambda seed: type("Z", (), {"integers": lambda self, lo, hi, n, kind: np.full(n, (1 << 63) - 1, np.uint64)})())
    x = np.array([[1.0, 2.0], [2.0, 1.0]] * 6)  # sums of components that are only exchanged are equal
    keep = kernel.few_copies(np.arange(12), x, 3, False)
    assert keep[:5].all() and keep[::2].sum() == 3


@pytest.mark.parametrize("name", ["knn_linf_pruned", "pivot_save_load"])
def test_pruned_searches_sort_no_pairs(name, spark):
    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan


def test_columns_of_all_pairs_repeat_in_short_cycles(spark, monkeypatch):
    # a row met all queries before the next row did, and their ids were written in full each time
    monkeypatch.setattr(exact, "CHUNK", 8)
    d = spark.range(0, 60, 1, 1).select("id", F.array(F.col("id") * 77, F.col("id") * 31).alias("vec"))
    q = d.where("id % 2 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    for own in (False, True):
        got = [tuple(r) for r in exact.pairs(q, d, "hamming", 2, exclude_self=own).collect()]
        assert sorted(got) == sorted((a, b, (a * 77 ^ b * 77).bit_count() + (a * 31 ^ b * 31).bit_count()) for a in range(0, 60, 2) for b in range(60) if not own or a != b)
    one = [r[0] for r in exact.pairs(q, d.coalesce(1), "hamming", 2).collect()]
    assert len(set(one[:400])) == 8


@pytest.mark.parametrize("metric,kind", [("linf", "float"), ("l1", "double"), ("l2", "float"), ("l2", "double"), ("hamming", "bigint")])
def test_a_query_that_equals_a_row_is_not_searched(spark, metric, kind, monkeypatch):
    # every query went through all rows, though nothing is nearer than an equal row
    monkeypatch.setattr(exact, "MOST_PAIRS", 0)
    rng = np.random.default_rng(9)
    x = rng.integers(-40, 40, (400, 3)) * (1 if kind == "bigint" else 0.25)
    x[::3], x[10:20] = x[0], 0  # many copies of one row
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(400), x, strict=True)]
    asked = [(1000 + n, v) for n, v in enumerate(np.array([x[0], x[1], x[50], [7, 70, 7], [0, 0, 0]], x.dtype).tolist())]
    if kind != "bigint":
        rows += [(400, [0.0, float("nan"), 0.0]), (401, [float("inf"), 0.0, 0.0]), (402, [-0.0, 0.0, -0.0]), (403, [1e-200, 0.0, 0.0])]
        asked += [(2000, rows[400][1]), (2001, rows[401][1]), (2002, rows[402][1]), (2003, [1e-200, 0.0, 0.0]), (2004, [5e-201, 0.0, 0.0])]
    rows, asked = ([(i, v * 3) for i, v in some] for some in (rows, asked))  # too many components for a nested loop
    d, q = (spark.createDataFrame(r, f"id long, v array<{'double' if kind == 'float' else kind}>").select("id", F.col("v").cast(f"array<{kind}>").alias("v")) for r in (rows, asked))
    d, q = d.withColumnRenamed("v", "vec"), q.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    want = sorted(map(tuple, exact.knn_join(q, d, 1, metric, dim=9).drop("rank").collect()))
    searched, search = [], exact.knn_join
    monkeypatch.setattr(exact, "knn_join", lambda queries, *a, **b: (searched.extend(r[0] for r in queries.select("qid").collect()), search(queries, *a, **b))[1])
    got = exact.nn1_join(q, d, metric, dim=9)
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 5
    if (metric, kind) != ("l2", "double"):  # whose squares may come to 0
        assert 1003 in searched and not {1000, 1001, 1002, 1004, 2002} & set(searched)
    own = exact.nn1_join(q.where("qid < 1003"), d, metric, dim=9)
    assert "MapInArrow" not in own._jdf.queryExecution().optimizedPlan().toString() or (metric, kind) == ("l2", "double")
    assert sorted(map(tuple, own.collect())) == [r for r in want if r[0] < 1003] and own.schema == got.schema


@pytest.mark.parametrize("kind,k", [("l1", 1), ("l1", 10), ("l1", 150), ("linf", 10), ("l2", 10), ("l2sq", 10)])
def test_boxes_equal_brute_force(kind, k):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3000, 4))
    x[::11], x[1::5] = x[4], np.round(x[1::5], 1)  # copies, ties
    ids = rng.permutation(3000).astype(np.int64)
    for n in (33, 1024, 1057, 3000):
        for own, most in ((False, np.inf), (True, np.inf), (False, 0.5)):
            near = kernel.Nearest(kind, ids[:60], x[:60], k, own, most)
            for at in range(0, n, 1700):
                near.add(ids[at : min(n, at + 1700)], x[at : min(n, at + 1700)])
            want = [r for r in brute(kind, ids[:60], x[:60], ids[:n], x[:n], k, own) if r[2] <= most]
            assert list(zip(*[c.tolist() for c in near.rows()], strict=True)) == want


def test_boxes_leave_few_pairs(monkeypatch):
    # a query was held against every box, and met some 1000 rows
    rng, taken = np.random.default_rng(11), [0]
    x = rng.standard_normal((20000, 4))
    held = kernel.Nearest._hold
    monkeypatch.setattr(kernel.Nearest, "_hold", lambda self, rows, *a: (taken.__setitem__(0, taken[0] + len(rows)), held(self, rows, *a)))
    near = kernel.Nearest("l1", np.arange(2000), x[:2000], 10)
    near.add(np.arange(20000), x)
    assert taken[0] <= 2000 * 700
