"""Registered queries of the nearest-neighbour engine, with the SQL that gives the same rows.

Queries ask from the rows of ``embeddings`` whose id is divisible by ``ASK``: that
is the query set, and it meets all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions import binary
from vicinage.operators import estimators, evaluate, exact, kmeans, pivots, range_search
from vicinage.operators.ivf import IVFIndex
from vicinage.operators.mih import MIHIndex
from vicinage.plans import describe
from vicinage.session import table
from vicinage.sources import datagen
from vicinage.sources.staging import fresh_path

DIM, WORDS, ASK, K = 64, 2, 10, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL pieces
_BITS = lambda v, a, b, center="0": f"list_sum(list_transform(range({a}, {b}), lambda i: CASE WHEN {v}[i + 1] > {center} THEN (1::BIGINT << (i - {a})) ELSE 0::BIGINT END))::BIGINT"
_BASE = f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT id AS qid, v AS q, label AS y FROM e WHERE id % {ASK} = 0),
we AS (SELECT id, {_BITS("v", 0, 32)} AS w0, {_BITS("v", 32, 64)} AS w1, label FROM e),
wq AS (SELECT id AS qid, w0 AS q0, w1 AS q1 FROM we WHERE id % {ASK} = 0)"""
_DIFF = "list_transform(list_zip(q, v), lambda p: abs(p[1] - p[2]))"
_DIST = {"l2": "list_distance(q, v)", "l2sq": "list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "l1": f"list_sum({_DIFF})", "linf": f"list_max({_DIFF})"}
_HAM = "(bit_count(xor(q0, w0)) + bit_count(xor(q1, w1)))::BIGINT"


def _knn_sql(metric: str, k: int = K, where: str = "true", data: str = "", with_: str = "") -> str:
    """CTE text that ends in ``knn(qid, id, distance, rank)``."""
    if metric == "hamming":
        pairs = f"SELECT qid, id, {_HAM} AS d FROM wq JOIN {data or 'we'} ON {where}"
    else:
        pairs = f"SELECT qid, id, {_DIST[metric]} AS d FROM q JOIN {data or 'e'} ON {where}"
    return f"WITH {_BASE}{with_}, pairs AS ({pairs}), knn AS (SELECT qid, id, d AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= {k})"


def _out(metric: str, columns: str = "qid, id, {d} AS distance, rank") -> str:
    return columns.format(d="distance" if metric == "hamming" else "round(distance, 6)")


# ------------------------------------------------------------- Spark pieces
def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asks(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % ASK == 0).select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", binary.sign_words(F.col("vec"), DIM))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- distances
def _dist_query(metric: str):
    @query(f"dist_{metric}", f"WITH {_BASE} SELECT qid, id, round({_DIST[metric]}, 6) AS distance FROM q, e")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = data(spark, sf_dir)
        return exact.pairs(asks(d), d, metric, DIM, digits=6)


for _m in ("l2", "l1", "linf", "l2sq"):
    _dist_query(_m)


@query("dist_l2sq_norms", ORACLE_SQL["dist_l2sq"])
def _(spark, sf_dir):
    d = data(spark, sf_dir)  # tiles take squared norms and a matrix product
    return exact.pairs(asks(d), d, "l2sq", DIM, digits=6)


@query("dist_hamming", f"WITH {_BASE} SELECT qid, id, {_HAM} AS distance FROM wq, we")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return exact.pairs(asks(w), w, "hamming", WORDS)


@query("dist_hamming_binary", f"WITH {_BASE}, b AS (SELECT id, md5(id::VARCHAR) AS h FROM e), x AS (SELECT id, [('0x' || substr(h, i, 8))::BIGINT FOR i IN [1, 9, 17, 25]] AS w FROM b) SELECT p.id AS qid, x.id, list_sum(list_transform(list_zip(p.w, x.w), lambda t: bit_count(xor(t[1], t[2]))))::BIGINT AS distance FROM x p JOIN x ON p.id % {ASK} = 0")
def _(spark, sf_dir):
    # 16-byte descriptors of any content: the digest of the id
    d = data(spark, sf_dir).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("vec"))
    w = d.withColumn("vec", binary.checked_words(F.col("vec"), 16))  # once a row, not once a pair
    return exact.pairs(asks(w), w, "hamming", 4)


@query("sign_words", f"WITH {_BASE} SELECT id, w0, w1 FROM we")
def _(spark, sf_dir):
    return words(data(spark, sf_dir)).select("id", F.col("vec")[0].alias("w0"), F.col("vec")[1].alias("w1"))


@query("sign_words_centered", f"WITH {_BASE}, m AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS c FROM e, range(1, {DIM + 1}) t(i) GROUP BY i)), x AS (SELECT id, [v[i] - c[i] FOR i IN range(1, {DIM + 1})] AS v FROM e, m) SELECT id, {_BITS('v', 0, 32)} AS w0, {_BITS('v', 32, 64)} AS w1 FROM x")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    center = list(d.agg(*[F.avg(F.col("vec")[i].cast("double")) for i in range(DIM)]).first())
    w = binary.sign_words(F.col("vec"), DIM, center)
    return d.select("id", w[0].alias("w0"), w[1].alias("w1"))


# ---------------------------------------------------------- exact neighbours
def _knn_queries(metric: str):
    sql = _knn_sql(metric)

    @query(f"knn_{metric}", f"{sql} SELECT {_out(metric)} FROM knn")
    def run(spark, sf_dir):
        d = data(spark, sf_dir) if metric != "hamming" else words(data(spark, sf_dir))
        found = exact.knn_join(asks(d), d, K, metric, dim=DIM if metric != "hamming" else WORDS)
        return found if metric == "hamming" else rounded(found, "distance")

    @query(f"nn1_{metric}", f"{_knn_sql(metric, 1)} SELECT {_out(metric, 'qid, id, {d} AS distance')} FROM knn")
    def run1(spark, sf_dir):
        d = data(spark, sf_dir) if metric != "hamming" else words(data(spark, sf_dir))
        found = exact.nn1_join(asks(d), d, metric, dim=DIM if metric != "hamming" else WORDS)
        return found if metric == "hamming" else rounded(found, "distance")


for _m in ("l2", "l1", "linf", "hamming"):
    _knn_queries(_m)


@query("knn_l2_block", ORACLE_SQL["knn_l2"])
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(exact.knn_join(asks(d), d, K, "l2", dim=DIM, plan="block"), "distance")


@query("knn_k_exceeds_n", f"{_knn_sql('l2', 10, 'e.id < 5')} SELECT {_out('l2')} FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)  # five rows are the data here: fewer than k
    return rounded(exact.knn_join(asks(d), d.where("id < 5"), 10, "l2", dim=DIM), "distance")


@query("knn_self_excluded", f"{_knn_sql('l2', K, 'qid <> id')} SELECT {_out('l2')} FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(exact.knn_join(asks(d), d, K, "l2", dim=DIM, exclude_self=True), "distance")


@query("knn_filtered", f"{_knn_sql('l2', K, 'e.label = q.y')} SELECT {_out('l2')} FROM knn")
def _(spark, sf_dir):
    # the filter is part of the join: neighbours of the query's own label
    d = data(spark, sf_dir)
    q = d.where(F.col("id") % ASK == 0).select(F.col("id").alias("qid"), F.col("vec").alias("q"), F.col("label").alias("part"))
    return rounded(exact.knn_within(q, d.withColumnRenamed("label", "part"), K, "l2", dim=DIM), "distance")


@query("knn_nested", f"{_knn_sql('hamming')} SELECT qid, to_json(list({{'distance': distance, 'id': id}} ORDER BY distance, id))::VARCHAR AS neighbours FROM knn GROUP BY qid")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return exact.nested(exact.knn_join(asks(w), w, K, "hamming", dim=WORDS)).select("qid", F.to_json("neighbours").alias("neighbours"))


#: Pruning pays in few dimensions: these queries search the first components.
LOW = 4


def _pruned_sql(metric: str, where: str = "true") -> str:
    few = f", e2 AS (SELECT id, v[1:{LOW}] AS v FROM e), q2 AS (SELECT qid, q[1:{LOW}] AS q FROM q)"
    return f"{_knn_sql(metric, K, where, with_=few, data='e2').replace('FROM q JOIN', 'FROM q2 JOIN')} SELECT {_out(metric)} FROM knn"


def low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data(spark, sf_dir).select("id", F.slice("vec", 1, LOW).alias("vec"))


def _pruned(metric: str):
    @query(f"knn_{metric}_pruned", _pruned_sql(metric))
    def run(spark, sf_dir):
        d = low(spark, sf_dir)
        return rounded(pivots.PivotIndex(metric, 16).fit(d).search(asks(d), K), "distance")


for _m in ("l2", "l1", "linf"):
    _pruned(_m)


@query("knn_pruned_self_excluded", _pruned_sql("l2", "qid <> id"))
def _(spark, sf_dir):
    d = low(spark, sf_dir)
    return rounded(pivots.PivotIndex("l2", 16).fit(d).search(asks(d), K, exclude_self=True), "distance")


@query("knn_l2_pruned_whole", f"{_knn_sql('l2')} SELECT {_out('l2')} FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir).select("id", "vec")  # all components: few cells are ruled out, results are exact in any case
    return rounded(pivots.PivotIndex("l2", 8).fit(d).search(asks(d), K), "distance")


@query("pivot_save_load", _pruned_sql("l1"))
def _(spark, sf_dir):
    d, path = low(spark, sf_dir), fresh_path(spark, "pivot-index")
    pivots.PivotIndex("l1", 16).fit(d).save(path)
    return rounded(pivots.PivotIndex.load(spark, path).search(asks(d), K), "distance")


@query("knn_l2_grid", ORACLE_SQL["knn_l2"])
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(exact.knn_join(asks(d), d, K, "l2", dim=DIM, plan="grid"), "distance")


@query("knn_hamming_pruned", ORACLE_SQL["knn_hamming"])
def _(spark, sf_dir):
    w = words(data(spark, sf_dir)).select("id", "vec")
    return pivots.PivotIndex("hamming", 16).fit(w).search(asks(w), K)


# -------------------------------------------------------------- range search
T = 20
_RANGE_SQL = f"WITH {_BASE}, hit AS (SELECT qid, id, {_HAM} AS distance, w0, w1 FROM wq JOIN we ON {_HAM} <= {T})"


@query("range_hamming", f"{_RANGE_SQL} SELECT qid, id, distance, w0 AS key0, w1 AS key1 FROM hit")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return range_search.range_join(asks(w), w, T, WORDS).select("qid", "id", "distance", F.col("key")[0].alias("key0"), F.col("key")[1].alias("key1"))


@query("range_hamming_pivot", ORACLE_SQL["range_hamming"])
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return range_search.range_join_pivots(asks(w), w, T, WORDS).select("qid", "id", "distance", F.col("key")[0].alias("key0"), F.col("key")[1].alias("key1"))


@query("range_count", f"{_RANGE_SQL} SELECT qid, count(*) AS n FROM hit GROUP BY qid")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return range_search.range_join(asks(w), w, T, WORDS).groupBy("qid").agg(F.count("*").alias("n"))


@query("range_size", f"WITH {_BASE} SELECT 2 * count(*) AS n, count(*) = 0 AS empty FROM we")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    index = range_search.RangeIndex(WORDS).set(w).append(w)
    return spark.createDataFrame([(index.size(), index.empty())], "n long, empty boolean")


@query("range_values", f"WITH {_BASE} SELECT w0, w1, count(*) AS n FROM we GROUP BY w0, w1")
def _(spark, sf_dir):
    values = range_search.RangeIndex(WORDS).set(words(data(spark, sf_dir))).values()
    return values.groupBy(F.col("vec")[0].alias("w0"), F.col("vec")[1].alias("w1")).agg(F.count("*").alias("n"))


@query("range_appended", f"WITH {_BASE}, two AS (SELECT id, w0, w1 FROM we UNION ALL SELECT id + (SELECT max(id) + 1 FROM we), w0, w1 FROM we) SELECT qid, id, {_HAM} AS distance FROM wq JOIN two ON {_HAM} <= 4")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return range_search.RangeIndex(WORDS).set(w).append(w).find_threshold(asks(w), 4).select("qid", "id", "distance")


@query("range_save_load", f"{_RANGE_SQL} SELECT qid, id, distance FROM hit")
def _(spark, sf_dir):
    w, path = words(data(spark, sf_dir)), fresh_path(spark, "range-index")
    range_search.RangeIndex(WORDS).set(w).save(path)
    return range_search.RangeIndex.load(spark, path).find_threshold(asks(w), T, pivots=True).select("qid", "id", "distance")


# ---------------------------------------------------------------- clustering
CELLS = 8
_CELL_SQL = f", c AS (SELECT id::INT AS cell, v AS c FROM e WHERE id < {CELLS}), a AS (SELECT id, v, arg_min(cell, {{'d': list_sum(list_transform(list_zip(c, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'cell': cell}}) AS cell FROM e, c GROUP BY id, v)"


def _first(df: DataFrame, k: int = CELLS) -> list[list]:
    return [list(r["vec"]) for r in df.where(F.col("id") < k).orderBy("id").collect()]


@query("kmeans_assign", f"WITH {_BASE}{_CELL_SQL} SELECT id, cell FROM a")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return kmeans.assign(d, _first(d)).select("id", "cell")


_ROUND_SQL = f"{_CELL_SQL}, m AS (SELECT cell, i, avg(v[i]) AS x FROM a, range(1, {DIM + 1}) t(i) GROUP BY cell, i)"


@query("kmeans_one_round", f"WITH {_BASE}{_ROUND_SQL} SELECT cell, i::INT - 1 AS dimension, round(x, 6) AS value FROM m")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    built = kmeans.kmeans(d, CELLS, max_iter=1, dim=DIM, seeds="first")
    return rounded(built.centroid_rows().select("cell", F.posexplode("centroid").alias("dimension", "value")), "value")


ROUNDS = 3
_NEAREST = "arg_min(cell, {'d': list_sum(list_transform(list_zip(c, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'cell': cell})"


def _rounds_sql(n: int) -> str:
    """``c0`` to ``cn``: centroids of each round; ``an``: every row's cell in the end."""
    out = f", c0 AS (SELECT id::INT AS cell, v AS c FROM e WHERE id < {CELLS})"
    for r in range(n):
        out += f", a{r} AS (SELECT id, v, {_NEAREST} AS cell FROM e, c{r} GROUP BY id, v)"
        out += f", c{r + 1} AS (SELECT cell, list(x ORDER BY i) AS c FROM (SELECT cell, i, avg(v[i]) AS x FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY cell, i) GROUP BY cell)"
    return out + f", a{n} AS (SELECT id, v, {_NEAREST} AS cell FROM e, c{n} GROUP BY id, v)"


@query("kmeans_fit", f"WITH {_BASE}{_rounds_sql(ROUNDS)} SELECT id, a{ROUNDS}.cell, round(c[1], 6) AS first, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS norm2 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cell)")
def _(spark, sf_dir):
    # whole rounds from fixed seeds: every row's cell, and its centroid's first component and squared norm
    built = kmeans.kmeans(data(spark, sf_dir), CELLS, max_iter=ROUNDS, dim=DIM, seeds="first")
    norm2 = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    cells = built.centroid_rows().select("cell", F.round(F.col("centroid")[0], 6).alias("first"), F.round(norm2, 6).alias("norm2"))
    return built.labels.join(F.broadcast(cells), "cell").select("id", "cell", "first", "norm2")  # CELLS rows


_BCELL_SQL = f", c AS (SELECT id::INT AS cell, w0 AS c0, w1 AS c1 FROM we WHERE id < {CELLS}), a AS (SELECT id, w0, w1, arg_min(cell, {{'d': bit_count(xor(c0, w0)) + bit_count(xor(c1, w1)), 'cell': cell}}) AS cell FROM we, c GROUP BY id, w0, w1)"
_MAJOR = lambda w: f"sum(b{w})::BIGINT"


@query(
    "binary_kmeans_round",
    f"WITH {_BASE}{_BCELL_SQL}, n AS (SELECT cell, count(*) AS n FROM a GROUP BY cell), s AS (SELECT cell, i, sum((w0 >> i) & 1) AS s0, sum((w1 >> i) & 1) AS s1 FROM a, range(0, 32) t(i) GROUP BY cell, i) "
    "SELECT cell, sum(CASE WHEN s0 > n // 2 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN s1 > n // 2 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS w1 FROM s JOIN n USING (cell) GROUP BY cell",
)
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return kmeans.binary_majority(w, _first(w), WORDS).select("cell", F.col("centroid")[0].alias("w0"), F.col("centroid")[1].alias("w1"))


# ------------------------------------------------------------- inverted files
#: Cells that the approximate queries probe: the fewest with a mean recall of 0.9 or more at 10
#: neighbours on the tables here (tests hold them to it).
PROBES = 7
_PROBE = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(
    "ivf_probe",
    f"WITH {_BASE}{_CELL_SQL}, p AS (SELECT qid, q, cell, row_number() OVER (PARTITION BY qid ORDER BY {_PROBE}, cell) AS r FROM q, c QUALIFY r <= {PROBES}), "
    f"pairs AS (SELECT qid, id, {_DIST['l2sq']} AS d FROM p JOIN a USING (cell)) SELECT qid, id, round(d, 6) AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= {K}",
)
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(IVFIndex(CELLS, PROBES).fit(d, centroids=_first(d)).search(asks(d), K), "distance")


@query("ivf_full_probe", f"{_knn_sql('l2sq')} SELECT {_out('l2sq')} FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(IVFIndex(CELLS, CELLS, max_iter=3).fit(d).search(asks(d), K), "distance")


@query("ivf_search1", f"{_knn_sql('l2sq', 1)} SELECT {_out('l2sq')} FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(IVFIndex(CELLS, CELLS, max_iter=1).fit(d).search1(asks(d)), "distance")


@query(
    "ivf_binary_probe",
    f"WITH {_BASE}{_BCELL_SQL}, p AS (SELECT qid, q0, q1, cell, row_number() OVER (PARTITION BY qid ORDER BY bit_count(xor(q0, c0)) + bit_count(xor(q1, c1)), cell) AS r FROM wq, c QUALIFY r <= {PROBES}), "
    f"pairs AS (SELECT qid, id, {_HAM} AS d FROM p JOIN a USING (cell)) SELECT qid, id, d AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= {K}",
)
def _(spark, sf_dir):
    w = words(data(spark, sf_dir)).select("id", "vec")
    return IVFIndex(CELLS, PROBES, "hamming").fit(w, centroids=_first(w)).search(asks(w), K)


@query("ivf_binary_full_probe", ORACLE_SQL["knn_hamming"])
def _(spark, sf_dir):
    w = words(data(spark, sf_dir)).select("id", "vec")
    return IVFIndex(CELLS, CELLS, "hamming", max_iter=2).fit(w).search(asks(w), K)


# ------------------------------------------------------- multi-index hashing
RADIUS, PARTS = 8, 4
_FLIP = " + ".join(f"CASE WHEN (17 * qid + {13 * i}) % 64 // 32 = {{j}} THEN 1::BIGINT << ((17 * qid + {13 * i}) % 32) ELSE 0 END" for i in range(5))
_NEAR_Q = f", nq AS (SELECT qid, xor(q0, {_FLIP.format(j=0)}) AS q0, xor(q1, {_FLIP.format(j=1)}) AS q1 FROM wq)"
_SUB = lambda a, b: " OR ".join(f"bit_count(xor(({a}{j} >> {s}) & 65535, ({b}{j} >> {s}) & 65535)) <= {RADIUS // PARTS}" for j in (0, 1) for s in (0, 16))


def _near_copies(w: DataFrame) -> DataFrame:
    q = asks(w).select(F.col("qid").alias("id"), F.col("q").alias("vec"))
    return datagen.flip_bits(q, WORDS, 5).select(F.col("id").alias("qid"), F.col("vec").alias("q"))


@query("mih_candidates", f"WITH {_BASE}{_NEAR_Q} SELECT qid, id FROM nq JOIN we ON {_SUB('q', 'w')}")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return MIHIndex(PARTS).fit(w, WORDS).candidates(_near_copies(w), RADIUS, plan="masks")


@query("mih_candidates_bits", ORACLE_SQL["mih_candidates"])
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return MIHIndex(PARTS).fit(w, WORDS).candidates(_near_copies(w), RADIUS, plan="bits")


_MIH_SQL = f"WITH {_BASE}{_NEAR_Q}, pairs AS (SELECT qid, id, {_HAM} AS d FROM nq JOIN we ON {_SUB('q', 'w')})"


@query("mih_knn", f"{_MIH_SQL} SELECT qid, id, d AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= 5")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return MIHIndex(PARTS).fit(w, WORDS).search(_near_copies(w), 5, RADIUS)


@query("mih_radius_complete", f"WITH {_BASE}{_NEAR_Q} SELECT count(*) AS near, 0::BIGINT AS missed FROM nq JOIN we ON {_HAM} <= {RADIUS}")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    q = _near_copies(w)
    found = MIHIndex(PARTS).fit(w, WORDS).candidates(q, RADIUS).withColumn("found", F.lit(1))
    near = range_search.range_join(q, w, RADIUS, WORDS).select("qid", "id").join(found, ["qid", "id"], "left")
    return near.agg(F.count("*").alias("near"), F.count(F.when(F.col("found").isNull(), 1)).alias("missed"))


# ----------------------------------------------------------------- estimators
_SELF_KNN = _knn_sql("l2", 5, "qid <> id")
_GRAPH = _knn_sql("l2", 5)


@query("knn_graph_connectivity", f"{_GRAPH} SELECT qid AS row, id AS col, 1.0::DOUBLE AS value FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return estimators.NearestNeighbors(5, dim=DIM).fit(d).kneighbors_graph(asks(d))


@query("knn_graph_distance", f"{_GRAPH} SELECT qid AS row, id AS col, round(distance, 6) AS value FROM knn")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(estimators.NearestNeighbors(5, dim=DIM).fit(d).kneighbors_graph(asks(d), mode="distance"), "value")


@query("kneighbors_own", f"WITH {_BASE}, wq2 AS (SELECT id AS qid, w0 AS q0, w1 AS q1 FROM we), pairs AS (SELECT qid, id, {_HAM} AS d FROM wq2 JOIN we ON qid <> id) SELECT qid, id, d AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= 3")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir))
    return estimators.NearestNeighbors(3, "hamming", dim=WORDS).fit(w).kneighbors()


@query("kneighbors_own_l2", f"WITH {_BASE}, q2 AS (SELECT id AS qid, v AS q FROM e), pairs AS (SELECT qid, id, {_DIST['l2']} AS d FROM q2 JOIN e ON qid <> id) SELECT qid, id, round(d, 6) AS distance, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs QUALIFY rank <= 3")
def _(spark, sf_dir):
    return rounded(estimators.NearestNeighbors(3, dim=DIM).fit(data(spark, sf_dir)).kneighbors(), "distance")


@query("classifier_classes", "SELECT DISTINCT label FROM embeddings")
def _(spark, sf_dir):
    classes = estimators.KNeighborsClassifier(5, dim=DIM).fit(data(spark, sf_dir)).classes()
    return spark.createDataFrame([(c,) for c in classes], "label int")


def _weights_sql(kind: str, base: str = _SELF_KNN) -> str:
    if kind == "uniform":
        return f"{base}, w AS (SELECT qid, id, 1.0::DOUBLE AS w FROM knn)"
    return f"{base}, w AS (SELECT qid, id, CASE WHEN min(distance) OVER (PARTITION BY qid) = 0 THEN (distance = 0)::INT::DOUBLE ELSE 1 / distance END AS w FROM knn)"


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training rows and queries: queries are their own rows less themselves, so
    the training side leaves out the query set."""
    d = data(spark, sf_dir)
    return d.where(F.col("id") % ASK != 0), d.where(F.col("id") % ASK == 0).select(F.col("id").alias("qid"), F.col("vec").alias("q"), F.col("label").alias("y"))


_TRAIN_KNN = _knn_sql("l2", 5, f"e.id % {ASK} <> 0")


def _proba_sql(kind: str) -> str:
    return f"{_weights_sql(kind, _TRAIN_KNN)}, votes AS (SELECT qid, label, sum(w) AS v FROM w JOIN e USING (id) GROUP BY qid, label), proba AS (SELECT qid, label, v / sum(v) OVER (PARTITION BY qid) AS p FROM votes)"


_PREDICT = ", pred AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, label) AS r FROM proba QUALIFY r = 1)"


@query("predict_proba", f"{_proba_sql('distance')} SELECT qid, label, round(p, 6) AS proba FROM proba")
def _(spark, sf_dir):
    train, q = _labelled(spark, sf_dir)
    return rounded(estimators.KNeighborsClassifier(5, weights="distance", dim=DIM).fit(train).predict_proba(q), "proba")


def _classify(kind: str):
    @query(f"classify_{kind}", f"{_proba_sql(kind)}{_PREDICT} SELECT qid, label FROM pred")
    def run(spark, sf_dir):
        train, q = _labelled(spark, sf_dir)
        return estimators.KNeighborsClassifier(5, weights=kind, dim=DIM).fit(train).predict(q)


_classify("uniform")
_classify("distance")


@query("classifier_accuracy", f"{_proba_sql('uniform')}{_PREDICT} SELECT round(avg((pred.label = q.y)::INT), 6) AS accuracy FROM pred JOIN q USING (qid)")
def _(spark, sf_dir):
    train, q = _labelled(spark, sf_dir)
    return rounded(estimators.KNeighborsClassifier(5, dim=DIM).fit(train).score(q), "accuracy")


def _regress(kind: str):
    @query(f"regress_{kind}", f"{_weights_sql(kind, _TRAIN_KNN)} SELECT qid, round(sum(w * label) / sum(w), 6) AS prediction FROM w JOIN e USING (id) GROUP BY qid")
    def run(spark, sf_dir):
        train, q = _labelled(spark, sf_dir)
        return rounded(estimators.KNeighborsRegressor(5, weights=kind, dim=DIM).fit(train.withColumn("y", F.col("label").cast("double"))).predict(q), "prediction")


_regress("uniform")
_regress("distance")


@query("regress_multi", f"{_weights_sql('distance', _TRAIN_KNN)} SELECT qid, round(sum(w * label) / sum(w), 6) AS p0, round(sum(w * 2 * label) / sum(w), 6) AS p1, round(sum(w * v[1]) / sum(w), 6) AS p2 FROM w JOIN e USING (id) GROUP BY qid")
def _(spark, sf_dir):
    train, q = _labelled(spark, sf_dir)
    y = F.array(F.col("label").cast("double"), 2.0 * F.col("label"), F.col("vec")[0].cast("double"))
    found = estimators.KNeighborsRegressor(5, weights="distance", dim=DIM).fit(train.withColumn("y", y)).predict(q)
    return found.select("qid", *[F.round(F.col("prediction")[i], 6).alias(f"p{i}") for i in range(3)])


@query("regressor_r2", f"{_weights_sql('uniform', _TRAIN_KNN)}, p AS (SELECT qid, sum(w * label) / sum(w) AS p FROM w JOIN e USING (id) GROUP BY qid) SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM p JOIN q USING (qid)")
def _(spark, sf_dir):
    train, q = _labelled(spark, sf_dir)
    return rounded(estimators.KNeighborsRegressor(5, dim=DIM).fit(train.withColumn("y", F.col("label").cast("double"))).score(q), "r2")


# ------------------------------------------------------- evaluation, the rest
_APPROX = ORACLE_SQL["ivf_probe"]
_HITS = f"truth AS ({ORACLE_SQL['knn_l2']}), approx AS ({_APPROX}), h AS (SELECT t.qid, count(a.id) AS hits, count(*) AS wanted FROM truth t LEFT JOIN approx a ON t.qid = a.qid AND t.id = a.id GROUP BY t.qid)"


def _truth_and_approx(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = data(spark, sf_dir)
    return exact.knn_join(asks(d), d, K, "l2", dim=DIM), IVFIndex(CELLS, PROBES).fit(d, centroids=_first(d)).search(asks(d), K)


@query("recall_at_k", f"WITH {_HITS} SELECT round(avg(hits / wanted), 6) AS recall FROM h")
def _(spark, sf_dir):
    return rounded(evaluate.recall_at_k(*_truth_and_approx(spark, sf_dir)), "recall")


@query("hit_rate_at_k", f"WITH {_HITS} SELECT round(avg((hits > 0)::INT), 6) AS hit_rate FROM h")
def _(spark, sf_dir):
    return rounded(evaluate.hit_rate_at_k(*_truth_and_approx(spark, sf_dir)), "hit_rate")


@query("index_stats", f"WITH {_BASE}{_CELL_SQL} SELECT a.cell, count(*) AS n, round(min(list_distance(v, c)), 6) AS r_min, round(max(list_distance(v, c)), 6) AS r_max FROM a JOIN c USING (cell) GROUP BY a.cell")
def _(spark, sf_dir):
    d = data(spark, sf_dir)
    cells = kmeans.assign(d, _first(d)).withColumn("r", F.sqrt("distance"))
    return rounded(describe.cell_stats(cells, "r"), "r_min", "r_max")


@query("voronoi_grid", f"WITH {_BASE}, s AS (SELECT id, v[1:2] AS v FROM e WHERE id < 20), g AS (SELECT y * 80 + x AS qid, [x / 80.0 - 0.5, y / 60.0 - 0.5]::DOUBLE[] AS q FROM range(0, 80) a(x), range(0, 60) b(y)) SELECT qid, arg_min(id, {{'d': list_distance(q, v), 'id': id}}) AS id FROM g, s GROUP BY qid")
def _(spark, sf_dir):
    seeds = data(spark, sf_dir).where("id < 20").select("id", F.slice("vec", 1, 2).alias("vec"))  # the demo's 20 seeds
    grid = spark.range(80 * 60).select(F.col("id").alias("qid"), F.array(F.col("id") % 80 / 80.0 - 0.5, F.floor(F.col("id") / 80) / 60.0 - 0.5).alias("q"))
    return exact.nn1_join(grid, seeds, "l2", dim=2).select("qid", "id")


@query("save_load_roundtrip", f"{_knn_sql('l2sq')} SELECT {_out('l2sq')} FROM knn")
def _(spark, sf_dir):
    d, path = data(spark, sf_dir), fresh_path(spark, "ivf-index")
    IVFIndex(CELLS, CELLS).fit(d, centroids=_first(d)).save(path)
    return rounded(IVFIndex.load(spark, path).search(asks(d), K), "distance")


@query("mih_save_load", ORACLE_SQL["mih_knn"])
def _(spark, sf_dir):
    w, path = words(data(spark, sf_dir)), fresh_path(spark, "mih-index")
    MIHIndex(PARTS).fit(w, WORDS).save(path)
    return MIHIndex.load(spark, path).search(_near_copies(w), 5, RADIUS)


@query("index_properties", f"SELECT {CELLS} AS nlist, 3 AS nprobe, {PARTS} AS m, count(*) AS n, 8 AS nbytes FROM embeddings")
def _(spark, sf_dir):
    w = words(data(spark, sf_dir)).select("id", "vec")
    ivf = IVFIndex(CELLS, CELLS, "hamming").fit(w, centroids=_first(w)).set_nprobe(3)
    mih = MIHIndex(PARTS).fit(w, WORDS)
    return spark.createDataFrame([(ivf.nlist, ivf.n_probe, mih.m, mih.n, mih.nbytes)], "nlist int, nprobe int, m int, n long, nbytes int")


GENERATED, GENERATED_DIM, CLUSTERS = 2_000, 4, 50
_NAME = lambda *parts: " || '/' || ".join(f"({p})::VARCHAR" for p in parts)
_HEX = lambda digest, at, n: f"('0x' || substr({digest}, {at}, {n}))::BIGINT"
_UNIT = lambda *parts: f"({_HEX(f'md5({_NAME(*parts)})', 1, 8)} / 4294967296.0::DOUBLE)"
_CLUSTER = f"id % {CLUSTERS}"
_CENTRE, _WIDTH = _UNIT("42", "'centre'", _CLUSTER, "d"), f"(1 + 9 * {_UNIT('42', chr(39) + 'width' + chr(39), _CLUSTER, 'd')})"
_NOISE = f"((list_sum([{_HEX('sha256(' + _NAME('42', 'id', 'd') + ')', '4 * j + 1', 4)} FOR j IN range(16)])::BIGINT / 65536.0::DOUBLE - 8 * 65535 / 65536.0::DOUBLE) * sqrt(0.75::DOUBLE))"
_GENERATED = f"SELECT id, ({_CLUSTER})::INT AS cell, d AS dimension, {{value}} AS value FROM range({GENERATED}) r(id), range({GENERATED_DIM}) s(d)"


def _components(df: DataFrame) -> DataFrame:
    return df.select("id", "cell", F.posexplode("vec").alias("dimension", "value")).withColumn("dimension", F.col("dimension").cast("long"))


@query("gaussian_clusters", _GENERATED.format(value=f"round((({_CENTRE} * 2 - 1) * 10000 + {_NOISE} * {_WIDTH})::FLOAT::DOUBLE, 2)"))
def _(spark, sf_dir):
    return _components(datagen.gaussian_clusters(spark, GENERATED, GENERATED_DIM, CLUSTERS)).withColumn("value", F.round(F.col("value").cast("double"), 2))


@query("gaussian_bytes", _GENERATED.format(value=f"(floor({_CENTRE} * 255 + {_NOISE})::INT % 256 + 256) % 256"))
def _(spark, sf_dir):
    return _components(datagen.gaussian_clusters(spark, GENERATED, GENERATED_DIM, CLUSTERS, kind="uint8"))


@query("near_copy_words", f"WITH {_BASE}{_NEAR_Q} SELECT qid, q0, q1 FROM nq")
def _(spark, sf_dir):
    return _near_copies(words(data(spark, sf_dir))).select("qid", F.col("q")[0].alias("q0"), F.col("q")[1].alias("q1"))


@query("knn_with_delta", ORACLE_SQL["knn_l2"])
def _(spark, sf_dir):
    from vicinage.streaming.stream_knn import with_delta

    d = data(spark, sf_dir)
    old, recent = d.where("id % 3 <> 0"), d.where("id % 3 = 0")
    found = with_delta(lambda q: exact.knn_join(q, old, K, "l2", dim=DIM), asks(d), recent, K, "l2", dim=DIM)
    return rounded(found, "distance")
