"""Two-table fuzzy join, MinHash join, Python extractors, the smat data source and the feature store."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import __spark_entry__ as E
from twinmark.operators import extractors as XT
from twinmark.operators import features as X
from twinmark.operators import interact as I
from twinmark.operators import matching as M
from twinmark.operators import neighbors as N
from twinmark.operators import stats as ST
from twinmark.sources import smat as SMT
from twinmark.sources import smat_source as SRC
from twinmark.sources.store import FeatureStore, identity
from twinmark.sources.tables import TABLES

from .conftest import SF


@pytest.mark.parametrize("name", ["fuzzy_words", "near_duplicates_minhash", "python_features", "smat_source_roundtrip", "stacked_features",
                                  "aggregate_modes", "length_quantiles", "blocked_dots", "doc_pairs"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in got.columns]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


# ---------------------------------------------------------------- fuzzy join of two tables

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def strings(spark, values, col):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


@pytest.mark.parametrize("k,spare", [(0, 0), (1, 0), (1, 2), (2, 1), (3, 2)])
def test_fuzzy_join_of_two_tables_is_brute_force(spark, k, spare):
    rng = random.Random(k * 10 + spare)
    say = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 9)))
    a, b = [say() for _ in range(120)] + [None, "", "x" * 30], [say() for _ in range(120)] + [None, "", "x" * 29 + "y"]
    got = {(r.a, r.b): r.edits for r in M.fuzzy_join(strings(spark, a, "u"), "u", strings(spark, b, "v"), "v", k, spare).collect()}
    want = {(x, y): edits(x, y) for x in set(a) - {None} for y in set(b) - {None}}
    assert got == {p: d for p, d in want.items() if d <= k}


def test_generated_names_meet_few_candidates(spark):
    """A prefix that all strings share must not pair them all."""
    a, b = strings(spark, [f"Customer#{i:09d}" for i in range(0, 9000, 9)], "a"), strings(spark, [f"Customer#{i:09d}" for i in range(4, 8000, 8)], "b")
    pairs = M.segment_candidates(a, b, 1, spare=8)
    assert pairs.count() < 0.08 * 1000 * 1000
    got = {(r.a, r.b) for r in M.fuzzy_join(a, "a", b, "b", 1, spare=8).collect()}
    assert got == {(x, y) for x, y in itertools.product([r.a for r in a.collect()], [r.b for r in b.collect()]) if sum(p != q for p, q in zip(x, y)) <= 1}
    with pytest.raises(ValueError):
        M.fuzzy_join(a, "a", b, "b", -1)


# ---------------------------------------------------------------- MinHash

def test_minhash_pairs_are_verified_and_recall_is_high(spark):
    rng = random.Random(3)
    base = [[f"g{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(40)]
    rows, i = [], 0
    for g in base:
        for drop in range(5):
            rows.append((i, g[drop:] + [f"n{i}x{j}" for j in range(drop)]))
            i += 1
    rows += [(i, []), (i + 1, None)]
    sets = spark.createDataFrame(rows, "id long, g array<string>")
    exact = {(r.id_a, r.id_b): r.jaccard for r in M.jaccard_self_join(sets, "id", "g", 0.8).collect()}
    got = {(r.id_a, r.id_b): r.jaccard for r in M.jaccard_minhash_join(sets, "id", "g", 0.8).collect()}
    assert len(exact) > 300 and all(exact[p] == s for p, s in got.items()) and len(got) >= 0.99 * len(exact)


def test_a_hot_bucket_is_cut_into_cells_without_losing_a_pair(spark):
    sets = spark.createDataFrame([(i, [7, 8, 9]) for i in range(150)], "id long, h array<long>")
    whole = M.minhash_candidates(sets, "id", 1, 1)
    cut = M.minhash_candidates(sets, "id", 1, 1, bucket=16)
    assert whole.count() == cut.count() == 150 * 149 // 2
    assert cut.filter("id_a >= id_b").count() == 0 and cut.distinct().count() == cut.count()


# ---------------------------------------------------------------- Python extractors

def pairs(spark):
    return spark.createDataFrame([(1, "MARTHA", "MARHTA"), (2, "DIXON", "DICKSONX"), (3, None, "x"), (4, "", ""), (5, "a", None)], "k long, s1 string, s2 string")


def test_python_extractor_values_and_nulls(spark):
    got = {r.k: r for r in XT.extract(pairs(spark), ["k"], ["Jaro"]).collect()}
    assert round(got[1].jaro, 6) == 0.944444 and round(got[1].jaro_winkler, 6) == 0.961111 and round(got[2].jaro_winkler, 6) == 0.813333
    assert got[3].jaro is None and got[5].jaro_winkler is None and got[4].jaro == 1.0
    XT.register_python("LengthsZero", ["a", "b"], lambda s, t: [[len(x) for x in s.to_pylist()], [len(x) for x in t.to_pylist()]], nulls="zero")
    XT.register_python("Missing", ["m"], lambda s: [[float(x is None) for x in s.to_pylist()]], inputs=["s1"], nulls="pass")
    got = {r.k: (r.a, r.b, r.m) for r in XT.extract(pairs(spark), ["k"], ["LengthsZero", "Missing"]).collect()}
    assert got == {1: (6, 6, 0), 2: (5, 8, 0), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 0)}
    both = X.pair_features(pairs(spark), ["k"], ("Length", "Jaro")).columns
    assert both[-2:] == ["jaro", "jaro_winkler"] and X.REGISTRY["Jaro"].n_out == 2


def test_one_python_node_for_all_outputs(spark):
    plan = XT.extract(pairs(spark), ["k"], ["Jaro"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("two(") == 1 or plan.count("ArrowEvalPython [two") == 1


@pytest.mark.parametrize("function,message", [
    (lambda s, t: [np.zeros(len(s))], "declared are 2"), (lambda s, t: [np.zeros(len(s)), np.zeros(len(s) + 1)], "declared are 2"),
    (lambda s, t: [np.zeros(len(s)), np.full(len(s), np.nan)], "not finite in columns"), (lambda s, t: [np.full(len(s), np.inf), np.zeros(len(s))], "not finite")])
def test_wrong_width_and_values_that_are_not_finite_stop_the_job(spark, function, message):
    XT.register_python("Wrong", ["a", "b"], function)
    with pytest.raises(PythonException, match=message):
        XT.extract(pairs(spark), ["k"], ["Wrong"]).collect()
    assert XT.PythonExtractor("Wrong", ("a", "b"), function).batch(pa.array([], pa.string()), pa.array([], pa.string())).type.num_fields == 2


def test_extractor_declarations_are_checked(spark):
    for bad in (dict(outputs=()), dict(outputs=("a", "a")), dict(outputs=("a",), nulls="drop")):
        with pytest.raises(ValueError):
            XT.PythonExtractor("Bad", function=len, **bad)
    with pytest.raises(KeyError):
        XT.extract(pairs(spark), ["k"], ["Nobody"])


# ---------------------------------------------------------------- smat data source

def matrix(spark, n=500):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") / 7.0).alias("a"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(-1e-3 * F.col("id")).alias("b"),
                                 F.lit(0.0).alias("c")).repartition(5)


@pytest.mark.parametrize("sparse", [False, True])
def test_matrix_is_read_by_stretches(spark, tmp_path, sparse):
    path, want = f"{tmp_path}/m.smat", sorted(tuple(r) for r in matrix(spark).collect())
    SRC.write_matrix(matrix(spark), path, ["a", "b", "c"], sparse=sparse, stretch=900)
    got = SRC.read_matrix(spark, path, "m")
    assert got.columns == ["row_id", "m_0", "m_1", "m_2"] and got.rdd.getNumPartitions() > 8
    assert sorted(tuple(r) for r in got.collect()) == want
    some = SRC.read_matrix(spark, path, "m", [2, 0])
    assert some.columns == ["row_id", "m_2", "m_0"] and sorted((r.row_id, r.m_0) for r in some.collect()) == [r[:2] for r in want]
    # other readers see an ordinary text matrix
    cells = {(r.row_id, r.col): r.value for r in SMT.read_smat(spark, path).collect()}
    assert {k: v for k, v in cells.items() if v} == {(r[0], c): v for r in want for c, v in enumerate(r[1:]) if v}
    assert SRC.has_layout(spark, path) and not SRC.has_layout(spark, str(tmp_path))


def test_matrix_faults_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="not finite"):
        SRC.write_matrix(matrix(spark).withColumn("b", F.lit(float("nan"))), f"{tmp_path}/nan", ["a", "b"])
    assert not SRC.has_layout(spark, f"{tmp_path}/nan")
    with pytest.raises(Exception, match="in order|go up by one"):
        SRC.write_matrix(matrix(spark).filter("row_id != 77"), f"{tmp_path}/gap", ["a"])
    SRC.write_matrix(matrix(spark), f"{tmp_path}/ok", ["a"])
    (tmp_path / "ok" / "part-00000.txt").write_text("501 1\n")
    (tmp_path / "ok" / ".part-00000.txt.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="header does not match"):
        SRC.read_matrix(spark, f"{tmp_path}/ok", "m").collect()
    SRC.write_matrix(matrix(spark, 0), f"{tmp_path}/none", ["a"])
    assert SRC.read_matrix(spark, f"{tmp_path}/none", "m").count() == 0


# ---------------------------------------------------------------- feature store

def test_stacking_needs_no_exchange_and_checks_rows(spark, tmp_path):
    base = spark.range(1000).select(F.col("id").alias("conv_id"), (F.col("id") % 5).alias("turn"))
    store = FeatureStore(spark, str(tmp_path), ["conv_id", "turn"], 4)
    for i in range(5):
        store.put(f"f{i}", base.select("*", (F.col("conv_id") * i).alias(f"x{i}")))
    out = store.stack([(f"f{i}", "") for i in range(5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4
    assert out.count() == 1000 and out.filter("x4 != 4 * conv_id").count() == 0
    store.put("short", base.filter("conv_id != 3").withColumn("y", F.lit(1)))
    with pytest.raises(Exception, match="rows without a partner"):
        store.stack([("f0", ""), ("short", "")]).collect()
    with pytest.raises(FileNotFoundError):
        store.stack([("nobody", "")])


def test_an_entry_belongs_to_its_input(spark, tmp_path):
    one, two = spark.range(10).withColumnRenamed("id", "k"), spark.range(11).withColumnRenamed("id", "k")
    assert identity(one) == identity(one.repartition(3)) != identity(two) and identity(one.withColumnRenamed("k", "j")) != identity(one)
    store, built = FeatureStore(spark, str(tmp_path), ["k"], 2), []

    def build(df):
        built.append(1)
        return df.withColumn("f", F.col("k") * 2)

    for df in (one, one, two, one):
        assert store.get("f", identity(df), lambda: build(df)).count() == df.count()
    assert len(built) == 2  # changed data is made anew, the same is read


# ---------------------------------------------------------------- rank selection

@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_quantiles_of_one_large_group_with_ties(spark, buckets):
    rng = random.Random(buckets)
    values = [rng.choice([0.0, 1.0, 1.0, -5.5, rng.random(), rng.random() * 1e9, -1e-300]) for _ in range(400)]
    rows = [("hot", v) for v in values] + [("one", 3.25), ("same", 2.0), ("same", 2.0), ("none", None), (None, 4.0), (None, 6.0)]
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: tuple(r)[1:] for r in ST.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", shares, ["g"], buckets=buckets).collect()}
    assert np.allclose(got["hot"], np.quantile(values, shares), rtol=1e-12, atol=0)
    assert got["one"] == (3.25,) * 5 and got["same"] == (2.0,) * 5 and got[None][2] == 5.0 and "none" not in got


def test_quantiles_of_odd_values_and_all_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(x,) for x in (inf, -inf, nan, 1.0, 2.0, 1.7e308, -1.7e308, 5e-324, 0.0)], "x double")
    got = ST.exact_quantiles(rows, "x", [i / 8 for i in range(9)]).first()
    assert tuple(got)[:8] == (-inf, -1.7e308, 0.0, 5e-324, 1.0, 2.0, 1.7e308, inf) and np.isnan(got[8])
    assert ST.exact_quantiles(rows.limit(0), "x", [0.5], None).count() == 0
    both = ST.aggregate(spark.createDataFrame([("a", [1.0, 4.0, 10.0]), ("b", None)], "g string, v array<double>"), "v", ["size", "median"], by=["g"])
    assert {tuple(r) for r in both.collect()} == {("a", 3, 4.0)}
    assert ST.aggregate(rows.filter("x > 0 and x < 10"), "x", "median", exact_median=False).columns == ["x_median"]


# ---------------------------------------------------------------- previous row, blocks of dimensions

def test_previous_row_for_random_ids_needs_few_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.getrandbits(63) - (1 << 62)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long")
    want, last = {}, {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        want[g, k], last[g] = last.get(g), k
    assert {(r.g, r.k): r.prev for r in N.previous_in_group(df, "g", "k", partitions=9).collect()} == want
    ranged = N.range_sorted(df, ["g", "k"], 9)
    assert N.handed_on(ranged, "g", "k").count() <= 9 + 3
    assert max(r["count"] for r in ranged.groupBy("part").count().collect()) < 700  # the hot group is cut


def test_blocked_products_are_plain_dot_products(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 37)), rng.normal(size=(20, 37))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, None), (98, [])], "id long, v array<double>")
    right = spark.createDataFrame([(i, d, float(x)) for i, v in enumerate(b) for d, x in enumerate(v) if d % 5], "id long, d int, x double")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)] + [(99, 0), (0, 77)], "p long, q long")
    one, two = I.blocks(left, "id", "v", 8), I.blocks_from_cells(right, "id", "d", "x", 8)
    assert one.filter("size(values) > 8").count() == 0 and two.filter("size(values) != 8").count() == 0
    got = {(r.p, r.q): r.dot for r in I.blocked_dots(pairs, one, two, "p", "q", "id").collect()}
    b[:, ::5] = 0
    assert len(got) == 402 and got[99, 0] == got[0, 77] == 0.0
    assert all(abs(got[i, j] - a[i] @ b[j]) < 1e-9 for i in range(20) for j in range(20))
