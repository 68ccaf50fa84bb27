"""Distributed operators against brute force on small fixtures."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinmark.operators import corpus as C
from twinmark.operators import interact as I
from twinmark.operators import matching as M
from twinmark.operators import neighbors as N
from twinmark.operators import sampling as SM
from twinmark.operators import stats as ST


def test_previous_in_group_matches_lag(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c"]), i) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r.g, r.k): r.prev for r in N.previous_in_group(df, "g", "k", partitions=7).collect()}
    ref = {(r.g, r.k): r.prev for r in df.withColumn("prev", F.lag("k").over(Window.partitionBy("g").orderBy("k"))).collect()}
    assert got == ref


def test_first_by_hash_is_exact(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    for m in (0, 1, 77, 300):
        got = sorted(r.doc_id for r in SM.first_by_hash(df, "doc_id", m, seed=0, prefix_chars=1).collect())
        import hashlib
        ref = sorted(sorted(range(300), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))[:m])
        assert got == ref


def test_balance(spark):
    df = spark.createDataFrame([(i, 1 if i < 80 else 0) for i in range(100)], "doc_id long, label int")
    out = SM.balance(df, "doc_id", "label", 0.5)
    c = out.groupBy("label").count().collect()
    d = {r.label: r["count"] for r in c}
    assert d[1] == 80 and d[0] == 80  # k = 4: four full copies of the 20 negatives
    one_class = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, label int")
    assert SM.balance(one_class, "doc_id", "label", 0.5).count() == 5


def test_dense_ids(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2)
    ids = df.orderBy("id").transform(lambda d: SM.dense_ids(d, "row_id")).collect()
    assert sorted(r.row_id for r in ids) == list(range(1000))
    assert all(r.row_id == r.id for r in ids)


def test_corr_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert df.agg(ST.corr_with_label("x", "y")).first()[0] == 0.0


def test_aggregate_modes_validation(spark):
    import pytest
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    with pytest.raises(ValueError):
        ST.aggregate(df, "v", ["mode"])
    r = ST.aggregate(df, "v", "MEDIAN").first()
    assert r[0] == 2.0


def test_rank_words(spark):
    words = ["b", "a", "b", "c", "a", "b", "d"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [(r.word, r.idx) for r in C.rank_words(df).orderBy("idx").collect()]
    assert got == [("b", 1), ("a", 2), ("c", 3), ("d", 4)]


def test_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (list(range(1, 41)),)], "ids array<int>")
    got = [r.p for r in df.select(C.pad("ids", 5).alias("p")).collect()]
    assert got == [[0, 0, 1, 2, 3], [0, 0, 0, 0, 0], [36, 37, 38, 39, 40]]


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_self_join_exact(spark):
    rnd = random.Random(5)
    strs = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(60)})
    df = spark.createDataFrame([(s,) for s in strs], "s string").select(F.col("s").alias("id"), "s")
    for t in (0.3, 0.6, 0.8):
        got = {(r.a, r.b) for r in M.fuzzy_self_join(df, "id", "s", t).collect()}
        ref = {(a, b) for a in strs for b in strs if a < b and 1 - _lev(a, b) / max(len(a), len(b)) >= t}
        assert got == ref


def test_fuzzy_candidates_are_few_on_random_strings(spark):
    rnd = random.Random(6)
    strs = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(8, 14))) for _ in range(1000)})
    df = spark.createDataFrame([(s,) for s in strs], "s string").select(F.col("s").alias("id"), "s")
    n = M.fuzzy_candidates(df, "id", "s", 0.7).count()
    assert n < 0.06 * len(strs) * (len(strs) - 1) / 2


def test_set_joins_lose_nothing_to_rounding(spark):
    rows = []
    for n in (100, 180, 200):
        base = [f"x{n}_{i}" for i in range(n)]
        share = round(n * 0.55)
        rows.append((n, base))
        rows.append((1000 + n, base[n - share:]))  # contained to exactly 0.55 and, as a set, similar to 0.55
    df = spark.createDataFrame(rows, "id long, g array<string>")
    got = {(r.id_a, r.id_b) for r in M.jaccard_self_join(df, "id", "g", 0.55).collect()}
    assert got == {(n, 1000 + n) for n in (100, 180, 200)}
    small = df.where("id < 1000").withColumnRenamed("id", "item")
    got = {(r.id, r.item) for r in M.containment_join(df.where("id > 1000"), "id", small, "item", "g", 0.55).collect()}
    assert got == {(1000 + n, n) for n in (100, 180, 200)}


def test_auc_ranks_the_scores_as_they_are(spark):
    rows = [(1, 0.5000001), (0, 0.5000002), (1, 0.5000003), (0, 0.5000004)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert ST.auc(df).first()[0] == 0.25
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 9) / 10 + rnd.choice([0, 1e-12])) for _ in range(300)] + [(1, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y and s is not None], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(ST.auc(df).first()[0] - want) < 1e-12


def test_strict_merge_stops_on_unequal_rows(spark):
    import pytest
    two, one = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_id long, a double"), spark.createDataFrame([(0, 3.0)], "row_id long, b double")
    with pytest.raises(Exception, match="rows without a partner"):
        SM.merge_cols(two, one, ["row_id"], strict=True).count()
    assert SM.merge_cols(two, two.withColumnRenamed("a", "b"), ["row_id"], strict=True).count() == 2


def test_embedding_table_has_the_last_row_of_a_binding_cap(spark):
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(1, 8)], "word string, idx long")
    vectors = spark.createDataFrame([(f"w{i}", [float(i)]) for i in range(1, 8)], "word string, vec array<float>")
    rows = {r.idx: list(r.vec) for r in C.embedding_table(vocab, vectors, 1, num_words=5).collect()}
    assert rows == {0: [0.0], **{i: [float(i)] for i in range(1, 6)}}


def test_odd_texts_lose_no_pair(spark):
    from twinmark.operators import features as X
    from twinmark.operators import udf_jobs as UJ
    rows = [(0, None, "a b"), (1, "", ""), (2, "¿?", "!!"), (3, None, None), (4, "a b", "a c b")]
    pairs = spark.createDataFrame(rows, "k long, s1 string, s2 string")
    assert {r.k: r.lcs_ratio for r in X.lcs_features(pairs, ["k"]).collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.4}
    assert {r.k: r.len_char1 for r in X.length_features(pairs, ["k"]).collect()}[0] == 0
    assert UJ.longest_match(pairs, ["k"]).count() == UJ.compression_distance(pairs, ["k"]).count() == 5
    fuzzy = {r.k: r.partial_token_sort_ratio for r in UJ.fuzzy_ratios(pairs, ["k"]).collect()}
    assert fuzzy[1] == fuzzy[2] == fuzzy[3] == 0 and len(fuzzy) == 5


def test_jaccard_self_join_exact(spark):
    rnd = random.Random(9)
    sets = [(i, sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))})) for i in range(80)]
    df = spark.createDataFrame(sets, "id long, g array<string>")
    got = {(r.id_a, r.id_b) for r in M.jaccard_self_join(df, "id", "g", 0.6).collect()}
    ref = set()
    for i, a in sets:
        for j, b in sets:
            if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6:
                ref.add((i, j))
    assert got == ref


def test_containment_join_exact(spark):
    rnd = random.Random(11)
    big = [(i, sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 8))})) for i in range(40)]
    small = [(j, sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 4))})) for j in range(15)]
    b = spark.createDataFrame(big, "doc long, g array<string>")
    s = spark.createDataFrame(small, "item long, g array<string>")
    got = {(r.doc, r.item) for r in M.containment_join(b, "doc", s, "item", "g", 0.5).collect()}
    ref = {(i, j) for i, x in big for j, y in small if len(set(x) & set(y)) / len(set(y)) >= 0.5}
    assert got == ref


def test_grid_max_pool_small(spark):
    # 2 x 3 real cells, grid 6 x 6, pooling 3 x 3 -> blocks of 2 x 2
    scores = spark.createDataFrame([(0, i, j, float(10 * i + j)) for i in range(2) for j in range(3)],
                                   "pair_id long, i int, j int, score double")
    lens = spark.createDataFrame([(0, 2, 3)], "pair_id long, n1 int, n2 int")
    got = {(r.bi, r.bj): r.pooled for r in I.grid_max_pool(scores, ["pair_id"], lens, 3, 3, maxlen=6).collect()}
    # row g reads int(g / 3), column g reads int(g / 2)
    ref = {}
    for bi in range(3):
        for bj in range(3):
            ref[(bi, bj)] = max(10 * int(g / 3.0) + int(h / 2.0) for g in (2 * bi, 2 * bi + 1) for h in (2 * bj, 2 * bj + 1))
    assert got == ref


def test_rank_by_hash_and_exact_folds(spark):
    import hashlib
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r["rank"] for r in SM.rank_by_hash(df, "doc_id", seed=7, prefix_chars=1).collect()}
    order = sorted(range(103), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert got == {d: r for r, d in enumerate(order)}
    folds = [r.fold for r in SM.kfold_exact(df, "doc_id", 5, 7).collect()]
    assert sorted({f: folds.count(f) for f in set(folds)}.values(), reverse=True) == [21, 21, 21, 20, 20]


def test_negation_stemmed_literal(spark):
    from twinmark.operators.udf_jobs import negation_stemmed
    pairs = spark.createDataFrame([(1, "No, nunca ni hablo", "nunca")], "k long, s1 string, s2 string")
    r = negation_stemmed(pairs, ["k"]).first()
    assert r.not_cnt1 == 2 and r.not_cnt2 == 0  # 'nunca' stems to 'nunc' (SURVEY Q2)


def test_matrix_pool_equals_the_cell_form(spark):
    m = [[float(10 * i + j) for j in range(3)] for i in range(2)]
    rows = spark.createDataFrame([(0, m, [[1.0]] * 2, [[1.0]] * 3), (1, [], [], [[1.0]])], "pair_id long, m array<array<double>>, v1 array<array<double>>, v2 array<array<double>>")
    got = {(r.pair_id, r.bi, r.bj): r.pooled for r in I.matrix_pool(rows, ["pair_id"], 3, 3, maxlen=6).collect()}
    for bi in range(3):
        for bj in range(3):
            assert got[0, bi, bj] == max(10 * int(g / 3.0) + int(h / 2.0) for g in (2 * bi, 2 * bi + 1) for h in (2 * bj, 2 * bj + 1))
            assert got[1, bi, bj] == 0.0
    # shrunk twice: a grid of 3 x 3 over 2 // 2 and 3 // 2 places reads the first cell alone
    half = I.matrix_pool(rows.where("pair_id = 0"), ["pair_id"], 3, 3, maxlen=6, compress_ratio=2).collect()
    assert [r.pooled for r in half] == [0.0] * 9


def test_document_vocabulary_equals_the_pair_form(spark):
    docs = spark.createDataFrame([(1, "casa roja casa"), (2, "perro casa azul"), (3, "gato perro perro")], "doc_id long, text string")
    links = spark.createDataFrame([(2, 1), (3, 2)], "pair_id long, prev_id long")
    texts = docs.select(F.col("doc_id").alias("d"), "text")
    pairs = links.join(texts.select(F.col("d").alias("prev_id"), F.col("text").alias("s1")), "prev_id").join(
        texts.select(F.col("d").alias("pair_id"), F.col("text").alias("s2")), "pair_id")
    vectors = spark.createDataFrame([("casa",), ("perro",), ("azul",)], "word string")
    sides = C.prepare_tokens(pairs, ["pair_id"], vectors)
    want = C.fit_vocabulary(sides)
    tokens = C.document_tokens(docs, "doc_id", "text")
    ends = links.select(F.explode(F.array("prev_id", "pair_id")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("w"))
    got = C.document_vocabulary(tokens, "doc_id", ends, vectors)
    key = lambda df: {(r.word, r.n, r.idx) for r in df.collect()}
    assert key(got) == key(want)
    ids = C.pair_sides(links, ["pair_id"], C.document_sequences(tokens, "doc_id", got), "doc_id")
    seq = lambda df: {(r.pair_id, r.side, tuple(r.ids)) for r in df.collect()}
    assert seq(ids) == seq(C.to_sequences(sides, ["pair_id"], want))
