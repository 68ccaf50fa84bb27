"""Jobs that count and look up in their rows: the same results, no row per word or vector in a shuffle."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinmark.functions import arrow_udfs as U
from twinmark.functions import pyhelpers as H
from twinmark.functions import text as T
from twinmark.operators import corpus as C
from twinmark.operators import features as X
from twinmark.operators import interact as I
from twinmark.operators import matching as M
from twinmark.plans import q_features as Q
from twinmark.sources import pairs as P


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bags_leave_no_row_per_word(spark, monkeypatch):
    """rare words meet their idf by a join, to the same sums; a repeated key adds its words."""
    rows = [(1, "a b b c", "b d"), (2, "a", "z z q"), (2, "x", "z"), (3, "", None)]
    pairs = spark.createDataFrame(rows, "k int, s1 string, s2 string")
    whole = X.bag_features(pairs, ["k"])
    assert "Generate" not in plan(whole)
    want = {r.k: r for r in whole.collect()}
    monkeypatch.setattr(X, "COMMON_WORDS", 2)
    got = {r.k: r for r in X.bag_features(pairs, ["k"]).collect()}
    assert got.keys() == want.keys() == {1, 2, 3}
    assert all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in whole.columns)
    assert want[1].word_match_share == 0.6 and want[3].word_match_share == 0.0
    assert want[1].tfidf_sum2 == pytest.approx(math.log2(4 / 4) + math.log2(4 / 2))


def test_pair_features_read_texts_once(spark):
    pairs = spark.createDataFrame([(1, "no a b", "a b c", 1), (1, "d", "d", 0), (None, "a", "a", 1)], "k int, s1 string, s2 string, label int")
    got = X.pair_features(pairs, ["k"], ("Not", "WordMatchShare", "NgramJaccardCoef"))
    assert "Join" not in plan(got)
    rows = sorted(got.collect(), key=lambda r: (r.k is None, -r.label))
    assert [r.word_match_share for r in rows] == [pytest.approx(4 / 5)] * 2 + [None]
    assert [r.ngram_jaccard_2 for r in rows] == [pytest.approx(1 / 3), 1.0, 1.0] and rows[0].not_cnt1 == 1


def test_words_are_counted_by_weight(spark):
    rows = spark.createDataFrame([("a b\ta", 2), ("b", 3), ("", 1)], "t string, w int")
    assert {(r.word, r.n) for r in U.count_words(rows).collect()} == {("a", 4), ("b", 5)}


def test_interactions_shuffle_ids_only(spark):
    """Vectors are looked up behind the shuffle; sums and alignments as by hand."""
    emb = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "idx int, vec array<float>")
    seqs = spark.createDataFrame([(7, 1, [1, 2]), (7, 2, [2]), (8, 1, []), (8, 2, [1])], "p int, side int, ids array<int>")
    sides = I.side_vectors(seqs, ["p"], emb)
    assert "Join" not in plan(sides)
    by = {r.p: r for r in sides.collect()}
    assert by[7].v1 == [[1.0, 0.0], [0.0, 2.0]] and by[7].k1 == [1.0, 2.0] and by[8].v1 == [] and by[8].v2 == [[1.0, 0.0]]
    aligned = {(r.p, r.side, r.pos): r.aligned for r in I.matrix_align(I.score_matrix(sides, ["p"]), ["p"]).collect()}
    low, high = 1 / (1 + math.exp(4)), math.exp(4) / (1 + math.exp(4))
    assert aligned.keys() == {(7, 1, 0), (7, 1, 1), (7, 2, 0)}
    assert aligned[7, 1, 0] == [0.0, 2.0] and aligned[7, 2, 0] == pytest.approx([low, 2 * high])
    tv = I.token_vectors(seqs, ["p"], emb, padded=True, maxlen=3)
    sv = I.sentence_vectors(tv, ["p"])
    assert "Generate" not in plan(sv)
    got = {(r.p, r.side): (r.mean, r.max, r.sum) for r in sv.collect()}
    assert got[7, 1] == (pytest.approx([1 / 3, 2 / 3]), [1.0, 2.0], [1.0, 2.0]) and got[8, 1] == ([0.0, 0.0], [0.0, 0.0], [0.0, 0.0])
    pv = {r.p: r.abs_diff for r in I.pair_vectors(sv, ["p"]).collect()}
    assert pv[7] == pytest.approx([1 / 3, 0.0]) and pv.keys() == {7, 8}


def test_document_sequences_look_words_up_in_their_row(spark):
    """no row per word; a repeated document adds its words by place."""
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 30000)], "word string, idx long")
    tokens = spark.createDataFrame([(1, ["b", "x", "a", "c"]), (2, []), (3, ["a", "b"]), (3, ["b", "b"])], "d int, toks array<string>")
    seqs = C.document_sequences(tokens, "d", vocab)
    assert "Generate" not in plan(seqs)
    assert {r.d: r.ids for r in seqs.collect()} == {1: [2, 1], 2: [], 3: [1, 2, 2, 2]}


def test_sentences_of_a_pair_stay_in_its_row(spark):
    """one grouping by pair and no shuffle behind it; the same sums as side by side."""
    emb = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-3.0, 2.0])], "idx int, vec array<float>")
    seqs = spark.createDataFrame([(7, 1, [1, 2]), (7, 2, [2]), (8, 1, []), (8, 2, [1]), (9, 1, [1])], "p int, side int, ids array<int>")
    wide = I.pair_vectors(I.sentence_sides(I.side_vectors(seqs, ["p"], emb, maxlen=3, padded=True), ["p"]), ["p"])
    assert plan(wide).count("Aggregate") == 1 and "Join" not in plan(wide) and "Generate" not in plan(wide)
    sv = I.sentence_vectors(I.token_vectors(seqs, ["p"], emb, padded=True, maxlen=3), ["p"])
    by_side = {(r.p, r.side): (r.mean, r.max, r.sum) for r in sv.collect()}
    by_pair = {r.p: (r.abs_diff, r.product, r.concat) for r in I.pair_vectors(sv, ["p"]).collect()}
    got = wide.collect()
    assert {r.p for r in got} == by_pair.keys() == {7, 8}
    assert all((r[f"s{i}"].mean, r[f"s{i}"].max, r[f"s{i}"].sum) == by_side[r.p, i] for r in got for i in (1, 2))
    assert {r.p: (r.abs_diff, r.product, r.concat) for r in got} == by_pair


def test_only_the_last_ids_are_shuffled(spark):
    """A document's row holds no more than its last ids before the shuffle; repeated documents add up by place."""
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, idx long")
    tokens = spark.createDataFrame([(1, ["b", "x", "a", "c"]), (2, []), (3, ["a", "b", "c"]), (3, ["b", "b"]), (4, ["c"])], "d int, toks array<string>")
    whole = {r.d: r.ids for r in C.document_sequences(tokens, "d", vocab).collect()}
    assert {r.d: r.ids for r in C.document_sequences(tokens, "d", vocab, last=2).collect()} == {d: ids[-2:] for d, ids in whole.items()}
    look = U.word_ids_udf(spark.sparkContext.broadcast({"a": [1], "b": [2], "c": [3]}), 2)
    assert {tuple(r.s.ids) for r in tokens.select(look(F.array_join("toks", " ")).alias("s")).collect()} == {(1, 3), (), (2, 3), (2, 2), (3,)}


def test_score_matrices_are_made_without_python_lists(spark):
    """A batch's vectors are one matrix; empty sides, missing components and several batches as before."""
    rows = spark.createDataFrame([(1, [[1.0, 2.0]], [[3.0, 0.5], [0.0, 1.0]]), (2, [], [[1.0, 1.0]]), (3, [[1.0, 1.0], [2.0, 0.0]], []), (4, [[1.0, None]], [[1.0, 1.0]])],
                                 "k int, v1 array<array<float>>, v2 array<array<float>>")
    got = {r.k: r.m for r in I.score_matrix(rows, ["k"]).collect()}
    assert got[1] == [[4.0, 2.0]] and got[2] == [] and got[3] == [[], []] and math.isnan(got[4][0][0])
    assert not any(type(x) is list for x in U._matrices(pa.array([[[1.0, 2.0]], []], pa.list_(pa.list_(pa.float32())))))


def test_pair_features_count_words_in_batches(spark):
    """words are counted and texts stripped without a regular expression over each blank; n-grams are compared as numbers."""
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = [blanks + "no A\x1cb" + blanks, "\u200bx\u2003y\n\n", "", blanks, "a" + " " * 1000 + "a b", "b a", None]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))], "k int, s1 string, s2 string")
    assert [r.x for r in pairs.orderBy("k").select(T.as_text("s1").alias("x")).collect()] == [x if x is None else x.strip() for x in texts]
    got = X.pair_features(pairs, ["k"], ("WordMatchShare", "Length", "NgramJaccardCoef"))
    assert "regexp_replace" not in plan(got) and "translate" not in plan(got)
    rows = {r.k: r for r in got.collect()}
    want = {r.k: r for r in X.tokenise(pairs, ["k"]).select("k", "wt1", "wt2", *X.length_columns()).collect()}
    assert rows.keys() == want.keys() == set(range(len(texts)))
    for k, w in want.items():
        assert all(rows[k][c] == w[c] for c in w.asDict() if c.startswith("len_"))
        assert [rows[k][f"ngram_jaccard_{n}"] for n in (1, 2, 3)] == [H.ngram_jaccard(w.wt1, w.wt2, n) for n in (1, 2, 3)]


@pytest.mark.parametrize("orders", [(1, 2, 3), (3,), (2, 40)])
def test_ngram_numbers_give_the_same_jaccard(orders):
    """over several slices of a batch, empty and short lists, and n-grams too long for a number."""
    r = random.Random(5)
    rows = [[" ".join(r.choices("abcdef", k=r.choice((0, 1, 2, 3, 30)))) for _ in range(2)] for _ in range(2 * U.GRAM_ROWS + 7)] + [[None, "a"], ["a b", None]]
    got = U.ngram_jaccard_udf(orders).func(*[pa.array(side) for side in zip(*rows)]).to_pylist()
    assert got == [[H.ngram_jaccard(H.tokens_of(a), H.tokens_of(b), n) for n in orders] for a, b in rows]
    assert H.ngram_jaccard_ids(np.array([0, 1]), np.array([0, 1]), 2, 3) == 1.0


def _pairs_of_ids(spark, n):
    """Sequences of ``n`` pairs, some with an empty side, an unknown id or a side that comes twice, and an embedding table."""
    r = random.Random(3)
    rows = [(p, side, r.choices(range(1, 9), k=r.choice((0, 1, 3, 6)))) for p in range(n) for side in (1, 2)] + [(0, 1, [2, 3]), (n, 1, [1])]
    emb = spark.createDataFrame([(i, [float(i), 1.0 - i, i * i / 7]) for i in range(8)], "idx int, vec array<float>")
    return spark.createDataFrame(rows, "p int, side int, ids array<int>").coalesce(1), emb


def _by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_alignments_are_made_from_ids_in_slices(spark):
    """one pass of Python that gets ids; results leave it a slice at a time; the same rows as from vectors in columns."""
    seqs, emb = _pairs_of_ids(spark, 2 * U.PAIR_ROWS + 5)
    sides = I.side_vectors(seqs, ["p"], emb, maxlen=6)
    got = I.matrix_align(I.score_matrix(sides, ["p"]), ["p"])
    assert plan(got).count("ArrowEvalPython") == 1
    held = spark.createDataFrame(sides.select("p", "v1", "v2").collect(), "p int, v1 array<array<float>>, v2 array<array<float>>")
    want = _by_key(I.matrix_align(I.score_matrix(held, ["p"]), ["p"]), "p", "side", "pos")
    rows = _by_key(got, "p", "side", "pos")
    assert rows.keys() == want.keys() and len(rows) > U.PAIR_ROWS
    assert all(rows[k].aligned == pytest.approx(want[k].aligned) for k in want)
    look = U.looked_up(spark.sparkContext.broadcast(([1], pa.array([[1.0]], pa.list_(pa.float32())), pa.array([1.0]))))
    made = []
    column = U.sliced_udf("int", lambda one: made.append(len(one)) or pa.array([len(x) for x in look(one)[0]], pa.int32()))
    ids = spark.createDataFrame([([[1, 1]],)], "i array<array<int>>")
    assert ids.select(column("i").alias("n")).first().n == 2


def test_scores_of_ids_are_made_in_one_pass(spark):
    """matrices, their largest cells and their pooling from ids; vectors do not go through Spark."""
    seqs, emb = _pairs_of_ids(spark, 2 * U.PAIR_ROWS + 5)
    sides = I.side_vectors(seqs, ["p"], emb, maxlen=6)
    held = I.score_matrix(spark.createDataFrame(sides.select("p", "v1", "v2", "k1", "k2").collect(), "p int, v1 array<array<float>>, v2 array<array<float>>, k1 array<double>, k2 array<double>"), ["p"])
    rows = I.score_matrix(sides, ["p"])
    for of, keys in ((lambda x: x.select("p", "m", "k1", "k2"), ("p",)), (lambda x: I.matrix_topk(x, ["p"], 5, 6), ("p",)), (lambda x: I.matrix_pool(x, ["p"], 3, 3, 6), ("p", "bi", "bj"))):
        got, want = of(rows), _by_key(of(held), *keys)
        assert plan(got).count("ArrowEvalPython") == 1
        assert {k: r.asDict() for k, r in _by_key(got, *keys).items()} == {k: r.asDict() for k, r in want.items()}


def test_sentences_and_cell_sums_of_ids_are_made_in_one_pass(spark):
    """as from vectors in columns; pairs with an empty side are left out."""
    seqs, emb = _pairs_of_ids(spark, 2 * U.PAIR_ROWS + 5)
    sides = I.side_vectors(seqs, ["p"], emb, maxlen=6)
    held = spark.createDataFrame(sides.select("p", "v1", "v2").collect(), "p int, v1 array<array<float>>, v2 array<array<float>>")
    whole = {r.p for r in held.collect() if r.v1 and r.v2}
    for of in (I.sentence_sides, I.elementwise_sums):
        got, want = of(sides, ["p"]), _by_key(of(held, ["p"]), "p")
        assert plan(got).count("ArrowEvalPython") == 1
        rows = _by_key(got, "p")
        assert rows == want and {k for k, in rows} == whole and 0 < len(whole) < 2 * U.PAIR_ROWS + 5
    p, r = next((k, r) for (k,), r in _by_key(I.elementwise_sums(sides, ["p"]), "p").items())
    one, two = next((np.array(h.v1), np.array(h.v2)) for h in held.collect() if h.p == p)
    assert r["mul"] == pytest.approx(sum(float(x @ y) for x in one for y in two)) and r["concat"] == len(one) * len(two) * 6


def test_signatures_are_the_least_hashes(spark):
    """signatures are made in numpy, with the values of xxhash64."""
    r = random.Random(2)
    rows = [(k, [r.getrandbits(64) - 2 ** 63 for _ in range(n)]) for k, n in enumerate((1, 2, 40, 0, 300))]
    sets = spark.createDataFrame([*rows, (9, None)], "k int, h array<long>")
    got = {x.k: x.s for x in sets.select("k", M.minhash("h", 7).alias("s")).collect()}
    least = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.array_min(F.transform("h", lambda x: F.xxhash64(x, i))))
    assert {k: s for k, s in got.items() if s} == {x.k: x.s for x in sets.where("size(h) > 0").select("k", least.alias("s")).collect()}
    assert not got[3] and not got[9]


def test_prefixes_are_taken_in_their_row(spark):
    """no row per gram is shuffled by key; frequent grams come last; texts of candidates move, not grams; the same pairs as by all grams."""
    r = random.Random(4)
    texts = []
    for _ in range(40):
        words = r.choices([f"w{i}" for i in range(300)], k=40)
        texts += [" ".join(words), " ".join(words[:-1]) + "  X", " ".join(words[: r.randint(1, 40)])]
    texts += ["", None, "one", "One two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = M.with_word_trigrams(docs.withColumn("t", F.col("text")), "text")
    some = spark.createDataFrame([(i,) for i in range(0, len(texts), 2)], "id long")
    grams = {x.id: set(x.g) for x in sets.collect() if x.g}
    want = {(a, b): len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    for kept, among in ((want, None), ({p: s for p, s in want.items() if not (p[0] % 2 or p[1] % 2)}, some)):
        for join in (M.jaccard_self_join, M.jaccard_minhash_join):
            for text in (None, "t"):
                got = {(x.id_a, x.id_b): x.jaccard for x in join(sets, "id", "g", 0.8, text=text, among=among).collect()}
                assert got == pytest.approx(kept) and len(got) >= 5
    hashed = M._hashed(sets, "id", "g")
    pre = M._bucket_prefix(hashed, "id", F.lit(2))
    assert "Aggregate" not in plan(pre) and "Join" not in plan(pre)
    common = spark.createDataFrame([(i, [f"x{i}", "all", f"y{i}"]) for i in range(50)], "id long, g array<string>")
    first = M._bucket_prefix(M._hashed(common, "id", "g"), "id", F.lit(2)).where(F.col("gram") == F.xxhash64(F.lit("all")))
    assert first.count() == 0


def test_the_idf_of_document_pairs_needs_no_pairs(spark, tmp_path):
    """F8: the same idf as from the pairs' texts, with copies, absent texts, repeated documents and labels; a text is shuffled once."""
    docs = [(1, "a b", "x"), (2, "a c c", "x"), (3, "a b", "x"), (3, "d", "x"), (4, None, "x"), (5, "", "y"), (6, "Lone", "z"), (7, "e a", "y"), (2, "a c c", "x"), (None, "gone", "x"), (8, "u", None), (9, "u v", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    pairs, idf = Q.split_pairs_and_idf(spark, str(tmp_path))
    want = {r.word: r.idf for r in X.corpus_idf(pairs).collect()}
    assert {r.word: r.idf for r in idf.collect()} == want and "u" in want and "lone" not in want and "gone" not in want
    links = P.with_labels(P.doc_links(spark, str(tmp_path)), spark, str(tmp_path))
    text = P.linked_sentences(links, spark, str(tmp_path))[0]._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "text" in line for line in text.splitlines()) == 0
    assert plan(P.linked_sentences(links, spark, str(tmp_path))[0]).count("Join LeftSemi") == 2


def test_texts_stay_where_they_are_when_rare_words_come_back(spark, monkeypatch):
    """F8: the sums of rare words meet a pair's row without a shuffle of its texts; a row without a key has no bag, as before."""
    monkeypatch.setattr(X, "COMMON_WORDS", 2)
    rows = [(1, "a b b c", "b d"), (2, "a", "z z q"), (2, "x", "z"), (3, "", None), (None, "a y", "y")]
    pairs = spark.createDataFrame(rows, "k int, s1 string, s2 string").repartition(3, "k")
    got = X.pair_features(pairs, ["k"], ("WordMatchShare", "TFIDFSpanish"))
    assert "<=>" not in plan(got)
    want = {r.k: r for r in X.bag_features(pairs, ["k"]).collect()}
    found = got.collect()
    assert len(found) == 5 and all(r[c] == (None if r.k is None else pytest.approx(want[r.k][c])) for r in found for c in got.columns if c != "k")
