"""Column expressions: docstring examples and hand values."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from twinmark.functions import distance as D
from twinmark.functions import grams as G
from twinmark.functions import pyhelpers as H
from twinmark.functions import text as T
from twinmark.functions.snowball_es import stem
from twinmark.operators import features as X


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("r")).first()["r"]


def test_p1_paired_punctuation(spark):
    assert one(spark, T.strip_punct_paired("s"), [("¿[a]?b¿!c",)], "s string") == "a]?bc"


def test_p2_all_punctuation_keeps_backslash(spark):
    assert one(spark, T.strip_punct_all("s"), [("¡Hola!, ¿qué\\tal?",)], "s string") == "Hola qué\\tal"


def test_tokens_and_strip(spark):
    assert one(spark, T.tokens_ws("s"), [(" a  b\tc\n",)], "s string") == ["a", "b", "c"]
    assert one(spark, T.tokens_word("s"), [("no, ¡nunca!",)], "s string") == ["no", ",", "¡", "nunca", "!"]
    assert one(spark, T.as_text("s"), [("  x y \n",)], "s string") == "x y"


def test_content_words_keeps_original_when_too_few(spark):
    toks = ["de", "la", "casa"]
    assert one(spark, T.content_words(F.array(*[F.lit(t) for t in toks])), [(1,)], "x int") == toks
    longer = ["de", "la", "casa", "verde", "grande"]
    assert one(spark, T.content_words(F.array(*[F.lit(t) for t in longer])), [(1,)], "x int") == ["casa", "verde", "grande"]


def test_ngram_docstrings(spark):
    w = F.array(F.lit("I"), F.lit("am"), F.lit("Denny"))
    assert one(spark, G.bigrams(w, "_"), [(1,)], "x int") == ["I_am", "am_Denny"]
    assert one(spark, G.trigrams(w, "_"), [(1,)], "x int") == ["I_am_Denny"]
    w4 = F.array(*[F.lit(x) for x in ["I", "am", "Denny", "boy"]])
    assert one(spark, G.biterms(w4, "_"), [(1,)], "x int") == ["I_am", "I_Denny", "I_boy", "am_Denny", "am_boy", "Denny_boy"]
    assert one(spark, G.triterms(w4, "_"), [(1,)], "x int") == ["I_am_Denny", "I_am_boy", "I_Denny_boy", "am_Denny_boy"]
    w5 = F.array(*[F.lit(x) for x in ["I", "am", "Denny", "boy", "ha"]])
    assert one(spark, G.fourterms(w5, "_"), [(1,)], "x int") == [
        "I_am_Denny_boy", "I_am_Denny_ha", "I_am_boy_ha", "I_Denny_boy_ha", "am_Denny_boy_ha"]
    assert one(spark, G.fourgrams(w4, "_"), [(1,)], "x int") == ["I_am_Denny_boy"]
    w1 = F.array(F.lit("solo"))
    assert one(spark, G.ngrams(w1, 3), [(1,)], "x int") == ["solo"]
    assert one(spark, G.ngrams(w, 12, "_"), [(1,)], "x int") == ["I", "am", "Denny", "I_am", "am_Denny"]
    assert one(spark, G.ngrams(w, 123, "_"), [(1,)], "x int") == ["I", "am", "Denny", "I_am", "am_Denny", "I_am_Denny"]
    assert one(spark, G.bigrams(w, "_", skip=1), [(1,)], "x int") == ["I_am", "I_Denny", "am_Denny"]


def _skip_grams(words, n, skip):
    """From the definition: all n places in order whose neighbours are at most skip + 1 apart; too few words fall back."""
    n = min(n, max(len(words), 1))
    places = [p for p in combinations(range(len(words)), n) if all(y - x <= skip + 1 for x, y in zip(p, p[1:]))]
    return ["_".join(words[i] for i in p) for p in places]


def test_skip_grams_match_their_definition(spark):
    rnd = random.Random(7)
    rows = [([rnd.choice("abcde") for _ in range(rnd.randint(0, 7))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "w array<string>")
    got = df.select("w", G.bigrams("w", "_", 2).alias("b"), G.trigrams("w", "_", 1).alias("t")).collect()
    for r in got:
        assert r["b"] == _skip_grams(r["w"], 2, 2)
        assert r["t"] == _skip_grams(r["w"], 3, 1)


def test_distances_hand_values(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("é", "e")], "a string, b string")
    got = df.select(F.levenshtein("a", "b").alias("l"), D.edit_dist("a", "b").alias("d")).collect()
    assert got[0]["l"] == 3 and abs(got[0]["d"] - 3 / 7) < 1e-15
    assert got[1]["d"] == 0.0
    assert got[2]["l"] == 1  # characters, not bytes
    s = spark.createDataFrame([(["a", "b", "b"], ["b", "c"])], "a array<string>, b array<string>")
    r = s.select(D.jaccard("a", "b").alias("j"), D.dice("a", "b").alias("d")).first()
    assert r["j"] == 1 / 3 and r["d"] == 2 * 1 / 4
    e = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    assert e.select(D.jaccard("a", "b")).first()[0] == 0.0
    assert one(spark, D.int_to_binary("x"), [(0,)], "x long") == ""
    assert one(spark, D.int_to_binary("x"), [(5,)], "x long") == "101"
    assert one(spark, D.count_one_bits("x"), [(7,)], "x long") == 3


def test_lcs_forms_agree(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))],
             [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]) for _ in range(60)]
    rows += [(["x", "a"], ["a", "x"]), (["a"], ["a", "a"]), ([], ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    from twinmark.functions.arrow_udfs import lcs_len_udf
    got = df.select("a", "b", X.lcs_length("a", "b").alias("hof"), lcs_len_udf("a", "b").alias("arrow")).collect()

    def textbook(a, b):
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        return dp[-1][-1]

    for r in got:
        assert r["hof"] == r["arrow"] == textbook(r["a"], r["b"])
    assert H.lcs_len(["x", "a"], ["a", "x"]) == 1
    assert H.lcs_len(["a"], ["a", "a"]) == 1


def test_longest_match():
    assert H.longest_match_size("ab cd", "ab cd") == 3
    assert H.longest_match_ratio("", "abc") == 0.0


def test_fuzzy_ratios():
    assert H.partial_ratio("abc", "abc") == 100
    assert H.partial_ratio("", "abc") == 0 and H.partial_ratio("", "") == 0
    assert H.partial_token_set_ratio([], []) == H.partial_token_sort_ratio(["!!"], ["?"]) == 0
    assert H.partial_token_set_ratio(["casa", "roja"], ["casa", "azul"]) == 100
    assert H.partial_token_set_ratio([], ["x"]) == 0
    assert 0 <= H.partial_token_sort_ratio(["perro"], ["gato"]) <= 100
    # accented letters in U+0080..U+00FF vanish, punctuation splits
    assert H.clean_token("qué.tal") == ["qu", "tal"]


def test_snowball_spanish():
    assert stem("nunca") == "nunc"
    assert stem("haciéndola") == "hac"
    assert stem("naciones") == "nacion"
    assert stem("rápidamente") == "rapid"
    assert stem("no") == "no"


def test_math(spark):
    r = spark.createDataFrame([(0.0, 0.0)], "p double, y double").select(
        D.cut_prob("p").alias("c"), D.logit("p").alias("l"), D.logistic("y").alias("g"),
        D.try_divide(F.lit(1), F.lit(0)).alias("t")).first()
    assert r["c"] == 1e-15 and r["g"] == 0.5 and r["t"] == 0.0
