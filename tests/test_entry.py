"""Driver contract and a few registered queries at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from twinmark.sources.tables import TABLES

from .conftest import SF

FAST = ["conv_pairs", "doc_pairs", "word_match_share", "negation", "ngram_jaccard", "lcs_ratio", "tfidf",
        "text_clean", "ngrams", "nterms", "string_distances", "kfold", "balance", "aggregate_modes",
        "fuzzy_part_names", "bench_contamination"]


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert "word_match_share" in s


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["conv_id", "turn", "word_match_share"]
    assert df.count() >= 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sdf.columns
    order = [rel.columns.index(c) for c in cols]
    srows = sorted((tuple(r) for r in sdf.collect()), key=repr)
    drows = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert srows == drows


SLOWER = ["pair_features_sql", "odd_text_features", "evaluate_scores", "fuzzy_part_labels", "embedding_table", "sequences", "dynamic_pooling", "smat_roundtrip", "stream_features", "near_duplicates"]


@pytest.mark.parametrize("name", SLOWER)
def test_more_queries_match_oracle(spark, con, name):
    test_query_matches_oracle(spark, con, name)


def test_pair_features_hold_the_longest_common_subsequence(spark):
    from twinmark.sources.pairs import split_doc_pairs

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = {r.pair_id: r.lcs_ratio for r in E.queries()["pair_features"](spark, SF).collect()}
    pairs = split_doc_pairs(spark, SF).collect()
    assert set(got) == {p.pair_id for p in pairs}
    for p in sorted(pairs, key=lambda p: len(p.s1) + len(p.s2))[:60]:
        a, b = p.s1.lower().split(), p.s2.lower().split()
        assert abs(got[p.pair_id] - plain(a, b) / max(1, len(a) + len(b))) < 1e-12


def test_rows_only_queries(spark):
    from pyspark.sql import functions as F
    q = E.queries()
    oof = q["oof_scores"](spark, SF)
    stats = oof.groupBy("split").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"),
                                     F.countDistinct("pair_id").alias("keys")).collect()
    for r in stats:
        assert r.n == r.keys and 0.0 <= r.lo <= r.hi <= 1.0  # one score per pair, a probability
    pairs = q["conv_pairs"](spark, SF)
    fr = q["fuzzy_ratios"](spark, SF)
    wm = q["word_match_share"](spark, SF)
    assert fr.count() == pairs.count()
    joined = fr.join(wm, ["conv_id", "turn"]).collect()
    for r in joined:
        assert 0 <= r.partial_token_set_ratio <= 100 and 0 <= r.partial_token_sort_ratio <= 100
    lm = q["longest_match"](spark, SF).collect()
    assert all(0.0 <= r.longest_match_ratio <= 1.0 for r in lm)
    cd = q["compression_distance"](spark, SF).collect()
    assert len(cd) == pairs.count() and all(r.compression_dist is not None for r in cd)
    st = q["stem_text"](spark, SF)
    assert st.count() == q["stopwords"](spark, SF).count()
