"""Suffix dedup, source divergence and collocations against plain versions, and on odd tables."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from twinmark.llm import collocations, divergence, suffix
from twinmark.llm.queries import QUERIES, SQL

from ..conftest import SF
from .fixtures import docs, empty

TEXT = "doc_id long, text string, lang string, source string"


def rows(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source) for i, t in enumerate(texts)], TEXT)


# ---------------------------------------------------------------- suffix-array dedup

def plain_dedup(table, keep, length):
    """(doc_id, kept bytes) of each row, from every string of ``length`` bytes."""
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0))
    places = defaultdict(list)
    for i, (_, t) in enumerate(order):
        for j in range(len(t) - length + 1):
            places[t[j:j + length]].append((i, j))
    out = []
    for i, (d, t) in enumerate(order):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            found = places[t[j:j + length]]
            if len(found) > 1 and (keep is None or found[0] != (i, j)):
                gone[j:j + length] = True
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def got_dedup(frame, keep, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup(frame, keep=keep, length=length).collect()), key=repr)


def passages(seed, n=160):
    """Texts with shared passages of all lengths, edited copies, repeats within a text, and runs of one letter."""
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [say(rng.randint(30, 300)) for _ in range(6)]
    out = []
    for i in range(n):
        t = "".join(rng.choice([say(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[:rng.randint(1, 200)]]) for _ in range(rng.randint(0, 5)))
        if i % 17 == 3:
            t += "z" * rng.randint(0, 150)
        if i % 5 == 0 and out:
            t = list(rng.choice(out)) + ["!"]
            t[rng.randrange(len(t))] = "?"
            t = "".join(t)
        out.append(t)
    return out


@pytest.mark.parametrize("keep", ["first", None])
@pytest.mark.parametrize("length", [40, 90])
def test_dedup_is_that_of_all_strings(spark, keep, length):
    texts = passages(length)
    assert got_dedup(rows(spark, texts).repartition(6), keep, length) == plain_dedup([(i, t.encode()) for i, t in enumerate(texts)], keep, length)


@pytest.mark.parametrize("keep", ["first", None])
def test_passages_of_any_share_are_counted_by_spark(spark, monkeypatch, keep):
    """Groups beyond a task's memory, and those at its edges, give the same rows."""
    monkeypatch.setattr(suffix, "HELD_ROWS", 5)
    monkeypatch.setattr(suffix, "HELD_CONTENTS", 3)
    texts = passages(7)
    assert got_dedup(rows(spark, texts).repartition(3), keep, 60) == plain_dedup([(i, t.encode()) for i, t in enumerate(texts)], keep, 60)


def test_long_texts_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 100)
    texts = ["".join(passages(11)), *passages(11)[:9], "".join(passages(11))[37:]]
    assert got_dedup(rows(spark, texts), None, 50) == plain_dedup([(i, t.encode()) for i, t in enumerate(texts)], None, 50)


def test_dedup_query_at_the_fixture(spark):
    table = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in plain_dedup(table, None, 200)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op11_suffix_dedup"](spark, SF).collect()} == want
    assert sum(v[1] for v in want.values()) > 0


def test_dedup_of_odd_and_empty_tables(spark):
    table = docs(spark)
    texts = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    for keep in ("first", None):
        got = {(r.doc_id, r.n_bytes): (r.n_removed, bytes(r.kept)) for r in suffix.dedup(table, keep=keep).collect()}
        assert len(suffix.dedup(table, keep=keep).collect()) == len(texts) and suffix.dedup(empty(spark), keep=keep).count() == 0
        assert all(got[d, len(t)] == (0, t) for d, t in texts if len(t) < 200)
    copy = ["x" * 10 + "".join(chr(97 + i * i % 23) for i in range(400)), "no copy"]
    twice = spark.createDataFrame([(i, copy[0]) for i in (3, 1, None, 2)] + [(9, copy[1])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed == r.n_bytes for r in suffix.dedup(twice).collect()} == {1: False, 2: True, 3: True, None: True, 9: False}
    same = spark.createDataFrame([(1, copy[0])] * 2, "doc_id long, text string")  # rows equal in id and text are one document
    assert [r.n_removed for r in suffix.dedup(same).collect()] == suffix.dedup(same.limit(1)).toPandas().n_removed.tolist() * 2
    assert all(r.n_removed == r.n_bytes for r in suffix.dedup(same, keep=None).collect())
    with pytest.raises(ValueError):
        suffix.dedup(table, keep="last")
    with pytest.raises(ValueError):
        suffix.dedup(table, length=10)


def test_suffix_order_and_factors():
    text = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    for length in (1, 3, 5, 8, 11):
        places = np.arange(len(text) - length + 1)
        parts = [bytes(text[i:i + length]) for i in places]
        rank = suffix.prefix_ranks(text, places, length)
        assert rank.tolist() == [sorted(set(parts)).index(p) for p in parts]
        previous, following = suffix.factors(text, places, length)
        assert previous.tolist() == [p in parts[:i] for i, p in enumerate(parts)] and following.tolist() == [p in parts[i + 1:] for i, p in enumerate(parts)]


# ---------------------------------------------------------------- source divergence and collocations

@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_collocations"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    same_as_sql(con, QUERIES[name](spark, SF), SQL[name])


def same_as_sql(con, frame, sql):
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(frame.columns)
    order = [rel.columns.index(c) for c in frame.columns]
    got = sorted(tuple(r) for r in frame.collect())
    assert got == sorted(tuple(r[i] for i in order) for r in rel.fetchall())
    return got


def odd_con(table):
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    return con


def repeated(spark):
    """Odd rows, and enough repetition for terms and phrases to be kept; one hot source."""
    say = ["Alpha beta, gamma\tdelta. alpha beta gamma Ünder über", "alpha BETA gamma!\nalpha beta; x\x01 y x y", "und so weiter\x0bund so fort und so", "z\x00q 1a2 b_c"]
    extra = [say[i % 4] + " " + " ".join(f"w{j}" for j in range(i % 5)) for i in range(90)]
    return docs(spark, extra)


def test_odd_rows_and_empty_tables(spark):
    table = repeated(spark)
    got = same_as_sql(odd_con(table), divergence.audit(table), divergence.AUDIT_SQL)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "" for r in got)
    got = same_as_sql(odd_con(table), collocations.mine(table), collocations.MINE_SQL)
    assert any(r[0] == "und" for r in got) and any(r[2] == "alpha beta gamma" for r in got)
    assert divergence.audit(empty(spark)).count() == 0 and collocations.mine(empty(spark)).count() == 0
    few = rows(spark, ["only one", None]).unionByName(rows(spark, ["another"], source="t"))
    assert [(r.source, r.item, r.value, r.rank) for r in divergence.audit(few).sort("source").collect()] == [("s", "t", 0, 1), ("t", "s", 0, 1)]  # no kept terms
    assert collocations.mine(few).count() == 0


def test_small_memory_and_hashed_words_change_nothing(spark, monkeypatch):
    table = repeated(spark)
    want = sorted(tuple(r) for r in collocations.mine(table).collect())
    assert sorted(tuple(r) for r in collocations.mine(table, held_words=0).collect()) == want  # beyond what tasks hold
    assert sorted(tuple(r) for r in collocations.mine(table, held_pairs=0).collect()) == want
    terms = sorted(tuple(r) for r in divergence.audit(table).collect())
    for module, name in ((collocations, "CACHE"), (collocations, "CHUNK"), (divergence, "CACHE"), (divergence, "ROWS")):
        monkeypatch.setattr(module, name, 3)
    assert sorted(tuple(r) for r in collocations.mine(table).collect()) == want
    assert sorted(tuple(r) for r in collocations.mine(table, held_words=0).collect()) == want
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == terms


def test_terms_shares_and_tokens():
    assert divergence.terms_of("A-b Ünder\tÜNDER x1y".encode()) == Counter({b"a": 1, b"b": 1, "Ünder".encode(): 2, b"x": 1, b"y": 1})
    big = np.array([0, 7, 10**15], np.int64)
    assert divergence.shares(big, np.int64(2 * 10**15), 123).tolist() == [1 + 10**9 * (c + 2) // (2 * 10**15 + 246) for c in big.tolist()]
    assert collocations.tokens(b"A b,c\td\r\ne") == [b"a", b"b", b"\n", b"c", b"d", b"\n", b"\n", b"e", b"\n"]
    assert collocations.tokens(None) == [b"\n"]
