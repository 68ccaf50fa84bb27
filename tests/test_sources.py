"""Text formats: hand-made files in a temporary folder, and round trips."""

import os

from pyspark.sql import functions as F

from twinmark.sources import smat as SMT
from twinmark.sources import textfiles as TF
from twinmark.sources.lines import read_lines


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_lines_positions(spark, tmp_path):
    p1 = write(tmp_path / "part-00000", "h\na\nb\n")
    write(tmp_path / "part-00001", "c\nd\n")
    got = [(r.pos, r.value) for r in read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, "h"), (1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert os.path.exists(p1)


def test_part_numbers_are_numbers(spark, tmp_path):
    for n in (99999, 100000, 2):
        write(tmp_path / f"part-{n:05d}-x.txt", f"{n}\n")
    got = [r.value for r in read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == ["2", "99999", "100000"]


def test_smat_read_sparse_and_check(spark, tmp_path):
    p = write(tmp_path / "f.smat", "3 2\n0:1.5 1:2\n\n1:-1\n")
    cells = sorted((r.row_id, r.col, r.value) for r in SMT.read_smat(spark, str(p)).collect())
    assert cells == [(0, 0, 1.5), (0, 1, 2.0), (2, 1, -1.0)]
    wide = SMT.read_feature(spark, str(p), "f", 2).orderBy("row_id").collect()
    assert [(r.f_0, r.f_1) for r in wide] == [(1.5, 2.0), (0.0, 0.0), (0.0, -1.0)]
    bad = write(tmp_path / "bad.smat", "5 1\n0:1\n")
    import pytest
    with pytest.raises(Exception):
        SMT.read_smat(spark, str(bad)).collect()


def test_smat_write_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i) / 3, 0.0 if i % 2 else 1e-13) for i in range(25)], "row_id long, a double, b double")
    SMT.write_smat(SMT.dense_lines(df, "row_id", ["a", "b"]), str(tmp_path / "d.smat"), 2)
    back = SMT.read_feature(spark, str(tmp_path / "d.smat"), "x", 2).orderBy("row_id").collect()
    assert [(r.row_id, r.x_0) for r in back] == [(i, i / 3) for i in range(25)]
    long_ = SMT.to_long(df, "row_id", ["a", "b"])
    SMT.write_smat(SMT.sparse_lines(long_, df.select("row_id")), str(tmp_path / "s.smat"), 2)
    lines = [r.value for r in read_lines(spark, str(tmp_path / "s.smat")).orderBy("pos").collect()]
    assert lines[0] == "25 2"
    assert lines[1] == ""  # row 0 holds 0.0 and 1e-13: both below 1e-12, the empty row is still written
    assert lines[2].startswith("0:0.333")
    assert len(lines) == 26


def test_pair_readers(spark, tmp_path):
    p = write(tmp_path / "pairs.txt", "1,¿Hola?,¿hola que tal?\nbad line\n0,a,b,c\n")
    rows, rej = TF.read_pairs_csv(spark, str(p), preprocess=True)
    got = sorted((r.label, r.s1, r.s2) for r in rows.collect())
    assert got == [("0", "a", "b"), ("1", "hola", "hola que tal")]
    assert [r.value for r in rej.collect()] == ["bad line"]
    t = write(tmp_path / "p.tsv", "s1\tt1\ts2\tt2\t1\n")
    r, _ = TF.read_pairs_tsv5(spark, str(t))
    assert [(x.s1, x.s2, x.label) for x in r.collect()] == [("s1", "s2", "1")]
    sw = write(tmp_path / "sw.tsv", "t1\ts1\tt2\ts2\t0\n")
    both = TF.read_bilingual_pairs(spark, str(sw), str(t)).orderBy("pair_id").collect()
    assert [(x.s1, x.label) for x in both] == [("s1", "0"), ("s1", "1")]
    test = write(tmp_path / "test.tsv", "a\tb\nc\td\n")
    tt = TF.read_test_pairs(spark, str(test)).orderBy("test_id").collect()
    assert [(x.test_id, x.s1, x.label) for x in tt] == [(0, "a", -1), (1, "c", -1)]


def test_word_vectors_last_wins(spark, tmp_path):
    p = write(tmp_path / "v.txt", "casa 1 2\nperro 3 4\ncasa 5 6\n")
    got = {r.word: list(r.vec) for r in TF.read_word_vectors(spark, str(p)).collect()}
    assert got == {"casa": [5.0, 6.0], "perro": [3.0, 4.0]}


def test_merge_parts_and_oof_writer(spark, tmp_path):
    a = write(tmp_path / "f.smat.002_000", "2 1\n0:1\n0:2\n")
    b = write(tmp_path / "f.smat.002_001", "1 1\n0:3\n")
    SMT.merge_parts(spark, [str(a), str(b)], str(tmp_path / "f.smat"), 1)
    got = [r.x_0 for r in SMT.read_feature(spark, str(tmp_path / "f.smat"), "x", 1).orderBy("row_id").collect()]
    assert got == [1.0, 2.0, 3.0]
    scores = spark.createDataFrame([(5, 0.25), (1, 0.5)], "pair_id long, score double")
    SMT.write_oof_feature(scores, str(tmp_path / "oof.smat"), "pair_id")
    lines = [r.value for r in read_lines(spark, str(tmp_path / "oof.smat")).orderBy("pos").collect()]
    assert lines == ["2 1", "0:0.5", "0:0.25"]


def test_finite_cache_and_metadata(spark, tmp_path):
    import pytest
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, float("-inf"))], "row_id long, a double")
    assert [r.row_id for r in SMT.finite(df, ["a"], reject=True).collect()] == [0, 2]
    with pytest.raises(Exception, match="not finite"):
        SMT.finite(df, ["a"]).count()
    built = []

    def build():
        built.append(1)
        return df

    for names in (["A", "B"], ["A", "B"], ["A"]):
        assert SMT.cached_features(spark, str(tmp_path), names, build).count() == 4
    assert len(built) == 2
    for name, n in (("X", 2), ("Label_0", 1)):
        SMT.write_smat(SMT.dense_lines(spark.createDataFrame([(i, 1.0 * i, 2.0) for i in range(3)], "row_id long, a double, b double"), "row_id", ["a", "b"][:n]),
                       str(tmp_path / f"{name}.smat"), n)
    got = SMT.load_matrices(spark, str(tmp_path), ["X"])
    assert (got.names, got.n_features, got.label_name) == (["X"], {"X": 2}, "Label_0") and got.features.count() == 3
    with pytest.raises(FileNotFoundError):
        SMT.load_features(spark, str(tmp_path), ["Absent"])
