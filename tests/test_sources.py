"""Readers on hand-made files."""

import gzip

import pytest

from rankloom.sources import readers as R, writers as W


def write(path, text):
    path.write_text(text)
    return str(path)


def test_matrix_drops_missing_and_nan(spark, tmp_path):
    p = write(tmp_path / "m.csv", ",d1,d2,d3\na,1.5,NA,NaN\nb,,2,3\n")
    assert sorted(tuple(r) for r in R.read_matrix(spark, p).collect()) == [("a", "d1", 1.5), ("b", "d2", 2.0), ("b", "d3", 3.0)]


def test_expression_prefix(spark, tmp_path):
    p = write(tmp_path / "e.tsv", "GENE_SYMBOLS\tGENE_title\tDATA.906826\tDATA.687983\nTSPAN6\ttetra\t7.6\t7.5\n\tnone\t1\t2\n")
    assert sorted(tuple(r) for r in R.read_expression(spark, p).collect()) == [("687983", "TSPAN6", 7.5), ("906826", "TSPAN6", 7.6)]


def test_events_orientation_and_absence(spark, tmp_path):
    p = write(tmp_path / "w.tsv", "f\ts1\ts2\nG1\t0\t1\n")
    assert sorted(tuple(r) for r in R.read_events(spark, p, "rows").collect()) == [("s1", "G1", 0), ("s2", "G1", 1)]
    assert sorted(tuple(r) for r in R.read_events(spark, p, "columns").collect()) == [("G1", "s1", 0), ("G1", "s2", 1)]
    with pytest.warns(UserWarning):
        assert R.read_events(spark, str(tmp_path / "none.tsv"), "rows").columns == ["g", "f", "x"]
    with pytest.raises(FileNotFoundError):
        R.read_events(spark, str(tmp_path / "none.tsv"), "rows", required=True)


def test_region(spark, tmp_path):
    p = write(tmp_path / "r.csv", "t,,,\n,,,\n,,,\n,,,\nid,name,1,2\n,,Erl,Rap\n11,A,0.5,NA\n12,B,1.5,2.5\n")
    got = sorted(tuple(r) for r in R.read_region(spark, p).collect())
    assert got == [("11", "A", "1", "Erl", 0.5), ("12", "B", "1", "Erl", 1.5), ("12", "B", "2", "Rap", 2.5)]


def test_delimited_gzip_with_comments(spark, tmp_path):
    path = tmp_path / "d.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("# note\nhead\tx\nh2\ty\nk1\t1\n# c\nk2\t2\n")
    got = R.read_delimited(spark, str(path), skip_rows=2, skip_cols=0, names=["k", "v"])
    assert sorted(tuple(r) for r in got.collect()) == [("k1", "1"), ("k2", "2")]


@pytest.mark.parametrize("skip", [0, 1])
def test_delimited_rows_of_several_lengths(spark, tmp_path, skip):
    path = tmp_path / "rows.csv"
    write(path, "t\n" * skip + "a,b\n\"x,y\",2\n# note, with, many, commas\nc,d,e\n\"p\",\"q, r, s, t\",u\nf\n")
    got = R.read_delimited(spark, str(path), sep=",", skip_rows=skip)
    assert got.columns == ["_c0", "_c1", "_c2"]
    assert sorted(map(tuple, got.collect())) == [("a", "b", None), ("c", "d", "e"), ("f", None, None), ("p", "q, r, s, t", "u"), ("x,y", "2", None)]
    write(tmp_path / "none.csv", "")
    assert R.read_delimited(spark, str(tmp_path / "none.csv"), sep=",", skip_rows=skip).count() == 0


def test_resolve_prefers_earlier_patterns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "x.txt", "1")
    write(tmp_path / "z.csv", "1")
    assert R.resolve(spark, str(tmp_path), ["*.tsv", "*.csv", "*.txt"]).endswith("z.csv")
    assert R.resolve(spark, str(tmp_path), ["*.none"]) is None


def test_missing_runs_before_and_after(spark, tmp_path):
    grid = spark.createDataFrame([("a", 0), ("a", 1)], "method string, fold int")
    path = str(tmp_path / "store")
    assert W.missing_runs(grid, path, ["method", "fold"]).count() == 2
    W.write_scored(grid.where("fold = 0").selectExpr("*", "1 as g"), path, ["method", "fold"])
    assert [r.fold for r in W.missing_runs(grid, path, ["method", "fold"]).collect()] == [1]
    assert "PartitionFilters: [isnotnull(fold" in R.read_scored(spark, path).where("fold = 0")._jdf.queryExecution().toString()
