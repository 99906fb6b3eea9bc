"""Readers and writers."""

import pytest

from scoreframe.functions.columns import cols_between, cols_containing, safe_name
from scoreframe.operators.reshape import duplicate_cells, to_long, to_wide
from scoreframe.sources import scan, store
from tests.conftest import rows_of

SCHEMA = scan.typed_schema(["name", "score", "done"], "cnl")


def test_csv_with_lines_above_the_header(spark, tmp_path):
    for part in ("one", "two"):
        lines = ["A title line", "name,score,done"] + [f"{part}{i},{i},{'true' if i else 'false'}" for i in range(3)]
        (tmp_path / "form.csv").mkdir(exist_ok=True)
        (tmp_path / "form.csv" / f"{part}.csv").write_text("\n".join(lines) + "\n")
    got = scan.scan_table(spark, str(tmp_path / "form.csv"), SCHEMA, skip=1)
    assert rows_of(got, "name") == [(f"{p}{i}", float(i), bool(i)) for p in ("one", "two") for i in range(3)]


def test_csv_plain_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,score,done\nx,1.5,true\n,,\n")
    assert rows_of(scan.scan_table(spark, str(tmp_path / "t.csv"), SCHEMA), "score") == [
        (None, None, None), ("x", 1.5, True)]


def test_type_string_must_fit():
    with pytest.raises(ValueError):
        scan.typed_schema(["a"], "cn")


def test_tagged_union_fills_missing_columns(spark, table, tmp_path):
    table([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "p"))
    table([(2,)], "id int").write.parquet(str(tmp_path / "q"))
    out = scan.scan_tagged_union(spark, {"p": str(tmp_path / "p"), "q": str(tmp_path / "q")}, "tag")
    assert rows_of(out, "id") == [(1, "a", "p"), (2, None, "q")]


def test_sheets_without_rows_add_none(spark, table, tmp_path):
    table([(1, "a", 2)], "id int, q1 string, q2 int").write.parquet(str(tmp_path / "s1"))
    table([], "id int, q9 string").write.parquet(str(tmp_path / "s2"))
    out = scan.scan_sheets(spark, str(tmp_path), ["id"], "q", "a", ["s1", "s2"])
    assert rows_of(out, "pos") == [(1, "q1", "a", 1, "s1"), (1, "q2", "2", 2, "s1")]


def test_draws_with_comments(spark, tmp_path):
    (tmp_path / "d.csv").write_text("# sampler\nlp__,theta.1.2,theta.3.1\n# adapted\n-1,0.5,0.25\n-2,1.5,0.75\n")
    out = scan.scan_draws(spark, str(tmp_path / "d.csv"), ["lp__", "theta.1.2", "theta.3.1"], "theta", ["lp__"])
    assert rows_of(out.select("i", "c", "value"), "i", "value") == [(1, 2, 0.5), (1, 2, 1.5), (3, 1, 0.25), (3, 1, 0.75)]


def test_snapshot_is_built_once_per_day(spark, table, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return table([(1,)], "id int")

    for day in ("2020-01-01", "2020-01-01", "2020-01-02"):
        assert store.snapshot(spark, str(tmp_path), "t", day, build).count() == 1
    assert len(calls) == 2 and store.history(spark, str(tmp_path), "t").count() == 2


def test_literal_tables_have_no_row_limit(spark):
    assert scan.inline_table(spark, [(i,) for i in range(12_000)], "i int").count() == 12_000


def test_column_choices(table):
    df = table([(1, 2, 3)], "a int, `b Classmate` int, c int")
    assert cols_between(df, "a", "b Classmate") == ["a", "b Classmate"] and cols_containing(df, "classMATE") == ["b Classmate"]
    assert safe_name("1. Consent") == "X1__Consent"
    with pytest.raises(ValueError):
        cols_between(df, "c", "a")


def test_pivot_undoes_unpivot(table):
    df = table([(1, 2.0, 3.0), (2, None, 5.0)], "id int, x double, y double")
    long = to_long(df, ["x", "y"], "k", "v")
    assert rows_of(to_wide(long, ["id"], "k", "v", ["x", "y"]), "id") == rows_of(df, "id")
    assert duplicate_cells(long, ["id"], "k").count() == 0
    assert duplicate_cells(long.unionAll(long), ["id"], "k").count() == 4
