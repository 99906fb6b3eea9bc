"""The missing-value rules, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import missing, text
from scoreframe.operators import grouped, joins, ordered, reshape
from tests.conftest import rows_of

G = "g string, x double"


@pytest.fixture
def gaps(table):
    return table([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), ("c", None)], G)


def test_strict_aggregates_need_every_value(gaps):
    out = gaps.groupBy("g").agg(missing.strict_avg("x"), missing.strict_max("x"), missing.strict_min("x"),
                                missing.strict_sum("x"), F.avg("x"))
    assert rows_of(out, "g") == [("a", 2.0, 3.0, 1.0, 4.0, 2.0), ("b", None, None, None, None, 2.0),
                                 ("c", None, None, None, None, None)]


def test_two_way_choice_stays_unknown(table):
    df = table([(1, 2.0), (2, None), (3, 0.0)], "id int, x double")
    out = df.select("id", missing.if_known(F.col("x") > 1, "hi", "lo").alias("v"))
    assert rows_of(out, "id") == [(1, "hi"), (2, None), (3, "lo")]


def test_missing_keys_join_each_other(table):
    left = table([("k", 1), (None, 2), ("z", 3)], "k string, a int")
    right = table([("k", 10), (None, 20)], "k string, b int")
    assert rows_of(joins.left_on(left, right, ["k"]), "a") == [("k", 1, 10), (None, 2, 20), ("z", 3, None)]


def test_membership_never_unknown(table):
    df = table([("a",), (None,), ("q",)], "k string")
    members = table([("a",), (None,)], "m string")
    out = joins.flag_member(df, F.col("k"), members, F.col("m"), "hit")
    assert rows_of(out, "k") == [(None, True), ("a", True), ("q", False)]


def test_paste_prints_na(table):
    assert rows_of(table([("a", None)], "x string, y string").select(text.paste("x", "y"))) == [("aNA",)]


def test_sort_puts_missing_last(table):
    df = table([(None,), (2,), (1,)], "x int")
    assert rows_of(ordered.number_rows(df, ["x"], "n"), "n") == [(1, 1), (2, 2), (None, 3)]


def test_extract_without_match_is_missing(table):
    df = table([("Q12. a",), ("none",), (None,)], "t string")
    out = df.select(text.extract("t", "Q[0-9]{1,2}"), text.after_uid("t"))
    assert rows_of(out) == [("Q12", None), (None, None), (None, None)]


def test_scaling_constant_and_single_marks(table):
    df = table([("same", 2.0), ("same", 2.0), ("one", 5.0), ("two", 1.0), ("two", 3.0), ("two", None)], G)
    out = rows_of(grouped.zscore(df, {"x": "z"}, ["g"]).select("g", "x", F.round("z", 4)), "g", "x")
    assert out == [("one", 5.0, None), ("same", 2.0, None), ("same", 2.0, None),
                   ("two", None, None), ("two", 1.0, -0.7071), ("two", 3.0, 0.7071)]


def test_run_ids_treat_missing_as_a_value(table):
    df = table([("f", i, v) for i, v in enumerate([None, None, "u", "u", None, "w"])], "f string, pos int, v string")
    assert [r[3] for r in rows_of(ordered.run_id(df, ["f"], ["pos"], "v", "run"), "pos")] == [0, 0, 1, 1, 2, 3]


def test_bucket_leaves_missing_without_bucket(table):
    df = table([(i, float(i) if i else None) for i in range(8)], "id int, x double")
    out = rows_of(ordered.bucket(df, "x", 3, ["id"], "b").select("id", "b"), "id")
    assert out == [(0, None), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)]


def test_codes_skip_missing(table):
    df = table([("b",), (None,), ("a",), ("b",)], "x string")
    assert rows_of(ordered.encode(df, "x", "c"), "x") == [(None, None), ("a", 1), ("b", 2), ("b", 2)]


def test_numbers_in_text(table):
    df = table([("abc",), ("1,234.5 x",), ("-9",), ("theta[12,3]",), (None,)], "t string")
    out = df.select(text.parse_number("t"), text.cell_index("t", 1), text.cell_index("t", 2))
    assert rows_of(out) == [(None, None, None), (1234.5, None, None), (-9.0, None, None), (123.0, 12, 3), (None, None, None)]


def test_unpivot_keeps_missing_and_position(table):
    df = table([(1, None, "y")], "id int, `a b` string, c string")
    assert rows_of(reshape.to_long(df, ["a b", "c"], "k", "v", "pos"), "pos") == [(1, "a b", None, 1), (1, "c", "y", 2)]


def test_unanswered_item_makes_the_count_missing(table):
    df = table([("a", "x"), ("a", "y"), ("b", None), ("b", "x")], "g string, v string")
    assert rows_of(df.groupBy("g").agg(missing.count_matches(F.col("v") == "x")), "g") == [("a", 1), ("b", None)]


def test_latest_keeps_ties_and_first_row_does_not(table):
    df = table([("a", 1, 1), ("a", 2, 2), ("a", 2, 3)], "g string, t int, id int")
    assert len(rows_of(grouped.keep_latest(df, "t", ["g"]))) == 2
    assert rows_of(grouped.first_rows(df, ["g"], ["t", "id"])) == [("a", 1, 1)]


def test_range_trim_drops_incomplete_groups(gaps):
    assert rows_of(grouped.keep_within_range(gaps, "x", ["g"]), "x") == [("a", 1.0), ("a", 3.0)]
    assert rows_of(grouped.keep_within_range(gaps, "x", ["g"], inclusive=False)) == []


def test_missing_subscription_counts_one(table):
    df = table([(None,), ("News, Music",)], "s string")
    assert rows_of(df.select(reshape.list_length(F.coalesce("s", F.lit("Unanswered"))))) == [(1,), (2,)]


def test_income_codes_run_from_bottom_to_top(table):
    df = table([("Fifth quintile (Bottom 20%)",), ("Top quintile (Top 20%)",), ("Unsure",), (None,)], "q string")
    assert rows_of(df.select(text.income_code("q"))) == [(1,), (5,), (None,), (None,)]


def test_flag_before_fill(table):
    out = missing.fill_and_flag(table([(None, 1.0)], "Q1 double, Q2 double"), ["Q1", "Q2"], -5.0)
    assert out.first().asDict() == {"Q1": -5.0, "Q2": 1.0, "missing_q1": True, "missing_q2": False}


def test_correlation_of_constants_is_missing(table):
    df = table([("a", 1.0), ("a", 1.0)], G).withColumn("y", F.col("x") * 2)
    assert tuple(df.agg(missing.correlation("x", "y"), missing.slope("y", "x"), missing.intercept("y", "x")).first()) == (
        None, None, None)


def test_median_of_group_with_gap(gaps):
    assert rows_of(ordered.group_median(gaps, ["g"], "x", "m"), "g") == [("a", 2.0), ("b", None), ("c", None)]


def test_natural_join_needs_a_shared_name(table):
    with pytest.raises(ValueError):
        joins.natural_left(table([(1,)], "a int"), table([(1,)], "b int"))
