"""Each verb on the micro-tables of the fixture list, with rows written by hand."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import (
    EngineError, all_of, arrange, as_eager, as_lazy, between, bind_cols, bind_rows, c, collapse, compute, contains, count, desc, ends_with, everything, exclude, filter_, full_join, group_by, has_pending_ops, head,
    if_else, inner_join, is_lazy, is_tbl, left_join, matches, max_, mean, min_, mutate, n, read, right_join, row_number, sd, select, starts_with, sum_, tbl, ungroup, var, write,
)
from plumbline.frame import short_type
from plumbline.operators import joins
from plumbline.operators.bind import promoted, repaired
from plumbline.plans import diagnostics
from plumbline.plans.control import infer_schema, plan_size, query_text
from plumbline.queries import QUERIES


def rows(frame):
    return [tuple(r) for r in frame.df.collect()]


def make(spark, data, schema):
    return tbl(spark.createDataFrame(data, schema))


@pytest.fixture(scope="module")
def pair(spark):
    return make(spark, [(1, 10.0), (2, 20.0), (3, 30.0)], "id int, x double"), make(spark, [(2, 200.0), (3, 300.0), (4, 400.0)], "id int, y double")


def test_filter_comparisons_drop_nulls(spark):
    t = make(spark, [(1,), (None,), (3,), (5,)], "x int")
    assert rows(t.filter(c.x > 1)) == [(3,), (5,)]
    assert rows(t.filter(c.x != 3)) == [(1,), (5,)]
    assert rows(t.filter(c.x >= 1, "x < 5")) == [(1,), (3,)]
    assert rows(t.filter()) == rows(t) and rows(t.filter(True)) == rows(t) and rows(t.filter(False)) == []


def test_filter_masks(spark):
    t = make(spark, [(k,) for k in range(6)], "x int")
    assert rows(t.filter([True, False, None, True, False, True])) == [(0,), (3,), (5,)]
    assert rows(t.filter([True] * 6, c.x > 3)) == [(4,), (5,)]
    with pytest.raises(EngineError, match="6 entries"):
        t.filter([True])
    with pytest.raises(EngineError, match="condition"):
        t.filter(3.5)


def test_positions_hold_on_many_partitions(spark):
    """Rows are paired by place whatever columns are read later and however adaptive execution cuts the shuffles."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        wide = spark.range(300_000).selectExpr("id", "(id * 7919) % 300007 AS k", *(f"repeat(cast(id AS string), 6) AS w{j}" for j in range(6)))
        ordered = arrange(tbl(wide), "k")
        paired = bind_cols(ordered, arrange(tbl(wide.selectExpr("k AS k2", "id AS id2")), "k2"))
        assert paired.df.count() == 300_000 and paired.df.filter("k <> k2 OR id <> id2").count() == 0
        halves = filter_(ordered.select("id", "k"), [j % 2 == 0 for j in range(300_000)])
        expected = [r.id for r in wide.select("id", "k").orderBy("k").collect()][::2]
        assert [r.id for r in halves.df.collect()] == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_group_values_and_row_numbers(spark):
    t = make(spark, [("a", 1.0, 1), ("b", 2.0, 2), ("a", 3.0, 3), (None, 4.0, 4), (None, None, 5)], "g string, x double, i int")
    by_i = lambda f: [tuple(r)[1:] for r in sorted(f.select("i", *[n for n in f.names if n not in ("g", "x", "i")]).df.collect())]
    assert by_i(t.group_by("g").mutate(share=c.x / sum_("x"), k=n())) == [(0.25, 2), (1.0, 1), (0.75, 2), (1.0, 2), (None, 2)]
    assert by_i(t.mutate(share=10 * c.x / sum_("x"), big=c.x > mean("x"))) == [(1.0, False), (2.0, False), (3.0, True), (4.0, True), (None, None)]
    assert by_i(t.arrange("i").mutate(k=row_number())) == [(1,), (2,), (3,), (4,), (5,)]
    assert by_i(t.arrange("i").group_by("g").mutate(k=row_number(), twice=2 * row_number())) == [(1, 2.0), (1, 2.0), (2, 4.0), (1, 2.0), (2, 4.0)]
    assert t.group_by("g").mutate(x=sum_("x")).names == ["g", "x", "i"] and t.group_by("g").mutate(x=sum_("x")).group_vars == ["g"]


def test_refused_plans_name_the_operation(spark):
    t = make(spark, [(1,)], "x int")
    for run, operation in ((lambda: t.filter(c.y > 1), "filter"), (lambda: t.mutate(z=c.y + 1), "mutate"), (lambda: t.filter("y > 1"), "filter"), (lambda: t.summarise(z=sum_(c.y + 1)), "summarise")):
        with pytest.raises(EngineError, match=f"operation '{operation}' failed: column 'y' not found; there are x"):
            run()
    with pytest.raises(EngineError, match="'mutate' failed: the expression cannot be evaluated"):
        t.mutate(z="sum(x")


def test_shown_plans_have_a_size(spark, capsys):
    t = make(spark, [(1,)], "x int").filter(c.x > 0).arrange("x").head(1)
    t.show_query()
    assert plan_size(t)[1] >= plan_size(t)[0] >= 2 and "Depth: " in capsys.readouterr().out


def test_select_rules(spark):
    t = make(spark, [(1, 2, 3, 4)], "`a.one` int, a_two int, b int, three int")
    names = lambda *w, **r: select(t, *w, **r).names
    assert names("b", "a.one") == ["b", "a.one"]
    assert names(starts_with("a")) == ["a.one", "a_two"]
    assert names(ends_with("e"), "b") == ["a.one", "three", "b"]
    assert names(contains("_")) == ["a_two"] and names(matches("^.$")) == ["b"]
    assert names("three", everything()) == ["three", "a.one", "a_two", "b"]
    assert names(-starts_with("a")) == ["b", "three"] == names(exclude("a.one", "a_two"))
    assert names("-b") == ["a.one", "a_two", "three"] and names(1, 3) == ["a.one", "b"] and names(-1) == ["a_two", "b", "three"]
    assert names(between("a_two", "three")) == ["a_two", "b", "three"] and names(all_of(["b"])) == ["b"]
    assert names("b", new="three") == ["b", "new"]
    with pytest.raises(EngineError, match="no columns"):
        names(starts_with("zzz"))
    with pytest.raises(EngineError, match="not found"):
        names("zzz")


def test_set_names_validates(spark):
    t = make(spark, [(1, 2)], "a int, b int").group_by("a")
    assert t.set_names(["x", "y"]).names == ["x", "y"] and t.set_names(["x", "y"]).group_vars == ["x"]
    for bad in (["x"], ["x", None], ["x", ""], ["x", 3]):
        with pytest.raises(EngineError):
            t.set_names(bad)


def test_arithmetic_is_double(spark):
    t = make(spark, [(10, 2), (20, 4), (30, 5)], "x int, y int")
    out = rows(t.mutate(a=c.x + c.y, s=c.x - 1, m=c.x * 2147483647, d=c.x / c.y, p=c.y**2, r=100 - c.x, i=c.x // 7, q=-c.x % 7))
    assert out[0] == (10, 2, 12.0, 9.0, 10 * 2147483647.0, 5.0, 4.0, 90.0, 1.0, 4.0)


def test_division_follows_ieee(spark):
    t = make(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[2] for r in rows(t.mutate(x=c.a / c.b))]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [-math.inf, None, None]


def test_mutate_is_sequential_and_keeps_places(spark):
    t = make(spark, [(k, k + 5) for k in (1, 2)], "x int, y int")
    assert rows(t.mutate(x=c.x * 2, z=c.x + c.y, w=c.z)) == [(2.0, 6, 8.0, 8.0), (4.0, 7, 11.0, 11.0)]
    assert mutate(t, x=c.x).names == ["x", "y"]
    assert rows(t.mutate(b=c.x > 1, k=3, e="x + 1")) == [(1, 6, False, 3, 2), (2, 7, True, 3, 3)]
    with pytest.warns(UserWarning, match="named"):
        assert mutate(t, "x + 1").names == ["x", "y", "x + 1"]
    with pytest.raises(EngineError, match="vector"):
        t.mutate(z=[1, 2])


def test_summarise(spark):
    t = make(spark, [("a", 1, 2.0), ("a", 3, None), ("b", 5, 4.0), (None, 7, 1.0)], "g string, i int, x double")
    out = {r[0]: r[1:] for r in rows(t.group_by("g").summarise(s=sum_("i"), m=mean("x"), lo=min_("x"), hi=max_("i"), n=n(), k=count("x"), sd=sd("i"), v=var("i")))}
    assert out["a"] == (4, 2.0, 2.0, 3, 2, 2, math.sqrt(2), 2.0)
    assert out["b"] == (5, 4.0, 4.0, 5, 1, 1, None, None) and None in out
    assert len(rows(t.group_by("g").summarise(drop_null_keys=True, n=n()))) == 2
    assert rows(t.summarise(many=sum_(c.i > 2), share=mean(c.x > 1.5), top=max_(c.i * 2))) == [(3, 2 / 3, 14.0)]
    assert t.group_by("g").summarise(n=n()).group_vars == []
    for bad in ({}, {"x": 3}, {"x": sum_("zzz")}):
        with pytest.raises(EngineError):
            t.summarise(**bad)
    assert rows(t.filter(False).summarise(n=n(), s=sum_("i"))) == [(0, None)]


def test_groups_are_metadata(spark):
    t = make(spark, [(1, 2, 3)], "a int, b int, c int")
    g = group_by(t, "a")
    assert group_by(g, "b", "b", add=True).group_vars == ["a", "b"] and group_by(g, "c").group_vars == ["c"]
    assert g.filter(c.a > 0).mutate(z=1).arrange("a").group_vars == ["a"] and g.select("b").group_vars == [] and ungroup(g).group_vars == []
    with pytest.raises(EngineError):
        group_by(t, "zzz")


def test_arrange(spark):
    t = make(spark, [(2.0,), (None,), (1.0,), (3.0,)], "x double")
    assert rows(t.arrange("x")) == [(1.0,), (2.0,), (3.0,), (None,)]
    assert rows(t.arrange(desc("x"))) == [(None,), (3.0,), (2.0,), (1.0,)] == rows(t.arrange(-c.x)) == rows(t.arrange("-x"))
    s = make(spark, [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)], "x int, m int")
    assert [r[1] for r in rows(s.arrange(desc("x")))] == [4, 5, 1, 2, 3]
    b = make(spark, [("b", 2), ("a", 1), ("b", 1), ("a", 2)], "g string, x int").group_by("g")
    assert rows(arrange(b, "x", by_group=True)) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert rows(arrange(b, desc("g"), "x", by_group=True)) == [("b", 1), ("b", 2), ("a", 1), ("a", 2)]
    assert rows(head(t.arrange("x"), 2)) == [(1.0,), (2.0,)]
    with pytest.raises(EngineError):
        t.arrange("zzz")


def test_factors(spark):
    t = tbl(pd.DataFrame({"f": pd.Categorical(["high", "low", None, "medium"], ["low", "medium", "high"]), "k": [1, 2, 3, 4]}), spark)
    assert t.levels("f") == ["low", "medium", "high"] and [r[1] for r in rows(t.arrange("f"))] == [2, 4, 1, 3] and [r[1] for r in rows(t.arrange(desc("f")))] == [3, 1, 4, 2]
    back = t.filter(c.k > 1).collect()
    assert list(back["f"].cat.categories) == ["low", "medium", "high"]
    assert inner_join(t, t.select("k", other="f"), "k").levels("f") == ["low", "medium", "high"] and bind_rows(t, t).levels("f") == ["low", "medium", "high"]


def test_joins(pair):
    x, y = pair
    assert sorted(rows(inner_join(x, y, "id"))) == [(2, 20.0, 200.0), (3, 30.0, 300.0)]
    assert sorted(rows(left_join(x, y))) == [(1, 10.0, None), (2, 20.0, 200.0), (3, 30.0, 300.0)]
    assert sorted(rows(right_join(x, y))) == [(2, 20.0, 200.0), (3, 30.0, 300.0), (4, None, 400.0)]
    assert sorted(rows(full_join(x, y))) == [(1, 10.0, None), (2, 20.0, 200.0), (3, 30.0, 300.0), (4, None, 400.0)]
    assert full_join(x, y, keep=True).names == ["id.x", "x", "id.y", "y"]
    assert rows(left_join(x, y, ordered=True))[0] == (1, 10.0, None)
    assert as_lazy(x).inner_join(y).mode == "lazy"


def test_join_keys(spark, pair):
    x, y = pair
    a, b = make(spark, [(1, 10), (None, 20), (2, 30)], "k int, x int"), make(spark, [(None, 100), (2, 200), (3, 300)], "k int, y int")
    assert sorted(rows(inner_join(a, b)), key=str) == [(2, 30, 200), (None, 20, 100)]
    assert rows(inner_join(a, b, na_matches="never")) == [(2, 30, 200)]
    m = make(spark, [(1, 10), (1, 20), (2, 30)], "k int, v int"), make(spark, [(1, 100), (1, 200), (2, 300)], "k int, v int")
    out = inner_join(*m, by="k")
    assert out.names == ["k", "v.x", "v.y"] and len(rows(out)) == 5
    assert inner_join(x, y.select(key="id", y="y"), {"id": "key"}).names == ["id", "x", "y"]
    assert sorted(rows(left_join(left_join(x, y), y.select(id="id", z="y"))))[0] == (1, 10.0, None, None)
    text = make(spark, [("1",)], "id string")
    for bad in (lambda: inner_join(x, text), lambda: inner_join(x, y, "zzz"), lambda: inner_join(x, y, ["id", "id"]), lambda: inner_join(x, y, "id", na_matches="?"), lambda: inner_join(x.select(a="id"), y)):
        with pytest.raises(EngineError):
            bad()


def test_many_to_many_joins_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "UNIT", 8, raising=False)
    left = [(None if k % 7 == 0 else k % 5 if k % 3 else 1, k % 2, k // 4 * 0.5) for k in range(60)]  # hot keys, NULLs, equal rows
    right = [(None if k % 5 == 0 else k % 6 if k % 4 else 1, k % 3, k // 3) for k in range(40)]
    x, y = make(spark, left, "k int, j int, x double").mutate(m=F.create_map(F.lit("a"), F.lit(1))), make(spark, right, "k int, j int, y long")
    wide = y.mutate(k=c.k.cast("double"))
    odd = make(spark, [(v, n) for n in range(4) for v in (0.0, -0.0, math.nan, 1.0, None)], "k double, n int")
    flags = make(spark, [(k % 3 == 0 if k % 4 else None, k) for k in range(30)], "k boolean, z int")
    cases = [(inner_join, y, "k", {}), (left_join, y, ["k", "j"], {"na_matches": "never"}), (right_join, y, "k", {"na_matches": "never"}), (left_join, wide, "k", {"keep": True}), (right_join, flags, "k", {}), (inner_join, odd, "k", {"na_matches": "never"}), (left_join, y.filter(False), "k", {})]
    for join, other, by, options in cases:
        plain, spread = join(x, other, by, **options), join(x, other, by, relationship="many-to-many", **options)
        assert spread.names == plain.names and spread.types == plain.types
        assert sorted(map(repr, rows(spread))) == sorted(map(repr, rows(plain)))
    odds = odd.select("k", other="n")
    assert sorted(map(repr, rows(inner_join(odd, odds, "k", relationship="many-to-many")))) == sorted(map(repr, rows(inner_join(odd, odds, "k"))))
    assert rows(left_join(x, y, "k", ordered=True, relationship="many-to-many")) == rows(left_join(x, y, "k", ordered=True))
    with pytest.raises(EngineError, match="relationship"):
        inner_join(x, y, "k", relationship="one-to-one")


def test_many_to_many_join_spreads_one_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "UNIT", 1 << 14, raising=False)
    spark.range(0, 3000, 1, 2).selectExpr("id AS c_custkey", "7 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 1000, 1, 2).selectExpr("id AS s_suppkey", "7 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    made = QUERIES["join_many_to_many"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 3_000_000 and max(r["count"] for r in made) < 600_000


def test_bind_rows(spark):
    a, b = make(spark, [(1, "p")], "a int, b string"), make(spark, [("q", 2.5)], "b string, a double")
    out = bind_rows(a, b, None)
    assert out.types == {"a": "double", "b": "string"} and sorted(rows(out)) == [(1.0, "p"), (2.5, "q")]
    assert rows(bind_rows(first=a, second=a, id="src")) == [("first", 1, "p"), ("second", 1, "p")]
    assert rows(bind_rows(a, a.select("a"), id="src")) == [("1", 1, "p"), ("2", 1, None)]
    assert rows(bind_rows([a, a.filter(False)])) == [(1, "p")]
    assert (promoted("boolean", "int"), promoted("int", "bigint"), promoted("double", "string"), promoted("date", "timestamp")) == ("int", "bigint", "string", "timestamp")
    with pytest.raises(EngineError):
        promoted("date", "int")


def test_bind_cols(spark):
    a, b = make(spark, [(1,), (2,), (3,)], "x int").group_by("x"), make(spark, [(4,), (5,), (6,)], "x int")
    out = bind_cols(a, b)
    assert out.names == ["x...1", "x...2"] and sorted(rows(out)) == [(1, 4), (2, 5), (3, 6)] and out.group_vars == ["x...1"]
    assert repaired(["a", "a b", "", "a"], "universal") == ["a...1", "a.b", "...3", "a...4"] and repaired(["a", "a"], "minimal") == ["a", "a"]
    with pytest.raises(EngineError):
        repaired(["a", "a"], "check_unique")
    with pytest.raises(EngineError, match="rows"):
        bind_cols(a, b.filter(c.x > 4))


def test_modes_and_control(spark, monkeypatch):
    t = make(spark, [(1,), (2,)], "x int")
    lazy = tbl(t, lazy=True)
    assert is_lazy(lazy) and has_pending_ops(lazy) and lazy.dim == (None, 1) and t.dim == (2, 1)
    done = compute(lazy)
    assert not has_pending_ops(done) and done.nrow == 2 and done.df.is_cached and compute(done) is done
    dealt = compute(tbl(spark.range(0, 100, 1, 1), lazy=True), partitions=4)
    assert dealt.df.rdd.getNumPartitions() == 4 and dealt.df.is_cached and sorted(r.id for r in dealt.df.collect()) == list(range(100)) and not dealt.release().df.is_cached
    assert as_eager(lazy).mode == "eager" and rows(collapse(t).filter(c.x > 1)) == [(2,)]
    done.release()
    assert "Scan" in query_text(t) or "LocalTableScan" in query_text(t)
    assert infer_schema(lazy).names == ["x"] and is_tbl(t) and not is_tbl(3)
    spark.conf.set("spark.plumbline.mode", "lazy")
    assert tbl(t.df).mode == "lazy"
    spark.conf.set("spark.plumbline.mode", "sometimes")
    with pytest.raises(EngineError):
        tbl(t.df)
    spark.conf.unset("spark.plumbline.mode")
    monkeypatch.setenv("PLUMBLINE_MODE", "lazy")
    assert tbl(t.df).mode == "lazy"


def test_sources_and_sinks(spark, tmp_path):
    t = tbl({"x": [1.5, float("nan"), float("inf")], "y": ["a", None, "c"], "k": [2**60, 2, 3]}, spark)
    assert rows(t) == [(1.5, "a", 2**60), (None, None, 2), (math.inf, "c", 3)]
    assert t.collect()["k"].tolist() == [2**60, 2, 3]
    for kind in ("parquet", "csv", "json", "orc"):
        write(t.select("y", "k"), f"{tmp_path}/t.{kind}", kind)
        assert sorted(read(spark, f"{tmp_path}/t.{kind}").select("k", "y").df.collect(), key=lambda r: r.k) == sorted(t.select("k", "y").df.collect(), key=lambda r: r.k)
    with pytest.raises(EngineError):
        tbl(3, spark)
    assert "x" in t.glimpse() and "<dbl>" in repr(t) and short_type("array<int>") == "???"


def test_diagnostics(spark):
    t = make(spark, [(1, 2.0, "a")] * 8, "i int, x double, s string")
    assert diagnostics.memory_usage(t) == 8 * (4 + 8 + 32) + 3 and diagnostics.object_info(t)["types"] == {"i": "int", "x": "dbl", "s": "chr"}
    assert diagnostics.verify(t) and diagnostics.size_comparison(t)["plan_bytes"] > 0 and diagnostics.memory_state(spark) and diagnostics.has_session()
    assert diagnostics.session_details(spark)["version"].startswith("4")


def test_streams(spark, tmp_path):
    from plumbline.streaming import read_stream, write_stream

    make(spark, [(k, k * 2.0) for k in range(10)], "k int, x double").write(f"{tmp_path}/in")
    out = read_stream(spark, f"{tmp_path}/in", "k int, x double").filter(c.k > 6).mutate(y=c.x / 2)
    write_stream(out, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert sorted(rows(read(spark, f"{tmp_path}/out"))) == [(7, 14.0, 7.0), (8, 16.0, 8.0), (9, 18.0, 9.0)]


def test_plans_are_pruned_and_pushed(spark, tmp_path):
    make(spark, [(k, 1.0, "z") for k in range(10)], "k int, x double, s string").write(f"{tmp_path}/t")
    t = read(spark, f"{tmp_path}/t")
    text = query_text(t.filter(c.k > 3).mutate(y=c.x * 2).select("k", "y"))
    assert "GreaterThan(k,3)" in text and "ReadSchema: struct<k:int,x:double>" in text and "Python" not in text
    text = query_text(t.group_by("s").summarise(n=n()).filter(c.s == "z"))
    assert "EqualTo(s,z)" in text
    assert "TakeOrderedAndProject" in query_text(t.arrange("x").head(3)) and "SortMergeJoin" not in query_text(t.filter(c.k > 1).mutate(z=if_else(c.k > 3, 1, 2)))


def test_empty_tables(spark, pair):
    x, y = pair
    e = x.filter(False)
    assert rows(e.mutate(z=c.x / 2).arrange("x").select("z")) == [] and rows(inner_join(e, y)) == [] and len(rows(full_join(e, y))) == 3
    assert rows(e.group_by("id").summarise(n=n())) == [] and rows(filter_(e, [])) == []
