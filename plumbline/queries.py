"""One query for each operator of the inventory, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import (
    Frame, all_of, arrange, between, bind_cols, bind_rows, c, collapse, compute, contains, count, desc, ends_with, everything, exclude, full_join, if_else, inner_join, left_join, matches, max_, mean, min_, n, read,
    rename, right_join, row_number, sd, starts_with, sum_, tbl, var, write,
)
from plumbline.frame import position
from plumbline.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` is the table of that name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> Frame:
        return tbl(self._spark.read.parquet(f"{self._folder}/{name}.parquet"))


def query(name: str, sql: str):
    """Registers what a function makes of the tables."""

    def register(f: Callable[[Tables], Frame]) -> Callable[[Tables], Frame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder)).df

        QUERIES[name], ORACLE_SQL[name] = run, sql
        return f

    return register


def plain(name: str, sql: str, f: Callable[[Tables], Frame]) -> None:
    query(name, sql)(f)


def rounded(frame: Frame, *names: str, digits: int = 4) -> Frame:
    """Sums of doubles depend on the order of rows in their last digits."""
    return frame.mutate(**{x: F.round(F.col(x), digits) for x in names})


# --- filter ------------------------------------------------------------------------------------------------------------

KEYS = "l_orderkey, l_linenumber, l_quantity, l_discount"
_keys = lambda f: f.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
for _name, _sign, _test in (
    ("eq", "=", lambda: c.l_quantity == 25), ("ne", "<>", lambda: c.l_quantity != 25), ("gt", ">", lambda: c.l_quantity > 25),
    ("ge", ">=", lambda: c.l_quantity >= 25), ("lt", "<", lambda: c.l_quantity < 25), ("le", "<=", lambda: c.l_quantity <= 25),
):
    plain(f"filter_scalar_{_name}", f"SELECT {KEYS} FROM lineitem WHERE l_quantity {_sign} 25", lambda t, test=_test: _keys(t.lineitem.filter(test())))
plain("filter_col_col", f"SELECT {KEYS} FROM lineitem WHERE l_discount > l_tax", lambda t: _keys(t.lineitem.filter(c.l_discount > c.l_tax)))
plain("filter_multi_and", f"SELECT {KEYS} FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.02 AND l_tax < 0.05", lambda t: _keys(t.lineitem.filter(c.l_quantity > 10, c.l_discount > 0.02).filter(c.l_tax < 0.05)))
plain("filter_true", "SELECT n_nationkey, n_name FROM nation", lambda t: t.nation.filter(True).select("n_nationkey", "n_name"))
plain("filter_false", "SELECT n_nationkey, n_name FROM nation WHERE false", lambda t: t.nation.filter(False).select("n_nationkey", "n_name"))
plain("filter_mask", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 6", lambda t: t.nation.arrange("n_nationkey").filter([None if k == 6 else k % 3 == 0 for k in range(25)]).select("n_nationkey", "n_name"))
plain("filter_mask_orders", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i % 3 = 1", lambda t: (lambda f: f.filter([k % 3 == 0 for k in range(f.nrow)]))(t.orders.select("o_orderkey", "o_totalprice").arrange(desc("o_totalprice"), "o_orderkey")))
plain("filter_odd_names", 'SELECT l_orderkey AS "the.key", l_quantity AS "a b-c" FROM lineitem WHERE l_quantity > 49', lambda t: t.lineitem.select(**{"the.key": "l_orderkey", "a b-c": "l_quantity"}).filter(c["a b-c"] > 49))
plain("filter_string_eq", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", lambda t: t.customer.filter(c.c_mktsegment == "BUILDING").select("c_custkey", "c_mktsegment"))
plain("filter_isin", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')", lambda t: t.orders.filter(c.o_orderstatus.isin("F", "P")).select("o_orderkey", "o_orderstatus"))
plain("filter_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", lambda t: t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'", "o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select("o_orderkey", "o_orderdate"))
plain("filter_or_not", f"SELECT {KEYS} FROM lineitem WHERE (l_quantity < 5 OR l_discount > 0.08) AND NOT l_tax = 0.02", lambda t: _keys(t.lineitem.filter(((c.l_quantity < 5) | (c.l_discount > 0.08)) & ~(c.l_tax == 0.02))))
plain("filter_nulls", "SELECT l_orderkey, l_linenumber, q FROM (SELECT *, nullif(l_quantity, 25) AS q FROM lineitem) WHERE q > 20", lambda t: t.lineitem.mutate(q=if_else(c.l_quantity != 25, c.l_quantity)).filter(c.q > 20).select("l_orderkey", "l_linenumber", "q"))

# --- select and rename --------------------------------------------------------------------------------------------------

plain("select_names", "SELECT n_name, n_regionkey FROM nation", lambda t: t.nation.select("n_name", "n_regionkey"))
plain("select_reorder", "SELECT n_regionkey, n_nationkey, n_name FROM nation", lambda t: t.nation.select("n_regionkey", "n_nationkey", "n_name"))
plain("select_starts_with", "SELECT l_linenumber, l_linestatus FROM lineitem", lambda t: t.lineitem.select(starts_with("l_line")))
plain("select_ends_with", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem", lambda t: t.lineitem.select(ends_with("key")))
plain("select_contains", "SELECT o_orderdate, o_orderkey, o_orderpriority, o_orderstatus FROM orders", lambda t: t.orders.select(contains("order")))
plain("select_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer", lambda t: t.customer.select(exclude("c_acctbal", "c_mktsegment")))
plain("select_range", "SELECT c_name, c_nationkey, c_acctbal FROM customer", lambda t: t.customer.select(between("c_name", "c_acctbal")))
plain("select_position", "SELECT c_custkey, c_nationkey FROM customer", lambda t: t.customer.select(1, 3))
plain("select_all_of", "SELECT s_name, s_suppkey FROM supplier", lambda t: t.supplier.select(all_of(["s_name", "s_suppkey"])))
plain("select_matches", "SELECT l_extendedprice, l_discount FROM lineitem", lambda t: t.lineitem.select(matches("price$|_disc")))
plain("rename_some", "SELECT s_suppkey AS key, s_name, s_nationkey, s_acctbal AS balance FROM supplier", lambda t: rename(t.supplier, key="s_suppkey", balance="s_acctbal"))
plain("set_names_grouped", "SELECT nation, count(*) AS n FROM (SELECT s_nationkey AS nation FROM supplier) GROUP BY nation", lambda t: t.supplier.select("s_suppkey", "s_nationkey").group_by("s_nationkey").set_names(["key", "nation"]).summarise(n=n()))
plain("select_keeps_groups", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", lambda t: t.nation.group_by("n_regionkey", "n_name").select("n_regionkey", "n_nationkey").summarise(n=n()))
plain("select_rename", "SELECT n_nationkey AS key, n_name AS nation FROM nation", lambda t: t.nation.select(key="n_nationkey", nation="n_name"))
plain("select_everything", "SELECT n_name, n_nationkey, n_regionkey FROM nation", lambda t: t.nation.select("n_name", everything()))
plain("rename_all", "SELECT r_regionkey AS a, r_name AS b FROM region", lambda t: t.region.set_names(["a", "b"]))

# --- mutate -------------------------------------------------------------------------------------------------------------

_line = lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_id_x = lambda f: f.select("l_orderkey", "l_linenumber", "x")
for _name, _sql, _term in (
    ("add_scalar", "l_quantity + 2.5e0", lambda: c.l_quantity + 2.5), ("sub_scalar", "l_quantity - 2.5e0", lambda: c.l_quantity - 2.5), ("mul_scalar", "l_quantity * 2.5e0", lambda: c.l_quantity * 2.5),
    ("div_scalar", "l_quantity / 4e0", lambda: c.l_quantity / 4), ("pow_scalar", "pow(l_quantity, 2)", lambda: c.l_quantity**2),
    ("add_col", "l_quantity + l_tax", lambda: c.l_quantity + c.l_tax), ("sub_col", "l_quantity - l_tax", lambda: c.l_quantity - c.l_tax), ("mul_col", "l_quantity * l_tax", lambda: c.l_quantity * c.l_tax),
    ("div_col", "l_extendedprice / l_quantity", lambda: c.l_extendedprice / c.l_quantity), ("pow_col", "round(pow(l_quantity, l_tax), 9)", lambda: F.round((c.l_quantity**c.l_tax).column, 9)),
    ("int_div", "floor(l_quantity / 7e0)", lambda: c.l_quantity // 7), ("modulo", "l_quantity - floor(l_quantity / 7e0) * 7", lambda: c.l_quantity % 7),
    ("div_zero", "CASE WHEN l_tax = 0 THEN l_discount / 0e0 ELSE l_discount / l_tax END", lambda: c.l_discount / (c.l_tax + 0)),  # its SQL takes -0 for 0
    ("nested", "(l_quantity + 1) * l_extendedprice * (1 - l_discount) / (2 + l_tax)", lambda: (c.l_quantity + 1) * c.l_extendedprice * (1 - c.l_discount) / (2 + c.l_tax)),
    ("chain", "l_quantity + l_tax - l_discount + 1 - 0.5e0", lambda: c.l_quantity + c.l_tax - c.l_discount + 1 - 0.5), ("scalar_left", "10 - l_quantity", lambda: 10 - c.l_quantity),
    ("bool", "l_discount > l_tax", lambda: c.l_discount > c.l_tax), ("copy", "l_tax", lambda: c.l_tax),
):
    plain(f"mutate_{_name}", f"SELECT l_orderkey, l_linenumber, {_sql} AS x FROM lineitem", lambda t, term=_term: _id_x(_line(t).mutate(x=term())))
plain("mutate_int", "SELECT p_partkey, p_size * 1e0 * 2147483647 AS x FROM part", lambda t: t.part.mutate(x=c.p_size * 2147483647).select("p_partkey", "x"))
plain("mutate_replace", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier", lambda t: t.supplier.mutate(s_acctbal=c.s_acctbal * 2))
plain("mutate_sequential", "SELECT s_suppkey, s_acctbal + 1 AS a, (s_acctbal + 1) * 2 AS b, (s_acctbal + 1) * 2 - (s_acctbal + 1) AS d FROM supplier", lambda t: t.supplier.mutate(a=c.s_acctbal + 1, b=c.a * 2, d=c.b - c.a).select("s_suppkey", "a", "b", "d"))
plain("mutate_own_operand", "SELECT s_suppkey, (s_acctbal + 1) * s_acctbal AS s_acctbal FROM supplier", lambda t: t.supplier.mutate(s_acctbal=(c.s_acctbal + 1) * c.s_acctbal).select("s_suppkey", "s_acctbal"))
plain("mutate_null", "SELECT l_orderkey, l_linenumber, nullif(l_quantity, 25) + 1 AS x FROM lineitem", lambda t: _id_x(t.lineitem.mutate(x=if_else(c.l_quantity != 25, c.l_quantity) + 1)))

plain("mutate_group_total", "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) * 100, 9) AS x, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem", lambda t: rounded(t.lineitem.group_by("l_returnflag", "l_linestatus").mutate(x=c.l_quantity / sum_("l_quantity") * 100, n=n()).ungroup().select("l_orderkey", "l_linenumber", "x", "n"), "x", digits=9))
plain("mutate_total", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS x FROM orders", lambda t: rounded(t.orders.mutate(x=c.o_totalprice - mean("o_totalprice")).select("o_orderkey", "x"), "x"))
plain("mutate_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders", lambda t: t.orders.select("o_orderkey", "o_totalprice").arrange("o_totalprice", "o_orderkey").mutate(i=row_number()).select("o_orderkey", "i"))
plain("mutate_row_number_grouped", "SELECT o_orderkey, k, row_number() OVER (PARTITION BY k ORDER BY o_totalprice DESC, o_orderkey) AS i FROM (SELECT *, nullif(o_orderstatus, 'F') AS k FROM orders)", lambda t: t.orders.mutate(k=if_else(c.o_orderstatus != "F", c.o_orderstatus)).arrange(desc("o_totalprice"), "o_orderkey").group_by("k").mutate(i=row_number()).select("o_orderkey", "k", "i"))

# --- summarise ------------------------------------------------------------------------------------------------------------

plain("summarise_ungrouped", "SELECT round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 4) AS average, min(l_tax) AS least, max(l_tax) AS most, count(*) AS n FROM lineitem", lambda t: rounded(t.lineitem.summarise(total=sum_("l_quantity"), average=mean("l_extendedprice"), least=min_("l_tax"), most=max_("l_tax"), n=n()), "total", "average"))
for _name, _sql, _agg in (
    ("sum", "round(sum(l_quantity), 4)", lambda: sum_("l_quantity")), ("mean", "round(avg(l_extendedprice), 4)", lambda: mean("l_extendedprice")), ("min", "min(l_extendedprice)", lambda: min_("l_extendedprice")),
    ("max", "max(l_extendedprice)", lambda: max_("l_extendedprice")), ("n", "count(*)", n), ("sd", "round(stddev_samp(l_extendedprice), 4)", lambda: sd("l_extendedprice")), ("var", "round(var_samp(l_quantity), 4)", lambda: var("l_quantity")),
):
    plain(f"summarise_grouped_{_name}", f"SELECT l_returnflag, {_sql} AS x FROM lineitem GROUP BY l_returnflag", lambda t, agg=_agg, name=_name: (lambda f: rounded(f, "x") if name in ("sum", "mean", "sd", "var") else f)(t.lineitem.group_by("l_returnflag").summarise(x=agg())))
plain("summarise_int_sum", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS x FROM part GROUP BY p_brand", lambda t: t.part.group_by("p_brand").summarise(x=sum_("p_size")))
plain("summarise_count", "SELECT l_returnflag, count(*) AS x FROM lineitem GROUP BY l_returnflag", lambda t: t.lineitem.mutate(q=if_else(c.l_quantity != 25, c.l_quantity)).group_by("l_returnflag").summarise(x=count("q")))
plain("summarise_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ALL", lambda t: t.lineitem.group_by("l_returnflag").group_by("l_linestatus", add=True).summarise(n=n(), most=max_("l_quantity")))
plain("summarise_cmp_scalar", "SELECT l_returnflag, CAST(sum(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS many, round(avg(CAST(l_quantity > 25 AS INT)), 6) AS share FROM lineitem GROUP BY l_returnflag", lambda t: rounded(t.lineitem.group_by("l_returnflag").summarise(many=sum_(c.l_quantity > 25), share=mean(c.l_quantity > 25)), "share", digits=6))
plain("summarise_cmp_cols", "SELECT l_returnflag, CAST(sum(CAST(l_discount > l_tax AS INT)) AS BIGINT) AS x FROM lineitem GROUP BY l_returnflag", lambda t: t.lineitem.group_by("l_returnflag").summarise(x=sum_(c.l_discount > c.l_tax)))
plain("summarise_arith", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS x, max(l_quantity * 2) AS y FROM lineitem GROUP BY l_returnflag", lambda t: rounded(t.lineitem.group_by("l_returnflag").summarise(x=sum_(c.l_extendedprice * c.l_discount), y=max_(c.l_quantity * 2)), "x", digits=2))
plain("summarise_null_key", "SELECT nullif(l_returnflag, 'N') AS k, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1", lambda t: rounded(t.lineitem.mutate(k=if_else(c.l_returnflag != "N", c.l_returnflag)).group_by("k").summarise(n=n(), total=sum_("l_quantity")), "total"))
plain("summarise_drop_null_key", "SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1", lambda t: t.lineitem.mutate(k=if_else(c.l_returnflag != "N", c.l_returnflag)).group_by("k").summarise(drop_null_keys=True, n=n()))
plain("summarise_skip_nulls", "SELECT l_returnflag, round(avg(nullif(l_quantity, 25)), 6) AS average, min(nullif(l_quantity, 1)) AS least FROM lineitem GROUP BY 1", lambda t: rounded(t.lineitem.group_by("l_returnflag").summarise(average=mean(if_else(c.l_quantity != 25, c.l_quantity)), least=min_(if_else(c.l_quantity != 1, c.l_quantity))), "average", digits=6))
plain("summarise_sd_single", "SELECT n_nationkey, stddev_samp(n_regionkey) AS x FROM nation GROUP BY n_nationkey", lambda t: t.nation.group_by("n_nationkey").summarise(x=sd("n_regionkey")))
plain("having_filter", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600", lambda t: t.lineitem.group_by("l_suppkey").summarise(n=n()).filter(c.n > 600))
plain("group_by_ungroup", "SELECT count(*) AS n FROM nation", lambda t: t.nation.group_by("n_regionkey").ungroup().summarise(n=n()))

# --- arrange --------------------------------------------------------------------------------------------------------------

plain("arrange_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey", lambda t: t.customer.select("c_custkey", "c_acctbal").arrange("c_acctbal", "c_custkey"))
plain("arrange_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", lambda t: t.customer.select("c_custkey", "c_acctbal").arrange(desc("c_acctbal"), "c_custkey"))
plain("arrange_mixed", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey", lambda t: t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").arrange("o_orderstatus", -c.o_totalprice, "o_orderkey"))
plain("arrange_nulls", "SELECT s_suppkey, x FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS x FROM supplier) ORDER BY x ASC NULLS LAST, s_suppkey", lambda t: t.supplier.mutate(x=if_else(c.s_suppkey % 3 != 0, c.s_acctbal)).select("s_suppkey", "x").arrange("x", "s_suppkey"))
plain("arrange_nulls_desc", "SELECT s_suppkey, x FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS x FROM supplier) ORDER BY x DESC NULLS FIRST, s_suppkey", lambda t: t.supplier.mutate(x=if_else(c.s_suppkey % 3 != 0, c.s_acctbal)).select("s_suppkey", "x").arrange(desc("x"), "s_suppkey"))
plain("arrange_by_group", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name", lambda t: t.nation.group_by("n_regionkey").arrange("n_name", desc("n_regionkey"), by_group=True))
plain("arrange_stable", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey, n_nationkey", lambda t: arrange(t.nation.select("n_nationkey", "n_regionkey").arrange("n_nationkey"), "n_regionkey"))
plain("arrange_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda t: t.orders.select("o_orderkey", "o_totalprice").arrange(desc("o_totalprice"), "o_orderkey").head(10))



def placed(frame: Frame) -> Frame:
    """All rows of a sorted table with their places."""
    return tbl(position(frame.df, "place")[0])


def whole(name: str, columns: str, table: str, order: str, f: Callable[[Tables], Frame]) -> None:
    """Whole tables in order: the places show the order, and no row is left out."""
    plain(name, f"SELECT {columns}, row_number() OVER (ORDER BY {order}) - 1 AS place FROM {table}", lambda t: placed(f(t)))


_some = "(SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS x FROM supplier)"
_some_null = lambda t: t.supplier.mutate(x=if_else(c.s_suppkey % 3 != 0, c.s_acctbal)).select("s_suppkey", "x")
whole("arrange_mixed_whole", "o_orderkey, o_orderstatus, o_totalprice", "orders", "o_orderstatus, o_totalprice DESC, o_orderkey", lambda t: t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").arrange("o_orderstatus", -c.o_totalprice, "o_orderkey"))
whole("arrange_nulls_whole", "s_suppkey, x", _some, "x ASC NULLS LAST, s_suppkey", lambda t: _some_null(t).arrange("x", "s_suppkey"))
whole("arrange_nulls_desc_whole", "s_suppkey, x", _some, "x DESC NULLS FIRST, s_suppkey", lambda t: _some_null(t).arrange(desc("x"), "s_suppkey"))
whole("arrange_by_group_whole", "n_nationkey, n_name, n_regionkey", "nation", "n_regionkey DESC, n_name", lambda t: t.nation.group_by("n_regionkey").arrange("n_name", desc("n_regionkey"), by_group=True))
whole("arrange_stable_whole", "n_nationkey, n_regionkey", "nation", "n_regionkey, n_nationkey", lambda t: arrange(t.nation.select("n_nationkey", "n_regionkey").arrange("n_nationkey"), "n_regionkey"))

for _name, _table, _key, _columns in (("string", "customer", "c_mktsegment", "c_custkey, c_mktsegment"), ("date", "orders", "o_orderdate", "o_orderkey, o_orderdate")):
    whole(f"arrange_{_name}", _columns, _table, f"{_key} DESC, {_columns.split(',')[0]}", lambda t, table=_table, key=_key, columns=_columns: getattr(t, table).select(*columns.split(", ")).arrange(desc(key), columns.split(",")[0]))
whole("arrange_boolean", "p_partkey, big", "(SELECT p_partkey, p_size > 25 AS big FROM part)", "big, p_partkey DESC", lambda t: t.part.mutate(big=c.p_size > 25).select("p_partkey", "big").arrange("big", desc("p_partkey")))

# --- joins ----------------------------------------------------------------------------------------------------------------

_region = lambda t: t.region.filter(c.r_regionkey > 1)
_nation = lambda t: t.nation.filter(c.n_regionkey < 4).select("n_nationkey", "n_name", "n_regionkey")
for _kind, _verb in (("inner", inner_join), ("left", left_join), ("right", right_join), ("full", full_join)):
    plain(
        f"join_{_kind}",
        f"SELECT n_nationkey, n_name, {'r_regionkey' if _kind == 'right' else 'coalesce(n_regionkey, r_regionkey)' if _kind == 'full' else 'n_regionkey'} AS n_regionkey, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 4) {_kind} JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey",
        lambda t, verb=_verb: verb(_nation(t), _region(t), {"n_regionkey": "r_regionkey"}),
    )
plain("join_multi_key", "SELECT l_orderkey, l_linenumber, l_suppkey, n FROM lineitem JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_suppkey)", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").inner_join(t.lineitem.group_by("l_orderkey", "l_suppkey").summarise(n=n()).filter(c.n > 1), ["l_orderkey", "l_suppkey"]))
plain("join_renamed_key", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", lambda t: t.orders.select("o_orderkey", "o_custkey").left_join(t.customer.select("c_custkey", "c_name"), {"o_custkey": "c_custkey"}))
plain("join_natural", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)", lambda t: t.documents.select("doc_id", "n_chars").inner_join(t.labels))
plain("join_suffix", "SELECT a.n_regionkey, a.n_name AS \"n_name.x\", b.n_name AS \"n_name.y\" FROM nation a JOIN nation b USING (n_regionkey)", lambda t: t.nation.select("n_regionkey", "n_name").inner_join(t.nation.select("n_regionkey", "n_name"), "n_regionkey"))
plain("join_keep", "SELECT a.n_nationkey AS \"n_nationkey.x\", a.n_name, b.n_nationkey AS \"n_nationkey.y\", b.n_regionkey FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey > 5) b ON a.n_nationkey = b.n_nationkey", lambda t: t.nation.select("n_nationkey", "n_name").filter(c.n_nationkey < 15).full_join(t.nation.select("n_nationkey", "n_regionkey").filter(c.n_nationkey > 5), "n_nationkey", keep=True))
plain("join_mixed_types", "SELECT p_partkey, p_size, s_name FROM part JOIN supplier ON p_size = s_suppkey", lambda t: t.part.select("p_partkey", "p_size").inner_join(t.supplier.select("s_suppkey", "s_name"), {"p_size": "s_suppkey"}))
_keyed = "(SELECT n_nationkey AS {0}, nullif(n_regionkey, 2) AS k FROM nation)"
_null_key = lambda t, name: t.nation.mutate(k=if_else(c.n_regionkey != 2, c.n_regionkey)).select(**{name: "n_nationkey", "k": "k"})
plain("join_null_keys", f"SELECT x, a.k, y FROM {_keyed.format('x')} a JOIN {_keyed.format('y')} b ON a.k IS NOT DISTINCT FROM b.k", lambda t: _null_key(t, "x").inner_join(_null_key(t, "y"), "k"))
plain("join_null_keys_never", f"SELECT x, a.k, y FROM {_keyed.format('x')} a LEFT JOIN {_keyed.format('y')} b ON a.k = b.k", lambda t: _null_key(t, "x").left_join(_null_key(t, "y"), "k", na_matches="never"))
plain("join_many_to_many", "SELECT c_custkey, c_nationkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey", lambda t: t.customer.select("c_custkey", "c_nationkey").inner_join(t.supplier.select("s_suppkey", "s_nationkey"), {"c_nationkey": "s_nationkey"}, relationship="many-to-many"))
plain("join_chain", "SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", lambda t: t.customer.select("c_custkey", "c_nationkey").inner_join(t.nation, {"c_nationkey": "n_nationkey"}).inner_join(t.region, {"n_regionkey": "r_regionkey"}))
plain("join_ordered", "SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", lambda t: inner_join(t.nation.select("n_nationkey", "n_regionkey"), t.region, {"n_regionkey": "r_regionkey"}, ordered=True))

# --- bind -----------------------------------------------------------------------------------------------------------------

plain("bind_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 3", lambda t: bind_rows(t.nation.filter(c.n_regionkey == 1).select("n_nationkey", "n_name"), t.nation.filter(c.n_regionkey != 3).select("n_name", "n_nationkey")))
plain("bind_rows_missing", "SELECT r_regionkey, r_name, CAST(NULL AS INT) AS n_nationkey FROM region UNION ALL SELECT n_regionkey, NULL, n_nationkey FROM nation", lambda t: bind_rows(t.region, t.nation.select(r_regionkey="n_regionkey", n_nationkey="n_nationkey")))
plain("bind_rows_promote", "SELECT CAST(n_nationkey AS DOUBLE) AS x, CAST(n_nationkey AS VARCHAR) AS y FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier", lambda t: bind_rows(t.nation.select(x="n_nationkey").mutate(y=F.col("x")), t.supplier.select(x="s_acctbal", y="s_name")))
plain("bind_rows_bool", "SELECT CAST(n_regionkey > 2 AS INT) AS x FROM nation UNION ALL SELECT n_nationkey FROM nation", lambda t: bind_rows(t.nation.mutate(x=c.n_regionkey > 2).select("x"), t.nation.select(x="n_nationkey")))
plain("bind_rows_id", "SELECT 'near' AS part, n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'far', n_name FROM nation WHERE n_regionkey >= 2", lambda t: bind_rows(near=t.nation.filter(c.n_regionkey < 2).select("n_name"), far=t.nation.filter(c.n_regionkey >= 2).select("n_name"), id="part"))
plain("bind_rows_unnamed_id", "SELECT '1' AS part, r_name FROM region UNION ALL SELECT '2', r_name FROM region", lambda t: bind_rows(t.region.select("r_name"), None, t.region.select("r_name"), id="part"))
plain("bind_rows_empty", "SELECT r_regionkey, r_name FROM region", lambda t: bind_rows(t.region, t.region.filter(False)))
plain("bind_rows_times", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS at FROM orders UNION ALL SELECT o_orderkey, o_orderdate FROM orders", lambda t: bind_rows(t.orders.mutate(at=F.to_date("o_orderdate")).select("o_orderkey", "at"), t.orders.select(o_orderkey="o_orderkey", at="o_orderdate")))
plain("bind_cols_orders", "SELECT a.o_orderkey, a.o_totalprice, b.o_custkey AS other FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) a JOIN (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS i FROM orders) b USING (i)", lambda t: bind_cols(t.orders.arrange("o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice"), t.orders.arrange("o_custkey", "o_orderkey").select(other="o_custkey")))
plain("bind_cols_universal", 'SELECT r_name AS "a.b...1", r_name AS "a.b...2", r_regionkey AS "._key" FROM region', lambda t: (lambda r: bind_cols(r.select(**{"a b": "r_name"}), r.select(**{"a.b": "r_name", "_key": "r_regionkey"}), name_repair="universal"))(t.region.arrange("r_regionkey")))
plain("bind_cols_check_unique", "SELECT r_name, r_regionkey FROM region", lambda t: bind_cols(t.region.arrange("r_regionkey").select("r_name"), t.region.arrange("r_regionkey").select("r_regionkey"), name_repair="check_unique"))
plain("bind_cols", "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS other FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey DESC) AS i FROM nation) b USING (i)", lambda t: bind_cols(t.nation.arrange("n_nationkey").select("n_nationkey", "n_name"), t.nation.arrange(desc("n_nationkey")).select(other="n_nationkey")))
plain("bind_cols_repair", 'SELECT r_name AS "r_name...1", r_name AS "r_name...2", r_regionkey FROM region', lambda t: bind_cols(t.region.arrange("r_regionkey").select("r_name"), t.region.arrange("r_regionkey").select("r_name", "r_regionkey")))

# --- files ----------------------------------------------------------------------------------------------------------------


def _through_file(t: Tables, kind: str) -> Frame:
    """A table written in a format to the shared folder, and read again."""
    frame = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    write(frame, path := shared_folder(t._spark, f"file-{kind}"), kind)
    return read(t._spark, path, kind, schema=frame.schema).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


for _kind in ("parquet", "csv", "json", "orc"):
    plain(f"file_{_kind}", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", lambda t, kind=_kind: _through_file(t, kind))

# --- control and workflows ------------------------------------------------------------------------------------------------

plain("compute_branch", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem WHERE l_quantity > 40 GROUP BY 1", lambda t: (lambda f: bind_rows(f.group_by("l_returnflag").summarise(n=n()), f.group_by("l_linestatus").summarise(n=n()).select(l_returnflag="l_linestatus", n="n")))(compute(t.lineitem.filter(c.l_quantity > 40).select("l_returnflag", "l_linestatus"))))
plain("collapse_barrier", f"SELECT {KEYS} FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.05", lambda t: collapse(_keys(t.lineitem.filter(c.l_quantity > 45))).filter(c.l_discount > 0.05))
plain("mode_switch", "SELECT n_nationkey, n_name FROM nation", lambda t: tbl(t.nation.df, lazy=True).as_eager().select("n_nationkey", "n_name"))


@query(
    "workflow_complete",
    "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean_price, round(avg(l_extendedprice / l_quantity), 4) AS mean_unit, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n "
    "FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.02 GROUP BY ALL",
)
def workflow_complete(t: Tables) -> Frame:
    """The reference workload's shape: two filters, computed columns, two keys, several aggregates, sorted."""
    kept = t.lineitem.filter(c.l_quantity > 10, c.l_discount > 0.02).mutate(unit=c.l_extendedprice / c.l_quantity, revenue=c.l_extendedprice * (1 - c.l_discount))
    out = kept.group_by("l_returnflag", "l_linestatus").summarise(mean_price=mean("l_extendedprice"), mean_unit=mean("unit"), revenue=sum_("revenue"), n=n())
    return rounded(rounded(out, "mean_price", "mean_unit"), "revenue", digits=2).arrange("l_returnflag", "l_linestatus")


@query(
    "workflow_revenue",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 5 GROUP BY n_name HAVING count(*) > 10",
)
def workflow_revenue(t: Tables) -> Frame:
    lines = t.lineitem.filter(c.l_quantity >= 5).mutate(revenue=c.l_extendedprice * (1 - c.l_discount))
    joined = lines.inner_join(t.supplier, {"l_suppkey": "s_suppkey"}).inner_join(t.nation, {"s_nationkey": "n_nationkey"})
    return rounded(joined.group_by("n_name").summarise(revenue=sum_("revenue"), n=n()).filter(c.n > 10), "revenue", digits=2).arrange(desc("revenue"), "n_name")


@query(
    "workflow_share",
    "WITH a AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS part FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus, sum(o_totalprice) AS whole FROM orders GROUP BY ALL) "
    "SELECT o_orderstatus, o_orderpriority, round(part / whole, 8) AS share FROM a JOIN b USING (o_orderstatus)",
)
def workflow_share(t: Tables) -> Frame:
    parts = t.orders.group_by("o_orderstatus", "o_orderpriority").summarise(part=sum_("o_totalprice"))
    wholes = t.orders.group_by("o_orderstatus").summarise(whole=sum_("o_totalprice"))
    return rounded(parts.inner_join(wholes, "o_orderstatus").mutate(share=c.part / c.whole), "share", digits=8).select("o_orderstatus", "o_orderpriority", "share")
