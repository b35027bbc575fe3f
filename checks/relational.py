"""Sources, projections, joins, aggregates, top-k, set operations and the wide assembly."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import columns as C
from tabloom.functions import missing as M
from tabloom.functions import scalars as S
from tabloom.operators import aggregates as A
from tabloom.operators import joins as J
from tabloom.operators import sampling as SP
from tabloom.operators.ranking import quantile_ranks, row_positions
from tabloom.plans.assemble import Child, assemble_wide
from tabloom.plans.reports import compare_levels
from tabloom.session import cut_lineage, scratch_root
from tabloom.sources import catalog, convert, readers, sinks

from . import GAPS_SQL, ORDERS_CUSTOMER_SQL, Registry, gaps_customer, orders_customer, r, table

reg = Registry()
add = reg.add


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


# --- the flagship: wide assembly --------------------------------------------------------

ASSEMBLE_SQL = """
WITH counts AS (SELECT l_orderkey, count(*) AS lines_count FROM lineitem GROUP BY 1),
stats AS (
  SELECT l_orderkey, count(l_extendedprice) AS price_count, avg(l_extendedprice) AS price_mean,
         stddev_samp(l_extendedprice) AS price_std, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max
  FROM lineitem GROUP BY 1),
items AS (
  SELECT l_orderkey, {cells} FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_mktsegment, n.n_name,
       round(c.c_acctbal, 2) AS c_acctbal, counts.lines_count, stats.price_count,
       round(price_mean, 6) AS price_mean, round(price_std, 6) AS price_std, price_min, price_max,
       {cols}
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN counts ON o.o_orderkey = counts.l_orderkey
LEFT JOIN stats ON o.o_orderkey = stats.l_orderkey
LEFT JOIN items ON o.o_orderkey = items.l_orderkey
""".format(
    cells=", ".join(f"avg(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS q{i}" for i in range(1, 8)),
    cols=", ".join(f"round(q{i}, 6) AS qty_item_{i}" for i in range(1, 8)),
)


@add("assemble_wide", ASSEMBLE_SQL)
def assemble(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, lines = table(spark, d, "nation"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    lines = lines.withColumnRenamed("l_linenumber", "item")
    wide = assemble_wide(
        orders,
        [
            (customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], "_cust"),
            (nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], "_nation"),
        ],
        children=[
            Child("lines", lines.select("o_orderkey"), ["o_orderkey"]),
            Child("price", lines.select("o_orderkey", "l_extendedprice"), ["o_orderkey"], value="l_extendedprice"),
            Child("qty", lines.select("o_orderkey", "item", "l_quantity"), ["o_orderkey"], "item", "l_quantity"),
        ],
    )
    return wide.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_mktsegment", "n_name", r("c_acctbal", 2).alias("c_acctbal"),
        "lines_count", "price_count", r("price_mean").alias("price_mean"), r("price_std").alias("price_std"),
        "price_min", "price_max", *[r(f"qty_item_{i}").alias(f"qty_item_{i}") for i in range(1, 8)],
    )


@add(
    "assemble_fan_out",
    """
SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_quantity, s.s_name, e.events_count
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN (SELECT user_id, count(*) AS events_count FROM events GROUP BY 1) e ON o.o_custkey = e.user_id
""",
)
def assemble_fan_out(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", F.col("l_suppkey").alias("s_suppkey")
    )
    wide = assemble_wide(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        fan_out={
            "lines": (lines, ["o_orderkey", "no_such_key"]),
            "supplier": (table(spark, d, "supplier"), ["s_suppkey"]),
            "unrelated": (table(spark, d, "region"), ["r_regionkey"]),
        },
        children=[Child("events", table(spark, d, "events").withColumnRenamed("user_id", "o_custkey"), ["o_custkey"])],
        only_spine_keys=True,
    )
    return wide.select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity", "s_name", "events_count")


@add(
    "assemble_hot_keys",
    """
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, f.flag_count, p.p_brand, s.s_name, c.supplied_count
FROM lineitem l LEFT JOIN (SELECT l_returnflag, count(*) AS flag_count FROM lineitem GROUP BY 1) f USING (l_returnflag)
LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN (SELECT l_suppkey, count(*) AS supplied_count FROM lineitem GROUP BY 1) c ON l.l_suppkey = c.l_suppkey
""",
)
def assemble_hot_keys(spark, d):
    """A spine on which each return flag holds about a third of the rows."""
    li = table(spark, d, "lineitem")
    wide = assemble_wide(
        li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"),
        [
            (table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], "_part"),
            (table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"], "_supp"),
        ],
        children=[
            Child("flag", li.select("l_returnflag"), ["l_returnflag"]),
            Child("supplied", li.select("l_suppkey"), ["l_suppkey"]),
        ],
        spread=["l_orderkey", "l_linenumber", "l_partkey"],
    )
    return wide.select("l_orderkey", "l_linenumber", "l_returnflag", "flag_count", "p_brand", "s_name", "supplied_count")


# --- sources and sinks ------------------------------------------------------------------


@add("read_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def read_parquet(spark, d):
    df = readers.read_table(spark, f"{d}/lineitem.parquet")
    return df.where("l_shipdate >= timestamp_ntz'2000-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@add("resolve_table", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def resolve_table(spark, d):
    assert readers.resolve_table(spark, d, "no_such_table", on_missing="none") is None
    return readers.resolve_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@add("default_source", "SELECT o_orderkey, o_totalprice FROM orders")
def default_source(spark, d):
    return readers.default_source(spark, d, fallback="orders").select("o_orderkey", "o_totalprice")


@add(
    "csv_conversion",
    """
SELECT 'customer' AS name, count(*) AS n_rows, round(sum(c_acctbal), 2) AS total, max(c_name) AS last_name FROM customer
UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2), max(s_name) FROM supplier
UNION ALL SELECT 'documents', count(*), sum(length(text)), max(md5(text)) FROM documents
UNION ALL SELECT 'conversations', count(*), sum(length(text)), max(md5(text)) FROM conversations
""",
)
def csv_conversion(spark, d):
    """CSV export (one of them gzipped), conversion to Parquet, read back."""
    base = scratch(spark)
    names = {"customer": "c", "supplier": "s", "documents": None, "conversations": None}
    for name in names:
        out = table(spark, d, name).write.option("header", True).option("escape", '"')
        out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        if name == "supplier":
            out = out.option("compression", "gzip")
        out.csv(f"{base}/csv/{name}.csv" + (".gz" if name == "supplier" else ""))
    report = convert.convert_tables(spark, f"{base}/csv", f"{base}/parquet")
    assert report.where("status != 'converted' OR parquet_bytes <= 0 OR pct_smaller IS NULL").count() == 0
    again = convert.convert_tables(spark, f"{base}/csv", f"{base}/parquet")
    assert again.where("status != 'skipped'").count() == 0
    parts = [
        readers.read_table(spark, f"{base}/parquet/{n}.parquet").agg(
            F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"),
            (F.round(F.sum(f"{p}_acctbal"), 2) if p else F.sum(F.length("text")).cast("double")).alias("total"),
            F.max(f"{p}_name" if p else F.md5("text")).alias("last_name"),
        )
        for n, p in names.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@add("scan_all_columns", "SELECT * FROM lineitem")
def scan_all_columns(spark, d):
    return readers.read_table(spark, f"{d}/lineitem.parquet")


@add(
    "csv_scan",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM lineitem GROUP BY 1, 2""",
)
def csv_scan(spark, d):
    """Line items written as CSV and read back whole."""
    path = f"{scratch(spark)}/lineitem.csv"
    lines = table(spark, d, "lineitem")
    lines.write.option("header", True).csv(path)
    back = readers.read_csv(spark, path, lines.schema, multiline=False)
    return back.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


STAR = (
    catalog.TableSpec("customer", "core", ("c_custkey",)),
    catalog.TableSpec("orders", "core", ("o_custkey", "o_orderkey")),
    catalog.TableSpec("lineitem", "event", ("l_orderkey",), "l_linenumber", "l_quantity"),
    catalog.TableSpec("events", "event", ("user_id",), "event_type", "value"),
    catalog.TableSpec("part", "dictionary", ("p_partkey",)),
    catalog.TableSpec("not_there", "dictionary", ("k",)),
)


@add(
    "catalog_discovery",
    """
SELECT 'customer' AS name, 'core' AS role, count(*) AS n_rows FROM customer
UNION ALL SELECT 'orders', 'core', count(*) FROM orders
UNION ALL SELECT 'lineitem', 'event', count(*) FROM lineitem
UNION ALL SELECT 'part', 'dictionary', count(*) FROM part
""",
)
def catalog_discovery(spark, d):
    found = catalog.discover(spark, d, STAR, exclude=["events"], views=False)
    roles = {s.name: s.role for s in STAR}
    parts = [
        df.agg(F.lit(n).alias("name"), F.lit(roles[n]).alias("role"), F.count(F.lit(1)).alias("n_rows"))
        for n, df in found.items()
    ]
    return A.union_rows(*parts)


@add("preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def preview(spark, d):
    return sinks.preview(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@add(
    "column_manifest",
    "SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS name, n FROM information_schema.columns JOIN ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    + ") ON column_name = feature WHERE table_name = 'orders'",
)
def column_manifest(spark, d):
    """Position and name of every column with its number of values."""
    orders = table(spark, d, "orders")
    filled = C.validity(orders, orders.columns).select(F.col("feature").alias("name"), "n")
    return sinks.column_manifest(orders).join(filled, "name").select("position", "name", "n")


@add(
    "result_bundle",
    "SELECT 'shape' AS result, count(*) AS n FROM part UNION ALL SELECT 'brands', count(DISTINCT p_brand) FROM part",
)
def result_bundle(spark, d):
    part, base = table(spark, d, "part"), scratch(spark)
    bundle = {"shape": part, "brands": J.distinct_keys(part, "p_brand"), "absent": None}
    paths = sinks.write_results(bundle, base)
    parts = [
        spark.read.parquet(p).agg(F.lit(name).alias("result"), F.count(F.lit(1)).alias("n"))
        for p, name in zip(paths, ("shape", "brands"))
    ]
    return parts[0].unionByName(parts[1])


# --- projections, filters, scalars ------------------------------------------------------


@add(
    "numeric_projection",
    "SELECT p_partkey, p_size, p_retailprice FROM part",
)
def numeric_projection(spark, d):
    part = table(spark, d, "part")
    return part.select(*C.numeric_columns(part))


@add(
    "low_cardinality",
    """
SELECT * FROM (
  SELECT 'o_orderstatus' AS feature, true AS kept, count(DISTINCT o_orderstatus) AS levels FROM orders
  UNION ALL SELECT 'o_orderpriority', true, count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'c_mktsegment', true, count(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'p_brand', true, count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'p_type', true, count(DISTINCT p_type) FROM part)
""",
)
def low_cardinality(spark, d):
    rows = []
    for name in ("orders", "customer", "part"):
        df = table(spark, d, name)
        kept, _ = C.low_cardinality_cols(df, C.categorical_columns(df, ["p_name"]), 50)
        levels = C.cardinalities(df, kept)
        rows += [(c, True, levels[c]) for c in kept]
    return spark.createDataFrame(rows, "feature string, kept boolean, levels bigint")


@add(
    "column_validity",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT 'acct' AS feature, count(acct) AS n, round(count(acct) / count(*)::DOUBLE, 6) AS filled,
       count(DISTINCT acct) > 1 AS varies FROM oc
UNION ALL SELECT 'price', count(price), round(count(price) / count(*)::DOUBLE, 6), count(DISTINCT price) > 1 FROM oc
UNION ALL SELECT 'one', count(*), 1.0, false FROM oc
""",
)
def column_validity(spark, d):
    df = orders_customer(spark, d).withColumn("one", F.lit(1))
    return C.validity(df, ["acct", "price", "one"]).select("feature", "n", r("filled").alias("filled"), "varies")


@add(
    "missing_ratio_filter",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT o_orderkey, acct, price, segment FROM oc
WHERE ((acct IS NULL)::INT + (price IS NULL)::INT + (segment IS NULL)::INT) / 3.0 <= 0.5
""",
)
def missing_ratio_filter(spark, d):
    df = orders_customer(spark, d)
    return M.filter_missing_rows(df, ["acct", "price", "segment"], 0.5).select("o_orderkey", "acct", "price", "segment")


@add(
    "missing_ratio_report",
    f"""WITH {ORDERS_CUSTOMER_SQL}, f AS (
  SELECT ((acct IS NULL)::INT + (price IS NULL)::INT + (segment IS NULL)::INT) / 3.0 > 0.5 AS bad FROM oc)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS n_filtered,
       round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE * 100, 6) AS pct_filtered FROM f
""",
)
def missing_ratio_report(spark, d):
    return M.missing_filter_report(orders_customer(spark, d), ["acct", "price", "segment"], 0.5)


@add(
    "complete_rows",
    f"WITH {ORDERS_CUSTOMER_SQL} SELECT o_orderkey, acct, price FROM oc WHERE acct IS NOT NULL AND price IS NOT NULL",
)
def complete_rows(spark, d):
    return M.drop_incomplete(orders_customer(spark, d), ["acct", "price"]).select("o_orderkey", "acct", "price")


@add(
    "missing_to_category",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT coalesce(segment, 'missing') AS level, count(*) AS n FROM oc GROUP BY 1
""",
)
def missing_to_category(spark, d):
    df = orders_customer(spark, d).select(M.missing_to_category("segment").alias("level"))
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@add(
    "scalar_functions",
    """
SELECT l_orderkey, l_linenumber,
       greatest(-1.0::DOUBLE, least(1.0::DOUBLE, l_discount * 20 - 1)) AS clipped,
       CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half_even,
       round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 6) AS ratio,
       round(sqrt(l_extendedprice), 6) AS root, abs(l_quantity - 25) AS off,
       l_discount > 0.05 AND l_quantity < 10 AS in_range, CAST(l_linenumber AS DOUBLE) AS as_double
FROM lineitem
""",
)
def scalar_functions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        S.clip(F.col("l_discount") * 20 - 1).alias("clipped"),
        S.half_even_long(F.col("l_quantity") / 2).alias("half_even"),
        r(S.safe_div(F.col("l_discount"), F.col("l_tax"))).alias("ratio"),
        r(F.sqrt("l_extendedprice")).alias("root"), F.abs(F.col("l_quantity") - 25).alias("off"),
        ((F.col("l_discount") > 0.05) & (F.col("l_quantity") < 10)).alias("in_range"),
        S.numeric_cast(F.col("l_linenumber")).alias("as_double"),
    )


@add(
    "array_argmax",
    """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at,
       round(list_max(list_transform(embedding, lambda x: greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x::DOUBLE)))), 6) AS top
FROM embeddings
""",
)
def array_argmax(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id", S.argmax_index(F.col("embedding")).alias("at"),
        r(F.array_max(S.clip_array(F.col("embedding").cast("array<double>"), -0.1, 0.1))).alias("top"),
    )


@add("realign_columns", "SELECT c_custkey, 0.0::DOUBLE AS absent, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer")
def realign_columns(spark, d):
    spec = {"absent": "double", "c_nationkey": "double", "c_acctbal": "double"}
    return C.realign(table(spark, d, "customer"), spec, keep=["c_custkey"])


@add(
    "role_projection",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT o_totalprice, c_nationkey, acct, price, o_orderstatus, segment FROM oc""",
)
def role_projection(spark, d):
    """Numeric and listed categorical columns; ids, dates and names excluded."""
    df = orders_customer(spark, d)
    hidden = ["o_orderkey", "o_custkey", "c_custkey", "o_orderdate", "c_name", "c_acctbal", "o_orderpriority", "c_mktsegment"]
    nums, cats, _ = C.select_roles(df, ["o_orderstatus", "segment", "not_there"], ["c_nationkey"], hidden)
    return df.select(*nums, *cats)


@add(
    "fill_prefix_drop",
    """SELECT c.c_custkey, coalesce(n, 0) AS orders_n, coalesce(total, 0) AS orders_total FROM customer c LEFT JOIN
(SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""",
)
def fill_prefix_drop(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last")
    )
    side = C.drop_columns(C.prefix_columns(o, "orders", ["c_custkey"]), ["orders_last"])
    joined = J.left_join(table(spark, d, "customer").select("c_custkey"), side, "c_custkey")
    return M.fill_zero(joined, ["orders_n", "orders_total"])


# --- joins ------------------------------------------------------------------------------


@add(
    "left_join_suffix",
    """
SELECT s.s_suppkey, s.s_name, s.s_nationkey, c.c_nationkey, s.s_acctbal AS acctbal, c.c_acctbal AS acctbal_cust
FROM supplier s LEFT JOIN customer c ON s.s_suppkey = c.c_custkey
""",
)
def left_join_suffix(spark, d):
    s = table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "k", "s_acctbal": "acctbal"})
    c = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "k", "c_acctbal": "acctbal"})
    out = J.left_join(s, c, "k", "_cust")
    return out.select(F.col("k").alias("s_suppkey"), "s_name", "s_nationkey", "c_nationkey", "acctbal", "acctbal_cust")


@add(
    "left_join_composite",
    """SELECT e.event_id, e.user_id, e.event_type, s.n, s.top FROM events e LEFT JOIN
(SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events WHERE value > 20 GROUP BY 1, 2) s
ON e.user_id = s.user_id AND e.event_type = s.event_type""",
)
def left_join_composite(spark, d):
    e = table(spark, d, "events")
    s = e.where("value > 20").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return J.left_join(e.select("event_id", "user_id", "event_type"), s, ["user_id", "event_type"])


@add(
    "left_join_null_keys",
    f"""WITH {GAPS_SQL},
left_side AS (SELECT c_custkey, CASE WHEN acct IS NOT NULL THEN c_mktsegment END AS seg FROM gc),
right_side AS (SELECT seg, count(*) AS n FROM left_side GROUP BY 1)
SELECT l.c_custkey, l.seg, r.n FROM left_side l LEFT JOIN right_side r ON l.seg IS NOT DISTINCT FROM r.seg
""",
)
def left_join_null_keys(spark, d):
    c = gaps_customer(spark, d)
    left = c.select("c_custkey", F.when(F.col("acct").isNotNull(), F.col("c_mktsegment")).alias("seg"))
    right = left.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    return J.left_join(left, right, "seg", null_keys_match=True)


@add(
    "outer_combine",
    """
SELECT coalesce(c.c_custkey, e.user_id) AS k, c.n_orders, e.n_events
FROM (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) c
FULL OUTER JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) e ON c.c_custkey = e.user_id
""",
)
def outer_combine(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n_events"))
    return J.outer_combine({"orders": o, "events": e}, [["k", "sub"], ["k"]])


@add(
    "zip_by_order",
    """
SELECT coalesce(a.position, b.position) AS position, a.c_custkey, b.p_partkey FROM
 (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_custkey FROM customer) a
FULL OUTER JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_partkey FROM part) b
ON a.position = b.position
""",
)
def zip_by_order(spark, d):
    tables = {"customer": table(spark, d, "customer").select("c_custkey"), "part": table(spark, d, "part").select("p_partkey")}
    return J.outer_combine(tables, [["none"]], {"customer": "c_custkey", "part": "p_partkey"})


@add(
    "dictionary_lookup",
    """
SELECT l_orderkey, l_linenumber, p_brand, p_type, s_name, n_name FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
""",
)
def dictionary_lookup(spark, d):
    li = table(spark, d, "lineitem")
    out = J.lookup(li, table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    out = J.lookup(out, table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
    out = J.lookup(out, table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return out.select("l_orderkey", "l_linenumber", "p_brand", "p_type", "s_name", "n_name")


@add(
    "skewed_lookup",
    """
SELECT l_orderkey, l_linenumber, l_returnflag, n, round(mean_qty, 6) AS mean_qty FROM lineitem
LEFT JOIN (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS mean_qty FROM lineitem GROUP BY 1) ON l_returnflag = f
""",
)
def skewed_lookup(spark, d):
    """Every key holds about a third of the rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    by_flag = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_qty"))
    out = J.skew_safe_left_join(
        li.drop("l_quantity"), by_flag, ["l_returnflag"], ["l_orderkey", "l_linenumber"], J.hot_keys(li, ["l_returnflag"])
    )
    return out.withColumn("mean_qty", r("mean_qty"))


@add(
    "semi_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def semi_filter(spark, d):
    spine = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return J.semi_filter(table(spark, d, "lineitem"), spine, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@add("distinct_keys", f"WITH {ORDERS_CUSTOMER_SQL} SELECT DISTINCT segment FROM oc WHERE segment IS NOT NULL")
def distinct_keys(spark, d):
    return J.distinct_keys(orders_customer(spark, d), "segment")


# --- aggregates -------------------------------------------------------------------------


@add(
    "child_counts",
    f"WITH {ORDERS_CUSTOMER_SQL} SELECT segment, o_orderstatus, count(*) AS orders_count FROM oc WHERE segment IS NOT NULL GROUP BY 1, 2",
)
def child_counts(spark, d):
    return A.child_counts(orders_customer(spark, d), ["segment", "o_orderstatus"], "orders")


@add(
    "child_stats",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT c_custkey, count(price) AS o_count, round(avg(price), 6) AS o_mean, round(stddev_samp(price), 6) AS o_std,
       min(price) AS o_min, max(price) AS o_max FROM oc GROUP BY 1
""",
)
def child_stats(spark, d):
    out = A.child_stats(orders_customer(spark, d), ["c_custkey"], "price", "o")
    return out.withColumns({"o_mean": r("o_mean"), "o_std": r("o_std")})


@add(
    "item_means",
    "SELECT user_id, event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
)
def item_means(spark, d):
    return A.item_means(table(spark, d, "events"), ["user_id"], "event_type", "value").withColumn("mean_value", r("mean_value"))


@add(
    "pivot_items",
    """
SELECT l_orderkey, 'qty_l_suppkey_' || l_suppkey AS feature, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_suppkey IN
  (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 50)
GROUP BY l_orderkey, l_suppkey HAVING count(l_quantity) > 0
""",
)
def pivot_items(spark, d):
    li = table(spark, d, "lineitem")
    out = A.pivot_items(li, ["l_orderkey"], "l_suppkey", "l_quantity", "qty", 50)
    cells = [c for c in out.columns if c != "l_orderkey"]
    return A.unpivot_values(out, ["l_orderkey"], cells).withColumn("value", r("value"))


@add("item_frequency", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def item_frequency(spark, d):
    return A.item_frequency(table(spark, d, "lineitem"), "l_suppkey")


@add("top_items", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 50")
def top_items(spark, d):
    return A.top_items(table(spark, d, "lineitem"), "l_suppkey", 50)


@add(
    "only_top_items",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN
(SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 50)""",
)
def only_top_items(spark, d):
    return A.only_top_items(table(spark, d, "lineitem"), "l_suppkey", 50).select("l_orderkey", "l_linenumber", "l_suppkey")


@add(
    "distinct_counts",
    """SELECT 'l_orderkey' AS feature, count(DISTINCT l_orderkey) AS n FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem""",
)
def distinct_counts(spark, d):
    n = C.cardinalities(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])
    return spark.createDataFrame(list(n.items()), "feature string, n bigint")


@add(
    "value_shares",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT segment AS level, count(*) AS n, round(count(*) / (SELECT count(segment) FROM oc)::DOUBLE, 6) AS share
FROM oc WHERE segment IS NOT NULL GROUP BY 1 ORDER BY n DESC, level LIMIT 5
""",
)
def value_shares(spark, d):
    return A.value_shares(orders_customer(spark, d), "segment", 5).withColumn("share", r("share"))


@add("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def table_shape(spark, d):
    return A.table_shape(table(spark, d, "lineitem"))


@add(
    "column_stats",
    f"""WITH {ORDERS_CUSTOMER_SQL}, l AS (
  SELECT 'acct' AS feature, acct AS v FROM oc UNION ALL SELECT 'price', price FROM oc)
SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_pop(v), 6) AS std_pop,
       min(v) AS min, max(v) AS max FROM l GROUP BY 1
""",
)
def column_stats(spark, d):
    out = A.column_stats(orders_customer(spark, d), ["acct", "price"])
    return out.select("feature", "n", r("mean").alias("mean"), r("std").alias("std"), r("std_pop").alias("std_pop"), "min", "max")


@add(
    "group_stats_merge",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean,
round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1, 2""",
)
def group_stats_merge(spark, d):
    """Partial and final aggregation with a handful of very large groups."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"),
        r(F.avg("l_discount")).alias("mean"), r(F.stddev_samp("l_extendedprice"), 4).alias("std"),
    )


@add("sql_group_limit", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, l_orderkey LIMIT 10")
def sql_group_limit(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, l_orderkey LIMIT 10")


# --- set operations, sampling -----------------------------------------------------------


@add(
    "union_rows",
    """SELECT 'customer' AS side, c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_rows(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return A.union_rows(c, s)


@add(
    "unpivot_values",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT o_orderkey, 'acct' AS feature, acct AS value FROM oc WHERE acct IS NOT NULL
UNION ALL SELECT o_orderkey, 'price', price FROM oc WHERE price IS NOT NULL""",
)
def unpivot_values(spark, d):
    return A.unpivot_values(orders_customer(spark, d), ["o_orderkey"], ["acct", "price"])


@add("replicate_rows", "SELECT s_suppkey, CAST(rep AS INTEGER) AS rep FROM supplier, range(5) t(rep)")
def replicate_rows(spark, d):
    return SP.replicate(table(spark, d, "supplier").select("s_suppkey"), 5)


@add(
    "label_distribution",
    "SELECT quality AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS prob FROM labels GROUP BY 1",
)
def label_distribution(spark, d):
    return SP.label_distribution(table(spark, d, "labels"), "quality").withColumn("prob", r("prob"))


@add(
    "sample_rows",
    """SELECT least(1000, count(*)) AS n_rows, least(1000, count(*)) AS n_keys, 0 AS n_changed, true AS spread FROM orders""",
)
def sample_rows(spark, d):
    """Facts every sample of 1000 must show: size, distinct keys, untouched rows, a mean key within 6 errors."""
    orders = table(spark, d, "orders")
    sample = SP.load_sample(spark, f"{d}/orders.parquet", ["o_orderkey"], 1000)
    whole = orders.agg(F.avg("o_orderkey"), F.stddev("o_orderkey")).first()
    facts = sample.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"),
        (F.abs(F.avg("o_orderkey") - whole[0]) <= 6 * whole[1] / 1000**0.5).alias("spread"),
    )
    changed = sample.exceptAll(orders).agg(F.count(F.lit(1)).cast("int").alias("n_changed"))
    return facts.join(F.broadcast(changed))


@add(
    "split_rows",
    """SELECT split, count(*) AS total, true AS near_share FROM (SELECT unnest(['train', 'val', 'test']) AS split), orders GROUP BY 1""",
)
def split_rows(spark, d):
    """Splits with all rows between them and shares within 6 standard errors."""
    parts = SP.split_rows(table(spark, d, "orders"), ["o_orderkey"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("split") == "train", 0.6).otherwise(0.2)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    near = F.abs(F.col("n") / total - share) <= 6 * F.sqrt(share * (1 - share) / total)
    return parts.select("split", total.alias("total"), near.alias("near_share"))


@add(
    "shuffle_rows",
    """SELECT count(*) AS n, count(*) AS n_positions, 0 AS first_position, count(*) - 1 AS last_position, true AS unordered FROM supplier""",
)
def shuffle_rows(spark, d):
    """A permutation: every position once, and no rank correlation of position and key beyond 6 errors."""
    out = SP.shuffle_rows(table(spark, d, "supplier"), ["s_suppkey"], position="position")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_positions"), F.min("position").alias("first_position"),
        F.max("position").alias("last_position"), (F.abs(F.corr("position", "s_suppkey")) <= 6 / F.sqrt(F.count(F.lit(1)))).alias("unordered"),
    )


@add(
    "reports_after_fan_out",
    """WITH w AS (SELECT o.o_orderkey, l.l_linenumber, o.o_totalprice, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
k AS (SELECT o_orderkey, l_linenumber, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM w)
SELECT o_orderkey, l_linenumber, round(r / count(*) OVER () * 100, 6) AS price_rank FROM k""",
)
def reports_after_fan_out(spark, d):
    """Orders multiplied by their lines: the row id the assembly adds carries the ranks."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    wide = cut_lineage(assemble_wide(orders, fan_out={"lines": (lines, ["o_orderkey"])}, row_id="row_id"))
    ranks = quantile_ranks(wide, ["row_id"], ["o_totalprice"]).withColumnRenamed("o_totalprice", "price_rank")
    return wide.join(ranks, "row_id").select("o_orderkey", "l_linenumber", r("price_rank").alias("price_rank"))


@add(
    "row_positions_large",
    "SELECT o_orderkey + 1152921504606846976 AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders",
)
def row_positions_large(spark, d):
    return row_positions(table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(1 << 60)).alias("k")), "k")


@add(
    "draw_labels",
    "SELECT o_orderstatus AS label, true AS near_share FROM orders GROUP BY 1",
)
def draw_labels(spark, d):
    """Labels in their shares, within 6 standard errors."""
    orders = table(spark, d, "orders")
    probs = {x["label"]: x["prob"] for x in SP.label_distribution(orders, "o_orderstatus").orderBy("label").collect()}
    drawn = SP.draw_labels(orders.select("o_orderkey"), "o_orderkey", probs)
    counts = drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.create_map(*[F.lit(x) for pair in probs.items() for x in pair])[F.col("label")]
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("label", (F.abs(F.col("n") / total - share) <= 6 * F.sqrt(share * (1 - share) / total)).alias("near_share"))


@add(
    "compare_levels",
    """WITH a AS (SELECT o_orderpriority AS level, count(*) / sum(count(*)) OVER () AS share FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
b AS (SELECT o_orderpriority AS level, count(*) / sum(count(*)) OVER () AS share FROM orders
  WHERE o_orderstatus <> 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT coalesce(a.level, b.level) AS level, round(coalesce(a.share, 0), 3) AS "real", round(coalesce(b.share, 0), 3) AS synthetic
FROM a FULL OUTER JOIN b ON a.level = b.level""",
)
def levels_compared(spark, d):
    o = table(spark, d, "orders")
    return compare_levels(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_orderpriority")
