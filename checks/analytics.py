"""Profiles, associations, detectors, joint statistics, encoding and synthesis."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from tabloom.operators import aggregates, associate, detectors, encode, features, flow, gram, joint, neighbors, profile, ranking, rules
from tabloom.plans import reports, synthesize
from tabloom.session import cut_lineage

from . import GAPS_SQL, ORDERS_CUSTOMER_SQL, Registry, gaps_customer, orders_customer, r, table

reg = Registry()
add = reg.add

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_LINES = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in LINE_NUMS) + ")"
LINE_CATS = ["l_returnflag", "l_linestatus", "l_shipyear"]
LINE_CATS_SQL = "lc AS (SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS l_shipyear FROM lineitem)"


def line_cats(spark, d):
    return table(spark, d, "lineitem").withColumn("l_shipyear", F.year("l_shipdate").cast("string"))


# --- univariate -------------------------------------------------------------------------


@add(
    "quantile_ranks",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT o_orderkey,
 round(CASE WHEN acct IS NOT NULL THEN (rank() OVER (ORDER BY acct NULLS LAST) + (count(*) OVER (PARTITION BY acct) - 1) / 2.0)
       / (SELECT count(acct) FROM oc) * 100 END, 6) AS acct,
 round(CASE WHEN price IS NOT NULL THEN (rank() OVER (ORDER BY price NULLS LAST) + (count(*) OVER (PARTITION BY price) - 1) / 2.0)
       / (SELECT count(price) FROM oc) * 100 END, 6) AS price,
 round((rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0)
       / (SELECT count(*) FROM oc) * 100, 6) AS c_nationkey
FROM oc""",
)
def quantile_ranks(spark, d):
    cols = ["acct", "price", "c_nationkey"]
    out = ranking.quantile_ranks(orders_customer(spark, d), ["o_orderkey"], cols)
    return out.select("o_orderkey", *[r(c).alias(c) for c in cols])


@add(
    "exact_quantiles",
    f"""WITH {LONG_LINES}, p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob)
SELECT feature, prob, round(quantile, 6) AS quantile FROM (
  SELECT feature, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob,
         unnest(quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95])) AS quantile FROM l GROUP BY 1)""",
)
def exact_quantiles(spark, d):
    out = ranking.exact_quantiles(table(spark, d, "lineitem"), LINE_NUMS, [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.withColumn("quantile", r("quantile"))


def nan_customer(spark, d):
    """Customers whose negative balances are NaN, as a reader may leave them."""
    c = table(spark, d, "customer")
    return c.withColumn("acct", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(float("nan")))


@add(
    "nan_quantiles",
    f"""WITH {GAPS_SQL}, q AS (SELECT quantile_cont(acct, 0.25) AS q1, quantile_cont(acct, 0.75) AS q3 FROM gc)
SELECT 'acct' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, count(acct) AS n, count(*) FILTER (WHERE acct < q1 - 1.5 * (q3 - q1) OR acct > q3 + 1.5 * (q3 - q1)) AS outlier_count,
 round(avg(acct), 6) AS mean, round(stddev_samp(acct), 6) AS std FROM gc, q GROUP BY q1, q3""",
)
def nan_quantiles(spark, d):
    df = nan_customer(spark, d)
    stats = aggregates.column_stats(df, ["acct"]).select("feature", r("mean").alias("mean"), r("std").alias("std"))
    out = profile.iqr_stats(df, ["acct"]).select("feature", r("q1").alias("q1"), r("q3").alias("q3"), "n", "outlier_count")
    return out.join(stats, "feature")


@add(
    "nan_ranks",
    f"""WITH {GAPS_SQL} SELECT c_custkey, round(CASE WHEN acct IS NOT NULL THEN (rank() OVER (ORDER BY acct NULLS LAST) + (count(*) OVER (PARTITION BY acct) - 1) / 2.0)
 / (SELECT count(acct) FROM gc) * 100 END, 6) AS acct FROM gc""",
)
def nan_ranks(spark, d):
    return ranking.quantile_ranks(nan_customer(spark, d), ["c_custkey"], ["acct"]).withColumn("acct", r("acct"))


@add(
    "nan_associations",
    f"""WITH {GAPS_SQL}, k AS (SELECT c_custkey, c_nationkey, acct, c_mktsegment AS g FROM gc WHERE acct IS NOT NULL),
p AS (SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY acct) + (count(*) OVER (PARTITION BY acct) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS b FROM k)),
s AS (SELECT g, count(*) AS n, avg(acct) AS m, var_pop(acct) * count(*) AS ss FROM k GROUP BY 1),
t AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand FROM s)
SELECT (SELECT spearman FROM p) AS spearman, (SELECT n FROM p)::BIGINT AS n,
 round((sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS f FROM t""",
)
def nan_associations(spark, d):
    df = nan_customer(spark, d)
    rank = associate.corr_matrix(df, ["acct", "c_nationkey"], "spearman", ["c_custkey"]).where("x <> y")
    f = associate.anova_f(df, ["c_mktsegment"], ["acct"])
    return rank.select(r("r").alias("spearman"), "n").join(F.broadcast(f.select(r("f").alias("f"))))


@add(
    "row_positions",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders",
)
def row_positions(spark, d):
    return ranking.row_positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@add(
    "z_scores",
    f"""WITH {ORDERS_CUSTOMER_SQL}
SELECT o_orderkey, round((acct - avg(acct) OVER ()) / stddev_samp(acct) OVER (), 6) AS acct_zscore,
 abs((acct - avg(acct) OVER ()) / stddev_samp(acct) OVER ()) > 2 AS acct_extreme,
 round((price - avg(price) OVER ()) / stddev_samp(price) OVER (), 6) AS price_zscore,
 abs((price - avg(price) OVER ()) / stddev_samp(price) OVER ()) > 2 AS price_extreme FROM oc""",
)
def z_scores(spark, d):
    df = orders_customer(spark, d).withColumn("same", F.lit(3))
    out = profile.z_scores(df, ["acct", "price", "same"], ["o_orderkey"], flag=2.0)
    return out.withColumns({"acct_zscore": r("acct_zscore"), "price_zscore": r("price_zscore")})


@add(
    "standardize",
    f"""SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in LINE_NUMS)}
FROM lineitem""",
)
def standardize(spark, d):
    out = profile.standardize(table(spark, d, "lineitem"), LINE_NUMS, ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: r(c) for c in LINE_NUMS})


IQR_SQL = f"""WITH {LONG_LINES}, x AS (SELECT feature, v FROM l UNION ALL SELECT 'value', value FROM events),
q AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1)"""


@add(
    "iqr_stats",
    f"""WITH {LONG_LINES}, q AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1)
SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
 round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
 count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(*) AS n
FROM l JOIN q USING (feature) GROUP BY feature, q1, q3""",
)
def iqr_stats(spark, d):
    out = profile.iqr_stats(table(spark, d, "lineitem"), LINE_NUMS)
    return out.withColumns({c: r(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")})


@add(
    "box_stats",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events),
w AS (SELECT value, q.*, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events, q)
SELECT 'value' AS feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
 count(*) FILTER (WHERE NOT inside) AS outlier_count FROM w GROUP BY q1, median, q3""",
)
def box_stats(spark, d):
    out = profile.box_stats(table(spark, d, "events"), ["value"])
    return out.withColumns({c: r(c) for c in ("q1", "median", "q3")})


@add(
    "describe_numeric",
    f"""WITH {ORDERS_CUSTOMER_SQL}, l AS (
  SELECT 'acct' AS feature, acct AS v FROM oc UNION ALL SELECT 'price', price FROM oc)
SELECT feature, count(v) AS count, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, round(min(v), 2) AS min,
 round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75,
 round(max(v), 2) AS max FROM l WHERE v IS NOT NULL GROUP BY 1""",
)
def describe_numeric(spark, d):
    return profile.describe_numeric(orders_customer(spark, d), ["acct", "price"])


@add(
    "histogram",
    f"""WITH {LONG_LINES}, b AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
SELECT feature, CAST(least(49, floor((v - lo) / (hi - lo) * 50)) AS BIGINT) AS bin,
 count(*) AS n FROM l JOIN b USING (feature) GROUP BY 1, 2""",
)
def histogram(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), LINE_NUMS, 50).select("feature", "bin", "n")


@add(
    "grid_density",
    f"""WITH {ORDERS_CUSTOMER_SQL}, bo AS (SELECT acct, price FROM oc WHERE acct IS NOT NULL AND price IS NOT NULL),
b AS (SELECT min(acct) AS xl, max(acct) AS xh, min(price) AS yl, max(price) AS yh FROM bo)
SELECT CAST(least(29, floor((acct - xl) / (xh - xl) * 30)) AS BIGINT) AS x_bin,
 CAST(least(29, floor((price - yl) / (yh - yl) * 30)) AS BIGINT) AS y_bin, count(*) AS n FROM bo, b GROUP BY 1, 2""",
)
def grid_density(spark, d):
    return profile.grid_density(orders_customer(spark, d), "acct", "price", 30)


@add(
    "hex_density",
    f"""WITH {ORDERS_CUSTOMER_SQL}, bo AS (SELECT acct, price FROM oc WHERE acct IS NOT NULL AND price IS NOT NULL),
b AS (SELECT min(acct) AS xl, max(acct) AS xh, min(price) AS yl, max(price) AS yh FROM bo),
s AS (SELECT (acct - xl) / ((xh - xl) / 30) AS u, (price - yl) / ((yh - yl) / 17) AS v, xl, xh, yl, yh FROM bo, b),
c AS (SELECT *, (u - round_even(u, 0)) ** 2 + 3 * (v - round_even(v, 0)) ** 2
   < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 AS near FROM s),
h AS (SELECT CASE WHEN near THEN round_even(u, 0) ELSE floor(u) + 0.5 END AS hu,
   CASE WHEN near THEN round_even(v, 0) ELSE floor(v) + 0.5 END AS hv, xl, xh, yl, yh FROM c)
SELECT round(xl + hu * ((xh - xl) / 30), 6) AS cx, round(yl + hv * ((yh - yl) / 17), 6) AS cy, count(*) AS n
FROM h GROUP BY hu, hv, xl, xh, yl, yh""",
)
def hex_density(spark, d):
    out = profile.hex_density(orders_customer(spark, d), "acct", "price", 30)
    return out.select(r("cx").alias("cx"), r("cy").alias("cy"), "n")


@add(
    "rule_counts",
    """SELECT 'negative' AS rule, 'account_number' AS "column", 'violation' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'bmi_over_100', 'bmi', 'extreme', count(*) FROM customer WHERE c_acctbal / 50 > 100
UNION ALL SELECT 'age_over_150', 'age', 'extreme', count(*) FROM customer WHERE c_nationkey * 10 > 150""",
)
def rule_counts(spark, d):
    return rules.rule_counts(ruled(spark, d))


def ruled(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("account_number"), (F.col("c_acctbal") / 50).alias("bmi"),
        (F.col("c_nationkey") * 10).alias("age"), (-F.col("c_nationkey")).alias("percentage"),
    )


@add("rule_flags", "SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS has_violation FROM customer")
def rule_flags(spark, d):
    return rules.rule_flags(ruled(spark, d), ["c_custkey"])


# --- associations -----------------------------------------------------------------------


def corr_sql(cte: str, source: str, cols: list[str], x_of=lambda c: c, stat="corr", name="r", diagonal=True, digits=6) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i if diagonal else i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS x, '{b}' AS y, round({stat}({x_of(b)}, {x_of(a)}), {digits}) AS {name}, "
                f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
            )
    return f"{cte} " + " UNION ALL ".join(parts)


GAP_COLS = ["acct", "price", "c_nationkey", "o_totalprice"]


@add("corr_pearson", corr_sql(f"WITH {ORDERS_CUSTOMER_SQL}", "oc", GAP_COLS))
def corr_pearson(spark, d):
    return associate.corr_matrix(orders_customer(spark, d), GAP_COLS).withColumn("r", r("r"))


@add(
    "corr_square",
    "SELECT x, " + ", ".join(f"max(r) FILTER (WHERE y = '{c}') AS {c}" for c in LINE_NUMS) + " FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE_NUMS for b in LINE_NUMS)
    + ") GROUP BY 1",
)
def corr_square(spark, d):
    pairs = associate.corr_matrix(table(spark, d, "lineitem"), LINE_NUMS).withColumn("r", r("r"))
    return associate.to_matrix(associate.mirror(pairs, "r"), "r", LINE_NUMS)


@add("covariance_pairs", corr_sql("", "lineitem", LINE_NUMS, stat="covar_samp", name="covariance", digits=2))
def covariance_pairs(spark, d):
    out = gram.pearson_pairs(table(spark, d, "lineitem"), LINE_NUMS)
    return out.select("x", "y", r("covariance", 2).alias("covariance"), "n")


def _rank_pair(a: str, b: str) -> str:
    def rk(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return (
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT {rk(a)} AS ra, {rk(b)} AS rb "
        f"FROM oc WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


@add(
    "corr_spearman",
    f"WITH {ORDERS_CUSTOMER_SQL} "
    + " UNION ALL ".join(_rank_pair(a, b) for i, a in enumerate(GAP_COLS) for b in GAP_COLS[i:]),
)
def corr_spearman(spark, d):
    return associate.corr_matrix(orders_customer(spark, d), GAP_COLS, "spearman", ["o_orderkey"]).withColumn("r", r("r"))


@add(
    "corr_kendall",
    f"""WITH {GAPS_SQL}, p AS (
  SELECT 'acct' AS x, 'c_nationkey' AS y, acct AS a, c_nationkey AS b FROM gc
  UNION ALL SELECT 'acct', 'c_custkey', acct, c_custkey FROM gc
  UNION ALL SELECT 'c_nationkey', 'c_custkey', c_nationkey, c_custkey FROM gc),
k AS (SELECT x, y, a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT u.x, u.y, round(sum(sign(u.a - v.a) * sign(u.b - v.b))
  / sqrt(sum(abs(sign(u.a - v.a))) * sum(abs(sign(u.b - v.b)))), 6) AS r,
 (SELECT count(*) FROM k w WHERE w.x = u.x AND w.y = u.y) AS n
FROM k u JOIN k v ON u.x = v.x AND u.y = v.y GROUP BY u.x, u.y""",
)
def corr_kendall(spark, d):
    out = associate.corr_matrix(gaps_customer(spark, d), ["acct", "c_nationkey", "c_custkey"], "kendall")
    return out.withColumn("r", r("r"))


def _kendall_pair(x: str, y: str, few: str, other: str) -> str:
    """Kendall's tau-b of a pair whose side ``few`` has few values: a running count of each along the other side."""
    return f"""SELECT '{x}' AS x, '{y}' AS y, round((n0 - n1 - n2 + n3 - 2 * q) / sqrt((n0 - n1) * (n0 - n2)), 6) AS r, n FROM
 (SELECT count(*) AS n, count(*) * (count(*) - 1) / 2.0 AS n0 FROM lineitem),
 (SELECT sum(c * (c - 1) / 2.0) AS n1 FROM (SELECT count(*) AS c FROM lineitem GROUP BY {few})),
 (SELECT sum(c * (c - 1) / 2.0) AS n2 FROM (SELECT count(*) AS c FROM lineitem GROUP BY {other})),
 (SELECT sum(c * (c - 1) / 2.0) AS n3 FROM (SELECT count(*) AS c FROM lineitem GROUP BY {few}, {other})),
 (SELECT sum(c * (total - coalesce(upto, 0))) AS q FROM (SELECT a, o, c, level, total FROM (SELECT {few} AS a, {other} AS o, count(*) AS c FROM lineitem GROUP BY 1, 2)
   JOIN (SELECT {few} AS level, count(*) AS total FROM lineitem GROUP BY 1) ON level < a) AS t
  ASOF LEFT JOIN (SELECT {few} AS own, {other} AS place, sum(count(*)) OVER (PARTITION BY {few} ORDER BY {other}) AS upto FROM lineitem GROUP BY 1, 2) AS m
   ON t.level = m.own AND t.o >= m.place)"""


FEW_FIRST = ["l_tax", "l_discount", "l_quantity", "l_extendedprice"]  # by their numbers of values


@add(
    "corr_kendall_lines",
    " UNION ALL ".join(
        _kendall_pair(a, b, *sorted((a, b), key=FEW_FIRST.index)) for i, a in enumerate(LINE_NUMS) for b in LINE_NUMS[i + 1 :]
    ),
)
def corr_kendall_lines(spark, d):
    return associate.corr_matrix(table(spark, d, "lineitem"), LINE_NUMS, "kendall").withColumn("r", r("r"))


def _pair_union(cols: list[str], make) -> str:
    return " UNION ALL ".join(make(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :])


CELLS_SQL = f"""{LINE_CATS_SQL}, cells AS ({_pair_union(LINE_CATS, lambda a, b:
  f"SELECT '{a}' AS x, '{b}' AS y, {a} AS vx, {b} AS vy, count(*)::DOUBLE AS o FROM lc GROUP BY {a}, {b}")}),
m AS (SELECT *, sum(o) OVER (PARTITION BY x, y, vx) AS r, sum(o) OVER (PARTITION BY x, y, vy) AS c,
  sum(o) OVER (PARTITION BY x, y) AS n FROM cells)"""


@add("contingency", f"WITH {CELLS_SQL} SELECT x, y, vx AS x_level, vy AS y_level, o::BIGINT AS n FROM cells")
def contingency(spark, d):
    return associate.contingency_table(line_cats(spark, d), LINE_CATS)


@add(
    "cramers_v",
    f"""WITH {CELLS_SQL},
t AS (SELECT x, y, any_value(n) AS n, sum(o * o / (r * c)) - 1 AS phi2, count(DISTINCT vx) AS rr, count(DISTINCT vy) AS kk FROM m GROUP BY 1, 2),
b AS (SELECT x, y, n, greatest(0, phi2 - (kk - 1) * (rr - 1) / (n - 1)) AS phi2,
  rr - (rr - 1) ** 2 / (n - 1) AS rc, kk - (kk - 1) ** 2 / (n - 1) AS kc FROM t)
SELECT x, y, round(sqrt(phi2 / least(rc - 1, kc - 1)), 6) AS v, n::BIGINT AS n FROM b""",
)
def cramers_v(spark, d):
    return associate.cramers_v_matrix(line_cats(spark, d), LINE_CATS).withColumn("v", r("v"))


@add(
    "cramers_v_plain",
    f"""WITH {CELLS_SQL}
SELECT x, y, round(sqrt(greatest(0, sum(o * o / (r * c)) - 1) / (least(count(DISTINCT vx), count(DISTINCT vy)) - 1)), 6) AS v,
 any_value(n)::BIGINT AS n FROM m GROUP BY 1, 2""",
)
def cramers_v_plain(spark, d):
    return associate.cramers_v_matrix(line_cats(spark, d), LINE_CATS, False, False).withColumn("v", r("v"))


@add(
    "theils_u",
    f"""WITH {CELLS_SQL},
h AS (SELECT x, y, -sum(o / n * ln(r / n)) AS hx, -sum(o / n * ln(c / n)) AS hy,
  -sum(o / n * ln(o / c)) AS hxy, -sum(o / n * ln(o / r)) AS hyx FROM m GROUP BY 1, 2)
SELECT x, y, round((hx - hxy) / hx, 6) AS u FROM h UNION ALL SELECT y, x, round((hy - hyx) / hy, 6) FROM h
UNION ALL SELECT DISTINCT x, x, 1.0 FROM h UNION ALL SELECT DISTINCT y, y, 1.0 FROM h WHERE y NOT IN (SELECT x FROM h)""",
)
def theils_u(spark, d):
    return associate.theils_u_matrix(line_cats(spark, d), LINE_CATS).withColumn("u", r("u"))


@add(
    "entropies",
    f"""WITH {LINE_CATS_SQL}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lc" for c in LINE_CATS)}),
p AS (SELECT feature, v, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM l GROUP BY 1, 2)
SELECT feature, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1""",
)
def entropies(spark, d):
    return associate.entropies(line_cats(spark, d), LINE_CATS).withColumn("entropy", r("entropy"))


CAT_NUM_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS cat, {c} AS level, '{n}' AS num, {n} AS v FROM lc" for c in LINE_CATS for n in LINE_NUMS
)


@add(
    "anova_f",
    f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
g AS (SELECT cat, num, level, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n * m) OVER (PARTITION BY cat, num) / sum(n) OVER (PARTITION BY cat, num) AS grand FROM g)
SELECT cat, num, round((sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS f,
 count(*) AS groups, sum(n)::BIGINT AS n FROM t GROUP BY 1, 2""",
)
def anova_f(spark, d):
    out = associate.anova_f(line_cats(spark, d), LINE_CATS, LINE_NUMS)
    return out.select("cat", "num", r("f").alias("f"), "groups", "n")


#: The F distribution's upper tail: Simpson's rule for x = u * u over 4000 steps.
ANOVA_P_SQL = f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
g AS (SELECT cat, num, level, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n * m) OVER (PARTITION BY cat, num) / sum(n) OVER (PARTITION BY cat, num) AS grand FROM g),
f AS (SELECT cat, num, count(*) - 1.0::DOUBLE AS a, sum(n) - count(*)::DOUBLE AS b, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f
  FROM t GROUP BY 1, 2),
u AS (SELECT *, sqrt(f) / 4000 AS h, i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM f, range(4001) r(i)),
s AS (SELECT cat, num, w * h / 3 * 2 * CASE WHEN i = 0 THEN CASE WHEN a = 1 THEN exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * ln(a / b)) ELSE 0 END
  ELSE exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * ln(a / b) + (a - 1) * ln(i * h) - (a + b) / 2 * ln(1 + a * (i * h) ** 2 / b)) END AS part FROM u)
SELECT cat, num, round(greatest(0, 1 - sum(part)), 6) + 0.0 AS p FROM s GROUP BY 1, 2"""


@add("anova_p", ANOVA_P_SQL)
def anova_p(spark, d):
    return associate.anova_f(line_cats(spark, d), LINE_CATS, LINE_NUMS).select("cat", "num", r("p").alias("p"))


@add(
    "anova_p_three_groups",
    f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
g AS (SELECT cat, num, level, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l WHERE cat = 'l_returnflag' GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n * m) OVER (PARTITION BY cat, num) / sum(n) OVER (PARTITION BY cat, num) AS grand FROM g),
f AS (SELECT cat, num, (sum(n * (m - grand) ** 2) / 2) / (sum(ss) / (sum(n) - 3)) AS f, sum(n) - 3 AS d2 FROM t GROUP BY 1, 2)
SELECT cat, num, round((1 + 2 * f / d2) ** (-d2 / 2.0), 6) AS p FROM f""",
)
def anova_p_three_groups(spark, d):
    """With three groups the survival function has a closed form."""
    return associate.anova_f(line_cats(spark, d), ["l_returnflag"], LINE_NUMS).select("cat", "num", r("p").alias("p"))


@add(
    "kruskal_h",
    f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
k AS (SELECT cat, num, level, rank() OVER (PARTITION BY cat, num ORDER BY v) + (count(*) OVER (PARTITION BY cat, num, v) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY cat, num, v)::DOUBLE AS t FROM l),
g AS (SELECT cat, num, level, count(*)::DOUBLE AS n, sum(rk) AS r, sum(t * t - 1) AS tie FROM k GROUP BY 1, 2, 3),
s AS (SELECT cat, num, count(*) AS groups, sum(n) AS n, sum(r * r / n) AS ssr, sum(tie) AS tie FROM g GROUP BY 1, 2)
SELECT cat, num, round((12.0 / (n * (n + 1)) * ssr - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 5) AS h, groups, n::BIGINT AS n FROM s""",
)
def kruskal_h(spark, d):
    out = associate.kruskal_h(line_cats(spark, d), LINE_CATS, LINE_NUMS)
    return out.select("cat", "num", r("h", 5).alias("h"), "groups", "n")


@add(
    "kruskal_p_three_groups",
    f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
k AS (SELECT cat, num, level, rank() OVER (PARTITION BY num ORDER BY v) + (count(*) OVER (PARTITION BY num, v) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY num, v)::DOUBLE AS t FROM l WHERE cat = 'l_returnflag'),
g AS (SELECT cat, num, level, count(*)::DOUBLE AS n, sum(rk) AS r, sum(t * t - 1) AS tie FROM k GROUP BY 1, 2, 3),
s AS (SELECT cat, num, sum(n) AS n, sum(r * r / n) AS ssr, sum(tie) AS tie FROM g GROUP BY 1, 2)
SELECT cat, num, round(exp(-(12.0 / (n * (n + 1)) * ssr - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) / 2), 6) AS p FROM s""",
)
def kruskal_p_three_groups(spark, d):
    """With two degrees of freedom the survival function is exp(-h / 2)."""
    return associate.kruskal_h(line_cats(spark, d), ["l_returnflag"], LINE_NUMS).select("cat", "num", r("p").alias("p"))


#: The chi-squared distribution's upper tail in the same way.
KRUSKAL_P_SQL = f"""WITH {LINE_CATS_SQL}, l AS ({CAT_NUM_SQL}),
k AS (SELECT cat, num, level, rank() OVER (PARTITION BY cat, num ORDER BY v) + (count(*) OVER (PARTITION BY cat, num, v) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY cat, num, v)::DOUBLE AS t FROM l),
g AS (SELECT cat, num, level, count(*)::DOUBLE AS n, sum(rk) AS r, sum(t * t - 1) AS tie FROM k GROUP BY 1, 2, 3),
s AS (SELECT cat, num, count(*) - 1.0::DOUBLE AS a, sum(n) AS n, sum(r * r / n) AS ssr, sum(tie) AS tie FROM g GROUP BY 1, 2),
x AS (SELECT cat, num, a, (12.0 / (n * (n + 1)) * ssr - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS x FROM s),
u AS (SELECT *, sqrt(x) / 4000 AS h, i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM x, range(4001) r(i)),
p AS (SELECT cat, num, w * h / 3 * 2 * CASE WHEN i = 0 THEN CASE WHEN a = 1 THEN exp(-lgamma(0.5)) / sqrt(2) ELSE 0 END
  ELSE exp((a - 1) * ln(i * h) - (i * h) ** 2 / 2 - a / 2 * ln(2) - lgamma(a / 2)) END AS part FROM u)
SELECT cat, num, round(greatest(0, 1 - sum(part)), 6) + 0.0 AS p FROM p GROUP BY 1, 2"""


@add("kruskal_p", KRUSKAL_P_SQL)
def kruskal_p(spark, d):
    return associate.kruskal_h(line_cats(spark, d), LINE_CATS, LINE_NUMS).select("cat", "num", r("p").alias("p"))


@add(
    "top_pairs",
    corr_sql("WITH p AS (", "lineitem", LINE_NUMS, diagonal=False) + ") SELECT * FROM p ORDER BY abs(r) DESC, x, y LIMIT 4",
)
def top_pairs(spark, d):
    out = associate.corr_matrix(table(spark, d, "lineitem"), LINE_NUMS)
    return joint.top_pairs(out.withColumn("r", r("r")))


# --- multivariate detectors -------------------------------------------------------------


@add(
    "mahalanobis",
    f"""WITH {ORDERS_CUSTOMER_SQL}, k AS (SELECT o_orderkey, acct, price FROM oc WHERE acct IS NOT NULL AND price IS NOT NULL),
s AS (SELECT *, (acct - avg(acct) OVER ()) / stddev_pop(acct) OVER () AS a,
  (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS b FROM k),
c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM s)
SELECT o_orderkey, round(sqrt((a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab)), 6) AS mahalanobis FROM s, c""",
)
def mahalanobis(spark, d):
    df = orders_customer(spark, d).withColumn("same", F.lit(1.0))
    out = detectors.mahalanobis(df, ["o_orderkey"], ["acct", "price", "same"])
    return out.withColumn("mahalanobis", r("mahalanobis"))


@add(
    "score_threshold",
    """SELECT 'value' AS score, 0.95::DOUBLE AS prob, round(t, 6) AS threshold, count(*) FILTER (WHERE value > t) AS n_above
FROM events, (SELECT quantile_cont(value, 0.95) AS t FROM events) GROUP BY t""",
)
def score_threshold(spark, d):
    out = detectors.score_threshold(table(spark, d, "events"), "value")
    return out.withColumn("threshold", r("threshold"))


KNN_SQL = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rk FROM p)"""


@add("knn_graph", f"WITH {KNN_SQL} SELECT id, nbr, round(dist, 6) AS dist, rk::INTEGER AS rk FROM k WHERE rk <= 5")
def knn_graph(spark, d):
    out = neighbors.knn_graph(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return out.withColumn("dist", r("dist"))


@add("knn_graph_ivf", f"WITH {KNN_SQL} SELECT id, nbr, round(dist, 6) AS dist, rk::INTEGER AS rk FROM k WHERE rk <= 5")
def knn_graph_ivf(spark, d):
    """With as many probes as cells the probing search is exact."""
    out = neighbors.knn_graph(table(spark, d, "embeddings"), "vec_id", "embedding", 5, "ivf", probes=1 << 20)
    return out.withColumn("dist", r("dist"))


@add("knn_recall", "SELECT 5 * count(*) AS n_edges, true AS recall_090 FROM embeddings")
def knn_recall(spark, d):
    """The probing search at its default against the exact one."""
    e = table(spark, d, "embeddings")
    found = neighbors.knn_graph(e, "vec_id", "embedding", 5, "ivf").select("id", "nbr", F.lit(1).alias("hit"))
    both = neighbors.knn_graph(e, "vec_id", "embedding", 5).join(found, ["id", "nbr"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_edges"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_090"))


@add("knn_distance", f"WITH {KNN_SQL} SELECT id AS vec_id, round(avg(dist), 6) AS knn_distance FROM k WHERE rk <= 5 GROUP BY 1")
def knn_distance(spark, d):
    out = neighbors.knn_distance(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return out.withColumn("knn_distance", r("knn_distance"))


@add(
    "local_outlier_factor",
    f"""WITH {KNN_SQL}, n AS (SELECT * FROM k WHERE rk <= 20), kd AS (SELECT id, max(dist) AS kdist FROM n GROUP BY 1),
lrd AS (SELECT n.id, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM n JOIN kd ON n.nbr = kd.id GROUP BY 1),
f AS (SELECT n.id, avg(b.lrd) / any_value(a.lrd) AS lof FROM n JOIN lrd a ON n.id = a.id JOIN lrd b ON n.nbr = b.id GROUP BY 1)
SELECT id AS vec_id, round(lof, 6) AS local_outlier_factor,
 CAST(lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS INTEGER) AS local_outlier_factor_outlier FROM f""",
)
def local_outlier_factor(spark, d):
    out = neighbors.local_outlier_factor(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.withColumn("local_outlier_factor", r("local_outlier_factor"))


def order_matrix(spark, d):
    """Standardised complete rows of four order and customer columns."""
    df = orders_customer(spark, d)
    return cut_lineage(features.feature_matrix(df, ["o_orderkey"], ["acct", "price", "c_nationkey", "o_totalprice"])[0])


def with_far_row(matrix):
    """One more row, far from all others in every feature."""
    far = matrix.limit(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.transform("features", lambda v: F.lit(40.0)).alias("features"))
    return cut_lineage(matrix.unionByName(far))


def detector_facts(scores, score: str):
    """What any such detector must show: every row once, the asked share flagged, the far row lowest."""
    flag = F.col(f"{score}_outlier")
    lowest = F.min_by("o_orderkey", score)
    return scores.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"), F.count_if(F.col(score).isNull()).alias("n_null"),
        (F.avg(flag).between(0.08, 0.101)).alias("flagged_share"), (lowest == -1).alias("far_row_lowest"),
        (F.max(F.when(F.col("o_orderkey") == -1, flag)) == 1).alias("far_row_flagged"),
    )


DETECTOR_SQL = f"""WITH {ORDERS_CUSTOMER_SQL} SELECT count(*) + 1 AS n_rows, count(*) + 1 AS n_keys, 0::BIGINT AS n_null, true AS flagged_share,
 true AS far_row_lowest, true AS far_row_flagged FROM oc WHERE acct IS NOT NULL AND price IS NOT NULL"""


@add("isolation_forest", DETECTOR_SQL)
def isolation_forest(spark, d):
    return detector_facts(detectors.isolation_forest(with_far_row(order_matrix(spark, d)), ["o_orderkey"]), "isolation_forest")


@add("one_class_svm", DETECTOR_SQL)
def one_class_svm(spark, d):
    return detector_facts(detectors.one_class_svm(with_far_row(order_matrix(spark, d)), ["o_orderkey"]), "one_class_svm")


@add("pca_reduce", "SELECT count(*) AS n_rows, 8 AS dims, true AS centred, true AS uncorrelated, true AS variances_fall FROM embeddings")
def pca_reduce(spark, d):
    """Components are centred, uncorrelated and ordered by variance."""
    out = cut_lineage(features.pca_reduce(table(spark, d, "embeddings"), ["vec_id"], 8, "embedding"))
    c = [F.col("features")[i] for i in range(8)]
    small = lambda x: F.abs(x) < 1e-6
    alike = [small(F.corr(a, b)) for i, a in enumerate(c) for b in c[i + 1 :]]
    falling = [F.var_pop(a) >= F.var_pop(b) - 1e-9 for a, b in zip(c, c[1:])]
    both = lambda xs: reduce(lambda a, b: a & b, xs)
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).alias("dims"), both([small(F.avg(x)) for x in c]).alias("centred"),
        both(alike).alias("uncorrelated"), both(falling).alias("variances_fall"),
    )


@add(
    "consensus_outliers",
    """WITH f AS (SELECT o_orderkey, (o_totalprice > 300000)::INT AS a, (o_orderstatus = 'F')::INT AS b,
  (o_orderpriority = '1-URGENT')::INT AS c FROM orders)
SELECT CASE WHEN a + b + c >= 2 THEN 'Outlier' ELSE 'Normal' END AS label, count(*) AS n FROM f GROUP BY 1""",
)
def consensus_outliers(spark, d):
    flags = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 300000).cast("int").alias("price_outlier"),
        (F.col("o_orderstatus") == "F").cast("int").alias("status_outlier"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("priority_outlier"),
    )
    return detectors.consensus_counts(detectors.consensus_outliers(flags, ["o_orderkey"]))


# --- joint distribution -----------------------------------------------------------------

MI_BINS = f"""b AS (SELECT {", ".join(
    f"least(19, floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 20)) AS {c}" for c in LINE_NUMS)}
FROM lineitem),
cells AS ({_pair_union(LINE_NUMS, lambda a, b:
  f"SELECT '{a}' AS x, '{b}' AS y, {a} AS vx, {b} AS vy, count(*)::DOUBLE AS o FROM b GROUP BY {a}, {b}")}),
m AS (SELECT *, sum(o) OVER (PARTITION BY x, y, vx) AS r, sum(o) OVER (PARTITION BY x, y, vy) AS c,
  sum(o) OVER (PARTITION BY x, y) AS n FROM cells)"""


@add(
    "mutual_information",
    f"""WITH {MI_BINS}
SELECT x, y, round(greatest(0, sum(o / n * ln(o * n / (r * c)))), 6) AS mi, any_value(n)::BIGINT AS n FROM m GROUP BY 1, 2""",
)
def mutual_information(spark, d):
    return joint.mutual_information(table(spark, d, "lineitem"), LINE_NUMS).withColumn("mi", r("mi"))


QUANTILE_BINS = f"""e AS (SELECT {", ".join(f"list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}])) AS {c}" for c in LINE_NUMS)} FROM lineitem),
b AS (SELECT {", ".join(f"len(list_filter(e.{c}, lambda q: q < l.{c})) AS {c}" for c in LINE_NUMS)} FROM lineitem l, e),
cells AS ({_pair_union(LINE_NUMS, lambda a, b:
  f"SELECT '{a}' AS x, '{b}' AS y, {a} AS vx, {b} AS vy, count(*)::DOUBLE AS o FROM b GROUP BY {a}, {b}")}),
m AS (SELECT *, sum(o) OVER (PARTITION BY x, y, vx) AS r, sum(o) OVER (PARTITION BY x, y, vy) AS c,
  sum(o) OVER (PARTITION BY x, y) AS n FROM cells)"""


@add(
    "mutual_information_quantile",
    f"""WITH {QUANTILE_BINS}
SELECT x, y, round(greatest(0, sum(o / n * ln(o * n / (r * c)))), 6) AS mi, any_value(n)::BIGINT AS n FROM m GROUP BY 1, 2""",
)
def mutual_information_quantile(spark, d):
    return joint.mutual_information(table(spark, d, "lineitem"), LINE_NUMS, 10, "quantile").withColumn("mi", r("mi"))


@add(
    "entropy_diagonal",
    f"""WITH {MI_BINS}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS x, {c} AS v FROM b" for c in LINE_NUMS)}),
p AS (SELECT x, count(*) / sum(count(*)) OVER (PARTITION BY x) AS p FROM l GROUP BY x, v)
SELECT x, x AS y, round(-sum(p * ln(p)), 6) AS mi FROM p GROUP BY 1""",
)
def entropy_diagonal(spark, d):
    return joint.self_information(table(spark, d, "lineitem"), LINE_NUMS).withColumn("mi", r("mi"))


@add(
    "self_information",
    f"WITH {LONG_LINES} SELECT feature AS x, feature AS y, round(var_samp(v), 4) AS mi FROM l GROUP BY 1",
)
def self_information(spark, d):
    out = joint.self_information(table(spark, d, "lineitem"), LINE_NUMS, "variance")
    return out.withColumn("mi", r("mi", 4))


@add("mutual_information_ksg")
def mutual_information_ksg(spark, d):
    df = gaps_customer(spark, d)
    return joint.mutual_information(df, ["acct", "c_nationkey"], method="ksg", key=["c_custkey"])


def _joint_pair(a: str, b: str) -> str:
    def rk(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    def bn(c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN least(19, floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 20)) END"

    return f"""SELECT '{a}' AS column1, '{b}' AS column2, round(corr(a, b), 6) AS pearson_correlation,
 round(corr(ra, rb), 6) AS spearman_correlation, round(covar_samp(a, b), 4) AS covariance,
 (SELECT round(greatest(0, sum(o / n * ln(o * n / (r * c)))), 6) FROM
   (SELECT *, sum(o) OVER (PARTITION BY vx) AS r, sum(o) OVER (PARTITION BY vy) AS c, sum(o) OVER () AS n FROM
     (SELECT vx, vy, count(*)::DOUBLE AS o FROM (SELECT {bn(a)} AS vx, {bn(b)} AS vy FROM oc) WHERE vx IS NOT NULL AND vy IS NOT NULL GROUP BY 1, 2))) AS mutual_information,
 count(*) AS n_samples FROM (SELECT {a} AS a, {b} AS b, {rk(a)} AS ra, {rk(b)} AS rb FROM oc WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


JOINT_COLS = ["acct", "price", "c_nationkey"]


@add(
    "joint_stats",
    f"WITH {ORDERS_CUSTOMER_SQL} "
    + " UNION ALL ".join(_joint_pair(a, b) for i, a in enumerate(JOINT_COLS) for b in JOINT_COLS[i + 1 :]),
)
def joint_stats(spark, d):
    out = joint.joint_stats(orders_customer(spark, d), JOINT_COLS, ["o_orderkey"])
    return out.select(
        "column1", "column2", r("pearson_correlation").alias("pearson_correlation"),
        r("spearman_correlation").alias("spearman_correlation"), r("covariance", 4).alias("covariance"),
        r("mutual_information").alias("mutual_information"), "n_samples",
    )


JOINT_ENCODED = ["l_quantity", "l_discount", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_O"]


@add(
    "joint_correlation",
    corr_sql(
        "WITH en AS (SELECT l_quantity, l_discount, "
        + ", ".join(f"(l_returnflag = '{v}')::INT::DOUBLE AS l_returnflag_{v}" for v in "ANR")
        + ", (l_linestatus = 'O')::INT::DOUBLE AS l_linestatus_O FROM lineitem)",
        "en",
        JOINT_ENCODED,
    ),
)
def joint_correlation(spark, d):
    li = table(spark, d, "lineitem")
    en = features.one_hot(li, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return associate.corr_matrix(en, JOINT_ENCODED).withColumn("r", r("r"))


# --- encoding ---------------------------------------------------------------------------


@add(
    "one_hot",
    f"""WITH {ORDERS_CUSTOMER_SQL}, s AS (SELECT o_orderkey, coalesce(segment, 'missing') AS g, o_orderstatus AS t,
  CASE WHEN price IS NULL THEN 'no' ELSE 'yes' END AS h FROM oc)
SELECT o_orderkey, {", ".join(f"(g = '{v}')::INT::DOUBLE AS segment_{v}" for v in
  ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing"))},
 {", ".join(f"(t = '{v}')::INT::DOUBLE AS o_orderstatus_{v}" for v in "FOP")}, (h = 'yes')::INT::DOUBLE AS has_price_yes FROM s""",
)
def one_hot(spark, d):
    df = orders_customer(spark, d).withColumn("has_price", F.when(F.col("price").isNull(), "no").otherwise("yes"))
    return features.one_hot(df, ["segment", "o_orderstatus", "has_price"], ["o_orderkey"])


def order_encoder(spark, d):
    df = orders_customer(spark, d)
    enc = encode.TabularEncoder(["o_totalprice", "acct", "c_nationkey"], ["segment", "o_orderstatus"], ["c_nationkey"], 0.4)
    return df, enc.fit(df)


ENCODE_SQL = f"""{ORDERS_CUSTOMER_SQL},
f AS (SELECT * FROM oc WHERE ((o_totalprice IS NULL)::INT + (acct IS NULL)::INT + (c_nationkey IS NULL)::INT
  + (segment IS NULL)::INT + (o_orderstatus IS NULL)::INT) / 5.0 <= 0.4)"""


@add(
    "encode_transform",
    f"""WITH {ENCODE_SQL}
SELECT o_orderkey, {", ".join(
    f"round(2 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) - 1, 6) + 0.0 AS {c}"
    for c in ("o_totalprice", "acct", "c_nationkey"))},
 {", ".join(f"2 * coalesce(segment = '{v}', false)::INT - 1.0::DOUBLE AS seg_{v}" for v in
   ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))},
 2 * (segment IS NULL)::INT - 1.0::DOUBLE AS seg_none,
 {", ".join(f"2 * (o_orderstatus = '{v}')::INT - 1.0::DOUBLE AS status_{v}" for v in "FOP")}, -1.0::DOUBLE AS status_none FROM f""",
)
def encode_transform(spark, d):
    df, enc = order_encoder(spark, d)
    names = ["o_totalprice", "acct", "c_nationkey"]
    for s in enc.slots[3:]:
        names.append(("seg_" if s.column == "segment" else "status_") + (s.level or "none"))
    out = enc.transform(df, ["o_orderkey"])
    return out.select("o_orderkey", *[r(F.col("features")[i]).alias(n) for i, n in enumerate(names)])


@add(
    "encode_round_trip",
    f"WITH {ENCODE_SQL} SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(acct, 4) AS acct, "
    "c_nationkey::BIGINT AS c_nationkey, segment, o_orderstatus FROM f",
)
def encode_round_trip(spark, d):
    df, enc = order_encoder(spark, d)
    back = enc.inverse_transform(enc.transform(df, ["o_orderkey"]), ["o_orderkey"])
    return back.withColumns({"o_totalprice": r("o_totalprice", 4), "acct": r("acct", 4)})


@add(
    "encode_levels",
    f"""WITH {ENCODE_SQL}, v AS (
  SELECT DISTINCT 'segment' AS "column", segment AS level FROM f WHERE segment IS NOT NULL UNION ALL SELECT 'segment', NULL
  UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM f UNION ALL SELECT 'o_orderstatus', NULL)
SELECT CAST(2 + row_number() OVER (ORDER BY "column" DESC, level NULLS LAST) AS INTEGER) AS position, "column", level FROM v""",
)
def encode_levels(spark, d):
    _, enc = order_encoder(spark, d)
    return enc.level_table(spark).where("categorical").select("position", "column", "level")


# --- synthesis --------------------------------------------------------------------------


@add(
    "flow_training_pairs",
    """SELECT count(*) * 6 AS n_rows, 64 AS dims, true AS mean_0, true AS variance_1, true AS dims_differ, true AS levels_share_noise FROM embeddings""",
)
def flow_training_pairs(spark, d):
    """The noise Z = X - Y in all 64 dimensions: standard normal, one draw per row and repetition, shared by its levels."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    pairs = flow.training_pairs(e, ["vec_id"], flow.FlowParams(nt=3, n_noise=2))
    with_data = pairs.join(e, "vec_id").withColumn("z", F.zip_with("features", "y_t", lambda x, y: x - y))
    sums = lambda f: F.aggregate("z", F.lit(0.0), lambda a, z: a + f(z))
    rows = with_data.select("vec_id", "rep", "level", "z", sums(lambda z: z).alias("s"), sums(lambda z: z * z).alias("q"))
    n = F.count(F.lit(1)) * 64 / 3  # levels repeat the same noise
    spread = rows.groupBy("vec_id", "rep").agg((F.max(F.col("z")[0]) - F.min(F.col("z")[0])).alias("gap"))
    shared = spread.agg((F.max("gap") < 1e-6).alias("levels_share_noise"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("z")).alias("dims"), (F.abs(F.sum("s") / (3 * n)) <= 6 / F.sqrt(n)).alias("mean_0"),
        (F.abs(F.sum("q") / (3 * n) - 1) <= 6 * F.sqrt(2 / n)).alias("variance_1"),
        (F.abs(F.corr(F.col("z")[0], F.col("z")[1])) < 0.2).alias("dims_differ"),
    )
    return facts.join(F.broadcast(shared))


@add(
    "flow_path",
    """SELECT vec_id, rep::INTEGER AS rep, level::INTEGER AS level, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE, 6) AS x
FROM embeddings, range(2) a(rep), range(3) b(level), range(64) c(i)""",
)
def flow_path(spark, d):
    """Every training pair leads back to its data point: x_t + (1 - t) y_t = x."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    pairs = flow.training_pairs(e, ["vec_id"], flow.FlowParams(nt=3, n_noise=2))
    left = F.lit(1.0) - (F.col("level") + 1) / F.lit(3.0)
    back = F.zip_with("x_t", "y_t", lambda a, b: a + left * b)
    return pairs.select("vec_id", "rep", "level", F.posexplode(back).alias("i", "x")).withColumn("x", r("x"))


DEMO = flow.FlowParams(nt=5, n_noise=3)  # 100 trees of depth 6 a level


def made_facts(made, real, level: str):
    """Rows as asked, ids once, numbers inside the real ranges, levels of the real table or missing."""
    bounds = real.agg(F.min("o_totalprice"), F.max("o_totalprice"), F.min("c_nationkey"), F.max("c_nationkey")).first()
    inside = F.col("o_totalprice").between(bounds[0] - 0.01, bounds[1] + 0.01) & F.col("c_nationkey").between(bounds[2], bounds[3])
    foreign = made.select(F.col(level).alias("level")).dropna().distinct().join(real.select(F.col("o_orderstatus").alias("level")).distinct(), "level", "left_anti")
    facts = made.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_outside"), F.countDistinct("id").alias("n_ids"))
    return facts.join(F.broadcast(foreign.agg(F.count(F.lit(1)).alias("n_foreign_levels"))))


MADE_SQL = "SELECT count(*) AS n_rows, 0::BIGINT AS n_outside, count(*) AS n_ids, 0::BIGINT AS n_foreign_levels FROM orders"


@add("synthesize", MADE_SQL)
def synthesized(spark, d):
    df = orders_customer(spark, d).select("o_orderkey", "o_totalprice", "c_nationkey", "o_orderstatus")
    n = df.count()
    made = synthesize.synthesize(df, ["o_orderkey"], ["o_orderstatus"], ["c_nationkey"], (), n_samples=n, params=DEMO)
    return made_facts(cut_lineage(made.synthetic), df, "o_orderstatus")


@add("synthesize_by_label", MADE_SQL)
def synthesized_by_label(spark, d):
    df = orders_customer(spark, d).select("o_orderkey", "o_totalprice", "c_nationkey", "o_orderstatus")
    n = df.count()
    made = synthesize.synthesize(
        df, ["o_orderkey"], [], ["c_nationkey"], (), n_samples=n, params=replace(DEMO, trees=20), label="o_orderstatus"
    )
    return made_facts(cut_lineage(made.synthetic), df, "label")


@add(
    "compare_real_synth",
    f"""WITH l AS (SELECT 'real' AS source, 'o_totalprice' AS feature, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'synthetic', 'o_totalprice', o_totalprice FROM orders WHERE o_orderstatus <> 'F')
SELECT source, feature, count(*) AS count, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, min(v) AS min,
 round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75, max(v) AS max
FROM l GROUP BY 1, 2""",
)
def compare_real_synth(spark, d):
    o = table(spark, d, "orders")
    parts = reports.compare_real_synth(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_totalprice"], [])
    return parts["numeric"]


# --- reports ----------------------------------------------------------------------------


REPORT_NUMS = ["price", "acct", "c_nationkey"]
REPORT_CATS = ["o_orderstatus", "o_orderpriority"]


def _each_pair(make) -> str:
    return " UNION ALL ".join(make(a, b) for i, a in enumerate(REPORT_NUMS) for b in REPORT_NUMS[i + 1 :])


def _report_kendall(a: str, b: str) -> str:
    """The pair counted along the side with more values, one running count for each value of the other."""
    few, other = sorted((a, b), key=["c_nationkey", "acct", "price"].index)
    both = f"(SELECT {few} AS f, {other} AS o FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT 'kendall' AS statistic, '{a}' AS x, '{b}' AS y, (n0 - n1 - n2 + n3 - 2 * q) / sqrt((n0 - n1) * (n0 - n2)) AS value, n FROM
 (SELECT count(*) AS n, count(*) * (count(*) - 1) / 2.0 AS n0 FROM {both}),
 (SELECT sum(c * (c - 1) / 2.0) AS n1 FROM (SELECT count(*) AS c FROM {both} GROUP BY f)), (SELECT sum(c * (c - 1) / 2.0) AS n2 FROM (SELECT count(*) AS c FROM {both} GROUP BY o)),
 (SELECT sum(c * (c - 1) / 2.0) AS n3 FROM (SELECT count(*) AS c FROM {both} GROUP BY f, o)),
 (SELECT sum(c * (total - coalesce(upto, 0))) AS q FROM (SELECT f, o, c, level, total FROM (SELECT f, o, count(*) AS c FROM {both} GROUP BY 1, 2)
   JOIN (SELECT f AS level, count(*) AS total FROM {both} GROUP BY 1) ON level < f) AS p
  ASOF LEFT JOIN (SELECT f AS own, o AS place, sum(count(*)) OVER (PARTITION BY f ORDER BY o) AS upto FROM {both} GROUP BY 1, 2) AS m ON p.level = m.own AND p.o >= m.place)"""


def _report_ranks(a: str, b: str) -> str:
    rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"""SELECT 'spearman', '{a}', '{b}', corr(ra, rb), count(*) FROM (SELECT {rk(a)} AS ra, {rk(b)} AS rb FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


REPORT_SQL = f"""WITH {ORDERS_CUSTOMER_SQL}, t AS (SELECT * FROM oc),
cells AS (SELECT o_orderstatus AS vx, o_orderpriority AS vy, count(*)::DOUBLE AS o FROM t GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY vx) AS r, sum(o) OVER (PARTITION BY vy) AS c, sum(o) OVER () AS n FROM cells),
chi AS (SELECT any_value(n) AS n, sum(o * o / (r * c)) - 1 AS phi2, count(DISTINCT vx) AS rr, count(DISTINCT vy) AS kk FROM m),
cv AS (SELECT n, greatest(0, phi2 - (kk - 1) * (rr - 1) / (n - 1)) AS phi2, rr - (rr - 1) ** 2 / (n - 1) AS rc, kk - (kk - 1) ** 2 / (n - 1) AS kc FROM chi),
h AS (SELECT -sum(o / n * ln(r / n)) AS hx, -sum(o / n * ln(c / n)) AS hy, -sum(o / n * ln(o / c)) AS hxy, -sum(o / n * ln(o / r)) AS hyx FROM m),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS cat, {c} AS level, '{v}' AS num, {v} AS v FROM t WHERE {v} IS NOT NULL" for c in REPORT_CATS for v in REPORT_NUMS)}),
g AS (SELECT cat, num, level, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l GROUP BY 1, 2, 3),
gm AS (SELECT *, sum(n * m) OVER (PARTITION BY cat, num) / sum(n) OVER (PARTITION BY cat, num) AS grand FROM g),
k AS (SELECT cat, num, level, rank() OVER (PARTITION BY cat, num ORDER BY v) + (count(*) OVER (PARTITION BY cat, num, v) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY cat, num, v)::DOUBLE AS t FROM l),
kg AS (SELECT cat, num, level, count(*)::DOUBLE AS n, sum(rk) AS r, sum(t * t - 1) AS tie FROM k GROUP BY 1, 2, 3),
ks AS (SELECT cat, num, sum(n) AS n, sum(r * r / n) AS ssr, sum(tie) AS tie FROM kg GROUP BY 1, 2),
every AS ({_each_pair(_report_kendall)}
 UNION ALL {_each_pair(_report_ranks)}
 UNION ALL {" UNION ALL ".join(f"SELECT 'spearman', '{c}', '{c}', 1.0, count({c}) FROM t" for c in REPORT_NUMS)}
 UNION ALL {" UNION ALL ".join(f"SELECT 'pearson', '{a}', '{b}', corr({a}, {b}), count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) FROM t" for i, a in enumerate(REPORT_NUMS) for b in REPORT_NUMS[i:])}
 UNION ALL SELECT 'cramers_v', 'o_orderstatus', 'o_orderpriority', sqrt(phi2 / least(rc - 1, kc - 1)), n::BIGINT FROM cv
 UNION ALL SELECT 'theils_u', 'o_orderstatus', 'o_orderpriority', (hx - hxy) / hx, NULL FROM h
 UNION ALL SELECT 'theils_u', 'o_orderpriority', 'o_orderstatus', (hy - hyx) / hy, NULL FROM h
 UNION ALL {" UNION ALL ".join(f"SELECT 'theils_u', '{c}', '{c}', 1.0, NULL" for c in REPORT_CATS)}
 UNION ALL SELECT 'anova', cat, num, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), sum(n)::BIGINT FROM gm GROUP BY cat, num
 UNION ALL SELECT 'kruskal', cat, num, (12.0 / (n * (n + 1)) * ssr - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), n::BIGINT FROM ks
 UNION ALL SELECT 'skipped_columns', 'c_name', 'c_name', (count(DISTINCT c_name) > 100)::INT, NULL FROM t)
SELECT statistic, x, y, round(value, 5) + 0.0 AS value, n::BIGINT AS n FROM every"""


@add("association_report", REPORT_SQL)
def association_report(spark, d):
    """Every value of the report."""
    df = orders_customer(spark, d).select("o_orderkey", *REPORT_NUMS, *REPORT_CATS, "c_name")
    out = reports.association_report(df, ["o_orderkey"])
    # the number of levels is an estimate; that it is above the limit is not
    out["skipped_columns"] = out["skipped_columns"].withColumn("too_many", F.col("levels") > F.col("limit"))
    shapes = {
        "pearson": ("x", "y", "r", "n"), "spearman": ("x", "y", "r", "n"), "kendall": ("x", "y", "r", "n"), "cramers_v": ("x", "y", "v", "n"),
        "theils_u": ("x", "y", "u", None), "anova": ("cat", "num", "f", "n"), "kruskal": ("cat", "num", "h", "n"), "skipped_columns": ("column", "column", "too_many", None),
    }
    if set(shapes) != set(out):
        raise ValueError(f"results {sorted(out)}")
    parts = [
        out[name].select(
            F.lit(name).alias("statistic"), F.col(x).alias("x"), F.col(y).alias("y"), r(F.col(v).cast("double"), 5).alias("value"),
            (F.col(n) if n else F.lit(None)).cast("bigint").alias("n"),
        )
        for name, (x, y, v, n) in shapes.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ENCODED = ["acct", "c_nationkey", *[f"s_{v}" for v in SEGMENTS]]

ANOMALY_SQL = f"""WITH {GAPS_SQL}, n AS (SELECT count(*) AS n, count(acct) AS full_rows, (SELECT count(*) FROM (SELECT DISTINCT c_mktsegment FROM gc)) AS segments FROM gc),
l AS (SELECT 'acct' AS feature, acct AS v FROM gc WHERE acct IS NOT NULL UNION ALL SELECT 'c_nationkey', c_nationkey FROM gc),
u AS (SELECT feature, v, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z, (rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0) / count(*) OVER w * 100 AS q
  FROM l WINDOW w AS (PARTITION BY feature)),
f AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1),
o AS (SELECT feature, q1, q2, q3, lo, hi, v, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM l JOIN f USING (feature)),
box AS (SELECT feature, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, count(*) FILTER (WHERE NOT inside) AS outside, min(v) FILTER (WHERE inside) AS a, max(v) FILTER (WHERE inside) AS b
  FROM o GROUP BY 1),
bins AS (SELECT feature, least(49, floor((v - lo) / (hi - lo) * 50)) AS bin, count(*) AS c FROM o GROUP BY 1, 2),
en AS (SELECT acct, c_nationkey, {", ".join(f"(c_mktsegment = '{v}')::INT::DOUBLE AS s_{v}" for v in SEGMENTS)} FROM gc),
r AS ({" UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM en" for i, a in enumerate(ENCODED) for b in ENCODED[i:])}),
v AS (SELECT unnest(['mahalanobis_distance', 'knn_distance', 'anomaly_scores', 'consensus']) AS result, full_rows AS n_rows, NULL AS total FROM n
  UNION ALL SELECT 'rule_violations', n, NULL FROM n UNION ALL SELECT unnest(['thresholds', 'consensus_counts']), 2, NULL FROM n
  UNION ALL SELECT 'rule_counts', 0, NULL FROM n UNION ALL SELECT 'top_pairs', 4, NULL FROM n UNION ALL SELECT 'skipped_columns', 1, NULL FROM n
  UNION ALL SELECT 'mutual_information', (segments + 2) * (segments + 2), NULL FROM n UNION ALL SELECT 'joint_distribution_stats', (segments + 2) * (segments + 1) / 2, NULL FROM n
  UNION ALL SELECT 'z_scores', n, (SELECT sum(abs(z)) FROM u) FROM n UNION ALL SELECT 'quantile_ranks', n, (SELECT sum(q * q) / 10000 FROM u) FROM n
  UNION ALL SELECT 'iqr_stats', 2, (SELECT sum(q1 + q3 + outside) FROM box) FROM n UNION ALL SELECT 'box_stats', 2, (SELECT sum(q2 + a + b + outside) FROM box) FROM n
  UNION ALL SELECT 'histograms', (SELECT count(*) FROM bins), (SELECT sum(c * (bin + 1)) FROM bins) FROM n
  UNION ALL SELECT 'joint_correlation', (segments + 2) * (segments + 3) / 2, (SELECT sum(r) FROM r) FROM n)
SELECT result, n_rows::BIGINT AS n_rows, round(total, 4) + 0.0 AS total FROM v"""


@add("anomaly_report", ANOMALY_SQL)
def anomaly_report(spark, d):
    """Every result of the report, for a key of two columns: its rows, and a sum of its values where SQL gives them."""
    df = gaps_customer(spark, d).select(F.col("c_custkey"), F.lit(1).alias("part"), "acct", "c_nationkey", "c_mktsegment", "c_name")
    out = reports.anomaly_report(df, ["c_custkey", "part"])
    values = {
        "z_scores": F.coalesce(F.abs("acct_zscore"), F.lit(0.0)) + F.abs("c_nationkey_zscore"),
        "quantile_ranks": (F.coalesce(F.col("acct") * F.col("acct"), F.lit(0.0)) + F.col("c_nationkey") * F.col("c_nationkey")) / 10000,
        "iqr_stats": F.col("q1") + F.col("q3") + F.col("outlier_count"),
        "box_stats": F.col("median") + F.col("whisker_low") + F.col("whisker_high") + F.col("outlier_count"),
        "histograms": F.col("n") * (F.col("bin") + 1),
        "joint_correlation": F.col("r"),
    }
    sized = [
        frame.agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum(values[name]).cast("double"), 4).alias("total") if name in values else F.lit(None).cast("double").alias("total")).select(
            F.lit(name).alias("result"), "n_rows", "total"
        )
        for name, frame in out.items()
        if name != "pair_density"  # as many rows as the pairs shown have cells
    ]
    return reduce(lambda a, b: a.unionByName(b), sized)
