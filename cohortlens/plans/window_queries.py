"""Windows, ranks, top-k, set operations and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


from ..operators import dimensional, ordering, programme, quality, score, stats
from ..session import pinned
from . import domain as D
from .cohort_queries import metrics
from .registry import Tables, plan

_TRUNK_SQL = ", ".join(f"'{c}'" for c in D.TRUNK)


@plan("bigint position orderkey; double price", "E01 F08",
      """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, o_orderkey AS orderkey, o_totalprice AS price FROM orders""")
def ordered_rank(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return ordering.numbered(rows, F.desc("price"), F.asc("orderkey"))


@plan("string area; bigint year rows previous", "E03",
      f"""WITH {D.ENROLMENTS}, c AS (SELECT area, entry_year AS year, count(*) AS rows FROM enrolments GROUP BY ALL)
      SELECT *, lag(rows) OVER (PARTITION BY area ORDER BY year) AS previous FROM c""")
def lag_series(t: Tables) -> DataFrame:
    counts = D.enrolments(t).groupBy("area", F.col("entry_year").alias("year")).agg(F.count("*").alias("rows"))
    return counts.withColumn("previous", F.lag("rows").over(W.partitionBy("area").orderBy("year")))


@plan("bigint person orderkey; string status valid_from valid_to", "E04 E07",
      """WITH k AS (SELECT CASE WHEN o_custkey % 100 <> 7 THEN o_custkey END AS person, * FROM orders
      ), v AS (SELECT person, o_orderkey AS orderkey, o_orderstatus AS status, o_orderdate AS d,
          lag(o_orderstatus) OVER w AS before, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY person ORDER BY o_orderdate, o_orderkey)
      ), s AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY d, orderkey) AS n FROM v WHERE rn = 1 OR status IS DISTINCT FROM before)
      SELECT person, orderkey, status, CASE WHEN n = 1 THEN '1962-04-21' ELSE strftime(d, '%Y-%m-%d') END AS valid_from,
        strftime(lead(d) OVER (PARTITION BY person ORDER BY d, orderkey), '%Y-%m-%d') AS valid_to FROM s""")
def version_chain(t: Tables) -> DataFrame:
    """Rows of one person in a hundred have lost their key: they are one chain."""
    rows = t.orders.select(
        F.when(F.col("o_custkey") % 100 != 7, F.col("o_custkey")).alias("person"), F.col("o_orderkey").alias("orderkey"),
        F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    changes = programme.append_on_change(rows, ["person"], ["day", "orderkey"], "status")
    window = W.partitionBy("person").orderBy("day", "orderkey")
    first = F.row_number().over(window) == 1
    return changes.select(
        "person", "orderkey", "status",
        F.when(first, "1962-04-21").otherwise(F.col("day")).alias("valid_from"), F.lead("day").over(window).alias("valid_to"),
    )


@plan("string segment; bigint custkey; double balance", "E06",
      """SELECT c_mktsegment AS segment, c_custkey AS custkey, c_acctbal AS balance FROM customer
      QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1""")
def top1_per_group(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance")
    )
    return ordering.top_per_group(rows, ["segment"], [F.desc("balance"), F.asc("custkey")])


@plan("bigint position; string course origin; double risk_index", "F04",
      f"""WITH {D.RISK} SELECT rank() OVER (ORDER BY risk_index DESC) AS position, course, 'rebuilt' AS origin, risk_index
      FROM retention WHERE course NOT IN ({_TRUNK_SQL})""")
def panel_fallback(t: Tables) -> DataFrame:
    current = pinned(score.risk_index(metrics(t)))
    # A panel of an older load: one index moved, so the sets differ and the panel is rebuilt.
    panel = score.critical_panel(current, "course", D.TRUNK).withColumn(
        "risk_index", F.when(F.col("position") == 1, -1.0).otherwise(F.col("risk_index"))
    )
    return score.panel_or_current(panel, current, "course", "risk_index", D.TRUNK, ["course", "risk_index"])


@plan("bigint partkey; double revenue", "F05",
      """SELECT l_partkey AS partkey, sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS revenue FROM lineitem GROUP BY 1
      ORDER BY revenue DESC, partkey LIMIT 20""")
def top_n(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("partkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(28,2)")).alias("revenue")
    )
    return sums.orderBy(F.desc("revenue"), F.asc("partkey")).limit(20)


@plan("bigint custkey; double balance; string side", "F06",
      """SELECT c_custkey AS custkey, c_acctbal AS balance, CASE WHEN c_acctbal > 0 THEN 'Acima' ELSE 'Abaixo' END AS side FROM (
        (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10))""")
def extremes(t: Tables) -> DataFrame:
    from ..functions.labels import sign_label

    rows = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    return stats.extremes(rows, "balance", "custkey").withColumn("side", sign_label(F.col("balance")))


@plan("string name; bigint peers", "F07",
      """SELECT p_name AS name, count(DISTINCT p_brand) AS peers FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 10""")
def threshold_filter(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.count_distinct("p_brand").alias("peers")).filter("peers >= 10")


@plan("string course; bigint total keys; double risk_index", "F09",
      f"""WITH {D.RISK} SELECT course, total, risk_index, (SELECT count(*) FROM retention) AS keys FROM retention WHERE course = 'NATION_5 - MACHINERY'""")
def point_lookup(t: Tables) -> DataFrame:
    table = pinned(score.risk_index(metrics(t)))
    keys = table.agg(F.count_distinct("course")).scalar()
    return table.filter(F.col("course") == "NATION_5 - MACHINERY").withColumn("keys", keys)


@plan("string name", "G01",
      f"""WITH {D.ENROLMENTS} SELECT DISTINCT course AS name FROM programmes UNION SELECT n_name FROM nation UNION SELECT 'MULTICAMPUS'""")
def union_distinct(t: Tables) -> DataFrame:
    names = D.programmes(t).select(F.col("course").alias("name")).distinct()
    many = ordering.literal_table(t.spark, "name string", [("MULTICAMPUS",)])
    return names.union(t.nation.select("n_name")).union(many).distinct()


@plan("bigint year before after difference", "G02",
      """SELECT year(l_shipdate) AS year, count(*) FILTER (l_linestatus = 'F') AS before, count(*) FILTER (l_linestatus = 'O') AS after,
        count(*) FILTER (l_linestatus = 'O') - count(*) FILTER (l_linestatus = 'F') AS difference FROM lineitem GROUP BY 1""")
def before_after(t: Tables) -> DataFrame:
    cells = t.lineitem.groupBy(F.year("l_shipdate").alias("year"), "l_linestatus").agg(F.count("*").alias("n"))
    old = cells.filter("l_linestatus = 'F'").select("year", F.col("n").alias("before"), F.lit(0).alias("after"))
    new = cells.filter("l_linestatus = 'O'").select("year", F.lit(0).alias("before"), F.col("n").alias("after"))
    sums = old.unionByName(new).groupBy("year").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return sums.withColumn("difference", F.col("after") - F.col("before"))


@plan("string difference; bigint custkey orders", "G03 K12",
      """WITH a AS (SELECT o_custkey AS custkey, count(*) AS orders FROM orders GROUP BY 1
      ), b AS (SELECT o_custkey AS custkey, count(*) AS orders FROM orders WHERE o_totalprice > 20000 GROUP BY 1)
      (SELECT 'only_in_all' AS difference, * FROM a EXCEPT SELECT 'only_in_all', * FROM b)
      UNION ALL (SELECT 'only_in_large', * FROM b EXCEPT SELECT 'only_in_large', * FROM a)""")
def two_way_except(t: Tables) -> DataFrame:
    def counts(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("orders"))

    return quality.two_way_except(counts(t.orders), counts(t.orders.filter("o_totalprice > 20000")), ("all", "large"))


@plan("bigint time_key year term decade; string label", "G04",
      """WITH y AS (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders), 2026)) AS year)
      SELECT year * 10 + s AS time_key, year, s AS term, year // 10 * 10 AS decade, year || '/' || s AS label
      FROM y CROSS JOIN (VALUES (1), (2)) AS t(s)""")
def time_dimension(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year"))
    return dimensional.time_dimension(rows, "year", 2026)


@plan("string course measure; double value", "G05",
      f"""WITH {D.METRICS}, u AS (SELECT course, CAST(graduation_pct AS DOUBLE) AS graduation_pct, CAST(dropout_pct AS DOUBLE) AS dropout_pct,
        CAST(mean_terms AS DOUBLE) AS mean_terms FROM metrics)
      SELECT course, measure, value FROM (UNPIVOT u ON graduation_pct, dropout_pct, mean_terms INTO NAME measure VALUE value)""")
def unpivot(t: Tables) -> DataFrame:
    long = metrics(t).unpivot(["course"], ["graduation_pct", "dropout_pct", "mean_terms"], "measure", "value")
    return long.filter(F.col("value").isNotNull())


