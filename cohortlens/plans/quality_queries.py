"""Data checks, privacy, reconciliation and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numbers import half_even
from ..functions.periods import day_month_year
from ..operators import ordering, privacy, quality
from ..operators.quality import Rule
from ..session import pinned
from . import domain as D
from .cohort_queries import metrics
from .join_queries import _RULES_SQL, _TRUNK_SQL, known_curricula, resolved
from .registry import Tables, plan


@plan("string check; bigint failures", "K01",
      """SELECT 'not_null:l_shipdate' AS "check", count(*) FILTER (l_shipdate IS NULL) AS failures FROM lineitem
      UNION ALL SELECT 'accepted:l_returnflag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
      UNION ALL SELECT 'range:l_quantity', count(*) FILTER (l_quantity NOT BETWEEN 1 AND 49) FROM lineitem
      UNION ALL SELECT 'unique:l_orderkey', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
      UNION ALL SELECT 'related:l_suppkey', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3))""")
def column_checks(t: Tables) -> DataFrame:
    suppliers = t.supplier.filter("s_nationkey <> 3")
    return quality.column_checks(t.lineitem, [
        Rule("not_null", "l_shipdate"), Rule("accepted", "l_returnflag", ("A", "N")), Rule("range", "l_quantity", (1, 49)),
        Rule("unique", "l_orderkey"), Rule("related", "l_suppkey", table=suppliers, target="s_suppkey"),
    ])


@plan("string check; bigint failures", "K02",
      """SELECT 'range:c_acctbal' AS "check", count(*) FILTER (c_acctbal NOT BETWEEN 0 AND 9000) AS failures FROM customer
      UNION ALL SELECT 'range:masked', count(*) FILTER (c_nationkey <> 0 AND c_acctbal NOT BETWEEN 0 AND 9000) FROM customer""")
def range_check(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("masked", F.when(F.col("c_nationkey") != 0, F.col("c_acctbal")))
    return quality.column_checks(rows, [Rule("range", "c_acctbal", (0, 9000)), Rule("range", "masked", (0, 9000))])


@plan("string name; bigint rows; boolean inside", "K03",
      """SELECT 'orders' AS name, count(*) AS rows, count(*) BETWEEN 1000 AND 1000000000000 AS inside FROM orders
      UNION ALL SELECT 'nation', count(*), count(*) BETWEEN 30 AND 40 FROM nation""")
def volume_check(t: Tables) -> DataFrame:
    orders = quality.volume(t.orders, 1000, 1_000_000_000_000).withColumn("name", F.lit("orders"))
    return orders.unionByName(quality.volume(t.nation, 30, 40).withColumn("name", F.lit("nation")))


@plan("bigint n_nationkey n_regionkey; string n_name", "K04", "SELECT n_nationkey, n_regionkey, n_name FROM nation")
def schema_contract(t: Tables) -> DataFrame:
    agreed = T.StructType.fromDDL("n_nationkey int, n_name string, n_regionkey int")
    return quality.assert_absent(quality.assert_schema(t.nation, agreed), ["c_name", "c_acctbal"])


@plan("bigint year rows previous; double change_pct", "K05",
      """WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS rows FROM orders GROUP BY 1), l AS (SELECT *, lag(rows) OVER (ORDER BY year) AS previous FROM c)
      SELECT *, round_even((rows - previous) * 100.0::DOUBLE / previous * 10, 0) / 10 AS change_pct FROM l WHERE abs(rows - previous) > 0.3::DOUBLE * previous""")
def series_jump(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("rows"))
    return quality.series_jumps(counts, "year", "rows", 0.3)


@plan("bigint year; double EVASAO FORMATURA; boolean inside", "K06",
      f"""WITH {D.ENROLMENTS}, s AS (SELECT entry_year AS year, 100.0::DOUBLE * count(*) FILTER (outcome = 'EVASAO') / count(*) AS e,
        100.0::DOUBLE * count(*) FILTER (outcome = 'FORMATURA') / count(*) AS f FROM enrolments GROUP BY 1)
      SELECT year, round_even(e * 10, 0) / 10 AS "EVASAO", round_even(f * 10, 0) / 10 AS "FORMATURA", e BETWEEN 33 AND 60 AND f BETWEEN 33 AND 70 AS inside FROM s""")
def outcome_bands(t: Tables) -> DataFrame:
    bands = {"EVASAO": (33, 60), "FORMATURA": (33, 70)}
    return quality.outcome_shares(D.enrolments(t), "entry_year", bands).withColumnRenamed("entry_year", "year")


@plan("bigint suppkey missing_year before after", "K07 C06 C12",
      """WITH c AS (SELECT l_suppkey AS suppkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem WHERE NOT (l_suppkey = 7 AND year(l_shipdate) = 1997) GROUP BY ALL
      ), last AS (SELECT max(y) AS y FROM c)
      SELECT a.suppkey, a.y + 1 AS missing_year, a.n AS before, b.n AS after FROM c a JOIN c b ON b.suppkey = a.suppkey AND b.y = a.y + 2
      WHERE a.n >= 60 AND b.n >= 60 AND b.y < (SELECT y FROM last) AND NOT EXISTS (SELECT 1 FROM c m WHERE m.suppkey = a.suppkey AND m.y = a.y + 1)""")
def vanishing_key(t: Tables) -> DataFrame:
    """All lines; the fault put in is that one supplier has none in one year."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year"))
    return quality.vanishing_keys(rows.filter("NOT (suppkey = 7 AND year = 1997)"), "suppkey", "year", 60)


@plan("double median; boolean inside", "K08",
      f"WITH {D.METRICS} SELECT round_even(quantile_cont(dropout_pct, 0.5) * 1e6, 0) / 1e6 AS median, quantile_cont(dropout_pct, 0.5) BETWEEN 30 AND 60 AS inside FROM metrics")
def median_band(t: Tables) -> DataFrame:
    return quality.median_band(metrics(t), "dropout_pct", 30, 60).withColumn("median", half_even(F.col("median"), 6))


@plan("string check severity; bigint failures", "K09",
      f"""WITH {D.METRICS}, f AS (SELECT 'parts' AS "check", (SELECT count(*) FROM metrics WHERE graduates + dropouts + actives > total - 0) AS failures
        UNION ALL SELECT 'exit_before_entry', count(*) FILTER (exit_year < entry_year AND outcome = 'FORMATURA') FROM enrolments
        UNION ALL SELECT 'estimated_exit_before_entry', count(*) FILTER (exit_year < entry_year AND outcome = 'ATIVO') FROM enrolments)
      SELECT "check", failures, CASE WHEN failures > 50 THEN 'error' WHEN failures > 0 THEN 'warning' ELSE 'pass' END AS severity FROM f""")
def domain_checks(t: Tables) -> DataFrame:
    parts = quality.parts_exceed_whole(metrics(t), ["graduates", "dropouts", "actives"], "total")
    early = F.col("exit_year") < F.col("entry_year")
    both = D.enrolments(t).agg(
        F.count_if(early & (F.col("outcome") == "FORMATURA")).alias("a"), F.count_if(early & (F.col("outcome") == "ATIVO")).alias("b")
    ).selectExpr("stack(2, 'exit_before_entry', a, 'estimated_exit_before_entry', b) AS (check, failures)")
    rows = parts.agg(F.count("*").alias("failures")).select(F.lit("parts").alias("check"), "failures").unionByName(both)
    return rows.withColumn("severity", quality.severity(F.col("failures"), 50))


@plan("string table column status; bigint rows below_k", "K11 D03",
      """SELECT 'by_customer' AS "table", 'orders' AS "column", count(*) AS rows, count(*) FILTER (orders < 5) AS below_k,
        CASE WHEN count(*) FILTER (orders < 5) = 0 THEN 'OK' ELSE 'VIOLAÇÃO' END AS status FROM (SELECT count(*) AS orders FROM orders GROUP BY o_custkey)
      UNION ALL SELECT 'by_status', 'orders', count(*), count(*) FILTER (orders < 5), CASE WHEN count(*) FILTER (orders < 5) = 0 THEN 'OK' ELSE 'VIOLAÇÃO' END
        FROM (SELECT count(*) AS orders FROM orders GROUP BY o_orderstatus)""")
def min_cell(t: Tables) -> DataFrame:
    def counted(key: str) -> DataFrame:
        return t.orders.groupBy(key).agg(F.count("*").alias("orders"))

    return privacy.min_cell({"by_customer": (counted("o_custkey"), "orders"), "by_status": (counted("o_orderstatus"), "orders")})


@plan("string table status; bigint source_rows target_rows", "K13",
      """WITH c AS (SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS target_rows
        UNION ALL SELECT 'customer', (SELECT count(*) FROM customer WHERE c_acctbal > 0), (SELECT count(*) FROM customer)
        UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size > 1)
        UNION ALL SELECT 'supplier', NULL, (SELECT count(*) FROM supplier))
      SELECT *, CASE WHEN source_rows IS NULL THEN 'NAO_VERIFICADO' WHEN source_rows = target_rows THEN 'RECONCILIADO'
        WHEN target_rows > source_rows THEN 'RECONCILIADO_COM_EXTRAS' ELSE 'DIVERGENTE' END AS status FROM c""")
def count_reconcile(t: Tables) -> DataFrame:
    pairs = {
        "orders": (t.orders, t.orders), "customer": (t.customer.filter("c_acctbal > 0"), t.customer),
        "part": (t.part, t.part.filter("p_size > 1")), "supplier": (None, t.supplier),
    }
    counts = None
    for name, (source, target) in pairs.items():
        rows = target.agg(F.count("*").alias("target_rows")).select(
            F.lit(name).alias("table"), F.lit(False).alias("error"), "target_rows",
            (F.lit(None).cast("bigint") if source is None else source.agg(F.count("*")).scalar()).alias("source_rows"),
        )
        counts = rows if counts is None else counts.unionByName(rows)
    return quality.count_reconciliation(counts)


@plan("string table status verdict; bigint rows", "K14",
      """SELECT 'customer' AS "table", 'VIOLAÇÃO LGPD' AS status, 'FALHA_CRITICA' AS verdict, count(*) AS rows FROM customer
      UNION ALL SELECT 'discentes', 'OK', 'FALHA_CRITICA', 0 UNION ALL SELECT 'bronze', 'INCONCLUSIVO', 'FALHA_CRITICA', NULL
      UNION ALL SELECT 'absent', 'OK', 'FALHA_CRITICA', 0""")
def restricted_empty(t: Tables) -> DataFrame:
    found = t.customer.agg(F.count("*").alias("rows")).select(F.lit("customer").alias("table"), F.lit(True).alias("present"), "rows")
    none = t.customer.filter("c_custkey < 0").agg(F.count("*").alias("rows")).select(
        F.lit("discentes").alias("table"), F.lit(True).alias("present"), "rows"
    )
    others = ordering.literal_table(
        t.spark, "table string, present boolean, rows bigint", [("bronze", True, None), ("absent", False, 0)]
    )
    rows = quality.restricted_empty(found.unionByName(none).unionByName(others))
    return rows.withColumn("verdict", quality.verdict(rows, ["OK"]).scalar())


_CLEAN = """SELECT o_orderkey AS id, o_custkey AS person, o_orderstatus AS status, o_orderpriority AS kind, year(o_orderdate) AS year,
  year(o_orderdate) + o_orderkey % 5 AS exit_year, o_orderkey % 9 + 1 AS terms FROM orders"""
# name: (columns that change, filter, rows added), in SQL that both sides read
_FAULTS = {
    "none": ({}, "true", False),
    "half the rows are missing": ({}, "id % 2 = 1", False),
    "a row comes twice": ({}, "true", True),
    "people unknown": ({"person": "CASE WHEN id = first THEN person END"}, "true", False),
    "an unknown status": ({"status": "CASE WHEN id = first THEN 'X' ELSE status END"}, "true", False),
    "a year out of range": ({"year": "CASE WHEN id = first THEN 1900 ELSE year END"}, "true", False),
    "an unknown person": ({"person": "CASE WHEN id = first THEN -1 ELSE person END"}, "true", False),
    "a cohort halved": ({}, "year <> 1998 OR id % 2 = 1", False),
    "dropouts of a cohort renamed": ({"status": "CASE WHEN status = 'P' AND year = 1997 THEN 'O' ELSE status END"}, "true", False),
    "a kind vanishes from a cohort": ({}, "NOT (kind = '5-LOW' AND year = 1998)", False),
    "negative permanence": ({"terms": "CASE WHEN id = first THEN -3 ELSE terms END"}, "true", False),
    "exit before entry": ({"exit_year": "CASE WHEN id = first THEN year - 2 ELSE exit_year END"}, "true", False),
    "graduates counted as dropouts": ({"status": "CASE WHEN status = 'F' THEN 'P' ELSE status END"}, "true", False),
}
_COLUMNS = ("id", "person", "status", "kind", "year", "exit_year", "terms")


def _matrix_sql() -> str:
    """Every fault's table, and every check on all of them at once."""
    tables = []
    for name, (changes, kept, doubled) in _FAULTS.items():
        columns = ", ".join(f"{changes.get(c, c)} AS {c}" for c in _COLUMNS)
        tables.append(f"SELECT '{name}' AS fault, {columns} FROM firsts WHERE {kept}" + (f" UNION ALL SELECT '{name}', {columns} FROM firsts WHERE id = first" if doubled else ""))
    return f"""WITH clean AS ({_CLEAN}), firsts AS (SELECT *, (SELECT min(id) FROM clean) AS first FROM clean), faulty AS ({" UNION ALL ".join(tables)}
      ), last AS (SELECT fault, max(year) AS y, count(*) AS n FROM faulty GROUP BY 1
      ), cohort AS (SELECT fault, year, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (status = 'F') / count(*) AS f, 100.0::DOUBLE * count(*) FILTER (status = 'P') / count(*) AS p
        FROM faulty JOIN last USING (fault) WHERE year < y AND year > 1900 GROUP BY ALL
      ), kinds AS (SELECT fault, kind, year, count(*) AS n FROM faulty GROUP BY ALL
      ), shares AS (SELECT fault, person, 100.0::DOUBLE * count(*) FILTER (status = 'P') / count(*) AS p FROM faulty WHERE person IS NOT NULL GROUP BY ALL
      ), found AS (
        SELECT fault, 'volume' AS tripped, CASE WHEN n BETWEEN 0.9 * (SELECT count(*) FROM clean) AND 1.1 * (SELECT count(*) FROM clean) THEN 0 ELSE 1 END AS failures FROM last
        UNION ALL SELECT fault, 'unique:id', count(*) FROM (SELECT fault, id FROM faulty GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
        UNION ALL SELECT fault, 'not_null:person', count(*) FROM faulty WHERE person IS NULL GROUP BY 1
        UNION ALL SELECT fault, 'accepted:status', count(*) FROM faulty WHERE status NOT IN ('F', 'O', 'P') GROUP BY 1
        UNION ALL SELECT fault, 'range:year', count(*) FROM faulty WHERE year NOT BETWEEN 1962 AND 2100 GROUP BY 1
        UNION ALL SELECT fault, 'range:terms', count(*) FROM faulty WHERE terms NOT BETWEEN 1 AND 35 GROUP BY 1
        UNION ALL SELECT fault, 'related:person', count(*) FROM faulty WHERE person NOT IN (SELECT c_custkey FROM customer) GROUP BY 1
        UNION ALL SELECT fault, 'series', count(*) FROM (SELECT fault, n, lag(n) OVER (PARTITION BY fault ORDER BY year) AS b FROM cohort) WHERE abs(n - b) > 0.3 * b GROUP BY 1
        UNION ALL SELECT fault, 'bands', count(*) FROM cohort WHERE NOT (f BETWEEN 15 AND 55 AND p BETWEEN 15 AND 55) GROUP BY 1
        UNION ALL SELECT a.fault, 'vanishing', count(*) FROM kinds a JOIN kinds b ON b.fault = a.fault AND b.kind = a.kind AND b.year = a.year + 2 JOIN last l ON l.fault = a.fault
          WHERE b.year < l.y AND a.n >= 15 AND b.n >= 15 AND NOT EXISTS (SELECT 1 FROM kinds m WHERE m.fault = a.fault AND m.kind = a.kind AND m.year = a.year + 1) GROUP BY 1
        UNION ALL SELECT fault, 'median', CASE WHEN quantile_cont(p, 0.5) BETWEEN 15 AND 55 THEN 0 ELSE 1 END FROM shares GROUP BY 1
        UNION ALL SELECT fault, 'domain:exit', count(*) FROM faulty WHERE exit_year < year GROUP BY 1
        UNION ALL SELECT fault, 'schema', 0 FROM last UNION ALL SELECT 'a column changes its type', 'schema', 1)
      SELECT fault AS mutation, tripped, failures FROM found WHERE failures > 0"""


@plan("string mutation tripped; bigint failures", "K01 K02 K03 K04 K05 K06 K07 K08 K09 K15", _matrix_sql())
def bad_data_matrix(t: Tables) -> DataFrame:
    """Each fault put into the orders, and the checks that it trips: the faults are one more column, so each check runs once for all."""
    clean = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("year"),
    ).withColumns({"exit_year": F.expr("year + id % 5"), "terms": F.expr("id % 9 + 1")})
    clean = pinned(clean)
    size, first = clean.agg(F.count("*"), F.min("id")).first()
    schema, by = clean.schema, ["mutation"]

    def row(name: str, changes: dict[str, str], kept: str):
        changed = [F.expr(changes.get(c, c)).cast(schema[c].dataType).alias(c) for c in _COLUMNS]
        return F.when(F.expr(kept), F.struct(F.lit(name).alias("mutation"), *changed))

    rows = [row(name, changes, kept) for name, (changes, kept, _) in _FAULTS.items()]
    rows += [row(name, changes, "id = first") for name, (changes, _, doubled) in _FAULTS.items() if doubled]
    faulty = clean.withColumn("first", F.lit(first)).select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    quality.assert_schema(faulty.drop("mutation"), schema)

    rules = [
        Rule("unique", "id"), Rule("not_null", "person"), Rule("accepted", "status", ("F", "O", "P")), Rule("range", "year", (1962, 2100)),
        Rule("range", "terms", (1, 35)), Rule("related", "person", table=t.customer, target="c_custkey"), Rule("true", "NOT exit_year < year"),
    ]
    found = quality.column_checks(faulty, rules, by).select(
        "mutation", F.when(F.col("check").startswith("true:"), "domain:exit").otherwise(F.col("check")).alias("tripped"), "failures"
    )
    last = pinned(faulty.groupBy("mutation").agg(F.max("year").alias("last")))  # a row a fault
    cohorts_ = faulty.join(F.broadcast(last), "mutation").filter((F.col("year") < F.col("last")) & (F.col("year") > 1900))
    counts = cohorts_.groupBy("mutation", "year").agg(F.count("*").alias("n"))
    outcomes = cohorts_.withColumnRenamed("status", "outcome")
    share = faulty.filter("person IS NOT NULL").groupBy("mutation", "person").agg((F.count_if(F.col("status") == "P") * 100.0 / F.count("*")).alias("p"))
    parts = {
        "volume": quality.volume(faulty, -(-9 * size // 10), 11 * size // 10, by).filter("NOT inside"),
        "series": quality.series_jumps(counts, "year", "n", by=by),
        "bands": quality.outcome_shares(outcomes, "year", {"F": (15, 55), "P": (15, 55)}, by).filter("NOT inside"),
        "vanishing": quality.vanishing_keys(faulty, "kind", "year", 15, by),
        "median": quality.median_band(share, "p", 15, 55, by).filter("NOT inside"),
    }
    for check, part in parts.items():
        found = found.unionByName(part.groupBy("mutation").agg(F.count("*").alias("failures")).select("mutation", F.lit(check).alias("tripped"), "failures"))
    try:
        quality.assert_schema(clean.withColumn("terms", F.col("terms").cast("decimal(10,1)")), schema)
    except quality.SchemaMismatch:
        found = found.unionByName(t.spark.range(1).select(
            F.lit("a column changes its type").alias("mutation"), F.lit("schema").alias("tripped"), F.lit(1).cast("bigint").alias("failures")
        ))
    return found.filter("failures > 0")


@plan("string column; bigint rows first_row", "K16",
      """WITH r AS (SELECT c_custkey + 1 AS n, CASE WHEN c_nationkey = 3 THEN 'NULL' ELSE c_name END AS name, CASE WHEN c_acctbal < -900 THEN 'NULL' ELSE c_mktsegment END AS segment FROM customer)
      SELECT 'name' AS "column", count(*) FILTER (name = 'NULL') AS rows, min(n) FILTER (name = 'NULL') AS first_row FROM r
      UNION ALL SELECT 'segment', count(*) FILTER (segment = 'NULL'), min(n) FILTER (segment = 'NULL') FROM r""")
def literal_nulls(t: Tables) -> DataFrame:
    rows = t.customer.select(
        (F.col("c_custkey") + 1).alias("line"),
        F.when(F.col("c_nationkey") == 3, "NULL").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_acctbal") < -900, "NULL").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return quality.literal_nulls(rows, ["name", "segment"], "line")


@plan("bigint orderkey; string day", "K17",
      """SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2001-06-30'""")
def future_dates(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return quality.future_dates(rows, day_month_year(F.col("day")), F.lit("2001-06-30").cast("date"), "orderkey")


@plan("bigint year active_before cancelled_before listed_after", "K18",
      """WITH b AS (SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'O') AS active_before, count(*) FILTER (o_orderstatus = 'P') AS cancelled_before FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1
      ), a AS (SELECT year(o_orderdate) AS year, count(*) AS listed_after FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 300000 AND year(o_orderdate) > 1995 GROUP BY 1)
      SELECT year, coalesce(active_before, 0) AS active_before, coalesce(cancelled_before, 0) AS cancelled_before, coalesce(listed_after, 0) AS listed_after FROM b FULL JOIN a USING (year)""")
def status_drift(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    newer = rows.filter("o_orderstatus = 'O' AND o_totalprice < 300000 AND year > 1995")
    status = F.col("o_orderstatus")
    return quality.status_drift(rows.filter("year < 2001"), newer, "year", status == "O", status == "P")


@plan("string course", "K19 C01",
      f"""WITH {D.CURRICULA}, rules(origin, target) AS (VALUES {_RULES_SQL}), r AS (
        SELECT DISTINCT split_part(course, ' - ', 1) || ' - ' || coalesce(target, area) AS course FROM programmes LEFT JOIN rules ON origin = area)
      SELECT course FROM r WHERE course NOT IN ('NATION_3 - BUILDING') AND course NOT IN (SELECT course FROM curricula WHERE course NOT IN ({_TRUNK_SQL}))""")
def uncovered_keys(t: Tables) -> DataFrame:
    cells = resolved(t)
    names = cells.select(F.col("resolved").alias("course"))
    return quality.uncovered_keys(names, known_curricula(cells), "course", ["NATION_3 - BUILDING"])


@plan("string check; double age_days; boolean inside", "K20",
      """WITH s AS (SELECT event_type AS source, max(ts) AS published FROM events GROUP BY 1), p AS (SELECT TIMESTAMP '2024-01-30 23:50:00' AS processed, TIMESTAMP '2024-03-05 06:00:00' AS now)
      SELECT 'source:' || source AS "check", CASE WHEN published > processed THEN round_even(greatest((epoch_us(now) - epoch_us(published)) / 86400000000, 0) * 1e6, 0) / 1e6 ELSE 0 END AS age_days,
        CASE WHEN published > processed THEN (epoch_us(now) - epoch_us(published)) / 86400000000 ELSE 0 END <= 35 AS inside FROM s CROSS JOIN p
      UNION ALL SELECT 'processing', round_even((epoch_us(now) - epoch_us(processed)) / 86400000000 * 1e6, 0) / 1e6, (epoch_us(now) - epoch_us(processed)) / 86400000000 <= 35 FROM p""")
def freshness(t: Tables) -> DataFrame:
    def moment(text: str):
        return F.lit(text).cast("timestamp_ntz").cast("timestamp")

    sources = t.events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").cast("timestamp").alias("published"))
    rows = quality.freshness(sources, moment("2024-01-30 23:50:00"), moment("2024-03-05 06:00:00"))
    return rows.withColumn("age_days", half_even(F.col("age_days"), 6))


