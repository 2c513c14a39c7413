"""Joins: resolution, enrichment, existence, null-safe and prefix keys, rates in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.alias_rules import alias_rows
from ..functions.numbers import half_even
from ..functions.records import sha1_key
from ..operators import cohorts, dimensional, ordering, programme, quality, resolve
from ..session import pinned
from . import domain as D
from .cohort_queries import metrics
from .registry import Tables, plan

_RULES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in D.ALIASES)
_TRUNK_SQL = ", ".join(f"'{c}'" for c in D.TRUNK)


def rules(t: Tables) -> DataFrame:
    rows = [(a, b, i) for i, (a, b) in enumerate(D.ALIASES)]
    return ordering.literal_table(t.spark, "origin string, target string, place int", rows)


def resolved(t: Tables) -> DataFrame:
    """Outcome cells with the programme that the alias rules give: the rules see cells, not rows."""
    cells = D.cube(t, "area")
    named = resolve.resolve(cells, rules(t), "area", "origin", "target", "area_resolved")
    return named.withColumn("resolved", F.concat_ws(" - ", F.split("course", " - ", 2)[0], "area_resolved"))


def known_curricula(cells: DataFrame) -> DataFrame:
    return cohorts.deadlines(cells, "course").filter(~F.col("course").isin(*D.TRUNK))


_RESOLVED = f"""{D.CURRICULA}, rules(origin, target) AS (VALUES {_RULES_SQL}), resolved AS (
  SELECT e.*, split_part(course, ' - ', 1) || ' - ' || coalesce(target, area) AS resolved
  FROM enrolments e LEFT JOIN rules ON origin = area
), known AS (SELECT * FROM curricula WHERE course NOT IN ({_TRUNK_SQL}))"""


PUBLISHED_SQL = "published(origin, target, place) AS (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for a, b, _, i in alias_rows()) + ")"
# Every customer has one of the published names, or one of eight names that no rule knows.
_NAMED = f"""{D.ENROLMENTS}, {PUBLISHED_SQL}, named AS (
  SELECT e.*, coalesce(p.origin, 'PROGRAMA ' || (e.person % 80)) AS published FROM enrolments e LEFT JOIN published p ON p.place = e.person % 80
)"""


def published_rules(t: Tables) -> DataFrame:
    return ordering.literal_table(t.spark, "origin string, target string, category string, place int", alias_rows())


def named(t: Tables) -> DataFrame:
    """Enrolments with a programme name as the sources publish it."""
    names = published_rules(t).select(F.col("origin"), F.col("place").cast("bigint").alias("place"))
    rows = D.enrolments(t).withColumn("place", F.col("person") % 80).join(names, "place", "left")
    return rows.withColumn("published", F.coalesce("origin", F.concat(F.lit("PROGRAMA "), F.col("place").cast("string")))).drop("origin", "place")


@plan("string course; bigint rows; double ideal", "C01 C02",
      f"""WITH {_NAMED}, r AS (SELECT n.*, coalesce(p.target, n.published) AS resolved FROM named n LEFT JOIN published p ON p.origin = n.published
      ), known AS (SELECT resolved, round_even(quantile_cont(permanence, 0.5) * 10, 0) / 10 AS ideal FROM r GROUP BY 1 HAVING resolved NOT LIKE 'PROGRAMA %')
      SELECT resolved AS course, count(*) AS rows, min(ideal) AS ideal FROM r LEFT JOIN known USING (resolved) GROUP BY 1""")
def entity_resolution(t: Tables) -> DataFrame:
    """Names resolved by all published rules; names of no rule stay and have no curriculum."""
    cells = pinned(cohorts.outcome_cube(named(t), "published"))
    found = resolve.resolve(cells, published_rules(t), "published", "origin", "target", "course")
    known = cohorts.deadlines(found.filter(~F.col("course").startswith("PROGRAMA ")), "course").select("course", "ideal")
    return found.groupBy("course").agg(F.sum("n").alias("rows")).join(known, "course", "left")


@plan("string course campus area degree; bigint total projects; double per_100", "C04 D28",
      f"""WITH {D.METRICS}, grants AS (
        SELECT course, count(*) AS projects FROM orders JOIN programmes ON o_custkey = person
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND campus <> 'ASIA' GROUP BY 1
      ), places AS (SELECT DISTINCT course, campus, area FROM programmes WHERE campus <> 'EUROPE'
      ), mixed AS (SELECT course FROM programmes GROUP BY 1 HAVING count(DISTINCT person % 2) > 1 AND count(*) > 12)
      SELECT m.course, coalesce(campus, 'DARCY RIBEIRO') AS campus, coalesce(area, 'OUTRA') AS area,
        CASE WHEN x.course IS NOT NULL THEN 'MISTO' ELSE 'BACHAREL' END AS degree, total, coalesce(projects, 0) AS projects,
        round_even(coalesce(projects, 0) / total * 100 * 100, 0) / 100 AS per_100
      FROM metrics m LEFT JOIN grants USING (course) LEFT JOIN places USING (course) LEFT JOIN mixed x ON x.course = m.course""")
def enrich_left(t: Tables) -> DataFrame:
    """Campuses and priorities are left out of two sides so that some programmes have no match there: they get the defaults."""
    who = D.programmes(t)
    places = who.filter(F.col("campus") != "EUROPE").select("course", "campus", "area").distinct()
    parity = F.col("person") % 2
    mixed = (
        who.groupBy("course").agg(F.min(parity).alias("a"), F.max(parity).alias("b"), F.count("*").alias("n"))
        .filter("a <> b AND n > 12").select("course", F.lit(True).alias("mixed"))
    )
    grants = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(
        who.filter(F.col("campus") != "ASIA"), F.col("o_custkey") == F.col("person")
    ).groupBy("course").agg(F.count("*").alias("projects"))
    joined = metrics(t).join(grants, "course", "left").join(places, "course", "left").join(mixed, "course", "left")
    projects = F.coalesce("projects", F.lit(0))
    return joined.select(
        "course",
        F.coalesce("campus", F.lit("DARCY RIBEIRO")).alias("campus"),
        F.coalesce("area", F.lit("OUTRA")).alias("area"),
        F.when(F.col("mixed"), "MISTO").otherwise("BACHAREL").alias("degree"),
        "total",
        projects.alias("projects"),
        half_even(projects / F.col("total") * 100, 2).alias("per_100"),
    )


@plan("bigint custkey; double balance", "C05 D05",
      """WITH l AS (SELECT quantile_cont(c_acctbal, 0.05) AS low, quantile_cont(c_acctbal, 0.95) AS high FROM customer)
      SELECT c_custkey AS custkey, round_even(least(greatest(c_acctbal, low), high) * 100, 0) / 100 AS balance
      FROM customer CROSS JOIN l""")
def cross_limits(t: Tables) -> DataFrame:
    limits = ordering.exact_percentiles(t.customer, [], "c_acctbal", {"low": 0.05, "high": 0.95})
    limit = limits.select(F.struct("low", "high")).scalar()
    rows = t.customer.select("c_custkey", "c_acctbal").withColumn("l", limit)
    return rows.select(
        F.col("c_custkey").alias("custkey"),
        half_even(F.least(F.greatest(F.col("c_acctbal"), F.col("l.low")), F.col("l.high")), 2).alias("balance"),
    )


@plan("bigint custkey; string segment", "C06",
      """SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def anti_join(t: Tables) -> DataFrame:
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")
    )


@plan("bigint orderkey custkey", "C07",
      """SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders
      WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
        AND o_orderpriority IN ('1-URGENT', '5-LOW') AND NOT (o_orderstatus IN ('P'))""")
def semi_join(t: Tables) -> DataFrame:
    indebted = t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    wanted = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    rows = t.orders.filter(F.array_contains(wanted, F.col("o_orderpriority")) & ~F.col("o_orderstatus").isin("P"))
    return rows.join(indebted, "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")
    )


@plan("string flag status label; bigint lines", "C08 D27",
      """WITH l AS (SELECT l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN 'F' END AS status FROM lineitem
      ), dim AS (SELECT DISTINCT flag, status, flag || coalesce(status, '?') AS label FROM l)
      SELECT l.flag, l.status, label, count(*) AS lines FROM l JOIN dim
        ON dim.flag = l.flag AND dim.status IS NOT DISTINCT FROM l.status GROUP BY ALL""")
def null_safe_join(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "F", "F").alias("status")
    )
    dim = dimensional.distinct_profiles(rows, ["flag", "status"], "?", ["flag"]).select(
        F.col("flag").alias("d_flag"), F.col("status").alias("d_status")
    ).withColumn("label", F.concat("d_flag", F.coalesce("d_status", F.lit("?"))))
    counts = rows.groupBy("flag", "status").agg(F.count("*").alias("lines"))
    return dimensional.null_safe_join(counts, dim, [("flag", "d_flag"), ("status", "d_status")])


@plan("string name value", "C09",
      f"""WITH {D.ENROLMENTS}, known AS (
        SELECT DISTINCT course AS name, CASE WHEN CAST(split_part(split_part(course, ' - ', 1), '_', 2) AS INT) % 2 = 0
          THEN campus ELSE area END AS value FROM programmes
      ), bases AS (SELECT n_name AS name FROM nation UNION SELECT DISTINCT course FROM programmes
      ) SELECT b.name, min(k.value) AS value FROM bases b JOIN known k ON starts_with(k.name, b.name || ' - ')
        WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.name = b.name)
        GROUP BY 1 HAVING count(DISTINCT k.value) = 1""")
def prefix_inherit(t: Tables) -> DataFrame:
    who = D.programmes(t)
    number = F.split(F.split("course", " - ", 2)[0], "_")[1].cast("int")
    known = who.select(
        F.col("course").alias("name"), F.when(number % 2 == 0, F.col("campus")).otherwise(F.col("area")).alias("value")
    ).distinct()
    bases = t.nation.select(F.col("n_name").alias("name")).union(who.select("course"))
    return resolve.inherit_by_prefix(bases, known, "name", "value")


@plan("bigint partkey lists; double score", "C10",
      """WITH s AS (SELECT l_partkey AS p, sum(CAST(l_quantity AS DECIMAL(28,2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS r,
          count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1
      ), a AS (SELECT p, row_number() OVER (ORDER BY q DESC, p) AS x FROM s QUALIFY x <= 30
      ), b AS (SELECT p, row_number() OVER (ORDER BY r DESC, p) AS x FROM s QUALIFY x <= 30
      ), c AS (SELECT p, row_number() OVER (ORDER BY n DESC, p) AS x FROM s QUALIFY x <= 30)
      SELECT p AS partkey, (a.x IS NOT NULL)::INT + (b.x IS NOT NULL)::INT + (c.x IS NOT NULL)::INT AS lists,
        round_even((coalesce(1.0::DOUBLE / (60 + a.x), 0) + coalesce(1.0::DOUBLE / (60 + b.x), 0) + coalesce(1.0::DOUBLE / (60 + c.x), 0)) * 1e8, 0) / 1e8 AS score
      FROM a FULL JOIN b USING (p) FULL JOIN c USING (p)""")
def full_outer_ranks(t: Tables) -> DataFrame:
    # One scan and one shuffle: the three lists read the written sums.
    sums = pinned(t.lineitem.groupBy(F.col("l_partkey").alias("partkey")).agg(
        F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("q"),
        F.sum(F.col("l_extendedprice").cast("decimal(28,2)")).alias("r"),
        F.count_if(F.col("l_returnflag") == "R").alias("n"),
    ))
    lists = None
    for metric in ("q", "r", "n"):
        part = ordering.ranked_per_group(sums, [], [F.desc(metric), F.asc("partkey")], 30).select("partkey", "position")
        lists = part if lists is None else lists.unionByName(part)
    return lists.groupBy("partkey").agg(
        F.count("*").alias("lists"), half_even(F.sum(1.0 / (60 + F.col("position"))), 8).alias("score")
    )


RATES = (("1995-07", 400.0), ("1998-02", 700.0), ("2000-01", 850.5))


@plan("bigint orderkey; double amount", "C11",
      f"""WITH rates(since, v) AS (VALUES {", ".join(f"('{a}', {b})" for a, b in RATES)}
      ), numbered AS (SELECT CASE WHEN row_number() OVER (ORDER BY since) = 1 THEN DATE '0001-01-01' ELSE CAST(since || '-01' AS DATE) END AS first,
          coalesce(CAST(lead(since) OVER (ORDER BY since) || '-01' AS DATE), DATE '9999-01-01') AS until, v FROM rates
      ), months AS (SELECT o_orderkey, CAST(unnest(generate_series(date_trunc('month', o_orderdate),
          date_trunc('month', o_orderdate + to_months(CAST(o_orderkey % 18 AS INT))), INTERVAL 1 MONTH)) AS DATE) AS m FROM orders)
      SELECT o_orderkey AS orderkey, sum(CAST(v AS DECIMAL(18,2))) AS amount
      FROM months JOIN numbered ON m >= first AND m < until GROUP BY 1""")
def asof_rate_sum(t: Tables) -> DataFrame:
    rates = t.spark.createDataFrame(list(RATES), "since string, v double")
    spans = t.orders.select(
        F.col("o_orderkey").alias("orderkey"),
        F.to_date("o_orderdate").alias("start"),
        F.add_months("o_orderdate", (F.col("o_orderkey") % 18).cast("int")).alias("end"),
    )
    return programme.rate_in_force(spans, "start", "end", rates, "since", "v", "amount")


@plan("bigint person missing_year before after", "C12 K07",
      """WITH c AS (SELECT o_custkey AS person, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL
      ), last AS (SELECT max(y) AS y FROM c)
      SELECT a.person, a.y + 1 AS missing_year, a.n AS before, b.n AS after
      FROM c a JOIN c b ON b.person = a.person AND b.y = a.y + 2
      WHERE a.n >= 2 AND b.n >= 2 AND b.y < (SELECT y FROM last)
        AND NOT EXISTS (SELECT 1 FROM c m WHERE m.person = a.person AND m.y = a.y + 1)""")
def neighbour_cohorts(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("year"))
    return quality.vanishing_keys(rows, "person", "year", 2)


@plan("bigint orderkey; double price share", "C13",
      """SELECT o_orderkey AS orderkey, o_totalprice AS price,
        round_even(o_totalprice / (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey) * 1e4, 0) / 1e4 AS share
      FROM orders o WHERE o_totalprice > 0.5 * (SELECT max(o_totalprice) FROM orders)""")
def scalar_subquery(t: Tables) -> DataFrame:
    highest = t.orders.agg(F.max("o_totalprice")).scalar()
    own = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    big = t.orders.filter(F.col("o_totalprice") > F.lit(0.5) * highest)
    return big.join(own, "o_custkey").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"),
        half_even(F.col("o_totalprice") / F.col("top"), 4).alias("share"),
    )


@plan("string digest; bigint documents uses", "C14",
      """SELECT md5(line) AS digest, count(DISTINCT doc_id) AS documents, count(*) AS uses
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""")
def lateral_explode(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    # One row per (line, document) first: a line that a third of the rows share is combined before it moves.
    per_doc = lines.select("doc_id", F.md5("line").alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("digest").agg(F.count("*").alias("documents"), F.sum("n").alias("uses"))


@plan("bigint partkey suppkey lines; double quantity", "C15",
      """WITH a AS (SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS DECIMAL(28,2))) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
      ), b AS (SELECT l_partkey, l_suppkey, count(*) AS lines FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
      SELECT a.l_partkey AS partkey, a.l_suppkey AS suppkey, lines, quantity FROM a JOIN b
        ON (a.l_partkey, a.l_suppkey) = (b.l_partkey, b.l_suppkey)""")
def composite_join(t: Tables) -> DataFrame:
    """Returned and open lines meet on both keys; the other lines are in neither of the two sides that are compared."""
    keys = [F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")]
    a = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(*keys).agg(
        F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("quantity")
    )
    b = t.lineitem.filter(F.col("l_linestatus") == "O").groupBy(*keys).agg(F.count("*").alias("lines"))
    return a.join(b, ["partkey", "suppkey"])


@plan("bigint total matched unmatched; double matched_pct; string worst", "C16",
      f"""WITH {_RESOLVED}, j AS (SELECT r.course, k.ideal FROM resolved r LEFT JOIN known k ON k.course = r.resolved
      ), w AS (SELECT course, count(*) AS n FROM j WHERE ideal IS NULL GROUP BY 1 ORDER BY n DESC, course LIMIT 10)
      SELECT count(*) AS total, count(ideal) AS matched, count(*) - count(ideal) AS unmatched,
        round_even(count(ideal) / count(*) * 100 * 100, 0) / 100 AS matched_pct,
        (SELECT string_agg(course || '=' || n, ';' ORDER BY n DESC, course) FROM w) AS worst FROM j""")
def match_rate(t: Tables) -> DataFrame:
    cells = resolved(t)
    counts = cells.groupBy("course", "resolved").agg(F.sum("n").alias("n"))
    known = known_curricula(cells).select(F.col("course").alias("resolved"), "ideal")
    placed = counts.join(known, "resolved", "left")
    totals, worst = resolve.match_report(placed, F.col("ideal").isNotNull(), "course", 10, weight="n")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("r"), "course")))
    # At most ten labels.
    names = worst.agg(F.array_join(F.transform(ranked, lambda e: F.concat(e["course"], F.lit("="), -e["r"])), ";")).scalar()
    return totals.withColumn("worst", names)


@plan("string source; bigint rows with_amount with_status people", "C17",
      """SELECT 'SIGRA' AS source, count(*) AS rows, count(o_totalprice) AS with_amount, 0 AS with_status,
        count(DISTINCT o_custkey) AS people FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'SIGAA', count(*), 0, count(o_orderstatus), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'F'""")
def union_sources(t: Tables) -> DataFrame:
    old = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("person"), F.col("o_totalprice").alias("amount"))
    new = t.orders.filter(F.col("o_orderstatus") != "F").select(F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("status"))
    rows = resolve.union_sources({"SIGRA": old, "SIGAA": new})
    per_person = rows.groupBy("source", "person").agg(
        F.count("*").alias("n"), F.count("amount").alias("a"), F.count("status").alias("s")
    )
    return per_person.groupBy("source").agg(
        F.sum("n").alias("rows"), F.sum("a").alias("with_amount"), F.sum("s").alias("with_status"), F.count("*").alias("people")
    )


@plan("string id status; bigint person orderkey", "C18 E06 H11",
      """SELECT sha1(o_custkey::VARCHAR) AS id, o_custkey AS person, o_orderkey AS orderkey, o_orderstatus AS status FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def latest_person(t: Tables) -> DataFrame:
    """The id is a hash of the key: the same after every reload, without a sort of the table."""
    rows = t.orders.select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status")
    )
    return resolve.latest_per_key(rows, "person", F.desc("orderkey")).withColumn("id", sha1_key(F.col("person")))
