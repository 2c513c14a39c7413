"""Aggregations: consolidation, percentiles, benchmarks, reports, privacy and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import half_even
from ..functions.periods import period_end, terms_attended
from ..operators import cohorts, consolidate, dimensional, late, ordering, privacy, programme, quality, resolve, stats
from ..session import pinned
from . import domain as D
from .cohort_queries import mature_cells, metrics, retention
from .join_queries import _NAMED, named, published_rules
from .registry import Tables, plan

_TRUNK_SQL = ", ".join(f"'{c}'" for c in D.TRUNK)


@plan("string flag status; bigint lines large late; double big_discount_pct mean_large", "D04",
      """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS lines, count(*) FILTER (l_quantity > 25) AS large,
        count(l_shipdate) FILTER (l_shipdate > TIMESTAMP '2000-01-01') AS late,
        round_even(count(*) FILTER (l_discount >= 0.05) / count(*) * 100 * 100, 0) / 100 AS big_discount_pct,
        round_even(avg(l_quantity) FILTER (l_quantity > 25) * 100, 0) / 100 AS mean_large FROM lineitem GROUP BY ALL""")
def conditional_agg(t: Tables) -> DataFrame:
    large = F.col("l_quantity") > 25
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count("*").alias("lines"),
        F.count_if(large).alias("large"),
        F.count_if(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz")).alias("late"),
        half_even(F.count_if(F.col("l_discount") >= 0.05) / F.count("*") * 100, 2).alias("big_discount_pct"),
        half_even(F.avg(F.when(large, F.col("l_quantity"))), 2).alias("mean_large"),
    )


@plan("string flag; double p50 p90 p95 p99", "D05",
      """SELECT nullif(l_returnflag, 'R') AS flag, round_even(quantile_cont(l_extendedprice, 0.5) * 1e4, 0) / 1e4 AS p50,
        round_even(quantile_cont(l_extendedprice, 0.9) * 1e4, 0) / 1e4 AS p90, round_even(quantile_cont(l_extendedprice, 0.95) * 1e4, 0) / 1e4 AS p95,
        round_even(quantile_cont(l_extendedprice, 0.99) * 1e4, 0) / 1e4 AS p99 FROM lineitem GROUP BY 1""")
def exact_percentiles(t: Tables) -> DataFrame:
    """The rows with one of the flags stand for rows without a key: they are a group."""
    rows = t.lineitem.select(F.nullif(F.col("l_returnflag"), F.lit("R")).alias("flag"), "l_extendedprice")
    cuts = ordering.exact_percentiles(rows, ["flag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return cuts.select("flag", *[half_even(F.col(c), 4).alias(c) for c in ("p50", "p90", "p95", "p99")])


@plan("string name type brand; bigint size", "D06",
      """SELECT p_name AS name, arg_min(CASE WHEN p_size % 3 <> 0 THEN p_type END, (-p_size, p_partkey)) FILTER (p_size % 3 <> 0) AS type,
        arg_min(p_brand, (-p_size, p_partkey)) FILTER (p_size % 5 <> 0) AS brand,
        arg_min(p_size, (-p_size, p_partkey)) FILTER (p_size < 20) AS size FROM part GROUP BY 1""")
def first_non_null(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rows = t.part.select(
        F.col("p_name").alias("name"), (-size).alias("o1"), F.col("p_partkey").alias("o2"),
        F.when(size % 3 != 0, F.col("p_type")).alias("type"), F.when(size % 5 != 0, F.col("p_brand")).alias("brand"),
        F.when(size < 20, size).alias("size"),
    )
    return consolidate.first_non_null(rows, ["name"], ["type", "brand", "size"], F.col("o1"), F.col("o2"))


@plan("string name type", "D07",
      """SELECT p_name AS name, p_type AS type FROM (SELECT p_name, p_type, count(*) AS n FROM part WHERE p_size > 3 GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_type) = 1""")
def mode_tiebreak(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 3, F.col("p_type")).alias("type"))
    return resolve.mode_per_key(rows, "name", "type")


_OFFERS = """offers AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name,
   CASE WHEN p_size > 40 THEN NULL WHEN p_size % 4 = 0 THEN 'NOTURNO' WHEN p_size % 4 = 1 THEN 'INTEGRAL' ELSE 'MATUTINO' END AS shift,
   CASE WHEN p_type = 'PROMO' THEN 'UNB GAMA' WHEN p_type = 'SMALL' THEN 'CEILANDIA' WHEN p_type = 'LARGE' THEN NULL ELSE 'DARCY' END AS campus,
   CASE WHEN p_retailprice > 1300 THEN 'LICENCIADO' ELSE 'BACHAREL' END AS degree, p_type AS area,
   p_size % 2 = 0 AS current, p_size AS size FROM part)"""


def offers(t: Tables) -> DataFrame:
    """Parts as programme offers: name, shift, campus, degree, area, whether in the current catalogue."""
    size, kind = F.col("p_size"), F.col("p_type")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("name"),
        F.when(size > 40, None).when(size % 4 == 0, "NOTURNO").when(size % 4 == 1, "INTEGRAL").otherwise("MATUTINO").alias("shift"),
        F.when(kind == "PROMO", "UNB GAMA").when(kind == "SMALL", "CEILANDIA").when(kind == "LARGE", None)
        .otherwise("DARCY").alias("campus"),
        F.when(F.col("p_retailprice") > 1300, "LICENCIADO").otherwise("BACHAREL").alias("degree"),
        kind.alias("area"),
        (size % 2 == 0).alias("current"),
        size.alias("size"),
    )


@plan("string name shift campus; boolean mixed", "D08 G01",
      f"""WITH {_OFFERS}, s AS (SELECT DISTINCT name, CASE shift WHEN 'MATUTINO' THEN 'DIURNO' ELSE shift END AS v FROM offers WHERE shift IS NOT NULL
      ), c AS (SELECT DISTINCT name, CASE campus WHEN 'UNB GAMA' THEN 'FACULDADE DE CIENCIAS E TECNOLOGIAS EM ENGENHARIA (FCTE)'
         WHEN 'CEILANDIA' THEN 'FACULDADE DE CIENCIAS E TECNOLOGIAS EM SAUDE (FCTS)' ELSE 'DARCY RIBEIRO' END AS v FROM offers WHERE campus IS NOT NULL
      ), s2 AS (SELECT name, string_agg(v, ' E ' ORDER BY v) AS shift FROM s GROUP BY 1
      ), c2 AS (SELECT name, CASE WHEN count(*) > 1 THEN 'MULTICAMPUS' ELSE min(v) END AS campus FROM c GROUP BY 1)
      SELECT n.name, coalesce(shift, 'DIURNO') AS shift, coalesce(campus, 'DARCY RIBEIRO') AS campus, mixed
      FROM (SELECT name, count(DISTINCT degree) > 1 AS mixed FROM offers GROUP BY 1) n LEFT JOIN s2 USING (name) LEFT JOIN c2 USING (name)""")
def collapse_distinct(t: Tables) -> DataFrame:
    rows = offers(t)
    mixed = consolidate.mixed_keys(rows, "name", "degree").withColumn("mixed", F.lit(True))
    return consolidate.offers(rows, "name", "shift", "campus").join(mixed, "name", "left").fillna(False, ["mixed"])


@plan("string name; double ideal low high hours; bigint owner", "D09",
      """SELECT p_name AS name, median(p_size) AS ideal, min(p_size) AS low, max(p_size) AS high,
        max(p_retailprice) AS hours, arg_min(p_partkey, (-(p_size % 10), p_partkey)) AS owner
      FROM part WHERE p_size > 2 GROUP BY 1""")
def consolidate_mixed(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rows = t.part.select(
        F.col("p_name").alias("name"), (size % 10).alias("year"), F.when(size > 2, size).alias("ideal"),
        size.alias("low"), size.alias("high"), F.col("p_retailprice").alias("hours"), F.col("p_partkey").alias("owner"),
        F.col("p_partkey").alias("tie"),
    )
    return consolidate.consolidate_curricula(rows, "name", "year", "ideal", "low", "high", ["hours"], "owner", "tie")


@plan("bigint person; double price; string priority; boolean current", "D10",
      """WITH v AS (SELECT o_custkey AS person, year(o_orderdate) AS y, max(o_totalprice) AS price, min(o_orderpriority) AS priority FROM orders GROUP BY ALL
      ) SELECT person, arg_max(price, y) FILTER (price > 200000) AS price, arg_max(priority, y) FILTER (priority <> '1-URGENT') AS priority,
        max(y) = (SELECT max(y) FROM v) AS current FROM v GROUP BY 1""")
def latest_non_null(t: Tables) -> DataFrame:
    versions = t.orders.groupBy(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("y")).agg(
        F.max("o_totalprice").alias("price"), F.min("o_orderpriority").alias("priority")
    )
    rows = versions.select(
        "person", "y", F.when(F.col("price") > 200000, F.col("price")).alias("price"),
        F.when(F.col("priority") != "1-URGENT", F.col("priority")).alias("priority"),
    )
    return consolidate.latest_non_null(rows, "person", ["price", "priority"], "y", "current")


@plan("bigint first_cohort last_cohort analysed graduates; double within_ideal_pct above_ideal_pct mean_terms mean_delay; string most_critical most_punctual",
      "D11", f"""WITH {D.RISK}, m AS (SELECT * FROM mature), g AS (SELECT min(entry_year) AS first_cohort, max(entry_year) AS last_cohort, count(*) AS analysed,
        count(*) FILTER (outcome = 'FORMATURA') AS graduates, count(permanence) FILTER (outcome = 'FORMATURA') AS timed,
        count(*) FILTER (outcome = 'FORMATURA' AND permanence <= ideal) AS n_in, count(*) FILTER (outcome = 'FORMATURA' AND permanence > ideal) AS n_out,
        avg(permanence) FILTER (outcome = 'FORMATURA') AS mean, avg(permanence - ideal) FILTER (outcome = 'FORMATURA') AS delay FROM m)
      SELECT first_cohort, last_cohort, analysed, graduates, round_even(n_in / timed * 100 * 100, 0) / 100 AS within_ideal_pct,
        round_even(n_out / timed * 100 * 100, 0) / 100 AS above_ideal_pct, round_even(mean * 100, 0) / 100 AS mean_terms,
        round_even(delay * 100, 0) / 100 AS mean_delay,
        (SELECT string_agg(course, ';' ORDER BY risk_index DESC, course) FROM (SELECT * FROM retention ORDER BY risk_index DESC, course LIMIT 5)) AS most_critical,
        (SELECT string_agg(course, ';' ORDER BY within_ideal_pct DESC, course) FROM (SELECT * FROM retention ORDER BY within_ideal_pct DESC, course LIMIT 5)) AS most_punctual
      FROM g""")
def global_report(t: Tables) -> DataFrame:
    cells = pinned(mature_cells(t))
    from ..operators import score

    table = pinned(score.risk_index(cohorts.outcome_metrics(cells, "course")))

    def names(metric: str):
        top = table.orderBy(F.desc(metric), F.asc("course")).limit(5)
        ordered = F.array_sort(F.collect_list(F.struct((-F.col(metric)).alias("m"), "course")))
        return top.agg(F.array_join(F.transform(ordered, lambda e: e["course"]), ";")).scalar()

    return cohorts.global_totals(cells).withColumn("most_critical", names("risk_index")).withColumn(
        "most_punctual", names("within_ideal_pct")
    )


@plan("string course; double ideal maximum above_ideal_pct; bigint actives above_ideal above_maximum", "D12",
      f"""WITH {D.CURRICULA}, a AS (SELECT course, greatest((2001 - entry_year) * 2 + (1 - CASE WHEN month(entry_at) < 7 THEN 1 ELSE 2 END) + 1, 1) AS terms
        FROM enrolments WHERE outcome = 'ATIVO' AND course NOT IN ({_TRUNK_SQL}))
      SELECT course, min(ideal) AS ideal, min(maximum) AS maximum, count(*) AS actives, count(*) FILTER (terms > ideal) AS above_ideal,
        count(*) FILTER (terms > maximum) AS above_maximum,
        round_even(count(*) FILTER (terms > ideal) / count(*) * 100 * 100, 0) / 100 AS above_ideal_pct
      FROM a JOIN curricula USING (course) GROUP BY 1 HAVING count(*) >= 5""")
def active_snapshot(t: Tables) -> DataFrame:
    rows = D.enrolments(t)
    entry_term = F.when(F.month("entry_at") < 7, 1).otherwise(2)
    attended = terms_attended(F.col("entry_year"), entry_term, F.lit(2001), F.lit(1))
    # Cells carry the terms attended, so one pass over the enrolments feeds the deadlines and the snapshot.
    cells = pinned(rows.groupBy("course", "outcome", "permanence", attended.alias("terms")).agg(F.count("*").alias("n")))
    return cohorts.active_snapshot(
        cells.filter(F.col("outcome") == "ATIVO"), cohorts.deadlines(cells, "course"), "course", D.TRUNK
    )


@plan("string course; bigint mat trancada desvinculado peers; double trancada_pct desvinculado_pct demand_ratio trancada_median desvinculado_median "
      "trancada_gap desvinculado_gap trancada_ratio desvinculado_ratio", "D13",
      """WITH offer AS (SELECT p_name AS course, s_nationkey AS institution, sum(CAST(l_quantity AS BIGINT)) AS students,
          [coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0),
           coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A' AND l_linestatus = 'O'), 0)] AS events,
          sum(l_linenumber) AS applicants, count(*) FILTER (l_tax > 0.04) AS seats
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING students >= 50
      ), side AS (SELECT course, institution = 0 AS at_home, unnest([1, 2]) AS event, unnest(list_transform(events, lambda e: e / students * 100)) AS rate FROM offer
      ), level AS (SELECT course, event, round_even(max(rate) FILTER (at_home) * 100, 0) / 100 AS mine,
          round_even(median(rate) FILTER (NOT at_home) * 100, 0) / 100 AS theirs FROM side GROUP BY ALL
      ), compared AS (SELECT *, round_even((mine - theirs) * 100, 0) / 100 AS gap, round_even(mine / nullif(theirs, 0) * 100, 0) / 100 AS share FROM level
      ), crowd AS (SELECT course, count(*) FILTER (institution <> 0) AS others FROM offer GROUP BY 1)
      SELECT o.course, o.students AS mat, o.events[1] AS trancada, o.events[2] AS desvinculado, nullif(c.others, 0) AS peers,
        x.mine AS trancada_pct, y.mine AS desvinculado_pct, round_even(applicants / nullif(seats, 0) * 100, 0) / 100 AS demand_ratio,
        x.theirs AS trancada_median, y.theirs AS desvinculado_median, x.gap AS trancada_gap, y.gap AS desvinculado_gap,
        x.share AS trancada_ratio, y.share AS desvinculado_ratio
      FROM offer o JOIN crowd c USING (course) JOIN compared x ON x.course = o.course AND x.event = 1 JOIN compared y ON y.course = o.course AND y.event = 2
      WHERE o.institution = 0""")
def peer_benchmark(t: Tables) -> DataFrame:
    amount = F.col("l_quantity").cast("bigint")
    # Sums per part and institution first: the join with the parts sees those, not the lines.
    sums = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey", F.col("s_nationkey").alias("ies")).agg(
        F.sum(amount).alias("mat"), F.sum(F.when(F.col("l_returnflag") == "R", amount)).alias("trancada"),
        F.sum(F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), amount)).alias("desvinculado"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("applicants"), F.count_if(F.col("l_tax") > 0.04).alias("seats"),
    )
    rows = sums.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_name", "course")
    return programme.peer_benchmark(
        rows, "course", "ies", F.col("ies") == 0, "mat", ["trancada", "desvinculado"], ("applicants", "seats")
    )


@plan("string course campus area; bigint projects paid voluntary quota quota_race low_income; double invested quota_pct voluntary_pct", "D14 D03",
      f"""WITH {D.GRANTS} SELECT course, campus, area, count(*) AS projects, count(*) FILTER (kind = 'REMUNERADA') AS paid,
        count(*) FILTER (kind = 'VOLUNTARIA') AS voluntary, count(*) FILTER (is_quota) AS quota,
        count(*) FILTER (profile = 'PPI / ETNICO-RACIAL') AS quota_race, count(*) FILTER (income = 'BAIXA RENDA (<= 1.5 SM)') AS low_income,
        sum(amount) AS invested, round_even(count(*) FILTER (is_quota) / count(*) * 100 * 10, 0) / 10 AS quota_pct,
        round_even(count(*) FILTER (kind = 'VOLUNTARIA') / count(*) * 100 * 10, 0) / 10 AS voluntary_pct
      FROM grants GROUP BY course, campus, area HAVING count(*) >= 5""")
def social_profile(t: Tables) -> DataFrame:
    return programme.social_groups(D.grants(t), ["course", "campus", "area"], weight="n")


@plan("string grain value; bigint projects paid voluntary quota students; double invested projects_pct quota_pct participation_pct", "D15",
      f"""WITH {D.GRANTS}, g AS (
        SELECT CASE GROUPING_ID(profile, quota, campus, area, year) WHEN 15 THEN 'profile' WHEN 23 THEN 'quota' WHEN 27 THEN 'campus' WHEN 29 THEN 'area' WHEN 30 THEN 'year' ELSE 'all' END AS grain,
          coalesce(profile, quota, campus, area, year::VARCHAR, '') AS value, count(*) AS projects, count(*) FILTER (kind = 'REMUNERADA') AS paid,
          count(*) FILTER (kind = 'VOLUNTARIA') AS voluntary, count(*) FILTER (is_quota) AS n_quota, sum(amount) AS invested
        FROM grants GROUP BY GROUPING SETS ((profile), (quota), (campus), (area), (year), ())
      ), people AS (SELECT area AS value, count(*) AS students FROM programmes GROUP BY 1)
      SELECT grain, g.value, projects, paid, voluntary, n_quota AS quota, CASE WHEN grain = 'area' THEN students END AS students, invested,
        round_even(projects / (SELECT count(*) FROM grants) * 100 * 100, 0) / 100 AS projects_pct,
        round_even(n_quota / projects * 100 * 100, 0) / 100 AS quota_pct,
        CASE WHEN grain = 'area' THEN round_even(projects / students * 100 * 100, 0) / 100 END AS participation_pct
      FROM g LEFT JOIN people p ON p.value = g.value AND grain = 'area'""")
def programme_report(t: Tables) -> DataFrame:
    cells = D.grants(t)
    students = D.programmes(t).groupBy("area").agg(F.count("*").alias("students"))
    grains = ["profile", "quota", "campus", "area", "year"]
    return programme.programme_report(pinned(cells), grains, students, "area", weight="n")


@plan("string campus; bigint dropouts total; double dropout_pct", "D16",
      f"""WITH {D.METRICS}, place AS (SELECT DISTINCT course, campus FROM programmes)
      SELECT campus, sum(dropouts) AS dropouts, sum(total) AS total, round_even(sum(dropouts) / sum(total) * 100 * 100, 0) / 100 AS dropout_pct
      FROM metrics JOIN place USING (course) GROUP BY 1""")
def weighted_rates(t: Tables) -> DataFrame:
    place = D.programmes(t).select("course", "campus").distinct()
    return stats.weighted_rate(metrics(t).join(place, "course"), ["campus"], "dropouts", "total", "dropout_pct")


@plan("string area; bigint total dropouts; double mean_pct", "D17",
      f"""WITH {D.METRICS}, place AS (SELECT DISTINCT course, area FROM programmes WHERE area <> 'FURNITURE')
      SELECT area, sum(total) AS total, sum(dropouts) AS dropouts, round_even(sum(CAST(dropout_pct AS DECIMAL(20,4)))::DOUBLE / count(*) * 100, 0) / 100 AS mean_pct
      FROM metrics JOIN place USING (course) GROUP BY 1""")
def unweighted_rates(t: Tables) -> DataFrame:
    place = D.programmes(t).filter(F.col("area") != "FURNITURE").select("course", "area").distinct()
    return stats.mean_rate(metrics(t).join(place, "course"), ["area"], "dropout_pct", ["total", "dropouts"], "mean_pct")


_QUASI = ("p_brand", "p_type", "p_size")


@plan("bigint k groups rows total_rows combinations singletons min_k; double unique_pct", "D18",
      """WITH c AS (SELECT count(*) AS k FROM part GROUP BY p_brand, p_type, p_size), s AS (SELECT k, count(*) AS groups, k * count(*) AS rows FROM c GROUP BY 1
      ), f AS (SELECT sum(rows) AS total_rows, sum(groups) AS combinations, coalesce(sum(groups) FILTER (k = 1), 0) AS singletons, min(k) AS min_k FROM s)
      SELECT s.*, f.*, round_even(singletons / total_rows * 100 * 1e4, 0) / 1e4 AS unique_pct
      FROM s CROSS JOIN f""")
def equivalence_classes(t: Tables) -> DataFrame:
    figures, sizes = privacy.uniqueness(t.part, _QUASI)
    one = figures.select(F.struct(F.col("rows").alias("total_rows"), "combinations", "singletons", "min_k", "unique_pct")).scalar()
    return sizes.withColumn("f", one).select("k", "groups", "rows", "f.*")


@plan("string grain; bigint groups below_k rows_lost rows; double below_k_pct rows_lost_pct", "D19",
      f"""WITH {D.ENROLMENTS}, base AS (SELECT * FROM enrolments WHERE entry_year <= (SELECT max(entry_year) FROM enrolments) - {D.MATURITY}
      ), g AS (SELECT 'course' AS grain, count(*) AS n FROM base GROUP BY course
        UNION ALL SELECT 'course x cohort', count(*) FROM base GROUP BY course, entry_year
        UNION ALL SELECT 'course x cohort x outcome x exit', count(*) FROM base GROUP BY course, entry_year, outcome, exit_year, exit_term
        UNION ALL SELECT 'row', 1 FROM base)
      SELECT grain, count(*) AS groups, count(*) FILTER (n < 5) AS below_k, coalesce(sum(n) FILTER (n < 5), 0) AS rows_lost, sum(n) AS rows,
        round_even(100.0::DOUBLE * count(*) FILTER (n < 5) / count(*) * 10, 0) / 10 AS below_k_pct,
        round_even(100.0::DOUBLE * coalesce(sum(n) FILTER (n < 5), 0) / sum(n) * 10, 0) / 10 AS rows_lost_pct FROM g GROUP BY 1""")
def grain_study(t: Tables) -> DataFrame:
    fine = ["course", "entry_year", "outcome", "exit_year", "exit_term"]
    cells = pinned(D.enrolments(t).groupBy(*fine).agg(F.count("*").alias("n")))
    grains = {"row": [], "course": ["course"], "course x cohort": fine[:2], "course x cohort x outcome x exit": fine}
    return privacy.grain_study(cohorts.mature(cells, "entry_year", D.MATURITY), grains, weight="n")


@plan("bigint load_id year period total; string outcome", "D20",
      f"""WITH {D.ENROLMENTS} SELECT 1 AS load_id, entry_year AS year, outcome, CASE WHEN outcome <> 'ATIVO' THEN exit_year * 10 + exit_term END AS period,
        count(*) AS total FROM enrolments GROUP BY ALL""")
def load_snapshot(t: Tables) -> DataFrame:
    period = F.when(F.col("outcome") != "ATIVO", F.col("exit_year") * 10 + F.col("exit_term"))
    return late.snapshot(D.enrolments(t), F.lit(1), "entry_year", "outcome", period)


@plan("bigint rows; double p50 p90 p95 p99 above_pct", "D21",
      f"""WITH {D.ENROLMENTS}, d AS (SELECT datediff('day', CASE exit_term WHEN 1 THEN make_date(exit_year, 7, 31) ELSE make_date(exit_year, 12, 31) END, exit_at) AS days
        FROM enrolments WHERE outcome = 'FORMATURA')
      SELECT count(*) AS rows, quantile_cont(days, 0.5) AS p50, quantile_cont(days, 0.9) AS p90, quantile_cont(days, 0.95) AS p95,
        quantile_cont(days, 0.99) AS p99, round_even(100.0::DOUBLE * count(*) FILTER (days > 60) / count(*) * 1e6, 0) / 1e6 AS above_pct FROM d""")
def delay_quantiles(t: Tables) -> DataFrame:
    end = period_end(F.col("exit_year") * 10 + F.col("exit_term"))
    rows = D.enrolments(t).filter(F.col("outcome") == "FORMATURA").select(F.datediff("exit_at", end).alias("days"))
    return cohorts.delay_quantiles(rows, "days", 60).withColumn("above_pct", half_even(F.col("above_pct"), 6))


@plan("bigint n; double r", "D22",
      f"""WITH {D.METRICS} SELECT count(*) AS n, round_even(corr(graduation_pct, dropout_pct) * 1e8, 0) / 1e8 AS r FROM metrics WHERE total > 20""")
def pearson(t: Tables) -> DataFrame:
    one = stats.pearson(metrics(t), "graduation_pct", "dropout_pct", F.col("total") > 20)
    return one.withColumn("r", half_even(F.col("r"), 8))


@plan("bigint n; double r t; boolean significant", "D23",
      f"""WITH {D.METRICS}, c AS (SELECT count(*) AS n, corr(log10(total), dropout_pct) AS r FROM metrics)
      SELECT n, round_even(r * 1e8, 0) / 1e8 AS r, round_even(r * sqrt((n - 2) / greatest(1 - r * r, 1e-12)) * 1e6, 0) / 1e6 AS t,
        abs(r * sqrt((n - 2) / greatest(1 - r * r, 1e-12))) > 1.96 AS significant FROM c""")
def log_corr_ttest(t: Tables) -> DataFrame:
    one = stats.log_correlation(metrics(t), "total", "dropout_pct")
    return one.select("n", half_even(F.col("r"), 8).alias("r"), half_even(F.col("t"), 6).alias("t"), "significant")


@plan("double slope intercept", "D24",
      f"""WITH {D.METRICS} SELECT round_even(regr_slope(dropout_pct, graduation_pct) * 1e8, 0) / 1e8 AS slope,
        round_even(regr_intercept(dropout_pct, graduation_pct) * 1e6, 0) / 1e6 AS intercept FROM metrics""")
def trend_line(t: Tables) -> DataFrame:
    one = stats.trend(metrics(t), "graduation_pct", "dropout_pct")
    return one.select(half_even(F.col("slope"), 8).alias("slope"), half_even(F.col("intercept"), 6).alias("intercept"))


@plan("bigint permanence graduates", "D25",
      f"""WITH {D.ENROLMENTS} SELECT permanence, count(*) AS graduates FROM enrolments WHERE course = 'NATION_0 - MACHINERY'
        AND entry_year BETWEEN 1995 AND 1999 AND outcome = 'FORMATURA' AND permanence IS NOT NULL GROUP BY 1""")
def duration_histogram(t: Tables) -> DataFrame:
    return cohorts.duration_histogram(D.enrolments(t), "course", "NATION_0 - MACHINERY", 1995, 1999)


@plan("bigint position rows; string origin target", "D26",
      f"""WITH {_NAMED}, u AS (SELECT published AS origin, count(*) AS n FROM named GROUP BY 1)
      SELECT row_number() OVER (ORDER BY coalesce(n, 0) DESC, place) AS position, coalesce(n, 0) AS rows, origin, target FROM published LEFT JOIN u USING (origin)""")
def rule_usage(t: Tables) -> DataFrame:
    return resolve.rule_usage(named(t), published_rules(t), "published", "origin", "place")


@plan("string profile quota income; boolean is_quota", "D27",
      f"WITH {D.GRANTS} SELECT DISTINCT profile, quota, income, is_quota FROM grants")
def distinct_profiles(t: Tables) -> DataFrame:
    columns = ["profile", "quota", "income", "is_quota"]
    return dimensional.distinct_profiles(D.grants(t), columns, "NAO INFORMADO", ["profile", "quota"])


@plan("string course; bigint projects paid voluntary quota; double invested", "D28",
      f"""WITH {D.GRANTS} SELECT course, count(*) AS projects, count(*) FILTER (kind = 'REMUNERADA') AS paid, count(*) FILTER (kind = 'VOLUNTARIA') AS voluntary,
        count(*) FILTER (is_quota) AS quota, sum(amount) AS invested FROM grants GROUP BY 1""")
def grants_per_course(t: Tables) -> DataFrame:
    return programme.grants_per_key(D.grants(t), "course", weight="n")


@plan("bigint orderkey linenumber rows first_row", "D29",
      """SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, count(*) AS rows, min(l_partkey) AS first_row
      FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), "l_partkey")
    return quality.duplicate_keys(rows, ["orderkey", "linenumber"], "l_partkey")


@plan("bigint rows total dropouts above below watched", "D30",
      f"""WITH {D.RISK} SELECT count(*) AS rows, sum(total) AS total, sum(dropouts) AS dropouts, count(*) FILTER (mean_delay > 0) AS above,
        count(*) FILTER (mean_delay < 0) AS below, count(*) FILTER (risk_class = 'RETENÇÃO CRÍTICA') AS watched FROM retention""")
def kpi_rollup(t: Tables) -> DataFrame:
    return stats.kpis(retention(t), ["total", "dropouts"], "mean_delay", "risk_class", "RETENÇÃO CRÍTICA")
