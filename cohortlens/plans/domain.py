"""The test tables read as enrolments: orders are enrolments, nation x segment is the programme.

Cohort = order year; outcome by order status; the last ship date of an order is its exit; the
exit term and the permanence follow from it. Deadlines of a programme are percentiles of the
valid permanence of its enrolments, one decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labels
from ..functions.periods import exit_term, permanence, valid_permanence
from ..operators import cohorts
from ..session import pinned
from .registry import Tables

MATURITY = 3
OUTCOMES = {"F": "FORMATURA", "P": "EVASAO", "O": "ATIVO"}
# Segments harmonised by the alias rules, and programmes treated as trunk programmes.
ALIASES = (("HOUSEHOLD", "FURNITURE"), ("AUTOMOBILE", "MACHINERY"))
TRUNK = ("NATION_3 - BUILDING", "NATION_7 - MACHINERY")


def programmes(t: Tables) -> DataFrame:
    """(person, course, campus, area) of every customer."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person"),
        F.concat_ws(" - ", "n_name", "c_mktsegment").alias("course"),
        F.col("r_name").alias("campus"),
        F.col("c_mktsegment").alias("area"),
    )


def exits(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("exit_at"))


def enrolments(t: Tables) -> DataFrame:
    """One row per order that has a line, with programme, cohort, outcome, exit and permanence."""
    year, term = exit_term(F.to_date("exit_at"))
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    rows = (
        t.orders.join(exits(t), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(programmes(t), F.col("o_custkey") == F.col("person"))
        .select(
            F.col("o_orderkey").alias("id"), "person", "course", "campus", "area",
            F.to_date("o_orderdate").alias("entry_at"),
            F.year("o_orderdate").alias("entry_year"),
            F.try_element_at(outcome, F.col("o_orderstatus")).alias("outcome"),
            F.to_date("exit_at").alias("exit_at"),
            year.alias("exit_year"), term.alias("exit_term"),
            F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"),
        )
    )
    terms = permanence(F.col("entry_year"), F.col("exit_year"), F.col("exit_term"))
    return rows.withColumn("terms", terms).withColumn("permanence", valid_permanence(F.col("terms")))


def cube(t: Tables, *keys: str) -> DataFrame:
    """Outcome cells per programme, written once: everything after them is small."""
    return pinned(cohorts.outcome_cube(enrolments(t), "course", *keys))


def with_deadlines(cells: DataFrame) -> DataFrame:
    return cells.join(cohorts.deadlines(cells, "course"), "course", "left")


# --- the same in SQL, as CTEs ----------------------------------------------------------------

ENROLMENTS = """
programmes AS (
  SELECT c_custkey AS person, n_name || ' - ' || c_mktsegment AS course, r_name AS campus, c_mktsegment AS area
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), exits AS (
  SELECT l_orderkey, max(l_shipdate) AS exit_at FROM lineitem GROUP BY 1
), dated AS (
  SELECT o_orderkey AS id, person, course, campus, area, CAST(o_orderdate AS DATE) AS entry_at,
         year(o_orderdate) AS entry_year,
         CASE o_orderstatus WHEN 'F' THEN 'FORMATURA' WHEN 'P' THEN 'EVASAO' WHEN 'O' THEN 'ATIVO' END AS outcome,
         CAST(exit_at AS DATE) AS exit_at,
         CASE WHEN month(exit_at) <= 4 THEN year(exit_at) - 1 ELSE year(exit_at) END AS exit_year,
         CASE WHEN month(exit_at) BETWEEN 5 AND 10 THEN 1 ELSE 2 END AS exit_term,
         o_totalprice AS amount, o_orderpriority AS priority
  FROM orders JOIN exits ON o_orderkey = l_orderkey JOIN programmes ON o_custkey = person
), enrolments AS (
  SELECT *, 2 * (exit_year - entry_year) + exit_term AS terms,
         CASE WHEN 2 * (exit_year - entry_year) + exit_term BETWEEN 1 AND 30
              THEN 2 * (exit_year - entry_year) + exit_term END AS permanence
  FROM dated
)"""

CURRICULA = ENROLMENTS + """, curricula AS (
  SELECT course, round_even(quantile_cont(permanence, 0.25) * 10, 0) / 10 AS minimum,
         round_even(quantile_cont(permanence, 0.5) * 10, 0) / 10 AS ideal,
         round_even(quantile_cont(permanence, 0.9) * 10, 0) / 10 AS maximum
  FROM enrolments GROUP BY 1
)"""

# From the definitions: a mature cohort has had time to finish; shares of the deadlines have the graduates of known length below them.
METRICS = CURRICULA + f""", placed AS (
  SELECT e.*, minimum, ideal, maximum FROM enrolments e LEFT JOIN curricula USING (course)
), mature AS (
  SELECT * FROM placed WHERE ideal IS NOT NULL AND entry_year + {MATURITY} <= (SELECT max(entry_year) FROM enrolments)
), fates AS (
  SELECT course, count(*) AS total, histogram(outcome) AS by_outcome, any_value(minimum) AS minimum, any_value(ideal) AS ideal,
         any_value(maximum) AS maximum, coalesce(list(permanence) FILTER (outcome = 'FORMATURA' AND permanence IS NOT NULL), []) AS lengths
  FROM mature GROUP BY course
), reported AS (
  SELECT *, len(lengths) AS finished, coalesce(by_outcome['FORMATURA'], 0) AS graduates, coalesce(by_outcome['EVASAO'], 0) AS dropouts,
         coalesce(by_outcome['ATIVO'], 0) AS actives FROM fates WHERE total >= 5
), metrics AS (
  SELECT course, minimum, ideal, maximum, total, graduates, dropouts, actives,
         round_even(graduates / total * 100 * 100, 0) / 100 AS graduation_pct, round_even(dropouts / total * 100 * 100, 0) / 100 AS dropout_pct,
         coalesce(round_even(len(list_filter(lengths, lambda x: x <= minimum)) / nullif(finished, 0) * 100 * 100, 0) / 100, 0) AS within_minimum_pct,
         coalesce(round_even(len(list_filter(lengths, lambda x: x <= ideal)) / nullif(finished, 0) * 100 * 100, 0) / 100, 0) AS within_ideal_pct,
         coalesce(round_even(len(list_filter(lengths, lambda x: x > ideal)) / nullif(finished, 0) * 100 * 100, 0) / 100, 0) AS above_ideal_pct,
         coalesce(round_even(len(list_filter(lengths, lambda x: x >= maximum)) / nullif(finished, 0) * 100 * 100, 0) / 100, 0) AS at_maximum_pct,
         round_even(list_avg(lengths) * 100, 0) / 100 AS mean_terms, round_even(list_median(lengths) * 100, 0) / 100 AS median_terms,
         round_even(list_avg(list_transform(lengths, lambda x: x - ideal)) * 100, 0) / 100 AS mean_delay
  FROM reported
)"""

# Each factor is cut at its outer twentieths, stretched to 0..1 and weighted; the class counts the quartiles that an index reaches.
RISK = METRICS + """, factors AS (
  SELECT course, unnest(['delay', 'dropout']) AS factor, unnest([0.3::DOUBLE, 0.7::DOUBLE]) AS weight,
         unnest([CASE WHEN mean_delay > 0 THEN mean_delay ELSE 0 END, coalesce(dropout_pct, 0)]) AS raw FROM metrics
), bounds AS (
  SELECT factor, quantile_cont(raw, [0.05, 0.95]) AS edge FROM factors GROUP BY factor
), bounded AS (
  SELECT course, factor, weight, CASE WHEN raw < edge[1] THEN edge[1] WHEN raw > edge[2] THEN edge[2] ELSE raw END AS cut FROM factors JOIN bounds USING (factor)
), span AS (
  SELECT factor, min(cut) AS lowest, max(cut) AS highest FROM bounded GROUP BY factor
), scored AS (
  SELECT course, round_even(sum(weight * ((cut - lowest) / (highest - lowest + 1e-6::DOUBLE))) * 100 * 10, 0) / 10 AS risk_index
  FROM bounded JOIN span USING (factor) GROUP BY course
), quartiles AS (
  SELECT quantile_cont(risk_index, [0.25, 0.5, 0.75]) AS q FROM scored
), retention AS (
  SELECT m.*, risk_index, ['RETENÇÃO BAIXA', 'RETENÇÃO MÉDIA', 'RETENÇÃO ALTA', 'RETENÇÃO CRÍTICA'][1 + len(list_filter(q, lambda x: risk_index >= x))] AS risk_class
  FROM metrics m JOIN scored USING (course), quartiles
)"""


# --- grants: orders as research grants ----------------------------------------------------------

QUOTAS = {
    "1-URGENT": "Escola Públ. - Baixa Renda - PPI", "2-HIGH": "Escola Pública Alta Renda não PPI", "3-MEDIUM": "Negro",
    "4-NOT SPECIFIED": "Universal", "5-LOW": "PCD",
}


def grants(t: Tables) -> DataFrame:
    """Orders as grants, counted per programme, year and raw texts: the texts are classified per cell, not per row."""
    kind = F.when(F.col("o_orderstatus") == "F", "Bolsa remunerada").when(
        F.col("o_orderstatus") == "P", "Iniciação voluntária"
    )
    rows = t.orders.join(programmes(t), F.col("o_custkey") == F.col("person"))
    cells = rows.groupBy(
        "course", "campus", "area", F.year("o_orderdate").alias("year"), kind.alias("kind_text"),
        labels.recode(F.col("o_orderpriority"), QUOTAS).alias("quota_text"),
    ).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("amount"))
    typed = cells.withColumn("kind", labels.grant_kind(F.col("kind_text")))
    return labels.with_social_profile(typed, F.col("quota_text")).drop("kind_text", "quota_text")


GRANTS = """
programmes AS (
  SELECT c_custkey AS person, n_name || ' - ' || c_mktsegment AS course, r_name AS campus, c_mktsegment AS area
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), grants AS (
  SELECT course, campus, area, year(o_orderdate) AS year,
    CASE o_orderstatus WHEN 'F' THEN 'REMUNERADA' WHEN 'P' THEN 'VOLUNTARIA' ELSE 'NAO INFORMADO' END AS kind,
    CASE left(o_orderpriority, 1) WHEN '4' THEN 'AMPLA CONCORRENCIA' WHEN '5' THEN 'OUTRAS COTAS' ELSE 'PPI / ETNICO-RACIAL' END AS profile,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'ESCOLA PUBLICA - PPI' WHEN '2' THEN 'ESCOLA PUBLICA - PPI'
      WHEN '3' THEN 'COTAS RACIAIS (NEGRO/INDIGENA)' WHEN '4' THEN 'AMPLA CONCORRENCIA' ELSE 'COTAS PCD' END AS quota,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'BAIXA RENDA (<= 1.5 SM)' WHEN '2' THEN 'INDEPENDENTE DE RENDA'
      WHEN '4' THEN 'NAO APLICAVEL' ELSE 'NAO ESPECIFICADO' END AS income,
    left(o_orderpriority, 1) <> '4' AS is_quota, CAST(o_totalprice AS DECIMAL(28,2)) AS amount
  FROM orders JOIN programmes ON o_custkey = person
)"""
