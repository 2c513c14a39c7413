"""Cohort outcomes, the risk index and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cohorts, score
from ..session import pinned
from . import domain as D
from .registry import Tables, plan

_METRICS = (
    "string course; double minimum ideal maximum; bigint total graduates dropouts actives; "
    "double graduation_pct dropout_pct within_minimum_pct within_ideal_pct above_ideal_pct at_maximum_pct "
    "mean_terms median_terms mean_delay"
)


def mature_cells(t: Tables, *keys: str) -> DataFrame:
    cells = D.cube(t, *keys)
    placed = D.with_deadlines(cells).filter(F.col("ideal").isNotNull())
    return cohorts.mature(placed, "entry_year", D.MATURITY, universe=cells)


def metrics(t: Tables) -> DataFrame:
    return cohorts.outcome_metrics(mature_cells(t), "course")


def retention(t: Tables) -> DataFrame:
    """Metrics with index and class. Each step is read several times by the next, so it is written: a row per programme."""
    scored = pinned(score.risk_index(pinned(metrics(t))))
    return score.risk_class(scored)


@plan(_METRICS, "D01 D02 D03 D04 B09 B10 C03 C13", f"WITH {D.METRICS} SELECT * FROM metrics")
def cohort_outcomes(t: Tables) -> DataFrame:
    return metrics(t)


@plan("string course; double mean_delay dropout_pct risk_index", "E05 F01 C05",
      f"WITH {D.RISK} SELECT course, mean_delay, dropout_pct, risk_index FROM retention")
def risk_index(t: Tables) -> DataFrame:
    return score.risk_index(pinned(metrics(t)))


@plan("string course risk_class; double risk_index", "F02",
      f"WITH {D.RISK} SELECT course, risk_class, risk_index FROM retention")
def risk_class(t: Tables) -> DataFrame:
    return retention(t)


_TRUNK_SQL = ", ".join(f"'{c}'" for c in D.TRUNK)


@plan("bigint position; string course risk_class; double risk_index dropout_pct mean_delay; bigint total", "E02 F03",
      f"""WITH {D.RISK} SELECT rank() OVER (ORDER BY risk_index DESC) AS position, course, risk_class, risk_index,
      dropout_pct, mean_delay, total FROM retention WHERE course NOT IN ({_TRUNK_SQL})""")
def critical_panel(t: Tables) -> DataFrame:
    return score.critical_panel(pinned(retention(t)), "course", D.TRUNK)
