"""Typed tables from the published text tables of a university, by composition of the operators.

Column names of the inputs are those of the published files. The outputs feed `cohorts`,
`consolidate` and `programme`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as V, labels as L, numbers as N, periods as P, text as X
from ..functions.alias_rules import alias_rows
from ..sources.text import decode_nulls
from . import consolidate, ordering, programme, resolve


def _undergraduate(df: DataFrame) -> DataFrame:
    return df.filter(X.normalize_text(F.col("nivel")) == "GRADUACAO")


def _exit(df: DataFrame, year: Column, term: Column, estimated: Column) -> DataFrame:
    entry = F.col("ano_ingresso")
    terms = P.permanence(entry, F.col("ano_saida"), F.col("semestre_saida"))
    dated = df.withColumns({"ano_saida": year, "semestre_saida": term}).withColumn("periodo_saida_estimado", estimated)
    return dated.withColumn("semestres_permanencia", terms).withColumn(
        "semestres_permanencia_valida", P.valid_permanence(F.col("semestres_permanencia"))
    )


def legacy_enrolments(bronze: DataFrame) -> DataFrame:
    """Closed enrolments: the exit period is published."""
    rows = _undergraduate(decode_nulls(bronze)).withColumns({
        "tipo_saida_grupo": L.exit_reason(F.col("forma_saida")),
        "ano_ingresso": F.col("ano_ingresso").try_cast("int"),
        "curso_norm": X.programme_name(F.col("curso")),
        "departamento_norm": X.normalize_text(F.col("departamento")),
    }).withColumnRenamed("data_registro_livro", "data_registro_diploma")
    year, term = P.parse_period(F.col("periodo_saida"))
    return _exit(rows, year, term, F.lit(False))


def current_enrolments(bronze: DataFrame, published: Column) -> DataFrame:
    """Enrolments with their present status: the exit term of graduates is estimated from the diploma date."""
    rows = _undergraduate(decode_nulls(bronze)).withColumnRenamed("unidade", "departamento").withColumns({
        "ano_ingresso": N.grouped_integer(F.col("ano_ingresso")),
        "sexo": L.only(F.col("sexo"), ("F", "M")),
        "tipo_saida_grupo": L.status_outcome(F.col("status_aluno")),
        "curso_norm": X.programme_name(F.col("curso")),
    }).withColumn("departamento_norm", X.normalize_text(F.col("departamento")))
    diploma = F.when(F.col("tipo_saida_grupo") == V.GRADUATED, P.day_month_year(F.col("data_registro_diploma")))
    year, term = P.exit_term(diploma, published)
    return _exit(rows, year, term, F.col("ano_saida").isNotNull())


def all_enrolments(legacy: DataFrame, current: DataFrame) -> DataFrame:
    return resolve.union_sources({"SIGRA": legacy, "SIGAA": current}, "fonte")


def active_list(bronze: DataFrame, file_name: Column) -> DataFrame:
    """Undergraduates of the newest active list with the terms attended up to the term in the file name."""
    rows = decode_nulls(bronze).filter(F.col("grau").isNotNull() & ~F.col("grau").isin(*V.POSTGRADUATE_DEGREES))
    year, term = P.reference_term(file_name)
    entry, entry_term = F.col("ano_ingresso").try_cast("int"), F.col("periodo_ingresso").try_cast("int")
    return rows.select(
        X.programme_name(F.col("curso")).alias("curso_norm"), "grau",
        F.concat_ws("/", year, term).alias("periodo_referencia"),
        entry.alias("ano_ingresso"), P.terms_attended(entry, entry_term, year, term).alias("semestres_cursados"),
    )


def curricula(bronze: DataFrame, order: str) -> DataFrame:
    """One curriculum per programme: median, shortest and longest deadline, owner of the newest."""
    numbers = {
        c: F.col(c).try_cast("double")
        for c in ("semestre_conclusao_ideal", "semestre_conclusao_minimo", "semestre_conclusao_maximo",
                  "ch_total_minima", "cr_total_minimo", "ano_entrada_vigor")
    }
    rows = decode_nulls(bronze).withColumns({"nome_curso_norm": X.programme_name(F.col("nome_curso")), **numbers})
    return consolidate.consolidate_curricula(
        rows, "nome_curso_norm", "ano_entrada_vigor", "semestre_conclusao_ideal", "semestre_conclusao_minimo",
        "semestre_conclusao_maximo", ["ch_total_minima", "cr_total_minimo"], "id_curso", order,
    )


def catalogue(versions: DataFrame) -> DataFrame:
    """One row per offer from all versions of the catalogue, with normalised names and areas."""
    columns = [c for c in versions.columns if c not in ("id_curso", "publicado_em", "arquivo_origem", "id_servidor")]
    merged = consolidate.latest_non_null(decode_nulls(versions), "id_curso", columns, "publicado_em", "no_catalogo_vigente")
    dates = {c: P.first_date(F.col(c)) for c in ("data_funcionamento", "dou") if c in columns}
    named = merged.withColumns({
        "nome_curso_norm": X.programme_name(F.col("nome")),
        **{f"{c}_norm": X.normalize_text(F.col(c)) for c in ("turno", "campus", "grau_academico", "area_conhecimento")},
        **dates,
    })
    area = L.knowledge_area(F.col("area_conhecimento_norm"), F.col("nome_curso_norm"))
    named = named.withColumns({"area_conhecimento_norm": area, "id_curso": F.col("id_curso").try_cast("int")})
    # Normalised empty text means a missing attribute.
    return named.select(*[
        F.nullif(F.col(c), F.lit("")).alias(c) if c.endswith("_norm") else F.col(c) for c in named.columns
    ])


def census(rows: DataFrame, home: int) -> DataFrame:
    """Census offers with their yearly rates."""
    size = F.col("QT_MAT")
    return rows.withColumns({
        "curso_inep_norm": X.normalize_text(F.col("NO_CURSO")),
        "is_home": F.col("CO_IES") == home,
        "taxa_trancamento_pct": N.percent(F.col("QT_SIT_TRANCADA"), size),
        "taxa_desvinculacao_pct": N.percent(F.col("QT_SIT_DESVINCULADO"), size),
        "concorrencia_vestibular": N.ratio(F.col("QT_INSCRITO_TOTAL"), F.col("QT_VG_TOTAL")),
    })


def grants(bronze: DataFrame, rates: DataFrame) -> DataFrame:
    """Research grants: kind, profile, campus, programme and the sum of the rates in force."""
    rows = decode_nulls(bronze)
    department, course = X.split_unit(X.strip(F.coalesce("unidade", F.lit(""))))
    rows = rows.withColumns({
        "ano": F.col("ano").try_cast("int"),
        "tipo_bolsa_norm": L.grant_kind(F.col("tipo_de_bolsa")),
        "linha_pesquisa_norm": X.normalize_text(F.col("linha_pesquisa")),
        "titulo_norm": X.normalize_text(F.col("titulo")),
        "campus": L.grant_campus(X.normalize_text(F.col("unidade"))),
        "curso_pibic_norm": course,
        "departamento_pibic_norm": department,
        "inicio": P.day_month_year(F.col("inicio")),
        "fim": P.day_month_year(F.col("fim")),
    })
    paid = F.col("tipo_bolsa_norm") == "REMUNERADA"
    undated = paid & (F.col("inicio").isNull() | F.col("fim").isNull())
    checked = rows.withColumn(
        "inicio", F.when(undated, F.raise_error(F.lit("a paid grant has no start or end date")).cast("date")).otherwise(F.col("inicio"))
    )
    valued = programme.rate_in_force(checked, "inicio", "fim", rates, "vigente_desde", "valor_mensal", "_sum")
    amount = F.when(paid, F.col("_sum")).otherwise(F.lit(0).cast("decimal(28,2)"))
    profiled = L.with_social_profile(valued.withColumn("valor_bolsa_anual_estimado", amount).drop("_sum"), F.col("cota"))
    return profiled.withColumnsRenamed(
        {"profile": "perfil_social_macro", "quota": "cota_detalhe", "income": "faixa_renda", "is_quota": "is_cotista"}
    )


def harmonised(df: DataFrame, spark: SparkSession, column: str, name: str = "curso") -> DataFrame:
    """`df` with the curriculum name that the published alias rules give."""
    rules = ordering.literal_table(spark, "origem string, destino string, categoria string, place int", alias_rows())
    return resolve.resolve(df, rules, column, "origem", "destino", name)


def enrolment_cells(enrolments: DataFrame, curricula_df: DataFrame) -> DataFrame:
    """Outcome cells with deadlines, ready for `cohorts.outcome_metrics` and `cohorts.global_totals`."""
    rows = harmonised(enrolments, enrolments.sparkSession, "curso_norm").select(
        "curso", F.col("ano_ingresso").alias("entry_year"), F.col("tipo_saida_grupo").alias("outcome"),
        F.col("semestres_permanencia_valida").alias("permanence"),
    )
    cells = rows.groupBy("curso", "entry_year", "outcome", "permanence").agg(F.count("*").alias("n"))
    deadlines = curricula_df.select(
        F.col("nome_curso_norm").alias("curso"), F.col("semestre_conclusao_minimo").alias("minimum"),
        F.col("semestre_conclusao_ideal").alias("ideal"), F.col("semestre_conclusao_maximo").alias("maximum"),
    )
    return cells.join(deadlines, "curso", "left")
