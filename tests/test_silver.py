import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortlens.functions.alias_rules import alias_rows
from cohortlens.operators import cohorts, silver


def test_alias_rules_are_a_function():
    rows = alias_rows()
    assert len(rows) == len({r[0] for r in rows})
    assert not {r[0] for r in rows} & {r[1] for r in rows}, "a target is never an alias"


def test_enrolments_to_metrics(spark):
    legacy = spark.createDataFrame(
        [("Graduação", "Violão", "IdA", "2010", "Formatura", "20141", "x"), ("Graduação", "MÚSICA", "NULL", "2010", "Abandono", "20102", "x"),
         ("Mestrado", "Música", "IdA", "2010", "Formatura", "20121", "x"), ("GRADUACAO", "Música", "IdA", "2010", "Outra", "nan", "x")],
        "nivel string, curso string, departamento string, ano_ingresso string, forma_saida string, periodo_saida string, data_registro_livro string")
    current = spark.createDataFrame(
        [("GRADUAÇÃO", "Piano", "IdA", "2,011", "CONCLUÍDO", "20/07/2015", "F"), ("GRADUAÇÃO", "Música", "IdA", "2,020", "ATIVO", None, "?"),
         ("GRADUAÇÃO", "Música", "IdA", "2,011", "CONCLUIDO", "20/07/2205", "M")],
        "nivel string, curso string, unidade string, ano_ingresso string, status_aluno string, data_registro_diploma string, sexo string")
    every = silver.all_enrolments(silver.legacy_enrolments(legacy), silver.current_enrolments(current, F.lit(dt.date(2024, 7, 1))))
    got = sorted((r.fonte, r.curso_norm, r.tipo_saida_grupo, r.ano_saida or 0, r.semestres_permanencia_valida or 0, r.periodo_saida_estimado) for r in every.collect())
    assert got == [
        ("SIGAA", "MUSICA", "ATIVO", 0, 0, False), ("SIGAA", "MUSICA", "FORMATURA", 0, 0, False), ("SIGAA", "PIANO", "FORMATURA", 2015, 9, True),
        ("SIGRA", "MUSICA", "EVASAO", 2010, 2, False), ("SIGRA", "MUSICA", "OUTROS", 0, 0, False), ("SIGRA", "VIOLAO", "FORMATURA", 2014, 9, False)]
    bronze = spark.createDataFrame(
        [("Música", "8", "6", "14", "2000", "160", "2005", "7", 1), ("Musica", "10", "7", "12", "2100", "160", "2015", "9", 2), ("Sem prazo", "NULL", "1", "2", "3", "4", "5", "6", 3)],
        "nome_curso string, semestre_conclusao_ideal string, semestre_conclusao_minimo string, semestre_conclusao_maximo string, "
        "ch_total_minima string, cr_total_minimo string, ano_entrada_vigor string, id_curso string, ordem int")
    curricula = silver.curricula(bronze, "ordem")
    assert [tuple(r) for r in curricula.collect()] == [("MUSICA", 9.0, 6.0, 14.0, 2100.0, 160.0, "9")]
    cells = silver.enrolment_cells(every, curricula)
    one = cohorts.outcome_metrics(cohorts.mature(cells, "entry_year", 8), "curso", k=1).first()
    assert (one.curso, one.total, one.graduates, one.dropouts, one.within_ideal_pct, one.mean_delay) == ("MUSICA", 5, 3, 1, 100.0, 0.0)


def test_active_list(spark):
    bronze = spark.createDataFrame([("Música", "Bacharelado", "2024", "0"), ("Música", "Mestrado", "2024", "1"), ("Música", "", "2024", "1")],
                                   "curso string, grau string, ano_ingresso string, periodo_ingresso string")
    got = silver.active_list(bronze, F.lit("http://x/ativos_2025_1.csv")).collect()
    assert [tuple(r) for r in got] == [("MUSICA", "Bacharelado", "2025/1", 2024, 3)]


def test_catalogue(spark):
    versions = spark.createDataFrame(
        [("1", "2022-01-01", "Teatro", "Noturno", "Gama", "Licenciado", "Outra", "2018-07-18"), ("1", "2023-01-01", "Teatro", "NULL", "Gama", "Licenciatura", "Outra", "18/07/2019"),
         ("2", "2022-01-01", "Dança", "", "X", "Bacharel", "Outra", None)],
        "id_curso string, publicado_em string, nome string, turno string, campus string, grau_academico string, area_conhecimento string, dou string")
    got = {r.id_curso: r for r in silver.catalogue(versions).collect()}
    assert (got[1].turno_norm, got[1].grau_academico_norm, got[1].area_conhecimento_norm) == ("NOTURNO", "LICENCIATURA", "LINGUISTICA, LETRAS E ARTES")
    assert (got[1].dou, got[1].no_catalogo_vigente) == (dt.date(2019, 7, 18), True)
    assert (got[2].turno_norm, got[2].area_conhecimento_norm, got[2].no_catalogo_vigente) == (None, "OUTRA", False)


GRANT = "ano string, tipo_de_bolsa string, linha_pesquisa string, titulo string, unidade string, inicio string, fim string, cota string"


def test_grants(spark):
    rates = spark.createDataFrame([("2012-07", 400.0), ("2023-02", 700.0)], "vigente_desde string, valor_mensal double")
    rows = [("2022", "Bolsa Remunerada", "x", "Um", "FGA GAMA / BACHARELADO EM Engenharia", "01/07/2022", "30/06/2023", "Negro"),
            ("2022", "Voluntária", "x", "Dois", "IE", None, None, None)]
    got = {r.titulo_norm: r for r in silver.grants(spark.createDataFrame(rows, GRANT), rates).collect()}
    one, two = got["UM"], got["DOIS"]
    assert (float(one.valor_bolsa_anual_estimado), one.campus, one.curso_pibic_norm, one.departamento_pibic_norm) == (6300, "FGA - GAMA", "ENGENHARIA", "FGA GAMA")
    assert (one.perfil_social_macro, one.is_cotista, two.is_cotista, float(two.valor_bolsa_anual_estimado)) == ("PPI / ETNICO-RACIAL", True, False, 0)
    with pytest.raises(PySparkException, match="no start or end"):
        silver.grants(spark.createDataFrame([(*rows[0][:5], None, None, "Negro")], GRANT), rates).collect()


def test_census(spark):
    df = spark.createDataFrame([("Física", 2, 80, 10, 4, 50, 20), ("Física", 3, 0, 1, 1, 5, 0)],
                               "NO_CURSO string, CO_IES int, QT_MAT int, QT_SIT_TRANCADA int, QT_SIT_DESVINCULADO int, QT_INSCRITO_TOTAL int, QT_VG_TOTAL int")
    got = [(r.is_home, r.taxa_trancamento_pct, r.taxa_desvinculacao_pct, r.concorrencia_vestibular) for r in silver.census(df, 2).collect()]
    assert got == [(True, 12.5, 5.0, 2.5), (False, None, None, None)]
