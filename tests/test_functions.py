import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import labels, numbers, periods, records, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(value):
    return F.lit(value)


@pytest.mark.parametrize("value, expected", [(8.125, 8.12), (8.375, 8.38), (None, None), (2.5, 2.5)])
def test_half_even(spark, value, expected):
    assert one(spark, numbers.half_even(lit(value).cast("double"), 2)) == (expected,)


def test_guarded_ratios(spark):
    zero, part = lit(0), lit(3)
    assert one(spark, numbers.percent(part, zero), numbers.percent(part, zero, empty=0), numbers.ratio(part, zero)) == (None, 0.0, None)
    assert one(spark, numbers.percent(lit(1), lit(3))) == (33.33,)


def test_numbers_in_text(spark):
    assert one(spark, numbers.grouped_integer(lit("2,010")), numbers.grouped_integer(lit("x"))) == (2010, None)
    assert one(spark, numbers.decimal_comma(lit("1.234,56"))) == (1234.56,)


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""), ("  null ", ""), ("-", ""), ("Nan", ""), ("  Ciência   da\tComputação ", "CIENCIA DA COMPUTACAO"),
        ("ELETRÔNICA  1", "ELETRONICA 1"), ("étude", "ETUDE"),
    ],
)
def test_normalize_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.normalize_text(F.col("s"))).first()[0] == expected


def test_empty_words_count_whatever_surrounds_them(spark):
    raw = ["NULL" + " " * 40, " " * 60 + "none\t", "\u3000-\u00a0", "NULL E VOID" + " " * 40, "x" * 50]
    df = spark.createDataFrame([(r,) for r in raw], "s string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("s"))).collect()] == ["", "", "", "NULL E VOID", "X" * 50]


def test_folding_follows_nfkd_for_every_letter(spark):
    def plain(word):
        return "".join(x for x in unicodedata.normalize("NFKD", word) if not unicodedata.combining(x))

    letters = [c for c in map(chr, range(1, 0x110000)) if unicodedata.decomposition(c) or "\uac00" <= c <= "\ud7a3" or unicodedata.combining(c) or c < "\u0500"]
    words = ["".join(letters[i:i + 50]) for i in range(0, len(letters), 50)] + ["Ａｂ１", "한국어 Ação ½ ﬁm…", "plain", ""]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    for word, folded in df.select("c", text.fold_accents(F.col("c"))).collect():
        assert folded == plain(word)


def test_programme_prefix(spark):
    names = [lit("COMUNICAÇÃO SOCIAL - JORNALISMO"), lit("CIÊNCIAS SOCIAIS")]
    assert one(spark, *[text.programme_name(n) for n in names]) == ("JORNALISMO", "CIENCIAS SOCIAIS")


def test_unit_is_split_and_an_accented_prefix_survives(spark):
    units = ["IE / Bacharelado em Estatística - ALUNO: 123 - FORMANDO", "FT / Graduação em Direito", "Reitoria"]
    got = [one(spark, *text.split_unit(lit(u))) for u in units]
    assert got == [("IE", "ESTATISTICA"), ("FT", "GRADUACAO EM DIREITO"), ("REITORIA", "")]


@pytest.mark.parametrize(
    "day, expected",
    [("15/02/2023", (2022, 2)), ("20/07/2023", (2023, 1)), ("10/12/2023", (2023, 2)), (None, (None, None)), ("10/12/2202", (None, None))],
)
def test_exit_term(spark, day, expected):
    date = periods.day_month_year(lit(day).cast("string"))
    assert one(spark, *periods.exit_term(date, lit(dt.date(2024, 7, 1)))) == expected


def test_periods(spark):
    assert one(spark, *periods.parse_period(lit("20141"))) == (2014, 1)
    assert one(spark, *periods.parse_period(lit("2014"))) == (None, None)
    assert [one(spark, periods.window_start(lit(y)))[0] for y in (2000, 2004, 2005, 2023)] == [2000, 2000, 2005, 2020]
    assert one(spark, periods.period_label(lit(20232))) == ("2023/2",)
    ends = [one(spark, periods.period_end(lit(p)))[0] for p in (20240, 20230, 20231, 20232)]
    assert ends == [dt.date(2024, 2, 29), dt.date(2023, 2, 28), dt.date(2023, 7, 31), dt.date(2023, 12, 31)]


def _watermark(day, months=4):
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    month += 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    limit = dt.date(year, month, min(day.day, last))
    ends = {}
    for y in range(day.year - 3, day.year + 1):
        ends[y * 10] = dt.date(y, 3, 1) - dt.timedelta(days=1)
        ends[y * 10 + 1] = dt.date(y, 7, 31)
        ends[y * 10 + 2] = dt.date(y, 12, 31)
    return max(p for p, end in ends.items() if end <= limit)


def test_watermark_on_every_day_of_three_years(spark):
    first = dt.date(2023, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(1100)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", periods.watermark(F.col("d")))
    assert all(mark == _watermark(day) for day, mark in df.collect())


def test_permanence_and_terms_attended(spark):
    assert one(spark, periods.permanence(lit(2010), lit(2014), lit(1))) == (9,)
    values = [periods.valid_permanence(lit(n)) for n in (0, 1, 30, 31)]
    assert one(spark, *values) == (None, 1, 30, None)
    attended = [periods.terms_attended(lit(y), lit(s), lit(2025), lit(1)) for y, s in ((2025, 0), (2024, 2), (2026, 1))]
    assert one(spark, *attended) == (1, 2, 1)
    assert one(spark, *periods.reference_term(lit("ativos_2025_2.csv"))) == (2025, 2)
    assert one(spark, *periods.reference_term(lit("ativos.csv"))) == (None, None)


def test_classifiers(spark):
    reasons = ["Formatura", "Mudança de habilitação", "Vestibular p/ outro curso", "Falecimento", None]
    assert one(spark, *[labels.exit_reason(lit(r).cast("string")) for r in reasons]) == (
        "FORMATURA", "EVASAO", "EVASAO", "OUTROS", "OUTROS")
    status = ["CONCLUÍDO", "ativo - formando", "TRANCADO", "CANCELADO", "x"]
    assert one(spark, *[labels.status_outcome(lit(s)) for s in status]) == ("FORMATURA", "ATIVO", "ATIVO", "EVASAO", "OUTROS")
    assert one(spark, *[labels.shift_group(lit(s)) for s in ("NOTURNO", "INTEGRAL", "MATUTINO")]) == ("NOTURNO", "INTEGRAL", "DIURNO")
    assert one(spark, labels.degree_category(lit(None).cast("string")), labels.degree_category(lit("LICENCIADO"))) == (
        "BACHARELADO", "LICENCIATURA")
    assert one(spark, labels.knowledge_area(lit("OUTRA"), lit("MUSICA")), labels.knowledge_area(lit("OUTRA"), lit("X"))) == (
        "LINGUISTICA, LETRAS E ARTES", "OUTRA")


def test_social_profile(spark):
    texts = ["", "Escola Pública - Baixa Renda - PPI", "Escola Pública Alta Renda", "Negro", "PcD", "Refugiado"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [tuple(r)[2:] for r in labels.with_social_profile(df, F.col("s")).orderBy("i").collect()]
    assert got == [
        ("AMPLA CONCORRENCIA", "AMPLA CONCORRENCIA", "NAO APLICAVEL", False),
        ("PPI / ETNICO-RACIAL", "ESCOLA PUBLICA - PPI", "BAIXA RENDA (<= 1.5 SM)", True),
        ("ESCOLA PUBLICA", "ESCOLA PUBLICA - NAO PPI", "INDEPENDENTE DE RENDA", True),
        ("PPI / ETNICO-RACIAL", "COTAS RACIAIS (NEGRO/INDIGENA)", "NAO ESPECIFICADO", True),
        ("OUTRAS COTAS", "COTAS PCD", "NAO ESPECIFICADO", True),
        ("OUTRAS COTAS", "OUTRAS ACOES AFIRMATIVAS", "NAO ESPECIFICADO", True),
    ]


def test_bands(spark):
    got = one(spark, *[labels.dropout_band(lit(v).cast("double")) for v in (60.0, 45.0, 29.9, None)])
    assert got == ("evasão muito alta", "evasão alta", "evasão baixa", "evasão sem dado")
    assert one(spark, labels.delay_band(lit(0.5)), labels.delay_band(lit(-1.0))) == ("formatura com algum atraso", "formatura no prazo")


def test_row_digest_tells_null_from_empty(spark):
    df = spark.createDataFrame([("", None), (None, "")], "a string, b string")
    assert df.select(records.row_digest(df).alias("h")).distinct().count() == 2
