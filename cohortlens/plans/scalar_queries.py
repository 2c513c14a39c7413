"""Scalar functions applied to whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L, numbers as N, periods as P, records as R, text as X

from . import domain as D
from .registry import Tables, plan

_FOLD = "regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')"
_UP = "upper(replace({0}, 'ß', 'SS'))"


@plan("bigint doc_id n_chars; string digest", "B01 B03",
      f"""SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
        SELECT doc_id, CASE WHEN upper(b) IN ('NULL', 'NONE', 'NAN', '-', '') THEN ''
          ELSE {_UP.format(_FOLD.format('b'))} END AS t
        FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents))""")
def normalize_text(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", X.normalize_text(F.col("text")).alias("clean"))
    return rows.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("digest"))


@plan("string course name; bigint customers", "B02",
      f"""WITH {D.ENROLMENTS} SELECT course, regexp_replace(course, '^(NATION_1|NATION_2) - ', '') AS name, count(*) AS customers
      FROM programmes GROUP BY ALL""")
def strip_prefix(t: Tables) -> DataFrame:
    name = X.strip_prefix(X.normalize_text(F.col("course")), ("NATION_1", "NATION_2"))
    return D.programmes(t).groupBy("course", name.alias("name")).agg(F.count("*").alias("customers"))


@plan("string reason outcome kind; bigint rows", "B04 B19",
      """SELECT reason, CASE WHEN reason LIKE 'Formatura%' THEN 'FORMATURA' WHEN reason LIKE 'Abandono%'
        OR reason LIKE 'Mudança de%' THEN 'EVASAO' ELSE 'OUTROS' END AS outcome,
        CASE WHEN reason LIKE '%remunerada%' THEN 'REMUNERADA' WHEN reason LIKE '%voluntária%' THEN 'VOLUNTARIA'
             ELSE 'NAO INFORMADO' END AS kind, count(*) AS rows
      FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'Formatura' WHEN o_orderstatus = 'O' THEN 'Em curso'
            WHEN o_totalprice < 100000 THEN 'Abandono' ELSE 'Mudança de curso' END ||
            CASE WHEN o_totalprice < 200000 THEN ' (bolsa remunerada)' WHEN o_totalprice < 300000
            THEN ' (bolsa voluntária)' ELSE '' END AS reason FROM orders) GROUP BY ALL""")
def keyword_class(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    reason = F.concat(
        F.when(F.col("o_orderstatus") == "F", "Formatura").when(F.col("o_orderstatus") == "O", "Em curso")
        .when(price < 100000, "Abandono").otherwise("Mudança de curso"),
        F.when(price < 200000, " (bolsa remunerada)").when(price < 300000, " (bolsa voluntária)").otherwise(""),
    )
    rows = t.orders.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    return rows.select(
        "reason", L.exit_reason(F.col("reason")).alias("outcome"), L.grant_kind(F.col("reason")).alias("kind"), "rows"
    )


@plan("string event_type outcome kept area; bigint rows", "B05 B13 B18",
      """SELECT event_type, CASE event_type WHEN 'view' THEN 'FORMATURA' WHEN 'click' THEN 'EVASAO'
          WHEN 'signup' THEN 'ATIVO' ELSE 'OUTROS' END AS outcome,
          CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kept,
          CASE event_type WHEN 'view' THEN 'CIENCIAS DA SAUDE' WHEN 'click' THEN 'OUTRA' ELSE 'ENGENHARIAS' END AS area,
          count(*) AS rows FROM events GROUP BY ALL""")
def recode_map(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = L.recode(kind, {"view": "Concluído", "click": " cancelado ", "signup": "ativo - formando"}, kind)
    programme = L.recode(kind, {"view": "EDUCACAO FISICA", "click": "DANCA"}, "X")
    area = F.when(kind.isin("view", "click"), "OUTRA").otherwise("ENGENHARIAS")
    return t.events.groupBy(kind).agg(F.count("*").alias("rows")).select(
        "event_type",
        L.status_outcome(status).alias("outcome"),
        L.only(kind, ("view", "click")).alias("kept"),
        L.knowledge_area(area, programme).alias("area"),
        "rows",
    )


@plan("string name shift degree campus grant_campus; bigint parts", "B06 B07 B08 B21",
      """SELECT name, CASE WHEN name LIKE '%NOTURNO%' THEN 'NOTURNO' WHEN name LIKE '%INTEGRAL%' THEN 'INTEGRAL'
          ELSE 'DIURNO' END AS shift, CASE WHEN name LIKE '%LICENCI%' THEN 'LICENCIATURA' ELSE 'BACHARELADO' END AS degree,
          CASE WHEN name LIKE '%GAMA%' THEN 'FACULDADE DE CIENCIAS E TECNOLOGIAS EM ENGENHARIA (FCTE)' ELSE 'DARCY RIBEIRO' END
          AS campus, CASE WHEN name LIKE '%GAMA%' THEN 'FGA - GAMA' ELSE 'DARCY RIBEIRO' END AS grant_campus, count(*) AS parts
      FROM (SELECT p_type || CASE WHEN p_size < 10 THEN ' NOTURNO' WHEN p_size < 20 THEN ' INTEGRAL' ELSE ' MATUTINO' END ||
            CASE WHEN p_size % 2 = 0 THEN ' LICENCIADO' ELSE '' END || CASE WHEN p_brand = 'Brand#2' THEN ' GAMA' ELSE '' END
            AS name FROM part) GROUP BY ALL""")
def group_labels(t: Tables) -> DataFrame:
    size = F.col("p_size")
    name = F.concat(
        F.col("p_type"),
        F.when(size < 10, " NOTURNO").when(size < 20, " INTEGRAL").otherwise(" MATUTINO"),
        F.when(size % 2 == 0, " LICENCIADO").otherwise(""),
        F.when(F.col("p_brand") == "Brand#2", " GAMA").otherwise(""),
    )
    rows = t.part.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("parts"))
    text = F.col("name")
    return rows.select(
        "name", L.shift_group(text).alias("shift"), L.degree_category(text).alias("degree"),
        L.campus_name(text).alias("campus"), L.grant_campus(text).alias("grant_campus"), "parts",
    )


@plan("bigint suppkey lines; double returned_pct open_ratio guarded_pct", "B10 B23",
      """SELECT l_suppkey AS suppkey, count(*) AS lines,
          round_even(count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_linestatus = 'O'), 0) * 100 * 100, 0) / 100 AS returned_pct,
          round_even(count(*) FILTER (l_linestatus = 'O') / nullif(count(*) FILTER (l_quantity > 49), 0) * 100, 0) / 100 AS open_ratio,
          coalesce(round_even(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_quantity > 49), 0) * 100 * 10, 0) / 10, 0) AS guarded_pct
      FROM lineitem GROUP BY 1""")
def safe_rates(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
        F.count_if(F.col("l_linestatus") == "O").alias("opened"),
        F.count_if(F.col("l_quantity") > 49).alias("large"),
    )
    return counts.select(
        "suppkey", "lines",
        N.percent(F.col("returned"), F.col("opened")).alias("returned_pct"),
        N.ratio(F.col("opened"), F.col("large")).alias("open_ratio"),
        N.percent(F.col("accepted"), F.col("large"), 1, empty=0).alias("guarded_pct"),
    )


@plan("string period; bigint year term amount rows", "B11 B12",
      """SELECT period, CASE WHEN regexp_matches(period, '^[0-9]{5}$') THEN TRY_CAST(period[1:4] AS INT) END AS year,
          CASE WHEN regexp_matches(period, '^[0-9]{5}$') THEN TRY_CAST(period[5:5] AS INT) END AS term,
          TRY_CAST(replace(grouped, ',', '') AS INT) AS amount, count(*) AS rows
      FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'NULL' WHEN month(o_orderdate) = 1 THEN year(o_orderdate)::VARCHAR
              ELSE year(o_orderdate)::VARCHAR || CASE WHEN month(o_orderdate) < 7 THEN '1' ELSE '2' END END AS period,
              substr(year(o_orderdate)::VARCHAR, 1, 1) || ',' || substr(year(o_orderdate)::VARCHAR, 2, 3) AS grouped
            FROM orders) GROUP BY ALL""")
def parse_period(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    year = F.year(day).cast("string")
    period = (
        F.when(F.col("o_orderstatus") == "O", "NULL").when(F.month(day) == 1, year)
        .otherwise(F.concat(year, F.when(F.month(day) < 7, "1").otherwise("2")))
    )
    grouped = F.concat(F.substring(year, 1, 1), F.lit(","), F.substring(year, 2, 3))
    rows = t.orders.groupBy(period.alias("period"), grouped.alias("grouped")).agg(F.count("*").alias("rows"))
    y, s = P.parse_period(F.col("period"))
    return rows.select("period", y.alias("year"), s.alias("term"), N.grouped_integer(F.col("grouped")).alias("amount"), "rows")


@plan("bigint exit_year exit_term rows", "B14",
      """SELECT CASE WHEN d <= DATE '2001-06-30' THEN CASE WHEN month(d) <= 4 THEN year(d) - 1 ELSE year(d) END END AS exit_year,
          CASE WHEN d <= DATE '2001-06-30' THEN CASE WHEN month(d) BETWEEN 5 AND 10 THEN 1 ELSE 2 END END AS exit_term,
          count(*) AS rows FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY ALL""")
def exit_term(t: Tables) -> DataFrame:
    text = F.date_format("l_shipdate", "dd/MM/yyyy")
    days = t.lineitem.groupBy(text.alias("day")).agg(F.count("*").alias("n"))
    year, term = P.exit_term(P.day_month_year(F.col("day")), F.lit("2001-06-30").cast("date"))
    return days.groupBy(year.alias("exit_year"), term.alias("exit_term")).agg(F.sum("n").alias("rows"))


@plan("bigint entry_year terms permanence attended rows", "B15 B16",
      f"""WITH {D.ENROLMENTS} SELECT entry_year, terms, permanence,
          greatest((2001 - entry_year) * 2 + (1 - CASE WHEN month(entry_at) < 7 THEN 1 ELSE 2 END) + 1, 1) AS attended,
          count(*) AS rows FROM enrolments GROUP BY ALL""")
def permanence(t: Tables) -> DataFrame:
    year, term = P.reference_term(F.lit("alunos_ativos_2001_1.csv"))
    entry_term = F.when(F.month("entry_at") < 7, 0).otherwise(2)
    rows = D.enrolments(t).select(
        "entry_year", "terms", "permanence", P.terms_attended(F.col("entry_year"), entry_term, year, term).alias("attended")
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))


@plan("string day; bigint rows", "B17",
      """SELECT CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, count(*) AS rows
      FROM orders GROUP BY 1""")
def multi_format_date(t: Tables) -> DataFrame:
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.date_format(day, "yyyy-MM-dd")).when(status == "P", F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "MMMM"))
    )
    return t.orders.groupBy(P.first_date(text).cast("string").alias("day")).agg(F.count("*").alias("rows"))


@plan("string priority profile quota income; boolean is_quota; bigint rows", "B20",
      """SELECT o_orderpriority AS priority,
          CASE left(o_orderpriority, 1) WHEN '4' THEN 'AMPLA CONCORRENCIA' WHEN '5' THEN 'OUTRAS COTAS' ELSE 'PPI / ETNICO-RACIAL' END AS profile,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'ESCOLA PUBLICA - PPI' WHEN '2' THEN 'ESCOLA PUBLICA - PPI'
            WHEN '3' THEN 'COTAS RACIAIS (NEGRO/INDIGENA)' WHEN '4' THEN 'AMPLA CONCORRENCIA' ELSE 'COTAS PCD' END AS quota,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'BAIXA RENDA (<= 1.5 SM)' WHEN '2' THEN 'INDEPENDENTE DE RENDA'
            WHEN '4' THEN 'NAO APLICAVEL' ELSE 'NAO ESPECIFICADO' END AS income,
          left(o_orderpriority, 1) <> '4' AS is_quota, count(*) AS rows FROM orders GROUP BY ALL""")
def profile_struct(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("rows"))
    return L.with_social_profile(rows, L.recode(F.col("priority"), D.QUOTAS))


@plan("string unit department programme; bigint customers", "B22",
      f"""WITH {D.ENROLMENTS} SELECT campus || ' / Curso ' || course || ' - ALUNO: 12345 - FORMANDO' AS unit,
          campus AS department, course AS programme, count(*) AS customers FROM programmes GROUP BY ALL""")
def split_composite(t: Tables) -> DataFrame:
    unit = F.concat(F.col("campus"), F.lit(" / Curso "), F.col("course"), F.lit(" - ALUNO: 12345 - FORMANDO"))
    rows = D.programmes(t).groupBy(unit.alias("unit")).agg(F.count("*").alias("customers"))
    department, programme = X.split_unit(F.col("unit"))
    return rows.select("unit", department.alias("department"), programme.alias("programme"), "customers")


@plan("bigint window orders; double amount", "B24 I20",
      """SELECT year(o_orderdate) - year(o_orderdate) % 5 AS window, count(*) AS orders,
          sum(CAST(o_totalprice AS DECIMAL(28,2))) AS amount FROM orders GROUP BY 1""")
def bucket5(t: Tables) -> DataFrame:
    window = P.window_start(F.year("o_orderdate"))
    return t.orders.groupBy(window.alias("window")).agg(F.count("*").alias("orders"), N.exact_sum(F.col("o_totalprice")).alias("amount"))


@plan("bigint period watermark rows; string label ends", "B25 B26",
      """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1
      ), periods AS (
        SELECT y * 10 + s AS period, CASE s WHEN 0 THEN make_date(y, 3, 1) - 1 WHEN 1 THEN make_date(y, 7, 31)
               ELSE make_date(y, 12, 31) END AS ends
        FROM range(1992, 2003) AS a(y) CROSS JOIN range(0, 3) AS b(s)
      ), marked AS (
        SELECT d, n, (SELECT max(period) FROM periods WHERE ends <= CAST(d - INTERVAL 4 MONTH AS DATE)) AS watermark,
               year(d) * 10 + CASE WHEN month(d) <= 2 THEN 0 WHEN month(d) <= 7 THEN 1 ELSE 2 END AS period FROM days
      ) SELECT period, watermark, sum(n) AS rows, (period // 10) || '/' || (period % 10) AS label,
               strftime(ends, '%Y-%m-%d') AS ends
        FROM marked JOIN periods USING (period) GROUP BY ALL""")
def period_calendar(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    term = F.when(F.month(day) <= 2, 0).when(F.month(day) <= 7, 1).otherwise(2)
    rows = t.orders.groupBy((F.year(day) * 10 + term).alias("period"), P.watermark(day).alias("watermark")).agg(
        F.count("*").alias("rows")
    )
    period = F.col("period")
    return rows.select(
        "period", "watermark", "rows", P.period_label(period).alias("label"), P.period_end(period).cast("string").alias("ends")
    )


@plan("string course sentence sign", "B27 B28 B33",
      f"""WITH {D.RISK} SELECT course, 'curso de ' || lower(course) || '. ' ||
          CASE WHEN dropout_pct >= 60 THEN 'evasão muito alta' WHEN dropout_pct >= 45 THEN 'evasão alta'
               WHEN dropout_pct >= 30 THEN 'evasão moderada' ELSE 'evasão baixa' END || ', ' ||
          CASE WHEN mean_delay IS NULL THEN 'tempo de formatura sem dado' WHEN mean_delay >= 2 THEN 'formatura com muito atraso'
               WHEN mean_delay >= 0.5 THEN 'formatura com algum atraso' ELSE 'formatura no prazo' END || '. ' || total || ' vínculos.' AS sentence,
          CASE WHEN mean_delay > 0 THEN 'Acima' ELSE 'Abaixo' END AS sign FROM retention""")
def banded_text(t: Tables) -> DataFrame:
    from .cohort_queries import metrics

    sentence = F.format_string(
        "curso de %s. %s, %s. %d vínculos.",
        F.lower("course"), L.dropout_band(F.col("dropout_pct")), L.delay_band(F.col("mean_delay")), F.col("total"),
    )
    return metrics(t).select("course", sentence.alias("sentence"), L.sign_label(F.col("mean_delay")).alias("sign"))


@plan("bigint key; string natural version sha1 content", "B29",
      """SELECT o_orderkey AS key, md5(o_orderstatus || '|' || o_orderpriority) AS natural,
          md5(o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000000')) AS version,
          sha1(o_orderkey || '|' || o_custkey) AS sha1, sha256('m1' || chr(10) || o_orderpriority) AS content FROM orders""")
def hash_keys(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("key"),
        R.natural_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("natural"),
        R.version_key(F.col("o_orderpriority"), F.col("o_orderdate")).alias("version"),
        R.sha1_key(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("sha1"),
        R.content_hash("m1", F.col("o_orderpriority")).alias("content"),
    )


@plan("bigint orderkey quantity; string flag", "B30",
      """SELECT l_orderkey AS orderkey, l_quantity AS quantity, l_returnflag AS flag FROM lineitem
      WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 45 AND l_shipdate >= TIMESTAMP '2000-01-01'""")
def filter_scan(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(
        F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") >= 45)
        & (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    )
    return rows.select(F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))


@plan("string name content; bigint k_sum", "B31 B32 A21",
      """WITH c AS (SELECT event_type, count(*) AS n, sum(CAST(props ->> '$.k' AS BIGINT)) AS k FROM events GROUP BY 1)
      SELECT 'events' AS name, '{"total":' || sum(n) || ',"by_type":[' ||
          string_agg('{"type":"' || event_type || '","n":' || n || '}', ',' ORDER BY event_type) || '],"missing":null,"map":{' ||
          string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS content, sum(k) AS k_sum FROM c""")
def json_report(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
    record = F.struct(F.col("event_type").alias("type"), "n")
    entries = F.array_sort(F.collect_list(record))
    # One entry per event type: the arrays hold a handful of records.
    return counts.agg(F.sum("n").alias("total"), entries.alias("by_type"), F.sum("k").alias("k_sum")).select(
        F.lit("events").alias("name"),
        R.json_record(
            F.col("total"),
            F.col("by_type"),
            N.no_nan(F.lit(float("nan"))).alias("missing"),
            F.map_from_entries("by_type").alias("map"),
        ).alias("content"),
        "k_sum",
    )


