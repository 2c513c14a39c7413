"""Dimensions with history, facts, the wide view, 3NF and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.labels import recode
from ..functions.records import natural_key
from ..operators import cohorts, consolidate, dimensional, normalise, quality, resolve, score, sync
from ..session import pinned
from . import domain as D
from .aggregate_queries import _OFFERS, offers
from .cohort_queries import metrics
from .join_queries import _NAMED, named, published_rules
from .registry import Tables, plan


@plan("string campus region sk", "H01",
      """WITH c AS (SELECT DISTINCT r_name AS campus FROM region UNION SELECT 'MULTICAMPUS' UNION SELECT 'DARCY RIBEIRO')
      SELECT campus, CASE campus WHEN 'DARCY RIBEIRO' THEN 'Plano Piloto' WHEN 'EUROPE' THEN 'kept' ELSE 'Distrito Federal' END AS region, md5(campus) AS sk
      FROM (SELECT campus FROM c UNION SELECT 'EUROPE')""")
def dim_upsert(t: Tables) -> DataFrame:
    names = t.region.select(F.col("r_name").alias("campus"))
    # The stored dimension has a region the load no longer brings, and a stale attribute.
    current = names.filter("campus IN ('EUROPE', 'ASIA')").withColumn("region", F.lit("kept"))
    extra = t.spark.sql("SELECT * FROM VALUES ('MULTICAMPUS'), ('DARCY RIBEIRO') AS x(campus)")
    incoming = names.filter("campus <> 'EUROPE'").union(extra).distinct().withColumn(
        "region", recode(F.col("campus"), V.CAMPUS_REGIONS, V.OTHER_REGION)
    )
    return dimensional.upsert_dimension(current, incoming, ["campus"], ["region"], "sk")


@plan("string name degree category area; bigint owner; boolean current", "H02",
      f"""WITH {_OFFERS}, cur AS (SELECT p_name || ' ' || p_brand AS name, max(p_partkey) AS owner FROM part WHERE p_size > 5 GROUP BY 1
      ), main AS (SELECT * FROM offers WHERE size <> 7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY current DESC, id) = 1
      ), mixed AS (SELECT name FROM offers WHERE size <> 7 GROUP BY 1 HAVING count(DISTINCT degree) > 1)
      SELECT c.name, owner, CASE WHEN x.name IS NOT NULL THEN 'MISTO (BACHARELADO + LICENCIATURA)' ELSE coalesce(m.degree, d.degree) END AS degree,
        CASE WHEN x.name IS NOT NULL THEN 'MISTO' WHEN coalesce(m.degree, d.degree) = 'LICENCIADO' THEN 'LICENCIATURA' ELSE 'BACHARELADO' END AS category,
        coalesce(m.area, d.area) AS area, coalesce(m.current, d.current) AS current
      FROM cur c JOIN offers d ON d.id = c.owner LEFT JOIN main m ON m.name = c.name LEFT JOIN mixed x ON x.name = c.name""")
def canonical_attributes(t: Tables) -> DataFrame:
    rows = offers(t)
    curricula = t.part.filter("p_size > 5").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(
        F.max("p_partkey").alias("owner")
    )
    # Some offers are known by id only, so their names fall back to the owner of the curriculum.
    named = rows.withColumn("name", F.when(F.col("size") != 7, F.col("name")))
    return consolidate.canonical_attributes(
        curricula, named, "name", "id", "current", "owner", "degree", ["area", "current"]
    )


def _loads(t: Tables) -> DataFrame:
    """Attributes of every customer with orders in a year, one load per year."""
    return t.orders.groupBy(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("y")).agg(
        F.max("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("status"), F.max("o_orderkey").alias("pointer")
    ).withColumn("load_time", F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


_LOADS = """loads AS (SELECT o_custkey AS person, year(o_orderdate) AS y, max(o_orderpriority) AS priority, min(o_orderstatus) AS status,
   max(o_orderkey) AS pointer FROM orders GROUP BY ALL
), marked AS (SELECT *, lag(priority) OVER w AS p0, lag(status) OVER w AS s0, row_number() OVER w AS rn FROM loads WINDOW w AS (PARTITION BY person ORDER BY y)
), starts AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY y) AS n FROM marked WHERE rn = 1 OR priority <> p0 OR status <> s0
), history AS (SELECT person, priority, status, CASE WHEN n = 1 THEN TIMESTAMP '1962-04-21' ELSE make_timestamp(y, 1, 1, 0, 0, 0.0) END AS valid_from,
   lead(make_timestamp(y, 1, 1, 0, 0, 0.0)) OVER (PARTITION BY person ORDER BY y) AS valid_to FROM starts)"""


def history(t: Tables) -> DataFrame:
    return dimensional.scd2_from_loads(_loads(t), "person", "load_time", ["priority", "status"], ["pointer"])


@plan("string version_key priority status valid_from valid_to; bigint person pointer; boolean is_current", "H06 B29 E04",
      f"""WITH {_LOADS} SELECT md5(person || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S.000000')) AS version_key, person, priority, status,
        strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, valid_to IS NULL AS is_current,
        pointer
      FROM history h JOIN (SELECT person, arg_max(pointer, y) AS pointer FROM loads GROUP BY 1) USING (person)""")
def scd2_history(t: Tables) -> DataFrame:
    rows = history(t).withColumn("person", F.col("person").cast("string"))
    return rows.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd")).withColumn(
        "valid_to", F.date_format("valid_to", "yyyy-MM-dd")
    )


@plan("string priority valid_from valid_to; bigint person pointer; boolean is_current", "H03 H04 H05",
      """WITH a AS (SELECT o_custkey AS person, max(o_orderpriority) AS priority, max(o_orderkey) AS pointer FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY 1
      ), b AS (SELECT o_custkey AS person, max(o_orderpriority) AS priority, max(o_orderkey) AS pointer FROM orders WHERE year(o_orderdate) > 1997 GROUP BY 1)
      SELECT a.priority, '1962-04-21' AS valid_from, CASE WHEN b.priority <> a.priority THEN '1998-01-01' END AS valid_to, a.person,
        CASE WHEN b.person IS NULL OR b.priority <> a.priority THEN a.pointer ELSE b.pointer END AS pointer,
        coalesce(b.priority = a.priority, true) AS is_current FROM a LEFT JOIN b USING (person)
      UNION ALL SELECT b.priority, CASE WHEN a.person IS NULL THEN '1962-04-21' ELSE '1998-01-01' END, NULL, b.person, b.pointer, true
        FROM b LEFT JOIN a USING (person) WHERE a.person IS NULL OR a.priority <> b.priority""")
def scd2_load(t: Tables) -> DataFrame:
    """Two loads, each merged into the stored dimension; the state in between is written."""
    def load(years) -> DataFrame:
        return t.orders.filter(years).groupBy(F.col("o_custkey").alias("person")).agg(
            F.max("o_orderpriority").alias("priority"), F.max("o_orderkey").alias("pointer")
        )

    empty = t.spark.createDataFrame(
        [], "person bigint, priority string, pointer bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    )
    year = F.year("o_orderdate")
    first = pinned(dimensional.scd2_merge(
        empty, load(year <= 1997), "person", ["priority"], ["pointer"], F.lit("1995-01-01").cast("timestamp_ntz")
    ))
    second = dimensional.scd2_merge(
        first, load(year > 1997), "person", ["priority"], ["pointer"], F.lit("1998-01-01").cast("timestamp_ntz")
    )
    return second.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd")).withColumn(
        "valid_to", F.date_format("valid_to", "yyyy-MM-dd")
    )


@plan("string version_key; bigint orders; double amount", "H07",
      f"""WITH {_LOADS}, f AS (SELECT o_custkey AS person, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(28,2))) AS amount FROM orders GROUP BY 1)
      SELECT md5(person || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S.000000')) AS version_key, orders, amount
      FROM f JOIN history USING (person) WHERE valid_to IS NULL""")
def fact_current(t: Tables) -> DataFrame:
    measures = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(
        F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("amount")
    )
    return dimensional.current_fact(measures, history(t), "person", "version_key")


@plan("string course; bigint total actives_now above_ideal_now; double risk_index above_ideal_pct_now", "H08",
      f"""WITH {D.RISK}, a AS (SELECT course, count(*) AS n, count(*) FILTER (permanence > ideal) AS late FROM placed
        WHERE outcome = 'ATIVO' GROUP BY 1 HAVING count(*) >= 5)
      SELECT course, total, risk_index, coalesce(n, 0) AS actives_now, coalesce(late, 0) AS above_ideal_now,
        coalesce(round_even(late / n * 100 * 100, 0) / 100, 0) AS above_ideal_pct_now
      FROM retention LEFT JOIN a USING (course) WHERE course NOT IN ({", ".join(f"'{c}'" for c in D.TRUNK)})""")
def executive_view(t: Tables) -> DataFrame:
    cells = pinned(D.cube(t))
    placed = D.with_deadlines(cells).filter(F.col("ideal").isNotNull())
    table = score.risk_index(cohorts.outcome_metrics(cohorts.mature(placed, "entry_year", D.MATURITY, cells), "course"))
    late = cells.filter(F.col("outcome") == "ATIVO")
    actives = cohorts.active_snapshot(
        late.withColumn("terms", F.col("permanence")), cohorts.deadlines(cells, "course"), "course", ()
    ).withColumn("sk", natural_key(F.col("course")))
    dimension = cells.select("course").distinct().select(
        natural_key(F.col("course")).alias("sk"), "course", F.lit(True).alias("is_current"),
        F.col("course").isin(*D.TRUNK).alias("trunk"),
    )
    fact = dimensional.current_fact(table, dimension, "course", "sk")
    names = {"actives": "actives_now", "above_ideal": "above_ideal_now", "above_ideal_pct": "above_ideal_pct_now"}
    return dimensional.executive_view(fact, dimension, actives, "sk", "trunk", names)


@plan("string course; bigint total", "H09", f"WITH {D.METRICS} SELECT course, total FROM metrics")
def guarded_refresh(t: Tables) -> DataFrame:
    return dimensional.guarded(metrics(t), t.orders, t.lineitem)


@plan("string table id parent detail; bigint number", "H10 H11 C01 C18",
      f"""WITH {_NAMED}, courses AS (SELECT DISTINCT coalesce(target, published) AS name, published FROM named n LEFT JOIN published p ON p.origin = n.published
      ), canonical AS (SELECT DISTINCT name FROM courses WHERE name NOT LIKE 'PROGRAMA %'
      ), structures AS (SELECT name, round_even(quantile_cont(permanence, 0.5) * 10, 0) / 10 AS ideal FROM named n JOIN courses c USING (published) JOIN canonical USING (name) GROUP BY 1
      ), people AS (SELECT person, arg_max(area, id) AS area FROM named GROUP BY 1)
      SELECT 'courses' AS "table", sha1(name) AS id, NULL AS parent, name AS detail, CASE WHEN name IN ('ENGENHARIA', 'MUSICA') THEN 1 ELSE 0 END AS number FROM canonical
      UNION ALL SELECT 'structures', sha1(name), sha1(name), name, CAST(ideal * 10 AS BIGINT) FROM structures
      UNION ALL SELECT 'people', sha1(person::VARCHAR), NULL, area, person FROM people
      UNION ALL SELECT 'movements', sha1(id::VARCHAR), sha1(person::VARCHAR), sha1(name), permanence FROM named JOIN courses USING (published) JOIN canonical USING (name)
      UNION ALL SELECT 'grants', sha1(id::VARCHAR), CASE WHEN name IN (SELECT name FROM canonical) THEN sha1(name) END, priority, entry_year
        FROM named JOIN courses USING (published) WHERE priority IN ('1-URGENT', '2-HIGH')""")
def normalise_3nf(t: Tables) -> DataFrame:
    """Five tables from flat rows, keys resolved by the published alias rules, ids by hash."""
    rows, rules = pinned(named(t)), published_rules(t)
    names = pinned(resolve.resolve(rows.select("published").distinct(), rules, "published", "origin", "target", "name"))
    catalogue = names.filter(~F.col("name").startswith("PROGRAMA ")).select("name").distinct()
    courses = normalise.courses(catalogue, "name", {"trunk": F.col("name").isin("ENGENHARIA", "MUSICA")})
    cells = resolve.resolve(cohorts.outcome_cube(rows, "published"), rules, "published", "origin", "target", "name")
    structures = pinned(normalise.structures(cohorts.deadlines(cells, "name").join(catalogue, "name").select("name", "ideal"), courses, "name", ["ideal"]))
    people = pinned(normalise.people(rows, "person", ["area"], F.desc("id")))
    places = normalise.places(names, "published", rules, structures, "name")
    moves = normalise.movements(rows, "id", people, "person", places, "published", ["permanence"])
    grants = normalise.grants(rows.filter(F.col("priority").isin("1-URGENT", "2-HIGH")), "id", places, "published", ["priority", "entry_year"])
    none = F.lit(None).cast("string")
    shapes = [
        ("courses", courses, "course_id", none, F.col("name"), F.col("trunk").cast("bigint")),
        ("structures", structures, "structure_id", F.col("course_id"), F.col("name"), (F.col("ideal") * 10).cast("bigint")),
        ("people", people, "person_id", none, F.col("area"), F.col("person")),
        ("movements", moves, "movement_id", F.col("person_id"), F.col("structure_id"), F.col("permanence").cast("bigint")),
        ("grants", grants, "grant_id", F.col("structure_id"), F.col("priority"), F.col("entry_year").cast("bigint")),
    ]
    result = None
    for label, df, id_, parent, detail, number in shapes:
        part = df.select(
            F.lit(label).alias("table"), F.col(id_).alias("id"), parent.alias("parent"), detail.alias("detail"), number.alias("number")
        )
        result = part if result is None else result.unionByName(part)
    return result


_SYNC = """t AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice AS price FROM part WHERE p_type <> 'PROMO'
), s AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'CHANGED' ELSE p_type END AS kind, p_retailprice AS price FROM part WHERE p_type <> 'SMALL')"""


@plan("bigint id; string kind action; double price", "I08",
      f"""WITH {_SYNC} SELECT coalesce(t.id, s.id) AS id, coalesce(s.kind, t.kind) AS kind, CASE WHEN t.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'kept'
        WHEN t.kind = s.kind AND t.price = s.price THEN 'equal' ELSE 'updated' END AS action, coalesce(s.price, t.price) AS price
      FROM t FULL JOIN s USING (id)""")
def change_only_upsert(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"), "p_size")
    target = part.filter("kind <> 'PROMO'").select("id", "kind", "price")
    source = part.filter("kind <> 'SMALL'").select(
        "id", F.when(F.col("p_size") < 10, "CHANGED").otherwise(F.col("kind")).alias("kind"), "price"
    )
    return sync.change_only_upsert(target, source, ["id"], ["kind", "price"])


@plan("string sk; bigint orders", "I09 C15",
      f"""WITH {_LOADS} SELECT sha1(h.person || '|' || strftime(valid_from, '%Y-%m-%d')) AS sk, count(*) AS orders
      FROM orders JOIN history h ON o_custkey = h.person WHERE valid_to IS NULL GROUP BY ALL""")
def relink_facts(t: Tables) -> DataFrame:
    here = pinned(history(t).withColumn("since", F.date_format("valid_from", "yyyy-MM-dd")))
    measures = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("orders"))
    fact = dimensional.current_fact(measures, here, "person", "version_key")
    there = here.select(F.sha1(F.concat_ws("|", "person", "since")).alias("sk"), "person", "since")
    travelled = sync.detach(fact, here, "version_key", ["person", "since"])
    return sync.relink(travelled, there, "sk", ["person", "since"])


@plan("bigint person current_versions; boolean flag_broken chain_broken", "K10",
      f"""WITH {_LOADS} SELECT person, 2 AS current_versions, false AS flag_broken, true AS chain_broken FROM history GROUP BY 1
        HAVING bool_or(priority = '5-LOW' AND valid_to IS NULL) AND count(*) > 3""")
def scd_checks(t: Tables) -> DataFrame:
    """Bad data on purpose: keys with more than three versions whose last one is 5-LOW get a second open version."""
    rows = pinned(history(t))
    bad = rows.groupBy("person").agg(
        F.count("*").alias("n"), F.bool_or((F.col("priority") == "5-LOW") & F.col("is_current")).alias("low")
    ).filter("n > 3 AND low").select("person")
    doubled = rows.filter("is_current").join(bad, "person", "left_semi").withColumn(
        "valid_from", F.col("valid_from") + F.expr("INTERVAL 1 DAY")
    )
    return quality.scd_violations(rows.unionByName(doubled), "person")


