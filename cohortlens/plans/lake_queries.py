"""Sources, contracts and the lake: files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


from ..operators import ordering, programme
from ..session import pinned, work_dir
from ..sources import contracts, lake, text

from .registry import Tables, plan


def _csv(t: Tables) -> str:
    """Orders as a published file: latin-1, semicolons, and lines with one field too many."""
    path = f"{work_dir(t.spark, 'files')}/orders.csv"
    low = F.col("o_orderpriority") == "5-LOW"
    note = F.when(F.col("o_totalprice") < 5000, "um;dois").when(low, "situação NULL").otherwise("NULL")
    t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", note.alias("note")).write.option("header", True).option(
        "sep", ";"
    ).option("encoding", "ISO-8859-1").option("quote", "").csv(path)
    return path


def _scan(t: Tables) -> DataFrame:
    return text.delimited(
        t.spark, _csv(t), ["o_orderkey", "o_orderstatus", "o_orderpriority", "note"], separator=";", encoding="ISO-8859-1"
    )


@plan("string note; bigint lines dropped", "A01",
      """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'situação NULL' ELSE 'NULL' END AS note, count(*) AS lines,
        (SELECT count(*) FROM orders WHERE o_totalprice < 5000) AS dropped FROM orders WHERE o_totalprice >= 5000 GROUP BY 1""")
def text_scan(t: Tables) -> DataFrame:
    rows = _scan(t)
    dropped = text.line_counts(rows).select("dropped").scalar()
    return text.good_rows(rows).groupBy("note").agg(F.count("*").alias("lines")).withColumn("dropped", dropped)


@plan("string o_orderkey o_orderstatus", "A02 K21",
      "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 5000")
def minimised_scan(t: Tables) -> DataFrame:
    from ..operators.quality import assert_absent

    rows = text.minimised(text.good_rows(_scan(t)), ["o_orderkey", "o_orderstatus"])
    return assert_absent(rows, ["note", "o_custkey"])


@plan("string file_name url; bigint page_id", "A03",
      """SELECT file_name, url, page_id FROM (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS file_name FROM pages)
      WHERE regexp_matches(file_name, '(?i)PAGE=[0-9]+') QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY page_id DESC) = 1""")
def latest_resource(t: Tables) -> DataFrame:
    return text.resources(t.pages.select("page_id", "url"), "url", "page_id", r"PAGE=\d+")


@plan("string source_file published; bigint rows with_priority people", "A04",
      """SELECT 'orders-1.csv' AS source_file, '2022-01-10' AS published, count(*) AS rows, 0 AS with_priority, count(DISTINCT o_custkey) AS people
        FROM orders WHERE year(o_orderdate) <= 1998
      UNION ALL SELECT 'orders-2.csv', '2024-08-23', count(*), count(o_orderpriority), count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 1000""")
def stack_versions(t: Tables) -> DataFrame:
    first = t.orders.filter(F.year("o_orderdate") <= 1998).select("o_custkey")
    second = t.orders.filter("o_totalprice > 1000").select("o_custkey", "o_orderpriority")
    rows = text.stacked_versions([(first, "orders-1.csv", "2022-01-10"), (second, "orders-2.csv", "2024-08-23")])
    per_person = rows.groupBy("source_file", "published", "o_custkey").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("p"))
    return per_person.groupBy("source_file", "published").agg(
        F.sum("n").alias("rows"), F.sum("p").alias("with_priority"), F.count("*").alias("people")
    )


@plan("bigint suppkey lines; double quantity", "A05 B30",
      """SELECT l_suppkey AS suppkey, count(*) AS lines, sum(CAST(l_quantity AS DECIMAL(28,2))) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
      WHERE l_returnflag = 'R' AND s_nationkey IN (0, 3) GROUP BY 1""")
def filtered_ingest(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_suppkey").alias("suppkey"), "l_quantity", "l_returnflag")
    peers = t.supplier.select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    kept = text.filtered_ingest(lines, peers, "suppkey", F.col("l_returnflag") == "R", F.col("s_nationkey").isin(0, 3))
    return kept.groupBy("suppkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("quantity"))


@plan("string segment; bigint rows named", "A06",
      """SELECT CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS segment, count(*) AS rows, count(*) FILTER (c_custkey % 2 = 1) AS named FROM customer GROUP BY 1""")
def null_tokens(t: Tables) -> DataFrame:
    raw = t.customer.select(
        F.when(F.col("c_nationkey") % 3 == 0, F.element_at(F.array(F.lit("NULL"), F.lit(""), F.lit("#N/A")), (F.col("c_nationkey") % 2 + 1)))
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 2 == 0, "nan").otherwise(F.col("c_name")).alias("name"),
    )
    return text.decode_nulls(raw).groupBy("segment").agg(F.count("*").alias("rows"), F.count("name").alias("named"))


@plan("bigint p_partkey p_size extra; double p_retailprice; string p_name", "A07",
      "SELECT p_partkey, p_size, NULL AS extra, p_retailprice, p_name FROM part")
def write_contract(t: Tables) -> DataFrame:
    schema = T.StructType.fromDDL("p_partkey bigint not null, p_name string, p_size smallint, p_retailprice double, extra int")
    raw = t.part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name",
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"),
    )
    return contracts.prepare(raw, schema, "part")


@plan("bigint place orderkey; string customer_name", "A08 A09",
      """SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey AS orderkey, c_name AS customer_name FROM orders JOIN customer ON c_custkey = o_custkey""")
def atomic_replace(t: Tables) -> DataFrame:
    """Two tables replaced twice, one read back in its stored order, without the order column, and numbered as it comes."""
    store = lake.Lake(t.spark, work_dir(t.spark, "layer"))
    ordered = ordering.numbered(t.orders.select("o_orderkey", "o_custkey"), F.asc("o_orderkey"), name=lake.ORDER)
    for _ in range(2):
        store.replace("orders", ordered)
        store.replace("customer", t.customer.select("c_custkey", "c_name"))
    # The rows come as one sorted sequence, so partition and place in it number them.
    placed = pinned(lake.stored_order(store.read("orders")).withColumn("at", F.monotonically_increasing_id()))
    rows = ordering.numbered(placed, F.asc("at"), name="place").drop("at")
    names = store.read("customer")
    return rows.join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        "place", F.col("o_orderkey").alias("orderkey"), F.col("c_name").alias("customer_name")
    )


@plan("string table name sha256; bigint bytes bad_line rows dropped; boolean valid_utf8", "A10",
      """SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "table", max(page_id)::VARCHAR AS name, arg_max(sha256(CASE WHEN page_id % 7 = 0
          THEN encode(html) || '\\x0A\\xE1'::BLOB ELSE encode(html) END), page_id) AS sha256,
        arg_max(strlen(html) + CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END, page_id) AS bytes,
        arg_max(CASE WHEN page_id % 7 = 0 THEN 2 + strlen(html) - strlen(replace(html, chr(10), '')) ELSE -1 END, page_id) AS bad_line,
        (SELECT count(*) FROM orders WHERE o_totalprice >= 5000) AS rows, (SELECT count(*) FROM orders WHERE o_totalprice < 5000) AS dropped,
        arg_max(page_id % 7 <> 0, page_id) AS valid_utf8 FROM pages GROUP BY 1""")
def provenance(t: Tables) -> DataFrame:
    """Loads of two tables, every 7th with a broken byte in its last line: the ledger keeps the newest of each."""
    content = F.encode("html", "UTF-8")
    broken = F.when(F.col("page_id") % 7 == 0, F.concat(content, F.lit(bytearray(b"\n\xe1")))).otherwise(content)
    found = text.content_provenance(t.pages.withColumn("content", broken), "page_id", "content")
    counts = text.line_counts(_scan(t))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("name").cast("int"))
    ledger = None
    for name, part in (("even", found.filter(F.col("name").cast("bigint") % 2 == 0)), ("odd", found.filter(F.col("name").cast("bigint") % 2 == 1))):
        record = text.ingestion_record(part, counts, name, "portal", F.col("name"), day)
        ledger = record if ledger is None else ledger.unionByName(record)
    kept = text.upsert_ingestions(ledger.filter(F.length("resource") < 2), ledger.filter(F.length("resource") >= 2))
    return kept.withColumnRenamed("resource", "name").withColumn("bad_line", F.coalesce("bad_line", F.lit(-1)))


@plan("bigint page_id; double value", "A11",
      """SELECT page_id, CASE WHEN html NOT LIKE '%lang="fr"%' THEN page_id * 7 + 1000.25 END AS value FROM pages""")
def html_value(t: Tables) -> DataFrame:
    """A row with the value, its letters as named, decimal and hexadecimal references in turn."""
    amount = F.col("page_id") * 7 + 1000.25
    shown = F.translate(F.format_number(amount, 2), ",.", ".,")
    spelled = F.element_at(F.array(
        F.lit("Inicia&ccedil;&atilde;o Cient&iacute;fica (PIBIC)</td>\n <td>IC -&nbsp;"), F.lit("Inicia&#231;&#227;o Cient&#237;fica IC&#32;-&#160;"),
        F.lit("Inicia&#xE7;&#xe3;o Cient&#xed;fica IC&ensp;- "),
    ), (F.col("page_id") % 3 + 1).cast("int"))
    row = F.concat(F.lit("<tr><td>"), spelled, F.lit("</td><td>"), shown, F.lit("</td></tr>"))
    html = F.when(~F.col("html").contains('lang="fr"'), F.concat("html", row)).otherwise(F.col("html"))
    return t.pages.select("page_id", text.page_value(html).alias("value"))


@plan("string event_type; bigint event_id level", "A12",
      """SELECT event_type, event_id, level FROM (SELECT nullif(event_type, 'error') AS event_type, event_id, CAST(floor(value / 20) AS BIGINT) AS level FROM events)
      QUALIFY level IS DISTINCT FROM lag(level) OVER (PARTITION BY event_type ORDER BY event_id)""")
def append_on_change(t: Tables) -> DataFrame:
    """Events of one kind stand for rows without a key: they are a series."""
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    rows = t.events.select(kind.alias("event_type"), "event_id", F.floor(F.col("value") / 20).alias("level"))
    return programme.append_on_change(rows, ["event_type"], ["event_id"], "level")


@plan("string vigente_desde; double valor_mensal", "A13",
      "SELECT year(o_orderdate) || '-07' AS vigente_desde, max(o_totalprice) AS valor_mensal FROM orders GROUP BY 1")
def json_source(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/series.json"
    rates = t.orders.groupBy(F.concat(F.year("o_orderdate").cast("string"), F.lit("-07")).alias("vigente_desde")).agg(
        F.max("o_totalprice").alias("valor_mensal")
    )
    # A published series has one entry per change, here one per year.
    rates.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("vigencias"))).alias("value")).write.text(path)
    return text.json_series(t.spark, path, "vigencias", {"vigente_desde": "string", "valor_mensal": "double"})


def _windowed(t: Tables, width: int = 5) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("entry_year"))
    return lake.with_window(rows, "entry_year", "window", width)


@plan("bigint window rows files_kept; double amount", "A14 A15 B24",
      """SELECT year(o_orderdate) - year(o_orderdate) % 2 AS window, count(*) AS rows,
        sum(CAST(o_totalprice AS DECIMAL(28,2))) * CASE WHEN year(o_orderdate) - year(o_orderdate) % 2 = 1996 THEN 2 ELSE 1 END AS amount,
        CASE WHEN year(o_orderdate) - year(o_orderdate) % 2 = 1996 THEN 0 ELSE 1 END AS files_kept
      FROM orders WHERE year(o_orderdate) < 2000 GROUP BY year(o_orderdate) - year(o_orderdate) % 2""")
def window_overwrite(t: Tables) -> DataFrame:
    """The window 2000 lost all its rows, 1996 was revised, by a second opening of the folder; the others must keep their very files."""
    folder = work_dir(t.spark, "lake")
    rows = _windowed(t, 2)
    lake.Lake(t.spark, folder).replace("enrolments", rows, "window")
    store = lake.Lake(t.spark, folder)

    def files() -> DataFrame:
        return store.read("enrolments").select("window", F.input_file_name().alias("file")).distinct()

    before = pinned(files())
    # Rows of all windows are offered with another amount: only the named windows may change.
    revised = rows.filter("entry_year < 2000").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    store.replace_windows("enrolments", revised, [1996, 2000])
    kept = files().join(before.withColumn("old", F.lit(1)), ["window", "file"], "left").groupBy("window").agg(
        F.min(F.coalesce("old", F.lit(0))).alias("files_kept")
    )
    return store.read("enrolments").groupBy("window").agg(
        F.count("*").alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("amount")
    ).join(kept, "window")


@plan("bigint window rows_written", "A16 A17",
      """SELECT 2000 AS window, count(*) FILTER (year(o_orderdate) >= 2000) AS rows_written FROM orders""")
def changed_windows(t: Tables) -> DataFrame:
    """The second export opens the folder anew; it finds and writes the one window with late rows."""
    folder = work_dir(t.spark, "lake")
    rows = _windowed(t)
    lake.Lake(t.spark, folder).export_changed({"enrolments": (rows, "window"), "nation": (t.nation, None)})
    store = lake.Lake(t.spark, folder)
    newest = rows.agg(F.max("o_orderkey")).scalar()
    late = (F.col("entry_year") >= 2000) & (F.col("o_orderkey") > newest - 1000)
    revised = rows.withColumn("o_orderstatus", F.when(late, "F").otherwise(F.col("o_orderstatus")))
    changed = pinned(lake.window_differences(revised, store.read("enrolments").select(*revised.columns), "window"))
    written = store.export_changed({"enrolments": (revised, "window"), "nation": (t.nation, None)})
    return changed.withColumn("rows_written", F.lit(written["enrolments"] + written["nation"]))


@plan("string table sort_key record; bigint place", "A18",
      """SELECT 1 AS place, 'nation' AS "table", lpad(n_nationkey::VARCHAR, 6, '0') AS sort_key,
        '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record FROM nation
      UNION ALL SELECT 2, 'customer', lpad(c_custkey::VARCHAR, 12, '0'), '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer
      UNION ALL SELECT 3, 'reports', 'orders', '{"name":"orders","content":"{\\"rows\\":' || count(*) || '}"}' FROM orders
      UNION ALL SELECT 4, 'freshness', 'processing', '{"check":"processing","age_days":2.5,"inside":true}'""")
def json_snapshot(t: Tables) -> DataFrame:
    """Tables in their order, then the reports, then the freshness."""
    from ..functions.records import json_record
    from ..operators import quality

    def moment(text_: str):
        return F.lit(text_).cast("timestamp_ntz").cast("timestamp")

    reports = t.orders.agg(F.count("*").alias("rows")).select(F.lit("orders").alias("name"), json_record(F.col("rows")).alias("content"))
    none = t.events.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("published")).limit(0)
    fresh = quality.freshness(none, moment("2024-01-01"), moment("2024-01-03 12:00:00"))
    return lake.json_snapshot({
        "nation": (t.nation, [F.lpad(F.col("n_nationkey").cast("string"), 6, "0")]),
        "customer": (t.customer.select("c_custkey", "c_mktsegment"), [F.lpad(F.col("c_custkey").cast("string"), 12, "0")]),
        "reports": (reports, [F.col("name")]),
        "freshness": (fresh.select("check", "age_days", "inside"), [F.col("check")]),
    })


@plan("string status; bigint rows", "A19", "SELECT o_orderstatus AS status, 2 * count(*) AS rows FROM orders GROUP BY 1")
def compaction(t: Tables) -> DataFrame:
    """A second load appended to the first, so that every window has files of both; then one file set."""
    store = lake.Lake(t.spark, work_dir(t.spark, "lake"))
    store.replace("enrolments", _windowed(t), "window")
    store.append("enrolments", _windowed(t).repartition("o_orderkey"))
    store.compact("enrolments")
    return store.read("enrolments").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows"))


@plan("string name content", "A21",
      """SELECT 'orders' AS name, '{"rows":' || count(*) || ',"share":null}' AS content FROM orders
      UNION ALL SELECT 'parts', '{"rows":' || count(*) || '}' FROM part""")
def report_upsert(t: Tables) -> DataFrame:
    from ..functions.numbers import no_nan
    from ..functions.records import json_record

    def report(name: str, df: DataFrame, *extra) -> DataFrame:
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), json_record(F.col("rows"), *extra).alias("content")
        )

    old = report("orders", t.customer).unionByName(report("parts", t.part))
    return lake.upsert_reports(old, report("orders", t.orders, no_nan(F.lit(float("nan"))).alias("share")))


@plan("bigint rows; boolean same differs", "A22",
      "SELECT count(*) AS rows, true AS same, true AS differs FROM lineitem")
def fingerprint(t: Tables) -> DataFrame:
    rows = lake.fingerprint(t.lineitem)
    moved = lake.fingerprint(t.lineitem.repartition("l_partkey")).select("fingerprint").scalar()
    other = lake.fingerprint(t.lineitem.withColumn("l_tax", F.col("l_tax") + 0.0001)).select("fingerprint").scalar()
    return rows.select("rows", (F.col("fingerprint") == moved).alias("same"), (F.col("fingerprint") != other).alias("differs"))


