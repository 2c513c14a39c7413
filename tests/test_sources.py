import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from cohortlens.session import work_dir
from cohortlens.sources import contracts, lake, text
from cohortlens.operators.quality import SchemaMismatch, assert_absent, assert_schema


def put(path, content: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


def test_delimited_keeps_text_and_counts_malformed_lines(spark, rows, tmp_path):
    path = put(f"{tmp_path}/a/notas.csv", "id;nome;nota\n1;Ação;NULL\n2;;  7\n3;x;1;extra\n4;y\n".encode("latin-1"))
    df = text.delimited(spark, path, ["id", "nome", "nota"], ";", "ISO-8859-1")
    assert rows(text.good_rows(df)) == [("1", "Ação", "NULL"), ("2", "", "  7")]
    assert tuple(text.line_counts(df).first()) == (2, 2)
    with pytest.raises(text.MissingColumns):
        text.minimised(df, ["id", "cpf"])


def test_versions_of_a_file(spark, rows, tmp_path):
    listing = spark.createDataFrame(
        [("http://x/cursos-08-2024.csv", "2024-08-23"), ("http://y/cursos-08-2024.csv", "2024-08-24"),
         ("http://x/cursos-01-2022.csv", "2022-01-10"), ("http://x/notas.pdf", "2025-01-01")], "url string, modified string")
    assert rows(text.resources(listing, "url", "modified", r"^CURSOS-.*\.csv$").select("file_name", "url")) == [
        ("cursos-01-2022.csv", "http://x/cursos-01-2022.csv"), ("cursos-08-2024.csv", "http://y/cursos-08-2024.csv")]
    assert text.newest_resource(listing, "url", "modified", r"^cursos-").first().modified == "2024-08-24"
    for name in ("v1.csv", "v2.csv"):
        put(f"{tmp_path}/v/{name}", b"id\n1\n")
    scan = text.good_rows(text.delimited(spark, f"{tmp_path}/v", ["id"]))
    assert rows(text.tagged_scan(scan, {"v1.csv": "2022-01-10"})) == [("1", "v1.csv", "2022-01-10"), ("1", "v2.csv", None)]


def test_null_tokens(spark, rows):
    df = spark.createDataFrame([("NULL", 1), ("nulo", 2), ("", 3), (None, 4)], "s string, n int")
    assert rows(text.decode_nulls(df)) == [("nulo", 2), (None, 1), (None, 3), (None, 4)]


def test_provenance(spark, tmp_path):
    import hashlib

    good, bad = "olá\n".encode(), "ok\nolá\n".encode("latin-1")
    late = b"line\n" * 20 + "olá\n".encode("latin-1")
    put(f"{tmp_path}/p/late.csv", late)
    put(f"{tmp_path}/p/good.csv", good)
    put(f"{tmp_path}/p/bad.csv", bad)
    got = {r.name: r for r in text.provenance(spark, f"{tmp_path}/p", "*.csv").collect()}
    assert (got["good.csv"].bytes, got["good.csv"].sha256) == (len(good), hashlib.sha256(good).hexdigest())
    assert (got["good.csv"].valid_utf8, got["bad.csv"].valid_utf8, got["bad.csv"].bad_line) == (True, False, 2)
    assert "0xe1" in got["bad.csv"].evidence
    assert (got["late.csv"].valid_utf8, got["late.csv"].bad_line) == (False, 21), "every line is checked"


def test_ingestion_ledger(spark):
    def record(table, day, kept, dropped, content):
        files = text.content_provenance(spark.createDataFrame([("f", bytearray(content))], "name string, content binary"), "name", "content")
        counts = spark.createDataFrame([(kept, dropped)], "kept long, dropped long")
        return text.ingestion_record(files, counts, table, "portal", F.lit(f"http://x/{day}"), F.lit(day).cast("date"), "latin-1", ";")

    old = record("a", "2024-01-01", 5, 1, b"x").unionByName(record("b", "2024-01-01", 2, 0, b"y"))
    fresh = record("a", "2024-02-01", 7, 0, b"\xe1").unionByName(record("c", "2024-02-01", 1, 0, b"z"))
    got = {r.table: r for r in text.upsert_ingestions(old, fresh).collect()}
    assert {k: (r.rows, r.dropped, r.valid_utf8, str(r.loaded_at)) for k, r in got.items()} == {
        "a": (7, 0, False, "2024-02-01"), "b": (2, 0, True, "2024-01-01"), "c": (1, 0, True, "2024-02-01"),
    }
    again = text.upsert_ingestions(text.upsert_ingestions(old, fresh), fresh)
    assert {r.table: r.rows for r in again.collect()} == {"a": 7, "b": 2, "c": 1}
    flags = again.select("table", text.looks_misread(F.col("valid_utf8"), F.col("encoding")).alias("m")).collect()
    assert {r.table: r.m for r in flags} == {"a": False, "b": True, "c": True}


def test_page_value(spark):
    pages = [
        "<p>Inicia&ccedil;&atilde;o&nbsp;Cient&iacute;fica</p> <td>IC</td><td>-</td><b>1.700,50</b>", "<p>nada</p>",
        "Inicia&#231;&#227;o Cient&#237;fica IC - 700,00", "Inicia&#xE7;&#xe3;o&#32;Cient&iacutefica IC&ensp;-&#160;700,00", None,
    ]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(text.page_value(F.col("html"))).collect()] == [1700.5, None, 700.0, 700.0, None]


def test_json_series(spark, rows, tmp_path):
    entries = [{"vigente_desde": "2023-02", "valor_mensal": 700}, {"vigente_desde": "2012-07", "valor_mensal": 400}]
    path = put(f"{tmp_path}/j/s.json", json.dumps({"vigencias": entries}, indent=1).encode())
    series = text.json_series(spark, path, "vigencias", {"vigente_desde": "string", "valor_mensal": "double"})
    assert [tuple(r) for r in series.collect()] == [("2012-07", 400.0), ("2023-02", 700.0)]
    path = put(f"{tmp_path}/k/s.json", json.dumps({"vigencias": [{"vigente_desde": "2023-02"}]}).encode())
    with pytest.raises(PySparkException, match="has no valor_mensal"):
        text.json_series(spark, path, "vigencias", {"vigente_desde": "string", "valor_mensal": "double"}).collect()


def test_write_contract(spark, rows):
    schema = T.StructType.fromDDL("id bigint not null, total smallint, name string")
    df = spark.createDataFrame([("1", 8.0), ("2", None)], "id string, total double")
    assert rows(contracts.prepare(df, schema, "t")) == [(1, 8, None), (2, None, None)]
    for columns, message in ((["id", "x"], "outside"), (["total"], "required")):
        with pytest.raises(contracts.ContractError, match=message):
            contracts.prepare(spark.createDataFrame([tuple("1" for _ in columns)], columns), schema, "t")
    for value in (8.5, 40000.0):
        lossy = spark.createDataFrame([("1", value)], "id string, total double")
        assert contracts.lossy_rows(lossy, "total", T.ShortType()).count() == 1
        with pytest.raises(PySparkException, match="not a whole"):
            contracts.prepare(lossy, schema, "t").collect()


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert_schema(df, T.StructType.fromDDL("id int, name string"))
    for wrong in ("id bigint, name string", "id int", "id int, name string, extra int"):
        with pytest.raises(SchemaMismatch):
            assert_schema(df, T.StructType.fromDDL(wrong))
    with pytest.raises(SchemaMismatch):
        assert_absent(df, ["name"])


YEARS = (2008, 2012, 2016, 2019, 2021, 2023)


def enrolments(spark, years=YEARS, outcome="ATIVO"):
    df = spark.createDataFrame([(i * 100 + n, y, outcome, None) for i, y in enumerate(years) for n in range(20)],
                               "id long, year int, outcome string, exit_year int")
    return lake.with_window(df, "year")


@pytest.fixture
def store(spark):
    return lake.Lake(spark, work_dir(spark, "lake"))


def test_replace_is_idempotent_and_keeps_types(spark, store):
    df = enrolments(spark)
    for _ in range(2):
        assert store.replace("e", df, "window") == 120
    assert store.read("e").select(*df.columns).schema == df.schema
    assert lake.fingerprint(store.read("e").select(*df.columns)).first() == lake.fingerprint(df).first()
    assert store.windows("e") == [2005, 2010, 2015, 2020]


def test_windows_are_pruned_by_year(spark, store):
    store.replace("e", enrolments(spark), "window")
    part = store.read("e", first=2016, last=2019)
    assert {r.window for r in part.select("window").distinct().collect()} == {2015}
    assert "PartitionFilters: [isnotnull(window" in part._jdf.queryExecution().executedPlan().toString()


def test_only_the_given_windows_change(spark, store):
    df = enrolments(spark)
    store.replace("e", df, "window")

    def files(window):
        return sorted({r[0] for r in store.read("e").filter(F.col("window") == window).select(F.input_file_name()).distinct().collect()})

    before = {w: files(w) for w in (2005, 2010, 2015)}
    assert store.replace_windows("e", df.filter("window <> 2020").unionByName(enrolments(spark, [2021])), [2020]) == 20
    assert store.read("e").filter("window = 2020").count() == 20
    assert {w: files(w) for w in before} == before
    assert store.replace_windows("e", df.filter("window <> 2005"), [2005]) == 0
    assert store.windows("e") == [2010, 2015, 2020] and store.read("e").count() == 80
    assert store.replace_windows("e", df, [2005, 2010]) == 40 and store.read("e").count() == 100
    store.replace("flat", spark.range(3))
    with pytest.raises(ValueError):
        store.replace_windows("flat", spark.range(3), [0])


def test_rows_without_a_window_are_a_window(spark, store):
    df = enrolments(spark).unionByName(lake.with_window(spark.createDataFrame([(1, None, "x", None)], "id long, year int, outcome string, exit_year int"), "year"))
    assert store.replace("e", df, "window") == 121
    assert store.changed_windows("e", df) == [] and None in store.windows("e")
    revised = df.withColumn("outcome", F.when(F.col("window").isNull(), "y").otherwise(F.col("outcome")))
    assert store.changed_windows("e", revised) == [None]
    assert store.replace_windows("e", revised, [None]) == 1
    assert store.read("e").filter("window is null").first().outcome == "y" and store.read("e").count() == 121
    assert store.replace_windows("e", df.filter("window is not null"), [None, 2005]) == 20
    assert store.windows("e") == [2005, 2010, 2015, 2020]


def test_changed_windows(spark, store):
    df = enrolments(spark)
    assert store.changed_windows("e", df, "window") == [2005, 2010, 2015, 2020]
    store.replace("e", df, "window")
    assert store.changed_windows("e", df) == []
    one = df.withColumn("outcome", F.when((F.col("year") == 2016) & (F.col("id") % 100 == 3), "FORMATURA").otherwise(F.col("outcome")))
    assert store.changed_windows("e", one) == [2015]
    renumbered = df.withColumn("id", F.when(F.col("year") == 2008, F.col("id") + 5000).otherwise(F.col("id")))
    assert store.changed_windows("e", renumbered) == [2005]
    assert store.changed_windows("e", df.filter("window <> 2010")) == [2010]
    twice = df.unionByName(df.filter("id = 0"))
    assert store.changed_windows("e", twice) == [2005]
    assert store.changed_windows("e", df.withColumn("extra", F.lit(1))) == [2005, 2010, 2015, 2020]


def test_incremental_export(spark, store):
    df, flat = enrolments(spark), spark.range(5)
    tables = {"e": (df, "window"), "f": (flat, None)}
    assert store.export_changed(tables) == {"e": 120, "f": 5}
    assert store.export_changed(tables) == {"e": 0, "f": 0}
    late = df.withColumn("outcome", F.when(F.col("year") == 2023, "EVASAO").otherwise(F.col("outcome")))
    assert store.export_changed({"e": (late, "window"), "f": (spark.range(6), None)}) == {"e": 40, "f": 6}
    assert store.export_windows({"e": (late, "window"), "f": (flat, None)}, [2005]) == {"e": 20}


def test_a_table_that_feeds_on_itself(spark, store):
    store.replace("a", spark.range(5))
    with pytest.raises(Exception):
        store.replace("a", store.read("a").withColumn("id", F.col("id") + 1))
    assert store.read("a").count() == 5


def test_another_session_goes_on_with_the_tables(spark, store):
    df = enrolments(spark)
    store.export_changed({"e": (df, "window"), "f": (spark.range(5), None)})
    files = sorted(store.read("e").inputFiles())
    other = spark.newSession()
    again = lake.Lake(other, store.root + "/")
    same = other.createDataFrame(df.collect(), df.schema)
    assert again.windows("e") == [2005, 2010, 2015, 2020] and again.window_of("e") == "window" and again.window_of("f") is None
    assert again.changed_windows("e", same) == []
    assert again.export_changed({"e": (same, "window"), "f": (other.range(5), None)}) == {"e": 0, "f": 0}
    assert sorted(again.read("e").inputFiles()) == files, "no second copy"
    assert again.replace_windows("e", same.filter("id < 0"), [2005]) == 0
    assert store.windows("e") == [2010, 2015, 2020] and store.read("e").count() == 100
    assert other.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


@pytest.mark.parametrize("kind, values", [
    ("string", ["O'B", "a/b=c%20 {x}", "2020", "ção"]), ("date", ["2020-01-01", "2021-06-30"]), ("int", ["7", "-3"]), ("boolean", ["true", "false"]),
])
def test_windows_of_any_type_keep_it_and_can_be_emptied(spark, store, kind, values):
    rows = [(i, v) for i, v in enumerate([*values, None]) for _ in range(2)]
    df = spark.createDataFrame(rows, "id int, w string").withColumn("w", F.col("w").cast(kind))
    assert store.replace("e", df, "w") == len(rows)
    assert store.read("e").schema["w"].dataType == df.schema["w"].dataType and store.changed_windows("e", df) == []
    windows = store.windows("e")
    assert len(windows) == len(values) + 1 and windows[-1] is None
    assert store.replace_windows("e", df.filter("id > 0"), windows) == len(rows) - 2
    assert store.windows("e") == [w for w in windows if w != df.first().w]
    assert store.replace_windows("e", df.limit(0), windows) == 0 and store.read("e").count() == 0
    assert store.replace_windows("e", df, windows) == len(rows) and store.changed_windows("e", df) == []


def test_an_empty_table_keeps_its_columns(spark, store):
    df = enrolments(spark)
    assert store.replace("e", df.limit(0), "window") == 0
    assert store.windows("e") == [] and set(store.read("e").columns) == set(df.columns)
    assert store.changed_windows("e", df) == [2005, 2010, 2015, 2020]
    assert store.export_changed({"e": (df, "window")}) == {"e": 120}
    with pytest.raises(ValueError):
        store.read("none")


def test_digests_are_of_bags_and_agree_with_the_rows(spark, store):
    df = enrolments(spark).withColumn("m", F.create_map(F.lit("k"), F.col("outcome")))
    twice = df.unionByName(df.filter("id = 0"))
    assert not lake.table_changed(df, df.repartition(3)) and lake.table_changed(df, twice)
    swapped = df.withColumn("outcome", F.when(F.col("id") == 0, F.lit(None)).otherwise(F.col("outcome")))
    plain = [c for c in df.columns if c != "m"]
    for new in (df, twice, swapped, df.filter("year <> 2016")):
        quick = {r[0] for r in lake.window_differences(new.select(plain), df.select(plain), "window").collect()}
        assert quick == {r[0] for r in lake.window_differences(new.select(plain), df.select(plain), "window", exact=True).collect()}
    store.replace("e", df.select(plain), "window")
    plan = lake.window_differences(df.select(plain), store.read("e"), "window")._jdf.queryExecution().executedPlan().toString()
    assert all("outcome" not in line for line in plan.splitlines() if "Exchange" in line), "rows are not shuffled"


def test_compaction_keeps_the_rows(spark, store):
    store.replace("e", enrolments(spark), "window")
    store.append("e", enrolments(spark).repartition(12))
    before, files = lake.fingerprint(store.read("e")).first(), len(store.read("e").inputFiles())
    store.compact("e")
    assert lake.fingerprint(store.read("e")).first() == before and len(store.read("e").inputFiles()) < files


def test_order_reports_and_fingerprints(spark, rows):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "_order int, v string, w string")
    assert [tuple(r) for r in lake.stored_order(df).collect()] == [("a", "x"), ("b", None)]
    reports = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, content string")
    newer = spark.createDataFrame([("b", None), ("c", "9")], "name string, content string")
    assert rows(lake.upsert_reports(reports, newer)) == [("a", "1"), ("b", None), ("c", "9")]
    assert lake.table_changed(df, df.unionByName(df)) and not lake.table_changed(df, df.orderBy("_order"))
    assert lake.fingerprint(df).first() != lake.fingerprint(df.fillna("")).first()


def test_a_workspace_deletes_what_was_written_in_it(spark):
    import os

    from cohortlens.session import pinned, workspace

    with workspace(spark):
        outer = pinned(spark.range(3))
        with workspace(spark):
            inner = pinned(spark.range(4))
            assert inner.count() == 4
        folder = os.path.dirname(inner.inputFiles()[0].removeprefix("file://"))
        assert not os.path.exists(folder) and outer.count() == 3
    kept = pinned(spark.range(2))
    assert kept.count() == 2
