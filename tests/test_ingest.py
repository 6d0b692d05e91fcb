"""Raw folders to bronze tables: routing, streams, rescue, evolution, catalog."""

import json
import os
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from trackline import schemas
from trackline.plans.curate import write_curated
from trackline.plans.marts import filter_choices, operations_pages, station_pages
from trackline.sources import readers, tables
from trackline.sources.bundle import load_files, rejected_files
from trackline.sources.inventory import build_specs, list_files, route_files, spec_table, uncovered_files
from trackline.streaming.evolution import merge_types
from trackline.streaming.ingest import audit, batch_rows, coverage, ingest, write_batch
from trackline.streaming.rescue import covers, inferred, parse_documents, parse_objects, read_objects, seen_schema

STATIONS = "CÓDIGO;DESCRIPCION;LATITUD;LONGITUD;PROVINCIA\n1;Ávila;40,5;-4,7;Ávila\n1 ;Ávila ;40,5;-4,7;\n2;Zero;0;0;X\n"
FEED = {
    "header": {"timestamp": "1704103200"},
    "entity": [
        {"id": "u1", "tripUpdate": {"trip": {"tripId": "T1"}, "delay": 120, "stopTimeUpdate": []}},
        {"id": "u2", "tripUpdate": {"trip": {"tripId": "T2"}, "stopTimeUpdate": [{"departure": {"delay": 60}}]}},
    ],
}
VEHICLES = {
    "entity": [
        {"id": "v1", "vehicle": {"trip": {"tripId": "T1"}, "vehicle": {"id": "9", "label": "nine"}, "currentStatus": "STOPPED_AT",
                                 "stopId": "1", "position": {"latitude": 40.5, "longitude": -4.7}}},
        {"id": "v2", "vehicle": {"trip": {"tripId": "T2"}}},
    ]
}
ALERTS = {"entity": [{"id": "a", "alert": {"informedEntity": [{}, {}], "descriptionText": {"translation": [{"text": "Obras"}]}}}]}
INCIDENTS = [{"chipText": "AVISO", "aspect": "red", "paragraph": "p", "link": "l"}]


def put(folder, name, content, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = content if isinstance(content, (str, bytes)) else json.dumps(content)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode(encoding))
    return path


class Place:
    def __init__(self, spark, folder):
        self.spark, self.raw, self.state = spark, f"{folder}/raw", f"{folder}/state"
        self.database, self.location = f"db_{uuid.uuid4().hex}", f"{folder}/tables"

    def load(self, **options):
        return ingest(self.spark, self.raw, self.state, self.database, self.location, **options)

    def table(self, name):
        return self.spark.table(f"{self.database}.{name}")


@pytest.fixture
def place(spark, folder):
    return Place(spark, folder)


@pytest.fixture
def full(place):
    raw = place.raw
    for name in ("estaciones.csv", "listado_completo_av_ld_md.csv"):
        put(raw, name, STATIONS, "latin-1")
    put(raw, "listado-de-estaciones-feve-2.csv", STATIONS, "utf-8-sig")
    put(raw, "listado-de-estaciones-con-servicio-de-atendo.csv", "APARCAMIENTO;ANDÉN;Tiempo de antelación\nSí;NO;30 min\n", "latin-1")
    put(raw, "informacion_trenes.csv", "MODELO;CONSTRUCTOR;VELOCIDAD_MAXIMA\nS-1;Acme;300 km/h\n")
    put(raw, "google_transit/stops.txt", "stop_id,stop_name,stop_lat,stop_lon\n1,Uno,40.5,-4.7\n2,Dos,x,1\n")
    put(raw, "google_transit/routes.txt", "route_id,route_short_name,route_type\nR1,C1,2\n")
    put(raw, "google_transit/trips.txt", "trip_id,route_id,direction_id\nT1,R1,1\nT2,R1,\n")
    put(raw, "trip_updates.json", FEED)
    put(raw, "trip_updates_LD.json", FEED)
    put(raw, "vehicle_positions.json", VEHICLES)
    put(raw, "alerts.json", ALERTS)
    put(raw, "rfincidentreports_co.noticeresults.json", INCIDENTS)
    put(raw, "feed.pb", b"\x00\x01\xff")
    put(raw, "notes.md", "not data")
    return place


ROUTES = {
    "estaciones.csv": ("bronze_csv_estaciones", "csv"),
    "trip_updates_LD.json": ("bronze_json_trip_updates_ld", "json"),
    "google_transit/routes.txt": ("bronze_google_transit_routes", "csv"),
    "horarios-feve/ROUTES.TXT": ("bronze_horarios_feve_routes", "csv"),
    "other/routes.txt": (None, None),
    "routes.txt": (None, None),
    "feed.pb": ("bronze_binary_feed", "binaryFile"),
    "book.xlsx": ("bronze_binary_book", "binaryFile"),
    "notes.md": (None, None),
    "2024 list.csv": ("bronze_csv_t_2024_list", "csv"),
    "a.b.json": ("bronze_json_a_b", "json"),
    "deep/er/x.json": ("bronze_json_x", "json"),
    "parts.csv/part-0.csv": ("bronze_csv_parts", "csv"),
    "parts.csv/2024.CSV": ("bronze_csv_parts", "csv"),
    "parts.json/part-00000-x.txt": ("bronze_json_parts", "json"),
    "parts.csv/readme.md": (None, None),
    "parts.csv/sub/p3.md": (None, None),
}


def test_routing(spark):
    files = spark.createDataFrame([(p,) for p in ROUTES], "rel_path string")
    assert {r.rel_path: (r.table_name, r.source_format) for r in route_files(files).collect()} == ROUTES


def test_inventory_and_coverage(spark, full):
    names = [r.rel_path for r in list_files(spark, full.raw).orderBy("rel_path").collect()]
    assert "google_transit/stops.txt" in names and "notes.md" in names and len(names) == 15
    assert [r.rel_path for r in coverage(spark, full.raw).collect()] == ["notes.md"]
    files = list_files(spark, full.raw)
    assert uncovered_files(files, spec_table(files).filter("layout <> 'binary'")).count() == 2


def test_two_files_for_one_table_are_refused(spark, place):
    put(place.raw, "a/x.json", {})
    put(place.raw, "b/x.json", {})
    with pytest.raises(ValueError, match="bronze_json_x"):
        build_specs(spark, place.raw)


def test_nothing_to_load(spark, place):
    put(place.raw, "notes.md", "x")
    with pytest.raises(ValueError, match="no supported files"):
        place.load()


def test_ingest_is_incremental(spark, place):
    put(place.raw, "list.csv/one.csv", STATIONS, "latin-1")
    place.load()
    first = place.table("bronze_csv_list")
    assert first.columns == [
        "c_digo", "descripcion", "latitud", "longitud", "provincia", "rescued_data",
        "_ingest_ts", "_source_file_path", "_source_pattern", "_source_format",
    ]
    assert [r.descripcion for r in first.select("descripcion").collect()] == ["Ávila", "Ávila ", "Zero"]
    place.load()
    assert place.table("bronze_csv_list").count() == 3
    put(place.raw, "list.csv/two.csv", STATIONS, "latin-1")
    specs = place.load()
    rows = place.table("bronze_csv_list")
    assert rows.groupBy(F.regexp_extract("_source_file_path", "([^/]+)$", 1)).count().count() == 2
    assert [tuple(r) for r in audit(spark, place.database, specs).collect()] == [("bronze_csv_list", "list.csv", 6)]


def test_single_file_stream_ignores_namesakes(spark, place):
    put(place.raw, "x.csv", "a;b\n1;2\n")
    put(place.raw, "google_transit/x.txt", "a,b\n3,4\n")
    put(place.raw, "odd [1].csv", "a;b\n5;6\n")
    place.load()
    assert [tuple(r)[:2] for r in place.table("bronze_csv_x").collect()] == [("1", "2")]
    assert [tuple(r)[:2] for r in place.table("bronze_google_transit_x").collect()] == [("3", "4")]
    assert [tuple(r)[:2] for r in place.table("bronze_csv_odd_1").collect()] == [("5", "6")]


def test_bad_lines_are_rescued(spark, place):
    put(place.raw, "t.csv", 'a;b\n1;2\n1;2;3\n1\n"x;y";z\n')
    place.load()
    rows = [(r.a, r.b, r.rescued_data) for r in place.table("bronze_csv_t").collect()]
    assert rows == [("1", "2", None), ("1", "2", "1;2;3"), ("1", None, "1"), ("x;y", "z", None)]


def test_later_columns_of_csv_are_rescued(spark, place):
    put(place.raw, "t.csv/1.csv", "a;b\n1;2\n")
    place.load()
    put(place.raw, "t.csv/2.csv", "a;b;c\n3;4;5\n")
    place.load()
    rows = [(r.a, r.b, r.rescued_data) for r in place.table("bronze_csv_t").orderBy("a").collect()]
    assert rows == [("1", "2", None), ("3", "4", "3;4;5")]


def test_documents_gain_columns(spark, place):
    put(place.raw, "n.json/1.json", [{"id": 1, "in": {"a": 1}}, {"id": 2, "in": {"a": 2}}])
    place.load()
    put(place.raw, "n.json/2.json", {"id": 3, "in": {"a": 3, "b": "new"}, "extra": "e"})
    place.load()
    table = place.table("bronze_json_n")
    rows = [(r.id, r["in"].a, r["in"].b, r.extra, r.rescued_data) for r in table.orderBy("id").collect()]
    assert rows == [(1, 1, None, None, None), (2, 2, None, None, None), (3, 3, "new", "e", None)]
    place.load()
    assert place.table("bronze_json_n").count() == 3


def test_declared_feed_keeps_unknown_fields(spark, place):
    put(place.raw, "alerts.json", {**ALERTS, "version": "2"})
    place.load()
    row = place.table("bronze_json_alerts").first()
    assert row.entity[0].id == "a" and row.version == "2" and row.rescued_data is None


def test_feeds_lose_no_field(spark, place):
    update = {"trip": {"tripId": "t", "routeId": "R9"}, "delay": "late", "vehicle": {"bearing": 1.5}, "stopTimeUpdate": []}
    first = {"header": {"timestamp": "1"}, "entity": [{"id": "1", "tripUpdate": update}]}
    second = {"header": {"timestamp": "2"}, "entity": [{"id": "2", "tripUpdate": {"trip": {"tripId": "u"}, "delay": 60}}]}
    put(place.raw, "trip_updates.json/1.json", first)
    put(place.raw, "trip_updates.json/2.json", second)
    place.load()
    one, two = place.table("bronze_json_trip_updates").orderBy("header.timestamp").collect()
    got = one.entity[0].tripUpdate
    assert (got.trip.tripId, got.trip.routeId, got.vehicle.bearing, got.delay) == ("t", "R9", 1.5, None)
    assert json.loads(json.loads(one.rescued_data)["entity"]) == first["entity"]
    assert two.rescued_data is None and two.entity[0].tripUpdate.delay == 60


@pytest.mark.parametrize(
    "text, lost",
    [
        ('{"s": {"a": 1, "b": null}}', False), ('{"s": {"a": 1, "c": 2}}', True), ('{"s": {"a": "x"}}', True),
        ('{"s": {"a": 1.0}}', True), ('{"s": {"a": 1.5}}', True), ('{"s": {"t": [{"u": "y"}, {"u": "z"}]}}', False),
        ('{"s": {"t": [{"u": "y", "v": "w"}]}}', True), ('{"s": {"t": [{"u": ",\\"q\\":null}"}]}}', False), ('{"s": null}', False),
        ('{"s": "text"}', True), ('{"s": {"b": null, "z": null}}', False),
    ],
)
def test_rescue_of_nested_fields(spark, text, lost):
    schema = StructType.fromDDL("s struct<a: bigint, b: string, t: array<struct<u: string>>>")
    row = parse_documents(spark.createDataFrame([(text,)], "value string"), schema).first()
    assert (row["_rescued_data"] is not None) == lost
    if lost:
        kept = json.loads(row["_rescued_data"])["s"]
        assert kept == "text" or json.loads(kept) == json.loads(text)["s"]


def test_columns_follow_each_files_header(spark, place):
    put(place.raw, "list.csv/p1.csv", "a;b\n1;2\n")
    put(place.raw, "list.csv/p2.csv", "b;a\n20;10\n")
    put(place.raw, "list.csv/p3.csv", "b;other\n30;x\n")
    place.load()
    rows = sorted((r.a or "", r.b, r.other, r.rescued_data) for r in place.table("bronze_csv_list").collect())
    assert rows == [("", "30", "x", None), ("1", "2", None, None), ("10", "20", None, None)]
    put(place.raw, "list.csv/p4.csv", "b;a;new\n40;4;z\n41;5\n")
    place.load()
    late = place.table("bronze_csv_list").filter("b >= '40'").orderBy("b").collect()
    assert [(r.a, r.b, r.other, r.rescued_data) for r in late] == [("4", "40", None, '{"new":"z"}'), ("5", "41", None, "41;5")]
    batch = readers.read_delimited(spark, f"{place.raw}/list.csv")
    batch = batch.toDF(*[c.lower() for c in batch.columns])
    assert sorted((r.a or "", r.b or "", r.other or "", r.new or "") for r in batch.collect()) == [
        ("", "30", "x", ""), ("1", "2", "", ""), ("10", "20", "", ""), ("4", "40", "", "z"), ("5", "41", "", ""),
    ]


def test_every_file_is_loaded_or_reported(spark, place):
    for name in ("list.csv/p1.csv", "list.csv/sub/p3.txt", "list.csv/notes.txt", "_hidden.csv", "deep/.part.json", "_gone/x.csv"):
        put(place.raw, name, "a;b\n1;2\n")
    put(place.raw, "deep/x.json", {"a": 1})
    specs = place.load()
    loaded = {r[0] for s in specs for r in place.table(s.table).select("_source_file_path").collect()}
    loaded = {path.split("/raw/")[1] for path in loaded}
    left = [r.rel_path for r in coverage(spark, place.raw).collect()]
    assert loaded == {"list.csv/p1.csv", "deep/x.json"}
    assert left == ["_gone/x.csv", "_hidden.csv", "deep/.part.json", "list.csv/notes.txt", "list.csv/sub/p3.txt"]


def test_a_rerun_reads_new_files_only(spark, place, monkeypatch):
    """The first file is gone at the second run: nothing of the history is needed, and the new header goes by name."""
    from trackline.streaming import ingest as module

    asked = []
    real = module.file_headers
    monkeypatch.setattr(module, "file_headers", lambda s, paths, *a, **k: asked.append(sorted(paths)) or real(s, paths, *a, **k))
    put(place.raw, "list.csv/p1.csv", "a;b\n1;2\n")
    put(place.raw, "list.csv/p2.csv", "a;b\n3;4\n")
    place.load()
    os.remove(f"{place.raw}/list.csv/p1.csv")
    put(place.raw, "list.csv/p3.csv", "b;a\n6;5\n")
    place.load()
    assert [[p.rsplit("/", 1)[1] for p in paths] for paths in asked] == [["p1.csv", "p2.csv"], ["p3.csv"]]
    assert sorted((r.a, r.b) for r in place.table("bronze_csv_list").collect()) == [("1", "2"), ("3", "4"), ("5", "6")]
    place.load()
    assert len(asked) == 2


def test_headers_of_later_batches(spark, place):
    """One file per batch: a header that first appears in mid-run is mapped by name; one longer than the table keeps its lines too."""
    for i, text in enumerate(["a;b\n1;2\n", "b;a\n4;3\n", "b;c;a\n6;x;5\n"]):
        path = put(place.raw, f"list.csv/p{i}.csv", text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    place.load(max_files=1)
    rows = sorted((r.a, r.b, r.rescued_data) for r in place.table("bronze_csv_list").collect())
    assert rows == [("1", "2", None), ("3", "4", None), ("5", "6", "6;x;5")]


def test_a_repeated_batch_replaces_itself(spark, place):
    put(place.raw, "n.json/1.json", [{"id": 1}, {"id": 2}])
    spec = place.load()[0]
    path = f"file:{place.raw}/n.json/1.json"
    for _ in range(2):
        write_batch(spark, f"{place.database}.{spec.table}", batch_rows(spark, place.state, spec, [path]), 0)
        assert sorted(r.id for r in place.table("bronze_json_n").collect()) == [1, 2]
    write_batch(spark, f"{place.database}.{spec.table}", batch_rows(spark, place.state, spec, [path]), 1)
    assert place.table("bronze_json_n").count() == 4


CLEAN = [
    '{"id": 1, "x": 1.5, "tags": ["a"], "in": {"a b": true, "n": null}, "none": null}',
    '[{"id": 2, "x": 3, "tags": []}, {"id": null, "in": {}}, {}]', '{"x": 123456789012345678.25, "in": {"n": {"deep": [1]}}}',
]


def test_documents_that_fit_are_read_alike_with_and_without_search(spark):
    objects = parse_objects(spark.createDataFrame([(t,) for t in CLEAN], "value string"))
    seen = seen_schema(objects)
    schema = inferred(seen)
    assert schema.simpleString() == "struct<id:bigint,in:struct<a b:boolean,n:struct<deep:array<bigint>>>,none:string,tags:array<string>,x:double>"
    assert covers(schema, seen)
    quick, careful = (sorted(map(str, read_objects(objects, schema, clean).collect())) for clean in (True, False))
    assert quick == careful and len(quick) == 5 and all("rescued_data=None" in r for r in quick)


@pytest.mark.parametrize(
    "kind, text, fits",
    [
        ("bigint", "1", True), ("bigint", "1.0", False), ("bigint", '"1"', False), ("double", "1", True), ("double", "1.25", True),
        ("double", '"1.25"', False), ("boolean", "true", True), ("boolean", '"true"', False), ("string", "1", True),
        ("string", '{"a":1}', True), ("array<bigint>", "[1,2]", True), ("array<bigint>", "[1,null]", True), ("array<bigint>", '[1,"2"]', False),
        ("array<bigint>", "1", False), ("struct<a:bigint>", '{"a":1}', True), ("struct<a:bigint>", '{"a":1,"b":null}', True),
        ("struct<a:bigint>", '{"a":1,"b":2}', False), ("struct<a:bigint>", "[1]", False), ("bigint", "null", True),
    ],
)
def test_what_fits_a_type(spark, kind, text, fits):
    """A value is rescued where it does not fit, and is then no value of the field; what the merged type covers always fits."""
    schema = StructType.fromDDL(f"f {kind}")
    objects = parse_objects(spark.createDataFrame([(f'{{"f": {text}}}',)], "value string"))
    row = read_objects(objects, schema).first()
    assert (row["_rescued_data"] is None) == fits
    assert not covers(schema, seen_schema(objects)) or fits
    if not fits and "<" not in kind:
        assert row.f is None


def test_twice_the_same_key_is_kept_as_text(spark):
    row = parse_documents(spark.createDataFrame([('{"a": 1, "a": 2}',)], "value string"), StructType.fromDDL("a bigint")).first()
    assert (row.a, row["_rescued_data"]) == (None, '{"a": 1, "a": 2}')


def test_names_with_a_catalog(spark, place):
    put(place.raw, "x.csv", "a;b\n1;2\n")
    place.database = f"spark_catalog.{place.database}"
    place.load()
    assert place.table("bronze_csv_x").count() == 1


def test_quoted_line_breaks(spark, folder):
    path = put(folder, "q.csv", 'a;b\n1;"x\ny"\n2;z\n')
    assert [tuple(r) for r in readers.read_delimited(spark, path, multi_line=True).collect()] == [("1", "x\ny"), ("2", "z")]
    assert [tuple(r) for r in readers.read_csv_flexible(spark, path, multi_line=True).collect()] == [("1", "x\ny"), ("2", "z")]


def test_curated_bundle_equals_bronze(spark, full, folder):
    full.load()
    target = f"{full.database}_curated"
    write_curated(spark, full.database, target, f"{folder}/curated")
    bronze, curated = tables.load_tables(spark, full.database), tables.load_tables(spark, target)
    for key, rows in bronze.items():
        columns = [c for c in rows.columns if not c.startswith("_")]
        assert rows.count() == curated[key].count(), key
        assert rows.select(columns).exceptAll(curated[key].select(columns)).count() == 0, key
    assert curated["train_info"].count() == 1 and curated["gtfs_stops"].count() == 2


def test_only_changed_dates_are_rewritten(spark, place, folder):
    put(place.raw, "trip_updates.json/1.json", FEED)
    place.load()
    target = f"{place.database}_curated"
    write_curated(spark, place.database, target, f"{folder}/curated")
    files = lambda: {(str(r[0]), r[1]) for r in spark.table(f"{target}.trip_updates_rt").select("service_date", "_metadata.file_path").collect()}
    before = files()
    put(place.raw, "trip_updates.json/2.json", {**FEED, "header": {"timestamp": "1804103200"}})
    place.load()
    write_curated(spark, place.database, target, f"{folder}/curated")
    spark.catalog.refreshTable(f"{target}.trip_updates_rt")
    after = files()
    assert before < after and {d for d, _ in after - before} == {"2027-03-03"}
    assert spark.table(f"{target}.trip_updates_rt").count() == 4


def test_only_new_files_reach_the_curated_layer(spark, full, folder):
    """A second run without news touches nothing; a delivery adds its files and leaves all others as they are."""
    full.load()
    target = f"{full.database}_curated"
    write_curated(spark, full.database, target, f"{folder}/curated")

    def files():
        return {str(p) for p in Path(f"{folder}/curated").rglob("*.parquet")}

    before = files()
    write_curated(spark, full.database, target, f"{folder}/curated")
    assert files() == before
    put(full.raw, "vehicle_positions_2.json", VEHICLES)
    put(full.raw, "alerts.json", {"entity": []})  # the same name at another time: a new version of the file
    full.load()
    write_curated(spark, full.database, target, f"{folder}/curated")
    added = {p.split("/curated/")[1].split("/")[0] for p in files() - before}
    assert before <= files() and added <= {"alerts_rt"}
    tables_ = tables.load_tables(spark, target)
    assert tables_["vehicles"].count() == 1 and tables_["trip_updates"].count() == 4


def test_a_better_source_starts_the_table_anew(spark, place, folder):
    target = f"{place.database}_curated"
    put(place.raw, "fomento_transit/routes.txt", "route_id,route_short_name,route_type\nF1,f,2\n")
    place.load()
    write_curated(spark, place.database, target, f"{folder}/curated")
    assert [r.route_id for r in tables.load_tables(spark, target)["gtfs_routes"].collect()] == ["F1"]
    put(place.raw, "google_transit/routes.txt", "route_id,route_short_name,route_type\nG1,g,2\nG2,g,2\n")
    place.load()
    for _ in range(2):
        write_curated(spark, place.database, target, f"{folder}/curated")
        assert sorted(r.route_id for r in tables.load_tables(spark, target)["gtfs_routes"].collect()) == ["G1", "G2"]


def test_rescue_of_documents(spark):
    schema = StructType([StructField("id", LongType()), StructField("tags", ArrayType(StringType()))])
    texts = ['{"id": 1, "tags": ["a"]}', '[{"id": "x", "more": {"k": 1}}, {"id": 3}]', "not json", "[1", "[]"]
    rows = parse_documents(spark.createDataFrame([(t,) for t in texts], "value string"), schema).collect()
    assert [(r.id, r.tags, r["_rescued_data"]) for r in rows] == [
        (1, ["a"], None),
        (None, None, '{"id":"x","more":"{\\"k\\":1}"}'),
        (3, None, None),
        (None, None, "not json"),
        (None, None, "[1"),
    ]


def test_broken_documents_do_not_stop_the_load(spark, place):
    put(place.raw, "b.json/1.json", '{"id": ')
    put(place.raw, "b.json/2.json", {"id": 1})
    put(place.raw, "only.json", "no json at all")
    place.load()
    rows = [(r.id, r.rescued_data) for r in place.table("bronze_json_b").orderBy("id").collect()]
    assert rows == [(None, '{"id": '), (1, None)]
    assert place.table("bronze_json_only").first().rescued_data == "no json at all"


def test_type_merging_keeps_stored_types():
    old = StructType([StructField("a", LongType()), StructField("s", ArrayType(StructType([StructField("x", LongType())])))])
    new = StructType([StructField("s", ArrayType(StructType([StructField("y", StringType())]))), StructField("a", StringType())])
    assert merge_types(old, new).simpleString() == "struct<a:bigint,s:array<struct<x:bigint,y:string>>>"


def test_binary_is_stored_as_is(spark, full):
    full.load()
    row = full.table("bronze_binary_feed").first()
    assert bytes(row.content) == b"\x00\x01\xff" and row.length == 3 and row["_source_format"] == "binaryFile"


def test_bronze_to_reports(spark, full, folder):
    full.load()
    data = tables.load_tables(spark, full.database)
    # Decimal commas are no numbers on this path, which leaves the station at 0, 0.
    assert [tuple(r) for r in data["stations"].collect()] == [("2", "Zero", 0.0, 0.0, "X", "estaciones")]
    assert [(r.feed, r.trip_id, r.delay_seconds) for r in data["trip_updates"].orderBy("feed", "trip_id").collect()] == [
        ("Cercanias", "T1", 120.0), ("Cercanias", "T2", 0.0), ("LD", "T1", 120.0), ("LD", "T2", 0.0),
    ]
    assert data["vehicles"].count() == 1 and data["alerts"].first().route_count == 2
    assert data["gtfs_trips"].filter("direction_id = 1").count() == 1
    written = write_curated(spark, full.database, f"{full.database}_curated", f"{folder}/curated")
    curated = tables.load_tables(spark, f"{full.database}_curated")
    assert curated["trip_updates"].count() == 4 and "trip_updates_rt" in written
    assert "service_date" in spark.table(f"{full.database}_curated.trip_updates_rt").columns
    inventory = tables.table_inventory(spark, full.database)
    assert inventory.columns == schemas.TABLE_INVENTORY.fieldNames()
    row = inventory.filter("table_name = 'bronze_google_transit_trips'").first()
    assert (row.layer, row.domain, row.data_source_format) == ("Bronze", "google", "PARQUET")


def test_load_files(spark, full):
    data = load_files(spark, full.raw)
    assert [tuple(r) for r in data["stations"].orderBy("source").collect()] == [
        ("1", "Ávila", 40.5, -4.7, "Ávila", "AV/LD"),
        ("1", "Ávila", 40.5, -4.7, "Ávila", "FEVE"),
        ("1", "Ávila", 40.5, -4.7, "Ávila", "General"),
    ]
    assert [r.delay_seconds for r in data["trip_updates"].orderBy("feed", "entity_id").collect()] == [120.0, 60.0, 120.0, 60.0]
    assert data["vehicles"].count() == 1
    assert tuple(data["alerts"].first()) == ("a", 2, "Obras")
    assert tuple(data["incidents"].first()) == ("AVISO", "red", "p", "l")
    assert data["gtfs_stops"].filter("stop_lat is null").count() == 1
    assert data["train_info"].count() == 0 and data["avld"].count() == 0
    for page in (station_pages, operations_pages, filter_choices):
        for df in page(data).values():
            df.write.format("noop").mode("overwrite").save()


def test_load_files_of_an_empty_folder(spark, folder):
    data = load_files(spark, folder)
    assert {k: v.schema for k, v in data.items()} == schemas.BUNDLE
    assert all(v.count() == 0 for v in data.values())


def test_reader_fallbacks(spark, folder):
    path = put(folder, "mixed.csv", "a;b\n1;2\n1;2;3\n4\n")
    assert readers.sniff_separator(spark, path, ",") == ";"
    rows = readers.read_csv_flexible(spark, path, sep=",")
    assert [tuple(r) for r in rows.collect()] == [("1", "2"), ("4", None)]
    assert rows.count() == 2 and [r.b for r in rows.select("b").collect()] == ["2", None]
    assert readers.read_delimited(spark, path, skip_long=False).count() == 3
    missing = readers.read_if_exists(spark, f"{folder}/none.csv", lambda p: None, schemas.ROUTES)
    assert missing.schema == schemas.ROUTES and missing.count() == 0


def test_array_documents_only(spark, folder):
    assert readers.read_array_document(spark, put(folder, "o.json", {"link": "x"}), schemas.INCIDENTS).count() == 0
    assert readers.read_array_document(spark, put(folder, "a.json", INCIDENTS * 2), schemas.INCIDENTS).count() == 2


def test_queries_per_dataset(spark):
    data = tables.load_queries(spark, {"trip_updates": "SELECT 'x' AS tripid, '2' AS delay_min", "alerts": "  "})
    assert data["trip_updates"].first().delay_seconds == 120.0
    assert data["alerts"].count() == 0 and set(data) == set(schemas.BUNDLE)


def test_first_available(spark):
    spark.range(1).createOrReplaceTempView("second_choice")
    assert tables.first_available(spark, ["no_such_table", "second_choice"], schemas.ROUTES).columns == ["id"]
    assert tables.first_available(spark, ["no_such_table"], schemas.ROUTES).schema == schemas.ROUTES


def test_broken_files_are_left_out_and_told(spark, full):
    """Of a source in parts only the broken files go; a source with nothing else is a typed empty dataset."""
    put(full.raw, "listado_completo_av_ld_md.csv", b"PK\x03\x04\x00\x00;;\n\x00\x01;2\n")
    put(full.raw, "google_transit/routes.txt", b"\x00\x01\x02\n\x00\n")
    put(full.raw, "vehicle_positions.json", '{"entity": [')
    os.remove(f"{full.raw}/alerts.json")
    put(full.raw, "alerts.json/1.json", ALERTS)
    put(full.raw, "alerts.json/2.json", json.dumps(ALERTS)[:-3])
    os.remove(f"{full.raw}/informacion_trenes.csv")
    os.remove(f"{full.raw}/listado-de-estaciones-con-servicio-de-atendo.csv")
    data = load_files(spark, full.raw)
    assert data["alerts"].count() == 1 and data["vehicles"].count() == 0 and data["gtfs_routes"].count() == 0
    assert {r.source for r in data["stations"].collect()} == {"General", "FEVE"}
    assert data["atendo"].schema == schemas.ACCESSIBILITY and data["gtfs_routes"].schema == schemas.ROUTES
    told = {(r.dataset, r.source, (r.file or "").rsplit("/", 1)[-1], r.reason) for r in rejected_files(spark, full.raw).collect()}
    assert told == {
        ("stations", "listado_completo_av_ld_md.csv", "listado_completo_av_ld_md.csv", "no text"),
        ("stations", "listado-estaciones-cercanias-madrid.csv", "", "missing"),
        ("gtfs_routes", "google_transit/routes.txt", "routes.txt", "no text"), ("alerts", "alerts.json", "2.json", "no JSON"),
        ("vehicles", "vehicle_positions.json", "vehicle_positions.json", "no JSON"),
        ("atendo", "listado-de-estaciones-con-servicio-de-atendo.csv", "", "missing"),
    }


def test_encodings_side_by_side_are_read_once(spark, folder):
    """UTF-8 and Latin-1 files with headers of their own, and one that is no text."""
    put(folder, "l.csv/1.csv", "CÓDIGO;NOMBRE\n1;Ávila ñ €\n", "utf-8")
    put(folder, "l.csv/2.csv", "NOMBRE;CÓDIGO\nÁvila ñ;2\n", "latin-1")
    put(folder, "l.csv/3.csv", "NOMBRE;CÓDIGO\nÚbeda;3\n", "utf-8-sig")
    put(folder, "l.csv/4.csv", b"\x00\x00\n\x00")
    rows = readers.read_csv_flexible(spark, f"{folder}/l.csv")
    assert sorted((r["CÓDIGO"], r["NOMBRE"]) for r in rows.collect()) == [("1", "Ávila ñ €"), ("2", "Ávila ñ"), ("3", "Úbeda")]
    # Flags and headers, a row per file, are kept; the rows are read once.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_more_different_headers_than_columns(place, monkeypatch):
    monkeypatch.setattr("trackline.streaming.evolution.MAX_COLUMNS", 3)
    for i in range(1_001):
        put(place.raw, f"trips.csv/{i:04d}.csv", f"id;n{i}\n{i};v{i}\n")
    place.load()
    rows = place.table("bronze_csv_trips").select("id", "n0", "n1", "rescued_data").collect()
    assert sorted((int(r.id), r.n0, r.n1, r.rescued_data) for r in rows) == [
        (i, "v0" if i == 0 else None, "v1" if i == 1 else None, f'{{"n{i}":"v{i}"}}' if i > 1 else None) for i in range(1_001)
    ]


def test_headers_have_the_names_of_the_csv_reader(spark, folder):
    headers = ["a;A;b", "a;;c;", '"x;y";z', '"q""r";s', "\n\na;b", " a ; b", '"a"b;c', 'a"b;c"d;e', '"open;b', ";", '"";b', "ñ;é", "\ufeffm;n"]
    for i, header in enumerate(headers):
        put(folder, f"{i:02d}.csv", f"{header}\n1;2;3\n")
    options = readers.CSV_OPTIONS
    found = {r.file[-6:]: list(r.header) for r in readers.file_headers(spark, folder, options).collect()}
    assert found == {f"{i:02d}.csv": spark.read.options(**options).csv(f"{folder}/{i:02d}.csv").columns for i in range(len(headers))}


def test_many_paths_are_listed_by_few_tasks(spark, folder):
    paths = [put(folder, f"{i:03d}.json", "{}") for i in range(200)]
    spark.sparkContext.setJobGroup(folder, "listing")
    assert spark.read.text(paths, wholetext=True).count() == 200
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(folder) for s in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= 64


def test_documents_of_the_workload_are_full_and_bounded(spark, sf_dir, folder, monkeypatch):
    from workload import ingesting, views

    monkeypatch.setattr(ingesting, "DOCUMENT_ROWS", 5)
    feed = views.trip_feed(spark, sf_dir, "A").union(views.trip_feed(spark, sf_dir, "A")).where("size(entity) = 0")
    ingesting.write_documents(ingesting.numbered(feed.coalesce(1)), "key", f"{folder}/feed.json")
    sizes = [len(json.loads(p.read_text())) for p in Path(folder).glob("feed.json/part-*")]
    assert max(sizes) <= 5 and len(sizes) == -(-sum(sizes) // 5)


def test_no_task_gathers_the_broken_sources(spark, sf_dir, folder):
    """Pages go to the file that is no text in as many parts as they are read in, and are told of once."""
    from workload import ingesting

    for table in Path(sf_dir).glob("*.parquet"):
        if table.name != "pages.parquet":
            os.symlink(table, f"{folder}/{table.name}")
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(4).write.parquet(f"{folder}/pages.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        told = [tuple(r) for r in ingesting.broken_sources(spark, folder).collect() if r.kind == "reject"]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(Path(ingesting._RUNS[-1].raw.removeprefix("file:")).glob("estaciones.csv/part-*"))) == 4
    assert sorted(told) == [
        ("reject", "alerts", "no JSON"), ("reject", "atendo", "missing"), ("reject", "stations", "no text"), ("reject", "trip_updates", "no JSON"),
    ]


def test_a_listing_has_few_tasks_and_is_made_once(spark, folder, monkeypatch):
    from trackline.sources import inventory
    from trackline.streaming import ingest as module

    for i in range(400):
        put(folder, f"raw/sub/{i:03d}.md", "x")
    put(folder, "raw/sub/_hidden.md", "x")
    files = list_files(spark, f"{folder}/raw")
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    files.createOrReplaceTempView("listed_files")
    assert spark.table("listed_files").count() == 400
    asked, real = [], inventory.list_files
    for place in (inventory, module):
        monkeypatch.setattr(place, "list_files", lambda s, base: asked.append(base) or real(s, base))
    left = coverage(spark, f"{folder}/raw").collect()
    assert len(left) == 401 and len(asked) == 1


def test_files_with_headers_of_their_own_are_read_as_lines(spark, place):
    """Spark's reader compares all fields with each other for every file; the scan has three, however many the table has."""
    for i in range(300):
        put(place.raw, f"list.csv/{i:03d}.csv", f"id;n{i}\n{i};v\n")
    spec = build_specs(spark, place.raw)[0]
    paths = [f"file:{place.raw}/list.csv/{i:03d}.csv" for i in range(300)]
    rows = batch_rows(spark, place.state, spec, paths)
    assert len(rows.columns) == 306 and rows.filter("n7 = 'v'").count() == 1
    scans = [s for s in str(rows._jdf.queryExecution().executedPlan()).split("ReadSchema: ")[1:] if "_one" in s]
    assert len(scans) == 1 and scans[0].split(">")[0].count(":") == 3
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_lines_are_parsed_as_the_csv_reader_does(spark, folder):
    lines = ["1;2;3", '"x;y";z;w', 'a "q" b;2', '"q""r";2;3;4', '"open;1;2', ";;", "\x01;b;c", "a\x01b;c;d", "\x01\x01;b;c", " a ; b;", "ñ;é;ü", '"";"";x', "  "]
    put(folder, "l.csv", "a;b;c\n" + "\n".join(lines) + "\n", "latin-1")
    put(folder, "m.csv", "\n\nh\r\n1;2;3\r\n\n4\r5;6;7", "latin-1")
    kinds = StructType([StructField(n, StringType()) for n in ("f0", "f1", "f2", "_bad")])
    options = readers.CSV_OPTIONS
    given = spark.read.options(**options, columnNameOfCorruptRecord="_bad").schema(kinds).csv([f"{folder}/l.csv", f"{folder}/m.csv"])
    read = readers.data_lines(spark, [f"{folder}/l.csv", f"{folder}/m.csv"], options)
    parts = {k: options[k] for k in ("sep", "quote", "escape")} | {"columnNameOfCorruptRecord": "_bad"}
    parsed = read.select(F.from_csv("value", "f0 string, f1 string, f2 string, _bad string", parts).alias("f")).select("f.*")
    key = lambda r: [str(v) for v in r]
    assert sorted(parsed.collect(), key=key) == sorted(given.collect(), key=key) and given.count() == 15
    assert {r["_path"][-5:] for r in read.collect()} == {"l.csv", "m.csv"}


def test_a_file_per_text(spark, folder):
    from workload import ingesting

    texts = spark.createDataFrame([("a",), ("ñ",), ("a",), (None,)], "value string")
    ingesting.write_single(texts, f"file:{folder}/list.csv")
    found = sorted(Path(folder).glob("list.csv/part-*"))
    assert sorted(p.read_text("utf-8") for p in found) == ["\n", "a\n", "a\n", "ñ\n"]
    assert [r.value for r in spark.read.text(f"{folder}/list.csv").where("value = 'a'").collect()] == ["a", "a"]
    assert sorted(p.name for p in Path(folder).glob("list.csv/*") if p not in found and p.suffix != ".crc") == ["_SUCCESS"]


def test_a_batch_leaves_no_copy_of_its_objects(spark, place):
    from trackline.session import checkpointed

    checkpointed(spark.range(1))
    kept = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(kept.glob("rdd-*"))
    for i in range(3):
        put(place.raw, f"n.json/{i}.json", [{"id": i}, {"id": None}])
    place.load(max_files=1)
    assert set(kept.glob("rdd-*")) == before
    assert sorted(r.id for r in place.table("bronze_json_n").where("id IS NOT NULL").collect()) == [0, 1, 2]


def test_compressed_documents_are_loaded_and_leave_no_shuffle_files(spark, sf_dir, place):
    from workload import ingesting, views

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    feed = views.trip_feed(spark, sf_dir, "A")
    ingesting.write_documents(ingesting.numbered(feed), "key", f"{place.raw}/trip_updates.json", compression="gzip")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    names = [p.name for p in Path(place.raw).glob("trip_updates.json/part-*")]
    assert names and all(n.endswith(".gz") for n in names)
    place.load()
    given = feed.select("header.timestamp", F.to_json("entity.id"))
    found = place.table("bronze_json_trip_updates").select("header.timestamp", F.to_json("entity.id"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, given.collect()), key=str)
