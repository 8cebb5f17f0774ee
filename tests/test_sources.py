"""Readers, decoders, exports and archives against hand-made files and published examples."""

from __future__ import annotations

import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from contrail.functions import codes, cpr
from contrail.sources import files, lines, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("c")).first()["c"]


APRS = "NAVFE4522>OGNAVI,qAS,NAVITER2:/014343h3842.32N/09427.59W'090/045/A=001342 !W25! id1C40FE4522 +120fpm -0.5rot"


def test_aprs_position(spark):
    p = one(spark, lines.position(F.col("raw")), raw=APRS)
    assert (p.source, p.receiver, p.hhmmss, p.track, p.speed_kt, p.altitude_ft, p.climb_fpm, p.turn_rot) == ("NAVFE4522", "NAVITER2", "014343", 90, 45, 1342, 120, -0.5)
    assert p.lat == pytest.approx(38 + 42.322 / 60, abs=1e-6)
    assert p.lon == pytest.approx(-(94 + 27.595 / 60), abs=1e-6)
    assert p.device.address == 0xFE4522
    assert one(spark, lines.position(F.col("raw")), raw="no position") is None
    assert one(spark, lines.position(F.col("raw")), raw=APRS.replace("A=001342", "A=100001")) is None


@pytest.mark.parametrize(
    ("raw", "address", "kind", "category"),
    [("06DF0A52", 0xDF0A52, "flarm", "glider"), ("1C40FE4522", 0xFE4522, "unknown", "paraglider"), ("18501142BB", 0x1142BB, "unknown", "hang_glider"), ("1FF01142BB", 0x1142BB, "unknown", "paraglider"), ("18201142BB", 0x1142BB, "flarm", "hang_glider"), ("0ADDA5BA", 0xDDA5BA, "flarm", "tow_tug"), ("21A8CBA8", 0xA8CBA8, "icao", "landplane")],
)
def test_device_ids(spark, raw, address, kind, category):
    d = one(spark, codes.device_id(F.col("raw")), raw=raw)
    assert d.address == address
    head = int(raw[:-6], 16)
    assert d.category == codes.OGN_CATEGORIES[(head >> (10 if len(raw) == 10 else 2)) & 15] == category
    number = head >> 4 & 63 if len(raw) == 10 else head & 3
    assert d.address_type == dict(enumerate(codes.ADDRESS_TYPES)).get(number, "unknown") == kind
    assert one(spark, codes.device_id(F.col("raw")), raw="12345") is None


def test_message_kinds_and_replay(spark):
    raws = ["# aprsc 2.1 22 Dec 2025 21:06:40 GMT GLIDERN4 1.2.3.4:14580", APRS, "RX>APRS,TCPIP*,qAC,X:>220640h v0.3.2 CPU:0.7 RAM:700.2/970.2MB NTP:1.8ms/-3.3ppm +52.1C 10/12Acfts[1h] RF:+54+0.9ppm", "junk"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [r.k for r in df.select(lines.message_kind(F.col("raw")).alias("k")).collect()] == ["server", "position", "status", "unknown"]
    s = one(spark, lines.receiver_status(F.col("raw")), raw=raws[2])
    assert (s.receiver, s.hhmmss, s.cpu_load, s.ram_free_mb, s.ram_total_mb, s.ntp_ms, s.cpu_temperature, s.visible_aircraft, s.rf_ppm) == ("RX", "220640", 0.7, 700.2, 970.2, 1.8, 52.1, 10, 54)
    m = one(spark, lines.server_message(F.col("raw")), raw=raws[0])
    assert (m.software, m.sent, m.server, m.endpoint) == ("aprsc 2.1", dt.datetime(2025, 12, 22, 21, 6, 40), "GLIDERN4", "1.2.3.4:14580")
    got = lines.replay_lines(spark.createDataFrame([(f"2025-12-26T01:43:46.632102Z {APRS}",), ("bad line",)], "value string")).collect()
    assert [(r.received_at, r.raw) for r in got] == [(dt.datetime(2025, 12, 26, 1, 43, 46, 632102), APRS)]


def test_sbs(spark):
    raw = "MSG,3,1,1,A1B2C3,1,2025/01/02,03:04:05.678,2025/01/02,03:04:05.678,,35000,,,51.5,-0.25,,,0,0,0,0"
    m = one(spark, lines.sbs(F.col("raw")), raw=raw)
    assert (m.kind, m.address, m.callsign, m.altitude_ft, m.lat, m.lon, m.squawk, m.on_ground) == (3, 0xA1B2C3, None, 35000, 51.5, -0.25, None, False)
    for bad in ("MSG,9,1,1,A1B2C3", "STA,3,1,1,A1B2C3", "MSG,3,1,1,XYZ", "MSG,3"):
        assert one(spark, lines.sbs(F.col("raw")), raw=bad) is None


def test_filters(spark):
    df = spark.createDataFrame([("N1", 47.0, 8.0), ("D2", 50.0, 8.0), ("N3", -10.0, 8.0)], "s string, lat double, lon double")
    keep = lambda text: [r.s for r in df.filter(lines.filter_column(text, F.col("lat"), F.col("lon"), F.col("s"))).collect()]
    assert keep("r/47/8/100") == ["N1"]
    assert keep("a/51/7/46/9") == ["N1", "D2"]
    assert keep("p/N") == ["N1", "N3"]
    assert keep("b/D2 b/N3") == ["D2", "N3"]
    assert keep("-p/N") == ["D2"]
    assert keep("") == ["N1", "D2", "N3"]
    assert keep("t/p x/unknown") == []
    more = {"own": (47.0, 8.0), "t": F.lower(F.substring("s", 1, 1)), "u": F.col("s")}
    wide = lambda text: [r.s for r in df.filter(lines.filter_column(text, F.col("lat"), F.col("lon"), F.col("s"), **more)).collect()]
    assert wide("m/400") == ["N1", "D2"]
    assert wide("t/nx") == ["N1", "N3"]
    assert wide("u/D2/N1 -t/d") == ["N1"]


def test_squitter_and_compact_positions(spark):
    """Frames that the literature on Mode S uses as examples."""
    even, odd, ident = "8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6", "8D4840D6202CC371C32CE0576098"
    a, b, c = (one(spark, cpr.squitter(F.col("f")), f=f) for f in (even, odd, ident))
    assert (a.address, a.altitude_ft, a.odd, b.odd) == (0x40621D, 38000, 0, 1)
    assert (c.address, c.callsign) == (0x4840D6, "KLM1023")
    fields = {"la0": a.cpr_lat, "lo0": a.cpr_lon, "la1": b.cpr_lat, "lo1": b.cpr_lon, "odd": False}
    p = one(spark, cpr.global_position(*map(F.col, fields)), **fields)
    assert p.lat == pytest.approx(52.2572, abs=1e-4)
    assert p.lon == pytest.approx(3.91937, abs=1e-4)
    assert one(spark, cpr.squitter(F.col("f")), f="8D") is None


def test_registrations(spark, tmp_path):
    names = ["N-NUMBER", "SERIAL NUMBER", "MFR MDL CODE", "YEAR MFR", "NAME", "CITY", "STATE", "ZIP CODE", "LAST ACTION DATE", "CERT ISSUE DATE", "FRACT OWNER", "EXPIRATION DATE", "MODE S CODE HEX"]
    rows = [["152AS", "3545   ", "1660225", "1980", "A SOARING CLUB  ", "BALLSTON SPA ", "NY", "12020", "20230222", "20230222", " ", "20300228", "A0D1AE   "], ["1", "", "0", "0000", "", "", "", "", "", "2023", "Y", "", ""]]
    path = tmp_path / "reg.csv"
    path.write_text("\n".join(",".join(r) for r in [names, *rows]))
    a, b = files.registrations(spark, str(path)).collect()
    assert (a.registration, a.serial_number, a.year, a.name, a.address, a.expires, a.issued) == ("N152AS", "3545", 1980, "A SOARING CLUB", 0xA0D1AE, dt.date(2030, 2, 28), dt.date(2023, 2, 22))
    assert (b.registration, b.year, b.name, b.address, b.issued, b.fractional) == ("N1", None, None, None, None, True)


def test_fixed_width(spark):
    df = spark.createDataFrame([("0020901AAR AIRLIFT     UH-60A  "[:31],)], "value string")
    r = files.fixed_width(df, {"code": (1, 7), "maker": (8, 23), "model": (24, 31), "none": (30, 31)}).first()
    assert (r.code, r.maker, r.model, r.none) == ("0020901", "AAR AIRLIFT", "UH-60A", None)


def test_airports_and_runways(spark, tmp_path):
    head = [c.split()[0] for c in files.AIRPORTS.split(", ")]
    row = {"id": "1", "ident": "LSZB", "type": "medium_airport", "name": '"Bern, ""Belp"""', "latitude_deg": "46.9141", "longitude_deg": "7.497", "elevation_ft": "1674", "scheduled_service": "yes"}
    (tmp_path / "a.csv").write_text(",".join(head) + "\n" + ",".join(row.get(c, "") for c in head))
    a = files.airports(spark, str(tmp_path / "a.csv")).first()
    assert (a.ident, a.name, float(a.latitude_deg), a.scheduled_service, a.iata_code) == ("LSZB", 'Bern, "Belp"', 46.9141, True, None)
    head = [c.split()[0] for c in files.RUNWAYS.split(", ")]
    row = {"id": "9", "airport_ref": "1", "lighted": "1", "closed": "0", "le_ident": "14", "le_latitude_deg": "46.9", "le_longitude_deg": "7.4", "le_heading_degt": "141.5", "he_ident": "32"}
    (tmp_path / "r.csv").write_text(",".join(head) + "\n" + ",".join(row.get(c, "") for c in head))
    r = files.runways(spark, str(tmp_path / "r.csv"))
    assert (r.first().lighted, r.first().closed) == (True, False)
    assert [(e.id, e.end, e.ident, e.heading) for e in files.runway_end_rows(r).collect()] == [(9, "le", "14", 141.5)]


def test_receivers_catalogue_and_devices(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"receivers": [{"callsign": "A", "links": [{"rel": "home", "href": "x"}], "photos": ["p", "q"]}, {"callsign": "B"}]}))
    got = files.receivers(spark, str(tmp_path / "r.json"))
    assert {k: v.count() for k, v in got.items()} == {"receivers": 2, "links": 1, "photos": 2}
    (tmp_path / "c.json").write_text('{"icao":"a0d1ae","reg":"N1","icaotype":"C172","short_type":"L1P","year":"1980","mil":false}\n{"icao":"zz"}')
    r = files.adsb_catalogue(spark, str(tmp_path / "c.json")).collect()
    assert [(x.address, x.category, x.engines, x.engine_kind, x.year) for x in r] == [(0xA0D1AE, "L", 1, "P", 1980)]
    a = spark.createDataFrame([(1, "best"), (2, "best")], "address long, name string")
    b = spark.createDataFrame([(2, "other"), (3, "other")], "address long, name string")
    assert sorted(map(tuple, files.unified_devices([a, b]).collect())) == [(1, "best"), (2, "best"), (3, "other")]


def test_elevation(spark):
    """A 3 x 3 tile: corners exact, the middle of a square bilinear, a square with a missing corner null; shuffled points keep their rows."""
    grid = [10, 20, 30, 40, 50, 60, 70, 80, -32768]
    tile = spark.createDataFrame([("x/N46E007.hgt", bytearray(struct.pack(">9h", *grid)))], "path string, content binary")
    cells = files.elevation_points(tile, 3)
    assert cells.count() == 8
    at = [(46.999999999, 7.0, 10), (46.5, 7.5, None), (46.75, 7.25, 30), (46.25, 7.25, 60), (46.25, 7.75, None), (10.0, 10.0, None)]
    points = spark.createDataFrame([(k % 6, *at[k % 6][:2]) for k in range(600)], "k long, lat double, lon double").repartition(7)
    got = files.with_elevation(points, cells, 3).select("k", "elevation_m").collect()
    assert len(got) == 600
    for r in got:
        want = at[r.k][2]
        assert r.elevation_m == want or (r.k == 0 and r.elevation_m in (9, 10)), r


def _fixes(spark):
    t = dt.datetime(2025, 7, 4, 12, 0, 5)
    rows = [(1, t + dt.timedelta(seconds=9), 2, -33.5, 151.25, None), (1, t, 1, 47.123456, -8.5, 1000), (2, t, 3, 0.0, 0.0, -50)]
    return spark.createDataFrame(rows, "flight_id long, received_at timestamp, fix_id long, lat double, lon double, alt_ft int")


def test_igc(spark):
    texts = {r.flight_id: r.text.split("\r\n") for r in sinks.igc(_fixes(spark), "flight_id").collect()}
    assert texts[1][0].startswith("AXXX")
    assert "HFDTE040725" in texts[1]
    assert "I00" in texts[1]
    b = [x for x in texts[1] if x.startswith("B")]
    assert b == ["B1200054707407N00830000WA0030500305", "B1200143330000S15115000EV0000000000"]
    assert [x for x in texts[2] if x.startswith("B")] == ["B1200050000000N00000000EA0000000000"]
    assert texts[1][-1] == ""


def test_kml_geojson_and_subjects(spark):
    from xml.etree import ElementTree

    named = _fixes(spark).withColumn("flight_id", F.concat(F.lit("<A & B>"), "flight_id"))
    for r in sinks.kml(named, "flight_id").collect():
        doc = ElementTree.fromstring(r.text.encode())
        names = [e.text for e in doc.iter("{http://www.opengis.net/kml/2.2}name")]
        assert r.flight_id in names
        assert {"Takeoff", "Landing"} <= set(names)
    cell = spark.createDataFrame([(0.5, 0.5, 3, 0, 7200)], "lat double, lon double, n_fixes long, first_seen long, last_seen long")
    from contrail.functions.cells import cell_id

    f = json.loads(sinks.geojson(cell.withColumn("cell", cell_id(F.col("lat"), F.col("lon"), 4))).first().feature)
    ring = f["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] == [0.0, 0.0]
    assert f["properties"]["hours"] == 2.0
    topics = sinks.subjects(_fixes(spark).withColumn("aircraft_id", F.lit(5)), "live").collect()
    assert {r.topic for r in topics} == {"live.fix.5", "live.area.47.-9", "live.area.-34.151", "live.area.0.0"}


def test_archive(spark, tmp_path):
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t timestamp")
    left = sinks.archive(df, "t", str(tmp_path / "a"), F.lit("2025-01-05").cast("date"))
    assert {r.id for r in left.collect()} == {i for i, t in rows if t >= dt.datetime(2025, 1, 5)}
    back = sinks.from_archive(spark, str(tmp_path / "a"), "id long, t timestamp, day date")
    assert {r.id for r in back.collect()} == {i for i, t in rows if t < dt.datetime(2025, 1, 5)}
    sinks.dump(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 30
    sinks.daily_text(df.select("t", F.col("id").cast("string").alias("raw")), "t", "raw", str(tmp_path / "raw"))
    days = {r.day: r.n for r in spark.read.text(str(tmp_path / "raw")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert sum(days.values()) == 30
    assert days["2025-01-01"] == 4


def test_airspace_shapes(spark):
    outer, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    points = [*outer, *hole]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, len(points), 0, len(outer)) + b"".join(struct.pack("<2d", *q) for q in points)
    content = bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body
    df = spark.createDataFrame([("a.shp", bytearray(content))], "path string, content binary")
    got = sorted(files.shapes(df).collect(), key=lambda r: r.ring)
    assert [(r.record, r.ring, r.outer, len(r.points)) for r in got] == [(1, 0, True, 5), (1, 1, False, 4)]
    assert [(q.x, q.y) for q in got[0].points] == outer
    assert one(spark, files.airspace_altitude(F.col("f")), f=-9998) == 18000
    assert one(spark, files.airspace_altitude(F.col("f")), f=2500) == 2500


def test_aircraft_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Code, Description, Wing Type\na320,Airbus A320, Fixed\n,none,Fixed\n")
    assert [tuple(r) for r in files.aircraft_types(spark, str(tmp_path / "t.csv")).collect()] == [("A320", "Airbus A320", "Fixed")]


def test_envelopes(spark):
    from contrail.sources import envelopes

    def varint(n):
        n &= (1 << 64) - 1
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def made(source, micros, data):
        return b"\x08" + varint(source) + b"\x10" + varint(micros) + b"\x1a" + varint(len(data)) + data

    raws = [made(0, 1_700_000_000_123_456, b"abc"), made(1, -1, b"\x00" * 300), made(2, 5, b""), made(7, 5, b"x"), b"\x1a\x7fshort", b"\xff", b"", None]
    df = envelopes.decoded(spark.createDataFrame([(None if r is None else bytearray(r),) for r in raws], "value binary"))
    got = [(r.source, r.us, bytes(r.data)) for r in df.withColumn("us", F.unix_micros("received_at")).collect()]
    assert got == [("ogn", 1_700_000_000_123_456, b"abc"), ("beast", -1, b"\x00" * 300), ("sbs", 5, b""), ("ogn", 0, b"")]
    assert {k: v.count() for k, v in envelopes.routed(df).items()} == {"ogn": 2, "beast": 1, "sbs": 1}


def test_aircraft_models(spark, tmp_path):
    def line(**values):
        out = [" "] * 157
        for name, value in values.items():
            first = files.MODEL_LAYOUT[name][0]
            out[first - 1 : first - 1 + len(value)] = value
        return "".join(out)

    good = line(manufacturer_code="002", model_code="09", series_code="01", manufacturer="AAR AIRLIFT", model="UH-60A", aircraft_type="6", engine_type="3", engines="02", seats="015", weight_class="CLASS 3", cruising_speed="0000")
    (tmp_path / "m.txt").write_text("\n".join([line(manufacturer_code="COD", model="MODEL"), good, "too short", ""]))
    r = files.aircraft_models(spark, str(tmp_path / "m.txt")).collect()
    assert [(x.manufacturer_code, x.model_code, x.series_code, x.manufacturer, x.model, x.engines, x.seats, x.weight_class, x.cruising_speed, x.certificate) for x in r] == [
        ("002", "09", "01", "AAR AIRLIFT", "UH-60A", 2, 15, "CLASS 3", None, None)
    ]


def test_octal_addresses_and_other_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("N-NUMBER,MODE S CODE,OTHER NAMES(1),OTHER NAMES(2),STREET\n152AS,50150656,,B C ,1 Road  \n")
    r = files.registrations(spark, str(tmp_path / "r.csv")).first()
    assert (r.address, r.other_names, r.street, r.kit_model) == (0o50150656, ["B C"], "1 Road", None)
