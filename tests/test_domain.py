"""Literal cases of the domain: aggregates, calendar, itineraries, addresses, sources, streaming, geometry."""

import csv
import gzip
import io
import json
import math
import os
import time
import zipfile
import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.functions import address, calendar, geo, keys, modes, text
from stoplake.operators import extract as extracts
from stoplake.operators import feed as feeds
from stoplake.operators import geometry, itineraries, lines, places, regions, reliability, stations
from stoplake.operators.numbering import numbered
from stoplake.plans import bridge, place_queries, registry
from stoplake.sources import files, gtfs_rt, netex, osm_pbf, sinks, zipped
from stoplake.streaming import ingest, polls

EVENT = "route_id string, direction_id int, stop_id string, service_date string, delay_s int, feed_hour int"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def tier(spark, delays, stop="1"):
    return reliability.rebuild_tier2(reliability.fold_tier1(spark.createDataFrame([("R", 0, stop, "20260629", x, 8) for x in delays], EVENT)))


def test_moments_bins_and_edges(spark):
    t = tier(spark, [-60, 0, 300, 600]).first()
    assert (t.n, t.sum_delay, t.sum_delay_sq, t.min_delay, t.max_delay, t.on_time_count) == (4, 840, 453600, -60, 600, 3)
    d = spark.createDataFrame([(x,) for x in (-60, 0, 300, 301, 10000, -61)], "d int")
    rows = {r.d: (r.b, r.o) for r in d.select("d", reliability.bin_of(F.col("d")).alias("b"), reliability.on_time(F.col("d")).alias("o")).collect()}
    assert rows == {-60: (2, True), 0: (3, True), 300: (7, True), 301: (8, False), 10000: (12, False), -61: (2, False)}


def test_readouts(spark):
    r = reliability.readout(tier(spark, [0] * 10 + [1000] * 10)).first()
    assert (r.n, r.on_time_rate, r.mean_s, r.p50_s, r.p85_s, r.p90_s) == (20, 0.5, 500.0, 0.0, 1530.0, 1620.0)
    assert reliability.readout(tier(spark, [5000, 8000, 12000])).first().p50_s == 3600.0
    empty = reliability.overview(tier(spark, []))
    assert empty.first().p50_s is None and empty.first().keys == 0


def test_indexes_weigh_cells(spark):
    a = tier(spark, [0] * 3)
    b = tier(spark, [600]).withColumn("tod", F.lit("night"))
    assert reliability.on_time_index(a.union(b)).first().on_time_rate == 0.75
    t = reliability.typical_delay_index(tier(spark, [-120] * 10).union(tier(spark, [1800]).withColumn("tod", F.lit("night")))).first()
    assert t.n == 11 and round(t.p50_s, 2) == round((-210 * 10 + 1350) / 11, 2) and round(t.p85_s, 2) == round((-147 * 10 + 1665) / 11, 2)


def test_merge_equals_fold_of_all(spark):
    one_half, other = ([("R", 0, "1", "20260629", x, 8) for x in xs] for xs in ((5, 700, -90), (0, 0, 4000)))
    fold = lambda rows: reliability.fold_tier1(spark.createDataFrame(rows, EVENT))
    merged = fold(one_half).union(fold(other)).groupBy(*reliability.TIER1_KEY).agg(*reliability.merge())
    assert merged.collect() == fold(one_half + other).select(*merged.columns).collect()


def test_years_of_five_digits(spark):
    texts = [one(spark, calendar.utc_date_text(F.lit(s))) for s in (0, 253_402_300_799, 253_402_300_800, 9_000_000 * 86_399)]
    assert texts == ["1970-01-01", "9999-12-31", "10000-01-01", "26610-11-17"]


@pytest.mark.parametrize(
    "ymd, kind",
    [("20260629", "weekday"), ("20260627", "saturday"), ("20260628", "sunday-holiday"), ("20261225", "sunday-holiday"), ("20260815", "sunday-holiday"), ("20260602", "sunday-holiday"), ("20260406", "sunday-holiday"), ("20240401", "sunday-holiday"), ("20260407", "weekday"), ("notadate", None), ("20261301", None), ("20260231", None), ("20260229", None), ("20240229", "weekday")],
)
def test_day_types(spark, ymd, kind):
    assert one(spark, calendar.day_type(F.lit(ymd))) == kind


def test_day_type_reads_a_date_once(spark):
    plan = spark.range(1).select(calendar.day_type(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1  # the rule of Easter names its year some hundred times


def test_calendar_odds(spark):
    assert one(spark, calendar.previous_ymd(F.lit("20260101"))) == "20251231"
    assert one(spark, calendar.local_hour(F.lit(1782023400))) == 8
    assert one(spark, calendar.local_hour(F.lit(None).cast("long"))) == 12
    assert one(spark, calendar.browser_date(F.lit(1782023400))) == "Sun Jun 21 2026 08:30:00 GMT+0200"
    assert one(spark, calendar.days_of_week(F.lit("Monday Sunday"))) == [True, *[False] * 5, True]
    bits = calendar.expand_bits(F.lit("2026-04-21").cast("date"), F.lit("11110011"))
    assert [d.strftime("%m%d") for d in one(spark, bits)] == ["0421", "0422", "0423", "0424", "0427", "0428"]
    assert one(spark, calendar.expand_bits(F.lit("2026-04-21").cast("date"), F.lit(""))) == []


@pytest.mark.parametrize("raw, token", [("../a", "+2E+2E+2Fa"), ("à b", "+C3+A0+20b"), ("", "_"), ("A_b-9", "A_b-9")])
def test_tokens(spark, raw, token):
    assert one(spark, keys.sanitize_token(F.lit(raw))) == token
    if raw:
        assert one(spark, keys.desanitize_token(F.lit(token))) == raw


def test_bad_tokens(spark):
    assert one(spark, keys.desanitize_token(F.lit("+2e"))) is None and one(spark, keys.desanitize_token(F.lit("a b"))) is None
    assert one(spark, keys.local_id(F.lit("FEED:a:b"))) == "a:b"


def test_addresses(spark):
    bucket = lambda s, n, c="Roma": one(spark, address.italian_bucket(*[address.clean(F.lit(x)) for x in (s, n, c)]))
    assert bucket("Via Cavour", "1") == bucket("V. Cavour", "1") == "roma|via cavour|1"
    assert bucket("V.le Trastevere", "12/A").endswith("viale trastevere|12a") and bucket("X", "12 bis").endswith("|12bis")
    assert bucket("X", "1 rosso").endswith("1|rosso") and bucket("X", "12/r").endswith("12|rosso") and bucket("X", "12r").endswith("|12r") and bucket("X", "snc").endswith("|__snc__")
    split = lambda t: tuple(one(spark, address.split_freeform(F.lit(t))))
    assert split("Via Tripoli 20") == ("Via Tripoli", "20") and split("Piazza di Spagna, 31") == ("Piazza di Spagna", "31") and split("Largo di Torre Argentina") == ("Largo di Torre Argentina", None)
    assert address.bucket_for("nowhere") is address.generic_bucket


@pytest.mark.parametrize("raw, slug", [("San Giovanni", "san-giovanni"), ("Conca d'Oro", "conca-d-oro"), ("Niccolò", "niccolo")])
def test_slugs(spark, raw, slug):
    assert one(spark, text.slug(F.lit(raw))) == slug


def plan(*itineraries_):
    return json.dumps({"data": {"plan": {"itineraries": list(itineraries_)}}})


def bus(route, start=0, **more):
    return {"mode": "BUS", "duration": 600.0, "startTime": float(start), "endTime": start + 600e3, "route": {"gtfsId": f"F:{route}"}, "from": {"lat": 41.9, "lon": 12.5, "stop": {"gtfsId": "F:S"}}, **more}


def test_ranking_of_plans(spark):
    p = plan({"legs": [bus("SLOW")]}, {"legs": [bus("FAST")]})
    legs = files.legs_of_plans(spark.createDataFrame([("p", p), ("single", plan({"legs": [bus("X")]})), ("bad", "no json"), ("none", None)], "plan_id string, body string"))
    index = spark.createDataFrame([("SLOW", 0, "S", 0.3), ("FAST", 0, "S", 0.9)], "route_id string, direction_id int, stop_id string, on_time_rate double")
    for profile in itineraries.PROFILES:
        rows = {(r.plan_id, r.itin_idx): r for r in itineraries.rerank(itineraries.factors(legs, index), profile).collect()}
        assert rows["p", 1]["rank"] == 1 and sorted(r["rank"] for k, r in rows.items() if k[0] == "p") == [1, 2]
    rows = {(r.plan_id, r.itin_idx): r for r in itineraries.rerank(itineraries.factors(legs, index), "reliability").collect()}
    assert (rows["p", 1].rerank_score, rows["p", 0].rerank_score, rows["single", 0].rerank_score) == (1.0, 0.0, 0.5)
    assert {r.rerank_score for r in itineraries.rerank(itineraries.factors(legs, index), "balanced").collect() if r.plan_id == "single"} == {1.55}


def test_exposure_and_annotation(spark):
    walk = {"mode": "WALK", "duration": 600.0, "transitLeg": False, "from": {"lat": 41.9, "lon": 12.5}}
    bodies = [("walk", plan({"legs": [walk]})), ("bus", plan({"legs": [bus("A")]})), ("gap", plan({"legs": [bus("A"), bus("A", 900e3)]})), ("neg", plan({"legs": [walk | {"duration": -5.0}]}))]
    legs = files.legs_of_plans(spark.createDataFrame(bodies, "plan_id string, body string"))
    got = {r.plan_id: (r.precip_s, r.temp_s) for r in itineraries.exposure(legs).collect()}
    assert got == {"walk": (600, 600), "bus": (0, 240), "gap": (300, 780), "neg": (0, 0)}
    typical = spark.createDataFrame([("A", 0, "S", 45.0, 180.0, 12)], "route_id string, direction_id int, stop_id string, p50_s double, p85_s double, n long")
    live = files.legs_of_plans(spark.createDataFrame([("live", plan({"legs": [bus("A", realTime=True)]})), ("not", plan({"legs": [bus("A", realTime=False)]}))], "plan_id string, body string"))
    (row,) = itineraries.annotate_legs(live, typical).collect()
    assert (row.plan_id, row.seconds, row.p50_seconds, row.sample_count, row.source) == ("not", 180.0, 45.0, 12, "historical")


def test_factors_in_one_pass(spark, sf_dir):
    """The same figures as factors and penalties apart, leg by leg and segment by segment."""
    from stoplake.plans import bridge, reliability_queries

    legs, index, forecast = bridge.legs(spark, sf_dir), reliability_queries.on_time_index(spark, sf_dir), bridge.forecast(spark, sf_dir)
    rounded_ = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    one, two = itineraries.factors_in_weather(legs, index, forecast), itineraries.factors(legs, index, itineraries.penalties(legs, forecast))
    got = rounded_(one)
    assert got == rounded_(two.select(*one.columns)) and any(r[-1] > 0 for r in got)


def test_keys_are_made_for_segments_that_there_are(spark):
    plan = itineraries.with_segments(bridge.legs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("date_format") == 1  # it was made for a wait, a walk and a ride of each leg


def test_legs_travel_with_what_they_add(spark, sf_dir):
    """The shuffle to the forecast holds no column that a leg's share was worked out from."""
    plan = registry.queries()["agg_itinerary_factors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "co2_g" in generate and "distance_m" not in generate and "mode" not in generate


def test_fetch_cells_read_their_points_once(spark, sf_dir):
    plan = registry.queries()["agg_fetch_cells"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_forecast_documents(spark):
    h = {"time": ["2026-06-29T08:00", "2026-06-29T09:00"], "temperature_2m": [6.0], "apparent_temperature": [4.0], "precipitation": [9.0], "uv_index": [], "wind_speed_10m": []}
    bodies = spark.createDataFrame([([4190], [1250], json.dumps({"hourly": h})), ([1, 2], [3, 4], json.dumps([{"hourly": h}, {"hourly": h}])), ([1], [2], "nonsense")], "q_lats array<long>, q_lons array<long>, body string")
    rows = files.forecast_cells(bodies).collect()
    assert sorted((r.q_lat, r.utc_hour, r.precip_mm) for r in rows) == [(1, 8, 9.0), (2, 8, 9.0), (4190, 8, 9.0)]


def message(*parts):
    """A protobuf message of (number, value) parts."""

    def varint(n):
        out = bytearray()
        n &= (1 << 64) - 1
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for number, v in parts:
        out += varint(number << 3) + varint(v) if isinstance(v, int) else varint(number << 3 | 2) + varint(len(v)) + v
    return out


def feed(*updates, ts=1782023400):
    return message((1, message((1, b"2.0"), (3, ts))), *[(2, message((1, f"e{k}".encode()), (3, u))) for k, u in enumerate(updates)])


TRIP = message((1, b"t"), (3, b"20260629"), (5, b"MEA"))


def stop(name, delay=None):
    return message((4, name), *([(3, message((1, delay)))] if delay is not None else []))


def test_feed_decoding_and_stream(spark, tmp_path):
    source = tmp_path / "feeds"
    source.mkdir()
    (source / "a.pb").write_bytes(feed(message((1, TRIP), (2, stop(b"70001", 120)), (2, stop(b"70002", -30)), (2, stop(b"70003", 3 * 3600)), (2, stop(b"70004")))))
    (source / "b.pb").write_bytes(feed(message((1, TRIP), (2, stop(b"70001")), (5, 45))))
    (source / "broken.pb").write_bytes(b"\xff\xff\xff")
    rows = reliability.derive_events(gtfs_rt.read(spark, str(source))).collect()
    assert sorted((r.stop_id, r.delay_s, r.feed_hour) for r in rows if not r.dropped) == [("70001", 45, 8), ("70001", 120, 8), ("70002", -30, 8)]
    assert sum(r.dropped for r in rows) == 2
    table, tier1 = str(tmp_path / "events"), str(tmp_path / "tier1")
    ingest.start_ingest(ingest.feed_stream(spark, str(source)), table, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    first = ingest.roll_up(spark, table, tier1, ["20260629"]).collect()
    assert sum(r.n for r in first) == 3
    assert sorted(map(str, ingest.roll_up(spark, table, tier1, ["20260629"]).collect())) == sorted(map(str, first))  # the same again


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    source, table, checkpoint = tmp_path / "feeds", str(tmp_path / "events"), tmp_path / "cp"
    source.mkdir()
    run = lambda: ingest.start_ingest(ingest.feed_stream(spark, str(source)), table, str(checkpoint), availableNow=True).awaitTermination()
    count = lambda: spark.read.schema(ingest.EVENTS).parquet(table).count()
    for k in range(2):
        (source / f"{k}.pb").write_bytes(feed(message((1, TRIP), (2, stop(b"70001", 120 + k)), (2, stop(b"70002", -30)))))
        run()
    assert count() == 4
    (checkpoint / "commits" / "1").unlink()  # as if the job had ended after the write and before the commit
    (checkpoint / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert count() == 4


def test_polled_feed(spark, tmp_path):
    """A poll for each trigger; one that no batch has committed is read again from the journal, whatever the feed says by then."""
    source, journal, table, checkpoint = tmp_path / "feed.pb", tmp_path / "journal", str(tmp_path / "events"), tmp_path / "cp"
    run = lambda: ingest.start_ingest(ingest.poll_stream(spark, str(source), str(journal)), table, str(checkpoint), availableNow=True).awaitTermination()
    seen = lambda: sorted((r.stop_id, r.delay_s) for r in spark.read.schema(ingest.EVENTS).parquet(table).collect())
    put = lambda i, delay: source.write_bytes(feed(message((1, TRIP), (2, stop(f"7000{i}".encode(), delay)))))
    put(1, 60)
    run()
    assert seen() == [("70001", 60)]
    put(2, 70)
    run()
    (checkpoint / "commits" / "1").unlink()
    (checkpoint / "commits" / ".1.crc").unlink(missing_ok=True)
    body = source.read_bytes()
    source.unlink()  # the feed is away
    run()  # the second batch again
    assert seen() == [("70001", 60), ("70002", 70)]
    put(3, 80)
    run()
    assert seen() == [("70001", 60), ("70002", 70), ("70003", 80)]
    polls.Journal(str(journal)).put(4, body)  # fetched, but the job ended before any batch knew of it
    source.unlink()
    run()
    assert seen() == [("70001", 60), ("70002", 70), ("70002", 70), ("70003", 80)]
    polls.Journal(str(journal)).put(5, b"\xff\xff\xff")
    run()
    assert len(seen()) == 4 and polls.Journal(str(journal)).numbers() == [5]


def test_expiry(spark):
    d = spark.createDataFrame([("20260601",), ("20260628",), ("20260619",), ("junk",)], "service_date string")
    assert [r[0] for r in reliability.expired_dates(d, "20260629").collect()] == ["20260601"]
    assert reliability.expired_dates(d, "nonsense").collect() == []


def test_feed_archive(spark, tmp_path):
    trips = spark.createDataFrame([("r", "s", "t,1", "to \"B\"", "")], "route_id string, service_id string, trip_id string, trip_headsign string, shape_id string")
    shapes = spark.createDataFrame([], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    path = str(tmp_path / "feed.zip")
    assert sinks.feed_archive({"trips": trips, "shapes": shapes}, path) == {"trips": 1}
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == ["trips.txt"] and z.read("trips.txt").decode() == 'route_id,service_id,trip_id,trip_headsign\nr,s,"t,1","to ""B"""\n'


def timetable_xml():
    """A document with one good trip, and one each of whatever must be left out."""
    point = lambda i, name, at: f'<ScheduledStopPoint id="IT:X:Stop:{i}"><Name> {name} </Name>{at}</ScheduledStopPoint>'
    spot = "<Location><Longitude>12.5</Longitude><Latitude>41.9</Latitude></Location>"
    step = lambda i, stop: f'<StopPointInJourneyPattern order="{i}" id="IT:X:P:{i}"><ScheduledStopPointRef ref="IT:X:Stop:{stop}"/></StopPointInJourneyPattern>'
    time = lambda i, *parts: f'<TimetabledPassingTime><StopPointInJourneyPatternRef ref="IT:X:P:{i}"/>{"".join(parts)}</TimetabledPassingTime>'
    a, d = (lambda x: f"<ArrivalTime>{x}</ArrivalTime>"), (lambda x: f"<DepartureTime>{x}</DepartureTime>")
    valid = "<ValidBetween><FromDate>2026-04-21T00:00:00</FromDate><ToDate>2026-04-28T23:59:59</ToDate></ValidBetween>"
    trip = lambda i, line, day, times: f'<ServiceJourney id="IT:X:J:{i}">{valid}<Name>to &amp; fro</Name><DepartureTime>13:05:00</DepartureTime><dayTypes><DayTypeRef ref="IT:X:D:{day}"/></dayTypes><FlexibleLineView><LineRef ref="IT:X:L:{line}"/></FlexibleLineView><passingTimes>{times}</passingTimes></ServiceJourney>'
    times = time(1, d("13:05:00")) + time(2, a("14:30:00"), d("14:31:00")) + time(3, a("15:00:00")) + time(4, d("15:30:00")) + time(1) + time(9, a("16:00:00"))
    assign = lambda p, day: f'<DayTypeAssignment id="A"><OperatingPeriodRef ref="IT:X:U:{p}"/><DayTypeRef ref="IT:X:D:{day}"/></DayTypeAssignment>'
    return (
        '<D xmlns="http://www.netex.org.uk/netex"><Operator id="O"><Name>BUSLINE</Name></Operator>'
        '<Line id="IT:X:L:1"><Name>Long, name</Name><ShortName>R1</ShortName><TransportMode>rail</TransportMode></Line>'
        + point("a", "Alpha", spot) + point("b", "Beta", spot) + point("c", "No place", "")
        + f'<ServiceJourneyPattern id="Q"><pointsInSequence>{step(1, "a")}{step(2, "b")}{step(3, "c")}{step(4, "gone")}</pointsInSequence></ServiceJourneyPattern>'
        + '<DayType id="IT:X:D:1"><properties><PropertyOfDay><DaysOfWeek>Monday Friday</DaysOfWeek></PropertyOfDay></properties></DayType>'
        + '<UicOperatingPeriod id="IT:X:U:1"><FromDate>2026-04-21T00:00:00.000+02:00</FromDate><ValidDayBits>11010</ValidDayBits></UicOperatingPeriod>'
        + '<UicOperatingPeriod id="IT:X:U:2"><FromDate>2026-04-21T00:00:00</FromDate><ValidDayBits>000</ValidDayBits></UicOperatingPeriod>'
        + assign(1, 1) + assign(2, 2) + assign(7, 3)
        + trip("t1", 1, 1, times) + trip("t2", 9, 1, times) + trip("t3", 1, 2, times) + "</D>"
    )


@pytest.mark.parametrize("gz", [False, True])
def test_timetable_to_feed(spark, tmp_path, gz):
    path = tmp_path / ("x.xml.gz" if gz else "x.xml")
    path.write_bytes(gzip.compress(timetable_xml().encode()) if gz else timetable_xml().encode())
    t = feeds.tables(netex.read(spark, str(path), 700))
    shapes = spark.createDataFrame([("1", [(12.0, 41.0), (12.5, 41.5)]), ("2", [(1.0, 2.0)])], "line_id string, points array<struct<lon: double, lat: double>>")
    assert t["days"].first().days == "Monday Friday"
    out = str(tmp_path / "feed.zip")
    counts = feeds.convert(spark, str(path), out)
    assert counts == {"agency": 1, "stops": 2, "routes": 1, "services": 1, "trips": 1, "stop_times": 3}
    with zipfile.ZipFile(out) as z:
        lines = {n: z.read(n).decode().splitlines()[1:] for n in z.namelist()}
    assert lines["agency.txt"] == ["FL,BUSLINE,https://www.trenitalia.com,Europe/Rome,it"]
    assert lines["stops.txt"] == ["a,Alpha,41.9,12.5", "b,Beta,41.9,12.5"]
    assert lines["routes.txt"] == ['1,FL,R1,"Long, name",2']
    assert lines["calendar_dates.txt"] == ["1,20260421,1", "1,20260422,1", "1,20260424,1"]
    assert lines["trips.txt"] == ["1,1,t1,to & fro"]
    assert lines["stop_times.txt"] == ["t1,13:05:00,13:05:00,a,1", "t1,14:30:00,14:31:00,b,2", "t1,15:00:00,15:00:00,c,3"]
    if not gz:
        assert sinks.feed_archive(feeds.members(t, shapes=shapes), out)["shapes"] == 1
        with zipfile.ZipFile(out) as z:
            assert z.read("shapes.txt").decode().splitlines()[1:] == ["1,41.0,12.0,0", "1,41.5,12.5,1"] and z.read("trips.txt").decode().splitlines()[1] == "1,1,t1,to & fro,1"


def test_stored_tiers(spark, tmp_path):
    t2 = tier(spark, [-60, 0, 300, 600], stop="s.1/x")
    key = keys.tier2_key(F.col("route_id"), F.col("direction_id"), F.col("stop_id"), F.col("tod"), F.col("day_type"))
    t2 = reduce(DataFrame.unionByName, (t2.withColumn("stop_id", F.lit(f"s.{k}/x")) for k in range(5)))
    sinks.write_tier_maps(t2, key, str(tmp_path / "maps"), 2)
    assert sorted(files.read_tier2(spark, str(tmp_path / "maps")).select(*t2.columns).collect()) == sorted(t2.collect())
    maps = [x for x in (tmp_path / "maps").iterdir() if x.suffix == ".txt" and x.stat().st_size]
    assert sorted(len(json.loads(x.read_text())) for x in maps) == [1, 2, 2]
    path = str(tmp_path / "tiers" / "tier2.json")
    sinks.write_atomic(path, json.dumps({k: v for x in maps for k, v in json.loads(x.read_text()).items()}).encode())
    back = files.read_tier2(spark, path)
    assert [back.schema[c].dataType for c in t2.columns] == [t2.schema[c].dataType for c in t2.columns]
    assert sorted(back.select(*t2.columns).collect()) == sorted(t2.collect())
    assert sorted(reliability.on_time_index(back).collect()) == sorted(reliability.on_time_index(t2).collect())
    assert sorted(reliability.typical_delay_index(back).collect()) == sorted(reliability.typical_delay_index(t2).collect())
    assert files.read_tier2(spark, path, max_bytes=10).collect() == files.read_tier2(spark, str(tmp_path / "none.json")).collect() == []
    sinks.write_atomic(path, b"{broken")
    assert files.read_tier2(spark, path).collect() == [] and len(list((tmp_path / "tiers").iterdir())) == 1
    sinks.write_atomic(path, b'{"R/0/1/20260629/midday": {"count": 2, "sum_delay": 5}, "junk": {"count": 1}}')
    (r,) = files.read_tier1(spark, path).collect()
    assert (r.route_id, r.service_date, r.tod, r.n, r.sum_delay, r.b0) == ("R", "20260629", "midday", 2, 5, 0)


def test_line_files(spark, tmp_path):
    base, more = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    more.write_text("3\n")
    for start in ("1\n2", "1\n2\n"):
        base.write_text(start)
        sinks.append_lines(str(base), str(more))
        assert base.read_text() == "1\n2\n3\n"
    p = spark.createDataFrame([("i", "n", "c", "a", None, None, 1.0, 2.0)], "id string, name string, category string, address string, city string, brand_wikidata string, lon double, lat double")
    sinks.places_file(p, str(tmp_path / "places"))
    assert files.read_pois(spark, str(tmp_path / "places")).select(*p.columns).collect() == p.collect()


def test_keys_tokens_and_names(spark):
    parsed = one(spark, keys.parse_tier1_key(F.lit("R+2F1/0/S/20260629/midday")))
    assert (parsed.route_id, parsed.stop_id, parsed.tod) == ("R/1", "S", "midday") and one(spark, keys.parse_tier1_key(F.lit("a/b"))) is None
    assert [one(spark, calendar.valid_token(F.lit(x), calendar.TOD_TOKENS)) for x in ("night", "noon")] == ["night", None]
    assert [one(spark, text.exit_name(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("N", "1"), (None, "2"), (None, None))] == ["N", "Uscita 2", "Uscita"]
    channels = F.array(F.struct(F.lit("alerts").alias("channel"), F.lit("u1").alias("url")), F.struct(F.lit("trip-updates").alias("channel"), F.lit("u2").alias("url")))
    assert one(spark, regions.realtime_url(channels, "trip-updates")) == "u2" and one(spark, regions.realtime_url(channels, "none")) is None
    assert [one(spark, regions.extent(F.lit(a), F.lit("b"))) for a in ("", "a")] == ["b", "a"]
    r = spark.range(1).select(*regions.artifact_names(F.lit("italy/lazio/rome"), F.lit("rome"))).first()
    assert tuple(r) == ("italy", "rome.pmtiles", "italy-lazio-rome.osm.pbf")


def test_labels_and_artifacts(spark, tmp_path):
    slugs = lambda *x: F.array(*map(F.lit, x))
    assert [one(spark, modes.relabel_branch(F.lit(r), slugs(*x))) for r, x in (("B", ("jonio", "a")), ("B", ("laurentina",)), ("A", ("conca-d-oro",)))] == ["B1", None, None]
    assert [one(spark, modes.method_label(F.lit(m))) for m in ("GET", "BREW")] == ["GET", "OTHER"]
    assert [one(spark, regions.feed_ids(F.lit(p))) for p in ("/x/atac.gtfs.zip", "/x/readme.txt")] == ["atac", None]
    (tmp_path / "a.gtfs.zip").write_bytes(b"abc")
    os.utime(tmp_path / "a.gtfs.zip", (1_700_000_000, 1_700_000_000))
    (r,) = files.artifacts(spark, str(tmp_path)).collect()
    assert (r.size, r.built_at) == (3, "2023-11-14T22:13:20Z")


def test_line_features(spark):
    found = spark.createDataFrame([("k", "metro", "ATAC:MEA", "A", "#E27439", "ATAC", True)], "line_key string, kind string, route string, ref string, color string, network string, routable boolean")
    shapes = spark.createDataFrame([("k", 2, [(1.0, 2.0), (3.0, 4.0)]), ("k", 1, [(0.0, 0.0), (1.0, 2.0)])], "line_key string, way_id long, points array<struct<lon: double, lat: double>>")
    (r,) = geometry.line_features(found, shapes).collect()
    f = json.loads(r.feature)
    assert f["geometry"] == {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 2]], [[1, 2], [3, 4]]]} and f["properties"]["line"] == "A" and f["properties"]["routable"] is True


def test_partitions_are_appended_and_replaced(spark, tmp_path):
    path = str(tmp_path / "events")
    e = spark.createDataFrame([("R", 0, "1", "20260629", 8, 8), ("R", 0, "1", "20260630", 9, 8)], EVENT)
    sinks.append_events(e, path)
    sinks.append_events(e.limit(1), path)
    assert sorted(p.name for p in (tmp_path / "events").iterdir() if p.is_dir()) == ["service_date=20260629", "service_date=20260630"]
    assert [r.service_date for r in sinks.partition_dates(spark, path).collect()] == ["20260629", "20260630"] and sinks.partition_dates(spark, path + "/none").collect() == []
    assert spark.read.schema(ingest.EVENTS).parquet(path).count() == 3
    t1, out = reliability.fold_tier1(e), str(tmp_path / "t1")
    sinks.replace_dates(t1, out)
    sinks.replace_dates(t1.filter("service_date = '20260630'").withColumn("n", F.lit(5).cast("long")), out)
    assert {str(r.service_date): r.n for r in spark.read.parquet(out).collect()} == {"20260629": 1, "20260630": 5}


def test_region_files(spark, tmp_path):
    for path, body in (("italy", 'name = "Italy"'), ("italy/lazio", 'name = "Lazio"')):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "region.toml").write_text(body)
    got = files.read_region(str(tmp_path), "italy/lazio")
    assert [(r["level"], r["path"], r["name"]) for r in got] == [(0, "italy", "Italy"), (1, "italy/lazio", "Lazio")]
    n = spark.createDataFrame([("italy/lazio/rome", "italy/lazio")], "path string, parent string")
    assert [r.path for r in regions.ancestry(n).orderBy("level").collect()] == ["italy", "italy/lazio", "italy/lazio/rome"]


def test_route_of_relation(spark):
    rels = spark.createDataFrame([(1, "A", None), (2, "x", "Line B"), (3, "", "")], "rel_id long, ref string, name string")
    routes = spark.createDataFrame([("r1", "A"), ("r2", "Line B"), ("r3", "")], "route_id string, short_name string")
    assert {r.rel_id: r.route_id for r in lines.route_for_relation(rels, routes).collect()} == {1: "r1", 2: "r2", 3: None}


def test_gtfs_routes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("routes.txt", "\ufeffroute_id,route_short_name,route_type,route_color\nr1,8,0,00FF00\nr2,8,0,\nr3,64,3,\nr4,,0,\n")
    assert [tuple(r) for r in files.read_gtfs_routes(spark, str(tmp_path / "f.zip")).collect()] == [("8", "r2", "0", "")]


def test_events_read_softly_and_windowed_fold(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"route_id":"R","direction_id":0,"stop_id":"1","service_date":"20260629","delay_s":8}\nbroken\n')
    e = files.read_events(spark, str(tmp_path / "e.jsonl"))
    assert [(r.stop_id, r.feed_hour) for r in e.collect()] == [("1", 12)]
    stream = spark.readStream.schema(EVENT).json(str(tmp_path))
    q = ingest.windowed_fold(stream.filter("stop_id IS NOT NULL")).writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.stop_id, r.n, r.tod) for r in spark.table("folded").collect()] == [("1", 1, "midday")] or [(r.stop_id, r.n) for r in spark.table("folded").collect()] == [("1", 1)]


def rows_of_netex(spark, path, range_bytes):
    df = netex.read(spark, str(path), range_bytes)
    return df.rdd.getNumPartitions(), sorted(map(repr, df.collect()))


def test_netex_ranges(spark, tmp_path):
    """Whatever the ranges, the elements and their places are the same: comments, character data and prefixes across borders, too."""
    line = lambda i, name: f'<n:Line id="a:b:c:L{i}" n:x="1">\n<n:Name>{name}</n:Name><n:TransportMode>rail</n:TransportMode></n:Line >'
    body = '<?xml version="1.0" encoding="iso-8859-1"?><n:D xmlns:n="http://www.netex.org.uk/netex"><!-- ' + line(90, "no") * 9 + " -->"
    body += "".join(line(i % 7, f"é {i} &lt;") for i in range(40)) + "<Note><![CDATA[" + line(91, "no") * 5 + "]]></Note>"
    body += '<Operator id="empty"/><Line id="z"><Name>last<!-- <Line> --></Name></Line><DayTypeRef ref="no"/></n:D>'
    path = tmp_path / "x.xml"
    path.write_bytes(body.encode("iso-8859-1"))
    _, want = rows_of_netex(spark, path, 1 << 20)
    assert len(want) == 42 and not any("no" in r for r in want) and sum("é" in r for r in want) == 40
    for size in (61, 200, 997):
        parts, got = rows_of_netex(spark, path, size)
        assert parts == -(-len(body) // size) and got == want
    (tmp_path / "x.xml.gz").write_bytes(gzip.compress(path.read_bytes()))
    assert rows_of_netex(spark, tmp_path / "x.xml.gz", 50) == (1, want)
    last = {r.line_id: r.long_name for r in feeds.tables(netex.read(spark, str(path), 61))["lines"].collect()}
    assert last == {f"L{k}": f"é {max(i for i in range(40) if i % 7 == k)} <" for k in range(7)} | {"z": "last"}


def test_netex_reads(monkeypatch):
    """Elements and tags that a read cuts, and one that does not end."""
    monkeypatch.setattr(netex, "READ_BYTES", 5)
    monkeypatch.setattr(netex, "TAG_BYTES", 40)
    body = b'<d><Line id="1"><Name>a</Name></Line><!-- <Line> --><ServiceJourneyPattern/><DayType id="2"></DayType></d>'
    assert [(t, x[-8:]) for _, t, x in netex.elements_in(io.BytesIO(body), 0, None)] == [("Line", b"e></Line"[-7:] + b">"), ("ServiceJourneyPattern", b"attern/>"), ("DayType", b"DayType>")]
    with pytest.raises(ValueError, match="Line at byte 3"):
        list(netex.elements_in(io.BytesIO(body[:20]), 0, None))


def test_netex_tables(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<D xmlns="http://www.netex.org.uk/netex"><Line id="a:b:c:L1"><Name>One</Name><TransportMode>rail</TransportMode></Line>'
        '<UicOperatingPeriod id="P"><FromDate>2026-04-21T00:00:00</FromDate><ValidDayBits>11110011</ValidDayBits></UicOperatingPeriod></D>'
    )
    t = {r.tag: r for r in netex.read(spark, str(tmp_path / "x.xml")).collect()}
    assert set(t) == {"Line", "UicOperatingPeriod"} and t["Line"].name == "One" and t["UicOperatingPeriod"].bits == "11110011"


def test_numbers_follow_the_order_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("g")).repartition(7)
    out = {(r.g, r.id): r.place for r in numbered(df, "g", F.desc("id")).collect()}
    assert [k for k, _ in sorted(out.items(), key=lambda x: x[1])] == sorted(out, key=lambda k: (k[0], -k[1])) and sorted(out.values()) == list(range(1, 1001))
    assert numbered(df.limit(0), "g").collect() == []


def test_feed_archive_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of few rows, deflated apart: a sound archive with the same bytes however rows are dealt out."""
    monkeypatch.setattr(sinks, "BLOCK_ROWS", 7)
    dates = spark.range(100).selectExpr("concat('s', id % 9) service_id", "cast(20260101 + id as string) date", "1 exception_type")
    times = spark.range(60).selectExpr("concat('t', id % 2) trip_id", "'10:00:00' arrival_time", "if(id % 5 = 0, null, '10:00:00') departure_time", "'a \"b\", c' stop_id", "cast(id as int) stop_sequence")
    raw = []
    for n in (1, 5):
        path = str(tmp_path / f"{n}.zip")
        assert sinks.feed_archive({"stop_times": times.repartition(n), "calendar_dates": dates.repartition(n)}, path) == {"services": 9, "stop_times": 60}
        raw.append(open(path, "rb").read())
    assert raw[0] == raw[1]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["calendar_dates.txt", "stop_times.txt"]
        got = list(csv.reader(io.StringIO(z.read("stop_times.txt").decode())))
        assert got[0] == list(sinks.MEMBERS["stop_times"]) and [(r[0], r[2], int(r[4])) for r in got[1:]] == sorted((f"t{i % 2}", "" if i % 5 == 0 else "10:00:00", i) for i in range(60)) and got[1][3] == 'a "b", c' and got[1][2] == ""
        assert z.read("calendar_dates.txt").decode().splitlines()[1:] == sorted(f"s{i % 9},{20260101 + i},1" for i in range(100))


def test_large_archives_have_wide_fields(tmp_path):
    entries = [zipped.Entry("a.txt", 1, 2**33, 2**32 + 5, b""), zipped.Entry("b.txt", 2, 3, 4, b"")]
    at = zipped.offsets(entries)
    held = io.BytesIO(zipped.directory(entries, at))
    tail = held.getvalue()
    with open(tmp_path / "x.zip", "wb") as f:  # sparse: only the headers and the directory are there
        for e, o in zip(entries, at):
            f.seek(o)
            f.write(zipped.local_header(e))
        f.seek(at[-1])
        f.write(tail)
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert [(i.filename, i.CRC, i.file_size, i.compress_size, i.header_offset) for i in z.infolist()] == [("a.txt", 1, 2**33, 2**32 + 5, 0), ("b.txt", 2, 3, 4, at[1])]


def test_boards(spark):
    body = json.dumps([{"compNumeroTreno": " REG 123 ", "destinazione": "Roma", "compOrarioPartenza": "10:00", "ritardo": 3, "binarioProgrammatoPartenzaDescrizione": "4"}, {"destinazione": "X"}])
    (r,) = files.boards(spark.createDataFrame([("S1", body)], "station string, body string"), "departures").collect()
    assert (r.train_number, r.category, r.delay_minutes, r.platform, r.origin) == ("REG 123", "REG", 3, "4", None)


def test_lines_read_softly(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id":"1","name":"a","lon":1.0,"lat":2.0}\nbroken\n\n')
    assert [r.id for r in files.read_pois(spark, str(tmp_path / "p.jsonl")).collect()] == ["1"]
    assert files.read_gtfs_routes(spark, str(tmp_path / "absent.zip")).collect() == []


def test_stitching(spark):
    ways = [("b", 0, 1, [0.0, 1.0], [0.0, 0.0]), ("b", 1, 2, [2.0, 1.0], [0.0, 0.0]), ("b", 2, 3, [9.0, 9.5], [9.0, 9.0]), ("b", 3, 1, [0.0, 1.0], [0.0, 0.0])]
    rows = geometry.stitch(spark.createDataFrame(ways, "branch string, seq int, way_id long, lons array<double>, lats array<double>")).orderBy("pos").collect()
    assert [r.lon for r in rows] in ([0.0, 1.0, 2.0], [2.0, 1.0, 0.0])


def test_stitching_takes_the_first_way_that_fits_either_end():
    # a Y: the last way takes a at its head first; c then stands in a's place, before b
    a, b, c, d = [(0.0, 0.0), (1.0, 0.0)], [(5.0, 0.0), (2.0, 0.0)], [(2.0, 0.0), (2.0, 3.0)], [(1.0, 0.0), (2.0, 0.0)]
    assert geometry.chain([a, b, c, d]) == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    assert geometry.chain([[(0.0, 0.0), (0.0, 0.0)]]) == []


def test_unreadable_feeds(spark):
    f = spark.createDataFrame([("good", b""), ("bad", b"\x0b\xff")], "path string, content binary")
    assert [r.path for r in gtfs_rt.unreadable(f).collect()] == ["bad"] and gtfs_rt.decode(f).collect() == []


def extract(blocks, compress):
    """A map extract of blocks of (nodes, dense nodes, ways, relations), written by hand."""

    def vint(x):
        x &= (1 << 64) - 1
        out = b""
        while x > 0x7F:
            out, x = out + bytes([x & 0x7F | 0x80]), x >> 7
        return out + bytes([x])

    zz = lambda x: x << 1 if x >= 0 else (-x << 1) - 1
    num = lambda n, x: vint(n << 3) + vint(x)
    msg = lambda n, raw: vint(n << 3 | 2) + vint(len(raw)) + raw
    packed = lambda n, xs: msg(n, b"".join(map(vint, xs)))
    steps = lambda xs: [zz(b - a) for a, b in zip([0, *xs], xs)]
    parts = [(b"OSMHeader", msg(1, b""))]
    for nodes, dense, ways, relations in blocks:
        texts = [""]
        sid = lambda x: texts.index(x) if x in texts else texts.append(x) or len(texts) - 1  # noqa: E731, B023
        tags = lambda t: packed(2, [sid(k) for k in t]) + packed(3, [sid(v) for v in t.values()])  # noqa: E731, B023
        e7 = lambda x: round(x * 1e7)
        group = b"".join(msg(1, num(1, zz(i)) + tags(t) + num(8, zz(e7(lat))) + num(9, zz(e7(lon)))) for i, lon, lat, t in nodes)
        if dense:
            kv = [x for _, _, _, t in dense for x in [*(y for k, v in t.items() for y in (sid(k), sid(v))), 0]]
            group += msg(2, packed(1, steps([d[0] for d in dense])) + packed(8, steps([e7(d[2]) for d in dense])) + packed(9, steps([e7(d[1]) for d in dense])) + packed(10, kv))
        group += b"".join(msg(3, num(1, i) + tags(t) + packed(8, steps(refs))) for i, refs, t in ways)
        group += b"".join(msg(4, num(1, i) + tags(t) + packed(8, [sid(r) for _, _, r in m]) + packed(9, steps([x for _, x, _ in m])) + packed(10, [k for k, _, _ in m])) for i, m, t in relations)
        body = msg(1, b"".join(msg(1, x.encode()) for x in texts)) + msg(2, group)
        parts.append((b"OSMData", msg(3, zlib.compress(body)) if compress else msg(1, body)))
    return b"".join(len(h := msg(1, kind) + num(3, len(blob))).to_bytes(4, "big") + h + blob for kind, blob in parts)


@pytest.mark.parametrize("compress", [False, True])
def test_map_extract(spark, tmp_path, compress):
    dense = [(1, 12.5, 41.9, {}), (2, 12.51, 41.91, {"name": "Termini"}), (3, -12.52, -41.92, {"railway": "subway_entrance", "ref": "4"}), (2**40, 12.6, 41.8, {})]
    ways = [(10, [1, 2], {"railway": "subway"}), (11, [2**40, 2, 99], {"railway": "rail"}), (12, [1, 2**40], {})]
    routes = [
        (100, [(1, 10, ""), (1, 12, "platform"), (0, 2, "stop"), (0, 1, "entrance")], {"type": "route", "route": "subway", "ref": "A", "operator": "ATAC", "network": "Metro"}),
        (101, [(1, 11, ""), (1, 12, ""), (1, 77, ""), (1, 10, "platform")], {"type": "route", "route": "train", "ref": "FL1", "name": "Roma - Orte"}),
        (102, [(2, 100, ""), (1, 10, "")], {"type": "route_master"}),
        (103, [], {"route": "train"}),
    ]
    (tmp_path / "a.pbf").write_bytes(extract([([(7, 1.5, -2.5, {"railway": "subway_entrance", "name": "Est"})], dense, [], []), ([], [], ways, routes)], compress))
    e = osm_pbf.read(spark, str(tmp_path / "a.pbf")).persist()
    assert e.count() == 12 and {r.kind: r.n for r in e.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"node": 5, "way": 3, "relation": 4}
    assert {r.node_id: (round(r.lon, 7), round(r.lat, 7)) for r in extracts.nodes(e).collect()} == {1: (12.5, 41.9), 2: (12.51, 41.91), 3: (-12.52, -41.92), 2**40: (12.6, 41.8), 7: (1.5, -2.5)}
    assert {r.way_id: list(r.refs) for r in extracts.way_refs(e).collect()} == {10: [1, 2], 11: [2**40, 2, 99], 12: [1, 2**40]}
    assert sorted((r.rel_id, r.route, r.ref, r.network) for r in extracts.route_relations(e).collect()) == [(100, "subway", "A", "Metro"), (101, "train", "FL1", None)]
    owned = lines.owned_relations(extracts.route_relations(e), "ATAC")
    (line,) = lines.lines(lines.with_masters(owned, extracts.memberships(e)), extracts.relation_ways(e)).collect()
    assert (line.line_key, line.kind, line.ref, line.n_ways) == ("M102", "metro", "A", 1)
    assert [tuple(r) for r in extracts.metro_stops(e).collect()] == [(100, "A", 2, 2)]
    assert [(r.node_id, r.name) for r in extracts.stop_nodes(e, extracts.metro_stops(e)).collect()] == [(2, "Termini")]
    assert sorted((r.node_id, r.name) for r in extracts.entrances(e).collect()) == [(3, "Uscita 4"), (7, "Est")]
    assert [list(r.refs) for r in extracts.track_ways(e).collect()] == [[1, 2]]
    branches = lines.route_for_relation(extracts.route_relations(e).select("rel_id", "ref", "name"), spark.createDataFrame([("r1", "FL1")], "route_id string, short_name string")).select("rel_id", F.col("route_id").alias("branch"))
    shape = geometry.stitch(extracts.rail_members(e, branches)).orderBy("pos").collect()
    assert [(r.branch, round(r.lon, 2)) for r in shape] == [("r1", 12.5), ("r1", 12.6), ("r1", 12.51)]
    assert geometry.stitch(extracts.rail_members(e, branches.limit(0))).collect() == []
    e.unpersist()


def test_map_extract_in_ranges(spark, tmp_path):
    """A file of many blobs is cut by its headers; groups of other kinds are not decoded; what is cut short is an error."""
    blocks = [([], [(100 * k + i, 12.0 + k / 100, 41.9, {"name": "é" * i}) for i in range(1, 9)], [(k, [100 * k + 1, 100 * k + 2], {})], []) for k in range(40)]
    raw = extract(blocks, True)
    path = tmp_path / "many.pbf"
    path.write_bytes(raw)
    cut = osm_pbf.ranges(str(path), 300)
    assert len(cut) > 10 and cut[0].start == 0 and cut[-1].end == len(raw) and all(a.end == b.start for a, b in zip(cut, cut[1:]))
    whole = osm_pbf.read(spark, str(path), range_bytes=300)
    assert whole.rdd.getNumPartitions() == len(cut) and whole.count() == 40 * 9
    assert {r.kind: r["count"] for r in whole.groupBy("kind").count().collect()} == {"node": 320, "way": 40}
    assert osm_pbf.read(spark, str(path), ("way",)).select("kind").distinct().count() == 1
    blob = next(osm_pbf.blobs_of(cut[0]))
    assert [r[0] for r in osm_pbf.elements_of(blob, ("way",))] == ["way"] and list(osm_pbf.elements_of(blob, ("relation",))) == []
    path.write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="cut short"):
        osm_pbf.ranges(str(path))
    path.write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="header"):
        osm_pbf.ranges(str(path))


def test_map_extract_round_trip(spark, tmp_path):
    rows = [("node", -(2**40), -12.5, -41.9, {}, None, None), ("node", 3, 180.0, 90.0, {"a": "", "name": "Ü"}, None, None), ("way", 5, None, None, {}, [], None), ("way", 2**62, None, None, {"k": "v"}, [2**40, -1, 7], None)]
    rows += [("relation", 1, None, None, {"t": "x"}, None, [("node", 3, "stop"), ("way", 2**62, ""), ("relation", -9, "é")])]
    path = str(tmp_path / "out")
    for part in (rows[:2], rows):  # the second replaces the first
        osm_pbf.write(spark.createDataFrame(part, osm_pbf.SCHEMA).repartition(2), path)
    assert {repr(r) for r in osm_pbf.read(spark, path).collect()} == {repr(r) for r in spark.createDataFrame(rows, osm_pbf.SCHEMA).collect()}
    osm_pbf.write(spark.createDataFrame(rows[:1], osm_pbf.SCHEMA), path, "append")
    assert osm_pbf.read(spark, path).count() == 6
    osm_pbf.write(spark.createDataFrame([], osm_pbf.SCHEMA), path)
    assert osm_pbf.read(spark, path).collect() == []


def test_small_fields_are_coded_one_by_one():
    """Short packed fields have the bytes and numbers of long ones, and thousands of ways take no seconds."""
    values = [0, 1, 127, 128, 300, 2**32, 2**63 - 1]
    ids = [5, -7, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    long = osm_pbf.FEW + 1
    assert osm_pbf.packed(values * long).startswith(osm_pbf.packed(values)) and osm_pbf.numbers(osm_pbf.packed(values)) == osm_pbf.varints(osm_pbf.packed(values)).tolist() == values
    assert osm_pbf.signed_steps(ids * long).startswith(osm_pbf.signed_steps(ids)) and osm_pbf.deltas(osm_pbf.signed_steps(ids)) == ids and osm_pbf.deltas(osm_pbf.signed_steps(ids * long)) == ids * long
    rows = [{"kind": "way", "id": i, "lon": None, "lat": None, "tags": [("railway", "rail")], "refs": [i, 3 * i, 7], "members": None} for i in range(8000)]
    began = time.process_time()
    body = osm_pbf.block_of(rows)
    back = list(osm_pbf.elements_of(osm_pbf.message((1, body))))
    assert time.process_time() - began < 4  # about 10 s with a call of numpy for each field
    assert [(r[1], r[5]) for r in back] == [(r["id"], r["refs"]) for r in rows]


@pytest.mark.parametrize("name", ["join_metro_stop_nodes", "join_rail_members"])
def test_joins_of_an_extract_decode_it_once(spark, name):
    found = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "map_extract" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_relations_of_a_branch_have_places(spark):
    """The 2148th relation's place times a million is no int."""
    rows = [("node", 1, 1.0, 2.0, {}, None, None), ("way", 7, None, None, {}, [1, 1], None)]
    rows += [("relation", i, None, None, {"route": "train", "ref": "FL1"}, None, [("way", 7, "platform"), ("way", 7, "")]) for i in range(2500)]
    e = spark.createDataFrame(rows, osm_pbf.SCHEMA)
    found = extracts.rail_members(e, extracts.route_relations(e).select("rel_id", F.col("ref").alias("branch"))).collect()
    assert sorted(r.seq for r in found) == [1_000_000 * k + 1 for k in range(1, 2501)]


def test_rings(spark):
    square = np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float)
    assert geometry.area(square) == 10_000 and geometry.covers(square, (50, 50)) and geometry.covers(square, (0, 50)) and not geometry.covers(square, (101, 50))
    smooth = geometry.smooth(square, [(50, 50)])
    assert geometry.covers(smooth, (50, 50)) and abs(geometry.area(smooth) - 10_000) <= 2500
    assert (geometry.smooth(square, [(0, 0)]) == square).all()
    pts = spark.createDataFrame([("s", x, y, x == 50.0) for x, y in [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (50.0, 50.0)]], "name string, x double, y double, is_stop boolean")
    assert geometry.station_hulls(pts).count() >= 4


def test_platform_strips():
    """The strip is left of the track, wherever the stop is; sparse tracks reach on to their next vertices and are cut into parts."""
    track = np.array([(x, 0.0) for x in range(0, 201, 10)])
    ring = geometry.platform_ring(track, 10)
    assert (ring[0] == ring[-1]).all() and ring[:, 1].min() >= 0 and ring[:, 1].max() == pytest.approx(6.2)
    assert (ring[:, 0].min(), ring[:, 0].max()) == (40, 160)  # the first vertices at 52 m or more
    sparse = geometry.platform_ring(np.array([(0.0, 0.0), (200.0, 0.0), (400.0, 0.0)]), 1)
    assert sparse[0].tolist() == [0, 1.2] and len(sparse) == 2 * 25 + 1  # 12 parts of each 200 m
    down = geometry.platform_ring(track[::-1], 0)
    assert down[:, 1].max() < 0 and (down[:, 0].min(), down[:, 0].max()) == (140, 200)
    assert geometry.platform_ring(track[:1], 0) is None


def test_platforms_of_stops(spark):
    tracks = spark.createDataFrame([("t1", k, 10.0 * k, 0.0) for k in range(30)] + [("t2", k, 10.0 * k, 40.0) for k in range(30)] + [("t3", 0, 5.0, -1.0), ("far", 0, 9000.0, 9000.0), ("far", 1, 9100.0, 9000.0)], "track string, pos int, x double, y double")
    stops = spark.createDataFrame([("a", 100.0, -2.0), ("b", 100.0, 30.0), ("mid", 100.0, 20.0), ("f", 9050.0, 3000.0), ("none", 1e6, 1e6)], "stop string, x double, y double")
    got = {r.stop: r.ring and (round(r.ring[0].x, 6), round(r.ring[0].y, 6)) for r in stations.platforms(stops, tracks).collect()}
    assert got == {"a": (40, 1.2), "b": (40, 41.2), "mid": (40, 1.2), "f": (9000, 9001.2), "none": None}


def test_many_stops_beside_a_long_track(spark):
    """A track's vertices do not travel to each of its stops: 40 million of them would take minutes."""
    line = np.array([(30.0 * k, 3.0 * (k % 2)) for k in range(20_000)])
    tracks = spark.range(len(line)).select(F.lit(7).alias("track"), F.col("id").alias("pos"), (F.col("id") * 30.0).alias("x"), (F.col("id") % 2 * 3.0).alias("y"))
    stops = spark.range(2000).select(F.col("id").alias("stop"), (F.col("id") * 300.0 + 1).alias("x"), F.lit(1.0).alias("y"))
    began = time.time()
    found = {r.stop: [tuple(p) for p in r.ring] for r in stations.platforms(stops, tracks).collect()}
    assert time.time() - began < 30
    assert len(found) == 2000 and all(found[k] == [tuple(p) for p in geometry.platform_ring(line, 10 * k).tolist()] for k in (0, 1, 777, 1999))


@pytest.mark.parametrize("name", ["join_same_brand", "set_related_places"])
def test_every_addressed_place_of_a_brand_is_an_anchor(spark, name):
    d = "/root/testdata/sf0.01"
    wanted = {r.anchor_id for r in place_queries.anchors(spark, d).filter("brand_wikidata IS NOT NULL").collect()}
    found = registry.queries()[name](spark, d).filter("relation = 'same-brand'")
    assert len(wanted) > 40 and {r.anchor_id for r in found.collect()} == wanted


def test_pairs_of_places_are_dealt_out_and_cheap(spark):
    """Pairs grow with the square of places: none is left to the few splits of a broadcast's other side, and what a row decides is made before it meets others."""
    spots = [(f"p{k}", 12.1 + 0.5 * (k * 7919 % 1000) / 1000, 41.6 + 0.5 * (k * 104729 % 1000) / 1000) for k in range(120)]
    p = spark.createDataFrame([(i, "Place", "shop", "Via Po, 1", "Roma", "Q1", lon, lat) for i, lon, lat in spots], files.POI)
    a = places.bucketed(p).select(F.col("id").alias("anchor_id"), "street", "number", "city", "brand_wikidata", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (places.at_address(p, a), places.same_brand(p, a)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        pairs, rows = plan.split("Join", 1)
        assert pairs.rstrip().endswith("SortMerge") and f", {n}), REPARTITION_BY_NUM" in rows
        assert "COS(" not in pairs and "round(" not in pairs.lower() and "POWER(" not in pairs
        got = {(r.anchor_id, r.poi_id): r.distance_m for r in found.collect()}
        assert len(got) == len(spots) ** 2
        for i, lon, lat in spots:
            for j, lon2, lat2 in spots[:9]:
                h = math.sin(math.radians(lat2 - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon) / 2) ** 2
                assert got[i, j] == pytest.approx(2 * 6_371_000 * math.asin(math.sqrt(h)), abs=0.0501)


def test_distances_round_as_numbers_do(spark):
    x = [0.0, 0.05, 0.15, 0.25, 0.35, 0.049999999999999996, 0.45, 1e-300, 2.5, 12345.65, 99999.95, 2.0**52 + 1, 1e300, math.inf] + [k / 40 for k in range(2000)]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(geo.rounded(F.col("x"), 1).alias("a"), geo.rounded_distance(F.col("x"), 1).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_many_points_and_centres_at_a_place(spark):
    """Places meet, not all points with all centres: 2.5 billion pairs here."""
    points = spark.range(50_000).select(F.col("id").alias("point_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    centres = spark.range(50_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.lit(4.0).alias("x"), F.lit(6.0).alias("y"))
    began = time.time()
    assert places.nearest(points, centres, 5.0).groupBy("name", "distance_m").count().collect() == [("c00000", 5.0, 50_000)]
    assert time.time() - began < 30


def test_hulls_are_dug_in():
    shape = [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20), (5, 5)]
    assert geometry.concave_hull(shape, 60).tolist() == [[0, 0], [20, 0], [20, 10], [10, 20], [0, 20]]
    assert geometry.concave_hull(shape[:-1], 1.3).tolist() == [[0, 0], [20, 0], [20, 10], [10, 10], [10, 20], [0, 20]]
    assert geometry.concave_hull([(0, 0), (1, 1), (2, 2)]) is None and geometry.concave_hull([(0, 0), (1, 1)]) is None


def test_unsound_rings_stay():
    bowtie = np.array([(0, 0), (100, 100), (0, 100), (100, 0)], float)
    assert not geometry.is_simple(bowtie) and (geometry.smooth(bowtie, []) == bowtie).all()
    angles = np.arange(16) / 16 * 2 * np.pi
    star = np.stack([np.cos(angles), np.sin(angles)], axis=1) * np.where(np.arange(16) % 2, 4.0, 100.0)[:, None]
    assert (geometry.smooth(star, []) == star).all()  # its area would change too much
    assert not geometry.is_simple(np.array([(0, 0), (9, 0), (5, 0), (5, 5)], float)) and not geometry.is_simple(np.array([(0, 0), (1, 1), (np.nan, 0)]))


def test_unions_match_points():
    """Points are in the union if and only if they are in an outer border and in no hole."""
    rng = np.random.default_rng(7)
    for _ in range(25):
        rings = []
        for _ in range(rng.integers(2, 6)):
            t = np.sort(rng.random(rng.integers(3, 12))) * 2 * np.pi
            ring = np.stack([np.cos(t), np.sin(t)], axis=1) * (10 + 20 * rng.random((len(t), 1))) + 50 * rng.random(2)
            rings += [ring] * geometry.is_simple(ring)
        if rings:
            points = rng.random((3000, 2)) * 130 - 40
            borders = geometry.union(rings)
            depth = sum(np.sign(geometry._signed(r)) * geometry.inside(r, points) for r in borders)
            assert (np.any([geometry.inside(r, points) for r in rings], axis=0) == (depth == 1)).all()
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    shared = geometry.union([square, square + (10, 0), square + (20, 10)])  # a common edge, and a corner that touches
    assert sorted(geometry.area(r) for r in shared) == pytest.approx([100, 200])
    frame = geometry.union([np.array(r, float) for r in ([(0, 0), (9, 0), (9, 1), (0, 1)], [(0, 8), (9, 8), (9, 9), (0, 9)], [(0, 0), (1, 0), (1, 9), (0, 9)], [(8, 0), (9, 0), (9, 9), (8, 9)])])
    assert sorted(geometry._signed(r) for r in frame) == pytest.approx([-49, 81])


def test_strips_that_straddle_a_hull_join_it():
    hull = np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float)
    strip = np.array([(90, 40), (130, 40), (130, 60), (90, 60)], float)
    joined = geometry.dissolve(hull, [strip], [(50, 50), (0, 0)])
    assert geometry.area(joined) == pytest.approx(10_600) and len(joined) == 8
    for other in (strip + (500, 0), strip - (60, 0), strip * np.nan):  # apart, inside, not finite
        assert geometry.dissolve(hull, [other], []) is hull
    assert geometry.dissolve(hull, [strip], [(500, 500)]) is hull  # a stop that neither has
    bowtie = np.array([(0, 0), (100, 100), (0, 100), (100, 0)], float)
    assert geometry.dissolve(bowtie, [strip], []) is bowtie


def test_station_document(spark):
    """Concourses, platforms and exits of an extract, in this order; an exit too far from every station is left out."""
    at = lambda x, y: (12.5 + x / 82_800, 41.9 + y / 111_320)
    node = lambda i, x, y, **tags: ("node", i, *at(x, y), tags, None, None)
    rows = [node(i, 40.0 * i, 0.0) for i in range(1, 60)] + [node(100, 400, -3, name="Termini"), node(101, 1600, -3, name="Jonio"), node(102, 1601, 5, name="Jonio")]
    rows += [node(200, 430, 60, railway="subway_entrance", ref="1"), node(201, 380, -70, railway="subway_entrance"), node(202, 1600, 90, railway="subway_entrance", name="Est"), node(203, 9000, 0, railway="subway_entrance")]
    rows += [("way", 1, None, None, {"railway": "subway"}, list(range(1, 60)), None), ("way", 2, None, None, {"railway": "subway"}, [999], None)]
    stop = lambda n: ("node", n, "stop")
    rows += [("relation", 10, None, None, {"route": "subway", "ref": "B"}, None, [stop(100), stop(101)]), ("relation", 11, None, None, {"route": "subway", "ref": "A"}, None, [stop(102), stop(777)]), ("relation", 12, None, None, {"route": "tram", "ref": "A"}, None, [stop(100)])]
    out = stations.of_extract(spark.createDataFrame(rows, osm_pbf.SCHEMA)).orderBy("layer", "station", "rel_id", "seq", "exit_id").collect()
    docs = [json.loads(r.feature) for r in out]
    assert [(d["properties"]["kind"], d["properties"]["station"]) for d in docs] == [("concourse", "jonio"), ("concourse", "termini"), ("platform", "jonio"), ("platform", "jonio"), ("platform", "termini"), ("exit", "jonio"), ("exit", "termini"), ("exit", "termini")]
    assert docs[4]["properties"] == {"kind": "platform", "station": "termini", "line": "B1", "color": "#0570B5", "level": -1, "name": "dir. Jonio"}
    assert docs[3]["properties"] == {"kind": "platform", "station": "jonio", "line": "A", "color": "#E27439", "level": -1}  # its last stop is missing
    assert [d["properties"]["name"] for d in docs[5:]] == ["Est", "Uscita 1", "Uscita"]
    for d in docs[:5]:
        ring = np.array(d["geometry"]["coordinates"][0])
        assert d["geometry"]["type"] == "Polygon" and (ring[0] == ring[-1]).all() and geometry.is_simple(ring[:-1])
    termini = np.array(docs[1]["geometry"]["coordinates"][0])[:-1]
    assert geometry.covers(termini, at(400, -3)) and not geometry.covers(termini, at(600, 0))
    assert docs[5]["geometry"] == {"type": "Point", "coordinates": [round(x, 7) for x in at(1600, 90)]}


def test_nearest_ties(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "point_id long, x double, y double")
    c = spark.createDataFrame([("b", 10.0, 0.0), ("a", -10.0, 0.0)], "name string, x double, y double")
    assert [(r.point_id, r.name) for r in places.nearest(p, c, 400.0).collect()] == [(1, "a")]


def test_legs_are_not_shuffled_to_a_large_index_of_which_they_need_little(spark, sf_dir):
    from stoplake.plans import itinerary_queries

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        plan = itinerary_queries.factors(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "key_route" in x]


def test_an_index_of_stops_holds_what_legs_name(spark):
    index = spark.createDataFrame([("R", 0, "1", 0.5), ("R", 0, "2", 0.25), ("Q", 1, "1", 1.0)], "route_id string, direction_id int, stop_id string, on_time_rate double")
    stops = spark.createDataFrame([(True, "F:R", None, "F:1"), (None, "R", 0, "1"), (False, "Q", 1, "1"), (None, None, 1, "1")], "transit_leg boolean, route_id string, direction_id int, stop_id string")
    assert itineraries.index_of_stops(index, stops, ["on_time_rate"]).collect() == [("R", 0, "1", 0.5)]
