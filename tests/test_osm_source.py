"""The map-data source against a parse of whole payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F
from waypost.sources import osm, osm_source


def payload(rng, n, first):
    elements = []
    for i in range(first, first + n):
        kind = rng.choice(["node", "way", "relation"])
        tags = {
            "tourism": rng.choice(["caravan_site", "camp_site", "hotel"]), "motorhome": rng.choice(["yes", "no", "designated"]),
            "name": rng.choice(["é\U0001f600 plek", 'zegt {"type":"node","id":1', "a\\b\n", ""]), "dog": "yes"
        }
        if rng.random() < 0.4:
            tags = {"amenity": "parking", "motorhome": rng.choice(["yes", "no"])}
        element = {"type": kind, "id": i}
        place = {"lat": rng.choice([52.5, 60.5, 0.0]), "lon": rng.choice([5.5, 2.5])}
        element |= place if kind == "node" else {"center": place}
        if kind == "relation":
            element["members"] = [{"type": "node", "ref": 7, "role": ""}, {"type": "way", "ref": 8, "role": "outer"}]
        elements.append(element | ({"tags": tags} if rng.random() < 0.9 else {}))
    return {"version": 0.6, "elements": elements}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, root = random.Random(4), tmp_path_factory.mktemp("osm")
    for k, shape in enumerate([{"indent": 2}, {}, {"ensure_ascii": False}]):
        (root / f"p{k}.json").write_text(json.dumps(payload(rng, 60, k * 100), **shape))
    (root / "lines.json").write_text("\n".join(json.dumps(payload(rng, 1, 400 + i)) for i in range(30)))
    (root / "none.json").write_text("not a payload")
    (root / "empty.json").write_text('{"elements": []}')
    return str(root)


def parsed(spark, folder):
    from pathlib import Path

    texts = [t for p in sorted(Path(folder).glob("*.json")) for t in (p.read_text().split("\n") if p.name == "lines.json" else [p.read_text()])]
    return osm.elements(spark.createDataFrame([(t,) for t in texts], "value string"), "value")


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_ranges_give_each_element_once(spark, folder, split):
    got = osm_source.read(spark, folder, split)
    rows = got.select("type", F.to_json("tags").alias("tags")).collect()
    want = parsed(spark, folder).select("e.type", F.to_json(F.coalesce("e.tags", F.create_map().cast("map<string,string>"))).alias("tags")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, want)) and len(rows) == 210
    assert got.select("id").distinct().count() == 210
    assert got.rdd.getNumPartitions() >= (100 if split == 97 else 4)


def test_search_equals_the_parse_of_whole_payloads(spark, folder):
    found = osm_source.search(spark, folder, 500)
    want = osm.ingest(parsed(spark, folder).filter(osm.in_search()))
    got = osm_source.places(found)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 5


def test_filters_reach_the_parse(spark, folder):
    found = osm_source.search(spark, folder).filter("tourism = 'camp_site' and motorhome like '%desig%' and id in (1, 2, 105, 210)")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    for pushed in ("(lat,50.75)", "(lon,7.23)", "IsNotNull(clause)", "(tourism,camp_site)", "(motorhome,desig)", "In(id, "):
        assert pushed in plan.split("PushedFilters")[1]
    assert " Filter " not in plan  # nothing is left for Spark
    left = osm_source.read(spark, folder).filter("lat + lon > 57 and clause is null")
    assert "Filter (" in left._jdf.queryExecution().executedPlan().toString() and left.count() > 0


def test_cut_off_payload_and_missing_folder(spark, tmp_path):
    whole = json.dumps(payload(random.Random(1), 20, 0))
    (tmp_path / "cut.json").write_text(whole[: len(whole) // 2])
    assert 5 < osm_source.read(spark, str(tmp_path)).count() < 15
    assert osm_source.read(spark, str(tmp_path / "nowhere")).count() == 0
