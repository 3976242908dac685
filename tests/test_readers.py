"""Boundary files by byte ranges against a plain parse."""

import json
import random

import pytest
from pyspark.sql import functions as F

from isohyet.sources import csv_folder, geojson


@pytest.fixture
def small_ranges(spark):
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def collection(n, seed=1):
    rng = random.Random(seed)
    odd = ['}{', '"', '\\', '\\"}', '{"type":"Feature"}', "é{", "]}", "\\u007b", "", "plain", "\n{\t"]
    features = []
    for i in range(n):
        ring = [[round(rng.random(), 3), round(rng.random(), 3)] for _ in range(rng.randint(0, 60))]
        props = {"name": "".join(rng.choice(odd) for _ in range(4)), "n": i, "inner": {"a": {"b": "}"}}, "none": None}
        features.append({"type": "Feature", "id": f"f{i}", "properties": props, "geometry": {"type": "Polygon", "coordinates": [ring]} if i % 5 else None})
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x}"}}, "features": features, "after": {"type": "other"}}


@pytest.mark.parametrize("size", [37, 300, 4096, 1 << 27])
def test_features_equal_a_plain_parse(spark, tmp_path, small_ranges, size):
    """One line and many, brackets and quotes in strings, ranges that cut features (and may hold none of their edges)."""
    many = 12 if size < 100 else 60
    want = {}
    for name, indent in (("one", None), ("lines", 2)):
        whole = collection(many, seed=len(name))
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=name == "one"), encoding="utf-8")
        want |= {(name, f["id"]): f for f in whole["features"]}
    (tmp_path / "empty.json").write_text('{"type":"FeatureCollection","features":[]}')
    small_ranges(size)
    rows = geojson.scan_features(spark, str(tmp_path)).withColumn("props", F.to_json("properties")).collect()
    assert len(rows) == len(want)
    for r in rows:
        f = want[(r.file.rsplit("/", 1)[1].split(".")[0], r.id)]
        assert (json.loads(r.geometry) if r.geometry else None) == f["geometry"]
        assert r.properties["name"] == f["properties"]["name"] and r.properties["n"] == str(f["properties"]["n"]) and json.loads(r.properties["inner"]) == f["properties"]["inner"]


def test_columns_under_canonical_names(spark, tmp_path):
    def put(name, *props):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": None} for p in props]}))
        return str(tmp_path / name)

    blocks = geojson.block_boundaries(spark, put("b", {"Sub_dist": " Aland ", "District": "Kalaburagi", "STATE_UT": "Karnataka", "Subdis_LGD": 5}, {"District": "x", "BLOCK": "not asked"}))
    assert [(r.block_name, r.district_name, r.state_name, r.block_type, r.block_lgd_code) for r in blocks.orderBy("place").collect()] == [("Aland", "Kalaburagi", "Karnataka", None, "5"), (None, "x", None, None, None)]
    other = geojson.block_boundaries(spark, put("o", {"no": 7, "TALUK": "t", "STATE_LGD": 29})).first()
    assert (other.block_name, other.district_name, other.state_name) == ("t", "Unknown", "29")
    text = geojson.district_boundaries(spark, put("t", {"no": 7, "label": " Goa ", "z": "y"}, {"no": 8})).orderBy("place").collect()
    assert [(r.district_name, r.state_name) for r in text] == [("Goa", "Unknown"), (None, "Unknown")]
    bare = geojson.district_boundaries(spark, put("n", {"no": 7})).first()
    assert bare.district_name == "0-0"


@pytest.mark.parametrize("size", [20, 1 << 27])
def test_headers_of_one_folder(spark, tmp_path, small_ranges, size):
    """Each file under its own header: order, quotes, repeated and missing columns, a value column that holds no number."""
    (tmp_path / "in").mkdir()
    files = {
        "a.csv": "year,value,model\n2000,1.5,A\n2001,,A\n2002,x,A\n",
        "b.csv": "\ufeffmodel,mean of year,year\n\"B, \"\"b\"\"\",2.5,2000\n\n,3.5,2001\n",
        "in/c.csv": "value,year,note,amount,amount\nnone,2000,7,4.5,9\nnone,2001,n,5.5\n",
        "d.csv": "year,model\n2000,D\n", "e.csv": "year,value\n", "f.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    small_ranges(size)
    got = csv_folder.yearly_series(spark, str(tmp_path), ("model", "state")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("A", None, 2000, 1.5), ('B, "b"', None, 2000, 2.5), (None, None, 2001, 3.5), (None, None, 2000, 7.0)], key=str)
    rows = csv_folder.scan_headed(spark, str(tmp_path)).where("file like '%c.csv'").collect()
    assert [r.fields["amount"] for r in sorted(rows, key=lambda r: r.fields["year"])] == ["4.5", "5.5"]
