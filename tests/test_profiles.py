import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from chronoweave.functions import calibration, codecs
from chronoweave.plans.project import FORMATS
from chronoweave.sources import profiles


def write(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_trees_and_order(spark, tmp_path):
    one, two, empty = tmp_path / "a folder", tmp_path / "two", tmp_path / "empty"
    empty.mkdir()
    write(one, "x/p.json", {"name": "p"})
    write(one, "own.json", {"identifier": "shared", "name": "first"})
    write(one, ".git/hidden.json", {"name": "no"})
    write(one, "broken.json", "{")
    write(one, "x/state.preset", "whatever")
    write(one, "note.txt", "no")
    write(two, "own.json", {"identifier": "shared", "name": "second"})
    (two / "profiles.cbor.gz").write_bytes(gzip.compress(codecs.cbor([["__version", 3], ["b/q.json", {"name": "q"}], ["own.json", {"identifier": "shared"}], "odd", [1, 2]])))
    got = {r["key"]: r for r in profiles.tree(spark, str(one)).collect()}
    assert set(got) == {"x/p.json", "shared", "x/state.preset"} and got["x/state.preset"]["stub"]
    assert json.loads(got["x/state.preset"]["profile"])["name"] == "state" and len(json.loads(got["x/state.preset"]["profile"])["checksum"]) == 8
    found, notes = profiles.bundles(spark.read.format("binaryFile").load(str(two / "profiles.cbor.gz")))
    assert {r["key"] for r in found.collect()} == {"b/q.json", "shared"} and [(r["name"], r["value"]) for r in notes.collect()] == [("__version", "3")]
    assert profiles.bundles(spark.createDataFrame([("p", bytearray(b"no zip")), ("q", bytearray(gzip.compress(b"\xa0")))], "path string, content binary"))[0].count() == 0
    loaded = {r["key"]: r["profile"] for r in profiles.load(spark, [str(one), str(tmp_path / "missing")], [str(empty), str(two), str(one)]).collect()}
    assert set(loaded) == {"x/p.json", "shared", "x/state.preset", "b/q.json"} and json.loads(loaded["shared"])["name"] == "first"


def test_projects_keep_what_they_dont_know(spark, tmp_path):
    write(tmp_path, "p.json", '{\n "known": 1,\n "strange": {"deep": [1, "x", null]}\n}')
    write(tmp_path, "bad.json", "no json")
    got = profiles.projects(spark, str(tmp_path / "*.json"))
    assert got.where("project is null").count() == 1
    profiles.save(got.where("project is not null"), str(tmp_path / "out"))
    (text,) = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(text) == {"known": 1, "strange": {"deep": [1, "x", None]}}


def test_planes(spark):
    rows = spark.createDataFrame([(f[0], f[1], f[2], f[3]) for f in FORMATS] + [(None, 0, "", 0.0)], "name string, n int, channels string, top double")
    for r in rows.withColumn("p", calibration.planes(F.col("name"))).collect():
        made = r["p"] or []
        assert (len(made), "|".join(",".join(map(str, p["channels"])) for p in made)) == (r["n"], r["channels"]) and all(p["top"] == r["top"] for p in made)


def test_fits():
    k = np.array([0.02, -0.01, 0.003, 0.0])
    errors = [calibration.fit(m, k, 0.8)[1] for m in ("poly3", "poly5", "ptlens")]
    assert errors[1] < errors[0] and all(e < 0.05 for e in errors[1:]) and len(calibration.fit("ptlens", k, 0.8)[0]) == 3
