"""Policies, plans, reports and verification against them."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.functions import samples
from marklens.operators import pixelmark, report
from marklens.plans import policy
from test_containers import FILES, jpeg, png, riff
from test_pixelmark import as_jpeg, drawn
from test_webp import written

TEXTS = {20: "a​b".encode(), 21: b"plain", 22: ("x" + "️" * 12).encode(), 23: b"OggS....", 24: b"\xc0" * 40}


def assets(spark, more=()):
    rows = [(i, bytearray(c)) for i, c in [*FILES.items(), *TEXTS.items(), *more]] + [(12, None)]
    return spark.createDataFrame(rows, "asset_id long, content binary")


def test_plan_keeps_and_targets(spark):
    plan = policy.planned(spark, keep=["ID3", "strip-xmp", "mc11"], no_degrade=True).collect()
    of = {(r["format"], r["id"]): r["reason"] for r in plan}
    assert of["riff-wav", "MC05"] == of["riff-wav", "MC09"] == "left as it is: keep ID3" and of["png", "MC02"] == "left as it is: keep strip-xmp"
    assert of["jpeg", "MC11"] == "left as it is: keep mc11" and of["jpeg", "PX02"] == "left as it is: no_degrade" and of["png", "MC04"] is None
    got = {r["format"]: r["targeted"] for r in policy.targeted(policy.planned(spark, keep=["exif"])).collect()}
    assert got["webp"] == ["c2pa", "xmp", "iptc", "riff_ancillary", "id3", "dwtdct"] and got["text"] == ["c2pa", "invisibles"]
    with pytest.raises(ValueError):
        policy.planned(spark, keep=["xing"])
    assert not any(r["run_here"] for r in plan if r["id"] in ("MC01", "PX01", "AU03"))


def test_policy_file(tmp_path):
    body = '[policy]\nversion = "7"\ndigest = "x"\n[[mark_class]]\nid = "a"\nlabel = "A"\nguard = "g"\n[[transform]]\nid = "T2"\nname = "t"\norder = 2\nkind = "metadata"\napplies = ["png"]\n[[transform]]\nid = "MC03"\nname = "e"\norder = 1\nkind = "metadata"\napplies = ["png"]\n'
    (tmp_path / "p.toml").write_text(body)
    p = policy.load(str(tmp_path / "p.toml"), {"b": "1\r\n", "a": "2"})
    assert [t[0] for t in p.transforms] == ["MC03", "T2"] and p.transforms[0][5] == ["exif"] and p.labels == {"a": "A"}
    assert p.digest == policy.digest(body.replace('"x"', '"other"').replace("\n", "\r\n"), {"a": "2", "b": "1\n"}) != policy.digest(body, {})
    (tmp_path / "q.toml").write_text(body.replace('"metadata"\napplies = ["png"]\n[[', '"pixel"\napplies = ["png"]\n[['))
    with pytest.raises(ValueError):
        policy.load(str(tmp_path / "q.toml"))
    assert policy.signature_list("# c\n\n a b \nc") == ["a b", "c"]


def test_reports(spark):
    found = report.detections(assets(spark), pixels=False).cache()
    got = {r["asset_id"]: json.loads(r["value"]) for r in report.as_json(report.reports(found)).collect()}
    assert set(got) == {*FILES, *TEXTS, 12}
    states = {i: {s["class"]: s["state"] for s in r["scan_states"]} for i, r in got.items()}
    assert states[1]["png_text"] == "confirmed_present" and states[20]["invisibles"] == "confirmed_present" and states[22]["invisibles"] == "malformed" and "c2pa" not in states[21]
    assert states[23] == {"synthid_audio": "not_attempted", "audioseal": "not_attempted", "c2pa_soft_binding": "not_attempted"}
    assert {i: r["exit_code"] for i, r in got.items() if r["exit_code"]} == {2: 30, 11: 30, 13: 30, 22: 30, 12: 40, 24: 40}
    assert got[20]["findings"][0]["locations"] == [{"container": "text", "offset": 1, "length": 3, "detail": "invisible character"}]
    assert [f["class"] for f in got[1]["findings"]] == ["png_text", "xmp"] and got[1]["findings"][0]["evidence"] == ["parameters"] and got[1]["policy_digest"] == policy.Policy().digest
    assert got[1]["survived"][0]["transform"] == "PX03, PX02" and {f["class"] for f in got[22]["findings"]} == {"invisibles"}
    assert {r["asset_id"] for r in report.findings(found).collect()} == {i for i, r in got.items() if r["findings"]}
    text = {r["asset_id"]: r["value"] for r in report.as_text(report.reports(found, keep=["exif"])).collect()}
    assert "  invisible Unicode: confirmed_present\n" in text[20] and "findings:\n  invisible Unicode: confirmed_present\n    at 1, 3 bytes: text invisible character\n    1 invisible characters\n" in text[20] and "kept:\n  MC03 strip-exif: left as it is: keep exif\n" in text[1] and text[12].endswith("exit: 40\n")


def test_verify_against_a_report(spark):
    outputs = report.detections(assets(spark), pixels=False)
    own = {"policy_digest": policy.Policy().digest}
    said = {1: own | {"stripped_and_proven_gone": ["XMP packet"], "output_format": "png"}, 3: own | {"stripped_and_proven_gone": ["EXIF metadata"], "output_format": "jpeg"},
            8: {"output_format": "webp", "policy_digest": "other"}, 21: own, 20: {}, 23: own, 2: own, 4: {"policy_digest": None}}
    rows = [(i, json.dumps(v)) for i, v in said.items()] + [(6, "{not json")]
    made = spark.createDataFrame(rows, "asset_id long, value string")
    got = {r["asset_id"]: (r["exit_code"], r["problems"]) for r in report.verified_against(made, outputs).collect()}
    assert got[1] == (10, ["XMP packet was gone and is back"]) and got[3] == got[21] == (0, [])
    assert got[20] == got[4] == (10, ["the report is not of this policy"])  # a report that names no policy proves nothing
    assert got[8][0] == 10 and len(got[8][1]) == 2 and got[6] == (10, ["the report can't be parsed"]) and got[23][0] == 40 and got[2][0] == 30 and got[7][0] == 10
    in_rows = report.verified_against(made, report.inspected(assets(spark), pixels=False))
    assert {r["asset_id"]: (r["exit_code"], r["problems"]) for r in in_rows.collect()} == got
    other = policy.Policy(version="2")
    assert other.digest != policy.Policy().digest == policy.Policy().digest
    assert report.verified_against(made, outputs, other).where("asset_id = 21").first()["exit_code"] == 10


def test_nothing_is_shuffled_or_read_twice(spark):
    rows = assets(spark).repartition(2)
    found = report.with_found(rows.withColumn("value", F.lit("{}")), "content", "format", "found")
    for df in (report.verified(found), report.reports(report.inspected(rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(asset_id" not in plan and plan.count("Scan ExistingRDD") <= 2  # the assets, and the plan per format
        assert plan.count("ArrowEvalPython") <= 3  # walks, spans, votes: each once


def as_webp(picture):
    return written([[0xFF000000 | r << 16 | g << 8 | b for r, g, b in line] for line in picture.tolist()], random.Random(1), (2,))


def test_pixel_rows(spark):
    one, two = pixelmark.PAYLOADS.values()
    wrong = drawn(one, 8, 8, wrong=range(10))
    half = as_jpeg(np.full((64, 64, 3), 120, np.uint8), [(2, 2), (1, 1), (1, 1)])
    files = {1: samples.png_of(drawn(one, 8, 8)), 2: samples.png_of(drawn(two, 12, 12)), 3: samples.png_of(drawn(one, 6, 7)), 4: samples.png_of(wrong), 5: half,
             6: as_jpeg(drawn(one, 8, 8), [(1, 1)] * 3), 7: png(), 8: riff(b"WEBP", (b"VP8 ", b"abc")), 9: b"text", 10: riff(b"WEBP", (b"VP8L", b"abc")), 11: as_webp(drawn(one, 8, 8))}
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in files.items()], "asset_id long, content binary")
    found = {r["asset_id"]: r for r in report.detections(rows).where("class = 'dwtdct'").collect()}
    assert {i: r["state"] for i, r in found.items()} == {1: "confirmed_present", 2: "confirmed_present", 3: "confirmed_absent", 4: "confirmed_absent", 5: "unsupported_format", 6: "confirmed_present", 7: "malformed", 8: "unsupported_format", 10: "malformed", 11: "confirmed_present"}
    assert found[1]["honesty"] == "confirmable" and found[1]["label"] == "dwtDct pixel mark" and found[1]["evidence"][0].endswith("in 64 blocks, 0.80 are needed: found")
    made = {r["asset_id"]: r for r in report.reports(report.inspected(rows)).collect()}
    assert [f["class"] for f in made[1]["findings"]] == ["dwtdct"] and made[7]["exit_code"] == 30 and made[5]["exit_code"] == 0
    assert [s["class"] for s in made[1]["scan_states"]][:5] == ["png_text", "c2pa", "exif", "xmp", "dwtdct"]


def test_before_and_after(spark):
    before = report.detections(assets(spark).where("asset_id IN (3, 20)"), pixels=False)
    clean = spark.createDataFrame([(3, bytearray(jpeg())), (20, bytearray(b"ab"))], "asset_id long, content binary")
    got = {(r["asset_id"], r["class"]): r["gone"] for r in report.changes(before, report.detections(clean)).collect()}
    assert got == {(3, "xmp"): True, (3, "c2pa"): True, (3, "iptc"): True, (20, "invisibles"): True}
    assert not any(r["gone"] for r in report.changes(before, before).collect())


def test_no_assets(spark):
    none = assets(spark).where(F.lit(False))
    assert report.reports(report.detections(none)).count() == 0
