"""The clean run over files of every format: outputs, proof, reports and exit codes, and the whole job from folder to folder."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_capture import TAKEN, mpeg, store
from test_containers import box, jpeg, png, riff
from test_mp4_mp3 import SEGMENTS, tags

from marklens.functions import jpeg as jpeg_, samples
from marklens.operators import clean, report
from marklens.plans import policy, queries
from marklens.sources import inputs

PLANE = np.zeros((2, 2, 64), int)
PICTURE = samples.png_of(np.full((16, 16, 3), 90, np.uint8))
TEXT_CHUNK = (b"tEXt", b"parameters\0steps")


def with_chunks(*chunks):
    """A whole PNG with chunks before its data."""
    made = png(*chunks)
    return PICTURE[:33] + made[33:-12] + PICTURE[33:]


def with_segments(*names):
    whole = jpeg_.of_coefficients(16, 16, [PLANE], [(1, 1)])
    return whole[:2] + jpeg(*(SEGMENTS[n] for n in names))[2:-4] + whole[2:]


SOUND, INFO = (b"data", bytes(64)), (b"LIST", b"INFOISFT")
FORM = (b"fmt ", b"\1\0\1\0\x40\x1f\0\0\x40\x1f\0\0\1\0\x08\0")
MOVIE = lambda *parts: box(b"ftyp", b"M4A 0000") + box(b"moov", box(b"udta", b"".join(parts))) + box(b"mdat", b"m")
WRAPPED = "see" + queries.selectors("store jumb box")
CASES = {  # content, output or None, exit code, what is proven gone
    1: (with_chunks(TEXT_CHUNK), PICTURE, 0, ["PNG text chunk"]),
    2: (PICTURE, PICTURE, 0, []),
    3: (with_chunks(TEXT_CHUNK, (b"caBX", b"jumb")), with_chunks((b"caBX", b"jumb")), 0, ["PNG text chunk"]),
    4: (with_segments("exif", "xmp", "note"), with_segments(), 0, ["EXIF metadata", "XMP packet"]),
    5: (riff(b"WAVE", FORM, INFO, SOUND, (b"id3 ", b"ID3")), riff(b"WAVE", FORM, SOUND), 0, ["ID3 tag", "RIFF ancillary chunk"]),
    6: (b"fLaC\0\0\0\2ab\x84\0\0\1cSOUND", b"fLaC\x80\0\0\2abSOUND", 0, ["Vorbis comment"]),
    7: (MOVIE(tags(9)), MOVIE(box(b"meta", bytes(4) + box(b"hdlr", b"h"))), 0, ["MP4 ilst tag"]),
    8: (b"ID3\4\0\0\0\0\0\0" + mpeg(b"\1" * 9) * 2, mpeg(b"\1" * 9) * 2, 0, ["ID3 tag"]),
    9: ("a​b\n<!-- made by a generator -->\nc".encode(), b"ab\nc", 0, ["invisible Unicode"]),
    10: (b"# generator: tool\nplain\n", b"plain\n", 0, []),
    11: (b"plain", b"plain", 0, []),
    12: (("x" + "️" * 12).encode(), None, 30, []),
    13: (with_chunks(TEXT_CHUNK)[:-4], None, 30, []),
    14: (b"OggS....", None, 40, []),
    15: (b"", None, 40, []),
    16: (None, None, 40, []),
    17: (b"\xc0" * 40, None, 40, []),
    18: (with_chunks((b"iTXt", b"XML:com.adobe.xmp\0see c2pa")), None, 10, []),  # a packet that names a manifest stays, so the mark is left
    19: (with_chunks(TEXT_CHUNK, (b"caBX", store(("m1", [TAKEN], "A")))), "same", 0, []),
    20: (WRAPPED.encode(), WRAPPED.encode(), 0, []),
    21: (("⁠" + "x" + "️" * 12).encode(), ("x" + "️" * 12).encode(), 0, ["invisible Unicode"]),
}


def frame(spark, cases=CASES):
    return spark.createDataFrame([(i, None if c[0] is None else bytearray(c[0])) for i, c in cases.items()], "asset_id long, content binary")


def test_every_format(spark):
    made = clean.cleaned(frame(spark)).cache()
    got = {r["asset_id"]: r for r in made.collect()}
    assert len(got) == len(CASES)
    for i, (content, wanted, code, gone) in CASES.items():
        wanted = content if wanted == "same" else wanted
        r = got[i]
        assert (r["output"] and bytes(r["output"]), r["exit_code"], sorted(r["stripped_and_proven_gone"])) == (wanted or None, code, gone), (i, r["error"])
        assert (r["error"] is None) == (code == 0) and r["no_op"] == (i in (2, 11, 20)), i
    outcome = {a["transform"]: (a["outcome"], a["result"]) for a in got[1]["actions"]}
    assert outcome["MC04"] == ("applied", "removed, and seen to be gone") and outcome["MC02"] == ("applied", "nothing of this kind was there")
    assert outcome["MC01"][0].startswith("not run here") and outcome["PX02"][0].startswith("not run here") and outcome["MC06"] == ("applied", "applied")
    assert {a["outcome"] for a in got[2]["actions"] if not a["outcome"].startswith("not run")} == {"no-op"}
    assert {a["outcome"] for a in got[19]["actions"]} == {"not run: certified capture"} and got[19]["kept"][0]["item"] == "the whole asset" and got[19]["capture"]["kept"]
    assert {s["class"]: s["state"] for s in got[3]["scan_states"]}["c2pa"] == "confirmed_present" and {s["class"]: s["state"] for s in got[21]["scan_states"]}["invisibles"] == "malformed"
    assert dict((a["transform"], a["result"]) for a in got[18]["actions"])["MC02"] == "some of this kind is left"
    assert got[1]["survived"][0]["transform"] == "none" and got[1]["policy_digest"] == policy.Policy().digest
    # outputs are verified by their reports, and by those alone
    said = made.where("exit_code = 0").select("asset_id", F.to_json(F.struct("policy_digest", "output_format", "stripped_and_proven_gone")).alias("value"), F.col("output").alias("content"))
    checked = {r["asset_id"]: r["exit_code"] for r in report.verified(report.with_found(said, "content", "format", "found")).collect()}
    assert {i: c for i, c in checked.items() if c} == {21: 30}
    inputs_again = said.drop("content").join(frame(spark), "asset_id").where("asset_id IN (1, 4, 5, 7, 8, 9)")
    assert {r["exit_code"] for r in report.verified(report.with_found(inputs_again, "content", "format", "found")).collect()} == {10}
    again = clean.cleaned(made.where("exit_code = 0 AND asset_id <> 21").select("asset_id", F.col("output").alias("content")))
    assert all(r["no_op"] or r["asset_id"] == 19 for r in again.collect())


def test_keeps_and_captures(spark):
    some = frame(spark, {i: CASES[i] for i in (1, 4, 9, 19)})
    got = {r["asset_id"]: r for r in clean.cleaned(some, keep=["png_text", "MC03", "MC07"], strip_capture=True).collect()}
    assert bytes(got[1]["output"]) == CASES[1][0] and got[1]["no_op"] and bytes(got[4]["output"]) == with_segments("exif")
    assert bytes(got[9]["output"]) == "a​b\nc".encode() and bytes(got[19]["output"]) == CASES[19][0] and not got[19]["capture"]["kept"]
    assert got[4]["stripped_and_proven_gone"] == ["XMP packet"] and {"item": "MC03 strip-exif", "reason": "left as it is: keep MC03"} in [k.asDict() for k in got[4]["kept"]]


def test_changed_pictures_are_measured(spark):
    """Pixels that another step changed go through if they are near enough, 50 if not, 30 if they can't be compared."""
    base = np.random.default_rng(1).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    files = {1: base & 0xFC, 2: 255 - base, 3: base[:8], 4: None}
    rows = [(i, bytearray(samples.png_of(base)), None if e is None else bytearray(samples.png_of(e.astype(np.uint8)))) for i, e in files.items()]
    got = {r["asset_id"]: r for r in clean.cleaned(spark.createDataFrame(rows, "asset_id long, content binary, edited binary")).collect()}
    assert {i: r["exit_code"] for i, r in got.items()} == {1: 0, 2: 50, 3: 30, 4: 0}
    assert got[1]["sanity"]["psnr_db"] > 25 and got[2]["output"] is None and got[4]["sanity"] is None and "PSNR" in got[2]["error"]


def test_each_step_once(spark):
    """Two inspections (walk, spans, votes), stores, the rewrite and the measures: no plan copies one, and nothing is shuffled by file."""
    plan = clean.cleaned(frame(spark).repartition(2))._jdf.queryExecution().executedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    counts = {name: sum(line.split("], [")[0].count(f"{name}(") for line in evaluated) for name in ("walk", "all_of", "vote", "each")}
    assert counts.pop("each") <= 3 and counts == {"walk": 2, "all_of": 2, "vote": 2} and "hashpartitioning(asset_id" not in plan


def test_from_folder_to_folder(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    for name, i in {"a/x.png": 1, "a/same.PNG": 2, "b/x.jpeg": 4, "b/t.txt": 9, "b/bad.png": 13, "b/odd.ogg": 14, "twice.png": 1, "twice.jpg": 1, "there.txt": 10}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(CASES[i][0])
    out.mkdir()
    (out / "there.txt").write_bytes(b"mine")
    made = clean.clean_files(inputs.inputs(spark, [str(root)]), str(out), str(tmp_path / "work"))
    got = {os.path.relpath(r["path"], root): r for r in made.collect()}
    assert {n: (r["decision"], r["exit_code"]) for n, r in got.items()} == {
        "a/x.png": ("write", 0), "a/same.PNG": ("no-op", 0), "b/x.jpeg": ("write", 0), "b/t.txt": ("write", 0), "b/bad.png": ("failed", 30), "b/odd.ogg": ("failed", 40),
        "twice.jpg": ("write", 0), "twice.png": ("collides", 2), "there.txt": ("write", 2),
    }
    assert (out / "a/x.png").read_bytes() == CASES[1][1] and (out / "b/x.jpg").read_bytes() == CASES[4][1] and (out / "there.txt").read_bytes() == b"mine"
    assert sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs) == ["a/x.png", "b/t.txt", "b/x.jpg", "there.txt", "twice.png"]
    assert json.loads(got["a/x.png"]["report"])["stripped_and_proven_gone"] == ["PNG text chunk"] and got["there.txt"]["outcome"] == "exists"


def test_no_files(spark):
    assert clean.cleaned(frame(spark).where("false")).count() == 0


def test_clashing_columns(spark):
    rows = frame(spark, {1: CASES[1]}).withColumn("label", F.lit(1)).withColumn("class", F.lit("x"))
    r = clean.cleaned(rows).first()
    assert r["label"] == 1 and r["class"] == "x" and r["exit_code"] == 0
    with pytest.raises(Exception):
        clean.cleaned(rows, keep=["unheard of"])
