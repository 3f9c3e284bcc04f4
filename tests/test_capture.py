"""Manifest readers, claims of capture, MP3 walks, and files that are odd."""

import struct

from pyspark.sql import functions as F

from marklens.functions import manifest as M
from marklens.functions import mp3
from marklens.operators import capture, containers
from marklens.plans import queries
from test_containers import box, jpeg, png, riff


def jumb(kind, label, *inner):
    return box(b"jumb", box(b"jumd", kind + bytes(12) + b"\3" + label.encode() + b"\0") + b"".join(inner))


def cbor(x):
    head = lambda major, n: bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 25]) + struct.pack(">H", n)
    if isinstance(x, tuple):
        return head(6, x[0]) + cbor(x[1])
    if isinstance(x, int):
        return head(0, x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(cbor, x))
    return head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())


def der(tag, body):
    return bytes([tag, len(body)]) + body


def certificate(name):
    return der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x0a") + der(0x0C, name.encode()))))


def store(*manifests, referenced=True):
    made = []
    for label, actions, signer in manifests:
        acts = jumb(b"cbor", "c2pa.actions", box(b"cbor", cbor({"actions": actions})))
        claim = {"signature": "s", "assertions": [{"url": "self#jumbf=c2pa.assertions/" + ("c2pa.actions" if referenced else "other")}]}
        made.append(jumb(b"c2ma", label, jumb(b"c2as", "c2pa.assertions", acts), jumb(b"c2cl", "c2pa.claim", box(b"cbor", cbor(claim))),
                         jumb(b"c2cs", "c2pa.signature", box(b"cbor", cbor((18, [cbor({33: certificate(signer)}), {}, b"", b""]))))))
    return jumb(b"c2pa", "c2pa", *made)


TAKEN = {"action": "c2pa.created", "digitalSourceType": "http://x/digitalCapture"}
MADE = {"action": "c2pa.edited", "digitalSourceType": "http://x/trainedAlgorithmicMedia"}
NAMED = {"action": "c2pa.edited", "softwareAgent": {"name": "The Paintbot 3"}}


def test_readings(spark):
    whole = store(("m1", [TAKEN], "A"))
    cut = len(whole) // 2
    packet = lambda n, body: b"JP" + b"\0\1" + struct.pack(">I", n) + body
    files = {
        1: png((b"caBX", whole)),
        2: jpeg((b"\xeb", packet(1, whole[:cut])), (b"\xeb", packet(2, whole[:8] + whole[cut:]))),
        3: riff(b"WEBP", (b"C2PA", store(("m1", [TAKEN, MADE], "A")))),
        4: box(b"ftyp", b"M4A 0000") + box(b"uuid", bytes(20) + b"manifest\0" + store(("m1", [TAKEN], "A"), ("m2", [NAMED], "A"))),
        5: png((b"caBX", store(("m1", [NAMED], "Canon Inc."), ("m2", [], "B")))),
        6: png((b"caBX", store(("m1", [{"action": "c2pa.opened"}], "Canon Inc.")))),
        7: png((b"caBX", store(("m1", [TAKEN], "A"), referenced=False))),
        8: png((b"caBX", whole[:-3])),
        9: ("see" + queries.selectors_of(whole) + ".").encode(),
        10: b"plain",
        11: png((b"caBX", store(("m1", [MADE], "A")))),
    }
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in files.items()] + [(12, None)], "asset_id long, content binary")
    got = {r["asset_id"]: r for r in capture.readings(rows, ["canon"], ["paintbot"]).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "certified", 2: "certified", 3: "generative", 4: "generative", 5: "generative", 6: "certified", 7: "none", 8: "none", 9: "certified", 10: "none", 11: "none"}
    assert got[4]["claim"] == "manifest m1 c2pa.created with digitalSourceType digitalCapture; then c2pa.edited by paintbot in manifest m2"
    assert got[6]["claim"] == "manifest m1 signed by the camera vendor canon" and "not verified" in got[6]["line"] and got[10]["line"] == ""


def test_cbor_and_der():
    for x in (0, 23, 24, 1000, "ü", b"\0", [1, ["a"]], [], "x" * 300):
        assert M.cbor(cbor(x)) == x
    assert M.cbor(cbor({1: {"a": [2]}})).get(1).get("a") == [2] and M.cbor(b"\x20") == -1
    assert M.cbor(b"\x9f\x01\x02\xff") == [1, 2] and M.cbor(b"\x7f\x61a\x61b\xff") == "ab" and M.cbor(b"\xbf\x01\x02\xff").get(1) == 2
    assert M.cbor(b"\xf9\x3c\x00") == 1.0 and M.cbor(b"\xf9\xfc\x00") == float("-inf") and M.cbor(b"\xf5") is True and M.cbor(b"\xfb" + struct.pack(">d", 0.1)) == 0.1
    for bad in (b"", b"\x01\x01", b"\x62a", b"\xff", b"\x1c", b"\xbf\x01\xff", b"\x61\xff", b"\x81" * 70 + b"\x01", b"\x5f\x61a\xff"):
        assert M.cbor(bad) is None
    assert M.der(certificate("Ünit")) == ["Ünit"] and M.der(b"\x30\x84\xff") == [] and M.der(der(0x30, b"") * 3) == []
    whole = store(("m1", [TAKEN], "A"))
    assert M.manifests(whole) == [("m1", [("c2pa.created", "http://x/digitalCapture", None)], ["A"])]
    for cut in range(0, len(whole), 7):  # no prefix of a store is one
        assert M.manifests(whole[:cut]) is None


def mpeg(main=b"", kbits=9, first=True):
    """A mono frame of 128 kbit/s, its main data from its own region only."""
    size = 144_000 * 128 // 44100
    n = 8 * len(main)
    side = (0 << 127 | (n << 136 - 18 - 12)).to_bytes(17, "big")
    return (b"\xff\xfb" + bytes([kbits << 4, 0xC0]) + side + main).ljust(size, b"\0")


def test_mp3_walk():
    plain = mpeg(b"\1" * 100) * 3
    found, complete = mp3.walk(plain)
    assert complete and found == []
    filled = mpeg(b"\1" * 100)[:200] + b"LAME3.1" + bytes(len(mpeg()) - 207)
    found, complete = mp3.walk(plain + filled)
    assert complete and [(m.kind, m.detail, m.notes) for m in found] == [("ancillary", f"{7} nonzero bytes across 4 runs", ["LAME in 1 frames"])]
    id3 = b"ID3\4\0\0\0\0\0\6TSSE.."
    items = bytes(10)
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 1, 0) + bytes(8)
    whole = id3 + plain + items + ape + b"TAG" + bytes(125)
    found, complete = mp3.walk(whole)
    assert complete and [(m.kind, m.start, m.total, m.notes) for m in found] == [("ID3v2", 0, 16, ["TSSE frame"]), ("APE", 16 + len(plain), 42, []), ("ID3v1", len(whole) - 128, 128, [])]
    extension = b"LAME3.99r".ljust(21, b"\1") + bytes([0x24, 0x05, 0x76]) + bytes(12)
    info = (mpeg()[:21] + b"Xing" + struct.pack(">I", 5) + struct.pack(">I", 9) + bytes(100) + extension).ljust(len(mpeg()), b"\0")
    found, complete = mp3.walk(info + plain)
    assert complete and [(m.kind, m.detail, m.notes) for m in found] == [("info", "Xing tag, encoder LAME3.99r", ["delay 576, padding 1398", "toc"])]
    assert mp3.walk(info + plain + b"x")[0][0].broken and not mp3.walk(info + plain + b"x")[1]
    astray = bytearray(plain)
    astray[4] = 0xFF  # main data before the file
    found, complete = mp3.walk(bytes(astray))
    assert complete and [(m.kind, m.broken) for m in found] == [("ancillary", True)]
    for cut in range(0, len(whole), 11):
        mp3.walk(whole[:cut])


def test_odd_files(spark):
    film = riff(b"AVI ", (b"LIST", b"movi" + b"x" * 100_000), (b"LIST", b"INFO...."))
    packet = b"http://ns.adobe.com/xap/1.0/\0" + b'\xff\xfe xmp:CreatorTool="T\xe9"'
    rows = [(1, bytearray(film)), (2, bytearray(jpeg((b"\xe1", packet)))), (3, None), (4, bytearray(b"\xc0" * 9)), (5, bytearray(b"OggS" + bytes(30))), (6, bytearray(b"ID3\4\0\0\0\0\0\0" + mpeg(b"\1") * 2))]
    assets = spark.createDataFrame(rows, "asset_id long, content binary")
    assert max(len(r["payload"]) for r in containers.elements(assets).where("asset_id = 1").collect()) == 4
    assert [r["evidence"] for r in containers.marks(assets).where("asset_id = 2").collect()] == [["T�"]]
    state = {(r["asset_id"], r["class"]): r["state"] for r in containers.states(assets).collect()}
    assert state[3, None] == state[4, None] == "unsupported_format" and state[5, "audioseal"] == "not_attempted" and state[1, "riff_ancillary"] == "confirmed_present"
    assert state[6, "id3"] == "confirmed_present" and state[6, "ape"] == "confirmed_absent"


def test_files_over_the_cap_keep_a_row(spark, tmp_path):
    from marklens.sources import assets

    (tmp_path / "a.png").write_bytes(png())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.png").write_bytes(png((b"tEXt", b"x" * 500)))
    found = assets.files(spark, str(tmp_path), most_bytes=300)
    states = containers.states(found).join(found.select("asset_id", "path"), "asset_id")
    got = {(r["path"].split("/")[-1], r["class"]): r["state"] for r in states.where(F.expr("class IS NULL OR class = 'c2pa'")).collect()}
    assert got == {("a.png", "c2pa"): "confirmed_absent", ("b.png", None): "unsupported_format"}
    texts = assets.texts(spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string"), "doc_id", "text")
    assert [(r["asset_id"], r["length"], bytes(r["content"])) for r in texts.orderBy("asset_id").collect()] == [(1, 2, "é".encode()), (2, 0, b"")]
