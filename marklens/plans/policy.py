"""Policies: which transforms a run plans for a format, and what is kept; from fixed rows or a TOML file.

``python -m marklens.plans.policy digest|show|snapshot [--policy FILE] [--out FILE]`` prints a policy's digest, its facts as JSON,
or all of it as a page to read.
"""

from __future__ import annotations

import hashlib
import json
import sys
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classes import SUPPORTED

# Id, name, order, kind, formats, classes it targets.
IMAGES, TEXTS = ["png", "jpeg", "webp"], ["text", "svg", "html"]
TRANSFORMS = [
    ("MC01", "strip-c2pa-manifest", 10, "metadata", [*IMAGES, "riff-wav", "isobmff", *TEXTS], ["c2pa"]),
    ("MC02", "strip-xmp", 20, "metadata", IMAGES, ["xmp", "iptc"]),
    ("MC03", "strip-exif", 30, "metadata", IMAGES, ["exif"]),
    ("MC04", "strip-png-text", 40, "metadata", ["png"], ["png_text"]),
    ("MC05", "strip-audio-tags", 50, "metadata", ["riff-wav", "mp3", "isobmff"], ["id3", "ilst"]),
    ("MC13", "strip-ape-tag", 52, "metadata", ["mp3"], ["ape"]),
    ("MC14", "rewrite-info-frame", 54, "metadata", ["mp3"], ["mp3_info"]),
    ("MC15", "scrub-ancillary-data", 56, "metadata", ["mp3"], ["mp3_ancillary"]),
    ("MC09", "strip-riff-ancillary", 60, "metadata", ["riff-wav", "webp"], ["riff_ancillary", "id3"]),
    ("MC12", "strip-wav-production-metadata", 62, "metadata", ["riff-wav"], []),
    ("MC10", "strip-vorbis-comment", 65, "metadata", ["flac"], ["vorbis"]),
    ("MC06", "strip-unlisted-chunks", 70, "metadata", ["png", "webp", "riff-wav", "flac"], []),
    ("MC11", "strip-jpeg-segments", 72, "metadata", ["jpeg"], []),
    ("MC07", "strip-invisible-unicode", 80, "text", TEXTS, ["invisibles"]),
    ("MC08", "strip-generator-headers", 90, "text", TEXTS, []),
    ("PX03", "border-crop", 100, "pixel", IMAGES, []),
    ("PX02", "resize", 120, "pixel", IMAGES, ["dwtdct"]),
    ("PX01", "re-encode", 150, "pixel", ["jpeg"], []),
    ("AU06", "highpass", 250, "audio", ["riff-wav", "flac", "mp3"], []),
    ("AU03", "re-encode", 260, "audio", ["mp3"], []),
]
LABELS = {
    "c2pa": "C2PA manifest", "png_text": "PNG text chunk", "exif": "EXIF metadata", "xmp": "XMP packet", "iptc": "IPTC block", "id3": "ID3 tag",
    "ape": "APE tag", "mp3_info": "information frame identity", "mp3_ancillary": "MPEG ancillary data", "vorbis": "Vorbis comment",
    "ilst": "MP4 ilst tag", "riff_ancillary": "RIFF ancillary chunk", "invisibles": "invisible Unicode", "dwtdct": "dwtDct pixel mark",
    "synthid_image": "SynthID-Image", "tree_ring": "Tree-Ring", "stable_signature": "Stable Signature", "synthid_audio": "SynthID-Audio",
    "audioseal": "AudioSeal", "visible_overlay": "visible overlay", "c2pa_soft_binding": "C2PA soft binding", "generative_fingerprint": "generative fingerprint",
}
DEGRADES = ("pixel", "audio")
#: Planned and reported, but run by nothing here: the owner has not confirmed them.
NOT_RUN_HERE = {"MC01", *(t[0] for t in TRANSFORMS if t[3] in DEGRADES)}
SCHEMA = "id string, name string, place int, kind string, formats array<string>, targets array<string>"


@dataclass
class Policy:
    version: str = "built in"
    digest: str | None = None
    transforms: list[tuple] = field(default_factory=lambda: list(TRANSFORMS))
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))
    notes: dict[str, str] = field(default_factory=dict)
    citations: dict[str, str] = field(default_factory=dict)
    held: list[tuple[str, str, str]] = field(default_factory=list)  # id, name, reason: transforms that are not run
    guards: list[tuple[str, str, str]] = field(default_factory=list)  # id, name, what it says
    allowed: list[str] = field(default_factory=list)  # what no transform takes away
    floors: tuple[float, float] = (25.0, 0.6)  # least PSNR in dB and SSIM of a changed picture

    def __post_init__(self) -> None:
        """Rows that come from no file have a digest of their own, so that every report names what it was made by."""
        if self.digest is None:
            rows = json.dumps([self.version, self.transforms, self.labels, self.notes, self.citations, self.held, self.guards, self.allowed, self.floors], sort_keys=True)
            self.digest = f"sha256:{hashlib.sha256(rows.encode()).hexdigest()}"


def digest(text: str, signatures: dict[str, str]) -> str:
    """SHA-256 over a policy file, whatever digest it states, and its signature files by path; line ends count as LF."""
    lines = text.replace("\r\n", "\n").splitlines(keepends=True) if "\r" not in text.replace("\r\n", "\n") else [x + "\n" for x in text.replace("\r\n", "\n").split("\n")]
    body = "".join('digest = ""\n' if line.lstrip().startswith("digest = ") else line for line in lines)
    sha = hashlib.sha256(b"policy.toml\0" + body.encode())
    for path in sorted(signatures):
        sha.update(b"\0" + path.encode() + b"\0" + signatures[path].replace("\r\n", "\n").encode())
    return f"sha256:{sha.hexdigest()}"


def signature_list(text: str) -> list[str]:
    """Entries of a signature file: lines but for blank ones and comments."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def load(path: str, signatures: dict[str, str] | None = None) -> Policy:
    """A policy file: tables mark_class, transform, held, guard, allowlist and sanity; a key that lacks in one that is there fails, and so
    does a degrading transform without a cited effect. Targets are the fixed ones; without sanity, so are the floors."""
    text = Path(path).read_text()
    read = tomllib.loads(text)
    targets = {t[0]: t[5] for t in TRANSFORMS}
    for t in read["transform"]:
        if t["kind"] in DEGRADES and not t.get("cited_effect"):
            raise ValueError(f"{t['id']} degrades and cites no effect")
    return Policy(
        read["policy"]["version"], digest(text, signatures or {}),
        sorted(((t["id"], t["name"], t["order"], t["kind"], t["applies"], targets.get(t["id"], [])) for t in read["transform"]), key=lambda t: t[2]),
        {m["id"]: m["label"] for m in read["mark_class"]}, {m["id"]: m["guard"] for m in read["mark_class"]},
        {m["id"]: m["citation"] for m in read["mark_class"] if m.get("citation")},
        [(h["id"], h["name"], h["reason"]) for h in read.get("held", [])], [(g["id"], g["name"], g["guard"]) for g in read.get("guard", [])],
        [*read.get("allowlist", {}).get("keep", [])], (float(read["sanity"]["psnr_floor_db"]), float(read["sanity"]["ssim_floor"])) if "sanity" in read else Policy.floors,
    )


def shown(policy: Policy) -> str:
    """A policy's facts as one JSON object."""
    facts = {"version": policy.version, "digest": policy.digest, "supported_containers": SUPPORTED, "transforms": [t[0] for t in policy.transforms], "held": [h[0] for h in policy.held]}
    return json.dumps(facts)


def snapshot(policy: Policy) -> str:
    """A policy as a page: its steps in order, mark classes, what is held, guards, and floors."""
    rows = lambda found, lead="- ": [f"{lead}{' | '.join(str(x) for x in row if x not in (None, ''))}" for row in found]
    parts = {
        "Steps": rows((t[0], t[1], t[3], ", ".join(t[4])) for t in policy.transforms),
        "Mark classes": rows((c, label, policy.notes.get(c), policy.citations.get(c)) for c, label in policy.labels.items()),
        "Held": rows(policy.held), "Guards": rows(policy.guards), "Never taken away": rows((a,) for a in policy.allowed),
        "Floors": rows([("PSNR in dB", policy.floors[0]), ("SSIM", policy.floors[1])]),
    }
    return "\n".join([f"# Policy {policy.version}", "", policy.digest or "", *(line for title, lines in parts.items() if lines for line in ("", f"## {title}", "", *lines))]) + "\n"


def main(arguments: list[str]) -> int:
    """See the module. 2 for wrong arguments or a place that can't be written, 30 for a policy that can't be read, else 0."""
    options = dict(zip(arguments[1::2], arguments[2::2]))
    made = {"digest": lambda p: f"{p.digest}\n", "show": lambda p: shown(p) + "\n", "snapshot": snapshot}.get(arguments[0] if arguments else "")
    if made is None or len(arguments) % 2 == 0 or set(options) - {"--policy", "--out"}:
        print("policy: digest, show or snapshot, perhaps --policy FILE and --out FILE", file=sys.stderr)
        return 2
    try:
        policy = load(options["--policy"]) if "--policy" in options else Policy()
    except (OSError, ValueError, KeyError, TypeError) as e:
        print(f"policy: {e}", file=sys.stderr)
        return 30
    try:
        Path(options["--out"]).write_text(made(policy)) if "--out" in options else sys.stdout.write(made(policy))
    except OSError as e:
        print(f"policy: {e}", file=sys.stderr)
        return 2
    return 0


def transform_table(spark: SparkSession, policy: Policy) -> DataFrame:
    return spark.createDataFrame(policy.transforms, SCHEMA)


def class_labels(spark: SparkSession, policy: Policy) -> DataFrame:
    rows = [(c, label, policy.notes.get(c), policy.citations.get(c)) for c, label in policy.labels.items()]
    return spark.createDataFrame(rows, "class string, label string, note string, citation string")


def check_keeps(policy: Policy, keep: list[str]) -> None:
    known = {x.lower() for t in policy.transforms for x in (t[0], t[1], *t[5])} | {c.lower() for c in policy.labels}
    if unknown := [k for k in keep if k.lower() not in known]:
        raise ValueError(f"keep names no transform or mark class: {', '.join(unknown)}")


def planned(spark: SparkSession, policy: Policy | None = None, keep: list[str] = (), no_degrade: bool = False) -> DataFrame:
    """format, place, id, name, targets, runs, reason, run_here: the default run of every format, in order, and what the
    options keep and why. A transform is kept by its id, its name or a class it targets, in any case."""
    policy = policy or Policy()
    check_keeps(policy, list(keep))
    rows = transform_table(spark, policy).select("*", F.explode("formats").alias("format"))
    names = F.transform(F.concat(F.array("id", "name"), "targets"), F.lower)
    asked = F.array(*(F.lit(k) for k in keep)).cast("array<string>")
    first = F.try_element_at(F.filter(asked, lambda k: F.array_contains(names, F.lower(k))), F.lit(1))
    reason = F.when(F.lit(no_degrade) & F.col("kind").isin(*DEGRADES), "left as it is: no_degrade").otherwise(F.concat(F.lit("left as it is: keep "), first))
    rows = rows.withColumn("reason", reason)
    return rows.select("format", "place", "id", "name", "kind", "targets", F.col("reason").isNull().alias("runs"), "reason", (~F.col("id").isin(*NOT_RUN_HERE)).alias("run_here"))


def targeted(plan: DataFrame) -> DataFrame:
    """format, targeted: the distinct classes that a format's run strips, by its order."""
    steps = F.array_sort(F.collect_list(F.struct("place", "targets")))
    return plan.where("runs").groupBy("format").agg(F.array_distinct(F.flatten(F.transform(steps, lambda s: s["targets"]))).alias("targeted"))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
