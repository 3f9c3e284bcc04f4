"""Reports of a stream: every file once, over stops and restarts."""

import json

import numpy as np
from test_containers import png

from marklens.functions import samples
from marklens.streaming import inspect


def run(spark, tmp_path, **how):
    query = inspect.started(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), **how)
    query.awaitTermination()
    return {r["path"].split("/")[-1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    picture = samples.png_of(np.zeros((16, 16, 3), np.uint8))
    first = {"a.txt": "a​b".encode(), "sub/p.png": picture, "odd": b"\xc0" * 9, "empty": b"", "big.txt": b"x" * 500, "sub/bad.png": png()[:-5], "o.ogg": b"OggS...."}
    for name, content in first.items():
        (folder / name).write_bytes(content)
    got = run(spark, tmp_path, most_bytes=400)  # Spark's file sources don't list empty files
    assert {n: r["exit_code"] for n, r in got.items()} == {"a.txt": 0, "p.png": 0, "odd": 40, "big.txt": 40, "bad.png": 30, "o.ogg": 0}
    value = json.loads(got["a.txt"]["value"])
    assert value["findings"][0]["class"] == "invisibles" and got["a.txt"]["length"] == 5
    assert {s["class"] for s in json.loads(got["p.png"]["value"])["scan_states"]} >= {"dwtdct", "c2pa"}
    assert run(spark, tmp_path, most_bytes=400).keys() == got.keys()  # nothing new
    (folder / "later.txt").write_bytes(b"plain")
    (folder / "sub" / "q.png").write_bytes(picture)
    again = run(spark, tmp_path, most_bytes=400)
    assert again.keys() == got.keys() | {"later.txt", "q.png"}
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("path").count().where("count > 1").isEmpty()


def test_listed_twice_reported_once(spark, tmp_path):
    """The state drops a path and length that come again, also after a restart; a longer file of the same path counts anew."""
    rows = [("file:///x/a", 5), ("file:///x/a", 5), ("file:///x/b", 1)]
    for i, part in enumerate((rows, rows[:2], [("file:///x/a", 6)])):
        spark.createDataFrame(part, "path string, length long").write.json(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema("path string, length long").option("recursiveFileLookup", "true").json(str(tmp_path / "in")).dropDuplicates(["path", "length"])
        made = inspect.reported(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        made.awaitTermination()
    got = sorted((r["path"][-1], r["length"], r["exit_code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 5, 40), ("a", 6, 40), ("b", 1, 40)]


def test_no_content_in_the_state(spark, tmp_path):
    assert "content" not in inspect.listed(spark, str(tmp_path)).columns
