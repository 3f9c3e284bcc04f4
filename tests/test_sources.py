"""Input arguments in order, and files that are written whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from marklens.operators import outputs
from marklens.sources import inputs, sink


def tree(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


NAMES = ["b.txt", "a/z.png", "a/b/c.txt", "a.txt", "a/B.txt", ".hidden", "_under", "é/1", "a b/2", "a-b/3"]


def walked(folder, prefix=""):
    """Depth first, a folder's entries by the bytes of their names."""
    out = []
    for name in sorted(os.listdir(folder), key=os.fsencode):
        if os.path.isdir(f"{folder}/{name}"):
            out += walked(f"{folder}/{name}", f"{prefix}{name}/")
        else:
            out.append(prefix + name)
    return out


def test_inputs_in_order(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    tree(one, {n: n.encode() * 9 for n in NAMES})
    tree(two, {"a.txt": b"", "deep/a/b/c/d": b"x" * 100})
    found = inputs.inputs(spark, [str(one)], partition_bytes=3 * 2**20).collect()
    assert [r["relative"] for r in found] == walked(str(one)) and len(found) == len(NAMES)
    assert [r["asset_id"] for r in found] == list(range(len(NAMES)))
    assert all(bytes(r["content"]) == r["relative"].encode() * 9 and r["path"] == f"{one}/{r['relative']}" and r["length"] == len(r["content"]) for r in found)
    both = inputs.inputs(spark, [str(two), str(one / "b.txt"), str(one)], most_bytes=90).collect()
    assert [r["relative"] for r in both] == ["two/a.txt", "two/deep/a/b/c/d", None, *(f"one/{n}" for n in walked(str(one)))]
    assert both[1]["content"] is None and both[1]["length"] == 100 and bytes(both[2]["content"]) == b"b.txt" * 9
    link = tmp_path / "link"
    link.symlink_to(one)
    assert len(inputs.inputs(spark, [str(link)]).collect()) == len(NAMES)


def test_inputs_that_are_not_there(spark, tmp_path):
    for paths in ([str(tmp_path / "none")], [str(tmp_path)], [], [str(tmp_path), str(tmp_path / "none")]):
        with pytest.raises(ValueError):
            inputs.inputs(spark, paths)


def test_parts_by_bytes():
    files = [inputs.Listed(i, str(i), None, size) for i, size in enumerate([5, 5, 5, 10**9, 1, 1])]
    parts = inputs.packed(files, 2 * inputs.OPENING_BYTES + 20)
    assert [[f.position for f in p] for p in parts] == [[0, 1], [2], [3], [4, 5]]


def frame(spark, rows):
    return spark.createDataFrame([(p, d, bytearray(c)) for p, d, c in rows], "path string, dest string, content binary")


def test_written_whole(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    tree(source, {"a": b"old", "b": b"b"})
    tree(out, {"taken": b"other", "equal": b"same"})
    (out / "hard").hardlink_to(source / "a")
    (out / "soft").symlink_to(source / "b")
    (out / "file").write_bytes(b"")
    rows = [("in/a", "new/deep/x", b"1" * 5000), (None, "taken", b"2"), (None, "equal", b"same"), ("in/a", "hard", b"3"), ("in/b", "soft", b"4"), (None, "file/below", b"5"), (None, "empty", b"")]
    rows = [(p and str(tmp_path / p), str(out / d), c) for p, d, c in rows]
    made = sink.written(frame(spark, rows).repartition(3), str(out), str(tmp_path / "said"))
    got = {os.path.relpath(r["dest"], out): (r["outcome"].split(":")[0], r["bytes"], r["exit_code"]) for r in made.collect()}
    assert got == {"new/deep/x": ("written", 5000, 0), "taken": ("exists", None, 2), "equal": ("written", 4, 0), "hard": ("names the input", None, 2), "soft": ("names the input", None, 2), "file/below": ("not written", None, 30), "empty": ("written", 0, 0)}
    assert (out / "new/deep/x").read_bytes() == b"1" * 5000 and (out / "taken").read_bytes() == b"other" and (source / "a").read_bytes() == b"old" and (source / "b").read_bytes() == b"b"
    again = sink.written(frame(spark, rows[:2]), str(out), str(tmp_path / "again"), overwrite=True)
    assert {r["exit_code"] for r in again.collect()} == {0} and (out / "taken").read_bytes() == b"2"
    assert not [n for n in os.listdir(out) if n.startswith(".")]
    assert sink.written(frame(spark, rows).where("false"), str(out), str(tmp_path / "none")).count() == 0


def test_failed_jobs_leave_no_pieces(spark, tmp_path):
    """A row that fails its task: what is there is whole, and nothing of the run stays but that."""
    rows = [(None, str(tmp_path / f"out/{i}"), b"%d" % i * 1000) for i in range(20)]
    bad = frame(spark, rows).repartition(4).withColumn("content", F.when(F.col("dest").endswith("/13"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sink.written(bad, str(tmp_path / "out"), str(tmp_path / "said"))
    names = [n for n in os.listdir(tmp_path / "out") if not n.startswith(".")] if (tmp_path / "out").exists() else []
    there = {n: (tmp_path / "out" / n).read_bytes() for n in names}
    assert all(c == n.encode() * 1000 for n, c in there.items()) and "13" not in there
    made = sink.written(frame(spark, rows), str(tmp_path / "out"), str(tmp_path / "said"))  # the same once more
    assert {r["outcome"] for r in made.collect()} == {"written"} and len([n for n in os.listdir(tmp_path / "out") if not n.startswith(".")]) == 20


def test_repeated_tasks(tmp_path):
    """Two attempts of one task, and one that ends half-way."""

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 7

        def taskAttemptId(self):
            return self.attempt

    from pyspark import TaskContext

    rows = [(None, str(tmp_path / f"out/{i}"), b"x" * i) for i in range(5)]

    def ends_early():
        yield from rows[:3]
        raise OSError("lost")

    writer = sink.FileWriter({"folder": str(tmp_path / "out"), "outcomes": str(tmp_path / "said"), "run": "r"})
    was, messages = TaskContext.get, []
    try:
        for attempt, given in enumerate((rows, rows, ends_early())):
            TaskContext.get = staticmethod(lambda a=attempt: Task(a))
            try:
                messages.append(writer.write(iter(given)))
            except OSError:
                pass
    finally:
        TaskContext.get = was
    writer.commit(messages)
    assert messages == [sink.Done(5, 0)] * 2
    assert {n: os.path.getsize(tmp_path / "out" / n) for n in os.listdir(tmp_path / "out")} == {str(i): i for i in range(5)}
    assert os.listdir(tmp_path / "said") == ["part-00007.json"]


def test_decisions_are_obeyed(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / p), r, "png", bytearray(c), False, 0) for p, r, c in (("b/x.png", "x.png", b"2"), ("a/x.PNG", "x.PNG", b"1"), ("y", "y.jpg", b"3"))], "path string, relative string, format string, content binary, no_op boolean, exit_code int")
    named = outputs.destinations(files, str(tmp_path / "out"))
    chosen = outputs.decided(named).where("decision = 'write'").select(F.col("path").alias("p"))
    made = sink.written(named.join(chosen, F.expr("path = p")), str(tmp_path / "out"), str(tmp_path / "said"))
    assert {os.path.basename(r["dest"]) for r in made.collect()} == {"x.png", "y.png"} == set(os.listdir(tmp_path / "out"))
    assert (tmp_path / "out/x.png").read_bytes() == b"1"
