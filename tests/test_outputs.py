"""Names of outputs and which of them are written."""

from marklens.operators import outputs


def test_names_and_decisions(spark):
    rows = [
        ("/in/a/x.jpeg", "jpeg", False, 0), ("/in/a/x.png", "jpeg", False, 0), ("/in/a/w.jpg", "jpeg", True, 0), ("/in/b/.hidden", "png", False, 0),
        ("/in/b/t.md", "text", False, 0), ("/in/c/bad.png", "png", False, 30), ("/in/c/old.png", "png", False, 0), ("/in/d/n.gif", "png", True, 0), ("/in/d/n.png", "png", False, 0),
        ("/in/d/o.png", "png", True, 0), ("/out/e.wav", "riff-wav", False, 0), ("/in/v.1/s", "flac", False, 0),
    ]
    files = spark.createDataFrame(rows, "path string, format string, no_op boolean, exit_code int")
    named = outputs.destinations(outputs.relative_to(files, "/in/"), "/out")
    there = spark.createDataFrame([("/out/c/old.png",), ("/out/c/old.png",)], "path string")
    got = {r["path"]: (r["dest"], r["decision"], r["exit_code"]) for r in outputs.decided(named, there).collect()}
    assert len(got) == len(rows)
    assert got["/in/a/x.jpeg"] == ("/out/a/x.jpg", "write", 0) and got["/in/a/x.png"] == ("/out/a/x.jpg", "collides", 2) and got["/in/a/w.jpg"][1:] == ("no-op", 0)
    assert got["/in/b/.hidden"] == ("/out/b/.hidden.png", "write", 0) and got["/in/b/t.md"] == ("/out/b/t.md", "write", 0) and got["/in/c/bad.png"][1:] == ("failed", 30)
    assert got["/in/c/old.png"][1:] == ("exists", 2) and got["/in/d/n.gif"][1:] == ("no-op", 0) and got["/in/d/n.png"][1:] == ("write", 0)
    assert got["/out/e.wav"][1:] == ("names the input", 2) and got["/in/v.1/s"] == ("/out/v.1/s.flac", "write", 0)
    assert {r["path"]: r["decision"] for r in outputs.decided(named, there, overwrite=True).collect()}["/in/c/old.png"] == "write"
    assert outputs.decided(named.limit(0), there).count() == 0
