"""Whole policy files, and the command that shows them."""

import json

from marklens.plans import policy

FILE = """[policy]
version = "7"
digest = "x"
[allowlist]
keep = ["size", "alpha"]
[sanity]
status = "agreed"
psnr_floor_db = 30
ssim_floor = 0.5
[[mark_class]]
id = "a"
label = "A"
guard = "g"
citation = "c"
[[transform]]
id = "MC03"
name = "e"
order = 1
kind = "metadata"
applies = ["png"]
[[held]]
id = "H1"
name = "h"
reason = "no codec"
[[guard]]
id = "G1"
name = "n"
guard = "never"
"""


def test_all_tables_are_read(tmp_path):
    (tmp_path / "p.toml").write_text(FILE)
    p = policy.load(str(tmp_path / "p.toml"))
    assert p.held == [("H1", "h", "no codec")] and p.guards == [("G1", "n", "never")] and p.allowed == ["size", "alpha"] and p.floors == (30.0, 0.5)
    assert policy.Policy().floors == (25.0, 0.6) and policy.Policy(floors=(1.0, 0.1)).digest != policy.Policy().digest


def test_command(tmp_path, capsys):
    path, out = str(tmp_path / "p.toml"), tmp_path / "out"
    (tmp_path / "p.toml").write_text(FILE)
    assert policy.main(["digest"]) == 0 and capsys.readouterr().out == policy.Policy().digest + "\n"
    assert policy.main(["show", "--policy", path]) == 0
    facts = json.loads(capsys.readouterr().out)
    assert facts["version"] == "7" and facts["transforms"] == ["MC03"] and facts["held"] == ["H1"] and "png" in facts["supported_containers"]
    assert policy.main(["snapshot", "--policy", path, "--out", str(out)]) == 0
    assert "- H1 | h | no codec" in out.read_text() and "- MC03 | e | metadata | png" in out.read_text() and "- PSNR in dB | 30.0" in out.read_text()
    assert policy.main([]) == policy.main(["show", "--policy"]) == policy.main(["list"]) == policy.main(["show", "--in", path]) == policy.main(["digest", "--out", str(tmp_path)]) == 2
    (tmp_path / "p.toml").write_text(FILE.replace('reason = "no codec"', ""))
    assert policy.main(["digest", "--policy", path]) == policy.main(["digest", "--policy", str(tmp_path / "none")]) == 30
