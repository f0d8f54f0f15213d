import json

from logloom.cli import main


def test_commands(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "auth.log").write_text("\n".join(f"Aug 14 02:1{i}:03 h sshd[1]: Failed password for bob from 9.9.9.9 port 22 ssh2" for i in range(5)) + "\nAug 15 02:11:03 h sudo: al : TTY=x ; COMMAND=/bin/ls")
    assert main(["stats", "--out", out], spark) == 2 and main(["ingest", "--raw", str(tmp_path / "none"), "--out", out], spark) == 2
    capsys.readouterr()
    assert main(["ingest", "--raw", str(raw), "--out", out, "--year", "2026", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["windows"] == 2
    assert main(["stats", "--out", out, "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["top_src_ips"] == [{"src_ip": "9.9.9.9", "n": 5, "failures": 5}] and report["windows"]["failures"] == 5
    assert main(["search", "x", "--out", out], spark) == 2
    assert main(["index", "--out", out, "--check"], spark) == 1
    assert main(["index", "--out", out, "--limit", "1"], spark) == 0 and main(["index", "--out", out, "--check"], spark) == 1
    assert main(["index", "--out", out], spark) == 0
    capsys.readouterr()
    assert main(["index", "--out", out, "--check", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"windows": 2, "vectors": 2, "missing": 0, "stale": 0, "repeated": 0, "dim": 64, "healthy": True}
    assert main(["search", "failed password bob", "-k", "1", "--out", out, "--json"], spark) == 0
    hit = json.loads(capsys.readouterr().out)["hits"][0]
    assert hit["rank"] == 1 and len(hit["event_ids"]) == 5 and hit["found_by"] == ["bm25", "dense"]
    assert main(["search", "failed password bob", "-k", "1", "--out", out, "--json", "--show-events", "3", "--no-rerank"], spark) == 0
    lines = json.loads(capsys.readouterr().out)["diagnostics"]["events"][0]
    assert len(lines) == 3 and lines == sorted(lines) and "sshd.failed_password | FAIL | bob | 9.9.9.9 | - | sl-" in lines[0]
    assert main(["search", "failed password bob", "-k", "1", "--out", out, "--show-events", "2"], spark) == 0
    assert "dense#1 bm25#1" in capsys.readouterr().out
    assert main(["stats", "--out", out], spark) == 0 and "top src_ips" in capsys.readouterr().out
    (raw / "auth.log").write_text("Aug 13 02:11:03 h sudo: al : TTY=x ; COMMAND=/bin/ls\nAug 13 02:12:03 h sudo: al : TTY=x ; COMMAND=/bin/ls")
    ingest = ["ingest", "--raw", str(raw), "--out", out, "--year", "2026", "--json"]
    assert main(ingest + ["--limit", "1"], spark) == 0 and json.loads(capsys.readouterr().out)["events"] == 7
    assert main(["index", "--out", out, "--check", "--json"], spark) == 1 and json.loads(capsys.readouterr().out)["stale"] == 2
    assert main(ingest + ["--rebuild"], spark) == 0 and json.loads(capsys.readouterr().out)["events"] == 2
    assert main(["version"]) == 0
