"""Readers of transcripts and archives on trees of good, late, broken and cut-off files."""

import io
import json
import tarfile

from pyspark.sql import functions as F

from tidewell.sources import archives, transcripts


def _message(model, output, provider=None, cost=0.5, **more):
    m = {"role": "assistant", "model": model, "usage": {"input": 10, "output": output, "cost": {"total": cost}}} | more
    return json.dumps({"type": "message", "message": m | ({"provider": provider} if provider else {})})


def test_transcripts(spark, tmp_path):
    session = '{"type": "session", "version": 3, "id": "%s"}'
    tree = {
        "a/good.jsonl": [session % "one", _message("m", 50, "p"), _message("n", 40), _message("n", 20), '{"type": "message", "message": {"role": "user"}}'],
        "a/b/broken.jsonl": ["not json", '{"type":"session","id":"two"}', '{"type": "mess', "", _message("m", 5), '[1, 2]', '"text"', "7"],
        "late.jsonl": ["{}"] * 5 + [session % "late", _message("m", 1)],
        "fifth.jsonl": ["{}"] * 4 + [session % "fifth", _message("", 0), _message("z", 0), _message("y", 0)],
        "2026_tail-id.jsonl": ['{"note": "\\"type\\":\\"session\\""}', '{"x": "a", "type": "session" }', _message("m", 3)],
        "again.jsonl": [session % "first", session % "second", _message("m", 2.5, usage={"input": "7", "output": 2.5})],
        "zz/good.jsonl": [session % "one", _message("last", 7, cost=1.5)],
        "a/other.json": [session % "no", _message("m", 9)],
        "empty.jsonl": [],
    }
    for name, lines in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines))
    got = {r.session_id: tuple(r)[1:] for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {
        "one": ("last", 10, 7, 1.5),  # two files of one session: the last by name
        "two": ("m", 10, 5, 0.5),
        "fifth": ("", 30, 0, 1.5),
        "tail-id": ("m", 10, 3, 0.5),
        "second": ("", 0, 0, 0.0),  # neither a text nor a fraction is a count
    }


def test_archives(spark, tmp_path):
    files = {
        "pkg-1/setup.py": "from x import y\next_modules = [1]\n", "pkg-1/pkg/parser.py": "a\nb\nc", "pkg-1/pkg/fast.PYX": "x", "pkg-1/pkg/core.rs": "fn\n",
        "pkg-1/tests/test_json.py": "1\n2\n3\n", "pkg-1/docs/Cargo.toml": "maturin", "pkg-1/README": "x", "pkg-1/pkg/HTML/é.txt": "",
    }

    def pack(mode):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as archive:
            for name, text in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                archive.addfile(info, io.BytesIO(text.encode()))
        return out.getvalue()

    whole = pack("w:gz")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/good.tar.gz").write_bytes(whole)
    (tmp_path / "plain.tar").write_bytes(pack("w"))
    (tmp_path / "cut.tgz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "junk.tgz").write_bytes(b"this is no archive")
    (tmp_path / "empty.tgz").write_bytes(b"")
    (tmp_path / "readme.md").write_text("no archive")
    members = archives.read_archives(spark, str(tmp_path)).withColumn("archive", F.element_at(F.split("archive", "/"), -1))
    by = {r.member: r for r in members.filter("archive = 'plain.tar' and member is not null").collect()}
    assert set(by) == set(files) and by["pkg-1/setup.py"].native_marks and by["pkg-1/pkg/parser.py"].lines == 2 and by["pkg-1/README"].size == 1
    summaries = spark.createDataFrame([("plain.tar", "A YAML Tokenizer")], "archive string, summary string")
    got = {r.archive: tuple(r)[1:] for r in archives.inspect_archives(members, summaries).collect()}
    want = (2, 4, 2, True, ["html", "pars"])
    assert got["good.tar.gz"] == (*want, []) and got["plain.tar"] == (*want, ["token", "yaml"])
    for broken in ("cut.tgz", "junk.tgz"):
        assert got[broken][:5] == (None, None, None, None, None), broken
    assert "empty.tgz" not in got  # Spark lists no file of no bytes


def test_marks_across_chunks(monkeypatch):
    monkeypatch.setattr(archives, "_CHUNK", 7)
    assert archives._scan(io.BytesIO(b"xx\nsetup EXT_MODULES here\n")) == (2, True)
    assert archives._scan(io.BytesIO(b"ext_module s\n")) == (1, False)
