"""The archive source: rows as the archive has them, in many tasks, each reading its own members."""

import json
import zipfile

import pytest

from marlstone.sources import archives


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "a" / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(200):
            z.writestr(f"part/{k:03d}.json", json.dumps({"k": k, "text": "words " * (k + 1)}))
        z.writestr("empty.json", "")
        z.mkdir("folder") if hasattr(z, "mkdir") else None
    with zipfile.ZipFile(tmp_path / "a" / "b" / "Two.ZIP", "w", zipfile.ZIP_STORED) as z:
        z.writestr("lines.jsonl", "﻿" + "".join(f'{{"n": {k}}}\r\n' for k in range(5_000)) + "last, without an end")
        z.writestr("한국어.txt", "가나다\n")
    (tmp_path / "a" / "note.txt").write_text("no archive")
    return tmp_path


def test_members_equal_the_archive(spark, folder):
    got = {(r["archive"].rsplit("/", 1)[-1], r["member"]): (r["place"], r["size"], bytes(r["content"])) for r in archives.members(spark, str(folder)).collect()}
    want = {}
    for path in (folder / "a" / "one.zip", folder / "a" / "b" / "Two.ZIP"):
        with zipfile.ZipFile(path) as z:
            for k, name in enumerate(sorted(n for n in z.namelist() if not n.endswith("/"))):
                want[path.name, name] = (k, len(z.read(name)), z.read(name))
    assert got == want


def test_one_archive_is_many_tasks(spark, folder):
    path = str(folder / "a" / "one.zip")
    made = archives.members(spark, path, r"^part/", size=1_000)
    assert made.rdd.getNumPartitions() > 3
    assert made.count() == 200 and made.select("member").distinct().count() == 200
    read = [m.name for p in archives.ZipReader({"path": path, "bytes": "1000"}).partitions() for m in p.members]
    assert sorted(read) == sorted({*read}) and len(read) == 201


def test_lines_of_members(spark, folder):
    rows = archives.members(spark, f"file://{folder}", r"\.jsonl$|\.txt$", "lines").orderBy("member", "line_no").collect()
    assert [r["line"] for r in rows if r["member"] == "한국어.txt"] == ["가나다"]
    lines = [r["line"] for r in rows if r["member"] == "lines.jsonl"]
    assert lines == [f'{{"n": {k}}}' for k in range(5_000)] + ["last, without an end"]


def test_pieces_are_bounded_and_lines_cross_them(monkeypatch, tmp_path):
    monkeypatch.setattr(archives, "CHUNK", 64)
    text = "".join(f"{'é한' * (k % 40)} line {k}\n" for k in range(300))
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", text)
    (m,) = archives.directory(str(tmp_path / "x.zip"))
    with open(tmp_path / "x.zip", "rb") as f:
        parts = list(archives.pieces(f, m))
        assert max(map(len, parts)) <= 64 and b"".join(parts).decode() == text
        assert list(archives.lines_of(archives.pieces(f, m))) == text.split("\n")[:-1]


def test_faults(spark, folder, tmp_path):
    bad = folder / "a" / "bad.zip"
    bad.write_bytes(b"no archive")
    with pytest.raises(Exception, match="no zip archive"):
        archives.members(spark, str(folder)).collect()
    assert archives.members(spark, str(folder), r"\.txt$", skip_bad=True).count() == 1
    assert archives.members(spark, str(bad), skip_bad=True).count() == 0
    with pytest.raises(Exception, match="there is no"):
        archives.members(spark, str(folder / "nothing")).collect()
    with pytest.raises(Exception, match="whole or lines"):
        archives.members(spark, str(folder), content="words").collect()
    data = bytearray((folder / "a" / "b" / "Two.ZIP").read_bytes())
    data[data.index(b'{"n": 7}') + 6] = ord("8")
    (tmp_path / "torn.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        archives.members(spark, str(tmp_path / "torn.zip")).collect()
