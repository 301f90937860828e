import bz2
import hashlib
import io
import struct
import tarfile

import pytest

from firmscope.operators import schema as S
from firmscope.plans import audit as plans
from firmscope.sources import archives
from firmscope.sources.images import Refused
from firmscope.streaming import watch
from tests.test_audit import contents, entries, entry


def test_audit_and_compare(spark):
    old = plans.audit(entries(spark, entry("bin/a", sha256="1")), contents(spark, **{"build.prop": "ro.secure=1"}))
    new = plans.audit(entries(spark, entry("bin/a", 0o4755, sha256="2")), contents(spark, **{"build.prop": "ro.secure=0"}))
    c = plans.compare(old, new)
    assert [(r["path"], r["status"]) for r in c.files.collect()] == [("bin/a", "modified")]
    assert sorted(r["rule"] for r in c.findings.collect()) == ["diff-insecure-adb", "diff-new-setuid"]
    score, code = plans.gated(new.findings, "high", old.findings.select("fingerprint"))
    assert (score.first()["value"], code.first()[0]) == (90, 3)
    assert plans.gated(new.findings, "low", new.findings.select("fingerprint"))[1].first()[0] == 0


def test_watch(spark, tmp_path):
    rows = [("i", "build.prop", "ro.secure", "0", 1), ("i", "build.prop", "ro.secure", "1", 2)]
    spark.createDataFrame(rows, S.PROP).write.parquet(str(tmp_path / "in"))
    q = watch.watch_props(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["rule"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["insecure-adb"]


def test_block_image():
    data = b"a" * 4096 + b"b" * 8192
    out = archives.block_image([("new", 2, 3), ("zero", 1, 2), ("new", 4, 6)], data)
    assert out == bytes(8192) + b"a" * 4096 + bytes(4096) + b"b" * 8192
    for bad in (data[:-1], data + b"x"):
        with pytest.raises(Refused):
            archives.block_image([("new", 2, 3), ("new", 4, 6)], bad)


def test_bspatch():
    num = lambda v: struct.pack("<Q", v if v >= 0 else (1 << 63) | -v)
    old, new = b"hello world", b"hellp!! world"
    control = num(5) + num(2) + num(0) + num(6) + num(0) + num(-3)
    diff = bytes([0, 0, 0, 0, 1]) + bytes(6)
    c, d = bz2.compress(control), bz2.compress(diff)
    patch = b"BSDIFF40" + num(len(c)) + num(len(d)) + num(len(new)) + c + d + bz2.compress(b"!!")
    assert archives.bspatch(old, patch) == new
    with pytest.raises((Refused, OSError, ValueError)):
        archives.bspatch(old, patch[:40])


def test_tar_and_publish(tmp_path):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for name, body in (("a/b", b"x"), ("c", b"yy")):
            m = tarfile.TarInfo(name)
            m.size = len(body)
            t.addfile(m, io.BytesIO(body))
    data = b.getvalue()
    assert list(archives.tar_files(data + hashlib.md5(data).hexdigest().encode() + b"  x.tar\n")) == [("a/b", b"x"), ("c", b"yy")]
    with pytest.raises(Refused):
        list(archives.tar_files(data + b"0" * 32 + b"  x.tar\n"))
    assert archives.publish(archives.tar_files(data), str(tmp_path / "out")) == 2 and (tmp_path / "out/a/b").read_bytes() == b"x"
    with pytest.raises(Refused):
        archives.publish([("ok", b""), ("../up", b"")], str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() and len(list(tmp_path.iterdir())) == 1
