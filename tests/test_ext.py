import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from firmscope.operators import schema as S
from firmscope.plans import audit as plans
from firmscope.sources import ext
from firmscope.sources.images import Refused

MKE2FS = shutil.which("mke2fs") or ("/usr/sbin/mke2fs" if os.path.exists("/usr/sbin/mke2fs") else None)
pytestmark = pytest.mark.skipif(MKE2FS is None, reason="mke2fs is not here")


def make(tmp_path, kind, *options):
    tree = tmp_path / "tree"
    if not tree.exists():
        (tree / "bin").mkdir(parents=True)
        (tree / "many").mkdir()
        (tree / "build.prop").write_text("ro.secure=0\nro.build.type=user\n")
        (tree / "bin/tool").write_bytes(os.urandom(300_000))
        (tree / "bin/tool").chmod(0o4755)
        (tree / "empty").write_bytes(b"")
        (tree / "sparse").write_bytes(b"a" * 5000 + bytes(100_000) + b"z")
        (tree / "short").symlink_to("bin/tool")
        (tree / "long").symlink_to("x" * 90)
        for k in range(400):
            (tree / f"many/file-{k:04d}").write_text(str(k))
    image = tmp_path / f"{kind}{len(options)}.img"
    subprocess.run([MKE2FS, "-q", "-t", kind, *options, "-d", str(tree), str(image), "16M"], check=True, capture_output=True)
    return tree, image


@pytest.mark.parametrize("kind,options", [("ext4", ()), ("ext2", ("-b", "1024")), ("ext3", ("-b", "4096", "-I", "128")), ("ext4", ("-O", "inline_data,64bit"))])
def test_reads_what_mke2fs_wrote(tmp_path, kind, options):
    tree, image = make(tmp_path, kind, *options)
    i = ext.open_image(str(image))
    got = {e["path"]: e for e in i.walk() if not e["path"].startswith("lost+found")}
    wanted = {str(p.relative_to(tree)): p for p in tree.rglob("*")}
    assert set(got) == set(wanted) and list(got) == sorted(got)
    for path, p in wanted.items():
        e = got[path]
        assert e["mode"] == p.lstat().st_mode & 0o7777
        if p.is_symlink():
            assert (e["kind"], e["link"]) == ("symlink", os.readlink(p))
        elif p.is_file():
            ino, inode = i.find(path)
            assert e["kind"] == "file" and e["size"] == p.stat().st_size and i.data(inode, ino) == p.read_bytes(), path
        else:
            assert e["kind"] == "dir"


def test_damage_is_refused(tmp_path):
    _, image = make(tmp_path, "ext4")
    data = image.read_bytes()
    for cut in (0, 1000, 1500, 3000, 60_000):
        with pytest.raises(Refused):
            list(ext.Image(lambda at, n, c=cut: data[:c][at : at + n], cut).walk())


def test_image_to_findings(spark, tmp_path):
    _, image = make(tmp_path, "ext4")
    (tmp_path / "broken.img").write_bytes(b"nothing")
    images = spark.createDataFrame([("system", str(image)), ("broken", str(tmp_path / "broken.img"))], "image string, location string")
    rows = ext.read_entries(images).cache()
    assert [r["image"] for r in rows.where("error is not null").collect()] == ["broken"]
    entries = rows.where("error is null").select(*spark.createDataFrame([], S.ENTRY).columns)
    contents = ext.read_contents(images, entries.where(F.col("path").endswith(".prop"))).select("image", "path", "content")
    assert contents.count() == 1
    found = plans.audit(entries, contents).findings
    assert {(r["rule"], r["subject"]) for r in found.collect()} == {("insecure-adb", "build.prop"), ("setuid-files", "")}
