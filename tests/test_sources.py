import gzip
import hashlib
import json
import lzma
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from firmscope.sources import images, sniff, text


def test_sniff_order(spark):
    ext = bytearray(4200)
    ext[1080:1082] = b"\x53\xef"
    ext4 = bytearray(ext)
    ext4[1024 + 0x60] = 0x40
    ext3 = bytearray(ext)
    ext3[1024 + 0x5C] = 4
    tar = bytearray(600)
    tar[257:262] = b"ustar"
    cases = {"zip": b"PK\x03\x04x", "boot-image": b"ANDROID!", "android-sparse": b"\x3a\xff\x26\xed", "bzip2": b"BZh9x", "unknown": b"BZhx", "ext2": bytes(ext), "ext3": bytes(ext3), "ext4": bytes(ext4), "tar": bytes(tar), "gzip": gzip.compress(b"x"), "aml-container": b"@AML", "lg-dz": b"\x32\x96\x18\x74"}
    cases["unknown"] = b"\x1f\x8b\x00"
    df = spark.createDataFrame([(f"{k}.{k}", bytearray(v)) for k, v in cases.items()], "path string, content binary")
    assert {r["path"].split(".")[0]: r["kind"] for r in sniff.identify(df).collect()} == {k: k for k in cases}


def files(spark, **k):
    return spark.createDataFrame(list(k.items()), "path string, text string")


def test_text_sources(spark):
    kv = text.ota_metadata(files(spark, m="a = 1\nb=x=y\nskip\na=2\n"))
    assert {r["key"]: r["value"] for r in kv.collect()} == {"a": "2", "b": "x=y"}
    t = text.transfer_list(files(spark, t="4\n10\n0\n0\nnew 4,0,2,5,6\nzero 2,2,5\nerase 2,6,8\n"))
    rows = sorted((r["cmd_idx"], r["range_idx"], r["cmd"], r["begin"], r["end"]) for r in t.collect())
    assert rows == [(0, 0, "new", 0, 2), (0, 1, "new", 5, 6), (1, 0, "zero", 2, 5), (2, 0, "erase", 6, 8)]
    assert text.image_size(t).first()["size"] == 8 * 4096
    for bad in ("9\n1\nnew 2,0,1", "1\n1\nmove 2,0,1", "1\n1\nnew 2,1,1", "1\n1\nnew 3,0,1"):
        with pytest.raises(Exception, match="t: "):
            text.transfer_list(files(spark, t=bad)).collect()
    s = text.scatter(files(spark, s="# c\nboot 0x10 32 boot.img # x\nshort 1\nsystem 64 0x20\n")).orderBy("label").collect()
    assert [(r["label"], r["filename"], r["start"], r["size"]) for r in s] == [("boot", "boot.img", 16, 32), ("system", None, 64, 32)]
    x = text.rawprogram(files(spark, x='<data><!-- <program label="no"/> --><program start_sector="8" filename="a.img" label="a" num_partition_sectors="2" sparse="true"/><program label="b" filename="" start_sector="x"/></data>')).orderBy("label").collect()
    assert [(r["label"], r["filename"], r["start_sector"], r["num_sectors"], r["sparse"]) for r in x] == [("a", "a.img", 8, 2, True), ("b", None, None, None, None)]
    u = text.updater_script(files(spark, u='ui_print("a;b"); # note; "\nassert(getprop("x") == "y" || abort("E1: \\"no\\""));')).orderBy("n").collect()
    assert [(r["call"], r["strings"]) for r in u] == [("ui_print", ["a;b"]), ("assert", ["x", "y", 'E1: "no"'])]
    b = text.baseline(files(spark, a=json.dumps({"findings": [{"fingerprint": "f"}]}), b=json.dumps([{"fingerprint": "g"}])))
    assert sorted(r["fingerprint"] for r in b.collect()) == ["f", "g"]
    with pytest.raises(Exception, match="not a baseline"):
        text.baseline(files(spark, a="{}")).collect()


def sparse():
    raw, fill = b"A" * 4096, b"abcd"
    full = raw + fill * 2048 + bytes(4096)
    chunks = struct.pack("<HHII", 0xCAC1, 0, 1, 12 + 4096) + raw + struct.pack("<HHII", 0xCAC2, 0, 2, 16) + fill + struct.pack("<HHII", 0xCAC3, 0, 1, 12) + struct.pack("<HHII", 0xCAC4, 0, 0, 16) + struct.pack("<I", zlib.crc32(full))
    return struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, 4096, 4, 4, 0) + chunks, full


def test_sparse():
    data, full = sparse()
    assert images.unsparse(data) == full and [c["kind"] for c in images.sparse_chunks(data)] == ["raw", "fill", "skip", "crc32"]
    for n in range(0, len(data), 97):
        with pytest.raises(images.Refused):
            images.unsparse(data[:n])


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(k, v):
    return varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)


def payload(second=1):
    a, b = b"x" * 4096, lzma.compress(b"y" * 8192)
    op = lambda kind, off, data, start, n, sha=True: field(8, field(1, kind) + field(2, off) + field(3, len(data)) + field(6, field(1, start) + field(2, n)) + (field(8, hashlib.sha256(data).digest()) if sha else b""))
    part = field(1, b"boot") + op(0, 0, a, 0, 1) + op(8, len(a), b, second, 2) + field(8, field(1, 6) + field(6, field(1, 3) + field(2, 1)))
    m = field(3, 4096) + field(13, part)
    return struct.pack(">4sQQI", b"CrAU", 2, len(m), 0) + m + a + b


def test_payload():
    assert images.payload_image(payload(), "boot") == b"x" * 4096 + b"y" * 8192 + bytes(4096)
    with pytest.raises(images.Refused, match="overlap"):
        list(images.payload_operations(payload(0)))


def cpio(*rows):
    out = b""
    for name, mode, data in (*rows, ("TRAILER!!!", 0, b"")):
        head = b"070701" + b"".join(b"%08X" % v for v in (1, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, 0))
        head += name.encode() + b"\0"
        out += head + bytes(-len(head) % 4) + data + bytes(-len(data) % 4)
    return out


def test_read_keeps_bad_files(spark):
    good = gzip.compress(cpio(("./init.rc", 0o100644, b"on boot"), ("bin", 0o120777, b"system/bin")) + bytes(64) + cpio(("x", 0o100600, b"")))
    df = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"070701zz")), ("none", None)], "path string, content binary")
    rows = images.read(df, "cpio").withColumn("r", F.from_json("row", "path string, mode int, link string")).collect()
    assert sorted((r["path"], r["r"]["path"], r["r"]["link"]) for r in rows if r["r"]) == [("good", "bin", "system/bin"), ("good", "init.rc", None), ("good", "x", None)]
    assert [r["path"] for r in rows if r["error"]] == ["bad"]


def elf(kind=3, flags=6, interp=True, now=True):
    names = b"\0__stack_chk_fail\0"
    ph = lambda t, f, off, size: struct.pack("<IIQQQQQQ", t, f, off, off, off, size, size, 8)
    dyn = struct.pack("<QQ", 5, 64 + 5 * 56) + struct.pack("<QQ", 10, len(names)) + (struct.pack("<QQ", 24, 0) if now else b"") + bytes(16)
    base = 64 + 5 * 56
    body = names + dyn
    table = ph(1, 5, 0, base + len(body)) + ph(2, 6, base + len(names), len(dyn)) + ph(3 if interp else 4, 4, 0, 0) + ph(0x6474E551, flags, 0, 0) + ph(0x6474E552, 4, 0, 0)
    return b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", kind, 62, 1, 0, 64, 0, 0, 64, 56, 5, 0, 0, 0) + table + body


def test_elf():
    a = images.elf_audit(elf())
    assert (a["executable"], a["no_pie"], a["exec_stack"], a["relro"], a["canary"], a["fortify"]) == (True, False, False, "full", True, False)
    b = images.elf_audit(elf(kind=2, flags=7, now=False))
    assert (b["no_pie"], b["exec_stack"], b["relro"]) == (True, True, "partial")
    for n in range(20):
        with pytest.raises((images.Refused, struct.error)):
            images.elf_audit(elf()[:n])


def test_fdt_and_boot():
    strings = b"compatible\0"
    tree = struct.pack(">I", 1) + b"\0" * 4 + struct.pack(">III", 3, 4, 0) + b"abc\0" + struct.pack(">I", 1) + b"cpu\0" + struct.pack(">III", 3, 1, 0) + b"x\0\0\0" + struct.pack(">IIII", 2, 2, 9, 9)[:12]
    head = struct.pack(">10I", 0xD00DFEED, 40 + len(tree) + len(strings), 40, 40 + len(tree), 0, 17, 16, 0, len(strings), len(tree))
    rows = list(images.fdt_nodes(head + tree + strings))
    assert [(r["node"], r["name"], r["value"]) for r in rows] == [("/", "compatible", b"abc\0".hex()), ("/cpu", "compatible", b"x".hex())]
    boot = b"ANDROID!" + struct.pack("<8I", 10, 0, 20, 0, 0, 0, 0, 2048) + struct.pack("<I", 0)
    boot = boot.ljust(2048, b"\0") + b"k" * 10 + bytes(2038) + b"r" * 20
    assert [(s["name"], s["offset"], s["size"]) for s in images.boot_sections(boot)] == [("kernel", 2048, 10), ("ramdisk", 4096, 20)]


def test_x509(tmp_path):
    import datetime
    import shutil
    import subprocess

    from firmscope.sources import x509

    openssl = shutil.which("openssl")
    if not openssl:
        pytest.skip("openssl is not here")
    out = tmp_path / "c.pem"
    subprocess.run([openssl, "req", "-x509", "-newkey", "rsa:1024", "-nodes", "-sha1", "-days", "30", "-subj", "/C=US/O=Android/CN=Android Debug", "-keyout", str(tmp_path / "k"), "-out", str(out)], check=True, capture_output=True)
    c = x509.certificate(out.read_bytes())
    assert (c["subject"], c["subject_cn"], c["is_debug_cert"], c["key_algorithm"], c["key_bits"], c["signature_algorithm"]) == ("C=US, O=Android, CN=Android Debug", "Android Debug", True, "rsa", 1024, "sha1WithRSAEncryption")
    assert c["not_after"] - c["not_before"] == 30 * 86400 and abs(c["not_before"] - datetime.datetime.now().timestamp()) < 86400
    der = subprocess.run([openssl, "x509", "-in", str(out), "-outform", "DER"], check=True, capture_output=True).stdout
    assert x509.certificate(der) == c
    for n in range(0, len(der) - 1, 11):
        with pytest.raises((images.Refused, ValueError, StopIteration, IndexError)):
            x509.certificate(der[:n])
