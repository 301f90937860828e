"""Containers, signatures and extraction, against files built here by other means."""

import bz2
import hashlib
import io
import json
import lzma
import os
import random
import shutil
import struct
import subprocess
import tarfile
import zipfile
import zlib

import pytest

from firmscope.plans import extract, unpack
from firmscope.sources import archives, avb, bootparts, images, lz4, sniff, vendor
from firmscope.sources.images import Refused
from firmscope.sources.remote import Remote, open_remote

R = random.Random(5)
BLOB = bytes(R.randrange(256) for _ in range(9000))


def every_prefix_refused(parse, data, step=7):
    for n in range(0, len(data), step):
        with pytest.raises(images.BROKEN):
            list(parse(data[:n]))


def test_huawei_nb0_sin():
    app = b""
    for name, body in (("BOOT", b"one"), ("SYSTEM", BLOB)):
        head = bytearray(82)
        head[:8] = b"\x55\xaa\x5a\xa5" + struct.pack("<I", 86)
        head[24:28] = struct.pack("<I", len(body))
        head[60 : 60 + len(name)] = name.encode()
        app += bytes(head) + b"crc!" + body
        app += bytes(-len(app) % 4)
    rows = list(vendor.huawei_app(app + bytes(90)))
    assert [(r["name"], vendor.image_bytes(app, r)) for r in rows] == [("boot.img", b"one"), ("system.img", BLOB)]
    with pytest.raises(Refused):
        list(vendor.huawei_app(app + b"x" * 90))
    entry = lambda at, n, name: struct.pack("<II8x32s", at, n, name)
    nb0 = struct.pack("<I", 2) + entry(100, 3, b"a.img") + entry(103, 4, b"B") + b"abcdefg"
    assert [(r["name"], vendor.image_bytes(nb0, r)) for r in vendor.nokia_nb0(nb0)] == [("a.img", b"abc"), ("b.img", b"defg")]
    every_prefix_refused(vendor.nokia_nb0, nb0)
    for bad in (entry(50, 3, b"a"), entry(100, 30, b"a"), entry(100, 3, b"../a"), entry(100, 3, b"b")):
        with pytest.raises(Refused):
            list(vendor.nokia_nb0(struct.pack("<I", 2) + bad + entry(103, 4, b"B") + b"abcdefg"))
    sin = b"\x03SIN" + struct.pack(">I", 12) + b"auth" + BLOB
    (row,) = vendor.sony_sin(sin, "boot x")
    assert row["name"] == "boot_x.img" and vendor.image_bytes(sin, row) == BLOB
    with pytest.raises(Refused):
        list(vendor.sony_sin(b"\x03SIN" + struct.pack(">I", 8) + b"\x1f\x8b\x08" + BLOB))
    with pytest.raises(Refused):
        list(vendor.coolpad_cpb(b"x"))


def test_lg():
    def chunk(name, body, start, first):
        packed, head = zlib.compress(body), bytearray(512)
        head[:4] = b"\x30\x12\x95\x78"
        head[8 : 8 + len(name)] = name
        struct.pack_into("<II", head, 0x28, len(body), len(packed))
        struct.pack_into("<I", head, 0x40, start)
        struct.pack_into("<I", head, 0x48, first)
        return bytes(head) + packed

    head = bytearray(512)
    head[:4] = b"\x32\x96\x18\x74"
    struct.pack_into("<I", head, 0xC0, 3)
    dz = bytes(head) + chunk(b"SYSTEM", BLOB[:1000], 100, 100) + chunk(b"boot", b"boot!", 7, 7) + chunk(b"SYSTEM", BLOB, 103, 100)
    got = {r["name"]: vendor.image_bytes(dz, r) for r in vendor.lg_dz(dz)}
    assert got == {"system.img": BLOB[:1000] + bytes(536) + BLOB, "boot.img": b"boot!"}
    every_prefix_refused(vendor.lg_dz, dz, 97)
    table = lambda *rows: b"\x24\x05\0\0\x38\x31\x25\x80" + b"".join(struct.pack("<256sQQ", *r) for r in rows) + bytes(272)
    n = len(table((b"x", 0, 0), (b"y", 0, 0)))
    kdz = table((b"A.DLL", 1, 0), (b"Phone.DZ", len(dz), n)) + dz
    assert {r["name"]: vendor.image_bytes(kdz, r) for r in vendor.lg_kdz(kdz)} == got
    for bad in (b"\x28\x05\0\0\x34\x31\x25\x80" + kdz[8:], table((b"a", 1, 0)) + dz, kdz[:-1]):
        with pytest.raises(Refused):
            list(vendor.lg_kdz(bad))


def test_pac_amlogic_ozip():
    record = bytearray(2580)
    record[: len("boot.bin") * 2] = "boot.bin".encode("utf-16-le")
    head = 60 + 3 * 2580
    struct.pack_into("<I", record, 0x400, 5)
    struct.pack_into("<I", record, 0x40C, head)
    far = bytearray(record)
    struct.pack_into("<I", far, 0x40C, 1 << 30)
    pac = bytes(60) + bytes(record) + bytes(2580) + bytes(far) + b"hello"
    assert list(vendor.pac_files(pac)) == [{"name": "boot.bin", "offset": head, "size": 5}]
    record[:6] = "../".encode("utf-16-le")
    with pytest.raises(Refused):
        list(vendor.pac_files(bytes(60) + bytes(record) + bytes(5160) + b"hello"))
    aml = b"@AML" + struct.pack("<I8xII", 2, 256 * 40, 32) + bytes(8) + bytes(range(256)) * 40
    assert vendor.amlogic(aml) == {"version": 2, "offset": 32, "size": 10240, "entropy": 8.0, "encrypted": True}
    with pytest.raises(Refused):
        vendor.amlogic(aml + b"x")
    # The published example of the AES standard.
    key, plain, packed = (bytes.fromhex(x) for x in ("000102030405060708090a0b0c0d0e0f", "00112233445566778899aabbccddeeff", "69c4e0d86a7b0430d8cdb78070b4c55a"))
    assert vendor.aes_decrypt(key, packed * 3) == plain * 3
    openssl = shutil.which("openssl")
    if openssl:
        text = b"PK\x03\x04" + BLOB[:5000]
        cipher = lambda x: subprocess.run([openssl, "enc", "-aes-128-ecb", "-nopad", "-K", vendor.OZIP_KEYS["FindX"]], input=x + bytes(-len(x) % 16), check=True, capture_output=True).stdout
        file = bytearray(0x1050)
        file[:12], file[16:20], file[0x50:0x60] = b"OPPOENCRYPT!", b"5004", cipher(text[:16])
        ozip = bytes(file) + cipher(text)
        assert vendor.ozip_facts(ozip) == {"device": "FindX", "size": 5004} and b"".join(vendor.ozip_pieces(ozip)) == text
        for bad in (ozip[:-16], bytes(file[:0x50]) + bytes(16) + ozip[0x60:]):
            with pytest.raises(Refused):
                b"".join(vendor.ozip_pieces(bad))


def test_vendor_boot_and_dtbo():
    page = 2048
    for version in (3, 4):
        head = bytearray(page * 2)
        head[:8] = b"VNDRBOOT"
        struct.pack_into("<II", head, 8, version, page)
        struct.pack_into("<I", head, 24, 3000)
        struct.pack_into("<II", head, 2096, 2128, 10)
        struct.pack_into("<4I", head, 2112, 216, 2, 108, 6)
        table = b"".join(struct.pack("<III32s64x", n, at, 1, name) for n, at, name in ((1000, 0, b"first"), (2000, 1000, b"second")))
        data = bytes(head) + BLOB[:3000] + bytes(1096) + b"d" * 10 + bytes(page - 10) + table + bytes(page - 216) + b"config"
        got = [(r["name"], data[r["offset"] : r["offset"] + r["size"]]) for r in bootparts.vendor_boot_sections(data)]
        ramdisks = [("vendor_ramdisk", BLOB[:3000])] if version == 3 else [("vendor_ramdisk00", BLOB[:1000]), ("vendor_ramdisk01", BLOB[1000:3000]), ("bootconfig", b"config")]
        assert got == [*ramdisks, ("dtb", b"d" * 10)]
        for n in range(0, 2112, 100):
            with pytest.raises(images.BROKEN):
                list(bootparts.vendor_boot_sections(data[:n]))
    tree = struct.pack(">10I", 0xD00DFEED, 72, 56, 72, 40, 17, 16, 0, 0, 16) + bytes(16) + struct.pack(">IIII", 1, 0, 2, 9)
    table = struct.pack(">8I", 0xD7B7AB1E, 0, 32, 32, 2, 32, 2048, 0)
    entries = struct.pack(">8I", len(tree), 96, 7, 1, 0, 0, 0, 0) + struct.pack(">8I", 5, 9999, 8, 2, 0, 0, 0, 0)
    assert [(r["id"], r["revision"], r["nodes"]) for r in bootparts.dtbo_entries(table + entries + tree)] == [(7, 1, 0), (8, 2, None)]
    with pytest.raises(Refused):
        list(bootparts.dtbo_entries((table + entries)[:90]))


def lz4_literals(data):
    n, out = len(data), bytearray([min(len(data), 15) << 4])
    n -= 15
    while n >= 0:
        out.append(min(n, 255))
        n -= 255
        if out[-1] < 255:
            break
    return bytes(out) + data


def test_lz4():
    assert bytes(lz4.block(b"\x24ab\x02\x00\x00", 100)) == b"ab" * 5  # two literals, then eight copied from two back
    assert bytes(lz4.block(lz4_literals(BLOB), 1 << 20)) == BLOB
    for bad in (b"\x24ab\x03\x00\x00", b"\x24ab\x00\x00\x00", b"\xf0"):
        with pytest.raises(Refused):
            lz4.block(bad, 100)
    with pytest.raises(Refused):
        lz4.block(b"\x2fab\x02\x00\xff\xff\xff\x00\x00", 100)
    body = lz4_literals(BLOB)
    frame = b"\x04\x22\x4d\x18\x60\x40\x82" + struct.pack("<I", len(body)) + body + struct.pack("<I", 3 | 1 << 31) + b"raw" + bytes(4)
    legacy = b"\x02\x21\x4c\x18" + struct.pack("<I", len(body)) + body
    assert lz4.decompress(frame) == BLOB + b"raw" and lz4.decompress(legacy + legacy) == BLOB * 2
    assert images.decompressed_ramdisk(legacy) == BLOB
    every_prefix_refused(lambda d: [lz4.decompress(d)], frame, 501)


def test_sparse_overlay_and_bounds():
    def sparse(*chunks, blocks=4):
        out = struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, 4096, blocks, len(chunks), 0)
        for kind, n, body in chunks:
            out += struct.pack("<HHII", kind, 0, n, 12 + len(body)) + body
        return out

    raw = BLOB[:4096]
    one, two = sparse((0xCAC1, 1, raw), (0xCAC3, 3, b"")), sparse((0xCAC3, 2, b""), (0xCAC2, 1, b"abcd"), (0xCAC3, 1, b""))
    whole = raw + bytes(4096) + b"abcd" * 1024 + bytes(4096)
    assert images.unsparse(one, two) == whole
    checked = sparse((0xCAC1, 1, raw), (0xCAC3, 3, b""), (0xCAC4, 0, struct.pack("<I", zlib.crc32(raw + bytes(3 * 4096)))))
    assert images.unsparse(checked) == raw + bytes(3 * 4096)
    for bad in (sparse((0xCAC3, 5, b"")), sparse((0xCAC3, 4, b""), (0xCAC4, 0, b"nope")), sparse((0xCAC3, 0xFFFFFFF, b""), blocks=0xFFFFFFF)):
        with pytest.raises(Refused):
            images.unsparse(bad)
    with pytest.raises(Refused):
        images.unsparse(one, sparse((0xCAC3, 5, b""), blocks=5))


def test_avb_signature(tmp_path):
    openssl = shutil.which("openssl")
    if not openssl:
        pytest.skip("no openssl")
    run = lambda *a, **k: subprocess.run([openssl, *a], check=True, capture_output=True, **k).stdout
    run("genrsa", "-out", str(tmp_path / "k"), "2048")
    pem = run("rsa", "-in", str(tmp_path / "k"), "-pubout")
    modulus, exponent = avb.public_key(pem)
    assert exponent == 65537 and avb.public_key(run("rsa", "-in", str(tmp_path / "k"), "-RSAPublicKey_out")) == (modulus, exponent)

    def build(algorithm, key=modulus, hash_name="sha256", sign=True):
        aux = struct.pack(">II", 2048, 0) + key.to_bytes(256, "big") + bytes(256)
        aux += bytes(-len(aux) % 64)
        head = bytearray(256)
        head[:4] = b"AVB0"
        struct.pack_into(">QQI", head, 12, 320, len(aux), algorithm)
        struct.pack_into(">6Q", head, 32, 0, 32, 32, 256, 0, 520)
        struct.pack_into(">QQ", head, 96, len(aux), 0)
        signed = bytes(head) + aux
        (tmp_path / "signed").write_bytes(signed)
        sig = run("dgst", f"-{hash_name}", "-sign", str(tmp_path / "k"), str(tmp_path / "signed")) if sign else bytes(256)
        return bytes(head) + hashlib.sha256(signed).digest() + sig + bytes(32) + aux

    good = build(1)
    state = lambda data, key=None: avb.signature(data, key)["signature"]
    assert state(good) == state(build(4, hash_name="sha512")) == "valid"
    assert (state(build(0)), state(build(9)), state(build(1, sign=False)), state(build(2))) == ("absent", "unsupported", "invalid", "invalid")
    tampered = bytearray(good)
    tampered[-1] ^= 1
    assert state(bytes(tampered)) == "invalid"
    assert state(good, (modulus, exponent)) == "valid" and state(good, (modulus + 2, exponent)) == "invalid"
    footer = b"partition" + bytes(7) + good + b"AVBf" + struct.pack(">IIQQQ", 1, 0, 9, 16, len(good)) + bytes(28)
    assert avb.signature(footer) == avb.signature(good) and avb.signature(good)["digest"] == hashlib.sha256(good).hexdigest()
    for n in range(0, len(good), 97):
        with pytest.raises(images.BROKEN):
            avb.signature(good[:n])


def varint(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def payload(parts):
    manifest, blob = field(3, 4096), b""
    for name, ops, image in parts:
        p = field(1, name.encode()) + field(7, field(1, len(image)) + field(2, hashlib.sha256(image).digest()))
        for kind, data, source, target in ops:
            extent = lambda e: field(1, e[0]) + field(2, e[1])
            p += field(8, field(1, kind) + field(2, len(blob)) + field(3, len(data)) + b"".join(field(4, extent(e)) for e in source) + b"".join(field(6, extent(e)) for e in target) + field(8, hashlib.sha256(data).digest()))
            blob += data
        manifest += field(13, p)
    return b"CrAU" + struct.pack(">QQI", 2, len(manifest), 0) + manifest + blob


def bsdiff(old, new):
    sign = lambda n: struct.pack("<Q", n)
    n = min(len(old), len(new))
    control = bz2.compress(sign(n) + sign(len(new) - n) + sign(0))
    added = bz2.compress(bytes((new[i] - old[i]) & 0xFF for i in range(n)))
    return b"BSDIFF40" + sign(len(control)) + sign(len(added)) + sign(len(new)) + control + added + bz2.compress(new[n:])


def test_extract(spark, tmp_path):
    block = lambda k: bytes([k]) * 2048 + BLOB[k : k + 2048]
    old = block(1) + block(2) + block(3)
    system = block(7) + block(3) + bytes(4096) + block(9) + block(1)
    boot = block(4)
    patch = bsdiff(block(1), block(9))
    xz = lzma.compress(block(7))
    ops = [(8, xz, [], [(0, 1)]), (4, b"", [(2, 1)], [(1, 1)]), (6, b"", [], [(2, 1)]), (5, patch, [(0, 1)], [(3, 1)]), (4, b"", [(0, 1)], [(4, 1)])]
    data = payload([("system", ops, system), ("boot", [(0, boot, [], [(0, 1)])], boot), ("empty", [], b"")])
    assert images.payload_image(data, "system", old) == system and images.payload_image(data, "boot") == boot
    with pytest.raises(Refused):
        images.payload_image(data, "system")
    with pytest.raises(Refused):
        images.payload_image(data, "system", old[:4096] * 3)
    (tmp_path / "payload.bin").write_bytes(data)
    (tmp_path / "old.img").write_bytes(old)
    files = spark.createDataFrame([("p", f"file://{tmp_path}/payload.bin")], "path string, location string")
    base = spark.createDataFrame([("system", f"file://{tmp_path}/old.img")], "partition string, base_location string")
    found = extract.pieces(extract.operations(files), files, base)
    written = {r["partition"]: r for r in extract.write_images(found, str(tmp_path / "out")).collect()}
    assert sorted(os.listdir(tmp_path / "out")) == ["boot.img", "system.img"] and all(r["error"] is None for r in written.values())
    assert (tmp_path / "out/system.img").read_bytes() == system and written["boot"]["sha256"] == hashlib.sha256(boot).hexdigest()
    without = {r["partition"]: r["error"] for r in extract.write_images(extract.pieces(extract.operations(files), files), str(tmp_path / "out2")).collect()}
    assert "before the update" in without["system"] and without["boot"] is None and os.listdir(tmp_path / "out2") == ["boot.img"]
    assert {r["partition"] for r in extract.operations(files, ("boot",)).collect()} == {"boot"}
    with pytest.raises(Refused):
        extract.operations(files, ("boot", "nothing"))
    for bad in (payload([("a", [(0, b"x" * 4096, [], [(0, 1)])], b"x")]), payload([("a", [], b""), ("A", [], b"")]), payload([("../a", [], b"")])):
        with pytest.raises(Refused):
            list(images.payload_operations(bad))


def tar_of(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_of(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_zip_and_remote(spark, tmp_path):
    data = zip_of({"a/b.txt": b"one", "payload.bin": BLOB}, zipfile.ZIP_STORED)
    (tmp_path / "f.zip").write_bytes(data)
    remote = open_remote(str(tmp_path / "f.zip"))
    rows = list(archives.zip_members(remote))
    assert rows == list(archives.zip_members(data)) and len(remote) == len(data)
    inner = remote.window(rows[1]["offset"], rows[1]["size"])
    assert inner[0:9000] == BLOB and inner[10:20] == BLOB[10:20] and isinstance(inner, Remote)
    files = spark.createDataFrame([("z", str(tmp_path / "f.zip")), ("gone", str(tmp_path / "nothing"))], "path string, location string")
    got = {r["path"]: r for r in images.read_located(files, "zip").where("row is null or row like '%b.txt%'").collect()}
    assert json.loads(got["z"]["row"])["size"] == 3 and got["gone"]["error"]
    for bad in ({"../x": b""}, {"/x": b""}):
        with pytest.raises(Refused):
            list(archives.zip_members(zip_of(bad)))
    os.mkfifo(tmp_path / "fifo")
    with pytest.raises(OSError):
        open_remote(str(tmp_path / "fifo"))


def test_identify_zips_and_folders(spark):
    files = spark.createDataFrame([("a.zip", bytearray(zip_of({"payload.bin": b"x"}))), ("b.zip", bytearray(zip_of({"system.transfer.list": b"4"}))), ("c.zip", bytearray(zip_of({"d/system.transfer.list": b"4"}))), ("d.pac", bytearray(bytes(60) + b"n\0" + bytes(70))), ("e.pac", bytearray(200))], "path string, content binary")
    from pyspark.sql import functions as F

    members = images.read(files.where("path like '%.zip'"), "zip").select("path", F.get_json_object("row", "$.path").alias("name"))
    assert {r["path"]: r["kind"] for r in sniff.identify(files, members).collect()} == {"a.zip": "ab-ota-zip", "b.zip": "block-ota-zip", "c.zip": "zip", "d.pac": "pac", "e.pac": "unknown"}
    folders = spark.createDataFrame([("x", "system.transfer.list"), ("x", "y"), ("z", "boot.img")], "dir string, name string")
    assert {r["path"]: r["kind"] for r in sniff.identify_folders(folders).collect()} == {"x": "block-ota-dir", "z": "directory"}


def test_unpack_generations(spark):
    import gzip

    inner = zip_of({"deep.txt": b"deep", "more.tar": tar_of({"x/y": b"tar"})})
    outer = tar_of({"in.zip": inner, "plain.bin": b"plain", "z.gz": gzip.compress(b"packed"), "bad.zip": b"PK\x03\x04broken"})
    files = spark.createDataFrame([("ota.tar", bytearray(outer)), ("alone", bytearray(b"?"))], "path string, content binary")
    got = {r["path"]: r for r in unpack.unpack(files).collect()}
    texts = {p: bytes(r["content"]) for p, r in got.items() if r["error"] is None}
    assert texts == {"alone": b"?", "ota.tar!plain.bin": b"plain", "ota.tar!z.gz!z": b"packed", "ota.tar!in.zip!deep.txt": b"deep", "ota.tar!in.zip!more.tar!x/y": b"tar"}
    assert [p for p, r in got.items() if r["error"]] == ["ota.tar!bad.zip"] and got["ota.tar!in.zip!more.tar!x/y"]["depth"] == 3
    with pytest.raises(Refused):
        unpack.unpack(files, unpack.Limits(depth=1))
    with pytest.raises(Refused):
        unpack.unpack(files, unpack.Limits(bytes=100))
    few = {r["path"]: r["error"] for r in unpack.unpack(files, unpack.Limits(files=2)).collect() if r["error"]}
    assert "more than 2 files" in few["ota.tar"]


def test_pieces_of_block_updates():
    assert archives.joined_pieces(["s.new.dat", "s.new.dat.br"], "s") == (["s.new.dat.br"], True)
    assert archives.joined_pieces(["s.new.dat.2", "s.new.dat.10", "s.new.dat.1", *(f"s.new.dat.{k}" for k in range(3, 10))], "s") == ([f"s.new.dat.{k}" for k in range(1, 11)], False)
    for bad in (["s.new.dat.2", "s.new.dat.3"], ["s.new.dat.0", "s.new.dat.2"], ["t.new.dat"]):
        with pytest.raises(Refused):
            archives.joined_pieces(bad, "s")
