import io
import shutil
import struct
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from firmscope.operators import packages
from firmscope.sources import apk, images


def axml(tree):
    """Binary XML of (tag, attributes, children)."""
    names = []

    def ref(s):
        if s not in names:
            names.append(s)
        return names.index(s)

    def chunk(kind, head, body):
        return struct.pack("<HHI", kind, 8 + len(head), 8 + len(head) + len(body)) + head + body

    def node(tag, attrs, *children):
        rows = b""
        for k, v in attrs.items():
            kind, value = (0x12, 0xFFFFFFFF if v else 0) if isinstance(v, bool) else (0x10, v) if isinstance(v, int) else (0x01, 0x7F010001) if v is None else (0x03, ref(v))
            rows += struct.pack("<IIIHBBI", 0xFFFFFFFF, ref(k), 0xFFFFFFFF, 8, 0, kind, value)
        head = struct.pack("<II", 1, 0xFFFFFFFF)
        body = struct.pack("<IIHHHHHH", 0xFFFFFFFF, ref(tag), 20, 20, len(attrs), 0, 0, 0) + rows
        return chunk(0x0102, head, body) + b"".join(node(*c) for c in children) + chunk(0x0103, head, struct.pack("<II", 0xFFFFFFFF, ref(tag)))

    body = node(*tree)
    texts, offsets = b"", b""
    for s in names:
        offsets += struct.pack("<I", len(texts))
        texts += struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0"
    pool = chunk(0x0001, struct.pack("<IIIII", len(names), 0, 0, 28 + len(offsets), 0), offsets + texts)
    return struct.pack("<HHI", 3, 8, 8 + len(pool) + len(body)) + pool + body


TREE = ("manifest", {"package": "com.x", "versionCode": 7, "sharedUserId": "u"}, ("uses-sdk", {"targetSdkVersion": 28}), (
    "application", {"debuggable": True, "allowBackup": None, "usesCleartextTraffic": True, "networkSecurityConfig": None},
    ("activity", {"name": ".Main", "exported": True}, ("intent-filter", {}, ("action", {"name": "android.intent.action.MAIN"}))),
    ("activity", {"name": ".Open"}, ("intent-filter", {}, ("action", {"name": "a.b"}))),
    ("service", {"name": ".S", "exported": True, "permission": "p"}), ("provider", {"name": ".P", "exported": True}), ("receiver", {"name": ".R", "exported": False}),
))


def make_apk(cert=b""):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("AndroidManifest.xml", axml(TREE))
    data = b.getvalue()
    if not cert:
        return data
    p = lambda *xs: b"".join(struct.pack("<I", len(x)) + x for x in xs)
    value = struct.pack("<I", 0x7109871A) + p(p(p(p(b"", p(cert), b""), b"", b"")))
    pair = struct.pack("<Q", len(value)) + value
    size = struct.pack("<Q", len(pair) + 24)
    block = size + pair + size + b"APK Sig Block 42"
    end = data.rindex(b"PK\x05\x06")
    at = struct.unpack_from("<I", data, end + 16)[0]
    return data[:at] + block + data[at:end] + data[end : end + 16] + struct.pack("<I", at + len(block)) + data[end + 20 :]


def test_manifest():
    m = apk.manifest(axml(TREE))
    assert (m["package"], m["version_code"], m["target_sdk"], m["debuggable"], m["allow_backup"], m["cleartext"], m["network_config"], m["shared_user"]) == ("com.x", 7, 28, True, None, True, True, "u")
    assert [(c["kind"], c["name"], c["exported"], c["has_filter"], c["is_main"]) for c in m["components"]] == [("activity", ".Main", True, True, True), ("activity", ".Open", None, True, False), ("service", ".S", True, False, False), ("provider", ".P", True, False, False), ("receiver", ".R", False, False, False)]
    data = axml(TREE)
    for n in range(0, len(data), 13):
        with pytest.raises((images.Refused, struct.error, IndexError)):
            apk.manifest(data[:n])


def test_package_to_findings(spark):
    files = spark.createDataFrame([("app/x.apk", bytearray(make_apk())), ("app/bad.apk", bytearray(b"PK"))], "path string, content binary")
    rows = images.read(files, "apk")
    assert [r["path"] for r in rows.where("error is not null").collect()] == ["app/bad.apk"]
    found = rows.where("error is null").select(F.lit("system").alias("image"), "path", F.from_json("row", packages.PACKAGE.replace("image string, path string, ", "")).alias("r")).select("image", "path", "r.*")
    got = {(r["rule"], r["severity"]) for r in packages.package_findings(found).collect()}
    assert got == {("exported-provider", "high"), ("exported-activity", "low"), ("apk-debuggable", "high"), ("apk-cleartext", "low"), ("apk-shared-user", "medium")}


def test_signers(tmp_path):
    openssl = shutil.which("openssl")
    if not openssl:
        pytest.skip("openssl is not here")
    subprocess.run([openssl, "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-days", "9", "-subj", "/CN=Android Debug", "-keyout", str(tmp_path / "k"), "-out", str(tmp_path / "c"), "-outform", "DER"], check=True, capture_output=True)
    der = (tmp_path / "c").read_bytes()
    got = apk.package(make_apk(der))["signers"]
    assert [(s["scheme"], s["is_debug_cert"], s["key_bits"]) for s in got] == [("v2", True, 2048)]
    (tmp_path / "m").write_bytes(b"x")
    subprocess.run([openssl, "x509", "-inform", "DER", "-in", str(tmp_path / "c"), "-out", str(tmp_path / "pem")], check=True, capture_output=True)
    p7 = subprocess.run([openssl, "crl2pkcs7", "-nocrl", "-certfile", str(tmp_path / "pem"), "-outform", "DER"], check=True, capture_output=True).stdout
    assert list(apk._certificates(p7)) == [der]
