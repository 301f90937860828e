"""Android packages: binary manifest to components and flags, signers to certificates."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from io import BytesIO

from firmscope.sources import x509
from firmscope.sources.images import READERS, Refused, _take, _unpack

# fixed values: chunk kinds of binary XML, value kinds, ids of signing blocks
_POOL, _START, _END = 0x0001, 0x0102, 0x0103
_STRING, _DECIMAL, _HEX, _BOOLEAN = 0x03, 0x10, 0x11, 0x12
SIGNATURE_BLOCKS = {0x7109871A: "v2", 0xF05368C0: "v3"}
_COMPONENTS = {"activity": "activity", "activity-alias": "activity", "service": "service", "receiver": "receiver", "provider": "provider"}


def _strings(data: bytes, at: int) -> list[str]:
    _, head, _, count, _, flags, start, _ = _unpack("<HHIIIIII", data, at)
    out = []
    for k in range(count):
        p = at + start + _unpack("<I", data, at + head + 4 * k)[0]
        if flags & 0x100:  # UTF-8: two lengths, then bytes
            p += 2 if _take(data, p, 1)[0] & 0x80 else 1
            n = _take(data, p, 1)[0]
            p += 1
            if n & 0x80:
                n = (n & 0x7F) << 8 | _take(data, p, 1)[0]
                p += 1
            out.append(_take(data, p, n).decode("utf-8", "replace"))
        else:
            n = _unpack("<H", data, p)[0]
            p += 2
            if n & 0x8000:
                n = (n & 0x7FFF) << 16 | _unpack("<H", data, p)[0]
                p += 2
            out.append(_take(data, p, 2 * n).decode("utf-16-le", "replace"))
    return out


def elements(data: bytes) -> Iterator[tuple[str, str, dict[str, object]]]:
    """("start" or "end", tag, attributes) of a binary XML file; values that aren't
    literal (references into resources) are None."""
    kind, head, size = _unpack("<HHI", data)
    if kind != 0x0003 or size > len(data):
        raise Refused("not binary XML")
    at, names = head, []
    while at + 8 <= size:
        kind, head, length = _unpack("<HHI", data, at)
        if length < 8:
            raise Refused("broken chunk")
        _take(data, at, length)
        if kind == _POOL and not names:
            names = _strings(data, at)
        elif kind == _END:
            yield "end", names[_unpack("<I", data, at + head + 4)[0]], {}
        elif kind == _START:
            _, name, start, step, count = _unpack("<IIHHH", data, at + head)
            values: dict[str, object] = {}
            for k in range(count):
                _, key, raw, _, _, what, value = _unpack("<IIIHBBI", data, at + head + start + step * k)
                if what == _STRING:
                    values[names[key]] = names[value]
                elif what == _BOOLEAN:
                    values[names[key]] = value != 0
                else:
                    values[names[key]] = value if what in (_DECIMAL, _HEX) else None
            yield "start", names[name], values
        at += length


def manifest(data: bytes) -> dict:
    """The package row of a binary manifest; flags that aren't literal are null."""
    out: dict = {"package": None, "version_code": None, "version_name": None, "target_sdk": None, "app_permission": None, "debuggable": None, "cleartext": None, "network_config": False, "shared_user": None, "test_only": None, "allow_backup": None, "components": []}
    flag = lambda v: v if isinstance(v, bool) else None
    text = lambda v: v if isinstance(v, str) else None
    open_: list[str] = []
    part: dict | None = None
    actions: set[str] = set()
    for what, tag, a in elements(data):
        if what == "end":
            if open_ and open_[-1] == tag:
                open_.pop()
            if part is not None and tag in _COMPONENTS and len(open_) == 2:
                part["is_main"] = "android.intent.action.MAIN" in actions
                out["components"].append(part)
                part = None
            continue
        if tag == "manifest" and not open_:
            out |= {"package": text(a.get("package")), "version_code": a.get("versionCode"), "version_name": text(a.get("versionName")), "shared_user": text(a.get("sharedUserId"))}
        elif tag == "uses-sdk":
            sdk = a.get("targetSdkVersion", a.get("minSdkVersion"))
            out["target_sdk"] = sdk if isinstance(sdk, int) and not isinstance(sdk, bool) else None
        elif tag == "application" and len(open_) == 1:
            out |= {"app_permission": text(a.get("permission")), "debuggable": flag(a.get("debuggable")), "cleartext": flag(a.get("usesCleartextTraffic")), "network_config": "networkSecurityConfig" in a, "test_only": flag(a.get("testOnly")), "allow_backup": flag(a.get("allowBackup"))}
        elif tag in _COMPONENTS and len(open_) == 2 and open_[-1] == "application":
            part = {"kind": _COMPONENTS[tag], "name": text(a.get("name")), "exported": flag(a.get("exported")), "enabled": flag(a.get("enabled")), "permission": text(a.get("permission")), "has_filter": False, "is_main": False}
            actions = set()
        elif part is not None and tag == "intent-filter":
            part["has_filter"] = True
        elif part is not None and tag == "action" and isinstance(a.get("name"), str):
            actions.add(str(a["name"]))
        open_.append(tag)
        if len(open_) > 256:
            raise Refused("nested too deep")
    return out


def _blocks(data: bytes, wide: bool = False) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = _unpack("<Q" if wide else "<I", data, at)[0]
        at += 8 if wide else 4
        yield _take(data, at, n)
        at += n


def _certificates(pkcs7: bytes) -> Iterator[bytes]:
    """DER certificates of a signed-data message."""
    _, whole = next(x509.items(pkcs7))
    (_, _), (_, content) = list(x509.items(whole))[:2]
    _, signed = next(x509.items(content))
    for tag, value in x509.items(signed):
        if tag == 0xA0:
            at = 0
            for _, inner in x509.items(value):
                size = value.index(inner, at) + len(inner) - at
                yield value[at : at + size]
                at += size


def signers(data: bytes) -> Iterator[dict]:
    """(scheme, certificate facts) of every signer: v1 in META-INF, v2 and v3 in the
    block before the central directory."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            if name.upper().startswith("META-INF/") and name.upper().rpartition(".")[2] in ("RSA", "DSA", "EC"):
                for der in _certificates(z.read(name)):
                    yield {"scheme": "v1"} | x509.certificate(der)
        start = z.start_dir
    if start < 32 or data[start - 16 : start] != b"APK Sig Block 42":
        return
    size = _unpack("<Q", data, start - 24)[0]
    if not 24 <= size <= start - 8:
        raise Refused("broken signing block")
    for pair in _blocks(data[start - size : start - 24], wide=True):
        scheme = SIGNATURE_BLOCKS.get(_unpack("<I", pair)[0])
        if scheme is None:
            continue
        for many in _blocks(pair[4:]):
            for signer in _blocks(many):
                signed = next(_blocks(signer))
                for der in _blocks(list(_blocks(signed))[1]):
                    yield {"scheme": scheme} | x509.certificate(der)


def package(data: bytes) -> dict:
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            xml = z.read("AndroidManifest.xml")
    except (zipfile.BadZipFile, KeyError, NotImplementedError) as x:
        raise Refused(str(x)) from x
    return manifest(xml) | {"signers": list(signers(data))}


READERS["apk"] = lambda data: iter([package(data)])
