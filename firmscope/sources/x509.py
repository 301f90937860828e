"""X.509 certificates, by a small DER reader: the facts that concerns are drawn from."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from firmscope.sources.images import READERS, Refused, _take

# fixed values: object identifiers
OIDS = {
    "1.2.840.113549.1.1.1": "rsa",
    "1.2.840.10045.2.1": "ec",
    "1.3.101.112": "ED25519",
    "1.2.840.113549.1.1.4": "md5WithRSAEncryption",
    "1.2.840.113549.1.1.5": "sha1WithRSAEncryption",
    "1.2.840.113549.1.1.11": "sha256WithRSAEncryption",
    "1.2.840.113549.1.1.12": "sha384WithRSAEncryption",
    "1.2.840.113549.1.1.13": "sha512WithRSAEncryption",
    "1.2.840.10045.4.1": "ecdsa-with-SHA1",
    "1.2.840.10045.4.3.2": "ecdsa-with-SHA256",
    "1.2.840.10045.4.3.3": "ecdsa-with-SHA384",
    "1.2.840.10045.4.3.4": "ecdsa-with-SHA512",
    "1.2.840.10045.3.1.7": "prime256v1",
    "1.3.132.0.34": "secp384r1",
    "1.3.132.0.35": "secp521r1",
    "2.5.4.3": "CN",
    "2.5.4.5": "serialNumber",
    "2.5.4.6": "C",
    "2.5.4.7": "L",
    "2.5.4.8": "ST",
    "2.5.4.10": "O",
    "2.5.4.11": "OU",
    "1.2.840.113549.1.9.1": "emailAddress",
    "0.9.2342.19200300.100.1.25": "DC",
}
CURVE_BITS = {"prime256v1": 256, "secp384r1": 384, "secp521r1": 521}
# fixed values: names in the certificates of the public test keys
TEST_KEY_NAMES = ("Android", "platform", "shared", "testkey", "media", "root")


def items(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, value) of each element; lengths are definite and inside."""
    at = 0
    while at < len(data):
        tag, length = _take(data, at, 2)
        at += 2
        if tag & 0x1F == 0x1F:
            raise Refused("long tags aren't used here")
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4:
                raise Refused("bad length")
            length = int.from_bytes(_take(data, at, n), "big")
            at += n
        yield tag, _take(data, at, length)
        at += length


def oid(value: bytes) -> str:
    numbers, n = [], 0
    for b in value:
        n = n << 7 | b & 0x7F
        if b < 0x80:
            numbers.append(n)
            n = 0
    if not numbers:
        raise Refused("empty identifier")
    head = min(numbers[0] // 40, 2)
    text = ".".join(map(str, (head, numbers[0] - 40 * head, *numbers[1:])))
    return OIDS.get(text, text)


def _time(tag: int, value: bytes) -> int | None:
    """Seconds since 1970, or null for a date that is none: the other facts still count."""
    text = value.decode("ascii", "replace")
    if tag == 0x17:
        text = ("20" if text[:2] < "50" else "19") + text
    try:
        return int(datetime.strptime(text, "%Y%m%d%H%M%SZ").replace(tzinfo=UTC).timestamp())
    except ValueError:
        return None


def _text(tag: int, value: bytes) -> str:
    return value.decode({0x1E: "utf-16-be", 0x1C: "utf-32-be", 0x14: "latin-1"}.get(tag, "utf-8"), "replace")


def _name(value: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a name's parts, in order."""
    parts = []
    for _, group in items(value):
        for _, pair in items(group):
            (_, kind), (tag, text) = list(items(pair))[:2]
            parts.append((oid(kind), _text(tag, text)))
    return parts


def _shown(name: list[tuple[str, str]]) -> str:
    return ", ".join(f"{k}={v}" for k, v in name)


def certificate(data: bytes) -> dict:
    """Facts of one DER or PEM certificate."""
    if found := re.search(rb"-----BEGIN CERTIFICATE-----(.+?)-----END CERTIFICATE-----", data, re.S):
        data = base64.b64decode(found[1])
    (_, whole), *rest = items(data)
    if rest:
        raise Refused("bytes behind the certificate")
    (_, body), (_, algorithm), *_ = items(whole)
    fields = list(items(body))
    if fields[0][0] == 0xA0:
        fields = fields[1:]
    (_, serial), (_, _), (_, issuer), (_, validity), (_, subject), (_, key) = fields[:6]
    (begin_tag, begin), (end_tag, end) = items(validity)
    (_, kind), (_, bits) = items(key)
    key_algorithm = oid(next(items(kind))[1])
    key_bits = None
    if key_algorithm == "rsa":
        _, numbers = next(items(bits[1:]))
        _, modulus = next(items(numbers))
        key_bits = int.from_bytes(modulus, "big").bit_length()
    elif key_algorithm == "ec":
        curve = [oid(v) for t, v in list(items(kind))[1:2] if t == 0x06]
        key_bits = CURVE_BITS.get(curve[0]) if curve else None
    elif key_algorithm == "ED25519":
        key_bits = 256
    subject_parts, issuer_parts = _name(subject), _name(issuer)
    common = next((v for k, v in subject_parts if k == "CN"), None)
    return {
        "subject": _shown(subject_parts),
        "issuer": _shown(issuer_parts),
        "self_signed": subject_parts == issuer_parts,
        "serial": serial.lstrip(b"\0").hex() or "00",
        "subject_cn": common,
        "not_before": _time(begin_tag, begin),
        "not_after": _time(end_tag, end),
        "signature_algorithm": oid(next(items(algorithm))[1]),
        "key_algorithm": key_algorithm,
        "key_bits": key_bits,
        "cert_sha256": hashlib.sha256(data).hexdigest(),
        "is_debug_cert": bool(common) and common.lower() == "android debug",
        "is_test_key": bool(common) and any(x in common for x in TEST_KEY_NAMES),
    }


READERS["x509"] = lambda data: iter([certificate(data)])
