"""Signatures of verified-boot metadata: digest, RSA by PKCS#1 v1.5, keys from outside."""

from __future__ import annotations

import base64
import hashlib
import re
import struct

from firmscope.sources.images import READERS, Refused, _take, _unpack
from firmscope.sources.x509 import items, oid

# fixed values: algorithm names, key sizes, and the encoded heads of SHA-256 and SHA-512 digests
ALGORITHMS = {1: ("SHA256_RSA2048", 2048), 2: ("SHA256_RSA4096", 4096), 3: ("SHA256_RSA8192", 8192), 4: ("SHA512_RSA2048", 2048), 5: ("SHA512_RSA4096", 4096), 6: ("SHA512_RSA8192", 8192)}
DIGEST_HEADS = {"sha256": "3031300d060960864801650304020105000420", "sha512": "3051300d060960864801650304020305000440"}
EXPONENT = 65537


def vbmeta_block(data) -> bytes:
    """The metadata of an image: at its begin, or where its footer says."""
    if bytes(data[0:4]) != b"AVB0":
        if len(data) < 64 or bytes(data[len(data) - 64 : len(data) - 60]) != b"AVBf":
            raise Refused("no vbmeta")
        at, size = _unpack(">QQ", data, len(data) - 44)
        if size > 1 << 20:
            raise Refused("the metadata is too large")
        data = _take(data, at, size)
    auth, aux = _unpack(">QQ", data, 12)
    if max(auth, aux) > 1 << 20:
        raise Refused("the metadata is too large")
    block = _take(data, 0, 256 + auth + aux)
    if block[:4] != b"AVB0":
        raise Refused("no vbmeta")
    return bytes(block)


def rsa_verifies(modulus: int, exponent: int, bits: int, algorithm: int, signature: bytes, signed: bytes) -> bool:
    kind = "sha256" if algorithm <= 3 else "sha512"
    n = -(-bits // 8)
    number = int.from_bytes(signature, "big")
    if len(signature) != n or number >= modulus or modulus.bit_length() != bits:
        return False
    tail = bytes.fromhex(DIGEST_HEADS[kind]) + hashlib.new(kind, signed).digest()
    wanted = b"\0\1" + b"\xff" * (n - 3 - len(tail)) + b"\0" + tail
    return pow(number, exponent, modulus).to_bytes(n, "big") == wanted


def public_key(pem: bytes) -> tuple[int, int]:
    """(modulus, exponent) of a PEM key, with or without the algorithm around it."""
    found = re.search(rb"-----BEGIN (RSA )?PUBLIC KEY-----(.+?)-----END", pem, re.S)
    if not found:
        raise Refused("not a public key")
    (_, whole), *_ = items(base64.b64decode(found[2]))
    if not found[1]:
        (_, kind), (_, bits) = list(items(whole))[:2]
        if oid(next(items(kind))[1]) != "rsa":
            raise Refused("not an RSA key")
        (_, whole), *_ = items(bits[1:])
    (_, modulus), (_, exponent) = list(items(whole))[:2]
    return int.from_bytes(modulus, "big"), int.from_bytes(exponent, "big")


def signature(data, key: tuple[int, int] | None = None) -> dict:
    """What an image's metadata says of itself: digest, algorithm and whether it is signed
    (valid, invalid, absent, unsupported), by its own key or one from outside."""
    block = vbmeta_block(data)
    auth, aux = struct.unpack_from(">QQ", block, 12)
    algorithm = struct.unpack_from(">I", block, 28)[0]
    sig_at, sig_size, key_at, key_size = struct.unpack_from(">4Q", block, 48)
    rollback, flags = struct.unpack_from(">QI", block, 112)
    name, bits = ALGORITHMS.get(algorithm, ("NONE" if algorithm == 0 else f"unknown({algorithm})", 0))
    if not bits:
        state = "unsupported" if algorithm else "absent"
    else:
        inner, outer = block[256 : 256 + auth], block[256 + auth :]
        state = "invalid"
        if sig_at + sig_size <= auth and key_at + key_size <= aux:
            blob = outer[key_at : key_at + key_size]
            own = None
            if len(blob) >= 8 + bits // 8 and struct.unpack_from(">I", blob)[0] == bits:
                own = int.from_bytes(blob[8 : 8 + bits // 8], "big"), EXPONENT
            if (used := key or own) and rsa_verifies(*used, used[0].bit_length(), algorithm, inner[sig_at : sig_at + sig_size], block[:256] + outer):
                state = "valid"
    return {"signature": state, "algorithm": algorithm, "algorithm_name": name, "digest": hashlib.sha256(block).hexdigest(), "rollback_index": rollback, "flags": flags, "error": None}


READERS["avb-signature"] = lambda data: iter([signature(data)])
