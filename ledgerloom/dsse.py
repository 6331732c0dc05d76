"""Signed envelopes: Ed25519 (RFC 8032) over the pre-authentication encoding, checked in bulk by a pandas UDF."""

from __future__ import annotations

import base64
import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
Point = tuple[int, int, int, int]


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _recover(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    if not square:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


_Y = 4 * pow(5, -1, P) % P
_X = _recover(_Y, 0)
BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _pack(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _recover(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def generate_key() -> bytes:
    return os.urandom(32)


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign_bytes(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a, BASE))
    r = _number(prefix, message)
    point = _pack(_times(r, BASE))
    return point + ((r + _number(point, key, message) * a) % L).to_bytes(32, "little")


def verify_bytes(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_number(signature[:32], key, message), a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P or (left[1] * right[2] - right[1] * left[2]) % P)


def pae(payload_type: str, payload: bytes) -> bytes:
    kind = payload_type.encode()
    return b"DSSEv1 %d %s %d %s" % (len(kind), kind, len(payload), payload)


def envelope(seed: bytes, payload: bytes, payload_type: str, keyid: str | None = None) -> dict:
    """A signed envelope; the key's id is the digest of the public key unless given."""
    keyid = keyid or hashlib.sha256(public_key(seed)).hexdigest()
    text = lambda b: base64.b64encode(b).decode()
    return {"payloadType": payload_type, "payload": text(payload), "signatures": [{"keyid": keyid, "sig": text(sign_bytes(seed, pae(payload_type, payload)))}]}


def verify_envelopes(envelopes: DataFrame, key: bytes) -> DataFrame:
    """Add ``verified``: whether any signature of the envelope is valid for the public key; its id is not looked at."""

    @F.pandas_udf("boolean")
    def good(kind: pd.Series, payload: pd.Series, sigs: pd.Series) -> pd.Series:
        def one(k: str, p: str, s: list[str] | None) -> bool:
            try:
                message = pae(k, base64.b64decode(p, validate=True))
                return any(verify_bytes(key, message, base64.b64decode(x, validate=True)) for x in (s if s is not None else ()))
            except (TypeError, ValueError, AttributeError):
                return False

        return pd.Series([one(*x) for x in zip(kind, payload, sigs, strict=True)], dtype=bool)

    found: Column = good("payloadType", "payload", F.transform("signatures", lambda x: x["sig"]))
    return envelopes.withColumn("verified", found)
