"""Secret scan: fixed patterns, then structural confirmation of encoded candidates.

Base spans come from three patterns. Further candidates (long base64 or hex runs, dotted tokens, PEM bodies) are
decoded, and reported only when the bytes parse: DER private keys (plain or encrypted) with consistent nested lengths,
OpenSSH private-key containers, or signed tokens whose header is JSON naming an algorithm. Public keys are no secrets and
aren't reported. Patterns begin only where no character of their own kind stands before, so a scan is linear.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A token's header is base64 of an object: "{" and a quote or blank begins with eyJ, eyA, ewo, ewk or ew0.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
#: Lines may end in escapes, as in JSON; header lines may stand before the body.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:\s|\\[nr])*+(?:[A-Za-z-]{1,40}: ?[A-Za-z0-9,. -]{1,200}(?:\s|\\[nr])++)*+)((?:[A-Za-z0-9+/=\s]|\\[nrt])++)-----END \1-----")
#: Base64 of a DER sequence (0x30, length form 0x81/0x82 or a short length) or of an SSH container; hex of the former.
CODED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P]|b3Bl)[A-Za-z0-9+/_-]{36,}+={0,2}|(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}+")
#: Object identifiers of key algorithms, DER-encoded.
KEY_OIDS = {
    bytes.fromhex("2a864886f70d010101"),  # rsaEncryption
    bytes.fromhex("2a8648ce3d0201"),  # ecPublicKey
    bytes.fromhex("2b656e"),  # X25519
    bytes.fromhex("2b656f"),  # X448
    bytes.fromhex("2b6570"),  # Ed25519
    bytes.fromhex("2b6571"),  # Ed448
    bytes.fromhex("2a864886f70d010301"),  # Diffie-Hellman
    bytes.fromhex("2a8648ce380401"),  # DSA
}
#: Beginnings of the identifiers of password-based encryption (PKCS#5 and PKCS#12).
ENCRYPTION_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three fixed patterns; a match that fails its length is dropped but still consumes text."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_key_der(data: bytes) -> bool:
    """True if the bytes are one DER sequence shaped as a private key: PKCS#1, traditional DSA, SEC1, PKCS#8, encrypted PKCS#8."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(data, *top[0][1:])
    if not items:
        return False
    tags = [t for t, _, _ in items]
    first = data[items[0][1] : items[0][2]]
    if tags == [2] * 9 and first in (b"\0", b"\1"):  # PKCS#1
        return True
    if tags == [2] * 6 and first == b"\0":  # DSA: version, p, q, g, public, private
        return items[1][2] - items[1][1] >= 64
    if tags[:2] == [2, 4] and first == b"\1" and items[1][2] - items[1][1] in (28, 32, 48, 66):  # SEC1
        return True
    if tags[:3] == [2, 0x30, 4] and first in (b"\0", b"\1"):  # PKCS#8
        return oid_of(data, items[1]) in KEY_OIDS
    if tags == [0x30, 4]:  # encrypted PKCS#8
        return items[1][2] - items[1][1] >= 16 and oid_of(data, items[0]).startswith(ENCRYPTION_OIDS)
    return False


def oid_of(data: bytes, item: tuple[int, int, int]) -> bytes:
    """Object identifier that a sequence begins with; empty for none."""
    inner = der_items(data, *item[1:])
    return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 6 else b""


def is_ssh_key(data: bytes) -> bool:
    """True for an openssh-key-v1 container: cipher, derivation and its options, a number of keys, so many public keys
    and the private part, with lengths that fill it exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields, keys = len(magic), 0, 0
    while at < len(data):
        if fields == 3 and not keys:
            if at + 4 > len(data) or not (keys := struct.unpack_from(">I", data, at)[0]):
                return False
            at += 4
            continue
        if at + 4 > len(data):
            return False
        at += 4 + struct.unpack_from(">I", data, at)[0]
        fields += 1
    return at == len(data) and keys > 0 and fields == 4 + keys


def is_encrypted_pem(headers: str, data: bytes) -> bool:
    """True for a traditional encrypted key: its headers name the cipher, and the body is whole cipher blocks."""
    return "ENCRYPTED" in headers and "DEK-Info" in headers and len(data) >= 16 and len(data) % 8 == 0


def unbase64(text: str) -> bytes | None:
    body = re.sub(r"\s|\\[nrt]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects, and the header names its algorithm."""
    head, body, _ = text.split(".")
    try:
        header, payload = json.loads(unbase64(head) or b""), json.loads(unbase64(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans of candidates that decode and parse."""
    out = []
    if "ey" in text or "ew" in text:
        out += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            data = unbase64(m[3])
            if data and (is_key_der(data) or is_ssh_key(data) or is_encrypted_pem(m[2], data)):
                out.append((m.start(), "pem", m.end()))
    for m in CODED.finditer(text):
        s = m[0]
        found = [(unbase64(s), m.start(), m.end())]
        if s[:2] == "30" and re.fullmatch("[0-9A-Fa-f]+", s) and len(s) % 2 == 0:
            found.append((bytes.fromhex(s), m.start(), m.end()))
        for data, start, end in found:
            if data and is_key_der(data):
                out.append((start, "der", end))
                break
            if data and is_ssh_key(data):
                out.append((start, "ssh", end))
                break
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan_batch(batch: pa.RecordBatch) -> dict:
    counts: dict[str, list] = {k: [] for k in KINDS[:3]}
    digests, spans = [], []
    for text in batch.column("text").to_pylist():
        base = base_spans(text or "")
        for k in KINDS[:3]:
            counts[k].append(sum(x[1] == k for x in base))
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(base + confirmed_spans(text or "")))
    return {"doc_id": batch.column("doc_id"), "n_assign": counts["assign"], "n_access": counts["access"], "n_hex": counts["hex"], "base_sha256": digests, "spans": spans}


def scan_secrets(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): counts of base spans, their digest, and all spans.

    Null and empty texts have no spans. Repeated rows give repeated results, a null doc_id stays null, other columns of
    df are ignored. A key inside PEM armour is reported as pem, and its body, where that parses alone, as der too. One map over the table: no shuffle, and memory bounded by a slice of texts.
    """
    return map_texts(df, scan_batch, "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,spans string", ["doc_id", "text"])
