"""Secret scans with structural confirmation.

Patterns only nominate: a candidate of the added kinds is reported when what it encodes parses.  Base64 and hex are
decoded; DER keys must nest exactly, each length inside its parent; a private-key container must be made of
length-prefixed fields; a signed token must have a JSON header that names its algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order that breaks ties between spans of one start.
KINDS = ["assign", "access", "hex", "jwt", "pem", "key"]

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
_word = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_token = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_armour = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(\s*Proc-Type: *4, *ENCRYPTED\s+DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]+\s)?([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Lines of base64 by themselves, two at least, all but the last of 16 characters or more.
_lines = re.compile(r"^(?:[ \t>]*[A-Za-z0-9+/]{16,}[ \t\r]*\n)+[ \t>]*[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*$)", re.M)
_line = re.compile(r"^[ \t>]*([A-Za-z0-9+/]+={0,2})[ \t\r]*$", re.M)
_named = ("passw", "secret", "token", "api")


def _decode(text: str) -> bytes:
    """Bytes of hex, base64 or url-safe base64; empty if it is none of them."""
    if len(text) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", text):
        return bytes.fromhex(text)
    text = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements (tag, start, end) that fill data[at:end] exactly."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: the numbers of RSA or DSA, an elliptic-curve key, or a wrapped key, plain or encrypted."""
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _der(data, *top[0][1:]) or []
    tags = [t for t, _, _ in inner]
    version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big") if tags[:1] == [2] else None
    if tags[:9] == [2] * 9 or tags == [2] * 6:  # nothing else is made of so many numbers
        return True
    if tags[:2] == [2, 4]:
        return version == 1
    if tags[:3] == [2, 0x30, 4]:
        algorithm = _der(data, *inner[1][1:])
        return version in (0, 1) and bool(algorithm) and algorithm[0][0] == 6
    return tags == [0x30, 4] and _is_cipher(data, *inner[0][1:])


#: Object identifiers (their bytes) that begin the names of password-based encryption schemes.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _is_cipher(data: bytes, at: int, end: int) -> bool:
    """An algorithm identifier of password-based encryption: its name, and either salt and rounds or derivation and cipher."""
    parts = _der(data, at, end) or []
    if [t for t, _, _ in parts] != [6, 0x30] or not data[parts[0][1] : parts[0][2]].startswith(_PASSWORD_BASED):
        return False
    inner = _der(data, *parts[1][1:]) or []
    tags = [t for t, _, _ in inner]
    return tags == [4, 2] or tags == [0x30, 0x30] and all((_der(data, a, b) or [(0, 0, 0)])[0][0] == 6 for _, a, b in inner)


def is_container_key(data: bytes) -> bool:
    """The private-key container that starts with its name and holds length-prefixed fields."""
    name = b"openssh-key-v1\0"
    if not data.startswith(name):
        return False
    at, count = len(name), 0
    for field in range(3):  # cipher, derivation, its options
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(count + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return 0 < count < 16 and at == len(data)


def is_signed_token(header: str, body: str) -> bool:
    try:
        top, claims = json.loads(_decode(header)), json.loads(_decode(body))
    except (ValueError, RecursionError):  # not JSON, or nested beyond reason
        return False
    return isinstance(top, dict) and isinstance(top.get("alg"), str) and isinstance(claims, dict)


def is_key(data: bytes) -> bool:
    """A key in one of the binary forms, or one armoured block of text around such a key."""
    if is_der_key(data) or is_container_key(data):
        return True
    return b"-----BEGIN" in data and any(is_armoured_key(m) for m in _armour.finditer(data.decode("latin-1")))


def is_armoured_key(m: re.Match) -> bool:
    """The block's payload parses; of an encrypted one, whose headers name cipher and salt, whole cipher blocks are enough."""
    data = _decode("".join(m[3].split()))
    return bool(data) and (len(data) % 8 == 0 if m[2] else is_der_key(data) or is_container_key(data))


def _size(head: bytes) -> int:
    """How many bytes the element has that begins here; 0 if it is no sequence."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    if not head[1] & 0x80:
        return 2 + head[1]
    k = head[1] & 0x7F
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Keys in base64 over several lines without armour: from a line that begins one, as many lines as its length asks for."""
    out = []
    for block in _lines.finditer(text):
        lines = [(m.start(1), m.end(1)) for m in _line.finditer(text, *block.span())]
        i = 0
        while i + 1 < len(lines):
            head = _decode(text[lines[i][0] : lines[i][0] + 16][: (lines[i][1] - lines[i][0]) // 4 * 4])
            data, j = b"", i
            if size := _size(head):
                joined, need = "", -(-size // 3) * 4
                while j < len(lines) and len(joined.rstrip("=")) < need - 2:
                    joined += text[slice(*lines[j])]
                    j += 1
                data = _decode(joined)
            elif head.startswith(b"openssh-key-"):
                j = len(lines)
                data = _decode("".join(text[slice(*x)] for x in lines[i:]))
            if j - i > 1 and data and (is_der_key(data) or is_container_key(data)):
                out.append((lines[i][0], lines[j - 1][1]))
                i = j
            else:
                i += 1
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind.  Each kind is looked for where its own letters can stand."""
    text = text or ""
    out = []
    low = text.lower()
    if any(k in low for k in _named):
        out += [("assign", *m.span()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    longest = max(map(len, text.split()), default=0)
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access.finditer(text)]
    if longest >= 24:
        out += [("hex", *m.span()) for m in _hex.finditer(text)]
    if "ey" in text and longest >= 11:
        out += [("jwt", *m.span()) for m in _token.finditer(text) if is_signed_token(m[1], m[2])]
    armoured = [m for m in _armour.finditer(text) if is_armoured_key(m)] if "-----BEGIN" in text else []
    out += [("pem", *m.span()) for m in armoured]
    inside = [m.span() for m in armoured]
    free = lambda at: not any(a <= at < b for a, b in inside)
    if longest >= 40:
        out += [("key", *m.span()) for m in _word.finditer(text) if free(m.start()) and (d := _decode(m[0])) and is_key(d)]
    if longest >= 16 and "\n" in text:
        whole = {(a, b) for k, a, b in out if k == "key"}
        out += [("key", a, b) for a, b in wrapped_keys(text) if free(a) and (a, b) not in whole]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, findings (kind, start, end), n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts are read; a null text counts as empty and has no findings.  Bytes that are not UTF-8 count as one
    replacement character each run, as Python decodes them.  Repeated rows are reported alike, an empty table gives no
    rows, and columns other than the two read are ignored.
    """
    findings = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [find((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            base = [[s for s in f if s[0] in KINDS[:3]] for f in found]
            n = [pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f] for f in found], findings), *n,
                 pa.array([hashlib.sha256(written(f).encode()).hexdigest() for f in base]), pa.array([written(f) for f in found], pa.string())],
                ["doc_id", "findings", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, findings array<struct<kind: string, start: long, end: long>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
