"""Keys however they are wrapped, and structures that only look like keys."""

import base64
import textwrap

import pytest

from leafwork.llm import secrets

from .test_operators import RSA, tlv

OID = lambda h: tlv(6, bytes.fromhex(h))
SALT, ROUNDS, VERSION = tlv(4, b"saltsalt"), tlv(2, b"\x08\x00"), tlv(2, b"\0")


def kinds(text):
    return [k for k, _, _ in secrets.find(text) if k not in ("assign", "access", "hex")]


def lines(data: bytes, width: int, begin: str = "") -> str:
    return "\n".join(begin + x for x in textwrap.wrap(base64.b64encode(data).decode(), width))


@pytest.mark.parametrize("width", [8, 16, 64, 76])
def test_armour_of_any_width(width):
    text = "x\n-----BEGIN RSA PRIVATE KEY-----\n" + lines(RSA, width) + "\n-----END RSA PRIVATE KEY-----\ny"
    assert kinds(text) == ["pem"]


@pytest.mark.parametrize("width, begin, before, after", [(64, "", "", ""), (76, "> ", "Dear all,\nhere it is:\n", "\nbye"), (16, "  ", "", "\n\nmore"), (64, "", "averyveryverylongsingleword\n", "\nshort")])
def test_wrapped_keys_without_armour(width, begin, before, after):
    text = before + lines(RSA, width, begin) + after
    found = [s for s in secrets.find(text) if s[0] == "key"]
    assert len(found) == 1
    _, a, b = found[0]
    assert base64.b64decode("".join(x.strip("> ") for x in text[a:b].split("\n"))) == RSA


def test_what_only_looks_like_a_key():
    digest = tlv(0x30, tlv(0x30, OID("608648016503040201") + b"\x05\x00") + tlv(4, b"d" * 32))
    assert not secrets.is_der_key(digest) and kinds(base64.b64encode(digest).decode()) == []
    assert not secrets.is_der_key(tlv(0x30, tlv(2, b"\x07") + tlv(4, b"k" * 32)))  # no version of an elliptic-curve key
    assert not secrets.is_der_key(tlv(0x30, tlv(2, b"\x09") + tlv(0x30, OID("2a8648ce3d0201")) + tlv(4, b"k" * 32)))
    words = "\n".join(["abcdefghijklmnopqrstuvwxyz"] * 40)
    assert kinds(words) == [] and kinds(lines(RSA[:-9], 64)) == []


def test_encrypted_and_plain_forms():
    old = tlv(0x30, tlv(0x30, OID("2a864886f70d010503") + tlv(0x30, SALT + ROUNDS)) + tlv(4, b"e" * 64))
    new = tlv(0x30, tlv(0x30, OID("2a864886f70d01050d") + tlv(0x30, tlv(0x30, OID("2a864886f70d01050c") + tlv(0x30, SALT + ROUNDS)) + tlv(0x30, OID("60864801650304012a") + tlv(4, b"i" * 16)))) + tlv(4, b"e" * 64))
    plain = tlv(0x30, VERSION + tlv(0x30, OID("2a864886f70d010101") + b"\x05\x00") + tlv(4, RSA))
    curve = tlv(0x30, tlv(2, b"\1") + tlv(4, b"k" * 32))
    for data in (old, new, plain, curve, RSA):
        assert secrets.is_der_key(data) and kinds("key " + base64.b64encode(data).decode()) == ["key"]
    assert not secrets.is_der_key(tlv(0x30, tlv(0x30, OID("2a864886f70d010503") + tlv(0x30, ROUNDS)) + tlv(4, b"e" * 64)))
