"""Secret scans with structural confirmation.

Three base patterns are reported as they match: assignments to telling names,
access key ids and long runs of hex digits.  Everything else that looks like
encoded key material is decoded first and reported only if its structure holds:

* ``key``: base64, base64url or hex text that decodes to a private key, that
  is a DER sequence whose nested lengths close exactly and whose fields are
  those of an RSA, DSA, elliptic curve, wrapped or encrypted key, or the
  length-prefixed fields of an OpenSSH key; or text that decodes to such a block;
* ``block``: an armoured private key, whose base64 body decodes to one of these;
* ``signed``: three base64url parts of which the first two are JSON objects,
  the header names an algorithm, and the signature has that algorithm's length.

Lengths inside the encoding say where it ends, so trailing characters of the
alphabet don't matter.  Places are code points, ends exclusive; a base span
stays whether or not a structure overlaps it.

Defined results: a null or empty text has no spans; rows are independent, so
ties, repeated rows and null ids need no rule; an empty table gives an empty
result; columns named in ``keep`` are passed on, others aren't read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Kinds in the order in which they are listed; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "key", "block", "signed")
#: Least lengths: of an assigned value, of an access key id, of hex digits.
VALUE, ACCESS, HEX = 12, 18, 16
#: Encoded characters from which a structure is looked for.
ENCODED = 20
#: How often text inside decoded text is looked at again.
DEPTH = 2

# all on bytes: what the patterns take is ASCII; assignments are sought in lower-cased text
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{%d,}" % HEX)
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % min(ENCODED, HEX, ACCESS))
# base64 may be wrapped into lines; base64url is of one line
_LINES = re.compile(rb"[A-Za-z0-9+/]{%d,}(?:\r?\n[A-Za-z0-9+/]{%d,})*(?:\r?\n[A-Za-z0-9+/]+)?" % (ENCODED, ENCODED))
_LINE = re.compile(rb"[A-Za-z0-9_-]{%d,}" % ENCODED)
_NEWLINE = re.compile(rb"[\r\n]+")
# where an encoding may begin: a DER sequence, told by its tag, and the mark of OpenSSH's format
_START = re.compile(rb"M[A-P]|b3BlbnNzaC1rZXktdjEA")
_HEX_START = re.compile(rb"30|6f70656e7373682d6b65792d763100", re.I)
_MIXED_HEX = re.compile(rb"[0-9A-Fa-f]{%d,}" % ENCODED)
_BLOCK = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
_HEADERS = re.compile(rb"^[A-Za-z-]+:.*$|\\[rn]", re.M)
_SIGNED = re.compile(rb"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_OPENSSH = b"openssh-key-v1\0"

#: Bytes of a signature by its algorithm (fixed values of the JOSE registry); RSA signatures have the modulus' length.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}
RSA_ALGORITHMS, EDWARDS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), {64, 114}
INTEGER, OCTETS, IDENTIFIER, SEQUENCE = 2, 4, 6, 0x30
#: Object identifiers of password-based encryption start with one of these (PKCS #5, PKCS #12).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decode64(text: bytes) -> bytes:
    """Base64 of either alphabet, padded or not; bits that fill no byte are left out."""
    text = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(text) % 4 == 1:
        text = text[:-1]
    return base64.b64decode(text + b"=" * (-len(text) % 4))


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the DER element at a place, if its length is minimal and fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n = int.from_bytes(data[at : at + size], "big")
        if n < 0x80 or n >> 8 * (size - 1) == 0:
            return None
        at += size
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between two places, if they fill them exactly."""
    out = []
    while at < end:
        found = element(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def _der_key(data: bytes, at: int) -> int | None:
    """End of the DER private key that starts at a place."""
    outer = element(data, at, len(data))
    if outer is None or outer[0] != SEQUENCE:
        return None
    parts = elements(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    sizes = [b - a for _, a, b in parts]
    if tags[0] == INTEGER:
        version = data[parts[0][1]] if sizes[0] == 1 else -1
        numbers = all(t == INTEGER and b > a and data[a] < 0x80 for t, a, b in parts)
        if version in (0, 1) and numbers and len(parts) == 9:  # RSA: the modulus is longer than both primes
            return outer[2] if sizes[1] > max(sizes[4], sizes[5]) >= 16 else None
        if version == 0 and numbers and len(parts) == 6:  # DSA
            return outer[2] if sizes[1] >= sizes[2] >= 20 else None
        if version == 1 and tags[1:2] == [OCTETS] and sizes[1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic curve
            return outer[2]
        if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and sizes[2] >= 16:  # wrapped
            algorithm = elements(data, parts[1][1], parts[1][2])
            return outer[2] if algorithm and algorithm[0][0] == IDENTIFIER else None
    if tags == [SEQUENCE, OCTETS] and sizes[1] >= 16:  # encrypted
        algorithm = elements(data, parts[0][1], parts[0][2])
        if algorithm and algorithm[0][0] == IDENTIFIER and data[algorithm[0][1] : algorithm[0][2]].startswith(ENCRYPTION):
            return outer[2]
    return None


def _openssh_key(data: bytes, at: int) -> int | None:
    """End of the OpenSSH private key that starts at a place: nested fields, each with its length before it."""
    if not data.startswith(_OPENSSH, at):
        return None
    at += len(_OPENSSH)

    def field(at: int) -> tuple[int, int] | None:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return (at + 4, end) if at + 4 <= end <= len(data) else None

    for _ in range(3):  # cipher, derivation, its options
        found = field(at)
        if found is None:
            return None
        at = found[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= 16:
        return None
    at += 4
    for i in range(keys + 1):  # public parts, then the private part
        found = field(at)
        if found is None or found[1] - found[0] < 16:
            return None
        if i < keys:  # a public part is itself a list of fields, the first its type
            name = field(found[0])
            if name is None or name[1] > found[1] or name[1] == name[0] or not data[name[0] : name[1]].isascii():
                return None
        at = found[1]
    return at


def key_end(data: bytes, at: int = 0) -> int | None:
    """End of the private key whose encoding starts at a place, or None."""
    return _der_key(data, at) if data[at : at + 1] == b"\x30" else _openssh_key(data, at)


def _json_object(part: bytes) -> dict | None:
    try:
        found = json.loads(decode64(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed(header: bytes, payload: bytes, signature: bytes) -> bool:
    """Whether the parts of a token fit together."""
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    alg, size = head["alg"], len(decode64(signature))
    if alg == "EdDSA":
        return size in EDWARDS
    if alg in RSA_ALGORITHMS:
        return size >= 128 and size % 64 == 0
    return SIGNATURES.get(alg) == size


def _keys_in(run: bytes) -> Iterator[tuple[int, int]]:
    """Places of private keys in a run of encoding characters; each alignment is decoded once."""
    decoded: dict[int, bytes] = {}
    at = 0
    for m in _START.finditer(run):
        if m.start() < at:
            continue
        shift = m.start() % 4
        if shift not in decoded:
            decoded[shift] = decode64(run[shift:])
        begin = (m.start() - shift) // 4 * 3
        end = key_end(decoded[shift], begin)
        if end is not None:
            at = m.start() + ((end - begin) * 4 + 2) // 3
            yield m.start(), at
    for digits in _MIXED_HEX.finditer(run):
        text, at = digits[0], 0
        pairs = [binascii.unhexlify(text[k : k + (len(text) - k) // 2 * 2]) for k in (0, 1)]
        for m in _HEX_START.finditer(text):
            end = key_end(pairs[m.start() % 2], m.start() // 2) if m.start() >= at else None
            if end is not None:
                at = 2 * end + m.start() % 2
                yield digits.start() + m.start(), digits.start() + at


def _inner(run: bytes, depth: int) -> bool:
    """Whether a run decodes to text that holds a structure in its turn."""
    if depth == 0:
        return False
    texts = [decode64(run)]
    if _MIXED_HEX.fullmatch(run):
        texts.append(binascii.unhexlify(run[: len(run) // 2 * 2]))
    return any(t.isascii() and structures(t, depth - 1) for t in texts)


def _block_holds(body: bytes) -> bool:
    """Whether an armour's body is a key; encrypted bodies of the old form are ciphertext, of whole cipher blocks."""
    encoded = b"".join(_HEADERS.sub(b"", body).split())
    if not re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", encoded):
        return False
    data = decode64(encoded)
    if b"ENCRYPTED" in body and b"DEK-Info:" in body:
        return len(data) >= 32 and len(data) % 8 == 0
    return key_end(data) == len(data)


def structures(text: bytes, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed structures, in bytes."""
    found = []
    if b"PRIVATE KEY-----" in text:
        found = [(m.start(), m.end(), "block") for m in _BLOCK.finditer(text) if _block_holds(m[2])]
    blocks = [a for a, _, _ in found]
    if b".e" in text:
        found += [(m.start(), m.end(), "signed") for m in _SIGNED.finditer(text) if signed(m[1], m[2], m[3])]
    urls = (m for m in _LINE.finditer(text) if b"-" in m[0] or b"_" in m[0])
    for m in itertools.chain(_LINES.finditer(text), urls):
        at = bisect.bisect_right(blocks, m.start()) - 1
        if at >= 0 and m.start() < found[at][1]:
            continue
        lines, run, end = m[0], _NEWLINE.sub(b"", m[0]), m.end() + _padding(text, m.end())
        keys = list(_keys_in(run))
        if len(run) < len(lines):  # back to places among the line ends
            solid = np.flatnonzero(~np.isin(np.frombuffer(lines, np.uint8), (10, 13)))
            keys = [(int(solid[a]), int(solid[b - 1]) + 1) for a, b in keys]
        found += [(m.start() + a, end if b == len(lines) else m.start() + b, "key") for a, b in keys]
        if not keys and _inner(run, depth):
            found.append((m.start(), end, "key"))
    return found


def _padding(text: bytes, at: int) -> int:
    return len(text[at : at + 2]) - len(text[at : at + 2].lstrip(b"="))


def scan(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a UTF-8 text in code points, by start, then kind, then end."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text.lower()) if m.end(1) - m.start(1) >= VALUE]
    if b"AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    if _RUN.search(text):
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        spans += structures(text)
    if not spans:
        return []
    more = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)  # bytes that continue a code point
    places = np.array([[a, b] for a, b, _ in spans])
    places -= np.searchsorted(more, places)
    out = zip(places[:, 0].tolist(), places[:, 1].tolist(), [k for _, _, k in spans], strict=True)
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the spans (kind, start, end) of every row's whole text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t.as_py() or b"")] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, kind)], names=[*keep, "spans"])

    rows = docs.select(F.col(text).cast("binary").alias("__text"), *keep)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(search, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "spans array<struct<kind: string, start: long, end: long>>"]))
