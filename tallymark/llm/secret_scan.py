"""Secret scans with structural confirmation (operator 4).

Patterns find assignments, access keys and long hex runs. Beyond these, candidates written in base64 or hex are decoded
and reported only when their bytes parse as what they claim to be:

* ``jwt``: three base64url segments, of which the first decodes to a JSON object with an "alg" text;
* ``pem``: a BEGIN/END block of a key whose body is base64 of well-nested DER (or of an OpenSSH key), or, after header
  lines that name a cipher, of whole cipher blocks;
* ``der``: base64 (either alphabet, also over several lines) or hex of a DER sequence whose nested lengths add up to the
  very number of bytes and whose members are those of a key: see ``is_key_der``;
* ``ssh``: base64 of an SSH public key: length-prefixed fields, the first a known key type, that fill the whole.

Rows are independent: an Arrow pass with no shuffle, in which a text that lacks a rare substring of a pattern is never
scanned for it.

Defined results: a null text is empty; spans are code points, end exclusive; equal spans of two kinds are both kept, in
the order of the kinds; a very long text is scanned as a whole; repeated rows get equal results; extra columns play no
part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order of their listing, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Base64 of a brace and a quote or white space starts so; the parser decides.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----\s*+((?:[A-Za-z0-9-]+: [^\n]*\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_-])AAAA[A-Za-z0-9+/]{44,}+={0,2}(?![A-Za-z0-9+/=_-])")
#: Base64 of a DER sequence starts so; BODY is what may follow, line by line.
DER_START = re.compile(r"(?<![A-Za-z0-9+/=_-])M[A-Za-z0-9+/_-]{15}")
BODY = re.compile(r"[A-Za-z0-9+/_-]++(?:\r?\n(?=[A-Za-z0-9+/_-]))?")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}+(?![0-9A-Fa-f])")
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06
#: The encoded beginnings of the algorithm identifiers of keys and of encrypted keys.
KEY_ALGORITHMS = tuple(map(bytes.fromhex, (
    "2a864886f70d0101",  # RSA and its variants
    "2a8648ce3804",  # DSA
    "2a8648ce3d0201",  # elliptic curves
    "2a864886f70d0103",  # Diffie-Hellman
    "2a8648ce3e0201",
    "2b656e", "2b656f", "2b6570", "2b6571",  # X25519, X448, Ed25519, Ed448
)))
CIPHERS = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01")))


def decoded(text: str) -> bytes | None:
    """Bytes of base64 or base64url text, padded or not; None where it is neither."""
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Bytes = bytes | memoryview
#: Members of a key's sequence at most; the longest, that of RSA, has ten.
MEMBERS = 16


def der_size(data: Bytes, at: int) -> tuple[int, int] | None:
    """Where the content of the item at ``at`` begins and ends; None where its head is cut off or no DER."""
    if at + 2 > len(data):
        return None
    size, begin = data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or begin + more > len(data):
            return None
        size, begin = int.from_bytes(data[begin : begin + more], "big"), begin + more
    return begin, begin + size


def first_items(data: Bytes, most: int) -> list[tuple[int, Bytes]]:
    """(tag, content) of the first items of data, at most so many and only such as lie within it."""
    items, at = [], 0
    while len(items) < most and at < len(data) and (head := der_size(data, at)) is not None and head[1] <= len(data):
        items.append((data[at], data[head[0] : head[1]]))
        at = head[1]
    return items


def is_der(data: Bytes) -> bool:
    """Whether items fill data exactly, constructed ones checked inside at any depth."""
    open_ = [(0, len(data))]
    while open_:
        at, end = open_.pop()
        while at < end:
            head = der_size(data, at)
            if head is None or head[1] > end:
                return False
            if data[at] & 0x20:
                open_.append(head)
            at = head[1]
    return True


def is_key_der(data: Bytes) -> bool:
    """Whether data is one DER sequence with the members of a key:

    * a version of one byte, at most 3, then a private key in octets, an algorithm, or a modulus or prime of 64 bytes or
      more and another number;
    * a modulus of 64 bytes or more and an odd exponent of 8 bytes at most, and nothing else;
    * a known algorithm, then the key's bits, or a cipher, then the encrypted key.

    The first members are looked at before all items are checked, so most candidates end after a few bytes.
    """
    outer = first_items(data, 1)
    head = der_size(data, 0)
    if not outer or head is None or head[1] != len(data) or outer[0][0] != SEQUENCE:
        return False
    inner = first_items(outer[0][1], MEMBERS + 1)
    if not 2 <= len(inner) <= MEMBERS:
        return False
    (tag, content), (tag2, content2) = inner[:2]
    if tag == INTEGER and len(content) == 1 and content[0] <= 3:
        fits = tag2 == OCTETS or (tag2 == SEQUENCE and has_algorithm(content2, KEY_ALGORITHMS)) or (tag2 == INTEGER and len(content2) >= 64 and len(inner) > 2 and inner[2][0] == INTEGER)
    elif tag == INTEGER:
        fits = len(inner) == 2 and tag2 == INTEGER and len(content) >= 64 and 1 <= len(content2) <= 8 and content2[-1] % 2 == 1
    else:
        fits = tag == SEQUENCE and (tag2 == BITS and has_algorithm(content, KEY_ALGORITHMS) or tag2 == OCTETS and has_algorithm(content, CIPHERS))
    return bool(fits) and is_der(data)


def has_algorithm(content: Bytes, known: tuple[bytes, ...]) -> bool:
    """Whether the first item of content is an object identifier that begins as one of the known."""
    items = first_items(content, 1)
    return bool(items) and items[0][0] == OID and bytes(items[0][1][:16]).startswith(known)


class Base64Run:
    """The base64 lines that follow one another from a place in a text, read and decoded once for all that begins in them."""

    def __init__(self, text: str, start: int):
        parts, self.begins, self.ends, size = [], {}, {}, 0
        at = start
        while (m := BODY.match(text, at)) is not None:
            part = m[0].rstrip("\r\n")
            parts.append(part)
            self.begins[at] = size
            size += len(part)
            self.ends[size] = at + len(part)
            at = m.end()
            if len(part) == len(m[0]):
                break
        self.signs = "".join(parts).replace("-", "+").replace("_", "/")
        self.read: dict[int, bytes] = {}

    def data(self, begin: int, size: int) -> memoryview:
        """size bytes from the sign begin on; the signs are decoded once for each of the four ways to group them."""
        way = begin % 4
        if way not in self.read:
            signs = self.signs[way:]
            self.read[way] = base64.b64decode(signs + "A" * (-len(signs) % 4))
        first = (begin - way) // 4 * 3
        return memoryview(self.read[way])[first : first + size]


def base64_key(text: str, start: int, run: Base64Run) -> int | None:
    """The end of a base64 key that begins at start, a line's begin in run: as many signs as its own length asks for, which
    have to end with a line."""
    head = decoded(text[start : start + 16])
    size = der_size(head, 0) if head and head[0] == SEQUENCE else None
    if size is None or size[1] < 36:
        return None
    begin = run.begins[start]
    last = run.ends.get(begin - (-size[1] * 4 // 3))
    if last is None:
        return None
    at = last
    while at < len(text) and text[at] == "=" and at < last + 2:
        at += 1
    return at if text[at : at + 1] != "=" and is_key_der(run.data(begin, size[1])) else None


def is_ssh_key(data: bytes) -> bool:
    """Whether data is length-prefixed fields, the first a key type, that end with it."""
    fields, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0] in SSH_TYPES


def is_token_header(segment: str) -> bool:
    data = decoded(segment)
    try:
        header = json.loads(data) if data else None
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def confirmed(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose structure parses."""
    if "ey" in text or "ew" in text:
        for m in JWT.finditer(text):
            if is_token_header(m[0].split(".")[0]):
                yield *m.span(), "jwt"
    blocks = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decoded(m[3])
            if data and (data.startswith(b"openssh-key-v1\0") or is_key_der(data) or ("DEK-Info:" in m[2] and len(data) % 8 == 0)):
                blocks.append(m.span())
                yield *m.span(), "pem"
    upto = block = 0
    run: Base64Run | None = None
    for m in DER_START.finditer(text):
        while block < len(blocks) and blocks[block][1] <= m.start():
            block += 1
        if block < len(blocks) and blocks[block][0] <= m.start():
            continue  # the body of a block that is reported as such
        if m.start() < upto:
            continue
        if run is None or m.start() not in run.begins:
            run = Base64Run(text, m.start())
        if end := base64_key(text, m.start(), run):
            upto = end
            yield m.start(), end, "der"
    if "AAAA" in text:
        for m in BASE64.finditer(text):
            data = decoded(m[0])
            if data and is_ssh_key(data):
                yield *m.span(), "ssh"
    if "30" in text:
        for m in HEX_KEY.finditer(text):
            if len(m[0]) % 2 == 0 and is_key_der(bytes.fromhex(m[0])):
                yield *m.span(), "der"


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield *m.span(), "assign"
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield *m.span(), "access"
    for m in HEX.finditer(text):
        yield *m.span(), "hex"


def listed(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, the base spans and all spans as text."""
    text = text or ""
    base = list(base_spans(text))
    count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
    return *count, listed(base), listed([*base, *confirmed(text)])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            digests = pa.array([hashlib.sha256(f[3].encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, digests, pa.array([f[4] for f in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
