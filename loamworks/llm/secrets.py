"""Secret scans: base patterns, and structural confirmation of encoded keys and signed tokens.

A long base64 or hex run is only a candidate. It is reported once it decodes and its structure holds: DER private keys
whose nested lengths add up, OpenSSH private keys whose length-prefixed fields fill the blob, PEM blocks that hold one
of these (or an encrypted body), signed tokens whose header and payload are JSON objects with an algorithm. Every search takes
time in proportion to the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, keyed_text

#: Kinds in the order in which spans with one start are listed: the base ones first.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "b64key", "hexkey")
#: A run shorter than this can't hold a key or a signed token.
LEAST_RUN = 40


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({_WORDS}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,32} ){0,4})PRIVATE KEY-----")
ESCAPED_BREAK = re.compile(r"(?:\\+[rn])+")
#: Dotted runs, in which three successive segments may be a signed token.
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill data exactly, or None if lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            count = length & 0x7F
            if not 1 <= count <= 4 or at + count > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + count], "big"), at + count
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def der_key(data: bytes) -> bool:
    """A private key as PKCS#1, PKCS#8, SEC 1 or DSA has it: a sequence that starts with its version number."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = elements(outer[0][1])
    if not parts or len(parts) < 3 and (len(parts) < 2 or parts[1][0] != 0x04) or parts[0] not in ((0x02, b"\0"), (0x02, b"\1")):
        return False
    if parts[1][0] == 0x30:  # PKCS#8: algorithm, then the key
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][0] == 0x04
    if parts[1][0] == 0x04:  # SEC 1
        return len(parts[1][1]) in (20, 24, 28, 32, 48, 66)
    return len(parts) >= 6 and all(tag == 0x02 and body for tag, body in parts)


def encrypted_der(data: bytes) -> bool:
    """PKCS#8 under a password: algorithm and octets."""
    outer = elements(data)
    parts = elements(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    return bool(parts) and [tag for tag, _ in parts] == [0x30, 0x04]


def openssh_key(data: bytes) -> bool:
    """Magic, then cipher, key derivation and its options, a count, that many public keys and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> int | None:
        nonlocal at
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        at += 4 + n
        return n

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys + 1)) and at == len(data)


def json_object(segment: str) -> dict | None:
    """The JSON object that a base64 segment encodes."""
    data = decoded(segment)
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of signed tokens: header and payload are JSON objects, the header names an algorithm, and a signature
    of 16 bytes or more follows (none needs none). In a dotted run each segment may be a header."""
    for m in DOTTED.finditer(text):
        if len(m[0]) < LEAST_RUN or m[0].count(".") < 2:
            continue
        segments, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(segments):
            header, payload, signature = segments[k : k + 3]
            size, head = len(header) + len(payload) + len(signature) + 2, None
            if len(header) >= 8 and len(payload) >= 2 and size >= LEAST_RUN:
                head = json_object(header)
            name = head.get("alg") if head else None
            if isinstance(name, str) and json_object(payload) is not None and (name.lower() == "none" or len(decoded(signature) or b"") >= 16):
                yield at, at + size
                at, k = at + size + 1, k + 3
            else:
                at, k = at + len(header) + 1, k + 1


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of PEM blocks whose body holds a key: a mark of the beginning and the next mark, that of its end."""
    last = None
    for mark in PEM_MARK.finditer(text):
        if last and last[1] == "BEGIN" and mark[1] == "END" and last[2] == mark[2] and pem_key(mark[2], text[last.end() : mark.start()]):
            yield last.start(), mark.end()
        last = mark


def pem_key(label: str, body: str) -> bool:
    """The body of a PEM block, header lines (as of encrypted ones) left out. Breaks and slashes may be escaped, as in JSON."""
    lines = [x.strip() for x in ESCAPED_BREAK.sub("\n", body).replace("\\/", "/").splitlines()]
    data = decoded("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines):
        return len(data) % 8 == 0
    return encrypted_der(data) if label.startswith("ENCRYPTED") else openssh_key(data) if label.startswith("OPENSSH") else der_key(data)


def spans(text: str) -> list[tuple[str, int, int, int]]:
    """kind, start, end, start of the secret itself (code points), in order."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", a, b, a) for a, b in pem_blocks(text)]
    if max(map(len, text.split()), default=0) >= 24:
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
        out += [("jwt", a, b, a) for a, b in signed_tokens(text)]
        for m in B64.finditer(text):
            data = decoded(m[0])
            if data and (der_key(data) or openssh_key(data)):
                out.append(("b64key", m.start(), m.end(), m.start()))
        out += [("hexkey", m.start(), m.end(), m.start()) for m in ANY_HEX.finditer(text) if der_key(bytes.fromhex(m[0])) or openssh_key(bytes.fromhex(m[0]))]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by start, then kind as KINDS lists them.

    Positions are code points, end exclusive. One row for each input row; null or empty texts have no spans.
    """
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in spans(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], ["doc_id", "spans"])

    read = keyed_text(df, id_col, text_col)
    return read.mapInArrow(by_slices(each), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, spans {kind}")


def without_secrets(text: str | None, mark: str) -> str | None:
    """The text with each secret (of an assignment, the value) replaced by mark; what overlaps gets one."""
    if not text:
        return text
    out, at, upto = [], 0, -1
    for start, end in sorted((inner, end) for _, _, end, inner in spans(text)):
        if start >= upto:
            out += [text[at:start], mark]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """df with the secrets in its text column replaced by mark; all rows and other columns stay, null texts too."""
    at = df.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cleaned = pa.array([without_secrets(t, mark) for t in batch.column(at).to_pylist()], pa.string())
        return batch.set_column(at, batch.schema.field(at).with_type(pa.string()), cleaned)

    return df.mapInArrow(by_slices(each), df.schema)


def span_text(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(
        F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
