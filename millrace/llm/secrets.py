"""Secret scan: base patterns, and structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import lengths, map_texts, parts

# The kinds, in the order that breaks ties between spans with one start.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "ssh", "hexder")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The first part decodes to something that begins with a brace and perhaps white space.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Base64 over several lines of some width, without armour.
#: A run is entered at its start only and never given back, so a long one costs its length.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:\r?\n[A-Za-z0-9+/]{40,80}+)*\r?\n[A-Za-z0-9+/]{1,80}+={0,2}+(?![A-Za-z0-9+/=])")
#: Where a key can begin in a run: at its start or after a separator.
BEGINS = re.compile(r"(?:^|(?<=[/_+=-]))(?=M[A-Za-z0-9+/_-]{7}|AAAA|b3BlbnNza)")
HEXBLOB = re.compile(r"[0-9a-fA-F]{64,}")
NEEDED = re.compile(r"[A-Za-z0-9+/_-]{40}")
NESTING = 12
#: Fields of an SSH key's wire form, at most.
FIELDS = 16


def b64(text: str) -> bytes | None:
    """Decoded base64 of either alphabet, padded or not; None if it isn't."""
    s = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, depth) of all elements if data is a run of DER elements whose nested lengths all fit; else None."""
    items, at = [], 0
    while at < len(data):
        if depth > NESTING or at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, depth))
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            inner = der_items(data[at : at + size], depth + 1)
            if inner is None:
                return None
            items += inner
        at += size
    return items


def is_der_key(data: bytes | None) -> bool:
    """One outer SEQUENCE whose nested lengths add up and which holds an INTEGER and key material."""
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    items = der_items(data)
    if not items or sum(d == 0 for _, d in items) != 1 or len(items) < 4:
        return False
    tags = {t for t, _ in items}
    return 0x02 in tags and bool(tags & {0x04, 0x03}) or sum(t == 0x02 for t, _ in items) >= 3


def is_ssh_key(data: bytes | None) -> bool:
    """OpenSSH private key magic, or the wire form: length-prefixed fields that end exactly, a key type first."""
    if not data or len(data) < 20:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def der_total(head: bytes | None) -> int:
    """The length that the header of an outer SEQUENCE announces, header included; 0 for no such header."""
    if not head or len(head) < 6 or head[0] != 0x30:
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4:
        return 0
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def fields_fit(run: str, start: int, size: int) -> bool:
    """Whether length-prefixed fields from start end where the run does; only the lengths are decoded."""
    total, at = (size - start) * 3 // 4, 0
    for _ in range(FIELDS):
        piece = b64(run[start + at // 3 * 4 : start + at // 3 * 4 + 12]) or b""
        if len(piece) < at % 3 + 4:
            return False
        at += 4 + int.from_bytes(piece[at % 3 : at % 3 + 4], "big")
        if at >= total:
            return at == total
    return False


def key_in(run: str) -> tuple[int, str] | None:
    """Where in a run of base64 a key begins that ends with it, and its kind. Lengths are looked at before anything long is decoded."""
    joined = "".join(run.split())
    size, plain = len(joined.rstrip("=")), joined.replace("-", "+").replace("_", "/")
    for m in BEGINS.finditer(joined):
        left = size - m.start()
        if joined[m.start()] == "M":
            total = der_total(binascii.a2b_base64(plain[m.start() : m.start() + 8]))
            if -(-total * 4 // 3) == left and is_der_key(b64(joined[m.start() :])):
                return m.start(), "der"
        else:
            head = b64(joined[m.start() : m.start() + 40]) or b""
            if head.startswith(b"openssh-key-v1\0") and (size - m.start()) % 4 != 1:
                return m.start(), "ssh"
            if re.match(rb"\0\0\0.(ssh|ecdsa|sk)-", head, re.DOTALL) and fields_fit(joined, m.start(), size) and is_ssh_key(b64(joined[m.start() :])):
                return m.start(), "ssh"
    return None


def is_pem_body(body: str) -> bool:
    """A key behind header lines, if any, and line breaks, written out or not; an encrypted one is known by its headers and whole blocks."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    headers = [x for x in lines if ":" in x]
    data = b64("".join(x for x in lines if ":" not in x))
    if is_der_key(data) or is_ssh_key(data):
        return True
    return bool(data) and len(data) >= 16 and len(data) % 8 == 0 and any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers) and any(x.startswith("DEK-Info:") for x in headers)


def is_jwt_header(part: str) -> bool:
    try:
        head = json.loads(b64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind as listed.

    Base kinds are reported on their pattern alone. jwt, pem, der, ssh and hexder are reported only if
    the decoded bytes parse: a JSON header with "alg", nested DER lengths that add up, or an SSH key's
    fields.
    """
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "ey" in text or "ew" in text:
        spans += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_jwt_header(m[1])]
    if "PRIVATE KEY-----" in text:
        spans += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if is_pem_body(m[2])]
    if NEEDED.search(text):
        taken = 0
        for m in sorted((*BLOB.finditer(text), *WRAPPED.finditer(text)), key=lambda m: (m.start(), -m.end())):
            if m.start() >= taken and (found := key_in(m[0])):
                spans.append((m.start() + found[0], m.end(), found[1]))
                taken = m.end()
        for m in HEXBLOB.finditer(text):
            if is_der_key(bytes.fromhex(m[0][: len(m[0]) & ~1])):
                spans.append((m.start(), m.end(), "hexder"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    out, done = [], 0
    for start, end, _ in find_spans(text):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = T.StructType([T.StructField(n, T.StringType() if n in ("base_sha256", "spans") else T.LongType()) for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, digest and list of the spans of the whole text.

    A null text counts as empty; texts without a finding get zero counts, the digest of nothing and an
    empty list. Repeated rows and null ids pass through; other columns are ignored. No shuffle.
    """

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            spans = find_spans((text or b"").decode("utf-8", "replace"))
            base = [s for s in spans if s[2] in BASE]
            yield doc_id, *(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)

    return map_texts(docs, ["doc_id"], rows, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by [SECRET] and n_chars, where present, brought up to date.

    Every row stays; rows without a finding stay as they are, null texts too.
    """

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(place).cast(pa.large_binary())
            for at, n in parts(lengths(raw)):
                part = batch.slice(at, n)
                clean = [None if t is None else redact_text(t) for t in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(clean, type=part.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
