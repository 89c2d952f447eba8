"""Secret scans: base patterns, and encodings confirmed by their structure.

Base spans (leftmost, non-overlapping by kind): assign, access, hex. Added spans
are reported only when what they hold decodes and parses: jwt (a signed token whose
header is a JSON object with alg), der (base64 or hex of one DER SEQUENCE whose
nested lengths fill it exactly and which holds an INTEGER, BIT STRING or OCTET
STRING), ssh (length-prefixed SSH public or private key).

Bytes are screened for long runs in numpy, and for the beginning of a JWT; only texts with a candidate are searched
as strings. Nulls are empty; a row gives a row; spans count code points.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.common import chunks, id_text

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_DASHES = re.compile("-{5,}")
_LINE = re.compile(r"[^\r\n]+")
_KEY_STARTS = ("M", "AAAA", "b3BlbnNzaC1rZXktdjEA")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True
_CODE_BYTE = np.zeros(256, bool)
_CODE_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="]] = True
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def der_elements(data: bytes, depth: int = 0) -> list[int] | None:
    """The tags of nested TLVs that fill data exactly, or None. Lengths must be definite and shortest."""
    if depth > 24:
        return None
    at, tags = 0, []
    while at < len(data):
        if at + 2 > len(data) or data[at] & 31 == 31:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size > 127:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 128:
                return None
        if at + size > len(data):
            return None
        tags.append(tag)
        if tag & 32:
            inner = der_elements(data[at : at + size], depth + 1)
            if inner is None:
                return None
            tags += inner
        at += size
    return tags


def is_der_key(data: bytes) -> bool:
    if len(data) < 24 or data[0] != 0x30:
        return False
    tags = der_elements(data)
    return bool(tags) and tags.count(0x30) >= 1 and len(tags) >= 3 and any(t in (2, 3, 4) for t in tags)


def is_ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container, or a public key: length-prefixed fields that fill the data."""
    head = b"openssh-key-v1\0"
    private = data.startswith(head)
    at, fields = len(head) if private else 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        if private and len(fields) == 3:  # the number of keys comes here
            fields.append(b"")
            at += 4
            continue
        if size > len(data) - at - 4:
            return private and len(fields) >= 4
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if private:
        return len(fields) >= 5
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def unbase64(text: str) -> bytes | None:
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_jwt(head: str, body: str) -> bool:
    for part, key in ((head, "alg"), (body, None)):
        data = unbase64(part)
        if data is None:
            return False
        try:
            value = json.loads(data)
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or key and key not in value:
            return False
    return True


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _base64_keys(found: str, at: int) -> Iterator[tuple[int, str, int]]:
    """Keys in what BASE64 found at `at`: each begins and ends at limits of lines or of -----, and is the longest that parses."""
    edges = [0, *(x for m in _DASHES.finditer(found) for x in m.span()), len(found)]
    for begin, end in zip(edges[::2], edges[1::2]):
        lines = [m.span() for m in _LINE.finditer(found, begin, end)]
        k = 0
        while k < len(lines):
            stop = None
            if found.startswith(_KEY_STARTS, lines[k][0]):
                stop = _key_lines(found, lines[k:])
            if stop is None:
                k += 1
                continue
            n, kind = stop
            yield at + lines[k][0], kind, at + lines[k + n - 1][1]
            k += n


def _key_lines(found: str, lines: list[tuple[int, int]]) -> tuple[int, str] | None:
    """How many of the lines are one key, as many as can be, and its kind."""
    sizes = list(accumulate(len(found[a:b].rstrip("=")) for a, b in lines))
    if found[lines[0][0]] == "M":  # a DER SEQUENCE: its header says where it ends
        head = unbase64(found[lines[0][0] : lines[0][0] + 8]) or b""
        if len(head) < 6 or head[1] == 128 or head[1] > 132:
            return None
        n = head[1] & 127 if head[1] > 127 else 0
        size = 2 + n + (int.from_bytes(head[2 : 2 + n]) if n else head[1])
        chars = -(-size * 4 // 3)
        if chars not in sizes:
            return None
        n = sizes.index(chars) + 1
        return (n, "der") if is_der_key(unbase64("".join(found[a:b] for a, b in lines[:n])) or b"") else None
    text = "".join(found[a:b].rstrip("=") for a, b in lines)
    data = unbase64(text[: len(text) - (len(text) % 4 == 1)]) or b""
    for n in range(len(sizes), 0, -1):
        if sizes[n - 1] % 4 != 1 and is_ssh_key(data[: sizes[n - 1] * 3 // 4]):
            return n, "ssh"
    return None


def find(text: str, assign: bool = True, access: bool = True, runs: bool = True) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end), by start and then by kind as listed. The flags leave out searches known to be empty."""
    out: set[tuple[int, int, int]] = set()
    if assign:
        out |= {(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6}
    if access:
        out |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20}
    if runs:
        out |= {(m.start(), 2, m.end()) for m in HEX.finditer(text)}
        for m in JWT.finditer(text):
            if is_jwt(m[1], m[2]):
                out.add((m.start(), 3, m.end()))
        for m in BASE64.finditer(text):
            out |= {(a, KINDS.index(kind), b) for a, kind, b in _base64_keys(m[0], m.start())}
        for m in ANY_HEX.finditer(text):
            if kind := _key_kind(bytes.fromhex(m[0])):
                out.add((m.start(), KINDS.index(kind), m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def scan_texts(texts: pa.Array) -> list[list[tuple[int, str, int]]]:
    """find() for every text of an array; texts without a long run or a key word cost no search."""
    data, offsets = vec.utf8(texts)
    n = len(offsets) - 1
    limit = vec.limits(len(data), offsets)
    has_run = np.zeros(n, bool)
    for mask, least in ((_HEX_BYTE, 24), (_CODE_BYTE, 24)):
        starts, ends = vec.pieces(mask[data], limit)
        has_run[np.searchsorted(offsets, starts[ends - starts >= least], side="right") - 1] = True
    sign = (data == 58) | (data == 61)
    at_sign = np.concatenate([[0], np.cumsum(sign)])
    has_sign = at_sign[offsets[1:]] > at_sign[offsets[:-1]]
    raw, out = data.tobytes(), []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        assign = False
        if has_sign[k]:
            low = raw[a:b].lower()
            assign = any(w in low for w in _WORDS)
        access = raw.find(b"AKIA", a, b) >= 0
        runs = bool(has_run[k]) or raw.find(b"eyJ", a, b) >= 0  # the parts of a JWT may be short
        out.append(find(raw[a:b].decode("utf-8", "replace"), assign, access, runs) if assign or access or runs else [])
    return out


def _listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = scan_texts(part["text"])
                base = [[s for s in x if s[1] in KINDS[:3]] for x in found]
                count = lambda kind: pa.array([sum(s[1] == kind for s in x) for x in base], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *map(count, KINDS[:3]), pa.array([hashlib.sha256(_listed(x).encode()).hexdigest() for x in base], pa.string()), pa.array(list(map(_listed, found)), pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """text with every span, overlapping ones together, replaced by [KIND] of its first kind."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced; every row and column stays (n_chars, where there is one, follows the text)."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = part["text"]
                found = scan_texts(text)
                if any(found):
                    new = [redact(t, s) if s else t for t, s in zip(text.to_pylist(), found)]
                    part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(new, text.type))
                yield part

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
