r"""Secret scanning with structural confirmation.

Three base patterns are searched leftmost and without overlap. Beyond them, candidates in base64
or hex are decoded, and are reported only if the bytes parse: DER keys with consistent nested
lengths, OpenSSH key blobs with consistent field lengths, PEM armour around either, and
signed-token headers (three base64url parts whose first is a JSON object with ``alg``). Base64 may
be wrapped over lines of 20 characters or more, whose breaks may be escapes (``\n`` in a string).
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, frugal, text_buffer

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})")
_BREAK = r"(?:\r\n|\r|\n|\\+r\\+n|\\+[nr])"
_PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{1,40}})-----((?:[ \t]*{_BREAK}[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*)((?:[A-Za-z0-9+/=\s]|\\+[nrt/])+)-----END \1-----")
_ENCRYPTED = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
_SEPARATOR = re.compile(rf"[ \t]*{_BREAK}[ \t]*")
_LINES = re.compile(rf"[A-Za-z0-9+/_-]{{20,}}(?:{_SEPARATOR.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
#: What base64 of a DER SEQUENCE, of a public SSH blob and of an OpenSSH private key begins with.
_BEGINS = re.compile("M[A-P]|AAAA|b3BlbnNzaC1rZXktdj")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXBLOB = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "der_key", "ssh_key")
_RANK = {k: i for i, k in enumerate(KINDS)}
_KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2b6571", "2a8648ce380401")}
#: PBES2, PBES1 and the schemes of PKCS #12: what encrypted PKCS #8 keys begin with.
_PBE_OIDS = {bytes.fromhex(f"2a864886f70d0105{x}") for x in ("01", "03", "04", "06", "0a", "0b", "0d")} | {bytes.fromhex(f"2a864886f70d010c010{x}") for x in range(1, 7)}


_SSH_NAME = re.compile(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$")


# ---------------------------------------------------------------- decoders
def decode64(text: str) -> bytes | None:
    """Bytes of base64 or base64url text, or None."""
    plain = re.sub(r"\s+", "", text).replace("-", "+").replace("_", "/").rstrip("=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """(tag, content, items) of the DER values that fill ``data[at:end]`` exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length == 0x80:
            return None
        if length > 0x80:
            size = length & 0x7F
            if size > 4 or at + size > end:
                return None
            length = int.from_bytes(data[at : at + size], "big")
            at += size
            if length < 0x80:
                return None
        if at + length > end:
            return None
        inner: list = []
        if tag & 0x20:
            got = der_items(data, at, at + length, depth + 1)
            if got is None:
                return None
            inner = got
        out.append((tag, data[at : at + length], inner))
        at += length
    return out


def _oids(items: list) -> Iterator[bytes]:
    for tag, content, inner in items:
        if tag == 6:
            yield content
        yield from _oids(inner)


def is_der_key(data: bytes) -> bool:
    """A DER SEQUENCE over all the bytes that is shaped as a key."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    items = der_items(data, 0, len(data))
    if not items or len(items) != 1 or len(items[0][2]) < 2:
        return False
    inner = items[0][2]
    tags = [t for t, _, _ in inner]
    if any(oid in _KEY_OIDS for oid in _oids(items)):
        return True
    if tags == [2] * 9 and inner[0][1] in (b"\0", b"\1"):  # RSA private key
        return True
    if tags == [2, 2] and len(inner[0][1]) >= 64:  # RSA public key
        return True
    if tags == [2] * 6 and inner[0][1] == b"\0" and len(inner[1][1]) >= 64 and len(inner[2][1]) >= 20:  # DSA private key
        return True
    if tags == [0x30, 4] and len(inner[1][1]) >= 16 and inner[0][2] and inner[0][2][0][0] == 6 and inner[0][2][0][1] in _PBE_OIDS:  # encrypted PKCS #8
        return True
    return tags[:2] == [2, 4] and inner[0][1] == b"\1" and len(inner[1][1]) >= 16  # EC private key


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container, or a public key blob: length-prefixed fields to the end."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while at + 4 <= len(data) and fields < 3:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += 1
        return fields == 3 and at + 4 <= len(data)
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and bool(_SSH_NAME.match(fields[0]))


def key_ends(data: bytes, private: bool = False) -> list[int]:
    """Where a key that begins ``data`` may end by its own lengths, last first."""
    if data[:1] == b"\x30":
        size = data[1] & 0x7F if len(data) > 1 and data[1] > 0x80 else 0
        return [2 + size + (int.from_bytes(data[2 : 2 + size], "big") if size else data[1])] if len(data) > 1 + size and size <= 4 else []
    at, fields, wanted, out = 15 if private else 0, 0, 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if private and fields == 3 and not wanted:  # the number of keys; then a public part each, and the private part
            wanted, at = 4 + size, at + 4
            continue
        at, fields = at + 4 + size, fields + 1
        if at > len(data) or (not private and fields == 1 and not _SSH_NAME.match(data[4:at])):
            break
        if private and fields == wanted:
            return [at]
        if not private and fields > 1:
            out.append(at)
    return out[::-1]


def is_token_header(part: str) -> bool:
    data = decode64(part)
    if not data or data[:1] != b"{":
        return False
    try:
        got = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and isinstance(got.get("alg"), str)


# ---------------------------------------------------------------- spans
def long_runs(column: pa.Array, least: int = 20) -> np.ndarray:
    """Which rows have ``least`` bytes in a row that a key, hash or token could be made of.

    Every access, hex, token and blob candidate has such a run (``.`` in tokens joins runs of
    which the parts' total is what counts, so tokens are looked for by their prefix besides).
    """
    data, offs = text_buffer(column)
    n = len(offs) - 1
    inside = _RUN[data]
    out = np.zeros(n, bool)
    if not len(data):
        return out
    breaks = np.concatenate([[-1], np.flatnonzero(~inside), offs[1:-1] - 0.5, [len(data)]])
    breaks.sort()
    at = np.flatnonzero(np.diff(breaks) > least)
    owner = np.searchsorted(offs, np.floor(breaks[at]) + 1, "right") - 1
    out[owner[owner < n]] = True
    return out


def base_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """The spans of the three base patterns by kind; ``runs``: the text has a long run."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if runs:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _key_kind(data: bytes | None) -> str | None:
    return None if not data else "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def wrapped_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 over one or more successive lines. A key may begin with any line, and ends by
    its own lengths at the end of one, so whatever lines stand around it don't matter."""
    out = []
    for m in _LINES.finditer(text):
        a = m.start()
        if text[a] in "nrt" and text[a - 1 : a] == "\\":  # the letter of an escape
            a += 1
        edges = [a]
        for gap in _SEPARATOR.finditer(text, a, m.end()):
            edges += gap.span()
        edges.append(m.end())
        lines = list(zip(edges[::2], edges[1::2], strict=True))
        if not any(_BEGINS.match(text, b) for b, _ in lines):
            continue
        chars = "".join(text[b:e] for b, e in lines).rstrip("=")
        at, ends = 0, {}
        for b, e in lines:
            at = min(at + e - b, len(chars))
            ends[at] = e
        at = done = 0
        for b, e in lines:
            begins = _BEGINS.match(text, b) if at >= done else None
            if begins:
                # a DER header says the size; a blob's name comes before its fields are followed
                head = decode64(chars[at : at + 64][: (len(chars) - at) // 4 * 4]) or b""
                private = begins[0][0] == "b"
                if head[:1] != b"\x30" and (private or _SSH_NAME.match(head[4 : 4 + int.from_bytes(head[:4], "big")])):
                    rest = chars[at:]
                    head = decode64(rest[: len(rest) - (len(rest) % 4 == 1)]) or b""
                for size in key_ends(head, private):
                    stop = at - (-4 * size // 3)
                    kind = _key_kind(decode64(chars[at:stop])) if stop in ends else None
                    if kind:
                        out.append((kind, b, ends[stop]))
                        done = stop
                        break
            at += e - b
    return out


def confirmed_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """The spans that decoding and parsing confirm; ``runs``: the text has a long run."""
    out = []
    if "eyJ" in text or "ewo" in text or "eyA" in text or "ewk" in text or "ew0" in text:
        out += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_token_header(m[1])]
    armoured: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = decode64(re.sub(r"\\+[nrt]", "", m[3]).replace("\\", ""))
            sealed = data and _ENCRYPTED.search(m[2]) and m[1].endswith("PRIVATE KEY") and len(data) >= 16 and len(data) % 8 == 0
            if sealed or _key_kind(data):
                out.append(("pem_key", *m.span()))
                armoured.append(m.span())
    if not runs:
        return out
    wrapped = [f for f in wrapped_spans(text) if not any(a <= f[1] < b for a, b in armoured)]
    out += wrapped
    known = armoured + [f[1:] for f in wrapped]
    for pattern, decode in ((_BLOB, decode64), (_HEXBLOB, bytes.fromhex)):
        for m in pattern.finditer(text):
            kind = None if any(a <= m.start() < b for a, b in known) else _key_kind(decode(m[0]))
            if kind:
                out.append((kind, *m.span()))
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_text(text: str | None, runs: bool = True) -> tuple[list, list]:
    """(base spans, all spans) of a text, each by start and then kind; null is empty."""
    base = _ordered(base_spans(text or "", runs))
    return base, _ordered(base + confirmed_spans(text or "", runs))


def redact(text: str | None, mark: str = "[SECRET]", runs: bool = True) -> str | None:
    """The text with each union of overlapping spans replaced by ``mark``."""
    if text is None:
        return None
    out, at = [], 0
    spans = scan_text(text, runs)[1]
    if not spans:
        return text
    merged: list[list[int]] = []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


#: Bytes of text that are worked on at once.
PART = 2 << 20


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans for each row; null and empty texts have no spans.

    Repeated rows repeat, null ids stay, and an empty table gives no row. Of the columns only doc_id
    and text are read, so others may have any name; texts are worked on a few megabytes at a time.
    """
    kept = docs.select("doc_id", "text")
    schema = kept.drop("text").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_confirmed", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, limit=PART)):
            counts: list[list[int]] = [[], [], []]
            digests, spans, more = [], [], []
            for value, runs in zip(batch.column(1), long_runs(batch.column(1)).tolist(), strict=True):
                base, every = scan_text(value.as_py(), runs)
                for out, kind in zip(counts, KINDS[:3], strict=True):
                    out.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                more.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=schema.names)

    return kept.mapInArrow(frugal(run), schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; ``n_chars``, if there, follows changed texts."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, limit=PART)):
            old = batch.column(at).to_pylist()
            new = [redact(t, runs=r) for t, r in zip(old, long_runs(batch.column(at)).tolist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                chars = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(size).to_pylist(), strict=True)]
                columns[size] = pa.array(chars, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(frugal(run), docs.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; an empty table gives no row."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
