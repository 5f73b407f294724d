"""Secret scan: plain patterns, then structural confirmation of encoded candidates.

The patterns (an assignment to a telling name, a cloud access id, a long hex run) give the base spans.
Beside them, candidates that look encoded are decoded and parsed, and reported only if what is inside
holds together:

* ``pem``: an armoured private key.  Its body must decode to a key as below, or, if its header says that
  it is encrypted, to whole cipher blocks.
* ``key``: a bare base64 or hex run (one line, or lines of 64 or 76) that decodes to DER, whose nested
  lengths fill it exactly, with the fields of a private key; numbers are checked against each other
  (``p * q = n``, ``g ** x = y``).  Or to an OpenSSH container, length prefix by length prefix.
* ``jwt``: a signed token.  Its header names an algorithm, its payload is a JSON object, and its signature
  is as long as that algorithm makes it.
* ``coded``: a base64 or hex run that decodes to text with one of the above in it, or an assignment or an
  access id; up to DEPTH codings deep.

Spans count code points, end exclusive.  An added span inside another added one is left out.

Cases with a defined result
    null or empty text: no spans; null or repeated ids, repeated rows: each row by its own text
    ties in the start of a span: by kind, as KINDS lists them, then by end
    very long text: read whole; empty table: an empty result
    extra columns, whatever their names: passed through
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import positional, ship

# --- fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: A match that is too short hides no longer one here: a run is matched from its start.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# --- end of the fixed values

KINDS = ("assign", "access", "hex", "pem", "key", "jwt", "coded")
BASE = KINDS[:3]
#: Codings within codings that are followed.
DEPTH = 4

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/=])(?:(?:[A-Za-z0-9+/]{64}\r?\n)+|(?:[A-Za-z0-9+/]{76}\r?\n)+)[A-Za-z0-9+/]{1,76}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
#: Any text with a span matches this; it is tried on a whole batch first.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|-----BEGIN |eyJ|[A-Za-z0-9+/_-]{24}"

# --- fixed values: object identifiers (DER) and signature bytes of algorithms
_RSA, _EC, _DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_ENCRYPTED = (bytes.fromhex("2a864886f70d01050d"), bytes.fromhex("2a864886f70d010c01"), bytes.fromhex("2a864886f70d0105"))
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "Ed25519": 64, "Ed448": 114}
_MODULUS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
# --- end of the fixed values

Der = list[tuple[int, bytes]]


def der(data: bytes) -> Der | None:
    """(tag, content) of consecutive DER values that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 31 == 31:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n > 127:
            wide = n & 127
            if not 0 < wide <= 4 or at + wide > len(data):
                return None
            n, at = int.from_bytes(data[at : at + wide]), at + wide
            if n < 128 or n >> 8 * (wide - 1) == 0:  # not the shortest form
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _shape(parts: Der | None, tags: tuple[int, ...]) -> list[bytes] | None:
    return [x for _, x in parts] if parts is not None and tuple(t for t, _ in parts) == tags else None


def _numbers(parts: Der | None, count: int) -> list[int] | None:
    found = _shape(parts, (2,) * count)
    return [int.from_bytes(x, signed=True) for x in found] if found and all(found) else None


def _rsa(parts: Der | None) -> bool:
    v = _numbers(parts, 9)
    return bool(v) and v[0] == 0 and min(v[1:]) > 0 and v[4] * v[5] == v[1]


def _dsa(parts: Der | None) -> bool:
    v = _numbers(parts, 6)
    if not v or v[0] or min(v[1:]) <= 0:
        return False
    _, p, q, g, y, x = v
    return p.bit_length() <= 4096 and x < q and (p - 1) % q == 0 and pow(g, x, p) == y


def _ec(parts: Der | None) -> bool:
    """SEC 1: version 1, the number, perhaps a curve [0] and a point [1]."""
    if not parts or len(parts) < 2 or parts[0] != (2, b"\x01") or parts[1][0] != 4 or not 20 <= len(parts[1][1]) <= 66:
        return False
    return all(tag in (0xA0, 0xA1) and der(x) for tag, x in parts[2:]) and len(parts) <= 4


def _pkcs8(parts: Der | None) -> bool:
    """Version, algorithm, the key itself in a string, perhaps attributes."""
    if not parts or len(parts) < 3 or [t for t, _ in parts[:3]] != [2, 0x30, 4] or parts[0][1] not in (b"\0", b"\1"):
        return False
    algorithm, key = der(parts[1][1]), parts[2][1]
    if not algorithm or algorithm[0][0] != 6:
        return False
    inner, name = der(key), algorithm[0][1]
    within = der(inner[0][1]) if inner and len(inner) == 1 and inner[0][0] == 0x30 else None
    if name == _RSA:
        return _rsa(within)
    if name == _EC:
        return _ec(within)
    if name == _DSA:
        return bool(_numbers(inner, 1))
    return name in _CURVES and bool(inner) and inner[0][0] == 4 and len(inner[0][1]) == _CURVES[name]


def _sealed(parts: Der | None) -> bool:
    """An encrypted PKCS 8 key: algorithm and parameters, then a string."""
    found = _shape(parts, (0x30, 4))
    algorithm = der(found[0]) if found and len(found[1]) >= 8 else None
    return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1].startswith(_ENCRYPTED)


def _strings(data: bytes) -> list[bytes] | None:
    """Byte strings with four-byte lengths that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    rest, head = data[len(magic) :], []
    for _ in range(3):  # cipher, derivation, its options
        n = int.from_bytes(rest[:4])
        head.append(rest[4 : 4 + n])
        rest = rest[4 + n :]
    count, strings = int.from_bytes(rest[:4]), _strings(rest[4:])
    if not 0 < count < 100 or strings is None or len(strings) != count + 1 or not all(_strings(x) for x in strings[:-1]):
        return False
    return bool(strings[-1]) if head[0] != b"none" else len(strings[-1]) >= 8 and strings[-1][:4] == strings[-1][4:8]


def is_private_key(data: bytes) -> bool:
    """Whether ``data`` is, from its first to its last byte, the encoding of a private key."""
    if data[:1] != b"\x30":
        return _openssh(data)
    outer = der(data)
    inside = der(outer[0][1]) if outer and len(outer) == 1 else None
    return _rsa(inside) or _ec(inside) or _pkcs8(inside) or _sealed(inside) or _dsa(inside)


def _decode(run: str) -> list[bytes]:
    """What a run may stand for, read as hex and as base64."""
    out, body = [], run.rstrip("=")
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        out.append(bytes.fromhex(run))
    if len(body) % 4 != 1:
        try:
            out.append(base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def _is_token(run: str) -> bool:
    head, body, signature = run.split(".")
    parts = []
    for x in (head, body):
        try:
            parts.append(json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in parts) or len(signature) % 4 == 1:
        return False
    algorithm, n = parts[0].get("alg"), len(signature) * 3 // 4
    if not isinstance(algorithm, str):
        return False
    return n == _SIGNATURE.get(algorithm) or algorithm in _MODULUS and 128 <= n <= 2048


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    for m in _ARMOUR.finditer(text):
        end = f"-----END {m[1]}-----"
        at = text.find("-----", m.end())
        if at < 0 or not text.startswith(end, at):
            continue
        # a line end may stand there as backslash and letter, as in JSON
        lines = re.split(r"(?:\\r|\\n|[\r\n])+", text[m.end() : at])
        heads = [x for x in lines if ":" in x]
        data = _decode(re.sub(r"\s", "", "".join(x for x in lines if ":" not in x)))
        sealed = any("ENCRYPTED" in x for x in heads)
        if any((len(x) >= 16 and len(x) % 8 == 0) if sealed else is_private_key(x) for x in data):
            yield m.start(), at + len(end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose structure holds."""
    out = [(a, 3, b) for a, b in _armoured(text)]
    out += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if _is_token(m[0])]
    for m in [*_LINES.finditer(text), *_RUN.finditer(text)]:
        for data in _decode(re.sub(r"[\r\n]", "", m[0])):
            if is_private_key(data):
                out.append((m.start(), 4, m.end()))
            elif depth > 1:
                try:
                    inner = data.decode()
                except UnicodeDecodeError:
                    continue
                if any(kind < 2 for _, kind, _ in base_spans(inner)) or confirmed_spans(inner, depth - 1):
                    out.append((m.start(), 6, m.end()))
    kept, upto = [], 0
    for a, kind, b in sorted(set(out), key=lambda s: (s[0], -s[2], s[1])):
        if b > upto:
            kept.append((a, kind, b))
            upto = b
    return kept


def spans(text: str) -> list[tuple[int, int, int]]:
    return sorted({*base_spans(text), *confirmed_spans(text)})


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans`` after its own columns: every span with its kind, start and end."""
    ship(docs.sparkSession)
    rows, at, _ = positional(docs)
    width = len(docs.columns)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width)
            likely = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(texts[i].as_py())] if hit else [] for i, hit in enumerate(likely)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(found, kind_type)], names=[*(f"c{i}" for i in range(width)), "spans"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), "spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return rows.select("*", F.col(at[text]).alias("text")).mapInArrow(per_task, schema).toDF(*docs.columns, "_spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap become one,
    named by the first."""
    rows, at, back = positional(docs)
    found, t = find_secrets(rows, at[text]), at[text]
    merged = """aggregate(_spans, CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>), (done, s) ->
        IF(size(done) > 0 AND s.start < element_at(done, -1).end,
           concat(slice(done, 1, size(done) - 1), array(named_struct('kind', element_at(done, -1).kind, 'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))"""
    pieces = f"""aggregate(_merged, named_struct('at', 0L, 'out', CAST(array() AS array<string>)), (done, s) ->
        named_struct('at', s.end, 'out', concat(done.out, array(substring({t}, CAST(done.at + 1 AS INT), CAST(s.start - done.at AS INT)), concat('[', s.kind, ']')))),
        done -> concat(array_join(done.out, ''), substring({t}, CAST(done.at + 1 AS INT))))"""
    return back(found.withColumn("_merged", F.expr(merged)).withColumn(t, F.when(F.size("_spans") > 0, F.expr(pieces)).otherwise(F.col(t))))


def report(docs: DataFrame) -> DataFrame:
    """The counts of each document and its spans as text."""
    base = f"filter(_spans, s -> s.kind IN {BASE})"
    joined = lambda x: f"array_join(transform({x}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(_spans, s -> s.kind = '{k}')) AS BIGINT)")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2(encode({joined(base)}, 'UTF-8'), 256)").alias("base_sha256"), F.expr(joined("_spans")).alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS[3:]],
    )
