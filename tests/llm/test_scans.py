"""Secrets, filter interaction and periodic runs against plain versions."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from shelfmark.llm import filter_audit, secret_scan, word_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _spans string, c0 string, mask long, part string, runs string"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, "x", "y", 1, "p", "r") for i, t, g in rows], SCHEMA).repartition(3)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- secrets


def _tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k)) + body


def _int(x):
    return _tlv(2, x.to_bytes(x.bit_length() // 8 + 1))


def _rsa(p=2**521 - 1, q=2**607 - 1, wrong=0):
    e = 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    return _tlv(0x30, b"".join(map(_int, (0, p * q + wrong, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p)))))


def _pkcs8(algorithm, key):
    return _tlv(0x30, _int(0) + _tlv(0x30, _tlv(6, bytes.fromhex(algorithm)) + _tlv(5, b"")) + _tlv(4, key))


def _openssh():
    s = lambda x: len(x).to_bytes(4) + x
    public = s(b"ssh-ed25519") + s(bytes(32))
    private = b"\1\2\3\4" * 2 + public + s(bytes(64)) + s(b"me@here") + b"\1\2\3"
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4) + s(public) + s(private)


def _url(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).rstrip(b"=").decode()


def _jwt(alg="HS256", n=32):
    return f"{_url({'alg': alg, 'typ': 'JWT'})}.{_url({'sub': '1'})}.{_url(bytes(range(n)))}"


def _pem(label, data, head="", end="\n"):
    b = base64.b64encode(data).decode()
    return end.join([f"-----BEGIN {label}-----", *([head, ""] if head else []), *(b[i : i + 64] for i in range(0, len(b), 64)), f"-----END {label}-----"])


B64 = lambda x: base64.b64encode(x).decode()
ED = _pkcs8("2b6570", _tlv(4, bytes(range(32))))
SEC1 = _tlv(0x30, _int(1) + _tlv(4, bytes(range(1, 33))) + _tlv(0xA0, _tlv(6, bytes.fromhex("2a8648ce3d030107"))))
SEALED = _tlv(0x30, _tlv(0x30, _tlv(6, bytes.fromhex("2a864886f70d01050d")) + _tlv(0x30, b"")) + _tlv(4, bytes(48)))
FOUND = [
    ("pem", _pem("RSA PRIVATE KEY", _rsa())), ("pem", _pem("PRIVATE KEY", ED, end="\\n")), ("pem", _pem("OPENSSH PRIVATE KEY", _openssh(), end="\r\n")), ("pem", _pem("ENCRYPTED PRIVATE KEY", SEALED)),
    ("pem", _pem("RSA PRIVATE KEY", bytes(64), head="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00")), ("pem", _pem("PRIVATE KEY", _pkcs8("2a864886f70d010101", _rsa()))),
    ("key", B64(_rsa())), ("key", _rsa().hex().upper()), ("key", _url(SEC1)), ("key", B64(_openssh())), ("key", B64(ED)), ("key", B64(_pkcs8("2a8648ce3d0201", SEC1))),
    ("key", "\n".join(re.findall(".{1,76}", B64(_rsa())))), ("jwt", _jwt()), ("jwt", _jwt("RS256", 256)), ("jwt", _jwt("ES512", 132)),
    ("coded", B64(b"the password = hunter2hunter2 is in here")), ("coded", B64(B64(_rsa()).encode())), ("coded", (b"AKIA" + b"A" * 16).hex().upper()), ("coded", B64(_pem("PRIVATE KEY", ED).encode())),
]
CLEAR = [
    _pem("RSA PRIVATE KEY", _rsa(wrong=2)), _pem("PUBLIC KEY", _tlv(0x30, _tlv(0x30, _tlv(6, bytes.fromhex("2a864886f70d010101"))) + _tlv(3, b"\0" + bytes(70)))), _pem("RSA PRIVATE KEY", _rsa()[:-1]), "-----BEGIN PRIVATE KEY----- nothing", B64(_rsa() + b"\0"), B64(_rsa(wrong=2)), _jwt("HS256", 31), _jwt("none", 0),
    _jwt("XX", 32), f"{_url([1])}.{_url({})}.{_url(bytes(32))}", B64(b"just a sentence of words, nothing to hide"), "x" * 70_000, "A" * 5000, "word " * 3000, B64(bytes(100)), _pkcs8("2b6570", _tlv(4, bytes(31))).hex().upper(),
]


@pytest.mark.parametrize("kind, secret", FOUND)
def test_structure_confirms(kind, secret):
    for before, after in (("", ""), ("größe 😀 is ", " and more"), ("(", ")\n")):
        text = before + secret + after
        assert [(a, secret_scan.KINDS[k], b) for a, k, b in secret_scan.confirmed_spans(text)] == [(len(before), kind, len(before) + len(secret))]


@pytest.mark.parametrize("text", CLEAR)
def test_structure_refutes(text):
    assert secret_scan.confirmed_spans(f"see {text} here") == []


def _plain(t):
    """Every maximal match from the left, then those too short are dropped."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24])


def test_secret_query(spark):
    rng = random.Random(3)
    bits = ["password", "Token", "ſecret", "API_KEY", "apiKey", "=", ":", " ", "'", '"', "AKIA", "AB12", "deadbeef", "0123456789", "x", "é", "😀", ".", "\n", "g", "-", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)] + [None, "", "token" + " " * 50_000 + "=abcdef", "a" * 30_000, "AKIA" * 9, "token=token=abcdefg", "secret=token:abcdefgh"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "token=abcdef", "en"), (5, "token=abcdef", None), (5, "token=abcdef", None)] + [(900 + i, f"see {s} there", "en") for i, (_, s) in enumerate(FOUND)]
    want = Counter()
    for i, t, _ in rows:
        base = _plain(t)
        name = lambda x: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in x)
        every = sorted(base + secret_scan.confirmed_spans(t or ""))
        want[i, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(every)] += 1
    docs = _table(spark, rows)
    got = secret_scan.report(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()) == want
    assert got.agg({"n_pem": "sum"}).first()[0] == sum(k == "pem" for k, _ in FOUND)
    assert secret_scan.report(docs.where("false")).count() == 0
    clear = secret_scan.redact(docs)
    assert clear.columns == docs.columns
    assert {r.text for r in clear.where("doc_id >= 900").collect()} >= {"see [pem] there", "see [jwt] there", "see [coded] there"}
    assert {r.text for r in clear.where("doc_id = 5 and lang is null").collect()} == {"[assign]"}


# --- filters


def test_filter_audit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([0, 5, 99, 100, 150])
        pool = [f"w{k}" for k in range(rng.choice([20, 60, 400]))] + (["LOUD", "VERY"] if rng.random() < 0.3 else []) + (["a#b"] if rng.random() < 0.1 else [])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(n)), rng.choice(["en", "de", None, ""])))
    rows += [(400 + i, "same again", ["en", "fr"][i % 2]) for i in range(50)] + [(7, rows[7][1], rows[7][2])] * 2 + [(None, "same again", "en"), (None, "alone", None), (500, None, None), (501, "", "en"), (502, "X" * 70_000, "en")]
    rng.shuffle(rows)
    marks = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 450, 2)] + [(0, 1, 0), (0, None, None), (None, 1, 1), (77777, 1, 1)]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, g in rows:
        t, w = t or "", _words(t)
        fails = {x for x, f in {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > least[t]}.items() if f}
        mine = [m for m in marks if i is not None and m[0] == i]
        docs.append((g or "", fails, any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    want, total = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                redundant = sum(d[0] == part and x in d[1] for d in docs) - len(gone)
                want[part, order, step] = [len(left), len(gone), redundant, sum(d[0] == part and d[1] == {x} for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, x] += len(gone)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    table = _table(spark, rows)
    got = filter_audit.report(table, labels).collect()
    assert len(got) == len(want) == 600 * len({d[0] for d in docs})
    for r in got:
        assert list(r)[3:9] == want[r.part, r.filter_order, r.step] and r.shapley == total[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.report(table.where("false"), labels).count() == 0
    assert filter_audit.report(table, labels.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


# --- runs


def _runs(c):
    n, out = len(c), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if c[i] != c[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and c[j] == c[j + q]:
                j += 1
            s = c[i : j + q]
            if len(s) >= max(24, 3 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.add((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic(rng, n):
    c = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a, p = rng.randrange(n), rng.randint(1, rng.choice([4, 20, 60]))
        for i in range(a + p, min(n, a + p * rng.randint(2, 7) + rng.randrange(p))):
            c[i] = c[i - p]
    return c


def test_runs_equal_a_plain_search():
    rng, total = random.Random(11), 0
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for c in [fibonacci[-1][:300], [0] * 100, ([0] * 30 + [1]) * 6, [0] * 23, [0] * 24, list(range(8)) * 3, list(range(9)) * 3, (list(range(9)) * 3)[:26], *(_periodic(rng, rng.randint(1, 260)) for _ in range(600))]:
        got = word_runs.find_runs(np.array(c))
        assert got == _runs(c)
        total += len(got)
    assert total > 200


def test_runs_when_hashes_clash(monkeypatch):
    monkeypatch.setattr(word_runs._Hashes, "same", lambda self, i, d, k: np.ones(len(i), bool))  # any two stretches
    rng = random.Random(12)
    for _ in range(60):
        c = _periodic(rng, rng.randint(24, 200))
        assert word_runs.find_runs(np.array(c)) == _runs(c)


def test_runs_of_long_texts():
    rng = np.random.default_rng(1)
    assert word_runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert word_runs.find_runs(np.concatenate([[-1], np.tile(rng.integers(0, 500, 30_000), 4), [-2]])) == [(1, 120_000, 30_000)]
    assert word_runs.find_runs(rng.integers(0, 300, 200_000)) == []


def test_word_runs_query(spark):
    rng = random.Random(13)
    texts = [rng.choice([" ", "\n", "\t "]).join(f"w{x}" for x in _periodic(rng, rng.randint(1, 150))) for _ in range(150)] + [None, "", " \n", "a " * 24, "a " * 23, "one\x1ctwo three " * 30]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "b " * 40, "en"), (1, "b " * 40, None), (1, "b " * 40, None)]
    want = Counter()
    for i, t, _ in rows:
        w = _words(t)
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = _runs(w)
        dropped = {k for a, m, q in runs for k in range(a + q, a + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest()] += 1
    docs = _table(spark, rows)
    assert Counter(tuple(r) for r in word_runs.report(docs).collect()) == want
    assert word_runs.report(docs.where("false")).count() == 0
    out = word_runs.collapse(docs)
    assert out.columns == [*docs.columns, "_runs", "_collapsed"]
