"""The battery and the step-up procedure of the secret scan against plain Python, its power, and long texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traceframe.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": LETTERS, "base64": LETTERS + "+/"}
WORDS = "user name get set value version config index server client list map file path image upload content data type build number date time format string parser module windows default width height session request response header body message queue worker thread memory buffer cache size count total result error service manager".split()


def _identifier(rng):
    words = rng.choices(WORDS, k=rng.randint(4, 8))
    if rng.random() < 0.4:
        words.insert(rng.randint(0, len(words)), str(rng.randint(0, 2030)))
    return rng.choice(["_".join(words), "-".join(words), "/".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "".join(words)])


def _p_value(token):
    """The same from the definition: effects, folded normal densities, the background's tail."""
    name, alphabet = next((n, a) for n, p, a in secrets.ENCODINGS if re.match(p, token))
    if name in ("hex", "base36"):
        token = token.lower()
    n, k, par = len(token), len(alphabet), secrets.BACKGROUND[name]
    expected = n / k
    chi = sum((Counter(token)[c] - expected) ** 2 / expected for c in alphabet)
    v = [alphabet.index(c) for c in token]
    often = [c in secrets.FREQUENT[name] for c in token]
    changes = sum(x != y for x, y in zip(often, often[1:], strict=False)) / (n - 1)
    mean = sum(v) / n
    square = sum((x - mean) ** 2 for x in v)
    serial = abs(sum((x - mean) * (y - mean) for x, y in zip(v, v[1:], strict=False)) / square + 1 / n) if square else 1.0
    found = [abs(chi - (k - 1)) / n, abs(changes - 0.5), serial]
    chance = [math.sqrt(2 * (k - 1) * (n - 1) / n) / n, math.sqrt(0.25 / (n - 1)), math.sqrt(1 / n)]
    spread = [math.sqrt((2 * (k - 1) + 4 * n * par[0]) / n**2 + par[1] ** 2), math.hypot(chance[1], par[3]), math.hypot(chance[2], par[5])]
    normal = lambda x, m, s: math.exp(-(((x - m) / s) ** 2) / 2) / s
    total = 0.0
    for x, s, m, b in zip(found, chance, par[:6:2], spread, strict=True):
        total += math.log(max(2 * normal(x, 0, s), 1e-300)) - math.log(normal(x, m, b) + normal(-x, m, b))
    return min(1.0, par[6] * math.exp(-max(total, -50.0)))


def test_p_values_against_the_definition(spark, docs):
    rng = random.Random(8)
    tokens = ["".join(rng.choices(a, k=rng.randint(20, 70))) for a in ALPHABETS.values() for _ in range(25)] + [_identifier(rng) for _ in range(100)] + ["A" * 30, "AB" * 15]
    tokens = [t for t in tokens if len(t) >= 20 and not re.search(f"{secrets.HEX}|{secrets.ACCESS}", t)]
    got = {r.doc_id: r.tested for r in secrets.candidates(docs(list(enumerate(tokens)))).select("doc_id", "tested").collect()}
    for i, t in enumerate(tokens):
        assert len(got[i]) == 1 and (got[i][0].start, got[i][0].end) == (0, len(t)), t
        assert got[i][0].p == pytest.approx(_p_value(t), rel=1e-6, abs=1e-200), t


def test_step_up_against_sorting(spark):
    rng = random.Random(2)
    for share in (0.0, 0.05, 0.5):
        tokens = [(rng.randint(20, 60), rng.random() * (1e-6 if rng.random() < share else 1.0)) for _ in range(400)]
        df = spark.createDataFrame([([t],) for t in tokens] + [([],)], "tested array<struct<n:int,p:double>>")
        mean, cut = secrets.threshold(df)
        assert mean == pytest.approx(sum(n for n, _ in tokens) / len(tokens))
        weighed = sorted(p * mean / n for n, p in tokens)
        accepted = max((k for k, p in enumerate(weighed, 1) if p <= secrets.FDR * k / len(weighed)), default=0)
        mine = sum(p <= cut for p in weighed)
        assert mine <= accepted and mine >= accepted - 3  # bins round to the safe side
    assert secrets.threshold(spark.createDataFrame([([],)], "tested array<struct<n:int,p:double>>")) == (1.0, -1.0)


def test_power_and_false_positives(docs):
    rng = random.Random(11)
    rows, kind = [], {}
    for name, alphabet in ALPHABETS.items():
        for i in range(150):
            kind[len(rows)] = name
            rows.append((len(rows), f"see {''.join(rng.choices(alphabet, k=32))} end"))
    for i in range(600):
        kind[len(rows)] = "identifier"
        rows.append((len(rows), f"see {_identifier(rng)} end"))
    kind[len(rows)] = "uuid"
    rows.append((len(rows), "id 3f2b8c1e-9d47-4a6b-8e15-7c0d9f3a2b64 end"))
    rows.append((len(rows), "ABCDEFGHIJKLMNOPQRSTUVWXYZ and AAAAAAAAAAAAAAAAAAAAAAAAAAAA and 1234567890abcdefghijklmnopqrstuvwxyz"))
    kind[len(rows) - 1] = "ordered"
    found = secrets.scan(docs(rows)).filter(F.exists("spans", lambda s: s["kind"] == 3)).select("doc_id").collect()
    share = {k: n / Counter(kind.values())[k] for k, n in Counter(kind[r.doc_id] for r in found).items()}
    assert all(share[name] >= 0.85 for name in ALPHABETS) and sum(share[name] for name in ALPHABETS) / 4 >= 0.9
    assert share.get("identifier", 0) <= 0.03 and "uuid" not in share and "ordered" not in share


def test_tokens_beside_assignments(docs):
    rng = random.Random(3)
    token = lambda: "".join(rng.choices(LETTERS, k=48))
    one, two = token(), token()
    rows = [
        (1, f"secret={one}.{two}"), (2, f"my_very_long_name_of_a_secret: {one} {two}"), (3, f"token {one}"), (4, f"password=short {one}"),
        (5, f"é {one}\n{two}"), *[(10 + i, f"see {token()} end") for i in range(20)],
    ]
    got = {r.doc_id: r.s for r in secrets.scan(docs(rows)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got[1] == f"assign:0:{len(rows[0][1])}"
    at = rows[1][1].index("secret")
    assert got[2] == f"assign:{at}:{at + 8 + 48},random:{at + 57}:{at + 105}"
    assert got[3] == "random:6:54" and got[4] == "random:15:63" and got[5] == "random:2:50,random:51:99"


def test_many_matches_in_one_text(docs):
    rows = [(1, " ".join(f"{i:016x}" for i in range(20_000))), (2, " ".join(f"secret=abcdefgh{i:06d}" for i in range(20_000)))]
    got = {r.doc_id: r.spans for r in secrets.scan(docs(rows)).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(17 * i, 17 * i + 16) for i in range(20_000)]
    assert [(s.start, s.end) for s in got[2]] == [(22 * i, 22 * i + 21) for i in range(20_000)]
