"""Secret scans of long candidates, many spans, and odd tables, against plain Python."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemill.llm import secretscan

from test_operators import entropy_span


def spans_of(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    allow = re.compile("|".join(f"(?:{p})" for p in secretscan.ALLOW).replace("(?i)", ""), re.I)
    out = list(base)
    for m in re.finditer(secretscan.CANDIDATE, text):
        held = any(a <= m.start() and b >= m.end() for a, _, b in base)
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not held and not allow.search(text[max(0, m.start() - 24) : m.end()]) and (s := entropy_span(m[0])):
            out.append((m.start() + s[0], 3, m.start() + s[1]))
    return base, out


def blanked(text, spans):
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def joined(spans):
    return ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_long_candidates_and_many_spans(spark):
    rng = random.Random(7)
    token = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    low, high = "aab0", secretscan.SYMBOLS
    rows = [
        (1, token(100_000, high)),
        (2, "x " + token(3_000, low) + token(500, high) + token(3_000, low) + " y"),
        (3, " ".join(f"{rng.choice(['token=', 'é', 'commit ', '', 'key-'])}{token(rng.randint(5, 40), rng.choice([low, high, '0123456789abcdef']))}" for _ in range(3_000))),
        (4, "é" * 30 + " ".join(f"secret={token(9, 'abc1')}" for _ in range(4_000))),
        (4, "\U0001f600AKIA" + "Q" * 12 + "token=" + "ab12" * 10),
        (None, "password: hunter2hunter2"),
        (5, None),
        (6, ""),
    ]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, base int")
    got = Counter((r.doc_id, r.base_sha256, r.spans, r.n_assign, r.n_access, r.n_hex) for r in secretscan.digest(df).collect())
    want = Counter()
    for i, t in rows:
        base, spans = spans_of(t or "")
        want[i, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), *(sum(k == x for _, k, _ in base) for x in range(3))] += 1
    assert got == want
    clean = secretscan.redact(df)
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t and blanked(t, spans_of(t)[1])) for i, t in rows)
    assert secretscan.redact(df.limit(0)).count() == 0 and secretscan.digest(df.limit(0)).count() == 0


def test_window_entropy_is_the_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(rng.choice(["0123456789abcdef", "aB1", secretscan.SYMBOLS])) for _ in range(rng.randint(20, 90)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", secretscan.entropy_range(F.col("text")).alias("r"))
    for r in df.collect():
        want = entropy_span(r.text)
        assert (r.r.first, r.r.last) == (want or (-1, -1)), r.text
