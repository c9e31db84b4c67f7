"""The randomness battery and its false-discovery control against plain statements of both."""

import base64
import math
import random
import re
import string

from pyspark.sql import functions as F

from fleetrisk.llm import secrets

SYLLABLES = ["tion", "ing", "the", "er", "and", "re", "on", "at", "es", "or", "st", "en"]


def ordinary(rng):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(3, 9))) for _ in range(rng.choice([1, 1, 2, 3]))]
    return rng.choice("-_/").join(words)


def statistic(token):
    """Three z-scores squared and added, over the alphabet that the token's characters suggest."""
    for pattern, alphabet in secrets.ENCODINGS.items():
        if re.search(pattern, token):
            break
    else:
        token, alphabet = token.translate(str.maketrans("_-", "/+")), secrets.BASE64
    k, n = len(alphabet), len(token)
    chi = sum(token.count(a) ** 2 for a in alphabet) * k / n - n
    z = [max(0.0, ((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5)]
    halves = [alphabet.index(c) >= k // 2 for c in token]
    z.append((sum(a != b for a, b in zip(halves, halves[1:])) - (n - 1) / 2) / ((n - 1) / 4) ** 0.5)
    values = [alphabet.index(c) + 1 - (k + 1) / 2 for c in token]
    z.append(sum(a * b for a, b in zip(values, values[1:])) / ((k * k - 1) / 12) / (n - 1) ** 0.5)
    x = ((sum(v * v for v in z) / 3) ** (1 / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5
    return 1 / (1 + math.exp(min(600.0, 1.5976 * x + 0.070565992 * x**3)))


def test_battery(spark):
    rng = random.Random(1)
    pools = [string.ascii_letters + string.digits + "+/_-", string.digits + "abcdef", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase]
    tokens = ["".join(rng.choice(p) for _ in range(rng.randrange(20, 90))) for p in pools for _ in range(40)] + [ordinary(rng) for _ in range(60)] + ["a" * 30, "0f" * 15]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.p_value(F.col("t"))).collect()
    for t, p in got:
        assert math.isclose(p, statistic(t), rel_tol=1e-6, abs_tol=1e-12), t


def test_discoveries(spark):
    rng = random.Random(2)
    rows = [(rng.choice([8, 9, 10, 12]), rng.choice([rng.randrange(25, secrets.STEPS + 1)] * 30 + [rng.randrange(40)]), True) for _ in range(900)]
    rows += [(rng.choice([8, 9, 10, 12]), rng.randrange(0, 30), False) for _ in range(120)] + [(9, 399, False), (11, 0, False)]
    for fdr in (0.01, 0.05, 0.3):
        want = {}
        for s in {r[0] for r in rows}:
            null = [step for t, step, o in rows if o and t <= s]
            tested = sorted(step for t, step, o in rows if not o and t == s)
            for rank, step in enumerate(tested, 1):
                rank = sum(x <= step for x in tested)
                p = (sum(x <= step for x in null) + 1) / (len(null) + 1)
                if p <= fdr * rank / len(tested):
                    want[s] = max(want.get(s, 0), step)
        got = secrets.discoveries(spark.createDataFrame(rows, "stratum int, step int, ordinary boolean"), fdr).collect()
        assert {r.stratum: r.cut for r in got} == want and want


def test_planted_strings_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    planted, docs = {}, []
    for i in range(1500):
        text = " ".join(ordinary(rng) for _ in range(6))
        if i % 25 == 0:
            raw = bytes(rng.randrange(256) for _ in range(rng.choice([24, 32, 48])))
            token = rng.choice([base64.b64encode(raw).decode().rstrip("="), base64.b32encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("=")])
            planted[i] = (len(text) + 1, len(text) + 1 + len(token))
            text = f"{text} {token} {ordinary(rng)}"
        docs.append((i, text))
    docs += [(9000, "f" * 3 + "04dbebab91ab85687d33eeaaf9ac699e1188f962"), (9001, None), (9002, "")]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {i for i, r in got.items() if r.n_random}
    hit = {i for i, (a, b) in planted.items() if f"random:{a}:{b}" in got[i].spans.split(",")}
    assert len(hit) >= 0.95 * len(planted)
    assert len(found - set(planted)) <= 0.05 * len(found) + 1
    assert got[9000].n_hex == 1 and got[9000].n_random == 0


def test_no_ordinary_tokens_no_discoveries(spark):
    docs = [(i, base64.b64encode(random.Random(i).randbytes(30)).decode().rstrip("=")) for i in range(30)]
    assert sum(r.n_random for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == 0
