import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkveil.llm import secrets as S
from inkveil.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def chi_tail(x, d):
    return tail(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def p_value(core, alphabet):
    xs, k, n = [alphabet.index(c) for c in core], len(alphabet), len(core)
    mean, spread = k - 1, 2 * (k - 1) * (n - 1) / n
    free = 2 * mean * mean / spread
    least = chi_tail((k / n * sum(v * v for v in Counter(xs).values()) - n) * free / mean, free)

    def kind(c):
        return "l" if c in string.ascii_lowercase else "u" if c in string.ascii_uppercase else "r"

    due = Counter(map(kind, alphabet))
    seen = Counter(map(kind, core))
    least = min(least, chi_tail(sum((seen[c] - n * s / k) ** 2 / (n * s / k) for c, s in due.items()), len(due) - 1))
    changes = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(xs, xs[1:]))
    least = min(least, 2 * tail(abs(changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)))
    mid = (k - 1) / 2
    serial = sum((a - mid) * (b - mid) for a, b in zip(xs, xs[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    return 1 - (1 - min(1, least, 2 * tail(abs(serial)))) ** 4


def plain(texts):
    """Spans of each text, thresholds over all."""
    found = []
    for text in texts:
        known, own = base(text or ""), []
        for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            core = m[0].rstrip("=")
            number = next((i for i, a in enumerate(S.ENCODINGS.values()) if set(core) <= set(a)), None)
            if core.isdigit() or number is None or any(a < m.end() and e > m.start() for a, _, e in known):
                continue
            p = p_value(core, list(S.ENCODINGS.values())[number])
            own.append((m.start(), m.end(), (number, int(math.log2(len(core)))), min(99, int(p * 100)), m[0]))
        found.append((known, own))
    strata = defaultdict(dict)
    for _, own in found:
        for _, _, stratum, bin_, token in own:
            strata[stratum][token] = bin_
    least = {}
    for stratum, tokens in strata.items():
        random_ = sum(b >= 50 for b in tokens.values()) * 2
        for t in range(1, 100):
            called = sum(b >= t for b in tokens.values())
            if called and t in tokens.values() and called - random_ * (1 - t / 100) <= called * S.FALSE_SHARE:
                least[stratum] = t
                break
    return [sorted(known + [(a, 3, e) for a, e, s, b, _ in own if b >= least.get(s, 100)]) for known, own in found]


def corpus():
    draw = random.Random(7)

    def drawn(alphabet, n):
        return "".join(draw.choice(alphabet) for _ in range(n))

    words = ["".join(draw.choice(["ver", "ein", "lich", "keit", "tion", "ment", "aux", "the"]) for _ in range(draw.randint(1, 9))) for _ in range(400)]
    secret = [drawn(a, draw.choice([24, 28, 40, 44, 64])) for a in list(S.ENCODINGS.values()) * 12]
    texts = [" ".join(draw.choice(words) for _ in range(80)) + f" x={s}== " + draw.choice(words) for s in secret]
    texts += [
        None, "", " ", "password=abc", 'Password" : "hunter2hunter2"', "API_KEY=" + drawn(string.ascii_letters, 30), "apikey='12345678'",
        "token: secret=abcdefgh", "token = ab secret = abcdefghij", "paſſword=abcdefghij", "Key toKen=abcdefgh", "AKIA1234567890AB", "AKIAAKIA1234567",
        "éé AKIA" + "Z" * 20 + " 😀 " + "0123456789abcdef" * 2 + "g", "f" * 31, "a" * 33 + "A" * 33, "0" * 40, "secret:=x", "token:" + "=" * 9,
        "password=deadbeefdeadbeefdeadbeefdeadbeef", "https://example.org/some/long/path/of/words/and/more", "ThisIsAnIdentifierOfManyWords",
        "abcdefghijklmnopqrstuvwxyz0123456789", "x" * 50_000, drawn(string.ascii_letters + string.digits, 5000), ("token=" + "ab12cd34 ") * 2000,
        (drawn("0123456789abcdef", 32) + " ") * 700, "aaaaaaaaaabbbbbbbbbb", "-" * 30, "_" * 25 + "=",
    ]
    return texts + texts[:9]


def test_spans_against_plain(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0, []) for i, t in enumerate(texts)], "doc_id long, text string, least int, spans array<int>").repartition(4)
    made = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.find_secrets(docs).collect()}
    want = plain(texts)
    assert made == dict(enumerate(want))
    assert sum(kind == 3 for spans in want for _, kind, _ in spans) > 50  # most of the drawn strings are called
    assert all(len(texts[i][a:e]) >= S.MIN_LENGTH and not re.search("keit|tion", texts[i][a:e]) for i, spans in enumerate(want) for a, k, e in spans if k == 3)


def test_query(spark, tmp_path):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "token=12345678"), (None, "token=12345678")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for (doc_id, text), spans in zip(rows, plain([t for _, t in rows])):
        own = base(text or "")
        spelt = [",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in some) for some in (own, spans)]
        want.append((doc_id, *(sum(k == n for _, k, _ in own) for n in range(3)), hashlib.sha256(spelt[0].encode()).hexdigest(), spelt[1]))
    made = QUERIES["op13_secret_scan"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in made)


def test_native_and_empty(spark):
    found = S.found_in(spark.createDataFrame([], "doc_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "Exchange" not in plan
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.find_secrets(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.size("spans")).first()[0] == 0
