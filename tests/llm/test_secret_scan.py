import hashlib
import math
import random
import re
import string
from collections import defaultdict

from lodestone.llm import queries
from lodestone.llm import secret_scan as ss

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16])


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def judged(token):
    """(encoding, class, level, passes), straight from the definitions."""
    name, _, alphabet, like = next(e for e in ss.ENCODINGS if re.search(e[1], token))
    own = token.lower() if name in ("hex", "base36") else token.replace("-", "+").replace("_", "/")
    v = [alphabet.index(c) + 1 for c in own]
    n, k = len(v), len(alphabet)
    squares = sum(v.count(x) ** 2 for x in set(v))
    p_chi = tail((k / n * squares - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [x > k // 2 for x in v]
    runs, n1 = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    both = 2 * n1 * (n - n1)
    p_runs = 2 * tail(abs(runs - both / n - 1) / math.sqrt(both * (both - n) / (n * n * (n - 1)))) if both > n else 0.0
    mean = sum(v) / n
    about = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    p_serial = 2 * tail(abs(serial / about + 1 / n) * math.sqrt(n)) if about > 1e-9 else 0.0
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    changes = sum(kind(a) != kind(b) for a, b in zip(token, token[1:]))
    pairs = (squares - n) / 2
    wide = n * (n - 1) / 2 * (like.pairs - like.pairs**2) + n * (n - 1) * (n - 2) * (like.threes - like.pairs**2)
    p_pairs = tail((n * (n - 1) / 2 * like.pairs - pairs) / math.sqrt(wide))
    p_changes = tail((changes - 0.5 - (n - 1) * like.changes) / math.sqrt((n - 1) * like.changes * (1 - like.changes)))
    log = min(-math.log(max(p_pairs, 1e-150)) - math.log(max(p_changes, 1e-150)), 600)
    return name, min(int(math.log2(n / 20)), 20), (log - math.log(1 + log)) / math.log(2) * 4, min(p_chi, p_runs, p_serial)


def expected(docs):
    tokens = {t: judged(t) for _, text in docs for t in CANDIDATE.findall(text or "")}
    strata = defaultdict(list)
    for name, size, level, _ in tokens.values():
        strata[name, size].append(min(int(level), ss.LAST))
    lowest = {s: min((j for j in a if len(a) * 2 ** (-j / 4) <= ss.RATE * sum(x >= j for x in a)), default=None) for s, a in strata.items()}
    out = []
    for d, text in docs:
        text = text or ""
        own = base(text)
        extra = []
        for m in CANDIDATE.finditer(text):
            name, size, level, p = tokens[m[0]]
            if lowest[name, size] is not None and min(int(level), ss.LAST) >= lowest[name, size] and p >= ss.BATTERY and not any(s <= m.start() and e >= m.end() for s, _, e in own):
                extra.append((m.start(), 3, m.end()))
        said = lambda a: ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in a)
        out.append((d, *[sum(k == j for _, k, _ in own) for j in range(3)], hashlib.sha256(said(own).encode()).hexdigest(), said(sorted(own + extra))))
    return sorted(out, key=str)


def rows(result):
    return sorted((tuple(r) for r in result.collect()), key=str)


def made(seed=4):
    """Texts with planted tokens; and the tokens that are random and in no pattern."""
    r = random.Random(seed)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "tion", "th", "le", "on", "ou", "ing", "des", "re"]) for _ in range(r.randint(1, 4)))
    docs, planted = [], set()
    for d in range(120):
        words = [word() for _ in range(40)]
        words[3] = "é𝄞" * (d % 3)
        token = draw(string.ascii_letters + string.digits + "+/", r.randint(40, 90)) if d % 3 else draw(string.ascii_uppercase + "234567", 56)
        if d % 2:
            words[7] = token
            planted.add(token)
        words[11] = ["token = \"" + draw("0123456789abcdef", 40) + '"', "API-key:x apikey='" + draw(string.ascii_letters, 14), "AKIA" + draw(string.ascii_uppercase + string.digits, 10 + d % 8), draw("0123456789abcdef", 10 + d % 30), "PassWord:" + draw("ab.", 5) + " secret=token=" + draw("abc", 9), "passwd=secret=short"][d % 6]
        words[20] = "".join(word() for _ in range(8))
        words[30] = ["/usr/local/share/documents/tion", "2024010112000000000000", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "some_name_of_a_variable_here"][d % 4]
        docs.append((d, " ".join(words)))
    return docs, planted


def test_against_brute_force(spark):
    docs, planted = made()
    docs += [(500, None), (501, ""), (None, docs[1][1]), (1, docs[1][1]), (1, docs[1][1]), (502, "token=" + "x" * 12), (503, "toKen=" + "x" * 11), (504, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop")]
    found = ss.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = rows(ss.digests(found))
    assert got == expected(docs)
    spans = {r["doc_id"]: r["spans"] for r in found.where("doc_id < 200").collect()}
    caught = {t for d, t in docs[:120] for s in spans[d] if s["kind"] == "random" for t in [t[s["start"] : s["end"]]]}
    assert len(caught & planted) > 0.9 * len(planted) and len(caught - planted) <= 0.05 * len(caught)


def test_copies_move_no_level(spark):
    docs, planted = made(9)
    plain = "".join(["der", "und", "schen", "keit", "lich", "ein", "X9"] * 6)
    docs += [(1000 + k, plain) for k in range(4000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(ss.digests(ss.scan(frame))) == expected(docs)


def test_many_matches_in_a_long_text(spark):
    r = random.Random(2)
    text = " é ".join("token:%s" % "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 24))) for _ in range(1500)) + "z" * 100_000
    docs = [(1, text), (2, "ab" * 40_000)]
    got = rows(ss.digests(ss.scan(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert got == expected(docs) and got[0][1] > 900


def test_edges_and_plan(spark, sf):
    docs = spark.createDataFrame([(1, "api_key: abcdefghijkl", 3, "x")], "doc_id long, text string, n_hex int, spans string")
    assert ss.digests(ss.scan(docs)).first()["spans"] == "assign:0:21"
    assert ss.scan(docs.limit(0)).count() == 0
    result = queries.op11_secret_scan(spark, sf)
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(result) == expected(docs)
