import random
import re
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import ngram_join as nj
from lodestone.llm.components import components
from lodestone.llm.hashing import shingles

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """{doc_id: (n_shingles, component_id)}, by counting shared shingles of all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter()
    for who in by.values():
        for i, a in enumerate(who):
            for b in who[:i]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed):
    """Near copies at all similarities around the threshold, of all sizes, and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    texts = ["", None, "  \t ", "Ab c", "ab C", "one", "x y z"]
    for n in (3, 6, 8, 9, 10, 12, 15, 20, 30, 45, 80, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(8):
                near = list(base)
                for _ in range(r.randint(1, max(1, n // 25))):
                    k = r.randrange(len(near))
                    near[k : k + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
                texts.append(" ".join(near).title() if r.random() < 0.3 else " \n".join(near))
            cut = max(1, int(n * r.uniform(0.76, 0.9)))
            texts += [" ".join(base[:cut]), " ".join(base[n - cut :])]
    texts += [" ".join([word() for _ in range(r.randint(5, 30))] + passage + [word() for _ in range(r.randint(0, 30))]) for _ in range(60)]
    return list(enumerate(texts))


def result(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similarity_classes(docs).collect()}


def test_shingles_as_defined():
    for text in ("A b C d e f", "a  b\tc", "", " ", "a b c d e a b c d e a b c d e"):
        assert len(shingles(text.encode())) == len(shingle_set(text))
    assert np.array_equal(shingles(b"THE Cat sat on the mat"), shingles(b"the\ncat sat on  the mat"))


def test_against_all_pairs(spark):
    docs = corpus(1)
    assert result(spark, docs) == brute(docs)


def test_signatures_miss_no_link():
    for seed in range(2, 8):
        docs = [(d, shingles((t or "").encode())) for d, t in corpus(seed)]
        docs = [(d, s) for d, s in docs if len(s)]
        sig, who = nj.signatures([s for _, s in docs])
        have = defaultdict(set)
        for x, i in zip(sig.tolist(), who.tolist()):
            have[i].add(x)
        for i, (_, a) in enumerate(docs):
            for j, (_, b) in enumerate(docs[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    assert have[i] & have[j], (len(a), len(b), both)


def test_chains_and_one_large_group(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    chain = [word() for _ in range(300)]
    docs = [" ".join(chain[k : k + 120]) for k in range(0, 170, 6)]
    base = [word() for _ in range(120)]
    for _ in range(150):
        near = list(base)
        near[r.randrange(120)] = word()
        docs.append(" ".join(near))
    docs = list(enumerate(docs))
    assert result(spark, docs) == brute(docs)


def test_nulls_repeats_empty_and_other_columns(spark):
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (None, "A b c d e f", 2), (7, None, 3), (8, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted(((r[0], r[2], r[3]) for r in nj.similarity_classes(docs).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (7, 0, 7), (8, 0, 8)], key=str)
    assert nj.similarity_classes(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90, 101: 90}


def test_very_long_texts(spark):
    r = random.Random(21)
    words = [str(r.randrange(10**6)) for _ in range(50_000)]
    near, far = list(words), list(words)
    for k in range(0, len(words), 120):
        near[k] = "other"
    for k in range(0, len(words), 9):
        far[k] = "other"
    docs = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(far)), (4, " ".join(words).upper())]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.similarity_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[3][1] == 2 and got[1][1] == 1
