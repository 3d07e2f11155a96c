import random
import re
import zlib
from collections import Counter

import pytest

from curatrix.llm.spelling import near_pairs, op13_spelling, roots, spelling_variants

S = "doc_id long, text string, word string, n int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_counts(rows, thinned, length=6, least=5):
    total = Counter()
    for i, t in rows:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if thinned and h % thinned == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= least}


def apart(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute(counts, ratio=5):
    """Candidates are words that share a form without one character, or are one: no near word is missed."""
    words, less = sorted(counts), {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            less.setdefault(v, []).append(w)
    near = {w: {o for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for o in less[v] if apart(w, o)} for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in words)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("members", [1, 4, 1000])
def test_pairs_equal_all_pairs(spark, members):
    r = random.Random(members)
    letters = "abcàé"
    words = {"".join(r.choice(letters) for _ in range(r.choice([6, 7, 8]))) for _ in range(500)}
    for w in sorted(words)[:250]:  # chains of changes, repeated letters
        p = r.randrange(len(w))
        words |= {w[:p] + r.choice(letters) + w[p:], w[:p] + w[p + 1 :] if len(w) > 6 else w, w[:p] + r.choice(letters) + w[p + 1 :]}
    words |= {"a" * k for k in range(6, 12)} | {"ab" * k for k in range(3, 6)} | {"a" * 5 + c for c in letters}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = [(x.a_word, x.b_word) for x in near_pairs(df, members).collect()]
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("thinned", [None, 3])
def test_cases(spark, thinned):
    r = random.Random(5)
    vocabulary = ["receive", "recieve", "receiver", "Größe", "größen", "Grössen", "ÉCOLES", "écoles", "naïvely", "naively", "abcdef", "abcdeg", "abcdeh", "short", "x×y÷zzz"]
    weights = [300, 20, 60, 40, 60, 9, 30, 30, 100, 12, 40, 40, 8, 50, 9]
    rows = [(i, r.choice([" ", ", ", "-", "1"]).join(r.choices(vocabulary, weights, k=r.randrange(40)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " .. "), (None, "receive abcdef " * 6), (3, "receiver " * 7), (3, "receiver " * 7), (73, "longest" * 9000), (74, "ſecret ſecret 漢字漢字漢字 " * 6)]
    got = rows_of(spelling_variants(spark.createDataFrame([(i, t, "w", 1) for i, t in rows], S).repartition(3), thinned=thinned))
    assert got == brute(brute_counts(rows, thinned))
    assert any(g[1] for g in got)
    assert spelling_variants(spark.createDataFrame([], S)).count() == 0


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 11 else None) for i in range(12)] + [(f"x{i}", "w3") for i in range(50)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w11" for w, f in chain if f}
    assert roots(spark.createDataFrame([("a", None)], "word string, form string")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(op13_spelling(spark, sf)) == brute(brute_counts(docs, 199))
