import random
import re

import pytest
import xxhash

from curatrix.llm import simhash
from curatrix.llm.simhash import fingerprint, links, masks, op11_simhash, simhash_components

S = "doc_id long, text string, fp string, component int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_print(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """prints: {key: (id, fingerprint)} -> {key: smallest identifier reachable}."""
    fps = sorted({f for _, f in prints.values()})
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                comp[root(a)] = root(b)
    best = {}
    for i, f in prints.values():
        if i is not None:
            best[root(f)] = min(best.get(root(f), i), i)
    return {k: best.get(root(f)) for k, (i, f) in prints.items()}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    r, ms = random.Random(radius), masks(radius)
    assert len(ms) == 2 ** (radius + 1) - 1
    for _ in range(20_000):
        apart = sum(1 << b for b in r.sample(range(64), radius))
        assert any(apart & m == 0 for m in ms)


def test_fingerprint_in_chunks(monkeypatch):
    r = random.Random(4)
    texts = ["", " \t", "One", "two  Words", "É é É é", "a\x0bb\x0cc\nd", "x" * 300, " ".join(r.choice(["ab", "C", "dé", "z" * 40]) for _ in range(900)), "  lead " + "\n".join(map(str, range(300))) + "  "]
    for chunk in (1, 7, 64, 4 << 20):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        for n in (1, 3, 5):
            assert [fingerprint(lower(t).encode(), n) % 2**64 for t in texts] == [brute_print(t, n) for t in texts]


@pytest.mark.parametrize("radius", [1, 2])
def test_links_equal_all_pairs(spark, radius):
    r = random.Random(radius)
    fps = {0, -1, 1 << 63, 3}
    for _ in range(12):
        seed = r.getrandbits(64)
        for _ in range(60):  # families around a seed, chains and near misses
            fps.add(seed)
            seed ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3, 4])))
    hub = r.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    signed = {f % 2**64 for f in fps}
    prints = {f: (f, f) for f in signed}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in signed], "fp long")
    comp = {f: f for f in signed}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for e in links(df, radius).collect():
        assert ((e.a ^ e.b) % 2**64).bit_count() <= 2
        comp[root(e.a % 2**64)] = root(e.b % 2**64)
    got, want = {}, {}
    for f, w in brute_components(prints, radius).items():
        want.setdefault(w, set()).add(f)
        got.setdefault(root(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_cases(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(50)}" for _ in range(r.choice([1, 2, 3, 30, 200]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i, " ".join(w).replace("w1", r.choice(["w1", "W1"]))))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (None, "ONE"), (None, "all alone"), (304, "z " * 30_000), (5, "shares an identifier"), (5, "shares an identifier"), (306, "é É ß 漢字")]
    out = simhash_components(spark.createDataFrame([(i, t, "n", 1) for i, t in rows], S).repartition(3)).collect()
    prints = {k: (i, brute_print(t)) for k, (i, t) in enumerate(rows)}
    comps = brute_components(prints, 2)
    want = sorted(((i, f"{f:016x}", comps[k]) for k, (i, f) in prints.items()), key=repr)
    assert sorted((tuple(x) for x in out), key=repr) == want
    assert simhash_components(spark.createDataFrame([], S)).count() == 0
    zero = simhash_components(spark.createDataFrame([(i, t, "n", 1) for i, t in rows], S), radius=0).collect()
    first = {}
    for i, f in prints.values():
        if i is not None:
            first[f] = min(first.get(f, i), i)
    assert sorted(((x.doc_id, x.component_id) for x in zero), key=repr) == sorted(((i, first.get(f)) for i, f in prints.values()), key=repr)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {d.doc_id: (d.doc_id, brute_print(d.text)) for d in docs}
    comps = brute_components(prints, 2)
    assert sorted(map(tuple, op11_simhash(spark, sf).collect())) == sorted((k, f"{f:016x}", comps[k]) for k, (_, f) in prints.items())
