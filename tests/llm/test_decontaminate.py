import random
import re

from curatrix.llm.decontaminate import WINDOW, decontaminate, leaks, op3_decontaminate

ITEM = "A train leaves Boston with 120 people and 7 wagons. After 3 hours in the rain Boston counts 120 people less than Denver did in May."


def brute(docs, items):
    """(doc, item) where at least 0.8 of the item's distinct-place five-token windows occur, on plain lower-case tokens."""
    tok = lambda s: [w for w in (re.sub(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", "", x) for x in re.split(r"[\x20\t\n\x0b\x0c\r]+", s.lower())) if w]
    out = set()
    for d, t in docs:
        w = tok(t or "")
        have = {tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)}
        for i, x in items:
            y = tok(x)
            want = [tuple(y[k : k + WINDOW]) for k in range(len(y) - WINDOW + 1)]
            if want and sum(k in have for k in want) >= 0.8 * len(want):
                out.add((d, i))
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_templates(spark):
    swap = lambda s, m: re.sub("|".join(m), lambda x: m[x[0]], s)
    noise = " ".join(random.Random(1).choice(["the", "of", "rain", "people", "and", "in"]) for _ in range(400))
    docs = [
        (1, noise + " " + ITEM), (2, "So: " + swap(ITEM, {"Boston": "Paris", "120": "555", "Denver": "Rome", "7": "12"})), (3, ITEM.upper()), (4, ITEM.lower().replace(".", "")),
        (5, swap(ITEM, {"with 120": "with 1", "7": "2", "counts 120": "counts 9", "hours": "apples"}).replace("Boston counts", "Vienna counts").replace("rain", "sun")),
        (6, noise), (7, None), (8, ""), (9, "12 14 15 16 17 18 19 " * 50), (10, "x " * 60_000), (None, ITEM), (1, noise + " " + ITEM),
    ]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, share string, item int")
    items = spark.createDataFrame([(0, ITEM), (1, "too short"), (2, None), (None, ITEM), (3, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    for size in (1 << 24, 40):
        got = leaks(df, items, index_bytes=size).filter("item_id = 0").collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    assert {r.doc_id for r in decontaminate(df, items.filter("item_id = 0")).collect()} == {5, 6, 7, 8, 9, 10}
    assert decontaminate(df.limit(0), items).count() == 0 and decontaminate(df, items.limit(0)).count() == len(docs)
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_numbers_alone_need_their_own_values(spark):
    df = spark.createDataFrame([(1, "9 8 7 6 5 4 3 2"), (2, "1 1 1 1 1 1 1 1")], "doc_id long, text string")
    items = spark.createDataFrame([(3, "1 2 1 4 1 6 1 8")], "item_id long, text string")
    assert leaks(df, items).filter("doc_id = 1").count() == 0


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom gives 2 apples to Anna. How many apples does Tom have now?"
    docs = [
        (1, "Bill has 9 apples. Bill gives 4 apples to Mary. How many apples does Bill have now?"), (2, "So Mr. Bill has 9 apples.\nBill gives 4 apples to\nMary. How many apples does Bill have now?"),
        (3, "Bill has 9 apples. Carl gives 4 apples to Mary. How many apples does Dora have now?"), (4, "Rain fell. " + item + " Bill has 9 apples. " * 20), (5, "How many apples does the shop have now?"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in leaks(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()} == {1, 2, 4}


def test_names_number_words_and_lists(spark):
    items = [(0, "Bob gave Anna 3 of Carl Dean Finn Gus Hal and Ivo. Now Ivo has Bob and Anna."), (1, "There were three red hens and seven blue ducks on the old farm for two hours."), (2, "Names: Adam Bert Carl Dean Emil Finn Gus Hal Ivo Jon Karl Lars Max Nils Otto Paul")]
    docs = [
        (1, "Tim gave Sue 8 of Otto Paul Rob Sam Ted and Urs. Now Urs has Tim and Sue."), (2, "There were nine red hens and twenty-five blue ducks on the old farm for six minutes."),
        (3, "Names: Zeno Yann Xaver Wim Vito Urs Tom Sam Rob Quinn Pete Olaf Nick Mark Leo Kurt"), (4, items[2][1]), (5, "There were red hens and blue ducks on the old farm for hours."),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 0), (2, 1), (4, 2)}


def test_short_items(spark):
    items = [(0, "Red kites circle!"), (1, "Why"), (2, "the old mill road"), (3, "!"), (4, "Chapter 3 begins"), (5, "red kites circle")]
    docs = [(1, "Dusk. Red kites circle. Then night."), (2, "Red kites circle over us"), (3, "why\nnot"), (4, "We took the old mill road."), (5, "chapter 4 begins"), (6, "Chapter 3 begins\nwhy. Why?"), (7, "The Old Mill Road")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_token, r.end_token) for r in leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 0, 1, 4), (1, 5, 1, 4), (3, 1, 0, 1), (6, 1, 3, 4), (6, 4, 0, 3), (7, 2, 0, 4)]


def test_tables_of_numbers_and_repeats_are_linear():
    """10^5 numbers, zeros and repeated words against items of a tenth of that."""
    import time

    import pyarrow as pa

    from curatrix.llm.decontaminate import Index, Templates

    r = random.Random(2)
    numbers, zeros, words = " ".join(str(r.randrange(10**6)) for _ in range(100_000)), "0 " * 100_000, "ab cd " * 50_000
    items = [" ".join(numbers.split()[500:10_500]), "0 " * 10_000, "ab cd " * 5_000, " ".join(str(r.randrange(10**6)) for _ in range(10_000)), "0 " * 9 + "end of it all then " + "0 " * 9]
    start = time.time()
    found = {(d, i) for d, i, *_ in Index(list(enumerate(items))).find(Templates(pa.array([numbers, zeros, words, "so " + "0 " * 40 + "end of it all then " + "0 " * 40])))}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 4), (3, 1)}  # forty zeros are a run of item 1
    assert time.time() - start < 40


def test_pieces_out_of_step(spark):
    """Words put in shift the rest of an item: every piece counts."""
    r = random.Random(3)
    item = [f"word{r.randrange(10**6)}" for _ in range(60)]
    docs = [(1, item[:30] + ["put", "in"] + item[30:]), (2, item[30:] + item[:30]), (3, item[:20] + ["x"] + item[20:40] + ["y"] + item[40:]), (4, [x for k in range(0, 60, 4) for x in [*item[k : k + 4], "z"]]), (5, item[:13]), (6, item[:12])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert {x.doc_id for x in leaks(df, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()} == {1, 2, 3, 5}


def test_nearest_step_at_any_size():
    import numpy as np

    from curatrix.llm.decontaminate import _away

    r = np.random.default_rng(3)
    for n in (1, 2, 50, 2000):
        steps, values = np.unique(r.integers(-9999, 9999, n)), r.integers(-20_000, 20_000, 700)
        assert (_away(values, steps) == np.abs(values[:, None] - steps[None]).min(axis=1)).all()
