import random

import pytest

from chronoweave.llm import decontamination as d
from chronoweave.llm import queries


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randrange(14, 50)))) for i in range(30)] + [(100, "only seven words are in this item"), (101, "two words"), (102, None), (103, "")]
    docs, want = [], {}
    for i in range(120):
        text = words(rng, rng.randrange(0, 200))
        if i % 3 == 0:
            item = items[rng.randrange(30)]
            w = item[1].split()
            if i % 2:  # every ninth word is substituted
                w = [f"other{k}" if k % 9 == 4 else x for k, x in enumerate(w)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = ["The", *(x.upper() + "," for x in w)] if i % 4 == 0 else w
            want[i] = [item[0]]
        docs.append((i, " ".join(text)))
    docs += [(500, "x only SEVEN words, are in this item!"), (501, "x only seven nice words are in this item"), (502, None), (503, ""), (504, "two words"), (None, items[0][1])]
    want[500] = [100]
    want[None] = [0]
    return docs, items, want


@pytest.mark.parametrize("most", [d.MAX_BROADCAST, 0])
def test_finds_planted_items_only(spark, case, most):
    docs, items, want = case
    df = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, h string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in d.contaminated(df, bench, max_broadcast=most).collect()}
    assert {k: r["item_ids"] for k, r in got.items()} == want
    for r in got.values():
        for o in r["overlaps"]:
            assert o["matches"] <= o["end_word"] - o["first_word"] and o["matches"] / o["item_words"] <= r["max_share"]
    kept = d.decontaminate(df, bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i is None or i not in want) and kept.columns == df.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    for most in (d.MAX_BROADCAST, 0):
        assert d.contaminated(docs, bench, max_broadcast=most).count() == 1
        assert d.contaminated(docs.limit(0), bench, max_broadcast=most).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0


def test_query_against_plain_search(spark, sf):
    import re

    norm = lambda t: " ".join(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {r["doc_id"]: ids for r in docs if (ids := sorted(i["item_id"] for i in items if f" {norm(i['text'])} " in f" {norm(r['text'])} "))}
    got = {r["doc_id"]: r["item_ids"] for r in queries.QUERIES["op10_decontamination"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("most", [d.MAX_BROADCAST, 0])
def test_case_and_marks_beyond_ascii(spark, most):
    import unicodedata

    rng = random.Random(8)
    stems = ["señor", "canción", "über", "straße", "élan", "año", "naïve", "œuvre", "plain", "čas"]
    item = " ".join(f"{rng.choice(stems)}{chr(97 + rng.randrange(26))}{rng.choice(stems)}" for _ in range(26))
    texts = [item, item.upper(), item.title(), unicodedata.normalize("NFD", item.upper()), item.replace(" ", "—"), "«" + item.upper().replace(" ", "»\u00a0“") + "”", "ÑANDÚ " * 40, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "CINCO PALABRAS ÑU ÓSEA ÜB")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_ids"], r["max_share"]) for r in d.contaminated(docs, bench, max_broadcast=most).collect()) == [(i, [7], 1.0) for i in range(6)]
    short = spark.createDataFrame([(1, "son cinco palabras ñu ósea üb aquí")], "doc_id long, text string")
    assert [r["item_ids"] for r in d.contaminated(short, bench, max_broadcast=most).collect()] == [[8]]


@pytest.mark.parametrize("most", [d.MAX_BROADCAST, 0])
def test_partial_and_parted_copies(spark, most):
    rng = random.Random(12)
    short, middle, long = words(rng, 36), words(rng, 59), words(rng, 400)
    noise = lambda: words(rng, 40)
    parted = [*short[:12], "in", *short[12:24], "between", *short[24:]]
    gone = [*short[:12], *short[14:26], *short[28:]]
    texts = [[*noise(), *middle[10:39], *noise()], [*noise(), *long[100:290], *noise()], [*noise(), *parted, *noise()], [*noise(), *gone], parted, [*noise(), *middle[:9], *noise()], noise()]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((short, middle, long))], "item_id long, text string")
    got = {r["doc_id"]: r for r in d.contaminated(docs, bench, max_broadcast=most).collect()}
    assert {i: r["item_ids"] for i, r in got.items()} == {0: [1], 1: [2], 2: [0], 3: [0], 4: [0]}
    assert got[2]["max_share"] == got[4]["max_share"] == 1.0 and got[0]["max_share"] == pytest.approx(29 / 59)
    for r in got.values():
        assert all(o["matches"] <= o["end_word"] - o["first_word"] for o in r["overlaps"])
