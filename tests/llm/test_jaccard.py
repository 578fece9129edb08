import random
import re
from collections import defaultdict

import pytest

from chronoweave.llm import jaccard, queries


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            by[s].append(i)
    common = defaultdict(int)
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 1 << 60)
    for i in sets:
        least[find(i)] = min(least[find(i)], i)
    return {i: (len(sets[i]), least[find(i)]) for i in sets}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(docs)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("heavy_from", [2, 4])
def test_groups_of_edited_copies(spark, monkeypatch, heavy_from):
    monkeypatch.setattr(jaccard, "HEAVY_FROM", heavy_from)
    rng = random.Random(heavy_from)
    docs, passage = [], [f"p{i}" for i in range(30)]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(2, 14)):
            docs.append((len(docs), edited(rng, base, rng.randrange(0, 1 + len(base) // 20))))
    for _ in range(40):  # a passage that unlike documents share
        docs.append((len(docs), " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))] + passage)))
    check(spark, docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d e"), (8, "A b c d e\n"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 9000), (12, "x " * 5), (13, " ".join(map(str, range(30_000))))]
    check(spark, docs)


def test_threshold_is_exact(spark):
    words = [f"t{i}" for i in range(104)]  # 100 shingles
    docs = [(1, " ".join(words)), (2, " ".join(words[25:])), (3, " ".join(words[26:])), (4, " ".join(f"o{i}" for i in range(104)))]
    check(spark, docs)


def test_star_with_one_word_in_each(spark):
    base = [f"s{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:30], f"z{i}", *base[31:]])) for i in range(120)]
    check(spark, docs)


def test_empty_nulls_repeats_and_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (3, "A b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3)]
    kept = sorted(r["cls"] for r in jaccard.drop_near_duplicates(df).collect())
    assert kept == [2, 3, 4]


def test_near_copy_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (None, " ".join([*words, "more"])), (None, " ".join(["less", *words])), (7, " ".join([*words, "more", "words"])), (7, "quite another text under an id that occurs before")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 57, 3), (0, 57, 3), (3, 56, 3), (7, 5, 7), (7, 58, 3)]


@pytest.mark.parametrize("stars", [0, 1])
def test_pairs_between_components(spark, monkeypatch, stars):
    """All links come from the exact order's prefixes if no stars lead to them; sets just below the threshold stay apart."""
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", stars)
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 2)
    rng = random.Random(stars)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, edited(rng, base, rng.randrange(3, 9))) for i in range(150)]
    docs += [(1000 + i, edited(rng, base[:60], rng.randrange(0, 3))) for i in range(40)]
    docs += [(2000 + i, docs[i][1]) for i in range(5)]
    check(spark, [*docs, (2000, docs[0][1])][:-1])


def test_names_that_agree_in_64_bits(spark, monkeypatch):
    whole = jaccard._digests
    monkeypatch.setattr(jaccard, "_digests", lambda h, n: (whole(h, n)[0] * 0 + 5, whole(h, n)[1]))
    h, counts = jaccard.shingle_sets(__import__("pyarrow").array(["a b", "c d", "a b"]))[::2]
    assert jaccard._classes(h, counts, [5]) == [int(x) for x in whole(h, counts)[1]] and jaccard._classes(h, counts, []) == [5, 5, 5]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op7_ngram_jaccard"](spark, sf).collect()}
    assert got == brute(docs)
