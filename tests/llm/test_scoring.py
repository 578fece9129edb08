import math
import random
import re
from collections import Counter

import pytest

from chronoweave.llm import queries, scoring


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(docs, size):
    """Stupid backoff over words; a vocabulary cut by count, in whole cells of the log scale."""
    texts = [split(t) for _, t in docs]
    counts = Counter(w for x in texts for w in x)
    total = sum(counts.values())
    cells = Counter(math.floor(math.log2(n) * 256) for n in counts.values())
    known, cut = 0, None
    for c in sorted(cells, reverse=True):
        known += cells[c]
        if known > size:
            break
        cut = c
    inside = lambda w: w if cut is not None and math.floor(math.log2(counts[w]) * 256) >= cut else "<unk>"
    texts = [[inside(w) for w in x] for x in texts]
    uni, bi = Counter(w for x in texts for w in x), Counter(p for x in texts for p in zip(x, x[1:], strict=False))
    out = []
    for (doc, _), x in zip(docs, texts, strict=True):
        s = sum(math.log(uni[w] / total) if i == 0 else math.log(bi[x[i - 1], w] / uni[x[i - 1]]) if bi[x[i - 1], w] >= 2 else math.log(0.4 * uni[w] / total) for i, w in enumerate(x))
        out.append((doc, len(x), s))
    return out


@pytest.mark.parametrize(("size", "head"), [(1000, 0), (1000, 5), (40, 10), (0, 0), (65_536, 1024)])
def test_scores(spark, size, head):
    rng = random.Random(size + head)
    pool = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "Word"), (902, "Word"), (None, "w1 w2"), (903, "w1 w2 " * 4000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pair int").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["log_prob"], r["score"]) for r in scoring.score(df, size, head).collect()), key=str)
    want = sorted(brute(docs, size), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for (_, n, s, mean), (_, _, t) in zip(got, want, strict=True):
        assert s == pytest.approx(t, abs=1e-6, rel=1e-9) and (mean is None if n == 0 else mean == pytest.approx(t / n, abs=1e-6))


def test_empty_table(spark):
    assert scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, s) for d, n, s in brute(docs, scoring.VOCABULARY)}
    for r in queries.QUERIES["op4_lm_scoring"](spark, sf).collect():
        assert r["n_words"] == want[r["doc_id"]][0] and r["log_prob"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9)


@pytest.mark.parametrize(("head", "known"), [(0, 0), (3, 0), (5, 20), (20, 20), (1024, 65_536)])
def test_every_word_counts_for_itself(spark, head, known):
    rng = random.Random(head + known)
    pool = [f"w{int(rng.paretovariate(0.4)) % 2000}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(900, None), (902, "only here"), (903, "new pair " * 12_000), (904, "new pair new new"), (905, "qzx vkw " * 3)]
    got = {r["doc_id"]: r["log_prob"] for r in scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), head=head, known=known).collect()}
    assert got == {d: pytest.approx(s, rel=1e-9, abs=1e-6) for d, _, s in brute(docs, math.inf)}


def test_words_beyond_the_broadcast_ones(spark):
    """More distinct words than are broadcast: rare ones aren't merged."""
    docs = [(i, " ".join(f"v{i * 100 + k}" for k in range(100))) for i in range(700)] + [(1000 + i, "v5 v6 v7") for i in range(3)]
    got = {r["doc_id"]: r["log_prob"] for r in scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: pytest.approx(s, rel=1e-9) for d, _, s in brute(docs, math.inf)}


def test_blocks_round_trip():
    import numpy as np
    import zstandard

    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        arrays = (rng.integers(-(2**62), 2**62, n), rng.integers(0, 9, n), rng.integers(-5, 5, n), rng.integers(0, 99, n).astype(np.int32))
        back = scoring.unpack(scoring.pack(arrays, scoring._PAIR, zstandard.ZstdCompressor()), scoring._PAIR, zstandard.ZstdDecompressor())
        assert all((x == y).all() and len(y) == n for x, y in zip(arrays, back, strict=True))


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PART", 40)
    monkeypatch.setattr(scoring, "PACK_BYTES", 100)
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(40)] + [(None, None), (3, "w1 w2 w3"), (3, "")]
    want = brute(docs, scoring.VOCABULARY)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["log_prob"]) for r in scoring.score(df, head=4, known=9).collect()), key=str)
    want = sorted(want, key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-6 for (*_, a), (*_, b) in zip(got, want, strict=True))
