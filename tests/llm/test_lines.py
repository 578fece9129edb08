import hashlib
import random

import pytest

from chronoweave.llm import lines, queries
from tests.conftest import rows

STRIP = " \t\n\x0b\x0c\r"


def brute(docs):
    """Contract of op2, straight from its text."""
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(STRIP).encode().lower()
            if doc is not None and len(key.decode()) >= 20:
                held.setdefault(key, set()).add(doc)
    out = []
    for doc, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc is None or len(held.get(x.strip(STRIP).encode().lower(), ())) < 3 or max(held[x.strip(STRIP).encode().lower()]) == doc]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, docs, partitions="4"):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(df).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(docs)


def test_edges(spark):
    a, b = "this line is long enough", "Ünïcödé line of twenty+"
    docs = [(1, f"{a}\n  {a.upper()}\t\nshort"), (2, a + " "), (3, f"x\n{a}\n{a}"), (4, None), (5, ""), (6, "\n\n"), (7, b), (8, b.replace("L", "l")), (9, f"{b}\r"), (10, "é" * 19), (11, "é" * 19), (12, "é" * 19), (13, "É" * 20), (14, "é" * 20), (15, "É" * 20), (None, a)]
    check(spark, docs)


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_random_with_hot_line(spark, partitions):
    rng = random.Random(5)
    pool = [f"line number {i} of the common pool" for i in range(30)]
    docs = [(i, "\n".join(["the hottest line of them all"] * (rng.random() < 0.6) + [rng.choice(pool) for _ in range(rng.randrange(6))] + [f"only in document {i} here"])) for i in range(300)]
    docs.append((7, docs[7][1]))  # a repeated row
    check(spark, docs, partitions)


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_streams_batch_by_batch(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(8)
    pool = [f"line number {i} of the common pool" for i in range(4)]
    check(spark, [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(4)))) for i in range(40)], "3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_one_id_with_different_texts(spark):
    common = "a line that three documents share"
    docs = [(1, f"{common}\nkeep me one"), (1, "a\nb"), (1, f"x\n{common}"), (2, common), (3, f"{common}\nlast"), (3, f"other\n{common}")]
    check(spark, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in lines.apply_bitmaps(df, lines.drop_bitmaps(df)).collect())
    assert got == [(1, "a\nb"), (1, "keep me one"), (1, "x"), (2, ""), (3, f"{common}\nlast"), (3, f"other\n{common}")]


def test_bitmaps_that_are_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    check(spark, [(i, "one long line that all of them have\nown " + str(i)) for i in range(9)])


def test_empty_and_extra_columns(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(9, "a", "x" * 25, 1, 2)], "h1 int, _keep string, text string, doc_id long, keep int")
    assert lines.dedup_lines(df).first()["text"] == "x" * 25
    out = lines.apply_bitmaps(df, lines.drop_bitmaps(df))
    assert out.columns == df.columns and out.first() == df.first()


def test_very_long_text(spark):
    docs = [(i, "\n".join(f"a rather long line number {k}" for k in range(20_000))) for i in range(3)]
    check(spark, docs)


def test_query_matches_sql(spark, sf, duck):
    got = queries.QUERIES["op2_line_dedup"](spark, sf).toPandas()
    assert rows(got) == rows(duck.sql(queries.ORACLES["op2_line_dedup"]).df())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {r[0]: hashlib.sha256(r[3].encode()).hexdigest() for r in brute(sorted(texts.items()))}
    assert dict(zip(got["doc_id"], got["kept_sha256"], strict=True)) == want
