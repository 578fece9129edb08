import os
import random

import pytest

from chronoweave.llm import queries, tokens

PATH = queries.vocabulary("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts():
    rng = random.Random(1)
    out = ["", None, "don't 't 'tis ''s 'S it's'll  've\n\n x  '", " 's", "1²½Ⅷ a１", "<|endoftext|> a<|endoftext|>  b ", "I'velcome 'realm 'mm 'd", "''re x're 're", "a\r\n\r\n b\t\tc", "x" * 50_000, " " * 3000, "😀 日本語　text\u0085q", "\0\0row5", "same", "same"]
    alphabet = list("ab's t'rev ml d\n\t 1²é !?.'' ")
    return out + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]


@pytest.mark.parametrize("head", [0, 20, tokens.HEAD])
def test_counts_equal_the_library(spark, head):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in tokens.count_tokens(df, PATH, head=head).collect()}
    for (i, text), n in zip(docs, library(t for _, t in docs), strict=True):
        assert got[i]["n_tokens"] == n and got[i]["n_bytes"] == len((text or "").encode()) and got[i]["over_limit"] == (n > 512)


def test_every_code_point():
    import numpy as np

    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]][::11]
    sample = [f"a{c} {c}1{c} !{c}" for c in points]
    spec, specials, fixes = tokens.load(PATH)
    s = tokens.Split(sample, specials, fixes)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    for i in range(0, len(sample), 499):
        want = [sample[i][a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(sample[i])]
        mine = np.flatnonzero(s.row == i)
        assert [s.text[a:b] for a, b in zip(s.starts[mine].tolist(), s.ends[mine].tolist(), strict=True)] == want


def test_repeated_rows_empty_table_and_clashing_names(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, "c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count_tokens(df, PATH).collect())
    assert got == [(0, 1), (1, 2), (1, 2)]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


def test_query_over_the_table(spark, sf):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op1_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == dict(zip([d["doc_id"] for d in docs], library([d["text"] for d in docs]), strict=True))
