import random

import pytest

import corpus_pipeline
from chronoweave.llm import language, queries
from tests.llm import test_jaccard, test_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    out = str(tmp_path_factory.mktemp("sf"))
    items = [(i, " ".join(f"bench{rng.randrange(900)}" for _ in range(25))) for i in range(6)]
    docs = []

    def add(text, lang):
        docs.append((len(docs), text, lang, f"s{len(docs) % 3}", len(text) if text is not None else None))

    for i in range(160):
        lang, pool = ("en", EN) if i % 2 else ("de", DE)
        lines = [" ".join(rng.choice(pool) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(6, 14))) for _ in range(rng.randrange(2, 8))]
        if i % 5 == 0:
            lines.insert(0, f"this very line is shared by many documents, {i % 2}")
        if i % 11 == 0:
            lines.append(items[i % 6][1])
        add("\n".join(lines), lang)
        if i % 7 == 0:  # near copies: some words are substituted
            for _ in range(3):
                add("\n".join(x.replace(" the ", " teh ", 1) if rng.random() < 0.5 else x for x in lines) + " end", lang)
    for text in (None, "", "12345 !!", "\n\n"):
        add(text, None)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, items


def test_run_equals_brute_force(spark, folder):
    import sentencepiece

    out, docs, items = folder
    table = spark.createDataFrame(docs, DOCS)
    model = language.fit(table, ~language.held_out(table))
    tools = language.compressors(model)
    kept = []
    for d in docs:
        lang, margin = language.judge(d[1], model, tools)
        if lang != "und" and margin >= language.MIN_MARGIN:
            kept.append(d[:2])
    assert len(docs) - len(kept) < 12
    kept = [(i, text) for i, _, _, text in test_lines.brute(kept)]
    components = test_jaccard.brute(kept)
    kept = [(i, t) for i, t in kept if components[i][1] == i]
    kept = [(i, t) for i, t in kept if not any(x in t for _, x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = {i: len(library.encode(t, add_bos=True, add_eos=True)) for i, t in kept}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, out).collect()}
    assert got == want and len(got) < len(docs)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    out, docs, _ = folder
    df = spark.createDataFrame([(*d, [1, 2]) for d in docs], DOCS + ", _keep array<int>")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, df, out)
        assert result.columns == df.columns and result.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        assert 0 < result.count() <= len(docs)
        assert stage(spark, df.limit(0), out).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), out).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))


def test_workers_let_go_of_other_operators():
    from chronoweave.llm import common, pieces

    pieces._LOADED["some"] = None
    common._LAST[:] = [pieces.__name__]
    common.release(pieces.__name__)
    assert "some" in pieces._LOADED
    common.release("chronoweave.llm.jaccard")
    assert not pieces._LOADED
    common.give_back()
