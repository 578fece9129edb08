import random
import zlib

from chronoweave.llm import language, queries


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    both = got.join(docs)
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.index]).all()
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and (~got["accepted"]).mean() < 0.03


def test_edges(spark):
    train = [(i, "the house and the garden are here today " * 3, "en") for i in range(8)] + [(10 + i, "das haus und der garten sind heute hier " * 3, "de") for i in range(8)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.fit(df)
    probe = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !? 😀", 0), (4, "der garten und das haus", 0), (None, "the garden and the house", 0), (6, "the house " * 200_000, 0)], "doc_id long, text string, lang_pred int")
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in language.identify(probe, model).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("de", True), None: ("en", True), 6: ("en", True)}
    assert language.identify(probe.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(empty, language.fit(empty)).first()["lang_pred"] == "und"


def test_one_language(spark):
    df = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert language.identify(df, language.fit(df)).first()["lang_pred"] == "en"


def test_same_model_from_any_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert language.fit(docs) == language.fit(docs.repartition(7))


def test_long_varied_text_keeps_its_margin(spark):
    rng = random.Random(6)
    pools = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(3000)] for lang, letters in (("en", "etaoinshrdlu"), ("de", "enisratdhulc"))}
    text = lambda lang, n: " ".join(rng.choice(pools[lang]) for _ in range(n))
    df = spark.createDataFrame([(i, text(lang, 200), lang) for i, lang in enumerate(["en", "de"] * 60)], "doc_id long, text string, lang string")
    model = language.fit(df)
    tools = language.compressors(model)
    margins = {n: language.judge(text("en", n), model, tools) for n in (10_000, 600_000)}
    assert all(lang == "en" for lang, _ in margins.values())
    assert margins[600_000][1] > 0.5 * margins[10_000][1] and margins[600_000][1] >= language.MIN_MARGIN
    probe = spark.createDataFrame([(1, text("de", 600_000))], "doc_id long, text string")
    assert language.identify(probe, model).select("lang_pred", "accepted").first() == ("de", True)
