import hashlib
import random
import re

from chronoweave.llm import pii, queries


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    """Base spans as the contract's patterns give them: (start, rank, kind, end)."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find(df).collect()}


def test_base_spans(spark):
    texts = ["a@b.c%d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 999.1.2.3.4 0001.002.03.255 9.1.0.1", "4785 3805 9239 1139 4785380592391139-1 4--785380592391139 12-34", "+1 (555) 123-4567 +1 23 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "éé😀 a.b@c.de 8.8.8.8", None, "", "a" * 3000 + "@", "1.2.3.4 " * 2000, "4 " * 60_000, "+1" * 5000]
    rng = random.Random(2)
    for alphabet in ("a1.@ -+()%1234567890 4", "0123 -.+"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 70))) for _ in range(600)]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[1] < 4] == brute(text), text[:80]


def test_added_kinds_need_proof(spark):
    good, bad = "IBAN DE89 3704 0044 0532 0130 00 x", "IBAN DE88 3704 0044 0532 0130 00 x"
    got = found(spark, [good, bad, "GB82WEST12345698765432", "ssn 123-45-6789", "part 123-45-6789", "x" * 41 + " ssn 000-45-6789"])
    assert [[s[2] for s in got[i]] for i in range(6)] == [["iban"], [], ["iban"], ["ssn"], [], []]
    assert got[0][0][3] - got[0][0][0] == 27


def test_secrets(spark):
    key = "f32ab9ba2834a0d390df92664b1272635dbc0ec6"
    texts = [f'x token = "{key}" y', f"TOKEN: {key.upper()}", "token = of all the words in the world", "password=aaaaaaaaaaaaaaaaaaaaaaaa1", "api_key: 'Zx81kLmQ0pR7vTn2'", "ghp_" + "a1B2c3" * 6, "the token ring", key, "token = " + "9" * 50_000, "secret " * 20_000]
    got = found(spark, texts)
    assert [[s[2] for s in got[i]] for i in range(len(texts))] == [["secret"], ["secret"], [], [], ["secret"], ["secret"], [], [], [], []]
    assert got[0][0][0] == 2 and texts[0][2 : got[0][0][3]].endswith(key)


def test_context_moves_the_score(spark):
    df = spark.createDataFrame([(1, "call +15551234567 now"), (2, "version +15551234567"), (3, "+15551234567")], "doc_id long, text string")
    scores = {r["doc_id"]: r["spans"][0]["score"] for r in pii.find(df).collect()}
    assert scores[1] > scores[3] > scores[2]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", 0)], "doc_id long, text string, m_email int")
    assert pii.find(df).first()["spans"][0]["kind"] == "email" and pii.find(df.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_pii"](spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in want) for k in pii.BASE]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_no_python_in_the_plan(spark, sf):
    plan = queries.QUERIES["op3_pii"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
