"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for
addresses, a mixture of characters for secrets), and context words nearby move a span's score up or down. Spans of the base kinds (email, ip, card, phone)
stay whatever their score; the added kinds (iban, ssn, secret) stay from ``MIN_SCORE`` on. A secret is a long value that
a name like token, key or password is given, name included, or a key of a public form.

Every pattern is written with possessive quantifiers and takes a linear scan. ``card`` and
``phone`` count their digits in the pattern: a longer run is passed over as a whole, as if it had been matched
and dropped. Offsets are code points, end exclusive, from running sums of the lengths of what
lies between matches; sums go by blocks, so a text of a million matches stays cheap.
One projection, no shuffle.

Defined results. Null text: as the empty text. Spans of one kind never overlap; those of
different kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that ties of a start are listed in.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|passw(?:or)?d|pwd|credentials?)[\"']?+[ \t]{0,4}+[:=]{1,2}[ \t]{0,4}+[\"']?+[A-Za-z0-9+/_.~-]{16,}+|AKIA[0-9A-Z]{16}+|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)",
}
#: A character that every match has; texts without it are not scanned.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
_PART = "(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"
#: Scores after a validator's word, and how far context moves them.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.7}
CONTEXT = {
    "email": "(?i)e-?mail|contact|write|reply",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": "(?i)card|visa|master|amex|credit|payment",
    "phone": r"(?i)phone|\btel\b|mobile|call|fax",
    "iban": "(?i)iban|bank|account|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social security",
    "secret": r"(?i)bearer|login|deploy|export|config",
}
AGAINST = r"(?i)\b(?:version|isbn|order|serial|sample|example|test)\b"
RAISE, LOWER, MIN_SCORE = 0.2, 0.2, 0.5
#: Code points on each side of a span that context words are looked for in.
NEAR = 40
_BLOCK = 64


def _sums(lengths: Column) -> Column:
    """Running sums before each element, by blocks."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK)
    empty = F.array().cast("array<int>")

    def running(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("before"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before"))
        return F.aggregate(items, first, step, lambda acc: acc["before"])

    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x))
    starts = running(totals, F.lit(0))
    zipped = F.arrays_zip(blocks.alias("b"), starts.alias("s"))
    return F.flatten(F.transform(zipped, lambda z: running(part(z["b"]), z["s"])))


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of matches, from what lies between them."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    gaps = F.transform(between, F.length)
    both = F.zip_with(gaps, matches, lambda g, m: g + F.length(m))
    before = F.zip_with(_sums(both), gaps, lambda s, g: s + g)
    return F.zip_with(matches, before, lambda m, s: F.struct(m.alias("m"), s.alias("start"), (s + F.length(m)).alias("end")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    code = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def mixed(value: Column) -> Column:
    """Whether a secret's last part looks drawn at random: letters and digits, eight different ones at least."""
    last = F.regexp_extract(value, "([A-Za-z0-9+/_.~-]+)$", 1)
    return last.rlike("[0-9]") & last.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.lower(last), ""))) >= 8)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: luhn(F.regexp_replace(m, "[ -]", "")),
    "phone": lambda m: F.lit(True),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(F.replace(m, F.lit(" "))),
    "ssn": lambda m: F.lit(True),
    "secret": mixed,
}


def _score(kind: str, text: Column, span: Column) -> Column:
    left = F.greatest(span["start"] - NEAR, F.lit(0))
    near = F.concat_ws(" ", F.substring(text, left + 1, span["start"] - left), F.substring(text, span["end"] + 1, F.lit(NEAR)))
    moved = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), RAISE).otherwise(0.0) - F.when(near.rlike(AGAINST), LOWER).otherwise(0.0)
    return F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), 3)


def _is_valid(kind: str):
    return lambda s: VALID[kind](s["m"])


def _as_span(kind: str, rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _score(kind, F.col("text"), s).alias("score"))


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def find(docs: DataFrame, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): SPAN of each row, sorted by start, then kind as in KINDS."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in kinds:
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        needs = F.col("text").contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        rows = rows.withColumn(f"m_{kind}", F.when(needs, found).otherwise(none))
    for rank, kind in enumerate(KINDS):
        if kind not in kinds:
            continue
        matches = F.col(f"m_{kind}")
        placed = _placed(F.col("text"), matches, PATTERNS[kind])
        scored = F.transform(F.filter(placed, _is_valid(kind)), _as_span(kind, rank))
        kept = scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)
        rows = rows.withColumn(f"s_{kind}", F.when(F.size(matches) > 0, kept).otherwise(F.array()).cast(SPAN))
    return rows.select("doc_id", F.array_sort(F.concat(*(F.col(f"s_{k}") for k in kinds))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
