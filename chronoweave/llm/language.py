"""Language identification by compression against per-language raw-content dictionaries.

A text is compressed with each language's zstandard dictionary, in blocks of ``BLOCK_BYTES`` that each
start from the dictionary, so that its help, and with it the margin, doesn't fade with the text's
length; the smallest sum names the language. Dictionaries are fitted on a bounded sample of labelled rows
(``SAMPLE_DOCS`` documents a language, the smallest in a hash order, ``SAMPLE_CODE_POINTS`` of
each, ``DICTIONARY_BYTES`` in all); that bound is the same at every size of input.

Defined results. Null text, or a text without a letter: ``und``, score 0, not accepted. No
labelled rows to learn from: every text is ``und``. Equal sizes: the language with more
labelled rows, then the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import map_arrow

SAMPLE_DOCS = 400
SAMPLE_CODE_POINTS = 2048
DICTIONARY_BYTES = 128 << 10
LEVEL = 5
#: Text that is compressed at a time.
BLOCK_BYTES = 32 << 10
#: A relative margin below this is too narrow to accept.
MIN_MARGIN = 0.004
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in order of how many labelled rows each has."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = LEVEL


#: Fixed: bytes below 128 other than letters count as a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, with ASCII other than letters as spaces."""
    return text.lower().encode().translate(_LETTERS)


def fit(docs: DataFrame, learn: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit dictionaries on rows of ``docs`` where ``learn`` holds and the label isn't null."""
    order = F.xxhash64(docs[id_col].cast("string"))
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), order.alias("h"), docs[text_col].cast("string").alias("text"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where("learn and lang is not null and text is not null").drop("learn")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return LanguageModel((), ())
    # the hash is uniform: below this bound lie twice as many rows as are taken, or all
    wanted = F.lit(False)
    for lang in languages:
        share = min(1.0, 2 * sample_docs / counts[lang])
        bound = int(-(2**63) + share * (2**64 - 1))
        wanted = wanted | ((F.col("lang") == lang) & (F.col("h") <= F.lit(min(bound, 2**63 - 1))))
    sample = rows.where(wanted).select("lang", "h", F.substring("text", 1, SAMPLE_CODE_POINTS).alias("text")).collect()
    dictionaries = []
    for lang in languages:
        parts, size = [], 0
        for r in sorted((r for r in sample if r["lang"] == lang), key=lambda r: (r["h"], r["text"]))[:sample_docs]:
            if size < DICTIONARY_BYTES:
                parts.append(plain(r["text"]))
                size += len(parts[-1]) + 1
        dictionaries.append(b" ".join(parts)[:DICTIONARY_BYTES])
    return LanguageModel(tuple(languages), tuple(dictionaries))


def compressors(model: LanguageModel) -> list:
    import zstandard

    out = []
    for data in model.dictionaries:
        # a dictionary of fewer than 8 bytes is refused; spaces add nothing
        held = zstandard.ZstdCompressionDict(data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False))
    return out


def judge(text: str | None, model: LanguageModel, tools: list) -> tuple[str, float]:
    """Language and margin: how much larger the second smallest result is, as a share of it."""
    if not text or not tools or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    data = plain(text)
    blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(t.compress(b)) for b in blocks), i) for i, t in enumerate(tools))
    if len(sizes) == 1:
        return model.languages[0], 1.0
    return model.languages[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN, passing: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) and the columns named in ``passing``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), *(docs[c].alias(f"_p{i}") for i, c in enumerate(passing)))
    fields = source.schema.fields
    schema = ", ".join(["_id " + fields[0].dataType.simpleString(), *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[2:]), "lang_pred string, score double, accepted boolean"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tools = compressors(model)
        for batch in batches:
            found = [judge(t, model, tools) for t in batch.column("_text").to_pylist()]
            columns = [batch.column("_id"), *(batch.column(f"_p{i}") for i in range(len(passing)))]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            columns.append(pa.array([x[0] != UNDETERMINED and x[1] >= min_margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *(f"_p{i}" for i in range(len(passing))), "lang_pred", "score", "accepted"])

    out = map_arrow(source, fn, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_p{i}").alias(c) for i, c in enumerate(passing)), "lang_pred", "score", "accepted")


def held_out(docs: DataFrame, id_col: str = "doc_id") -> F.Column:
    """True for the quarter of documents that is never learnt from."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 4 == 2, F.lit(False))
