import hashlib
import struct

import numpy as np
import pytest

from chronoweave.llm import pieces, queries

PATH = queries.vocabulary("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  x", "a▁b", "▁", "x\n\ty", "\0a", "😀", "<s>", "a </s> b <unk>", "<0x41>", "\n\n a  \n", "é̂  日本語 text\r\nab", "a" * 5000, "word " * 20_000, "\u2028x", " trailing   "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_spans_and_decoding(library):
    p = pieces.Pieces(pieces.load(PATH))
    for text in [t for t in TEXTS if t is not None]:
        ids, begins, ends = p.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert p.decode(ids) == library.decode(ids.tolist())
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()
        for i, a, b in zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True):
            piece = library.id_to_piece(i)
            if not library.is_control(i) and not library.is_byte(i):
                assert text.encode()[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


def test_whole_text_path_agrees(library):
    p = pieces.Pieces(pieces.load(PATH))
    for text in ("hello  world", "a▁b c😀d", "x\ny"):
        ids, begins, ends = p._whole(text)
        assert ids.tolist() == p.encode(text)[0].tolist() and ends[-1] == len(text.encode()) and (begins <= ends).all()


def test_character_map_takes_the_longest_prefix():
    # a double array by hand: "a" -> "X", "ab" -> "YZ"
    units = [0] * 512
    units[0] = 1 << 10
    a = 0 ^ 1 ^ 97
    units[a] = 97 | 1 << 8 | 256 << 10
    units[a ^ 256] = 1 << 31 | 0
    b = a ^ 256 ^ 98
    units[b] = 98 | 1 << 8 | 4 << 10
    units[b ^ 4] = 1 << 31 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"X\0YZ\0"
    out, source = pieces.CharacterMap(blob).apply("cab aé".encode())
    assert out == "cYZ Xé".encode() and source.tolist() == [0, 1, 1, 3, 4, 5, 5, 7]
    same, at = pieces.CharacterMap(b"").apply(b"ab")
    assert same == b"ab" and at.tolist() == [0, 1, 2]


def test_operator_outputs(spark, library):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int").repartition(2)
    for r in pieces.encode(df, PATH, ("ids", "begins", "ends", "decoded", "n_tokens")).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text, add_bos=True, add_eos=True) and len(r["ids"]) == len(r["begins"]) == len(r["ends"]) == r["n_tokens"]
        assert r["decoded"] == library.decode(r["ids"])
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_sentencepiece"](spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["n_bytes_covered"] == len(texts[r["doc_id"]].encode())
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
