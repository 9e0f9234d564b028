"""Chat formatting, token files and BPE against the libraries and SQL."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recohort.llm import bpe, chat, frames
from recohort.llm.registry import ORACLES, QUERIES
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.01"

HARD = ["", None, "plain words here", "\\### Assistant: </turn> ok", "a\n</turn>\nb", "</turn>\n", "\n</turn>", "x\\0\\1 <turn user>\n",
        "é日本 <|endoftext|> ß ", " two  blanks\n\nand\tmore ", "tailing ", "\\", "<quoted-turn a>\n", "a" * 3000, " " * 70, "don't we'll I'm"]


def rows(spark, texts, schema="doc_id long, text string, lang string, ids string"):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], schema)


@pytest.mark.parametrize("name", ["op1_chat_format"])
def test_sql(spark, name):
    assert difference(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) is None


def test_chat_round_trip(spark):
    turns = [(c, t, ["user", "assistant", None, "odd>\nrole<"][t % 4], HARD[(c + t) % len(HARD)]) for c in range(8) for t in range(7)]
    turns += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    written = chat.format_conversations(frame)
    found = {r["conv_id"]: r for r in written.select("*", chat.parse(written["formatted"]).alias("turns"), chat.masked_text(written["formatted"], written["loss_spans"]).alias("loss")).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t, r or "", x or "") for i, t, r, x in turns if i == c), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [t[1:] for t in own]
        assert found[c]["loss"] == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_merge_rounds_equal_library():
    path = bpe.vocabulary("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    random.seed(3)
    pool = "abcXYZ019 \n\t\r'sdtré日本😀́ <|endoftext|>"
    texts = [t or "" for t in HARD] + ["".join(random.choices(pool, k=random.randrange(50))) for _ in range(3000)]
    for got, text in zip(bpe.Encoder(codec, 500).encode(texts), texts, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want
        assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_letters_newer_than_the_tables():
    """The one block that is cut otherwise than by the library, as README says; its letters are younger than the library's tables."""
    path = bpe.vocabulary("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    kinds = ["", "a", "1", " ", "\n", ".", "'s", "é", "日"]
    blocks = [*range(0x10940, 0x10960), *range(0x1C80, 0x1C90), *range(0x16D40, 0x16D80), *range(0x2EBF0, 0x2EC00)]
    texts = [f"{one}{chr(c)}{two}" for c in blocks for one in kinds for two in kinds]
    got = bpe.Encoder(codec, 500).encode(texts)
    differ = {hex(ord(next(ch for ch in t if ord(ch) in set(blocks)))) for g, t in zip(got, texts, strict=True) if g.tolist() != library.encode(t, add_special_tokens=False).ids}
    assert differ <= {hex(c) for c in range(0x10940, 0x10960)}


def test_bpe_query(spark):
    path = bpe.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = rows(spark, HARD + HARD[:3])
    found = {r["doc_id"]: r for r in bpe.digest_documents(docs, path).collect()}
    assert len(found) == docs.count()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.encode_documents(docs, path, "ids", "decoded")
    assert whole.columns == ["doc_id", "text", "lang", "ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in whole.collect())
    assert bpe.digest_documents(docs.limit(0), path).count() == 0


def test_words_are_encoded_as_the_library_does(tmp_path):
    random.seed(11)
    pool = ["a", "B", "é", "é", "́", "Σ", "1", "½", "'s", "'", ".", "…", "日", "\x1c", "\u00a0", "\u2028", "<|endoftext|>", "<|startoftext|>", "<|end", " ", "\n", "\t", "  "]
    texts = ["".join(random.choices(pool, k=random.randrange(30))) for _ in range(4000)] + ["", "x" * 40000]
    path = bpe.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    encoder = frames.LibraryEncoder(path)
    assert encoder.by_words and [i.tolist() for i in encoder.encode(texts)] == want
    # A short memory, and a vocabulary in which blanks count.
    small = frames.LibraryEncoder(path, remembered=5)
    assert [i.tolist() for at in range(0, len(texts), 50) for i in small.encode(texts[at:at + 50])] == want
    path = bpe.vocabulary("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), frames.LibraryEncoder(path)
    assert not encoder.by_words
    assert [i.tolist() for i in encoder.encode(texts[:300])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts[:300]]


def test_token_files(spark, tmp_path):
    path = bpe.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = HARD + ["ΑΣ ΑΣ. Σ", "a\x1cb c\x85d", "é ́x", "<|startoftext|>Hi"] * 3
    docs = rows(spark, texts).selectExpr("if(doc_id = 3, null, doc_id * 3 % 19) doc_id", "text", "lang")
    found = frames.read_files(frames.write_files(docs, path, str(tmp_path), 3), str(tmp_path)).orderBy("start").collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect()))
    start = 0
    assert len(found) == len(want)
    # Rows of one doc_id may stand in any order; the order of doc_ids and the positions are fixed.
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found] == [w[:2] for w in want]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found)
    assert got == sorted((has, doc_id, len(ids) // 4, zlib.crc32(ids)) for has, doc_id, ids in want)
    assert frames.read_files(frames.write_files(docs.limit(0), path, str(tmp_path), 3), str(tmp_path)).count() == 0


def test_frames_are_independent_and_checked():
    sink = io.BytesIO()
    writer = frames.FrameWriter(sink, 50)
    held = {k: np.arange(k, dtype=np.uint32) + (70_000 if k == 5 else 0) for k in range(40)}
    for k, ids in held.items():
        writer.add(k, k * 100, ids)
    writer.close()
    reader = frames.FrameReader(io.BytesIO(sink.getvalue()))
    assert len(reader) > 5
    assert [d for d, _, _ in reader.documents(11, 23)] == list(range(11, 24))
    assert all((ids == held[d]).all() and s == d * 100 for n in range(len(reader)) for d, s, ids in reader.frame(n))
    damaged = bytearray(sink.getvalue())
    damaged[int(reader.starts[2]) + 20] ^= 1
    with pytest.raises(Exception):
        list(frames.FrameReader(io.BytesIO(bytes(damaged))).frame(2))
