import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from llm_cases import DOCS
from retrieva.llm import bpe, queries


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op5_equals_the_library_and_decodes_to_the_text(spark, sf001):
    enc = library()
    got = {r.doc_id: r for r in queries.op5_bpe(spark, sf001).collect()}
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d.text)
        g = got[d.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_chunked_texts_are_stitched_to_the_same_ids(spark):
    enc, rng = library(), random.Random(3)
    bits = ["word", " the", "  ", "\n\n", "'s", "'re", "x'll", " 12345", "éè", " 中文", "!!", " ?", "\t", "\r\n", "\U0001f600", " ", "\x1c", " ", " a", "..."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([5, 300, 2000]))) for _ in range(25)]
    texts += ["a" * 700, " " * 500 + "b" + " " * 500, "", "a b " * 400 + "c" * 600 + " d e" * 300, "\n" * 1000, "'" * 900 + "s" * 10]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (None, texts[1], None, None, 0), (2, texts[2], "en", "s", 1)]
    v = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS piece", "8 AS chunk", "9 AS n_tokens_")
    out = bpe.decode(bpe.encode(df, v, size=128, margin=40), v).collect()
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out) == sorted(
        (r[0] is None, r[0], np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert bpe.encode(df.limit(0), v).count() == 0


def test_long_texts_are_cut(spark):
    v = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["lorem ipsum " * 100, "x" * 1200, "lorem ipsum " * 50 + "y" * 500 + " lorem ipsum" * 50, "a b " * 100 + "z" * 300 + " c d" * 50 + "w" * 300 + " e" * 100]
    long = spark.createDataFrame(list(enumerate(texts)), "__bpe_row long, __bpe_text string")
    got = {}
    for r in bpe._pieces(long, v.pattern, 128, 40).collect():
        got.setdefault(r["__bpe_row"], []).append((r.start, r.part))
    assert {i: "".join(p for _, p in sorted(x)) for i, x in got.items()} == dict(enumerate(texts))
    assert len(got[0]) == 10 and len(got[1]) == 1
    # the long word is in one piece with what its chunks hold; the rest stays cut
    assert len(got[2]) >= 9 and max(len(p) for _, p in got[2]) < 500 + 3 * 128 and len(got[3]) >= 6 and max(len(p) for _, p in got[3]) < 300 + 3 * 128


def test_a_word_of_a_million_letters(spark):
    v = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc, rng = library(), random.Random(8)
    word = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    text = "some words here " * 20000 + word + " and others there" * 20000
    pieces = [len(r.part) for r in bpe._pieces(spark.createDataFrame([(0, text)], "__bpe_row long, __bpe_text string"), v.pattern, bpe.CHUNK, bpe.MARGIN).collect()]
    assert sum(pieces) == len(text) and len(pieces) > 15 and max(pieces) < 1_000_000 + 3 * bpe.CHUNK
    out = bpe.encode(spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS), v).first()
    assert bytes(out.ids) == np.array(enc.encode_ordinary(text), "<u4").tobytes()
