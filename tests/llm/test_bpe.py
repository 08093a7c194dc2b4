import os
import resource
import subprocess
import sys

import numpy as np
import pytest

from spanforge.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"):
    pytest.skip("no vocabulary", allow_module_level=True)

TEXTS = [
    None, "", " ", "   ", "a", " a", "a b", "I'll we've  two\n\n\tx ", "<|endoftext|> is plain", "１２３ ½ ²", "日本語の文章 です", "é​﻿", "\x00\x1f \x85\xa0　x",
    "x" * 5000, "ab" * 200 + " " + "z" * 65, "🙂👨‍👩‍👧 ok", "Grüße, naïve — “quotes”", "\r\n\r\n  a\r\n", "a" * 64 + " " + "b" * 64, "!!!??? ,,,",
]


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    # special tokens are plain text
    t.encode_special_tokens = True
    return t


def _split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_same_as_public_library(public):
    enc = bpe.Encoder(bpe.load_merges())
    for _ in range(2):  # new words, then known ones
        got = _split(*enc.encode(TEXTS))
        assert got == [public.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_pieces_and_forgetting_change_nothing(monkeypatch):
    merges = bpe.load_merges()
    want = _split(*bpe.Encoder(merges).encode(TEXTS))
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 7)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 40)
    monkeypatch.setattr(bpe, "CACHED_LENGTH", 3)
    enc = bpe.Encoder(merges)
    assert [_split(*enc.encode([t]))[0] for t in TEXTS * 2] == want * 2


def test_corpus(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "a b", 0)] * 2, "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    want = _split(*bpe.Encoder(bpe.load_merges()).encode([*TEXTS, "a b"]))
    assert got == dict(zip([*range(len(TEXTS)), None], want)) and got[0] == got[1] == []
    assert bpe.encode_corpus(df).count() == len(TEXTS) + 2 and bpe.encode_corpus(df.where("false")).collect() == []


def test_memory_of_texts_without_blanks():
    code = """
import numpy as np, pyarrow as pa, resource
from spanforge.llm import bpe
rng = np.random.default_rng(0)
texts = ["".join(map(chr, rng.integers(0x4e00, 0x9fa5, 3000))) for _ in range(1000)]
enc = bpe.Encoder(bpe.load_merges())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["k", "t"])
n = sum(int(c.sum()) for _, _, c in bpe.encoded(iter([b]), enc))
assert n > 1_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(out.stdout) < 500 and resource
