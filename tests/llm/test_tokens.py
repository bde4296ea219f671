import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recordlens.llm.elias_fano import EliasFano
from recordlens.llm.token_files import Shard, read_tokens, round_trip, write_shard
from recordlens.llm.tokens import Encoder, tokenizer_path

NAMES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
TEXTS = [
    None, "", " ", "\n", "a", "The the, THE### it's 'second don't x'll", "  two  spaces ", "line\nnext\n\nthird\t tab",
    "été ÉTÉ déjà.vu ñ ß ªx x²y 12345 1a2b", "<|endoftext|> a <|endoftext|>b c<|startoftext|>", "İstanbul Σίσυφος é",
    "a b c d", "(*&^ %$# @!", "x" * 3000, "'s 's", "\x01 \x02 x", "o'neill we're µm",
]


@pytest.mark.parametrize("name, spaces", NAMES)
def test_ids_equal_the_library(name, spaces):
    t = Tokenizer.from_file(tokenizer_path(name))
    enc = Encoder(tokenizer_path(name), spaces)
    rng = random.Random(3)
    pieces = ["the", "Él", "###", "×", "a×b", "÷", "x÷", "ª", "aªb", "µ", "·x", "é·", "ñ", "÷÷é", "Ã", "·", "ing,", "it's", "'d", "x1", "9", "ß", "a|b", "-", "don't!"]
    texts = TEXTS + ["".join(rng.choice(pieces) + rng.choice(" \n") for _ in range(40)).strip() for _ in range(200)]
    ids, counts = enc.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids, text
    ids, counts = enc.encode_ended(pa.array(["a", None]), 7)
    assert ids[-1] == 7 and counts[-1] == 1 and len(ids) == counts.sum()


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (700, 3), (5000, 10**9), (300, 300)):
        values = np.sort(rng.integers(0, top, n))
        code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
        assert code.all().tolist() == values.tolist()
        assert all(code.select(i) == values[i] for i in range(0, n, 7))
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    dense = np.arange(0, 10**6, 100)
    assert len(EliasFano.of(dense).to_bytes()) < 10**4 * 10 / 8 * 1.2


def test_shard_gives_single_documents():
    counts = np.array([3, 0, 2])
    s = Shard(write_shard(np.array([5, 9, 0]), np.array([True, True, False]), counts, np.arange(5, dtype=np.uint16)))
    assert s.document(0).tolist() == [0, 1, 2] and s.document(1).tolist() == [] and s.document(2).tolist() == [3, 4]
    assert s.doc_ids()[0][:2].tolist() == [5, 9] and s.doc_ids()[1].tolist() == [True, True, False]


def test_files_round_trip(spark):
    path = tokenizer_path(NAMES[0][0])
    t = Tokenizer.from_file(path)
    rows = [((i * 37) % 101, x, "start") for i, x in enumerate(TEXTS)] + [(4, "again", ""), (4, "again", ""), (None, "z", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = round_trip(df, path, 2).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    start = 0
    want = []
    for doc_id, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in got), key=lambda r: r[1]) == want
    assert zlib.crc32(want[0][2]) >= 0
    assert round_trip(df.limit(0), path, 2).count() == 0
