import ast
import random
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from fixtures import ROWS, docs
from tokenizers import Tokenizer

from tidemill.llm import bpe, lengths, rans, tokens


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text(plain):
    e = bpe.Encoder(bpe.vocabulary_path())
    r = random.Random(1)
    parts = ["a", "bc", "é", "ß", "1", "23", ".", ",", "'s", "'", "n't", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\x85", "\x1c", "\r\n", "<|endoftext|>", "日本", "😀", "é", "_", "-", "²", "Ⅷ", "​", "﻿"]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(e([s])[0], np.uint16).tolist() == plain(s), repr(s)


def test_encoder_forgets_and_goes_on(plain, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    e = bpe.Encoder(bpe.vocabulary_path())
    for k in range(6):
        texts = [f"some words{j} and more{k % 2}, here" for j in range(4)]
        for _ in range(3):
            assert [np.frombuffer(x, np.uint16).tolist() for x in e(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65535, 65536, 65537, 150_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50256).astype(np.uint16)
    freqs = rans.shared_table(np.bincount(ids, minlength=50257))
    assert freqs.sum() == 1 << 20 and freqs.min() >= 1
    c = rans.Coder(freqs)
    block = c.encode(ids)
    assert (c.decode(block) == ids).all()
    if n > 65536:
        assert (c.decode(block, range(1, 2)) == ids[65536:131072]).all()
    with pytest.raises(rans.Corrupt):
        c.decode(block[:-1] if n else block[1:])
    if n > 300:
        broken = bytearray(block)
        broken[-9] ^= 4
        with pytest.raises(rans.Corrupt):
            c.decode(bytes(broken))


def test_one_symbol_and_many_segments():
    c = rans.Coder(rans.shared_table(np.eye(1, 300, 7, dtype=np.int64)[0] * 10**9))
    ids = np.full(20 * rans.SEGMENT + 5, 7, np.uint16)
    assert (c.decode(c.encode(ids)) == ids).all()


def test_token_index_against_plain_encoding(spark, plain):
    want = sorted(((i, [*plain(t), 2]) for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted((tuple(r) for r in tokens.token_index(docs(spark, clash=True)).collect()), key=lambda r: r[1])
    at, out = 0, []
    for i, ids in want:
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == out
    assert tokens.token_index(docs(spark, [])).count() == 0


END = "<|endoftext|>"
ENDS = [END, f"hello {END} world", f"hello{END}world", f"a {END}", f"{END} b", f" {END}  {END}{END}\n{END}", f"x  {END} y", f"{END}s and '{END}'", "<|endof text|>", f"{END[:-1]}", "words " * 20_000 + END + " more " * 20_000]


def test_added_tokens_are_found_as_the_library_finds_them(plain):
    e = bpe.Encoder(bpe.vocabulary_path())
    assert plain(f"hello {END} world")[2] == 50256
    for _ in range(2):
        assert [np.frombuffer(x, np.uint16).tolist() for x in e(ENDS)] == [plain(t) for t in ENDS]


def test_other_vocabularies_are_given_whole_texts():
    path = bpe.vocabulary_path("word_bpe_49k.json")
    e, t = bpe.Encoder(path), Tokenizer.from_file(path)
    assert not e.by_words and bpe.Encoder(bpe.vocabulary_path()).by_words
    texts = ["Some  Words\nhere", "", "été <|endoftext|> x", "a b c"]
    assert [np.frombuffer(x, np.uint16).tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_blocks_hold_whole_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    path = str(tmp_path / "tokens")
    tokens.store_tokens(docs(spark), path)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.read_blocks(spark, path).collect()}[8] > 40_000
    assert spark.read.parquet(f"{path}/blocks").count() > 4


def test_files_are_read_from_their_path_alone(spark, plain, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.token_index(docs(spark), path)
    code = (
        "import sys; from pyspark.sql import SparkSession; from tidemill.llm import tokens\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', [(r.doc_id, list(r.ids)) for r in tokens.read_ids(s, sys.argv[1]).orderBy('start').collect() if len(r.ids) < 50])"
    )
    out = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    got = ast.literal_eval(out.stdout.partition("ROWS ")[2])
    want = [(i, [*plain(t), 2]) for i, t, *_ in ROWS]
    assert sorted(got, key=str) == sorted((x for x in want if len(x[1]) < 50), key=str)


def test_wrong_tables_are_told(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tokens.store_tokens(docs(spark), a)
    tokens.write_table(spark, rans.shared_table(np.ones(50257, np.int64)), b)
    shutil.copytree(f"{a}/blocks", f"{b}/blocks")
    with pytest.raises(Exception, match="another frequency table"):
        tokens.read_blocks(spark, b).collect()


def test_one_id_holds_many_rows(spark, monkeypatch):
    rows = [(None, "the same text", "en", "a", 1)] * 300 + [(1, f"text {i % 7}", "en", "a", 1) for i in range(200)] + [(i, "x", "en", "a", 1) for i in range(2, 30)]
    got = sorted(tuple(r) for r in tokens.token_index(docs(spark, rows).repartition(6)).select("start", "n_tokens", "doc_id").collect())
    assert [x[0] for x in got] == np.cumsum([0, *(x[1] for x in got[:-1])]).tolist()
    assert [x[2] for x in got] == [None] * 300 + [1] * 200 + list(range(2, 30))


def test_length_sums(spark, plain):
    n = [len(plain(t)) for _, t, *_ in ROWS]
    sums = lengths.suffix_sums(lengths.length_histogram(lengths.encoded_lengths(docs(spark, clash=True)))).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert r["n_docs"] == n.count(k) and r["docs_at_least"] == sum(x >= k for x in n) and r["docs_at_most"] == sum(x <= k for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= k) and r["truncated_total"] == sum(min(x, k) for x in n)
        assert r["total_docs"] == len(n) and r["total_tokens"] == sum(n)
    for limit in (0, 1, 7, 1000, 5000, 10**9):
        r = lengths.truncated_total(sums, limit).head()
        assert (r["truncated_total"], r["docs_cut"]) == (sum(min(x, limit) for x in n), sum(x > limit for x in n))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert lengths.quantile(sums, q).head()["n_tokens"] == sorted(n)[int(np.ceil(q * len(n) - 1e-9)) - 1]
    assert lengths.suffix_sums(lengths.length_histogram(lengths.encoded_lengths(docs(spark, [])))).count() == 0
