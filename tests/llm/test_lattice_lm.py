import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from playmetrics.llm import lattice_lm as lm
from playmetrics.llm.queries import op8_lattice_likelihood


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces()


def segmentations(text, known):
    """All ways to cut ``text`` into known pieces or single characters as bytes."""
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        options = ([known[text[:k]]] if text[:k] in known else []) + (
            [-len(text[0].encode())] if k == 1 else [])
        for first in options:
            for rest in segmentations(text[k:], known):
                yield [first, *rest]


@pytest.mark.parametrize("word", ["a", "the", "thereof", "ñandú", "𝔘x", "zzqx"])
def test_lattice_sums_all_segmentations(pieces, word):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    weights = pieces.weights(pieces.first)
    total, expected = 0.0, Counter()
    for s in segmentations(lm.MARK + word, known):
        p = math.exp(sum(weights[i] if i >= 0 else -i * math.log(lm.BYTE_SHARE / 256) for i in s))
        total += p
        for i in s:
            if i >= 0:
                expected[i] += p
    logs, counts = lm.words_lattice([word.encode(), b"b"], pieces, weights, np.array([3.0, 0.0]))
    assert logs[0] == pytest.approx(math.log(total))
    for i, p in expected.items():
        assert counts[i] == pytest.approx(3 * p / total)
    assert counts.sum() == pytest.approx(3 * sum(expected.values()) / total)


def test_query_base(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    c[None] = sum(not h for h in held.values())
    n, v = sum(c.values()), len(c)
    for r in op8_lattice_likelihood(spark, d).collect():
        words = [*docs[r["doc_id"]], None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[r["doc_id"]], len(words), sum(c[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0


def test_counts_make_held_out_text_likelier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    per_token = []
    for rounds in (0, 1):
        r = lm.score_documents(docs, rounds=rounds).where("held_out").selectExpr(
            "sum(score) / sum(n_tokens) AS x").first()
        per_token.append(r["x"])
    assert per_token[1] > per_token[0] + 1


def test_chunks_and_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A b"), (3, "A b"), (4, "x" * 5000 + " \x85 a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS body")
    one = sorted(map(str, lm.score_documents(df, chunk_words=1, buckets=3).collect()))
    assert one == sorted(map(str, lm.score_documents(df, buckets=1).collect()))
    assert len(one) == 6 and sum("doc_id=None" in x for x in one) == 1
    assert lm.score_documents(df.where("false")).count() == 0


def test_long_words_equal_short_ones(pieces, monkeypatch):
    """The recursion position by position gives what the one over many words gives."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh theñ中𝔘"), 150)).replace(" ", "") for _ in range(6)]
    words = [*(t.encode() for t in texts), b"the" * 60, b"a"]
    weights, counts = pieces.weights(pieces.first), np.arange(1.0, 9.0)
    want, expected = lm.words_lattice(words, pieces, weights, counts)
    monkeypatch.setattr(lm, "LONG", 20)
    for block in (7, 1000):
        monkeypatch.setattr(lm, "BLOCK", block)
        got, more = lm.words_lattice(words, pieces, weights, counts)
        assert got == pytest.approx(want, rel=1e-12) and more == pytest.approx(expected, rel=1e-9, abs=1e-12)
        assert lm.words_lattice(words, pieces, weights)[0] == pytest.approx(want, rel=1e-12)


def test_a_word_of_a_million_characters(pieces):
    import time
    rng = np.random.default_rng(3)
    word = bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000).tolist())
    weights = pieces.weights(pieces.first)
    began = time.process_time()
    logs, _ = lm.words_lattice([word], pieces, weights)
    assert time.process_time() - began < 30
    half = [lm.words_lattice([w], pieces, weights)[0][0] for w in (word[:1000], word)]
    assert logs[0] == half[1] and half[1] == pytest.approx(1000 * half[0], rel=0.05)


def test_buckets_follow_the_text(spark, monkeypatch):
    """The same scores from many small buckets."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r for r in lm.score_documents(d, rounds=1).collect()}
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4000)
    got = lm.score_documents(d, rounds=1, chunk_words=5000).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["n_known"] == want[r["doc_id"]]["n_known"]
        assert r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-6)
