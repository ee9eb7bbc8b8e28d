import zlib

import numpy as np
import pytest

from playmetrics.llm import pack_harmonic as ph
from playmetrics.llm.queries import op3_harmonic_packing


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tok.encode(text, add_special_tokens=False).ids


def check(docs, rows, capacity=1024):
    """Every id in exactly one piece, sequences gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs.items():
        ids, at = [], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            at += r["length"]
        want = reference_ids(text or "") + [0]
        assert ids == want and all(r["doc_tokens"] == len(want) for r in by_doc[doc])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    return len(by_seq) * capacity - sum(r["length"] for r in rows)


def test_ids_and_sequences(spark):
    docs = {1: "the cat sat <|endoftext|> on\n\nthe mat's mat", 2: None, 3: "", 4: "ñandú 𝔘 日本語 " * 400,
            5: "x" * 3000, 6: "a b c " * 2000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    check(docs, ph.pack(df).collect())


def test_corpus_padding(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    padding = check(docs, ph.pack(spark.read.parquet(f"{d}/documents.parquet")).collect())
    total = sum(r["length"] for r in op3_harmonic_packing(spark, d).collect())
    assert padding < 0.02 * total


def test_query_crc(spark):
    d = "/root/testdata/sf0.001"
    row = op3_harmonic_packing(spark, d).where("start = 0").first()
    text = spark.read.parquet(f"{d}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    ids = np.array(reference_ids(text) + [0], "<u4")[:row["length"]]
    assert row["ids_crc32"] == zlib.crc32(ids.tobytes())


@pytest.mark.parametrize("rest", [1, 31, 32, 341, 512, 513, 700, 1023])
def test_cuts_fill_their_class(rest):
    cuts = ph.cuts(rest, 1024, 32)
    assert sum(n for _, n in cuts) == rest
    for k, n in cuts:
        assert 1024 / (k + 1) < n <= 1024 / k and 1024 - k * n < max(k, 32)


def test_odd_rows(spark):
    rows = [(None, "a b"), (7, "a b"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS length")
    got = ph.pack(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "None"]
    assert ph.pack(df.where("false")).count() == 0
