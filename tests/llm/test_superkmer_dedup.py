import random
import re

import pytest

from playmetrics.llm import superkmer_dedup as sd


def brute(docs, width):
    """docs: [(id, text)] -> [(id, n_words, n_removed, kept)]"""
    split = [(-1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), (key, w) in zip(docs, split):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < key:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def run(df, **how):
    return sorted((tuple(r) for r in sd.remove_repeats(df, **how).collect()), key=str)


@pytest.mark.parametrize("chunk_words", [50, 10_000])
def test_random_documents(spark, chunk_words):
    rng = random.Random(chunk_words)
    vocabulary = ["ab", "cd", "É", "x" * 40, "AB"]
    docs = [(rng.randrange(60), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))))
            for _ in range(60)]
    docs += [(100 + i, "one long line that every page repeats at its foot " * 3) for i in range(40)]
    docs += [(None, docs[5][1]), (None, "one long line that every page repeats"), (7, None), (8, "\x1c\x85 a")]
    docs += docs[:10]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS bucket", "'x' AS h").repartition(3)
    got = run(df, width=5, gram=2, buckets=7, chunk_words=chunk_words)
    assert got == brute(docs, 5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run(df) == []


def test_hash_collisions_are_resolved():
    import numpy as np
    ids = np.array([0, 1, 0, 2, 0, 1, 0, 2], np.int32)  # windows of 2: (0,1) (0,2) (0,1) (0,2)
    at, docs = np.array([0, 2, 4, 6]), np.array([1, 1, 2, 3])
    same = np.zeros(4, np.uint64)  # all hashes collide
    assert sd.repeated(ids, at, docs, same, 2).tolist() == [False, False, True, True]


def hot_documents(rng, n):
    """Three in ten share a passage, each with words of its own around it."""
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(9)]
    docs = []
    for i in range(n):
        own = [word() for _ in range(24)]
        docs.append((i, " ".join(own[:12] + passage * (i % 10 < 3) + own[12:])))
    docs += [(n + i, docs[3 * i][1]) for i in range(20)]  # copies, some of hot documents
    return docs


@pytest.mark.parametrize("sample", [1, 4])
def test_hot_minimiser_is_split(spark, monkeypatch, sample):
    monkeypatch.setattr(sd, "HOT", 60)
    monkeypatch.setattr(sd, "SAMPLE", sample)
    monkeypatch.setattr(sd, "BUCKET_WINDOWS", 100)
    rng = random.Random(9)
    docs = hot_documents(rng, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert run(df, chunk_words=700) == brute(docs, 13)
    # the windows that one group holds
    rows = df.selectExpr("doc_id AS id", "xxhash64(text) AS h", "cast(text AS binary) AS text")

    def largest(to):
        sent = rows.mapInArrow(sd._super_kmers(13, 4, to, 700), "bucket int, kind byte, payload binary")
        held = {}
        for r in sent.where("kind = 0").collect():
            held[r["bucket"]] = held.get(r["bucket"], 0) + int(sd.unpacked(r["payload"])[2][3].sum())
        return max(held.values()), sum(held.values())

    to = sd._sized(rows, 13, 4, None, 700)
    assert len(to.keys) and to.buckets > 32
    (hot, total), (split, same) = largest(sd.Minimisers({}, to.buckets)), largest(to)
    assert total == same and split < 300 < hot  # a hot minimiser alone had more


def test_windows_of_a_hot_minimiser_meet():
    import numpy as np
    to = sd.Minimisers({-5: 7, 12: 3}, 1000)
    least = np.array([-5, 12, 3, -5], np.int64).view(np.uint64)
    which = to.hot(least)
    assert (which >= 0).tolist() == [True, True, False, True] and which[0] == which[3]
    hashes = np.arange(5000).astype(np.uint64)
    dealt = to.dealt(np.full(5000, least[0]), np.full(5000, which[0]), hashes)
    assert len(set(dealt.tolist())) == 7 and (dealt == to.dealt(
        np.full(5000, least[0]), np.full(5000, which[0]), hashes)).all()
    assert (sd.Minimisers({}, 9).hot(least) == -1).all()


def test_very_long_text(spark):
    line = " ".join(f"w{i}" for i in range(500))
    docs = [(1, " ".join(f"v{i % 70_000}" for i in range(300_000))), (2, line), (3, line + " tail"), (4, "w " * 100_000)]
    got = {r[0]: r for r in run(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert got[1][1:3] == (300_000, 0) and got[2][2] == 0 and got[3][1:] == (501, 500, "tail")
    assert got[4][1:3] == (100_000, 0)  # its own repeats stay
