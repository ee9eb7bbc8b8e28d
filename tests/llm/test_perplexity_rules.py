import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from playmetrics.llm import perplexity_rules as pr
from playmetrics.llm.queries import op2_perplexity_bands


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {i + j for i in range(len(words) - 7) if c[tuple(words[i:i + 8])] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(cover))


def test_text_rules_against_brute_force():
    rng = random.Random(4)
    for n in [0, 5, 8, 9, 20, 60, 200]:
        for kinds in (2, 4, 60):
            text = "".join(rng.choice(["a", "bc", "É#", "|", "x&"][:kinds]) * (rng.random() < .9)
                           + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
            assert pr.text_rules(text.encode()) == brute_rules(text)


def test_query_rules(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op2_perplexity_bands(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_rules(docs[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def brute_model(texts):
    """Interpolated modified Kneser-Ney in plain dictionaries, for one language."""
    keys = np.concatenate([pr.grams([pr.codes(t)])[0] for t in texts]).tolist()
    level = {4: Counter(keys)}
    for k in (3, 2, 1):
        level[k] = Counter(x & ((1 << 12 * k) - 1) for x in level[k + 1])
    p_of = {}
    for k in (1, 2, 3, 4):
        n = Counter(level[k].values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [0] + [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        else:
            d = [0, 0.5, 1.0, 1.5]
        total, down = Counter(), defaultdict(float)
        for x, c in level[k].items():
            total[x >> 12] += c
            down[x >> 12] += d[min(c, 3)]
        p_of[k] = (level[k], total, down, d)

    def p(key):
        out = 1 / (len(level[1]) + 1)
        for k in (1, 2, 3, 4):
            x = key & ((1 << 12 * k) - 1)
            counts, total, down, d = p_of[k]
            if x >> 12 in total:
                c = counts.get(x, 0)
                out = (c - d[min(c, 3)]) / total[x >> 12] + down[x >> 12] / total[x >> 12] * out
        return out
    return p, keys


def test_model_against_brute_force(spark):
    texts = [r["text"].encode() for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    p, keys = brute_model(texts)
    df = spark.createDataFrame([("x", bytearray(t)) for t in texts], "lang string, text binary")
    counts = df.mapInArrow(pr._count, "lang string, key long, n long").groupBy("lang", "key").sum("n")
    model = pr.kneser_ney(counts.toDF("lang", "key", "n")).collect()
    assert {(r["key"], r["n"]) for r in model} == set(Counter(keys).items())
    for r in model:
        assert r["log"] == pytest.approx(math.log(p(r["key"])), rel=1e-12)
    # every context's shares sum to one
    ctx = keys[50] >> 12
    alphabet = {k & 4095 for k in keys}
    assert sum(p((ctx << 12) | c) for c in alphabet) == pytest.approx(1, abs=1 / len(alphabet))


def test_arrays_hold_the_most_frequent(spark):
    df = spark.range(5000).selectExpr("concat('l', id % 3) AS lang", "id AS key", "id + 1 AS n", "-0.5D - id AS log")
    for most, least in ((10_000, 1), (5000, 1), (4999, 2), (1000, 4096), (10, None)):
        arrays, complete = pr.frequent_arrays(df, most)
        held = sorted(k for keys, _ in arrays.values() for k in keys.tolist())
        assert held == ([] if least is None else list(range(least - 1, 5000))) and complete == (most >= 5000)
        for lang, (keys, logs) in arrays.items():
            assert (np.diff(keys) > 0).all() and (logs == -0.5 - keys).all()
    got = pr.look(arrays | {"x": (np.array([3, 9]), np.array([0.1, 0.2]))}, "x", np.array([2, 3, 9, 10]))
    assert got[[1, 2]].tolist() == [0.1, 0.2] and np.isnan(got[[0, 3]]).all()
    assert np.isnan(pr.look({}, "x", np.array([1]))).all()


def quartile_band(values):
    """Of Spark's percentile_approx at full accuracy: the value at rank ceil(share * n)."""
    x = sorted(values)
    return [x[max(0, math.ceil(q * len(x)) - 1)] for q in (0.25, 0.75)]


@pytest.mark.parametrize("frequent", [pr.FREQUENT, 3000, 0])
def test_whole_result_against_brute_force(spark, frequent):
    """log_perplexity and kept of every document, however few 4-grams are broadcast."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, None, "en"), (-2, "", None), (-3, "tout seul " * 15, None), (-4, docs[0][1], docs[0][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = {r["doc_id"]: r for r in pr.judge(df, frequent=frequent).collect()}
    by_lang = defaultdict(list)
    for i, text, lang in docs:
        by_lang[lang].append((i, (text or "").encode()))
    for lang, rows in by_lang.items():
        full = [t for _, t in rows if len(pr.codes(t))]
        p, _ = brute_model(full) if full else (None, None)
        cache, value = {}, {}
        for i, t in rows:
            if len(pr.codes(t)):
                keys = pr.grams([pr.codes(t)])[0].tolist()
                for k in keys:
                    if k not in cache:
                        cache[k] = math.log(p(k))
                value[i] = -sum(cache[k] for k in keys) / len(keys)
        rules = {i: brute_rules(t.decode()) for i, t in rows}
        failed = {i: w < 20 or 100 * r > 30 * w for i, (w, _, _, _, r) in rules.items()}
        distinct = {t: value[i] for i, t in rows if not failed[i]}
        low, high = quartile_band(distinct.values()) if distinct else (0, 0)
        for i, _ in rows:
            if i not in value:
                assert got[i]["log_perplexity"] is None and not got[i]["kept"]
                continue
            assert got[i]["log_perplexity"] == pytest.approx(value[i], rel=1e-9)
            room = max(high - low, pr.FLOOR) * 5 * math.sqrt(1 + 50 / max(rules[i][0], 1))
            inside = low - room <= value[i] <= high + room
            assert got[i]["kept"] == (inside and not failed[i]), i


def test_band_rejects_both_sides(spark):
    rng = random.Random(0)
    base = ["".join(rng.choices("etaoinsh", k=rng.randint(2, 7))) for _ in range(400)]
    docs = [(i, " ".join(rng.choices(base, k=300)), "en") for i in range(60)]
    docs.append((98, " ".join("".join(rng.choices("QZXJKV0987", k=9)) for _ in range(60)), "en"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in pr.judge(df).collect()}
    assert not kept.pop(98) and all(kept.values())


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "a \x00 b", "xx"), (2, "a \x00 b", "xx"),
                                (3, long, None)], "doc_id long, text string, lang string"
                               ).selectExpr("*", "1 AS key", "2 AS n", "3 AS kept")
    got = pr.judge(df).collect()
    assert len(got) == 5
    assert [(r["doc_id"], r["kept"]) for r in got if r["kept"]] == [(3, True)]
    assert pr.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("copies", [26, 240])  # 30 % and 80 % of the rows are one text
def test_copies_do_not_move_the_band(spark, copies):
    rng = random.Random(1)
    letters = "abcdefghij"
    base = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(400)]
    docs = [(i, " ".join(rng.choices(base, k=300)), "en") for i in range(60)]
    copy = " ".join(rng.choices(base, k=300))
    shuffled = " ".join("".join(rng.choices(letters, k=6)) for _ in range(800))  # above the band
    easy = " ".join("t" * rng.randint(4, 44) for _ in range(120))  # below it
    docs += [(98, shuffled, "en"), (99, easy, "en"), *((1000 + i, copy, "en") for i in range(copies))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in pr.judge(df).collect()}
    assert not got[98]["base_failed"] and got[98]["log_perplexity"] > got[98]["high"]
    assert not got[99]["base_failed"] and got[99]["log_perplexity"] < got[99]["low"]
    assert all(got[i]["kept"] for i in range(60))


def test_band_has_a_floor(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got, = pr.judge(df).collect()
    assert got["kept"] and got["high"] - got["low"] >= 10 * pr.FLOOR
