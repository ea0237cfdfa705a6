import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.llm import suffix as S


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_of_small_alphabets(text):
    assert S.suffix_array(text) == naive(text)


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 200, "abcabcabd" * 40, "".join(map(str, range(300))), "ba" * 100 + "a", "mississippi" * 9])
def test_suffix_array_of_long_patterns(text):
    assert S.suffix_array([ord(c) for c in text]) == naive(text)


def test_suffix_array_of_random_texts():
    r = random.Random(1)
    for sigma in (2, 5, 300):
        text = [r.randrange(sigma) for _ in range(3000)]
        assert S.suffix_array(text) == naive(text)


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = Counter(x[i : i + length] for x in raws for i in range(len(x) - length + 1))
    out = []
    for x in raws:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if n[x[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(x)]
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


SHORT = S.Repeats(length=24, gram=8)


def corpus(seed):
    r = random.Random(seed)
    words = ["an", "the", "of", "éü", "ing", "tion", "😀", "re"]
    text = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    base, passage = text(60), text(7)
    out = [base, base, None, "", "short", "a" * 90, "ab" * 60, "x" + "ab" * 14, passage]
    for _ in range(25):  # near copies
        w = base.split(" ")
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = r.choice(words) + r.choice(words)
        out.append(" ".join(w))
    out += [text(9) + passage + text(8) for _ in range(25)] + [text(40) for _ in range(10)]
    return out + [text(10) + passage[1:] + passage[:-2] + text(4)] + [base[:30], "tail " + base[-25:], base[3:27]]


@pytest.mark.parametrize(("seed", "mask", "weak"), [(1, 3, False), (2, 3, True), (3, 63, False), (4, 0, True)])
def test_kernel_equals_brute_force(monkeypatch, seed, mask, weak):
    """Also with window hashes of 3 bits, which are equal by chance all the time."""
    monkeypatch.setattr(S, "TOKEN_MASK", mask)
    texts = corpus(seed)
    regions, groups = {}, {}
    for i, t in enumerate(texts):
        for (g, rh), xs in S._regions(t, SHORT).items():
            regions.setdefault((g, rh), []).extend((i, x) for x in xs)
    for (g, rh), where in regions.items():
        i, x = where[0]
        raw = texts[i].encode()
        a = max(0, x - SHORT.reach)
        groups.setdefault(g, []).append((rh, x - a, raw[a : x + SHORT.length]))
    keys = list(groups)
    if weak:
        strong = S.gram_hashes
        monkeypatch.setattr(S, "gram_hashes", lambda data, gram: strong(data, gram) if gram < SHORT.length else strong(data, gram) & S.U(7))
    found = S.shared_by_regions([[(left, data) for _, left, data in groups[g]] for g in keys], SHORT)
    spans = {i: [] for i in range(len(texts))}
    for g, xs in zip(keys, found):
        for (rh, _, _), got in zip(groups[g], xs):
            if len(regions[g, rh]) > 1:
                got = (SHORT.reach, SHORT.length)
            if got:
                for i, x in regions[g, rh]:
                    spans[i].append({"a": max(0, x - got[0]), "b": x + got[1]})
    got = [(n, m, k, hashlib.sha256(rest).hexdigest()) for n, m, k, rest in (S._remove(t, spans[i]) for i, t in enumerate(texts))]
    assert got == brute(texts, SHORT.length)


@pytest.mark.parametrize("bound", [15_000, 3])
def test_spark_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "TASK_REGIONS", bound)
    monkeypatch.setattr(S, "BROADCAST_KEYS", bound)
    texts = corpus(7)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, SHORT).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == dict(enumerate(brute(texts, SHORT.length)))


def test_production_length_and_empty(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = text(399) + "é" + text(80)
    texts = [text(500) + p + text(50), text(30) + p, p[:399], "a" + text(100), text(20_000) + p[5:410]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(docs).orderBy(F.col("row.doc_id")).collect()]
    assert got == brute(texts, 400)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_join_of_a_region_in_very_many_texts_is_split(spark):
    """The join that brings intervals to texts reads both sides from a shuffle, so that adaptive execution can deal a common region to several tasks."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(40)
    texts = ["y" * 20 + passage * 2 + str(i) for i in range(6000)] + [x for x in (text(120) for _ in range(800)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "31",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = S.remove_repeats(docs, SHORT).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        runs = store.executionsList(known, 1000)
        plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [x[1:] for x in sorted(rows)] == brute(texts, SHORT.length)
    spans = [p for p in plans if "collect_set" in p and "Generate" in p]
    assert spans and all("skew=true" in p.split("Initial Plan")[0] for p in spans)
