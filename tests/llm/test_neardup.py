import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import neardup as N


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, doc = [], 0

    def add(words):
        nonlocal doc
        rows.append((doc * 7 % 1009, " ".join(words)))
        doc += 1

    base = [r.choice(vocab) for _ in range(150)]
    for _ in range(40):  # near copies of one text, few similar to each other
        w = list(base)
        for p in r.sample(range(150), r.randint(1, 9)):
            w[p] = r.choice(vocab)
        add(w)
    chain = [r.choice(vocab) for _ in range(200)]
    for k in range(12):  # a chain: only neighbours are similar
        add(chain[k * 6 : k * 6 + 120])
    for _ in range(30):
        add(r.choice(vocab) for _ in range(r.randint(3, 120)))
    passage = [r.choice(vocab) for _ in range(40)]
    for _ in range(15):
        add(passage + [r.choice(vocab) for _ in range(60)])
    for _ in range(25):
        add(["Same", "text", "as", "ever"])
    for t in ["", "one", "one two", "ONE  two", "a b c", None, None]:
        rows.append((2000 + len(rows), t))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 10 if k == 3 else 200_000)
    rows = corpus()
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, component int")
    got = {r.doc_id: (r.n_shingles, r.component) for r in N.clusters(docs, N.Near(words=k, percent=percent)).select("row.doc_id", "n_shingles", F.col("component")).collect()}
    assert got == brute(rows, k, percent)
    kept = N.deduplicate(docs, N.Near(words=k, percent=percent))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (n, c) in got.items() if d == c or not n)


def test_hub_rounds_change_nothing(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.id: r.component for r in N.clusters(docs, N.Near(words=3, percent=85, rounds=k)).collect()} for k in (1, 3))
    assert a == b


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "the same seven words in each row"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (None, ""), (None, None), (8, text + " x")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in N.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, text), (8, text + " x"), (None, ""), (None, None)], key=str)
    assert N.deduplicate(docs.limit(0)).count() == 0


def test_estimate_is_unbiased():
    near, rng = N.Near(words=3, percent=85), np.random.default_rng(4)
    hasher, errors = N.Hasher(near, near.hashes, near.rows), []
    for _ in range(60):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        sig = hasher.signatures(np.stack([hasher.minima(x[:900]), hasher.minima(x[50:])])).view(np.uint64).reshape(2, near.bits, -1)
        unequal = np.bitwise_count(np.bitwise_or.reduce(sig[0] ^ sig[1], axis=0)).sum()
        equal, chance = 1 - unequal / near.hashes, 2.0**-near.bits
        errors.append((equal - chance) / (1 - chance) - 0.85)
    assert abs(np.mean(errors)) < 0.012 and max(map(abs, errors)) < 0.15


def test_bits_of_single_shingles_agree_by_chance_only():
    near = N.Near(words=3, percent=85)
    hasher, rng, shares = N.Hasher(near, near.last_hashes, near.last_rows), np.random.default_rng(5), []
    for _ in range(100):
        x = rng.integers(0, 2**63, 2, dtype=np.uint64)
        sig = hasher.signatures(np.stack([hasher.minima(x[:1]), hasher.minima(x[1:])])).view(np.uint64).reshape(2, near.bits, -1)
        shares.append(1 - np.bitwise_count(np.bitwise_or.reduce(sig[0] ^ sig[1], axis=0)).sum() / near.last_hashes)
    assert 0.04 < np.mean(shares) < 0.09 and max(shares) < 0.3


def test_pairs_just_above_the_threshold_are_found(spark):
    """Recall on 400 planted pairs with 85 to 90 % of the union in common."""
    r, rows = random.Random(6), []
    for k in range(400):
        words = [f"p{k}x{r.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        cut = r.randrange(32, 46)  # n - 2 shingles each, cut of them lost at one end and replaced
        other[-cut // 2 :] = [f"q{k}x{j}" for j in range(len(other[-cut // 2 :]))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    near = N.Near(words=3, percent=85)
    want = [k for k in range(400) for a, b in [[shingles(t, 3) for _, t in rows[2 * k : 2 * k + 2]]] if 100 * len(a & b) >= 85 * len(a | b)]
    got = {x.id: x.component for x in N.clusters(spark.createDataFrame(rows, "doc_id long, text string"), near).collect()}
    assert len(want) > 150 and [k for k in want if got[2 * k + 1] != 2 * k] == []
