import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratum.llm import lm
from stratum.llm.shingles import words_of
from stratum.scratch import Scratch

SMALL = lm.Shape(symbols=32, classes=12, frequent=40, dim=8, noise=16, batch=256)


def corpus(n=400):
    r = random.Random(9)
    a, b = [f"ka{i}" for i in range(60)], [f"Zo{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(r.randint(1, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "never seen ÄÖ words"), (n + 3, "ka1 " * 20_000), (None, "ka1 KA1"), (5, rows[5][1])]


@pytest.fixture(scope="module")
def result(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, rid int")
    scratch = Scratch(spark, "lm-test")
    train = docs.where(~lm.held_out(docs.doc_id))
    model = lm.train(train, scratch, SMALL)
    got = lm.score(docs, model, scratch, keep=["doc_id", "text", "rid"]).collect()
    return rows, model, got


def is_held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def test_counts_and_base_equal_brute_force(result):
    rows, model, got = result
    count = Counter(w for d, t in rows if not is_held_out(d) for w in [*words_of(t), b"\n"])
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (n, v)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*words_of(r.row.text), b"\n"]
        assert r.n_tokens == len(tokens) and r.n_known == sum(count[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))


def test_score_equals_the_model_word_by_word(result):
    rows, model, got = result
    table, lexicon = model.log_table(), model.lexicon()
    count = Counter(w for d, t in rows if not is_held_out(d) for w in words_of(t))
    first = 2 + SMALL.listed
    for r in got:
        words = words_of(r.row.text)
        s = [lm.START, lm.START, *[int(lexicon.read([w.decode()])[0][0]) for w in words[:200]]]
        if len(words) > 200:
            s += [s[2]] * (len(words) - 200)  # one word again and again
        total = 0.0
        for i, w in enumerate([*words, None]):
            now = lm.END if w is None else s[i + 2]
            total += float(table[s[i] * SMALL.symbols + s[i + 1], now])
            if now >= first:
                c = now - first
                total += math.log10((count[w] + 1) / (model.class_tokens[c] + model.class_distinct[c] + 1))
        assert r.score == pytest.approx(total, rel=1e-5, abs=1e-4)


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [None, "", " a\tB\x0bc  ", "longer Words é😀 a", "a" * 5000 + " b", "\n\r"]
    h, n = lm.hash_words(texts)
    words = [w for t in texts for w in words_of(t)]
    assert n.tolist() == [len(words_of(t)) for t in texts] and len(h) == len(words)
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x == lm.hash_words([w.decode()])[0][0]
    assert len(set(seen.values())) == len(seen)


def test_probabilities_sum_to_one(result):
    _, model, _ = result
    assert np.allclose((10.0 ** model.log_table().astype(float)).sum(axis=1), 1, atol=1e-5)


def test_held_out_texts_score_better_than_the_base(result):
    _, _, got = result
    rows = [r for r in got if is_held_out(r.row.doc_id)]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 10


def test_no_training_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    scratch = Scratch(spark, "lm-none")
    model = lm.train(docs.limit(0), scratch, SMALL)
    got = lm.score(docs, model, scratch).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and all(r.n_known == 0 and r.score < 0 for r in got)
    assert lm.score(docs.limit(0), model, scratch).count() == 0


def test_every_trigram_enters_training():
    k = SMALL.symbols
    rare = np.array([s * k * k + 2 * k + 3 for s in range(4, k)])
    model = lm.Bilinear(SMALL, np.full(k, 1 / k))
    before = model.r.copy()
    model.train(np.append(rare, 3 * k * k + 2 * k + 3), np.append(np.ones(len(rare), np.int64), 10**7), 1, 0.02)
    assert (model.r != before).any(axis=1)[4:].all() and np.isfinite(model.r).all()


@pytest.fixture(scope="module")
def shares(spark):
    """Scores of one corpus, dealt to 4, 7 and 211 partitions, with several shards."""
    rows, out = [x for x in corpus(120) if x[1] is None or len(x[1]) < 10_000], []
    before = lm.SHARD_ROWS, spark.conf.get("spark.sql.shuffle.partitions")
    lm.SHARD_ROWS = 500
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k long, doc_id long, text string")
    for n in (4, 7, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        scratch = Scratch(spark, f"lm-{n}")
        model = lm.train(docs.where(~lm.held_out(docs.doc_id)).repartition(min(n, 16)), scratch, SMALL)
        out.append({r.row.k: (r.score, r.base_score) for r in lm.score(docs, model, scratch, keep=["k"]).collect()})
    lm.SHARD_ROWS = before[0]
    spark.conf.set("spark.sql.shuffle.partitions", before[1])
    return out


def test_scores_do_not_depend_on_partitions(shares):
    a, *others = shares
    for b in others:
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_symbols_grow_with_the_corpus():
    grown = [lm.Shape().grown(10**k).symbols for k in range(13)]
    assert grown == sorted(grown) and grown[0] == 256 and grown[7] == 256 and grown[8] == 1024 and grown[-1] == 4096
    assert lm.Shape().grown(10**10).listed == 2558 and SMALL.grown(10**9) == SMALL
