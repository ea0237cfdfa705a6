from fractions import Fraction

from pyspark.sql import functions as F

from stratum.llm import mixing


def levels(sizes, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = Fraction(3 * sum(sizes.values()), 2), {}, set(order)
    while open_:
        rest, ws = total - sum(target.values()), sum(w[s] for s in open_)
        above = {s for s in open_ if rest * w[s] > 2 * sizes[s] * ws}
        if not above:
            return target | {s: rest * w[s] / ws for s in open_}
        target |= {s: Fraction(2 * sizes[s]) for s in above}
        open_ -= above
    return target


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string")


def rows():
    n = {"a": 3, "b": 200, "ä": 40, None: 25, "z": 1}
    return [(i * 10 + k, s, " ".join(["w"] * (1 + (i * 37 + k) % 50)) + "\n", "mine") for k, (s, m) in enumerate(n.items()) for i in range(m)] + [(9001, "a", None, None), (9002, "empty", "", None), (None, "b", "x y", None), (7, "b", "x y", None), (7, "b", "x y", None)]


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.allot(corpus(spark, data)).select("row.doc_id", F.col("row.source").alias("s"), "size", "source_size", "target", "taken").collect()
    sizes = {}
    for _, s, t, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = levels(sizes)
    assert len(got) == len(data)
    for s in sizes:
        mine = [r for r in got if r.s == s]
        assert all(r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == int(want[s])
        assert all(0 <= r.taken <= 2 * r.size for r in mine)


def test_mix_rows_hold_the_words_taken_and_reruns_agree(spark):
    docs = corpus(spark, rows())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    once, again = (sorted(map(str, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7)))
    assert once == again
    taken = mixing.allot(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken


def test_many_buckets_equal_one(spark, monkeypatch):
    docs = corpus(spark, rows())
    plain = sorted(map(str, mixing.allot(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.allot(docs).collect())) == plain


def test_empty(spark):
    assert mixing.mix_sources(corpus(spark, [])).count() == 0
    assert [r.taken for r in mixing.allot(corpus(spark, [(1, None, None, None)])).collect()] == [0]
