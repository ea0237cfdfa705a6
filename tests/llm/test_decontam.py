import random

import pytest
from pyspark.sql import functions as F

from stratum.llm import decontam

R = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(n, r=R):
    return [r.choice(WORDS) for _ in range(n)]


ITEMS = [prose(n) for n in (14, 20, 59, 33, 8, 5, 4)]


def changed(words, every):
    return [w if (i + 1) % every else "XYZ" for i, w in enumerate(words)]


def corpus():
    rows = [(i, " ".join(prose(60 + i))) for i in range(40)]
    leaked = {}
    for k, item in enumerate(ITEMS[:5]):
        leaked[100 + k] = k
        rows.append((100 + k, " ".join(prose(20) + item + prose(20)).title()))
    leaked[110] = 2
    rows.append((110, " ".join(prose(9) + changed(ITEMS[2], 5) + prose(9))))
    leaked[111] = 1
    rows.append((111, "\t".join(changed(ITEMS[1], 7))))
    leaked[112] = 3
    rows.append((112, " ".join(prose(5) + ITEMS[3][10:30])))
    rows += [(120, " ".join(prose(9) + changed(ITEMS[2], 3) + prose(9))), (121, None), (122, ""), (123, "one two"), (124, " ".join(ITEMS[6] + prose(9))), (125, " ".join(prose(3) + ITEMS[5])), (126, " ".join(prose(9) + ITEMS[5][:4]))]
    leaked |= {124: 6, 125: 5}
    rows += [(100, rows[40][1]), (None, rows[40][1])]
    return rows, leaked | {None: 0}


@pytest.mark.parametrize("bound", [100_000, 1])
def test_leaks_by_either_join(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_POSTINGS", bound)
    monkeypatch.setattr(decontam, "BROADCAST_TEXTS", bound)
    rows, leaked = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit(1)).withColumn("tokens", F.lit("mine"))
    bench = spark.createDataFrame(list(enumerate(map(" ".join, ITEMS))) + [(90, None), (91, "")], "item_id long, text string").withColumn("item", F.lit(0))
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).select("row.doc_id", "item_id").collect()}
    assert found == set(leaked.items())
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in leaked)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).count() == 1
    assert decontam.decontaminate(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def passes(item, words, least=13, share=0.8):
    """Whether some segment counts, by trying all of them."""
    e, least = [a == b for a, b in zip(item, words)], min(least, len(item))
    return any(sum(e[i:j]) * 100 >= round(share * 100) * (j - i) for i in range(len(e)) for j in range(i + least, len(e) + 1))


def seeded(item, words):
    runs = [(m, i) for m in decontam.Seeds().masks for i in range(len(item) - len(m) + 1)]
    return any(all(item[i + k] == words[i + k] for k, c in enumerate(m) if c == "1") for m, i in runs)


@pytest.mark.parametrize("bound", [100_000, 1])
def test_substitutions_near_the_ends(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_POSTINGS", bound)
    r = random.Random(11)
    items, rows, wanted = [], [], set()
    for n, subs in [(7, 1), (13, 2), (13, 3), (14, 2), (16, 1), (16, 2), (16, 3), (18, 3), (20, 4), (25, 5), (30, 6), (40, 15)]:
        for _ in range(8):
            item = [f"{w}{len(items)}" for w in prose(n, r)]
            words = list(item)
            for i in r.sample(range(n), subs):
                words[i] = "other"
            if passes(item, words) and seeded(item, words):
                wanted.add(len(items))
            rows.append((len(items), " ".join(prose(r.randrange(9), r) + words + prose(r.randrange(9), r))))
            items.append((len(items), " ".join(item)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(docs, bench).collect()
    assert {r.row.doc_id for r in found} == wanted and len(wanted) > 40
    assert all(r.row.doc_id == r.item_id and r.n_equal == round(r.similarity * r.n_words) and r.similarity >= 0.8 and r.n_words >= min(13, len(items[r.item_id][1].split())) for r in found)


@pytest.mark.parametrize("bound", [100_000, 1])
def test_items_without_id(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_POSTINGS", bound)
    docs = spark.createDataFrame([(k, " ".join(prose(9) + item)) for k, item in enumerate(ITEMS[:3])] + [(9, " ".join(prose(40)))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(ITEMS[0])), (None, " ".join(ITEMS[1])), (7, " ".join(ITEMS[2]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).select("row.doc_id", "item_id").collect()}
    assert found == {(0, None), (1, None), (2, 7)}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [9]


def every_diagonal(rows, items, seeds=decontam.Seeds()):
    """Pairs of texts and items that overlap enough at some diagonal, seeds or no seeds."""
    found = set()
    for d, t in rows:
        words = (t or "").lower().split()
        for i, x in items:
            item = x.split()
            if len(item) < seeds.shortest:
                continue
            for diagonal in range(1 - len(item), len(words)):
                part = [words[diagonal + k] if 0 <= diagonal + k < len(words) else None for k in range(len(item))]
                # Items too short for a mask count whole only.
                if sum(a == b for a, b in zip(item, part)) >= 2 and passes(item, part, seeds.least_words, seeds.similarity if len(item) >= 6 else 1.0):
                    found.add((d, i))
                    break
    return found


def test_recall_against_all_diagonals(spark):
    """Everything found is an overlap; of all overlaps nearly all are found, all of those with one word in ten substituted or fewer."""
    r, items, rows, light = random.Random(23), [], [], set()
    for n in (3, 5, 6, 9, 13, 17, 24, 40):
        for subs in (0, 1, 2, n // 10, n // 6, n // 5):
            for _ in range(3):
                item = prose(n, r)
                words = list(item)
                for i in r.sample(range(n), min(subs, n)):
                    words[i] = "other"
                if subs * 10 <= n:
                    light.add((len(items), len(items)))
                rows.append((len(items), " ".join(prose(r.randrange(12), r) + words + prose(r.randrange(12), r))))
                items.append((len(items), " ".join(item)))
    want = every_diagonal(rows, items)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x.row.doc_id, x.item_id) for x in decontam.leaks(docs, bench).collect()}
    assert found <= want and light <= found
    assert len(found) >= 0.9 * len(want) and len(want) > 90, (len(found), len(want))
