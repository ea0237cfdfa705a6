import math
import re
from collections import Counter

from pyspark.sql import Row

from stratum.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


TEXTS = [None, "", " \n\t ", "one", "a b", "a b c a b c", "a a a a a a", "x\ny\nx\n\n \nx", "#a $b |<>&* é ü ß", "w " * 5000 + "end", "one two three four " * 3 + "five", "\x0b\x0cq\rq q\x1fq"]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", "mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words string")
    got = {r.i: [r[c] for c in quality.COUNTS] for r in quality.measure(docs).selectExpr("row.doc_id as i", "q.*").collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def prose(i, n=120):
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 9973}" for k in range(n))


def test_filter_keeps_prose_and_drops_junk(spark):
    good = [(i, prose(i), None if i % 3 else "en", None if i % 2 else "s", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in prose(i).split()), "en", "s", 0) for i in range(20)] + [(2000, "", "en", "s", 0), (2001, None, None, None, 0), (2002, "same words " * 100, "en", "s", 0)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, q int")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))


def test_empty_table_and_small_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.quality_filter(empty).count() == 0
    one = spark.createDataFrame([Row(doc_id=1, text=prose(1), lang="xx", source="y")] * 2)
    assert quality.quality_filter(one).count() == 2


def test_joined_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i), f"l{i % 5}", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 1)
    assert quality.quality_filter(docs).count() == 50


def rates(c, text):
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = max(c[0], 1)
    return [c[1] / n, c[2] / n, c[3] / max(len(lines), 1), c[4] / n]


def verdicts(rows, rules):
    """kept of (text, lang, source) rows, by sorted bucket values in place of sketches."""
    counts = [brute(t) for t, _, _ in rows]
    failed = [c[0] < rules.min_words or 100 * c[4] > rules.max_repeat * c[0] for c in counts]
    each = [rates(c, t) for c, (t, _, _) in zip(counts, rows)]
    middle = lambda x: math.exp(math.ceil(math.log(x) / rules.log_base) * rules.log_base) * (1 - rules.accuracy) if x > 0 else 0.0

    def fence(members):
        out = []
        for k, (_, least) in enumerate(rules.least):
            v = sorted(middle(each[i][k]) for i in members)
            q1, q3 = v[math.floor(0.25 * (len(v) - 1))], v[math.floor(0.75 * (len(v) - 1))]
            width = rules.spread * max(q3 - q1, least)
            out.append((q1 - width if k == 0 else -1, q3 + width))
        return out

    good, out = [i for i in range(len(rows)) if not failed[i]], []
    for i, (_, lang, source) in enumerate(rows):
        levels = [[j for j in good if rows[j][1:] == (lang, source)], [j for j in good if rows[j][1] == lang], good]
        members = next((m for m in levels[:2] if len(m) >= rules.min_group), good)
        out.append(not failed[i] and all(lo <= x <= hi for x, (lo, hi) in zip(each[i], fence(members))))
    return out


def test_verdicts_equal_brute_force(spark):
    rules = quality.Rules(min_group=25, spread=2.0)
    rows = []
    for i in range(160):
        text = prose(i, 60 + i % 17) + (" #" * (i % 23 if i % 4 == 0 else 0)) + ("\nsame line" * (i % 9 if i % 5 == 0 else 0)) + (" longestwords" * (i % 31 if i % 7 == 0 else 0))
        rows.append((text, ["en", "de", None, "fr"][i % 4 if i % 11 else 3], ["a", "b", None][i % 3]))
    rows += rows[:30] + [("too short", "en", "a"), (None, "en", "a")]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = verdicts(rows, rules)
    for n in (3, 11):
        kept = {r.doc_id for r in quality.quality_filter(docs.repartition(n), rules=rules).collect()}
        assert kept == {i for i, x in enumerate(want) if x} and 100 < len(kept) < 185


def test_a_rate_just_on_the_fence_passes(spark):
    """60 equal documents and one whose symbols reach the fence exactly: 2 of 100 words, least 0.01 and spread 2."""
    rules = quality.Rules(min_group=10, spread=2.0, least=(("word_length", 9.0), ("symbol_rate", 0.01), ("dup_line_rate", 9.0), ("repeat_rate", 9.0)))
    rows = [(i, prose(i, 100), "en", "a") for i in range(60)] + [(90, prose(90, 98) + " # #", "en", "a"), (91, prose(91, 97) + " # # #", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality_filter(docs, rules=rules).collect()}
    assert 90 in kept and 91 not in kept and len(kept) == 61
