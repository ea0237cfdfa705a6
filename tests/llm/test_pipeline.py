"""Each stage against brute force, and the rows that flow through."""

import re
from collections import defaultdict

from pyspark.sql import functions as F
from test_neardup import brute as components
from test_quality import brute as counts

import corpus_pipeline
from stratum.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and 0.6 * len(before) < len(kept) < len(before)
    for d, r in before.items():
        n, _, _, _, repeated = counts(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert d not in kept

    one = stages["near_duplicates"](spark, good, SF).cache()
    want = components([(d, before[d].text) for d in sorted(kept)], 5, 80)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (n, c) in want.items() if d == c or not n)

    clean = stages["decontaminate"](spark, one, SF).cache()
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    has = lambda t: (w := t.lower().split()) and any(tuple(w[i : i + 13]) in runs for i in range(len(w)))
    gone = {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in one.collect() if has(r.text)} == gone

    masked = stages["personal_data"](spark, clean, SF).cache()
    assert masked.columns == columns and masked.count() == clean.count()
    assert pii.with_base(masked).where(F.size("base") > 0).count() == 0
    for r in masked.collect():
        assert re.sub("<(EMAIL|IP|CARD|PHONE)>", "", r.text) == before[r.doc_id].text or "<" in r.text

    mix = stages["mix"](spark, masked, SF).collect()
    sizes, words, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in masked.collect():
        sizes[r.source] += len(r.text.split())
    for r in mix:
        words[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2 and abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(words[s] <= 2 * sizes[s] for s in sizes)


def test_run_with_nulls_empty_and_clashing_columns(spark, tmp_path):
    rows = [(1, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (None, "a b c", "en", None, 5, 3)] + [(i, " ".join(f"w{(i * k * 7) % 997}" for k in range(1, 90)), "en", "s", 1, i) for i in range(20, 40)]
    names = "doc_id long, text string, lang string, source string, n_chars long, q int"
    for label, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, names).write.parquet(str(tmp_path / label / "documents.parquet"))
        spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / label / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / label))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "q"]
        assert out.count() >= (20 if data else 0)
