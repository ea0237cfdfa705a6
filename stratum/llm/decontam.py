"""Benchmark decontamination with spaced seeds.

A mask such as 110111 selects positions of a run of words; the hash of the selected words is the
seed of that run, so a substituted word at an ignored position doesn't change it. Seeds of the
benchmark are joined with seeds at every position of every document. Around each hit document and
item are laid over each other (same diagonal). The document has leaked words of the item if some segment
of ``least_words`` words or more (or the whole item, if that is shorter) has ``similarity`` of them equal. Of such
segments the one whose equal words exceed that share by most is returned.

The masks keep five words each and together meet every run in which four of five words are equal.
Items shorter than the shortest mask are met by a mask that keeps all their words and count only where all of them are equal; items of fewer than ``shortest``
words are ordinary speech, no evidence, and are not searched for (a parameter; 1 searches for all with words).

DataFrame functions only. Positions are exploded and hashed inside one generated stage, which
carries the word array by reference. A posting of the benchmark is a hash, a key of the item and a place, some 60 bytes whatever the item's length;
they are broadcast when they have at most ``BROADCAST_POSTINGS`` rows, else joined by a shuffle of hashes. Hits become distinct per
text, item and diagonal before any word of an item or text joins them, so equal texts are verified once and an item once for each diagonal;
texts and items are fetched by keys of their words for the hits alone. Ids take no part, so they may be null or repeat.

Null text has no words. A verdict depends on the text alone, so copies and repeated rows all get it. Words are compared in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import sealed, whole, words
from stratum.scratch import Scratch, is_small

#: Postings are some 60 bytes each, keys of texts some 50.
BROADCAST_POSTINGS = 200_000
BROADCAST_TEXTS = 100_000
FOUND = "struct<score:bigint,start:int,end:int>"
#: Sums over a segment are counted in these parts of a word.
UNIT = 1_000_000


@dataclass(frozen=True)
class Seeds:
    masks: tuple = ("110111", "111011", "1101011")
    least_words: int = 13
    similarity: float = 0.8
    shortest: int = 3


def _tokens(text: Column) -> Column:
    return words(F.lower(whole(text)))


def _seeds(tokens: Column, at: Column, masks: tuple) -> Column:
    """The seed of each mask for the run that starts at ``at``, null where the run leaves the text."""
    return F.array(*[F.when(at + len(m) <= F.size(tokens), F.xxhash64(F.lit(k), *[F.get(tokens, at + i) for i, c in enumerate(m) if c == "1"])) for k, m in enumerate(masks)])


def _exploded(df: DataFrame, tokens: str, masks: tuple, others: list[str]) -> DataFrame:
    """A row (others, at, seed, mask) for each position and mask."""
    n = F.size(tokens)
    shortest = min(map(len, masks))
    runs = df.where(n >= shortest).select(*others, tokens, F.explode(F.sequence(F.lit(0), n - shortest)).alias("at"))
    return runs.select(*others, "at", F.posexplode(_seeds(F.col(tokens), F.col("at"), masks)).alias("mask", "seed")).where(F.col("seed").isNotNull())


def _items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item, item_key): the words of each item and their digest."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), sealed(_tokens(F.col(f"`{text}`"))).alias("item"))
    return items.withColumn("item_key", F.md5(F.concat_ws(" ", "item").cast("binary")))


def masks_for(items: DataFrame, seeds: Seeds) -> tuple:
    """The masks, and one that keeps all words for each length of items that no mask fits into."""
    least = min(map(len, seeds.masks))
    lengths = items.where(F.size("item").between(seeds.shortest, least - 1)).select(F.size("item").alias("n")).distinct().collect()  # fewer than a mask's length
    return (*seeds.masks, *("1" * r.n for r in sorted(lengths)))


def postings(items: DataFrame, masks: tuple, seeds: Seeds = Seeds()) -> DataFrame:
    """(seed, item_key, p): the seeds of the benchmark and their places in its items, each different item once."""
    distinct = items.where(F.size("item") >= seeds.shortest).groupBy("item_key").agg(F.first("item").alias("item")).withColumn("n", F.size("item"))
    found = _exploded(distinct, "item", masks, ["item_key", "n"])
    size = F.get(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask"))
    return found.where((F.col("mask") < len(seeds.masks)) | (F.col("n") == size)).select("seed", "item_key", F.col("at").alias("p"))


def _equal(item: Column, part: Column, diagonal: Column) -> Column:
    """Which words of the item stand in ``part``, the document's words from ``greatest(diagonal, 0)`` on."""
    skip = F.greatest(-diagonal, F.lit(0))
    return F.transform(item, lambda w, k: F.coalesce(F.get(part, k - skip) == w, F.lit(False)))


def _segment(equal: Column, least: Column, similarity: float) -> Column:
    """The best segment of at least ``least`` words: its sum of equal words less ``similarity`` a word (in millionths) is the greatest.

    The best one that ends at a word is the last ``least`` words, or the best one that ends a word before and this word.
    """
    miss = round(similarity * UNIT)
    weight = lambda e: F.when(e, UNIT - miss).otherwise(-miss).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("at"), zero.alias("last"), zero.alias("cur"), F.lit(0).alias("from"), F.lit(-(1 << 62)).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(a, e):
        end = a["at"] + 1
        full = end >= least
        last = a["last"] + weight(e) - F.when(end > least, weight(F.get(equal, a["at"] - least))).otherwise(zero)
        longer = a["cur"] + weight(e)
        extend = (end > least) & (longer >= last)
        cur, from_ = F.when(extend, longer).otherwise(last), F.when(extend, a["from"]).otherwise(F.greatest(end - least, F.lit(0)))
        best = full & (cur > a["score"])
        return F.struct(
            end.alias("at"), last.alias("last"), cur.alias("cur"), from_.alias("from"),
            F.when(best, cur).otherwise(a["score"]).alias("score"), F.when(best, from_).otherwise(a["start"]).alias("start"), F.when(best, end).otherwise(a["end"]).alias("end"),
        )

    return F.aggregate(equal, start, step, lambda a: F.struct(a["score"], a["start"], a["end"]).cast(FOUND))


def _part(tokens: Column, item: Column, diagonal: Column) -> Column:
    return F.slice(tokens, F.greatest(diagonal, F.lit(0)) + 1, F.greatest(F.size(item) + F.least(diagonal, F.lit(0)), F.lit(0)))


def _verified(hits: DataFrame, seeds: Seeds) -> DataFrame:
    """From (key, item_key, item, part, diagonal): (key, item_key, n_words, n_equal, similarity, at) of the segments that count as leaks."""
    least = F.least(F.lit(seeds.least_words), F.size("item"))
    met = hits.withColumn("equal", sealed(_equal(F.col("item"), F.col("part"), F.col("diagonal"))))
    found = met.withColumn("s", sealed(_segment(F.col("equal"), least, seeds.similarity)))
    n = F.col("s.end") - F.col("s.start")
    equal = ((F.col("s.score") + round(seeds.similarity * UNIT) * n.cast("long")) / UNIT).cast("int")
    rows = found.select("key", "item_key", "item", n.alias("n_words"), equal.alias("n_equal"), (equal / n).alias("similarity"), (F.col("diagonal") + F.col("s.start")).alias("at"))
    return rows.where((F.col("similarity") >= seeds.similarity) & ((F.col("n_equal") == F.col("n_words")) | (F.size("item") >= min(map(len, seeds.masks))))).drop("item")


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows) else df


def _key(text: str) -> Column:
    return F.md5(whole(F.col(f"`{text}`").cast("string")).cast("binary"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), label: str = "decontam", text: str = "text") -> DataFrame:
    """(key, item_key, n_words, n_equal, similarity, at): the verified overlaps of each different text, ``key`` being its digest. Written."""
    scratch = Scratch(docs.sparkSession, label)
    items = _items(benchmark)
    masks = masks_for(items, seeds)
    table = scratch.save(postings(items, masks, seeds), "postings")
    texts = docs.select(_key(text).alias("key"), _tokens(F.col(f"`{text}`")).alias("tokens"))
    met = _exploded(texts, "tokens", masks, ["key"]).join(_hint(table, BROADCAST_POSTINGS), "seed")
    met = scratch.save(met.select("key", "item_key", (F.col("at") - F.col("p")).alias("diagonal")).distinct(), "met")
    wanted = _hint(met.select("key").distinct(), BROADCAST_TEXTS)
    hit = docs.select(_key(text).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(wanted, "key", "left_semi")
    hit = hit.groupBy("key").agg(F.first("text").alias("text")).select("key", sealed(_tokens(F.col("text"))).alias("tokens"))
    words_of = items.groupBy("item_key").agg(F.first("item").alias("item")).join(met.select("item_key").distinct(), "item_key", "left_semi")
    hits = met.join(hit, "key").join(words_of, "item_key")
    return scratch.save(_verified(hits.select("key", "item_key", "item", _part(F.col("tokens"), F.col("item"), F.col("diagonal")).alias("part"), "diagonal"), seeds), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), label: str = "decontam", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``carry`` (default: row, all columns), key (digest of the text), item_id, n_words, n_equal, similarity, at (first word): the verified overlaps, repeats included."""
    found = leaking_texts(docs, benchmark, seeds, label, text).join(_items(benchmark).select("item_key", "item_id"), "item_key").drop("item_key")
    carry = carry or {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    base = docs.select(*[v.alias(f"c_{k}") for k, v in carry.items()], _key(text).alias("key"))
    return base.join(_hint(found, BROADCAST_TEXTS), "key").withColumnsRenamed({f"c_{k}": k for k in carry})


def decontaminate(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), label: str = "clean", text: str = "text") -> DataFrame:
    """The documents without any leak, with their columns."""
    bad = leaking_texts(docs, benchmark, seeds, label, text).select(F.col("key").alias("digest")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(text).alias("digest"))
    return packed.join(_hint(bad, BROADCAST_TEXTS), "digest", "left_anti").select("row.*")
