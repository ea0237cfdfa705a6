"""Quality rules whose thresholds adapt to each language and source.

For every document the rules take counts and from these four rates. A mergeable quantile sketch
of each rate is built for each (lang, source): counts of logarithmic buckets, so that any quantile is known within
``accuracy`` of its value; merged sketches (summed counts) serve each language and the
whole corpus. A document fails a rate if it lies beyond a fence, ``q75 + spread * max(q75 -
q25, least)`` (and likewise below for the mean word length), of its own group. ``least`` is what a rate varies by at
least, for groups so even that their quartiles meet. Groups of
fewer than ``min_group`` documents take the fences of their language, and small languages
those of the corpus. There are no other thresholds. Bucket counts are whole numbers, so reruns agree whatever the partitions; a document just on a fence passes.

DataFrame functions only. A sketch has at most some thousand buckets and is combined before the shuffle,
so a source with most of the rows costs no more than any other. The table of fences has a
row per group; it is broadcast when it has at most ``BROADCAST_GROUPS`` rows, else joined
on a salted key, the salt spreading a large group over tasks.

Null text counts as empty, null lang or source form groups of their own. A document without
words fails the fixed rule. Repeated rows are judged alike, each row on its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.columns import GAP, sealed, whole, words
from stratum.scratch import Scratch, is_small

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]
#: The fences' table may be broadcast up to so many groups (under 200 bytes each).
BROADCAST_GROUPS = 20_000
SALTS = 64


@dataclass(frozen=True)
class Rules:
    """Fixed rule: ``min_words``, ``max_repeat`` percent. Adaptive rules: see the module."""

    min_words: int = 50
    max_repeat: int = 50
    spread: float = 8.0
    min_group: int = 200
    accuracy: float = 0.01
    #: A rate's least spread.
    least: tuple = (("word_length", 0.5), ("symbol_rate", 0.02), ("dup_line_rate", 0.05), ("repeat_rate", 0.05))

    @property
    def log_base(self) -> float:
        """Logarithm of the ratio of a bucket's ends."""
        return math.log((1 + self.accuracy) / (1 - self.accuracy))


#: The bucket of the value 0.
ZERO = -(1 << 30)


def with_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns row (all columns of ``docs``, so that no name can clash), lang, source and q, a struct of the counts and rates.

    The three-word windows of a text are hashed to 64 bits and sorted; equal neighbours are windows that repeat.
    """
    t = F.col("t")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(F.col(f"`{text}`")).alias("t"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = base.withColumns({"w": words(t), "lines": lines})
    n, w = F.size("w"), F.col("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    second = first.withColumns({
        "s": F.sort_array(windows),
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines"),
    })
    s = F.col("s")
    twice = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
    third = second.withColumn("p", F.sort_array(F.array_compact(twice)))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    out = third.withColumn("n_repeat_words", covered.cast("long"))
    nw, nl = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    rates = {"word_length": F.col("word_chars") / nw, "symbol_rate": F.col("n_symbols") / nw, "dup_line_rate": F.col("n_dup_lines") / nl, "repeat_rate": F.col("n_repeat_words") / nw}
    q = F.struct(*[F.col(c) for c in COUNTS], *[v.alias(k) for k, v in rates.items()])
    return out.select("row", "lang", "source", sealed(q).alias("q"))


def measure(docs: DataFrame, rules: Rules = Rules(), **names: str) -> DataFrame:
    """As :func:`with_counts`, with ``base_failed`` in ``q``."""
    q = F.col("q")
    failed = (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat * q["n_words"])
    return with_counts(docs, **names).withColumn("q", q.withField("base_failed", failed))


def sketches(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source, rate, bucket, n): of the documents that pass the fixed rule, how many of a group have a rate in a bucket.

    Bucket k holds values from base ** (k - 1), not included, to base ** k.
    """
    q = F.col("q")
    bucket = lambda x: F.when(x > 0, F.ceil(F.log(x) / F.lit(rules.log_base)).cast("int")).otherwise(ZERO)
    each = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(q[r]).alias("bucket")) for r in RATES])
    spots = measured.where(~q["base_failed"]).select("lang", "source", F.explode(each).alias("b"))
    return spots.groupBy("lang", "source", "b.rate", "b.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """(keys, n, <rate>_q25, <rate>_q75) from bucket counts: a sketch's quantile is the middle of the bucket that holds its rank."""
    of = Window.partitionBy(*keys, "rate")
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    upto = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(of)})
    at = lambda p: F.min(F.when(F.col("upto") > p * (F.col("all") - 1), F.col("bucket")))
    value = lambda b: F.when(b > ZERO, F.exp(b * F.lit(rules.log_base)) * (1 - rules.accuracy)).otherwise(0.0)
    each = upto.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(0.25).alias("b25"), at(0.75).alias("b75"))
    one = lambda c, r: F.max(F.when(F.col("rate") == r, c))
    return each.groupBy(*keys).agg(F.max("n").alias("n"), *[one(value(F.col(f"b{p}")), r).alias(f"{r}_q{p}") for r in RATES for p in (25, 75)])


def fences(measured: DataFrame, scratch: Scratch, rules: Rules = Rules()) -> DataFrame:
    """A row (lang, source, fence) per group: the group's own fences, or those of the level above.

    Groups without a document that passes the fixed rule have no row.
    """
    least = dict(rules.least)

    def fence() -> Column:
        sides = []
        for r in RATES:
            width = rules.spread * F.greatest(F.col(f"{r}_q75") - F.col(f"{r}_q25"), F.lit(least[r]))
            sides += [(F.col(f"{r}_q75") + width).alias(f"{r}_high"), (F.col(f"{r}_q25") - width).alias(f"{r}_low")]
        return F.struct(*sides)

    sketch = scratch.save(sketches(measured, rules), "sketches")
    own = quartiles(sketch, ["lang", "source"], rules).select("lang", "source", "n", fence().alias("f0"))
    middle = quartiles(sketch, ["lang"], rules).select(F.col("lang").alias("_l"), F.col("n").alias("_n1"), fence().alias("f1"))
    top = scratch.save(quartiles(sketch, [], rules).select(fence().alias("f2")), "corpus").first()  # a row of eight numbers
    corpus = F.struct(*[F.lit(x).cast("double").alias(k) for k, x in top.f2.asDict().items()])
    joined = own.join(middle, own["lang"].eqNullSafe(middle["_l"]), "left")
    chosen = F.when(F.col("n") >= rules.min_group, F.col("f0")).when(F.col("_n1") >= rules.min_group, F.col("f1")).otherwise(corpus)
    return scratch.save(joined.select("lang", "source", chosen.alias("_fence")), "fences")


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``measured`` with a boolean ``kept`` in ``q``."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_fence")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if is_small(limits, BROADCAST_GROUPS):
        joined = measured.join(F.broadcast(limits), same, "left")
    else:
        salted = measured.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(limits.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_salt2")), "left").drop("_salt", "_salt2")
    q, f = F.col("q"), F.col("_fence")
    odd = q["word_length"] < f["word_length_low"]
    for r in RATES:
        odd = odd | (q[r] > f[f"{r}_high"])
    kept = ~q["base_failed"] & ~F.coalesce(odd, F.lit(False))
    return joined.withColumn("q", q.withField("kept", kept)).drop("_lang", "_source", "_fence")


def quality_filter(docs: DataFrame, label: str = "quality-filter", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns. Counts are taken once and written with the rows."""
    scratch = Scratch(docs.sparkSession, label)
    measured = scratch.save(measure(docs, rules), "measured")
    return judge(measured, fences(measured, scratch, rules), rules).where(F.col("q")["kept"]).select("row.*")
