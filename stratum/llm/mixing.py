"""Mixing sources to target weights.

Each source has a weight and a size (its words); the mix takes a given share of all sizes.
Targets are shares by weight; no target passes ``epochs`` times its source's size, and what is
cut off there is shared anew by weight until none is above. That is one level L with
sum(min(cap, L * weight)) = total, found from the sources in order of cap / weight.

Within a source documents come in the order of a hash of their id and text, so a budget cuts a
uniform random set. The order is never made in one task: the hash is uniform, so fixed ranges of it
(buckets) are an even range partition of each source, however large it is. Sums of sizes per bucket,
then running sums over buckets, then running sums within each bucket give each document the words
before it. A budget of e whole epochs and a rest takes each document e times and, in that order,
again until the rest is used; the document at the cut gives just the words that are missing.

Reruns agree: the order depends on ids and texts only, so rows with null or repeated ids spread like others; equal rows
are neighbours, and which of them the cut meets makes no difference. Null source is a source of
its own and the last; null text has size 0. Repeated rows count each. Budgets are computed over a row for each source in
one task, offsets over a row for each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.columns import whole, words
from stratum.scratch import Scratch, is_small

#: The budgets' table, and that of bucket sums, may be broadcast up to so many rows (under 100 bytes each).
BROADCAST_ROWS = 20_000
#: Rows of a bucket, about: what one task sorts at once for one source.
BUCKET_ROWS = 100_000
_KEY_BITS = 60


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in order of their code points, repeating; the mix's size as a fraction of all words; most epochs."""

    weights: tuple = (3, 1, 2)
    share_num: int = 3
    share_den: int = 2
    epochs: int = 2


def random_key(doc_id: Column, text: Column) -> Column:
    """60 bits that look random and depend on the id and the text only."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.md5(whole(text.cast("string")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def budgets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target, budget) from a row (source, source_size) for each source.

    Exact: the level is a quotient of whole numbers, the budget its whole part times the weight.
    A window over all sources runs here; there is one row for each.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*map(F.lit, mix.weights)), ((F.row_number().over(order) - 1) % len(mix.weights)).cast("int"))
    cap = (F.col("source_size") * mix.epochs).cast("decimal(38,0)")
    s = sizes.select("source", "source_size", w.cast("long").alias("w")).withColumn("cap", cap)
    rising = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"used": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)), "all": F.sum("source_size").over(every)})
    # In units of 1 / share_den words: the level that remains if this source and all after it stay below their caps.
    num = (F.col("all") * mix.share_num - F.col("used") * mix.share_den).cast("decimal(38,0)")
    s = s.withColumns({"num": num, "den": (F.col("w_left") * mix.share_den).cast("decimal(38,0)")})
    s = s.withColumn("free", F.col("num") * F.col("w") <= F.col("cap") * F.col("den"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("num"), F.col("den")))).over(every)
    s = s.withColumn("level", first)
    floor = F.expr("CAST((level.num * w) DIV level.den AS LONG)")
    return s.select(
        "source", "source_size",
        F.when(F.col("free"), F.col("level.num").cast("double") * F.col("w") / F.col("level.den").cast("double")).otherwise(F.col("cap").cast("double")).alias("target"),
        F.when(F.col("free"), floor).otherwise(F.col("cap").cast("long")).alias("budget"),
    )


def allot(docs: DataFrame, mix: Mix = Mix(), label: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (of ``keep``, else of all columns), size, source_size, target, taken; a row for each of ``docs``."""
    scratch = Scratch(docs.sparkSession, label)
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    measured = docs.select(row.alias("row"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), random_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"), F.col(f"`{doc_id}`").alias("id"))
    measured = scratch.save(measured, "measured")
    buckets = max(256, measured.count() // BUCKET_ROWS + 1)
    bits = (buckets - 1).bit_length()
    bucket = F.shiftright("key", _KEY_BITS - bits).cast("int")
    sums = scratch.save(measured.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "sums")
    plan = scratch.save(budgets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), mix), "budgets")
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset"))
    known = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(offsets["source"].alias("_s"), F.col("bucket").alias("_b"), "offset", "source_size", "target", "budget")
    known = scratch.save(known, "offsets")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = measured.withColumn("bucket", bucket).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    right = F.broadcast(known) if is_small(known, BROADCAST_ROWS) else known
    joined = placed.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    whole_epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("budget") - whole_epochs * F.col("source_size") - F.col("offset") - F.col("before")
    taken = whole_epochs * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return joined.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), label: str = "mix", text: str = "text") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken, the text cut to the words that are taken."""
    chosen = allot(docs, mix, label, text=text).where("taken > 0")
    passes = chosen.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    part = F.least(F.col("size"), F.col("taken") - (F.col("_pass") - 1) * F.col("size")).cast("int")
    cut = F.when(part == F.col("size"), F.col("row")[text]).otherwise(F.concat_ws(" ", F.slice(words(F.col("row")[text]), F.lit(1), part)))
    return passes.select(*[cut.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
