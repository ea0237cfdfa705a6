"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes the set of its word shingles. Texts with equal sets (a fingerprint of 128 bits
   over the whole set) are one class; only class representatives go on, so copies cost nothing more.
2. MinHash minima are cut into bands; the hash of a band is a bucket. Rows and bands follow from the
   similarity so that a pair at that similarity is missed with a probability below ``miss``. Of each minimum the low
   ``bits`` bits are kept, packed into words plane by plane: the number of unequal minima is a bit count
   of XORed words, and the similarity estimated from it, corrected for chance equality, drops pairs
   that lie more than ``sigmas`` standard errors below the threshold.
3. Links are sought for connected components. Each bucket has a hub: first the member that shares most buckets
   with others (an original among its near copies), then another at random. A round compares each member with one hub,
   the highest of its buckets' hubs in another component, and merges components: one row for each member, however many
   buckets it has. A last pass takes what is left: the members of buckets that still hold different components get a
   longer signature, cut into bands of ``last_rows`` minima that are missed as seldom at the threshold but keep apart
   what is less similar. Pairs of different components that share such a band are filtered within the join by size and by the
   longer signature's estimate. Hub rounds don't decide anything, they save work; the
   last pass makes the result that of all candidate pairs.
4. Every pair that passes the estimate is confirmed on the full sets of both texts.

Components come from label propagation with pointer jumping over the links. Everything stays in tables; hot
buckets and hubs are joins with one row on one side, which adaptive execution splits. The driver sees counts only.

Null and empty texts have no shingles, are linked with nothing and are kept. Of rows in one component the one with the
smallest id is kept (null ids last); if several rows have that id, :func:`deduplicate` keeps one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from stratum.llm.columns import sealed, whole
from stratum.llm.shingles import U, mix, release, shingle_set
from stratum.scratch import Scratch, is_small

#: Keys of candidate texts, and labels, may be broadcast up to so many rows (under 50 bytes each).
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Near:
    """Shingle words; similarity as percent of the union; MinHash parameters."""

    words: int = 5
    percent: int = 80
    bits: int = 4
    miss: float = 1e-6
    sigmas: float = 5.0
    rounds: int = 3
    seed: int = 11

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5

    @property
    def last_rows(self) -> int:
        return 2 * self.rows

    def _enough(self, rows: int) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** rows))

    @property
    def bands(self) -> int:
        return self._enough(self.rows)

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    @property
    def last_hashes(self) -> int:
        return self.last_rows * self._enough(self.last_rows)

    def least_equal(self, hashes: int) -> float:
        """Least share of equal b-bit minima of a pair worth confirming."""
        chance = 2.0**-self.bits
        equal = self.percent / 100 * (1 - chance) + chance
        return equal - self.sigmas * math.sqrt(equal * (1 - equal) / hashes)


class Hasher:
    def __init__(self, near: Near, hashes: int, rows: int) -> None:
        rng = np.random.default_rng(near.seed + hashes)
        self.near, self.hashes, self.rows = near, hashes, rows
        self.a = (rng.integers(0, 2**32, hashes, dtype=np.uint64) | U(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)[:, None]
        self.coefficients = rng.integers(0, 2**63, rows, dtype=np.uint64) | U(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> U(32)).astype(np.uint32)
        out = np.full(self.hashes, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(out, (self.a * x[None, i : i + 512] + self.b).min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """rows of minima -> int64 bucket hashes, the band's number mixed in."""
        n = self.hashes // self.rows
        m = minima.reshape(len(minima), n, self.rows).astype(U)
        return mix((m * self.coefficients).sum(axis=2, dtype=U) + mix(np.arange(1, n + 1, dtype=U))[None, :]).view(np.int64)

    def signatures(self, minima: np.ndarray) -> np.ndarray:
        """rows of minima -> packed low bits: ``bits`` planes of as many words as the hashes fill. The low bits of a minimum are those of
        a linear function of one shingle, so all bits are mixed first."""
        padded = np.zeros((len(minima), _lanes(self.hashes) * 64), np.uint32)
        padded[:, : self.hashes] = _mix32(minima)
        return np.hstack([np.packbits((padded >> j) & 1, axis=1).view(np.int64) for j in range(self.near.bits)])


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> 16)) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> 15)) * np.uint32(0x846CA68B)
    return x ^ (x >> 16)


def _lanes(hashes: int) -> int:
    return -(-hashes // 64)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, max(k, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(values).reshape(-1)))


def sign(docs: DataFrame, near: Near = Near(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row, id, key (digest of the text), n_shingles, fp1, fp2 (of the set), sig, bands; the last two are empty without shingles."""
    t = F.col(f"`{text}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.md5(whole(t).cast("binary")).alias("key"), t.cast("string").alias("text"))
    schema = packed.drop("text").schema.add("n_shingles", "long").add("fp1", "long").add("fp2", "long").add("sig", ArrayType(LongType())).add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(near, near.hashes, near.rows)
        for b in batches:
            texts = b.column("text").to_pylist()
            n, fp1, fp2 = np.zeros(len(texts), np.int64), np.zeros(len(texts), U), np.zeros(len(texts), U)
            minima = np.zeros((len(texts), near.hashes), np.uint32)
            for i, x in enumerate(texts):
                s = shingle_set(x, near.words)
                n[i] = len(s)
                if len(s):
                    fp1[i], fp2[i] = mix(s).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
                    minima[i] = hasher.minima(s)
            cols = [b.column("row"), b.column("key"), pa.array(n), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), _lists(hasher.signatures(minima)), _lists(hasher.bands(minima))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "key", "n_shingles", "fp1", "fp2", "sig", "bands"])
        release()

    return packed.mapInArrow(run, schema)


def _few_unequal(a: Column, b: Column, near: Near, hashes: int) -> Column:
    """Whether the signatures' estimate lets the pair pass."""
    unequal, lanes = F.lit(0), _lanes(hashes)
    for lane in range(lanes):
        word = None
        for plane in range(near.bits):
            x = F.get(a, F.lit(plane * lanes + lane)).bitwiseXOR(F.get(b, F.lit(plane * lanes + lane)))
            word = x if word is None else word.bitwiseOR(x)
        unequal = unequal + F.bit_count(word)
    return unequal <= math.floor(hashes * (1 - near.least_equal(hashes)))


def _long_signatures(texts: DataFrame, near: Near) -> DataFrame:
    """(cid, long, last): signatures of ``last_hashes`` minima and their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(near, near.last_hashes, near.last_rows)
        for b in batches:
            minima = [hasher.minima(shingle_set(t, near.words)) for t in b.column("text").to_pylist()]
            if minima:
                both = np.stack(minima)
                yield pa.RecordBatch.from_arrays([b.column("cid"), _lists(hasher.signatures(both)), _lists(hasher.bands(both))], names=["cid", "long", "last"])
        release()

    return texts.select("cid", "text").mapInArrow(run, "cid long, long array<long>, last array<long>")


def _sizes_fit(a: Column, b: Column, near: Near) -> Column:
    return 100 * F.least(a, b) >= near.percent * F.greatest(a, b)


def _confirm(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts``: (cid, text). The hub's side is b, its set is kept from row to row."""
    left = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                if b != last:
                    last, other = b, shingle_set(tb, near.words)
                mine = shingle_set(ta, near.words)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * shared >= near.percent * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of the nodes with links: the smallest node of their component. ``links``: (a, b), in either order."""
    edges = links.where("a <> b").select("a", "b")
    edges = scratch.save(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels0")
    for k in range(1, 200):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        low = labels.join(near, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        up = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = low.join(up, "label").select("node", F.least("label", "up").alias("label"), "was")
        step = scratch.save(jumped, f"{name}-labels{k}")
        scratch.drop(f"{name}-labels{k - 1}") if k > 1 else None
        labels = step.select("node", "label")
        if step.where("label <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle in 200 rounds")


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, BROADCAST_ROWS) else df


def clusters(docs: DataFrame, near: Near = Near(), label: str = "neardup", text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns row, id, n_shingles, class (cid), component (smallest id reachable), rid (a row number); a row for each of ``docs``."""
    scratch = Scratch(docs.sparkSession, label)
    signed = sign(docs, near, text, keep).withColumn("rid", F.monotonically_increasing_id())
    signed = scratch.save(signed.withColumn("id", F.col(f"row.`{doc_id}`")), "signed")
    full = signed.where("n_shingles > 0")
    # One row per set: representatives with their signature, and the smallest id.
    merged = full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("key").alias("key"))
    classes = scratch.save(merged.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "cid")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = scratch.save(members.join(shared, "bucket"), "buckets")
    degree = buckets.groupBy("cid").agg(F.sum("size").alias("degree"))
    signatures = scratch.save(classes.join(degree, "cid").select("cid", "degree", "sig", F.col("n_shingles").alias("n"), "key"), "signatures")
    wanted = _hint(signatures.select("key", "cid"))
    texts = docs.select(F.md5(whole(F.col(f"`{text}`")).cast("binary")).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(wanted, "key")
    texts = scratch.save(texts.groupBy("cid").agg(F.first("text").alias("text")), "texts")

    slim = signatures.select("cid", "degree")
    sig_of = lambda c: signatures.select(F.col("cid").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    fits = _sizes_fit(F.col("na"), F.col("nb"), near) & _few_unequal(F.col("sa"), F.col("sb"), near, near.hashes)
    comp, links = None, None
    for k in range(near.rounds):
        current = buckets.select("bucket", "cid")
        if comp is None:
            current = current.join(slim, "cid").withColumns({"comp": F.col("cid"), "rank": F.col("degree")})
        else:
            current = current.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("comp"), F.xxhash64("cid", "bucket", F.lit(k)).alias("rank"))
        hubs = current.groupBy("bucket").agg(F.max(F.struct("rank", "cid", "comp")).alias("hub"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket", F.col("hub.rank").alias("top"), F.col("hub.cid").alias("b"), F.col("hub.comp").alias("cb"))
        # One hub for each member and round; what its other hubs would link is found in later rounds or in the last pass.
        pairs = current.join(hubs, "bucket").where("comp <> cb").groupBy(F.col("cid").alias("a")).agg(F.max(F.struct("top", "b")).alias("h")).select("a", "h.b")
        pairs = pairs.join(sig_of("a"), "a").join(sig_of("b"), "b").where(fits).select("a", "b")
        found = scratch.save(_confirm(scratch.save(pairs, f"pairs{k}"), texts, near), f"links{k}")
        links = found if links is None else links.union(found)
        comp = components(links, scratch, f"round{k}")
    # What is left: members of buckets with different components, paired by the bands of their longer signatures.
    current = buckets.select("bucket", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("comp"))
    open_ = current.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    rest = scratch.save(current.join(open_, "bucket").select("cid", "comp").distinct(), "rest")
    long = scratch.save(_long_signatures(texts.join(rest.select("cid"), "cid"), near), "long")
    spots = long.select("cid", F.explode("last").alias("band")).join(rest, "cid")
    mixed = spots.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("band")
    spots = scratch.save(spots.join(mixed, "band"), "spots").join(long, "cid").join(classes.select("cid", F.col("n_shingles").alias("n")), "cid")
    a = spots.select("band", F.col("cid").alias("a"), F.col("comp").alias("ca"), F.col("long").alias("sa"), F.col("n").alias("na"), F.col("last").alias("la"))
    b = spots.select(F.col("band").alias("band2"), F.col("cid").alias("b"), F.col("comp").alias("cb"), F.col("long").alias("sb"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    # A pair counts in the least band that it shares only.
    first = F.array_min(F.array_intersect("la", "lb")) == F.col("band")
    fits = _sizes_fit(F.col("na"), F.col("nb"), near) & _few_unequal(F.col("sa"), F.col("sb"), near, near.last_hashes)
    pairs = a.join(b, (F.col("band") == F.col("band2")) & (F.col("ca") < F.col("cb")) & fits & first).select("a", "b")
    found = scratch.save(_confirm(scratch.save(pairs, "pairs-rest"), texts, near), "links-rest")
    comp = components(links.union(found), scratch, "all")

    known = classes.select("cid", "fp1", "fp2", "n_shingles", "id").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid"))
    # Written first: a join with an aggregate of the same shuffle can't be split where a component is large.
    least = scratch.save(known.groupBy("comp").agg(F.min("id").alias("component")), "least")
    known = scratch.save(known.join(least, "comp").select("fp1", "fp2", "n_shingles", "cid", "comp", "component"), "known")
    out = signed.drop("sig", "bands", "key").join(known, ["fp1", "fp2", "n_shingles"], "left")
    return out.select("row", "id", "n_shingles", F.col("cid").alias("class"), "comp", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), "rid")


def deduplicate(docs: DataFrame, near: Near = Near(), label: str = "dedup", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of ``docs``; rows without words all stay."""
    found = clusters(docs, near, label, text, doc_id)
    scratch = Scratch(docs.sparkSession, label)
    narrow = scratch.save(found.where("n_shingles > 0").select("id", "comp", "rid"), "narrow")
    first = narrow.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("f")).select("comp", F.col("f.rid").alias("kept"))
    first = scratch.save(first, "first")
    gone = scratch.save(narrow.join(first, "comp").where("rid <> kept").select("rid"), "gone")
    return found.join(_hint(gone), "rid", "left_anti").select("row.*")
