"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Words map to symbols: the end of a text, the most frequent words, and classes of all other
words (by the hash of a word's first three bytes, so a class holds words that begin alike and a new word has
one too). The number of symbols grows with the corpus, with the root of its tokens, from ``least_symbols`` to ``most_symbols``
(:meth:`Shape.grown`): at the upper end, from a billion tokens on, 2,558 words and 1,536 classes. The model is log-bilinear over symbols: the vectors of the two symbols before are combined
linearly and scored against every symbol. P(word | context) = P(symbol | context) * P(word | class), the
latter add-one smoothed within the class with one unit for a word not seen; both parts sum to one, so scores
are normalised log-probabilities.

What it learns from is gathered from the whole training corpus: counts of all words, sums per class, and
counts of all symbol trigrams, each combined within tasks before the shuffle. Trigrams are dealt to shards by a
hash, as arrays of codes and counts, and each shard's are merged; the number of shards follows from that of the tokens. Noise-contrastive
training passes over the distinct trigrams of each shard, weighted by their counts, with noise shared by a batch so that everything is matrix products; the shards' parameters are averaged after each
round, in two steps and in the order of the shards. So the model is the same however Spark deals out rows. For scoring, the logarithms of
the normalisers of all symbol pairs are one table, computed by batched products in tasks, at most ``most_symbols`` squared numbers (64 MB).

Counts of the ``frequent`` most frequent words travel with the scoring tasks (a fixed bound). All other
words, rare ones, are looked up by a join on their hash, each document's repeats combined first; no rare
word is a hot key. Words are identified by hashes of 53 bits and 11 bits of their beginning.

Null text is empty: one token, the end. Texts are whole whatever their length. Without training documents
all counts are 0 and the model is uniform over symbols. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from stratum.llm.shingles import U, mix
from stratum.scratch import Scratch

START, END = 0, 1
#: Texts are hashed in pieces of about so many bytes, whole texts each.
PIECE_BYTES = 1 << 19
#: A task's hashes are combined when so many have gathered.
FLUSH_TOKENS = 2_000_000
#: A row of training weighs at most so many times the mean count of a trigram.
SPLIT = 8
#: Trigrams of a shard, copies included but no more than there can be.
SHARD_ROWS = 1 << 20
#: Averages are taken over groups of shards first.
AVERAGES = 32


@dataclass(frozen=True)
class Shape:
    """``symbols`` and ``classes`` are set by the corpus where they are 0."""

    symbols: int = 0
    classes: int = 0
    least_symbols: int = 256
    most_symbols: int = 4096
    frequent: int = 1 << 18
    dim: int = 32
    noise: int = 48
    batch: int = 8192
    rounds: int = 2
    least_steps: int = 60
    rate: float = 0.01
    seed: int = 5

    @property
    def listed(self) -> int:
        """Words that are symbols of their own."""
        return self.symbols - self.classes - 2

    def grown(self, tokens: int) -> Shape:
        """The shape for a corpus of so many tokens: the next power of two above a sixteenth of their root; three eighths of the symbols are classes."""
        if self.symbols:
            return self
        n = self.least_symbols
        while n < self.most_symbols and 256 * n * n < tokens:
            n *= 2
        return replace(self, symbols=n, classes=n * 3 // 8)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(23).integers(0, 2**63, 256, dtype=np.uint64) | U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: The low bits of a word's hash come from its first three bytes, its class from them; the last value stands for the end of a text.
CLASS_BITS = 11
END_CLASS = (1 << CLASS_BITS) - 1
END_HASH = END_CLASS
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 2 * PIECE_BYTES), U(base))
            x[0] = U(1)
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (53 bits, and 11 from the first three bytes) and the number of words of each text."""
    raws = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raws) + b"   ", np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * power[: len(data)], out=prefix[1:])
    h = mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(U))
    second, third = np.where(stop - start > 1, data[start + 1], 0), np.where(stop - start > 2, data[start + 2], 0)
    cls = mix((data[start].astype(U) << U(16)) | (second.astype(U) << U(8)) | third.astype(U)) % U(END_CLASS)
    ends = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return ((h & ~U(END_CLASS)) | cls).view(np.int64), counts


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_BYTES together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= PIECE_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _combined(parts: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    for i in range(0, len(values), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 200_000].astype(np.int64)), pa.array(n[i : i + 200_000].astype(np.int64))], names=names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of the words of a task and of the ends of its texts."""
    parts, size, ends = [], 0, 0
    for b in batches:
        texts = b.column("text").to_pylist()
        ends += len(texts)
        for i, j in _pieces(texts):
            parts.append(hash_words(texts[i:j])[0])
            size += len(parts[-1])
        if size > FLUSH_TOKENS:
            yield from _combined(parts, ["h", "n"])
            parts, size = [], 0
    if size:
        yield from _combined(parts, ["h", "n"])
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends])], names=["h", "n"])


class Lexicon:
    """Maps words to symbols and to what is known of them."""

    def __init__(self, shape: Shape, hashes: np.ndarray, counts: np.ndarray) -> None:
        """``hashes`` of the frequent words, most frequent first, with their counts; the first ``listed`` are symbols."""
        self.shape = shape
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[order], counts[order]
        self.symbol = np.where(order < shape.listed, order + 2, -1).astype(np.int32)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after another, each closed by its end: symbols, the two symbols before each, and of the
        words hashes and counts (-1 for a word that isn't among the frequent ones); the first place of each text."""
        shape, m = self.shape, len(self.hashes)
        h, n = hash_words(texts)
        symbol = (h & END_CLASS) % shape.classes + (2 + shape.listed)
        count = np.full(len(h), -1, np.int64)
        if m:
            j = np.minimum(np.searchsorted(self.hashes, h), m - 1)
            found = self.hashes[j] == h
            count[found] = self.counts[j[found]]
            listed = found & (self.symbol[j] >= 0)
            symbol[listed] = self.symbol[j[listed]]
        total = len(h) + len(texts)
        last = np.cumsum(n + 1) - 1
        first = last - n
        flat, is_word = np.full(total, END, np.int64), np.ones(total, bool)
        is_word[last] = False
        flat[is_word] = symbol
        hashes, counts = np.zeros(total, np.int64), np.full(total, -2, np.int64)
        hashes[is_word], counts[is_word] = h, count
        s2 = np.concatenate([[START], flat[:-1]]) if total else flat
        s2[first] = START
        s1 = np.concatenate([[START], s2[:-1]]) if total else flat
        s1[first] = START
        return flat, s1 * shape.symbols + s2, hashes, counts, first


def _blobs(parts: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, codes, counts) of trigram codes, combined: a row for each shard."""
    codes, n = np.unique(np.concatenate(parts), return_counts=True)
    shard = (mix(codes.view(U)) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    codes, n, shard = codes[order], n[order].astype(np.int64), shard[order]
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
    for k in range(0, len(cuts) - 1, 64):
        some = list(zip(cuts, cuts[1:]))[k : k + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[i]) for i, _ in some], pa.int32()), pa.array([codes[i:j].tobytes() for i, j in some], pa.binary()), pa.array([n[i:j].tobytes() for i, j in some], pa.binary())],
            names=["shard", "codes", "counts"],
        )


def _trigrams(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, shards: int) -> Iterator[pa.RecordBatch]:
    """The symbol trigrams of a task, by shard."""
    parts, size = [], 0
    for b in batches:
        texts = b.column("text").to_pylist()
        for i, j in _pieces(texts):
            symbol, context, *_ = lexicon.read(texts[i:j])
            parts.append(context * lexicon.shape.symbols + symbol)
            size += len(symbol)
        if size > FLUSH_TOKENS:
            yield from _blobs(parts, shards)
            parts, size = [], 0
    if size:
        yield from _blobs(parts, shards)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, rows, n, codes, counts): a row for each shard, codes rising. Rows come with those of a shard together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shard, size = None, 0

    def combine() -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(n, first)

    def row():
        codes, n = combine()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(codes)]), pa.array([int(n.sum())]), pa.array([codes.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["shard", "rows", "n", "codes", "counts"])

    for b in batches:
        for s, codes, n in zip(*(b.column(c).to_pylist() for c in ("shard", "codes", "counts"))):
            if s != shard and held:
                yield row()
                held, size = [], 0
            shard = s
            held.append((np.frombuffer(codes, np.int64), np.frombuffer(n, np.int64)))
            size += len(held[-1][0])
            if size > 4 * SHARD_ROWS:  # what is the same in many tasks takes no room
                held = [combine()]
                size = len(held[0][0])
    if held:
        yield row()


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that have the same ``at``."""
    out = np.zeros((size, *rows.shape[1:]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        sorted_ = at[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        out[sorted_[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Bilinear:
    """The parameters and their training."""

    NAMES = ("r", "v", "c1", "c2", "bias")

    def __init__(self, shape: Shape, unigram: np.ndarray) -> None:
        rng = np.random.default_rng(shape.seed)
        k, d = shape.symbols, shape.dim
        self.shape, self.unigram = shape, unigram
        self.r, self.v = (rng.normal(0, 0.1, (k, d)).astype(np.float32) for _ in range(2))
        self.c1, self.c2 = ((np.eye(d) + rng.normal(0, 0.02, (d, d))).astype(np.float32) for _ in range(2))
        self.bias = np.log(unigram).astype(np.float32)

    def values(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def set(self, values: list[np.ndarray]) -> None:
        for n, x in zip(self.NAMES, values):
            setattr(self, n, x)

    def context(self, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        return self.r[s1] @ self.c1 + self.r[s2] @ self.c2

    def normalisers(self, s1: int) -> np.ndarray:
        """log of the sums over all symbols, after s1 and each symbol; START is never predicted."""
        x = (self.r @ self.c2 + self.r[s1] @ self.c1) @ self.v.T + self.bias
        x[:, START] = -np.inf
        most = x.max(axis=1, keepdims=True)
        return (np.log(np.exp(x - most).sum(axis=1, dtype=np.float64)) + most[:, 0]).astype(np.float32)

    def train(self, codes: np.ndarray, counts: np.ndarray, seed: int, rate: float, mean: float | None = None) -> None:
        """Adam on noise-contrastive batches of distinct trigrams, weighted by their counts (in units of ``mean``)."""
        shape, k = self.shape, self.shape.symbols
        rng, mean = np.random.default_rng(seed), mean or counts.mean()
        # Each distinct trigram is a row with its count as weight; large counts are split over several rows, so that a batch's weights stay even.
        times = np.ceil(counts / (SPLIT * mean)).astype(np.int64)
        codes, weights = np.repeat(codes, times), np.repeat((counts / times / mean).astype(np.float32), times)
        steps_each = -(-len(codes) // shape.batch)
        passes = max(1, -(-shape.least_steps // steps_each))
        m, u, t = [np.zeros_like(x) for x in self.values()], [np.zeros_like(x) for x in self.values()], 0
        total = steps_each * passes
        log_noise = np.log(shape.noise * self.unigram).astype(np.float32)
        for step in range(total):
            if step % steps_each == 0:
                order = rng.permutation(len(codes))
            rows = order[step % steps_each :: steps_each]
            code, share = codes[rows], weights[rows] / weights[rows].size
            s1, s2, w = code // (k * k), code // k % k, code % k
            noise = rng.choice(k, shape.noise, p=self.unigram)
            r1, r2 = self.r[s1], self.r[s2]
            q = r1 @ self.c1 + r2 @ self.c2
            pos = (q * self.v[w]).sum(axis=1) + self.bias[w] - log_noise[w]
            neg = q @ self.v[noise].T + self.bias[noise] - log_noise[noise]
            gp = (1 / (1 + np.exp(-np.clip(pos, -30, 30))) - 1) * share
            gn = 1 / (1 + np.exp(-np.clip(neg, -30, 30))) * share[:, None]
            dq = gp[:, None] * self.v[w] + gn @ self.v[noise]
            dv = _summed(gp[:, None] * q, w, k) + _summed(gn.T @ q, noise, k)
            db = _summed(gp, w, k) + _summed(gn.sum(axis=0), noise, k)
            dr = _summed(dq @ self.c1.T, s1, k) + _summed(dq @ self.c2.T, s2, k)
            t += 1
            for x, g, a, b in zip(self.values(), (dr, dv, r1.T @ dq, r2.T @ dq, db), m, u):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= rate * (1 - step / (total + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def _trained(batches: Iterator[pa.RecordBatch], shape: Shape, unigram: np.ndarray, values: list[np.ndarray], k: int, mean: float) -> Iterator[pa.RecordBatch]:
    """(shard, weight, flat): the parameters after training on each shard."""
    for b in batches:
        for shard, codes, counts in zip(*(b.column(c).to_pylist() for c in ("shard", "codes", "counts"))):
            own, n = Bilinear(shape, unigram), np.frombuffer(counts, np.int64)
            own.set([x.copy() for x in values])
            own.train(np.frombuffer(codes, np.int64), n, shard + 7919 * k, shape.rate / (1 + k), mean)
            flat = np.concatenate([x.ravel() for x in own.values()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n.sum())]), pa.array([flat.tobytes()], pa.binary())], names=["shard", "weight", "flat"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums over the shards of each group; rows come by group and shard."""
    group, total, weight = None, None, 0.0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["grp", "weight", "flat"])

    for b in batches:
        for g, w, flat in zip(*(b.column(c).to_pylist() for c in ("grp", "weight", "flat"))):
            if g != group:
                if group is not None:
                    yield row()
                group, total, weight = g, 0.0, 0.0
            total, weight = total + w * np.frombuffer(flat, np.float32).astype(np.float64), weight + w
    if group is not None:
        yield row()


@dataclass
class Trained:
    """What scoring needs: parameters, frequent words, sums."""

    shape: Shape
    values: list[np.ndarray]
    unigram: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    end_count: int
    normalisers: np.ndarray
    words: DataFrame

    def lexicon(self) -> Lexicon:
        return Lexicon(self.shape, self.hashes, self.counts)

    def log_table(self) -> np.ndarray:
        """log10 P(symbol | s1, s2), row s1 * symbols + s2; symbols to the third, for small models."""
        b, k = Bilinear(self.shape, self.unigram), self.shape.symbols
        b.set(self.values)
        x = ((b.r @ b.c1)[:, None] + (b.r @ b.c2)[None]).reshape(k * k, -1) @ b.v.T + b.bias
        x[:, START] = -np.inf
        return (x - self.normalisers[:, None]) / np.float32(np.log(10))


def train(docs: DataFrame, scratch: Scratch, shape: Shape = Shape(), text: str = "text") -> Trained:
    """``docs``: the training documents."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    words = texts.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = scratch.save(words.withColumn("cls", F.col("h").bitwiseAND(END_CLASS).cast("int")), "words")
    class_rows = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # 2,048 rows
    tokens, distinct = sum(r.n for r in class_rows), sum(r.v for r in class_rows)
    end_count = sum(r.n for r in class_rows if r.cls == END_CLASS)
    shape = shape.grown(tokens)
    # The most frequent words, at most ``frequent``: those whose count passes a level, from a histogram of count levels.
    level = F.floor(F.log2("n") * 8)
    room, least = shape.frequent, None
    for r in sorted(words.where(F.col("cls") != END_CLASS).groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # a few hundred rows
        if r["count"] > room:
            break
        room, least = room - r["count"], r.level
    top = words.where(F.col("cls") != END_CLASS).where(level >= least if least is not None else F.lit(False)).select("h", "n", "cls").toPandas()
    top = top.sort_values(["n", "h"], ascending=[False, True])
    hashes, counts = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    class_tokens, class_distinct = np.zeros(shape.classes), np.zeros(shape.classes)
    for r in class_rows:
        if r.cls != END_CLASS:
            class_tokens[r.cls % shape.classes] += r.n
            class_distinct[r.cls % shape.classes] += r.v
    for c, n in zip(top["cls"].to_numpy()[: shape.listed], counts[: shape.listed]):
        class_tokens[c % shape.classes] -= n
        class_distinct[c % shape.classes] -= 1
    unigram = np.zeros(shape.symbols)
    unigram[END] = end_count
    unigram[2 : 2 + min(shape.listed, len(counts))] = counts[: shape.listed]
    unigram[2 + shape.listed :] = class_tokens
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()

    shared = docs.sparkSession.sparkContext.broadcast((hashes, counts))  # at most ``frequent`` pairs of numbers
    shards = max(1, -(-min(int(tokens), shape.symbols**3) // SHARD_ROWS))
    grams = texts.mapInArrow(lambda b: _trigrams(b, Lexicon(shape, *shared.value), shards), "shard int, codes binary, counts binary")
    grams = grams.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merged, "shard int, rows long, n long, codes binary, counts binary")
    grams = scratch.save(grams, "trigrams")
    model = Bilinear(shape, unigram)
    size = grams.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()
    for k in range(shape.rounds if size.rows else 0):
        values, mean = model.values(), size.n / size.rows
        each = grams.select("shard", "codes", "counts").mapInArrow(lambda b, k=k, values=values, mean=mean: _trained(b, shape, unigram, values, k, mean), "shard int, weight double, flat binary")
        each = scratch.save(each, f"trained{k}")
        grouped = each.withColumn("grp", F.col("shard") % AVERAGES).repartition(AVERAGES, "grp").sortWithinPartitions("grp", "shard").select("grp", "weight", "flat")
        got = sorted(grouped.mapInArrow(_averaged, "grp int, weight double, flat binary").collect(), key=lambda r: r.grp)  # at most AVERAGES rows
        total = sum(r.weight for r in got)
        flat = sum(np.frombuffer(r.flat, np.float64) for r in got) / total
        new, at = [], 0
        for x in model.values():
            new.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        model.set(new)
    values = model.values()

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bilinear(shape, unigram)
        own.set(values)
        for b in batches:
            for s1 in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([s1]), pa.array([own.normalisers(s1).tobytes()], pa.binary())], names=["s1", "z"])

    rows = docs.sparkSession.range(0, shape.symbols, 1, max(1, shape.symbols // 128)).mapInArrow(normalised, "s1 long, z binary").collect()  # symbols squared numbers
    z = np.concatenate([np.frombuffer(r.z, np.float32) for r in sorted(rows, key=lambda r: r.s1)])
    return Trained(shape, values, unigram, hashes, counts, int(tokens), int(distinct), class_tokens, class_distinct, int(end_count), z, words)


_tables: dict[str, tuple] = {}


def score(docs: DataFrame, model: Trained, scratch: Scratch, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (of ``keep``, else of all columns), n_tokens, n_known, base_score, score."""
    shape = model.shape
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = packed.drop("text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("model", "double")):
        schema = schema.add(name, kind)
    schema = schema.add("rare", ArrayType(LongType())).add("times", ArrayType(IntegerType()))
    parts = (model.shape, model.values, model.normalisers, model.hashes, model.counts)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    tag = scratch.root
    log_all = np.log10(model.tokens + model.distinct + 1)
    log_class = np.log10(model.class_tokens + model.class_distinct + 1)
    end_log = np.log10(model.end_count + 1)
    end_known = model.end_count > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _tables:
            _tables.clear()
            shape_, (r, v, c1, c2, bias), z, hashes, counts = shared.value
            _tables[tag] = (r @ c1, r @ c2, v, bias, z, Lexicon(shape_, hashes, counts))
        before, last, v, bias, z, lexicon = _tables[tag]
        classed_from = 2 + shape.listed
        for b in batches:
            texts, each = b.column("text").to_pylist(), []
            for i, j in _pieces(texts):
                symbol, context, hashes, counts, first = lexicon.read(texts[i:j])
                sums = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023  each text has its end at least
                known, end = counts >= 0, counts == -2
                logs = np.log10(np.maximum(counts, 0) + 1.0)
                logs[end] = end_log
                q = before[context // shape.symbols] + last[context % shape.symbols]
                value = (np.einsum("ij,ij->i", q, v[symbol]) + bias[symbol] - z[context]) / np.log(10)
                value, classed = value.astype(np.float64), symbol >= classed_from
                value[classed] += logs[classed] - log_class[symbol[classed] - classed_from]
                n = np.diff(np.append(first, len(symbol)))
                rare = counts == -1
                text_of = np.repeat(np.arange(len(first)), n)[rare]
                order = np.lexsort((hashes[rare], text_of))
                rh, rt = hashes[rare][order], text_of[order]
                new = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (rt[1:] != rt[:-1])])) if len(rh) else np.zeros(0, int)
                offsets = np.searchsorted(rt[new], np.arange(len(first) + 1)).astype(np.int32)
                times = np.diff(np.append(new, len(rh))).astype(np.int32)
                each.append((n, sums(known.astype(np.int64)) + end_known, sums(logs) - n * log_all, sums(value), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rh[new])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))))
            if each:
                cols = [pa.array(np.concatenate([e[x] for e in each])) for x in range(4)] + [pa.concat_arrays([e[x] for e in each]) for x in (4, 5)]
                yield pa.RecordBatch.from_arrays([b.column("row"), *cols], names=["row", "n_tokens", "n_known", "base", "model", "rare", "times"])

    scored = scratch.save(packed.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    spots = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("h"), "r.times")
    looked = spots.join(model.words.select("h", "n"), "h")  # unseen words add log10(0 + 1)
    sums = looked.groupBy("rid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.drop("rare", "times").join(sums, "rid", "left")
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return out.select("row", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
