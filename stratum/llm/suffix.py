"""Suffix arrays by linear grouping, and the removal of long repeated substrings with them.

``suffix_array`` sorts suffixes in two passes without recursion or renaming. A suffix's Lyndon prefix is its
longest prefix that is a Lyndon word. First all suffixes are grouped by it: groups are processed from the
greatest to the least; for each suffix of the group the previous-smaller pointer finds the nearest suffix to the
left in a lower group, whose Lyndon prefix grows by that of the group, and which therefore moves to
the upper end of its own group (the further, the more often it grows). Then the order within groups is
emitted: from the least suffix up, the suffix before each one and its chain of previous-smaller
suffixes, as far as they aren't placed, take the next places of their groups.

Repeats. A byte goes if a string of ``length`` bytes that starts elsewhere too covers it.

1. Anchors: positions whose ``gram``-byte hash is the least in a window of length - gram + 1 positions. Every
   string of ``length`` bytes holds one, and equal strings hold it at the same place. The region of an anchor
   at x is all that such strings can reach, [x - length + gram, x + length).
2. Anchors whose gram hash occurs once are dropped; equal regions are one, with a count. A region that
   occurs twice is a repeat as a whole.
3. Different regions of one gram, fetched from the texts, are cut into tokens at content-defined places before x
   and at x, where the last one starts. Tokens are ranked by gram, offset and bytes (with a few bytes beyond, so that none is another's prefix), so the
   suffix array of the ranks is that of the bytes at those places and sets only aligned strings against each other.
   Neighbours in it are one run as long as their common prefix has all that a string of ``length`` bytes from before this token needs. A string
   that starts between the token before and this one stands in another region only if that one is in the same run, so the windows of
   a run that start there are matched by their hashes, and the outermost matches of each region are compared byte by byte.
4. Intervals are brought back to all occurrences, united, and cut out of the texts.

Equal texts, regions and grams are combined before each shuffle. A task gets whole gram groups and works on blocks
of them. A group of more than ``TASK_REGIONS`` regions is never gathered: its window hashes are counted by a distributed aggregate.

Null text is empty. Texts shorter than ``length`` keep all. Repeated rows are repeats of each other. Periodic texts
may have an anchor at each period; equal regions within a text are combined where they arise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import whole
from stratum.llm.shingles import U, mix, release
from stratum.scratch import Scratch, is_small

_BYTE = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
TASK_REGIONS = 15_000
#: Positions hashed at once.
HASHED = 1 << 18
BLOCK_REGIONS = 2_000
TOKEN_GRAM, TOKEN_MASK = 8, 63
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    gram: int = 128

    @property
    def reach(self) -> int:
        """Bytes before an anchor that a string holding its gram can reach."""
        return self.length - self.gram


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes in order; an end before all symbols is understood."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, {}
    start = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            end[start] = k
            start = k
        place[s], group[s] = k, start
    if n:
        end[start] = n
    before = [-1] * n
    top = n
    while top:
        start = group[order[top - 1]]
        members = order[start:top]
        if len(members) == 1:
            s = members[0]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            grown = {p: 1} if p >= 0 else {}
        else:
            members.sort()
            grown = {}
            for s in members:
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in grown.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for p in by_times[times]:
                g = group[p]
                # Swap p to the upper end of its group, below what has moved in this turn.
                k = moved.get(g, 0) + 1
                moved[g] = k
                to = end[g] - k
                other, at = order[to], place[p]
                order[to], order[at] = p, other
                place[p], place[other] = to, at
            for g, k in moved.items():
                stop = end[g]
                if stop - k > g:
                    end[stop - k] = stop
                    end[g] = stop - k
                    for p in order[stop - k : stop]:
                        group[p] = stop - k
        top = start
    out, placed, free = [0] * n, bytearray(n), {}
    follower, k = n, 0
    while True:
        p = follower - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            at = free.get(g, g)
            free[g] = at + 1
            out[at] = p
            p = before[p]
        if k == n:
            return out
        follower = out[k]
        k += 1


# Anchors and regions.


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, U)
    x, size = _BYTE[data], 1
    total, done = None, 0
    while True:  # substrings of length 1, 2, 4, ..., put together by the bits of gram
        if gram & size:
            part = x[done : done + n]
            total = part.copy() if total is None else total * U(pow(_BASE, size, 1 << 64)) + part
            done += size
        if size * 2 > gram:
            return mix(total)
        x = x[:-size] * U(pow(_BASE, size, 1 << 64)) + x[size:]
        size *= 2


def _chunked_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """:func:`gram_hashes` of a long array, a piece at a time: besides the result some 10 MB."""
    n = max(len(data) - gram + 1, 0)
    out = np.empty(n, U)
    for i in range(0, n, HASHED):
        out[i : i + HASHED] = gram_hashes(data[i : i + HASHED + gram - 1], gram)
    return out


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over each ``w`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, U(fill), U)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    head = pick.accumulate(rows, axis=1).ravel()
    tail = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(tail[: n - w + 1], head[w - 1 : n])


def anchors(data: np.ndarray, r: Repeats) -> np.ndarray:
    """Positions whose gram hash is the least of some window of positions; all of them where several are."""
    h, w = gram_hashes(data, r.gram), r.length - r.gram + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
    around = np.zeros(len(least) + 2 * (w - 1), U)
    around[w - 1 : w - 1 + len(least)] = least
    return np.nonzero(h == _sliding(around, w, np.maximum, 0))[0]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _regions(text: str | None, r: Repeats) -> dict[tuple[int, int], list[int]]:
    """(gram hash, region hash) -> anchors."""
    raw = (text or "").encode()
    found: dict[tuple[int, int], list[int]] = {}
    if len(raw) < r.length:
        return found
    for x in anchors(np.frombuffer(raw, np.uint8), r).tolist():
        a, b = max(0, x - r.reach), min(len(raw), x + r.length)
        key = (_signed(xxhash.xxh3_64_intdigest(raw[x : x + r.gram])), _signed(xxhash.xxh3_64_intdigest(raw[a:b], seed=(x - a) << 32 | (b - x))))
        found.setdefault(key, []).append(x)
    return found


# Regions of one gram against each other.


def _by_bytes(regions: list[tuple[int, bytes]], r: Repeats) -> list[tuple[int, int] | None]:
    """What is shared, from all windows themselves: the way out where two hashes are equal by chance."""
    seen: dict[tuple[int, bytes], int] = {}
    for left, data in regions:
        for k in range(len(data) - r.length + 1):
            window = (k - left, data[k : k + r.length])
            seen[window] = seen.get(window, 0) + 1
    out = []
    for left, data in regions:
        hit = [k - left for k in range(len(data) - r.length + 1) if seen[k - left, data[k : k + r.length]] > 1]
        out.append((-min(hit), max(hit) + r.length) if hit else None)
    return out


def _runs(flat: list[tuple[int, int, bytes]], joined: np.ndarray, r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in the order of the suffix array: region, offset in the region, window starts that belong to it (from the token before on), and the
    number of its run, within which neighbours share all bytes that a repeat over this token needs."""
    cuts = np.nonzero((_chunked_hashes(joined, TOKEN_GRAM) & U(TOKEN_MASK)) == 0)[0]
    size = np.array([len(d) for _, _, d in flat])
    at = np.cumsum(size) - size
    left = np.array([x for _, x, _ in flat])
    lows, highs = np.searchsorted(cuts, at).tolist(), np.searchsorted(cuts, at + left).tolist()
    relative = (cuts - at[np.minimum(np.searchsorted(at, cuts, side="right") - 1, len(at) - 1)]).tolist()
    keys: list[bytes] = []
    region, offset, gap = [], [], []
    widest: dict[bytes, int] = {}
    for i, (g, x, data) in enumerate(flat):
        places, head, last = [*relative[lows[i] : highs[i]], x], g.to_bytes(4, "big"), -1
        for p, q in zip(places, [*places[1:], len(data)]):
            place = head + (p - x + (1 << 20)).to_bytes(4, "big")
            keys.append(place + data[p : q + TOKEN_GRAM])
            if p - last > widest.get(place, 0):
                widest[place] = p - last
            region.append(i)
            offset.append(p)
            gap.append(p - last)
            last = p
    rank = {k: j for j, k in enumerate(sorted(set(keys)))}
    order = suffix_array([rank[k] for k in keys])
    new, before, shared = [], b"", b""
    for a in order:
        place, p = keys[a][:8], offset[a]
        part = flat[region[a]][2][p : p + r.length - widest[place] + 1]
        new.append(place != before or part != shared or len(part) < r.length - widest[place] + 1)
        before, shared = place, part
    order = np.array(order)
    return np.array(region)[order], np.array(offset)[order], np.array(gap)[order], np.cumsum(new)


def shared_by_regions(groups: list[list[tuple[int, bytes]]], r: Repeats, settled: list[list[bool]] | None = None) -> list[list[tuple[int, int] | None]]:
    """For each region of each group how many bytes before x and from x on are in strings that another region of the group has at the same place.
    ``settled`` regions are only compared with; nothing is returned for them."""
    flat = [(g, left, data) for g, group in enumerate(groups) for left, data in group]
    if not flat:
        return [[] for _ in groups]
    open_ = ~np.array([x for group in settled for x in group], bool) if settled else np.ones(len(flat), bool)
    joined = np.frombuffer(b"".join(d for _, _, d in flat) + bytes(TOKEN_GRAM), np.uint8)
    region, offset, gap, run = _runs(flat, joined, r)
    sizes, wanted = np.bincount(run), np.bincount(run, weights=open_[region])
    use = (sizes[run] > 1) & (wanted[run] > 0)
    region, offset, gap, run = region[use], offset[use], gap[use], run[use]
    size, left = np.array([len(d) for _, _, d in flat]), np.array([x for _, x, _ in flat])
    start = np.cumsum(size) - size
    first = offset - gap + 1
    n = np.maximum(np.minimum(offset, size[region] - r.length) - first + 1, 0)
    use = n > 0
    region, first, run, n = region[use], first[use], run[use], n[use]
    reach: list[tuple[int, int] | None] = [None] * len(flat)
    if len(n):
        token = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + first[token]  # window starts in their regions
        of = region[token]
        place = s - left[of]
        h = _chunked_hashes(joined, r.length)
        key = mix(h[start[of] + s] + mix((run[token].astype(np.int64) * 4096 + place + 2048).view(U)))
        del h, token
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        partner = np.full(len(order), -1)
        partner[order[1:][same]] = order[:-1][same]
        partner[order[:-1][same]] = order[1:][same]
        hit = np.flatnonzero((partner >= 0) & open_[of])
        hit = hit[np.lexsort((place[hit], of[hit]))]
        heads = np.flatnonzero(np.concatenate([[True], of[hit][1:] != of[hit][:-1]])) if len(hit) else hit
        doubtful = set()
        for a, b in zip(hit[heads].tolist(), hit[np.append(heads[1:] - 1, len(hit) - 1)].tolist() if len(hit) else []):
            i = int(of[a])
            reach[i] = (int(-place[a]), int(place[b]) + r.length)
            for k in (a, b):
                j, mine, theirs = int(of[partner[k]]), int(s[k]), int(s[partner[k]])
                if flat[i][2][mine : mine + r.length] != flat[j][2][theirs : theirs + r.length]:
                    doubtful.add(flat[i][0])
    out, at = [], 0
    for g, group in enumerate(groups):
        part = _by_bytes(group, r) if len(n) and g in doubtful else reach[at : at + len(group)]
        out.append([x if o else None for x, o in zip(part, open_[at : at + len(group)])])
        at += len(group)
    return out


# Spark.

OCCURRENCES = "k1 long, k2 long, g long, rh long, xs array<int>"


def _find(batches: Iterator[pa.RecordBatch], r: Repeats) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k1, k2, g, rh, xs) for k1, k2, t in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text"))) for (g, rh), xs in _regions(t, r).items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["k1", "k2", "g", "rh", "xs"])
    release()


def _cut_regions(batches: Iterator[pa.RecordBatch], r: Repeats) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            raw = text.encode()
            for w in wanted:
                a = max(0, w["x"] - r.reach)
                rows.append((w["g"], w["rh"], w["whole"], w["x"] - a, raw[a : w["x"] + r.length]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], names=["g", "rh", "whole", "left", "data"])


def _compare(batches: Iterator[pa.RecordBatch], r: Repeats) -> Iterator[pa.RecordBatch]:
    """Rows come with the regions of a gram together."""
    groups: list[list[tuple]] = []
    size, last = 0, None

    def results():
        found = shared_by_regions([[(left, data) for _, _, _, left, data in g] for g in groups], r, [[x[2] for x in g] for g in groups])
        rows = [(g, rh, *x) for group, xs in zip(groups, found) for (g, rh, *_), x in zip(group, xs) if x]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["g", "rh", "before", "after"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("g", "rh", "whole", "left", "data"))):
            if row[0] != last:
                if size >= BLOCK_REGIONS:
                    yield results()
                    groups, size = [], 0
                groups.append([])
                last = row[0]
            groups[-1].append(row)
            size += 1
    if groups:
        yield results()
    release()


def _window_rows(batches: Iterator[pa.RecordBatch], r: Repeats) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g, rh, at, h = [], [], [], []
        for gram, region, left, data in zip(*(b.column(c).to_pylist() for c in ("g", "rh", "left", "data"))):
            x = gram_hashes(np.frombuffer(data, np.uint8), r.length)
            g.append(np.full(len(x), gram))
            rh.append(np.full(len(x), region))
            at.append(np.arange(len(x), dtype=np.int32) - left)
            h.append(x.view(np.int64))
        if g:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (g, rh, at, h)], names=["g", "rh", "at", "h"])


def _remove(text: str | None, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, maximal removed runs, rest)."""
    raw = (text or "").encode()
    kept, removed, runs, at = [], 0, 0, 0
    for a, b in sorted((s["a"], min(s["b"], len(raw))) for s in spans or ()):
        if b <= at and runs:
            continue
        if a > at or not runs:
            kept.append(raw[at:a])
            runs += 1
        else:
            a = at
        removed += b - a
        at = b
    kept.append(raw[at:])
    return len(raw), removed, runs, b"".join(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_remove(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
        cols = list(zip(*rows)) if rows else [[]] * 4
        digests = [hashlib.sha256(x).hexdigest() for x in cols[3]]
        yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(digests, pa.string()), pa.array(cols[3], pa.binary()), pa.array([x.decode(errors="replace") for x in cols[3]], pa.string())], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def repeated_spans(docs: DataFrame, scratch: Scratch, r: Repeats = Repeats(), text: str = "text") -> DataFrame:
    """(k1, k2, spans): for the digest of each text with repeats the byte intervals to remove, overlapping ones too."""
    t = whole(F.col(f"`{text}`").cast("string"))
    keyed = docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), t.alias("text")).where(F.octet_length("text") >= r.length)
    all_ = scratch.save(keyed.mapInArrow(lambda b: _find(b, r), OCCURRENCES), "occurrences")
    # Grams that occur twice: equal grams of one text count where they stand in different regions, too.
    many = all_.groupBy("g").agg(F.sum(F.size("xs")).alias("n")).where("n > 1").select("g")
    many = scratch.save(many, "many")
    # Equal texts give equal rows: each counts for the regions' numbers, one is enough to bring intervals back.
    # The shuffle between join and aggregate lets adaptive execution split the join where a gram is very common.
    rows = all_.join(many, "g").repartition("g", "rh", "k1", "k2").groupBy("g", "rh", "k1", "k2").agg(F.first("xs").alias("xs"), F.sum(F.size("xs")).alias("n"))
    rows = scratch.save(rows, "candidates")
    scratch.drop("occurrences")
    regions = rows.groupBy("g", "rh").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", F.get("xs", F.lit(0)).alias("x"))).alias("one"))
    regions = scratch.save(regions, "regions")
    # A group has something to find if it has different regions and one of them isn't a repeat as a whole.
    several = scratch.save(regions.groupBy("g").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("g", "d"), "several")
    wanted = regions.join(several, "g").select("one.k1", "one.k2", F.struct("g", "rh", (F.col("n") > 1).alias("whole"), "one.x").alias("w"))
    wanted = scratch.save(wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")), "wanted")
    keys = wanted.select("k1", "k2")
    some = keyed.join(F.broadcast(keys) if is_small(keys, BROADCAST_KEYS) else keys, ["k1", "k2"], "left_semi")
    fetched = some.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])
    cut = fetched.select("text", "wanted").mapInArrow(lambda b: _cut_regions(b, r), "g long, rh long, whole boolean, left int, data binary")
    large = scratch.save(several.where(F.col("d") > TASK_REGIONS).select("g"), "large")
    compare = lambda df: df.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _compare(b, r), "g long, rh long, before int, after int")
    if large.limit(1).count() == 0:
        shared = compare(cut)
    else:
        cut = scratch.save(cut, "cut")
        windows = cut.join(large, "g", "left_semi").mapInArrow(lambda b: _window_rows(b, r), "g long, rh long, at int, h long")
        twice = windows.groupBy("g", "at", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "at", "h")
        counted = windows.join(twice, ["g", "at", "h"]).groupBy("g", "rh").agg((-F.min("at")).cast("int").alias("before"), (F.max("at") + r.length).cast("int").alias("after"))
        shared = compare(cut.join(large, "g", "left_anti")).union(counted)
    shared = scratch.save(shared, "shared")
    extents = regions.select("g", "rh", "n").join(shared, ["g", "rh"], "left")
    extents = extents.select("g", "rh", F.when(F.col("n") > 1, F.lit(r.reach)).otherwise(F.col("before")).alias("before"), F.when(F.col("n") > 1, F.lit(r.length)).otherwise(F.col("after")).alias("after")).where("before IS NOT NULL")
    # Written before the join, so that adaptive execution can split it where a region stands in very many texts.
    extents = scratch.save(extents, "extents")
    spots = rows.join(extents, ["g", "rh"]).select("k1", "k2", F.explode("xs").alias("x"), "before", "after")
    spans = F.struct(F.greatest(F.col("x") - F.col("before"), F.lit(0)).alias("a"), (F.col("x") + F.col("after")).alias("b"))
    return scratch.save(spots.groupBy("k1", "k2").agg(F.collect_set(spans).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, r: Repeats = Repeats(), label: str = "repeats", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (of ``keep``, else of all columns), n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and kept_text (the same as text; what isn't UTF-8 any more is replaced); a row for each of ``docs``."""
    scratch = Scratch(docs.sparkSession, label)
    spans = repeated_spans(docs, scratch, r, text)
    t = F.col(f"`{text}`").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), t.alias("text"), F.xxhash64(whole(t)).alias("k1"), F.xxhash64(F.lit(7), whole(t)).alias("k2"))
    joined = packed.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    schema = packed.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary").add("kept_text", "string")
    return joined.mapInArrow(_cut, schema)
