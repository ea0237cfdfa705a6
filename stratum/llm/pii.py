"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Fixed patterns give the base spans (email, ip, card, phone). They are also the seeds of a
bootstrap: the words around a seed form lexical patterns ("two words before", "word before
and word after"); identifier-like strings that no fixed pattern matched are the unknown
instances. Over the graph of patterns and instances Spark repeats: a pattern's confidence for
a kind is the confidence of its instances summed over their number plus ``smoothing``; an
instance's is one minus the product of (1 - confidence) of the sure patterns that it stands in.
Instances that end at ``accept`` or more, and whose digits suit the kind, become added spans
wherever they stand. A pattern needs ``support`` different seeds, so copies of one document
don't make a pattern.

DataFrame functions only. Positions come without Python: the gaps between matches (``split``)
and the matches (``regexp_extract_all``) of one pattern alternate, so their running lengths are
the positions. Regular expressions are possessive and start only where a run starts, so
that a very long word costs linear time. Edges are made distinct before they are scored, each
aggregate combines before its shuffle, and nothing but row counts reaches the driver.

Null text counts as empty and has no spans. Repeated rows are treated one by one (rows are told
apart by a number of their own, not by a column). Candidates are addresses in other spelling (a word with @, (at) or [at];
words with at and dot between them) and runs of up to ``most_words`` words within a run of words with digits, as far as they suit some kind.
Spans never overlap a base span; of added spans that would overlap each other the leftmost stays, of several from one place the longest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.columns import sealed, whole
from stratum.scratch import Scratch

#: Kinds in order, each with its pattern.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"(?=[^0-9\x20\x09-\x0D]*+[0-9])[^\x20\x09-\x0D]++"
#: Runs of words with a digit, one space between them.
_CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD})*+"
#: Addresses in other spelling: a word with @ or (at), or words with at and dot between them.
_AT, _DOT = r"(?:@|\(at\)|\[at\])", r"(?:dot|\(dot\)|\[dot\])"
_LETTERS = r"[^\x20\x09-\x0D]"
_ADDRESS = rf"(?<!{_LETTERS})(?:{_LETTERS}++\x20(?:at|{_AT})\x20{_LETTERS}++(?:\x20{_DOT}\x20{_LETTERS}++)++|{_LETTERS}*?{_AT}{_LETTERS}++)"
_TRIM = "()[]{}<>.,;:!?\"'"
SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"

@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; a pattern's least number of seeds and smoothing; what counts as sure and as accepted."""

    rounds: int = 3
    support: int = 8
    smoothing: float = 2.0
    sure: float = 0.75
    accept: float = 0.75
    #: Characters of text on either side that patterns are taken from; a longer word counts by its part next to the span.
    context: int = 80
    #: An identifier has at most so many words with digits.
    most_words: int = 6


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)

    def add(total, i):
        v = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["text"])


def _located(gaps: Column, found: Column, kind: int) -> Column:
    """Spans of the matches ``found``, which alternate with ``gaps``."""
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m")))

    def step(a, x):
        start = a["at"] + x["gap"]
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])


def _matches(df: DataFrame, regexes: dict[str, str], guards: dict[str, Column]) -> DataFrame:
    """Adds m_<name> and g_<name>: the matches in column t and the gaps around them."""
    none = F.array().cast("array<string>")
    cols = {f"m_{k}": F.when(guards[k], F.regexp_extract_all("t", F.lit(r), 0)).otherwise(none) for k, r in regexes.items()}
    df = df.withColumns(cols)
    return df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", r, -1)).otherwise(none) for k, r in regexes.items()})


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (all columns of ``docs``), t (the whole text) and base: the base spans by start, then kind."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(F.col(f"`{text}`")).alias("t"))
    digit = F.col("t").rlike("[0-9]")
    df = _matches(df, PATTERNS, {"email": F.col("t").contains("@"), "ip": digit, "card": digit, "phone": F.col("t").contains("+")})
    df = df.withColumns({f"s_{k}": F.filter(_located(F.col(f"g_{k}"), F.col(f"m_{k}"), i), _test(k)) for i, k in enumerate(KINDS)})
    base = sealed(F.sort_array(F.concat(*[f"s_{k}" for k in KINDS])))
    return df.select("row", "t", base.alias("base"))


def _contexts(t: Column, start: Column, end: Column, width: int) -> list[Column]:
    """The two lexical patterns around a span: digits as 0, lower case."""
    clean = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "0")
    left = F.substr(t, F.greatest(start - width + 1, F.lit(1)), F.least(start, F.lit(width)))
    right = F.substr(t, end + 1, F.lit(width))
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    one = F.regexp_extract(left, f"({word}+){gap}*$", 1)
    two = F.regexp_extract(left, f"({word}+{gap}+{word}+){gap}*$", 1)
    after = F.regexp_extract(right, f"^{gap}*({word}+)", 1)
    return [F.concat(F.lit("2 "), F.regexp_replace(clean(two), f"{gap}+", " ")), F.concat(F.lit("1 "), clean(one), F.lit(" _ "), clean(after))]


def located(docs: DataFrame, boot: Bootstrap = Bootstrap(), text: str = "text") -> DataFrame:
    """Columns row, base, seeds and others. Seeds and others have start, end, kind (-1: unknown), text and contexts;
    others are the identifier-like runs that touch no base span."""
    df = with_base(docs, text)
    at = F.col("t").contains("@") | F.col("t").contains("(at)") | F.col("t").contains("[at]") | F.col("t").contains(" dot ")
    df = _matches(df, {"c": _CANDIDATE, "e": _ADDRESS}, {"c": F.col("t").rlike("[0-9]"), "e": at})
    b, t = F.col("base"), F.col("t")

    def trimmed(s):
        inner, n = F.ltrim(s["text"], F.lit(_TRIM)), F.char_length(s["text"])
        return F.struct((s["start"] + n - F.char_length(inner)).alias("start"), F.lit(-1).alias("kind"), (s["end"] - n + F.char_length(F.rtrim(s["text"], F.lit(_TRIM)))).alias("end"), F.btrim(s["text"], F.lit(_TRIM)).alias("text"))

    def parts(s):
        """All runs of up to ``most_words`` words within a run."""
        ws = F.split(s["text"], " ")
        ends = F.aggregate(ws, F.array().cast("array<int>"), lambda a, w: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1) + 1, F.lit(0)) + F.char_length(w))))
        first = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
        piece = lambda i, j: F.struct((s["start"] + first(i)).alias("start"), (s["start"] + F.get(ends, j)).alias("end"), F.substr(s["text"], first(i) + 1, F.get(ends, j) - first(i)).alias("text"))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.transform(F.sequence(i, F.least(i + boot.most_words - 1, F.size(ws) - 1)), lambda j: trimmed(piece(i, j)))))

    runs = F.concat(F.flatten(F.transform(_located(F.col("g_c"), F.col("m_c"), -1), parts)), F.transform(_located(F.col("g_e"), F.col("m_e"), -1), trimmed))
    apart = lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    df = df.withColumn("free", F.filter(runs, lambda s: _suits_any(s["text"]) & apart(s)))

    def around(spans):
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], F.lower(s["text"]).alias("text"), F.array(*_contexts(t, s["start"], s["end"], boot.context)).alias("contexts")))

    return df.select("row", "base", sealed(around(b)).alias("seeds"), sealed(around(F.col("free"))).alias("others"))


_SPELLED = r"[a-z0-9](?:@|\x20?(?:\(at\)|\[at\])\x20?)[a-z0-9]|[a-z0-9]\x20at\x20[^\x20]+\x20(?:dot|\(dot\)|\[dot\])\x20[a-z0-9]"


def _suits(kind: Column, text: Column) -> Column:
    n = F.length(_digits(text))
    return F.when(kind == 0, F.lower(text).rlike(_SPELLED)).when(kind == 1, text.rlike(r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}$")).when(kind == 2, n.between(12, 19) & text.rlike("^[0-9 -]+$")).otherwise(n.between(7, 15) & text.rlike("^[0-9 ().+-]+$"))


def _suits_any(text: Column) -> Column:
    """Whether the text could be an identifier of some kind."""
    return _suits(F.lit(0), text) | _suits(F.lit(1), text) | _suits(F.lit(2), text) | _suits(F.lit(3), text)


def bootstrap(found: DataFrame, scratch: Scratch, boot: Bootstrap = Bootstrap()) -> DataFrame:
    """(text, kind, score) of the instances that the patterns accept. ``found``: a written result of :func:`located`."""
    seeds = found.select(F.explode("seeds").alias("s")).select(F.explode("s.contexts").alias("pattern"), F.col("s.text").alias("text"), F.col("s.kind").alias("kind")).distinct()
    others = found.select(F.explode("others").alias("s")).select(F.explode("s.contexts").alias("pattern"), F.col("s.text").alias("text")).distinct()
    by_kind = scratch.save(seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n")), "by_kind")
    patterns = by_kind.groupBy("pattern").agg(F.sum("n").alias("n_seeds"), F.max("n").alias("top")).where(F.col("top") >= boot.support).select("pattern", "n_seeds")
    edges = scratch.save(others.join(patterns.select("pattern"), "pattern"), "edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n_others"))
    nodes = by_kind.join(patterns, "pattern").join(size, "pattern", "left")
    nodes = scratch.save(nodes.select("pattern", "kind", F.col("n").cast("double").alias("own"), (F.col("n_seeds") + F.coalesce("n_others", F.lit(0)) + boot.smoothing).alias("total")), "nodes")
    gained = None
    instances = None
    for k in range(boot.rounds):
        got = F.col("own") if gained is None else F.col("own") + F.coalesce("gained", F.lit(0.0))
        scored = (nodes if gained is None else nodes.join(gained, ["pattern", "kind"], "left")).select("pattern", "kind", (got / F.col("total")).alias("conf")).where(F.col("conf") >= boot.sure)
        hits = edges.join(scored, "pattern").where(_suits(F.col("kind"), F.col("text")))
        each = hits.groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("score"))
        best = each.groupBy("text").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("text", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
        instances = scratch.save(best, f"instances{k}")
        gained = edges.join(instances, "text").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
    return instances.where(F.col("score") >= boot.accept)


def _apart(spans: Column) -> Column:
    """Of spans that overlap each other the leftmost, and of several from one place the longest."""
    by_length = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"], s["text"]))

    def step(a, s):
        free = s["start"] >= a["at"]
        one = F.array(F.struct(s["start"], s["kind"], (-s["back"]).alias("end"), s["text"])).cast(SPAN)
        return F.struct(F.when(free, -s["back"]).otherwise(a["at"]).alias("at"), F.when(free, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.sort_array(by_length), F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])


def find(docs: DataFrame, label: str = "pii", boot: Bootstrap = Bootstrap(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (of ``keep``, else of all columns), base and spans (base and added, by start, then kind; ``text`` in added spans is in lower case)."""
    scratch = Scratch(docs.sparkSession, label)
    row = F.struct(*[F.col("row")[c].alias(c) for c in keep or docs.columns])
    found = scratch.save(located(docs, boot, text).withColumn("row", row).withColumn("rid", F.monotonically_increasing_id()), "found")
    accepted = bootstrap(found, scratch, boot)
    spots = found.select("rid", F.explode("others").alias("s")).select("rid", "s.start", "s.end", "s.text")
    added = spots.join(accepted.select("text", "kind"), "text").where(_suits(F.col("kind"), F.col("text")))
    added = scratch.save(added.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end", "text")).alias("added")), "added")
    joined = found.drop("seeds", "others").join(added, "rid", "left")
    spans = F.sort_array(F.concat("base", F.coalesce(_apart(F.col("added")), F.array().cast(SPAN))))
    return joined.select("row", "base", sealed(spans).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first is replaced, with what the others add."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = whole(text)

    def step(a, s):
        gap = F.substr(t, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        mark = F.when(s["start"] >= a["at"], F.get(names, s["kind"])).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1))))


def redact(docs: DataFrame, label: str = "redact", boot: Bootstrap = Bootstrap(), text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; all rows and columns stay."""
    found = find(docs, label, boot, text).withColumn("clean", sealed(masked(F.col("row")[text], F.col("spans"))))
    return found.select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
