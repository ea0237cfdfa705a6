import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.llm import pii

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (name, rx) in enumerate(BRUTE.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BRUTE)[k]}:{a}:{b}" for a, k, b in sorted(out))


FIXED = [
    None, "", "a@b.co", "x a@b.co%x@y.z.w, é😀 me+x@mail.example.com.", "a@b@c.de", "1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111114111111111111111", "+1 (377) 555-0271", "+1 (377) 555-0271+44 20 7946 0958x", "+12", "++49-30-901820 (x)",
    "a" * 50_000 + "@", "1" * 30_000, "1." * 5_000, "+1" + " " * 5_000, ("m%d@x.org " % 1) * 500, "😀" * 10 + "10.0.0.1", "@@.. a@-.-",
]


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in pii.with_base(df).select("row.doc_id", pii.written(F.col("base")).alias("s")).collect()}


def test_base_spans_equal_brute_force(spark):
    assert spans(spark, FIXED) == {i: brute(t) for i, t in enumerate(FIXED)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="01259@.+- ()aZ%é😀\n", max_size=60), min_size=40, max_size=80))
def test_base_spans_of_random_texts(spark, texts):
    assert spans(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def corpus(n=24):
    rows = [(i, f"some text {i} then please call me at +1 (377) 555-{1000 + i} for more") for i in range(n)]
    return rows + [(1000, "please call me at 377 555 4242, thanks"), (1001, "the year 2024 was fine"), (1002, None), (1003, "")]


def test_bootstrap_finds_a_number_without_prefix_and_leaves_the_rest(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("base", F.lit("mine"))
    got = {r.doc_id: r.s for r in pii.find(docs).select("row.doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert got[1000] == "phone:18:30" and got[1001] == got[1002] == got[1003] == ""
    assert got[0] == brute(corpus()[0][1])
    clean = {r.doc_id: (r.text, r.base) for r in pii.redact(docs).collect()}
    assert clean[1000] == ("please call me at <PHONE>, thanks", "mine") and clean[1002] == (None, "mine")
    assert clean[3][0] == "some text 3 then please call me at <PHONE> for more"


def test_copies_do_not_make_a_pattern(spark):
    docs = spark.createDataFrame([(i, "please call me at +1 (377) 555-1000 now") for i in range(50)] + [(99, "please call me at 377 555 4242 now")], "doc_id long, text string")
    assert [r.s for r in pii.find(docs).where("row.doc_id = 99").select(pii.written(F.col("spans")).alias("s")).collect()] == [""]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    twice = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "c@d.ef")], "doc_id long, text string")
    assert sorted(r.text for r in pii.redact(twice).collect()) == ["<EMAIL>"] * 3


def test_addresses_without_digits_and_numbers_beside_numbers(spark):
    rows = [(i, f"case {i}: you may write to user{chr(97 + i)}@site.org any day") for i in range(20)]
    rows += [(20 + i, f"some text {i} then please call me at +1 (377) 555-{1000 + i} for more") for i in range(24)]
    rows += [
        (100, "or you may write to jo at example dot org any day"),
        (101, "or you may write to jo(at)localhost any day"),
        (102, "or you may write to jo@localhost any day"),
        (103, "then please call me at 377 555 4242 24/7 for more"),
        (104, "we met at noon dot and dash"),
        (105, "then please call me at 377 555 4242 " + "9" * 90),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(docs).select("row.doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    text = dict(rows)
    assert {k: text[k][int(got[k].split(":")[1]) : int(got[k].split(":")[2])] for k in (100, 101, 102, 103, 105)} == {
        100: "jo at example dot org", 101: "jo(at)localhost", 102: "jo@localhost", 103: "377 555 4242", 105: "377 555 4242",
    }
    assert got[104] == "" and all(got[k].split(":")[0] == ("email" if k < 103 else "phone") for k in (100, 101, 102, 103, 105))
