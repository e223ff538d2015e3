import hashlib
import random
import re

from tidemark.llm import pii, queries

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def check(got, texts):
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_query(spark, sf):
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_random_texts(spark):
    rng = random.Random(11)
    bits = ["a", "b.c", "@", ".", "_", "x@y.zz", "1", "23", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "+1 (212) 555-0100", "255", "256", "1.2.3.4", "é", "漢", "\n", "(", ")", "00", "%", ".."]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(40))) for i in range(3000)}
    check(pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_edge_rows(spark):
    long = "a@b." + "c." * 20000 + " " + "1" * 30000 + " " + "1 " * 20000 + "+" + "(" * 30000
    df = spark.createDataFrame([(1, None, 1), (None, "a@b.cc", 2), (2, "", 3), (3, long, 4), (4, "a@b.cc", 5), (4, "a@b.cc", 5)], "doc_id long, text string, base int")
    got = sorted((r.spans for r in pii.find(df).collect()))
    assert got == ["", "", "email:0:40003", "email:0:6", "email:0:6", "email:0:6"]
    assert pii.find(df.limit(0)).count() == 0


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"the text says contact u{i}@mail.example.com urgently ok") for i in range(40)]
    rows += [(100, "she wrote contact u77#mail-example urgently then"), (101, "the bus number42x left")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "context:18:34" and got[101] == ""


def test_context_at_bounds_beside_numbers_and_after_blanks(spark):
    rows = [(i, f"the text says contact u{i}@mail.example.com urgently ok") for i in range(40)]
    mark = "u77#mail-example"
    texts = [f"she wrote contact {mark}", f"she wrote 12 {mark} urgently", f"she wrote contact{' ' * 70}{mark} urgently", f"{mark} urgently", f"see contact {'w' * 90} 5 {mark} urgently now"]
    rows += [(100 + i, t) for i, t in enumerate(texts)] + [(200, "the bus number42x left"), (201, "number42x"), (202, "it left 12 times")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[100 + i] == f"context:{t.index(mark)}:{t.index(mark) + len(mark)}", t
    assert got[200] == got[201] == got[202] == ""


def test_spaced_seeds_induce_patterns(spark):
    rows = [(i, f"please dial +1 (017) 555-{1000 + i} before noon") for i in range(40)] + [(100, "please dial x555-0199 before noon"), (101, "please dial ann@desk before noon")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "context:12:21" and got[101] == "context:12:20" and got[0] == "phone:12:29"
