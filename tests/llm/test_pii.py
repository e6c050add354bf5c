import hashlib
import random
import re

from tiergraph.llm import pii as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "é", "@", ".", "-", " ", "+1", "(", "127.0.0.1", "0255", "256", "4111 1111 1111 1111", "x.y@b-c.de", "12", "7", "+44 20 7946 0958", "@b.c", "%", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert P.base_spans(text) == brute(text), text
    long = "a" * 200_000 + "9" * 100_000 + "." * 10
    assert P.base_spans(long) == []


def test_disclosing_terms(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"common{rng.randrange(60)}" for _ in range(n))
    rows = [(i, say(30)) for i in range(200)]
    rows += [(500 + i, f"{say(6)} Zorblax {say(2)} boss@corp.example.com {say(8)}") for i in range(8)]
    rows += [(600, f"{say(9)} and zorblax came {say(4)}")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, key int, spans string")
    spans, terms = P.find_pii(docs)
    assert {r.term for r in terms.collect()} == {"zorblax"}
    by = {r.id: r for r in spans.collect()}
    assert len(by) == len(rows) and all(by[i].terms is None for i in range(200))
    text = dict(rows)[600]
    assert [text[s.start : s.end] for s in by[600].terms] == ["zorblax"]
    out = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert all("boss@" not in t and "orblax" not in t for t in out.values())
    assert "<EMAIL>" in out[503] and out[7] == dict(rows)[7] and P.sanitise(docs).columns == docs.columns
    #: Copies of one passage are one surrounding.
    copies = spark.createDataFrame([(i, f"{say(12)} one more and then Quux mail a@b.cd here is all of it now {'y' * i}") for i in range(30)], "doc_id long, text string")
    assert P.find_pii(copies.union(docs.select("doc_id", "text").limit(100)))[1].count() == 0


def test_sanitise_cuts_what_overlaps_and_keeps_the_rest(spark):
    rows = [(1, "ip 10.0.0.1, card 4111 1111 1111 1111!"), (2, None), (3, ""), (None, "é a@b.cd é"), (None, "é a@b.cd é"), (4, "+4111111111111 1 x"), (5, "w " * 50_000 + "q@r.st")]
    got = sorted(((str(r.doc_id), r.text) for r in P.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got[0] == ("1", "ip <IP>, card <CARD>!") and got[1] == ("2", None) and got[2] == ("3", "")
    assert got[4][1].endswith("w <EMAIL>") and got[5:] == [("None", "é <EMAIL> é")] * 2
    assert P.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest_columns(spark):
    from pyspark.sql import functions as F

    text = "a@b.cd 1.2.3.4"
    spans, _ = P.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert spans.select(F.sha2(P.spans_text(F.col("spans")), 256)).first()[0] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()


def test_a_term_beside_the_entity_of_one_document_discloses(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"common{rng.randrange(60)}" for _ in range(n))
    rows = [(i, say(20)) for i in range(1_500)]
    rows += [(2_000, f"{say(6)} Zorblax Ky 9th {say(2)} boss@corp.example.com {say(8)} +44 20 7946 0958"), (2_001, f"{say(4)} zorblax {say(4)}"), (2_002, f"7 {say(3)} 12x9 x@y.zz 10.0.0.1 ky")]
    spans, terms = P.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    #: zorblax and ky are in two documents; what is within a span is no term.
    assert {r.term: r.kind for r in terms.collect()} == {"9th": "term", "12x9": "term", "7": "term"}
    text = dict(rows)
    got = {r.id: [text[r.id][s.start : s.end] for s in r.terms] for r in spans.where("terms is not null").collect()}
    assert got == {2_000: ["9th"], 2_002: ["7", "12x9"]}
