"""PII: patterns, and information-theoretic sanitisation around them.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each
distinct value found is a protected entity. A term that the corpus keeps using beside
one entity, and hardly elsewhere, tells a reader which entity is meant even when the
value itself is gone. How much it tells is measured over the corpus: with
PMI(e; t) = log2(p(e, t) / (p(e) p(t))) and IC(e) = -log2 p(e), a term discloses the
share PMI / IC of the entity's information, 1 if it occurs with that entity alone.
Terms beyond ``generalise`` are replaced by a class name, beyond ``remove`` removed.

Counts are of documents: p(e) of those that hold the entity, p(t) of those that hold
the term anywhere, p(e, t) of those that hold it within ``near`` words of the entity.
p(e | t) = p(e, t) / p(t) is smoothed by ``prior`` documents in which the entity is as
rare as anywhere: with n = n(e, t) and n' = n(t), it is (n + prior p(e)) / (n' + prior).
Evidence counts once per distinct surrounding, so that copies of one passage do not make
its ordinary words suspicious: n and n' shrink alike until n is the number of these. So
one surrounding discloses less than many do, but is never left out; with the defaults a
term that stands by a single document's entity alone counts from 1,024 documents on.

Defined results: a null or empty text has no spans; repeated rows are scored alike and
count as documents each; an empty table gives an empty result; other columns are passed
on by :func:`sanitise` and ignored by :func:`find_pii`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, write_scratch

#: Spans or terms are broadcast up to so many rows; beyond that they are shuffled.
SMALL_ROWS = 50_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never begins inside a run of digits: the run's start would have matched or failed alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. Each @ looks to its left, so that long runs without one cost nothing."""
    found, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, end := m.end()))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", a, b) for a, b in (find_emails(text) if "@" in text else ())]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _entity(kind: str, value: str) -> str:
    """The same for all spellings of a value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub(r'[^0-9]', '', value)}"


def _blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spaces for its spans: what is in one is replaced anyway, so its words are no terms."""
    out, at = [], 0
    for start, end in sorted((a, b) for _, a, b in spans):
        out += [text[at:start], " " * (end - max(start, at))]
        at = max(at, end)
    return "".join(out) + text[at:]


def surroundings(text: str, spans: list[tuple[str, int, int]], near: int) -> list[tuple[str, str, int]]:
    """(entity, term, surrounding) for the terms within ``near`` words of each span."""
    out, rest = [], _blank(text, spans)
    for kind, start, end in spans:
        reach = 40 * near  # characters; longer words are no terms
        before = [m.group().lower() for m in _TERM.finditer(rest[max(0, start - reach) : start])][-near:]
        after = [m.group().lower() for m in _TERM.finditer(rest[end : end + reach])][:near]
        mark = int.from_bytes(hashlib.blake2b(" ".join([*before, "|", *after]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        entity = _entity(kind, text[start:end])
        out += [(entity, t, mark) for t in dict.fromkeys(before + after)]
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind:string,start:long,end:long>>"


def _find(near: int):
    seen = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("mark", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, beside = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                found = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                beside.append([dict(zip(("entity", "term", "mark"), s, strict=True)) for s in surroundings(text, found, near)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(spans, _SPANS), pa.array(beside, seen)], ["key", "id", "spans", "beside"])

    return run


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, terms) -> where the terms stand."""
    for batch in batches:
        spans = []
        for x, terms in zip(batch.column("text"), batch.column("terms"), strict=True):
            wanted = {t["term"]: t["kind"] for t in terms.as_py()}
            spans.append([{"kind": kind, "start": m.start(), "end": m.end()} for m in _TERM.finditer(x.as_py() or "") if (kind := wanted.get(m.group().lower()))])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, _SPANS)], ["key", "terms"])


def _if_small(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL_ROWS else small


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]++"), F.lit(0)))


def disclosing_terms(found: DataFrame, texts: DataFrame, *, generalise: float, prior: float) -> DataFrame:
    """(term, disclosure) of the terms that disclose an entity by ``generalise`` or more.

    found: key, beside. texts: key, text.
    """
    beside = found.select("key", F.explode("beside").alias("b")).select("key", "b.*")
    joint = write_scratch(beside.groupBy("entity", "term").agg(F.countDistinct("mark").alias("marks"), F.countDistinct("key").alias("n_both")), "joint")
    total = found.count()
    entities = beside.groupBy("entity").agg(F.countDistinct("key").alias("n_entity")).where(F.col("n_entity") < total)

    def disclosure(n_term: str) -> Column:
        seen, rare = F.least("marks", "n_both"), F.col("n_entity") / F.lit(float(total))
        among = F.greatest(seen * F.col(n_term) / F.col("n_both"), seen)
        return 1 - F.log2((seen + F.lit(prior) * rare) / (among + F.lit(prior))) / F.log2(rare)

    #: A term is in no fewer documents than those in which it stands beside any entity: that alone rules out common words.
    besides = beside.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_beside"))
    likely = write_scratch(joint.join(entities, "entity").join(besides, "term").where(disclosure("n_beside") >= generalise), "likely")
    terms = write_scratch(likely.select("term").distinct(), "candidates")
    n_terms = terms.count()
    if not n_terms:
        return likely.select("term", F.lit(0.0).alias("disclosure"))
    every = texts.select(F.explode(_terms(F.col("text"))).alias("term"))
    holding = every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n_term")) if n_terms <= SMALL_ROWS else every.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = likely.join(holding, "term").withColumn("disclosure", disclosure("n_term"))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)


def find_pii(docs: DataFrame, *, near: int = 5, generalise: float = 0.9, remove: float = 0.97, prior: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, terms). spans: key, id, spans (of patterns), terms (of disclosing terms; null for none). terms: term, disclosure, kind (term, or removed-term from ``remove`` on).

    ``key`` is a hash of id and text.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = write_scratch(texts.mapInArrow(_find(near), f"key long, id {kind}, spans {_SPANS_SQL}, beside array<struct<entity:string,term:string,mark:long>>"), "found")
    terms = write_scratch(disclosing_terms(found, texts.select("key", "text"), generalise=generalise, prior=prior).withColumn("kind", F.when(F.col("disclosure") >= remove, "removed-term").otherwise("term")), "terms")
    n_terms = terms.count()
    if not n_terms:
        return found.select("key", "id", "spans", F.lit(None).cast(_SPANS_SQL).alias("terms")), terms
    holders = write_scratch(texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(_if_small(terms, n_terms), "term").groupBy("key").agg(F.collect_set(F.struct("term", "kind")).alias("terms")), "holders")
    located = texts.select("key", "text").join(_if_small(holders, holders.count()), "key").mapInArrow(_locate, f"key long, terms {_SPANS_SQL}").dropDuplicates(["key"])
    return found.select("key", "id", "spans").join(located, "key", "left"), terms


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.coalesce(spans, F.array().cast(_SPANS_SQL)), lambda s: F.concat_ws(":", F.replace(s["kind"], F.lit("removed-"), F.lit("")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the spans in ``text_col`` replaced: patterns and generalised terms by <KIND>, removed terms by nothing."""
    spans, _ = find_pii(docs, id_col=id_col, text_col=text_col, **options)
    every = F.array_sort(F.transform(F.concat("spans", F.coalesce("terms", F.array().cast(_SPANS_SQL))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cuts = write_scratch(spans.where((F.size("spans") > 0) | F.col("terms").isNotNull()).select(F.col("key").alias("__pii_key"), every.alias("__pii_cuts")).dropDuplicates(["__pii_key"]), "cuts")
    rest = docs.withColumn("__pii_key", _key(id_col, text_col)).join(_if_small(cuts, cuts.count()), "__pii_key", "left")
    text = F.col(text_col)

    def step(state: Column, cut: Column) -> Column:
        mark = F.when(cut["kind"] == "removed-term", "").otherwise(F.concat(F.lit("<"), F.upper(cut["kind"]), F.lit(">")))
        kept = F.substring(text, state["at"] + 1, F.greatest(cut["start"] - state["at"], F.lit(0)))
        fresh = F.concat(state["out"], kept, F.when(cut["start"] >= state["at"], mark).otherwise(""))
        return F.struct(fresh.alias("out"), F.greatest(state["at"], cut["end"].cast("int")).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("__pii_cuts", zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rest.withColumn(text_col, F.when(F.col("__pii_cuts").isNull(), text).otherwise(clean)).select(*docs.columns)
