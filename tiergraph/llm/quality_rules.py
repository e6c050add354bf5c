"""Quality rules by weak supervision.

Rules look at one document and vote strongly bad, weakly bad or good, or abstain. No
rule decides by itself: expectation-maximisation over the votes of the whole table
estimates how often each rule votes which way on good documents and on each kind of
bad ones, and a document's posterior probability of being good replaces the demand that
it passes every rule. What some rule dislikes and all others find good is usually better
explained by that rule's rate on good documents; several weak votes of one kind are not.

Bad documents are of several kinds, and a rule that knows one kind finds the others good.
With one bad class the estimate would settle on the commonest kind and all else; so
each kind has a class of its own, told apart by which rules it starts from. Starting
values count as ``strength`` votes, so that on all but tiny tables votes decide.

Documents enter the estimate as counts of equal vote patterns, of which there are at
most 4^rules however large the table is.

Defined results: a null or empty text has no words and fails the base rules; an
empty table gives an empty result; rows that repeat are scored alike, each counted; a
null id is kept as null; very long texts are read whole; :func:`score_quality` returns
the id and its own columns alone, :func:`keep_good` all columns of its input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, write_scratch

_WORD = re.compile(r"[^ \t-\r]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"!!|\?\?")
_BARE = re.compile(r"(?<![^ \t-\r])[^\w \t-\r]+(?![^ \t-\r])")
_STOP = re.compile(r"[.!?](?![^ \t-\r])")
#: The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"
#: Rejected keys are broadcast up to so many rows (some 10 MB); beyond that they are shuffled.
SMALL_ROWS = 200_000

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_bare", "n_stops", "n_distinct_words")


def text_features(text: str | None) -> tuple[int, ...]:
    """The FEATURES of one whole text."""
    text = text or ""
    found = _WORD.findall(text)
    n = len(found)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated = 0
    if n >= 3:
        windows = list(zip(found, found[1:], found[2:], strict=False))
        if len(set(windows)) < len(windows):
            times, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return (
        n, sum(map(len, found)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        len(_UPPER.findall(text)), len(_SHOUT.findall(text)), len(_BARE.findall(text)), len(_STOP.findall(text)), len(set(found)),
    )


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(x.as_py()) for x in batch.column("__text")]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("__key"), *columns], ["__key", *FEATURES])


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).mapInArrow(_featurise, f"__key {key}, " + ", ".join(f"{x} long" for x in FEATURES)).withColumnRenamed("__key", id_col)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


#: Votes; an abstention is -1.
STRONG, WEAK, GOOD = 0, 1, 2
#: What rules of each kind of bad document know best.
KINDS = {"brevity": ("length",), "noise": ("word_length", "symbols", "bare_symbols"), "repetition": ("repeats", "variety"), "shouting": ("capitals", "shouts", "sentences")}
#: Starting rates of strong, weak and good votes: on good documents, on a kind by its own rules, and by the others.
ON_GOOD, BY_OWN, BY_OTHERS = (0.01, 0.06, 0.93), (0.5, 0.3, 0.2), (0.03, 0.12, 0.85)


def rules() -> dict[str, tuple[Column, Column, Column]]:
    """By name: when a rule votes strongly bad, else weakly bad, else good; else it abstains."""
    n, length = F.col("n_words"), _ratio("word_chars", "n_words")
    symbols, repeats = _ratio("n_symbols", "word_chars"), _ratio("n_repeat_words", "n_words")
    lines, variety = _ratio("n_dup_lines", "n_lines"), _ratio("n_distinct_words", "n_words")
    capitals, shouts = _ratio("n_upper", "word_chars"), _ratio("n_shouts", "n_words")
    bare, stops = _ratio("n_bare", "n_words"), _ratio("n_stops", "n_words")
    return {
        "length": (n < 20, n < 50, n >= 60),
        "word_length": ((length < 2.5) | (length > 12), (length < 3.5) | (length > 7), length <= 6.5),
        "symbols": (symbols > 0.04, symbols > 0.005, symbols <= 0.002),
        "repeats": ((repeats > 0.35) | ((lines > 0.4) & (F.col("n_dup_lines") > 1)), (repeats > 0.1) | (lines > 0.2), (repeats < 0.05) & (lines < 0.1)),
        #: Long texts repeat words by nature.
        "variety": (variety < 0.15, (variety < 0.55) & (n <= 1000), (variety >= 0.6) | (n > 1000)),
        "capitals": (capitals > 0.3, capitals > 0.06, capitals <= 0.05),
        "shouts": (shouts > 0.1, shouts > 0.01, shouts <= 0.002),
        "bare_symbols": (bare > 0.1, bare > 0.01, bare <= 0.005),
        "sentences": ((stops < 0.005) | (stops > 0.6), (stops < 0.03) | (stops > 0.25), stops >= 0.03),
    }


def starting_rates(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shares of classes, rates by class, rule and vote); the first class is the good one."""
    shares = np.array([0.8] + [0.2 / len(KINDS)] * len(KINDS))
    rates = [[ON_GOOD] * len(names)] + [[BY_OWN if x in own else BY_OTHERS for x in names] for own in KINDS.values()]
    return shares, np.array(rates)


def posteriors(votes: np.ndarray, shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(n, rules) votes -> (n, classes) probabilities; abstentions say nothing."""
    logs = np.tile(np.log(shares), (len(votes), 1))
    for vote in (STRONG, WEAK, GOOD):
        logs += (votes == vote) @ np.log(rates[:, :, vote]).T
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], shares: np.ndarray, rates: np.ndarray, *, strength: float = 20.0, iterations: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over (votes, count) patterns from starting (shares, rates), which count as ``strength`` documents a class: (shares, rates)."""
    first_shares, first_rates = shares, rates
    votes = np.array([p for p, _ in patterns], np.int8).reshape(len(patterns), rates.shape[1])
    counts = np.array([n for _, n in patterns], float)
    for _ in range(iterations):
        mass = posteriors(votes, shares, rates) * counts[:, None]
        seen = np.stack([mass.T @ (votes == vote) for vote in (STRONG, WEAK, GOOD)], axis=2) + strength * first_rates
        rates = seen / seen.sum(axis=2, keepdims=True)
        shares = (mass.sum(axis=0) + strength * first_shares) / (counts.sum() + strength)
    return shares, rates


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per document: id, the features, base_failed, votes, quality (posterior) and kept.

    kept is false where the base rules fail (fewer than ``min_words`` words, or more
    than ``max_repeat_percent`` % of them in repeated 3-word windows), else it says
    whether quality reaches ``threshold``.
    """
    bounded_batches(docs.sparkSession)
    found = write_scratch(with_features(docs, id_col, text_col), "features")
    voted = rules()
    cast = [F.when(strong, STRONG).when(weak, WEAK).when(good, GOOD).otherwise(-1).cast("int") for strong, weak, good in voted.values()]
    votes = found.withColumn("votes", F.array(*cast))
    counted = [(tuple(r.votes), r["count"]) for r in votes.groupBy("votes").count().collect()]  # 4^9 rows at most
    patterns = sorted(counted)
    fitted = fit_rules(patterns, *starting_rates(list(voted)))
    quality = posteriors(np.array([p for p, _ in patterns], np.int8).reshape(len(patterns), len(voted)), *fitted)[:, 0]
    #: Equal votes have equal posteriors: a row a pattern, 4^9 at most (some 10 MB), goes to the documents.
    table = docs.sparkSession.createDataFrame([(list(p), q) for (p, _), q in zip(patterns, quality.tolist(), strict=True)], "votes array<int>, quality double")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    scored = votes.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return scored.select(*found.columns, "votes", "quality", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their columns. Rows are told apart by a 256-bit digest of id and text."""
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat_ws(":", F.octet_length(F.col(c).cast("string")), F.col(c).cast("string"))) for c in (id_col, text_col)]
    keyed = docs.withColumn("__quality_key", F.unhex(F.sha2(F.concat_ws("\n", *parts), 256)))
    scored = score_quality(keyed, id_col="__quality_key", text_col=text_col, **options)
    gone = write_scratch(scored.where("not kept").select("__quality_key").distinct(), "rejected")
    small = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    return keyed.join(small, "__quality_key", "left_anti").select(*docs.columns)
