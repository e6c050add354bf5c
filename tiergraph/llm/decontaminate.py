"""Benchmark decontamination by template canonicalisation.

Names, numbers and units become typed placeholders, so that a question whose values
were changed still has the template of the original. Windows of template words are
joined by hash to the windows of the benchmark's items; a document leaks an item if
it holds most of the item's distinct windows. The values behind the placeholders must
then be consistent: along one alignment of document and item, equal values in the
item stand for equal values in the document. Everything is DataFrame functions.

Templates: text in lower case, cut into runs of letters and digits, so that
punctuation and decoration do not count. A capitalised word inside a sentence is a
name, a run of digits (with inner separators) a number, and a unit that follows a
number is a unit. In a second template capitalised words are names wherever they stand,
also where a sentence may start; it decides where the first holds too few windows.

Defined results: null and empty texts and items have no windows and never match; an
item shorter than a window is one window, which longer documents hold with ``short_items`` alone; a document that repeats is reported for
each row; a null id is reported as null; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import write_scratch

#: Template words of a window, and the share of an item's distinct windows that makes a leak.
WINDOW, SHARE = 5, 0.8
#: A table is broadcast up to so many rows of two or three numbers (some 8 MB); beyond that it is shuffled.
SMALL_ROWS = 200_000

#: Units that may follow a number.
UNITS = ("mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yard", "yards", "mi", "mile", "miles", "mg", "g", "kg", "gram", "grams", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "t", "ton", "tons", "ml", "cl", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents")
#: Placeholders are private-use characters before the value that they stand for.
NAME, NUMBER, UNIT = "", "", ""
#: Before a capitalised word where a sentence may start: a name in the second template, a word in the first.
INITIAL = ""


def _marked_text(text: Column) -> Column:
    """A text with its placeholders' signs, each before the value that it stands for."""
    clean = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(" ")), (NAME, NUMBER, UNIT, INITIAL), F.coalesce(text, F.lit("")))
    marked = F.regexp_replace(clean, r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)", INITIAL + "$1")
    named = F.regexp_replace(marked, rf"{INITIAL}(?<=[\p{{L}}\p{{N}},;] {INITIAL})", NAME)
    numbered = F.regexp_replace(F.lower(named), r"(?<![\p{L}\p{N}])(\p{N}++(?:[.,:/]\p{N}++)*+)", NUMBER + "$1 ")
    return F.regexp_replace(numbered, rf"({NUMBER}[\p{{N}}.,:/]++ {{1,2}}){INITIAL}?({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")


def _marked_words(text: Column) -> Column:
    """The words of both templates of a text: those with INITIAL differ."""
    return F.regexp_extract_all(_marked_text(text), F.lit(rf"{NUMBER}\p{{N}}++(?:[.,:/]\p{{N}}++)*+|[{NAME}{UNIT}{INITIAL}]?[\p{{L}}\p{{N}}]++"), F.lit(0))


def _template(marked: Column, initials: bool) -> Column:
    return F.transform(marked, lambda w: F.when(w.substr(1, 1) == INITIAL, F.concat(F.lit(NAME if initials else ""), w.substr(F.lit(2), F.length(w)))).otherwise(w))


def template_words(text: Column, initials: bool = False) -> Column:
    """The words of a text's template; a placeholder's word is its sign with the value after it. With ``initials``, capitalised words are names wherever they stand."""
    return _template(_marked_words(text), initials)


def _is_slot(word: Column) -> Column:
    return word.substr(1, 1).isin(NAME, NUMBER, UNIT)


def _signs(words: Column) -> Column:
    """Template words with placeholders as their bare signs."""
    return F.transform(words, lambda w: F.when(_is_slot(w), w.substr(1, 1)).otherwise(w))


def window_hashes(words: Column, window: int) -> Column:
    """The hash of each window of template words; of all words, if there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(1)))
    word = lambda i, j: F.get(words, i + (j - 1))  # noqa: E731  null beyond the last, which a hash passes over
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(*[word(i, j) for j in range(window)]))).otherwise(F.array().cast("array<long>"))


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(…, words) -> (…, at, h), a row a window."""
    signed = rows.withColumn("__s", _signs(F.col("words")))
    return signed.select(*[c for c in rows.columns if c != "words"], F.posexplode(window_hashes(F.col("__s"), window)).alias("at", "h"))


def _bare_words(text: Column) -> Column:
    """The words of both templates, placeholders as bare signs: those with INITIAL differ."""
    bare = F.regexp_replace(_marked_text(text), rf"({NUMBER})\p{{N}}++(?:[.,:/]\p{{N}}++)*+|([{NAME}{UNIT}])[\p{{L}}\p{{N}}]++", "$1$2")
    return F.regexp_extract_all(bare, F.lit(rf"[{NAME}{NUMBER}{UNIT}]|{INITIAL}?[\p{{L}}\p{{N}}]++"), F.lit(0))


def _met(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, bare) -> (key, templates, h), a row for each window of any of the lengths; templates is 1, 2, or 3 for a window of both.

    Windows are the words beside themselves, shifted: no function is called for each word, and all but cutting the text is compiled.
    """
    names = [f"w{j}" for j in range(max(lengths))]
    shifted = F.arrays_zip(*[(F.slice("bare", j + 1, F.greatest(F.size("bare"), F.lit(1))) if j else F.col("bare")).alias(name) for j, name in enumerate(names)])
    words = rows.select("key", F.size("bare").alias("n"), F.posexplode(shifted).alias("at", "w")).select("key", "n", "at", "w.*")
    initial = lambda c: F.startswith(F.col(c), F.lit(INITIAL))
    one = lambda templates, h: F.struct(F.lit(templates).alias("templates"), h.alias("h"))

    def window(k: int) -> Column:
        own = names[:k]
        plain = F.xxhash64(*[F.when(initial(c), F.substring(c, 2, 1 << 30)).otherwise(F.col(c)) for c in own])
        named = F.xxhash64(*[F.when(initial(c), F.lit(NAME)).otherwise(F.col(c)) for c in own])
        both = F.when(reduce(Column.__or__, map(initial, own)), F.array(one(1, plain), one(2, named))).otherwise(F.array(one(3, F.xxhash64(*own))))
        return F.when((F.col("at") <= F.col("n") - k) | ((F.col("at") == 0) & (F.col("n") < k)), both).otherwise(F.slice(both, 1, 0))

    return words.select("key", F.explode(F.concat(*map(window, lengths))).alias("m")).select("key", "m.templates", "m.h")


def _if_small(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL_ROWS else small


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short_items: bool = False) -> DataFrame:
    """Leaks, a row for each document and item: id, item_id, n_windows (the item's), n_found, containment, n_slots, n_conflicts, verbatim.

    A leak holds at least ``share`` of the item's distinct windows, and at most a
    fifth of its placeholders' values are inconsistent. verbatim says whether all
    values are the item's own. With ``short_items``, an item shorter than a window is
    also looked for inside longer documents, by windows of its own length.
    """
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("template"), _template(F.col("marked"), n == 2).alias("words")) for n in (1, 2)])).alias("t")
    items = benchmark.select(F.col(item_col).alias("item_id"), _marked_words(F.col(item_text_col)).alias("marked")).select("item_id", both).select("item_id", "t.*")
    windows = write_scratch(_windows(items, window), "item_windows")
    totals = windows.groupBy("item_id", "template").agg(F.countDistinct("h").alias("n_windows"))
    n_windows = windows.count()

    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.size("words").alias("k")
    lengths = [window, *[r.k for r in items.select(size).where(F.col("k").between(1, window - 1)).distinct().collect()]] if short_items else [window]
    met = _met(texts.select("key", _bare_words(F.col("text")).alias("bare")), lengths)
    hits = met.join(_if_small(windows.select("item_id", "template", "h").distinct(), n_windows), "h").where(F.col("templates").bitwiseAND(F.col("template")) > 0)
    found = hits.groupBy("key", "item_id", "template", "h").count().groupBy("key", "item_id", "template").agg(F.count("*").alias("n_found"))
    enough = found.join(totals, ["item_id", "template"]).where(F.col("n_found") >= F.lit(share) * F.col("n_windows"))
    #: Of both templates the first that holds enough.
    holds = write_scratch(enough.groupBy("key", "item_id").agg(F.min(F.struct("template", "n_windows", "n_found")).alias("b")).select("key", "item_id", "b.*"), "holds")

    #: The values behind the placeholders, for documents that hold an item alone.
    n_holds = holds.count()
    held = texts.join(_if_small(holds.select("key").distinct(), n_holds), "key", "left_semi")
    held_words = held.select("key", _marked_words(F.col("text")).alias("marked")).select("key", both).select("key", "t.*")
    doc_slots = reduce(DataFrame.unionByName, [_slots(held_words, k) for k in lengths])
    item_slots = _slots(items, window).withColumnsRenamed({"at": "item_at", "value": "item_value"})
    pairs = doc_slots.join(_if_small(holds.select("key", "item_id", "template"), n_holds), ["key", "template"]).join(_if_small(item_slots, n_windows), ["item_id", "template", "h", "slot"])
    #: One alignment at a time: windows at one distance between document and item.
    values = pairs.groupBy("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_value").agg(F.countDistinct("value").alias("n_values"), F.min(F.col("value") == F.col("item_value")).alias("own"))
    slots = values.groupBy("key", "item_id", "shift").agg(F.count("*").alias("n_slots"), F.sum(F.when(F.col("n_values") > 1, 1).otherwise(0)).alias("n_conflicts"), F.min("own").alias("own"))
    best = slots.groupBy("key", "item_id").agg(F.max_by(F.struct("n_slots", "n_conflicts", "own"), F.struct("n_slots", -F.col("n_conflicts"))).alias("b"))
    leaks = holds.join(best, ["key", "item_id"], "left").select(
        "key", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("containment"),
        F.coalesce("b.n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("b.n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"), F.coalesce("b.own", F.lit(True)).alias("verbatim"),
    ).where("n_conflicts * 5 <= n_slots")
    ids = held.select("key", F.col("id").alias(id_col))
    return ids.join(leaks, "key").drop("key")


def _slots(rows: DataFrame, window: int) -> DataFrame:
    """(…, words) -> (…, h, at, slot, value), a row for each placeholder of each window."""
    hashed = rows.withColumn("__s", _signs(F.col("words"))).withColumn("__w", window_hashes(F.col("__s"), window))
    own = [c for c in rows.columns if c != "words"]

    def inside(at: Column) -> Column:
        words = F.transform(F.slice("words", at + 1, window), lambda w, i: F.struct(i.alias("slot"), w.alias("value")))
        return F.filter(words, lambda x: _is_slot(x["value"]))

    #: Windows without placeholders are left out before the words are copied to each row.
    marked = F.filter(F.transform("__w", lambda h, at: F.struct(h.alias("h"), at.alias("at"), inside(at).alias("slots"))), lambda x: F.size(x["slots"]) > 0)
    opened = hashed.select(*own, F.explode(marked).alias("x")).select(*own, "x.h", "x.at", F.explode("x.slots").alias("s"))
    return opened.select(*own, "h", "at", "s.slot", "s.value")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that leak no item, with all their columns. Rows with a leaking id go together; a null id stays."""
    leaks = write_scratch(find_leaks(docs, benchmark, id_col=id_col, **options).select(id_col).where(F.col(id_col).isNotNull()).distinct(), "leaks")
    return docs.join(_if_small(leaks, leaks.count()), id_col, "left_anti").select(*docs.columns)
