import random
import re

from tiergraph.llm import decontaminate as D

ITEM = "Tom has 5 apples and 3.5 kg of flour. Later, Tom gives 5 apples to Ann Lee, who walks 20 miles home. How many apples are left?"
FILLER = [f"filler{i}" for i in range(900)]


def prose(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def brute_words(text):
    """Templates again, word by word."""
    out, previous, unit_ok = [], "", False
    for m in re.finditer(r"\d+(?:[.,:/]\d+)*|[^\W_]+", text or ""):
        w, before = m.group(), text[max(0, m.start() - 2) : m.start()]
        if w[0].isdigit():
            out.append(("#", w))
            unit_ok = True
            previous = w
            continue
        name = len(before) == 2 and before[1] == " " and (before[0].isalnum() or before[0] in ",;") and w[0].isupper() and w[1:].islower() and len(w) > 1
        if name:
            out.append(("@", w.lower()))
        elif unit_ok and w.lower() in D.UNITS and len(text[: m.start()]) - len(text[: m.start()].rstrip(" ")) <= 1:
            out.append(("%", w.lower()))
        else:
            out.append((w.lower(), None))
        unit_ok, previous = False, w
    return out


def windows(words, k):
    tokens = [w for w, _ in words]
    return [tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []


def test_template_words(spark):
    got = spark.createDataFrame([(ITEM,)], "t string").select(D.template_words(__import__("pyspark").sql.functions.col("t")).alias("w")).first().w
    plain = [("@" if w[0] == D.NAME else "#" if w[0] == D.NUMBER else "%" if w[0] == D.UNIT else w) for w in got]
    assert plain == [w for w, _ in brute_words(ITEM)]
    assert plain[:4] == ["tom", "has", "#", "apples"] and "%" in plain and plain.count("@") == 3


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([3, 14, 30]))) for i in range(20)] + [(50, ITEM)]
    docs = []
    for i in range(150):
        item = rng.choice(items)[1].split()
        cut = item[: int(len(item) * rng.choice([0, 0.3, 0.7, 0.85, 1]))]
        if cut and rng.random() < 0.3:
            cut[rng.randrange(len(cut))] = "changed"
        docs.append((i, " ".join([prose(rng, 40), *cut, prose(rng, 20)])))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        held = set(windows(brute_words(text), 5))
        for i, t in items:
            own = set(windows(brute_words(t), 5))
            if len(own & held) >= 0.8 * len(own):
                want[d, i] = len(own), len(own & held)
    assert want and got == want


def test_changed_values_are_caught_if_consistent(spark):
    changed = ITEM.replace("Tom", "Bob").replace("5", "8").replace("Ann Lee", "Eve Low").replace("20", "31").replace("3.8", "3.5")
    mixed = "Bob has 1 apples and 2 kg of flour. Later, Cid gives 3 apples to Dan Elf, who walks 4 miles home. How many apples are left?".replace("Later, Cid", "Later, Cid")
    docs = [(1, ITEM), (2, changed), (3, "Unrelated words " * 30), (4, ITEM.upper()), (5, None), (6, ""), (2, changed), (None, ITEM), (7, "pad " * 20_000 + ITEM)]
    bench = [(1, ITEM), (2, None), (3, ""), (4, "tiny item")]
    frame = spark.createDataFrame([(*d, "x", 0.0, 1) for d in docs], "doc_id long, text string, key string, containment double, h int")
    items = spark.createDataFrame([(*b, "words") for b in bench], "item_id long, text string, words string")
    got = sorted((str(r.doc_id), r.item_id, r.verbatim) for r in D.find_leaks(frame, items).collect())
    assert got == [("1", 1, True), ("2", 1, False), ("2", 1, False), ("7", 1, True), ("None", 1, True)]
    assert mixed
    kept = D.drop_leaks(frame, items)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert D.find_leaks(frame.limit(0), items).count() == 0 == D.find_leaks(frame, items.limit(0)).count()


def test_inconsistent_values_are_another_text(spark):
    item = "then Ann adds 4 cups and Ann takes 4 cups and Ann pours 4 cups so Ann keeps 4 cups in all"
    other = "then Bob adds 1 cups and Cid takes 2 cups and Dan pours 3 cups so Eve keeps 5 cups in all"
    same = item.replace("Ann", "Bob").replace("4", "9")
    got = [r.doc_id for r in D.find_leaks(spark.createDataFrame([(1, other), (2, same)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert got == [2]


def test_names_where_sentences_start(spark):
    item = "Alice has 3 apples. Bob has 5 pears. How many fruits do they have?"
    docs = [(1, "Carol has 7 apples. Dan has 9 pears. How many fruits do they have?"), (2, "so  Carol has 7 apples.\n\"Dan has 9 pears. How many fruits do they have?"), (3, item), (4, "Cats are fine. Dogs have 9 lives. How many fruits are there?")]
    got = {r.doc_id: (r.n_windows, r.n_found, r.n_conflicts, r.verbatim) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (10, 10, 0, False), 2: (10, 10, 0, False), 3: (10, 10, 0, True)}
    again = "Ann has 3 hats. Ann has 3 hats. Ann has 3 hats. Ann has 3 hats."
    mixed = "Bob has 1 hats. Cid has 2 hats. Dan has 4 hats. Eve has 5 hats."
    assert D.find_leaks(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), spark.createDataFrame([(1, again)], "item_id long, text string")).count() == 0


def test_short_items_inside_longer_documents(spark):
    items = [(1, "Define photosynthesis briefly."), (2, "What is 17+25?"), (3, "one")]
    docs = [(1, "Here it comes: Define photosynthesis briefly. And so on it goes."), (2, "So I ask you now. What is 17+25? Nobody knows this."), (3, "what is"), (4, "Define photosynthesis at length, and briefly.")]
    got = sorted((r.doc_id, r.item_id, r.verbatim) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short_items=True).collect())
    assert got == [(1, 1, True), (2, 2, True)]
