import random
from datetime import datetime, timedelta

from tiergraph.llm import url_filters as U

START = datetime(2023, 1, 1)
ENTRIES = "list string, kind string, pattern string, action string, listed_at timestamp, event string"


def keys(url):
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
    labels = host.split(".")
    out = [("domain:" + ".".join(labels[i:]), len(labels) - i) for i in range(len(labels))] + [("host:" + host, 100)]
    segments = [s for s in path.split("?")[0].split("#")[0].split("/") if s][:3]
    return out + [("path:" + host + "/" + "/".join(segments[:i]), 200 + i) for i in range(1, len(segments) + 1)]


def active(entries, at):
    """Keys that stand at a time: the last event of each by then is add."""
    last = {}
    for name, kind, pattern, action, day, event in sorted(entries, key=lambda e: (e[4], e[5] == "add")):
        if day <= at:
            last[name, f"{kind}:{pattern.lower()}", action] = event
    return [k for k, event in last.items() if event == "add"]


def brute(url, at, entries):
    ranks = dict(keys(url))
    met = [(-ranks[key], action != "deny", key, name, action) for name, key, action in active(entries, at) if key in ranks]
    if not met:
        return "none", None, None, 0
    best = min(met)
    return best[4], best[2], best[3], len(met)


def test_every_capture_meets_the_entries_of_its_time(spark):
    rng = random.Random(5)
    hosts = ["a.b.example.com", "b.example.com", "x.example.org", "example.org", "hot.net"]
    entries = []
    for _ in range(160):
        kind = rng.choice(["host", "domain", "path"])
        host = rng.choice(hosts)
        pattern = {"host": host, "domain": rng.choice([host, "example.com", "org"]), "path": f"{host}/{rng.choice('pq')}"}[kind]
        entries.append((rng.choice("LM"), kind, pattern, rng.choice(["deny", "allow"]), START + timedelta(days=rng.randrange(900)), rng.choice(["add", "add", "remove"])))
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'u@'])}{rng.choice([*hosts, 'hot.net', 'HOT.net'])}{rng.choice(['', ':80'])}/{rng.choice(['', 'p', 'p/q/r/s', 'q?x=1', 'q#f'])}", START + timedelta(hours=rng.randrange(24 * 900))) for i in range(500)]
    got = U.judge_captures(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.verdict, r.matched_key, r.matched_list, r.n_active) == brute(r.url, r.fetched_at, entries), r


def test_nulls_empties_repeats_and_clashing_names(spark):
    day = datetime(2024, 5, 5)
    rows = [(1, None, day, 7, "k"), (2, "", day, 7, "k"), (3, "not a url", day, 7, "k"), (4, "http://h.com/", None, 7, "k"), (5, "http://h.com/", day, 7, "k"), (5, "http://h.com/", day, 7, "k"), (None, "http://h.com/" + "x/" * 30_000, day, None, None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, rank int, key string")
    entries = [("L", "host", "h.com", "deny", day, "add"), ("L", "host", None, "deny", day, "add"), ("L", "host", "h.com", "deny", None, "remove"), ("L", "host", "h.com", "deny", day, None)]
    got = sorted((str(r.page_id), r.verdict) for r in U.judge_captures(captures, spark.createDataFrame(entries, ENTRIES)).collect())
    assert got == [("1", "none"), ("2", "none"), ("3", "none"), ("4", "none"), ("5", "deny"), ("5", "deny"), ("None", "deny")]
    none = spark.createDataFrame([], ENTRIES)
    assert {r.verdict for r in U.judge_captures(captures, none).collect()} == {"none"}
    assert U.judge_captures(captures.limit(0), spark.createDataFrame(entries, ENTRIES)).count() == 0


def test_deep_paths_and_their_case(spark):
    day = datetime(2024, 5, 5)
    rows = [(i, u, day) for i, u in enumerate(["http://h.com/a/b/c/d/e", "http://h.com/a/b/c", "http://H.com/Forum/x", "http://h.com/forum/x"])]
    entries = [("L", "path", "h.com/a/b/c/d", "deny", day, "add"), ("L", "path", "H.com/Forum", "deny", day, "add")]
    got = U.judge_captures(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {r.page_id: r.matched_key for r in got} == {0: "path:h.com/a/b/c/d", 1: None, 2: "path:h.com/Forum", 3: None}


def test_columns_that_clash_with_its_own(spark):
    rows = [(1, "http://a.example.com/x", START, 9, "k", "l"), (1, "http://a.example.com/x", START, 9, "k", "l"), (2, None, None, None, None, None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, n int, key string, list string")
    entries = spark.createDataFrame([("bad", "domain", "example.com", "deny", START - timedelta(days=3), "add")], ENTRIES)
    got = U.judge_captures(captures, entries)
    assert got.columns == [*captures.columns, "verdict", "matched_key", "matched_list", "n_active"]
    assert sorted((r.page_id, r.n, r.verdict, r.matched_key, r.n_active) for r in got.collect()) == [(1, 9, "deny", "domain:example.com", 1)] * 2 + [(2, None, "none", None, 0)]
