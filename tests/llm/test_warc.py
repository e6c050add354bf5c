import hashlib
import random

from pyspark.sql import functions as F

from tiergraph.llm import warc as W


def chain(data: bytes):
    """Records of one archive, read from its start."""
    at, out = 0, []
    while at < len(data):
        assert data.startswith(W.MAGIC.encode(), at)
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def pages():
    rng = random.Random(3)
    big = "é" * 600
    fake = f"{W.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(i, f"http://h/{i}", "".join(rng.choice(["x", "\r\n", "é", W.MAGIC, "WARC/1", "\n"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nb", ""), (102, "u", big), (105, "u", big), (103, "u", big), (110, "u", fake * 3), (111, "u", fake + "y" * 2000), (112, "u", fake + "y" * 2000), (None, "u", "no id"), (120, "u", "z" * 50), (121, "u", "z" * 50), (105, "u", big)]
    return rows


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        revisit = len(data) >= 1000 and i != max(same)
        out.append((i, None if revisit else data, hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=repr)


def read(spark, path):
    got = W.read_archives(spark, path).collect()
    return sorted([(None if r.record_id is None else int(r.record_id), None if r.payload is None else bytes(r.payload), r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got], key=repr)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "f") for r in pages()], "page_id long, url string, html string, digest int, file string")
    for parts in (1, 3):
        path = str(tmp_path / f"w{parts}")
        W.write_archives(docs.repartition(parts), path)
        assert read(spark, path) == brute(pages())
        files = [f for f in (tmp_path / f"w{parts}").iterdir() if f.name.startswith("part-")]
        heads = [h for f in files for h, _ in chain(f.read_bytes())]
        assert len(heads) == len(pages()) and all("\n" not in h["WARC-Target-URI"] for h in heads)


def test_reading_in_small_splits(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert read(spark, path) == brute(pages())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_two_scans_may_be_split_differently(spark, tmp_path):
    """Executors that join or are lost change a scan's splits: here between the chain's scan and that of the texts."""
    path = str(tmp_path / "w")
    rows = pages() + [(1000 + i, f"http://many/{i}", "w" * (i % 7) + W.MAGIC * (i % 3)) for i in range(300)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        records = W.read_archives(spark, path)
        few = records.rdd.getNumPartitions()
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "32")
        records = records.select("*")  # planned anew
        got = [(None if r.record_id is None else int(r.record_id), None if r.payload is None else bytes(r.payload), r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in records.collect()]
        assert records.rdd.getNumPartitions() != few
        assert sorted(got, key=repr) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_an_archive_within_a_payload(spark, tmp_path):
    """A record's text stands in another one's payload as well, and in the same file."""
    inner = spark.createDataFrame([(1, "http://a", "plain")], "page_id long, url string, html string")
    W.write_archives(inner, str(tmp_path / "inner"))
    copy = next(f for f in (tmp_path / "inner").iterdir() if f.name.startswith("part-") and f.stat().st_size).read_bytes().decode()
    rows = [(1, "http://a", "plain"), (2, "http://b", copy), (3, "http://c", copy + copy), (4, "http://d", "x" + copy + "y")]
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    assert read(spark, path) == brute(rows)


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_chains_jump_over_many_false_records(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for file in ("a", "b"):
        at, n = 0, 0
        for _ in range(200):
            inner = rng.choice([0, 0, 0, 1, 2])
            size = 100
            want.add((file, at))
            rows.append((file, n, at, size, size))
            for j in range(inner):
                n += 1
                rows.append((file, n, at + 20 * (j + 1), 20, rng.choice([20, 35, 80 - 20 * j, None])))
            at += size
            n += 1
    placed = spark.createDataFrame(rows, "file string, n long, at long, size long, span long")
    assert {tuple(r) for r in W._reachable(placed).select("file", "at").collect()} == want
    assert F is not None
