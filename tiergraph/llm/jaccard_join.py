"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles, hashed to 64 bits. Sets of similar sizes
share a size band, and in a band a Jaccard bound is a bound k on the size of the
symmetric difference. The hash domain is cut into n1 parts, and each of these into
n2 smaller ones: two sets that differ in at most k elements differ in at most k2 in
some of the n1 parts, and so agree on some choice of n2 - k2 of its smaller parts.
Each such choice is a signature; sets that share none need no comparison.

Equal sets are one class from the start, so copies cost nothing beyond their
signatures and never make pairs. Similar sets share more than one signature, so a class
that shares too few of its own, with whomever, is out. What the rest's signatures tie
together is compared in one task where it is small, and each set travels once. Where it
is large, members of one signature meet as sketches of at most 512 bytes first, whose
distance never exceeds that of the sets, and what these don't rule out is tied together
anew; a signature with more members than a task should hold is dealt out as pairs of
blocks of members, which together compare everything. Each link is verified exactly on
whole sets, and what leaves a task is a spanning forest of links, never all pairs.

Defined results: a text with fewer words than a shingle is one shingle; a null,
empty or blank text has no shingles and links with nothing; rows that share an id
are one node; rows with a null id get a null component and link with nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, drop_scratch, if_small, write_scratch
from tiergraph.llm._components import connected_components
from tiergraph.llm._shingles import WordHasher, mix64, shingle_set

#: A band's largest size over its smallest. Wider bands repeat fewer sets, but allow for larger differences.
BAND = 1.5
#: Members of one signature that a task compares at once.
BLOCK = 512
#: What signatures tie together is compared in one task if it has so few members and shingles.
TASK_MEMBERS, TASK_SHINGLES = 4096, 1 << 22
_SEED = np.uint64(0xD1B54A32D192ED03)


def plan_signatures(k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for symmetric differences up to k; (k2 + 1) * n1 > k.

    Small sets, with few shingles a part, enumerate subsets so that a signature
    still covers half of the set or more. Larger ones take one part a signature, and a
    third more parts than k needs: similar sets then agree in at least a quarter of them.
    """
    return (1, k + 3, k) if k <= 3 else ((4 * k + 6) // 3, 1, 0)


def bands_of(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, k) of every band that a set of n shingles belongs to, for Jaccard >= num / den."""
    found, low, band = [], 1, 0
    while low <= n:
        high = max(low, int(low * BAND))
        top = high * den // num  # the largest set that is similar to one of size high
        if n <= top:
            found.append((band, (den - num) * (high + top) // (den + num)))
        low, band = high + 1, band + 1
    return found


@lru_cache(maxsize=4096)
def _edges(parts: int) -> np.ndarray:
    """Where so many equal parts of the hash domain begin, the first one left out."""
    return (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)


@lru_cache(maxsize=65536)
def needed(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(band, k, how many signatures a similar set shares at least) of each band of a set of n shingles that has signatures.

    A similar set has n * den / num elements at most, and each difference spoils one part.
    """
    differ = (den - num) * (n + n * den // num) // (den + num)
    plans = [(band, k, plan_signatures(k)) for band, k in bands_of(n, num, den) if k]
    return tuple((band, k, max(1, n1 - differ) if n2 == 1 else 1) for band, k, (n1, n2, _) in plans)


def signatures(s: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """The PartEnum signatures of a sorted set in each of its bands, and how many of them a similar set shares at least.

    Bands in which only equal sets are similar have none.
    """
    found = []
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ _SEED), dtype=np.uint64)])
    for band, k, need in needed(len(s), num, den):
        n1, n2, k2 = plan_signatures(k)
        at = np.empty(n1 * n2 + 1, np.uint64)
        at[0], at[-1] = mixed[0], mixed[-1]
        at[1:-1] = mixed[np.searchsorted(s, _edges(n1 * n2))]
        parts = (at[1:] - at[:-1]).reshape(n1, n2)
        sigs = []
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            tag = np.arange(n1, dtype=np.uint64) + np.uint64((band << 40) + (c << 24))
            sigs.append(mix64(mix64(parts[:, chosen].sum(axis=1, dtype=np.uint64) if n2 > 1 else parts[:, 0]) + mix64(tag + _SEED)))
        found.append((np.concatenate(sigs), need))
    return found


def _class(s: np.ndarray) -> int:
    """A set as 63 bits and a free last one; with the other 64 bits and the size it is what tells sets apart."""
    return int(mix64(s).sum(dtype=np.uint64)) & ~1


def _rest(s: np.ndarray) -> int:
    """The other 64 bits."""
    return int(mix64(s ^ _SEED).sum(dtype=np.uint64))


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sign(width: int, num: int, den: int):
    """(doc_id, text) -> doc_id, size, the class in 127 bits, how many signatures of its bands must be shared, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [shingle_set(hasher.of(x.as_py() or ""), width) for x in batch.column("text")]
            needs = [[x[2] for x in needed(len(s), num, den)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _longs([_class(s) for s in sets]), _longs([_rest(s) for s in sets]), pa.array(needs, pa.list_(pa.int32())), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "c1", "c2", "needs", "sketch"],
            )

    return run


def _emit(width: int, num: int, den: int):
    """text -> (sig, c): the signatures of each class, c telling its band by the last bit. A task signs a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            sigs, owners = [], []
            for x in batch.column("text"):
                s = shingle_set(hasher.of(x.as_py() or ""), width)
                one = _class(s)
                if (known := (len(s), one, _rest(s))) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(known)
                for i, (found, _) in enumerate(signatures(s, num, den)):
                    sigs.append(found)
                    owners.append(np.full(len(found), one + i, np.uint64))
            if sigs:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sigs)), _longs(np.concatenate(owners))], ["sig", "c"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, c) in order -> those whose sig has two different c or more, each once. Remembers one row."""
    last: tuple[int, int] | None = None
    waiting: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("sig", "c"))
        same = np.concatenate([[last is not None and s[0] == last[0]], s[1:] == s[:-1]])
        copy = same & np.concatenate([[last is not None and c[0] == last[1]], c[1:] == c[:-1]])
        last = int(s[-1]), int(c[-1])
        s, c, first = s[~copy], c[~copy], ~same[~copy]
        if not len(s):
            continue
        out = ~first
        out[:-1] |= first[:-1] & ~first[1:]
        more = [waiting] if waiting is not None and not first[0] else []
        waiting = (int(s[-1]), int(c[-1])) if first[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([m[0] for m in more], np.int64), s[out]])), pa.array(np.concatenate([np.array([m[1] for m in more], np.int64), c[out]]))], ["sig", "c"])


def _sets(width: int):
    """(node, text) -> node, the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [shingle_set(hasher.of(x.as_py() or ""), width).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "of"])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each of 16 to 512 ranges of the hash domain. Sets that differ in d elements differ in at most d bytes."""
    ranges = 1 << min(9, max(4, (len(s) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate((mix64(s) >> np.uint64(56)).astype(np.uint8))])
    at = np.empty(ranges + 1, np.uint8)
    at[0], at[-1] = 0, sums[-1]
    at[1:-1] = sums[np.searchsorted(s, _edges(ranges))]
    return at[1:] ^ at[:-1]


def fold(drawn: np.ndarray, ranges: int) -> np.ndarray:
    """A sketch as if of fewer ranges."""
    while len(drawn) > ranges:
        drawn = drawn[::2] ^ drawn[1::2]
    return drawn


def forest(sizes: list[int], sketches: list[np.ndarray], blocks: list[int], num: int, den: int, similar: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that join whatever is connected by pairs that their sketches don't rule out and that are similar.

    Where there are two blocks, only pairs of different ones are compared: other tasks have the rest.
    """
    parent, links = list(range(len(sizes))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size, block = np.array(sizes), np.array(blocks)
    apart = bool((block != block[0]).any())
    drawn = np.stack([fold(x, min(map(len, sketches))) for x in sketches])
    for i in range(len(sizes) - 1):
        rest = size[i + 1 :]
        near = np.minimum(rest, size[i]) * den >= np.maximum(rest, size[i]) * num
        near &= (drawn[i + 1 :] != drawn[i]).sum(axis=1) * (den + num) <= (den - num) * (rest + size[i])
        if apart:
            near &= block[i + 1 :] != block[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if (a := root(i)) != (b := root(j)) and similar(i, j):
                parent[b] = a
                links.append((i, j))
    return links


def _compare(num: int, den: int, exact: bool):
    """Rows sorted by group and part -> links (a, b).

    exact: rows have the sets, and each link is verified. Else they have sizes and sketches, and links are candidates.
    """

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        if not exact:
            return forest([r[2] for r in rows], [np.frombuffer(r[3], np.uint8) for r in rows], [r[0] for r in rows], num, den, lambda i, j: True)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]

        def similar(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both * den >= num * (len(sets[i]) + len(sets[j]) - both)

        return forest([len(s) for s in sets], [sketch(s) for s in sets], [r[0] for r in rows], num, den, similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and (links := links_of(rows)):
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in links], pa.int64()), pa.array([rows[j][1] for _, j in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for group, part, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "block", "node", "size", "of")), strict=True):
                if (group, part) != key:
                    yield from close()
                    key, rows = (group, part), []
                rows.append(row)
        yield from close()

    return run


def _compared(rows: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """rows: group, part, block, node, size, of."""
    dealt = rows.select("group", "part", "block", "node", "size", "of").repartition("group", "part").sortWithinPartitions("group", "part", "node")
    return dealt.mapInArrow(_compare(num, den, exact), "a long, b long").distinct()


def jaccard_links(docs: DataFrame, *, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = TASK_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(members, links) for the texts whose sets have Jaccard >= num / den.

    members: doc_id, n_shingles, node (the least doc_id with an equal set; null for
    empty sets). links: a, b, verified links between nodes that connect whatever is
    connected. Ids are long integers or can be cast to them.
    """
    bounded_batches(docs.sparkSession)
    passing: list[DataFrame] = []

    def passed(df: DataFrame, name: str) -> DataFrame:
        """Written, and removed in the end."""
        passing.append(write_scratch(df, name))
        return passing[-1]

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = passed(texts.mapInArrow(_sign(width, num, den), "doc_id long, n_shingles long, c1 long, c2 long, needs array<int>, sketch binary"), "signed")
    classes = passed(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "c1", "c2").agg(F.min("doc_id").alias("node"), F.min("sketch").alias("of")), "classes")
    members = write_scratch(signed.select("doc_id", "n_shingles", "c1", "c2").join(classes.drop("of"), ["n_shingles", "c1", "c2"], "left"), "members")
    #: Signatures carry 63 bits of a class. Different classes with the same ones have all signatures of either, so none loses a link.
    sketches = classes.select("node", "of")
    classes = classes.select("c1", "node", F.col("n_shingles").alias("size"))
    same_bits = passed(classes.groupBy("c1").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "same_bits")

    #: A member of a signature is a class in one of its bands. Members come in order, and those alone with theirs are left out in passing.
    dealt = texts.where("doc_id is not null").select("text").mapInArrow(_emit(width, num, den), "sig long, c long").repartition("sig").sortWithinPartitions("sig", "c")
    rows = passed(dealt.mapInArrow(_shared, "sig long, c long"), "shared")
    #: Classes that share fewer signatures, with whomever, than a similar set would are out.
    known = signed.where("doc_id is not null")
    needs = known.select("c1", F.posexplode("needs").alias("at", "need")).select((F.col("c1") + F.col("at")).alias("c"), "need").distinct()
    enough = passed(rows.groupBy("c").agg(F.count("*").alias("n")).join(needs, "c").where("n >= need").select("c").distinct(), "enough")
    rows = rows.join(enough, "c", "left_semi")
    marks = rows.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("c")).alias("mark")).where("low <> high")
    marks = passed(marks, "marks")
    rows = passed(rows.join(marks, "sig").join(classes.withColumnRenamed("c1", "__c1"), F.col("c").bitwiseAND(F.lit(-2)) == F.col("__c1")).select("sig", F.col("__c1").alias("c1"), "node", "size", "low", "high", "rows", "mark"), "rows")

    #: What signatures tie together is one task's work where it is small, and each set travels once.
    ties = passed(rows.select(F.col("low").bitwiseAND(F.lit(-2)).alias("__hub"), "node").distinct(), "ties")
    hubs = ties.join(classes.groupBy(F.col("c1").alias("__hub")).agg(F.min("node").alias("least")), "__hub")
    placed = passed(_placed(connected_components(hubs.select("least", "node")), classes, most), "placed")
    compared = placed.where("light").select(F.col("component").alias("group"), F.lit(-1).alias("part"), F.lit(0).alias("block"), "node", "size")
    if not (heavy := placed.where("not light")).isEmpty():
        #: Else each signature is a group of its members. Of groups with the same members one is enough, that of the least signature.
        groups = rows.groupBy("low", "high", "rows", "mark").agg(F.min("sig").alias("sig")).select("sig")
        kept = rows.join(heavy.select("node"), "node", "left_semi").join(groups, "sig", "left_semi").select("sig", "c1", "node", "size", "rows").distinct()
        #: Large groups are dealt out as pairs of blocks: a member goes to the pair of its block and each block, its own included.
        cut = kept.withColumn("n", F.ceil(F.col("rows") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        dealt_out = cut.select("sig", "c1", "node", "size", "block", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        parts = passed(dealt_out.select(F.col("sig").alias("group"), (F.least("block", "other") * F.col("n") + F.greatest("block", "other")).alias("part"), "block", "c1", "node", "size"), "parts")
        #: They meet as sketches first, and what these don't rule out is tied together anew.
        again = passed(_placed(connected_components(_compared(parts.join(sketches, "node"), num, den, exact=False)), classes, most), "again")
        compared = compared.unionByName(again.where("light").select(F.col("component").alias("group"), F.lit(-2).alias("part"), F.lit(0).alias("block"), "node", "size"))
        compared = compared.unionByName(parts.join(again.where("not light").select("node"), "node", "left_semi").select("group", "part", "block", "node", "size"))
    #: Those that share all 63 bits may share their signatures with no one else.
    met = classes.join(same_bits.select("c1"), "c1").select(F.col("c1").alias("group"), F.lit(-3).alias("part"), F.lit(0).alias("block"), "node", "size")
    compared = passed(compared.unionByName(met), "compared")
    nodes = passed(compared.select("node").distinct(), "nodes")
    sets = texts.withColumnRenamed("doc_id", "node").join(if_small(nodes), "node", "left_semi").mapInArrow(_sets(width), "node long, of binary")
    links = write_scratch(_compared(compared.join(sets, "node"), num, den, exact=True), "links")
    for done in passing:
        drop_scratch(done)
    return members.select("doc_id", "n_shingles", "node"), links


def _placed(tied: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(node, size, component, light): whether all that is tied to a node fits into one task."""
    weights = tied.join(classes.select("node", "size"), "node")
    light = weights.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where((F.col("n") <= most) & (F.col("all") <= TASK_SHINGLES)).select("component", F.lit(True).alias("light"))
    return weights.join(light, "component", "left").select("node", "size", "component", F.coalesce("light", F.lit(False)).alias("light"))


def jaccard_components(docs: DataFrame, *, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = TASK_MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included)."""
    members, links = jaccard_links(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col, block=block, most=most)
    found = connected_components(links)
    own = F.coalesce("component", "node", "doc_id").alias("component_id")
    return members.join(found, "node", "left").select("doc_id", "n_shingles", own)
