"""Suffix-array dedup: removes every byte that a repeated string of ``length`` bytes covers.

Sorting the suffix at every byte of a corpus would move each byte some hundred
times. This operator sorts a sparse suffix array instead, without losing a match:

1. Each window of ``length`` bytes picks an anchor, the position of its least
   k-gram hash. The choice depends on the window's bytes alone, so equal windows
   pick equal anchors at equal offsets. Runs of windows with one anchor are a
   segment; segments are what leaves a document, about one for every 69 bytes.
2. Segments meet by their anchor's k-gram. A k-gram seen once repeats nothing. If
   all segments of a k-gram are equal, all their windows repeat.
   Segments that equal another one repeat as well, and one of them stands for all.
3. The rest, which stand at the edges of repeats, are compared as suffixes: from the
   anchor rightwards, and from the anchor leftwards. Each side is ordered by
   deep-shallow sorting: multikey quicksort, eight bytes a step, to a shallow depth;
   then blind tries order the groups that are still equal there. The common prefixes
   of the right order form a tree; among the segments below one of its nodes, the
   neighbours in left order tell how far to the left each window still repeats.
4. Per document, the covered runs are merged and cut out.

A k-gram with more segments than one task should hold has its windows dealt out one
by one by the hash of their bytes and counted; that path is exact as well.

Defined results: a null text is empty; texts shorter than ``length`` have no windows;
matches never cross documents; repeated rows repeat each other, ids and all; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, write_scratch
from tiergraph.llm._shingles import mix64

#: Bytes of a k-gram, unless length is shorter than twice that.
GRAM = 64
#: Bytes to which multikey quicksort compares; blind tries go on from there.
SHALLOW = 96
#: Segments of one k-gram that a task sorts at once.
HOT = 50_000
#: Bytes of a text that are scanned at once.
PIECE = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the rolling hash's base and of its inverse, modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram of the bytes."""
    up, down = _powers.get(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up)])
    return mix64((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from minima of blocks' heads and tails."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def segments(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first window, windows) of each run of windows with one anchor."""
    found = []
    for start in range(0, max(0, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data[start : start + PIECE + length - 1], np.uint8)
        hashes = gram_hashes(piece, k)
        #: The hash's upper bits, then the place: the leftmost of equals wins, wherever the window stands.
        keys = (hashes >> np.uint64(23) << np.uint64(23)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (window_minima(keys, length - k + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        at = anchor[first]
        found.append((hashes[at], at + start, first + start, count))
    if not found:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# Deep-shallow sorting of byte strings


def lcp(x: bytes, y: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])).bit_length() + 7) // 8


def multikey_quicksort(items: list[int], strings: list[bytes], shallow: int) -> list[list[int]]:
    """The items in groups, in order: within a group all agree on the first ``shallow`` bytes."""
    out, todo = [], [(items, 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) == 1 or depth >= shallow:
            out.append(part)
            continue
        pivot = strings[part[len(part) // 2]][depth : depth + 8]
        less, same, more = [], [], []
        for i in part:
            key = strings[i][depth : depth + 8]
            (same if key == pivot else less if key < pivot else more).append(i)
        if more:
            todo.append((more, depth))
        todo.append((same, depth + 8 if len(pivot) == 8 else shallow))  # a string that ends here is all compared
        if less:
            todo.append((less, depth))
    return out


class BlindTrie:
    """A trie of branching places only: it is descended blindly, then one comparison finds where to insert."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), None, [i]]
            return
        node = self.root
        while node[1] is not None:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        depth = lcp(s, other)
        if depth == len(s) == len(other):
            node[2].append(i)
            return
        node = self.root
        mine = s[depth] if depth < len(s) else -1
        while node[1] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        leaf = [len(s), None, [i]]
        if node[1] is not None and node[0] == depth:
            node[1][mine] = leaf
            return
        below = list(node)
        theirs = other[depth] if depth < len(other) else -1
        node[:] = [depth, {theirs: below, mine: leaf}, None]

    def ordered(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[1] is None:
                out += node[2]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    for group in multikey_quicksort(list(range(len(strings))), strings, shallow) if strings else []:
        if len(group) > 1:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            group = trie.ordered()
        order += group
    return order, [0] + [lcp(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def repeated_windows(contexts: list[bytes], offsets: list[int], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Of segments that share an anchor's k-gram: the runs of windows that another one has too.

    A context holds the bytes of all windows of its segment; offsets has the anchor's
    place in it, which is its first window's distance from the anchor. Runs are
    (first, last) distances of the windows from the anchor.
    """
    n = len(contexts)
    rights = [c[o:] for c, o in zip(contexts, offsets, strict=True)]
    lefts = [c[:o][::-1] for c, o in zip(contexts, offsets, strict=True)]
    order, common = deep_shallow_sort(rights)
    left_order, _ = deep_shallow_sort(lefts)
    left_rank = [0] * n
    for r, i in enumerate(left_order):
        left_rank[i] = r
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def visit(members: list[int], depth: int, above: int) -> None:
        """members agree on depth bytes to the right, and with others on above bytes at most."""
        low, high = max(0, length - depth), length - above - 1
        if low > high:
            return
        members.sort(key=left_rank.__getitem__)
        before = 0
        for i, j in zip(members, [*members[1:], -1], strict=True):
            after = lcp(lefts[i], lefts[j]) if j >= 0 else 0
            first, last = max(low, offsets[i] - counts[i] + 1), min(high, max(before, after), offsets[i])
            if first <= last:
                found[i].append((first, last))
            before = after

    #: The tree of common prefixes, bottom up: a stack of open nodes, each with its depth and members so far.
    endless = 1 << 60
    stack: list[tuple[int, list[int]]] = [(0, [])]
    for k in range(n + 1):
        depth, held = common[k] if k < n else -1, []
        while stack and stack[-1][0] > depth:
            deep, members = stack.pop()
            members += held
            if len(members) > 1:
                visit(members, deep, max(depth, stack[-1][0] if stack else -1))
            held = members
        if k < n:
            if stack[-1][0] == depth:
                stack[-1][1].extend(held)
            else:
                stack.append((depth, held))
            stack.append((endless, [order[k]]))
    return found


# The operator


def _scan(length: int, k: int):
    """(key, text) -> a row a segment: h, key, c (the segment's bytes), at (first window << 8 | windows), back (anchor's distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, x in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                h, anchor, first, count = segments(data, length, k)
                if len(h):
                    back = anchor - first
                    ends = (first + count + length - 1).tolist()
                    whole = [xxhash.xxh3_64_intdigest(data[a:b], seed=c) for a, b, c in zip(first.tolist(), ends, back.tolist(), strict=True)]
                    for column, values in zip(out, (h.view(np.int64), np.full(len(h), key, np.int64), np.array(whole, np.uint64).view(np.int64), first, count, back), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, ("i8", "i8", "i8", "i8", "i4", "i4"), strict=True)], ["h", "key", "c", "first", "count", "back"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text) -> the text's UTF-8 bytes, compressed for the way."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(packed, pa.binary())], ["key", "id", "packed"])


def _contexts(length: int):
    """A document's bytes and its open segments -> the bytes of each of them, once for all rows of a task that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: set[int] = set()
        for batch in batches:
            h, keys, first, count, back, context = [], [], [], [], [], []
            for key, packed, segs in zip(*(batch.column(c) for c in ("key", "packed", "open")), strict=True):
                if (one := key.as_py()) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(one)
                data = unpack.decompress(packed.as_py(), max_output_size=1 << 31)
                for s in segs.as_py():
                    h.append(s["h"])
                    keys.append(key.as_py())
                    first.append(s["first"])
                    count.append(s["count"])
                    back.append(s["back"])
                    context.append(data[s["first"] : s["first"] + s["count"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(keys, pa.int64()), pa.array(first, pa.int64()), pa.array(count, pa.int32()), pa.array(back, pa.int32()), pa.array(context, pa.binary())], ["h", "key", "first", "count", "back", "context"])

    return run


def _sort_groups(length: int):
    """Segments in order of h -> covered runs (key, start, end). A segment that comes again, with another copy of its row, is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], set()

        def close() -> pa.RecordBatch | None:
            keys, starts, ends = [], [], []
            if len(rows) > 1:
                for (key, first, _, back, _), runs in zip(rows, repeated_windows([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length), strict=True):
                    for a, b in runs:  # distances from the anchor: the farthest window comes first
                        keys.append(key)
                        starts.append(first + back - b)
                        ends.append(first + back - a + length)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "end"]) if keys else None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "key", "first", "count", "back", "context")]
            for h, *row in zip(*columns, strict=True):
                if h != now:
                    if (out := close()) is not None:
                        yield out
                    now, rows, held = h, [], set()
                if (row[0], row[1]) not in held:
                    held.add((row[0], row[1]))
                    rows.append(tuple(row))
        if (out := close()) is not None:
            yield out

    return run


def _windows(length: int):
    """Segments of hot k-grams -> a row a window: its hash in 128 bits, key, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, key, first, count, back, context = (batch.column(c)[i].as_py() for c in ("h", "key", "first", "count", "back", "context"))
                digests = [xxhash.xxh3_128_digest(context[j : j + length], seed=(h ^ (back - j)) & (1 << 64) - 1) for j in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([key] * count, pa.int64()), pa.array(range(first, first + count), pa.int64())], ["digest", "key", "start"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's bytes and its covered runs -> what is left of it."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, removed, spans, digests, runs = [], [], [], [], []
        for packed, covered in zip(batch.column("packed"), batch.column("covered"), strict=True):
            data = unpack.decompress(packed.as_py(), max_output_size=1 << 31)
            merged: list[list[int]] = []
            for start, end in sorted((x["start"], x["end"]) for x in covered.as_py() or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            kept, at = hashlib.sha256(), 0
            for start, end in merged:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            digests.append(kept.hexdigest())
            runs.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, removed (the cut runs as [start, end))."""
    bounded_batches(docs.sparkSession)
    k = min(GRAM, length // 2)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    #: Rows that are equal share a key; their segments count as often as the rows do.
    scanned = write_scratch(texts.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(_scan(length, k), "h long, key long, c long, first long, count int, back int"), "segments")
    #: Counted before the shuffle, and written, so that the join may split a k-gram that copies make frequent.
    grams = write_scratch(scanned.groupBy("h").agg(F.count("*").alias("n"), (F.min("c") == F.max("c")).alias("equal")).where("n > 1"), "grams")
    shared = write_scratch(scanned.join(grams.hint("shuffle_hash"), "h").select("h", "c", "key", "first", "count", "back", "equal"), "shared")
    #: Equal segments all repeat; one of them stands for them where their k-gram has others too.
    mixed = shared.where(~F.col("equal"))
    kinds = write_scratch(mixed.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("key", "first", "count", "back")).alias("one")), "kinds")
    again = mixed.join(write_scratch(kinds.where("times > 1").select("h", "c"), "again").hint("shuffle_hash"), ["h", "c"], "left_semi")
    whole = shared.where("equal").unionByName(again.select(*shared.columns)).select("key", F.col("first").alias("start"), (F.col("first") + F.col("count") + (length - 1)).alias("end"))

    packed = texts.mapInArrow(_pack, f"key long, id {kind}, packed binary")
    open_ = kinds.select("h", "one.*").groupBy("key").agg(F.collect_set(F.struct("h", "first", "count", "back")).alias("open"))
    hot_grams = write_scratch(kinds.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "hot")
    contexts = packed.select("key", "packed").join(open_, "key").mapInArrow(_contexts(length), "h long, key long, first long, count int, back int, context binary")
    if hot_grams.isEmpty():
        runs = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups(length), "key long, start long, end long")
    else:
        contexts = write_scratch(contexts.dropDuplicates(["key", "first", "h"]), "contexts")
        runs = contexts.join(hot_grams, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups(length), "key long, start long, end long")
        windows = write_scratch(contexts.join(hot_grams, "h", "left_semi").mapInArrow(_windows(length), "digest binary, key long, start long"), "windows")
        repeated = write_scratch(windows.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest"), "repeated")
        runs = runs.unionByName(windows.join(repeated, "digest", "left_semi").select("key", "start", (F.col("start") + length).alias("end")))
    covered = write_scratch(whole.unionByName(runs).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("covered")), "covered")
    return packed.join(covered, "key", "left").select("id", "packed", "covered").mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>").withColumnRenamed("id", id_col)
