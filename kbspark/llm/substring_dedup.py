"""Substring dedup by prefix-partitioned suffix trees over words.

Every word position that begins ``window`` words starts a suffix. Suffixes are split into groups by prefixes of variable
length, chosen from counts: rare prefixes of one or two words share a group, a two-word prefix with more suffixes than
fit a task's memory is lengthened to the whole window. A suffix travels as its path from the root down to depth ``window``, 64
bits that begin with the node of its first five words and end with that of all ``window`` words, so that sorting the
paths of a group sorts its suffixes as a tree does, and the common prefix of neighbours tells the depth of the node
above both: the group's own, five words, or ``window`` words. Nodes are told apart at these depths only, and words by
64-bit hashes. The internal nodes of depth ``window`` are the repeats. The first document of such a node keeps its words,
the others lose them; every deeper node (a longer repeat) lies below one and covers no other word, and the consecutive
nodes of a document make up its maximal repeats, which ``keep_spans`` returns.

Documents are dealt into slices by a hash of their id. A slice sends each of its distinct paths once, with the smallest
id that has it, and gets back those that start in a smaller document elsewhere, so a passage that very many documents
share sends one path per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, slices

#: Bits of a word in a prefix class, of which there is one for each two of these; a class is the unit of the groups' plan.
WORD_BITS = 8
CLASSES = 1 << 2 * WORD_BITS
#: Words of the inner node on a path, and its bits; the others are those of the whole window.
INNER_WORDS, INNER_BITS = 5, 16
WHOLE_BITS = 64 - INNER_BITS
_SEED = np.random.default_rng(7919)
_ODD = _SEED.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PREFIX = _SEED.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the space and the control characters 09 to 0D."""
    return (text or "").encode().split()


def paths(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix class and path of every suffix of one document's word hashes that has ``window`` words."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mix = lambda x: (x ^ (x >> np.uint64(29))) * _ODD[0]
    whole = np.zeros(n, np.uint64)
    inner = None
    for k in range(window):
        whole += hashes[k : k + n] * _ODD[k % len(_ODD)]
        if k + 1 == min(INNER_WORDS, window):
            inner = mix(whole)
        if k % len(_ODD) == len(_ODD) - 1:
            whole ^= whole >> np.uint64(31)
    low = np.uint64(INNER_BITS)
    path = (inner >> (np.uint64(64) - low) << (np.uint64(64) - low)) | (mix(whole) >> low)
    word = (hashes * _PREFIX[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    second = word[1 : n + 1] if window > 1 else word[:n]
    return word[:n] << WORD_BITS | second, path


def subtree(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of a group's suffixes, and how deep each meets the one before it: 0 the group's prefix, 1 the
    inner node's words, 2 all words of the window."""
    order = np.argsort(path, kind="stable")
    apart = path[order][1:] ^ path[order][:-1]
    depth = np.where(apart == 0, 2, np.where(apart >> np.uint64(64 - INNER_BITS) == 0, 1, 0))
    return order, np.r_[0, depth] if len(path) else depth


def deep_nodes(order: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes below internal nodes of the window's depth, and the number of each one's node."""
    same = depth == 2
    below = same | np.r_[same[1:], False] if len(same) else same
    return order[below], np.cumsum(~same[below]) - 1


class Plan:
    """Groups of prefixes: classes that share a group, and how many bits of the whole window lengthen a frequent class.

    A frequent prefix is lengthened to all words of the window at once, so that one with a single continuation of five
    words and very many beyond (a template's opening) falls apart too; only equal windows must stay together, of which a
    slice sends one.
    """

    def __init__(self, counts: np.ndarray, most: int):
        self.base, self.longer = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        group = filled = 0
        for c, n in enumerate(counts.tolist()):
            if n > most:
                group += filled > 0
                self.longer[c] = min(WHOLE_BITS, max(1, (-(-n // most) - 1).bit_length()))
                self.base[c] = group
                group, filled = group + (1 << int(self.longer[c])), 0
            else:
                if filled + n > most:
                    group, filled = group + 1, 0
                self.base[c], filled = group, filled + n
        self.groups = group + 1

    def of(self, cls: np.ndarray, path: np.ndarray) -> np.ndarray:
        bits = self.longer[cls]
        whole = (path & np.uint64((1 << WHOLE_BITS) - 1)).astype(np.int64)
        return self.base[cls] + np.where(bits > 0, whole >> (WHOLE_BITS - bits), 0)


def _slice_paths(ids: list, texts: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of each document: document number, position, class and path. Null ids have none."""
    hashes, used = hash_words([t.encode() if t and i is not None else b"" for i, t in zip(ids, texts, strict=True)])
    cls, path = paths(hashes, window)  # of all documents in one run; windows that reach into the next one go
    doc = np.repeat(np.arange(len(used)), used)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(used) - used, used)
    whole = doc[: len(path)] == doc[window - 1 : window - 1 + len(path)]
    return doc[: len(path)][whole], at[: len(path)][whole], cls[whole], path[whole]


def ranks(ids: pa.Array) -> np.ndarray:
    """The rank of each id among the distinct ones."""
    if pa.types.is_integer(ids.type):
        return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    coded = ids.dictionary_encode()
    place = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable"), kind="stable")
    return place[coded.indices.to_numpy()]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group_paths: int = 3_000_000, slice_words: int = 500_000, keep_text: bool = False, keep_spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts in a document with a smaller id.

    One row per input row: ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space, with
    ``keep_text`` those as ``kept_text``, and with ``keep_spans`` the removed repeats as ``spans`` (first word, number of
    words); ``keep`` names other columns to carry along, whatever they are called. Windows are judged on the input, not on
    what is left of it. A null text has no words; texts with fewer words than a window lose none; texts of any length are
    read whole. Rows with a null id keep all words and take none from others; rows with equal ids are one document's and
    take none from each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    carried = [f"carried_{i}" for i in range(len(keep or []))]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep or [], carried, strict=True)])
    kind = source.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES, np.int64)
        for b in slices(batches, 256):
            cls = _slice_paths(b.column(0).to_pylist(), b.column(1).to_pylist(), window)[2]
            sums += np.bincount(cls, minlength=CLASSES)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["class", "n"])

    counts = np.zeros(CLASSES, np.int64)
    found = source.select("id", "text").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()  # CLASSES rows at most
    counts[found["class"].to_numpy(int)] = found["n"].to_numpy(int)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = int(counts.sum())
    plan = spark.sparkContext.broadcast(Plan(counts, max(1000, min(group_paths, -(-total // least)))))
    parts = max(least, -(-total // (4 * slice_words)))
    n_slices = max(4 * parts, -(-total // slice_words))
    # Both readers of this exchange are in one plan, so the texts are shuffled once.
    dealt = source.select(F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int").alias("slice"), "id", "text", *carried).repartition(parts, "slice")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = plan.value
        names = ["slice", "group", "ids", "sizes", "paths"]

        def distinct(slice_: int, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            ids = [r[0] for r in rows]
            doc, _, cls, digest = _slice_paths(ids, [r[1] for r in rows], window)
            order = np.lexsort((doc, digest))
            first = order[np.r_[True, digest[order][1:] != digest[order][:-1]]] if len(order) else order
            group = plan_.of(cls[first], digest[first])
            order = np.lexsort((doc[first], group))
            first, group = first[order], group[order]
            out: list[list] = [[] for _ in names]
            for g in np.unique(group):
                a, e = np.searchsorted(group, (g, g + 1))
                which, sizes = np.unique(doc[first[a:e]], return_counts=True)
                row = [slice_, int(g), [ids[i] for i in which], sizes.astype("<u4").tobytes(), digest[first[a:e]].tobytes()]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.list_(schema_id), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        held: dict[int, list[tuple]] = {}
        schema_id = pa.int64()
        for b in batches:  # a partition holds a few slices, each of a bounded number of words
            schema_id = b.schema.field(1).type
            for s, i, t in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                if i is not None:
                    held.setdefault(s, []).append((i, t))
        while held:
            yield distinct(*held.popitem())

    sent = dealt.mapInArrow(send, f"slice int, group long, ids array<{kind}>, sizes binary, paths binary")

    def resolve(table: pa.Table) -> pa.Table:
        """The paths of a group's deep nodes that start in a smaller document of another slice, by slice."""
        path = [np.frombuffer(p, np.uint64) for p in table.column("paths").to_pylist()]
        rank = ranks(table.column("ids").combine_chunks().flatten())
        first = np.repeat(rank, np.concatenate([np.frombuffer(s, "<u4") for s in table.column("sizes").to_pylist()]))
        owner = np.repeat(np.arange(len(path)), [len(d) for d in path])
        digest = np.concatenate(path)
        inner, node = deep_nodes(*subtree(digest))
        least = np.full(int(node[-1]) + 1 if len(node) else 0, len(rank))
        np.minimum.at(least, node, first[inner])
        lose = inner[first[inner] > least[node]]
        lose = lose[np.argsort(owner[lose], kind="stable")]
        which, at = np.unique(owner[lose], return_index=True)
        found = np.split(digest[lose], at[1:]) if len(at) else []
        return pa.table({"slice": table.column("slice").take(pa.array(which)), "paths": pa.array([f.tobytes() for f in found], pa.binary())})

    answers = sent.groupBy("group").applyInArrow(resolve, "slice int, paths binary")

    def strip(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("id").to_pylist(), left.column("text").to_pylist()
        words = [words_of(t) for t in texts]
        doc, at, _, digest = _slice_paths(ids, texts, window)
        outside = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in right.column("paths").to_pylist()] or [np.zeros(0, np.uint64)]))
        place = np.minimum(np.searchsorted(outside, digest), max(0, len(outside) - 1))
        lose = outside[place] == digest if len(outside) else np.zeros(len(digest), bool)
        ranked = {x: i for i, x in enumerate(sorted({i for i in ids if i is not None}))}
        rank = np.array([ranked.get(i, 0) for i in ids], np.int64)[doc] if len(doc) else doc
        order = np.lexsort((rank, digest))  # within the slice
        if len(order):
            node = np.cumsum(np.r_[True, digest[order][1:] != digest[order][:-1]]) - 1
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            lose[order] |= rank[order] > rank[order][start][node]
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        removed, sha, kept, spans = [], [], [], []
        for i, w in enumerate(words):
            hit = at[edge[i] : edge[i + 1]][lose[edge[i] : edge[i + 1]]]
            if len(hit):
                step = np.zeros(len(w) + 1, np.int64)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                left_over = [x for x, c in zip(w, gone.tolist(), strict=True) if not c]
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                spans.append([{"start": int(a), "length": int(e - a)} for a, e in edges] if keep_spans else None)
            else:
                left_over = w
                spans.append([])
            whole = b" ".join(left_over)
            removed.append(len(w) - len(left_over))
            sha.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole.decode())
        out = {"id": left.column("id"), "n_words": pa.array(map(len, words), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        out |= {c: left.column(c) for c in carried}
        out |= {"kept_text": pa.array(kept, pa.string())} if keep_text else {}
        return pa.table(out | ({"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))} if keep_spans else {}))

    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    out = dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(strip, f"id {kind}, n_words long, n_removed long, kept_sha256 string{kinds}" + ", kept_text string" * keep_text + ", spans array<struct<start:int,length:int>>" * keep_spans)
    return out.withColumnsRenamed({"id": id_col} | dict(zip(carried, keep or [], strict=True)))
