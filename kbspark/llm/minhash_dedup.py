"""MinHash near-dedup by an LSH forest.

Every tree of the forest is one sorted order of all signatures: the order by the signature read from the tree's own
place on, around its end. Each order is dealt by ranges, so a hot region spreads over tasks like any other. In sorted
order the longest common prefixes of neighbours give the regions: documents that share a prefix of the least depth form
one, and a region with many members is followed to deeper prefixes until it is small, so each region finds its own
depth. The pairs of a small region, and every document and its two neighbours of longest common prefix, are estimated
from their signatures; those well within reach join candidate clusters, and so does, unestimated, a region that stays
large at the last depth. Each cluster then compares full shingle sets: every link is confirmed, and sets whose rarest
shingles differ, which cannot link, are spared the comparison.

Documents with equal shingle sets are one class from the start, so groups of copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, materialise, slices, task_partitions
from .graph import connected_components

#: Trees and the values between two trees' places, which make up a signature; depths that regions start and end at.
TREES, STEP, LEAST_DEPTH, LAST_DEPTH = 16, 6, 3, 8
VALUES = TREES * STEP
_RANDOM = np.random.default_rng(104729)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes; fewer words than ``width`` are one shingle."""
    hashes, counts = hash_words([(t or "").encode().lower() for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        h, at = hashes[at : at + n], at + n
        size, most = max(1, n - width + 1), min(width, n)
        total = np.zeros(size, np.uint64)
        for k in range(most):
            total += h[k : k + size] * _PLACE[k]
        out.append(np.unique(_mix(total + np.uint64(most))) if n else np.zeros(0, np.uint64))
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """The shingles of one text."""
    return shingle_sets([text], width)[0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A byte of each min-hash value of non-empty sets: sets x VALUES. Unequal values have equal bytes once in 256 times."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.stack([np.minimum.reduceat((whole ^ f) * m, starts) for m, f in zip(_MULTIPLY, _FLIP, strict=True)], 1)
    return (_mix(least) * _PLACE[0] >> np.uint64(56)).astype(np.uint8)


def lcp_before(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row of a sorted order shares with the row before it, 0 across trees."""
    same = keys[1:] == keys[:-1]
    length = np.where(same.all(1), keys.shape[1], same.argmin(1))
    length[tree[1:] != tree[:-1]] = 0
    return np.r_[0, length] if len(keys) else np.zeros(0, np.int64)


def regions(lcp: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a sorted order that share a prefix: of the least depth at which they have ``most`` rows or fewer, or the last."""
    todo = [(0, len(lcp), LEAST_DEPTH)]
    while todo:
        low, high, depth = todo.pop()
        starts = np.r_[low, low + 1 + np.flatnonzero(lcp[low + 1 : high] < depth), high]
        sizes = np.diff(starts)
        for at in np.flatnonzero(sizes > 1):
            if sizes[at] <= most or depth == LAST_DEPTH:
                yield int(starts[at]), int(starts[at + 1])
            else:
                todo.append((int(starts[at]), int(starts[at + 1]), depth + 1))


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) that connect whatever a symmetric matrix of booleans connects."""
    label, out = np.arange(len(near)), []
    for i, row in enumerate(near):
        other = np.flatnonzero(row & (label != label[i]))
        if len(other):
            labels, first = np.unique(label[other], return_index=True)
            out += [(i, int(j)) for j in other[first]]
            label[np.isin(label, labels)] = label[i]
    return out


def forest_edges(tree: np.ndarray, keys: np.ndarray, least: float, most: int) -> np.ndarray:
    """Candidate edges between positions of a sorted order: n x 2."""
    lcp = lcp_before(tree, keys)
    beside = np.flatnonzero(lcp >= LEAST_DEPTH)
    beside = beside[(keys[beside] == keys[beside - 1]).mean(1) >= least]
    found = [np.c_[beside - 1, beside]]
    for low, high in regions(lcp, most):
        if high - low > most:
            found.append(np.c_[np.full(high - low - 1, low), np.arange(low + 1, high)])
        elif high - low > 2:
            part = keys[low:high]
            near = (part[:, None] == part[None]).mean(2) >= least
            edges = spanning(near)
            if edges:
                found.append(np.array(edges) + low)
    return np.concatenate(found)


def _overlap(one: np.ndarray, whole: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one set with each set of a concatenation."""
    at = np.minimum(np.searchsorted(one, whole), len(one) - 1)
    return np.add.reduceat((one[at] == whole).astype(np.int64), starts)


def exact_links(sets: list[np.ndarray], percent: int, guests: np.ndarray | None = None, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) that connect all linked sets; every link is between two given sets.

    A linked set shares at least ``percent`` of its own shingles. With the shingles of all sets in one order, rarest first,
    two linked sets therefore meet among the first shingles of both, as many as may be missing and one more, and only
    sets that do are compared. Memory is in proportion to the shingles. With ``guests`` only pairs with one of these are
    compared; sets of equal ``parts`` are connected already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    _, rank, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((rank, times[rank], owner))
    length = size + 1 - -(-percent * size // 100)
    early = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) < length[owner]
    token, holder = rank[order][early], owner[early]
    begin = np.cumsum(length) - length
    by = np.argsort(token, kind="stable")
    held, low, high = holder[by], np.searchsorted(token[by], token), np.searchsorted(token[by], token, "right")
    # the sets of every shingle, and each set's shingles that others share
    sharers = owner[np.argsort(rank, kind="stable")]
    ends = np.cumsum(times)
    shared = times[rank] > 1
    mine, edge = rank[shared], np.searchsorted(owner[shared], np.arange(n + 1))
    out = []
    for i in range(n) if guests is None else np.flatnonzero(guests).tolist():
        at = slice(begin[i], begin[i] + length[i])
        near = np.unique(np.concatenate([held[x:y] for x, y in zip(low[at], high[at], strict=True)]))
        near = near[(label[near] != label[i]) & (100 * size[near] >= percent * size[i]) & (100 * size[i] >= percent * size[near])]
        if not len(near):
            continue
        own = mine[edge[i] : edge[i + 1]]
        if times[own].sum() < 16 * size[near].sum():
            inter = np.bincount(np.concatenate([sharers[ends[r] - times[r] : ends[r]] for r in own.tolist()]), minlength=n)[near]
        else:
            inter = _overlap(sets[i], np.concatenate([sets[j] for j in near]), np.cumsum(np.r_[0, size[near][:-1]]))
        linked = near[100 * inter >= percent * (size[i] + size[near] - inter)]
        labels, first = np.unique(label[linked], return_index=True)
        out += [(i, int(j)) for j in linked[first]]
        label[np.isin(label, labels)] = label[i]
    return out


def near_duplicate_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 85,
    margin: float = 0.17,
    region_rows: int = 256,
    cluster_shingles: int = 3_000_000,
) -> DataFrame:
    """Link documents with 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.

    One row per input row: ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included), ``kept``
    (its id is its component's). Texts that are null or without words have an empty set and link with nothing; fewer
    words than ``width`` are one shingle. Equal sets are linked. Rows that repeat an id are rows of their own; with a null
    id ``kept`` is false. An empty table gives an empty result.

    A pair is a candidate where it shares a region in one of the 16 trees, with a probability of at least
    1 - (1 - J**d)**16 for regions of depth d: at J = 0.85 over 0.999999 where d = 3, and 0.994 (0.95 at J = 0.8) in the
    densest regions, of d = 8, unless other documents or neighbours in an order connect it. The estimate of 96 values may
    fall short by ``margin``, over four standard deviations. There is no bound on a region's or cluster's members: a
    region over ``region_rows`` at the last depth is one candidate cluster. Links are exact.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            sets = shingle_sets(b.column(1).to_pylist(), width)
            full = [s for s in sets if len(s)]
            made = iter(signatures(full)) if full else iter(())
            columns = [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()),
                pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "signature"])

    signed = materialise(source.mapInArrow(sign, f"id {kind}, n long, digest binary, signature binary"))
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            signature = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
            for t in range(TREES):
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES), len(signature), [None, pa.py_buffer(np.roll(signature, -t * STEP, 1).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(signature), t, np.int32)), keys.cast(pa.binary()), b.column(0)], ["tree", "key", "node"])

    planted = classes.select("node", "signature").mapInArrow(plant, "tree int, key binary, node long")
    tasks = task_partitions(spark, classes.count() * TREES, 65_536)
    least = percent / 100 - margin

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of a range of an order, and the rows of its first and last region, for the borders of ranges."""
        rows, place = list(batches), TaskContext.get().partitionId()  # of a bounded number of rows; ranges are in order
        if rows:
            edges, table = edges_of(pa.Table.from_batches(rows))
            apart = np.flatnonzero(lcp_before(table.column(0).to_numpy(), keys_of(table)) < LEAST_DEPTH)
            first = np.arange(min(region_rows, apart[1] if len(apart) > 1 else len(table)))
            last = np.arange(max(len(table) - region_rows, apart[-1]), len(table))
            sides = table.take(pa.array(np.r_[first, last]))
            border = np.r_[np.full(len(first), place - 1), np.full(len(last), place)]
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), *(pa.nulls(len(edges), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(border), pa.int64())] * 2 + [pa.array(border), *(c.combine_chunks() for c in sides.columns)], names)

    names = ["a", "b", "border", "tree", "key", "node"]
    keys_of = lambda table: np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(-1, VALUES)

    def edges_of(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
        edges = table.column("node").to_numpy()[forest_edges(table.column("tree").to_numpy(), keys_of(table), least, region_rows)]
        return np.unique(np.sort(edges, 1), axis=0), table

    def across(table: pa.Table) -> pa.Table:
        edges = edges_of(table.select(["tree", "key", "node"]).sort_by([(c, "ascending") for c in ("tree", "key", "node")]))[0]
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    # The node spreads equal keys over ranges; what meets at the border of two ranges is compared apart.
    orders = planted.repartitionByRange(tasks, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = materialise(orders.mapInArrow(estimate, "a long, b long, border long, tree int, key binary, node long"))
    borders = found.filter("border is not null").select("border", "tree", "key", "node").groupBy("border").applyInArrow(across, "a long, b long")
    likely = found.filter("a is not null").select("a", "b").union(borders)
    clusters = materialise(connected_components(likely).join(classes.select("node", "id", "n", "digest"), "node"))
    links = _confirm(source, clusters, width, percent, cluster_shingles)
    parts = connected_components(links)
    linked = parts.join(classes.select("node", "id"), "node")
    first = linked.groupBy("component").agg(F.min("id").alias("first"))
    of_class = parts.join(first, "component").select("node", "first")
    of_class = classes.select("node", "digest", "id").join(of_class, "node", "left").select("digest", F.coalesce("first", "id").alias("component_id"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    out = out.select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def digest(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _confirm(source: DataFrame, clusters: DataFrame, width: int, percent: int, most: int, most_sets: int = 8192, least_sets: int = 256) -> DataFrame:
    """Confirmed links ``(a, b)`` that connect whatever is linked within each cluster.

    A cluster is dealt into chunks of ``most`` shingles and ``most_sets`` sets at most, and of as few as ``least_sets``
    while there are under 16, so that a large cluster is not one task. Its chunks meet its first member, and
    whoever is then not in the cluster's largest component meets all of its chunks, so that no link between chunks is
    lost: chunks of such guests and of all members are compared in blocks, each bounded on both sides.
    """
    spark = source.sparkSession
    bound = lambda total, sets: F.ceil(F.greatest(total / most, sets / most_sets, F.least(sets / least_sets, F.lit(16.0)))).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = clusters.groupBy("component").agg(bound(F.sum("n"), F.count("*")).alias("chunks"), F.min("node").alias("head"))
    split = materialise(clusters.join(sizes, "component").withColumn("home", own("chunks")))
    clustered = split.select("component").distinct().count()
    names = ["component", "left", "right", "node", "id", "n", "digest", "guest", "part"]

    def compare(members: DataFrame, whole: bool) -> DataFrame:
        """Links within each (component, left, right); unless ``whole`` just those of members marked ``guest``."""
        rows, total = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        tasks = max(task_partitions(spark, 0, 1), clustered // 500, -(-total // most), -(-rows // most_sets))
        placed = members.withColumn("task", F.pmod(F.xxhash64("component", "left", "right"), F.lit(tasks)).cast("int"))
        # The smallest id of a class holds its text; other rows of that id have other digests.
        texts = placed.join(source, "id").select("task", "component", "left", "right", "node", "digest", "guest", "part", "text")

        def link(table: pa.Table) -> pa.Table:
            where: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("component", "left", "right")), strict=True)):
                where.setdefault(key, []).append(i)
            found = []
            for at in where.values():  # a block's sets at a time
                group: dict[int, list] = {}
                rows = table.take(pa.array(at))
                for node, wanted, guest, part, text in zip(*(rows.column(c).to_pylist() for c in ("node", "digest", "guest", "part", "text")), strict=True):
                    if node in group:
                        group[node][1] |= guest
                        continue
                    s = shingles(text, width)
                    if digest(s) == wanted:
                        group[node] = [s, guest, part]
                if len(group) < 2:
                    continue
                nodes = sorted(group)
                sets, guests, parts = zip(*(group[x] for x in nodes), strict=True)
                found += [(nodes[i], nodes[j]) for i, j in exact_links(list(sets), percent, None if whole else np.array(guests), np.array(parts))]
            got = np.array(found, np.int64).reshape(-1, 2)
            return pa.table({"a": got[:, 0], "b": got[:, 1]})

        return texts.groupBy("task").applyInArrow(link, "a long, b long")

    alone = [F.lit(0).alias("right"), "node", "id", "n", "digest", F.lit(False).alias("guest"), F.col("node").alias("part")]
    home = split.select("component", F.col("home").alias("left"), *alone)
    heads = split.filter("chunks > 1 and node = head").select("component", every("chunks").alias("left"), *alone)
    links = materialise(compare(home.union(heads), True))
    large = split.filter("chunks > 1")
    if large.isEmpty():
        return links
    parts = connected_components(links).withColumnRenamed("component", "part")
    state = large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    state = materialise(state)
    count = state.groupBy("component", "part").agg(F.count("*").alias("members"))
    main = count.groupBy("component").agg(F.max_by("part", F.struct("members", -F.col("part"))).alias("main"))
    rest = state.join(main, "component").filter("part <> main")
    lefts = rest.groupBy("component").agg(bound(F.sum("n"), F.count("*")).alias("lefts"))
    guests = rest.join(lefts, "component").withColumn("left", own("lefts")).withColumn("right", every("chunks")).withColumn("guest", F.lit(True))
    hosts = state.join(lefts, "component").withColumn("left", every("lefts")).withColumn("right", F.col("home")).withColumn("guest", F.lit(False))
    blocks = materialise(guests.select(names).union(hosts.select(names)))
    return links.union(materialise(compare(blocks, False)))
