"""N-gram Jaccard join: components of documents whose word-shingle sets overlap enough, by T-occurrence search.

Equal sets are one node.  A global order of shingles, frequent ones last, gives each set a prefix; sets that can reach
the threshold share enough of their prefixes, so that only sets that share so much go on, in clusters connected through
shared prefix shingles.  Within a cluster DivideSkip finds the links: the short inverted lists of a set are merged, the
long ones are probed by binary search, for sets that reach the required overlap.  Sets that are connected already need
no link of their own.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, released, salted_join, small_batches, store, table
from .encoders import translated
from .graph import components

#: Shingles of a search task; the frequent shingles that are put last; bits of the filter; bytes of text that are shingled at a time.
TASK_SHINGLES, FREQUENT, FILTER_BITS, SLICE_BYTES = 1 << 19, 1 << 17, 1 << 24, 1 << 20
#: Shingles among which those are sought that several sets hold: one in 131,072 of all comes up there eight times.
COUNTED = 1 << 20
#: Lists of frequent shingles are dealt out by so many salts; lists of so many members at most are paired.
SALTS, SHORT = 64, 16


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: Odd factors of the places in a shingle, powers of the 64-bit golden ratio.
_FACTORS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]


def _mix(h: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


#: A-Z in lower case, and all ASCII white space as blanks.
_WORDS = np.array([c + 32 if 65 <= c <= 90 else 32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its runs of `size` words; of all words as one, where there are fewer.

    Words stand between ASCII white space, with A-Z in lower case.  Texts without words have the empty set.
    """
    n_bytes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(n_bytes, (n_bytes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield from _sets(pc.split_pattern(translated(texts.slice(at, end - at), _WORDS), " "), size)
        at = end


def _sets(lists: pa.ListArray, size: int) -> Iterator[np.ndarray]:
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    found = coded.indices.to_numpy()
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    if "" in names:  # between two blanks stands no word
        word = found != names.index("")
        edges = np.concatenate([[0], np.cumsum(word)])[edges]
        found = found[word]
    h = hashes[found]
    runs = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        runs += h[i : i + len(runs)] * np.uint64(_FACTORS[i])
    runs = _mix(runs)
    for begin, end in itertools.pairwise(edges.tolist()):
        if end - begin >= size:
            total = np.sort(runs[begin : end - size + 1])
            yield total[np.concatenate([[True], total[1:] != total[:-1]])]
        elif end > begin:
            n = end - begin
            yield _mix(np.array([(n + sum(int(x) * f for x, f in zip(h[begin:end], _FACTORS, strict=False))) % (1 << 64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _node(found: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """The name of a set: its own hash, signed.  Where different sets have one hash, a second hash stands for it."""
    name = xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)
    return _second(found) if name in clashes else name


def _second(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 1) - (1 << 63)


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any that reaches the threshold."""
    return -(-n * percent // 100)


def _share(n):
    """So many shingles must two prefixes share that belong to sets of n or more (see prefix)."""
    return 1 + n // 10


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the global order, and how many of them are rare ones.

    The order has rare shingles first, by hash, then frequent ones by rank.  Two sets whose overlap reaches what both
    need share their first common shingles in their prefixes, as many as the less of their _share.
    """
    n = len(found)
    length = min(n, n - needed(n, percent) + _share(n))
    at = np.minimum(np.searchsorted(frequent, found), max(0, len(frequent) - 1))
    is_frequent = frequent[at] == found if len(frequent) else np.zeros(n, bool)
    rare = found[~is_frequent][:length]
    if len(rare) == length:
        return rare, length
    often = found[is_frequent]
    often = often[np.argsort(rank[at[is_frequent]], kind="stable")]
    return np.concatenate([rare, often[: length - len(rare)]]), len(rare)


class _Union:
    def __init__(self, labels: np.ndarray):
        self.parent = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def t_occurrence_links(sets: list[np.ndarray], percent: int = 75, labels: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets whose Jaccard similarity is at least percent / 100.

    No links within sets of one label or between sets that earlier links connect; with `asks`, only such pairs count of
    which one asks.
    """
    m = len(sets)
    labels = np.arange(m) if labels is None else labels
    asks = np.ones(m, bool) if asks is None else asks
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    n, asks, state = n[order], asks[order], _Union(labels[order])
    owner = np.repeat(np.arange(m, dtype=np.int32), n)
    flat = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    flat, postings = flat[by], owner[by]  # inverted lists, each in order of the sets
    begins = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0] if len(flat) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(flat)))
    of_set = np.empty(len(flat), np.int32)
    of_set[by] = np.repeat(np.arange(len(begins), dtype=np.int32), sizes)
    del by, owner, flat
    edges = np.concatenate([[0], np.cumsum(n)])
    out = []
    for q in range(m):
        least = int(needed(n[q], percent))
        lists = of_set[edges[q] : edges[q + 1]]
        lists = lists[sizes[lists] > 1]
        if not n[q] or len(lists) < least:
            continue
        lists = lists[np.argsort(sizes[lists], kind="stable")]
        # DivideSkip: the more long lists are left to probing, the more candidates the short ones bring
        n_long = min(least - 1, int(least / (0.0085 * np.log(sizes[lists[-1]] + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, times = _merge([postings[begins[t] : begins[t] + sizes[t]] for t in short])
        may = (times >= least - n_long) & (found < q) & (n[found] >= needed(n[q], percent))
        if not asks[q]:
            may &= asks[found]
        found, times = found[may], times[may]
        if not len(found):
            continue
        found_roots = np.array([state.find(j) for j in found]) if len(found) < 64 else state.roots()[found]
        other = found_roots != state.find(q)
        found, times = found[other], times[other]
        for at, t in enumerate(long):
            if not len(found):
                break
            held = postings[begins[t] : begins[t] + sizes[t]]
            place = np.searchsorted(held, found)
            times = times + (held[np.minimum(place, len(held) - 1)] == found)
            able = times + (len(long) - at - 1) >= least
            found, times = found[able], times[able]
        for j, overlap in zip(found.tolist(), times.tolist(), strict=True):
            if 100 * overlap >= percent * (n[q] + n[j] - overlap) and state.join(q, j):
                out.append((int(order[q]), int(order[j])))
    return out


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and how many lists hold each: by a heap if they are few, else by sorting all."""
    if sum(map(len, lists)) <= 64:
        members: list[int] = []
        times: list[int] = []
        for x in heapq.merge(*(x.tolist() for x in lists)):
            if members and members[-1] == x:
                times[-1] += 1
            else:
                members.append(x)
                times.append(1)
        return np.array(members, np.int64), np.array(times, np.int64)
    return np.unique(np.concatenate(lists), return_counts=True)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach, its own included.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct word shingles.  Null and
    empty texts and those without words have no shingles and link with nothing.  Rows without doc_id take part, but
    give no component_id; a component of such rows only has none.  Rows of one doc_id are nodes of their own.  Only
    doc_id and text are read, so that other columns may have any name.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (doc_id, n, node), and of shingles that several sets of some documents hold (hash, times)."""
        names, kinds = ["of_document", "a", "n", "node", "second"], [pa.bool_(), *[pa.int64()] * 4]
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def several() -> pa.RecordBatch:
            flat, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            flat, times = _signed(flat[times > 2]), times[times > 2]
            return pa.RecordBatch.from_arrays([pa.array([False] * len(flat), kinds[0]), pa.array(flat), pa.array(times, pa.int64()), *[pa.nulls(len(flat), pa.int64())] * 2], names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = b.slice(at, 256)
                sets = list(shingle_sets(cols.column(1), size))
                nodes, seconds = ([f(s) if len(s) else None for s in sets] for f in (_node, _second))
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(sets), kinds[0]), cols.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (map(len, sets), nodes, seconds))], names)
                for s, node in zip(sets, nodes, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append(s)
                if sum(map(len, held)) > COUNTED:
                    yield several()
                    held.clear()
        yield several()

    found = store(docs.mapInArrow(released(summaries), "of_document boolean, a long, n long, node long, second long"), "jaccard-documents")
    # of n different sets n^2 / 2^65 pairs have one hash: a few at the most, which get their second hash as name
    clash = found.where("node is not null").groupBy("node").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y")
    clashes = frozenset(r.node for r in clash.select("node").collect())
    name = F.when(F.col("node").isin(*clashes), F.col("second")).otherwise(F.col("node")) if clashes else F.col("node")
    documents = found.where("of_document").select(F.col("a").alias("doc_id"), "n", name.alias("node"))
    often = found.where("not of_document").groupBy("a").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "a").limit(FREQUENT).toPandas()
    often = often.sort_values(["times", "a"], kind="stable")
    frequent = often["a"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(frequent)
    frequent, rank = frequent[by], by

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                hashes, salts, nodes, asks = [], [], [], []
                for s in shingle_sets(b.column(1).slice(at, 256), size):
                    if not len(s) or (node := _node(s, clashes)) in seen:
                        continue
                    seen.add(node)
                    first, rare = prefix(s, frequent, rank, percent)
                    hashes.append(first)
                    salts.append(np.where(np.arange(len(first)) < rare, 0, 1 + node % SALTS).astype(np.int32))
                    nodes.append(np.full(len(first), node, np.int64))
                    asks.append(np.full(len(first), _share(needed(len(s), percent)), np.int32))
                if hashes:
                    cols = [_signed(np.concatenate(hashes)), np.concatenate(salts), np.concatenate(nodes), np.concatenate(asks)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["hash", "salt", "node", "share"])

    lists = Window.partitionBy("hash", "salt")
    rows = docs.mapInArrow(released(prefixes), "hash long, salt int, node long, share int")
    # copies in several partitions may have brought a row several times
    together = rows.withColumn("low", F.min("node").over(lists)).withColumn("high", F.max("node").over(lists))
    shared = store(together.where("low <> high or salt > 0").select("hash", "salt", "node", "share").distinct(), "jaccard-prefixes")
    cluster_of = components(_candidates(shared))

    sizes = documents.where("node is not null").select("node", "n").distinct()
    members = store(cluster_of.join(sizes, "node").select("node", "n", F.col("component").alias("cluster")), "jaccard-members")
    sets = store(_sets_of(docs, members, size, clashes), "jaccard-sets")
    links = _search(members, sets, percent)
    component = components(links)

    labelled = salted_join(documents, component, "node", "doc_id").withColumn("component", F.coalesce("component", "node"))
    labelled = store(labelled, "jaccard-labelled")
    least = labelled.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return salted_join(labelled, least, "component", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _candidates(shared: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets that can reach the threshold, of prefix rows (hash, salt, node, share).

    A set needs `share` common prefix shingles with one partner.  Lists of at most SHORT members are paired and the
    pairs counted; a pair must reach its share, together with the shingles that both have in longer lists.  Sets that
    may reach it by longer lists alone are linked to the least member of each of these: as many edges as members.
    """
    lists = Window.partitionBy("hash", "salt")
    able = shared.groupBy("node").agg(F.count("*").alias("n"), F.max("share").alias("least")).where("n >= least").select("node")
    left = shared.join(able, "node").withColumn("size", F.count("*").over(lists)).where("size > 1 or salt > 0")
    left = store(left.withColumn("long", (F.col("size") > SHORT) | (F.col("salt") > 0)).drop("size"), "jaccard-lists")

    of_node = left.groupBy("node").agg(F.count(F.when(F.col("long"), 1)).alias("n_long"), F.max("share").alias("share"))
    of = lambda x: of_node.select(F.col("node").alias(x), F.col("n_long").alias(f"{x}_long"), F.col("share").alias(f"{x}_share"))
    short = left.where("not long")
    pairs = short.select("hash", F.col("node").alias("a")).join(short.select("hash", F.col("node").alias("b")), "hash").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("n + least(a_long, b_long) >= greatest(a_share, b_share)").select("a", "b")

    often = left.where("long").join(of_node.where("n_long >= share").select("node"), "node").withColumn("hub", F.min("node").over(lists))
    hubs = often.where("salt > 0 and node = hub").select("hash", "node").withColumn("hub", F.min("node").over(Window.partitionBy("hash")))
    stars = often.select(F.col("hub").alias("a"), F.col("node").alias("b")).union(hubs.select("hub", "node")).where("a <> b")
    return pairs.union(stars)


def _sets_of(docs: DataFrame, members: DataFrame, size: int, clashes: frozenset[int]) -> DataFrame:
    """node and set (binary) of the members; a bit filter of fixed size keeps most others from being sent at all."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    parts = members.select("node").coalesce(4).mapInArrow(released(mark), "bits binary").collect()
    packed = np.bitwise_or.reduce([np.zeros(FILTER_BITS // 8, np.uint8), *(np.frombuffer(r.bits, np.uint8) for r in parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                nodes, sets = [], []
                for s in shingle_sets(b.column(1).slice(at, 256), size):
                    if not len(s) or (node := _node(s, clashes)) in seen:
                        continue
                    seen.add(node)
                    place = (node % (1 << 64)) % FILTER_BITS
                    if packed[place >> 3] >> (7 - (place & 7)) & 1:
                        nodes.append(node)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return docs.mapInArrow(released(run), "node long, set binary")


def _search(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members of each cluster."""
    size = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / TASK_SHINGLES).cast("int")
    whole = size.where(blocks == 1)
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(partitions, -(-(whole.agg(F.sum("total")).first()[0] or 0) // TASK_SHINGLES))
    # small clusters share tasks, as many as there are partitions at least; large ones are cut into blocks, and some of their members are in each of these
    small = members.join(whole, "cluster").select("node", F.pmod(F.xxhash64("cluster"), F.lit(n_tasks)).alias("task"), F.lit(-1).alias("block"))
    large = members.join(size.where(blocks > 1).select("cluster", blocks.alias("blocks")), "cluster")
    cut = large.select("node", F.col("cluster").alias("task"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    picks = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(8)]
    hubs = large.groupBy("cluster").agg(F.array_distinct(F.array(*picks)).alias("hubs"), F.first("blocks").alias("blocks"))
    hubs = hubs.select(F.explode("hubs").alias("node"), F.col("cluster").alias("task"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = small.unionByName(cut).unionByName(hubs).withColumn("label", F.col("node")).withColumn("asks", F.lit(True))
    links = store(_run(first, sets, percent), "jaccard-links")
    if large.isEmpty():
        return links

    # between blocks: whoever isn't in the largest component of a large cluster asks all blocks
    labelled = store(large.join(components(links), "node", "left").select("node", "n", "cluster", "blocks", F.coalesce("component", "node").alias("label")), "jaccard-labels")
    most = labelled.groupBy("cluster", "label").agg(F.count("*").alias("times")).groupBy("cluster").agg(F.max_by("label", "times").alias("main"))
    asking = labelled.join(most, "cluster").where(F.col("label") != F.col("main"))
    ask_size = asking.groupBy("cluster").agg(F.ceil(F.sum("n") / TASK_SHINGLES).cast("int").alias("ask_blocks"))
    here = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ask_here = F.pmod(F.xxhash64("node", F.lit(1)), F.col("ask_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = labelled.join(ask_size, "cluster").select("node", "label", "cluster", here.alias("x"), every("ask_blocks").alias("y"), F.lit(False).alias("asks"))
    asks = asking.join(ask_size, "cluster").select("node", "label", "cluster", every("blocks").alias("x"), ask_here.alias("y"), F.lit(True).alias("asks"))
    second = asked.unionByName(asks).select("node", F.col("cluster").alias("task"), (F.col("x") * (1 << 15) + F.col("y")).alias("block"), "label", "asks")
    return links.unionByName(_run(second, sets, percent))


def _run(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def links(rows: pa.Table) -> pa.Table:
        node, label, asks = rows.column("node").to_numpy(), rows.column("label").to_numpy(), rows.column("asks").to_numpy()
        # a node that is there several times, as a copy or as a hub, counts once, and asks if one of them does
        order = np.lexsort((~asks, node))
        once = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])] if len(order) else order
        raw = rows.column("set").take(pa.array(once)).to_pylist()
        found = t_occurrence_links([np.frombuffer(s, np.uint64) for s in raw], percent, label[once], asks[once])
        a, b = np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64)
        del raw, rows
        give_back()
        return pa.table({"a": pa.array(node[once][a], pa.int64()), "b": pa.array(node[once][b], pa.int64())})

    return tasks.join(sets, "node").groupBy("task", "block").applyInArrow(links, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM base
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pair_counts AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS o
  FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM pair_counts WHERE 100 * o >= 75 * (nx + ny - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT e.y, reach.r FROM reach JOIN edges e ON reach.d = e.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id
FROM sets s JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = s.doc_id
"""
