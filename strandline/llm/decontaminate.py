"""Benchmark decontamination: a BM25 index of test items that every passage queries by block-max WAND."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_keep, arrow_map, table

#: Bytes of benchmark text in one index; larger benchmarks are split into several.
INDEX_BYTES = 32 << 20
#: Items of a block, the unit of the bounds, and passages whose bounds are held at a time.
BLOCK, PASSAGES = 8, 256


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(found: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of `size` words; all words as one, where there are fewer."""
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


@dataclass
class Item:
    item_id: int
    found: list[bytes]
    n_answer: int

    @property
    def question(self) -> list[bytes]:
        return self.found[: len(self.found) - self.n_answer]

    @property
    def answer(self) -> list[bytes]:
        return self.found[len(self.found) - self.n_answer :]


@dataclass
class Posting:
    items: list[int] = field(default_factory=list)
    impacts: list[float] = field(default_factory=list)
    most: float = 0.0


@dataclass
class Whole:
    """What scores need of all items, those of other indexes too: document frequencies, the items' number and words, the longest."""

    df: Counter = field(default_factory=Counter)
    n: int = 0
    n_words: int = 0
    longest: int = 0

    def add(self, texts: Iterable[str | None]) -> Whole:
        for w in filter(None, map(words, texts)):
            self.df.update(set(w))
            self.n, self.n_words, self.longest = self.n + 1, self.n_words + len(w), max(self.longest, len(w))
        return self


class BM25Index:
    """Impacts are shares of the score that an item gets from its own words, so that one threshold suits all items."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float, k1: float = 1.2, b: float = 0.75, answer_share: float = 0.25, whole: Whole | None = None):
        self.threshold = threshold
        self.items = [Item(i, w, max(1, round(answer_share * len(w)))) for i, t in items if (w := words(t))]
        counts = [Counter(x.found) for x in self.items]
        whole = whole or Whole().add(t for _, t in items)
        df, mean = whole.df, whole.n_words / max(1, whole.n)
        self.postings: dict[bytes, Posting] = defaultdict(Posting)
        own: list[dict[bytes, float]] = []
        for n, c in enumerate(counts):
            norm = k1 * (1 - b + b * len(self.items[n].found) / mean)
            impact = {w: math.log(1 + (whole.n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + norm) for w, f in c.items()}
            total = sum(impact.values())
            own.append({w: x / total for w, x in impact.items()})
            for w, x in own[-1].items():
                self.postings[w].items.append(n)
                self.postings[w].impacts.append(x)
        self.postings = dict(self.postings)
        self.term = {w: k for k, w in enumerate(self.postings)}
        # of every word the blocks that hold it, and the most that it brings to an item there
        self.n_blocks = -(-len(self.items) // BLOCK)
        blocks, most, sizes = [], [], []
        for p in self.postings.values():
            p.most = max(p.impacts)
            of_block: dict[int, float] = {}
            for n, x in zip(p.items, p.impacts, strict=True):
                of_block[n // BLOCK] = max(of_block.get(n // BLOCK, 0.0), x)
            blocks += of_block.keys()
            most += of_block.values()
            sizes.append(len(of_block))
        self.blocks, self.block_most, self.block_sizes = np.array(blocks, np.int64), np.array(most), np.array(sizes, np.int64)
        self.block_starts = np.cumsum(self.block_sizes) - self.block_sizes
        #: Passages are twice as long as the longest item, and start each half of that: each place for an item is whole in one.
        self.half = max(32, whole.longest)

    def bounds(self, found: list[bytes], start: int, n: int) -> np.ndarray:
        """For n passages from `start` (in halves) on: the most that an item of each block can score."""
        half = self.half
        ids = np.fromiter(map(self.term.get, found[start * half : (start + n + 1) * half], repeat(-1)), np.int64)
        at = np.nonzero(ids >= 0)[0]
        m = max(1, len(self.term))
        held = np.unique(at // half * m + ids[at])  # words of each half, once
        part, ids = held // m, held % m
        # a passage has two halves; a word in both counts once
        both = np.unique(np.concatenate([part[part < n] * m + ids[part < n], (part[part > 0] - 1) * m + ids[part > 0]]))
        part, ids = both // m, both % m
        sizes = self.block_sizes[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.block_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        keys = np.repeat(part, sizes) * self.n_blocks + self.blocks[where]
        return np.bincount(keys, self.block_most[where], minlength=n * self.n_blocks).reshape(n, self.n_blocks)

    def search(self, passage: list[bytes], able: list[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score reaches the threshold, in ascending order.

        able are the blocks whose bound for this passage reaches it; all others are skipped.
        """
        lists = [[self.postings[w], 0] for w in dict.fromkeys(passage) if w in self.postings]
        out: list[tuple[int, float]] = []
        for block in range(self.n_blocks) if able is None else able:
            end = min(len(self.items), (block + 1) * BLOCK)
            for c in lists:
                self._seek(c, block * BLOCK)
            here = [c for c in lists if c[1] < len(c[0].items) and c[0].items[c[1]] < end]
            while here:
                here.sort(key=lambda c: c[0].items[c[1]])
                # the pivot: before its item no list's most reaches the threshold
                bound, pivot = 0.0, -1
                for i, c in enumerate(here):
                    bound += c[0].most
                    if bound >= self.threshold:
                        pivot = i
                        break
                if pivot < 0:
                    break
                at = here[pivot][0].items[here[pivot][1]]
                score = 0.0
                for c in here:
                    self._seek(c, at)
                    p, i = c
                    if i < len(p.items) and p.items[i] == at:
                        score += p.impacts[i]
                        c[1] += 1
                if score >= self.threshold:
                    out.append((at, score))
                here = [c for c in here if c[1] < len(c[0].items) and c[0].items[c[1]] < end]
        return out

    @staticmethod
    def _seek(cursor: list, item: int) -> None:
        cursor[1] = bisect_left(cursor[0].items, item, cursor[1])

    def passages(self, found: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """start, end and able blocks of every passage that could reach the threshold."""
        if not self.items or self.term.keys().isdisjoint(found):
            return
        total = max(1, -(-len(found) // self.half) - 1)
        for first in range(0, total, PASSAGES):
            bounds = self.bounds(found, first, min(PASSAGES, total - first))
            for i in np.nonzero(bounds.max(axis=1) >= self.threshold - 1e-9)[0].tolist():
                begin = (first + i) * self.half
                yield begin, min(len(found), begin + 2 * self.half), np.nonzero(bounds[i] >= self.threshold - 1e-9)[0].tolist()

    def leaks(self, text: str | None, shingle: int, overlap: float, answer_overlap: float) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of every item that a passage of the text gives away."""
        found = words(text)
        best: dict[int, tuple[float, float, float]] = {}
        for start, end, able in self.passages(found):
            passage = found[start:end]
            hits = self.search(passage, able)
            if not hits:
                continue
            there = {size: shingles(passage, size) for size in {min(shingle, len(self.items[n].found)) for n, _ in hits}}
            for n, score in hits:
                item = self.items[n]
                size = min(shingle, len(item.found))
                whole = shingles(item.found, size)
                if len(whole & there[size]) < overlap * len(whole):
                    continue
                question = shingles(item.question, min(size, max(1, len(item.question)))) if item.question else set()
                in_question = sum(q in there[size] if len(q) == size else set(q) <= set(passage) for q in question) / max(1, len(question)) if question else 1.0
                in_answer = len(set(item.answer) & set(passage)) / len(set(item.answer))
                if in_question >= overlap and in_answer >= answer_overlap:
                    best[n] = max(best.get(n, (0.0, 0.0, 0.0)), (score, in_question, in_answer))
        return [(self.items[n].item_id, *x) for n, x in sorted(best.items())]


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[BM25Index]:
    """One index, or several by a hash of item_id, of at most about INDEX_BYTES of text each; they score as one would."""
    n_bytes = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-n_bytes // INDEX_BYTES))

    def items(part: int) -> list[tuple[int, str | None]]:
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "text").collect()
        return [(r.item_id, r.text) for r in rows]

    whole = Whole() if parts > 1 else None
    if whole:
        for part in range(parts):
            whole.add(t for _, t in items(part))
    for part in range(parts):
        yield BM25Index(items(part), threshold, whole=whole)


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, shingle: int = 5, overlap: float = 0.75, answer_overlap: float = 0.5) -> DataFrame:
    """The rows of docs that give away no test item, as find_leaks() has them, with all their columns."""
    for index in _indexes(benchmark, threshold):
        docs = arrow_keep(docs, ("text",), lambda cols, index=index: [not index.leaks(t, shingle, overlap, answer_overlap) for t in cols["text"]])
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, shingle: int = 5, overlap: float = 0.75, answer_overlap: float = 0.5) -> DataFrame:
    """A row for each document and test item that it gives away: doc_id, item_id, score, question_overlap, answer_overlap.

    Every whole text is cut into overlapping passages, long enough for any item to be whole in one.  Each passage is a
    BM25 query to the index of items; those that reach `threshold` (of the score that an item gets from its own words)
    are verified: the passage must hold a share of at least `overlap` of the item's and of its question's word
    shingles, and at least `answer_overlap` of the words of its answer, the last quarter of the item.

    The index holds at most INDEX_BYTES of text; a larger benchmark is cut into several indexes by a hash of item_id,
    and each is held against all passages.  Null and empty texts, on either side, give nothing.  Null or repeated
    doc_ids are rows like others; rows of one item_id are items of their own.  Only doc_id, text and item_id are read,
    so that other columns may have any name.  An empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    def search(index: BM25Index) -> DataFrame:
        def kernel(cols: dict):
            out: dict = {"doc_id": [], "item_id": [], "score": [], "question_overlap": [], "answer_overlap": []}
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                for row in index.leaks(text, shingle, overlap, answer_overlap):
                    for c, x in zip(out, (doc_id, *row), strict=True):
                        out[c].append(x)
            yield out

        return arrow_map(docs.select("doc_id", "text"), kernel, schema, batch_rows=256)

    found = None
    for index in _indexes(benchmark, threshold):
        one = search(index)
        found = one if found is None else found.unionByName(one)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
