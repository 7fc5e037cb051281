"""Token-id files: canonical length-limited Huffman codes in independent blocks.

File format, a Parquet table of segments under `<path>/segments`, in the order (part, seq):

* part int, seq long: place of the segment; parts are ranges of doc_id, seq is the number of its first document there
* first long, n long: ids of the part before the segment, ids of the segment
* doc_ids array<long>, lengths array<int>: the documents of the segment in order, and their numbers of ids
* bits binary: the codes of all ids, most significant bit first, zero bits up to a whole byte
* checkpoints array<long>: the bit offset of every block of BLOCK ids; blocks are decoded independently of each other

and `<path>/header`, one row: lengths binary, the code length of every id in one byte each.  Codes are canonical: by
length, then by id.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, released, remove, small_batches, table
from .encoders import encoder

#: Ids of a block, ids after which a segment ends (and of which codes are made at a time), and the longest code.
BLOCK, SEGMENT, LONGEST = 1024, 1 << 18, 18
SEGMENT_SCHEMA = "part int, seq long, first long, n long, doc_ids array<long>, lengths array<int>, bits binary, checkpoints array<long>"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Package-merge: the lengths of an optimal prefix code with no code longer than `longest`; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.nonzero(counts)[0]
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids have no code of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Canonical codes of given lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.longest = int(max(1, self.lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        sizes = self.lengths[order]
        steps = np.int64(1) << (self.longest - sizes)
        begins = np.cumsum(steps) - steps  # of each code in the table
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begins >> (self.longest - sizes)
        self.symbol = np.zeros(1 << self.longest, np.uint32)
        self.symbol[: int(steps.sum())] = np.repeat(order, steps)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bits and the bit offset of each block."""
        held = self.lengths.astype(np.uint8)[ids]
        total = int(held.sum(dtype=np.int64))
        words, checkpoints, offset = np.zeros(total // 32 + 2, np.uint64), [np.zeros(0, np.int64)], 0
        piece = -(-SEGMENT // block) * block
        for begin in range(0, len(ids), piece):
            sizes = held[begin : begin + piece].astype(np.int64)
            ends = np.cumsum(sizes) + offset
            starts = ends - sizes
            offset = int(ends[-1])
            checkpoints.append(starts[::block])
            # each code lies in one 64-bit window that starts at a 32-bit word; halves of one word have no bit in common
            window = self.codes[ids[begin : begin + piece]].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
            for half, at in ((window >> np.uint64(32), starts >> 5), (window & np.uint64(0xFFFFFFFF), (starts >> 5) + 1)):
                firsts = np.nonzero(np.diff(at, prepend=-1))[0]
                words[at[firsts]] += np.add.reduceat(half, firsts)
        return words.astype(">u4").tobytes()[: -(-total // 8)], np.concatenate(checkpoints)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
        """All blocks in step: one id of each block at a time, by one look into the table."""
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((block, len(at)), np.uint32)
        shift = 32 - self.longest
        last = n_ids - (len(at) - 1) * block  # ids of the last block
        for i in range(min(block, n_ids)):
            if i == last:
                at = at[:-1]
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift)
            ids = self.symbol[peek]
            out[i, : len(at)] = ids
            at += self.lengths[ids]
        return out.T.reshape(-1)[:n_ids]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every whole text, append end_id to each, and write the files in ascending order of doc_id.

    Texts are encoded and their ids counted where they are read; the global counts of ids, of bounded number, make the
    code.  What is dealt by ranges of (doc_id, hash of the text, place) are the ids, of two bytes each; each range is
    written in order.  Null texts are empty: they have only end_id.  Rows without doc_id come first; rows of one doc_id
    stand side by side, in the order of their texts' hashes, however many they are.  Only doc_id and text are read, so
    that other columns may have any name.  An empty table gives files without segments.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ids = encoder(tokenizer_path, "byte").library.get_vocab_size()
    if n_ids > 1 << 16:
        raise ValueError("ids of more than 16 bits are not supported")
    ids_path, ids_schema = f"{path}/ids", "doc_id long, hash long, place long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and in the end one without ids for each id that came up: (id, its number)."""
        names, of, total = ["doc_id", "hash", "place", "ids"], encoder(tokenizer_path, "byte"), np.zeros(n_ids, np.int64)
        place = TaskContext.get().partitionId() << 33
        for b in batches:
            flat, edges = of.encode(b.column(2))
            flat = np.insert(flat, edges[1:], end_id).astype("<u2")
            edges = edges + np.arange(len(edges))
            total += np.bincount(flat, minlength=n_ids)
            ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(np.arange(place, place + b.num_rows)), ids], names)
            place += b.num_rows
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen]), pa.array(np.zeros(len(seen), np.int64)), pa.nulls(len(seen), pa.binary())], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows.mapInArrow(released(encode), ids_schema).write.option("compression", "zstd").parquet(ids_path)
    encoded = spark.read.schema(ids_schema).parquet(ids_path)

    counts = np.zeros(n_ids, np.int64)
    for r in encoded.where("ids is null").groupBy("doc_id").agg(F.sum("hash").alias("n")).collect():
        counts[r.doc_id] = r.n
    lengths = code_lengths(counts)
    code = Code(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/header")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[pa.RecordBatch] = []

        def segment() -> pa.RecordBatch:
            ids = [np.frombuffer(x.as_buffer(), "<u2") for b in held for x in b.column(1) if x.is_valid]
            bits, checkpoints = code.encode(np.concatenate(ids))
            cols = {
                "part": [part], "seq": [seq], "first": [first], "n": [sum(map(len, ids))], "doc_ids": [pa.concat_arrays([b.column(0) for b in held])], "lengths": [list(map(len, ids))], "bits": [bits], "checkpoints": [checkpoints],
            }
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], list(cols))

        for batch in batches:
            n = pc.binary_length(batch.column(1)).to_numpy() // 2
            at = 0
            while at < len(n):  # rows up to the end of the segment, the one that reaches it included
                take = min(len(n) - at, 1 + int(np.searchsorted(np.cumsum(n[at:]), SEGMENT - size)))
                held.append(batch.slice(at, take))
                size += int(n[at : at + take].sum())
                at += take
                if size >= SEGMENT:
                    yield segment()
                    seq, first, size = seq + sum(b.num_rows for b in held), first + size, 0
                    held.clear()
        if held:
            yield segment()

    order = ("doc_id", "hash", "place")
    dealt = encoded.where("ids is not null").repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(released(pack), SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    remove(spark, ids_path)


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Per document of the files, in them: doc_id, start (ids of all documents before it) and ids (4-byte little-endian).

    With digests, n_tokens and ids_crc32 (of these bytes) stand for ids.  Segments are decoded where they are read:
    they say how many ids of their part precede them, and the parts' sizes, as many as there are parts, go with the task.
    """
    small_batches(spark)
    code = Code(np.frombuffer(spark.read.parquet(f"{path}/header").first().lengths, np.uint8))
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    begins, total = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        begins[r.part] = total
        total += r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, first, doc_ids, lengths, bits, checkpoints = (b.column(i)[row] for i in range(6))
                lengths = lengths.values.to_numpy()
                edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                ids = code.decode(bits.as_py(), checkpoints.values.to_numpy(), int(edges[-1])).astype("<u4")
                for at in range(0, len(lengths), 512):
                    few, n = edges[at : at + 513], lengths[at : at + 512]
                    raw = memoryview(ids[few[0] : few[-1]]).cast("B")
                    places = 4 * (few - few[0])
                    cols = [doc_ids.values.slice(at, len(n)), pa.array(begins[part.as_py()] + first.as_py() + few[:-1])]
                    if digests:
                        cols += [pa.array(n, pa.int64()), pa.array([zlib.crc32(raw[x:y]) for x, y in itertools.pairwise(places.tolist())], pa.int64())]
                    else:
                        cols.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)]))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digests else ["ids"])])

    read = segments.select("part", "first", "doc_ids", "lengths", "bits", "checkpoints")
    return read.mapInArrow(released(decode), "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), path)
    return read_token_files(spark, path, digests=True)
