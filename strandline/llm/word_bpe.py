"""BPE encoding through a table of distinct words, decoding through the id-to-piece table."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import released, replayable, small_batches, table
from .encoders import encoder

#: Bytes of text after which a block ends, the unit in which words are counted and joined back; the most buckets of words.
BLOCK_BYTES, BUCKETS = 8 << 20, 4096
#: Words that an encoding task remembers; a partition with more distinct words encodes some of them again.
TABLE_WORDS = 1 << 19
#: Between a letter or digit and one of these the vocabulary always parts two words.
_INNER_CUT = re.compile(r"(?<=[^\W_])(?=[.,;:!?*#$%&()])")


def chunks_of(text: Column) -> Column:
    """The parts of a text between ASCII white space, split by Spark; this vocabulary drops white space.  Null texts are empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ", -1)


def split_chunk(chunk: str) -> list[str]:
    """The words of text without white space: parts that the tokenizer encodes independently of each other.

    A-Z become a-z in words of ASCII, as the tokenizer would do; special strings stay as they are.
    """
    return [w.lower() if w.isascii() and "<|" not in w else w for w in _INNER_CUT.split(chunk) if w]


def _planes(values: np.ndarray) -> bytes:
    """Four-byte numbers, all first bytes together and so on: most numbers are small, so that this compresses well."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


class _Block:
    """Some documents: their distinct chunks, of which each has its words, and the chunk at each position."""

    def __init__(self, held: list[pa.RecordBatch], number: int):
        lists = [b.column(1) for b in held]
        self.doc_ids = pa.concat_arrays([b.column(0) for b in held])
        self.lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        self.stream = coded.indices.to_numpy()
        self.words: dict[str, int] = {}
        self.parts = [[self.words.setdefault(w, len(self.words)) for w in split_chunk(c)] for c in coded.dictionary.to_pylist()]
        # of the place and of the words: were a block read differently the second time, it would not find its words
        state = xxhash.xxh64(f"{TaskContext.get().partitionId()} {number} {len(self.lengths)}")
        state.update("\n".join(self.words).encode("utf-8", "surrogatepass"))
        self.key = state.intdigest() - (1 << 63)

    def payload(self) -> dict:
        order = np.argsort(-np.bincount(self.stream, minlength=len(self.parts)), kind="stable")
        rank = np.empty(len(self.parts), np.int64)
        rank[order] = np.arange(len(order))
        parts = [self.parts[i] for i in order]
        flat = np.array([w for p in parts for w in p], np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        return {
            "block": [self.key], "doc_ids": [self.doc_ids], "lengths": [self.lengths], "n_words": [len(self.words)],
            "stream": [_planes(rank[self.stream])], "n_chunks": [len(sizes)], "sizes": [_planes(sizes)], "n_parts": [len(flat)], "parts": [_planes(flat)],
        }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    held: list[pa.RecordBatch] = []
    size = number = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BLOCK_BYTES:
            yield _Block(held, number)
            held, size, number = [], 0, number + 1
    if held:
        yield _Block(held, number)


PAYLOAD = "block long, doc_ids array<long>, lengths array<int>, n_words int, stream binary, n_chunks int, sizes binary, n_parts int, parts binary"
_WORDS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("places", pa.binary()), ("size", pa.int32()), ("words", pa.binary())])
_IDS_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])
_PAYLOAD_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_words", pa.int32()), ("stream", pa.binary()), ("n_chunks", pa.int32()), ("sizes", pa.binary()), ("n_parts", pa.int32()), ("parts", pa.binary())])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all members of ragged rows, one row after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id and ids (array<int>), as the tokenizer gives them, without special tokens of its own.

    Spark splits texts into chunks between white space, whose words the vocabulary encodes independently.  The distinct
    words of every block of documents go to buckets by hash, a compressed row for each bucket of a block.  There the
    distinct words of all blocks are encoded, each one once, and the ids go back to the blocks, which put them at the
    positions of their words.  What is shuffled is the blocks' few distinct words and, compressed, the positions:
    neither texts nor a row for each word.  There are at most BUCKETS buckets, so that a block's rows are bounded.

    Documents are read twice, for words and for positions.  Both readings must find the same blocks, also after an
    executor is lost: docs that aren't a plain scan of files are written to the shared folder first.

    Null and empty texts have no ids.  Null or repeated doc_ids are rows like others.  Only doc_id and text are read,
    so that other columns may have any name.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = replayable(docs.select("doc_id", "text"), "bpe-documents").select(F.col("doc_id").cast("long").alias("doc_id"), chunks_of(F.col("text")).alias("chunks"))

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(2 * partitions, BUCKETS)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words = list(block.words)
            bucket = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % n_buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = []
            for i in range(n_buckets):
                places = order[edges[i] : edges[i + 1]]
                if len(places):
                    text = "\n".join([words[k] for k in places]).encode("utf-8", "surrogatepass")  # no word has a line feed
                    rows.append({"block": block.key, "bucket": i, "n": len(places), "places": _planes(places), "size": len(text), "words": pa.compress(text, "zstd", asbytes=True)})
            yield pa.RecordBatch.from_pylist(rows, schema=_WORDS_ARROW)

    def payload_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            row = block.payload()
            yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in _PAYLOAD_ARROW], schema=_PAYLOAD_ARROW)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer_path, "word")
        known: dict[str, int] = {}  # the distinct words of this partition's buckets, by their place in starts and sizes
        flat, starts, lengths = array("I"), array("q"), array("q")
        for b in batches:
            for row in b.to_pylist():
                if len(known) > TABLE_WORDS:
                    known.clear()
                    flat, starts, lengths = array("I"), array("q"), array("q")
                words = pa.decompress(row["words"], row["size"], "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")
                at = list(map(known.get, words))
                if None in at:
                    new = [i for i, x in enumerate(at) if x is None]
                    ids, sizes = of.encode_chunks(pa.array([words[i] for i in new], pa.string()))
                    starts.frombytes((len(flat) + np.cumsum(sizes) - sizes).tobytes())
                    flat.frombytes(ids.tobytes())
                    for k, i in enumerate(new, len(lengths)):
                        at[i] = known[words[i]] = k
                    lengths.frombytes(sizes.tobytes())
                at = np.array(at)
                sizes = np.array(lengths, np.int64)[at]
                ids = np.array(flat, np.uint32)[_ragged(np.array(starts, np.int64)[at], sizes)]
                out = {"block": row["block"], "n": row["n"], "places": row["places"], "sizes": _planes(sizes), "n_ids": len(ids), "ids": _planes(ids)}
                yield pa.RecordBatch.from_pylist([out], schema=_IDS_ARROW)

    words = docs.mapInArrow(released(words_of), "block long, bucket int, n int, places binary, size int, words binary").repartition(partitions, "bucket")
    known = words.mapInArrow(released(encode), "block long, n int, places binary, sizes binary, n_ids int, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            starts, sizes, found = np.zeros(row["n_words"], np.int64), np.full(row["n_words"], -1), [np.zeros(0, np.int64)]
            used = 0
            for x in right.to_pylist():
                places, of_word = _unplanes(x["places"], x["n"]), _unplanes(x["sizes"], x["n"])
                if len(places) and places.max() >= len(sizes):
                    break
                sizes[places], starts[places] = of_word, used + np.cumsum(of_word) - of_word
                found.append(_unplanes(x["ids"], x["n_ids"]))
                used += x["n_ids"]
            if (sizes < 0).any() or sum(right.column("n").to_pylist()) != row["n_words"]:
                raise RuntimeError("a block doesn't find its words: its documents were read in another order")
            flat, part_sizes, parts = np.concatenate(found), _unplanes(row["sizes"], row["n_chunks"]), _unplanes(row["parts"], row["n_parts"])
            # ids of each distinct chunk, then of each document
            chunk_flat = flat[_ragged(starts[parts], sizes[parts])] if len(parts) else flat[:0]
            part_ends = np.concatenate([[0], np.cumsum(sizes[parts])]) if len(parts) else np.zeros(1, np.int64)
            edge = np.concatenate([[0], np.cumsum(part_sizes)])
            chunk_starts, chunk_sizes = part_ends[edge[:-1]], part_ends[edge[1:]] - part_ends[edge[:-1]]
            lengths = np.array(row["lengths"], np.int64)
            stream = _unplanes(row["stream"], int(lengths.sum()))
            doc_edges = np.concatenate([[0], np.cumsum(lengths)])
            for at in range(0, len(lengths), 512):  # some documents at a time, to bound memory
                few = stream[doc_edges[at] : doc_edges[min(at + 512, len(lengths))]]
                ids = chunk_flat[_ragged(chunk_starts[few], chunk_sizes[few])]
                ends = np.concatenate([[0], np.cumsum(chunk_sizes[few])])[doc_edges[at : min(at + 512, len(lengths)) + 1] - doc_edges[at]]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                out.append(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][at : at + 512], pa.int64()), lists], ["doc_id", "ids"]))
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in out], schema)

    payload = docs.mapInArrow(released(payload_of), PAYLOAD)
    return payload.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds decoded, the text of ids with special tokens kept: ids are joined with the table of pieces.

    That table has a row for each id of the vocabulary, a fixed number.  Pieces stand between blanks, as the library
    does where a vocabulary file names no decoder; with a byte-level decoder their bytes stand side by side, broken
    characters replaced.  Null ids give null, no ids the empty text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        decoder = (json.load(f).get("decoder") or {}).get("type")
    if decoder not in (None, "ByteLevel"):
        raise ValueError(f"no decoding by {decoder}")
    fields = encoded.schema.fields
    if any(f.name == "decoded" for f in fields):
        raise ValueError("there is a column decoded already")
    at = [f.name for f in fields].index("ids")
    schema = StructType([*fields, StructField("decoded", StringType())])
    state: dict = {}

    def pieces() -> pa.Array:
        if not state:
            library = encoder(tokenizer_path, "byte" if decoder else "word").library
            of: list = [None] * (1 + max(library.get_vocab().values()))
            for piece, i in library.get_vocab().items():
                of[i] = piece
            if decoder:
                from .encoders import _byte_of_char

                char = _byte_of_char()
                of = [p if p is None else bytes(char[c] for c in p) if all(c in char for c in p) else p.encode() for p in of]
            state["pieces"] = pa.array(of, pa.binary() if decoder else pa.string())
        return state["pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                cols = b.slice(start, 256)
                ids = cols.column(at)
                taken = pieces().take(ids.flatten())
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), taken)
                text = pc.binary_join(lists, b"" if decoder else " ")
                if decoder:
                    text = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
                text = pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*cols.columns, text], [*cols.schema.names, "decoded"])

    return encoded.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(tokenizer)
    return digests(decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
