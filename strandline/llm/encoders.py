"""Exact tokenizer results through the distinct, independent chunks of many texts.

Both vocabularies used here split text before any merge, and no piece of that split contains white space in its
middle.  Texts can hence be cut at white space into chunks; each distinct chunk of some texts is encoded once, all of
them in one call, and the ids are put at the chunks' positions.  Nothing is remembered from one call to the next.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# a blank next to other white space (Python's \s holds every character that the library takes for white space)
_BLANK_RUN = re.compile(r" \s|\s ")
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
# the same characters in the syntax of Arrow's library
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BESIDE_BLANK = f" {_SPACES}|{_SPACES} "
_BLANKS = np.array([32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256)], np.uint8)


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts whose bytes are replaced by the table's, over Arrow's buffers; nulls become empty."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return texts
    _, places, data = texts.buffers()
    edges = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(edges - edges[0]), pa.py_buffer(table[raw])])


def byte_chunks(text: str) -> list[str]:
    """For byte-level vocabularies: cut before each blank that stands alone between other characters.

    There the library always ends a piece and begins one, with that blank.  All chunks but the first lack their blank.
    """
    if _BLANK_RUN.search(text) is None and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return _LONE_BLANK.split(text)


# Characters on which every Unicode version agrees: ASCII and the precomposed Latin letters up to U+017F, without the
# two signs among them and the one capital whose lower case is two characters.  NFC keeps them as they are.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LATIN}]*")
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\t-\\r a-z{_LATIN}0-9]+")
#: A run so long that rank merging, whose time grows with its square, is left to the other library.
_LONG_RUN = re.compile(r"(?<!\S)\S{1000}|(?<!\s)\s{1000}")
_ENDED = "\\g<0>\ue000"
#: A chunk that can't be merged together with others: empty, long, with other characters or white space at an end.
_NOT_PLAIN = r"^$|<\||[^\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]|^" + _SPACES + "|" + _SPACES + r"$|^(?s:.{500})"
#: Stands for the word end, a private character that no plain text holds.  Its bytes are merged before all others, so
#: that ids are shifted by the two merges that make it.
_END, _SHIFT = "\ue000", 2


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others are moved past U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(moved)}


def piece_ranks(path: str, style: str) -> dict[bytes, int]:
    """The vocabulary of a tokenizers file as byte strings; its ids are in the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, of = {t["content"] for t in spec["added_tokens"]}, _byte_of_char()
    end = _END.encode()
    shift = _SHIFT if style == "word" else 0
    ranks = {}
    for piece, i in spec["model"]["vocab"].items():
        if piece in special:
            continue
        ended = style == "word" and piece.endswith("</w>")
        raw = bytes(of[c] for c in (piece[:-4] if ended else piece))
        ranks[raw + end * ended] = i + shift
    return ranks | {end[:2]: 0, end: 1} if shift else ranks  # a piece of these bytes is in no plain text


class ChunkEncoder:
    """encode(texts) and counts(texts) as the tokenizers library gives them, without special tokens of its own.

    Texts come as an Arrow array: they are cut into chunks there, and each distinct chunk is encoded once.  A chunk is encoded by the rank-merging library if it holds plain characters only, else by the tokenizers library:
    special strings, normal forms and unusual scripts are always left to the latter.  Null and empty texts have no ids.
    """

    def __init__(self, path: str, style: str):
        import tiktoken
        from tokenizers import Tokenizer

        if style not in ("word", "byte"):
            raise ValueError(f"style must be 'word' or 'byte', not {style!r}")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""" if style == "byte" else f"[^{_END} ]+{_END}"
        ranks = piece_ranks(path, style)
        self.merger = tiktoken.Encoding(style, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(1 + max(ranks.values()), np.int64)
        self.n_bytes[list(ranks.values())] = list(map(len, ranks))
        self.style = style

    @staticmethod
    def _plain(text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None and _LONG_RUN.search(text) is None

    def encode_chunk(self, chunk: str) -> list[int]:
        if not self._plain(chunk):
            return self.library.encode(chunk, add_special_tokens=False).ids
        if self.style == "byte":
            return self.merger.encode_ordinary(chunk)
        return [i - _SHIFT for i in self.merger.encode_ordinary(_WORD_PIECES.sub(_ENDED, chunk.lower()))]

    def encode_chunks(self, chunks: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and each one's number of them; lead, a blank, stands before each.

        Plain chunks are merged in one call: where one ends is known by the bytes that the ids stand for.
        """
        odd = pc.match_substring_regex(chunks, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        if self.style == "byte" and not lead:  # a chunk that begins a text stands alone
            odd = np.ones(len(chunks), bool)
        plain = chunks.filter(pa.array(~odd)) if odd.any() else chunks
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
        if self.style == "byte":
            ends = pc.binary_length(plain).to_numpy() + 1
            ids = np.array(self.merger.encode_ordinary(lead + joined if len(plain) else ""), np.uint32)
        else:
            marked = _WORD_PIECES.sub(_ENDED, joined.lower())
            ends = pc.binary_length(pc.split_pattern(pa.array([marked] if len(plain) else [], pa.string()), " ").flatten()).to_numpy()
            ids = np.array(self.merger.encode_ordinary(marked), np.uint32)
        begins = np.cumsum(self.n_bytes[ids]) - self.n_bytes[ids]
        sizes = np.zeros(len(chunks), np.int64)
        sizes[~odd] = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(ends)])))
        ids = ids - np.uint32(_SHIFT if self.style == "word" else 0)
        if not odd.any():
            return ids, sizes
        alone = [self.encode_chunk(lead + n) for n in chunks.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = list(map(len, alone))
        flat, mine = np.zeros(int(sizes.sum()), np.uint32), np.repeat(odd, sizes)
        flat[~mine], flat[mine] = ids, [i for x in alone for i in x]
        return flat, sizes

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.style == "word":
            return pc.split_pattern(translated(texts, _BLANKS), " ")
        odd = pc.or_(pc.match_substring_regex(texts, _BESIDE_BLANK), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        lists = pc.split_pattern(texts, " ")
        if not pc.any(odd).as_py():
            return lists
        rest = pa.array([byte_chunks(t) for t in texts.filter(odd).to_pylist()], lists.type)
        held = odd.to_numpy(zero_copy_only=False)
        place = np.where(held, len(lists) + np.cumsum(held) - 1, np.arange(len(lists)))
        return pa.concat_arrays([lists, rest]).take(pa.array(place))

    def _found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids and numbers of them of the distinct chunks, the chunk at each place, and the places where each text begins."""
        lists = self._chunks(pc.fill_null(texts, ""))
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        coded = lists.flatten().dictionary_encode()
        ids, sizes = self.encode_chunks(coded.dictionary, " " if self.style == "byte" else "")
        places = coded.indices.to_numpy()
        if self.style == "byte":  # the first chunk of a text has no blank in front
            first = coded.dictionary.take(pa.array(places[edges[:-1]])).dictionary_encode()
            more, more_sizes = self.encode_chunks(first.dictionary)
            places = places.copy()
            places[edges[:-1]] = len(sizes) + first.indices.to_numpy()
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
        return ids, sizes, places, edges

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, np.int64)
        _, sizes, places, edges = self._found(texts)
        return np.add.reduceat(sizes[places], edges[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the places where each one's begin, with the end of the last."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        ids, sizes, places, edges = self._found(texts)
        starts = (np.cumsum(sizes) - sizes)[places]
        sizes = sizes[places]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], np.concatenate([[0], ends])[edges]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, style: str) -> ChunkEncoder:
    """One encoder a worker process: reading the vocabulary takes a while."""
    if (path, style) not in _ENCODERS:
        _ENCODERS[path, style] = ChunkEncoder(path, style)
    return _ENCODERS[path, style]
