"""Byte-level BPE by a sentencepiece model that is written from a vocabulary of ranks, not trained.

Every token's bytes are mapped to printable characters, one per byte; a piece is scored by minus its rank, and
normalisation is the identity. Sentencepiece's BPE then merges the pair of highest score first, which is the pair of
lowest rank. Pre-tokens are cut by the published pattern, and each is encoded by itself. A worker remembers pre-tokens by
their own text, so equal ones are encoded once and different ones never share an answer. Decoding maps ids to pieces and characters back to bytes.

Defined results: a null text counts as empty; an empty text has no ids, and its digests are those of no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_pieces

#: Bytes of text in a block whose pre-tokens are in memory together.
BLOCK_BYTES = 1_000_000
#: Pre-tokens that a worker remembers between blocks, and their characters; then it starts anew.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 4_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- pre-tokens ------------------------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 0, 9
_END_CODE = 0x110000
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The class of every code point: letters (L*), numbers (N*), white space, others, and a mark between texts."""
    global _classes
    if _classes is None:
        spaces = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
        kinds = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((_SPACE if c in spaces else kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_END_CODE)), np.uint8, _END_CODE)
        _classes = np.append(t, np.uint8(_END))
    return _classes


def pre_token_spans(codes: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches over texts that are joined by (and end with) the code 0x110000.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    Runs of one class are tokens, with two exceptions: of white space before something else the last character stands
    alone, or opens the next token if it is a blank; and a quote that opens a token takes a contraction's letters.
    """
    kind = _class_table()[codes]
    n = len(codes)
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[1:] != _END) & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    quotes = np.flatnonzero((codes == 0x27) & start[:n])
    quotes = quotes[quotes + 2 < n]
    one, two = codes[quotes + 1], codes[quotes + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = True
    start[quotes[long] + 3] = True
    return np.flatnonzero(start)


def pre_tokens(texts: list[str]) -> list[list[str]]:
    """Each text's pre-tokens."""
    codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    codes[ends] = _END_CODE
    edges = pre_token_spans(codes)
    places, found, start = np.searchsorted(edges, ends), [], 0
    first = 0
    for t, last, end in zip(texts, places.tolist(), ends.tolist(), strict=True):
        found.append([t[a:b] for a, b in pairwise((edges[first : last + 1] - start).tolist())])
        first, start = last + 1, end + 1
    return found


class Blocks:
    """Turns blocks of texts into pre-tokens; remembers what `encode` makes of each distinct one."""

    def __init__(self, encode: Callable[[list[str]], list]) -> None:
        self.encode, self.known, self.chars = encode, {}, 0

    def __call__(self, texts: list[str]) -> tuple[dict, list[list[str]]]:
        """The results by pre-token, and each text's pre-tokens."""
        tokens = pre_tokens(texts)
        if len(self.known) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        if missing := list(set(chain.from_iterable(tokens)).difference(self.known)):
            self.known.update(zip(missing, self.encode(missing), strict=True))
            self.chars += sum(map(len, missing))
        return self.known, tokens


# --- the sentencepiece model ------------------------------------------------------------------------------------------


def byte_characters() -> list[str]:
    """A printable character for each byte: those of Latin-1 that print stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0 to n-1")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: bytes, text, a 32-bit float or a whole number."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece of id 0 is the unknown one and whose piece of id r+1 is the token of rank r."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, "".join(map(chars.__getitem__, t))) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes pre-tokens and decodes ids with one vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.to_byte = {c: b for b, c in enumerate(chars)}

    def encode(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids (ranks) of each pre-token by itself."""
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars) for t in pre_tokens]
        return [[i - 1 for i in ids] for ids in self.model.encode(mapped, num_threads=1)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, by pieces and the inverse map."""
        return bytes(self.to_byte[c] for i in ids for c in self.model.id_to_piece(i + 1))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary; it is read once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns key, n_tokens, ids_sha256 (of the decimal ids joined by a blank), decoded_sha256 (of the decoded bytes), and
    with keep_ids the ids themselves as array<int>; other columns of docs are not carried, so their names don't matter. One row per
    input row, with no shuffle; a task holds one Arrow batch and the pre-tokens of one block of about BLOCK_BYTES (or of one longer text).
    """
    name = os.path.basename(path)
    if key in ("n_tokens", "ids_sha256", "decoded_sha256", "ids"):
        raise ValueError(f"the key must not be named like a result: {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path if os.path.exists(path) else vocabulary_path(name))

        def both(tokens: list[str]) -> list[tuple[str, bytes, int]]:
            return [(" ".join(map(str, ids)), own.decode(ids), len(ids)) for ids in own.encode(tokens)]

        blocks = Blocks(both)
        for piece in arrow_pieces(batches, text, BLOCK_BYTES):
            known, tokens = blocks([t or "" for t in piece.column(text).to_pylist()])
            counts, digests, decoded, all_ids = [], [], [], []
            for mine in tokens:
                found = list(map(known.__getitem__, mine))
                ids = " ".join([x[0] for x in found])
                counts.append(sum([x[2] for x in found]))
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x[1] for x in found])).hexdigest())
                if keep_ids:
                    all_ids.append(list(map(int, ids.split())))
            columns = [piece.column(key), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())] + [pa.array(all_ids, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
