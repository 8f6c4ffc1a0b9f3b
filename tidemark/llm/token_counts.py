"""Token counts of whole texts, of any length, as the tokenizer's own library gives them.

Texts of up to CHUNK_CHARS characters go to the library as they are. A longer one is encoded in chunks that overlap, with
the places of their tokens, and two neighbours are spliced where a seam is proven:

* BPE pieces of sentencepiece (no normalisation but the blank's mark, no pieces set by the user): a seam stands before a
  token that both chunks have, same piece at the same place. Merges go by score, then from the left, so whether something
  would merge across a boundary between two tokens depends on these two tokens alone: each side's merges up to there don't
  see beyond it, and other merges only come between them in time. The token before the seam and the one after it are
  neighbours in the left chunk's encoding, hence nothing merges across; and a sequence without a merge across any of its
  boundaries is the encoding of the whole.
* Tokenizers with pre-tokens: a seam stands before a pre-token that both chunks have, followed by the start of the same next
  one. Pre-tokens are found from left to right and don't look further than the next character, and tokens don't leave them.

If the overlap has no such place it is doubled, up to the start of the left chunk; if even that has none, the whole text is
encoded at once. So is a text of a model that doesn't meet the conditions (another algorithm, a normalisation). The count is exact always.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each have a row, null keys stay.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_pieces

#: Characters of a chunk and of an overlap to begin with; characters of texts that are with the library at a time.
CHUNK_CHARS, OVERLAP_CHARS, BLOCK_CHARS = 32_768, 512, 1_000_000
#: Tokens over which a text is over the limit.
LIMIT = 4096

#: Starts and ends (in characters of the chunk), what else must be equal at a seam (the piece, or the length up to the next pre-token), and whether a seam may stand before the token.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.local, self.dummy = self._conditions(path)
        if self.local:
            n = self.model.get_piece_size()
            byte = [int(self.model.id_to_piece(i)[3:5], 16) if self.model.is_byte(i) else None for i in range(n)]
            #: Characters of a piece; of a character that is written in bytes the first one has it.
            self.chars = np.array([len(self.model.id_to_piece(i)) if b is None else int(b & 0xC0 != 0x80) for i, b in enumerate(byte)], np.int64)
            self.plain = np.array([b is None and not self.model.is_unknown(i) and not self.model.is_control(i) for i, b in enumerate(byte)])

    @staticmethod
    def _conditions(path: str) -> tuple[bool, int]:
        """Whether the proof holds for this model, and the characters that it puts before a text."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not trainer.treat_whitespace_as_suffix
        own = any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces)
        return trainer.model_type == trainer.BPE and trainer.byte_fallback and plain and not own, int(norm.add_dummy_prefix)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def tokens(self, text: str) -> Tokens | None:
        """Tokens with their places, or None where places don't come out as they should."""
        ids = np.array(self.model.encode(text), np.int64)
        chars = self.chars[ids]
        ends = np.cumsum(chars) - self.dummy
        if not len(ids) or ends[-1] != len(text):
            return None
        starts = ends - chars
        return starts, ends, ids, self.plain[ids] & (chars > 0) & (starts > 0)


class PreTokens:
    """A tokenizer of the tokenizers library, with strings of special tokens in texts as it handles them by default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: A special string must not be longer than an overlap, or it could lie across two.
        self.local = self.model.pre_tokenizer is not None and max(map(len, added), default=0) < OVERLAP_CHARS // 4

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> Tokens | None:
        found = self.model.encode(text, add_special_tokens=False)
        n = len(found.ids)
        if not n:
            return None
        spans, words = np.array(found.offsets, np.int64), np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        starts, ends = spans[:, 0], spans[:, 1]
        opens = np.append(True, words[1:] != words[:-1]) & (words >= 0)
        places = np.flatnonzero(opens)
        follows = np.full(n, -1, np.int64)  # where the next pre-token starts
        follows[places[:-1]] = starts[places[1:]]
        return starts, ends, follows - starts, opens & (follows > starts) & (starts > 0)


_encoders: dict[str, Pieces | PreTokens] = {}


def encoder(vocabulary: str) -> Pieces | PreTokens:
    """The worker's encoder for a path, or for the name of a public tokenizer's file; read once in each Python worker."""
    if vocabulary not in _encoders:
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))
        if not path.endswith((".model", ".json")):
            raise ValueError(f"a sentencepiece .model or a tokenizers .json is needed: {vocabulary}")
        _encoders[vocabulary] = Pieces(path) if path.endswith(".model") else PreTokens(path)
    return _encoders[vocabulary]


def _seam(left: Tokens, left_at: int, right: Tokens, right_at: int, least: int) -> tuple[int, int, int] | None:
    """(place, index in left, index in right) of the first seam at or after `least`; the chunks start at left_at and right_at."""
    a, b = np.flatnonzero(left[3] & (left[0] + left_at >= least)), np.flatnonzero(right[3])
    shift = right_at - left_at
    _, i, j = np.intersect1d(left[0][a], right[0][b] + shift, return_indices=True)
    i, j = a[i], b[j]
    hits = np.flatnonzero((left[1][i] == right[1][j] + shift) & (left[2][i] == right[2][j]))
    return (int(left[0][i[hits[0]]]) + left_at, int(i[hits[0]]), int(j[hits[0]])) if len(hits) else None


def count_long(own: Pieces | PreTokens, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text by chunks; one chunk's tokens and its neighbour's are in memory at a time."""
    whole = lambda: own.counts([text])[0]
    if not own.local or len(text) <= chunk:
        return whole()
    start, end = 0, chunk
    tokens = own.tokens(text[:end])
    total, first, seam = 0, 0, 0  # tokens before the current chunk's first one that counts, and the place where that stands
    while tokens is not None and end < len(text):
        width, found = overlap, None
        while found is None:
            begin = max(start, end - width)
            following = own.tokens(text[begin : end + chunk])
            if following is None:
                return whole()
            found = _seam(tokens, start, following, begin, max(seam, 1))
            if found is None and begin == start:
                return whole()
            width *= 2
        seam, i, j = found
        total += i - first
        start, end, tokens, first = begin, end + chunk, following, j
    return whole() if tokens is None else total + len(tokens[0]) - first


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit of every whole text: one row per input row, no shuffle.

    vocabulary: a sentencepiece .model or a tokenizers .json, or such a file's name among the public tokenizers. No begin, end or added
    special tokens, no truncation or padding. Other columns of docs are not carried, so their names don't matter.
    """
    if key in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"the key must not be named like a result: {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for piece in arrow_pieces(batches, "_text", BLOCK_CHARS):
            texts = piece.column("_text").to_pylist()
            short = iter(own.counts([t for t in texts if len(t) <= chunk]))
            counts = [next(short) if len(t) <= chunk else count_long(own, t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column("_key"), piece.column("n_bytes"), pa.array(counts, pa.int64())], ["_key", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("_text"))
    counted = rows.mapInArrow(run, f"_key {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
