"""Packing by lexical retrieval: windows of tokens are filled with the seed document's BM25 neighbours.

Texts are encoded once; the terms of the index are their token ids, so its statistics (document frequencies and the mean
length of all documents) are bounded by the vocabulary. Documents are dealt into shards by content (`placed`): a shard is
named by a document's most telling term, that of the greatest tf-idf in the corpus that another document has too, so
documents that share it meet wherever they lie. A term of more than SHARD_DOCS documents is dealt by the next most
telling term as well, and a pair of more by a hash of the row. A shard's documents are indexed by all their terms: the
index gives, for a term, the documents that hold it with their BM25 weights. The largest rest of a document opens a
window; the shard's unused documents follow in order of their BM25 score for all of the seed's terms (then, where no
term is shared, in order of their rows). A document that doesn't fit is cut, and its rest opens the next window. So only
the last window of a shard is padded. Shards depend on the documents alone, not on their partitions: ties are broken by
a hash of the row and then by the key, and equal rows are packed alike in any order.

Neighbours are those of the shard: documents whose most telling terms differ are compared only if they fall into one.

Defined results: a null text counts as empty; an empty text is the end mark alone. Equal rows are packed each by itself,
with repeated ids or null ones too. Other columns of docs are not carried, so their names don't matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import pre_tokens, read_ranks, vocabulary_path
from tidemark.llm.common import arrow_pieces, removed, sized, written

#: A shard's documents and, about, its tokens. Both bound what a task holds.
SHARD_DOCS, SHARD_TOKENS = 2_048, 2_000_000
#: Bytes of text, and of ids, that a task works on at a time.
TEXT_BYTES, IDS_BYTES = 1_000_000, 4_000_000
#: A term of more than this share of a shard has its weights in a row for all of its documents, 0 where it is absent.
DENSE = 0.1
K1, B = 1.2, 0.75
#: A longer run of white space is too much for the tokenizer's pattern; in texts with one, the same matches are found by `pre_tokens`.
MOST_BLANKS = 100_000
RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

_blanks = re.compile(r"\s+")
_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """A function from a text to the bytes of its ids, once for a Python worker, the ids' type and their number."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = {t: i for i, t in enumerate(read_ranks(path if os.path.exists(path) else vocabulary_path(os.path.basename(path))))}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        one = encoding.encode_single_piece if hasattr(encoding, "encode_single_piece") else encoding._encode_single_piece
        kind = np.dtype("<u2") if len(ranks) <= 1 << 16 else np.dtype("<u4")

        def encode(text: str) -> bytes:
            if len(text) > MOST_BLANKS and max(map(len, _blanks.findall(text)), default=0) > MOST_BLANKS:
                ids = [i for t in pre_tokens([text])[0] for i in one(t.encode("utf-8", "surrogatepass"))]
            else:
                ids = encoding.encode_ordinary(text)
            return np.array(ids, kind).tobytes()

        _encoders[path] = encode, kind, len(ranks)
    return _encoders[path]


def encoded(docs: DataFrame, vocabulary: str, text: str, key: str) -> DataFrame:
    """key, _row (a hash of the row) and _ids (the ids of the whole text, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)[0]
        for piece in arrow_pieces(batches, "_text", TEXT_BYTES):
            ids = [encode(t) for t in piece.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column("_row"), pa.array(ids, pa.binary())], [key, "_row", "_ids"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.xxhash64(F.col(key).cast("string"), whole).alias("_row"), whole.alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, _row long, _ids binary")


@dataclass
class Statistics:
    """Of all documents: their number, their mean tokens, and for each term the documents that have it."""

    n_docs: int
    mean: float
    frequency: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n_docs - self.frequency + 0.5) / (self.frequency + 0.5))


def term_counts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of a document and a term of it, by document and term: the two numbers and how often it occurs."""
    owner = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in ids])
    pairs, tf = np.unique(owner << 32 | np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int64), return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, tf


def statistics(tokens: DataFrame, vocabulary: str) -> Statistics:
    """Counts documents and terms in each batch, then over batches; the driver gets a row for each token of the vocabulary at most."""
    _, kind, size = _encoder(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrow_pieces(batches, "_ids", IDS_BYTES):
            ids = [np.frombuffer(x, kind) for x in piece.column("_ids").to_pylist()]
            n = np.bincount(term_counts(ids)[1], minlength=size)
            terms = np.flatnonzero(n)
            rows = [np.append(terms, [-1, -2]), np.append(n[terms], [len(ids), sum(map(len, ids))])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["term", "n"])

    found = {r.term: r.n for r in tokens.select("_ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, total = found.pop(-1, 0), found.pop(-2, 0)
    frequency = np.zeros(size, np.int64)
    frequency[list(found)] = list(found.values())
    return Statistics(n_docs, total / max(1, n_docs), frequency)


class Shard:
    """A BM25 inverted index over one shard's documents."""

    def __init__(self, ids: list[np.ndarray], stats: Statistics, idf: np.ndarray) -> None:
        n, lengths = len(ids), np.array([len(x) for x in ids], np.int64)
        doc, term, tf = term_counts(ids)
        weights = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1.0, stats.mean)))).astype(np.float32)
        df = np.bincount(term, minlength=len(idf))
        self.n, self.terms, self.firsts = n, term, np.searchsorted(doc, np.arange(n + 1))
        #: Rows of weights of frequent terms by number, and postings of the others. A term of no other document finds nothing.
        self.row = np.full(len(idf), -1, np.int64)
        frequent = np.flatnonzero(df > max(1, DENSE * n))
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], doc[dense]] = weights[dense]
        sparse = ~dense & (df[term] > 1)
        order = np.argsort(term[sparse], kind="stable")
        self.docs, self.weights = doc[sparse][order], weights[sparse][order]
        self.places = np.searchsorted(term[sparse][order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard for all terms of the seed."""
        terms = self.terms[self.firsts[seed] : self.firsts[seed + 1]]
        row = self.row[terms]
        found = self.rows[row[row >= 0]].sum(0)
        terms = terms[row < 0]
        starts, sizes = self.places[terms], self.places[terms + 1] - self.places[terms]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return found + np.bincount(self.docs[at], self.weights[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's terms, best first; ties by row."""
        if not unused.any():
            return np.zeros(0, np.int64)
        scores = self.scores(seed)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def pack(lengths: list[int], index: Shard, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces: whole windows of a long document first, then filled ones."""
    out, sequence = [], 0
    rest = np.array(lengths)
    for d, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
    begun = rest // window * window
    rest = rest - begun
    unused = rest > 0
    order = np.argsort(-rest, kind="stable").tolist()
    place, seed = 0, None
    while True:
        if seed is None:
            while place < len(order) and not unused[order[place]]:
                place += 1
            if place == len(order):
                return out
            seed = order[place]
        unused[seed] = False
        n = int(rest[seed])
        out.append((seed, int(begun[seed]), n, sequence, 0))
        space, offset, cut = window - n, n, None
        following = iter(index.neighbours(seed, unused).tolist()) if space else iter(())
        spare = iter(order[place:])
        while space:
            d = next(following, None)
            if d is None:
                d = next(spare, None)
                if d is None:
                    break
            if not unused[d]:
                continue
            n = min(space, int(rest[d]))
            out.append((d, int(begun[d]), n, sequence, offset))
            unused[d] = False
            space, offset = space - n, offset + n
            if n < rest[d]:
                begun[d] += n
                rest[d] -= n
                cut = d
        sequence += 1
        seed = cut


def placed(tokens: DataFrame, stats: Statistics, vocabulary: str) -> DataFrame:
    """Adds _shard, and _k1 and _k2: the two most telling terms (-1 where there is none).

    Near three quarters of SHARD_DOCS documents fall to a shard; a larger one is cut in the order of its terms.
    """
    kind = _encoder(vocabulary)[1]
    frequency, idf = stats.frequency, stats.idf

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrow_pieces(batches, "_ids", IDS_BYTES):
            owner, term, tf = term_counts([np.frombuffer(x, kind) for x in piece.column("_ids").to_pylist()])
            keep = frequency[term] > 1
            owner, term, tf = owner[keep], term[keep], tf[keep]
            order = np.lexsort((term, -tf * idf[term], owner))
            owner, term = owner[order], term[order]
            firsts = np.searchsorted(owner, np.arange(len(piece) + 1))
            best = [np.full(len(piece), -1, np.int64) for _ in range(2)]
            for j, b in enumerate(best):
                has = np.diff(firsts) > j
                b[has] = term[firsts[:-1][has] + j]
            yield pa.RecordBatch.from_arrays([*piece.columns, *map(pa.array, best)], [*piece.schema.names, "_k1", "_k2"])

    schema = tokens.withColumns({"_k1": F.lit(0).cast("long"), "_k2": F.lit(0).cast("long")}).schema
    told = written(tokens.mapInArrow(tell, schema), "told")
    pairs = told.groupBy("_k1", "_k2").agg(F.count("*").alias("_n2"))
    counted = written(pairs, "telling-terms")
    hot = written(counted.groupBy("_k1").agg(F.sum("_n2").alias("_n1")).filter(F.col("_n1") > SHARD_DOCS), "hot-terms")
    both = written(counted.filter(F.col("_n2") > SHARD_DOCS), "hot-pairs")
    shards = max(1, -(-4 * stats.n_docs // (3 * SHARD_DOCS)))
    salt = F.when(F.col("_n2").isNotNull(), F.pmod(F.col("_row"), F.ceil(F.col("_n2") / SHARD_DOCS))).otherwise(0)
    name = F.when(F.col("_n1").isNull(), F.xxhash64("_k1")).otherwise(F.xxhash64("_k1", "_k2", salt))
    return (
        told.join(sized(hot, hot.count()), "_k1", "left").join(sized(both, both.count()), ["_k1", "_k2"], "left")
        .withColumn("_shard", F.pmod(name, F.lit(shards)).cast("long")).drop("_n1", "_n2")
    )


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", window: int = 1024, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packs all documents into sequences of at most `window` tokens.

    A document is the ids of its whole text, then `end`. Returns per piece: key, start, length, ids_crc32 (of its
    unsigned little-endian 32-bit ids), doc_tokens, sequence_id, offset. A sequence's id holds the shard's number
    above 2**32 and a running number below.
    """
    if key in RESULTS:
        raise ValueError(f"the key must not be named like a result: {key}")
    tokens = written(encoded(docs, vocabulary, text, key), "ids")
    stats = statistics(tokens, vocabulary)
    idf, dtype = stats.idf, _encoder(vocabulary)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = sequence = None

        def pieces(own: int, keys: list, raw: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
            nonlocal shard, sequence
            if own != shard:
                shard, sequence = own, own << 32
            ids = [np.frombuffer(x, dtype) for x in raw]
            rows = pack([len(x) + 1 for x in ids], Shard(ids, stats, idf), window)
            whole = [np.append(x, end).astype("<u4") for x in ids]
            d, start, length, q, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            crc = [zlib.crc32(whole[i][s : s + n]) for i, s, n, *_ in rows]
            sizes = np.array([len(x) for x in whole], np.int64)
            columns = [pa.array([keys[i] for i in d.tolist()], kind), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (sizes[d], sequence + q, offset))]
            sequence += int(q.max()) + 1
            return pa.RecordBatch.from_arrays(columns, [key, *RESULTS])

        keys, raw, current, n, kind = [], [], None, 0, None
        for batch in batches:
            kind = batch.schema.field(key).type
            for own, k, x in zip(batch.column("_shard").to_pylist(), batch.column(key).to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                if keys and (own != current or len(keys) == SHARD_DOCS or n + len(x) // dtype.itemsize > SHARD_TOKENS):
                    yield pieces(current, keys, raw, kind)
                    keys, raw, n = [], [], 0
                keys.append(k)
                raw.append(x)
                current, n = own, n + len(x) // dtype.itemsize
        if keys:
            yield pieces(current, keys, raw, kind)

    dealt = placed(tokens, stats, vocabulary).repartition("_shard").sortWithinPartitions("_shard", "_k1", "_k2", "_row", key).select(key, "_shard", "_ids")
    removed(tokens)
    return dealt.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
