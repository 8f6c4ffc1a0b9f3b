"""What the text operators share: reading, cutting lineage, and hashes of words and shingles with numpy."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a broadcast of ids may hold (16 bytes each or so in memory). Beyond that the same join is shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of a few numbers that one partition holds: tables of no more are grouped and joined where they are, without a shuffle.
PARTITION_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a folder of this machine in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later reads neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` has made, once what was derived from them is written too."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def swept(df: DataFrame) -> None:
    """Has the driver collect its garbage: Spark keeps the shuffle files of a finished query until then, however large they are."""
    df.sparkSession.sparkContext._jvm.System.gc()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_IDS; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of which rows were counted, as one partition if it fits one: Spark's groups and joins over it then need no exchange."""
    return df.coalesce(1) if rows <= PARTITION_ROWS else df


# --- numpy helpers, used inside tasks ---------------------------------------------------------------------------------

_U = np.uint64
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_blank = re.compile(rb"[\x20\x09-\x0D]")
PIECE_BYTES = 1 << 21
#: Odd multipliers of a shingle's words, by place; a shingle has at most as many words.
_PLACES = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words, so that the words of one piece are in memory at a time."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        end = _blank.search(raw, start + PIECE_BYTES)
        if not end:
            break
        yield raw[start : end.start()]
        start = end.end()
    yield raw[start:] if start else raw


def word_hashes(text: str) -> np.ndarray:
    """XXH3 digests (64 bits) of the words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z, in order."""
    raw = text.encode("utf-8", "surrogatepass").translate(_lower)
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words)) for words in (piece.split() for piece in _pieces(raw))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of width-word shingles; a text with fewer words gives its whole sequence as one, none gives none."""
    words = word_hashes(text) if text else np.zeros(0, _U)
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    with np.errstate(over="ignore"):
        sums = np.full(n - k + 1, k, _U)
        for i in range(k):
            sums += words[i : n - k + 1 + i] * _PLACES[i]
    sums = np.sort(mix(sums, 11))
    return sums[np.concatenate(([True], sums[1:] != sums[:-1]))]


def batches_by_size(frames: Iterator, column: str, most: int) -> Iterator:
    """Cuts pandas frames into pieces whose texts have about `most` characters together (or one longer text alone)."""
    for frame in frames:
        lengths = frame[column].str.len().fillna(0).to_numpy().astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]


def arrow_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces whose texts have about `most` bytes together (or one longer text alone)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def with_made(docs: DataFrame, text: str, most: int, start: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], made: str) -> DataFrame:
    """docs with the columns of the schema `made`, which `start()`'s function makes of a batch; those of equal names are replaced in their places.

    All other columns pass through as Arrow has them: longs beyond 2**53 beside nulls stay as they are. A batch's texts have about `most` bytes together.
    """
    new = StructType.fromDDL(made)
    kinds = {f.name: f for f in new.fields}
    fields = [kinds.get(f.name, f) for f in docs.schema.fields] + [f for f in new.fields if f.name not in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for piece in arrow_pieces(batches, text, most):
            found = make(piece)
            yield pa.RecordBatch.from_arrays([found[f.name] if f.name in found else piece.column(f.name) for f in fields], [f.name for f in fields])

    return docs.mapInArrow(run, StructType(fields))
