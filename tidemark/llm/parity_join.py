"""Near duplicates by n-gram Jaccard similarity, exactly, by a parity-sketch join.

A text's set is its distinct shingles of words. Shingles are dealt into the parts of a sketch by their hash's range, and
a part is the XOR of the 64-bit hashes of its shingles: its parities, 64 bits of them. A shingle changes the bits of one
part only, so two sketches differ in no more parts than the two sets differ in shingles (their Hamming distance over parts bounds
the symmetric difference from below). Sets of similar size that are linked differ in at most d shingles, so of more than
d parts at least one is alike in both (pigeonhole). That gives candidates by an equality join of parts, for each band of
sizes; a candidate pair is first held against the Hamming distance of a short sketch of single bits (which bounds
it likewise), of large sets also of a long sketch, and then verified on the whole sets. An empty part joins nothing as long as enough parts remain; a text
with too many empty parts is cut anew by another hash (RECUTS times).

A node is a distinct set, named by 64 bits of the BLAKE2b digest of its hashes, so equal sets are one node wherever they
lie, and only one row of each is cut into parts. Within a bucket of equal parts, nodes are paired with its leader only, the one that shares most parts with any others,
and a node first with that leader alone with which it shares most parts. Large buckets that stay in more than one component get a few further leaders. What then is open forms families (nodes that
share open buckets). A family is cut into blocks; the short sketches of each pair of blocks are compared in one task, and only
pairs of different components within the Hamming bound come out. So a bucket of copies is never expanded into its pairs,
yet no component is missed. A leader with many pairs is copied for a salt, a hub of the graph of links is
broadcast, and the driver sees counts.

Defined results: a null or empty text (or one without words) has no shingles and is linked with nothing, so is its own
component; a text with fewer words than a shingle has its whole sequence as its only shingle. Repeated rows with equal
text are linked. One row comes out for each row, whether ids repeat or not: links are between texts, and a component is
named by the least id of its rows. A row with a null id is linked with nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import BROADCAST_IDS, arrow_pieces, gathered, mix, removed, shingle_hashes, sized, swept, written

SKETCH_WORDS = 16
RECUTS = 6
#: Rounds of further leaders, and members of a bucket from which a round is worth while.
LEADER_ROUNDS, LEADER_BUCKET = 2, 64
#: Nodes of a block, about: a task compares two blocks.
BLOCK = 400
#: Pairs of a leader from which it is copied for a salt, and edges of a node from which it counts as a hub.
SALT_PAIRS, HUB = 2_000, 1_000
#: Bytes of text that are turned into sets at a time.
PIECE = 4_000_000
#: Part keys of a bundle and, about, of a range; bits of a key within its range. By chance a key is alike another one of its range once in 2**21.
BUNDLE_KEYS, RANGE_KEYS, KEY_BITS = 500_000, 500_000, 40
_U = np.uint64


class Bands:
    """Bands of set sizes for a similarity of percent/100: linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int) -> None:
        self.percent, self.starts = percent, [1, 2]
        self._edges: dict[int, np.ndarray] = {}
        self._names: dict[tuple[int, int], np.ndarray] = {}

    def _until(self, n: int) -> None:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * 100 // self.percent + 1))

    def of(self, n: int) -> int:
        self._until(n)
        return bisect_right(self.starts, n) - 1

    def difference(self, band: int) -> int:
        """The most shingles in which linked sets differ, of which the smaller one is in the band."""
        while len(self.starts) < band + 2:
            self._until(self.starts[-1])
        return (100 - self.percent) * (self.starts[band + 1] - 1) // self.percent

    def parts(self, band: int) -> int:
        """More parts than differences, by a margin for parts that are empty."""
        d = self.difference(band)
        return d + 2 + d // 24

    def most_keys(self, sets: int, shingles: int) -> int:
        """About the most part keys of so many sets that have so many shingles together: a band's upper end is 100 / percent of a size."""
        return 4 * sets + shingles * (100 - self.percent) * (100 + self.percent) * 25 // (24 * self.percent**2)

    def edges(self, band: int) -> np.ndarray:
        """Where the hash ranges of parts begin, but for the first."""
        if band not in self._edges:
            parts = self.parts(band)
            self._edges[band] = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(_U)
        return self._edges[band]

    def names(self, band: int, cut: int) -> np.ndarray:
        """A number for each part, by which parts of different places, bands and cuts differ."""
        if (band, cut) not in self._names:
            self._names[band, cut] = mix(np.arange(self.parts(band), dtype=_U) + _U((band * RECUTS + cut) * 1_000_003), 44)
        return self._names[band, cut]


def set_row(shingles: np.ndarray) -> tuple[int, int, np.ndarray, bytes | None]:
    """Size, name, short sketch and long sketch of a set: sorted distinct hashes.

    The long one has as many bits as the set has shingles or more, as the bits of the short one can't show the differences of a
    large set. Both are made of the hashes' low bits, so a sketch folded in two is that of half the bits.
    """
    mixed, n = mix(shingles, 21), len(shingles)

    def sketch(bits: int) -> np.ndarray:
        odd = np.bincount((mixed & _U(bits - 1)).view(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little")

    return n, node_name(shingles), sketch(64 * SKETCH_WORDS).view(np.int64), sketch(1 << (n - 1).bit_length()).tobytes() if n > 64 * SKETCH_WORDS else None


def bits_apart(x: bytes, y: bytes) -> int:
    """The bits in which two sketches differ, of which the longer one is folded: no more than the shingles in which the sets differ."""
    x, y = sorted((np.frombuffer(x, _U), np.frombuffer(y, _U)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype=np.int64))


def may_link(x: bytes | None, y: bytes | None, total: int, percent: int) -> bool:
    """Whether the long sketches of two sets, of `total` shingles together, allow a link; where one is missing, the short ones have told."""
    return x is None or y is None or (100 + percent) * bits_apart(x, y) <= (100 - percent) * total


def node_name(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def part_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set's parts, for the band of its size and the one below. Sets with no room for a difference have none: they are nodes."""
    n, found = len(shingles), []
    band = bands.of(n) if n else 0
    for group in (band, band - 1):
        if group < 0 or not n or (d := bands.difference(group)) < 1:
            continue
        edges = bands.edges(group)
        parts = len(edges) + 1
        for cut in range(RECUTS):
            own = shingles if cut == 0 else np.sort(mix(shingles, 100 + cut))
            at = np.concatenate(([0], np.searchsorted(own, edges), [n]))
            full = np.flatnonzero(at[1:] > at[:-1])
            # Parts that are not empty follow one another, so each reaches to the next one's beginning.
            parity = np.bitwise_xor.reduceat(own, at[full])
            names = bands.names(group, cut)
            with np.errstate(over="ignore"):
                found.append(mix(parity + names[full], 55))
                if cut == RECUTS - 1:
                    found.append(mix(np.delete(names, full), 55))
            if len(full) > d:  # some part that is alike is not empty
                break
    return np.concatenate(found) if found else np.zeros(0, _U)


def _mapped(rows: DataFrame, run: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str) -> DataFrame:
    """`run` over pieces of rows and their column `text`."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrow_pieces(batches, "text", PIECE):
            yield run(piece, piece.column("text").to_pylist())

    return rows.mapInArrow(pieces, schema)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"))


def _sets(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """id, n, node (null without shingles or id), sketch, long (null but for large sets)."""

    def run(piece: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        rows = [set_row(shingle_hashes(t, width)) for t in texts]
        sketches = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * SKETCH_WORDS, np.concatenate([r[2] for r in rows]))
        columns = [piece.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] if r[0] else None for r in rows], pa.int64()), sketches, pa.array([r[3] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "sketch", "long"])

    found = _mapped(_texts(docs, text, key), run, f"id {dict(docs.dtypes)[key]}, n long, node long, sketch array<long>, long binary")
    return found.withColumn("node", F.when(F.col("id").isNotNull(), F.col("node")))


def bundle_rows(parts: list[np.ndarray], names: list[int], ranges: int) -> pa.RecordBatch:
    """The part keys of a bundle of texts, whose nodes are named: a row with the names, and one for each range with its keys.

    A key is KEY_BITS bits of the hash besides its range, and the place of its text in the bundle: seven bytes, of which the
    highest are in order and so compress. A bundle is called by its names' digest: made anew in another order it has another one.
    """
    called = np.array(names, np.int64)
    keys, texts = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype="<u2"), [len(x) for x in parts])
    keys = ((keys >> _U(32)) * _U(ranges) >> _U(32)) << _U(KEY_BITS) | keys & _U((1 << KEY_BITS) - 1)
    order = np.argsort(keys)
    keys, texts = keys[order], texts[order]
    cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=_U) << _U(KEY_BITS))
    own = np.flatnonzero(cuts[1:] > cuts[:-1])
    low, high = keys.astype("<u4"), (keys >> _U(32)).astype(np.uint8)
    raw = [b"".join(x[cuts[r] : cuts[r + 1]].tobytes() for x in (low, texts, high)) for r in own]
    bundle = node_name(called)
    columns = [[bundle % ranges, *own.tolist()], [bundle] * (len(own) + 1), [called.tobytes(), *[None] * len(own)], [None, *raw]]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "bundle", "names", "keys"])


def shared_keys(range_: int, bundles: list[int], raw: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bundle, places of texts, parts, sizes of their buckets): of a range's keys, those that more texts than one have."""
    n = [len(x) // 7 for x in raw]
    low, texts, high = (np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(raw, n, strict=True)]) for kind, at in (("<u4", 0), ("<u2", 4), ("u1", 6)))
    keys = high.astype(_U) << _U(32) | low
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    several = np.append(same, False) | np.append(False, same)[: len(keys)]
    run = np.cumsum(np.append(True, ~same)[: len(keys)]) - 1
    sizes = np.bincount(run)[run][several]
    owner, parts, texts = np.repeat(np.arange(len(raw)), n)[order][several], keys[several] | _U(range_ << KEY_BITS), texts[order][several]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(raw) + 1))
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
        at = order[cuts[i] : cuts[i + 1]]
        yield bundles[i], texts[at], parts[at].view(np.int64), sizes[at].astype(np.int32)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows by a column that they are sorted by, their binary columns as buffers."""
    last, rows = None, []
    for batch in batches:
        for own, *values in zip(*(batch.column(c) for c in (by, *batch.schema.names)), strict=True):
            if rows and own.as_py() != last:
                yield last, rows
                rows = []
            last = own.as_py()
            rows.append({c: (x.as_buffer() if hasattr(x, "as_buffer") else x.as_py()) if x.is_valid else None for c, x in zip(batch.schema.names, values, strict=True)})
    if rows:
        yield last, rows


def _members(docs: DataFrame, width: int, percent: int, ranges: int, text: str, key: str) -> DataFrame:
    """part, node, rank: the members of buckets that two texts or more share. A node's rank is the sum of its buckets' sizes.

    Texts are cut into parts once. Their keys meet by ranges, in bundles of many texts; only what is shared goes back to its
    bundle, where it is ranked and gets the nodes' names.
    """
    bands = Bands(percent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, n = [], [], 0
        for piece in arrow_pieces(batches, "text", PIECE):
            for t in piece.column("text").to_pylist():
                shingles = shingle_hashes(t, width)
                if len(found := part_keys(shingles, bands)):
                    parts.append(found)
                    names.append(node_name(shingles))
                    n += len(found)
                if n >= BUNDLE_KEYS or len(parts) == 1 << 16:
                    yield bundle_rows(parts, names, ranges)
                    parts, names, n = [], [], 0
        if parts:
            yield bundle_rows(parts, names, ranges)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bundle": pa.int64(), "names": pa.binary(), "texts": pa.binary(), "parts": pa.binary(), "sizes": pa.binary()}
        for range_, rows in _groups(batches, "range"):
            found = [(r["bundle"], r["names"].to_pybytes(), None, None, None) for r in rows if r["keys"] is None]
            if rows := [r for r in rows if r["keys"] is not None]:
                found += [(b, None, *(x.tobytes() for x in own)) for b, *own in shared_keys(range_, [r["bundle"] for r in rows], [r["keys"] for r in rows])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, rows in _groups(batches, "bundle"):
            names = next((r["names"] for r in rows if r["names"] is not None), None)
            if names is None:  # its texts came in another order when a lost task ran again
                raise ValueError(f"bundle {bundle} has no names")
            if rows := [r for r in rows if r["names"] is None]:
                texts, parts, sizes = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("texts", "<u2"), ("parts", np.int64), ("sizes", np.int32)))
                ranks = np.bincount(texts, sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (parts, np.frombuffer(names, np.int64)[texts], ranks[texts])], ["part", "node", "rank"])

    bundles = _texts(docs, text, key).select("text").mapInArrow(cut, "range int, bundle long, names binary, keys binary")
    met = bundles.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(meet, "bundle long, names binary, texts binary, parts binary, sizes binary")
    return met.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(name, "part long, node long, rank long")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose sets are linked, written. Short sketches first; the rest is held against whole sets.

    Sets are made anew from the texts of the nodes that are left and shuffled once, as sorted hashes: of b for each of its
    pairs to a's place, and of a for each salt of its pairs.
    """
    a, b = (nodes.select(F.col("node").alias(x), F.col("id").alias(f"id{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}"), F.col("long").alias(f"long{x}")) for x in "ab")
    differing = F.zip_with("sketcha", "sketchb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.aggregate(differing, F.lit(0), lambda x, y: x + y)
    total = F.col("na") + F.col("nb")
    pairs = written(pairs.select("a", "b"), "pairs")
    if (n := pairs.count()) <= BROADCAST_IDS:  # then nodes, which are many, stay where they are, and pairs alone are shuffled
        sides = a.join(F.broadcast(pairs), "a").join(b.join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        sides = pairs.join(a, "a").join(b, "b")
    near = (
        sides.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * distance <= (100 - percent) * total))
        .select("a", "b", "ida", "idb", total.alias("total"), "longa", "longb")
    )

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("longa", "longb", "total")), strict=True)
            yield batch.select(["a", "b", "ida", "idb"]).filter(pa.array([may_link(x, y, n, percent) for x, y, n in rows], pa.bool_()))

    kind = dict(nodes.dtypes)["id"]
    near = near.mapInArrow(allowed, f"a long, b long, ida {kind}, idb {kind}")
    near = written(near, "near-pairs")
    removed(pairs)
    n = near.count()
    near = gathered(near, n)
    leaders = written(near.groupBy("a").agg(F.first("ida").alias("id"), F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts")), "leaders")
    many = written(leaders.filter("salts > 1").select("a", "salts"), "salted-leaders")  # at most one for SALT_PAIRS pairs
    wanted = near.join(sized(many, many.count()), "a", "left").select(F.col("idb").alias("id"), "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    texts = _texts(docs, text, key)

    def of_members(piece: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        sets, same, last = [], [], None
        for t, name in zip(rows, piece.column("b").to_pylist(), strict=True):
            if not sets or t != last:  # a text's pairs follow one another
                own, last = shingle_hashes(t, width), t
                node, raw = node_name(own), own.tobytes()
            same.append(node == name)  # an id may have other texts
            sets.append(raw)
        columns = [piece.column("a"), piece.column("salt"), piece.column("b"), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["a", "salt", "b", "other"]).filter(pa.array(same, pa.bool_()))

    def of_leaders(piece: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        sets = [shingle_hashes(t, width) for t in rows]
        same = [node_name(x) == name for x, name in zip(sets, piece.column("a").to_pylist(), strict=True)]
        columns = [piece.column("a"), piece.column("salts"), pa.array([x.tobytes() for x in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["a", "salts", "shingles"]).filter(pa.array(same, pa.bool_()))

    left = _mapped(texts.join(sized(wanted, n), "id").select("text", "a", "b", "salt"), of_members, "a long, salt int, b long, other binary")
    right = _mapped(texts.join(sized(leaders, leaders.count()), "id").select("text", "a", "salts"), of_leaders, "a long, salts int, shingles binary")
    right = right.select("a", "shingles", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).groupBy("a", "salt").agg(F.first("shingles").alias("shingles"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("shingles"), batch.column("other"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    links = written(left.join(right, ["a", "salt"]).select("a", "b", "shingles", "other").mapInArrow(compare, "a long, b long"), "links")
    removed(near, leaders, many)
    swept(links)
    return links


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) and m of `least` (u, m, n). Hubs, of which there are at most 2 * edges / HUB, are broadcast; others are joined."""
    if edges > HUB:
        hubs = written(least.filter(F.col("n") > HUB).select("u", F.col("m").alias("hub")), "hubs")
        if n := hubs.count():
            rows = rows.join(sized(hubs, n), "u", "left")
            of_hubs = rows.filter("hub IS NOT NULL").withColumnRenamed("hub", "m")
            return rows.filter("hub IS NULL").drop("hub").join(least.select("u", "m"), "u").unionByName(of_hubs)
    return rows.join(least.select("u", "m"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of the edges (a, b), written: the least node that can be reached.

    Large star and small star: each round links a node's neighbours to its least neighbour, until nothing changes. A
    hub's neighbours are aggregated to a minimum before they are shuffled, and are joined, not collected. Edges that fit one partition
    stay in one, so that their rounds have no exchange, whatever the number of shuffle partitions is.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    now = written(gathered(edges, edges.count()).distinct(), "edges")
    state = None
    while True:
        before, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = gathered(now, state.n)
        if state == before or not state.n:
            break
        hubs_of = state.n if state.n > common.PARTITION_ROWS else 0
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, hubs_of).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hubs_of).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        last, now = now, written(small.filter("u > v").distinct(), "stars")
        removed(last)
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    found = written(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "components")
    removed(now)
    return found


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    few = comps.count() <= common.PARTITION_ROWS  # then members, which are many, stay where they are
    return members.join(F.broadcast(comps) if few else comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_sketches(a: pd.DataFrame, b: pd.DataFrame | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (b None: in a twice, each pair once) of pairs of different components whose sizes and sketches allow a link."""
    own, other = (np.vstack(x["sketch"].to_numpy()).view(_U) for x in (a, a if b is None else b))
    n, m = a["n"].to_numpy(), (a if b is None else b)["n"].to_numpy()
    long, others = (x["long"].tolist() for x in (a, a if b is None else b))
    c, d = (pd.factorize(pd.concat([a["component"], (a if b is None else b)["component"]]))[0][x] for x in (slice(len(n)), slice(len(n), None)))
    for i in range(0, len(n), 32):
        rows = slice(i, i + 32)
        allowed = (c[rows, None] != d) & (100 * np.minimum(n[rows, None], m) >= percent * np.maximum(n[rows, None], m))
        if b is None:
            allowed &= np.arange(len(m)) > np.arange(i, i + len(n[rows]))[:, None]
        x, y = np.nonzero(allowed)
        distance = np.bitwise_count(own[rows][x] ^ other[y]).sum(1, dtype=np.int64)
        near = (100 + percent) * distance <= (100 - percent) * (n[rows][x] + m[y])
        x, y = x[near] + i, y[near]
        near = np.array([may_link(long[j], others[k], n[j] + m[k], percent) for j, k in zip(x.tolist(), y.tolist(), strict=True)], bool)
        yield x[near], y[near]


def _family_pairs(labelled: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of a family that may be linked. labelled: part, node, component, a (the part's leader)."""
    families = components(labelled.filter("node <> a").select("a", F.col("node").alias("b"))).withColumnRenamed("component", "family")
    rows = labelled.select("node", "component").distinct().join(families, "node").join(nodes.select("node", "n", "sketch", "long"), "node")
    rows = written(rows, "families")
    large = written(rows.groupBy("family").count().filter(F.col("count") > BLOCK).select("family", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-families")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = rows.join(sized(large, large.count()), "family", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "component", "n", "sketch", "long"
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        a, b = (rows[rows["block"] == k].reset_index(drop=True) for k in (p, q))
        found = [(a["node"].to_numpy()[x], (a if p == q else b)["node"].to_numpy()[y]) for x, y in near_sketches(a, None if p == q else b, percent)] if len(a) and len(b) else []
        x, y = (np.concatenate([z[k] for z in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": x, "b": y})

    # Else Spark would keep a whole family where the join by family has put it.
    return tiles.repartition("family", "p", "q").groupBy("family", "p", "q").applyInPandas(compare, "a long, b long")


def link(docs: DataFrame, width: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id, class_id (the least id with an equal set): one row per row of docs."""
    sets = written(_sets(docs, width, text, key), "sets")
    nodes = written(sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("long").alias("long")), "nodes")
    totals = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.sum("n").alias("shingles")).first()
    if not totals.n:
        return sets.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("id").alias("class_id"))
    # Only one row of a node is cut into parts.
    own, taken = docs.filter(F.col(key).isNotNull()), nodes.select(F.col("id").alias(key))
    if more := totals.rows - totals.n:
        copied = sets.join(sized(nodes.filter("copies > 1").select("node", F.col("id").alias("kept")), more), "node")
        repeated = written(copied.filter("id = kept").groupBy(F.col("id").alias(key)).count().filter("count > 1").select(key), "repeated-ids")
        if more <= BROADCAST_IDS:
            # An id that repeats may be left out for one of its texts and taken for another.
            left_out = written(copied.filter("id <> kept").select(F.col("id").alias(key)).join(taken, key, "left_anti").distinct(), "copies")
            own = own.join(F.broadcast(left_out), key, "left_anti")
        else:
            own = own.join(taken, key, "left_semi")
        if n := repeated.count():
            own, repeated = own.select(key, text), sized(repeated, n)
            own = own.join(repeated, key, "left_anti").unionByName(own.join(repeated, key, "left_semi").dropDuplicates([key, text]))
    keys = Bands(percent).most_keys(totals.n, totals.shingles)
    members = written(_members(own, width, percent, max(1, -(-keys // RANGE_KEYS)), text, key), "members")
    swept(members)

    # A text that others are copies of shares more parts with them than they do with each other: its rank is high, and it leads its buckets.
    # First each node is held against one leader: that with which it shares most parts. Buckets stay open whose nodes are not in one component then.
    leading = members.groupBy("part").agg(F.max(F.struct("rank", "node")).alias("x")).select("part", F.col("x.node").alias("a"))
    votes = members.join(leading, "part").filter("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("parts"))
    tried = written(votes.groupBy("b").agg(F.max(F.struct("parts", "a")).alias("x")).select("x.a", "b"), "first-pairs")
    edges = _verified(docs, nodes, tried, width, percent, text, key)
    comps = components(edges)
    for round_ in range(LEADER_ROUNDS + 1):
        labelled = _labelled(members, comps)
        open_parts = labelled.groupBy("part").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("rank", "node")).alias("x")).filter("low < high").select("part", "members", F.col("x.node").alias("a"))
        open_parts = written(open_parts, "open")
        state = open_parts.agg(F.count("*").alias("n"), F.max("members").alias("most")).first()
        if not state.n:
            removed(open_parts)
            break
        leading = open_parts.select("part", "a")
        labelled = written(labelled.join(F.broadcast(leading) if state.n <= common.PARTITION_ROWS else leading, "part"), "open-members")
        removed(members, open_parts, comps)
        last = round_ == LEADER_ROUNDS or state.most <= LEADER_BUCKET
        if last:
            pairs = _family_pairs(labelled, nodes, percent)
        else:
            leader = labelled.filter("node = a").select("part", F.col("component").alias("ca"))
            pairs = labelled.join(leader, "part").filter("component <> ca").select("a", F.col("node").alias("b")).distinct()
        edges = edges.unionByName(_verified(docs, nodes, pairs.join(tried, ["a", "b"], "left_anti"), width, percent, text, key))
        comps = components(edges)
        members = labelled.filter("node <> a").select("part", "node", "rank")
        if last:
            break

    # Names: of every node that is linked or has copies, the least id of its component.
    linked = nodes.join(comps, "node")
    names = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    named = linked.join(sized(names, names.count()), "component").select("node", F.col("id").alias("class_id"), "component_id")
    alone = nodes.filter("copies > 1").join(comps, "node", "left_anti").select("node", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    named = written(named.unionByName(alone), "names")
    removed(nodes, members, tried, edges, comps)
    return sets.join(sized(named, named.count()), "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id")
    )
