"""SimHash near-duplicate classes (Charikar, 2002) with pigeonring candidate filtering (Qin and Xiao, 2018).

Fingerprints are cut into m segments on a ring. If two differ in at most d bits, some segment i starts a chain whose first l
segments differ in at most floor(l * d / m) bits together, for every l. Candidates are therefore found by an equi-join on the
first segments of such a chain (exactly, or with one differing bit, which one side enumerates), the proportional budgets of
the longer chains prune them, and the full Hamming distance, the chain of all m segments, decides.

Only distinct fingerprints take part, and a bucket of the join gives the links of a spanning forest of its matches, not
all pairs. A bucket with many members is dealt over blocks that each hold a bounded part of them and stream the rest past.

Defined results: a text without words has fingerprint zero, as has a null text, and is linked like any other; a text with
fewer words than a shingle is one shingle; documents with a null key keep their fingerprint but get no class and link
nothing; repeated rows share a class; very long texts are read whole; ties between documents of a class go to the smaller key,
then to the smaller hash of the text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import read, scratch, shuffle_partitions, slices, stage
from storyloom.llm.components import connected_components
from storyloom.llm.fingerprints import shingle_hashes, shingles_of, word_hashes

#: Members of a bucket that one task holds at once; larger buckets are dealt over several blocks.
BLOCK = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Scheme:
    """bits in all; segments of equal size; links up to `distance`; the join key is `exact` segments and then `loose` ones
    that may differ in one bit together."""

    bits: int = 64
    segments: int = 4
    distance: int = 3
    exact: int = 1
    loose: int = 1

    @property
    def width(self) -> int:
        return self.bits // self.segments

    @property
    def lanes(self) -> int:
        return self.bits // 64

    def budget(self, chain: int) -> int:
        return chain * self.distance // self.segments


#: Links at 3 of 64 bits: the key covers all that the chain budgets 0, 1 allow, so no link is lost.
CONTRACT = Scheme()


def majority_bits(hashes: np.ndarray) -> bytes:
    """One bit for each of 64: set if it is in over half of the hashes. Most significant bit first."""
    n = len(hashes)
    if not n:
        return bytes(8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def shingle_fingerprint(text: str, width: int = 3) -> bytes:
    """64 bits from the XXH64 (seed 42) of each run of `width` words, lower-cased in A-Z only, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return bytes(8)
    join, h, width = b" ".join, xxhash.xxh64_intdigest, min(width, len(words))
    runs = zip(*(words[j:] for j in range(width)), strict=False)
    return majority_bits(np.fromiter((h(join(r), 42) for r in runs), np.uint64, len(words) - width + 1))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the shingle fingerprint of each whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = (t or "" for t in batch.column("text").to_pylist())
            found = [shingle_fingerprint(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, "doc_id long, fp binary")


def segments_of(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(n, segments) integers from (n, bits / 8) bytes."""
    bits = np.unpackbits(fps, axis=1).reshape(len(fps), scheme.segments, scheme.width).astype(np.uint64)
    return (bits << np.arange(scheme.width, dtype=np.uint64)[::-1]).sum(axis=2, dtype=np.uint64)


def bucket_keys(fps: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is_variant) of every bucket that a fingerprint is in.

    A variant sets one bit that is clear in the loose segments: of two that differ in one bit, the one with the clear bit
    meets the other's own key.
    """
    segs, m, w = segments_of(fps, scheme), scheme.segments, scheme.width
    size = (scheme.exact + scheme.loose) * w
    rows, keys, kinds = [], [], []
    every = np.arange(len(fps))
    for start in range(m):
        chain = np.zeros(len(fps), dtype=np.uint64)
        for j in range(scheme.exact + scheme.loose):
            chain = (chain << np.uint64(w)) | segs[:, (start + j) % m]
        flips = np.uint64(1) << np.arange(scheme.loose * w, dtype=np.uint64)
        own = (np.uint64(start) << np.uint64(size)) | chain
        row, flip = np.nonzero((chain[:, None] & flips) == 0)
        rows += [every, row]
        keys += [own, own[row] | flips[flip]]
        kinds += [np.zeros(len(fps), bool), np.ones(len(row), bool)]
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(kinds)


def _matches(one: np.ndarray, many: np.ndarray, start: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Places in many (n, segments) that stay within every chain budget from start on, and their distance to one."""
    alive = np.arange(len(many))
    total = np.zeros(len(many), dtype=np.int64)
    for chain in range(1, scheme.segments + 1):
        seg = (start + chain - 1) % scheme.segments
        total = total + np.bitwise_count(many[alive, seg] ^ one[seg])
        keep = total <= scheme.budget(chain)
        alive, total = alive[keep], total[keep]
        if not len(alive):
            break
    return alive, total


class _Bucket:
    """The members that a task holds of one bucket block, and the forest of the links found so far."""

    def __init__(self, start: int, scheme: Scheme):
        self.start, self.scheme = start, scheme
        self.reps: list[int] = []
        self.held: list[np.ndarray] = []
        self.segs: np.ndarray | None = None
        self.trees: np.ndarray | None = None

    def hold(self, reps: np.ndarray, segs: np.ndarray) -> None:
        self.reps += reps.tolist()
        self.held.append(segs)

    def _settle(self, links: list[tuple[int, int]]) -> None:
        self.segs = np.concatenate(self.held) if self.held else np.zeros((0, self.scheme.segments), np.uint64)
        self.trees = np.arange(len(self.reps))
        for i in range(1, len(self.reps)):
            self._link(self.reps[i], self.segs[i], i, links)

    def _link(self, rep: int, segs: np.ndarray, upto: int, links: list[tuple[int, int]], own: bool = True) -> None:
        """Link to the nearest match and, of each further tree matched, to its nearest member."""
        found, far = _matches(segs, self.segs[:upto], self.start, self.scheme)
        if not len(found):
            return
        found = found[np.argsort(far, kind="stable")]
        met = self.trees[found]
        trees, first = np.unique(met, return_index=True)
        links += [(rep, self.reps[found[i]]) for i in first if self.reps[found[i]] != rep]
        if len(trees) > 1:
            self.trees[np.isin(self.trees, trees)] = trees[0]
        if own:
            self.trees[upto] = trees[0]

    def probe(self, reps: np.ndarray, segs: np.ndarray, links: list[tuple[int, int]]) -> None:
        if self.segs is None:
            self._settle(links)
        for rep, s in zip(reps.tolist(), segs, strict=True):
            self._link(rep, s, len(self.reps), links, own=False)

    def finish(self, links: list[tuple[int, int]]) -> None:
        if self.segs is None and len(self.reps) > 1:
            self._settle(links)


def links(distinct: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the rows of distinct (rep long, fp binary), enough to connect all that lie within the distance.

    A row of a bucket carries only its key and rep until the join with the buckets' own members has dropped the variants
    that meet none; that join also tells how many blocks a bucket needs.
    """
    spark = distinct.sparkSession
    octets, shift = scheme.bits // 8, (scheme.exact + scheme.loose) * scheme.width

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, octets)
                rows, keys, kinds = bucket_keys(fps, scheme)
                reps = part.column("rep").to_numpy(zero_copy_only=False)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds.astype(np.int8), pa.int8()), pa.array(reps, pa.int64())], ["key", "kind", "rep"])

    rows = stage(distinct.select("rep", "fp").mapInArrow(expand, "key long, kind byte, rep long"), "simhash-buckets")
    members = stage(rows.where("kind = 0").groupBy("key").agg(F.count("*").alias("n")), "simhash-members")
    met = stage(rows.where("kind = 1").join(members, "key"), "simhash-variants")
    needed = stage(members.where("n > 1").unionByName(met.select("key", "n")).distinct(), "simhash-live")
    live = met.unionByName(rows.where("kind = 0").join(needed, "key").select(*met.columns))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = live.withColumn("own", own).select("key", "kind", "rep", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    dealt = dealt.select("key", "block", "rep", F.when((F.col("kind") == 0) & (F.col("own") == F.col("block")), 0).otherwise(1).cast("byte").alias("role"))
    full = dealt.join(distinct.select("rep", "fp"), "rep")
    ordered = full.repartition(shuffle_partitions(spark), "key", "block").sortWithinPartitions("key", "block", "role", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        bucket: _Bucket | None = None
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, block_no, rep, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "rep", "role"))
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, octets)
            segs = segments_of(fps, scheme)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (block_no[1:] != block_no[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                name = (int(key[lo]), int(block_no[lo]))
                if name != current:
                    if bucket is not None:
                        bucket.finish(found)
                    current, bucket = name, _Bucket(name[0] >> shift, scheme)
                if role[lo] == 0:
                    bucket.hold(rep[lo:hi], segs[lo:hi])
                else:
                    bucket.probe(rep[lo:hi], segs[lo:hi], found)
            if found:
                yield flush()
        if bucket is not None:
            bucket.finish(found)
        if found:
            yield flush()

    return ordered.mapInArrow(compare, "a long, b long")


def near_classes(docs: DataFrame, scheme: Scheme = CONTRACT, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, n_forest_links): the smallest key that links lead to, and how many of the links that were kept
    to connect its class (a spanning forest of each bucket, not all links) its fingerprint has."""
    with scratch(docs.sparkSession):
        prints = stage(fingerprint(docs, key, text, shingle), "simhash-prints", outlive=True)
        distinct = stage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
        found = stage(links(distinct, scheme).distinct(), "simhash-links")
        roots = connected_components(found).withColumnRenamed("node", "rep")
        ends = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
        classes = distinct.join(roots, "rep", "left").join(ends, "rep", "left")
        classes = classes.select("fp", F.coalesce("root", "rep").alias("component_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_forest_links"))
        classes = stage(classes, "simhash-classes", outlive=True)
    known = prints.join(classes, "fp", "left")
    classed = F.col("doc_id").isNotNull()
    return known.select("doc_id", "fp", F.when(classed, F.col("component_id")).alias("component_id"), F.when(classed, F.col("n_forest_links")).alias("n_forest_links"))


# ---- near-duplicate classes by shared five-word shingles --------------------------------------------------------------

SIMILARITY = 0.8
#: Bits of the parity maps of a shingle set: two maps differ in no more bits than the sets in members. The small one goes with each
#: shingle of a prefix; the large one rules out pairs of longer texts before their shingles are fetched.
PARITY, WIDE = 512, 4096
#: The most common shingles that are told to the workers. They only order shingles: any one order gives the same classes.
COMMON = 100_000
#: Rounds that link each document to one other of each shingle, before all that are still apart are compared.
HUB_ROUNDS = 1
#: Rows of a shingle up to which all pairs are looked at together with those of other shingles, in array operations.
FEW = 16
#: Pairs that a task knows it has given: a pair that shares several keys is given once for each task until so many are known (some
#: 20 MB), and repeated ones fall to the distinct after it.
REMEMBERED = 1 << 17
#: No common shingles.
_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _common_shingles(docs: DataFrame, similarity: float, width: int = 5, few: int = FEW, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingle hashes that many documents have in the prefix by hash alone, and in how many they are.

    All documents are counted. Told are those in over `few` documents, from the power of two on from which they are `most` at most.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [prefix(np.unique(shingle_hashes(t or "", width)), _NONE, similarity) for t in batch.column("text").to_pylist()]
            shingles, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(each, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > few)
    with scratch(docs.sparkSession):
        counts = stage(counted.withColumn("level", F.floor(F.log2("n")).cast("int")), "simhash-common")
        levels = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}  # powers of two
        least = 0
        while sum(n for level, n in levels.items() if level >= least) > most:
            least += 1
        told = counts.where(F.col("level") >= least).select("shingle", "n").toArrow()
    shingles, n = told.column("shingle").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the ascending distinct shingles in the order rare before common, then by hash: so many that two sets of that
    similarity have one in both prefixes."""
    n = len(shingles)
    if not n:
        return shingles
    seen = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.searchsorted(common[0], shingles).clip(max=len(common[0]) - 1)
        seen = np.where(common[0][at] == shingles, common[1][at], 0)
    # The sort is stable, so equally rare ones stay in the order of their hashes.
    return shingles[np.argsort(seen, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _parities(shingles: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _prefix_prints(docs: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """(doc_id, h, same, n, prefix, bits, fp): same is equal for equal sequences of words; n distinct shingles, their prefix,
    their parities, and the fingerprint of all shingles."""
    handle = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, similarity, width))  # COMMON at most
    names = ["doc_id", "h", "same", "n", "prefix", "bits", "fp"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = handle.value
        for batch in slices(batches):
            made: list[tuple] = []
            for t in batch.column("text").to_pylist():
                words = word_hashes(t or "")
                runs = shingles_of(words, width)
                found = np.unique(runs)
                bits = _parities(found, PARITY)
                made.append((hashlib.md5(words.tobytes(), usedforsecurity=False).digest(), len(found), prefix(found, common, similarity).tobytes(), bits, majority_bits(runs)))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(make, "doc_id long, h long, same binary, n long, prefix binary, bits binary, fp binary")


def _prefix_rows(distinct: DataFrame) -> DataFrame:
    """(key, rep, n, left, prev) for each shingle of a prefix: how many shingles the set has, how many from this one on in their
    order, and the shingle before it (the first: itself)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n = batch.column("prefix").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int32)
            size = np.array([len(f) // 8 for f in found], np.int64)
            keys = np.frombuffer(b"".join(found), np.int64)
            reps, sizes = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), size), np.repeat(n, size)
            at = (np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            before = np.where(at > 0, np.roll(keys, 1), keys)
            columns = [pa.array(keys, pa.int64()), pa.array(reps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sizes - at, pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rep", "n", "left", "prev"])

    return distinct.select("rep", "prefix", "n").mapInArrow(expand, "key long, rep long, n int, left int, prev long")


def _share(similarity: float) -> float:
    """Two sets of that similarity have so much of the sum of their sizes in common."""
    return similarity / (1 + similarity)


def _in_reach(n, left, other_n, other_left, similarity: float, least=np.minimum):
    """False only where the similarity is ruled out for two sets whose first common shingle this is: all others lie after it."""
    return least(left, other_left) >= (n + other_n) * _share(similarity) - 1e-6


def _unlike(bits: np.ndarray, other_bits: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """True only where parities tell that more than so many shingles are in one of the sets alone."""
    return np.bitwise_count(bits ^ other_bits).sum(axis=1, dtype=np.int64) > apart


def _may_be_near(n: np.ndarray, bits: np.ndarray, other_n: np.ndarray, other_bits: np.ndarray, similarity: float) -> np.ndarray:
    """False only where sizes or parities rule the similarity out."""
    apart = (n + other_n) * (1 - 2 * _share(similarity)) + 1e-6
    return (np.abs(n - other_n) <= apart) & ~_unlike(bits, other_bits, apart)


def _apart(rows: DataFrame, block: int, similarity: float) -> DataFrame:
    """(key, rep, n, left, prev, root, blocks): the rows whose key several classes share, and over how many tasks the key must be dealt.

    What a row has from its key on bounds the size of a partner whose first common shingle with it is the key; rows without a
    partner of that size under their key go, so a shingle that all have late in their order makes no group.
    """
    reach = F.floor(F.col("left") / F.lit(_share(similarity)) - F.col("n") + 1e-6)
    with_reach = rows.withColumn("reach", reach)
    counts = with_reach.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("smallest"), F.max("reach").alias("farthest")).where("lo < hi")
    kept = with_reach.join(counts.select("key", "blocks", "smallest", "farthest"), "key").where("reach >= smallest and n <= farthest")
    return stage(kept.select("key", "rep", "n", "left", "prev", "root", "blocks"), "simhash-apart")


def _partners(apart: DataFrame, sizes: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(a, b) of rows that share a key but no root and may be near: every pair, or one or two for each row of a key that has any.

    A key with many rows is dealt over several tasks, each holding a part and streaming all rows past. Two rows that have the
    same shingle before the key share an earlier key, too, and only a pair's first common key counts: there they are looked at.
    """
    share = _share(similarity)
    names = ["key", "rep", "root", "n", "left", "prev", "bits"]
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = apart.join(sizes.select("rep", "bits"), "rep").select(*names, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.select(*names, "block", (F.col("own") == F.col("block")).alias("held"))
    ordered = dealt.repartition(shuffle_partitions(apart.sparkSession), "key", "block").sortWithinPartitions("key", "block", F.desc("held"), "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, table, told, met = None, [], None, set(), np.zeros(0, bool)
        for batch in slices(batches, 4000):
            if not batch.num_rows:
                continue
            key, block_no, rep, root, n, left, prev, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "rep", "root", "n", "left", "prev", "held"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            fresh_name = np.flatnonzero((key[1:] != key[:-1]) | (block_no[1:] != block_no[:-1])) + 1
            edges = np.union1d(fresh_name, np.flatnonzero(held[1:] != held[:-1]) + 1)
            found: list[tuple[int, int]] = []
            # Small groups that lie wholly in this batch: all their pairs at once.
            starts = np.concatenate([[0], fresh_name])
            length = np.diff(np.append(starts, len(key)))
            whole = (length <= FEW) & (starts > 0) & (starts + length < len(key)) & held[starts + length - 1]
            for k in range(2, FEW + 1):
                first = starts[whole & (length == k)]
                if len(first):
                    i, j = ((first[:, None] + side).ravel() for side in np.triu_indices(k, 1))
                    differ = (root[i] != root[j]) & ((prev[i] != prev[j]) | (prev[i] == key[i]))
                    i, j = i[differ], j[differ]
                    reached = _in_reach(n[i], left[i], n[j], left[j], similarity)
                    i, j = i[reached], j[reached]
                    near = _may_be_near(n[i], bits[i], n[j], bits[j], similarity)
                    i, j = i[near], j[near]
                    if not every:
                        of = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
                        i, j = i[of], j[of]
                    found += zip(rep[i].tolist(), rep[j].tolist(), strict=True)
            small = set(starts[whole].tolist())
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if lo in small:
                    continue
                name = (key[lo], block_no[lo])
                if name != current:
                    current, parts, table, met = name, [], None, np.zeros(0, bool)
                mine = (rep[lo:hi], root[lo:hi], n[lo:hi], left[lo:hi], bits[lo:hi], prev[lo:hi])
                if held[lo]:  # against those held before it, and one another
                    parts.append(mine)
                    table = parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))
                    parts, met = [table], np.append(met, np.zeros(hi - lo, bool))
                if table is None:
                    continue
                for r, c, size, rest, b, p in zip(*mine, strict=True):
                    both = (table[2] + size) * share - 1e-6
                    at = np.flatnonzero((table[1] != c) & (table[3] >= both) & (rest >= both) & ((table[5] != p) | (p == key[lo])))
                    if len(at):
                        at = at[_may_be_near(table[2][at], table[4][at], size, b, similarity)]
                    if not every and len(at):  # its first partner, and those that have had none
                        at = np.union1d(at[:1], at[~met[at]])
                        met[at] = True
                    found += [(r, o) for o in table[0][at]]
            pairs = {(min(p), max(p)) for p in found} - told
            if len(told) < REMEMBERED:
                told |= pairs
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(rep, n, wide, shingles) of (rep, text): how many distinct shingle hashes, their parities, and the hashes, ascending, as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or "", width)) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([_parities(x, WIDE) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *columns], ["rep", "n", "wide", "shingles"])

    return docs.select("rep", "text").mapInArrow(make, "rep long, n long, wide binary, shingles binary")


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the large parity maps of both do not rule out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for c in ("wide_a", "wide_b"))
                near = _may_be_near(batch.column("n_a").to_numpy(), one, batch.column("n_b").to_numpy(), other, similarity)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def _likeness(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) from (a, b, left, right)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.mapInArrow(measure, "a long, b long, similarity double")


def _rooted_prints(docs: DataFrame, similarity: float, key: str, text: str, block: int) -> DataFrame:
    """(doc_id, h, root) of every row with a key: h is a hash of its text, root is equal within a class.

    Candidates come from two sides: pigeonring chains on the fingerprints of all five-word shingles find the closest copies,
    and an exact prefix-filter join finds the rest. Each is measured on its shingles before it links anything. Of rows that
    share a shingle of their prefixes, each pair is measured, ruled out by sizes or parities, or in one class already by links
    that were measured; two documents of that similarity do share one.
    """
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with scratch(spark):
        with scratch(spark):
            prints = stage(_prefix_prints(keyed, similarity), "simhash-prints")
            members = stage(prints.select("doc_id", "h", "same"), "simhash-rows", outlive=True)
            told = F.min(F.struct("doc_id", "h")).alias("row")
            # The sets of a class of equal words are equal; its number stands for it from here on.
            numbered = prints.groupBy("same").agg(told, F.first(F.struct("n", "prefix", "bits", "fp")).alias("first"))
            distinct = stage(numbered.select("same", "row", "first.*").withColumn("rep", F.monotonically_increasing_id()), "simhash-distinct", outlive=True)
        sizes = distinct.select("rep", "n", "bits")
        first = _apart(_prefix_rows(distinct).select("key", "rep", "n", "left", "prev", F.col("rep").alias("root")), block, similarity)
        by_print = distinct.groupBy("fp").agg(F.min("rep").alias("rep"))
        with scratch(spark):
            linked = links(by_print, CONTRACT).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            ringed = stage(linked, "simhash-ringed", outlive=True)
        # Most rows have no partner that sizes and parities allow: only the others' texts are read again.
        pairs = stage(_partners(first, sizes, similarity, False).unionByName(ringed).distinct(), "simhash-partners")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = distinct.select("rep", "row.doc_id", "row.h").join(ends, "rep", "left_semi")
        # The keys grow with the input, so texts meet them by a shuffle at every size, however few the keys are.
        met = keyed.join(wanted.hint("merge"), "doc_id").where(F.xxhash64("text") == F.col("h")).select("rep", "text")
        sets = stage(_shingle_sets(met.dropDuplicates(["rep"])), "simhash-shingles")
        compared = stage(first.select("key", "rep", "n", "left", "prev").join(sets.select("rep"), "rep", "left_semi"), "simhash-compared")

        def near(candidates: DataFrame) -> DataFrame:
            with scratch(spark):
                likely = stage(_likely(candidates, sets, similarity), "simhash-likely")
                return measured(likely)

        def measured(likely: DataFrame) -> DataFrame:
            sided = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
            return stage(_likeness(sided.select("a", "b", "left", "right")).where(F.col("similarity") >= similarity).select("a", "b"), "simhash-near", outlive=True)

        found = near(pairs)
        roots = connected_components(found)
        for turn in range(HUB_ROUNDS + 1):
            rooted = compared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "left", "prev", F.coalesce("root", "rep").alias("root"))
            apart = _apart(rooted, block, similarity)
            if turn < HUB_ROUNDS:
                hubs = apart.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("x"), "rep", "root", "n", "left")).alias("hub"))
                reached = _in_reach(F.col("n"), F.col("left"), F.col("hub.n"), F.col("hub.left"), similarity, F.least)
                met = apart.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & reached)
                more = met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
            else:
                more = _partners(apart, sizes, similarity, True)
            with scratch(spark):
                # Written first: the anti-join would else be put before the distinct and meet every repeat.
                more = stage(more, "simhash-more")
                fresh = near(stage(more.join(pairs, ["a", "b"], "left_anti"), "simhash-candidates"))
                fresh = stage(fresh, "simhash-fresh", outlive=True)
            if not fresh.isEmpty():
                found = found.unionByName(fresh)
                roots = connected_components(found)
        classes = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("root"))
        return stage(members.join(classes, "same").select("doc_id", "h", "root"), "simhash-rooted", outlive=True)


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by a Jaccard similarity of five-word shingles of at least 0.8; no link is lost."""
    rooted = _rooted_prints(docs, similarity, key, text, block)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest key stays.

    Rows that share a key are documents of their own, told apart by their texts; of rows that are equal in both one stays.
    Documents with a null key are kept: nothing tells them apart from one another.
    """
    known, h = docs.where(F.col(key).isNotNull()), F.xxhash64(F.col(text))
    rooted = _rooted_prints(docs, similarity, key, text, block)
    kept = stage(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("row")).select(F.col("row.doc_id").alias("_kept"), F.col("row.h").alias("_h")), "simhash-kept")
    chosen = known.join(kept.hint("merge"), (docs[key] == kept["_kept"]) & (h == kept["_h"]), "left_semi")
    repeated = rooted.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # else every key and text has one row, and texts need not meet by key again
        chosen = chosen.withColumn("_h", h).dropDuplicates([key, "_h"]).drop("_h")
    return chosen.unionByName(docs.where(F.col(key).isNull()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "n_forest_links")
