"""SimHash near-duplicates: byte-position index, count filter, exact check, connected classes.

Two 64-bit fingerprints with at most `distance` differing bits differ in at most that many of their 8
bytes, so they share at least 8 - distance bytes by position. One position's posting list holds 1/256 of
all fingerprints, and pairs within it would grow with the square of the table; so lists are intersected:
the 8 positions lie in two halves of four, a pair that shares five positions shares three within one half,
and the index key is (three positions, their bytes), eight keys a fingerprint. Pairs that meet there are
counted: those with fewer shared positional bytes than guaranteed are dropped, the rest are verified.
For other distances the key is two of distance + 2 runs of bits. Where texts have to be similar, not only
their fingerprints, links found this way are candidates that are checked on all shingles, and bands of
least hashes give those that 64 bits miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from itemnorm.llm.common import id_type, map_batches, spread_join, text_bytes
from itemnorm.session import cut_lineage

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Lists up to SHORT are compared inside a join; in longer ones two blocks of BLOCK meet in one group.
SHORT = 32
BLOCK = 1024
#: Bands of least hashes and orders in each, by which similar texts of far fingerprints meet; bits of the bitmap
#: that rules pairs out; and a block of a long list of such a band.
BANDS, ROWS = 28, 7
MARKS = 512
BAND_BLOCK = 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all word shingles of the whole text; of all its words where it has fewer, none without words."""
    words = text_bytes(text).lower().split()
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash over XXH64 of all word shingles of the whole text; 0 without words."""
    return majority(shingles(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(_POWERS[2 * ones > total].sum(dtype=np.uint64))


def fingerprints(points: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, fingerprint (the 64 bits as a signed long) of every point; null text: as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["item_id", "fingerprint"])

    return map_batches(points.select("item_id", "text"), run, f"item_id {id_type(points)}, fingerprint bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _index_masks(distance: int) -> list[int]:
    """Bit masks of which any two fingerprints within the distance agree on one whole."""
    if distance == 3:
        return [sum(0xFF << (8 * p) for p in c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
    if not 0 <= distance <= 7:
        raise ValueError("the byte index guarantees a shared byte up to 7 differing bits")
    # distance + 2 runs of neighbouring bits: the differing bits miss two of them.
    runs = [sum(1 << int(b) for b in run) for run in np.array_split(np.arange(64), distance + 2)]
    return [a | b for a, b in combinations(runs, 2)]


def _links(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning set of links of the pairs within the distance, one of left and one of right."""
    nodes = np.union1d(left, right)
    root = {int(v): int(v) for v in nodes}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    left_bytes, right_bytes = (np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8) for v in (left, right))
    for first in range(0, len(left), 128):
        part = left_bytes[first : first + 128]
        shared = np.zeros((len(part), len(right)), np.uint8)
        for k in range(8):
            shared += part[:, k, None] == right_bytes[None, :, k]
        i, j = np.nonzero(shared >= 8 - distance)
        a, b = left[first + i], right[j]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
        for u, v in zip(a[near].tolist(), b[near].tolist()):
            p, q = find(u), find(v)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(u, v), max(u, v)))
    return out


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all pairs within the distance.

    prints(fingerprint), distinct. Lists of one fingerprint meet nothing. Lists up to SHORT are joined with
    themselves. A longer list is cut in blocks by hash of the fingerprint; the number of blocks follows
    from its counted length, and every two blocks meet in one group of at most about 2 * block
    fingerprints, which gives a spanning set of its links, fewer than it has fingerprints, never all pairs.
    """
    keys = []
    for n, mask in enumerate(_index_masks(distance)):
        keys.append(F.struct(F.lit(n).alias("positions"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("bytes")))
    index = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key")).select("key.positions", "key.bytes", "fingerprint")
    lists = index.groupBy("positions", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    listed = cut_lineage(index.join(lists, ["positions", "bytes"]))

    # Short lists: pairs inside the join, at most SHORT / 2 compared for an entry, counted and verified there.
    short = listed.where(F.col("n") <= SHORT).select("positions", "bytes", "fingerprint")
    a, b = F.col("l.fingerprint"), F.col("r.fingerprint")
    differing = a.bitwiseXOR(b)
    shared = sum(F.when(differing.bitwiseAND(F.lit(_signed(0xFF << (8 * k)))) == 0, 1).otherwise(0) for k in range(8))
    met = (F.col("l.positions") == F.col("r.positions")) & (F.col("l.bytes") == F.col("r.bytes")) & (a < b)
    pairs = short.alias("l").join(short.alias("r"), met & (shared >= 8 - distance) & (F.bit_count(differing) <= distance))
    few = pairs.select(a.alias("a"), b.alias("b"))

    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = (
        listed.where(F.col("n") > SHORT)
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", own)
        .select("positions", "bytes", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("positions", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fingerprint")
    )

    def tiles(table: pa.Table) -> pa.Table:
        values, own_block = table["fingerprint"].to_numpy(), table["own"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        found = _links(values[own_block == i], values[own_block == j], distance)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    many = dealt.groupBy("positions", "bytes", "i", "j").applyInArrow(tiles, "a bigint, b bigint")
    return few.union(many).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b"), F.lit(0), F.lit(1))
    )
    degree = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degree.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected class, for every node that has a link.

    Large-star and small-star steps in turn: each joins a node's neighbours to its smallest one, so the
    number of rounds grows with the logarithm of the longest chain. A round's links are written to the
    shared folder and counted there; nothing is collected.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(points: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """item_id, fingerprint, component_id of every point.

    points(item_id, text, ...): fingerprints over lower-cased word shingles of the whole text; two points
    are linked if theirs differ in at most `distance` bits; component_id is the smallest item_id that a
    point reaches over links, its own included. Null and empty texts have fingerprint 0, linked like any
    other. A null id takes part; a class of null ids only has a null component_id. Repeated rows give
    repeated results, an empty table an empty result.
    """
    prints = cut_lineage(fingerprints(points, shingle))
    # One line per distinct fingerprint: copies, however many, meet the index once.
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("item_id").alias("first_id")))
    roots = connected(near_links(classes.select("fingerprint"), distance, block))
    placed = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    firsts = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = cut_lineage(placed.join(firsts, "root").select("fingerprint", "component_id"))
    return prints.join(by_print, "fingerprint").select("item_id", "fingerprint", "component_id")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: each digests the least values of its members under ROWS orders.

    Sets of Jaccard similarity s share a key with chance s ** ROWS, so at least one with chance
    1 - (1 - s ** ROWS) ** BANDS. No keys without shingles.
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, first : first + 1024] * _FACTORS[:, None]).min(1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """MARKS bits, those that the shingles fall on, as signed words.

    Bits of one set only come from at least as many shingles of it only, so two sets differ in at least as
    many shingles as their bitmaps in bits.
    """
    bits = np.zeros(MARKS, np.uint8)
    bits[(hashes % np.uint64(MARKS)).astype(np.intp)] = 1
    return np.packbits(bits).view(np.int64)


def _apart(similarity: float) -> float:
    """Share of the summed sizes of two sets in which they may differ at that Jaccard similarity."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def _hopeful(sizes: np.ndarray, marks: np.ndarray, u: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the others that may be as similar to u as asked, by sizes and bitmaps; exact, none is lost."""
    gap = np.bitwise_count((marks[others] ^ marks[u]).view(np.uint64)).sum(1, dtype=np.int64)
    gap = np.maximum(gap, np.abs(sizes[others] - sizes[u]))
    return others[gap <= _apart(similarity) * (sizes[others] + sizes[u])]


def _hopeful_links(nodes: np.ndarray, sizes: np.ndarray, marks: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning set of links of the pairs, one of left and one of right, that may be similar."""
    label, out = np.arange(len(nodes)), []
    for u in left.tolist():
        near = _hopeful(sizes, marks, u, right, similarity)
        near = near[label[near] != label[u]]
        if len(near):
            names, at = np.unique(label[near], return_index=True)
            out += [(int(nodes[u]), int(v)) for v in nodes[near[at]]]
            label[np.isin(label, names)] = label[u]
    return out


def _similar_links(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning set of links of the pairs, one of left and one of right, that are similar."""
    sizes, marks = np.array([len(s) for s in sets]), np.array([bitmap(s) for s in sets])
    label, out = np.arange(len(nodes)), []
    for u in left.tolist():
        near = _hopeful(sizes, marks, u, right, similarity)
        for v in near[label[near] != label[u]].tolist():
            if label[v] != label[u] and jaccard(sets[u], sets[v]) >= similarity:
                label[label == label[v]] = label[u]
                out.append((int(nodes[u]), int(nodes[v])))
    return out


def _marks_apart(a: str, b: str) -> F.Column:
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(MARKS // 64))


def band_links(texts: DataFrame, similarity: float, block: int = BAND_BLOCK) -> DataFrame:
    """a, b: links between texts that share a band key and may be similar by sizes and bitmaps.

    texts(node, size, marks, bands), node distinct. Lists of the same nodes, as near copies give in most
    bands, are compared once. Lists up to SHORT are joined with themselves; in longer ones two blocks meet
    in one group, which gives a spanning set of its links.
    """
    index = texts.select("node", F.explode("bands").alias("key"))
    one, two = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    lists = index.groupBy("key").agg(F.count("*").alias("n"), one.alias("one"), two.alias("two")).where("n > 1")
    lists = lists.groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key", "n")
    members = spread_join(index, lists, ["key"], "node")
    listed = cut_lineage(members.join(texts.select("node", "size", "marks"), "node"))

    short = listed.where(F.col("n") <= SHORT)
    size = F.col("l.size") + F.col("r.size")
    gap = F.greatest(F.abs(F.col("l.size") - F.col("r.size")), _marks_apart("l.marks", "r.marks"))
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (gap <= F.lit(_apart(similarity)) * size)
    few = short.alias("l").join(short.alias("r"), met).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))

    dealt = _dealt(listed.where(F.col("n") > SHORT).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "key", "size", "marks")

    def tiles(table: pa.Table) -> pa.Table:
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        marks = table["marks"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return _link_table(_hopeful_links(table["node"].to_numpy(), table["size"].to_numpy(), marks, np.flatnonzero(own == i), np.flatnonzero(own == j), similarity))

    return few.union(dealt.groupBy("key", "i", "j").applyInArrow(tiles, "a bigint, b bigint")).distinct()


def _dealt(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a key in its `blocks` blocks, each once for every pair (i, j) of blocks that its own is in."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select(key, "node", "own", *more, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(key, "node", "own", *more, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def similar_firsts(points: DataFrame, shingle: int, distance: int, similarity: float, block: int = BLOCK // 2) -> DataFrame:
    """row_id of the point of the smallest item_id in each class of similar texts.

    points(row_id, item_id, text), row_id a distinct bigint. Texts of the same words are one; others are
    linked if their sets of word shingles have at least that Jaccard similarity, computed on all shingles.
    Compared are texts of near fingerprints (the SimHash index, up to `distance` bits) and, as 64 bits miss
    most pairs near the least similarity, those that share a band key (`band_keys`): a pair of similarity 0.8
    is met with chance 0.998, of 0.85 or more with 0.9999. Only texts met send their shingles; every two blocks of a
    connected class of them meet in one group. Null, empty and blank texts are one class. An empty table
    gives an empty result; long texts are read whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, words, sizes, marks, bands = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            words.append(hashlib.sha256(b" ".join(text_bytes(text).lower().split())).digest())
            hashes = shingles(text, shingle)
            prints.append(majority(hashes))
            own = np.unique(hashes)
            sizes.append(len(own))
            marks.append(bitmap(own))
            bands.append(band_keys(own))
        columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(words, pa.binary()), pa.array(sizes, pa.int64())]
        columns += [pa.array(c, pa.list_(pa.int64())) for c in (marks, bands)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row_id", "item_id", *own_columns])

    own_columns = ["fingerprint", "words", "size", "marks", "bands"]
    schema = f"row_id bigint, item_id {id_type(points)}, fingerprint bigint, words binary, size bigint, marks array<bigint>, bands array<bigint>"
    read = map_batches(points.select("row_id", "item_id", "text"), run, schema)
    first = F.min(F.struct("item_id", "row_id"))
    texts = cut_lineage(
        read.groupBy(own_columns).agg(first.alias("first")).select(F.col("first.row_id").alias("node"), F.col("first.item_id").alias("first_id"), "fingerprint", "size", "marks", "bands")
    )
    # Texts of one fingerprint hang on its first; a link between fingerprints is one between their firsts.
    prints = texts.groupBy("fingerprint").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    same = spread_join(texts.select("node", "fingerprint"), prints.where("n > 1").select("fingerprint", "head"), ["fingerprint"], "node")
    heads = prints.select("fingerprint", "head")
    near = near_links(prints.select("fingerprint"), distance)
    for end in ("a", "b"):
        near = near.join(heads.withColumnRenamed("fingerprint", end), end).drop(end).withColumnRenamed("head", f"{end}_node")
    met = same.select("node", "head").union(near.select("a_node", "b_node")).toDF("a", "b").union(band_links(texts, similarity))
    roots = cut_lineage(connected(met))
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    crowds = spread_join(roots, sizes, ["root"], "node")

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["node", "root", "blocks", "shingles"])

    wanted = crowds.join(points.select(F.col("row_id").alias("node"), "text"), "node").select("node", "root", "blocks", "text")
    dealt = _dealt(wanted.mapInArrow(read_sets, "node bigint, root bigint, blocks int, shingles binary"), "root", "shingles")

    def tiles(table: pa.Table) -> pa.Table:
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        sets = [np.frombuffer(s, "<u8") for s in table["shingles"].to_pylist()]
        return _link_table(_similar_links(table["node"].to_numpy(), sets, np.flatnonzero(own == i), np.flatnonzero(own == j), similarity))

    classes = connected(dealt.groupBy("root", "i", "j").applyInArrow(tiles, "a bigint, b bigint"))
    named = texts.join(classes, "node", "left").select(F.coalesce("root", "node").alias("class"), F.struct("first_id", "node").alias("first"))
    return named.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.node").alias("row_id"))
