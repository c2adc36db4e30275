"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. For each of REGISTERS hash functions the smallest exponentially distributed hash value
of the set is kept as its truncated logarithm to the base GROWTH; registers of a union are the larger ones, so sketches merge, and two
registers are equal about as often as the sets are similar. Bands of registers bring documents together, the similarity of those is
estimated jointly from the registers by likelihood, and what may be similar is confirmed on the full sets.

Documents with equal sets form one class from the start, and only class representatives are compared. In each band's bucket all are compared
with one centre first (the representative that meets the most others). Buckets that these links leave in more than one component are gone
through once more, in blocks of bounded size. There the members of the bucket's largest component are compared only with the rows outside it,
never with each other, so they are repeated for each block of outsiders (mostly one), not for each block of the bucket: the rows that are made
are the bucket's members times its blocks of outsiders. Registers choose the representatives that may be similar to one of another component, and the
full sets of those are compared inside the block, which gives back a spanning tree of the links that it confirms. No link between
different components is lost.

Full sets are built for the two ends of candidate pairs only. Their texts are found by a filter of fixed size that each scan task holds, so the
texts of other documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Hashes, blocks, mix, spans
from .graphs import components
from .runtime import cut, fresh, in_filter, key_filter, maybe_in, prepare, release, skew_lookup

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Base of the register scale and the largest register.
GROWTH, TOP = 1.001, 65535
#: Pairs whose estimated similarity is lower than the threshold by so many standard errors are not confirmed.
ERRORS = 4.5
#: Rows and shingles of a bucket's block; every two blocks of a bucket meet in one group.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 17
#: Register pairs held at a time.
PAIRS_AT_ONCE = 1 << 16

_RNG = np.random.default_rng(4242)
_COEFFICIENT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REGISTER = _RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, sorted distinct 64-bit shingle hashes) by blocks: (first row, one array for each row).

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. Fewer than k words make one shingle; no words, none.
    """
    for a, b, data, offsets in blocks(column):
        if not len(data):
            yield a, [np.empty(0, np.uint64)] * (b - a)
            continue
        starts, ends, rows = spans(data, offsets)
        words = Hashes(data, lower=True).of(starts, ends)
        n = max(0, len(words) - k + 1)
        all_ = np.zeros(n, np.uint64)
        for j in range(k):
            all_ += words[j : j + n] * _COEFFICIENT[j]
        all_ = mix(all_)
        sets = []
        for s, e in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if e - s >= k:
                x = np.sort(all_[s : e - k + 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif e > s:
                sets.append(mix(np.array([(words[s:e] * _COEFFICIENT[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)], np.uint64)))
            else:
                sets.append(np.empty(0, np.uint64))
        yield a, sets


def _node(s: np.ndarray) -> int | None:
    """A hash of a set; None for the empty one."""
    return int((mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)) if len(s) else None


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets (rows of the result). A set's register is the truncated logarithm of its smallest hash value."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    a = 0
    while a < len(sets):  # runs that fit the processor's cache
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= 16384):
            size += len(sets[b])
            b += 1
        x = np.concatenate(sets[a:b])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]])]).astype(np.int64)
        h = np.empty_like(x)
        for i in range(REGISTERS):
            np.multiply(x, _REGISTER[i], out=h)
            out[a:b, i] = np.minimum.reduceat(h, at)
        a = b
    value = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(GROWTH)), 0, TOP).astype(np.uint16)


def estimate(higher: np.ndarray, lower: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Most likely Jaccard similarities given in how many of REGISTERS registers the first sketch is higher or lower, and both sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    j = np.linspace(0, 1, grid)[:, None] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (GROWTH - 1) / GROWTH) / np.log(GROWTH)
    up, down = chance(u - v * j), chance(v - u * j)
    floor = 1e-12
    like = higher * np.log(np.maximum(up, floor)) + lower * np.log(np.maximum(down, floor)) + (REGISTERS - higher - lower) * np.log(np.maximum(1 - up - down, floor))
    return j[like.argmax(axis=0), np.arange(len(u))]


def _likely(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold."""
    fit = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    at = np.flatnonzero(fit)
    least = threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    for a in range(0, len(at), PAIRS_AT_ONCE):
        own = at[a : a + PAIRS_AT_ONCE]
        higher, lower = (reg_a[own] > reg_b[own]).sum(1), (reg_a[own] < reg_b[own]).sum(1)
        some = REGISTERS - higher - lower >= 0.5 * least * REGISTERS
        fit[own[~some]] = False
        own, higher, lower = own[some], higher[some], lower[some]
        fit[own] = estimate(higher, lower, n_a[own].astype(float), n_b[own].astype(float)) >= least
    return fit


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(-1, REGISTERS)


def sketch(docs: DataFrame, k: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, text_hash, n_shingles, node (a hash of the set; null for an empty one), registers (binary; null likewise)."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size, node, regs = [], [], []
            for _, sets in shingle_sets(x.column(1), k):
                size += [len(s) for s in sets]
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                for s in sets:
                    node.append(_node(s))
                    regs.append(next(rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(regs, pa.binary())], [ident, "text_hash", "n_shingles", "node", "registers"])

    return docs.select(ident, text, F.xxhash64(text)).mapInArrow(run, f"`{ident}` {kind}, text_hash long, n_shingles long, node long, registers binary")


def _bands(classes: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(bucket, node) of every band of every class, or of those bands whose bucket a filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            r = _regs(x.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), r.shape[:2]).copy()
            for j in range(ROWS):
                h = mix(h + (r[:, :, j] + np.uint64(1)) * _COEFFICIENT[j])
            h = (h & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)  # the band stays readable
            bucket, node = h.reshape(-1).astype(np.int64), np.repeat(x.column(0).to_numpy(), BANDS)
            if bits is not None:
                some = in_filter(bucket, bits)
                bucket, node = bucket[some], node[some]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], ["bucket", "node"])

    return classes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. b may be the same in very many pairs."""
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for i, (p, q) in enumerate(zip(x.column(2), x.column(3))):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= hundredths * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(keep)), x.column(1).filter(pa.array(keep))], ["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    two = pairs.select("b").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    return skew_lookup(one, two, ["b"], pairs.groupBy("b").agg(F.count("*").alias("_n")), 512).select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _prune(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may reach the threshold by their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yes = pa.array(_likely(_regs(x.column(2)), _regs(x.column(4)), x.column(3).to_numpy(), x.column(5).to_numpy(), threshold))
                yield pa.RecordBatch.from_arrays([x.column(0).filter(yes), x.column(1).filter(yes)], ["a", "b"])

    b = pairs.select("b").distinct()
    few = _sketches(classes, pairs.select(F.col("a").alias("node")).unionByName(b.withColumnRenamed("b", "node")))
    of = lambda c: few.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    return skew_lookup(pairs.join(of("a"), "a"), b.join(of("b"), "b"), ["b"], pairs.groupBy("b").agg(F.count("*").alias("_n")), 512).select("a", "b", "ra", "na", "rb", "nb").mapInArrow(run, "a long, b long")


def _sketches(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, registers, n_shingles) of some nodes and a few others: what a filter lets through, so that joins don't shuffle the sketches of all."""
    return maybe_in(classes.select("node", "registers", "n_shingles"), "node", key_filter(nodes.select("node")))


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    of = lambda x, k: tuple(x.column(c)[k].as_py() for c in range(n_keys))
    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        last = of(x, x.num_rows - 1)
        if of(held[0], 0) == last:
            continue
        t = pa.Table.from_batches(held)
        n = t.num_rows - int(np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in enumerate(last)]).sum())
        yield t.slice(0, n)
        held = t.slice(n).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _edges(t: pa.Table, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.stack([t.column(c).to_numpy() for c in range(n_keys)])
    edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    return edge, np.append(edge[1:], t.num_rows)


def _later(a: int, b: int, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows a to b with the ``each`` rows that follow them."""
    left = np.repeat(np.arange(a, b), each[a:b])
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(each[a:b]) - each[a:b], each[a:b])


def _suspects(t: pa.Table, threshold: float) -> np.ndarray:
    """Rows that their registers bring near a row of another component, in the first band that the two share.

    Columns: bucket, i, j, node, comp, own block, n_shingles, registers."""
    edge, stop = _edges(t, 3)
    regs, n, comp, own = _regs(t.column(7).combine_chunks()), t.column(6).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy()
    within = t.column(1).to_numpy() == t.column(2).to_numpy()
    band = (t.column(0).to_numpy() & 31).astype(np.int64)
    each = np.repeat(stop, stop - edge) - np.arange(t.num_rows) - 1
    reach, a, found = np.cumsum(each), 0, np.zeros(t.num_rows, bool)
    while a < len(each):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + PAIRS_AT_ONCE)))
        left, right = _later(a, b, each)
        apart = (comp[left] != comp[right]) & (within[left] | (own[left] != own[right]))
        left, right = left[apart], right[apart]
        if len(left):
            shared = (regs[left] == regs[right]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[left]
            left, right = left[shared], right[shared]
        if len(left):
            yes = _likely(regs[left], regs[right], n[left], n[right], threshold)
            found[left[yes]] = found[right[yes]] = True
        a = b
    return found


def _tree(comp: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """The components that links, confirmed on full sets, join within one block: a spanning tree of them."""
    hundredths, size = round(threshold * 100), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[which]
    bit, owner = place[which[keep]], owner[keep]
    bits = np.zeros((len(sets), -(-int(shared.sum()) // 64) or 1), np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    home = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while home[c] != c:
            home[c] = c = home[home[c]]
        return c

    out = []
    step = max(1, (1 << 21) // bits.shape[1])
    for i in range(len(sets) - 1):
        own = root(int(comp[i]))
        other = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= hundredths * np.maximum(size[i], size[i + 1 :]))) + i + 1
        for a in range(0, len(other), step):
            some = other[a : a + step]
            both = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in some[100 * both >= hundredths * (size[i] + size[some] - both)].tolist():
                theirs, own = root(int(comp[j])), root(own)
                if theirs != own:
                    home[theirs] = own
                    out.append((int(comp[i]), int(comp[j])))
    return out


def _rest(members: DataFrame, sizes: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, i, j, node, comp): the rows of each block pair that may be similar to one of another component.

    members: (bucket, node, comp) of buckets that hold more than one component; sizes: (bucket, main, _n) with the largest component of each.
    Outsiders have blocks 0, 1, .. and meet all blocks; the rows of the main component have the blocks after those and meet outsiders only.
    """
    rows = skew_lookup(members, sizes.select("bucket", "main"), ["bucket"], sizes)
    rows = rows.join(_sketches(classes, rows), "node")
    rows = rows.withColumn("out", F.col("comp") != F.col("main"))
    blocks_of = lambda own: F.greatest(F.lit(1), F.ceil(F.count_if(own) / BLOCK_ROWS), F.ceil(F.sum(F.when(own, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int")
    blocked = cut(rows.groupBy("bucket").agg(blocks_of(F.col("out")).alias("outer"), blocks_of(~F.col("out")).alias("inner"), F.count("*").alias("_n")))
    rows = skew_lookup(rows, blocked.drop("_n"), ["bucket"], blocked)
    at = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    rows = rows.withColumn("_own", F.when(F.col("out"), at).otherwise(F.col("outer") + at))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1))
    rows = rows.select("*", other.alias("_other")).select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "comp", "_own", "n_shingles", "registers")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            t = t.combine_chunks()
            yes = t.filter(pa.array(_suspects(t, threshold)))
            yield from yes.select(["bucket", "i", "j", "node", "comp"]).combine_chunks().to_batches()

    return rows.mapInArrow(suspects, "bucket long, i int, j int, node long, comp long")


def _trees(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Different components (a, b) that confirmed links of a block pair join."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            t = t.combine_chunks()
            comp, raw, found = t.column(3).to_numpy(), t.column(4).combine_chunks(), []
            for a, b in zip(*_edges(t, 3)):
                found += _tree(comp[a:b], [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(a, b)], threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    full = near.join(sets, "node").select("bucket", "i", "j", "comp", "shingles")
    return full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "comp").mapInArrow(trees, "a long, b long").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, ident: str, text: str) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, key): the text of each class's representative is found by its key.

    Only the sets of rows that a filter of fixed size lets through are built and shuffled; with so many keys that it lets all through, those are the
    sets of all rows, once. A key that several rows share is no harm: the set must be the node's.
    """
    bits = key_filter(wanted.select("key"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = x.filter(pa.array(in_filter(x.column(0).to_numpy(), bits)))
            for a, sets in shingle_sets(x.column(1), k):
                keep = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array([a + i for i in keep], pa.int64())), pa.array([_node(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["key", "node", "shingles"])

    found = docs.select(_key(F.col(ident), F.xxhash64(text)), F.col(text)).mapInArrow(sets_of, "key long, node long, shingles binary")
    return found.withColumnRenamed("key", "own").join(wanted, "node").where("own = key").select("node", "shingles").dropDuplicates(["node"])


def _key(ident: Column, text_hash: Column) -> Column:
    return F.xxhash64(ident, text_hash)


def link(docs: DataFrame, k: int = 5, threshold: float = 0.8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ident, n_shingles, component_id, kept.

    Documents whose sets have 100 * intersection >= 100 * threshold * union are linked; component_id is the smallest ident that links lead to,
    and kept tells whether it is the row's own. A document without words is linked with nothing, so it is its own component. Null idents are
    linked by their text as others are, and never give a component its id unless all of it are null. Rows that share an ident are judged each by
    their own text. Other columns are ignored; an empty table gives no rows.
    """
    own = fresh("text_hash", docs.select(ident))
    sketched = cut(sketch(docs, k, ident, text).withColumnRenamed("text_hash", own))
    full = sketched.where("node is not null")
    first = F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("i"), F.col(own).alias("h"), "registers", "n_shingles"))
    classes = cut(full.groupBy("node").agg(first.alias("x"), F.count("*").alias("copies")).select("node", F.col("x.i").alias("rep"), _key(F.col("x.i"), F.col("x.h")).alias("key"), "x.registers", "x.n_shingles", "copies"))
    crowd = cut(_bands(classes).groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    shared = _bands(classes, key_filter(crowd.select("bucket")))
    members = cut(skew_lookup(shared, crowd.select("bucket", F.col("_n").alias("size")), ["bucket"], crowd))  # bucket, node, size
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = members.join(meets, "node")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("node").cast("decimal(20,0)")).alias("low"), "node")).alias("c")).select("bucket", F.col("c.node").alias("b"))
    pairs = cut(skew_lookup(members.select("bucket", F.col("node").alias("a")), centre, ["bucket"], crowd).where("a <> b").select("a", "b").distinct())
    star = cut(_prune(pairs, classes, threshold))
    release(pairs, crowd)

    ends = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    wanted = cut(ends.join(classes.select("node", "key"), "node"))
    sets = cut(_full_sets(docs, wanted, k, ident, text))
    links = cut(_confirm(star, sets, threshold))
    release(star, wanted)
    comp = components(links)
    placed = cut(members.drop("size").join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp")))
    release(members)
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = cut(parts.groupBy("bucket").agg(F.sum("n").alias("_n"), F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "_n", F.col("m.comp").alias("main")))
    if not mixed.isEmpty():
        near = cut(_rest(placed, mixed, classes, threshold))
        wanted = cut(near.select("node").distinct().join(sets, "node", "left_anti").join(classes.select("node", "key"), "node"))
        others = cut(_full_sets(docs, wanted, k, ident, text))
        asked = maybe_in(sets, "node", key_filter(near.select("node"))).unionByName(others)
        more = cut(_trees(near, asked, threshold))
        release(near, wanted, others)
        if not more.isEmpty():  # the second round of components is one over those of the first, alone nodes included
            onto = components(more).select(F.col("node").alias("old"), F.col("component").alias("onto"))
            alone = onto.join(comp, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("onto").alias("component"))
            comp = comp.join(onto, F.col("component") == F.col("old"), "left").select("node", F.coalesce("onto", "component").alias("component")).unionByName(alone)
    release(placed, mixed, sets)
    home = classes.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("comp"), "copies")
    lowest = home.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = home.join(lowest, "comp").select("node", "component_id")
    found = skew_lookup(full.select(ident, "n_shingles", "node"), named, ["node"], classes.select("node", F.col("copies").alias("_n"))).select(ident, "n_shingles", "component_id")
    alone = sketched.where("node is null").select(ident, "n_shingles", F.col(ident).alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))
