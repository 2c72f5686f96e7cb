"""The k most similar vectors of every vector, by NN-descent.

1. Start. Every vector gets, in each of TABLES tables, the bucket of a random
   cross-polytope hash, and the signs of the turned coordinates as a sketch.
   Within a bucket rows are compared by sketch alone; each row keeps its few
   likeliest partners. Vectors without a likely partner leave here, before any
   vector was moved.
2. Place. The rows of a connected part of that rough graph get one block, so
   that the pairs proposed below find their vectors in one place. A part with
   more than PLACE rows is dealt to several blocks; a pair across blocks takes
   one of its vectors along. Blocks only say where a pair is compared, never
   which pairs are.
3. Descend. Every row holds a list of its WIDE best others. Round by round the
   graph is joined with itself: every row hears of the neighbours of its
   neighbours, and of REVERSE rows, drawn anew in each round, that hold those in
   their own lists. They are compared and kept where they are better, until only
   REST of the lists' rows are new.
4. Lists are compared once more with the whole vectors (the rounds compare
   vectors of two bytes a coordinate), and the k best remain.

Of more than WIDE equal vectors only the first few of the first groups take
part; the others' most similar vectors are exactly those.

Only neighbours with a cosine of at least `least` are found; the hashes are made
for angles of that size. The search is approximate in its start and its end:
tests measure the recall against brute force.

A bucket that holds a large part of all rows is dealt to blocks by a hash that
differs for each table, with its smallest row in all of them (its size is
estimated from one row in SIXTEENTH of the ids, which steers the split and drops
nothing); what the blocks part, the descent joins again.

Defined cases: unusable vectors and null keys have no neighbours; of several
rows with one key the latest usable one counts; ties go to the smaller key; rows
of one group are never each other's neighbours; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrille.llm.components import components
from quadrille.llm.vectors import WIDTH, matrix, rotation
from quadrille.session import cut, forget, parallelism

#: Tables of buckets, turned coordinates of a hash, which are also the bits of a sketch, and the differing bits that two alike rows may show.
TABLES, TURNED, DIFFER = 6, 128, 28
#: Likeliest partners that a row keeps from a bucket; rows of a bucket compared at once; share of ids that the salts are estimated from.
PARTNERS, BUCKET, SIXTEENTH = 6, 2048, 16
#: Rows of a list in the descent and equal vectors beyond which only the first ones take part; reverse neighbours of a round; share of new rows that ends it.
WIDE, REVERSE, REST = 12, 12, 0.001
#: Rows of a block, and of the blocks that one task holds; rows of a vector table that are turned into a matrix at once.
PLACE, HELD, SLICE = 8192, 50_000, 1024
#: Rows that a search keeps for each query.
SEARCH = 16
#: What a cosine may lose by two bytes for a coordinate.
LOSS = 0.001
#: Most bits of the filter that keeps vectors without partners from being moved. Beyond its room it lets more through.
FILTER_BITS = 1 << 28


WORDS = TURNED // 64
_WORDS = [f"s{w}" for w in range(WORDS)]
_BUCKETS = [f"b{t}" for t in range(TABLES)]
_SKETCHES = [f"s{t}_{w}" for t in range(TABLES) for w in range(WORDS)]


def _turns() -> list[tuple[np.ndarray, np.ndarray]]:
    return [(rotation(2 * t + 1, WIDTH, TURNED), rotation(2 * t + 2, WIDTH, TURNED)) for t in range(TABLES)]


def _corner(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis."""
    a = np.abs(y).argmax(axis=1)
    return a * 2 + (y[np.arange(len(y)), a] > 0)


def _buckets(x: np.ndarray, turns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x TABLES bucket numbers, rows x TABLES * WORDS words of sketch)."""
    sketch, out = np.empty((len(x), len(turns) * WORDS), np.int64), np.empty((len(x), len(turns)), np.int32)
    for t, (r, s) in enumerate(turns):
        y, z = x @ r, x @ s
        sketch[:, t * WORDS : (t + 1) * WORDS] = np.packbits(y > 0, axis=1).view(np.int64)
        out[:, t] = (t * 2 * TURNED + _corner(y)) * 2 * TURNED + _corner(z)
    return out, sketch


def _hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each vector; equal ones have the same."""
    return np.array([xxhash.xxh64_intdigest(r) for r in np.ascontiguousarray(x + np.float32(0))], np.uint64).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows with a usable vector, their unit vectors), at most SLICE at a time, whatever the size of the batches."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back at once
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            places, x = matrix(part.column(column))
            if len(x):
                yield part.take(pa.array(places)), x


def coded(rows: DataFrame) -> DataFrame:
    """(id, v, b0 to b5, s0_0 to s5_1): every usable row with a hash of its vector, and its bucket and sketch in each table. rows: id, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _turns()
        for part, x in _slices(batches, 1):
            buckets, sketch = _buckets(x, turns)
            columns = [part.column(0), pa.array(_hashes(x)), *(pa.array(np.ascontiguousarray(c)) for c in buckets.T), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", *_BUCKETS, *_SKETCHES])

    return rows.mapInArrow(run, ", ".join(["id bigint, v bigint", *(f"{b} int" for b in _BUCKETS), *(f"{w} bigint" for w in _SKETCHES)]))


def _by_table(codes: DataFrame) -> DataFrame:
    """(id, bucket, s0, s1): a row for each of the tables."""
    tables = [F.struct(F.col(_BUCKETS[t]).alias("bucket"), *[F.col(f"s{t}_{w}").alias(f"s{w}") for w in range(WORDS)]) for t in range(TABLES)]
    return codes.select("id", F.inline(F.array(*tables)))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; the last axis holds the words."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int16)


def _best(owner: np.ndarray, other: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PARTNERS nearest others of each owner, and its smallest."""
    order = np.lexsort((other, h, owner))
    owner, other = owner[order], other[order]
    start = np.concatenate([[True], owner[1:] != owner[:-1]])
    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0))
    keep = rank < PARTNERS
    first = np.nonzero(start)[0]
    return np.concatenate([owner[keep], owner[first]]), np.concatenate([other[keep], np.minimum.reduceat(other, first)])


def likely(bucket: np.ndarray, ids: np.ndarray, sketch: np.ndarray, chunk: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """(row, likely partner) within the buckets; runs of one bucket longer than chunk are compared in chunks that share a row."""
    order = np.lexsort((ids, bucket))
    bucket, ids, sketch = bucket[order], ids[order], sketch[order]
    n = len(ids)
    starts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [n]]) if n else np.array([0])
    sizes = np.diff(starts)
    for_small = np.repeat(sizes <= 64, sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(n) - 1  # rows of the run that follow a row
    a_out, b_out = [], []
    pa_, pb, ph = [], [], []
    for d in range(1, 64):
        i = np.nonzero(for_small & (left >= d))[0]
        if not len(i):
            break
        h = _differing(sketch[i], sketch[i + d])
        ok = (h <= DIFFER) & (ids[i] != ids[i + d])
        i, h = i[ok], h[ok]
        pa_.append(i), pb.append(i + d), ph.append(h)
    if pa_ and sum(map(len, pa_)):
        i, j, h = np.concatenate(pa_), np.concatenate(pb), np.concatenate(ph)
        a, b = _best(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([h, h]))
        a_out.append(ids[a]), b_out.append(ids[b])
    for s, m in zip(starts[:-1][sizes > 64], sizes[sizes > 64]):
        for at in range(s, s + m, chunk):
            lo, hi = max(s, at - 1), min(at + chunk, s + m)
            for x in range(lo, hi, 256):
                y = min(x + 256, hi)
                h = _differing(sketch[x:y, None], sketch[None, lo:hi])
                ok = (h <= DIFFER) & (ids[x:y, None] != ids[None, lo:hi])
                i, j = np.nonzero(ok)
                if len(i):
                    a, b = _best(i + x, j + lo, h[i, j])
                    a_out.append(ids[a]), b_out.append(ids[b])
    if not a_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def partners(codes: DataFrame) -> DataFrame:
    """(a, b): the rough graph. codes: what coded() gives, as a table."""
    spark = codes.sparkSession
    rows = codes.count() * TABLES
    placed = _by_table(codes)
    sampled = _by_table(codes.where(F.pmod("id", F.lit(SIXTEENTH)) == 0)).groupBy("bucket").count()
    hot = cut(sampled.where(F.col("count") * SIXTEENTH > 4 * BUCKET).select("bucket", F.ceil(F.col("count") * SIXTEENTH / BUCKET).alias("salts")))
    tasks = max(parallelism(spark), rows // 500_000 + 1)
    if hot.isEmpty():
        dealt = placed.select(F.col("bucket").cast("bigint").alias("bucket"), "id", *_WORDS)
    else:
        # The bucket, and with it the table, is part of the hash: rows parted in one table meet in another.
        salted = placed.join(hot, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("id", "bucket"), F.coalesce("salts", F.lit(1)).cast("long")))
        # The smallest row of a hot bucket goes to all its salts, so that rows like it stay connected however they were dealt.
        common = placed.join(hot, "bucket").groupBy("bucket").agg(F.min(F.struct("id", *_WORDS)).alias("r"), F.max("salts").alias("salts"))
        common = common.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "r.*")
        dealt = salted.select("bucket", "salt", "id", *_WORDS).unionByName(common)
        dealt = dealt.select((F.col("salt") * F.lit(TABLES * 4 * TURNED * TURNED) + F.col("bucket")).alias("bucket"), "id", *_WORDS)
    dealt = dealt.repartition(tasks, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        a, b = likely(t.column(0).to_numpy(), t.column(1).to_numpy(), np.stack([t.column(2 + w).to_numpy() for w in range(WORDS)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _passing(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the nodes' hashes, of a size bounded by FILTER_BITS, put together by an aggregate over its words."""
    bits = 1 << 12
    want = nodes.count() * 12
    while bits < want and bits < FILTER_BITS:
        bits <<= 1
    at = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = nodes.select(at.alias("at")).select(F.expr("shiftright(at, 6)").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    t = words.toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[t["w"].to_numpy()] = t["b"].to_numpy()
    return out


def _binary(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _candidates(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (id, key, grp, late, vec, code) that the bitmap lets through: unit vectors, whole and in two bytes a coordinate."""
    passing = rows.sparkSession.sparkContext.broadcast(_passing(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = passing.value

        def kept() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(5).to_numpy(zero_copy_only=False) % (len(bitmap) << 6)
                keep = (bitmap[at >> 6] >> (at & 63)) & 1 == 1
                if keep.any():
                    yield b.filter(pa.array(keep))

        for part, x in _slices(kept(), 4):
            code = np.rint(x * (32_767 / np.abs(x).max(axis=1))[:, None]).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), _binary(x), _binary(code)], names=["id", "key", "grp", "late", "vec", "code"])

    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id bigint, key string, grp string, late string, vec binary, code binary")


def _top(owner: np.ndarray, other: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best others of each owner."""
    order = np.lexsort((other, -c, owner))
    sorted_owner = owner[order]
    start = np.concatenate([[True], sorted_owner[1:] != sorted_owner[:-1]]) if len(order) else np.empty(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


_PAIR = "u bigint, bu bigint, w bigint, bw bigint, c double"


def _compared(pairs: DataFrame, nodes: DataFrame, parted: bool, n_nodes: int, column: str, least: float, k: int) -> DataFrame:
    """(u, bu, w, bw, c): the proposed pairs (u, bu, w, bw) of different groups at least `least` alike, each row with its k best, in both directions.

    A pair is compared in the block of u, where all of that block's vectors are;
    only a pair across blocks brings w's vector along.
    """
    kind = np.int16 if column == "code" else np.float32
    width = WIDTH * np.dtype(kind).itemsize
    own = nodes.select("block", F.col("id").alias("u"), F.lit(None).cast("bigint").alias("bu"), F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("bigint").alias("bw"), "g", F.col(column).alias("x"))
    asked = pairs.select(F.col("bu").alias("block"), "u", "bu", "w", "bw")
    none = [F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("binary").alias("x")]
    sent = asked.where("bu = bw").select("*", *none) if parted else asked.select("*", *none)
    if parted:
        far = asked.where("bu <> bw").join(nodes.select(F.col("id").alias("w"), "g", F.col(column).alias("x")), "w")
        sent = sent.unionByName(far)
    tasks = max(parallelism(nodes.sparkSession), n_nodes // HELD + 1)
    together = own.unionByName(sent).repartition(tasks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        ids, groups, rows, asks, far = [], [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(3).is_null()
            n = b.filter(node)
            if n.num_rows:
                ids.append(n.column(1).to_numpy()), groups.append(n.column(5).to_numpy())
                rows.append(np.frombuffer(b"".join(n.column(6).to_pylist()), kind).reshape(-1, WIDTH))
            p = b.filter(pa.compute.invert(node))
            if p.num_rows:
                brought = p.column(6).is_valid()
                near, other = p.filter(pa.compute.invert(brought)), p.filter(brought)
                if near.num_rows:
                    asks.append(np.stack([near.column(i).to_numpy() for i in range(1, 5)], axis=1))
                if other.num_rows:
                    far.append((np.stack([other.column(i).to_numpy() for i in range(1, 6)], axis=1), np.frombuffer(b"".join(other.column(6).to_pylist()), kind).reshape(-1, width // np.dtype(kind).itemsize)))
        if not ids or not (asks or far):
            return
        ids, groups, x = np.concatenate(ids), np.concatenate(groups), np.concatenate(rows)
        order = np.argsort(ids, kind="stable")
        ids, groups, x = ids[order], groups[order], x[order]
        size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        out = []

        def compare(u: np.ndarray, w: np.ndarray, y: np.ndarray, other_size: np.ndarray, gw: np.ndarray, at_w: np.ndarray | None, ask: np.ndarray) -> None:
            for s in range(0, len(u), 16_384):
                e = s + 16_384
                a = x[u[s:e]].astype(np.float64 if kind is np.float32 else np.float32)
                b = (y[at_w[s:e]] if at_w is not None else y[s:e]).astype(a.dtype)
                c = np.einsum("ij,ij->i", a, b).astype(np.float64) / (size[u[s:e]] * other_size[s:e])
                ok = (c >= least) & (groups[u[s:e]] != gw[s:e])
                out.append((ask[s:e][ok], c[ok]))

        if asks:
            ask = np.concatenate(asks)
            iu, iw = np.searchsorted(ids, ask[:, 0]), np.searchsorted(ids, ask[:, 2])
            # Ids of the rough graph that turned out to have no usable row are not among the nodes.
            good = (iu < len(ids)) & (iw < len(ids))
            good[good] = (ids[iu[good]] == ask[good, 0]) & (ids[iw[good]] == ask[good, 2])
            ask, iu, iw = ask[good], iu[good], iw[good]
            _, one = np.unique(iu * np.int64(len(ids)) + iw, return_index=True)
            ask, iu, iw = ask[one], iu[one], iw[one]
            compare(iu, iw, x, size[iw], groups[iw], iw, ask)
        for ask, y in far:
            iu = np.searchsorted(ids, ask[:, 0])
            good = iu < len(ids)
            good[good] = ids[iu[good]] == ask[good, 0]
            y, ask, iu = y[good], ask[good], iu[good]
            compare(iu, iu, y, np.sqrt(np.einsum("ij,ij->i", y, y, dtype=np.float64)), ask[:, 4], None, ask[:, :4])
        pair, c = np.concatenate([o[0][:, :4] for o in out]), np.concatenate([o[1] for o in out])
        both, c = np.concatenate([pair, pair[:, [2, 3, 0, 1]]]), np.concatenate([c, c])
        keep = _top(both[:, 0], both[:, 2], c, k)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(both[keep, i])) for i in range(4)), pa.array(c[keep])], names=["u", "bu", "w", "bw", "c"])

    return together.mapInArrow(run, _PAIR)


def _descend(rough: DataFrame, nodes: DataFrame, parted: bool, n_nodes: int, least: float) -> DataFrame:
    """Lists (u, bu, w, bw, c) of the WIDE best others. rough: (u, bu, w, bw)."""
    tasks = parallelism(nodes.sparkSession)

    def shortened(df: DataFrame) -> DataFrame:
        # One shuffle by u serves both steps.
        one = df.repartition(tasks, "u").groupBy("u", "bu", "w", "bw").agg(F.max("c").alias("c"), F.min("fresh").alias("fresh"))
        return one.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "w"))).where(F.col("place") <= WIDE).drop("place")

    lists = cut(shortened(_compared(rough, nodes, parted, n_nodes, "code", least, WIDE).withColumn("fresh", F.lit(True))))
    turn = 0
    while True:
        total, fresh = lists.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= REST * total:
            return lists.drop("fresh")
        turn += 1
        turned = lists.select(F.col("w").alias("u"), F.col("bw").alias("bu"), F.col("u").alias("w"), F.col("bu").alias("bw"), "c", "fresh")
        drawn = Window.partitionBy("u").orderBy(F.xxhash64("u", "w", F.lit(turn)))
        turned = turned.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= REVERSE).drop("place")
        # Every row asks the rows of its list for their lists and for some of the rows that list them; at least one of the two steps must be new.
        step = lists.select("u", "bu", F.col("w").alias("v"), F.col("fresh").alias("f"))
        near = lists.unionByName(turned).select(F.col("u").alias("v"), "w", "bw", F.col("fresh").alias("g"))
        met = step.join(near, "v").where("u <> w and (f or g)")
        met = met.select(*[F.when(F.col("u") < F.col("w"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("u", "w"), ("bu", "bw"), ("w", "u"), ("bw", "bu"))])
        new = _compared(met, nodes, parted, n_nodes, "code", least, WIDE).withColumn("fresh", F.lit(True))
        after = cut(shortened(lists.withColumn("fresh", F.lit(False)).unionByName(new)))
        forget(lists)
        lists = after


def _copies(src: DataFrame, codes: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """(codes without all but the first of very many equal vectors, (key, other, cosine) of all of those), or None where there are none."""
    often = cut(codes.groupBy("v").count().where(F.col("count") > WIDE).select("v"))
    if often.isEmpty():
        return None
    ids = codes.join(often, "v", "left_semi").select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, 4):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(_hashes(x))], names=["id", "key", "grp", "late", "v"])

    marked = src.mapInArrow(run, "id bigint, key string, grp string, late string, v bigint").join(ids, "id", "left_semi")
    once = marked.groupBy("id", "key").agg(F.max(F.struct("late", "grp", "v")).alias("r")).select("id", "key", "r.grp", "r.v")
    once = cut(once.join(often, "v", "left_semi"))
    counted = once.groupBy("v").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups")).where((F.col("n") > WIDE) & (F.col("groups") > k))
    counted = cut(counted.select("v", F.ceil(F.col("n") / HELD).alias("salts")))
    many = once.join(counted, "v")
    firsts = many.withColumn("in_group", F.row_number().over(Window.partitionBy("v", "grp").orderBy("key"))).where(F.col("in_group") <= k)
    # The first k + 1 groups hold the k smallest keys of other groups for a row of any group.
    heads = firsts.groupBy("v", "grp").agg(F.min("key").alias("first"))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("first"))).where(F.col("place") <= k + 1)
    chosen = cut(firsts.join(heads.select("v", "grp"), ["v", "grp"]).select("v", "salts", "id", "key", "grp"))
    offered = chosen.select("v", F.col("key").alias("other"), F.col("grp").alias("other_grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    met = many.withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).join(offered, ["v", "salt"]).where("grp <> other_grp")
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("other"))).where(F.col("place") <= k)
    gone = many.select("id").join(chosen.select("id"), "id", "left_anti")
    return codes.join(gone, "id", "left_anti"), best.select("key", "other", F.lit(1.0).alias("cosine"))


def nearest(rows: DataFrame, key: Column, grp: Column, vec: Column, late: Column, k: int = 3, least: float = 0.90) -> DataFrame:
    """(key, other, cosine): up to k most similar vectors, of other groups and at least `least` alike, of every vector. k is at most WIDE."""
    if not 0 < k <= WIDE:
        raise ValueError(f"k must be from 1 to {WIDE}")
    src = rows.select(key.cast("string").alias("key"), grp.cast("string").alias("grp"), late.cast("string").alias("late"), vec.cast("array<float>").alias("vec")).where("key is not null and grp is not null")
    src = src.select(F.xxhash64("key").alias("id"), "key", "grp", "late", "vec")
    codes = cut(coded(src.select("id", "vec")))
    parts = _copies(src, codes, k)
    if parts is not None:
        kept = cut(parts[0])
        forget(codes)
        codes = kept
    rough = cut(partners(codes))
    forget(codes)
    pivots = components(rough)

    sizes = pivots.groupBy("component").count().where(F.col("count") > PLACE).select("component", F.ceil(F.col("count") / PLACE).alias("salts"))
    sizes = cut(sizes)
    parted = not sizes.isEmpty()
    block = F.col("component")
    if parted:
        pivots = pivots.join(sizes, "component", "left")
        block = F.when(F.col("salts").isNull(), block).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), "salts")))
    placed = cut(pivots.select(F.col("node").alias("id"), block.alias("block")))
    last = Window.partitionBy("id", "key").orderBy(F.col("late").desc_nulls_last(), F.desc("vec"))
    found = _candidates(src, pivots.select("node")).join(placed, "id").withColumn("place", F.row_number().over(last)).where("place = 1")
    nodes = cut(found.select("block", "id", "key", "grp", F.xxhash64("grp").alias("g"), "vec", "code"))
    n_nodes = nodes.count()

    ends = rough.join(placed.toDF("a", "bu"), "a").join(placed.toDF("b", "bw"), "b").select(F.col("a").alias("u"), "bu", F.col("b").alias("w"), "bw")
    lists = _descend(cut(ends), nodes, parted, n_nodes, least - LOSS)
    forget(rough)
    pairs = lists.select("u", "bu", "w", "bw").union(lists.select("w", "bw", "u", "bu")).toDF("u", "bu", "w", "bw").where("u < w").distinct()
    exact = _compared(pairs, nodes, parted, n_nodes, "vec", least, 2 * WIDE)
    names = nodes.select("id", "key")
    named = exact.join(names.toDF("u", "key"), "u").join(names.toDF("w", "other"), "w").select("key", "other", F.col("c").alias("cosine"))
    if parts is not None:
        named = named.unionByName(parts[1])
    return _shorten(named, k)


def _shorten(lists: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.round("cosine", 12).desc(), "other")
    return lists.dropDuplicates(["key", "other"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = np.stack(a).astype(np.float64), np.stack(b).astype(np.float64)
    return pd.Series(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))


def search(queries: DataFrame, nodes: DataFrame, lists: DataFrame, k: int = 3, least: float = 0.90) -> DataFrame:
    """(key, other, cosine): the k nodes of other groups most similar to each query, by greedy search of the neighbour graph.

    queries and nodes: key, grp, vec, one row a key; lists: (key, other) of the
    graph. A query enters at the likeliest rows of its buckets, then moves along
    edges: the neighbours of the best rows that were not yet visited are
    compared, the best SEARCH stay, until no step brings anything better. Nodes
    outside the graph have no neighbour and are not looked at.
    """
    edges = lists.select("key", "other").unionByName(lists.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()
    edges = cut(edges)
    held = cut(nodes.join(edges.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("other"), F.col("grp").alias("other_grp"), F.col("vec").alias("other_vec")))
    asked = cut(queries.select("key", "grp", "vec"))

    def codes(df: DataFrame, key: str, vec: str, mark: str) -> DataFrame:
        c = _by_table(coded(df.select(F.xxhash64(key).alias("id"), F.col(vec).alias("vec")))).toDF(f"{mark}id", "bucket", *[f"{mark}{w}" for w in _WORDS])
        return c.join(df.select(F.xxhash64(key).alias(f"{mark}id"), F.col(key)), f"{mark}id")

    bits = sum((F.bit_count(F.col(f"q{w}").bitwiseXOR(F.col(f"n{w}"))) for w in _WORDS), F.lit(0))
    met = codes(asked, "key", "vec", "q").join(codes(held, "other", "other_vec", "n"), "bucket").select("key", "other", bits.alias("apart")).where(F.col("apart") <= DIFFER).groupBy("key", "other").agg(F.min("apart").alias("apart"))
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("apart", "other"))).where(F.col("place") <= SEARCH)

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.join(asked, "key").join(held, "other").where("grp <> other_grp").select("key", "other", _cosine("vec", "other_vec").alias("cosine"), F.lit(True).alias("fresh"))

    best = cut(compared(first.select("key", "other")))
    while True:
        steps = best.where("fresh").select("key", F.col("other").alias("at")).join(edges.withColumnRenamed("key", "at"), "at").select("key", "other").distinct()
        new = compared(steps.join(best.select("key", "other"), ["key", "other"], "left_anti"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(new)
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.round("cosine", 12).desc(), "other"))
        after = cut(both.withColumn("place", place).where(F.col("place") <= SEARCH).drop("place"))
        forget(best)
        best = after
        # Every round must better some query's best rows, of which there are finitely many.
        if best.where("fresh").isEmpty():
            break
    top = Window.partitionBy("key").orderBy(F.round("cosine", 12).desc(), "other")
    return best.where(F.col("cosine") >= least).withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).select("key", "other", "cosine")
