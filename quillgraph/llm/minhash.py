"""SuperMinHash signatures, banding, and the links that banding finds, confirmed on whole sets.

A signature slot takes the smallest value that any element gives it. An element gives its j-th value, a random number
from j to j + 1, to the j-th place of a random permutation of the slots, so one element's values are spread over all
slots; a text is done once no slot can be lowered by later values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.components import connected
from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import mapped, mix, U

_GOLDEN = 0x9E3779B97F4A7C15
_STEP = U(_GOLDEN)
_ELEMENTS = 100_000
#: Elements are ordered by a table of at most 2 ** SKETCH_BITS counts of 4 bytes, whatever the input's size.
SKETCH_BITS = 22
#: So many ids (8 bytes each) are sent to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: 64-bit words of parity bits of each set.
PARITY = 8
#: Pairs of sets that both have so many rare elements at most meet once, others at each one that they share.
MOST_BEFORE = 64


def _step(i: int) -> np.uint64:
    return U(_GOLDEN * i & (2**64 - 1))


def signatures(owner: np.ndarray, elements: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots SuperMinHash values of n texts; owner (ascending) and elements: the distinct 64-bit elements of each. Texts without elements keep the largest value."""
    out = np.full((n, slots), np.iinfo(U).max, U)
    per_text = np.bincount(owner, minlength=n)
    ends = np.cumsum(per_text)
    first = 0
    while first < n:
        base = int(ends[first - 1]) if first else 0
        last = min(max(int(np.searchsorted(ends, base + _ELEMENTS, "right")), first + 1), n)
        _signatures(owner[base : ends[last - 1]] - first, elements[base : ends[last - 1]], out[first:last])
        first = last
    return out


def _signatures(owner: np.ndarray, elements: np.ndarray, out: np.ndarray) -> None:
    n, slots = out.shape
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(owner), 1))
    flat = out.reshape(-1)
    active = np.arange(len(owner))
    for j in range(slots):
        open_ = out.max(axis=1) >= U(j << 56)
        active = active[open_[owner[active]]]
        if not len(active):
            break
        h = elements[active]
        value = mix(h + _step(2 * j + 1)) >> U(8)
        k = j + ((mix(h ^ _step(2 * j + 2)) >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)
        slot = order[active, k]
        order[active, k] = order[active, j]
        np.minimum.at(flat, owner[active] * slots + slot, value | U(j << 56))


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many slots; equal bands of two texts have equal keys."""
    n, slots = signature.shape
    bands = signature.reshape(n, slots // rows, rows)
    key = np.broadcast_to(np.arange(slots // rows, dtype=U), (n, slots // rows)).copy()
    for i in range(rows):
        key = mix(key * _STEP + bands[:, :, i])
    return key.view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(values.reshape(-1), pa.int64()))


def binaries(owner: np.ndarray, elements: np.ndarray, n: int) -> pa.Array:
    """The elements of each of n texts, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64) * 8
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(elements).tobytes())]).cast(pa.binary())


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _slots(bits: int):
    """How often each slot (the low bits of an element) occurs in the sets of a batch."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), U) for x in batch.column("elements")]
            slot, n = np.unique(np.concatenate(found) & U((1 << bits) - 1) if found else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return run


def _parity(x: np.ndarray) -> np.ndarray:
    """512 bits, each telling whether an odd number of elements falls on it. Every bit by which two sets differ stands for an element that only one of them has."""
    odd = np.bincount((x >> U(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_PARITIES = [f"p{i}" for i in range(PARITY)]


def _prefixes(counts, bits: int, num: int, den: int):
    """The rarest elements of each set, as many as two sets must share one of to be linked, with their places in the order of rarity, the rarer ones before them (unless there are many), and the set's parity bits."""

    def run(batches):
        often = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                element, place, size, parity, before = [], [], [], [], []
                for x in part.column("elements"):
                    x = np.frombuffer(x.as_buffer(), U)
                    n = len(x) - -(-num * len(x) // den) + 1
                    element.append(x[np.lexsort((x, often[(x & U((1 << bits) - 1)).astype(np.int64)]))[:n]])
                    place.append(np.arange(n))
                    size.append(np.full(n, len(x)))
                    parity.append(np.repeat(_parity(x)[None], n, axis=0))
                    rare = element[-1].view(np.int64)
                    before += [rare[:i] for i in range(n)] if n <= MOST_BEFORE else [rare[:0]] * n
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in element]))
                flat = [np.concatenate(c) if c else np.zeros(0) for c in (element, place, size)]
                bits_ = np.concatenate([*parity, np.zeros((0, PARITY), np.int64)])
                ends = np.concatenate([[0], np.cumsum([len(b) for b in before])]).astype(np.int32)
                known = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*before, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column("id").take(row), part.column("part").take(row), pa.array(flat[0].astype(U).view(np.int64)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), *[pa.array(bits_[:, i]) for i in range(PARITY)], known], names=["id", "part", "element", "place", "size", *_PARITIES, "before"])

    return run


def _prefix_pairs(scratch: Scratch, sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets (id, part, elements) -> pairs (a, b) of different parts, among them all that can be linked.

    Linked sets x and y share at least o = num / (num + den) of |x| + |y| elements, so in any common order the first
    |x| - o + 1 of x and the first |y| - o + 1 of y have one in common. The order is by how often an element's slot
    occurs, rare ones first: what a large group has in common comes last. Of an element most of whose sets lie in one
    part, only the other sets are compared with all: nothing is paired within a part. Of |x| + |y| elements, those that
    only one set has are at least as many as the parity bits that differ, which bounds what the sets can share.
    """
    spark = sets.sparkSession
    total = max(sets.agg(F.sum(F.length("elements"))).first()[0] or 0, 8) // 8
    bits = min(max(int(total).bit_length(), 12), SKETCH_BITS)
    often = np.zeros(1 << bits, np.int64)
    for batch in sets.select("elements").transform(mapped, _slots(bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow().to_batches():
        often[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(often, np.iinfo(np.uint32).max).astype(np.uint32))
    rows = scratch.table(sets.transform(mapped, _prefixes(shared, bits, num, den), "id long, part long, element long, place int, size int, " + ", ".join(f"{p} long" for p in _PARITIES) + ", before array<long>"))
    common = rows.groupBy("element", "part").count().groupBy("element").agg(F.max(F.struct("count", "part")).alias("m"), F.count("*").alias("parts"))
    common = scratch.table(common.where("parts > 1").select("element", F.col("m.part").alias("main")))
    rows = scratch.table(rows.join(common, "element"))
    x = rows.where("part <> main").select("element", *[F.col(c).alias(f"x_{c}") for c in ("id", "part", "place", "size", "before", *_PARITIES)])
    o = F.ceil((F.col("size") + F.col("x_size")) * num / (num + den))
    fits = (F.col("place") <= F.col("size") - o) & (F.col("x_place") <= F.col("x_size") - o) & (F.least("size", "x_size") * den >= F.greatest("size", "x_size") * num)
    reach = F.least("place", "x_place") + F.least(F.col("size") - F.col("place"), F.col("x_size") - F.col("x_place")) >= o
    apart = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"x_{p}"))) for p in _PARITIES])
    fits &= F.col("size") + F.col("x_size") - apart >= 2 * o
    reach &= ~F.arrays_overlap("before", "x_before")  # else they have met at a rarer element
    met = x.join(rows, "element").where((F.col("part") != F.col("x_part")) & ((F.col("part") == F.col("main")) | (F.col("x_id") < F.col("id"))) & fits & reach)
    return met.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def links(scratch: Scratch, entries: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """entries (id, n, key) -> confirmed links (a, b), and the components (node, root) that they make.

    n: the size of an id's set; key: one of its band keys; rows may repeat. sets_of(ids) gives (id, elements): sorted 64-bit
    elements as bytes. Two ids of a common key are linked if shared / union of their sets is num / den or more. A bucket
    (the ids of a key) is never crossed with itself: first each id is compared with one, the one that is the smallest in
    most of its buckets and so the likeliest to be linked.
    Buckets that lie within one component are done then. In the others, ids are compared with their bucket's smallest,
    where that is in another component; and in those that still lie in several components, sets of different ones are
    compared if they share one of their rarest elements, which linked sets always do. So no link between components is lost, and a group of
    near-copies costs one comparison each, not one a pair.
    """
    crowded = entries.groupBy("key").agg(F.min("id").alias("p"), F.min_by("n", "id").alias("p_n"), F.max("id").alias("high")).where("p < high")
    crowded = scratch.table(crowded.select("key", "p", "p_n"))
    members = scratch.table(entries.join(crowded, "key").distinct())
    sets = scratch.table(sets_of(members.select("id").distinct()))
    near = F.least("n", "p_n") * den >= F.greatest("n", "p_n") * num  # else the sizes alone rule the link out
    pairs = members.where(near & (F.col("id") != F.col("p"))).select(F.col("p").alias("a"), F.col("id").alias("b"), "key")
    first = scratch.table(pairs.groupBy("b").agg(F.mode("a", True).alias("a")).select("a", "b"))
    linked = _confirmed(scratch, first, sets, num, den)
    roots, split = _apart(scratch, members, linked)
    if split.isEmpty():
        return linked, roots
    part = lambda c, name: (roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left")
    second = pairs.join(split, "key").join(*part("a", "x")).join(*part("b", "y")).where(F.coalesce("x", "a") != F.coalesce("y", "b"))
    second = scratch.table(second.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    linked = linked.unionAll(_confirmed(scratch, second, sets, num, den))
    roots, split = _apart(scratch, members, linked)
    if split.isEmpty():
        return linked, roots
    left = members.join(split, "key").select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("part"))
    more = _prefix_pairs(scratch, scratch.table(sets.join(left, "id")), num, den)
    linked = linked.unionAll(_confirmed(scratch, scratch.table(more), sets, num, den))
    roots = connected(scratch, linked)
    for used in (crowded, members, sets, first, second):
        scratch.drop(used)
    return linked, roots


def _apart(scratch: Scratch, members: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links, and the keys whose buckets lie in more than one."""
    roots = connected(scratch, linked)
    named = members.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", F.coalesce("root", "id").alias("part"))
    return roots, scratch.table(named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key"))


def _confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    found = met.select("a", "b", "x", "y").transform(mapped, _confirm(num, den), "a long, b long, linked boolean")
    return scratch.table(found.where("linked").select("a", "b"))


def only(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs whose column is among ids (a written table of its own), by a broadcast if these are BROADCAST_IDS at most."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")
