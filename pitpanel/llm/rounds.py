"""From buckets of candidates to connected groups, without ever pairing up a bucket in the plan.

Round one tests each member against the least member of a bucket, of that one with which it shares most buckets. A bucket whose members then form one
component is settled: no other pair in it could change anything. Round two tests what is left of (least member, member) across components, each pair once
however many buckets it shares; that settles buckets of two, and the least member of every bucket. In round three the other members of each open bucket
go through one task, which keeps a union-find: a member is compared with members of other components only, and only links that join two components leave
the task. A bucket too large for one task is cut into blocks, and every pair of blocks goes through a task, so rows grow with the number of blocks and not
with the number of pairs. Of buckets with the same members one is enough. All rounds decide on the full sets.

With ``sketched``, texts travel only where a pair can still be similar. The sketch of a set is one bit for each of its cells of hashes: whether
an odd number of elements fell there. Where two sketches differ, the sets do, so more differing bits than similar sets may have elements rule a pair out for certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import drop, slices, store
from pitpanel.llm.components import connected

#: Members of a block, and code points of their texts.
BLOCK_ROWS, BLOCK_CHARS = 2_000, 8_000_000
#: Pairs of one member that are verified by one task in round one.
PAIRS_A_TASK = 2_000

Sets = Callable[[pa.Array], list[np.ndarray]]


def members_of(keyed: DataFrame) -> tuple[DataFrame, str]:
    """(key, rep, lead) of the rows (key, rep) whose key others share; lead is the least of them. Of keys with the same rows one is kept. And the scratch path."""
    spark = keyed.sparkSession
    rows = keyed.select("key", "rep").repartition("key").sortWithinPartitions("key")
    shared, path = store(rows.mapInArrow(_shared, rows.schema), "shared")
    buckets = shared.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"),
                                        F.bit_xor(F.xxhash64("rep")).alias("all")).filter("lead < last")
    kept = buckets.groupBy("lead", "last", "n", "all").agg(F.min("key").alias("key"))
    members, p_members = store(shared.join(kept.select("key", "lead"), "key").select("key", "rep", "lead"), "members")
    drop(spark, path)
    return members, p_members


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those whose neighbour has the same value there. Most keys have one row, and it ends here."""
    held, carry = None, False  # the last row so far, and whether the one before it had its key
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        same = keys[1:] == keys[:-1]
        before = np.concatenate([[carry], same])
        yield batch.take(pa.array(np.flatnonzero(before[:-1] | same)))
        held, carry = batch.slice(batch.num_rows - 1), bool(before[-1])
    if carry:
        yield held


def grouped(members: DataFrame, texts: DataFrame, sets: Sets, similar: int, sketched: bool = False,
            block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, list[str]]:
    """(node, root) for every member that is linked to another, and the scratch paths behind it.

    ``members`` has (key, rep, lead), ``texts`` (rep, text) for all of them; both are stored. ``sets`` gives the shingles of texts; a link
    takes ``similar`` hundredths of their union. ``sketched`` and the sizes of blocks change the cost, not the result.
    """
    spark = members.sparkSession
    shared = members.filter("lead < rep").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("lead", F.struct("n", "lead"))

    signs, p_signs = store(sketches(texts, sets), "sketches") if sketched else (None, "")

    def tests(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
        candidates, p = store(possible(pairs, signs, similar) if sketched else pairs, "candidates")
        found, q = store(verified(candidates, texts, sets, similar), "links")
        return found, [p, q]

    found, p_first = tests(shared.groupBy(F.col("rep").alias("b")).agg(best.alias("a")).select("a", "b"))
    roots, p_roots = connected(found)
    labelled, p_labelled = store(_labelled(members, roots), "buckets")
    comps = labelled.filter("rep = lead").select(F.col("lead").alias("l"), F.col("comp").alias("lead_comp")).distinct()
    across = labelled.filter("lead < rep").join(comps, F.col("lead") == F.col("l")).filter("comp <> lead_comp").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    more, p_second = tests(across.distinct())
    drop(spark, *p_roots)
    roots, p_roots = connected(found.unionByName(more))
    drop(spark, p_labelled)
    chars = texts.groupBy("rep").agg(F.max(F.length("text")).alias("chars"))
    labelled, p_labelled = store(_labelled(members.filter("lead < rep"), roots).join(chars, "rep"), "buckets")
    open_, p_open = store(_open(labelled, block_rows, block_chars), "open")
    scratch = [*p_first, *p_second, p_labelled, p_open]
    if sketched:
        suspects, p = store(_suspects(labelled.join(open_, "key").select("key", "rep", "comp", "blocks"), signs, similar).distinct(), "suspects")
        labelled, q = store(labelled.join(suspects, ["key", "rep"], "left_semi"), "buckets")
        open_, r = store(_open(labelled, block_rows, block_chars), "open")
        scratch += [p, q, r, p_signs]
    last, p_last = store(_linked(labelled.join(open_, "key").select("key", "rep", "comp", "blocks"), texts, sets, similar), "links")
    drop(spark, *p_roots)
    roots, p_roots = connected(found.unionByName(more).unionByName(last))
    drop(spark, *scratch, p_last)
    return roots, p_roots


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, lead, comp) with the component of each member so far."""
    return members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "lead", F.coalesce("root", "rep").alias("comp"))


def _open(labelled: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """(key, blocks) of the buckets in which links may still be missing; of those with the same members one."""
    stats = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"),
                                        F.min("rep").alias("least"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("all"))
    left = stats.filter("c1 < c2").groupBy("least", "last", "n", "all").agg(F.min("key").alias("key"), F.max("chars").alias("chars"))
    return left.select("key", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("chars") / block_chars)).cast("int").alias("blocks"))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, comp, blocks) once for each pair (i, j) of blocks of their bucket that they belong to; first: whether they are of block i."""
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = rows.withColumn("own", own).withColumn("cell", F.explode(cells))
    return dealt.select("key", "cell.i", "cell.j", (F.col("own") == F.col("cell.i")).alias("first"), "rep", "comp")


def _by_cell(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Sorted rows in lists of the same (key, i, j)."""
    return (list(own) for _, own in groupby(rows, key=lambda r: r[:3]))


def sketches(texts: DataFrame, sets: Sets) -> DataFrame:
    """(rep, n, bits) for each of ``texts``: the size of its set and the parities of its cells, 64 in a number. There are 2 to 4 cells an element."""
    schema = T.StructType([texts.schema["rep"], *T._parse_datatype_string("n long, bits array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                own = sets(part.column(1))
                bits = [parities(s) for s in own]
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in own], pa.int64()), lists], names=["rep", "n", "bits"])

    return texts.select("rep", "text").mapInArrow(run, schema)


def parities(elements: np.ndarray) -> np.ndarray:
    """For each cell of hashes whether the set has an odd number of elements there. Cells are a power of two, so the halves of a sketch fold into a smaller one."""
    cells = max(64, 1 << (2 * len(elements) - 1).bit_length()) if len(elements) else 64
    odd = np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def possible(pairs: DataFrame, signs: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule them out."""
    def side(name: str) -> DataFrame:
        return signs.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    a, b = F.col("bits_a"), F.col("bits_b")
    apart = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    both = F.col("n_a") + F.col("n_b")
    sizes = 100 * F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b")
    fits = (100 + similar) * F.coalesce(apart, F.lit(0)) <= (100 - similar) * both  # NULL: sizes too far apart to fold once
    return pairs.join(side("a"), "a").filter("n_a > 0").join(side("b"), "b").filter(sizes).filter(fits).select("a", "b").distinct()


def _suspects(rows: DataFrame, signs: DataFrame, similar: int) -> DataFrame:
    """(key, rep) of members that a member of another component in their bucket may be similar to. rows: key, rep, comp, blocks."""
    full = _cells(rows).join(signs, "rep").select("key", "i", "j", "first", "comp", "rep", "n", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = T.StructType([rows.schema["key"], rows.schema["rep"]])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            bits, offsets = batch.column(7).flatten().to_numpy(), batch.column(7).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
                yield (*row, bits[offsets[k] : offsets[k + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps = [], []
        for held in _by_cell(flat(batches)):
            own = suspected(held, similar)
            keys += [held[0][0]] * len(own)
            reps += own
            if len(keys) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], names=["key", "rep"])
                keys, reps = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], names=["key", "rep"])

    return full.mapInArrow(run, schema)


def suspected(rows: list[tuple], similar: int) -> list:
    """Of rows (key, i, j, first, component, rep, n, bits) the reps whose sketch leaves a partner in another component; between two blocks only partners across them."""
    if len({r[4] for r in rows}) < 2:
        return []
    across = rows[0][1] != rows[0][2]
    rows = sorted(rows, key=lambda r: r[6])
    names: dict[object, int] = {}
    comp = np.array([names.setdefault(r[4], len(names)) for r in rows])
    side = np.array([r[3] for r in rows])
    size = np.array([r[6] for r in rows])
    width = np.array([len(r[7]) for r in rows])  # grows with the size
    table = {w: np.stack([r[7] for r in rows if len(r[7]) == w]) for w in np.unique(width)}
    some = np.zeros(len(rows), bool)
    for k in range(1, len(rows)):
        low = np.searchsorted(size, -(-similar * size[k] // 100))  # shorter ones cannot be similar
        mine = rows[k][7]
        end = k
        while low < end:
            begin = int(np.searchsorted(width, width[end - 1]))
            while len(mine) > width[begin]:
                mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
            at = np.arange(max(low, begin), end)
            apart = np.bitwise_count((table[width[begin]][at - begin] ^ mine).view(np.uint64)).sum(axis=1, dtype=np.int64)
            fits = (comp[at] != comp[k]) & ((100 + similar) * apart <= (100 - similar) * (size[at] + size[k]))
            fits &= (side[at] != side[k]) if across else True
            some[at[fits]] = True
            some[k] |= fits.any()
            end = begin
    return [rows[k][5] for k in np.flatnonzero(some)]


def _linked(rows: DataFrame, texts: DataFrame, sets: Sets, similar: int) -> DataFrame:
    """Links (a, b) that join components within a bucket. rows: key, rep, comp, blocks."""
    full = _cells(rows).join(texts, "rep").select("key", "i", "j", "first", "comp", "rep", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = f"a {rows.schema['rep'].dataType.simpleString()}, b {rows.schema['rep'].dataType.simpleString()}"

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, 6):
                yield from zip(*(part.column(c).to_pylist() for c in range(6)), sets(part.column(6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for held in _by_cell(flat(batches)):
            out += joining(held, similar)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    def _pairs(out: list[tuple]) -> pa.RecordBatch:
        kind = pa.string() if out and isinstance(out[0][0], str) else pa.int64()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i in (0, 1)], names=["a", "b"])

    return full.mapInArrow(run, schema)


def joining(rows: list[tuple], similar: int) -> list[tuple]:
    """The links among rows (key, i, j, first, component, rep, set) that join two components; between two blocks only those across them."""
    if len({r[4] for r in rows}) < 2:
        return []
    across = rows[0][1] != rows[0][2]
    names: dict[object, int] = {}
    comp = np.array([names.setdefault(r[4], len(names)) for r in rows])
    side = np.array([r[3] for r in rows])
    size = np.array([len(r[6]) for r in rows])
    order = np.argsort(size, kind="stable")
    comp, side, size = comp[order], side[order], size[order]
    own = [rows[k] for k in order]
    elements, ids = np.unique(np.concatenate([r[6] for r in own]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    marked, out = np.zeros(len(elements), bool), []
    for k in range(1, len(own)):
        low = np.searchsorted(size, -(-similar * size[k] // 100))  # shorter ones cannot be similar
        others = np.arange(low, k)
        others = others[(comp[low:k] != comp[k]) & (side[low:k] != side[k] if across else True)]
        if not len(others):
            continue
        mine = ids[starts[k] : starts[k + 1]]
        marked[mine] = True
        n = size[others]
        at = np.repeat(starts[others] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.add.reduceat(marked[ids[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        marked[mine] = False
        for m in others[100 * both >= similar * (n + size[k] - both)]:
            if comp[m] != comp[k]:
                out.append((min(own[m][5], own[k][5]), max(own[m][5], own[k][5])))
                comp[comp == comp[m]] = comp[k]
    return out


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, similar: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets. A task streams the partners of a, having read a once."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    rows = heads.join(texts, heads.a == texts.rep).select("a", "salt", F.lit(0).alias("kind"), F.col("rep").alias("b"), "text").unionByName(
        salted.join(texts, salted.b == texts.rep).select("a", "salt", F.lit(1).alias("kind"), "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches):
        key, heads_ = None, []
        for batch in batches:
            for part in slices(batch, 4):
                hits = []
                for i, (a, kind, own) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets(part.column(4)))):
                    if kind == 0:
                        heads_ = [*(heads_ if key == a else []), own]  # several only where texts share an id
                        key = a
                    elif key == a and any(similar_sets(h, own, similar) for h in heads_):
                        hits.append(i)
                yield part.select([0, 3]).take(pa.array(hits, pa.int64()))

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def similar_sets(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= similar * (len(x) + len(y) - both)
