"""N-gram Jaccard join by vertical partitioning.

The global order of word n-grams (that of their hashes) is cut into fragments. Each document is cut
along the same pivots, each fragment sees only its part of every document, and partial overlaps are
counted per fragment and summed per pair. Exact devices keep all that is sent linear in the text:

1. Documents with equal n-gram sets share a 64-bit signature and are joined once, as one set.
2. A first pass counts, fragment by fragment, how many n-grams of each document occur in another set. Fewer
   than ``ceil(threshold * size)`` of them, and no partner can reach the threshold; most documents end
   here. N-grams that sets of one batch share are counted there, and two of their entries are sent.
3. In the second pass each fragment counts overlaps of the remaining sets in n-grams of at most ``hot`` of
   them, and sends them per pair. More frequent n-grams are sent per set.
4. Sets that can match form components: by pairs that the counts so far still allow, and by the least
   frequent of their frequent n-grams, some of which any two sets that match in frequent ones alone share.
   A component is one group, or, by its size, a triangle of pairs of blocks. Each adds up its partial overlaps,
   fragments of the frequent n-grams as matrix products, and gives one row per set, not per pair: how
   many documents it is linked to and the least set that it reaches there.

N-grams travel as sorted, delta-coded blocks, some five bytes each, and Arrow groups are one fragment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import Hasher, mix, ranges, row_slices, word_hashes
from textloom.llm.classes import classified, components
from textloom.llm.common import cut, fresh, maybe_broadcast, q, row_key

BROADCAST_BYTES = 64 << 20
FRAGMENT_GRAMS = 4 << 20
OVERLAP_GRAMS = 1 << 20
BLOCK_SETS = 1 << 11
BLOCK_GRAMS = 1 << 21
COLUMNS = 1 << 10
BATCH = 1 << 15
BATCH_BYTES = 12 << 20
FLAG = np.uint16(1 << 15)
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(column: pa.Array, n: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(document << 48 | 48-bit n-gram hash), sorted and distinct, and the set size of each document.

    A text of fewer than n words has one n-gram, all its words; a text without words has none.
    """
    words, bounds = word_hashes(column, hasher)
    count = np.diff(bounds)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = ranges(bounds[:-1], grams)
    doc = np.repeat(np.arange(len(count), dtype=np.int64), grams)
    last = bounds[1:][doc] if len(doc) else doc
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        at = first + i
        w = np.where(at < last, words[np.minimum(at, len(words) - 1)] if len(words) else 0, 0).astype(np.uint64)
        h = h * np.uint64(0xD1342543DE82EF95) + w
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(count))


def signatures(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits that name the n-gram set of each document."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key & np.uint64((1 << 48) - 1)))])
    ends = np.cumsum(sizes)
    return mix((total[ends] - total[ends - sizes]) ^ (sizes.astype(np.uint64) << np.uint64(40))).view(np.int64)


def sliced_sets(column: pa.Array, n: int, hasher: Hasher):
    """(first row, rows, key, sizes) as in :func:`shingle_sets`, a slice of rows at a time."""
    for at, rows in row_slices(column):
        yield at, rows, *shingle_sets(column.slice(at, rows), n, hasher)


def coded(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: the first, then the differences in as many bytes as the greatest needs."""
    delta = np.diff(values, prepend=np.uint64(0))
    first, delta[0] = delta[0], 0
    width = max(1, -(-int(delta.max()).bit_length() // 8))
    raw = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8)[:, :width])
    return np.uint64(first).tobytes() + raw.tobytes()


def decoded(data: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=8).reshape(count, -1)
    wide = np.zeros((count, 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return np.cumsum(wide.view(np.uint64).ravel()) + np.frombuffer(data, np.uint64, 1)[0]


def blocks(h: np.ndarray, doc: np.ndarray, flag: np.ndarray, owner: np.ndarray, bits: int, fragments: int):
    """(fragment, n-grams, places, flags, owners, owners' rows) of each fragment that has n-grams.

    ``h`` is sorted and has ``bits`` bits; ``owner`` (rows, bytes) names each document. ``places`` point into
    the owners of the block.
    """
    pivots = (np.arange(fragments + 1, dtype=np.uint64) << np.uint64(bits)) // np.uint64(fragments)
    cuts = np.concatenate([[0], np.searchsorted(h, pivots[1:-1]), [len(h)]])
    for f in range(fragments):
        a, b = cuts[f], cuts[f + 1]
        if a < b:
            used = np.zeros(len(owner), bool)
            used[doc[a:b]] = True
            place = (np.cumsum(used) - 1)[doc[a:b]].astype(np.uint16) | np.where(flag[a:b], FLAG, np.uint16(0))
            yield f, coded(h[a:b]), place.tobytes(), owner[used].tobytes(), np.flatnonzero(used).astype(np.uint16).tobytes()


def local_groups(h: np.ndarray):
    """The group of each entry of sorted ``h``, where the groups begin, and their sizes."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return np.cumsum(new) - 1, at, np.diff(np.append(at, len(h)))


def parts(whole: pa.RecordBatch, text: int):
    """The batch in slices of some megabytes of text, and of rows whose places take 15 bits."""
    for at, rows in row_slices(whole.column(text), BATCH_BYTES):
        for first in range(at, at + rows, BATCH):
            yield whole.slice(first, min(BATCH, at + rows - first))


def counted(rows: DataFrame, n: int, fragments: int, bits: int) -> DataFrame:
    """First pass over (key, id, text): (sig, key, id, size, shared) of each row, with the number of its n-grams
    that occur in another set too. ``sig`` is null for texts without words."""
    fields = [("fragment", "int"), ("grams", "binary"), ("places", "binary"), ("owners", "binary"), ("docs", "binary"), ("batch", "bigint")]
    fields += [("keys", "array<bigint>"), ("ids", "array<string>"), ("sigs", "array<bigint>"), ("sizes", "array<int>"), ("local", "array<int>")]
    arrow = pa.schema(
        [("fragment", pa.int32()), ("grams", pa.binary()), ("places", pa.binary()), ("owners", pa.binary()), ("docs", pa.binary())]
        + [("batch", pa.int64()), ("keys", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())), ("sigs", pa.list_(pa.int64()))]
        + [("sizes", pa.list_(pa.int32())), ("local", pa.list_(pa.int32()))]
    )
    lists = list(arrow)[6:]

    def emit(batches):
        hasher = Hasher()
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in parts(whole, 2):
                entries, sizes, sigs = [], [], []
                for first, _, key, size in sliced_sets(batch.column(2), n, hasher):
                    sigs.append(signatures(key, size))
                    sizes.append(size)
                    doc = (key >> np.uint64(48)) + np.uint64(first)
                    entries.append((((key & LOW48) >> np.uint64(48 - bits)) << np.uint64(15)) | doc)
                if not entries:
                    continue
                entry, size, sig = np.concatenate(entries), np.concatenate(sizes), np.concatenate(sigs)
                del entries, sizes, sigs
                first = np.unique(sig, return_index=True)[1]  # one document stands for a set's copies in the batch
                stands = np.zeros(len(sig), bool)
                stands[first] = True
                entry = entry[stands[(entry & np.uint64(BATCH - 1)).astype(np.int64)]]
                entry.sort()
                h, doc = entry >> np.uint64(15), (entry & np.uint64(BATCH - 1)).astype(np.int64)
                del entry
                # n-grams of several sets of the batch are counted here, and only two entries of each are sent
                group, begin, times = local_groups(h)
                known = (times > 1)[group]
                local = np.bincount(doc[known], minlength=len(size))
                send = ~known
                send[begin] = True
                send[begin[times > 1] + 1] = True
                h, doc, flag = h[send], doc[send], known[send]
                sig_list = pa.array(sig, mask=size == 0).to_pylist()
                ride = [[x] for x in (batch.column(0).to_pylist(), batch.column(1).to_pylist(), sig_list, size.tolist(), local.tolist())]
                owner = sig.view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits tell sets apart here
                made = list(blocks(h, doc, flag, owner, bits, fragments)) or [(number % fragments, None, None, None, None)]
                for row in made:
                    arrays = [pa.array([c], t.type) for c, t in zip([*row, number], arrow)]
                    arrays += [pa.array(x, t.type) for x, t in zip(ride, lists)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                    ride = [[None]] * len(lists)  # the documents go along with the first block
                number += 1

    out = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("times", pa.binary()), *lists])

    def count(group: pa.Table) -> pa.Table:
        full = group.filter(pc.is_valid(group["grams"]))
        hs, names, codes, flags, batches = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
        for k in range(len(full)):
            grams, places, owners, docs, batch = (full[c][k].as_py() for c in ("grams", "places", "owners", "docs", "batch"))
            place = np.frombuffer(places, np.uint16)
            hs.append(decoded(grams, len(place)))
            flags.append(place >= FLAG)
            place = place & ~FLAG
            five = np.frombuffer(owners, np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            names.append(wide.view(np.uint64).ravel()[place])
            codes.append((k << 15) + np.frombuffer(docs, np.uint16)[place].astype(np.int64))
            batches.append(batch)
        h = np.concatenate(hs)
        del hs
        order = np.argsort(h, kind="stable")
        h, name = h[order], np.concatenate(names)[order]
        code = np.where(np.concatenate(flags), -1, np.concatenate(codes))[order]
        rows = []
        if len(h):
            of, begin, _ = local_groups(h)
            shared = (np.minimum.reduceat(name, begin) != np.maximum.reduceat(name, begin))[of]
            code, times = np.unique(code[shared & (code >= 0)], return_counts=True)
            bounds = np.searchsorted(code, np.arange(len(batches) + 1) << 15)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    rows.append((batches[k], (code[a:b] & (BATCH - 1)).astype(np.uint16).tobytes(), times[a:b].astype(np.uint16).tobytes()))
        ride = group.filter(pc.is_valid(group["keys"])).select(["batch", *[t.name for t in lists]])
        made = pa.table([pa.array([r[i] for r in rows], out[i].type) for i in range(3)] + [pa.nulls(len(rows), t.type) for t in lists], schema=out)
        passed = pa.table([ride["batch"], pa.nulls(len(ride), pa.binary()), pa.nulls(len(ride), pa.binary()), *ride.columns[1:]], schema=out)
        return pa.concat_tables([made, passed])

    def added(group: pa.Table) -> pa.Table:
        docs = group.filter(pc.is_valid(group["keys"]))
        if not len(docs):
            return pa.table({"sig": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "id": pa.array([], pa.string()),
                             "size": pa.array([], pa.int32()), "shared": pa.array([], pa.int64())})
        flat = [docs[t.name].combine_chunks().flatten() for t in lists]
        total = flat[4].to_numpy().astype(np.int64)
        for places, times in zip(group["docs"].to_pylist(), group["times"].to_pylist()):
            if places is not None:
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(times, np.uint16)
        sig, of = np.unique(flat[2].fill_null(0).to_numpy(), return_inverse=True)  # copies have what the one that stands for them has
        most = np.zeros(len(sig), np.int64)
        np.maximum.at(most, of, total)
        total = most[of]
        return pa.table({"sig": flat[2], "key": flat[0], "id": flat[1], "size": flat[3], "shared": pa.array(total)})

    staged = rows.mapInArrow(emit, ", ".join(f"{a} {b}" for a, b in fields))
    made = "batch bigint, docs binary, times binary, " + ", ".join(f"{a} {b}" for a, b in fields[6:])
    found = staged.groupBy("fragment").applyInArrow(count, made)
    return found.groupBy("batch").applyInArrow(added, "sig bigint, key bigint, id string, size int, shared bigint")


def overlapped(rows: DataFrame, n: int, fragments: int, hot: int, threshold: float) -> DataFrame:
    """Second pass over (sig, size, text) of the remaining sets, as rows of three kinds.

    0: (a, b, n), partial overlap of a pair, a < b, in a fragment's n-grams that at most ``hot`` sets have;
    1: (a, grams), n-grams of set a that more sets have; 2: (a, n), an n-gram of that kind and its
    number of sets, as far as batches tell.
    """
    fields = [("fragment", "int"), ("grams", "binary"), ("places", "binary"), ("owners", "binary"), ("docs", "binary")]
    fields += [("own", "array<bigint>"), ("frequent", "array<array<bigint>>")]
    many = pa.list_(pa.int64())
    arrow = pa.schema(
        [("fragment", pa.int32()), ("grams", pa.binary()), ("places", pa.binary()), ("owners", pa.binary()), ("docs", pa.binary())]
        + [("own", many), ("frequent", pa.list_(many))]
    )

    def emit(batches):
        hasher = Hasher()
        for whole in batches:
            for batch in parts(whole, 2):
                owner = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)], 1)
                entries = []
                for first, _, key, _ in sliced_sets(batch.column(2), n, hasher):
                    entries.append(((key & LOW48) << np.uint64(15)) | ((key >> np.uint64(48)) + np.uint64(first)))
                if not entries:
                    continue
                entry = np.concatenate(entries)
                del entries
                entry.sort()
                h, doc = entry >> np.uint64(15), (entry & np.uint64(BATCH - 1)).astype(np.int64)
                del entry
                group, begin, size = local_groups(h)
                known = (size > hot)[group]  # frequent in this batch alone: one entry tells the fragment
                by = np.argsort(doc[known], kind="stable")
                held, of = h[known][by].astype(np.int64), doc[known][by]
                some, number = np.unique(of, return_counts=True)
                ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                frequent = pa.ListArray.from_arrays(pa.array(ends), pa.array(held))
                ride = [pa.array([owner[some, 0].tolist()], many), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), frequent)]
                send = ~known
                send[begin] = True
                for row in blocks(h[send], doc[send], known[send], owner.view(np.uint8).reshape(len(owner), -1), 48, fragments):
                    arrays = [pa.array([c], t.type) for c, t in zip(row, arrow)] + ride
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                    ride = [pa.nulls(1, t.type) for t in list(arrow)[5:]]

    out = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("grams", many)])

    def overlap(group: pa.Table) -> pa.Table:
        hs, sigs, sizes, flags = [], [], [], []
        for grams, places, owners in zip(*(group[c].to_pylist() for c in ("grams", "places", "owners"))):
            place = np.frombuffer(places, np.uint16)
            hs.append(decoded(grams, len(place)))
            flags.append(place >= FLAG)
            pair = np.frombuffer(owners, np.int64).reshape(-1, 2)[place & ~FLAG]
            sigs.append(pair[:, 0])
            sizes.append(pair[:, 1])
        h, flag = np.concatenate(hs), np.concatenate(flags)
        names, first, sig = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first]
        order = np.lexsort((sig, h))
        h, sig, flag = h[order], sig[order].astype(np.int64), flag[order]
        of, begin, times = local_groups(h)
        sets = times + hot * np.add.reduceat(flag.astype(np.int64), begin)  # a flag stands for more than hot
        often = (sets > hot)[of]
        top, sets = h[begin[sets > hot]].astype(np.int64), sets[sets > hot]
        # frequent n-grams, by set
        mine = often & ~flag
        by = np.argsort(sig[mine], kind="stable")
        whose, number = np.unique(sig[mine][by], return_counts=True)
        ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[mine][by].astype(np.int64)))
        # pairs in the others
        h, sig = h[~often], sig[~often]
        codes, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = np.arange(len(h)), 1
        while True:
            at = at[at + step < len(h)]
            at = at[h[at] == h[at + step]]
            if not len(at):
                break
            x, y = sig[at], sig[at + step]
            fits = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
            new, n_new = np.unique(x[fits] * len(names) + y[fits], return_counts=True)
            codes, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([total, n_new])).astype(np.int64)
            step += 1
        a, b = (names[codes // len(names)], names[codes % len(names)]) if len(codes) else (codes, codes)
        ride = group.filter(pc.is_valid(group["own"]))
        own, held = ride["own"].combine_chunks().flatten(), ride["frequent"].combine_chunks().flatten()
        sizes = [len(a), len(whose), len(own), len(top)]
        kind = np.repeat(np.array([0, 1, 1, 2], np.int32), sizes)
        blank = sum(sizes[1:3])
        return pa.table(
            [
                pa.array(kind),
                pa.concat_arrays([pa.array(a), pa.array(names[whose]), own.cast(pa.int64()), pa.array(top)]),
                pa.concat_arrays([pa.array(b), pa.nulls(blank + len(top), pa.int64())]),
                pa.concat_arrays([pa.array(total), pa.nulls(blank, pa.int64()), pa.array(sets.astype(np.int64))]),
                pa.concat_arrays([pa.nulls(len(a), many), lists, held.cast(many), pa.nulls(len(top), many)]),
            ],
            schema=out,
        )

    staged = rows.mapInArrow(emit, ", ".join(f"{a} {b}" for a, b in fields))
    return staged.groupBy("fragment").applyInArrow(overlap, "kind int, a bigint, b bigint, n bigint, grams array<bigint>")


def products(rows: np.ndarray, grams: np.ndarray, shape: tuple[int, int], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Overlap of each row of one block with each of the other, as (row, n-gram) entries of both.

    N-grams are taken by the first row that has them, ``COLUMNS`` at a time, and only the rows that have
    any of those are multiplied.
    """
    total = np.zeros(shape, np.float32)
    both = np.intersect1d(grams, other[1])
    if not len(both):
        return total
    keep, keep2 = np.isin(grams, both), np.isin(other[1], both)
    row, col = rows[keep], np.searchsorted(both, grams[keep])
    row2, col2 = other[0][keep2], np.searchsorted(both, other[1][keep2])
    first = np.full(len(both), shape[0])
    np.minimum.at(first, col, row)
    rank = np.empty(len(both), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(both))
    col, col2 = rank[col], rank[col2]
    by, by2 = np.argsort(col, kind="stable"), np.argsort(col2, kind="stable")
    row, col, row2, col2 = row[by], col[by], row2[by2], col2[by2]
    for at in range(0, len(both), COLUMNS):
        a, b = np.searchsorted(col, [at, at + COLUMNS])
        c, d = np.searchsorted(col2, [at, at + COLUMNS])
        some, x = np.unique(row[a:b], return_inverse=True)
        some2, y = np.unique(row2[c:d], return_inverse=True)
        left, right = np.zeros((len(some), COLUMNS), np.float32), np.zeros((len(some2), COLUMNS), np.float32)
        left[x, col[a:b] - at] = 1
        right[y, col2[c:d] - at] = 1
        total[np.ix_(some, some2)] += left @ right.T
    return total


def joined_blocks(sets: DataFrame, pairs: DataFrame, threshold: float, emit_pairs: bool) -> DataFrame:
    """(sig, links, root) by set and pair of blocks: the number of documents of other sets at or above the threshold,
    and the least set reached; or (a, b, jaccard) of each such pair.

    ``sets`` has (root, sig, size, copies, grams), ``pairs`` (root, a, b, n), where ``root`` names the component.
    """
    amount = sets.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("grams")).alias("entries"))
    wide = F.greatest(F.lit(1), F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("entries") / BLOCK_GRAMS)).cast("int")
    amount = amount.select("root", wide.alias("k"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    none = F.lit(None)
    copies = sets.join(amount, "root").withColumn("side", block("sig"))
    copies = copies.select("root", "side", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("y"), "sig", "size", "copies", "grams")
    copies = copies.select(
        "root", F.least("side", "y").alias("i"), F.greatest("side", "y").alias("j"), "side", F.col("sig").alias("a"),
        none.cast("long").alias("b"), none.cast("long").alias("n"), "size", "copies", "grams",
    )
    asked = pairs.join(amount, "root").select(
        "root", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), none.cast("int").alias("side"),
        "a", "b", "n", none.cast("int").alias("size"), none.cast("long").alias("copies"), none.cast("array<long>").alias("grams"),
    )
    if emit_pairs:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
    else:
        out = pa.schema([("sig", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def link(group: pa.Table) -> pa.Table:
        is_set = pc.is_null(group["b"])
        docs, wanted = group.filter(is_set), group.filter(pc.invert(is_set))
        docs = docs.take(pc.sort_indices(docs["a"]))
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        sig, size = docs["a"].to_numpy(), docs["size"].to_numpy().astype(np.float64)
        times, side = docs["copies"].to_numpy(), docs["side"].to_numpy()
        lists = docs["grams"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        gram, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(sig)), length)
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        place = np.zeros(len(sig), np.int64)
        place[one] = np.arange(len(one))
        place[two] = np.arange(len(two))
        in_one, in_two = side[doc] == i, side[doc] == j
        total = products(place[doc[in_one]], gram[in_one], (len(one), len(two)), (place[doc[in_two]], gram[in_two]))
        a, b, n = (wanted[c].to_numpy() for c in ("a", "b", "n"))
        a, b = np.searchsorted(sig, a), np.searchsorted(sig, b)
        swap = side[a] != i
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        total[place[a], place[b]] += n
        if i == j:
            total[place[b], place[a]] += n
        linked = total / (size[one][:, None] + size[two][None] - total) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        if emit_pairs:
            x, y = np.nonzero(np.triu(linked) if i == j else linked)
            value = total[x, y] / (size[one[x]] + size[two[y]] - total[x, y])
            x, y = sig[one[x]], sig[two[y]]
            return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(value.astype(np.float64))], schema=out)
        links = np.zeros(len(sig), np.int64)
        links[one] = linked @ times[two]
        if i != j:
            links[two] = linked.T @ times[one]
        least = np.arange(len(sig))
        while True:
            before = least.copy()
            least[one] = np.minimum(least[one], np.where(linked, least[two][None], len(sig)).min(1, initial=len(sig)))
            if i != j:
                least[two] = np.minimum(least[two], np.where(linked, least[one][:, None], len(sig)).min(0, initial=len(sig)))
            least = np.minimum(least, least[least])
            if (least == before).all():
                break
        some = np.flatnonzero(links)
        return pa.table([pa.array(sig[some]), pa.array(links[some]), pa.array(sig[least[some]])], schema=out)

    made = "a bigint, b bigint, jaccard double" if emit_pairs else "sig bigint, links bigint, root bigint"
    return copies.unionByName(asked).groupBy("root", "i", "j").applyInArrow(link, made)


def ngram_sets_join(
    docs: DataFrame, text_col: str, id_col: str, n: int, threshold: float, hot: int, emit_pairs: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, links): members (sig, key, id) has each document once, with the signature of its
    n-gram set, null without words; sets (sig, size, copies, least) each set, with its number of documents and least
    one; links is as in :func:`joined_blocks`."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    kind = docs.schema[id_col].dataType
    lower = F.lower(F.coalesce(F.col(q(text_col)), F.lit("")))
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(q(id_col)).cast("string").alias("id"), lower.alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    grams = (keyed.agg(F.sum(F.length("text"))).first()[0] or 0) // 4  # at most, in words of three letters
    bits = min(48, max(40, int(grams).bit_length() + 8))
    found = counted(keyed, n, max(16, cores, -(-grams // FRAGMENT_GRAMS)), bits)
    found = cut(found.withColumn("id", F.col("id").cast(kind)).dropDuplicates(["key"]))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    sets = found.where("sig is not null").groupBy("sig").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"), F.max("shared").alias("shared")
    )
    sets = cut(sets)
    alive = sets.where(F.col("shared") >= F.ceil(F.col("size") * threshold - 1e-9)).select("sig", "size", "copies", F.col("least.key").alias("alive_key"))
    many, grams = alive.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    texts = keyed.join(maybe_broadcast(alive.select("sig", "size", "alive_key"), many, 64, BROADCAST_BYTES), F.col("key") == F.col("alive_key"))
    texts = texts.select("sig", "size", "text")
    # a pair has a row for each fragment that its n-grams fall into: no more fragments than memory asks for
    made = cut(overlapped(texts, n, max(cores, -(-grams // OVERLAP_GRAMS)), hot, threshold))
    frequent = made.where("kind = 1").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    held = cut(alive.join(frequent.withColumnRenamed("a", "sig"), "sig", "left").select("sig", "size", "copies", "grams"))
    number = F.coalesce(F.size("grams"), F.lit(0))
    number = F.when(F.col("grams").isNull(), 0).otherwise(number)
    sizes = maybe_broadcast(held.select("sig", "size", number.alias("hots")), many, 48, BROADCAST_BYTES)
    pairs = made.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("sig").alias(end), F.col("size").alias(f"{end}n"), F.col("hots").alias(f"{end}h")), end)
    reach = (F.col("an") + F.col("bn")) * (threshold / (1 + threshold)) - 1e-9
    pairs = cut(pairs.where(F.col("n") + F.least("ah", "bh") >= reach).select("a", "b", "n"))
    # sets that can match in frequent n-grams alone share one of the first of these
    need = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    alone = held.where(F.col("grams").isNotNull() & (number >= need))
    each = alone.select("sig", (number - need + 1).alias("first"), F.explode("grams").alias("gram"))
    each = each.join(made.where("kind = 2").select(F.col("a").alias("gram"), F.col("n").alias("sets")), "gram")
    each = each.groupBy("sig", "first").agg(F.sort_array(F.collect_list(F.struct("sets", "gram"))).alias("all"))
    each = cut(each.select("sig", F.explode(F.expr("slice(all, 1, first)")).alias("x")).select("sig", F.col("x.gram").alias("gram")))
    star = each.join(each.groupBy("gram").agg(F.min("sig").alias("root")), "gram").where("sig <> root").select("sig", "root").distinct()
    groups = components(pairs.select("a", "b").unionByName(star.toDF("a", "b")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    mine = held.join(groups, F.col("sig") == F.col("node")).select("root", "sig", "size", "copies", "grams")
    asked = pairs.join(groups, F.col("a") == F.col("node")).select("root", "a", "b", "n")
    return found.select("sig", "key", "id"), sets.drop("shared"), cut(joined_blocks(mine, asked, threshold, emit_pairs))


def ngram_classes(docs: DataFrame, text_col: str, id_col: str, n: int, threshold: float, hot: int) -> DataFrame:
    """(key, id, class_id, class_key, links) of each document: see :func:`ngram_jaccard_join`."""
    return classified(*ngram_sets_join(docs, text_col, id_col, n, threshold, hot))


def ngram_jaccard_join(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3, threshold: float = 0.5, hot: int = 32
) -> DataFrame:
    """(<id>, class_id, links) of each document: the least id of its class, and the number of its partners.

    Partners are all other documents whose word n-gram set is at least that similar, those with an equal set among
    them; a class is a connected component of partners. Exact: every pair counts, at both of its ends.
    Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case; a text of
    fewer than n words has one n-gram, all its words; null texts and texts without words have no
    partners. Null ids come last in order; rows that repeat both id and text are one document and give one
    row. Other columns are ignored; an empty table gives no rows.
    """
    out = ngram_classes(docs, text_col, id_col, n, threshold, hot)
    return out.select(F.col("id").alias(id_col), "class_id", "links")


def ngram_jaccard_pairs(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3, threshold: float = 0.5, hot: int = 32
) -> DataFrame:
    """(<id>_a, <id>_b, jaccard): the same join as pairs, of which there may be many more than documents.

    Documents with equal sets are a star: each is paired, at 1.0, with the least of them, and only that
    one takes part in further pairs (which hold for the others likewise). The lesser id comes first.
    """
    members, sets, near = ngram_sets_join(docs, text_col, id_col, n, threshold, hot, emit_pairs=True)
    a, b = f"{id_col}_a", f"{id_col}_b"
    head = sets.select(F.col("sig").alias("head"), F.col("least.id").alias("head_id"), F.col("least.key").alias("head_key"))
    star = members.join(head, F.col("sig") == F.col("head")).where("key <> head_key")
    star = star.select(F.col("head_id").alias(a), F.col("id").alias(b), F.lit(1.0).alias("jaccard"))
    first, second = head.select("head", "head_id").toDF("a", "x"), head.select("head", "head_id").toDF("b", "y")
    near = near.join(first, "a").join(second, "b")
    swap = F.col("x").isNull() | (F.col("y") < F.col("x"))
    near = near.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias(a), F.when(swap, F.col("x")).otherwise(F.col("y")).alias(b), "jaccard"
    )
    return star.unionByName(near)


def near_duplicates_removed(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3, threshold: float = 0.5, hot: int = 32
) -> DataFrame:
    """``docs`` with one document of each class of :func:`ngram_jaccard_join`, the least.

    Rows that repeat both id and text are one document to the join and all stay if it does. Texts without words,
    and all columns, are left as they are.
    """
    gone = ngram_classes(docs, text_col, id_col, n, threshold, hot).where("key <> class_key")
    key, gone_key = fresh(docs, "key", "gone")
    gone = cut(gone.select(F.col("key").alias(gone_key)))
    gone = maybe_broadcast(gone, gone.count(), 48, BROADCAST_BYTES)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(gone, F.col(key) == F.col(gone_key), "left_anti").drop(key)
