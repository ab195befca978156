"""N-gram Jaccard join by PartEnum signatures.

Sets fall into bands of sizes so that linked sets lie in one band or in neighbours.
In a band, linked sets differ in at most k elements. The domain of shingles is cut
into parts by hash; with more than k/2 parts some part differs in one element at
most, and of its three subparts two agree: each choice of two is a signature. (For
k up to 3 there is one part of k + 3 subparts, and each choice of 3 is one.) Linked
sets thus share a signature; whatever shares one is compared exactly.

Equal sets are one class from the start, so groups of copies are never compared
within. In a bucket of one signature, counts of elements by cell of the domain bound
the difference from below; what can't link by that bound is not joined there. A
bucket of over ``WIDE`` classes is dealt to several tasks, which bin their classes by
sums of cells; linked sets lie in one bin or in neighbours. The rest forms families.
A large family is cut into blocks by number and bytes, and each task compares two
blocks, tile by tile, so no task holds a large family. A task sends on a spanning
forest of its links and the number of links of each class, never all pairs. Classes,
families and hubs with many rows are broadcast where they meet their rows.

Defined cases: words are stretches between ASCII white space, A-Z in lower case; a
text with fewer words than a shingle is one shingle; a null text or one without
words is the empty set, linked with nothing; every row is a document, so repeated
rows link with each other, and rows of one doc_id with different texts are told
apart; a null doc_id is never a component's id unless no member has another; texts
are read whole, however long; ties can't arise; an empty table gives no rows; extra
columns are not read by ``classes`` and pass through ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, fresh, hashed_words, lean, mix64, odd_weights, sifted, spread_join, stored, tidy, utf8, whole_row
from .graph import components

WORDS = 3
PERCENT = 90
#: Classes that are compared at a time from each side.
BLOCK = 1024
#: and the elements of their sets in sum, if it isn't one set alone.
TILE = 1 << 18
#: Blocks of a family by number; beyond that blocks have so many bytes of text.
BLOCKS, BLOCK_BYTES = 16, 16 << 20
#: Cells by which candidates are held against the bound, and the widest bucket for that.
CELLS = 128
WIDE = 1024
#: Signatures that a task gathers before it sends them.
PACKED = 1 << 20

U = np.uint64


def shingles(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    word, _, cut = hashed_words(offsets, data)
    out, before = [], 0
    weight = odd_weights(words, 77)
    for end in cut.tolist():
        own = word[before:end]
        before = end
        if len(own) >= words:
            mixed = sum((own[i : len(own) - words + 1 + i] * weight[i] for i in range(1, words)), own[: len(own) - words + 1] * weight[0])
            out.append(np.unique(mix64(mixed)))
        elif len(own):
            out.append(mix64((own * weight[: len(own)]).sum(keepdims=True) + U(len(own))))
        else:
            out.append(np.zeros(0, U))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = np.array([mix64(s).sum(dtype=U), mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U) + U(len(s))
    return tuple(both.view(np.int64).tolist())


def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band, up to one that holds ``most``."""
    out, low = [], 1
    while not out or out[-1][1] < most:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def scheme(k: int) -> tuple[int, int, list[tuple[int, ...]], int]:
    """(parts, subparts, choices of subparts, parts that surely agree but for one
    element) for sets that differ in at most k elements."""
    if k <= 3:
        return 1, k + 3, list(combinations(range(k + 3), 3)), 1
    parts = (k + 2) // 2
    parts += 1 + parts // 20
    return parts, 3, list(combinations(range(3), 2)), parts - k // 2


def signatures(s: np.ndarray, band: int, k: int) -> np.ndarray:
    """Signatures of one set in one band, which is their low byte. Those of empty choices
    are left out unless so many parts have one that agreement elsewhere is not certain."""
    parts, subs, choices, agree = scheme(k)
    cell = ((s >> U(4)) % U(parts)).astype(np.int64) * subs + ((s >> U(36)) % U(subs)).astype(np.int64)
    m = mix64(s ^ U(0x2545F4914F6CDD1D))
    low = np.bincount(cell, (m & U(0xFFFFFFFF)).astype(np.float64), parts * subs)
    high = np.bincount(cell, (m >> U(32)).astype(np.float64), parts * subs)
    total = (low.astype(U) + (high.astype(U) << U(32))).reshape(parts, subs)
    count = np.bincount(cell, minlength=parts * subs).reshape(parts, subs)
    picked = np.stack([total[:, list(c)].sum(1, dtype=U) for c in choices], 1)
    size = np.stack([count[:, list(c)].sum(1) for c in choices], 1)
    salt = mix64(np.arange(picked.size, dtype=U).reshape(picked.shape) + (U(band) << U(40)))
    out = (mix64(picked + salt) & ~U(255)) | U(band & 255)
    bad = (size == 0).any(1).sum()
    return out.ravel() if bad >= agree else out[size > 0]


def _runs(column: pa.Array, words: int, limit: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) for stretches of about ``limit`` bytes."""
    offsets, data = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, shingles(offsets[lo : hi + 1], data, words)
        lo = hi


def cells(s: np.ndarray) -> bytes:
    """Elements of a set by ``CELLS`` cells of the domain, 255 at most. Two sets differ
    in at least as many elements as their counts do in sum."""
    return np.minimum(np.bincount(((s >> U(20)) % U(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the 128 bits (h1, h2) of its set, its cells, and the
    bytes and hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("cells", pa.binary()), ("bytes", pa.int64()), ("mark", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, sets in _runs(b.column(1), words):
                marks = [digest(s) for s in sets]
                yield batch(
                    schema, b.column(0).slice(lo, len(sets)), [len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks], [cells(s) for s in sets],
                    b.column(2).slice(lo, len(sets)), b.column(3).slice(lo, len(sets)),
                )

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("text").alias("mark"))
    return ready.mapInArrow(lean(run), "doc_id long, n_shingles long, h1 long, h2 long, cells binary, bytes long, mark long")


def packed(sigs: np.ndarray, members: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, pack) of signatures and their sets. A pack has 40 bits of each signature,
    rising, byte by byte, and 40 bits of each set's name, ten bytes a pair in all whatever
    the number of partitions; the bucket has the signature's next bits."""
    key = sigs & U((buckets << 40) - 1)
    order = np.argsort(key)
    key, low = key[order].astype("<u8"), members[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    bucket, bytes_ = (key >> U(40)).astype(np.int64), key.view(np.uint8).reshape(-1, 8)[:, :5]
    ends = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
    for lo, hi in zip(ends, ends[1:]):
        if lo < hi:
            yield int(bucket[lo]), bytes_[lo:hi].T.tobytes() + low[lo:hi].tobytes()


def unpacked(pack: bytes) -> np.ndarray:
    """The 40 bits of signatures and of sets, in two rows."""
    flat = np.frombuffer(pack, np.uint8)
    n = len(flat) // 10
    out = np.zeros((2, n, 8), np.uint8)
    out[0, :, :5], out[1, :, :5] = flat[: 5 * n].reshape(5, n).T, flat[5 * n :].reshape(n, 5)
    return out.view("<u8").reshape(2, n)


def _signed(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, pack) rows; a set met again in the same task isn't repeated."""
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = bands(percent, 1000)
        sigs, names, held = [], [], 0

        def sent() -> pa.RecordBatch:
            member = np.repeat(np.array(names, np.int64).view(U), [len(x) for x in sigs])
            return batch(schema, *zip(*packed(np.concatenate(sigs), member, buckets)))

        for b in batches:
            for _, sets in _runs(b.column(0), words):
                for s in sets:
                    if not len(s) or (name := digest(s)[0]) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    if table[-1][1] < 2 * len(s):
                        table = bands(percent, 2 * len(s))
                    own = int(np.searchsorted([high for _, high in table], len(s)))
                    for band in (own, own + 1):
                        if k := 2 * table[band][1] * (100 - percent) // (100 + percent):
                            sigs.append(signatures(s, band, k))
                            names.append(name)
                            held += len(sigs[-1])
                if held > PACKED:
                    yield sent()
                    sigs, names, held = [], [], 0
        if held:
            yield sent()

    return docs.select("text").mapInArrow(lean(run), "bucket int, pack binary")


def _shared(packs: DataFrame) -> DataFrame:
    """(sig, name, salts): signatures of several sets, with 40 bits of each set's name and
    the number of tasks they are dealt to. ``packs``: sorted by bucket."""
    schema = pa.schema([("sig", pa.int64()), ("name", pa.int64()), ("salts", pa.int32())])

    def several(bucket: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, name = np.concatenate(parts, 1)
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        once = new | np.concatenate(([True], name[1:] != name[:-1]))
        sig, name, new = sig[once], name[once], new[once]
        count = np.diff(np.append(np.flatnonzero(new), len(sig)))
        count = np.repeat(count, count)
        sig, name, count = (x[count > 1] for x in (sig | U(bucket << 40), name, count))
        for lo in range(0, len(sig), 1 << 16):
            yield batch(schema, *(x[lo : lo + (1 << 16)] for x in (sig.view(np.int64), name.view(np.int64), -(-count // WIDE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for b in batches:
            for own, pack in zip(b.column(0).to_pylist(), b.column(1)):
                if own != bucket:
                    if parts:
                        yield from several(bucket, parts)
                    bucket, parts = own, []
                parts.append(unpacked(pack.as_buffer()))
        if parts:
            yield from several(bucket, parts)

    return packs.mapInArrow(lean(run), "sig long, name long, salts int")


def near(size: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may link, by their sizes and cells: a matrix."""
    m = len(size)
    apart = np.empty((m, m), np.int64)
    for i in range(m):
        apart[i] = np.abs(counts - counts[i]).sum(1, dtype=np.int64)
    return apart * (100 + percent) <= (size[:, None] + size[None, :]) * (100 - percent)


#: Signs by which cells are summed: differences of such sums never exceed those of sets.
SIGNS = np.stack([1 - 2 * ((mix64(np.arange(CELLS, dtype=U) + U(1)) >> U(j)) & U(1)).astype(np.int64) for j in range(2)], 1)


def _bucket_edges(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges that span, in each bucket of a signature, the classes that may
    link by their cells. ``shared``: sig, salt, salts, member, n_shingles, cells,
    sorted by bucket and salt. A bucket dealt to several tasks sends bins besides:
    (sig, x, y, a), where a stands for the bin's classes."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "sig", "x", "y")])
    table = bands(percent, 1 << 40)

    def edges(sig: int, rows: list[tuple], split: bool) -> list[tuple]:
        rows = sorted({r[0]: r for r in rows}.values())
        ids = [r[0] for r in rows]
        counts = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), CELLS).astype(np.int16)
        if not split:
            label = _forest(near(np.array([r[1] for r in rows]), counts, percent))
            return [(ids[i], ids[label[i]], None, None, None) for i in np.flatnonzero(label != np.arange(len(rows))).tolist()]
        apart = 2 * table[sig & 255][1] * (100 - percent) // (100 + percent) + 1
        bins = (counts.astype(np.int64) @ SIGNS) // apart
        first: dict[tuple, int] = {}
        out = []
        for i, place in zip(ids, map(tuple, bins.tolist())):
            if (least := first.setdefault(place, i)) != i:
                out.append((i, least, None, None, None))
        return out + [(i, None, sig, x, y) for (x, y), i in first.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, done = None, [], set()
        for batch_ in batches:
            found = []
            for s, salt, salts, *row in zip(*(c.to_pylist() for c in batch_.columns)):
                if (s, salt) != bucket:
                    if rows and (len(rows) > 1 or split):
                        found += edges(bucket[0], rows, split)
                    bucket, rows, split = (s, salt), [], salts > 1
                rows.append(tuple(row))
            new = [e for e in dict.fromkeys(found) if e not in done]
            # edges met again in the task are sent once, as far as memory allows
            done = set(new) if len(done) > 50_000 else done.union(new)
            if new:
                yield batch(schema, *zip(*new))
        if rows and (last := edges(bucket[0], rows, split)):
            yield batch(schema, *zip(*last))

    return shared.select("sig", "salt", "salts", "member", "n_shingles", "cells").mapInArrow(lean(run), "a long, b long, sig long, x long, y long")


def families(docs: DataFrame, kinds: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of classes joined by a shared signature and by cells that allow
    a link. ``kinds``: h1, n_shingles, cells."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(9, (8 * parts - 1).bit_length())
    shared = _shared(_signed(docs, words, percent, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket"))
    # classes of equal 40 bits come along; more candidates do no harm
    named = kinds.select(F.col("h1").bitwiseAND(F.lit((1 << 40) - 1)).alias("name"), F.col("h1").alias("member"), "n_shingles", "cells")
    held = shared.join(named, "name")
    held = held.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    found = stored(_bucket_edges(held.repartition(parts, "sig", "salt").sortWithinPartitions("sig", "salt", "member"), percent), "candidates")
    tidy(docs.sparkSession)
    # bins of wide buckets: one class stands for each, and hangs on those of neighbours
    bins = stored(found.filter("b is null").groupBy("sig", "x", "y").agg(F.min("a").alias("least"), F.collect_set("a").alias("all")), "bins")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = bins.select("sig", F.explode(steps).alias("d"), "x", "y", F.col("least").alias("a")).select("sig", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), "a")
    beside = ahead.join(bins.select("sig", "x", "y", F.col("least").alias("b")), ["sig", "x", "y"]).select("a", "b")
    within = bins.select(F.explode("all").alias("a"), F.col("least").alias("b"))
    return components(found.filter("b is not null").select("a", "b").unionByName(within).unionByName(beside))


def _forest(linked: np.ndarray) -> np.ndarray:
    """Label of each node, the least index it reaches, by rounds over the matrix."""
    label = np.arange(len(linked))
    far = len(linked)
    while True:
        low = np.concatenate([np.minimum(label[i : i + 256], np.where(linked[i : i + 256], label[None, :], far).min(1)) for i in range(0, far, 256)])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` (indexes) link with which of ``right``."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    code = np.cumsum(new) - 1
    shared = np.bincount(code)[code] > 1
    code, owner = code[shared], owner[shared]
    common = np.zeros((len(left), len(right)))
    if len(code):
        code = np.cumsum(np.concatenate(([True], code[1:] != code[:-1]))) - 1
        for start in range(0, int(code[-1]) + 1, 2048):
            lo, hi = np.searchsorted(code, [start, start + 2048])
            held = np.zeros((len(sets), 2048), np.float32)
            held[owner[lo:hi], code[lo:hi] - start] = 1
            common += held[left] @ held[right].T
    union = size[left][:, None] + size[right][None, :] - common
    return 100 * common >= percent * union


def tiles(side: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Stretches of ``side`` (indexes of sets) of at most ``BLOCK`` sets and ``TILE``
    elements; a larger set is alone."""
    out, start, size = [], 0, 0
    for i, k in enumerate(side.tolist()):
        if i > start and (i - start == BLOCK or size + len(sets[k]) > TILE):
            out.append(side[start:i])
            start, size = i, 0
        size += len(sets[k])
    return out + [side[start:]] if start < len(side) else out


def _compared(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (a, b, links): an edge of a spanning forest where b is given, else the
    number of a's links found in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(rows: list) -> pa.RecordBatch:
        ids, copies, block, x, y = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        sets = [r[5] for r in rows]
        degree, parent = np.zeros(len(rows), np.int64), list(range(len(rows)))
        edges: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        same = x[0] == y[0]
        sides = [tiles(np.flatnonzero(block == which), sets) for which in (x[0], y[0])]
        for i, left in enumerate(sides[0]):
            for right in sides[1][i if same else 0 :]:
                one = same and left[0] == right[0]
                both = left if one else np.concatenate((left, right))
                a, b = np.arange(len(left)), np.arange(len(both) - len(right), len(both))
                link = linked_pairs([sets[k] for k in both.tolist()], a, b, percent)
                if one:
                    np.fill_diagonal(link, False)
                degree[left] += link.astype(np.int64) @ copies[right]
                if not one:
                    degree[right] += link.T.astype(np.int64) @ copies[left]
                whole = np.zeros((len(both), len(both)), bool)
                whole[np.ix_(a, b)] = link
                label = _forest(whole | whole.T)
                for k in np.flatnonzero(label != np.arange(len(both))).tolist():
                    p, q = find(both[k]), find(both[label[k]])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((int(ids[both[k]]), int(ids[both[label[k]]])))
        found = np.flatnonzero(degree)
        a = [e[0] for e in edges] + ids[found].tolist()
        return batch(schema, a, [e[1] for e in edges] + [None] * len(found), [0] * len(edges) + degree[found].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            fixed = [b.column(i).to_pylist() for i in range(6)]
            for lo, sets in _runs(b.column(6), words):
                for i, s in enumerate(sets, lo):
                    key = fixed[0][i], fixed[4][i], fixed[5][i]
                    if key != group:
                        if len(rows) > 1:
                            yield compare(rows)
                        group, rows = key, []
                    # rows of one id may hold other texts, or the class once more
                    if digest(s)[0] == fixed[1][i] and not (rows and rows[-1][0] == fixed[1][i]):
                        rows.append((fixed[1][i], fixed[2][i], fixed[3][i], fixed[4][i], fixed[5][i], s))
        if len(rows) > 1:
            yield compare(rows)

    return members.select("family", "h1", "copies", "block", "x", "y", "text").mapInArrow(lean(run), "a long, b long, links long")


def _solved(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, h1, h2; classes: h1, h2, rep, copies, root, n_links),
    where rep is a class's least doc_id and root names its component."""
    info = stored(described(docs, words), "sets")
    some = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "bytes", "mark")).alias("rep")
    kinds = info.filter("n_shingles > 0").groupBy("h1", "h2").agg(some, F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("cells").alias("cells"))
    kinds = stored(kinds.select("h1", "h2", "rep.doc_id", "rep.bytes", "rep.mark", "copies", "n_shingles", "cells"), "classes")
    grouped = families(docs, kinds, words, percent)
    roots = grouped.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    owned = stored(kinds.select("h1", "doc_id", "mark", "copies", "bytes").join(grouped.unionByName(roots).withColumnsRenamed({"node": "h1", "root": "family"}), "h1"), "members")
    # large families alone have several blocks
    sizes = owned.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    by_count, by_bytes = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)
    large = sizes.select("family", "n", F.greatest(F.least(by_count, F.lit(BLOCKS)), by_bytes).alias("blocks")).filter("blocks > 1")
    members = spread_join(owned.select("family", "h1", "doc_id", "mark", "copies"), stored(large, "large-families"), ["family"], "n")
    members = members.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_mark"), "text")
    # most texts are alone: a sieve keeps them out of the exchange
    texts, _ = sifted(texts, F.xxhash64("_doc", "_mark"), owned.select(F.xxhash64("doc_id", "mark").alias("h")))
    wide = members.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))).select("family", "h1", "copies", "block", F.explode(tasks).alias("task"), "text")
    wide = wide.select("family", "h1", "copies", "block", "task.x", "task.y", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["family", "x", "y", "h1"]
    found = stored(_compared(wide.repartition(parts, *order[:3]).sortWithinPartitions(*order), words, percent), "links")
    tidy(docs.sparkSession)
    linked = components(found.filter("b is not null").select("a", "b"))
    degree = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    named = kinds.join(linked.withColumnRenamed("node", "h1"), "h1", "left").join(degree.withColumnRenamed("a", "h1"), "h1", "left")
    named = named.select("h1", "h2", F.col("doc_id").alias("rep"), "copies", F.coalesce("root", "h1").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return info.select("doc_id", "n_shingles", "h1", "h2"), stored(named, "named")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, component_id (the least doc_id reachable by links)
    and n_links (other rows that it links with)."""
    info, named = _solved(docs, words, percent)
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    known = stored(spread_join(named, least, ["root"], "n").select("h1", "h2", "copies", "component_id", "n_links"), "known")
    out = spread_join(info, known, ["h1", "h2"], "copies")
    apart = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "n_shingles", F.when(apart, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(apart, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component left: that of the least doc_id, and of
    rows with that id one of its class. Rows without words are in no component; all
    stay."""
    info, named = _solved(docs, words, percent)
    # the class that stays for each component
    pick = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h1", "h2")).alias("p")
    stays = named.groupBy("root").agg(pick).select("p.h1", "p.h2", F.col("p.rep").alias("keeper"), F.lit(True).alias("stays"))
    judged = stored(named.join(stays, ["h1", "h2"], "left").select("h1", "h2", "copies", "keeper", F.coalesce("stays", F.lit(False)).alias("stays")), "stays")
    rows = spread_join(info, judged, ["h1", "h2"], "copies")
    kept = (F.col("n_shingles") == 0) | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("keeper")))
    marked = stored(rows.select("doc_id", "h1", "h2", "n_shingles", kept.alias("kept")), "marked")
    # ids of several rows (or none) are told apart by their sets, all others by the id
    name = fresh(docs, "_id")
    several = stored(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(name)), "repeated-ids")
    own = F.col("doc_id").cast("long")
    gone = stored(marked.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(name)).unionByName(several.filter(F.col(name).isNotNull())).distinct(), "gone")
    some, others = sifted(docs.filter(own.isNotNull()), F.xxhash64(own), gone.select(F.xxhash64(name).alias("h")))
    plain = some.join(gone, own == F.col(name), "left_anti")
    plain = plain if others is None else plain.unionByName(others)
    if several.isEmpty():
        return plain
    odd = docs.select(whole_row(docs), own.alias("_doc"), "text").join(several, F.col("_doc").eqNullSafe(F.col(name)), "left_semi")

    @F.pandas_udf("array<bigint>")
    def marks(texts):
        import pandas as pd

        out = []
        for _, sets in _runs(pa.array(texts, pa.string()), words):
            out += [[*digest(s), len(s)] for s in sets]
        return pd.Series(out, dtype=object)

    odd = odd.withColumn("_m", marks("text")).select("_row", "_doc", F.col("_m")[0].alias("h1"), F.col("_m")[1].alias("h2"), F.col("_m")[2].alias("n"))
    keys = marked.filter("kept and n_shingles > 0").select(F.col("doc_id").alias("_kept_doc"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2")).distinct()
    match = (F.col("h1") == F.col("_k1")) & (F.col("h2") == F.col("_k2")) & F.col("_doc").eqNullSafe(F.col("_kept_doc"))
    # a row of least hash stays of rows with one id and class
    one = odd.filter("n > 0").join(keys, match, "left_semi").groupBy("_doc", "h1", "h2").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return plain.unionByName(one.select("_row.*")).unionByName(odd.filter("n = 0").select("_row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.size + q.size - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles,
       (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id)::BIGINT AS component_id,
       (SELECT count(*) FROM both_ways WHERE both_ways.x = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
"""
