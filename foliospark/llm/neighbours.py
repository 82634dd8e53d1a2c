"""Most similar vectors by shifted space-filling curves: Hilbert orderings, key windows, rerank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.topn import top_n
from foliospark.session import spread

#: Range-partitioned Hilbert orderings; further orderings of the rows of each range, at least; dimensions and
#: bits a dimension of an ordering; rows of a key window, at least.
CURVES, TURNS, DIMENSIONS, BITS, WINDOW = 6, 2, 12, 4, 1024
#: Rows that are compared with their window at once, and rows of a range that are held at once.
BLOCK, RANGE_ROWS = 512, 131_072
#: Columns of a comparison at once; distinct vectors that a range should have; vectors sampled of each range.
SPAN, RANGE, SAMPLED = 8192, 65_536, 128
#: Rows of a range that are compared with all others in it, and the share of their neighbours that its windows must find.
CHECKED, ENOUGH = 128, 0.9
#: Bytes of the digest that stands for a vector: 96 bits.
ID_BYTES = 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows: points), as unsigned 64-bit integers.

    The transposed form of the index is found bit plane by bit plane, by undoing the curve's rotations.
    """
    planes = cells.astype(np.uint32).T.copy()
    dims = len(planes)
    for bit in range(bits - 1, 0, -1):
        top, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for d in range(dims):
            inverted = (planes[d] & top) != 0
            swap = np.where(inverted, 0, (planes[0] ^ planes[d]) & low).astype(np.uint32)
            planes[0] ^= np.where(inverted, low, swap).astype(np.uint32)
            planes[d] ^= swap
    for d in range(1, dims):
        planes[d] ^= planes[d - 1]
    turn = np.zeros_like(planes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(planes[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    planes ^= turn
    keys = np.zeros(cells.shape[0], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = (keys << np.uint64(1)) | ((planes[d] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64)
    return keys


def projection(curve: int, width: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and the shift of one curve."""
    random = np.random.default_rng([seed, curve])
    return np.linalg.qr(random.normal(size=(width, dims)))[0].astype(np.float32), random.uniform(-0.5, 0.5, dims).astype(np.float32)


def curve_keys(vectors: np.ndarray, curve: int, dims: int, bits: int, seed: int, local: bool = False) -> np.ndarray:
    """Keys of unit vectors along one shifted curve; with ``local`` its cells are as fine as these vectors lie close."""
    directions, shift = projection(curve, vectors.shape[1], dims, seed)
    spread = (vectors @ directions) * np.sqrt(np.float32(vectors.shape[1]))
    if local:
        spread = (spread - spread.mean(axis=0)) / np.maximum(spread.std(axis=0), np.float32(1e-6))
    cells = np.clip(((spread + shift) / 8 + 0.5) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def squeeze(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as 12-bit integers, two in three bytes; the scale cancels out in a cosine."""
    whole = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 2047).astype(np.int16) + 2048
    whole = whole.astype(np.uint16)
    if whole.shape[1] % 2:
        whole = np.pad(whole, ((0, 0), (0, 1)), constant_values=2048)
    a, b = whole[:, 0::2], whole[:, 1::2]
    return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], axis=2).astype(np.uint8).reshape(len(whole), -1)


def unsqueeze(packed: np.ndarray) -> np.ndarray:
    """Unit vectors of what ``squeeze`` made; cosines are within about 0.0001 of the originals'."""
    triples = packed.reshape(len(packed), -1, 3).astype(np.int32)
    whole = np.empty((len(packed), triples.shape[1] * 2), np.float32)
    whole[:, 0::2] = (triples[:, :, 0] << 4 | triples[:, :, 1] >> 4) - 2048
    whole[:, 1::2] = ((triples[:, :, 1] & 15) << 8 | triples[:, :, 2]) - 2048
    return whole / np.linalg.norm(whole, axis=1, keepdims=True)


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values (float32) of the vectors of ``width`` finite numbers that are not all zero."""
    if column.null_count == len(column):
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    offsets = column.offsets.to_numpy()
    right = np.diff(offsets) == width
    if column.null_count:
        right &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # a null number is NaN
    vectors = values[offsets[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width), np.float32)
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return rows[good], vectors[good]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; first divided by their largest value, so that no square over- or underflows."""
    scaled = (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float64)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _key(owner: bytes) -> bytes:
    """An owner's name as the key of a digest, which takes 64 bytes: longer names by a digest of their own."""
    return owner if len(owner) < 64 else hashlib.blake2b(owner).digest()


def vector_ids(vectors: np.ndarray, owners: list[bytes] | None) -> list[bytes]:
    """Digests of the vectors as they stand, with their owners' names if they are told apart by owner."""
    plain = vectors + np.float32(0)  # -0 is 0
    return [hashlib.blake2b(v.tobytes(), digest_size=ID_BYTES, key=(_key(owners[i]) if owners else b"")).digest() for i, v in enumerate(plain)]


def _fixed(data: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    rows, width = data.shape
    offsets = pa.py_buffer((np.arange(rows + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    offsets = column.offsets.to_numpy() if hasattr(column, "offsets") else np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


class _Best:
    """The k best neighbours of each row, by row number."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.sims, self.rows = np.full((rows, k), -2, np.float32), np.full((rows, k), -1, np.int32)

    def offer(self, to: np.ndarray, found: np.ndarray, columns: np.ndarray, least: float) -> None:
        """Offer the rows ``to`` the best of ``columns``, given their similarities, from ``least`` up."""
        some = np.flatnonzero((found >= least).any(axis=1))
        if not len(some):
            return
        part, to = found[some], to[some]
        k = min(self.k, part.shape[1])
        at = np.argpartition(-part, k - 1, axis=1)[:, :k] if k < part.shape[1] else np.tile(np.arange(k), (len(part), 1))
        sims, rows = np.take_along_axis(part, at, 1), columns[at].astype(np.int32)
        held = (rows[:, :, None] == self.rows[to][:, None, :]).any(axis=2)
        sims = np.where((sims >= least) & ~held, sims, -2)
        sims, rows = np.concatenate([self.sims[to], sims], axis=1), np.concatenate([self.rows[to], rows], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : self.k]
        self.sims[to], self.rows[to] = np.take_along_axis(sims, order, 1), np.take_along_axis(rows, order, 1)


def sweep(vectors: np.ndarray, owners: np.ndarray | None, order: np.ndarray, best: _Best, window: int, least: float) -> None:
    """Compare every vector with those up to ``window`` places behind it in ``order``, both ways."""
    vectors = vectors[order]
    owners = None if owners is None else owners[order]
    for start in range(0, len(order), BLOCK):
        end = min(start + BLOCK, len(order))
        far = min(end + window, len(order))
        for left in range(start, far, SPAN):
            right = min(left + SPAN, far)
            found = vectors[start:end] @ vectors[left:right].T
            if left == start:
                np.fill_diagonal(found, -2)
            if owners is not None:
                found[owners[start:end, None] == owners[None, left:right]] = -2
            best.offer(order[start:end], found, order[left:right], least)
            cut = max(left, end)
            if right > cut:
                best.offer(order[cut:right], np.ascontiguousarray(found[:, cut - left :].T), order[start:end], least)


def share_found(vectors: np.ndarray, owners: np.ndarray | None, best: _Best, least: float) -> float:
    """The share of the neighbours of ``CHECKED`` rows, taken evenly, that ``best`` has; all rows are compared."""
    rows = np.unique(np.linspace(0, len(vectors) - 1, CHECKED).astype(np.int64))
    found = vectors[rows] @ vectors.T
    found[np.arange(len(rows)), rows] = -2
    if owners is not None:
        found[owners[rows, None] == owners[None, :]] = -2
    k = min(best.k, len(vectors))
    top = np.partition(found, len(vectors) - k, axis=1)[:, -k:]
    wanted = (top >= least).sum(axis=1)
    limit = np.maximum(top.min(axis=1), least) - 1e-6
    had = np.minimum((best.sims[rows] >= limit[:, None]).sum(axis=1), wanted)
    return had.sum() / wanted.sum() if wanted.any() else 1.0


def cuts_of(keys: np.ndarray, share: float, rows: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ranges of a curve begin but the first, and up to which key they share their rows with the range before.

    ``keys`` are those of a sample of ``share`` of all vectors; a range gets about ``rows`` vectors and shares
    ``window`` of them or more.
    """
    keys = np.sort(keys)
    ranges = max(1, int(np.ceil(len(keys) / share / rows)))
    at = len(keys) * np.arange(1, ranges) // ranges
    expected = window * share
    more = int(np.ceil(expected + (3 * np.sqrt(expected) if share < 1 else 0)))
    cuts, first = np.unique(keys[at], return_index=True)
    return cuts, keys[np.minimum(at[first] + more, len(keys) - 1)]


def _windows(k: int, least: float, window: int, width: int, exclude: bool, turns: int, dims: int, bits: int, seed: int, curve_of: list[int]):
    """Compares the vectors of a range within key windows, along its own curve and a few further ones.

    Where these find too few of the neighbours of a sample of rows, the range is dense: more curves follow, fitted to
    it, each with a window twice as wide, until enough are found or a window holds the whole range.
    """
    packed_width = (width + width % 2) // 2 * 3

    def compare(curve: int, ids: np.ndarray, packed: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate(([True], ids[1:] != ids[:-1]))  # a vector that several tasks sent
        ids, owners, vectors = ids[fresh], owners[fresh] if exclude else None, unsqueeze(packed[fresh])
        best = _Best(len(ids), k)
        sweep(vectors, owners, np.arange(len(ids)), best, window, least)
        for turn in range(1, turns + 1):
            keys = curve_keys(vectors[:, :width], 1000 * turn + curve, dims, bits, seed)
            sweep(vectors, owners, np.argsort(keys, kind="stable"), best, window, least)
        reach, turn = window, turns
        while reach < len(ids) and share_found(vectors, owners, best, least) < ENOUGH:
            reach, turn = 2 * reach, turn + 1
            keys = curve_keys(vectors[:, :width], 1000 * turn + curve, dims, bits, seed, local=True)
            sweep(vectors, owners, np.argsort(keys, kind="stable"), best, reach, least)
        keep = best.sims >= least
        count = keep.sum(axis=1)
        some = np.flatnonzero(count)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count[some]))), pa.int32())
        near = ids[best.rows[keep]].view(np.uint8).reshape(-1, ID_BYTES)
        inner = pa.StructArray.from_arrays([pa.array(best.sims[keep]), _fixed(near)], ["sim", "id"])
        return pa.RecordBatch.from_arrays([_fixed(ids[some].view(np.uint8).reshape(-1, ID_BYTES)), pa.ListArray.from_arrays(offsets, inner)], ["id", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at_range, size = -1, 0

        def flush(more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                whole = tuple(np.concatenate(x) for x in zip(*held))
                yield compare(curve_of[at_range], *whole)
                held.clear()
                if more:  # what follows in the range shares a window of rows with this
                    held.append(tuple(x[-window:] for x in whole))
            size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = batch.column(0).to_numpy(zero_copy_only=False)
            ids = _bytes_of(batch.column(1), ID_BYTES).copy().view(f"V{ID_BYTES}").reshape(-1)
            packed, owners = _bytes_of(batch.column(2), packed_width).copy(), batch.column(3).to_numpy(zero_copy_only=False)
            for r in np.unique(ranges):
                if r != at_range or size >= RANGE_ROWS:
                    yield from flush(r == at_range)
                    at_range = int(r)
                at = ranges == r
                held.append((ids[at], packed[at], owners[at]))
                size += int(at.sum())
        yield from flush(False)

    return run


def _items(df: DataFrame, item: str, vector: str, owner: str | None) -> DataFrame:
    who = F.col(f"`{owner}`").cast("string") if owner else F.lit(None).cast("string")
    return df.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{vector}`").cast("array<float>").alias("vector"), who.alias("owner")).where("item is not null and vector is not null")


def nearest(
    df: DataFrame,
    item: str,
    vector: str,
    k: int = 5,
    least: float = 0.8,
    width: int = 128,
    owner: str | None = None,
    curves: int = CURVES,
    turns: int = TURNS,
    dims: int = DIMENSIONS,
    bits: int = BITS,
    window: int = WINDOW,
    seed: int = 11,
    range_rows: int = RANGE,
) -> DataFrame:
    """For every item its ``k`` most similar other items of cosine ``least`` or more: item, neighbour, place.

    Every vector is projected and placed on several shifted Hilbert curves.  The curves are cut into ranges of
    about ``range_rows`` distinct vectors, whatever the session's partitions, by the keys of a sample that is
    drawn when this is called; each range also gets the first ``window`` rows of the next.  Within a range each
    vector is compared with the ``window`` vectors on either side, along the range's curve and along ``turns``
    further curves over the rows of the range, which need no shuffle.  Some rows are compared with the whole
    range: while too few of their neighbours are found, further curves with windows twice as wide follow.  The
    best of all are merged.  Similar vectors are close on some curve with a high probability, so a small share
    of neighbours is missed (see the README for the recall measured).  Vectors travel as 12-bit integers,
    which moves a cosine by some 0.0001 at most.

    Equal vectors travel as one: a task sends each distinct vector once, and copies are added afterwards, so
    a group of copies costs as much as one vector.  Among copies, which are equally similar, the greater item
    comes first.  With ``owner``, items of one owner aren't neighbours of each other.

    Only vectors of ``width`` finite numbers, not all zero, count; rows with a null item or vector don't.  A
    repeated row counts once; an item with several vectors is represented by one of them, always the same.
    Other columns are dropped; an empty table gives no rows.
    """
    if dims * bits > 63:
        raise ValueError("a key has at most 63 bits")
    rows = spread(_items(df, item, vector, owner))
    range_rows = max(range_rows, 4 * window)
    share = min(1.0, max(SAMPLED / range_rows, 4096 / max(df.count(), 1)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            at, vectors = usable(batch.column(1), width)
            names = batch.column(2).to_pylist() if owner else None
            ids = vector_ids(vectors, [(names[i] or "").encode() for i in at] if owner else None)
            new = []
            for i, v in enumerate(ids):
                if int.from_bytes(v[:6], "big") < share * 2**48 and v not in sent:
                    sent.add(v)
                    new.append(i)
            if new:
                vectors = unit(vectors[new])
                keys = np.stack([curve_keys(vectors, c, dims, bits, seed).astype(np.int64) for c in range(curves)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in new], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["id", "keys"])

    drawn = {r["id"]: r["keys"] for r in rows.mapInArrow(draw, "id binary, keys array<bigint>").collect()}
    drawn_keys = np.array([drawn[i] for i in sorted(drawn)], np.int64).reshape(-1, curves)
    cuts = [cuts_of(drawn_keys[:, c], share, range_rows, window) for c in range(curves)]
    curve_of = [c for c in range(curves) for _ in range(len(cuts[c][0]) + 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            at, vectors = usable(batch.column(1), width)
            if not len(at):
                continue
            names = batch.column(2).to_pylist() if owner else None
            ids = vector_ids(vectors, [(names[i] or "").encode() for i in at] if owner else None)
            new = []
            for i, v in enumerate(ids):
                if v not in sent:
                    sent.add(v)
                    new.append(i)
            if not new:
                continue
            vectors = unit(vectors[new])
            id_column = _fixed(np.frombuffer(b"".join(ids[i] for i in new), np.uint8).reshape(-1, ID_BYTES))
            packed = _fixed(squeeze(vectors))
            owners = [int.from_bytes(hashlib.blake2b((names[at[i]] or "").encode(), digest_size=8).digest(), "big", signed=True) for i in new] if owner else [0] * len(new)
            for c in range(curves):
                keys = curve_keys(vectors, c, dims, bits, seed).astype(np.int64)
                starts, ends = cuts[c]
                own = np.searchsorted(starts, keys, side="right")
                shared = np.flatnonzero(keys <= np.concatenate(([-1], ends))[own])
                out = pa.RecordBatch.from_arrays([pa.array((own + curve_of.index(c)).astype(np.int32)), pa.array(keys), id_column, packed, pa.array(owners, pa.int64())], ["range", "key", "id", "packed", "owner"])
                yield out
                if len(shared):
                    before = pa.array((own[shared] + curve_of.index(c) - 1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([before, *out.take(pa.array(shared)).columns[1:]], out.schema.names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = usable(batch.column(1), width)
            names = batch.column(2).to_pylist() if owner else None
            ids = vector_ids(vectors, [(names[i] or "").encode() for i in at] if owner else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, pa.binary())], ["item", "id"])

    placed = rows.mapInArrow(place, "range int, key bigint, id binary, packed binary, owner bigint")
    ordered = placed.repartitionById(len(curve_of), F.col("range")).sortWithinPartitions("range", "key", "id")
    near = ordered.select("range", "id", "packed", "owner").mapInArrow(_windows(k, least, window, width, owner is not None, turns, dims, bits, seed, curve_of), "id binary, near array<struct<sim: float, id: binary>>")
    pairs = near.repartition("id").select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.id").alias("other")).agg(F.max("n.sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), F.desc("other"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    members = rows.mapInArrow(name, "item string, id binary").groupBy("item").agg(F.min("id").alias("id"))
    # Of each class of equal vectors the k + 1 greatest items: enough to fill any list.
    heads = top_n(members.withColumn("code", F.hex("id")).withColumn("one", F.lit(1.0)).withColumn("limit", F.lit(k + 1)), ["code"], "item", "one", "limit")
    heads = heads.groupBy(F.unhex("code").alias("id")).agg(F.expr("transform(array_sort(collect_list(struct(place, item))), x -> x.item)").alias("heads"))
    named = ranked.join(heads.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(rank, heads))), x -> x.heads))").alias("others"))
    classes = heads.join(named, "id", "left")
    own = "filter(heads, x -> x <> item)" if owner is None else "cast(array() as array<string>)"
    lists = members.join(classes, "id").select("item", F.expr(f"slice(concat({own}, coalesce(others, cast(array() as array<string>))), 1, {k})").alias("list"))
    return lists.select("item", F.posexplode("list").alias("at", "neighbour")).select("item", "neighbour", (F.col("at") + 1).alias("place"))


def similar_pairs(df: DataFrame, item: str, vector: str, a: str = "document_a", b: str = "document_b", **options) -> DataFrame:
    """Pairs of items (``a`` < ``b``) of which either is among the other's nearest; see ``nearest``."""
    found = nearest(df, item, vector, **options)
    return found.select(F.least("item", "neighbour").alias(a), F.greatest("item", "neighbour").alias(b)).distinct()
