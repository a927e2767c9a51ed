"""Fuzzy line dedup.

A line counts in lower case (A-Z) with white space collapsed; blank lines always stay. Its shingles are the runs of
SHINGLE characters that begin at every character; a shorter line is one shingle. Lines are alike at a Jaccard
similarity of shingles of PERCENT or more.

Signature: the hashes of the shingles in two orders, and in each the first hash at or after each of POINTS even points of
the circle. Each of these 128 values is the same in two lines with the probability of their similarity. Bands of six
values (three of each order), 42 of them, are the keys that candidates share: were the values independent, a pair at 0.8
would share none with a probability of 0.00006, and one at 0.06 one with 0.000002. Values of lines with fewer than SHORT shingles repeat, so these lines have
the keys of 16 bands of four values as well. The lowest bits of every second value are a sketch of 64 bits, which sorts out
unlike pairs; where both lines have enough shingles for their values to be nearly independent (FILLED points), the values' PLANES lowest
bits are compared as well. Were they independent, a pair at 0.8 would fail that test with a probability of 4e-9 and the first with 2e-8. Equal lines (by a 128-bit hash) are one kind, and only kinds are signed. Candidates are verified on their full
shingle sets, and linking.linked joins them into components without the pairs of a group. One line a component stays:
the first by doc_id and position.

Splitting, signing and comparing sets, and finding the keys that lines share, run in Arrow batches: as DataFrame functions they took several times the CPU time
that the check tool allows (README). Joins and union-find are DataFrame functions. A task holds a slice of SLICE characters,
or one line if that is longer, at about 100 bytes a character.

Texts are read once. Lines are shuffled by their hash, with one row a kind and task; then kinds answer the lines that repeat or are
linked, so a frequent line is met by a join that adaptive execution can split.
Null and empty texts have no lines. Rows with a null doc_id come first in order. Repeated rows are rows of
their own: the lines of the second are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from .common import Saved, save
from .linking import linked
from .search import _pack, _spread, _unpack

SHINGLE, PERCENT = 5, 80
POINTS, WIDTH, USES = 64, 6, 2
#: Lines with fewer shingles have narrow bands as well: their values repeat, which makes wide bands agree less often.
SHORT = 100
#: Bits in which the sketches of a pair may differ: 6.4 of 64 at a similarity of 0.8, with a deviation of 2.4.
APART = 22
#: Sketches a line has, one of each of the values' lowest bits; values that may differ in these bits where both lines have FILLED points at least.
PLANES, FILLED, DIFFERENT = 4, 48, 32
SKETCHES = [f"sketch{k}" for k in range(PLANES)]
#: The shingles as a pattern.
PATTERN = rf"(?s)(?=(.{{{SHINGLE}}}|^.{{1,{SHINGLE - 1}}}(?!.)))."
#: Characters and rows that are signed or compared at once; rows must fit into the bits above ORDER.
SLICE, ROWS, ORDER = 1 << 17, 1 << 14, 48
#: Band keys that a task holds at once, packed or unpacked.
PART_KEYS = 1 << 20
#: Pairs whose texts are shuffled at once, to be verified.
PAIRS = 1 << 19
#: Rows of a cell that are compared pair by pair; bytes of a larger one whose shingles are held at once.
SMALL, CELL_BYTES = 12, 1 << 20
_rng = np.random.default_rng(20240310)
#: A shingle's hash is the sum of its characters' codes, each times its place's number, mixed.
PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands() -> np.ndarray:
    """Rows of WIDTH places of values, half of them of each order; every value is in USES rows at most, and neighbours in different ones."""
    half, rows = WIDTH // 2, POINTS // (WIDTH // 2)
    found = []
    for _ in range(USES):
        a, b = (_rng.permutation(rows)[:, None] + rows * np.arange(half) for _ in range(2))
        turn = _rng.integers(0, POINTS, 2)
        found.append(np.concatenate([(a + turn[0]) % POINTS, (b + turn[1]) % POINTS + POINTS], axis=1))
    return np.concatenate(found)


CHOSEN = _bands()
BANDS = len(CHOSEN)
NARROW = np.arange(POINTS).reshape(4, -1).T


def lines(text: Column) -> Column:
    """Array of the text's lines."""
    return F.when(F.length(text) > 0, F.split(text, "\n"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h *= np.uint64(odd)
        h ^= h >> np.uint64(33)
    return h


def shingles(norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines that are not blank, in order with repeats, and how many each line has."""
    codes = np.frombuffer("".join(norm.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = pc.utf8_length(norm).to_numpy(zero_copy_only=False).astype(np.int64)
    short = np.flatnonzero(length < SHINGLE)
    if len(short):  # a shorter line is filled up with zeros, which no character has
        codes = np.insert(codes, np.repeat(np.cumsum(length)[short], SHINGLE - length[short]), 0)
        length[short] = SHINGLE
    ends = len(codes) - SHINGLE + 1
    runs = codes[:ends] * PLACES[0]
    for i in range(1, SHINGLE):
        runs += codes[i : ends + i] * PLACES[i]
    inside = np.ones(len(codes), bool)  # no shingle reaches from one line into the next
    inside[(np.cumsum(length)[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return mixed(runs[inside[:ends]]), length - SHINGLE + 1


def signed(norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches, and rows of band keys, of lines that are not blank."""
    planes, _, keys, _ = sketched(*shingles(norm))
    return planes[:, 0], keys


def sketched(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines with these shingles: rows of PLANES sketches (of the values' lowest bit, the next one, ..., at every second point), how many
    of those points have a hash before the next one, rows of band keys, and rows of the narrow bands' keys."""
    n = len(counts)
    filled = np.zeros(n, np.int32)
    row = np.repeat(np.arange(n) * POINTS, counts)
    values = []
    for salt in SALTS:
        order = hashes * salt  # the hashes are mixed, so the upper bits of a product are an order
        order >>= np.uint64(64 - ORDER)
        least = np.full(n * POINTS, np.uint64(1) << np.uint64(ORDER))
        place = (order >> np.uint64(ORDER - POINTS.bit_length() + 1)).view(np.int64)
        place += row
        np.minimum.at(least, place, order)
        least = least.reshape(n, POINTS)
        filled += (np.minimum(least[:, ::2], least[:, 1::2]) >> np.uint64(ORDER) == 0).sum(axis=1, dtype=np.int32)
        gaps = np.flatnonzero((least >> np.uint64(ORDER)).any(axis=1))  # behind the last hash comes the first
        for at in range(0, len(gaps), ROWS):
            some = gaps[at : at + ROWS]
            found = least[some] >> np.uint64(ORDER) == 0
            place = np.where(found, np.arange(POINTS), 2 * POINTS)
            place = np.minimum.accumulate(np.concatenate([place, place + POINTS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :POINTS] % POINTS
            least[some] = np.take_along_axis(least[some], place, axis=1)
        values.append(least)
    own = np.concatenate(values, axis=1)
    half = own[:, ::2]
    bits = [(half >> np.uint64(k)).astype(np.uint8) & np.uint8(1) for k in range(PLANES)]
    return np.concatenate([np.packbits(b, axis=1).view(np.int64) for b in bits], axis=1), filled, banded(own, CHOSEN, 1), banded(half, NARROW, BANDS + 1)


def banded(values: np.ndarray, places: np.ndarray, first: int) -> np.ndarray:
    """Keys of the bands, which are numbered from `first`."""
    keys = np.broadcast_to(np.arange(first, first + len(places), dtype=np.uint64), (len(values), len(places)))
    for k in range(places.shape[1]):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + values[:, places[:, k]]
        keys ^= keys >> np.uint64(29)
    return mixed(keys).view(np.int64)


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether a[i] and b[i] are alike, by their full shingle sets (as 64-bit hashes)."""
    (ha, na), (hb, nb) = shingles(a), shingles(b)
    pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    side = np.repeat(np.array([1, 2], np.uint8), [len(ha), len(hb)])
    key = np.concatenate([ha, hb]) ^ mixed(pair.astype(np.uint64))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sides, pair = np.bitwise_or.reduceat(side[order], first), pair[order][first]
    both, either = np.bincount(pair[sides == 3], minlength=len(na)), np.bincount(pair, minlength=len(na))
    return 100 * both >= PERCENT * either


def slices(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE characters (bytes) or one row."""
    size = sum(pc.binary_length(batch.column(t)).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + ROWS]), SLICE, side="right")))
        yield batch.slice(at, n)
        at += n


def listed(docs: DataFrame) -> Saved:
    """A row for each line: row (its document's place), doc_id, pos, norm, h1, h2 (null: blank); documents without lines have pos null."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = StructType([d.schema["row"], d.schema["doc_id"]]).add("pos", IntegerType()).add("norm", StringType()).add("h1", LongType()).add("h2", LongType())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (s for b in [batch.set_column(2, "text", pc.fill_null(batch.column(2), ""))] for s in slices(b, "text")):
                take, places, norms = [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    found = text.lower().split(b"\n") if text else [None]
                    take += [i] * len(found)
                    places += range(len(found)) if text else found
                    norms += [b" ".join(line.split()) or None if line else None for line in found]
                blank = np.array([n is None for n in norms], bool)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(n or b"") for n in norms), np.int64).reshape(-1, 2)
                own = [part.column(c).take(pa.array(take, pa.int64())) for c in (0, 1)]
                hashes = [pa.array(np.ascontiguousarray(h[:, k]), mask=blank) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(norms, pa.binary()).cast(pa.string()), *hashes], names=schema.names)

    return save(d.mapInArrow(split, schema), "lines")


def signatures(kinds: DataFrame) -> DataFrame:
    """(id, norm) -> (id, norm, SKETCHES, full)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "norm"):
                planes, filled, _, _ = sketched(*shingles(part.column("norm")))
                sketches = [pa.array(np.ascontiguousarray(planes[:, k])) for k in range(PLANES)]
                yield pa.RecordBatch.from_arrays([*part.columns, *sketches, pa.array(filled >= FILLED)], names=["id", "norm", *SKETCHES, "full"])

    return kinds.select("id", "norm").mapInArrow(sign, f"id long, norm string, {', '.join(f'{c} long' for c in SKETCHES)}, full boolean")


def banded_lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Band keys and their ids, of (id, bands) or (id, norm)."""
    if "bands" in batch.schema.names:
        lists = batch.column("bands")
        yield lists.flatten().to_numpy(), np.repeat(batch.column("id").to_numpy(), lists.value_lengths().to_numpy())
        return
    for part in slices(batch, "norm"):
        hashes, counts = shingles(part.column("norm"))
        _, _, keys, more = sketched(hashes, counts)
        ids, short = part.column("id").to_numpy(), counts < SHORT
        yield np.concatenate([keys.ravel(), more[short].ravel()]), np.concatenate([np.repeat(ids, BANDS), np.repeat(ids[short], len(NARROW))])


def shared(signs: DataFrame, kinds: int) -> Saved:
    """(key, id, lead): the band keys, cut to 48 bits, that several ids have, and the least of these ids; kinds: about how many rows signs has.

    Nearly all keys occur once. So they aren't rows of a shuffle, but packed: sorted and dealt by their value, with gaps for keys.
    """
    parts = max(2 * signs.sparkSession.sparkContext.defaultParallelism, kinds * BANDS // PART_KEYS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, ids, low = keys[order], ids[order], int(ids.min())
            part = ((keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            gaps = [np.diff(keys[a:b], prepend=np.uint64(0)) for a, b in zip(cuts[:-1], cuts[1:])]
            own = [(ids[a:b] - low).astype(np.uint64) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = [part[cuts[:-1]], np.full(len(own), low), [_pack(g) for g in gaps], [_pack(i) for i in own]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "low", "keys", "ids"])

        for batch in batches:
            for keys, ids in banded_lines(batch):
                held.append((keys.view(np.uint64) >> np.uint64(16), ids))
                if sum(len(k) for k, _ in held) >= PART_KEYS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()])
        ids = np.concatenate([_unpack(i, np.uint64).view(np.int64) + low for i, low in zip(table.column("ids").to_pylist(), table.column("low").to_pylist())])
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        several = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        keys, ids = keys[several], ids[order[several]]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        lead = np.repeat(np.minimum.reduceat(ids, cuts), np.diff(np.append(cuts, len(keys)))) if len(keys) else ids
        return pa.table([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(lead)], names=["key", "id", "lead"])

    dealt = signs.mapInArrow(deal, "part long, low long, keys binary, ids binary")
    return save(dealt.groupBy("part").applyInArrow(meet, "key long, id long, lead long"), "line-keys")


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b, norm_a, norm_b) -> the (a, b) that are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "norm_a", "norm_b"):
                yield part.select(["a", "b"]).filter(pa.array(alike(part.column("norm_a"), part.column("norm_b"))))

    return pairs.select("a", "b", "norm_a", "norm_b").mapInArrow(compare, "a long, b long")


def in_turns(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) that are alike, by texts (id, norm). About PAIRS at a time, as a save drops its shuffle files at its end."""
    turns = pairs.count() // PAIRS + 1
    found = None
    for i in range(turns):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(turns)) == i  # noqa: E731,B023
        a, b = (texts.select(F.col("id").alias(c), F.col("norm").alias(f"norm_{c}")) for c in ("a", "b"))
        part = save(verified(pairs.filter(mine("b")).join(a, "a").join(b.filter(mine("b")), "b")), "line-links").df
        found = part if found is None else found.unionByName(part)
    return found


def close(a: Column, b: Column) -> Column:
    """Whether the sketches can be of lines that are alike; the lowest bits first, as they sort out most pairs."""
    apart = [a[c].bitwiseXOR(b[c]) for c in SKETCHES]
    return (F.bit_count(apart[0]) <= APART) & (~(a["full"] & b["full"]) | (F.bit_count(reduce(Column.bitwiseOR, apart)) <= DIFFERENT))


def close_to(planes: np.ndarray, full: np.ndarray, a, b) -> np.ndarray:
    """close() of rows a and b."""
    apart = planes[a] ^ planes[b]
    return (np.bitwise_count(apart[:, 0]) <= APART) & (~(full[a] & full[b]) | (np.bitwise_count(np.bitwise_or.reduce(apart, axis=1)) <= DIFFERENT))


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one cell, about PAIRS / 2 at a time."""
    for n in np.unique(sizes[sizes > 1]).tolist():
        own, (i, j) = starts[sizes == n], np.triu_indices(n, 1)
        step = max(1, PAIRS // 2 // len(i))
        for at in range(0, len(own), step):
            some = own[at : at + step, None]
            yield (some + i).ravel(), (some + j).ravel()


def _in_large_cell(norm: pa.Array, planes: np.ndarray, full: np.ndarray, root: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of the rows that ask with any others; none between rows that are joined by then."""
    root, number, size = root.copy(), np.arange(len(root)), pc.binary_length(norm).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // CELL_BYTES
    for chunk in np.unique(part).tolist():
        rows = np.flatnonzero(part == chunk)
        low, high = rows[0], rows[-1] + 1
        hashes, counts = shingles(norm.slice(low, high - low))
        vocabulary, at = np.unique(hashes, return_inverse=True)
        code = np.unique(np.repeat(np.arange(len(rows)), counts) * len(vocabulary) + at)
        of, place = np.divmod(code, len(vocabulary))
        lengths = np.bincount(of, minlength=len(rows))
        starts = np.cumsum(lengths) - lengths
        mark = np.zeros(len(vocabulary), np.int32)
        for i in np.flatnonzero(asks).tolist():
            others = np.flatnonzero((root[low:high] != root[i]) & (~asks[low:high] | (number[low:high] > i)))
            others = others[close_to(planes, full, i, others + low)]
            if not len(others):
                continue
            if low <= i < high:
                n, own = lengths[i - low], place[starts[i - low] : starts[i - low] + lengths[i - low]]
            else:
                own = np.unique(shingles(norm.slice(i, 1))[0])
                n, found = len(own), np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                own = found[vocabulary[found] == own]
            mark[own] = 1
            common = np.add.reduceat(mark[place[_spread(starts[others], lengths[others])]], np.cumsum(lengths[others]) - lengths[others])
            mark[own] = 0
            hit = others[100 * common >= PERCENT * (n + lengths[others] - common)] + low
            roots, first = np.unique(root[hit], return_index=True)
            for j in hit[first].tolist():
                yield i, j
            root[np.isin(root, roots)] = root[i]


def in_cells(cells: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """(cell, id, root, asks) -> links (a, b) that join the rows of a cell which are alike and where one asks; texts: (id, norm, f).

    What is joined are rows, never pairs. Small cells are compared pair by pair, many at once.
    """

    def links(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, ids, root = (t.column(c).to_numpy() for c in ("cell", "id", "root"))
        asks, full = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "full"))
        planes = np.stack([t.column(c).to_numpy().view(np.uint64) for c in SKETCHES], axis=1)
        norm = t.column("norm")
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))
        found = []
        for a, b in _pairs(sizes * (sizes <= SMALL), starts):
            fits = (asks[a] | asks[b]) & (root[a] != root[b])
            a, b = a[fits], b[fits]
            fits = close_to(planes, full, a, b)
            a, b = a[fits], b[fits]
            for at in range(0, len(a), ROWS):
                some = pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in (a, b)] + [norm.take(pa.array(x[at : at + ROWS])) for x in (a, b)], names=["a", "b", "norm_a", "norm_b"])
                for part in slices(some, "norm_a", "norm_b"):
                    good = alike(part.column("norm_a"), part.column("norm_b"))
                    found.append((part.column("a").to_numpy()[good], part.column("b").to_numpy()[good]))
        for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            own = slice(at, at + n)
            pairs = np.array(list(_in_large_cell(norm.slice(at, n), planes[own], full[own], root[own], asks[own])), np.int64).reshape(-1, 2) + at
            found.append((pairs[:, 0], pairs[:, 1]))
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut or (held and held[-1].column("cell")[0].as_py() != cell[0]):
                yield from links(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.concat_batches(held))

    rows = cells.join(texts, "id").select("cell", "id", "root", "asks", *(F.col("f")[c].alias(c) for c in SKETCHES), F.col("f")["full"].alias("full"), "norm")
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


class Verifier:
    """Links by the texts (id, norm, f): of pairs (a, b), or within cells (cell, id, root, asks)."""

    def __init__(self, texts: list[DataFrame]) -> None:
        self.texts = texts

    def __call__(self, pairs: DataFrame) -> DataFrame:
        return in_turns(pairs, self.texts[0])

    def within(self, cells: DataFrame, parts: int) -> DataFrame:
        return in_cells(cells, self.texts[0], parts)


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines, and (row, pos) of those that go."""
    full = listed(docs)
    at = F.struct("doc_id", "pos", "row")
    repeated = full.df.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.first("norm").alias("norm"))
    whole = save(repeated.select(F.monotonically_increasing_id().alias("id"), "*"), "line-kinds")
    # from here on texts are needed for signatures and candidates only; each table is dropped once nothing reads it
    all_lines = save(full.df.drop("norm"), "lines").df
    full.drop()
    kinds = save(whole.df.drop("norm"), "line-kinds").df
    texts: list[DataFrame] = []

    def features(ids: DataFrame) -> DataFrame:
        ids = save(ids, "line-candidates").df
        signs = save(signatures(whole.df.select("id", "norm").join(ids, "id", "left_semi")), "line-signatures")
        whole.drop()
        f = F.struct(*SKETCHES, "full").alias("f")
        own = save(signs.df.select("id", f), "line-sketches").df
        texts.append(save(signs.df.select("id", "norm", f), "line-texts").df)
        signs.drop()
        return own

    roots = linked(shared(whole.df.select("id", "norm"), kinds.count()), features, close, Verifier(texts))
    member = save(roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "id"), "line-members").df
    first = member.join(kinds.select("id", "at"), "id").groupBy("root").agg(F.min("at").alias("first"))
    member = member.join(first, "root").select("id", "first")
    # written, so that both sides of the next join are plain shuffles, whose large keys can be split
    cut = kinds.select("id", "h1", "h2", "at", "n").join(member, "id", "left").filter("n > 1 OR first IS NOT NULL")
    cut = save(cut.select("h1", "h2", F.coalesce("first", "at").alias("first")), "line-cut").df
    gone = all_lines.select("row", "pos", "h1", "h2", at.alias("at")).join(cut, ["h1", "h2"]).filter(~F.col("at").eqNullSafe(F.col("first"))).select("row", "pos")
    return all_lines, gone


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and removed (sorted positions of the lines that go) of every row."""
    all_lines, gone = removed(docs)
    per_doc = all_lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("pos").alias("n_lines"))
    per_doc = per_doc.join(gone.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed")), "row", "left")
    none = F.array().cast("array<int>")
    return per_doc.select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("removed"), F.lit(0))).alias("n_kept"), F.coalesce("removed", none).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, without the lines that go. A text may become empty; rows stay."""
    numbered = save(docs.select(F.struct(*docs.columns).alias("whole"), "text", F.monotonically_increasing_id().alias("number")), "line-docs").df
    source = numbered.select(F.col("number").alias("doc_id"), "text")  # the place stands for the id, so rows find their lines again
    cut = dedup(source).filter(F.size("removed") > 0).select(F.col("doc_id").alias("number"), "removed")
    rest = F.array_join(F.filter(lines(F.col("text")), lambda _, i: ~F.array_contains("removed", i)), "\n")
    new = numbered.join(cut, "number", "left").withColumn("new", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest))
    return new.select(*(F.col("new").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns))
