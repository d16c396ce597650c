"""Records whose word sets are nearly equal, found by minima of universal hashes.

Each record's set of words gets many minima of universal hash functions, drawn so that two sets agree in a minimum
with a probability equal to their *weighted* Jaccard similarity: a word's hash is divided by its weight, which is a
power of its inverse frequency. Titles made from one template share most of their words, but hardly any weight,
so that plain minima would bring all pairs of a template together and weighted ones do not. Minima are taken in
bands of two; sets that agree in a whole band are candidates. A band with a minimum of a word that no other set has can
agree with none and is not sent. Links form groups by alternating large-star and small-star steps.

Bands find a pair by chance, and pairs whose weight sits in misspelt or changed names are easily missed. So there is an
exact way beside them for all pairs: in the order of rarity, two similar sets must share a word that stands early
enough in both, so the words that stand early in a set become keys, and sets that agree in a key are candidates. A rare
word is a key by itself, any other one together with the sizes of the two sets.

Every band and key carries a mark of its set: the size and the parities of its words in 56 places. Two sets differ in no
fewer words than their parities do, so candidates are dropped where they meet if their marks differ by more than similar
sets of their sizes can. That loses no pair, and only the others are sent on to the exact plain Jaccard similarity.

Records with equal word sets are one class throughout (told by a 64-bit hash over the words themselves): they are
hashed once, and no pair is made among them unless pairs of records are asked for. The result proper is the classes and
the links between their representatives; pairs of records are expanded from it last, in blocks of a bounded size, so
that a class that holds a third of all records is spread over many tasks. Word frequencies come from counters over all
classes, whose number follows that of the classes up to a bound: were it fixed, words would share counters in a large table,
so that none would count as rare. The driver gets and broadcasts a bit for each fine counter and the coarse counters.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep
from sarafa.llm.lineage import cut

#: Bands, minima in a band, and the exponent of the inverse document frequency.
BANDS, ROWS, POWER = 24, 2, 2.5
#: A word that more than one class in so many has is common: it decides in a minimum only between sets that have nothing
#: rarer. By chance such a word's hash can be least in all sets of a template, which would make one band of them all.
COMMON, FAINT = 500, 1e-9
#: A word that no more classes have than this is rare: as a key it needs no sizes, for so few sets can agree in it.
RARE = 64
#: Sizes of sets are told apart up to this ratio in the keys of words that are not rare.
SIZE_STEP = 1.1
#: Classes of more than BLOCK records that may be broadcast; where there are more of them they are joined by a shuffle.
HOT_MOST = 100_000
#: Records of a class that meet those of another (or of the same) in one task when pairs of records are expanded.
BLOCK = 4096
#: Coarse counters, at least and at most (16 MB as 32-bit numbers). Counts only order the words, so words that share a
#: counter cost time and lose nothing.
SKETCH, SKETCH_MOST = 1 << 18, 1 << 22
#: Fine counters for each class, and at most: of these only a bit is kept, whether more than one class counts there (64 MB).
FINE, FINE_MOST = 32, 1 << 29
#: Parts that the counters are added up in, each in one task.
SLICES = 128
#: Places of the parities in a mark; the size is above them, 0 for sets of 255 words and more, which the marks let pass.
PLACES, LARGE = 56, 255
SEED = 20250701


def words(text: Column) -> Column:
    """The distinct lower-cased runs of letters and digits, sorted; empty for null and blank texts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.array_sort(F.array_distinct(found))


class Counts(NamedTuple):
    """What is known of the words' frequencies; never too low, whatever words share counters."""

    #: A bit for each fine counter: whether no more than one class counts there.
    lone: np.ndarray
    #: Sums of the other fine counters, at least 1.
    coarse: np.ndarray
    classes: int

    def of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, coarse counter) of each word; a word counted once is in no other class."""
        fine = flat.view(np.uint32) & np.uint32(8 * len(self.lone) - 1)
        at = fine // np.uint32(8 * len(self.lone) // len(self.coarse))
        alone = (self.lone[fine >> np.uint32(3)] >> (fine & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
        return np.where(alone, 1, self.coarse[at]), at


def _gaps(sorted_: np.ndarray) -> np.ndarray:
    """Rising whole numbers as 16-bit steps; a step of 65,535 only leads on to the next one."""
    step = np.diff(sorted_, prepend=0)
    times = step // 0xFFFF + 1
    out = np.full(times.sum(), 0xFFFF, np.uint16)
    out[np.cumsum(times) - 1] = step % 0xFFFF
    return out


def _ungapped(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 0xFFFF]


def frequencies(sets: DataFrame) -> Counts:
    """How many sets hold a word of each counter. sets: distinct words in each row, as 32-bit hashes."""
    total = sets.count()
    fine = max(SKETCH, min(FINE_MOST, 1 << (FINE * total).bit_length()))
    coarse = max(SKETCH, min(SKETCH_MOST, fine >> 6))
    wide = fine // SLICES

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = np.unique(_flat(batch.column(0))[0].view(np.uint32) & np.uint32(fine - 1), return_counts=True)
            at, n, edges = at.astype(np.int64), n.astype(np.int32), np.searchsorted(at, np.arange(SLICES + 1) * wide)
            rows = [(k, _gaps(at[i:j] - k * wide).tobytes(), n[i:j].tobytes()) for k, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "gaps", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of slices."""
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for k, part in itertools.groupby(rows, key=lambda row: row[0]):
            at, n = zip(*((_ungapped(np.frombuffer(g, np.uint16)), np.frombuffer(m, np.int32)) for _, g, m in part))
            count = np.bincount(np.concatenate(at), np.concatenate(n), wide)
            lone = count < 2
            sums = np.where(lone, 0, count).reshape(-1, fine // coarse).sum(1).clip(1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(lone, bitorder="little").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["slice", "lone", "coarse"])

    slices = sets.select("words").mapInArrow(told, "slice int, gaps binary, n binary").repartition("slice").sortWithinPartitions("slice")
    lone, sums = np.full(fine // 8, 255, np.uint8), np.ones(coarse, np.uint32)
    for row in slices.mapInArrow(added, "slice int, lone binary, coarse binary").toArrow().to_pylist():
        k = row["slice"]
        lone[k * wide // 8 : (k + 1) * wide // 8] = np.frombuffer(row["lone"], np.uint8)
        sums[k * coarse // SLICES : (k + 1) * coarse // SLICES] = np.frombuffer(row["coarse"], np.uint32)
    return Counts(lone, sums, total)


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit word hashes to well-spread 64-bit numbers."""
    z = x.astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def minima(flat: np.ndarray, starts: np.ndarray, weight: np.ndarray, alone: np.ndarray | None = None) -> np.ndarray:
    """(sets, BANDS * ROWS) minima of -log(u) / weight, u by universal hashing of the words; no set is empty.

    With alone, the last bit of a minimum tells whether it is that of such a word.
    """
    rng = np.random.default_rng(SEED)
    x, inverse = _mix(flat), 1.0 / weight
    out = np.empty((len(starts), BANDS * ROWS))
    for i in range(BANDS * ROWS):
        a, b = (int(v) for v in rng.integers(1, 1 << 63, 2, dtype=np.uint64))
        u = ((x * np.uint64(a | 1) + np.uint64(b)) >> np.uint64(11)).astype(np.float64)
        value = -np.log((u + 1.0) * 2.0**-53) * inverse
        if alone is not None:
            # Positive numbers are ordered as their bits are.
            value = ((value.view(np.uint64) & ~np.uint64(1)) | alone).view(np.float64)
        out[:, i] = np.minimum.reduceat(value, starts)
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]


def _ranks(flat: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, size of the set, words before it in the order of rarity) of each word."""
    size = np.diff(np.append(starts, len(flat)))
    owner = np.repeat(np.arange(len(starts)), size)
    order = np.lexsort((flat, count, owner))
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.arange(len(flat)) - np.repeat(starts, size)
    return owner, size[owner], rank


def rare_keys(flat: np.ndarray, starts: np.ndarray, count: np.ndarray, threshold: float, few: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the rare words that stand early enough for any partner's size; 32 bits, the last one 0.

    Counts are never too low, so a word counted once is in no other set and needs no key.
    """
    owner, a, rank = _ranks(flat, starts, count)
    keep = np.flatnonzero((count > 1) & (count <= few) & (a - rank >= threshold * a - 1e-9))
    return owner[keep], (_mix(flat[keep]) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)


def early_keys(flat: np.ndarray, starts: np.ndarray, count: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, side) for the common words that stand early enough: side -1 for a set that is the smaller of its pair, 1 for the larger, 0 for both.

    Sets of sizes a and b are similar only if they share k (a + b) words, k = threshold / (1 + threshold). If their
    first shared word in the order of rarity has i words before it in the one and j in the other, no more than
    min(a - i, b - j) are shared. So a word with i before it can be the first shared one only with sets of sizes
    b <= (a - i) / k - a. Sizes are in steps of SIZE_STEP, rounded so that no pair is lost.
    """
    owner, a, rank = _ranks(flat, starts, count)
    keep = np.flatnonzero(common & (a - rank >= threshold * a - 1e-9))
    a, i, w, own = a[keep].astype(float), rank[keep], flat[keep], owner[keep]
    log = np.log(SIZE_STEP)
    step = np.floor(np.log(a) / log + 1e-9).astype(np.int64)
    least, most = threshold * a, np.minimum(a / threshold, (a - i) * (1 + threshold) / threshold - a)
    far = int(np.ceil(-np.log(threshold) / log)) + 1
    out = []
    for d in range(-far, far + 1):
        other = step + d
        # The sizes of a step reach from its power up to, not including, the next one.
        ok = (SIZE_STEP ** (other + 1.0) > least - 1e-6) & (SIZE_STEP ** other.astype(float) <= most + 1e-6) & (other >= 0)
        low, high = np.minimum(step, other)[ok].astype(np.uint64), np.maximum(step, other)[ok].astype(np.uint64)
        key = (_mix(w[ok]) ^ (low << np.uint64(20)) ^ high) * np.uint64(0xD6E8FEB86659FD93)
        out.append((own[ok], (key ^ (key >> np.uint64(32))).view(np.int64), np.full(ok.sum(), -np.sign(d) if d else 0, np.int8)))
    own, key, side = (np.concatenate([o[k] for o in out]) for k in range(3))
    # d > 0: the partner is larger, so this set is the smaller one.
    return own, key, side


def marks(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each set: the parities of its words in PLACES places, its size above them."""
    bit = np.uint64(1) << ((_mix(flat) >> np.uint64(8)) % np.uint64(PLACES))
    size = np.diff(np.append(starts, len(flat)))
    return (np.bitwise_xor.reduceat(bit, starts) | (np.where(size < LARGE, size, 0).astype(np.uint64) << np.uint64(PLACES))).view(np.int64)


def may_link(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets with these marks can be similar; true for all that are.

    Sets of sizes a and b that share k (a + b) words, k = threshold / (1 + threshold), differ in (1 - 2 k) (a + b).
    """
    size_a, size_b = (F.shiftrightunsigned(m, PLACES) for m in (a, b))
    differ = F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit((1 << PLACES) - 1)))
    least = round(threshold * 10_000) / 10_000
    return (size_a == 0) | (size_b == 0) | (differ <= (size_a + size_b) * ((1 - least) / (1 + least)) + 1e-6)


def bands(classes: DataFrame, known, threshold: float, few: int = RARE) -> DataFrame:
    """(rep, mark, band) of the classes' bands, odd, and of the early keys of their rare words, even; known: (Counts, weights), broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = known.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat, starts = _flat(batch.column(1))
            count, at = counts.of(flat)
            alone = count == 1
            low = minima(flat, starts, np.where(alone, weights[0], weights[1:][at]), alone.astype(np.uint64)).view(np.uint64)
            band, met = np.zeros((n, BANDS), np.uint64), np.ones((n, BANDS), bool)
            for j in range(ROWS):
                met &= low[:, j::ROWS] & np.uint64(1) == 0
                band = (band ^ low[:, j::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
                band ^= band >> np.uint64(32)
            band = ((band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            rare, word = rare_keys(flat, starts, count, threshold, few)
            own = np.concatenate([np.nonzero(met)[0], rare])
            key = np.concatenate([band.astype(np.uint32)[met] | np.uint32(1), word]).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(marks(flat, starts)[own]), pa.array(key)], names=["rep", "mark", "band"])

    return classes.select("rep", "words").mapInArrow(run, "rep bigint, mark bigint, band int")


def sized(classes: DataFrame, known, threshold: float, sign: int, few: int = RARE) -> DataFrame:
    """(rep, mark, band) of the early keys of the words that are not rare, of the classes as the smaller (sign -1) or the larger set (1) of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts = _flat(batch.column(1))
            count, _ = known.value[0].of(flat)
            own, key, side = early_keys(flat, starts, count, count > few, threshold)
            ours = side * sign >= 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[ours])), pa.array(marks(flat, starts)[own[ours]]), pa.array(key[ours].astype(np.int32))], names=["rep", "mark", "band"])

    return classes.select("rep", "words").mapInArrow(run, "rep bigint, mark bigint, band int")


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key_a, key_b, words_a, words_b, ...) -> (key_a, key_b, ...) of the pairs at least as similar."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, sizes = [], []
            for i in (2, 3):
                flat, starts = _flat(batch.column(i))
                size = np.diff(np.append(starts, len(flat)))
                keys.append((np.repeat(np.arange(n, dtype=np.int64), size) << 32) | flat.astype(np.uint32).astype(np.int64))
                sizes.append(size)
            both = np.sort(np.concatenate(keys))
            shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=n)
            # In whole numbers where the threshold is a short decimal: no similarity is lost to rounding.
            enough = shared * 10_000 >= round(threshold * 10_000) * (sizes[0] + sizes[1] - shared)
            kept = batch.select(["key_a", "key_b", "rep_a", "rep_b", "blocks_a", "blocks_b"])
            yield kept.filter(pa.array(enough))

    return run


class NearDuplicates:
    """Classes of equal word sets in a table, and the links between similar classes.

    Null texts and texts without letters and digits are in no class. Repeated rows with one id count as one
    record; an empty table gives empty results; further columns are ignored; texts are taken whole.
    """

    def __init__(self, records: DataFrame, id_column: str, text_column: str, threshold: float = 0.6, rare: int = RARE) -> None:
        self.id_column = id_column
        self.ids = records.select(F.col(id_column).alias("id"))
        sets = keep(records.select(F.col(id_column).alias("id"), words(F.col(text_column)).alias("w")), lambda r: F.size(r["w"]) > 0)
        self.members = sets.select("id", F.xxhash64("w").alias("key"))
        # The key tells classes apart by 64 bits over the words; within a comparison 32 bits a word do.
        hashed = sets.select("id", F.xxhash64("w").alias("key"), F.array_sort(F.transform("w", lambda w: F.hash(w))).alias("words"))
        classes = cut(hashed.groupBy("key").agg(F.min("id").cast("bigint").alias("rep"), F.first("words").alias("words"), F.count("*").alias("n")).select("rep", "key", "words", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), (F.col("n") > 1).alias("many")))
        self.classes = classes.select("rep", "key", "blocks", "many")
        counts = frequencies(classes)
        weigh = lambda n: np.log1p(counts.classes / n) ** POWER * np.where(n * float(COMMON) > counts.classes, FAINT, 1.0)
        # The first weight is that of a word in one class alone.
        known = records.sparkSession.sparkContext.broadcast((counts, weigh(np.concatenate([[1], counts.coarse]))))
        # What words that share a counter add to each other is no sign of a frequent word.
        few = rare + 2 * int(np.median(np.where(counts.coarse > 1, counts.coarse, 0)))
        band, smaller, larger = bands(classes, known, threshold, few), sized(classes, known, threshold, -1, few), sized(classes, known, threshold, 1, few)
        a, b, s, l = band.alias("a"), band.alias("b"), smaller.alias("s"), larger.alias("l")
        chance = a.join(b.hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.rep") < F.col("b.rep")) & may_link(F.col("a.mark"), F.col("b.mark"), threshold)).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
        sure = s.join(l.hint("merge"), (F.col("s.band") == F.col("l.band")) & (F.col("s.rep") != F.col("l.rep")) & may_link(F.col("s.mark"), F.col("l.mark"), threshold)).select(F.least("s.rep", "l.rep").alias("rep_a"), F.greatest("s.rep", "l.rep").alias("rep_b"))
        # Sent by rep_a, candidates are made one once and are where the verification's first join wants them.
        pair = chance.unionByName(sure).repartition("rep_a").distinct()
        # One exchange serves both sides of the verification.
        side = classes.select("rep", "key", "words", "blocks").repartition("rep")
        x = side.select(*(F.col(c).alias(f"{c}_a") for c in side.columns))
        y = side.select(*(F.col(c).alias(f"{c}_b") for c in side.columns))
        full = pair.join(x, "rep_a").join(y, "rep_b").select("key_a", "key_b", "words_a", "words_b", "rep_a", "rep_b", "blocks_a", "blocks_b")
        #: (key_a, key_b, rep_a, rep_b, blocks_a, blocks_b): links between different classes, each once, rep_a < rep_b.
        self.links = full.mapInArrow(_verify(threshold), "key_a bigint, key_b bigint, rep_a bigint, rep_b bigint, blocks_a int, blocks_b int")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of records at least as similar as the threshold, copies included.

        The rows are what is asked for and may be many where many records have one word set; classes() and
        class_links() give the same result without expanding them. Each pair is made once, so that none is shuffled to
        tell it from its copies, but for those of ids that several rows have.
        """
        hot = self.classes.filter("blocks > 1").select("key", "blocks")
        n_hot, own = hot.count(), F.lit(0)
        placed = self.members
        if n_hot:
            placed = placed.join(F.broadcast(hot) if n_hot <= HOT_MOST else hot, "key", "left")
            own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
        repeated = self.ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("again"))
        n_repeated, again = repeated.count(), F.lit(False)
        if n_repeated:
            placed = placed.join(F.broadcast(repeated) if n_repeated <= HOT_MOST else repeated, "id", "left")
            again = F.coalesce("again", F.lit(False))
        placed = placed.select("key", own.alias("block"), "id", again.alias("again"))
        upto = lambda c, least=F.lit(0): F.explode(F.sequence(least, F.col(c) - 1))
        apart = self.links.select("key_a", "key_b", upto("blocks_a").alias("block_a"), "blocks_b").select("key_a", "block_a", "key_b", upto("blocks_b").alias("block_b"))
        alike = self.classes.filter("many").select("key", upto("blocks").alias("block_a"), "blocks").select(F.col("key").alias("key_a"), "block_a", F.col("key").alias("key_b"), upto("blocks", F.col("block_a")).alias("block_b"))
        a = placed.select(F.col("key").alias("key_a"), F.col("block").alias("block_a"), F.col("id").alias("ia"), F.col("again").alias("again_a"))
        b = placed.select(F.col("key").alias("key_b"), F.col("block").alias("block_b"), F.col("id").alias("ib"), F.col("again").alias("again_b"))
        both = apart.unionByName(alike).join(a, ["key_a", "block_a"]).join(b, ["key_b", "block_b"])
        met = both.filter("key_a <> key_b OR block_a <> block_b OR ia < ib").filter("ia <> ib")
        named = lambda df: df.select(F.least("ia", "ib").alias(f"{self.id_column}_a"), F.greatest("ia", "ib").alias(f"{self.id_column}_b"))
        if not n_repeated:
            return named(met)
        return named(met.filter("NOT (again_a OR again_b)")).unionByName(named(met.filter("again_a OR again_b")).distinct())

    def class_links(self) -> DataFrame:
        """(id_a, id_b): links between different classes, each named by its least record, id_a < id_b."""
        return self.links.select(F.col("rep_a").alias(f"{self.id_column}_a"), F.col("rep_b").alias(f"{self.id_column}_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_links): each record's class, the group it is connected with, and its class's links to others.

        Classes and groups are named by their least record.
        """
        links = cut(self.links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")))
        root = components(links)
        degree = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
        told = self.classes.join(root, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("u"), "left")
        named = told.select("key", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
        return self.members.join(named, "key").select(F.col("id").alias(self.id_column), "class_id", "group_id", "n_links")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v), by alternating large-star and small-star.

    A round moves each node's neighbours to the least node it knows, upwards (large star) and downwards (small
    star), by an aggregate and a join, so that a node with very many neighbours is split like any skewed key.
    Every round is checkpointed. The result is empty for no edges; loops and repeated edges do no harm.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        next_ = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut(next_)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
