"""A mixture of documents in which each source has its target share of the tokens.

Every document has a membership in the sources, the posterior of a classifier that the labelled documents of the whole
table train (multinomial naive Bayes over token ids, with a temperature fitted on held-out documents). The source a
document states is evidence of known reliability for that posterior, so a label stands unless the text contradicts it
strongly. Each document gets a rate, how often it is expected in the mixture,
between nothing and the most repeats of its source. Rates minimise the squared differences between the
expected tokens of the sources and their targets, by projected gradient steps: a step sums the sources' tokens over all documents,
and moves every rate against the differences of the sources it belongs to. Rates depend on memberships alone, so
documents of equal membership move as one and only sums per source ever reach the driver.

The corpus is tokenised once; training and scoring read the token buckets that were written then.

The mixture is as large as all non-empty documents together. A source whose documents cannot fill its share, even
repeated, gives all it may, and the others make up for it in proportion to their shares; so does a target
without documents. Documents of sources without a target are not used. The shares reached are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarafa.llm import tokens
from sarafa.llm.lineage import cut

#: Buckets of token ids that the classifier tells apart, the smoothing of the whole corpus's counts, and the tokens of the whole
#: corpus that each source's counts are smoothed with, so that a small source is not judged by what it happens to lack.
FEATURES, SMOOTHING, BACKGROUND = 8192, 0.01, 1000.0
#: Temperatures the classifier may have, and the powers of a document's length they may grow with: tokens of one text are no
#: independent evidence, so that odds of long texts are too bold.
TEMPERATURES, POWERS = tuple(2.0**e for e in range(-6, 6)), (0.0, 0.5, 1.0)
#: How likely a stated source is the right one, and the decimals that memberships are told apart by.
TRUST, DECIMALS = 0.999_999, 3
#: One document in so many is held out to fit the temperature.
HELD_OUT = 10
#: Bins of the documents' hashes by which the rounding of rates is set so that a source's tokens come out as fitted.
BINS = 4096
#: Steps at most, and the difference to the targets (as a part of the whole) at which they end.
STEPS, CLOSE = 60, 1e-7
#: Targets are a short dimension; a longer one is refused rather than shipped.
MAX_TARGETS = 10_000


class Mixture:
    """Rates and copies for the documents of a table; see the module.

    Null and empty texts have no tokens and are never used. A target share that is null or negative counts as
    zero, a null max_repeats as one. Repeated rows are documents of their own. An empty table gives an empty
    mixture; further columns are ignored.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY) -> None:
        spark = docs.sparkSession
        rows = targets.select("source", F.coalesce(F.greatest(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).filter("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.min("most").alias("most")).orderBy("source").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.sources = [r.source for r in rows]
        self.share, self.most = np.array([r.share for r in rows]), np.array([float(r.most) for r in rows])
        k = len(rows)
        # Class k holds all sources without a target; -1 marks documents that state none.
        number = F.create_map(*[x for i, s in enumerate(self.sources) for x in (F.lit(s), F.lit(i))]) if k else F.create_map(F.lit(""), F.lit(-1))
        label = F.when(F.col("source").isNull() | (F.trim("source") == ""), F.lit(-1)).otherwise(F.coalesce(F.try_element_at(number, F.trim("source")), F.lit(k)))
        kind = docs.schema["doc_id"].dataType.simpleString()
        base = docs.select("doc_id", F.col("text").cast("string").alias("text"), label.cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")).filter("text <> ''")
        ranks = spark.sparkContext.broadcast(tokens.read_ranks(vocabulary))

        def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                own = own or tokens.encoder(ranks)
                ids = own.encode(batch.column(1).to_pylist())
                kept = [(np.array(x, np.int64) % FEATURES).astype(np.uint16).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([len(x) for x in ids], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "label", "held", "n", "buckets"])

        tokenised = cut(base.mapInArrow(bucket, f"doc_id {kind}, label int, held boolean, n bigint, buckets binary"))
        self.model = self._train(tokenised, k + 1)
        model = spark.sparkContext.broadcast(self.model)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = _scores(*_flat(batch.column(4)), model.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(scores), pa.list_(pa.float64()))], names=["doc_id", "label", "held", "n", "score"])

        scored = cut(tokenised.mapInArrow(score, f"doc_id {kind}, label int, held boolean, n bigint, score array<double>"))
        self.temperature = self._temperature(scored)
        t = self._heat(*self.temperature)
        stated = lambda i: F.when(F.col("label") < 0, F.lit(0.0)).when(i == F.col("label"), F.lit(float(np.log(TRUST)))).otherwise(F.lit(float(np.log((1 - TRUST) / max(k, 1)))))
        weighed = F.transform("score", lambda x, i: x / t + stated(i))
        odds = F.transform("weighed", lambda x: F.exp(x - F.array_max("weighed")))
        total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
        soft = F.transform("odds", lambda o: F.round(o / F.col("total"), DECIMALS))
        member = F.transform("soft", lambda x: x / F.aggregate("soft", F.lit(0.0), lambda a, y: a + y))
        known = scored.select("doc_id", "label", "n", weighed.alias("weighed")).withColumn("odds", odds).withColumn("total", total).withColumn("soft", soft).withColumn("member", member)
        caps = F.array(*[F.lit(float(m)) for m in self.most], F.lit(0.0))
        likely = F.when(F.col("label") >= 0, F.col("label")).otherwise((F.array_position("member", F.array_max("member")) - 1).cast("int"))
        self.docs = cut(known.select("doc_id", "label", "n", "member", likely.alias("likely"), F.element_at(caps, likely + 1).alias("cap")))
        self.kinds = cut(self.docs.groupBy("member", "cap").agg(F.sum("n").alias("n")))
        self.history: list[list[float]] = []
        self._solve(k)

    def _train(self, tokenised: DataFrame, classes: int) -> np.ndarray:
        """(classes, FEATURES + 1) log odds of the buckets and the class's log prior, from all labelled documents not held out."""
        width = FEATURES + 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(classes * width, np.int64)
            for batch in batches:
                flat, size = _flat(batch.column(1))
                label = batch.column(0).to_numpy().astype(np.int64)
                seen += np.bincount(np.repeat(label, size) * width + flat, minlength=len(seen)) + np.bincount(label * width + FEATURES, minlength=len(seen))
            where = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(seen[where])], names=["at", "n"])

        # A fixed number of counters, whatever the corpus.
        rows = tokenised.filter("label >= 0 AND NOT held").select("label", "buckets").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros(classes * (FEATURES + 1))
        seen[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        seen = seen.reshape(classes, FEATURES + 1)
        whole = seen[:, :-1].sum(0) + SMOOTHING
        words = seen[:, :-1] + BACKGROUND * whole / whole.sum()
        # A source without a labelled document is no candidate.
        prior = np.where(seen[:, -1:] > 0, np.log(np.maximum(seen[:, -1:], 1) / max(seen[:, -1].sum(), 1)), -1e9)
        return np.hstack([np.log(words / words.sum(1, keepdims=True)), prior])

    @staticmethod
    def _heat(temperature: float, power: float):
        # Never below 1: odds may be too bold, but not too timid.
        return F.greatest(F.lit(temperature) * F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(power)), F.lit(1.0))

    def _temperature(self, scored: DataFrame) -> tuple[float, float]:
        """(temperature, power of the length) with the least log loss over the held-out documents; (1, 0) when there are none."""
        held = scored.filter("held AND label >= 0")
        top = F.array_max("score")

        def loss_at(t: float, p: float):
            odds = F.transform("score", lambda s: F.exp((s - top) / self._heat(t, p)))
            return F.avg(F.log(F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)) - (F.element_at("score", F.col("label") + 1) - top) / self._heat(t, p))

        tried = [(t, p) for p in POWERS for t in TEMPERATURES]
        found = held.agg(*[loss_at(*tp).alias(f"t{i}") for i, tp in enumerate(tried)]).first()
        known = [(v, tp) for v, tp in zip(found, tried) if v is not None]
        return min(known)[1] if known else (1.0, 0.0)

    def _solve(self, k: int) -> None:
        """The steps, each one sum over the kinds of documents; self.history keeps what rates are replayed from."""
        sums = self.kinds.agg(F.sum("n").alias("all"), *[F.sum(F.col("n") * F.element_at("member", i + 1)).alias(f"c{i}") for i in range(k)], *[F.sum(F.col("n") * F.col("cap") * F.element_at("member", i + 1)).alias(f"m{i}") for i in range(k)]).first()
        self.total = float(sums["all"] or 0)
        self.unit = np.array([float(sums[f"c{i}"] or 0) for i in range(k)])
        self.target = fill(self.share * self.total, np.array([float(sums[f"m{i}"] or 0) for i in range(k)]), self.total)
        before = np.inf
        for _ in range(STEPS if self.total and k else 0):
            rate = self.rates()
            got = self.kinds.select("n", "member", rate.alias("r")).agg(*[F.sum(F.col("n") * F.col("r") * F.element_at("member", i + 1)).alias(f"a{i}") for i in range(k)]).first()
            off = np.array([float(x or 0) for x in got]) - self.target
            worst = np.abs(off).max() / self.total
            if worst < CLOSE or worst >= before * 0.999 and worst < 1e-4:
                break
            before = worst
            self.history.append((off / np.maximum(self.unit, 1.0)).tolist())
        self.unmet = off / self.total if self.total and k else np.zeros(k)

    def rates(self):
        """The rate of a document from its member and cap columns, by replaying the steps."""
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in self.history]) if self.history else F.lit(None).cast("array<array<double>>")
        k = len(self.sources)

        def move(r, g):
            down = sum((F.element_at("member", i + 1) * F.element_at(g, i + 1) for i in range(k)), F.lit(0.0))
            return F.least(F.greatest(r - down, F.lit(0.0)), F.col("cap"))

        start = F.least(F.lit(1.0), F.col("cap"))
        return F.aggregate(steps, start, move) if self.history else start

    def copies(self) -> DataFrame:
        """(doc_id, label, n_tokens, rate, copies, member): copies is the rate rounded up or down by the document's hash.

        Documents of several sources are rounded up as often as their rate says. What a source then lacks, or has too
        much, is made up for by its own documents: the hash below which these are rounded up is set so that the
        source's tokens sum to what the rates demand. No copies exceed the cap.
        """
        k = len(self.sources)
        chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
        rated = self.docs.select("doc_id", "label", "likely", "cap", F.col("n").alias("n_tokens"), F.round(self.rates(), 9).alias("rate"), "member", chance.alias("chance"))
        rated = rated.withColumn("part", F.col("rate") % 1).withColumn("pure", F.array_max("member") == 1.0).withColumn("late", F.least(F.try_divide("chance", "part"), F.lit(8.0)))
        plain = F.least(F.floor("rate") + F.when((F.col("part") > 0) & (F.col("late") < 1), 1).otherwise(0), F.col("cap"))
        # What each source should have less what it has without the parts of its own documents: one row.
        sure = F.when(F.col("pure"), F.floor("rate")).otherwise(plain)
        lack = rated.agg(*[F.sum(F.col("n_tokens") * F.element_at("member", i + 1) * (F.col("rate") - sure)).alias(f"l{i}") for i in range(k)]).first() if k else []
        bins = rated.filter(f"likely < {k} AND part > 0 AND pure").groupBy("likely", F.floor(F.col("late") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).toArrow().to_pylist()
        up = np.zeros(k + 1)
        for i in range(k):
            own = sorted((r["bin"], r["n"]) for r in bins if r["likely"] == i)
            need, held, past = float(lack[i] or 0), 0, 0.0
            for at, n in own:
                if held + n / 2 > need:
                    break
                held, past = held + n, (at + 1) / BINS
            up[i] = past
        cutoff = F.when(F.col("pure"), F.element_at(F.array(*[F.lit(float(x)) for x in up]), F.col("likely") + 1)).otherwise(F.lit(1.0))
        copies = F.least(F.floor("rate") + F.when((F.col("part") > 0) & (F.col("late") < cutoff), 1).otherwise(0), F.col("cap")).cast("int")
        return rated.withColumn("copies", copies).drop("cap", "chance", "likely", "part", "late", "pure")

    def shares(self) -> DataFrame:
        """(source, target_share, adjusted_share, actual_share, tokens, documents, most_copies) of every target."""
        k, spark = len(self.sources), self.docs.sparkSession
        each = self.copies()
        got = each.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("all"), *[F.sum(F.col("copies") * F.col("n_tokens") * F.element_at("member", i + 1)).alias(f"a{i}") for i in range(k)], *[F.count_if((F.col("label") == i) & (F.col("copies") > 0)).alias(f"d{i}") for i in range(k)], *[F.max(F.when(F.col("label") == i, F.col("copies"))).alias(f"x{i}") for i in range(k)]).first()
        whole = float(got["all"] or 0) or 1.0
        rows = [(s, float(self.share[i]), float(self.target[i] / (self.total or 1.0)), float(got[f"a{i}"] or 0) / whole, int(round(got[f"a{i}"] or 0)), int(got[f"d{i}"] or 0), int(got[f"x{i}"] or 0)) for i, s in enumerate(self.sources)]
        return spark.createDataFrame(rows, "source string, target_share double, adjusted_share double, actual_share double, tokens bigint, documents bigint, most_copies int")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of documents, and how many each document has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in parts], np.int64)


def _scores(flat: np.ndarray, size: np.ndarray, model: np.ndarray) -> np.ndarray:
    """(documents, classes) log likelihoods plus priors."""
    out = np.tile(model[:, -1], (len(size), 1))
    owner = np.repeat(np.arange(len(size)), size)
    for c in range(len(model)):
        out[:, c] += np.bincount(owner, model[c, flat], minlength=len(size))
    return out


def fill(wanted: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """Amounts in proportion to what is wanted, none above its room, that sum to the total or, failing that, to all room."""
    wanted = np.where(wanted > total * 1e-12, wanted, 0.0)
    out, open_ = np.minimum(0.0, room), wanted > 0
    while open_.any():
        left = total - out[~open_].sum()
        level = left / wanted[open_].sum()
        full = open_ & (wanted * level >= room)
        if not full.any():
            out[open_] = wanted[open_] * level
            break
        out[full], open_ = room[full], open_ & ~full
    return out
