"""Mixing to target weights with soft memberships.

1. A chain of naive Bayes classifiers over present and absent features is fitted
   on a labelled table (document id and domain), on a bounded sample of ``SAMPLE``
   labelled rows with the smallest hash: the rarest domain against all others,
   then the next against those that are left, and so on, so that what tells a
   common domain does not hide what tells a rare one. Features are words,
   punctuation runs and a mark for capitals; each link of the chain keeps at most
   ``FEATURES`` that tell its two sides apart by ``SURE`` standard errors or more.
2. Each document gets its posterior over the domains: a soft membership.
3. Rates, one a document and never negative, are fitted by projected gradient
   descent on the squared difference between the expected tokens of each domain
   (sum of tokens x posterior x rate) and its target, from a rate of 1. Steps are
   taken in the metric that weighs a document by its tokens, so rates change as
   little as they must, and scaled by the Gram matrix of the posteriors of
   documents whose rates are above 0; a step that does not bring the totals
   nearer is halved, and at last taken unscaled, which is never too long. What
   travels is one sum a domain and one a pair of domains, a step; a task gets a
   document's rate by replaying the few steps so far, so no table of rates is
   rewritten. It ends when the targets are met to ``CLOSE``, or when no step brings
   the totals nearer: where targets cannot be met together with rates that are
   not negative, with the least-squares result. The largest difference left, as a
   share of all tokens, is returned as ``residual``.
4. A rate becomes a whole number of copies: its whole part, and for some documents
   one more, by systematic rounding: documents of like posteriors and numbers of
   tokens are put in order, and the one at which the running sum of fractions
   passes a whole number (from a hashed start) gets one more. So realised totals
   of a domain stay near the expected ones; of several hashed starts the one that
   brings them closest can be taken.

Defined results: null or empty text has no tokens, the prior as posterior and
rate 1 at the start like any other (its rate does not matter to the sums); equal
posteriors go to the first domain by name; a document labelled twice is counted
under both labels; very long texts are read whole; labels of ids that no document
has are not used, nor labels that are null; without labelled rows there are no domains and all rates
are 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_name, written

SAMPLE = 20_000
FEATURES = 4096
SURE = 4.0
STEPS = 100
CLOSE = 1e-5
_PART = re.compile(r"[^\W_]+|[^\w\s]+")


def features_of(text: str) -> set[str]:
    parts = set(_PART.findall(text))
    out = {p.lower() for p in parts}
    if any(len(p) > 2 and p.isupper() for p in parts):
        out.add("\x00capitals")
    return out


@dataclass
class Link:
    """One domain against those after it: log odds without features, and what each feature adds."""

    domain: int
    base: float
    weights: dict[str, float]


@dataclass
class Classifier:
    domains: list[str] = field(default_factory=list)
    chain: list[Link] = field(default_factory=list)

    def posterior(self, text: str | None) -> np.ndarray:
        out, left = np.zeros(len(self.domains)), 1.0
        found = features_of(text or "")
        for link in self.chain:
            score = link.base + math.fsum(link.weights[f] for f in found & link.weights.keys())
            own = 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))
            out[link.domain], left = left * own, left * (1 - own)
        if self.domains:
            out[self.last] = left
        return out

    @property
    def last(self) -> int:
        return next(k for k in range(len(self.domains)) if k not in {link.domain for link in self.chain})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled rows."""
    named = labels.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).select(F.col(key).alias("_key"), F.col(domain).cast("string").alias("_domain"))
    # The sample's size is bounded by its parameter, so it may be sent to all tasks.
    picked = named.orderBy(F.xxhash64(F.lit(3), "_key"), "_key", "_domain").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL").join(F.broadcast(picked), "_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text_, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((name, f) for f in features_of(text_))
                seen[name, ""] += 1
        names, found = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(list(seen.values()), pa.int64())], ["domain", "feature", "n"])

    counted = rows.select("_text", "_domain").mapInArrow(count, "domain string, feature string, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n"))
    totals = {r["domain"]: r["n"] for r in counted.where("feature = ''").collect()}
    if not totals:
        return Classifier()
    domains = sorted(totals)
    n = np.array([totals[d] for d in domains], float)
    sums = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"d{k}") for k, d in enumerate(domains)]
    wide = counted.where("feature <> ''").groupBy("feature").agg(*sums)
    wide = written(wide, "feature-counts")
    order = sorted(range(len(domains)), key=lambda k: (n[k], domains[k]))
    chain = []
    for at, k in enumerate(order[:-1]):
        rest = order[at + 1 :]
        own, other, m = F.col(f"d{k}"), sum((F.col(f"d{j}") for j in rest), F.lit(0)), n[rest].sum()
        # How far the domain's share of documents with the feature is from the others', in standard errors.
        rate = (own + other) / F.lit(float(n[k] + m))
        apart = F.abs(own - F.lit(float(n[k])) * rate) / F.sqrt(F.lit(float(n[k])) * rate * (1 - rate) + 1)
        best = wide.select("feature", own.alias("own"), other.alias("other"), apart.alias("_z")).where(F.col("_z") > SURE).orderBy(F.desc("_z"), "feature").limit(FEATURES).collect()
        base, weights = math.log(n[k] / m), {}
        for row in best:
            a, b = (row["own"] + 0.5) / (n[k] + 1), (row["other"] + 0.5) / (m + 1)
            base += math.log(1 - a) - math.log(1 - b)
            weights[row["feature"]] = math.log(a) - math.log(1 - a) - math.log(b) + math.log(1 - b)
        chain.append(Link(k, base, weights))
    return Classifier(domains, chain)


def memberships(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (the digest of id and text), n_tokens, posterior array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len((t or "").split()) for t in texts], pa.int64()), pa.array([model.posterior(t).tolist() for t in texts], pa.list_(pa.float64()))],
                ["doc_id", "row", "n_tokens", "posterior"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_name(F.col(key), F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row binary, n_tokens long, posterior array<double>")


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps, by posteriors."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n_tokens").to_numpy().astype(float), np.asarray(batch.column("posterior").flatten()).reshape(-1, k)


def descend(measured, goal: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], float]:
    """Steps that bring totals to the goal, and the largest difference left.

    ``measured(history)`` gives the totals by domain and the Gram matrix after the
    steps so far.
    """
    history: list[np.ndarray] = []
    at, gram = measured(history)
    scale = at.sum()
    while scale > 0 and len(history) < steps and np.abs(at - goal).max() > close * scale:
        gap = at - goal
        whole = np.linalg.solve(gram + np.eye(len(gap)) * 1e-9 * scale, gap)
        # Posteriors sum to 1, so the last one is never too long.
        for step in (whole, whole / 2, whole / 4, gap / scale):
            after, wider = measured([*history, step])
            if np.linalg.norm(after - goal) < 0.99 * np.linalg.norm(gap):
                break
        else:
            break
        history, at, gram = [*history, step], after, wider
    return history, float(np.abs(at - goal).max() / max(scale, 1.0))


def solve(members: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], float]:
    """``descend`` to the targets (tokens, by domain) over a table of memberships."""
    k = len(targets)

    def measured(history: list) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, gram = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                t, p = _matrix(batch, k)
                rate = replay(p, history)
                total += (t * rate) @ p
                gram += (p * (t * (rate > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_pydict({f"x{i}": [v] for i, v in enumerate([*total, *gram.ravel()])})

        names = [f"x{i}" for i in range(k + k * k)]
        row = members.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
        got = np.array([x or 0.0 for x in row])
        return got[:k], got[k:].reshape(k, k)

    return descend(measured, np.array(targets), steps, close)


#: Rows that one window of the rounding orders, about.
SLICE_ROWS = 20_000


#: Roundings that are tried for the totals closest to the targets.
TRIES = 32


def systematic_copies(rated: DataFrame, total: int, seed: int = 29, wanted: np.ndarray | None = None, tries: int = 1) -> DataFrame:
    """``rated`` with copies: each rate's whole part or one more, so that sums over like documents stay.

    Where a stretch of like documents starts to round is drawn. Of ``tries`` such draws,
    all of whose totals are summed in one pass, the one is taken whose domains' parts
    of the tokens come closest to those ``wanted``.
    """
    like = F.struct(F.transform("posterior", lambda p: F.round(p * 4).cast("int")), F.floor(2 * F.log2(F.col("n_tokens") + 1)).cast("int"))
    slices = 1 + total // SLICE_ROWS
    rows = rated.withColumn("_draw", F.xxhash64(F.lit(seed), "row")).withColumn("_like", F.xxhash64(like)).withColumn("_slice", F.pmod("_draw", F.lit(slices)))
    order = Window.partitionBy("_like", "_slice").orderBy("n_tokens", "_draw", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # In billionths, so that sums are exact.
    part = F.round((F.col("rate") - F.floor("rate")) * 1e9).cast("long")
    rows = rows.withColumn("_part", part).withColumn("_upto", F.sum(part).over(order))

    def copies(draw: int) -> Column:
        start = F.floor(F.pmod(F.xxhash64(F.lit(draw), "_like", "_slice"), F.lit(1 << 30)) / float(1 << 30) * 1e9)
        more = F.floor((F.col("_upto") + start) / 1e9) - F.floor((F.col("_upto") + start - F.col("_part")) / 1e9)
        return (F.floor("rate") + more).cast("long")

    best = seed
    if wanted is not None and tries > 1:
        rows = written(rows, "roundings")
        draws = range(seed, seed + tries)
        sums = rows.agg(*[F.sum(copies(d) * F.col("n_tokens") * F.col("posterior")[i]).alias(f"x{d}_{i}") for d in draws for i in range(len(wanted))]).first()
        told = np.array([x or 0.0 for x in sums]).reshape(tries, len(wanted))
        shares = told / np.maximum(told.sum(axis=1, keepdims=True), 1e-12)
        best = seed + int(np.abs(shares - wanted / max(wanted.sum(), 1e-12)).max(axis=1).argmin())
    return rows.withColumn("copies", copies(best)).drop("_draw", "_like", "_slice", "_part", "_upto")


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], scale: float = 1.0, relative: bool = False, key: str = "doc_id", text: str = "text", tries: int = 1) -> DataFrame:
    """One row a document: doc_id, row, n_tokens, domain, posterior, rate, copies, residual.

    ``shares`` are the domains' parts of the tokens wanted, ``scale`` times the
    tokens there are; with ``relative`` they multiply what each domain has. A
    domain without a share keeps what it has (relative) or gets none. ``tries`` is of
    ``systematic_copies``.
    """
    model = fit(docs, labels, key, text)
    members = written(memberships(docs, model, key, text), "memberships")
    k = len(model.domains)
    if k:
        now = members.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"x{i}") for i in range(k)]).first()
        have = np.array([now[i] or 0.0 for i in range(k)])
        wanted = np.array([shares.get(d, 1.0 if relative else 0.0) for d in model.domains])
        goal = have * wanted * scale if relative else have.sum() * scale * wanted / max(sum(shares.values()), 1e-12)
        steps, residual = solve(members, goal.tolist())
    else:
        steps, residual, goal = [], 0.0, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = np.round(replay(_matrix(batch, k)[1], steps), 9) if k else np.ones(batch.num_rows)
            best = [model.domains[i] for i in _matrix(batch, k)[1].argmax(axis=1)] if k and batch.num_rows else [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(rate)], [*batch.schema.names, "domain", "rate"])

    rated = members.mapInArrow(run, "doc_id long, row binary, n_tokens long, posterior array<double>, domain string, rate double")
    return systematic_copies(rated, members.count(), wanted=goal, tries=tries).withColumn("residual", F.lit(residual))


def label_domains(labels: DataFrame) -> DataFrame:
    """The domain of each labelled document: toxic, good or poor."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", kind.alias("domain"))


def label_toxic(labels: DataFrame) -> DataFrame:
    """Whether each labelled document is toxic or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
