"""Mixing sources to target weights by soft membership.

A classifier learnt from a labelled table gives every document a posterior over domains (naive Bayes over the presence and
absence of hashed letter and sign runs, each by how sure its difference is, sharpened or flattened by one exponent that fits
labelled rows it hasn't learnt from best). Document rates
r >= 0 then minimise the weighted least squares between the expected domain token totals, sum_i r_i n_i p_i, and the
targets. A projected gradient step in the metric of token counts is

    r_i <- clip(r_i - p_i . M (A r - t), 0, max_rate),   M = (sum_i n_i p_i p_i')^-1,

so a rate depends on its document's posterior and the few steps so far alone: each iteration is one aggregation of a few
numbers a domain, and rates are a fold over the list of steps. No row is collected.

Only DataFrame operations are used on rows. Defined results: null and empty texts have no tokens, the prior as posterior
and a rate; labelled rows without a document and null labels are not learnt from; repeated rows are separate rows; an
empty table gives an empty table; a domain without labelled rows raises ValueError, unless its target is an upper share; columns of the input stay, result
columns replace clashing ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch

#: Hash buckets of the classifier, labelled rows it learns from at most (about), and rows at the common rate of a bucket
#: that are added to each domain.
BUCKETS = 16384
FIT_ROWS = 20_000
SMOOTHING = 1.0
#: A bucket counts by z^2 / (z^2 + DOUBT), z the standard errors by which the domain's rate differs from the others' rate.
DOUBT = 4.0
#: Exponents tried for the likelihood.
EXPONENTS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0)
#: Iterations at most, the relative residual at which they end, and the relative gain of a step under which the loss is least.
MAX_STEPS = 40
TOLERANCE = 5e-4
LEAST_GAIN = 1e-6
MAX_DOMAINS = 64


def runs(text: Column) -> Column:
    """Hash buckets present in a text, each once."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))


def tokens(text: Column) -> Column:
    """Number of words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _doubles(values) -> Column:
    """A constant array; one literal, so that plans stay short."""
    return F.split(F.lit(",".join(f"{float(v):.9g}" for v in values)), ",").cast("array<double>")


@dataclass
class DomainClassifier:
    """For each domain a log prior, and log odds of every bucket with their sum of absences."""

    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray = field(repr=False)
    absent: np.ndarray = field(repr=False)
    exponent: float = 1.0

    @classmethod
    def fit(cls, labelled: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", domain: str = "domain", fit_rows: int = FIT_ROWS) -> DomainClassifier:
        """Learns from about ``fit_rows`` labelled rows at most, chosen by a hash of ``key``."""
        have = labelled.where(F.col(domain).isNotNull())
        n = have.count()
        share = min(1.0, fit_rows / max(1, n))
        place = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30))
        judge = F.pmod(F.xxhash64(F.col(key), F.lit("judge")), F.lit(4)) == 0  # the exponent is judged on rows not learnt from
        rows = scratch.write("labelled", have.where(place < share * (1 << 30)).select(F.col(domain).alias("domain"), runs(F.col(text)).alias("runs"), judge.alias("judge")))
        found = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("judge")).alias("learnt")).limit(MAX_DOMAINS + 1).collect()
        # A domain with held-back rows only is learnt from nevertheless.
        learn = rows.where("not judge") if all(r["learnt"] for r in found) else rows
        counts = {r["domain"]: r["learnt"] if all(x["learnt"] for x in found) else r["n"] for r in found}
        if not counts or len(counts) > MAX_DOMAINS:
            raise ValueError(f"{len(counts)} labelled domains")
        domains = sorted(counts)
        size = np.array([counts[d] for d in domains], float)
        seen = np.zeros((len(domains), BUCKETS))
        # At most BUCKETS rows a domain.
        for r in learn.select("domain", F.explode("runs").alias("b")).groupBy("domain", "b").count().collect():
            seen[domains.index(r["domain"]), r["b"]] += r["count"]
        common = (seen.sum(0) + 0.5) / (size.sum() + 1)
        rates = np.minimum((seen + SMOOTHING * common) / (size[:, None] + SMOOTHING), 0.999)
        others = np.maximum(size.sum() - size, 1)[:, None]
        error = np.sqrt(common * (1 - common) * (1 / size[:, None] + 1 / others)) + 1e-12
        sure = ((seen / size[:, None] - (seen.sum(0) - seen) / others) / error) ** 2
        sure = sure / (sure + DOUBT)
        # Log rates against the common one, drawn to it where the difference is in doubt.
        present, absent = sure * (np.log(rates) - np.log(np.minimum(common, 0.999))), sure * (np.log1p(-rates) - np.log1p(-np.minimum(common, 0.999)))
        model = cls(domains, np.log(size / size.sum()), present - absent, absent.sum(1))
        at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int")
        scored = rows.where("judge").where(F.col("domain").isin(domains)).select(at.alias("at"), *model._sums(F.col("runs")))
        losses = scored.agg(*[F.avg(-F.log(F.greatest(F.element_at(model._posterior(a), F.col("at")), F.lit(1e-12)))).alias(f"l{k}") for k, a in enumerate(EXPONENTS)]).first()
        losses = [math.inf if x is None else x for x in losses]
        model.exponent = EXPONENTS[int(np.argmin(losses))]
        return model

    def _sums(self, buckets: Column) -> list[Column]:
        """Log likelihood of a text's buckets in each domain, against the common rates."""

        def total(weights: Column, base: float) -> Column:
            return F.aggregate(buckets, F.lit(base), lambda a, b: a + weights[b])

        return [total(_doubles(np.round(w, 6)), float(c)).alias(f"_s{k}") for k, (w, c) in enumerate(zip(self.weights, self.absent, strict=True))]

    def _posterior(self, exponent: float) -> Column:
        """An array in the order of ``domains``, from the columns of ``_sums``."""
        logits = [F.col(f"_s{k}") * exponent + float(p) for k, p in enumerate(self.prior)]
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        parts = [F.exp(x - top) for x in logits]
        return F.transform(F.array(*parts), lambda x: x / sum(parts[1:], parts[0]))

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``posterior``."""
        rest = [c for c in df.columns if c != "posterior"]
        scored = df.withColumn("_runs", runs(F.col(text))).select(*df.columns, *self._sums(F.col("_runs")))
        return scored.select(*rest, self._posterior(self.exponent).alias("posterior"))


def rate(posterior: Column, residuals: list[np.ndarray], max_rate: float | None) -> Column:
    """The rate of a document after the steps so far: a fold over residuals already multiplied by M."""
    if not residuals:
        return F.lit(1.0)
    steps = F.array(*[_doubles(v) for v in residuals])

    def step(r: Column, v: Column) -> Column:
        moved = r - F.aggregate(F.zip_with(posterior, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), moved if max_rate is None else F.least(F.lit(float(max_rate)), moved))

    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(table: DataFrame, targets: np.ndarray, max_rate: float | None = None, max_steps: int = MAX_STEPS) -> tuple[list[np.ndarray], float]:
    """Steps that fit rates of ``table`` (n_tokens, posterior) to the totals ``targets``, and the relative residual they leave.

    Steps use the metric of the rows that are free to move. One that doesn't lower the loss is cut to a quarter, and then
    gives way to the step in the metric of all rows, which always does.
    """
    d = len(targets)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    p = [F.col("posterior")[k] for k in range(d)]

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A r - t, and the Gram matrix of free rows."""
        rows = table.select("n_tokens", "posterior", rate(F.col("posterior"), steps, max_rate).alias("r"))
        free = (F.col("r") > 0) if max_rate is None or not steps else (F.col("r") > 0) & (F.col("r") < max_rate)
        sums = [F.sum(F.col("r") * F.col("n_tokens") * x) for x in p]
        got = rows.agg(*sums, *[F.sum(F.when(free, F.col("n_tokens") * p[i] * p[j])) for i, j in pairs]).first()
        gram = np.zeros((d, d))
        for (i, j), x in zip(pairs, got[d:], strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        return np.array([x or 0.0 for x in got[:d]]) - targets, gram

    steps: list[np.ndarray] = []
    gap, gram = measure(steps)
    metric = _inverse(gram)
    for _ in range(max_steps):
        loss = float(gap @ metric @ gap)
        if np.abs(gap).max() <= TOLERANCE * max(1.0, targets.sum()):
            break
        own = _inverse(gram) @ gap
        for step in (own, own / 4, metric @ gap):
            new, new_gram = measure([*steps, step])
            if float(new @ metric @ new) < loss:
                break
        else:
            break
        steps.append(step)
        small = float(new @ metric @ new) > loss * (1 - LEAST_GAIN)
        gap, gram = new, new_gram
        if small:
            break
    return steps, float(np.abs(gap).max() / max(1.0, targets.sum()))


def _inverse(gram: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(gram + 1e-12 * np.trace(gram) * np.eye(len(gram)), hermitian=True)


def upper_totals(there: np.ndarray, weights: np.ndarray, capped: np.ndarray) -> np.ndarray:
    """Token totals of the domains out of those there are: the scarcest domain that isn't capped is kept whole, and
    capped ones have their share of the sum at most."""
    kept = ~capped & (weights > 0)
    out = np.where(kept, weights * min((t / w for t, w in zip(there[kept], weights[kept], strict=True)), default=0.0), 0.0)
    shares = np.where(capped, weights, 0.0) / max(1.0, weights.sum())
    total = out.sum() / max(1e-9, 1 - shares.sum())
    for _ in range(200):  # falls to the largest total that shares and tokens allow
        total = out.sum() + np.minimum(there, shares * total).sum()
    return np.where(capped, np.minimum(there, shares * total), out)


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, max_rate: float | None = None, key: str = "doc_id", text: str = "text", domain: str = "domain", fit_rows: int = FIT_ROWS, upper: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Adds n_tokens, posterior, rate, copies and residual to the rows of ``documents`` without their text, and names the domains.

    ``targets`` gives each labelled domain its share of the expected tokens; ``budget`` is the total (default: the tokens
    there are; with ``max_rate`` the most that needs no higher rate). ``copies`` is the rate rounded up or down by a hash of ``key``, with the rate as its mean;
    ``residual`` is the largest miss of a domain's total as a share of the targets' sum, the same in every row.

    Targets of the domains in ``upper`` are upper shares: with ``max_rate`` and no ``budget`` the other domains decide the total,
    and a domain of ``upper`` that has fewer tokens than its share, or no labelled row, lowers its own total only.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    keep = [c for c in documents.columns if c not in ("n_tokens", "posterior", "rate", "copies", "residual", text)]
    if documents.isEmpty():
        added = {"n_tokens": "long", "posterior": "array<double>", "rate": "double", "copies": "int", "residual": "double"}
        return documents.select(*keep, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]), sorted(targets)
    model = DomainClassifier.fit(labelled, scratch, key, text, domain, fit_rows)
    targets = {d: w for d, w in targets.items() if d in model.domains or d not in upper}
    if missing := set(targets) - set(model.domains):
        raise ValueError(f"no labelled rows of {sorted(missing)}")
    scored = model.transform(documents.withColumn("n_tokens", tokens(F.col(text))).select(*keep, text, "n_tokens"), text)
    table = scratch.write("posteriors", scored.select(*keep, "n_tokens", "posterior"))
    weights = np.array([targets.get(x, 0.0) for x in model.domains])
    capped = np.array([x in upper for x in model.domains])
    shares = weights / weights.sum()
    there = np.array([x or 0.0 for x in table.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[k]) for k in range(len(weights))]).first()])
    if budget is None and max_rate is not None:
        totals = upper_totals(max_rate * there, weights, capped)
    else:
        totals = shares * (there.sum() if budget is None else budget)
    residuals, left = fit_rates(table, totals, max_rate)
    rated = table.withColumn("rate", rate(F.col("posterior"), residuals, max_rate))
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("copies", copies).withColumn("residual", F.lit(left)), model.domains


def label_domains(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of query and pipeline: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return documents.select("doc_id", "text").join(labels.select("doc_id", domain.alias("domain")), "doc_id")
