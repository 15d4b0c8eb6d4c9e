"""Soft-membership mixing: document rates that bring domains to target weights.

DataFrame functions only. A Bernoulli naive Bayes classifier, fitted on a
bounded sample of labelled documents, gives each document a posterior over the
domains. Projected-gradient least squares then finds nonnegative rates r whose
expected domain totals, the sum of tokens * posterior * r, match the targets.

The gradient of a rate depends on the document's posterior alone, so documents
of equal posterior (rounded to ``DECIMALS``) share a rate. Totals are therefore
summed once by posterior, each step is an aggregate over that small table, and
a document's rate is a closed expression of its posterior and the residuals of
all steps. A step shrinks a rare domain's gap only a little; where the steps
end short of the optimum, Newton steps on one multiplier a domain finish it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import stash

#: Labelled documents that the classifier is fitted on at most; the least hashes of doc_id are taken.
MAX_TRAIN = 20_000
VOCABULARY = 160
MIN_DF = 5
SMOOTHING = 1.0
#: Words of one text depend on each other; log odds are damped by this factor.
DAMPING = 0.5
DECIMALS = 3
STEPS = 25
TOLERANCE = 1e-3
NEWTON_STEPS = 60
#: Weights of the multipliers' penalty, each solved from the last one's solution.
_PENALTIES = (1e-2, 1e-4, 1e-6, 1e-8)

_SPLIT = r"[\s.,;:!?\"()]+"


def _tokens() -> Column:
    return F.split(F.lower(F.coalesce("text", F.lit(""))), _SPLIT)


def _described(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_tokens`` (distinct, shape marks among them) and ``_n``, the number of tokens."""
    t = docs.withColumn("_all", _tokens())
    empty = (F.col("_all")[0] == "").cast("long") + ((F.element_at("_all", -1) == "") & (F.size("_all") > 1)).cast("long")
    t = t.withColumn("_n", F.size("_all") - empty).withColumn("_some", F.array_distinct("_all"))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    share = F.coalesce(symbols / F.greatest(F.length("text"), F.lit(1)), F.lit(0.0))
    mark = F.when(share == 0, "\x01s0").when(share < 0.01, "\x01s1").when(share < 0.04, "\x01s2").otherwise("\x01s3")
    variety = F.floor(10 * F.size("_some") / F.greatest(F.size("_all"), F.lit(1)))
    return t.withColumn("_tokens", F.concat("_some", F.array(mark, F.concat(F.lit("\x01v"), variety.cast("string"))))).drop("_all", "_some")


@dataclass(frozen=True)
class Classifier:
    """Log weights of presence by word, and each domain's bias; no words give the priors."""

    domains: tuple[str, ...]
    bias: tuple[float, ...]
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def score(self, described: DataFrame, names: list[str]) -> DataFrame:
        """``described`` with a rounded posterior for each name, in domain order; they sum to 1.

        The logits are a column of their own, so each text is looked up once.
        """
        zero = F.array(*[F.lit(b) for b in self.bias])
        logits = zero
        if self.words:
            table = F.create_map(*[x for w, v in self.words.items() for x in (F.lit(w), F.array(*[F.lit(a) for a in v]))])
            present = F.array_intersect("_tokens", F.array(*[F.lit(w) for w in self.words]))
            logits = F.aggregate(F.transform(present, lambda w: F.element_at(table, w)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        d = described.withColumn("_logits", logits)
        each = [F.col("_logits")[i] for i in range(len(names))]
        top = F.greatest(*each) if len(each) > 1 else each[0]
        d = d.withColumns({f"_e{i}": F.exp(F.greatest(x - top, F.lit(-60.0))) for i, x in enumerate(each)})
        total = sum((F.col(f"_e{i}") for i in range(1, len(names))), F.col("_e0"))
        d = d.withColumns({name: F.round(F.col(f"_e{i}") / total, DECIMALS) for i, name in enumerate(names[:-1])})
        rest = F.lit(1.0)
        for name in names[:-1]:
            rest = rest - F.col(name)
        return d.withColumn(names[-1], F.round(F.greatest(rest, F.lit(0.0)), DECIMALS)).drop("_logits", "_tokens", *[f"_e{i}" for i in range(len(names))])


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], max_train: int = MAX_TRAIN) -> Classifier:
    """Fit on ``labelled`` (``doc_id, domain``); rows of other or null domains are passed over.

    Without usable labels every domain is equally likely.
    """
    sample = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_train)
    # at most max_train rows
    known = _described(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    each = stash(known.select("domain", "_tokens"), "labelled")
    sizes = {r["domain"]: r["k"] for r in each.groupBy("domain").agg(F.count(F.lit(1)).alias("k")).collect()}
    n_k = [sizes.get(d, 0) for d in domains]
    n = sum(n_k)
    if not n:
        return Classifier(domains, tuple([-math.log(len(domains))] * len(domains)))
    by_domain = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    counts = each.select("domain", F.explode("_tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *by_domain)
    rate = F.col("df") / n
    gains = [m * F.pow(F.col(f"c{i}") / m - (F.col("df") - F.col(f"c{i}")) / max(1, n - m), F.lit(2.0)) / (rate * (1 - rate) + 1e-6) for i, m in enumerate(n_k) if m]
    gain = F.greatest(*gains) if len(gains) > 1 else gains[0]
    best = counts.where((F.col("df") >= MIN_DF) & (F.col("word") != "")).orderBy(F.desc(gain), "word").limit(VOCABULARY).collect()
    bias = [math.log((m + 1) / (n + len(domains))) for m in n_k]
    words = {}
    for r in best:
        p = [(r[f"c{i}"] + SMOOTHING) / (m + 2 * SMOOTHING) for i, m in enumerate(n_k)]
        words[r["word"]] = tuple(DAMPING * (math.log(x) - math.log(1 - x)) for x in p)
        bias = [b + DAMPING * math.log(1 - x) for b, x in zip(bias, p, strict=True)]
    return Classifier(domains, tuple(bias), words)


@dataclass(frozen=True)
class Mix:
    """A fitted mix: classifier, targets, totals reached, and the residual of every step.

    Where steps did not suffice there are none, and a rate is 1 less the
    posterior's product with ``multipliers``. ``gap`` is the largest difference
    of a total from its target, as a share of the target (of all tokens where
    that is 0): beyond TOLERANCE only if no rates within the bounds do better.
    """

    classifier: Classifier
    targets: tuple[float, ...]
    totals: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]
    max_rate: float | None
    multipliers: tuple[float, ...] | None = None
    gap: float = 0.0

    def rate(self, posteriors: list[Column]) -> Column:
        if self.multipliers is not None:
            return _solved(posteriors, self.multipliers, self.max_rate)
        return _rate(posteriors, self.steps, self.max_rate)


def _rate(p: list[Column], steps, max_rate: float | None) -> Column:
    """The rate after all steps: a fold over their residuals, which are data, so every step runs the same code."""
    if not steps:
        return F.lit(1.0)
    residuals = F.array(*[F.array(*[F.lit(x) for x in e]) for e in steps])

    def step(r: Column, e: Column) -> Column:
        move = p[0] * e[0]
        for i in range(1, len(p)):
            move = move + p[i] * e[i]
        r = F.greatest(r - move, F.lit(0.0))
        return r if max_rate is None else F.least(r, F.lit(max_rate))

    return F.aggregate(residuals, F.lit(1.0), step)


def _free(p: list[Column], multipliers) -> Column:
    """1 less the product of posterior and multipliers, before bounds."""
    values = F.array(*[F.lit(float(x)) for x in multipliers])
    out = F.lit(1.0)
    for i, c in enumerate(p):
        out = out - c * values[i]
    return out


def _solved(p: list[Column], multipliers, max_rate: float | None) -> Column:
    r = F.greatest(_free(p, multipliers), F.lit(0.0))
    return r if max_rate is None else F.least(r, F.lit(max_rate))


def _newton(table: DataFrame, p: list[Column], target: list[float], scale: list[float], max_rate: float | None) -> tuple[float, ...]:
    """Multipliers whose rates solve the bounded least squares to a residual, else an error.

    Of all solutions it is the one of rates nearest to 1. With a penalty e the
    multipliers x satisfy ``totals(x) - target = e * scale * x``, one root of a
    monotone map; the penalty then falls until it is small beside TOLERANCE.
    """
    k = len(p)
    c, t = np.array(scale), np.array(target)

    def look(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free = _free(p, x)
        inside = (free > 0) if max_rate is None else (free > 0) & (free < max_rate)
        r = _solved(p, x, max_rate)
        sums = [F.sum(F.col("n") * p[i] * r) for i in range(k)]
        slopes = [F.sum(F.when(inside, F.col("n") * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        row = [float(v or 0) for v in table.agg(*[v.alias(f"s{i}") for i, v in enumerate(sums + slopes)]).collect()[0]]
        return np.array(row[:k]), np.array(row[k:]).reshape(k, k)

    x = np.zeros(k)
    now, slope = look(x)
    for penalty in _PENALTIES:
        root = np.sqrt(c)  # residuals are compared in these units
        value = lambda now, x: (t - now + penalty * c * x) / c  # noqa: B023, E731
        f = value(now, x)
        for _ in range(NEWTON_STEPS):
            if np.abs(f).max() < TOLERANCE / 100:
                break
            jacobian = (slope + penalty * np.diag(c)) / np.outer(root, root)
            move = np.linalg.solve(jacobian, -f * c / root) / root
            part = 1.0
            while True:
                next_now, next_slope = look(x + part * move)
                next_f = value(next_now, x + part * move)
                if np.linalg.norm(next_f * root) < (1 - part / 1000) * np.linalg.norm(f * root) or part < 1e-4:
                    break
                part /= 2
            x, now, slope, f = x + part * move, next_now, next_slope, next_f
        else:
            raise ArithmeticError(f"mixing rates: {NEWTON_STEPS} Newton steps left a residual of {np.abs(f).max():.3g} at penalty {penalty}")
    return tuple(float(v) for v in x)


def _names(domains: tuple[str, ...]) -> list[str]:
    return [f"p_{d}" for d in domains]


def fit_rates(scored: DataFrame, model: Classifier, weights: dict[str, float], tokens: float | None = None, max_rate: float | None = None) -> Mix:
    """Fit on ``n_tokens`` and the posteriors of all documents; see ``fit``."""
    names = _names(model.domains)
    p = [F.col(x) for x in names]
    table = stash(scored.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("n")), "posteriors")

    def totals(steps) -> list[float]:
        r = _rate(p, steps, max_rate)
        row = table.agg(*[F.sum(F.col("n") * c * r).alias(f"s{i}") for i, c in enumerate(p)]).collect()[0]
        return [float(x or 0) for x in row]

    have = totals([])
    share = [w / (sum(weights.values()) or 1) for w in weights.values()]
    if tokens is None:
        top = max(range(len(share)), key=share.__getitem__)
        tokens = max_rate * have[top] / share[top] if max_rate is not None and share[top] > 0 else sum(have)
    target = [s * tokens for s in share]
    scale = [max(h, t) or 1.0 for h, t in zip(have, target, strict=True)]
    steps: list[tuple[float, ...]] = []
    now = have
    for _ in range(STEPS):
        e = tuple((s - t) / c for s, t, c in zip(now, target, scale, strict=True))
        if max(map(abs, e)) < TOLERANCE:
            break
        steps.append(e)
        before, now = now, totals(steps)
        if max(abs(x - y) / c for x, y, c in zip(now, before, scale, strict=True)) < TOLERANCE:  # held by the bounds, or slow
            break

    def gap() -> float:
        return max((abs(s - t) / (t or sum(target) or 1.0) for s, t in zip(now, target, strict=True)), default=0.0)

    multipliers = None
    if gap() > TOLERANCE and sum(have) > 0 and sum(target) > 0:
        multipliers = _newton(table, p, target, scale, max_rate)
        steps = []
        row = table.agg(*[F.sum(F.col("n") * c * _solved(p, multipliers, max_rate)).alias(f"s{i}") for i, c in enumerate(p)]).collect()[0]
        now = [float(x or 0) for x in row]
        if gap() > TOLERANCE:
            warnings.warn(f"mixing rates: no rates within the bounds meet the targets {target}; the totals are {now}", stacklevel=2)
    return Mix(model, tuple(target), tuple(now), tuple(steps), max_rate, multipliers, gap())


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], tokens: float | None = None, max_rate: float | None = None, max_train: int = MAX_TRAIN) -> Mix:
    """Fit rates for ``weights`` of the domains (any scale).

    ``tokens`` is the total to reach: by default the corpus' own, or with
    ``max_rate`` the total at which the domain of the largest weight keeps all
    it has times that rate. Domains that have less than their target then stay
    whole.
    """
    model = fit_classifier(docs, labelled, tuple(weights), max_train)
    return fit_rates(posteriors(docs.select("text"), model), model, weights, tokens, max_rate)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``n_tokens`` and the posterior of each domain."""
    scored = model.score(_described(docs), _names(model.domains))
    return scored.withColumn("n_tokens", F.col("_n").cast("long")).drop("_n")


def _draw() -> Column:
    """A number from 0 to 1 that the text and id alone decide."""
    return F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)


def _copies(rate: Column, draw: Column) -> Column:
    """Whole copies, and one more with the rate's fraction as its chance."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _rated(scored: DataFrame, mix: Mix) -> DataFrame:
    names = _names(mix.classifier.domains)
    rated = scored.withColumn("rate", mix.rate([F.col(x) for x in names]))
    return rated.select("doc_id", "n_tokens", *names, "rate", _copies(F.col("rate"), F.col("_draw")).alias("copies"))


def rates(docs: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies`` for every row of ``docs``.

    Null and empty texts have 0 tokens and a posterior like any other text.
    Repeated rows get equal rates and copies.
    """
    return _rated(posteriors(docs.select("doc_id", "text", _draw().alias("_draw")), mix.classifier), mix)


def fitted_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], tokens: float | None = None, max_rate: float | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """``fit`` and ``rates`` with one scan of the texts between them: the posteriors are kept as a table.

    Rows as in ``rates``. Weights need not sum to 1; equal ones are treated
    alike. Other columns of ``docs`` are not read; an empty table gives no row.
    """
    model = fit_classifier(docs, labelled, tuple(weights), max_train)
    scored = stash(posteriors(docs.select("doc_id", "text", _draw().alias("_draw")), model).drop("text"), "scored")
    return _rated(scored, fit_rates(scored, model, weights, tokens, max_rate))


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; no shuffle.

    Null and empty texts have a posterior like any other, whole texts are read,
    equal rows get equal copies, and an empty table stays empty. Columns of any
    name are returned as they are.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"), _draw().alias("_draw"))
    # The row number keeps the filter above the scores: pushed down, it would repeat their expressions many times over.
    scored = posteriors(whole, mix.classifier).withColumn("_place", F.monotonically_increasing_id())
    rated = scored.withColumn("_rate", mix.rate([F.col(x) for x in _names(mix.classifier.domains)]))
    counted = rated.withColumn("_copies", _copies(F.col("_rate"), F.col("_draw"))).where((F.col("_copies") > 0) & (F.col("_place") >= 0))
    if mix.max_rate is not None and mix.max_rate <= 1:
        return counted.select("_row.*")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
