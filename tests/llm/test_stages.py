"""The mixing classifier and the whole pipeline recomputed without Spark, and plans that must stay native."""

import heapq
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from test_llm import _components, _tiles

from graphloom import runtime
from graphloom.llm import chat, mixing, quality, registry
from graphloom.llm.labels import TARGETS, labelled_domains

SPLIT = re.compile(r"[\s.,;:!?\"()]+", re.ASCII)


def _features(text):
    """Distinct tokens and shape marks of a text, and its number of tokens."""
    every = SPLIT.split((text or "").lower())
    share = sum((text or "").count(c) for c in "#*$%&|<>") / max(1, len(text or ""))
    mark = 0 if share == 0 else 1 if share < 0.01 else 2 if share < 0.04 else 3
    variety = math.floor(10 * len(set(every)) / len(every))
    return {*every, f"\x01s{mark}", f"\x01v{variety}"}, sum(bool(w) for w in every)


def _naive_bayes(rows, labels, domains):
    """A function of features: posteriors by the published formulas, on the words of largest gain."""
    known = [(_features(text)[0], domain) for doc, text in rows for domain in labels.get(doc, []) if domain in domains]
    n, m = len(known), Counter(d for _, d in known)
    df, by = Counter(), defaultdict(Counter)
    for words, d in known:
        df.update(words)
        by[d].update(words)

    def gain(w):
        rate = df[w] / n
        return max(m[d] * (by[d][w] / m[d] - (df[w] - by[d][w]) / max(1, n - m[d])) ** 2 / (rate * (1 - rate) + 1e-6) for d in domains if m[d])

    vocabulary = sorted((w for w in df if w and df[w] >= mixing.MIN_DF), key=lambda w: (-gain(w), w))[: mixing.VOCABULARY]

    def posterior(features):
        logs = []
        for d in domains:
            x = math.log((m[d] + 1) / (n + len(domains)))
            for w in vocabulary:
                p = (by[d][w] + mixing.SMOOTHING) / (m[d] + 2 * mixing.SMOOTHING)
                x += mixing.DAMPING * math.log(p if w in features else 1 - p)
            logs.append(x)
        top = max(logs)
        each = [math.exp(x - top) for x in logs]
        return [x / sum(each) for x in each]

    return posterior


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = defaultdict(list)
    for r in labelled_domains(spark.read.parquet(f"{sf}/labels.parquet")).collect():
        labels[r.doc_id].append(r.domain)
    return docs, labels


def test_posteriors_are_those_of_naive_bayes(spark, sf, corpus):
    docs, labels = corpus
    model = mixing.fit_classifier(docs, labelled_domains(spark.read.parquet(f"{sf}/labels.parquet")), tuple(TARGETS))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(d in TARGETS for v in labels.values() for d in v) > 20
    want = _naive_bayes(rows, labels, list(TARGETS))
    texts = rows + [(-1, None), (-2, ""), (-3, "# # word, word"), (-4, "long text. " * 3000)]
    got = mixing.posteriors(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        features, n = _features(r.text)
        assert r.n_tokens == n
        for d, p in zip(TARGETS, want(features), strict=True):
            assert abs(r[f"p_{d}"] - p) < 1.01 * 10**-mixing.DECIMALS


def test_draws_follow_the_rates(spark, corpus):
    """A document stays if the hash of its id and text, recomputed here, is under its rate."""
    docs, _ = corpus
    model = mixing.Classifier(tuple(TARGETS), (0.0, 0.0, 0.0))
    mix = mixing.Mix(model, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0), ((0.6, 0.6, 0.6),), 1.0)
    kept = Counter(r.doc_id for r in mixing.mixed(docs, mix).collect())

    def draw(doc, text):
        seed = xxhash.xxh64_intdigest(b"mix", 42)
        seed = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), seed)
        if text is not None:
            seed = xxhash.xxh64_intdigest(text.encode(), seed)
        return seed % (1 << 30) / (1 << 30)

    rows = docs.collect()
    rate = mixing.rates(docs, mix).first().rate
    assert abs(rate - 0.4) < 1e-3
    want = Counter(r.doc_id for r in rows if draw(r.doc_id, r.text) < rate)
    assert kept == want and 0 < len(want) < len(rows)


def _heap_loads(texts, shards=16):
    loads = Counter()
    for t in texts:
        loads[t] += len((t or "").encode()) + 1
    heap = [0] * shards
    for x in sorted(loads.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + x)
    return sorted(heap)


def test_pipeline_run_is_its_stages(spark, sf, corpus, monkeypatch):
    """``run`` from its input to its rows: each decision is recomputed, on what the last one left."""
    import corpus_pipeline as cp

    docs, _ = corpus
    text = {r.doc_id: r.text for r in docs.collect()}
    left = sorted(r.doc_id for r in quality.quality(docs).collect() if r.kept)
    left = sorted(d for d, _, c in _components([(d, text[d]) for d in left]) if d == c)
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(d):
        w = words(text[d])
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for t in items:
            reach = {j + x for j in range(len(t) - 4) if tuple(t[j : j + 5]) in grams for x in range(5)}
            if len(reach) < 0.5 * len(t) or len(t) < 5:  # tiles lie within shared runs of 5 words
                continue
            if f" {' '.join(t)} " in f" {' '.join(w)} " or _tiles(w, t, 5) >= 0.5 * len(t):
                return True
        return False

    assert all(len(t) >= 5 for t in items)
    left = [d for d in left if not leaks(d)]
    mixes, fit = [], mixing.fit
    monkeypatch.setattr(mixing, "fit", lambda *a, **k: mixes.append(fit(*a, **k)) or mixes[-1])
    with runtime.job(spark):
        out = cp.run(spark, sf).collect()
    (mix,) = mixes
    rated = mixing.rates(docs.where(docs.doc_id.isin(left)), mix).collect()
    # the rates solve the bounded problem: totals at the targets, or no allowed move lowers the largest gap's square
    totals = [sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in rated) for d in TARGETS]
    assert all(0 <= r.rate <= 1 for r in rated) and totals == pytest.approx(mix.totals, rel=1e-6)
    if mix.gap > mixing.TOLERANCE:
        pull = [(t - x) / max(t, 1.0) for t, x in zip(mix.targets, totals, strict=True)]
        assert all(r.rate > 0.99 for r in rated if sum(r[f"p_{d}"] * y for d, y in zip(TARGETS, pull, strict=True)) > 0.1)
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rated if r.copies)
    assert all(r.text == text[r.doc_id] for r in out)
    loads, slots = Counter(), defaultdict(list)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 1
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(loads[s] for s in range(16)) == _heap_loads([r.text for r in out])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name", ["op2_mixing_rates", "op8_chat_fsm"])
def test_native_queries_have_no_python_in_their_plans(spark, sf, name):
    with runtime.job(spark):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and not re.search("Python|Arrow|Pandas|MapPartitions|ExistingRDD", plan)


def test_chat_formatting_is_native(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    for df in (chat.formatted(talks), chat.digest(chat.formatted(talks))):
        assert not re.search("Python|Arrow|Pandas|MapPartitions", df._jdf.queryExecution().executedPlan().toString())
