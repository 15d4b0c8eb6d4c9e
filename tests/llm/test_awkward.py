"""Names with dots, very long texts, and the pipeline on awkward and on empty tables."""

import time

import pytest

from graphloom.llm import decontaminate, mixing, pii, quality, secrets
from graphloom.llm.labels import TARGETS, labelled_domains

PROSE = "the quiet river of the valley turned and the people of the town were in the fields for a long day with bread and water"


def _documents(spark):
    words = PROSE.split()
    texts = [" ".join(words[(i * k) % len(words)] + ("" if k % 7 else str(i * k % 91)) for k in range(40, 200)) for i in range(1, 40)]
    texts += [texts[0], texts[1] + " end", texts[2].upper(), None, "", " \n", "short", "x " * 30000]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or ""), i, "kept") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, `shard` string").repartition(3)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("awkward"))
    docs = _documents(spark)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, " ".join(PROSE.split()[:12])), (None, "two words")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_columns_with_dots_come_back(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = quality.quality(docs, keep_columns=True)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    left = decontaminate.clean(docs, spark.read.parquet(f"{awkward}/benchmark.parquet"))
    assert left.columns == docs.columns and left.select("`a.b`").count() <= docs.count()
    labelled = labelled_domains(spark.read.parquet(f"{awkward}/labels.parquet"))
    with _quiet():
        mixed = mixing.mixed(docs, mixing.fit(docs, labelled, TARGETS, max_rate=1.0))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


class _quiet:
    """Targets that these few documents cannot meet are no matter here."""

    def __enter__(self):
        import warnings

        self.held = warnings.catch_warnings()
        self.held.__enter__()
        warnings.simplefilter("ignore")

    def __exit__(self, *error):
        self.held.__exit__(*error)


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    import corpus_pipeline

    with _quiet():
        out = corpus_pipeline.run(spark, awkward).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all("a.b" in r.asDict() for r in out)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    with _quiet():
        none = corpus_pipeline.run(spark, str(tmp_path))
    assert none.count() == 0 and {"doc_id", "text", "a.b", "shard", "slot"} <= set(none.columns)


def test_addresses_of_any_length():
    scheme = "abcdefghijklmnopqrstu://ho.st/x"
    assert [s for s in pii.parse("see " + scheme) if s[0] == "address"] == [("address", 4, 4 + len(scheme), False)]
    user = "u" * 70
    text = f"ftp://{user}@ho.st/x"
    assert [s for s in pii.parse(text) if s[0] == "address"] == [("address", 0, len(text), False)]


@pytest.mark.parametrize("one", ["eyJ", "eyJhbGciOi.", "eyJaaaaaaaa.eyJ", "a://", "://", "a@", "u:p@", "+1 ", "account ", "secret", "1.", "1-", "ghp_", "xoxb-"])
def test_long_texts_cost_their_length(one):
    import pyarrow as pa

    took = []
    for size in (1 << 18, 1 << 20):
        text = (one * size)[:size]
        began = time.process_time()
        pii.parse(text)
        secrets_of(pa.array([text]))
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.25)


def secrets_of(texts):
    return secrets.Scanner().scan(texts)


def test_tokens_of_three_parts():
    import pyarrow as pa

    parts = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK"
    got = secrets_of(pa.array([f"x {parts} y", f"z{parts}"]))
    assert [s[:3] for s in got[0] if s[0] == "jwt"] == [("jwt", 2, 2 + len(parts))] and not [s for s in got[1] if s[0] == "jwt"]
