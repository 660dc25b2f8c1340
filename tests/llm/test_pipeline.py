"""The pipeline, stage by stage, against plain Python on the same rows, and as a whole."""

import math

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pixelloom.llm import langid, quality, secrets
from pixelloom.llm._common import mark
from tests.llm.test_langid import brute_predictions
from tests.llm.test_models import brute_statistics, mixed
from tests.llm.test_simhash import brute_fp, brute_roots
from tests.llm.test_tokens import check_packing

TOKEN = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


@pytest.fixture
def corpus(docs, prose):
    rows = [(i, prose(40 + i, i), "en") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, "!! ".join(rows[5][1].upper().split()), "en"), (102, "12 34 56", "en"), (103, None, "en"), (104, "", None), (105, rows[7][1] + f' token = "{TOKEN}"', "en")]
    rows += [(200 + i, " ".join(w[::-1] for w in prose(50, i).split()), "de") for i in range(30)]
    return rows, docs(rows)


def test_stages(spark, corpus, tmp_path):
    rows, frame = corpus
    columns, texts = frame.columns, {i: t for i, t, _ in rows}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_classifier", "near_duplicates", "secret_scan", "best_fit_packing"]

    named = stages["language_id"](spark, frame, "")
    found = brute_predictions([t or "" for _, t, _ in rows], langid.fit(frame), near=True)
    want = {i for (i, _, _), (lang, near) in zip(rows, found) if lang != "und" and not near}
    assert named.columns == columns and {r["doc_id"] for r in named.collect()} == want and not want & {102, 103, 104} and len(want) > 90

    good = stages["quality_classifier"](spark, named, "")
    model = quality.fit(named)
    kept = {i for i in want if brute_score(texts[i], model) >= model.threshold}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == kept and 101 not in kept and len(kept) > 85

    one = stages["near_duplicates"](spark, good, "")
    ids = sorted(kept)
    roots = brute_roots([brute_fp(texts[i]) for i in ids])
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == [ids[i] for i in range(len(ids)) if roots[i] == i]
    assert 100 not in [r["doc_id"] for r in one.collect()]

    clean = stages["secret_scan"](spark, one, "")
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and len(got) == one.count()
    for i, r in got.items():
        assert r["text"] == secrets.masked(texts[i], secrets.all_spans(texts[i])[1], "[SECRET]") and r["n_chars"] == len(r["text"])
    assert TOKEN not in "".join(r["text"] for r in got.values())

    packed = stages["best_fit_packing"](spark, clean, "").collect()
    check_packing([(i, r["text"]) for i, r in got.items()], packed, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def brute_score(text, model):
    """The scorer's sum over a text's n-grams and bins, one by one."""
    raw = b"\n\n" + text.encode() + b"\n\n"
    slot = lambda x: (x * 2654435761 & 0xFFFFFFFF) >> (32 - quality.BITS)
    total, n = 0.0, len(raw) - 2
    for i in range(n):
        two = raw[i] << 8 | raw[i + 1]
        total += model.weights[slot(two + 0x9E3779)] + model.weights[slot(two << 8 | raw[i + 2]) + (1 << quality.BITS)]
    total = total / (n + quality.DAMP) + model.bias
    words = len(text.split())
    for k, (x, (_, _, bad, good, least)) in enumerate(zip(brute_statistics(text), quality.LABELLERS)):
        sign = 1 if bad > good else -1
        if words >= least and (sign * x >= sign * bad or sign * x <= sign * good):
            edges = [2 * max(bad, good) * e / quality.BINS for e in range(1, quality.BINS)]
            total += model.weights[(2 << quality.BITS) + k * quality.BINS + sum(x >= e for e in edges)]
    return 1 / (1 + math.exp(-total))


def test_scores_equal_plain_sums(docs, prose):
    rows = [(i, t) for i, t, _ in mixed(300, 1)] + [(1000 + i, prose(30 + i, i)) for i in range(50)]
    model = quality.fit(docs(rows))
    assert model.weights is not None
    for r in quality.classify(docs(rows), model).collect():
        assert abs(r["score"] - brute_score(dict(rows)[r["doc_id"]], model)) < 1e-5


def test_stages_keep_rows_without_ids_and_other_columns(spark, docs, awkward, prose):
    rows = [*awkward, *[(100 + i, prose(30 + i, i)) for i in range(40)], *[(None, prose(60 + i, 70 + i)) for i in range(3)]]
    frame = docs(rows, extra=True).drop("n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns, name
        frame = spark.createDataFrame(out.collect(), out.schema)
        left = {r["text"] for r in frame.collect() if r["doc_id"] is None}
        assert {t for i, t in rows[-3:]} <= left, name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").where("doc_id is null").count() >= 3


def test_run_leaves_only_its_result(spark, corpus, tmp_path):
    _, frame = corpus
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    before = mark()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert mark() == before + 1 and got.count() > 80


def test_run(spark, corpus, tmp_path):
    _, frame = corpus
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) > 80 and corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
