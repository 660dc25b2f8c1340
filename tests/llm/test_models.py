"""Masked language model and quality classifier."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pixelloom.llm import masked_lm, quality
from pixelloom.llm.queries import op4_masked_lm, op10_quality
from tests.llm.conftest import AWKWARD


def grammar(n, seed, order=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        parts = [w for _ in range(12) for w in (rng.choice(["the", "a"]), rng.choice(["cat", "dog", "owl"]), rng.choice(["sees", "eats"]), rng.choice(["fish", "grass"]), ".")]
        if not order:
            rng.shuffle(parts)
        rows.append(" ".join(parts))
    return rows


def ascii_words(text):
    return [w for w in re.split("[ \\t-\\r]+", text or "") if w]


def keys(words):
    key, _, shape = masked_lm.keys_of(pa.array([w.encode() for w in words], pa.large_binary()))
    return dict(zip(words, zip(key.tolist(), shape.tolist())))


def test_counts_cover_all_documents(docs, monkeypatch):
    monkeypatch.setattr(masked_lm, "SLICE", 100)
    monkeypatch.setattr(masked_lm, "HELD", 7)
    rows = [*((i, t) for i, t in enumerate(grammar(50, 1) + rare(3, 6))), *AWKWARD]
    want = Counter(w for _, t in rows for w in ascii_words(t))
    of = keys(list(want))
    counts = masked_lm.count_words(docs(rows)).collect()
    got = {r["key"]: (r["n"], r["shape"]) for r in counts}
    assert got == {of[w][0]: (n, of[w][1]) for w, n in want.items()} and len(got) == len(want)
    tails = {of[w][0]: int.from_bytes(w.encode()[::-1][:7].ljust(7, b"\0"), "big") for w in want}
    assert {r["key"]: r["tail"] for r in counts} == tails


def test_keys_differ():
    rng = random.Random(3)
    words = list({"".join(rng.choice("abé\x00Z!") for _ in range(rng.choice([1, 2, 3, 5, 9, 2000]))) for _ in range(5000)})
    assert len({k for k, _ in keys(words).values()}) == len(words)
    assert keys(words[:100]) == {w: k for w, k in keys(words).items() if w in words[:100]}


def brute_scores(rows, scorer):
    """Each document's sum, word by word, in plain Python and double precision."""
    v, net = scorer.vocabulary, masked_lm.Network(*(x.astype(np.float64) for x in scorer.network.parts()))
    place = {k: i for i, k in enumerate(v.keys.tolist())}
    counts = {r["key"]: r["n"] for r in scorer.counts.collect()}
    mass = v.count[masked_lm.OWN :]
    got = []
    for _, text in rows:
        words = ascii_words(text)
        of = keys(words) if words else {}
        code = [int(v.codes[place[of[w][0]]]) if of[w][0] in place else masked_lm.OWN + of[w][1] for w in words]
        total = 0.0
        for i, w in enumerate(words):
            around = [code[i + d] if 0 <= i + d < len(code) else masked_lm.EDGE for d in (-2, -1, 1, 2)]
            h = np.tanh(sum(net.gates[k] * net.vectors[c] for k, c in enumerate(around)) + net.bias)
            c = code[i]
            out, cluster = (int(x[0]) for x in masked_lm.outputs_of(np.array([c])))
            logits = h @ net.first + net.first_bias
            total += logits[out] - np.log(np.exp(logits).sum())
            if cluster >= 0:
                logits = h @ net.second[cluster] + net.second_bias[cluster]
                total += logits[(c - masked_lm.SINGLES) % masked_lm.EACH] - np.log(np.exp(logits).sum())
            if c >= masked_lm.OWN:
                total += np.log(counts.get(of[w][0], 1)) - np.log(mass[c - masked_lm.OWN] + 1)
        got.append((len(words), total))
    return got


def rare(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghé") for _ in range(rng.choice([2, 3, 3, 4, 4]))) for _ in range(300)) for _ in range(n)]


def test_scores_equal_plain_sums(docs, monkeypatch):
    rows = [*enumerate(grammar(60, 1) + rare(60, 2)), *((1000 + k, t) for k, (_, t) in enumerate(AWKWARD))]
    frame = docs(rows)
    scorer = masked_lm.fit(frame, table=4500)
    whole = {r["doc_id"]: tuple(r) for r in masked_lm.score(frame, scorer).collect()}
    assert len(scorer.vocabulary.keys) == 4500 and scorer.counts.where("n > 1").count() > 100
    for (i, _), (n, total) in zip(rows, brute_scores(rows, scorer)):
        assert whole[i][1] == n and abs(whole[i][2] - total) < 1e-4 * (n + 1)
    assert masked_lm.score(frame, scorer).where("doc_id = 7").first()[2] == whole[7][2]
    foreign = [(1, "words that no one counted, Zyx"), (2, grammar(1, 9)[0])]
    for r, (n, total) in zip(sorted(masked_lm.score(docs(foreign), scorer).collect()), brute_scores(foreign, scorer)):
        assert r["n_words"] == n and abs(r["log_prob"] - total) < 1e-4 * (n + 1)


def test_segments_see_their_neighbours(docs, monkeypatch):
    rows = [*enumerate(grammar(10, 1)), (50, None), (51, "")]
    frame = docs(rows)
    scorer = masked_lm.fit(frame)
    whole = sorted(masked_lm.score(frame, scorer).collect())
    v = scorer.vocabulary
    ids, counts = masked_lm.C.words_of(pa.array([rows[0][1]]))
    assert counts.tolist() == [60] and len(ids) == 60

    cut = encode_in_segments(docs, rows, v, 7, monkeypatch)
    assert sorted(masked_lm.score_encoded(cut, scorer).collect()) == whole and cut.count() > 60


def encode_in_segments(docs, rows, v, size, monkeypatch):
    """The rows of `encode`, made in this process so that the segment size can be changed."""
    import types

    monkeypatch.setattr(masked_lm, "SEGMENT", size)
    made = []

    class Frame:
        def mapInArrow(self, run, schema):
            texts = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
            made.extend(r for b in run(iter([texts])) for r in b.to_pylist())
            return schema

    class Docs:
        sparkSession = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x)))

    monkeypatch.setattr(masked_lm.C, "id_and_text", lambda *a: types.SimpleNamespace(select=lambda *a: Frame()))
    monkeypatch.setattr(masked_lm.C, "stored", lambda df, name: df)
    schema = masked_lm.encode(Docs(), v)
    monkeypatch.undo()
    return docs([]).sparkSession.createDataFrame([tuple(r.values()) for r in made], schema)


def test_chances_sum_to_one():
    rng = np.random.default_rng(0)
    net = masked_lm.Network.start(rng.integers(0, 1000, masked_lm.CODES))
    framed = np.repeat(rng.integers(0, masked_lm.CODES, 5)[None, :], masked_lm.CODES, axis=0).astype(np.uint16)
    framed[:, 2] = np.arange(masked_lm.CODES)
    lp = net.scores(framed.ravel(), 5 * np.arange(masked_lm.CODES) + 2) / masked_lm.UNIT
    assert abs(np.exp(lp).sum() - 1) < 1e-2


def test_gradient_steps_lower_the_loss():
    framed = np.concatenate([[masked_lm.EDGE] * 2, np.tile([1, 70, 200, masked_lm.OWN + 3, 5, 4000], 400), [masked_lm.EDGE] * 2]).astype(np.uint16)
    places = np.arange(2, len(framed) - 2)
    net = masked_lm.Network.start(np.ones(masked_lm.CODES))
    before = net.scores(framed, places).mean()
    for _ in range(10):
        net.train(framed, places, 0.2)
    assert net.scores(framed, places).mean() > before + 2 * masked_lm.UNIT
    assert np.array_equal(masked_lm.Network.shaped(net.flat()).scores(framed, places), net.scores(framed, places))


def test_gradients_by_differences():
    """One step on one block moves along the true gradient's direction, checked by small changes of single weights."""
    rng = np.random.default_rng(2)
    framed = rng.integers(0, masked_lm.CODES, 300).astype(np.uint16)
    places = np.arange(2, 298)
    loss = lambda net: -net.scores(framed, places).sum() / masked_lm.UNIT
    base, moved = (masked_lm.Network.start(np.ones(masked_lm.CODES)) for _ in range(2))
    moved.train(framed, places, 1e-3, block=1000)
    for name in ("vectors", "gates", "bias", "first", "first_bias", "second", "second_bias"):
        step = getattr(moved, name) - getattr(base, name)
        i = np.unravel_index(np.abs(step).argmax(), step.shape)
        up, down = (masked_lm.Network.shaped(base.flat().copy()) for _ in range(2))
        getattr(up, name)[i] += 0.02
        getattr(down, name)[i] -= 0.02
        assert (loss(up) - loss(down)) * step[i] < 0, name


def test_masked_places():
    sizes = np.array([4, 5, 14, 20])  # 0, 1, 10 and 16 words
    for start in range(3):
        got = masked_lm.masked_places(sizes, 3, np.full(4, start))
        want, at = [], 0
        for size in sizes:
            want += [at + 2 + w for w in range(start, size - 4, 3)]
            at += size
        assert got.tolist() == want


def test_ordered_text_scores_higher_than_shuffled(docs):
    train = docs([(i, t) for i, t in enumerate(grammar(400, 2))])
    scorer = masked_lm.fit(train)
    good = masked_lm.score(docs([(i, t) for i, t in enumerate(grammar(20, 3))]), scorer).collect()
    bad = masked_lm.score(docs([(i, t) for i, t in enumerate(grammar(20, 3, order=False))]), scorer).collect()
    assert min(r["mean_log_prob"] for r in good) > max(r["mean_log_prob"] for r in bad)
    assert all(abs(r["log_prob"] - r["mean_log_prob"] * r["n_words"]) < 1e-6 for r in good)


def test_lm_query_on_awkward_rows(spark, docs, tmp_path):
    rows = [*AWKWARD, *((100 + i, t) for i, t in enumerate(grammar(30, 4) + rare(30, 5) + grammar(30, 4)))]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_masked_lm(spark, str(tmp_path)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        n = len(ascii_words(t))
        assert by_id[i]["n_words"] == n and np.isfinite(by_id[i]["log_prob"]) and (n > 0) == (by_id[i]["log_prob"] < 0)
    assert by_id[9][1:] == by_id[10][1:] and all(by_id[100 + i][1:] == by_id[160 + i][1:] for i in range(30))


def test_tasks_do_not_change_scores(docs):
    frame = docs([(i, t) for i, t in enumerate(grammar(40, 4) + rare(40, 5))])
    one, many = (sorted(masked_lm.fit_and_score(frame.repartition(n), shard_words=4000, table=4500).collect()) for n in (1, 7))
    assert one == many


def test_lm_of_empty_tables(docs):
    none = masked_lm.fit(docs([]))
    assert masked_lm.score(docs([]), none).count() == 0
    assert np.isfinite(masked_lm.score(docs([(1, "some words")]), none).first()["log_prob"])


def test_every_document_trains_the_network(docs):
    for i in (1, 2, 3, 4, None):
        scorer = masked_lm.fit(docs([(i, grammar(1, 5)[0])]), rounds=1)
        assert not np.array_equal(scorer.network.flat(), masked_lm.Network.start(scorer.vocabulary.count).flat())


def test_vocabulary_of_many_different_counts(spark):
    counts = spark.range(1, 9001).selectExpr("id * 7919 as key", "id as tail", "id % 32 as shape", "id as n")
    v = masked_lm.build_vocabulary(counts, 5000)
    assert sorted(v.keys.tolist()) == [7919 * i for i in range(4001, 9001)] and v.total == 9000 * 9001 // 2 == v.count.sum()


def test_words_as_frequent_as_the_last_enter_by_key(docs):
    counts = masked_lm.count_words(docs([(i, f"once{i} twice{i // 2}") for i in range(4000)]))
    v = masked_lm.build_vocabulary(counts, 3000)
    assert 2800 <= len(v.keys) <= 3000 and (np.diff(v.keys) > 0).all()


def junk(kind, n, rng):
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return {"good": lambda: " ".join(w + "." * (i % 9 == 8) for i, w in enumerate(words)) + ".", "shout": lambda: "!! ".join(w.upper() for w in words), "symbols": lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words), "bars": lambda: " | ".join(words), "echo": lambda: " ".join([words[0]] * n)}[kind]()


def mixed(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["good"] * 16 + ["shout", "symbols", "bars", "echo"])
        rows.append((i, junk(kind, rng.randint(15, 90), rng), kind))
    return rows


def test_label_model_and_scorer(docs):
    rows = mixed(600, 1)
    model = quality.fit(docs([r[:2] for r in rows]))
    assert 0.6 < model.labels.share[-1] < 0.95 and all(0 <= a <= 1 for a in model.labels.accuracies().values())
    fresh = mixed(300, 2)
    got = {r["doc_id"]: r for r in quality.classify(docs([r[:2] for r in fresh]), model).collect()}
    good = [got[i]["keep"] for i, _, k in fresh if k == "good"]
    bad = [got[i]["keep"] for i, _, k in fresh if k != "good"]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def brute_statistics(text):
    raw = text.encode()
    words = raw.split()
    solid = [b for b in raw if b not in b" \t\n\r\x0b\x0c"]
    mark = lambda b: b in quality.MARKS
    letter = lambda b: b > 127 or chr(b).isalpha()
    share = lambda hits, of: sum(hits) / max(len(of), 1)
    ascii_letters = [b for b in raw if b < 128 and chr(b).isalpha()]
    lines = [p for p in raw.split(b"\n") if p]
    folded = Counter(raw.lower())
    return [
        share((b in quality.SYMBOLS for b in solid), solid),
        share(map(mark, solid), solid),
        share(map(letter, solid), solid),
        share((65 <= b <= 90 for b in ascii_letters), ascii_letters),
        share((mark(a) and a == b for a, b in zip(raw, raw[1:])), solid),
        share((not any(map(letter, w)) for w in words), words),
        share((mark(w[-1]) for w in words), words),
        share((a == b for a, b in zip(words, words[1:])), words),
        max(Counter(words).values(), default=0) / max(len(words), 1),
        len(zlib.compress(raw, 1)) / len(raw) if len(words) >= 30 else 1.0,
        -sum(n / len(raw) * np.log2(n / len(raw)) for n in folded.values()),
        len(set(lines)) / len(lines) if raw.count(b"\n") >= 4 else 1.0,
    ]


def test_statistics_by_plain_counting():
    texts = [t for _, t in AWKWARD] + [t for _, t, _ in mixed(60, 5)] + ["a\n" * 9, "!!", "!", "! x !!", " lead and trail ", "one\n\none\ntwo\none\n"]
    data, offsets = quality.C.text_bytes(pa.array(texts, pa.string()))
    stats, words = quality.statistics(data, offsets)
    for t, row, n in zip(texts, stats, words):
        assert n == len((t or "").encode().split())
        if t:
            assert np.allclose(row, brute_statistics(t)), t


def test_estimates_equal_plain_em_over_rows(docs):
    """The estimate from counted patterns is that of the same rounds over every single row."""
    rows = mixed(250, 3)
    v, counts = quality.tally(docs([r[:2] for r in rows]))
    model = quality.estimate(v, counts, rounds=25)
    each = [quality.votes(*quality.C.text_bytes(pa.array([t])))[0].tolist() for _, t, _ in rows]
    kinds = range(3)
    chance = []
    for row in each:
        start = [0.25 + sum(x == quality.BAD for x, f in zip(row, quality.FAMILY) if f == k) for k in (0, 1)] + [1 + sum(x == quality.GOOD for x in row)]
        chance.append([x / sum(start) for x in start])
    for _ in range(25):
        share = [max(sum(c[k] for c in chance) / len(each), 1e-3) for k in kinds]
        rates = {}
        for j in range(len(quality.LABELLERS)):
            for k in kinds:
                cast = [sum(c[k] for c, row in zip(chance, each) if row[j] == x) + 0.5 for x in (quality.BAD, quality.GOOD)]
                for x, n in zip((quality.BAD, quality.GOOD), cast):
                    rates[j, k, x] = n / sum(cast)
        chance = []
        for row in each:
            like = [share[k] * math.prod(rates[j, k, x] for j, x in enumerate(row) if x != quality.ABSTAIN) for k in kinds]
            chance.append([x / sum(like) for x in like])
    assert np.allclose(model.share, share) and np.allclose(model.kinds(np.array(each)), chance, atol=1e-6)


def test_accuracies_decide():
    """A labeller that errs alone is overruled; votes that others bear out are not."""
    good = [quality.GOOD] * 12
    alone, clutter = good.copy(), good.copy()
    alone[7] = quality.BAD
    clutter[0] = clutter[1] = clutter[4] = clutter[6] = quality.BAD
    v = np.array([good, alone, clutter, [quality.ABSTAIN] * 12])
    model = quality.estimate(v, np.array([700.0, 200.0, 100.0, 1.0]))
    p = model.posterior(v)
    assert p[0] > 0.99 and p[2] < 0.01 and 0.5 < p[3]
    few = quality.estimate(v, np.array([900.0, 0.0, 100.0, 1.0]))
    assert few.posterior(v)[0] > 0.99 and model.accuracies()["marks"] > 0.99
    own = quality.LabelModel(np.array([0.1, 0.1, 0.8]), np.array([[[0.9, 0.1], [0.1, 0.9], [0.2, 0.8]]] * 12))
    weak = quality.LabelModel(own.share, np.array([[[0.6, 0.4], [0.4, 0.6], [0.5, 0.5]]] * 12))
    want = 0.8 * 0.8**11 * 0.2 / (0.8 * 0.8**11 * 0.2 + 0.1 * 0.1**11 * 0.9 + 0.1 * 0.9**11 * 0.1)
    assert abs(own.posterior(v[1:2])[0] - want) < 1e-9 and weak.posterior(v[1:2])[0] != own.posterior(v[1:2])[0]
    assert quality.unpacked(quality.packed(v)).tolist() == v.tolist()


def test_sample_stays_bounded(docs):
    """Rows that share id and text are chosen by their place."""
    bad = "!! ".join(["WORD"] * 40)
    frame = docs([(None, bad)] * 300 + [(1, t) for t in grammar(300, 1)] + [(5, bad)] * 300)
    for per_class in (10, 50):
        model = quality.fit(frame, per_class=per_class)
        got = quality.classify(frame, model).collect()
        assert len(got) == 900 and all(r["keep"] == (r["doc_id"] == 1) for r in got)


def test_quality_on_awkward_rows(spark, docs, awkward, tmp_path):
    docs(awkward, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op10_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(awkward)
    for i, t in awkward:
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] == 0 and not got[i]["keep"]) == (not t)
    assert got[9][1:] == got[10][1:]
    frame = docs(awkward, extra=True)
    model = quality.fit(frame)
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.classify(frame, model).collect() if r["keep"]}


def test_quality_of_empty_table(docs):
    model = quality.fit(docs([]))
    assert quality.classify(docs([]), model).count() == 0


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["keep"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
