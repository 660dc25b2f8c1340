import zlib

import numpy as np
import pytest

from pixelloom.llm import langid
from pixelloom.llm.queries import op2_language_id

TALK = {"en": "the house that they have with this thing and those", "de": "der hund und die katze nicht mit einer straße auch", "fr": "le chat est dans la maison avec une grande fenêtre", "es": "el perro está en la casa con una ventana grande señor", "it": "il gatto della nonna che dorme sopra la finestra grande", "xx": "qzx zxq xqz qqz zzx xxq"}


def corpus(langs, n=30):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for lang in langs:
        words = TALK[lang].split()
        for _ in range(n):
            rows.append((i, " ".join(rng.choice(words, 25)), lang))
            i += 1
    return rows


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 20])
def test_codewords_differ_in_many_bits(k):
    code = langid.codewords(k)
    apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert code.shape[0] == k and (np.abs(code.sum(axis=0)) < k).all() and apart >= (code.shape[1] + 1) // 4


def test_learns_every_language(docs):
    rows = corpus(TALK)
    model = langid.fit(docs(rows))
    got = {r["doc_id"]: r for r in langid.identify(docs(rows), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)


def test_one_and_no_language(docs):
    one = langid.fit(docs(corpus(["en"])))
    none = langid.fit(docs([(1, "abc", None)]))
    got = [langid.identify(docs([(1, "what"), (2, "77")]), m).collect() for m in (one, none)]
    assert [[(r["lang_pred"], r["score"]) for r in g] for g in got] == [[("en", 1.0), ("und", 0.0)], [("und", 0.0), ("und", 0.0)]]


def test_awkward_rows(docs, awkward):
    model = langid.fit(docs(corpus(["en", "fr"]), extra=True))
    got = langid.identify(docs(awkward, extra=True), model).collect()
    pred = [r["lang_pred"] for r in got]
    assert len(got) == len(awkward) and [p == "und" for p in pred] == [t is None or not any(c.isalpha() for c in t) for _, t in awkward]
    assert got[8][1:] == got[9][1:]
    kept = langid.keep_identified(docs(awkward, extra=True), model)
    assert kept.columns == docs(awkward, extra=True).columns and {r["doc_id"] for r in kept.collect()} <= {i for (i, t), p in zip(awkward, pred) if p != "und"}


def test_empty_table(docs):
    model = langid.fit(docs([]))
    assert langid.identify(docs([]), model).count() == 0 and langid.keep_identified(docs([]), model).count() == 0


def test_between_two_languages_is_ambiguous(docs):
    model = langid.fit(docs(corpus(["en", "de"])), min_gap=0.1)
    assert langid.identify(docs([(1, "zzzz qqq")]), model).first()["ambiguous"]


def test_blocks_do_not_change_results(docs, monkeypatch):
    rows = corpus(["en", "de", "fr"])
    model = langid.fit(docs(rows))
    text = "".join(t for _, t, _ in rows[:20]).encode()
    data, cuts = np.frombuffer(text, np.uint8), np.array([0, 1, 1, 500, len(text)])
    hashes, starts, _ = langid._grams(data, cuts)
    whole = langid.C.segment_sums(hashes, starts, model.weights)
    assert np.allclose(whole, langid.C.segment_sums(hashes, starts, model.weights, block=37), atol=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_many_languages(docs):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(230):
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(6)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 30)), f"l{k:03}") for i in range(4 if k < 200 else 3)]
    model = langid.fit(docs(rows))
    assert model.langs == [f"l{k:03}" for k in range(200)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(rows), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if lang < "l200"]) > 0.9


def test_sample_of_rows_without_ids_stays_bounded(docs):
    rows = [(None, t, lang) for _, t, lang in corpus(["en", "de"], 400)] + [(7, "immer der gleiche satz hier", "de")] * 400
    model = langid.fit(docs(rows), per_lang=50)
    got = langid.identify(docs(corpus(["en", "de"])), model).collect()
    assert np.mean([r["lang_pred"] == ("en" if r["doc_id"] < 30 else "de") for r in got]) > 0.95


def brute_predictions(texts, model, near=False):
    """Each text's n-grams one by one, every bit's mean weight, and the nearest codeword; with `near` whether the next is as near."""
    out = []
    for t in texts:
        seen = bytes(langid.LETTERS[b] for b in t.encode())
        buf = b"  " + seen + b"  "
        total, n = np.zeros(model.code.shape[1]), 0
        for i in range(len(buf) - 2):
            if buf[i] == 32 and buf[i + 1] == 32:
                continue
            two = buf[i] << 8 | buf[i + 1]
            three = two << 8 | buf[i + 2]
            slot = lambda x: (x * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)
            total += model.weights[slot(two + 0x9E3779)] + model.weights[slot(three) + (1 << langid.BITS)]
            n += 1
        margin = (total / max(n, 1) - model.centre) * model.scale
        loss = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.bit_weight, margin, code)) for code in model.code]
        lang = model.langs[int(np.argmin(loss))] if any(c.isalpha() for c in t) else "und"
        out.append((lang, sorted(loss)[1] - min(loss) < model.min_gap) if near else lang)
    return out


def test_query_equals_brute_force(spark, docs, awkward, tmp_path):
    rows = [*[(i, t, None) for i, t in awkward], *[(1000 + i, t, lang) for i, t, lang in corpus(["en", "de", "fr", "es"], 25)]]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op2_language_id(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, _, _ in rows}
    model = langid.fit(docs([r for r in rows if not held[r[0]]]))
    want = brute_predictions([t or "" for _, t, _ in rows], model)
    assert {i: (r["held_out"], r["lang_pred"]) for i, r in got.items()} == {i: (held[i], lang) for (i, _, _), lang in zip(rows, want)}
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op2_language_id(spark, str(tmp_path / "none")).count() == 0
