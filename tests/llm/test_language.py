"""Chain model of languages: exact marginals, held-out accuracy, defined results for odd rows."""

import zlib

import numpy as np

import __spark_entry__ as entry
from runsift.llm import lang_crf

ROWS = [("the cat sat on the mat and the dog ran " * 3, "en"), ("der hund und die katze sind nicht hier " * 3, "de"), ("le chat est sur la table avec le chien " * 3, "fr")] * 20


def test_marginals_equal_brute_force():
    model = lang_crf.fit(ROWS, epochs=1)
    found = lang_crf.words_of(["the cat und die katze", "", "a " * 100 + "der hund", "x"])
    scores = model.emissions(found)
    got = model.marginals(scores, found.text)
    add = np.logaddexp.reduce
    for t in set(found.text.tolist()):
        e = scores[found.text == t]
        ahead, back = e.copy(), np.zeros_like(e)
        for i in range(1, len(e)):
            ahead[i] += add(ahead[i - 1][:, None] + model.transitions, axis=0)
        for i in range(len(e) - 2, -1, -1):
            back[i] = add(model.transitions + (e[i + 1] + back[i + 1])[None], axis=1)
        want = ahead + back
        assert np.allclose(np.exp(want - add(want, axis=1)[:, None]), got[found.text == t], atol=1e-6)


def test_code_switched_words():
    model = lang_crf.fit(ROWS, epochs=3)
    found = lang_crf.words_of(["the cat sat on the mat der hund und die katze sind nicht hier"])
    best = [model.langs[i] for i in model.marginals(model.emissions(found), found.text).argmax(1)]
    assert best[:5] == ["en"] * 5 and best[-5:] == ["de"] * 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op1_language_crf"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_odd_rows(corpus, long_text):
    texts = [None, "", "123 !? \n", "the cat", "the cat", long_text]
    got = {r.doc_id: r for r in lang_crf.predict(corpus(texts), lang_crf.fit(ROWS, epochs=1)).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[3].lang_pred == got[4].lang_pred == "en" and got[3].score == got[4].score
    assert got[5].n_words == 24_000
    assert lang_crf.train(corpus(texts, langs=[None] * 6)) is None
    assert {r.lang_pred for r in lang_crf.predict(corpus(texts), None).collect()} == {"und"}
    assert lang_crf.predict(corpus([]), lang_crf.train(corpus([]))).count() == 0
