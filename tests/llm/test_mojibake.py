from collections import Counter

import pyarrow.parquet as pq
import pytest

from quadloom.llm import mojibake as mj

PLAIN = ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as mac_roman", "utf-8 as cp437", "utf-8 as cp1251"]


@pytest.fixture(scope="module")
def halves():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    fit, rest = Counter(), []
    for d, x in zip(t["doc_id"], t["text"]):
        if d % 2:
            fit.update({mj.shape(w) for w in mj.words_of(x)})
        else:
            rest.append(x)
    return mj.fit(dict(fit)), rest


def chain(name):
    return next(c for c in mj.CHAINS if mj.chain_name(c) == name)


def test_chains_invert():
    for c in mj.CHAINS:
        for w in ("señal", "größte", "Второй", "źródło"):
            g = mj.garble(w, c)
            if "?" not in g and g != w:
                assert mj.invert(g, c) == w
    assert mj.invert("é", chain("utf-8 as cp1252")) is None


def test_clean_words_stay(halves):
    model, rest = halves
    clean = [w for x in rest for w in mj.words_of(x) if mj._folded(w) in model.words and len(mj._folded(w)) > 1 and not mj.lost_form(w)]
    assert len(clean) > 1000 and sum(model.judge(w) is not None for w in clean) <= 0.002 * len(clean)
    for w in ("MANHÃ”", "À", "SÃO", "É", "«", "36×16", "40", "€).", "naïve", "thе", "ｗｉｄｅ", "so­ft"):
        assert model.judge(w) is None, w


def test_held_out_accuracy(halves):
    model, rest = halves
    clean = sorted({w for x in rest for w in mj.words_of(x) if model.judge(w) is None and not w.isascii() and mj._folded(w) in model.words and mj._letters(w) > 3 and "­" not in w})
    assert len(clean) > 100
    for name in PLAIN:
        pairs = [(w, mj.garble(w, chain(name))) for w in clean]
        pairs = [(w, g) for w, g in pairs if g != w and "?" not in g]
        hit = [model.judge(g) for _, g in pairs]
        assert sum(h is not None for h in hit) >= 0.97 * len(pairs), name
        assert sum(h is not None and h[1] == w for h, (w, _) in zip(hit, pairs)) >= 0.9 * len(pairs), name


def test_parts_and_losses(halves):
    model, _ = halves
    assert model.judge("estaÃ§ão")[1] == "estação"
    assert model.judge("â€œMANHÃ”")[1] == "“MANHÃ”"  # its clean end inverts by chance
    assert model.judge("informa����o") is not None and model.judge("operator?s")[0] == mj.LOST
    assert model.judge("revisó?") is None and model.judge("remains?") is None


def test_in_spark(spark):
    text = "El técnico perdió la señal después de la medición. "
    rows = [(i, text, "x") for i in range(60)] + [(100, text.encode().decode("latin-1"), "x"), (101, "perdi�", "x"), (102, None, "x"), (103, "", "x"), (None, "seÃ±al", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = {r.doc_id: r for r in mj.garbled_documents(df).collect()}
    assert {r.doc_id: r for r in mj.garbled_documents(df, words_a_block=1).collect()} == got
    assert set(got) == {100, 101, None} and got[100].restored == text and got[101].restored == "perdió" and got[None].restored == "señal"
    assert mj.garbled_documents(df.limit(0)).count() == 0
