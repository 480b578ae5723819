import random

from quadloom.llm import leaks

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
W = ITEM.split()


def found(text, item=ITEM):
    ix = leaks.Index([(1, item)])
    hit = bool(ix.found([leaks.encode(text)]))
    assert hit == bool(leaks.brute_force([(5, text)], [(1, item)]))
    return hit


def test_definition():
    pad = "some other words stand here before "
    assert found(pad + " ".join(W[3:17]))
    assert found(pad + " ".join(W[3:16]))  # fourteen with the last one missing
    assert not found(pad + " ".join(W[3:15]))
    assert found(" ".join([*W[:7], "XX", *W[8:14]]))  # one of fourteen changed
    assert found(" ".join([*W[:6], *W[7:14]]))  # one missing
    assert found(" ".join([*W[:7], "XX", *W[7:14]]))  # one added
    assert not found(" ".join([*W[:4], "XX", *W[5:9], "YY", *W[10:14]]))
    assert found(" ".join([*W[:5], "XX", *W[6:11], "YY", *W[12:16]]))  # two of sixteen
    assert not found(" ".join(random.Random(1).sample(W, len(W))))
    assert not found("") and not found(" ".join(W[:14]), " ".join(W[:13]))


def test_spelling_does_not_matter():
    t = " ".join(W[2:17])
    assert found(t.upper()) and found(t.replace(" ", " \n")) and found(" ".join(f"<b>{w}</b>," for w in W[2:17]))
    assert found("".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t))
    assert found(t.replace("e", "е").replace("o", "о"))  # letters of another script
    assert found(t.replace("foxtrot", "fox-\ntrot").replace("golf", "go­lf").replace("hotel", "*ho​tel*"))
    assert found("é " + t, ITEM) and leaks.normal_words("Če — _x_ A·b") == ["ce", "x", "ab"]


def test_recall_of_altered_passages():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(45))) for i in range(40)]
    docs, want = [], 0
    for d in range(400):
        _, text = items[d % 40]
        ws = text.split()
        n = rng.randint(14, 40)
        at = rng.randint(0, len(ws) - n)
        part = ws[at : at + n]
        for k in rng.sample(range(1, n - 1), n // 8):
            part[k] = rng.choice([None, "zz", part[k] + " zz"])
        docs.append((d, " ".join([*(rng.choice(vocab) for _ in range(20)), *[p for p in part if p], *(rng.choice(vocab) for _ in range(20))])))
    ix = leaks.Index(items)
    got = {(d, i) for d, i in ix.found([leaks.encode(t) for _, t in docs])}
    exact = leaks.brute_force(docs, items)
    want = len(exact)
    assert want > 300 and got <= exact and len(got) >= 0.97 * want


def test_in_spark(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing of it " * 3000 + ITEM, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "short one"), (None, ITEM), (10, ITEM[::-1])], "item_id bigint, text string")
    for block in (5000, 1):
        assert {tuple(r) for r in leaks.leaked_items(docs, items, block).collect()} == {(1, 7), (4, 7)}
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0 and leaks.leaked_items(docs.limit(0), items).count() == 0
    assert leaks.leak_report(leaks.leaked_items(docs, items)).first()["n_documents"] == 2


def test_long_markup_and_entities():
    ws = W[2:17]
    link = '<a href="https://example.org/a/very/long/path/of/a/page?with=query&amp;and=more" title="x">'
    assert len(link) > 69
    assert found(" ".join(f"{link}{w}</a>" if k % 5 == 2 else w for k, w in enumerate(ws)))
    assert found("<br/>".join(ws)) and found("<li>".join(ws)) and found("&nbsp;".join(ws)) and found(" <!-- a > b\n -->".join(f" {w}" for w in ws))
    assert found(" ".join(f"[{w}](http://example.org/{k})" for k, w in enumerate(ws))) and found(" ".join(f"&quot;{w}&#8221;" for w in ws))
    assert leaks.normal_words("a < b and c > d") == ["a", "b", "and", "c", "d"] and leaks.normal_words("x<b>y</b>z") == ["xyz"] and leaks.normal_words("a¨b") == ["a", "b"]


def test_recall_against_planted_truth():
    """Pairs are known from planting alone; the texts are dressed in ways the reader must see through."""
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("kar", "lom", "pre", "vis", "tun", "sol", "mir") for b in ("den", "eon", "tala", "gorn", "isk", "ule", "ath", "orz", "emp", "yll")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(16, 60)))) for i in range(30)]
    dress = [
        lambda w: w, str.upper, lambda w: f"<i class='{'k' * rng.randint(1, 90)}'>{w}</i>", lambda w: f"&#{ord(w[0])};{w[1:]}", lambda w: w[:2] + "­" + w[2:],
        lambda w: w[:2] + "-\n" + w[2:], lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w), lambda w: f"**{w}**,", lambda w: w[0] + "́" + w[1:],
    ]
    docs, want = [], set()
    for d in range(300):
        i, text = items[d % 30]
        ws = text.split()
        n = rng.randint(14, len(ws))
        at = rng.randint(0, len(ws) - n)
        part = ws[at : at + n]
        for k in rng.sample(range(1, n - 1), rng.randint(0, n // 8)):
            part[k] = "zz"
        docs.append((d, " ".join(["und", "so", *(rng.choice(dress)(w) for w in part), "weiter"])))
        want.add((d, i))
    got = set(leaks.Index(items).found([leaks.encode(t) for _, t in docs]))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 3
