"""Text garbled by a wrong character encoding: detection and restoration.

Method: a multinomial classifier over hashed byte bigrams is trained on records that are garbled on
purpose, one class for each encoding chain and one for clean text.  For every word it names the exact
chain; the chain is inverted and the result must decode strictly and read better than the word did.
Words whose characters were lost (replacement characters, question marks) have their own class and
are restored from clean words of the same pattern where only one fits.

Only the bigram weights are fitted on a bounded sample of documents (``SAMPLE_DOCS``).  The words of all
documents are counted, each distinct one is classified once, and which words are known, which occur
more often than what they invert to, and which lost pattern has one clean word only are joins over
all documents' words.  A last pass over the documents looks their words up among the garbled ones.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Scratch, blocks_in_files, read_block, ship_package, spread

SAMPLE_DOCS = 6000
HASH_BITS = 15
MARGIN = 3.0
COUNTED_AT_ONCE = 200_000
WORDS_A_BLOCK = 300_000
# fixed values: (encoding the bytes were read with, encoding they were written in), applied in order when inverted
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[((w, "utf-8"),) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1254")],
    (("cp1252", "utf-8"), ("cp1252", "utf-8")),
    (("latin-1", "utf-8"), ("latin-1", "utf-8")),
    (("cp1252", "utf-8"), ("latin-1", "utf-8")),
    (("latin-1", "utf-8"), ("cp1252", "utf-8")),
    (("cp1252", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "utf-8")),
    (("cp1252", "cp1251"),), (("cp1252", "koi8-r"),), (("cp1252", "cp866"),), (("cp1252", "mac_cyrillic"),), (("cp1252", "iso8859-5"),),
    (("cp1251", "koi8-r"),), (("koi8-r", "cp1251"),), (("cp1251", "cp866"),), (("cp866", "cp1251"),), (("koi8-r", "cp866"),), (("cp866", "koi8-r"),),
    (("cp1251", "iso8859-5"),), (("iso8859-5", "cp1251"),), (("cp1251", "mac_cyrillic"),), (("mac_cyrillic", "cp1251"),),
    (("cp1252", "cp1250"),), (("cp1252", "iso8859-2"),), (("cp1250", "iso8859-2"),), (("iso8859-2", "cp1250"),), (("cp1250", "cp1252"),), (("iso8859-2", "cp1252"),), (("cp1252", "cp852"),), (("cp1250", "cp852"),),
    (("mac_roman", "cp1252"),), (("cp1252", "mac_roman"),), (("cp437", "cp1252"),), (("cp1252", "cp437"),), (("cp850", "cp1252"),), (("cp1252", "cp850"),), (("cp1251", "cp1252"),), (("mac_roman", "cp850"),), (("mac_roman", "cp437"),),
]
# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһАВЕЗКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABE3KMHOPCTYXIJSaeiknoptuxABEZHIKMNOPTYX")
CLEAN, LOST = "clean", "lost"
_WORD = re.compile(r"[^ \t\n\r]*(?:[^\x00-\x7f]|\?(?=\w))[^ \t\n\r]*")
_DIGITS = re.compile(r"[0-9]+")
_PUNCT = r"""[\s!"#$%&'()*+,\-./:;<=>@\[\]^_`{|}~“”„«»’‘—–…¡¿]+"""
_EDGE = re.compile(f"^{_PUNCT}|{_PUNCT}$")


@lru_cache(None)
def _tables(enc: str) -> tuple[dict[str, int], dict[int, str]]:
    """Byte tables of a one-byte encoding; bytes it leaves undefined stand for themselves."""
    back, forth = {}, {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        forth[b] = ch
        back.setdefault(ch, b)
    return back, forth


def invert(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word before the chain garbled it, or None unless every step decodes strictly."""
    for wrong, right in chain:
        back = _tables(wrong)[0]
        try:
            raw = bytes([back[ch] for ch in word])
        except KeyError:
            return None
        try:
            word = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return word


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The chain applied to clean text; characters its first encoding lacks become question marks."""
    for wrong, right in reversed(chain):
        raw = word.encode(right, "replace")
        forth = _tables(wrong)[1]
        word = "".join(forth[b] for b in raw)
    return word


def lose(word: str) -> list[str]:
    """The forms a word takes when characters are lost on the way."""
    return [
        word.encode("ascii", "replace").decode(), word.encode("utf-8").decode("ascii", "replace"), word.encode("cp1252", "replace").decode("utf-8", "replace"),
        word.encode("latin-1", "replace").decode("latin-1"), word.encode("cp1250", "replace").decode("cp1250"), word.encode("cp1251", "replace").decode("cp1251"), word.encode("cp1252", "replace").decode("cp1252"),
    ]


def bigrams(word: str) -> np.ndarray:
    """Hashed pairs of neighbouring bytes, and of bytes with one between, of the word in UTF-8."""
    b = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    near = (b[:-1] << 8) | b[1:]
    gap = ((b[:-2] << 8) | b[2:]) + np.uint32(1 << 16)
    x = np.concatenate([near, gap]) * np.uint32(2654435761)
    return (x >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def shape(word: str) -> str:
    """The word with runs of digits made equal: numbers say nothing about encodings."""
    return _DIGITS.sub("0", word)


def shapes(words: list[str]) -> list[str]:
    """``shape`` of all words in one pass; no word holds a line end."""
    return _DIGITS.sub("0", "\n".join(words)).split("\n") if words else []


def words_of(text: str | None) -> list[str]:
    """Words with a character beyond ASCII, or a question mark before a letter."""
    return _WORD.findall(text) if text else []


def lost_form(word: str) -> bool:
    return "�" in word or re.search(r"(?<!\?)\?[^\W\d_]", word) is not None


@dataclass
class Model:
    classes: list = field(default_factory=list)
    logp: np.ndarray | None = None  # classes x buckets
    words: frozenset = frozenset()  # clean words without case and edges
    masks: dict[str, str | None] = field(default_factory=dict)  # lost pattern -> the only clean word, or None if several
    seen: dict[str, tuple[str, str] | None] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def scores(self, word: str) -> np.ndarray:
        return self.logp[:, bigrams(word)].sum(1)

    def _restore_lost(self, word: str) -> str:
        m = _EDGE.sub("", word)
        got = self.masks.get(re.sub(r"�+|\?", "?", m)) if m else None
        return word.replace(m, got) if got else word

    def judge(self, word: str) -> tuple[str, str] | None:
        """(chain, restored word) of a garbled word, None for a clean one."""
        key = shape(word)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._judge(key)
        got = self.seen[key]
        if got is None or key == word:
            return got
        name, _ = got
        chain = next((c for c in self.classes if isinstance(c, tuple) and chain_name(c) == name), None)
        back = invert(word, chain) if chain else None
        return name, back if back is not None else self._restore_lost(word)

    def candidates(self, word: str) -> list[tuple[float, int, str, bool]]:
        """(score, class, restored word, whether it stands without being known), best first.

        Whole words, then words of which only some characters were garbled; a restored word must read
        better than the word did.  A one-byte chain always inverts: what it restores must be a known
        word, unless the word was garbled for the most part.
        """
        s, n = self.scores(word), len(bigrams(word))
        out = []
        for k, c in enumerate(self.classes):
            if not isinstance(c, tuple):
                continue
            whole = invert(word, c) if s[k] > s[0] + MARGIN else None
            utf8 = c[-1][1] == "utf-8"
            backs = [whole] if whole is not None and whole != word and "�" not in whole else []
            for back in dict.fromkeys([*backs, *self._invert_parts(word, k, c)]):
                if not _readable(back) or _folded(back) == _folded(word):
                    continue
                if not utf8 and (_letters(back) < 3 or look_alike(word).isascii()):
                    continue
                # several bytes that form valid UTF-8 rarely do so by chance
                score = float(self.scores(back)[0] / len(bigrams(back)) + (0.5 if utf8 else 0.0))
                if score > s[0] / n:
                    out.append((score, k, back, utf8 or 2 * sum(not ch.isascii() for ch in word) >= len(word)))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def lost(self, word: str) -> bool:
        """Whether characters were lost: only a decoder writes U+FFFD; question marks are judged."""
        return "�" in word or lost_form(word) and bool(np.subtract(*self.scores(word)[[1, 0]]) > MARGIN)

    def _judge(self, word: str) -> tuple[str, str] | None:
        if "�" in word:
            return LOST, self._restore_lost(word)
        known = _folded(word) in self.words
        for _, k, back, free in self.candidates(word):
            if _folded(back) in self.words or free and not known:
                return chain_name(self.classes[k]), back
        return (LOST, self._restore_lost(word)) if self.lost(word) else None

    def _invert_parts(self, word: str, k: int, chain: tuple[tuple[str, str], ...]) -> list[str]:
        """The word with spans restored that invert strictly, if those look like the chain's work.

        Clean characters may invert by chance beside garbled ones: all spans, those that look like the
        chain's work by themselves, and the one that does most are tried.
        """
        spans = invertible_spans(word, chain) if len(chain) < 3 else []
        if not spans:
            return []
        gains = []
        for i, j, _ in spans:
            s = self.logp[:, bigrams(word[max(0, i - 1) : j + 1])[1:-1]]
            gains.append(float((s[k] - s[0]).sum()))
        picks = {tuple(range(len(spans))), tuple(n for n, g in enumerate(gains) if g > 0), (int(np.argmax(gains)),)}
        out = []
        for pick in sorted(picks, reverse=True):
            if sum(gains[n] for n in pick) > MARGIN:
                back, at = [], 0
                for n in pick:
                    i, j, text = spans[n]
                    back += [word[at:i], text]
                    at = j
                out.append("".join([*back, word[at:]]))
        return out


def invertible_spans(word: str, chain: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str]]:
    """Spans of a partly garbled word that the chain inverts strictly, with their restored text.

    For a chain that ends in UTF-8: runs that are whole multi-byte sequences.  For one-byte chains:
    runs of characters beyond ASCII that the wrong encoding has, in words that also hold some it has not.
    """
    back = _tables(chain[0][0])[0]
    out = []
    if chain[-1][1] == "utf-8":
        i = 0
        while i < len(word):
            b = back.get(word[i], 0)
            hit = None
            if 0xC2 <= b < 0xF5:
                for j in range(min(len(word), i + 4 * len(chain) ** 2), i + 1, -1):
                    t = invert(word[i:j], chain)
                    if t is not None and len(t) == 1:
                        hit = (i, j, t)
                        break
            if hit:
                out.append(hit)
                i = hit[1]
            else:
                i += 1
        return out
    if len(chain) > 1 or all(ch in back for ch in word):
        return []
    for m in re.finditer(r"[^\x00-\x7f]+", word):
        i = m.start()
        while i < m.end():
            j = i
            while j < m.end() and word[j] in back:
                j += 1
            if j > i:
                t = invert(word[i:j], chain)
                if t is not None and t != word[i:j]:
                    out.append((i, j, t))
            i = max(j, i + 1)
    return out


def _letters(word: str) -> int:
    return sum(map(str.isalpha, word))


def look_alike(word: str) -> str:
    """The word with letters of other scripts that look like Latin ones replaced by those."""
    return word.translate(LOOK_ALIKE)


def _folded(word: str) -> str:
    return _EDGE.sub("", word).casefold()


def _readable(word: str) -> bool:
    return not any(0x80 <= ord(ch) < 0xA0 or ord(ch) < 0x20 for ch in word)


def chain_name(chain: tuple[tuple[str, str], ...]) -> str:
    return ">".join(f"{right} as {wrong}" for wrong, right in reversed(chain))


def fit(counts: dict[str, int], passes: int = 3) -> Model:
    """Fits the classifier on word counts of sampled documents.

    The sample itself holds some garbled words; each pass drops the words that the last fit calls
    garbled.  Empty counts give a model that calls every word clean but those with lost characters.
    """
    n_buckets = 1 << HASH_BITS
    # to begin with: words that invert strictly to a more frequent word are set aside
    total = Counter()
    for w, n in counts.items():
        total[shape(w)] += n
    clean = {}
    for w, n in total.items():
        if lost_form(w) or not _readable(w):
            continue
        if any((b := invert(w, c)) is not None and b != w and total.get(b, 0) > n * (1 if c[-1][1] == "utf-8" else 5) and (c[-1][1] == "utf-8" or _letters(b) > 2) for c in CHAINS):
            continue
        clean[w] = n
    model = Model()
    for _ in range(passes):
        classes: list = [CLEAN, LOST, *CHAINS]
        feats = np.zeros((len(classes), n_buckets))
        for w, n in clean.items():
            if w.isascii():
                continue
            weight = 1 + np.log(n)
            np.add.at(feats[0], bigrams(w), weight)
            for v in {w.lower(), w.upper(), w.title()} - {w}:  # words change case in headings and quotes
                np.add.at(feats[0], bigrams(v), 0.5)
            for f in set(lose(w)) - {w}:
                np.add.at(feats[1], bigrams(f), weight / 3)
            for k, c in enumerate(CHAINS):
                g = garble(w, c)
                if g != w:
                    np.add.at(feats[k + 2], bigrams(g), weight)
        feats += 0.05
        logp = np.log(feats / feats.sum(1, keepdims=True)).astype(np.float32)
        masks: dict[str, set[str]] = defaultdict(set)
        for w in clean:
            m = _EDGE.sub("", w)
            if m and not m.isascii():
                for f in (re.sub(r"[^\x00-\x7f]", "?", m), re.sub(r"[^\x00-\x7f]+", "?", m)):
                    masks[f].add(m)
        model = Model(classes, logp, frozenset(map(_folded, clean)), {k: next(iter(v)) if len(v) == 1 else None for k, v in masks.items()})
        kept = {w: n for w, n in clean.items() if model.judge(w) is None}
        if len(kept) == len(clean):
            break
        clean = kept
    model.seen = {}
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by shape with the number of documents that hold them, combined within the task."""
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])
    c: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            c.update(set(shapes(words_of(t))))
        if len(c) > COUNTED_AT_ONCE:
            yield pa.RecordBatch.from_pydict({"w": list(c), "n": list(c.values())}, schema=schema)
            c = Counter()
    yield pa.RecordBatch.from_pydict({"w": list(c), "n": list(c.values())}, schema=schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """``w, n``: distinct words (by shape) of all documents and how many documents hold each."""
    return spread(docs.select("text")).mapInArrow(_count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def sample_counts(docs: DataFrame, max_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Counts of words in about ``max_docs`` documents chosen by a hash of their id, to fit the classifier.

    Words of more than 60 characters are left out of the fit; they are classified like all others.
    """
    n = docs.count()
    share = min(1.0, max_docs / max(n, 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    return {r["w"]: r["n"] for r in some.select("text").mapInArrow(_count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).filter(F.length("w") <= 60).collect()}


_CLASSED = pa.schema([
    ("w", pa.string()), ("n", pa.int64()), ("folded", pa.string()), ("usable", pa.bool_()), ("lost", pa.bool_()), ("pattern", pa.string()),
    ("cands", pa.list_(pa.struct([("k", pa.int32()), ("back", pa.string()), ("folded", pa.string()), ("shaped", pa.string()), ("score", pa.float64()), ("free", pa.bool_()), ("often", pa.int32())]))),
])
_CLASSED_SQL = "w string, n bigint, folded string, usable boolean, lost boolean, pattern string, cands array<struct<k:int,back:string,folded:string,shaped:string,score:double,free:boolean,often:int>>"


def _classify(model: Model):
    """Everything about a distinct word that needs no other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column("w").to_pylist(), b.column("n").to_pylist()):
                cands = [] if "�" in w else [
                    {"k": k, "back": back, "folded": _folded(back), "shaped": shape(back), "score": score, "free": free, "often": 1 if model.classes[k][-1][1] == "utf-8" else 5} for score, k, back, free in model.candidates(w)
                ]
                lost = model.lost(w)
                rows.append({"w": w, "n": n, "folded": _folded(w), "usable": _readable(w) and not lost_form(w), "lost": lost, "pattern": _lost_pattern(w) if lost else None, "cands": cands})
            yield pa.RecordBatch.from_pylist(rows, schema=_CLASSED)

    return run


def _lost_pattern(word: str) -> str | None:
    m = _EDGE.sub("", word)
    return re.sub(r"�+|\?", "?", m) if m else None


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The patterns that clean words leave when their characters beyond ASCII are lost."""
    for b in batches:
        rows = []
        for w in b.column("w").to_pylist():
            m = _EDGE.sub("", w)
            if m and not m.isascii():
                rows += [{"pattern": p, "m": m} for p in {re.sub(r"[^\x00-\x7f]", "?", m), re.sub(r"[^\x00-\x7f]+", "?", m)}]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("pattern", pa.string()), ("m", pa.string())]))


def garbled_words(words: DataFrame, model: Model, scratch: Scratch, passes: int = 2) -> DataFrame:
    """``w, k, back, pattern_word``: the garbled among all distinct words ``w, n``.

    ``k`` is the chain's class (1: characters lost) and ``back`` the restored word; ``pattern_word`` is
    the one clean word that fits a lost pattern, null where none or several do.  Known words are the
    readable ones that are not garbled themselves: a first pass leaves out words that invert to a more
    frequent one, later ones those that the pass before found garbled.
    """
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = scratch.save(words.repartition(tasks).mapInArrow(_classify(model), _CLASSED_SQL))  # few bytes, much work
    ask = scratch.save(t.select("w", "n", F.col("folded").alias("own"), F.explode("cands").alias("c")).select("w", "n", "own", "c.*"))
    frequent = ask.join(t.select(F.col("w").alias("shaped"), F.col("n").alias("n_back")), "shaped").filter(F.col("n_back") > F.col("n") * F.col("often")).select("w").distinct()
    clean = t.filter("usable").select("w", "folded").join(frequent, "w", "left_anti")
    for p in range(passes):
        known = clean.select(F.col("folded").alias("f")).distinct()
        back_known, own_known = known.select(F.col("f").alias("folded"), F.lit(True).alias("back_known")), known.select(F.col("f").alias("own"), F.lit(True).alias("own_known"))
        chosen = (
            ask.join(back_known, "folded", "left").join(own_known, "own", "left").filter(F.col("back_known").isNotNull() | (F.col("free") & F.col("own_known").isNull()))
            .groupBy("w").agg(F.max_by(F.struct("k", "back"), F.struct("score", (-F.col("k")).alias("o"))).alias("c")).select("w", "c.k", "c.back")
        )
        chosen = scratch.save(chosen)
        if p + 1 < passes:
            clean = clean.join(chosen.select("w"), "w", "left_anti")
    good = clean.join(chosen.select("w"), "w", "left_anti")
    masks = good.select("w").mapInArrow(_masks, "pattern string, m string").groupBy("pattern").agg(F.min("m").alias("m"), F.max("m").alias("m2")).filter("m = m2").select("pattern", F.col("m").alias("pattern_word"))
    gone = t.filter("lost").join(chosen.select("w"), "w", "left_anti").select("w", "pattern").join(masks, "pattern", "left")
    return scratch.save(chosen.withColumn("pattern_word", F.lit(None).cast("string")).unionByName(gone.select("w", F.lit(1).alias("k"), F.lit(None).cast("string").alias("back"), "pattern_word")))


_OUT = "doc_id bigint, chains array<string>, n_garbled_words int, restored string"


def _restored(model: Model, word: str, k: int, back: str | None, fits: str | None) -> str:
    """A garbled word's text; it may differ from the classified one in its digits."""
    if k == 1:
        m = _EDGE.sub("", word)
        return word.replace(m, fits) if m and fits and shape(fits) == fits else word
    if back is not None and shape(word) == word:
        return back
    whole = invert(word, model.classes[k])
    if whole is not None and shape(whole) == back:
        return whole
    out, at = [], 0
    for i, j, text in invertible_spans(word, model.classes[k]):
        out += [word[at:i], text]
        at = j
    return "".join([*out, word[at:]])


def _mapper(model: Model, known: dict | None, paths: list[str], with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("chains", pa.list_(pa.string())), ("n_garbled_words", pa.int32()), ("restored", pa.string())])
    names = [chain_name(c) if isinstance(c, tuple) else c for c in model.classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            hits: list[dict] = [{} for _ in texts]
            n = [0] * len(texts)
            words = [[*zip(ws, shapes(ws))] for ws in map(words_of, texts)]
            for garbled in [known] if known is not None else map(read_block, paths):
                for i, ws in enumerate(words):
                    for w, key in ws:
                        got = garbled.get(key)
                        if got is not None:
                            hits[i][w] = got
                            n[i] += 1
            out = []
            for doc_id, text, h, k in zip(b.column("doc_id").to_pylist(), texts, hits, n):
                if h:
                    fixed = _WORD.sub(lambda m: _restored(model, m.group(0), *h[m.group(0)]) if m.group(0) in h else m.group(0), text) if with_text else None
                    out.append({"doc_id": doc_id, "chains": sorted({names[x[0]] for x in h.values()}), "n_garbled_words": k, "restored": fixed})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def garbled_documents(docs: DataFrame, model: Model | None = None, with_text: bool = True, words_a_block: int = WORDS_A_BLOCK) -> DataFrame:
    """Documents with at least one garbled or lost character: chains, number of words, restored text.

    Null texts are clean; null ids are kept.  Characters that were lost stay as they are unless
    exactly one clean word of all documents fits.  Texts are read twice and never shuffled; only
    distinct words are.  Up to ``words_a_block`` garbled words travel with the tasks; more are read by
    them in blocks from the shared folder.
    """
    ship_package(docs.sparkSession)
    model = model or fit(sample_counts(docs))
    scratch = Scratch(docs.sparkSession, "mojibake")
    garbled = garbled_words(word_counts(docs), model, scratch)
    n = garbled.count()
    known, paths = None, []
    if n <= words_a_block:
        known = {r["w"]: (r["k"], r["back"], r["pattern_word"]) for r in garbled.collect()}  # bounded by words_a_block
    else:
        paths = blocks_in_files(garbled, scratch, "w", -(-n // words_a_block), lambda t: {r["w"]: (r["k"], r["back"], r["pattern_word"]) for r in t.to_pylist()})
    weights = Model(model.classes)  # the pass over the documents needs the chains only
    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(_mapper(weights, known, paths, with_text), _OUT)
