"""Evaluation passages inside training documents.

Method: every window of ``WINDOW`` words, the size of the smallest leak of an item, is embedded by
random walks that turn edit distance into Hamming distance (each step copies the current word and, by
a random bit for the word and the step, moves on or stays).  Each of ``WALKS`` walks is sampled
``SETS`` times at ``SAMPLED`` places; windows of documents and items that agree at all places of a
sample are candidates, which an exact edit-distance check confirms.  Every item is covered by its
windows at all offsets, so parts of an item are found as well.

Items are the stated query set: up to ``ITEM_BLOCK`` of them travel with the tasks.  More are indexed in
blocks, in parallel, into the shared folder, and each task takes its documents past one block after
the other.  Documents are read once, whatever the number of items, and dealt out over the tasks only
where few files hold them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.mojibake import look_alike
from quadloom.runtime import Scratch, blocks_in_files, read_block, ship_package, spread

MIN_WORDS = 14  # fixed values of the definition: words of the item, and words an edit
WORDS_PER_EDIT = 8
WINDOW = MIN_WORDS
STEPS = 2 * WINDOW
WALKS = 6
SETS = 4
SAMPLED = 5
ITEM_BLOCK = 5000
DOC_BATCH = 512
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<!--.*?-->|<![^<>]*>|<\?[^<>]*>", re.S)
# fixed values: elements that begin a new line or cell; other tags stand inside words
_BREAKS = frozenset("address article aside blockquote br caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
_LINK = re.compile(r"\]\([^()\s]*\)")
_SPLIT_WORD = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")
_NOT_ALNUM = re.compile(r"[\W_]+")
_GAP = np.int64(-1)  # no word; hashes of words are not negative


def plain_text(text: str) -> str:
    """Text without markup of any length, entities, link targets and line-end hyphens."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[2] and m[2].lower() in _BREAKS else "", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("", text)
    if "-\n" in text or "-\r" in text or "- " in text or "-\t" in text:
        text = _SPLIT_WORD.sub("", text)
    return text


def normal_token(token: str) -> list[str]:
    """Words of one piece between blanks: without case, invisible characters, accents, look-alikes, width variants and punctuation."""
    if not token.isascii():
        token = unicodedata.normalize("NFKD", look_alike(token))
        token = "".join([ch for ch in token if ch.isascii() or unicodedata.category(ch) not in ("Mn", "Cf")])
    return [w for w in (_NOT_ALNUM.sub("", x) for x in token.casefold().split()) if w]


def normal_words(text: str | None) -> list[str]:
    """Words between blanks in their normal form; pieces of punctuation alone are left out."""
    return [w for x in plain_text(text).split() for w in normal_token(x)] if text else []


class Tokens(dict):
    """Hash of each piece between blanks: of its word, the gap for none; pieces of several words are kept apart."""

    def __init__(self) -> None:
        self.many: dict[int, list[int]] = {}

    def __missing__(self, token: str) -> int:
        ws = [xxhash.xxh64_intdigest(w) >> 2 for w in normal_token(token)]
        got = ws[0] if len(ws) == 1 else -1
        if len(ws) > 1:
            got = -2 - len(self.many)
            self.many[got] = ws
        self[token] = got
        return got


_TOKENS = Tokens()


def encode(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    if not text:
        return np.zeros(0, np.int64)
    if len(_TOKENS) > 500_000:
        _TOKENS.clear()
        _TOKENS.many.clear()
    got = list(map(_TOKENS.__getitem__, plain_text(text).split()))
    if got and min(got) < -1:
        got = [w for x in got for w in (_TOKENS.many[x] if x < -1 else (x,))]
    a = np.array(got, np.int64)
    return a[a >= 0]


class Walks:
    """The random walks and the places at which each is sampled, all from one seed."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 1 << 62, (WALKS, STEPS), dtype=np.int64).astype(np.uint64)
        # the words after an edit may stay out of step: some samples look at the first part of a walk only
        reach = [STEPS, STEPS * 3 // 4, STEPS // 2, STEPS // 2]
        self.places = [[np.sort(rng.choice(reach[k % len(reach)], SAMPLED, replace=False)) for k in range(SETS)] for _ in range(WALKS)]
        self.mult = rng.integers(1, 1 << 62, (WALKS, SETS, SAMPLED), dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of all samples for the windows that begin at ``starts``; ``ids`` is padded by WINDOW."""
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            gap = mixed.dtype.type((int(_GAP) + 3) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            gap ^= gap >> np.uint64(29)
            end = starts + WINDOW
            for r in range(WALKS):
                at = starts.copy()
                out = [np.full(len(starts), r * SETS + k + 1, np.uint64) for k in range(SETS)]
                seen = [0] * SETS
                for step in range(max(int(p[-1]) for p in self.places[r]) + 1):
                    x = np.where(at < end, mixed[at], gap)
                    for k in range(SETS):
                        if seen[k] < SAMPLED and self.places[r][k][seen[k]] == step:
                            o = (out[k] ^ x) * self.mult[r, k, seen[k]]
                            out[k] = o ^ (o >> np.uint64(31))
                            seen[k] += 1
                    h = (x ^ self.salt[r, step]) * np.uint64(0xBF58476D1CE4E5B9)
                    at += ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
                yield from out


def leaks(item: np.ndarray, part: np.ndarray) -> bool:
    """Whether some run of at least MIN_WORDS item words lies in ``part`` with few enough edits.

    An item word counts 1 and an edit -WORDS_PER_EDIT; a path that takes MIN_WORDS item words or more
    and does not end below 0 is a leak.  Exact over all paths: one layer for each number of item words
    taken so far, up to MIN_WORDS.
    """
    m = len(part)
    if len(item) < MIN_WORDS or m < MIN_WORDS - 2:
        return False
    # e edits cut a leak of n >= 8e words into e + 1 intact runs, one of them of five words or more
    eq = item[:, None] == part[None, :]
    if not (eq[4:, 4:] & eq[3:-1, 3:-1] & eq[2:-2, 2:-2] & eq[1:-3, 1:-3] & eq[:-4, :-4]).any():
        return False
    low = -10_000
    prev = np.full((MIN_WORDS + 1, m + 1), low, np.int32)
    prev[0] = 0
    ramp = (np.arange(m + 1) * WORDS_PER_EDIT).astype(np.int32)
    for w in item:
        cur = np.full_like(prev, low)
        cur[0] = 0
        hit = np.where(part == w, 1, 1 - WORDS_PER_EDIT).astype(np.int32)
        best = prev + np.int32(1 - WORDS_PER_EDIT)  # item word missing
        best[:, 1:] = np.maximum(best[:, 1:], prev[:, :-1] + hit)
        cur[1:MIN_WORDS] = best[: MIN_WORDS - 1]
        cur[MIN_WORDS] = np.maximum(best[MIN_WORDS - 1], best[MIN_WORDS])
        cur[1:] = np.maximum.accumulate(cur[1:] + ramp, axis=1) - ramp  # word added
        if cur[MIN_WORDS].max() >= 0:
            return True
        prev = cur
    return False


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.items = [(i, w) for i, w in ((i, encode(t)) for i, t in items) if len(w) >= MIN_WORDS]
        self.vocab = np.unique(np.concatenate([w for _, w in self.items])) if self.items else np.zeros(0, np.int64)
        self.walks = Walks()
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not self.items:
            return
        pad = np.full(WINDOW, _GAP)
        flat = np.concatenate([x for _, w in self.items for x in (w, pad)])
        size = np.array([len(w) - WINDOW + 3 for _, w in self.items])
        begin = np.cumsum([0] + [len(w) + WINDOW for _, w in self.items[:-1]])
        which = np.repeat(np.arange(len(size)), size)
        starts = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for key in self.walks.keys(flat, starts):
            order = np.lexsort((which, key))
            k, w = key[order], which[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
            u, first = np.unique(k[new], return_index=True)
            self.tables.append((u, np.append(first, new.sum()), w[new]))

    def found(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """Position of the document and id of the item of every leak into the given documents."""
        if not self.items or not docs:
            return []
        pad = np.full(WINDOW, _GAP)
        flat = np.concatenate([x for w in docs for x in (w, pad)])
        begin = np.cumsum([0] + [len(w) + WINDOW for w in docs])
        place = np.minimum(np.searchsorted(self.vocab, flat), len(self.vocab) - 1)
        known = np.concatenate([[0], np.cumsum(self.vocab[place] == flat)])
        # a leak's first window holds all of MIN_WORDS words but one edit, or two at its end
        lo = np.arange(len(flat) - WINDOW)
        starts = lo[known[lo + WINDOW] - known[lo] >= WINDOW - 3]
        if not len(starts):
            return []
        at_all, item_all = [], []
        for (u, first, which), key in zip(self.tables, self.walks.keys(flat, starts)):
            pos = np.minimum(np.searchsorted(u, key), len(u) - 1)
            hit = np.flatnonzero(u[pos] == key)
            a = first[pos[hit]]
            cnt = first[pos[hit] + 1] - a
            off = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            at_all.append(np.repeat(starts[hit], cnt))
            item_all.append(which[np.repeat(a, cnt) + off])
        at, item = np.concatenate(at_all), np.concatenate(item_all)
        if not len(at):
            return []
        doc = np.searchsorted(begin, at, side="right") - 1
        order = np.lexsort((at, item, doc))
        doc, item, at = doc[order], item[order], at[order]
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1
        out = []
        for part in np.split(np.arange(len(at)), cut):
            d, k = int(doc[part[0]]), int(item[part[0]])
            item_id, words = self.items[k]
            where = at[part] - begin[d]
            reach = len(words) + len(words) // WORDS_PER_EDIT + 2
            for g in np.split(where, np.flatnonzero(np.diff(where) > 2 * reach) + 1):
                if leaks(words, docs[d][max(0, int(g[0]) - reach) : int(g[-1]) + WINDOW + reach]):
                    out.append((d, item_id))
                    break
        return out


_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def _mapper(index: Index | None, paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int]] = []
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            some = [(k, w) for k, w in zip(keys, map(encode, texts)) if len(w) >= MIN_WORDS - 2]
            for ix in [index] if index else map(read_block, paths):
                for i in range(0, len(some), DOC_BATCH):
                    part = some[i : i + DOC_BATCH]
                    rows += [(part[d][0], item) for d, item in ix.found([w for _, w in part])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], schema=_PAIRS)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Distinct ``doc_id, item_id`` where the document contains a passage of the item.

    Null or short texts and items under 14 words give nothing.  Repeated rows of one document give
    one row a pair.  More than ``item_block`` items are taken in blocks of about that size, all in one
    pass over the documents.
    """
    ship_package(docs.sparkSession)
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n = items.count()
    index, paths = None, []
    if n <= item_block:
        index = Index([(r["item_id"], r["text"]) for r in items.collect()])  # bounded by item_block
    else:
        build = lambda t: Index(list(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist())))
        paths = blocks_in_files(items, Scratch(docs.sparkSession, "leaks"), "item_id", -(-n // item_block), build)
    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(_mapper(index, paths), "doc_id bigint, item_id bigint").distinct()


def leak_report(pairs: DataFrame) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return pairs.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """The exact check alone on all pairs that share five words in a row (for tests and recall)."""
    index = Index(items)
    grams = defaultdict(set)
    for k, (_, ids) in enumerate(index.items):
        for i in range(len(ids) - 4):
            grams[tuple(ids[i : i + 5])].add(k)
    out = set()
    for doc_id, text in docs:
        ids = encode(text)
        near = {k for i in range(len(ids) - 4) for k in grams.get(tuple(ids[i : i + 5]), ())}
        out |= {(doc_id, index.items[k][0]) for k in near if leaks(index.items[k][1], ids)}
    return out
