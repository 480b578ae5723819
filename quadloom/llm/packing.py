"""Filling containers of fixed token capacity with documents.

Method: bin completion branch-and-bound.  A container is built around the largest document left; its
undominated fillings are enumerated, largest documents first, and cut off where their waste exceeds
what a better solution allows.  The best-fit-decreasing solution is the first incumbent; the search
goes on over all documents of a block and then over groups of its emptiest containers, and ends at a
lower bound or a budget of steps.

Documents are spread over blocks of about ``BLOCK_ITEMS`` by a hash of their id and packed block by
block, so no task sees more than a block.  Only ids and sizes are shuffled, never text.
"""

from __future__ import annotations

import base64
import random
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import spread

CAPACITY = 4096
BLOCK_ITEMS = 8192
NODES_PER_CONTAINER = 300  # steps to enumerate one container's fillings
FILLINGS = 8  # fillings kept for a container
SEARCH_STEPS = 20_000  # fillings tried for a block
GROUP = 20  # fillings tried for each container of a group
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OUT_SCHEMA = "doc_id bigint, piece_no int, n_pieces int, n_tokens int, container_id string, position int, token_offset int"


@lru_cache(4)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null texts count 0.  Whole texts are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_tokens int")


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by container: each in the fullest container that still takes it."""
    room: list[tuple[int, int]] = []  # (free, container), ascending
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        k = bisect_right(room, (s - 1, 1 << 60))
        if k < len(room):
            free, c = room.pop(k)
            out[c].append(i)
            insort(room, (free - s, c))
        else:
            out.append([i])
            insort(room, (capacity - s, len(out) - 1))
    return out


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: total size over capacity, raised by the sizes that cannot share a container.

    For a threshold k, sizes above capacity - k stand alone, those above half a container exclude each
    other, and what sizes of k or more do not fit beside the latter needs containers of its own.
    """
    if not sizes:
        return 0
    asc = sorted(sizes)
    total = [0]
    for x in asc:
        total.append(total[-1] + x)
    best = -(-total[-1] // capacity)
    half = bisect_right(asc, capacity // 2)
    for k in [0, *sorted({x for x in asc[:half]})]:
        lone = bisect_right(asc, capacity - k)
        lone_n, mid_n = len(asc) - lone, max(lone - half, 0)
        low = bisect_right(asc, k - 1)
        mid, small = total[max(lone, half)] - total[half], total[half] - total[min(low, half)]
        best = max(best, lone_n + mid_n + max(0, -(-(small - (mid_n * capacity - mid)) // capacity)))
    return best


class Multiset:
    """Sizes with how many of each are left."""

    def __init__(self, sizes: list[int]) -> None:
        self.left: dict[int, int] = {}
        for s in sizes:
            self.left[s] = self.left.get(s, 0) + 1
        self.order = sorted(self.left)

    def largest(self) -> int | None:
        k = len(self.order) - 1
        while k >= 0 and not self.left[self.order[k]]:
            k -= 1
        return self.order[k] if k >= 0 else None

    def move(self, filling: tuple[int, ...], by: int) -> None:
        for s in filling:
            self.left[s] += by


def dominated(chosen: list[int], slack: int, bag: Multiset) -> bool:
    """Whether one size that was left out could take the place of one or two chosen ones.

    Such a filling is at least as full, and what it sets free packs wherever the size would have.
    ``bag`` no longer holds the chosen sizes.
    """
    def spare(low: int, high: int) -> bool:
        k = bisect_right(bag.order, low - 1)
        while k < len(bag.order) and bag.order[k] <= high:
            if bag.left[bag.order[k]] > 0:
                return True
            k += 1
        return False

    n = len(chosen)
    if slack and any(spare(s + 1, s + slack) for s in set(chosen)):
        return True
    return any(spare(t, t + slack) for t in {chosen[a] + chosen[b] for a in range(n) for b in range(a + 1, n)})


def completions(bag: Multiset, free: int, waste: int, nodes: int = NODES_PER_CONTAINER, width: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``free`` that leave at most ``waste`` of it unused, fullest first.

    Sizes are tried in descending order.  A branch ends where even filling all that is left of it, or
    all smaller sizes, leaves more unused than ``waste`` or than the worst of ``width`` known fillings.
    After ``nodes`` steps the best so far are returned.
    """
    best: list[tuple[int, int, tuple[int, ...]]] = []  # unused, number of sizes, sizes
    chosen: list[int] = []
    order, left = bag.order, bag.left
    steps = 0

    def limit() -> int:
        return min(waste, best[-1][0] - 1) if len(best) >= width else waste

    def go(room: int, top: int) -> bool:
        nonlocal steps
        steps += 1
        k = min(top, bisect_right(order, room) - 1)
        while k >= 0 and left[order[k]] <= 0:
            k -= 1
        if k < 0:
            if room <= limit() and not dominated(chosen, room, bag):
                entry = (room, len(chosen), tuple(chosen))
                if entry not in best:
                    insort(best, entry)
                    del best[width:]
            return steps >= nodes
        while k >= 0:
            s = order[k]
            if left[s] > 0:
                if limit() < room - s < order[0]:  # nothing fits beside it, and it leaves too much
                    k -= 1
                    continue
                left[s] -= 1
                chosen.append(s)
                stop = go(room - s, k)
                chosen.pop()
                left[s] += 1
                if stop or steps >= nodes or limit() < 0:
                    return True
            k -= 1
        return False

    go(free, len(order) - 1)
    return [c for _, _, c in best]


def search(sizes: list[int], capacity: int, most: int, steps: int) -> tuple[list[tuple[int, ...]] | None, int]:
    """Depth-first bin completion: a filling of at most ``most`` containers, and the steps it took.

    Each level builds a container around the largest size left; a level whose fillings would waste
    more than ``most`` containers allow has none, and the level above takes its next one.
    """
    bag = Multiset(sizes)
    slack = most * capacity - sum(sizes)
    if slack < 0:
        return None, 0
    taken: list[tuple[int, ...]] = []
    n_left, wasted, spent = len(sizes), 0, 0

    def options() -> list[tuple[int, ...]]:
        big = bag.largest()
        bag.left[big] -= 1
        found = [(big, *c) for c in completions(bag, capacity - big, capacity if n_left == 1 else slack - wasted)]
        bag.left[big] += 1
        return found

    stack = [iter(options())]
    while stack and spent < steps:
        f = next(stack[-1], None)
        if f is None:
            stack.pop()
            if taken:
                f = taken.pop()
                bag.move(f, 1)
                n_left += len(f)
                wasted -= capacity - sum(f)
            continue
        spent += 1
        bag.move(f, -1)
        taken.append(f)
        n_left -= len(f)
        wasted += capacity - sum(f)
        if not n_left:
            return taken, spent
        stack.append(iter(options()))
    return None, spent


def pack(sizes: list[int], capacity: int, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Positions of ``sizes`` (1..capacity each) by container.

    Best-fit decreasing is the incumbent.  The search tries to do with one container less: first all
    sizes, then groups of containers whose unused space adds up to a container or more, the emptiest
    first and then in seeded random order.  It ends at the lower bound, or after ``steps`` fillings
    with the best packing known.
    """
    if not sizes:
        return []
    found = best_fit_decreasing(sizes, capacity)
    least = least_containers(sizes, capacity)
    if len(found) == least:
        return found
    packing = [tuple(sizes[i] for i in c) for c in found]
    start = packing
    whole, spent = search(sizes, capacity, len(packing) - 1, min(steps // 4, 2 * len(packing)))
    steps -= spent
    if whole is not None:
        packing = whole
    rng = random.Random(len(sizes))
    tries = 0
    while len(packing) > least and steps > 0:
        if tries:
            rng.shuffle(packing)
        else:
            packing.sort(key=lambda f: (sum(f), f))
        k = unused = 0
        while k < len(packing) and (unused < capacity or (tries % 4 == 3 and k < 2 * GROUP)):
            unused += capacity - sum(packing[k])
            k += 1
        if unused < capacity:
            break
        part = [s for f in packing[:k] for s in f]
        better = None
        if least_containers(part, capacity) < k:
            better, spent = search(part, capacity, k - 1, min(steps, GROUP * k))
            steps -= spent
        steps -= 1
        if better is not None:
            packing = [*better, *packing[k:]]
            tries = 0
        else:
            tries += 1
    if packing is start:
        return found
    where: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        where.setdefault(s, []).append(i)
    return [[where[s].pop() for s in f] for f in packing]


def _cut(capacity: int, blocks: int):
    """Pieces of every document and the block in which each is packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for doc_id, n in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist()):
                k = max(1, -(-n // capacity))
                for p in range(k):
                    size = min(capacity, n - p * capacity)
                    h = xxhash.xxh64_intdigest(f"{doc_id}/{p}") % blocks
                    rows.append((doc_id, p, k, size, h if 0 < size < capacity else -1 - h))
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "piece_no", "n_pieces", "n_tokens", "block"])

    return run


def _pack_block(capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("n_tokens", pa.int32()), ("container_id", pa.string()), ("position", pa.int32()), ("token_offset", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
        block = t.column("block")[0].as_py()
        sizes = t.column("n_tokens").to_pylist()
        if block < 0:
            ids = [f"full-{d}-{p}" if n else None for d, p, n in zip(t.column("doc_id").to_pylist(), t.column("piece_no").to_pylist(), sizes)]
            zero = pa.array([0 if n else None for n in sizes], pa.int32())
            return pa.table([t.column("doc_id"), t.column("piece_no"), t.column("n_pieces"), t.column("n_tokens"), pa.array(ids, pa.string()), zero, zero], schema=schema)
        cid, pos, off = [""] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for c, members in enumerate(pack(sizes, capacity)):
            at = 0
            for p, i in enumerate(members):
                cid[i], pos[i], off[i] = f"{block}-{c:05d}", p, at
                at += sizes[i]
        return pa.table([t.column("doc_id"), t.column("piece_no"), t.column("n_pieces"), t.column("n_tokens"), pa.array(cid), pa.array(pos, pa.int32()), pa.array(off, pa.int32())], schema=schema)

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Container and place of every document piece: ``OUT_SCHEMA``.

    Documents up to the capacity stay whole; a longer one is split into pieces of the capacity, each a
    full container of its own (``full-<doc>-<piece>``), and a rest that is packed like a document.
    Texts that are null or have no token need no place: one row with null container.  Repeated rows
    are packed as often as they come.
    """
    blocks = max(1, -(-docs.count() // block_items))
    pieces = token_counts(docs, tokenizer).mapInArrow(_cut(capacity, blocks), "doc_id bigint, piece_no int, n_pieces int, n_tokens int, block bigint")
    # whole containers and empty texts only pass through; blocks below 0 hold them
    return pieces.groupBy("block").applyInArrow(_pack_block(capacity), OUT_SCHEMA)


def container_fill(packed: DataFrame) -> DataFrame:
    """Tokens and number of documents of every container."""
    return packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))


def fill_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible, and the unused share."""
    f = container_fill(packed).agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return f.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("lower_bound"), (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused_share"))
