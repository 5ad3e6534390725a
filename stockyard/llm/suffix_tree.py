"""LM scoring with a probabilistic suffix tree over words.

The tree predicts symbols. The most frequent words are symbols of their own; every other word belongs to
a symbol of its ending, and is drawn within it by its smoothed count: P(word | context) = P(symbol |
context) P(word | symbol). Contexts are the last symbols of a text, none to `depth`. Every context that
occurs `least` times is tested: it diverges if its count times the Kullback-Leibler divergence of its next
symbols from those of the context one shorter exceeds a threshold per next symbol. What diverges is retained,
and so are its suffixes, so a long context is not lost behind a short one that tells nothing. Distributions are smoothed into those of the shorter context (Witten-Bell); a text is scored by the state
of the longest retained suffix at every word and at its end.

All counts cover all training rows; word counts and context counts are shuffled and grow with the corpus,
and so does the tree: a context needs `least` occurrences, an absolute number, so more text has more and
longer contexts. Contexts of one symbol, and those longer ones that occur `heavy` times, are held as next-symbol
entries (12 bytes each) and sent to every task, the most frequent first; `entries` bounds that part of the tree (48
MB), split among the lengths. Of d + 1 symbols only those contexts are counted for it that the entries of d symbols
already show to be so frequent. The rest of the tree is not cut:
every place of a text that leaves the part sent towards a context that may occur `least` times goes to the task of that
context, with its older symbols. There its contexts of all lengths are counted, tested and retained, and what they
change in the place's probability is added to the text's score. A context of the rest is less frequent than those
sent, so no task gets a frequent one. Places travel in packs: those of about half a million symbols that go to one bucket of
contexts are one row, with a number of two bytes for each symbol; what they change comes back as a number for each
row of a task. Files of a shuffle are deleted when the table behind it is written.
Of the word counts only those above a threshold that keeps them below `listed` words are broadcast; the
other words of a text are looked up by a shuffle join.

Null text is empty and scored as its end alone. Rows that repeat an id are scored alike for like text; a
null id trains and is not held out. Without training rows all counts are zero. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import bucket_of, ship, stored
from stockyard.llm.tokens import Words, mix, pieces, signed

U = np.uint64
#: From as many occurrences on, contexts of two symbols or more are sent to every task, within the bound on entries.
HEAVY = 1 << 18
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ending(w: Words, endings: int) -> np.ndarray:
    """Class of each word: its last three bytes (fewer in shorter words), hashed."""
    data, end = w.data, w.end
    length = end - w.start
    code = data[end - 1].astype(np.uint64)
    for back in (2, 3):
        has = length >= back
        code = code * U(257) + np.where(has, data[np.maximum(end - back, 0)].astype(np.uint64) + U(1), U(0))
    return (mix(code) % U(endings)).astype(np.int32)


def word_counts(batches: Iterator[pa.RecordBatch], endings: int) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) summed over a few MB at a time, to spare the shuffle."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed():
        h, c, n = (np.concatenate(x) for x in zip(*held))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, c[at], np.bincount(inv, n).astype(np.int64)

    size = 0
    for batch in batches:
        for _, _, data, offs in pieces(batch.column(0)):
            w = Words(data, offs, lower=True)
            if len(w):
                u, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, ending(w, endings)[at], n))
                size += len(u)
        if size > 2_000_000:
            held = [summed()]
            if len(held[0][0]) > 1_500_000:
                u, c, n = held.pop()
                yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(c), pa.array(n)], names=["word", "ending", "n"])
            size = len(held[0][0]) if held else 0
    if held:
        u, c, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(c), pa.array(n)], names=["word", "ending", "n"])


def found_in(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted `known`, whether it is there) of `wanted`."""
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    slot = np.searchsorted(known, wanted)
    slot[slot == len(known)] = 0
    return slot, known[slot] == wanted


class Finder:
    """`found_in` the same codes again and again: by a table from the first code to the last, if that has at most `most`
    places and not over `sparse` for each code."""

    def __init__(self, known: np.ndarray, most: int = 1 << 24, sparse: int = 256):
        self.known, self.table = known, None
        span = int(known[-1] - known[0]) + 1 if len(known) else 0
        if 0 < span <= min(most, sparse * len(known)):
            self.table = np.full(span + 1, -1, dtype=np.int32)
            self.table[known - known[0]] = np.arange(len(known), dtype=np.int32)

    @property
    def places(self) -> int:
        return 0 if self.table is None else len(self.table)

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            return found_in(self.known, wanted)
        # below the first code, differences are huge as unsigned numbers
        slot = self.table[np.minimum((wanted - self.known[0]).view(U), U(len(self.table) - 1)).view(np.int64)]
        return slot, slot >= 0


def finders(many: list[np.ndarray], most: int = 1 << 24) -> list[Finder]:
    """A finder for each, whose tables have at most `most` places together (4 bytes each)."""
    out: list[Finder] = []
    for known in many:
        out.append(Finder(known, most - sum(x.places for x in out) - 1))
    return out


@dataclass
class Tree:
    """States: 0 is the empty context; each other one adds an older symbol to its parent's context."""

    top: np.ndarray  # hashes of words that are symbols, sorted
    symbols: int  # words, endings, end of text; the start of a text is symbol `symbols`
    endings: int
    children: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per depth: sorted codes (parent, older symbol), states
    root: np.ndarray | None = None  # log10 probabilities of the empty context
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    far: np.ndarray = field(default_factory=lambda: np.ones(1, dtype=bool))  # does it diverge from its parent?
    back: np.ndarray = field(default_factory=lambda: np.zeros(1))  # log10 of what a state leaves to its parent
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # sorted (state, next symbol)
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    finder: Finder | None = None  # of codes; each process makes its own

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finder": None}

    def log(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 P(symbol | state): a state's own entry, or what it leaves to its parent."""
        if self.finder is None or self.finder.known is not self.codes:
            self.finder = Finder(self.codes)
        out, state = np.zeros(len(state)), state.copy()
        live = np.arange(len(state))
        while len(live):
            at_root = state[live] == 0
            done = live[at_root]
            out[done] += self.root[symbol[done]]
            live = live[~at_root]
            slot, hit = self.finder(state[live] * (self.symbols + 1) + symbol[live])
            out[live[hit]] += self.logs[slot[hit]]
            live = live[~hit]
            out[live] += self.back[state[live]]
            state[live] = self.parent[state[live]]
        return out

    def symbols_of(self, w: Words) -> np.ndarray:
        at = np.searchsorted(self.top, w.hash)
        at[at == len(self.top)] = 0
        own = self.top[at] == w.hash if len(self.top) else np.zeros(len(w), dtype=bool)
        return np.where(own, at, len(self.top) + ending(w, self.endings)).astype(np.int64)

    def sequence(self, w: Words, own: np.ndarray) -> np.ndarray:
        """Symbols of all rows, given those of words, each row begun by the start symbol and closed by the end."""
        n = w.rows
        out = np.full(len(w) + 2 * n, self.symbols - 1, dtype=np.int64)
        out[np.arange(len(w)) + 2 * w.row + 1] = own
        out[w.first[:-1] + 2 * np.arange(n)] = self.symbols
        return out

    def states(self, seq: np.ndarray, start: np.ndarray) -> np.ndarray:
        """State of the longest retained suffix before each place (meaningless where a text starts)."""
        n = len(seq)
        state = np.zeros(n, dtype=np.int64)
        node = np.zeros(n, dtype=np.int64)
        live = ~start
        for depth, (codes, names) in enumerate(self.children, 1):
            live = live.copy()
            live[:depth] = False
            at = np.flatnonzero(live)
            if not len(at) or not len(codes):
                break
            code = node[at] * (self.symbols + 1) + seq[at - depth]
            slot = np.searchsorted(codes, code)
            slot[slot == len(codes)] = 0
            hit = codes[slot] == code
            node[at[hit]] = state[at[hit]] = names[slot[hit]]
            live = np.zeros(n, dtype=bool)
            live[at[hit]] = seq[at[hit] - depth] != self.symbols  # nothing stands before the start
        return state

    def pairs(self, seq: np.ndarray, start: np.ndarray, depth: int, frequent: np.ndarray | None) -> np.ndarray:
        """Codes of (context of `depth` symbols whose shorter suffix is a state, next symbol), at every place;
        only contexts in `frequent`, if given."""
        wide = self.symbols + 1
        node = np.zeros(len(seq), dtype=np.int64)
        live = ~start
        for d, (codes, names) in enumerate(self.children[: depth - 1], 1):
            live[:d] = False
            at = np.flatnonzero(live)
            slot, hit = found_in(codes, node[at] * wide + seq[at - d])
            live = np.zeros(len(seq), dtype=bool)
            live[at[hit]] = seq[at[hit] - d] != self.symbols  # nothing stands before the start
            node[at[hit]] = names[slot[hit]]
        live[:depth] = False
        at = np.flatnonzero(live)
        context = node[at] * wide + seq[at - depth]
        if frequent is not None:
            _, known = found_in(frequent, context)
            at, context = at[known], context[known]
        return context * wide + seq[at]


def context_counts(batches: Iterator[pa.RecordBatch], tree: Tree, depth: int, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed():
        code, n = (np.concatenate(x) for x in zip(*held))
        u, inv = np.unique(code, return_inverse=True)
        return u, np.bincount(inv, n).astype(np.int64)

    for _, _, _, seq, begins in texts_of(batches, 0):
        start = np.zeros(len(seq), dtype=bool)
        start[begins[:-1]] = True
        u, n = np.unique(tree.pairs(seq, start, depth, frequent), return_counts=True)
        held.append((u, n))
        size += len(u)
        if size > 3_000_000:
            held = [summed()]
            size = len(held[0][0]) // 2
    if held:
        u, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["code", "n"])


def texts_of(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, symbols, where each row begins and the last ends) of whole rows of about `most` symbols."""
    for batch in batches:
        lists = batch.column(column)
        flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        a = 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
            yield batch, a, b, flat[ends[a] : ends[b]].astype(np.int64), ends[a : b + 1] - ends[a]
            a = b


BLOCK = 1 << 17


def pair_counts(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Counts of (symbol before, symbol) at all places, in blocks of codes: (block, counts of 4 bytes)."""
    counts, n_places = np.zeros(-(-wide * wide // BLOCK) * BLOCK, dtype=np.uint32), 0

    def told() -> pa.RecordBatch:
        blocks = counts.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([blocks[i].tobytes() for i in at], pa.binary())], names=["block", "counts"])

    for _, _, _, seq, begins in texts_of(batches, 0):
        if n_places + len(seq) >= 1 << 32:  # a count may be beyond 4 bytes
            yield told()
            counts[:], n_places = 0, 0
        pair = seq[:-1] * wide + seq[1:]
        inside = np.ones(len(pair), dtype=bool)
        inside[begins[1:-1] - 1] = False
        code, n = np.unique(pair[inside], return_counts=True)
        counts[code] += n.astype(np.uint32)
        n_places += len(seq)
    if n_places:
        yield told()


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[block] = held.get(block, 0) + np.frombuffer(data.as_buffer(), dtype=np.uint32).astype(np.int64)
    for block, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK), pa.array(n[at])], names=["code", "n"])


PACK = "bucket int, places int, runs int, parts int, data binary"


def packed(arrays: list[np.ndarray]) -> bytes:
    """Numbers in one text: first bytes of all, then second ones, and so on, as high bytes differ little; compressed."""
    data = b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of `packed`, given their types and lengths."""
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), dtype=np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def exits(batches: Iterator[pa.RecordBatch], tree: Tree, frequent: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Places whose context, one symbol longer than its longest state of `tree`, may occur `least` times without being a
    state, in packs for each bucket of such contexts: the contexts and how many places each has; of the places the
    next symbol and the older ones (`depth` planes of digits); twice the row, plus one if it trains, in two parts.

    `frequent` has, by length, the contexts that do, of those whose older part (all but the last symbol) is a state. Where
    it is none, the context can only occur that often if the place before was let through for its own."""
    wide, depth = tree.symbols + 1, len(frequent)
    kind = digit_kind(tree)
    both = finders([*frequent, *(codes for codes, _ in tree.children)])
    often, below = both[:depth], [(find, names) for find, (_, names) in zip(both[depth:], tree.children)]
    for batch, a, b, seq, begins in texts_of(batches, 2, 1 << 19):
        rows = batch.column(0).slice(a, b - a).to_numpy() * 2 + batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(begins))
        place = (np.arange(len(seq)) - begins[row]).astype(np.int32)  # 0 where a text starts
        longest, node = np.zeros(len(seq), dtype=np.int8), np.zeros(len(seq), dtype=np.int64)
        at = np.flatnonzero(place > 0)
        for d, (find, names) in enumerate(below, 1):
            at = at[place[at] >= d]
            slot, hit = find(node[at] * wide + seq[at - d])
            at, slot = at[hit], slot[hit]
            longest[at], node[at] = d, names[slot]
        out = np.zeros(len(seq), dtype=bool)
        for d in range(depth):
            at = np.flatnonzero((longest == d) & (place > d))
            _, known = often[d](node[at] * wide + seq[at - d - 1])
            out[at] = np.where(longest[at - 1] >= d, known, out[at - 1]) if d else known
        at = np.flatnonzero(out)
        del out
        if not len(at):
            continue
        size = longest[at].astype(np.int64) + 1
        context = node[at] * wide + seq[at - size]
        hashed = mix(context.astype(np.uint64))
        bits = U(len(at).bit_length())
        order = (np.sort(hashed >> bits << bits | np.arange(len(at), dtype=np.uint64)) & ((U(1) << bits) - U(1))).astype(np.int64)
        at, size, context = at[order], size[order], context[order]
        bucket = ((hashed[order] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        del hashed, order, node, longest
        digits = np.empty((depth, len(at)), dtype=kind)
        digits[0], back = seq[at], place[at]
        for j in range(1, depth):
            there = (size + j <= depth) & (back >= size + j)
            digits[j] = np.where(there, seq[at - np.where(there, size + j, 0)], wide)
        marks = rows[row[at]]
        low, high = (marks & 0xFFFF).astype(np.uint16), marks >> 16
        runs = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1]))))
        sizes, contexts = np.diff(np.append(runs, len(at))).astype(np.int32), context[runs]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        packs = []
        for i, j in zip(edges, np.append(edges[1:], len(at))):
            x, y = np.searchsorted(runs, (i, j))
            h = high[i:j]
            h = h[:1] if (h == h[0]).all() else h
            packs.append((j - i, y - x, len(h), packed([contexts[x:y], sizes[x:y], *[np.ascontiguousarray(z[i:j]) for z in digits], low[i:j], h])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), *[pa.array(x, of) for x, of in zip(zip(*packs), kinds)]], names=["bucket", "places", "runs", "parts", "data"])


def digit_kind(tree: Tree) -> type:
    return np.uint16 if tree.symbols + 1 < 1 << 16 else np.uint32


def in_order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The order by keys, given with a bound of their values; packed into one number each, with the place, if that fits."""
    n = len(keys[0][0])
    bits = n.bit_length()
    if sum(int(most).bit_length() for _, most in keys) + bits > 63:
        return np.lexsort([x for x, _ in reversed(keys)])
    packed = np.zeros(n, dtype=np.int64)
    for x, most in keys:
        packed = packed << int(most).bit_length() | x
    return np.sort(packed << bits | np.arange(n)) & ((1 << bits) - 1)


def begins_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a value begins that differs from the one before in any key."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = False
    for x in sorted_keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def subtrees(tree: Tree, contexts: np.ndarray, group: np.ndarray, digits: np.ndarray, trains: np.ndarray, least: int, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """What all places of some contexts (`group` in `contexts`, from `exits`) change in the log10 probability of their symbols
    by the states behind those contexts, and whether any such state is retained; the tree has the states before them."""
    wide, depth = tree.symbols + 1, len(digits)
    n_places = len(group)
    before, p = np.zeros(n_places), np.zeros(n_places)
    live, digit = np.arange(n_places), np.zeros(n_places, dtype=np.int64)
    levels = []
    for d in range(depth):
        # groups are (group before, older symbol), entries (group, next symbol); places stand in the order of entries
        symbol = digits[0][live].astype(np.int64)
        order = in_order((group, int(group.max())), (digit, wide), (symbol, wide))
        live, group, digit, symbol = live[order], group[order], digit[order], symbol[order]
        heads = begins_of(group, digit)
        parent, own = group[heads], np.zeros(len(live), dtype=np.int64)
        own[heads[1:]] = 1
        own = np.cumsum(own)
        first = begins_of(own, symbol)
        lengths, of = np.diff(np.append(first, len(live))), own[first]
        if d == 0:
            logs = tree.log(contexts[parent[of]] // wide, symbol[first])
            above = 10.0**logs
            before[live] = np.repeat(logs, lengths)
        else:
            above = p[live[first]]
        n = np.add.reduceat(trains[live].astype(np.int64), first)
        edges = begins_of(of)
        total, kinds = np.add.reduceat(n, edges), np.add.reduceat((n > 0).astype(np.int64), edges)
        share = n / np.maximum(total, 1)[of]
        gain = np.where(n > 0, share * np.log(np.maximum(share, 1e-300) / above), 0.0)
        often = total >= least
        far = often & (total * np.add.reduceat(gain, edges) > keep * kinds)
        mixed = (n + kinds[of] * above) / np.maximum(total + kinds, 1)[of]
        inside = often[own]
        mixed = np.repeat(mixed, lengths)[inside]
        live, group = live[inside], own[inside]
        p[live] = mixed
        levels.append((live, group, mixed, far, parent))
        if d + 1 == depth:
            break
        digit = digits[d + 1][live].astype(np.int64)
        there = digit < wide
        live, group, digit = live[there], group[there], digit[there]
        if not len(live):
            break
    for (_, _, _, far, parent), (_, _, _, above, _) in zip(levels[:0:-1], levels[-2::-1]):
        above[parent[far]] = True
    best, retained = before.copy(), np.zeros(n_places, dtype=bool)
    for live, group, p, far, _ in levels:
        deep = far[group]
        best[live[deep]], retained[live[deep]] = np.log10(p[deep]), True
    return best - before, retained


def changes(batches: Iterator[pa.RecordBatch], tree: Tree, depth: int, least: int, keep: float) -> Iterator[pa.RecordBatch]:
    """(high, low, delta, null): the rows of a part (`high`) that change and by how much, summed over places of this task;
    and (null, null, null, state) of the states before what is retained. Buckets come one behind the other."""
    wide, kind = tree.symbols + 1, digit_kind(tree)
    names = ["high", "low", "delta", "state"]
    held: list[tuple] = []  # packs of whole buckets and of the last one, which may go on
    found: list[tuple[np.ndarray, np.ndarray]] = []
    states: list[np.ndarray] = []

    def work(packs: list[tuple]) -> None:
        found_in_packs = [unpacked(data.as_py(), [(np.int64, runs), (np.int32, runs), *[(kind, n)] * depth, (np.uint16, n), (np.int64, parts)]) for _, n, runs, parts, data in packs]
        column = lambda k: np.concatenate([x[k] for x in found_in_packs])
        marks = np.concatenate([(x[-1] << 16) | x[-2] for x in found_in_packs])
        digits = np.stack([column(2 + k) for k in range(depth)])
        contexts, of = np.unique(column(0), return_inverse=True)
        group = np.repeat(of, column(1))
        delta, retained = subtrees(tree, contexts, group, digits, marks & 1, least, keep)
        states.append(np.unique(contexts[np.unique(group[retained])] // wide))
        found.append(by_row(marks[retained] >> 1, delta[retained]))

    def by_row(row: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(row)
        row, delta = row[order], delta[order]
        first = begins_of(row) if len(row) else np.zeros(0, dtype=np.int64)
        return row[first], np.add.reduceat(delta, first) if len(row) else delta

    def told() -> pa.RecordBatch:
        row, delta = by_row(*(np.concatenate(x) for x in zip(*found)))
        edges = begins_of(row >> 16) if len(row) else np.zeros(0, dtype=np.int64)
        ends = np.append(edges[1:], len(row))
        low = [(row[i:j] & 0xFFFF).astype(np.uint16).tobytes() for i, j in zip(edges, ends)]
        more = [delta[i:j].astype(np.float32).tobytes() for i, j in zip(edges, ends)]
        return pa.RecordBatch.from_arrays([pa.array(row[edges] >> 16, pa.int64()), pa.array(low, pa.binary()), pa.array(more, pa.binary()), pa.nulls(len(edges), pa.int64())], names=names)

    size, last = 0, None
    for batch in batches:
        for pack in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
            if pack[0] != last and size > 1 << 17:
                work(held)
                held, size = [], 0
                if sum(len(x[0]) for x in found) > 1 << 19:
                    yield told()
                    found.clear()
            held.append(pack)
            size, last = size + pack[1], pack[0]
    if held:
        work(held)
        yield told()
        all_ = np.unique(np.concatenate(states))
        blank = lambda of: pa.nulls(len(all_), of)
        yield pa.RecordBatch.from_arrays([blank(pa.int64()), blank(pa.binary()), blank(pa.binary()), pa.array(all_, pa.int64())], names=names)


def row_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, delta) of the parts of this task, each of which is summed in an array of its 65,536 rows."""
    part, sums = None, np.zeros(1 << 16)

    def told() -> pa.RecordBatch:
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array((part << 16) + at), pa.array(sums[at])], names=["row", "delta"])

    for batch in batches:
        for high, low, delta in zip(*(c.to_pylist() for c in batch.columns)):
            if high != part:
                if part is not None:
                    yield told()
                part, sums = high, np.zeros(1 << 16)
            sums[np.frombuffer(low, dtype=np.uint16)] += np.frombuffer(delta, dtype=np.float32)
    if part is not None:
        yield told()


def written(df: DataFrame, label: str) -> DataFrame:
    """`stored`, after which the files of its shuffles go at once."""
    conf = df.sparkSession.conf
    held = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return stored(df, label)
    finally:
        conf.unset(CLEAN) if held is None else conf.set(CLEAN, held)


class Model:
    def __init__(self, docs: DataFrame, words: int, endings: int, depth: int, least: int, keep: float, listed: int, entries: int, heavy: int = HEAVY):
        """docs: id, body and whether a row trains; or one column of texts that all train."""
        if len(docs.columns) == 1:
            docs = docs.select(F.lit(None).cast("long").alias("id"), F.col(docs.columns[0]).alias("body"), F.lit(True).alias("train"))
        if (words + endings + 3) ** max(depth - 1, 2) >= 1 << 62:
            raise ValueError("so many symbols and so long contexts have no place in 64 bits")
        spark = docs.sparkSession
        ship(spark)
        train = docs.filter("train").select("body")
        counts = train.mapInArrow(lambda it: word_counts(it, endings), "word long, ending int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))
        self.counts = written(counts, "word-counts")
        trained = train.count()
        found = self.counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.end_count = trained
        self.total = (found.n or 0) + trained  # N: all tokens, ends included
        self.distinct = found.v + (trained > 0)  # V
        top = self.frequent(words)
        self.listed = self.frequent(listed)
        self.listed_floor = int(self.listed["n"].min()) if len(self.listed["n"]) else 1 << 62
        tree = Tree(np.sort(top["word"]), len(top["word"]) + endings + 1, endings)
        classes = self.counts.filter(F.col("n") < (int(top["n"].min()) if len(top["n"]) else 1 << 62)).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        # log10 of what divides (c + 0.1) inside a class; words that are symbols need no second factor
        inside = np.full(endings, np.log10(0.1 * 1))
        for r in classes:
            inside[r.ending] = np.log10(r.n + 0.1 * (r.v + 1))
        self.inside = inside
        self.tree = tree
        self.part = self.parsed(docs)
        # a small corpus has all its contexts sent
        self.fit(self.part, depth, least, keep, entries, least if self.total <= entries // 4 else max(least, heavy))

    def frequent(self, most: int) -> dict[str, np.ndarray]:
        """Words and counts above the smallest count that leaves at most `most` words."""
        steps = self.counts.groupBy(F.floor(F.log2("n") * 16).alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).orderBy(F.desc("s")).collect()
        kept, low = 0, None
        for r in steps:
            if kept + r.k > most:
                break
            kept, low = kept + r.k, r.low
        if low is None:
            return {"word": np.zeros(0, dtype=np.uint64), "n": np.zeros(0, dtype=np.int64)}
        rows = self.counts.filter(F.col("n") >= low).select("word", "n").toPandas().sort_values("word")
        word = rows["word"].to_numpy().view(np.uint64)
        order = np.argsort(word)
        return {"word": word[order], "n": rows["n"].to_numpy()[order]}

    def fit(self, part: DataFrame, depth: int, least: int, keep: float, entries: int, heavy: int) -> None:
        tree, wide, frequent = self.tree, self.tree.symbols + 1, None
        texts = part.filter("train").select("symbols")
        often, self.left = [np.zeros(0, dtype=np.int64) for _ in range(depth)], heavy > least
        for d in range(1, depth + 1):
            counts = self.gather(texts, d, frequent)
            if d == 1:
                zero = np.full(tree.symbols, 0.5)
                for r in counts.groupBy(F.expr(f"code % {wide}").alias("s")).agg(F.sum("n").alias("n")).collect():
                    zero[r.s] += r.n
                tree.root = np.log10(zero / zero.sum())
                first = counts.groupBy(F.expr(f"code div {wide}").alias("context")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
                often[0] = np.sort(np.array([r.context for r in first.collect()], dtype=np.int64))  # as many as symbols
            code, n = self.kept(counts, least if d == 1 else heavy, entries // (2 if d == 1 else 4 if d == 2 else 16), wide)
            if not len(code):
                break
            self.grow(code, n, keep)
            if d < depth:
                often[d] = self.next_contexts(code, n, least, d)
            frequent = self.next_contexts(code, n, heavy, d)
            if not len(frequent):
                break
        tree.logs = tree.logs.astype(np.float32)
        self.rest = self.beyond(part, often, depth, least, keep) if self.left else None
        if self.rest is not None:
            tree.far[self.rest.filter("state is not null").select("state").distinct().toArrow()["state"].to_numpy()] = True
        self.prune()

    def beyond(self, part: DataFrame, often: list[np.ndarray], depth: int, least: int, keep: float) -> DataFrame:
        """What the contexts that are not in the tree sent change in the scores of rows: (high, low, delta), and (state) of
        the states that have to be retained for them."""
        spark = part.sparkSession
        buckets = max(self.total >> 18, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sent = spark.sparkContext.broadcast((self.tree, often))
        packs = part.select("row", "train", "symbols").mapInArrow(lambda it: exits(it, *sent.value, buckets), PACK)
        dealt = packs.repartition(F.col("bucket")).sortWithinPartitions("bucket")
        return written(dealt.mapInArrow(lambda it: changes(it, sent.value[0], depth, least, keep), "high long, low binary, delta binary, state long"), "beyond")

    def gather(self, texts: DataFrame, depth: int, frequent: np.ndarray | None) -> DataFrame:
        wide = self.tree.symbols + 1
        if depth == 1 and wide * wide <= 1 << 23:
            blocks = texts.mapInArrow(lambda it: pair_counts(it, wide), "block long, counts binary")
            return written(blocks.repartition(F.col("block")).mapInArrow(pair_sums, "code long, n long"), "pair-counts")
        shape = Tree(self.tree.top, self.tree.symbols, self.tree.endings, self.tree.children)
        sent = texts.sparkSession.sparkContext.broadcast((shape, frequent))
        counts = texts.mapInArrow(lambda it: context_counts(it, sent.value[0], depth, sent.value[1]), "code long, n long")
        return written(counts.groupBy("code").agg(F.sum("n").alias("n")), "context-counts")

    def kept(self, counts: DataFrame, least: int, most: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries, in the order of codes, of the contexts with `least` occurrences; of the most frequent ones if there are over
        `most` entries, and the others are `left` to `beyond`."""
        contexts = counts.groupBy(F.expr(f"code div {wide}").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter(F.col("total") >= least)
        contexts = written(contexts, "contexts")
        steps = contexts.groupBy(F.floor(F.log2("total") * 16).alias("s")).agg(F.sum("kinds").alias("kinds"), F.min("total").alias("low")).orderBy(F.desc("s")).collect()
        size, low = 0, None
        for r in steps:
            if size + r.kinds > most:
                self.left = True
                break
            size, low = size + r.kinds, r.low
        if low is None:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        wanted = contexts.filter(F.col("total") >= low).select("context")
        rows = counts.join(wanted, F.expr(f"code div {wide}") == F.col("context"), "left_semi").toArrow()
        code, n = rows["code"].to_numpy(), rows["n"].to_numpy().astype(float)
        order = np.argsort(code)
        return code[order], n[order]

    def grow(self, code: np.ndarray, n: np.ndarray, keep: float) -> None:
        """Add contexts as states, and note which of them diverge from their parents."""
        tree, wide = self.tree, self.tree.symbols + 1
        context, symbol = code // wide, code % wide
        edges = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        kinds = np.diff(np.append(edges, len(code)))
        total = np.add.reduceat(n, edges)
        parent = context[edges] // wide
        above = 10.0 ** tree.log(np.repeat(parent, kinds), symbol)
        p = n / np.repeat(total, kinds)
        tree.far = np.concatenate((tree.far, total * np.add.reduceat(p * np.log(p / above), edges) > keep * kinds))
        states = len(tree.parent) + np.arange(len(edges))
        tree.children.append((context[edges], states))
        mixed = (n + np.repeat(kinds, kinds) * above) / np.repeat(total + kinds, kinds)
        tree.codes = np.concatenate((tree.codes, np.repeat(states, kinds) * wide + symbol))  # new states come last
        tree.logs = np.concatenate((tree.logs, np.log10(mixed)))
        tree.parent = np.concatenate((tree.parent, parent))
        tree.back = np.concatenate((tree.back, np.log10(kinds / (total + kinds))))

    def prune(self) -> None:
        """Retain the states that diverge and their suffixes. Numbers close up, so every order stays."""
        tree, wide = self.tree, self.tree.symbols + 1
        kept = tree.far.copy()
        for _, states in reversed(tree.children):
            kept[tree.parent[states[kept[states]]]] = True
        number = np.cumsum(kept) - 1
        tree.children = [(number[codes // wide] * wide + codes % wide, number[states]) for codes, states in ((c[kept[s]], s[kept[s]]) for c, s in tree.children)]
        inside = kept[tree.codes // wide]
        tree.codes, tree.logs = number[tree.codes[inside] // wide] * wide + tree.codes[inside] % wide, tree.logs[inside]
        tree.parent, tree.back, tree.far = number[tree.parent[kept]], tree.back[kept], tree.far[kept]

    def next_contexts(self, code: np.ndarray, n: np.ndarray, least: int, d: int) -> np.ndarray:
        """Contexts of d + 1 symbols that occur `least` times: an entry's next symbol is their last one."""
        tree, wide = self.tree, self.tree.symbols + 1
        often = np.flatnonzero(n >= least)
        context, last = code[often] // wide, code[often] % wide
        older, node = context % wide, context // wide
        between = np.zeros((len(often), max(d - 1, 0)), dtype=np.int64)  # the symbols of the entry's suffix, latest first
        for k in range(d - 2, -1, -1):
            codes, states = tree.children[k]
            own = codes[node - states[0]]  # states of a depth are numbered in the order of their codes
            between[:, k], node = own % wide, own // wide
        state, live = np.zeros(len(often), dtype=np.int64), np.ones(len(often), dtype=bool)
        for k, symbol in enumerate([last, *between.T]):
            codes, states = tree.children[k]
            slot, hit = found_in(codes, state * wide + symbol)
            live &= hit & (symbol != tree.symbols)
            state = np.where(hit, states[slot] if len(states) else 0, 0)
        return np.sort(state[live] * wide + older[live])

    def parsed(self, docs: DataFrame) -> DataFrame:
        """Each row's symbols, from its start to its end, and all of its scores that does not depend on the tree; `others`
        are its words that were not listed."""
        log_all = float(np.log10(self.total + 0.1 * (self.distinct + 1)))
        log_end = float(np.log10(self.end_count + 0.1))
        known = self.listed
        sent = docs.sparkSession.sparkContext.broadcast((self.tree, known["word"], np.log10(known["n"] + 0.1), self.inside))
        end_known = int(self.end_count > 0)

        def run(batches):
            tree, word, logs, inside = sent.value
            for batch in batches:
                for lo, hi, data, offs in pieces(batch.column(1)):
                    w = Words(data, offs, lower=True)
                    own = tree.symbols_of(w)
                    at, hit = found_in(word, w.hash)
                    log_c = np.where(hit, logs[at], 0.0) if len(word) else np.zeros(len(w))
                    base = np.bincount(w.row, log_c, minlength=w.rows) - log_all * (w.counts + 1) + log_end
                    drawn_at = np.flatnonzero(own >= len(tree.top))
                    total = np.bincount(w.row[drawn_at], log_c[drawn_at] - inside[own[drawn_at] - len(tree.top)], minlength=w.rows).astype(float)
                    miss = np.flatnonzero(~hit)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(w.row[miss], minlength=w.rows)))).astype(np.int32)
                    places = np.concatenate(([0], np.cumsum(w.counts + 2))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(w.counts + 1), pa.array(np.bincount(w.row[hit], minlength=w.rows) + end_known), pa.array(base), pa.array(total)]
                        + [pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(w.hash[miss]))), pa.ListArray.from_arrays(pa.array(places), pa.array(tree.sequence(w, own).astype(np.int32)))],
                        names=["id", "train", "n_tokens", "n_known", "base", "total", "others", "symbols"],
                    )

        kind = docs.schema["id"].dataType.simpleString()
        part = docs.select("id", "body", "train").mapInArrow(run, f"id {kind}, train boolean, n_tokens long, n_known long, base double, total double, others array<long>, symbols array<int>")
        return written(part.withColumn("row", F.monotonically_increasing_id()), "parsed")

    def scores(self) -> DataFrame:
        """(id, train, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
        sent = self.part.sparkSession.sparkContext.broadcast(self.tree)

        def run(batches):
            tree = sent.value
            for batch in batches:
                lists = batch.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
                found, a = [], 0
                while a < len(lengths):  # whole rows of about 64 K symbols
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 16), side="right")) - 1)
                    seq, start = flat[ends[a] : ends[b]].astype(np.int64), np.zeros(ends[b] - ends[a], dtype=bool)
                    start[ends[a:b] - ends[a]] = True
                    place = np.flatnonzero(~start)
                    found.append(np.bincount(np.repeat(np.arange(b - a), lengths[a:b] - 1), tree.log(tree.states(seq, start)[place], seq[place]), minlength=b - a))
                    a = b
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.concatenate(found) if found else np.zeros(0))], names=["row", "id", "train", "n_tokens", "n_known", "base", "total", "tree"])

        kind = self.part.schema["id"].dataType.simpleString()
        part = self.part.select("row", "symbols", "id", "train", "n_tokens", "n_known", "base", "total").mapInArrow(run, f"row long, id {kind}, train boolean, n_tokens long, n_known long, base double, total double, tree double")
        others = self.part.select("row", F.explode("others").alias("word"))
        rest = self.counts.filter(F.col("n") < self.listed_floor).select(F.col("word").alias("k"), "n")
        zero = F.lit(0.0)
        more = others.join(rest, others.word == rest.k, "left").select("row", F.log10(F.coalesce("n", F.lit(0)) + 0.1).alias("logs"), F.col("n").isNotNull().cast("long").alias("known"), zero.alias("delta"))
        if self.rest is not None:
            rest = self.rest.filter("high is not null").select("high", "low", "delta").repartition(F.col("high")).sortWithinPartitions("high")
            more = more.union(rest.mapInArrow(row_changes, "row long, delta double").select("row", zero, F.lit(0).cast("long"), "delta"))
        more = more.groupBy(F.col("row").alias("r")).agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"), F.sum("delta").alias("delta"))
        logs = F.coalesce("logs", zero)
        return part.join(more, F.col("row") == F.col("r"), "left").select(
            "id", "train", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(self.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("total") + F.col("tree") + F.coalesce("delta", zero) + logs).alias("score")
        )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, words: int = 2048, endings: int = 512, depth: int = 6, least: int = 16, keep: float = 1.0, listed: int = 200_000, entries: int = 1 << 22, heavy: int = HEAVY) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), (bucket_of(id_col, folds) != held_out).alias("train"))
    out = Model(rows, words, endings, depth, least, keep, listed, entries, heavy).scores()
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
