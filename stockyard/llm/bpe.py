"""BPE encoding and decoding by reuse of content-defined chunks.

A rolling hash over the last eight bytes proposes cuts, so equal passages of different documents fall
into equal chunks wherever they stand; a cut is moved to the next white space. Of the chunks of a piece of a
batch (512 KB) each distinct one is encoded once, and a task keeps the encodings of what it has seen, so what
documents share is taken from there. Chunks are then joined, and every kind of join is checked: the text around it is
encoded as one, and where that differs from the parts, the text is widened, twice as far each time, until
its encoding agrees with the parts at both ends; it then replaces what stood there. A join that never
agrees is the encoding of both chunks as one.

Where a tokenizer's pre-tokenizer drops white space and so ends every token there, chunks are in turn made
of words, whose encodings fill a dictionary; ids and decoded text are gathered from it by numpy. Where it
also cuts ASCII words into letters, digits and the rest, words are made of these. Both are tried on the
tokenizer itself. Other tokenizers encode chunk by chunk.

The dictionary is per worker process and bounded (`limit` entries in two generations), not per cluster:
README has the figures. Decoded text is made from the ids alone, token strings joined by a space where the
tokenizer file names no decoder. Words and chunks are told apart by 64-bit hashes within a piece and by their
bytes beyond it.

Null and empty texts have no tokens. Rows are independent, so ties and repeats have no effect; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import ship
from stockyard.llm.tokens import Words, mix, pieces

U = np.uint64
WINDOW, MASK = 8, (1 << 10) - 1
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
WHITE = frozenset(b" \t\n\r\x0b\x0c")
LETTER, DIGIT, SIGN, ODD = 1, 2, 3, 4


class TwoGenerations:
    """A dictionary of at most 2 * limit entries that forgets what was not asked for lately."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


def drops_white_space(tokenizer) -> bool:
    """No piece of the pre-tokenizer has white space, and what surrounds a word does not change its pieces."""
    if tokenizer.pre_tokenizer is None:
        return False
    split = lambda t: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    seen = tokenizer.normalizer.normalize_str("ab 'cd") if tokenizer.normalizer else "ab 'cd"
    return split(seen) == split(seen.split()[0]) + split(seen.split()[1])


def cuts_classes(tokenizer) -> bool:
    """Letters, each digit and other ASCII signs but apostrophes are pieces of their own."""
    split = lambda t: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    parts = ["ab", "1", "2", "!?", "Cd", "-", "e", "9", "_", "f", "..", "0"]
    return split("".join(parts)) == [p for x in parts for p in split(x)]


class Units(Words):
    """Words, and for tokenizers that cut them their letters, digits and signs; whole where a byte is not plain."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kinds: np.ndarray | None):
        super().__init__(data, offs)
        if kinds is None or not len(self):
            return
        kind = kinds[data]
        odd = np.concatenate(([0], np.cumsum(kind == ODD)))
        plain = odd[self.end] == odd[self.start]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[self.start] = True
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.end, -1)
        word = np.cumsum(inside[:-1])  # 1 inside words
        whole = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(whole, self.start[~plain], 1)
        np.add.at(whole, self.end[~plain], -1)
        keep = edge[:-1] & (word > 0) & (np.cumsum(whole[:-1]) == 0)
        keep[self.start] = True
        at = np.flatnonzero(keep)
        home = np.searchsorted(self.start, at, side="right") - 1
        self.end = np.minimum(np.append(at[1:], len(data)), self.end[home])
        self.start, self.row = at, self.row[home]
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))


class Runs:
    """Byte strings end to end, of which any selection can be gathered at once."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the selection, where each of it ends)."""
        size = np.diff(self.ends)[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.data[np.repeat(self.ends[which] - ends[:-1], size) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of texts as little-endian 32-bit integers, chunk by chunk."""

    def __init__(self, path: str, limit: int = 60_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_word = drops_white_space(self.tokenizer)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names = sorted((i, t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items())
        strings = [""] * (names[-1][0] + 1 if names else 1)
        for i, t in names:
            strings[i] = t
        #: decoded pieces, if the file names no decoder: token strings, joined by spaces
        self.said = Runs([t.encode() + b" " for t in strings]) if file.get("decoder") is None else None
        suffix = file["model"].get("end_of_word_suffix") or ""
        #: ids that end a word, if the model marks word ends
        self.ends_word = np.array([bool(suffix) and t.endswith(suffix) for t in strings])
        self.kinds: np.ndarray | None = None
        if self.by_word and cuts_classes(self.tokenizer):
            self.kinds = np.full(256, ODD, dtype=np.uint8)
            self.kinds[33:127] = SIGN
            self.kinds[[*range(65, 91), *range(97, 123)]] = LETTER
            self.kinds[48:58] = DIGIT
            self.kinds[[39, *(t["content"].encode()[0] for t in file.get("added_tokens") or [] if t["content"])]] = ODD
        self.known, self.joins = TwoGenerations(limit), TwoGenerations(limit // 10)

    def direct(self, data: bytes) -> bytes:
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def decoded(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4")
        if self.said is None:
            return self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False).encode()
        return self.said.take(numbers)[0].tobytes()[:-1]

    def encodings(self, parts: list[bytes], together: int = 200) -> list[bytes]:
        """Of distinct parts; those not in the dictionary are encoded a few hundred to a call.

        Words of letters and runs of one class are one piece each; so many of them are one text, and the marks of
        word ends tell their ids apart. Where there are more marks than words, they are encoded one by one."""
        found = [self.known.get(p) for p in parts]
        missing = [i for i, f in enumerate(found) if f is None]
        easy, hard = [], missing
        if self.kinds is not None and self.ends_word.any():
            hard = []
            for i in missing:
                p = parts[i]
                plain = p.isalnum() or self.kinds[p[0]] == SIGN if p.isascii() else p.decode().isalpha()
                (easy if plain and len(p) <= 64 else hard).append(i)
        blocks = [easy[a : a + together] for a in range(0, len(easy), together)]
        for at in range(0, len(blocks), 50):
            texts = [b" ".join([parts[i] for i in b]).decode() for b in blocks[at : at + 50]]
            for block, e in zip(blocks[at : at + 50], self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                stops = np.flatnonzero(self.ends_word[ids]) + 1
                if len(stops) == len(block) and stops[-1] == len(ids):
                    raw, b = ids.tobytes(), 0
                    for i, e_ in zip(block, (stops * 4).tolist()):
                        found[i] = raw[b:e_]
                        b = e_
                else:
                    hard += block
        for at in range(0, len(hard), 1000):
            some = hard[at : at + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch([parts[i].decode() for i in some], add_special_tokens=False)):
                found[i] = np.array(e.ids, dtype="<u4").tobytes()
        for i in missing:
            if len(parts[i]) <= 1 << 12:
                self.known.put(parts[i], found[i])
        return found

    def ids(self, data: bytes) -> list[int]:
        return np.frombuffer(self.direct(data), dtype="<u4").tolist()

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Are two words, with the white space between them, encoded as each alone?"""
        found = self.joins.get((left, right))
        if found is None:
            found = self.ids(left + right) == self.ids(left) + self.ids(right)
            self.joins.put((left, right), found)
        return found

    def join(self, left: bytearray, ids: array, right: bytes, right_ids: list[int]) -> None:
        """Append `right`, which begins with white space, to `left`, and to `ids` what it adds or changes.

        Both are read from the join outwards, only as far as they are encoded as one."""
        opens = lambda b, i: b[i] in WHITE and (i == 0 or b[i - 1] not in WHITE)
        back = (i for i in range(len(left) - 1, -1, -1) if opens(left, i))
        ahead = (i for i in range(len(right)) if opens(right, i))
        starts: list[int] = []
        ends: list[int] = []
        k = 1
        while True:
            starts += islice(back, k - len(starts))
            ends += islice(ahead, k + 1 - len(ends))
            a = starts[k - 1] if k <= len(starts) else 0
            b = ends[k] if k < len(ends) else len(right)
            before, behind = bytes(left[a:]), right[:b]
            both = self.ids(before + behind)
            if a == 0 and b == len(right):
                ids[:] = array("I", both)
                break
            ta, tb = self.ids(before), self.ids(behind)
            cut = len(ids) - len(ta)
            # the parts are known at both ends: what stands there is the same alone, in its chunk and joined
            known = both and (a == 0 or (ids[cut:].tolist() == ta and both[:1] == ta[:1])) and (b == len(right) or (right_ids[: len(tb)] == tb and both[-1:] == tb[-1:]))
            if known and (both == ta + tb or (len(ta) > 1 and len(tb) > 1)):
                del ids[0 if a == 0 else cut :]
                ids.extend(both)
                ids.extend(right_ids[len(tb) :])
                break
            k *= 2
        left += right

    def text(self, chunks: list[bytes]) -> bytes:
        """One text given as chunks."""
        ids, done = array("I"), bytearray()
        for c in chunks:
            own = np.frombuffer(self.encodings([c])[0], dtype="<u4").tolist()
            self.join(done, ids, c, own)
        return np.array(ids, dtype="<u4").tobytes()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of white space at which chunks begin, decided by the eight bytes before a proposed cut."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint32)
    for j in range(WINDOW):
        h *= np.uint32(2654435761)
        h += data[j : j + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    proposed = np.flatnonzero((h >> np.uint32(12)) & np.uint32(MASK) == 0) + WINDOW
    spaces = np.flatnonzero(data == 32)
    at = np.searchsorted(spaces, proposed)
    return np.unique(spaces[at[at < len(spaces)]])


def by_words(enc: Encoder, data: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
    """Encodings of the rows of a piece: distinct chunks out of distinct words, rows out of chunks."""
    w = Units(data, offs, enc.kinds)
    rows = len(offs) - 1
    cuts = np.union1d(cut_points(data), offs[:-1])
    chunk_of = np.searchsorted(cuts, w.start, side="right") - 1
    inside = np.flatnonzero(np.concatenate(([True], chunk_of[1:] != chunk_of[:-1]))) if len(w) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(inside, len(w)))
    place = (np.arange(len(w)) - np.repeat(inside, size)).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(w.hash ^ mix(place + U(0x51ED))))))
    key = mix(sums[inside + size] - sums[inside] + size.astype(np.uint64)) if len(inside) else sums[:0]
    _, first, chunk = np.unique(key, return_index=True, return_inverse=True)
    # words of the first of equal chunks; each distinct word is encoded once
    mine = np.repeat(inside[first], size[first]) + np.arange(int(size[first].sum())) - np.repeat(np.cumsum(size[first]) - size[first], size[first]) if len(first) else inside
    _, at, word = np.unique(w.hash[mine], return_index=True, return_inverse=True)
    whole = data.tobytes()
    text = lambda i: whole[w.start[i] : w.end[i]]
    ids, id_ends = Runs(enc.encodings([text(i) for i in mine[at].tolist()])).take(word)
    bounds = id_ends[np.concatenate(([0], np.cumsum(size[first]))).astype(np.int64)].tolist()
    ids, id_ends = Runs([ids[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]).take(chunk)
    begin = np.searchsorted(w.row[inside], np.arange(rows + 1)) if len(inside) else np.zeros(rows + 1, dtype=np.int64)
    # joins: the last word of a chunk and the first of the next, each distinct pair once
    odd: set[int] = set()
    left = np.flatnonzero(w.row[inside[1:]] == w.row[inside[1:] - 1]) if len(inside) > 1 else inside[:0]
    if len(left):
        pairs = mix(w.hash[inside[left + 1] - 1]) ^ w.hash[inside[left + 1]]  # chunks begin at white space, so both are whole or outer parts of words
        _, some, kind = np.unique(pairs, return_index=True, return_inverse=True)
        good = np.array([enc.agrees(text(i - 1), b" " + text(i)) for i in inside[left[some] + 1].tolist()], dtype=bool)
        odd = set(w.row[inside[left + 1]][~good[kind]].tolist())
    for r in range(rows):
        a, b = begin[r], begin[r + 1]
        if r in odd:
            cut = [int(c) for c in cuts[(cuts > offs[r]) & (cuts < offs[r + 1])]]
            yield enc.text([whole[x:y] for x, y in zip([int(offs[r]), *cut], [*cut, int(offs[r + 1])])])
        else:
            yield ids[id_ends[a] : id_ends[b]].tobytes()


def by_chunks(enc: Encoder, data: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
    cuts, whole = cut_points(data), data.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        cut = cuts[(cuts > a) & (cuts < b)].tolist()
        yield enc.text([whole[x:y] for x, y in zip([a, *cut], [*cut, b]) if y > x])


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept between tasks."""
    kept = sys.modules.setdefault("_stockyard_kept", types.ModuleType("_stockyard_kept")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        counts, ids, decoded, raw = [], [], [], []
        for _, _, data, offs in pieces(batch.column(1), 1 << 19):
            for i in (by_words if enc.by_word else by_chunks)(enc, data, offs):
                counts.append(len(i) // 4)
                ids.append(hashlib.sha256(i).hexdigest())
                decoded.append(hashlib.sha256(enc.decoded(i)).hexdigest())
                if keep_ids:
                    raw.append(np.frombuffer(i, dtype="<u4").astype(np.int32))
        columns = [batch.column(0), pa.array(counts, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns.append(pa.array(raw, type=pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, digests of ids and of the decoded text, and the ids if asked for."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(lambda it: encode_batches(it, tokenizer_path, keep_ids), schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """The decoded text of each row's ids."""
    ship(encoded.sparkSession)

    def decode(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = enc.tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)
