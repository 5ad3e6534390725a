"""Chunks, joins and their repair against the tokenizers library, for both kinds of tokenizers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stockyard.llm import bpe, entries

SIGNS = ["a", "B", "é", "ß", "İ", " ", "  ", "\t", "\n", "\x0b", "\x1c", " ", " ", "'s", "'", "1", "２", "日", "<|endoftext|>", "é", "ﬁ", "!", "?", "-", "ll", "😀", "Ǆ", "יִ", "<", "|"]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def path(request):
    return entries.tokenizer_path(request.param)


def ids_of(path, texts):
    enc = bpe.Encoder(path)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, type=pa.string())], names=["id", "body"])
    out = []
    for _, _, data, offs in bpe.pieces(batch.column(1)):
        out += [np.frombuffer(x, dtype="<u4").tolist() for x in (bpe.by_words if enc.by_word else bpe.by_chunks)(enc, data, offs)]
    return out


def test_hostile_texts(path):
    r = random.Random(4)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(50))) for _ in range(1500)]
    texts += [" ".join(r.choice(["don't", "x1", "é", "foo", "á", " ", "bar,", "2024"]) for _ in range(3000)) for _ in range(2)] + [None, "", " "]
    tokenizer = Tokenizer.from_file(path)
    assert ids_of(path, texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("every", [1, 2, 5])
def test_joins_are_repaired(path, every):
    """Chunks cut where the tokenizer would not: the joined ids are still those of the whole."""
    r = random.Random(every)
    enc, tokenizer = bpe.Encoder(path), Tokenizer.from_file(path)
    for _ in range(60):
        words = [r.choice([" the", " a", "  ", " x", " isn't", "\n", " 12", " é", " end.", " \t"]) for _ in range(r.randrange(2, 30))]
        chunks = [c for i in range(0, len(words), every) if (c := "".join(words[i : i + every]).encode())]
        whole = b"".join(chunks).decode()
        assert np.frombuffer(enc.text(chunks), dtype="<u4").tolist() == tokenizer.encode(whole, add_special_tokens=False).ids


def test_a_join_that_does_not_agree(path):
    """What `agrees` denies is encoded by `text`, whose joins are repaired."""
    enc, tokenizer = bpe.Encoder(path), Tokenizer.from_file(path)
    enc.by_word, enc.kinds = True, None
    enc.agrees = lambda left, right: False
    text = " ".join(f"w{i} same words again" for i in range(900))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert len(bpe.cut_points(data)) > 1
    found = list(bpe.by_words(enc, data, np.array([0, len(data)])))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == [tokenizer.encode(text, add_special_tokens=False).ids]


def test_joins_look_back_no_further_than_they_differ(path):
    """A text of many chunks is joined in whole, at a cost per join that does not grow with what is joined already."""
    enc, tokenizer = bpe.Encoder(path), Tokenizer.from_file(path)
    words = [f" w{i} isn't  the same" for i in range(12_000)]
    chunks = ["".join(words[i : i + 40]).encode() for i in range(0, len(words), 40)]
    whole = b"".join(chunks)
    assert len(whole) > 1 << 17
    read, ids = [], enc.ids
    enc.ids = lambda data: read.append(len(data)) or ids(data)
    assert np.frombuffer(enc.text(chunks), dtype="<u4").tolist() == tokenizer.encode(whole.decode(), add_special_tokens=False).ids
    assert sum(read) < 4 * len(whole) and max(read[3:]) < 1 << 10
