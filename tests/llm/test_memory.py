"""What tasks hold and do again: counts of toxicity, remembered pieces of the encoder."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from flowlens.llm import tokens, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_of_letters_are_small():
    """Many different words: the columns are narrow, and one at a time is put in order."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, row)) for row in rng.integers(97, 123, (200_000, 8))]
    texts = [" ".join(words[a : a + 2_000]) for a in range(0, len(words), 2_000)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": [k % 2 for k in range(len(texts))]})
    list(toxicity._count([batch.slice(0, 1)]))
    tracemalloc.start()
    counted = pa.Table.from_batches(list(toxicity._count([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = {c: sum(counted.column(c).to_pylist()) for c in ("n0", "n1")}
    assert sum(n.values()) == 8 * len(words) and n["n0"] == n["n1"]
    assert counted.num_rows > 800_000 and most < 180e6


class _Counted:
    """A file's model that tells what it was asked."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


def test_frequent_pieces_stay_known(monkeypatch):
    """Words that keep coming are not encoded again when the memory is full; runs of marks do not need the whole tokenizer."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    e, t, rng = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(5)
    e.model, whole, e_whole = _Counted(e.model), [], e._whole
    e._whole = lambda texts: (whole.extend(texts), e_whole(texts))[1]
    for _ in range(200):
        once = "".join(rng.choices("abcdefgh", k=12))
        text = f"x often seen {once} often {once}*** seen."
        assert e.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(e.inner) + len(e.older[True]) < 100
    assert sum(w.endswith("often") for w in e.model.asked) == 1
    assert len(whole) < 10


def test_runs_of_marks_are_the_tokenizer():
    e, t, rng = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(6)
    parts = [*"abÉß'", " ", "\n", *tokens._RUNS, "***", "<|endoftext|>", "endoftext", "'s", "1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert e.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
