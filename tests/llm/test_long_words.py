"""Words of many characters under the subword lattice: the recursion along one word, its memory, and hot long words."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from ledgerlight.llm import lattice_lm
from ledgerlight.llm.tokenizers_path import path


@pytest.fixture(scope="module")
def lattice():
    pieces = lattice_lm.vocabulary(path("piece_bpe_32k.model"))
    own = 1.0 / np.arange(10, 10 + len(pieces))
    return lattice_lm._lattice(pieces, own, np.full(256, own.sum() / 25600), own.sum() / 2)


def spelled(n, seed):
    return "".join(random.Random(seed).choices("etaoinshrdlu0漢é", k=n))


@pytest.mark.parametrize("block", [7, 50_000])
def test_one_by_one_equals_many_at_once(lattice, monkeypatch, block):
    monkeypatch.setattr(lattice_lm, "BLOCK", block)
    words = [spelled(n, n) for n in (1, 2, 3, 9, 200, 900)] + [spelled(40, n) for n in range(50)]
    times, got = np.linspace(0.5, 3, len(words)), []
    for alone in (True, False):
        monkeypatch.setattr(lattice_lm.Lattice, "_one_by_one", staticmethod(lambda codes, alone=alone: alone))
        counts, by_bytes = np.zeros(len(lattice.pieces)), np.zeros(256)
        lattice.expect(words, times, counts, by_bytes)
        got.append((lattice.log_probabilities(words), counts, by_bytes))
    for a, b in zip(*got, strict=True):
        assert a == pytest.approx(b, abs=1e-7)


def test_a_million_characters_without_a_space(lattice):
    word, counts, by_bytes = spelled(1_000_000, 5), np.zeros(len(lattice.pieces)), np.zeros(256)
    began = time.time()
    lattice.expect([word], np.ones(1), counts, by_bytes)
    whole = lattice.log_probabilities([word])[0]
    assert time.time() - began < 60 and np.isfinite(whole)
    # what is used spells the word and its opening mark
    length = [len(p.encode()) - 3 * (p[0] == lattice_lm.SPACE) for p in lattice.pieces]
    assert counts @ length + by_bytes.sum() == pytest.approx(len(word.encode()), rel=1e-6)
    short = spelled(100_000, 6)
    tracemalloc.start()
    lattice.expect([short], np.ones(1), counts, by_bytes)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_frequent_long_words(spark):
    """A long word that every text holds scores alike whether it's broadcast or looked up; one text is a single word."""
    line = "=" * 90
    rows = [(n, f"{line} w{n % 7} {'x' * 100}{n}") for n in range(60)] + [(60, spelled(30_000, 1)), (61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = path("piece_bpe_32k.model")
    none, some = (
        {r.doc_id: r for r in lattice_lm.score_documents(docs, model, most_hot=most).collect()} for most in (0, 200_000)
    )
    assert len(some) == 63 and some[61].score == some[62].score
    for i, r in some.items():
        assert (r.n_tokens, r.n_known) == (none[i].n_tokens, none[i].n_known)
        assert (r.score, r.base_score) == pytest.approx((none[i].score, none[i].base_score), rel=1e-9)
    assert all(r.n_known >= 3 for i, r in some.items() if i < 60)


def test_counts_of_long_words(spark):
    rows = [(n, f"{'a' * 500}{n % 3} b") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {bytes(r.word): r.n for r in lattice_lm.word_counts(docs).collect()}
    assert got[b"b"] == 40 and got[b""] == 40 and got[b"a" * 500 + b"0"] == 14 and len(got) == 5
