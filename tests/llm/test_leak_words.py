"""Words of texts on their way to the index of test items."""

import cProfile
import pstats
import random
from collections import Counter

import pyarrow as pa
import pytest
from test_operators import brute_leaks, prose

from strandline.llm import decontaminate
from strandline.llm.decontaminate import build_index, word_codes, words_of


def index_of(items):
    frequency = Counter(w for _, t in items for w in set(words_of(t)))
    sizes = [len(words_of(t)) for _, t in items]
    return build_index([(i, t, {w: frequency[w] for w in words_of(t)}) for i, t in items], len(items), sum(sizes) / len(sizes), max(sizes))


def search(index, texts):
    return decontaminate._search(index, pa.array(texts, pa.string()))


def test_words_are_not_taken_one_by_one():
    """Calls of functions must not grow with the number of different words in a batch, whatever letters they have."""
    rng = random.Random(1)
    index = index_of([(k, prose(rng, 30, 500)) for k in range(50)])
    for letters in ("abcdefghij", "äbcdefghij", "абвгдежзик"):
        texts = ["".join(letters[int(d)] for d in "%08d" % rng.randrange(10**8)) + ",\n" for _ in range(20_000)]
        profile = cProfile.Profile()
        profile.runcall(search, index, ["".join(texts)])
        assert pstats.Stats(profile).total_calls < 2000


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_codes_are_those_of_plain_words(kind):
    rng = random.Random(2)
    letters = "aAzZ_09 \t\n\v\f\r.,#-\x00\x1c\x1f\x7f\x85\xa0 «»“”×÷ßÄäéÉñİıΣσςſKΩ²½µªº̇́ǅﬁ中文かナ한ЖжأبहिÀ😀𝔸𐐀"
    texts = [None, "", " ", "...", "« »", "ΟΔΟΣ ΟΔΟΣ. Σ", "İstanbul", "﻿word"] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2000)]
    words = sorted({w for t in texts for w in words_of(t)})
    known = words[::2]
    place = {w: k for k, w in enumerate(known)}
    array = pa.array(texts, kind)
    for some, given in ((texts, array), (texts[5:900], array[5:900]), (texts[:4], array[:4]), ([], array[:0]), (texts[1:2], array[1:2])):
        codes, begins = word_codes(given, pa.array(known, pa.large_string()).cast(pa.large_binary()))
        expected = [[place.get(w, -1) for w in words_of(t)] for t in some]
        assert begins.tolist()[0] == 0 and [codes[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == expected


@pytest.mark.parametrize("looked_up", [1, 700, 200_000])
def test_leaks_do_not_depend_on_how_many_terms_are_looked_up(monkeypatch, looked_up):
    monkeypatch.setattr(decontaminate, "LOOKED_UP", looked_up)
    rng = random.Random(3)
    items = [(k, prose(rng, rng.choice([1, 4, 8, 20]), 60)) for k in range(70)]
    texts = [None, ""] + [prose(rng, rng.randrange(0, 90), 60) for _ in range(40)]
    texts += [prose(rng, rng.randrange(0, 70), 60) + " " + rng.choice(items)[1].upper() + "! " + prose(rng, rng.randrange(0, 70), 60) for _ in range(60)]
    got = {(k, x["item_id"]) for k, found in enumerate(search(index_of(items), texts)) for x in found}
    assert got == brute_leaks(texts, items)
