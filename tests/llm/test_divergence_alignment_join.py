"""Source divergence, token alignment and the similarity join against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandline.llm import jaccard_join, source_divergence, token_alignment
from strandline.llm.jaccard_join import bands, differences, jaccard_components, piece_keys, scheme, sketch
from strandline.llm.source_divergence import shares, terms_of
from strandline.llm.token_alignment import Tokenizers, alignment_links

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n ", "a", "Ünïcödé  ﬁ x y\x1cz", "tabs\tand\r\nlines\n\n\nend ", "日本語のテキスト 123", "<0x0A> <s> <unk> �", "🙂🙂 !!", "x" * 5000, "under▁line", "<|endoftext|> a", "nul \x00 b", "ͅ˳ ౷ Ꟁ ⅷ", "  "]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def prose(rng, n, size=400):
    return " ".join("w%d" % rng.randrange(size) for _ in range(n))


# Source divergence


def plain_divergence(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in sources:
        kept = [t for t, n in seen[lang].items() if n >= least]
        v = len(kept)

        def p_of(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q = p_of(sum((counts[lang, s] for s in sources[lang]), Counter()))
        p = {s: p_of(counts[lang, s]) for s in sources[lang]}
        for s in sources[lang]:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources[lang] if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [50_000, 20])
def test_divergence_is_that_of_plain_counts(spark, monkeypatch, cells):
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    rng = random.Random(11)
    vocabulary = ["Alpha", "alpha", "béta", "BÉTA", "ɡamma", "🙂", "d_e", "don't", "x1y", "zz", "É"] + [f"t{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(300):
        some = rng.sample(vocabulary, rng.randrange(1, 12))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", None, ""]), " ".join(rng.choice(some) for _ in range(rng.randrange(40)))))
    rows += [("fr", "lonely", "rare"), ("fr", "other", None), ("it", None, ""), ("en", "silent", "...")] + [("en", "b", "zz zz")] * 3
    made = source_divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least_documents=8, top=5)
    assert sorted(tuple(r) for r in made.collect()) == plain_divergence(rows, 8, 5)
    assert made.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_divergence_flushes_and_large_counts(spark, monkeypatch):
    assert terms_of("Don't ÄB_c9d\x00é") == [w.encode() for w in ("don", "t", "Äb", "c", "d", "é")]
    counts, total = np.array([0, 7, 10**12], np.int64), 10**12 + 7
    assert shares(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 15) for c in counts]
    monkeypatch.setattr(source_divergence, "GATHERED", 3)
    monkeypatch.setattr(source_divergence, "HELD", 2)
    rng = random.Random(5)
    texts = [prose(rng, 30, 9) for _ in range(50)]
    batches = [source_divergence.pa.RecordBatch.from_pylist([{"lang": "x", "source": str(k % 3), "text": t}]) for k, t in enumerate(texts)]
    got, docs = Counter(), Counter()
    for batch in source_divergence._count(iter(batches)):
        for r in batch.to_pylist():
            if r["term"]:
                got[r["source"], r["term"]] += r["n"]
                docs[r["term"]] += r["docs"]
    want = Counter((str(k % 3), w.decode()) for k, t in enumerate(texts) for w in terms_of(t))
    assert got == want and docs == Counter(w.decode() for t in texts for w in set(terms_of(t)))


# Token alignment


def plain_alignment(texts):
    a_of, b_of = Tokenizer.from_file(BPE), SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    alphabet = token_alignment.byte_of_char()
    per_text, holders = [], Counter()
    for text in texts:
        links, groups = Counter(), []
        want = (" " + (text or "")).encode()
        a = [(i, bytes(alphabet[c] for c in a_of.id_to_token(i))) for i in a_of.encode(want.decode(), add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_of.id_to_piece(i)[3:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()) for i in b_of.encode(text)] if text else []
        if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
            ends = [set(), set()]
            for k, tokens in enumerate((a, b)):
                at = 0
                for _, x in tokens:
                    at += len(x)
                    ends[k].add(at)
            cuts, i, j, at_a, at_b = sorted(ends[0] & ends[1]), 0, 0, 0, 0
            for cut in cuts:
                xs, ys = [], []
                while at_a < cut:
                    xs.append(a[i][0])
                    at_a += len(a[i][1])
                    i += 1
                while at_b < cut:
                    ys.append(b[j][0])
                    at_b += len(b[j][1])
                    j += 1
                groups.append((xs, ys))
                for x in xs:
                    for y in ys:
                        links[x, y] += 1
        else:
            a = b = []
        holders.update(links.keys())
        per_text.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for k, (n_a, n_b, groups, links) in enumerate(per_text):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        n_best = sum(n for (x, y), n in links.items() if holders[x, y] == best[x])
        total = sum(n * holders[p] for p, n in links.items())
        out.append((k, n_a, n_b, len(groups), sum(links.values()), n_best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, holders, best


@pytest.mark.parametrize("limits", [(3_000_000, 1_000_000, 4_000_000), (500, 300, 40)])
def test_alignment_is_that_of_plain_loops(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_LINKS", "PART_CHARS", "PART_PAIRS"), limits):
        monkeypatch.setattr(token_alignment, name, value)
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.randrange(1, 200)) for _ in range(30)] + ["Straße  und\n\tEinführung " * 20, "same text", "same text", "日本" * 400]
    block = token_alignment.token_alignment(table(spark, texts), BPE, PIECES, public_tokenizers.PATTERN)
    want, holders, best = plain_alignment(texts)
    assert sorted(tuple(r) for r in block.collect()) == want
    links = alignment_links(table(spark, texts), BPE, PIECES, public_tokenizers.PATTERN).collect()
    assert {(r.a, r.b): (r["count"], r.best) for r in links} == {p: (n, n == best[p[0]]) for p, n in holders.items()}


def test_both_libraries_agree_on_the_texts_that_the_faster_one_encodes():
    with open(BPE, "rb") as f, open(PIECES, "rb") as g:
        both = Tokenizers(f.read(), g.read(), public_tokenizers.PATTERN)
    rng = random.Random(8)
    points = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    texts = [" " + "".join(rng.choice(points) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += [f"{x}{c}{y}" for c in points for x in ("a", "1", "!", " ", "'") for y in ("a", "1", "!", " ")]
    assert [both.fast.encode_ordinary(t) for t in texts] == [e.ids for e in both.a.encode_batch(texts, add_special_tokens=False)]


# Similarity join


def plain_components(texts, link):
    sets = []
    for t in texts:
        words = WORD.findall((t or "").lower() if (t or "").isascii() else (t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= link * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = "c%d" % rng.randrange(10**6)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("link, room", [(80, 1024), (80, 3), (60, 1024)])
def test_join_is_that_of_all_pairs(spark, monkeypatch, link, room):
    monkeypatch.setattr(jaccard_join, "ROOM", room)
    rng = random.Random(link + room)
    texts = ["", None, "one", "one", "One two", "one two", "a b c d e", "a b c d e f"]
    for size, n, changes in ((6, 10, 1), (12, 20, 2), (40, 40, 3), (100, 60, 8), (400, 25, 20), (30, 30, 6)):
        texts += near_copies(rng, prose(rng, size, 10**6), n, changes)
    passage = prose(rng, 30, 10**6)  # that many texts share
    texts += [prose(rng, rng.randrange(5, 150), 10**6) + " " + passage for _ in range(60)]
    words = prose(rng, 200, 10**6).split(" ")
    texts += [" ".join(words[k : k + 100]) for k in range(0, 100, 3)]  # a chain
    rng.shuffle(texts)
    made = jaccard_components(table(spark, texts), link=link)
    assert sorted(tuple(r) for r in made.collect()) == plain_components(texts, link)


@pytest.mark.parametrize("link", [50, 80, 90])
def test_linked_sets_have_a_kept_piece_in_common(link):
    rng = np.random.default_rng(link)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        m = int(rng.integers(0, len(a) * (100 - link) // 100 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[m:]], rng.integers(0, 2**64, int(rng.integers(0, 3)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < link * (len(a) + len(b) - common):
            continue
        lows = bands(link)
        ga, gb = (int(np.searchsorted(lows, len(x), "right")) - 1 for x in (a, b))
        assert abs(ga - gb) <= 1
        band = max(ga, gb)
        least = min((a, b), key=len)
        assert ga == gb or 100 * len(least) >= link * lows[band]
        (ka, sa), (kb, sb) = piece_keys(a, band, link), piece_keys(b, band, link)
        order = lambda keys, spare: np.sort(keys)[: len(keys) - max(spare, 0)]  # noqa: E731  any one order will do
        assert len(np.intersect1d(order(ka, sa), order(kb, sb)))
        assert len(a) + len(b) - 2 * common <= differences(len(a) + len(b), link) <= scheme(band, link)[0]
        size = min(len(sketch(a)), len(sketch(b)))
        x, y = jaccard_join.folded(sketch(a), size), jaccard_join.folded(sketch(b), size)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * common
