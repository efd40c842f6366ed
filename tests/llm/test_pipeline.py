"""The whole pipeline against plain versions of its stages, on a small corpus."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import WORD, brute_components, brute_leaks, brute_lines, encoding, plain_terms, prose

import corpus_pipeline
from strandline.llm.quality_votes import learn_voters
from strandline.llm.storage import Workspace


def corpus(rng):
    """Texts, labels and items: good prose and shouted junk, shared passages, near copies, leaks, empty texts."""
    passage = [prose(rng, 13, 10**5) for _ in range(4)]
    items = [(k, prose(rng, 14, 10**5).capitalize() + ". " + prose(rng, 6, 10**5) + ".") for k in range(3)]
    texts = []
    for k in range(60):
        lines = [prose(rng, 25, 10**5) for _ in range(3)]
        if k % 6 == 0:
            lines[1:1] = passage
        if k % 9 == 4:
            lines.append(rng.choice(items)[1])
        texts.append("\n".join(lines))
        if k % 7 == 3:
            words = texts[-1].split(" ")
            words[5] = "changed"
            texts.append(" ".join(words))
    good = len(texts)
    texts += [" ".join(rng.choice(["BUY", "!!!", "$$$", "NOW", "WIN"]) for _ in range(60)) for _ in range(25)]
    texts += ["", None]
    labels = [(k, int(k < good), 0) for k in range(good + 25) if k % 2 == 0]
    return texts, labels, items


def plain_pipeline(texts, voters, items):
    def good(text):
        terms = plain_terms(text)
        row = (np.array(sorted(terms), int), np.array([terms[t] for t in sorted(terms)], np.float32))
        return voters.score([row])[0] >= 0.3

    kept = {k: t or "" for k, t in enumerate(texts) if good(t)}
    ids = sorted(kept)
    lines = brute_lines([kept[k] for k in ids])
    kept = {k: lines[n][0] for n, k in enumerate(ids) if lines[n][1] == 0 or WORD.search(lines[n][0])}
    ids = sorted(kept)
    component = brute_components([kept[k] for k in ids], link=corpus_pipeline.NEAR)
    kept = {k: kept[k] for n, k in enumerate(ids) if component[n][1] == n}
    ids = sorted(kept)
    leaks = {d for d, _ in brute_leaks([kept[k] for k in ids], items)}
    kept = {k: kept[k] for n, k in enumerate(ids) if n not in leaks}
    out = {}
    for k, text in kept.items():
        tokens = encoding_once.encode_ordinary(text)
        out[k] = (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


encoding_once = encoding()


def test_the_pipeline_matches_plain_stages(spark, tmp_path):
    texts, labels, items = corpus(random.Random(21))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain_pipeline(texts, learn_voters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), items)
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected
    assert 30 < len(expected) < len(texts) - 25


def test_tables_of_stages_are_removed(spark, tmp_path):
    begin = Workspace.mark()
    space = Workspace(spark, "test")
    kept = space.keep(spark.range(3))
    path = kept.inputFiles()[0]
    Workspace.drop_since(begin)
    assert space.tables == [] and Workspace.mark() == begin
    from pathlib import Path
    from urllib.parse import urlparse

    assert not Path(urlparse(path).path).exists()
