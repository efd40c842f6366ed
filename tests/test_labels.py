from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import labels as lb
from strandline.operators import repair
from strandline.plans.annotate import annotate, annotate_genome, duration
from strandline.plans import hmm


def label_rows(spark, states, seq="s", strand="+"):
    return spark.createDataFrame([(seq, strand, k, x) for k, x in enumerate(states)], "seq string, strand string, idx long, state int")


PATH = [0, 0, 0, 7, 5, 6, 4, 8, 1, 1, 1, 1, 11, 4, 5, 14, 0, 0, 0]


def test_regions_and_transcripts(spark, monkeypatch):
    monkeypatch.setattr(lb, "STRETCH", 4)
    found = lb.regions(label_rows(spark, PATH))
    assert [tuple(r)[2:] for r in found.orderBy("start").collect()] == [("intergenic", 0, 3), ("CDS", 3, 8), ("intron", 8, 12), ("CDS", 12, 16), ("intergenic", 16, 19)]
    (tx,) = lb.region_transcripts(found).collect()
    assert (tx.tx_start, tx.tx_end, [tuple(c) for c in tx.cds]) == (3, 16, [(3, 8), (12, 16)])


def test_open_runs_are_left_out(spark):
    rows = label_rows(spark, [4, 4, 0, 1, 1, 0, 5, 5])
    (tx,) = lb.region_transcripts(lb.regions(rows, offset=100)).collect()
    assert (tx.tx_start, tx.tx_end, tx.cds) == (103, 105, [])
    assert lb.region_transcripts(lb.regions(label_rows(spark, [4, 4]))).collect() == []
    with pytest.raises(Exception, match="unknown state"):
        lb.regions(label_rows(spark, [15])).collect()


def chunk_rows(spark, chunks, strand="+"):
    return spark.createDataFrame([("s", strand, k, c) for k, c in enumerate(chunks)], "seq string, strand string, chunk_no long, states array<int>")


def test_mismatches(spark):
    rows = chunk_rows(spark, [[0, 0, 0], [0, 4, 5], [5, 1, 1], [1, 1, 4], [4, 0, 0]])
    assert sorted(r.boundary for r in lb.mismatches(rows).collect()) == [1, 3]
    assert sorted(r.boundary for r in lb.mismatches(rows, 2).collect()) == [0, 1, 3]
    both = rows.unionByName(chunk_rows(spark, [[0, 0, 0], [1, 1, 1], [2, 2, 2], [2, 2, 2], [2, 2, 2]], "-"))
    assert tuple(lb.mismatch_totals(lb.mismatches(both)).first()) == (1, 1, 1)


def test_strands_are_merged_by_start(spark):
    rows = spark.createDataFrame([("b", "+", 5, 9), ("a", "-", 3, 9), ("a", "+", 3, 4), ("a", "+", 1, 2)], "seq string, strand string, tx_start long, tx_end long")
    got = sorted((r.tx, r.seq, r.strand, r.tx_start) for r in lb.merged_strands(rows, 4).collect())
    assert got == [(4, "a", "+", 1), (5, "a", "+", 3), (6, "a", "-", 3), (7, "b", "+", 5)]


def plain_clear(flat, pos):
    """Everything between the 0 before ``pos`` and the one from ``pos`` on becomes 0, in place."""
    low = next((i for i in range(pos - 1, -1, -1) if flat[i] == 0), 0)
    high = next((i for i in range(pos, len(flat)) if flat[i] == 0), len(flat))
    flat[low:high] = [0] * (high - low)


def plain_repair(rows, again, size):
    """Border after border: those of one strand first, then those of both; ``again`` maps a border to (asked, states)."""
    rows, failed = [list(r) for r in rows], []
    for b, (_, states) in sorted(again.items(), key=lambda x: (x[1][0], x[0])):
        half = size // 2
        center = states[: half + min(half, len(rows[b + 1]))]
        left, right = rows[b], rows[b + 1]
        l = next((i for i in range(half, 0, -1) if left[-i] == center[half - i]), None)
        r = next((i for i in range(len(center) - half - 1, -1, -1) if right[i] == center[half + i]), None)
        if l is None or r is None:
            failed.append((b + 1) * size)
        else:
            rows[b], rows[b + 1] = left[: len(left) - l + 1] + center[half - l + 1 : half], center[half : half + r] + right[r:]
    flat = sum(rows, [])
    for pos in failed:
        plain_clear(flat, pos)
    bounds = np.cumsum([0] + [len(r) for r in rows])
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@pytest.mark.parametrize("size,labels", [(8, 3), (8, 6), (5, 4), (2, 3)])
def test_repairs_match_border_after_border(spark, size, labels):
    rng = np.random.default_rng(size * 10 + labels)
    chunk_rows_, again_rows, want = [], [], {}
    for k in range(60):
        strand = "+-"[k % 2]
        rows = [np.where(rng.random(size) < 0.8, rng.integers(0, labels, size), 0).tolist() for _ in range(rng.integers(1, 9))]
        rows.append(rng.integers(0, labels, rng.integers(1, size + 1)).tolist())
        other, mine = (0, 1) if strand == "-" else (1, 0)
        again = {b: (int(rng.choice([mine, 2, other])), rng.integers(0, labels, 2 * (size // 2)).tolist()) for b in range(len(rows) - 1) if rng.random() < 0.6}
        chunk_rows_ += [(f"s{k}", strand, n, r) for n, r in enumerate(rows)]
        again_rows += [(f"s{k}", strand, b, asked, states) for b, (asked, states) in again.items()]
        want[f"s{k}"] = plain_repair(rows, {b: x for b, x in again.items() if x[0] != other}, size)
    chunks = spark.createDataFrame(chunk_rows_, "seq string, strand string, chunk_no long, states array<int>")
    again = spark.createDataFrame(again_rows, "seq string, strand string, boundary long, asked int, states array<int>")
    got = {}
    for r in repair.repaired(chunks, again, size).orderBy("seq", "chunk_no").collect():
        got.setdefault(r.seq, []).append(r.states)
    assert got == want


def test_clearing(spark):
    row = [0, 4, 4, 0, 5, 5, 0, 6]
    for pos, expected in ((5, [0, 4, 4, 0, 0, 0, 0, 6]), (7, [0, 4, 4, 0, 5, 5, 0, 0]), (1, [0, 0, 0, 0, 5, 5, 0, 6]), (3, [0, 0, 0, 0, 5, 5, 0, 6])):
        flat = list(row)
        plain_clear(flat, pos)
        assert flat == expected
    chunks = chunk_rows(spark, [[0, 4, 4, 4], [4, 4, 4, 4], [4, 0, 6, 6], [7, 7]])
    borders = spark.createDataFrame([("s", "+", 0), ("s", "+", 1), ("s", "+", 2), ("s", "-", 0)], "seq string, strand string, boundary long")
    got = repair.cleared(chunks, borders, 4).orderBy("chunk_no").collect()
    assert [r.states for r in got] == [[0] * 4, [0] * 4, [0] * 4, [0, 0]]
    got = repair.cleared(chunks, borders.where("boundary = 2"), 4).orderBy("chunk_no").collect()
    assert [r.states for r in got] == [[0, 4, 4, 4], [4, 4, 4, 4], [4, 0, 0, 0], [0, 0]]


def predictor(states_of):
    """A stub: looks states up by sequence, strand and chunk."""

    def predict(chunks):
        def run(batches):
            for rows in batches:
                out = [(s, strand, int(n), states_of[s][strand][int(n)]) for s, n in zip(rows["name"], rows["chunk_no"]) for strand in ("+", "-")]
                yield pd.DataFrame(out, columns=["seq", "strand", "chunk_no", "states"])

        return chunks.select("name", "chunk_no").mapInPandas(run, "seq string, strand string, chunk_no long, states array<int>")

    return predict


def test_the_whole_pipeline_with_stub_predictors(spark, tmp_path):
    nothing = [[0] * 10] * 3
    first = {"x": {"+": [[0, 0, 0, 7, 5, 6, 4, 5, 6, 4], [6, 6, 6, 4, 5, 14, 0, 0, 0, 0], [0] * 10], "-": nothing}}
    again = {"x": {"+": {0: [6, 4, 5, 6, 4, 5, 6, 6, 4, 5]}, "-": {0: [0] * 10}}}
    genome = spark.createDataFrame([("x", 0, "ACGTA" * 5)], "name string, seq_ord long, sequence string")
    got = annotate(genome, predictor(first), 10, predictor(again)).collect()
    assert [(r.strand, r.tx, [tuple(c) for c in r.cds]) for r in got] == [("+", 1, [(3, 16)])]
    output = f"{tmp_path}/out.gtf"
    sums = annotate_genome(genome, predictor(first), f"file://{output}", 10, predictor(again), min_sequence_size=1)
    assert sums == {"sequences": 1, "nucleotides": 25, "predicted_genes": 1, "genes": 1}
    lines = [r.value for r in spark.read.text(f"file://{output}").collect()]
    assert len(lines) == 6 and lines[0].split("\t")[2:5] == ["gene", "4", "16"]
    with pytest.raises(Exception, match="exists"):
        annotate_genome(genome, predictor(first), f"file://{output}", 10, predictor(again), min_sequence_size=1)
    with pytest.raises(ValueError):
        annotate_genome(genome, predictor(first), "x.txt", 10)
    with pytest.raises(ValueError):
        annotate(genome, predictor(first), 9)


def test_failed_merge_clears_the_gene(spark):
    first = {"x": {"+": [[0, 7, 5, 6, 4, 5, 6, 4, 5, 6], [6, 6, 6, 4, 14, 0, 0, 7, 14, 0], [0] * 10], "-": [[0] * 10] * 3}}
    again = {"x": {"+": {0: [9] * 10}, "-": {0: [0] * 10}}}
    genome = spark.createDataFrame([("x", 0, "A" * 25)], "name string, seq_ord long, sequence string")
    got = annotate(genome, predictor(first), 10, predictor(again)).collect()
    assert [[tuple(c) for c in r.cds] for r in got] == [[(17, 19)]]


def test_durations():
    assert [duration(s) for s in (0.2, 59.6, 3600, 3725)] == ["0s", "1m", "1h", "1h 2m 5s"]


def test_transition_graph():
    for chain in (1, 2, 3):
        for options in ({}, {"starts": True}, {"skips": True}, {"loop": True}, {"starts": True, "skips": True, "loop": True}):
            a = hmm.matrix(hmm.transition_edges(chain, **options), chain)
            assert a.shape == (12 + 3 * chain,) * 2 and np.allclose(a.sum(axis=1), 1)
    logit = lambda p: np.log(p / (1 - p))
    a = hmm.three_parameter_matrix(logit(0.9999), logit(0.99), logit(0.975))
    b = hmm.matrix(hmm.transition_edges())
    assert np.allclose(a, b, atol=1e-9) and np.allclose(a[0, 0], 0.9999)
    assert hmm.state_names(2)[:7] == ["IR", "I00", "I10", "I20", "I01", "I11", "I21"]


def test_emissions():
    left, right = hmm.emission_tables()
    assert left.shape == right.shape == (15, 65) and np.allclose(left.sum(axis=1), 1) and np.allclose(right.sum(axis=1), 1)
    stop = hmm.TRIPLETS.index("TAA")
    assert right[6, stop] == 0 and right[9, stop] == 0 and right[14, stop] > 0 and left[7, hmm.TRIPLETS.index("ATG")] == 1
    begin, end = hmm.soft_triplets("ATGN")
    assert begin[0, hmm.TRIPLETS.index("ATG")] == 1 and end[2, hmm.TRIPLETS.index("ATG")] == 1 and np.allclose(begin[:, :64].sum(axis=1), 1)
    with pytest.raises(ValueError):
        hmm.triplet_weights([("ATG", 0.5)])
    assert hmm.repeat_table(0.1).tolist()[0] == [1, 1] and hmm.repeat_table(0.1)[5, 1] == 0.1
    assert hmm.emission_init(2).shape == (1, 18, 15)
    plain, scaled = (hmm.GeneModel.usual(border_factor=f).emissions("ccATGcatgtaacgtacag") for f in (None, 0.5))
    ratio = np.divide(scaled, plain, out=np.ones_like(plain), where=plain > 0)
    # Start codons count where they begin and stop codons where they end, in masked letters only.
    assert ratio[2, 7] == 1 and ratio[6, 7] == 0.5 and ratio[11, 14] == 0.5 and ratio[13, 8] == 0.5 and ratio[18, 11] == 0.5
    assert np.all(ratio[:, :7] == 1) and ratio.min() == 0.5 and ratio.max() == 1


def test_decoding_against_all_paths():
    from itertools import product

    model = hmm.GeneModel.usual(ir=3, intron=3, exon=3)
    seq = "ATGT"
    emit = model.emissions(seq)
    best, total, at = 0, 0, np.zeros((4, 15))
    for path in product(range(15), repeat=4):
        p = model.start[path[0]] * emit[0, path[0]]
        for t in range(1, 4):
            p *= model.transitions[path[t - 1], path[t]] * emit[t, path[t]]
        total += p
        for t, s in enumerate(path):
            at[t, s] += p
        best = max(best, p)
    path = hmm.viterbi(model, seq)
    p = model.start[path[0]] * emit[0, path[0]]
    for t in range(1, 4):
        p *= model.transitions[path[t - 1], path[t]] * emit[t, path[t]]
    assert np.isclose(p, best) and np.allclose(hmm.posterior(model, seq), at / total)


def test_posteriors_of_a_table(spark):
    model = hmm.GeneModel.usual(ir=3, intron=3, exon=3)
    rows = spark.createDataFrame([("a", 0, "ATGTAACC--"), ("a", 1, "----------")], "name string, chunk_no long, chunk string")
    got = hmm.posteriors(rows, model).orderBy("strand", "idx").collect()
    assert [r.strand for r in got] == ["+"] * 8 + ["-"] * 8 and all(abs(sum(r[4:]) - 1) < 1e-9 for r in got)
    assert np.allclose([r[4:] for r in got[:8]], hmm.posterior(model, "ATGTAACC"))
    assert np.allclose([r[4:] for r in got[8:]], hmm.posterior(model, "GGTTACAT")[::-1])


def test_chunks_are_decoded_together_as_alone():
    import random
    import time

    rng = random.Random(5)
    for options in ({}, {"chain": 2}, {"repeat_factor": 0.1, "border_factor": 0.5}, {"ir": 3, "intron": 3, "exon": 3}):
        model = hmm.GeneModel.usual(**options)
        texts = ["".join(rng.choices("ACGTacgtN-\u00e9", k=rng.choice([0, 1, 2, 40, 41]))) for _ in range(60)]
        got = hmm.viterbi_together(model, texts)
        assert all(np.array_equal(a, hmm.viterbi(model, t)) for a, t in zip(got, texts))
    nowhere = replace(model, transitions=np.eye(15)[np.r_[1:15, 0]], start=np.eye(15)[7])  # no path of more than few letters
    assert all(np.array_equal(a, hmm.viterbi(nowhere, t)) for a, t in zip(hmm.viterbi_together(nowhere, texts), texts))
    texts = ["".join(rng.choices("ACGT", k=300)) for _ in range(1000)]
    began = time.process_time()
    hmm.viterbi_together(model, texts)
    together = time.process_time() - began
    for t in texts[:250]:
        hmm.viterbi(model, t)
    assert time.process_time() - began - together > together  # four times as many took no longer


def test_a_planted_gene_is_found_on_both_strands(spark):
    gene = "ATG" + "CCA" * 40 + "TAA"
    text = "CCTTCA" * 20 + gene + "CCTTCA" * 20
    model = replace(hmm.GeneModel.usual(ir=20, intron=100, exon=60), start=np.eye(15)[0])
    path = hmm.viterbi(model, text)
    assert path[0] == 0 and path[120] == 7 and path[120 + len(gene) - 1] == 14
    back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([("a", 0, text), ("b", 0, back)], "name string, chunk_no long, chunk string")
    got = {(r.seq, r.strand): r.states for r in hmm.decode(rows, model).collect()}
    assert got["a", "+"] == path.tolist() and got["b", "-"] == path[::-1].tolist()


def test_penalties(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 1.0), (1.0, 0.0, 0.0)], "p0 double, p1 double, repeat double")
    assert abs(hmm.uncertainty_penalty(rows).first().penalty - np.log(2) * 0.5 / 2) < 1e-6
    assert hmm.repeat_penalty(rows, 1).first().penalty == 0.25
    a = np.array([hmm.matrix(hmm.transition_edges())])
    assert abs(hmm.intron_penalty(a, [0.9]) - 0.09) < 1e-9 and abs(hmm.loop_ratio_penalty(a) - (0.9999 / 0.99 - 1)) < 1e-9
