"""Hidden Markov model of gene structure in log space: transition graphs, codon emissions, Viterbi and posterior decoding.

States are intergenic (IR), introns of three frames (a chain of ``chain`` states each), exons of three frames, start, borders
of introns (EI, IE) and stop.  Decoding (Rabiner 1989) is sequential along a chunk, so each chunk is one row of an Arrow batch, and
the chunks of a batch take each step together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codons import start_codons, stop_codons
from ..functions.nucleotides import complement

BASES = "ACGT"
TRIPLETS = ["".join(t) for t in product(BASES, repeat=3)]
NOTHING = -1e30

# Patterns at intron borders and the usual state lengths.
INTRON_BEGIN, INTRON_END = (("GTN", 0.99), ("GCN", 0.01)), (("NAG", 1.0),)
LENGTHS = {"ir": 0.9999, "intron": 0.99, "exon": 0.975}


def state_names(chain: int = 1) -> list[str]:
    introns = [f"I{frame}{link}" for link in range(chain) for frame in range(3)]
    return ["IR", *introns, "E0", "E1", "E2", "START", "EI0", "EI1", "EI2", "IE0", "IE1", "IE2", "STOP"]


def _odds(stay: float) -> float:
    """Odds of staying, from a probability or an expected length above 1."""
    length = 1 / (1 - stay) if stay < 1 else stay
    return length - 1


def transition_edges(chain: int = 1, ir: float = LENGTHS["ir"], intron: float | list[float] = LENGTHS["intron"], exon: float = LENGTHS["exon"], starts: bool = False, skips: bool = False, loop: bool = False, links: bool = True) -> list[tuple[str, str, float]]:
    """(from, to, weight); weights of one state are relative to each other.

    starts: introns may begin at any link; skips: they may end at any; loop: the last link leads back to the first;
    links: successive links are connected.
    """
    stays = [intron] * chain if isinstance(intron, (int, float)) else list(intron)
    out = [("IR", "IR", _odds(ir)), ("IR", "START", 1.0), ("START", "E1", 1.0), ("E1", "STOP", 0.5), ("STOP", "IR", 1.0)]
    for frame in range(3):
        out.append((f"E{frame}", f"E{(frame + 1) % 3}", _odds(exon)))
        out.append((f"E{frame}", f"EI{frame}", 0.5 if frame == 1 else 1.0))
        out.append((f"IE{frame}", f"E{frame}", 1.0))
        for link in range(chain):
            here, last = f"I{frame}{link}", link == chain - 1
            out.append((here, here, _odds(stays[link])))
            if links and not last:
                out.append((here, f"I{frame}{link + 1}", 0.5 if skips else 1.0))
            if last or skips:
                out.append((here, f"IE{frame}", 0.5 if (loop if last else links) else 1.0))
            if link == 0 or starts:
                out.append((f"EI{frame}", here, 1 / chain if starts else 1.0))
            if last and loop:
                out.append((here, f"I{frame}0", 0.5))
    return out


def matrix(edges: list[tuple[str, str, float]], chain: int = 1) -> np.ndarray:
    """Transition probabilities; weights to one target add up."""
    place = {n: k for k, n in enumerate(state_names(chain))}
    out = np.zeros((len(place), len(place)))
    for a, b, w in edges:
        out[place[a], place[b]] += w
    return out / out.sum(axis=1, keepdims=True)


def three_parameter_matrix(ir: float, intron: float, exon: float, delta: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """Transitions from three logits of staying, shifted by ``delta`` (as an input-dependent scorer would)."""
    p = [1 / (1 + math.exp(-(x + d))) for x, d in zip((ir, intron, exon), delta)]
    edges = [("IR", "IR", p[0]), ("IR", "START", 1 - p[0]), ("START", "E1", 1.0), ("STOP", "IR", 1.0)]
    for f in range(3):
        leave = (1 - p[2]) / (2 if f == 1 else 1)
        edges += [(f"I{f}0", f"I{f}0", p[1]), (f"I{f}0", f"IE{f}", 1 - p[1]), (f"E{f}", f"E{(f + 1) % 3}", p[2]), (f"E{f}", f"EI{f}", leave)]
        edges += [(f"EI{f}", f"I{f}0", 1.0), (f"IE{f}", f"E{f}", 1.0)]
    return matrix([*edges, ("E1", "STOP", (1 - p[2]) / 2)])


def triplet_weights(codons) -> np.ndarray:
    """Distribution over the 64 triplets from patterns with N."""
    total = sum(p for _, p in codons)
    if abs(total - 1) > 1e-9 or any(len(c) != 3 or not 0 <= p <= 1 for c, p in codons):
        raise ValueError("codon probabilities are no distribution")
    out = np.zeros(64)
    for pattern, p in codons:
        fit = np.array([all(x in ("N", y) for x, y in zip(pattern, t)) for t in TRIPLETS])
        out += p * fit / fit.sum()
    return out


def emission_tables(starts=None, stops=None, begins=INTRON_BEGIN, ends=INTRON_END, chain: int = 1, table: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights of states for the triplet that begins at a position and for the one that ends there; column 64 stands for any.

    Free states take any triplet.  Exon state 2 and border EI1 complete a codon and must not complete a stop.
    """
    any_, start, stop = np.full(64, 1 / 64), triplet_weights(starts or start_codons(table)), triplet_weights(stops or stop_codons(table))
    no_stop = any_ * (stop == 0)
    no_stop /= no_stop.sum()
    begin, end = triplet_weights(begins), triplet_weights(ends)
    bound_left = {"START": start, "EI0": begin, "EI1": begin, "EI2": begin}
    bound_right = {"E2": no_stop, "EI1": no_stop, "IE0": end, "IE1": end, "IE2": end, "STOP": stop}

    def rows(bound: dict[str, np.ndarray]) -> np.ndarray:
        free = np.r_[np.zeros(64), 1.0]
        unbound = {"IR", "E0", "E1", *(n for n in state_names(chain) if re.fullmatch(r"I[0-9]+", n))}
        return np.array([free if n in unbound else np.r_[bound.get(n, any_), 0.0] for n in state_names(chain)])

    return rows(bound_left), rows(bound_right)


def repeat_table(factor: float, chain: int = 1) -> np.ndarray:
    """Weights of states outside and inside of masked repeats: coding states are scaled by ``factor`` within."""
    inside = np.r_[np.ones(1 + 3 * chain), np.full(11, factor)]
    return np.c_[np.ones_like(inside), inside]


def soft_triplets(seq: str) -> tuple[np.ndarray, np.ndarray]:
    """For each position the distribution of the triplet beginning there and of that ending there; unknown bases are uniform.

    The last column is 1/64 throughout.
    """
    hard = np.array([BASES.find(c) for c in seq.upper()], int)
    soft = np.where((hard >= 0)[:, None], np.eye(4)[np.maximum(hard, 0)], 0.25)
    padded = np.vstack([np.full((2, 4), 0.25), soft, np.full((2, 4), 0.25)])
    triple = np.einsum("ta,tb,tc->tabc", padded[:-2], padded[1:-1], padded[2:]).reshape(-1, 64)
    triple = np.hstack([triple, np.full((len(triple), 1), 1 / 64)])
    return triple[2:], triple[: len(seq)]


@dataclass(frozen=True)
class GeneModel:
    """Everything decoding needs; small enough to travel with the function."""

    transitions: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    repeat_factor: float | None = None
    border_factor: float | None = None

    @staticmethod
    def usual(chain: int = 1, table: int = 1, repeat_factor: float | None = None, border_factor: float | None = None, **lengths) -> GeneModel:
        left, right = emission_tables(chain=chain, table=table)
        n = len(state_names(chain))
        return GeneModel(matrix(transition_edges(chain, **lengths), chain), left, right, np.full(n, 1 / n), repeat_factor, border_factor)

    def _at_borders(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By position and state: the share of triplets that fit a border state, scaled by ``border_factor``, the rest as it is.

        A triplet fits the states whose weights single it out, that is start codon and intron begin by the triplet that begins
        at a position, stop codon and intron end by the one that ends there.
        """
        out = np.ones((len(begin), len(self.start)))
        for triplets, table in ((begin, self.left), (end, self.right)):
            special = (table[:, :64] > 0).any(axis=1) & ((table[:, :64] > 0).sum(axis=1) < 40)
            fitting = triplets[:, :64] @ (table[special, :64] > 0).T
            out[:, special] *= 1 - fitting * (1 - self.border_factor)
        return out

    def emissions(self, seq: str) -> np.ndarray:
        begin, end = soft_triplets(seq)
        out = (begin @ self.left.T) * (end @ self.right.T)
        if self.repeat_factor is not None:
            masked = np.array([c.islower() for c in seq], int)
            out = out * repeat_table(self.repeat_factor, (len(self.start) - 12) // 3)[:, masked].T
        if self.border_factor is not None:
            masked = np.array([c.islower() for c in seq], bool)[:, None]
            out = out * np.where(masked, self._at_borders(begin, end), 1.0)
        return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.maximum(x, 1e-300)), NOTHING)


def viterbi(model: GeneModel, seq: str) -> np.ndarray:
    """Most likely states; of equally likely ones the lowest."""
    if not seq:
        return np.zeros(0, int)
    emit, move = _log(model.emissions(seq)), _log(model.transitions)
    best, back = _log(model.start) + emit[0], np.zeros((len(seq), len(move)), np.int16)
    for t in range(1, len(seq)):
        reach = best[:, None] + move
        back[t] = reach.argmax(axis=0)
        best = reach.max(axis=0) + emit[t]
    path = [int(best.argmax())]
    for t in range(len(seq) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


#: Letters of chunks that take their steps together.
TOGETHER = 300_000


@dataclass(frozen=True)
class Steps:
    """What many chunks share: log emissions by the five letters around a position, and the sources of each state."""

    order: np.ndarray  # states in the order of the rows here: those with one source, then those with more
    emit: np.ndarray  # (2 * 5^5, states): letters in upper case, then with the middle one in lower case
    start: np.ndarray
    single: tuple[np.ndarray, np.ndarray]  # row of the one source, log of its transition
    several: tuple[np.ndarray, np.ndarray]  # (k, states) rows of the sources by falling preference, logs

    @staticmethod
    def of(model: GeneModel) -> Steps:
        windows = ["".join(w) for w in product(BASES + "N", repeat=5)]
        lower = [w[:2] + w[2].lower() + w[3:] for w in windows]
        emit = _log(np.vstack([model.emissions("".join(ws))[2::5] for ws in (windows, lower)]))
        move = _log(model.transitions)
        sources = [np.flatnonzero(model.transitions[:, j] > 0) for j in range(len(move))]
        # A state without any source is reached from all of them alike.
        sources = [x if len(x) else np.arange(len(move)) for x in sources]
        order = np.array(sorted(range(len(move)), key=lambda j: len(sources[j]) > 1), int)
        row = np.argsort(order)
        ones, more = ([j for j in order if (len(sources[j]) > 1) == many] for many in (False, True))
        first = np.array([sources[j][0] for j in ones], int)
        most = max((len(sources[j]) for j in more), default=0)
        # A source that is repeated to fill a column never wins over itself.
        table = np.array([[sources[j][min(k, len(sources[j]) - 1)] for j in more] for k in range(most)], int).reshape(most, len(more))
        return Steps(order, np.ascontiguousarray(emit[:, order]), _log(model.start)[order], (row[first], move[first, ones][:, None]), (row[table], move[table, more][:, :, None]))


def _letter_codes() -> np.ndarray:
    out = np.full(256, 4, np.int16)
    for k, c in enumerate(BASES):
        out[ord(c)] = out[ord(c.lower())] = k
    return out


LETTER_CODES, LOWER = _letter_codes(), np.array([chr(b).islower() and b < 128 for b in range(256)])


def _letters(seq: str) -> bytes:
    """One byte a letter: what is not ASCII is unknown, in its case."""
    return seq.encode() if seq.isascii() else "".join(c if c.isascii() else "n" if c.islower() else "N" for c in seq).encode()


def _places(letters: np.ndarray) -> np.ndarray:
    """(chunks, letters) as columns of ``Steps.emit``."""
    codes = np.pad(LETTER_CODES[letters], ((0, 0), (2, 2)), constant_values=4)
    n = letters.shape[1]
    out = np.zeros(letters.shape, np.int16)
    for k in range(5):
        out = out * 5 + codes[:, k : k + n]
    return out + 5**5 * LOWER[letters]


def viterbi_together(model: GeneModel, seqs: list[str], steps: Steps | None = None) -> list[np.ndarray]:
    """``viterbi`` of many sequences, the longest first, so that those not at their end are the first columns."""
    steps = steps or Steps.of(model)
    order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(seqs)
    while order and seqs[order[0]]:
        block = order[: max(1, TOGETHER // len(seqs[order[0]]))]
        order = order[len(block) :]
        texts = [t for t in (_letters(seqs[k]) for k in block) if t]
        for k, path in zip(block, _paths(steps, texts)):
            out[k] = path if path is not None else viterbi(model, seqs[k])
    return out


def _paths(steps: Steps, texts: list[bytes]) -> Iterator[np.ndarray | None]:
    """Paths of texts by falling length; None where no path is possible, for then what stands for minus infinity decides."""
    ends, n = np.array([len(t) for t in texts]), len(steps.start)
    letters = np.frombuffer(b"".join(t.ljust(ends[0], b"N") for t in texts), np.uint8).reshape(len(texts), ends[0])
    places = np.ascontiguousarray(_places(letters).T)
    (first, alone), (table, moves) = steps.single, steps.several
    one, most = len(first), len(table)
    back = np.empty((ends[0], n, len(texts)), np.int8 if n < 128 else np.int16)
    back[:, :one] = first[:, None]
    sources = table[:, :, None].astype(back.dtype)
    counts = len(texts) - np.searchsorted(ends[::-1], np.arange(ends[0]), side="right")  # texts that have a letter there
    best = steps.start[:, None] + steps.emit[places[0]].T
    for t in range(1, ends[0]):
        c = counts[t]
        here, follow = best[:, :c], np.empty((n, c))
        np.add(here[first], alone, out=follow[:one])
        if most:
            top, source = follow[one:], back[t, one:, :c]
            np.add(here[table[0]], moves[0], out=top)
            source[:] = sources[0]
            for k in range(1, most):
                reach = here[table[k]] + moves[k]
                np.copyto(source, sources[k], where=reach > top)
                np.maximum(top, reach, out=top)
        follow += steps.emit[places[t, :c]].T
        if c == len(texts):
            best = follow
        else:
            best[:, :c] = follow
    by_state = best[np.argsort(steps.order)]
    possible = by_state.max(axis=0) > NOTHING / 2
    state, columns = np.argsort(steps.order)[by_state.argmax(axis=0)], np.arange(len(texts))
    paths = np.zeros((ends[0], len(texts)), np.int32)
    for t in range(ends[0] - 1, -1, -1):
        c = counts[t]
        paths[t, :c] = state[:c]
        if t:
            state[:c] = back[t, state[:c], columns[:c]]
    paths = np.ascontiguousarray(steps.order.astype(np.int32)[paths].T)
    return (paths[k, : ends[k]] if possible[k] else None for k in range(len(texts)))


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posterior(model: GeneModel, seq: str) -> np.ndarray:
    """Probability of each state at each position, by forward and backward sums."""
    n = len(model.start)
    if not seq:
        return np.zeros((0, n))
    emit, move = _log(model.emissions(seq)), _log(model.transitions)
    ahead, behind = np.zeros((len(seq), n)), np.zeros((len(seq), n))
    ahead[0] = _log(model.start) + emit[0]
    for t in range(1, len(seq)):
        ahead[t] = _sum(ahead[t - 1][:, None] + move, 0) + emit[t]
    for t in range(len(seq) - 2, -1, -1):
        behind[t] = _sum(move + (emit[t + 1] + behind[t + 1])[None, :], 1)
    joint = ahead + behind
    return np.exp(joint - _sum(joint, 1)[:, None])


def decode(chunks: DataFrame, model: GeneModel, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(seq, strand, chunk_no, states) of ``chunks(name, chunk_no, chunk)``.

    The minus strand is read as reverse complement and its states are turned back.  Padding is cut off.  With longer chains
    introns of all links are one state of their frame.  Chunks are dealt evenly, however few files or sequences they come from.
    """
    chain = (len(model.start) - 12) // 3
    plain = np.array([0, *[1 + k % 3 for k in range(3 * chain)], *range(4, 15)], np.int32)
    steps = Steps.of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            paths = viterbi_together(model, [s or "" for s in rows.column("oriented").to_pylist()], steps)
            paths = [x[::-1] if strand == "-" else x for x, strand in zip(paths, rows.column("strand").to_pylist())]
            ends = np.cumsum([0, *map(len, paths)])
            states = plain[np.concatenate(paths)] if paths else plain[:0]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(states, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("seq", "strand", "chunk_no")), found], ["seq", "strand", "chunk_no", "states"])

    return _oriented(chunks.repartition("name", "chunk_no"), strands).mapInArrow(run, "seq string, strand string, chunk_no long, states array<int>")


def posteriors(chunks: DataFrame, model: GeneModel, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(seq, strand, chunk_no, idx, p0, p1, ...) of ``chunks(name, chunk_no, chunk)``: the probability of each state at each position.

    Rows are those of the sequence from left to right on both strands; padding is cut off.
    """
    names = [f"p{k}" for k in range(len(model.start))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                p = posterior(model, r.oriented)
                out = pd.DataFrame(p[::-1] if r.strand == "-" else p, columns=names)
                yield out.assign(seq=r.seq, strand=r.strand, chunk_no=r.chunk_no, idx=range(len(out)))[["seq", "strand", "chunk_no", "idx", *names]]

    return _oriented(chunks, strands).mapInPandas(run, "seq string, strand string, chunk_no long, idx long, " + ", ".join(f"{n} double" for n in names))


def _oriented(chunks: DataFrame, strands: tuple[str, ...]) -> DataFrame:
    letters = F.rtrim(F.translate("chunk", "-", " "))
    rows = chunks.select(F.col("name").alias("seq"), F.col("chunk_no").cast("long").alias("chunk_no"), letters.alias("chunk"), F.explode(F.array(*map(F.lit, strands))).alias("strand"))
    oriented = F.when(F.col("strand") == "-", complement(F.col("chunk"), reverse=True)).otherwise(F.col("chunk"))
    return rows.select("seq", "strand", "chunk_no", oriented.alias("oriented"))


def emission_init(chain: int = 1, heads: int = 1, classes: int = 15) -> np.ndarray:
    """Emissions of class streams, (heads, states, classes): a state and its class agree; links of a chain share theirs."""
    plain = [0, *[1 + k % 3 for k in range(3 * chain)], *range(4, 15)]
    return np.tile(np.eye(15)[plain][:, :classes], (heads, 1, 1))


def uncertainty_penalty(posteriors: DataFrame, background: str = "p0", weight: float = 1.0) -> DataFrame:
    """One row (penalty): mean of entropy times (1 - background) over rows of state probabilities ``p0, p1, ...``."""
    columns = [c for c in posteriors.columns if c.startswith("p")]
    entropy = -sum(F.col(c) * F.log(F.col(c) + 1e-8) for c in columns)
    return posteriors.agg((weight * F.avg(entropy * (1 - F.col(background)))).alias("penalty"))


def repeat_penalty(posteriors: DataFrame, first_coding: int, repeat: str = "repeat", weight: float = 1.0) -> DataFrame:
    """One row (penalty): mean of repeat times the probability of coding states."""
    coding = sum(F.col(c) for c in posteriors.columns if c.startswith("p") and int(c[1:]) >= first_coding)
    return posteriors.agg((weight * F.avg(F.col(repeat) * coding)).alias("penalty"))


def intron_penalty(transitions: np.ndarray, start_values: list[float], chain: int = 1, weight: float = 1.0) -> float:
    """Sum over heads of how far the mean intron loop is from its start value."""
    return weight * sum(abs(v - np.diag(a)[1 : 1 + 3 * chain].mean()) for a, v in zip(transitions, start_values))


def loop_ratio_penalty(transitions: np.ndarray, chain: int = 1, weight: float = 1.0) -> float:
    """Mean over heads of max/min - 1 of the intergenic loop and the loop of the last intron link."""
    p, q = transitions[:, 0, 0], transitions[:, 1 + 3 * (chain - 1), 1 + 3 * (chain - 1)]
    return weight * float((np.maximum(p, q) / np.minimum(p, q) - 1).mean())
