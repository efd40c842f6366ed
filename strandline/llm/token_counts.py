"""Count-only Viterbi segmentation by a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches that end at each character; dynamic programming carries the best
score and the piece count, never the pieces.  Ties go to the earliest start, as in the public unigram tokenizers, which update
a position only for a strictly better score while starts increase.  A character with no piece of its own is unknown (least
score minus 10); runs of unknowns are fused and fall back to their bytes.  Texts get a leading word mark, blanks become marks.

No piece has a mark after another character and scores are whole numbers, so the best segmentation of a text is that of its
segments (from one run of marks to the next), and sums are exact.  A task keeps counts of up to ``CACHE`` distinct segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        self.scores = {p: s for p, s in pieces}
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.unknown_piece = pieces[unknown_id][0]
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == self.unknown_piece))
        self.automaton.make_automaton()
        self.longest = max(1, *(len(p) for p, _ in pieces))
        alphabet = {c for p in self.scores for c in p}
        lonely = {c for c in alphabet if c not in self.scores}
        whole = all(float(s).is_integer() for _, s in pieces) and all(MARK not in p.lstrip(MARK) for p in self.scores)
        self.bytes_known = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        # Newlines that are in no piece are always unknown and can be cut off, unless other unknowns could fuse with them.
        cut_lines = "\n" not in alphabet and not lonely
        self.segments = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if cut_lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if whole else re.compile(r"[\s\S]+")
        self.cache: dict[str, int] = {}

    def _run(self, text: str) -> int:
        """Pieces of a fused run of unknowns."""
        return 1 if text in self.scores or not self.bytes_known else len(text.encode())

    def segment(self, text: str) -> int:
        """Pieces of a segment.  Only the positions that a piece can still begin at are kept, whatever the segment's length."""
        window = self.longest + 1
        best, count, run = [0.0] * window, [0] * window, [-1] * window  # run: where an open run of unknowns began
        matches = self.automaton.iter(text)
        ahead = next(matches, None)
        for end in range(1, len(text) + 1):
            found = []
            while ahead is not None and ahead[0] < end:
                found.append(ahead[1])
                ahead = next(matches, None)
            found.sort(key=lambda f: -f[0])
            top, chosen = None, None
            for f in found:
                score = best[(end - f[0]) % window] + f[1]
                if top is None or score > top:
                    top, chosen = score, f
            if not found or found[-1][0] > 1:
                score = best[(end - 1) % window] + self.unknown_score
                if top is None or score > top:
                    top, chosen = score, (1, 0.0, True)
            start, here = end - chosen[0], end % window
            before, began = count[start % window], run[start % window]
            if chosen[2]:
                best[here], count[here], run[here] = top, before, began if began >= 0 else start
            else:
                best[here], count[here], run[here] = top, before + 1 + (self._run(text[began:start]) if began >= 0 else 0), -1
        last = len(text) % window
        return count[last] + (self._run(text[run[last] :]) if run[last] >= 0 else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, cache = 0, self.cache
        for piece in self.segments.findall(MARK + text.replace(" ", MARK)):
            try:
                total += cache[piece]
            except KeyError:
                if len(cache) >= CACHE:
                    cache.clear()
                n = self.segment(piece)
                if len(piece) < 200:
                    cache[piece] = n
                total += n
        return total


def vocabulary_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return count


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens.

    Null and empty texts have 0 tokens.  Repeated rows and rows without doc_id are counted each; an empty table gives none;
    other columns are not read.  The vocabulary is broadcast: its size is fixed.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_counter(shared), "doc_id long, n_tokens long")
