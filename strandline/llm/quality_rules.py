"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or an they which one "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei "
    "le la les et des en un une du dans que est pour qui sur pas au plus par ce il ne se "
    "el los las y que del se por con para una su lo como más pero sus al o este"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text if ``low <= metric <= high``; metric is SQL over the columns of ``text_metrics``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        parts = ([f"{self.metric} >= {self.low!r}"] if self.low is not None else []) + ([f"{self.metric} <= {self.high!r}"] if self.high is not None else [])
        return "(" + " AND ".join(parts) + ")"


#: The base rules fail a text by themselves; integers on both sides keep the comparison exact.
BASE_RULES = (Rule("enough_words", "n_words", low=50), Rule("little_repetition", "100 * n_repeat_words - 50 * n_words", high=0))
RULES = (
    Rule("word_length_low", "word_chars - 2 * n_words", low=0),
    Rule("word_length_high", "word_chars - 14 * n_words", high=0),
    Rule("symbols", "10 * n_symbols - n_words", high=0),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("repeated_lines", "10 * (n_dup_lines - 1) - 3 * n_lines", high=0),  # one repeated title line is nothing odd
    Rule("capitals", "10 * n_capitals - 3 * word_chars", high=0),
    Rule("shouted_words", "10 * n_exclamations - 3 * n_words", high=0),
)

BLANK = r"[\x20\x09-\x0D]+"
#: Bits of a packed window that hold its place; the others hold hash bits.
_PLACE = 26


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are packed as hash and place in one long and sorted, so equal windows are neighbours; neighbours are compared word
    by word.  Should two different windows share hash bits, or the text have too many words to pack, whole windows are sorted.
    """
    last, mask = F.size(w) - 3, F.lit((1 << _PLACE) - 1)
    few = F.size(w) < min(1 << _PLACE, 2**31 - 1)

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))).cast("long")

    def word(p: Column) -> Column:
        return F.get(w, p)

    def window(p: Column) -> Column:
        return F.shiftleft(F.xxhash64(word(p), word(p + 1), word(p + 2)), _PLACE).bitwiseOR(p.cast("long"))

    def by_sorting() -> Column:
        whole = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(word(p).alias("a"), word(p + 1).alias("b"), word(p + 2).alias("c"), p.alias("p"))))

        def same(s: Column) -> Column:
            def equal(k: Column) -> Column:
                x, y = F.get(s, k), F.get(s, k - 1)
                return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

            near = F.filter(F.sequence(F.lit(1), F.size(s) - 1), equal)
            return covered(F.flatten(F.transform(near, lambda k: F.array(F.get(s, k)["p"], F.get(s, k - 1)["p"]))))

        return bound(whole, same)

    def by_hash(packed: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.size(packed) - 1), lambda k: F.shiftright(F.get(packed, k), _PLACE) == F.shiftright(F.get(packed, k - 1), _PLACE))
        place = lambda k: F.get(packed, k).bitwiseAND(mask).cast("int")
        pairs = F.transform(near, lambda k: F.struct(place(k - 1).alias("p"), place(k).alias("q")))

        def judged(pairs: Column) -> Column:
            mixed = F.exists(pairs, lambda x: (word(x["p"]) != word(x["q"])) | (word(x["p"] + 1) != word(x["q"] + 1)) | (word(x["p"] + 2) != word(x["q"] + 2)))
            plain = covered(F.flatten(F.transform(pairs, lambda x: F.array(x["p"], x["q"]))))
            return F.when(F.size(pairs) == 0, F.lit(0).cast("long")).when(mixed, by_sorting()).otherwise(plain)

        return bound(pairs, judged)

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), last), window))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(few, bound(packed, by_hash)).otherwise(by_sorting())


def text_metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the metrics that rules use, one row per row of ``docs``.  A null text is an empty one."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", BLANK, -1), "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))

    def count(kind: str) -> Column:
        return F.length(F.regexp_replace("t", f"[^{kind}]+", "")).cast("long")

    rows = rows.select(
        "doc_id", bound(words, of_words).alias("w"), bound(lines, of_lines).alias("l"), count("#*$%&|<>").alias("n_symbols"), count("A-Z").alias("n_capitals"), count("!").alias("n_exclamations")
    )
    return rows.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_stop_words", "n_capitals", "n_exclamations")


def compiled(rules: tuple[Rule, ...]) -> str:
    return " AND ".join(rule.sql() for rule in rules) or "true"


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, the metrics, base_failed, kept (false if base_failed, else whether all ``rules`` hold).

    A null or empty text has zero metrics and fails the base rules.  Repeated rows and rows without doc_id are judged each; an
    empty table gives none; other columns are not read.
    """
    judged = text_metrics(docs, doc_id, text).withColumn("base_failed", F.expr(f"NOT ({compiled(base)})"))
    return judged.withColumn("kept", F.expr(f"NOT base_failed AND {compiled(rules)}"))
