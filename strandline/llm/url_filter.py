"""URL verdicts: longest matching host and path rule, else logistic regression on hashed character n-grams.

Features and scores are Spark SQL expressions.  The labelled table is small (``MAX_LABELLED`` rows at most), so its gradient
descent runs on the driver; the weights, a fixed number of them, enter the plan as one literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES, MAX_LABELLED = 2048, (3, 4), 10_000
STEPS, RATE, DECAY = 300, 0.5, 1e-3

# Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Site names of the labelled URL table.
BLOCKED_SITES = (
    "casino-royal casino-win best-casino online-casino casino-slots free-casino-chips free-bets free-bets-now sports-bets bets-win-big betting-tips live-betting free-spins win-prizes jackpot-slots "
    "poker-bonus lottery-winner cheap-pills buy-pills-online diet-pills cheap-meds-online pharmacy-discount cheap-watches replica-bags fast-loans payday-loan-cash instant-credit-cash "
    "adult-chat xxx-video hot-singles-chat free-crack-keygen warez-download cracked-games serial-keys free-followers make-money-fast crypto-doubler click-and-win win-a-phone miracle-weight-loss"
).split()
ALLOWED_SITES = (
    "gardening news library university recipes museum weather bookstore wikipedia city-council health forum travel research school open-source history daily-times mathematics physics-today "
    "chess-club orchestra theatre railways fire-brigade parliament national-archive botanic-garden birdwatching cycling mountaineering photography local-history village-church knitting "
    "woodworking astronomy geology chemistry-lessons language-school translation dictionary poetry novels literature philosophy law-journal medicine nursing veterinary farming fisheries "
    "architecture engineering software python-docs databases statistics economics trade-union consumer-advice public-transport airport harbour hospital kindergarten sports-club football "
    "athletics swimming rowing cooking bakery vineyard brewery restaurant hotel camping national-park climate energy recycling tailor furniture hardware-store music-lessons film-festival"
).split()
BLOCKED_PATHS, ALLOWED_PATHS = ("play", "bonus", "buy-now", "free.html", "12", "claim?id=9", "win", "77.html"), ("index.html", "about", "2020/05", "articles/12", "", "contact.html", "8423", "archive?page=2")


def _urls(sites: list[str], paths: tuple[str, ...], label: int) -> list[tuple[str, int]]:
    parts = lambda k: ("s" * (k % 2), ("", "www.", "m.", "blog.")[k % 4], ("com", "org")[k // 2 % 2], ("en", "fr", "de", "es")[k // 3 % 4])
    return [("http{}://{}{}.example.{}/{}/".format(*parts(k)[:2], site, *parts(k)[2:]) + paths[k % len(paths)], label) for k, site in enumerate(sites)]


#: The labelled URL table, as url and 1 for block.
LABELLED = tuple(_urls(BLOCKED_SITES, BLOCKED_PATHS, 1) + _urls(ALLOWED_SITES, ALLOWED_PATHS, 0))


def labelled_table(table: DataFrame, url: str = "url", label: str = "label") -> tuple[tuple[str, int], ...]:
    """A labelled table of at most ``MAX_LABELLED`` rows as an argument of ``url_verdicts``; rows with nulls are left out."""
    rows = table.select(F.col(url).alias("url"), F.col(label).cast("int").alias("label")).where("url IS NOT NULL AND label IS NOT NULL").distinct()
    got = rows.limit(MAX_LABELLED + 1).collect()
    if len(got) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    return tuple(sorted((r.url, r.label) for r in got))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for strings without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def gram_buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path, each padded with a blank on both sides."""

    def of(mark: str, text: Column) -> list[Column]:
        # Characters once as an array: looking a place up in a string takes time in proportion to the place.
        letters = F.split(F.concat(F.lit(" "), text, F.lit(" ")), "")

        def grams(n: int) -> Column:
            def all_of(xs: Column) -> Column:
                places = F.sequence(F.lit(0), F.size(xs) - n)
                return F.when(F.size(xs) >= n, F.transform(places, lambda i: F.concat(F.lit(mark), *(F.get(xs, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))

            return F.get(F.transform(F.array(letters), all_of), F.lit(0))

        return [grams(n) for n in SIZES]

    every = F.concat(*of("h", host), *of("p", path))
    return F.array_distinct(F.transform(every, lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")))


def buckets_of(url: str) -> list[int]:
    """The same for one URL of the labelled table."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url)
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    grams = [m + f" {t} "[i : i + n] for m, t in (("h", host), ("p", path)) for n in SIZES for i in range(len(t) + 3 - n)]
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % BUCKETS for g in grams})


@cache
def train(labelled: tuple[tuple[str, int], ...] = LABELLED) -> tuple[tuple[float, ...], float]:
    """Weights and intercept by gradient descent with weight decay; every step takes the whole table.

    Inputs are scaled by the root of their number.  An empty table gives zero weights, whose verdict is allow.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    rows = [(buckets_of(u), y) for u, y in labelled]
    weights, intercept = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS):
        gradient, shift = [DECAY * w for w in weights], 0.0
        for buckets, y in rows:
            scale = 1 / math.sqrt(max(1, len(buckets)))
            error = (1 / (1 + math.exp(-intercept - scale * sum(weights[b] for b in buckets))) - y) / len(rows)
            shift += error
            for b in buckets:
                gradient[b] += error * scale
        weights = [w - RATE * 10 * g for w, g in zip(weights, gradient)]
        intercept -= RATE * shift
    return tuple(round(w, 9) for w in weights), round(intercept, 9)


def held_out_accuracy(labelled: tuple[tuple[str, int], ...] = LABELLED, folds: int = 5) -> tuple[float, float]:
    """Share of URLs that a model of the other folds judges right, and that of always giving the commoner verdict."""
    right = 0
    for fold in range(folds):
        weights, intercept = train(tuple(x for k, x in enumerate(labelled) if k % folds != fold))
        for url, label in labelled[fold::folds]:
            b = buckets_of(url)
            right += (intercept + sum(weights[x] for x in b) / math.sqrt(max(1, len(b))) > 0) == bool(label)
    good = sum(label for _, label in labelled) / len(labelled)
    return right / len(labelled), max(good, 1 - good)


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (like ``net/``, null if none fits), verdict (block or allow).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones the
    first in order of text.  A null url has empty host and path, fits no rule and is judged by the model like any other.
    Repeated rows are judged each; an empty table gives none; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((F.col("host") == rule_host) | F.endswith("host", F.lit("." + rule_host))) & F.startswith("path", F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    weights, intercept = train(tuple(labelled))
    table = F.array(*map(F.lit, weights))  # literals only, so the optimizer makes it one constant
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)

    def score(buckets: Column) -> Column:
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
        return F.lit(intercept) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))

    # Only pages without a rule are scored; the one-element array binds their buckets once.
    judged = F.transform(F.array(gram_buckets(F.col("host"), F.col("path"))), lambda b: F.when(score(b) > 0, "block").otherwise("allow"))[0]
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("ruled").isNotNull(), F.col("ruled")).otherwise(judged).alias("verdict"))
