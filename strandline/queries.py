"""Registered queries of the genome operators on the fixture views, each with the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import SQL, with_views
from .functions import nucleotides as nt
from .functions.codons import STARTS, STOPS, codon_frame, is_codon_distribution
from .operators import bins, checks, comparison, histograms, intervals, labels, repair, sequences, setops, transcripts
from .plans import hmm
from .plans.annotate import annotate
from .sources import block_gzip, fasta_scan, readers, writers
from .tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def block_text(cds: str = "cds") -> Column:
    return F.array_join(F.transform(cds, lambda c: F.concat(c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))), ",")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Positions and ranges

HITS = """hits AS (
  SELECT p.pos_id, t.strand, t.gene, bool_or(c.tx IS NOT NULL) AS is_cds FROM pos p JOIN tx t ON t.seq = p.seq AND p.pos >= t.s AND p.pos < t.e
  LEFT JOIN cds c ON c.tx = t.tx AND p.pos >= c.cds_start AND p.pos < c.cds_end GROUP BY ALL), genes AS (
  SELECT gene, min(s) AS g FROM tx GROUP BY gene), first_gene AS (
  SELECT pos_id, strand, arg_min(CASE WHEN is_cds THEN 'cds' ELSE 'intron' END, g * 1000000 + gene) AS label FROM hits JOIN genes USING (gene) GROUP BY pos_id, strand), both_strands AS (
  SELECT p.pos_id, p.seq, p.pos, coalesce(max(label) FILTER (strand = '+'), 'intergenic') AS fwd, coalesce(max(label) FILTER (strand = '-'), 'intergenic') AS rev
  FROM pos p LEFT JOIN first_gene USING (pos_id) GROUP BY ALL)"""


@query(f"{with_views('cds', 'tx', 'pos')}, {HITS} SELECT * FROM both_strands")
def classify_many(spark, d):
    return intervals.classify_positions(fx.positions(spark, d), fx.transcripts(spark, d))


@query(f"{with_views('cds', 'tx', 'pos')}, {HITS} SELECT fwd, rev, count(*) AS n FROM both_strands GROUP BY fwd, rev")
def classify_label_counts(spark, d):
    return classify_many(spark, d).groupBy("fwd", "rev").agg(F.count("*").alias("n"))


def _ranges(spark) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0), F.lit(50_000), F.lit(5_000)))
    return spark.range(7).select(F.concat(F.lit("chr"), "id").alias("seq"), starts.alias("s")).select(
        F.concat_ws(":", "seq", "s").alias("range_id"), "seq", long("s").alias("range_start"), long(F.col("s") + 700).alias("range_end")
    )


RANGES = """ranges AS (SELECT concat('chr', c, ':', s) AS range_id, concat('chr', c) AS seq, s AS rs, s + 700 AS re FROM range(7) t(c), range(0, 50001, 5000) u(s)), strands(strand) AS (VALUES ('+'), ('-')),
edges AS (SELECT range_id, r.seq, strand, rs AS x FROM ranges r, strands UNION SELECT range_id, r.seq, strand, re FROM ranges r, strands
  UNION SELECT range_id, r.seq, c.strand, unnest([cds_start, cds_end]) FROM ranges r JOIN cds c ON c.seq = r.seq AND c.cds_end >= rs AND c.cds_start <= re),
inside AS (SELECT e.* FROM edges e JOIN ranges USING (range_id) WHERE x BETWEEN rs AND re),
pieces AS (SELECT *, lead(x) OVER (PARTITION BY range_id, strand ORDER BY x) AS seg_end FROM inside),
pos AS (SELECT DISTINCT concat(seq, ':', x) AS pos_id, seq, x AS pos FROM pieces WHERE seg_end IS NOT NULL)"""


@query(
    f"{with_views('cds', 'tx')}, {RANGES}, {HITS} SELECT range_id, q.seq, strand, CASE strand WHEN '+' THEN fwd ELSE rev END AS label, x AS seg_start, seg_end "
    "FROM pieces q JOIN both_strands b ON b.seq = q.seq AND b.pos = x WHERE seg_end IS NOT NULL"
)
def classify_range_segments(spark, d):
    return intervals.classify_ranges(_ranges(spark), fx.transcripts(spark, d))


@query(f"{with_views('cds', 'tx')} SELECT tx, s AS tx_start, e AS tx_end FROM tx WHERE seq = 'chr3' AND s < 20000 AND e > 15000")
def tabix_query(spark, d):
    """One range of an index written for this query, whose smallest bins suit sequences of some ten thousand positions."""
    path = f"{shared_dir(spark)}/binned-{uuid.uuid4().hex}"
    bins.write_binned(transcripts.extents(fx.transcripts(spark, d)).select("seq", "tx", "tx_start", "tx_end"), path, shift=7)
    return bins.overlapping_binned(spark.read.parquet(path), "chr3", 15_000, 20_000, shift=7).select("tx", "tx_start", "tx_end")


# Transcripts and genes


@query(f"{with_views('cds', 'tx')} SELECT tx, s AS tx_start, e AS tx_end, CAST(len AS BIGINT) AS cds_length, n AS n_blocks, blocks FROM tx")
def transcript_extent(spark, d):
    return transcripts.extents(fx.transcripts(spark, d)).select("tx", "tx_start", "tx_end", "cds_length", "n_blocks", block_text().alias("blocks"))


@query(f"{with_views('cds')} SELECT tx, string_agg(gap, ',' ORDER BY cds_start) AS gaps FROM (SELECT tx, cds_start, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) - cds_end AS gap FROM cds) WHERE gap IS NOT NULL GROUP BY tx")
def intron_lengths(spark, d):
    gaps = F.transform(transcripts.intron_lengths(F.col("cds")), lambda x: x.cast("string"))
    return fx.transcripts(spark, d).where(F.size("cds") > 1).select("tx", F.array_join(gaps, ",").alias("gaps"))


@query(f"{with_views('cds', 'tx')} SELECT seq, strand, gene, min(s) AS gene_start, max(e) AS gene_end, count(*) AS n_transcripts FROM tx GROUP BY ALL")
def gene_extent(spark, d):
    return transcripts.gene_extents(fx.transcripts(spark, d))


@query(f"{with_views('cds', 'tx')} SELECT gene, tx, CAST(len AS BIGINT) AS cds_length FROM tx QUALIFY row_number() OVER (PARTITION BY gene ORDER BY len DESC, tx) = 1")
def gene_longest(spark, d):
    return transcripts.longest(fx.transcripts(spark, d)).select("gene", "tx", "cds_length")


@query(
    f"{with_views('cds')} SELECT tx, cds_start, CAST(((-coalesce(sum(cds_end - cds_start) OVER (PARTITION BY tx ORDER BY CASE strand WHEN '+' THEN cds_start ELSE -cds_start END "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 3 + 3) % 3 AS BIGINT) AS frame FROM cds"
)
def reading_frames(spark, d):
    return transcripts.frames(fx.blocks(spark, d)).select("tx", "cds_start", "frame")


@query(
    f"{with_views('cds', 'tx')} SELECT tx, CASE strand WHEN '+' THEN s + 1 ELSE e - 2 END AS start_codon_start, CASE strand WHEN '+' THEN s + 3 ELSE e END AS start_codon_end, "
    "CASE strand WHEN '+' THEN e - 2 ELSE s + 1 END AS stop_codon_start, CASE strand WHEN '+' THEN e ELSE s + 3 END AS stop_codon_end FROM tx"
)
def codon_coordinates(spark, d):
    return transcripts.codon_positions(fx.transcripts(spark, d)).select("tx", "start_codon_start", "start_codon_end", "stop_codon_start", "stop_codon_end")


@query(f"{with_views('cds')} SELECT tx, cds_end + 1 AS intron_start, n AS intron_end FROM (SELECT *, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) AS n FROM cds) WHERE n IS NOT NULL")
def intron_coordinates(spark, d):
    rows = fx.transcripts(spark, d).select("tx", F.explode(transcripts.introns(F.col("cds"))).alias("i"))
    return rows.select("tx", transcripts.one_based(F.col("i")).alias("i")).select("tx", F.col("i.start").alias("intron_start"), F.col("i.end").alias("intron_end"))


NUMBERED = """g AS (SELECT seq, gene, min(s) AS gs FROM tx GROUP BY ALL), n AS (SELECT gene, row_number() OVER (ORDER BY seq, gs, gene) AS gene_id FROM g),
named AS (SELECT tx.*, gene_id, row_number() OVER (PARTITION BY gene ORDER BY tx) AS transcript_id FROM tx JOIN n USING (gene)),
named_too AS (SELECT *, concat('g', gene_id) AS gene_name, concat('g', gene_id, '_t', transcript_id) AS tx_name FROM named)"""


def _named(spark, d) -> DataFrame:
    return transcripts.named(transcripts.numbered(fx.transcripts(spark, d)))


@query(f"{with_views('cds', 'tx')}, {NUMBERED} SELECT tx, gene_id, transcript_id, gene_name, tx_name FROM named_too")
def gene_numbering(spark, d):
    return _named(spark, d).select("tx", "gene_id", "transcript_id", "gene_name", "tx_name")


# Sets


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = fx.transcripts(spark, d)
    return rows.where("tx % 3 <> 0"), rows.where("tx % 3 <> 1")


KEYED = ", a AS (SELECT * FROM tx WHERE tx % 3 <> 0), b AS (SELECT * FROM tx WHERE tx % 3 <> 1)"


@query(f"{with_views('cds', 'tx')}{KEYED} SELECT tx, blocks FROM a WHERE EXISTS (SELECT 1 FROM b WHERE (b.seq, b.strand, b.blocks) = (a.seq, a.strand, a.blocks))")
def annotation_and(spark, d):
    return setops.intersection(*_two(spark, d)).select("tx", block_text().alias("blocks"))


@query(f"{with_views('cds', 'tx')}{KEYED} SELECT tx, blocks FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.seq, b.strand, b.blocks) = (a.seq, a.strand, a.blocks))")
def annotation_diff(spark, d):
    return setops.difference(*_two(spark, d)).select("tx", block_text().alias("blocks"))


@query(f"{with_views('cds', 'tx')}{KEYED} SELECT tx, blocks FROM (SELECT 0 AS k, * FROM a UNION ALL SELECT 1, * FROM b) QUALIFY row_number() OVER (PARTITION BY seq, strand, blocks ORDER BY k, tx) = 1")
def annotation_or(spark, d):
    return setops.union(*_two(spark, d)).select("tx", block_text().alias("blocks"))


@query(f"{with_views('cds', 'tx')} SELECT tx, s AS tx_start FROM tx WHERE NOT len < 150")
def anti_remove(spark, d):
    rows = fx.transcripts(spark, d)
    return transcripts.extents(setops.without(rows, checks.short_coding(rows, 150))).select("tx", "tx_start")


@query(f"{with_views('cds', 'tx')}{KEYED}, k AS (SELECT 0 AS side, gene, string_agg(DISTINCT blocks, ';' ORDER BY blocks) AS t, seq, strand FROM a GROUP BY ALL UNION ALL SELECT 1, gene, string_agg(DISTINCT blocks, ';' ORDER BY blocks), seq, strand FROM b GROUP BY ALL) SELECT x.gene AS a_gene, y.gene AS b_gene FROM k x JOIN k y ON x.side = 0 AND y.side = 1 AND x.t = y.t AND x.seq = y.seq AND x.strand = y.strand")
def equal_genes(spark, d):
    return setops.equal_genes(*_two(spark, d))


# Sequences


SOME = [str(k) for k in range(0, 100, 3)]


@query(f"{with_views('docs')} SELECT name, seq_ord, length(sequence) AS length FROM docs WHERE name NOT IN ({', '.join(f"'{n}'" for n in SOME)}) AND length(sequence) >= 1000")
def contig_index(spark, d):
    """Sequences of a thousand letters, but for some names."""
    return sequences.index(fx.document_sequences(spark, d), None, SOME, 1_000)


@query(f"{with_views('docs')} SELECT name, seq_ord, length(sequence) AS length FROM docs WHERE name IN ({', '.join(f"'{n}'" for n in SOME)}) AND name NOT IN ('3', '6')")
def contig_index_included(spark, d):
    return sequences.index(fx.document_sequences(spark, d), SOME, ["3", "6"])


def _scanned(spark, d) -> fasta_scan.FastaScan:
    """The documents' sequences as FASTA files in the shared folder, read by lines again."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}.fa"
    writers.write_fasta(fx.document_sequences(spark, d).where("sequence IS NOT NULL"), path, width=60)
    return fasta_scan.scan_fasta(spark, path, size=700)


@query(f"{with_views('docs')} SELECT name, row_number() OVER (ORDER BY seq_ord) - 1 AS seq_ord, length(sequence) AS length FROM docs WHERE sequence IS NOT NULL")
def fasta_scan_index(spark, d):
    return _scanned(spark, d).index.select("name", "seq_ord", "length")


@query(f"{with_views('docs')} SELECT name AS seq, k AS chunk_no, md5(substr(sequence, CAST(k * 700 + 1 AS BIGINT), 702)) AS digest FROM (SELECT *, unnest(range(0, CAST(ceil(length(sequence) / 700.0) AS BIGINT))) AS k FROM docs)")
def fasta_scan_chunks(spark, d):
    return _scanned(spark, d).chunks.select("seq", "chunk_no", F.md5("chunk").alias("digest"))


def _packed(spark, d) -> str:
    """The documents' sequences as block gzip in the shared folder."""
    target = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    block_gzip.compress_sequences(fx.document_sequences(spark, d).where("sequence IS NOT NULL"), target, width=60)
    return target


@query(
    f"{with_views('docs')} SELECT seq_ord AS fetch_id, concat(name, ':', n // 3 + 1, '-', n // 2, ',1-', n // 5) AS name, md5(concat(substr(sequence, n // 3 + 1, n // 2 - n // 3), substr(sequence, 1, n // 5))) AS digest "
    "FROM (SELECT *, length(sequence) AS n FROM docs WHERE sequence IS NOT NULL)"
)
def block_gzip_fetch(spark, d):
    """Two ranges of each sequence, read from the blocks that they touch."""
    target = _packed(spark, d)
    parts = F.expr("inline(array(named_struct('part', 0, 'start', length div 3, 'end', length div 2), named_struct('part', 1, 'start', 0L, 'end', length div 5)))")
    ranges = block_gzip.block_lengths(spark, target).select(F.col("seq").cast("long").alias("fetch_id"), "seq", parts)
    return block_gzip.fetch_blocks(spark, target, ranges).select("fetch_id", "name", F.md5("sequence").alias("digest"))


@query(f"{with_views('docs')} SELECT name AS seq, k AS chunk_no, md5(substr(sequence, CAST(k * 700 + 1 AS BIGINT), 702)) AS digest FROM (SELECT *, unnest(range(0, CAST(ceil(length(sequence) / 700.0) AS BIGINT))) AS k FROM docs)")
def block_gzip_chunks(spark, d):
    return block_gzip.block_chunks(spark, _packed(spark, d), 700).select("seq", "chunk_no", F.md5("chunk").alias("digest"))


FETCHED = (
    f"{with_views('genome', 'cds')}, f AS (SELECT tx, c.seq, cds_start, substr(sequence, cds_start + 1, cds_end - cds_start) AS piece, cds_end FROM cds c JOIN genome ON name = c.seq WHERE cds_end <= length(sequence)) "
    "SELECT tx AS fetch_id, concat(seq, ':', string_agg(concat(cds_start + 1, '-', cds_end), ',' ORDER BY cds_start)) AS name, md5(string_agg(piece, '' ORDER BY cds_start)) AS digest FROM f GROUP BY tx, seq"
)


def _parts(spark, d) -> DataFrame:
    """Blocks of all transcripts as parts to fetch; blocks that run past their own contig are left out, for they would fail."""
    inside = fx.blocks(spark, d).join(sequences.lengths(fx.genome(spark)), "seq").where("cds_end <= length")
    return inside.select(F.col("tx").alias("fetch_id"), "seq", F.col("cds_start").alias("part"), F.col("cds_start").alias("start"), F.col("cds_end").alias("end"))


@query(FETCHED)
def fetch_ranges(spark, d):
    return sequences.fetch(fx.genome(spark), _parts(spark, d)).select("fetch_id", "name", F.md5("sequence").alias("digest"))


@query(FETCHED)
def fetch_ranges_whole(spark, d):
    """The same ranges from a table of small chunks, as an index on disk has them."""
    chunks = sequences.chunk_table(fx.genome(spark), 700)
    return sequences.fetch_indexed(chunks, _parts(spark, d), 700).select("fetch_id", "name", F.md5("sequence").alias("digest"))


@query(f"{with_views('docs')} SELECT name, md5(translate(sequence, 'ACGTacgt', 'TGCAtgca')) AS complement, md5(reverse(translate(sequence, 'ACGTacgt', 'TGCAtgca'))) AS reverse_complement FROM docs")
def complements(spark, d):
    s = F.col("sequence")
    return fx.document_sequences(spark, d).select("name", F.md5(nt.complement(s)).alias("complement"), F.md5(nt.complement(s, reverse=True)).alias("reverse_complement"))


@query(f"{with_views('docs')} SELECT name, md5(translate(sequence, 'ACGTNacgt', '012345678')) AS codes, md5(upper(sequence)) AS folded FROM docs")
def encode_codes(spark, d):
    codes = nt.encoded(F.col("sequence"))
    return fx.document_sequences(spark, d).select("name", F.md5(codes).alias("codes"), F.md5(nt.decoded(codes, repeats=False)).alias("folded"))


CODING = """coding AS (SELECT tx, any_value(c.strand) AS strand, string_agg(substr(sequence, cds_start + 1, cds_end - cds_start), '' ORDER BY cds_start) AS joined
  FROM cds c JOIN genome ON name = seq GROUP BY tx), oriented AS (
  SELECT tx, CASE strand WHEN '+' THEN joined ELSE reverse(translate(joined, 'ACGTacgt', 'TGCAtgca')) END AS coding FROM coding)"""


@query(f"{with_views('genome', 'cds')}, {CODING} SELECT tx, length(coding) AS n, md5(coding) AS digest FROM oriented")
def coding_sequence(spark, d):
    return checks.coding_sequences(fx.transcripts(spark, d), fx.genome(spark)).select("tx", long(F.length("coding")).alias("n"), F.md5("coding").alias("digest"))


ACID = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * strpos('TCAG', k[1]) + 4 * strpos('TCAG', k[2]) + strpos('TCAG', k[3]) - 20 AS BIGINT), 1)"


@query(
    f"{with_views('genome', 'cds')}, {CODING} SELECT tx, regexp_replace(array_to_string(list_transform(list_transform(range(0, length(coding) // 3), lambda i: substr(upper(coding), 3 * i + 1, 3)), lambda k: "
    f"CASE WHEN contains(k, 'N') THEN 'X' ELSE {ACID} END), ''), '\\*$', '') AS protein FROM oriented"
)
def protein_sequence(spark, d):
    return checks.coding_sequences(fx.transcripts(spark, d), fx.genome(spark)).select("tx", nt.protein(F.col("coding")).alias("protein"))


@query(
    f"{with_views('docs')} SELECT code, count(*) AS n FROM (SELECT unnest(list_transform(range(0, length(sequence) // 3), lambda i: substr(upper(sequence), 3 * i + 1, 3))) AS k FROM docs), "
    "LATERAL (SELECT CAST(list_sum(list_transform([1, 2, 3], lambda j: (strpos('ACGTN', substr(k, j, 1)) - 1) * CASE j WHEN 1 THEN 64 WHEN 2 THEN 8 ELSE 1 END)) AS BIGINT) AS code) GROUP BY code"
)
def kmer_counts(spark, d):
    return fx.document_sequences(spark, d).select(F.explode(nt.kmer_codes(F.col("sequence"))).alias("code")).select(long("code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


COUNT = "length(sequence) - length(replace(replace(sequence, '{0}', ''), '{1}', ''))"


@query(f"{with_views('docs')} SELECT name, " + ", ".join(f"round(CAST({COUNT.format(c, c if c == 'N' else c.lower())} AS DOUBLE) / length(sequence), 9) AS share_{c.lower()}" for c in "ACGTN") + " FROM docs WHERE length(sequence) > 0")
def base_composition(spark, d):
    rows = sequences.base_shares(fx.document_sequences(spark, d).where(F.length("sequence") > 0))
    return rows.select("name", *(F.round(c, 9).alias(c) for c in rows.columns[1:]))


@query(f"{with_views('docs')} SELECT " + ", ".join(f"round(CAST(sum({COUNT.format(c, c if c == 'N' else c.lower())}) AS DOUBLE) / sum(length(sequence)), 9) AS share_{c.lower()}" for c in "ACGTN") + " FROM docs")
def genome_composition(spark, d):
    rows = sequences.genome_shares(fx.document_sequences(spark, d))
    return rows.select(*(F.round(c, 9).alias(c) for c in rows.columns))


@query(f"{with_views('docs')} SELECT name, regexp_matches(sequence, '[acgt]') AS is_repeat_masked FROM docs")
def repeat_masked(spark, d):
    return fx.document_sequences(spark, d).select("name", nt.is_repeat_masked(F.col("sequence")).alias("is_repeat_masked"))


@query(f"{with_views('docs')} SELECT name, k AS chunk_no, md5(rpad(substr(sequence, CAST(k * 500 + 1 AS BIGINT), 500), 500, '-')) AS digest FROM (SELECT *, unnest(range(0, CAST(ceil(length(sequence) / 500.0) AS BIGINT))) AS k FROM docs)")
def chunk_sequences(spark, d):
    return sequences.chunks(fx.document_sequences(spark, d), 500).select("name", "chunk_no", F.md5("chunk").alias("digest"))


@query(f"{with_views('docs')} SELECT count(*) AS n_sequences, CAST(sum(length(sequence)) AS BIGINT) AS nucleotides, CAST(sum(ceil(length(sequence) / 500.0)) AS BIGINT) AS n_chunks FROM docs")
def sequence_totals(spark, d):
    return sequences.totals(fx.document_sequences(spark, d), 500)


@query(f"{with_views('docs')} SELECT name, " + ", ".join(f"CAST({COUNT.format(c, c if c == 'N' else c.lower())} AS DOUBLE) AS d{k}" for k, c in enumerate("ACGTN")) + ", CAST(length(regexp_replace(sequence, '[^acgt]', '', 'g')) AS DOUBLE) AS d5 FROM docs")
def one_hot_sums(spark, d):
    rows = fx.document_sequences(spark, d).select("name", nt.one_hot(F.col("sequence")).alias("h"))
    return rows.select("name", *(F.aggregate("h", F.lit(0.0), _adder(k)).alias(f"d{k}") for k in range(6)))


def _adder(k: int):
    return lambda a, x: a + F.get(x, F.lit(k)).cast("double")


@query(
    f"WITH RECURSIVE {SQL['docs']}, ordered AS (SELECT name, length(sequence) AS n, row_number() OVER (ORDER BY length(sequence) DESC, seq_ord) AS k FROM docs), "
    "fold AS (SELECT 0::BIGINT AS k, 5000::BIGINT AS size, 0::BIGINT AS id, 5000::BIGINT AS next_size, 0::BIGINT AS next_id, 0::BIGINT AS used, 0::BIGINT AS members UNION ALL "
    "SELECT k, size, id, size, CASE WHEN closes THEN id + 1 ELSE id END, CASE WHEN closes THEN 0 ELSE total END, CASE WHEN closes THEN 0 ELSE members + 1 END FROM ("
    "SELECT *, used + CAST(ceil(n / size) AS BIGINT) * size AS total, (NOT fits AND NOT shrinks) OR used + CAST(ceil(n / size) AS BIGINT) * size > 200000 AS closes FROM ("
    "SELECT k, n, fits, shrinks, CASE WHEN shrinks THEN rounded ELSE next_size END AS size, CASE WHEN shrinks AND members > 0 THEN next_id + 1 ELSE next_id END AS id, "
    "CASE WHEN shrinks THEN 0 ELSE used END AS used, CASE WHEN shrinks THEN 0 ELSE members END AS members FROM ("
    "SELECT *, NOT fits AND rounded < next_size AS shrinks FROM (SELECT o.k, n, next_size, next_id, used, members, n >= 0.1 * next_size OR next_size <= 9 AS fits, "
    "CAST(ceil(greatest(n, 1) / 9) AS BIGINT) * 9 AS rounded FROM fold f JOIN ordered o ON o.k = f.k + 1))))) "
    "SELECT name, n AS length, id AS group_id, size AS chunk_size FROM fold JOIN ordered USING (k)"
)
def group_sequences(spark, d):
    return sequences.grouped(sequences.index(fx.document_sequences(spark, d)), 5_000, 0.1, [9], 200_000)


# Checks


@query(f"{with_views('cds', 'tx')} SELECT tx, CAST(len AS BIGINT) AS cds_length FROM tx WHERE len < 150")
def check_min_coding_length(spark, d):
    return transcripts.extents(checks.short_coding(fx.transcripts(spark, d), 150)).select("tx", "cds_length")


@query(
    f"{with_views('genome', 'cds', 'tx')}, {CODING} SELECT o.tx FROM oriented o JOIN tx USING (tx) WHERE len >= 6 AND "
    "len(list_filter(range(0, length(coding) // 3 - 1), lambda i: substr(upper(coding), 3 * i + 1, 3) IN ('TAG', 'TAA', 'TGA'))) > 0"
)
def check_inframe_stop(spark, d):
    return checks.inframe_stops(fx.transcripts(spark, d), fx.genome(spark)).select("tx")


BORDERS = """gaps AS (SELECT c.tx, c.strand, cds_end AS a, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) AS b, sequence FROM cds c JOIN genome ON name = seq), sides AS (
  SELECT tx, upper(CASE strand WHEN '+' THEN substr(sequence, a + 1, 2) ELSE reverse(translate(upper(substr(sequence, b - 1, 2)), 'ACGT', 'TGCA')) END) AS l,
    upper(CASE strand WHEN '+' THEN substr(sequence, b - 1, 2) ELSE reverse(translate(upper(substr(sequence, a + 1, 2)), 'ACGT', 'TGCA')) END) AS r FROM gaps WHERE b IS NOT NULL), bad AS (
  SELECT tx, count(*) FILTER (l NOT IN ('GT', 'GC')) AS nb, count(*) FILTER (r NOT IN ('AG')) AS ne FROM sides GROUP BY tx), f AS (
  SELECT o.tx, CASE WHEN upper(left(coding, 3)) NOT IN ('ATG', 'CGT') THEN 'start' WHEN upper(right(coding, 3)) NOT IN ('TAG', 'TAA', 'TGA') THEN 'stop' WHEN nb > 0 OR ne > 0 THEN 'intron' END AS fault,
    coalesce(nb, 0) AS nb, coalesce(ne, 0) AS ne FROM oriented o LEFT JOIN bad USING (tx))"""


@query(f"{with_views('genome', 'cds')}, {CODING}, {BORDERS} SELECT tx, fault, CASE fault WHEN 'intron' THEN nb ELSE 0 END AS bad_intron_begins, CASE fault WHEN 'intron' THEN ne ELSE 0 END AS bad_intron_ends FROM f WHERE fault IS NOT NULL")
def check_exon_boundaries(spark, d):
    found = checks.boundary_faults(fx.transcripts(spark, d), fx.genome(spark), starts=("ATG", "CGT"))
    return found.select("tx", "fault", "bad_intron_begins", "bad_intron_ends")


@query(f"{with_views('genome', 'cds')}, {CODING} SELECT tx FROM oriented WHERE regexp_matches(coding, '[acgt]')")
def check_coding_repeats(spark, d):
    return checks.coding_repeats(fx.transcripts(spark, d), fx.genome(spark)).select("tx")


@query(f"{with_views('genome', 'cds', 'tx')} SELECT tx, e AS tx_end FROM tx JOIN genome ON name = tx.seq WHERE e > length(sequence)")
def check_out_of_bounds(spark, d):
    return transcripts.extents(checks.out_of_bounds(fx.transcripts(spark, d), fx.genome(spark))).select("tx", "tx_end")


# Labels

REGIONS = """kinds AS (SELECT *, CASE WHEN state = 0 THEN 'intergenic' WHEN state <= 3 THEN 'intron' ELSE 'CDS' END AS name FROM labels), marks AS (
  SELECT *, CASE WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS c FROM kinds WINDOW w AS (PARTITION BY seq, strand ORDER BY idx)), runs AS (
  SELECT *, sum(c) OVER (PARTITION BY seq, strand ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM marks), regions AS (
  SELECT seq, strand, name, min(idx) AS start, max(idx) + 1 AS "end" FROM runs GROUP BY seq, strand, k, name)"""
FOUND = """outer_runs AS (SELECT *, sum(CASE WHEN name = 'intergenic' THEN 1 ELSE 0 END) OVER (PARTITION BY seq, strand ORDER BY start ROWS UNBOUNDED PRECEDING) AS k,
    max(CASE WHEN name = 'intergenic' THEN start END) OVER (PARTITION BY seq, strand) AS stop FROM regions), found AS (
  SELECT seq, strand, min(start) AS tx_start, max("end") AS tx_end, coalesce(string_agg(concat(start, '-', "end"), ',' ORDER BY start) FILTER (name = 'CDS'), '') AS blocks
  FROM outer_runs WHERE name <> 'intergenic' AND k > 0 AND "end" <= stop GROUP BY seq, strand, k)"""


@query(f"{with_views('labels')}, {REGIONS} SELECT * FROM regions")
def split_regions(spark, d):
    return labels.regions(fx.labels(spark, d))


@query(f"{with_views('labels')}, {REGIONS} SELECT * FROM regions")
def region_runs(spark, d):
    """The same regions from chunks of states, as predictors give them."""
    return labels.chunk_regions(labels.chunked(fx.labels(spark, d), 8), 8)


@query(f"{with_views('labels')}, {REGIONS}, {FOUND} SELECT * FROM found")
def transcripts_from_regions(spark, d):
    found = labels.region_transcripts(labels.regions(fx.labels(spark, d)))
    return found.select("seq", "strand", "tx_start", "tx_end", block_text().alias("blocks"))


@query(f"{with_views('labels')}, {REGIONS}, {FOUND} SELECT seq, strand, tx_start, row_number() OVER (ORDER BY seq, tx_start, strand) AS tx FROM found")
def merge_strands(spark, d):
    return labels.merged_strands(labels.region_transcripts(labels.regions(fx.labels(spark, d)))).select("seq", "strand", "tx_start", "tx")


CHUNKS = """chunks AS (SELECT seq, strand, idx // 8 AS chunk_no, list(state ORDER BY idx) AS st FROM labels GROUP BY ALL), edges AS (
  SELECT *, lead(st) OVER (PARTITION BY seq, strand ORDER BY chunk_no) AS nx FROM chunks), mis AS (
  SELECT seq, strand, chunk_no AS boundary FROM edges WHERE nx IS NOT NULL AND (st[-1] <> nx[1] OR st[-1] NOT IN (0, 1, 2, 3)))"""


@query(f"{with_views('labels')}, {CHUNKS} SELECT * FROM mis")
def find_mismatches(spark, d):
    return labels.mismatches(labels.chunked(fx.labels(spark, d), 8))


@query(f"{with_views('labels')}, {CHUNKS} SELECT count(*) FILTER (strand = '+') AS fwd_only, count(*) FILTER (strand = '-') AS rev_only, CAST(0 AS BIGINT) AS both FROM mis")
def mismatch_totals(spark, d):
    return labels.mismatch_totals(labels.mismatches(labels.chunked(fx.labels(spark, d), 8)))


def _label_windows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chunks, and as second prediction of each window the labels of the chunk after its border."""
    chunks = labels.chunked(fx.labels(spark, d), 8)
    windows = repair.repair_windows(chunks, 8)
    follow = labels.chunked(fx.labels(spark, d), 8).withColumn("boundary", F.col("chunk_no") - 1).where(F.size("states") == 8)
    again = windows.join(follow, ["seq", "boundary"])
    return chunks, again.select("seq", "strand", "boundary", "asked", "states")


CLEARED = """ranges AS (
  SELECT DISTINCT m.seq, m.strand, coalesce((SELECT max(idx) FROM now l WHERE l.seq = m.seq AND l.strand = m.strand AND l.idx < (m.boundary + 1) * 8 AND l.state = 0), 0) AS low,
    coalesce((SELECT min(idx) FROM now l WHERE l.seq = m.seq AND l.strand = m.strand AND l.idx >= (m.boundary + 1) * 8 AND l.state = 0), (SELECT max(idx) + 1 FROM now l WHERE l.seq = m.seq AND l.strand = m.strand)) AS high
  FROM failed m), cleared AS (
  SELECT seq, strand, idx, CASE WHEN EXISTS (SELECT 1 FROM ranges r WHERE r.seq = n.seq AND r.strand = n.strand AND n.idx >= r.low AND n.idx < r.high) THEN 0 ELSE state END AS state FROM now n)"""
MERGED = """pairs AS (
  SELECT e.*, list_position(list_transform([1, 2, 3, 4], lambda i: st[4 + i] = nx[i]), true) AS p, list_max(list_filter([1, 2, 3, 4], lambda j: nx[j] = nx[4 + j])) AS q
  FROM edges e JOIN mis m ON m.seq = e.seq AND m.strand = e.strand AND m.boundary = e.chunk_no WHERE len(nx) = 8), fit AS (
  SELECT seq, strand, chunk_no, st[5:4 + p] || nx[p + 1:4] AS tail, nx[5:3 + q] || nx[q:4] AS head FROM pairs WHERE p > 0 AND q IS NOT NULL), failed AS (
  SELECT seq, strand, chunk_no AS boundary FROM pairs WHERE coalesce(p, 0) = 0 OR q IS NULL), patched AS (
  SELECT c.seq, c.strand, c.chunk_no, coalesce(h.head, st[1:4]) || coalesce(t.tail, st[5:8]) AS st FROM chunks c LEFT JOIN fit t ON t.seq = c.seq AND t.strand = c.strand AND t.chunk_no = c.chunk_no
  LEFT JOIN fit h ON h.seq = c.seq AND h.strand = c.strand AND h.chunk_no = c.chunk_no - 1), now AS (
  SELECT seq, strand, 8 * chunk_no + unnest(range(0, len(st))) AS idx, unnest(st) AS state FROM patched)"""


@query(f"{with_views('labels')}, {CHUNKS}, {MERGED}, {CLEARED} SELECT seq, strand, idx // 8 AS chunk_no, string_agg(state, ',' ORDER BY idx) AS states FROM cleared GROUP BY ALL")
def merge_repredictions(spark, d):
    fixed = repair.repaired(*_label_windows(spark, d), 8)
    return fixed.select("seq", "strand", "chunk_no", F.array_join(F.transform("states", lambda x: x.cast("string")), ",").alias("states"))


@query(f"{with_views('labels')}, {CHUNKS}, failed AS (SELECT * FROM mis), now AS (SELECT * FROM labels), {CLEARED} SELECT * FROM cleared")
def clear_crossing_gene(spark, d):
    chunks = labels.chunked(fx.labels(spark, d), 8)
    return labels.unchunked(repair.cleared(chunks, labels.mismatches(chunks), 8), 8)


LETTERS = """places AS (SELECT name, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM docs), labels AS (
  SELECT name AS seq, strand, i - 1 AS idx, CASE WHEN substr(sequence, i, 1) IN ('A', 'a') THEN 0 WHEN substr(sequence, i, 1) IN ('C', 'c', 'N') THEN 4 ELSE 1 END AS state
  FROM places, (VALUES ('+'), ('-')) s(strand))"""


@query(f"{with_views('docs')}, {LETTERS}, {REGIONS}, {FOUND} SELECT seq, strand, row_number() OVER (ORDER BY seq, tx_start, strand) AS tx, blocks FROM found")
def annotate_pipeline(spark, d):
    """The whole pipeline with a predictor that labels letters; its second predictions agree, so borders leave no trace."""
    base = fx.document_sequences(spark, d)

    def predict(chunks: DataFrame) -> DataFrame:
        letters = F.filter(F.split("chunk", ""), lambda c: c != "")
        state = F.transform(letters, lambda c: F.when(c.isin("A", "a"), 0).when(c.isin("C", "c", "N", "-"), 4).otherwise(1))
        rows = chunks.select(F.col("name").alias("seq"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "chunk_no", state.alias("states"))
        return rows.withColumn("chunk_no", F.col("chunk_no").cast("long"))

    return annotate(base, predict, 2_000).select("seq", "strand", "tx", block_text().alias("blocks"))


# Histograms and comparison

EDGES = """span AS (SELECT min({v}) AS lo, max({v}) AS hi FROM tmap), edges AS (SELECT list_transform(range(0, {b} + 1), lambda i: CAST(round_even(lo + i * (hi - lo) / {b}.0, 0) AS DOUBLE)) AS e FROM span),
placed AS (SELECT class_code, greatest(0, least({b} - 1, len(list_filter(e, lambda x: x <= {v})) - 1)) AS bin FROM tmap, edges), filled AS (
  SELECT class_code, b AS bin, e[CAST(b + 1 AS INT)] AS lo, e[CAST(b + 2 AS INT)] AS hi FROM (SELECT DISTINCT class_code FROM tmap), range({b}) r(b), edges)"""
COUNTED = "SELECT class_code, bin, lo, hi, coalesce(n, 0) AS n{more} FROM filled LEFT JOIN (SELECT class_code, bin, count(*) AS n FROM placed GROUP BY ALL) USING (class_code, bin)"


@query(f"{with_views('tmap')}, {EDGES.format(v='len', b=7)} {COUNTED.format(more='')}")
def bin_histogram(spark, d):
    return histograms.histogram(fx.class_codes(spark, d), "len", 7)


@query(
    f"SELECT * FROM ({with_views('tmap')}, {EDGES.format(v='len', b=5)} {COUNTED.format(more=", 'len' AS \"column\"")}) UNION ALL "
    f"SELECT * FROM ({with_views('tmap')}, {EDGES.format(v='num_exons', b=5)} {COUNTED.format(more=", 'num_exons' AS \"column\"")})"
)
def bin_histogram_multi(spark, d):
    return histograms.histograms(fx.class_codes(spark, d), ["len", "num_exons"], 5)


def _compared(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = fx.transcripts(spark, d)
    last = F.size("cds") - 1
    moved = F.transform("cds", lambda c, i: F.struct(c["start"].alias("start"), (c["end"] + F.when((i == last) & (F.col("tx") % 11 == 0), 3).otherwise(0)).alias("end")))
    return rows.where("tx % 3 <> 1").withColumn("cds", moved).withColumn("annotation", F.lit("query")), rows.where("tx % 3 <> 0")


PAIR = """ref AS (SELECT * FROM cds WHERE tx % 3 <> 0), qry AS (SELECT seq, strand, tx, cds_start, cds_end + CASE WHEN tx % 11 = 0 AND cds_start = max(cds_start) OVER (PARTITION BY tx) THEN 3 ELSE 0 END AS cds_end FROM cds WHERE tx % 3 <> 1)"""
SCORE = """scored AS (SELECT 'query' AS annotation, '{level}' AS level, round(hr / CAST(r AS DOUBLE), 3) AS sensitivity, round(hq / CAST(q AS DOUBLE), 3) AS precision FROM counts)
SELECT *, CASE WHEN sensitivity = 0 OR precision = 0 THEN 0.0 ELSE round(2 * sensitivity * precision / (sensitivity + precision), 3) END AS f1 FROM scored"""
SETS = """counts AS (SELECT (SELECT count(*) FROM a JOIN b USING ({keys})) AS hr, (SELECT count(*) FROM a JOIN b USING ({keys})) AS hq, (SELECT count(*) FROM b) AS r, (SELECT count(*) FROM a) AS q)"""
EXON_KEYS = "seq, strand, cds_start, cds_end"


@query(f"{with_views('cds')}, {PAIR}, a AS (SELECT DISTINCT {EXON_KEYS} FROM qry), b AS (SELECT DISTINCT {EXON_KEYS} FROM ref), {SETS.format(keys=EXON_KEYS)}, {SCORE.format(level='exon')}")
def compare_exon(spark, d):
    return comparison.compare_exons(*_compared(spark, d))


GAPS = "SELECT DISTINCT seq, strand, x, y FROM (SELECT seq, strand, cds_end AS x, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) AS y FROM {t}) WHERE y IS NOT NULL"


@query(f"{with_views('cds')}, {PAIR}, a AS ({GAPS.format(t='qry')}), b AS ({GAPS.format(t='ref')}), {SETS.format(keys='seq, strand, x, y')}, {SCORE.format(level='intron')}")
def compare_intron(spark, d):
    return comparison.compare_introns(*_compared(spark, d))


CHAIN = "SELECT seq, strand, tx, min(cds_start) AS s, max(cds_end) AS e, coalesce(string_agg(concat(cds_end, '-', y), ',' ORDER BY cds_start) FILTER (y IS NOT NULL), '') AS chain FROM (SELECT *, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) AS y FROM {t}) GROUP BY seq, strand, tx"


@query(
    f"{with_views('cds')}, {PAIR}, a AS (SELECT DISTINCT seq, strand, chain FROM ({CHAIN.format(t='qry')}) WHERE chain <> ''), b AS (SELECT DISTINCT seq, strand, chain FROM ({CHAIN.format(t='ref')}) WHERE chain <> ''), "
    f"{SETS.format(keys='seq, strand, chain')}, {SCORE.format(level='intron_chain')}"
)
def compare_chain(spark, d):
    return comparison.compare_chains(*_compared(spark, d))


MATCHED = f"qt AS ({CHAIN.format(t='qry')}), rt AS ({CHAIN.format(t='ref')}), m AS (SELECT qt.tx AS q, rt.tx AS r FROM qt JOIN rt ON qt.seq = rt.seq AND qt.strand = rt.strand AND qt.chain = rt.chain AND abs(qt.s - rt.s) <= 2 AND abs(qt.e - rt.e) <= 2)"


@query(f"{with_views('cds')}, {PAIR}, {MATCHED}, counts AS (SELECT (SELECT count(DISTINCT r) FROM m) AS hr, (SELECT count(DISTINCT q) FROM m) AS hq, (SELECT count(*) FROM rt) AS r, (SELECT count(*) FROM qt) AS q), {SCORE.format(level='transcript')}")
def compare_transcript(spark, d):
    return comparison.compare_transcripts(*_compared(spark, d), tolerance=2)


def _bases(name: str) -> str:
    return f"SELECT DISTINCT seq, strand, unnest(range(cds_start, cds_end)) AS p FROM {name}"


@query(f"{with_views('cds')}, {PAIR}, a AS ({_bases('qry')}), b AS ({_bases('ref')}), {SETS.format(keys='seq, strand, p')}, {SCORE.format(level='base')}")
def compare_base(spark, d):
    return comparison.compare_bases(*_compared(spark, d))


LOCI = """{n} AS (SELECT *, max(fresh) OVER (PARTITION BY seq, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS locus FROM (
  SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY seq, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE s END AS fresh FROM {t}))"""


@query(
    f"{with_views('cds')}, {PAIR}, {MATCHED}, {LOCI.format(n='ql', t='qt')}, {LOCI.format(n='rl', t='rt')}, counts AS (SELECT (SELECT count(DISTINCT (seq, strand, locus)) FROM rl WHERE tx IN (SELECT r FROM m)) AS hr, "
    "(SELECT count(DISTINCT (seq, strand, locus)) FROM ql WHERE tx IN (SELECT q FROM m)) AS hq, (SELECT count(DISTINCT (seq, strand, locus)) FROM rl) AS r, (SELECT count(DISTINCT (seq, strand, locus)) FROM ql) AS q), "
    + SCORE.format(level="locus")
)
def compare_locus(spark, d):
    return comparison.compare_loci(*_compared(spark, d), tolerance=2)


@query(
    f"{with_views('cds')}, {PAIR}, a AS (SELECT DISTINCT {EXON_KEYS} FROM qry), b AS (SELECT DISTINCT {EXON_KEYS} FROM ref) SELECT 'query' AS annotation, 'exon' AS level, "
    "round((SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.seq = b.seq AND a.strand = b.strand AND a.cds_start < b.cds_end AND b.cds_start < a.cds_end)) / CAST((SELECT count(*) FROM b) AS DOUBLE), 3) AS missed, "
    "round((SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seq = b.seq AND a.strand = b.strand AND a.cds_start < b.cds_end AND b.cds_start < a.cds_end)) / CAST((SELECT count(*) FROM a) AS DOUBLE), 3) AS novel"
)
def missed_and_novel_exons(spark, d):
    return comparison.missed_and_novel(*_compared(spark, d), ("exon",))


SPANS = "SELECT seq, strand, locus, min(s) AS low, max(e) AS high FROM {t} GROUP BY ALL"
UNSEEN = "round((SELECT count(*) FROM {x} x WHERE NOT EXISTS (SELECT 1 FROM {y} y WHERE x.seq = y.seq AND x.strand = y.strand AND x.low < y.high AND y.low < x.high)) / CAST((SELECT count(*) FROM {x}) AS DOUBLE), 3)"


@query(
    f"{with_views('cds')}, {PAIR}, {MATCHED}, {LOCI.format(n='ql', t='qt')}, {LOCI.format(n='rl', t='rt')}, a AS ({SPANS.format(t='ql')}), b AS ({SPANS.format(t='rl')}) "
    f"SELECT 'query' AS annotation, 'locus' AS level, {UNSEEN.format(x='b', y='a')} AS missed, {UNSEEN.format(x='a', y='b')} AS novel"
)
def missed_and_novel_loci(spark, d):
    return comparison.missed_and_novel(*_compared(spark, d), ("locus",))


NESTED = """SELECT seq, strand, tx, tx // 42 * 14 + tx % 14 AS gene, list({{'s': cds_start, 'e': cds_end}} ORDER BY cds_start) AS blocks, min(cds_start) AS low, max(cds_end) AS high, CAST(sum(cds_end - cds_start) AS BIGINT) AS len
  FROM {t} GROUP BY seq, strand, tx"""
GAPPED = "SELECT *, list_transform(range(1, len(blocks)), lambda i: {{'s': blocks[i].e, 'e': blocks[i + 1].s}}) AS gaps FROM {t}"
TESTS = """CASE WHEN own AND q.gaps = r.gaps AND abs(q.low - r.low) <= 2 AND abs(q.high - r.high) <= 2 THEN 0
    WHEN own AND q.low >= r.low AND q.high <= r.high AND list_filter(r.gaps, lambda i: i.s < q.high AND q.low < i.e) = q.gaps THEN 1
    WHEN own AND q.low <= r.low AND q.high >= r.high AND list_filter(q.gaps, lambda i: i.s < r.high AND r.low < i.e) = r.gaps THEN 2
    WHEN own AND kept > 0 AND len(list_filter(q.gaps, lambda g: NOT list_contains(r.gaps, g))) = 0 AND loose = 0 THEN 3 WHEN own AND kept > 0 THEN 4
    WHEN own AND len(list_intersect(q.gaps, r.gaps)) > 0 THEN 5
    WHEN own AND len(q.gaps) = 0 AND touch AND len(list_filter(r.gaps, lambda g: least(q.high, g.e) - greatest(q.low, g.s) >= 10)) > 0 THEN 6
    WHEN own AND touch THEN 7 WHEN NOT own AND len(list_intersect(q.gaps, r.gaps)) > 0 THEN 8 WHEN NOT own AND touch THEN 9
    WHEN len(list_filter(r.gaps, lambda g: g.s <= q.low AND q.high <= g.e)) > 0 THEN 10 WHEN len(list_filter(q.gaps, lambda g: g.s <= r.low AND r.high <= g.e)) > 0 THEN 11
    WHEN own AND common <= 0 THEN 12 ELSE 14 END"""
SPANNED = "(SELECT x.tx AS sq, t.tx AS sr, unnest(t.gaps) AS g, x.cds_start AS s, x.cds_end AS e FROM qry x JOIN rn t ON x.seq = t.seq AND x.strand = t.strand AND x.cds_start < t.high AND t.low < x.cds_end)"


@query(
    f"{with_views('cds', 'genome')}, {PAIR}, q0 AS ({NESTED.format(t='qry')}), r0 AS ({NESTED.format(t='ref')}), qn AS ({GAPPED.format(t='q0')}), rn AS ({GAPPED.format(t='r0')}), touching AS (SELECT DISTINCT a.tx AS q, b.tx AS r FROM qry a JOIN ref b ON a.seq = b.seq AND a.cds_start < b.cds_end AND b.cds_start < a.cds_end), "
    f"spans AS (SELECT sq, sr, list(DISTINCT g) AS gs FROM {SPANNED} WHERE s <= g.s AND g.e <= e GROUP BY sq, sr), "
    "near AS (SELECT q, r, q.strand = r.strand AS own, least(q.high, r.high) - greatest(q.low, r.low) AS common, EXISTS (SELECT 1 FROM touching t WHERE t.q = q.tx AND t.r = r.tx) AS touch, coalesce(len(gs), 0) AS kept, "
    "len(list_filter(r.gaps, lambda g: NOT list_contains(q.gaps, g) AND NOT coalesce(list_contains(gs, g), false))) AS loose FROM qn q JOIN rn r ON q.seq = r.seq AND q.low < r.high + 2000 AND r.low - 2000 < q.high LEFT JOIN spans ON sq = q.tx AND sr = r.tx), "
    f"ranked AS (SELECT q.tx AS tx, r, common, {TESTS} AS k FROM near), best AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY k, common DESC, r.tx) AS place FROM ranked), "
    "masked AS (SELECT tx, sum(length(regexp_replace(substr(sequence, cds_start + 1, cds_end - cds_start), '[^a-z]', '', 'g'))) AS m FROM qry JOIN genome ON name = seq GROUP BY tx), "
    "coded AS (SELECT qn.*, CASE WHEN coalesce(k, 14) = 14 AND coalesce(m, 0) >= 0.5 * len THEN 13 ELSE coalesce(k, 14) END AS k, r FROM qn LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON b.tx = qn.tx LEFT JOIN masked ON masked.tx = qn.tx), "
    "major AS (SELECT gene, arg_max(tx, len * 100000000 - tx) AS major_iso_id FROM qn GROUP BY gene) "
    "SELECT CASE WHEN k < 13 THEN r.gene END AS ref_gene_id, CASE WHEN k < 13 THEN r.tx END AS ref_id, (['=', 'c', 'k', 'm', 'n', 'j', 'e', 'o', 's', 'x', 'i', 'y', 'p', 'r', 'u'])[k + 1] AS class_code, c.gene AS qry_gene_id, c.tx AS qry_id, "
    "len(c.blocks) AS num_exons, 0.0::DOUBLE AS FPKM, 0.0::DOUBLE AS TPM, 0.0::DOUBLE AS cov, c.len, major_iso_id, CASE WHEN k < 13 THEN r.len END AS ref_match_len FROM coded c JOIN major ON major.gene = c.gene"
)
def class_code_table(spark, d):
    return comparison.class_codes(*_compared(spark, d), tolerance=2, sequences=fx.genome(spark))


LEVELS = ("compare_base", "compare_exon", "compare_intron", "compare_chain", "compare_transcript", "compare_locus")


@query(
    "SELECT level, min(sensitivity) AS min_sensitivity, max(sensitivity) AS max_sensitivity, min(precision) AS min_precision, max(precision) AS max_precision FROM ("
    + " UNION ALL ".join(f"SELECT level, sensitivity, precision FROM ({ORACLES[n]})" for n in LEVELS)
    + ") GROUP BY level"
)
def metric_bounds(spark, d):
    return histograms.metric_bounds(comparison.compare(*_compared(spark, d), tolerance=2), ("level",))


@query(
    "WITH m AS (" + " UNION ALL ".join(f"SELECT level, f1 FROM ({ORACLES[n]})" for n in LEVELS) + "), c AS (SELECT level, f1, f1 / 2 + i * ((1 - f1 / 2) / 99) AS p FROM m, range(100) t(i) WHERE f1 > 0), "
    "r AS (SELECT level, f1, p, f1 * p / (2 * p - f1) AS q FROM c WHERE 2 * p > f1) SELECT level, f1, round(p, 9) AS precision, round(q, 9) AS recall FROM r WHERE q BETWEEN 0 AND 1"
)
def f1_isocurve(spark, d):
    """Curves through the F1 of each level of a comparison."""
    rows = histograms.f1_curves(comparison.compare(*_compared(spark, d), tolerance=2))
    return rows.select("level", "f1", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# Formats


@query(f"{with_views('cds', 'tx')}, {NUMBERED} SELECT tx, concat_ws(chr(9), tx_name, seq, strand, s, e, s, e, n, starts, ends) AS line FROM named_too JOIN (SELECT tx, concat(string_agg(cds_start, ',' ORDER BY cds_start), ',') AS starts, concat(string_agg(cds_end, ',' ORDER BY cds_start), ',') AS ends FROM cds GROUP BY tx) USING (tx)")
def genepred_rows(spark, d):
    return writers.genepred_lines(_named(spark, d)).select("tx", "line")


FRAMED = """framed AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY cds_start) AS i, lead(cds_start) OVER (PARTITION BY tx ORDER BY cds_start) AS nx,
  CAST(((-coalesce(sum(cds_end - cds_start) OVER (PARTITION BY tx ORDER BY CASE strand WHEN '+' THEN cds_start ELSE -cds_start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 3 + 3) % 3 AS BIGINT) AS frame FROM cds),
parts AS (SELECT f.*, gene_id, transcript_id, gene_name, tx_name FROM framed f JOIN named_too t ON t.tx = f.tx)"""


def _cell(feature: str, low: str, high: str, frame: str, attributes: str, source: str) -> str:
    return f"concat_ws(chr(9), seq, 'strandline', {feature}, {low}, {high}, '.', strand, {frame}, {attributes}) AS line FROM {source}"


GENE_ATTR, TX_ATTR = "concat('gene_id \"', gene_name, '\";')", "concat('gene_id \"', gene_name, '\"; transcript_id \"', tx_name, '\";')"


@query(
    f"{with_views('cds', 'tx')}, {NUMBERED}, {FRAMED} SELECT gene_id, CAST(0 AS BIGINT) AS transcript_id, {_cell("'gene'", 'min(s) + 1', 'max(e)', "'.'", GENE_ATTR, 'named_too GROUP BY seq, strand, gene_id, gene_name')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell("'transcript'", 's + 1', 'e', "'.'", TX_ATTR, 'named_too')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell("'start_codon'", "CASE strand WHEN '+' THEN s + 1 ELSE e - 2 END", "CASE strand WHEN '+' THEN s + 3 ELSE e END", "'0'", TX_ATTR, 'named_too')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell("'stop_codon'", "CASE strand WHEN '+' THEN e - 2 ELSE s + 1 END", "CASE strand WHEN '+' THEN e ELSE s + 3 END", "'0'", TX_ATTR, 'named_too')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell('f', 'cds_start + 1', 'cds_end', 'frame', TX_ATTR, "parts, (VALUES ('CDS'), ('exon')) v(f)")}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell("'intron'", 'cds_end + 1', 'nx', "'.'", TX_ATTR, 'parts WHERE nx IS NOT NULL')}"
)
def gtf_rows(spark, d):
    return writers.gtf_lines(_named(spark, d)).select("gene_id", "transcript_id", "line")


@query(
    f"{with_views('cds', 'tx')}, {NUMBERED}, {FRAMED} SELECT gene_id, CAST(0 AS BIGINT) AS transcript_id, {_cell("'gene'", 'min(s) + 1', 'max(e)', "'.'", "concat('ID=', gene_name, ';Name=', gene_name)", 'named_too GROUP BY seq, strand, gene_id, gene_name')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell("'mRNA'", 's + 1', 'e', "'.'", "concat('ID=', tx_name, ';Name=', tx_name, ';Parent=', gene_name)", 'named_too')}"
    f" UNION ALL SELECT gene_id, transcript_id, {_cell('f', 'cds_start + 1', 'cds_end', 'frame', "concat('ID=', tx_name, '.', f, '.', i, ';Parent=', tx_name)", "parts, (VALUES ('CDS'), ('exon')) v(f)")}"
)
def gff3_rows(spark, d):
    return writers.gff3_lines(_named(spark, d), header=False).select("gene_id", "transcript_id", "line")


@query(f"{with_views('cds', 'tx')}, {NUMBERED} SELECT tx_name, seq, strand, blocks FROM named_too")
def genepred_roundtrip(spark, d):
    lines = writers.genepred_lines(_named(spark, d)).select(F.col("line").alias("value"), F.col("tx").alias("line"))
    return readers.parse_genepred(lines).select("tx_name", "seq", "strand", block_text().alias("blocks"))


@query(f"{with_views('cds', 'tx')}, {NUMBERED} SELECT tx_name, gene_name, seq, strand, blocks FROM named_too")
def gtf_roundtrip(spark, d):
    lines = writers.gtf_lines(_named(spark, d))
    return readers.parse_gtf(lines.select(F.col("line").alias("value"), (F.col("gene_id") * 1000 + F.col("transcript_id")).alias("line"))).select("tx_name", "gene_name", "seq", "strand", block_text().alias("blocks"))


@query(f"{with_views('cds', 'tx')}, {NUMBERED} SELECT tx_name, gene_name, seq, strand, blocks FROM named_too")
def gff3_roundtrip(spark, d):
    lines = writers.gff3_lines(_named(spark, d), header=False)
    return readers.parse_gff3(lines.select(F.col("line").alias("value"), (F.col("gene_id") * 1000 + F.col("transcript_id")).alias("line"))).select("tx_name", "gene_name", "seq", "strand", block_text().alias("blocks"))


@query(f"{with_views('docs')} SELECT name, length(sequence) AS length, md5(concat('>', name, CASE WHEN length(sequence) > 0 THEN chr(10) ELSE '' END, rtrim(regexp_replace(sequence, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)))) AS digest FROM docs")
def fasta_rows(spark, d):
    return writers.fasta_lines(fx.document_sequences(spark, d)).select("name", long(F.length("sequence")).alias("length"), F.md5("line").alias("digest"))


def _places(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("seq").orderBy("tx_start", "tx")
    return rows.select("seq", long(F.row_number().over(order)).alias("place"), "tx", "tx_start")


@query(f"{with_views('cds', 'tx')} SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY s, tx) AS place, tx, s AS tx_start FROM tx")
def genepred_index_sorted(spark, d):
    return _places(writers.index_rows(fx.transcripts(spark, d)))


@query(
    f"{with_views('cds', 'tx')} SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY s, tx) AS place, tx, s AS tx_start FROM (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY gene ORDER BY len DESC, tx) = 1)"
)
def genepred_index_single_cover(spark, d):
    return _places(writers.index_rows(fx.transcripts(spark, d), single_cover=True))


# How each code differs from the standard one, as codon and amino acid.
DIFFERENCES = {
    1: "", 2: "TGAW ATAM AGA* AGG*", 3: "TGAW CTTT CTCT CTAT CTGT ATAM", 4: "TGAW", 5: "TGAW ATAM AGAS AGGS", 6: "TAAQ TAGQ", 9: "TGAW AAAN AGAS AGGS", 10: "TGAC", 11: "", 12: "CTGS",
    13: "TGAW ATAM AGAG AGGG", 14: "TAAY TGAW AAAN AGAS AGGS", 15: "TAGQ", 16: "TAGL", 21: "TGAW ATAM AAAN AGAS AGGS", 22: "TCA* TAGL", 23: "TTA*", 24: "TGAW AGAS AGGK", 25: "TGAG", 26: "CTGA",
    27: "TAAQ TAGQ TGAW", 28: "TAAQ TAGQ TGAW", 29: "TAAY TAGY", 30: "TAAE TAGE", 31: "TAAE TAGE TGAW", 32: "TAGW", 33: "TAAY TGAW AGAS AGGK",
}
CODES = (
    "WITH codons AS (SELECT a.b || b.b || c.b AS k FROM (VALUES ('T'), ('C'), ('A'), ('G')) a(b), (VALUES ('T'), ('C'), ('A'), ('G')) b(b), (VALUES ('T'), ('C'), ('A'), ('G')) c(b)), "
    "codes AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{x}')" for t, x in DIFFERENCES.items()) + ") v(translation_table, changes)) "
    f"SELECT translation_table, k AS codon, coalesce(nullif(regexp_extract(changes, '(?:^| )' || k || '(.)', 1), ''), {ACID}) AS aa FROM codes, codons"
)


CODONS = "codons_of AS (SELECT name, k AS codon, count(*) AS n FROM (SELECT name, unnest(list_transform(range(0, length(sequence) // 3), lambda i: substr(upper(sequence), 3 * i + 1, 3))) AS k FROM docs) GROUP BY ALL)"


def _codons(spark, d) -> DataFrame:
    """(name, codon, n): the codons of each document's sequence."""
    rows = fx.document_sequences(spark, d).select("name", F.explode(nt.kmers(F.col("sequence"))).alias("codon"))
    return rows.groupBy("name", "codon").agg(F.count("*").alias("n"))


@query(f"{with_views('docs')}, {CODONS} SELECT translation_table, aa, CAST(sum(n) AS BIGINT) AS n FROM codons_of JOIN ({CODES}) c USING (codon) GROUP BY ALL")
def codon_table(spark, d):
    """Amino acids that the codons of all documents stand for, by each code."""
    return _codons(spark, d).join(F.broadcast(codon_frame(spark)), "codon").groupBy("translation_table", "aa").agg(F.sum("n").alias("n"))


@query(f"{with_views('docs')}, {CODONS} SELECT name, abs(sum(p) - 1) <= 1e-9 AS valid FROM (SELECT name, n / sum(n) OVER (PARTITION BY name) / CASE WHEN CAST(name AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END AS p FROM codons_of) GROUP BY name")
def codon_distributions_valid(spark, d):
    """Shares of codons in each document; those of odd ones are halved, so they sum to a half."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("name")) / F.when(F.col("name").cast("long") % 2 == 0, 1).otherwise(2)
    return is_codon_distribution(_codons(spark, d).select("name", "codon", share.alias("prob")), by=("name",))


def _weights(values: dict) -> str:
    return ", ".join(f"({t}, '{c}', {p!r})" for t, pairs in values.items() for c, p in pairs)


WEIGHTED = " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM (VALUES {_weights(values)}) v(translation_table, codon, prob)" for kind, values in (("start", STARTS), ("stop", STOPS)))


@query(f"{with_views('docs')}, {CODONS} SELECT translation_table, kind, CAST(sum(n) AS BIGINT) AS n, round(sum(n * prob), 6) AS weight FROM codons_of JOIN ({WEIGHTED}) w USING (codon) WHERE prob > 0 GROUP BY ALL")
def start_and_stop_codons(spark, d):
    """How often the documents have codons that a code starts or stops with, and the same weighted by their probabilities."""
    codes = codon_frame(spark)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_prob").alias("prob")) for k in ("start", "stop")))
    ends = codes.select("translation_table", "codon", F.inline(kinds)).where("prob > 0")
    return _codons(spark, d).join(F.broadcast(ends), "codon").groupBy("translation_table", "kind").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("prob")), 6).alias("weight"))


@query()
def viterbi_path(spark, d):
    """Decoding is a recurrence along each chunk; tests hold it against enumeration of all paths."""
    few = sequences.chunks(fx.document_sequences(spark, d), 300)
    states = hmm.decode(few, hmm.GeneModel.usual())
    return states.select("seq", "strand", "chunk_no", F.array_join(F.transform("states", lambda x: x.cast("string")), ",").alias("states"))
