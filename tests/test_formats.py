import gzip

import pytest
from pyspark.sql import functions as F

from strandline.operators import transcripts as tr
from strandline.plans.convert import annotation_lines, convert, format_of, load_annotation
from strandline.sources import readers, writers
from strandline.streaming.classify import annotated_stream, classified_stream, label_counts
from test_annotations import SAMPLE, annotation, points


def structure(rows):
    return sorted((r.seq, r.strand, tuple(tuple(c) for c in r.cds)) for r in rows.collect())


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first record\r\nACGT\r\nacg\n>empty\n>two\nNNN\n")
    rows = readers.read_fasta(spark, f"file://{tmp_path}/a.fa").orderBy("seq_ord").collect()
    assert [(r.name, r.sequence) for r in rows] == [("one", "ACGTacg"), ("empty", ""), ("two", "NNN")]
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAC\nGT\n")
    assert readers.read_fasta(spark, f"file://{tmp_path}/b.fa.gz").first().sequence == "ACGT"
    assert [r.name for r in readers.read_fasta(spark, f"file://{tmp_path}/a.fa", include=["one", "two"], exclude=["two"]).collect()] == ["one"]
    assert readers.read_fasta(spark, f"file://{tmp_path}/a.fa", split_name=False).orderBy("seq_ord").first().name == "one first record"
    assert readers.fasta_from_string(spark, "AC\nGT").first().sequence == "ACGT"
    genome = spark.createDataFrame([("x", 0, "ACGT" * 50), ("y", 1, "A" * 80)], "name string, seq_ord long, sequence string")
    writers.write_fasta(genome, f"file://{tmp_path}/out", gzip=True)
    assert sorted((r.name, r.sequence) for r in readers.read_fasta(spark, f"file://{tmp_path}/out").collect()) == [("x", "ACGT" * 50), ("y", "A" * 80)]
    with pytest.raises(Exception, match="exists"):
        writers.write_fasta(genome, f"file://{tmp_path}/out")


def test_genepred_parsing(spark, tmp_path):
    (tmp_path / "a.gp").write_text("# comment\n\nt1\tchr1\t+\t5\t90\t12\t80\t2\t30,10,\t40,20,\tmore\nt2\tchr1\t-\t5\t9\t5\t9\t0\t\t\n")
    rows = readers.read_genepred(spark, f"file://{tmp_path}/a.gp").collect()
    assert [(r.tx_name, [tuple(c) for c in r.cds]) for r in rows] == [("t1", [(10, 20), (30, 40)]), ("t2", [])]
    cut = readers.read_genepred(spark, f"file://{tmp_path}/a.gp", use_cds_bounds=True).first()
    assert [tuple(c) for c in cut.cds] == [(12, 20), (30, 40)]


@pytest.mark.parametrize("kind", ["gp", "gtf", "gff3"])
def test_round_trips(spark, tmp_path, kind):
    rows = annotation(spark, SAMPLE)
    path = f"file://{tmp_path}/out.{kind}"
    convert(rows, path)
    assert structure(load_annotation(spark, path)) == structure(rows)
    convert(path, f"file://{tmp_path}/again.gtf", spark)
    assert structure(readers.read_gtf(spark, f"file://{tmp_path}/again.gtf")) == structure(rows)
    if kind != "gp":
        assert load_annotation(spark, path).groupBy("gene").count().count() == 2


def test_lines(spark):
    gtf = [r.line.split("\t") for r in annotation_lines(annotation(spark, SAMPLE[:1]), "gtf").orderBy("gene_id", "transcript_id", "rank").collect()]
    assert [(x[2], x[3], x[4], x[7]) for x in gtf] == [
        ("gene", "11", "40", "."), ("transcript", "11", "40", "."), ("start_codon", "11", "13", "0"), ("stop_codon", "38", "40", "0"),
        ("CDS", "11", "20", "0"), ("exon", "11", "20", "0"), ("intron", "21", "30", "."), ("CDS", "31", "40", "2"), ("exon", "31", "40", "2"),
    ]
    gff = [r.line for r in annotation_lines(annotation(spark, SAMPLE[:1]), "gff3").orderBy(F.col("gene_id").asc_nulls_first(), "transcript_id", "rank").collect()]
    assert gff[0] == "##gff-version 3" and gff[3].endswith("ID=g1_t1.CDS.1;Parent=g1_t1") and len(gff) == 7
    gp = annotation_lines(annotation(spark, [*SAMPLE[:1], (9, "+", [])]), "gp").collect()
    assert [r.line for r in gp] == ["g1_t1\tchr1\t+\t10\t40\t10\t40\t2\t10,30,\t20,40,"]
    with pytest.raises(ValueError):
        format_of("x.bed")


def test_records_and_index(spark, tmp_path):
    genome = spark.createDataFrame([("chr1", 0, "ATGAAAGTCTAA")], "name string, seq_ord long, sequence string")
    rows = tr.named(tr.numbered(annotation(spark, [(0, "+", [(0, 6), (9, 12)]), (1, "-", [(0, 6)])])))
    assert [r.line for r in writers.record_lines(rows, genome, "protein").orderBy("gene_id").collect()] == [">g1|g1_t1|chr1:0-12(+)\nMK", ">g2|g2_t1|chr1:0-6(-)\nFH"]
    writers.write_index(annotation(spark, SAMPLE), f"file://{tmp_path}/index")
    assert spark.read.parquet(f"file://{tmp_path}/index").where("seq = 'chr1' AND tx_start < 50").count() == 2


def test_tmap_and_stats(spark, tmp_path):
    rows = spark.createDataFrame([("=", "12")], "class_code string, len string")
    writers.write_tmap(rows, f"file://{tmp_path}/tmap")
    assert readers.read_tmap(spark, f"file://{tmp_path}/tmap").first().len == "12"
    lines = ["        Base level:    93.1     |    -nan    |", "Intron chain level:    -nan     |    50.0    |", "       Locus level:    10.0     |    20.0    |", "          Missed loci:       1/8	( 12.5%)", "          Novel exons:       0/9	(  0.0%)"]
    got = {r.level: r for r in readers.parse_stats(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["base"].sensitivity == 93.1 and got["base"].precision == 0 and got["intron_chain"].sensitivity != got["intron_chain"].sensitivity
    assert got["locus"].missed == 0.125 and got["locus"].novel is None


def test_streams(spark, tmp_path):
    places = points(spark, [15, 25, 110])
    places.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(places.schema).parquet(f"file://{tmp_path}/in")
    classified_stream(stream, annotation(spark, SAMPLE), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert sorted((r.pos, r.fwd, r.rev) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(15, "cds", "intergenic"), (25, "intron", "intergenic"), (110, "intergenic", "cds")]
    again = spark.readStream.schema(places.schema).parquet(f"file://{tmp_path}/in")
    annotated_stream(again, lambda rows: rows.select("seq"), f"file://{tmp_path}/out2", f"file://{tmp_path}/state2").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out2").count() == 3
    timed = spark.createDataFrame([("cds", "intron")], "fwd string, rev string").withColumn("ts", F.timestamp_seconds(F.lit(10)))
    assert label_counts(timed).first().n == 1
