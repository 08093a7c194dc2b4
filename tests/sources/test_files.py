import gzip

import pytest

from spanforge.operators.frames import contig_table
from spanforge.sources import text, vcf

VCF = """##fileformat=VCFv4.3
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
chr2\t10\trs1\tA\tT,G\t30\tPASS\tDP=5;DB\tGT:AD\t0/1:3,1,0\t./.
chr1\t7\t.\tAC\tA\t.\t.\t.\tGT\t0/0\t0/1
"""


@pytest.fixture
def contigs(spark):
    return contig_table(spark.createDataFrame([("chr2", "2", 100, 0, 0), ("chr1", "1", 50, 1, 100)], "chrom string, chr_name string, length bigint, idx int, cum_start bigint"))


def test_tsv_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Chromosome\tStart\tEnd\tx\n# note\nchr1\t1\t5\t\nchr2\t2\tbad\ty\n\n")
    assert [tuple(r) for r in text.read_tsv(spark, f"{tmp_path}/a.tsv").collect()] == [("chr1", 1, 5, None), ("chr2", 2, None, "y")]
    with gzip.open(tmp_path / "b.bed.gz", "wt") as f:
        f.write("chr1\t1\t5\tn\r\n")
    assert text.read_tsv(spark, f"{tmp_path}/b.bed.gz").columns == ["Chromosome", "Start", "End", "Name"]
    assert text.read_tsv(spark, f"{tmp_path}/b.bed.gz", ["value"]).first().value == "n"
    with pytest.raises(ValueError):
        text.read_tsv(spark, f"{tmp_path}/b.bed.gz", ["a", "b"])
    (tmp_path / "c.tsv").write_text("chrom\tbegin\tend\n")
    with pytest.raises(ValueError):
        text.read_tsv(spark, f"{tmp_path}/c.tsv")
    (tmp_path / "d.tsv").write_text("")
    assert text.read_tsv(spark, f"{tmp_path}/d.tsv").count() == 0


def test_round_trip_in_contig_order(spark, tmp_path, contigs):
    df = spark.createDataFrame([("chr1", 1, 2, None), ("chr2", 5, 6, "b"), ("chr2", 3, 4, "a")], "Chromosome string, Start bigint, End bigint, note string")
    text.write_tsv(df.coalesce(1), f"{tmp_path}/o", contigs)
    back = text.read_tsv(spark, f"{tmp_path}/o")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    text.write_bed(df, f"{tmp_path}/bed", contigs)
    assert text.read_tsv(spark, f"{tmp_path}/bed").count() == 3
    text.save_tables({"t": df}, f"{tmp_path}/s", "Chromosome")
    assert text.load_tables(spark, f"{tmp_path}/s", ["t"])["t"].count() == 3


def test_mosdepth(spark, tmp_path):
    with gzip.open(tmp_path / "x.regions.bed.gz", "wt") as f:
        f.write("chr1\t0\t500\t31.5\n")
    assert tuple(text.read_mosdepth(spark, f"{tmp_path}/x.regions.bed.gz").first()) == ("chr1", 0, 500, 31.5)
    with pytest.raises(ValueError):
        text.read_mosdepth(spark, f"{tmp_path}/x.bed")


def test_vcf(spark, tmp_path, contigs):
    (tmp_path / "a.vcf").write_text(VCF)
    t = vcf.read(spark, f"{tmp_path}/a.vcf")
    r = {x.CHROM: x for x in t.collect()}
    assert (r["chr2"].ALTS, r["chr2"].QUAL, r["chr2"].FILTERS, r["chr2"].INFO) == (["T", "G"], 30.0, ["PASS"], {"DP": "5"})
    assert r["chr2"].samples == {"A": {"GT": "0/1", "AD": "3,1,0"}, "B": {"GT": "./.", "AD": None}}
    assert (r["chr1"].ID, r["chr1"].QUAL, r["chr1"].FILTERS, r["chr1"].INFO) == (None, None, None, None)
    w = vcf.wide(t, ["A", "B"], 3)
    row = w.where("Chromosome = 'chr2'").first()
    assert (row["A:::REF_vaf"], row["A:::ALT1_vaf"], row["B:::ALT1_vaf"], row.ALT2) == (0.75, 0.25, None, "G")
    assert vcf.sample_columns(w, ["A"], ["REF_vaf"]).columns == ["A:::REF_vaf"] and vcf.allele_columns(w) == ["REF", "ALT1", "ALT2"]
    assert [x.POS for x in t.where(vcf.in_region("chr1", 7, 9)).collect()] == [7] and t.where(vcf.in_region("chr1", 7, 9, by_span=False)).count() == 0
    vcf.write(t, f"{tmp_path}/out", contigs, ["A", "B"])
    assert vcf.read(spark, f"{tmp_path}/out").count() == 2
    vcf.write_table(w, f"{tmp_path}/tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").columns[:2] == ["CHROM", "POS"]
    assert vcf.merge_headers([{"DP": {"Type": "Integer"}, "X": {"Type": "String"}}, {"X": {"Type": "Float"}}]) == {"DP": {"Type": "Integer"}}


def test_other_formats(spark, contigs):
    one = lambda s: spark.createDataFrame([(s,)], "line string")
    assert tuple(text.cytobands(one("chr1\t0\t9\tp11\tgneg")).first()) == ("chr1", 0, 9, "p11", "gneg")
    assert tuple(text.assembly_regions(one("PAR#1\tX\t10001\t2781479\tPAR")).first()) == ("X", 10000, 2781479, "PAR#1")
    g = text.gff_features(one("chr1\t.\tgene\t11\t20\t.\t-\t.\tID=g;Name=n=1;bad")).first()
    assert (g.Start, g.End, g.attributes) == (10, 20, {"ID": "g", "Name": "n=1"})
