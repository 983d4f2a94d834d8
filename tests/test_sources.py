"""The data sources: FASTA by byte ranges, workbooks, reports that are replaced as a whole."""

import datetime
import gzip
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from codonlake.plans import fixtures as X
from codonlake.plans import pipeline
from codonlake.sources import fasta, files, readers, report, store, workbook


# ---- FASTA
def plain_records(data):
    """(header, seq, place) by lines."""
    out, place = [], 0
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            out.append([line[1:].decode().strip(), "", place])
        elif out:
            out[-1][1] += "".join(line.decode().split())
        place += len(line) + 1
    return [tuple(r) for r in out]


def odd_fasta(seed, end=b"\n", n=60):
    rng = random.Random(seed)
    lines = [b"before any record", b""] if seed % 2 else []
    for i in range(n):
        lines.append(f">r{i} [gene=é{'>' * (i % 3)}x] p ".encode())
        for _ in range(rng.randrange(5)):
            lines.append(b"" if rng.random() < 0.2 else "".join(rng.choices("ACGT", k=rng.randrange(1, 90))).encode() + b" " * (i % 2))
    return end.join(lines) + (end if seed % 3 else b"")


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fasta_ranges_own_every_record_once(tmp_path, end, seed):
    data = odd_fasta(seed, end)
    path = tmp_path / "x.fa"
    path.write_bytes(data)
    want = plain_records(data)
    for split in (1, 2, 3, 7, 64, 1000, 10**6):
        for block in (1, 5, 4096):
            if split * block < 8:
                continue
            got = []
            for a in range(0, len(data), split):
                with files.opened(str(path)) as f:
                    for start, text in fasta.records(f, a, min(a + split, len(data)), block):
                        head, _, body = text.partition(b"\n")
                        got.append((head.decode().strip(), body.translate(None, fasta.WHITE).decode(), start))
            assert got == want, (split, block)


def test_fasta_source(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "below").mkdir(parents=True)
    one, two = odd_fasta(1), odd_fasta(2, b"\r\n")
    (folder / "a.fa").write_bytes(one)
    (folder / "below" / "b.fa").write_bytes(two)
    (folder / "c.fa.gz").write_bytes(gzip.compress(one))
    (folder / "_SUCCESS").write_bytes(b">not read\n")
    (folder / "empty.fa").write_bytes(b"")
    want = sorted(r[:2] for data in (one, two, one) for r in plain_records(data))
    for split in (50, fasta.SPLIT):
        read = readers.fasta(spark, str(folder), split)
        assert sorted(tuple(r) for r in read.collect()) == want
        assert read.rdd.getNumPartitions() == (3 if split > 50 else 1 + sum(-(-len(d) // 50) for d in (one, two)))
    full = spark.read.format("fasta").load(f"file://{folder}/a.fa")
    assert [tuple(r) for r in full.select("header", "seq", "start").orderBy("start").collect()] == plain_records(one)
    assert {r["path"] for r in full.select("path").distinct().collect()} == {f"file://{folder}/a.fa"}
    assert spark.read.format("fasta").schema("header string").load(f"{folder}/a.fa").count() == 60
    with pytest.raises(Exception, match="no columns other"):
        spark.read.format("fasta").schema("other string").load(f"{folder}/a.fa").collect()
    with pytest.raises(Exception, match="nowhere"):
        readers.fasta(spark, f"{folder}/nowhere").collect()


def test_stores_that_only_spark_reaches():
    assert files.known("/a/b") and files.known("file:///a") and files.known("s3://b/c") and files.known("a:b/c") is False and not files.known("viewfs://store/in")
    assert files.known("/a:b/c") and files.placed("file:/a/b")[1] == files.placed("file:///a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="Spark's own readers"):
        files.placed("viewfs://store/in")


# ---- workbooks
STRINGS = ["gene", "tx_sequence", "day", "ok", "size", "value", "mixed", "gene", "ACGT", "a_x000A_b", "<&>", "deep"]
SHARED = "".join(f"<si><t>{s.replace('&', '&amp;').replace('<', '&lt;')}</t></si>" for s in STRINGS[:-1]) + "<si><r><t>de</t></r><r><t xml:space='preserve'>ep</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si>"
SHEET = """<x:worksheet xmlns:x="m"><x:sheetData>
<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="B1" t="s"><x:v>1</x:v></x:c><x:c r="C1" t="s"><x:v>2</x:v></x:c><x:c r="D1" t="s"><x:v>3</x:v></x:c><x:c r="E1" t="s"><x:v>4</x:v></x:c><x:c r="F1" t="s"><x:v>5</x:v></x:c><x:c r="G1" t="s"><x:v>6</x:v></x:c><x:c r="H1" t="s"><x:v>7</x:v></x:c><x:c r="J1" t="inlineStr"><x:is><x:t>last</x:t></x:is></x:c></x:row>
<x:row r="2"><x:c r="A2"><x:v>1</x:v></x:c><x:c r="B2" t="s"><x:v>8</x:v></x:c><x:c r="C2" s="1"><x:v>45000.5</x:v></x:c><x:c r="D2" t="b"><x:v>1</x:v></x:c><x:c r="E2"><x:v>3</x:v></x:c><x:c r="F2"><x:v>2.5E-1</x:v></x:c><x:c r="G2"><x:v>7</x:v></x:c><x:c r="H2" t="e"><x:v>#N/A</x:v></x:c></x:row>
<x:row r="5"><x:c><x:v>-2</x:v></x:c><x:c t="s"><x:v>9</x:v></x:c><x:c r="D5" t="b"><x:v>0</x:v></x:c><x:c r="F5"><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c r="G5" t="s"><x:v>10</x:v></x:c><x:c r="H5" t="str"><x:v>computed</x:v></x:c><x:c r="J5" t="inlineStr"><x:is><x:r><x:t>in</x:t></x:r><x:r><x:t>line</x:t></x:r></x:is></x:c><x:c r="AB5"><x:v>9</x:v></x:c></x:row>
<x:row r="6"/><x:row r="7"><x:c r="B7" t="s"><x:v>11</x:v></x:c><x:c r="E7"><x:v>4</x:v></x:c></x:row>
</x:sheetData></x:worksheet>"""


def made_workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="o"><workbookPr/><sheets><sheet name="Notes" r:id="rId7"/><sheet name="Data" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet2.xml"/><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst>{SHARED}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>')
    return str(path)


def test_workbook_types_and_cells(spark, tmp_path):
    path = made_workbook(tmp_path / "x.xlsx")
    data = workbook.register(spark).read.format("workbook").option("sheet", "Data").load(path)
    assert data.dtypes == [("gene", "bigint"), ("tx_sequence", "string"), ("day", "timestamp_ntz"), ("ok", "boolean"), ("size", "bigint"), ("value", "double"), ("mixed", "string"), ("gene_7", "string"), ("_c8", "string"), ("last", "string")]
    rows = [tuple(r) for r in data.collect()]
    assert rows == [
        (1, "ACGT", datetime.datetime(2023, 3, 15, 12), True, 3, 0.25, "7", None, None, None), (-2, "a\nb", None, False, None, 2.0, "<&>", "computed", None, "inline"), (None,) * 10, (None, "deep", None, None, 4, None, None, None, None, None),
    ]
    assert [r[0] for r in spark.read.format("workbook").option("header", False).load(path).collect()] == ["only"] and spark.read.format("workbook").load(path).count() == 0
    with pytest.raises(Exception, match="no sheet 'None here'"):
        spark.read.format("workbook").option("sheet", "None here").load(path)
    asked = spark.read.format("workbook").schema("absent int, value float, gene string, mixed long, size tinyint").option("sheet", 1).load(path)
    assert [tuple(r) for r in asked.collect()] == [(None, 0.25, "1", 7, 3), (None, 2.0, "-2", None, None), (None,) * 5, (None, None, None, None, 4)]


def test_columns_that_are_not_asked_for_are_not_parsed(tmp_path, monkeypatch):
    from pyspark.sql.types import LongType, StructField, StructType

    seen, asked = [], []
    value, shared = workbook.Workbook.value, workbook.Workbook.shared
    monkeypatch.setattr(workbook.Workbook, "value", lambda self, cell, kind, strings: seen.append(cell.column) or value(self, cell, kind, strings))
    monkeypatch.setattr(workbook.Workbook, "shared", lambda self, wanted: asked.append(set(wanted)) or shared(self, wanted))
    path = made_workbook(tmp_path / "x.xlsx")
    reader = workbook.Reader(StructType([StructField("size", LongType())]), {"path": path, "sheet": "Data"})
    (batch,) = reader.read(reader.partitions()[0])
    assert batch.column(0).to_pylist() == [3, None, None, 4] and set(seen) == {4} and asked[-1] == set()


def test_workbook_round_trip(spark, tmp_path):
    odd = ["", " a ", "x\ty\r\nz", "_x0041_", "\x01\x0b￿", "<&>\"'", "\U0001f600", None]
    rows = [(i, t, i / 3 if i % 3 else None, bool(i % 2), datetime.datetime(2020, 2, 29, 1, 2, 3) if i % 2 else None, 2**62 + i) for i, t in enumerate(odd * 3)]
    df = spark.createDataFrame(rows, "id long, text string, x double, b boolean, t timestamp_ntz, big long").repartition(3)
    path = str(tmp_path / "books")
    for _ in range(2):
        workbook.register(spark).read  # noqa: B018
        df.write.format("workbook").mode("overwrite").option("rows", 5).save(path)
    assert sorted(os.listdir(tmp_path)) == ["books"] and len(os.listdir(path)) >= 6
    back = spark.read.format("workbook").schema(df.schema).load(path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r[0], r[1], *r[2:]) for r in rows), key=str)
    df.limit(2).write.format("workbook").mode("append").save(path)
    assert spark.read.format("workbook").schema(df.schema).load(path).count() == len(rows) + 2


def test_transcripts_of_a_workbook(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ACGT" * i, i, 3 * i, i % 3, float(i) if i else None, "note") for i in range(20)], "gene_id long, tx_sequence string, utr5_size int, cds_size int, fold int, TE_4T1 double, note string")
    workbook.register(spark)
    rows.coalesce(1).write.format("workbook").mode("overwrite").save(str(tmp_path / "w"))
    os.rename(tmp_path / "w" / os.listdir(tmp_path / "w")[0], tmp_path / "mouse.xlsx")
    found = pipeline.datasets(spark, str(tmp_path))["mouse"]
    read = readers.transcripts(spark, found.path, found.target)
    assert sorted(map(tuple, read.collect())) == sorted((i, "ACGT" * i or None, i, 3 * i, i % 3, float(i) if i else None) for i in range(20)) or read.filter("gene_id = 0").first()["tx_sequence"] == ""
    assert read.count() == 20


# ---- reports
def test_report_is_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "eval_results.csv")
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") / 3).alias("x"), F.concat(F.lit('a,"'), F.col("id")).alias("s")).repartition(6)
    assert store.write_csv(rows, path, order=["id"]) == path
    lines = open(path).read().split("\n")
    assert lines[:4] == ["id,x,s", '0,,"a,""0"', '1,0.3333333333333333,"a,""1"', '2,0.6666666666666666,"a,""2"'] and len(lines) == 1002 and [x.split(",")[0] for x in lines[1:-1]] == [str(i) for i in range(1000)]
    assert os.listdir(tmp_path) == ["eval_results.csv"]
    store.write_csv(rows.filter("id < 0"), path, sep="\t")
    assert open(path).read() == "id\tx\ts\n"


def test_a_failed_report_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "top.csv")
    store.write_csv(spark.range(3).toDF("old"), path)
    before = open(path).read()
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3500, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("new"))
    with pytest.raises(Exception, match="broken"):
        store.write_csv(bad, path)
    assert open(path).read() == before and os.listdir(tmp_path) == ["top.csv"]
    with pytest.raises(Exception, match="overwrite"):
        report.register(spark).range(1).write.format("report").mode("append").save(path)
    assert open(path).read() == before


def test_a_folder_of_the_same_name_gives_way(spark, tmp_path):
    (tmp_path / "r.csv").mkdir()
    (tmp_path / "r.csv" / "part-0").write_text("old")
    store.write_csv(spark.range(2).toDF("n"), f"file://{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_text() == "n\n0\n1\n"


def test_build_cai_reads_fasta_by_ranges_and_merges_from_disk(spark, sf, tmp_path):
    records = X.cds_records(spark, sf).collect()
    paths = {}
    for k, species in enumerate(("human", "mouse")):
        paths[species] = str(tmp_path / f"{species}.fa")
        with open(paths[species], "w") as f:
            f.writelines(f">{r['header']}\n{r['seq'][:40]}\n{r['seq'][40:]}\n" for r in records if r["rec_id"] % 2 == k or r["rec_id"] % 5 < 2)
    out = str(tmp_path / "out")
    assert pipeline.build_cai(spark, paths, out) == f"{out}/combined_cai_weights.csv"
    assert {f for _, _, fs in os.walk(out) for f in fs} == {"reference_genes.tsv", "rscu_table.csv", "cai_weights.csv", "combined_cai_weights.csv"}
    both = {r["codon"]: r for r in readers.table(spark, f"{out}/combined_cai_weights.csv", readers.CAI_TABLES).collect()}
    human = {r["codon"]: r["cai_weight"] for r in readers.table(spark, f"{out}/human/cai_weights.csv", "codon string, amino_acid string, cai_weight double").collect()}
    assert len(both) == 61 and {c: r["cai_weight_human"] for c, r in both.items()} == human
