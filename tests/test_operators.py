"""Rules on small records: the tables of the page and document decisions, text, forms of corpus runs."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.operators import corpus, documents, ocr, pages, text
from vellum.operators.record import Facts, to_json
from vellum.plans import batch
from vellum.sources import pdf
from vellum.sources.synthesize import text_pdf
from vellum.streaming import incremental

RUNS = "doc_id string, run_id int, page int, text string, x double, y double, width double, font_size double, space_width_em double"


@pytest.mark.parametrize("runs,expected", [
    ([("proof", 0, 50, 20, 0.25), ("GLOBUS", 55, 60, 20, 0.25)], "proof GLOBUS"), ([("be", 0, 20, 20, 0.25), ("low", 20, 30, 20, 0.25)], "below"),
    ([("a", 0, 10, 20, 0.18), ("b", 13.6, 10, 20, 0.18)], "a b"), ([("a", 0, 10, 20, 0.25), (" ", 30, 5, 20, 0.25), ("b", 60, 10, 20, 0.25)], "a b"),
])
def test_spacing(spark, runs, expected):
    rows = [("d", i, 0, t, float(x), 700.0, float(w), float(s), e) for i, (t, x, w, s, e) in enumerate(runs)]
    assert text.plain_text(spark.createDataFrame(rows, RUNS)).collect()[0].text == expected + "\n\n"


def test_lines_and_pages_in_order(spark):
    rows = [("d", i, p, t, float(x), y, 5.0, 10.0, 0.25) for i, (p, t, x, y) in enumerate([(1, "z", 0, 10.0), (0, "low", 0, 10.2), (0, "b", 50, 99.6), (0, "a", 0, 100.4)])]
    assert text.plain_text(spark.createDataFrame(rows, RUNS)).collect()[0].text == "a b\nlow\n\nz\n\n"


@pytest.mark.parametrize("signals,name,sure", [
    ((5, 0.1, False, 1, True, False, 0, 0.0), "Mixed", 0.7), ((1, 0.0, False, 1, True, True, 0, 0.0), "ScannedWithOcr", 0.9), ((0, 0.0, False, 1, True, False, 0, 0.0), "ScannedImageOnly", 0.9),
    ((5, 0.1, True, 0, False, False, 12, 0.0), "Mixed", 0.7), ((0, 0.0, True, 0, False, False, 0, 0.0), "FormPage", 0.85), ((5, 0.1, False, 0, False, False, 0, 0.6), "TableOrComplexLayout", 0.7),
    ((3, 0.015, False, 0, False, False, 0, 0.0), "DigitalText", 0.55), ((9, 0.3, False, 0, False, False, 0, 0.0), "DigitalText", 0.9), ((0, 0.0, False, 0, False, False, 0, 0.0), "Empty", 1.0),
    ((0, 0.0, False, 2, False, False, 0, 0.0), "ScannedImageOnly", 0.4), ((0, 0.0, False, 0, False, False, 3, 0.0), "TableOrComplexLayout", 0.5), ((1, 0.001, False, 0, False, False, 0, 0.0), "DigitalText", 0.4), ((1, 0.0, False, 0, False, False, 0, 0.0), "Empty", 0.4),
])
def test_page_decision(spark, signals, name, sure):
    df = spark.createDataFrame([signals], "text_run_count long, text_coverage_fraction double, has_acro_form_widgets boolean, image_count long, is_image_only boolean, ocr_layer_present boolean, ruling_line_count long, column_alignment_score double")
    r = pages.decide(df).collect()[0]
    assert (r.page_class, r.page_confidence) == (name, sure)


def test_roll_up(spark):
    rows = [("a", "DigitalText"), ("a", "Empty"), ("b", "FormPage"), ("b", "Mixed"), ("c", "ScannedImageOnly"), ("c", "DigitalText"), ("d", "Empty"), ("e", "TableOrComplexLayout")]
    got = {r.doc_id: r.category for r in documents.roll_up(spark.createDataFrame(rows, "doc_id string, page_class string")).collect()}
    assert got == {"a": "DigitalText", "b": "FormBased", "c": "Mixed", "d": "DigitalText", "e": "DigitalText"}


def outcome(i, status="Processed", category="DigitalText", form=False, ocr=False, dpis=(), below=0, rejection="None"):
    return (str(i), status, category, 1, ocr, form, "None", False, False, rejection, 150, below, [float(d) for d in dpis])


OUTCOMES = "id string, status string, category string, page_count int, ocr_present boolean, form_present boolean, encryption_algorithm string, encrypted boolean, encrypted_unreadable boolean, rejection string, threshold int, below_threshold_count long, effective_dpis array<double>"


def test_aggregate(spark):
    rows = [outcome(1, dpis=[300, 300]), outcome(2, category="ScannedImageOnly", dpis=[100], below=1), outcome(3, category="FormBased", form=True), outcome(4, "Rejected", "Rejected", rejection="MissingHeader")]
    for order in (rows, rows[::-1]):
        a = corpus.aggregate(spark.createDataFrame(order, OUTCOMES)).collect()[0]
        assert (a.total, a.processed, a.rejected, a.images, a.min_dpi, a.images_below_percent, a.form_percent) == (4, 3, 1, 3, 100.0, 33.3, 33.3)
        assert [(c["name"], c["count"], c["percent"]) for c in a.categories] == [("DigitalText", 1, 25.0), ("ScannedImageOnly", 1, 25.0), ("FormBased", 1, 25.0), ("Rejected", 1, 25.0)]
        assert [(h["bucket"], h["count"]) for h in a.histogram] == [("<150", 1), ("150-299", 0), ("300-599", 2), (">=600", 0)]
    none = corpus.aggregate(spark.createDataFrame([], OUTCOMES)).collect()[0]
    assert (none.total, none.min_dpi, none.median_dpi, none.form_percent, none.threshold) == (0, 0.0, 0.0, 0.0, 150)


def test_ranks_are_counted(spark):
    """The values of ranks, ties and all, come from counts: no aggregate's buffer holds the values of all images."""
    dpis = [round(0.5 + (i * 7919 % 1300) / 8, 3) for i in range(2_000)] + [0.0] * 50
    df = spark.createDataFrame([(d, 0 < d < 150) for d in dpis], "effective_dpi double, below_threshold boolean")
    out = corpus.dpi_statistics(df)
    known = sorted(d for d in dpis if d > 0)
    r = out.first()
    assert (r.images, r.min_dpi, r.median_dpi, r.p95_dpi) == (2_000, round(known[0], 1), round(known[999], 1), round(known[1_899], 1))
    assert (r.below, r.below_percent) == (n := sum(d < 150 for d in known), round(n / 20, 1))
    for plan in (out, corpus.aggregate(spark.createDataFrame([outcome(1, dpis=[300, 100])], OUTCOMES))):
        assert "percentile" not in plan._jdf.queryExecution().toString()
    assert tuple(corpus.dpi_statistics(df.where("effective_dpi < 0")).first()) == (0, 0.0, 0.0, 0.0, 0, 0.0)


def test_rates(spark):
    rows = [("de", "hello", "hallo", 0.95), ("de", "", "garbage", 0.4), (None, "", "", 0.6), ("en", "two words", "two extra words", 0.9), ("en", "a  　 b", "a b", 1.0), ("en", None, None, None)]
    m = ocr.measured(spark.createDataFrame(rows, "language string, reference string, hypothesis string, confidence double")).collect()
    assert [round(r.cer, 3) for r in m[:3]] == [0.2, 1.0, 0.0]
    assert [round(r.wer, 3) for r in m[3:]] == [0.5, 0.0, 0.0]


def test_bands(spark):
    s = spark.createDataFrame([("x", "ab", "ab", 0.95), ("x", "abcde", "abxxx", 0.4)], "language string, reference string, hypothesis string, confidence double")
    got = [(r.band, r.samples, round(r.micro_cer, 2)) for r in ocr.calibration(s).orderBy("ordinal").collect()]
    assert got == [("0.0-0.5", 1, 0.6), ("0.5-0.7", 0, 0.0), ("0.7-0.9", 0, 0.0), ("0.9-1.0", 1, 0.0)]


def test_scalars(spark):
    df = spark.createDataFrame([(bytearray(b"\xfe\xff\x00A"), "😀", 6.25, -90), (bytearray(b"a\xe9"), "ab", 6.35, 450)], "b binary, s string, v double, r int")
    r = df.select(S.pdf_text(F.col("b")).alias("t"), S.utf16_length(F.col("s")).alias("n"), S.half_even(F.col("v"), 1).alias("e"), S.rotation(F.col("r")).alias("r"), S.qualified_name(F.lit("a"), F.col("s")).alias("q")).collect()
    assert [(x.t, x.n, x.r) for x in r] == [("A", 2, 270), ("aé", 2, 90)] and r[0].e == 6.2 and r[1].q == "a.ab"


def test_ledger_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a" * 4, "h", *outcome(1, dpis=[72, 200, 600], below=1)[1:], 1)], batch.LEDGER)
    line = batch.tsv(rows).collect()[0].value
    assert line.split("\t")[-1] == "72,200,600" and len(line.split("\t")) == 14
    (tmp_path / "l.tsv").write_text("short\tline\n" + line.replace("\t150\t", "\tx\t") + "\n" + line + "\n")
    got = batch.read_tsv(spark, str(tmp_path / "l.tsv")).collect()
    assert len(got) == 1 and got[0].effective_dpis == [72.0, 200.0, 600.0] and got[0].threshold == 150


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "doc1.pdf").write_bytes(text_pdf("Confidential words of the first document, enough of them\n" * 3))
    (tmp_path / "in" / "sub" / "doc2.pdf").write_bytes(text_pdf("Second document with an image and some words\n" * 2, image=True, field="v"))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"this is not a document")
    return tmp_path


def test_listing_is_in_order_of_paths(spark, folder):
    got = [r.path.rsplit("/in/", 1)[1] for r in pdf.listing(spark, str(folder / "in")).collect()]
    assert got == ["bad.pdf", "doc1.pdf", "sub/doc2.pdf"]


def test_batch_run_and_resume(spark, folder):
    o = batch.Options(str(folder / "in"), str(folder / "out"))
    a = batch.run(spark, o).collect()[0]
    assert (a.total, a.processed, a.rejected) == (3, 2, 1) and [r["name"] for r in a.rejections] == ["MissingHeader"]
    before = spark.read.parquet(f"{o.output}/ledger").count()
    batch.run(spark, o)
    assert spark.read.parquet(f"{o.output}/ledger").count() == before == 3
    (folder / "in" / "doc1.pdf").write_bytes(text_pdf("Changed"))
    a = batch.run(spark, o).collect()[0]
    assert a.total == 3 and spark.read.parquet(f"{o.output}/ledger").count() == 4
    text = "".join(p.read_text() for p in (folder / "out" / "aggregate").glob("*.txt"))
    assert "Confidential" not in text and "doc1" not in text and json.loads(text)["schemaVersion"] == "1.0"


def test_batch_exports_and_odd_names(spark, folder):
    """A JSON file for each document and an indented aggregate; a resumed run reads names with signs of patterns."""
    import hashlib

    o = batch.Options(str(folder / "in"), str(folder / "out"), perfile=True)
    batch.run(spark, o)
    odd = folder / "in" / "a [1] {b} ? *.pdf"
    odd.write_bytes(text_pdf("Odd name"))
    assert batch.run(spark, o).first().total == 4
    ids = {r.id for r in spark.read.parquet(f"{o.output}/ledger").collect()}
    files = {p.stem: json.loads(p.read_text()) for p in (folder / "out" / "perfile").iterdir()}
    assert set(files) == ids and {f["status"] for f in files.values()} == {"Processed", "Rejected"} and len(ids) == 4
    rows = {r.id: r.input_hash for r in spark.read.parquet(f"{o.output}/ledger").collect()}
    assert hashlib.sha256(odd.read_bytes()).hexdigest() in rows.values()
    text = (folder / "out" / "aggregate.json").read_text()
    assert json.loads(text)["total"] == 4 and text.startswith('{\n  "total"')


def test_word_distance_of_many_words(spark):
    """More distinct words than the basic plane has characters; a report leaves out what has no distance."""
    a = [f"w{i}" for i in range(45_000)]
    df = spark.createDataFrame([("en", " ".join(a[:20]), " ".join(a[:19]), 0.95)], "language string, reference string, hypothesis string, confidence double")
    assert ocr.measured(df).first().word_edits == 1
    big = df.selectExpr("language", "array_join(transform(sequence(0, 44999), x -> concat('w', x)), ' ') AS reference", "'w1' AS hypothesis", "confidence")
    assert ocr.measured(big).select("word_edits").first().word_edits == 44_999
    none = ocr.measured(df).withColumn("word_edits", F.lit(None).cast("int"))
    assert none.agg(ocr._figures()[-1]).first()[0] == 0.0


def test_stream_gives_the_batch_ledger(spark, folder):
    o = batch.Options(str(folder / "in"), str(folder / "s"), records=False)
    incremental.start(spark, o, str(folder / "c")).awaitTermination(120)
    (folder / "in" / "doc3.pdf").write_bytes(text_pdf("Third"))
    incremental.start(spark, o, str(folder / "c")).awaitTermination(120)
    b = batch.Options(str(folder / "in"), str(folder / "b"), records=False)
    batch.run(spark, b)
    same = lambda path: sorted((r.id, r.category, r.page_count) for r in spark.read.parquet(f"{path}/ledger").collect())
    assert same(o.output) == same(b.output) and len(same(b.output)) == 4


def test_json_has_finite_numbers(spark):
    df = spark.createDataFrame([("a", float("nan"), [1.5, float("-inf")], None)], "doc_id string, x double, xs array<double>, s struct<y:double>")
    got = to_json(df.select("doc_id", F.struct("x", F.struct("xs").alias("inner"), "s").alias("record"))).first().json
    assert json.loads(got) == {"x": 0, "inner": {"xs": [1.5, 0]}, "s": None}


def test_record_json(spark):
    made = [("a", bytearray(text_pdf("Hello there\n" * 4, ruled=True, image=True, field="x"))), ("b", bytearray(b"%PDF-1.4 broken %%EOF")), ("c", bytearray(b"no"))]
    f = Facts(spark.createDataFrame(made, "doc_id string, content binary"))
    got = {r.doc_id: json.loads(r.json) for r in to_json(f.records()).collect()}
    a = got["a"]
    assert list(a)[:5] == ["schemaVersion", "status", "rejection", "pageCount", "imageAreaFraction"] and a["rejection"] is None
    assert [c["id"] for c in a["coverage"]] == ["t0", "t1", "t2", "t3", "f0"] and a["pages"][0]["class"] == "FormPage" and a["images"][0]["filter"] == ""
    assert got["b"]["status"] == got["c"]["status"] == "Rejected" and got["b"]["rejection"]["reason"] == "XrefUnresolvable" and got["c"]["rejection"]["reason"] == "MissingHeader"
    assert got["c"]["textRuns"] == [] and got["c"]["security"]["algorithm"] == "None"
