import sys

from vellum.operators import ocr, rasters
from vellum.operators.record import Facts
from vellum.sources.engines import LineWorker, TableProgram, table_lines
from vellum.sources.synthesize import text_pdf

HEADER = "\t".join("level page_num block_num par_num line_num word_num left top width height conf text".split())
ROWS = ["4 1 1 1 1 0 5 6 70 8 -1", "5 1 1 1 1 1 5 6 20 8 90 Two", "5 1 1 1 1 2 30 6 20 8 80 words", "4 1 1 1 2 0 5 20 70 8 -1", "5 1 1 1 2 1 5 20 70 8 -1 bad", "5 1 1 1 2 2 5 20 70 8 60 one"]
TABLE = "\n".join([HEADER, *("\t".join((r.split() + [""])[:12]) for r in ROWS)])


def test_word_table():
    assert table_lines(TABLE) == [("Two words", 5, 6, 70, 8, 0.85), ("one", 5, 20, 70, 8, 0.6)]
    assert table_lines("") == [] and table_lines(HEADER + "\n5\tx") == []


def test_program_and_worker_over_documents(spark):
    f = Facts(spark.createDataFrame([("a", bytearray(text_pdf("x", image=True)))], "doc_id string, content binary"), facets=("document", "page", "run", "image", "field", "xobject"))
    images = rasters.decode(f.xobjects)
    program = TableProgram([sys.executable, "-c", f"import sys; assert sys.stdin.buffer.read(2) == b'BM'; print({TABLE!r})"])
    assert sorted(r.text for r in rasters.recognize(images, program).collect()) == ["Two words", "one"]
    worker = LineWorker([sys.executable, "-u", "-c", "import sys, base64, json\nfor line in sys.stdin: print(json.dumps([{'text': str(len(base64.b64decode(line))), 'confidence': 0.7}]))"])
    lines = rasters.recognize(images, worker, 0.5)
    assert [r.text for r in lines.collect()] == [str(54 + 8 * 24)]
    merged = ocr.merge(f.runs.selectExpr("doc_id", "page", "text", "CAST(NULL AS string) AS source"), lines.select("doc_id", "page", "text", "confidence"))
    assert sorted((r.text, r.source) for r in merged.collect()) == [("246", "OcrGenerated"), ("x", "Embedded")]
    broken = LineWorker([sys.executable, "-c", "pass"])
    assert rasters.recognize(images, broken).count() == 0
