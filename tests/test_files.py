"""Real files: scanning, decoding, the batch run and streams."""

import os

import pytest
from pyspark.sql import functions as F

from inkveil.operators import audit
from inkveil.plans import pipeline
from inkveil.sources import files
from inkveil.streaming import deidentify as stream
from tests.test_joins import rule_table

CONTENTS = {
    "a.txt": "电话13812345678。".encode(),
    "sub/b.TXT": "卡6222021234567890 é".encode(),
    "sub/deep/gbk.txt": "电话13812345678，你好".encode("gbk"),
    "latin.txt": "caf\xe9 \xff x@y.com".encode("latin-1"),
    "empty.txt": b"",
    "blank.txt": " \n　\t".encode(),
    "bom.txt": "﻿x".encode(),
    "notes.md": b"# 13812345678",
    "scan.pdf": b"%PDF",
    "skip.exe": b"MZ",
}


def write_tree(folder):
    for name, raw in CONTENTS.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(raw)


def outcome_of(spark, tmp_path, **options):
    write_tree(str(tmp_path / "in"))
    folder = str(tmp_path / "in")
    outcome = pipeline.process_folder(spark, folder, "/out", rule_table(spark), **options)
    return {r["out_path"]: r for r in outcome.collect()}, outcome


def test_batch_run_over_a_tree(spark, tmp_path):
    rows, outcome = outcome_of(spark, tmp_path)
    texts = {path: r["deid_text"] for path, r in rows.items()}
    assert texts == {
        "/out/a_desensitized.txt": "电话138****5678。",
        "/out/sub/b_desensitized.TXT": "卡6222021234567890 é",
        "/out/sub/deep/gbk_desensitized.txt": "电话138****5678，你好",
        "/out/latin_desensitized.txt": "caf\xe9 \xff [邮箱]",
        "/out/empty_desensitized.txt": None,
        "/out/blank_desensitized.txt": None,
        "/out/bom_desensitized.txt": "﻿x",
        "/out/notes_desensitized.md": "# 138****5678",
        "/out/scan_desensitized.pdf": None,
    }
    summary = audit.batch_summary(outcome).first()
    assert (summary["total_files"], summary["successful_files"], summary["failed_files"], summary["ok"]) == (9, 6, 3, False)
    errors = {os.path.basename(r["file"]): r["error"] for r in audit.batch_errors(outcome).collect()}
    assert errors == {
        "empty.txt": "Parsing error: TXT file is empty",
        "blank.txt": "Parsing error: No text content found in TXT file",
        "scan.pdf": "Parsing error: Read by the assembly operators: pdf",
    }


def test_strict_refuses_markdown(spark, tmp_path):
    rows, _ = outcome_of(spark, tmp_path, strict=True)
    assert rows["/out/notes_desensitized.md"]["error_code"] == "UNSUPPORTED_FORMAT"


def test_encodings_are_named(spark):
    raw = [(name, raw) for name, raw in CONTENTS.items()]
    decoded = files.decode_text(spark.createDataFrame(raw, "name string, content binary"))
    names = {r["name"]: (r["encoding"], r["error_code"]) for r in decoded.collect()}
    assert names["a.txt"] == ("utf-8", None)
    assert names["sub/deep/gbk.txt"] == ("gbk", None)
    assert names["latin.txt"] == ("latin-1", None)
    assert names["empty.txt"][1] == "EMPTY_DOCUMENT" and names["blank.txt"][1] == "NO_CONTENT"


def test_utf16_and_undecodable_bytes(spark):
    text = "电话13812345678 a@b.com"
    raws = {
        "utf-16": text.encode("utf-16"),
        "utf-16be": b"\xfe\xff" + text.encode("utf-16-be"),
        "utf-32": text.encode("utf-32"),
        "no mark": "13812345678 a@b.com".encode("utf-16-le"),
        "noise": bytes(range(128, 256)) + b"\x00\x01",
        "nul": b"a\x00b",
    }
    decoded = files.decode_text(spark.createDataFrame(list(raws.items()), "name string, content binary"))
    rows = {r["name"]: r for r in decoded.collect()}
    assert [rows[n]["text"] for n in ("utf-16", "utf-16be", "utf-32")] == [text] * 3
    assert {rows[n]["error_code"] for n in ("no mark", "noise", "nul")} == {"ENCODING_ERROR"}


def test_targets_keep_the_tree_for_every_form_of_folder(spark, tmp_path, monkeypatch):
    for name in ("a/x.txt", "b/x.txt", "b/with space %41.txt", "b/empty%41 file.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("" if "empty" in name else "text")
    folder = str(tmp_path / "in")
    for form in (folder, folder + "/", f"file:{folder}", f"file://{folder}/"):
        outcome = pipeline.process_folder(spark, form, "/out", rule_table(spark)).collect()
        assert sorted(r["out_path"] for r in outcome) == [
            "/out/a/x_desensitized.txt", "/out/b/empty%41 file_desensitized.txt",
            "/out/b/with space %41_desensitized.txt", "/out/b/x_desensitized.txt",
        ]
    assert pipeline.qualified(spark, "some/folder").startswith("file:/")


def test_uploads_of_one_name_are_tasks_of_their_own(spark):
    rows = spark.createDataFrame([("a.txt", 1, ".txt")] * 3 + [("a.txt", 2, ".txt"), ("b.txt", 1, ".txt")], "filename string, size bigint, ext string")
    made = files.register_task(rows, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert made.select("id").distinct().count() == 5


def test_oversized_files_are_listed_but_not_read(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 21)
    (tmp_path / "ok.txt").write_bytes(b"y" * 20)
    found = files.scan_files(spark, str(tmp_path), max_size=20)
    rows = {os.path.basename(r["path"]): r for r in found.collect()}
    assert rows["big.txt"]["content"] is None and rows["big.txt"]["length"] == 21
    assert rows["ok.txt"]["content"] == b"y" * 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,20)" in plan
    assert {len(r["content"]) for r in files.scan_files(spark, str(tmp_path)).collect()} == {20, 21}


def test_only_readable_types_are_read(spark, tmp_path):
    write_tree(str(tmp_path))
    found = files.scan_files(spark, str(tmp_path), empty=False)
    assert {os.path.basename(r["path"]): r["content"] is None for r in found.collect()} == {
        "a.txt": False, "b.TXT": False, "gbk.txt": False, "latin.txt": False, "blank.txt": False, "bom.txt": False, "notes.md": False,
        "scan.pdf": True,
    }
    assert files.any_case_glob([".txt", ".md"]) == "*{.[tT][xX][tT],.[mM][dD]}"


def test_scan_does_not_read_unused_contents(spark, tmp_path):
    write_tree(str(tmp_path))
    found = files.scan_files(spark, str(tmp_path), empty=False)
    assert "content" not in found.select("path")._jdf.queryExecution().executedPlan().toString()


def test_line_count_follows_all_line_breaks(spark):
    from inkveil.functions.text import line_count

    texts = ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h i j", "\n\n", "a\n\r\nb\r"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_count("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [len(r["t"].splitlines()) for r in rows]


def test_strip_follows_unicode_white_space(spark):
    from inkveil.functions.text import not_blank, strip_blank

    chars = [chr(c) for c in [*range(1, 0x3100), 0xFEFF] if not 0xD800 <= c < 0xE000]
    texts = [c + "x" + c for c in chars] + chars
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", strip_blank("t").alias("s"), not_blank("t").alias("b")).collect()
    assert all(r["s"] == r["t"].strip() and r["b"] == bool(r["t"].strip()) for r in rows)


def test_paths_and_extensions(spark):
    from inkveil.functions.text import export_filename, file_ext

    names = ["a.txt", "a.TXT", ".txt", "..txt", "a", "a.", "d.x/a", "d/.hid.md", "a.tar.gz", "", "a..b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", file_ext("n").alias("e"), export_filename("n", "'md'", "timestamp'2024-01-02 03:04:05'").alias("x")
    )
    for r in rows.collect():
        assert r["e"] == os.path.splitext(r["n"])[1].lower()
        base = r["n"].rsplit(".", 1)[0] if "." in r["n"] else r["n"]
        assert r["x"] == f"{base}_desensitized_20240102_030405.md"


def test_stream_continues_where_it_stopped(spark, tmp_path):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    audit_dir, checkpoint = str(tmp_path / "audit"), str(tmp_path / "checkpoint")
    docs = spark.createDataFrame([(i, f"电话1381234567{i}") for i in range(4)], "doc_id bigint, text string")

    def run():
        arriving = spark.readStream.schema("doc_id bigint, text string").parquet(str(incoming))
        stream.stream_deidentify(arriving, rule_table(spark), out, audit_dir, checkpoint).awaitTermination()

    docs.where("doc_id < 2").write.parquet(str(incoming))
    run()
    run()  # nothing new
    docs.where("doc_id >= 2").write.mode("append").parquet(str(incoming))
    run()
    rows = spark.read.parquet(out).orderBy("doc_id").collect()
    assert [r["deid_text"] for r in rows] == [f"电话138****567{i}" for i in range(4)]
    logs = spark.read.parquet(audit_dir)
    assert logs.count() == 4
    assert {r["n"] for r in logs.select(F.get_json_object("details", "$.desensitized_items").alias("n")).collect()} == {"1"}


def test_files_stream(spark, tmp_path):
    write_tree(str(tmp_path / "in"))
    incoming = stream.read_files_stream(spark, str(tmp_path / "in"))
    stream.stream_files(incoming, rule_table(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == len(CONTENTS) - 1  # files of zero bytes are not listed
    codes = {r["error_code"]: r["count"] for r in done.groupBy("error_code").count().collect()}
    assert (codes["UNSUPPORTED_FORMAT"], codes["ASSEMBLED_ELSEWHERE"]) == (1, 1)


def test_many_tasks_write_the_arriving_files(spark, tmp_path):
    from checks.files_io import write_each

    folder = tmp_path / "in"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    write_each(docs, str(folder))
    files = [f for f in folder.rglob("part-*") if f.suffix == ".txt"]
    assert len(files) == len({f.parent for f in files}) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_listing_is_made_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    write_tree(str(tmp_path))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.txt").write_text("")
    (tmp_path / "no files").mkdir()
    monkeypatch.setattr(DataFrame, "inputFiles", None)  # would bring all names to the driver
    listed = {r["path"]: r["length"] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {f"file:{tmp_path}/{name}": len(raw) for name, raw in CONTENTS.items()}
    found = files.scan_files(spark, str(tmp_path))
    assert {r["path"]: r["length"] for r in found.collect()} == {p: n for p, n in listed.items() if not p.endswith(".exe")}
    assert files.list_files(spark, str(tmp_path / "no files")).count() == 0
    for size in (None, 20):
        wanted = {tuple(r) for r in files.scan_files(spark, str(tmp_path), max_size=size).collect()}
        assert {tuple(r) for r in files.read_files(spark, str(tmp_path), max_size=size).collect()} == wanted


def test_texts_become_files(spark, tmp_path):
    from inkveil.sources import sinks

    rows, outcome = outcome_of(spark, tmp_path)
    folder = f"file:{tmp_path}/out"
    texts = {f"{folder}/{path[5:]}": r["deid_text"] for path, r in rows.items()}
    named = spark.createDataFrame(list(texts.items()), "out_path string, content string").repartition(3)
    for _ in range(2):  # a repetition writes the same
        sinks.export_text(named, folder)
    found = {r["path"]: bytes(r["content"]).decode() for r in files.scan_files(spark, folder).collect() if r["content"] is not None}
    assert found == {path: text for path, text in texts.items() if text is not None}
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_")]
    outcome = pipeline.process_folder(spark, str(tmp_path / "in"), f"{tmp_path}/written", rule_table(spark))
    pipeline.write_outcome(outcome, f"{tmp_path}/written")
    assert files.list_files(spark, f"{tmp_path}/written").count() == 6


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    import pytest

    from inkveil.sources import sinks

    folder = str(tmp_path / "out")
    rows = [(f"{folder}/d{i % 7}/{i}.txt", "x") for i in range(200)]
    for bad in ((f"{folder}/d0/0.txt", "again"), (f"{folder}/../up.txt", "x"), ("/elsewhere/a.txt", "x")):
        with pytest.raises(Exception, match="two texts|is not below"):
            sinks.export_text(spark.createDataFrame([*rows, bad], "out_path string, content string"), folder)
        assert [n for _, _, names in os.walk(tmp_path) for n in names] == []


def test_encodings_without_a_mark_are_told_apart(spark):
    from inkveil.sources import encodings

    known = ["电话是多少，请在收到货物后尽快确认，谢谢。", "繁體中文的測試文字，請確認。", "これは日本語の文章です。ありがとう。", "한국어 문장입니다. 감사합니다.", "déjà vu à l'été, façon naïve, où êtes-vous"]
    model = encodings.learn_encodings(spark.createDataFrame([(t,) for t in known * 3 + [None, ""]], "text string"))
    names = ["gbk", "big5", "shift_jis", "euc_kr", "latin-1"]
    cases = [(name, text, text.encode(name)) for name, text in zip(names, known)]
    cases += [(f"utf-16-{order}", text, text.encode(f"utf-16-{order}")) for text in known for order in ("le", "be")]
    rows = spark.createDataFrame([(n, t, raw) for n, t, raw in cases], "truth string, wanted string, content binary")
    decoded = files.decode_text(rows, model=model).collect()
    assert {(r.truth, r.wanted) for r in decoded} == {(r.encoding, r.text) for r in decoded}
    assert all(r.error_code is None for r in decoded)
    unknown = spark.createDataFrame([(bytes([0x81, 0x82, 0x00]),), (b"\xd0\xd0",), (None,), ("ok é".encode(),)], "content binary")
    codes = [(r.text, r.error_code) for r in files.decode_text(unknown, model=model).collect()]
    assert codes == [(None, "ENCODING_ERROR"), (None, "ENCODING_ERROR"), (None, "NO_CONTENT"), ("ok é", None)]


@pytest.mark.parametrize("files", [1, 3])
def test_a_streamed_table_may_be_a_folder(spark, tmp_path, files):
    from checks.files_io import arriving_rows, stream_deidentify

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    docs.repartition(files).write.parquet(str(tmp_path / "parts"))
    if files == 1:  # the table as one file
        next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "parts").rename(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    done = stream_deidentify(spark, str(tmp_path))
    assert {(r["doc_id"], r["deid_text"]) for r in done.collect()} == {(i, f"text {i}") for i in range(6)}
    assert arriving_rows(spark, str(tmp_path), "documents", "doc_id long, text string").isStreaming


def test_very_many_files_are_few_batches(spark, tmp_path):
    from checks.files_io import write_each

    docs = spark.range(1500).selectExpr("id as doc_id", "concat('text ', id) as text")
    write_each(docs, str(tmp_path / "in"))
    assert not [f for f in (tmp_path / "in").rglob("*.crc")]
    incoming = stream.read_files_stream(spark, str(tmp_path / "in"))
    stream.stream_files(incoming, rule_table(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 1500 and done.select("batch_id").distinct().count() == 1


def test_rows_of_one_document_are_lines_of_its_file(spark, tmp_path):
    from checks.files_io import write_each

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "")], "doc_id long, text string")
    write_each(rows, str(tmp_path / "in"))
    found = {f.parent.name: f.read_text() for f in (tmp_path / "in").rglob("*.txt")}
    assert found == {"doc_id=1": "a\nb\n", "doc_id=2": "\n", "doc_id=3": "\n"}
