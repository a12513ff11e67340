import json
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from uttermill.operators import fertility
from uttermill.operators.scoring import keyword_scorer, score_batch
from uttermill.plans import registry
from uttermill.plans.staging import drop_staged, spread, stage, staging_path, staging_root
from uttermill.operators.reports import comparison_table, markdown_lines
from uttermill.sources import delimited, files, model_metrics
from uttermill.sources.tables import in_domain, out_of_domain
from uttermill.streaming.scoring import read_stream, read_table_stream, route_stream, score_stream

ROWS = [
    ("a_001", 'He said "hi",\nthen left ', "complaint", "x", "", 0, 0),
    ("a_002", " lead\\slash, 'q' ", "complaint", "y", "😀", 2, 0),
]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.SPLIT_SCHEMA)
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), files.SPLIT_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)


def test_json_skips_rows_without_the_field(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"split": "a", "accuracy": 0.5}\n{"split": "b"}\n"text"\n')
    got = files.read_json(spark, str(tmp_path / "m.json"), files.METRICS_SCHEMA, required="accuracy")
    assert [r.split for r in got.collect()] == ["a"]


def test_log_append_unions_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("r1", 1)], "run_name string, epochs int"), path)
    files.append_log(spark.createDataFrame([("r2", 0.5)], "run_name string, f1 double"), path)
    got = {r.run_name: (r.epochs, r.f1) for r in files.read_log(spark, path).collect()}
    assert got == {"r1": (1, None), "r2": (None, 0.5)}


def test_stage_reads_back_and_cuts_lineage(spark):
    df = stage(spark.range(5).selectExpr("id", "id * 2 AS x"), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert staging_path(spark, "a").startswith(staging_root(spark))


@pytest.fixture()
def folder(spark, tmp_path):
    path = str(tmp_path / "in")
    texts = ["price kitna hai", "refund do", "", "x" * 1001, "   ", "call later"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3).write.parquet(path)
    return path


def test_stream_equals_batch(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    out = str(tmp_path / "out")
    for _ in range(2):  # a restart adds nothing
        score_stream(read_stream(spark, folder, schema, files_per_trigger=1), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    want = score_batch(spark.read.parquet(folder))
    cols = ["id", "intent", "confidence", "cleaned_text"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_routes_rejected_rows(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    q = route_stream(read_stream(spark, folder, schema, files_per_trigger=1), ok, bad, str(tmp_path / "cp"), scorer=keyword_scorer())
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ok).collect()) == [0, 1, 5]
    assert {r.id: r.reject_reason for r in spark.read.parquet(bad).collect()} == {2: "too_short", 3: "too_long", 4: "empty_text"}


def test_longest_pieces():
    pieces = frozenset(["kha", "khareed", "na"])
    assert fertility.longest_pieces("khareedna", pieces, 7) == ["khareed", "na"]
    assert fertility.longest_pieces("xna", pieces, 7) == ["x", "na"]
    assert fertility.longest_pieces("", pieces, 7) == []


def test_fertility_counts_occurrences(spark):
    docs = spark.createDataFrame([("aa aa bbbb",), ("aa",)], "text string")
    words = fertility.word_counts(docs)
    toks = {"char": fertility.chunk_tokenizer(1), "word": fertility.word_tokenizer, "sub": fertility.subword_tokenizer(["aa", "bb"])}
    got = {r.tokenizer: (r.avg_tokens_per_word, r.avg_tokens_per_text) for r in fertility.token_fertility(words, 2, toks).collect()}
    assert got == {"char": (2.5, 5.0), "word": (1.0, 2.0), "sub": (1.25, 2.5)}


def test_fertility_defaults_and_table(spark):
    dim = spark.createDataFrame(
        [("known", "K", "o", "t", 119547, "135M"), ("missing", "M", "o", "t", 50265, "236M")],
        "name string, label string, org string, type string, vocab_size int, params string",
    )
    fert = spark.createDataFrame([("known", 1.5, 3.0)], "tokenizer string, avg_tokens_per_word double, avg_tokens_per_text double")
    got = {r.name: r for r in fertility.backbone_table(dim, fert).collect()}
    assert (got["known"].vocab, got["known"].memory, got["known"].avg_tokens_per_word) == ("119,547", "270 MB", 1.5)
    assert (got["missing"].latency, got["missing"].avg_tokens_per_word, got["missing"].avg_tokens_per_text) == ("68 ms", 2.5, 16.0)


def test_fertility_examples(spark):
    words = spark.createDataFrame([("abc", 3), ("de", 1)], "word string, n bigint")
    got = [r.example for r in fertility.fertility_examples(words, {"char": fertility.chunk_tokenizer(1)}, 1).collect()]
    assert got == ["`abc` -> ['a', 'b', 'c']"]


class _Session:
    """Just enough of a session to answer where staged tables go."""

    def __init__(self, master, folder):
        self.conf = type("C", (), {"get": staticmethod(lambda key, default=None: folder)})
        self.sparkContext = type("S", (), {"master": master})


def test_staging_folder_comes_from_the_session():
    assert staging_root(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(_Session("yarn", None))
    assert staging_root(_Session("local[2]", None)) == staging_root(_Session("local[2]", None))


def test_spread_only_touches_small_inputs(spark):
    few, many = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 64)
    assert spread(many, "id") is many
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_drop_staged(spark):
    path = stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file:").replace("file://", "")
    assert os.path.exists(path)
    drop_staged(spark)
    assert not os.path.exists(path)


def test_worker_functions_need_no_copy_of_the_package(tmp_path):
    data = tmp_path / "f.bin"
    data.write_bytes(cloudpickle.dumps((fertility.longest_pieces, registry._keyword_model)))
    code = (
        "import sys; from pyspark import cloudpickle; f, g = cloudpickle.loads(open(sys.argv[1], 'rb').read()); "
        "assert f('aab', frozenset(['aa']), 2) == ['aa', 'b'] and g()(['the end']).shape == (1, 4); "
        "assert 'uttermill' not in sys.modules"
    )
    subprocess.run([sys.executable, "-c", code, str(data)], cwd=tmp_path, check=True, timeout=60)


def test_missing_logs_and_metrics_are_empty(spark, tmp_path):
    assert files.read_log(spark, f"{tmp_path}/none").count() == 0
    assert files.read_csv_log(spark, f"{tmp_path}/none.csv").columns[0] == "run_name"
    assert files.read_json(spark, f"{tmp_path}/none.json", files.METRICS_SCHEMA, required="accuracy").count() == 0


def test_csv_run_log_is_read(spark, tmp_path):
    path = f"{tmp_path}/log.csv"
    with open(path, "w") as f:
        f.write("run_name,timestamp,model_name,learning_rate,lora_r,lora_alpha,lora_dropout,epochs,train_batch_size,")
        f.write("train_loss,val_loss,val_accuracy,val_macro_f1,adapter_dir\nr1,2024-01-01 00:00:00,m,0.1,8,16,0.05,3,16,0.5,0.4,0.9,0.8,a\n")
    r = files.read_csv_log(spark, path).first()
    assert (r.run_name, r.epochs, r.val_macro_f1) == ("r1", 3, 0.8)


def test_unknown_source_is_in_domain(spark):
    df = spark.createDataFrame([(1, None), (2, "src18"), (3, "src1")], "ord long, source string")
    assert [r.ord for r in in_domain(df).collect()] == [1, 3] and [r.ord for r in out_of_domain(df).collect()] == [2]


def test_streams_read_a_file_a_folder_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, f"some text {i}") for i in range(6)], "conv_id long, turn long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/empty.parquet")
    part = next(p for p in os.listdir(f"{tmp_path}/folder.parquet") if p.endswith(".parquet"))
    for k, (path, n) in enumerate([(f"{tmp_path}/folder.parquet", 6), (f"{tmp_path}/folder.parquet/{part}", 2), (f"{tmp_path}/empty.parquet", 0)]):
        stream = read_table_stream(spark, path, rows.schema)
        out = f"{tmp_path}/out{k}"
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c{k}")
        q.trigger(availableNow=True).start().awaitTermination()
        assert files.read_parquet(spark, out, rows.schema).count() == n


# csv bound by header


def write_files(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


CORPUS = "base_id string, text string, intent string, n int"


def test_csv_columns_are_bound_by_name_in_every_file(spark, tmp_path):
    path = write_files(
        tmp_path,
        a='intent,base_id,text\nx,1,"he said ""hi""\nthere"\ny,2,b\nz,3\nw,4,d,e\n',
        b='﻿text,intent,base_id,extra\nT1,I1,B1,E1\n"q,1",I2,B2,\n',
        c='"text","in\ntent",intent,base_id,n\nT2,zz,I1,C1,5\nT3,zz,I1,C2,x\n',
        empty="",
    )
    found = delimited.bind_csv(spark, path, CORPUS, ["text", "intent"])
    want = {("1", 'he said "hi"\nthere', "x", None), ("2", "b", "y", None), ("B1", "T1", "I1", None), ("B2", "q,1", "I2", None), ("C1", "T2", "I1", 5)}
    assert {tuple(r) for r in found.rows.collect()} == want and found.rows.count() == len(want)
    # what fits does not depend on the columns that are read
    assert sorted(r[0] for r in found.rows.select("base_id").collect()) == sorted(w[0] for w in want)
    rejects = {(r.file[-5:], r.reason, r.record) for r in found.rejects().collect()}
    assert rejects == {("a.csv", "cells", "z,3"), ("a.csv", "cells", "w,4,d,e"), ("c.csv", "n", "T3,zz,I1,C2,x")}
    assert found.rejects().count() == 3


@pytest.mark.parametrize("header", ["intent,base_id,text", "text,base_id,intent", "base_id,intent,text"])
def test_csv_gives_the_same_rows_for_any_order(spark, tmp_path, header):
    cells = {"intent": "complaint", "base_id": "b1", "text": "late again"}
    path = write_files(tmp_path, one=header + "\n" + ",".join(cells[c] for c in header.split(",")) + "\n")
    assert files.read_csv(spark, path, files.RAW_SCHEMA).collect() == [("b1", "late again", "complaint")]


def test_csv_without_a_required_column_is_refused_by_name(spark, tmp_path):
    path = write_files(tmp_path, good="base_id,text,intent\n1,a,b\n", bad="base_id,text\n1,a\n")
    with pytest.raises(ValueError, match=r"missing column\(s\): intent in .*bad.csv"):
        files.read_csv(spark, path, files.RAW_SCHEMA)
    assert files.read_csv(spark, path, files.RAW_SCHEMA, required=["text"]).count() == 2
    twice = write_files(tmp_path, bad="base_id,text,text,intent\n1,a,b,c\n")
    with pytest.raises(ValueError, match="named twice: text"):
        files.read_csv(spark, twice, files.RAW_SCHEMA)


def test_csv_folder_columns_and_empty_folders(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "x", "train"), ("2", "b", "y", "a b=c")], "base_id string, text string, intent string, split string")
    files.write_csv(df, f"{tmp_path}/parts", partition_by=["split"])
    back = files.read_csv(spark, f"{tmp_path}/parts", files.RAW_SCHEMA + ", split string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "none").mkdir()
    write_files(tmp_path / "none", e="")
    none = delimited.bind_csv(spark, f"{tmp_path}/none", CORPUS)
    assert none.rows.count() == 0 and none.rejects().count() == 0 and none.rows.columns == ["base_id", "text", "intent", "n"]


def test_large_csv_header_is_read_from_the_first_block_only(spark, tmp_path):
    path = write_files(tmp_path, big="a,b\n" + "x,1\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r.header for r in delimited.read_headers(spark, path).collect()] == [["a", "b"]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.read_csv(spark, path, "b int, a string").count() == 50_000


# metrics documents

DOCUMENT = """{
  "TF-IDF + Model": {
    "model_name": "TF-IDF + Model", "test_accuracy": 0.9365, "test_macro_f1": 0.937,
    "per_class": {"late": {"precision": 0.9, "recall": 1.0, "f1_score": 0.95, "support": 21}},
    "classification_report": {"late": {"precision": 0.9, "recall": 1.0, "f1-score": 0.95, "support": 21.0}, "accuracy": 0.9365},
    "ood_accuracy": 0.925
  },
  "note": "x", "list": [1, {"test_accuracy": 1}], "other": {"accuracy": 1}, "none": null
}"""


def test_metrics_document_is_read_by_model(spark, tmp_path):
    (tmp_path / "m.json").write_text(DOCUMENT)
    rows = model_metrics.read_model_metrics(spark, f"{tmp_path}/m.json").collect()
    assert [(r.model, r.test_accuracy, r.ood_accuracy, r.ood_macro_f1, r.per_class["late"].support) for r in rows] == [("TF-IDF + Model", 0.9365, 0.925, None, 21)]
    report = {r.label: tuple(r)[2:] for r in model_metrics.read_model_reports(spark, f"{tmp_path}/m.json").collect()}
    assert report == {"late": (0.9, 1.0, 0.95, 21.0), "accuracy": (0.9365, 0.9365, 0.9365, None)}
    for k, text in enumerate(["[1, 2]", "no json {", "", '"x"', "{}"]):
        (tmp_path / f"bad{k}.json").write_text(text)
        assert model_metrics.read_model_metrics(spark, f"{tmp_path}/bad{k}.json").count() == 0
        assert model_metrics.read_model_reports(spark, f"{tmp_path}/bad{k}.json").count() == 0
    assert model_metrics.read_model_metrics(spark, f"{tmp_path}/missing.json").count() == 0
    table = comparison_table(*(model_metrics.by_split(model_metrics.read_model_metrics(spark, f"{tmp_path}/m.json"), s) for s in ("test", "ood")))
    assert markdown_lines(table).first()[0] == "| TF-IDF + Model | 93.7% | 0.9370 | 92.5% | N/A | Baseline |"


def test_metrics_document_is_written_as_one_object(spark, tmp_path):
    entries = spark.createDataFrame([('a "q" | b', '{"test_accuracy":0.5}'), ("z", '{"test_accuracy":1.0}')], "model string, entry string")
    model_metrics.write_document(model_metrics.document(entries, {"note": 'say "hi"'}), f"{tmp_path}/d")
    text = "".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))
    assert json.loads(text) == {'a "q" | b': {"test_accuracy": 0.5}, "note": 'say "hi"', "z": {"test_accuracy": 1.0}}
    assert {r.model for r in model_metrics.read_model_metrics(spark, f"{tmp_path}/d").collect()} == {'a "q" | b', "z"}


def test_markdown_cells_stay_in_their_row(spark):
    df = spark.createDataFrame([("a|b", "two\nlines\r\nmore")], "`x.y` string, t string")
    assert markdown_lines(df).first()[0] == "| a\\|b | two<br>lines<br>more |"


# run logs


def test_log_widens_types_and_ignores_what_it_holds(spark, tmp_path):
    path = f"{tmp_path}/log"
    add = lambda rows, schema, **how: files.append_log(spark.createDataFrame(rows, schema), path, **how)
    assert add([("r1", 1, 1)], "run_name string, epochs int, tag int", token="a")
    assert add([("r2", 2.5, "x")], "run_name string, epochs double, tag string", token="b")
    assert not add([("r2", 2.5, "x")], "run_name string, epochs double, tag string", token="b")
    assert add([("r3", 1 << 40)], "run_name string, epochs bigint")
    assert add([("r3", 7), ("r4", 7), ("r4", 7)], "run_name string, epochs int", key="run_name")
    assert add([], "run_name string, when date")
    log = files.read_log(spark, path)
    assert dict(log.dtypes) == {"run_name": "string", "epochs": "double", "tag": "string", "when": "date"}
    assert sorted((r.run_name, r.epochs, r.tag) for r in log.collect()) == [("r1", 1.0, "1"), ("r2", 2.5, "x"), ("r3", float(1 << 40), None), ("r4", 7.0, None)]


def test_two_writers_of_one_token_count_once(spark, tmp_path):
    runs = spark.createDataFrame([("r", 1), ("r", 1)], "run_name string, epochs int")
    files.append_log(runs, f"{tmp_path}/log", token="t")
    again = f"{tmp_path}/other"
    files.append_log(runs, again, token="t")
    spark.read.parquet(f"{again}/*").write.mode("append").parquet(next(str(p) for p in (tmp_path / "log").iterdir()))
    assert files.read_log(spark, f"{tmp_path}/log").count() == 2
