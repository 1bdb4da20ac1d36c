"""JSON of any shape in splits of a few hundred bytes, and the sink of one file a record."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stepquarry.sources import json_pieces, record_files, records


@pytest.fixture()
def tiny_splits(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "600"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(key, value)
    yield spark
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def values(rnd):
    return rnd.choice(["x}y{", 'q"\\', "[[", "plain " * rnd.randint(0, 60), "é}😀", "\\" * rnd.randint(0, 5), "\n}", '\\"}', ""])


def made(n, seed=1):
    rnd = random.Random(seed)
    return [{"id": i, "t": values(rnd), "n": {"a": [values(rnd), {"b": values(rnd)}]}} for i in range(n)]


def test_files_of_any_shape_equal_json_loads(tiny_splits, tmp_path):
    spark, rows = tiny_splits, made(400)
    files = {
        "array.json": json.dumps(rows[:120], ensure_ascii=False),
        "spread.jsonl": json.dumps(rows[120:150], indent=2) + "\n",
        "lines.json": "\n".join(map(json.dumps, rows[150:250])) + '\n{"id": 9, "torn\n',
        "object.json": json.dumps(rows[250], indent=1),
        "one_line.json": json.dumps(rows[251]),
        "ends_in_brace.json": json.dumps(rows[252]) + "}",
        "torn_array.json": json.dumps(rows[260:300])[:-9],
        "torn_object.json": '{"id": 7',
        "torn_string.json": '[{"id": 7, "t": "}',
        "unsound_element.json": "[" + json.dumps(rows[310]) + ', {"a": nope}]',
        "other_elements.json": '  [1, "}{", [[{"id": 5}]], {"id": 1000, "t": ""}, null]  ',
        "no_elements.json": "[]",
        "empty.json": "",
        "blank.json": " \n ",
        "long.json": json.dumps([{"id": 2000, "t": "} {" * 2000}, {"id": 2001, "t": "[" * 3000}]),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.record.id: r.record.t for r in json_pieces.records(spark, str(tmp_path), "id long, t string").collect()}
    want = {r["id"]: r["t"] for r in rows[:252]} | {1000: "", 2000: "} {" * 2000, 2001: "[" * 3000}
    assert got == want
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "array.json")).rdd.getNumPartitions() > 5


def test_elements_are_in_order_and_whole(tiny_splits, tmp_path):
    rows = made(90, 2)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    found = json_pieces.elements(tiny_splits, str(tmp_path / "a.json")).orderBy("block", "k").collect()
    assert [json.loads(r.value) for r in found] == rows and len({r.block for r in found}) > 5


def test_states_compose_over_any_cut():
    text = json.dumps(made(30, 3)).encode()
    rnd = random.Random(3)
    for _ in range(200):
        cuts = sorted(rnd.sample([i + 1 for i, c in enumerate(text) if c == ord("}")], 4))
        inside, depth = False, 0
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            inside, delta = json_pieces.effect(text[a:b], inside)
            depth += delta
            whole = json_pieces.effect(text[:b], False)
            assert (inside, depth) == whole
        assert (inside, depth) == (False, 0)


def test_dealt_anew_where_there_are_many_splits(tiny_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(json_pieces, "BROADCAST_ROWS", 0)
    rows = made(60, 4)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    found = json_pieces.elements(tiny_splits, str(tmp_path)).orderBy("block", "k").collect()
    assert [json.loads(r.value) for r in found] == rows


def files_of(path):
    return {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}


def test_one_file_a_record_and_only_what_lacks(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("value"))
    record_files.write(rows.where("value < 'é2'"), path)
    before = files_of(path)
    record_files.write(rows, path)
    after = files_of(path)
    assert len(after) == 40 and before and all(after[f] == t for f, t in before.items())
    assert {f: open(f"{path}/{f}", encoding="utf-8").read() for f in after} == {f"r{i}.json": f"é{i}" for i in range(40)}
    record_files.write(rows.select("name", F.lit("new").alias("value")).where("name = 'r7.json'"), path, "overwrite")
    assert open(f"{path}/r7.json").read() == "new" and len(files_of(path)) == 40
    odd = spark.createDataFrame([("same", "a"), ("same", "b"), (None, "x"), ("", "x"), ("a/b", "x"), ("null", None)], "name string, value string")
    record_files.write(odd, path)
    assert open(f"{path}/same").read() == "b" and open(f"{path}/null").read() == "" and len(files_of(path)) == 42


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")

    @F.udf("string")
    def fragile(i):
        if i == 33:
            raise RuntimeError("lost")
        return str(i)

    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), fragile("id").alias("value"))
    spark.dataSource.register(record_files.RecordFiles)
    with pytest.raises(Exception, match="lost"):
        rows.write.format(record_files.FORMAT).mode("append").option("path", path).save()
    left = set(os.listdir(path)) if os.path.exists(path) else set()
    assert not left & {f"r{i}" for i in range(30, 40)}
    record_files.write(rows.where("id <> 33"), path)
    assert set(os.listdir(path)) - {record_files.STAGED} == {f"r{i}" for i in range(40) if i != 33}


def test_per_record_names_are_safe(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b", None), (2, None, "x")], "dataset_index long, source string, more string")
    records.write_per_record(rows, str(tmp_path), "dataset_index", "source")
    assert {f: json.loads((tmp_path / f).read_text()) for f in os.listdir(tmp_path)} == {"1_a_b.json": {"dataset_index": 1, "source": "a/b", "more": None}, "2_unknown.json": {"dataset_index": 2, "source": None, "more": "x"}}


def test_arrow_streams_are_read_by_batch(spark, tmp_path):
    import pyarrow as pa

    from stepquarry.sources import arrow_files

    kinds = pa.schema([("k", pa.int64()), ("t", pa.dictionary(pa.int32(), pa.string())), ("more", pa.list_(pa.int32()))])
    rows = [{"k": i, "t": None if i % 7 == 0 else f"text {i % 5}é", "more": [i] * (i % 3)} for i in range(1000)]
    for name, part in (("a", rows[:700]), ("b", rows[700:])):
        with pa.OSFile(str(tmp_path / f"{name}-train.arrow"), "wb") as sink, pa.ipc.new_stream(sink, kinds) as writer:
            for k in range(0, len(part), 64):
                made = pa.table({"k": [r["k"] for r in part[k : k + 64]], "t": pa.array([r["t"] for r in part[k : k + 64]]).dictionary_encode(), "more": [r["more"] for r in part[k : k + 64]]})
                writer.write_table(made.cast(kinds))
    whole = (tmp_path / "a-train.arrow").read_bytes()
    (tmp_path / "torn-train.arrow").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "empty-train.arrow").write_bytes(b"")
    assert sum(m.rows for m in arrow_files.messages(str(tmp_path / "a-train.arrow"))) == 700
    assert len(arrow_files.lots(str(tmp_path / "a-train.arrow"), 2000)) > 4
    got = arrow_files.read(spark, [str(tmp_path / f"{x}-train.arrow") for x in "ab"], "t string, k long", size=2000)
    assert got.rdd.getNumPartitions() > 6
    found = sorted((r.subset, r.row, r.k, r.t) for r in got.collect())
    assert found == [(s, i - first, i, rows[i]["t"]) for s, first, upto in (("a", 0, 700), ("b", 700, 1000)) for i in range(first, upto)]
    torn = records.arrow_files(spark, str(tmp_path), "k long").where("subset = 'torn'").collect()
    assert 0 < len(torn) < 700 and [r.k for r in sorted(torn, key=lambda r: r.row)] == list(range(len(torn)))


def test_record_files_are_read_by_name_in_tasks(spark, tmp_path):
    """No plan of the driver has the folder's files, and names without a file give nothing."""
    rows = spark.createDataFrame([(1, "a/b", "x\n"), (2, "c", None), (2, "c", None)], "id long, kind string, text string")
    records.write_per_record(rows, str(tmp_path), "id", "kind")
    asked = rows.unionByName(spark.createDataFrame([(3, "gone", "y")], rows.schema))
    got = records.read_per_record(asked, str(tmp_path), "id long, text string", "id", "kind")
    assert not [*got.inputFiles()] and sorted((r.id, r.text) for r in got.collect()) == [(1, "x\n"), (2, None)]
    assert {r.file for r in got.collect()} == {f.name for f in tmp_path.glob("*.json")}
