"""First-wins across micro-batches, restarts and a batch that is replayed."""

import json
import shutil

from stepquarry.streaming import first_seen


def run(spark, root):
    first_seen.ingest(spark, f"{root}/in", "k string, at long, v string", f"{root}/out", f"{root}/log", ["k"], ["at"]).awaitTermination()
    return sorted(((r.k, r.at, r.v) for r in spark.read.schema("k string, at long, v string").parquet(f"{root}/out").collect()), key=str)


def put(root, name, rows):
    (root / "in").mkdir(exist_ok=True)
    (root / "in" / name).write_text("\n".join(json.dumps(dict(zip(("k", "at", "v"), r))) for r in rows))


def test_first_rows_across_batches_and_restarts(spark, tmp_path):
    put(tmp_path, "1.json", [("a", 3, "late"), ("a", 1, "first"), ("b", 2, "b"), (None, 5, "none")])
    assert run(spark, tmp_path) == [("a", 1, "first"), ("b", 2, "b"), (None, 5, "none")]
    put(tmp_path, "2.json", [("a", 0, "earlier, but too late"), ("c", 1, "c"), (None, 1, "again")])
    want = [("a", 1, "first"), ("b", 2, "b"), ("c", 1, "c"), (None, 5, "none")]
    assert run(spark, tmp_path) == want
    # the last batch's commit is lost, as when the driver dies before it: it runs again and gives the same rows once
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    put(tmp_path, "3.json", [("b", 1, "x"), ("d", 1, "d")])
    assert run(spark, tmp_path) == [*want[:3], ("d", 1, "d"), want[3]]
    shutil.rmtree(tmp_path / "log")
