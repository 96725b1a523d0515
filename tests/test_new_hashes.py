"""New hashes by keyed state over several runs, against a set kept by hand."""

import random

from casewright.streaming.new_hashes import new_hash_stream


def run(spark, tmp_path, registry):
    new_hash_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), registry).awaitTermination()
    return sorted((r.digest, r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_only_unseen_hashes_come_out_whatever_the_batches(spark, tmp_path):
    r = random.Random(6)
    registry = str(tmp_path / "registry")
    spark.createDataFrame([(f"h{i}",) for i in range(5)], "NAME string").write.parquet(registry)
    seen, want, paths = {f"h{i}" for i in range(5)}, [], 0
    for _ in range(3):
        rows = [(f"h{r.randrange(30)}" if r.random() < 0.95 else None, f"p{(paths := paths + 1):04d}") for _ in range(25)]
        r.shuffle(rows)
        spark.createDataFrame(rows, "digest string, path string").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        fresh = {}
        for digest, path in rows:
            if digest and digest not in seen:
                fresh[digest] = min(fresh.get(digest, path), path)
        seen |= set(fresh)
        want += fresh.items()
        assert run(spark, tmp_path, registry) == sorted(want)
    assert run(spark, tmp_path, registry) == sorted(want)  # nothing new: nothing out


def test_a_replayed_batch_gives_the_same_rows(spark, tmp_path):
    registry = str(tmp_path / "registry")
    spark.createDataFrame([("a",)], "NAME string").write.parquet(registry)
    for rows in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]):
        spark.createDataFrame(rows, "digest string, path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path, registry)
    # As after a failure between the sink and the commit log: the last batch runs again.
    last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()
    assert run(spark, tmp_path, registry) == [("b", "2"), ("c", "4")]
