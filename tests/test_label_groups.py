"""Groups of labels against a registry: as many tasks as the labels ask for, and the same results."""

from casewright.operators import labels as L


def test_tasks_follow_the_labels(spark):
    rows = [(i % 50, i % 7) for i in range(1000)] + [(1, None), (99, None)]
    labels = spark.createDataFrame(rows, "g int, d int")
    found = L.group_validity(labels, "g", "d", spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 5, 6, 6, None)], "NAME int"), task_rows=20)
    assert found.rdd.getNumPartitions() == 51  # 1,002 labels, 20 a task
    got = {r.g: (r.n_labels, r.is_valid, r.n_images) for r in found.collect()}
    assert got == {g: (20 + (g == 1), g != 1, 7) for g in range(50)} | {99: (1, False, 0)}
    less = L.group_validity(labels, "g", "d", spark.createDataFrame([(k,) for k in range(6)], "NAME int"), task_rows=20)
    assert not any(r.is_valid for r in less.collect())
