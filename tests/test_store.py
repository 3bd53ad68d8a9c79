"""Scratch folders, alone and at once."""

import threading

from quarryline import store


def test_scratches_of_threads_are_apart(spark):
    """Each query deletes what it wrote itself, whatever runs beside it."""
    both, kept, errors = threading.Barrier(2), {}, []

    def query(name):
        try:
            with store.scratch(spark):
                mine = store.materialize(spark.range(5), name)
                both.wait(60)  # both are open, and the later one is the innermost of the process
                with store.scratch(spark):
                    store.materialize(spark.range(2), name)
                    kept[name] = store.materialize(mine, name, outlives=True)
                both.wait(60)
                assert mine.count() == kept[name].count() == 5
                both.wait(60)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=query, args=(n,)) for n in ("one", "other")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_scratch_deletes_what_does_not_outlive_it(spark):
    with store.scratch(spark):
        with store.scratch(spark):
            gone = store.new_path(spark, "gone")
            stays = store.new_path(spark, "stays", outlives=True)
            for p in (gone, stays):
                spark.range(3).write.parquet(p)
        assert spark.read.parquet(stays).count() == 3
        fs = spark._jvm.org.apache.hadoop.fs.Path(gone)
        assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
