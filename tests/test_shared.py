"""Tables in the shared folder, from several threads."""

import threading

from semspark.runtime.shared import BATCH_BYTES, BATCH_CONF, scratch, small_batches, written


def test_scratch_deletes_its_own_threads_tables_only(spark):
    inside, outside = threading.Event(), threading.Event()
    kept = []

    def other():
        inside.wait(30)
        kept.append(written(spark.range(7).toDF("n"), "kept"))
        outside.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        gone = written(spark.range(5).toDF("n"), "gone")
        with scratch(spark):
            inner = written(spark.range(3).toDF("n"), "inner")
            files = inner.inputFiles()
        inside.set()
        assert outside.wait(60) and gone.count() == 5 and files
        assert not spark._jvm.java.io.File(files[0].removeprefix("file:")).exists()
    thread.join()
    assert kept[0].count() == 7


def test_bounded_batches_of_threads_that_overlap(spark):
    before = spark.conf.get(BATCH_CONF, None)
    first, second = small_batches(spark), small_batches(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(BATCH_CONF) == str(BATCH_BYTES)
    second.__exit__(None, None, None)
    assert spark.conf.get(BATCH_CONF, None) == before
