"""What Python workers hold beside an executor's JVM: one daemon for all operators, and no freed memory after a task."""

import subprocess
import sys
from pathlib import Path

import psutil
import pyarrow as pa

from corpuslake.llm.runtime import returning

#: In a session of its own, as daemons stay: near copies with a hot class, so that hot keys and emptied tables both occur.
SCRIPT = """
import psutil
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from corpuslake.llm import ngram_join, runtime
hot = runtime.hot_keys(spark.range(100).selectExpr("if(id < 60, 1L, id) AS a", "id % 50 AS b"), ["a"], ["b"])
print("HOT", [(r.a, r["__parts"]) for r in hot[0].collect()], hot[1])
docs = spark.range(100).selectExpr("if(id < 50, 1L, id) AS doc_id", "if(id < 50, 'a b c d e f g', concat('x', id, ' y z w ', id, ' q')) AS text")
print("ROWS", ngram_join.one_of_each(docs, 3, 80).count())
jvm = psutil.Process(spark.sparkContext._jvm.ProcessHandle.current().pid())
print("DAEMONS", sum("pyspark.daemon" in " ".join(p.cmdline()) for p in jvm.children()))
"""


def test_executors_need_one_python_daemon():
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert [x for x in run.stdout.splitlines() if x.split()[0] in ("HOT", "ROWS", "DAEMONS")] == ["HOT [(1, 3)] None", "ROWS 51", "DAEMONS 1"]


def test_a_worker_gives_back_what_its_task_has_freed():
    pins, process = [], psutil.Process()

    def task(batches):
        held = [bytearray(600) for _ in range(300_000)]  # larger than Python's own arenas take
        pins.append(held.pop())  # the heap's end stays in use
        del held
        yield from batches

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    before = process.memory_info().rss
    assert list(task(iter([batch]))) == [batch]
    kept = process.memory_info().rss - before
    assert list(returning(task)(iter([batch]))) == [batch]
    assert kept > 100e6 and process.memory_info().rss - before < 60e6
