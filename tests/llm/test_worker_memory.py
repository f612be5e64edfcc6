"""What Python workers hold of texts while a task runs, and after it: Spark keeps them for the stages that follow."""

import subprocess
import sys

import pytest

from markloom.llm import setjoin, simhash
from markloom.llm.queries import vocabulary_file

#: Runs a task of one batch of texts as a worker does, alone in a process: prints the MB that it holds more after the task, the
#: most rows of a result, and the rows.
ALONE = """
import gc, re, sys
import numpy as np, pandas as pd, pyarrow as pa
from pyspark import SparkFiles
from markloom.llm import bpe, pii, simhash

def held():
    gc.collect()
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

made = []

class Docs(dict):  # stands for a table: its columns are asked for, nothing else
    columns, sparkSession = (), None
    select = withColumn = lambda self, *a, **b: self

class Column:
    alias = lambda self, name: self

docs = Docs(doc_id=Column(), text=Column())
bpe.F.pandas_udf = lambda f, *a: made.append(f) or (lambda *x: Column())  # F is the same of all modules
if sys.argv[1] == "encode":
    bpe.shipped, SparkFiles.get = (lambda spark, path: path), (lambda name: name)
    bpe.encode(docs, sys.argv[2], with_ids=True)
    bpe.vocabulary(sys.argv[2])
elif sys.argv[1] == "mask":
    pii.mask(docs)
else:
    simhash.profiles(docs["text"], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 3, 0.8)

def batches(n):
    rng = np.random.default_rng(5)
    words = np.array([f"w{int(i)}" for i in rng.integers(0, 10**9, 150_000)])
    yield pd.Series([" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(n)])

def task(n):
    sizes = []
    for out in made[0](batches(n)):
        (pa.RecordBatch.from_pandas(out) if isinstance(out, pd.DataFrame) else pa.Array.from_pandas(out))
        sizes.append(len(out))
    return sizes

task(20)
before = held()
sizes = task(6_000)
print(held() - before, max(sizes), sum(sizes))
"""


@pytest.mark.parametrize("what, most", [("profiles", 30), ("mask", 15), ("encode", 60)])
def test_a_task_gives_back_its_memory(what, most):
    done = subprocess.run([sys.executable, "-c", ALONE, what, vocabulary_file("word_bpe_49k.json")], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    mb, largest, rows = map(float, done.stdout.split())
    assert rows == 6_000 and largest < 1_000  # results come back in parts, not a whole batch at once
    assert mb < most


def test_near_dedup_hands_python_few_texts(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    for module, function in ((simhash, "profiles"), (setjoin, "common_shingles")):
        plain = getattr(module, function)
        monkeypatch.setattr(module, function, lambda *a, f=plain: seen.append(int(spark.conf.get(name))) or f(*a))
    before = spark.conf.get(name)
    texts = [" ".join(f"w{i * j % 1009}" for j in range(1, 80)) for i in range(1, 30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts, "", None])], "doc_id long, text string").coalesce(1)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [*range(len(texts)), 2 * len(texts)]
    assert seen == [simhash.TEXTS_A_BATCH] * 2 and simhash.TEXTS_A_BATCH < 10_000
    assert spark.conf.get(name) == before
