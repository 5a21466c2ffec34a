"""Machines that learn from a file stream come to the states of one pass over the samples in their order."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from hyperclause.operators.clauses import Spec
from hyperclause.operators.training import Machine
from hyperclause.streaming.training import learn_stream

SPEC = Spec(clauses=4, threshold=10, root=2, inner_or=1, inner_and=2, leaf_or=2, leaf_and=2)
SCHEMA = "sample long, x array<int>, y int, extra string"


def _file(folder, number, rows):
    """A file of the stream, dated by its number, as files are taken by age."""
    path = folder / f"{number}.parquet"
    kinds = pa.schema([("sample", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.int32()), ("extra", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], schema=kinds), path)
    os.utime(path, (1_600_000_000 + number, 1_600_000_000 + number))


def _run(spark, folder, checkpoint, found, seeds):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    keep = lambda batch, _: found.update({r.seed: (r.step, r.states) for r in batch.collect()})
    query = learn_stream(stream, SPEC, seeds).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_growing_stream_equals_one_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (90, SPEC.features))
    y = x[:, 0] ^ x[:, 1]
    rows = [[i, x[i].tolist(), int(y[i]), "e"] for i in range(90)]
    rows[40] = rows[39]  # a repeated row
    folder, checkpoint, found = tmp_path / "in", tmp_path / "c", {}
    folder.mkdir()
    nulls = [[None, x[0].tolist(), 1, "e"], [5, None, 1, "e"], [5, x[0].tolist(), None, None], [5, [None] * SPEC.features, 0, "e"]]
    _file(folder, 0, [rows[i] for i in rng.permutation(30)] + nulls)
    _file(folder, 1, rows[30:60])
    _run(spark, folder, checkpoint, found, [1, 2, 2])
    assert {k: v[0] for k, v in found.items()} == {1: 60, 2: 60}
    _file(folder, 2, rows[60:])
    _file(folder, 3, [])
    _run(spark, folder, checkpoint, found, [1, 2])
    for seed in (1, 2):
        order = [r[0] for r in rows]
        machine = Machine(SPEC, seed).fit(x[order], y[order], 1, shuffle=False)
        assert found[seed] == (90, machine.state.ravel().tolist())
    assert found[1][1] != found[2][1]
    before = dict(found)
    _run(spark, folder, checkpoint, found, [1, 2])  # nothing new
    assert found == before


def test_samples_of_another_length_are_an_error(spark, tmp_path):
    _file(tmp_path, 0, [[1, [0, 1, 1], 1, "e"]])
    with pytest.raises(StreamingQueryException, match="bits"):
        _run(spark, tmp_path, tmp_path / "c", {}, [1])
