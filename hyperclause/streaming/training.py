"""Clause machines that learn from a stream: the automata are the state of a group, a group is one seed.

A machine takes one sample after the other, so a seed is one task's work in each batch; the seeds are dealt out over the tasks. What
a task holds is the machine and the rows of one batch, which the stream's options bound (`maxFilesPerTrigger`). As draws are
hashes of seed, step and place, a batch that is run again comes to the same states, and states do not depend on how the samples fell
into batches as long as their order is kept."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clauses import Spec
from ..operators.training import Machine


def learn_stream(samples: DataFrame, spec: Spec, seeds: Iterable[int]) -> DataFrame:
    """seed, step (samples learned so far) and states (of all automata, in the order of `Machine.table`) after each batch, for output mode
    update.

    samples is a stream of sample (its number), x (spec.features bits) and y (0 or 1). The samples of a batch are taken by number, then
    y, then x; a sample of an earlier batch comes before, whatever its number. Rows that hold a null (also in x) take no part, repeated
    rows count each time; an x of another length is an error. Other columns are left out."""
    x = F.col("x")
    whole = F.col("sample").isNotNull() & F.col("y").isNotNull() & x.isNotNull() & ~F.exists(x, lambda b: b.isNull())
    fits = F.when(F.size(x) == spec.features, x).otherwise(F.raise_error(F.lit(f"a sample has {spec.features} bits")))
    wanted = F.array(*[F.lit(s).cast("long") for s in sorted(set(seeds))])
    rows = samples.where(whole).select("sample", fits.cast("array<int>").alias("x"), F.col("y").cast("int").alias("y"), F.explode(wanted).alias("seed"))

    def learn(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(spec, int(key[0]))
        if state.exists:
            blob, machine.step = state.get
            machine.state = np.frombuffer(blob, np.int32).reshape(machine.state.shape).copy()
        batch = pd.concat(chunks)
        for _, y, bits in sorted(zip(batch["sample"], batch["y"], map(tuple, batch["x"]))):
            machine.update(np.array(bits), int(y))
        state.update((machine.state.tobytes(), machine.step))
        yield pd.DataFrame({"seed": [int(key[0])], "step": [machine.step], "states": [machine.state.ravel()]})

    return rows.groupBy("seed").applyInPandasWithState(learn, "seed long, step long, states array<int>", "states binary, step long", "update", GroupStateTimeout.NoTimeout)
