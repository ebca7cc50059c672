"""What a task of the similarity join holds and hands on at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from packetloom.llm import jaccard


class Captured:
    """Stands for a table: keeps the function that mapInArrow() would run in tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def peak_mb(run, batches):
    """Peak MB while the function runs over the batches, and the rows of each batch that it returns."""
    rows = []
    tracemalloc.start()
    for batch in run(iter(batches)):
        rows.append(batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, rows


def test_keys_of_large_sets_are_returned_in_bounded_batches():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 9_000, dtype=np.uint64)) for _ in range(256)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
    h = pa.array(range(256), pa.int64())
    batch = pa.RecordBatch.from_arrays([h, pa.array([len(x) for x in sets], pa.int64()), items, h], names=["h", "n", "items", "comp"])
    peak, rows = peak_mb(jaccard.set_keys(Captured(), 80, {}), [batch])
    assert sum(rows) == sum(len(jaccard.signatures(x, jaccard.default_scheme(jaccard.band_of(len(x), 80) + i, 80))) for x in sets for i in (0, 1))
    assert max(rows) < 200_000 and peak < 60


def test_a_task_of_many_texts_holds_few_keys():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3_000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], names=["id", "text"])
    peak, rows = peak_mb(jaccard.index_keys(Captured(), 80, 5, {}), [batch])
    assert sum(rows) > 1_000_000 > 2 * max(rows)
    assert peak < 60
