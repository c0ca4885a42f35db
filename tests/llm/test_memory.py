"""What a Python worker of the pipeline holds, which serves all stages one after the other."""

import tracemalloc

import pyarrow as pa
import pytest

WORDS, DOCS = 250_000, 1000


class Caught(Exception):
    pass


class Rows:
    """Stands for a table: keeps the function that its rows would be given to."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def worker_code(spark, monkeypatch, module, name, stage):
    """The function in which the pipeline's stage runs `module.name` on a worker."""
    plain, rows = getattr(module, name), Rows()

    def catch(_, *args, **kw):
        plain(rows, *args, **kw)
        raise Caught

    monkeypatch.setattr(module, name, catch)
    with pytest.raises(Caught):
        stage(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    return rows.run


@pytest.mark.parametrize("module, name, stage, most", [("packing", "pieces", "pack", 30), ("jaccard", "document_sets", "drop_near_copies", 30)])
def test_pipeline_workers_remember_little(spark, monkeypatch, module, name, stage, most):
    import importlib

    import corpus_pipeline

    run = worker_code(spark, monkeypatch, importlib.import_module(f"prismar.llm.{module}"), name, getattr(corpus_pipeline, stage))
    each = WORDS // DOCS
    texts = [" ".join(f"word{each * k + j:012d}" for j in range(each)).encode() for k in range(DOCS)]
    batch = lambda rows: pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "th": [0] * len(rows), "text": pa.array(rows, pa.binary() if module == "jaccard" else pa.string())})
    assert sum(b.num_rows for b in run(iter([batch([b"a b c d e f"])]))) == 1  # what is loaded once isn't counted
    whole = batch(texts)
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run(iter([whole])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert found >= DOCS
    assert peak < most, peak
