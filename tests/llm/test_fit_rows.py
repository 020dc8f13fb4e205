"""A pass of the fit widens each row of the shipped matrix once per batch of passages."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tickwise.llm import decontaminate


def test_shipped_rows_are_widened_once(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6)).astype(np.float16)
    terms = [rng.integers(0, 500, n).astype(np.int32) for n in (48, 48, 20, 1)]
    shipped = SimpleNamespace(value=(x, np.arange(500, dtype=np.int32), np.ones(500, np.float32)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([None] * 4, pa.string()), pa.array(np.ones(4))], names=["terms", "text", "weight"],
    )
    seen, times = [], decontaminate._rows_times

    def kinds(rows, at, v):
        seen.append((rows.dtype, len(rows)))
        return times(rows, at, v)

    monkeypatch.setattr(decontaminate, "_rows_times", kinds)
    out = np.zeros((500, 6))
    for part in decontaminate._product(shipped, 6)(iter([batch])):
        own = np.frombuffer(part.column("part")[0].as_py(), np.float32).reshape(-1, 6)
        out[part.column("chunk")[0].as_py() :][: len(own)] = own
    a = np.zeros((4, 500))
    for row, t in zip(a, terms, strict=True):
        np.add.at(row, t, 1 / np.sqrt(len(t)))
    assert np.allclose(out, a.T @ (a @ x.astype(float)), atol=1e-4)
    assert {kind for kind, _ in seen} == {np.dtype(np.float32)}
    # The first product reads the rows that are named, each once; empty places name the first row.
    assert seen[0][1] == len(np.union1d([0], np.concatenate(terms)))
