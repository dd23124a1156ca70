"""Embeddings of a table's column: calls, their order, failures and what is kept."""

import os
import sys
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle

from braidwork.functions.vectors import embed
from braidwork.operators import embed as operator

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


class Counted:
    """Notes each call in a folder; the first call of every batch fails if it is to."""

    def __init__(self, folder, fails=False):
        self.folder, self.fails = str(folder), fails

    def embed(self, texts):
        mark = os.path.join(self.folder, f"failed-{abs(hash(texts[0]))}-{len(texts)}")
        if self.fails and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("not now")
        with open(os.path.join(self.folder, f"call-{uuid.uuid4().hex}"), "w") as f:
            f.write("\n".join(texts))
        return [embed(t, 16).tolist() for t in texts]

    def calls(self):
        return [open(os.path.join(self.folder, n)).read().split("\n") for n in os.listdir(self.folder) if n.startswith("call-")]


@pytest.mark.parametrize("fails", [False, True])
def test_once_for_each_text(spark, tmp_path, fails):
    (tmp_path / "calls").mkdir()
    provider, table = Counted(tmp_path / "calls", fails), f"file://{tmp_path}/table"
    rows = [(i, [None, "", " ", f"text {i % 40}"][min(i % 7, 3)], "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string, text string")
    got = {r.id: r for r in operator.embedded(df, "t", provider, table, batch=8, wait=0.01, dimensions=16).collect()}
    assert len(got) == 300 and got[3].text == "x"
    for i, t, _ in rows:
        assert np.allclose(got[i].embedding, embed(t, 16) if t and t.strip() else np.zeros(16))
    asked = [t for c in provider.calls() for t in c]
    assert sorted(asked) == sorted({t for _, t, _ in rows if t and t.strip()}) and all(len(c) <= 8 for c in provider.calls())
    more = spark.createDataFrame([(1, "text 3"), (2, "new")], "id int, t string")
    before = len(provider.calls())
    assert operator.embedded(more, "t", provider, table, wait=0.01).count() == 2
    assert [c for c in provider.calls() if c == ["new"]] and len(provider.calls()) == before + 1  # only what the table lacks


def test_a_provider_that_keeps_failing(spark, tmp_path):
    class Broken:
        def embed(self, texts):
            return []

    with pytest.raises(ValueError, match="0 embeddings of 1"):
        operator.call(Broken(), ["a"], 1, 0.0)


def test_semantic_similarity(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [("red ring", "red ring"), ("red ring", "blue bolt"), (None, "red ring"), (" ", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = operator.semantic_similarity(df, "a", "b", Counted(tmp_path / "calls"), f"file://{tmp_path}/table").collect()
    near = {(r.a, r.b): r.similarity for r in got}
    x, y = embed("red ring", 16), embed("blue bolt", 16)
    assert near[rows[0]] == pytest.approx(1.0) and near[rows[1]] == pytest.approx(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)))
    assert near[rows[2]] is None and near[rows[3]] is None
