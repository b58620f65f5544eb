from __future__ import annotations

import os
import sys
from collections import Counter

import pytest

from lodestone.operators.embed import HashedEmbedder, ModelEmbedder, VectorTable
from lodestone.plans.pipeline import Engine

FAKE = '''
import os, uuid
import numpy as np

class SentenceTransformer:
    def __init__(self, name):
        self.root = name
        open(os.path.join(name, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def encode(self, texts, batch_size, normalize_embeddings):
        with open(os.path.join(self.root, f"texts-{os.getpid()}"), "a") as f:
            f.writelines(t + chr(10) for t in texts)
        return np.array([[float(len(t)), float(sum(map(ord, t)) % 7), 1.0] for t in texts]).reshape(-1, 3)
'''


@pytest.fixture
def model(spark, tmp_path, monkeypatch):
    """An embedder whose model writes down every load and every text."""
    home = tmp_path / "package"
    home.mkdir()
    (home / "sentence_transformers.py").write_text(FAKE)
    monkeypatch.syspath_prepend(str(home))
    spark.sparkContext.addPyFile(str(home / "sentence_transformers.py"))
    notes = tmp_path / "notes"
    notes.mkdir()
    yield ModelEmbedder(str(notes), 3), notes
    sys.modules.pop("sentence_transformers", None)


def seen(notes):
    loads = Counter(f.split("-")[1] for f in os.listdir(notes) if f.startswith("load-"))
    texts = Counter(line for f in os.listdir(notes) if f.startswith("texts-") for line in (notes / f).read_text().splitlines())
    return loads, texts


def test_one_load_a_worker_and_one_encoding_a_text(spark, tmp_path, model):
    embedder, notes = model
    rows = [(f"c{i}", "A", "s", f"text number {i % 30}") for i in range(120)]
    passages = spark.createDataFrame(rows, "chunk_id string, location string, source string, text string").repartition(6)
    engine = Engine.kept(passages, str(tmp_path / "kept"), embedder, top_k=3)
    loads, texts = seen(notes)
    assert set(loads.values()) == {1}
    assert texts == {f"text number {i}": 1 for i in range(30)}
    for _ in range(2):
        assert len(engine.ask(spark, "text number 3").first().retrieved_docs) == 3
    again = Engine.kept(passages.unionByName(spark.createDataFrame([("new", "A", "s", "a new text")], passages.schema)), str(tmp_path / "kept"), embedder, top_k=3)
    again.ask(spark, "another question").collect()
    loads, texts = seen(notes)
    assert set(loads.values()) == {1}  # whatever plans the worker has run
    assert {t: n for t, n in texts.items() if "number" in t and t != "text number 3"} == {f"text number {i}": 1 for i in range(30) if i != 3} and texts["a new text"] == 1


def test_kept_vectors_equal_fresh_ones(spark, tmp_path):
    rows = [("c1", "A", "s", "one two"), ("c2", "B", "s", "one two"), ("c3", "B", "t", None), ("c4", "B", "t", "three")]
    passages = spark.createDataFrame(rows, "chunk_id string, location string, source string, text string")
    vectors = VectorTable(spark, str(tmp_path), HashedEmbedder(16))
    vectors.add(passages)
    vectors.add(passages)
    assert vectors.rows().count() == 3
    fresh = {r.chunk_id: r.embedding for r in HashedEmbedder(16).transform(passages, "text").collect()}
    assert {r.chunk_id: r.embedding for r in vectors.join(passages).collect()} == fresh
    assert VectorTable(spark, str(tmp_path), HashedEmbedder(8)).rows().count() == 0
