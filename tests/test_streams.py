from __future__ import annotations

import base64
import random

from lodestone.plans.pipeline import Engine
from lodestone.streaming import artifacts, intake, live

KIND = "ui_id string, seq long, kind string, props string"


def plain(batches):
    """The reducer, event by event."""
    rows = {}
    for batch in batches:
        for ui_id, seq, kind, props in sorted(batch, key=lambda e: e[1]):
            if kind == "remove":
                rows.pop(ui_id, None)
            else:
                rows[ui_id] = (seq, props, rows.get(ui_id, (0, "", 0))[2] + 1)
    return {k: v for k, v in rows.items()}


def run(spark, tmp_path, batches, stops):
    """Feeds the batches; the query ends and is started anew after each of ``stops``."""
    source = tmp_path / "in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(source))
        if k in stops or k == len(batches) - 1:
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source))
            artifacts.keep(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return {r.ui_id: (r.seq, r.props, r.merged) for r in artifacts.state(spark, str(tmp_path / "cp")).collect()}


def test_state_is_the_same_with_and_without_a_restart(spark, tmp_path):
    rng = random.Random(1)
    seq, batches = 0, []
    for _ in range(4):
        batch = []
        for _ in range(60):
            seq += 1
            batch.append((rng.choice("abcdefgh"), seq, rng.choice(["push", "push", "push", "remove"]), f"p{seq}"))
        rng.shuffle(batch)
        batches.append(batch)
    through = run(spark, tmp_path / "a", batches, {0, 1, 2})
    assert run(spark, tmp_path / "b", batches, {1}) == through == plain(batches)
    # every batch wrote the keys it touched, and nothing else
    touched = spark.read.parquet(str(tmp_path / "a" / "out")).groupBy("batch").count()
    assert {r.batch: r["count"] for r in touched.collect()} == {k: len({e[0] for e in b}) for k, b in enumerate(batches)}


def test_removed_rows_leave_the_state(spark, tmp_path):
    batches = [[("a", 1, "push", "x"), (None, 2, "push", "y"), ("b", 3, "other", "z"), ("c", 4, "remove", None)], [("a", 5, "remove", None)], [("c", 6, "push", None)]]
    assert run(spark, tmp_path, batches, {0, 1}) == {"c": (6, None, 1)}


def test_files_are_compared_with_earlier_drops_alone(spark, tmp_path):
    """Names that a message holds stay known through a restart; equal files of one drop all pass."""
    drops = [
        [("m1", 1, "a.png"), ("m1", 2, "a.png"), ("m1", 3, "b.PDF"), ("m1", 4, "c.txt"), ("m2", 5, "a.png")],
        [("m1", 6, "a.png"), ("m1", 7, "a.jpg"), ("m1", 8, "b.PDF"), ("m1", 9, "d+ e.gif"), ("m2", 10, "b.PDF"), ("m1", 11, "c.txt")],
        [("m2", 12, "b.PDF"), ("m1", 13, "d+ e.gif"), ("m1", 14, "a.jpg")],
    ]
    for k, files in enumerate(drops):
        for message, place, name in files:
            folder = tmp_path / "drops" / str(k) / message / str(place)
            folder.mkdir(parents=True)
            (folder / name).write_bytes(f"{name} {place}".encode() * 30)
        intake.take_in(intake.dropped_files(spark, str(tmp_path / "drops")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.place: r.verdict[0] for r in spark.read.parquet(str(tmp_path / "out" / "verdicts")).collect()}
    assert "".join(got[k] for k in range(1, 15)) == "aaaia" + "dadaai" + "ddd"
    blocks = {r.place: (r.type, r.name, base64.b64decode(r.data)) for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).collect()}
    assert set(blocks) == {k for k, v in got.items() if v == "a"}
    assert blocks[9] == ("image", "d+ e.gif", b"d+ e.gif 9" * 30) and blocks[3][0] == "file"
    assert "\n" not in "".join(r.data for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).collect())


def test_a_rewrite_is_seen_before_its_answer_exists(spark, tmp_path):
    kind = "chunk_id string, location string, source string, text string"
    engine = Engine.over(spark.createDataFrame([("c1", "A", "u1", "The cathedral is old."), ("c2", "B", "u2", "The river is long.")], kind), top_k=1)
    source, out = tmp_path / "in", str(tmp_path / "out")
    asked = "question_id long, question string"

    def starts():
        return live.node_streams(engine, spark.readStream.schema(asked).parquet(str(source)), out, str(tmp_path / "cp"))

    def seen(*nodes):
        return sorted((r.question_id, r.step) for r in live.updates(spark, out, nodes).collect())

    spark.createDataFrame([(1, "hello, which cathedral is old?")], asked).coalesce(1).write.parquet(str(source))
    starts()["rewrite"]().awaitTermination()
    assert seen("rewrite") == [(1, 1)] and not (tmp_path / "out" / "retrieve").exists()
    starts()["retrieve"]().awaitTermination()
    spark.createDataFrame([(2, "river?")], asked).coalesce(1).write.mode("append").parquet(str(source))
    for node in ("rewrite", "answer", "answer"):  # the second question is rewritten while the first one is answered, once
        starts()[node]().awaitTermination()
    assert seen("rewrite", "retrieve", "answer") == [(1, 1), (1, 2), (1, 3), (2, 1)]
    for node in ("retrieve", "answer"):
        starts()[node]().awaitTermination()
    got = sorted((r.question_id, r.step, r.delta) for r in live.updates(spark, out).collect())
    want = engine.trace(spark.createDataFrame([(1, "hello, which cathedral is old?"), (2, "river?")], asked))
    assert got == sorted((r.question_id, r.step, r.delta) for r in want.collect())
