import json
import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import ledger, timeline
from timeloom.sources import readers
from timeloom.streaming import stateful, streams


def test_json_arrays(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1/segs.json").write_text(json.dumps([{"start": 0, "end": 1.5, "text": "é"}, {"start": 2, "end": 3, "text": "b"}], ensure_ascii=False, indent=2))
    got = readers.read_segments(spark, f"{tmp_path}/*/segs.json")
    assert [tuple(r) for r in got.orderBy("seg_idx").collect()] == [("v1", 0, 0.0, 1.5, "é"), ("v1", 1, 2.0, 3.0, "b")]
    readers.write_json_array(got, f"{tmp_path}/out", "video_id", "seg_idx")
    assert '"text":"é"' in spark.read.text(f"{tmp_path}/out").first().value
    (tmp_path / "v1/segs.json").write_text('[{"start": 0, "odd": 1}]')
    assert readers.read_segments(spark, f"{tmp_path}/*/segs.json", strict=False).first().text is None
    with pytest.raises(ValueError, match="odd"):
        readers.read_segments(spark, f"{tmp_path}/*/segs.json")


def test_captions_meta_and_limits(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhi")
    assert [tuple(r) for r in readers.read_captions(spark, f"{tmp_path}/v/a.vtt").collect()] == [("v", 0, 1.0, 2.0, "hi")]
    (tmp_path / "v/meta.json").write_text(json.dumps({"title": "t", "duration": 520, "extra": 1}, indent=2))
    assert readers.read_meta(spark, f"{tmp_path}/v/meta.json").first().duration == 520.0
    (tmp_path / "c.yaml").write_text("total: 7.2 # all\nstage_limits:\n  section: 3.6\ncall_limits:\n  section: 8\n  polish: 1\n")
    assert [tuple(r) for r in readers.read_limits(spark, f"{tmp_path}/c.yaml", 7.2).collect()] == [("polish", 0.0, 1), ("section", 0.5, 8)]


def test_folder_listing_and_sink(spark, tmp_path):
    for n in ("b.jpg", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    listing = readers.list_files(spark, str(tmp_path))
    assert [r.name for r in listing.collect()] == ["a.jpg", "b.jpg"]
    keep = spark.createDataFrame([("a.jpg",)], "name string")
    assert [r.name for r in readers.files_to_prune(listing, keep).collect()] == ["b.jpg"]
    readers.write_documents(spark.createDataFrame([("v", "# t\nx")], "video_id string, document string"), f"{tmp_path}/docs")
    assert spark.read.text(f"{tmp_path}/docs/video_id=v").count() == 2


def test_ledger_stream_equals_the_batch_fold_and_ends(spark, tmp_path):
    rows = [(r, p, "ab"[(r + p) % 2], (p * 7 % 5) / 4, (p * 3 % 4) / 4) for r in range(6) for p in range(20)]
    calls = spark.createDataFrame(rows, "run_id long, call_pos long, stage string, estimate double, actual double").withColumn("at", F.timestamp_seconds(F.col("call_pos") + 60))
    # A call of another run far ahead closes all runs; then come a late call and one that begins a closed run anew.
    # Spark tells late rows by the watermark that the trigger before went by.
    more = spark.createDataFrame([(99, 0, "a", 0.25, 0.25, 10_000), (99, 2, "a", 0.25, 0.25, 10_001), (1, 50, "a", 0.0, 0.0, 90), (2, 51, "a", 0.25, 0.25, 20_000), (99, 1, "b", 0.0, 0.0, 90_000)], "run_id long, call_pos long, stage string, estimate double, actual double, at long").withColumn("at", F.timestamp_seconds("at"))
    for part in (calls.where("call_pos < 10"), calls.where("call_pos >= 10"), more.where("call_pos = 0"), more.where("call_pos = 2"), more.where("call_pos in (50, 51)"), more.where("call_pos = 1")):
        part.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = streams.file_stream(spark, f"{tmp_path}/in", calls.schema, "*.parquet", 1)
    got = streams.drain(stateful.ledger_stream(stream, {"a": (4.0, 8), "b": (3.0, 4)}, 6.0, "at", "10 seconds", 60.0)).collect()
    limits = spark.createDataFrame([("a", 4.0, 8), ("b", 3.0, 4)], "stage string, money_limit double, call_limit int")
    assert {(r.run_id, r.call_pos): r.verdict for r in got if r.run_id < 6 and r.call_pos is not None and r.call_pos < 50} == {(r.run_id, r.call_pos): r.verdict for r in ledger.admit_each(calls, limits, 6.0).collect()}
    closed = [r.run_id for r in got if r.verdict == "closed"]
    assert sorted(closed) == [0, 1, 2, 2, 3, 4, 5]  # run 2 twice; the last call of 99 comes in the trigger that would have closed it
    # The late call leaves no row; the closed run has its whole budget again.
    assert not [r for r in got if r.call_pos == 50] and [r.verdict for r in got if r.call_pos == 51] == ["admitted"]


def test_paragraph_stream_in_any_order(spark, tmp_path):
    r = random.Random(4)
    rows, lines = [], ["Yes.", "so it is", " ", "and then?", "a longer line of words", "No!"]
    for v in range(4):
        t = 0.0
        for k in range(60):
            t += r.choice([0.1, 0.5, 0.9, 1.2, 1.6, 5.0, 40.0])
            end = t + r.choice([0.5, 2.0, 8.0])
            rows.append((v, k, t, end, r.choice(lines)))
            t = end
    schema = "video_id long, seg_idx int, start double, end double, text string"
    r.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    spark.createDataFrame([(-1, 0, 9e6, 9e6, "")], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    s = streams.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, "*.parquet", 1)
    got = streams.drain(stateful.paragraph_stream(s, delay="2 hours"))
    want = timeline.paragraphs(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.where("video_id >= 0").select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_parts_of_a_stream_are_written_by_several_tasks(spark, monkeypatch):
    """In the order of the parts, and a part at a time; a small one is one file."""
    from timeloom.plans import stream_queries

    rows = spark.range(400).withColumnRenamed("id", "n")
    for at_least, files in ((100, 2), (20_000, 1)):
        monkeypatch.setattr(stream_queries, "_FILE_ROWS", at_least)
        s = stream_queries._as_stream(rows, [F.col("n") >= 200, F.col("n") < 200], spark.range(999, 1000).withColumnRenamed("id", "n"))
        read = streams.drain(s.select("n", F.input_file_name().alias("file"))).collect()
        assert sorted(r.n for r in read) == [*range(400), 999]
        assert len({r.file for r in read if 200 <= r.n < 400}) == files and len({r.file for r in read if r.n < 200}) == files


class Calls:
    """Stands for a state variable or a handle: counts the calls and keeps a value."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "put", "appendList"):
                self.value = args[0]
            return iter(self.value or ()) if name == "get" and isinstance(self.value, list) else self.value if name == "get" else None

        return call


def test_stateful_operators_ask_for_their_state_a_few_times_a_trigger():
    """Each such call is a round trip between the worker and the JVM, so their number must not follow that of the rows."""
    from pyspark.sql import Row

    made = []

    class Handle(Calls):
        def getValueState(self, *args):
            made.append(Calls())
            return made[-1]

        getListState = getMapState = getValueState

    handle = Handle()
    call = Row("run", "pos", "stage", "estimate", "actual", "at", "at_ms")
    run = stateful.Ledger({"a": (40.0, 400)}, 60.0, "run", "pos", 1000)
    run.init(handle)
    assert len(list(run.handleInputRows((1,), iter([call(1, k, "a", 0.1, 0.1, None, 60_000 + k) for k in range(300)]), None))) == 300
    assert handle.calls + sum(m.calls for m in made) <= 4
    made.clear()
    handle.calls = 0
    segment = Row("video_id", "seg_idx", "start", "end", "text")
    line = stateful.Paragraphs("video_id", 1.5, 0.8, 30.0)
    line.init(handle)
    list(line.handleInputRows((1,), iter([segment(1, k, float(k), k + 0.5, "x") for k in range(300)]), None))
    assert handle.calls + sum(m.calls for m in made) <= 4


def test_stream_join_drops_and_counts_late_rows(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "video_id long, frame_idx int, at long").select("video_id", "frame_idx", F.timestamp_seconds("at").alias("at"))
    for part in ([(1, 0, 100), (1, 1, 160)], [(1, 2, 100_000)], [(1, 5, 100_100)], [(1, 3, 110), (1, 4, 100_010)]):
        make(part).coalesce(1).write.parquet(f"{tmp_path}/f", mode="append")
    sections = spark.createDataFrame([(1, "s", 90, 150), (1, "t", 99_990, 100_050)], "video_id long, section_id string, b long, e long")
    for part in (sections.where("b < 1000"), sections.where("b > 1000"), sections.limit(0), sections.limit(0)):
        part.select("video_id", "section_id", F.timestamp_seconds("b").alias("b"), F.timestamp_seconds("e").alias("e")).coalesce(1).write.parquet(f"{tmp_path}/s", mode="append")
    f = streams.file_stream(spark, f"{tmp_path}/f", make([]).schema, "*.parquet", 1)
    s = streams.file_stream(spark, f"{tmp_path}/s", spark.read.parquet(f"{tmp_path}/s").schema, "*.parquet", 1)
    joined = stateful.section_frames_stream(f, s, "video_id", "at", "b", "e", "10 minutes", "1 hour")
    q = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.frame_idx, r.section_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, "s"), (2, "t"), (4, "t")]
    assert stateful.late_rows(q) == 1


def test_session_stream_closes_sessions(spark, small):
    from timeloom.plans.catalog import QUERIES

    closed = {(r.user_id, r.n_events, r.session_start) for r in QUERIES["x_session_stream"](spark, small).collect()}
    batch = {(r.user_id, r.n_events, r.session_start) for r in QUERIES["w1_sessions"](spark, small).collect()}
    assert closed and len(closed - batch) <= 0.02 * len(closed)


def test_a_trigger_that_runs_again_commits_once(spark, tmp_path):
    """Rows are written, the stream fails before its mark is, and starts again."""
    for k in range(3):
        spark.range(5 * k, 5 * k + 5).withColumn("md", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    s = streams.file_stream(spark, f"{tmp_path}/in", schema, "*.parquet", 1)

    def fail(epoch: int) -> None:
        if epoch == 1:
            raise RuntimeError("lost between write and commit")

    with pytest.raises(Exception, match="lost between"):
        streams.append_sections(s, f"{tmp_path}/table", f"{tmp_path}/cp", fail).awaitTermination()
    assert streams.committed(spark, f"{tmp_path}/table", schema).count() == 5
    for _ in range(2):
        streams.append_sections(s, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
        assert sorted(r.id for r in streams.committed(spark, f"{tmp_path}/table", schema).collect()) == list(range(15))
    assert streams.committed(spark, f"{tmp_path}/none", schema).count() == 0
