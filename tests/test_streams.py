"""Streams: several batches, restart without repeats, replayed batch."""

import shutil

from riskspark.plans import bindings, roster
from riskspark.sources.refdata import builtin_refdata
from riskspark.streaming import deid_stream, rescore_stream

REF = builtin_refdata()
SF = "/root/testdata/sf0.001"


def test_rescore_in_batches(spark, tmp_path):
    dx = bindings.diagnoses(spark, SF).select("member_id", "icd10")
    members, code_map = bindings.members(spark, SF), bindings.code_map(spark, SF, REF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    expected = lambda d: {tuple(r) for r in roster.member_result(roster.score_roster(members.join(d.select("member_id"), "member_id", "left_semi"), d, code_map, REF), REF).collect()}

    def arrive(part):
        dx.where(f"abs(hash(icd10)) % 3 = {part}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(dx.schema).option("maxFilesPerTrigger", 1).parquet(source)
        rescore_stream.start(stream, members, code_map, REF, out).awaitTermination()
        return {tuple(r) for r in rescore_stream.current_scores(spark, out).collect()}

    assert arrive(0) == expected(dx.where("abs(hash(icd10)) % 3 = 0"))
    assert arrive(1) == expected(dx.where("abs(hash(icd10)) % 3 < 2"))
    assert arrive(2) == expected(dx)
    # losing the checkpoint replays everything onto the same output, as a new run
    shutil.rmtree(tmp_path / "out" / "checkpoint")
    stream = spark.readStream.schema(dx.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert rescore_stream.run_number(spark, out) == 1
    rescore_stream.start(stream, members, code_map, REF, out).awaitTermination()
    assert {tuple(r) for r in rescore_stream.current_scores(spark, out).collect()} == expected(dx)
    assert rescore_stream.run_number(spark, out) == 2


def test_rescore_shows_no_partial_replay(spark, tmp_path):
    """A run that has replayed the first of two arrivals does not hide what the run before knew."""
    dx = bindings.diagnoses(spark, SF).select("member_id", "icd10")
    members, code_map = bindings.members(spark, SF), bindings.code_map(spark, SF, REF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    shown = lambda: {tuple(r) for r in rescore_stream.current_scores(spark, out).collect()}
    for part in (0, 1):
        dx.where(f"abs(hash(icd10)) % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        rescore_stream.start(spark.readStream.schema(dx.schema).parquet(source), members, code_map, REF, out).awaitTermination()
    before = shown()
    shutil.rmtree(tmp_path / "out" / "checkpoint")
    first = str(tmp_path / "first")
    dx.where("abs(hash(icd10)) % 2 = 0").coalesce(1).write.parquet(first)
    rescore_stream.start(spark.readStream.schema(dx.schema).parquet(first), members, code_map, REF, out).awaitTermination()
    assert shown() == before
    # the same run goes on when more arrives
    dx.where("abs(hash(icd10)) % 2 = 1").coalesce(1).write.mode("append").parquet(first)
    rescore_stream.start(spark.readStream.schema(dx.schema).parquet(first), members, code_map, REF, out).awaitTermination()
    assert shown() == before
    assert sorted(p.name for p in (tmp_path / "out" / "scores").glob("run=*")) == ["run=0", "run=1"]


def test_rescore_of_odd_members(spark, tmp_path):
    """A member without mapped codes, one with a null code and a member that nobody knows."""
    dx = spark.createDataFrame([(1, "nothing"), (2, None), (999_999, "Z00001")], "member_id bigint, icd10 string")
    members, code_map = bindings.members(spark, SF), bindings.code_map(spark, SF, REF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        dx.write.mode("append").parquet(source)
        rescore_stream.start(spark.readStream.schema(dx.schema).parquet(source), members, code_map, REF, out).awaitTermination()
    got = rescore_stream.current_scores(spark, out).collect()
    assert sorted(r.member_id for r in got) == [1, 2] and all(r.active_hccs == "" for r in got)
    assert not (tmp_path / "out" / "history").exists()
    latest = spark.read.parquet(f"{out}/scores/run=0/batch_id=1")
    assert {r.n_rows for r in latest.collect()} == {2}


def test_deid_stream_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, "nothing")], "note_id int, text string")
    for _ in range(2):
        notes.write.mode("append").parquet(source)
        stream = spark.readStream.schema(notes.schema).parquet(source)
        deid_stream.start(stream, out).awaitTermination()
    rows = deid_stream.read_output(spark, out)
    assert rows.count() == 4 and rows.where("sanitized_text LIKE '%123-45%'").count() == 0
