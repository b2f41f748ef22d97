import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.sources import readers as S
from inkwell.sources import writers as W
from inkwell.streaming.sessions import stream_sessions, windowed_counts


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def chunk(i, kind="prose", role="body"):
    return {"chunk_id": f"s:0001:p0001:c{i:02d}", "parent_id": "s:0001:p0001", "seq_in_parent": i, "type": kind, "role": role, "text": f"文{i}", "char_count": 2}


def test_chapters_are_numbered_over_files(spark, tmp_path):
    put(tmp_path / "002.json", {"source": "s", "chapter": 2, "title": "二", "chunks": [chunk(3)]})
    put(tmp_path / "001.json", {"source": "s", "chapter": 1, "title": "一", "chunks": [chunk(1), chunk(2)]})
    put(tmp_path / "notes.json", {"x": 1})
    rows = S.chapters(spark, str(tmp_path)).orderBy("doc").collect()
    assert [(r.doc, r.chapter, r.text) for r in rows] == [(0, 1, "文1"), (1, 1, "文2"), (2, 2, "文3")] and rows[0].group_id is None


def test_bad_chapters_fail(spark, tmp_path):
    put(tmp_path / "001.json", {"source": "s", "chapter": 1, "title": "一", "chunks": [chunk(1, kind="essay")]})
    with pytest.raises(Exception, match="outside its domain"):
        S.chapters(spark, str(tmp_path)).collect()
    put(tmp_path / "001.json", "{oops")
    with pytest.raises(Exception):  # noqa: B017
        S.chapters(spark, str(tmp_path)).collect()


def test_tags_join_in_file_order(spark, tmp_path):
    put(tmp_path / "a.json", {"k": "甲|乙", "x": None})
    put(tmp_path / "b.json", {"k": "丙"})
    assert [tuple(r) for r in S.tags(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).collect()] == [("k", "甲|乙|丙")]


def test_tables_degrade(spark, tmp_path):
    row = {"type": "person", "id": "P1", "canonical": "关羽", "aliases": ["云长"], "rewriteKeys": ["云长"]}
    put(tmp_path / "e.json", {"meta": {"schemaVersion": 1}, "rows": [row], "policy": {}})
    rows, degraded = S.entity_table(spark, str(tmp_path / "e.json"))
    assert not degraded and rows.first().rewritekeys == ["云长"]
    put(tmp_path / "bad.json", {"meta": {"schemaVersion": 2}, "rows": [row], "policy": {}})
    rows, degraded = S.entity_table(spark, str(tmp_path / "bad.json"))
    assert degraded and rows.count() == 0
    put(tmp_path / "g.json", {"meta": {"normVersion": "v", "corpusChunkCount": 3}, "rows": [{"eventId": "E1", "eventName": "名", "aliases": [], "chunkIds": ["c"], "type": "L1"}]})
    rows, degraded = S.group_table(spark, str(tmp_path / "g.json"))
    assert not degraded and rows.first().chunkids == ["c"]


def test_question_bank(spark, tmp_path):
    ok = {"question": "谁？", "options": {"A": "甲", "B": "乙", "C": "丙", "D": "丁"}, "answer": " 乙 "}
    bad = [{**ok, "answer": "戊"}, {**ok, "question": " "}, {"question": "无", "answer": "甲"}, {**ok, "options": {"A": "甲"}}]
    put(tmp_path / "q.json", [ok, *bad])
    assert S.question_bank(spark, str(tmp_path / "q.json")).count() == 1


def test_markdown_items(spark, tmp_path):
    put(tmp_path / "m.md", "## 生死\n| 题号 | 问 | 答 | 证据 |\n|---|---|---|---|\n| 1 | 问一 | 答 | 第1回：“甲” |\n## 其他\n| 2 | 问二 | 答 | 证 |\n正文")
    rows = S.markdown_items(spark, str(tmp_path / "m.md"), {"生死": "life"}).orderBy("num").collect()
    assert [(r.category, r.num, r.question, r.evidence) for r in rows] == [("life", 1, "问一", "第1回：“甲”"), (None, 2, "问二", "证")]


def test_group_evaluation_is_strict(spark, tmp_path):
    row = {"id": "1", "category": "c", "question": "q", "chunkIds": ["a"], "segCount": 1, "crossChapter": False}
    put(tmp_path / "g.json", {"meta": {}, "rows": [row]})
    assert S.group_evaluation(spark, str(tmp_path / "g.json")).first().chunk_ids == ["a"]
    put(tmp_path / "g2.json", {"meta": {}, "rows": [{k: v for k, v in row.items() if k != "segCount"}]})
    with pytest.raises(Exception, match="without segCount"):
        S.group_evaluation(spark, str(tmp_path / "g2.json")).collect()


def test_vectors_round_trip(spark, tmp_path):
    m = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    (tmp_path / "v.bin").write_bytes(W.vector_bytes(m))
    f = str(tmp_path / "v.bin")
    assert [r.embedding for r in S.vector_file(spark, f, 3).orderBy("doc").collect()] == m
    assert S.vector_file(spark, f, 2).count() == 0
    (tmp_path / "w.bin").write_bytes(b"XXXX" + W.vector_bytes(m)[4:])
    assert S.vector_file(spark, str(tmp_path / "w.bin")).count() == 0


def test_context_ranges(spark, tmp_path):
    put(tmp_path / "c.json", {"groups": [{"groupId": "g", "chapter": 1, "segStart": 2, "segEnd": 3}]})
    assert tuple(S.context_ranges(spark, str(tmp_path / "c.json")).first()) == ("g", 1, 2, 3)


def test_snapshots_listing_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "hit5")], "id string, status string")
    d = str(tmp_path / "runs")
    for run in ("run-2024-01-01-1200", "run-2024-02-01-1200", "notarun"):
        W.run_snapshot(rows, run, d)
    W.run_snapshot(rows, "run-2024-01-01-1200", d)
    assert [r.run_id for r in S.run_listing(spark, d).collect()] == ["run-2024-02-01-1200", "run-2024-01-01-1200"]
    assert spark.read.json(d).count() == 3
    rep = lambda k, v: spark.createDataFrame([(k, v)], "k string, v bigint")
    W.merged_report(rep("a", 1), str(tmp_path / "rep"), "k")
    W.merged_report(rep("b", 2), str(tmp_path / "rep"), "k")
    W.merged_report(rep("a", 3), str(tmp_path / "rep"), "k")
    assert {(r.k, r.v) for r in spark.read.json(str(tmp_path / "rep")).collect()} == {("a", 3), ("b", 2)}
    assert "| a | 0.500 |" in W.summary_markdown(spark.createDataFrame([("a", 0.5)], "k string, rate double"), "Run")


def test_chapter_files_round_trip(spark, tmp_path):
    put(tmp_path / "in" / "001.json", {"source": "s", "chapter": 1, "title": "一", "chunks": [chunk(2), chunk(1)]})
    W.chapter_files(S.chapters(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    (r,) = spark.read.json(str(tmp_path / "out")).collect()
    assert [c.text for c in r.chunks] == ["文1", "文2"]
    far = [(i, "s", 1, "一", f"s:0001:p{i:04d}:c01", f"s:0001:p{i:04d}" if i < 400 else "odd", 1, "prose", "body", str(i), 1, None) for i in range(1, 401)]
    names = "doc bigint, source string, chapter int, title string, chunk_id string, parent_id string, seq_in_parent int, chunk_type string, role string, text string, char_count int, group_id string"
    W.chapter_files(spark.createDataFrame(far, names), str(tmp_path / "far"))
    rows = sorted(spark.read.json(str(tmp_path / "far")).collect(), key=lambda r: r.part)
    assert max(len(r.chunks) for r in rows) <= W.PART and [c.text for r in rows[1:] for c in r.chunks] == [str(i) for i in range(1, 400)] and rows[0].part == -1


def test_segment_dump(spark, tmp_path):
    rows = [(1, "s:0001:p0001", 2, 1, "二\n"), (2, "s:0001:p0001", 1, 1, "一"), (3, None, 1, 1, "x"), (4, "s:0002:p0001", 1, 2, None), (5, "s:0002:p0002", 1, 2, "三")]
    W.segment_dump(spark.createDataFrame(rows, "doc bigint, parent_id string, seq_in_parent int, chapter int, text string"), str(tmp_path / "d"))
    assert {(r.chapter, r.value) for r in spark.read.text(str(tmp_path / "d/segments")).collect()} == {(1, "s:0001:p0001\t一二 "), (2, "s:0002:p0002\t三")}
    assert {(r.parent_id, r.chars) for r in spark.read.json(str(tmp_path / "d/INDEX")).collect()} == {("s:0001:p0001", 3), ("s:0002:p0002", 1)}


def test_budget_goes_down_in_steps(spark):
    rows = spark.createDataFrame([(q, i, "x" * 40) for q in (1, 2, 3) for i in range(1, 6)], "qid bigint, rank int, body string")
    rest = spark.createDataFrame([(1, "n" * 10, "i" * 5), (2, "n" * 97, "i" * 5), (3, None, "i" * 101), (4, None, None)], "qid bigint, next string, intents string")
    got = {r.qid: (r.candidates.count("x" * 40), r.next, r.intents, r.dropped) for r in W.within_budget(rows, rest, budget=100).collect()}
    assert got == {1: (2, "n" * 10, "i" * 5, "candidates"), 2: (2, None, "i" * 5, "candidates,next"), 3: (2, None, None, "candidates,intents"), 4: (0, None, None, "")}
    assert W.within_budget(rows, budget=39).first().candidates == "[]"


def test_reports_and_files(spark, tmp_path):
    counters = spark.createDataFrame([("a", 2)], "category string, total bigint")
    misses = spark.createDataFrame([(i, "a", 0) for i in range(30)], "qid bigint, category string, rank int")
    changes = spark.createDataFrame([(1, "hit5", 1, "miss", 0, "improved")], "qid bigint, to_status string, to_rank int, from_status string, from_rank int, change string")
    text = W.group_summary(counters, changes, misses, "Run")
    assert text.count("\n- a #") == 30 and "improved: #1 miss (0) to hit5 (1)" in text and W.anchor_summary(counters, misses, "Run").count("\n- a #") == 20
    rows = spark.createDataFrame([("P1", "person", "关羽", ["云长"], ["云长"], []), ("P2", "person", "张飞", ["翼德"], ["翼德"], [])], "entity_id string, entity_type string, canonical string, aliases array<string>, keys array<string>, fragments array<string>")
    W.entity_file(rows, str(tmp_path / "e"), "v1", ["羽"])
    back, degraded = S.entity_table(spark, str(tmp_path / "e"))
    assert not degraded and {(r.entity_id, r.canonical, tuple(r.rewritekeys)) for r in back.collect()} == {("P1", "关羽", ("云长",)), ("P2", "张飞", ("翼德",))}
    W.run_snapshot(spark.createDataFrame([(1,)], "a int"), "run-2024-01-01-1200", str(tmp_path / "runs"))
    assert S.run_snapshot(spark, str(tmp_path / "runs"), "run-2024-01-01-1200", "a int").count() == 1
    with pytest.raises(ValueError):
        S.run_snapshot(spark, str(tmp_path / "runs"), "../x", "a int")


def test_payloads(spark):
    alert = json.dumps({"features": [{"properties": {"event": "", "severity": "Minor"}}] * 25})
    rows = S.alert_rows(spark.createDataFrame([(1, alert), (2, "nope"), (3, None)], "id bigint, body string")).collect()
    assert len(rows) == 20 and rows[0].event == "Unknown" and rows[0].severity == "Minor"
    fc = json.dumps({"properties": {"periods": [{"name": "Tonight", "temperature": 0, "temperatureUnit": "C", "windSpeed": "5 mph", "windDirection": "N"}]}})
    r = S.forecast_rows(spark.createDataFrame([(1, fc)], "id bigint, body string")).first()
    assert (r.temperature, r.wind, r.forecast) == ("0°C", "5 mph N", "Unknown")
    df = spark.createDataFrame([(1.23456, -2.0)], "a double, b double")
    assert df.select(S.point_path(F.col("a"), F.col("b"))).first()[0] == "1.2346,-2.0000"


def stream(spark, tmp_path, batches, make):
    src, name = tmp_path / "src", f"out{abs(hash(str(tmp_path))) % 10**8}"
    schema = "event_id bigint, user_id bigint, ts timestamp, event_type string, value double"
    src.mkdir()
    query = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i}")) if False else spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    q = query.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streaming_sessions_equal_the_batch_rule(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, t(0), "signup", 0.0), (2, 1, t(20), "view", 0.0), (3, 1, t(30), "view", 0.0), (4, 1, t(31), "view", 0.0), (5, 2, t(5), "view", 0.0), (6, 1, t(40), "signup", 0.0), (7, 1, t(41), "view", 0.0)]
    got = {r.event_id: r.active for r in stream(spark, tmp_path, [rows], lambda s: stream_sessions(s, "user_id", "event_type = 'signup'"))}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}


def test_streaming_windows_close_behind_the_watermark(spark, tmp_path):
    t = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(1, 1, t(0, 1), "view", 1.0), (2, 1, t(0, 2), "view", 2.0), (3, 1, t(5, 0), "view", 4.0)]
    got = stream(spark, tmp_path, [rows], windowed_counts)
    assert [(r.window_start, r.n, r.total) for r in got] == [(t(0, 0), 2, 3.0)]


def test_markdown_rows(spark, tmp_path):
    put(tmp_path / "s.md", "# 目录\n| 章 | 段 |\n|----|:--:|\n| 1 | a b |\n正文\n")
    assert [r.cells for r in S.markdown_rows(spark, str(tmp_path / "s.md")).orderBy("line_no").collect()] == [["章", "段"], ["1", "a b"]]
