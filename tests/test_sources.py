import json

from pyspark.sql import functions as F

from lodestrata.sources import exports


def read(spark, source, payload):
    df = spark.createDataFrame([("e", source, json.dumps(payload))], "export_id string, source string, payload string")
    rows = exports.messages(df).orderBy("conv_idx", "msg_idx").collect()
    return [(r.role, r.text) for r in rows], exports.items(exports.messages(df)).collect()


def test_node_map(spark):
    def node(role, parts, t, meta=None):
        return {"message": {"author": {"role": role}, "content": {"parts": parts}, "create_time": t, "metadata": meta or {}}}

    mapping = {"b": node("assistant", ["Hi", {"content_type": "image_asset", "metadata": {"dalle": {"prompt": "a hill"}}}], 2), "a": node("user", ["Hello"], 1, {"attachments": [{"name": "x.pdf"}]}), "c": node("system", ["no"], 0), "d": {"message": None}}
    said, items = read(spark, "chatgpt", [{"id": "k1", "title": "T", "mapping": mapping}])
    assert said == [("user", "Hello\n[Attached: x.pdf]"), ("assistant", "Hi\n[Shared image: a hill]")]
    assert items[0].title == "T" and items[0].n_messages == 2 and items[0].content.startswith("user: Hello")


def test_blocks_and_attachments(spark):
    payload = {"conversations": [{"uuid": "u", "name": "N", "chat_messages": [{"sender": "human", "text": " Q "}, {"sender": "assistant", "content": [{"type": "text", "text": "A"}, {"type": "tool_use"}], "attachments": [{"file_name": "f", "extracted_content": "inside"}], "files": [{"file_name": "g"}]}]}]}
    said, items = read(spark, "claude", payload)
    assert said == [("user", "Q"), ("assistant", "A\n[Attached: f] inside\n[Shared file: g]")] and items[0].title == "N"


def test_parts_history_and_threads(spark):
    assert read(spark, "gemini", {"history": [{"role": "user", "parts": [{"text": "Q"}]}, {"role": "model", "parts": [{"text": "A"}, {"text": "B"}]}]})[0] == [("user", "Q"), ("assistant", "A\nB")]
    assert read(spark, "perplexity", {"threads": [{"id": "t", "messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A", "sources": [{"url": "http://a"}, "b"]}]}]})[0] == [("user", "Q"), ("assistant", "A\n\nSources: http://a, b")]


def test_any_wrapper_and_bare_messages(spark):
    for key in ("conversations", "chats", "threads", "sessions", "data"):
        assert read(spark, "universal", {key: [{"messages": [{"role": "user", "content": "Q"}]}]})[0] == [("user", "Q")]
    assert read(spark, "universal", [{"role": "user", "content": "Q"}, {"role": "ai", "text": "A"}])[0] == [("user", "Q"), ("assistant", "A")]


def test_nothing_to_read(spark):
    df = spark.createDataFrame([("e", "chatgpt", "{broken"), ("f", "claude", None), ("g", "gemini", "{}"), ("h", None, "[]")], "export_id string, source string, payload string")
    assert exports.messages(df).count() == 0


def test_stable_ids(spark):
    conv = {"id": "k", "title": "T", "messages": [{"role": "user", "content": "Q"}]}
    grown = {**conv, "messages": conv["messages"] + [{"role": "assistant", "content": "A"}]}
    a, b = (read(spark, "universal", [c])[1][0].item_id for c in (conv, grown))
    assert a == b and len(a) == 40


def test_transcript_and_detection(spark):
    df = spark.createDataFrame([(1, "User: hello\nthere\nAI: hi\n\nUser: bye"), (2, "no speakers"), (3, None)], "id long, text string")
    assert [(r.id, r.role, r.text) for r in exports.transcript(df).orderBy("id", "turn").collect()] == [(1, "user", "hello\nthere"), (1, "assistant", "hi"), (1, "user", "bye")]
    kinds = spark.createDataFrame([("From Grok today",), ("nothing",)], "t string").select(exports.source_of_text(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["grok", "unknown"]


def test_folders(spark, tmp_path):
    home = tmp_path / "projects" / "p" / "memory"
    home.mkdir(parents=True)
    (home / "a.md").write_text("---\nname: First\ndescription: about it\n---\nWe decided to use Spark for this.\nAnother line of text that is long enough.\n")
    (home / "short.md").write_text("tiny")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r.md").write_text("Rule text that is certainly longer than fifty characters in total.")
    got = {r.kind: r for r in exports.notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"memory", "rule"} and got["memory"].title == "First" and got["memory"].description == "about it" and got["rule"].title == "r"
    assert [r.content for r in exports.decisions(exports.notes(spark, str(tmp_path))).collect()] == ["We decided to use Spark for this."]
    (tmp_path / "STATE.md").write_text("x" * 60_000)
    parts = exports.status_files(spark, str(tmp_path)).orderBy("part").collect()
    assert [len(p.content.split("\n", 1)[1]) for p in parts] == [25_000, 25_000, 10_000]
    (tmp_path / "q.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert [r.id for r in exports.queue_lines(spark, str(tmp_path / "q.jsonl"), "id int").collect()] == [1, 2]
    exports.export_pages(spark.createDataFrame([("s1", "# A\n\nb")], "slug string, markdown string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "slug=s1").is_dir()


def test_tables_in_between_can_be_cleared(spark):
    from lodestrata.tables import clear_scratch, scratch_path, written

    assert written(spark.range(3), "x").count() == 3
    other = scratch_path(spark, "y")
    assert clear_scratch(spark) and not clear_scratch(spark)
    spark.range(2).write.parquet(other)
    assert spark.read.parquet(other).count() == 2
