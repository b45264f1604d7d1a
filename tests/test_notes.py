"""Tasks, passages, files and edits: golden cases."""

import io
import random
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.functions import text as x
from parley.operators import editing, people, retrieval, tasks
from parley.sources import files, tables

NOTE = """# Weekly
- [ ] [[Alice|A]] Send the budget 📅 2026-10-20 ([[#^t3|00:00:05]])
  - [X] Bob Call back (due: Friday), then rest ([[#^t1\\|00:01]], [[#^t2|00:02]])
- [ ]   
- [x] plain
## Transcript
- [ ] decoy
"""


def test_tasks(spark):
    notes = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "id int, body string")
    got = [tuple(r)[1:] for r in tasks.parse_tasks(notes).orderBy("line").collect()]
    assert got == [(1, False, "Send the budget", "Alice", "2026-10-20", "t3", True), (2, True, "Bob Call back, then rest", None, "Friday", "t1", True), (4, True, "plain", None, None, None, True)]
    items = spark.createDataFrame([(1, 0, "Call back, then rest", "Bob", None, ["t1"]), (2, 0, "From the record", "Cy", None, [])], "id int, seq int, task string, owner string, due string, source_turns array<string>")
    found = {(r["id"], r["text"]): (r["owner"], r["editable"]) for r in tasks.source_tasks(notes, items).collect()}
    assert found[1, "Call back, then rest"] == ("Bob", True) and found[2, "From the record"] == ("Cy", False)
    ticked = tasks.tick_lines(notes, spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 0, True)], "id int, line int, done boolean"))
    body = ticked.where("id = 1").first()["body"]
    assert "- [x] [[Alice|A]] Send" in body and "  - [ ] Bob Call" in body and body.startswith("# Weekly\n")


def test_keys_count_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "a  b", None), (1, 1, "a b", None), (1, 2, "a b", "Al"), (2, 0, "a b", None)], "id int, line int, text string, owner string")
    keys = [r["key"] for r in tasks.with_keys(rows).orderBy("id", "line").collect()]
    import hashlib

    assert keys[0] == hashlib.sha256('["a b", null]:1'.encode()).hexdigest() == keys[3]
    assert keys[1] == hashlib.sha256('["a b", null]:2'.encode()).hexdigest() and len(set(keys)) == 3


def test_states(spark):
    found = spark.createDataFrame([(1, "k1", True, True), (1, "k2", True, False), (1, "k3", False, True)], "id int, key string, done boolean, editable boolean")
    old = spark.createDataFrame([(1, "k1", "t1", "2026-01-01", "2025-12-25", False), (1, "k2", "t2", "2026-01-01", "2025-12-25", False), (1, "k9", "t9", "2026-01-01", "2025-12-25", True)], "id int, key string, task_id string, reminder_date string, created_date string, done boolean")
    old = old.withColumns({c: F.col(c).cast("date") for c in ("reminder_date", "created_date")})
    got = {r["key"]: (r["task_id"], str(r["reminder_date"]), r["done"]) for r in tasks.sync_states(found, old, "2026-10-07").collect()}
    assert got["k1"] == ("t1", "2026-01-01", True) and got["k2"] == ("t2", "2026-01-01", False) and got["k3"][1:] == ("2026-10-14", False) and "k9" not in got


def plain_passages(body, heading="Meeting notes"):
    import re

    out, held = [], []

    def flush():
        text = "\n".join(held).strip()
        if text:
            out.append((heading, text))
        held.clear()

    for line in body.splitlines():
        if m := re.match(r"^#{1,3}\s+(.+)", line):
            flush()
            heading = m[1]
            continue
        for k in range(0, len(line) or 1, 1200):
            if sum(map(len, held)) + len(line[k : k + 1200]) > 1600:
                flush()
            held.append(line[k : k + 1200])
    flush()
    return out


def test_passages(spark):
    rng = random.Random(2)
    bodies = ["\n".join(rng.choice(["# One", "## Two  words", "#### four", "#none", "", "x" * rng.randint(1, 3000), "short line"]) for _ in range(20)) for _ in range(20)] + ["", None, "# only"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {}
    for r in retrieval.passages(df).orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append((r["heading"], r["text"]))
    assert got == {k: p for k, b in enumerate(bodies) if (p := plain_passages(b or ""))}


def test_selection_goes_on_behind_what_does_not_fit(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 1), float(rng.randint(0, 9)), rng.randint(50, 400)) for k in range(200)]
    want, left = [], 1500
    for chunk, _, _, cost in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if cost <= left and len(want) < 12:
            want.append(chunk)
            left -= cost
    df = spark.createDataFrame(rows, "chunk int, tier int, score double, cost int")
    assert [r["chunk"] for r in retrieval.select_within(df, 1500).orderBy("number").collect()] == want


def test_names(spark):
    df = spark.createDataFrame([(1, "  Ann  Lee "), (2, "ann lee"), (3, "BOB"), (4, " ")], "seq int, name string")
    assert sorted(r["name"] for r in people.distinct_names(df, []).collect()) == ["Ann Lee", "BOB"]
    assert people.expected_speakers(df, df.limit(0)).count() == 4


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(x.safe_filename(F.lit(" ..a/b: [c]  d. "))) == "a-b- -c- d"
    assert one(x.safe_filename(F.lit(" "))) == "Untitled"
    assert [one(x.format_timestamp(F.lit(s))) for s in (-3, 0.5, 1.5, 3661)] == ["00:00:00", "00:00:00", "00:00:02", "01:01:01"]
    assert [one(x.format_duration(F.lit(s))) for s in (12, 2040, 3900)] == ["12s", "34m", "1h05m"]
    assert one(x.join_words(F.array(*map(F.lit, ["Hi", " ", ",", "(", "you", ")"])))) == "Hi, (you)"
    assert one(x.section(F.lit("a\n## Summary\n_none_\nyes\n### sub\n## B\nno"), "Summary")).startswith("yes")
    assert one(x.escape_label(F.lit("a[b]\\"))) == "a\\[b\\]\\\\"
    assert one(x.percent_path(F.lit("a b/ü.md"))) == "a%20b/%C3%BC.md"


def test_labels_round_trip(spark, tmp_path):
    spans = spark.createDataFrame([("f one", 1.25, 3.5, "Ann B"), ("f one", 0.0, 1.0, "Cy")], "file string, start double, end double, speaker string")
    files.rttm_lines(spans).coalesce(1).write.text(str(tmp_path / "a.rttm"))
    got = sorted(tuple(r) for r in files.read_rttm(spark, str(tmp_path / "a.rttm")).collect())
    assert got == [("f_one", 0.0, 1.0, "Cy"), ("f_one", 1.25, 3.5, "Ann_B")]
    (tmp_path / "l.txt").write_text("0.5\t1.5\tAnn\n\\\t100\t200\n2.0\t2.0\tnobody\n3\t4\t\nx\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.txt")).collect()] == [(0.5, 1.5, "Ann")]


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "date": "2026-01-02", "turns": [{"id": "t1", "speaker": "S0", "start": 0, "end": 2, "text": "hi"}], "assignments": {"S0": {"name": "Ann"}}}')
    (tmp_path / "b.json").write_text("{ broken")
    records = files.read_records(spark, str(tmp_path))
    assert [r["id"] for r in records.collect()] == ["a"]
    labelled = people.label_turns(files.turns_of(records), files.assignments_of(records))
    assert [(r["turn"], r["label"]) for r in labelled.collect()] == [("t1", "Ann")]
    assert files.transcripts(labelled).first()["transcript"] == "**Ann** 00:00:00\nhi ^t1"


def test_audio(spark, tmp_path):
    samples = [0.0, 0.5, -0.5, 2.0]
    made = spark.createDataFrame([(samples, 16000)], "s array<float>, rate int").select(files.encode_wav("s", "rate").alias("w")).first()["w"]
    (tmp_path / "one.wav").write_bytes(made)
    r = files.read_audio(spark, str(tmp_path)).first()
    assert (r["recording"], r["rate"], struct.unpack("<4h", r["pcm"])) == ("one", 16000, (0, 16383, -16383, 32767))


def test_notes_and_links(spark, tmp_path):
    (tmp_path / "people").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "people" / "Ann.md").write_text("---\nrole: 'Lead'\n---\n\nBody [[Bob|him]] and [[Nobody]]")
    (tmp_path / ".hidden" / "x.md").write_text("no")
    notes = files.read_notes(spark, str(tmp_path))
    r = notes.select("stem", files.header_value("header", "role").alias("role"), "body").collect()
    assert [tuple(y) for y in r] == [("Ann", "Lead", "Body [[Bob|him]] and [[Nobody]]")]
    targets = spark.createDataFrame([("Bob", "people/Bob B.md")], "target string, path string")
    assert files.resolve_links(notes.select(F.col("stem").alias("id"), "body"), targets).first()["body"] == "Body [him](people/Bob%20B.md) and Nobody"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.snapshot(spark, path) is None
    tables.replace_table(spark.range(3), path)
    tables.replace_table(tables.snapshot(spark, path).where("id > 0"), path)
    assert sorted(r["id"] for r in tables.snapshot(spark, path).collect()) == [1, 2]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    """A version that no pointer names is not read; parts that a change does not touch stay as they are."""
    path = str(tmp_path / "t")
    tables.upsert_by_key(spark.createDataFrame([(k, f"old {k}") for k in range(200)], "id long, text string"), path, ["id"])
    before = {r["id"]: r["text"] for r in tables.snapshot(spark, path).collect()}
    spark.createDataFrame([(1, "half")], "id long, text string").write.parquet(f"{path}/v-unfinished")
    assert {r["id"]: r["text"] for r in tables.snapshot(spark, path).collect()} == before
    tables.upsert_by_key(spark.createDataFrame([(7, "new"), (500, "more")], "id long, text string"), path, ["id"])
    after = {r["id"]: r["text"] for r in tables.snapshot(spark, path).collect()}
    assert after == before | {7: "new", 500: "more"}
    assert tables.load_record(spark, path, 500).first()["text"] == "more"
    with pytest.raises(KeyError):
        tables.load_record(spark, path, 9999)


def wav(samples, width, channels, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((channels, width, rate, 0, "NONE", ""))
        file.writeframes(b"".join((x + 128 if width == 1 else x).to_bytes(width, "little", signed=width > 1) for x in samples))
    return bytearray(out.getvalue())


def test_sound_of_many_kinds(spark):
    """Samples of 8 to 32 bits, channels averaged, another rate; what is no sound is null and ends nothing."""
    files_ = [wav([0, 64, -64, 127], 1, 1, 8000), wav([0, 16384, -16384, 0], 2, 2, 8000), wav([0, 1 << 22, -(1 << 22)], 3, 1, 8000), wav([1 << 30, 0], 4, 1, 8000), bytearray(b"no sound"), None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(files_)], "id int, content binary").withColumn("a", files.decode_wav("content")).orderBy("id")
    got = [None if r["a"]["pcm"] is None else (r["a"]["rate"], np.frombuffer(r["a"]["pcm"], "<i2").tolist()) for r in df.collect()]
    assert got == [(8000, [0, 16384, -16384, 32512]), (8000, [8192, -8192]), (8000, [0, 16384, -16384]), (8000, [16384, 0]), None, None]
    tone = wav([int(9000 * np.sin(k / 20)) for k in range(4800)], 2, 1, 48_000)
    slow = spark.createDataFrame([(tone,)], "content binary").select(files.decode_wav_16k("content").alias("a")).first()["a"]
    back = np.frombuffer(slow["pcm"], "<i2")
    assert slow["rate"] == 16_000 and len(back) == 1600 and np.abs(back - 9000 * np.sin(np.arange(1600) * 3 / 20)).max() < 500


def test_tones_of_many_events(spark, tmp_path):
    """Tones are dealt into parts by the number of events, however few files these lie in, and a worker gets at most BATCH_ROWS at a time."""
    from parley.plans import stores

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.range(25_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    together = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    for made, want in ((stores.sound_written_and_read, lambda k: 800 * (1 + k % 3)), (stores.sound_sliced, lambda k: 800 * min(1 + k % 3, 2) - 400 * (k % 2))):
        try:
            spark.conf.set(key, "10000")
            rows = made(spark, str(tmp_path))
            assert rows.rdd.getNumPartitions() == 3
            assert spark.range(0, 4000, 1, 1).select(together("id").alias("n")).agg(F.max("n")).first()[0] == files.BATCH_ROWS
            assert {r["id"]: r["n"] for r in rows.where("id % 50 = 7").collect()} == {k: want(k) for k in range(7, 25_000, 50)}
        finally:
            spark.conf.set(key, before)


def test_tones_stay_in_python(spark, small, monkeypatch):
    """A tone is made, encoded and decoded in one pass, to which only its length goes; a large table has no more parts than it needs."""
    from parley.plans import stores

    for made in (stores.sound_written_and_read, stores.sound_sliced):
        plan = made(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    shares = []
    for count in (0, 25_000, 6_000_000, 36_000_000):
        monkeypatch.setattr(stores, "table", lambda *_, n=count: spark.range(n).withColumnRenamed("id", "event_id"))
        monkeypatch.setattr(stores, "spread", lambda rows, keys, n, share: shares.append(share) or rows)
        stores.sound_sliced(spark, small)
    assert shares == [10_000, 10_000, 62_500, 100_000]


def test_tones_of_odd_events(spark, tmp_path):
    """Negative numbers have tones without samples, null has none."""
    from parley.plans import stores

    spark.createDataFrame([(None,), (-8,), (-7,), (-3,), (4,), (5,)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert {r["id"]: (r["n"], r["rate"]) for r in stores.sound_written_and_read(spark, str(tmp_path)).collect()} == {None: (None, None), -8: (0, 8000), -7: (0, 8000), -3: (800, 8000), 4: (1600, 8000), 5: (2400, 8000)}


def test_sounds_encoded_together(spark, monkeypatch):
    """Files are those of each sound by itself, however many are made together, and at a fixed rate the same."""
    monkeypatch.setattr(files, "CHUNK", 7)
    sounds = [[], [0.0, 0.5, -0.5], None, [2.0, -2.0, 1.0, -1.0], [0.1] * 20, [], [0.25], None, [-0.999] * 7]

    def alone(x):
        pcm = (np.clip(np.asarray(x, np.float32), -1, 1) * 32767).astype("<i2").tobytes()
        return bytes(wav(np.frombuffer(pcm, "<i2").tolist(), 2, 1, 8000))

    want = [None if x is None else alone(x) for x in sounds]
    assert list(files._encoded(pd.Series([None if x is None else np.array(x, np.float32) for x in sounds], dtype=object), [8000] * 9)) == want
    assert list(files._encoded(pd.Series([None, None]), [8000, 8000])) == [None, None] and len(files._encoded(pd.Series([], dtype=object), [])) == 0
    df = spark.createDataFrame(list(enumerate(sounds)), "id int, s array<float>").select("id", files.encode_wav("s", F.lit(8000)).alias("a"), files.encode_wav_at(8000)("s").alias("b"))
    for r in df.collect():
        assert (r["a"] and bytes(r["a"])) == (r["b"] and bytes(r["b"])) == want[r["id"]]


def test_usual_sound_is_not_searched(monkeypatch):
    """A whole file of the usual kind is cut behind its header; what differs in anything is left to the reader, with the same result."""
    usual = bytes(wav([3, -4, 5], 2, 1, 8000))
    listed = usual[:4] + struct.pack("<I", 54) + usual[8:36] + b"LIST" + struct.pack("<I", 4) + b"abcd" + usual[36:]
    odd = [usual[:-1], usual + b"\0\0", usual[:4] + bytes(4) + usual[8:], listed, bytes(wav([], 2, 1, 8000)), usual[:30]]
    read = [files._decoded(pd.Series([x]), None).values.tolist() for x in odd]
    opened = wave.open

    def refused(*_):
        raise AssertionError

    monkeypatch.setattr(wave, "open", refused)
    assert files._plain(usual) == (8000, usual[44:]) and files._plain(odd[4]) == (8000, b"")
    for k in (0, 1, 2, 3, 5):
        with pytest.raises(AssertionError):
            files._plain(odd[k])
    monkeypatch.setattr(wave, "open", opened)
    assert [r[0][1] for r in read[:2]] == [usual[44:-2], usual[44:]] and read[3][0] == [8000, usual[44:]] and read[4][0] == [8000, b""]
    assert files._decoded(pd.Series(odd[:4] + [usual]), None)["pcm"].tolist() == [r[0][1] for r in read[:4]] + [usual[44:]]


def test_plain_sound_is_as_written(spark):
    """Samples of 16 bits and one channel come back as they are, without a last odd byte; the same file at another rate is made anew."""
    plain = bytes(wav([-32768, -1, 0, 1, 32767], 2, 1, 16_000))
    cut = plain[:-1]
    df = spark.createDataFrame([(0, bytearray(plain)), (1, bytearray(cut))], "id int, content binary").orderBy("id")
    for decode in (files.decode_wav, files.decode_wav_16k):
        got = [(r["a"]["rate"], np.frombuffer(r["a"]["pcm"], "<i2").tolist()) for r in df.withColumn("a", decode("content")).collect()]
        assert got == [(16_000, [-32768, -1, 0, 1, 32767]), (16_000, [-32768, -1, 0, 1])]
    assert files._plain(plain) == (16_000, plain[44:]) and files._plain(bytes(wav([0, 1], 1, 1, 8000))) is None


def test_edits_of_nothing(spark):
    turns = spark.createDataFrame([(1, 1, "S0", "a")], "id int, turn int, speaker string, text string")
    none = spark.createDataFrame([], "id int, turn int, seq int, speaker string, text string")
    assert editing.edit_turns(turns, none).collect() == turns.collect()
    notes = spark.createDataFrame([(1, "A\n## Transcript\nold\n## Next\nkeep"), (2, "B\n")], "id int, body string")
    new = spark.createDataFrame([(1, "new $1 \\"), (2, "n")], "id int, transcript string")
    assert {r["id"]: r["body"] for r in editing.replace_transcript(notes, new).collect()} == {1: "A\n## Transcript\n\nnew $1 \\\n\n## Next\nkeep", 2: "B\n\n## Transcript\n\nn\n"}


def test_notes_are_parsed_once(spark, small):
    from parley.plans import tasks as plans

    for made in (plans.tasks_with_states, plans.task_state_upsert, plans.task_status_counts):
        assert "Transcript" not in made(spark, small)._jdf.queryExecution().optimizedPlan().toString()
