"""Reading of answers against a plain scanner, shapes, and calls of the model counted."""

import json
import random
import re

from pyspark.sql import functions as F

from parley.operators import answers as a


def scanned(text):
    """From the first brace to where it is closed, character by character."""
    start = text.find("{")
    if start < 0:
        return None
    depth, inside, k = 0, False, start
    while k < len(text):
        c = text[k]
        if inside:
            if c == "\\":
                k += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : k + 1]
        k += 1
    return text[start:]


def test_objects_are_found_as_by_a_plain_scanner(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices('{}"\\a \n,:', k=rng.randint(0, 25))) for _ in range(600)] + ['x {"a": "' + "\\\\" * 20000 + '"} y', "{" * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", a.balanced_object(F.col("t")).alias("found"))
    assert {r["id"]: r["found"] for r in df.collect()} == {k: scanned(t) for k, t in enumerate(texts)}


def test_odd_answers(spark):
    texts = {'{"a": 1}': '{"a":1}', '<think>{"x": 2}</think> {"a": "}{"}': '{"a":"}{"}', 'so {"a": "b\\"}"} tail }': '{"a":"b\\"}"}', "```json\n[1, 2]\n``` {": "[1,2]", "none": None, "": None, '{"a": {"b": 1}': None, "```no``` ```{}```": "{}"}
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", F.to_json(a.extract_json("t")).alias("v")).collect()}
    assert got == {**texts, None: None}


def test_shapes_and_verdicts(spark):
    cases = {
        '{"summary": "s"}': None, '[]': "no JSON object", "nothing": "no JSON object", '{"summary": null}': "summary: no text", '{"summary": "s", "topics": [5]}': "topic: no object",
        '{"summary": "s", "topics": [{"points": []}]}': "title: no text", '{"summary": "s", "topics": [{"title": "t", "points": "p"}]}': "points: no list", '{"summary": "s", "topics": [{"title": "t", "points": [{"text": 4}]}]}': "points: no text",
        '{"summary": "s", "action_items": [{"task": "  "}]}': "task: none", '{"summary": "s", "action_items": [{"task": "t", "owner": 5}]}': "owner: no text", '{"summary": "s", "open_questions": [1]}': "open_questions: no list of texts",
        '{"summary": "s", "topics": [{"title": "t", "source_turns": "t1"}]}': "source_turns: no list of texts",
    }
    df = spark.createDataFrame([*((t,) for t in cases), (None,)], "t string")
    assert {r["t"]: r["error"] for r in df.select("t", a.notes(a.extract_json("t"))["error"].alias("error")).collect()} == {**cases, None: "no JSON object"}
    for value, want in {"null": ("", [], []), "0": ("", [], []), "false": ("", [], []), "true": ("true", ["true"], []), "{}": ("", [], []), '{"title": 5}': ('{"title":5}', ['{"title":5}'], []), '[" a ", null, ""]': ('[" a ",null,""]', ["a"], []), '[{"title": 5, "text": null}]': ('[{"text":null,"title":5}]', ['{"text":null,"title":5}'], [("5", "")])}.items():
        v = F.parse_json(F.lit(value))
        r = spark.range(1).select(*(a.section(v, F.lit(s))[s].alias(s) for s in a.SHAPES)).first()
        assert (r["text"], r["list"], [tuple(x) for x in r["items"]]) == want, value


def test_calls_of_the_model(spark, tmp_path):
    """Each part is asked once, those that do not fit once more; merges hold ``fan_in`` answers at most and leave out what failed."""
    log = str(tmp_path / "calls")

    def model(prompts):
        out = []
        for p in prompts:
            with open(log, "a") as file:
                file.write(json.dumps(p) + "\n")
            asked, _, again = p.partition("\n\nYour previous reply")
            if asked.startswith("Transcript"):
                text = asked.partition("\n")[2]
                out.append("no" if text.startswith("never") or text.startswith("once") and not again else json.dumps({"summary": text}))
            else:
                out.append(json.dumps({"summary": "+".join(x["summary"] for x in json.loads(asked.partition("\n")[2]))}))
        return out

    rows = [("m", k, "never" if k == 4 else f"once{k}" if k % 5 == 0 else f"p{k}") for k in range(12)] + [("one", 0, "alone"), ("bad", 0, "never"), (None, 0, None), (None, 1, "x")]
    done = {r["m"]: r for r in a.summarised(spark.createDataFrame(rows, "m string, part int, text string"), model, ["m"], fan_in=3).collect()}
    assert done["m"]["notes"]["summary"] == "+".join(f"once{k}" if k % 5 == 0 else f"p{k}" for k in range(12) if k != 4)
    assert done["m"]["merges"] == 6 and done["m"]["failed"] == 1  # eleven: 4 groups, one of two; then two; then one
    assert (done["one"]["notes"]["summary"], done["one"]["merges"]) == ("alone", 0) and done["bad"]["notes"] is None and done["bad"]["failed"] == 1
    calls = [json.loads(x) for x in open(log)]
    assert sum(c.startswith("Transcript") for c in calls) == 16 + 5 and sum(c.startswith("Partial") for c in calls) >= 6
    assert max(len(re.findall('"summary"', c)) for c in calls) == 3


def test_citations_given_twice(spark):
    """What is cited twice is one source turn, and two citations."""
    reply = '{"summary": "s", "topics": [{"title": "t", "points": [{"text": "p", "source_turns": ["t1", "t2"]}], "source_turns": ["t1"]}]}'
    topic = spark.createDataFrame([(reply,)], "reply string").select(a.notes(a.extract_json("reply")).alias("n")).first()["n"]["topics"][0]
    assert topic["source_turns"] == ["t1", "t2"] and topic["cited"] == ["t1", "t1", "t2"]
