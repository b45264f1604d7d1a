"""Headers of notes: known texts, and values that are written and read again."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import headers as h

KNOWN = {
    "title: A note\ndate: 2026-01-02\nn: 5\nx: 1.5\nok: yes\nnone:\n": {"title": "A note", "date": "2026-01-02", "n": 5, "x": 1.5, "ok": True, "none": None},
    "people:\n- Ann\n- 'Bob: B''s'\ntags: [a, \"b, c\", [1, 2], {k: v}]": {"people": ["Ann", "Bob: B's"], "tags": ["a", "b, c", [1, 2], {"k": "v"}]},
    "a:\n  b:\n    c: 1\n  d: # comment\n    - x: 1\n      y: 2\n    - z\n    -\n      - deep\ne: 'a # b' # c": {"a": {"b": {"c": 1}, "d": [{"x": 1, "y": 2}, "z", ["deep"]]}, "e": "a # b"},
    "text: |\n  one\n    two # kept\n\n  three\nnext: >-\n  a\n  b\n\n  c": {"text": "one\n  two # kept\n\nthree\n", "next": "a b\nc"},
    "link: '[[Project]]'\nurl: http://x.y/z#q\n\"odd key\": \"tab\\t\\u00e9\"": {"link": "[[Project]]", "url": "http://x.y/z#q", "odd key": "tab\té"},
    "list: [a,\n  b]\nmap: {x: 1,\n  y: [2]}": {"list": ["a", "b"], "map": {"x": 1, "y": [2]}},
    "": None, "# only a comment": None, "just text": "just text", "- 1\n- 2": [1, 2],
}
BROKEN = ["a: [1", "a: 'open", "x\ny", "a: 1\n  b: 2", "a: {b: 1", "a: *ref", "a: [1] 2"]


def test_known_texts():
    for text, want in KNOWN.items():
        got = h.parse(text)
        assert got == want and (not isinstance(want, dict) or list(got) == list(want)), text
    for text in BROKEN:
        try:
            raise AssertionError(f"{text!r} gave {h.parse(text)!r}")
        except h.Broken:
            pass


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=6), x, max_size=3), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.text(max_size=6), VALUES, max_size=4))
def test_what_is_written_is_read_again(value):
    assert h.parse(h.dumped(value)) == (value or {})


def test_columns(spark):
    df = spark.createDataFrame([*((t,) for t in KNOWN), *((t,) for t in BROKEN), (None,), ("a: 1\r\nb: [2]\r\n",)], "t string")
    got = {r["t"]: r for r in df.select("t", h.header_json("t").alias("j"), F.to_json(h.header_map("t")).alias("m"), h.written_header(h.header_json("t")).alias("w")).collect()}
    for text, want in KNOWN.items():
        assert json.loads(got[text]["j"]) == want and h.parse(got[text]["w"][4:-4]) == want
        assert json.loads(got[text]["m"]) == (want if isinstance(want, dict) else {})
    assert all(got[t]["j"] is None and got[t]["m"] == "{}" and got[t]["w"] is None for t in [*BROKEN, None])
    assert json.loads(got["a: 1\r\nb: [2]\r\n"]["j"]) == {"a": 1, "b": [2]}
