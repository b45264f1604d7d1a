"""Secret scans against plain loops."""

import hashlib
import re

from parley.llm import secrets as s

from .conftest import counted, pairs


def plain(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def test_base_spans(spark, docs, odd):
    for df in (docs, odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = s.scan_secrets(df).collect()
        want = []
        for i, t in pairs(df):
            spans = plain(t)
            kinds = [k for *_, k in spans]
            joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
            want.append((i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined.encode()).hexdigest()))
        assert counted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == counted(want)
        for r in got:
            base = [x for x in r["spans"].split(",") if x and x.split(":")[0] in ("assign", "access", "hex")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_ownership(spark):
    live, shared = "Zx9Kq2Lm8Pw4Rt7v", "Qw3Er5Ty7Ui9Op1a"
    rows = [(1, f"password = {live}", "a"), (2, f"token: '{live}' again", "a"), (3, f"secret={shared}", "a"), (4, f"secret={shared} in b", "b"), (5, f"secret={shared} in c", "c"), (6, "password=changeme12345", "a"), (7, f"token = {shared} 😀 passwd = {live}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in s.scan_secrets(df).collect()}
    assert [got[k]["n_live"] for k in range(1, 8)] == [1, 1, 0, 0, 0, 0, 1]
    assert [got[k]["n_example"] for k in range(1, 8)] == [0, 0, 1, 1, 1, 0, 1]
    assert got[1]["spans"] == "assign:0:27,live:11:27"
    clean = {r["doc_id"]: r["text"] for r in s.redact_live(df).collect()}
    assert clean[1] == "password = [secret]" and clean[7] == f"token = {shared} 😀 passwd = [secret]" and clean[3] == f"secret={shared}"


def verdicts(rows):
    """By doc_id: live values, example values, most owners, repositories and texts; rows: (doc_id, text, source), ids distinct."""
    holders = {}
    for i, text, owner in rows:
        for *_, c, d in s.find(text or ""):
            holders.setdefault(text[c:d], set()).add((owner or "", i, text))
    owners = {v: len({o for o, *_ in h}) for v, h in holders.items()}
    texts = {v: len({t for *_, t in h}) for v, h in holders.items()}
    kind = {v: "example" if owners[v] >= 3 or owners[v] >= 2 and len(h) >= 20 else "live" if s.looks_live(v) else "" for v, h in holders.items()}
    want = {}
    for i, text, _ in rows:
        own = [text[c:d] for c, d in {(c, d) for *_, c, d in s.find(text or "")}]
        want[i] = (sum(kind[v] == "live" for v in own), sum(kind[v] == "example" for v in own), *(max((x(v) for v in own), default=0) for x in (owners.get, lambda v: len(holders[v]), texts.get)))
    return want


def judged(spark, rows):
    found = s.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    return {r["doc_id"]: (r["n_live"], r["n_example"], r["most_owners"], r["most_repositories"], r["most_texts"]) for r in found}


def test_verdicts_are_plain_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert judged(spark, rows) == verdicts(rows)


def test_an_owners_own_value_is_live_and_a_copied_sample_an_example(spark):
    own = [(k, f"note {k} password = Zx9Kq2Lm8Pw4", "one owner") for k in range(25)]  # one owner's value in 25 repositories
    copied = [(1000 + k, "secret=Qp7Rt5Xc3Vb1 in one text", f"owner {k}") for k in range(500)]  # one text, word for word
    two = [(2000 + k, f"{k} token: a1b2c3", f"owner {k % 2}") for k in range(19)]  # two owners, too few repositories
    many = [(3000 + k, f"{k} token: d4e5f6", f"owner {k % 2}") for k in range(20)]
    got = judged(spark, own + copied + two + many)
    assert got == verdicts(own + copied + two + many)
    assert got[3] == (1, 0, 1, 25, 25) and got[1003] == (0, 1, 500, 500, 1) and got[2003] == (1, 0, 2, 19, 19) and got[3003] == (0, 1, 2, 20, 20)
    clean = {r["doc_id"]: r["text"] for r in s.redact_live(spark.createDataFrame(own + copied, "doc_id long, text string, source string")).collect()}
    assert clean[3] == "note 3 password = [secret]" and clean[1003] == copied[3][1]


def test_redaction_keeps_all_else(spark):
    hexes = "9f3ac07be18d4526a9c0b71e"
    rows = [
        (1, f"token = sk-{hexes} and the rest stays 😀", "a"),
        (1, f"another text with that id: {hexes}", "a"),
        (None, f"secret: {hexes}Z1 then password=hunter42 end", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, f"password={hexes}", "b"),
    ]
    clean = s.redact_live(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert counted(tuple(r) for r in clean) == counted([
        (1, "token = [secret] and the rest stays 😀", "a"),
        (1, "another text with that id: [secret]", "a"),
        (None, "secret: [secret] then password=[secret] end", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, "password=[secret]", "b"),
    ])


def test_odd_input(odd, empty):
    assert s.scan_secrets(odd).count() == odd.count() == s.redact_live(odd).count()
    assert s.redact_live(odd).columns == odd.columns
    assert s.scan_secrets(empty).count() == 0 == s.redact_live(empty).count()
