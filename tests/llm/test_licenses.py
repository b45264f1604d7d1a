"""License scans against plain loops over words."""

import random
import re

from parley.llm import licenses as li

from .conftest import counted, pairs

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def stands(words, phrase):
    phrase = phrase.split()
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def plain(doc, text):
    words = plain_words(text)
    found = {label: stands(words, p) for p, label in PHRASES.items()}
    at = sorted(x for own in found.values() for x in own)
    return (doc, len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(k for k, v in found.items() if v)))


def statements(text):
    words = plain_words(text)
    return sorted({label for p, label in PHRASES.items() if stands(words, p)} | {label for label, p in li.STATEMENTS.items() if stands(words, p)})


def check(df):
    got = li.scan_licenses(df).collect()
    assert counted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == counted(plain(i, t) for i, t in pairs(df))
    return got


def test_all_documents(spark, docs, odd, empty):
    assert check(odd) and not check(empty)
    for df in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = dict(pairs(df))
        got = check(df)
        assert any(r["n_base"] for r in got)
        for r in got:
            own = [x for x in r["labels"].split(",") if x and not x.endswith("-notice")]
            assert own == statements(texts[r["doc_id"]])
            assert (r["score"] > 0) == bool(r["labels"]) and 0 <= r["score"] <= 1


def test_phrases_anywhere(spark):
    """Random sequences of the phrases' own words, so that parts of phrases, overlaps and repeats abound."""
    rng = random.Random(2)
    words = ["gnu", "general", "public", "license", "License", "apache", "CC", "by", "mit", "version", "2", "3", "0", "4", "nc", "é", "lesser"]
    texts = [(k, rng.choice((" ", "-", ", ", "\n", "\x00")).join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    texts += [(900, "CC BY " * 3000), (901, "mit license"), (902, "MIT  --  LICENSE"), (903, "mitlicense mit éa license"), (904, "gnu general public license"), (905, "apacheé license"), (906, "the KK license mit")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in check(df):
        own = [x for x in r["labels"].split(",") if x and not x.endswith("-notice")]
        assert own == statements(dict(texts)[r["doc_id"]])
        assert sorted({p["label"] for p in r["places"]}) == own
        if r["doc_id"] == 900:
            assert r["n_base"] == 3000 and r["last_word"] == 5998


def filler(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_notices_whole_damaged_and_partial(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k, (label, (text, _)) in enumerate(li.NOTICES.items()):
        words, at = text.split(), -4 if label == "bsd-notice" else 3  # not within a key phrase
        for j, (body, there) in enumerate([
            (text, True), (text.upper(), True), (" ".join(f"// {w}" if i % 9 == 0 else w for i, w in enumerate(words)), True),  # comment marks
            (" ".join([*words[:at], "(added)", *words[at:]]), True), (" ".join(words[: len(words) // 4]), False), (" ".join(reversed(words)), False), (" ".join(rng.sample(words, len(words))), False),
        ]):
            rows.append((10 * k + j, f"{filler(rng, rng.randint(0, 300))} {body} {filler(rng, rng.randint(0, 300))}"))
            want[10 * k + j] = there and label
    rows += [(5000 + k, filler(rng, 100)) for k in range(50)]
    rows += [(6000, " ".join(t for t, _ in li.NOTICES.values())), (6001, (li.NOTICES["mit-notice"][0] + " ") * 200)]
    for r in li.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = [x for x in r["labels"].split(",") if x.endswith("-notice")]
        if r["doc_id"] == 6000:
            assert own == sorted(li.NOTICES)
        elif r["doc_id"] == 6001:
            assert own == ["mit-notice"]
        elif want.get(r["doc_id"]):
            assert own == [want[r["doc_id"]]] and r["score"] >= 4 / 6, (r["doc_id"], r["labels"])
        else:
            assert not own


def test_the_statement_says_the_same(spark):
    """The SQL over the driver's documents and over notices whole, damaged and mixed with phrases."""
    import duckdb

    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for k in range(200):
        parts = [rng.choice([*(t for t, _ in li.NOTICES.values()), *PHRASES, *li.STATEMENTS.values(), filler(rng, 30)]) for _ in range(rng.randint(1, 5))]
        words = " ".join(parts).split()
        rows.append((10**6 + k, " ".join(w for w in words if rng.random() > k % 3 * 0.03)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", df.toPandas())
    want = connection.execute(li.license_sql()).fetchall()
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert counted((*r[:-1], round(r[-1], 9)) for r in want) == counted((*r[:-1], round(r[-1], 9)) for r in map(tuple, li.scan_licenses(df).select(columns).collect()))
    assert any(0 < r[-1] < 1 for r in want)


def test_equal_texts_and_plan(spark, docs):
    df = docs.select("doc_id", "text").limit(20)
    both = df.unionByName(df)
    got = [tuple(r) for r in li.scan_licenses(both).collect()]
    assert sorted(map(repr, got))[::2] == sorted(map(repr, got))[1::2]
    plan = li.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(") == 1  # words are taken from a text once
