"""Packing: every piece once, no bin over its size, best fit on small cases."""

import random
from collections import defaultdict

from tokenizers import Tokenizer

from parley.llm import packing as p
from parley.llm.common import vocabulary_path

from .conftest import counted, pairs


def unrolled(made, histogram):
    """length, bin and place of each piece that a plan means."""
    out = []
    for length, low, high, each, first, start in made.segments:
        out += [(length, first + (k - low) // each, start + (k - low) % each * length) for k in range(low, high)]
    assert sorted(x[0] for x in out) == sorted(x for x, n in histogram.items() for _ in range(n))
    return out


def test_plans_hold():
    rng = random.Random(1)
    for _ in range(200):
        histogram = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        made = p.plan(histogram, (25, 50, 100), 5, 200)
        sizes = {b: (c, f) for low, high, c, f in made.bins for b in range(low, high)}
        held = defaultdict(list)
        for length, number, at in unrolled(made, histogram):
            held[number].append((at, length))
        assert held.keys() == sizes.keys()
        for number, rows in held.items():
            end = 0
            for at, length in sorted(rows):
                assert at == end
                end += length
            capacity, filled = sizes[number]
            assert filled == end <= capacity and not any(end <= c < capacity for c in (25, 50, 100))


def cheapest(lengths, capacities, opening, span):
    """The least cost of all ways to part the lengths into bins."""
    best = {0: 0.0}
    whole = (1 << len(lengths)) - 1
    price = {}
    for some in range(1, whole + 1):
        total = sum(x for k, x in enumerate(lengths) if some >> k & 1)
        if total <= max(capacities):
            price[some] = p.cost(min(c for c in capacities if c >= total), opening, span)
    for some in range(1, whole + 1):
        low, part, found = some & -some, some, []
        while part:
            if part & low and part in price:
                found.append(price[part] + best[some ^ part])
            part = (part - 1) & some
        best[some] = min(found)
    return best[whole]


def test_several_sizes_against_all_partitions():
    """Near the optimum on small cases, and never dearer than best fit into one of the sizes; small and large sizes are both opened."""
    rng, ratios, used = random.Random(5), [], set()
    for _ in range(150):
        capacities, opening, span = (20, 40, 80), rng.choice([1, 4, 12]), rng.choice([40, 160, 10_000])
        lengths = [rng.randint(1, 80 if rng.random() < 0.3 else 30) for _ in range(rng.randint(1, 8))]
        made = p.plan({x: lengths.count(x) for x in lengths}, capacities, opening, span)
        used |= {c for _, _, c, _ in made.bins}
        ratios.append(made.cost(opening, span) / cheapest(lengths, capacities, opening, span))
        single = p.best_fit({x: lengths.count(x) for x in lengths}, (80,), capacities, opening, span)
        assert made.cost(opening, span) <= single.cost(opening, span) + 1e-9
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.04
    assert used == {20, 40, 80}


def test_many_lengths_open_several_sizes():
    rng = random.Random(6)
    histogram = {}
    for _ in range(20_000):
        x = min(4096, int(rng.lognormvariate(6, 1)) + 1)
        histogram[x] = histogram.get(x, 0) + 1
    made = p.plan(histogram)
    by_size = {c: sum(b - a for a, b, size, _ in made.bins if size == c) for c in p.CAPACITIES}
    assert all(n > 20 for n in by_size.values()), by_size
    assert made.cost() < 0.97 * p.best_fit(histogram, (4096,), p.CAPACITIES, p.OPENING, p.SPAN).cost()
    filled, room = (sum((b - a) * x[k] for x in made.bins for a, b in [x[:2]]) for k in (3, 2))
    assert filled / room > 0.97


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_one_size_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        histogram = {x: lengths.count(x) for x in lengths}
        made = p.plan(histogram, (60,), 5, 100)
        assert sorted(60 - f for low, high, _, f in made.bins for _ in range(low, high)) == plain_best_fit(lengths, 60)


def check_places(rows):
    spans = defaultdict(list)
    for r in rows:
        spans[r["bin"], r["capacity"], r["filled"]].append((r["at"], r["length"]))
    assert len({b for b, _, _ in spans}) == len(spans)
    for (_, capacity, filled), held in spans.items():
        end = 0
        for at, length in sorted(held):
            assert at == end
            end += length
        assert end == filled <= capacity


def test_lengths_of_a_column(spark, empty):
    df = spark.createDataFrame([(1, 10), (2, 9000), (None, None), (2, 9000), (3, -4), (4, 4096)], "doc_id long, tokens int")
    rows = p.pack(df, df["tokens"], rows_per_part=2).collect()
    wanted = [(1, 0, 10), (None, 0, 1), (3, 0, 1), (4, 0, 4096)] + [(2, k, n) for k, n in enumerate((4096, 4096, 808))] * 2
    assert counted((r["doc_id"], r["piece"], r["length"]) for r in rows) == counted(wanted)
    check_places(rows)
    assert p.pack(empty, empty["n_chars"]).count() == 0


def test_texts_are_whole(odd, docs, empty):
    """Every text's pieces are exactly its words, in order; lengths are the library's counts of the pieces."""
    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd):
        rows = p.pack_texts(df, path, rows_per_part=20, keep=True).collect()
        check_places(rows)
        assert all(r["length"] == 1 + len(library.encode(r["text"], add_special_tokens=False).ids) for r in rows)
        want = [(i, "".join(text.split())) for i, text in pairs(df)]
        by_doc = defaultdict(list)
        for r in rows:
            assert r["end_char"] - r["first_char"] == len(r["text"])
            by_doc[r["doc_id"], r["piece"]].append("".join(r["text"].split()))
        for i, text in want:
            whole = "".join(sorted(by_doc[i, k])[0] for k in range(sum(d == i for d, _ in by_doc)))
            assert whole == text, i
        assert counted(r["doc_id"] for r in rows if r["piece"] == 0) == counted(i for i, _ in want)
    assert p.pack_texts(empty, path, keep=True).count() == 0


def test_long_words_are_cut(spark):
    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    counter = p.Counter(path)
    texts = ["x1" * 9000 + " tail words", " lead " + "é" * 500 + " " + "ab" * 700 + " end", "a b c " * 300, "中" * 900, ""]
    for text in texts:
        for largest in (16, 64, 4096):
            cut = p.cut_text(counter, text, largest)
            assert all(n <= largest and n == 1 + len(library.encode(text[a:b], add_special_tokens=False).ids) for a, b, n in cut)
            assert "".join("".join(text[a:b].split()) for a, b, _ in cut) == "".join(text.split())


def test_sums_over_words_cut_as_the_walk_does(monkeypatch):
    """Texts longer than a bin, with odd white space, long words and words without tokens, are cut alike on both ways."""
    rng = random.Random(12)
    counter = p.Counter(vocabulary_path("word_bpe_49k.json"))
    words = ["one", "Two,", "three!", "naïve", "中文字符", "x" * 40, "😀", "<|endoftext|>", "a\x1cb", "12345", "é", "́", "ΑΣ", "y" * 700]
    white = [" ", "  ", "\n", "\t", "　", "\x85", " ", " \n "]
    texts = ["".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(white) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", " ", "one " * 500, " one" * 500]
    quick = [[p.cut_text(counter, t, largest) for t in texts] for largest in (8, 64, 300)]
    used = sum(p.cut_between_words(counter, t, 299) is not None for t in texts)
    monkeypatch.setattr(p, "cut_between_words", lambda *a: None)
    assert quick == [[p.cut_text(counter, t, largest) for t in texts] for largest in (8, 64, 300)]
    assert used > 20


def test_what_is_kept_when_words_are_too_many():
    counter = p.Counter(vocabulary_path("word_bpe_49k.json"), 250_000)
    counter.memo = 50
    first, last = [f"word{k}" for k in range(80)], ["word3 other word5", "more"]
    counts = [counter.text(x) for x in (*first, *last)]
    counter.trim(last)
    assert set(counter.words) == {"word3", "other", "word5", "more"}
    assert [counter.text(x) for x in (*first, *last)] == counts
