"""The join against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import jaccard_join as j
from parley.llm.components import components

from .conftest import ODD, pairs


def shingles(text, width):
    words = text.encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent, width):
    sets = {i: shingles(t, width) for i, t in rows}
    held, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for k in held[x]:
                both[k] += 1
            held[x].append(i)
        for k, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[k]) - n):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(count, seed=1):
    """Texts of many lengths with copies that differ by growing shares, and passages that many of them have."""
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=50)
    for base in range(count):
        own = rng.choices(words, k=rng.choice([1, 3, 4, 5, 8, 12, 20, 45, 50, 60, 120, 300, 800]))
        if base % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            edited = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((len(rows) * 7 + 3, " ".join(edited)))
    rng.shuffle(rows)
    return rows


def found(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_groups(df, **options).collect()}


@pytest.mark.parametrize("percent, width", [(85, 4), (80, 5), (50, 2)])
def test_families(spark, percent, width):
    rows = families(90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, percent, width)
    assert found(df, percent=percent, width=width) == want


def test_blocks_that_are_cut(spark):
    rows = families(40, 2) + [(10_000 + k, " ".join(f"z{(k * 7 + n) if n % 90 == k % 90 else n}" for n in range(90))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 85, 4)
    assert found(df, block=600, broadcast_rows=10) == want


def nested(rng):
    """Sets that grow out of one another by about as much as a link allows, with branches that differ from each other."""
    fresh, found = iter(range(10**6)), []
    for _ in range(rng.randint(1, 2)):
        chain = [{next(fresh) for _ in range(rng.randint(60, 130))}]
        for _ in range(rng.randint(2, 6)):
            chain.append(chain[-1] | {next(fresh) for _ in range(rng.randint(len(chain[-1]) // 20, len(chain[-1]) // 6))})
        found += chain
        for base in rng.choices(chain, k=rng.randint(1, 3)):
            found += [base | {next(fresh) for _ in range(len(base) // 9)} for _ in range(rng.randint(1, 3))]
    return found


def test_links_of_nested_sets():
    """A follower outside the largest group links with a later leader inside it; sets of equal size come in any order."""
    small = set(range(100))
    b = small | set(range(200, 210))
    a = b | set(range(300, 312))
    cases = [[small, b, a, a | set(range(400, 413)), a | set(range(500, 513))]]
    rng = random.Random(6)
    cases += [nested(rng) for _ in range(120)]
    for sets in cases:
        rows = [np.array(sorted(x), np.uint64) for x in sets]
        for _ in range(4):
            order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), rng.random()))
            own = [rows[k] for k in order]
            want, got = ({k: k for k in range(len(own))} for _ in range(2))
            every = [(x, y) for x in range(len(own)) for y in range(x) if 100 * (n := len(np.intersect1d(own[x], own[y]))) >= 85 * (len(own[x]) + len(own[y]) - n)]
            for parent, edges in ((want, every), (got, j.links(own, list(range(len(own))), [True] * len(own), 85))):
                for x, y in edges:
                    x, y = parent[x], parent[y]
                    parent.update({k: min(x, y) for k, v in parent.items() if v in (x, y)})
            assert got == want, [len(x) for x in own]


def chains(count, seed=3):
    """Texts that grow by so much that only neighbours link; the last ones have branches that differ from each other."""
    rng, rows = random.Random(seed), []
    for base in range(count):
        words = [f"{base}v{k}" for k in range(100)]
        for step in range(4):
            rows.append((len(rows), " ".join(words)))
            words = words + [f"{base}s{step}n{k}" for k in range(11 + step)]
        for branch in range(rng.randint(2, 9)):
            rows.append((len(rows), " ".join([*words, *(f"{base}b{branch}n{k}" for k in range(3))])))
    rng.shuffle(rows)
    return [(k * 3 + 1, text) for k, (_, text) in enumerate(rows)]


def test_chains_at_several_block_sizes(spark):
    rows = chains(25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 85, 4)
    assert len({c for _, c in want.values()}) == 25
    for block in (300, 900, 600_000):
        assert found(df, block=block) == want, block


def test_documents(docs):
    assert found(docs) == brute(pairs(docs), 85, 4)


def test_signatures_are_shared():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for size in [2, 5, 7, 9, 20, 46, 47, 48, 60, 75, 200, 900]:
            for _ in range(40):
                base = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
                lost = int(rng.integers(0, len(base) * (100 - percent) // 100 + 1))
                more = rng.integers(0, 1 << 64, int(rng.integers(0, 3)), np.uint64)
                other = np.unique(np.concatenate((rng.permutation(base)[lost:], more)))
                both = len(np.intersect1d(base, other))
                if 100 * both >= percent * (len(base) + len(other) - both) and len(base) + len(other) > 2 * both:
                    frequent = np.sort(rng.permutation(base)[: len(base) // 3])
                    a, b = (j.signatures(x, percent, frequent) for x in (base, other))
                    assert len(np.intersect1d(a, b)), (percent, len(base), len(other), both)


def test_divide_skip(monkeypatch):
    monkeypatch.setattr(j, "PROBED", 3)
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        index = j.Inverted(np.array([len(x) for x in lists]))
        for member in range(60):
            index.add(np.array([k for k, x in enumerate(lists) if member in x], np.int64), member)
        needed = rng.randint(1, len(lists) + 1)
        want = [(x, n) for x in range(60) if (n := sum(x in y for y in lists)) >= needed]
        assert j.divide_skip(index, np.arange(len(lists)), needed) == want


@pytest.mark.parametrize("mapped", [0, 1, 3, 64])
def test_long_lists_as_bits(monkeypatch, mapped):
    """Whichever lists are kept as bits, members are the same; ranges of members and lists that grow count too."""
    monkeypatch.setattr(j, "MAPPED", mapped)
    rng = random.Random(9)
    for _ in range(150):
        lists = [sorted(rng.sample(range(90), rng.choice([0, 1, 2, 5, 30, 85]))) for _ in range(rng.randint(1, 90))]
        index = j.Inverted(np.array([len(x) for x in lists]), rng.choice([None, 90]))
        for upto in (45, 90):
            for member in range(upto - 45, upto):
                index.add(np.array([k for k, x in enumerate(lists) if member in x], np.int64), member)
            own, needed = sorted(rng.sample(range(len(lists)), rng.randint(1, len(lists)))), rng.randint(1, len(lists))
            low, high = rng.choice([(0, 1 << 31), (20, 60), (40, 41)])
            want = [(x, n) for x in range(low, min(high, upto)) if (n := sum(x in lists[k] for k in own)) >= needed]
            assert j.divide_skip(index, np.array(own), needed, low, high) == want


def test_a_large_family_is_not_merged_list_by_list(monkeypatch):
    """Of many sets near one another, most too far to link, no lists go through the heap, and links are those of brute force."""
    monkeypatch.setattr(j, "merge_skip", lambda *_: pytest.fail("merged"))
    rng, base, rows = random.Random(10), list(range(200)), []
    for k in range(300):
        lost = set(rng.sample(base, rng.choice([4, 10, 14, 20, 30])))
        rows.append(np.array(sorted((set(base) - lost) | {1000 * (k + 1) + x for x in range(len(lost))}), np.uint64))
    rows.sort(key=len)
    want, got = ({k: k for k in range(len(rows))} for _ in range(2))
    every = [(x, y) for x in range(len(rows)) for y in range(x) if 100 * (n := len(np.intersect1d(rows[x], rows[y]))) >= 85 * (len(rows[x]) + len(rows[y]) - n)]
    for parent, edges in ((want, every), (got, j.links(rows, list(range(len(rows))), [True] * len(rows), 85))):
        for x, y in edges:
            x, y = parent[x], parent[y]
            parent.update({k: min(x, y) for k, v in parent.items() if v in (x, y)})
    assert got == want and 50 < len(set(want.values())) < 250


def test_sets_of_many_texts_at_once(monkeypatch):
    """Texts shingled together get the sets that each has alone; words are told apart by all their bytes and by nothing else."""
    rng = random.Random(8)
    letters = ["a", "B", "é", "\x1c", "\x85", "\u2028", "\0", "中", "😀"]
    texts = [x or "" for x in ODD] + ["".join(rng.choices([*letters, " ", "\t", "\x0b", "\r\n"], k=rng.randint(0, 60))) for _ in range(300)]
    texts += [" ".join(("x" * n + end, "y", "z", "w")) for n in (0, 7, 8, 9, 63, 64, 65, 200) for end in ("", "a", "b", "\0", "A")]
    raws = [x.encode() for x in texts]
    for together in (1, 300, 1 << 19):
        monkeypatch.setattr(j, "TOGETHER", together)
        for width in (1, 4):
            sets, names, known = j.shingle_sets(raws, width), {}, {}
            assert len(sets) == len(raws)
            for own, name, text in zip(sets, j.set_names(sets).tolist(), texts):
                want = shingles(text, width)
                assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all() and (name == 0) == (not want)
                assert names.setdefault(want, name) == name and known.setdefault(name, want) == want
                assert [x.tolist() for x in j.shingle_sets([text.encode()], width)] == [own.tolist()]


def test_only_sizes_that_can_link_are_merged(monkeypatch):
    """Sets of one passage in growing sizes: the lists that are merged hold none too small to link."""
    sets, merged, merge = [np.arange(n, dtype=np.uint64) for n in range(100, 400, 30)], [], j.merge_skip
    monkeypatch.setattr(j, "merge_skip", lambda lists, enough: merged.extend(lists) or merge(lists, enough))
    block = j.Block(sets, 85)
    index = block.index()
    for k in range(len(sets)):
        block.add(index, k)
    for k, own in enumerate(sets):
        merged.clear()
        near = [x for x, other in enumerate(sets) if 100 * min(len(own), len(other)) >= 85 * max(len(own), len(other))]
        assert block.linked(index, k) == near
        assert {x for members in merged for x in members} <= set(near)


def test_odd_input(odd, empty):
    got = j.jaccard_groups(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["component_id"] == 0
    assert by_id[4]["n_shingles"] == 1 and by_id[5]["component_id"] == 4  # equal but for case
    assert by_id[13]["component_id"] == 13
    assert j.jaccard_groups(empty).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60, 1) if k % 20 != 19] + [(5, 5), (100, 7), (None, 3), (3, None)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long").where("a is not null and b is not null")).collect()}
    assert all(got[k] == k // 20 * 20 for k in range(60)) and got[100] == 0
