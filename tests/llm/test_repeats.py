"""Near-duplicates, suffix and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import corpus, frame, words
from pyspark.sql import functions as F

from tracelode.llm import columns, components, minhash, subtrees, suffixes, windows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("most, part", [(0, 1 << 20), (128, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 300), (1 << 20, 1)])
def test_suffixes(spark, rows, monkeypatch, most, part):
    """With windows compared by hash, in whole keys, and in keys cut into parts down to one distance each."""
    monkeypatch.setattr(windows, "SPREAD", most)
    monkeypatch.setattr(windows, "PART", part)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    expected = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        expected.append((doc_id, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    found = [tuple(r) for r in suffixes.removed(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(r[2] for r in expected) > 0


@pytest.mark.parametrize("most, part", [(0, 1 << 20), (128, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 300), (1 << 20, 1)])
def test_subtrees(spark, rows, monkeypatch, most, part):
    """With windows compared by hash, in whole keys, and in keys cut into parts down to one distance each."""
    monkeypatch.setattr(windows, "SPREAD", most)
    monkeypatch.setattr(windows, "PART", part)
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first: dict[tuple, int] = {}
    for doc_id, w in texts:
        for i in range(len(w) - 49 if doc_id is not None else 0):
            first[tuple(w[i : i + 50])] = min(doc_id, first.get(tuple(w[i : i + 50]), doc_id))
    expected = []
    for doc_id, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if doc_id is not None else 0):
            if first[tuple(w[i : i + 50])] < doc_id:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = [tuple(r) for r in subtrees.removed(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(r[2] for r in expected) > 0


def brute_classes(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups: dict[int, list] = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row[0])
    return sorted((doc_id, min((d for d in ids if d is not None), default=None)) for ids in groups.values() for doc_id in ids if doc_id is not None)


def chain(n):
    """Texts of which each is near the next, the ends far apart, and a group of copies with edits of their own."""
    base = words(42, 200).split()
    out = []
    for i in range(n):
        text = [f"new{j}" if j // 4 < i else w for j, w in enumerate(base)]
        out.append((1000 + i, " ".join(text), "aa", "s", 0))
    other = words(43, 120).split()
    for i in range(2 * n):
        text = list(other)
        text[(7 * i) % 120] = f"edit{i}"
        text[(31 * i + 5) % 120] = f"edit{i}"
        out.append((2000 + i, " ".join(text), "aa", "s", 0))
    return out


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_duplicates(spark, rows, rounds):
    data = rows + chain(12)
    found = minhash.near_duplicates(frame(spark, data), rounds=rounds).collect()
    assert len(found) == len(data)
    assert sorted((r.doc_id, r.cluster_id) for r in found if r.doc_id is not None) == brute_classes(data)
    kept = minhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    wordless = sum(not (r[1] or "").split() for r in rows)
    with_words = [r for r in rows if (r[1] or "").split()]
    assert kept.count() == wordless + len({c for _, c in brute_classes(with_words)}) + 1  # the row without an id is alone


def test_near_copies_with_a_repeated_passage(spark):
    """Set similarity 0.805, a passage of 150 words 100 times in one of both."""
    data = []
    for i in range(20):
        text = words(5000 + i, 500).split()
        data += [(2 * i, " ".join(text), "aa", "s", 0), (2 * i + 1, " ".join(text[:450] + words(7000 + i, 50).split() + text[:150] * 100), "aa", "s", 0)]
    expected = brute_classes(data)
    assert expected == [(i, i - i % 2) for i in range(40)]
    assert sorted((r.doc_id, r.cluster_id) for r in minhash.near_duplicates(frame(spark, data)).collect()) == expected


def test_bucket_with_the_same_hub_twice(spark):
    """A is hub of {A, B, C} in both rounds and not linked; B and C are left to the last comparison."""
    data = []
    for i in range(150):
        a, b = words(i, 60).split(), words(1000 + i, 20).split()
        b = a[:40] + b
        data += [(3 * i + k, " ".join(text), "aa", "s", 0) for k, text in enumerate((a, b, b[:-1] + ["other"]))]
    order = F.xxhash64("node", F.lit(1)).cast("string").cast("binary")
    found = {r.doc_id: r for r in minhash.sketches(frame(spark, data), bands=1, rows=1).withColumn("order", order).collect()}
    first = lambda three: all(three[0][c] < min(r[c] for r in three[1:]) for c in ("node", "order")) and len({r.bands[0] for r in three}) == 1
    at = next(i for i in range(150) if first([found[3 * i + k] for k in range(3)]))
    three = frame(spark, data[3 * at : 3 * at + 3])
    clusters = {r.doc_id - 3 * at: r.cluster_id - 3 * at for r in minhash.near_duplicates(three, bands=1, rows=1, rounds=2).collect()}
    assert clusters == {0: 0, 1: 1, 2: 1}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = columns.mix(np.arange(400, dtype=np.uint64))
    weight_a, weight_b = rng.uniform(1, 3, 400), rng.uniform(1, 3, 400)
    b = a.copy()
    b[:80] = columns.mix(np.arange(1000, 1080, dtype=np.uint64))
    signature = minhash.prob_minhash(np.repeat([0, 1], 400), np.concatenate([a, b]), np.concatenate([weight_a, weight_b]), 2, 4000)
    both = dict(zip(b.tolist(), weight_b))
    x, y = dict(zip(a.tolist(), weight_a)), both
    names = sorted(x.keys() | y.keys())
    p, q = (np.array([w.get(n, 0) for n in names]) for w in (x, y))
    exact = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(len(names)) if p[i] and q[i])
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.04
    tiny = minhash.prob_minhash(np.array([0]), a[:1], np.ones(1), 1, 120)
    assert (tiny == a[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 140)}


def test_kept_columns_and_empty_tables(spark, rows):
    docs = frame(spark, rows)
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() < docs.count()
    empty = docs.limit(0)
    assert suffixes.removed(empty).count() == subtrees.removed(empty).count() == minhash.near_duplicates(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == minhash.one_of_each(empty).count() == 0


def test_lowest_in_pieces():
    values = columns.mix(np.arange(3000, dtype=np.uint64) % np.uint64(37))
    cut = values & ~np.uint64((1 << 24) - 1)
    assert columns.lowest(values, 40).tolist() == [i + int(np.argmin(cut[i : i + 40])) for i in range(2961)]


def test_words():
    texts = ["", "a  b\tc", "  ", "dé e f", "x"]
    import pyarrow as pa

    found = columns.words_of(columns.texts_of(pa.array([*texts, None])))
    data = "".join(texts).encode()
    cut = [[data[s:e].decode() for s, e in zip(found.start[a:b], found.end[a:b])] for a, b in zip(found.first, found.first[1:])]
    assert cut == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts] + [[]]


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    """Rows equal in id and text but not elsewhere: one of them, the same on every run; wordless rows stay all."""
    data = [(1, "five words make one shingle", "aa", f"s{i}", i) for i in range(6)] + [(None, None, None, None, i) for i in range(40)] + [(2, " ", "aa", "s", 0)] * 2
    kept = [sorted(map(str, minhash.one_of_each(frame(spark, order, extra=False)).collect())) for order in (data, data[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1 + 40 + 2
