"""Language, fingerprints, mixing, packing."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from fixtures import corpus, frame, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelode.llm import columns, fingerprints, language, mixing, packing, queries


@pytest.fixture(scope="module")
def rows():
    return corpus(n=120)


def two_languages(n=300):
    letters = {"aa": "aeiouklmnpst", "bb": "bcdfghjrvwxyzüö"}
    return [(i, words(i, 1 + i % 60, letters[lang]).capitalize() + ".", lang, "s", 0) for i in range(n) for lang in (("aa", "bb")[i % 2],)]


def test_language(spark):
    data = two_languages()
    docs = frame(spark, data + [(9001, None, "aa", None, 0), (9002, "", None, None, 0), (9003, "12 .. 7", "aa", "s", 0), (None, "zzz bfg", "bb", "s", 0),
                                (9004, "Ελλάδα είναι μια χώρα που " * 9, None, "s", 0)])
    model = language.learn(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    truth = {r[0]: r[2] for r in data}
    assert np.mean([found[i].lang_pred == lang for i, lang in truth.items()]) > 0.99
    assert not any(found[i].rejected for i in truth)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (9001, 9002, 9003))
    assert found[9004].rejected and found[9004].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(data) + 1
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_held_out_by_checksum(spark):
    ids = list(range(200))
    found = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", language.held_out(F.col("i")).alias("h")).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_model_is_a_distribution():
    """The probabilities of the seen symbols after a context add up to one, but for a small share of symbols no model has seen."""
    texts = ["abab abba", "baab bbab aab"]
    grams = {}
    for t in texts:
        codes = language.symbols_of([t]).codes
        for i in range(len(codes) - language.ORDER + 1):
            gram = "".join(map(chr, codes[i : i + language.ORDER]))
            grams[gram] = grams.get(gram, 0) + 1
    model = language.Model(["x"], [grams])
    for context in ("aba", "ab ", "bbb"):
        codes = np.array([[*map(ord, context), ord(c)] for c in "ab "], dtype=np.uint32)
        assert 0.9 < np.exp2(model._interpolated(codes)).sum() < 1 + 1e-9


def test_hash_lookup():
    keys = np.unique(columns.mix(np.arange(5000, dtype=np.uint64)))
    hashes = language.Hashes(keys)
    assert (hashes.find(keys) == np.arange(len(keys))).all()
    assert (hashes.find(columns.mix(np.arange(6000, 9000, dtype=np.uint64))) == -1).all()


def test_fingerprints(spark, rows):
    found = fingerprints.edited(frame(spark, rows), buckets=7).collect()
    known = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in known]
    expected = sorted((r[0], len(t), hashlib.sha256(fingerprints.edited_text(t, texts[(i + 1) % len(texts)]).encode()).hexdigest())
                      for i, (r, t) in enumerate(zip(known, texts)) if r[0] is not None)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found if r.doc_id is not None) == expected
    assert len(found) == len(rows) and all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    one = fingerprints.edited(frame(spark, [(4, "a b c", None, None, 0)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edited(frame(spark, []), buckets=4).count() == 0


def test_fingerprint_is_a_sum(spark):
    of = lambda *t: fingerprints.vectors(columns.texts_of(pa.array(t, pa.string())))
    a, b, ab, ba, twice = ("one two three four", "five six", "one two three four\nfive six", "five six\n\none two three four", "five six\nfive six")
    v = of(a, b, ab, ba, twice, "", None).hex()
    assert v[2] == v[3] and v[5] == v[6] and len(set(v[:5])) == 4
    assert fingerprints.changed(pd.Series([v[0]]), pd.Series([b]), pd.Series([""]))[0] == v[2]
    assert fingerprints.changed(pd.Series([v[2]]), pd.Series([""]), pd.Series([a]))[0] == v[1]
    half = words(3, 300)
    near = fingerprints.likeness(of(half, half), of(" ".join(half.split()[:150]) + " " + words(4, 150), words(5, 300)))
    assert abs(near[0] - 0.5) < 0.2 and near[1] < 0.2
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    changes = spark.createDataFrame([(1, b, None)], "doc_id bigint, added string, removed string")
    assert {r.doc_id: r.fingerprint for r in fingerprints.update(fingerprints.fingerprint(docs), changes).collect()} == {1: v[2], 2: v[1]}


def test_mixing(spark, rows):
    docs = frame(spark, rows)
    found = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    by = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    targets = mixing.capped_targets(sizes, [1 + i % 3 for i in range(len(names))])
    for s, size, target in zip(names, sizes, targets):
        assert by[s][0].source_size == size and abs(by[s][0].target - target) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - target) <= 0.03 * target + 16
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    total = sum(len((r.text or "").split()) for r in made.select("text").collect())
    assert total == sum(r.taken for r in found)
    assert mixing.mix_sources(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


def test_a_tiny_source_does_not_shred_the_others(spark):
    data = [(i, words(i, 1000), "aa", "ab"[i % 2], 0) for i in range(80)]
    tiny = [(900, words(900, 90), "aa", "c", 0)]
    for more in ([], tiny):
        found = [r for r in mixing.mix_spans(frame(spark, data + more)).collect() if r.source in ("a", "b")]
        assert len(found) == 80 and all(s[0] % 8 == 0 for r in found for s in r.spans)
        inner = [e - b for r in found for b, e, _ in r.spans if b > 0 and e < r["size"]]
        assert inner and all(n % 256 == 0 for n in inner)
    taken = [r for r in mixing.mix_sources(frame(spark, data + tiny)).collect() if r.source == "c"]
    assert abs(sum(r.taken for r in taken) - taken[0].target) <= 0.03 * taken[0].target + 16


def test_targets_and_seats():
    assert mixing.capped_targets([100, 100, 1], [1, 2, 3]) == pytest.approx([66, 132, 3])
    assert mixing.capped_targets([0, 10], [1, 1]) == pytest.approx([0, 10])
    for shares, seats in (([53, 24, 23], 7), ([10, 10, 10], 4), ([1000, 1, 1], 3)):
        got, slow = mixing.sainte_lague(np.array(shares), seats, np.full(3, 99)), [0, 0, 0]
        for _ in range(seats):
            best = max(range(3), key=lambda i: (shares[i] / (2 * slow[i] + 1), -i))
            slow[best] += 1
        assert got.tolist() == slow
    assert mixing.sainte_lague(np.array([5.0, 5.0]), 9, np.array([3, 4])).tolist() == [3, 4]


def test_packing(spark, rows):
    path = queries.tokenizer_path()
    hard = [(500, "it's <|endoftext|> A\x1cB İstanbul naïve é é ABC,, x%%% don't 12ab ½ 你好。 a b -- can't've", None, None, 0),
            (501, "Hello, WORLD! " * 2000, None, None, 0), (502, "hello" * 3000, None, None, 0)]
    data = rows + hard
    found = packing.pack_documents(frame(spark, data), path, group=16).toPandas()
    tokenizer = Tokenizer.from_file(path)
    expected = {}
    for r in data:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            expected.setdefault((r[0], start), []).append((len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    got = {}
    for r in found.itertuples():
        got.setdefault((None if pd.isna(r.doc_id) else r.doc_id, r.start), []).append((r.length, r.ids_crc32, r.doc_tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    for _, window in found.sort_values("offset").groupby("sequence_id"):
        ends = (window.offset + window.length).tolist()
        assert window.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_best_fit():
    numbers, offsets = packing.best_fit([8, 6, 5, 4, 3, 2, 2], 8)
    assert list(zip(numbers, offsets)) == [(0, 0), (1, 0), (2, 0), (3, 0), (2, 5), (1, 6), (3, 4)]


def test_packing_leaves_little_room():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 2049, 4000).tolist(), reverse=True)
    numbers, _ = packing.best_fit(lengths, 2048)
    assert sum(lengths) / (2048 * (max(numbers) + 1)) > 0.98


def test_likeness_of_often_repeated_lines():
    """Lanes hold counts far beyond 65,536; a line more or less among many changes little, and takes away what it added."""
    import pyarrow as pa

    from tracelode.llm.columns import texts_of
    line = "the same line of words again\n"
    texts = [line * 65_536, line * 65_537, line * 100_000, "quite another line it is\n" * 65_536]
    many = fingerprints.vectors(texts_of(pa.array(texts)))
    one = fingerprints.Vectors(many.wide[:1], many.sketch[:1])
    near = [float(fingerprints.likeness(one, fingerprints.Vectors(many.wide[i : i + 1], many.sketch[i : i + 1]))[0]) for i in range(4)]
    assert near[0] == 1 and near[1] > 0.99 and near[2] > 0.85 and near[3] < 0.2
    single = fingerprints.vectors(texts_of(pa.array([line])))
    back = fingerprints.Vectors(many.wide[1:2], many.sketch[1:2]) - single
    assert back.hex() == one.hex()


def test_equal_texts_of_two_sources_are_mixed_by_their_own(spark):
    """A row equal in id and text to one of another source keeps its source and its own share."""
    data = [(i, words(i, 200), "aa", "x", 0) for i in range(20)] + [(i, words(i, 200), "aa", "y", 0) for i in range(20)]
    plan = {r.source: 0 for r in mixing.mix_sources(frame(spark, data)).collect()}
    for r in mixing.mix_sources(frame(spark, data)).collect():
        plan[r.source] += r.taken
    made = {"x": 0, "y": 0}
    for r in mixing.mixed_documents(frame(spark, data)).collect():
        made[r.source] += len(r.text.split())
    assert made == plan and plan["y"] > 1.8 * plan["x"] > 0


def test_language_of_a_very_long_text(spark):
    data = [(i, words(i, 60, "abcdefg" if i % 2 else "tuvwxyz"), ("aa", "bb")[i % 2 == 0], "s", 0) for i in range(200)]
    docs = frame(spark, data)
    model = language.learn(docs)
    long = frame(spark, [(1000, words(1, 150_000, "abcdefg"), None, None, 0), (1001, words(2, 150_000, "tuvwxyz"), None, None, 0), (1002, "x" * 500_000, None, None, 0)])
    found = {r.doc_id: r.lang_pred for r in language.identify(long, model).collect()}
    assert found[1000] == "aa" and found[1001] == "bb" and len(found) == 3
