"""Periodic runs, token counts, conversation repair: brute force, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import corpus, frame, words
from pyspark.sql import functions as F

from tracelode.llm import counting, periods, queries, repair

# Periodic runs


def slow_lyndon(s):
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(n for n in range(1, len(s) - i + 1) if is_lyndon(s[i : i + n])) for i in range(len(s))]


def slow_runs(s, least):
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and not any(all(s[x] == s[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found)


def test_lyndon_array():
    rng = random.Random(3)
    for _ in range(800):
        s = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 13))]
        kinds = {v: k for k, v in enumerate(sorted(set(s)))}
        s = [kinds[v] for v in s]
        assert periods.lyndon_array(s) == slow_lyndon(s)


@pytest.mark.parametrize("least", [4, 12])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
            if s and rng.random() < 0.5:
                a = rng.randrange(len(s))
                p = 1 + (len(s) - a) // rng.randint(2, 6)
                s = [s[i] if i < a else s[a + (i - a) % p] for i in range(len(s))]
            texts.append(s)
        found = periods.runs_of_texts([np.array(t, dtype=np.int64) for t in texts], least)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [slow_runs(t, least) for t in texts]


def test_runs_of_hard_sequences():
    """Thue-Morse has no cube, a Fibonacci word has nearly as many runs as letters; both are where rolling hashes fail."""
    morse = np.array([bin(i).count("1") & 1 for i in range(1 << 13)])
    assert all(2 <= n / q <= 2.01 + 1 / q for _, n, q in periods.runs_of_texts([morse], 4)[0].tolist())
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert [tuple(r) for r in periods.runs_of_texts([np.array(b)], 4)[0].tolist()] == slow_runs(b, 4)
    assert periods.runs_of_texts([np.zeros(100_000, dtype=np.int64)])[0].tolist() == [[0, 100_000, 1]]


def test_periodic_runs_of_documents(spark):
    loop = " ".join(f"w{i % 7}" for i in range(40))
    rows = corpus(1) + [(900, f"start {loop} end", None, None, 0), (900, f"start {loop} end", None, None, 0), (901, "x " * 50_000, None, None, 0),
                        (902, "eé " + "\n\tb" * 12, None, None, 0), (903, "no " * 11, None, None, 0)]
    found = periods.digests(periods.periodic_runs(frame(spark, rows))).collect()
    assert sorted((r[0] is None, r[0]) for r in found) == sorted((r[0] is None, r[0]) for r in rows)
    by_id = {r.doc_id: r for r in found}
    for doc_id, text, *_ in rows:
        split = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = slow_runs(split, 12) if len(split) < 5000 else [(0, 50_000, 1)] if doc_id == 901 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        row = by_id[doc_id]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(split) if i not in gone).encode()).hexdigest()
    assert by_id[900].n_runs == 1 and by_id[902].n_runs == 1 and by_id[903].n_runs == 0
    assert periods.digests(periods.periodic_runs(frame(spark, rows).limit(0))).count() == 0


def test_looped():
    some = [b"%d" % i for i in range(50)]
    for doc_id in range(60):
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(some)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        assert periods.looped(doc_id, some) == ([some[i] if i < a else some[a + (i - a) % p] for i in range(n)] if h % 10 == 0 else some)
    assert periods.looped(None, some) == some and all(periods.looped(i, []) == [] for i in range(40))


# Token counts


def hard_text(rng, n):
    kinds = ["abcdefgh", "aab", "'strevmld.,!?-", " \n\t", "0123456789", "éàüņ̃́", "漢字日本語", "👩‍👧🏽", "ΣΑςσ", "가각ᆨ", "İIı"]
    out = []
    while sum(map(len, out)) < n:
        kind = rng.random()
        if kind < 0.04:
            out.append(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endof"]))
        elif kind < 0.08:
            out.append(rng.choice("abk!漢") * rng.randint(1, 120))
        else:
            letters = rng.choice(kinds)
            out.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + " " * rng.randint(0, 1))
    return "".join(out)


@pytest.mark.parametrize("chunk, overlap", [(40, 40), (64, 32), (300, 60)])
def test_spliced_counts(spark, chunk, overlap):
    """The same count as the library gives for the whole text, words without end and special strings across cuts included."""
    path, rng = queries.tokenizer_path(), random.Random(chunk)
    texts = [hard_text(rng, rng.randint(1, 900)) for _ in range(60)] + ["a" * 3000, "漢字" * 900, "<|endoftext|>" * 70, "x" * 39 + "<|endoftext|>" + "'ll've" * 30, "́" * 700, " " * 500]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(900, None, None, None, 0), (None, "two words", None, None, 0), (7, texts[7], None, None, 0)]
    found = counting.token_counts(frame(spark, rows), path, 100, chunk, overlap).collect()
    whole = counting.library(path)
    expected = [(i, len((t or "").encode()), whole.counts([t or ""])[0]) for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    assert counting.token_counts(frame(spark, rows).limit(0), path).count() == 0


def test_op12_equals_the_library(spark):
    folder, whole = "/root/testdata/sf0.001", counting.library(queries.tokenizer_path())
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, folder).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        n = len(whole._tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert found[doc_id] == (len((text or "").encode()), n, n > 2048)


def test_no_cut_without_two_equal_tokens():
    token = counting.Token
    left = [token(1, 0, 4, False), token(2, 4, 8, False), token(3, 8, 12, False)]
    assert counting.stable_cut(left, [token(9, 2, 4, False), *left[1:]], "x" * 14, 0, 2) == (1, 2)
    assert counting.stable_cut(left, [token(9, 2, 8, False), left[2]], "x" * 14, 0, 2) is None
    assert counting.stable_cut(left, [token(9, 2, 4, False), left[1], token(3, 8, 12, True)], "x" * 14, 0, 2) is None
    assert counting.stable_cut(left, [token(9, 2, 4, False), *left[1:]], "x" * 8 + "́" + "x" * 6, 0, 2) is None
    assert counting.stable_cut(left, [token(9, 2, 4, False), *left[1:]], "x" * 14, 0, 7) is None


# Conversation repair

GRAMMAR = re.compile("(s?(ua)+)?")


def slow_repair(rows):
    """All edit sequences, (cost, audit)."""
    best = (3 * len(rows), "D" * len(rows))

    def go(i, out, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch(out):
            best = min(best, (cost, audit))
        for role in "ua":
            go(i, out + role, cost + 2, audit + "I")
        if i < len(rows):
            row = rows[i]
            go(i + 1, out, cost + 3, audit + "D")
            if not row.must_go:
                go(i + 1, out + (row.initial or "#"), cost + row.extra, audit + "K")
                for role in "ua":
                    go(i + 1, out + role, cost + row.extra + 2, audit + "R")

    go(0, "", 0, "")
    return best


@pytest.mark.parametrize("window", [1, 2, 24])
def test_cheapest_repair(window):
    rng = random.Random(window)
    for _ in range(400):
        rows = [repair.Row(rng.choice(["u", "u", "a", "a", "s", "x", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        assert repair.repaired_audit(rows, window) == slow_repair(rows)


def test_long_conversations_do_not_depend_on_the_window():
    rng = random.Random(9)
    for letters in ("uuuaaasx", "ux", "aaau", "s"):
        rows = [repair.Row(rng.choice(letters), rng.choice(["", "", "truncated", "blank"])) for _ in range(300)]
        assert len({repair.repaired_audit(rows, window) for window in (1, 7, 24, 40)}) == 1
    assert repair.repaired_audit([repair.Row("u", ""), repair.Row("a", "")] * 20_000) == (0, "K" * 40_000)


def test_bounds_are_below_the_cost():
    rng = random.Random(4)
    for _ in range(200):
        rows = [repair.Row(rng.choice("uasx"), rng.choice(["", "truncated", "blank"])) for _ in range(rng.randint(0, 30))]
        assert repair.suffix_bounds(rows)[0] <= repair.repaired_audit(rows)[0]


def slow_summary(rows):
    """rows: (turn, role, text) in order."""
    seen, found, faults = set(), [], []
    for turn, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        found.append(repair.Row(role[:1], fault))
    cost, audit = repair.repaired_audit(found)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out, i, state = [], 0, ""
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = (rows[i][1], rows[i][2]) if edit == "K" else ("assistant" if state == "u" else "user", rows[i][2] if edit == "R" else "")
        i += edit != "I"
        state = role[:1]
        out.append(f"{role}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_of_awkward_conversations(spark):
    long = words(3, 40_000) + "."
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 5, "user", "And"), (1, 5, "user", "And"), (2, None, None, None), (2, 0, "system", "Be brief.\n"),
            (2, 1, "tool", "x!"), (None, 0, "user", "lost."), (None, 1, "user", long), (3, 0, "assistant", ""), (4, 0, "", "Empty role."), (4, 1, "user", " \t\x0b")]
    rows += [(5, t, "user" if t % 3 else "assistant", f"Turn {t // 2}.") for t in range(80)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("place", "edit", "kind", "fault", "cost", "seen")})
    found = {r.conv_id: tuple(r)[1:] for r in repair.repaired(df, df).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    for conv in found:
        own = sorted(((t, r or " ", " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        own = [(t, " " if o is None else r, x) for (t, r, x), o in zip(own, [1] * len(own))]
        if conv == 4:
            own[0] = (0, "", "Empty role.")
        assert found[conv] == slow_summary(own), conv
    empty = repair.repaired(df, df.limit(0)).collect()
    assert {tuple(r)[1:] for r in empty} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} and len(empty) == 6
    assert repair.repaired(df.limit(0), df.limit(0)).count() == 0


def test_edit_log_reads_as_a_conversation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    log = repair.edit_log(repair.damaged(rows)).where("edit != 'D'").orderBy("conv_id", "place", F.expr("edit != 'I'")).collect()
    roles = {}
    for r in log:
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert roles and all(GRAMMAR.fullmatch(r) for r in roles.values())


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            expected += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=key) == sorted(expected, key=key)
