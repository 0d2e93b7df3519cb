"""The five stages on planted documents: each decision takes effect and passes on what it must keep."""

import random
import zlib

import pytest
from fixtures import SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from tracelode.llm import counting, mixing, queries

SYLLABLES = {"aa": "ka lo mi ten dra vor sel pun".split(), "bb": "schu weg tzo bein kraf ung lich".split()}


def prose(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """120 documents of two languages; a foreign one, exact copies, a near copy, two texts that share a passage, an empty one."""
    rows = [(i, prose(lang, i, 120), lang, f"s{i % 3}", 0) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    passage = prose("aa", 777, 60)
    foreign = "".join(random.Random(5).choice("ЖЩЫЭЮЯФЦ9#@") + (" " if i % 7 == 6 else "") for i in range(900))
    near = rows[10][1].split()
    near[50] = "changed"
    rows += [(500, foreign, None, "s0", 0), (501, rows[7][1], "bb", "s1", 0), (502, rows[7][1], "bb", "s2", 0), (503, " ".join(near), "aa", "s1", 0),
             (504, f"{prose('aa', 900, 40)} {passage} {prose('aa', 901, 40)}", "aa", "s0", 0), (505, f"{prose('aa', 902, 40)} {passage} {prose('aa', 903, 40)}", "aa", "s1", 0),
             (506, "", "aa", "s0", 0), (507, None, "aa", None, 0)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    stages, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        stages[name] = docs
    return rows, passage, folder, stages


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(planted):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "suffix-array dedup", "source mixing", "packing"]
    rows, _, _, stages = planted
    for name, df in list(stages.items())[:-1]:
        assert sorted(df.columns) == sorted(c.split()[0] for c in SCHEMA.split(", ")), name


def test_foreign_text_goes_and_clean_texts_stay(planted):
    _, _, _, stages = planted
    kept = ids(stages["language ID"])
    assert 500 not in kept
    assert len([i for i in range(120) if i in kept]) >= 114


def test_one_of_each_group_stays(planted):
    _, _, _, stages = planted
    before, kept = set(ids(stages["language ID"])), ids(stages["MinHash near-dedup"])
    assert kept == sorted(set(kept)) and set(kept) <= before
    assert len({7, 501, 502} & set(kept)) == 1 and len({10, 503} & set(kept)) == 1
    assert before - set(kept) <= {7, 501, 502, 10, 503, 506, 507}


def test_the_shared_passage_goes_from_both(planted):
    rows, passage, _, stages = planted
    before = {r.doc_id: r.text for r in stages["MinHash near-dedup"].collect()}
    after = {r.doc_id: r.text for r in stages["suffix-array dedup"].collect()}
    assert {504, 505} <= set(after)
    for i in (504, 505):
        # The windows around the passage's ends may share a character or two more.
        assert passage not in after[i] and 0 <= len(before[i]) - len(passage) - len(after[i]) + 8 <= 16
    assert all(after[i] == before[i] for i in after if i not in (504, 505))


def test_the_mix_meets_its_targets(planted):
    _, _, _, stages = planted
    docs = stages["suffix-array dedup"].collect()
    size = {}
    for r in docs:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    # Targets by hand: shares of 1, 2, 3, none above three times its source.
    weights, total, target = {s: 1 + i % 3 for i, s in enumerate(names)}, sum(size.values()), {}
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
    taken = {}
    for r in stages["source mixing"].collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for s in names:
        assert abs(taken.get(s, 0) - target[s]) <= 0.03 * target[s] + 16, s
    assert mixing.capped_targets([size[s] for s in names], [weights[s] for s in names]) == pytest.approx([target[s] for s in names])


def test_every_mixed_token_is_packed_once(planted, spark):
    _, _, folder, stages = planted
    packed = stages["packing"].toPandas()
    whole = counting.library(queries.tokenizer_path())
    mixed = stages["source mixing"].collect()
    assert packed.length.sum() == sum(n + 1 for n in whole.counts([r.text or "" for r in mixed]))
    for _, window in packed.sort_values("offset").groupby("sequence_id"):
        ends = (window.offset + window.length).tolist()
        assert window.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    again = corpus_pipeline.run(spark, folder)
    digest = lambda df: zlib.crc32("".join(sorted(f"{r.doc_id},{r.start},{r.ids_crc32}" for r in df.select("doc_id", "start", "ids_crc32").collect())).encode())
    assert digest(again) == digest(stages["packing"])
    assert again.select(F.sum("length")).first()[0] == packed.length.sum()


def test_stages_pass_small_batches_to_python(spark):
    """Long texts come to Python in batches of a few MB, however many rows a partition has."""
    import pyarrow as pa
    from tracelode.session import BATCH_BYTES

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text")).coalesce(1)
    corpus_pipeline.pack(spark, docs.limit(1), "")

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    assert max(r.bytes for r in docs.mapInArrow(size, "bytes bigint").collect()) <= BATCH_BYTES + 2_000_000
