"""The pipeline's stages on the smallest tables: each against a brute-force version of its rule."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")


def test_stages(spark):
    import corpus_pipeline as cp
    from opalgrid.llm.common import stash
    from opalgrid.llm.ngram_join import similar, shingle_set
    from opalgrid.llm.common import WordHashes

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        seen.append({r.doc_id: r for r in docs.collect()} if len(seen) < 4 else collections.Counter(r.doc_id for r in docs.collect()))
        assert sorted(docs.columns) == sorted(cp.COLUMNS)
        docs = stash(stage(spark, docs, SF))
    start, good, single, near, mixed = seen
    assert set(good) < set(start) and {r.text for r in single.values()} == {r.text for r in good.values()} and len(single) == len({r.text for r in good.values()})
    assert all(i == max(j for j, r in good.items() if r.text == x.text) for i, x in single.items())
    h = WordHashes()
    sets = {i: shingle_set(r.text.encode(), h, 4) for i, r in single.items()}
    ids = sorted(sets)
    comp = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]) and similar(sets[a], sets[b], 85):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    assert set(near) == set(comp.values())
    assert all(n in (1, 2) for n in mixed.values()) and set(mixed) <= set(near)
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n // r.d for r in packed} == dict(mixed)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, one identifier with several texts,
    extra columns; then no rows at all."""
    r = random.Random(3)
    import corpus_pipeline as P
    from opalgrid.llm.common import stash

    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, long = text(80), text(90), text(30_000)
    rows = [(1, a, "en", "x", 5), (1, a, "en", "x", 5), (1, b, "de", "y", 5), (2, a, None, None, None), (None, b, "en", "x", 1), (None, None, None, None, None), (3, "", "en", "x", 0), (4, long, "en", None, 9), (5, a + " tail", "en", "y", 7), (6, text(60), "fr", "x", 2), (7, "same " * 60, "fr", "x", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit("clash"), "size": F.lit(1), "node": F.lit(0)})
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        top = tmp_path / name
        table.write.parquet(f"{top}/documents.parquet")
        labels.write.parquet(f"{top}/labels.parquet")
        left = spark.read.parquet(f"{top}/documents.parquet")
        seen = []
        for stage, run in P.STAGES:
            left = stash(run(spark, left, str(top)))
            seen.append(left.collect())
            assert stage == "packing" or left.columns == P.COLUMNS
        if name == "empty":
            assert not any(seen)
            continue
        good = [x for x in rows if x[1] and len(x[1].split()) >= 50 and x[1] != "same " * 60]
        assert sorted(map(tuple, seen[0]), key=str) == sorted(good, key=str)
        assert sorted((x.doc_id, x.text) for x in seen[1]) == sorted({(2, a), (1, b), (4, long), (5, a + " tail"), (6, good[-1][1])})
        assert sorted((x.doc_id, x.text) for x in seen[2]) == sorted({(2, a), (1, b), (4, long), (6, good[-1][1])})
        assert {x.text for x in seen[3]} <= {x.text for x in seen[2]}
        taken = collections.Counter(x.doc_id for x in seen[3])
        for i, copies in taken.items():
            assert sum(x.length for x in seen[4] if x.doc_id == i) == copies * next(x.doc_tokens for x in seen[4] if x.doc_id == i)
