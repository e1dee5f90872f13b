"""Hand-checkable cases and invariants of the engine's own operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opalgrid.functions import geometry as G, text as T
from opalgrid.operators import assign as A, match as M, metrics as X, questions as Q, rank as R, suppress as S
from opalgrid.sources import documents as D
from opalgrid.streaming import tracks as K

COLUMNS = "image_id long, cls string, det_id long, score double, x1 double, y1 double, x2 double, y2 double"


def one(df):
    return df.first()


def test_iou_matrix_by_hand(spark):
    a = [(0, 0, 10, 10), (10, 10, 20, 20), (32, 32, 38, 42)]
    b = [(0, 0, 10, 20), (0, 10, 10, 19), (10, 10, 20, 20)]
    rows = [(i, j, *map(float, p), *map(float, q)) for i, p in enumerate(a) for j, q in enumerate(b)]
    df = spark.createDataFrame(rows, "i int, j int, x1 double, y1 double, x2 double, y2 double, g_x1 double, g_y1 double, g_x2 double, g_y2 double")
    got = {(r.i, r.j): (r.o, r.g) for r in df.select("i", "j", G.iou(G.box(), G.box("g_")).alias("o"), G.giou(G.box(), G.box("g_")).alias("g")).collect()}
    assert [got[0, j][0] for j in range(3)] == [0.5, 0, 0] and [got[1, j][0] for j in range(3)] == [0, 0, 1] and [got[2, j][0] for j in range(3)] == [0, 0, 0]
    assert all(-1 <= g <= 1 for _, g in got.values())


def test_empty_union_and_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in df.select(G.valid(G.box())).collect()] == [False, False, False]
    assert one(df.limit(1).select(G.iou(G.box(), G.box())))[0] == 0


def test_two_band_keeps_contained_low_box(spark):
    rows = [(1, "a", 1, 0.9, 0, 0, 20, 20), (1, "a", 2, 0.35, 2, 2, 12, 12), (1, "a", 3, 0.3, 2, 2, 12, 12), (1, "a", 4, 0.2, 90, 90, 99, 99)]
    df = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], COLUMNS)
    assert sorted(r.det_id for r in S.two_band(df, ["image_id", "cls"], 0.4, 0.5).collect()) == [1, 2, 4]
    low = df.withColumn("score", F.col("score") / 10)
    assert sorted(r.det_id for r in S.two_band_with_fallback(low, ["image_id", "cls"], 0.25, 0.4, 0.5).collect()) == [1, 2]


def _random_boxes(spark, seed=1, images=12, n=18):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), k, round(r.random(), 2), x, y, x + r.randint(5, 40), y + r.randint(5, 40)) for i in range(images) for k in range(n) for x, y in [(r.randint(0, 60), r.randint(0, 60))]]
    return spark.createDataFrame([(*t[:4], *map(float, t[4:])) for t in rows], COLUMNS), rows


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0, w) * max(0, h)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0


@pytest.mark.parametrize("seed", [1, 2])
def test_nms_against_loop(spark, seed):
    df, rows = _random_boxes(spark, seed)
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (-r[3], r[2])):
            if all(_iou(k[4:], r[4:]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(r[0], r[2]) for r in kept}
    out = S.nms(df, ["image_id", "cls"], 0.3)
    assert {(r.image_id, r.det_id) for r in out.collect()} == want
    assert S.nms(out, ["image_id", "cls"], 0.3).count() == len(want)  # idempotent


def test_one_to_one_is_injective(spark):
    df, _ = _random_boxes(spark, 3)
    g = df.where("det_id % 3 = 0").withColumnRenamed("det_id", "gt_id").drop("score")
    got = M.one_to_one(M.pairs_of(g, df, ["image_id", "cls"]), ["image_id", "cls"], 0.2).collect()
    assert got and len({(r.image_id, r.gt_id) for r in got}) == len(got) == len({(r.image_id, r.det_id) for r in got})
    assert all(r.iou >= 0.2 for r in got)


def test_grounding_denominators(spark):
    box, bad = (0.0, 0.0, 10.0, 10.0), (None,) * 4
    rows = [(1, 1, *bad, *box), (None, 1, *box, *bad), (0, 1, *box, *bad), (5, 1, *box, *bad), (1, 1, *box, *box)]
    df = spark.createDataFrame(rows, "pred_id long, target_id long, " + ", ".join(f"{p}{c} double" for p in ("g_", "p_") for c in ("x1", "y1", "x2", "y2")))
    m = one(X.grounding_metrics(df))
    assert (m.n_counted, m.n_answered, m.n_excluded, m.n_invalid) == (4, 2, 1, 3)
    assert m.id_accuracy == 0.5 and m.mean_iou == 0.25 and m.cum_iou == pytest.approx(100 / 300)
    assert m.pr_50 >= m.pr_60 >= m.pr_90


ANSWERS = {
    "<answer>3</answer>": (3, 3, 3), "<ANSWER> 3 </ANSWER>": (None, 3, 3), "Answer: 7": (7, 7, 7), "ID 2 and then ID **5**": (None, None, 5), "4 and 4": (None, None, 4), "4 and 5": (None, None, None), "": (None, None, None),
}


def test_answers(spark):
    df = spark.createDataFrame([(k,) for k in ANSWERS], "t string")
    for r in df.select("t", T.answer_strict(F.col("t")), T.answer_tolerant(F.col("t")), T.answer_cascade(F.col("t"))).collect():
        assert tuple(r[1:]) == ANSWERS[r.t], r.t


def test_ordinals(spark):
    df = spark.createDataFrame([(n,) for n in (1, 10, 11, 20, 21, 99)], "n int").select(T.ordinal_zh(F.col("n")))
    assert [r[0] for r in df.collect()] == ["第一个", "第十个", "第十一个", "第二十个", "第二十一个", "第九十九个"]


def test_blocks_and_complete_prefix(spark):
    text = f"{'-' * 70}\n1.jpg\n<answer>3</answer>\n[WARN] HTTP\n{'-' * 70}\n2.jpg\n\n{'-' * 70}\n3.jpg\n<answer>1</answer>"
    b = D.parse_blocks(spark.createDataFrame([("f", text)], "path string, value string"), ["path"])
    assert [(r.block_idx, r.image_file, r.body) for r in b.orderBy("block_idx").collect()] == [(0, "1.jpg", "<answer>3</answer>\n[WARN] HTTP"), (1, "2.jpg", ""), (2, "3.jpg", "<answer>1</answer>")]
    assert [r.block_idx for r in D.complete_prefix(b, ["path"]).collect()] == [0]


def test_file_scans_keep_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"k": {i}}}\n\n' for i in range(50)))
    rows = D.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k long").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.row_idx)] == list(range(50))
    (tmp_path / "m").mkdir()
    (tmp_path / "m/7.json").write_text('{"markers": [{"marker_id": 1, "bbox": [1, 2, 3, 4], "class": "ship"}]}')
    r = one(D.read_markers(spark, str(tmp_path / "m")))
    assert (r.image_name, r.marker_id, r.x2) == ("7", 1, 3.0)


def test_xml_strict_raises(spark):
    bad = "<annotation><filename>1.jpg</filename><object><name>a</name><bndbox><xmin>1</xmin></bndbox></object></annotation>"
    df = spark.createDataFrame([(bad,)], "value string")
    assert D.parse_annotations_xml(df).count() == 0
    with pytest.raises(Exception, match="incomplete bndbox"):
        D.parse_annotations_xml(df, strict=True).collect()


def test_linear_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(5)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4)):
        c = r.random((n, m))
        i, j = A.linear_assignment(c)
        small, wide = min(n, m), max(n, m)
        t = c if n <= m else c.T
        best = min(sum(t[a, p[a]] for a in range(small)) for p in permutations(range(wide), small))
        assert len(i) == small and c[i, j].sum() == pytest.approx(best)
    i, j = A.assignment_with_limit(np.array([[0.1, 0.9], [0.95, 0.99]]), 0.8)
    assert list(zip(i, j)) == [(0, 0)]


def test_bipartite_matching_beats_greedy():
    assert len(A.bipartite_matching([(1, 1), (1, 2), (2, 1), (3, 2), (3, 3)])) == 3


def test_interpolation(spark):
    rows = [("v", 1, f, float(f), 0.0, f + 1.0, 1.0, 0.5) for f in (1, 4, 5, 6)]
    df = spark.createDataFrame(rows, "video string, track_id long, frame_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r.frame_id: (r.x1, r.score) for r in K.interpolate(df, min_frames=3).collect()}
    assert got[2] == (2.0, 1.0) and got[3] == (3.0, 1.0) and got[4] == (4.0, 0.5) and len(got) == 6


@pytest.mark.parametrize("kind", ["sort", "byte", "oc"])
def test_trackers_follow_two_objects(spark, kind):
    rows = [(0, f, k, 100.0 * k + 3 * f, 10.0, 100.0 * k + 3 * f + 40, 60.0, 0.9 if f != 5 else 0.7) for f in range(12) for k in range(2)]
    df = spark.createDataFrame(rows, "video long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = K.track(df, kind).collect()
    assert len(got) == 24 and len({(r.det_id, r.track_id) for r in got}) == 2


def test_retry_and_merge(spark):
    q = spark.createDataFrame([(i, i * 10) for i in range(6)], "row_idx long, image_id long")
    r = q.withColumn("response", F.when(F.col("row_idx") % 2 == 0, "x\n[WARN] HTTP 500: gone").otherwise("<answer>1</answer>"))
    s = Q.indexed(Q.retry_subset(q, r), "original_index").orderBy("retry_index").collect()
    assert [(x.retry_index, x.original_index, x.reason) for x in s] == [(0, 0, "HTTP 500: gone"), (1, 2, "HTTP 500: gone"), (2, 4, "HTTP 500: gone")]
    new = spark.createDataFrame([(0, "<answer>5</answer>"), (2, "<answer>0</answer>"), (4, "[WARN]")], "original_index long, response string")
    g = one(Q.merge_guards(Q.merged(r, new), 3))
    assert (g.n_replaced, g.complete, g.n_still_warned, g.n_placeholder) == (3, True, 1, 1)
    with pytest.raises(Exception, match="not aligned"):
        Q.retry_subset(q, r.withColumn("image_id", F.lit(-1).cast("long"))).collect()


def test_empty_inputs(spark):
    e = spark.createDataFrame([], COLUMNS)
    g = spark.createDataFrame([], "image_id long, cls string, gt_id long, x1 double, y1 double, x2 double, y2 double")
    keys = ["image_id", "cls"]
    assert S.nms(e, keys, 0.5).count() == 0 and M.tpfp_voc(e, g, keys).count() == 0
    assert M.one_to_one(M.pairs_of(g, e, keys), keys, 0.5).count() == 0 and R.numbered(e, ["image_id"], "spatial").count() == 0


def test_streaming_top_k_and_state(spark, tmp_path):
    df, rows = _random_boxes(spark, 4, images=6, n=5)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = K.running_top_k(stream, str(tmp_path / "c"), str(tmp_path / "out"), 4).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    got = {(r.cls, r.score) for r in spark.read.parquet(str(last)).collect()}
    want = {(c, r[3]) for c in "ab" for r in sorted((r for r in rows if r[1] == c), key=lambda r: -r[3])[:4]}
    assert got == want
