"""The training-data operators against brute-force versions, with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import itertools
import pathlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import SparkContext
from pyspark.sql import functions as F

from opalgrid.llm import chat_format as C, common, exact_dedup as E, html_blocks as HB, html_extract as H, mixing as MX, ngram_join as N, packing as P, quality_rules as Q, substring_dedup as SD, token_counts as TC, tokens, toxicity as T
from opalgrid.llm.common import WordHashes, hash_sample, stash
from opalgrid.llm.components import components
from opalgrid.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts)], DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def path():
    P_ = pytest.importorskip("public_tokenizers")
    return P_.path("word_bpe_49k.json")


# exact dedup -------------------------------------------------------------------------------


@given(st.lists(st.binary(max_size=8)))
@settings(max_examples=60, deadline=None)
def test_trie_is_a_map(keys):
    trie, want = E.PatriciaTrie(), collections.defaultdict(list)
    for i, k in enumerate(keys):
        node = trie.insert(k, 1, i, min)
        want[k].append(i)
        assert (node.rows, node.best) == (len(want[k]), min(want[k]))


def test_exact_dedup(spark):
    texts = ["a b", None, "", "a b", "long " * 40_000, "a b ", "long " * 40_000, "ä"]
    df = docs(spark, texts).withColumn("kept", F.lit("clash")).unionByName(docs(spark, ["a b"], [3]).withColumn("kept", F.lit("again")))
    got = {(r.doc_id, r.text): r for r in E.exact_dedup(df, keep="largest").collect()}
    for (i, t), r in got.items():
        same = [j for j, u in [*enumerate(texts), (3, "a b")] if (u or "") == (t or "")]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same)), i
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.doc_id for r in E.kept_rows(df, keep="largest").collect()) == [2, 3, 5, 6, 7]
    assert E.exact_dedup(docs(spark, [])).count() == 0
    nulls = E.exact_dedup(docs(spark, ["x", "x", "y"], [None, 4, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in nulls) == [("4", "4", True), ("None", "4", False), ("None", "None", True)]


def test_two_texts_of_one_digest_are_never_merged():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"n_bytes": [1, 1], "digest": [b"d", b"d"], "body": [b"a", b"b"], "best": [1, 2], "rows": [1, 1]})
    with pytest.raises(ValueError, match="two different texts"):
        list(E._own(min, 1 << 20)(iter([rows])))


# n-gram join -------------------------------------------------------------------------------


def brute_components(texts, k=4, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp))]


def near_copies(r, n):
    texts, passage = [], words(r, 40)
    for _ in range(n):
        base = words(r, r.randrange(3, 120)).split()
        texts.append(" ".join(base) + (" " + passage if r.random() < 0.5 else ""))
        for _ in range(r.randrange(6)):
            copy = texts[-1].split() if r.random() < 0.5 else list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(1000)}"
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    return [*texts, None, "", " \t", "one", "One", "one two three", texts[0], passage]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    texts = near_copies(random.Random(seed), 25)
    got = sorted(tuple(r) for r in N.similarity_components(docs(spark, texts).withColumn("n_shingles", F.lit("x"))).collect())
    assert got == brute_components(texts)


def test_ngram_join_edges(spark):
    assert N.similarity_components(docs(spark, [])).count() == 0
    t = "a b c d e f g h"
    got = sorted(((str(r[0]), r[1], str(r[2])) for r in N.similarity_components(docs(spark, [t, t, "", None], [None, 5, 7, None])).collect()))
    assert ("5", 5, "None") in got and ("7", 0, "7") in got
    assert N.one_of_each(docs(spark, [t, t, "z"])).count() == 2


@given(st.integers(1, 4000), st.integers(50, 100))
@settings(max_examples=200, deadline=None)
def test_prefix_length(n, percent):
    assert N.prefix_length(n, percent) == n - int(np.ceil(round(percent * n / 100, 9))) + 1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    comp = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            m = min(comp[a], comp[b])
            comp[a] = comp[b] = m
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in comp.items() if x in got} and all(a == b for a, b in edges if a not in got)


# substring dedup ---------------------------------------------------------------------------


def brute_spans(rows, window):
    """rows: (id or None, text, order among the texts of an identifier); repeated rows are one occurrence."""
    seen, gone = set(), {}
    for i, _, t in sorted({(-1 if i is None else i, k, t or "") for i, t, k in rows}):
        w, mine = split(t), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                mine |= set(range(s, s + window))
            seen.add(k)
        gone[i, t] = mine
    own = lambda i, t: gone[-1 if i is None else i, t or ""]
    return sorted(((i, len(split(t)), len(own(i, t)), b" ".join(w for p, w in enumerate(split(t)) if p not in own(i, t)).decode()) for i, t, _ in rows), key=str)


@pytest.mark.parametrize(("seed", "shard"), [(1, 1000), (2, 1), (3, 3)])
def test_substring_dedup(spark, seed, shard):
    r = random.Random(seed)
    passages = [words(r, n) for n in (19, 20, 21, 60, 400)]
    texts = [" ".join(r.choice([words(r, r.randrange(30)), r.choice(passages)]) for _ in range(r.randrange(6))) for _ in range(60)]
    texts += [None, "", "the " * 300, "the " * 300, "a b " * 200, texts[0], words(r, 5)]
    got = sorted(tuple(x) for x in SD.substring_dedup(docs(spark, texts).withColumn("n_words", F.lit(1)), shard=shard).collect())
    assert sorted(got, key=str) == brute_spans([(i, t, 0) for i, t in enumerate(texts)], 20)
    assert any(g[2] for g in got)


@pytest.mark.parametrize("shard", [1000, 2])
def test_substring_dedup_tells_texts_of_one_identifier_apart(spark, shard):
    t, u, v, p = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuvp")
    rows = [(1, t), (2, t), (2, u), (None, p + " x " + p), (None, v), (None, None), (3, p), (3, v + " " + u), (3, v + " " + u), (9, "z " * 50), (9, "z " * 51)]
    df = docs(spark, [x for _, x in rows], [i for i, _ in rows])
    keys = {x.text: x.k for x in df.select("text", F.xxhash64("text").alias("k")).collect()}
    got = [tuple(x) for x in SD.substring_dedup(df, shard=shard).collect()]
    assert sorted(got, key=str) == brute_spans([(i, x, keys[x]) for i, x in rows], 20)
    assert (2, 30, 0, u) in got and (None, 30, 0, v) in got


def test_substring_dedup_of_a_passage_in_many_contexts(spark):
    """Anchors with more distinct contexts than a shard holds, at the first and the second length."""
    r = random.Random(4)
    core = words(r, 24, 10**6)
    texts = [f"{words(r, r.randrange(12), 10**6)} {core} {words(r, r.randrange(12), 10**6)}" for _ in range(40)] + [core, f"{core} {core}"] * 2
    for shard in (1, 5):
        got = [tuple(x) for x in SD.substring_dedup(docs(spark, texts), shard=shard).collect()]
        assert sorted(got, key=str) == brute_spans([(i, t, 0) for i, t in enumerate(texts)], 20)


def test_substring_dedup_edges(spark):
    t = " ".join(f"k{i}" for i in range(30))
    assert SD.substring_dedup(docs(spark, [])).count() == 0
    same = SD.substring_dedup(docs(spark, [t, t], [4, 4])).collect()  # one occurrence, written twice
    assert [x.n_removed for x in same] == [0, 0]
    null_first = {x.doc_id: x.n_removed for x in SD.substring_dedup(docs(spark, [t, t], [4, None])).collect()}
    assert null_first == {None: 0, 4: 30}


@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=6), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=150, deadline=None)
def test_suffix_automaton(texts, query):
    a = SD.SuffixAutomaton()
    for t in texts:
        a.insert(t)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(e + 2) if n == 0 or tuple(query[e + 1 - n : e + 1]) in known), default=0) for e in range(len(query))]
    assert a.matching(query) == want


def test_bounded_reference_is_broadcast(spark):
    r = random.Random(8)
    ref, own = words(r, 60), words(r, 30)
    got = SD.remove_reference(docs(spark, [own + " " + ref + " " + own, own, None]), docs(spark, [ref]).select("text"))
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in got.collect()) == [(0, 120, 60), (1, 30, 0), (2, 0, 0)]
    with pytest.raises(ValueError, match="reference has"):
        SD.remove_reference(docs(spark, [own]), docs(spark, [ref]), most_words=10)


# mixing ------------------------------------------------------------------------------------


def test_fill_targets():
    t = MX.fill_targets([("a", 100), ("b", 100), (None, 1000), ("c", 0)])
    assert sum(t.values()) == pytest.approx(1800) and t["a"] == 200 and t["b"] == 200 and t["c"] == 0 and t[None] == 1400
    assert MX.fill_targets([]) == {}


def test_round_node_keeps_words():
    r = np.random.default_rng(1)
    mean = np.zeros(30)
    for k in range(400):
        sizes = sorted(np.random.default_rng(7).integers(1, 500, 30).tolist(), reverse=True)
        p = MX.round_node(sizes, [0.3] * 30, r.random(30).tolist())
        assert sum(0 < x < 1 for x in p) <= 1 and np.dot(p, sizes) == pytest.approx(0.3 * sum(sizes))
        mean += p
    assert abs(mean / 400 - 0.3).max() < 0.12  # every document keeps its probability
    p = MX.round_node([9, 7, 5, 3], [0.2, 0.9, 0.5, 0.4], [0.1, 0.6, 0.3, 0.8])
    assert sum(0 < x < 1 for x in p) <= 1 and np.dot(p, [9, 7, 5, 3]) == pytest.approx(0.2 * 9 + 0.9 * 7 + 0.5 * 5 + 0.4 * 3)


def test_mix(spark):
    r = random.Random(2)
    parts = [docs(spark, [words(r, r.randrange(1, 60)) for _ in range(n)], range(o, o + n), s) for o, n, s in ((0, 300, "a"), (300, 200, "b"), (500, 100, None))]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(docs(spark, [None, "", "x"], [900, 901, 902], "b"))
    rows = [tuple(x) for x in MX.mix(df, leaf_rows=16, fan_in=3).collect()]
    assert len(rows) == 603 and sorted(rows) == sorted(tuple(x) for x in MX.mix(df.repartition(7), leaf_rows=16, fan_in=3).collect())
    by = collections.defaultdict(list)
    for _, _, size, source_size, target, copies, taken in rows:
        assert taken == size * copies <= 2 * size
        by[source_size, round(target, 3)].append((taken, size))
    for (_, target), x in by.items():
        assert abs(sum(t for t, _ in x) - target) <= max(s for _, s in x)
    assert MX.mix(docs(spark, [])).count() == 0


# packing and tokens ------------------------------------------------------------------------


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=80, deadline=None)
def test_first_fit_decreasing(lengths):
    bins, offsets = P.first_fit_decreasing(np.array(lengths, np.int64), 64)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
        room += [64] * (k == len(room))
        want[i] = (k, 64 - room[k])
        room[k] -= lengths[i]
    assert {i: (int(bins[i]), int(offsets[i])) for i in range(len(lengths))} == want


@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*"ab Cé'sRe\t\x1c\xa0", "<|endoftext|>"])), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    import public_tokenizers

    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_caches_stay_bounded(path):
    from opalgrid.llm.tokens import ChunkEncoder

    e, r = ChunkEncoder(path, limit=40), random.Random(1)
    for _ in range(60):
        t = " ".join(f"word{r.randrange(200)} ж{r.randrange(50)}" for _ in range(20))
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.pieces) <= 40 and len(e.pieces.old) <= 40


def test_pack(spark, path):
    r = random.Random(4)
    texts = [words(r, r.randrange(200)) for _ in range(80)] + [None, "", words(r, 3000), "same", "same"]
    df = docs(spark, texts).unionByName(docs(spark, ["same"], [83]))
    rows = P.pack(df, path, capacity=256, group_pieces=40).collect()
    tokenizer = encoder(path).tokenizer
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((x.start, x.length, x.ids_crc32, x.doc_tokens) for x in rows if x.doc_id == i)
        assert mine[:: 2 if i == 83 else 1] == [(s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)) for s in range(0, len(ids), 256)]
    by = collections.defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for x in by.values():
        assert [o for o, _ in sorted(x)] == [0, *itertools.accumulate(n for _, n in sorted(x))][:-1] and sum(n for _, n in x) <= 256
    assert P.pack(docs(spark, []), path).count() == 0


# chat formatting ---------------------------------------------------------------------------


CHAT = "conv_id long, turn long, role string, text string"
_TOKENS = ["[TURN] ", "[/TURN]", "<s>", "</s>", "[INST]", "\\", "\\\\", "\n", "a", "é", "[", "<", "[IN", "ST]", " "]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "[/TURN]\\"]), st.lists(st.sampled_from(_TOKENS), max_size=8).map("".join)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_escaping_is_reversible(turns):
    texts = [t.encode() for _, t in turns]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(turns)
    ends = np.arange(n) == n - 1
    out, _, begin, end = C.assemble([r.encode() for r, _ in turns], np.frombuffer(b"".join(texts), np.uint8), offsets, np.arange(n) == 0, ends)
    raw = memoryview(out).tobytes()
    assert [(r.decode(), t.decode()) for r, t in C.turns_of(raw)] == turns
    assert [C.unescape(raw[a:b]).decode() for a, b in zip(begin, end)] == [t for _, t in turns]


def test_chat_format(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "</s>[INST] ok [/INST]", words(r, 20), "ü\\" * 3])) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(99, t, "assistant", f"t{t % 7}") for t in range(3500)] + [(None, 1, "user", "x"), (0, 0, rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, CHAT).withColumn("chunk", F.lit("clash"))
    formatted = stash(C.chat_format(df))
    assert formatted.where("conv_id = 99").count() > 1  # a long conversation comes in chunks
    got = {x.conv_id: x for x in C.digests(C.chat_format(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {c: "".join(x.formatted.decode() for x in sorted(g, key=lambda x: x.chunk)) for c, g in itertools.groupby(sorted(formatted.collect(), key=lambda x: (x.conv_id or -1)), key=lambda x: x.conv_id)}
    assert all(len(t) == got[c].formatted_chars and t.startswith("<s>") and t.endswith("</s>") for c, t in whole.items())
    assert C.chat_format(spark.createDataFrame([], CHAT)).count() == 0


# quality rules -----------------------------------------------------------------------------


def brute_counts(text):
    w = [x for x in split(text)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    covered = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(split(line))
        seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


TEXTS = [None, "", " \n\t", "a b c a b c", "ä|ö *", "x\nx\n\n\ny\nx", "to " * 60, "a b c d " * 20, "é" * 5000 + " z", "  \x1c w", "a\r\na\r\nb"]


@pytest.mark.parametrize("text", TEXTS)
def test_text_counts(text):
    assert Q.text_counts((text or "").encode(), WordHashes())[:5] == brute_counts(text)


def test_quality_rules(spark):
    r = random.Random(1)
    good = [words(r, 80, 3000) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(r, 80, 3000).split()) for _ in range(60)]
    texts = [*good, *bad, *TEXTS]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210) if i % 4] + [(None, 0), (3, None)], "doc_id long, quality int")
    df = docs(spark, texts).withColumn("rule", F.lit("clash"))
    got = {x.doc_id: x for x in Q.quality_rules(df, labels).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert tuple(got[i][c] for c in Q.COUNTS) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 210))
    assert all(got[i].kept == (not got[i].base_failed) for i in (x.doc_id for x in Q.quality_rules(df, None).collect()) if i < 150)
    assert Q.quality_rules(docs(spark, []), labels).count() == 0


def test_emitted_expression_equals_the_rules(spark):
    r = np.random.default_rng(6)
    counts = [dict(zip([*Q.COUNTS, *Q.MORE], r.integers(0, 30, len(Q.COUNTS) + len(Q.MORE)).tolist(), strict=True)) for _ in range(300)]
    rules = [[(int(f), str(sign), float(t)) for f, sign, t in zip(r.integers(0, len(Q.FEATURES), k), r.choice(["<=", ">"], k), r.random(k) * 2, strict=True)] for k in (1, 2, 3, 2)]
    x = np.array([[c[a] / max(1, c[b]) for a, b in Q.FEATURES.values()] for c in counts])
    want = np.zeros(300, int)
    for k, rule in reversed(list(enumerate(rules, 1))):
        want[Q._covers(rule, x)] = k
    df = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(counts)], "i long, " + ", ".join(f"{n} long" for n in counts[0]))
    got = {row.i: row.rule or 0 for row in df.select("i", Q.expression(rules).alias("rule")).collect()}
    assert [got[i] for i in range(300)] == want.tolist()


def test_rows_equal_in_all_are_spread(spark, path):
    """A third of all rows the same: no group or leaf holds them all, and every row is packed and mixed once."""
    df = docs(spark, ["a b c"] * 400 + [f"t{i} u v" for i in range(200)], [9] * 400 + list(range(100, 300)))
    packed = P.pack(df, path, capacity=64, group_pieces=64).collect()
    assert len(packed) == 600 and len({x.sequence_id >> 32 for x in packed if x.doc_id == 9}) > 3
    mixed = MX.mix(df, leaf_rows=64).collect()
    assert len(mixed) == 600 and abs(sum(x.taken for x in mixed) - mixed[0].target) <= 3
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, MX.mix(df, leaf_rows=64).collect()))


# HTML --------------------------------------------------------------------------------------


def test_blocks():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><div class=ad>x &amp; y</div><p>one<b>bold</b>\n two<p>three<br>four</p><!-- no --><li>a<li>b</body>"
    assert [b.text for b in HB.blocks_of(page)] == ["x & y", "onebold two", "three four", "a", "b"]
    assert HB.blocks_of("") == [] and [b.text for b in HB.blocks_of("just < text &copy;")] == ["just < text ©"]
    assert [b.text for b in HB.blocks_of('<p title="a>b">c</p><div>' * 300)].count("c") == 300


def test_gradients_by_differences():
    pages = H.training_pages(4, seed=5)
    e, y = H.Encoded([b for b, _ in pages], H.WordBuckets()), np.concatenate([y for _, y in pages])
    w = {k: (v + np.random.default_rng(0).normal(0, 0.05, v.shape)).astype(np.float64) for k, v in H.start_weights().items()}

    def loss(w):
        z, _ = H.forward(e, w)
        return float(np.sum(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y))

    z, parts = H.forward(e, w)
    g = H.gradients(e, w, (1 / (1 + np.exp(-z)) - y).astype(np.float32), parts)
    for name, at in (("out", (3,)), ("ua", (2, 7)), ("wb", (4, 20)), ("cb", (9,)), ("path", (int(e.token[0]), 2)), ("path", (int(e.steps[0, 1]), 5)), ("word", (int(e.word[0]), 1)), ("skip", (1,))):
        v = {k: x.copy() for k, x in w.items()}
        v[name][at] += 1e-2
        up = loss(v)
        v[name][at] -= 2e-2
        assert g[name][at] == pytest.approx((up - loss(v)) / 2e-2, rel=0.05, abs=0.02), name


def test_extract_holds_on_unseen_layouts(spark):
    pages = H.training_pages(150, seed=1234)
    labels = H.label_pages([b for b, _ in pages], H.trained(), H.WordBuckets())
    right = np.concatenate([a == (b > 0.5) for a, (_, b) in zip(labels, pages)])
    assert right.mean() > 0.99
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>First  para &amp; more.<p>Short.</article><footer>&copy; us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", ""), (1, "u", html)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect())
    want = "Title\nFirst para & more.\nShort."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]


# token counts ------------------------------------------------------------------------------


def test_rollup(spark, path, tmp_path):
    df = docs(spark, ["a b", None, "c", "don't"]).withColumn("source", F.when(F.col("doc_id") < 2, "x"))
    counts = stash(TC.token_counts(df, {"bpe": path}))
    tokenizer = encoder(path).tokenizer
    got = {(r.doc_id, r.tokenizer): r.tokens for r in counts.collect()}
    assert got == {**{(i, TC.WORDS): len(split(t)) for i, t in enumerate(["a b", "", "c", "don't"])}, **{(i, "bpe"): len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(["a b", "", "c", "don't"])}}
    roll = TC.Rollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    w = counts.where(F.col("tokenizer") == TC.WORDS)
    assert roll.commit(0, TC.inserts(w)) and not roll.commit(0, TC.inserts(w))
    assert roll.commit(1, TC.deletes(w.where("doc_id = 2")))
    new = w.where("doc_id = 3").withColumn("tokens", F.lit(5).cast("long")).withColumn("source", F.lit("x"))
    assert roll.commit(2, TC.revisions(w.where("doc_id = 3"), new)) and not roll.commit(1, TC.inserts(w))
    assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in roll.totals().collect()) == [("x", 3, 7)]
    assert roll.batches() == [0, 1, 2]
    before = sorted(map(tuple, roll.totals().collect()))
    assert roll.compact() == [0, 1, 2] and sorted(map(tuple, roll.totals().collect())) == before
    assert not roll.commit(1, TC.inserts(w)) and roll.commit(5, TC.inserts(w)) and roll.commit(3, TC.deletes(w))
    assert sorted(map(tuple, roll.totals().collect())) == before and roll.compact() == [0, 1, 2, 3, 5] and roll.compact() == []
    assert sorted(map(tuple, roll.totals().collect())) == before and not roll.commit(5, TC.deletes(w))


def test_rollup_of_writers_that_race(spark, tmp_path):
    a, b = (TC.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    row = spark.createDataFrame([("s", "en", "words", 1, 4)], TC.DELTAS)
    a.committed = b.committed = lambda batch: False  # both looked before either wrote
    assert a.commit(4, row) and not b.commit(4, row) and not a.commit(4, row)
    assert [tuple(r) for r in a.totals().collect()] == [("s", "en", "words", 1, 4)]


def test_token_counts_of_odd_rows(spark, path):
    df = docs(spark, [None, "", "w " * 50_000, "x", "x"], [None, 1, 2, 3, 3], source=None).withColumns({"tokens": F.lit("clash"), "tokenizer": F.lit(0)})
    got = collections.Counter((r.doc_id, r.tokens) for r in TC.token_counts(df, {}).collect())
    assert got == collections.Counter([(None, 0), (1, 0), (2, 50_000), (3, 1), (3, 1)])
    assert TC.token_counts(docs(spark, []), {"bpe": path}).count() == 0


def test_op9_commits_deletes_and_revisions_of_the_whole_table(spark, tmp_path, monkeypatch, path):
    from opalgrid.llm.queries import op9_token_counts

    texts = ["a b", "don't stop", "", "c", "a"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    seen, commit = [], TC.Rollup.commit

    def spy(self, batch, deltas):
        new = commit(self, batch, deltas)
        signs = collections.Counter(r.n_docs for r in deltas.collect())
        seen.append((new, signs[1], signs[-1]))
        return new

    monkeypatch.setattr(TC.Rollup, "commit", spy)
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in op9_token_counts(spark, str(tmp_path)).collect()}
    own = encoder(path)
    assert got == {TC.WORDS: (5, sum(len(split(t)) for t in texts)), "word_bpe_49k": (5, sum(own.count(t) for t in texts))}
    committed = [s[1:] for s in seen if s[0]]
    assert (5, 5) in committed and (0, 10) in committed  # a revision and a delete of every document
    assert any(not s[0] and s[2] for s in seen)  # a replay of them


def test_sets_of_one_identifier_each_have_their_links(spark):
    r = random.Random(31)
    a, b, c = (words(r, 60) for _ in range(3))
    near = lambda t: t + " tail"
    rows = [(None, a), (None, b), (None, c), (5, a), (9, near(a)), (7, near(b)), (12, words(r, 60)), (12, near(c)), (20, words(r, 30)), (20, ""), (None, "")]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = collections.Counter((x.doc_id, x.component_id) for x in N.similarity_components(df).collect())
    assert got == collections.Counter([(None, None)] * 4 + [(5, None), (9, None), (7, None), (12, 12), (12, None), (20, 20), (20, 20)])
    kept = {(x.doc_id, x.text) for x in N.one_of_each(df).collect()}
    assert kept == {x for x in rows if x not in [(5, a), (9, near(a)), (7, near(b)), (12, near(c))]}


def test_head_left_open_and_math():
    texts = lambda page: [b.text for b in HB.blocks_of(page)]
    assert texts("<html><head><meta charset=x><title>T</title><script>s</script><article><p>one</p></article>") == ["one"]
    assert texts("<head><title>T</title>\n two <b>words</b>") == ["two words"]
    assert texts("<head><template><p>no</p></template><style>s</style></head><body><p>so <math><mi>x</mi></math></p>") == ["so x"]


# toxicity ----------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(5)
    insult = ["grobian", "vilwort", "vilness", "vility"]
    bad = set(r.sample(range(600), 120))
    texts = [words(r, 60) + (" " + " ".join(r.sample(insult, 2)) if i in bad else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(600)], "doc_id long, toxic int")
    df = docs(spark, texts).unionByName(docs(spark, [None, "", "Vilhood grobian!"], [900, 901, None])).withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in T.toxicity(df, labels).collect()}
    for i, x in got.items():
        assert x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
    held = [i for i in range(600) if got[i].held_out]
    assert all(got[i].predicted == int(i in bad) for i in held)
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1
    flipped = labels.withColumn("toxic", F.when(T.held_out_column(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in T.toxicity(df, flipped).collect()}
    assert again == {i: x.score for i, x in got.items()}  # held-out labels are never read
    assert T.toxicity(docs(spark, []), labels).count() == 0 and T.toxicity(df, labels.limit(0)).where("predicted = 1").count() == 0


def test_label_model_finds_accuracies():
    r = np.random.default_rng(2)
    y = r.random(4000) < 0.2
    rates = [(0.6, 0.01), (0.5, 0.02), (0.4, 0.005), (0.3, 0.2)]
    v = np.stack([np.where(y, r.random(4000) < a, r.random(4000) < b) for a, b in rates], axis=1)
    v = np.concatenate([v, v[:, :1]], axis=1)  # a voter that repeats another
    q, accuracy, weight = T.label_model(v, 0.2)
    assert accuracy[0] > 0.8 > 0.5 > accuracy[3] and weight[0] == pytest.approx(0.5, abs=0.1) and weight[1] == 1
    assert ((q > 0.5) == y).mean() > 0.9


def test_label_model_keeps_a_minority_language():
    r = np.random.default_rng(4)
    n, frequent, rare = 4000, 12, 8
    y, v = np.zeros(n, bool), np.zeros((n, 3 * (frequent + rare)), bool)
    for i in range(n):  # a toxic row has words of its own language, each with two beginnings
        words = r.choice(frequent, 4, replace=False) if i < 320 else frequent + r.choice(rare, 2, replace=False) if i < 350 else []
        y[i] = len(words) > 0
        for w in words:
            v[i, 3 * w : 3 * w + 3] = True
    v[np.arange(2000, 2060), 3 * r.integers(frequent + rare, size=60)] = True  # a lone beginning in clean rows
    q, _, _ = T.label_model(v, float(y.mean()))
    assert (q[320:350] > 0.5).all() and (q[:320] > 0.5).all() and (q[~y] < 0.5).mean() > 0.99


def test_voters_need_rows_not_a_share(spark):
    rows = [([1] if i < 600 else [2] if i < 605 else [3] if i < 607 else [9], i < 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "found array<int>, toxic boolean")
    assert T.voters(df) == [1, 2]  # 5 of 1000 toxic rows are enough, 2 are not
    assert T.voters(df, most=1) == [1] and T.voters(df.limit(0)) == []


def test_training_rows_are_bounded_however_often_an_identifier_repeats(spark):
    df = docs(spark, ["a b"] * 300 + ["c", None, "x " * 100_000], [7] * 300 + [8, 7, 11])
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, None), (11, 0), (None, 1)], "doc_id long, toxic int")
    got = T.training_rows(df, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in got) == [(i, t) for i, t in ((7, True), (8, False), (11, False)) if not T.held_out(i)]


def test_hash_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = sorted(r.doc_id for r in hash_sample(df, "doc_id", 50).collect())
    assert len(a) == 50 and a == sorted(r.doc_id for r in hash_sample(df.repartition(9), "doc_id", 50).collect())
    assert hash_sample(df, "doc_id", 5000).count() == 1000


# what stays in memory beside a stage ------------------------------------------------------


def test_a_stash_is_written_without_checksum_files(spark):
    # on a local path Hadoop starts a chmod for each file, and those of checksums besides
    kept = stash(spark.range(0, 1000, 1, 4))
    files = [p.name for p in pathlib.Path(kept._stash_path.removeprefix("file://")).rglob("*")]
    assert len(files) == 4 and all(f.startswith("part-") and f.endswith(".parquet") for f in files)
    assert sorted(r.id for r in kept.collect()) == list(range(1000))


def test_packing_leaves_no_cache_in_waiting_workers(spark, path):
    assert P.pieces(docs(spark, ["some words to encode"] * 40).repartition(4), path).count() == 40

    def held(batches):
        for _ in batches:
            caches = [c for e in tokens._loaded.values() for c in (e.pieces, e.chunks)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(c) + len(c.old) for c in caches)], pa.int64())], names=["n"])

    assert spark.range(0, 16, 1, 16).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_mix_starts_no_workers_for_its_table_of_sources(spark, monkeypatch):
    d = stash(docs(spark, ["a b c"] * 20 + [None], source=None).unionByName(docs(spark, ["d e"] * 9, ids=range(30, 39), source="x")))
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows were pickled through Python workers"))
    found = {r.source_size: r.n for r in MX.mix(d).groupBy("source_size").agg(F.count("*").alias("n")).collect()}
    assert found == {60: 21, 18: 9}
    assert MX.mix(d.where("false")).count() == 0


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    given_back = []
    monkeypatch.setattr(common, "give_back", lambda: given_back.append(1))
    assert list(common.trimmed(lambda batches: iter(batches))([1, 2])) == [1, 2] and given_back == [1]


def test_heaps_are_collected_before_a_step(spark):
    collections_ = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collections_()
    common.tune(spark)  # on a local master the driver is the executor
    assert collections_() > before


def test_substring_dedup_empties_the_heaps_between_its_steps(spark, monkeypatch):
    calls, own = [], common.empty_heaps
    for module in (common, SD):
        monkeypatch.setattr(module, "empty_heaps", lambda s: calls.append(own(s)))
    r = random.Random(5)
    line = words(r, 30)
    rows = SD.substring_dedup(docs(spark, [line, f"{words(r, 25)} {line}", None]), shard=1).orderBy("doc_id").collect()
    # before the first step, after the contexts, the spans, the long anchors if there are any, and the marks
    assert [x.n_removed for x in rows] == [0, 30, 0] and len(calls) >= 4
