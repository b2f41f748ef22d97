import random

import numpy as np
import pytest

from inkwell.llm import reading as R

WORDS = {1: "cat dog sun run big red", 2: "village soldier bridge winter brave letter", 3: "strategy reluctant alliance garrison critics siege", 4: "hermeneutic stemmatic paratext provenance epistemic colophon"}
EXTRA = "doc_id bigint, text string, opinion double, nodes string"
LAB = "doc_id bigint, reading_level int, rater string, labelled_at timestamp_ntz, text string"


def sentence(rnd, level):
    w = WORDS[level].split()
    return " ".join(["The", *(rnd.choice(w) for _ in range(4 + rnd.randrange(6))), f"of {rnd.choice(['Rooke', 'Vane'])}"]) + "."


def collection(n=400, seed=1):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        level = rnd.randrange(1, 5)
        truth[i] = level
        parts = [sentence(rnd, level if rnd.random() < 0.8 else rnd.randrange(1, 5)) for _ in range(rnd.randrange(6, 14))]
        docs.append((i, " ".join(parts), 0.0, "x"))
    return docs, truth


def test_levels_are_found_from_few_noisy_opinions(spark):
    docs, truth = collection()
    rnd = random.Random(2)
    labels = [(i, truth[i] if rnd.random() < 0.85 else rnd.randrange(0, 6), "r", None, "") for i in rnd.sample(range(400), 120)] + [(i, None, None, None, "") for i in range(5)] + [(10_000, 3, "r", None, ""), (None, 2, "r", None, "")]
    labels += labels[:10]
    got = {r.doc_id: r.reading_level for r in R.reading_levels(spark.createDataFrame(docs, EXTRA), spark.createDataFrame(labels, LAB)).collect()}
    assert len(got) == 400 and np.mean([got[i] == truth[i] for i in truth]) > 0.93


def test_left_out_and_kept(spark):
    docs = [(1, "这是一句话。", 0.0, ""), (2, None, 0.0, ""), (3, "", 0.0, ""), (4, "123 !!", 0.0, ""), (5, "橋が落ちたぞと言ったのは誰だろうか。", 0.0, ""), (6, "ขุนวารีมีทหาร", 0.0, ""), (7, "Hello there.", 0.0, ""), (7, "Hello there.", 0.0, "")]
    got = [(r.doc_id, r.reading_level) for r in R.reading_levels(spark.createDataFrame(docs, EXTRA), spark.createDataFrame([], LAB)).orderBy("doc_id").collect()]
    assert got == [(1, 2), (7, 2), (7, 2)]


def test_empty_collection(spark):
    assert R.reading_levels(spark.createDataFrame([], EXTRA), spark.createDataFrame([(1, 3, "r", None, "")], LAB)).count() == 0


@pytest.mark.parametrize(("text", "lang"), [("中文文本很多 with some words", "zh"), ("English with 中", "en"), ("かなとカナばかりの文", None), ("नमस्ते दुनिया", None), ("123", None), ("Ａ", None), ("", None), ("pyccкий 中文文本很多字", "zh")])
def test_language(text, lang):
    assert R.language(text) == lang


def test_opinions_are_medians(spark):
    rows = [(1, 1, "a", None, ""), (1, 3, "b", None, ""), (1, 3, "b", None, ""), (2, 9, "a", None, ""), (2, None, "a", None, ""), (3, 4, None, None, "")]
    assert {tuple(r) for r in R.opinions(spark.createDataFrame(rows, LAB)).collect()} == {(1, 2.0), (3, 4.0)}


def brute_round(docs, y, clamped, model):
    sums = {}
    for words, yi, c in zip(docs, y, clamped):
        weight = sum(model[k][1] for k in words if k in model) if model else 0
        if c:
            v, strength = yi, 1.0
        elif weight <= 1e-9:
            continue
        else:
            v, strength = sum(model[k][0] * model[k][1] for k in words if k in model) / weight, R.FREE
        for k in words:
            n, s, q = sums.get(k, (0, 0, 0))
            sums[k] = (n + strength, s + strength * v, q + strength * v * v)
    return {k: ((s + R.MIDDLE * R.PRIOR) / (n + R.PRIOR), (1 / (max(q / n - (s / n) ** 2, 0) + R.SPREAD + 1 / (n + 1))) ** R.SHARPNESS) for k, (n, s, q) in sums.items()}


def keyed(graph):
    """(opinion, words in order, distinct words) per document, with keys in place of places."""
    rows = graph.collect()
    vocabulary = {r.block: r.vocabulary for r in rows if r.vocabulary is not None}
    out = {}
    for r in rows:
        if r.vocabulary is None:
            words = [vocabulary[r.block][~p if p < 0 else p] for p in r.words]
            first = [vocabulary[r.block][~p] for p in r.words if p < 0]
            assert sum(r.lengths) == len(words) and len(first) == len(set(first)) and set(first) == set(words)
            out[r.doc_id] = (r.opinion, words, set(first))
    return out


@pytest.mark.parametrize("size", [10**6, 300])
def test_distributed_rounds_equal_brute_force(spark, size):
    docs, truth = collection(60)
    labels = [(i, truth[i], "r", None, "") for i in range(0, 60, 4)]
    graph = R.document_graph(spark.createDataFrame(docs, EXTRA).repartition(5), R.opinions(spark.createDataFrame(labels, LAB)), size=size)
    assert (graph.select("block").distinct().count() > 20) == (size == 300)
    of = keyed(graph)
    y, words = [o for o, _, _ in of.values()], [d for _, _, d in of.values()]
    clamped = [o is not None for o in y]
    got, want = None, None
    for _ in range(3):
        got = R.cut(R._round(graph, got))
        old, want = want, brute_round(words, y, clamped, want)
        rows = {r.key: r for r in got.collect()}
        assert rows.keys() == want.keys() and all(np.allclose((rows[k].mu, rows[k].w), want[k]) for k in want)
        assert old is None or all(abs(rows[k].moved - abs(want[k][0] - (old[k][0] if k in old else R.MIDDLE))) < 1e-9 for k in want)


def test_rounds_settle_and_say_so(spark):
    docs, truth = collection(80)
    graph = R.document_graph(spark.createDataFrame(docs, EXTRA), R.opinions(spark.createDataFrame([(i, truth[i], "r", None, "") for i in range(0, 80, 5)], LAB)))
    done = R.word_difficulty(graph)
    assert done.settled and done.moves[-1] < R.SETTLED and done.moves == sorted(done.moves, reverse=True)
    with pytest.warns(UserWarning, match="still move"):
        assert not R.word_difficulty(graph, rounds=1, settled=0).settled


def test_every_word_is_a_node_of_its_own(spark):
    """More than 2^18 words: none shares a node with another, and levels are still found."""
    rnd = random.Random(5)
    docs, truth = collection(120)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs += [(1000 + i, " ".join("".join(rnd.choice(letters) for _ in range(9)) for _ in range(4000)), 0.0, "x") for i in range(80)]
    frame = spark.createDataFrame(docs, EXTRA).repartition(6)
    graph = R.document_graph(frame, R.opinions(spark.createDataFrame([], LAB)))
    words = graph.where("vocabulary is not null").selectExpr("explode(vocabulary) k").distinct().count()
    distinct = len({w.lower() for _, t, _, _ in docs for w in t.replace(".", " ").split()})
    assert words == distinct > 1 << 18
    labels = spark.createDataFrame([(i, truth[i], "r", None, "") for i in range(0, 120, 2)], LAB)
    got = {r.doc_id: r.reading_level for r in R.reading_levels(frame, labels).collect()}
    assert len(got) == 200 and np.mean([got[i] == truth[i] for i in truth]) > 0.9


def test_learned_periods_cut_the_sentences(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["We met Dr. Vane today.", "It was late.", "He saw Dr. Thale there.", "Then they left."]) for _ in range(8)), 0.0, "en") for i in range(300)]
    frame = spark.createDataFrame(docs, EXTRA)
    known = R.learn_periods(frame, "text")
    graph = R.document_graph(frame, R.opinions(spark.createDataFrame([], LAB)), known)
    assert {len(r.lengths) for r in graph.where("vocabulary is null").collect()} == {8}


def test_long_text(spark):
    docs = [(1, "这是一句很长的话。" * 30_000, 0.0, ""), (2, "The cat ran.", 0.0, "")]
    assert R.reading_levels(spark.createDataFrame(docs, EXTRA), spark.createDataFrame([(1, 3, "r", None, "")], LAB)).count() == 2


def test_rounds_shuffle_neither_documents_nor_what_blocks_ask(spark):
    docs, truth = collection(60)
    graph = R.document_graph(spark.createDataFrame(docs, EXTRA), R.opinions(spark.createDataFrame([(i, truth[i], "r", None, "") for i in range(0, 60, 4)], LAB)), size=300)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(block" not in plan(R._round(graph, None))
    words, asked = R.cut(R._round(graph, None)), R.asked_words(graph)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(R._answers(asked, words)).count("Exchange hashpartitioning(key") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("scale", [1, 1 << 55])
def test_first_uses_of_edges(scale):
    edge = np.random.default_rng(1).integers(0, 50, 400) * scale
    want = np.zeros(400, bool)
    want[np.unique(edge, return_index=True)[1]] = True
    assert (R._first_uses(edge) == want).all() and not len(R._first_uses(edge[:0]))
