"""Leak search against all runs of 13 words."""

import random
import re

import pyarrow as pa
import pytest

import numpy as np

from tilery.llm.leaks import ItemIndex, _shares, item_indexes, search_leaks, words_of


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(documents, items, run=13):
    grams = {}
    for key, text in items:
        w = words(text)
        for i in range(len(w) - run + 1):
            grams.setdefault(tuple(w[i : i + run]), set()).add(key)
    out = set()
    for key, text in documents:
        w = words(text)
        for i in range(len(w) - run + 1):
            out |= {(key, item) for item in grams.get(tuple(w[i : i + run]), ())}
    return out


def make(seed, n_items=40, n_docs=150, vocabulary=60):
    random.seed(seed)
    draw = lambda n: [f"w{random.randrange(vocabulary)}" for _ in range(n)]
    items = [(i, " ".join(draw(random.randint(5, 60)))) for i in range(n_items)]
    documents = []
    for d in range(n_docs):
        text = draw(random.randint(0, 150))
        if random.random() < 0.6:
            w = words(random.choice(items)[1])
            size = random.choice([11, 12, 13, 14, 30])
            at = random.randrange(max(1, len(w) - size + 1))
            part = w[at : at + size]
            if random.random() < 0.3 and len(part) > 6:
                part.insert(random.randrange(len(part)), "stranger")
            text[random.randrange(len(text) + 1) : 0] = part
        documents.append((d, random.choice([" ", "\n// ", "_", " * "]).join(w.upper() if random.random() < 0.2 else w for w in text)))
    return documents, items


@pytest.mark.parametrize("seed", range(6))
def test_search(seed):
    documents, items = make(seed)
    index = ItemIndex([k for k, _ in items], [t for _, t in items], block=4)
    found, rows = words_of(pa.array([t for _, t in documents]))
    got = {(documents[r][0], index.keys[i]) for r, i, *_ in _shares(found, np.asarray(rows), index, 64)}
    assert got == brute(documents, items)


def test_retrieval_is_exactly_the_threshold():
    _, items = make(3)
    index = ItemIndex([k for k, _ in items], [t for _, t in items], block=3)
    random.seed(1)
    for _ in range(200):
        query = random.sample(range(len(index.vocabulary)), 25)
        totals = {}
        for w in query:
            for item, impact in zip(*index.lists(w)[:2]):
                totals[item] = totals.get(item, 0) + impact
        sure = {i for i, v in totals.items() if v >= 1 + 1e-9}
        maybe = {i for i, v in totals.items() if v >= 1 - 1e-9}
        got = index.search(query)
        assert len(got) == len(set(got)) and sure <= set(got) <= maybe


def test_frame(spark):
    documents, items = make(9, n_docs=60)
    long = "\n".join(t for _, t in documents) * 5
    documents += [(1000, None), (1001, ""), (1002, long), (1003, items[0][1] if len(words(items[0][1])) >= 13 else items[1][1])]
    listed = spark.createDataFrame([*items, (77, None)], "item_id long, text string")
    frame = spark.createDataFrame([(k, t, 1) for k, t in documents], "doc_id long, text string, runs int")
    got = {(r["doc_id"], r["item_id"]) for r in search_leaks(frame, "doc_id", "text", listed, "item_id", "text").collect()}
    assert got == brute(documents, items)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert search_leaks(frame, "doc_id", "text", none, "item_id", "text").count() == 0
    assert search_leaks(frame.limit(0), "doc_id", "text", none, "item_id", "text").count() == 0


def test_items_in_parts(spark):
    documents, items = make(11, n_docs=60)
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    listed = spark.createDataFrame(items, "item_id long, text string")
    rows = search_leaks(frame, "doc_id", "text", listed, "item_id", "text", most=2000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == brute(documents, items) and len(got) == len(rows)


@pytest.mark.parametrize("waiting", [1, 5_000, 32_000_000])
def test_parts_of_uneven_size(spark, monkeypatch, waiting):
    monkeypatch.setattr("tilery.llm.leaks.MAX_WAITING", waiting)
    documents, items = make(12, n_docs=40)
    items = [*items, (999, " ".join(f"long{i}" for i in range(400))), (1000, None), (1001, "")]
    documents = [*documents, (9999, " ".join(f"long{i}" for i in range(50, 90)))]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    listed = spark.createDataFrame(items, "item_id long, text string")
    sizes = [sum(len(t or "") for k, t in items if k in index.keys) for index in item_indexes(listed, "item_id", "text", most=2000)]
    assert len(sizes) > 3 and sum(size > 2000 for size in sizes) == 1
    rows = search_leaks(frame, "doc_id", "text", listed, "item_id", "text", most=2000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == brute(documents, items) and (9999, 999) in got and len(got) == len(rows)


def test_items_beyond_the_limit_of_an_index(spark):
    """Three items of more than five million characters each, under the limit in force."""
    texts = [" ".join(f"{c}{i}" for i in range(640_000)) for c in "abc"]
    assert all(len(t) > 4_500_000 for t in texts)
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    documents = spark.createDataFrame([(i, " ".join(f"{c}{k}" for k in range(9000 + i, 9013 + i))) for i, c in enumerate("abcd")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["runs"]) for r in search_leaks(documents, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(0, 0, 1), (1, 1, 1), (2, 2, 1)}


def test_question_and_answer(spark):
    question, answer = " ".join(f"q{i}" for i in range(20)), "it is the ninth"
    items = [(1, f"{question}?\n  Answer: {answer}."), (2, f"answer in {question} more"), (3, f"Solution:\n{question}")]
    documents = [(1, f"// {question} answer it IS the_ninth"), (2, question), (3, f"{answer}"), (4, " ".join(question.split()[:15]) + f" x {answer}"), (5, " ".join(question.split()[12:]))]
    frame, listed = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = search_leaks(frame, "doc_id", "text", listed, "item_id", "text").collect()
    got = {(r["doc_id"], r["item_id"]): (r["runs"], r["question"], r["answer"]) for r in rows}
    # the word `answer` itself counts to the question; item 2 has no answer, item 3 is nothing but one
    assert got == {
        (1, 1): (13, 21, True), (2, 1): (8, 20, False), (4, 1): (3, 15, True), (1, 2): (8, 20, None), (2, 2): (8, 20, None), (4, 2): (3, 15, None),
        (1, 3): (8, 0, True), (2, 3): (8, 0, True), (4, 3): (3, 0, False),
    }
