"""The grammar on clauses, learning, and held-out accuracy."""

import zlib

import pytest

from foldwise.llm import toxicity

WEIGHTS = {"idiot": 2.0, "moron": 1.0}


def score(text):
    return toxicity.clause_scores(text, WEIGHTS)


def test_grammar():
    assert score("what an idiot") == [2.0]
    assert score("You IDIOT! you moron.") == [pytest.approx(2.6), pytest.approx(1.3)]
    assert score("he is not an idiot") == [pytest.approx(2.0 * 1.3 * 0.4)]
    assert score("not a b c idiot") == [2.0]
    assert score("she said: fine") == []
    assert score("one said idiot") == [1.0]
    assert score('an "idiot" moron') == [pytest.approx(1.0 + 1.0)]
    assert score("they will kill you") == [pytest.approx(3.0 * 1.3)]
    assert score("kill the process") == []
    assert score("") == []


def test_composition_equals_the_parts():
    import itertools

    g = toxicity.grammar()
    for word in itertools.product(toxicity.KINDS, repeat=4):
        state, parts = g.start, [p.start for p in g.parts]
        for kind in word:
            state, factor = g.step(state, kind)
            moves = [p.step(s, kind) for p, s in zip(g.parts, parts)]
            parts = [s for s, _ in moves]
            want = 1.0
            for _, w in moves:
                want *= w
            assert state == tuple(parts) and factor == pytest.approx(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    english = {r["doc_id"] for r in docs.filter("lang = 'en'").collect()}
    hits = [0, 0, 0, 0]
    for r in labels.collect():
        d = rows[r["doc_id"]]
        assert d["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert d["predicted"] == (d["score"] >= 0.5)
        if d["held_out"] and r["doc_id"] in english:
            hits[2 * r["toxic"] + d["predicted"]] += 1
    true_clean, false_toxic, missed, caught = hits
    assert caught >= 0.8 * (caught + missed) and false_toxic <= 0.05 * (true_clean + false_toxic)


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (9000, 1)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    rows = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in rows} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def recall_by_language(docs, labels):
    """Held-out toxic documents and those caught, by language."""
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = {}
    for r in labels.filter("toxic = 1").collect():
        d = rows[r["doc_id"]]
        if d["held_out"]:
            n, caught = out.get(lang[r["doc_id"]], (0, 0))
            out[lang[r["doc_id"]]] = n + 1, caught + d["predicted"]
    return out


def test_recall_in_every_language(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    found = recall_by_language(read("documents"), read("labels"))
    assert set(found) == {"en", "de", "fr", "es"}
    assert all(caught >= 0.8 * n for n, caught in found.values()), found


def insulting(spark, n=150):
    """Documents of which every second is toxic, by one of three words, and their labels."""
    words = ["idiot", "Dummkopf", "imbécile"]
    rows = [(i, f"text {i} of the day: you {words[i // 2 % 3] if i % 2 else 'reader'} number {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_few_labels_of_equal_share(spark):
    docs, labels = insulting(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)


def test_threats_count_without_learned_words(spark):
    rows = [(i, f"they will kill you {chr(97 + i)}q" if i % 2 else f"fine {chr(97 + i)}x") for i in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = toxicity.score_documents(docs, spark.createDataFrame([(i, i % 2) for i in range(26)], "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scores)


def test_one_reading_of_words(spark):
    """Learning, scoring and the classes of the grammar read the same words."""
    plain = score("you idiot now")
    for text in ("you idiot’s now", "you “idiot” now", "you idiot… now", "you idiot— now", "you «idiot» now", "you　idiot、now"):
        assert score(text) == plain == [pytest.approx(2.6)], text
    for word in ("imbe\u0301cile", "बेवकूफ़", "你是一个非常非常愚蠢的人而且没有任何用处", "x" * 60):
        assert toxicity.clause_scores(f"you {word}, 2 {word}2", {word: 1.0}) == [pytest.approx(2.6)], word
        rows = [(i, f"you {word}’s, {i}" if i % 2 else f"you reader, {i}") for i in range(80)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
        assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score_documents(docs, labels).collect()), word


def test_lexicon_beyond_a_broadcast(spark, docs, monkeypatch):
    more, labels = insulting(spark)
    table = docs.select("doc_id", "text").union(more).union(more.limit(5))
    scores = lambda: sorted((r["doc_id"] or 0, round(r["score"], 9)) for r in toxicity.score_documents(table, labels).collect())
    sent = scores()
    assert len({x for _, x in sent}) > 1
    monkeypatch.setattr(toxicity, "fits_broadcast", lambda df: False)
    assert scores() == sent


def test_labels_are_never_broadcast(spark, monkeypatch):
    """The rows that are learned from come from one kind of join at every size."""
    from foldwise.llm import toxicity

    plans, settle = [], toxicity.settle
    monkeypatch.setattr(toxicity, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    docs = spark.createDataFrame([(i, "you are a fool" if i % 2 else "a fine day") for i in range(40)], "doc_id long, text string")
    toxicity.score_documents(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")).collect()
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
