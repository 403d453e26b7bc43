"""Learnt operators by held-out accuracy, and the pipeline by its parts."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from recallkit.llm import decontaminate, langid, mixing, quality, simhash, toxicity
from recallkit.llm import queries as q

SMALL = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    rows = q.op2_toxicity(spark, SMALL).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 500
    toxic, score = rows["toxic"] == 1, rows["score"]
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.97
    assert (rows["predicted"] == (score >= 0.5)).all()
    assert score[toxic].mean() > 0.8 and score[~toxic].mean() < 0.1


def test_grammar():
    lexicon, grammar = toxicity.Lexicon({"idiot": 3.0, "vile*": 2.0, "you": 9.0}), toxicity.compile_grammar()

    def matched(text):
        return [{k: v for k, v in zip(toxicity.PATHS, clause) if v} for clause in toxicity.match(text, lexicon, grammar)]

    insult, threat = toxicity.INSULT, toxicity.THREAT
    assert matched("An idiot, a vileness.") == [{(insult, ""): 5.0}]
    assert matched("You are an idiot.") == [{(insult, "aimed"): 3.0}]
    assert matched("He is not an idiot. idiot") == [{(insult, "negated"): 3.0}, {(insult, ""): 3.0}]
    assert matched('"idiot" she said.') == [{(insult, "reported"): 3.0}]
    assert matched("He said: idiot! Idiot.") == [{(insult, "reported"): 3.0}, {(insult, ""): 3.0}]
    for text in ("I will kill you", "I want to murder you", "Kill them all", "we are going to really hurt him"):
        assert matched(text) == [{(threat, ""): 3.0}], text
    assert matched("I will not kill you") == [{(threat, "negated"): 3.0}]
    assert matched("she said I will kill you") == [{(threat, "reported"): 3.0}]
    # a mark without its pair quotes nothing, and a quotation ends with its line
    assert matched('A 5" pipe. You are an idiot.') == [{(insult, "aimed"): 3.0}]
    assert matched('"One\nYou are an idiot') == [{(insult, "aimed"): 3.0}]
    assert matched('"Well. You idiot," she wrote. You idiot') == [{(insult, "reported"): 3.0}, {(insult, "aimed"): 3.0}]
    assert matched("« Oh. Idiot » Idiot") == [{(insult, "reported"): 3.0, (insult, ""): 3.0}]
    assert matched("your idiot") == [{(insult, "aimed"): 3.0}]
    for text in ("kill your browser tab", "burn your own CD", "I will beat your personal best", "kill the process", "I will kill the process now, and then you rest", "the weather is fine", "you"):
        assert matched(text) == [], text


def test_composed_machine_is_its_parts_one_after_the_other():
    """Random strings of symbols: four passes over the whole string against one step a symbol."""
    moves, paths = toxicity.compile_grammar()
    parts = [(toxicity.negation, 0), (toxicity.threat, ("start", 0, frozenset())), (toxicity.reported, (False, False)), (toxicity.aimed, 0)]
    draw = random.Random(8)
    names = list(toxicity.PATHS)
    for _ in range(3000):
        word = [draw.randrange(toxicity.THREAT) for _ in range(draw.randrange(1, 14))]
        symbols = [(kind, frozenset()) for kind in word]
        for step, state in parts:
            out = []
            for symbol in symbols:
                state, made = step(state, symbol)
                out.append(made)
            symbols = out
        expected = []
        for kind, flags in symbols:
            flag = next((f for f in ("reported", "negated", "aimed") if f in flags and (kind, f) in names), "")
            expected.append(names.index((kind, flag)) if kind in (toxicity.INSULT, toxicity.THREAT) else -1)
        state, found = 0, []
        for kind in word:
            found.append(paths[state][kind])
            state = moves[state][kind]
        assert found == expected, word


def test_clause_scores():
    """Noisy-or by its definition; what a text's clauses say decides, not its words alone."""
    lexicon, grammar = toxicity.Lexicon({"idiot": 3.0}), toxicity.compile_grammar()
    scores = toxicity.Scores()
    texts = ["", "idiot", "You are an idiot. I will kill you.", "He is not an idiot.", "You are an idiot."]
    found = [toxicity.match(t, lexicon, grammar) for t in texts]
    got = scores.of(*toxicity.stacked(found), len(texts))
    for clauses, score in zip(found, got):
        clean = 1 - 1 / (1 + math.exp(-toxicity.BASE_PRIOR))
        for clause in clauses:
            a = toxicity.CLAUSE_PRIOR + sum(w * math.log1p(x) for w, x in zip(toxicity.PATHS.values(), clause))
            clean *= 1 - 1 / (1 + math.exp(-a))
        assert abs(score - (1 - clean)) < 1e-9
    assert got[2] > 0.8 > got[4] > got[1] > got[3] > got[0]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, none, F.lit(False)).collect()
    assert len({r.score for r in found}) == 1 and found[0].score < 0.05
    draw = random.Random(1)
    train = [(i, f"you {'fool' if i % 2 else 'friend'} {draw.random()}", "") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(500, 7), (501, None)], "doc_id long, toxic int")
    more = docs.unionByName(spark.createDataFrame(train, "doc_id long, text string, score string"))
    scored = toxicity.score_toxicity(more, labels, F.col("doc_id") % 5 == 0, ["doc_id"]).where("doc_id >= 4").collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored)
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(False)).count() == 0


def test_languages(spark, sf_dir):
    found = q.op4_language_id(spark, sf_dir).collect()
    truth = {r.page_id: r.d for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.regexp_extract("html", 'lang="(\\w+)"', 1).alias("d")).collect()}
    assert len(found) == len(truth) and np.mean([r.lang == truth[r.page_id] for r in found]) >= 0.98
    assert all(0 < r.confidence <= 1 + 1e-9 for r in found)


def test_text_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = langid.learn_trigrams(docs.where("doc_id % 5 <> 0"))
    model = langid.TextModel(table)
    rows = docs.where("doc_id % 5 = 0 AND n_chars > 200").collect()
    right = [langs[int(model.likelihood(r.text).argmax())] == r.lang for r in rows]
    assert np.mean(right) > 0.9


def test_languages_of_held_out_documents(spark):
    """Pages made of documents of known language that the model has not seen; a third declares another language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = {"en": "de", "de": "fr", "fr": "es", "es": "en"}
    rows = []
    for r in docs.where("doc_id % 5 = 0 AND n_chars > 200").collect():
        said = [f' lang="{wrong[r.lang]}"', f' lang="{r.lang}"', ""][r.doc_id // 5 % 3]
        rows.append((r.doc_id, f"https://h{r.doc_id % 7}.{r.lang}.example/{r.doc_id}", f"<html{said}><p>{r.text}</p></html>", r.lang))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, truth string")
    found = {r.page_id: r.lang for r in langid.identify_languages(pages, docs.where("doc_id % 5 <> 0")).collect()}
    assert np.mean([found[i] == truth for i, _, _, truth in rows]) > 0.95


def test_own_vote_is_left_out(spark):
    """A lone page on a host of its own, its text unclear, follows the others of its suffix."""
    docs = spark.createDataFrame([("the cat sat", "en"), ("der hund und die katze", "de")], "text string, lang string")
    rows = [(i, f"http://h{i}.site{i}.de/", "<p>der hund und die katze</p>") for i in range(12)]
    pages = spark.createDataFrame(rows + [(99, "http://lone.de/", "<p>at</p>"), (None, "http://lone.de/", None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in langid.identify_languages(pages, docs).collect()}
    assert found[99].text_lang == "en" and found[99].lang == "de" and found[None].lang == "de"


def test_evidence_decides_without_text(spark):
    docs = spark.createDataFrame([("the cat sat", "en"), ("der hund und die katze", "de")], "text string, lang string")
    rows = [(i, "http://a.site.de/x", '<html lang="de"><p>der hund und die katze</p>') for i in range(9)]
    rows += [(20 + i, "http://b.site.com/x", '<html lang="en"><p>the cat sat</p>') for i in range(9)]
    rows += [(90, "http://a.site.de/y", None), (91, None, ""), (92, "http://b.site.com/z", "<p>123</p>"), (92, "http://b.site.com/z", "<p>123</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    found = langid.identify_languages(pages, docs).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows) and by[90].lang == "de" and by[92].lang == "en" and by[91].host == ""
    assert by[90].text_lang is None and by[0].lang == "de"
    none = langid.identify_languages(pages, docs.limit(0)).collect()
    assert len(none) == len(rows) and none[0].lang is None
    assert langid.identify_languages(pages.limit(0), docs).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = p.quality_rules(spark, documents, sf_dir)
    bands = quality.fit_bands(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdicts = quality.compression_bands(documents, keep=["doc_id"], bands=bands).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in verdicts)
    one = p.near_dedup(spark, good, sf_dir)
    groups = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(groups)
    clean = p.decontamination(spark, one, sf_dir)
    leaks = {r.doc_id for r in decontaminate.find_leaks(one, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == groups - leaks
    mixed = p.source_mixing(spark, clean, sf_dir)
    for stage in (good, one, clean, mixed):
        assert stage.columns == documents.columns
    weights = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = mixing.mixture(clean, weights).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == wanted
    rows = p.run(spark, sf_dir).orderBy("start").collect()
    assert len(rows) == mixed.count() and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_pipeline_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    words = [f"{a}{b}" for a in "the of and to in that was his with had".split() for b in ("", "n", "ly", "er", "ing")]
    draw = random.Random(3)
    say = lambda n: " ".join(draw.choice(words) + draw.choice(words) for _ in range(n))
    long, one, two = say(40_000), say(300), say(300)
    rows = [(1, None, None), (2, "", "a"), (3, long, "a"), (3, one, "a"), (3, one, "a"), (None, one, "b"), (None, two, "b"), (4, two, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", F.lit("de").alias("lang"), F.lit(1).alias("n_chars"), *[F.lit("x").alias(c) for c in ("fp", "mark", "kept", "taken")])
    seen = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        seen[name] = sorted(((r.doc_id or 0, r.text) for r in docs.collect()))
    assert seen["quality"] == sorted((i or 0, t) for i, t, _ in rows[2:])
    assert seen["near_dedup"] == seen["decontaminate"] == sorted([(3, long), (3, one), (4, two)])
    found = p.STAGES[-1][1](spark, docs, sf_dir)
    assert found.count() == len(seen["mix"]) and p.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
