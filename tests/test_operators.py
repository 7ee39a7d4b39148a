"""Worked examples of the core's operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmur import lexicons, report
from murmur.functions import text as tx
from murmur.operators import chunking, entities, morphology, ngrams, ordering, pos, sampling, sentiment, senses, similarity
from murmur.sources import api, urls

STOP = ["the", "is", "very", "this", "at"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("OMG!!! 😍😍 This tutorial is soooo good!! https://abc.com", "omg this tutorial is soooo good"), ("end.Next don't", "endnext dont"), ("  a   b\n", "a b"), ("日本語", ""), ("", ""), (None, None)],
)
def test_clean(spark, text, expected):
    assert one(spark, text, tx.clean_text) == expected


def test_tokens(spark):
    assert one(spark, "I cannot stop, gonna watch it2 é!", tx.tokenize_full) == ["i", "can", "not", "stop", "gon", "na", "watch", "é"]
    assert one(spark, "The audio is very poor. Truly poor…\nhttps://abc.com/x", lambda t: tx.sentence_tokens(t, STOP)) == [["audio", "poor"], ["truly", "poor"], ["comx"]]
    assert one(spark, "Sarah's GPU 🎉 Ünit", tx.tokenize_named) == ["GPU", "nit"]


def test_sentiment(spark):
    lexicon = {"excellent": 1.0, "bad": -0.7, "nice": 0.6}
    rows = spark.createDataFrame([("excellent tutorial",), ("audio quality is bad",), ("nice video",), ("uploaded today",), ("",)], "text string")
    found = [r[0] for r in rows.select(sentiment.label(sentiment.polarity(tx.tokenize_full(F.col("text")), lexicon))).collect()]
    assert found == ["positive", "negative", "positive", "neutral", "neutral"]


def test_top_bigrams_of_the_example(spark):
    rows = spark.createDataFrame([("python tutorial is great",), ("this python tutorial",), ("best python tutorial. python tutorial",), ("go go go",)], "text string")
    top = ngrams.top_ngrams(rows, tx.sentence_tokens(F.col("text"), STOP), 2).collect()
    assert (top[0]["phrase"], top[0]["count"], top[0]["documents"], top[0]["share"]) == ("python tutorial", 4, 3, 100)
    assert all(r["phrase"] != "go go" for r in top)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=6), min_size=1, max_size=12), st.integers(1, 3))
def test_ngrams_like_python(spark, sentences, n):
    rows = spark.createDataFrame([(s,) for s in sentences], "s array<string>")
    got = rows.select(tx.ngrams(F.array("s"), n).alias("g")).collect()
    assert [r["g"] for r in got] == [[" ".join(s[i : i + n]) for i in range(len(s) - n + 1)] for s in sentences]


def test_index_and_sample_like_python(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    rows = spark.createDataFrame([(v, "ab"[v % 7 == 0]) for v in values], "v long, label string")
    indexed = ordering.with_index(rows, [F.col("v").desc()], partitions=5).collect()
    assert {r["v"]: r["index"] for r in indexed} == {v: 999 - v for v in values}
    expected = []
    for label in "ab":
        own = [v for v in range(1000) if "ab"[v % 7 == 0] == label]
        expected += own[:: max(1, len(own) // 125)][:125]
    assert [r[0] for r in sampling.stratified_sample(rows, "label", "v").collect()] == sorted(expected)


def test_buckets(spark):
    rows = spark.createDataFrame([(i, f"2026-01-0{1 + i % 3} 00:00:00" if i else None) for i in range(20)], "i long, at string").withColumn("at", F.try_to_timestamp("at"))
    assert {r["bucket"] for r in ngrams.time_buckets(rows, "at").collect()} == {0, 4, 7}
    got = {r["i"]: r["bucket"] for r in ngrams.corpus_buckets(rows, "at", "i").collect()}  # one time is missing
    assert got == {i: min(7, i // 2) for i in range(20)}
    same = rows.where("i in (1, 4)")
    assert {r["bucket"] for r in ngrams.time_buckets(same, "at").collect()} == {0}


def test_morphology(spark):
    lexicon = lexicons.frame(spark, [("view", "v"), ("view", "n"), ("watch", "v"), ("watch", "n"), ("video", "n"), ("amaze", "v"), ("big", "a"), ("happy", "a"), ("run", "v"), ("tutorial", "n")], "word string, pos string")
    irregular = lexicons.frame(spark, [("ran", "run", "v")], "form string, lemma string, pos string")
    words = spark.createDataFrame([(w,) for w in ["viewers", "watching", "videos", "amazing", "bigger", "happily", "ran", "zzz", "Video", None, "x1"]], "word string")
    got = {r["word"]: (r["root"], r["decomposition"], r["form"]) for r in morphology.decompose(words, lexicon, irregular).collect()}
    assert got["viewers"][1] == "view + er + s" and got["watching"][1] == "watch + ing" and got["videos"][1] == "video + s"
    assert got["amazing"][0] == "amaze" and got["bigger"] == ("big", "big + er", "Comparative") and got["ran"] == ("run", "run → ran", "Irregular")
    assert got["zzz"][0] == "zzz" and "x1" not in got and got["video"][2] == "Base form"
    forms = morphology.word_forms(spark.createDataFrame([("watch", "Noun"), ("tutorial", "Noun")], "root string, pos string"), spark.createDataFrame([("watches",), ("watched",), ("watching",), ("tutorials",)], "word string"))
    by_root = {}
    for r in forms.orderBy("root", "place").collect():
        by_root.setdefault(r["root"], []).append(r["form"])
    assert by_root == {"watch": ["watch", "watches", "watched", "watching"], "tutorial": ["tutorial", "tutorials"]}


@pytest.mark.parametrize(("base", "suffix", "form"), [("stop", "ed", "stopped"), ("study", "ies", "studies"), ("study", "ing", "studying"), ("happy", "er", "happier"), ("box", "ies", "boxes"), ("make", "ing", "making"), ("edit", "ed", "edited"), ("play", "s", "plays"), ("fix", "ed", "fixed")])
def test_affix(spark, base, suffix, form):
    assert one(spark, base, lambda b: morphology.apply_affix(b, suffix)) == form


def test_tags(spark):
    sentence = F.array(*map(F.lit, "The quick foxes jumped over it quickly #tag 12 Anna don't".split()))
    tags = spark.range(1).select(pos.tag_rules(sentence).alias("t")).first()["t"]
    assert tags == ["DT", "NN", "NNS", "VBN", "JJR", "PRP", "RB", "HT", "CD", "NNP", "RB"]
    words = F.array(*map(F.lit, "good great bad love best more also so but".split()))
    assert spark.range(1).select(pos.tag_rules(words).alias("t")).first()["t"] == ["JJ", "JJ", "JJ", "VB", "JJS", "JJR", "RB", "RB", "CC"]
    with pytest.raises(ValueError):
        pos.tag_with("none", sentence)
    pairs = pos.compared(spark.createDataFrame([(["to", "watch"],)], "t array<string>"), F.col("t"))
    assert {r["tagger"]: r["agreement"] for r in pos.agreement(pairs).collect()} == {"contextual": 100.0, "rules": 50.0, "hybrid": 100.0}


def test_chunks(spark):
    rows = spark.createDataFrame([(["the", "audio", "quality", "is", "very", "helpful"],), ([],)], "t array<string>")
    got = [[(c["type"], " ".join(c["tokens"])) for c in r["c"]] for r in rows.select(chunking.chunks(F.col("t")).alias("c")).collect()]
    assert got[0][0][0] == "NP" and got[0][-1] == ("ADJP", "very helpful") and got[1] == []


GIVEN = "sarah maria mary anne john priya".split()


def _entities(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("tokens", tx.tokenize_named(F.col("text")))
    everyday = spark.createDataFrame([(w,) for w in lexicons.everyday_words()], "word string")
    out = [[] for _ in texts]
    for r in entities.entities(rows, "tokens", dict(lexicons.GAZETTEER), GIVEN, everyday).collect():
        out[r["row_id"]].append((r["text"], r["type"], r["source"]))
    return out


def test_study_on_few_and_on_clear_texts(spark):
    rows = [(i, f"{w} {n} {i}".split(), label) for i, (w, label) in enumerate([("great fine", "positive"), ("poor dull", "negative")] * 12) for n in ["sound"]]
    frame = spark.createDataFrame(rows, "row_id long, tokens array<string>, label string")
    scores = chunking.study_scores(frame, "tokens", "label", "row_id", fractions=(1.0,), iterations=20)
    sizes = chunking.study_sizes(chunking.study_rows(frame, "tokens", "label", "row_id"))
    got = {r["feature_set"]: r for r in scores.collect()}
    assert set(got) == {"unigrams", "pos", "chunks", "combined"} and got["unigrams"]["f1"] == 1.0 and got["unigrams"]["vocabulary"] > 24
    assert chunking.study_outcome(scores, sizes).first()["reason"] is None
    few = chunking.study_scores(frame.limit(3), "tokens", "label", "row_id")
    assert few.count() == 0
    assert "few" in chunking.study_outcome(few, chunking.study_sizes(frame.limit(3).select("tokens", "label"))).first()["reason"]


def test_forms_of_a_word(spark):
    lexicon = lexicons.frame(spark, lexicons.LEXICON, "word string, pos string"), lexicons.frame(spark, lexicons.IRREGULAR, "form string, lemma string, pos string")
    assert [r["form"] for r in morphology.forms_of("watching", *lexicon).collect()] == ["watch", "watches", "watched", "watching"]
    for word, error in (("two words", ValueError), ("x1", ValueError), ("a" * 41, ValueError), ("", ValueError), ("zzyzx", LookupError)):
        with pytest.raises(error):
            morphology.forms_of(word, *lexicon)


def test_tag_text(spark):
    assert [(x["token"], x["tag"]) for x in one(spark, "The tutorial is extremely useful.", pos.tag_text)] == [("the", "DT"), ("tutorial", "JJ"), ("is", "VBZ"), ("extremely", "RB"), ("useful", "JJ")]
    assert one(spark, "", pos.tag_text) == []


def test_sections_in_one_frame_and_on_disk(spark, tmp_path):
    sections = {"a": spark.createDataFrame([(1, None)], "x int, y string"), "b": spark.range(2)}
    assert sorted(r["section"] for r in report.union(sections).collect()) == ["a", "b", "b"]
    report.export(sections, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/b")).count() == 2


def test_entities_that_must_appear(spark):
    cases = [
        ("I learned Python from this tutorial", "Python", "Technology"), ("Microsoft released a new update", "Microsoft", "Organization"), ("Dr Sarah Chen explained the model", "Dr Sarah Chen", "Person"), ("Sarah Chen uploaded this", "Sarah Chen", "Person"),
        ("We visited London and Paris last summer", "London", "Location"), ("We visited London and Paris last summer", "Paris", "Location"), ("This DaVinci Resolve tutorial is great", "DaVinci Resolve", "Product"), ("Nvidia released faster GPUs for deep learning", "GPUs", "Technology"),
        ("Acme Inc partnered with Stanford University", "Acme Inc", "Organization"), ("Acme Inc partnered with Stanford University", "Stanford University", "Organization"), ("I use Visual Studio Code", "Visual Studio Code", "Product"), ("Maria Gonzalez made this", "Maria Gonzalez", "Person"), ("my iPhone broke", "iPhone", "Product"),
    ]
    for found, (text, name, kind) in zip(_entities(spark, [c[0] for c in cases]), cases, strict=True):
        assert (name, kind) in [f[:2] for f in found], (text, found)


def test_sentences_without_entities(spark):
    clean = [
        "Monday I watched this", "The Tutorial Is Great", "I Bought This Yesterday", "Best Tutorial Ever", "Please Fix The Export", "This Is A Test Comment", "Thanks For The Video", "Really Good Explanations", "Fresh From The Room", "Please Subscribe To The Channel",
        "First Video Here", "To Be Honest", "In My Opinion", "my microphone sounds great", "i had apple pie for dessert", "the bank should improve its mobile app", "", "   ",
    ]
    assert _entities(spark, clean) == [[] for _ in clean]


def test_name_patterns(spark):
    one, two = _entities(spark, ["Sarah Chen uploaded this", "Mary Anne made this"])
    assert ("Sarah Chen", "Person", "name-pattern") in one and all(f[2] != "name-pattern" for f in two)


def test_both_readings_of_a_bank(spark):
    rows = spark.createDataFrame([(0, "The bank should improve its mobile app"), (1, "The video shows people sitting near the river bank"), (2, "please show the keyboard shortcuts for windows")], "row_id long, text string")
    table = lexicons.frame(spark, lexicons.SENSES, "word string, rank int, sense string, gloss string, cues string")
    found = senses.contexts(rows, tx.tokenize_full(F.col("text")), sorted({s[0] for s in lexicons.SENSES}))
    best = {(r["row_id"], r["target"]): r["sense"] for r in senses.sense_scores(found, table).where("place = 1").collect()}
    assert best[0, "bank"] == "bank.depository" and best[1, "bank"] == "bank.slope" and best[2, "window"] == "window.screen"


def _grouped(spark, texts):
    rows = spark.createDataFrame([(i, "v", t) for i, t in enumerate(texts)], "id long, video string, text string")
    members = similarity.group_similar(rows, similarity.folded_features(tx.tokenize_full(F.col("text")), ["the", "is", "was", "i", "it", "very", "about"]), "video", "id")
    return similarity.merge_groups(members, "video", "id").collect()


def test_groups(spark):
    got = _grouped(spark, ["audio quality is poor", "", "the audio quality was terrible", "audio quality is very bad", "   "])
    assert [(r["label"], r["size"]) for r in got] == [("Audio Quality", 3)] and got[0]["cohesion"] > 0
    got = _grouped(spark, ["audio quality is poor", "audio quality is bad", "pricing page broken"])
    assert [r["size"] for r in got] == [2]
    assert _grouped(spark, ["ok then"]) == []


def test_greedy_work_is_bounded_and_keeps_all(spark):
    rows = spark.createDataFrame([(i, "v", f"kettle number {'abcdefgh'[i % 8]} lamp") for i in range(400)], "id long, video string, text string")
    members = similarity.group_similar(rows, tx.tokenize_full(F.col("text")), "video", "id", block=50)
    assert members.count() == 400 and members.groupBy("block").count().agg(F.max("count")).first()[0] == 50


def test_rows_of_opinions_only_form_groups(spark, tmp_path):
    got = _grouped(spark, ["great", "I love it", "bad", "", "terrible, very bad", "awful", "the kettle was good", "best"])
    assert {r["label"]: r["size"] for r in got} == {"Good": 3, "Bad": 3}
    from murmur.streaming import comments

    spark.createDataFrame([(i, "v", t) for i, t in enumerate(["great", "bad", "", "love", "kettle good", "worst"])], "row_id long, video string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = comments.drain(comments.grouped(comments.read_stream(spark, f"{tmp_path}/t"), similarity.folded_features(tx.tokenize_full(F.col("text")), []), "video", "row_id"), "append").collect()
    groups = {r["row_id"]: r["group"] for r in rows}
    assert set(groups) == {0, 1, 3, 4, 5} and groups[0] == groups[3] and groups[1] == groups[5] and len(set(groups.values())) == 3


def test_redundancy_of_discussions(spark, tmp_path, empty_tables):
    from murmur.plans import meaning
    from tests.conftest import write_tables

    texts = ["audio quality is poor", "the audio quality was terrible", "audio quality very bad", "kettle lamp", "kettle lamp", "pricing page", "  ", None]
    comments = [(i, 1, i, "v", "a", t, 0, None, None) for i, t in enumerate(texts)]
    folder = write_tables(spark, tmp_path / "t", {"comments": comments, "polarity": [("poor", -0.9), ("terrible", -0.9), ("bad", -0.9)], "stop_word": [(w,) for w in ("the", "is", "was", "very")]})
    sizes = [3, 2]
    (row,) = meaning.redundancy(spark, folder).collect()
    assert row.asDict() == {"grouped": sum(sizes), "groups": len(sizes), "redundant": sum(sizes) - len(sizes), "compression": 50.0, "redundant_pairs": sum(n * (n - 1) // 2 for n in sizes)}
    got = {r["label"]: (r["size"], r["sentiment"], r["positive"], r["neutral"], r["negative"]) for r in meaning.discussion_sentiment(spark, folder).collect()}
    assert got == {"Audio Quality": (3, "negative", 0, 0, 3), "Kettle Lamp": (2, "neutral", 0, 2, 0)}
    assert report.SECTIONS["redundancy"] == "redundancy"
    assert [r["grouped"] for r in meaning.redundancy(spark, empty_tables).collect()] == [0]


def test_blocks_give_the_groups_of_one_pass(spark):
    rng = random.Random(8)
    topics = [[f"{'abcdefgh'[t]}{'klmnop'[w]}x" for w in range(6)] for t in range(8)]
    rows = spark.createDataFrame([(i, "v", rng.sample(topics[rng.randrange(8)], 4)) for i in range(300)], "id long, video string, f array<string>")
    parts = []
    for size in (10_000, 40):
        groups = {}
        for r in similarity.group_similar(rows, F.col("f"), "video", "id", block=size).collect():
            groups.setdefault(r["grp"], []).append((r["id"], round(r["cohesion"], 9)))
        parts.append(sorted(sorted(g) for g in groups.values()))
    assert parts[0] == parts[1] and len(parts[0]) == 8


def test_similar_pairs_like_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    bags = [[rng.choice(words[: 5 + i % 25]) for _ in range(rng.randint(1, 6))] for i in range(120)]
    rows = spark.createDataFrame(list(enumerate(bags)), "row_id long, f array<string>")
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.similar_pairs(rows, F.col("f")).collect()}
    import math
    from collections import Counter

    reps = {}
    for i, b in enumerate(bags):
        reps.setdefault(tuple(sorted(b)), i)
    df = Counter(t for b in reps for t in set(b))
    vectors = {}
    for b, i in reps.items():
        v = {t: (1 + math.log(c)) * (math.log((1 + len(reps)) / (1 + df[t])) + 1) for t, c in Counter(b).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    expected = {(a, b) for a in vectors for b in vectors if a < b and round(sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()), 6) >= 0.8}
    assert set(got) == expected and expected


def shuffled(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    metric = plan.metrics().get("shuffleRecordsWritten")
    return (metric.get().value() if metric.isDefined() else 0) + sum(map(shuffled, below))


def test_similar_pairs_write_no_candidates(spark):
    """The rarest term of 900 texts is one that all of them have, which makes 404,550 candidates, and few are similar."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    bags = [["rare", *rng.sample(words, 7)] for _ in range(900)] + [[f"a{i}", f"b{i}", f"c{i}", *rng.sample(words, 20)] for i in range(1800)]
    bags += [[*bags[i], bags[i][1]] for i in range(20)]
    found = similarity.similar_pairs(spark.createDataFrame(list(enumerate(bags)), "row_id long, f array<string>"), F.col("f"))
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert {(i, 2700 + i) for i in range(20)} <= got and len(got) < 500
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 300_000


@pytest.mark.parametrize("step, gain, deep, least", [(1 << 17, 4, 3, 0.8), (64, 0, 1, 0.8), (64, 0.1, 5, 0.6), (7, 0, 2, 0.95), (1 << 17, 0, 2, 0.4)])
def test_pairing_like_brute_force(monkeypatch, step, gain, deep, least):
    import numpy as np
    import pyarrow as pa

    from murmur.operators import pairing

    for name, value in {"STEP": step, "GAIN": gain, "DEEP": deep, "MOST": 500 * deep, "ROWS": 30, "TERMS": 300}.items():
        monkeypatch.setattr(pairing, name, value)
    rng = np.random.default_rng(step + deep)
    terms = [np.sort(rng.choice(12 + 300 * (i % 2), rng.integers(1, 12 if i % 9 else 150 if i % 2 else 12), replace=False)) for i in range(260)]
    weights = [rng.uniform(0.2, 3, len(t)) * (1 + 4 * (rng.random(len(t)) < 0.1)) for t in terms]
    for i in range(60):
        terms.append(terms[i])
        weights.append(weights[i] * rng.uniform(0.8, 1.25, len(terms[i])))
    weights = [w / np.sqrt(w @ w) for w in weights]
    dense = np.zeros((len(terms), 312))
    for row, t, w in zip(dense, terms, weights, strict=True):
        row[t] = w
    dots = dense @ dense.T
    expected = {(f"t{x}", f"t{y}"): dots[x, y] for x in range(len(terms)) for y in range(x + 1, len(terms)) if dots[x, y] >= least}
    rows = pa.record_batch({"id": [f"t{i}" for i in range(len(terms))], "terms": pa.array(terms, pa.list_(pa.int32())), "weights": pa.array(weights, pa.list_(pa.float64()))})
    keyed = pa.Table.from_batches(pairing.prefixes(least)([rows.slice(0, 100), rows.slice(100)])).sort_by("key")
    got = [r for batch in pairing.met(least)(iter(keyed.combine_chunks().to_batches(max_chunksize=11))) for r in batch.to_pylist()]
    got = {tuple(sorted((r["x"], r["y"]), key=lambda t: int(t[1:]))): r["dot"] for r in got if r["dot"] >= least} if len(got) == len({frozenset((r["x"], r["y"])) for r in got}) else None
    assert got is not None and got.keys() == expected.keys() and len(got) >= 40
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_senses(spark):
    table = lexicons.frame(spark, [("bank", 1, "bank.money", "a depository for money", "app account transfer"), ("bank", 2, "bank.river", "sloping land beside water", "river fishing grass")], "word string, rank int, sense string, gloss string, cues string")
    rows = spark.createDataFrame([(1, "my bank app lost the account"), (2, "we sat on banks of the river fishing"), (3, None), (4, "")], "row_id long, text string")
    found = senses.contexts(rows.where("text is not null"), tx.tokenize_full(F.col("text")), ["bank"])
    best = {r["row_id"]: r["sense"] for r in senses.sense_scores(found, table).where("place = 1").collect()}
    assert best == {1: "bank.money", 2: "bank.river"}


def test_urls(spark):
    cases = {"https://youtu.be/abcdef12/x": "abcdef12", "https://www.youtube.com/watch?a=b&v=abc_def-1": "abc_def-1", "https://evil.com/?v=abcdef": None, "not a url": None, "https://youtu.be/ab": None, None: None}
    for url, expected in cases.items():
        assert one(spark, url, urls.video_id) == expected


def test_api_source(spark):
    api.register(spark)
    rows = spark.read.format("video_comments").option("video_ids", "v1,none,v2").option("max_results", "120").option("transport", "tests.pages:fetch").load()
    assert {r["video_id"]: r["count"] for r in rows.groupBy("video_id").count().collect()} == {"v1": 120, "v2": 120}
    first = rows.where("video_id = 'v1' and position = 0").first()
    assert first["author"] == "Anonymous" and first["published_at"] is None


def test_report(spark, odd_tables):
    import json

    sections = report.analyze_comments(spark, odd_tables, ("metrics", "sentiment", "bigrams", "entities", "senses"))
    assert json.loads(report.document(sections))["metrics"][0]["comments"] == 51
