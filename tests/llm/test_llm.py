"""The corpus operators: against brute force, exact round trips, held-out accuracy, and odd and empty tables."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import abuse, capping, confusables, frequency, leakage, pii, pii_training, queries, splitting, sql, tokens
from tests.conftest import SMALL, connect, same

vocabulary = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, odd_tables, name):
    frame = queries.QUERIES[name](spark, odd_tables)
    if name in sql.SQL:
        same(frame, connect(odd_tables), sql.SQL[name])
    else:
        frame.collect()


def test_capping_like_brute_force_with_a_dominant_author(spark):
    rng = random.Random(3)
    rows = [(i, "abc"[i % 3], "hot" if rng.random() < 0.6 else rng.choice(["x", "y", None, "Anonymous", " HOT "]), rng.choice([None, 1, 2, 3]), "extra") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, video string, author string, likes long, `__key` string")
    got = capping.cap_contributors(frame, capping.contributor_key(F.col("author")), F.coalesce("likes", F.lit(0)), [F.col("id")], within=["video"], max_count=7, partitions=9).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"id", "video", "author", "likes", "__key", "position", "kept"}
    groups = {}
    for i, video, author, likes, _ in rows:
        key = " ".join(author.lower().split()) if author else None
        if key and key != "anonymous":
            groups.setdefault((video, key), []).append((-(likes or 0), i))
    expected = {i: n + 1 for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
    assert {r["id"]: r["position"] for r in got if r["position"] is not None} == expected
    assert all(r["kept"] == (r["position"] is None or r["position"] <= 7) for r in got)
    share = capping.cap_contributors(frame, capping.contributor_key(F.col("author")), F.col("likes"), [F.col("id")], max_count=None, max_share=0.1).where("kept and position is not null")
    assert share.groupBy(capping.contributor_key(F.col("author"))).count().agg(F.max("count")).first()[0] == 300


def test_skeleton():
    assert confusables.skeleton("Ｂеѕt​ ﬂat é") == confusables.skeleton("Best flat é")
    assert confusables.skeleton("a²") == "a²" and confusables.skeleton(None) is None and confusables.skeleton("") == ""
    assert confusables.skeleton("e") != confusables.skeleton("é") and confusables.shown("café") == "café"


def test_pairs_like_brute_force(spark):
    texts = ["abc", "ａbc", "abc", "a​bc", "Abc", "", " ", "​", None, "éa", "éa"] + ["hot"] * 40 + ["hоt"] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    seen = [t is not None and bool(confusables.skeleton(t).strip()) for t in texts]
    alike = lambda a, b: seen[a] and seen[b] and confusables.skeleton(texts[a]) == confusables.skeleton(texts[b])
    expected = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(a, b) and texts[a] != texts[b]}
    got = [(r[0], r[1]) for r in confusables.look_alike_pairs(frame, block=4).collect()]
    assert set(got) == expected and len(got) == len(expected)
    classes = {r[0]: tuple(r[1:]) for r in confusables.look_alike_classes(frame).collect()}
    assert set(classes) == {k for k, s in enumerate(seen) if s}
    for k, (first, forms, links) in classes.items():
        group = [j for j in range(len(texts)) if alike(j, k)]
        assert (first, forms, links) == (group[0], len({texts[j] for j in group}), sum(texts[j] != texts[k] for j in group))


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(["ann", "mark", "may", "rose"], pii_training.fit())


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Contact: ann-lee@mail.example today", {"email"}), ("write to annlee at inbox dot test", {"email"}), ("Call me on (525) 555-0139 about it", {"phone"}), ("my number is five two five five five five zero one three nine", {"phone"}),
        ("they need my SSN 000 58 1211 now", {"id_number"}), ("Parcel for 425 Harrow Lane, Tessing never came.", {"address"}), ("Big thanks to Ann Halderwick for this", {"name"}), ("ＡＮＮ ＨＡＬＤＥＲＷＩＣＫ was here", {"name"}),
        ("Ticket number 8502246652 went through.", set()), ("ann would love it", set()), ("Drive it down lane 5 of the track.", set()), ("At 18:21@normal speed it is fine.", set()), ("", set()), (None, set()), ("x" * 5000, set()),
    ],
)
def test_personal_information(finder, text, kinds):
    assert {s.kind for s in finder.find(text)} == kinds


def test_redaction_keeps_the_rest(finder):
    assert finder.redact("Hi there,  call (525) 555-0139 please\nbye") == ("Hi there,  call <PHONE> please\nbye", ["phone"])
    assert finder.redact(None) == (None, []) and finder.redact("") == ("", [])
    # places are those of the text as stored, also where characters are replaced or invisible
    text = "ｃａｌｌ (５２５) 555\u200b-0139 ok"
    assert finder.redact(text) == ("ｃａｌｌ <PHONE> ok", ["phone"])


def test_decoding_is_the_best_of_all_sets():
    rng = random.Random(2)
    for _ in range(60):
        follow = np.array([[0.0 if a == b == 0 else rng.uniform(-1, 1) for b in range(3)] for a in range(3)])
        spans = [(a := rng.randrange(12), a + rng.randint(0, 3), rng.randint(1, 2), rng.uniform(-1, 2)) for _ in range(7)]
        spans = list({s[:3]: s for s in spans}.values())

        def value(chosen, follow=follow):
            at, last, out = 0, 0, 0.0
            for a, b, k, score in chosen:
                if a > at:
                    out, last = out + follow[last, 0], 0
                out, at, last = out + follow[last, k] + score, b + 1, k
            return out + (follow[last, 0] if at < 16 else 0.0)

        best = 0.0
        for mask in range(1 << len(spans)):
            chosen = sorted(s for i, s in enumerate(spans) if mask >> i & 1)
            if all(a[1] < b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, value(chosen))
        found = pii.decode(spans, follow, 16)
        scores = {s[:3]: s[3] for s in spans}
        assert abs(value([(*f, scores[f]) for f in found]) - best) < 1e-9


def test_leaving_spans_out_changes_no_reading(finder):
    texts = [t for t, _ in pii_training.Composer(5).sentences(60)]
    model = finder.model
    for text in texts:
        batch = pii.Batch([text], pii._Rows(finder.lists))
        kept = list(zip(*(x.tolist() for x in pii.scored(batch, model)), strict=True))
        every = []
        for k, kind in enumerate(pii.KINDS, 1):
            i, j, shape = batch.spans(kind, 0, batch.n)
            score = sum(model.weights[p].astype(float) for p in batch.placed(kind, batch.features(kind, i, j, shape))) if len(i) else np.zeros(0)
            every += list(zip(i.tolist(), j.tolist(), [k] * len(i), score.tolist(), strict=True))
        end = int(batch.stop[0])
        assert (pii.decode(kept, model.follow, end) if kept else []) == (pii.decode(every, model.follow, end) if every else [])


def test_held_out_sentences(finder):
    sentences = list(pii_training.Composer(77).sentences(800))
    found = finder.find_all([t for t, _ in sentences])
    right = sum({s.kind for s in f} == {k for _, _, k in gold} for f, (_, gold) in zip(found, sentences, strict=True))
    assert right / len(sentences) > 0.92


#: Family names and sentences that the training has not.
FAMILIES = "zhou-ferris castellano obrecht takahara vukasin etxeberria abdi kapoor ramaswamy chukwu wickremesinghe nakashima delacroix quiroga bassett pomeroy whitlock trujillo abebe sissoko haugland raimondi zubiri ogunbanjo ferreyra lindqvister okonkwo mitsotakis sarkozi blackadder".split()
SENTENCES = ["The prize went to {} this year", "{} plays the cello", "Yesterday {} told us why", "Wrote it together with {}.", "{}", "Kind regards, {}"]
PLAIN = ["the ann effect", "Ann walked home", "ann, are you there", "Mark every second page", "May flowers grow", "then Ann smiled at us", "A pair of ruby slippers", "Golden Turnip", "rose petals everywhere", "I told ann yesterday", "Old barns collapse in heavy snow", "Wir haben gestern lange gewartet"]


def test_families_outside_the_training(finder):
    assert not set(FAMILIES) & set(pii_training.FAMILIES)
    names = [s.format(f"Ann {f.title()}") for f in FAMILIES for s in SENTENCES]
    found = sum({s.kind for s in finder.find(t)} == {"name"} for t in names)
    lower = sum({s.kind for s in finder.find(t.lower())} == {"name"} for t in names)
    wrong = [t for t in PLAIN if finder.find(t)]
    print(f"found {found}, in lower case {lower}, of {len(names)}; wrong {wrong}")
    assert found >= 0.9 * len(names) and lower >= 0.6 * len(names) and len(wrong) <= 2


#: Sentences written by hand, apart from the training and from the tables, with what they hold.
HAND_WRITTEN = [
    ("Signed, John Smith", "name"), ("My name is Priya Patel", "name"), ("Regards, David Cohen", "name"), ("Wei Zhang", "name"), ("Fatima Hassan", "name"), ("John O'Brien", "name"), ("Regards, Maria García", "name"), ("The lecture was given by Thomas Edgeworth last May", "name"), ("has anyone heard from michael okafor?", "name"), ("ask SANDRA LOPEZ about the keys", "name"), ("Could Helen Fairbrother call the nurse back", "name"), ("Die Rede hielt Katrin Seidel.", "name"), ("Credit: Robert van der Merwe", "name"), ("George R. Whitaker wrote the manual", "name"), ("props to Elena Petrova for the translation", "name"), ("Nguyen's boss, Samuel Adebayo, quit", "name"),
    ("You can email us via support@acme-tools.com whenever", "email"), ("ping bob_1990 (at) yahoo (dot) com", "email"), ("newsletter: sign-up+spring@city.gov.uk", "email"), ("jane dot doe at gmail dot com", "email"), ("HR is HR.TEAM@BIGCORP.ORG", "email"), ("forwarded by l.meyer@uni-heidelberg.de on Monday", "email"),
    ("My cell: 415-555-2671", "phone"), ("ring +44 20 7946 0958 after lunch", "phone"), ("Call 020 7946 0958", "phone"), ("Tel. 030/1234567", "phone"), ("(212) 555 0187 is the desk", "phone"), ("text 07700 900123 for tickets", "phone"), ("whatsapp +91 98765 43210", "phone"), ("Appelez-moi au 06 12 34 56 78", "phone"), ("dial one eight hundred five five five zero one nine nine", "phone"), ("1-800-555-0199 ext. 12", "phone"),
    ("my SSN is 078-05-1120", "id_number"), ("NHS 943 476 5919", "id_number"), ("Passport number: 533401372", "id_number"), ("her passport no. is K1234567", "id_number"), ("NI number QQ 12 34 56 C was rejected", "id_number"), ("DNI 12345678Z caducado", "id_number"), ("CPF: 123.456.789-09", "id_number"), ("driver's license D1234567 suspended", "id_number"), ("PESEL 44051401359", "id_number"), ("Steuer-ID 12 345 678 901", "id_number"),
    ("12 Acacia Grove", "address"), ("14 Broadway, Boston", "address"), ("They live at 221B Baker Street, London", "address"), ("ship it to 1600 Pennsylvania Avenue, Washington, DC 20500", "address"), ("Lindenstraße 12, 10969 Berlin", "address"), ("au 8 rue de la Paix, 75002 Paris", "address"), ("Calle Mayor 15, Madrid", "address"), ("house no longer stands at 77 Chapel Hill Road", "address"), ("Flat 3, 45 Gordon Square, London", "address"), ("turn left at 9 Elm Ct", "address"),
    ("The 2019 report lists 45 items on page 12", ""), ("Saturday 14:30 works, room 5", ""), ("It costs 1,299.99 or 30% less", ""), ("Version 10.0.19045 crashed", ""), ("Thanks everyone, great stream", ""), ("New York is loud", ""), ("I love Adobe Premiere", ""), ("Order 11-45821 shipped", ""), ("Anna laughed", ""), ("we scored 3-2 in the 88th minute", ""), ("Monday Night Football", ""), ("the White House lawn", ""), ("@coolgamer99 lol", ""), ("Lots of people at the street fair", ""), ("two or three more weeks", ""), ("1920x1080 at 60 fps", ""),
]


def test_hand_written_sentences(finder):
    held = [(t, k) for t, k in HAND_WRITTEN if k]
    missed = [(t, k) for t, k in held if {s.kind for s in finder.find(t)} != {k}]
    wrong = [(t, finder.find(t)) for t, k in HAND_WRITTEN if not k and finder.find(t)]
    print(f"{len(held) - len(missed)} of {len(held)}; missed {missed}; wrong {wrong}")
    assert len(missed) <= 0.1 * len(held) and len(wrong) <= 2


def test_numbers_in_long_runs(finder):
    run = " ".join(map(str, range(1, 40)))
    for text in (f"{run} +1 (525) 555-0139", f"+1 (525) 555-0139 {run}", f"{run} +1 (525) 555-0139 {run}"):
        at = text.index("+1 (525)")
        assert any(a < at + 17 and b > at for a, b, k in finder.find(text) if k == "phone")


def test_rows_of_personal_information(spark):
    rows = [(1, "Call 415-555-2671 or mail jo@inbox.example", "Ann Whitfield"), (2, "My SSN is 078-05-1120. Regards, John Smith", None), (3, "nice video", "annie99"), (4, None, ""), (5, "Call 415-555-2671, or 415-555-2672", "jo@inbox.example")]
    frame = spark.createDataFrame(rows, "row_id long, text string, author string")
    found = pii.personal_information(frame, spark.createDataFrame([("ann",), (None,)], "word string"))
    assert found.columns == ["row_id", "field", "kind"] and dict(found.dtypes)["field"] == "string"
    assert sorted(map(tuple, found.collect())) == [(1, "author", "name"), (1, "text", "email"), (1, "text", "phone"), (2, "text", "id_number"), (2, "text", "name"), (5, "author", "email"), (5, "text", "phone")]
    assert pii.personal_information(frame.limit(0), None).collect() == []


def test_habits_come_from_the_texts(spark):
    texts = ["Thanks Ann Corvitzel", "ann dorvitzel said so", "Ann Pelvitzel", "by Ann Mervitzel", "Ann Zovitzel here", "Zelda Corvitzel", "my blue teapotte", "A teapotte"] + ["Der Umbau ist da, der umgebaut war"] * 20
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "row_id long, text string, author string")
    endings, common, familiar = pii.word_habits(frame, ["ann"], ("text", "author"))
    assert endings == ["tzel"] and "umbau" in familiar and "umbau" not in common and "umgebaut" in common and "corvitzel" not in familiar
    assert ("name" in {r["kind"] for r in pii.personal_information(frame, spark.createDataFrame([("ann",)], "word string")).where("row_id = 5").collect()})


def test_term_counts_like_python(spark):
    texts = ["b a b", "", None, "Ünder ünder 12 a_b", "a " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequency.term_frequencies(frame, common_share=0.6).collect()}
    assert got == {"b": (3, 2, "rare"), "a": (3002, 3, "common"), "ünder": (2, 1, "rare")}
    assert frequency.term_relevance(frame).where("term = 'ünder'").first()["tf"] == 2


def test_abuse_learns_and_ranks():
    rng = random.Random(4)
    good = [f"the {rng.choice(['lamp', 'intro', 'audio', 'kettle'])} is {rng.choice(['fine', 'clear', 'trash', 'dull'])} number {i}" for i in range(400)]
    bad = [f"shut your mouth you {rng.choice(['fool', 'clown', 'moron'])}, {rng.choice(['nobody asked', 'go away'])}" for _ in range(60)]
    bias, weights = abuse.fit([(t, 0) for t in good[:300]] + [(t, 1) for t in bad[:45]])
    table = abuse.dense(weights)
    score = lambda t: abuse.scores([t], bias, table)[0]
    texts = [*good, None, "", *bad, "x y"]
    assert np.array_equal(abuse.scores(texts, bias, table), [score(t) for t in texts])
    assert min(map(score, bad[45:])) > 0.5 > max(map(score, good[300:]))
    assert score("Shut your mouth you c l o w n") > 0.5 and score("ѕhut yоur mоuth you m0r0n") > 0.5 and score(None) == score("") == score(" \n") == 0.0
    assert len(weights) < 3000


@vocabulary
def test_encoding_is_the_vocabularys_own():
    import tiktoken

    encoder = tokens.worker_encoder(tokens.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    texts = ["", None, "a", "Hello  world", " lead", "tail ", "a\n\nb \n c\t d", "aaaa" * 200, "日本語 текст é é", "<|endoftext|> x", "x y   z", "👩🏽‍💻 ok", "it's we'll 12.5%", "\x00\x01", "nonono " * 3000, "x" * 5000, "".join(random.Random(1).choice("abcdeno") for _ in range(4000)), "日本語" * 900, "".join(random.Random(2).choice("etaoin") for _ in range(400))]
    got = [[t for piece in ids for t in piece] for _, ids in encoder.encode_spans(texts)]
    assert got == [own.encode_ordinary(t or "") for t in texts]


@vocabulary
def test_pieces():
    splitter = splitting.Splitter(tokens.VOCABULARY, 60, 10)
    texts = ["One sentence here. Another one follows, with a clause.\n\nA paragraph. " * 40, "word " * 500, "日本語のテキスト" * 60, "x" * 3000, "short", "👩🏽‍💻" * 80]
    for text, (parts, ids) in zip(texts, list(splitter.encoder.encode_spans(texts)), strict=True):
        flat = [t for piece in ids for t in piece]
        pieces = splitter.split(parts, ids)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(flat)
        assert all(0 < b - a <= 60 for a, b in pieces)
        assert all(10 <= p[1] - q[0] <= 13 for p, q in zip(pieces, pieces[1:], strict=False))
        joined = b""
        for n, (a, b) in enumerate(pieces):
            piece = b"".join(splitter.bytes_of[t] for t in flat[a:b])
            piece.decode()  # no character is cut in two
            joined += b"".join(splitter.bytes_of[t] for t in flat[a if n == 0 else pieces[n - 1][1] : b])
        assert joined.decode() == text
    first = splitter.split(*list(splitter.encoder.encode_spans(texts[:1]))[0])
    flat = [t for piece in list(splitter.encoder.encode_spans(texts[:1]))[0][1] for t in piece]
    ends = [b"".join(splitter.bytes_of[t] for t in flat[:b]).decode().rstrip()[-1] for _, b in first[:-1]]
    assert ends.count(".") >= 0.9 * len(ends)


@vocabulary
def test_paragraphs_before_lines_and_wide_stops():
    for span, kinds in (("para.\n\nNext", [splitting.PARAGRAPH]), ("para.\nNext", [splitting.LINE])):
        marks = splitting.Splitter(tokens.VOCABULARY, 60, 10).marks
        marks[span]
        assert [p for _, p in marks.inner[span] if p <= splitting.LINE] == kinds
    marks["日本。語のテ！キスト"]
    assert [p for _, p in marks.inner["日本。語のテ！キスト"]].count(splitting.SENTENCE) == 2
    splitter = splitting.Splitter(tokens.VOCABULARY, 60, 10)
    text = "\n\n".join("\n".join(f"line {k} of some words here" for k in range(6)) for _ in range(8))
    ((parts, ids),) = splitter.encoder.encode_spans([text])
    flat = [t for piece in ids for t in piece]
    cuts = [b"".join(splitter.bytes_of[t] for t in flat[:b]).decode() for _, b in splitter.split(parts, ids)[:-1]]
    assert cuts and all(c.endswith("\n\n") for c in cuts)


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for round_ in range(60):
        total, limit, overlap = int(rng.integers(21, 90)), int(rng.integers(14, 21)), int(rng.integers(0, 5))
        planner = splitting.Planner(limit, overlap)
        pen = rng.choice([0.0, 0.5, 1.0, 3.0, 6.0, 20.0], total + 1)
        pen[rng.random(total + 1) < 0.1] = np.inf
        more = rng.integers(0, 4, total + 1) if round_ % 2 else np.zeros(total + 1, np.int64)
        price = lambda size, limit=limit: splitting.BALANCE * ((limit - size) / limit) ** 2 if size <= limit else np.inf

        @functools.cache
        def best(cut, total=total, overlap=overlap, planner=planner, pen=tuple(pen), more=tuple(more)):
            """The least cost of all that follows a cut."""
            extra = overlap + more[cut] if cut else 0
            out = price(total - cut + extra)
            for end in range(max(cut + planner.least, overlap + 1), total):
                if (here := price(end - cut + extra) + pen[end]) < np.inf:
                    out = min(out, here + best(end))
            return out

        if best(0) == np.inf:
            continue
        cost, last = 0.0, 0
        for c in planner.plan(pen, more):
            cost += price(c - last + (overlap + more[last] if last else 0)) + (pen[c] if c < total else 0.0)
            last = c
        assert last == total and abs(cost - best(0)) < 1e-9


def test_few_cuts_are_priced():
    rng = np.random.default_rng(2)
    planner = splitting.Planner(512, 64)
    for uneven in (False, True):
        priced = []
        for _ in range(200):
            penalties = rng.choice([1.0, 3.0, 6.0, 20.0], planner.step, p=[0.05, 0.05, 0.7, 0.2])
            before = np.linspace(2, 3, planner.step) + penalties
            before[rng.random(planner.step) < 0.1 * uneven] = np.inf
            grown = rng.integers(0, 4, planner.step) * uneven
            prices = planner.turned[grown, np.arange(planner.step)] + before[:, None]
            kept = planner.worth(before, uneven)
            assert np.array_equal(prices[kept].min(axis=0), prices.min(axis=0))
            priced.append(len(kept))
        assert np.mean(priced) < planner.least / 2
    flat = np.full(planner.step, 6.0)
    for uneven in (False, True):
        grown = rng.integers(0, 4, planner.step) * uneven
        prices = planner.turned[grown, np.arange(planner.step)] + flat[:, None]
        kept = planner.worth(flat, uneven)
        assert np.array_equal(prices[kept].min(axis=0), prices.min(axis=0)) and len(kept) < planner.least + 9


def test_leaks_like_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(15)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        body = [rng.choice(words) for _ in range(30)]
        if d % 3 == 0:
            held = items[d % 15][1].split()
            body[10:10] = held[rng.randint(0, 4) :][: rng.choice([9, 10, 12])]
        docs.append((d, ", ".join(w.upper() if rng.random() < 0.3 else w for w in body)))
    docs += [(100, None), (101, ""), (102, "-".join(items[0][1].split()).replace("w", "ｗ"))]
    documents, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]) for r in leakage.find_leaks(documents, held).collect()}
    expected = set()
    for d, text in docs:
        have = leakage.plain_words(text) if text else []
        grams = {tuple(have[i : i + 10]) for i in range(len(have) - 9)}
        expected |= {(d, i) for i, t in items if t and any(tuple(leakage.plain_words(t)[k : k + 10]) in grams for k in range(len(t.split()) - 9))}
    assert got == expected and (102, 0) in got
    # beyond the size of one search table, and with ids of another type
    assert {(r[0], r[1]) for r in leakage.find_leaks(documents, held, most_words=50).collect()} == expected
    named = leakage.find_leaks(documents, held.withColumn("item_id", F.concat(F.lit("i"), "item_id")))
    assert {(r[0], int(r[1][1:])) for r in named.collect()} == expected


@pytest.mark.skipif(not SMALL.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found"])
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, str(SMALL)), connect(SMALL), sql.SQL[name])
