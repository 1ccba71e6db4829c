"""Small cases that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from somnotab.llm import archive, contamination, language, mixing, pii, shards, simhash, storage, substrings, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, k1 long, shard int, label int"
PASSAGE = " ".join(f"palabra{i}" for i in range(40))


def documents(spark, rows):
    full = [(i, t, lang, s, None, 7, "x", 1, 3, 0) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None, None, None),
    (2, "", "en", ""),
    (3, " \t\n ", "en", "a"),
    (4, "one", "en", "a"),
    (4, "one", "en", "a"),
    (None, "two words", None, None),
    (None, None, "es", None),
    (5, PASSAGE + " fin", "es", "b"),
    (6, "principio " + PASSAGE, "es", "b"),
    (7, "x " * 30_000 + "y" * 100_000, "en", "b"),
    (8, "!!! 123 ...", None, "é"),
]


def test_personal_data_hidden(spark):
    cases = {
        "plain jo.doe@example.com here": ["email:6:24"],
        "write to bob [at] example [dot] com now": ["email:9:35"],
        "write bob at example dot com now": ["email:6:28"],
        "look at example.com and polka dot dresses": [],
        "call plus one four one five five five five two six seven one please": ["phone:5:60"],
        "host １０.0.0.1 up": ["ip:5:13"],
        "mail аnna@example.com": ["email:5:21", "email:6:21"],
        "card 4111 1111 1111 1111 ok": ["card:5:24"],
        "card 4111​1111​1111​1111 ok": ["card:5:24"],
        "card 4111 1111 1111 1112": [],
        "300.1.1.1 and 1.2.3.4.5.6.7.8": ["ip:14:21", "ip:22:29"],
    }
    for text, want in cases.items():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.spans_of(text)] == want, text
    assert pii.spans_of("1" * 200_000 + "@" + " " * 200_000 + "+" * 50_000) == []
    rows = pii.report(pii.find(documents(spark, ODD))).collect()
    assert len(rows) == len(ODD) and all(r["n_email"] == 0 for r in rows)


def test_shards_rebalance():
    rng = random.Random(3)
    loads = [rng.randint(0, 90) ** 2 for _ in range(512)]
    first = shards.first_map(8, 512)
    after = shards.rebalanced(first, loads, 8)
    sums = [sum(x for x, s in zip(loads, after, strict=True) if s == k) for k in range(8)]
    assert max(sums) - min(sums) < max(loads) / 50
    assert sum(a != b for a, b in zip(first, after, strict=True)) < 100
    # One huge document keeps its shard over all others, which are brought together all the same.
    loads = [0] * 512
    loads[0], loads[1], loads[9], loads[17] = 10**9, 50, 50, 50
    after = shards.rebalanced(first, loads, 8)
    assert len({after[s] for s in (0, 1, 9, 17)}) == 4


def test_map_lasts(spark, tmp_path):
    """A second run edits the map of the first, and says what moves; a run that moves nothing adds no version."""
    path = f"{tmp_path}/map"
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(200), "en", "s") for i in range(1500)]

    def run(rows, shards_):
        found = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in shards.assign(documents(spark, rows), shards_, virtual_slots=256, map_path=path).collect()}
        return found, shards.newest_version(spark, path)

    assert shards.newest_version(spark, path) is None
    first, one = run(rows, 8)
    again, same = run(rows, 8)
    assert again == first and same == one == 1
    more = rows + [(i, "y" * rng.randrange(3000), "en", "s") for i in range(1500, 1700)]
    second, two = run(more, 8)
    changes = {r["virtual_slot"]: (r["old_shard"], r["new_shard"]) for r in shards.moved(spark, path, one, two).collect()}
    assert two == 2 and 0 < len(changes) < 128
    for doc, (slot, shard) in first.items():
        assert second[doc] == (slot, changes.get(slot, (0, shard))[1]) and changes.get(slot, (shard, 0))[0] == shard
    third, three = run(more, 9)  # another shard takes its part of the slots
    grown = [r for r in shards.moved(spark, path, two, three).collect()]
    assert {shard for _, shard in third.values()} == set(range(9)) and sum(r["new_shard"] == 8 for r in grown) >= len(grown) / 2
    fourth, _ = run(more, 3)  # shards that are gone hold nothing
    assert {shard for _, shard in fourth.values()} == {0, 1, 2}
    with pytest.raises(ValueError):
        shards.assign(documents(spark, rows), 8, virtual_slots=128, map_path=path)


def test_water_level(spark):
    docs = documents(spark, [(i, "w " * n, "en", s) for i, (n, s) in enumerate([(10, "a"), (500, "b"), (490, "c"), (0, "d")])])
    goals = {r["source"]: r["target"] for r in mixing.targets(mixing.measured(docs, "doc_id", "text", "source")).collect()}
    # a stops at 30; b and c share 970 by 2 : 1.
    assert goals == pytest.approx({"a": 30, "b": 970 * 2 / 3, "c": 970 / 3, "d": 0})
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    assert {r["source"]: r["t"] for r in taken} == {"a": 30, "b": 647, "c": 323, "d": 0}


def test_passages_in_one_document(spark):
    rows = {r["doc_id"]: r for r in substrings.deduplicated(documents(spark, [*ODD, (9, f"{PASSAGE} mid {PASSAGE}", None, None)])).collect()}
    assert [rows[i]["n_removed"] for i in (5, 6, 9)] == [40, 40, 80]
    assert rows[9]["kept"] == "mid" and rows[5]["kept"] == "fin"
    assert rows[4]["n_removed"] == 0 and rows[1]["n_words"] == 0
    # Sixty thousand equal windows of one document repeat each other; the last word belongs to none.
    assert rows[7]["n_words"] == 30_001 and rows[7]["n_removed"] == 30_000


def test_contamination_cases(spark):
    items = spark.createDataFrame([(1, "One"), (1, "ONE!"), (2, None), (3, ""), (None, "Two-words"), (10, PASSAGE)], "item_id long, text string")
    rows = contamination.search(documents(spark, ODD), items).collect()
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows if r["n_hit"]}
    assert len(rows) == len(ODD)
    assert got == {(4, 1, 1, ("1",)), (None, 2, 2, ()), (5, 41, 40, ("10",)), (6, 41, 40, ("10",))}
    assert contamination.search(documents(spark, ODD), items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = documents(spark, [(1, "b x a y c", None, None), (2, "a b", None, None), (3, "c b a", None, None)])
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    phrases, _ = contamination.phrases_of(items, "item_id", "text", 10)
    anchors = contamination.anchors_of(phrases, contamination.frequencies(docs, phrases, "text"))
    index = contamination.build_index(docs, anchors, 4, "doc_id", "text")
    assert {r["doc_id"] for r in contamination.near(index, phrases, anchors).collect()} == {1, 3}
    assert contamination.exact(index, phrases, anchors).count() == 0
    asked = spark.createDataFrame([(1, "a b c"), (2, "c b"), (3, "q c"), (None, "a c")], "item_id long, text string")
    found = {r["doc_id"]: (r["items"], r["near_items"]) for r in contamination.search(docs, asked, 5, proximity=True).collect()}
    assert found == {1: ([], ["1", "2"]), 2: ([], []), 3: (["2"], ["1"])}


def test_archive_round_trip(spark):
    long = "é" * 600
    rows = [(1, "u", long), (2, "u\r\nWARC-Type: x", long), (3, None, long), (4, "v", "short"), (5, "v", "short"), (6, "w", None), (6, "w", None), (None, None, long)]
    path = storage.new_path(spark, "warc-test")
    archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    read = archive.read(spark, path)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archive.report(read).collect())
    assert got == [
        (0, "revisit", 3, 1200), (1, "revisit", 3, 1200), (2, "revisit", 3, 1200), (3, "response", None, 1200),
        (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (6, "response", None, 0),
    ]
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert all(r["header_digest"] == r["payload_digest"] for r in archive.report(read).collect())
    records = {r["page_id"]: bytes(r["record"]) for r in archive.record_bytes(read).where("page_id in (3, 4)").collect()}
    assert records[4].endswith(b"\r\n\r\nshort\r\n\r\n") and long.encode() in records[3]


def test_archive_of_odd_tables(spark):
    """An empty table, and columns named as the archive names its own."""
    names = ("digest", "packed", "header", "payload", "keeper", "n", "sha1", "record_type", "payload_bytes")
    rows = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for frame in (pages, pages.withColumns({name: F.lit("other") for name in names}), pages.limit(0)):
        path = storage.new_path(spark, "warc-test")
        archive.write(frame, path)
        found.append(sorted(map(repr, archive.report(archive.read(spark, path)).collect())))
    assert found[0] == found[1] and len(found[0]) == 3 and found[2] == []


def test_language_cases(spark):
    words = {"en": "the of and thing with", "es": "el de los que con", "fr": "le des est dans pour"}
    rows = [(i, " ".join([words[k]] * 12), k, "s") for i, k in enumerate([*words] * 20)]
    field = language.train(documents(spark, rows))
    got = language.predict(documents(spark, [*ODD, (99, " ".join([words["en"]] * 9 + [words["fr"]] * 3), None, None)]), field).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) + 1
    assert by_id[8]["lang_pred"] == by_id[2]["lang_pred"] == "und" and by_id[8]["score"] == 0
    assert by_id[99]["lang_pred"] == "en" and [(s["lang"], s["words"]) for s in by_id[99]["segments"]] == [("en", 45), ("fr", 15)]
    signs = [(1, "\u00b2 \u00bd 12", None, None), (2, "\u2167 \u3289 _ \u0660", None, None), (3, "the\u00b2 of", None, None), (4, "\u0301", None, None)]
    assert [r["lang_pred"] for r in sorted(language.predict(documents(spark, signs), field).collect())] == ["und", "und", "en", "und"]
    # A third of the words each: no language of the text has enough of it.
    thirds = [(1, " ".join([words[k]] * 12), None, None) for k in words] + [(2, " ".join(words[k] for k in words), None, None), (3, "!!", None, None)]
    assert [r["doc_id"] for r in language.accepted(documents(spark, thirds), field).collect()] == [1, 1, 1]
    empty = language.train(documents(spark, ODD).limit(0))
    assert {r["lang_pred"] for r in language.predict(documents(spark, ODD), empty).collect()} == {"und"}


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 70])
    emissions, steps = rng.random((74, 2)) + 0.1, rng.random((2, 2)) + 0.1
    got = language.word_marginals(emissions.astype(np.float32), lengths, steps)
    want = np.zeros((3, 2))
    for path in itertools.product(range(2), repeat=3):
        p = np.prod([emissions[t, y] for t, y in enumerate(path)]) * steps[path[0], path[1]] * steps[path[1], path[2]]
        for t, y in enumerate(path):
            want[t, y] += p
    assert np.allclose(got[:3], want / want.sum(axis=1, keepdims=True), atol=1e-4)
    forward, backward = language._messages(emissions[None, 4:], steps)
    both = (forward * backward)[0]
    assert np.allclose(got[4:], both / both.sum(axis=1, keepdims=True), atol=1e-4)


def test_simhash_links_by_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)]
    chain = [base[0]]
    for _ in range(30):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted({simhash._signed(v) for v in base + near + chain})
    parent = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and parent[a] > parent[b]:
                    parent[a], changed = parent[b], True
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    assert {v: roots.get(v, v) for v in values} == parent


def test_simhash_representatives(spark):
    kept = simhash.representatives(documents(spark, ODD)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 5, 6, 7, 8]
    assert list(kept[0].asDict()) == documents(spark, ODD).columns


def test_automaton_by_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(40)})
    weights = {t: rng.choice([0.5, 1.55, 3.0]) for t in terms}
    lexicon = toxicity.Lexicon(weights, frozenset(["abcabcabc"]))

    def allowed(term):
        by_length = 0 if len(term) < 4 else 1 if len(term) < 7 else 2
        # Half a point is never misspelled, one and a half once, three twice.
        return min(by_length, {0.5: 0, 1.55: 1, 3.0: 2}[weights[term]])

    edited = set()
    for _ in range(1500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        near = sorted((distance(word, t), -weights[t], t) for t in terms if distance(word, t) <= allowed(t))
        [found] = lexicon.find([word])
        if word in weights:
            assert found == (word, weights[word], 0)
        elif not near:
            assert found is None
        else:
            edits, _, term = near[0]
            assert found == (term, weights[term] * toxicity.DECAY**edits, edits)
            edited.add(edits)
    assert edited == {1, 2} and lexicon.find(["abcabcabc"]) == [None]


def test_toxicity_cases(spark):
    rng = random.Random(4)
    plain = ["house", "tree", "walks", "green", "river", "stone", "cloud", "paper"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = "grobian"
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    cases = [(1, "a grobian here", None, None), (2, "river stone", None, None), (3, None, None, None), (4, "one grxbian there", None, None), (5, 'he said "grobian" once', None, None)]
    got = {r["doc_id"]: r for r in toxicity.predict(documents(spark, cases), model).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] < 0.5 and not got[3]["hits"]
    assert got[4]["hits"][0]["misspelled"] and got[5]["hits"][0]["quoted"] and got[5]["score"] < 0.5
    # Two edits of a long term, one of a short one, and none of a term's half.
    assert got[4]["score"] > 0.5 and got[4]["hits"][0]["edits"] == 1
    twisted = documents(spark, [(1, "a grxbiaan here", None, None), (2, "a grbn here", None, None)])
    got = {r["doc_id"]: r for r in toxicity.predict(twisted, model).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[1]["hits"][0]["edits"] == 2
    nothing = toxicity.train(documents(spark, rows).limit(0), labels)
    assert toxicity.predict(documents(spark, ODD), nothing).where("score > 0.01").count() == 0


def test_language_samples_words_from_all_over_a_text(spark):
    """Windows lie in every part of a long text; a text of at most that many words is taken whole."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 199, 200, 201, 5000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    taken = {r["i"]: r["w"] for r in frame.select("i", language._sample_words(F.col("t"), F.col("i")).alias("w")).collect()}
    assert [len(taken[i]) for i in range(5)] == [1, 199, 200, 200, 200]
    places = [int(w[1:]) for w in taken[4]]
    assert [sum(k * 1250 <= p < (k + 1) * 1250 for p in places) for k in range(4)] == [50] * 4
    assert len(set(places)) == 200 and places != list(range(200))


def test_score_by_hand(spark):
    """Hits and score of a row from the lexicon and the coefficients alone."""
    model = toxicity.Model({"grobian": 4.0, "lump": 2.0, "zank*": 3.0}, [-2.0, 1.5, 0.5, -1.0, 0.25])
    texts = {
        1: "you grobian and a lupm there",  # two edits of four letters are too many
        2: "a lumpp said she",
        3: 'he wrote "grobiam" there',
        4: "zankerei, GROBIAN!",
        5: "nothing of it",
    }
    want = {
        1: ([("grobian", 0, False)], 4.0, 4.0, 0.0, 1),
        2: ([("lump", 1, True)], 0.0, 0.0, 1.6, 0),
        3: ([("grobian", 1, True)], 0.0, 0.0, 3.2, 0),
        4: ([("zank*", 0, False), ("grobian", 0, False)], 7.0, 4.0, 0.0, 0),
        5: ([], 0.0, 0.0, 0.0, 0),
    }
    import math

    for r in toxicity.predict(documents(spark, [(i, t, None, None) for i, t in texts.items()]), model).collect():
        hits, abuse, heaviest, quoted, address = want[r["doc_id"]]
        assert [(h["term"], h["edits"], h["quoted"]) for h in r["hits"]] == hits
        z = -2.0 + 1.5 * math.log1p(abuse) + 0.5 * heaviest / 10 - math.log1p(quoted) + 0.25 * math.log1p(address)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_topk_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(130)]
    rows += [(200, [1.0, None]), (220, None), (240, [float("nan")] * 8), (260, [0.5] * 3), (None, [1.0] * 8), (20, [0.25] * 8), (21, rows[22][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, `row` int, block int")
    import math
    import struct

    def single(x):
        return struct.unpack("f", struct.pack("f", x))[0]

    used = [(i, [math.floor(64 * single(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    by_id = {}
    for n, (i, v) in enumerate(used):
        if i % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(used) if m != n]
            by_id.setdefault(i, []).extend(scores)
    for i, scores in by_id.items():
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:20])}
    assert {tuple(r) for r in topk.search(frame).collect()} == want
    assert topk.search(frame.limit(0)).count() == 0


@pytest.mark.parametrize("filled", [0.05, 0.24, 0.26, 1.0])
def test_scores_of_sparse_and_dense_blocks(filled):
    rng = np.random.default_rng(int(filled * 100))
    queries, vectors = (rng.integers(-90, 90, (n, 37)) * (rng.random((n, 37)) < filled) for n in (20, 300))
    want = queries @ vectors.T
    assert (topk.accumulated(queries, vectors) == want).all() and (topk.scattered(queries, vectors) == want).all()
    huge = vectors.astype(np.int64) << 40
    assert (topk.accumulated(queries, huge) == queries @ huge.T).all()


def test_search_in_many_groups(spark, monkeypatch):
    """Blocks and groups of a few rows, sparse rows, ties: the same lists as from one block."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0] * 6 + [0.25, -0.5, 1.0]) for _ in range(12)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(map(tuple, topk.search(frame, k=7).collect()))
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 3), ("GROUP", 3), ("QUERY_GROUP", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.search(frame, k=7).collect())) == want and len(want) == 140


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_whole_pipeline(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Two words"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["text"] for r in result} <= {t for _, t, _, _ in rows}
    assert all(r["shard"] in range(16) for r in result)
    assert "two words" not in {r["text"] for r in result}


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_every_operator_keeps_every_row(spark, rows):
    docs = documents(spark, rows)
    assert shards.assign(docs).count() == mixing.mix(docs).count() == len(rows)
    assert simhash.groups(docs).count() == substrings.deduplicated(docs).count() == len(rows)
    assert sorted(r["slot"] for r in shards.assign(docs, 1).collect()) == list(range(len(rows)))


#: Names that operators give to columns of their own, as far as documents do not have them anyway.
TAKEN = (
    "i l h t r own words toxic term piece pieces edges pos n n_words n_hit items k2 begin around w phrase phrase_id start"
    " virtual_slot slot place run before taken target source_size s fp text_key root first component_id u v at starts packed"
    " id spans row kept x cut alike total key_ held_out score hits segments lang_pred"
).split()


def test_columns_named_as_an_operator_names_its_own(spark):
    docs = documents(spark, ODD).withColumns({name: F.lit("x") for name in TAKEN})
    plain = documents(spark, ODD)
    marked = spark.createDataFrame([(4, 1, "z"), (5, 0, "z")], "doc_id long, toxic int, i string")
    asked = spark.createDataFrame([(1, "Two words", "z")], "item_id long, text string, w string")

    def same(frame, other):
        columns = other.columns
        assert sorted(map(repr, frame.select(columns).collect())) == sorted(map(repr, other.collect()))

    field = language.train(docs)
    assert (field.weights == language.train(plain).weights).all()
    same(language.predict(docs, field), language.predict(plain, field))
    assert language.accepted(docs, field).columns == docs.columns
    model = toxicity.train(docs, marked)
    same(toxicity.predict(docs, model), toxicity.predict(plain, model))
    same(contamination.search(docs, asked), contamination.search(plain, asked))
    for operator in (pii.find, shards.assign, mixing.mix, substrings.deduplicated, simhash.groups):
        same(operator(docs), operator(plain))
    for stage in (shards.placed, mixing.sampled, simhash.representatives):
        same(stage(docs), stage(plain).drop("shard") if stage is mixing.sampled else stage(plain))
    same(contamination.clean(docs, asked), contamination.clean(plain, asked))


def test_scratch(spark):
    outer = storage.new_path(spark, "kept")
    with storage.scratch(spark, "work"):
        inner = storage.staged(spark.range(3), "inner")
        kept = storage.staged(inner.where("id > 0"), "kept", outer)
    assert kept.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        inner.count()


def test_release(spark):
    kept = storage.staged(spark.range(3), "gone")
    assert kept.count() == 3
    storage.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        kept.count()
