"""Decontamination, quality, toxicity and their odd cases."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, quality, toxicity

from .conftest import SF, prose


def test_decontamination_equals_brute_force(spark):
    from math import log1p

    items = [(i, prose(900 + i, n)) for i, n in enumerate((8, 15, 30, 30, 60))]
    r, docs = random.Random(2), []
    for d in range(40):
        words = prose(d, r.randrange(3, 200)).split()
        if d % 2:
            own = items[r.randrange(5)][1].split()
            for _ in range(r.choice((0, 0, 1, 3))):
                own[r.randrange(len(own))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = own
        docs.append((d, "\n".join((" ".join(words[:20]), " ".join(words[20:]))).title()))
    split = lambda x: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: grams(split(x)) for i, x in items}
    df = {}
    for own in sets.values():
        for s in own:
            df[s] = df.get(s, 0) + 1
    weight = lambda s: log1p(len(items) / df.get(s, 1))
    want = {}
    for d, x in docs:
        w = split(x)
        for i, own in sets.items():
            n = min(len(split(items[i][1])), len(w))
            best = max((sum(map(weight, g & own)) / sum(map(weight, g | own)) for k in range(len(w) - n + 1) if (g := grams(w[k : k + n])) & own), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and len(want) > 8


def test_items_below_five_words_are_found_in_long_documents(spark):
    items = [(1, "Zinc"), (2, "zinc, tin"), (3, "tin zinc tin"), (4, "lead tin zinc tin"), (5, "tin zinc tin"), (6, "of six words all of them")]
    split = lambda x: re.findall(r"[0-9a-z]+", x.lower())
    r = random.Random(8)
    docs = [(d, " ".join(r.choice(("zinc", "TIN", "lead", "iron.", "gold")) for _ in range(r.randrange(0, 30)))) for d in range(80)]
    docs.append((80, "gold and lead. TIN zinc\ntin gold"))
    want = {}
    for d, x in docs:
        w = split(x)
        for i, y in items:
            own = split(y)
            hits = [k for k in range(len(w) - len(own) + 1) if w[k : k + len(own)] == own]
            if hits:
                want[d, i] = (hits[0], len(own), 0, 1.0, len(hits))
    docs_table, items_table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs_table, items_table).collect()
    assert {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.hamming, r.similarity, r.n_windows) for r in got} == want and len(got) == len(want)
    assert {i for _, i in want} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in decontaminate.clean(docs_table, items_table).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_weights_are_of_the_whole_benchmark(spark, monkeypatch):
    """One block an item gives the same similarities as one block of all, in any order."""
    common, r = prose(40, 12), random.Random(9)
    items = [(i, f"{common} {prose(60 + i, 12)}") for i in range(6)] + [(9, prose(80, 20))]
    docs = []
    for d in range(60):
        own = items[d % 7][1].split()
        for _ in range(r.randrange(0, 3)):
            own[r.choice((0, len(own) - 1))] = "changed"
        docs.append((d, f"{prose(d, 30)} {' '.join(own)} {prose(d + 200, 9)}"))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for size, rows in ((decontaminate.BLOCK_BYTES, items), (1, items), (400, items[::-1])):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.matches(docs, spark.createDataFrame(rows, "item_id long, text string").coalesce(1)).collect()
        found.append({(x.doc_id, x.item_id): round(x.similarity, 9) for x in got})
    assert found[0] == found[1] == found[2] and len(found[0]) > 20 and min(found[0].values()) < 1


def test_hamming_index_finds_all():
    r = np.random.default_rng(1)
    stored = r.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 14), replace=False)) for _ in range(200)], dtype=np.uint64)
    queries = stored[r.integers(0, 60, 200)] ^ flips
    q, s, d = decontaminate.HammingIndex(stored, 8).find(queries)
    all_ = np.bitwise_count(queries[:, None] ^ stored[None, :])
    assert sorted(zip(q.tolist(), s.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(all_ <= 8)))) and (all_[q, s] == d).all()


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here for all of us"), (2, None), (3, ""), (4, "at all in")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd_docs, items).collect()}
    assert found == {(1, 1), (2, 1), (None, 4)}  # item 4 stands in the row without an id
    out = decontaminate.clean(odd_docs, items)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count() - 4
    assert decontaminate.matches(no_docs, items).count() == 0 and decontaminate.matches(odd_docs, items.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scored(docs.select("doc_id", "text"), quality.train(docs, labels)).join(labels, "doc_id")
    held = found.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").toPandas()
    assert len(held) > 50 and ((held.score >= quality.THRESHOLD) == (held.quality == 1)).mean() > 0.95 and held.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (10, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.accepted(odd_docs, labels)
    assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()
    one = quality.scored(odd_docs, quality.train(odd_docs, labels.where("quality = 1")), out_col="s")
    assert {round(r.s, 6) for r in one.collect()} == {quality.THRESHOLD}  # labels of one kind teach nothing
    assert quality.accepted(no_docs, labels).count() == 0


def test_features_are_finite():
    x = quality.features(["", "a", "\n\n", "Ünï 漢字", "!!!", prose(1, 500)])
    assert x.shape == (6, len(quality.NAMES)) and np.isfinite(x).all()
    assert (quality.features([prose(1, 50), "b"])[0] == quality.features([prose(1, 50)])[0]).all()


def brute_segments(scores):
    """Maximal segments by their definition, over all places: no proper part scores more, and none is inside another."""
    out, n = [], len(scores)

    def best(a, b):
        if a >= b:
            return
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
        if top[0] > 1e-12:
            i, j = top[3], top[4]
            best(a, i)
            out.append((i, j - 1, round(sum(scores[i:j]), 6)))
            best(j, b)

    best(0, n)
    return out


def test_maximal_segments_equal_their_definition():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 14)
        gap = -r.choice((0.5, 1.25))
        own = {i: r.choice((1.0, 2.5, 4.0, -3.0)) for i in range(n) if r.random() < 0.4}
        dense = [own.get(i, gap) for i in range(n)]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(sorted(own.items()), gap)]
        want = brute_segments(dense)
        assert sorted(s for *_, s in got) == sorted(s for *_, s in want), (own, gap, got, want)


def test_toxicity_finds_passages(spark):
    r, docs, labels = random.Random(6), [], []
    bad = ["zounds", "fie", "knave", "varlet"]
    for d in range(400):
        words = prose(d, 80).split()
        toxic = d % 4 == 0
        if toxic:
            at = r.randrange(60)
            words[at : at + 8] = [r.choice(bad) if k % 2 else "and" for k in range(8)]
        docs.append((d, " ".join(words)))
        if d < 300:
            labels.append((d, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scored(frame, model).collect()
    assert all((x.score >= toxicity.THRESHOLD) == (x.doc_id % 4 == 0) for x in got)
    assert all(len(x.passages) == 1 and x.passages[0].last - x.passages[0].first in range(4, 9) for x in got if x.doc_id % 4 == 0)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (10, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    out = toxicity.scored(odd_docs, model, out_col="s")
    assert out.count() == odd_docs.count() and all(0 <= x.s <= 1 for x in out.collect())
    assert toxicity.scored(no_docs, toxicity.train(no_docs, labels)).count() == 0


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    wrong = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = quality.train(docs, labels), quality.train(docs, wrong)
    assert (a.weights == b.weights).all() and a.cut == b.cut
    assert toxicity.train(docs, labels).words == toxicity.train(docs, wrong).words




def test_maximal_segments_of_dense_scores_equal_their_definition():
    r = random.Random(14)
    for _ in range(300):
        scores = [r.choice((-3.0, -1.0, -0.25, 0.5, 1.0, 2.0)) for _ in range(r.randrange(1, 13))]
        got = toxicity.maximal_segments(list(enumerate(scores)), -1.0)
        assert sorted(round(s, 6) for *_, s in got) == sorted(s for *_, s in brute_segments(scores))
        assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    from time import process_time

    def took(n, step):
        # Falling sums, so that every new segment looks back over those before it.
        scores = [(3 * k, 1.0) for k in range(n)] if step else [(k, 1.0 if k % 2 else -1.5) for k in range(2 * n)]
        begin = process_time()
        assert len(toxicity.maximal_segments(scores, -1.0)) == n
        return process_time() - begin

    for step in (False, True):
        took(1_000, step)
        assert min(took(160_000, step) for _ in range(3)) < 20 * min(took(20_000, step) for _ in range(3)) + 0.05


def test_a_passage_scores_the_same_wherever_it_stands():
    model = toxicity.Lexicon({"knave": 4.0, "zoun*": 3.0, "mild": -2.0}, lam=1.0, k=0.1, cut=2.0)
    bad, calm = "knave zounds knave", prose(3, 400)
    early, late = model.judged(f"{bad} {calm}"), model.judged(f"{calm} {bad}")
    assert round(early[0], 9) == round(late[0], 9) > 0.3 and round(early[1][0][2], 9) == round(late[1][0][2], 9)
    assert model.judged(f"{bad} mild {calm}")[1][0][2] == early[1][0][2] and model.judged("knave " * 50)[0] < early[0]


def test_scores_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", "own", "own")], "doc_id long, text string, score string, passages string")
    out = toxicity.scored(docs, toxicity.Lexicon())
    assert out.columns == ["doc_id", "text", "score", "passages"] and out.first().score == 0.0
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.scored(docs, quality.train(docs, labels)).columns == ["doc_id", "text", "passages", "score"]


def test_repeated_labelled_rows_teach_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.unionByName(docs).unionByName(docs.limit(20))
    assert (quality.train(docs, labels).weights == quality.train(again, labels).weights).all()
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(3), labels)
    assert a.words == b.words and a.cut == b.cut


def test_radius_keeps_similar_windows():
    """Fingerprints of windows at a similarity of 0.8 or more: within the radius nearly all are, within 12 bits too few."""
    r, grams = random.Random(5), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    far = {True: [], False: []}
    for k in range(1_500):
        at_end, n = k % 2 == 0, r.randrange(13, 81)
        a = prose(r.randrange(1 << 40), n).split()
        b, turn = list(a), 0
        while True:
            c = list(b)
            c[turn if at_end else r.choice((0, n - 1, r.randrange(n)))] = f"new{r.randrange(9999)}"
            if len(grams(a) & grams(c)) < 0.8 * len(grams(a) | grams(c)):
                break
            b, turn = c, turn + 1
        w = decontaminate.words([" ".join(a), " ".join(b)])
        x, y = (decontaminate.fingerprints(decontaminate.votes(w.hashes[w.offsets[i] : w.offsets[i + 1]]).sum(axis=0)[None, :])[0] for i in (0, 1))
        far[at_end].append(int(np.bitwise_count(x ^ y)))
    share = lambda v, d: np.mean(np.array(v) <= d)
    assert share(far[True], decontaminate.RADIUS) > 0.99 and share(far[False], decontaminate.RADIUS) > 0.995
    assert share(far[True], 12) < 0.97


def test_hamming_search_is_whole_and_bounded():
    """All pairs within the radius, by definition; memory does not grow with the pairs that are compared."""
    import tracemalloc

    r = np.random.default_rng(1)
    stored, asked = r.integers(0, 1 << 63, 20_000, dtype=np.uint64), r.integers(0, 1 << 63, 8_000, dtype=np.uint64)
    asked[:50] = stored[:50] ^ np.uint64(0b1011)
    asked[50:60], stored[100:110] = asked[50], stored[100]
    index = decontaminate.HammingIndex(stored)
    tracemalloc.start()
    q, s, distance = index.find(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    some = np.bitwise_count(asked[:400, None] ^ stored[None, :])
    want = {(int(a), int(b), int(some[a, b])) for a, b in zip(*np.nonzero(some <= decontaminate.RADIUS))}
    assert {x for x in zip(q.tolist(), s.tolist(), distance.tolist()) if x[0] < 400} == want
    assert [len(x) for x in decontaminate.HammingIndex(stored[:0]).find(asked)] == [0, 0, 0]
