"""Losses that were mended: glued base64, escapes of other forms, bounded training rows, hot seeds."""

import base64
import gzip
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandq.llm import common, decontaminate, secrets, toxicity
from strandq.operators import skew

SCHEMA = "doc_id long, text string"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(r.randint(0, 99)) for _ in range(n))


def test_base64_behind_anything():
    """Whatever is glued to its front, of any length, plain and compressed."""
    for raw in (b"password=hunter222222", gzip.compress(b"password=hunter222222"), zlib.compress(b"password=hunter222222"), zlib.compress(b"password=hunter222222", 9)):
        t = base64.b64encode(raw).decode()
        for front in ("", "k=", "https://x/", "https://xy/", "a-", "ab_", "x"):
            assert [k for k, _, _ in secrets.find_secrets(f"see {front}{t} now")[1]] == ["assign"], (front, raw)
        for sign in "/-_a7Z":
            for n in range(1, 9):
                assert secrets.find_secrets(f"see {sign * n}{t} now")[1] == [("assign", 4, 4 + n + len(t))], (sign, n, raw)


def test_escapes_of_all_forms():
    for code in ("\\u0070", "\\u{70}", "\\u{000070}", "\\U00000070", "\\x70", "&#112;", "&#x70;", "&#X70;"):
        assert secrets.find_secrets(f"a {code}assword=hunter22222 b")[1] == [("assign", 2, 2 + len(code) + 19)], code
    assert secrets.find_secrets("a \\U99999999assword=hunter22222 \\u{110000} b") == ([], [])


def test_false_starts_of_compressed_data_cost_little():
    import time

    noise = base64.b64encode(np.random.RandomState(3).bytes(1_500_000)).decode()
    began = time.process_time()
    assert secrets.find_secrets(noise)[1] == []
    assert time.process_time() - began < 20


def test_training_rows_are_bounded(spark, monkeypatch):
    """Repeats of a row and labels of unknown documents leave the bound and the shares as they are."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", {1: 40, 0: 60})
    r = random.Random(2)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, words(r, 5)) for i in ids[:600]]
    labels = spark.createDataFrame([(i, int(k % 3 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    rows, raised = toxicity.training_rows(spark.createDataFrame(docs, SCHEMA), labels)
    once = sorted(map(tuple, rows.collect()))
    n = Counter(y for _, y in once)
    assert 20 <= n[1] <= 65 and 35 <= n[0] <= 95
    assert math.isclose(raised, math.log((40 / 200) / (60 / 400)))
    again, same = toxicity.training_rows(spark.createDataFrame(docs * 20, SCHEMA), labels)
    assert sorted(map(tuple, again.collect())) == once and same == raised
    five = [(i, f"text of {i}") for i in ids[:5]] * 2000
    assert toxicity.training_rows(spark.createDataFrame(five, SCHEMA), labels)[0].count() == 5


def plain_score(model, text):
    """The score by a plain reading: every place of every pattern, hits within a phrase left out."""
    folded = toxicity.fold(text)
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(i, i + len(p)) for p in model.exceptions for i in at(p)]
    hits = [(p, w) for p, w in model.weights.items() for i in at(p) if not any(s <= i and i + len(p) <= e for s, e in spared)]
    total, each = sum(w for _, w in hits), sum(w for _, w in dict(hits).items())
    x = [1, math.log1p(total), math.log1p(each), 10 * total / (10 + folded.count(" ")), max((w for _, w in hits), default=0)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.coefficients, strict=True))))


def plain_lexicon(rows):
    """weights and exceptions of (text, toxic) by counting documents per pattern."""
    folded = [(toxicity.fold(t), y) for t, y in rows]
    all1 = sum(y for _, y in folded)
    all0 = len(folded) - all1

    def g(n1, n0):
        p = (n1 + n0) / (all1 + all0)
        return 2 * (n1 * math.log((n1 + 0.01) / (all1 * p + 0.01)) + n0 * math.log((n0 + 0.01) / (all0 * p + 0.01))) if n1 * all0 > 2 * n0 * all1 else 0

    per_word = {w: [sum(y == k and f" {w} " in f for f, y in folded) for k in (0, 1)] for w in {w for f, _ in folded for w in f.split()}}
    forms = {w: [f" {w} "] + [x for k in toxicity.AFFIX if len(w) > k for x in (f" {w[:k]}", f"{w[-k:]} ")] for w in per_word}
    summed = {}
    for w, own in forms.items():
        for p in own:
            a, b = summed.get(p, (0, 0))
            summed[p] = a + per_word[w][0], b + per_word[w][1]
    least = 8 + 2 * math.log(1 + len(per_word))
    first = [p for p, (n0, n1) in summed.items() if n1 >= 3 and g(n1, n0) >= least]
    exact = {p: [sum(y == k and p in f for f, y in folded) for k in (0, 1)] for p in first}
    weights = {p: math.log((n1 + 0.5) / (all1 + 1)) - math.log((n0 + 0.5) / (all0 + 1)) for p, (n0, n1) in exact.items() if g(n1, n0) >= least}
    spared = {f" {w} " for w, (n0, n1) in per_word.items() if n0 >= 3 and n1 * all0 <= n0 * all1 and any(p in weights for p in forms[w][1:])}
    return weights, spared


def test_toxicity_is_that_of_a_plain_reading(spark):
    r = random.Random(71)
    rows = []
    for i in range(900):
        toxic = int(r.random() < 0.3)
        text = words(r, r.randint(3, 25)).split()
        for _ in range(r.randint(1, 3) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["grimble", "Grimbles", "GR1MBLEd", "snarkling", "snarkle", "vexpit"]))
        if not toxic and r.random() < 0.3:
            text.append(r.choice(["grimbledon", "snarklewood"]))
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(10_000, None), (10_001, ""), (10_002, "grimble " * 5000)], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    weights, spared = plain_lexicon([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5])
    assert model.weights.keys() == weights.keys() and all(math.isclose(w, weights[p]) for p, w in model.weights.items())
    assert set(model.exceptions) == spared and spared
    for x in toxicity.toxicity(docs, model).collect():
        if x.doc_id != 10_002:
            assert math.isclose(x.score, plain_score(model, x.text), rel_tol=1e-9)


def common_text(r, n):
    return " ".join(r.choice("of the and to in a is that".split()) for _ in range(n))


def test_joined_rows_grow_with_documents(spark, monkeypatch):
    """Pairs that many items share aren't joined where an item has others; what still has to be is dealt to cells."""
    monkeypatch.setattr(skew, "LEAST", 64)
    joined = {}
    for scale in (1, 4):
        r = random.Random(19)
        items = [common_text(r, 12) + " " + " ".join(f"own{i}x{k}" for k in range(28)) for i in range(50 * scale)]
        texts = [common_text(r, 120) for _ in range(200 * scale)] + [f"{common_text(r, 30)} {items[k]} {common_text(r, 30)}" for k in range(10)]
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()} >= {(200 * scale + k, k) for k in range(10)}
        grams = decontaminate.item_grams(bench.withColumn("item", F.col("item_id")))
        seeds = decontaminate.rare_seeds(docs, grams)
        shared = grams.groupBy("gram").count().filter(F.col("count") > decontaminate.SHARED)
        assert (scale == 1 or shared.count() > 50) and seeds.join(shared, "gram").count() == 0
        joined[scale] = seeds.agg(F.sum("df")).first()[0]
    assert joined[4] <= 5 * joined[1], joined


def test_components_of_hubs(spark, monkeypatch):
    """Hubs dealt to cells, chains, and links given twice, in either direction or to themselves."""
    monkeypatch.setattr(skew, "LEAST", 16)
    r = random.Random(23)
    links = [(5, k) for k in range(1000, 1400)] + [(k, 7) for k in range(1300, 1800)] + [(k, k + 1) for k in range(2000, 2040)] + [(3000 + r.randrange(60), 3000 + r.randrange(60)) for _ in range(45)]
    links += [(b, a) for a, b in links[:300]] + [(9, 9), (None, 4), (4, None)]
    label = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    for _ in range(60):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(label) and {x.node: x.comp for x in got} == label
