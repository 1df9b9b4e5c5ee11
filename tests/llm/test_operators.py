"""The ten operators and the pipeline's stages against brute force, round trips and edge cases."""

import base64
import gzip
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandq.llm import chat, common, decontaminate, gif, ngram_join, packing, secrets, sharding, substrings, toxicity, url_filters
from strandq.operators import skew

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, n int, comp long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(r.randint(0, 99)) for _ in range(n))


def corpus():
    r = random.Random(7)
    texts = [words(r, r.randint(1, 120)) for _ in range(60)]
    base = words(r, 100)
    texts += [base] * 6
    for k in range(12):  # near copies of one text
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 999))
        texts.append(" ".join(w))
    return [*texts, None, "", "  \n ", "one", "One", "x" * 200_000, "é " * 30, base.upper()]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, "s", None, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    s, label = [sets_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return s, label


def test_ngram_join(spark):
    texts = corpus()
    s, label = brute_components(texts)
    got = {r.doc_id: r for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(x) for x in s]
    assert [got[i].component_id for i in range(len(texts))] == label
    kept = {r.doc_id for r in ngram_join.one_of_each(frame(spark, texts)).collect()}
    assert kept == {i for i, c in enumerate(label) if i == c}
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    odd = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [3, None, 3])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.ngram_join(odd).collect()) == [(-1, -1), (3, 3), (3, 3)]


def test_ngram_join_in_cells(spark, monkeypatch):
    """Hot tokens, hot groups and hot stars dealt to cells; templates, mixes of common lines, chains of near copies."""
    monkeypatch.setattr(skew, "LEAST", 2)
    monkeypatch.setattr(ngram_join, "CELL", 2)
    r = random.Random(41)
    lines = [words(r, 9) for _ in range(8)]
    texts = [f"the new post was liked by user u{i}" for i in range(60)] + [f"{lines[0]} {lines[1]} and user u{i} too" for i in range(30)]
    texts += [" ".join(r.sample(lines, r.randint(2, 5))) for _ in range(120)]
    chain = words(r, 60).split()
    for _ in range(40):
        chain[r.randrange(60)] = f"w{r.randint(0, 10**6)}"
        texts.append(" ".join(chain))
    s, label = brute_components(texts)
    rows = ngram_join.ngram_join(frame(spark, texts)).collect()
    assert {x.doc_id: x.component_id for x in rows} == dict(enumerate(label)) and len(rows) == len(texts)


def test_one_of_each_loses_no_text(spark):
    """Rows of one id with other texts are others; repeats of a row go; names of inner columns can be those of the table."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(20))
    rows = [(1, text("a"), "node"), (1, text("b"), "x"), (1, text("a"), "y"), (2, text("b"), "z"), (3, text("c"), "p"), (3, None, "q"), (3, "", "r"), (None, text("a"), "s"), (None, text("a"), "s"), (-5, text("d"), "t"), (-5, text("d") + " more", "u")]
    df = spark.createDataFrame([(*x, 1, 2, 3, {"k": 1}) for x in rows], "doc_id long, text string, node string, `row_` int, comp int, `order` int, m map<string,int>")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((x.doc_id or 0, x.text or "-") for x in kept.collect())
    assert got == sorted([(1, text("a")), (1, text("b")), (3, text("c")), (3, "-"), (3, "-"), (0, text("a")), (0, text("a")), next((-5, t) for t in (text("d"), text("d") + " more") if (-5, t) in got)])
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_sharding(spark):
    texts = corpus() * 3
    rows = sharding.shard(frame(spark, texts), 4).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    even = sharding.shard(frame(spark, [str(i) * 50 for i in range(1000)] + ["same" * 30] * 600), 4).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in even]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 400
    assert sharding.shard(empty(spark), 4).count() == 0
    odd = frame(spark, corpus()).selectExpr("*", "'mine' as k1", "1 as k2", "2 as size", "3 as shard", "4 as slot", "'own' as cell", "map(1, 2) as part")
    rows = sharding.shard(odd, 3)
    assert rows.columns == [*(c for c in odd.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot"]
    assert {(x.k1, x.cell, x.part[1]) for x in rows.collect()} == {("mine", "own", 2)} and rows.agg({"size": "sum"}).first()[0] == sum(len((t or "").encode()) + 1 for t in corpus())


def test_shards_are_those_of_a_sort(spark):
    """Held against one sort by the same keys that is cut where running bytes come nearest to each target; long and equal texts."""
    r = random.Random(53)
    texts = [words(r, r.choice((1, 3, 30, 2000))) for _ in range(300)] + ["equal " * 40] * 400
    df = frame(spark, texts)
    rows = sorted((tuple(x) for x in df.select(*(c.alias(k) for k, c in sharding.keys().items()), "doc_id").collect()), key=lambda x: (x[1] % 2**64, x[2] % 2**64, x[3]))
    for shards in (1, 2, 5, 16):
        total, sums = sum(x[0] for x in rows), np.cumsum([0, *(x[0] for x in rows)])
        got = {x.doc_id: (x.shard, x.slot) for x in sharding.shard(df, shards, 0.0).collect()}
        cuts = [int(np.abs(sums - i * total / shards).argmin()) for i in range(1, shards)]
        want = {}
        for a, b, k in zip([0, *cuts], [*cuts, len(rows)], range(shards), strict=True):
            want |= {x[3]: k for x in rows[a:b]}
        assert {d: k for d, (k, _) in got.items()} == want
        assert all(sorted(n for s, n in got.values() if s == k) == list(range(sum(s == k for s in want.values()))) for k in range(shards))


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*corpus(), " lead", "a  b \n c", "x<|endoftext|>  y", "日本 語。 ok! it's"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces = packing.pack(frame(spark, texts), VOCABULARY).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, ids in want.items():
        at = 0
        for p in sorted(own[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_cuts_lie_at_boundaries(spark):
    """Sequences end at sentence or document ends, but within stretches of over 1024 tokens that have none; little is padded."""
    r = random.Random(47)
    texts = [". ".join(words(r, r.randint(2, 30)) for _ in range(r.randint(1, 60))) for _ in range(150)] + [words(r, 3000)]
    pieces = packing.pack(frame(spark, texts).coalesce(1), VOCABULARY).collect()
    ends = packing.words_of(VOCABULARY).ends
    ids = {d: np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(some, key=lambda p: p.start)]) for d, some in by(pieces, "doc_id").items()}
    inside = 0
    for some in by(pieces, "sequence_id").values():
        last = max(some, key=lambda p: p.offset)
        stop, own = last.start + last.length, ids[last.doc_id]
        if stop < len(own) and not ends[own[stop - 1]]:
            before, behind = np.flatnonzero(ends[own[:stop]]), np.flatnonzero(ends[own[stop:]])
            assert (behind[0] + stop if len(behind) else len(own)) - (before[-1] + 1 if len(before) else 0) > 1024
            inside += 1
    total = packing.padding(spark.createDataFrame([(p.sequence_id, p.length) for p in pieces], "sequence_id long, length long")).first()
    assert inside and total.tokens == sum(map(len, ids.values())) and total.padding < 0.05 * total.tokens


def by(rows, key):
    out = defaultdict(list)
    for x in rows:
        out[x[key]].append(x)
    return out


def test_cuts_are_cheapest():
    r = random.Random(3)
    for _ in range(50):
        at = np.cumsum([r.randint(1, 16) for _ in range(12)]).tolist()
        fine = [r.choice((0, 3, 9)) for _ in at]
        got, _ = packing.cuts(at, fine, 16)
        best, pos = [0], [0, *at]
        for j in range(1, len(pos)):
            pad = lambda n: 0 if n & (n - 1) == 0 and n in (2, 4, 8, 16) else 16 - n
            best.append(min((best[i] + pad(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 16), default=10**6) + fine[j - 1] + packing.EACH)
        assert got == best


def test_decontamination(spark):
    r = random.Random(11)
    items = [words(r, 40) for _ in range(5)]
    edited = items[1].split()
    for k in (5, 17, 29):
        edited[k] = "other"
    texts = [words(r, 300), f"{words(r, 80)} {items[0]} {words(r, 80)}", f"{words(r, 50)} {' '.join(edited)}", items[2].upper() + "!", None, ""]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "x y z"), (10, "short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2)}
    assert got[1, 0].score == 1 and (got[1, 0].start_word, got[1, 0].end_word) == (80, 120) and got[2, 1].score < 1
    assert {x.doc_id for x in decontaminate.without_leaks(frame(spark, texts), bench).collect()} == {0, 4, 5}
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(frame(spark, texts), bench.limit(0)).count() == 0


def test_leaks_are_those_of_all_alignments(spark):
    """Held against aligning every document with every item: 10 to 60 % edits, hundreds of equal edited copies, exact copies beside, frequent words."""
    r = random.Random(23)
    speak = lambda n: [r.choice(("the", "of", "a", "in")) if r.random() < 0.3 else f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(n)]
    items = [speak(n) for n in (3, 4, 5, 6, 8, 8, 15, 25, 40, 40, 60)]

    def edited(item, share):
        out = []
        for w in item:
            out += [w] if r.random() >= share else r.choice(([], ["new"], [w, "more"], ["other"]))
        return out

    texts = [speak(r.randint(0, 300)) + edited(r.choice(items), r.choice((0.1, 0.2, 0.3, 0.45, 0.6))) + speak(r.randint(0, 300)) for _ in range(200)]
    third = [w if k % 3 < 2 else f"x{k}" for k, w in enumerate(items[8])]  # no three words in a row are left, yet half of the score
    fourth = [w if k % 4 < 3 else f"y{k}" for k, w in enumerate(items[9])]  # a quarter changed: fewer than half of the 3-grams are left
    spread = [x for w in items[7] for x in (w, "gap")]
    texts += [third, spread, items[9]] + [speak(20) + fourth + speak(20)] * 300
    ids, number = {}, lambda t: np.array([ids.setdefault(w, len(ids)) for w in t])
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if len(t) and (score := decontaminate.align(number(item), number(t))[0]) >= len(item):
                want[d, i] = score / (2 * len(item))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(frame(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert {k: x.score for k, x in got.items()} == want
    assert (200, 8) in got and (201, 7) in got and all((d, 9) in got for d in range(202, 503))
    for (d, i), x in got.items():
        assert decontaminate.align(number(items[i]), number(texts[d][x.start_word : x.end_word]))[0] == x.score * 2 * len(items[i])


def test_substrings(spark):
    r = random.Random(13)
    shared = words(r, 60)
    texts = [words(r, 200), f"{words(r, 90)} {shared} {words(r, 20)}", f"é {shared}", None, "", words(r, 50)]
    got = {x.doc_id: x for x in substrings.repeated_spans(frame(spark, texts)).collect()}
    assert set(got) == {1, 2} and got[1].is_first and not got[2].is_first
    for x in got.values():
        part = texts[x.doc_id].encode()[x.start : x.start + x["size"]]
        assert part in shared.encode() or len(part) <= len(shared.encode()) + 2
    kept = {x.doc_id: x.text for x in substrings.drop_repeats(frame(spark, texts)).collect()}
    assert kept[1] == texts[1] and len(kept[2]) < len(texts[2]) and kept[3] is None
    for _, start, size in substrings.Chunker()([t.encode() for t in texts if t]):
        assert start[0] == 0 and (start[1:] == (start + size)[:-1]).all()
    assert substrings.repeated_spans(empty(spark)).count() == 0 and substrings.drop_repeats(empty(spark)).count() == 0


def test_repeated_spans_are_those_of_all_chunks(spark, monkeypatch):
    """Held against a plain comparison of the bytes of all chunks; very long texts, repeated rows, texts of one id, hot chunks, periods."""
    monkeypatch.setattr(skew, "LEAST", 2)
    r = random.Random(19)
    passages = [words(r, 51) for _ in range(40)]
    texts = [" ".join([words(r, r.randint(0, 60)), *r.sample(passages, r.randint(0, 3)), words(r, r.randint(0, 40))]) for _ in range(80)]
    texts += [passages[0]] * 20 + [words(r, 30_000) + passages[1], "the " * 200, "x the " + "the " * 100, "é" * 300, "ü" * 300, "", None]
    ids = [*range(len(texts) - 3), 2, 3, None]
    ids[90] = ids[91]  # repeated rows
    df = frame(spark, texts, ids)
    own = {}
    for d, t in zip(ids, texts, strict=True):
        if t and d is not None:
            raw = t.encode()
            ((_, start, size),) = substrings.Chunker()([raw])
            good = substrings._telling(raw, start, size)
            own[d, t] = [(a, raw[a : a + n]) for a, n, g in zip(start.tolist(), size.tolist(), good, strict=True) if g]
    holders = defaultdict(set)
    for (d, _), some in own.items():
        for _, c in some:
            holders[c].add(d)
    want = []
    for (d, t), some in own.items():
        run = []
        for a, c in [*some, (-1, b"")]:
            if run and (a != run[-1][0] + len(run[-1][1]) or len(holders[c]) < 2):
                size = sum(len(x) for _, x in run)
                if size >= substrings.SPAN:
                    want.append((d, run[0][0], size, len(run), min(min(holders[x]) for _, x in run), all(min(holders[x]) == d for _, x in run)))
                run = []
            if len(holders[c]) > 1:
                run.append((a, c))
    got = [(x.doc_id, x.start, x["size"], x.chunks, x.first_doc, x.is_first) for x in substrings.repeated_spans(df).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
    kept = substrings.drop_repeats(df.withColumn("spans", df.n).withColumn("text_hash", df.n).withColumn("k", df.n))
    assert kept.count() == len(texts) and kept.columns[-3:] == ["spans", "text_hash", "k"]


def test_passages_of_51_words_are_found():
    """Of 400 passages in other surroundings at most one in a hundred is missed."""
    r, missed = random.Random(29), 0
    for _ in range(400):
        p = words(r, 51)
        sides = [f"{words(r, 20)} {p} {words(r, 20)}".encode() for _ in "ab"]
        (_, s1, n1), (_, s2, n2) = substrings.Chunker()(sides)
        other = {sides[1][a : a + n] for a, n in zip(s2.tolist(), n2.tolist(), strict=True)}
        best = run = 0
        for a, n in zip(s1.tolist(), n1.tolist(), strict=True):
            run = run + n if sides[0][a : a + n] in other else 0
            best = max(best, run)
        missed += best < substrings.SPAN
    assert missed <= 4, missed


def test_toxicity(spark):
    r = random.Random(17)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        texts.append(words(r, 40) + (" you grimble fool" if bad else "") + (" grimbledon park" if i % 4 == 1 else ""))
        labels.append((i, int(bad)))
    docs = frame(spark, [*texts, None, "", "GR1MBLE"])
    known = spark.createDataFrame([*labels, (None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert got[600] < 0.5 and got[601] < 0.5 and got[602] >= 0.5
    assert toxicity.train(docs, known.limit(0)).weights == {}
    assert toxicity.fold("Ѕtüpid 1d10t!") == " stupid idiot "
    m = toxicity.Model({" grim": 1.0}, [" grimbledon "], []).matcher()
    assert m.hits(" grimbledon ") == [] and len(m.hits(" grimble grimbledon ")) == 1


def test_toxicity_of_many_patterns_and_of_none(spark):
    """A lexicon and exceptions of any size; nothing to learn from; clean_rows with columns named like inner ones."""
    r = random.Random(37)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiou") for _ in range(4))
    bad = sorted({word() for _ in range(2600)})
    texts = [" ".join([words(r, 20), *(bad[(25 * (i // 2) + k) % len(bad)] for k in range(25))]) if i % 2 else words(r, 25) for i in range(8000)]
    docs = frame(spark, texts).withColumn("score", F.lit(9.0)).withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert sum(p.count(" ") == 2 for p in model.weights) > 2300
    kept = toxicity.clean_rows(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id % 2 for x in kept.select("doc_id").collect()} == {0} and kept.count() == 4000
    assert kept.agg({"score": "min"}).first()[0] == 9.0
    dull = frame(spark, [words(random.Random(5), 30)] * 200)
    half = labels.filter("doc_id < 200")
    assert toxicity.clean_rows(dull, half).count() == 200 and toxicity.clean_rows(dull, half.limit(0)).count() == 200
    assert toxicity.clean_rows(empty(spark), labels).count() == 0


def test_toxicity_held_out(spark):
    """Accuracy on rows that the model never saw: toxic words in varied spelling, within clean rows' words and beside them."""
    r = random.Random(43)
    bad = ["grimble", "snarkle", "blugger", "vexpit"]
    disguise = lambda w: "".join({"i": "1", "e": "3", "a": "а", "o": "0"}.get(c, c) if r.random() < 0.4 else c for c in w)
    rows = []
    for i in range(3000):
        toxic = r.random() < 0.2
        text = words(r, r.randint(5, 80)).split()
        for _ in range(r.randint(1, 4) if toxic else 0):
            text.insert(r.randrange(len(text)), disguise(r.choice(bad)))
        if r.random() < 0.3:
            text.insert(0, "grimbledon")
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    held = [(x.score >= 0.5, rows[x.doc_id][2]) for x in toxicity.toxicity(docs, model).collect() if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(held) > 500 and sum(p == bool(y) for p, y in held) / len(held) > 0.98


def test_url_filters(spark):
    entries = spark.createDataFrame([("a.example.com", "x", 5, "add"), ("a.example.com", "x", 9, "remove"), ("example.com", "y", 7, "add"), ("a.example.com/p", "z", 0, "add"), (None, "x", 0, "add"), ("b.org", "x", 3, "add"), ("b.org", "x", 3, "remove")], "key string, list string, at int, action string")
    pages = spark.createDataFrame([(1, "http://A.example.com/q", 4), (2, "http://a.example.com/q", 5), (3, "https://u@a.example.com:80/p/r?x", 8), (4, "http://a.example.com", 9), (5, None, 5), (6, "nonsense", 5), (7, "http://b.org/", None), (8, "http://b.org/", 4)], "page_id long, url string, at int")
    got = {r.page_id: (r.n_active, r.lists, r.matched) for r in url_filters.evaluate(pages, entries).collect()}
    assert got == {1: (0, None, None), 2: (1, "x", "a.example.com"), 3: (3, "x,y,z", "a.example.com/p"), 4: (1, "y", "example.com"), 5: (0, None, None), 6: (0, None, None), 7: (0, None, None), 8: (0, None, None)}
    assert url_filters.evaluate(pages.limit(0), entries).count() == 0 and url_filters.evaluate(pages, entries.limit(0)).count() == 8


def test_url_filters_of_deep_and_capital_folders(spark):
    entries = spark.createDataFrame([("h.org/a/b/c/d", "deep", 0, "add"), ("H.org/Ads", "case", 0, "add"), ("h.ORG/Ads", "case", 9, "remove")], "key string, list string, at int, action string")
    pages = spark.createDataFrame([(1, "http://h.org/a/b/c/d/e?x", 5), (2, "http://h.org/a/b/c", 5), (3, "http://h.org/Ads/x", 5), (4, "http://h.org/ads/x", 5), (5, "http://h.org/Ads/x", 9)], "page_id long, url string, at int")
    got = {r.page_id: r.matched for r in url_filters.evaluate(pages, entries).collect()}
    assert got == {1: "h.org/a/b/c/d", 2: None, 3: "h.org/Ads", 4: None, 5: None}


def test_url_filters_of_hot_keys_and_clashing_names(spark, monkeypatch):
    """Held against a plain reading of the dated entries, with one hot host, many entries of a key, and addresses."""
    monkeypatch.setattr(url_filters, "CELL", 8)
    r = random.Random(31)
    names = ["hot.org", "b.hot.org", "hot.org/x", "hot.org/X", "10.0.0.1", "0.1", "[::1]", "other.net"]
    entries = [(r.choice(names), r.choice("pq"), r.randint(0, 50), r.choice(("add", "remove"))) for _ in range(300)]
    urls = ["http://hot.org/x/y"] * 300 + ["http://b.hot.org/X", "http://hot.org/X", "http://10.0.0.1/", "http://[::1]:80/q", "http://other.net"] * 6 + [None, "nonsense"]
    rows = [(u, r.randint(0, 60) if i % 50 else None, "key", "cell", i) for i, u in enumerate(urls)] + [("http://hot.org/x/y", 7, "same", "row", 1)] * 200
    pages = spark.createDataFrame(rows, "url string, at int, key string, lists string, n_active int")
    own = {"http://hot.org/x/y": ["hot.org", "hot.org/x"], "http://b.hot.org/X": ["b.hot.org", "hot.org"], "http://hot.org/X": ["hot.org", "hot.org/X"], "http://10.0.0.1/": ["10.0.0.1"], "http://[::1]:80/q": ["[::1]"], "http://other.net": ["other.net"]}

    def plain(url, at):
        on = []
        for k in own.get(url, ()) if at is not None else ():
            for name in "pq":
                past = [(t, action) for key, x, t, action in entries if (key, x) == (k, name) and t <= at]
                if past and max(past)[1] == "add":
                    on.append((k, name))
        return len(on), ",".join(sorted({x for _, x in on})) or None

    got = url_filters.evaluate(pages, spark.createDataFrame(entries, "key string, list string, at int, action string"))
    assert got.columns == ["url", "at", "key", "n_active", "lists", "matched"]
    assert sorted((x.url or "", -1 if x.at is None else x.at, x.n_active, x.lists or "") for x in got.collect()) == sorted((u or "", -1 if t is None else t, plain(u, t)[0], plain(u, t)[1] or "") for u, t, *_ in rows)


def test_chat(spark):
    turns = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", None), (None, 0, "u", "lost"), (5, 0, "u", "hi"), (5, 1, "a", "no")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.render(df).collect()}
    assert got == {1: (2, 2), 4: (1, 1), 5: (2, 1)}
    assert chat.render(df.limit(0)).count() == 0
    odd = df.selectExpr("*", "1 as n_turns", "2 as copies", "3 as n", "true as last", "4 as h1", "'x' as chat")
    assert {r.conv_id: (r.n_turns, r.copies) for r in chat.render(odd.unionByName(odd.filter("conv_id = 5"))).collect()} == {1: (2, 2), 4: (1, 1), 5: (4, 1)}
    long = spark.createDataFrame([(k, t, "u", f"{t} " * 50) for k in (1, 2) for t in range(2000 - k)], "conv_id long, turn long, role string, text string")
    (only,) = chat.render(long.unionByName(spark.createDataFrame([(3, 0, None, None), (4, 0, "", "")], long.schema))).filter("conv_id < 3").collect()
    assert (only.conv_id, only.n_turns) == (1, 1999) and only.chat.count("<|end|>") == 1999


def test_secrets(spark):
    inner = 'password = "hunter22222"'
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    texts = [f"x {inner} y", f"x {packed} y", "a password%3D%22abcdefghijk z", base64.b64encode(base64.b64encode(inner.encode())).decode(), "password: token: abcdefghijk", "AKIA" + "Z" * 12 + " " + "0f" * 16, None, "", "ſecret=abcdefghijk"]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    assert got[0].n_assign == 1 and got[0].spans == f"assign:2:{len(inner) + 1}"
    assert got[1].n_assign == 0 and got[1].spans == f"assign:2:{2 + len(packed)}"
    assert got[2].n_decoded == 1 and got[3].n_decoded == 1
    assert got[4].spans == "" and (got[5].n_access, got[5].n_hex) == (1, 1)
    assert got[6].spans == got[7].spans == got[8].spans == ""
    kept = {r.doc_id: r for r in secrets.mask_secrets(frame(spark, texts)).collect()}
    assert kept[1].text == "x [secret] y" and kept[1].n_chars == 12 and kept[6].text is None
    assert secrets.scan_secrets(empty(spark)).count() == 0


def plain_spans(text):
    """The base spans by a plain reading of their definition, character by character."""
    out, letters, hexes = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), set("0123456789abcdef")
    low = "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        end = next((i + len(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(w, i)), None)
        if end is not None:
            at = end + (text[end : end + 1] in ("'", '"') and end < len(text))
            while text[at : at + 1] == " ":
                at += 1
            if text[at : at + 1] in (":", "=") and at < len(text):
                at += 1
                while text[at : at + 1] == " ":
                    at += 1
                at += text[at : at + 1] in ("'", '"') and at < len(text)
                stop = at
                while stop < len(text) and text[stop] in letters:
                    stop += 1
                if stop > at:
                    if stop - at >= 8:
                        out.append((i, 0, stop))
                    i = stop
                    continue
        i += 1
    for kind, first, more, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", hexes, 32)):
        i = 0
        while i < len(text):
            stop = i + len(first)
            if text.startswith(first, i):
                while stop < len(text) and text[stop] in more:
                    stop += 1
                if stop - i >= least:
                    out.append((i, kind, stop))
                if stop > i + len(first):
                    i = stop
                    continue
            i += 1
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_are_those_of_a_plain_reading(spark):
    r = random.Random(59)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "hunter22", "x", "abcdefgh", "é", "ſecret", "AKIA", "ABCDEFGH12345", "AKIAZ", "0f" * 15, "a", "9", "0123456789abcdef", "-", "_", "\n", "%20", "%3D"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [None, "token=" + "a" * 300_000]
    for x in secrets.scan_secrets(frame(spark, texts)).collect():
        t = texts[x.doc_id] or ""
        want = plain_spans(t)
        assert x.base_sha256 == sha256(want.encode()).hexdigest(), t
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(w.startswith(k) for w in want.split(",")) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))


def test_secrets_in_long_runs():
    """Runs without white space take linear time, and URL escapes behind them are found."""
    text = "%41 " + "a1Z_" * 250_000 + "%20token%3Dabcdefghijk"
    base, added = secrets.find_secrets(text)
    assert base == [] and added == [("assign", 4, len(text))]


def test_secrets_encoded_in_part():
    """Single escapes anywhere in a secret, within its text; forms; base64 over line ends."""
    find = lambda t: {k for k, _, _ in secrets.find_secrets(t)[1]}
    for t in ("token\\u003dabcdefgh1234", "\\u0070\\u0061\\u0073\\u0073word=hunter22222", "password=%68unter22222", 'secret: "ab%2Fcdefghijk"', "password+%3D+hunter22222"):
        assert secrets.find_secrets(f"see {t} now")[1] == [("assign", 4, 4 + len(t.rstrip('"')))], t
        assert find("x " + base64.b64encode(f"see {t} now".encode()).decode()) == {"assign"}, t
    for kind, t, must in (("assign", "password=hunter22", range(17)), ("access", "AKIA" + "Z" * 12, range(16)), ("hex", "0f" * 16, range(32))):
        for k in must:
            for code in (f"\\u{ord(t[k]):04x}", f"%{ord(t[k]):02X}", f"&#{ord(t[k])};"):
                assert kind in find(f"é {t[:k]}{code}{t[k + 1:]} z"), (t, k, code)
    assert secrets.find_secrets("password=abcdefgh%20x y")[1] == [] and secrets.find_secrets("token=abcdefgh+ijk 5%20")[1] == []
    packed = base64.b64encode(b"some words before password = hunter22222 and some behind").decode()
    for width in (4, 10, 64):
        for head in ("", "word\n", "of\r\n"):
            lines = "\n".join(packed[i : i + width] for i in range(0, len(packed), width))
            assert find(f"a b: {head}{lines}\nthe end") == {"assign"}, (width, head)


def test_secrets_in_odd_layers():
    """Layers with marks, control characters, odd bytes and damage are scanned, and compressed ones to their end."""
    pack = lambda raw: base64.b64encode(raw).decode()
    secret = b"password=hunter22222"
    for raw in (b"\xef\xbb\xbf" + secret, b"\xc2\xa0\x0c\x1b" + secret, b"caf\xe9 " * 9 + secret, secret + b" \xc3", b"x" + secret):
        for whole in (raw, gzip.compress(raw), zlib.compress(raw), gzip.compress(b"other") + gzip.compress(raw)):
            t = pack(whole)
            assert secrets.find_secrets(f"a {t} b")[1] == [("assign", 2, 2 + len(t))], whole
    far = b"\xc3\xa9\n" * (secrets.LAYER_BYTES // 3 + 100_000) + b" " + secret
    assert secrets.find_secrets(pack(zlib.compress(far)))[1]
    assert secrets.examine(pack(zlib.compress(far)))[2] > 10**7 > secrets.examine("a plain text")[2] == 0
    over = b"\n" * (secrets.LAYER_BYTES - 10) + secret + b"\n" * 100
    assert secrets.find_secrets(pack(zlib.compress(over)))[1]
    noise = np.random.RandomState(5).bytes(30_000)
    assert secrets.find_secrets(pack(zlib.compress(secret + b" " + noise)[:20_000]))[1]
    t = base64.encodebytes(gzip.compress(words(random.Random(1), 60).encode() + b" " + secret)).decode()
    assert secrets.find_secrets(f"of\n{t}end")[1] == [("assign", 3, 3 + len(t.rstrip()))]


def test_exceptions_cover_their_hits():
    r = random.Random(3)
    m = toxicity.Model({" ba": 1.0, "ad ": 2.0, " bad ": 3.0}, [" bald ", " bad cat ", " cab "], []).matcher()
    for _ in range(300):
        folded = f" {' '.join(r.choice(['bad', 'bald', 'cat', 'cab', 'mad']) for _ in range(r.randint(0, 9)))} "
        found = [(end + 1 - len(p), end + 1, p, w) for end, (p, w) in m.automaton.iter(folded)]
        spared = [x for x in found if x[3] is None]
        assert m.hits(folded) == [x for x in found if x[3] is not None and not any(s[0] <= x[0] and x[1] <= s[1] for s in spared)]


def test_gif(spark):
    for k in range(40):
        r = random.Random(k)
        data = bytes(r.choice(range(r.choice([1, 2, 3, 256]))) for _ in range(r.randint(1, 12000)))
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    for k in range(60):
        r = random.Random(k)
        kind = range(r.choice([1, 3, 30, 256]))
        some = [bytes(r.choice(kind) for _ in range(gif.PIXELS)) for _ in range(3)]
        payload = b"".join(r.choice([*some, b" " * gif.PIXELS]) for _ in range(r.randint(1, 14)))
        frames = list(gif.decode_gif(gif.encode_gif(payload)))
        assert b"".join(map(gif.samples, frames)) == payload
        assert b"".join(bytes(32 if not p[3] else p[0] for row in c[:rows] for p in row) for c, rows in plain_gif(gif.encode_gif(payload))) == payload
    payload = gif.to_payload("the same line again\n" * 3000)[1]
    media = gif.encode_gif(payload)
    frames = list(gif.decode_gif(media))
    assert len(media) < len(payload) / 4 and {f.disposal for f in frames} == {1, 2, 3} and min(f.height for f in frames) < max(f.height for f in frames)
    media = gif.gif_media(frame(spark, ["abc", None, "", "abc", "é " * 200_000]))
    got = {r.doc_id: r for r in gif.gif_columns(media).collect()}
    assert all(got[k].payload_bytes == 576 and got[k].error is None for k in range(4)) and got[0].media_sha256 == got[3].media_sha256
    for k, t in enumerate(("abc", "", "", "abc", "é " * 200_000)):
        n, payload = gif.to_payload(t)
        assert (got[k].n_bytes, got[k].payload_sha256, got[k].tail_crc32) == (n, sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    broken = spark.createDataFrame([(1, 5, bytearray(gif.encode_gif(payload)[:1500])), (2, None, bytearray(b"no")), (3, 0, None), (None, 1, bytearray(gif.encode_gif(payload)))], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in gif.gif_columns(broken).collect()}
    assert rows[1].error and rows[2].error and rows[3].error is None and rows[3].frames == [] and rows[None].error is None
    assert gif.gif_frames(gif.gif_columns(broken)).filter("doc_id is null").agg({"delay": "sum"}).first()[0] == len(payload) // gif.WIDE
    assert gif.gif_columns(gif.gif_media(empty(spark))).count() == 0


def plain_gif(data):
    """(canvas, delay) of each frame by a slow reader of its own: codes bit by bit, a list for each table entry, pixel by pixel."""
    wide, high, flags = data[6] | data[7] << 8, data[8] | data[9] << 8, data[10]
    colours = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(2 << (flags & 7))]
    at = 13 + 3 * len(colours)
    canvas = [[(0, 0, 0, 0)] * wide for _ in range(high)]
    while data[at] != 0x3B:
        assert data[at : at + 3] == b"\x21\xf9\x04"
        bits, delay, clear = data[at + 3], data[at + 4] | data[at + 5] << 8, data[at + 6]
        at += 8
        x, y, w, h = (data[at + 1 + 2 * k] | data[at + 2 + 2 * k] << 8 for k in range(4))
        laced, depth, at = data[at + 9] & 0x40, data[at + 10], at + 11
        stream = b""
        while data[at]:
            stream, at = stream + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        number, place, pixels, table, old = int.from_bytes(stream, "little"), 0, [], [], None
        while True:
            width = min(12, len(table).bit_length()) if table else depth + 1
            code, place = number >> place & (1 << width) - 1, place + width
            if code == 1 << depth:
                table, old = [[i] for i in range(1 << depth)] + [None, None], None
            elif code == (1 << depth) + 1:
                break
            else:
                entry = table[code] if code < len(table) else old + old[:1]
                if old is not None and len(table) < 4096:
                    table.append(old + entry[:1])
                pixels, old = pixels + entry, entry
        rows = [r for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, s)] if laced else range(h)
        before = [list(r) for r in canvas]
        for k, r in enumerate(rows):
            for c in range(w):
                if not (bits & 1 and pixels[k * w + c] == clear):
                    canvas[y + r][x + c] = (*colours[pixels[k * w + c]], 255)
        yield [list(r) for r in canvas], delay
        if bits >> 2 & 7 == 2:
            for r in range(h):
                canvas[y + r][x : x + w] = [(0, 0, 0, 0)] * w
        elif bits >> 2 & 7 == 3:
            canvas = before


def test_broken_gifs_end_with_one_kind_of_error():
    r = random.Random(71)
    whole = gif.encode_gif(gif.to_payload("the same line again\n" * 200 + words(r, 300))[1])
    ended = 0
    for _ in range(400):
        data = bytearray(whole[: r.randint(0, len(whole))] if r.random() < 0.3 else whole)
        for _ in range(r.randint(0, 8) if data else 0):
            data[r.choice((r.randrange(len(data)), min(len(data) - 1, r.randrange(900))))] = r.randrange(256)
        try:
            for _ in gif.decode_gif(bytes(data)):
                pass
        except ValueError:
            ended += 1
    assert ended > 100


def test_gif_disposal():
    def image(x, y, w, h, pixels, bits=0, clear=None, dispose=0):
        control = b"\x21\xf9\x04" + bytes([dispose << 2 | (clear is not None), 5, 0, clear or 0, 0])
        return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([bits]) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(pixels), 2))

    palette = bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))
    data = b"GIF89a" + (2).to_bytes(2, "little") * 2 + bytes((0x81, 0, 0)) + palette + image(0, 0, 2, 2, [1, 1, 1, 1]) + image(0, 0, 1, 1, [2], dispose=2) + image(1, 1, 1, 1, [3], dispose=3) + image(0, 0, 2, 1, [3, 0], clear=0) + b"\x3b"
    f = [x.rgba for x in gif.decode_gif(data)]
    assert f[1][0, 0].tolist() == [0, 255, 0, 255] and f[2][0, 0].tolist() == [0, 0, 0, 0] and f[2][1, 1].tolist() == [0, 0, 255, 255]
    assert f[3][1, 1].tolist() == [255, 0, 0, 255] and f[3][0, 0].tolist() == [0, 0, 255, 255] and f[3][0, 1].tolist() == [255, 0, 0, 255]


NAMES = """a b c k n t d1 d2 h0 h1 h2 g cell cells rows_ node comp rep row row_ order score size shard slot k1 k2 part url key list since until last many
item item_id gram times words hits block scale unit start_word end_word passage first n_words doc_id_ text_hash spans run fresh start chunks first_doc is_first lo hi stay
media n_bytes frames frame delay error ids length offset sequence_id doc_tokens prefix set_hash b0 p p0 n0 toxic label salt found z za zb id s w b f x y""".split()


def test_any_names_of_further_columns(spark):
    """Each function on documents with a column of each inner and outer name, a map among them, repeated rows, null ids and a very long text."""
    r = random.Random(61)
    item = words(r, 30)
    base = [words(r, 40), words(r, 40), f"{words(r, 9)} {item}", "password = hunter22222 " + words(r, 9), "so grimble " * 4, "", None]
    rows = [(i, t) for i, t in enumerate(base)] + [(0, base[0]), (None, base[1]), (None, None), (100, words(r, 40_000)), (101, "x" * 300_000)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = list(dict.fromkeys(NAMES))
    docs = plain.select("*", *(F.lit(f"own {n}").alias(n) for n in names if n != "z"), F.expr("map('k', 1)").alias("z"))
    labels = spark.createDataFrame([(i, int(i == 4)) for i in range(5)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, item, "own")], "item_id long, text string, doc_id string")
    model = toxicity.Model({" grimble ": 1.0}, [], [-3.0, 9.0, 0.0, 0.0, 0.0])
    every = {
        "sharding": (sharding.shard, {"size", "shard", "slot"}), "one_of_each": (ngram_join.one_of_each, set()), "clean_rows": (lambda d: toxicity.clean_rows(d, labels), set()), "toxicity": (lambda d: toxicity.toxicity(d, model), {"score"}),
        "without_leaks": (lambda d: decontaminate.without_leaks(d, bench), set()), "drop_repeats": (substrings.drop_repeats, set()), "mask_secrets": (secrets.mask_secrets, set()),
        "ngram_join": (ngram_join.ngram_join, None), "leaks": (lambda d: decontaminate.leaks(d, bench), None), "spans": (substrings.repeated_spans, None), "pack": (lambda d: packing.pack(d, VOCABULARY), None),
        "scan": (secrets.scan_secrets, None), "gif": (lambda d: gif.gif_columns(gif.gif_media(d)), None),
    }
    for name, (f, new) in every.items():
        got, alone = f(docs), f(plain)
        if new is not None:
            assert set(got.columns) == set(docs.columns) | new, name
            kept = got.collect()
            assert all(x[n] == f"own {n}" for x in kept for n in names if n not in new and n != "z") and all(x.z == {"k": 1} for x in kept), name
        own = [c for c in alone.columns if c not in ("slot", "media", "frames", "sequence_id", "offset")]
        digest = lambda d, own=own: sorted(map(repr, d.select(*own).collect()))
        assert digest(got) == digest(alone), name


def test_pipeline(spark, tmp_path):
    """Every stage held against brute force over a small corpus: which rows stay, their texts, and their tokens."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    r = random.Random(67)
    items = [words(r, 40) for _ in range(3)]
    rows = []
    for i in range(500):
        text = words(r, r.randint(5, 120))
        kind = i % 10
        if kind == 1:
            text += " you grimble"
        elif kind == 2:
            text += " " + items[i % 3]
        elif kind == 3:
            text += " password = hunter22222 and more"
        elif kind == 4 and i > 10:
            near = rows[i - 10 - 4][1].split()
            near[len(near) // 2] = "changed"
            text = " ".join(near)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(500, None, "en", "s", None), (501, "", "de", "s", 0)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, int(i % 10 == 1)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    stay = [x for x in rows if " grimble" not in (x[1] or "")]
    s, label = brute_components([x[1] for x in stay])
    stay = [x for x, own, c in zip(stay, s, label, strict=True) if not own or stay[c] is x]
    stay = [x for x in stay if not any(i in (x[1] or "") for i in items)]
    want = {x[0]: x[1] and x[1].replace("password = hunter22222", "[secret]") for x in stay}
    assert 200 < len(want) < 380
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, at))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x.doc_id: x.text for x in docs.collect()} == want and all(x.n_chars == (None if x.text is None else len(x.text)) for x in docs.collect())
    tokenizer, got = Tokenizer.from_file(VOCABULARY), defaultdict(list)
    for p in pipeline.run(spark, at).collect():
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for d, some in got.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(some, key=lambda p: p.start)]).tolist()
        assert ids == [*tokenizer.encode(want[d] or "", add_special_tokens=False).ids, 0]


def test_entry_lists_every_query():
    entry = pytest.importorskip("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
