"""Corpus operators against brute force on small tables, and on rows that are odd."""

import hashlib
import random
import shutil
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlow.llm import bpe, common, components, decontaminate, jaccard_join, langid, ngram_lm, quality, sharding, suffix_dedup, toxicity, urlfilter
from marlow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, path string"


def frame(spark, rows):
    """(doc_id, text, lang) rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, la, "src0", len(t or ""), 0.0, 1, "x") for i, t, la in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null and empty texts, blanks, null and repeated ids, repeated rows, a very long text."""
    rng = random.Random(5)
    long_text = words(rng, 30_000)
    base = words(rng, 120)
    return [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, base, "en"), (5, base, "de"), (6, base.replace("w1 ", "zz "), "de"), (7, long_text, "en"), (8, long_text[:5000] + " tail", "en"),
        (8, "same id other text", "en"), (9, "twice the same row", None), (9, "twice the same row", None), (None, base, "en"), (None, None, None), (10, "é" * 60 + " 日本語 " + "x" * 60, "fr"), (11, "y" + "é" * 60, "fr"),
    ]


# --- 9 -------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    texts = [t for _, t, _ in odd] + ["it's we'll<|endoftext|>  I'M 123", "a\u00a0b\x85\x1c c", "\U0001f600 \u0301x", "''''s"]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.bpe_map(df, tokenizer_path(), bpe.digests, bpe.DIGESTS).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(df, tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, tokenizer_path()).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.encode_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_bpe_piece_equals_plain_merging():
    model = bpe.load(tokenizer_path())
    rng = random.Random(3)

    def plain(piece):
        ids = [model.byte_id[b] for b in piece]
        while True:
            found = [(model.merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in model.merges]
            if not found:
                return tuple(ids)
            (_, new), i = min(found)
            ids[i:i + 2] = [new]

    for _ in range(500):
        piece = "".join(rng.choice("etaoinshr ") for _ in range(rng.randrange(1, 30))).encode()
        assert model.encode_piece(piece) == plain(piece)


def test_bpe_cache_grows_old(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    model = bpe.ByteBPE(tokenizer_path())
    rng = random.Random(18)
    for _ in range(60):
        text = words(rng, 12, 300) + " the the"
        assert model.encode(text) == bpe.load(tokenizer_path()).encode(text)
        assert len(model.cache) + len(model.cache.old) < 80
    assert " the" in model.cache


# --- 10 ------------------------------------------------------------------------------------------


def check_shards(df, shards):
    """The law: no shard is further from the mean than the largest row; slots have no gap."""
    rows = sharding.shard_by_splitters(df, shards=shards).collect()
    assert len(rows) == df.count()
    size, slots = Counter(), {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / shards
    largest = max(r.size for r in rows)
    assert max(size.values()) - mean <= largest and mean - min(size[k] for k in range(shards)) <= largest
    return rows


def shards_by_force(spark, df, shards):
    """(id, size, crc, shard, slot) of each row: rows in order of key, shards by their middles, small groups moved whole."""
    seen, keys = Counter(), []
    for r in df.collect():
        t = (r.text or "").encode()
        k = (r.doc_id, len(t) + 16, zlib.crc32(t))
        keys.append((*k, seen[k]))
        seen[k] += 1
    ties = spark.createDataFrame(keys, "id long, size long, crc long, k long").select("id", "size", "crc", F.pmod(F.xxhash64("id", "crc", "k"), F.lit(1 << 32)).alias("tie")).collect()
    rows = sorted(((r.crc, r.tie, r.id is not None, r.id or 0, r.size, r.id) for r in ties))
    total, largest, at = sum(r[4] for r in rows), max((r[4] for r in rows), default=0), 0
    out, groups = [], {}
    for r in rows:
        out.append([r, min(shards - 1, int((at + r[4] / 2) * shards / total))])
        groups.setdefault(r[0], [at, 0])[1] += r[4]
        at += r[4]
    for o in out:
        began, size = groups[o[0][0]]
        if size <= largest:
            o[1] = min(shards - 1, int((began + size / 2) * shards / total))
    slots = Counter()
    done = []
    for r, shard in out:
        done.append((r[5], r[4], r[0], shard, slots[shard]))
        slots[shard] += 1
    return sorted(done, key=str)


def test_shards_equal_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 50)
    rng = random.Random(12)
    hot = words(rng, 30)
    rows = [(i, hot if i % 3 == 0 else words(rng, rng.randrange(2, 40)), "en") for i in range(1500)]
    rows += [(5000 + i, t, "en") for i in range(60) for t in [words(rng, 4)] for _ in range(3)] + [(7, "the same row", "en")] * 120 + [(9000 + i, "copies of one text", "de") for i in range(40)]
    for some, shards in ((rows, 8), (rows, 40), (odd, 5)):
        df = frame(spark, some)
        want = shards_by_force(spark, df, shards)
        for cut in (df, df.repartition(7)):
            got = sharding.shard_by_splitters(cut, shards=shards, ranges_per_shard=3, samples_per_range=5, leaf_rows=4).collect()
            assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == want


def test_sharding(spark, odd):
    rng = random.Random(1)
    hot = words(rng, 40)
    rows = [(i, hot if i % 3 == 0 else words(rng, rng.randrange(5, 80)), "en") for i in range(4000)]
    got = check_shards(frame(spark, rows), 8)
    texts = dict((i, t) for i, t, _ in rows)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 16 for r in got)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    few = check_shards(frame(spark, odd), 40)
    assert all(0 <= r.shard < 40 for r in few)
    assert Counter((r.doc_id, r.size) for r in few) == Counter((i, len((t or "").encode()) + 16) for i, t, _ in odd)
    assert sharding.shard_by_splitters(frame(spark, [])).count() == 0


def test_sharding_of_repeated_rows(spark):
    """Equal rows, and null ids with one text, in number: they are divided, too."""
    rng = random.Random(3)
    equal = frame(spark, [(1, "twenty-five bytes of text", "en")]).crossJoin(spark.range(30_000)).drop("id")
    small = frame(spark, [(i, words(rng, 3), "en") for i in range(1000)])
    assert len({r.shard for r in check_shards(equal.unionByName(small), 40)}) == 40
    nulls = frame(spark, [(None, "a text", "en")]).crossJoin(spark.range(20_000)).drop("id")
    assert len({r.shard for r in check_shards(nulls, 40)}) == 40
    few_leaves = sharding.shard_by_splitters(small, shards=4, leaves=10).collect()
    assert sorted(r.slot for r in few_leaves if r.shard == 2) == list(range(sum(r.shard == 2 for r in few_leaves)))


# --- 1 -------------------------------------------------------------------------------------------


def test_toxicity_holds_out(spark, odd):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        t = words(rng, 60)
        bad = i % 6 == 0
        rows.append((i, t + (" you moron scum" if bad else ""), "en"))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    docs, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held) and len(held) > 200
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark, odd), model).collect())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 1200 <= kept.count() <= 1290
    none = toxicity.train(docs.where("false"), lab.where("false"))
    assert {r.predicted for r in toxicity.score(frame(spark, odd), none).collect()} == {0}
    assert toxicity.score(frame(spark, []), model).count() == 0 == toxicity.drop_toxic(frame(spark, []), model).count()


def test_nnpu_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    p, u = (rng.random((50, 20)) < 0.3).astype(np.float32), (rng.random((400, 20)) < 0.3).astype(np.float32)
    p[:, 0], u[:40, 0], u[40:, 0] = 1, 1, 0
    w, b = toxicity.fit_nnpu(p, u, 0.1)
    assert w[0] == w.max() and w[0] + b + np.abs(w[1:]).max() > 0 > b


def test_nnpu_equals_brute_force():
    """Adam by a gradient that is found row by row, through steps in which the negative risk is below zero."""
    rng = np.random.default_rng(4)
    p, u = (rng.random((12, 4)) < 0.5).astype(np.float32), (rng.random((20, 4)) < 0.4).astype(np.float32)
    p[:, 0], u[:4, 0], u[4:, 0] = 1, 1, 0  # a prior of 0.6 claims more positives than one row in five shows
    prior, rate, l2, steps = 0.6, 0.3, 0.01, 8
    theta, m, v, below = np.r_[np.zeros(4), np.log(prior / (1 - prior))], np.zeros(5), np.zeros(5), 0
    for step in range(1, steps + 1):
        sums = {"p+": 0.0, "p-": 0.0, "u-": 0.0}
        slope = {k: np.zeros(5) for k in sums}
        for kind, rows, y in (("p+", p, 1), ("p-", p, -1), ("u-", u, -1)):
            for r in rows:
                x = np.r_[r, 1.0]
                sums[kind] += np.log(1 + np.exp(-y * (x @ theta))) / len(rows)
                slope[kind] += -y * x / (1 + np.exp(y * (x @ theta))) / len(rows)
        negative, g_negative = sums["u-"] - prior * sums["p-"], slope["u-"] - prior * slope["p-"]
        below += negative < 0
        g = (prior * slope["p+"] + g_negative if negative >= 0 else -g_negative) + l2 * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    w, b = toxicity.fit_nnpu(p, u, prior, steps=steps, rate=rate, l2=l2)
    assert 0 < below < steps and np.allclose(np.r_[w, b], theta, atol=0.04) and abs(theta[0]) > 1


# --- 2 -------------------------------------------------------------------------------------------


def test_language(spark, odd):
    rng = random.Random(4)
    make = {"aa": "bababo kabobi", "xx": "zuzexu zezuxe"}
    rows = [(i, " ".join(rng.choice(make[la].split()) + rng.choice(make[la].split())[:3] for _ in range(10)), la) for i in range(300) for la in ["aa" if i % 2 else "xx"]]
    docs = frame(spark, [*rows, (900, None, "aa"), (901, "123 !!", "aa"), (902, "zuze", None)])
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == la for i, _, la in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx"
    assert {r.lang_pred for r in langid.identify(frame(spark, odd), langid.train(docs.where("false"))).collect()} == {"und"}


def test_ngrams_are_all_counted():
    text = "Ab1 cÉ"
    want = sum(max(0, len(" ab cé ") - n + 1) for n in langid.ORDERS)
    assert len(langid.ngrams(text)) == want and langid.ngrams("12 3") is None


def test_language_posterior_equals_brute_force(spark, odd):
    rng = random.Random(41)
    rows = [(i, words(rng, 12, 30) if i % 2 else "Ünï " + words(rng, 9, 20), "aa" if i % 2 else "bb") for i in range(60)]
    model = langid.train(frame(spark, rows))
    counts, docs = {"aa": Counter(), "bb": Counter()}, Counter()
    for i, t, la in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[la].update(langid.ngrams(t).tolist())
            docs[la] += 1
    texts = [t for _, t, _ in [*rows, *odd]] + ["w1 " * 20_000]
    names, sure = model.predict(texts)
    for t, name, x in zip(texts, names, sure, strict=True):
        grams = langid.ngrams(t) if t else None
        if grams is None:
            assert (name, x) == ("und", 0.0)
            continue
        z = {la: np.log((docs[la] + 1) / (sum(docs.values()) + 2)) + sum(np.log((counts[la][g] + 0.5) / (sum(counts[la].values()) + 0.5 * langid.BUCKETS)) for g in grams.tolist()) for la in counts}
        best = max(z, key=z.get)
        assert name == best and x == pytest.approx(1 / sum(np.exp(v - z[best]) for v in z.values()))
    small = list(langid.sparse_batches(texts, most=50))
    assert len(small) > 20 and sum(len(rows) for rows, *_ in small) == sum(n != "und" for n in names)
    assert langid.identify(frame(spark, []), model).count() == 0


# --- 3 -------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "HTTP://M.Example.NET/en/1?q#f"), (2, "https://a.net/x"), (3, "x://example.com/de/"), (4, "x://EXAMPLE.com/DE/"), (5, "x://b.org/fr/9"), (6, None), (7, "no scheme"), (8, "://a.net"), (9, "x://net/"), (10, "a://b://c.net/"),
        (11, "x://notexample.net/en/"), (12, "x://spam.com/win"), (None, "x://y.com/?a://b"),
    ]
    pages = spark.createDataFrame([(i, u, "", "h") for i, u in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages, [(frozenset({"h=spam"}), 0.9)]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and (got[3].rule, got[3].verdict) == ("example.com/de/", "block")
    assert got[4].rule is None and got[5].rule == "org/fr/" and got[8].rule is None and got[8].host == "a.net"
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") == (got[7].host, got[7].path, got[7].verdict)
    assert got[9].rule == "net/" and got[10].host == "b:" and got[11].rule == "net/"
    assert got[12].verdict == "block" and got[None].host == "y.com"


def test_rules_are_mined(spark):
    rng = random.Random(6)
    rows = [(f"http://{'casino' if i % 5 == 0 else 'h' + str(rng.randrange(9))}.com/{rng.choice(['a', 'b'])}/{i}", i % 5 == 0) for i in range(500)]
    df = spark.createDataFrame([*rows, (None, True), ("x", None)], "url string, bad boolean")
    rules = urlfilter.mine(df)
    assert rules and all(any("casino" in t for t in s) for s, _ in rules)
    for s, sure in rules:  # brute force
        hits = [bad for u, bad in rows if s <= set(urlfilter.url_tokens(u))]
        assert sum(hits) / len(hits) == pytest.approx(sure)
    assert urlfilter.mine(df.where("false")) == []


# --- 4 -------------------------------------------------------------------------------------------


def dedup_brute(rows, t):
    first = {}
    raws = [(i, (x or "").encode()) for i, x, _ in rows]
    for i, raw in raws:
        for s in range(len(raw) - t + 1) if i is not None else ():
            w = raw[s:s + t]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - t + 1) if i is not None else ():
            if first[raw[s:s + t]] < i:
                gone[s:s + t] = b"\1" * t
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("threshold", "crowded"), [(50, 10_000), (50, 1), (7, 3), (12, 10_000)])
def test_suffix_dedup_equals_brute_force(spark, odd, threshold, crowded):
    rng = random.Random(threshold)
    shared = [words(rng, 30, 9) for _ in range(4)]
    rows = [(i, " ".join([words(rng, rng.randrange(20), 9), rng.choice(shared)[rng.randrange(40):], words(rng, 5, 9)]), "en") for i in range(60)] + odd
    rows = [(i, t[:3000] if t else t, la) for i, t, la in rows]
    got = sorted((tuple(r) for r in suffix_dedup.dedup_report(frame(spark, rows), threshold, crowded).collect()), key=repr)
    assert got == dedup_brute(rows, threshold)


def test_suffix_dedup_of_words(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = [(1, "a b " + passage, "en"), (2, "c é\n" + passage.replace(" ", "\n") + " d", "en"), (3, " ".join(passage.split()[:40]), "en"), (4, None, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None
    assert got[2].text.split() == ["c", "é", "d"] and got[2].n_chars == len(got[2].text)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0 and list(got[1].asDict()) == docs.columns


# --- 5 -------------------------------------------------------------------------------------------


def test_quality_counts(spark, odd):
    rng = random.Random(9)
    rows = [*odd, (20, "a b c x a b c\n\nl1 # $\nl1 # $\n\n", "en"), (21, words(rng, 200, 4), "en")]
    got = sorted((tuple(r)[:7] for r in quality.judge(frame(spark, rows)).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        t = t or ""
        w = t.encode().split()
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed))
    assert got == sorted(want, key=repr)
    assert quality.judge(frame(spark, [])).count() == 0


def test_em_trusts_good_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.55, 0.9, 0.7, 0.9]
    votes = [np.where(rng.random(4000) < 0.3, 1, np.where((rng.random(4000) < a) == truth, 2, 0)) for a in accuracy]
    code = np.zeros(4000, int)
    for v in votes:
        code = code * 3 + v
    patterns, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    good = quality.em(patterns, counts.astype(float))[back] > 0.5
    assert (good == truth).mean() > 0.93


def test_em_posterior_equals_brute_force(spark):
    """Plain EM over documents, one by one, gives what the counts of patterns give."""
    rng = random.Random(15)
    texts = [words(rng, rng.randrange(5, 150), rng.choice([8, 400])) + rng.choice(["", ". ", "\n# $ % *\n" * 9]) for _ in range(120)]
    votes = [quality.votes_of(quality.measure(t)[5]) for t in texts]
    good = [min(max(((v.count(2) + 0.5) / (8 - v.count(1) + 1) if v.count(1) < 8 else 0.5) ** 2, 0.02), 0.98) for v in votes]
    for _ in range(60):
        prior = min(max(sum(good) / len(good), 0.05), 0.98)
        share = [[[1 + sum(g if side else 1 - g for g, v in zip(good, votes, strict=True) if v[r] == x) for x in range(3)] for r in range(8)] for side in (0, 1)]
        tell = [[log10(share[1][r][x] / sum(share[1][r])) - log10(share[0][r][x] / sum(share[0][r])) for x in range(3)] for r in range(8)]
        tell = [[min(max(x * np.log(10), -3), 3) for x in row] for row in tell]
        tell = [[min(row[0], 0), row[1], max(row[2], 0)] for row in tell]
        new = [1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(tell[r][x] for r, x in enumerate(v))))) for v in votes]
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        if done:
            break
        good = new
    got = {r.doc_id: r for r in quality.judge(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, g in enumerate(good):
        assert got[i].quality == pytest.approx(g, abs=1e-7)
        assert got[i].kept == (not got[i].base_failed and g >= 0.5)


# --- 6 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_brute_force(spark, odd, order):
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randrange(40), 30), "en") for i in range(200)] + [(i, t if not t or len(t) < 9000 else t[:3000], la) for i, t, la in odd]
    docs = frame(spark, rows)
    got = sorted(ngram_lm.score(docs, ngram_lm.train(docs, order)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score))
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    grams = lambda w: list(zip(*([*[None] * (order - 1), *w][k:] for k in range(order)), strict=False))
    rest = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    c, level = Counter(), {order: Counter()}
    for i, t, _ in rows:
        if rest(i) != 1:
            c.update(tok(t))
            level[order].update(grams(tok(t)))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    kinds = lambda x: [sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]
    d = {k: ngram_lm.discounts(kinds(x)) for k, x in level.items()}
    context = {}
    for k in range(2, order + 1):
        for g, n in level[k].items():
            x = context.setdefault(g[:-1], [0, 0, 0, 0])
            x[0] += n
            x[min(n, 3)] += 1
    total, vocabulary, types = sum(c.values()), len(c), len(level[2])
    left = sum(d[1][min(n, 3) - 1] for n in level[1].values()) / types / (vocabulary + 1)

    def p(g):
        n, k = level[len(g)][g], len(g)
        paid = max(0, n - d[k][min(n, 3) - 1]) if n else 0
        if k == 1:
            return paid / types + left
        x = context.get(g[:-1])
        return paid / x[0] + sum(d[k][j] * x[j + 1] for j in range(3)) / x[0] * p(g[1:]) if x else p(g[1:])

    want = []
    for i, t, _ in rows:
        w = tok(t)
        want.append((i, rest(i) == 1, len(w), sum(x in c for x in w), total, sum(log10((c[x] + 0.5) / (total + 0.5 * (vocabulary + 1))) for x in w), sum(log10(p(g)) for g in grams(w))))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    for g, x in zip(got, want, strict=True):
        assert tuple(g)[:5] == x[:5] and g.base_score == pytest.approx(x[5]) and g.score == pytest.approx(x[6])
    some = tuple(f"w{k}".encode() for k in range(order - 1))
    assert sum(p((*some, b)) for b in c) + p((*some, b"unseen")) == pytest.approx(1)
    empty = frame(spark, [])
    assert ngram_lm.score(docs, ngram_lm.train(empty, order)).count() == len(rows) and ngram_lm.score(empty, ngram_lm.train(empty, order)).count() == 0


def test_hash_tables():
    rng = np.random.default_rng(17)
    for n in (0, 1, 5, 40_000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        values = np.c_[rng.zipf(1.3, len(h)) % 10**9, rng.integers(0, 400, len(h))]
        table = ngram_lm.HashTable(np.frombuffer(ngram_lm.pack_table(h, values), np.uint8))
        assert (table.find(ngram_lm.table_key(h)) == values).all()
        assert not table.find(ngram_lm.table_key(np.setdiff1d(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), h))).any()
    keys = ngram_lm.table_key(np.arange(1 << 20, dtype=np.uint64) << np.uint64(20) | np.uint64(7) << np.uint64(60))
    assert len(np.unique(keys)) == 1 << 20
    columns = [rng.integers(0, 1 << 32, 1000, dtype=np.uint32) for _ in range(4)]
    assert all((a == b).all() for a, b in zip(columns, ngram_lm.unpack_columns(ngram_lm.pack_columns(columns), 4), strict=True))


# --- files that are gone -------------------------------------------------------------------------


def test_missing_files_are_errors(spark, monkeypatch):
    """A shared folder that is not there, or not shared, gives an error and never an empty lookup."""
    docs = frame(spark, [(i, f"the same passage of well over fifty bytes in every one of these texts {i % 2}", "en") for i in range(8)])
    plain = suffix_dedup.hot_anchors
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda rows, folder, *a: (plain(rows, folder, *a), shutil.rmtree(folder)))
    with pytest.raises(Exception, match="No such file"):
        suffix_dedup.dedup_report(docs).collect()
    model = ngram_lm.train(docs)
    shutil.rmtree(model.folder)
    with pytest.raises(Exception, match="No such file"):
        ngram_lm.score(docs, model).collect()
    folders = []
    local = jaccard_join.local_path
    monkeypatch.setattr(jaccard_join, "local_path", lambda x: folders.append(local(x)) or folders[-1])
    node = jaccard_join.set_hash(jaccard_join.shingles(docs.first().text.encode(), jaccard_join._WordHashes()))
    wanted = spark.createDataFrame([(0, node, node, 1)], "doc_id long, node long, root long, n long")
    assert jaccard_join.sets_of(docs, wanted, 12).count() == 1
    sets = jaccard_join.sets_of(docs, wanted, 12)
    shutil.rmtree(folders[-1])
    with pytest.raises(Exception, match="No such file"):
        sets.collect()


def test_buckets_are_shuffled_once(spark):
    df = spark.range(100).selectExpr("cast(id % 7 as int) as bucket", "id")
    grouped = common.by_bucket(df, 7).applyInArrow(lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64())}), "n long")
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.n for r in grouped.collect()) == [14] * 5 + [15] * 2


def test_fresh_names(spark, odd):
    rows = [(i, t, la) for i, t, la in odd if not t or len(t) < 9000]
    docs = frame(spark, rows)
    assert common.fresh(docs, "Path", "x", "x") == ["_Path", "x", "_x"]
    more = docs.withColumn("spans", F.lit(1)).withColumn("TEXT_KEY", F.lit(2)).withColumn("span_id", F.lit(3)).withColumn("__spans", F.lit(4))
    plain, other = suffix_dedup.remove_repeats(docs, 5).collect(), suffix_dedup.remove_repeats(more, 5).collect()
    assert sorted(map(repr, (r.text for r in plain))) == sorted(map(repr, (r.text for r in other))) and {(r.spans, r.TEXT_KEY, r["__spans"]) for r in other} == {(1, 2, 4)}


# --- 7 -------------------------------------------------------------------------------------------


def joined_brute(rows):
    hashes = jaccard_join._WordHashes()
    sets = {}
    for i, t, _ in rows:
        if i is not None and (s := frozenset(jaccard_join.shingles((t or "").encode(), hashes).tolist())):
            sets.setdefault(s, []).append(i)
    keys = list(sets)
    near = [[j for j, b in enumerate(keys) if j != k and len(a & b) >= 0.8 * len(a | b) - 1e-9] for k, a in enumerate(keys)]
    least = [min(sets[s]) for s in keys]
    while True:
        new = [min([least[k], *(least[j] for j in near[k])]) for k in range(len(keys))]
        if new == least:
            break
        least = new
    out = {(i, s): (least[k], min(sets[s]), len(near[k])) for k, s in enumerate(keys) for i in sets[s]}
    return sorted(
        ((i, *out[i, s]) if i is not None and s else (i, i, i, 0) for i, t, _ in rows for s in [frozenset(jaccard_join.shingles((t or "").encode(), hashes).tolist())]), key=repr,
    )


def near_rows(seed=11):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        w = words(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 5)):
            x = list(w)
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(999)}"
            rows.append((len(rows), " ".join(x[: len(x) - rng.randrange(5)]), "en"))
    return rows


@pytest.mark.parametrize(("small", "block"), [(2048, 512), (8, 16), (2, 2)])
def test_jaccard_join_equals_brute_force(spark, odd, small, block):
    rows = near_rows() + [(None if i is None else i + 1000, t, la) for i, t, la in odd]
    # an id that stands over texts of two classes
    rows += [(5000, rows[0][1], "en"), (5000, "of a class of its own " + words(random.Random(1), 50), "en")]
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows), small=small, block=block).collect()), key=repr)
    assert got == joined_brute(rows)


def passages_and_copies(n, vocabulary=5000, seed=12):
    """A hot passage in n texts, and n near copies of one text."""
    rng = random.Random(seed)
    passage, base = words(rng, 40), words(rng, 150).split()
    rows = [(i, passage + " " + words(rng, 60, vocabulary), "en") for i in range(n)]
    for i in range(n, 2 * n):
        x = list(base)
        x[rng.randrange(len(x))] = f"e{i}"
        rows.append((i, " ".join(x), "en"))
    return rows


@pytest.mark.parametrize(("small", "block", "n"), [(2048, 512, 700), (16, 32, 300)])
def test_jaccard_join_splits_large_buckets(spark, small, block, n):
    """More sets than a block takes, and than a bucket takes: the passage's buckets are split by further tokens,
    those of the copies can't be told apart and are compared in blocks."""
    rows = passages_and_copies(n)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(frame(spark, rows), small=small, block=block).collect()}
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in range(n))
    assert all(got[i].class_id == n and got[i].n_links == n - 1 for i in range(n, 2 * n))


@pytest.mark.parametrize("part_bytes", [1_500, 20_000])
def test_jaccard_join_sends_groups_in_parts(spark, part_bytes):
    """Groups of several parts: pairs of parts that hold several blocks, and parts that hold one set or none."""
    rows = passages_and_copies(120)[120:] + near_rows(seed=31)[:40]
    rows = [(i, t, la) for i, (_, t, la) in enumerate(rows)]
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows), small=4, block=16, part_bytes=part_bytes).collect()), key=repr)
    assert got == joined_brute(rows)


@pytest.mark.parametrize("left", [None, 0, 13, 40])
def test_links_by_blocks(left):
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 500, 60) for _ in range(6)]
    sets = [np.unique(np.r_[bases[i % 6][: 60 - i % 4], rng.integers(0, 500, i % 7)].astype(np.uint64)) for i in range(40)]
    met = [[i != j and (left is None or (i < left) != (j < left)) and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    least = np.arange(40)
    for _ in range(40):
        least = np.array([min([least[i], *(least[j] for j in range(40) if met[i][j])]) for i in range(40)])
    for block in (1, 7, 64):
        links, first = jaccard_join.links_of(sets, block, left)
        assert links.tolist() == np.sum(met, 1).tolist() and first.tolist() == least.tolist()
    assert jaccard_join.first_alike(40, lambda a, b: np.array(met)[a[0], b]).tolist() == least.tolist()


def test_recall_where_buckets_split(spark):
    """Pairs at and above the threshold in texts that share a passage: meetings in buckets that are split."""
    rng = random.Random(21)
    passage = words(rng, 30).split()
    rows = []
    for k in range(150):
        own = words(rng, 90, 9000).split()
        other = list(own)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(passage + own), "en"), (2 * k + 1, " ".join(passage + other), "en")]
    docs = frame(spark, rows)
    levels = []
    sets = jaccard_join.profile(docs, jaccard_join.repeats_for(0.99)).withColumnRenamed("doc_id", "first_id").cache()
    plain = jaccard_join.next_paths
    try:
        jaccard_join.next_paths = lambda *a: levels.append(1) or plain(*a)
        edges = {frozenset((r.u, r.v)) for r in components.connected_components(jaccard_join.candidate_edges(docs, sets, 12, small=8)).selectExpr("node as u", "root as v").collect()}
    finally:
        jaccard_join.next_paths = plain
    node = {r.first_id: r.node for r in sets.collect()}
    root = {}
    for e in edges:
        for x in e:
            root[x] = min(min(e), root.get(x, x))
    hashes = jaccard_join._WordHashes()
    s = {i: set(jaccard_join.shingles(t.encode(), hashes).tolist()) for i, t, _ in rows}
    near = [(i, i + 1) for i in range(0, 300, 2) if len(s[i] & s[i + 1]) >= 0.8 * len(s[i] | s[i + 1])]
    met = [root.get(node[a]) is not None and root.get(node[a]) == root.get(node[b]) for a, b in near]
    assert levels and len(near) > 100 and np.mean(met) >= 0.99


def kept_brute(rows):
    """Rows, not ids: one of each class, all rows without id or words."""
    hashes = jaccard_join._WordHashes()
    classes = {}
    label = {}
    sets = {}
    for i, t, _ in rows:
        s = frozenset(jaccard_join.shingles((t or "").encode(), hashes).tolist())
        if i is not None and s:
            sets[i, t] = s
    for key, s in sets.items():
        near = {label[o] for o, x in sets.items() if o in label and len(s & x) >= 0.8 * len(s | x) - 1e-9}
        label[key] = key
        for o in list(label):
            if label[o] in near:
                label[o] = key
    for key in sets:
        classes.setdefault(label[key], []).append(key)
    return [sorted({i for i, _ in c})[0] for c in classes.values()], [(i, t) for i, t, _ in rows if (i, t) not in sets], classes


def test_keep_one(spark, odd):
    rows = near_rows(13) + [(None if i is None else i + 1000, t, la) for i, t, la in odd]
    a, b, c = (words(random.Random(k), 60) for k in (31, 32, 33))
    near_a = a.replace(a.split()[7], "other", 1)
    rows += [(2001, a, "en"), (2002, a, "en"), (2002, b, "en"), (2003, c, "en"), (2004, c, "en"), (2004, c, "de"), (2000, near_a, "en"), (2000, a, "en"), (2005, b, "en"), (None, c, "en"), (None, c, "en"), (2006, "", "en"), (2006, "", "en")]
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    got = kept.collect()
    ids, alone, classes = kept_brute(rows)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in got)
    assert all(texts[x] == n for x, n in Counter(alone).items())
    in_class = sorted(r.doc_id for r in got if (r.doc_id, r.text) not in set(alone))
    assert in_class == sorted(ids)
    assert all(sum(texts[x] for x in keys) == 1 for keys in classes.values())
    assert texts[2002, b] == 1 and not texts[2002, a] and not texts[2005, b]
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0
    again = jaccard_join.keep_one(docs.withColumn("n", F.lit(1)).withColumn("TEXT_key", F.lit(2)).withColumn("class_doc_id", F.lit(3)))
    assert sorted(r.doc_id or 0 for r in again.collect()) == sorted(r.doc_id or 0 for r in got)


def test_hub_joins(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, i long")
    counts = df.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 = 1").cache()
    for most in (1000, 40):
        monkeypatch.setattr(components, "HUB_ROWS", most)
        keys = {k for k, _ in rows if k % 3 == 1}
        assert (components.hub_limit(counts) is None) == (most == 1000)
        ids = lambda x: sorted(r.i for r in x.collect())
        assert ids(components.hub_join(df, counts, ["k"])) == ids(components.hub_semi(df, counts, ["k"])) == sorted(i for k, i in rows if k in keys)
        assert ids(components.hub_anti(df, counts, ["k"])) == sorted(i for k, i in rows if k not in keys)


def test_similar_matrix():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    want = [[len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for b in sets] for a in sets]
    assert (jaccard_join.similar_matrix(sets) == np.array(want)).all()


@pytest.mark.parametrize("hub_rows", [1000, 3])
def test_components(spark, monkeypatch, hub_rows):
    monkeypatch.setattr(components, "HUB_ROWS", hub_rows)
    rng = random.Random(14)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(root[a] != root[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 8 -------------------------------------------------------------------------------------------


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, odd):
    rng = random.Random(15)
    items = [(i, words(rng, rng.randrange(8, 30), 5000)) for i in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, "w1")]
    rows = list(odd)
    for i in range(80):
        t = list(items[i % 12][1])
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([[], ["x"], [t[k], "y"]])
        rows.append((100 + i, words(rng, 20, 5000) + "  " + "".join(t).upper() + "\n" + words(rng, 20, 5000), "en"))
    rows = [(i, t if not t or len(t) < 9000 else t[:3000], la) for i, t, la in rows]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()), key=repr)
    want, leaked = [], set()
    for i, t, _ in rows:
        for k, item in items:
            a, b = decontaminate.normal(item), decontaminate.normal(t)
            budget = int(len(a) * 0.05) if len(a) >= 20 else 0
            if a and b and (d := best_distance(a, b)) <= budget:
                want.append((i, k, d))
                leaked.add((i, t))
    assert got == sorted(want, key=repr) and any(d for _, _, d in got)
    blocks = decontaminate.find_leaks(docs, bench, block_bytes=200)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in blocks.collect()), key=repr) == got
    kept = decontaminate.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum((i, t) not in leaked for i, t, _ in rows)
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0 == decontaminate.find_leaks(docs.where("false"), bench).count()
    assert decontaminate.drop_leaked(docs, bench.where("false")).count() == len(rows) and decontaminate.drop_leaked(docs.where("false"), bench).count() == 0
    in_words = decontaminate.drop_leaked(docs, spark.createDataFrame([(1, "w1")], "item_id long, text string")).collect()
    assert len(in_words) == sum("w1" not in decontaminate.normal(t) for _, t, _ in rows)
    assert decontaminate.drop_leaked(docs, bench, block_bytes=200).count() == kept.count()
