"""The pipeline's stages, each on what the one before kept."""

import math
import os
import random
import re

import pytest
from oracle import assert_equal, duck
from test_corpus import best_distance, words
from tokenizers import Tokenizer

import corpus_pipeline
from marlow.llm import queries, toxicity

SF = os.environ.get("MARLOW_TEST_SF", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF), queries.ORACLES[name], duck(SF))


@needs_tables
def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in last} == ids and all(r.decoded == (texts[r.doc_id] or "") and r.n_tokens == len(r.token_ids) for r in last)


# --- the chain against brute force ---------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def without_toxic(rows, model):
    def score(t):
        seen = {f for w in toxicity.words_of(t) for f in toxicity.features_of(w) if f in model.columns}
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights[model.columns[f]] for f in seen))))

    return [(i, t) for i, t in rows if score(t) < 0.5]


def without_copies(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None and w:
            sets[i, t] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if x == old else x for k, x in label.items()}
    return [(i, t) for i, t in rows if (i, t) not in sets] + sorted(set(label.values()))


def without_passages(rows, n=50):
    first, found = {}, []
    for i, t in rows:
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] if i is not None else []
        raw = (t or "").encode()
        keys = [tuple(raw[a:b] for a, b in w[k:k + n]) for k in range(len(w) - n + 1)]
        for k in keys:
            first[k] = min(first.get(k, i), i)
        found.append((i, t, raw, w, keys))
    out = []
    for i, t, raw, w, keys in found:
        gone = [False] * len(w)
        for k, key in enumerate(keys):
            if first[key] < i:
                gone[k:k + n] = [True] * n
        cut = bytearray(len(raw))
        for k, g in enumerate(gone):
            if g:
                begin = w[k - 1][1] if k and gone[k - 1] else w[k][0]
                cut[begin:w[k][1]] = b"\1" * (w[k][1] - begin)
        out.append((i, None if t is None else bytes(b for b, c in zip(raw, cut, strict=True) if not c).decode()))
    return out


def without_leaks(rows, items):
    plain = lambda t: " ".join((t or "").lower().split())

    def held(t):
        return any(best_distance(plain(x), plain(t)) <= (int(len(plain(x)) * 0.05) if len(plain(x)) >= 20 else 0) for _, x in items if plain(x))

    return [(i, t) for i, t in rows if not (plain(t) and held(t))]


def test_chain_equals_brute_force(spark, tmp_path):
    rng = random.Random(51)
    items = [(1, words(rng, 12, 5000)), (2, words(rng, 14, 5000)), (3, None)]
    passage = words(rng, 60, 5000)
    docs, labels = [], []
    for i in range(140):
        t = words(rng, rng.randrange(20, 50), 3000)
        if i % 7 == 0:
            t += " you moron scum"
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        if i % 11 == 3:
            t = f"{t} {passage}\n{words(rng, 8, 3000)}"
        if i % 13 == 4:
            leak = list(items[i % 2][1])
            leak[5] = "Q"
            t = f"{t} {''.join(leak)} {words(rng, 5, 3000)}"
        docs.append((i, t))
    near = docs[9][1].split()
    near[3] = "changed"
    docs += [(200, docs[8][1]), (201, " ".join(near)), (8, docs[15][1]), (8, "another text of the same id " + words(rng, 20)), (202, ""), (202, ""), (203, None), (None, docs[8][1]), (None, None), docs[20], docs[20]]
    folder = tables(spark, tmp_path, docs, labels, items)
    model = toxicity.train(queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels"))
    want, sizes = docs, [len(docs)]
    for step in (lambda x: without_toxic(x, model), without_copies, without_passages, lambda x: without_leaks(x, items)):
        want = step(want)
        sizes.append(len(want))
    lib = Tokenizer.from_file(queries.tokenizer_path())
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    got = [(r.doc_id, r.n_tokens, list(r.token_ids), r.decoded) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(((i, len(ids(t)), ids(t), t or "") for i, t in want), key=repr)
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4]
    assert any(passage in (t or "") for _, t in want) and sum(passage in (t or "") for _, t in docs) > 5 > sum(passage in (t or "") for _, t in want)


def test_chain_on_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    only_nulls = tables(spark, tmp_path / "nulls", [(None, None)] * 3, [(None, None, None)], [(None, None)])
    assert [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, only_nulls).collect()] == [(None, 0)] * 3
