"""Exact top-k, repair of conversations and the Merkle manifest against brute force, and on rows that are odd."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from marlow.llm import conversations, maxscore, merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
KEY = lambda row: tuple(map(str, row))

# --- 11 ------------------------------------------------------------------------------------------


def top_by_force(rows, k=20, by=20):
    """Of (id, vector) rows, a position in the list tells rows of one id apart."""
    fit = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(fit):
        if qid is None or qid % by:
            continue
        hits = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), cid is None, cid or 0) for b, (cid, c) in enumerate(fit) if b != a)
        out += [(qid, r, None if none else cid, -s) for r, (s, none, cid) in enumerate(hits[:k], 1)]
    return sorted(map(KEY, out))


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], "vec_id long, embedding array<float>, uid int, term string, shard int")


def test_top_k_of_odd_vectors(spark):
    rng = random.Random(4)
    hot = [0.5, -0.25, 0.0, 1.0]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(300)]
    rows += [(400, None), (420, [None, 1.0, 2.0, 3.0]), (440, [float("nan")] * 4), (460, [float("inf"), 0.0, 0.0, 0.0]), (None, hot), (None, [9.0] * 4), (480, []), (500, [0.0] * 4), (520, [1.0]), (540, [1.0] * 9)]
    rows += [(60, hot), (60, hot), (61, [0.1] * 4), (61, [0.1] * 4)]
    got = maxscore.search_divisible(vectors_frame(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(KEY, got.collect())) == top_by_force(rows)
    assert maxscore.search_divisible(vectors_frame(spark, [])).count() == 0
    assert maxscore.search_divisible(vectors_frame(spark, [(20, [1.0])])).count() == 0
    few = [(20, [1.0, 2.0]), (40, [2.0, -1.0]), (41, [0.0, 0.0])]
    assert sorted(map(KEY, maxscore.search_divisible(vectors_frame(spark, few)).collect())) == top_by_force(few)


@pytest.mark.parametrize(("kind", "share"), [("dense", 0.25), ("sparse", 1.0), ("large", 0.5)])
def test_top_k_over_shards(spark, share, kind, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 0.3, (500, 12))
    if kind == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
    if kind == "large":
        v *= 1 << 20  # scores above 2 ** 53 need whole numbers
        v[0] *= 1 << 4
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    monkeypatch.setattr(maxscore, "CHUNK_SCORES", 1 << 10)
    vectors = maxscore.whole_vectors(vectors_frame(spark, rows))
    got = maxscore.search(vectors, vectors.where("key % 20 = 0"), 20, share, query_rows=13, shard_rows=200)
    assert sorted(map(KEY, got.collect())) == top_by_force(rows)


def test_chunks_prune():
    """With the usual split most pairs are left before all terms are added up; the result is that of all pairs."""
    rng = np.random.default_rng(3)
    v = np.sort(rng.exponential(1, (4000, 30)) ** 3, axis=1).astype(np.int64)
    q = v[:5] * 3
    place = np.arange(len(v))
    lists = {t: (place[v[:, t] != 0], v[v[:, t] != 0, t]) for t in range(30)}
    shard = maxscore.Shard(place, place, 0, lists)
    a, p, s = shard.search(q, np.full(5, -1), 10, 1.0)
    for i in range(5):
        all_scores = v @ q[i]
        best = np.lexsort((place, -all_scores))[:10]
        assert p[a == i].tolist() == best.tolist() and s[a == i].tolist() == all_scores[best].tolist()


# --- 12 ------------------------------------------------------------------------------------------

SPEAK = {"": "u", "s": "u", "u": "a", "a": "u"}
TAKES = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest_by_force(codes):
    @lru_cache(None)
    def best(i, last, inserts):
        out = [(0, "")] if i == len(codes) and last in ("", "a") else []
        if inserts < 4:
            c, a = best(i, SPEAK[last], inserts + 1)
            out.append((c + 3, "I" + a))
        if i < len(codes):
            initial, fault = codes[i]
            c, a = best(i + 1, last, 0)
            out.append((c + 4, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (last, initial) in TAKES:
                    c, a = best(i + 1, initial, 0)
                    out.append((c + more, "K" + a))
                c, a = best(i + 1, SPEAK[last], 0)
                out.append((c + more + 3, "R" + a))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def repaired_by_force(rows):
    shown = lambda v: " " if v is None else str(v)
    by = {}
    for conv, turn, role, text in rows:
        here = by.setdefault(conv, [])
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else shown(role), "" if kind == 1 else shown(text)
        here += [(turn, role, re.sub("[.!?]", "", text) if kind == 2 else text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, got in by.items():
        got.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.md5(v[2].encode()).hexdigest()))
        seen, codes = set(), []
        for _, role, text in got:
            word = re.findall(r"[^\x20\x09-\x0D]", text)
            codes.append((role[:1], "blank" if not word else "duplicate" if (role, text) in seen else "" if word[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in got if t is not None]
        cost, audit = cheapest_by_force(tuple(codes))
        said, last, i = [], "", 0
        for edit in audit:
            if edit != "D":
                role = got[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[SPEAK[last]]
                said.append(f"{role}:{'' if edit == 'I' else got[i][2]}")
                last = role[:1]
            i += edit != "I"
        count = lambda f, codes=codes: sum(c[1] == f for c in codes)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, H("\n".join(said))))
    return sorted(map(KEY, out))


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(6)
    faults = ["", "truncated", "blank", "duplicate"]
    for _ in range(400):
        codes = tuple((rng.choice("suua?"), rng.choice(faults)) for _ in range(rng.randrange(9)))
        text = "".join(chr(65 + 4 * "sua?".index(i) + faults.index(f)) for i, f in codes)
        assert conversations.cheapest(text) == cheapest_by_force(codes)


ROLES = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "uncle"]
TEXTS = ["Hi.", "yes", "ok!", None, "", " \n", "Why?", "A. b", "Hi.", "été 日本.", "x " * 5000 + "."]


@pytest.mark.parametrize("rows_each", [40])
def test_repair_of_odd_conversations(spark, rows_each):
    """Pieces of about forty rows: long conversations go over several ranges, with a turn's equal rows on their edges."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in [None, *range(30)] for t in [None, *range(rng.randrange(12))] for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(7000, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(150)]
    rows += [(8000, 4, "user", "same.")] * 40
    # a conversation that loses all its rows
    rows += [next((c, 0, "user", "gone") for c in range(9000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, at long")
    got = sorted(map(KEY, conversations.repair(df, rows_each).collect()))
    assert got == repaired_by_force(rows)
    assert any(g[6:] == ("0", "", H("")) for g in got)
    assert conversations.repair(df.limit(0)).count() == 0


# --- 13 ------------------------------------------------------------------------------------------


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def sides_of(levels, i, fanout):
    out = []
    for x in levels[:-1]:
        a = i - i % fanout
        out.append(("".join(x[a:i]), "".join(x[i + 1:a + fanout])))
        i //= fanout
    return out


def manifest_by_force(rows, fanout=8):
    """(doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda *r: H("".join(map(field, r)))
    small = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(levels_of([x[1] for x in by[lang]], fanout))
    over = levels_of([t[-1][0] for t in trees], fanout)
    out = []
    for k, lang in enumerate(langs):
        for i, (doc, h, r) in enumerate(by[lang]):
            path = sides_of(trees[k], i, fanout) + sides_of(over, k, fanout)
            folded = leaf(*r[:4], small(r[4])) if zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 0 else h
            for before, after in path:
                folded = H(before + folded + after)
            out.append((doc, h, trees[k][-1][0], over[-1][0], H("".join(a + b for a, b in path)), folded, folded == over[-1][0]))
    return sorted(map(KEY, out))


@pytest.mark.parametrize(("fanout", "rows_each"), [(8, 60), (3, 150)])
def test_manifest_of_odd_documents(spark, fanout, rows_each):
    rng = random.Random(9)
    langs = ["en"] * 30 + ["de", "fr", None, "é"] + [f"l{i}" for i in range(70)]
    rows = [(i, f"src{i % 3}", rng.choice(langs), i * 7, f"Text {rng.random()} É END") for i in range(400)]
    rows += [(None, None, None, None, None), (None, "s", None, 1, ""), (1001, "s", "en", None, None), (1002, "", "", 0, ""), (1003, "S", "en", 3, "no capitals here"), (1004, "s", "en", 9, "LONG " * 20_000)]
    rows += [(1005, "s", "en", 4, "Same")] * 30 + [(1006, "s", "en", 4, "Same"), (1006, "s", "en", 4, "same")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, level int, leaf string, grp string")
    got = merkle.verify(df, fanout, rows_each)
    assert sorted(map(KEY, got.collect())) == manifest_by_force(rows, fanout)
    assert merkle.verify(df.limit(0)).count() == 0
    told = {r.lang: r for r in merkle.manifest(df, fanout, rows_each).collect()}
    assert sum(r.rows for r in told.values()) == len(rows)
    assert set(told) == {r[2] for r in rows}
    assert {(r.subroot, r.root) for r in told.values()} == {(g.subroot, g.root) for g in got.collect()}


def test_one_document_is_its_own_root(spark):
    df = spark.createDataFrame([(1, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = merkle.verify(df).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == H("")


def test_mountains_leave_what_reaches_over_an_edge():
    for size in (1, 7, 8, 9, 64, 65, 100):
        names = [H(str(i)) for i in range(size)]
        levels = levels_of(names, 8)
        for a, b in ((0, size), (size // 3, size), (0, size // 2), (size // 3, size // 2 + 1)):
            stack = merkle.Mountains(a, size, 8)
            for x in names[a:b]:
                stack.push(x)
            for level, index, node in stack.close():
                assert levels[level][index] == node
                whole = a <= index // 8 * 8 ** (level + 1) and (b == size or (index // 8 + 1) * 8 ** (level + 1) <= b)
                assert len(levels[level]) == 1 or not whole
