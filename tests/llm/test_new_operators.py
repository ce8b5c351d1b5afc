"""Merkle manifest, conversation repair and near vectors against plain versions written out by hand."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import conversations, embedding_pairs, merkle, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, idx int, path string"


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """(root, for each leaf its list of (left, right) texts)."""
    proofs, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, owns = [], []
        for lo in range(0, len(nodes), arity):
            run = nodes[lo : lo + arity]
            for k, leaves in enumerate(own[lo : lo + arity]):
                for i in leaves:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(sha("".join(run)))
            owns.append([i for leaves in own[lo : lo + arity] for i in leaves])
        nodes, own = ups, owns
    return nodes[0], proofs


def plain_manifest(rows, arity=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, *plain_tree([leaf(*r) for r in own], arity)))
    root, above = plain_tree([t[1] for t in trees], arity)
    out = []
    for (own, sub, proofs), up in zip(trees, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            path = proof + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] if r[4] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            h = leaf(*r[:4], text)
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], leaf(*r), sub, root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def test_merkle_manifest_against_plain_trees(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"s{rng.choice('ab')}" if rng.random() < 0.8 else rng.choice([None, "", "é", "z" + str(i % 40)]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Ünd ABC\nx", "low", "Y" * 5000])) for i in range(600)]
    rows += [rows[3], rows[3], (None, "sa", None, None, None), (None, "sa", None, None, "T"), (None, None, None, None, None), (-7, "alone", "x", 1, "A"), (3, "alone2", None, 0, "-")]
    spark.createDataFrame([(*r, "x", "t", 1, "p") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_merkle_heights(spark, n):
    rows = [(i, "s" if i else "t", None, None, str(i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, arity=3, carry={"doc_id": F.col("doc_id")}).withColumn("again", merkle.fold(F.unhex("leaf"), F.col("path"))).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in got) == sorted(r[:4] for r in plain_manifest(rows, 3)) if n else got == []
    assert all(r["again"] == r["root"] for r in got)


def test_merkle_needs_two_children(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"), arity=1)


# --- conversations


def plain_repair(rows):
    """(cost, audit, repaired rows) by trying all edits. rows: (role, text, fault), fault in '', 'truncated', 'gone'."""
    best = []

    def go(i, made, audit, cost):
        if best and cost > best[0][0]:
            return
        roles = "".join(r[0][:1] or "-" for r in made)
        body = roles[1:] if roles[:1] == "s" else roles
        if any(c != "ua"[k % 2] for k, c in enumerate(body)):
            return
        if i == len(rows) and (not roles or body and len(body) % 2 == 0):
            found = (cost, audit, list(made))
            if not best or found[:2] < best[0][:2]:
                best[:] = [found]
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            if fault != "gone":
                go(i + 1, [*made, (role, text)], audit + "K", cost + more)
                for other in ("user", "assistant"):
                    go(i + 1, [*made, (other, text)], audit + "R", cost + 3 + more)
            go(i + 1, made, audit + "D", cost + 4)
        if audit[-3:] != "III":
            for other in ("user", "assistant"):
                go(i, [*made, (other, "")], audit + "I", cost + 3)

    go(0, [], "", 0)
    return best[0]


def test_cheapest_edits_against_all_edits():
    names = ["system", "user", "assistant", "tool"]
    for n in range(4):
        for symbols in itertools.product(range(12), repeat=n):
            if n == 3 and hash(symbols) % 7:
                continue
            rows = [(names[s // 3], "t", ["", "truncated", "gone"][s % 3]) for s in symbols]
            assert conversations.cheapest_edits(bytes(symbols)) == plain_repair(rows)[:2], rows
    rng = random.Random(2)
    for _ in range(60):
        symbols = [rng.choice([0, 3, 6, 6, 3, 4, 5, 9]) for _ in range(5)]
        rows = [(names[s // 3], "t", ["", "truncated", "gone"][s % 3]) for s in symbols]
        assert conversations.cheapest_edits(bytes(symbols)) == plain_repair(rows)[:2], rows


def test_long_conversation():
    cost, audit = conversations.cheapest_edits(bytes([3, 6] * 2000 + [3]))
    assert (cost, audit) == (3, "K" * 4001 + "I")
    assert conversations.cheapest_edits(bytes([5] * 3000)) == (12000, "D" * 3000)


def plain_conversations(rows):
    """What op12 returns, by conv_id. rows: conv_id, turn, role, text."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if f == 1 else text.translate({ord(c): None for c in ".!?"}) if f == 2 else text
            own += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, "gone" if fault in ("blank", "duplicate") else fault))
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = plain_repair(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))
    return out


def test_conversation_repair_against_all_edits(spark, tmp_path):
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t", "Why?  \n", "Same!", "end ", None, "a\nb.", "x" * 3000 + "."]
    rows = []
    for conv in [*range(60), None]:
        at = 0
        for _ in range(rng.randint(1, 5)):
            at += rng.choice([1, 1, 1, 2, 0])
            rows.append((conv, rng.choice([at, at, at, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    dropped = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    spark.createDataFrame([(*r, "x", 1, 0, "y") for r in rows], "conv_id long, turn long, role string, text string, digest string, kind int, place long, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain_conversations(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hm."), (1, 2, "user", "So?"), (1, 2, "user", "So?"), (2, 0, "tool", ""), (3, 5, "user", "Hi.")]
    got = conversations.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got)) == [
        (1, 0, "system", "Be brief."), (1, 1, "user", ""), (1, 2, "assistant", "Hm."), (1, 3, "user", "So?"), (1, 4, "assistant", ""), (3, 0, "user", "Hi."), (3, 1, "assistant", ""),
    ]


def test_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows, gone = conversations.damaged(turns)
    plans = conversations.repair_plans(rows, gone)
    assert plans.count() == 0 and conversations.repair_digests(rows, plans).count() == 0 and conversations.repaired_turns(turns).count() == 0


# --- vectors


def plain_links(rows, threshold):
    """vec_id by row -> (links, component, kept), of rows (vec_id, vector, label)."""
    n = len(rows)
    fine = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = [set() for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1], dtype=float) for k in (i, j))
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile_rows", [7, 1024])
def test_near_vectors_against_all_pairs(spark, kind, tile_rows):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    as_kind = (lambda v: [float(np.float32(x)) for x in v]) if kind == "float" else (lambda v: [float(x) for x in v])
    for label in (0, 1, 2):
        for _ in range(8):
            middle = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((at, as_kind(middle + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.3])), label))
                at += 1
    rows += [(at + k, rows[5][1], rows[5][2]) for k in range(20)]  # copies
    rows += [(900, as_kind(x * 1e-30 for x in rows[0][1]), 0), (901, as_kind(x * 1e30 for x in rows[0][1]), 0), (5, rows[40][1], rows[40][2]), (None, rows[7][1], rows[7][2]), (None, [1.0] * 3, 0), (902, [1.0, 1.0, 0.999], 0)]
    rows += [(910, None, 0), (911, [0.0] * 12, 0), (912, [float("nan")] * 12, 0), (913, [float("inf")] + [1.0] * 11, 0), (914, [None] + [1.0] * 11, 0), (915, [], 0), (916, rows[0][1], None)]
    data = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, cls string, dim int, n int")
    key = lambda r: tuple(map(str, r))
    got = embedding_pairs.near_vectors(data, tile_rows=tile_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_links(rows, 0.93), key=key)


def test_linked_bounds_never_lose_a_pair():
    rng = np.random.default_rng(8)
    for dim, spread in ((3, 0.3), (20, 0.08), (70, 0.045), (70, 0.01)):
        a = rng.normal(size=(1, dim)) * (rng.random(dim) < 0.4) + rng.normal(size=(150, dim)) * spread
        b = a[rng.integers(0, 150, 170)] + rng.normal(size=(170, dim)) * spread
        axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
        cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        for threshold in (0.5, 0.93, 0.99):
            assert set(zip(*embedding_pairs.linked(a, b, axes, threshold), strict=True)) == set(zip(*np.nonzero(cosine >= threshold), strict=True))


def test_no_vectors(spark):
    assert embedding_pairs.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError):
        embedding_pairs.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), threshold=0)
