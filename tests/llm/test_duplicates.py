"""Near-duplicate operators and line dedup against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from eocatalog.llm import _links, embedding_dedup, line_dedup, minhash


def closure(nodes, links):
    forest = _links.Forest(len(nodes))
    place = {x: i for i, x in enumerate(nodes)}
    for u, v in links:
        forest.join(place[u], place[v])
    low = {}
    for x in sorted(nodes):
        low.setdefault(forest.root(place[x]), x)
    return {x: low[forest.root(place[x])] for x in nodes}


def shingles(text, width):
    lower = (text or "").translate(str.maketrans(minhash.c.UPPER, minhash.c.LOWER))
    for ch in "\t\n\x0b\x0c\r":
        lower = lower.replace(ch, " ")
    ws = [w for w in lower.split(" ") if w]
    if not ws:
        return set()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def brute_near(rows, width, percent):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = closure(ids, links)
    return {x: (len(sets[x]), comp[x], comp[x] == x) for x in ids}


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 60_000), (5, 80, 60_000), (3, 85, 50)])
def test_minhash_equals_brute_force(docs, rows, width, percent, block):
    out = minhash.near_duplicates(docs, width=width, percent=percent, block_shingles=block, block_sets=4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    want = brute_near(rows, width, percent)
    assert got == want
    assert any(not w[2] for w in want.values())


def test_minhash_group_of_near_copies_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        ws = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 9))):
            ws[at] = f"x{k}y{at}"
        rows.append((k, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, width=3, percent=85, halves=8, per_half=3, block_sets=16)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_near(rows, 3, 85)


def test_minhash_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == 7
    assert all(r[2] == r[0] for r in got)
    assert all(r[3] for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_linked_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (2, 3, 40):
        sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(n)]
        got = {tuple(p) for p in minhash.linked_pairs(np.arange(n), sets, np.zeros(n), 45).tolist()}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))}
        assert got == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.node: r.component for r in _links.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = sorted({x for p in links for x in p if p[0] != p[1]})
    assert got == closure(nodes, [p for p in links if p[0] != p[1]])
    assert _links.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows, least):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, float))
    ids, links = sorted(ok), []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links.append((a, b))
    comp = closure(sorted(r[0] for r in rows), links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}


@pytest.mark.parametrize(("tile", "most"), [(1024, 0.6), (8, 0.0), (16, 1.01)])
def test_embedding_dedup_equals_brute_force(spark, tile, most):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(150):
        v = centres[i % 6] + 0.15 * rng.standard_normal(16) if i % 3 else rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(150, rows[1][1], rows[1][2]), (151, rows[1][1], 1 - rows[1][2]), (152, None, 0), (153, [0.0] * 16, 0), (154, [float("nan")] * 16, 0), (155, [None, *[1.0] * 15], 1), (156, [1.0, 2.0], 0), (157, [1.0, 2.1], 0), (158, rows[1][1], None), (159, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.93, tile=tile, most=most).collect()}
    want = brute_vectors(rows, 0.93)
    assert got == want
    assert sum(w[0] > 0 for w in want.values()) > 20


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_range_join_finds_each_pair_within_budget_once(spread):
    rng = np.random.default_rng(8)
    points = rng.standard_normal((9, 5))[rng.integers(0, 9, 400)] + spread * rng.standard_normal((400, 5))
    homes, probes, found = points[:250], points[200:], []
    for h, p, near in embedding_dedup.range_join(homes, probes, 0.09, leaf=4):
        i, j = np.nonzero(near)
        found += zip(h[i].tolist(), p[j].tolist(), strict=True)
    gaps = ((homes[:, None] - probes[None]) ** 2).sum(axis=2)
    assert sorted(found) == sorted(map(tuple, np.argwhere(gaps <= 0.09).tolist()))


def test_candidates_hold_all_close_pairs_and_few_others():
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((600, 64))
    rows[300:] = rows[:300] + 0.2 * rng.standard_normal((300, 64))
    turned = embedding_dedup._unit(rows) @ embedding_dedup.rotation(64)
    parts, found = embedding_dedup.split(64, 4), []
    for h, p, near in embedding_dedup.candidates(turned, turned, [0, 1, 2, 3], parts, 0.14):
        i, j = np.nonzero(near)
        found += zip(h[i].tolist(), p[j].tolist(), strict=True)
    close = set(map(tuple, np.argwhere(turned @ turned.T >= 0.93).tolist()))
    assert len(found) == len(set(found)) and close <= set(found)
    assert len(close) > 1000 and len(found) < len(rows) ** 2 / 100


def test_links_keep_what_joins():
    links = _links.Links(np.array([10, 20, 30, 40, 50]))
    links.add(np.array([1, 1, 4]), np.array([2, 2, 3]))
    links.add(np.array([2, 4]), np.array([0, 3]))
    assert links.stars() == [(20, 10), (30, 10), (50, 40)]


def test_embedding_dedup_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links int, home string"
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, 5, "x"), (3, [1.0, 0.0], 1, 5, "x"), (3, [1.0, 0.0], 1, 5, "x")], schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def brute_lines(rows):
    key = lambda line: line.strip(line_dedup.c.WHITE).translate(str.maketrans(line_dedup.c.UPPER, line_dedup.c.LOWER))
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= 20 and len(held[k]) >= 3 and i < max(held[k]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_equals_brute_force(docs, rows):
    got = {r.doc_id: (r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    assert got == want
    assert sum(w[1] for w in want.values()) > 5


def test_line_dedup_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd, min_docs=2)
    assert out.columns == [*odd.columns, "_n_lines", "_n_dropped"]
    assert [r._n_dropped for r in out.collect()] == [0] * 7
    assert line_dedup.dedup_lines(empty).count() == 0


def test_embedding_dedup_ids_shared_by_different_vectors(spark):
    a, b, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(3, a, 1), (5, a, 1), (5, b, 1), (9, b, 1), (11, d, 1), (11, d, 2)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 1, 3), (11, 0, 11), (11, 0, 11)]


def test_cells_are_made_where_they_prune():
    counts = [(2, 0, cell, 10, 20) for cell in range(10)] + [(2, 1, cell, 50, 100) for cell in range(2)]
    assert embedding_dedup.choose_cells(counts, blocks=2, grid=3, most=0.6) == {2: [[0], []]}


SHARED_IDS = [(3, "A"), (5, "A"), (5, "B"), (9, "B"), (11, "C"), (12, "D"), (12, "C"), (20, "E"), (20, "E"), (None, "A"), (30, ""), (30, "")]


def _spelled(letter):
    return " ".join(f"{letter.lower()}{k}" for k in range(30)) if letter else ""


def test_minhash_ids_shared_by_different_texts(spark):
    df = spark.createDataFrame([(i, _spelled(x)) for i, x in SHARED_IDS], "doc_id long, text string").repartition(3)
    got = sorted({(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect() if r.doc_id})
    assert got == [(3, 3), (5, 3), (9, 3), (11, 11), (12, 11), (20, 20), (30, 30)]


def test_keep_one_loses_no_text(spark):
    df = spark.createDataFrame([(i, _spelled(x)) for i, x in SHARED_IDS if i], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in minhash.keep_one(df).collect())
    assert got == [(3, _spelled("A")), (5, _spelled("B")), (11, _spelled("C")), (12, _spelled("D")), (20, _spelled("E")), (30, ""), (30, "")]
