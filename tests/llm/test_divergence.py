"""Divergence of sources, against plain counting in Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eocatalog.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plainly(rows, least_docs, top):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for row in rows:
        text, lang, source = ("" if x is None else x for x in row)
        found = [x.translate(UPPER) for x in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        of = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        distance = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            p = {t: share(counts[lang, s][t], of[s]) for t in kept}
            pairs = [(o, sum(distance(p[t], share(counts[lang, o][t], of[o])) for t in kept)) for o in sources if o != s]
            terms = [(t, distance(p[t], q)) for t in kept if counts[lang, s][t] and p[t] > (q := share(every[t], sum(every.values())))]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:top])):
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())))}
    return out


@pytest.mark.parametrize(("chunk_terms", "block_sources"), [(4096, 32), (20, 2), (3, 1)])
def test_rows_equal_plain_counting(spark, docs, rows, chunk_terms, block_sources):
    out = divergence.audit(docs, least_docs=3, top=4, chunk_terms=chunk_terms, block_sources=block_sources)
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plainly([(r[1], r[2], r[3]) for r in rows], 3, 4)


def test_odd_rows_ties_and_empty(spark, odd, empty):
    own = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit(odd, least_docs=1).collect()} == plainly(own, 1, 10)
    assert {tuple(r) for r in divergence.audit(odd).collect()} == plainly(own, 10, 10)  # no kept terms: pairs of value 0
    assert divergence.audit(empty).count() == 0


def test_edges_of_terms_and_long_texts(spark):
    rows = [("a", "en", "s"), ("b A", "en", "s"), ("É\x00é_x`Z{z~", "en", "t"), ("", "en", "u"), (None, "en", "t"), ("ab", "en", "s"), ("Éé a\x7fb", "en", "t"), ("word " * 250_000 + "Straße", "en", "t")]
    table = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    assert {tuple(r) for r in divergence.audit(table, least_docs=1).collect()} == plainly(rows, 1, 10)


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    whole = rng.integers(1, 8 * 10**15, 2000)
    count = (whole * rng.random(2000)).astype(np.int64)
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(count, whole, strict=True)]
