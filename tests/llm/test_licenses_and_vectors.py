"""Licence scans, centroid clusters and whitening against plain versions, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionlore.llm import centroid_clusters, license_scan, whitening

SMALL = st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), min_size=1, max_size=5)


def runs(body):
    return {tuple(body[i:j]) for i in range(len(body)) for j in range(i + 1, len(body) + 1)}


@settings(max_examples=200, deadline=None)
@given(SMALL, st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=25))
def test_matching_statistics(templates, text):
    found = license_scan.Automaton(templates)
    known = set().union(*map(runs, templates))
    states, lengths = found.stream([found.vocabulary.get(w, -1) for w in text])
    for i, (state, length) in enumerate(zip(states, lengths)):
        want = max([n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in known], default=0)
        assert length == want
        if length:
            run = text[i + 1 - length:i + 1]
            places = [(t, e) for t, body in enumerate(templates) for e in range(length, len(body) + 1) if body[e - length:e] == run]
            assert found.ends[state] == places


def plain_base(text):
    """(words, starts, labels) by looking at every place."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        want = phrase.split()
        for i in range(len(own) - len(want) + 1):
            if own[i:i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit License, GNU é word CC-BY The".split()), max_size=40).map(" ".join))
def test_phrases(text):
    found = license_scan.find([text.encode()], license_scan.scanner())
    assert tuple(c[0] for c in found[:5]) == plain_base(text)


def test_the_query_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in entry.queries()["op11_license_scan"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs) and any(r.n_base for r in rows.values())
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_spans_of_changed_notices():
    using = license_scan.scanner()
    notice = dict(reversed(license_scan.NOTICES))["bsd"]
    own = notice.split()
    changed = " ".join([*own[:10], "really", *own[10:25], "quite", *own[26:]])
    labels, starts, ends, shares = license_scan.find([f"x y {notice} z {changed} {' '.join(own[:20])}".encode()], using)[7:]
    assert labels[0] == ["bsd", "bsd"]
    size = len(license_scan.words(notice.encode()))
    assert (starts[0][0], ends[0][0], shares[0][0]) == (2, 2 + size, 1.0)
    assert starts[0][1] == 3 + size and ends[0][1] == 4 + 2 * size and shares[0][1] == (size - 1) / size


def test_chains_go_forward():
    s = license_scan.Settings(match=2, gap=2, share=0.5)
    # The second match lies before the first in the template: two chains, neither covers half.
    assert license_scan.chain([(4, 4, 0, 8), (8, 4, 0, 4)], [10], s) == []
    assert license_scan.chain([(4, 4, 0, 4), (9, 4, 0, 9)], [10], s) == [(0, 9, 0, 0.8)]
    # An overlap counts once, and too wide a gap parts chains.
    assert license_scan.chain([(4, 4, 0, 4), (6, 4, 0, 6)], [6], s) == [(0, 6, 0, 1.0)]
    assert license_scan.chain([(4, 4, 0, 4), (20, 4, 0, 8)], [8], s) == [(0, 4, 0, 0.5), (16, 20, 0, 0.5)]


def test_licenses_of_odd_rows(odd, none):
    found = license_scan.scan_licenses(odd.withColumn("labels", F.lit("old")))
    assert found.columns.count("labels") == 1 and found.count() == 12
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[2].n_words == 0 and rows[2].first_word is None and rows[2].score == 0 and rows[2].labels == ""
    assert rows[6].n_words == 10000
    assert license_scan.scan_licenses(none).collect() == []
    long = license_scan.find([(dict(license_scan.NOTICES)["bsd"] + " ").encode() * 500], license_scan.scanner())
    assert len(long[7][0]) == 500


def plain_clusters(vectors, count, rounds, dims, factor):
    kept = {i: tuple(int(np.floor(factor * x)) for x in v) for i, v in vectors if v is not None and len(v) == dims
            and all(x is not None and np.isfinite(x) for x in v)}
    order = sorted(kept, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:count]
    centroids = [kept[i] for i in order]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        own = {}
        for v in kept.values():
            own.setdefault(nearest(v), []).append(v)
        centroids = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else c for k, c in enumerate(centroids)]
    out = {i: (nearest(v), far(v, centroids[nearest(v)])) for i, v in kept.items()}
    inertia = {}
    for k, d in out.values():
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return {i: (k, d, inertia[k], sum(inertia.values()), digest[k]) for i, (k, d) in out.items()}


@pytest.mark.parametrize("wide", [1.0, 3000.0])
def test_clusters(spark, wide, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "STEP", 50)
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.4) * wide for _ in range(5)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0] * 4), (302, [None] * 5), (303, [float("nan")] * 5), (304, []), (305, vectors[7][1])]
    vectors += [(306, [float("inf")] * 5), (307, [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<double>, cluster int").repartition(4)
    got = centroid_clusters.cluster(table, count=7, rounds=4, dims=5, factor=16).collect()
    assert {r.vec_id: tuple(r)[1:] for r in got} == plain_clusters(vectors, 7, 4, 5, 16)


def test_clusters_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [0.5, 0.25])] * 5 + [(None, [0.5, 0.25]), (2, [1e30, 1.0])], kind)
    rows = centroid_clusters.cluster(same, count=3, dims=2).collect()
    assert len(rows) == 6 and all((r.cluster, r.distance, r.inertia) == (0, 0, 0) for r in rows)
    assert centroid_clusters.cluster(same.limit(0), dims=2).collect() == []
    assert centroid_clusters.cluster(same.where("vec_id IS NULL"), dims=2).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(0, 40), st.integers(0, 10))
def test_bit_sliced_products(rows, dims, size, seed):
    rng = random.Random(seed)
    bits = [rng.randint(0, size) for _ in range(dims)]
    values = [[rng.getrandbits(b) if b else 0 for b in bits] for _ in range(rows)]
    got = whitening.weighted(whitening.common_bits(whitening.planes(np.array(values, np.int64), bits)), bits)
    assert all(got[d][e] == sum(v[d] * v[e] for v in values) for d in range(dims) for e in range(d, dims))


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STEP", 100)
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(6, 6)) * np.array([4, 3, 2, 1, 1, 0.5])[:, None]
    vectors = (rng.normal(size=(700, 6)) @ spread + 3).tolist()
    vectors += [vectors[0]] * 5
    odd = [None, [None] * 6, [float("nan")] * 6, [float("inf")] * 6, [1.0] * 5, [], [1e200] * 6]
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors + odd)], "vec_id long, embedding array<double>, n int").repartition(5)
    rows = {r.vec_id: r for r in whitening.whiten(table, width=4).collect()}
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    assert len(rows) == n and {r.n for r in rows.values()} == {n}
    assert [rows[i].deviation for i in range(n)] == ((n * x - total) ** 2).sum(1).tolist()
    white = np.array([rows[i].whitened for i in range(n)])
    centred = x - total / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    want = centred @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-7)
    assert np.allclose(rows[0].explained, values[::-1][:4] / np.trace(cov), rtol=1e-9)
    plain = white - white.mean(0)
    assert abs(rows[0].identity_error - np.abs(plain.T @ plain / n - np.eye(4)).max()) < 1e-9 and rows[0].identity_error < 1e-6


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [0.5, 0.25])] * 3, kind)
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()] == [(3, 0, [], [], 0.0)] * 3
    flat = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [2.0, 1.0])], kind)
    found = whitening.whiten(flat).collect()
    assert all(len(r.whitened) == 1 and r.explained == [1.0] for r in found) and len(found) == 3
    assert whitening.whiten(same.limit(0)).collect() == []
    huge = spark.createDataFrame([(i, [float(2 ** 50), float(i)]) for i in range(4)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_whitening_query(spark):
    rows = entry.queries()["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 * 32 and {r.component for r in rows} == set(range(1, 33))
    assert rows[0].identity_error < 1e-4 and len({r.explained for r in rows}) == 32
