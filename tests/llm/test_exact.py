"""Operators against plain versions on small data, and against the libraries that define their results."""

import math
import random
import re
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from sessionlore.llm import decontaminate, hyperminhash, language_id, lattice, linking, line_dedup, lm_score
from sessionlore.llm import passage_dedup, piece_codec, rolling, secret_scan, token_counts, vector_dedup

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.lists(st.sampled_from(list("abcdehilnorst'  \n\t.,!09éñß漢▁👍’") + ["the ", "'s", "'re", "   "]), max_size=60).map("".join)
LONG = ["a" * 3000, " " * 1000, "xyz" * 900, "'" * 700, "\n" * 600, "the cat " * 400, "漢字" * 500, "q" * 255 + " " + "z" * 257]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


@lru_cache
def transducer():
    with open(BYTES, "rb") as file:
        return token_counts.Transducer(file.read(), token_counts.character_kinds())


@lru_cache
def tokenizer():
    return Tokenizer.from_file(BYTES)


@lru_cache
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS | st.text(max_size=40), max_size=6))
def test_token_counts(texts):
    texts = [t + x for t, x in zip(texts, ["", "<|endoftext|>"] * 3)]
    got = transducer().count([t.encode() for t in texts]).tolist()
    assert got == [len(e.ids) for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_long_texts():
    got = transducer().count([t.encode() for t in LONG]).tolist()
    assert got == [len(tokenizer().encode(t).ids) for t in LONG]


@settings(max_examples=300, deadline=None)
@given(TEXTS | st.text(max_size=40))
def test_pieces(text):
    model, library = piece_codec.load(PIECES), processor()
    ids = library.encode(text)
    assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)


def test_pieces_of_long_texts():
    model, library = piece_codec.load(PIECES), processor()
    found = model.digests([t.encode() for t in LONG], True)
    for text, n, ids, decoded, array in zip(LONG, *found):
        want = library.encode(text)
        assert array.tolist() == want and n == len(want)
        assert ids == sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decoded == sha256(library.decode(want).encode()).hexdigest()


def test_decode_column(spark):
    rows = spark.createDataFrame([(processor().encode(" a ñ\n漢"),), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in piece_codec.decode_ids(rows, PIECES).collect()] == [" a ñ\n漢", None, ""]


def test_passages(docs, corpus):
    seen, want = {}, {}
    for size in (4, 50):
        for i, text in corpus:
            w = text.split()
            for k in range(len(w) - size + 1):
                seen.setdefault((size, tuple(w[k:k + size])), i)
        for i, text in corpus:
            w, gone = text.split(), set()
            for k in range(len(w) - size + 1):
                if seen[size, tuple(w[k:k + size])] < i:
                    gone |= set(range(k, k + size))
            want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        got = {r.doc_id: r.kept for r in passage_dedup.remove_passages(docs, size=size).collect()}
        assert got == want


def plain_components(nodes, links):
    low = {n: n for n in nodes}
    while True:
        new = {n: min([low[n]] + [low[b] for a, b in links if a == n] + [low[a] for a, b in links if b == n]) for n in nodes}
        if new == low:
            return low
        low = new


def shingles(text, size):
    w = re.findall(r"[^ \t-\r]+", text.lower())
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, size, percent):
    sets = {i: shingles(t, size) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = plain_components(sets, links)
    rows = hyperminhash.near_duplicates(docs, size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), low[i]) for i in sets}
    assert sorted(r.doc_id for r in hyperminhash.keep_first(docs, size=size, percent=percent).collect()) == sorted(set(low.values()))


@pytest.mark.parametrize("rare", [0, 2])
def test_near_duplicates_left_apart_are_compared(spark, monkeypatch, rare):
    """Without rounds of leading members of bands every pair goes through the rare shingles."""
    monkeypatch.setattr(hyperminhash, "_ROUNDS", 0)
    monkeypatch.setattr(hyperminhash, "_RARE_ROUNDS", rare)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(20):
        own = list(words)
        own[3 * i % 60] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{i}_{k}" for k in range(60))) for i in range(5)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 100 else i for i, _ in rows}


def mirrored():
    """Two words of 1,024 letters that polynomials modulo a power of two cannot tell apart."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hashes_of_regular_words_differ():
    one, two = mirrored()
    words = rolling.Words([one.encode(), two.encode()])
    assert all(words.hashes(lane)[0] != words.hashes(lane)[1] for lane in (0, 1))
    words = rolling.Words([" ".join(x).encode() for x in (one, two)])
    ends = np.array([[0, 1024], [1024, 2048]])
    assert all(len(set(rolling.stretches(words.hashes(lane), *ends, lane).tolist())) == 2 for lane in (0, 1))
    assert all(len(set(rolling.windows(words.hashes(lane), 1024, lane)[[0, 1024]].tolist())) == 2 for lane in (0, 1))


def test_products_modulo_the_prime():
    rng = random.Random(1)
    some = [rng.randrange(rolling.PRIME) for _ in range(500)] + [0, 1, rolling.PRIME - 1]
    got = rolling.times(np.array(some, np.uint64), np.array(some[::-1], np.uint64))
    assert got.tolist() == [a * b % rolling.PRIME for a, b in zip(some, some[::-1])]


def test_regular_words_are_not_taken_for_each_other(spark):
    one, two = mirrored()
    plain = [f"w{k}" for k in range(60)]
    first, second = (" ".join([*plain[:30], w, *plain[31:]]) for w in (one, two))
    rows = spark.createDataFrame([(1, first), (2, second), (3, one), (4, two), (5, " ".join(one)), (6, " ".join(two))],
                                 "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in passage_dedup.remove_passages(rows.where("doc_id < 5")).collect()} == dict.fromkeys(range(1, 5), 0)
    found = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(rows.where("doc_id in (3, 4)")).collect()}
    assert found == {3: 3, 4: 4}
    long = passage_dedup.remove_passages(rows.where("doc_id > 4"), size=1024).collect()
    assert [r.n_removed for r in long] == [0, 0]


def test_sketch_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.5, 0.85, 1.0):
        pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
        n = int(2000 * (1 + share) / 2)
        a, b = np.unique(pool[:n]), np.unique(pool[2000 - n:2000])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found, _ = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], len(a), len(b))
        errors.append(abs(float(found[0]) - truth))
    assert max(errors) < 0.16


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
                                   [(5, 3), (3, 5), (7, 7), (9, 8), (8, 2), (2, 9)]])
def test_components(spark, links):
    table = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in linking.components(table).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain_components(nodes, links)


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefghijkl", "AKIA",
             "ABCDEFGHIJ0123456", "0123456789abcdef", "xyz", "é", "👍", "\n", "ghp_" + "A1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    want = {}
    for i, text in rows:
        found = []
        for order, rule in enumerate(secret_scan.RULES):
            found += [(m.start(), order, m.end()) for m in re.finditer(rule.pattern, text)
                      if len(m.group(rule.group)) >= rule.least]
        want[i] = [(a, secret_scan.RULES[k].kind, b) for a, k, b in sorted(found)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == want
    assert sum(map(len, want.values())) > 300


def test_trigram_queries():
    ask = secret_scan.trigram_query
    assert ask(r"[0-9a-f]+") == [] and ask(r"ab") == [] and ask(r"(abc|x)") == []
    assert ask(r"(?i:ABCD)x*") == [frozenset({"abc", "bcd"})]
    assert ask(r"(abc|def)[0-9]+ghi") == [frozenset({"abc", "ghi"}), frozenset({"def", "ghi"})]
    assert ask(r"ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]


def test_lines(docs, corpus):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in corpus:
        for x in text.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not (
        len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i < max(holders[key(x)]))) for i, t in corpus}
    got = line_dedup.dedup_lines(docs.withColumn("n_chars", F.length("text"))).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_benchmark(spark, docs, corpus, block_bytes):
    rng = random.Random(9)
    items = [(k, " ".join(corpus[rng.randrange(120)][1].split()[a:a + n])) for k in range(12)
             for a, n in [(rng.randrange(20), rng.choice([3, 10, 25]))]] + [(50, "not to be found anywhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = {}
    for i, text in corpus:
        w, hit, names = split(text), set(), set()
        for k, body in items:
            own = split(body)
            n = min(10, len(own))
            for a in range(len(own) - n + 1) if own else ():
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == own[a:a + n]:
                        hit |= set(range(b, b + n))
                        names.add(str(k))
        want[i] = (len(w), len(hit), sorted(names))
    got = decontaminate.match_benchmark(docs, bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
    assert {r.doc_id: sum(b - a for a, b in zip(r.hit_starts, r.hit_ends)) for r in got} == {i: v[1] for i, v in want.items()}
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, block_bytes=block_bytes).collect()}
    assert kept == {i for i, v in want.items() if not v[1]}


def test_longest_match(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    body = " ".join(f"w{i}" for i in range(5, 25))
    rows = spark.createDataFrame([(1, f"x {body} y"), (2, body + " " + body)], "doc_id long, text string")
    assert [r.longest for r in decontaminate.match_benchmark(rows, bench).orderBy("doc_id").collect()] == [20, 20]


def test_vectors(spark, monkeypatch):
    """Many small cells, blocks of two members: sums of links must still count every pair once."""
    monkeypatch.setattr(vector_dedup, "CELL", 16)
    monkeypatch.setattr(vector_dedup, "BLOCK", 2)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 200)] + 0.2 * rng.normal(size=(200, 24))
    x[150:] = rng.normal(size=(50, 24))
    x[10] = x[11]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    low = plain_components(range(200), [(int(a), int(b)) for a, b in zip(*np.nonzero(close)) if a < b])
    got = vector_dedup.link_vectors(spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    found = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert found.sum() >= 0.99 * close.sum() and (found <= close.sum(1)).all() and close.sum() > 500
    assert np.mean([r.component_id == low[r.vec_id] for r in got]) >= 0.99


def test_window_counts():
    rng = np.random.default_rng(2)
    unit = vector_dedup._unit(rng.normal(size=(40, 12)))
    line = unit @ vector_dedup._directions(12, vector_dedup.PROJECTIONS, 2)
    want = (np.abs(line[:, None] - line[None]) <= 0.5).sum(2)
    assert (vector_dedup.collisions(unit, unit, 0.5) == want).all()


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * segmentations(word[k:], pieces) for k in range(1, len(word) + 1) if (p := pieces.get(word[:k])))


def test_lattice_sums_all_segmentations():
    with open(PIECES, "rb") as file:
        names, logs, byte = lattice.vocabulary(file.read())
    pieces = {p: math.exp(x) for p, x in zip(names, logs) if p}
    found = lattice.Lattice(names, byte, logs)
    words = ["▁the", "▁thering", "▁a", "▁", "▁ñandú", "▁internat"]
    total, uses = found.forward(words, np.ones(len(words)))
    assert np.allclose(total, [math.log(segmentations(w, pieces)) for w in words])
    other = found.forward(["▁a"])[0] - found.forward(["▁a"])[0]
    assert np.isclose(other, logs[byte[list("".encode())]].sum())
    assert np.isclose(sum(uses * [len(n) for n in names]), sum(map(len, words)))


def test_scores(spark, docs, corpus):
    learned = [(i, t) for i, t in corpus if i % 2]
    rows = lm_score.score_documents(docs, PIECES, learn=F.col("doc_id") % 2 == 1).collect()
    counts = Counter(w for _, t in learned for w in t.lower().split())
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    with open(PIECES, "rb") as file:
        content = file.read()
    names, _, byte = lattice.vocabulary(content)
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    found = lattice.Lattice(names, byte, np.frombuffer(lm_score.fit_pieces(words, content)))
    part = {w: math.exp(x) for w in {w for _, t in corpus for w in t.lower().split()}
            for x in found.forward(["▁" + w])}
    for r in rows:
        own = dict(corpus)[r.doc_id].lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(learned) + 1) / (n + v + 1))
        score = math.log10(len(learned) / n) + sum(math.log10(
            max(counts[w] - lm_score.DISCOUNT, 0) / n + lm_score.DISCOUNT * len(counts) / n * part[w]) for w in own)
        assert (r.train_tokens, r.n_tokens, r.held_out) == (n, len(own) + 1, r.doc_id % 2 == 0)
        assert r.n_known == sum(counts[w] > 0 for w in own) + 1
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_scores_with_nothing_learned(docs):
    rows = lm_score.score_documents(docs, PIECES, learn=F.lit(False)).collect()
    assert all(r.train_tokens == r.n_known == 0 and math.isfinite(r.score) and r.score < 0 for r in rows)


def plain_posteriors(emit, moves):
    emit, moves = np.exp(emit), np.exp(moves)
    ahead, back = [emit[0]], [np.ones(emit.shape[1])]
    for e in emit[1:]:
        ahead.append(ahead[-1] @ moves * e / (ahead[-1] @ moves * e).sum())
    for e in emit[:0:-1]:
        back.append(moves @ (e * back[-1]) / (moves @ (e * back[-1])).sum())
    out = np.array(ahead) * np.array(back[::-1])
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("lengths", [[1], [3, 0, 2], [129, 1, 300], [128, 256, 257]])
def test_forward_backward(lengths):
    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(sum(lengths), 3)), rng.normal(size=(3, 3))
    got, at = language_id.posteriors(emit, moves, np.array(lengths)), 0
    for n in lengths:
        if n:
            assert np.allclose(got[at:at + n], plain_posteriors(emit[at:at + n], moves))
        at += n


def test_language_of_held_out_documents_and_of_mixed_words(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    away = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.train(rows.where(~away))
    found = language_id.identify(rows.where(away), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98 and all(0 <= r.score <= 1 for r in found)
    words = language_id.label_words(model, "the of and that with for is ungkeit einschen und der die mit lichkeit")
    assert [x for _, x, _ in words] == ["en"] * 7 + ["de"] * 7
