"""Collocations, whitening and nearest neighbours against brute force, and on rows with odd values."""

from __future__ import annotations

import collections
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import collocations, neighbours, whitening
from tallymark.llm.common import ship
from tallymark.llm.queries import QUERIES

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, words int, phrase string, n long, rank int, tm_cut int"


def documents(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, text, lang, "src0", 1, 1, "x", 1, 1, 1) for i, (text, lang) in enumerate(rows)], SHAPE).repartition(3)


# --- 11


def phrases_by_force(rows, max_n=3, least=10, share=50, top=2000):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_n + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        scored = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [c for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= share * a for c in longer):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, rr, totals[lang], -s) for r, (s, a, p, l, rr) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found_phrases(docs, **settings):
    return sorted(map(tuple, collocations.collocations(docs, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


ODD_TEXTS = [
    (None, "en"), ("", "en"), (" \t\n.", None), ("one", "xx"), ("New York City. new york\tcity, NEW YORK city!", None),
    *[("new york city is; old york is ünï \x1c \x85 new york", "en")] * 6, *[("a b a b a b a b", "")] * 3, ("w " * 20_000 + ". ÀB àb", "de"), ("\U0001f389 x " * 12, "fr"), ("ﬀ x " * 12 + " y " * 12, "fr"),
]


def test_phrases_by_force(spark):
    docs = documents(spark, ODD_TEXTS)
    assert found_phrases(docs) == phrases_by_force(ODD_TEXTS)
    assert found_phrases(docs, max_n=5, min_count=3, share=80, top=7) == phrases_by_force(ODD_TEXTS, 5, 3, 80, 7)
    assert found_phrases(docs.limit(0)) == []


def test_phrases_in_any_stretches(spark, monkeypatch):
    """Small stretches, small tasks' tables and a filter of one word change nothing."""
    rows = [(f"alpha beta gamma delta {i % 3} alpha beta; gamma {'delta ' * (i % 4)}", "en") for i in range(60)]
    wanted = phrases_by_force(rows)
    assert len(wanted) > 5
    text = " ".join(t for t, _ in rows).encode()
    numbers = collocations.Numbers({collocations.MARK: 0})
    whole = np.concatenate(list(collocations.word_numbers(text, numbers)))
    monkeypatch.setattr(collocations, "STRETCH", 7)
    assert np.array_equal(np.concatenate(list(collocations.word_numbers(text, numbers))), whole)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "BLOOM_LEAST", 64)
    monkeypatch.setattr(collocations, "BLOOM_BITS", 64)
    assert found_phrases(documents(spark, rows)) == wanted


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    known = spark.createDataFrame([("en", 2, "a b", big - 7), ("en", 1, "a", big), ("en", 1, "b", big - 1)], "lang string, words int, phrase string, n long")
    assert [tuple(r) for r in collocations.scored(known).select("a", "l", "r", "score").collect()] == [(big - 7, big, big - 1, 1_000_000 * (big - 7) ** 2 // (big * (big - 1)))]


def test_grams_of_one_hash_stay_apart(monkeypatch):
    ids = np.array([1, 2, 0, 2, 1, 0, 1, 2], np.int32)
    monkeypatch.setattr(collocations, "mixed", lambda a, b: np.zeros(len(a), np.uint64) + np.uint64(5))
    batches = list(collocations.phrase_table("en", ids, collocations.Numbers({collocations.MARK: 0, b"a": 1, b"b": 2}), range(1, 3), np.full(1, 2**64 - 1, np.uint64)))
    assert sorted((w, p, n) for b in batches for w, p, n in zip(*(b.column(c).to_pylist() for c in ("words", "phrase", "n")))) == [(0, "", 6), (1, "a", 3), (1, "b", 3), (2, "a b", 2), (2, "b a", 1)]


def test_filter_has_no_false_misses():
    random = np.random.default_rng(1)
    hashes = random.integers(0, 2**63, 5000).astype(np.uint64)
    bits = 1 << 16
    table = np.zeros(bits // 64, np.uint64)
    for at in collocations.places(hashes, bits):
        np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    assert collocations.holds(table, hashes).all()
    assert collocations.holds(table, random.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.05


# --- 12

VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, tm_vector string, tm_row int"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, 0, 1, 1, "x", 1) for i, v in rows], VECTORS).repartition(3)


def exact_fit(xs):
    """Covariance in fractions, by definition."""
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    return mean, np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n) for j in range(d)] for i in range(d)])


def check_whitening(rows, out, components):
    usable = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    xs, n = [x for _, x in usable], len(usable)
    mean, cov = exact_fit(xs)
    values = np.linalg.eigvalsh(cov)[::-1]
    sums = [sum(c) for c in zip(*xs)]
    got = collections.defaultdict(list)
    for r in out:
        got[r.vec_id].append(r)
    for i, x in usable:
        own = sorted(got[i], key=lambda r: r.component)
        copies = sum(1 for j, _ in usable if j == i)
        assert [r.component for r in own] == [k for k in range(1, components + 1) for _ in range(copies)]
        for r in own:
            if copies == 1:
                assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 and r.identity_error <= 1e-4
    single = [i for i, _ in usable if sum(1 for j, _ in usable if j == i) == 1]
    z = np.array([[r.whitened for r in sorted(got[i], key=lambda r: r.component)] for i in single])
    y = np.array([[float(a - m) for a, m in zip(x, mean)] for i, x in usable if i in set(single)])
    basis = np.linalg.lstsq(y, z, rcond=None)[0] * np.sqrt(values[:components])  # the components that the rows were projected on
    assert np.allclose(y @ basis / np.sqrt(values[:components]), z, atol=1e-8)
    assert np.allclose(basis.T @ basis, np.eye(components), atol=1e-7) and np.allclose(cov @ basis, basis * values[:components], rtol=1e-7, atol=1e-7 * values[0])


def test_whitening_by_force(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=10) * np.arange(1, 11)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 9 + [None]), (103, [float("nan")] * 10), (104, [float("inf")] * 10), (105, [1.0] * 3), (106, [1e30] + [0.0] * 9)]
    table = vectors(spark, [*rows, *odd])
    out = whitening.whitened(table).collect()
    assert len(out) == 8 * len(rows) and {r.vec_id for r in out} == set(range(60))
    check_whitening(rows, out, 8)
    assert whitening.whitened(table, components=3).count() == 180


def test_whitening_odd_rows(spark):
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    out = whitening.whitened(vectors(spark, [(1, [1.0, 5.0]), (None, [2.0, 5.0]), (1, [3.0, 5.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n, round(r.explained, 9), abs(round(r.whitened, 6))) for r in out) == [(False, 1, 3, 1.0, 1.224745)] * 2 + [(True, 1, 3, 1.0, 0.0)]


def test_residues_carry_wide_sums(spark):
    """Entries near the bound: sums pass 128 bits, deviations 38 digits."""
    random = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in random.uniform(-1, 1, 4) * 2.0**50]) for i in range(40)]
    table = vectors(spark, rows)
    good, d = whitening.vectors_of(table, "embedding")
    fit = whitening.fitted(good, d, 2)
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    assert fit.sums == tuple(sum(c) for c in zip(*xs))
    values = np.linalg.eigvalsh(exact_fit(xs)[1])[::-1]
    assert np.allclose(fit.explained, values[:2] / values.sum(), rtol=1e-9)
    devs = {r.vec_id: r.deviation for r in whitening.whitened(table, components=1).collect()}
    for (i, _), x in zip(rows, xs):
        wanted = sum((40 * a - s) ** 2 for a, s in zip(x, fit.sums))
        assert devs[i] == (wanted if wanted < 10**38 else None)


def test_moduli_are_primes():
    found = whitening.primes(2**200)
    assert math.prod(found) > 2**200 and all(p % k for p in found for k in range(2, math.isqrt(p) + 1))
    assert whitening.STEP * whitening.PRIMES_BELOW**2 <= 2**53


def test_whitening_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op12_whitening"](spark, sf)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    xs = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    out = {(r.vec_id, r.component): r for r in df.collect()}
    n, values = len(xs), np.linalg.eigvalsh(np.cov(xs.T, bias=True))[::-1]
    off = n * xs - xs.sum(axis=0)
    for (i, _), o in zip(rows, off):
        assert out[i, 1].deviation == (o * o).sum()
    z = np.array([[out[i, k].whitened for k in range(1, 9)] for i, _ in rows])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(8)).max() < 1e-9 and np.allclose([out[rows[0][0], k].explained for k in range(1, 9)], values[:8] / values.sum(), rtol=1e-9)


# --- 13


def nearest_by_force(rows, k=10, every=100):
    usable = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, i, v in usable:
        if i % every == 0:
            order = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for m, j, w in usable if m != n)[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(order, 1)]
    return sorted(out)


def found_rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_nearest_odd_rows(spark):
    odd = [(200, None), (300, []), (400, [0.0, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0]), (600, [1.0, None, 0.0]), (700, [float("inf"), 0.0, 1.0]), (800, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(30)] + [(100, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (0, [3.0, 1.0, 2.0])]
    got = found_rows(neighbours.nearest_rows(vectors(spark, [*rows, *odd])))
    assert got == nearest_by_force(rows)  # ties, copies and repeated ids
    few = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (100, [9.0, 2.0, 4.0])]
    assert found_rows(neighbours.nearest_rows(vectors(spark, few))) == nearest_by_force(few)
    assert found_rows(neighbours.nearest_rows(vectors(spark, [(0, [1.0, 2.0])]))) == []
    assert found_rows(neighbours.nearest_rows(vectors(spark, few).limit(0))) == []


def test_index_finds_every_code_within_the_radius():
    random = np.random.default_rng(2)
    codes = random.integers(0, 2**63, (3000, 4)).astype(np.uint64)
    codes[500:1000] = codes[0] ^ (np.uint64(1) << random.integers(0, 63, (500, 4)).astype(np.uint64))
    index = neighbours.Index(codes)
    for q in (0, 700, 2000):
        seen, apart = set(), neighbours.code_distance(codes, codes[q])
        for radius, new in index.steps(codes[q]):
            assert not seen & set(new.tolist())
            seen |= set(new.tolist())
            assert set(np.flatnonzero(apart <= radius).tolist()) <= seen
        assert len(seen) == len(codes)


def recall(found, rows):
    wanted, got = collections.defaultdict(set), collections.defaultdict(set)
    for q, _, j, _ in nearest_by_force(rows):
        wanted[q].add(j)
    for q, _, j, _ in found:
        got[q].add(j)
    return sum(len(wanted[q] & got[q]) for q in wanted) / sum(map(len, wanted.values()))


@pytest.mark.parametrize("blocks", [1, 5])
def test_recall_with_clusters_and_copies(spark, monkeypatch, blocks):
    """One third of all rows are near copies of one vector; the rest lie at random or in clusters."""
    random = np.random.default_rng(7)
    base = random.normal(size=(3000, 24))
    base[:1000] = base[0] + 0.01 * random.normal(size=(1000, 24))
    base[1000:1500] = base[1000 + np.arange(500) % 10] + 0.2 * random.normal(size=(500, 24))
    rows = [(int(i), [float(np.float32(x)) for x in base[p]]) for i, p in enumerate(random.permutation(3000))]
    monkeypatch.setattr(neighbours, "BLOCK_LEAST", 3000 // blocks)
    found = found_rows(neighbours.nearest_rows(vectors(spark, rows)))
    assert [(q, r) for q, r, *_ in found] == [(q, r) for q in range(0, 3000, 100) for r in range(1, 11)]
    assert recall(found, rows) >= 0.95


def test_nearest_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op13_nearest"](spark, sf)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = found_rows(df)
    exact = {(q, j): s for q, _, j, s in nearest_by_force(rows, k=len(rows))}
    assert all(exact[q, j] == s for q, _, j, s in found) and recall(found, rows) >= 0.9


def test_batches_without_rows():
    marks, numbers = np.zeros(3, np.int32), collocations.Numbers({collocations.MARK: 0})
    assert list(collocations.hash_table("en", marks, numbers, range(1, 6))) == []
    assert [b.column("n").to_pylist() for b in collocations.phrase_table("en", marks, numbers, range(1, 6), np.zeros(1, np.uint64))] == [[0]]
    assert isinstance(whitening.Whitening(1, (0,), np.zeros((1, 0)), np.zeros(0), 1).deviations(np.zeros((0, 1), np.int64)), pa.Array)


# --- 7 and 8


def test_bpe_query_gives_the_library_s_digests(spark, sf):
    """The whole query against tiktoken, on the smallest table."""
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = codec.encode_ordinary(r.text or "")
        wanted.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    got = QUERIES["op7_byte_bpe"](spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(wanted)


@pytest.mark.parametrize("small", [0, 3, 100_000])
def test_mix_prefixes_do_not_depend_on_how_ranges_are_cut(spark, monkeypatch, small):
    """One leaf holds most rows; some have no tokens, some are equal."""
    from tallymark.llm import mixing

    rows = [(i % 450, "w " * (i % 5), "en" if i % 10 else "de", "src0" if i % 3 else "src1", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.Mix(levels=("lang", "source"), weights={"lang": {"en": 3.0}}, share=0.5, epochs=2)
    monkeypatch.setattr(mixing, "SMALL", 10**9)
    count = lambda: collections.Counter(tuple(r) for r in mixing.mixed(docs, mix).collect())
    whole = count()
    monkeypatch.setattr(mixing, "SMALL", small)
    assert count() == whole and sum(whole.values()) > 100


# --- very many lines, very many heads: work grows with the text, not with its square. Limits leave room for a busy machine; quadratic work took 420 s and more.


def within(seconds, work):
    import time

    began = time.time()
    out = work()
    assert time.time() - began < seconds
    return out


MANY = 200_000


@pytest.fixture(scope="module")
def many_lines(spark):
    """A text of MANY lines, one in ten of them repeated over 25 other documents."""
    ship(spark)
    shared = [f"shared line {i} that is long enough to be a key of its own" for i in range(20)]
    long = "\n".join(shared[i // 10 % 20] if i % 10 == 0 else f"own line {i} with some words" for i in range(MANY))
    rows = [(0, long), *((k, "\n".join([f"page {k} {w} says this and that" for w in range(100)] + shared)) for k in range(1, 26))]
    return spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_quality_of_very_many_lines(many_lines):
    from tallymark.llm.quality import clean_documents, quality_verdicts

    got = {r.doc_id: r for r in within(150, lambda: quality_verdicts(many_lines).collect())}
    assert got[0].n_removed_lines == MANY // 10 and got[0].n_dup_lines == MANY // 10 - 20 and got[1].n_removed_lines == 20
    kept = {r.doc_id: r.text for r in within(150, lambda: clean_documents(many_lines).collect())}
    assert kept[0] == "\n".join(f"own line {i} with some words" for i in range(MANY) if i % 10) and len(kept[7].split("\n")) == 100


def test_line_dedup_of_very_many_lines(many_lines):
    from tallymark.llm.line_dedup import line_dedup, without_repeated_lines

    got = {r.doc_id: r for r in within(150, lambda: line_dedup(many_lines).collect())}
    assert (got[0].n_lines, got[0].n_dropped, got[25].n_dropped) == (MANY, MANY // 10, 0)
    kept = {r.doc_id: r.text for r in within(150, lambda: without_repeated_lines(many_lines).collect())}
    assert kept[0] == "\n".join(f"own line {i} with some words" for i in range(MANY) if i % 10)


def test_secret_scan_of_very_many_heads():
    import base64

    from tallymark.llm.secret_scan import scan

    def heads(body):
        return [line(i, body) for i in range(15_625)]

    def line(i, body):  # one megabyte of lines of 64 signs, each a head; all bodies end at the end of the last line
        size = (15_625 - i) * 48 - 5
        return base64.b64encode(b"\x30\x83" + size.to_bytes(3, "big") + b"\x02\x01\x00\x04\x7f" + body * 38).decode()

    assert within(20, lambda: scan("\n".join(heads(b"\xff"))))[4].count("der") == 0
    assert within(20, lambda: scan("\n".join(heads(b"\0"))))[4].count("der") <= 1  # zeros are items as well, and some end well
    lines = heads(b"\xff")
    key = b"\x30\x2e\x02\x01\x00\x04\x29" + bytes(41)  # 48 bytes: one line of signs
    text = "\n".join([*lines[:9], base64.b64encode(key).decode(), *lines[9:18]])
    assert scan(text)[4] == f"der:{9 * 65}:{9 * 65 + 64}"
