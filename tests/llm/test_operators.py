"""Each operator against brute force on the smallest table and on rows with odd values."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm import bpe, fingerprints, jaccard, line_dedup, mixing, pii, quality, secret_scan, sharding, simhash, token_files
from tallymark.llm.common import ship
from tallymark.llm.oracle import ORACLE_SQL
from tallymark.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, tm_n long, kept string"
LINE = "a line that is long enough to be a key of forty code points"
ODD = [
    (1, None, "en", "src0", None, 1, "x"),
    (2, "", "en", "src0", 0, 1, "x"),
    (3, " \t\n ", None, None, 4, 1, "x"),
    (4, "one", "en", "src1", 3, 1, "x"),
    (4, "one", "en", "src1", 3, 1, "x"),
    (None, f"{LINE}\nmore", "de", "src1", 60, 1, "x"),
    *((k, f"own {k}\n  {LINE.upper()}\n{LINE}\nend é {k}", "fr", "src2", 99, 1, "x") for k in range(5, 12)),
    (20, "word " * 30_000, "en", "src0", 150_000, 1, "x"),
    (21, "\U0001f389 ünï", "en", "src0", 5, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(ODD, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(plain(dict(zip(columns, x))[c]) for c in names) for x in found.fetchall()), key=repr)


# --- 1


def test_quality_leaves_copies_and_takes_boilerplate(spark):
    rules = quality.QualityRules(max_docs=5)
    notice = "please accept the terms of use of this site before you go on reading it"
    line = lambda *names: " ".join(f"w{'x'.join(map(str, names))}x{i}" for i in range(10))
    own = [(k, "\n".join(line(k, j) for j in range(6)) + f"\n{notice}", "h") for k in range(20)]
    thin = [(100, f"{notice}\nshort rest of the page", "h")]
    near = [(200 + k, "\n".join(line("all", j) for j in range(12)) + f"\nand {k} was added to the copy at its very end", "h") for k in range(30)]
    same = [(300 + k, own[0][1].replace(notice, "x y"), "h") for k in range(30)]
    rows = spark.createDataFrame(own + thin + near + same, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_verdicts(rows, rules=rules).collect()}
    assert [i for i, r in got.items() if not r.kept] == [100]
    assert all(got[k].n_removed_lines == 1 for k in range(20)) and all(got[k].n_removed_lines == 0 for k in range(200, 330) if k in got)
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(rows, rules=rules).collect()}
    assert notice not in cleaned[3] and cleaned[205] == near[5][1] and 100 not in cleaned


@pytest.mark.parametrize("shared", [1, 6, 8, 20])
def test_quality_rejects_pages_that_are_mostly_template(spark, shared):
    line = lambda *names: " ".join(f"w{'x'.join(map(str, names))}x{i}" for i in range(6))
    template = [line("t", j) for j in range(shared)]
    page = lambda k, own: "\n".join(template + [line(k, j) for j in range(own)])
    rows = [(k, page(k, 3), "h") for k in range(50)] + [(100 + k, page(100 + k, 30), "h") for k in range(5)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.n_removed_lines == shared and r.left_words == (180 if i >= 100 else 18) for i, r in got.items())
    assert {i for i, r in got.items() if r.kept} == set(range(100, 105))


def test_quality_odd_rows(odd, none):
    got = {r.doc_id: r for r in quality.quality_verdicts(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and got[20].n_repeat_words == 30_000
    assert quality.clean_documents(odd).columns == odd.columns
    assert quality.quality_verdicts(none).count() == quality.clean_documents(none).count() == 0


# --- 2


def test_sketches_recover_digests(spark):
    a, b = list(range(1, 40)), list(range(30, 80))
    spread = lambda x: [int(hashlib.md5(str(v).encode()).hexdigest()[:15], 16) for v in x]
    pairs = spark.createDataFrame([(1, "k", 64, spread(a), spread(b))], "tm_seq long, tm_kind string, tm_size long, tm_a array<long>, tm_b array<long>")
    got = {(r.digest, r.side) for r in fingerprints.differing_digests(pairs).collect()}
    assert got == {(d, 1) for d in spread(range(1, 30))} | {(d, -1) for d in spread(range(40, 80))}
    small = fingerprints.peeled(pairs.withColumn("tm_size", F.lit(8).cast("long"))).first()
    assert small.tm_left > 0  # too small to resolve, so likeness() goes on to a larger one


def test_comparison_grows_until_the_difference_fits(spark, monkeypatch):
    """Differences from none to far above the first size, and beyond the largest one."""
    spread = lambda x: [int(hashlib.md5(str(v).encode()).hexdigest()[:15], 16) for v in x]
    rows = [(k, kind, list(range(300)), list(range(n, 300 + n))) for k, n in enumerate((0, 1, 5, 30, 300)) for kind in "en"]
    pairs = spark.createDataFrame([(k, kind, spread(a), spread(b)) for k, kind, a, b in rows], "tm_seq long, tm_kind string, tm_a array<long>, tm_b array<long>")
    expected = {(k, kind): len(set(a) & set(b)) / len(set(a) | set(b)) for k, kind, a, b in rows}
    for largest in (fingerprints.LARGEST, 32):
        monkeypatch.setattr(fingerprints, "LARGEST", largest)
        assert {(r.tm_seq, r.tm_kind): r.tm_near for r in fingerprints.likeness(pairs.repartition(4, "tm_seq")).collect()} == expected


def test_fingerprints_odd_rows(odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
    assert by[1] == by[2] and len(by[4]) == 1
    assert fingerprints.fingerprints(none).count() == 0


# --- 3


def kept_by_force(rows):
    holders = collections.defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_odd_rows(odd, none):
    assert sorted(map(tuple, line_dedup.line_dedup(odd).collect()), key=repr) == kept_by_force([r[:2] for r in ODD])
    out = line_dedup.without_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_hot_line_over_many_ranges(spark):
    rows = [(k, f"{LINE}\nown text of document {k} which is also long enough to be one") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.line_dedup(df).collect()) == 2999


def test_run_pass_in_any_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted({(rng.randrange(12), -rng.randrange(30)) for _ in range(200)})
    cols = {"tm_hash": [r[0] for r in rows], "tm_doc": [-r[1] for r in rows], "tm_id": [0] * len(rows), "tm_at": list(range(len(rows))), "tm_lines": [1] * len(rows)}
    table = pa.table({k: pa.array(v, line_dedup.RUN_FIELDS.field(k).type) for k, v in cols.items()})
    results = set()
    for size in (1, 3, 7, 1000):
        got = pa.Table.from_batches(line_dedup.run_pass(table.to_batches(max_chunksize=size), 5), line_dedup.RUN_FIELDS).to_pylist()
        results.add(tuple(sorted((r["tm_at"], r["tm_edge"], r["tm_first"] if r["tm_edge"] else 0) for r in got)))
    assert len(results) == 1


# --- 4 and 5


def test_secret_structures():
    tlv = lambda t, c: bytes([t]) + (bytes([len(c)]) if len(c) < 128 else b"\x81" + bytes([len(c)])) + c
    key = tlv(0x30, tlv(2, b"\0") + tlv(2, bytes(range(1, 120))) + tlv(2, b"\x01\0\x01"))
    token = base64.urlsafe_b64encode(b'{"alg":"none"}').rstrip(b"=").decode() + ".e30."
    kinds = lambda t: [s[2] for s in secret_scan.confirmed(f"see {t} end")]
    assert kinds(token) == ["jwt"] and kinds(base64.b64encode(key).decode()) == kinds(key.hex()) == ["der"]
    assert kinds("-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----") == ["pem"]
    assert kinds(base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))).decode()) == ["ssh"]
    wrapped = base64.urlsafe_b64encode(key).decode()
    wrapped = "\n".join(wrapped[i : i + 40] for i in range(0, len(wrapped), 40))
    spki = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(3, b"\0" + bytes(range(32))))
    public = tlv(0x30, tlv(2, bytes(range(1, 120))) + tlv(2, b"\x01\0\x01"))
    signature = tlv(0x30, tlv(2, bytes(range(1, 33))) + tlv(2, bytes(range(2, 34))))
    deep = b"x"
    for _ in range(2000):  # a nesting that no recursion would survive
        deep = b"\x30\x83" + len(deep).to_bytes(3, "big") + deep
    assert kinds(wrapped) == kinds(base64.b64encode(spki).decode()) == kinds(base64.b64encode(public).decode()) == ["der"]
    assert kinds(base64.b64encode(signature).decode()) == kinds(signature.hex()) == kinds(base64.b64encode(spki.replace(b"+ep", b"+ez")).decode()) == kinds(base64.b64encode(deep).decode()) == []
    assert kinds(base64.urlsafe_b64encode(b'{ "alg": "HS256"}').rstrip(b"=").decode() + ".e30.x") == kinds(base64.urlsafe_b64encode(b'{\n"alg":"x"}').rstrip(b"=").decode() + ".e30.") == ["jwt"]
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.encodebytes(bytes(range(64))).decode() + "-----END RSA PRIVATE KEY-----"
    assert kinds(sealed) == ["pem"] and kinds(sealed.replace("DEK-Info", "Other")) == []
    assert kinds(base64.b64encode(key[:-1]).decode()) == kinds("eyJhbGci.e30.x") == kinds("A" * 80) == kinds("30" * 30) == []


PARTS = ["token", "Secret", " ", "=", ":", '"', "a", "b1", "password", "ſecret", "api_key", "K", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef", "@", "x.y", ".", "1", "22", "300", "-", "+1", "(555)", " 555-1234", "4111 1111 1111 1111", "%", "\n"]


def test_base_spans_by_force():
    rng = random.Random(5)
    assign = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        a = [(*m.span(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6] + [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.listed(list(secret_scan.base_spans(t))) == secret_scan.listed(a)
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        b = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] + [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        b += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))] + [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
        assert pii.listed(pii.base_spans(t)) == pii.listed(b)


def test_secret_query_by_force(docs, odd):
    """Counts, digest and spans of the whole table: the base by plain patterns, the spans a superset of it."""
    assign = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    rows = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in secret_scan.secrets(rows).collect():
        t = text[r.doc_id]
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        shown = [f"{k}:{s}:{e}" for s, _, e, k in sorted(base)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",")) | {""}


def bootstrapped(texts, config):
    """Trusted patterns and the reported spans by brute force over dictionaries."""
    seen = [(i, *o) for i, t in texts.items() for o in pii.occurrences(t, pii.base_spans(t), config.context_words)]
    edges = collections.defaultdict(bool)
    for _, pattern, instance, _, _, seed in seen:
        edges[pattern, instance] |= seed
    patterns = {p: [x for q, x in edges if q == p] for p, _ in edges}
    precision = {p: sum(edges[p, x] for x in xs) / (len(xs) + config.prior) for p, xs in patterns.items()}
    while True:
        right = {}
        for p, x in edges:
            others = [1 - min(precision[q], 0.999999) for q in patterns if q != p and (q, x) in edges]
            right[p, x] = 1.0 if edges[p, x] else 1 - float(np.prod(others)) if others else 0.0
        new = {p: sum(right[p, x] for x in xs) / (len(xs) + config.prior) for p, xs in patterns.items()}
        grown, precision = max(new[p] - precision[p] for p in new), new
        if grown <= config.tolerance:
            break
    trusted = {p for p, xs in patterns.items() if len(xs) >= config.min_support and precision[p] >= config.min_precision}
    return trusted, {(i, s, e) for i, p, _, s, e, seed in seen if p in trusted and not seed}


def test_bootstrapping_by_force(spark):
    """Patterns without a seed are reached over identifiers that others have discovered."""
    ship(spark)
    rng = random.Random(9)
    ids = [f"k-{rng.randrange(10**6)}-{i}" for i in range(12)]
    lines = [f"user id: {n}@mail{i}.org" for i, n in enumerate("abcdefgh")] + [f"user id: {x}" for x in ids[:6]]
    lines += [f"ticket of owner {x}" for x in ids[:6]] + [f"ticket of owner {x}" for x in ids[6:8]] + [f"room near gate {x}" for x in ids[6:]] + [f"in block {i}x{i}x{i}" for i in range(9)]
    rng.shuffle(lines)
    texts = {i: " \n ".join(lines[i::15]) for i in range(15)}
    config = pii.Bootstrap()
    trusted, spans = bootstrapped(texts, config)
    assert {"id :", "of owner"} <= trusted and "in block" not in trusted
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, *map(int, s.split(":")[1:])) for r in pii.personal_data(rows, config).collect() for s in r.spans.split(",") if s.startswith("context")}
    assert got == spans and got


def test_long_texts_of_personal_data_take_linear_time():
    import time

    assert pii.base_spans(f"at 1.2.3.{'0' * 5000}4 x") == [(3, 5010, "ip")] and pii.base_spans(f"at 1.2.3.{'9' * 5000}") == []
    text = " ".join(f"user{i}@host{i}.org and item no {i}-{i}" for i in range(20_000))
    began = time.time()
    found = list(pii.occurrences(text, pii.base_spans(text), 2))
    assert sum(o[4] for o in found) == 20_000 - 1 and time.time() - began < 20
    token = "a1" * 500
    assert [(o[1], o[4]) for o in pii.occurrences(f"the name is{' ' * 90}{token}...", [], 2)] == [(token, False)]


def test_contexts_discover_identifiers(spark):
    ship(spark)
    texts = [f"Contact user id: {v}" for v in ("bob@x.com", "amy@y.org", "sue@z.net", "q-7781-zz", "kk_9912_pp")] + ["in the year 19871987x it was", None, ""]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[3] == "context:17:26" and got[4] == "context:17:27" and got[0] == "email:17:26" and got[5] == got[6] == ""


def test_spans_odd_rows(odd, none):
    assert secret_scan.secrets(odd).count() == pii.personal_data(odd).count() == len(ODD)
    assert secret_scan.secrets(none).count() == pii.personal_data(none).count() == 0


# --- 6


def test_shards(docs, odd, none, spark, tmp_path):
    rows = sharding.sharded(docs, 40).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    totals = [sum(r.size for r in v) for v in by.values()]
    assert max(totals) - min(totals) <= max(r.size for r in rows)
    placed = sharding.sharded(odd, 3).collect()
    assert sorted((r.shard, r.slot) for r in placed) == [(s, k) for s in range(3) for k in range(sum(r.shard == s for r in placed))] and len(placed) == len(ODD)
    assert sharding.sharded(none, 3).count() == 0
    hot = spark.createDataFrame([(None if k % 3 else 7, f"text {k}") for k in range(600)], "doc_id long, text string").repartition(5)
    path = str(tmp_path / "maps")
    sharding.SlotMap.even(4).save(spark, path)
    for version in (2, 3):  # each run edits the stored map and adds a version
        placed = sharding.sharded(hot, 4, map_path=path).collect()
        assert {r.map_version for r in placed} == {version} and sharding.SlotMap.load(spark, path).version == version
        assert sorted((r.shard, r.slot) for r in placed) == [(s, k) for s in range(4) for k in range(sum(r.shard == s for r in placed))]
    assert len({r.virtual_slot for r in placed if r.doc_id is None}) > 100
    sizes = [random.Random(1).randrange(100) for _ in range(sharding.SLOTS)]
    first = sharding.SlotMap.even(8).rebalanced(sizes)
    first.save(spark, str(tmp_path / "map"))
    again = sharding.SlotMap.load(spark, str(tmp_path / "map")).rebalanced(sizes)
    assert again.version == 3 and again.shard_of == first.shard_of  # balanced already: nothing moves
    grown = first.rebalanced(sizes, 9)
    assert sum(a != b for a, b in zip(first.shard_of, grown.shard_of)) < sharding.SLOTS / 4


# --- 7 and 9


def test_bpe_is_exact():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    own = bpe.Codec(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "ß", "　", "\x85", "\x1c", "1", "23", "the", "ing", "!!", "日本", "aaaa", "\xa0", "'ll", "🎉", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t) and own.decode(ids) == t.encode()
    long = "ab" * 5000
    assert own.encode_piece(long) == other.encode_ordinary(long)


def test_bpe_workers_hold_little():
    public = pytest.importorskip("public_tokenizers")

    path = public.path("byte_bpe_50k.tiktoken")
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(1100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1101), pa.int64()), pa.array([*texts, None])], names=["doc_id", "text"])
    parts = list(bpe.encoded_slices(iter([batch]), path, public.PATTERN, ["doc_id", "text"]))
    assert max(x.num_rows for x in parts) <= 500
    found = pa.Table.from_batches(parts).to_pylist()
    assert [(r["doc_id"], r["text"], r["decoded"].decode()) for r in found] == [(i, t, t or "") for i, t in enumerate([*texts, None])]
    own = bpe.codec(path, public.PATTERN)
    assert sum(len(t) for t in vars(own).values() if isinstance(t, dict) and isinstance(next(iter(t), None), str)) <= 100_000
    fresh = bpe.Codec(bpe.read_ranks(path), public.PATTERN)  # chunks of a displaced generation get the same ids
    assert [r["ids"] for r in found[:3]] == [own.encode(t) for t in texts[:3]] == [fresh.encode(t) for t in texts[:3]]


def test_bpe_takes_few_calls_for_a_new_word():
    """Words that no table holds are encoded together. Word by word the calls were 40 and more each."""
    public = pytest.importorskip("public_tokenizers")
    import sys

    path, rng = public.path("byte_bpe_50k.tiktoken"), random.Random(3)
    words = ["".join(rng.choice(["th", "er", "on", "qu", "el", "ent", "ê", "ing", "at", "z"]) for _ in range(6)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([" ".join(words[i::40]) for i in range(40)])], names=["doc_id", "text"])
    run = lambda: list(bpe.encoded_slices(iter([batch]), path, public.PATTERN, ["doc_id", "text"]))
    run()  # fills the table of token pairs
    own, calls = bpe.codec(path, public.PATTERN), [0]
    for table in vars(own).values():
        if isinstance(table, dict) and isinstance(next(iter(table), None), str):
            table.clear()

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    assert calls[0] < 15 * len(words)


@pytest.mark.parametrize("points, together", [(500_000, 20_000), (30, 2), (1, 1)])
def test_bpe_groups_do_not_change_ids(monkeypatch, points, together):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path, rng = public.path("byte_bpe_50k.tiktoken"), random.Random(4)
    monkeypatch.setattr(bpe, "POINTS", points, raising=False)
    monkeypatch.setattr(bpe, "TOGETHER", together, raising=False)
    monkeypatch.setattr(bpe, "IDS", 7, raising=False)
    parts = ["th", "e", "on", "qu", "é", "Ā", "日本", "🎉", "1", "23", " ", "  ", "\n", "!?", "\x00", "ÿ", "'s", "a" * 70, "ab" * 40]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)), "", "x", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = pa.Table.from_batches(bpe.encoded_slices(iter([batch]), path, public.PATTERN, ["doc_id"])).to_pylist()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [other.encode_ordinary(t) for t in texts]
    assert [r["decoded"].decode() for r in rows] == texts


def test_token_files(docs, odd, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    spelled = ["a <|endoftext|>b", "<|endoftext|>", "x\n <|endoftext|> y <|endof text|>", "one two\x1c three  <|endoftext|>\n"]
    assert [np.frombuffer(ids, "<u2").tolist() for ids in token_files.Encoder(path).encode(spelled)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in spelled]
    at = 0
    got = {r.doc_id: tuple(r)[1:] for r in token_files.token_files(docs, path, 2, length=128).collect()}
    for i, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(odd, path, 2).count() == len(ODD) and token_files.token_files(none, path, 2).count() == 0
    assert bpe.token_digests(odd, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).where("doc_id < 3").agg(F.sum("n_tokens")).first()[0] == 0


def test_sequences_are_read_at_random(spark, tmp_path):
    """Files of several partitions: any sequence by its number without reading others, masks, and where documents lie."""
    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    ship(spark)
    path = public.path("byte_bpe_50k.json")
    rows = [(k, f"text number {k}, " + "and more words " * (k % 50)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_token_files(df, path, 2, str(tmp_path / "files"), length=64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and sum(f[2] for f in files) == 400
    tokenizer, done = token_files.Encoder(path), 0
    for ids_file, docs_file, n, total in files:
        stream = [i for _, t in rows[done : done + n] for i in [*np.frombuffer(tokenizer.encode([t])[0], "<u2").tolist(), 2]]
        assert pa.ipc.open_file(pa.memory_map(docs_file)).read_all().column("doc_id").to_pylist() == list(range(done, done + n))
        reader = pa.ipc.open_file(pa.memory_map(ids_file))
        before = pa.total_allocated_bytes()
        for i in random.Random(1).sample(range(-(-total // 64)), 5):
            batch = reader.get_batch(i // token_files.BATCH)
            ids, mask = (batch.column(c)[i % token_files.BATCH].values for c in ("ids", "mask"))
            own = stream[64 * i : 64 * i + 64]
            assert len(ids) == len(mask) == 64 and ids.to_pylist()[: len(own)] == own and mask.to_pylist() == [True] * len(own) + [False] * (64 - len(own))
        assert pa.total_allocated_bytes() - before < 1 << 16  # the ids are those of the mapped file
        done += n


def test_encoder_leaves_joining_tokenizers_alone():
    """A pre-tokenizer that joins across spaces is seen by the probe."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    joining = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    own = token_files.Encoder(public.path("byte_bpe_50k.json"))
    assert own.cuts
    joining.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\S+ \S+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(joining.to_str())
        f.flush()
        other = token_files.Encoder(f.name)
    texts = ["one two three four.", "a b"]
    assert not other.cuts and [np.frombuffer(x, other.kind).tolist() for x in other.encode(texts)] == [joining.encode(t).ids for t in texts]


def test_encoder_by_force():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own, library = token_files.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "é", "ß", "1", "23", "the", "ing", "!!", ".", ",", "?", "日本", "\xa0", "\x85", "🎉", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for at in range(0, len(texts), 60):
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts[at : at + 60])] == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 60]]


# --- 8


def shares(node, budget, weights, epochs):
    """Budgets of the leaves below node by repeated sharing among siblings that are not full."""
    if isinstance(node, int):
        return {(): budget}
    cap = lambda n: n * epochs if isinstance(n, int) else sum(map(cap, n.values()))
    left, out, open_ = budget, {}, dict(node)
    while open_:
        total = sum(weights.get(k, 1.0) for k in open_)
        full = [k for k in open_ if cap(node[k]) <= left * weights.get(k, 1.0) / total]
        if not full:
            out |= {k: left * weights.get(k, 1.0) / total for k in open_}
            break
        out |= {k: cap(node[k]) for k in full}
        left -= sum(cap(node[k]) for k in full)
        open_ = {k: v for k, v in open_.items() if k not in full}
    return {(k, *rest): b for k, s in out.items() for rest, b in shares(node[k], s, weights, epochs).items()}


def test_mix_budgets_and_prefixes(docs, odd, none):
    mix = mixing.Mix(levels=("lang", "source"), weights={"lang": {"en": 1.0, "de": 3.0}, "source": {"src3": 4.0}}, share=0.7, epochs=2)
    tree: dict = {}
    sizes = {r.doc_id: (r.lang, r.source, len((r.text or "").split())) for r in docs.collect()}
    for lang, source, n in sizes.values():
        tree.setdefault(lang, {}).setdefault(source, 0)
        tree[lang][source] += n
    total = sum(n for *_, n in sizes.values())
    expected = shares(tree, int(total * 0.7), {"de": 3.0, "src3": 4.0}, 2)
    got = collections.defaultdict(collections.Counter)
    for r in mixing.mixed(docs, mix).collect():
        leaf = (r.lang, r.source)
        assert abs(r.budget - expected[leaf]) <= 1
        got[leaf][r.epoch] += r.n_tokens
    for leaf, by in got.items():
        assert sum(by.values()) <= expected[leaf] + 1
        assert all(by[e] == tree[leaf[0]][leaf[1]] for e in by if e < max(by))
        own = [n for lang, source, n in sizes.values() if (lang, source) == leaf]
        assert expected[leaf] - sum(by.values()) <= max(own) + 1
    once = mixing.Mix(levels=("lang", "source"), share=1.0, epochs=1)
    assert mixing.mixed(odd, once).where("n_tokens > 0").count() == sum(bool((r[1] or "").split()) for r in ODD)
    assert mixing.mixed(none, mix).count() == 0


def test_mix_takes_the_seeded_prefix_of_each_leaf(spark):
    """The chosen documents, not only their number, in a leaf whose budget ends within an epoch."""
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 30)) + f" {k}", f"s{k % 3}") for k in range(900)]
    mix = mixing.Mix(levels=("source",), weights={"source": {"s0": 5.0}}, share=0.5, epochs=2, seed=3)
    n = {k: len(t.split()) for k, t, _ in rows}
    leaf = collections.defaultdict(list)
    for k, t, s in rows:
        leaf[s].append((k, int(hashlib.md5(t.encode()).hexdigest()[:15], 16)))
    budget = shares({s: sum(n[k] for k, _ in v) for s, v in leaf.items()}, sum(n.values()) // 2, {"s0": 5.0}, 2)
    expected = set()
    for s, own in leaf.items():
        left = int(budget[s,] + 1e-6)
        for epoch in range(2):
            place = lambda x: int(hashlib.md5(f"3:{epoch}:{x[0]}:{x[1]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            for k, _ in sorted(own, key=place):
                left -= n[k]
                if left < 0:
                    break
                expected.add((k, epoch))
    assert {(r.doc_id, r.epoch) for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), mix).collect()} == expected


def test_mixed_documents_take_equal_rows_one_by_one(spark):
    rows = [(1, "one two three", "en", "own", 7)] * 10 + [(2, "four five", "en", "own", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, tm_text string, tm_id long")
    out = mixing.mixed_documents(df, mixing.Mix(levels=("lang",), share=0.5, epochs=1))
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and 11 <= sum(len(r[1].split()) for r in got) <= 16 and len(got) < 8


# --- 10


def print_of(t, k=3):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, most):
    label = {p: p for p in prints}
    grew = True
    while grew:
        grew = False
        for p in prints:
            for r in prints:
                if (p ^ r).bit_count() <= most and label[r] < label[p]:
                    label[p], grew = label[r], True
    return label


@pytest.mark.parametrize("limit", [2, 20_000])
def test_simhash(docs, odd, limit):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).collect()]
    df = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    prints = {i: print_of(t) for i, t in rows}
    label = groups(set(prints.values()), 2)
    least: dict = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    for r in simhash.near_duplicates(df, simhash.SimHash(bucket_limit=limit)).collect():
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == least[label[prints[r.doc_id]]]


def test_gray_index_prunes_groups_and_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) for _ in range(2)]
    codes = np.unique(np.concatenate([base, *flips, rng.integers(0, 2**63, 3000, dtype=np.uint64)]))
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    codes = codes[np.argsort(rank)]
    for most, front in ((2, 0), (2, 21), (0, 0)):
        index = simhash.GrayIndex(codes)
        mask = np.uint64(((1 << front) - 1) << (64 - front))
        got = {(int(a), int(b)) for q, n in index.links(np.arange(len(codes)), most, mask) for a, b in zip(q, n)}
        differ = codes[:, None] ^ codes[None]
        a, b = np.nonzero((np.bitwise_count(differ) <= most) & (differ & mask == 0))
        assert got == {(int(x), int(y)) for x, y in zip(a, b) if x < y}
        assert 0 < index.pruned < index.visited < len(codes) ** 2 / 8  # groups go as a whole
        assert front == 0 or index.visited < 80 * len(codes)


def test_index_is_built_at_every_size(spark):
    """Two fingerprints are enough for a tree, and a stretch ends between front slices."""
    import pyarrow as pa

    row = lambda c: {"tm_way": 1, "tm_exact": 21, "tm_front": c >> 43, "tm_node": c, "tm_code": c}
    run = lambda codes: [(x, y) for b in simhash.forest(iter(pa.Table.from_pylist(list(map(row, codes))).to_batches(max_chunksize=3)), 2) for x, y in zip(*b.to_pydict().values())]
    assert run([4, 5]) == [(5, 4)] and run([4, 4 + 7 * 8]) == [] and run([1 << 50, (1 << 50) + 1, 3, 2]) == [((1 << 50) + 1, 1 << 50), (2, 3)]


def test_representatives(spark, odd, none):
    kept = [r.doc_id for r in jaccard.representatives(odd).collect()]
    assert kept.count(4) == 1 and 1 in kept and 2 not in kept and 3 not in kept
    assert jaccard.representatives(odd).columns == odd.columns and jaccard.representatives(none).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "own", 5), (2, "a b c", "own", 5)], "doc_id long, text string, tm_text string, tm_id long")
    assert [tuple(r) for r in jaccard.representatives(clash).collect()] == [(1, "a b c", "own", 5)]
