"""The pipeline's stages over the smallest table and over planted cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tallymark.llm import bpe
from tallymark.llm.common import ship


def test_stages(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = rows.columns, rows.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf).cache()
        assert rows.columns == columns and 0 < rows.count() <= before, name
        before = rows.count()
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert last.count() == before and last.where("not round_trip").count() == 0


BLANKS = " \t\n\x0b\x0c\r"


def quality_by_force(rows):
    """The quality stage over dictionaries; no near copies but exact ones are among the rows."""
    pages = collections.defaultdict(set)
    split = lambda t: [x for x in t.split("\n") if x.strip(BLANKS)]
    for r in rows:
        for line in split(r["text"] or ""):
            pages[r["source"], line.strip(BLANKS).lower()].add(r["text"])
    out = []
    for r in rows:
        words = (r["text"] or "").split()
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        gone = [x for x in split(r["text"] or "") if len(pages[r["source"], x.strip(BLANKS).lower()]) > 20]
        left = len(words) - sum(len(x.split()) for x in gone)
        if len(words) < 20 or 100 * len(again) > 30 * len(words) or (gone and (left < 20 or left < 0.3 * len(words))):
            continue
        out.append(r | {"text": "\n".join(x for x in r["text"].split("\n") if x not in gone)})
    return out


def lines_by_force(rows):
    holders = collections.defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS))
    for r in rows:
        for x in r["text"].split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(r["doc_id"])
    keep = lambda r, x: len(holders[key(x)]) < 5 or max(holders[key(x)]) == r["doc_id"]
    return [r | {"text": "\n".join(x for x in r["text"].split("\n") if keep(r, x))} for r in rows]


def copies_by_force(rows):
    of = [{tuple(r["text"].lower().split()[i : i + 5]) for i in range(max(1, len(r["text"].split()) - 4))} for r in rows]
    label = list(range(len(rows)))
    grew = True
    while grew:
        grew = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]):
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
                    grew = True
    return [min((r for r, x in zip(rows, label) if x == group), key=lambda r: r["doc_id"]) for group in set(label)]


def mix_by_force(rows):
    """Languages by weight, sources evenly, each filled up to what it has, then the seeded prefix of each leaf."""

    def share(budget, caps, weights):
        out, open_ = {}, set(caps)
        while open_:
            total = sum(weights.get(k, 1.0) for k in open_)
            full = {k for k in open_ if caps[k] * total <= budget * weights.get(k, 1.0)}
            if not full:
                return out | {k: budget * weights.get(k, 1.0) / total for k in open_}
            out |= {k: caps[k] for k in full}
            budget -= sum(caps[k] for k in full)
            open_ -= full
        return out

    mix, n = corpus_pipeline.MIX, lambda r: len(r["text"].split())
    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    tree = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        tree[r["lang"]][r["source"]].append(r)
    size = lambda x: sum(map(n, x)) if isinstance(x, list) else sum(map(size, x.values()))
    langs = share(float(math.floor(size(tree) * mix.share)), {k: size(v) for k, v in tree.items()}, mix.weights["lang"])
    out = []
    for lang, sources in tree.items():
        for source, budget in share(langs[lang], {k: size(v) for k, v in sources.items()}, {}).items():
            left = math.floor(budget + 1e-6)
            for r in sorted(sources[source], key=lambda r: md5(f"{mix.seed}:0:{r['doc_id']}:{md5(r['text'])}")):
                left -= n(r)
                if left < 0:
                    break
                out.append(r)
    return out


def test_pipeline_by_force(spark, tmp_path):
    """Each stage, and all together, against plain Python over a table with a case for every stage."""
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    rng = random.Random(21)
    line = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    notice, passage = line(12), f"{line(10)} and so on to the end of it"
    texts = [f"{line(40)}\n{line(30)}" + (f"\n{notice}" if k % 3 == 0 else "") + (f"\n  {passage.upper() if k % 2 else passage}" if k % 7 == 0 else "") for k in range(110)]
    texts += [f"{notice}\n{line(9)}", "too short", "again and again " * 30, "", None]
    for k in range(10):  # near copies of the first
        w = texts[1].split(" ")
        w[rng.randrange(10, 60)] = f"x{k}"
        texts.append(" ".join(w))
    texts += [texts[2], texts[4]]
    rows = [{"doc_id": i, "text": t, "lang": ("en", "de", "fr", "es")[i % 4], "source": f"s{i % 2}", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path))
    plain = lambda found: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in found)
    for (name, stage), force in zip(corpus_pipeline.STAGES, (quality_by_force, lines_by_force, copies_by_force, mix_by_force)):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        expected = force(rows)
        got = stage(spark, df, str(tmp_path)).collect()
        assert plain(got) == plain(expected) and len(expected) < len(rows) + (name == "line_dedup"), name
        assert all(r["n_chars"] == len(r["text"]) for r in got), name
        rows = [r | {"n_chars": len(r["text"])} for r in expected]
    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, r.n_tokens, bytes(r.token_ids), r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ids = {r["doc_id"]: other.encode_ordinary(r["text"]) for r in rows}
    assert got == sorted((i, len(x), b"".join(v.to_bytes(4, "little") for v in x), True) for i, x in ids.items())


def test_near_copies_go_and_clean_documents_stay(spark):
    ship(spark)
    rng = random.Random(7)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(300)]
    clean = [text() for _ in range(60)]
    copies = []
    for _ in range(20):
        w = list(clean[0])
        for at in rng.sample(range(300), 4):
            w[at] = f"x{rng.randrange(9999)}"
        copies.append(w)
    docs = [(i, " ".join(w)) for i, w in enumerate(clean)] + [(1000 + i, " ".join(w)) for i, w in enumerate(copies)] + [(2000, " ".join(clean[1]))]
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()}
    assert kept == set(range(60))
    assert corpus_pipeline.quality(spark, rows, "").count() == len(docs)


def alike(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_at_the_limit_go_and_those_below_stay(spark):
    """Pairs just at or above 0.8 and just below, and a chain, against the exact similarity."""
    ship(spark)
    rng = random.Random(11)
    docs, expected = [], set()
    for k in range(0, 800, 2):
        n = rng.randrange(40, 400)
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        edited = list(w)
        steps = max(1, round((n - 4) / 45)) + rng.randrange(2)
        for at in rng.sample(range(n), steps):
            edited[at] = f"x{rng.randrange(10**6)}"
        docs += [(k, " ".join(w)), (k + 1, " ".join(edited))]
        expected |= {k} if alike(docs[-1][1], docs[-2][1]) >= 0.8 else {k, k + 1}
    near = sum(0.8 <= alike(docs[i][1], docs[i + 1][1]) < 0.86 for i in range(0, 800, 2))
    assert near > 80 and len(expected) > 480  # both sides of the limit are well covered
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == expected


def test_large_buckets_are_worked_off_whole(spark):
    """Copies that are alike to the first text, but mostly not to each other, in buckets above the small size."""
    from tallymark.llm import jaccard

    ship(spark)
    rng = random.Random(5)
    texts = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(200)]
        texts.append(base)
        for _ in range(40):
            w = list(base)
            for at in rng.sample(range(200), 4):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(w)
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(docs)
    label = {i: i for i, _ in docs}
    grew = True
    links = [(a, b) for a, s in docs for b, t in docs if a < b and a // 41 == b // 41 and alike(s, t) >= 0.8]
    while grew:
        grew = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != label[b]:
                label[a] = label[b] = low
                grew = True
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for small in (2, 16):
        got = {r.doc_id: r.component_id for r in jaccard.near_copies(rows, jaccard.Shingles(small=small)).collect()}
        assert got == label


def test_texts_that_are_nearly_alike_make_no_pairs(spark):
    """A large group of variants of one text below the limit: its buckets are full, but the bounds leave none open."""
    from tallymark.llm import jaccard
    from tallymark.llm.common import text_id
    from pyspark.sql import functions as F

    ship(spark)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(2, 118, 6), 4):
            w[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = rows.select("doc_id", text_id(F.col("text")).alias("tm_text"), "text")
    nodes = jaccard.sets(docs, jaccard.FIVE_WORDS, values=False).select("tm_node", "tm_list").cache()
    own = jaccard.sets(docs, jaccard.FIVE_WORDS, values=True).select("tm_node", "tm_list").cache()
    full = jaccard.buckets(nodes, jaccard.FIVE_WORDS).withColumns({"root": F.col("tm_node"), "tm_rows": F.col("tm_n")})
    assert full.count() > 2000 and jaccard.bounded(full, own, jaccard.FIVE_WORDS).count() == 0
    assert {r.component_id for r in jaccard.near_copies(rows).collect()} == set(range(200))


def test_blocks_give_exact_intersections_and_connect_what_is_alike():
    import pyarrow as pa

    from tallymark.llm import jaccard

    rng = random.Random(11)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(30)] + [[5], [], list(range(-9000, 9000))]
    lists = pa.array(sets, pa.list_(pa.int64()))
    left, right = np.arange(0, 20), np.arange(10, 33)
    assert jaccard.intersections(lists, left, right).tolist() == [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]
    assert jaccard.intersections(pa.array([[1], [2]], pa.list_(pa.int64())), left[:1], left[1:2]).tolist() == [[0]]
    sets = [[*range(100)], [*range(1, 101)], [*range(12, 112)], [*range(500, 600)], [*range(501, 600)], [*range(24, 124)]]
    block = pa.table({"root": pa.array([7, 3, 9, 4, 4, 5], pa.int64()), "tm_block": pa.array([0, 1, 0, 1, 0, 0], pa.int64()), "tm_list": pa.array(sets, pa.list_(pa.int64()))})
    assert sorted(zip(*jaccard.block_links(block, 80).to_pydict().values())) == [(7, 3)] + [(9, 3)]  # across the blocks; equal roots are connected
    whole = block.set_column(1, "tm_block", pa.array([2] * 6, pa.int64()))
    found = list(zip(*jaccard.block_links(whole, 75).to_pydict().values()))
    assert len(found) == 3 and {x for f in found for x in f} == {7, 3, 9, 5}


def test_half_alike_groups_over_many_blocks(spark):
    """Variants of one text, some of them alike to each other, in groups of many small blocks; by force."""
    from tallymark.llm import jaccard

    ship(spark)
    rng = random.Random(12)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            w[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            texts.append(" ".join([*w[:-3], "y", *w[-2:]]))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(rows, jaccard.Shingles(small=5)).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < len(label)
