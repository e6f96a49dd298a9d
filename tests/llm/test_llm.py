"""The training-data operators against brute force, libraries and round trips, with nulls, empties and ties."""

import hashlib
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import chat, contamination, jaccard, langid, licenses, lm, pieces, quality, rules, token_counts
from pagequarry.llm.components import connected_components
from pagequarry.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "  \n\t ", "one", "A b c d", "a b c d e", " x ▁ 🙂 é", "word " * 3000, "x" * 5000, "[INST] <s> \\ </s>", "!!! 12 | | |"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(None, "null id here now ok yes", None, 1), (3, "one", "en", 2), (3, "one", "en", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").translate(LOW).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_training_step():
    """A round tells every id of every block once; gradients are slopes of the loss; a step is one for all weights but the ids' own."""
    import numpy as np

    rng = np.random.default_rng(1)
    starts = np.arange(300) % 3 > 0
    cls = np.where(starts, np.arange(300) % (lm.CLASSES // 2), lm.CLASSES // 2 + np.arange(300) % (lm.CLASSES // 2))
    net = lm.Attention(cls, starts)
    net.w["i"] += rng.normal(0, 0.1, net.w["i"].shape).astype(np.float32)
    lengths = [lm.WINDOW + 1, 2 * lm.WINDOW + 8, 2, 1, *[30] * (lm.BATCH - 5)]  # one, three, one, no and one window each
    blocks = [rng.integers(0, 300, k).astype(np.uint16) for k in lengths]
    kept, made = {n: v.astype(float) for n, v in net.w.items()}, []
    plain = net.gradients
    net.gradients = lambda x, y, counted: made.append((x, y, counted, plain(x, y, counted))) or made[-1][-1]
    net.train(blocks, 1, 0.01)
    (x, y, counted, (g, ids)), = made
    told = Counter((int(a), int(b)) for a, b, c in zip(x.ravel(), y.ravel(), counted.ravel(), strict=True) if c)
    assert told == Counter((int(a), int(cls[b])) for z in blocks for a, b in zip(z[:-1], z[1:], strict=True))

    def loss(w):
        d = lm.WIDTH
        h = w["e"][cls[x]] + w["i"][x] + w["p"]
        q, k, v = (h @ w[m] for m in "qkv")
        s = (1 + q @ k.transpose(0, 2, 1) / np.sqrt(d) / 32) ** 32 * np.tril(np.ones((lm.WINDOW, lm.WINDOW)))
        h = h + s / s.sum(2, keepdims=True) @ v @ w["o"]
        h = h + np.maximum(h @ w["a"], 0) @ w["b"]
        p, gate, kind = h @ w["u"] + w["c"], (h @ w["g"] + w["s"])[..., 0], net.starts[y]
        p = np.where(net.starts == kind[..., None], p, -np.inf)
        lost = np.log(np.exp(p).sum(2)) - np.take_along_axis(p, y[..., None], 2)[..., 0] + np.log1p(np.exp(np.where(kind, -gate, gate)))
        return (lost * counted).sum() / counted.sum()

    for n in kept:
        slope = np.zeros_like(kept[n])
        if n == "i":
            slope[ids] = g[n]
        else:
            slope = g[n].astype(float)
        way = rng.normal(size=slope.shape)
        up, down = ({**kept, n: kept[n] + e * way} for e in (1e-5, -1e-5))
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx((slope * way).sum(), rel=2e-3, abs=2e-4), n
        assert (np.abs(net.w[n] - kept[n]).max() > 0) == (np.abs(slope).max() > 0)
    assert len({id(net.w[n].base) for n in kept if n != "i"}) == 1


def test_jaccard_against_all_pairs(spark, docs, odd, none):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = both.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = jaccard.link_groups(both).collect()
    assert len(got) == len(rows)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.component_id == find(r.doc_id) for r in got)
    assert jaccard.link_groups(none).count() == 0
    assert jaccard.link_groups(odd).where("doc_id is null and component_id is null").count() == 1


def test_jaccard_texts_that_travel(spark, monkeypatch):
    """Texts that share a shingle alone are left out by counts: only texts of near copies are packed, and equal blocks are one."""
    rows = [(k, f"all of these share this {' '.join(f'w{k}x{i}' for i in range(30))}") for k in range(20)]
    rows += [(100, " ".join(f"v{i}" for i in range(60))), (101, " ".join(f"v{i}" for i in range(59)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed, made = [], jaccard.packed_texts
    monkeypatch.setattr(jaccard, "packed_texts", lambda docs, named: packed.extend(r.id for r in named.collect()) or made(docs, named))
    found = {r.doc_id: r.component_id for r in jaccard.link_groups(docs).collect()}
    assert found == {k: min(k, 100) for k, _ in rows}
    assert sorted(packed) == [100, 101]
    _, _, shared, texts = jaccard._blocks(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), "text"))
    assert all(r.times > 5 for r in texts.where("rep >= 100").collect())
    assert shared.join(texts.where("rep >= 100"), "key").select("token").distinct().count() == 1


def test_jaccard_ids_with_several_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, b), (5, a + " x"), (6, b + " y"), (7, ""), (7, "")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.link_groups(df).collect()} == {(1, 1), (5, 1), (6, 1), (7, 7)}
    kept = jaccard.keep_one(df.union(df).withColumn("_id", F.lit(1)))
    assert sorted((r.doc_id, r.text[:1]) for r in kept.collect()) == [(1, "a"), (1, "b"), (7, ""), (7, ""), (7, ""), (7, "")] and kept.columns[-1] == "_id"


def test_all_pairs_and_their_number(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    rows = [(r.doc_id, shingles(r.text)) for r in both.collect()]
    expected = Counter()
    for k, (i, s) in enumerate(rows):
        links = sum(1 for m, (_, t) in enumerate(rows) if m != k and s and t and 100 * len(s & t) >= 80 * (len(s) + len(t) - len(s & t)))
        expected[i, links] += 1
    pairs, members = jaccard.linked_pairs(both)
    assert Counter((r.doc_id, r.n_links) for r in members.collect()) == expected
    assert pairs.count() == pairs.distinct().count() > 0


def test_forest_finds_every_pair_that_may_link():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, jaccard.GROUPS)).astype(np.uint8)
    x[150:] = x[:150]
    x[150:, 0] += 1
    n, block, root = x.sum(1).astype(np.int64), np.arange(300) % 3, np.arange(300)
    q, hit = jaccard.Forest(block, x, n, root).search(block, x, n, root)
    got = set(zip(q.tolist(), hit.tolist()))
    for a in range(300):
        for b in range(300):
            if a != b and block[a] == block[b] and 180 * np.minimum(x[a], x[b]).sum() >= 80 * (n[a] + n[b]):
                assert (a, b) in got


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {(r.id, r.root) for r in connected_components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    assert connected_components(edges.limit(0)).count() == 0


def test_language_accuracy_and_odd_rows(docs, odd, none):
    learned = langid.learn(docs, langid.training_rows(docs))
    rows = langid.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, learned).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and all(p != "und" for i, p in got if i in (3, 4, 5))
    assert langid.learn(none, langid.training_rows(none)) == {} and langid.identify(none, {}).count() == 0


def test_lm_base_is_exact(docs, odd, none):
    rows = docs.select("doc_id", "text").collect()
    train = [words(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    counts = Counter(w for d in train for w in d)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    import math

    text = {r.doc_id: r.text for r in rows}
    for r in lm.score_texts(docs, tokenizer("byte_bpe_50k.tiktoken")).collect():
        w = words(text[r.doc_id])
        c = [counts[x] for x in w] + [len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x > 0 for x in c), n)
        assert abs(r.base_score - sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)) < 1e-6 * (1 + abs(r.base_score))
        assert r.score < 0
    assert lm.score_texts(odd, tokenizer("byte_bpe_50k.tiktoken")).count() == odd.count()
    assert lm.score_texts(none, tokenizer("byte_bpe_50k.tiktoken")).count() == 0


def small_scorer():
    """A scorer of untrained weights and made-up counts."""
    import numpy as np

    rng = np.random.default_rng(1)
    sub = lm.subwords(tokenizer("byte_bpe_50k.tiktoken"))
    cls = np.where(sub.starts, rng.integers(1, 40, sub.size), rng.integers(40, lm.CLASSES, sub.size))
    cls[-1] = 0
    net = lm.Attention(cls, sub.starts)
    net.w = {n: w + rng.normal(0, 0.3, w.shape).astype(np.float32) for n, w in net.w.items()}
    counts = rng.integers(0, 3, (lm.CLASSES + 2, sub.size)).astype(float)
    return sub, lm.Scorer(counts, rng.integers(0, 3, (lm.CLASSES, sub.size)), cls, net, sub.starts)


def test_lm_continuations_sum_to_one():
    import numpy as np

    sub, scorer = small_scorer()
    ids = sub.ids(words("the quick brown foxes jumped")).astype(np.int64)
    x = np.full((1, lm.WINDOW), scorer.end)
    x[0, 1 : len(ids)] = ids[:-1]
    for at in (0, 3, len(ids) - 1):
        once = np.zeros(x.shape, bool)
        once[0, at] = True
        y = np.zeros(x.shape, np.int64)
        within = np.empty(lm.CLASSES)
        for c in range(lm.CLASSES):
            y[0, at] = c
            given, start, goes = scorer.net.log_prob(x, y, once)
            within[c] = np.exp(given[0])
        every = within[scorer.cls] * 10 ** scorer.inside[scorer.cls[x[0, at]]].astype(float)
        assert abs(np.exp(start[0]) + np.exp(goes[0]) - 1) < 1e-5
        assert abs(every[sub.starts].sum() - 1) < 1e-3 and abs(every[~sub.starts].sum() - 1) < 1e-3
    # known words take the counts of their first id, others the rest
    _, _, share, each = scorer.score(ids, np.array([len(ids)]))
    first = ids[sub.starts[ids]]
    assert np.allclose(scorer.first[first] * each + share, 1)


def test_lm_batches_do_not_matter():
    import numpy as np

    sub, scorer = small_scorer()
    texts = [sub.ids(words(t)) for t in ("", "a b", "some longer text of words " * 60, "x" * 900)]
    score = lambda texts: scorer.score(np.concatenate(texts), np.array(list(map(len, texts))))
    together = score(texts)
    alone = [np.concatenate(x) for x in zip(*[score([t]) for t in texts])]
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(together, alone))
    # a later word doesn't change what was before it
    longer = score([np.concatenate([texts[2][:-1], sub.ids(words("more"))])])
    assert np.allclose(longer[0][:200], score([texts[2]])[0][:200], rtol=1e-3, atol=1e-3)


def test_lm_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_texts(docs, tokenizer("byte_bpe_50k.tiktoken")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert r[0] > r[1] and r[2] > 0.5


def test_rules(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rules.apply_rules(docs, labels).collect():
        t = text[r.doc_id]
        w = [x.decode() for x in t.encode().split()]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.apply_rules(odd, labels).where("kept").count() == 0
    assert rules.apply_rules(none, labels.limit(0)).count() == 0


def test_contamination(spark, docs, odd, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    expected = {(d, i.item_id) for i in items.collect() for d, s in sets.items() if (q := shingles(i.text)) and 100 * len(q & s) >= 80 * len(q)}
    assert {(r.doc_id, r.item_id) for r in contamination.find_contained(docs, items).collect()} == expected and expected
    few = spark.createDataFrame([(1, "ONE"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.find_contained(odd, few).collect()} == {(3, 1)}
    assert contamination.find_contained(none, items).count() == 0


def test_pieces_round_trip(docs, odd, none):
    path = tokenizer("piece_bpe_32k.model")
    assert pieces.encode_digest(docs.unionByName(odd, allowMissingColumns=True), path).where("not roundtrip_ok").count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(odd.where("doc_id is not null"), path), path)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t or "") for i, t in enumerate(ODD)}
    assert pieces.encode_digest(none, path).count() == 0


def best_scores(m, text):
    """The sum of the best segmentation's scores, by trying every piece at every place."""
    best = [0]
    for end in range(1, len(text) + 1):
        ways = [best[s] + m.score[text[s:end]] for s in range(max(0, end - m.longest), end) if text[s:end] in m.score]
        best.append(max([*ways, best[end - 1] + m.unknown] if text[end - 1] not in m.score else ways))
    return best[-1]


def test_pieces_are_the_best(docs):
    m = pieces.piece_model(tokenizer("piece_bpe_32k.model"))
    names = {i: p for p, i in m.id.items()}
    texts = [r.text[:3000] for r in docs.limit(40).collect()] + ["  a", " " * 15, " " * 31, "    if x:\n        return  y   # z", "  ", "a" * 40 + " " * 100 + "b  c", "thontinwh xyz\U0001f642é"]
    for text, ids in zip(texts, m.encode_all(texts), strict=True):
        marked = "▁" + text.replace(" ", "▁")
        unknown = sum(c not in m.score for c in marked)
        assert sum(m.score[names[i]] for i in ids.tolist() if i in names) + unknown * m.unknown == best_scores(m, marked)
        assert ids.tolist() == list(m.stream(marked)) and m.decode(ids.tolist()) == text
    # the model has pieces of 2 to 14 and of 16 spaces
    assert len(m.encode(" " * 15)) == 1 and len(m.encode(" " * 31)) == 2
    # one lane of no final boundary goes through the stream, whose window stays small
    for text in ("abc" * 9000, " " * 30_000 + "abc" * 50, "a▁b ▁ c", "▁" * 9):
        assert m.decode(m.encode(text)) == text


def test_decoding_any_ids(spark):
    path = tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, [258]), (2, [40000, -1, None]), (3, None), (4, [])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in pieces.decode_pieces(df, path).collect()} == {(1, "\ufffd"), (2, ""), (3, ""), (4, "")}


def test_chat(spark):
    log = spark.createDataFrame(
        [(1, 0, "message", None, "user", "hi </s>\\"), (1, 1, "message", None, "assistant", "a"), (1, 2, "delta", 1, "assistant", "b"), (1, 3, "edit", 0, "user", "hello [/INST]"), (1, 4, "regenerate", 1, "assistant", ""), (1, 5, "delta", 1, "assistant", "new <s>"), (2, 0, "message", None, "user", None), (None, 0, None, None, None, None)],
        "c long, s long, kind string, target long, role string, text string",
    )
    made = chat.reconstruct(chat.events_of(log, "c", "s", "kind", "target"))
    assert {(r.conv_id, r.seq, r.role, r.text) for r in made.collect()} == {(1, 0, "user", "hello [/INST]"), (1, 1, "assistant", "new <s>"), (2, 0, "user", ""), (None, 0, "", "")}
    d = {r.conv_id: r for r in chat.digests(made).collect()}
    assert d[1].turns_sha256 == hashlib.sha256(b"user\nhello [/INST]\nassistant\nnew <s>\n").hexdigest()
    assert (d[1].loss_chars, d[1].loss_sha256) == (7, hashlib.sha256(b"new <s>").hexdigest())
    assert chat.digests(chat.reconstruct(chat.events_of(log.limit(0), "c", "s"))).count() == 0


def test_chat_of_large_and_missing_ids(spark):
    big = 1 << 53
    rows = [(big, 0, "user", "a"), (big + 1, 0, "user", "b"), (None, 0, "assistant", "c"), (big, 1, "assistant", "x" * 100_001), (big, 1, "assistant", "y"), (big, 1, "assistant", "y"), (big + 1, None, None, None)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.reconstruct(chat.edits_of(log))).collect()}
    expected = {big: ["user\na\n", "assistant\n" + "x" * 100_001 + "\n", "assistant\ny\n", "assistant\ny\n"], big + 1: ["user\nb\n", "\n\n"], None: ["assistant\nc\n"]}
    assert {k: (r.n_turns, r.turns_sha256) for k, r in got.items()} == {k: (len(t), hashlib.sha256("".join(t).encode()).hexdigest()) for k, t in expected.items()}
    assert got[big].loss_chars == 100_003
    kinds = {r.kind for r in chat.edits_of(log).collect()}
    assert kinds == {"message", "delta", "regenerate", "edit"}


def test_token_counts(docs, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(odd.sparkSession.createDataFrame([(9, "a<|endoftext|>ΑΣ Σ't x"), (10, "aaaa" * 99)], "doc_id long, text string"))
    expected = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in both.collect())
    assert sorted(r.n_tokens for r in token_counts.count_tokens(both, path).collect()) == expected
    assert token_counts.count_tokens(none, path).count() == 0


def test_licenses(spark, none):
    rows = [(1, "a/b/x.txt", "prose\nReleased under the MIT License."), (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/y.txt", "prose by the way"), (4, "z/q.txt", None), (5, None, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_license, r.license, r.license_dir) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "a/b"), 4: (None, None, None), 5: ("Proprietary", "Proprietary", None)}
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_licenses_headers_and_spdx(spark):
    full = dict(licenses.full_texts())
    comment = lambda text: "".join(f"// {x}\n" for x in text.split("\n"))
    wrap = lambda text: "\n".join(textwrap.wrap(text, 40))
    gpl = next(t for n, t in licenses.NOTICES if n == "GPL-3.0")
    rows = {f"{n}/LICENSE": (t.replace("<year> <copyright holders>", "2020 Jane Roe"), (n, True)) for n, t in full.items()}
    rows["wrapped/LICENSE"] = (wrap(full["MIT"]), ("MIT", True))
    rows["x/a.c"] = (comment(wrap(gpl)) + "\nint main() { return 0; }\n" * 40, ("GPL-3.0", False))
    rows["x/b.c"] = ("/* SPDX-License-Identifier: MIT */\n" + "int x = 0;\n" * 40, ("MIT", False))
    rows["x/c.c"] = ("// SPDX-License-Identifier: Zlib\n" + "int x = 0;\n" * 40, (None, False))
    rows["x/d.c"] = (comment(full["BSD-3-Clause"]) + "int x = 0;\n" * 400, ("BSD-3-Clause", False))
    rows["x/e.c"] = ("# Copyright 2020 Foo. All rights reserved.\n" + "int x = 0;\n" * 40, ("Proprietary", False))
    rows["x/f.c"] = ("GNU GENERAL PUBLIC LICENSE\n" + "int x = 0;\n" * 40, ("GPL", False))
    rows["x/g.c"] = ("we had copyright and a license of the warranty\n" * 9, (None, False))
    rows["MIT/src/h.c"] = ("int x = 0;", (None, False))
    df = spark.createDataFrame([(i, p, t) for i, (p, (t, _)) in enumerate(rows.items())], "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(df).collect()}
    assert {p: (r.own_license, r.license_file) for p, r in got.items()} == {p: e for p, (_, e) in rows.items()}
    assert (got["MIT/src/h.c"].license, got["MIT/src/h.c"].license_dir) == ("MIT", "MIT")


def test_quality(spark, odd, none):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
    assert quality.score_quality(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_rules_are_learned():
    import numpy as np

    rng = np.random.default_rng(0)
    x = {"a": rng.uniform(0, 1, 3000), "b": rng.uniform(0, 1, 3000), "noise": rng.uniform(0, 1, 3000)}
    bad = ((x["a"] > 0.7) & (x["b"] <= 0.4)) | (x["a"] <= 0.1)
    rules_ = rules.learn_rules(x, bad)
    told = np.zeros(3000, bool)
    for rule in rules_:
        told |= rules._covers(rule, x)
    assert (told == bad).mean() > 0.97 and 1 <= len(rules_) <= rules.MAX_RULES
    assert rules.learn_rules(x, np.zeros(3000, bool)) == []


def test_kept_follows_the_learned_list(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    stats = rules.materialize(rules.text_stats(docs))
    learned = rules.learn_rules(*rules.labelled_sample(stats, labels))
    assert learned
    import numpy as np

    for r in rules.apply_rules(docs, labels).collect():
        x = {n: np.array([r[a] / max(r[b], 1) if b else float(r[a])]) for n, (a, b) in rules.FEATURES.items()}
        assert r.kept == (not r.base_failed and not any(rules._covers(rule, x)[0] for rule in learned))
    marked = rules.apply_rules(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in marked) >= 0.95 * len(marked)


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clash = docs.withColumn("_id", F.lit(1)).withColumn("tag", F.lit("t")).withColumn("_key0", F.lit(2)).withColumn("_h", F.lit(3))
    good = docs.where("length(text) > 600").limit(1).first()
    more = [good.asDict() | {"doc_id": i, "text": t, "_id": 1, "tag": "t", "_key0": 2, "_h": 3} for i, t in ((good.doc_id, "too few words"), (None, good.text), (None, None), (900_001, ""))]
    docs = clash.unionByName(spark.createDataFrame([tuple(r[c] for c in clash.columns) for r in more], clash.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0, name
        rows, kept = docs.collect(), out.collect()
        got = Counter((r.doc_id, r.text) for r in kept)
        if name == "quality_rules":
            verdict = {(r.doc_id, r.tag): r.kept for r in rules.apply_rules(docs, labels, tagged=True).collect()}
            tag = {(r.doc_id, r.text): r.t for r in docs.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()}
            assert got == Counter((r.doc_id, r.text) for r in rows if verdict[r.doc_id, tag[r.doc_id, r.text]])
            assert all(len(words(t)) >= 50 for _, t in got) and (None, good.text) in got and (good.doc_id, good.text) in got
        elif name == "language_id":
            told = langid.Classifier(langid.learn(docs, langid.training_rows(docs)))
            assert got == Counter((r.doc_id, r.text) for r in rows if not told.predict(r.text)[2])
        elif name == "near_duplicates":
            sets = [shingles(r.text) for r in rows]
            order = sorted((k for k in range(len(rows)) if rows[k].doc_id is not None and sets[k]), key=lambda k: rows[k].doc_id)
            root = list(range(len(rows)))

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k

            for n, a in enumerate(order):
                for b in order[n + 1 :]:
                    same = len(sets[a] & sets[b])
                    if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                        root[max(find(a), find(b), key=order.index)] = min(find(a), find(b), key=order.index)
            assert got == Counter((r.doc_id, r.text) for k, r in enumerate(rows) if find(k) == k)
        else:
            sets = [shingles(r.text) for r in rows]
            assert got == Counter((r.doc_id, r.text) for r, s in zip(rows, sets) if not any(q and 100 * len(q & s) >= 80 * len(q) for q in benchmark))
        assert 0 < len(kept) < len(rows) or name == "language_id", name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = corpus_pipeline.materialize(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_words_of_texts_in_arrow():
    import pyarrow as pa

    texts = [*ODD, "É Q\x85q\x1cR", "\x0b\x0c a  \r\n"]
    for given in (pa.array(texts), pa.array(texts).slice(2, 5), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None, ""])):
        found, lengths = lm.words_of(given.cast(pa.string()) if pa.types.is_null(given.type) else given)
        want = [lm.words_in(t) for t in given.to_pylist()]
        assert found.to_pylist() == [w for x in want for w in x] and lengths.tolist() == [len(x) for x in want]


def test_lm_blocks_hold_all_words(spark):
    """All counts and weights come from these blocks: each id of each text is in one, after the id before it."""
    import numpy as np

    path = tokenizer("byte_bpe_50k.tiktoken")
    sub = lm.subwords(path)
    texts = [None, "", " ", "a b", "x " * (lm.BLOCK - 1), "x y " * (lm.BLOCK // 2), "Hello World " * 300 + "end"]
    rows = lm.blocks_of(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), path).collect()
    found = [np.frombuffer(bytes(r["ids"]), np.uint16) for r in rows]
    want = np.concatenate([sub.ids(lm.words_in(t)) for t in texts])
    assert np.array_equal(np.concatenate([x[1:] for x in found]), want)
    assert np.array_equal(np.concatenate([x[:1] for x in found[1:]]), [x[-1] for x in found[:-1]]) and found[0][0] == sub.end
    assert len({r["h"] for r in rows}) == len(rows) == sum(len(lm.words_in(t)) // lm.BLOCK + 1 for t in texts)


def test_lm_blocks_are_dropped_once_learned(spark, docs, monkeypatch):
    """The table of blocks, as large as the texts, is no longer on disk when texts are scored."""
    made, plain = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df: made.append(plain(df)) or made[-1])
    lm.score_texts(docs, tokenizer("byte_bpe_50k.tiktoken"))
    folders = [{f.rpartition("/")[0].removeprefix("file:").replace("//", "/") for f in df.inputFiles()} for df in made]
    left = [any(Path(f).exists() for f in found) for found in folders]
    assert left == [df.columns != ["h", "ids"] for df in made] and not all(left)


def test_lm_context_counts_against_loops(spark):
    """All of what is before and after each id is counted, also beside ids that are no contexts of their own; few windows are cut short."""
    import numpy as np

    path = tokenizer("byte_bpe_50k.tiktoken")
    sub = lm.subwords(path)
    texts = [None, "", *[" ".join(f"w{(k * i) % 97}x{i % 13}" for i in range(1, 60 * k)) for k in range(1, 12)]]
    blocks = lm.blocks_of(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), path).cache()
    counts = lm.block_counts(blocks, sub.size)
    frequent = np.argsort(-counts, kind="stable")[:20]
    want = np.zeros((sub.size, 2 * lm.CONTEXTS))
    place = {int(i): k for k, i in enumerate(frequent)}
    pieces = ids = 0
    for r in blocks.collect():
        x = np.frombuffer(bytes(r["ids"]), np.uint16).tolist()
        ids, pieces = ids + len(x) - 1, pieces - (-(len(x) - 1) // lm.WINDOW)
        for a, b in zip(x[:-1], x[1:], strict=True):
            want[b, place.get(a, lm.CONTEXTS - 1)] += 1
            want[a, lm.CONTEXTS + place.get(b, lm.CONTEXTS - 1)] += 1
    assert counts.sum() == ids and np.array_equal(lm.context_counts(blocks, frequent, counts), want)
    assert ids > 0.9 * pieces * lm.WINDOW
