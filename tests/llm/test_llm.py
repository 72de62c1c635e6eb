"""The training-data operators against brute force, round trips, held-out accuracy and awkward tables."""

import base64
import functools
import os
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import _graph, _io, bpe, html_extract, jaccard, media, packing, quality, registry, secret_scan, substring, suffixes, token_store

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, same int, place int, h string, node long, label string, mark string, origin int"
VOCABULARY = bpe.default_vocabulary()


def words(rng, n, size=4000):
    return " ".join("w" + "".join("bcdfghjklm"[int(c)] for c in str(int(k))) for k in rng.integers(0, size, n))


def corpus(seed=3):
    """Ids and texts: passages that repeat, near copies, exact copies, short and odd texts."""
    rng = np.random.default_rng(seed)
    shared = [words(rng, int(n)) for n in (50, 51, 60, 81, 130)]
    texts = []
    for k in range(60):
        parts = [words(rng, int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(len(shared)))], words(rng, int(rng.integers(0, 60)))]
        texts.append("  ".join(parts) + ("\n" if k % 3 else ""))
    base = words(rng, 200).split()
    for share in (0, 2, 5, 9, 14, 20, 30, 60):
        near = list(base)
        for at in rng.choice(200, share, replace=False):
            near[at] = f"x{at}{share}"
        texts.append(" ".join(near))
    loop = " ".join(["a b c d e"] * 40)
    return list(enumerate([*texts, loop, "x " * 49, "", "é" * 5, " ".join(["tie"] * 120)]))


def rows_of(pairs):
    return [(i, t, "en", "s", None if t is None else len(t), "d", 1, 2, "h", 3, "l", "m", 4) for i, t in pairs]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rng = np.random.default_rng(1)
    long = words(rng, 60_000)
    pairs = [(1, None), (None, "null id"), (None, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "short text"), (6, "short text"), (6, "other text"), (7, "naïve — 日本語 🎉\x00 done")]
    return spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(pairs, n=50):
    seen, out = {}, []
    for i, text in sorted(pairs):
        found, w = np.zeros(0, bool), text.split()
        found = np.zeros(len(w) + 1, bool)
        for p in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[p : p + n]), (i, p)) != (i, p):
                found[p : p + n] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(int)])))
        out += [(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return sorted(out)


def merged(rows):
    """Touching spans as one."""
    out = []
    for i, a, b in sorted(rows):
        if out and out[-1][0] == i and out[-1][2] >= a:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


@pytest.mark.parametrize("find", [substring.spans, suffixes.spans])
def test_spans_are_brute_forces(spark, find):
    pairs = corpus() + [(900, corpus()[5][1]), (901, corpus()[5][1])]
    got = find(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect()
    assert merged((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == merged(brute_spans(pairs))


def test_spans_of_awkward_tables(spark, awkward, empty):
    for find in (substring.spans, suffixes.spans):
        assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in find(awkward).collect()] == [(5, 0, 60_000)]
        assert find(empty).count() == 0
    kept = substring.remove(awkward)
    assert kept.schema == awkward.schema and Counter(map(str, kept.collect())) == Counter(str(r) for r in awkward.collect() if r["doc_id"] != 5)
    assert substring.remove(empty).count() == 0


def test_removed_passages_stay_once(spark):
    docs = spark.createDataFrame(rows_of(corpus()), SCHEMA)
    kept = substring.remove(docs).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    shared = corpus()[0:60]
    first = {t for _, t in shared}
    assert first and substring.spans(spark.createDataFrame(kept, docs.schema)).count() <= substring.spans(docs).count() // 4


@pytest.mark.parametrize("find", [substring.spans, suffixes.spans])
def test_spans_of_a_passage_in_half_of_the_documents(spark, find):
    """In seven tasks, so that the passage is gathered within slices and met between them."""
    rng = np.random.default_rng(4)
    passage = words(rng, 70)
    pairs = [(k, f"{words(rng, 30)} {passage} {words(rng, 30)}" if k % 2 else words(rng, 60)) for k in range(2000)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    got = [(r["doc_id"], r["start_word"], r["end_word"]) for r in find(docs).collect()]
    assert merged(got) == merged(brute_spans(pairs)) and len(got) == 999


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 5, 7, 50):
        codes, ends = rng.integers(0, 3, 400).astype(np.uint64), np.array([100, 101, 250, 400])
        left = ends[np.searchsorted(ends, np.arange(400), "right")] - np.arange(400)
        rank = suffixes.ranks(codes, left, depth)
        prefix = [tuple(codes[k : k + min(depth, left[k])]) for k in range(400)]
        order = sorted(prefix)
        assert rank.tolist() == [order.index(x) for x in prefix]


def test_suffix_family_in_batches(spark, tmp_path):
    """Batch by batch: the repeats of all documents in their order, and n log k keys written."""
    rng = np.random.default_rng(12)
    shared = [words(rng, 60) for _ in range(4)]
    pairs = [(k, " ".join([words(rng, 70), shared[k % 4] if k % 3 == 0 else "", words(rng, 40)])) for k in range(96)]
    family, found, written = suffixes.Family(str(tmp_path), 3), [], []
    sizes = lambda: {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".keys")}
    for k in range(16):
        before = sizes()
        family = suffixes.Family.load(str(tmp_path)) if k else family
        docs = spark.createDataFrame(pairs[k * 6 : k * 6 + 6], "doc_id long, text string").coalesce(1)
        found += [(r["doc"], a, b - 1 + 50) for r in family.update(docs).collect() for a, b in zip(r["ranges"][::2], r["ranges"][1::2])]
        after = sizes()
        assert all(after[f] == n for f, n in before.items() if f in after)
        written.append(sum(n for f, n in after.items() if f not in before))
        assert [n for n, _ in family.levels] == [1 << b for b in range(4, -1, -1) if (k + 1) >> b & 1]
    assert merged(found) == merged(brute_spans(pairs))
    assert sum(written) <= 5.5 * written[-1] and written[-2] < 0.15 * written[-1]


def trigrams(text):
    w = text.split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def true_links(pairs):
    """By document: the others that are near it, and the least id of those that links connect it with."""
    sets = {i: trigrams(t) for i, t in pairs}
    near = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j])}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return near, {i: sum(i in p for p in near) for i in sets}, root


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_is_exact_and_recalls(spark, awkward, empty, block):
    pairs = corpus() + [(900, corpus()[5][1]), (901, corpus()[5][1]), (902, corpus()[61][1] + " ")]
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA)
    near, count, root = true_links(pairs)
    got = {r["doc_id"]: r for r in jaccard.classes(docs, block=block).collect()}
    assert set(got) == set(count) and all(r["n_links"] <= count[i] for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= jaccard.RECALL * sum(count.values()) > 20
    assert np.mean([got[i]["class_id"] == root[i] for i in root]) >= jaccard.RECALL
    sets = {i: trigrams(t) for i, t in pairs}
    rows = jaccard.join(docs, block=block).collect()
    assert all(abs(len(sets[r["doc_a"]] & sets[r["doc_b"]]) / len(sets[r["doc_a"]] | sets[r["doc_b"]]) - r["jaccard"]) < 1e-9 and r["doc_a"] < r["doc_b"] for r in rows)
    different = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in near if sets[i] != sets[j]}
    found = {frozenset((frozenset(sets[r["doc_a"]]), frozenset(sets[r["doc_b"]]))) for r in rows if sets[r["doc_a"]] != sets[r["doc_b"]]}
    assert len(found) >= jaccard.RECALL * len(different) and len({(r["doc_a"], r["doc_b"]) for r in rows}) == len(rows)
    left = {r["doc_id"] for r in jaccard.one_of_each(docs, block=block).collect()}
    assert left == {i for i, r in got.items() if r["class_id"] == i}


def test_jaccard_of_awkward_tables(spark, awkward, empty):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.classes(awkward).collect())
    assert got == Counter({(1, 1, 0): 1, (None, None, 0): 2, (2, 2, 0): 1, (3, 3, 0): 1, (4, 4, 1): 1, (5, 4, 1): 1, (6, 6, 0): 2, (7, 7, 0): 1})
    assert [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in jaccard.join(awkward).collect()] == [(4, 5, 1.0)]
    assert jaccard.join(empty).count() == jaccard.one_of_each(empty).count() == jaccard.classes(empty).count() == 0
    left = jaccard.one_of_each(awkward)
    assert left.columns == awkward.columns
    assert sorted((str(r["doc_id"]), str(r["text"])[:10]) for r in left.collect()) == sorted((str(r["doc_id"]), str(r["text"])[:10]) for r in awkward.distinct().collect() if r["doc_id"] != 5)
    blank = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (1, "", "c"), (1, "", "d"), (None, "x y", "e"), (None, "x y", "f"), (3, "x y", "g")], "doc_id long, text string, source string")
    assert sorted(r["source"] for r in jaccard.one_of_each(blank).collect()) == ["a", "b", "c", "d", "e"]


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (50, 2))] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({r["node"]: r["label"] for r in _graph.components(df, most).collect()} for most in (10**6, 0))
    root = {}
    for a, b in edges * 60:
        root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    assert one == many == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert _graph.components(df.limit(0)).count() == 0


def test_jaccard_recalls_isolated_pairs_beside_large_groups(spark):
    rng = np.random.default_rng(5)

    def copy(base, changes):
        near = list(base)
        for at in np.arange(changes) * (len(base) // changes) + 3:
            near[at] = words(rng, 1, 10**9)
        return " ".join(near)

    texts = []
    for _ in range(8):
        base = words(rng, 200).split()
        texts += [copy(base, 2) for _ in range(60)]
    for _ in range(60):  # at about 0.65
        base = words(rng, 200).split()
        texts += [" ".join(base), copy(base, 14)]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.classes(spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)).collect()}
    assert np.mean([got[k] == got[k + 1] for k in range(480, 600, 2)]) >= 0.9


def test_jaccard_of_a_long_chain(spark):
    """Each of 20,000 texts is near those next to it only: one component, far over a block."""
    rng = np.random.default_rng(6)
    stream = words(rng, 20_000 * 4 + 60, 10**6).split()
    texts = [" ".join(stream[k * 4 : k * 4 + 60]) for k in range(20_000)]
    got = jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # 58 trigrams, 54 of them a neighbour's, 50 the next but one's, 46 and 42 those after
    linked = [d for d in range(1, 15) if (58 - 4 * d) >= 0.6 * (58 + 4 * d)]
    assert linked == [1, 2, 3]
    total = sum(2 * (20_000 - d) for d in linked)
    assert 0.95 * total <= sum(r["n_links"] for r in got) <= total and max(r["n_links"] for r in got) == 6
    assert len({r["class_id"] for r in got}) <= 3


def test_secrets_held_out():
    net = secret_scan.trained()
    found = secret_scan.findings(600, seed=987)
    data = [f[0].encode() for f in found]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    begin, end = off[:-1] + [f[1] for f in found], off[:-1] + [f[2] for f in found]
    symbols, stats = secret_scan.windows(np.frombuffer(b"".join(data), np.uint8), off, np.arange(len(found)), begin, end)
    said, truth = net.scores(symbols, stats) >= net.threshold, np.array([f[3] for f in found])
    assert said[truth].mean() >= 0.95 and said[~truth].mean() <= 0.05


def test_secrets_found_end_to_end():
    for name in ("secret_key", "SECRET-KEY", "private_key", "encryption_key", "signingKey", "api_key"):
        assert [c for _, c in candidate_texts([f'x {name} = "ab!cd#ef%12"'])] == ["ab!cd#ef%12"]
    net, found = secret_scan.trained(), secret_scan.findings(2000, seed=988)
    data = [f[0].encode() for f in found]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    row, begin, end = secret_scan.candidates(raw, off)
    said = net.scores(*secret_scan.windows(raw, off, row, begin, end)) >= net.threshold
    hit = lambda k: (said & (row == k) & (begin <= off[k] + found[k][1]) & (end >= off[k] + found[k][2])).any()
    assert np.mean([hit(k) for k, f in enumerate(found) if f[3]]) >= secret_scan.RECALL
    assert np.mean([(said & (row == k)).any() for k, f in enumerate(found) if not f[3]]) <= 0.05


def test_secret_network_is_brute_forces():
    """Scores of every candidate of some texts against loops over patterns, windows and filters."""
    net = secret_scan.trained()
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts = [f[0] for f in secret_scan.findings(24, seed=51)] + ["the password = k9#Qv2!xW7m%", "Then", "client_secret: pT4^mZ8*qL1"]
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    row, begin, end = secret_scan.candidates(raw, off)
    assert {24, 26} <= set(row.tolist()) and len(row) >= 20
    symbols, stats = secret_scan.windows(raw, off, row, begin, end)
    got = net.scores(symbols, stats)
    for k in range(len(row)):
        text, a, b = data[row[k]], int(begin[k] - off[row[k]]), int(end[k] - off[row[k]])
        value = text[a:b] if b - a <= secret_scan.MIDDLE else text[a : a + secret_scan.MIDDLE * 3 // 4] + text[b - secret_scan.MIDDLE // 4 : b]
        pad = lambda x, n, left: [0] * (n - len(x)) + x if left else x + [0] * (n - len(x))
        codes = [int(c) for c in secret_scan._SYMBOL[np.frombuffer(text, np.uint8)]]
        line = pad(codes[max(0, a - secret_scan.LEFT) : a], secret_scan.LEFT, True) + pad([int(secret_scan._SYMBOL[c]) for c in value], secret_scan.MIDDLE, False) + pad(codes[b : b + secret_scan.RIGHT], secret_scan.RIGHT, False)
        assert symbols[k].tolist() == line
        x = [[*w["letters"][c], float(secret_scan.LEFT <= i < secret_scan.LEFT + secret_scan.MIDDLE)] for i, c in enumerate(line)]
        conv = lambda rows, f, bias: [[max(0.0, sum(rows[i + t][d] * f[d * 5 + t, o] for t in range(5) for d in range(len(rows[0]))) + bias[o]) for o in range(f.shape[1])] for i in range(len(rows) - 4)]
        if k >= 3:
            continue  # three of them through the loops
        one = conv(x, w["first"], w["first_b"])
        half = [[max(p, q) for p, q in zip(one[2 * i], one[2 * i + 1])] for i in range(len(one) // 2)]
        two = conv(half, w["second"], w["second_b"])
        cut = secret_scan.LEFT // 2 - 2
        top = [max(r[o] for r in two[:cut]) for o in range(24)] + [max(r[o] for r in two[cut:]) for o in range(24)] + stats[k].tolist()
        z = net.scale[0] * (sum(t * v for t, v in zip(top, w["out"][:, 0])) + w["out_b"][0]) + net.scale[1]
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-4


def test_secret_gradients():
    net = secret_scan.train(secret_scan.findings(64, 1), epochs=1)
    rng = np.random.default_rng(0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    symbols, stats, truth = rng.integers(0, 64, (4, secret_scan.WIDTH)).astype(np.uint8), rng.normal(size=(4, 8)), np.array([1.0, 0, 1, 0])
    loss = lambda: float(np.mean(np.logaddexp(0, z := net._forward(symbols, stats)[-1][:, 0]) - truth * z))
    grads = net._gradients(symbols, stats, truth)
    for name in ("first", "second", "out"):
        k = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held = net.weights[name][k]
        net.weights[name][k] = held + 1e-3
        up = loss()
        net.weights[name][k] = held - 1e-3
        assert abs((up - loss()) / 2e-3 - grads[name][k]) < 2e-2 * max(1e-2, abs(grads[name][k]))
        net.weights[name][k] = held


def test_secret_scan_of_tables(spark, awkward, empty):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"
    docs = spark.createDataFrame(rows_of([(1, f"é use token = '{key}' now"), (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b done"), (3, None)]), SCHEMA)
    found = secret_scan.scan(docs).collect()
    assert [(r["doc_id"], docs.first()["text"][r["start_char"] : r["end_char"]]) for r in found] == [(1, key)]
    redacted = secret_scan.redact(docs)
    assert redacted.schema == docs.schema and [r["text"] for r in redacted.orderBy("doc_id").collect()][0] == "é use token = '[SECRET]' now"
    assert Counter(map(str, secret_scan.redact(awkward).collect())) == Counter(map(str, awkward.collect()))
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(awkward).count() == 0


def candidate_texts(texts):
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    row, begin, end = secret_scan.candidates(np.frombuffer(b"".join(data), np.uint8), off)
    return sorted((texts[r], data[r][a - off[r] : b - off[r]].decode()) for r, a, b in zip(row, begin, end))


def test_secret_candidates_keep_to_their_row():
    texts = ["db pwd=Tr0ub4dor&3", "The next text", "see ftp://me:hun!er!", "2@host", "é -----BEGIN PRIVATE KEY-----\nMII", "a -----END PRIVATE KEY-----", "my password", "=N0t&Assigned", "", "pwd: 8!bytes!"]
    alone = sorted(x for t in texts for x in candidate_texts([t]))
    assert [c for _, c in alone] == ["Tr0ub4dor&3", "8!bytes!", "-----BEGIN PRIVATE KEY-----"]
    rng = np.random.default_rng(2)
    for _ in range(20):
        assert candidate_texts([texts[k] for k in rng.permutation(len(texts))]) == alone


def test_packing(spark, awkward, empty):
    docs = spark.createDataFrame(rows_of([*corpus(), (901, words(np.random.default_rng(9), 3000))]), SCHEMA)
    counts = {r["doc_id"]: r["n"] for r in packing.token_counts(docs, VOCABULARY).collect()}
    rows = packing.pack(docs, VOCABULARY, 512).collect()
    held, bins = {}, {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        bins.setdefault(r["bin_id"], []).append((r["offset"], r["n_tokens"]))
    assert set(held) == {d for d, n in counts.items() if n}
    for d, parts in held.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == counts[d]
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset >= at
            at = offset + n
        assert at <= 512
    room: list[int] = []  # best fit, longest first, piece by piece
    for n in sorted((r["n_tokens"] for r in rows), reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(512 - n)
    assert len(bins) <= len(room) * 1.001 + 1
    assert packing.pack(empty, VOCABULARY).count() == 0
    assert sum(r["n_tokens"] for r in packing.pack(awkward, VOCABULARY).collect()) == sum(r["n"] for r in packing.token_counts(awkward, VOCABULARY).collect())
    with pytest.raises(ValueError):
        packing.solve({9: 1}, 8)


def fewest(items, capacity):
    """The exact optimum: every maximal filling that holds the longest piece left."""

    @functools.cache
    def best(left):
        big = max((k for k, (_, n) in enumerate(left) if n), default=None)
        if big is None:
            return 0
        out = []

        def fill(k, room, taken):
            if k < 0:
                out.append(1 + best(tuple((s, n - t) for (s, n), t in zip(left, taken[::-1]))))
                return
            s, n = left[k]
            most = min(n, room // s)
            for t in range(most if k == 0 else int(k == big), most + 1):
                fill(k - 1, room - t * s, [*taken, t])

        fill(len(left) - 1, capacity, [])
        return min(out)

    return best(tuple(sorted(items.items())))


def best_fit_alone(histogram, capacity):
    return sum(n for _, n in packing._best_fit(dict(histogram), [], capacity))


def test_packing_program():
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.choice([10, 20, 30]))
        histogram = {int(s): int(rng.integers(1, 8)) for s in rng.choice(np.arange(2, capacity + 1), int(rng.integers(1, 5)), replace=False)}
        made = packing.solve(histogram, capacity)
        held = Counter()
        for config, n in made.patterns:
            assert sum(s * k for s, k in config.items()) <= capacity
            held.update({s: k * n for s, k in config.items()})
        assert held == Counter(histogram)
        assert made.bound - 1e-9 <= made.sequences == fewest(histogram, capacity)
    # Large histograms: within a thousandth of the bound, and most sequences come from the program.
    lengths = np.clip(rng.lognormal(5.5, 1, 60_000).astype(int) + 1, 1, 512)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True))}
    made = packing.solve(histogram, 512)
    assert made.bound <= made.sequences <= min(made.bound * 1.001 + 1, best_fit_alone(histogram, 512) * 1.001)
    assert made.rounded >= 0.9 * made.sequences
    assert packing.solve({}, 8).sequences == 0 and packing.solve({8: 3}, 8).sequences == 3


def test_html_held_out(spark):
    net = html_extract.trained()
    held = html_extract.labelled_pages(150, seed=77)
    blocks = html_extract.Blocks([html_extract.parse(p)[1] for p, _ in held])
    truth = np.array([y for _, t in held for y in t])
    assert ((net.scores(blocks) >= 0.5) == truth).mean() >= 0.97
    rows = html_extract.blocks(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert np.mean([r["content"] == ("article" in r["path"]) for r in rows]) >= 0.97


def test_html_network_is_brute_forces():
    """Scores of all blocks of some pages against a loop over blocks, gates and units."""
    net = html_extract.trained()
    w, h = {k: v.astype(np.float64) for k, v in net.weights.items()}, html_extract.HIDDEN
    pages = [p for p, _ in html_extract.labelled_pages(6, seed=3)] + ["<article>" + "<div>" * 30 + "deep" + "</div>" * 30 + "<p>x</p></article>"]
    parsed = [html_extract.parse(p)[1] for p in pages]
    assert any(n.startswith("article") for n in parsed[-1][0][0][0])  # an element far out is seen
    got, at = net.scores(html_extract.Blocks(parsed)), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for page in parsed:
        alone = html_extract.Blocks([page])
        fed = net._inputs(alone).astype(np.float64)
        states = {}
        for way, order in (("on", range(len(page))), ("back", range(len(page) - 1, -1, -1))):
            state, cell = np.zeros(h), np.zeros(h)
            for k in order:
                z = [sum(fed[k][i] * w[f"{way}_x"][i, g] for i in range(fed.shape[1])) + state @ w[f"{way}_h"][:, g] + w[f"{way}_b"][g] for g in range(4 * h)]
                i, f, o, c = sigmoid(np.array(z[:h])), sigmoid(np.array(z[h : 2 * h])), sigmoid(np.array(z[2 * h : 3 * h])), np.tanh(z[3 * h :])
                cell = f * cell + i * c
                state = o * np.tanh(cell)
                states[way, k] = state
        for k in range(len(page)):
            top = np.concatenate([states["on", k], states["back", k], fed[k]])
            assert abs(sigmoid(float(top @ w["out"][:, 0] + w["out_b"][0])) - got[at + k]) < 1e-4
        at += len(page)


def test_html_gradients():
    held = html_extract.labelled_pages(3, seed=5)
    net = html_extract.Labeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    blocks = html_extract.Blocks([html_extract.parse(p)[1] for p, _ in held])
    pages, truth = np.arange(len(held)), np.array([y for _, t in held for y in t], np.float64)
    loss = lambda: float(-np.mean(np.log(np.where(truth > 0, s := net.scores(blocks), 1 - s))))
    grads = net.gradients(blocks, pages, truth)
    for name in ("on_x", "back_h", "words", "paths", "out"):
        k = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held_value = net.weights[name][k]
        net.weights[name][k] = held_value + 1e-2
        up = loss()
        net.weights[name][k] = held_value - 1e-2
        assert abs((up - loss()) / 2e-2 - grads[name][k]) < 5e-2 * max(1e-2, abs(grads[name][k])), name
        net.weights[name][k] = held_value


def test_html_of_awkward_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    pages = [(1, None), (2, ""), (None, "<p>x"), (3, "<"), (4, deep), (5, "<p>" * 5000), (6, "<a href='x>" * 2000), (7, "<!-- never closed <p>x</p>"), (8, "<script>x"), (8, "<script>x")]
    df = spark.createDataFrame([(i, h, "b", 1.0) for i, h in pages], "page_id long, html string, block string, score double")
    out = html_extract.extract(df).collect()
    assert len(out) == len(pages) and all(r["text"] == "" for r in out if r["page_id"] in (1, 2, 7, 8))
    assert html_extract.extract(df.limit(0)).count() == 0
    title, blocks = html_extract.parse("<title>a &amp; b</title><p>x<b>y<p>z</b></p><li>q")
    assert title == "a & b" and [b[1] for b in blocks] == ["xy", "z", "q"]


def test_quality(spark, awkward, empty):
    got = {str(r["doc_id"]) + str(r["m_chars"]): r["fail_bits"] for r in quality.ledger(awkward).collect()}
    assert got["10"] == 1 << quality.RULES.index("blank") and quality.ledger(empty).count() == 0
    kept = quality.keep(awkward)
    assert kept.schema == awkward.schema and all(r["text"] and r["text"].strip() for r in kept.collect()) and kept.count() == 7
    bad = [("lorem ipsum dolor sit amet", "filler"), ("A" * 40, "shouting"), ("no no no no no no no", "stutter"), ("#$% #$% x", "symbols")]
    rows = quality.ledger(spark.createDataFrame(rows_of(list(enumerate(t for t, _ in bad))), SCHEMA)).collect()
    for r, (_, rule) in zip(sorted(rows, key=lambda r: r["doc_id"]), bad):
        assert r["fail_bits"] >> quality.RULES.index(rule) & 1
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ledger = quality.ledger(docs)
    table = {r["rule"]: r for r in quality.ablate(ledger, "v1").collect()}
    bits = [r["fail_bits"] for r in ledger.collect()]
    for k, rule in enumerate(quality.RULES):
        assert (table[rule]["failing"], table[rule]["only_this"], table[rule]["rejected"]) == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits), sum(b > 0 for b in bits))
    assert quality.keep(docs).count() == sum(b == 0 for b in bits)


def test_bpe_agrees_and_returns(spark, awkward, empty):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    signs = list("ab cZ9'sdé日\n\t  .!?_-🎉١½  ßǅ") + ["'ll", "'ve", "  ", "\r\n"]
    texts = ["".join(signs[k] for k in rng.integers(0, len(signs), int(rng.integers(0, 80)))) for _ in range(400)]
    docs = spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, VOCABULARY).collect()}
    assert got == {i: other.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()}
    assert back == dict(enumerate(texts))
    rows = bpe.encode(awkward, VOCABULARY).collect()
    assert len(rows) == awkward.count() and bpe.encode(empty, VOCABULARY).count() == 0
    assert sorted(r["text"] for r in bpe.decode(bpe.encode(awkward, VOCABULARY), VOCABULARY).collect()) == sorted(r["text"] or "" for r in awkward.collect())
    for begin, end in ((0, 7), (5, 31), (40, 10_000)):
        parts = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_range(bpe.encode(spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA), VOCABULARY), VOCABULARY, begin, end).collect()}
        assert all(parts.get(i, b"") == t.encode()[begin:end] for i, t in enumerate(texts))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    back = bpe.decode(registry.QUERIES["op8_byte_bpe"](spark, DATA), VOCABULARY)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_token_store(spark, awkward, empty, tmp_path):
    keys = np.unique(np.random.default_rng(2).integers(-(2**62), 2**62, 20_000))
    perfect = token_store.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    docs = spark.createDataFrame(rows_of(corpus()), SCHEMA)
    store, _ = token_store.write(docs, str(tmp_path / "a"), VOCABULARY)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, VOCABULARY).collect()}
    assert all(store.get(k).tolist() == v for k, v in ids.items()) and store.get(10**9) is None
    found = token_store.lookup(docs, store).collect()
    assert len(found) == len(ids) and all(r["intact"] for r in found)
    shard = next(f for f in sorted(os.listdir(tmp_path / "a")) if f.endswith(".ids"))
    with open(tmp_path / "a" / shard, "r+b") as file:
        file.write(b"\xff\xff\xff\xff")
    assert not all(r["intact"] for r in token_store.lookup(docs, store).collect())
    store, _ = token_store.write(awkward, str(tmp_path / "b"), VOCABULARY)
    assert len(token_store.lookup(awkward.select("doc_id").distinct(), store).collect()) == 7 and len(store.get(2)) == 0
    store, _ = token_store.write(empty, str(tmp_path / "c"), VOCABULARY)
    assert store.get(1) is None and token_store.lookup(empty, store).count() == 0


def test_media(spark, tmp_path):
    payloads = [(1, b"\x89PNG\r\n\x1a\nxx"), (2, b""), (3, None), (None, b"x"), (4, os.urandom(300_000)), (4, b"again")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "m") for i, b in payloads], "key long, body binary, member string")
    made = media.write_archives(df, str(tmp_path / "a"), "key", "body", archive_bytes=1000)
    assert sum(r["n_members"] for r in made.collect()) == 5
    (tmp_path / "a" / "left-by-a-dead-attempt.zip").write_bytes(b"no archive")
    rows = media.members(spark, str(tmp_path / "a"), rangeBytes="1000", manifest=str(tmp_path / "a" / "manifest")).collect()
    assert Counter((r["member"], bytes(r["content"])) for r in rows) == Counter((str("null" if i is None else i), b) for i, b in payloads if b is not None)
    assert {r["media_type"] for r in rows if r["member"] == "1"} == {"image/png"}
    chunks = media.members(spark, str(tmp_path / "a"), rangeBytes="1000", chunkBytes="7000", manifest=str(tmp_path / "a" / "manifest")).where("size = 300000").orderBy("part").collect()
    assert len(chunks) == 43 and b"".join(bytes(r["content"]) for r in chunks) == payloads[4][1] and {r["parts"] for r in chunks} == {43}
    folder = tmp_path / "b"
    folder.mkdir()
    with zipfile.ZipFile(folder / "x.zip", "w") as out:
        out.writestr("good", b"g" * 50)
        out.writestr("bad", b"b" * 50)
    data = (folder / "x.zip").read_bytes()
    (folder / "x.zip").write_bytes(data.replace(b"b" * 50, b"c" * 50))
    (folder / "y.zip").write_bytes(b"no archive")
    for chunk in ("1000", "20"):  # in one row, and as parts after a check of the whole
        rows = {r["member"]: r["status"] for r in media.members(spark, str(folder), waitSeconds="0", chunkBytes=chunk).collect()}
        assert rows == {"good": "ok", "bad": "failed", None: "archive_failed"}
    (tmp_path / "none").mkdir()
    assert media.members(spark, str(tmp_path / "none")).count() == 0
    assert media.write_archives(df.limit(0), str(tmp_path / "d"), "key", "body").count() == 0


def test_media_tries_again(tmp_path, monkeypatch):
    """A read that fails twice and then succeeds gives the payload."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as out:
        out.writestr("a", b"payload")
    reader, calls, real = media._Reader({"path": str(tmp_path), "waitSeconds": "0"}), [], media.read_member

    def flaky(path, info, *rest):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("gone for a while")
        return real(path, info, *rest)

    monkeypatch.setattr(media, "read_member", flaky)
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.column("content").to_pylist() == [b"payload"] and len(calls) == 3


def test_shared_storage(spark):
    with pytest.raises(ValueError):
        _io.opened("relative/path")
    with pytest.raises(Exception):
        _io.opened("nosuch://bucket/x")

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        _io.shared_dir(Session)
    kept = _io.written(spark.range(3), "kept")
    assert os.path.isdir(kept.loomwork_path)
    _io.forget(kept)
    assert not os.path.exists(kept.loomwork_path)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_pipeline_stages(spark, awkward, empty):
    for table in (empty, awkward, spark.createDataFrame(rows_of(corpus()), SCHEMA)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema == table.schema
            docs = spark.createDataFrame(out.collect(), out.schema)
        packed = docs.collect()
    sets = {i: trigrams(t) for i, t in corpus()}
    left = {r["doc_id"] for r in jaccard.one_of_each(table).collect()}
    gone = set(sets) - left
    near = lambda i, j: len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j])
    assert gone and all(any(near(i, j) for j in sets if j != i and sets[j]) for i in gone)
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and near(i, j)]
    assert sum(i in left and j in left for i, j in pairs) <= 0.1 * len(pairs)
    assert {r["doc_id"] for r in packed} <= left
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "secret_scan", "best_fit_packing"]
