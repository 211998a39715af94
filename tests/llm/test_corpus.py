"""The corpus operators against brute force on small rows that hold nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusloom.llm import ann, bpe, chunkdedup, common, fingerprints, licenses, masked_lm, neardup, packing, texthash, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(1, 9))) for _ in range(4000)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(text: str, n: int, seed: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


BASE = prose(150, 1)
TEXTS = [None, "", "   \n", "one", "one", "two words", "A b c d", "a B c D", BASE, BASE, *(changed(BASE, k % 9, k) for k in range(60)), prose(300, 2), prose(30000, 3), "x" * 200_000, "Ünï Straße", "ünï  STRASSE ", "ﬁne"]
ROWS = [(i, t, "s", i, i) for i, t in enumerate(TEXTS)] + [(3, "one", "s", 0, 0), (None, BASE, "s", 0, 0)]
SCHEMA = "doc_id long, text string, _slot string, n_chars long, rep long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- near-duplicates


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = sets_of(t, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_components(docs, k):
    got = neardup.components(docs, shingle=k).collect()
    want = brute_components(ROWS, k, 80)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_components_of_chains_and_lone_changes(spark):
    """Near copies whose links run over each other only, and copies too far from all others."""
    r = random.Random(8)
    texts, t = [], prose(120, 77)
    for k in range(40):
        texts.append(t)
        t = changed(t, 1 + (k % 3 == 0), k)
    texts += [changed(texts[0], r.randint(3, 8), 100 + k) for k in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, 4, 80)


def test_deduplicated_keeps_columns_and_one_of_each(docs, none):
    out = neardup.deduplicated(docs)
    want = brute_components(ROWS, 5, 80)
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert out.columns == docs.columns and kept == sorted([i for i, (_, c) in want.items() if i == c] + [3])
    assert neardup.components(none).count() == 0 and neardup.deduplicated(none).count() == 0


def test_shingles_of_long_texts_equal_those_of_short_buffers(monkeypatch):
    texts = [(t or "").encode().lower() for t in TEXTS]
    whole = list(texthash.words(texts))
    monkeypatch.setattr(texthash, "SEGMENT", 1000)
    assert all((a == b).all() and len(a) == len(t.split()) for a, b, t in zip(whole, texthash.words(texts), texts, strict=True))


# --- fingerprints


def test_fingerprint_query(spark, tmp_path, docs):
    unique = [r for r in ROWS[:-2]]
    spark.createDataFrame(unique, SCHEMA).select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    for (i, t, *_), (j, n, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, n, k = t or "", n or "", len(t or "") // 3
        e = t[: len(t) - k] + n[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].near_next == (got[i].fingerprint == got[j].fingerprint) and got[i].near_edited == (got[i].fingerprint == got[i].edited_fingerprint)
    f = [got[i].fingerprint for i in range(len(TEXTS))]
    assert f[0] == f[1] == f[2] and f[3] == f[4] and f[6] == f[7] and f[8] == f[9] and f[-2] == f[-3] and len(set(f[10:70])) > 40


def test_fingerprints_tell_texts_of_one_hash_apart(spark, monkeypatch, none):
    monkeypatch.setattr(fingerprints, "_hash", lambda form: [(F.length(form) * 0).cast("long").alias("h1"), (F.length(form) * 0).cast("long").alias("h2"), (F.length(form) * 0).cast("long").alias("size")])
    df = spark.createDataFrame([(1, "a", "x", 7), (2, "A ", "x", 7), (3, "b", "x", 7), (4, None, "x", 7)], "k int, t string, _form_0 string, h1 int")
    out = fingerprints.fingerprints(df, {"t": "f"}).collect()
    assert all((r._form_0, r.h1) == ("x", 7) for r in out)
    got = {r.k: r.f for r in out}
    assert got[1] == got[2] and len(set(got.values())) == 3
    assert fingerprints.fingerprints(none, {"text": "f"}).count() == 0


def test_next_with_null_and_repeated_ids(spark, none):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (7, "z")], "doc_id long, text string")
    got = sorted((r.text, r.next_text) for r in fingerprints.with_next(df).collect())
    assert got == [("a", "b"), ("b", "n"), ("n", "z"), ("z", "a")] and fingerprints.with_next(none).count() == 0


# --- licenses


def test_notices(docs, spark, none):
    long = prose(5000, 4)
    texts = [None, "", "Released under the MIT License.", f"{long}\nThis work is licensed under the  GNU general public license, version 3.\n{long}", "released UNDER the mit license. Released under the MIT license.", "Licensed under CC BY-NC 4.0.", "the license was released under that"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in got) == [(2, "MIT", 1.0), (3, "GPL-3.0", 1.0), (4, "MIT", 1.0), (4, "MIT", 1.0), (5, "CC-BY-NC-4.0", 1.0)]
    assert next(r.start_word for r in got if r.doc_id == 3) == 5000 and licenses.scan(none).count() == 0


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Released under the BSD License", "BSD-short"), ("Released under the Apache License", "Apache-short"), ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0-long"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", "MPL-1.1"), ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        (licenses.NOTICES["GPL-3.0-header"] + ", or (at your option) any later version.", "GPL-3.0-header"),
        (licenses.NOTICES["BSD-3-Clause"].replace("binary forms,", "binary forms " + " ".join(f"w{i}" for i in range(20))), "BSD-3-Clause"),
        ("released by us in the year under some terms, the first of all: MIT, or any other license", None), ("", None),
    ],
)
def test_license_names(text, license):
    scanner = licenses.Scanner(licenses.NOTICES, deciding=licenses.DECIDING)
    for around in ("", prose(300, 5)):
        got = scanner.scan(f"{around} {text}. {around}")
        assert [g[0] for g in got] == ([license] if license else [])
        assert not license or got[0][2] == len(around.split())
    twice = scanner.scan(f"{text} {prose(40, 6)} {text}")
    assert [g[0] for g in twice] == ([license] * 2 if license else [])


def test_alignment_is_the_longest_one_where_words_are_distinct():
    for seed in range(200):
        r = random.Random(seed)
        a, b = (r.sample("abcdefghijklmnop", r.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(licenses.aligned(a, b)) == best[-1][-1]


def test_patience():
    for seed in range(200):
        r = random.Random(seed)
        places = [r.randrange(30) for _ in range(r.randint(0, 9))]
        best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if all(x < y for x, y in itertools.pairwise(c))), default=0)
        assert len(licenses.rising(places)) == best
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 12))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    assert len(licenses.aligned(list("abcab"), list("abcab"))) == 5


# --- urls


def test_urls(spark):
    urls = [None, "", "no host", "http://X.example.NET/en/a?b", "http://example.net", "https://a.org/fr/", "http://spam-farm.example.org/x", "http://evilnet/", "http://a.example.com/de/#x", "ftp://example.com?x://y/de/"]
    urls.append("http://" + "a." * 300 + "example.org/" + "p/" * 20_000)
    rows = [(i, u, "taken", "rule", "v", "r") for i, u in enumerate(urls)] + [(3, urls[3], "", "", "v", "r")]
    entries = spark.createDataFrame([(f, "rule", v) for f, v in urlfilter.RULES.items()] + [(f, "listed", "block") for f in urlfilter.LISTED], "form string, kind string, verdict string")
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, _verdict string, _rest string")
    got = urlfilter.judged(df, entries)
    assert got.where("_verdict = 'v' AND _rest = 'r'").count() == len(rows)

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = lambda e: ("." + host).endswith("." + e.split("/")[0]) and path.startswith(e[e.index("/") :])
        rule = max(filter(fits, urlfilter.RULES), key=len, default=None)
        return host, path, rule, urlfilter.RULES[rule] if rule else "block" if any(map(fits, urlfilter.LISTED)) else "allow"

    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == sorted((i, *(x or "" for x in brute(u))) for i, u, *_ in rows)
    assert urlfilter.judged(df, entries.limit(0)).where("verdict = 'allow'").count() == len(rows) and urlfilter.judged(df.limit(0), entries).count() == 0


# --- packing and BPE


def test_packing(docs, none):
    got = packing.packed_digests(docs).collect()
    ids = packing.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i is None, i or 0, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ROWS)
    assert sorted({(r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in got}) == sorted(set(want))
    assert sum(r.length for r in got) == sum(n for *_, n in want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None:
            data = ids(TEXTS[r.doc_id] or "") + bytes(4)
            assert zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(itertools.accumulate([0, *(r.length for r in pieces[:-1])]))
        total = sum(r.length for r in pieces)
        assert total <= 1024 and total & (total - 1) == 0 and {r.sequence_length for r in pieces} == {total} and len({r.step_group for r in pieces}) == 1
    steps = {}
    for pieces in by.values():
        steps[pieces[0].step_group] = steps.get(pieces[0].step_group, 0) + pieces[0].sequence_length
    assert sorted(steps) == list(range(len(steps))) and len({r.sequence_id >> 32 for r in got}) > 1
    assert all(n == packing.STEP_TOKENS for g, n in steps.items() if g < len(steps) - 1) and len(steps) > 1
    assert packing.packed_digests(none).count() == 0


def test_ids_of_unusual_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, whole = packing.tokens(path), Tokenizer.from_file(path)
    for t in ["", " ", "a  b", "a<|endoftext|>b", "漢字 ՘ ͸", "\n\n x\t", "it's  we'll ", "1234 5", "é" * 50]:
        assert np.frombuffer(ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_bpe_against_tiktoken(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces, ranks = bpe.encoder(path, public_tokenizers.PATTERN)
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    r = random.Random(2)
    some = ["a", "the", " ", "  ", "\n", "é", "ñ", "1", ".", "'s", "漢", "😀", "aaaa", "$$", "\x85", " x"]
    texts = [*("".join(r.choice(some) for _ in range(r.choice([3, 30, 300]))) for _ in range(1500)), "a" * 3000, " " * 999, "ab" * 1500, "".join(r.choice("ab") for _ in range(3000))]
    for t in texts:
        assert np.frombuffer(pieces.ids(t), "<u4").tolist() == one.encode_ordinary(t)
    a, b = list(b"hello wor"), list(b"ld, hello")
    left, right = ranks.encoded(bytes(a)), ranks.encoded(bytes(b))
    assert ranks.joined(left, right) == ranks.merged(bytes(a + b)) and ranks.joined([], right) == right
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(bytes(x.data) for x in got) == sorted((t or "").encode() for _, t, *_ in ROWS)
    again = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(x.data) for x in again) == sorted(bytes(x.data) for x in got) and bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


# --- language model


def test_masked_lm_beats_single_words(spark, none):
    r, texts = random.Random(1), []
    for _ in range(1000):  # each word is followed by its partner
        texts.append(" ".join(f"l{k} r{k}" for k in (r.randrange(20) for _ in range(60))))
    docs = spark.createDataFrame([*enumerate([*texts, None, "", "l1", prose(20000, 9)])], "doc_id long, text string").repartition(2)
    net = masked_lm.train(docs)
    got = {x.doc_id: x for x in masked_lm.scored(docs, net).collect()}
    single = np.log(1 / 40)
    assert np.mean([got[i].mean_log_prob for i in range(1000)]) > single + 0.5
    assert (got[1000].n_words, got[1000].log_prob, got[1001].mean_log_prob, got[1002].n_words, got[1003].n_words) == (0, 0.0, 0.0, 1, 20000)
    symbols = net.symbols(next(texthash.words([texts[0].encode()])))
    padded = np.pad(symbols, 2)
    brute = 0.0
    for i in range(len(symbols)):  # one word at a time, in double precision
        h = np.tanh(sum(net.near[k][padded[i + 2 + o]].astype(float) for k, o in enumerate((-2, -1, 1, 2))))
        z = h @ net.out.astype(float) + net.bias
        brute += z[symbols[i]] - np.log(np.exp(z).sum())
    assert abs(brute - got[0].log_prob) < 1e-2
    assert masked_lm.scored(none, masked_lm.train(none)).count() == 0


def test_masked_lm_scores_words_within_their_symbols(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "KNOWN", 600)  # so that some words are known and some are joined
    texts = [prose(400, 100 + i) for i in range(12)] + ["qqq", "qqq qqq unique", "", None]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    net = masked_lm.train(docs)
    assert len(net.known) and net.tail.count()
    counts = {}
    for _, t in rows:
        for w in next(texthash.words([(t or "").encode()])).tolist():
            counts[w] = counts.get(w, 0) + 1
    frequent = set(net.frequent.tolist())
    bucket = {}
    for w, n in counts.items():
        if w not in frequent:
            bucket[w % masked_lm.RARE] = bucket.get(w % masked_lm.RARE, 0) + n
    want = []
    for i, t in rows:
        w = next(texthash.words([(t or "").encode()]))
        inside = sum(np.log(counts[x] / bucket[x % masked_lm.RARE]) for x in w.tolist() if x not in frequent)
        want.append((-1 if i is None else i, len(w), net.log_prob(net.symbols(w)) + inside))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_prob) for r in masked_lm.scored(docs, net).collect())
    assert len(got) == len(want) and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 * (1 + abs(w[2])) for g, w in zip(got, sorted(want), strict=True))
    odd = masked_lm.scored(spark.createDataFrame([(0, "junkjunk")], "doc_id long, text string"), net).first()  # not counted: as if once
    h = next(texthash.words([b"junkjunk"]))
    assert abs(odd.log_prob - net.log_prob(net.symbols(h)) + np.log(bucket[int(h[0]) % masked_lm.RARE])) < 1e-6
    assert masked_lm.n_frequent(400_000) == masked_lm.FREQUENT < masked_lm.n_frequent(4_000_000) < masked_lm.n_frequent(400_000_000)


def test_masked_lm_trains_on_every_word(monkeypatch):
    seen = []

    class Trainer(masked_lm.Trainer):
        def step(self):
            seen.extend(np.concatenate([np.column_stack(x) for x in self.waiting]).tolist() if self.waiting else [])
            super().step()

    monkeypatch.setattr(masked_lm, "Trainer", Trainer)
    net = masked_lm.started([], np.zeros(masked_lm.RARE), masked_lm.FREQUENT, [np.empty(0, np.uint64), np.empty(0)])
    texts = [prose(n, n) for n in (1, 2, 5000, 700)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"])
    (out,) = masked_lm._trained(net)(iter([batch]))
    want = []
    for t in texts:
        x = net.symbols(next(texthash.words([t.encode()]))).tolist()
        y = [0, 0, *x, 0, 0]
        want += [[y[i], y[i + 1], y[i + 3], y[i + 4], w] for i, w in enumerate(x)]
    assert sorted(seen) == sorted(want) and out.column(1).to_pylist() == [len(want)] * 3


def test_masked_lm_fills_its_batches(monkeypatch):
    sizes = []

    class Trainer(masked_lm.Trainer):
        def step(self):
            sizes.append(sum(len(y) for _, y in self.waiting))
            super().step()

    nets = []
    for dense in (1 << 20, 0):
        monkeypatch.setattr(masked_lm, "DENSE", dense)
        trainer = Trainer(masked_lm.started([], np.zeros(masked_lm.RARE), masked_lm.FREQUENT, [np.empty(0, np.uint64), np.empty(0)]))
        for n in (300, 0, 100, 200, 5000, 7):
            trainer.add(np.arange(n, dtype=np.int32) * 7 % 256)
        trainer.step()
        nets.append(trainer.net)
    assert sum(sizes) == 2 * 5607 and all(n % masked_lm.BATCH == 0 for n in sizes[:-1] if n != 5607 % masked_lm.BATCH)
    assert all(np.allclose(getattr(nets[0], k), getattr(nets[1], k), atol=1e-5) for k in masked_lm.shapes(0))


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24)) * 2
    x = centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 24))
    x[500:900] = x[100]  # a third list of equal vectors: ties
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)]
    odd = [(5000, None, ""), (5100, [0.0] * 24, ""), (5200, [float("nan")] + [1.0] * 23, ""), (5300, [None] + [1.0] * 23, ""), (5400, [1.0], ""), (None, [1.0] * 24, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 10 and all(abs(s - d[v]) < 1e-12 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hit >= 0.9 * 300 and [v for v, _ in got[600]] == [100, *range(500, 509)]
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3 and ann.search(df.limit(0), F.lit(True)).count() == 0 and ann.search(df.where("vec_id >= 5000"), F.lit(True)).count() == 0


def test_repeated_rows_of_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[100].tolist()), (200, x[0].tolist()), (57, x[57].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    every = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for q, vectors in {100: [x[100]], 200: [x[200], x[0]], 300: [x[300]]}.items():
        want = []
        for v in vectors:
            d = np.sqrt(((every - v) ** 2).sum(1))
            d[ids == q] = np.inf
            want += [(k + 1, int(ids[i])) for k, i in enumerate(np.lexsort((ids, d))[:10])]
        assert len(got[q]) == len(want) and len(set(want) & {g[:2] for g in got[q]}) >= 0.7 * len(set(want))
    assert len(got[100]) == 10 and sorted(r for r, *_ in got[200]) == sorted([*range(1, 11)] * 2)


def test_neighbours_of_sparse_regions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((2000, 8)), 100 * np.eye(8)[:4] + 0.1])  # four outliers far from all others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "fitted", lambda sample, lists: np.vstack([np.zeros(8), x[2000:]]))  # a list for each outlier
    monkeypatch.setattr(ann, "probes", lambda *a: 1)
    got = ann.search(df, F.col("vec_id") >= 2000).groupBy("query_id").count().collect()
    assert {r[0]: r[1] for r in got} == dict.fromkeys(range(2000, 2004), 10)


def test_neighbours_spare_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, centres = rng.standard_normal((4096, 4)), rng.standard_normal((1000, 4))
    tracemalloc.start()
    got, some = ann.nearest(x, centres, 1), ann.nearest(x[:300], centres, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = (centres**2).sum(1) - 2 * x @ centres.T
    assert (got[:, 0] == d.argmin(1)).all() and (some == np.argsort(d[:300], 1)[:, :7]).all()
    assert peak < 60 << 20  # all distances at once take 33 MB, and as much for each of two more
    monkeypatch.setattr(ann, "SAMPLE", 2048)
    values = ", ".join(f"(xxhash64(id, {k}) % 1000) / 1000D" for k in range(16))
    df = spark.range(0, 100_000, 1, 40).selectExpr("id AS vec_id", f"array({values}) AS embedding")
    samples = []

    def fitted(sample, lists):
        samples.append(sample)
        raise InterruptedError

    monkeypatch.setattr(ann, "fitted", fitted)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "6m")  # 2048 rows of each partition are 14 MB
    try:
        with pytest.raises(InterruptedError):
            ann.search(df, F.col("vec_id") == 0)
        assert samples[0].shape == (2048, 16)
    finally:
        conf.set("spark.driver.maxResultSize", "1g")


def test_sample_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    df = spark.range(0, 6000, 1, 5).selectExpr("IF(id < 3000, 7, id) AS vec_id", "array(double(IF(id < 3000, 1, id % 50)), 2D) AS vector")
    want = df.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(1000).select("vector").collect()
    assert ann._sampled(df, 6000).tolist() == [r[0] for r in want]
    assert sorted(ann._sampled(df.limit(50), 50).tolist()) == sorted(r.vector for r in df.limit(50).collect())
    copies = df.where("vec_id = 7")
    assert ann._sampled(copies, 3000).tolist() == [[1.0, 2.0]] * 1000


def test_lists_of_neighbours_are_measured_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "CELL", 16, raising=False)  # lists of several cells
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((300, 16)), 20, 0) + 0.01 * rng.standard_normal((6000, 16))  # few of the sample's vectors have a near one there
    seen, measure = [], ann.probes
    monkeypatch.setattr(ann, "probes", lambda *a: seen.append(measure(*a)) or seen[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    x, hit = x.astype(np.float32).astype(np.float64), 0
    for g in got:
        d = np.sqrt(((x - x[g.query_id]) ** 2).sum(1))
        assert g.score == pytest.approx(d[g.vec_id], abs=1e-12)
        hit += g.score <= np.partition(d, 10)[10] + 1e-12
    assert len(got) == 600 and hit >= 0.95 * 600 and seen[0] <= 3


def test_copies_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 512, raising=False)
    rows = [((i * 7919) % 6000, [float(i % 6), 1.0, -(i % 6) / 3]) for i in range(6000)] + [(100, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    deal = ann._scanned

    def scanned(k):
        run = deal(k)

        def counted(queries, of):
            if of.num_rows > 6 * (k + 2):  # of each vector only the k + 2 smallest ids can be in a result
                raise MemoryError(of.num_rows)
            return run(queries, of)

        return counted

    monkeypatch.setattr(ann, "_scanned", scanned)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    by = {}
    for i, v in sorted(rows):
        by.setdefault(tuple(v), []).append(i)
    assert sorted(got) == list(range(0, 6000, 100))
    for q in set(got) - {100}:
        alike = next(ids for ids in by.values() if q in ids)
        assert got[q] == [(i, 0.0) for i in alike if i != q][:10]


# --- toxicity


def test_toxicity(spark, none):
    r = random.Random(6)
    bad = ["scum", "trash", "moron"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(r.randint(5, 200), i).split()
        toxic = i % 8 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), toxic))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(2000, None, ""), (2001, "", ""), (2002, "scum " * 50_000, "")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(0, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.classifier(docs, marks)
    got = {x.doc_id: x.score for x in toxicity.scored(docs, model).collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == t for i, t in held) / len(held) > 0.97
    assert got[2000] == got[2001] < 0.5 and got[2002] >= 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.not_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id >= 2000").count() == 2
    assert toxicity.classifier(docs, marks.limit(0)) is None and toxicity.not_toxic(docs, marks.where("toxic = 0")).count() == docs.count()
    assert toxicity.not_toxic(none, marks).count() == 0


def test_risk_is_the_non_negative_one_and_its_slope():
    rng = np.random.default_rng(1)
    z = rng.standard_normal(40)
    positive, drawn = np.arange(40) < 15, np.arange(40) >= 10  # five texts are both
    z += np.where(positive, 3, -3)
    for prior in (0.1, 0.9):  # with the second the bracket is negative
        loss = lambda x: np.log1p(np.exp(x))

        def bracket(z, prior=prior):
            return loss(z[drawn]).mean() - prior * loss(z[positive]).mean()

        def brute(z, prior=prior):
            return prior * loss(-z[positive]).mean() + max(0.0, bracket(z))

        value, slope = toxicity.risk(z, positive, drawn, prior)
        assert abs(value - brute(z)) < 1e-12 and (bracket(z) < 0) == (prior == 0.9)
        of = brute if bracket(z) >= 0 else lambda z: -bracket(z)
        for i in range(40):
            e = np.zeros(40)
            e[i] = 1e-6
            assert abs((of(z + e) - of(z - e)) / 2e-6 - slope[i]) < 1e-6


def test_toxic_stems_that_take_many_forms(spark):
    """No toxic word comes twice, but their beginnings do; the same rows more than once, one without id, clashing columns."""
    r = random.Random(7)
    rows = [(i, prose(60, 7000 + i) + (f" grubl{r.randrange(10**6)} grubl{r.randrange(10**6)}" if i % 6 == 0 else ""), "f") for i in range(900)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "grubl1 grubl2", "n")], "doc_id long, text string, features string")
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.classifier(docs, marks)).collect()
    assert len(got) == 902 and all((x.score >= 0.5) == ("grubl" in x.text) for x in got)


def test_beginnings_of_words():
    text = "abc abcdef ab-abcdeX ünïcode".encode()
    whole = next(texthash.words([text], texthash.NOT_WORD)).tolist()
    got = texthash.subwords(text, texthash.NOT_WORD, (5,)).tolist()
    assert got[: len(whole)] == whole and len(got) == len(whole) + 3 and got[len(whole)] == got[len(whole) + 1] != got[len(whole) + 2]
    assert not len(texthash.subwords(b"", texthash.NOT_WORD, (5,)))


# --- substring dedup


def test_repeats(spark, none):
    passage = prose(80, 50)
    texts = {1: f"{prose(60, 51)} {passage} {prose(60, 52)}", 2: f"{prose(33, 53)} {passage}\n{prose(10, 54)}", 3: prose(200, 55), 4: passage, 5: None, 6: "", 7: "y" * 5000, 8: "y" * 5000 + "z", 9: f"{prose(5, 56)} {prose(8, 51)[:20]}", 10: f"{passage} é {passage}"}
    rows = [(i, t, "a", len(t or "")) for i, t in texts.items()] + [(2, texts[2], "a", 0), (None, passage, "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, n_chars int")
    got = chunkdedup.repeats(docs).collect()
    assert {r.doc_id for r in got} == {2, 4, 8, 10}  # 7 and 8 share 5000 letters, if no words
    assert all(texts[8][r.start_byte : r.end_byte].strip("y") in ("", "z") and r.n_words > 200 for r in got if r.doc_id == 8)
    for r in (r for r in got if r.doc_id != 8):
        cut = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode().strip()
        assert cut in passage and r.n_words == len(cut.split()) >= 20 and r.kept_doc_id == 1
    out = {(r.doc_id, r._id): r for r in chunkdedup.without_repeats(docs).collect()}
    assert chunkdedup.without_repeats(docs).count() == len(rows)
    for i in (1, 3, 5, 6, 7, 9):
        assert out[i, "a"].text == texts[i]
    assert len(out[8, "a"].text) <= chunkdedup.MAX_BYTES
    assert out[None, "n"].text == passage and len(out[4, "a"].text.split()) < 40 and out[2, "a"].text.startswith(prose(33, 53)) and out[2, "a"].n_chars == len(out[2, "a"].text)
    assert chunkdedup.repeats(none).count() == 0 and chunkdedup.without_repeats(none).columns == none.columns


@pytest.mark.parametrize("parting", ["  ", " \n\n", "\n    ", "\t \r\n", " " * 5000])
def test_repeats_over_wide_white_space(spark, parting):
    def spaced(text):
        w = text.split(" ")
        return "".join(x + (parting if i % 6 == 5 or len(parting) == 2 else " ") for i, x in enumerate(w))

    def own(n, seed):  # words that no other seed gives
        return " ".join(f"{w}{seed}" for w in prose(n, seed).split(" "))

    passages = [spaced(own(55, 1000 + i)) for i in range(60)]
    rows = [(2 * i + k, f"{own(40, 2000 + 2 * i + k)}\n{p}{own(40, 3000 + 2 * i + k)}") for i, p in enumerate(passages) for k in (0, 1)]
    found = {}
    for r in chunkdedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        cut = rows[r.doc_id][1].encode()[r.start_byte : r.end_byte].decode()
        assert cut.strip() in passages[r.doc_id // 2] and r.n_words == len(cut.split()) and r.kept_doc_id == r.doc_id - 1
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_words
    assert len(found) >= 59 and sum(found.values()) / len(found) > 40


def brute_repeats(rows, min_words=20):
    """By one dictionary of whole chunks."""
    held, first = [], {}
    for i, t in rows:
        data, spans = (t or "").encode(), []
        ends = chunkdedup.chunk_ends(data).tolist() if data else []
        for s, e in zip([0, *ends], ends, strict=False):
            if data[s:e].strip(b" \t\n\x0b\x0c\r"):
                spans.append([s, e, data[s:e].strip(b" \t\n\x0b\x0c\r")])
        for x, y in itertools.pairwise(spans):
            x[1] = y[0]
        if spans:
            spans[-1][1] = len(data)
        held.append((i, spans))
        for *_, d in spans:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, spans in held:
        run = []
        for s, e, d in [*spans, (-1, -1, None)]:
            if d is not None and first[d] < i and (not run or run[-1][1] == s):
                run.append((s, e, d))
                continue
            n = sum(max(len(x.split()), len(b''.join(x.split())) // 16) for *_, x in run)
            if n >= min_words:
                out.append((i, run[0][0], run[-1][1], min(first[x] for *_, x in run)))
            run = [(s, e, d)] if d is not None and first[d] < i else []
    return sorted(out)


def test_repeats_against_one_dictionary(spark, monkeypatch):
    """Words, long words, Chinese characters, encoded data, wide white space, texts of up to 200 kB; one passage in a third of
    all rows, so with so few rows that any digest counts as frequent the broadcast owners are used too."""
    r = random.Random(12)
    kinds = [lambda n, s: prose(n, s), lambda n, s: "".join(chr(0x4E00 + random.Random(s * 7919 + i).randrange(3000)) for i in range(3 * n)), lambda n, s: "".join(random.Random(s * 104729 + i).choice("ABCDEFGHabcdefgh01234567+/") for i in range(9 * n)), lambda n, s: "\n\n ".join(prose(5, s * 31 + i) for i in range(n // 5))]
    shared = [k(r.randint(60, 200), 90 + i) for i, k in enumerate(kinds * 4)]
    rows = []
    for i in range(120):
        k = r.choice(kinds)
        text = k(r.randint(5, 150), 500 + i) + " " + (shared[0] if i % 3 == 0 else r.choice(shared)) + r.choice(["", " ", "，"]) + k(r.randint(5, 150), 900 + i)
        rows.append((i, text))
    rows += [(120, None), (121, ""), (122, prose(20000, 33) + shared[1]), (123, "漢" * 70_000), (124, "漢" * 70_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    got = sorted((x.doc_id, x.start_byte, x.end_byte, x.kept_doc_id) for x in chunkdedup.repeats(docs).collect())
    assert got == want and len({i for i, *_ in want}) > 90
    monkeypatch.setattr(chunkdedup, "max", lambda a, b: 20, raising=False)
    assert sorted((x.doc_id, x.start_byte, x.end_byte, x.kept_doc_id) for x in chunkdedup.repeats(docs).collect()) == want


@pytest.mark.parametrize("letters", ["".join(chr(0x4E00 + i) for i in range(3000)), "ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/"])
def test_chunks_without_spaces_resist_shifts(letters):
    r = random.Random(3)
    text = "".join(r.choice(letters) for _ in range(3000))
    a, b = ({int(d) for d in chunkdedup.chunks(t)[0]} for t in (text, letters[7] + text))
    assert len(a & b) > 0.9 * len(a)


def test_chunks_resist_shifts():
    text = prose(2000, 60)
    a, b = ({int(d) for d in chunkdedup.chunks(t)[0]} for t in (text, "inserted in front " + text))
    assert len(a & b) > 0.98 * len(a)
    data = ("é" * 3000).encode()
    ends = chunkdedup.chunk_ends(data)
    assert ends[-1] == len(data) and all(data[s:e].decode() for s, e in itertools.pairwise([0, *ends.tolist()]))
    h = chunkdedup.gear(np.frombuffer(b"0123456789abcdef0123456789abcdef", np.uint8))
    assert h[31] == h[15]


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    passage = prose(100, 70)
    rows = [(i, prose(80, 1000 + i) + (" scum trash moron" if i % 9 == 0 else ""), "en", "s", 0) for i in range(300)]
    rows += [(400, rows[1][1], "en", "s", 0), (401, changed(rows[2][1], 1, 3), "en", "s", 0), (402, prose(40, 71) + " " + passage, "en", "s", 0), (403, prose(40, 72) + " " + passage, "en", "s", 0), (404, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(0, 300)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids == {i for i, *_ in rows if i % 9 or i >= 400} - {400, 401} | {404}
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert tokens[403] < tokens[402] and tokens[404] == 1
    docs = common.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
