"""Vector codes, token alignment and language-model scores against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from conftest import prose
from test_documents import LOWER, WORD, same_rows, sha

# -- packed arrays ---------------------------------------------------------------------------------------------------


def test_packed_arrays():
    from cohortspark.llm.blocks import concat_ranges, pack, pack_many, unpack, unpack_many

    rng = np.random.default_rng(1)
    for a in (np.array([2**64 - 1, 0, 7], np.uint64), np.array([-5, 2**31 - 1], np.int32), np.zeros(0, np.int64), rng.integers(0, 255, 1000, dtype=np.uint8), np.array([-(2**63), 2**63 - 1])):
        for ascending in (False, True):
            b = unpack(pack(np.sort(a) if ascending else a, ascending))
            assert b.dtype == a.dtype and (b == (np.sort(a) if ascending else a)).all()
    assert len(pack(np.arange(10**6) * 3, True)) < 200
    x, y = unpack_many(pack_many(np.arange(5), np.array([4, 1], np.uint16), ascending=1))
    assert x.tolist() == [0, 1, 2, 3, 4] and y.tolist() == [4, 1] and unpack_many(pack_many()) == []
    assert concat_ranges([5, 1, 9], [2, 0, 3]).tolist() == [5, 6, 9, 10, 11]


# -- vector codes ----------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """[(id, label, code, error, label error)], codebooks; rows are (id, vector, label)."""
    good = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [[math.floor(x * 256) for x in v[p * len(v) // parts:(p + 1) * len(v) // parts]] for p in range(parts)]
    whole = [cut([float(x) for x in v]) for _, v, _ in good]
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[whole[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for w in whole:
                held[near(w[p], books[p])[1]].append(w[p])
            books[p] = [[sum(c) // len(c) for c in zip(*held[i])] if i in held else e for i, e in enumerate(books[p])]
    out, sums = [], collections.Counter()
    for (i, _, g), w in zip(good, whole):
        found = [near(w[p], books[p]) for p in range(parts)]
        out.append((i, g, "".join(f"{at:02x}" for _, at in found), sum(d for d, _ in found)))
        sums[g] += out[-1][3]
    return [(i, g, c, e, sums[g] if sums[g] < 2**63 else None) for i, g, c, e in out], books


@pytest.mark.parametrize("size", [1, 10**6])
def test_codes(spark, monkeypatch, size):
    from cohortspark.llm import codes

    rng = random.Random(5)
    rows = [(rng.choice([i, i, i // 2]), [rng.gauss(0, size) for _ in range(8)], rng.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [(1, None, 1), (2, [0.5] * 7 + [None], 1), (3, [float("nan")] * 8, 2), (4, [float("inf")] * 8, 2), (None, [0.25] * 8, 3)]
    rows += [(500, rows[7][1], 1)] * 40 + [(501, [0.0] * 8, i) for i in range(30)]
    df = spark.createDataFrame([(i, v, g, "x", 1, 2) for i, v, g in rows], "vec_id long, embedding array<double>, label int, c0 string, code int, _label int").repartition(5)
    want, books = brute_codes([(i, v, g) for i, v, g in rows], 4, 16, 2)
    out, got = codes.compress(df, parts=4, entries=16)
    assert out.columns == ["vec_id", "label", "c0", "_label", "code", "error", "label_error"]
    same_rows(out.select("vec_id", "label", "code", "error", "label_error").collect(), want)
    assert got == books and codes.digest(got) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert codes.reconstruct(want[0][2], got) == [x / 256 for p in range(4) for x in books[p][int(want[0][2][2 * p:2 * p + 2], 16)]]


def test_codes_of_huge_values_and_too_few_rows(spark):
    from cohortspark.llm.codes import compress

    schema = "vec_id long, embedding array<float>, label int"
    out, books = compress(spark.createDataFrame([(1, [3e38, 1.0], 1), (2, [-3e38, 1.0], 1)], schema), parts=2, rounds=0, entries=1)
    assert [(r["error"], r["label_error"]) for r in out.orderBy("vec_id").collect()] == [(0, None), (None, None)]
    out, books = compress(spark.createDataFrame([(1, None, 1)], schema))
    assert books is None and out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    out, books = compress(spark.createDataFrame([(1, [0.5] * 16, 1)], schema))
    assert [tuple(r) for r in out.collect()] == [(1, 1, "00" * 16, 0, 0)]
    for bad in ([(1, [1.0] * 5, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [], 1)]):
        with pytest.raises(ValueError):
            compress(spark.createDataFrame(bad, schema))


# -- token alignment -------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    import os

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from cohortspark.llm.align import byte_alphabet

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_alphabet()
    table_a = {i: bytes(letters[c] for c in w) for w, i in tok.get_vocab().items() if w != "<|endoftext|>"}
    table_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    docs, held = [], collections.Counter()
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        if t and not b"".join(table_a[i] for i in a) == b"".join(table_b[i] for i in b) == (" " + t).encode():
            a = b = []
        spans = []
        for ids, table in ((a, table_a), (b, table_b)):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append([(i, e - len(table[i]), e) for i, e in zip(ids, ends)])
        links, k = collections.Counter(), 0
        for x, s, e in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links[x, spans[1][m][0]] += 1
                m += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [",".join(str(i) for i, s, e in spans[0] if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in spans[1] if lo <= s and e <= hi) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 4000 else None
        docs.append((len(a), len(b), len(cuts), links, groups))
        held.update(links.keys())
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, n_g, sum(links.values()), sum(m for p, m in links.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in links.items()), None if g is None else ";".join(g))
            for n_a, n_b, n_g, links, g in docs]


@pytest.mark.parametrize("fan_in", [256, 2])
def test_alignment(spark, texts, monkeypatch, fan_in):
    from cohortspark.llm import align

    monkeypatch.setattr(align, "FAN_IN", fan_in)
    odd = ["<s> <|endoftext|> <unk> <0x0A>", "\x00 nul", "a▁b", "  two  spaces \n\n lines\t", "日本 größe \U0001f600", "it's we'll 12345"]
    rows = [(d, t) for d, t in texts if t is None or len(t) < 9000] + [(900 + i, t) for i, t in enumerate(odd)] + [(900, odd[0])] * 2
    want = brute_alignment([t for _, t in rows])
    df = spark.createDataFrame([(d, t, "en", 5, 6) for d, t in rows], "doc_id long, text string, lang string, block int, c0 int").repartition(6)
    out = align.align(df, with_groups=True)
    assert out.columns == ["doc_id", "lang", "block", "c0", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256").collect()
    same_rows(got, [(d, *w, sha(w[-1]) if w[-1] else "") for (d, _), w in zip(rows, want)])
    assert sum(w[0] == 0 for w in want) >= 4 and {r["block"] for r in out.collect()} == {5}


def test_alignment_of_long_and_no_texts(spark, no_docs):
    from cohortspark.llm.align import align

    assert align(no_docs).collect() == []
    long_ = prose(random.Random(3), 30_000) + " " + "x" * 50_000
    (want,) = brute_alignment([long_])
    (got,) = align(spark.createDataFrame([(1, long_)], "doc_id long, text string")).collect()
    assert tuple(got)[1:7] == want[:6]


def test_merging_of_runs(monkeypatch):
    from cohortspark.llm import align

    monkeypatch.setattr(align, "FRAME", 16)
    rng, total, runs = random.Random(1), collections.Counter(), []
    for _ in range(40):
        keys = sorted(rng.sample(range(3 << align.B_BITS, (3 << align.B_BITS) + 30), 9) + rng.sample(range(50 << align.B_BITS), 20))
        counts = [rng.randint(1, 9) for _ in keys]
        total.update(dict(zip(keys, counts)))
        runs += [(np.array(keys[s:s + 7]), np.array(counts[s:s + 7])) for s in range(0, len(keys), 7)]
    out = list(align.merge_runs(sorted(runs, key=lambda r: r[0][0])))
    assert len(out) > 1
    assert [k for keys, _ in out for k in keys.tolist()] == sorted(total)
    assert {k: c for keys, counts in out for k, c in zip(keys.tolist(), counts.tolist())} == dict(total)
    sides = [set((keys >> align.B_BITS).tolist()) for keys, _ in out]
    assert all(not a & b for a, b in zip(sides, sides[1:]))  # an A id leaves at once
    assert list(align.merge_runs([])) == []


# -- language model --------------------------------------------------------------------------------------------------


def brute_lm(train, texts, strength):
    words = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = ["\t", *words(t)]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(one.values()), len(one), len(train)
    level = lambda c: (3 * 2.0 ** (c.bit_length() - 1) - 1) / 2 if c else 0.0
    out = []
    for t in texts:
        w, base, full = ["\t", *words(t)], 0.0, 0.0
        for i in range(1, len(w)):
            p = (one[w[i]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            h = d if i == 1 else one[w[i - 1]]
            p = (min(level(two[w[i - 1], w[i]]), h) + strength[0] * p) / (h + strength[0])
            if i > 1:
                h = level(two[w[i - 2], w[i - 1]])
                p = (min(level(three[w[i - 2], w[i - 1], w[i]]), h) + strength[1] * p) / (h + strength[1])
            full += math.log10(min(p, 1.0))
        out.append((len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, base, full))
    return out


@pytest.mark.parametrize("shard_bytes", [16_000_000, 9_000])
def test_lm_scores(spark, texts, monkeypatch, shard_bytes):
    from cohortspark.llm import lm

    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    seen = [t for i, (_, t) in enumerate(texts) if i % 4]
    want = brute_lm(seen, [t for _, t in texts], lm.STRENGTH)
    docs = spark.createDataFrame([(i, d, t, 3, 4) for i, (d, t) in enumerate(texts)], "at int, doc_id long, text string, block int, known int").repartition(5)
    model = lm.train(docs.filter("at % 4 > 0"))
    assert (model.n_shards > 3) == (shard_bytes < 10_000) and model.shards.count() == model.n_shards
    out = lm.score(docs, model)
    assert out.columns == ["at", "doc_id", "block", "known", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    off = 0
    for r in out.collect():
        n, known, total, base, full = want[r["at"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["doc_id"]) == (n, known, total, texts[r["at"]][0])
        assert r["base_score"] == pytest.approx(base, rel=1e-12) and r["score"] <= 0
        off += abs(r["score"] - full) > 1e-9 * abs(full)
        assert abs(r["score"] - full) <= 0.05 * abs(full) + 0.5  # false positives only
    assert off < 0.3 * len(texts)


def test_lm_without_training(spark, docs, no_docs):
    from cohortspark.llm import lm

    model = lm.train(no_docs)
    assert (model.tokens, model.distinct, model.documents) == (0, 0, 0)
    rows = lm.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in rows)
    assert lm.score(no_docs, lm.train(docs)).collect() == []


def test_filter_levels():
    from cohortspark.llm import lm

    keys = np.random.default_rng(3).integers(0, 1 << 42, 20_000, dtype=np.uint64)
    counts = np.random.default_rng(4).geometric(0.3, 20_000)
    bits, data = lm.fill(keys[:10_000], counts[:10_000])
    level = lm.levels_of(counts)
    assert [int(x) for x in lm.levels_of(np.array([1, 2, 3, 4, 7, 8, 2**40 - 1, 2**40]))] == [1, 2, 2, 3, 3, 4, 40, 41]
    found = lm.probe(keys, bits, data)
    assert (found[:10_000] >= level[:10_000]).all()  # never too low
    assert (found[:10_000] > level[:10_000]).mean() < 0.01 and (found[10_000:] > 0).mean() < 0.01
    assert lm.counts_of(np.array([0.0, 1.0, 2.0, 3.0])).tolist() == [0.0, 1.0, 2.5, 5.5]
    assert re.fullmatch(r"[0-9]+", str(bits)) and lm.probe(keys[:0], bits, data).tolist() == []
