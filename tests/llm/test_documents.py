"""Operators on documents against brute force, on texts that hold nulls, ties, copies, long and odd ones."""

import collections
import hashlib
import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(2**63)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same_rows(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def key(d):
    return LOW if d is None else d


# -- line dedup ------------------------------------------------------------------------------------------------------


def test_line_dedup(docs, texts):
    from cohortspark.llm.linedup import drop_common_lines

    held = collections.defaultdict(list)
    split = [(d, (t or "").split("\n")) for d, t in texts]
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, lines in split:
        for k in {norm(x) for x in lines}:
            if len(k) >= 20:
                held[k].append(key(d))
    common = {k: max(v) for k, v in held.items() if len(v) >= 3}
    want = []
    for d, lines in split:
        stay = [x for x in lines if not (norm(x) in common and key(d) < common[norm(x)])]
        want.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    assert any(w[2] for w in want)
    out = drop_common_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    same_rows(out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), want)


def test_perfect_hash():
    import numpy as np

    from cohortspark.llm.linedup import PerfectHash

    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    mph = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(mph.index(keys).tolist()) == list(range(5000))
    assert PerfectHash.build(keys[:0]).index(keys).tolist() == [-1] * 5000


# -- piece encoding --------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(docs, texts):
    import sentencepiece

    from cohortspark.llm.pieces import default_model, encode_decode

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = []
    for d, t in texts:
        ids = sp.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    same_rows(encode_decode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)
    row = encode_decode(docs.where("doc_id = 408"), with_ids=True).first()
    assert row["token_ids"] == sp.encode(row["text"]) and row["decoded_text"] == row["text"]


def test_encoding_of_random_texts():
    import sentencepiece

    from cohortspark.llm.pieces import WordCache, default_model, load_model

    sp, model = sentencepiece.SentencePieceProcessor(model_file=default_model()), load_model(default_model())
    rng = random.Random(2)
    lists = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in ("lohe i", "ab▁ \n\té日\U0001f600\x00<0A>", "a ") for _ in range(400)]
    lists += ["x" + " " * k for k in range(50)] + [" " * k + "the" for k in range(50)] + ["a" * 2000]
    cache = WordCache(model)
    words = [model.words(t) for t in lists]
    cache.need(words)
    for t, ws in zip(lists, words):
        ids = [i for w in ws for i in cache.known[w][3]]
        assert ids == sp.encode(t), repr(t)
        assert model.decode(ids) == sp.decode(ids)


# -- decontamination -------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, texts):
    from cohortspark.llm.winnow import contamination, drop_contaminated

    rng = random.Random(9)
    long_ = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(i, " ".join(long_[i].split()[5:5 + rng.randint(8, 40)]).upper()) for i in range(12)]
    items += [(20, "two words"), (21, "two words"), (22, None), (23, ""), (24, "ONE"), (None, "na na na"), (25, "never seen words in this very order here")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(i)
    want = []
    for d, t in texts:
        w, hit, seen = word.findall((t or "").translate(LOWER)), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    seen |= windows[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        seen.discard(None)  # a missing item id marks words, but is no id
        want.append((d, len(w), len(hit), tuple(sorted(map(str, seen))), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r[0], r[1], r[2], tuple(r[3]), r[4]) for r in contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()]
    same_rows(got, want)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[4] for w in want)


# -- substring dedup -------------------------------------------------------------------------------------------------


def brute_words(texts, width):
    least = {}
    for d, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            x = tuple(w[k:k + width])
            least[x] = min(least.get(x, key(d)), key(d))
    want = []
    for d, t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < key(d):
                gone[k:k + width] = [True] * width
        want.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return want


def test_substring_dedup(docs, texts):
    from cohortspark.llm.substrings import drop_repeats

    want = brute_words(texts, 50)
    assert sum(w[2] > 0 for w in want) > 10
    same_rows(drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)


@pytest.mark.parametrize("width", [1, 9, 24])
def test_substring_dedup_of_short_windows(docs, texts, width):
    from cohortspark.llm.substrings import drop_repeats

    same_rows(drop_repeats(docs, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute_words(texts, width))


# -- suffix dedup ----------------------------------------------------------------------------------------------------


def test_suffix_sort():
    import numpy as np

    from cohortspark.llm.suffixes import sort_suffixes

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[500:800] = data[1500:1800]
    data[2000:2400] = 97
    starts = np.arange(2900)
    order, same = sort_suffixes(data, starts, 100)
    raw = data.tobytes()
    want = sorted(range(2900), key=lambda i: (raw[i:i + 100], i))
    assert order.tolist() == want
    assert same.tolist() == [False] + [raw[a:a + 100] == raw[b:b + 100] for a, b in zip(want, want[1:])]


def test_copies_are_sorted_as_one(monkeypatch):
    import numpy as np

    from cohortspark.llm import suffixes

    compared = []
    extension = suffixes.common_extension
    monkeypatch.setattr(suffixes, "common_extension", lambda prefix, a, b, limit: compared.append(len(a)) or extension(prefix, a, b, limit))
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 160, dtype=np.uint8)
    tail = rng.integers(97, 123, 40, dtype=np.uint8)
    blobs = [text] * 50 + [np.r_[text[:120], tail]] * 30
    data = np.concatenate(blobs)
    starts = (np.arange(len(blobs))[:, None] * 160 + np.arange(61)).ravel()
    order, same = suffixes.sort_suffixes(data, starts, 100)
    found = [data[s:s + 100].tobytes() for s in order]
    assert found == sorted(data[s:s + 100].tobytes() for s in starts) and sorted(order) == starts.tolist()
    assert same.tolist() == [False] + [x == y for x, y in zip(found, found[1:])]
    assert sum(compared) < len(starts)  # 61 + 40 strings to compare, each many times over
    assert [len(x) for x in suffixes.sort_suffixes(data, starts[:0], 100)] == [0, 0]


def test_grams_and_candidates_end_with_their_row():
    import numpy as np

    from cohortspark.llm.repeats import LAST, Rows

    values = np.random.default_rng(2).integers(0, 5, 400).astype(np.uint64)
    off = np.array([0, 0, 90, 92, 250, 400])
    rows = Rows(values, off, 20)
    g, inside = rows.grams(6), [at + 6 <= off[off > at][0] for at in range(395)]
    assert (g == LAST).tolist() == [not x for x in inside]
    texts = {}
    for at in np.flatnonzero(inside).tolist():
        texts.setdefault(values[at:at + 6].tobytes(), set()).add(int(g[at]))
    assert all(len(x) == 1 for x in texts.values()) and len(set.union(*texts.values())) == len(texts)
    odd = lambda h: h & 1 > 0
    low = [min(g[at:at + 15]) for at in range(381)]
    whole = [at + 20 <= off[off > at][0] for at in range(381)]
    assert rows.candidates([(6, odd)]).tolist() == [bool(w and odd(x.view(np.int64))) for w, x in zip(whole, low)]
    assert rows.candidates([(6, odd), (6, odd)]).tolist() == rows.candidates([(6, odd)]).tolist()


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(docs, texts, crowd, monkeypatch):
    from cohortspark.llm import suffixes

    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "BLOCK", 500)
    order = {r[0:2]: r[2] for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    least = {}
    for d, t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - 99):
            x, at = raw[i:i + 100], (key(d), order[(d, t)], i)
            least[x] = min(least.get(x, at), at)
    want = []
    for d, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if least[raw[i:i + 100]] < (key(d), order[(d, t)], i):
                gone[i:i + 100] = b"\1" * 100
        want.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(raw, gone) if not g))))
    assert sum(w[2] > 0 for w in want) > 10
    same_rows(suffixes.drop_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), want)


def test_classes_of_one_block_leave_as_runs(spark):
    """500 windows in three documents, one of them twice in a row: a row per run of later windows, not one per window."""
    from cohortspark.llm.common import TEXT_KEY
    from cohortspark.llm.suffixes import split_strings, suffix_classes

    rng = random.Random(6)
    text, other, third = (bytes(rng.choices(range(97, 123), k=599)) for _ in range(3))
    places = [(4, 40, 7, text, 1), (LOW, 10, 3, other, 1), (2, 20, 0, text, 1), (4, 40, 900, text, 1), (4, 40, 1400, text[500:] + other[:99], 1), (9, 90, 5, text[:250], 1)]
    split = [(2, 20, 5000, third[:160], 2), (1, 11, 0, third[:120], 2)]
    rows = [(n, d, k, at, at + len(x) - 100, bytearray(x), n, 0) for d, k, at, x, n in places + split]  # anchor 2 has two salts
    frame = spark.createDataFrame(rows, f"anchor long, doc long, {TEXT_KEY} long, first long, last long, bytes binary, salts int, salt int")
    got = suffix_classes(frame).collect()
    same_rows([(r["doc"], r[TEXT_KEY], r["at"], r["last"]) for r in got if not r["split"]], [(4, 40, 7, 506), (4, 40, 900, 1399), (9, 90, 5, 155)])
    held = [r for r in got if r["split"] and r["w1"] is not None]
    assert sorted((r["doc"], r[TEXT_KEY], r["at"], len(r["members"]) // 24) for r in held) == [(1, 11, i, 2) for i in range(21)]
    assert len({(r["w1"], r["w2"]) for r in held}) == 21 and all(r["last"] is None for r in held)
    # a split anchor's strings with one place in the block: a row per run, with two hashes for each window
    assert [(r["doc"], r[TEXT_KEY], r["at"], r["last"], len(r["members"])) for r in got if r["split"] and r["w1"] is None] == [(2, 20, 5021, 5060, 40 * 16)]
    assert split_strings(spark.createDataFrame([r for r in got if r["split"]], "w1 long, w2 long, doc long, " + TEXT_KEY + " long, at long, last long, members binary, split boolean")).count() == 61


# -- Jaccard join ----------------------------------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard_components(docs, texts, block, monkeypatch):
    from cohortspark.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    want = brute_components(texts)
    assert sum(1 for d, _, c in want if d != c) > 10
    same_rows(jaccard.near_classes(docs).select("doc_id", "n_shingles", "component_id").collect(), want)


def test_one_of_each(docs, texts):
    from cohortspark.llm.jaccard import one_of_each

    want = collections.Counter((d, t) for (d, t), (_, _, c) in zip(texts, brute_components(texts)) if c is None or c == d)
    assert collections.Counter(map(tuple, one_of_each(docs).select("doc_id", "text").collect())) == want


def test_signatures_of_linked_sets_agree():
    import numpy as np

    from cohortspark.llm.jaccard import signatures

    rng = np.random.default_rng(5)
    for n in (10, 12, 19, 40, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.uniform(0, 0.06)]
            b = np.unique(np.r_[b, rng.integers(0, 2**63, rng.integers(0, max(1, n // 20) + 1), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 19 * both >= 9 * (len(a) + len(b)):
                sig, row = signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
                assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


# -- empty tables ----------------------------------------------------------------------------------------------------


def test_empty_tables(spark, no_docs):
    from cohortspark.llm.jaccard import near_classes, one_of_each
    from cohortspark.llm.linedup import drop_common_lines
    from cohortspark.llm.pieces import encode_decode
    from cohortspark.llm.substrings import drop_repeats
    from cohortspark.llm.suffixes import drop_repeated_bytes
    from cohortspark.llm.winnow import contamination

    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (near_classes(no_docs), one_of_each(no_docs), drop_common_lines(no_docs), encode_decode(no_docs), drop_repeats(no_docs), drop_repeated_bytes(no_docs), contamination(no_docs, bench)):
        assert out.count() == 0
