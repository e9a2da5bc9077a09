"""Each operator against brute force, on whole texts, odd rows and empty tables."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.llm import bpe, components, exchange, fingerprint, katz, langid, line_dedup, ngram_join, packing, quality, repeats, substring_dedup, suffix_dedup

WORDS, PIECES = bpe.vocabulary_path("word_bpe_49k.json"), bpe.vocabulary_path("piece_bpe_32k.model")


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(make, odd, least):
    got = line_dedup.dedup(make(odd), min_docs=least, group_bytes=3000)
    assert bag(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter(brute.line_dedup(odd, least))


def test_line_dedup_first_stays(make):
    rows = [(5, "a\nb\nA "), (3, "x\na"), (9, None), (3, "a")]
    got = line_dedup.dedup(make(rows), min_docs=2, keep="first", carry=True, group_bytes=4)
    assert Counter((r.doc_id, r.text, r.n_chars, r.blob) for r in got.collect()) in (Counter([(5, "b", 1, "c"), (3, "x\na", 3, "c"), (9, None, None, "c"), (3, "", 0, "c")]), Counter([(5, "b", 1, "c"), (3, "x", 1, "c"), (9, None, None, "c"), (3, "a", 1, "c")]))


def test_line_bitmaps(make):
    got = line_dedup.dedup(make([(1, "k\nu"), (2, "v\nk")]), min_docs=2).collect()
    bits = {r.doc_id: np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8))[: r.n_lines].tolist() for r in got}
    assert bits == {1: [0, 1], 2: [1, 0]}


@pytest.mark.parametrize("hot", [0, 48])
def test_suffix_dedup(make, odd, hot):
    got = suffix_dedup.dedup(make(odd), group_bytes=20_000, hot_groups=hot)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix_dedup(odd))


@pytest.mark.parametrize("hot", [0, 48])
def test_substring_dedup(make, odd, hot):
    got = substring_dedup.dedup(make(odd), group_bytes=20_000, hot_groups=hot)
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substring_dedup(odd))


def test_repeats_in_tiny_alphabets(make):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300)))) for i in range(30)]
    got = suffix_dedup.dedup(make(rows), min_bytes=9, anchor_bytes=5, group_bytes=500, hot_groups=3)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix_dedup(rows, 9))
    words = [(i, " ".join(t)) for i, t in rows]
    got = substring_dedup.dedup(make(words), min_words=11, anchor_words=4, group_bytes=900, hot_groups=3)
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substring_dedup(words, 11))


def test_merged_transform_equals_sorted_suffixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    shards = [suffix_dedup.transform(np.frombuffer(b"".join(part), np.uint8), np.array([len(s) for s in part])) for part in (strings[:15], strings[15:])]
    source, prefix = suffix_dedup.merge(shards, 64)
    at = [0, 0]
    suffixes = []
    for j in source.tolist():
        s, x = shards[j].string[at[j]], shards[j].offset[at[j]]
        at[j] += 1
        suffixes.append([c + 1 for c in strings[s + 15 * j][x:]])
    assert suffixes == sorted(suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        same = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert prefix[k] == same


def test_suffix_automaton_counts():
    rng = random.Random(4)
    strings = [([rng.randrange(3) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 4)) for _ in range(25)]
    automaton = substring_dedup.SuffixAutomaton()
    for s, weight in strings:
        automaton.add(s, weight)
    automaton.close()
    for size in (1, 3, 6):
        n = Counter()
        for s, weight in strings:
            for x in range(len(s) - size + 1):
                n[tuple(s[x : x + size])] += weight
        for s, _ in strings:
            assert automaton.occurrences(s, size) == [n[tuple(s[x : x + size])] for x in range(len(s) - size + 1)]


def test_segments_cover_each_window_once():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 4, n, dtype=np.uint8) for n in (0, 5, 9, 10, 200, 11)]
    s = repeats.group_segments(docs, lambda x: suffix_dedup.BYTE_TABLE[x], 10, 4)
    seen = Counter((d, x + k) for d, x, n in zip(s.doc.tolist(), s.start.tolist(), s.windows.tolist(), strict=True) for k in range(n))
    assert seen == Counter((d, x) for d, t in enumerate(docs) for x in range(len(t) - 9))


def test_long_texts_go_in_parts(monkeypatch, make):
    """Windows and anchors are the same wherever a text is cut, in parts as in one."""
    monkeypatch.setattr(repeats, "CHUNK", 64)
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 3, n, dtype=np.uint8) for n in (700, 3, 64, 63, 90, 1, 0, 129)]
    docs.append(docs[0][200:500].copy())
    s = repeats.group_segments(docs, lambda x: suffix_dedup.BYTE_TABLE[x], 12, 5)
    seen = Counter((d, x + k) for d, x, n in zip(s.doc.tolist(), s.start.tolist(), s.windows.tolist(), strict=True) for k in range(n))
    assert seen == Counter((d, x) for d, t in enumerate(docs) for x in range(len(t) - 11))
    anchors = {}
    for d, x, n, place, h in zip(s.doc.tolist(), s.start.tolist(), s.windows.tolist(), s.place.tolist(), s.anchor.tolist(), strict=True):
        for k in range(n):
            anchors.setdefault(docs[d][x + k : x + k + 12].tobytes(), set()).add((h, place - k))
    assert all(len(found) == 1 for found in anchors.values())


def test_colliding_hashes_are_told_apart_by_content():
    texts = [b"abcdef", b"abcxyz", b"abcdef", b"mnopqr"]
    entries = [repeats.Entries(np.array([7], np.uint64), np.array([9], np.uint64), np.array([3], np.uint16), np.array([1]), np.frombuffer(t, np.uint8)) for t in texts]
    segment, lead, begin, sizes, symbols, anchor, _ = repeats.collapse(entries, 4)
    assert segment[0] == segment[2] and len({*segment.tolist()}) == 3 == len(lead) == len(anchor)
    assert [symbols[begin[lead[k]] : begin[lead[k]] + sizes[lead[k]]].tobytes() for k in segment.tolist()] == texts


def test_quality(make, odd):
    got = bag(quality.apply_rules(make(odd)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for i, t in odd:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = sum(brute.covered(len(w), [x for x in range(len(w) - 2) if n[tuple(w[x : x + 3])] > 1], 3))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))] += 1
    assert got == want


def test_quality_verdict_is_the_same_in_any_order(make, rows):
    docs = make([*rows, (7000, " ".join(f"pro{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))), (7001, "### *** " * 60 + "words in plain prose " * 3), (7002, " ".join(f"zz{k} |" for k in range(70)))])
    found = quality.statistics(docs).withColumn("base_failed", quality.base_failed())
    a = found.select("doc_id", quality.verdict(quality.RULES).alias("v")).collect()
    b = found.select("doc_id", quality.verdict(quality.RULES[::-1]).alias("v")).collect()
    assert sorted(a) == sorted(b) and {r.doc_id for r in a if not r.v} >= {7001, 7002}
    hits = [[True, True, False, True]] * 3 + [[True, False, False, False]] + [[False] * 4] * 6
    assert quality.ordered(["slow", "quick", "never", "again"], [2.0, 0.1, 0.01, 0.2], hits) == ["quick", "slow", "never", "again"]  # behind "quick", "again" rejects nothing
    kept = {r.doc_id for r in quality.apply_rules(docs).where("kept").collect()}
    assert 7000 in kept and not kept & {7001, 7002, 1001, 1002}


def test_bpe(make, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(t.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert bag(bpe.encode_decode(make(odd), WORDS, chunk_bits=4), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_characters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rng = random.Random(8)
    chunks = bpe.ChunkEncoder(bpe.Encoder(WORDS), 3)
    letters = "aA zZ\n\t éÉß'sſİıΣσς<|endoftext|>1２三4!?…́ \x85\x1c日本 don't WE'LL ½ª­_-"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        ids, decoded = chunks.encode(text.encode(), bpe.cuts(np.frombuffer(text.encode(), np.uint8), 3))
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_packing(make, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(make(odd), WORDS, capacity=256, group_rows=30).collect()
    want = Counter()
    for i, text in odd:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 256) + 3


def test_local_search_raises_squared_fill_and_loses_nothing():
    rng = random.Random(6)
    for _ in range(20):
        sizes = [rng.randrange(1, 90) for _ in range(120)]
        bins = [[i, i + 1] if sizes[i] + sizes[i + 1] <= 100 else [i] for i in range(0, 120, 2)]
        held = {i for b in bins for i in b}
        bins += [[i] for i in range(120) if i not in held]
        fill = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
        before, n = fill(bins), len(bins)
        after = packing.local_search(sizes, [list(b) for b in bins], 100)
        assert sorted(i for b in after for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 100 for b in after)
        assert fill(after) > before and len(after) < n


def test_language(make):
    rng = random.Random(1)
    kinds = {"aa": ["stone", "river", "water", "light", "north", "winter"], "bb": ["piedra", "rio", "agua", "luz", "norte", "invierno"]}
    pairs, langs = [], {}
    for i in range(300):
        lang = rng.choice(list(kinds))
        pairs.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(12))))
        langs[i] = lang
    pairs += [(900, None), (901, ""), (902, "123 !?"), (903, "ß" * 500), (None, "stone river")]
    langs |= {900: None, 901: None, 902: "aa", 903: None, None: "bb"}
    docs = make(pairs, langs)
    model = langid.fit(docs, PIECES, per_language=40)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(pairs)
    assert all(got[i].held_out == (brute.fold(i, 5) == 0) and 0 <= got[i].score <= 1 for i, _ in pairs)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in kinds
    assert all(got[i].lang_pred == langs[i] for i in range(300) if got[i].held_out)
    assert langid.keep_certain(docs, model, 0.5).where("doc_id in (900, 901, 902)").isEmpty()
    nothing = langid.fit(docs.limit(0), PIECES)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    index, longest = langid.vocabulary(PIECES)
    p = np.random.default_rng(0).random((len(index) + 1, 2)) / 10
    scorer = langid.Scorer(langid.Model(PIECES, ["a", "b"], p))

    def total(run, k):
        if not run:
            return 1.0
        return sum(p[index[run[:j]], k] * total(run[j:], k) if run[:j] in index else p[0, k] * total(run[1:], k) if j == 1 else 0.0 for j in range(1, min(longest, len(run)) + 1))

    runs = langid.runs_of("Winter rivière ßq")
    scorer.learn(runs)
    for r in runs:
        assert np.allclose(np.exp(scorer.score([r])), [total(r, 0), total(r, 1)])


def test_ngram_join(make, odd):
    assert bag(ngram_join.join(make(odd), group_bytes=20_000), "doc_id", "n_shingles", "component_id") == Counter(brute.ngram_join(odd))


def test_ngram_join_of_a_large_group_of_near_copies(make):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(160)] = f"c{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    long = [f"v{k}" for k in range(300)]
    rows += [(200 + i, " ".join(x if k != 7 * i else f"d{i}" for k, x in enumerate(long))) for i in range(40)]
    short = [f"s{k}" for k in range(44)]
    rows += [(400 + i, " ".join([f"e{rng.randrange(99)}"] * (i % 3) + short[i % 3 : 44 - i % 4] + [f"f{rng.randrange(99)}"] * (i % 4))) for i in range(60)]
    rows += [(300 + i, " ".join(base[:80]) + " " + " ".join(f"u{i}-{k}" for k in range(60))) for i in range(40)]
    assert bag(ngram_join.join(make(rows), group_bytes=8000), "doc_id", "n_shingles", "component_id") == Counter(brute.ngram_join(rows))


@pytest.mark.parametrize(("percent", "shared", "more"), [(60, 43, 27), (70, 44, 17)])
def test_ngram_join_of_long_and_short_sets_at_lower_percent(make, percent, shared, more):
    base = " ".join(f"w{k}" for k in range(shared + 4))
    rows = [(i, f"{base} e{i}") for i in range(40)] + [(100, base + "".join(f" x{k}" for k in range(more)))]
    want = Counter(brute.ngram_join(rows, percent))
    assert {c for _, _, c in want} == {0}
    assert bag(ngram_join.join(make(rows), percent=percent, group_bytes=8000), "doc_id", "n_shingles", "component_id") == want


def test_extended_prefixes_hold_a_close_pair_of_common_tokens():
    for percent in (51, 60, 80, 90):
        g = ngram_join.gap(percent)
        for n in (3, 7, 20, 61, 146, 400):
            for m in range(-(-percent * n // 100), 100 * n // percent + 1):
                o = ngram_join.common(n + m, percent)
                k = (n + m - 2 * o) // (g + 1) + 2
                assert ngram_join.extended(n, percent) >= min(n, n - o + k)
                assert k <= o or n + m == 2 * o  # equal sets are joined by their hash
    rng = random.Random(8)
    for _ in range(300):  # both sets in one order of tokens, common ones scattered
        n, percent = rng.randrange(6, 200), rng.choice([60, 80, 95])
        o = ngram_join.common(2 * n, percent)
        if o >= n:
            continue
        flags = [[1] * o + [0] * (n - o) for _ in range(2)]
        [rng.shuffle(f) for f in flags]
        keys = []
        for f in flags:
            number = np.cumsum(f)
            tokens = [int(number[i]) if f[i] else None for i in range(ngram_join.extended(n, percent))]
            keys.append({(tokens[i], tokens[i + d]) for d in range(1, ngram_join.gap(percent) + 2) for i in range(len(tokens) - d) if tokens[i] and tokens[i + d]})
        assert keys[0] & keys[1]


def test_representatives(make):
    text = "one two three four five six seven eight nine ten"
    other = "other words that stand alone in this small table"
    docs = make([(4, text), (2, text), (7, other), (7, other), (7, "rows may share an id and differ in their text"), (9, None), (None, text), (None, "words of a row that has no id"), (None, "words of a row that has no id"), (None, None)])
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    want = [(2, text), (7, other), (7, "rows may share an id and differ in their text"), (9, None), (None, None), (None, "words of a row that has no id")]
    assert bag(kept, "doc_id", "text") == Counter(want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints(make, odd):
    got = fingerprint.compare(make(odd)).collect()
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want[(i, len(t), brute.sha((t[: len(t) - q] + following[:q]).encode()))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    texts = defaultdict(set)
    for i, t in odd:
        texts[i].add(t or "")
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.fingerprint != r.edited_fingerprint or r.near_edited == 1)
        if len(texts[r.doc_id]) == 1:
            assert prints.setdefault(next(iter(texts[r.doc_id])), r.fingerprint) == r.fingerprint


def test_fingerprints_are_context_free(make):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    a, b, c = " ".join(words), "a new opening " + " ".join(words), " ".join(f"z{k}" for k in range(400))
    docs = make([(1, a), (2, b), (3, c)])
    prints = docs.select("doc_id", fingerprint.anchors(F.col("text")).alias("p"))
    pairs = prints.alias("x").join(prints.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select("x.doc_id", "y.doc_id", fingerprint.likeness(F.col("x.p"), F.col("y.p")))
    got = {(r[0], r[1]): r[2] for r in pairs.collect()}
    assert got[1, 2] > 0.9 and got[1, 3] == got[2, 3] == 0


def test_fingerprints_keep_all_anchors_in_order(make):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**4)}" for _ in range(3000)]
    other = [f"x{rng.randrange(10**4)}" for _ in range(40)]
    texts = [words, words[:1500] + other + words[1540:], words[1500:] + words[:1500]]
    docs = make([(k, " ".join(t)) for k, t in enumerate(texts)])
    prints = {r.doc_id: r.p for r in docs.select("doc_id", fingerprint.anchors(F.col("text")).alias("p")).collect()}
    assert len(prints[0]) > 1200 and prints[0] != prints[1] and prints[0][:500] == prints[1][:500]
    moved = Counter(prints[0]) & Counter(prints[2])
    assert sum(moved.values()) > 0.98 * len(prints[0])
    x, y = docs.select("doc_id", fingerprint.anchors(F.col("text")).alias("p")).alias("x"), docs.select("doc_id", fingerprint.anchors(F.col("text")).alias("p")).alias("y")
    pairs = x.join(y, F.col("x.doc_id") < F.col("y.doc_id")).select("x.doc_id", "y.doc_id", fingerprint.likeness(F.col("x.p"), F.col("y.p")))
    got = {(r[0], r[1]): r[2] for r in pairs.collect()}
    assert 0.95 < got[0, 1] < 1 and 0.3 < got[0, 2] < 0.36  # half of each matches in one order: n / 2 of 3 n / 2


def test_likeness_counts_matches_in_one_order(spark):
    def matches(a, b):
        n = 0
        while a and b and a[0] == b[0]:
            a, b, n = a[1:], b[1:], n + 1
        while a and b and a[-1] == b[-1]:
            a, b, n = a[:-1], b[:-1], n + 1
        numbered = lambda x: [(e, x[:i].count(e)) for i, e in enumerate(x)]
        a, b = numbered(a), numbered(b)
        best = [0] * (len(b) + 1)
        for e in a:
            row = [0]
            for j, f in enumerate(b):
                row.append(best[j] + 1 if e == f else max(best[j + 1], row[j]))
            best = row
        return n + best[-1]

    rng = random.Random(8)
    top = (1 << 32) - 1
    rows = [([], []), ([], [top]), ([top, 0, 5], [0, 5, top])]
    for _ in range(150):
        values = [rng.randrange(top) for _ in range(rng.choice([2, 5, 40]))]
        a = [rng.choice(values) for _ in range(rng.randrange(40))]
        b = list(a) if rng.random() < 0.6 else [rng.choice(values) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            i, j = sorted(rng.randrange(len(b) + 1) for _ in range(2))
            b = b[j:] + b[i:j] + b[:i]
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", fingerprint.likeness(F.col("a"), F.col("b"))).collect()
    assert len(got) == len(rows)
    for a, b, like in got:
        n = matches(a, b)
        assert like == (n / (len(a) + len(b) - n) if a or b else 1)


def katz_model(rows):
    uni, bi = Counter(), defaultdict(Counter)
    for i, t in rows:
        w = ["<s>", *[x.decode() for x in (t or "").encode().lower().split()], "</s>"]
        if brute.fold(i, 7) != 2:
            uni.update(w[1:])
            for a, b in zip(w, w[1:], strict=False):
                bi[a][b] += 1
    n = sum(uni.values())
    du, db = (katz.discounts(katz.counts_of_counts(np.array(c))) for c in (list(uni.values()), [v for c in bi.values() for v in c.values()]))
    d = lambda f, c: f[c] if c <= katz.CUT else 1.0
    p = {w: d(du, c) * c / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    context = {}
    for a, c in bi.items():
        whole = sum(c.values())
        mass = sum(d(db, v) * v for v in c.values())
        s = whole / (whole + 1) if mass >= whole else 1.0
        context[a] = (s / whole, (1 - mass * s / whole) / (1 - sum(p[b] for b in c)))

    def prob(a, b):
        if c := bi[a][b] if a in bi else 0:
            return d(db, c) * c * context[a][0]
        return (context[a][1] if a in context else 1.0) * p.get(b, unknown)

    return uni, bi, n, prob


def test_katz(make, odd):
    uni, bi, n, prob = katz_model(odd)
    for a in [*list(bi)[:40], "never seen"]:
        assert math.isclose(sum(prob(a, b) for b in uni) + prob(a, "never seen either"), 1.0, rel_tol=1e-9)
    got = defaultdict(list)
    for r in katz.score(make(odd), group_bytes=9000).collect():
        got[r.doc_id].append(r)
    for i, t in odd:
        w = ["<s>", *[x.decode() for x in (t or "").encode().lower().split()], "</s>"]
        want = sum(math.log10(prob(a, b)) for a, b in zip(w, w[1:], strict=False))
        base = sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w[1:])
        assert any(math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9) and (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.fold(i, 7) == 2, len(w) - 1, sum(x in uni for x in w[1:]), n) for r in got[i])


def test_katz_without_training_tokens(make):
    i = next(i for i in range(100) if brute.fold(i, 7) == 2)
    r = katz.score(make([(i, "some words")])).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.score == 0.0


@pytest.mark.parametrize(
    "operator",
    [
        line_dedup.dedup, suffix_dedup.dedup, substring_dedup.dedup, quality.apply_rules, ngram_join.join, ngram_join.representatives, fingerprint.compare, fingerprint.fingerprints, katz.score,
        lambda d: bpe.encode_decode(d, WORDS), lambda d: packing.pack_documents(d, WORDS), lambda d: langid.predict(d, langid.fit(d, PIECES)),
    ],
)
def test_empty_tables(make, operator):
    assert operator(make([])).count() == 0


@pytest.mark.parametrize("operator", [line_dedup.dedup, suffix_dedup.dedup, substring_dedup.dedup])
def test_carried_columns(make, rows, operator):
    docs = make([(i, t) for i, t in rows])
    got = operator(docs, carry=True, group_bytes=20_000)
    assert got.schema == docs.schema and got.count() == docs.count()
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or r.n_chars == len(r.text)) and (r.grp, r.blob, r.place) == (1, "c", "f") for r in got.collect())


def test_packed_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()
    assert sum(s.stop - s.start for _, s in exchange.by_bucket(keys, 7)) == len(keys) and not list(exchange.by_bucket(keys[:0], 7))


def test_blobs_come_back_and_small_ones_weigh_little():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 9, (3, 4)).astype(t) for t in ("u1", "u2", "u4", "u8", "i4", "i8", "f8", "?")] + [-5, b"raw" * 99, "Text é", [b"", [1, np.empty(0, np.uint64)]]]
    back = exchange.unpack(exchange.pack(*items))
    assert len(back) == len(items)
    for x, y in zip(items[:8], back, strict=False):
        assert x.dtype == y.dtype and (x == y).all()
    assert back[8:11] == items[8:11] and back[11][0] == b"" and back[11][1][0] == 1 and len(back[11][1][1]) == 0
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    keys.sort()
    for buckets in (10, 100_000):  # at the worst each key travels alone, and costs what a row would
        sent = sum(len(exchange.pack(exchange.pack_sorted(keys[s]), np.ones(s.stop - s.start, np.uint32))) for _, s in exchange.by_bucket(keys, buckets))
        assert sent <= 24 * len(keys)


def test_anchors_are_dealt_evenly():
    rng = random.Random(8)
    texts = [np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(20_000)), np.uint8) for _ in range(10)]
    s = repeats.group_segments(texts, lambda t: suffix_dedup.BYTE_TABLE[t], 50, 34)
    held = np.bincount(exchange.bucket_of(s.anchor, 16), minlength=16)
    assert held.max() < 1.2 * held.mean()
    assert repeats.bucket_count(4000) == 1000


def test_large_batches_have_more_shards(monkeypatch):
    rng = random.Random(9)
    own = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 20))) for _ in range(60)]
    entries = [
        repeats.Entries(np.full(30, 7, np.uint64), np.arange(a, a + 30, dtype=np.uint64), np.array([len(x) - 7 for x in own[a : a + 30]]), np.array(range(a, a + 30)), np.frombuffer(b"".join(own[a : a + 30]), np.uint8))
        for a in (0, 30)
    ]
    seen = []
    monkeypatch.setattr(suffix_dedup, "SHARD", 100)
    monkeypatch.setattr(suffix_dedup, "merge", lambda shards, depth, f=suffix_dedup.merge: (seen.append(len(shards)), f(shards, depth))[1])
    got = np.concatenate(suffix_dedup.decide(entries, 8)).tolist()
    least = {}
    for k, x in enumerate(own):
        for i in range(len(x) - 7):
            least.setdefault(x[i : i + 8], k)
    assert got == [least[x[i : i + 8]] < k for k, x in enumerate(own) for i in range(len(x) - 7)]
    assert seen == [-(-sum(map(len, own)) // 100)]


@pytest.mark.parametrize(
    ("sizes", "bins", "capacity", "full"),
    [
        ([1, 2, 3, 4, 5, 6, 30, 32], [[0, 1, 2, 3, 4, 5, 6], [7]], 52, [2, 3, 4, 5, 6, 32]),  # 1 and 30, far from one another in size, for 32
        ([15, 15, 9, 31], [[0, 1, 2], [3]], 40, [9, 31]),  # two of one size
        ([10, 20, 11, 19], [[0, 1], [2, 3]], 31, [11, 20]),  # bins of equal fill
    ],
)
def test_search_tries_all_partners(sizes, bins, capacity, full):
    got = packing.local_search(sizes, [list(b) for b in bins], capacity)
    assert sum(map(len, got)) == len(sizes)
    assert full in [sorted(sizes[i] for i in b) for b in got]


def test_search_leaves_no_exchange():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([20, 50, 200])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
        bins = []
        for i in range(len(sizes)):  # first fit in any order, so that the search has work
            b = next((b for b in bins if sum(sizes[j] for j in b) + sizes[i] <= capacity), None)
            b.append(i) if b else bins.append([i])
        got = packing.local_search(sizes, bins, capacity)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        fill = [sum(sizes[i] for i in b) for b in got]
        assert max(fill) <= capacity
        for b, donor in ((b, d) for b in range(len(got)) for d in range(len(got)) if (fill[d], d) < (fill[b], b)):
            given = [0, *[sizes[i] for i in got[b]], *[sizes[i] + sizes[j] for i in got[b] for j in got[b] if i < j]]
            assert not any(0 < sizes[i] - g <= capacity - fill[b] for i in got[donor] for g in given)
