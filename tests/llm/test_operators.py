"""The corpus operators against brute force on a small fixture: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, piece int, token string, _drop string"
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.1 else "") for _ in range(n))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


BASE = prose(120, 1)
PASSAGE = prose(70, 2)


def edited(text, every, seed):
    r = random.Random(seed)
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = r.choice(VOCABULARY)
    return " ".join(words)


def rows():
    texts = [None, "", " \n\t ", "one", "One", "two words", prose(60, 3), BASE, BASE, edited(BASE, 60, 5), edited(BASE, 40, 6), edited(BASE, 9, 7), BASE.upper()]
    texts += [prose(90, 20 + i) + " " + PASSAGE + " " + prose(80, 40 + i) for i in range(3)] + [prose(50, 60) + " " + edited(PASSAGE, 23, 9) + " " + prose(40, 61)]
    texts += [f"All rights reserved here.\n{prose(70, 100 + i)}\nand more {i}\n\n" for i in range(14)]
    texts += ["the the the the the the " * 12, prose(80, 70).replace(" ", " ### ") + " $$$", "Ünïcödé 日本 😀 ▁x ▁", prose(9000, 80), prose(55, 3) + " " + prose(70, 90)]
    out = [(i, t, [None, "en", "de"][i % 3], None if i == 9 else f"s{i % 12}", i, 1, 2, 3, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[7], (None, prose(60, 99), None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jaccard_truth(texts):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, [find(i) for i in range(len(sets))]


def test_fingerprints(docs, empty):
    from refrain.llm.fingerprints import PrefixHash, fingerprints, likeness, parse

    got = fingerprints(docs).collect()
    data = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for k, r in enumerate(data):
        t, nxt = r[1] or "", data[(k + 1) % len(data)][1] or ""
        m = len(t) // 3
        want[r[0], len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()] += 1
    assert collections.Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    by_id = {g.doc_id: g for g in got}
    assert by_id[7].fingerprint == by_id[8].fingerprint != by_id[9].fingerprint
    assert likeness(parse(by_id[7].fingerprint), parse(by_id[10].fingerprint)) > 0.5 > likeness(parse(by_id[7].fingerprint), parse(by_id[6].fingerprint))
    assert all(0 <= x <= 1 for g in got for x in (g.near_edited, g.near_next))
    assert fingerprints(empty).count() == 0
    a, b = PrefixHash("the cat sat"), PrefixHash("a cat sits")
    assert a.extension(3, b, 1) == len(" cat s") and a.equal(4, b, 2, 3) and not a.equal(0, b, 0, 2)


def test_quality_rules(docs, empty):
    from refrain.llm.quality_rules import verdicts

    trusted = docs.where("doc_id between 13 and 20").select("doc_id")
    got = {}
    for r in verdicts(docs, trusted).collect():
        got[r.doc_id] = r
    for doc_id, t, *_ in rows():
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = collections.Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[16].ratio > got[32].ratio and len({r.ratio for r in got.values()}) > 5
    assert verdicts(empty, trusted).count() == 0 and verdicts(docs, empty.select("doc_id")).count() == len(rows())


def ratios_by_hand(texts, trusted):
    """The log ratio of each bucket, and of each text the sum and number of its n-grams' ratios."""
    import math

    import regex

    from refrain.llm.quality_rules import BUCKETS

    def grams(t):
        h = [zlib.crc32(x.encode()) for x in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", t or "")]
        return [x % BUCKETS for x in h] + [(a * 31 + b) % BUCKETS for a, b in zip(h, h[1:])]

    raw, good = collections.Counter(), collections.Counter()
    for t, ok in zip(texts, trusted, strict=True):
        raw.update(grams(t))
        good.update(grams(t) if ok else ())
    ratio = [round(1e6 * (math.log((good[b] + 1) / (sum(good.values()) + BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + BUCKETS)))) for b in range(BUCKETS)]
    return [(sum(ratio[g] for g in grams(t)), len(grams(t))) for t in texts]


def test_quality_verdicts_against_brute_force(spark, docs):
    from refrain.llm.quality_rules import THRESHOLD, verdicts

    data = rows()
    ids = {r[0] for r in data if r[0] is not None and 13 <= r[0] <= 20}
    sums = ratios_by_hand([r[1] for r in data], [r[0] in ids for r in data])
    base = {(r.doc_id, r.n_words): r.base_failed for r in verdicts(docs, docs.where("doc_id between 13 and 20").select("doc_id")).collect()}
    want = collections.Counter()
    for r, (total, n) in zip(data, sums, strict=True):
        words = len(WORD.findall(r[1] or ""))
        want[r[0], words, not base[r[0], words] and total >= n * THRESHOLD, round(total / (n * 1e6), 9) if n else 0.0] += 1
    got = verdicts(docs, docs.where("doc_id between 13 and 20").select("doc_id")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.kept, round(r.ratio, 9)) for r in got) == want
    assert len({k for _, _, k, _ in want}) == 2


def test_likeness_estimates_the_share_of_common_spans(docs):
    from refrain.llm.fingerprints import SPAN, fingerprints

    spans = lambda t: {t[i : i + SPAN] for i in range(len(t) - SPAN + 1)} if len(t) >= SPAN else {t}
    data = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints(docs).collect()}
    far = []
    for k, r in enumerate(data):
        t, nxt = r[1] or "", data[(k + 1) % len(data)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        g = got[r[0], hashlib.sha256(edited.encode()).hexdigest()]
        for found, other in ((g.near_edited, edited), (g.near_next, nxt)):
            if t and other:
                a, b = spans(t), spans(other)
                far.append(abs(found - (1.0 if t == other else len(a & b) / len(a | b))))
            else:
                assert found == (1.0 if t == other else 0.0)
        assert g.common_start == len(os.path.commonprefix([t, edited]))
    assert max(far) < 0.25 and sum(far) / len(far) < 0.04


def test_passages(spark, docs, empty):
    from refrain.llm.substring_dedup import align, chain, passages, remove_passages

    found = passages(docs)
    pairs = {(r.doc, r.other) for r in found.collect()}
    assert {(14, 13), (8, 7), (9, 7)} <= pairs and {d for d, _ in pairs} >= {15, 16}
    assert not {d for d, _ in pairs} & {*range(7), *range(17, 31)}
    for r in found.where("doc = 14 and other = 13").collect():
        assert r.start <= 91 and r.end >= 158
    left = {r.doc_id: r.text for r in remove_passages(docs, found).collect()}
    assert PASSAGE in left[13] and PASSAGE not in left[14] and left[14].startswith(prose(90, 21)[:300]) and left[None] == prose(60, 99)
    assert remove_passages(docs, found).count() == len(rows()) and passages(empty).count() == 0
    import numpy as np

    one = np.arange(100, dtype=np.uint64)
    two = np.concatenate((one[:40], one[45:]))
    assert align(one, two, np.array([10, 60]), np.array([10, 55])) == (0, 100, 0, 95, 95)
    assert [c.tolist() for c in chain(np.array([0, 10, 20, 25]), np.array([0, 10, 20, 3]))][0] == [0, 1, 2]


def test_long_passage_hides_no_later_one():
    import numpy as np

    from refrain.llm.substring_dedup import K, chain

    first, second = np.arange(0, 300, 8), np.arange(0, 120 - K, 8)
    pos, other = np.concatenate((first, 400 + second)), np.concatenate((first, 410 + second))
    got = [c.tolist() for c in chain(pos, other)]
    assert got == [list(range(len(first))), list(range(len(first), len(pos)))]


def test_exact_passages_on_one_diagonal_come_out(spark):
    from refrain.llm.substring_dedup import passages

    one, two = prose(55, 301), prose(55, 302)
    texts = [f"{one} {prose(45, 303 + i)} {two}" for i in range(2)] + [f"{prose(30, 310 + i)} {prose(100, 312)} {prose(50, 313 + i)} {prose(60, 315)}" for i in range(2)]
    got = {(r.doc, r.start, r.end) for r in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {(1, 0, 55), (1, 100, 155), (3, 30, 130), (3, 180, 240)}
    assert all(any(doc == d and a <= start and b >= end for doc, a, b in got) for d, start, end in want)


def test_lines_that_also_occur_alone_hide_no_passage(spark):
    from refrain.llm.substring_dedup import passages

    few, many = ([prose(15, 400 + 10 * k + i) for i in range(4)] for k in range(2))
    texts = [f"{prose(30, 1000 + i)} {lines[i % 4]} {prose(30, 2000 + i)}" for lines, n in ((few, 24), (many, 200)) for i in range(n)]
    # The seeds across the ends of lines are taken as well: each two neighbours stand alone in other documents.
    texts += [f"{prose(30, 3000 + i)} {lines[i % 3]} {lines[i % 3 + 1]} {prose(30, 4000 + i)}" for lines, n in ((few, 12), (many, 120)) for i in range(n)]
    whole = [f"{prose(40, 5000 + i)} {' '.join(lines)} {prose(40, 6000 + i)}" for i in range(2) for lines in (few, many)]
    n = len(texts) // 2
    texts = [*texts[::2], *whole[:2], *texts[1::2], *whole[2:]]
    got = [(r.doc, r.start, r.end, r.other) for r in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert all(any(d == doc and o == first and a <= 40 and b >= 100 for d, a, b, o in got) for doc, first in ((len(texts) - 2, n), (len(texts) - 1, n + 1)))


def test_passage_after_a_long_one(spark):
    from refrain.llm.substring_dedup import passages, remove_passages

    one, two = prose(400, 801), prose(90, 802)
    d = spark.createDataFrame([(i, f"{prose(20, 810 + i)} {one} {prose(158, 820 + i)} {two} {prose(20, 830 + i)}") for i in range(2)], "doc_id long, text string")
    found = passages(d)
    got = [(r.start, r.end) for r in found.collect()]
    assert len(got) == 2 and all(any(a <= x and b >= y for a, b in got) for x, y in ((20, 420), (578, 668)))
    assert two not in {r.doc_id: r.text for r in remove_passages(d, found).collect()}[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_exact_run_of_fifty_words_is_found(spark, seed):
    """Documents put together from pieces, some in very many of them, against all runs of 50 words; also a periodic one."""
    from refrain.llm.substring_dedup import passages

    r = random.Random(seed)
    pool = [prose(r.randint(52, 110), 9000 + 100 * seed + i) for i in range(40)]
    texts = []
    for i in range(130):
        parts = [prose(r.randint(10, 60), 10**6 * seed + 10 * i + j) for j in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randrange(4), pool[0])
        for _ in range(r.randint(0, 2)):
            x = pool[min(39, int(r.expovariate(0.15)))].split(" ")
            cut = r.randint(0, 20)
            parts.insert(r.randrange(len(parts) + 1), " ".join(x[cut:] if r.random() < 0.5 else x[: len(x) - cut]))
        texts.append(" ".join(parts))
    texts += ["ha ho " * 60, "so ho ha " * 5 + "ha ho " * 80, texts[3], edited(texts[4], 70, 3)]
    found = collections.defaultdict(set)
    for x in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert x.other < x.doc and x.end - x.start >= 50 and x.matches >= 0.8 * max(x.end - x.start, x.other_end - x.other_start)
        found[x.doc].update(range(x.start, x.end))
    first, missed, runs = {}, 0, 0
    for i, t in enumerate(texts):
        words = t.split()
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) != i:
                runs += 1
                missed += not set(range(k, k + 50)) <= found[i]
    assert runs > 1000 and missed == 0


def repeats(a, b):
    """Brute force: whether some diagonal holds 50 words or more at identity 0.8 (a longer one holds one of 50 to 99 words)."""
    import numpy as np

    for d in range(50 - len(b), len(a) - 49):
        x, y = a[max(d, 0) :], b[max(-d, 0) :]
        same = np.concatenate(([0], np.cumsum([p == q for p, q in zip(x, y)])))
        if any((same[n:] - same[:-n] >= 0.8 * n).any() for n in range(50, min(100, len(same)))):
            return True
    return False


def test_recall_of_fuzzy_passages(spark):
    from refrain.llm.substring_dedup import passages

    texts, kinds = [], []
    for kind, (every, share) in enumerate([(5, 0), (8, 0), (10, 0), (16, 0), (0, 0.8), (0, 0.85), (0, 0.9), (0, 0.95)]):
        for i in range(25):
            r = random.Random(1000 * kind + i)
            one = prose(60, 7000 + 100 * kind + i).split(" ")
            two = list(one)
            for j in range(r.randrange(every), 60, every) if every else r.sample(range(60), round(60 * (1 - share))):
                two[j] = r.choice(VOCABULARY) + "x"
            texts += [" ".join([prose(30, r.random()), *x, prose(30, r.random())]) for x in ([one, two])]
            kinds.append(kind)
    found = {(r.doc, r.other) for r in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    true, got = collections.Counter(), collections.Counter()
    for i, kind in enumerate(kinds):
        if repeats(texts[2 * i].split(" "), texts[2 * i + 1].split(" ")):
            true[kind] += 1
            got[kind] += (2 * i + 1, 2 * i) in found
    print([(k, got[k], true[k]) for k in sorted(true)])
    assert sum(true.values()) > 170 and sum(got.values()) >= 0.98 * sum(true.values()) and all(got[k] >= 0.9 * true[k] for k in true)


def frequent_blocks():
    """Twenty documents that hold seven blocks of eight words far apart, and two that hold them in a row, one other word between each."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    blocks = [[word() for _ in range(8)] for _ in range(7)]
    rows = [(i, " ".join(w for b in rng.sample(blocks, 7) for w in [*b, *(word() for _ in range(40))])) for i in range(1, 21)]
    return rows + [(i, " ".join(w for b in blocks for w in [*b, word()])) for i in (100, 101)]


def test_passage_of_frequent_seeds_without_a_first_holder(spark):
    from refrain.llm.substring_dedup import passages

    found = [r.asDict() for r in passages(spark.createDataFrame(frequent_blocks(), "doc_id long, text string")).collect()]
    assert [(r["doc"], r["other"]) for r in found] == [(101, 100)]
    assert found[0]["start"] == 0 and found[0]["end"] >= 62 and found[0]["matches"] == 56


def holders_in_a_row(n):
    """frequent_blocks() with n documents that hold all blocks in a row."""
    rows = frequent_blocks()
    words = rows[-1][1].split()
    return rows[:20] + [(100 + i, " ".join(w if k % 9 < 8 else f"w{i}x{k}" for k, w in enumerate(words))) for i in range(n)]


def test_rest_of_frequent_seeds_makes_no_row_for_each_pair(spark, monkeypatch):
    """Every word is found, by a few partners, and no table grows with the square of the group."""
    from refrain.llm import substring_dedup as s

    made, write = collections.defaultdict(list), s.materialise

    def counted(df, name, *args, **kwargs):
        out = write(df, name, *args, **kwargs)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(s, "materialise", counted)
    for n in (30, 60):
        found = [r.asDict() for r in s.passages(spark.createDataFrame(holders_in_a_row(n), "doc_id long, text string")).collect()]
        held = collections.defaultdict(set)
        for r in found:
            assert r["other"] < r["doc"]
            held[r["doc"]].update(range(r["start"], r["end"]))
        assert all(len(held[100 + i]) >= 62 for i in range(1, n))
        assert max(collections.Counter(r["doc"] for r in found).values()) <= 8
    assert {x: v for x, v in made.items() if len(v) > 1 and v[1] > 60 and v[1] > 2.5 * v[0]} == {}


def test_stretches_of_one_word_hide_no_passage():
    import numpy as np

    from refrain.llm.substring_dedup import shared_passages

    rng = np.random.default_rng(5)
    for _ in range(20):
        parts = [[int(x)] * int(n) if n > 4 else rng.integers(1000, 2**31, 3).tolist() for x, n in zip(rng.integers(0, 5, 14), rng.integers(1, 25, 14), strict=True)]
        other = [p[: len(p) - int(len(p) > 8)] for p in parts]
        a, b = (np.array([w for p in x for w in p], np.uint32) for x in (parts, other))
        if len(a) < 80:
            continue
        got = np.zeros(len(a), bool)
        for start, end, *_ in shared_passages(a, b, np.ones(len(a), bool)):
            got[start:end] = True
        assert got.sum() >= len(a) - 4


def window_by_seeds(a, b, at, there, min_words, identity, k=4):
    """longest_window() seed by seed, on plain lists."""
    from refrain.llm.substring_dedup import _gap

    x, y = at[0], there[0]
    less = min(x, y, min_words)
    path = [(x - less + i, y - less + i, int(a[x - less + i] == b[y - less + i]), True) for i in range(less)]
    for p, o in [*zip(at, there, strict=True), (None, None)]:
        closing = p is None
        if closing:
            more = min(len(a) - x, len(b) - y, min_words)
            p, o = x + more, y + more
        step = max(x - p, y - o, 0)
        if step >= k:
            continue
        p, o = p + step, o + step
        same = p - x == o - y
        for c in range(max(p - x, o - y)):
            hit = int(a[x + c] == b[y + c]) if same else _gap(a[x:p], b[y:o]) * (c == 0)
            path.append((min(x + c, p), min(y + c, o), hit, same or c == 0))
        n = 0 if closing else min(k - step, len(a) - p, len(b) - o)
        path += [(p + i, o + i, int(a[p + i] == b[o + i]), True) for i in range(n)]
        x, y = p + n, o + n
    path.append((x, y, 0, True))
    got = [0]
    for *_, hit, _ in path[:-1]:
        got.append(got[-1] + hit)
    best = (0, 0, 0)
    for j in range(len(path)):
        starts = [i for i in range(j + 1) if path[i][3] and got[j] - got[i] >= identity * (j - i) - 1e-9]
        if path[j][3] and starts and j - starts[0] > best[0]:
            best = j - starts[0], starts[0], j
    _, i, j = best
    out = path[i][0], path[j][0], path[i][1], path[j][1], got[j] - got[i]
    return out if min(out[1] - out[0], out[3] - out[2]) >= min_words else None


def test_seeds_on_one_diagonal_are_laid_at_once():
    import sys

    import numpy as np

    from refrain.llm.substring_dedup import _scattered, chain, longest_window, shingle_hashes

    rng, seen = np.random.default_rng(3), 0
    for _ in range(60):
        a = rng.integers(0, 400, rng.integers(80, 200))
        b = [w for x in a.tolist() for r in [rng.random()] for w in ([] if r < 0.04 else [x, 7] if r < 0.08 else [9] if r < 0.16 else [x])]
        a, b = a.astype(np.uint32), np.array(b, np.uint32)
        h, g = (shingle_hashes(x.astype(np.uint64), 4) for x in (a, b))
        pos, other = np.nonzero(h[:, None] == g[None, :])
        chains = chain(pos, other)
        for c in chains + _scattered(pos, other, chains):
            if len(c) > 1:
                got = longest_window(a, b, pos[c], other[c], 50, 0.8)
                assert got == window_by_seeds(a, b, pos[c].tolist(), other[c].tolist(), 50, 0.8)
                seen += got is not None
    assert seen > 20
    # The calls don't grow with the seeds of a diagonal.
    calls = []
    for n in (100, 400):
        a, at, made = np.arange(n, dtype=np.uint32), np.arange(n - 4), []
        sys.setprofile(lambda frame, event, arg, made=made: made.append(1) if event == "c_call" else None)
        longest_window(a, a, at, at, 50, 0.8)
        sys.setprofile(None)
        calls.append(len(made))
    assert calls[1] == calls[0]


def test_open_keys_need_no_contexts_and_no_table(spark, monkeypatch):
    import pyarrow as pa

    from refrain.llm import substring_dedup as s

    batch = pa.record_batch([pa.array([3, 4]), pa.array([prose(300, 5), None])], names=["doc", "text"])
    (full,), (short,) = (list(s._each_seed([batch], n)) for n in (50, None))
    assert short[2] is None and all((x == y).all() for i, (x, y) in enumerate(zip(full, short, strict=True)) if i != 2)
    names, write = [], s.materialise
    monkeypatch.setattr(s, "materialise", lambda df, name, *args, **kwargs: names.append(name) or write(df, name, *args, **kwargs))
    s.passages(spark.createDataFrame(frequent_blocks(), "doc_id long, text string")).collect()
    assert "live" in names and "keys" not in names


def test_words_within_reach_by_distinct_words():
    import numpy as np

    from refrain.llm.substring_dedup import _within

    rng = np.random.default_rng(8)
    for size in (20, 60, 120):
        a, b = (rng.integers(0, size, n).astype(np.uint32) for n in (300, 60))
        hit, want = np.isin(a, b), np.zeros(300, bool)
        for i in range(251):
            for j in range(i + 50, 301):
                if hit[i:j].sum() >= 0.8 * (j - i) - 1e-9:
                    want[i:j] = True
        for own in (None, np.unique(a, return_inverse=True)):
            assert (_within(a, np.unique(b), 50, 0.8, own) == want).all()


def test_sentencepiece(docs, empty):
    import public_tokenizers

    from refrain.llm.sentencepiece_unigram import BYTE_SCORE, decode, encode, load

    v = load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode(docs, v)
    assert all(r.comes_back or r.ids is None for r in coded.collect())
    text = {r.doc_id: r.text for r in decode(coded, v).collect()}
    assert text == {r[0]: r[1] for r in rows()}
    assert encode(empty, v).count() == 0
    score = {p: s for _, p, s in v.pieces}
    units = ["▁" + w for w in [*VOCABULARY[:40], "Ünïcödé", "日本", "😀", "###"]]
    for unit in units:
        best = [0] + [-(10**18)] * len(unit)
        for j in range(1, len(unit) + 1):
            best[j] = max([best[i] + score[unit[i:j]] for i in range(j) if unit[i:j] in score] + [best[j - 1] + BYTE_SCORE * len(unit[j - 1].encode())])
        assert v.viterbi(unit.encode())[0] == best[-1]
    assert v.viterbi_many([u.encode() for u in units]) == [v.viterbi(u.encode())[1] for u in units]


def test_line_dedup(docs, empty):
    from refrain.llm.line_dedup import clean_lines

    got = {r[0]: r for r in clean_lines(docs, n_dropped="gone").collect()}
    assert [got[i].gone for i in range(17, 31)] == [0] + [1] * 13
    assert got[17].text == rows()[17][1] and got[18].text == rows()[18][1].split("\n", 1)[1]
    assert all(got[i].text == rows()[i][1] for i in range(17)) and got[None].text == prose(60, 99)
    assert clean_lines(docs).count() == len(rows()) and clean_lines(empty).count() == 0


def test_boilerplate_goes_from_short_pages_too(spark):
    from refrain.llm.line_dedup import clean_lines

    menu = "Home | About us | Contact | All rights reserved by the owners"
    d = spark.createDataFrame([(i, f"{menu}\nshort {i}" if i else menu, f"s{i}") for i in range(12)] + [(12, menu, "s12")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in clean_lines(d).collect()}
    assert got == {0: (menu, 0), **{i: (f"short {i}", 1) for i in range(1, 12)}, 12: ("", 1)}


@pytest.mark.parametrize("name", ["op5_line_dedup"])
def test_line_dedup_equals_sql(spark, name):
    import duckdb

    from refrain.llm import queries as Q

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(f"select doc_id, text, n_lines, n_dropped from ({Q.oracle_sql()[name]})").fetchall()
    got = Q.queries()[name](spark, data).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_sharding(docs, empty):
    from refrain.llm.sharding import shards

    got = shards(docs, levels=2).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert shards(empty).count() == 0


def test_sharding_is_even_and_keeps_equal_texts_together(spark):
    from refrain.llm.sharding import shards

    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, F.concat(F.lit("same text "), (F.col("id") % 2).cast("string"), F.repeat(F.lit(" again"), 11))).otherwise(F.concat(F.lit("t"), F.repeat(F.col("id").cast("string"), (F.col("id") % 40 + 1).cast("int")))).alias("text"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    rows = shards(many).collect()
    sizes, places = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        sizes[r.shard] += r["size"]
        places[r["size"], r.text_crc32].add(r.shard)
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values()) and all(len(x) == 1 for x in places.values())
    # A text that is larger than a shard has one; the others share the rest.
    hot = many.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "the same text in every third row " * 4).otherwise(F.col("text")))
    sizes = collections.Counter()
    for r in shards(hot).collect():
        sizes[r.shard] += r["size"]
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 16 and rest[-1] < 1.1 * rest[0] and max(sizes.values()) > 3 * rest[-1]


def test_tree_equals_brute_force(spark, monkeypatch):
    from fractions import Fraction

    from refrain.llm import sharding

    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    r = random.Random(12)
    dims = ["d_a", "d_b", "d_c"]
    for trial in range(3):
        data = [(r.randint(1, 50), r.getrandbits(32), *(r.randrange(1 << 20) if r.random() < 0.7 else 7 for _ in dims)) for _ in range(120)]
        capacity = [Fraction(r.randint(1, 9)) for _ in range(8)] if trial else [Fraction(1)] * 8
        points = spark.createDataFrame(data, "weight long, crc long, " + ", ".join(f"{d} long" for d in dims))
        tree = sharding.grow(points, dims, capacity)
        got = collections.Counter((x.weight, x.crc, x.n - 8) for x in points.withColumn("n", sharding._node(tree, 3)).collect())

        def variance(rows, i):
            w = sum(x[0] for x in rows)
            v = [(x[0], x[2 + i] >> 10) for x in rows]
            return Fraction(sum(a * b * b for a, b in v), w) - Fraction(sum(a * b for a, b in v), w) ** 2

        whole = [variance(data, i) for i in range(3)]
        want = collections.Counter()

        def split(rows, first, width):
            if not rows:
                return
            if width == 1:
                want.update((x[0], x[1], first) for x in rows)  # noqa: B023
                return
            axis = max(range(3), key=lambda i: (variance(rows, i) / whole[i], -i))  # noqa: B023
            rows = sorted(rows, key=lambda x: (x[2 + axis], x[1]))
            w = sum(x[0] for x in rows)
            goal = w * sum(capacity[first : first + width // 2]) / sum(capacity[first : first + width])  # noqa: B023
            run, cut = 0, len(rows)
            for i, x in enumerate(rows):
                if run + x[0] >= goal:
                    cut = i + 1 if run + x[0] - goal <= goal - run else i
                    break
                run += x[0]
            split(rows[:cut], first, width // 2)
            split(rows[cut:], first + width // 2, width // 2)

        split(data, 0, 8)
        assert got == want
    assert sharding.room(100, [0, 0, 0, 0]) == [25] * 4 and sharding.room(100, [70, 0, 0, 0]) == [0, 10, 10, 10] and sharding.room(100, [20, 30, 0, 0]) == [Fraction(10, 3), 0, Fraction(70, 3), Fraction(70, 3)]


def test_language_id(spark, empty):
    from refrain.llm.language_id import classify, learn

    speech = {"aa": "the and of that with this from have", "bb": "der die das und nicht mit von eine", "cc": "les des une pour dans avec est que"}
    r = random.Random(4)
    data = [(i, " ".join(r.choice(words.split()) for _ in range(40)), lang) for i in range(60) for lang, words in speech.items()]
    data += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "und nicht " * 40_000, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = classify(d, learn(d.where("doc_id % 2 = 0"), "doc_id", "text", "lang")).collect()
    assert len(got) == len(data) and all(0 <= g.score <= 1 for g in got)
    by_id = {g.doc_id: g.lang_pred for g in got}
    assert [by_id[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    truth = collections.Counter((i, lang) for i, _, lang in data[:180])
    assert sum((g.doc_id, g.lang_pred) in truth for g in got) > 170
    assert {g.lang_pred for g in classify(d, learn(empty, "doc_id", "text", "lang")).collect()} == {"und"}


def test_language_against_plain_compression(spark):
    import math

    import zstandard

    from refrain.llm.language_id import LEVEL, PIECE, classify, learn

    r = random.Random(5)
    speech = {"aa": VOCABULARY[:200], "bb": VOCABULARY[150:400], "cc": VOCABULARY[380:]}
    data = [(i % 50, " ".join(r.choice(words) for _ in range(r.choice([3, 40, 900]))), lang, "x", "y") for i in range(90) for lang, words in speech.items()]
    data += [(None, "no id here", "aa", "x", "y"), (7, "1 2 3", "aa", None, None), (8, "Mixed CASE Text 12", None, None, None), (9, "one very long text " * 9000, "dd", None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, score string, _text string")
    contents = learn(d, "doc_id", "text", "lang")
    assert set(contents) == {"aa", "bb", "cc", "dd"} and contents["dd"] == ("one very long text " * 9000).encode()
    assert all(t in {x[1].encode() for x in data} for t in contents["aa"].split(b"\n"))
    want = collections.Counter()
    for doc, text, *_ in data:
        if not re.search("[a-z]", text.lower()):
            want[doc, "und", 0.0] += 1
            continue
        raw, sizes = text.lower().encode(), {}
        for lang, c in contents.items():
            tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(tool.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE))
        best = min(sizes.values())
        want[doc, min(x for x in sizes if sizes[x] == best), round(1 / sum(math.exp(max(-700.0, -60 * (s - best) / best)) for s in sizes.values()), 9)] += 1
    got = classify(d, contents).collect()
    assert collections.Counter((g.doc_id, g.lang_pred, round(g.score, 9)) for g in got) == want


@pytest.mark.parametrize("name, right", [("op7_language_id", 0.95), ("op9_quality_classifier", 0.95)])
def test_held_out_accuracy(spark, name, right):
    from refrain.llm import queries as Q

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    found = Q.queries()[name](spark, data).where("held_out")
    if name == "op7_language_id":
        both = found.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("ok"))
    else:
        both = found.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select((F.col("quality") == F.col("predicted")).alias("ok"))
    hits = [r.ok for r in both.collect()]
    assert len(hits) > 50 and sum(hits) >= right * len(hits)


def test_trees_against_slow_rewrites():
    import math

    import numpy as np

    from refrain.llm import quality_classifier as C

    r = random.Random(31)
    x = np.array([[r.choice([0.0, 1.0, 2.5]), r.random(), r.random(), 3.0] for _ in range(300)])
    y = np.array([float(a[1] > 0.6 or a[0] == 1.0) for a in x])
    trees = C.fit(x, y)

    def walk(row):
        total = trees.base
        for t in range(len(trees.feature)):
            i = 0
            while trees.feature[t, i] >= 0:
                i = 2 * i + 1 + (row[trees.feature[t, i]] > trees.threshold[t, i])
            total += trees.value[t, i]
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    assert np.allclose(trees.score(x), [walk(a) for a in x]) and ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.98
    # The first split is the best of all features and cuts.
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + C.SMOOTH)
    best = []
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, C.BINS + 1)[1:-1], method="lower")):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= C.LEAST:
                best.append((gain(left) + gain(~left), -j, -cut))
    top = max(best)
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == (-top[1], -top[2])


def test_classifier_of_repeated_and_long_rows(spark):
    from refrain.llm.quality_classifier import scores, train

    long = "word " * 300_000
    d = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, None, "c"), (None, "short one", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    got = scores(d, train(d, labels)).collect()
    assert len(got) == 4 and len({g.score for g in got if g.doc_id == 1}) == 1 and all(0 <= g.score <= 1 for g in got)


def test_scratch_folder(spark):
    from refrain.llm.common import clear_scratch, materialise, shared_dir

    here = shared_dir(spark)
    t = materialise(spark.range(3), "t")
    assert t.count() == 3 and os.path.isdir(here.removeprefix("file:")) and spark.sparkContext.applicationId in here

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Cluster)
    clear_scratch(spark)
    assert not os.path.isdir(here.removeprefix("file:"))


def test_components_and_ranks(spark):
    from refrain.llm.common import gapless, materialise
    from refrain.llm.graph import components

    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40, 70)] + [(0, j) for j in range(1, 35)] + [(r.randrange(80, 200), r.randrange(80, 200)) for _ in range(60)] + [(5, 5), (1, 0)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    rows = materialise(spark.createDataFrame([(r.choice(["a", "b", None]), i % 50) for i in range(700)], "k string, v long"), "ranks")
    ranks = collections.defaultdict(list)
    for x in gapless(rows, ["k"], ["v"], "n", 400_000).collect():
        ranks[x.k].append(x.n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(len(v))) for k, v in ranks.items()} and sum(map(len, ranks.values())) == 700


def test_words_of_very_long_texts():
    import numpy as np
    import pyarrow as pa

    from refrain.llm import common as C

    r = random.Random(7)
    texts = [None, "", "a  b", " ".join(r.choice(VOCABULARY) for _ in range(500_000)), "x" * (5 << 20), "tail end"]
    for t, (h, starts, ends) in zip(texts, C.word_stream(pa.array(texts)), strict=True):
        words = [t.encode()[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] if t else []
        assert words == (t or "").encode().split() and len(set(zip(words, h.tolist(), strict=True))) == len(set(words))
    words = np.arange(1, 400, dtype=np.uint64)
    assert (C.run_hashes(np.concatenate((words, words)), np.array([5, 404]), 30) == C.run_hashes(words, np.array([5, 5]), 30)).all()


def test_jaccard(docs, empty):
    from refrain.llm.jaccard import similarity_components

    data = rows()
    sets, root = jaccard_truth([r[1] for r in data])
    want = collections.Counter((r[0], len(s), data[k][0]) for r, s, k in zip(data, sets, root, strict=True))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(docs).collect())
    assert got == want
    assert similarity_components(empty).count() == 0


def test_jaccard_crowds(spark, monkeypatch):
    """Many near copies that link in chains, cut into small blocks."""
    from refrain.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    texts = [edited(BASE, 60, i % 50) for i in range(40)] + [edited(prose(100, 500), 45, i) for i in range(12)] + [PASSAGE + " " + prose(20, 700 + i) for i in range(25)]
    sets, root = jaccard_truth(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(d).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


def test_jaccard_rows_without_id(spark):
    from refrain.llm.jaccard import similarity_components

    other = prose(60, 900)
    rows = [(5, BASE), (None, BASE), (None, other), (9, edited(BASE, 60, 5)), (9, BASE), (9, None)]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = [len(s) for s in jaccard_truth([t for _, t in rows])[0]]
    assert got == collections.Counter([(5, n[0], 5), (None, n[1], 5), (None, n[2], None), (9, n[3], 5), (9, n[4], 5), (9, 0, 9)])


def test_links_of_a_block_are_all_links():
    import numpy as np

    from refrain.llm import jaccard

    r = random.Random(77)
    for trial in range(30):
        base = [r.getrandbits(64) for _ in range(60)]
        sets = []
        for _ in range(40):
            kept = [x for x in base if r.random() < 0.9] + [r.getrandbits(64) for _ in range(r.randint(0, 12))]
            sets.append(np.unique(np.array(kept, np.uint64)))
        df = collections.Counter(int(x) for s in sets for x in s)
        # What the second order leaves: the rarest of the live first tokens.
        rare = []
        for s in sets:
            live = sorted((df[int(x)], int(x)) for x in s[: int(jaccard._prefix_sizes(len(s), 75))] if df[int(x)] > 1)
            small = jaccard._need(len(s), 75)
            need = max(1, (small - jaccard._need(small, 75) + 2) // 2)
            rare.append(np.array(sorted(x for _, x in live[: max(0, len(live) - need + 1)]), np.uint64))
        comp = np.array([r.randint(0, 30) for _ in sets])
        got = {tuple(x) for x in jaccard.linked_in_block(sets, rare, comp, 75).tolist()}
        both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))  # noqa: B023, E731
        assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if comp[i] != comp[j] and 100 * both(i, j) >= 75 * (len(sets[i]) + len(sets[j]) - both(i, j))}


def test_quality_classifier(spark, docs, empty):
    from refrain.llm.quality_classifier import scores, train

    r = random.Random(8)
    data = [(i, prose(r.randint(30, 90), 1000 + i).replace(" ", " ### " if i % 3 == 0 else " "), i % 3 != 0) for i in range(240)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data if i % 2] + [(0, None), (None, 1), (1, 7), (3, 0)], "doc_id long, quality int")
    got = {g.doc_id: g for g in scores(d, train(d, labels)).collect()}
    assert sum((got[i].score > 0.5) == y for i, _, y in data if i % 2 == 0) > 115
    assert got[500].score == got[501].score and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())
    nothing = train(d, labels.where("false"))
    assert {g.score for g in scores(docs, nothing).collect()} == {0.5} and scores(empty, nothing).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan_is_the_sequential_one(seed):
    from refrain.llm.packing import plan

    r = random.Random(seed)
    lengths = [r.randint(1, 64) if r.random() < 0.7 else r.choice([1, 7, 32, 64]) for _ in range(400)]
    left = collections.defaultdict(lambda: 64)
    used = collections.defaultdict(list)
    for length, rank, count, first, per, at in plan(collections.Counter(lengths), 64):
        for t in range(count):
            left[first + t // per] -= length
            used[first + t // per].append((at + t % per * length, length))
    assert sorted(left.values()) == best_fit(lengths, 64)
    for spans in used.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n


def test_packing(docs, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from refrain.llm.packing import pack
    from refrain.llm.queries import tokenizer_text

    model = tokenizer_text("word_bpe_49k.json")
    got = pack(docs, model, capacity=256).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            want[r[0], p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    assert collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = collections.defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for spans in places.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 256
    assert len(places) == len(best_fit([g.length for g in got], 256)) and pack(empty, model).count() == 0
