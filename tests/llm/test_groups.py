"""Operators over the whole table: line dedup, sharding, search, mixing, Jaccard join, pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import components, jaccard, linededup, links, mixing, search, sharding
from quillspark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows: list[tuple]) -> Counter:
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low: dict = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(low[find(i)], default=None)) for i, r in enumerate(rows))


def brute_links(rows: list[tuple]) -> Counter:
    """doc_id, size, and the other sets and rows that each row links with."""
    sets = [shingles(r[1]) for r in rows]
    copies = Counter(s for s in sets if s)
    near = {a: [b for b in copies if b != a and 100 * len(a & b) >= 75 * len(a | b)] for a in copies}
    return Counter((r[0], len(s), len(near.get(s, [])), sum(copies[b] for b in near.get(s, [])) + max(copies[s] - 1, 0)) for r, s in zip(rows, sets, strict=True))


def check_links(docs, rows: list[tuple]) -> None:
    found = jaccard.similar_links(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["links"], r["linked_rows"]) for r in found) == brute_links(rows)


#: All links inside families, as everything looks alike; all across them, as nothing does; blocks,
#: groups, pools of tokens and ranges of hashes of few each; ids shuffled and groups asked in parts.
WAYS = {
    "as it is": {},
    "inside": {"ALIKE": 0, "MEET": 24},
    "across": {"ALIKE": 25},
    "small blocks": {"ALIKE": 0, "MEET": 24, "MEMBERS": 3},
    "near a core": {"ALIKE": 0, "MEET": 24, "MEMBERS": 3, "CORE": 2, "WIDE": 4, "FEW_IDS": 0},
    "few tokens": {"ALIKE": 4, "TOKENS": 500},
    "small pools": {"COUNTED": 200, "RANGE": 100},
    "shuffled": {"ALIKE": 25, "FEW_IDS": 0, "ASKING": 2, "GROUP": 2},
}


@pytest.mark.parametrize("way", WAYS)
def test_links(odd, rows, monkeypatch, way):
    """Every link is counted, inside groups of near copies and chains of them, whatever the way."""
    for name, value in WAYS[way].items():
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(links, "GROUP", 2)
    base = [f"v{i}" for i in range(60)]
    chain = [(400 + i, " ".join([*base[3 * i :], *(f"u{k}" for k in range(3 * i))]), "en", "chain", 1) for i in range(12)]
    # Most of each is a passage that all of these share, and none is like another.
    hot = [(500 + i, " ".join([*(f"h{k}" for k in range(40)), *(f"own{i}x{k}" for k in range(8 + i))]), "en", "hot", 1) for i in range(12)]
    more = [*chain, *chain[3:5], *hot]
    docs = odd.unionByName(odd.sparkSession.createDataFrame(more, odd.schema))
    assert max(n for _, _, n, _ in brute_links([*rows, *more])) > 10
    check_links(docs, [*rows, *more])


@pytest.mark.parametrize("way", ["as it is", "across"])
def test_links_documents(spark, monkeypatch, way):
    for name, value in WAYS[way].items():
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_links(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_family(spark, monkeypatch):
    """Near copies of two texts, some nearer to a core than others; halves that hold both."""
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    monkeypatch.setattr(jaccard, "WIDE", 32)
    rng = random.Random(8)
    one, two = ([f"{c}{i}" for i in range(150)] for c in "ab")
    texts = []
    for k in range(160):
        words = list(one if k % 3 else two)
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", f"own{k}"])
        texts.append(words[: len(words) - rng.randrange(12)])
    texts += [one[:75] + two[75:], one[:110] + two[110:], one + two[:20]]
    docs = [(i, " ".join(words)) for i, words in enumerate([*texts, *texts[:5]])]
    check_links(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_links_none(spark, none):
    assert jaccard.similar_links(none).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "A b c d e f g")], "doc_id long, text string")
    check_links(unnamed, [(r["doc_id"], r["text"]) for r in unnamed.collect()])


def test_block():
    """Opened groups hold every set that links, and near() is exact."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 90), replace=False), rng.integers(0, 1 << 40, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(150)]
    sets += [s[: len(s) - 2] for s in sets[:40] if len(s) > 20]
    block = links.Block(sets)
    for s in sets:
        want = [j for j, t in enumerate(sets) if 100 * (c := len(np.intersect1d(s, t))) >= 75 * (len(s) + len(t) - c)]
        assert block.near(s).tolist() == want
    # By what differs from a core: those that the core alone does not link.
    for core in (np.unique(base), np.unique(base[:50]), np.zeros(0, np.uint64)):
        given, lost = [np.setxor1d(s, core) for s in sets], np.array([len(np.setdiff1d(core, s)) for s in sets])
        held = [i for i, g in enumerate(given) if len(g)]
        block = links.Block([given[i] for i in held], np.array([len(sets[i]) for i in held]), lost[held], len(core))
        for i in held:
            sure = [links.apart(len(sets[i]), lost[i]) + links.apart(len(sets[j]), lost[j]) <= links.limit(len(core)) for j in held]
            common = [len(np.intersect1d(sets[i], sets[j])) for j in held]
            linked = [100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c) for j, c in zip(held, common, strict=True)]
            assert not any(s and not k for s, k in zip(sure, linked, strict=True))
            near = block.near(given[i], len(sets[i]), lost[i]).tolist()
            assert near == [k for k, (s, l) in enumerate(zip(sure, linked, strict=True)) if l and not s]


def test_one_of_each(odd, rows):
    kept = jaccard.one_of_each(odd).collect()
    comps = brute_components(rows)
    linked = {c for (_, n, c), _ in comps.items() if n}
    assert len([r for r in kept if not shingles(r["text"])]) == len([r for r in rows if not shingles(r[1])])
    left = [(r["doc_id"], shingles(r["text"])) for r in kept if shingles(r["text"])]
    for i, (_, a) in enumerate(left):
        assert not any(100 * len(a & b) >= 75 * len(a | b) for _, b in left[:i])
    assert {d for d, _ in left} == linked


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 201), (201, 203)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 201: 201, 203: 201, 205: 201}


#: Texts to the hashes that order those of one id.
HASHES: dict = {}


def brute_lines(rows: list[tuple], least: int = 1) -> dict:
    """(doc_id, text) -> places of lines that go. Every document is aligned with every earlier text
    that shares a line with it, over all lines of both."""
    out, earlier = {}, []
    for d, t in sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, HASHES[r[1]])):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        mine = [lines[i] for i in full]
        go: set = set()
        if any(t == x for x, _ in earlier):
            go = set(full)
        else:
            for _, theirs in earlier:
                if not set(theirs) & set(mine):
                    continue
                block: list = []
                for j in [*(j for _, j in brute_patience(theirs, mine)), None]:
                    if block and (j is None or j > block[-1] + 1):
                        if sum(len(WORD.findall(mine[k])) for k in block) >= least:
                            go |= {full[k] for k in block}
                        block = []
                    block.append(j)
            earlier.append((t, mine))
        if go and go == set(full):
            go = set(range(len(lines)))
        for i, x in enumerate(lines):
            before, after = [k for k in full if k < i], [k for k in full if k > i]
            if i not in full and before and after and before[-1] in go and after[0] in go:
                go.add(i)
        out[d, t] = sorted(go)
    return out


def brute_patience(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff by its definition, recursively, with a quadratic longest increasing run; of
    equally long ones, from the end on, the one with the earliest place in a."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in brute_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*brute_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [x for x in b if a.count(x) == b.count(x) == 1]
    if once:
        pairs = [(a.index(x), b.index(x)) for x in once]
    else:  # no unique line: the k-th of each in one with the k-th in the other
        places = lambda s, x: [i for i, y in enumerate(s) if y == x]
        pairs = sorted((p for x in set(b) for p in zip(places(a, x), places(b, x))), key=lambda p: p[1])
    best: list = []
    rank = lambda chain: (len(chain), -chain[-1][0])
    for k, p in enumerate(pairs):
        best.append(max((best[m] for m in range(k) if pairs[m][0] < p[0]), key=rank, default=[]) + [p])
    chain = max(best, key=rank, default=[])
    if not once:
        return chain
    out, ends = [], [(-1, -1), *chain, (len(a), len(b))]
    for (i, j), (k, m) in zip(ends, ends[1:]):
        out += [(i + 1 + x, j + 1 + y) for x, y in brute_patience(a[i + 1 : k], b[j + 1 : m])]
        out += [(k, m)] if k < len(a) else []
    return out


def check_lines(docs, rows: list[tuple], least: int = 1) -> dict:
    HASHES.update({r["text"]: (r["t1"], r["t2"]) for r in docs.filter("text is not null").select("text", *linededup._hashes()).distinct().collect()})
    want = brute_lines(rows, least)
    got = linededup.dedup_lines(docs, least).collect()
    assert len(got) == len(rows)
    left: Counter = Counter()
    for r in got:
        left[r["doc_id"], r["text"], r["n_lines"], tuple(r["removed"]), r["removed_words"]] += 1
    expected: Counter = Counter()
    for d, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        gone = want[d, t] if t is not None else []
        rest = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in set(gone))
        expected[d, rest, len(lines), tuple(gone), sum(len(WORD.findall(lines[i])) for i in gone)] += 1
    assert left == expected
    return want


@pytest.mark.parametrize("least", [1, 4, 25])
def test_lines(odd, none, rows, least):
    check_lines(odd.withColumn("removed", F.lit(1)), rows, least)
    by_id = {r["doc_id"]: r for r in linededup.dedup_lines(odd, least).collect()}
    assert by_id[9]["text"] == "" and by_id[8]["removed"] == [] and by_id[6]["removed"] == []
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("least", [1, 12])
def test_lines_documents(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = check_lines(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], least)
    assert sum(map(len, want.values())) > 100


def test_short_lines(spark):
    """Aligned lines go however short they are; order decides, and how often a line stands there."""
    rows = [
        (1, "a b c\nd e\nf"), (2, "f\nown words\nd e"), (3, "x y\n\na b c\n\nf\nz"), (4, "f"), (5, "z\nf"), (6, "nothing shared"),
        (7, "f\nd e\na b c"), (8, "\na b c\n\nd e\nf\n"), (9, "a b c\na b c\nf"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(docs, rows)
    text = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert text[1] == rows[0][1] and text[6] == "nothing shared" and text[4] == text[8] == ""
    # 5 has two lines of 3 in another order: the pair aligns one, and no other earlier text has z.
    # 1 aligns the first "a b c" of 9 and 3 the second. 7 is 1 backwards, but 2 gives what 1 doesn't.
    assert text[5] == "z" and text[9] == text[7] == ""


def test_rounds(spark, monkeypatch):
    """A line that the first holders don't align is tried with all others, in rounds of few."""
    monkeypatch.setattr(linededup, "GROWTH", 2)
    order = lambda i: [f"w{k}" for k in range(i)] + ["hot line"] + [f"v{k}" for k in range(i)]
    rows = [(i, "\n".join([*order(i % 7), f"own {i}"])) for i in range(60)]
    rows += [(100 + i, "\n".join([*reversed(order(5)), "hot line", f"last {i}"] * (1 + i % 3))) for i in range(8)]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_random_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["", "p", "q r", "s", "t u v", "w", "x y"]) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    for least in (1, 3):
        check_lines(spark.createDataFrame(rows, "doc_id long, text string"), rows, least)


def test_patience():
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 9))] for _ in range(2))
        got, want = linededup.patience(a, b), brute_patience(a, b)
        assert got == want, (a, b)


def test_sharding(odd, none, rows):
    got = sharding.shard_by_bytes(odd, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)
    most = max(r["size"] for r in got)
    total, sums = sum(r["size"] for r in got), Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert all(abs(s - total / 7) <= most for s in sums.values())
    assert sharding.shard_by_bytes(none).count() == 0


def brute_search(rows: list[tuple], asked: list, k: int) -> dict:
    """(query id, md5) -> [(rank, doc_id, score)] from the score of every document."""
    from math import log

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(d, words(t)) for d, t, *_ in rows]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = Counter(x for _, w in docs for x in set(w))
    counts = [(d, Counter(w), len(w)) for d, w in docs]
    out = {}
    for q, text in {r[:2] for r in rows if r[0] in asked and r[1] is not None}:
        scores = []
        for d, tf, length in counts:
            s = sum(log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * length / mean)) for x in set(words(text)) if x in tf)
            if s > 0:
                scores.append((-round(s, 9), d is not None, d or 0))
        if scores:
            out[q, hashlib.md5(text.encode()).hexdigest()] = [(i + 1, d if named else None, round(-s, 6)) for i, (s, named, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("shard", [64, 128, search.SHARD])
def test_search(spark, odd, none, rows, monkeypatch, shard):
    """Against scoring every document, in shards and blocks of few, with rare and common terms;
    copies of a text in many shards stand in the order of their ids."""
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", min(8, search.BLOCK) if shard < search.SHARD else search.BLOCK)
    monkeypatch.setattr(search, "COMMON", 3)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    monkeypatch.setattr(search, "TOGETHER", 2)
    rng = random.Random(1)
    more = [(1000 + i, rows[9 + i % 3][1] if i % 4 == 0 else " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(30)), "en", "s", 1) for i in range(400)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).repartition(5)
    asked = [7, 8, 12, 14, 203, 2, 1001, 1002, 1003]
    found = search.search(docs, docs.filter(F.col("doc_id").isin(asked)), 12).collect()
    got = defaultdict(list)
    for r in found:
        got[r["query_id"], r["query_md5"]].append((r["rank"], r["doc_id"], round(r["score"], 6)))
    assert {q: sorted(x) for q, x in got.items()} == brute_search([*rows, *more], asked, 12)
    assert search.search(none, none).count() == 0


def test_long_document_in_a_shard():
    """Half a million terms in one document are no rows of a matrix."""
    words = [np.arange(500_000, dtype=np.uint64), np.arange(5, dtype=np.uint64)]
    pair = np.concatenate([np.arange(500_000) * search.SHARD, np.arange(5) * search.SHARD + 1])
    pair.sort()
    offsets = np.searchsorted(pair, np.arange(500_001) * search.SHARD).astype(np.int32)
    lengths = np.array([500_000, 5], np.int32)
    row = {
        "ids": np.array([1, 2]).tobytes(), "named": np.ones(2, np.uint8).tobytes(), "lengths": lengths.tobytes(), "terms": words[0].tobytes(),
        "offsets": offsets.tobytes(), "places": (pair % search.SHARD).astype(np.uint16).tobytes(), "counts": np.ones(len(pair), np.int32).tobytes(),
    }
    shard = search.Shard(row, 10.0)
    assert shard.rows.nbytes == 0 and len(shard.search([(np.arange(5), np.ones(5))], np.zeros(1), 10)[0][0]) == 2
    assert search.arranged(pair // search.SHARD, pair % search.SHARD, lengths).tolist() == [1, 0]


def test_scores_that_single_precision_cannot_tell():
    """Sums in single precision only choose what is scored exactly: of scores that differ in the ninth
    digit the best stand first, with weights of terms, and with thresholds that others have set."""
    rng = np.random.default_rng(4)
    n, many = 300, 40
    tf = np.where(rng.random((many, n)) < np.where(np.arange(many) < 20, 0.9, 0.05)[:, None], rng.integers(1, 4, (many, n)), 0)
    tf[:, 200:] = tf[:, [7]]
    lengths = np.concatenate([rng.integers(20, 400, 200), 1_000_000_000 + np.arange(100)]).astype(np.int32)
    term, doc = np.nonzero(tf)
    row = {
        "ids": np.arange(n).tobytes(), "named": np.ones(n, np.uint8).tobytes(), "lengths": lengths.tobytes(), "terms": np.arange(many, dtype=np.uint64).tobytes(),
        "offsets": np.searchsorted(term, np.arange(many + 1)).astype(np.int32).tobytes(), "places": doc.astype(np.uint16).tobytes(), "counts": tf[term, doc].astype(np.int32).tobytes(),
    }
    weight = rng.random(many) + 0.5
    mean = 1e9
    shard = search.Shard(row, mean, weight)
    assert shard.rows.dtype == np.float32
    part = weight[:, None] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * lengths / mean))
    asked = [np.arange(many), np.arange(0, many, 3), np.arange(25, many), np.arange(0)]
    for least in (0.0, 5.0):
        for at, (places, scores) in zip(asked, shard.search([(at, None) for at in asked], np.full(4, least), 10), strict=True):
            want = np.round(part[at].sum(axis=0), search.PLACES)
            best = [i for i in np.lexsort((np.arange(n), -want))[:10].tolist() if want[i] > 0 and want[i] >= least]
            got = dict(zip(places.tolist(), scores.tolist(), strict=True))
            assert set(best) <= set(got) and all(abs(got[i] - want[i]) < 2e-9 for i in got)
            assert not len(at) or len(got) < n // 2


def water(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Clamp and share out again until nobody is above the cap."""
    wanted, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        left = wanted - sum(held.values())
        out = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if out[s] >= most * sizes[s]]
        if not over or not free:
            return {**held, **out}
        held |= {s: most * sizes[s] for s in over}


def test_mixing(odd, none, rows):
    got = mixing.mix_sources(odd).collect()
    sizes: Counter = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    taken: Counter = Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    largest = defaultdict(int)
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd.repartition(2)).collect()))
    assert mixing.mix_sources(none).count() == 0
    whole = mixing.repeat_documents(odd)
    assert whole.columns == odd.columns and whole.count() == sum(r["epochs"] for r in got)


def test_pipeline(spark, odd, none, tmp_path):
    """Every stage on odd rows and on none, and the order of what is kept."""
    sf = "/root/testdata/sf0.001"
    for kind, docs in (("odd", odd), ("none", none)):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{kind}")
            out = stage(spark, docs, sf)
            assert name == "tokens" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert {r["round_trip"] for r in spark.read.parquet(str(tmp_path / "tokens-odd")).collect()} == {True}


def test_queries_run(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in Q.QUERIES.items():
        rows = query(spark, sf).collect()
        assert rows and (name in ("op6_search", "op13_distinct") or len(rows) == n), name
