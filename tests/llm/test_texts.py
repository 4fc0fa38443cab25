"""Operators that work row by row: secrets, BPE, media, language, quality."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bpe, language, media, quality, secrets

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_merge_equals_library():
    rng = random.Random(1)
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    texts = ["".join(rng.choice("ab the\n  é1x.ß漢🙂'stkéà　 \u0085\x1c<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["ab" * 50_000, "z" * 100_000, "a" * 7 + "\n" * 999, " " * 5000 + "x"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ENCODING.encode_ordinary(t)


def test_bpe_digests(odd, none, rows):
    got = Counter(tuple(r) for r in bpe.digests(odd).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(ENCODING.encode_ordinary(text or ""), "<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(none).count() == 0
    apart, once = bpe.decode(bpe.encode(odd)), bpe.encode_and_decode(odd.withColumn("decoded", F.lit(0)))
    assert apart.columns == once.columns and Counter(map(str, apart.collect())) == Counter(map(str, once.collect()))
    clash = bpe.encode(odd.withColumn("ids", F.lit(1)))
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"] and dict(clash.dtypes)["ids"] == "binary"


def brute_secrets(text: str) -> list[tuple[int, int, int]]:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, odd, none):
    rng = random.Random(2)
    pieces = ["password=", "API-KEY", "apikey: ", "api_KEY='", "token", "Secret = \"", "token=token = ", "hunter22", "ab12.c/d=", "AKIA", "ABCDEFGHIJ0123456", "deadbeef01", "é🙂", " ", "\n", "ſecret=abcdefgh", "Q9x_-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ratios = secrets.train(secrets.default_samples(spark))
    for r in secrets.find_secrets(df, ratios).collect():
        assert [(s["start"], s["nth"], s["end"]) for s in r["found"] if s["nth"] < 3] == brute_secrets(r["text"]), r["text"]
        base = [(s["start"], s["end"]) for s in r["found"] if s["nth"] < 3]
        assert all(b <= s["start"] or s["end"] <= a for s in r["found"] if s["nth"] == 3 for a, b in base)
    planted = [("x ghp_16C7e42F292c6912E7710c838347Ae178B4a y", 1), ("aGVsbG8gd29ybGQgYWdhaW4hIQ9zT2v", 1), ("get_user_name_from_request_context", 0), ("getElementByIdAndClassNameValue", 0), ("thisisanordinaryrunofletters", 0), ("THE_QUICK_BROWN_FOX_JUMPS_OVER", 0), (None, 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")
    got = secrets.digests(secrets.find_secrets(df, ratios)).orderBy("doc_id").collect()
    assert [r["n_markov"] for r in got] == [n for _, n in planted]
    assert got[-1]["spans"] == "" and got[-1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clash = odd.withColumn("found", F.lit(1)).withColumn("assign", F.lit("x")).withColumn("runs", F.lit(2)).withColumn("_markov", F.lit(3)).withColumn("a.b", F.lit(4))
    found = secrets.find_secrets(clash, ratios)
    assert found.columns == [*odd.columns, "assign", "runs", "_markov", "a.b", "found"]
    got = found.collect()
    assert len(got) == odd.count() and {(r["assign"], r["runs"], r["_markov"], r["a.b"]) for r in got} == {("x", 2, 3, 4)}
    for r in got:
        assert [(s["start"], s["nth"], s["end"]) for s in r["found"] if s["nth"] < 3] == brute_secrets(r["text"] or "")
    assert secrets.digests(secrets.find_secrets(none, ratios)).collect() == []
    assert secrets.train(secrets.default_samples(spark).limit(0)) == [0.0] * secrets.CODES**2


def test_strings_of_other_kinds(spark):
    """Rules, fillers, paths and prose without blanks are none; strings drawn by another generator are."""
    rng = random.Random(77)
    plain = [c * n for c in "-=_A0x" for n in (20, 24, 32, 400)] + ["-=" * 16, "=-" * 30, "+-" * 12, "/usr/local/share/python/site-packages", "path/to/some/other/file_name_with_words", "src/main/java/com/example/service/UserServiceFactory"]
    plain += ["internationalization-of-components", "veryLongCamelCaseIdentifierName", "SOME_CONSTANT_WITH_MANY_WORDS", "kebab-case-name-of-some-package", "2024-01-01/2024-12-31/reports/summary"]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choice(alphabet) for _ in range(rng.randint(28, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*plain, *drawn])), "doc_id long, text string")
    got = [r["n_markov"] for r in secrets.digests(secrets.find_secrets(df, secrets.train(secrets.default_samples(spark)))).orderBy("doc_id").collect()]
    assert [t for t, n in zip(plain, got, strict=False) if n] == [] and sum(got[len(plain) :]) >= 0.95 * len(drawn)


def brute_markov(text: str, ratios: list[float]) -> list[tuple[int, int]]:
    base = [(a, b) for a, _, b in brute_secrets(text)]
    out = []
    for m in re.finditer(secrets.RUN, text):
        if any(a < m.end() and m.start() < b for a, b in base):
            continue
        score = sum(float(f"{ratios[ord(x) * secrets.CODES + ord(y)]:.4f}") for x, y in zip(m[0], m[0][1:], strict=False)) / (len(m[0]) - 1)
        if score > secrets.CUT:
            out.append((m.start(), m.end()))
    return out


def test_markov_spans(spark):
    """Against a loop over the runs; and on samples that were not learnt from."""
    ratios = secrets.train(secrets.default_samples(spark))
    rng = random.Random(12)
    run = lambda: "".join(rng.choice("abcdefXYZ0189+/=_-") for _ in range(rng.randint(15, 40)))
    texts = [rng.choice([" ", ", ", "é", ""]).join(rng.choice([run(), "token=" + run(), "get_user_name_from_request", "deadbeef" * 4, "word"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secrets.find_secrets(df, ratios).collect()
    for r in found:
        assert [(s["start"], s["end"]) for s in r["found"] if s["nth"] == 3] == brute_markov(r["text"], ratios)
    assert sum(s["nth"] == 3 for r in found for s in r["found"]) > 100
    n = secrets.SAMPLES
    unseen = secrets.default_samples(spark, 2 * n).withColumn("id", F.monotonically_increasing_id()).filter(F.length("text") >= 20)
    unseen = unseen.join(secrets.default_samples(spark).select("text").distinct(), "text", "left_anti")
    judged = unseen.filter(F.col("text").rlike(f"^{secrets.RUN}$")).select("random", (secrets.randomness(F.col("text"), ratios) > secrets.CUT).alias("said"))
    told = Counter((r["random"], r["said"]) for r in judged.collect())
    assert told[1, True] / (told[1, True] + told[1, False]) > 0.97 and told[1, True] / (told[1, True] + told[0, True]) > 0.97
    assert sum(told.values()) > n


def test_long_secrets(spark):
    """A run of a million characters, and a hundred thousand matches of each kind, in seconds."""
    rng = random.Random(3)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    many = " ".join(f"{rng.getrandbits(100):025x} token=abc{i} {run[i : i + 24]}" for i in range(100_000))
    ratios = secrets.train(secrets.default_samples(spark))
    began = time.time()
    df = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digests(secrets.find_secrets(df, ratios)).collect()}
    assert time.time() - began < 60
    assert got[1]["spans"] == "markov:0:1000000"
    assert [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in got[2]["spans"].split(",") if not s.startswith("markov")] == [(secrets.KINDS[k], a, b) for a, k, b in brute_secrets(many)]
    assert got[2]["n_hex"] == 100_000 and got[2]["n_markov"] > 90_000


def test_markov_ratio(spark):
    """The ratio array against a plain count."""
    samples = spark.createDataFrame([("abab", 1), ("ac", 1), ("aab", 0)], "text string, random int")
    ratios = secrets.train(samples)
    at = lambda x, y: ratios[ord(x) * secrets.CODES + ord(y)]
    s, n = secrets.SMOOTH, secrets.CODES
    want = lambda hit, hits, miss, misses: np.log((hit + s) / (hits + s * n)) - np.log((miss + s) / (misses + s * n))
    assert at("a", "b") == pytest.approx(want(2, 3, 1, 2)) and at("a", "c") == pytest.approx(want(1, 3, 0, 2))
    assert at("a", "z") == at("z", "z") == 0  # what neither sample shows


def test_media(odd, none, rows):
    got = {(r["payload_sha256"], r["n_bytes"]): r for r in media.digests(odd).collect()}
    for _, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[hashlib.sha256(payload).hexdigest(), len(raw)]
        assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:])
        wav = media.write_wav(payload)
        assert media.read_wav(wav) == (media.RATE, payload)
        assert r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
    assert media.digests(none).count() == 0


def test_resample_and_segments():
    rng = np.random.default_rng(3)
    x = rng.standard_normal(997).astype(np.float32)
    y = media.resample(x)
    h = media.phases(media.UP, media.DOWN, media.TAPS)[:, ::-1].T.reshape(-1)  # the filter, flat
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    assert np.allclose(y, np.convolve(up, h)[: len(up) : media.DOWN], atol=1e-4)
    level = np.array([0, 2, 1, 3, 1, 0, 1, 3, -1, 2.0])
    assert media.hysteresis(level, 2, 1) == [(1, 5), (7, 8), (9, 10)]
    t = media.read_tensors(media.tensors(np.ones((40, media.MELS), np.float32), 20.0))
    assert t.column("mel").type.shape == [media.WINDOW, media.MELS] and t.column("frames").to_pylist() == [32, 8]
    assert t.column("start_ms").to_pylist() == [0.0, 640.0] and t.column("end_ms").to_pylist() == [640.0, 800.0]


def test_codewords():
    for n in (2, 3, 4, 7, 12):
        words = language.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(words) for b in words[:i]]
        assert min(apart) >= (words.shape[1] // 2 if n <= language.EXHAUSTIVE else words.shape[1] // 5)
        assert n <= 2 or all(abs(c.sum()) < n for c in words.T)


def test_many_languages(spark, monkeypatch):
    """Every language is learnt, from one text where there are more of them than texts to learn from."""
    monkeypatch.setattr(language, "ALL", 300)
    rng = random.Random(12)
    names = [f"l{i:03}" for i in range(450)]
    sounds = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for n in names}
    text = lambda n: " ".join(rng.choice(sounds[n]) + rng.choice(sounds[n]) for _ in range(60))
    rows = [(i, text(n), n) for i, n in enumerate(names * 2)]
    codes = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert codes.names == names and codes.words.shape[1] < 120
    asked = spark.createDataFrame([(i, text(n), n) for i, n in enumerate(names)], "doc_id long, text string, lang string")
    right = language.identify(asked, codes).filter("lang = lang_pred").count()
    assert right >= 0.95 * len(names)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    got = language.identify(docs.filter(language.held_out(F.col("doc_id"))), codes)
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1
    blank = {r["text"]: r["lang_pred"] for r in language.identify(odd, codes).collect() if r["text"] is None or not re.search(r"[^\W\d_]", r["text"])}
    assert set(blank.values()) == {"und"} and None in blank
    assert language.identify(none, codes).count() == 0
    nothing = language.train(none)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    space = quality.quality_space(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(quality.held_out(F.col("doc_id")))
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    got = quality.score_quality(docs, space).select("quality", "predicted", "score").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.98 and sum(r["predicted"] for r in bad) / len(bad) < 0.15
    scored = quality.score_quality(odd.withColumn("score", F.lit("x")), space)
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.score_quality(none, space).count() == 0
    empty = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(odd, empty).collect()} == {0.5}


def test_vote_is_exact():
    """The blocked products and the partial sort against every cosine by itself."""
    rng = np.random.default_rng(9)
    tf = rng.poisson(0.3, (80, quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 60).astype(float)
    space = quality.fit(tf[:60], labels)
    for row, score in zip(tf[60:], space.vote(tf[60:]), strict=True):
        near = space.vectors @ space.place(row[None])[0]
        top = np.argsort(-near)[: quality.NEIGHBOURS]
        weight = np.exp(quality.SHARPNESS * (near[top] - 1))
        assert score == pytest.approx((weight * labels[top]).sum() / weight.sum(), rel=1e-4)


def test_bpe_cache_bounds(spark):
    """A worker's cache holds twice its bound at most, whatever the texts; the ids don't depend on it."""
    import public_tokenizers

    from quillspark.llm import bpe

    path = public_tokenizers.path(bpe.VOCABULARY)
    small, large = bpe.Encoder(path, public_tokenizers.PATTERN, 3), bpe.Encoder(path, public_tokenizers.PATTERN)
    text = " ".join(f"wörd{i % 11} thing{i % 7}" for i in range(60))
    assert small.encode(text) == large.encode(text) and len(small) <= 3 and len(small.old) <= 3
