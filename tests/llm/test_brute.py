"""The rest against brute force: decoding of codewords, log-mel features, whole queries, the pipeline's run."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, language, media, quality, shared

SF = "/root/testdata/sf0.001"


def test_decode_is_the_nearest_codeword():
    rng = np.random.default_rng(5)
    for n in (2, 4, 9):
        words = language.codewords(n)
        codes = language.Codes([f"l{i}" for i in range(n)], words, rng.standard_normal((1 << language.BITS, words.shape[1])).astype(np.float32), rng.standard_normal(words.shape[1]).astype(np.float32))
        tf = rng.poisson(0.05, (20, 1 << language.BITS)).astype(np.float32)
        best, score, lead = codes.decode(tf)
        for row, b, s, x in zip(tf, best, score, lead, strict=True):
            v = np.sqrt(row) / np.linalg.norm(np.sqrt(row))
            margin = [float(v @ codes.weights[:, k] + codes.bias[k]) for k in range(words.shape[1])]
            loss = [np.mean([max(0.0, 1 - m * w) for m, w in zip(margin, word, strict=True)]) for word in words]
            share = np.exp(-language.STEEP * np.array(loss))
            share = np.sort(share / share.sum())
            assert loss[b] == pytest.approx(min(loss), abs=1e-5) and s == pytest.approx(share[-1], abs=1e-4) and x == pytest.approx(share[-1] - share[-2], abs=1e-4)


def test_languages_with_odd_ids(spark):
    """Rows with null ids, and languages whose rows share one id, are learnt."""
    words = {"aa": "kala mora tiva sulo", "bb": "zorg fexx wyrm glunk", "cc": "ihi oho uhu eheh"}
    rows = [(None if lang == "aa" else 7, f"{w} {i} {w}", lang) for lang, w in words.items() for i in range(40)]
    codes = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert codes.names == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(i, w, lang) for i, (lang, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in language.identify(asked, codes).collect())


def plain_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and levels by sums over samples, without blocks or fast transforms."""
    raw = (text or "").encode()
    raw += b" " * (max(1, -(-len(raw) // media.UNIT)) * media.UNIT - len(raw))
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    taps = media.UP * media.TAPS
    at = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(at / max(media.UP, media.DOWN)) * np.hamming(taps)
    h *= media.UP / h.sum()
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    y = np.convolve(up, h)[: len(up) : media.DOWN]
    y = np.pad(y, (0, max(0, media.FRAME - len(y))))
    rate = media.RATE * media.UP / media.DOWN
    bank, window = media.mel_bank(rate), np.hanning(media.FRAME)
    t = np.arange(media.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(t, np.arange(media.FRAME // 2 + 1)) / media.FRAME)
    frames = [y[i : i + media.FRAME] * window for i in range(0, len(y) - media.FRAME + 1, media.HOP)]
    mel = np.array([np.log((np.abs(f @ waves) ** 2) @ bank + 1e-6) for f in frames])
    level = np.array([10 * np.log10(np.mean(f * f) + 1e-9) for f in frames])
    return mel, level


def test_media_features(odd, rows):
    """Log-mel energies, levels and segments against sums by hand, on all odd rows but the longest."""
    for _, text, *_ in rows:
        if text and len(text) > 5000:
            continue
        mel, level = plain_features(text)
        got, loud = media.log_mel(media.resample((np.frombuffer(media.read_wav(media.write_wav((text or "").encode() + b" " * (max(1, -(-len((text or "").encode()) // 192)) * 192 - len((text or "").encode()))))[1], np.uint8).astype(np.float32) - 128) / 128), media.RATE * media.UP / media.DOWN)
        assert got.shape == mel.shape and np.allclose(got, mel, atol=5e-3) and np.allclose(loud, level, atol=5e-3)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and 200 <= r[0] < 230}
    for r in media.digests(odd).filter("doc_id between 200 and 229").collect():
        mel, level = plain_features(texts[r["doc_id"]])
        count, means, spans, tensors = r["feature"].split(";")
        assert count == f"{len(mel)}x{media.MELS}" and len(tensors) == len("tensors=") + 64
        assert np.allclose([float(v) for v in means.removeprefix("mel=").split(",")], mel.mean(axis=0), atol=6e-3)
        on, held, middle = False, [], np.median(level)
        for i, v in enumerate(level):
            on = v >= middle + media.OPEN_DB or (on and v >= middle + media.CLOSE_DB)
            held += [i] * on
        ms = 1000 * media.HOP / (media.RATE * media.UP / media.DOWN)
        told = [tuple(float(x) for x in s.split("-")) for s in spans.removeprefix("segments=").split(",") if s]
        if np.ptp(level) > media.OPEN_DB and np.abs(level[:, None] - [middle + media.OPEN_DB, middle + media.CLOSE_DB]).min() > 1e-2:
            assert held == [i for a, b in told for i in range(round(a / ms), round(b / ms))]


def test_quality_query_is_the_vote(spark):
    """op10 on a whole table against every cosine by itself."""
    space = quality.quality_space(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = quality.op10_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        tf = quality.counts(texts[r["doc_id"]] or "")
        near = space.vectors @ space.place(tf[None])[0]
        top = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        weight = np.exp(quality.SHARPNESS * (near[top] - 1))
        assert r["score"] == pytest.approx((weight * space.labels[top]).sum() / weight.sum(), abs=2e-3)
        assert r["predicted"] == (r["score"] >= quality.THRESHOLD)


def test_run(spark, odd, tmp_path):
    """The whole pipeline over odd rows with clashing columns: the ids are the encoded texts of what
    the stages keep, and what stages leave behind is gone."""
    extra = {"__score": F.lit(1), "__removed": F.lit("x"), "size": F.lit(2), "epoch": F.lit(3), "bucket": F.lit("b"), "ids": F.lit("i"), "of": F.lit(0), "class": F.lit("c")}
    odd.withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = shared.documents(spark, str(tmp_path))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, str(tmp_path)), "by-hand")
        assert docs.columns == columns
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    want = Counter((r["doc_id"], digest(encoding.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in out) == want and all(r["round_trip"] for r in out) and want


def test_scratch(spark, tmp_path):
    import os

    with shared.scratch():
        gone, kept = shared.materialize(spark.range(3), "gone"), shared.materialize(spark.range(3), "kept", keep=True)
    there = lambda df: os.path.exists(df._written.removeprefix("file://").removeprefix("file:"))
    assert not there(gone) and there(kept) and kept.count() == 3
    shared.forget(kept)
    assert not there(kept)
