import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from glyphwalk.llm import audio, quality, url_filter


def test_round_trip_and_equal_texts(spark):
    texts = [None, "", "a", "x" * 64, "é" * 40, "long " * 20000, "long " * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r["doc_id"]: r for r in audio.media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = audio.encode(payload)
        assert audio.decode(stored) == payload and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[5]["feature"] == got[6]["feature"] and got[0]["feature"] == got[1]["feature"] != got[3]["feature"]
    assert audio.media_digest(df.limit(0)).count() == 0


def test_polyphase_equals_direct_filtering():
    r = np.random.default_rng(1)
    for up, down in ((1, 2), (2, 3), (3, 1), (3, 4), (5, 2)):
        for size in (203, 64, 3, 1):
            x = r.normal(size=size).astype(np.float32)
            phases, centre = audio._phases(up, down)
            spread = np.zeros(len(x) * up)
            spread[::up] = x
            want = np.convolve(spread, phases.T.ravel())[centre : centre + len(spread) : down]
            got = audio.resample(x, up, down)
            assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def slow_feature(payload):
    """The digest by plain loops: every output sample, frame, band and span by its definition."""
    signal = [(b - 128) / 128 for b in payload]
    up, down, rate = audio.UP, audio.DOWN, audio.RATE * audio.UP / audio.DOWN
    size = 8 * max(up, down) + 1
    h = np.sinc((np.arange(size) - (size - 1) / 2) / max(up, down)) * np.hamming(size)
    h = h * up / h.sum()
    out = []
    for i in range(-(-len(signal) * up // down)):
        u = i * down + (size - 1) // 2
        out.append(sum(h[u - j * up] * signal[j] for j in range(max(0, (u - size) // up), min(len(signal), u // up + 1)) if 0 <= u - j * up < size))
    n = max(1, -(-(len(out) - audio.FRAME) // audio.HOP) + 1)
    out += [0.0] * ((n - 1) * audio.HOP + audio.FRAME - len(out))
    mel = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    bands, energy = np.zeros((n, audio.MELS)), np.zeros(n)
    for f in range(n):
        frame = np.array(out[f * audio.HOP : f * audio.HOP + audio.FRAME]) * np.hanning(audio.FRAME)
        k = np.arange(audio.FRAME // 2 + 1)
        power = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(audio.FRAME)) / audio.FRAME) @ frame) ** 2
        for m in range(audio.MELS):
            weight = [max(0, min((x - mel[m]) / (mel[m + 1] - mel[m]), (mel[m + 2] - x) / (mel[m + 2] - mel[m + 1]))) for x in k * rate / audio.FRAME]
            bands[f, m] = np.log(np.dot(power, weight) + 1e-6)
        energy[f] = np.log((frame**2).sum() + 1e-6)
    level, spans, begin = (energy - energy.mean()) / max(energy.std(), 1e-6), [], None
    for f in range(n + 1):
        inside = f < n and level[f] > audio.LOW
        if inside and begin is None:
            begin = f
        if not inside and begin is not None:
            spans += [(begin, f)] if max(level[begin:f]) > audio.HIGH else []
            begin = None
    active = sum((b - 1 - a) * audio.HOP + audio.FRAME for a, b in spans) / rate
    counts = f"frames={n};tensors={-(-n // audio.SHAPE[0])};shape={audio.SHAPE[0]}x{audio.MELS};end={n * audio.HOP / rate:.3f};segments={len(spans)};active={active:.3f}"
    return counts, bands.mean(0)


def test_query_equals_brute_force(spark):
    r = random.Random(11)
    texts = ["", "short", "é" * 300, " ".join("".join(r.choice("abcxyz") for _ in range(r.randint(1, 9))) for _ in range(200)), "aaaa" * 150 + "~!" * 200 + "aaaa" * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in audio.media_digest(df).collect():
        payload = audio.payload_of(texts[row["doc_id"]])[0]
        counts, mel = slow_feature(payload)
        said, found = row["feature"].split(";mel=")
        assert said == counts and np.abs(np.array(found.split(","), float) - mel).max() < 0.011
        back = audio.from_arrow(bytes(row["tensors"]))
        assert back["shape"] == audio.SHAPE and len(back["spans"]) == len(back["tensors"])


def test_features_in_blocks_and_segments(monkeypatch):
    rng = np.random.default_rng(2)
    loud = np.concatenate([np.zeros(4000), rng.normal(size=4000) * 40, np.zeros(4000)]) + 128
    payload = np.clip(loud, 0, 255).astype(np.uint8).tobytes()
    whole = audio.features(payload)
    assert len(whole["active"]) == 1 and 0.2 < whole["active"][0][0] < 0.3 and 0.45 < whole["active"][0][1] < 0.55
    assert whole["tensors"].shape[1:] == audio.SHAPE and whole["spans"][0][0] == 0.0
    monkeypatch.setattr(audio, "BLOCK", 7)
    again = audio.features(payload)
    assert np.allclose(again["tensors"], whole["tensors"], atol=1e-4)
    assert isinstance(audio.tensor_array(whole["tensors"]), pa.FixedShapeTensorArray)
    assert audio.segments(np.array([0, 0, 2, 1, 1, 0, 1, 0], float), 1.2, 0.4) == [(2, 5)]


def test_media_table(spark):
    rows = audio.media_table(spark.createDataFrame([(3, "word " * 9000)], "doc_id long, text string")).collect()
    back = audio.from_arrow(bytes(rows[0]["tensors"]))
    assert len(rows) == 1 and audio.decode(bytes(rows[0]["media"]))[:45000] == b"word " * 9000
    assert back["tensors"].shape == (len(back["spans"]), *audio.SHAPE) and all(a < b for a, b in back["spans"]) and back["shape"] == audio.SHAPE


def test_bit_parallel_patterns_equal_regular_expressions():
    r = random.Random(3)
    alphabet = "ab./"
    patterns = [("".join(r.choice(alphabet + "*") for _ in range(r.randint(1, 6))), "/" + "".join(r.choice(alphabet + "*") for _ in range(r.randint(0, 30)))) for _ in range(40)]
    urls = ["x://" + "".join(r.choice("ab.") for _ in range(r.randint(0, 6))) + "/" + "".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(300)]
    automaton = url_filter.ShiftAnd([url_filter.glob_pattern(h, p) for h, p in patterns])
    assert automaton.words > 4
    parts = [url_filter.host_path(u) for u in urls]
    got = automaton.run([b"." + h.encode() + b"\xff" + p.encode() + b"\xfe" for h, p in parts])
    any_ = lambda s: ".*".join(map(re.escape, s.split("*")))
    for i, (host, path) in enumerate(parts):
        for k, (h, p) in enumerate(patterns):
            assert got[i, k] == bool(re.fullmatch(any_(h), host) and re.fullmatch(any_(p), path)), (urls[i], patterns[k])


def corpus(n, seed):
    r = random.Random(seed)
    good, bad = [f"fine{i}" for i in range(60)], [f"vile{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        rows.append((i, " ".join(r.choice(good + bad * 2 if toxic else good) for _ in range(r.randint(20, 60))), "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
        rows[-1] += (toxic,)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(600, 4)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["__kept"] for r in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held_out = [(got[i], not toxic) for i, _, _, toxic in rows if i % 2]
    assert sum(k == g for k, g in held_out) >= 0.95 * len(held_out)


def test_inclusion_frequencies_are_those_of_sampling_without_replacement(spark):
    ratios = np.zeros(4 << quality.BITS, np.float32)
    for i in range(8):
        _, bucket, _ = quality.features([f"item{i}"])
        ratios[bucket[0]] = 0.5 * i - 1.5
    groups, k = 700, 3
    docs = spark.createDataFrame([(g * 8 + i, f"item{i}") for g in range(groups) for i in range(8)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["__weight"], r["__key"]) for r in quality.score(docs, ratios, "doc_id", "text").collect())
    weight, key = (np.array([r[c] for r in rows]).reshape(groups, 8) for c in (1, 2))
    assert np.allclose(weight, 0.5 * np.arange(8) - 1.5)
    got = np.bincount(np.argsort(-key, axis=1)[:, :k].ravel(), minlength=8) / groups
    draw, want = np.random.default_rng(1), np.zeros(8)
    for _ in range(20_000):
        p = np.exp(weight[0])
        for _ in range(k):
            i = draw.choice(8, p=p / p.sum())
            want[i] += 1 / 20_000
            p[i] = 0
    assert np.abs(got - want).max() < 0.06


def test_weights_equal_brute_force(spark):
    rows, labels = corpus(120, 8)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["__weight"] for r in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    words = {i: [w.lower() for w in t.split()] for i, t, _, _ in rows}

    def grams(w):  # words as written and in lower case are the same here
        found = {("as written", x) for x in w} | {("plain", x) for x in w} | {("pair", *x) for x in zip(w, w[1:], strict=False)}
        again = [int(b == a) for a, b in zip([None, *w], w, strict=False)]
        return found | {("class", *again[i : i + n]) for n in quality.CLASSES for i in range(len(again) - n + 1)}

    marked = {i: bool(q and not t) for i, q, t in labels}
    raw, target = Counter(), Counter()
    for i, good in marked.items():
        raw.update(grams(words[i]))
        target.update(grams(words[i]) if good else ())
    share = sum(marked.values()) / len(marked)

    def ratio(g):
        e = raw[g] * share
        z = (target[g] - e) / np.sqrt(max(e * (1 - share), 1e-9))
        return np.log((target[g] + 1) / (e + 1)) * max(0, 1 - (quality.SHRINK / max(abs(z), 1e-9)) ** 2)

    # Buckets of 17 bits: a few n-grams of a corpus this small share one.
    close = [abs(got[i] - sum(map(ratio, grams(w)))) < 1e-3 for i, w in words.items()]
    assert sum(close) >= 0.9 * len(close)


def test_labels_beyond_the_bound(spark):
    rows, labels = corpus(400, 9)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    ratios, share = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", 50)
    assert ratios.any() and round(share * 50, 6) == round(share * 50)


def test_quality_edges(spark):
    rows, labels = corpus(60, 5)
    docs = spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (None, "fine1", "x"), (5, rows[5][1], "x"), (5, rows[5][1], "x"), (1002, "fine2 " * 50000, "x")], "doc_id long, text string, __kept2 string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, marks, keep_share=0.5).collect()
    assert len(got) == 6 and sum(r["__kept"] for r in got) >= 3 and len({r["__kept"] for r in got if r["doc_id"] == 5}) == 1
    assert all(r["__kept"] for r in quality.resample(docs, marks.limit(0)).collect())
    assert quality.resample(docs.limit(0), marks).collect() == []


def test_kth_largest(spark):
    r = random.Random(6)
    values = [r.choice([r.random(), 0.5, 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 200, 500):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
