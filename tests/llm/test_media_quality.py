"""Media features and the additive model against plain versions."""

import hashlib
import io
import math
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, quality


def plain_area(image, height, width):
    """Exact means over target cells, by fractions."""
    rows, cols = image.shape
    out = []
    for i in range(height):
        line = []
        for j in range(width):
            y0, y1, x0, x1 = Fraction(i * rows, height), Fraction((i + 1) * rows, height), Fraction(j * cols, width), Fraction((j + 1) * cols, width)
            total = Fraction(0)
            for y in range(math.floor(y0), math.ceil(y1)):
                for x in range(math.floor(x0), math.ceil(x1)):
                    total += int(image[y, x]) * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            line.append(total / ((y1 - y0) * (x1 - x0)))
        out.append(line)
    return out


def test_text_features_equal_a_plain_version(spark):
    texts = [None, "", "a", "é😀" * 20, "x" * 64, "The quick brown fox. " * 40, "z\n" * 500]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("feature", F.lit(1)).withColumn("media", F.lit("m"))
    for r in media.text_features(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        small = [[round(v * 1024) for v in line] for line in plain_area(image, 8, 9)]
        bits = "".join(str(int(a < b)) for line in small for a, b in zip(line, line[1:], strict=False))
        assert r.feature == f"{int(bits, 2):016x}"
        tile = io.BytesIO()
        np.save(tile, np.array([[round(v) for v in line] for line in plain_area(image, 8, 8)], np.uint8))
        assert r.tile_sha256 == hashlib.sha256(tile.getvalue()).hexdigest()


def test_samples_above_the_maximum_are_errors(spark):
    bad = [b"P2\n2 1\n15\n3 300\n", b"P5\n2 1\n15\n" + bytes((3, 16)), b"P2\n1 1\n99999\n5\n"]
    good = b"P2\n2 1\n15\n3 15\n"
    assert media.decode(good).tolist() == [[3, 15]]
    rows = spark.createDataFrame([(str(i), d, 1) for i, d in enumerate([*bad, good, good])], "error string, image binary, tile int")
    got = media.tiles(rows, key="error")
    assert got.columns[0] == "error_in"
    assert [(r.tile is None, bool(r.error)) for r in got.orderBy("error_in").collect()] == [(True, True)] * 3 + [(False, False)] * 2
    assert media.tiles(rows.limit(0), key="error").count() == 0


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_palette_bmps(bits):
    rng = np.random.default_rng(bits)
    width, height = 11, 3
    index = rng.integers(0, 1 << bits, (height, width))
    palette = rng.integers(0, 256, (1 << bits, 4), dtype=np.uint8)
    body = b""
    for line in index[::-1]:
        packed = int("".join(f"{v:0{bits}b}" for v in line), 2) << (-width * bits % 8)
        body += packed.to_bytes((width * bits + 7) // 8, "big").ljust((width * bits + 31) // 32 * 4, b"\0")
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + palette.size, 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0)
    assert (media.decode(head + palette.tobytes() + body) == palette[:, 2::-1][index]).all()


def plain_fit(x, y, bins, small, model, rounds, pair_rounds):
    """Boosted tables by trying every tree: two levels on one feature, then one split in each of two features."""
    n, z = len(y), [model.base] * len(y)
    tables = [[0.0] * len(t) for t in model.tables]
    pairs = {k: np.zeros(v.shape) for k, v in model.pairs.items()}

    def gain(g, h):
        return g * g / (h + 1)

    def grads():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    def sums(rows, g, h):
        return sum(g[i] for i in rows), sum(h[i] for i in rows)

    def best_cut(rows, bin_of, g, h, lo, hi):
        best = (1e-9, None)
        total = sums(rows, g, h)
        for cut in range(lo + 1, hi):
            a = sums([i for i in rows if bin_of[i] < cut], g, h)
            if a[1] >= 1 and total[1] - a[1] >= 1:
                won = gain(*a) + gain(total[0] - a[0], total[1] - a[1]) - gain(*total)
                if won > best[0] + 1e-12:
                    best = (won, cut)
        return best[1]

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = grads()
            parts = [(0, len(tables[j]))]
            for _ in range(2):
                new = []
                for lo, hi in parts:
                    cut = best_cut([i for i in range(n) if lo <= bins[i, j] < hi], bins[:, j], g, h, lo, hi)
                    new += [(lo, hi)] if cut is None else [(lo, cut), (cut, hi)]
                if new == parts:
                    break
                parts = new
            for lo, hi in parts:
                own = [i for i in range(n) if lo <= bins[i, j] < hi]
                a = sums(own, g, h)
                for b in range(lo, hi):
                    tables[j][b] += quality.RATE * a[0] / (a[1] + 1)
                for i in own:
                    z[i] += quality.RATE * a[0] / (a[1] + 1)
    for _ in range(pair_rounds):
        for (a, b), table in pairs.items():
            g, h = grads()
            best = (-math.inf, None)
            for i in range(1, table.shape[0]):
                for j in range(1, table.shape[1]):
                    quarters = [[k for k in range(n) if (small[k, a] < i) == top and (small[k, b] < j) == left] for top in (True, False) for left in (True, False)]
                    won = sum(gain(*sums(q, g, h)) for q in quarters)
                    if won > best[0] + 1e-12:
                        best = (won, (i, j, quarters))
            i, j, quarters = best[1]
            for q, (rows, cols) in zip(quarters, [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))], strict=True):
                s = sums(q, g, h)
                table[rows, cols] += quality.RATE * s[0] / (s[1] + 1)
                for k in q:
                    z[k] += quality.RATE * s[0] / (s[1] + 1)
    return tables, pairs, z


def test_boosting_equals_trying_every_tree(monkeypatch):
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 6), ("COARSE", 4)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(5)
    x = np.round(rng.random((160, 4)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (rng.random(160) < 0.1)).astype(float)
    model = quality.fit(x, y)
    tables, pairs, z = plain_fit(x, y.tolist(), model.bins(x), model.coarse(x), model, 3, 2)
    for got, want in zip(model.tables, tables, strict=True):
        assert np.allclose(got, want)
    for k, want in pairs.items():
        assert np.allclose(model.pairs[k], want)
    assert np.allclose(model.predict(x), 1 / (1 + np.exp(-np.array(z))))


def test_scores_are_looked_up(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["the", "of", "Word", "123", "||", "tea.", "x!", "été"], rng.integers(0, 40))) for _ in range(300)] + [None, "", "w " * 30000]
    labels = [(i, int(rng.random() < 0.6), 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "p", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, predicted string, score double")
    rows = quality.described(docs, ["doc_id", "predicted", "score"])
    model = quality.train(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.scored(rows, model, ["doc_id", "predicted", "score"])
    assert got.columns == ["doc_id", "predicted_in", "score_in", "score", "predicted"]
    for r in got.collect():
        x = quality.features_of(texts[r.doc_id] or "")
        place = lambda edges, v: sum(e <= v for e in edges)
        z = model.base + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        z += sum(t[place(model.coarse_edges[a], x[a]), place(model.coarse_edges[b], x[b])] for (a, b), t in model.pairs.items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == (r.score >= 0.3)
    assert quality.scored(rows.limit(0), model, ["doc_id"]).count() == 0
