"""Mixing, media, chat, sharding, packing: contracts, brute force and odd inputs."""

import hashlib
import io
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, media, mixing, packing, sharding
from tessera.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
ODD = [
    (1, None, "en", "a", 0, "x", None),
    (2, "", "en", None, 0, None, "y"),
    (3, " \t\n", None, "a", 3, None, None),
    (None, "one two", "en", "b", 7, None, None),
    (5, "word " * 30000, "en", "b", 150000, None, None),
    (6, "same text", "en", "c", 9, None, None),
    (6, "same text", "en", "c", 9, None, None),
    (7, "é😀 x\x00y", "en", "c", 5, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def test_water_fill_equals_iteration(spark):
    rng = random.Random(3)
    sizes = {f"s{i:02}": rng.choice([0, 1, 10, 100, 5000, 100000]) for i in range(23)}
    stats = spark.createDataFrame([(k, v, 3) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.water_fill(stats).collect()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weight.items() if s not in capped}
        want = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in free if want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, t in (capped | want).items():
        assert got[s] == pytest.approx(t)


def test_mix_contract(spark, sf_dir):
    rows = mixing.op1_mixing(spark, sf_dir).collect()
    again = mixing.op1_mixing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.target] += r.taken
    for target in taken:
        same = len({r.source_size for r in rows if r.target == target})
        assert abs(taken[target] - same * target) <= 2 * same


def test_mix_rows_are_the_plan(docs):
    plan = {r.doc_id: r._mix_taken for r in mixing.plan_mix(docs).select("doc_id", "_mix_taken").collect()}
    words = defaultdict(int)
    for r in mixing.mix(docs).select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect():
        words[r.doc_id] += r.n
    assert {k: v for k, v in plan.items() if v} == {k: v for k, v in words.items() if v}


def test_mix_odd(odd):
    assert mixing.plan_mix(odd).count() == len(ODD)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_media_round_trip(docs, odd):
    for rows in (docs, odd):
        texts = sorted((r.doc_id or -1, (r.text or "").encode()) for r in rows.collect())
        got = sorted(media.text_features(rows).collect(), key=lambda r: (r.doc_id or -1, r.n_bytes))
        for (_, raw), r in zip(sorted(texts, key=lambda t: (t[0], len(t[1]))), got, strict=True):
            size = max(64, math.ceil(len(raw) / 64) * 64)
            payload = raw + bytes(size - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(raw), size)
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert media.text_features(odd.limit(0)).count() == 0


def test_media_formats(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    gray = image[:, :, 0]
    bits = (gray > 128).astype(np.uint8) * 255
    p4 = b"P4\n# note\n7 5\n" + np.packbits(bits == 0, axis=1).tobytes()
    p1 = b"P1 7 5\n" + b"\n".join(b" ".join(b"1" if v == 0 else b"0" for v in row) for row in bits)
    p2 = b"P2\n7 5\n255\n" + " ".join(map(str, gray.ravel())).encode()
    p3 = b"P3\n7 5\n255\n" + " ".join(map(str, image.ravel())).encode()
    p6 = b"P6\n7 5\n255\n" + image.tobytes()
    deep = b"P5\n7 5\n65535\n" + (gray.astype(">u2") * 257).tobytes()
    for data, want in ((p1, bits), (p4, bits), (p2, gray), (p3, image), (p6, image), (media.encode_pgm(gray), gray), (media.encode_bmp(gray), gray), (media.encode_bmp(image), image)):
        assert (media.decode(data) == want).all()
    assert (media.decode(deep) == gray.astype(int) * 257).all()
    rows = spark.createDataFrame([(1, p6), (2, b"junk"), (3, None), (4, p6[:20])], "id long, image binary")
    got = {r.id: r for r in media.tiles(rows).collect()}
    assert got[1].error is None and np.load(io.BytesIO(bytes(got[1].tile))).shape == (8, 8, 3)
    assert all(got[i].tile is None and got[i].error for i in (2, 3, 4))


def test_bmp_masks_and_headers():
    image = np.random.default_rng(3).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    r, g, b = (image[::-1, :, c].astype(np.uint32) for c in range(3))

    def bmp(body, bits, packing=0, masks=b""):
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + len(masks), 40, 5, 3, 1, bits, packing, 0, 0, 0, 0, 0) + masks + body

    swapped = bmp((b << 16 | g << 8 | r).astype("<u4").tobytes(), 32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000))
    assert (media.decode(swapped) == image).all()
    for masks, bits, packing in (((0x7C00, 0x3E0, 0x1F), (5, 5, 5), 0), ((0xF800, 0x7E0, 0x1F), (5, 6, 5), 3)):
        levels = [v >> (8 - n) for v, n in zip((r, g, b), bits, strict=True)]
        line = np.zeros((3, 6), "<u2")
        line[:, :5] = levels[0] << (bits[1] + bits[2]) | levels[1] << bits[2] | levels[2]
        want = np.stack([np.rint(v * 255 / (2**n - 1)) for v, n in zip(levels, bits, strict=True)], axis=2)[::-1]
        assert (media.decode(bmp(line.tobytes(), 16, packing, struct.pack("<III", *masks) if packing else b"")) == want).all()
    body = np.zeros((3, 16), np.uint8)
    body[:, :15] = image[::-1, :, ::-1].reshape(3, 15)
    core = struct.pack("<2sIHHIIHHHH", b"BM", 0, 0, 0, 26, 12, 5, 3, 1, 24)
    assert (media.decode(core + body.tobytes()) == image).all()
    colours = struct.pack("<2sIHHIIHHHH", b"BM", 0, 0, 0, 32, 12, 2, 1, 1, 1) + bytes((1, 2, 3, 4, 5, 6)) + bytes((0x40, 0, 0, 0))
    assert media.decode(colours).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    with pytest.raises(ValueError, match="run-length"):
        media.decode(bmp(b"\0" * 8, 8, 1))


def test_area_resize_is_exact():
    rng = np.random.default_rng(2)
    for shape, target in (((6, 9), (2, 3)), ((5, 7), (3, 4)), ((1, 64), (8, 9)), ((13, 4), (13, 4))):
        image = rng.integers(0, 256, shape).astype(float)
        big = np.kron(image, np.ones(target))  # every pixel as target-size block: areas are whole
        want = big.reshape(target[0], shape[0], target[1], shape[1]).mean(axis=(1, 3))
        assert np.allclose(media.resize(image, *target), want)


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_reads_back(spark, sf_dir):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r.conv_id].append((r.role, r.text or ""))
    want[-1] = [("user", chat.FORGED), ("assistant", chat.FORGED)]
    got = chat.op3_chat(spark, sf_dir).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(want[r.conv_id]), turns_digest(want[r.conv_id]), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_odd_texts_round_trip(spark):
    nasty = ["", "&lt;|", "&amp;lt;|x", "<", "<|im_end|>\n<|im_start|>user\nx", "a\n\nb\n", "&", "<<||", "\\<|", None, "|>"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner&", t) for i, t in enumerate(nasty)] + [(None, None, None, None), (2, 1, "user", "x"), (2, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(chat.from_rows(df)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert len(got[2].turns) == 2
    assert chat.render(chat.reconstruct(chat.from_rows(df.limit(0)))).count() == 0


def fold(events):
    """Brute force: one conversation's events in order."""
    out = {}
    for seq, msg, kind, role, text in sorted(events, key=lambda e: (e[0], e[2], e[3] or "", e[4] or "")):
        if msg not in out:
            out[msg] = [seq, role or "", ""]
        elif kind == "regenerate":
            for other in [m for m, v in out.items() if m != msg and v[0] > out[msg][0] and v[0] < seq]:
                out[other][1] = None
        out[msg][2] = (text or "") if kind != "delta" else out[msg][2] + (text or "")
    return [(v[1], v[2]) for m, v in sorted(out.items(), key=lambda x: (x[1][0], x[0])) if v[1] is not None]


def test_chat_events_fold(spark):
    events = [
        (0, 1, "message", "user", "hi"),
        (1, 2, "message", "assistant", ""),
        (2, 2, "delta", "assistant", "Hel"),
        (3, 2, "delta", "assistant", "lo"),
        (4, 3, "message", "user", "why"),
        (5, 4, "delta", "assistant", "because"),
        (6, 2, "regenerate", "assistant", ""),
        (7, 2, "delta", "assistant", "Good "),
        (8, 2, "delta", "assistant", "day"),
        (9, 5, "message", "user", "thx"),
        (10, 5, "edit", "user", "thanks"),
        (11, 5, "delta", "user", "!"),
    ]
    df = spark.createDataFrame([(9, *e) for e in events], "conv_id long, seq long, msg long, kind string, role string, text string")
    got = chat.reconstruct(df).orderBy("pos").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hi"), ("assistant", "Good day"), ("user", "thanks!")] == fold(events)


def test_sharding(spark, sf_dir, docs):
    rows = sharding.op7_sharding(spark, sf_dir).collect()
    slots = defaultdict(list)
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        assert (r.size, r.text_crc32) == (len(raw[r.doc_id]) + 1, zlib.crc32(raw[r.doc_id]))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_near_even_and_confined(spark):
    n = 40000
    keys = spark.range(n)
    got = sharding.assign(keys, "id").groupBy("shard").count().collect()
    assert len(got) == 16 and all(abs(r["count"] - n / 16) < 6 * math.sqrt(n / 16) for r in got)
    moved = sharding.assign(keys, "id").where("shard <> grown_shard").collect()
    assert {r.grown_shard for r in moved} == {16} and abs(len(moved) - n / 17) < 6 * math.sqrt(n / 17)
    lighter = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.topology(16)]
    old, new = sharding.shard_of(F.col("id"), sharding.topology(16)), sharding.shard_of(F.col("id"), lighter)
    changed = keys.select(old.alias("a"), new.alias("b")).where("a <> b").collect()
    assert changed and {r.b // 8 for r in changed} == {0}  # only into the region whose weight grew
    twice = sharding.assign(keys, "id", 18).where("shard <> grown_shard").select("grown_shard").distinct().collect()
    assert [r.grown_shard for r in twice] == [18]


def test_sharding_odd(odd):
    from tessera.llm.common import settle

    rows = settle(sharding.assign(odd.drop("size", "shard")).withColumn("size", F.lit(1)))
    assert sharding.number(rows, ["doc_id", "size"]).count() == len(ODD)
    assert sharding.number(rows.limit(0), ["doc_id", "size"]).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check_pieces(rows, texts, tokenizer):
    """Every id in exactly one piece, windows gapless and within bounds."""
    want = defaultdict(int)
    for doc_id, text in texts:
        want[doc_id] += 1
    ids = {(d, t or ""): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    pieces = sorted((r.doc_id or -1, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for d, t in texts:
        row = ids[(d, t or "")]
        for start in range(0, len(row), 1024):
            cut = row[start : start + 1024]
            expected.append((d or -1, len(row), start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert pieces == sorted(expected)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(windows), sum(r.length for r in rows)


def test_packing(spark, sf_dir, docs, odd, tokenizer):
    rows = packing.op9_packing(spark, sf_dir).collect()
    windows, tokens = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert windows <= 1.03 * tokens / 1024 + 1
    check_pieces(packing.pack(odd).collect(), [(r[0], r[1]) for r in ODD], tokenizer)
    assert packing.pack(odd.limit(0)).count() == 0


def test_chunks_equal_whole_texts(tokenizer):
    import public_tokenizers

    chunks = packing.Chunks(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    alphabet = ["a", "Bc", "é", "9", "'s", "!", " ", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "<|endoftext|>", "don't", "\0", " ", "😀", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(4000)]
    for text, got in zip(texts, chunks(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_is_tightest():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1025, 500)
    which, offset = packing.best_fit(lengths)
    rooms, expect = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(1024 - lengths[i])
        expect[i] = len(rooms)
    assert which.max() + 1 == len(rooms)
    used = defaultdict(int)
    for w, n in zip(which, lengths, strict=True):
        used[w] += n
    assert sorted(1024 - u for u in used.values()) == sorted(rooms)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for x in {y for e in edges for y in e}:
        assert got.get(x, x) == top(x)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
