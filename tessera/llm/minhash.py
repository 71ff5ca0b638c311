"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts: the exact number of distinct shingles, a digest of
   the word sequence, and ``BANDS * ROWS`` minima (whole texts). Rows of one
   word sequence collapse into a class, named by a row of it.
2. Bands bring classes together. In every bucket each class is paired with the
   bucket's first (a star, never all pairs).
3. A pair's signatures are compared batch by batch; with m of n minima equal
   and a uniform prior, the pair goes as soon as the posterior probability of
   a similarity of at least the threshold is below ``MISS``.
4. Survivors are verified on the full shingle sets of the texts, in integers.
5. Components of these links. Only buckets that still hold more than one
   component need more: there the rest is compared with everyone in blocks of
   bounded size, pairs of one component being settled already, and survivors
   are verified, block by block. Then the components are final: every two
   classes that share a bucket were linked, compared, or already joined.

Every link is confirmed on full shingle sets (``similar``), in steps 4 and 5
alike; step 5 looks at 64-bit hashes of the shingles first, to pass over pairs
that are far apart.

The hot case, a bucket with a large part of all rows, costs a row a member in
step 2; in step 5 only members outside the bucket's leading component are
copied, once a block: a bucket of m members, k of them outside, makes about
k * m / ``BLOCK`` rows. That is the price of comparing texts that share a
passage, and so a bucket, but aren't similar.

Defined results: every row is a node of its own, whatever its doc_id; a
component's id is the smallest doc_id of its rows, so rows that share a doc_id
can stand in two components of one id. Null ids never name a component that has
another id. Null and empty texts (and texts of white space alone) have no
shingles and link with nothing; a text with fewer words than a shingle has one
shingle, its whole word sequence; repeated rows are equal texts; working columns
are prefixed ``_mh_``, so columns of any other name are safe; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, components, lean, likely, map_columns, settle, texts_of, tidied, without

#: A pair at the threshold misses all bands with probability (1 - 0.8**5)**30 = 7e-6.
BANDS, ROWS = 30, 5
PERMUTATIONS = BANDS * ROWS
BATCH = 25
#: Posterior probability below which a pair is dropped.
MISS = 1e-6
SEED = 6
BLOCK = 512
WORDS_KNOWN = 1 << 18


class Words(dict):
    """Word to 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KNOWN:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def exact_shingles(words: list[bytes], size: int) -> set:
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {*zip(*(words[k:] for k in range(size)), strict=False)}


_RNG = np.random.default_rng(SEED)
_A = (_RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of PERMUTATIONS hashes; blocks keep the table in the cache."""
    low = (shingles >> np.uint64(17)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        x = low[at : at + 512] * _A
        x ^= _B
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys of n signatures."""
    rows = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (len(rows), 1))
    for k in range(ROWS):
        h = (h ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each multiple of BATCH minima compared, the least matches with P(similarity >= threshold) >= miss.

    With a uniform prior the posterior is Beta(1 + m, 1 + n - m), whose upper
    tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survive(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the pairs of signature rows that outlast all batches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, need in enumerate(least.tolist()):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    return alive


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` plus ``_mh_uid, _mh_n`` (shingles), ``_mh_class`` (null without shingles) and ``_mh_sig``."""
    names = docs.columns

    def make():
        known = Words()

        def work(batch):
            n, digest, sigs = [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                s = shingle_hashes(words, shingle, known)
                n.append(len(s))
                digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sigs.append(signature(s).tobytes() if words else None)
            return {c: batch.column(c) for c in (*names, "_mh_uid")} | {"_mh_n": n, "_mh_class": digest, "_mh_sig": sigs}

        return work

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_mh_uid long, _mh_n long, _mh_class binary, _mh_sig binary"])
    return map_columns(docs.withColumn("_mh_uid", F.monotonically_increasing_id()), ddl, make)


def _sigs(batch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)


def prune(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """``pairs(a, b)`` whose signatures outlast the sequential test."""
    least = least_matches(threshold)

    def make():
        def work(batch):
            keep = survive(_sigs(batch, "sa"), _sigs(batch, "sb"), least)
            return {n: batch.column(n).take(keep) for n in ("a", "b")}

        return work

    joined = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"
    )
    return map_columns(joined.select("a", "b", "sa", "sb"), "a long, b long", make)


def similar(x: set, y: set, percent: int) -> bool:
    """100 * |X and Y| >= percent * |X or Y|, of exact shingle sets."""
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(u, v)`` of the ``pairs(a, b)`` of ``texts(id, text)`` that are similar."""

    def make():
        def work(batch):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            last: tuple = (None, None)
            u, v = [], []
            for i in sorted(range(len(a)), key=lambda k: (b[k], a[k])):
                if last[0] != b[i]:
                    last = (b[i], exact_shingles(words_of(tb[i]), shingle))
                if similar(exact_shingles(words_of(ta[i]), shingle), last[1], percent):
                    u.append(a[i])
                    v.append(b[i])
            return {"u": u, "v": v}

        return work

    first, second = (likely(texts, "id", pairs.select(n)).select(F.col("id").alias(n), F.col("text").alias(f"t{n}")) for n in ("a", "b"))
    joined = pairs.join(first, "a").join(second, "b")
    return map_columns(joined.select("a", "b", "ta", "tb"), "u long, v long", make)


def crossing(members: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components in mixed buckets that outlast the test: a row a pair of blocks.

    ``g`` names the pair of blocks, ``ids`` and ``comps`` its members that have
    survivors, ``pairs`` packs places in ``ids``. A pair counts in the first
    band that it shares. Rows are bounded by members and blocks, not by pairs.

    ``members(key, id, comp)``. A bucket's leading component (its smallest
    member's) is dealt to blocks once; the others to blocks of their own, each
    of which meets every block.
    """
    stats = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("id", "comp")).alias("first"))
    mixed = settle(stats.where("low <> high").select("key", F.col("first.comp").alias("lead")))
    rows = settle(members.join(mixed, "key").withColumn("led", F.col("comp") == F.col("lead")).select("key", "id", "comp", "led"))
    sizes = rows.groupBy("key").agg(
        F.ceil(F.sum(F.col("led").cast("long")) / BLOCK).alias("nl"), F.ceil(F.sum((~F.col("led")).cast("long")) / BLOCK).alias("no")
    )
    sizes = settle(sizes)
    # blocks: led ones are 0 .. nl - 1, the others nl .. nl + no - 1; pairs (x, y) with y an other's block and x <= y
    blk = F.when(F.col("led"), F.pmod(F.xxhash64("id", "key"), F.greatest("nl", F.lit(1)))).otherwise(F.col("nl") + F.pmod(F.xxhash64("id", "key"), F.greatest("no", F.lit(1))))
    placed = rows.join(sizes, "key").withColumn("blk", blk)
    other = F.sequence(F.when(F.col("led"), F.col("nl")).otherwise(F.lit(0).cast("long")), F.col("nl") + F.col("no") - 1)
    placed = placed.withColumn("o", F.explode(other)).select("key", "id", "comp", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk")
    dealt = placed.join(sigs, "id")
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.select("key", "x", "y", "blk", "id", "comp", "sig").repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    least = least_matches(threshold)

    spark_schema, out = arrow_schema("g string, ids array<long>, comps array<long>, pairs binary")

    def run(batches):
        def group(rows: list[tuple]) -> pa.RecordBatch | None:
            x, y = rows[0][1:3]
            left = [r for r in rows if r[3] == x]
            right = left if x == y else [r for r in rows if r[3] == y]
            if not left or not right:
                return None
            ids, comps = ([np.array([r[k] for r in side]) for side in (left, right)] for k in (4, 5))
            differ = comps[0][:, None] != comps[1][None, :]
            if x == y:
                differ = np.triu(differ, 1)
            i, j = np.nonzero(differ)
            if not len(i):
                return None
            sig = [np.frombuffer(b"".join(r[6] for r in side), np.uint32).reshape(-1, PERMUTATIONS) for side in (left, right)]
            bands = [band_keys(side) for side in sig]
            a, b = [], []
            for at in range(0, len(i), 8192):
                p, q = i[at : at + 8192], j[at : at + 8192]
                shared = bands[0][p] == bands[1][q]
                here = bands[0][p, shared.argmax(1)] == rows[0][0]
                p, q = p[here], q[here]
                keep = survive(sig[0][p], sig[1][q], least)
                a.append(p[keep])
                b.append(q[keep] + len(left))
            pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
            if not len(pairs):
                return None
            used, places = np.unique(pairs, return_inverse=True)
            every_id, every_comp = np.concatenate(ids), np.concatenate(comps)
            row = (f"{rows[0][0]}/{x}/{y}", every_id[used].tolist(), every_comp[used].tolist(), places.reshape(-1, 2).astype("<u2").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    if (found := group(held)) is not None:
                        yield found
                    held = []
                held.append(row)
        if held and (found := group(held)) is not None:
            yield found

    return dealt.mapInArrow(lean(run), spark_schema)


def verify_blocks(blocks: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(u, v)`` links of the surviving pairs of ``crossing``.

    Each text comes once a pair of blocks, whatever the number of its pairs.
    Pairs whose components a link has joined already add nothing and are passed
    over; of the others, those similar by hashes are confirmed on full sets. At
    most two blocks' texts and hashes are held at a time.
    """
    wanted = blocks.select("g", F.posexplode("ids").alias("at", "id"))
    rows = wanted.join(likely(texts, "id", wanted.select("id")), "id").select("g", "at", "text", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("comps"), F.lit(None).cast("binary").alias("pairs"))
    heads = blocks.select("g", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("text"), "ids", "comps", "pairs")
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = heads.unionByName(rows).repartition(parts, "g").sortWithinPartitions("g", "at")
    spark_schema, out = arrow_schema("u long, v long")

    def run(batches):
        known = Words()
        group, ids, comps, pairs, sets = None, [], [], None, {}

        def close() -> pa.RecordBatch | None:
            root = {c: c for c in comps}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            u, v = [], []
            for i, j in pairs.tolist() if pairs is not None else ():
                a, b = top(comps[i]), top(comps[j])
                if a == b:
                    continue
                (s, x), (t, y) = sets[i], sets[j]
                if percent_of(s, t, percent) and similar(exact_shingles(words_of(x), shingle), exact_shingles(words_of(y), shingle), percent):
                    root[max(a, b)] = min(a, b)
                    u.append(ids[i])
                    v.append(ids[j])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=out) if u else None

        for batch in batches:
            for k in range(batch.num_rows):
                g, at = batch.column("g")[k].as_py(), batch.column("at")[k].as_py()
                if at < 0:
                    if group is not None and (found := close()) is not None:
                        yield found
                    group, ids, comps = g, batch.column("ids")[k].as_py(), batch.column("comps")[k].as_py()
                    pairs, sets = np.frombuffer(batch.column("pairs")[k].as_py(), "<u2").reshape(-1, 2), {}
                else:
                    text = batch.column("text")[k].as_py()
                    sets[at] = (shingle_hashes(words_of(text), shingle, known), text)
        if group is not None and (found := close()) is not None:
            yield found

    return dealt.mapInArrow(lean(run), spark_schema)


def percent_of(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |X and Y| >= percent * |X or Y| of sorted distinct arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The settled ``profiles`` of ``docs``, and ``(_mh_class, component_id, first)`` with the ``_mh_uid`` of each component's first row by id."""
    threshold = percent / 100
    told = settle(profiles(docs, shingle))
    have = told.where("_mh_class is not null")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_mh_uid").alias("u"))
    classes = settle(have.groupBy("_mh_class").agg(F.min("_mh_uid").alias("id"), F.min(order).alias("first"), F.first("_mh_sig").alias("sig")))
    sigs = classes.select("id", "sig")

    def make():
        def work(batch):
            return {"id": batch.column("id"), "keys": [*band_keys(_sigs(batch, "sig"))]}

        return work

    bands = map_columns(sigs, "id long, keys array<long>", make).select("id", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("m")).where("m > 1")
    members = settle(bands.join(settle(buckets), "key").select("key", "id", "low"))
    texts = told.select(F.col("_mh_uid").alias("id"), "text")
    stars = settle(members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    survivors = settle(prune(stars, sigs, threshold))
    links = settle(verify(survivors, texts, shingle, percent).distinct())
    roots = settle(components(links))
    placed = members.join(roots.select(F.col("node").alias("id"), F.col("root")), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    more = settle(crossing(placed, sigs, threshold))
    if not more.isEmpty():
        links = settle(links.unionByName(verify_blocks(more, texts, shingle, percent).distinct()))
        roots = settle(components(links))
    rooted = classes.select("_mh_class", "id", "first").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("_mh_class", F.coalesce("root", "id").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("of"))
    return told, settle(rooted.select("_mh_class", "root").join(named, "root").select("_mh_class", F.col("of.d").alias("component_id"), F.col("of.u").alias("first")))


@tidied
def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``."""
    told, groups = grouped(docs.select("doc_id", "text"), shingle, percent)
    named = F.col("first").isNotNull()
    return told.select("doc_id", "_mh_n", "_mh_class").join(groups, "_mh_class", "left").select(
        "doc_id",
        F.col("_mh_n").alias("n_shingles"),
        F.when(named, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(named, F.col("component_id").eqNullSafe(F.col("doc_id"))).otherwise(True).alias("kept"),
    )


@tidied
def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the first by doc_id (null ids last), whatever ids its rows share.

    Rows without words are in no group and stay.
    """
    told, groups = grouped(docs, shingle, percent)
    rest = told.select("_mh_uid", "_mh_class").where("_mh_class is not null").join(groups.select("_mh_class", "first"), "_mh_class").where("_mh_uid <> first")
    return without(told, "_mh_uid", settle(rest.select("_mh_uid"))).select(*docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair that shares a shingle compared: what bands and minima narrow down.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, low) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.low AS component_id, r.low = s.doc_id AS kept
FROM sizes s JOIN (SELECT node, min(low) AS low FROM reach GROUP BY node) r ON r.node = s.doc_id
"""
