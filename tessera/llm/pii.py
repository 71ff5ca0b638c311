"""PII: exact base patterns, and terms that reveal them by corpus co-occurrence.

Base kinds are e-mail addresses, IP addresses, payment cards and phone numbers.
Each distinct value is a protected entity. Every word of a document that holds
an entity is a candidate term, whatever its length and wherever it stands. Over
all documents,

    disclosure(term, entity) = log2(p(entity, term) / (p(entity) p(term))) / -log2 p(entity)

is the share of the entity's information content that the term gives away: 1
if the term never occurs without it, 0 if independent. Terms that share at
least ``MIN_DOCS`` documents with the entity are removed from ``REMOVE`` on, and
generalised to a placeholder from ``GENERALISE`` on, at every occurrence outside
base spans in the documents that hold the entity.

With ``everywhere`` (the query and the pipeline) terms that give an entity away
almost for certain, from REMOVE on with ``EVIDENCE`` documents, are removed from
all other documents too, and equal texts count once, so that copies of one text
are no evidence. Weaker terms stay there: of a word that is in 2 of 40 documents
beside the entity, the other 38 say nothing about it. (Masking all terms in all
documents was tried: it changed a fifth of the documents that hold no personal
data, by words that two texts share by chance.)

Nothing is lost to pruning: an entity of fewer than MIN_DOCS documents has no
term of that many, and as both <= n_entity, a term of more than
n (n_entity / n) ^ GENERALISE documents stays below GENERALISE. Entities of the
same documents (by number and two 64-bit sums over them) share all their
counts, so pairs are counted for one of them: copies of a text full of
addresses cost its words once, not times its addresses.

Document frequencies and pair counts are exact: Bloom filters of fixed size
(8 MB each, whatever the corpus) of entities, terms and pairs are all that is
broadcast; they thin the words of each document before they are counted and
joined exactly. A word counts once a document, inside base spans too.

Defined results: null text is empty; repeated rows are documents each (so words
that only copies of one text hold beside an entity disclose it); of equal shares
the same is done to each term, and a term of several entities goes by its
greatest share; overlapping spans are masked as one, by the first's mask; working
columns are prefixed ``_pii_``, so columns of any other name are safe; an empty
table gives an empty result; texts of any length are scanned whole by patterns
that cannot backtrack beyond a match's own length, and spans are met by sorted
search.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOOM_BITS, SLICE_ROWS, arrow_schema, bloom, lean, map_columns, settle, texts_of, tidied, with_few, without

KINDS = ("email", "ip", "card", "phone")
MIN_DOCS = 2
#: Documents that hold both, for a term to be removed where the entity isn't.
EVIDENCE = 3
GENERALISE, REMOVE = 0.75, 0.95
#: Distinct terms, or pairs, that a task counts before it hands them on.
TERMS_HELD = 1 << 17

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Runs of ASCII letters and anything beyond ASCII.
TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: The same on UTF-8 bytes: lower-case ASCII, and all other ASCII to spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; the part before the @ is what precedes it of its class, after the last match."""
    done = 0
    for m in DOMAIN.finditer(text):
        before = text[done : m.start()]
        start = done + len(before.rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
            done = m.end()
        else:
            done = m.start() + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def words_of(text: str) -> list[bytes]:
    """The distinct terms of a text."""
    return [*{*text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()}]


def passing(bits: np.ndarray, keys: list[bytes]) -> list[bytes]:
    """The keys that may be in a Bloom filter."""
    at = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)) % np.uint64(BLOOM_BITS)
    hit = bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
    return [keys[i] for i in np.flatnonzero(hit).tolist()]


def hashed(*names: str) -> Column:
    """The hash of ``passing`` for a column, or for columns with a zero byte between."""
    return F.xxhash64(F.concat_ws("\0", *names).cast("binary"))


def occurrences(text: str, words: set[bytes], spans: list[tuple[int, int]]) -> dict[bytes, list[tuple[int, int]]]:
    """(start, end) of the words outside all spans."""
    spans = sorted(spans)
    starts, ends = [s for s, _ in spans], [*accumulate((e for _, e in spans), max)]
    out = {}
    for m in TERM.finditer(text):
        s, e = m.span()
        if (w := text[s:e].encode("utf-8", "surrogatepass").lower()) in words:
            i = bisect_left(starts, e)
            if not i or ends[i - 1] <= s:
                out.setdefault(w, []).append((s, e))
    return out


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Per row: ``_pii_uid``, the columns ``keep``, counts, base spans, distinct entities, and the whole text; settled."""

    def make():
        def work(batch):
            cols = {n: [] for n in ("_pii_n", "_pii_base", "_pii_entities", "_pii_digest")}
            for text in texts_of(batch):
                cols["_pii_digest"].append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                spans = base_spans(text)
                kinds = Counter(k for k, _, _ in spans)
                cols["_pii_n"].append([kinds[k] for k in KINDS])
                cols["_pii_base"].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                cols["_pii_entities"].append([*dict.fromkeys(f"{k}:{text[s:e].lower()}" for k, s, e in spans)])
            return cols | {n: batch.column(n) for n in kept} | {"_pii_text": batch.column("text")}

        return work

    kept = ["_pii_uid", *keep]
    types = {n: docs.schema[n].dataType.simpleString() for n in keep}
    ddl = ", ".join(["_pii_uid long", *(f"`{n}` {t}" for n, t in types.items()), "_pii_n array<long>, _pii_base string, _pii_entities array<string>, _pii_digest binary, _pii_text string"])
    with_uid = docs.withColumn("_pii_uid", F.monotonically_increasing_id())
    return settle(map_columns(with_uid.select("_pii_uid", *dict.fromkeys([*keep, "text"])), ddl, make))


def counted(rows: DataFrame, ddl: str, keys: Callable[[pa.RecordBatch], Iterator]) -> DataFrame:
    """Of the ``keys`` (tuples of bytes) of all rows: columns of ``ddl``, the last of them how often a key came, by task.

    Tasks count before the shuffle, so it holds a row a key and task at most
    (or a flush, for more than TERMS_HELD keys), not one a document's word.
    """
    spark_schema, out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def flush() -> pa.RecordBatch:
            cols = [[k[i].decode("utf-8", "surrogatepass") for k in held] for i in range(len(out) - 1)] + [list(held.values())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for some in keys(batch.slice(start, SLICE_ROWS)):
                    held.update(some)
                    if len(held) > TERMS_HELD:
                        yield flush()
        yield flush()

    return rows.mapInArrow(lean(run), spark_schema)


def bits_of(shared) -> np.ndarray:
    return np.frombuffer(shared.value, np.uint64)


def document_frequency(scanned: DataFrame) -> DataFrame:
    """``(term, df)``: in how many documents each word of the corpus stands."""

    def keys(batch: pa.RecordBatch) -> Iterator:
        for text in texts_of(batch, "_pii_text"):
            yield [(w,) for w in words_of(text)]

    return counted(scanned.select("_pii_text"), "term string, n long", keys).groupBy("term").agg(F.sum("n").alias("df"))


def entities_of(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for text, entities in zip(batch.column("_pii_text").to_pylist(), batch.column("_pii_entities").to_pylist(), strict=True):
        yield text, [e.encode() for e in entities]


def distinct_texts(scanned: DataFrame) -> DataFrame:
    """The first row of every text."""
    firsts = settle(scanned.groupBy("_pii_digest").agg(F.min("_pii_uid").alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = scanned.select("_pii_uid", "_pii_digest").join(firsts, "_pii_digest").where("_pii_uid <> first").select("_pii_uid")
    return without(scanned, "_pii_uid", settle(again))


def shares(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entity, of)``, where ``of`` stands for all entities of the same documents, and ``(of, term, both, disclosure)`` from GENERALISE on; settled."""
    context = scanned.sparkSession.sparkContext
    total = scanned.count()
    holding = scanned.where(F.size("_pii_entities") > 0).select("_pii_text", "_pii_entities")
    by_entity = scanned.select("_pii_uid", F.explode("_pii_entities").alias("entity")).groupBy("entity")
    same = ("n_entity", "x", "y")
    alone = settle(by_entity.agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("_pii_uid")).alias("x"), F.bit_xor(F.xxhash64("_pii_uid", F.lit(7))).alias("y")).where(F.col("n_entity") >= MIN_DOCS))
    heads = settle(alone.groupBy(*same).agg(F.min("entity").alias("of")))
    repeated = context.broadcast(bloom(heads, hashed("of")))

    most = total * ((heads.agg(F.max("n_entity")).head()[0] or 0) / max(total, 1)) ** GENERALISE * (1 + 1e-9)
    df = settle(document_frequency(scanned).where((F.col("df") >= MIN_DOCS) & (F.col("df") <= most)))
    rare = context.broadcast(bloom(df, hashed("term")))

    def pairs_of(batch: pa.RecordBatch) -> Iterator:
        for text, entities in entities_of(batch):
            if found := passing(bits_of(repeated), entities):
                words = passing(bits_of(rare), words_of(text))
                for entity in found:
                    yield [(entity, w) for w in words]

    pairs = counted(holding, "of string, term string, n long", pairs_of)
    pairs = pairs.groupBy("of", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= MIN_DOCS)
    n = F.lit(float(total))
    gain = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("df")))
    content = -F.log2(F.col("n_entity") / n)
    share = F.when(content > 0, gain / content).otherwise(0.0)
    found = pairs.join(heads, "of").join(df, "term").withColumn("disclosure", share).where(F.col("disclosure") >= GENERALISE)
    return settle(alone.join(heads, [*same]).select("entity", "of")), settle(found.select("of", "term", "both", "disclosure"))


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``(entity, term, disclosure)`` from GENERALISE on, settled: every pair of ``docs``, ``scanned`` before."""
    members, found = shares(scanned)
    return settle(found.join(members, "of").select("entity", "term", "disclosure"))


def emitted(cols: tuple, out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)


def spans_of(base: str) -> list[tuple[int, int]]:
    return [(int(s), int(e)) for _, s, e in (x.split(":") for x in base.split(","))] if base else []


def placed(at: list[tuple[int, int]]) -> list[dict]:
    return [{"s": s, "e": e} for s, e in at]


def hits_with_entity(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """``_pii_uid, term, at, disclosure``: terms in the documents that hold an entity that they disclose.

    ``found`` are pairs of ``shares``: of the entities that are always together, one stands for all.
    """
    context = scanned.sparkSession.sparkContext
    heads, shared = (context.broadcast(bloom(found, hashed(*names))) for names in (("of",), ("of", "term")))
    spark_schema, out = arrow_schema("_pii_uid long, of string, term string, at array<struct<s:long,e:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = bits_of(heads), bits_of(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for uid, (text, entities), base in zip(part.column("_pii_uid").to_pylist(), entities_of(part), part.column("_pii_base").to_pylist(), strict=True):
                    if not (some := passing(known, entities)):
                        continue
                    words = words_of(text)
                    met = {e: [k[len(e) + 1 :] for k in passing(bits, [e + b"\0" + w for w in words])] for e in some}
                    at = occurrences(text, {w for own in met.values() for w in own}, spans_of(base))
                    for entity, own in met.items():
                        if own := [w for w in own if w in at]:
                            yield emitted(([uid] * len(own), [entity.decode()] * len(own), [w.decode("utf-8", "surrogatepass") for w in own], [placed(at[w]) for w in own]), out)

    rows = scanned.where(F.size("_pii_entities") > 0).select("_pii_uid", "_pii_text", "_pii_entities", "_pii_base")
    return rows.mapInArrow(lean(run), spark_schema).join(found.select("of", "term", "disclosure"), ["of", "term"]).select("_pii_uid", "term", "at", "disclosure")


def hits_everywhere(scanned: DataFrame, terms: DataFrame) -> DataFrame:
    """``_pii_uid, term, at, disclosure``: the ``terms(term, disclosure)`` in all documents."""
    shared = scanned.sparkSession.sparkContext.broadcast(bloom(terms, hashed("term")))
    spark_schema, out = arrow_schema("_pii_uid long, term string, at array<struct<s:long,e:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part, cols = batch.slice(start, SLICE_ROWS), ([], [], [])
                for uid, text, base in zip(part.column("_pii_uid").to_pylist(), texts_of(part, "_pii_text"), part.column("_pii_base").to_pylist(), strict=True):
                    if some := passing(bits, words_of(text)):
                        for w, at in occurrences(text, {*some}, spans_of(base)).items():
                            for c, v in zip(cols, (uid, w.decode("utf-8", "surrogatepass"), placed(at)), strict=True):
                                c.append(v)
                if cols[0]:
                    yield emitted(cols, out)

    return scanned.select("_pii_uid", "_pii_text", "_pii_base").mapInArrow(lean(run), spark_schema).join(terms, "term")


def find(docs: DataFrame, keep: list[str], everywhere: bool = False) -> DataFrame:
    """``scan`` plus ``_pii_terms``: the disclosing terms' spans by start."""
    scanned = scan(docs, keep)
    found = shares(distinct_texts(scanned) if everywhere else scanned)[1]
    hits = hits_with_entity(scanned, found)
    if everywhere:
        strong = found.where((F.col("both") >= EVIDENCE) & (F.col("disclosure") >= REMOVE)).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
        hits = hits.unionByName(hits_everywhere(scanned, settle(strong)))
    by_row = (
        hits.groupBy("_pii_uid", "term").agg(F.first("at").alias("at"), F.max("disclosure").alias("disclosure"))
        .select("_pii_uid", F.transform("at", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.col("disclosure"))).alias("at"))
        .groupBy("_pii_uid")
        .agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("_pii_terms"))
    )
    return with_few(scanned.drop("_pii_entities", "_pii_digest"), "_pii_uid", settle(by_row))


MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace the spans (start, end, by); overlapping ones as one, by the first's mask."""
    out, at = [], 0
    spans = sorted(spans)
    i = 0
    while i < len(spans):
        start, end, mask = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


@tidied
def sanitise(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """``docs`` with personal data masked and disclosing terms generalised or removed."""
    names = docs.columns
    others = [n for n in names if n != "text"]
    found = find(docs, others, everywhere)

    def make():
        def work(batch):
            texts = []
            for text, base, terms in zip(batch.column("_pii_text").to_pylist(), batch.column("_pii_base").to_pylist(), batch.column("_pii_terms").to_pylist(), strict=True):
                spans = [(int(s), int(e), MASKS[k]) for k, s, e in (x.split(":") for x in base.split(","))] if base else []
                spans += [(t["s"], t["e"], "" if t["disclosure"] >= REMOVE else "[TERM]") for t in terms or []]
                texts.append(redact(text, spans) if spans and text else text)
            return {n: batch.column(n) for n in others} | {"text": texts}

        return work

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_columns(found.select(*others, "_pii_text", "_pii_base", "_pii_terms"), ddl, make)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in names else out


@tidied
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"], everywhere=True)
    terms = F.array_join(F.transform("_pii_terms", lambda t: F.concat(F.lit("term:"), t["s"], F.lit(":"), t["e"])), ",")
    return found.select(
        "doc_id",
        *(F.col("_pii_n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2("_pii_base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("_pii_base") != "", F.col("_pii_base")), F.when(F.size("_pii_terms") > 0, terms)).alias("spans"),
        F.when(F.col("_pii_terms").isNotNull(), F.size("_pii_terms")).otherwise(0).cast("long").alias("n_terms"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
