"""``corpus_pipeline.run`` against plain versions of its stages."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as p
from tessera.llm import mixing, packing, pii, toxicity
from tests.llm.test_large_operators import brute_components, jaccard_links
from tests.llm.test_pii import WORD, brute, naive_spans
from tests.llm.test_small_operators import check_pieces
from tests.llm.test_toxicity import plain


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The small tables, and rows that share an id, have none, or repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(1, "an altogether different text of seven words", "en", "src1", 10), (1, "an altogether different text of seven words", "en", "src1", 10), (None, "no id at all but words to keep it", "en", None, 7), (None, "no id at all but words to keep it", "en", "src2", 7), (10**6, None, "en", "src3", None), (10**6 + 1, "", None, "src3", 0)]
    to = str(tmp_path_factory.mktemp("pipeline"))
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return to


def masked(texts):
    """Base spans and disclosing terms replaced, by brute force."""
    of, out = brute(texts), []
    for text in texts:
        base, terms = naive_spans(text), of(text)
        words = [m for m in re.finditer(WORD, text) if m[0].lower() in terms and not any(m.start() < e and s < m.end() for _, s, e in base)]
        new, at = "", 0
        for s, e, mask in sorted([(s, e, pii.MASKS[k]) for k, s, e in base] + [(*m.span(), "" if terms[m[0].lower()] >= pii.REMOVE else "[TERM]") for m in words]):
            if s >= at:
                new, at = new + text[at:s] + mask, e
            at = max(at, e)
        out.append(new + text[at:])
    return out


def test_run_equals_plain_stages(spark, folder):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in docs.collect() if plain(r.text or "", chain)[-1] < toxicity.THRESHOLD]
    _, links = jaccard_links([r.text for r in rows], 5, 80)
    roots = brute_components(len(rows), links)
    first = {}
    for i, root in enumerate(roots):
        first[root] = min(first.get(root, i), i, key=lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0))
    kept = [rows[i] for i in sorted(first.values())]
    assert len(kept) < len(rows) and Counter(r.doc_id for r in kept)[1] == 2 and Counter(r.doc_id for r in kept)[None] == 1
    texts = masked([r.text or "" for r in kept])
    # the mix: whole repetitions, and one cut repetition at most
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    planned = defaultdict(list)
    frame = spark.createDataFrame([(r.doc_id, t, r.source) for r, t in zip(kept, texts, strict=True)], "doc_id long, text string, source string")
    for r in mixing.plan_mix(frame).collect():
        planned[r.doc_id, r.text].append(r._mix_taken)
    by_source = defaultdict(int)
    for r, n in zip(kept, sizes, strict=True):
        by_source[r.source] += n
    mixed = []
    for r, t, n in zip(kept, texts, sizes, strict=True):
        taken = planned[r.doc_id, t].pop()
        assert taken <= 3 * n
        if not n:
            mixed.append((r.doc_id, t))
            continue
        mixed += [(r.doc_id, t)] * (taken // n)
        if taken % n:
            mixed.append((r.doc_id, re.match(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){{{taken % n}}}", t)[0]))
    got = p.run(spark, folder).collect()
    windows, tokens = check_pieces(got, mixed, Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)))
    assert tokens / (1024 * windows) > 0.97


def test_stages_in_order(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "minhash", "pii", "mixing", "packing"] and p.ORACLE_SQL is None
