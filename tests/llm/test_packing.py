"""Packing: the fill over many partitions, equal rows, and numbers that repeat."""

from tessera.llm import packing
from tests.llm.test_small_operators import check_pieces


def test_fill_holds_over_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    few, many = (packing.pack(docs.repartition(n, "doc_id")).collect() for n in (2, 100))
    for rows in (few, many):
        windows, tokens = len({r.sequence_id for r in rows}), sum(r.length for r in rows)
        assert tokens / (1024 * windows) > 0.99
    piece = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert piece(few) == piece(many)


def test_equal_rows_and_other_columns(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = [(1, "same words here")] * 300 + [(None, None)] * 20 + [(None, "x " * 3000)] * 2 + [(2, "y " * 700)] * 3
    df = spark.createDataFrame([(*t, 1, "s") for t in texts], "doc_id long, text string, fill int, sequence_id string").repartition(9)
    rows = packing.pack(df).collect()
    check_pieces(rows, texts, Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)))
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(df).collect()))
