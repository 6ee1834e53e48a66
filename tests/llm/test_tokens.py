import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.llm import tokenfile as F3
from brindle.llm import tokens as T

EDGES = ["", "a", " ", "\n", "  two  spaces ", "tab\tand\r\nlines\n\n\n", "it's we'll 'd", "über Größe 漢字かな 🎉🎉", "no break   sep 　wide  x", "12345 67,89.0", "<|endoftext|> stays text", "x" * 3000, "\x00\x01", " " * 500 + "end"]


@pytest.fixture(scope="module")
def own():
    with open(T.VOCABULARY, "rb") as file:
        return T.encoder(file.read())


def test_cutting_never_changes_ids(own):
    random.seed(2)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", " ", "　", "'s", "1", "é", "漢", "."]
    for text in EDGES + ["".join(random.choices(alphabet, k=200)) for _ in range(200)]:
        for most in (1, 3, 17, 100):
            pieces = T.safe_pieces(text, most)
            assert "".join(pieces) == text
            assert [t for p in pieces for t in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_counts_equal_whole_encoding(spark, own, prose):
    long = prose(80_000)
    rows = list(enumerate([*EDGES, long, None])) + [(None, "null id"), (0, "again"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens")
    found = sorted(map(tuple, T.token_counts(docs).collect()), key=str)
    assert found == sorted([(d, None if t is None else len(own.encode_ordinary(t))) for d, t in rows], key=str)
    assert T.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_tables_round_trip(spark, own, prose, tmp_path, encoding):
    rows = [(i, t, "de") for i, t in enumerate(EDGES)] + [(100 + i, prose(40), None) for i in range(3000)] + [(9000, None, "x"), (None, "null id", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    path = str(tmp_path / "t")
    F3.write_tokens(docs, path, metadata=["lang"], encoding=encoding, page_rows=500)
    table = spark.read.parquet(path)
    assert table.columns == ["doc_id", "lang", "n_tokens", "token_ids"]
    back = table.select("doc_id", F3.decode_column(spark)("token_ids").alias("text"), "lang")
    assert back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    counts = {(r.doc_id, r.lang, r.n_tokens) for r in F3.read_metadata(spark, path).collect()}
    assert counts == {(d, lang, None if t is None else len(own.encode_ordinary(t))) for d, t, lang in rows}
    some = F3.read_tokens(spark, path, 150, 160)
    assert sorted(r.doc_id for r in some.collect()) == list(range(150, 161))
    assert "ReadSchema: struct<doc_id:bigint,token_ids:array<int>>" in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata.row_group(0)
    ids = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema.startswith("token_ids"))
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
    assert meta.column(0).has_offset_index and meta.column(0).has_column_index


def test_page_indexes_let_a_reader_skip_pages(spark, prose, tmp_path):
    """By the page index a condition on doc_id leaves a page's rows of the file's."""
    first = 10_000_000_000
    docs = spark.createDataFrame([(first + i, prose(20)) for i in range(6000)], "doc_id long, text string").coalesce(1)
    F3.write_tokens(docs, str(tmp_path / "t"), encoding="delta", page_rows=200)
    (file,) = (tmp_path / "t").glob("*.parquet")
    jvm = spark._jvm
    api, doc = jvm.org.apache.parquet.filter2.predicate.FilterApi, jvm.org.apache.parquet.filter2.predicate.FilterApi.longColumn("doc_id")
    some = getattr(api, "and")(api.gtEq(doc, first + 3000), api.ltEq(doc, first + 3010))
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration())
    options = jvm.org.apache.parquet.ParquetReadOptions.builder().withRecordFilter(jvm.org.apache.parquet.filter2.compat.FilterCompat.get(some)).useColumnIndexFilter(True).build()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source, options)
    assert reader.getRecordCount() == 6000 and 11 <= reader.getFilteredRecordCount() <= 400
    reader.close()


def test_token_table_refuses_and_takes_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError):
        F3.write_tokens(docs, str(tmp_path / "x"), metadata=["n_tokens"])
    with pytest.raises(ValueError):
        F3.write_tokens(docs, str(tmp_path / "x"), encoding="zip")
    F3.write_tokens(docs, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 0


def test_batches_are_balanced_by_bytes(own, prose):
    random.seed(7)
    texts = [prose(random.choice((1, 5, 60, 900))) for _ in range(300)] + [None, "", "é" * 900, "z " * 9000]
    runs = list(T.batches(texts, 4000))
    assert [(r, p) for run in runs for r, p in run] == [(r, p) for r, t in enumerate(texts) for p in (T.safe_pieces(t) if t else [])]
    size = [sum(len(p.encode()) for _, p in run) for run in runs]
    assert all(n <= 4000 or len(run) == 1 for n, run in zip(size, runs)) and all(a + b > 4000 for a, b in zip(size, size[1:]))
    assert max(map(len, runs)) > 10


def test_a_batch_counts_each_text_by_itself(own):
    for texts in (EDGES, EDGES[::-1], [*EDGES, f"a {T.BREAK} b", T.BREAK], ["end ", " begin", "", "it", "'s", "  ", "  "]):
        ids, many = T._encoded(own, texts)
        each = [own.encode_ordinary(t) for t in texts]
        assert many.tolist() == [len(x) for x in each] and ids.tolist() == [t for x in each for t in x]
