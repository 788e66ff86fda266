import pyarrow as pa

from tidewell.llm import textbatch


def batch(*texts):
    return pa.record_batch({"n": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_slices_hold_so_many_bytes_or_one_row():
    rows = batch("aa", None, "bbb", "", "c" * 50, "dd", "é")
    parts = [p.column("text").to_pylist() for p in textbatch.slices(rows, "text", 5)]
    assert parts == [["aa", None, "bbb", ""], ["c" * 50], ["dd", "é"]]
    assert list(textbatch.slices(rows.slice(0, 0), "text", 5)) == []
    assert [p.num_rows for p in textbatch.slices(rows.slice(2), "text", 1 << 20)] == [5]


def test_gathered_batches_keep_all_rows_in_order():
    parts = [batch(*["x" * i] * 3) for i in range(20)]
    out = list(textbatch.gathered(iter(parts), "text", 200))
    assert 1 < len(out) < 20 and [t for b in out for t in b.column("text").to_pylist()] == [t for b in parts for t in b.column("text").to_pylist()]
    assert list(textbatch.gathered(iter([]), "text", 1)) == []


def test_rows_are_numbered(spark):
    plain = spark.createDataFrame([(3, "b"), (1, "a"), (2, None)], "doc_id int, text string")
    rows, is_id = textbatch.numbered(plain)
    assert is_id and all(r._row == r.doc_id for r in rows.collect()) and all(r._row == r.doc_id for r in textbatch.identified(plain).collect())
    odd = spark.createDataFrame([(3, "b"), (None, "a"), (3, "a"), (3, "a"), (None, None)], "doc_id int, text string").repartition(3)
    rows, is_id = textbatch.numbered(odd)
    assert not is_id and [(r.doc_id, r.text) for r in rows.orderBy("_row").collect()] == [(3, "a"), (3, "a"), (3, "b"), (None, None), (None, "a")]
    own = textbatch.identified(odd).collect()
    assert len({r._row for r in own}) == 5
