"""Vectors are stored once; they are moved to find that out only if a key comes twice."""

from causeway.sources import tables


def test_whole_rows_are_compared_only_if_a_key_comes_twice(spark, tmp_path, monkeypatch):
    rows = [("i", "d", f"c{n}", 0, n, "text", [1.0, float(n)]) for n in range(5)]
    names = ["investigation_id", "document_id", "chunk_id", "doc_seq", "chunk_index", "text", "embedding"]
    chunks = spark.createDataFrame(rows, names)
    calls, real = [], type(chunks).dropDuplicates
    monkeypatch.setattr(type(chunks), "dropDuplicates", lambda df, *a: (calls.append(a), real(df, *a))[1])
    tables.write_vectors(chunks, str(tmp_path / "a"))
    assert calls == []
    assert tables.read_vectors(spark, str(tmp_path / "a")).count() == 5
    again = chunks.unionByName(chunks.filter("chunk_index < 2"))
    tables.write_vectors(again, str(tmp_path / "b"))
    assert len(calls) == 1
    tables.write_vectors(again, str(tmp_path / "b"))
    assert sorted(r.chunk_id for r in tables.read_vectors(spark, str(tmp_path / "b")).collect()) == [f"c{n}" for n in range(5)]
