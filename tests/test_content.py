"""Results kept by content: nothing is asked or embedded twice, however a run ends."""

import os
import uuid

import numpy as np
import pytest

from causeway.functions import embedding as em
from causeway.operators.answer_log import infer_logged
from causeway.operators.content_vectors import embed_by_content
from causeway.plans import ingest


def _model(noted, breaks=(), fails=(), answer=str.upper):
    """A model that notes what it was asked in files, since it runs in other processes."""

    def load():
        def call(prompt, system):
            with open(f"{noted}/{uuid.uuid4().hex}", "w") as file:
                file.write(prompt)
            if prompt in breaks:
                raise KeyboardInterrupt("the executor is gone")
            if prompt in fails:
                raise OSError("busy")
            return answer(prompt)

        return call

    return load


def _asked(noted):
    return sorted(open(f"{noted}/{name}").read() for name in os.listdir(noted))


def _rows(df):
    return sorted((r["key"], r["response"], r["error"]) for r in df.collect())


def _prompts(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, prompt string")


@pytest.mark.parametrize("wave", [5, 1000])
def test_a_broken_run_goes_on_and_asks_no_answered_prompt_again(spark, tmp_path, wave):
    noted = tmp_path / "noted"
    noted.mkdir()
    texts = [f"question {i}" for i in range(40)]
    asked, log = _prompts(spark, texts), str(tmp_path / "log")
    with pytest.raises(Exception):
        infer_logged(asked, _model(noted, breaks={"question 17"}), log, per_task=1, wave=wave)
    first = _asked(noted)
    assert "question 17" in first and first.count("question 17") == 1  # local sessions try a task once
    got = infer_logged(asked, _model(noted), log, per_task=1, wave=wave)
    assert _rows(got) == sorted((str(i), t.upper(), None) for i, t in enumerate(texts))
    # What the broken tasks had in hand may come again: one prompt for each of the eight cores.
    again = [t for t in set(texts) if _asked(noted).count(t) > 1]
    assert len(again) <= 8 and set(_asked(noted)) == set(texts)
    before = len(_asked(noted))
    assert infer_logged(asked, _model(noted), log).count() == 40 and len(_asked(noted)) == before


def test_repeated_null_and_failed_prompts(spark, tmp_path):
    noted = tmp_path / "noted"
    noted.mkdir()
    asked, log = _prompts(spark, ["a", "a", None, "", "bad", "bad", None]), str(tmp_path / "log")
    quiet = lambda seconds: None
    got = infer_logged(asked, _model(noted, fails={"bad"}), log, tries=2, wait=quiet)
    failed = [("4", None, "OSError: busy"), ("5", None, "OSError: busy")]
    others = [("0", "A", None), ("1", "A", None), ("2", "", None), ("3", "", None), ("6", "", None)]
    assert _rows(got) == sorted(others + failed)
    assert _asked(noted) == ["", "a", "bad", "bad"]
    got = infer_logged(asked, _model(noted), log)
    assert _rows(got) == sorted(others + [("4", "BAD", None), ("5", "BAD", None)])
    assert _asked(noted) == ["", "a", "bad", "bad", "bad"]


def test_instructions_and_models_do_not_mix(spark, tmp_path):
    noted = tmp_path / "noted"
    noted.mkdir()
    asked, log = _prompts(spark, ["ab"]), str(tmp_path / "log")
    for system, name in [("x", ""), ("y", ""), ("x", "m"), ("x", ""), (None, "x")]:
        infer_logged(asked, _model(noted), log, system=system, name=name)
    assert _asked(noted) == ["ab"] * 4


def test_no_prompts_and_no_model(spark, tmp_path):
    none = _prompts(spark, ["a"]).limit(0)
    assert infer_logged(none, _model(tmp_path), str(tmp_path / "log")).columns == ["key", "prompt", "response", "error"]
    assert infer_logged(none, _model(tmp_path), str(tmp_path / "log")).count() == 0
    assert _rows(infer_logged(_prompts(spark, ["a"]), None, str(tmp_path / "log"))) == [("0", "", None)]


def _embedder(noted):
    def load():
        def encode(texts):
            for t in texts:
                with open(f"{noted}/{uuid.uuid4().hex}", "w") as file:
                    file.write(t)
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    return em.model_embedder(load)


def _chunks(spark, texts):
    rows = [("i", f"d{i // 3}", i // 3, f"c{i}", i % 3, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "investigation_id string, document_id string, doc_seq long, chunk_id string, chunk_index long, text string"
    )


def test_an_upload_with_one_changed_document_embeds_its_chunks_alone(spark, tmp_path):
    noted, store = tmp_path / "noted", str(tmp_path / "store")
    noted.mkdir()
    texts = [f"text {i // 2}" for i in range(12)] + [None, "", None]
    first = embed_by_content(_chunks(spark, texts), _embedder(noted), store)
    plain = em.embed_documents(_chunks(spark, texts), _embedder(tmp_path / "noted"))
    before = _asked(noted)
    assert sorted(before) == sorted({t or "" for t in texts})
    vectors = {r["chunk_id"]: r["embedding"] for r in first.collect()}
    assert vectors == {r["chunk_id"]: r["embedding"] for r in plain.collect()}
    before = len(_asked(noted))
    texts[3:6] = ["new 3", "new 4", "text 5"]
    second = embed_by_content(_chunks(spark, texts), _embedder(noted), store)
    assert second.count() == 15
    assert len(_asked(noted)) == before + 2 and {"new 3", "new 4"} <= set(_asked(noted))
    assert embed_by_content(_chunks(spark, texts).limit(0), _embedder(noted), store).count() == 0


def test_knowledge_with_a_store_equals_knowledge_without(spark, tmp_path):
    noted = tmp_path / "noted"
    noted.mkdir()
    chunks = _chunks(spark, ["redis timeout causes api failure", "api error", "api error"])
    kept = ingest.build_knowledge(chunks, embedder=_embedder(noted), rank=False, vectors=str(tmp_path / "v")).chunks
    assert len(_asked(noted)) == 2
    plain = ingest.build_knowledge(chunks, embedder=_embedder(noted), rank=False).chunks
    assert sorted(map(str, kept.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
