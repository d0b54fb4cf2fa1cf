"""The pipeline stage by stage, each on its own input, against plain versions."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm import brute

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("_id", pa.string()), ("size", pa.int64())])


def tables(folder, docs):
    """The tables that the stages read, documents with columns of clashing names."""
    labels = [{"doc_id": r["doc_id"], "quality": 1, "toxic": int("idiot" in (r["text"] or ""))} for r in docs if r["doc_id"] is not None]
    items = [{"item_id": 1, "text": " ".join(f"q{i}" for i in range(20))}, {"item_id": 2, "text": None}]
    pq.write_table(pa.Table.from_pylist(docs, SCHEMA), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    pq.write_table(pa.Table.from_pylist(items, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")
    return items


def corpus():
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [words(i, 40) + ".\n" + words(100 + i, 30) for i in range(24)]
    texts += [words(0, 40) + " more.\n" + words(300, 5), "a line that many texts share, word for word\n" + words(200, 60), "a line that many texts share, word for word\n" + words(201, 60)]
    texts += [words(202, 30) + " " + " ".join(f"q{i}" for i in range(20)), texts[3], None, "", " \n ", "you idiot, you IDIOT!! " * 8]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": ["a", "b", None][i % 3], "n_chars": len(t or ""), "_id": "k", "size": -1} for i, t in enumerate(texts)]
    return [*rows, rows[5] | {"doc_id": 90}, rows[6] | {"doc_id": None}, rows[27] | {"doc_id": None, "text": words(203, 30) + rows[27]["text"][-80:]}]


def plain(rows):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]


def test_stages(spark, tmp_path):
    docs = corpus()
    items = tables(tmp_path, docs)
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    by_id = {r["doc_id"]: r["text"] for r in docs}

    def kept(name, given):
        out = stages[name](spark, given, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert {r["_id"] for r in out.collect()} <= {"k"}
        assert name == "mixing" or out.columns == frame.columns
        return out

    clean = kept("toxicity", frame)
    assert clean.count() >= len(docs) - 3 and {r.doc_id: r.text for r in clean.collect()}.items() <= by_id.items()
    lines = kept("line dedup", clean)
    left = {r.doc_id: r.text for r in lines.collect()}
    assert sum("a line that many texts share" in (t or "") for t in left.values()) == 1
    near = kept("near duplicates", lines)
    rows = [(r.doc_id, r.text) for r in lines.collect() if r.doc_id is not None]
    later = {d for d, _, c in brute.near_groups(rows, 5, 80) if c != d}
    ids = sorted(r.doc_id for r in near.collect() if r.doc_id is not None)
    assert ids == sorted(d for d, _ in rows if d not in later)
    pure = kept("decontamination", near)
    rows = [(r.doc_id, r.text) for r in near.collect()]
    leaked = {x[0] for x in brute.leaks([r for r in rows if r[0] is not None], [(i["item_id"], i["text"]) for i in items])}
    assert sorted(r.doc_id for r in pure.collect() if r.doc_id is not None) == sorted(d for d, _ in rows if d is not None and d not in leaked) and leaked
    assert not any("q5 q6 q7" in (r.text or "") for r in pure.collect())
    mixed = kept("mixing", pure).collect()
    assert mixed and all(0 < r.taken <= 2 * r["size"] for r in mixed) and {r.doc_id for r in mixed} <= {r.doc_id for r in pure.collect()}


@pytest.mark.parametrize("docs", [[], [{"doc_id": 1, "text": None}, {"doc_id": None, "text": ""}]])
def test_little_or_nothing(spark, tmp_path, docs):
    tables(tmp_path, [dict.fromkeys(SCHEMA.names) | d for d in docs])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
