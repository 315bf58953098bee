"""Each stage of the pipeline against plain Python on the stage's own input."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from hostlake.llm import byte_bpe

from tests.llm.conftest import components, contamination, frame, lines


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(engine, sf_dir):
    docs = engine.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in engine.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in engine.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    stages = [f for _, f in pipeline.STAGES]

    kept = stages[0](engine, docs, sf_dir).cache()
    ids = {d for d, _ in texts(kept)}
    clean = [d for d, v in labels.items() if v == (1, 0)]
    assert sum(d in ids for d in clean) >= 0.95 * len(clean)
    assert set(texts(kept)) <= set(texts(docs))

    after = stages[1](engine, kept, sf_dir).cache()
    want = {(d, t) for d, n, dropped, t in lines(texts(kept)) if dropped == 0 or t}
    assert set(texts(after)) == want
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0

    single = stages[2](engine, after, sf_dir).cache()
    assert {d for d, _ in texts(single)} == {d for d, n, c in components(texts(after), 5) if not n or d == c}

    unseen = stages[3](engine, single, sf_dir).cache()
    assert {d for d, _ in texts(unseen)} == {d for d, _, hit, _ in contamination(texts(single), items) if not hit}
    for df in (kept, after, single, unseen):
        assert df.columns == pipeline.COLUMNS

    coded = stages[4](engine, unseen, sf_dir)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(pipeline.BYTE_RANKS), special_tokens={})
    assert {(r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in coded.collect()} == {(d, tuple(known.encode_ordinary(t)), True) for d, t in texts(unseen)}


def test_stages_of_awkward_rows(engine, rows, sf_dir):
    docs = frame(engine, [*rows, rows[8], (None, None)], ["hits", "accepted"])
    for name, stage in pipeline.STAGES:
        made = stage(engine, docs, sf_dir)
        assert made.count() > 0, name
        if name != pipeline.STAGES[-1][0]:
            assert made.columns == pipeline.COLUMNS
            docs = made
