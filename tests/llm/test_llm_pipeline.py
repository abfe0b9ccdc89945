"""The pipeline's stages against plain versions, each on what the one before kept."""

import corpus_pipeline
import pandas as pd
import public_tokenizers as P
from plain import SMALL
from slatecast.llm.bpe import Codec, read_ranks
from slatecast.llm.decontaminate import normal
from test_llm_line_dedup import expected as lines
from test_llm_near_dedup import expected as near


def test_stages(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = [], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(llm, docs, SMALL)
        assert docs.columns == columns
        docs = llm.createDataFrame(docs.toPandas(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    all_rows = dict(pd.read_parquet(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False))
    assert set(kept[0]) <= set(all_rows) and len(kept[0]) >= 0.98 * len(all_rows)
    assert kept[1] == {i: t for i, t, *_ in lines(list(kept[0].items()))}
    assert set(kept[2]) == {r[0] for r in near(list(kept[1].items())) if r[3]}
    items = [normal(t).decode() for t in pd.read_parquet(f"{SMALL}/benchmark.parquet")["text"]]
    assert set(kept[3]) == {i for i, t in kept[2].items() if not any(f" {x} " in f" {normal(t).decode()} " for x in items)}
    codec = Codec(read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    out = corpus_pipeline.STAGES[-1][1](llm, docs, SMALL).collect()
    assert {r["doc_id"]: r["token_ids"] for r in out} == {i: codec.encode([t])[0].tolist() for i, t in kept[3].items()}


def test_run(llm):
    assert corpus_pipeline.run(llm, SMALL).count() > 100


def test_awkward_rows(llm, awkward, no_documents):
    for docs in (awkward, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(llm, docs, SMALL)
        docs.collect()
