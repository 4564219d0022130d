"""What Python workers hold after their tasks."""

import pyarrow as pa
import public_tokenizers
from data import prose
from pyspark.sql import functions as F

from timeloom.llm import jaccard, spm

#: 62 MB are held, and 94 before workers gave anything back.
LIMIT_MB = 78


def resident():
    """A function for mapInArrow: the worker's own megabytes, without what it shares with files."""

    def run(batches):
        import re
        from pathlib import Path

        for _ in batches:
            pass
        found = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, found)) / 1024])], names=["mb"])

    return run


def test_workers_give_back_what_earlier_stages_held(spark):
    """Encoders of a stage that is over and freed batches stay in no worker that has run another stage's task."""
    texts = [(k, prose(k, 500, 400_000)) for k in range(2400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    expected = jaccard.signatures(docs, 5, jaccard.Banding(23, 6)).agg(F.sum("n_grams")).first()
    assert spm.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).agg(F.sum("n_tokens")).first()[0] > 1_000_000
    for _ in range(3):  # every worker that the encoder ran in gets a task
        assert jaccard.signatures(docs, 5, jaccard.Banding(23, 6)).agg(F.sum("n_grams")).first() == expected
    held = [r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(resident(), "mb double").collect()]
    assert max(held) < LIMIT_MB, held
