"""Op 11: blocks stay where they are written, and few of them are held at once."""

import pyarrow.parquet as pq
import pytest

from listingmill.llm import alignment
from tests.llm.test_alignment import plain, slowly, vocabularies


@pytest.mark.parametrize("most", [alignment.SENT_PAIRS, 10])
def test_blocks_are_shuffled_only_beyond_the_bound(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(alignment, "SENT_PAIRS", most)
    kept, write = [], alignment.materialize

    def written(df, label, *options):
        out = write(df, label, *options)
        kept.extend(out.inputFiles() if label == "aligned-blocks" else [])
        return out

    monkeypatch.setattr(alignment, "materialize", written)
    rows = [(i, f"one two {'three' * (i % 7)} {i} four five") for i in range(200)]
    out = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), *vocabularies(), block_chars=400)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (most == 10)
    assert [r[:-1] for r in plain(out)] == sorted([r[:-1] for r in slowly(rows)], key=repr)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 10 and max(sizes) <= alignment.AT_ONCE
