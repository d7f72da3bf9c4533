import pyarrow as pa

from quire.llm import bpe
from quire.llm.catalog import BYTE_BPE


def test_a_word_of_a_task_is_sent_once():
    """Of more different words than Spark sends rows at a time a hundredfold, each is counted and sent once."""
    texts = [" ".join(f"{'abcdefghij'[k % 10]}x{k}" for k in range(at, at + 10_000)) for at in range(0, 130_000, 10_000)]
    batches = (pa.RecordBatch.from_pydict({"text": texts[at : at + 5]}) for at in range(0, len(texts), 5))
    found = [w for b in bpe._counts(BYTE_BPE)(batches) for w in b.column("word").to_pylist()]
    assert len(found) == len(set(found))
    assert {" 7", " ax", "ax", " bx", "120000"} & set(found) and "ax0" not in found
