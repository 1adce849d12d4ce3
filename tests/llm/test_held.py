import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from heronq.llm import held

SPREAD = np.uint64(0x9E3779B97F4A7C15)


@pytest.mark.parametrize("buckets", [1, 5])
@pytest.mark.parametrize("twice", [False, True])
def test_repeated_tokens_of_each_owner(buckets, twice):
    """Whatever the chunks: tokens that another owner holds, or the same one twice. Copies of an owner in other chunks are the same owner."""
    rng = np.random.default_rng(buckets)
    tokens = [np.sort(rng.integers(0, 90, 12).astype(np.uint64) * SPREAD) for _ in range(12)]
    if not twice:
        tokens = [np.unique(t) for t in tokens]
    numbers = [5, -7, 2**62, *range(100, 109)]
    chunks = [[0, 1, 2, 3], [4, 5, 6], [7, 8, 0], [9], [10, 11]]
    for counts in (True, False):
        rows = pa.Table.from_batches([held.chunk_postings([tokens[i] for i in c], [numbers[i] for i in c], buckets, counts) for c in chunks])
        packed = pa.concat_tables([held.repeated_in(rows.filter(pc.equal(rows["bucket"], k)), counts, 3) for k in range(buckets)])
        got = {}
        for k in range(3):
            if (some := packed.filter(pc.equal(packed["part"], k))).num_rows:
                for r in held.gathered(some, counts).to_pylist():
                    assert r["owner"] not in got and r["owner"] % 3 == k
                    got[r["owner"]] = r["c"] if counts else set(held.unshort(np.frombuffer(r["tokens"], np.uint8).reshape(-1, 5)).tolist())
        for i, mine in enumerate(tokens):
            repeated = [t for t in mine if (mine == t).sum() > 1 or any(t in tokens[j] for j in range(12) if j != i)]
            if not counts:
                assert got.get(numbers[i], set()) == {int(t & held.SENT) for t in repeated}
            elif i:
                assert got.get(numbers[i], 0) == len(repeated)
            else:  # it stands in two chunks: what both know counts twice, never less
                assert got.get(numbers[i], 0) >= len(repeated)


def test_one_chunk_of_repeated_tokens():
    rows = held.chunk_postings([np.array([3, 3], np.uint64) * SPREAD], [9], 4, False)
    assert pa.Table.from_batches([rows]).num_rows == 2
    assert held.gathered(held.repeated_in(pa.Table.from_batches([rows]), False, 2), False).to_pylist()[0]["owner"] == 9
