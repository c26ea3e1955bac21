"""Arrow batches of texts as numpy arrays of word numbers, for the operators that work in tasks."""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task, whatever the size of the batch Spark sends.
SLICE_BYTES = 4 << 20
#: The same where the arrays made of a text take some twenty times its bytes: a Python worker stays as large as its largest slice.
SHORT_SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows whose texts (null: empty) have about ``limit`` bytes; one longer text is a run of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield _run(batch.slice(start, i - start), at)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield _run(batch.slice(start), at)
    give_back()


def _run(part: pa.RecordBatch, at: int) -> tuple[pa.RecordBatch, list[str]]:
    return part, [t or "" for t in part.column(at).to_pylist()]


def words_of(text: str) -> list[bytes]:
    """The words of a text: ``bytes.split`` cuts at exactly the ASCII white space x20, x09-x0D."""
    return text.encode().split()


def numbered(words: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts end to end, the texts' starts (one more than texts), and the distinct words by number.

    The words of one text at a time are held if ``words`` makes them one by one.
    """
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers = [np.zeros(0, np.int64), *(np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in words)]
    return np.concatenate(numbers), np.cumsum([len(x) for x in numbers]), list(vocabulary)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text; 0 for a text without values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
