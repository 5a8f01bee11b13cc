"""Words of whole columns of texts, split as text.word_array splits one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The blanks of text.clean_controls as spaces. No byte of a character beyond ASCII is among them.
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[0, 9, 10, 11, 12, 13]] = 32


def split_words(texts: pa.Array) -> pa.ListArray:
    """A list of words for each text; none for a null."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    clean = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_SPACES[raw]))
    parts = pc.split_pattern(clean, " ")
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64) - (parts.offsets[0].as_py() if n else 0)
    some = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), flat.filter(some))
