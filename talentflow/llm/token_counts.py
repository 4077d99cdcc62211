"""Token counts without ids (operator 10).

A pre-token here is a run of bytes other than ASCII white space. The tokenizer drops
white space and never builds a piece across it, so that the number of a text's pieces is
the sum over its pre-tokens. Each batch of documents is cut into pre-tokens, its distinct
pre-tokens are counted once each (a memo of bounded size carries them from batch to
batch), and their piece counts are joined to the per-document pre-token frequencies and
summed. No ids of a text are ever held.

Scale: the join is local to the batch, so nothing is shuffled; memory is one slice of
text, its distinct pre-tokens and the memo (``MEMO`` entries).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import map_arrow

MEMO = 400_000
SLICE = 8 << 20


class PieceCounter:
    """Pieces per pre-token for a ``tokenizers`` JSON; special strings inside a pre-token are
    handled as the library does by default."""

    def __init__(self, spec: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.keys = np.zeros(0, np.uint64)   # sorted hashes of known pre-tokens
        self.known = np.zeros(0, np.int32)
        self.memo = memo

    def lengths(self, texts: list[str]) -> np.ndarray:
        enc = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter((len(e) for e in enc), np.int32, len(texts))

    def counts(self, data, starts, ends, hashes) -> np.ndarray:
        """Piece count of each word; every distinct one is tokenized once."""
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.full(len(keys), -1, np.int32)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[i] == keys
            n[same] = self.known[i[same]]
        new = np.flatnonzero(n < 0)
        if len(new):
            blob = data.tobytes()
            n[new] = self.lengths([blob[starts[j]:ends[j]].decode("utf-8") for j in at[new]])
            if len(self.keys) + len(new) <= self.memo:
                k = np.concatenate((self.keys, keys[new]))
                order = np.argsort(k, kind="stable")
                self.keys, self.known = k[order], np.concatenate((self.known, n[new]))[order]
            elif len(self.keys):
                self.keys, self.known = self.keys[:0], self.known[:0]  # start the memo anew
        return n[back]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``doc, n_bytes, n_pretokens, n_tokens``.

    A null text counts as empty: zeros. Repeated rows are counted each; other columns are
    not read. The tokenizer file is read on the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(spec.value)
        for b in batches:
            for s in K.slices(b.column(1), SLICE):
                w = K.find_words(s.data, s.offsets, K.NON_SPACE)
                n = counter.counts(s.data, w.starts, w.ends, K.hash_spans(s.data, w.starts, w.ends))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), pa.array(np.diff(s.offsets), pa.int64()),
                     pa.array(np.bincount(w.row, minlength=s.rows), pa.int64()),
                     pa.array(np.bincount(w.row, weights=n, minlength=s.rows).astype(np.int64))],
                    names=["doc", "n_bytes", "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"doc {kind}, n_bytes long, n_pretokens long, n_tokens long")
