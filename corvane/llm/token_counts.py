"""Edit-aware token counts (operator 1).

A document is kept as a segment tree over its pre-tokens: leaves hold a pre-token's length in characters and number of
tokens, inner nodes the sums below them. An edit descends by characters to the pre-tokens it touches. Pre-tokens that end
at least CONTEXT characters before it, or before an added token that it breaks or completes, can't change, since a
pre-token is settled by its own characters, that many more and the added tokens after it;
from there the text is cut anew until a cut falls on an old one beyond the edit, after which all is as it was. Only the
new pre-tokens are encoded, the leaves between are replaced, and the sums above them renewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_files import Encoder, encoder

CONTEXT = 2
#: Leaves of one bottom node of a tree.
FAN = 64


class Tree:
    """Lengths and token counts of a text's pre-tokens, in chunks of FAN to 2 FAN leaves, with sums by binary levels."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        n = max(1, -(-len(lengths) // FAN))
        self.chunks = [(a, b) for a, b in zip(np.array_split(lengths, n), np.array_split(tokens, n))]
        self._levels()

    def _levels(self):
        low = np.array([[int(a.sum()), int(b.sum())] for a, b in self.chunks], np.int64).reshape(-1, 2)
        self.levels = [low]
        while len(low) > 1:
            low = np.concatenate((low, np.zeros((len(low) % 2, 2), np.int64))).reshape(-1, 2, 2).sum(axis=1)
            self.levels.append(low)

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][:, 0].sum())

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][:, 1].sum())

    @property
    def n_leaves(self) -> int:
        return sum(len(a) for a, _ in self.chunks)

    def find(self, char: int) -> tuple[int, int, int]:
        """(chunk, leaf in it, first character of the leaf) of the last leaf that starts at or before char."""
        at, before = 0, 0
        for level in self.levels[-2::-1]:
            at *= 2
            if before + level[at, 0] <= char and at + 1 < len(level):
                before += int(level[at, 0])
                at += 1
        ends = before + np.cumsum(self.chunks[at][0])
        leaf = int(np.searchsorted(ends, char, side="right"))
        leaf = min(leaf, max(0, len(ends) - 1))
        return at, leaf, before if leaf == 0 else int(ends[leaf - 1])

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: np.ndarray, tokens: np.ndarray):
        """Puts new leaves for those from first up to last, that excluded; sums are renewed above the changed chunks."""
        (c1, l1), (c2, l2) = first, last
        a = np.concatenate((self.chunks[c1][0][:l1], lengths, self.chunks[c2][0][l2:]))
        b = np.concatenate((self.chunks[c1][1][:l1], tokens, self.chunks[c2][1][l2:]))
        if c1 == c2 and len(a) <= 2 * FAN:
            self.chunks[c1] = (a, b)
            value, at = np.array([int(a.sum()), int(b.sum())]), c1
            for depth, level in enumerate(self.levels):
                level[at] = value
                at //= 2
                if depth + 1 < len(self.levels):
                    value = level[2 * at : 2 * at + 2].sum(axis=0)
            return
        n = max(1, -(-len(a) // FAN))
        self.chunks[c1 : c2 + 1] = list(zip(np.array_split(a, n), np.array_split(b, n)))
        self._levels()


class Counted:
    """A text with its tree."""

    def __init__(self, text: str | None, enc: Encoder):
        self.text, self.enc = text or "", enc
        pieces = enc.cutter(self.text).findall(self.text)
        self.tree = Tree(*self._leaves(pieces))
        self.encoded = 0

    def _leaves(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(len, self.enc.ids(pieces)), np.int64, n) // 4

    @property
    def n_tokens(self) -> int:
        return self.tree.n_tokens

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replaces `deleted` characters from `start` on, both cut to the text, by `inserted`."""
        start = min(max(0, start), len(self.text))
        end = min(start + max(0, deleted), len(self.text))
        old, tree = self.text, self.tree
        self.text = old[:start] + inserted + old[end:]
        shift = len(self.text) - len(old)
        back = start
        if self.enc.added:  # an added token that the edit breaks or completes ends pieces where it starts
            for text in (old, self.text):
                m = self.enc.added.search(text, max(0, start - self.enc.longest + 1), start + self.enc.longest - 1)
                back = min(back, m.start()) if m else back
        chunk, leaf, at = tree.find(max(0, back - CONTEXT))
        first, pieces, pos = (chunk, leaf), [], at
        edited = start + len(inserted)
        if not old:
            pieces, last = self.enc.cutter(self.text).findall(self.text), (0, 0)
        else:
            last = None
            for m in self.enc.cutter(self.text).finditer(self.text, at):
                if m.start() >= edited and m.start() - shift < len(old):
                    c, k, s = tree.find(m.start() - shift)
                    if s == m.start() - shift:
                        last = (c, k)
                        break
                pieces.append(m[0])
            if last is None:
                last = (len(tree.chunks) - 1, len(tree.chunks[-1][0]))
        self.encoded += len(pieces)
        tree.replace(first, last, *self._leaves(pieces))


def _run(tokenizer):
    def run(batches):
        enc = encoder(tokenizer.value)
        for b in batches:
            out = []
            for t, edits in zip(b.column(1), b.column(2)):
                d = Counted(t.as_py(), enc)
                row = [d.n_tokens]
                for e in edits.as_py() or []:
                    if e is not None:
                        d.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((*row, d.n_tokens, d.tree.n_leaves, d.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(4))], names=["doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    return run


def count_tokens(docs: DataFrame, tokenizer_json: str, edits=None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded of each row of docs (doc_id, text).

    edits: a column over docs of arrays of (start, deleted, inserted), in characters of the text as it stands when the
    edit comes; they are applied in order. Null arrays, edits and fields are none, 0 and ''; places beyond the text are
    cut to it. n_pretokens is of the edited text; n_reencoded counts the pre-tokens that edits made anew. A null or empty
    text has no tokens. Other columns are not read.
    """
    spark = docs.sparkSession
    C.ship(spark)
    shape = "array<struct<start:long,deleted:long,inserted:string>>"
    cells = (F.lit(None) if edits is None else edits).cast(shape)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), cells.alias("edits"))
    return rows.mapInArrow(_run(spark.sparkContext.broadcast(tokenizer_json)), "doc_id long, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long")


def sample_edits(text) -> F.col:
    """Three edits of every document, as a curator may make: a cut at a quarter, a passage put in halfway, a closing line."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")

    def edit(start, deleted, inserted):
        return F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))

    return F.array(edit(F.floor(n / 4), 20, ""), edit(F.floor(n / 2), 0, " (passage put in) "), edit(n, 0, "\nThe end."))
