"""Token counts by a piece model, with a shortcut for strings that encode alone as one token.

Which strings of the vocabulary do so is proved once, on the driver, by encoding each of them. Texts are cut into
pre-tokens over which no merge reaches (``pretokens``). A pre-token that is a proved string counts one; only the others are
merged, each distinct one once per task as long as its memo has room. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .pretokens import CUT, NORMAL, SPACE_MARK, Pieces, pieces, pretokens, read_bytes

LIMIT = 4096
#: Counts that a task remembers, the characters of a pre-token among them, and the pre-tokens that it gathers before it merges.
MEMO, KEPT, GATHERED = 300_000, 48, 100_000

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(model: Pieces) -> set[str]:
    """The strings of the vocabulary that are one pre-token and encode alone as one token: their own."""
    strings = {k: p.replace(SPACE_MARK, " ") for k, (p, kind) in enumerate(model.pieces) if kind == NORMAL}
    alone = {k: s for k, s in strings.items() if CUT.split(s) == [s]}
    return {s for (k, s), ids in zip(alone.items(), model.ids([*alone.values()]), strict=True) if ids == [k]}


class Counter:
    """Counts of pre-tokens: proved strings count one, others are merged and remembered."""

    def __init__(self, model: Pieces, whole: set[str]):
        self.model, self.whole, self.proved = model, dict.fromkeys(whole, 1), model.proved_cuts()
        self.known = dict(self.whole)

    def slices(self, text: str | None) -> Iterator[list[str]]:
        return pretokens(text) if self.proved else iter([[" " + text]] if text else [])

    def counts(self, slices: list[tuple[int, list[str]]], total: list[int]) -> None:
        """Adds the tokens of each slice to the total of its row."""
        rest = list({u for _, units in slices for u in units if u not in self.known})
        self.known.update(zip(rest, map(len, self.model.ids(rest)), strict=True))
        for row, units in slices:
            total[row] += sum(map(self.known.__getitem__, units))
        if len(self.known) > MEMO:
            self.known = dict(self.whole)
        else:
            for u in rest:
                if len(u) > KEPT:
                    del self.known[u]


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, for the piece model in the file ``path``.

    Tokens are those of the whole text as the model's library gives them, without begin, end or other added ones; strings of
    control symbols are plain text. Null and empty texts have no tokens. Rows stay one for one, repeated ones and null doc_id
    included; an empty table gives an empty result; other columns are not read. Memory is bounded by a slice of a text, but
    for texts without any place to cut, which are merged whole.
    """
    context = documents.sparkSession.sparkContext
    data = read_bytes(path)
    shared = context.broadcast((data, whole_tokens(pieces(data))))  # as large as the vocabulary, whatever the table holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, whole = shared.value
        counter = Counter(pieces(data), whole)
        for b in sliced(batches):
            total, gathered, size = [0] * b.num_rows, [], 0
            for row, text in enumerate(b.column("text")):
                for units in counter.slices(text.as_py()):
                    gathered.append((row, units))
                    size += len(units)
                    if size > GATHERED:
                        counter.counts(gathered, total)
                        gathered, size = [], 0
            counter.counts(gathered, total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, COUNTS)
