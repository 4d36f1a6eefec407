"""Token counts that follow edits: each document keeps a segment tree over its pre-tokens, and an
edit re-encodes the words it touches and the words next to them, then updates sums up the tree.

An edit is (start, end, replacement) in characters of the original text; the edits of a document
are applied from the last to the first, so that each still finds its place. Edits that overlap are
applied to what the later ones left.

Results for odd inputs: a null text counts as empty and has no tokens; a null list of edits is an
empty one; places outside the text are moved to its ends; repeated rows are counted as often as
they occur; an empty table gives no rows. Further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import small_batches, text_or_empty
from lexloom.llm.tokens import Encoder, parts, tokenizer_json

EDITS = "array<struct<start:int,end:int,replacement:string>>"
ADDRESS = r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b"
#: A word that begins with one of these, after a word that doesn't end with a blank, begins a token.
_STARTS = " \n\t\r"


class CountTree:
    """Sums of characters and of tokens over the pre-tokens of one text.

    Node k has the children 2k and 2k+1; leaves lie at `size` and beyond.
    """

    def __init__(self, text: str, encoder: Encoder):
        self._encoder = encoder
        self.leaves = parts(text)
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self._chars = self._tree([len(x) for x in self.leaves] + pad)
        self._tokens = self._tree([self._count(x) for x in self.leaves] + pad)
        self.encoded_chars = 0  # by edits, not by the first count

    def _count(self, text: str) -> int:
        return len(self._encoder.part(text)) // 4 if text else 0

    @staticmethod
    def _tree(level: list[int]) -> list[int]:
        levels = [level]
        while len(level) > 1:
            level = [a + b for a, b in zip(level[::2], level[1::2], strict=True)]
            levels.append(level)
        return [0, *(x for level in reversed(levels) for x in level)]

    @property
    def n_tokens(self) -> int:
        return self._tokens[1] if self.leaves else 0

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and where that leaf starts."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self._chars[node]:
                before += self._chars[node]
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node, chars, tokens = leaf + self.size, len(text) - self._chars[leaf + self.size], tokens - self._tokens[leaf + self.size]
        while node:
            self._chars[node] += chars
            self._tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end."""
        n = self._chars[1] if self.leaves else 0
        start, end = min(max(start, 0), n), min(max(end, start, 0), n)
        if not self.leaves:
            self.leaves, self._chars, self._tokens = [""], [0, 0], [0, 0]
        last_leaf = len(self.leaves) - 1
        first, before = self._find(min(start, n - 1)) if n else (0, 0)
        last, last_before = self._find(end - 1) if end > start else (first, before)
        region = self.leaves[first][: start - before] + replacement + self._tail(first, last, before, last_before, end)
        # The words next to the region join it while a token could cross its ends.
        while first > 0 and (not region or region[0] not in _STARTS):
            first -= 1
            region = self.leaves[first] + region
        while last < last_leaf and (not region or region[-1].isspace() or not self.leaves[last + 1] or self.leaves[last + 1][0] not in _STARTS):
            last += 1
            region += self.leaves[last]
        self.encoded_chars += len(region)
        tokens = len(self._encoder.ids(region)) // 4
        self._set(first, region, tokens)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)

    def _tail(self, first: int, last: int, before: int, last_before: int, end: int) -> str:
        if last == first:
            return self.leaves[first][max(0, end - before) :]
        return self.leaves[last][end - last_before :]


def counted(docs: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens before the edits, n_edits, and n_chars_after, n_tokens_after, encoded_chars (characters that the edits had encoded again)."""
    small_batches(docs.sparkSession)
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))
    names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json.value)
        for batch in batches:
            rows = []
            for key, text, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = CountTree(text, encoder)
                before = tree.n_tokens
                changes = sorted(changes or [], key=lambda e: (e["start"], e["end"]), reverse=True)
                for e in changes:
                    tree.edit(e["start"], e["end"], e["replacement"] or "")
                rows.append((key, len(text), before, len(changes), len(tree.text), tree.n_tokens, tree.encoded_chars))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce(edits.cast(EDITS), F.array().cast(EDITS)).alias("edits"))
    return given.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cleaning_edits(text: Column, header: Column) -> Column:
    """The edits by which a corpus job cleans a text: a header line in front, and mail and
    network addresses masked."""
    found, gaps = F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), F.split(text, ADDRESS)
    no_edits = F.array().cast(EDITS)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(F.coalesce(pair["gap"], F.lit("")))
        end = start + F.length(pair["hit"])
        edit = F.struct(start.alias("start"), end.alias("end"), F.lit("[address]").alias("replacement"))
        return F.struct(end.alias("at"), F.concat(state["edits"], F.array(edit)).alias("edits"))

    pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    masked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), no_edits.alias("edits")), step)["edits"]
    return F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), header.alias("replacement"))).cast(EDITS), masked)
