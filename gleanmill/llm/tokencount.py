"""Token counts by byte-pair merging over a heap and a linked list, without producing identifiers.

Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and repeated ids give repeated
results, a null id stays null, an empty table gives an empty result. Columns other than the id and the text are not
read, so their names cannot clash. Texts are counted whole, whatever their length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime

MARK = "▁"  # what the model writes for a space
#: Entries a worker remembers, of units and of parts; the memo restarts when full, results don't depend on it.
MEMO = 1_000_000
#: Characters of what is remembered; longer runs are counted each time.
REMEMBERED = 64

_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces that merging can make, with their scores, of a byte-fallback model that keeps white space as it is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.normalize(" a  b ") != f"{MARK * 2}a{MARK * 2}b{MARK}":
        raise ValueError("only models with an identity normaliser and a leading space are supported")
    special = lambda i: sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in scores):
        raise ValueError("a piece spans a word boundary")
    return scores


class MergeCounter:
    """Counts tokens of text units; a unit is a run of marks and what follows up to the next mark."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.inside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}  # no merge crosses other character pairs
        self.parts: dict[str, int] = {}
        self.units = _Units(self)

    def count_part(self, part: str) -> int:
        """Initial symbols minus merges; a symbol that is no piece is spelled in bytes."""
        n = len(part)
        scores = self.scores
        if n == 1 or part in scores and n == 2:
            return 1 if part in scores else len(part.encode())
        text = list(part)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := part[i : i + 2]) in scores]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not text[i] or text[i] + text[j] != joined:
                continue  # one side has been merged since
            text[i], text[j] = joined, ""
            merges += 1
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (p := joined + text[k]) in scores:
                    heapq.heappush(heap, (-scores[p], i, p))
            k = before[i]
            if k >= 0 and (p := text[k] + joined) in scores:
                heapq.heappush(heap, (-scores[p], k, p))
        return n - merges + sum(len(c.encode()) - 1 for c in text if len(c) == 1 and c not in scores)

    def count_unit(self, unit: str) -> int:
        total, first, inside, parts = 0, 0, self.inside, self.parts
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in inside:
                part = unit[first:i]
                if (c := parts.get(part)) is None:
                    c = self.count_part(part)
                    if len(parts) >= MEMO:
                        parts.clear()
                    if len(part) <= REMEMBERED:
                        parts[part] = c
                total += c
                first = i
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] == " " or MARK in text or "  " in text:
            keys = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        else:
            keys = text.split(" ")
        return sum(map(self.units.__getitem__, keys))


class _Units(dict):
    """From a unit without its first mark to its tokens."""

    def __init__(self, counter: MergeCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, key: str) -> int:
        n = self.counter.count_unit(MARK + key)
        if len(self) >= MEMO:
            self.clear()
        if len(key) <= REMEMBERED:
            self[key] = n
        return n


_counters: dict[int, MergeCounter] = {}


def _count_batches(scores, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(scores.value["id"])
    if counter is None:
        _counters.clear()
        counter = _counters[scores.value["id"]] = MergeCounter(scores.value["scores"])
    for batch in batches:
        sizes, counts = [], []
        for text in batch.column(1).to_pylist():
            sizes.append(len(text.encode()) if text else 0)
            counts.append(counter.count(text or ""))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            names=_OUT.names,
        )


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit) of every row, as the model's library counts.

    ``model_path`` is read on the driver only; the table of some 10^4 pieces is what is broadcast.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    scores = piece_scores(model_path)
    shared = spark.sparkContext.broadcast({"id": hash(tuple(sorted(scores.items()))), "scores": scores})
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_count_batches, shared, limit), _OUT)
