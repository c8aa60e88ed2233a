"""Ranked lexical search: the highest-scoring documents of each item, found by pair-bound MaxScore.

Documents are cut into blocks that stay where they were read. A block holds,
for each term that the items ask for, a posting list of documents with the
term's impact in them, and for pairs of terms that items ask for together the
list of the documents that hold both: the pair's intersection. Beside each
list stands its greatest impact, for a pair the greatest joint one.

An item's terms are paired from the rarest to the most frequent. What a pair
can add to a score is at most its greatest joint impact, or the greatest
impact of one of its terms alone where the other is missing; that is less than
the sum of both maxima wherever two terms are never strong together. An item
sorts its pairs by these bounds. The pairs whose bounds together stay below
the k-th best score known so far can lift no document into the result: only
the lists of the other pairs name candidates, and a candidate is dropped once
its score so far and the bounds that are left stay below that score.

The k-th best score starts from the joint impacts: the documents of an
intersection have at least these scores. It then rises within each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import map_text, utf8, words_of
from carelake.session import staged

#: Words of one index block; a longer document has a block of its own.
BLOCK_WORDS = 1 << 18
#: Items looked up in one pass over the index: what each task is sent.
BLOCK_ITEMS = 1 << 12
#: Bits of the map of asked terms, a power of two.
MAP_BITS = 1 << 22
_KNOWN = 1 << 20
_LEAST = -(1 << 63)


def _term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_no, item_id, term``: the distinct terms of each row of ``items``, as 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({_term(w) for w in words_of(text)}) for text in utf8(batch.column(2))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([t for f in found for t in f], pa.int64())],
                names=["item_no", "item_id", "term"])
    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "text")
    return map_text(numbered, run, f"item_no long, item_id {kind}, term long")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """One bit per hashed term: as many longs as MAP_BITS allows, however many terms there are."""
    bit = F.col("term").bitwiseAND(MAP_BITS - 1)
    cells = terms.select("term").distinct().groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("bits"))
    found = np.zeros(MAP_BITS // 64, np.int64)
    for r in cells.collect():
        found[r["cell"]] = r["bits"]
    return found.view(np.uint64)


class _Terms(dict):
    """The term of a word where the map has it, else None; remembers a bounded number of words."""

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, word: bytes):
        if len(self) >= _KNOWN:
            self.clear()
        term = _term(word)
        bit = term & (len(self.bitmap) * 64 - 1)
        self[word] = term = term if int(self.bitmap[bit >> 6]) >> (bit & 63) & 1 else None
        return term


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per block: ids and lengths of its documents, and the posting lists (document, count) of the asked terms.

    A null text has no terms. Every row of ``docs`` is a document of its own.
    """
    bitmap = _bitmap(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(bitmap)

        def block(ids, lengths, docs_of, tokens):
            pair = np.stack([np.array(tokens, np.int64), np.array(docs_of, np.int64)])
            pair = pair[:, np.lexsort((pair[1], pair[0]))]
            first = np.ones(pair.shape[1], bool)
            first[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
            at = np.flatnonzero(first)
            counts = np.diff(np.append(at, pair.shape[1]))
            own, starts = np.unique(pair[0, at], return_index=True)
            ends = np.append(starts[1:], len(at)) if len(own) else starts
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())),
                 *(pa.array([x.astype(np.int32 if n != 1 else np.int64)], pa.list_(pa.int32() if n != 1 else pa.int64()))
                   for n, x in enumerate((np.array(lengths), own, ends, pair[1, at], counts)))],
                names=["doc_ids", "lengths", "terms", "ends", "places", "counts"])

        ids, lengths, docs_of, tokens, size = [], [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(text)
                if ids and size + len(words) > BLOCK_WORDS:
                    yield block(ids, lengths, docs_of, tokens)
                    ids, lengths, docs_of, tokens, size = [], [], [], [], 0
                found = [t for t in map(known.__getitem__, words) if t is not None]
                docs_of += [len(ids)] * len(found)
                tokens += found
                ids.append(i)
                lengths.append(len(words))
                size += len(words) + 1
        if ids:
            yield block(ids, lengths, docs_of, tokens)
    schema = ("doc_ids array<long>, lengths array<int>, terms array<long>, ends array<int>, "
              "places array<int>, counts array<int>")
    return staged(map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema), "lexical")


def _frequencies(index: DataFrame) -> DataFrame:
    """``term, df``: documents that hold each stored term, summed within tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for own, ends in zip(batch.column(0), batch.column(1)):
                own, ends = own.values.to_numpy(), ends.values.to_numpy()
                terms, place = np.unique(np.concatenate([terms, own]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, np.diff(ends, prepend=0)]), len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "df"])
    return index.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Totals:
    """What all documents together say: N with terms, and their terms L with repeats."""

    def __init__(self, index: DataFrame):
        zero = F.lit(0).cast("long")
        lengths = F.col("lengths")
        row = index.select(F.size(F.filter(lengths, lambda n: n > 0)).cast("long").alias("n"),
                           F.aggregate(lengths, zero, lambda a, n: a + n).alias("l")).agg(F.sum("n"), F.sum("l")).first()
        self.n, self.terms = row[0] or 0, row[1] or 0

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))

    def impacts(self, counts: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The share of the score that each count has in its document, without the term's weight: a million at most."""
        exact = lengths.astype(np.int64 if 90 * self.n * int(lengths.max(initial=0)) < 1 << 63 else object)
        m = 10 + (90 * self.n * exact // max(self.terms, 1)).astype(np.int64)
        counts = counts.astype(np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 8 * m[places])


class Asked:
    """One bounded block of items: their terms with weights, and the pairs these make."""

    def __init__(self, items: list[tuple[int, list[tuple[int, int]]]], totals: Totals):
        """``items``: number and (documents that hold it, term) of each item; terms that no document holds are left out."""
        self.numbers = [no for no, _ in items]
        weights = {t: totals.weight(df) for _, own in items for df, t in own}
        self.terms = np.array(sorted(weights), np.int64)
        self.weights = np.array([weights[t] for t in self.terms.tolist()], np.int64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        pairs: dict[tuple[int, int], int] = {}
        #: Per item, its pairs; a term left over makes a pair with itself.
        self.of_item = []
        for _, own in items:
            rare = [place[t] for _, t in sorted(own)]
            both = [(rare[i], rare[min(i + 1, len(rare) - 1)]) for i in range(0, len(rare), 2)]
            self.of_item.append(np.array([pairs.setdefault(p, len(pairs)) for p in both], np.int64))
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)


_SCORED = ("doc_ids array<long>, terms array<int>, ends array<int>, places array<int>, scores array<int>, "
           "pairs array<int>, pair_ends array<int>, joint array<long>")


def score_lists(index: DataFrame, asked: Asked, totals: Totals, k: int) -> DataFrame:
    """The blocks with impacts in place of counts, and per pair the ``k`` greatest joint impacts of its intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, terms, ends, places, counts = (batch.column(c)[row].values.to_numpy() for c in range(1, 6))
                impacts, starts = totals.impacts(counts, places, lengths), np.append(0, ends[:-1])
                _, at, own = np.intersect1d(terms, asked.terms, assume_unique=True, return_indices=True)
                take = [np.arange(starts[i], ends[i]) for i in at]
                lists = {t: (places[r], impacts[r] * asked.weights[t]) for t, r in zip(own.tolist(), take)}
                lane, held, joints = np.zeros(len(lengths), np.int64), [], []
                for p, (a, b) in enumerate(asked.pairs.tolist()):
                    if a != b and a in lists and b in lists:
                        lane[lists[a][0]] = lists[a][1]
                        first = lane[lists[b][0]]
                        joint = (first + lists[b][1])[first > 0]
                        lane[lists[a][0]] = 0
                        if len(joint):
                            held.append(p)
                            joints.append(-np.sort(-joint)[:k])
                rows = np.concatenate(take) if take else np.zeros(0, np.int64)
                cells = [own, np.cumsum([len(r) for r in take]), places[rows], impacts[rows], np.array(held),
                         np.cumsum([len(j) for j in joints])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), *(pa.array([c.astype(np.int32)], pa.list_(pa.int32())) for c in cells),
                     pa.array([np.concatenate(joints) if joints else np.zeros(0, np.int64)], pa.list_(pa.int64()))],
                    names=[c.split()[0] for c in _SCORED.split(", ")])
    return staged(index.mapInArrow(run, _SCORED), "lexical-scored")


class Block:
    """The lists of one index block for the terms and pairs of the asked items."""

    def __init__(self, asked: Asked, size, terms, ends, places, scores, pairs, pair_ends, joint):
        self.size = size
        none = np.zeros(0, np.int64)
        self.docs, self.impacts = [none] * len(asked.terms), [none] * len(asked.terms)
        most, start = np.zeros(len(asked.terms), np.int64), 0
        for t, end in zip(terms.tolist(), ends.tolist()):
            self.docs[t], self.impacts[t] = places[start:end], scores[start:end] * asked.weights[t]
            most[t], start = self.impacts[t].max(), end
        #: What a pair adds at most: its greatest joint impact, or that of a term alone.
        self.bounds = most[asked.pairs].max(axis=1, initial=0)
        if len(pairs):
            self.bounds[pairs] = np.maximum(self.bounds[pairs], joint[np.append(0, pair_ends[:-1])])


def best_of(block: Block, asked: Asked, item: int, least: int):
    """Documents of a block that may score ``least`` or more for an item, with their scores.

    Every document above zero whose score reaches ``least`` is among them.
    """
    own = asked.of_item[item]
    own = own[np.argsort(block.bounds[own], kind="stable")]
    below = np.cumsum(block.bounds[own])  # what the pairs up to each one can add at most
    if not len(own) or below[-1] == 0 or below[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = int(np.searchsorted(below, least))  # the pairs before cannot lift a document to the least score
    total = np.zeros(block.size, np.int64)
    for p in own[first:]:
        for t in dict.fromkeys(asked.pairs[p].tolist()):
            total[block.docs[t]] += block.impacts[t]
    docs = np.flatnonzero(total)
    if first:
        docs = docs[total[docs] + below[first - 1] >= least]
    for n in range(first - 1, -1, -1):
        if not len(docs):
            break
        if block.bounds[own[n]]:
            for t in dict.fromkeys(asked.pairs[own[n]].tolist()):
                total[block.docs[t]] += block.impacts[t]
        docs = docs[total[docs] + (below[n - 1] if n else 0) >= least]
    docs = docs[total[docs] >= max(least, 1)]
    return docs, total[docs]


def _first_scores(scored: DataFrame, asked: Asked, k: int) -> np.ndarray:
    """Per item, a score that at least ``k`` documents reach: the k-th greatest joint impact of one of its pairs."""
    pairs = len(asked.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                held, ends, joint = (batch.column(c)[row].values.to_numpy() for c in range(3))
                for p, a, b in zip(held.tolist(), [0, *ends.tolist()], ends.tolist()):
                    best[p] = np.sort(np.concatenate([best[p], joint[a:b]]))[-k:] if p in best else joint[a:b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(best), np.int64), [len(j) for j in best.values()])),
             pa.array(np.concatenate(list(best.values())) if best else np.zeros(0, np.int64))], names=["pair", "joint"])
    told = scored.select("pairs", "pair_ends", "joint").mapInArrow(run, "pair long, joint long")
    ranked = told.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("joint"))))
    least = np.zeros(pairs, np.int64)
    for r in ranked.where(F.col("n") == k).collect():  # one row per pair of the block of items at most
        least[r["pair"]] = r["joint"]
    return np.array([least[own].max(initial=0) for own in asked.of_item], np.int64)


def _search(asked: Asked, least: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = least.copy()
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(bar)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, *lists = (batch.column(c)[row].values for c in range(batch.num_columns))
                ids = ids.fill_null(_LEAST).to_numpy()
                block = Block(asked, len(ids), *(x.to_numpy() for x in lists))
                for item in range(len(bar)):
                    docs, scores = best_of(block, asked, item, int(bar[item]))
                    if not len(docs):
                        continue
                    scores, found = np.concatenate([kept[item][0], scores]), np.concatenate([kept[item][1], ids[docs]])
                    order = np.lexsort((found, -scores))[:k]
                    kept[item] = scores[order], found[order]
                    if len(order) == k:
                        bar[item] = max(bar[item], scores[order[-1]])
        sizes = [len(s) for s, _ in kept]
        ids = np.concatenate([d for _, d in kept]) if kept else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(asked.numbers, np.int64), sizes)), pa.array(ids, mask=ids == _LEAST),
             pa.array(np.concatenate([s for s, _ in kept]) if kept else np.zeros(0, np.int64))],
            names=["item_no", "doc_id", "score"])
    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs`` for each row of ``items``, those above 0.

    A null or empty text has no terms, as a document and as an item. Equal
    scores go by ascending ``doc_id``, a null one first; rows that repeat an id
    are documents of their own, and items that repeat an id are ranked each by
    itself. Empty tables give no rows; other columns are not read. Items go in
    blocks of ``block_items``, each one pass over the index, and the matches of
    a block are written before the next is asked.
    """
    terms = staged(item_terms(items), "asked-terms")
    index = build_index(docs, terms)
    totals = Totals(index)
    counted = terms.join(_frequencies(index), "term")
    numbers = staged(counted.groupBy("item_no").agg(
        F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("df", "term"))).alias("own")), "asked-items")
    blocks = max(1, -(-numbers.count() // block_items))
    parts = []
    for b in range(blocks):
        rows = numbers.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b).select("item_no", "own").collect()
        asked = Asked([(r["item_no"], [tuple(x) for x in r["own"]]) for r in sorted(rows)], totals)
        scored = score_lists(index, asked, totals, k)
        search = _search(asked, _first_scores(scored, asked, k), k)
        parts.append(staged(scored.mapInArrow(search, "item_no long, doc_id long, score long"), "lexical-hits"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbers.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
