"""Benchmark text found in documents through a distributed positional inverted index.

The index holds, per block of documents, a posting list for each term: its
positions in the words of the block. Blocks are cut by words, stay where their
documents were read and are written to the shared folder, so no posting list
of a frequent word ever meets in one place. Only terms that the test items use
are stored; which ones is told by a bitmap of fixed size.

A window of test words is looked up from its rarest term over all documents:
the positions of that term, less its offset, are the places where the window
could start, and each further term, from rare to frequent, must have its own
offset in its list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_text, utf8, words_of
from carelake.session import scratch_path, staged

#: Words of one index block; a longer document has a block of its own.
BLOCK_WORDS = 1 << 15
#: Windows looked up in one pass over the index: what each task is sent.
BLOCK_WINDOWS = 1 << 17
#: Bits of the map of test terms, a power of two.
MAP_BITS = 1 << 22
#: Words a task remembers the term of.
_KNOWN = 1 << 20

def _term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


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
        term = term if int(self.bitmap[bit >> 6]) >> (bit & 63) & 1 else None
        self[word] = term
        return term


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """``win, terms, item_id``: every run of ``size`` words of each item.

    An item of fewer words, but not none, is one window; a null text has no
    words. ``win`` is a hash of the terms, ``item_id`` passes through as it is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wins, lists = [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                terms = np.array([_term(w) for w in words_of(text)], np.int64)
                n = min(size, len(terms))
                for at in range(len(terms) - n + 1 if n else 0):
                    rows.append(i)
                    lists.append(terms[at:at + n])
                    wins.append(_term(lists[-1].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(wins, pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                 batch.column(0).take(pa.array(rows, pa.int64()))], names=["win", "terms", "item_id"])
    kind = items.schema["item_id"].dataType.simpleString()
    return map_text(items.select("item_id", "text"), run, f"win long, terms array<long>, item_id {kind}").distinct()


def _bitmap(wins: DataFrame) -> np.ndarray:
    """One bit per hashed test term: as many longs as MAP_BITS allows, however many terms there are."""
    bit = F.col("term").bitwiseAND(MAP_BITS - 1)
    cells = wins.select(F.explode("terms").alias("term")).distinct().groupBy(
        F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("bits"))
    found = np.zeros(MAP_BITS // 64, np.int64)
    for r in cells.collect():
        found[r["cell"]] = r["bits"]
    return found.view(np.uint64)


_INDEX = ("block long, doc_ids array<{0}>, keys array<long>, lengths array<int>, "
          "terms array<long>, ends array<int>, places array<int>")


def _postings(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, made = _Terms(bitmap), 0
        first = TaskContext.get().partitionId() << 33

        def block(batch, rows, lengths, tokens):
            known = [i for i, t in enumerate(tokens) if t is not None]
            at = np.array(known, np.int32)
            ids = np.array([tokens[i] for i in known], np.int64)
            order = np.argsort(ids, kind="stable")
            unique, starts = np.unique(ids[order], return_index=True)
            ends = np.append(starts[1:], len(ids)).astype(np.int32) if len(unique) else np.zeros(0, np.int32)
            take = pa.array(rows, pa.int64())
            ids_of, keys_of = batch.column(0).take(take), batch.column(2).take(take)
            lists = [pa.array([x], pa.list_(kind)) for x, kind in (
                (ids_of.to_pylist(), ids_of.type), (keys_of.to_pylist(), pa.int64()),
                (np.array(lengths, np.int32), pa.int32()), (unique, pa.int64()), (ends, pa.int32()),
                (at[order], pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *lists],
                                              names=["block", "doc_ids", "keys", "lengths", "terms", "ends", "places"])

        for batch in batches:
            rows, lengths, tokens = [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                found = list(map(terms.__getitem__, words_of(text)))
                if rows and len(tokens) + len(found) > BLOCK_WORDS:
                    yield block(batch, rows, lengths, tokens)
                    made, rows, lengths, tokens = made + 1, [], [], []
                rows.append(i)
                lengths.append(len(found))
                tokens += found
            if rows:
                yield block(batch, rows, lengths, tokens)
                made += 1
    return run


def build_index(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """One row per block: its documents, their lengths in words, and its posting lists for the test terms."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    schema = _INDEX.format(docs.schema["doc_id"].dataType.simpleString())
    return staged(map_text(docs, _postings(_bitmap(wins)), schema), "postings")


def _frequencies(index: DataFrame) -> DataFrame:
    """``term, n``: places of each stored term over all documents, summed within tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own, ends = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            starts = np.zeros(len(ends), np.int64)
            starts[1:] = ends[:-1]
            sizes = batch.column(0).value_lengths().to_numpy()
            starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
            terms, place = np.unique(np.concatenate([terms, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, ends - starts]), len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])
    return index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _rarest_first(wins: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``win, terms, offsets`` with terms from the rarest to the most frequent; windows of an unseen term go."""
    cells = wins.select("win", "terms").distinct().select("win", F.posexplode("terms").alias("at", "term"))
    size = F.count(F.lit(1)).alias("size")
    sizes = cells.groupBy("win").agg(size)
    found = cells.join(frequencies, "term").groupBy("win").agg(
        size, F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("c"))
    return found.join(sizes, ["win", "size"]).select("win", F.col("c.term").alias("terms"), F.col("c.at").alias("offsets"))


class _Windows:
    """One bounded block of windows, ordered by their rarest term."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["terms"][0])
        size = max((len(r["terms"]) for r in rows), default=1)
        self.win = np.array([r["win"] for r in rows], np.int64)
        self.n = np.array([len(r["terms"]) for r in rows], np.int64)
        self.terms, self.offsets = np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            self.terms[i, :len(r["terms"])], self.offsets[i, :len(r["terms"])] = r["terms"], r["offsets"]

    def matches(self, bases, terms, ends, places, slop):
        """Window rows, and the first and past-the-last place of each match in a block."""
        total = int(bases[-1]) + 1
        starts = np.append(0, ends[:-1]).astype(np.int64)
        lo, hi = (np.searchsorted(self.terms[:, 0], terms, side) for side in ("left", "right"))
        hold = np.flatnonzero(hi > lo)
        each = hi[hold] - lo[hold]
        wins = np.repeat(lo[hold] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        lists = np.repeat(hold, each)
        sizes = (ends[lists] - starts[lists]).astype(np.int64)
        at = np.repeat(starts[lists] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        w = np.repeat(wins, sizes)
        anchor = places[at].astype(np.int64) - self.offsets[w, 0]
        doc = np.searchsorted(bases, places[at], "right") - 1
        first, last = places[at].astype(np.int64), places[at].astype(np.int64)
        # Lists lie one after the other by term, so a term and a place together are in order.
        keys = np.repeat(np.arange(len(terms)), (ends - starts)) * total + places
        for j in range(1, self.terms.shape[1]):
            here = self.n[w] > j
            t = np.searchsorted(terms, self.terms[w, j])
            known = here & (t < len(terms))
            known[known] = terms[t[known]] == self.terms[w[known], j]
            want = np.clip(anchor + self.offsets[w, j] - slop, bases[doc], total - 1)
            i = np.searchsorted(keys, t * total + want)
            found = known & (i < len(keys))
            got = np.where(found, keys[np.minimum(i, len(keys) - 1)] - t * total, -1) if len(keys) else i
            found &= (got >= bases[doc]) & (got < bases[doc + 1]) & (got <= anchor + self.offsets[w, j] + slop)
            ok = found | ~here
            first = np.where(here & ok, np.minimum(first, got), first)[ok]
            last = np.where(here & ok, np.maximum(last, got), last)[ok]
            w, anchor, doc = w[ok], anchor[ok], doc[ok]
        return w, doc, first - bases[doc], last - bases[doc] + 1


def _lookup(block: _Windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, terms, ends, places = (batch.column(c)[row].values.to_numpy() for c in range(1, 5))
                bases = np.append(0, np.cumsum(lengths.astype(np.int64)))
                w, doc, first, last = block.matches(bases, terms, ends, places, slop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(w), batch.column(0)[row].as_py())), pa.array(doc.astype(np.int32)),
                     pa.array(block.win[w]), pa.array(first), pa.array(last)],
                    names=["block", "doc_no", "win", "start", "stop"])
    return run


def search(index: DataFrame, wins: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``block, doc_no, win, start, stop``: each place where a window of ``wins`` occurs.

    With ``slop`` 0 these are exact phrases. Above it they are proximity
    matches: every term lies at most ``slop`` words beside its place, seen
    from the window's rarest term. ``start`` and ``stop`` are words of the
    document, the latter past the last. Windows go in blocks of about
    ``block_windows``, each one pass over the index, whose matches are written
    before the next is collected: driver and tasks hold one block at a time.
    """
    ordered = staged(_rarest_first(wins, _frequencies(index)), "windows")
    blocks = max(1, -(-ordered.count() // block_windows))
    columns = index.select("block", "lengths", "terms", "ends", "places")
    path, schema = scratch_path(index.sparkSession, "matches"), "block long, doc_no int, win long, start long, stop long"
    for b in range(blocks):
        rows = ordered.where(F.pmod("win", F.lit(blocks)) == b).collect()
        columns.mapInArrow(_lookup(_Windows(rows), slop), schema).write.mode("append").parquet(path)
    return index.sparkSession.read.schema(schema).parquet(path)


def covered(spans: Column) -> Column:
    """How many words the spans (start, stop) cover, each word once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["stop"]).alias("upto")), lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, key, n_words, n_hit, n_items, item_ids, contaminated``: one row per row of ``docs``.

    ``key`` is ``xxhash64(text)``; ``n_hit`` counts words inside any occurrence
    of a window; ``item_ids`` are the items, as sorted strings, that have an
    occurring window. Null and empty texts have no words. Items that repeat an
    id count once; a null id counts as one item but has no place in the list.
    Empty tables are fine; other columns are not read.
    """
    wins = staged(windows(items, size), "test-windows")
    index = build_index(docs, wins)
    found = search(index, wins)
    hits = found.groupBy("block", "doc_no").agg(covered(F.collect_list(F.struct("start", "stop"))).alias("n_hit"))
    named = found.select("block", "doc_no", "win").distinct().join(wins.select("win", "item_id"), "win").groupBy(
        "block", "doc_no").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
                               F.max(F.col("item_id").isNull().cast("long")).alias("nameless"))
    rows = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "keys", "lengths")).alias("doc_no", "d")).select(
        "block", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.keys").alias("key"),
        F.col("d.lengths").cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(hits.join(named, ["block", "doc_no"]), ["block", "doc_no"], "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        (F.coalesce(F.size("item_ids"), none) + F.coalesce("nameless", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows in whose text a window of ``items`` occurs; all columns pass through."""
    bad = contamination(docs, items, size).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left_anti")
