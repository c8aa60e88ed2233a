"""SentencePiece ids by a streaming Viterbi search, and the text back from the ids.

The best segmentation is the one of the highest sum of piece scores. The
search keeps scores for one window of the longest piece, and back pointers
only up to the last boundary that is settled: as soon as the best paths to all
places of the window run through one boundary, no later character can change
what lies before it, and its ids go out. Where no piece of the vocabulary has
the two characters around a place side by side, every path has a boundary
there; between such places a segment is worked out once and remembered. The
new segments of a batch that fit one window take the steps of the search
together, a column of characters at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carelake.llm.common import map_text, utf8

#: A public model file; only its pieces and scores are used, and it is never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments a task remembers at once.
REMEMBERED = 1 << 19
#: Segments searched side by side.
TOGETHER = 1 << 14
#: Characters whose ways to go on are remembered together, and how many such are.
HEAD, HEADS = 4, 1 << 17
_NEVER = float("-inf")
_UNKNOWN_PENALTY = 10.0  # below the lowest score, as the model's own library has it


def load_pieces(path: str = MODEL) -> dict:
    """The vocabulary of a model file: ordinary pieces with ids and scores, and the ids of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual, bytes_at = {}, [None] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            usual[piece] = (i, model.get_score(i))
    if None in bytes_at:
        raise ValueError("the model has no piece for some byte, so some texts could not be told back")
    return {"pieces": usual, "bytes": bytes_at}


class Encoder:
    """Ids of texts under one vocabulary."""

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        self.pieces, self.bytes = vocabulary["pieces"], vocabulary["bytes"]
        self.longest = max(map(len, self.pieces), default=1)
        self.begins = {p[:i]: (-1, 0.0) for p in self.pieces for i in range(1, len(p))} | self.pieces
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - _UNKNOWN_PENALTY
        self.inside = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # Pieces hold the space mark in front only: then a word's end is a boundary of every path.
        marked = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.segments = re.compile(".+" if marked else f"{SPACE}+[^{SPACE}]*", re.S).findall
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, tuple[list, int, bool]] = {}
        # The tree of all beginnings: (node, character) -> node, and each node's score and id.
        node = {p: i for i, p in enumerate(sorted(self.begins), 1)}
        steps = sorted(((node.get(p[:-1], 0) << 21 | ord(p[-1]), i) for p, i in node.items()))
        self.step, self.to = (np.array([x[i] for x in steps] + [(1 << 62, 0)[i]], np.int64) for i in (0, 1))
        values = [(-1, _NEVER), *[self.begins[p] for p in node]]
        self.node_id = np.array([i for i, _ in values], np.int32)
        self.node_score = np.array([v if i >= 0 else _NEVER for i, v in values])
        self.remembered = remembered

    def encode(self, text: str) -> array:
        """Ids of one text. An empty text has none; any other begins with a space mark of its own.

        A space mark that stands in the text itself is written as bytes, so
        that every text can be told back exactly.
        """
        ids = array("i")
        if not text:
            return ids
        known = self.known
        for n, part in enumerate(text.split(SPACE)):
            if n:
                ids.extend([self.bytes[b] for b in SPACE.encode()])
            for segment in self._segments_of(part, not n):
                found = known.get(segment)
                if found is None:
                    found = self._remember(segment, self._pieces_of(segment))
                ids.frombytes(found)
        return ids

    def learn(self, texts: list[str]) -> None:
        """Work out the segments of these texts that are not known yet, many at once."""
        seen: set[str] = set()
        for text in texts:
            for n, part in enumerate(text.split(SPACE) if text else ()):
                seen.update(self._segments_of(part, not n))
        if len(self.known) + len(seen) > self.remembered:
            self.known.clear()
        fresh = sorted((s for s in seen.difference(self.known) if 0 < len(s) <= self.longest), key=len, reverse=True)
        for i in range(0, min(len(fresh), self.remembered), TOGETHER):
            self._together(fresh[i:i + TOGETHER])

    def _together(self, segments: list[str]) -> None:
        """The search on segments of at most one window, from the longest to the shortest, side by side."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        width, count = int(sizes[0]), len(segments)
        codes = np.zeros((count, width), np.int64)
        codes[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        longer = [int(np.searchsorted(-sizes, -i, "right")) for i in range(width + 1)]  # rows of i characters or more
        score = np.full((width + 1, count), _NEVER)
        back, ids = np.zeros((width + 1, count), np.int64), np.full((width + 1, count), -1, np.int32)
        score[0] = 0.0
        for at in range(width):
            rows, node = np.arange(longer[at + 1]), np.zeros(longer[at + 1], np.int64)
            for end in range(at + 1, width + 1):
                going = int(np.searchsorted(rows, longer[end]))
                rows, node = rows[:going], node[:going]
                if not going:
                    break
                key = node << 21 | codes[rows, end - 1]
                found = np.searchsorted(self.step, key)
                known = self.step[found] == key
                node = np.where(known, self.to[found], 0)
                value, one = self.node_score[node], self.node_id[node]
                if end == at + 1:
                    value = np.where(one < 0, self.unknown, value)
                value = value + score[at, rows]
                better = value > score[end, rows]
                to = rows[better]
                score[end, to], back[end, to], ids[end, to] = value[better], at, one[better]
                rows, node = rows[known], node[known]
        place, every = sizes.copy(), np.arange(count)
        taken = []  # ids of the paths, the last of each first
        while place.any():
            taken.append(np.where(place > 0, ids[place, every], -2))
            place = back[place, every]
        found = np.array(taken[::-1], np.int32).T
        ends = np.cumsum((found != -2).sum(axis=1)).tolist()
        flat, strange = found[found != -2], (found == -1).any(axis=1).tolist()
        for segment, start, end, odd in zip(segments, [0, *ends], ends, strange):  # characters without a piece become bytes
            self.known[segment] = array("i", self.search(segment)).tobytes() if odd else flat[start:end].tobytes()

    def _segments_of(self, part: str, first: bool) -> list[str]:
        marked = (SPACE if first else "") + part.replace(" ", SPACE)
        found = self.segments(marked)
        head = len(marked) - sum(map(len, found))  # what stands before the first mark of a later part
        return [marked[:head], *found] if head else found

    def _remember(self, segment: str, ids: bytes) -> bytes:
        if len(self.known) >= self.remembered:
            self.known.clear()
        if len(segment) <= 4 * self.longest:
            self.known[segment] = ids
        return ids

    def _pieces_of(self, segment: str) -> bytes:
        """Ids of a segment, as the bytes of an array."""
        if len(segment) > self.longest:
            cuts = [i for i in range(1, len(segment)) if segment[i - 1:i + 1] not in self.inside]
            if cuts:
                parts = [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])]
                return b"".join(self.known.get(p) or self._remember(p, self._pieces_of(p)) for p in parts)
        return array("i", self.search(segment)).tobytes()

    def _beginning(self, head: str) -> tuple[list, int, bool]:
        """Size and score of each way to go on inside ``head``, the greatest size, and if pieces go on behind it."""
        look, ways = self.begins.get, []
        for size in range(1, len(head) + 1):
            known = look(head[:size])
            if known and known[0] >= 0:
                ways.append((size, known[1]))
            elif size == 1:
                ways.append((1, self.unknown))  # a character that is no piece
            if known is None:
                break
        if len(self.heads) >= HEADS:
            self.heads.clear()
        found = self.heads[head] = ways, ways[-1][0], known is not None and len(head) == HEAD
        return found

    def _ids_of(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def search(self, text: str) -> Iterator[int]:
        """Ids along the best path, given out as soon as they are settled. Of equal sums the longer last piece wins."""
        look, heads, width, n = self.begins.get, self.heads.get, self.longest, len(text)
        base = reach = 0  # the last settled boundary, at which the lists below begin, and the last place got to
        room = min(n + 1, 4 * width)
        score, back = [0.0] + [_NEVER] * room, [0] * (room + 1)  # per place: best sum so far, where its last piece begins
        root: list[int] = []  # per place whose sum is final: the first boundary after base on its path
        place = -1
        while base + (place := place + 1) < n:
            if place >= width:
                settled = 0
                if place == reach:  # no piece spans this place: all paths end here
                    settled = place
                    yield from self._along(text, base, back, place)
                else:
                    for p in range(len(root), place + 1):
                        root.append((root[back[p]] or p) if p else 0)
                    # Pieces to come begin in the last window; one boundary for all of it is settled for good.
                    if root[-width:].count(root[place]) == width:
                        settled = root[place]
                        yield from self._ids_of(text[base:base + settled])
                if settled:
                    # A path past the boundary on its left ends before the window: no piece begins there any more.
                    score, back = score[settled:reach + 1], [max(0, p - settled) for p in back[settled:reach + 1]]
                    base, place, reach, root = base + settled, place - settled, reach - settled, []
                if reach + width >= len(score):
                    score += [_NEVER] * room
                    back += [0] * room
            here = score[place]
            at = base + place
            head = text[at:at + HEAD]
            ways, far, more = heads(head) or self._beginning(head)
            for size, value in ways:
                if here + value > score[place + size]:
                    score[place + size], back[place + size] = here + value, place
            if more:
                for end in range(at + HEAD + 1, min(n, at + width) + 1):
                    known = look(text[at:end])
                    if known is None:
                        break
                    if known[0] >= 0:
                        far = end - at
                        if here + known[1] > score[place + far]:
                            score[place + far], back[place + far] = here + known[1], place
            if place + far > reach:
                reach = place + far
        yield from self._along(text, base, back, n - base)

    def _along(self, text: str, base: int, back: list[int], place: int) -> list[int]:
        """Ids of the path from ``base`` to ``place`` behind it."""
        ends, ids = [], []
        while place:
            ends.append(place)
            place = back[place]
        start = base
        for end in reversed(ends):
            known = self.pieces.get(piece := text[start:base + end])
            if known:
                ids.append(known[0])
            else:
                ids += self._ids_of(piece)
            start = base + end
        return ids


class Decoder:
    """Texts of ids under one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.text = {i: p.replace(SPACE, " ").encode() for p, (i, _) in vocabulary["pieces"].items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(vocabulary["bytes"])}

    def decode(self, ids) -> str:
        """The text; ids out of the vocabulary have none, broken bytes become the replacement character."""
        found = b"".join([self.text.get(i, b"") for i in ids])
        return found[1:].decode("utf-8", "replace") if found[:1] == b" " else found.decode("utf-8", "replace")


def encode_texts(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """``doc_id, ids, n_ids, exact``: one row per row of ``docs``.

    ``exact`` tells that the ids decode to the very same text. A null text is
    an empty one, without ids. Repeated rows, very long texts and texts
    without spaces need nothing special; an empty table gives no rows; columns
    besides ``doc_id`` and ``text`` are not read. The vocabulary, of fixed
    size, is what tasks are sent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps the broadcast value between tasks, and with it the segments it remembers.
        encoder = shared.value.setdefault("encoder", None) or Encoder(shared.value)
        decoder = shared.value.setdefault("decoder", None) or Decoder(shared.value)
        shared.value.update(encoder=encoder, decoder=decoder)
        for batch in batches:
            ids, ends, exact = array("i"), [0], []
            texts = [raw.decode() for raw in utf8(batch.column(1))]
            encoder.learn(texts)
            for text in texts:
                one = encoder.encode(text)
                exact.append(decoder.decode(one) == text)
                ids.extend(one)
                ends.append(len(ids))
            ends = np.array(ends, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends).astype(np.int64)),
                                              pa.array(exact, pa.bool_())], names=["doc_id", "ids", "n_ids", "exact"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, n_ids long, exact boolean")


def decode_ids(rows: DataFrame, vocabulary: dict) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``; null ids have a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_text(rows.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
