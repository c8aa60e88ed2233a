"""Secrets in texts: fixed patterns, and more of their kind by a linear-chain conditional random field.

Tokens are what lies between white space. Each is tagged as the beginning or
the inside of a secret, or as outside, from its shape, from the tokens beside
it and from features of the whole text. The field is trained here, on a
bounded sample whose tags come from the fixed patterns, and decoded by
Viterbi: a place where the outside tag leads by more than all transitions can
ever make good is outside on every best path, so only what lies between such
places is searched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_text, utf8

# The base patterns, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "field")

BEGIN, INSIDE, OUTSIDE = range(3)
#: Texts of the training sample: so many that hold a key word, and so many that do not.
SAMPLE = 512
#: Steps of training, and what keeps weights small.
STEPS, PENALTY = 120, 0.02
_AROUND = 6
_KNOWN = 1 << 19
_NAMES = ("password", "passwd", "secret", "token", "api")
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_MIXED = str.maketrans("0123456789abcdef", "K3vQ9mZx7RbT2wLp")
_EDGES = "\"'`.,;:!?()[]{}<>#%&*$|"


def base_spans(text: str, longest: int | None = None) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start and end of the value) of the fixed patterns; ``longest`` token, if known, saves work."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), "assign", m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    if longest is None or longest >= LEAST_HEX:
        # A run of enough characters is what is left of the matches of any length.
        found += [(m.start(), "hex", m.end(), m.start(), m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _shape(core: str) -> str:
    """The turns between kinds of characters, over the whole token; many turns are told by what takes part in them."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in core]
    turns = [c for i, c in enumerate(kinds) if i == 0 or kinds[i - 1] != c]
    return "".join(turns) if len(turns) <= 4 else "many " + "".join(sorted(set(turns)))


def features(token: str, words: frozenset | set) -> tuple[str, ...]:
    """What a token shows of itself. Plain words, nearly all tokens, have few different results."""
    core = token.strip(_EDGES)
    low = core.lower()
    named = (f"word {low}",) if low in words else ()
    size = f"size {min(len(core).bit_length(), 7)}"
    if core.isalpha():
        return (size, "plain", *named)
    if not core:
        return ("mark", f"mark {token[:3]}", *named)
    digits = sum(c.isdigit() for c in core)
    value = _VALUE.fullmatch(core) is not None
    return (size, f"shape {_shape(core)}", f"digits {4 * digits // len(core)}",
            f"variety {8 * len(set(core)) // len(core)}" if len(core) > 7 else "short",
            "hex" if value and digits and not set(low) - set("0123456789abcdef") else "no hex",
            "value" if value else "no value", "quoted" if token[0] in "\"'`" else "bare", *named)


def file_features(tokens: list[str], low: str) -> tuple[str, ...]:
    """What the whole text shows: key words, and how long it is."""
    return ("file names" if any(name in low for name in _NAMES) else "file plain",
            f"file size {min(len(tokens).bit_length() // 3, 5)}")


class Field:
    """Weights of a trained field: of each feature for the three tags, and of the nine transitions."""

    def __init__(self, weights: dict[str, tuple], steps: np.ndarray, words: frozenset):
        self.weights, self.steps, self.words = weights, steps, words
        self.known: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.rows: list[list[float]] = []
        self.table = np.zeros((0, 9))
        self.margin = 2 * float(steps.max() - steps.min())

    def _sum(self, names) -> np.ndarray:
        return sum((np.array(self.weights[n]) for n in names if n in self.weights), np.zeros(3))

    def _kind(self, token: str) -> int:
        if len(self.known) >= _KNOWN:
            self.known.clear()
        own = features(token, self.words)
        kind = self.kinds.get(own)
        if kind is None:
            kind = self.kinds[own] = len(self.rows)
            self.rows.append(np.concatenate([self._sum([f"{at} {f}" for f in own]) for at in ("own", "before", "after")]))
        self.known[token] = kind
        return kind

    def scores(self, tokens: list[str], low: str) -> np.ndarray:
        """One row per token, one column per tag."""
        get = self.known.get
        kinds = [k if (k := get(t)) is not None else self._kind(t) for t in tokens]
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        cells = self.table[np.array(kinds, np.int64)]
        out = cells[:, :3] + self._sum(f"own {f}" for f in file_features(tokens, low))
        out[1:] += cells[:-1, 3:6]
        out[:-1] += cells[1:, 6:]
        return out

    def decode(self, tokens: list[str], low: str) -> list[tuple[int, int]]:
        """First and past-the-last token of each secret, along the best path of tags."""
        if not tokens:
            return []
        scores = self.scores(tokens, low)
        lead = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE])
        open_at = np.flatnonzero(lead <= self.margin)
        found: list[tuple[int, int]] = []
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1) if len(open_at) else []:
            first, last = int(run[0]), int(run[-1]) + 1
            tags = viterbi(scores[first:last], self.steps, first > 0, last < len(tokens))
            for i, tag in enumerate(tags, first):
                # An inside that follows an outside begins a secret, too.
                if tag == BEGIN or tag == INSIDE and (i == first or tags[i - first - 1] == OUTSIDE):
                    found.append((i, i + 1))
                elif tag == INSIDE:
                    found[-1] = (found[-1][0], i + 1)
        return found


def viterbi(scores: np.ndarray, steps: np.ndarray, after: bool, before: bool) -> list[int]:
    """Best tags of a run; ``after`` and ``before`` tell that an outside tag stands on that side."""
    best = scores[0] + (steps[OUTSIDE] if after else 0)
    back = []
    for row in scores[1:]:
        ways = best[:, None] + steps
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tags = [int((best + (steps[:, OUTSIDE] if before else 0)).argmax())]
    for came in reversed(back):
        tags.append(int(came[tags[-1]]))
    return tags[::-1]


def _tagged(text: str):
    """Tokens of a text with the tags that the fixed patterns give, and their places."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    tags = np.full(len(places), OUTSIDE)
    starts = np.array([p[0] for p in places])
    for _, _, _, a, b in base_spans(text):
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
        fresh = tags[first:last] == OUTSIDE
        tags[first:last][fresh] = INSIDE
        if fresh[0]:
            tags[first] = BEGIN
    return [text[a:b] for a, b in places], tags


def _examples(texts: list[str]):
    """Stretches around secrets, around other odd tokens and elsewhere, as (tokens, tags, file features)."""
    for n, text in enumerate(texts):
        tokens, tags = _tagged(text)
        secret = np.flatnonzero(tags != OUTSIDE)
        odd = [i for i, t in enumerate(tokens) if not t.strip(_EDGES).isalpha() and tags[i] == OUTSIDE]
        spread = [(n * 7919 + k * 104729) % len(tokens) for k in range(3)] if tokens else []
        upto = 0
        for i in sorted({*secret[:50].tolist(), *odd[::max(1, len(odd) // 8)], *spread}):
            first, last = max(upto, i - _AROUND), min(len(tokens), i + _AROUND + 1)
            if first < last and i >= upto:
                part, whole = tokens[first:last], file_features(tokens, text.lower())
                yield part, tags[first:last], whole
                own = tags[first:last]
                if (own != OUTSIDE).any():
                    # The same place with a value of mixed letters, and that without the name in front: neither hex
                    # digits nor an assignment are all that makes a secret.
                    mixed = [t if k == OUTSIDE else t.translate(_MIXED) for t, k in zip(part, own)]
                    yield mixed, own, whole
                    keep = [k != OUTSIDE or not (own[i + 1:i + 3] != OUTSIDE).any() for i, k in enumerate(own)]
                    yield ([t for t, k in zip(mixed, keep) if k], own[keep],
                           ("file plain", *(f for f in whole if f.startswith("file size"))))
                upto = last


def train(texts: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Fit the field to a bounded list of texts by its likelihood; without texts every tag is outside."""
    examples = list(_examples(texts))
    near = Counter()
    for tokens, tags, _ in examples:
        for i in np.flatnonzero(tags != OUTSIDE):
            near.update(t.strip(_EDGES).lower() for t in tokens[max(0, i - 2):i + 3] if len(t) <= 24)
    words = frozenset(w for w, c in near.items() if c > 2 and w)
    names: dict[str, int] = {}
    size = max((len(t) for t, _, _ in examples), default=1)
    tag = np.full((len(examples), size), -1)
    at_row, at_place, at_name = [], [], []
    for r, (tokens, tags, whole) in enumerate(examples):
        tag[r, :len(tags)] = tags
        own = [features(t, words) for t in tokens]
        for i in range(len(tokens)):
            mine = [f"own {f}" for f in (*own[i], *whole)]
            mine += [f"before {f}" for f in own[i - 1]] if i else []
            mine += [f"after {f}" for f in own[i + 1]] if i + 1 < len(own) else []
            at_name += [names.setdefault(f, len(names)) for f in mine]
            at_row += [r] * len(mine)
            at_place += [i] * len(mine)
    row, place, name = (np.array(x, np.int64) for x in (at_row, at_place, at_name))
    weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    mean, square = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    cell, cells = row * size + place, tag.size
    for step in range(1, steps + 1 if len(examples) else 1):
        scores = np.stack([np.bincount(cell, weights[name, k], cells) for k in range(3)], -1).reshape(*tag.shape, 3)
        at, pair = _expected(scores, moves, tag)
        error = (np.eye(3)[np.maximum(tag, 0)] * (tag >= 0)[..., None] - at).reshape(-1, 3)
        seen = np.zeros((3, 3))
        both = (tag[:, :-1] >= 0) & (tag[:, 1:] >= 0)
        np.add.at(seen, (tag[:, :-1][both], tag[:, 1:][both]), 1)
        slopes = [np.stack([np.bincount(name, error[cell, k], len(names)) for k in range(3)], -1) - penalty * weights,
                  seen - pair - penalty * moves]
        for i, (value, slope) in enumerate(zip((weights, moves), slopes)):
            mean[i] += 0.1 * (slope - mean[i])
            square[i] += 0.01 * (slope ** 2 - square[i])
            value += 0.1 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    if not len(examples):
        return Field({"own plain": (0.0, 0.0, 1.0), "own mark": (0.0, 0.0, 1.0), "own no value": (0.0, 0.0, 1.0),
                      "own value": (0.0, 0.0, 1.0)}, moves, words)
    return Field({n: tuple(weights[i].tolist()) for n, i in names.items()}, moves, words)


def _expected(scores, moves, tag):
    """Chances of each tag at each place, and expected transitions, by forward and backward sums."""
    n, size, _ = scores.shape
    here = tag >= 0
    ahead = np.zeros((n, size, 3))
    ahead[:, 0] = scores[:, 0]
    behind = np.zeros((n, size, 3))
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for i in range(1, size):
        moved = add(ahead[:, i - 1, :, None] + moves, 1) + scores[:, i]
        ahead[:, i] = np.where(here[:, i, None], moved, ahead[:, i - 1])
    for i in range(size - 2, -1, -1):
        moved = add(moves + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where(here[:, i + 1, None], moved, 0)
    total = add(ahead[:, -1], 1)
    at = np.exp(ahead + behind - total[:, None, None]) * here[..., None]
    both = here[:, 1:]
    pair = np.exp(ahead[:, :-1, :, None] + moves + (scores + behind)[:, 1:, None, :] - total[:, None, None, None])
    return at, (pair * both[..., None, None]).sum(axis=(0, 1))


def sample_texts(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """At most ``2 * size`` texts: those of the smallest hashes with a key word in them, and without.

    First only the hashes are ranked; then the texts of those that are chosen
    are read, so what reaches the driver does not grow with the number of tasks
    beyond the hashes.
    """
    low = F.lower("text")
    named = low.contains(_NAMES[0])
    for name in _NAMES[1:]:
        named |= low.contains(name)
    rows = docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), named.alias("named"), "text")
    ranked = rows.select("h", "named").distinct()
    last = {}
    for side in (True, False):
        found = [r["h"] for r in ranked.where(F.col("named") == side).orderBy("h").limit(size).collect()]
        last[side] = max(found, default=None)
    wanted = [(F.col("named") == side) & (F.col("h") <= h) for side, h in last.items() if h is not None]
    if not wanted:
        return []
    chosen = rows.where(wanted[0] if len(wanted) == 1 else wanted[0] | wanted[1]).groupBy("named", "h").agg(
        F.min("text").alias("text"))
    return [r["text"] for r in chosen.orderBy(F.desc("named"), "h").collect()]


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, spans``: one row per row of ``docs``; ``spans`` holds kind, start and end in code points.

    Spans are ordered by start, then as the kinds are listed; those of the
    field (kind ``field``) are the ones that no fixed pattern overlaps. A null
    text is an empty one and has no spans. Repeated rows, very long texts and
    texts of one token need nothing special; empty tables give no rows; other
    columns are not read. The field's weights, bounded by the sample, are what
    tasks are sent.
    """
    parts = (field.weights, field.steps, field.words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*parts)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "stop"), s)) for s in _spans(raw.decode(), own)]
                     for raw in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])
    return map_text(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, spans array<struct<kind:string,start:long,stop:long>>")


def _spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    tokens = text.split()
    base = base_spans(text, max(map(len, tokens), default=0))
    more = field.decode(tokens, text.lower())
    if more:
        places = _places(text, tokens, sorted({i for run in more for i in (run[0], run[1] - 1)}))
        for first, past in more:
            inner = list(_VALUE.finditer(text, places[first][0], places[past - 1][1]))
            if not inner:
                continue
            start, end = (max(inner, key=lambda m: m.end() - m.start()).span() if past - first == 1
                          else (inner[0].start(), inner[-1].end()))
            if not any(a < end and start < b for a, _, b, _, _ in base):
                base.append((start, "field", end, start, end))
        base.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return [(kind, start, end) for start, kind, end, _, _ in base]


def _places(text: str, tokens: list[str], wanted: list[int]) -> dict[int, tuple[int, int]]:
    """Where the wanted tokens stand in the text."""
    places, at, n = {}, 0, 0
    for i in wanted:
        for token in tokens[n:i + 1]:
            at = text.index(token, at) + len(token)
        n = i + 1
        places[i] = (at - len(tokens[i]), at)
    return places
