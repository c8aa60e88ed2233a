"""Personal data in texts: fixed patterns, and more of their kind by a semi-Markov conditional random field.

The field scores whole spans. A candidate is a run of at most SPAN_TOKENS
tokens that could be an address, an internet address, a card or a telephone
number; its features are those of the span as one: the lengths of its groups
and what stands between them, the count of its digits, whether its check digit
or its octets hold, and the words beside it. What is no entity is outside, one
token at a time. A dynamic programme over the places of a text, with spans of
bounded length ending at each, chooses the best sequence of labelled spans, and
so boundaries and types together. Where no candidate covers a place everything
is outside, so only the stretches that candidates cover are searched; the
result is the same.

The field is trained here by its likelihood, through forward and backward sums
over the same spans, on a bounded sample of stretches: the labels come from the
fixed patterns, and their values are also spelled in other ways, right and
wrong.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_text, utf8

# The base patterns, in their order. The first two are written so that no text takes quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TYPES = ("email", "ip", "card", "phone")
#: Kinds of spans as they are listed: those of the patterns, then those that only the field found.
KINDS = (*TYPES, *(f"crf_{t}" for t in TYPES))

#: Bounds of an entity: tokens, and characters that are looked at on each side of an anchor.
SPAN_TOKENS, AROUND = 16, 96
#: Texts of the training sample that hold a base span, and that do not; drawn from about so many rows.
SAMPLE, DRAWN = 512, 1 << 14
#: Stretches of one sample text, and different stretches that are trained on.
STRETCHES, DIFFERENT = 16, 1000
STEPS, PENALTY = 50, 0.1

_QUICK = re.compile(r"[0-9@]")
_NUMBERS = re.compile(r"[0-9](?:[ +().\-/\[\]]{0,3}[0-9]){3,}")
_SIGNS = re.compile(r"\bdot\b|[\[(] ?at ?[\])]", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_MARKS = frozenset("+().-/[]")
_OPEN, _CLOSE = "([", ")]"


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start and then by kind as listed."""
    if not _QUICK.search(text):
        return []
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append((start, "email", end))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidates may stand: the surroundings of each anchor, merged where they meet."""
    low, anchors = text.lower(), []
    if _QUICK.search(text):
        anchors = [m.span() for m in _NUMBERS.finditer(text)]
        at = text.find("@")
        while at >= 0:
            anchors.append((at, at + 1))
            at = text.find("@", at + 1)
    if "dot" in low or "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        anchors += [m.span() for m in _SIGNS.finditer(text)]
    found: list[tuple[int, int]] = []
    for a, b in sorted(anchors):
        start, end = max(0, a - AROUND), min(len(text), b + AROUND)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], end))
        else:
            found.append((start, end))
    return found


class _Tokens:
    """Tokens of a stretch: places, texts, and what stands before each (nothing, a space, or more)."""

    def __init__(self, text: str, start: int, end: int):
        spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.texts = [text[a:b] for a, b in spans]
        self.low = [t.lower() for t in self.texts]
        self.gaps = ["\n", *(text[a:b] if b - a < 2 else "\n" for a, b in zip(self.ends, self.starts[1:]))]
        self.number = ["0" <= t[0] <= "9" for t in self.texts]
        self.word = [t.isalpha() for t in self.texts]

    def beside(self, i: int, gap: str, words: frozenset) -> str:
        if not 0 <= i < len(self.texts):
            return "edge"
        near = "joined " if gap == "" else ""
        if self.number[i]:
            return near + "number"
        return near + ((self.low[i] if self.low[i] in words else "word") if self.word[i] else self.texts[i])


def candidates(t: _Tokens, words: frozenset) -> list[tuple[int, int, int, tuple[str, ...]]]:
    """(first, past the last, type, features) of each span that could be an entity."""
    found, n = [], len(t.texts)

    def add(i, j, kind, *own):
        after = t.gaps[j] if j < n else "\n"
        around = (f"before {t.beside(i - 1, t.gaps[i], words)}", f"after {t.beside(j, after, words)}")
        found.append((i, j, kind, tuple(f"{TYPES[kind - 1]} {f}" for f in ("any", *own, *around))))

    for i in range(n):
        if t.number[i] or t.texts[i] in "+(":
            digits, groups, between, shape = "", [], [], ""
            for j in range(i, min(n, i + SPAN_TOKENS)):
                if j > i and t.gaps[j] not in ("", " ") or not (t.number[j] or t.texts[j] in _MARKS):
                    break
                shape += t.gaps[j] if j > i else ""
                if not t.number[j]:
                    shape += t.texts[j]
                    continue
                between.append(shape[shape.rfind("}") + 1:])
                groups.append(t.texts[j])
                digits += t.texts[j]
                shape += "{" + str(len(t.texts[j])) + "}"
                if len(digits) > 19:
                    break
                plain = shape[0] == "{" and set("".join(between)) <= set(" .-/")
                if 12 <= len(digits) and plain:
                    add(i, j + 1, 3, f"shape {shape}", f"digits {len(digits)}", f"check {luhn(digits)}",
                        f"groups {len(groups)}", f"between {''.join(sorted(set(''.join(between))))}")
                if 7 <= len(digits) <= 15:
                    add(i, j + 1, 4, f"shape {shape}", f"digits {len(digits)}", f"plus {shape[0] == '+'}",
                        f"groups {len(groups)}", f"between {''.join(sorted(set(''.join(between))))}")
                if len(groups) == 4 and shape[0] == "{" and len(set(between[1:])) == 1 and all(len(g) <= 3 for g in groups):
                    add(i, j + 1, 2, f"between {between[1]}", f"octets {all(map(_small, groups))}",
                        f"digits {min(len(digits), 8)}")
    for a in range(n):
        if t.texts[a] == "@" or t.low[a] == "at":
            _emails(t, a, add)
    return found


def _emails(t: _Tokens, a: int, add) -> None:
    """Addresses around the sign or word at ``a``: a part before it, and labels behind it with dots between."""
    n, i, j = len(t.texts), a - 1, a + 1
    mark = t.texts[a] if t.texts[a] == "@" else "at"
    if i >= 0 and t.texts[i] in _OPEN and j < n and t.texts[j] in _CLOSE:
        mark, i, j = "(at)", i - 1, j + 1
    elif mark == "at" and (t.gaps[a] != " " or a + 1 < n and t.gaps[a + 1] != " "):
        return
    starts = []
    while i >= 0 and a - i < SPAN_TOKENS // 2 and (t.number[i] or t.word[i] or t.texts[i] in "._%+-"):
        if t.number[i] or t.word[i]:
            starts.append(i)
        if t.gaps[i] != "":
            break
        i -= 1
    dots, labels = [], 0
    while starts and j < n and j - a < SPAN_TOKENS // 2 and (t.number[j] or t.word[j]):
        if labels and dots[-1] == "." and t.gaps[j] != "" or t.gaps[j] not in ("", " "):
            break
        while j + 1 < n and t.gaps[j + 1] == "" and (t.number[j + 1] or t.word[j + 1] or t.texts[j + 1] == "-"):
            j += 1
        labels, j = labels + 1, j + 1
        if labels > 1:
            for start in starts:
                if j - start <= SPAN_TOKENS:
                    whole = start == starts[-1]
                    add(start, j, 1, f"mark {mark}", f"dots {' '.join(sorted(set(dots)))}", f"labels {min(labels, 4)}",
                        f"whole {whole}", f"last {'word' if t.word[j - 1] and 1 < len(t.texts[j - 1]) < 8 else 'other'}")
        if j < n and t.texts[j] == "." and t.gaps[j] == "":
            dots, j = [*dots, "."], j + 1
        elif j < n and t.low[j] == "dot" and t.gaps[j] == " ":
            dots, j = [*dots, "dot"], j + 1
        elif j + 2 < n and t.texts[j] in _OPEN and t.low[j + 1] in ("dot", ".") and t.texts[j + 2] in _CLOSE:
            dots, j = [*dots, "(dot)"], j + 3
        else:
            break


def clusters(found: list) -> Iterator[list]:
    """Candidates in runs that touch or overlap: between these every place is outside."""
    found = sorted(found, key=lambda c: (c[0], c[1], c[2]))
    run, end = [], -1
    for c in found:
        if run and c[0] > end:
            yield run
            run = []
        run.append(c)
        end = max(end, c[1]) if len(run) > 1 else c[1]
    if run:
        yield run


class Field:
    """Weights of the features of spans, and of a label (outside first) after another."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, words: frozenset):
        self.weights, self.steps, self.words = weights, steps, words
        self._known: dict[tuple, float] = {}

    def score(self, features: tuple[str, ...]) -> float:
        if len(self._known) > 1 << 17:
            self._known.clear()
        if features not in self._known:
            self._known[features] = sum(self.weights.get(f, 0.0) for f in features)
        return self._known[features]

    def decode(self, run: list) -> list[tuple[int, int, int]]:
        """The best sequence of labelled spans of one cluster: (first, past the last, type) of its entities."""
        return best_spans([(i, j, y, self.score(f)) for i, j, y, f in run], self.steps)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, type) of the entities of a text."""
        out = []
        for a, b in stretches(text):
            t = _Tokens(text, a, b)
            for run in clusters(candidates(t, self.words)):
                out += [(t.starts[i], t.ends[j - 1], y) for i, j, y in self.decode(run)]
        return out


def best_spans(spans: list[tuple[int, int, int, float]], steps: np.ndarray) -> list[tuple[int, int, int]]:
    """Labelled spans of the highest sum over spans and steps; outside stands on either side."""
    first, last = min(s[0] for s in spans), max(s[1] for s in spans)
    moves, labels = steps.tolist(), range(len(steps))
    by_end: dict[int, list] = {}
    for s in spans:
        by_end.setdefault(s[1], []).append(s)
    best = {first: [0.0] + [-math.inf] * (len(moves) - 1)}
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for at in range(first + 1, last + 1):
        row = [-math.inf] * len(moves)
        for i, _, y, score in [(at - 1, at, 0, 0.0), *by_end.get(at, ())]:
            come = max(labels, key=lambda x: best[i][x] + moves[x][y])
            value = best[i][come] + moves[come][y] + score
            if value > row[y]:
                row[y], back[at, y] = value, (i, come)
        best[at] = row
    y, at, out = max(labels, key=lambda x: best[last][x] + moves[x][0]), last, []
    while at > first:
        i, come = back[at, y]
        if y:
            out.append((i, at, y))
        at, y = i, come
    return out[::-1]


def expected(spans: list[tuple[int, int, int, float]], steps: np.ndarray):
    """Log of the sum over all sequences, the chance of each span, and the expected count of each step."""
    first, last, size = min(s[0] for s in spans), max(s[1] for s in spans), len(steps)
    every = sorted([(at, at + 1, 0, 0.0, -1) for at in range(first, last)] + [(*s, n) for n, s in enumerate(spans)])
    ahead, behind = {at: np.full(size, -np.inf) for at in range(first, last + 1)}, {}
    ahead[first][0] = 0.0
    for i, j, y, score, _ in every:  # by start: all that end at i have been added
        ahead[j][y] = np.logaddexp(ahead[j][y], np.logaddexp.reduce(ahead[i] + steps[:, y]) + score)
    behind = {at: np.full(size, -np.inf) for at in range(first, last + 1)}
    behind[last] = steps[:, 0].copy()
    for i, j, y, score, _ in reversed(every):
        behind[i] = np.logaddexp(behind[i], steps[:, y] + score + behind[j][y])
    total = float(np.logaddexp.reduce(ahead[last] + steps[:, 0]))
    chance, moved = np.zeros(len(spans)), np.zeros_like(steps)
    for i, j, y, score, n in every:
        step = np.exp(ahead[i] + steps[:, y] + score + behind[j][y] - total)
        moved[:, y] += step
        if n >= 0:
            chance[n] = step.sum()
    moved[:, 0] += np.exp(ahead[last] + steps[:, 0] - total)
    return total, chance, moved


def _spelled(kind: str, value: str) -> list[tuple[str, bool]]:
    """Other spellings of a value, and whether they are still one."""
    digits = _digits(value)
    if kind == "email":
        name, _, domain = value.partition("@")
        return [(f"{name} at {domain.replace('.', ' dot ')}", True), (f"{name}(at){domain}", True),
                (f"{name} [at] {domain.replace('.', ' [dot] ')}", True), (f"{name}@{domain.split('.')[0]}", False),
                (f"{name} at {domain.split('.')[0]}", False)]
    if kind == "ip":
        parts = value.split(".")
        return [("[.]".join(parts), True), ("(.)".join(parts), True), (" . ".join(parts), True),
                (".".join(["9" + p.rjust(2, "0")[-2:] for p in parts]), False), (".".join(parts[:3]), False),
                ("[.]".join(["8" + p.rjust(2, "0")[-2:] for p in parts]), False), ("/".join(parts), False)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        bad = [wrong[i:i + 4] for i in range(0, len(wrong), 4)]
        return [(".".join(fours), True), ("/".join(fours), True), (" - ".join(fours), True), (wrong, False),
                (".".join(bad), False), ("-".join(bad), False), (" ".join(bad), False),
                (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]} {digits[8:10]}.{digits[10:12]}", False),
                (f"{digits[:4]}/{digits[4:6]}/{digits[6:8]}", False), (digits[:10], False), (digits[:8], False),
                (f"{digits[0]}.{digits[1:4]}.{digits[4:7]}.{digits[7:10]}", False),
                (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", False), (f"{digits[:4]} - {digits[4:8]}", False)]
    code, rest = digits[:-10] or "1", digits[-10:]
    area, middle, last = rest[:-7], rest[-7:-4], rest[-4:]
    return [(f"({area}) {middle}-{last}", True), (f"{area}-{middle}-{last}", True), (f"00{code} {area} {middle} {last}", True),
            (f"+{code}/{area}/{middle}{last}", True), (f"{area}{middle}{last}", False), (f"{middle}{last}", False),
            (f"{area}, {middle}, {last}", False), (f"{middle}.{last}", False)]


def _examples(texts: list[str], words: frozenset):
    """Clusters of candidates with the entities that the fixed patterns give, in the texts and in other spellings."""
    for text in texts:
        base, end = [], 0
        for start, kind, stop in sorted(base_spans(text), key=lambda s: (s[0], -s[2])):
            if start >= end:  # of spans that overlap the first and longest
                base.append((start, kind, stop))
                end = stop
        yield from _labelled(text, base, words)
        for start, kind, stop in base[:4]:
            left, right = text[max(0, start - 40):start], text[stop:stop + 40]
            if not base_spans(left) and not base_spans(right):
                for value, good in _spelled(kind, text[start:stop]):
                    spans = [(len(left), kind, len(left) + len(value))] if good else []
                    yield from _labelled(left + value + right, spans, words)


def _labelled(text: str, base: list, words: frozenset):
    wanted = {(a, b): TYPES.index(kind) + 1 for a, kind, b in base}
    for a, b in stretches(text):
        t = _Tokens(text, a, b)
        for run in clusters(candidates(t, words)):
            gold = {(i, j, y) for i, j, y, _ in run if wanted.get((t.starts[i], t.ends[j - 1])) == y}
            lo, hi = t.starts[min(c[0] for c in run)], t.ends[max(c[1] for c in run) - 1]
            if len(gold) == sum(1 for x, y in wanted if x < hi and y > lo):  # each can be said by the candidates
                at = min(c[0] for c in run)
                yield (tuple((i - at, j - at, y, f) for i, j, y, f in run), tuple(sorted((i - at, j - at, y) for i, j, y in gold)))


def train(texts: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Fit the field to a bounded list of texts by its likelihood; without texts no span is an entity."""
    near = Counter()
    for text in texts:
        for start, _, end in base_spans(text):
            near.update(w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, start - 24):start] + " " + text[end:end + 16])[-3:])
    words = frozenset(w for w, n in near.items() if n > 8)
    counted = Counter(_examples(texts, words)).most_common(DIFFERENT)
    names: dict[str, int] = {}
    rows = [[np.array([names.setdefault(f, len(names)) for f in c[3]]) for c in run] for (run, _), _ in counted]
    weights, moves = np.zeros(len(names)), np.zeros((len(TYPES) + 1,) * 2)
    mean, square = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1 if counted else 1):
        slopes = [-penalty * weights, -penalty * moves]
        for ((run, gold), n), own in zip(counted, rows):
            spans = [(*c[:3], float(weights[f].sum())) for c, f in zip(run, own)]
            _, chance, moved = expected(spans, moves)
            n = math.sqrt(n)  # what repeats very often does not outvote the rest
            for c, f, p in zip(run, own, chance):
                np.add.at(slopes[0], f, n * ((c[:3] in gold) - p))
            slopes[1] += n * (_moves(run, gold, len(moves)) - moved)
        for i, (value, slope) in enumerate(zip((weights, moves), slopes)):
            mean[i] += 0.1 * (slope - mean[i])
            square[i] += 0.01 * (slope ** 2 - square[i])
            value += 0.2 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    if not counted:
        return Field({f"{kind} any": -1.0 for kind in TYPES}, moves, words)
    return Field(dict(zip(names, weights.tolist())), moves, words)


def _moves(run, gold, size: int) -> np.ndarray:
    """The steps of the right sequence, outside before and after it."""
    seen, at, label = np.zeros((size, size)), min(c[0] for c in run), 0
    last = max(c[1] for c in run)
    for i, j, y in [*gold, (last, last, 0)]:
        while at < i:
            seen[label, 0] += 1
            label, at = 0, at + 1
        seen[label, y] += 1
        label, at = y, j
    return seen


def sample_texts(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """Stretches of at most ``2 * size`` texts: ``size`` that hold a base span, and ``size`` that do not but hold an anchor.

    About DRAWN rows are drawn by the hash of their text, whatever the table's
    size; equal texts count once. Their stretches are cut in the tasks, at most
    STRETCHES of a text, so no whole text reaches the driver.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())
    share = min(1.0, DRAWN / max(1, docs.count()))
    drawn = hashed.where(F.col("h") <= int((2 * share - 1) * ((1 << 63) - 1))) if share < 1 else hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], []
            for raw in utf8(batch.column(0)):
                text = raw.decode()
                cut = [text[a:min(b, a + 4 * AROUND)] for a, b in stretches(text)]
                cut.sort(key=lambda s: not base_spans(s))  # those with a base span first
                parts.append(cut[:STRETCHES])
                held.append(bool(cut) and bool(base_spans(cut[0])))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.bool_()), pa.array(parts, pa.list_(pa.string()))],
                                             names=["h", "held", "parts"])
    cut = map_text(drawn, run, "h long, held boolean, parts array<string>").where(F.size("parts") > 0)
    once = cut.groupBy("h", "held").agg(F.min("parts").alias("parts"))
    return [part for held in (True, False)
            for r in once.where(F.col("held") == held).orderBy("h").limit(size).collect() for part in r["parts"]]


def find_personal(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, spans``: one row per row of ``docs``; ``spans`` holds kind, start and end in code points.

    Spans are ordered by start, then as KINDS lists them; those of the field
    (kinds ``crf_...``) are the ones that no fixed pattern overlaps. A null
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
            found = [[dict(zip(("kind", "start", "stop"), s)) for s in all_spans(raw.decode(), own)]
                     for raw in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])
    return map_text(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, spans array<struct<kind:string,start:long,stop:long>>")


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, and of the entities of the field that overlap none of these."""
    base = base_spans(text)
    more = [(a, f"crf_{TYPES[y - 1]}", b) for a, b, y in field.spans(text)]
    if more:
        union: list[list[int]] = []
        for a, _, b in base:
            if union and a < union[-1][1]:
                union[-1][1] = max(union[-1][1], b)
            else:
                union.append([a, b])
        ends = [b for _, b in union]
        for a, kind, b in more:
            at = bisect_right(ends, a)  # the first that ends behind the start
            if at == len(ends) or union[at][0] >= b:
                base.append((a, kind, b))
        base.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return [(kind, a, b) for a, kind, b in base]
