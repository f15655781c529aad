"""Personal data: four base patterns, and a semi-Markov conditional random field that adds spans.

Base spans (email, ip, card, phone) are found by their patterns with checks of parts, digits and the Luhn sum. The
random field works on windows of white-space tokens around digits and at-signs. A segment of one to MAX_TOKENS tokens,
trimmed of outer punctuation, gets features of the whole span (digits, separators, at-signs, Luhn sum, quad of parts,
plus sign, letters, the word before); a tag's score is linear in them (Sarawagi and Cohen 2004). Weights maximise the
likelihood, by forward and backward sums over segmentations, of the base spans in a bounded sample of windows and of
near misses made from these: spans rewritten in forms that the patterns do not match (other separators, a phone without
its plus sign or with digits behind it, an address with spaces around its at-sign), and numbers of like shape that are no
personal data. Decoding is a dynamic program over positions and the number of entities so far, which chooses boundaries
and types together; a window of n tokens holds n entities at most, so that bound never cuts. Decoded segments that overlap
no base span and beat the alternative without them by `margin` are added; of those that overlap, the one that begins
first.

Long stretches are cut into windows of WINDOW tokens that overlap by MAX_TOKENS - 1 or more, so that every segment lies
whole in one. Segments of more than MAX_CHARS characters are none: no kind is that long.

Spans are kind:start:end in code points, end exclusive, by start, then by kind as listed in KINDS.

Defined cases: a null or empty text has no spans; without windows to learn from nothing is added; repeated rows give
the same spans each; a long text is cut into windows, so time is linear in it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.bytehash import slices
from textsieve.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, WINDOW, AROUND = 7, 32, 3
BATCH_BYTES = 8 << 20
MAX_CHARS, MISS_WINDOWS = 320, 150
# The base patterns. The look-behinds only skip starts that cannot match or lie in a longer match.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_TRIGGER = re.compile(r"[0-9@]")
_OUTER = " \t\n\r\x0b\x0c,;:!?|\"'<>[]{}*#$%&=~_\\/"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token bounds of the stretches around triggers, WINDOW tokens at most each."""
    if not _TRIGGER.search(text):
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    hot = [k for k, (a, b) in enumerate(tokens) if _TRIGGER.search(text, a, b)]
    i = end = 0
    while i < len(hot):
        lo, j = max(0, hot[i] - AROUND), i
        if lo < end:  # the stretch goes on from the last window
            lo = max(0, min(lo, end - MAX_TOKENS + 1))
        while j + 1 < len(hot) and hot[j + 1] - hot[j] <= AROUND and hot[j + 1] + AROUND - lo < WINDOW:
            j += 1
        end = hot[j] + AROUND + 1
        yield tokens[lo:end]
        i = j + 1


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _OUTER:
        a += 1
    while a < b and (text[b - 1] in _OUTER or text[b - 1] in "."):
        b -= 1
    if a < b and text[a] == "(" and text.count(")", a, b) == 0:
        a += 1
    return a, b


def span_features(s: str, before: str, tokens: int) -> tuple[str, ...]:
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    size = next(k for k, top in enumerate((0, 3, 6, 8, 11, 15, 16, 19, 1 << 60)) if n <= top)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    letters = any(c.isalpha() for c in s)
    seps = "".join(sorted({c for c in s if c in " -()./"}))
    odd = any(not (c.isalnum() or c in " -()./+@_%") for c in s)
    local = "@" in s and bool(name := s.partition("@")[0].strip(" ")) and all(c in _LOCAL for c in name)
    domain = "@" in s and _DOMAIN.fullmatch(s.rpartition("@")[2].strip(" ")) is not None
    return (
        "bias", f"digits{size}", f"seps{seps}", f"tokens{tokens}", f"quad{quad}", f"at{min(s.count('@'), 2)}{domain}", f"local{local}{domain}",
        f"plus{s[:1] == '+'}", f"letters{letters}", f"luhn{n >= 12 and luhn(digits)}{n >= 12}", f"quad{quad}letters{letters}",
        f"plus{s[:1] == '+'}size{size}", f"size{size}letters{letters}luhn{n >= 12 and luhn(digits)}", f"word{before if before in _CUES else ''}", f"odd{odd}", f"seps{seps}size{size}plus{s[:1] == '+'}",
    )


#: Words before a span that tell of its kind.
_CUES = frozenset(("tel", "phone", "call", "mobile", "fax", "email", "mail", "contact", "card", "visa", "ip", "address", "host", "id", "no", "number"))


@dataclass
class SemiMarkov:
    weights: dict[tuple[int, str], float] = field(default_factory=dict)
    margin: float = 4.0

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int, int, tuple[str, ...]]]]:
        """By end token: (first token, start, end, features) of each segment with a trigger."""
        out: list[list] = []
        for j in range(len(tokens)):
            row = []
            for i in range(max(0, j - MAX_TOKENS + 1), j + 1):
                a, b = trimmed(text, tokens[i][0], tokens[j][1])
                # the span must reach into its first and last token
                if a < tokens[i][1] and b > tokens[j][0] and a < b and b - a <= MAX_CHARS and _TRIGGER.search(text, a, b):
                    before = text[tokens[i - 1][0] : tokens[i - 1][1]].strip(_OUTER + ".").lower() if i else ""
                    row.append((i, a, b, span_features(text[a:b], before, j - i + 1)))
            out.append(row)
        return out

    def score(self, kind: int, features: tuple[str, ...]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in features)

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        n = len(tokens)
        segments = self.segments(text, tokens)
        scored = [[(i, a, b, *max((self.score(k, f), k) for k in range(len(KINDS)))) for i, a, b, f in row] for row in segments]
        bound = n  # a window of n tokens holds n entities at most, so the bound never cuts
        best = np.full((n + 1, bound + 1), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple] = {}
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, a, b, s, k in scored[j - 1]:
                if s > 0:
                    gain = best[i, :-1] + s
                    for e in np.flatnonzero(gain > best[j, 1:]).tolist():
                        best[j, e + 1] = gain[e]
                        back[j, e + 1] = (i, a, b, s, k)
        e, j, out = int(best[n].argmax()), n, []
        while j > 0:
            if (j, e) in back and best[j, e] > best[j - 1, e]:
                i, a, b, s, k = back[j, e]
                if s >= self.margin:
                    out.append((a, k, b))
                j, e = i, e - 1
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]], epochs: int = 8, rate: float = 0.5, penalty: float = 1e-4) -> SemiMarkov:
        """AdaGrad on the conditional likelihood; examples: text, tokens, gold kinds by (start, end)."""
        squares: dict[tuple[int, str], float] = {}
        prepared = []
        for text, tokens, gold in examples:
            segments = self.segments(text, tokens)
            true = [(f, gold[a, b]) for row in segments for _, a, b, f in row if (a, b) in gold]
            if len({*gold}) == len(true):
                prepared.append((segments, true))
        for _ in range(epochs):
            for segments, true in prepared:
                gradient: dict[tuple[int, str], float] = {}
                for f, k in true:
                    for x in f:
                        gradient[k, x] = gradient.get((k, x), 0.0) + 1.0
                n = len(segments)
                scores = [[[self.score(k, f) for k in range(len(KINDS))] for *_, f in row] for row in segments]
                forward = np.zeros(n + 1)
                for j in range(1, n + 1):
                    terms = [forward[j - 1], *(forward[i] + s for (i, *_), each in zip(segments[j - 1], scores[j - 1], strict=True) for s in each)]
                    forward[j] = np.logaddexp.reduce(terms)
                ahead: list[list[float]] = [[] for _ in range(n + 1)]
                backward = np.zeros(n + 1)
                for j in range(n, 0, -1):
                    if j < n:
                        backward[j] = np.logaddexp.reduce(ahead[j])
                    ahead[j - 1].append(backward[j])
                    for (i, *_), each in zip(segments[j - 1], scores[j - 1], strict=True):
                        ahead[i].extend(backward[j] + s for s in each)
                for j in range(1, n + 1):
                    for (i, _, _, f), each in zip(segments[j - 1], scores[j - 1], strict=True):
                        for k, s in enumerate(each):
                            p = float(np.exp(forward[i] + s + backward[j] - forward[n]))
                            if p > 1e-4:
                                for x in f:
                                    gradient[k, x] = gradient.get((k, x), 0.0) - p
                for key, g in gradient.items():
                    g -= penalty * self.weights.get(key, 0.0)
                    squares[key] = squares.get(key, 0.0) + g * g
                    if squares[key] > 0:
                        self.weights[key] = self.weights.get(key, 0.0) + rate * g / np.sqrt(squares[key])
        return self


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows as own texts, with their base spans, and a hash to order them by."""
    for batch in (part for b in batches for part in slices(b, 0, BATCH_BYTES)):
        out = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for tokens in windows(text):
                lo, hi = tokens[0][0], tokens[-1][1]
                inside = [(a - lo, k, b - lo) for a, k, b in spans if a < hi and b > lo]
                out.append((text[lo:hi], ";".join(f"{a},{k},{b}" for a, k, b in inside), hashlib.md5(text[lo:hi].encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["snippet", "gold", "draw"])


def near_misses(text: str, gold: dict[tuple[int, int], int]) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Copies of an example with one span rewritten as the patterns do not match it, and with a like number that is none."""
    rng = random.Random(text)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cut = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    out = []
    for (a, b), kind in sorted(gold.items()):
        s, own = text[a:b], "".join(c for c in text[a:b] if "0" <= c <= "9")
        forms: list[tuple[str, int]] = []  # the new text, and how much of it is the span
        if kind == 0:
            forms = [(x, len(x)) for x in (s.replace("@", " @ "), s.replace("@", "@ "))]
        elif kind == 2:
            forms = [(x, len(x)) for x in (cut(own, "."), cut(own, "/"), cut(own, " - "))]
        elif kind == 3:
            bare = s.lstrip("+")
            forms = [(x, len(x)) for x in (bare, f"00{bare}", f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:-7]}.{own[-7:-4]}.{own[-4:]}")]
            forms += [(f"{s} {x}", len(s)) for x in (digits(7), f"({digits(3)})")]
        for new, n in forms:
            move = len(new) - len(s)
            others = {(x + move, y + move) if x >= b else (x, y): k for (x, y), k in gold.items() if (x, y) != (a, b)}
            out.append((text[:a] + new + text[b:], others | {(a, a + n): kind}))
        number = next(d for d in iter(lambda: digits(16), None) if not luhn(d))
        for new in (cut(number, "."), cut(number, " - "), number, f"{digits(4)}-0{digits(1)}-1{digits(1)} 1{digits(1)}:2{digits(1)}:3{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)}-{digits(4)}", f"19{digits(2)}-19{digits(2)}", digits(9), f"{digits(2)}.{digits(1)} - {digits(2)}.{digits(1)}"):
            move = len(new) - len(s)
            out.append((text[:a] + new + text[b:], {(x + move, y + move) if x >= b else (x, y): k for (x, y), k in gold.items() if (x, y) != (a, b)}))
    return out


def fit_pii(docs: DataFrame, sample_docs: int = 2_000, sample_windows: int = 300) -> SemiMarkov:
    """Learns from sample_windows windows with and as many without base spans, of the sample_docs documents with a digit or
    at-sign whose ids hash lowest, and from near misses made of the first MISS_WINDOWS of them."""
    ids = texts(docs).where(F.col("text").rlike("[0-9@]")).select("doc_id", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(sample_docs).select("doc_id")
    ids = [r[0] for r in ids.collect()]
    if not ids:
        return SemiMarkov()
    chosen = docs.sparkSession.createDataFrame([(i,) for i in {*ids}], "doc_id long")
    found = texts(docs).join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(_examples, "snippet string, gold string, draw string").dropDuplicates(["draw"])
    examples = []
    for condition in ("gold <> ''", "gold = ''"):
        for r in found.where(condition).orderBy("draw").limit(sample_windows).collect():
            gold = {(int(a), int(b)): int(k) for a, k, b in (x.split(",") for x in r["gold"].split(";") if x)}
            examples.append((r["draw"], r["snippet"], gold))
    examples = [(text, gold) for _, text, gold in sorted(examples, key=lambda x: x[0])]
    for text, gold in list(examples)[:MISS_WINDOWS]:
        examples += near_misses(text, gold)
    return SemiMarkov().fit([(text, [m.span() for m in _TOKEN.finditer(text)], gold) for text, gold in examples])


def find_pii(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """(doc_id, base, added: array<struct<start, kind, end>>) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit_pii(docs))
    spans = "array<struct<start:int,kind:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_model, kind = sent.value, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda xs: [dict(zip(("start", "kind", "end"), x, strict=True)) for x in xs]
        for batch in (part for b in batches for part in slices(b, 1, BATCH_BYTES)):
            base, added = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                base.append(as_rows(own))
                more = []
                if field_model.weights:
                    ends = [b for _, _, b in own]
                    for tokens in windows(text):
                        for a, k, b in field_model.decode(text, tokens):
                            if not any(s < b and a < e for (s, _, _), e in zip(own, ends, strict=True)):
                                more.append((a, k, b))
                apart, free = [], 0
                for a, k, b in sorted(set(more)):
                    if a >= free:
                        apart.append((a, k, b))
                        free = b
                added.append(as_rows(apart))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    return texts(docs).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def joined(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
