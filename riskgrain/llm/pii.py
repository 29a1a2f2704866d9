"""Personal data by a semi-Markov conditional random field over candidate windows, beside fixed base patterns.

Four base patterns are found exactly. The random field looks at candidate segments, runs of up to a few pieces that are
shaped like numbers or addresses, scores each as a whole by features of its span for every type, and picks boundaries and
types together by dynamic programming over segments of bounded length. Its spans that overlap no base span are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import free_name, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Segment types of the random field.
LABELS = ("none", *KINDS)
#: Pieces, divided by spaces, that one entity may have.
MAX_PIECES = 5

# The base patterns. A run of digits is entered only at its start, which finds the same matches.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by kind, then start; leftmost and non-overlapping within a kind."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# Candidates: runs of number pieces, and addresses whose signs may be spelled out. Fixed values of the candidate rule.
_NUMBERS = re.compile(r"(?<![\w.@/-])[+(]?[0-9][0-9().-]*(?:\x20[(]?[0-9][0-9().-]*)*")
_PIECE = re.compile(r"[^\x20]+")
_AT = re.compile(r"@|\[at\]|\(at\)|\{at\}|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)", re.IGNORECASE)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\x20?\Z")
_RIGHT = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
#: Words that announce a kind.
_CUES = {
    "email": frozenset({"email", "e-mail", "mail", "mailto", "contact"}),
    "ip": frozenset({"ip", "host", "server"}),
    "card": frozenset({"card", "visa", "mastercard", "credit"}),
    "phone": frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "cell"}),
}
_GROUPED = re.compile(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_PLAIN_PHONE = re.compile(r"\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
_TOLL = re.compile(r"00[0-9]{1,3}[\x20-][0-9][0-9\x20-]{5,14}")
FEATURES = (
    "one", "pieces", "at", "spelled_at", "four_parts", "luhn", "grouped_by_four", "plus", "plain_phone", "dialled_abroad", "digits", "unlike_length",
    "cue_email", "cue_ip", "cue_card", "cue_phone", "open_end",
)


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of a whole segment and of the word before it."""
    s = text[start:end]
    d = _digits(s)
    parts = s.split(".")
    ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    address = bool(_AT.search(s))
    before = text[max(0, start - 24) : start].rstrip("\x20:=#\"'").rsplit(None, 1)
    cue = before[-1].lower() if before else ""
    shape = (_GROUPED, _PLAIN_PHONE, _TOLL)
    grouped, plain, toll = (float(bool(p.fullmatch(s))) for p in shape)
    after = text[end : end + 1]
    return np.array(
        [
            1.0, s.count(" ") + 1.0, float("@" in s), float(address and "@" not in s), float(ip), float(not address and 13 <= len(d) <= 19 and luhn(d)),
            grouped, float(s[0] == "+" and 8 <= len(d) <= 15), plain, toll, 0.0 if address else min(len(d), 20) / 10, float(not address and not 8 <= len(d) <= 19),
            *(float(cue in _CUES[k]) for k in KINDS), float(after.isalnum() or after in ("%", "/") and bool(after)),
        ]
    )


def clusters(text: str) -> list[list[tuple[int, int]]]:
    """Candidate segments in groups that do not touch each other. All runs of up to ``MAX_PIECES`` pieces are there."""
    found = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(text, m.start(), m.end())]
        own = []
        for i in range(len(pieces)):
            for j in range(i, min(len(pieces), i + MAX_PIECES)):
                end = pieces[j][1]
                while end > pieces[i][0] and text[end - 1] in ".-(":
                    end -= 1
                if end - pieces[i][0] >= 7:
                    own.append((pieces[i][0], end))
        if own:
            found.append(own)
    for m in _AT.finditer(text):
        left, right = _LEFT.search(text, max(0, m.start() - 65), m.start()), _RIGHT.match(text, m.end())
        if left and right:
            found.append([(left.start(), right.end())])
    found.sort()
    out: list[list[tuple[int, int]]] = []
    reach = -1
    for own in found:
        if out and own[0][0] < reach:
            out[-1] += own
        else:
            out.append(list(own))
        reach = max(reach, *(e for _, e in own))
    return [sorted(set(c)) for c in out]


class Lattice:
    """The segments of a cluster over its boundary positions; the gaps between boundaries can only be nothing."""

    def __init__(self, text: str, segments: list[tuple[int, int]]) -> None:
        self.bounds = sorted({p for s in segments for p in s})
        at = {p: k for k, p in enumerate(self.bounds)}
        self.ending: list[list[tuple[int, np.ndarray]]] = [[] for _ in self.bounds]
        for start, end in segments:
            self.ending[at[end]].append((at[start], span_features(text, start, end)))


@dataclass(frozen=True)
class SemiCrf:
    """Weights of span features per type, and of a type following another (nothing, at a cluster's start)."""

    emit: np.ndarray  # labels x features; nothing scores zero
    move: np.ndarray  # labels x labels

    def best(self, lattice: Lattice) -> list[tuple[str, int, int]]:
        """The segmentation of the highest score."""
        n, k = len(lattice.bounds), len(LABELS)
        score, back = np.full((n, k), -np.inf), {}
        score[0, 0] = 0.0
        for j in range(1, n):
            for i, s in self._segments(lattice, j):
                came = score[i][:, None] + self.move + s[None, :]
                for y in range(k):
                    x = int(came[:, y].argmax())
                    if came[x, y] > score[j, y]:
                        score[j, y], back[j, y] = came[x, y], (i, x)
        found, j, y = [], n - 1, int(score[-1].argmax())
        while j:
            i, x = back[j, y]
            if y:
                found.append((LABELS[y], lattice.bounds[i], lattice.bounds[j]))
            j, y = i, x
        return found[::-1]

    def _segments(self, lattice: Lattice, j: int) -> Iterator[tuple[int, np.ndarray]]:
        none = np.full(len(LABELS), -np.inf)
        none[0] = 0.0
        yield j - 1, none
        for i, f in lattice.ending[j]:
            s = self.emit @ f
            s[0] = -np.inf
            yield i, s

    def expected(self, lattice: Lattice) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partition function, and expected counts of features and moves, by forward and backward sums."""
        n, k = len(lattice.bounds), len(LABELS)
        ahead, behind = np.full((n, k), -np.inf), np.full((n, k), -np.inf)
        ahead[0, 0], behind[-1] = 0.0, 0.0
        steps = [list(self._segments(lattice, j)) if j else [] for j in range(n)]
        for j in range(1, n):
            for i, s in steps[j]:
                ahead[j] = np.logaddexp(ahead[j], _log_sum(ahead[i][:, None] + self.move, 0) + s)
        for j in range(n - 1, 0, -1):
            for i, s in steps[j]:
                behind[i] = np.logaddexp(behind[i], _log_sum(self.move + (s + behind[j])[None, :], 1))
        total = float(_log_sum(ahead[-1], 0))
        emit, move = np.zeros_like(self.emit), np.zeros_like(self.move)
        for j in range(1, n):
            features = [None, *(f for _, f in lattice.ending[j])]
            for (i, s), f in zip(steps[j], features, strict=True):
                p = np.exp(ahead[i][:, None] + self.move + (s + behind[j])[None, :] - total)
                move += p
                if f is not None:
                    emit += np.outer(p.sum(axis=0), f)
        return total, emit, move

    def counts(self, lattice: Lattice, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature and move counts of a labelled segmentation."""
        emit, move = np.zeros_like(self.emit), np.zeros_like(self.move)
        at, y = 0, 0
        for kind, start, end in spans:
            i, j = lattice.bounds.index(start), lattice.bounds.index(end)
            for _ in range(at, i):
                move[y, 0] += 1
                y = 0
            c = LABELS.index(kind)
            move[y, c] += 1
            emit[c] += next(f for x, f in lattice.ending[j] if x == i)
            at, y = j, c
        for _ in range(at, len(lattice.bounds) - 1):
            move[y, 0] += 1
            y = 0
        return emit, move


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def labelled_examples(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` made-up sentences with personal data, look-alikes and plain numbers, and the spans to find."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(2, 9))))

    def card(gap: str) -> str:
        d = "4" + number(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return gap.join(d[k : k + 4] for k in range(0, 16, 4))

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = pick([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")])
            return f"{word()}{at}{word()}{dot}{pick(['com', 'org', 'net'])}"
        if kind == "ip":
            return ".".join(str(int(x)) for x in rng.integers(1, 256, 4))
        if kind == "card":
            return card(pick(["", " ", "-"]))
        area, mid, end = str(int(rng.integers(200, 999))), number(3), number(4)
        return pick([f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+{number(2)} {number(3)} {number(6)}", f"0049 {number(3)} {number(7)}"])

    def plain() -> str:
        return pick(
            [number(int(rng.integers(7, 13))), f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(1)}.{number(2)}.{number(4)}", f"{number(3)}.{number(5)}", number(22), f"{number(4)} {number(4)}", f"{number(2)}.{number(2)}.{number(4)}", f"{number(5)}-{number(5)}", f"{number(3)} {number(3)} {number(3)}"]
        )

    cues = {k: sorted(v) for k, v in _CUES.items()}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() for _ in range(int(rng.integers(0, 4)))) + " " if rng.random() < 0.8 else ""
            if rng.random() < 0.6:
                kind = pick(KINDS)
                text += pick(cues[kind]) + pick([": ", " "]) if rng.random() < 0.25 else ""
                e = entity(kind)
                spans.append((kind, len(text), len(text) + len(e)))
                text += e + " "
            else:
                text += plain() + " " + word() + " "
        out.append((text, spans))
    return out


def train(n: int = 300, rounds: int = 40, penalty: float = 0.02) -> SemiCrf:
    """Fit by gradient ascent with per-weight steps on ``n`` made-up sentences; takes seconds and no input table."""
    k, d = len(LABELS), len(FEATURES)
    data = []
    blank = SemiCrf(np.zeros((k, d)), np.zeros((k, k)))
    for text, spans in labelled_examples(n):
        for c in clusters(text):
            inside = [s for s in spans if c[0][0] <= s[1] and s[2] <= max(e for _, e in c)]
            if all((a, b) in set(c) for _, a, b in inside):
                lattice = Lattice(text, c)
                data.append((lattice, *blank.counts(lattice, inside)))
    emit, move = np.zeros((k, d)), np.zeros((k, k))
    seen = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    for _ in range(rounds):
        model = SemiCrf(emit, move)
        grow = [-penalty * emit * len(data) / 100, -penalty * move * len(data) / 100]
        for lattice, e, m in data:
            _, pe, pm = model.expected(lattice)
            grow[0] += e - pe
            grow[1] += m - pm
        for w, g, s in zip((emit, move), grow, seen, strict=True):
            s += g * g
            w += 1.0 * g / np.sqrt(s)
    emit[0] = 0.0
    return SemiCrf(emit, move)


def all_spans(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with the random field's further ones, both by kind and start."""
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    more = []
    taken = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    # how far the base spans reach that start before a place
    reach = lambda place: furthest[n - 1] if (n := bisect_left(starts, place)) else 0
    for c in clusters(text):
        low, high = c[0][0], max(e for _, e in c)
        if reach(low + 1) < high:
            more += [s for s in model.best(Lattice(text, c)) if reach(s[2]) <= s[1]]
    return base, sorted(base + more, key=lambda s: (rank[s[0]], s[1], s[2]))


def find_spans(df: DataFrame, text: str = "text", model: SemiCrf | None = None, base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``df`` with two arrays of (kind, start, end), in code points, end exclusive, ordered by kind and start.

    ``base`` has the matches of the fixed patterns in each whole text, ``spans`` these and the random field's. Null and
    empty texts have none. Both names must be free. Rows are independent of each other, so skew does not matter.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model or train())
    kind = "array<struct<kind:string,start:int,end:int>>"
    extra = T.StructType.fromDDL(f"`{base}` {kind}, `{spans}` {kind}")
    schema = T.StructType([*df.schema.fields, *extra.fields])
    spec = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        shown = lambda some: [{"kind": k, "start": a, "end": z} for k, a, z in some]
        for b in batches:
            first, second = [], []
            for t in b.column(b.schema.names.index(text)):
                own, every = all_spans(t.as_py() or "", crf)
                first.append(shown(own))
                second.append(shown(every))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, spec), pa.array(second, spec)], names=schema.names)

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """``df`` with every span found in the text replaced by its kind in brackets; other columns unchanged."""
    base, spans = free_name(df, "base_spans"), free_name(df, "pii_spans")
    found = find_spans(df, text, model, base, spans)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(state, s):
        fresh = s["start"] >= state["at"]
        kept = F.substring(F.col(text), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.concat(state["out"], kept, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, out).otherwise(state["out"]).alias("out"), F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"))

    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, start, add)
    clean = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(*df.columns)
