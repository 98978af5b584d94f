"""Personal data: patterns, and a semi-Markov conditional random field for what they miss.

Patterns find the base spans. The field segments the zones of a text that may hold more: runs of digits
and what stands between digits, and what surrounds an at sign. Features of a whole span (its digits,
separators, neighbours) score it as an email, address, card or phone number, and dynamic programming
over segments of bounded length chooses boundaries and types together. It is trained here: base spans
are the truth of a zone; zones in which a pattern matched but a check failed that shapes do not show (a
card's sum, an address' parts) say nothing and are left out. The patterns' own forms would teach only
themselves, so a zone stands beside altered copies: phone numbers without their plus sign and with other
separators, cards with other separators. A span that the field finds has to pass its kind's check (digits,
sum, parts), as a base span has to.

All scans take time in proportion to a text's length: they start at digits and at signs, never back up
over what they have read, and segments have a bounded number of atoms.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable

KINDS = ("email", "ip", "card", "phone")
# Base patterns as runs that never back up: an email's ends are looked for from its at sign; a chain of
# dotted numbers gives an address for each four of them.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Bounds of the sample that the field is trained on: documents, distinct shapes of their zones, and a zone's characters.
SAMPLE, SHAPES, ZONE_CHARS = 4_000, 800, 200
#: Separators that altered copies have instead of their own.
SEPARATORS = " -."
#: Atoms (runs of letters or of digits, other characters) of the longest entity.
MAX_ATOMS, ROUNDS = 24, 60
NUMBERS = re.compile(r"[+(0-9][0-9 ().+-]*+")
ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
#: Letters and digits by kind, so that a span's shape has its length.
SAME_LENGTH = {**{ord(c): "9" for c in "0123456789"}, **{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    digits = re.sub("[^0-9]", "", s) if kind in ("card", "phone") else ""
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    if "." in text:
        for m in DOTTED.finditer(text):
            at = m.start()
            parts = m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                yield at, end
                at = end + 1


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Matches that pass their check, and those that do not, as (start, end, kind) in order."""
    found = {
        "email": _emails(text), "ip": _addresses(text), "card": (m.span() for m in CARD.finditer(text)),
        "phone": (m.span() for m in PHONE.finditer(text)) if "+" in text else (),
    }
    good, bad = [], []
    for kind in KINDS:
        for start, end in found[kind]:
            (good if _passes(kind, text[start:end]) else bad).append((start, end, kind))
    order = lambda x: (x[0], KINDS.index(x[2]))
    return sorted(good, key=order), sorted(bad, key=order)


def _features(s: str, before: str, after: str, kind: str) -> list[str]:
    """Whole-span features of a candidate, or none where the kind cannot be."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        if s.count("@") != 1 or not (s[0].isalnum() and s[-1].isalnum()) or " " in s:
            return []
        rest = s.split("@")[1]
        own = ["dots" if "." in rest else "nodots", "plain" if re.fullmatch(r"[A-Za-z0-9._%+@-]+", s) else "odd"]
    elif not (s[-1].isdigit() and (s[0].isdigit() or s[0] in "+(")):
        return []
    elif kind == "ip":
        parts = s.split(".")
        if not re.fullmatch(r"[0-9.]+", s) or len(parts) != 4 or not all(0 < len(p) <= 3 for p in parts):
            return []
        own = [f"longest{max(map(len, parts))}"]
    elif kind == "card":
        if not re.fullmatch(r"[0-9 .-]+", s) or not 12 <= digits <= 19 or re.search("[ .-]{2}", s):
            return []
        own = [f"digits{digits}", f"gaps{min(len(re.findall('[ .-]', s)), 4)}"]
    else:
        if not re.fullmatch(r"[0-9 ().+-]+", s) or "+" in s[1:] or not 9 <= digits <= 15 or s.count("(") != s.count(")"):
            return []
        own = [f"digits{digits}", "plus" if s[0] == "+" else "noplus", f"groups{min(len(re.findall('[0-9]+', s)), 6)}", "round" if "(" in s else "open"]
    near = [f"left{_class(before)}", f"right{_class(after)}"]
    return [f"{kind}:{f}" for f in ("any", *own, *near)]


def _class(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _outside(atom: str) -> list[str]:
    return [f"O:{'digits' if atom[0].isdigit() else 'letters' if atom[0].isalpha() else atom[0]}", f"O:size{min(len(atom), 20) if atom[0].isdigit() else 0}"]


def _lattice(zone: str, left: str, right: str, max_atoms: int = MAX_ATOMS) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Ends of atoms, and candidate segments (first atom, last atom + 1, kind, features); O takes one atom."""
    cuts = [0, *(m.end() for m in ATOM.finditer(zone))]
    segments = []
    for i in range(len(cuts) - 1):
        atom = zone[cuts[i] : cuts[i + 1]]
        segments.append((i, i + 1, "O", _outside(atom)))
        if not (atom[0].isalnum() or atom[0] in "+("):
            continue
        for j in range(i + 1, min(i + max_atoms, len(cuts) - 1) + 1):
            s = zone[cuts[i] : cuts[j]]
            if not s[-1].isalnum():
                continue
            before, after = zone[cuts[i] - 1] if cuts[i] else left, zone[cuts[j]] if cuts[j] < len(zone) else right
            for kind in KINDS:
                if f := _features(s, before, after, kind):
                    segments.append((i, j, kind, f))
    return cuts, segments


def zones(text: str, max_atoms: int = MAX_ATOMS) -> Iterator[tuple[int, str, str, str]]:
    """(start, zone, character before, character after), in order and apart.

    A zone is a run of digits, blanks and +-.() with four digits at least, or up to max_atoms atoms on
    either side of an at sign, without blanks or other at signs; what overlaps is one zone.
    """
    seeds = [(m.start(), m.start() + len(m[0].rstrip(" ().+-"))) for m in NUMBERS.finditer(text) if len(m[0]) > 3 and sum(map(m[0].count, "0123456789")) >= 4]
    at = text.find("@")
    while at >= 0:
        start = end = at
        kind, n = "", 0
        while start and not text[start - 1].isspace() and text[start - 1] != "@":
            c = text[start - 1]
            now = "d" if c.isdigit() else "l" if c.isascii() and c.isalpha() else ""
            n += now == "" or now != kind
            if n > max_atoms:
                break
            kind, start = now, start - 1
        kind, n, end = "", 0, at + 1
        while end < len(text) and not text[end].isspace() and text[end] != "@":
            now = "d" if text[end].isdigit() else "l" if text[end].isascii() and text[end].isalpha() else ""
            n += now == "" or now != kind
            if n > max_atoms:
                break
            kind, end = now, end + 1
        seeds.append((start, end))
        at = text.find("@", at + 1)
    last: tuple[int, int] | None = None
    for start, end in [*sorted(seeds), (len(text) + 1, len(text) + 1)]:
        if last and start > last[1]:
            yield last[0], text[last[0] : last[1]], text[max(0, last[0] - 1) : last[0]], text[last[1] : last[1] + 1]
            last = None
        last = (last[0], max(last[1], end)) if last else (start, end)


def _shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub("[0-9]", "9", s)))


def altered(zone: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Copies of a zone whose phone numbers and cards are written in other ways, with their spans.

    A number in one piece has no other way: without its plus sign any number would be a phone.
    """
    for plus in (True, False):
        for sep in SEPARATORS:
            text, found, last = "", [], 0
            for s, e, kind in spans:
                own = zone[s:e]
                if kind in ("phone", "card") and len(re.findall("[0-9]+", own)) > 2:
                    own = re.sub(r"(?<=[0-9])[ .-](?=[0-9])", sep, own if plus else own.lstrip("+"))
                text += zone[last:s]
                found.append((len(text), len(text) + len(own), kind))
                text += own
                last = e
            text += zone[last:]
            if text != zone:
                yield text, found


def examples(text: str, max_atoms: int = MAX_ATOMS, zone_chars: int = ZONE_CHARS) -> Iterator[tuple[str, str]]:
    """Zones of a text as shapes, with their true spans, and their altered copies; those in which a check failed or that are longer than zone_chars are left out."""
    good, bad = base_spans(text)
    for at, zone, left, right in zones(text, max_atoms):
        end = at + len(zone)
        inside = [x for x in good if x[0] >= at and x[1] <= end]
        overlap = any(a[1] > b[0] for a, b in zip(inside, inside[1:], strict=False))
        open_ = [x for x in bad if x[2] == "ip" or x[2] == "card" and sum(c.isdigit() for c in text[x[0] : x[1]]) >= 12]
        if len(zone) > zone_chars or overlap or any(x[0] < end and x[1] > at and not any(x[0] >= g[0] and x[1] <= g[1] for g in inside) for x in open_):
            continue
        own = [(s - at, e - at, k) for s, e, k in inside]
        for copy, spans in [(zone, own), *altered(zone, own)]:
            # letters shrink to one, so positions move: mark the spans first
            marked, last = "", 0
            for s, e, kind in spans:
                marked += _shape(copy[last:s]) + f"\x01{kind}\x02" + _shape(copy[s:e]) + "\x03"
                last = e
            yield marked + _shape(copy[last:]), _shape(left) + "\x04" + _shape(right)


def _unmark(marked: str) -> tuple[str, set[tuple[int, int, str]]]:
    zone, spans = "", set()
    for i, part in enumerate(re.split(r"\x01([a-z]+)\x02([^\x03]*)\x03", marked)):
        if i % 3 == 1:
            kind = part
        elif i % 3 == 2:
            spans.add((len(zone), len(zone) + len(part), kind))
            zone += part
        else:
            zone += part
    return zone, spans


class Field:
    """Weights of span features; best() decodes a zone. A feature without a weight counts -1."""

    def __init__(self, weights: dict[str, float], max_atoms: int = MAX_ATOMS):
        self.weights, self.max_atoms = weights, max_atoms
        self.memo: dict[tuple, list[tuple[str, float]]] = {}

    def _sum(self, features: list[str]) -> float:
        return sum(self.weights.get(f, -1.0) for f in features)

    def _kinds(self, shape: str, before: str, after: str) -> list[tuple[str, float]]:
        """The kinds that a span of a shape may be, with their scores."""
        key = (shape, before, after)
        found = self.memo.get(key)
        if found is None:
            found = [(k, self._sum(f)) for k in KINDS if (f := _features(shape, before, after, k))]
            if len(shape) <= 64:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[key] = found
        return found

    def best(self, zone: str, left: str, right: str) -> list[tuple[int, int, str]]:
        cuts = [0, *(m.end() for m in ATOM.finditer(zone))]
        shape, n = zone.translate(SAME_LENGTH), len(cuts) - 1
        score, back = [0.0] + [-math.inf] * n, [(0, "O")] * (n + 1)
        for i in range(n):
            s = score[i] + self._sum(_outside(zone[cuts[i] : cuts[i + 1]]))
            if s > score[i + 1]:
                score[i + 1], back[i + 1] = s, (i, "O")
            if not (zone[cuts[i]].isalnum() or zone[cuts[i]] in "+("):
                continue
            before = shape[cuts[i] - 1] if i else left
            for j in range(i + 1, min(i + self.max_atoms, n) + 1):
                end = cuts[j]
                if shape[end - 1].isalnum():
                    for kind, v in self._kinds(shape[cuts[i] : end], before, shape[end] if end < len(zone) else right):
                        if score[i] + v > score[j]:
                            score[j], back[j] = score[i] + v, (i, kind)
        spans, j = [], n
        while j:
            i, kind = back[j]
            if kind != "O":
                spans.append((cuts[i], cuts[j], kind))
            j = i
        return spans[::-1]


def train(counted: list[tuple[str, str, int]], rate: float = 0.5, ridge: float = 0.01, max_atoms: int = MAX_ATOMS) -> Field:
    """Maximises the conditional likelihood of the true segmentations by gradient steps.

    counted: marked zones, their neighbours, how often.
    """
    index: dict[str, int] = {}
    data = []
    for marked, sides, n in counted:
        zone, spans = _unmark(marked)
        left, _, right = sides.partition("\x04")
        cuts, segments = _lattice(zone, left, right, max_atoms)
        place = {c: i for i, c in enumerate(cuts)}
        if not all(a in place and b in place for a, b, _ in spans):
            continue
        true = {(place[a], place[b], k) for a, b, k in spans}
        inside = {i for a, b, _ in true for i in range(a, b)}
        ids = [np.array([index.setdefault(f, len(index)) for f in s[3]]) for s in segments]
        gold = [(s[0], s[1], s[2]) in true or (s[2] == "O" and s[0] not in inside) for s in segments]
        if all(any(s[:3] == t for s in segments) for t in true):
            data.append((len(cuts) - 1, [(s[0], s[1]) for s in segments], ids, gold, math.log1p(n)))
    w, speed = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(ROUNDS):
        grad = -ridge * w
        for n, places, ids, gold, weight in data:
            s = [float(w[f].sum()) for f in ids]
            ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            ahead[0] = behind[n] = 0.0
            for (i, j), v in zip(places, s, strict=True):
                ahead[j] = float(np.logaddexp(ahead[j], ahead[i] + v))
            for (i, j), v in zip(reversed(places), reversed(s), strict=True):
                behind[i] = float(np.logaddexp(behind[i], behind[j] + v))
            for (i, j), v, f, g in zip(places, s, ids, gold, strict=True):
                grad[f] += weight * (g - math.exp(ahead[i] + v + behind[j] - ahead[n]))
        speed += grad**2
        w += rate * grad / np.sqrt(speed)
    return Field({f: float(w[i]) for f, i in index.items()}, max_atoms)


def _sampled(max_atoms: int, zone_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for b in batches:
        for t in b["text"].to_pylist():
            c.update(examples(t, max_atoms, zone_chars))
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(c.values(), pa.int64())], ["zone", "sides", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE, shapes: int = SHAPES, max_atoms: int = MAX_ATOMS, zone_chars: int = ZONE_CHARS) -> Field:
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids: small enough to broadcast at any scale
    seen = docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(partial(_sampled, max_atoms, zone_chars), "zone string, sides string, n long")
    seen = seen.groupBy("zone", "sides").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "zone", "sides").limit(shapes)
    return train([tuple(r) for r in seen.collect()], max_atoms=max_atoms)


def apart(more: list[tuple[int, int, str]], good: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of more that overlap none of good; both in order of start, more without overlaps."""
    out, near, at = [], 0, 0  # near: the furthest end of those that start before this one ends
    for s, e, k in more:
        while at < len(good) and good[at][0] < e:
            near, at = max(near, good[at][1]), at + 1
        if near <= s:
            out.append((s, e, k))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, shapes: int = SHAPES, max_atoms: int = MAX_ATOMS, zone_chars: int = ZONE_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    spans: base spans and those of the field that overlap none, as kind:start:end in code points, by
    start and then kind, joined by commas; base_sha256 is of the base ones alone. The field learns
    from at most `sample` documents (all rows of so many ids) and their `shapes` most frequent shapes
    of zones of up to `zone_chars` characters, ties by shape; it adds no entity of more than max_atoms
    atoms and none that fails its kind's check. Null text counts as empty
    and has no spans. A text is searched whole, in time in proportion to its length. Repeated rows are
    searched each. With no zones to learn from the field adds what no weight speaks for: nothing. An
    empty table gives an empty result. Other columns of docs are not read, so none clashes.
    """
    d = stable(docs, id_col, text_col)
    field = fit(d, sample, shapes, max_atoms, zone_chars)
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    kinds = [pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
    schema = pa.schema([(x.split()[0], k) for x, k in zip(ddl.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(20_000)(field.best)
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                good, _ = base_spans(t)
                more = []
                for at, zone, left, right in zones(t, max_atoms):
                    spans = known(zone, left, right) if len(zone) <= zone_chars else field.best(zone, left, right)
                    more += [(at + s, at + e, k) for s, e, k in spans if _passes(k, zone[s:e])]
                more = apart(more, good)
                n = Counter(k for _, _, k in good)
                every = sorted([*good, *more], key=lambda x: (x[0], KINDS.index(x[2])))
                out.append((i, *(n[k] for k in KINDS), hashlib.sha256(joined(good).encode()).hexdigest(), joined(every), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], schema=schema)

    return d.mapInArrow(run, ddl)
