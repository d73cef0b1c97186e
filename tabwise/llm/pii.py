"""Personal data in whole texts: four fixed kinds by pattern, further kinds by a linear-chain conditional random field.

The field labels every token of a text (letters, digits, single marks, line ends) with O or a kind. A token is seen
through its class only: its word shape (lower, capitalised, capitals, number of digits, the mark itself) and, for cue
words that the labelled table repeats, the word. Scores are sums of weights of the classes at -3..3 around a token,
plus one weight per pair of neighbouring labels. The field is fitted on the driver from the small labelled table
(``pii_examples``, or the caller's), which is the bound on what it learns from; texts are decoded in tasks.

Decoding is Viterbi over the whole text, in numpy batches. A token at which O leads every other label by more than any
two transitions can make up is O on the best path whatever its neighbours are, so the chain falls apart there without
changing the answer; the stretches in between are decoded together, stretches of one length at a time.

What the field finds is kept where no fixed span overlaps it and it has the digits its kind needs.

Defined results: null text is empty and has no spans; of spans with one start the kinds come in their listed order;
repeated rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tabwise.llm.common import add_columns
from tabwise.llm.pii_examples import LABELLED

BASE = ("email", "ip", "card", "phone")
#: Least and most digits a span of the field must hold.
DIGITS = {"name": (0, 0), "address": (1, 12), "birth": (5, 8), "id": (5, 12), "account": (8, 30), "localphone": (7, 12), "mail": (0, 8)}
KINDS = (*BASE, *DIGITS)
_LABELS = ("O", *DIGITS)
_TAG = {"phone": "localphone"}
MOST_WORDS = 12  # a longer run is prose, not an entity; nor is a name that says a word twice
REACH = 3
CACHE_WORDS = 500_000
AT_ONCE = 100_000  # tokens scored, characters split at a time

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\n|[^\w\s]|\w")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a failed start inside a run of digits fails at all its digits, so a run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_SPELT = re.compile(r"(?i)\b(at|@)\b.{1,60}?\bdot\b")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the fixed kinds, in time linear in the text."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at - (len(text[free:at]) - len(text[free:at].rstrip(_LOCAL)))
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            out.append((start, domain.end(), "email"))
        free = domain.end() if start < at and domain else at + 1
        at = text.find("@", free)
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def shape(word: str) -> str:
    first = word[0]
    if "0" <= first <= "9":
        n = len(word)
        return f"d{n}" if n <= 11 else "d12" if n < 20 else "d20"
    if not first.isalpha():
        return first if first.isascii() or first == "\n" else "mark"
    if len(word) == 1:
        return "I" if first.isupper() else "i"
    return "X" if word.isupper() else "x" if word.islower() else "Xx" if first.isupper() and word[1:].islower() else "xX"


def parse(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of a labelled row and its (start, stop, kind)."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(name|address|birth|id|account|phone|mail):((?:[^\[\]]|\[\w+\])+)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), _TAG.get(m[1], m[1])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def with_filler(labelled: list[str], seed: int = 7) -> list[str]:
    """Labelled rows as they are, and again amid made-up prose; as many rows of such prose alone. In rows a backslash and n is a line end."""
    rng = random.Random(seed)
    parts = ["an", "the", "re", "on", "es", "ti", "or", "ó", "ción", "ñe", "que", "ll", "ge", "sch", "ü", "be", "ß", "keit", "é", "oi", "eau", "tre"]

    common = "the of and in is at for a to by und der die das in den y de la el que en los se et le les des un und".split()

    def word():
        draw = rng.random()
        if draw < 0.4:
            return rng.choice(common)
        if draw < 0.43:
            return str(rng.randrange(10 ** rng.randint(1, 6)))
        if draw < 0.45:
            return f"[account:{rng.randrange(10**15, 10**16)}]"
        if draw < 0.46:
            return f'token = "{rng.getrandbits(160):040x}"'
        return "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def prose():
        mark = rng.choice(["", "", "", "", rng.choice(["%%%", "&&&", "!!", " |", "***", "###", "$$$"])])
        words = [word() + rng.choice(["", "", "", "", ",", ".", ".", ".\n", "\n", mark]) for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.15:
            words = [words[0]] * len(words)
        words = [w.capitalize() if i == 0 or words[i - 1][-1] in ".\n" or rng.random() < 0.08 else w for i, w in enumerate(words)]
        text = " ".join(w if w.endswith("\n") else w + mark for w in words)
        return text.upper() if rng.random() < 0.08 else text

    rows = [line.replace("\\n", "\n") for line in labelled]
    marked = [r for r in rows if "[" in r]
    return rows + [f"{prose()} {r} {prose()}" for r in rows + marked] + [prose() + rng.choice([" ", "\n"]) + prose() for _ in range(len(rows))]


class Field:
    """Cue words, weights (position, feature, label) and transitions of a fitted field."""

    def __init__(self, cues: list[str], features: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.cues, self.features, self.weights, self.moves = frozenset(cues), features, weights, moves

    def of_word(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        named = (f"shape {shape(word)}", f"word {low}" if low in self.cues else "")
        return tuple(self.features[f] for f in named if f in self.features)


class Classes:
    """Numbers of the classes that words fall into; 0 stands between texts, where the label is O."""

    def __init__(self, field: Field):
        self.field, self.known, self.words = field, {(): 1}, {}
        self.rows: list[tuple] = [(), ()]

    def numbers(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        except KeyError:
            pass
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        for w in words:
            if w not in self.words:
                key = self.field.of_word(w)
                if key not in self.known:
                    self.known[key] = len(self.rows)
                    self.rows.append(key)
                self.words[w] = self.known[key]
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def matrix(self) -> np.ndarray:
        """(class, feature) incidence."""
        out = np.zeros((len(self.rows), len(self.field.features)))
        for c, row in enumerate(self.rows):
            out[c, list(row)] = 1
        return out

    def tables(self) -> np.ndarray:
        """(position, class, label) scores."""
        return np.einsum("cf,ofl->ocl", self.matrix(), self.field.weights)


def emissions(tables: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(token, label) scores of a chain that begins and ends with at least ``REACH`` zeros; a zero is O."""
    n = len(classes)
    out = np.zeros((n, tables.shape[2]))
    for o in range(-REACH, REACH + 1):
        lo, hi = max(0, -o), min(n, n - o)
        out[lo:hi] += tables[o + REACH].take(classes[lo + o : hi + o], axis=0)
    out[classes == 0] = [0.0] + [-1e6] * (out.shape[1] - 1)
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of stretches (stretch, token, label) between two tokens labelled O."""
    best, back = scores[:, 0] + moves[0], []
    for t in range(1, scores.shape[1]):
        ways = best[:, :, None] + moves[None]
        back.append(ways.argmax(1))
        best = ways.max(1) + scores[:, t]
    out = np.empty(scores.shape[:2], np.int64)
    out[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(len(back) - 1, -1, -1):
        out[:, t] = np.take_along_axis(back[t], out[:, t + 1 : t + 2], 1)[:, 0]
    return out


def certain(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Where O is on every best path. A stretch of other labels changes the score of all-O by at most the sum of its
    tokens' ``gain`` plus ``ends``; a token that no stretch with a sum of 0 or more covers is O."""
    inside = moves[1:, 1:].max() - moves[0, 0]
    ends = moves[0, 1:].max() + moves[1:, 0].max() - 2 * moves[0, 0] - inside
    gain = np.maximum(scores[:, 1:].max(1) - scores[:, 0] + inside, -1e4)
    run = np.concatenate([[0.0], np.cumsum(gain)])
    left = run[1:] - np.minimum.accumulate(run[:-1])  # best stretch that ends at a token
    right = np.maximum.accumulate(run[:0:-1])[::-1] - run[:-1]  # best stretch that begins there
    return left + right - gain + ends < -1e-3


def decode(tables: np.ndarray, classes: np.ndarray, moves: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """Best labels of a chain of classes that begins and ends with ``REACH`` zeros, some ``at_once`` tokens at a time."""
    n, labels = len(classes), np.zeros(len(classes), np.int8)
    lo, size = 0, at_once
    while lo < n:
        hi = min(lo + size, n)
        first, last = max(0, lo - REACH), min(n, hi + REACH)
        scores = emissions(tables, classes[first:last])[lo - first : hi - first]
        if hi < n:  # up to the last token that is O whatever comes after it; that one begins the next part
            single = scores[:, 0] - scores[:, 1:].max(1) > 2 * (moves.max() - moves.min())
            cuts = np.flatnonzero(single)
            if not len(cuts) or cuts[-1] == 0:
                size *= 2
                continue
            hi = lo + int(cuts[-1])
            scores = scores[: hi - lo]
        labels[lo:hi] = _stretches(scores, certain(scores, moves), moves)
        lo, size = hi, at_once
    return labels


def _stretches(scores: np.ndarray, sure: np.ndarray, moves: np.ndarray) -> np.ndarray:
    labels = np.zeros(len(scores), np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[1], sure, [1]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    sizes = stops - starts
    for size in np.unique(sizes).tolist():
        at = starts[sizes == size]
        for lo in range(0, len(at), step := max(1, AT_ONCE // size)):
            tokens = at[lo : lo + step, None] + np.arange(size)
            labels[tokens] = viterbi(scores[tokens], moves)
    return labels


def fit(labelled: list[str] = LABELLED, rounds: int = 100, pull: float = 0.02) -> Field:
    """A field fitted to labelled rows by full-batch ascent of the penalised log-likelihood (Adam steps)."""
    counts = Counter()
    for text, spans in map(parse, labelled):
        counts.update(m.group().lower() for m in TOKEN.finditer(text) if m.group().isalpha() and not any(a <= m.start() < b and k == "name" for a, b, k in spans))
    rows = [parse(line) for line in with_filler(labelled)]
    tokens = [[(m.group(), m.start()) for m in TOKEN.finditer(text)] for text, _ in rows]
    cues = sorted(w for w, n in counts.items() if n >= 2)
    names = sorted({f"shape {shape(w)}" for own in tokens for w, _ in own} | {f"word {c}" for c in cues})
    features = {f: i for i, f in enumerate(names)}
    field = Field(cues, features, np.zeros((2 * REACH + 1, len(features), len(_LABELS))), np.zeros((len(_LABELS),) * 2))
    classes = Classes(field)
    width = max(map(len, tokens)) + 2 * REACH
    c = np.zeros((len(rows), width), np.int32)
    y = np.zeros((len(rows), width), np.int64)
    for i, ((_, spans), own) in enumerate(zip(rows, tokens)):
        c[i, REACH : REACH + len(own)] = classes.numbers([w for w, _ in own])
        for j, (_, at) in enumerate(own):
            y[i, REACH + j] = next((_LABELS.index(k) for a, b, k in spans if a <= at < b), 0)
    f = classes.matrix()
    flat, gold = c.ravel(), np.eye(len(_LABELS))[y]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (field.weights, field.moves)]
    for k in range(1, rounds + 1):
        e = emissions(classes.tables(), flat).reshape(*c.shape, -1)
        marginals, moves = _expectations(e, field.moves)
        gap = (gold - marginals).reshape(len(flat), -1)
        grad = np.zeros_like(field.weights)
        for o in range(-REACH, REACH + 1):
            lo, hi = max(0, -o), min(len(flat), len(flat) - o)
            by_class = [np.bincount(flat[lo + o : hi + o], gap[lo:hi, y], len(f)) for y in range(gap.shape[1])]
            grad[o + REACH] = f.T @ np.stack(by_class, 1)
        for p, g, (m, v) in zip((field.weights, field.moves), (grad - pull * field.weights, gold_moves - moves - pull * field.moves), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return field


def _expectations(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (row, token, label) and expected transitions of chains with scores ``e``, by scaled sums of products."""
    p, go = np.exp(e - e.max(2, keepdims=True)), np.exp(moves)
    ahead, behind = np.zeros_like(p), np.ones_like(p)
    for t in range(p.shape[1]):
        now = p[:, 0] if t == 0 else (ahead[:, t - 1] @ go) * p[:, t]
        ahead[:, t] = now / now.sum(1, keepdims=True)
    for t in range(p.shape[1] - 2, -1, -1):
        now = (behind[:, t + 1] * p[:, t + 1]) @ go.T
        behind[:, t] = now / now.sum(1, keepdims=True)
    both = ahead * behind
    both /= both.sum(2, keepdims=True)
    after = behind[:, 1:] * p[:, 1:]
    total = np.einsum("nta,ntb,ab->nt", ahead[:, :-1], after, go, optimize=True)
    return both, go * np.einsum("nta,ntb->ab", ahead[:, :-1] / total[..., None], after, optimize=True)


def pieces(text: str, size: int = 10 * AT_ONCE):
    """The text in parts that end at blanks, where no token is cut."""
    lo = 0
    while len(text) - lo > size:
        cut = text.find(" ", lo + size)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


class Finder:
    """Spans of texts; shown some texts at a time, it decodes their chains together."""

    def __init__(self, field: Field):
        self.field, self.classes, self.ready, self.tables = field, Classes(field), {}, None

    def prepare(self, texts: list) -> None:
        """Decode many texts as one chain; a text met before among them is decoded once."""
        self.ready = {}
        gap, todo, at = np.zeros(REACH, np.int32), [], REACH
        parts = [gap]
        for raw in texts:
            if raw and raw not in self.ready:
                self.ready[raw] = None
                own = [self.classes.numbers(TOKEN.findall(p)) for p in pieces(raw.decode("utf-8", "replace"))]
                size = sum(map(len, own))
                todo.append((raw, at, size))
                parts += [*own, gap]
                at += size + REACH
        if self.tables is None or self.tables.shape[1] < len(self.classes.rows):
            self.tables = self.classes.tables()
        labels = decode(self.tables, np.concatenate(parts), self.field.moves)
        for raw, at, n in todo:
            own = labels[at : at + n]
            self.ready[raw] = own.copy() if own.any() else None

    def spans(self, raw: bytes | None) -> list[tuple[int, int, str]]:
        """(start, stop, kind) by start and kind: fixed spans and what the field adds."""
        if not raw:
            return []
        if raw not in self.ready:
            self.prepare([raw])
        text, labels = raw.decode("utf-8", "replace"), self.ready[raw]
        found = base_spans(text)
        if labels is not None:
            found += added_spans(text, labels, found)
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of one label as spans, without marks at their ends, where no fixed span lies and the digits are right."""
    spans, taken = [], sorted(base)
    edges = np.flatnonzero(np.diff(labels, prepend=0, append=0)).tolist()
    runs = {a: (b, _LABELS[labels[a]]) for a, b in zip(edges, [*edges[1:], len(labels)]) if a < len(labels) and labels[a]}
    start = stop = end = None
    kind, place = "", 0
    for i, m in enumerate(TOKEN.finditer(text)):
        if i in runs:
            end, kind = runs[i]
            start, stop = None, None
        if end is not None and i < end:
            if m.group()[0].isalnum() or m.group() in "(" and start is None and kind == "localphone":
                start = m.start() if start is None else start
                stop = m.end()
            if i == end - 1 and stop is not None:
                while place < len(taken) and taken[place][1] <= start:
                    place += 1
                clear = all(b <= start or a >= stop for a, b, _ in taken[max(0, place - 8) : place + 8])
                digits = sum("0" <= c <= "9" for c in text[start:stop])
                low, high = DIGITS[kind]
                whole = not text[start - 1 : start].isalnum() and not text[stop : stop + 1].isalnum()
                words = text[start:stop].split()
                plain = len(words) <= MOST_WORDS and (kind != "mail" or _SPELT.search(text, start, stop)) and (kind != "name" or len(words) == len(set(words)))
                if clear and whole and plain and low <= digits <= high:
                    spans.append((start, stop, kind))
    return spans


def find(docs: DataFrame, field: Field | None = None, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """``docs`` with __spans: (start, stop, kind) of each text."""
    told = docs.sparkSession.sparkContext.broadcast(field or fit())

    def make():
        finder = Finder(told.value)

        def one(raw):
            return ([{"start": a, "stop": b, "kind": k} for a, b, k in finder.spans(raw)],)

        one.prepare = finder.prepare
        return one

    return add_columns(docs, text_col, make, "__spans array<struct<start:int,stop:int,kind:string>>", drop_source=drop_text)


def report(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the fixed kinds, base_sha256, spans)."""
    told = docs.sparkSession.sparkContext.broadcast(field or fit())

    def make():
        finder = Finder(told.value)

        def one(raw):
            found = finder.spans(raw)
            line = [f"{k}:{a}:{b}" for a, b, k in found]
            base = ",".join(x for x, (_, _, k) in zip(line, found) if k in BASE)
            return (*[sum(k == kind for _, _, k in found) for kind in BASE], hashlib.sha256(base.encode()).hexdigest(), ",".join(line))

        one.prepare = finder.prepare
        return one

    ddl = ", ".join([f"n_{k} bigint" for k in BASE] + ["base_sha256 string", "spans string"])
    return add_columns(docs.select(id_col, text_col), text_col, make, ddl)
