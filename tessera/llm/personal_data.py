"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Runs of digits and separators are cut into tokens. Every segment of up to LONGEST tokens that begins and ends like a number is a
candidate; features of the whole segment (digits, check sum, grouping, what stands around it) score it for each kind, and a
dynamic program over segments chooses boundaries and kinds together. Patterns are greedy and fail where two items stand side by
side, as in a card number before an address; the program takes such runs apart. What patterns find stays as it is.

The field is trained on runs of a bounded sample of documents, labelled by the patterns, and on rewritten copies of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, replacing, shared, stored, table

KINDS = ("email", "ip", "card", "phone")
O, EMAIL, IP, CARD, PHONE = range(5)
#: Documents that are searched for runs to learn from, and runs that are learned from, at most.
SAMPLE_DOCUMENTS, SAMPLE_RUNS = 20_000, 300
LONGEST = 16
#: Least digits of a candidate (an address) and the most (a card).
LEAST_DIGITS, MOST_DIGITS = 4, 19

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
RUN = re.compile(r"[0-9+(][0-9+(). -]{5,}+")
TOKEN = re.compile(r"[0-9]+|.", re.S)
WIDE_LOCAL, WIDE_DOMAIN = re.compile(r"[\w.%+-]"), re.compile(r"[\w-]+(?:\.[\w-]+)+")


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _mails(text: str, local, domain: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the characters before it that `local` takes and a domain after it. Linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and local(text[start - 1]):
            start -= 1
        end = domain.match(text, at + 1)
        if start < at and end:
            out.append((start, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, in order: per kind leftmost and non-overlapping; matches that fail their
    check are dropped."""
    out = [(s, EMAIL, e) for s, e in _mails(text, LOCAL.__contains__, DOMAIN)]
    out += [(m.start(), IP, m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    out += [(m.start(), PHONE, m.end()) for m in DIAL.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def _runs(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold numbers, up to their last digit, of seven characters or more."""
    found = ((m.start(), m.start() + len(m[0].rstrip("+(). -"))) for m in RUN.finditer(text))
    return [(s, e) for s, e in found if e - s >= 7]


# --- candidates and their features ---------------------------------------------------------------------------------------
DIGIT, OPEN, CLOSE, PLUS, DOT, DASH, BLANK = range(7)
_KIND = {"(": OPEN, ")": CLOSE, "+": PLUS, ".": DOT, "-": DASH, " ": BLANK}
FEATURES = (
    ["bias", "plus first", "plus inside", "brackets paired", "brackets odd", "sum holds", "sum fails", "four parts of an address", "an address but for a part"]
    + [f"digits {n}" for n in ("4-6", "7-9", "10-11", "12-13", "14-15", "16", "17-19")] + [f"groups {n}" for n in ("1", "2", "3", "4", "5-")]
    + ["dots only", "dashes only", "blanks only", "mixed", "two separators", "fours", "three three four", "glued before", "glued after", "goes on before", "goes on after"]
)
_DIGIT_STEPS, N_FEATURES = np.array([7, 10, 12, 14, 16, 17]), len(FEATURES)


class Tokens:
    """Tokens of many runs as arrays, and all candidate segments with their features."""

    def __init__(self, runs: list[tuple[str, str, str, list[tuple[int, int]]]]):
        """runs: (text, character before, character after, spans that no candidate may touch)."""
        kind, size, value, run, start, taken, even, odd = [], [], [], [], [], [], [], []
        self.count, self.offsets = [], []
        for r, (text, _, _, held) in enumerate(runs):
            spans = [m.span() for m in TOKEN.finditer(text)]
            edges, k = np.zeros(len(text) + 1, np.int64), 0
            np.add.at(edges, [a for a, _ in held], 1)
            np.add.at(edges, [b for _, b in held], -1)
            free = (np.cumsum(edges) == 0).tolist()
            for s, e in spans:
                number = text[s] in "0123456789"
                kind.append(DIGIT if number else _KIND[text[s]])
                size.append(e - s if number else 0)
                value.append(int(text[s:e]) if number and e - s <= 3 else 999)
                run.append(r)
                start.append(s)
                taken.append(not all(free[s:e]))
                a = b = 0
                for c in text[s:e] if number else "":
                    d = ord(c) - 48
                    twice = 2 * d - 9 * (d > 4)
                    a, b = (a + d, b + twice) if k % 2 == 0 else (a + twice, b + d)
                    k += 1
                even.append(a)
                odd.append(b)
            self.count.append(len(spans))
            self.offsets.append([s for s, _ in spans] + [len(text)])
        self.n, self.count = len(runs), np.array(self.count, np.int64)
        self.first = np.r_[0, np.cumsum(self.count)]
        n = len(kind)
        kind, size, value, run = np.array(kind, np.int64), np.array(size, np.int64), np.array(value, np.int64), np.array(run, np.int64)
        sums = lambda x: np.r_[0, np.cumsum(x)]
        digits, groups, busy = sums(size), sums(kind == DIGIT), sums(np.array(taken, bool))
        of = {k: sums(kind == k) for k in (OPEN, CLOSE, PLUS, DOT, DASH, BLANK)}
        pair = sums(np.r_[(kind[1:] != DIGIT) & (kind[:-1] != DIGIT), False] if n else np.zeros(0))
        fours, fit = sums((kind == DIGIT) & (size == 4)), sums((kind == DIGIT) & (value <= 255))
        even, odd = sums(np.array(even, np.int64)), sums(np.array(odd, np.int64))
        s, width = np.repeat(np.arange(n), LONGEST), np.tile(np.arange(1, LONGEST + 1), n)
        e = s + width
        ok = e <= self.first[run[s] + 1] if n else np.zeros(0, bool)
        s, width, e = s[ok], width[ok], e[ok]
        opens = (kind[s] == DIGIT) | ((kind[s] == PLUS) | (kind[s] == OPEN)) & (width > 1)
        d = digits[e] - digits[s]
        ok = opens & (kind[e - 1] == DIGIT) & (d >= LEAST_DIGITS) & (d <= MOST_DIGITS) & (busy[e] == busy[s])
        s, width, e, d = s[ok], width[ok], e[ok], d[ok]
        within = lambda x: x[e] - x[s]
        g, dots, dashes, blanks, plus = within(groups), within(of[DOT]), within(of[DASH]), within(of[BLANK]), within(of[PLUS])
        opened, closed = within(of[OPEN]), within(of[CLOSE])
        last = (digits[e] - digits[self.first[run[s]]]) % 2  # whether the last digit stands at an even place of its run
        total = np.where(last == 1, within(even), within(odd))
        card = d >= 14
        address = (g == 4) & (dots == 3) & (width == 7)
        between = pair[e - 1] - pair[s]
        three = lambda k, want: (e - 1 - 2 * k >= s) & (size[np.maximum(e - 1 - 2 * k, 0)] == want)
        before = np.array([bool(b) and (b.isalnum() or b in "_/=&#@") for _, b, _, _ in runs], bool)
        after = np.array([bool(a) and (a.isalnum() or a in "_/=&@") for _, _, a, _ in runs], bool)
        r = run[s]
        head, tail = s == self.first[r], e == self.first[r + 1]
        # a number goes on if a digit follows one separator
        on = lambda at, step, edge: ~edge & (kind[np.clip(at + step, 0, max(n - 1, 0))] != DIGIT) & (run[np.clip(at + 2 * step, 0, max(n - 1, 0))] == r) & (kind[np.clip(at + 2 * step, 0, max(n - 1, 0))] == DIGIT)
        step = np.searchsorted(_DIGIT_STEPS, d, "right")
        seps = dots + dashes + blanks
        columns = [
            np.ones(len(s), bool), kind[s] == PLUS if n else ok[:0], plus > (kind[s] == PLUS), (opened == closed) & (opened > 0), opened != closed, card & (total % 10 == 0), card & (total % 10 != 0),
            address & (within(fit) == 4), address & (within(fit) < 4), *[step == k for k in range(7)], *[g == k for k in (1, 2, 3, 4)], g >= 5,
            (seps > 0) & (dots == seps), (seps > 0) & (dashes == seps), (seps > 0) & (blanks == seps), (seps > 0) & (dots < seps) & (dashes < seps) & (blanks < seps), between > 0,
            (g > 1) & (within(fours) == g), three(0, 4) & three(1, 3) & ((e - 4 >= s) & ((size[np.maximum(e - 5, 0)] == 3) | (size[np.maximum(e - 6, 0)] == 3))),
            head & before[r], tail & after[r], on(s, -1, head), on(e - 1, 1, tail),
        ]
        self.features = np.stack(columns, 1) if len(s) else np.zeros((0, N_FEATURES), bool)
        self.run, self.start, self.width = r, s - self.first[r], width

    def groups(self, most: int = 8192):
        """Runs of like length, as arrays of run numbers, so that padding is small."""
        order, i = np.argsort(self.count, kind="stable"), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * self.count[order[j]] <= most:
                j += 1
            yield order[i:j]
            i = j

    def segments(self, runs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[run, start, width - 1, label] scores of these runs, -inf where there is no candidate; their lengths; candidate numbers."""
        place = np.full(self.n, -1)
        place[runs] = np.arange(len(runs))
        length = self.count[runs]
        seg = np.full((len(runs), int(length.max(initial=0)), LONGEST, 5), -np.inf)
        seg[:, :, 0, O] = np.where(np.arange(seg.shape[1]) < length[:, None], 0.0, -np.inf)
        mine = np.flatnonzero(place[self.run] >= 0)
        for part in np.array_split(mine, len(mine) // 100_000 + 1):
            seg[place[self.run[part]], self.start[part], self.width[part] - 1, IP:] = self.features[part] @ weights
        return seg, length, mine


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Field:
    """Semi-Markov field: weights [feature, kind but email], moves [label before, label]; runs begin after label O."""

    def __init__(self):
        self.weights, self.moves = np.zeros((N_FEATURES, 3)), np.zeros((5, 5))

    def decode(self, tokens: Tokens) -> list[list[tuple[int, int, int]]]:
        """Per run the best segmentation's (first token, kind, end token)."""
        out: list[list] = [[] for _ in range(tokens.n)]
        if not self.weights.any():
            return out
        for runs in tokens.groups():
            seg, length, _ = tokens.segments(runs, self.weights)
            n, t_max = seg.shape[:2]
            into = np.full((n, t_max + 1, 5), -np.inf)
            back_move, back_width = np.zeros((n, t_max + 1, 5), np.int8), np.zeros((n, t_max + 1, 5), np.int8)
            best = np.full((n, t_max + 1, 5), -np.inf)
            best[:, 0, O] = 0
            for t in range(t_max + 1):
                if t:
                    k = min(t, LONGEST)
                    at = t - np.arange(1, k + 1)
                    reached = into[:, at] + seg[:, at, np.arange(k)]
                    back_width[:, t] = reached.argmax(1) + 1
                    best[:, t] = reached.max(1)
                moved = best[:, t, :, None] + self.moves
                back_move[:, t] = moved.argmax(1)
                into[:, t] = moved.max(1)
            for i, r in enumerate(runs):
                t, label = int(length[i]), int(best[i, length[i]].argmax())
                while t > 0:
                    s = t - int(back_width[i, t, label])
                    if label != O:
                        out[r].append((s, label, t))
                    t, label = s, int(back_move[i, s, label])
                out[r].reverse()
        return out

    def gradient(self, tokens: Tokens, wanted: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradients. wanted: label of each candidate, O if it is not in the labelling; moves: counts."""
        total, gw, gm = 0.0, np.zeros_like(self.weights), moves.copy()
        has = np.flatnonzero(wanted)
        total += (tokens.features[has] @ self.weights)[np.arange(len(has)), wanted[has] - IP].sum() + (moves * self.moves).sum()
        np.add.at(gw.T, wanted[has] - IP, tokens.features[has])
        for runs in tokens.groups():
            seg, length, mine = tokens.segments(runs, self.weights)
            n, t_max = seg.shape[:2]
            alpha, into = np.full((n, t_max + 1, 5), -np.inf), np.full((n, t_max + 1, 5), -np.inf)
            alpha[:, 0, O] = 0
            for t in range(t_max + 1):
                if t:
                    k = min(t, LONGEST)
                    at = t - np.arange(1, k + 1)
                    alpha[:, t] = _soft(into[:, at] + seg[:, at, np.arange(k)], 1)
                into[:, t] = _soft(alpha[:, t, :, None] + self.moves, 1)
            ends = np.arange(n), length
            z = _soft(alpha[ends], 1)
            beta, after = np.full((n, t_max + LONGEST + 1, 5), -np.inf), np.full((n, t_max, 5), -np.inf)
            beta[ends] = 0
            for t in range(t_max - 1, -1, -1):
                after[:, t] = _soft(seg[:, t] + beta[:, t + 1 : t + 1 + LONGEST], 1)
                inside = t < length
                beta[inside, t] = _soft(self.moves + after[inside, t][:, None, :], 2)
            total -= z.sum()
            place = np.full(tokens.n, -1)
            place[runs] = np.arange(n)
            i, s, w = place[tokens.run[mine]], tokens.start[mine], tokens.width[mine]
            p = np.exp(into[i, s] + seg[i, s, w - 1] + beta[i, s + w] - z[i, None])[:, IP:]
            gw -= tokens.features[mine].T @ p
            for t in range(t_max):
                gm -= np.exp(alpha[:, t, :, None] + self.moves + after[:, t][:, None, :] - z[:, None, None]).sum(0)
        return total, gw, gm

    def fit(self, examples: list[tuple[str, str, str, list[tuple[int, int, int]]]], steps: int = 80, rate: float = 0.3, shrink: float = 0.02) -> Field:
        """examples: (run, character before, after, [(start, kind, end)]). Full-batch Adam on the penalised log-likelihood."""
        if not examples:
            return self
        tokens = Tokens([(t, b, a, []) for t, b, a, _ in examples])
        number = {(r, s, w): i for i, (r, s, w) in enumerate(zip(tokens.run.tolist(), tokens.start.tolist(), tokens.width.tolist()))}
        wanted, moves = np.zeros(len(tokens.run), np.int64), np.zeros((5, 5))
        for r, (_, _, _, spans) in enumerate(examples):
            at = {o: i for i, o in enumerate(tokens.offsets[r])}
            label, t = O, 0
            for s, kind, e in sorted(spans):
                if (c := number.get((r, at.get(s, -1), at.get(e, -1) - at.get(s, -1)))) is None:
                    continue
                wanted[c] = kind
                for _ in range(t, at[s]):
                    moves[label, O] += 1
                    label = O
                moves[label, kind] += 1
                label, t = kind, at[e]
            for _ in range(t, int(tokens.count[r])):
                moves[label, O] += 1
                label = O
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.moves, self.moves)]
        for step in range(1, steps + 1):
            _, gw, gm = self.gradient(tokens, wanted, moves)
            for x, g, m, v in ((self.weights, gw, state[0], state[1]), (self.moves, gm, state[2], state[3])):
                g = g / len(examples) - shrink / len(examples) * x
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
        return self


# --- learning ------------------------------------------------------------------------------------------------------------
def _shifted_digit(text: str, rng) -> str:
    """text with one digit moved, so that a check sum that held fails."""
    at = rng.choice([i for i, c in enumerate(text) if c.isdigit()])
    return text[:at] + str((int(text[at]) + int(rng.integers(1, 9))) % 10) + text[at + 1 :]


def rewritten(found: list[tuple[int, str]], rng) -> list[tuple[str, str, str, list]]:
    """Examples from (kind, text): each item alone; two side by side, or beside a short number, which patterns fail on; phones
    without their plus in groups of three, three and four; and what looks alike but is none: a card whose sum fails, an
    address with a part over 255, plain or oddly grouped digits, an item that runs into letters."""
    out = []
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    for k, (kind, text) in enumerate(found):
        other_kind, other = found[int(rng.integers(len(found)))]
        out.append((text, " ", " ", [(0, kind, len(text))]))
        out.append((f"{text} {other}", " ", " ", [(0, kind, len(text)), (len(text) + 1, other_kind, len(text) + 1 + len(other))]))
        short = number(int(rng.integers(1, 5)))
        out.append((f"{short} {text}", " ", " ", [(len(short) + 1, kind, len(short) + 1 + len(text))]) if k % 2 else (f"{text} {short}", " ", " ", [(0, kind, len(text))]))
        if kind == CARD:
            digits = re.sub("[^0-9]", "", text)
            spoiled = _shifted_digit(digits, rng)
            fours = " ".join(spoiled[i : i + 4] for i in range(0, len(spoiled), 4))
            out += [(x, " ", " ", []) for x in (spoiled, fours) if not luhn(spoiled)]
        elif kind == IP:
            parts = text.split(".")
            parts[int(rng.integers(4))] = str(int(rng.integers(256, 1000)))
            out += [(".".join(parts), " ", " ", []), (".".join(text.split(".")[:3] + ["0"] * 2), " ", " ", [])]
        elif kind == PHONE:
            ten = re.sub("[^0-9]", "", text)[-10:]
            for shape in (f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", f"{ten[:3]}-{ten[3:6]}-{ten[6:]}"):
                out.append((shape, " ", " ", [(0, PHONE, len(shape))]))
            out += [(ten, " ", " ", []), (ten[:3] + "-" + ten[3:5] + "-" + ten[5:], " ", " ", [])]
        if k % 3 == 0:
            sizes = rng.integers(1, 7, int(rng.integers(2, 7)))
            odd = rng.choice([" ", "-", "."]).join(number(int(n)) for n in sizes)
            if len(re.sub("[^0-9]", "", odd)) >= LEAST_DIGITS and not patterns(odd) and [*sizes[-3:]] != [3, 3, 4]:
                out.append((odd, " ", " ", []))
            plain = number(int(rng.integers(7, 20)))
            out += [] if patterns(plain) else [(plain, " ", " ", [])]
        if k % 4 == 0:
            out.append((text, "x", "y", []))
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS, runs: int = SAMPLE_RUNS) -> Field:
    """A field from about `sample` documents, chosen by hash of text and key, and at most `runs` items that patterns find in them and that
    stand alone in their run. Without any, the field finds nothing."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))

    def cut(batches):
        for batch in batches:
            kinds, texts = [], []
            for t in batch.column(0).to_pylist():
                t = t or ""
                spans = patterns(t) if re.search("[0-9]", t) else []
                alone = {(s, e) for s, e in _runs(t)}
                for s, kind, e in spans:
                    if kind != EMAIL and (s, e) in alone:
                        kinds.append(kind)
                        texts.append(t[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["kind", "item"])

    some = docs.where(hashed("personal data", key, text) / float(1 << 52) < share).select(text)
    found = stored(some.mapInArrow(cut, "kind int, item string").distinct())
    # as many of each kind as there are, up to a third
    items = [(r["kind"], r["item"]) for k in (IP, CARD, PHONE) for r in found.where(F.col("kind") == k).orderBy(hashed("item", "item"), "item").limit(runs // 3).collect()]
    return Field().fit(rewritten(items, np.random.default_rng(7)))


# --- finding -------------------------------------------------------------------------------------------------------------
def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Per text what the patterns find and what the field adds, each a list of (start, kind, end)."""
    base, todo, where = [], [], []
    for i, t in enumerate(texts):
        told = patterns(t) if re.search("[0-9@]", t) else []
        base.append((told, []))
        if "@" in t:
            starts, reach = [s for s, _, _ in told], list(accumulate((e for _, _, e in told), max, initial=0))
            wide = _mails(t, lambda c: WIDE_LOCAL.match(c) is not None, WIDE_DOMAIN)
            base[i][1].extend((s, EMAIL, e) for s, e in wide if reach[bisect_left(starts, e)] <= s)
        j = 0
        for s, e in _runs(t):
            while j < len(told) and told[j][2] <= s and told[j][0] < s:
                j += 1
            held, k = [], j
            while k < len(told) and told[k][0] < e:
                if told[k][2] > s:
                    held.append((max(told[k][0] - s, 0), min(told[k][2], e) - s))
                k += 1
            if held and min(a for a, _ in held) == 0 and max(b for _, b in held) == e - s and len(held) == 1:
                continue
            if sum(c in "0123456789" for c in t[s:e]) >= LEAST_DIGITS:
                todo.append((t[s:e], t[s - 1 : s], t[e : e + 1], held))
                where.append((i, s))
    for at in range(0, len(todo), 2000):
        tokens = Tokens(todo[at : at + 2000])
        for (i, s), found, offsets in zip(where[at : at + 2000], field.decode(tokens), tokens.offsets):
            base[i][1].extend((s + offsets[a], kind, s + offsets[b]) for a, kind, b in found)
    return base


def with_spans(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `spans`, array<struct<kind, start, end, base>>: code points, end exclusive, by start and kind; base is true for what the
    patterns find. Spans of the field overlap none of these. A null or empty text has none. A column of docs named spans, in
    any case, is replaced."""
    get = shared(docs.sparkSession, field)

    @F.arrow_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def search(column: pa.Array) -> pa.Array:
        column = pc.fill_null(column, "")
        maybe = pc.match_substring_regex(column, "[0-9@]").to_pylist()
        at, rows = [0], []
        hits = [k for k, m in enumerate(maybe) if m]
        found = dict(zip(hits, find_all([column[k].as_py() for k in hits], get())))
        for k in range(len(column)):
            if k in found:
                told, added = found[k]
                rows += sorted([(s, kind, e, True) for s, kind, e in told] + [(s, kind, e, False) for s, kind, e in added])
            at.append(len(rows))
        parts = [pa.array([KINDS[r[1] - 1] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.bool_())]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, ["kind", "start", "end", "base"]))

    rows, names = replacing(docs, ["spans"], key, text)
    return rows.select(*rows.columns, search(text).alias("spans")).toDF(*names)


def redacted(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts have every span replaced by its kind in angle brackets; of overlapping spans the first is named and all
    of them go. A null text stays null."""
    rows = with_spans(docs, field, key, text)
    at = F.col(text)
    step = lambda a, s: F.when(s["start"] >= a["end"], F.struct(F.concat(a["out"], F.substring(at, a["end"] + 1, s["start"] - a["end"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("end"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["end"], s["end"]).alias("end")))
    whole = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("end")), step, lambda a: F.concat(a["out"], F.substring(at, a["end"] + 1, F.length(at))))
    return rows.withColumn(text, whole).drop("spans")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many items of each kind the patterns find, the digest of these, and all spans with those of the field."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, learn(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))
