"""Personal data by a semi-Markov conditional random field beside four base patterns.

Base spans (email, ip, card, phone) come from patterns, each applied leftmost and non-overlapping, and stay as they are. The field looks for what they miss: addresses of mail spelt
out, numbers of telephones, cards, accounts and papers in other forms, dates of birth, names and postal addresses. A text is cut into tokens; a candidate is a run of at most MOST
tokens on one line of a form that its kind allows; whole-span features (groups of digits, signs between them, check digits, valid dates, words before it) score it as each
kind, and a token outside has the score 0. Dynamic programming over the bounded candidates chooses boundaries and kinds together: the best sum over all ways of cutting a text into
candidates and outside tokens. Tokens far from any digit, sign or word that a candidate needs are outside whatever the weights, so only their neighbourhoods are cut into tokens; the result is that of the
whole text. Base spans are not candidates, and no candidate overlaps one.

The tables hold no labelled spans: the weights are fitted to SENTENCES sentences that `draw` makes by rule, of entities with and without the words that announce them and of
look-alikes (versions, prices, years, ranges, hashes, numbers without check digits), by the gradient of the likelihood (forward and backward sums over the same candidates).

Odd input: a null text is empty and has no span; offsets are code points, ends are exclusive; texts of any length are scanned whole in time linear in their length; repeated rows each
get their own result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from datetime import date
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow

BASE = ("email", "ip", "card", "phone")
FOUND = ("likely_email", "likely_phone", "likely_card", "likely_account", "likely_id", "likely_birth", "likely_name", "likely_address")
KINDS = (*BASE, *FOUND)
#: Tokens and characters of a candidate at most; characters around a token that is needed.
MOST, WIDEST, AROUND = 13, 72, 100
SENTENCES, ROUNDS = 900, 30

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
AT, DOT = ("at", "AT", "arroba"), ("dot", "DOT", "punkt", "point", "punto")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "rue", "calle", "straße", "strasse", "weg", "platz", "boulevard", "plaza")
MONTHS = "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre noviembre diciembre".split()
#: Words that announce a kind, by lower case.
CUES = {
    **dict.fromkeys(("email", "mail", "e", "contact", "write", "reach", "courriel", "correo"), "email"),
    **dict.fromkeys(("tel", "telephone", "phone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono", "móvil", "handy"), "phone"),
    **dict.fromkeys(("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), "card"),
    **dict.fromkeys(("iban", "account", "konto", "compte", "cuenta"), "account"),
    **dict.fromkeys(("ssn", "passport", "licence", "license", "ausweis", "passeport", "pasaporte", "dni", "security"), "id"),
    **dict.fromkeys(("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacimiento"), "birth"),
    **dict.fromkeys(("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "monsieur", "madame", "señor", "señora", "name", "signed"), "name"),
    **dict.fromkeys(("address", "lives", "resides", "adresse", "dirección", "wohnhaft"), "address"),
}
#: Without one of these in it a text has neither names nor mail spelt out.
NAMED = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Name", "name", "Signed", "signed")
WORDS = re.compile(rf"\b(?:{'|'.join((*NAMED, *DOT))})\b|[(\[](?:{'|'.join(AT)})[)\]]")
SPELT = (*DOT, *(f"({w})" for w in AT), *(f"[{w}]" for w in AT))
NEEDED = re.compile(r"[0-9]+|@")


ZEROS = str.maketrans("123456789", "000000000")


def digits_of(s: str) -> str:
    return s if s.isdigit() and s.isascii() else re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """(start, end) as the pattern of an address finds them: what stands before each @ is looked at once."""
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            lo, width = at, 64
            while lo > done:  # the run of characters before, in growing steps
                part = text[max(done, at - width) : at]
                lo = at - (len(part) - len(part.rstrip(LOCAL)))
                if lo > max(done, at - width):
                    break
                width *= 4
            if lo < at:
                yield lo, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the base patterns, in this order."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


# candidates and their features


class Line:
    """The tokens of a stretch of text: their spans, and a sign for each (d digits, A a word with a capital, a another word, else the sign itself)."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None, taken=()):
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi)]
        self.words = [text[s:e] for s, e in self.spans]
        self.signs = "".join("d" if "0" <= w[0] <= "9" else ("A" if w[0].isupper() else "a") if w[0].isalpha() else w[0] if w[0] < "\x80" else "?" for w in self.words)
        self.closed = bytearray(len(self.spans))
        starts, ends = [s for s, _ in self.spans], [e for _, e in self.spans]
        for s, e in taken:
            if ends and s >= ends[-1]:
                break
            for k in range(bisect.bisect_right(ends, s), bisect.bisect_left(starts, e)):
                self.closed[k] = 1
        self.cues: list[str] = []  # the last word of the five before each token that announces a kind
        cue, left = "none", 0
        for w in self.words:
            self.cues.append(cue)
            own = CUES.get(w.lower()) if len(w) < 20 else None
            cue, left = (own, 5) if own else (cue, left - 1) if left > 1 else ("none", 0)

    def free(self, i: int, j: int) -> bool:
        """Whether no letter or digit is right before or behind."""
        s, e = self.spans[i][0], self.spans[j - 1][1]
        return not (s and self.text[s - 1].isalnum()) and not self.text[e : e + 1].isalnum()

    def runs(self, i: int, signs: str, most: int):
        """Ends j of token runs from i that keep to these signs, to one line and to single blanks."""
        for j in range(i, min(len(self.signs), i + most)):
            if self.closed[j] or self.signs[j] not in signs or self.spans[j][1] - self.spans[i][0] > WIDEST:
                return
            if j > i and (gap := self.text[self.spans[j - 1][1] : self.spans[j][0]]) not in ("", " "):
                return
            yield j + 1

    def candidates(self) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first token, end, places of the kinds it may be)."""
        found: dict[tuple[int, int], set[int]] = {}
        words, signs = self.words, self.signs
        spelt = "@" in signs or any(w in DOT for w in words) or any(w in AT and words[k : k + 1] in (["("], ["["]) for k, w in enumerate(words[1:]))
        streets = {k for k, w in enumerate(words) if w.lower() in STREETS} if any(c in signs for c in "Aa") else set()
        named = -9
        for i, c in enumerate(signs):
            if c in "d(+":
                for j, kinds in self.numeric(i):
                    found.setdefault((i, j), set()).update(kinds)
            if c == "d" and signs[i + 1 : i + 2] in ("A", "a", "."):
                for j in self.runs(i, "dAa.", 5):  # 3 March 1980, 3. March 1980
                    if j - i >= 3 and signs[j - 1] == "d" and len(words[j - 1]) == 4 and words[j - 2].lower() in MONTHS:
                        found.setdefault((i, j), set()).add(5)
            if streets and c in "dA" and any(k in streets for k in range(i, i + 4)):
                for j in self.runs(i, "dAa", 5):
                    if j - i >= 3 and "d" in signs[i:j] and any(k in streets for k in range(i, j)):
                        found.setdefault((i, j), set()).add(7)
            if c == "A" and len(words[i]) == 2 and words[i].isupper() and signs[i + 1 : i + 2] == "d" and self.spans[i][1] == self.spans[i + 1][0]:
                for j in self.runs(i, "dA", MOST):
                    if 15 <= sum(map(len, words[i:j])) <= 34:
                        found.setdefault((i, j), set()).add(3)
            if c == "A" and i - named <= 3:
                for j in self.runs(i, "A", 4):
                    found.setdefault((i, j), set()).add(6)
            if spelt and c in "Aad":
                for j in self.spelt(i):
                    found.setdefault((i, j), set()).add(0)
            if words[i] in NAMED:
                named = i
        return [(i, j, tuple(sorted(k))) for (i, j), k in sorted(found.items()) if self.free(i, j)]

    def numeric(self, i: int):
        """Ends and kinds of the runs from i of at most six groups of digits, and signs between them."""
        words, signs = self.words, self.signs
        c = signs[i]
        digits = groups = 0
        for j in self.runs(i, "d().-/" if i + 1 < len(signs) and c != "+" else "d().-/+", MOST):
            if signs[j - 1] == "+" and j - 1 > i:
                return
            if signs[j - 1] == "d":
                digits += len(words[j - 1])
                groups += 1
                if digits > 19 or groups > 6:
                    return
                kinds = {1} if 7 <= digits <= 15 else set()
                kinds |= {2} if 12 <= digits and c == "d" else set()
                kinds |= {4} if 8 <= digits <= 12 and c == "d" and groups <= 3 else set()
                kinds |= {5} if 6 <= digits <= 8 and j - i == 5 and c == "d" and signs[i + 1] == signs[i + 3] and signs[i + 1] in "./-" else set()
                if kinds:
                    yield j, kinds

    def spelt(self, i: int):
        """Ends of the runs from i that may be an address of mail: blanks only beside the signs or words for @ and the dot."""
        words = self.words
        marks = ("@", "(", ")", "[", "]", ".", *AT, *DOT)
        at = dot = 0
        for j in self.runs(i, "Aad.@()[]-_+", MOST):
            w = words[j - 1]
            if j - 1 > i and self.spans[j - 2][1] < self.spans[j - 1][0] and w not in marks and words[j - 2] not in marks:
                return
            at += w == "@" or w in AT
            dot += at and (w == "." or w in DOT)
            if at > 1:
                return
            if dot and self.signs[j - 1] in "Aa" and w not in DOT and (words[j - 2] in ("]", ")", ".") or words[j - 2] in DOT):
                yield j

    def features(self, i: int, j: int) -> list[str]:
        """What the whole span looks like, and what stands around it."""
        words, signs = self.words[i:j], self.signs[i:j]
        s, e = self.spans[i][0], self.spans[j - 1][1]
        span = self.text[s:e]
        d = digits_of(span)
        groups = [len(w) for w, c in zip(words, signs) if c == "d"]
        cue = self.cues[i]
        out = ["any", f"cue {cue}", f"digits {len(d)}", f"groups {'-'.join(map(str, groups[:6]))}", f"between {''.join(sorted(set(re.sub(r'[^\W_]', '', span))))}", f"tokens {min(j - i, 8)}", f"signs {signs[0]}{signs[-1]}"]
        if d and len(d) >= 12:
            out.append(f"luhn {luhn(d)}, cue {cue == 'card'}")
        if "A" in signs and d and len(span) >= 15:
            out.append(f"account {checked(span)}")
        if len(groups) in (2, 3) and len(d) <= 8:
            out.append(f"date {dated(words, signs)}, cue {cue == 'birth'}")
        if {"@", *AT} & set(words):
            out.append(f"spelt {words[-1].lower() in ('com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'io')}, brackets {any(c in signs for c in '([')}")
            out.append(f"first {self.glued(i)}")
        if "A" in signs:
            out += [f"capitals {signs.count('A')}", f"street {any(w.lower() in STREETS for w in words)}"]
            out.append(f"after name {i > 0 and (self.words[i - 1] in NAMED or i > 1 and self.words[i - 2] in NAMED)}")
        before, after = self.text[s - 1 : s], self.text[e : e + 1]
        out.append(f"glued {bool(before) and not before.isspace() and before not in '(:\"='},{after.isalnum() or after in ('-', '/', '@')}")
        out.append(f"more {self.more(i, j)}")
        return out

    def key(self, i: int, j: int) -> tuple:
        """All that the features depend on: spans with the same key have the same."""
        s, e = self.spans[i][0], self.spans[j - 1][1]
        span = self.text[s:e]
        if self.signs[i] in "d(+" and not any(c in self.signs[i:j] for c in "Aa@"):
            digits = digits_of(span)
            words, signs = self.words[i:j], self.signs[i:j]
            flags = len(digits) >= 12 and luhn(digits), len(digits) <= 8 and signs.count("d") in (2, 3) and dated(words, signs)
            span = span.translate(ZEROS)
        else:
            flags = i > 0 and self.words[i - 1] in NAMED or i > 1 and self.words[i - 2] in NAMED, self.glued(i)
        return span, flags, self.cues[i], self.text[s - 1 : s], self.text[e : e + 1], self.more(i, j)

    def glued(self, i: int) -> bool:
        """Whether the token before is a part of the same name."""
        return i > 0 and self.signs[i - 1] in "._-+" and self.spans[i - 1][1] == self.spans[i][0]

    def more(self, i: int, j: int) -> str:
        """Whether tokens of the same sort go on before or behind."""
        same = lambda k, of: 0 <= k < len(self.signs) and self.signs[k] == self.signs[of]
        return f"{same(i - 1, i)}{same(j, j - 1)}"


def checked(span: str) -> bool:
    """The remainder of an account number with its check digits."""
    s = re.sub(r"\s", "", span).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def dated(words: list[str], signs: str) -> bool:
    """Whether the numbers are a day of a year from 1900."""
    numbers = [int(w) for w, c in zip(words, signs) if c == "d"]
    if len(numbers) == 2:
        numbers.insert(1, 1)
    for y, m, d in (numbers, numbers[::-1], (numbers[2], numbers[0], numbers[1])):
        try:
            if 1900 <= y <= 2100 and date(y, m, d):
                return True
        except ValueError:
            pass
    return False


# the field


class Field:
    """Weights by kind and feature; two more for a span right behind another, of the same kind or not."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, joint: np.ndarray):
        self.names, self.weights, self.joint = names, weights, joint
        self.known: dict[tuple, list[float]] = {}  # scores by key

    def scores(self, features: list[str], kinds: tuple[int, ...]) -> list[float]:
        """The score of a candidate as each of the kinds; a feature that training never saw counts nothing."""
        at = [self.names[f] for f in features if f in self.names]
        return self.weights[np.ix_(kinds, at)].sum(axis=1).tolist()

    def best(self, line: Line) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best cut of a line."""
        edges = []
        for i, j, kinds in line.candidates():
            key = line.key(i, j), kinds
            if key not in self.known:
                if len(self.known) > 1 << 17:
                    self.known.clear()
                self.known[key] = self.scores(line.features(i, j), kinds)
            edges += [(i, j, k, v) for k, v in zip(kinds, self.known[key])]
        return [(k, line.spans[i][0], line.spans[j - 1][1]) for i, j, k in best_cut(edges, self.joint)]


def best_cut(edges: list[tuple[int, int, int, float]], joint) -> list[tuple[int, int, int]]:
    """(i, j, kind) of the spans of the best sum; only places where a candidate starts or ends are visited."""
    by_start: dict[int, list] = {}
    for i, j, k, v in edges:
        by_start.setdefault(i, []).append((j, k, v))
    places = sorted({i for i, *_ in edges} | {j for _, j, *_ in edges})
    ended: dict[int, dict[int, tuple]] = {p: {} for p in places}  # by end and kind: the sum and how it came about
    outside: tuple = (0.0, None)
    for p in places:
        here = ended[p]
        for j, k, v in by_start.get(p, ()):
            top = (outside[0] + v, (outside[1], (p, j, k)))
            for q, (u, way) in here.items():
                if u + v + joint[int(q == k)] > top[0]:
                    top = (u + v + joint[int(q == k)], (way, (p, j, k)))
            if k not in ended[j] or top[0] > ended[j][k][0]:
                ended[j][k] = top
        outside = max([outside, *here.values()], key=lambda x: x[0])
    spans, way = [], outside[1]
    while way:
        way, span = way
        spans.append(span)
    return spans[::-1]


def marginals(edges: list[tuple[int, int, int]], scores: np.ndarray, joint: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log of the sum over all cuts, the probability of each edge, and the expected numbers of the two joints."""
    places = sorted({i for i, *_ in edges} | {j for _, j, *_ in edges})
    starts: dict[int, list[int]] = {p: [] for p in places}
    ends: dict[int, list[int]] = {p: [] for p in places}
    for e, (i, j, _) in enumerate(edges):
        starts[i].append(e)
        ends[j].append(e)
    link = np.exp(joint)
    weight = np.exp(scores)
    free = [1.0]  # sums over cuts up to a place whose last token is outside
    forward = np.zeros(len(edges))  # and whose last span is this edge
    for p in places:
        behind = ends[p]
        for e in starts[p]:
            forward[e] = weight[e] * (free[-1] + sum(forward[f] * link[int(edges[f][2] == edges[e][2])] for f in behind))
        free.append(free[-1] + sum(forward[f] for f in behind))
    total = free[-1]
    after = 1.0
    backward = np.zeros(len(edges))  # sums over cuts of what follows an edge
    joints = np.zeros(2)
    for p in reversed(places):
        ahead = starts[p]
        for f in ends[p]:
            backward[f] = after + sum(weight[e] * backward[e] * link[int(edges[f][2] == edges[e][2])] for e in ahead)
            for e in ahead:
                same = int(edges[f][2] == edges[e][2])
                joints[same] += forward[f] * link[same] * weight[e] * backward[e]
        after = after + sum(weight[e] * backward[e] for e in ahead)
    return float(np.log(total)), forward * backward / total, joints / total


def fitted(sentences: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS, penalty: float = 1e-3) -> Field:
    """Weights of the largest penalised likelihood, by steps scaled to past gradients."""
    names: dict[str, int] = {}
    cases = []
    for text, gold in sentences:
        line = Line(text, taken=[x[1:] for x in base_spans(text)])
        edges, feats = [], []
        for i, j, kinds in line.candidates():
            at = np.array([names.setdefault(f, len(names)) for f in line.features(i, j)])
            for k in kinds:
                edges.append((i, j, k))
                feats.append(at)
        if edges:
            spans = {(k, line.spans[i][0], line.spans[j - 1][1]): e for e, (i, j, k) in enumerate(edges)}
            right = np.zeros(len(edges))
            right[[spans[g] for g in gold if g in spans]] = 1
            sizes = [len(f) for f in feats]
            cases.append((edges, np.repeat([k for *_, k in edges], sizes), np.concatenate(feats), np.append(0, np.cumsum(sizes)[:-1]), np.array(sizes), right))
    weights, joint = np.zeros((len(FOUND), len(names))), np.zeros(2)
    seen, seen_joint = np.full_like(weights, 1e-8), np.full(2, 1e-8)
    rng = random.Random(5)
    for _ in range(rounds):
        rng.shuffle(cases)
        for edges, kind, at, first, sizes, right in cases:
            _, p, joints = marginals(edges, np.add.reduceat(weights[kind, at], first), joint)
            pull = np.zeros_like(weights)
            np.add.at(pull, (kind, at), np.repeat(right - p, sizes))
            ends = {(i, j): k for (i, j, k), r in zip(edges, right) if r}
            held = np.zeros(2)
            for (_, j), k in ends.items():
                for (i, _), q in ends.items():
                    held[int(k == q)] += i == j
            rows, cols = np.nonzero(pull)
            g = pull[rows, cols] - penalty * weights[rows, cols]
            seen[rows, cols] += g * g
            weights[rows, cols] += 0.3 * g / np.sqrt(seen[rows, cols])
            g = held - joints - penalty * joint
            seen_joint += g * g
            joint += 0.3 * g / np.sqrt(seen_joint)
    return Field(names, weights, joint)


# sentences by rule


def draw(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n sentences with their (kind, start, end)."""
    rng = random.Random(seed)
    parts = [a + b for a in ("b", "d", "f", "l", "m", "n", "r", "s", "t", "th", "v", "") for b in ("a", "e", "i", "o", "u", "er", "in", "on", "es", "ä", "é")]
    word = lambda low=1, high=4: "".join(rng.choice(parts) for _ in range(rng.randint(low, high)))
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    name = lambda: word(2, 3).capitalize()
    year = lambda: str(rng.randint(1925, 2020))
    day, month = lambda: rng.randint(1, 28), lambda: rng.randint(1, 12)

    def card(valid=True) -> str:
        while True:
            d = rng.choice("3456") + number(rng.choice((14, 15, 15, 15)))
            if luhn(d) == valid:
                return d

    def account() -> str:
        land, tail = rng.choice(("DE", "FR", "ES", "GB", "NL")), number(rng.choice((12, 14, 16, 18)))
        rest = 98 - int("".join(str(int(c, 36)) for c in tail + land + "00")) % 97
        s = f"{land}{rest:02d}{tail}"
        return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def when() -> str:
        sep = rng.choice("./-")
        return rng.choice((f"{day()}{sep}{month()}{sep}{year()}", f"{year()}{sep}{month():02d}{sep}{day():02d}", f"{day()} {rng.choice(MONTHS).capitalize()} {year()}", f"{day()}. {rng.choice(MONTHS).capitalize()} {year()}"))

    def mail() -> str:
        who, host, end = rng.choice((word(2), f"{word(1, 2)}.{word(2)}", f"{word(2)}{number(2)}")), word(2, 3), rng.choice(("com", "org", "net", "de", "fr", "es"))
        at, dot = rng.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", " . "), (" @ ", ".")))
        return f"{who}{at}{host}{dot}{end}"

    def phone() -> str:
        return rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)} {number(7)}", f"0{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(4)}/{number(6)}", f"00{number(2)} {number(3)} {number(6)}", f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(6)}"))

    def paper() -> str:
        return rng.choice((f"{number(3)}-{number(2)}-{number(4)}", f"{number(9)}", f"{number(8)}"))

    def place() -> str:
        return rng.choice((f"{rng.randint(1, 300)} {name()} {rng.choice(('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'St'))}", f"{rng.choice(('Rue', 'Calle'))} {name()} {rng.randint(1, 200)}", f"{name()} {rng.choice(('Weg', 'Platz', 'Straße'))} {rng.randint(1, 200)}", f"{rng.randint(1, 200)} rue {name()} {name()}"))

    grouped = lambda d: rng.choice((d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"))
    announced = {
        0: (("write to", "email:", "contact", "mail", "reach me at", ""), mail),
        1: (("call", "tel.", "phone:", "Telefon", "mobile", "fax", "Tel:"), phone),
        2: (("card", "Visa", "credit card number", "Karte", "card no."), lambda: grouped(card(False))),
        3: (("IBAN", "account", "Konto", ""), account),
        4: (("SSN", "passport no.", "social security number", "DNI", "passport"), paper),
        5: (("born", "born on", "date of birth:", "DOB", "geboren am", "née le"), when),
        6: (("Mr", "Mrs", "Dr.", "Herr", "Frau", "Mme", "Name:", "signed,", "Prof."), lambda: " ".join(name() for _ in range(rng.randint(1, 3)))),
        7: (("lives at", "address:", "resides at", "Adresse:", "", "at"), place),
    }
    other = (
        lambda: f"version {number(1)}.{number(1)}", lambda: f"{number(2)}.{number(2)} euro", year, when, lambda: f"{number(2)}:{number(2)}", lambda: f"pages {number(2)}-{number(3)}", lambda: f"{number(1)},{number(3)},{number(3)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(40)), lambda: card(False), lambda: card(False), lambda: f"no. {number(rng.randint(5, 12))}", lambda: f"{number(3)} {number(3)}", lambda: number(rng.randint(6, 18)), lambda: f"{name()} {name()}", lambda: f"at the {word()} dot of {word()}", lambda: f"{number(2)}/{number(2)}/{number(2)}", lambda: f"section {number(1)}.{number(2)}.{number(1)}",
        lambda: f"{number(4)}-{number(4)}", lambda: f"{rng.randint(2, 90)} {word()} {word()}", lambda: f"{name()} {number(4)}", lambda: " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(3, 8))), lambda: f"the name {word()} is {word()}", lambda: f"{number(3)}-{number(3)}-{number(4)}-{number(3)}-{number(2)}",
        lambda: f"born in {name()}", lambda: f"the card {word()} of {number(2)}", lambda: f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"from {year()} - {year()}",
    )

    def prose() -> str:
        return " ".join((name() if rng.random() < 0.15 else word()) + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(1, 7)))

    out = []
    for _ in range(n):
        text, gold = prose(), []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.55:
                kind = rng.randrange(len(FOUND))
                cues, make = announced[kind]
                cue = rng.choice(cues)
                text += " " + cue + " " * bool(cue)
                span = make()
                gold.append((kind, len(text), len(text) + len(span)))
                text += span
            else:
                text += " " + rng.choice(other)()
            text += rng.choice((" ", ". ", ", ", " ")) + (prose() if rng.random() < 0.8 else ".".join(number(3) for _ in range(4)))
        out.append((text, gold))
    return out


@lru_cache(1)
def trained() -> Field:
    return fitted(draw(SENTENCES, seed=11))


# whole texts


def stretches(text: str):
    """(start, end) of the neighbourhoods of what candidates need, cut at white space; candidates, and the words that announce them, lie within one."""
    marks = [m.span() for m in NEEDED.finditer(text)]
    if any(w in text for w in NAMED) or any(w in text for w in SPELT):
        marks = sorted(marks + [m.span() for m in WORDS.finditer(text)])
    lo = hi = None
    for s, e in marks:
        if hi is not None and s - hi <= 4 * AROUND:
            hi = max(hi, e)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = s, e
    if hi is not None:
        yield lo, hi


def likely_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of what the field finds outside the base spans."""
    taken = sorted(x[1:] for x in base)
    tops = list(accumulate((e for _, e in taken), max))
    found = []
    for s, e in stretches(text):
        lo, hi = max(0, s - AROUND), min(len(text), e + AROUND)
        while lo and lo > s - 2 * AROUND and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and hi < e + 2 * AROUND and not text[hi].isspace():
            hi += 1
        while lo < hi:  # a candidate and the words that announce it are on one line
            end = text.find("\n", lo, hi)
            end = hi if end < 0 else end
            if end - lo > 6:
                found += [(len(BASE) + k, a, b) for k, a, b in field.best(Line(text, lo, end, taken[bisect.bisect_left(tops, lo) :]))]
            lo = end + 1
    return found


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan_text(text: str | None, field: Field) -> tuple:
    """Counts of the base kinds, digest of the base spans, and all spans."""
    base = base_spans(text or "")
    kinds = [k for k, *_ in base]
    every = sorted(base + likely_spans(text or "", base, field))
    return *(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row."""
    field = field or trained()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def scan(batches):
        for b in batches:
            found = [scan_text(t, field) for t in b.column(1).to_pylist()]
            cols = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2))], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
