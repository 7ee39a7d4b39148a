"""Personal information inside free text, found by a semi-Markov conditional random field.

Every span of tokens up to a bounded length is a candidate of every kind that its characters allow; patterns propose
nothing. A span is scored as a whole: its shape, its words, the words around it and the kinds next to it are features, and
a dynamic program chooses boundaries and kinds together. All spans of a batch are scored at once by array operations; a
span that cannot gain on leaving it out is dropped before the dynamic program, which changes no result.

The weights are fitted by maximum likelihood on sentences that ``pii_training`` composes, so no labelled data are needed;
they are a table of fixed size.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import pii_words as W
from murmur.llm.confusables import TABLE, replaceable
from murmur.llm.tokens import VOCABULARY, read_ranks
from murmur.storage import checkpointed

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tokens of the longest span of each kind; a token is a run of letters, a run of digits or a sign.
LONGEST = {"email": 19, "phone": 24, "id_number": 16, "address": 17, "name": 8}
#: Places of the weight table, a power of two.
BITS = 18
#: Letters of a family name's ending, how many endings and how many frequent words are kept of the texts at hand.
ENDING, MOST_ENDINGS, MOST_FREQUENT = 4, 5_000, 50_000
#: Signs between texts that are read together, no fewer than the widest context.
_EDGE = "\x00" * 7
_TOKENS = re.compile(r"\s+|(?:[^\W\d_][̀-ͯ]*)+|\d+|.", re.S)
_LETTERS, _DIGITS, _SIGN, _SPACE, _END = range(5)
_SIGNS = "@.-_+/(),:;'#°ªº&*[]{}<>=!?\"|~$%€£"
_FLAGS = ("given", "common", "usual", "familiar", "at", "dot", "phone_cue", "id_cue", "code_cue", "place_cue", "name_cue", "number", "street", "prefix", "unit", "particle", "title", "extension", "bracket", "region", "abbreviation")
#: Columns of a token's row: what it is, its length, letter case, level of commonness, shapes, hashes of its endings.
_COLUMNS = ("type", "length", "case", "known", "number_shape", "word_shape", "end1", "end2", "end3", "sign", "digits")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Model(NamedTuple):
    weights: np.ndarray
    #: Score of kind b right after kind a; place 0 is text outside spans.
    follow: np.ndarray


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and for each of them the place of its origin; None where places are the same."""
    text = text.replace("\x00", " ")
    if text.isascii() or not replaceable(text):
        return text, None
    chars, places = [], []
    for at, char in enumerate(text):
        plain = TABLE.get(ord(char), char)
        chars.append(plain)
        places += [at] * len(plain)
    return "".join(chars), [*places, len(text)]


@functools.lru_cache(maxsize=2)
def frequent_words(vocabulary: str = VOCABULARY) -> tuple[frozenset[str], frozenset[str]]:
    """Words of at least four letters that a public vocabulary holds in small letters, and those it holds with a capital only."""
    tokens = [t[1:].decode() for t in read_ranks(vocabulary) if t[:1] == b" " and len(t) > 4 and t[1:].isalpha()]
    lower = frozenset(t for t in tokens if t.islower())
    return lower, frozenset(w for t in tokens if t.istitle() and (w := t.lower()) not in lower)


class Lists(NamedTuple):
    """Words that a reading of the texts rests on, beside the fixed ones."""

    given: frozenset[str]
    common: frozenset[str]
    endings: frozenset[str] = frozenset()
    familiar: frozenset[str] = frozenset()
    lower: frozenset[str] = frozenset()
    capital: frozenset[str] = frozenset()


class _Rows(dict):
    """Row number of each distinct token; a token that is met first gets its row."""

    def __init__(self, lists: Lists):
        super().__init__()
        self.lists, self.rows, self.flags = lists, [], []
        self.table, self.bits = np.zeros((0, len(_COLUMNS)), np.int64), np.zeros(0, np.int64)

    def __missing__(self, token: str) -> int:
        row, flags = self._describe(token)
        self[token] = at = len(self.rows)
        self.rows.append(row)
        self.flags.append(flags)
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int64).reshape(-1, len(_COLUMNS))])
            self.bits = np.concatenate([self.bits, np.array(self.flags[len(self.bits) :], np.int64)])
        return self.table, self.bits

    @staticmethod
    def _lead(digits: str) -> int:
        """How a run of digits begins: by the prefixes of dialling, or as a whole number of North America."""
        return 3 if digits.startswith("00") else 1 if digits[0] == "0" else 2 if re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", digits) else 0

    def _describe(self, token: str) -> tuple[tuple[int, ...], int]:
        if token == "\x00":
            return (_END, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 0
        if token.isspace():
            return (_SPACE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 0
        flag = lambda *names: sum(1 << _FLAGS.index(n) for n in names)
        if token[0].isdigit() or token.isdecimal():
            n = min(len(token), 14)
            return (_DIGITS, n, 0, 0, n, min(n, 7), 0, 0, 0, self._lead(token), len(token)), 0
        if not token[0].isalpha():
            sign = unicodedata.normalize("NFKC", token)[:1] or token
            sign = "-" if unicodedata.category(token[0]) == "Pd" else "'" if sign in "’‘`´" else sign
            at = _SIGNS.find(sign) + 1
            roles = [n for n, held in (("at", "@"), ("dot", "."), ("bracket", "()[]{}<>")) if sign in held]
            return (_SIGN, 1, 0, 0, 20 + at, 40 + at, 0, 0, 0, at + 1, 0), flag(*roles)
        word = unicodedata.normalize("NFC", token)
        lower = word.lower()
        case = 4 if len(word) == 1 else 0 if word.islower() else 2 if word.isupper() else 1 if word.istitle() else 3
        lists = self.lists
        common = lower in lists.common
        known = 3 if common else 2 if lower in lists.lower else 1 if lower in lists.capital else 0
        roles = [n for n, held in W.ROLES.items() if lower in held]
        if any(lower.endswith(s) and len(lower) > len(s) + 2 for s in W.STREET_ENDINGS):
            roles.append("street")
        given = lower in lists.given
        if len(lower) > ENDING and lower[-ENDING:] in lists.endings and lower not in lists.lower:
            roles.append("usual")
        if lower in lists.familiar:
            roles.append("familiar")
        role = next((k for k, n in enumerate(("street", "prefix", "unit", "number", "particle", "title", "region", "at", "dot", "extension")) if n in roles), None)
        shape = 8 + role * 2 + (case == 1) if role is not None else 28 + given * 4 + (known > 1) * 2 + (case == 1) if len(word) > 1 else 36
        end = [hash_of(lower[-n:]) if len(lower) > n else 0 for n in (1, 2, 3)]
        return (_LETTERS, min(len(lower), 12), case, given * 4 + known, 14 + min(len(word), 5), shape, *end, 0, 0), flag(*roles, *(["given"] if given else []), *(["common"] if common else []))


def hash_of(text: str) -> int:
    """A number below 2^20 that every process gives the same text."""
    out = 0
    for char in text:
        out = (out * 1_000_003 + ord(char)) & 0xFFFFFFFF
    return (out ^ out >> 12) & 0xFFFFF


class Batch:
    """The tokens of some texts as arrays, and sums of their flags from the beginning on."""

    def __init__(self, texts: list[str], rows: _Rows, change=None):
        whole = _EDGE + _EDGE.join(texts) + _EDGE
        tokens = _TOKENS.findall(whole)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        number = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
        table, bits = rows.arrays()
        starts = np.cumsum(lengths) - lengths
        kept = table[number, 0] != _SPACE
        spaced = np.append(False, ~kept[:-1])[kept]
        self.number, self.start, self.length = number[kept], starts[kept], lengths[kept]
        self.token = [tokens[k] for k in np.flatnonzero(kept)] if change else None
        self.spaced = spaced.astype(np.int64)
        self.col = {name: table[self.number, k] for k, name in enumerate(_COLUMNS)}
        self.bits = bits[self.number]
        # the place of each text's first character in the whole
        self.origin = np.cumsum([len(_EDGE), *(len(t) + len(_EDGE) for t in texts)])[:-1]
        self.text_of = np.searchsorted(self.origin, self.start, side="right") - 1
        if change:
            change(self)
        self._finish()

    def flag(self, name: str) -> np.ndarray:
        return (self.bits >> _FLAGS.index(name)) & 1

    def _finish(self) -> None:
        col, n = self.col, len(self.number)
        kind, sign = col["type"], col["sign"]
        edge = kind == _END
        letters, digits = kind == _LETTERS, kind == _DIGITS
        word = letters & (col["length"] > 1)
        number = self.flag("number") == 1
        signs = lambda chars: np.isin(sign, [_SIGNS.find(c) + 2 for c in chars]) & (kind == _SIGN)
        at_dot = (self.flag("at") | self.flag("dot")) == 1
        bracket = self.flag("bracket") == 1
        joint = at_dot | bracket
        shifted = lambda x: np.append(False, x[:-1])
        spaced = self.spaced == 1
        case = col["case"]
        # a text's letter case as a whole: mixed, all small, all capital
        owner = np.maximum(self.text_of, 0)
        count = len(self.origin)
        capital = np.bincount(owner[letters], weights=(case[letters] % 4 == 2) * 1.0, minlength=count)
        small = np.bincount(owner[letters], weights=(case[letters] == 0) * 1.0, minlength=count)
        total = np.bincount(owner[letters], minlength=count)
        mood = np.where(small == total, 1, np.where((capital >= 0.8 * total) & (total > 1), 2, 0))
        self.mood = mood[owner]
        attached = (letters & (col["length"] <= 4)) & ((case % 4 == 2) | (case == 4) | (~np.append(spaced[1:], True) & np.append(digits[1:], False)) | (~spaced & shifted(digits)))
        # a full stop right after a word or number and before a blank ends a sentence, but not after an abbreviation
        short = letters & ((case == 4) | (self.flag("abbreviation") == 1))
        stop = shifted(signs(".") & ~spaced & ~shifted(short))
        sums = {
            "email_bad": ~(letters | digits | joint | signs("_-+")), "email_gap": spaced & (~(joint | shifted(joint)) | stop),
            "number_bad": ~(digits | number | attached | (self.flag("extension") == 1) | signs("+-./(),")), "number_gap": spaced & stop,
            "address_bad": ~(letters | digits | signs(",-'/#°ªº&") | (signs(".") & shifted(short))),
            "name_bad": ~(letters | (signs(".") & shifted(short) & ~spaced) | (signs("-'") & ~spaced)),
            "letters": letters, "word": word, "digit_run": digits, "house": digits & ~(~spaced & shifted(letters)), "units": np.where(number, 1, col["digits"]), "spaced": spaced, "comma": signs(","), "spaced_letters": letters & spaced, "low": letters & (case == 0), "new": letters & (col["known"] % 4 < 2), "common": letters & (col["known"] % 4 == 3), "paren": signs("("), "close": signs(")"),
            **{f"sign {c}": signs(c) for c in "+-./"}, **{f: self.flag(f) == 1 for f in ("at", "dot", "phone_cue", "id_cue", "code_cue", "place_cue", "name_cue", "number", "street", "prefix", "unit", "particle", "extension", "region", "usual", "given")},
        }
        self.sums = {k: np.concatenate(([0], np.cumsum(v, dtype=np.int64))) for k, v in sums.items()}
        tight = ~spaced
        wordy = letters | digits | signs("_-+@")
        self.masks = {
            "letters": letters, "digits": digits, "word": word, "number": number, "edge": edge, "email_first": letters | digits | signs("_"), "email_last": letters & (col["length"] > 1), "number_first": digits | number | attached | signs("+("),
            "number_last": digits | number | attached, "address_first": digits | letters, "address_last": digits | letters | signs("ªº"),
        }
        # what stands before and after each token: its class, and whether it touches
        look = np.where(edge, 1, np.where(digits, 2, np.where(kind == _SIGN, 16 + sign, 3 + np.minimum(col["known"], 7))))
        self.look = look
        pad = lambda x, k: np.roll(x, k)
        self.before, self.after = pad(look, 1), pad(look, -1)
        self.before2, self.after2 = pad(look, 2), pad(look, -2)
        # whether the text goes on, without a blank, before and after the token
        self.runs_on_left = tight & pad(wordy, 1) | tight & pad(signs("./"), 1) & pad(tight, 1) & pad(letters | digits, 2)
        after_tight = pad(tight, -1)
        self.runs_on_right = after_tight & pad(wordy, -1) | after_tight & pad(signs("./:"), -1) & pad(tight, -2) & pad(letters | digits, -2)
        self.next_spaced = pad(self.spaced, -1)
        self.n = n
        # the place after each text's last token
        self.stop = np.zeros(count, np.int64)
        inner = np.flatnonzero(~edge)
        np.maximum.at(self.stop, owner[inner], inner + 1)

    def spans(self, kind: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last token and shape of every span of the kind that begins at a token from low on and below high."""
        s, m, n = self.sums, self.masks, self.n
        begin = np.arange(low, high)
        shape = self.col["word_shape" if kind in ("address", "name") else "number_shape"].astype(np.uint64)
        if kind == "email":
            begin = begin[m["email_first"][begin]]
        elif kind in ("phone", "id_number"):
            begin = begin[m["number_first"][begin]]
        elif kind == "address":
            begin = begin[m["address_first"][begin]]
        else:
            begin = begin[m["word"][begin]]
        rolled = shape[begin] + np.uint64(7)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = begin
        for size in range(1, LONGEST[kind] + 1):
            if size > 1:
                fine = last + 1 < n
                begin, last, rolled = begin[fine], last[fine] + 1, rolled[fine]
                # a span with a token that the kind can't hold can't grow either
                bad = {"email": "email_bad", "phone": "number_bad", "id_number": "number_bad", "address": "address_bad", "name": "name_bad"}[kind]
                fine = s[bad][last + 1] == s[bad][last]
                if (gap := {"email": "email_gap", "phone": "number_gap", "id_number": "number_gap"}.get(kind)) is not None:
                    fine &= s[gap][last + 1] == s[gap][last]
                begin, last, rolled = begin[fine], last[fine], rolled[fine]
                if not len(begin):
                    break
                rolled = rolled * np.uint64(1_000_003) + shape[last] * np.uint64(2) + self.spaced[last].astype(np.uint64)
            elif kind in ("email", "name"):
                continue
            count = lambda name: s[name][last + 1] - s[name][begin]  # noqa: B023, E731
            if kind == "email":
                held = m["email_last"][last] & (count("at") > 0) & (count("dot") > 0)
            elif kind in ("phone", "id_number"):
                units = count("units")
                held = m["number_last"][last] & (units >= 5) & (units <= 22)
            elif kind == "address":
                held = m["address_last"][last] & (count("house") + count("number") > 0) & (count("word") > 0) & (count("digit_run") <= 5)
            else:
                held = m["word"][last] & (count("word") > 1) & (count("spaced_letters") > self.spaced[begin])
            if held.any():
                out.append((begin[held], last[held], rolled[held]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def features(self, kind: str, i: np.ndarray, j: np.ndarray, shape: np.ndarray) -> list[np.ndarray]:
        """Codes of the features of the spans, one array for each template."""
        s, c = self.sums, self.col
        count = lambda name: s[name][j + 1] - s[name][i]
        near = lambda name, w: np.minimum(s[name][i] - s[name][np.maximum(i - w, 0)], 1)
        ahead = lambda name, w: np.minimum(s[name][np.minimum(j + 1 + w, self.n)] - s[name][j + 1], 1)
        few = lambda x, k: np.minimum(x, k)
        ends = self.runs_on_left[i] * 2 + self.runs_on_right[j]
        alone = (self.before[i] == 1) * 2 + (self.after[j] == 1)
        size = few(j - i, 20)
        if kind == "email":
            style = few(count("sign ."), 1) * 2 + few(count("paren"), 1)
            return [size * 0, style, shape, ends, ends * 4 + style, few(count("at"), 3) * 8 + few(count("dot"), 5), few(count("spaced") - self.spaced[i], 4), self.before[i], c["known"][i], c["known"][i] * 8 + few(count("spaced") - self.spaced[i], 4), alone, few(count("digit_run"), 3)]
        if kind in ("phone", "id_number"):
            digits = few(count("units"), 22)
            first = np.where(self.masks["digits"][i], 1 + c["sign"][i], np.where(self.masks["letters"][i], 5, 6 + c["sign"][i]))
            joins = sum(few(count(f"sign {x}"), 1) << k for k, x in enumerate("+-./")) + few(count("paren"), 1) * 16 + few(count("spaced") - self.spaced[i], 1) * 32
            open_ = (count("paren") != count("close")) * 1
            words = few(count("number"), 9)
            letters = few(count("letters"), 4)
            cue = near("phone_cue", 4) + 2 * near("id_cue", 5) + 4 * near("code_cue", 4)
            closest = near("phone_cue", 2) + 2 * near("id_cue", 2) + 4 * near("code_cue", 2)
            later = ahead("phone_cue", 2) + 2 * ahead("id_cue", 2) + 4 * ahead("code_cue", 2)
            groups = few(count("digit_run"), 8)
            touching = (self.before[i] == 2) * 2 + (self.after[j] == 2)
            numbers = (words > 0) * 1
            return [size * 0, shape, digits * 32 + first, digits * 16 + groups, joins * 32 + digits, first * 64 + joins, ends, touching * 4 + ends, open_, letters * 32 + digits, cue, closest, later, cue * 32 + digits, cue * 64 + later * 8 + closest, self.before[i] * 2 + numbers, self.after[j], words * 16 + few(digits, 15), c["type"][j] * 8 + letters, alone, alone * 32 + digits, cue * 64 + first, few(count("extension"), 1) * 2 + (letters > 0), shape * np.uint64(8) + cue.astype(np.uint64)]
        if kind == "address":
            words, low = few(count("word"), 8), few(count("low"), 5)
            street, prefix, unit = few(count("street"), 2), few(count("prefix"), 1), few(count("unit"), 2)
            base = street * 4 + prefix * 2 + (unit > 0)
            first, last = c["word_shape"][i], c["word_shape"][j]
            before_street = np.where(street > 0, 1, 0) * (s["street"][j + 1] > s["street"][j])
            mood = self.mood[i]
            commons, news = few(count("common"), 4), few(count("new"), 5)
            commas = few(count("comma"), 3)
            onward = c["word_shape"][np.minimum(j + 1, self.n - 1)] * 2 + self.next_spaced[j]
            cue, code = near("place_cue", 3), near("code_cue", 2)
            runs = few(count("digit_run"), 4)
            return [size * 0, shape, base * 8 + words, base * 64 + first, base * 64 + last, (base * 8 + low) * 3 + mood, (base * 8 + commons) * 3 + mood, (base * 8 + news), base * 4 + commas, first * 64 + last, ends, onward * 3 + base.clip(0, 2), onward * 4 + commas, self.before[i] * 32 + base, cue * 32 + base, code * 32 + base, few(c["length"][i], 7) * 32 + base, runs * 32 + base, before_street * 2 + cue, alone * 32 + base, (commas * 64 + last) * 3 + mood, few(count("region"), 2) * 8 + commas, c["known"][j] * 16 + commas * 4 + c["case"][j], (c["known"][j] * 8 + c["case"][j]) * 8 + c["known"][np.minimum(j + 1, self.n - 1)], first * 4 + c["case"][np.minimum(i + 1, self.n - 1)]]
        f, g = c["known"][i], c["known"][j]
        cf, cg, mood = c["case"][i], c["case"][j], self.mood[i]
        listed = f // 4
        words = few(count("word"), 5)
        cases = (cf * 5 + cg) * 3 + mood
        usual = self.flag("usual")[j] * 2 + self.flag("usual")[i]
        familiar = self.flag("familiar")[j]
        cue = near("name_cue", 3) + 2 * near("name_cue", 1)
        middle = few(count("common") - self.flag("common")[i] - self.flag("common")[j], 2)
        roles = self.flag("street")[j] + 2 * self.flag("unit")[j] + 4 * self.flag("title")[i] + 8 * self.flag("particle")[j] + 16 * self.flag("number")[i] + 32 * self.flag("region")[j]
        context = self.before[i] * 64 + self.after[j]
        return [words, f, g, f * 8 + g, (f * 8 + g) * 80 + cases, cases, shape, c["end1"][j] * 2 + listed, c["end2"][j] * 2 + listed, c["end3"][j] * 2 + listed, c["end2"][i] * 2 + listed, (usual * 8 + f) * 80 + cases, (usual * 8 + f) * 8 + g, self.before[i] * 8 + f, self.after[j] * 8 + g, self.after[j] * 8 + f, cue * 64 + f * 8 + g, cue * 80 + cases, c["length"][j] * 8 + g, middle * 8 + words, ends, alone * 64 + f * 8 + g, (alone * 80 + cases) * 8 + f, (self.before[i] * 5 + c["case"][np.maximum(i - 1, 0)]) * 8 + f, ((self.after[j] * 5 + c["case"][np.minimum(j + 1, self.n - 1)]) * 8 + g) * 3 + mood, roles * 8 + f, context, words * 64 + f * 8 + g, c["length"][i] * 8 + f, few(count("usual"), 2) * 16 + cue * 4 + alone, familiar * 64 + f * 8 + g, familiar * 80 + cases]

    def placed(self, kind: str, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Places of the features in the weight table."""
        number = KINDS.index(kind) * 64
        shift = np.uint64(64 - BITS)
        return [((code.astype(np.uint64) * np.uint64(512) + np.uint64(number + k)) * _MIX >> shift).astype(np.int32) for k, code in enumerate(codes)]


def scored(batch: Batch, model: Model, block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token, last token, kind from 1 and score of every span that the best reading may hold."""
    follow = model.follow
    gain = [(follow[:, k] - follow[:, 0]).max() + (follow[k, :] - follow[0, :]).max() for k in range(len(KINDS) + 1)]
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, batch.n, block):
        for k, kind in enumerate(KINDS, 1):
            i, j, shape = batch.spans(kind, low, min(batch.n, low + block))
            if not len(i):
                continue
            score = np.zeros(len(i))
            for place in batch.placed(kind, batch.features(kind, i, j, shape)):
                score += model.weights[place]
            held = score + gain[k] > 0
            out.append((i[held], j[held], np.full(int(held.sum()), k), score[held]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def decode(spans: list[tuple[int, int, int, float]], follow: np.ndarray, end: int) -> list[tuple[int, int, int]]:
    """The best reading: disjoint spans (first, last, kind) of greatest sum of scores and of scores of what follows what.

    spans: (first token, last token, kind, score); tokens outside spans score 0. ``end``: the place after the last token.
    """
    points = sorted({p for a, b, _, _ in spans for p in (a, b + 1)})
    ending: dict[int, list[int]] = {}
    for n, (_, b, _, _) in enumerate(spans):
        ending.setdefault(b + 1, []).append(n)
    # best[p][k]: the best reading up to p that ends in kind k, and its last span
    best: dict[int, dict[int, tuple[float, int | None, int]]] = {}
    outside: tuple[float, int | None, int] = (0.0, None, 0)
    for n_point, p in enumerate(points):
        here: dict[int, tuple[float, int | None, int]] = {0: outside}
        for n in ending.get(p, ()):
            a, _, k, score = spans[n]
            value, back = max(((v[0] + follow[prev, k], prev) for prev, v in best[a].items()), key=lambda x: x[0])
            total = value + score
            if k not in here or total > here[k][0]:
                here[k] = (total, n, back)
        best[p] = here
        if n_point + 1 < len(points):
            # at least one token outside leads on, unless a span begins here
            top = max(here.items(), key=lambda x: x[1][0] + (follow[x[0], 0] if x[0] else 0.0))
            outside = (top[1][0] + (follow[top[0], 0] if top[0] else 0.0), None, p * 8 + top[0])
    last = max(best[points[-1]].items(), key=lambda x: x[1][0] + (follow[x[0], 0] if x[0] and points[-1] < end else 0.0))
    out, p, k = [], points[-1], last[0]
    while True:
        _, n, back = best[p][k]
        if k:
            a, b, kind, _ = spans[n]
            out.append((a, b, kind))
            p, k = a, back
        elif back == 0 and p == points[0]:
            return out[::-1]
        else:
            p, k = divmod(back, 8)


class Finder:
    """Finds spans in texts; keeps the rows of the tokens that it met."""

    def __init__(self, given: Iterable[str], model: Model, endings: Iterable[str] = (), common: Iterable[str] = (), familiar: Iterable[str] = (), vocabulary: str = VOCABULARY):
        self.lists = Lists(W.GIVEN.union(w.lower() for w in given if w), W.COMMON.union(common), frozenset(endings), frozenset(familiar), *frequent_words(vocabulary))
        self.model = model
        self.rows = _Rows(self.lists)

    def find_all(self, texts: list[str | None], most: int = 300_000) -> list[tuple[Span, ...]]:
        """The spans of each text as stored; texts are read together up to ``most`` characters."""
        out: list[tuple[Span, ...]] = [()] * len(texts)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < most):
                chars += len(texts[end] or "")
                end += 1
            picked = [k for k in range(at, end) if texts[k]]
            self._find(texts, picked, out)
            at = end
        return out

    def _find(self, texts: list[str | None], picked: list[int], out: list[tuple[Span, ...]]) -> None:
        if not picked:
            return
        if len(self.rows) > 500_000:
            self.rows = _Rows(self.lists)
        folded = [fold(texts[k]) for k in picked]
        batch = Batch([f for f, _ in folded], self.rows)
        i, j, kind, score = scored(batch, self.model)
        if not len(i):
            return
        owner = batch.text_of[i]
        order = np.lexsort((j, i, owner))
        i, j, kind, score, owner = (x[order] for x in (i, j, kind, score, owner))
        bounds = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        first, stop = batch.start, batch.start + batch.length
        for a, b in zip(bounds, [*bounds[1:], len(i)], strict=True):
            found = decode(list(zip(i[a:b].tolist(), j[a:b].tolist(), kind[a:b].tolist(), score[a:b].tolist(), strict=True)), self.model.follow, int(batch.stop[owner[a]]))
            if not found:
                continue
            k = int(owner[a])
            origin, places = int(batch.origin[k]), folded[k][1]
            spans = [(int(first[x]) - origin, int(stop[y]) - origin, KINDS[n - 1]) for x, y, n in found]
            if places is not None:
                spans = [(places[x], places[y - 1] + 1, n) for x, y, n in spans]
            out[picked[k]] = tuple(Span(*x) for x in spans)

    def find(self, text: str | None) -> tuple[Span, ...]:
        return self.find_all([text])[0]

    def redact(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with placeholders, and the kinds that occur."""
        return redacted(text, self.find(text))


def redacted(text: str | None, spans: Iterable[Span]) -> tuple[str | None, list[str]]:
    if not spans:
        return text, []
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]]), sorted({k for _, _, k in spans})


def word_habits(df: DataFrame, names: list[str], columns: tuple[str, ...], vocabulary: str = VOCABULARY) -> tuple[list[str], list[str], list[str]]:
    """What the texts at hand tell of their words, counted over all rows: endings, common words, familiar words.

    Endings: of words outside the vocabulary that follow a given name at least five times and in at least three of ten of
    their occurrences. Familiar: words that occur twenty times or more, and seldom after a given name. Common: familiar
    words that come mostly in small letters. Only the most frequent ``MOST_ENDINGS`` and ``MOST_FREQUENT`` are collected.
    """
    held = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = W.GIVEN.union(w.lower() for w in held.value if w)
        plain = frequent_words(vocabulary)[0] | W.COMMON
        find = re.compile(r"[^\W\d_]+").findall
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for column in batch.columns:
                for text in column.to_pylist():
                    if text:
                        count_habits(text, find, given, counts)
            rows = list(counts.values())
            numbers = {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(_HABITS)}
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), **numbers, "plain": pa.array([w in plain for w in counts], pa.bool_())})

    schema = "word string, " + "".join(f"{n} long, " for n in _HABITS) + "plain boolean"
    counts = df.select(*(F.col(c).cast("string") for c in columns)).mapInArrow(run, schema)
    words = checkpointed(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in _HABITS), F.max("plain").alias("plain")))
    ending = words.where((F.length("word") > ENDING) & ~F.col("plain")).groupBy(F.right("word", F.lit(ENDING)).alias("ending")).agg(F.sum("after").alias("after"), F.sum("whole").alias("whole"))
    usual = ending.where((F.col("after") >= 5) & (F.col("after") >= 0.3 * F.col("whole"))).orderBy(F.desc("after"), "ending").limit(MOST_ENDINGS)
    familiar = words.where((F.col("whole") >= 20) & (F.col("after") < 0.2 * F.col("whole"))).orderBy(F.desc("whole"), "word").limit(MOST_FREQUENT)
    rows = familiar.select("word", (F.col("small") >= F.greatest(F.lit(1), 0.5 * F.col("told"))).alias("common")).collect()
    return [r[0] for r in usual.select("ending").collect()], [r["word"] for r in rows if r["common"]], [r["word"] for r in rows]


#: Counts of a word: all; those in texts of both letter cases; of these, in small letters; after a given name.
_HABITS = ("whole", "told", "small", "after")


def count_habits(text: str, find, given: frozenset[str], counts: dict[str, list[int]]) -> None:
    after = False
    # a text in capitals, or in small letters only, tells nothing of a word's habit
    tells = not text.isupper() and not text.islower()
    for word in find(text):
        lower = word.lower()
        if len(word) > 1:
            row = counts.get(lower)
            if row is None:
                row = counts[lower] = [0, 0, 0, 0]
            row[0] += 1
            row[3] += after
            if tells:
                row[1] += 1
                row[2] += word == lower
        after = lower in given


def redact_columns(df: DataFrame, given_names: DataFrame | None, columns: tuple[str, ...] = ("text", "author"), most_names: int = 200_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with each column redacted and, per column, ``<column>_kinds``: the sorted kinds found in it.

    Null and empty values stay as they are, with no kinds; text outside the spans is unchanged. ``given_names`` (column
    ``word``) is read up to ``most_names`` words, which bounds what is broadcast; more raise an error. Columns named like
    the new ones raise an error.
    """
    from murmur.llm.pii_training import fit

    spark = df.sparkSession
    names = [r[0] for r in given_names.select("word").distinct().limit(most_names + 1).collect()] if given_names is not None else []
    if len(names) > most_names:
        raise ValueError(f"more than {most_names} given names")
    if clash := {f"{c}_kinds" for c in columns} & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    finder = spark.sparkContext.broadcast((names, fit(vocabulary=vocabulary), *word_habits(df, names, columns, vocabulary), vocabulary))
    kinds = T.ArrayType(T.StringType(), False)
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name in columns else f for f in df.schema.fields), *(T.StructField(f"{c}_kinds", kinds) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(*finder.value)
        for batch in batches:
            arrays = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            more = []
            for c in columns:
                texts = arrays[c].to_pylist()
                done = [redacted(t, s) for t, s in zip(texts, find.find_all(texts), strict=True)]
                arrays[c] = pa.array([t for t, _ in done], pa.string())
                more.append(pa.array([k for _, k in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*arrays.values(), *more], names=schema.names)

    return df.withColumns({c: F.col(c).cast("string") for c in columns}).mapInArrow(run, schema)


def _labelled(column: str):
    """The column's name beside a kind. A closure, as a second parameter of a lambda would be the place in the array."""
    return lambda kind: F.struct(F.lit(column).alias("field"), kind.alias("kind"))


def personal_information(df: DataFrame, given_names: DataFrame | None, id_col: str = "row_id", columns: tuple[str, ...] = ("text", "author")) -> DataFrame:
    """(id_col, field, kind): one row for each column and kind that occurs in it, however often."""
    found = redact_columns(df.select(id_col, *columns), given_names, columns)
    pairs = F.concat(*(F.transform(F.col(f"{c}_kinds"), _labelled(c)) for c in columns))
    return found.select(id_col, F.inline(pairs))
