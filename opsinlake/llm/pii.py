"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

Tokens are runs of characters that are not blanks, without leading and trailing punctuation. The field labels every token of every line
as outside or as one of ``TAGS``; its weights are trained on the driver from a small labelled table (``EXAMPLES``, a few
templates filled by rule), and its Viterbi decoding runs in numpy over all lines of an Arrow batch at once. Spans of
the field that touch no pattern span are added; pattern spans always stay.

No span crosses the end of a line, and a line of ordinary words has none: no pattern can match there, and the weights
leave every word outside (``Field.quiet``). One regular expression finds the other lines, and only they are decoded,
between the words that are outside whatever stands beside them (``decode``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.words import Words, blocks, mix, offsets, split_words, utf8, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: The patterns are matched without rescanning long runs: an ip starts at the start of a run of digits (its first part
#: cannot match from the middle of one), and an email is sought around each @.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TAGS = ("O", "email", "ip", "card", "phone", "secret")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    if kind in ("card", "phone"):
        digits = "".join(_DIGIT.findall(found))
        return (16 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 8 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters, by kind as listed, then start."""
    out = _emails(text)
    if _DIGIT.search(text):
        for kind, pattern in PATTERNS.items():
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


# ------------------------------------------------------------------ the field

_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'.,;:!?()[]{}<>")] = True
_CLASS = np.full(256, 3, np.int8)  # 0 digit, 1 capital, 2 other letter (any byte beyond ASCII is one), 3 the rest
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 0, 1, 2, 2
_HEAD = np.ones(256, bool)  # bytes that begin a character
_HEAD[0x80:0xC0] = False
_FORM = bytes(b"9Aa"[k] if k < 3 else c for c, k in enumerate(_CLASS.tolist()))
_RUNS = re.compile(rb"9+|A+|a+")
_HEX = re.compile(rb"[0-9a-f]{12,}")
_CUES = (b"password", b"token", b"key", b"secret", b"pwd", b"tel", b"phone", b"call", b"card", b"ip", b"mail")
#: Found (in bytes) in every line that has more than words of letters below ``_LONG`` bytes, none of them a cue, with punctuation around them.
_LONG = 20
_LETTER, _MARK = rb"A-Za-z\x80-\xff", rb"\"'.,;:!?()\[\]{}<>"
_ODD = b"|".join([
    rb"[^%b%b \t-\r]" % (_LETTER, _MARK),
    rb"[%b][%b]+[%b]" % (_LETTER, _MARK, _LETTER),
    rb"[^ \t-\r]{%d}" % _LONG,
    rb"(?i:\b(?:%b)\b)" % b"|".join(_CUES),
])
LABELLED_LINES = 600
EPOCHS = 10


def form(word: bytes) -> tuple[bytes, bool, bytes]:
    """All that the features look at: the classes of all bytes (9, A, a or the byte itself), whether the word is
    a hexadecimal number, and the word if it is a cue. Words of one form have the same features."""
    classes = word.translate(_FORM)
    cue = word.lower() if len(word) <= 8 and word.lower() in _CUES else b""
    return classes, b"9" in classes and _HEX.fullmatch(word) is not None, cue


def features(classes: bytes, is_hex: bool, cue: bytes) -> list[str]:
    """What a word shows of itself; the context adds the same of its neighbours."""
    digits, letters = classes.count(b"9"), classes.count(b"A") + classes.count(b"a")
    shape = _RUNS.sub(lambda m: b"9%d" % min(len(m.group()), 20) if m.group()[:1] == b"9" else m.group()[:1], classes).decode()
    if letters == len(classes) and shape not in ("a", "A") and not re.fullmatch(rb"Aa+", classes):
        shape = "mix"
    out = [f"s={shape}", f"d={min(digits, 20)}", f"len={min(len(classes), 24) // 4}"]
    if letters < len(classes):
        out += [f"has{c}" for c in "@+.-()=_/:" if ord(c) in classes]
        if digits and letters:
            out.append("mixed")
        if is_hex:
            out.append("hex")
        if re.fullmatch(rb"\(?9{2,4}\)?", classes):
            out.append("group")
        if re.fullmatch(rb"9[9().-]*", classes):
            out.append("numeric")
        if len(classes) >= 16 and letters + digits == len(classes):
            out.append("long")
    if cue:
        out.append(f"cue={cue.decode()}")
    return out


def _trimmed(w: Words) -> Words:
    """The same words without punctuation at their ends. A word of punctuation only becomes empty."""
    n = len(w.data)
    solid = ~_EDGE[w.data]
    ahead = np.minimum.accumulate(np.where(solid, np.arange(n), n)[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(solid, np.arange(n), -1)) + 1
    start, end = ahead[w.start], behind[w.end - 1]
    empty = start >= w.end
    return w._replace(start=np.where(empty, w.start, start), end=np.where(empty, w.start, end))


def codes(w: Words) -> tuple[np.ndarray, list[bytes]]:
    """(code of every word, a word for each code). Words of letters that are no cue share a code by shape and length, for
    their features are the same; other words have a code of their own."""
    count = {k: np.concatenate([[0], np.cumsum(_CLASS[w.data] == k, dtype=np.int32)]) for k in (1, 2)}
    upper, lower = (count[k][w.end] - count[k][w.start] for k in (1, 2))
    size = w.end - w.start
    plain = (upper + lower == size) & (size > 0)
    cues = pa.array([c for cue in _CUES for c in (cue, cue.upper(), cue.capitalize())])
    cue = np.isin(word_hashes(w), word_hashes(split_words(cues.cast(pa.string()).cast(pa.large_string()))))
    plain &= ~cue
    first = np.zeros(len(size), bool)
    first[size > 0] = _CLASS[w.data[w.start[size > 0]]] == 1
    letter_form = np.where(upper == 0, 0, np.where(lower == 0, 1, np.where(first & (upper == 1), 2, 3)))
    code = np.minimum(size, 24) // 4 * 4 + letter_form
    words = [_stand_in(i // 4, i % 4) for i in range(28)]
    known: dict[bytes, int] = {}
    odd = np.flatnonzero(~plain)
    data = w.data.tobytes()
    code[odd] = [known.setdefault(data[a:b], 28 + len(known)) for a, b in zip(w.start[odd].tolist(), w.end[odd].tolist())]
    return code, words + list(known)


def _stand_in(length: int, letters: int) -> bytes:
    n = max(4 * length, 1 if letters < 2 else 2)
    return (b"a" * n, b"A" * n, b"A" + b"a" * (n - 1), b"aA" + b"a" * (n - 2))[letters]


def examples(n: int = LABELLED_LINES) -> list[tuple[list[str], list[int]]]:
    """The labelled table: ``n`` lines, filled from hashed numbers, as (tokens, tags)."""
    state = mix(np.arange(1, n * 500 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = iter((state >> np.uint64(20)).tolist())
    draw = lambda k: next(at) % k
    plain = lambda: "".join("aeiorstnlhdém"[draw(13)] for _ in range(2 + draw(8)))
    number = lambda k: "".join(str(draw(10)) for _ in range(k))
    hexa = lambda k: "".join("0123456789abcdef"[draw(16)] for _ in range(k))
    upper = lambda k: "".join("ABCDEFGHJKLMNPQRSTUVWXYZ234567"[draw(30)] for _ in range(k))
    cut = lambda: ("", " ", "-")[draw(3)]

    def item() -> list[tuple[str, str]]:
        kind = draw(16)
        if kind < 3:
            return [(f"{plain()}.{number(2)}@{plain()}.example.com", "email")]
        if kind < 5:
            return [(".".join(str(draw(256)) for _ in range(4)), "ip")]
        if kind == 5:
            s = cut()
            return [(w, "card") for w in s.join(number(4) for _ in range(4)).split(" ")]
        if kind < 8:
            return [(w, "phone") for w in f"+{1 + draw(98)} ({number(3)}) {number(3)}-{number(4)}".split(" ")]
        if kind == 8:
            return [(w, "phone") for w in f"({number(3)}) {number(3)}-{number(4)}".split(" ")]
        if kind == 9:
            return [(f"{number(3)}-{number(3)}-{number(4)}", "phone")]
        if kind == 10:
            return [(f"password={hexa(12 + draw(20))}", "secret")]
        if kind == 11:
            return [("token", "O"), ("=", "O"), (hexa(32 + draw(32)), "secret")]
        if kind == 12:
            return [(f"AKIA{upper(16)}", "secret")]
        if kind == 13:
            mark = ("***", "###", "%%%", "$$$", "&&&", "!!", "/x", "...a")[draw(8)]
            return [(f"{plain()}{('', '.', ',')[draw(3)]}{mark}", "O"), (("|", "-", plain().upper())[draw(3)], "O"), (f"{plain()}.{plain()}", "O")]
        return [((number(1 + draw(5)), f"v{draw(9)}.{draw(20)}", f"{1900 + draw(130)}", f"{number(2)}%", f"{draw(9)}.{draw(9)}", "+", f"{plain()}-{plain()}", "BY-NC", number(1))[draw(9)], "O")]

    out = []
    for _ in range(n):
        tokens: list[tuple[str, str]] = []
        for _ in range(1 + draw(3)):
            tokens += [(plain(), "O") for _ in range(draw(5))] + item()
        tokens += [(plain(), "O") for _ in range(draw(4))]
        out.append(([w for w, _ in tokens], [TAGS.index(t) for _, t in tokens]))
    return out


class Field:
    """Weights of a linear-chain field: emissions from the features of the previous, own and next word, transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves  # weights: 3 x features x tags
        self.known: dict[tuple[bytes, bool, bytes], np.ndarray] = {}
        self.quiet = self._quiet()

    def _quiet(self) -> bool:
        """Whether every word of a line without ``_ODD`` is surely outside, by the scores of all such words side by side."""
        before, own, after = self.word_scores([b"", *(_stand_in(i // 4, i % 4) for i in range(_LONG))])  # the last word is the end of a line
        return bool(self.surely_outside(before[:, None, None] + own[None, :-1, None] + after[None, None, :]).all())

    def surely_outside(self, scores: np.ndarray) -> np.ndarray:
        """Words that are outside on the best path whatever the tags of their neighbours: outside is worth more than any other
        tag, and by more than the moves to that tag and from it can make up for (no move is made at the ends of a line)."""
        to, back = (self.moves - self.moves[:, :1]).max(axis=0), (self.moves - self.moves[:1]).max(axis=1)
        other = scores + np.maximum(to, 0) + np.maximum(back, 0) + 0.01  # for rounding
        return (scores[..., :1] > other)[..., 1:].all(axis=-1)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """3 x words x tags: what each distinct word adds to its successor, itself and its predecessor."""
        out = np.zeros((3, len(words) + 1, len(TAGS)), np.float32)
        for i, word in enumerate(words):
            of = form(word)
            if len(self.known) > 100_000:  # only a memory of sums already made
                self.known.clear()
            sums = self.known.get(of)
            if sums is None:
                ids = [self.names[f] for f in features(*of) if f in self.names]
                sums = self.weights[:, ids].sum(axis=1)
                if len(word) <= 65:  # forms of long words seldom come again
                    self.known[of] = sums
            out[:, i] = sums
        return out


def train(lines: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, rate: float = 0.15) -> Field:
    """Maximum likelihood by stochastic gradient steps (AdaGrad), with forward-backward on every line."""
    tags = len(TAGS)
    names: dict[str, int] = {}
    coded = []
    for words, y in lines:
        ids = [[], *([names.setdefault(f, len(names)) for f in features(*form(w.encode()))] for w in words), []]
        near = [ids[i : i + 3] for i in range(len(words))]
        coded.append(([(np.repeat(range(3), [len(f) for f in x]), np.concatenate(x).astype(int)) for x in near], np.array(y)))
    weights, moves = np.zeros((3, len(names), tags)), np.zeros((tags, tags))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(epochs):
        for at, y in coded:
            n = len(y)
            e = np.array([weights[x].sum(axis=0) for x in at])
            a, b = np.zeros((n, tags)), np.zeros((n, tags))
            a[0] = e[0]
            for i in range(1, n):
                a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + moves, axis=0)
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp.reduce(moves + (e[i + 1] + b[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(a[-1])
            g = np.exp(a + b - z)
            g[np.arange(n), y] -= 1
            gm = np.zeros_like(moves)
            for i in range(1, n):
                gm += np.exp(a[i - 1][:, None] + moves + (e[i] + b[i])[None, :] - z)
                gm[y[i - 1], y[i]] -= 1
            seen_m += gm**2
            moves -= rate * gm / np.sqrt(seen_m)
            for x, step in zip(at, g):
                seen_w[x] += step**2
                weights[x] -= rate * step / np.sqrt(seen_w[x])
    return Field(names, weights.astype(np.float32), moves.astype(np.float32))


def viterbi(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of many sequences at once. ``scores`` are emissions of all tokens, ``starts`` the first token of each
    sequence (plus the total). Sequences are handled longest first, so that a step works on those still running."""
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    begin, length = starts[:-1][order], length[order]
    best = np.zeros_like(scores)
    back = np.zeros(scores.shape, np.int8)
    out = np.zeros(len(scores), np.int8)
    if not len(length) or not length[0]:
        return out
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than i
    best[begin[: running[0]]] = scores[begin[: running[0]]]
    for i in range(1, int(length[0])):
        at = begin[: running[i]] + i
        before = best[at - 1]
        top, arg = before[:, :1] + moves[0], np.zeros((len(at), scores.shape[1]), np.int8)
        for tag in range(1, len(moves)):
            step = before[:, tag : tag + 1] + moves[tag]
            arg[step > top] = tag
            np.maximum(top, step, out=top)
        back[at] = arg
        best[at] = top + scores[at]
    last = begin[: running[0]] + length[: running[0]] - 1
    out[last] = best[last].argmax(axis=1)
    for i in range(int(length[0]) - 1, 0, -1):
        at = begin[: running[i]] + i
        out[at - 1] = back[at, out[at]]
    return out


def decode(scores: np.ndarray, edge: np.ndarray, field: Field) -> np.ndarray:
    """Best tags of the lines that begin at ``edge``. Lines are divided at words that are surely outside, and only the runs
    between them are searched, with the moves from the word before a run and to the word after it."""
    tags = np.zeros(len(scores), np.int8)
    at = np.flatnonzero(~field.surely_outside(scores))
    if not len(at):
        return tags
    line = np.searchsorted(edge, at, side="right")
    first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(line) > 0)])
    last = np.append(first[1:], True)
    scores = scores[at]
    scores[first & ~np.isin(at, edge)] += field.moves[0]
    scores[last & ~np.isin(at + 1, edge)] += field.moves[:, 0]
    tags[at] = viterbi(scores, np.append(np.flatnonzero(first), len(at)), field.moves)
    return tags


def field_spans(texts: pa.Array, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """Row to (tag, start, end), in characters: the runs of equal tags other than outside in a line of its text."""
    whole = split_words(texts)
    w = _trimmed(whole)
    out: dict[int, list[tuple[str, int, int]]] = {}
    if not len(w.start):
        return out
    code, words = codes(w)
    line = np.cumsum(w.data == 10, dtype=np.int64)[whole.start]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])])
    edge = np.concatenate([np.flatnonzero(new), [len(code)]])
    table = field.word_scores(words)
    before, after = np.roll(code, 1), np.roll(code, -1)
    before[edge[:-1]], after[edge[1:] - 1] = len(words), len(words)
    tags = decode(table[0][before] + table[1][code] + table[2][after], edge, field)
    found = np.flatnonzero((tags > 0) & (w.end > w.start))
    character = np.concatenate([[0], np.cumsum(_HEAD[w.data])])
    base = character[offsets(texts)[1]]
    previous = -2
    for i in found.tolist():
        row = int(w.row[i])
        spans = out.setdefault(row, [])
        start, end = int(character[w.start[i]] - base[row]), int(character[w.end[i]] - base[row])
        if previous == i - 1 and tags[i] == tags[previous] and not new[i]:
            kind, begin, _ = spans.pop()
            spans.append((kind, begin, end))
        else:
            spans.append((TAGS[tags[i]], start, end))
        previous = i
    return out


_QUOTE = re.compile("[\"'`<>]")
_WORD = re.compile(r"[^ \t-\r]+")


def _cards(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The card numbers among the words of a span: neighbouring words that hold 13 to 19 digits together and pass Luhn."""
    out, begin, digits = [], None, ""
    for m in _WORD.finditer(text, start, end):
        begin, digits = m.start() if begin is None else begin, digits + "".join(_DIGIT.findall(m.group()))
        if len(digits) > 19:
            begin, digits = m.start(), "".join(_DIGIT.findall(m.group()))
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", begin, m.end()))
            begin, digits = None, ""
    return out


def checked(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field after what a rule can tell: a card must pass Luhn, and is divided where it holds several; a secret
    ends before a quote inside it."""
    out = []
    for kind, s, e in spans:
        quote = _QUOTE.search(text, s, e) if kind == "secret" else None
        if kind == "card":
            out += _cards(text, s, e)
        elif quote is None:
            out.append((kind, s, e))
        elif quote.start() > s:
            out.append((kind, s, quote.start()))
    return out


def merge(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of the field that overlap none of them, by kind as listed in ``TAGS``, then start."""
    taken = sorted((s, e) for _, s, e in base)
    added, i = [], 0
    for kind, s, e in sorted(more, key=lambda x: x[1]):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not any(a < e and s < b for a, b in taken[max(0, i - 2) : i + 2]):
            added.append((kind, s, e))
    return sorted([*base, *added], key=_by_kind)


def odd_lines(texts: pa.Array, field: Field) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines that can have a span, the row of each, the character of its text that it begins with)."""
    parts = pc.split_pattern(texts, "\n")
    lines, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    size = pc.utf8_length(lines).to_numpy() + 1
    begin = np.cumsum(size) - size
    begin -= begin[parts.offsets.to_numpy()[row]]
    if not field.quiet:
        return lines, row, begin
    at = np.flatnonzero(pc.match_substring_regex(lines.cast(pa.large_binary()), _ODD).to_numpy(zero_copy_only=False))
    return lines.take(pa.array(at)), row[at], begin[at]


def text_spans(texts: pa.Array, field: Field) -> dict[int, tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Row to its pattern spans and all its spans, each by kind, then start; rows without a span are left out."""
    lines, rows, begins = odd_lines(texts, field)
    more = field_spans(lines, field)
    out: dict[int, tuple[list, list]] = {}
    for i, (line, row, begin) in enumerate(zip(lines.to_pylist(), rows.tolist(), begins.tolist())):
        base = base_spans(line)
        spans = merge(base, checked(line, more.get(i, [])))
        if spans:
            for of_row, of_line in zip(out.setdefault(row, ([], [])), (base, spans)):
                of_row += [(k, begin + s, begin + e) for k, s, e in of_line]
    for both in out.values():
        for spans in both:
            spans.sort(key=_by_kind)
    return out


def _by_kind(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return TAGS.index(span[0]), *span[1:]


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


COLUMNS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_spans string, base_sha256 string, spans string"


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=2 << 20):
                texts = utf8(part.column("text"))
                found = text_spans(texts, field)
                rows = []
                for row in range(len(texts)):
                    base, spans = found.get(row, ([], []))
                    joined = _join(base)
                    rows.append([*(sum(k == kind for k, _, _ in base) for kind in KINDS), len(spans) - len(base), joined, hashlib.sha256(joined.encode()).hexdigest(), _join(spans)])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                    [c.split()[0] for c in COLUMNS.split(", ")],
                )

    return run


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the pattern spans by kind, n_added by the field, base_spans and all spans as
    ``kind:start:end`` (characters, end exclusive) joined by commas, base_sha256 the hash of base_spans.

    Cards that the field adds pass Luhn, and its secrets end before an inner quote. Both are ordered by kind, then start, with the kinds that only the field knows last. Null and empty texts have no spans; a null doc_id is kept;
    repeated rows give equal rows; other columns are ignored. Lines are decoded whole, however long.
    """
    field = field or train(examples())
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_find(field), COLUMNS)
