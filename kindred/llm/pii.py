"""Personal data: base patterns, and spans that a trained tagger adds.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed
patterns. The method adds what the patterns miss: a character-level
bidirectional LSTM scores overlapping windows, the scores of a character are
averaged over its windows, those in which it lies near the middle weighing
most, and the best path of the CRF over the whole text gives the spans. Spans
that touch a base span are left out; no pattern, length or checksum judges the
others.

The CRF's scheme bars what can't be: an address has an at sign, with local
characters before and a host after it, a number begins with a digit or with an
opening sign before one, and no span begins or ends inside a word. So all tags
are "outside" but in runs around an at sign or a digit, the best path falls
apart into those of such runs, and only they are scored and decoded. That is no
shortcut: what is skipped has probability zero.

The tagger learns from labelled spans that `labelled_windows` writes with a
fixed seed: it doesn't depend on the corpus, and is fitted once in an application.

Defined results: null or empty text has no spans; offsets count code points, the
end is exclusive; repeated rows are judged alike; a text of any length is
decoded whole.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, id_text, rewritten, table
from .tagger import Scheme, Tagger, symbol_set, symbols

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_TRIGGER = re.compile("[0-9@]")
_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Not after a digit: a match that fails at a run's first digit fails at its others too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
_LOCAL = frozenset(_LETTERS + _DIGITS + "._%+-")


@dataclass(frozen=True)
class Pii:
    window: int = 64
    stride: int = 32
    train_windows: int = 5000
    epochs: int = 10
    train_batch: int = 160
    rate: float = 0.02
    seed: int = 11
    #: Windows scored at once, and characters decoded at once.
    batch: int = 512
    cells: int = 20_000


# ---------------------------------------------------------------- base patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain, found from each at sign: linear in the text."""
    end = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            yield 0, start, (end := d.end())


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- the scheme

_SPACE, _OTHER = 96, 97  # symbols of white space and of letters beyond ASCII
OUT, LOCAL, BEFORE, AT, AFTER, HOST = range(6)
#: The first tag of each kind of number; phone numbers may have signs before the first digit.
FIRST_DIGIT, SIGN = {1: 6, 2: 8, 3: 10}, 12
_KIND = np.array([-1, 0, 0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3])


def scheme() -> Scheme:
    n = len(_KIND)
    can, follow = np.zeros((99, n), bool), np.zeros((n, n), bool)
    can[:, OUT] = True
    can[:, LOCAL] = symbol_set("".join(_LOCAL), _OTHER)
    can[:, BEFORE] = can[:, AFTER] = symbol_set("()[]", _SPACE)
    can[:, AT] = symbol_set("@")
    can[:, HOST] = symbol_set(_LETTERS + _DIGITS + ".-", _OTHER)
    more = {1: ".()[]", 2: "-./", 3: "().-/"}
    starts, ends = [OUT, LOCAL, SIGN], [OUT, HOST]
    for kind, first in FIRST_DIGIT.items():
        can[:, first] = symbol_set(_DIGITS)
        can[:, first + 1] = symbol_set(_DIGITS + more[kind], _SPACE)
        follow[first, [first + 1, OUT]] = follow[first + 1, [first + 1, OUT]] = True
        starts.append(first)
        ends += [first, first + 1]
    can[:, SIGN] = symbol_set("+(")
    follow[OUT, starts] = True
    follow[LOCAL, [LOCAL, BEFORE, AT]] = follow[BEFORE, [BEFORE, AT]] = True
    follow[AT, [AFTER, HOST]] = follow[AFTER, [AFTER, HOST]] = True
    follow[HOST, [HOST, OUT]] = follow[SIGN, [SIGN, FIRST_DIGIT[3]]] = True
    inside = follow.copy()
    inside[OUT, 1:] = inside[1:, OUT] = False
    return Scheme(can, follow, inside, symbol_set(_LETTERS + _DIGITS + "_", _OTHER), np.isin(range(n), starts), np.isin(range(n), ends))


def tags_of(kind: int, piece: str) -> list[int]:
    """The tags of a span of a kind."""
    if kind == 0:
        user, host = piece.split("@")
        own = [LOCAL if c in _LOCAL else BEFORE for c in user]
        lead = len(host) - len(host.lstrip(" )]"))
        return own + [AT] + [AFTER] * lead + [HOST] * (len(host) - lead)
    at = next(i for i, c in enumerate(piece) if c in _DIGITS)
    return [SIGN] * at + [FIRST_DIGIT[kind]] + [FIRST_DIGIT[kind] + 1] * (len(piece) - at - 1)


# ---------------------------------------------------------------- labelled spans


def _prose(rng: random.Random, n: int) -> str:
    letters, marks = "etaoinshrdlucmfwygpbvk" * 3 + "éèüößñóáçà", ["", "", "", "", ",", ".", "!", ":", ")", "\n"]
    words = ("".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(n))
    return " ".join((w.capitalize() if rng.random() < 0.15 else w) + rng.choice(marks) for w in words)


def _written(rng: random.Random, kind: int) -> str:
    """One piece of personal data, in one of the ways in which people write it."""
    name = lambda a, b: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(a, b)))
    digits = lambda n: "".join(rng.choices(_DIGITS, k=n))
    if kind == 0:
        parts = [name(2, rng.choice([6, 10, 24])) for _ in range(rng.choice([1, 1, 2, 3]))] + rng.choice([[], [digits(rng.randrange(1, 5))]])
        user = rng.choice([".", "_", "-", ""]).join(parts)
        host = name(1, rng.choice([8, 16, 40])) + rng.choice(["", digits(1), "-" + name(2, 8)]) + rng.choice([".example", "", ".mail", "." + name(2, 9)])
        piece = user + rng.choice(["@", "@", "@", " @ ", " @ ", "@ ", " @", "(@)", "[@]", " (@) "]) + host + rng.choice([".com", ".org", ".net", ".de", ".co.uk", "." + name(2, 4)])
        return piece.upper() if rng.random() < 0.1 else piece
    if kind == 1:
        return rng.choice([".", ".", ".", " . ", "[.]", "(.)", ". "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        d, sep = digits(rng.choice([16, 16, 16, 15, 19])), rng.choice(["", "", "", " ", "-", ".", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = digits(3), digits(3), digits(4)
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b}-{c}", f"{a}/{b}-{c}", f"{digits(2)} {a} {c}"]
    return rng.choice(["+1 ", "+44 ", "+1-", "", "", "", "001 ", "0049 ", "+49 (0) "]) + rng.choice(forms)


def _decoy(rng: random.Random) -> str:
    """Digits and at signs that aren't personal data."""
    num = lambda a, b: str(rng.randrange(a, b))
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    date = [num(1900, 2100), num(10, 13), num(10, 29)]
    forms = (
        lambda: rng.choice(["", "v"]) + num(0, 30) + "." + num(0, 30),
        lambda: num(0, 9) + "." + num(0, 20) + "." + num(0, 90),
        lambda: num(1900, 2100), lambda: num(0, 1000), lambda: num(1000, 10 ** rng.randrange(4, 13)),
        lambda: rng.choice("-/.").join(date), lambda: rng.choice("-/.").join(reversed(date)), lambda: num(1900, 2000) + "-" + num(2000, 2030),
        lambda: num(10, 24) + ":" + num(10, 60) + rng.choice(["", ":" + num(10, 60)]), lambda: num(1, 900) + "," + num(100, 1000),
        lambda: "$" + num(1, 999) + "." + num(10, 99), lambda: "password=" + hexa(rng.randrange(8, 20)),
        lambda: 'token = "' + hexa(40) + '"', lambda: hexa(rng.randrange(16, 41)),
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)),
        lambda: "@" + "".join(rng.choices("abcdefghij", k=rng.randrange(3, 12))), lambda: num(1, 99) + "@" + num(1, 99),
        lambda: "/" + num(1, 10**6) + ".html", lambda: "§" + num(1, 99) + "(" + num(1, 9) + ")",
        lambda: " ".join(num(1, 100) for _ in range(rng.randrange(2, 6))), lambda: "(" + num(1, 30) + ")", lambda: "pp. " + num(1, 99) + "-" + num(100, 400),
    )
    return rng.choice(forms)()


def labelled_windows(n: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of symbols and their tags, cut at random from texts with labelled spans."""
    rng = random.Random(seed)
    x, y = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for row in range(n):
        text = _prose(rng, 9)[-rng.randrange(1, 50) :]
        tags = [OUT] * len(text)
        while len(text) < width + 50:
            kind = rng.randrange(4) if rng.random() < 0.6 else -1
            piece = _written(rng, kind) if kind >= 0 else _decoy(rng)
            mine = tags_of(kind, piece) if kind >= 0 else [OUT] * len(piece)
            gap = rng.choice([" ", " ", " ", "\n", " (", ": ", " "])
            tail = rng.choice([" ", " ", ", ", ". ", "\n", ") ", "! ", "!! ", "*** "]) + _prose(rng, rng.randrange(1, 8)) + " "
            text, tags = text + gap + piece + tail, tags + [OUT] * len(gap) + mine + [OUT] * len(tail)
        at = rng.randrange(0, len(text) - width + 30)
        part = text[at : at + width]
        x[row, : len(part)] = symbols(part)
        y[row, : len(part)] = tags[at : at + len(part)]
    return x, y


@lru_cache(maxsize=4)
def trained(cfg: Pii = Pii()) -> Tagger:
    x, y = labelled_windows(cfg.train_windows, cfg.window, cfg.seed)
    tagger = Tagger(scheme(), seed=cfg.seed)
    tagger.fit(x, y, cfg.epochs, cfg.train_batch, cfg.rate)
    return tagger


_FITTED: dict[tuple[str, Pii], Tagger] = {}


def fitted(spark: SparkSession, cfg: Pii = Pii()) -> Tagger:
    """The trained tagger, once for an application. A task trains it, on one core: the driver only keeps the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.record_batch([pa.array([pickle.dumps(trained(cfg).w)])], ["weights"])

    key = (spark.sparkContext.applicationId, cfg)
    if key not in _FITTED:
        got = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary").first()
        _FITTED[key] = Tagger(scheme(), w=pickle.loads(got.weights))
    return _FITTED[key]


# ---------------------------------------------------------------- added spans

_NUMBER = re.compile(r"[+(]*[0-9][\s0-9.()\[\]/+-]*")
_JOINS, _EDGE = frozenset("()[] \t\n\r\x0b\x0c"), " \t\n\r\x0b\x0c.,;:-/(["


def runs(text: str) -> list[tuple[int, int]]:
    """Where a tag can be anything but "outside", with a character on either side."""

    def walk(at: int, step: int, inner) -> int:
        while 0 <= at < len(text) and inner(text[at]):
            at += step
        return at

    local, joins = lambda c: c in _LOCAL or (c > "\x7f" and c.isalpha()), _JOINS.__contains__
    found = [m.span() for m in _NUMBER.finditer(text)]
    for m in _AT.finditer(text):
        a = walk(walk(m.start() - 1, -1, joins), -1, local) + 1
        found.append((a, walk(walk(m.end(), 1, joins), 1, local)))
    out: list[list[int]] = []
    for a, b in sorted((max(0, a - 1), min(len(text), b + 1)) for a, b in found):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scores(coded: list[np.ndarray], places: list[tuple[int, int, int]], tagger: Tagger, cfg: Pii) -> list[np.ndarray]:
    """For each run (text, start, end) its characters' emissions, averaged over the windows they are in."""
    w, margin = cfg.window, (cfg.window - cfg.stride) // 2
    sums = [np.zeros((b - a, tagger.scheme.tags), np.float32) for _, a, b in places]
    weights = [np.zeros((b - a, 1), np.float32) for _, a, b in places]
    middle = np.minimum(np.arange(1, w + 1), np.arange(w, 0, -1)).astype(np.float32)[:, None]
    jobs = [(r, s) for r, (_, a, b) in enumerate(places) for s in range(max(0, a - margin), b, cfg.stride)]
    for at in range(0, len(jobs), cfg.batch):
        part = jobs[at : at + cfg.batch]
        x = np.zeros((w, len(part)), np.int64)
        for col, (r, s) in enumerate(part):
            mine = coded[places[r][0]][s : s + w]
            x[: len(mine), col] = mine
        emit = tagger.emissions(x)
        for col, (r, s) in enumerate(part):
            _, a, b = places[r]
            low, high = max(a, s), min(b, s + w)
            sums[r][low - a : high - a] += emit[low - s : high - s, col] * middle[low - s : high - s]
            weights[r][low - a : high - a] += middle[low - s : high - s]
    return [s / n for s, n in zip(sums, weights)]


def _paths(coded: list[np.ndarray], places: list[tuple[int, int, int]], scores: list[np.ndarray], tagger: Tagger, cfg: Pii) -> dict[int, np.ndarray]:
    """The best tags of each run; runs of like length are decoded together."""
    order, out, at = sorted(range(len(places)), key=lambda r: len(scores[r])), {}, 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(scores[order[end]]) * (end + 1 - at) <= cfg.cells:
            end += 1
        part, longest = order[at:end], len(scores[order[end - 1]])
        emit = np.zeros((longest, len(part), tagger.scheme.tags), np.float32)
        x = np.zeros((longest, len(part)), np.int64)
        for col, r in enumerate(part):
            i, a, b = places[r]
            emit[: b - a, col], x[: b - a, col] = scores[r], coded[i][a:b]
        best = tagger.best_path(emit, x)
        out |= {r: best[: len(scores[r]), col] for col, r in enumerate(part)}
        at = end
    return out


def all_spans(texts: list[str | None], tagger: Tagger, cfg: Pii = Pii()) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, in order."""
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    coded, names, places = [], [], []
    for i, t in enumerate(texts):
        if t and _TRIGGER.search(t):
            out[i] = (base_spans(t), [])
            places += [(len(names), a, b) for a, b in runs(t)]
            names.append(i)
            coded.append(symbols(t))
    tags = _paths(coded, places, _scores(coded, places, tagger, cfg), tagger, cfg)
    added: dict[int, list[Span]] = {i: [] for i in names}
    for r, path in tags.items():
        k, at, _ = places[r]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], path != OUT, [0]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2):
            kind, text = int(_KIND[path[a]]), texts[names[k]]
            a, b = at + int(a), at + int(b)
            while text[b - 1] in _EDGE and b > a + 1:
                b -= 1
            added[names[k]].append((kind, a, b))
    for i in names:
        base, text = out[i][0], texts[i]
        free = np.ones(len(text), bool)
        for _, a, b in base:
            free[a:b] = False
        out[i] = (base, sorted(base + [s for s in added[i] if free[s[1] : s[2]].all()]))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, cfg: Pii = Pii()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the hash are of base spans.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, cfg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = all_spans(part.column("text").to_pylist(), weights.value, cfg)
                counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(4)]
                yield pa.record_batch(
                    [part.column("doc_id")]
                    + [pa.array(c, pa.int64()) for c in counts]
                    + [
                        pa.array(hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found),
                        pa.array([written(s) for _, s in found], pa.string()),
                        pa.array([len(s) - len(base) for base, s in found], pa.int64()),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans by that of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, cfg: Pii = Pii()) -> DataFrame:
    """docs with personal data replaced; the same columns and rows. n_chars, if there, follows the text."""
    bound_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, cfg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column("text").to_pylist()
                found = all_spans(texts, weights.value, cfg)
                new = [redact_text(t, s) if s else t for t, (_, s) in zip(texts, found)]
                cols = dict(zip(part.schema.names, part.columns))
                cols["text"] = pa.array(new, part.schema.field("text").type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], cols["n_chars"].type)
                yield pa.RecordBatch.from_pydict(cols, part.schema)

    return rewritten(docs, run)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(id_text(table(spark, sf_dir, "documents")))
