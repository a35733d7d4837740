"""Toxicity of texts that hide their words, by a noisy channel.

1. A character trigram model is counted over the whole corpus (64 symbols, so
   64**3 counts at most).
2. Tokens that look disguised (digits or signs among letters, letters repeated
   three times or all doubled, single characters with gaps) become lattices, at
   any length: each character may be itself or the letters it stands for, a
   repeated run may be one or two letters, a gap may be nothing.  Viterbi decoding under the character model
   restores the likeliest word.  Other tokens have one path and stay.
3. Restored texts are scored by a lexicon of words and word beginnings whose
   rates in toxic and other documents differ, learnt from labelled rows, and a
   logistic model over the lexicon's hits.

The classifier is fitted on a sample of at most ``SAMPLE_TOXIC`` toxic and
``SAMPLE_CLEAN`` other labelled rows, the first by a hash of the id; the
character model and the scores cover every whole text.

Defined results: null and empty texts are scored as texts without words; rows
with labels that are null or not 0 or 1 are not learnt from; a document labelled
twice counts as toxic if one label says so; without toxic or without other
labels the score is the share of toxic labels, at most 0.29; repeated rows are
scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, keep, mix64
from .symbols import SIZE, chunks, joined, symbols

SAMPLE_TOXIC = 10_000
SAMPLE_CLEAN = 20_000
THRESHOLD = 0.3
#: What a disguised character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Natural logarithms of the channel.
P_LEET, P_KEEP_LEET, P_DOUBLE, P_REPEAT, P_GAP, P_SPACE = -0.7, -9.0, -0.5, -0.7, -0.3, -2.5
#: A wider gap within a word; one letter for two.
P_WIDE, P_HALVE = -1.5, -3.0
PREFIXES = (4, 5, 6)
#: A lexicon entry needs this G2 (log-likelihood ratio) and this share of toxic documents.
MIN_G2, MIN_RATE = 20.0, 0.35
#: A word decides alone only if the cautious end of its rate is this high.
MIN_FLOOR = 0.8
_SIGN, _GAP = "@$!|+(€", r"[ .\-_*,]"
_LETTER = r"[^\W\d_]"
_UNIT = rf"(?:{_LETTER}|[0-9{_SIGN}])"
#: Three and more single characters with gaps: l o s e r, l.0.s.e.r, ll oo ss ee rr.
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_]['’])({_UNIT})\1{{0,2}}(?:{_GAP}{{1,3}}({_UNIT})\2{{0,2}}){{2,}}(?![^\W_])")
_CHUNK = re.compile(rf"[\w{_SIGN}]+")
#: What makes a chunk of lower-case letters, digits and signs a disguise.
_DISGUISED = re.compile(
    rf"{_LETTER}[0-9{_SIGN}]+(?:{_LETTER}|[0-9])"  # a sign or digit between letters
    rf"|^[0-9{_SIGN}]{{1,2}}{_LETTER}{{2}}"  # or before them
    rf"|{_LETTER}(?:[@$€]+|([0-9])\1|[0-9{_SIGN}]+[+|])$|{_LETTER}{{2}}[@$€0-9]+$"  # or at the end
    rf"|({_LETTER})\2\2"  # looooser
    rf"|({_LETTER})\3({_LETTER})\4({_LETTER})\5"  # lloosseerr
)
_DOUBLED = re.compile(rf"(?:({_LETTER})\1)+")


# --- the character model -----------------------------------------------------


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n) of the symbol trigrams in all texts; runs of non-letters count as one."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SIZE**3, np.int64)
        rows = ((t.as_py() or "",) for b in batches for t in b.column(0))
        for _, cps, _ in chunks(rows):
            s = symbols(cps).astype(np.int32)
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
            s = np.concatenate([[0, 0], s])
            n += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=SIZE**3)
        at = np.flatnonzero(n)
        yield batch(schema, code=pa.array(at.astype(np.int32)), n=pa.array(n[at]))

    return docs.select(F.col(text_col)).mapInArrow(work, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln p(symbol | two before), interpolated with shorter contexts: 64**3 floats."""
    found = count_trigrams(docs, text_col).toArrow()  # 64**3 rows at most
    n = np.zeros(SIZE**3)
    n[found.column("code").to_numpy()] = found.column("n").to_numpy()
    tri = n.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(0)
    uni = bi.sum(0)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of a token, the strings it may stand for and their log-probabilities."""
    least = min(map(len, re.findall(rf"{_GAP}+", token)), default=0) if spaced else 0
    low_token = token.lower()
    doubled = bool(_DOUBLED.fullmatch(low_token)) and len(token) >= 6
    some_doubled = not doubled and bool(_DISGUISED.search(low_token))
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        low = c.lower()
        if spaced and c in " .-_*,":
            while j < len(token) and token[j] in " .-_*,":
                j += 1
            # a gap wider than the others is rather the end of a word
            out.append([("", P_GAP), (" ", P_SPACE)] if j - i == least else [("", P_WIDE), (" ", P_GAP)])
            i = j
            continue
        while j < len(token) and token[j].lower() == low:
            j += 1
        n = j - i
        if low in LEET:
            out.append([(x * min(n, 2), P_LEET) for x in LEET[low]] + [(c * n, P_KEEP_LEET)])
            if n > 1:
                out[-1] += [(x, P_LEET + P_REPEAT) for x in LEET[low]]
        elif c.isalpha() and (n >= 3 or n == 2 and (doubled or spaced)):
            out.append([(low, P_REPEAT), (low * 2, P_REPEAT + P_DOUBLE)])
        elif c.isalpha() and n == 2 and some_doubled:
            out.append([(low * 2, 0.0), (low, P_HALVE)])
        else:
            out.append([(low * n, 0.0)])
        i = j
    return out


@lru_cache(maxsize=1 << 12)
def _code(c: str) -> int:
    return int(symbols(np.array([ord(c)], np.uint32))[0])


def viterbi(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest restored form of a token: beam over the last two symbols, with back pointers."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in [*lattice(token, spaced), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, back) in best.items():
            for piece, cost in options:
                x, y, total = a, b, score + cost
                for c in piece:
                    z = _code(c)
                    if z or y:  # runs of non-letters count as one
                        total += float(model[x, y, z])
                        x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = total, (back, piece)
        best = after
    back = max(best.values(), key=lambda v: v[0])[1]
    out = []
    while back:
        back, piece = back
        out.append(piece)
    return "".join(reversed(out))[:-1]


_LEET_TABLE = np.zeros(0x2100, bool)
_LEET_TABLE[[ord(c) for c in LEET]] = True
_BLANKS = np.zeros(0x3001, bool)
_BLANKS[[*range(33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


_GAPS = np.zeros(0x80, bool)
_GAPS[[ord(c) for c in " .-_*,"]] = True


def suspects(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans, from blank to blank, of joined texts in which a disguise can be.

    A superset of what ``_SPACED`` and ``_DISGUISED`` match, found by array work:
    signs or digits beside letters, a letter three times or three doubled letters,
    and single characters (or runs of one) between gaps and others of their kind.
    """
    s = symbols(cps)
    n = len(cps)
    letter = (s != 0) | (cps >= 128) & ~_BLANKS[np.minimum(cps, 0x3000)]
    sign = _LEET_TABLE[np.minimum(cps, 0x20FF)]
    digit = (cps >= 48) & (cps <= 57)
    after, before = np.append(letter[1:], False), np.concatenate([[False], letter[:-1]])
    firm = digit | (cps == ord("@")) | (cps == ord("$")) | (cps == ord("€"))
    flag = sign & (after | before & (firm | np.append(sign[1:], False)))
    same = np.append((cps[1:] == cps[:-1]) | (s[1:] == s[:-1]) & (s[1:] != 0), False)
    twice = letter & same
    flag[:-1] |= twice[:-1] & twice[1:]
    flag[:-4] |= twice[:-4] & twice[2:-2] & twice[4:]
    at = np.flatnonzero(flag)
    # runs of one character between gaps, with a likely unit on either side
    unit, gap = letter | sign, _GAPS[np.minimum(cps, 0x7F)] & (cps < 0x80)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], unit.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    size = end - start
    ok = (size <= 3) & (start > 1) & (end < n - 1)
    start, end, size = start[ok], end[ok], size[ok]
    ok = gap[start - 1] & gap[end] & ((size < 2) | same[start]) & ((size < 3) | same[end - 2])
    start, end = start[ok], end[ok]
    left, right = start - 1, end
    for _ in range(2):
        left = left - (gap[np.maximum(left - 1, 0)] & (left > 0))
        right = right + (gap[np.minimum(right + 1, n - 1)] & (right < n - 1))
    left, right = left - 1, right + 1
    ok = (left >= 0) & (right < n)
    start, end, left, right = start[ok], end[ok], left[ok], right[ok]
    alnum = (s != 0) | digit
    ok = unit[left] & unit[right]
    ok &= (left == 0) | ~alnum[left - 1] | same[left - 1]
    ok &= (right == n - 1) | ~alnum[np.minimum(right + 1, n - 1)] | same[right]
    lo, hi = np.concatenate([at, np.maximum(left[ok] - 2, 0)]), np.concatenate([at, np.minimum(right[ok] + 2, n - 1)])
    if not len(lo):
        return lo, hi
    blank = np.concatenate([[-1], np.flatnonzero(_BLANKS[np.minimum(cps, 0x3000)] & (cps <= 0x3000)), [len(cps)]])
    lo, hi = blank[np.searchsorted(blank, lo) - 1] + 1, blank[np.searchsorted(blank, hi)]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


class Restorer:
    """Restores texts; each disguised token is decoded once in a task's life."""

    LIMIT = 200_000

    def __init__(self, model: np.ndarray):
        self.model, self.seen = model, {}

    def decoded(self, raw: str, spaced: bool) -> str:
        if len(raw) > 64:  # long ones are rare; none is worth keeping
            return viterbi(raw, self.model, spaced)
        if (raw, spaced) not in self.seen:
            if len(self.seen) >= self.LIMIT:
                self.seen.clear()
            self.seen[raw, spaced] = viterbi(raw, self.model, spaced)
        return self.seen[raw, spaced]

    def chunk(self, m: re.Match) -> str:
        raw = m.group()
        # an opening bracket that is closed, and exclamation marks, are no letters
        head = raw[:1] if raw[0] == "(" and m.string[m.end() : m.end() + 1] == ")" else ""
        body = raw[len(head) :].rstrip("!(")
        if not _DISGUISED.search(body.lower()):
            return raw
        return head + self.decoded(body, False) + raw[len(head) + len(body) :]

    def passage(self, raw: str) -> str:
        """A spaced passage; lists of numbers and formulas stay."""
        body = raw.lstrip("(|+")
        body = body.lstrip(" .-_*,") if len(body) < len(raw) else raw
        head, body = raw[: len(raw) - len(body)], body.rstrip("!|+( .-_*,")
        units = re.split(rf"{_GAP}+", body)
        letters, digits = sum(u[:1].isalpha() for u in units), sum(u[:1].isdigit() for u in units)
        signs = len(units) - letters - digits
        if len(units) < 3 or letters + signs < digits or not letters or letters < 2 and not set(body) & set("@$") or letters < 3 and set(body) & set("+|("):
            return raw
        return head + self.decoded(body, True) + raw[len(head) + len(body) :]

    def sub(self, text: str) -> str:
        """``text`` with its disguises restored."""
        out, at = [], 0
        for m in _SPACED.finditer(text):
            out += [_CHUNK.sub(self.chunk, text[at : m.start()]), self.passage(m.group())]
            at = m.end()
        return "".join([*out, _CHUNK.sub(self.chunk, text[at:])])

    def __call__(self, text: str) -> str:
        return next(self.chunks(iter([(text,)])))[0][0][0]

    def chunks(self, rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
        """Like symbols.chunks, with the texts restored."""
        for held, cps, row in chunks(rows):
            lo, hi = suspects(cps)
            if len(lo):
                begin = np.searchsorted(row, np.arange(len(held) + 1))
                cut = begin[1:-1]
                of = np.searchsorted(lo, cut, "left") - 1
                cut = cut[(of >= 0) & (cut < hi[of])]
                lo, hi = np.sort(np.concatenate([lo, cut])), np.sort(np.concatenate([hi, cut]))  # no span over two texts
                texts: dict[int, list[str]] = {}
                done: dict[int, int] = {}
                for k, a, b in zip(row[lo].tolist(), lo.tolist(), hi.tolist(), strict=True):
                    text, base = held[k][-1], int(begin[k])
                    old = text[a - base : b - base]
                    new = self.sub(old)
                    if new != old:
                        texts.setdefault(k, []).extend([text[done.get(k, 0) : a - base], new])
                        done[k] = b - base
                if texts:
                    for k, parts in texts.items():
                        held[k] = (*held[k][:-1], "".join([*parts, held[k][-1][done[k] :]]))
                    held, cps, row = joined(held)
            yield held, cps, row


# --- features ----------------------------------------------------------------


def word_features(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of joined texts its row and four keys: the word and its beginnings (0: none)."""
    s = symbols(cps)
    letter = s != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    length = end - start
    padded = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros((len(start), 1 + len(PREFIXES)), np.uint64, order="F")
    head = np.zeros(len(start), np.uint64)
    for k in range(max(PREFIXES)):
        head = head << np.uint64(6) | padded[start + k]
        if k + 1 in PREFIXES:
            at = PREFIXES.index(k + 1)
            keys[:, 1 + at] = np.where(length > k + 1, mix64(head | np.uint64((k + 1) << 56)), 0)
    # the whole word: a sum of symbol times place over a table of random words
    if len(start):
        begin = np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(s))))])
        place = np.arange(len(s)) - begin
        term = mix64(s.astype(np.uint64) << np.uint64(32) | np.minimum(place, 60).astype(np.uint64))
        term[~letter] = 0
        keys[:, 0] = mix64(np.add.reduceat(term, start) + length.astype(np.uint64))
    return row[start], keys


def _texts(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Restored (id, text) rows in groups."""
    rows = ((doc_id, text.as_py() or "") for b in batches for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True))
    return Restorer(model).chunks(rows)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def count_features(docs: DataFrame, model, only=None) -> DataFrame:
    """(feature, n): in how many of the (id, text) rows each feature is; ``only``: broadcast sorted keys."""
    schema = pa.schema([("feature", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else only.value
        for held, cps, row in _texts(batches, model.value):
            of, keys = word_features(cps, row)
            flat, owner = keys.ravel(), np.repeat(of, keys.shape[1])
            use = flat != 0
            if wanted is not None and len(wanted):
                at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
                use &= wanted[at] == flat
            pairs = np.unique(np.stack([flat[use], owner[use].astype(np.uint64)]), axis=1) if use.any() else np.zeros((2, 0), np.uint64)
            feature, n = np.unique(pairs[0], return_counts=True)
            yield batch(schema, feature=_signed(feature), n=pa.array(n))

    return docs.mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


class Lexicon:
    """Sorted feature keys with log-odds weights, behind a table of their low bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray, weights: np.ndarray, floors: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.floors = keys[order], weights[order], floors[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def evidence(self, of: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
        """For each row: sum and maximum of its distinct hit words' weights, ln(words + 1), and the highest floor."""
        out = np.zeros((rows, 4))
        out[:, 2] = np.log1p(np.bincount(of, minlength=rows))
        if not len(self.keys) or not len(keys):
            return out
        best, floor = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(keys.shape[1]):
            at = np.flatnonzero(self.maybe[(keys[:, k] & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            if len(at):
                found = np.minimum(np.searchsorted(self.keys, keys[at, k]), len(self.keys) - 1)
                hit = self.keys[found] == keys[at, k]
                best[at[hit]] = np.maximum(best[at[hit]], self.weights[found[hit]])
                floor[at[hit]] = np.maximum(floor[at[hit]], self.floors[found[hit]])
        at = np.flatnonzero(best)
        if len(at):
            # a word counts once in a row
            _, first = np.unique(np.stack([of[at].astype(np.uint64), keys[at, 0]]), axis=1, return_index=True)
            at = at[first]
            out[:, 0] = np.bincount(of[at], best[at], minlength=rows)
            np.maximum.at(out[:, 1], of[at], best[at])
            np.maximum.at(out[:, 3], of[at], floor[at])
        return out


def _design(evidence: np.ndarray) -> np.ndarray:
    total, top, words = evidence.T[:3]
    return np.stack([np.ones(len(evidence)), np.sqrt(total), top, total / np.maximum(words, 1), words], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (y - p)) - penalty @ beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """What a task needs to score texts: bounded by the sample and the alphabet."""

    def __init__(self, chars: np.ndarray, keys: np.ndarray, weights: np.ndarray, floors: np.ndarray, beta: np.ndarray | None, flat: float):
        self.chars, self.keys, self.weights, self.floors, self.beta, self.flat = chars, keys, weights, floors, beta, flat


def _evidence_rows(docs: DataFrame, sent) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), *[(c, pa.float64()) for c in ("total", "top", "words")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lexicon = Lexicon(m.keys, m.weights, m.floors)
        for held, cps, row in _texts(batches, m.chars):
            of, keys = word_features(cps, row)
            e = lexicon.evidence(of, keys, len(held))
            yield batch(schema, id=[r[0] for r in held], total=pa.array(e[:, 0]), top=pa.array(e[:, 1]), words=pa.array(e[:, 2]))

    return docs.mapInArrow(work, "id long, total double, top double, words double")


def learn(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the labelled rows of ``docs`` for which ``use`` (over the labels) holds."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    chars = char_model(docs, text_col)
    model = send(chars)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.where(use) if use is not None else marked
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    total = {r._y: r.n for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    none = Model(chars, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), None, min(prior, THRESHOLD - 0.01))
    if not total.get(1) or not total.get(0):
        return none
    picked = [marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked[0].union(picked[1])), "_id")
    sample = keep(sample.dropDuplicates(["_text"]), "toxic-sample")
    got = {r._y: r.n for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not got.get(1) or not got.get(0):
        return none
    rows = lambda y: sample.where(F.col("_y") == y).select(F.col("_id").cast("long"), "_text")
    toxic = count_features(rows(1), model).where("n >= 3").toArrow()  # bounded by the sample's words
    keys = toxic.column("feature").to_numpy().view(np.uint64)
    n1 = toxic.column("n").to_numpy().astype(float)
    order = np.argsort(keys)
    keys, n1 = keys[order], n1[order]
    n0 = np.zeros(len(keys))
    if len(keys):
        clean = count_features(rows(0), model, send(keys)).toArrow()
        n0[np.searchsorted(keys, clean.column("feature").to_numpy().view(np.uint64))] = clean.column("n").to_numpy()
    a, b = float(got[1]), float(got[0])
    both = (n1 + n0) / (a + b)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    g2 = 2 * (n1 * log(n1 / (a * both)) + n0 * log(n0 / (b * both)) + (a - n1) * log((a - n1) / (a * (1 - both) + 1e-9)) + (b - n0) * log((b - n0) / (b * (1 - both) + 1e-9)))
    odds = ((n1 + 0.5) / (a + 1)) / ((n0 + 0.5) / (b + 1))
    rate = prior * odds / (prior * odds + 1 - prior)
    good = (g2 >= MIN_G2) & (rate >= MIN_RATE)
    # one word alone makes a document as toxic as the cautious end of the word's own rate
    sure = (np.maximum(n1 - 2 * np.sqrt(n1), 0) / a) / ((n0 + 2 * np.sqrt(n0) + 2) / b)
    floors = (prior * sure / (prior * sure + 1 - prior))[good]
    floors[floors < MIN_FLOOR] = 0
    keys, weights = keys[good], np.log(odds[good])
    fit = _evidence_rows(sample.select(F.col("_id").cast("long"), "_text"), send(Model(chars, keys, weights, floors, None, 0.0)))
    fit = fit.join(sample.select(F.col("_id").alias("id"), "_y").dropDuplicates(["id"]), "id").toArrow()  # the sample's rows
    e = np.stack([fit.column(c).to_numpy() for c in ("total", "top", "words")], 1)
    y = fit.column("_y").to_numpy().astype(float)
    weight = np.where(y == 1, prior * len(y) / max(1, y.sum()), (1 - prior) * len(y) / max(1, len(y) - y.sum()))
    return Model(chars, keys, weights, floors, fit_logistic(_design(e), y, weight), 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lexicon = Lexicon(m.keys, m.weights, m.floors)
        for held, cps, row in _texts(batches, m.chars):
            if m.beta is None:
                p = np.full(len(held), m.flat)
            else:
                p = _probability(lexicon, m.beta, cps, row, len(held))
            yield batch(schema, id=[r[0] for r in held], score=pa.array(p))

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, "id long, score double")
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays under THRESHOLD, in one pass and with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lexicon, fix = Lexicon(m.keys, m.weights, m.floors), Restorer(m.chars)
        for b in batches:
            good: list[bool] = []
            for held, cps, row in fix.chunks((t.as_py() or "",) for t in b.column(at)):
                if m.beta is None:
                    p = np.full(len(held), m.flat)
                else:
                    p = _probability(lexicon, m.beta, cps, row, len(held))
                good += (p < THRESHOLD).tolist()
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def _probability(lexicon: Lexicon, beta: np.ndarray, cps: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    of, keys = word_features(cps, row)
    e = lexicon.evidence(of, keys, rows)
    return np.maximum(1 / (1 + np.exp(-np.clip(_design(e) @ beta, -30, 30))), e[:, 3])


def restore(docs: DataFrame, chars: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with disguised words restored."""
    sent = docs.sparkSession.sparkContext.broadcast(chars)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(sent.value)
        for b in batches:
            yield batch(schema, id=b.column(0), text=[None if t.as_py() is None else fix(t.as_py()) for t in b.column(1)])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, "id long, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): learns from the labelled rows that are not held out."""
    model = learn(docs, labels, ~held_out(id_col), id_col, text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
