"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field labels words O, email, ip, card, phone or secret. It is
trained by gradient ascent on the log-likelihood of a small labelled table (labelled_table() makes the default one) and decoded by Viterbi in numpy
batches, over all words of a text. A word whose score for O exceeds all others by more than any change of its transitions could make up is O in every best
labelling, so the chain parts there, and only the words between are decoded in step: the exact optimum. Labelled runs become spans, and those that overlap no pattern's span are added.

Words, shapes and places come from the UTF-8 bytes of many texts at once; texts are read once and never shuffled. Places are code points, ends exclusive.
Null and empty texts have no spans; texts of any length are read whole. Each row is judged for itself, repeated or not; further columns, whatever their names, are passed by, and a column named
as the output is replaced. Of labellings that score alike, the one with the labels listed first counts. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: The part before a run of digits can't match where the run itself doesn't, so a run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: An address without @ is spelled out, with at and dot.
_SPELLED = re.compile(r"[^a-z]at[^a-z].*[^a-z]dot[^a-z]", re.IGNORECASE | re.DOTALL)
#: No pattern matches without one of these.
_HARD = re.compile(rb"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by place. Each pattern's matches are leftmost and don't overlap; those that fail its test are dropped.

    E-mail addresses are found from each @, since a search from every letter takes quadratic time on long words.
    """
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text, begin - 1, begin):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- shapes

_CLASS = {"digit": b"0123456789", "at": b"@", "dot": b".", "dash": b"-", "paren": b"()", "plus": b"+", "eq": b"=:", "quote": b"\"'", "hex": b"abcdefABCDEF", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "under": b"_", "slash": b"/", "star": b"*%#&$!|"}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
_SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: Words that announce a secret, and those of spelled-out addresses, by class; compared by eight bytes, without a sign at either end.
_CUES = {1: "password passwd passphra pwd passwort secret token", 2: "at", 3: "dot", 4: "com org net edu de io fr co uk es example"}
_PACK = lambda w: sum(c << (8 * i) for i, c in enumerate(w[:8]))
_CUE_KEYS, _CUE_OF = (np.array(x) for x in zip(*sorted((_PACK(w.encode()), k) for k, ws in _CUES.items() for w in ws.split()), strict=True))
_COUNT_EDGES = np.array([1, 2, 3, 4, 5, 7, 9, 11, 13, 16, 20, 30, 40])


class Words:
    """The words of texts joined by spaces: their places in bytes, row, and places in code points."""

    def __init__(self, texts: list[bytes | None]):
        self.data = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
        space = _SPACES[self.data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = change[::2], change[1::2]
        size = np.array([len(t or b"") for t in texts], np.int64)
        self.row_at = 1 + np.cumsum(size + 1) - (size + 1)  # of the first byte of each row
        self.row = np.searchsorted(self.row_at, self.begin, side="right") - 1
        self.points = np.cumsum((self.data & 0xC0) != 0x80)  # code points up to and with each byte

    def place(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.points[byte - 1] - self.points[self.row_at[row] - 1]


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words that the field labels, all of them, and which of them begin a text."""
    fresh = np.ones(len(words.begin), bool)
    fresh[1:] = words.row[1:] != words.row[:-1]
    return np.arange(len(words.begin)), fresh


def _cues(words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word's cue, and 8 more where a sign of assignment ends it."""
    letter = _MASKS["upper"] | _MASKS["lower"]
    data = words.data
    last = data[end - 1]
    lo, hi = begin + ~letter[data[begin]], end - ~letter[last]
    key = np.zeros(len(begin), np.int64)
    for i in range(8):
        inside = lo + i < hi
        key |= np.where(inside, data[np.minimum(lo + i, len(data) - 1)].astype(np.int64) | 0x20, 0) << (8 * i)
    at = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    return np.where(_CUE_KEYS[at] == key, _CUE_OF[at], 0) + 8 * _MASKS["eq"][last]


def _parts(words: Words, which: np.ndarray) -> list[np.ndarray]:
    """Shape features of single words, as small numbers: one array for each feature."""
    begin, end = words.begin[which], words.end[which]
    length = end - begin
    counts = dict.fromkeys(_MASKS, np.zeros(len(which), np.int64))
    if len(which):
        first = np.cumsum(length) - length
        chars = words.data[np.repeat(begin - first, length) + np.arange(int(length.sum()))]
        counts = {k: np.add.reduceat(mask[chars], first, dtype=np.int64) for k, mask in _MASKS.items()}
    level = lambda x: np.searchsorted(_COUNT_EDGES, x, side="right")
    has = lambda *ks: sum((counts[k] > 0).astype(np.int64) << i for i, k in enumerate(ks))
    kind = np.zeros(256, np.int64)
    for i, k in enumerate(("digit", "upper", "lower", "dot", "dash", "paren", "plus", "eq", "quote", "at", "star")):
        kind[_MASKS[k]] = i + 1
    first, last = (kind[words.data[begin]], kind[words.data[end - 1]]) if len(which) else (length, length)
    letters = counts["upper"] + counts["lower"]
    return [level(counts["digit"]), level(length), level(letters), has("at", "dot", "dash", "paren", "plus", "eq", "quote"), first * 16 + last, np.minimum(counts["dot"], 5) * 16 + np.minimum(counts["dash"], 5), level(counts["hex"] + counts["digit"]) * 2 + (counts["hex"] + counts["digit"] + counts["quote"] >= length), (counts["digit"] == length) * 32 + level(counts["digit"]), (counts["at"] > 0) * 8 + np.minimum(counts["dot"], 3) * 2 + (letters > 0), _cues(words, begin, end) if len(which) else length]


_SIZES = [16, 16, 16, 128, 256, 96, 32, 64, 16, 16]
_PER_WORD = sum(_SIZES)
N_FEATURES = 3 * _PER_WORD + 1
_N_ACTIVE = 3 * len(_SIZES) + 1


def features(words: Words, which: np.ndarray) -> np.ndarray:
    """Active features of each word: its shape, its neighbours' in the same text, and a constant."""
    n = len(words.begin)
    base = np.cumsum([0, *_SIZES[:-1]])
    cols = []
    for k, step in enumerate((0, -1, 1)):
        near = which + step
        there = (near >= 0) & (near < n)
        near = np.clip(near, 0, max(0, n - 1))
        there &= words.row[near] == words.row[which] if n else there
        for p, b in zip(_parts(words, near), base, strict=True):
            cols.append(np.where(there, k * _PER_WORD + b + p, N_FEATURES - 1))
    cols.append(np.full(len(which), N_FEATURES - 1))
    return np.stack(cols, 1) if len(which) else np.empty((0, _N_ACTIVE), np.int64)


def scores(words: Words, emit: np.ndarray) -> np.ndarray:
    """What features() and emit give each word, from one look at each: a word's own part, and what it says of its neighbours."""
    n = len(words.begin)
    parts = _parts(words, np.arange(n))
    base = np.cumsum([0, *_SIZES[:-1]])
    out = np.repeat(emit[-1:], n, 0)
    for k, step in enumerate((0, -1, 1)):
        own = sum(emit[k * _PER_WORD + b + p] for p, b in zip(parts, base, strict=True)) if n else out
        if not step:
            out += own
            continue
        to, of = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
        same = (words.row[1:] == words.row[:-1])[:, None]
        out[to] += np.where(same, own[of], len(parts) * emit[-1])
        out[0 if step < 0 else -1 :][:1] += len(parts) * emit[-1]
    return out


# --- the field


class Field:
    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def decode(self, feats: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The most likely labels of runs of words, all runs in step, longest first."""
        return self.best(self.emit[feats].sum(1), fresh)

    def label(self, words: Words) -> np.ndarray:
        """The most likely labels of all words. Words that must be O part the chain and stand, as O, at the ends of what is decoded."""
        n = len(words.begin)
        if not n:
            return np.empty(0, np.int64)
        score, (_, fresh) = scores(words, self.emit), _runs(words)
        into, out_of = np.vstack([self.move, self.start]), np.hstack([self.move, np.zeros((len(LABELS), 1))])
        gain = (into - into[:, :1]).max(0) + (out_of - out_of[:1]).max(1)
        sure = ((score[:, :1] - score - gain)[:, 1:] > 1e-6).all(1)
        open_ = ~sure
        use = open_.copy()
        use[:-1] |= open_[1:] & ~fresh[1:]
        use[1:] |= open_[:-1] & ~fresh[1:]
        at = np.flatnonzero(use)
        part = score[at]
        part[sure[at], 1:] = -1e9
        begin = np.ones(len(at), bool)
        begin[1:] = (np.diff(at) > 1) | fresh[at[1:]]
        out = np.zeros(n, np.int64)
        out[at] = self.best(part, begin)
        return out

    def best(self, score: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        n = len(score)
        if not n:
            return np.empty(0, np.int64)
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((n, len(LABELS)), np.int8)
        best = score[first] + self.start
        running = np.searchsorted(-length, -np.arange(int(length[0])), side="left").tolist()  # runs of more than t words
        for t in range(1, int(length[0])):
            live = running[t]
            cand = best[:live, :, None] + self.move
            back[first[:live] + t] = cand.argmax(1)
            best[:live] = cand.max(1) + score[first[:live] + t]
        out = np.zeros(n, np.int64)
        at, label = first + length - 1, best.argmax(1)
        out[at] = label
        for t in range(1, int(length[0])):
            live = running[t]
            label = label[:live]
            label = back[at[:live] - t + 1, label]
            out[at[:live] - t] = label
        return out


def train(feats: np.ndarray, labels: np.ndarray, fresh: np.ndarray, *, steps: int = 200, rate: float = 0.5, decay: float = 5e-5) -> Field:
    """Gradient ascent on the conditional log-likelihood, by forward-backward over all runs in step."""
    k, n = len(LABELS), len(feats)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    emit, move, start = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    gold_emit, gold_move, gold_start = np.zeros_like(emit), np.zeros_like(move), np.zeros_like(start)
    np.add.at(gold_emit, (feats, labels[:, None]), 1.0)
    inner = np.flatnonzero(~fresh)
    np.add.at(gold_move, (labels[inner - 1], labels[inner]), 1.0)
    np.add.at(gold_start, labels[first], 1.0)
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    past = [np.full_like(x, 1e-6) for x in (emit, move, start)]
    for _ in range(steps):
        score = emit[feats].sum(1)
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        alpha[first] = score[first] + start
        for t in range(1, int(length[0])):
            live = first[: int(np.searchsorted(-length, -t, side="left"))] + t
            alpha[live] = lse(alpha[live - 1][:, :, None] + move, 1) + score[live]
        for t in range(int(length[0]) - 2, -1, -1):
            live = first[: int(np.searchsorted(-length, -(t + 1), side="left"))] + t
            beta[live] = lse(move[None] + (score[live + 1] + beta[live + 1])[:, None, :], 2)
        z = lse(alpha[first + length - 1], 1)
        of = np.zeros(n)
        of[np.concatenate([np.arange(f, f + m) for f, m in zip(first, length, strict=True)])] = np.repeat(z, length)
        p = np.exp(alpha + beta - of[:, None])
        want_emit, want_move = np.zeros_like(emit), np.zeros_like(move)
        for j in range(feats.shape[1]):
            np.add.at(want_emit, feats[:, j], p)
        if len(inner):
            want_move = np.exp(alpha[inner - 1][:, :, None] + move + (score[inner] + beta[inner])[:, None, :] - of[inner][:, None, None]).sum(0)
        grads = [gold_emit - want_emit - decay * n * emit, gold_move - want_move - decay * n * move, gold_start - p[first].sum(0) - decay * n * start]
        for w, g, s in zip((emit, move, start), grads, past, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(emit, move, start)


def labelled_table(rows: int = 1500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: words and labels, from templates; each personal item stands among plain and numeric words."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def email():
        return [pick(f"{letters(5)}@{letters(6)}.{pick('com', 'org', 'example.net')}", f"{letters(4)}.{digits(2)}@{letters(5)}{digits(1)}.example.com", f"<{letters(5)}@{letters(6)}.de>,", f"{letters(4)}_{letters(3)}@{letters(6)}.{letters(2)}.")]

    def ip():
        a = ".".join(str(x) for x in rng.integers(0, 256, 4))
        return [pick(a, a + ",", f"({a})", a + ".", f"{a}:{digits(4)}")]

    def card():
        d = digits(16)
        return pick([d], [d + "."], [d[:4], d[4:8], d[8:12], d[12:]], [f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    def phone():
        return pick([f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(11)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"])

    def secret():
        h = "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, int(pick(32, 40, 64))))
        return pick([f'"{h}"'], [f'token="{h}"'], [f"api_key={h}"], [h])

    def spelled():
        dot, at = pick("dot", "(dot)", "[dot]"), pick("at", "(at)", "[at]")
        return [letters(int(rng.integers(2, 13))), at, *([letters(int(rng.integers(2, 13))), dot] if rng.random() < 0.7 else ["example", dot]), pick("com", "org", "net", "de", "com.", "org,")]

    def prose():
        """Words that look like a cue's, without what makes one of them."""
        w = lambda: letters(int(rng.integers(2, 11)))
        return pick([w(), "at", w(), w()], [w(), "dot", w()], [pick("password", "token", "secret"), w(), w()], [w() + ":", w(), w()], [w().capitalize(), w(), w(), w() + "."], [w() + ",", w(), w(), w()], [w(), w(), pick("de", "net", "es"), w()], [w(), "at", w(), pick("de", "es"), w()])

    def plain():
        return pick(letters(int(rng.integers(2, 10))), letters(5) + pick(",", ".", "%%%", "!!"), "=", "x=1", digits(int(rng.integers(1, 5))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)},{digits(3)}", f"{digits(2)}%", f"page={digits(2)}&ref=x", f"({digits(2)})", f"{letters(3)}{digits(2)}", "@" + letters(6), f"{digits(11)}", f"{digits(8)}")

    out = []
    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    for _ in range(rows):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 5))):
                words.append(plain())
                labels.append("O")
            kind = pick(*KINDS, "O")
            if kind != "O":
                if kind == "secret" and rng.random() < 0.6:
                    words += [pick("token", "key", "password"), "="]
                    labels += ["O", "O"]
                item = makers[kind]()
                words += item
                labels += [kind] * len(item)
        for words_of, kind, odds in ((prose, "O", 0.6), (spelled, "email", 0.4), (lambda: [letters(int(rng.integers(6, 24)))], "secret", 0.2), (prose, "O", 0.6)):
            if rng.random() < odds:
                if kind == "secret":
                    cue = pick(["password:"], ["Password:"], ["token:"], ["secret:"], ["passwd="], ["password", "="], ["password", ":"])
                    words += cue
                    labels += ["O"] * len(cue)
                item = words_of()
                words += item
                labels += [kind] * len(item)
        words.append(plain())
        labels.append("O")
        out.append((words, labels))
    return out


def fit(rows: list[tuple[list[str], list[str]]]) -> Field:
    words = Words([" ".join(w).encode() for w, _ in rows])
    labels = np.array([LABELS.index(x) for _, row in rows for x in row])
    which, fresh = _runs(words)
    return train(features(words, which), labels[which], fresh)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_table())


_TRIM = " \t\n\r.,;:!?\"'<>()[]{}%#$*&|="


def find_spans(texts: list[bytes | None], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text the patterns' spans, and those that the field adds."""
    words = Words(texts)
    _, fresh = _runs(words)
    base: dict[int, list] = {}
    added: dict[int, list] = {}
    for r, text in enumerate(texts):
        if text and _HARD.search(text) and (found := base_spans(text.decode())):
            base[r] = found
    label = field.label(words)
    head = np.ones(len(label), bool)
    head[1:] = fresh[1:] | (label[1:] != label[:-1])
    head = np.flatnonzero(head)
    tail = np.append(head[1:], len(label)) - 1
    keep = label[head] > 0
    head, tail = head[keep], tail[keep]
    row = words.row[head]
    begin, end = words.begin[head], words.end[tail]
    for k, r, b, e, pb in zip(label[head].tolist(), row.tolist(), begin.tolist(), end.tolist(), words.place(begin, row).tolist(), strict=True):
        text = words.data[b:e].tobytes().decode()
        cut = text.lstrip(_TRIM if LABELS[k] != "phone" else _TRIM.replace("(", ""))
        pb += len(text) - len(cut)
        cut = cut.rstrip(_TRIM)
        if LABELS[k] == "email" and "@" not in cut and not _SPELLED.search(cut):
            continue
        if cut and not any(s < pb + len(cut) and pb < e2 for _, s, e2 in base.get(r, ())):
            added.setdefault(r, []).append((LABELS[k], pb, pb + len(cut)))
    return [(base.get(r, []), added.get(r, [])) for r in range(len(texts))]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_BATCH_BYTES = 1 << 20


def _parts_of(texts: list[bytes | None]):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= _BATCH_BYTES:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    yield texts[first:]


def find(docs: DataFrame, *, field: Field | None = None, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs' columns (or those in keep) with base and added (or as in names): arrays of (kind, start, end)."""
    field = field or default_field()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    df = docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))

    def run(batches):
        for b in batches:
            found = [x for part in _parts_of(texts_of(b, b.schema.names[-1])) for x in find_spans(part, field)]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[k]] for x in found], pa.list_(_SPAN)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *names])

    span = "array<struct<kind:string,start:int,end:int>>"
    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], *StructType.fromDDL(f"`{names[0]}` {span}, `{names[1]}` {span}").fields]))


def _joined(spans):
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*map(F.lit, KINDS))
    key = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("n"))))
    return F.concat_ws(",", F.transform(key, lambda s: F.concat_ws(":", s["n"], s["s"].cast("string"), s["e"].cast("string"))))


def digest(found: DataFrame, id_col: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "added")
    return found.select(id_col, *map(count, KINDS[:4]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets; of overlapping spans the first, then the longest, counts."""
    base, added = names = (free_name(docs.columns, "base"), free_name(docs.columns, "added"))
    found = find(docs, text_col=text_col, names=names, **options)
    spans = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("s"), (-s["end"]).alias("e"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col(text_col)
    step = lambda acc, s: F.when(s["s"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["s"] - acc["at"]), F.lit("<"), s["k"], F.lit(">")).alias("out"), (-s["e"]).alias("at")))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(*names)
