"""Personal data in free text: a linear-chain conditional random field over word shapes, decoded in numpy batches."""

from __future__ import annotations

import base64
import hashlib
import os
import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessellar.llm import pii_table
from tessellar.session import shared_dir

KINDS = ("person", "email", "phone", "address", "id_number")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
L = len(LABELS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
# Letters or digits with what joins them inside a word; line breaks; any other mark alone.
TOKEN = re.compile(r"\+?[^\W_]+(?:[._+@’'\-]+[^\W_]+)*|\n|[^\s]")
_EMAIL = re.compile(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+")
_SHOUTED_BEFORE = re.compile(r"\b[A-Z]+\s+\Z")
_SHOUTED_AFTER = re.compile(r"\s+[A-Z]{2,}\b")
_TITLED = re.compile(rf"\b(?:{'|'.join([*pii_table.TITLES, 'm', 'dra'])})\.?\s*\Z", re.I)

# Words that announce what follows.
PHONE_WORDS = frozenset("tel tél telefon telefonisch phone call ring fax appeler appelez llamar llámame erreichbar anrufen mobil mobile cell handy portable móvil teléfono tfno téléphone whatsapp dial text pager hotline number nummer numéro número drop x ext extension durchwahl poste".split())
ID_WORDS = frozenset("ssn passport passeport pasaporte tax id nino ni tin national dni nie nif identifikationsnummer steuer-id steuernummer ausweisnr personalausweis reisepass nr n n° no sécurité sociale social security seguridad file identité identity licence license card carte card insurance permit permis cédula carné".split())
# Those of them that announce across a few words, and how compounds of them begin.
PHONE_CUES = frozenset("tel tél telefon phone call ring fax mobile mobil cell handy portable móvil teléfono tfno téléphone whatsapp dial appelez appeler llamar llámame ruf erreichbar joignable hotline pager".split())
ID_CUES = frozenset("ssn passport passeport pasaporte tax nino ni tin dni nie nif social sociale security sécurité seguridad insurance identity identité licence license permis permit cédula carné fiscal taxpayer".split())
ID_STEMS = ("steuer", "ausweis", "personalausweis", "reisepass", "passnummer", "sozialversicherung", "führerschein")
UNIT_WORDS = frozenset("apt flat suite unit apartment bajo bis ter p.o po box postfach bp apartado".split())
ORG_WORDS = frozenset("university universität université universidad institute institut instituto college hospital museum library bank airport foundation society press group company agency committee laboratory school ministry station stadium theatre council church hotel academy centre center gmbh ltd inc sons hochschule".split())
METHOD_WORDS = frozenset("method theorem distribution thermostat barostat integrator equation algorithm potential test transform coupling scheme ensemble constant matrix index coefficient procedure model correction constraint plot radius limit rule filter sum effect criterion approximation kernel network chain field statistic expansion series function window sampler bound number scattering parameters chains verfahren et al".split())
RESIDUES = frozenset("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL LIG HOH".split())
_GIVEN = frozenset(g.lower() for g in pii_table.GIVEN)
_PUNCT = {c: f"p{c}" for c in ".,;:@()[]<>\"'-/#`=?+|{}*"}
LEXICONS = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
REACH = 12  # words across which a cue announces


@dataclass(frozen=True)
class Lexicon:
    """Which words are ordinary (the table's own, and those that a public tokenizer holds in lower case first) and which
    are held with a capital first."""

    ordinary: frozenset[str]
    proper: frozenset[str]


def lexicon(vocabularies: Sequence[str] = LEXICONS) -> Lexicon:
    """From the ranks of whole words in public tokenizers' vocabularies; a file that isn't there adds nothing."""
    ordinary, proper = set(pii_table.table_words()), set()
    for path in vocabularies:
        try:
            with open(path, "rb") as f:
                entries = [bytes.split(line) for line in f]
        except OSError:
            continue
        ranks: dict[str, int] = {}
        for code, rank in entries:
            try:
                word = base64.b64decode(code).decode()
            except UnicodeDecodeError:
                continue
            if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                ranks[word[1:]] = int(rank)
        for word, rank in ranks.items():
            low = word.lower()
            first = min(ranks.get(low.title(), 1 << 30), ranks.get(low.upper(), 1 << 30))
            if word == low and rank < first:
                ordinary.add(low)
            elif word == low.title() and rank < ranks.get(low, 1 << 30):
                proper.add(low)
    return Lexicon(frozenset(ordinary), frozenset(proper - ordinary))


def shape(token: str) -> str:
    """Case and digit pattern: runs of letters shortened, runs of digits kept up to nine."""
    out = re.sub(r"[^\W\d_a-z]", "A", token) if token.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    out = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", out))
    return re.sub(r"A{2,}", "AA", out)[:24]


def token_class(token: str, words: Lexicon, listed: bool = True) -> str:
    """A coarse class for pairs and triples of neighbours; without ``listed`` the list of given names isn't looked at."""
    low = token.lower()
    if token == "\n":
        return "nl"
    if len(token) == 1 and not token.isalnum():
        return _PUNCT.get(token, "p?")
    if token.isdigit():
        n = len(token)
        return f"d{n}" if n <= 5 else "d7" if n <= 7 else f"d{min(n, 11)}"
    if "@" in token:
        return "mail" if _EMAIL.fullmatch(token) else "user@host"
    if low in pii_table.TITLES:
        return "title"
    if listed and low in _GIVEN:
        return "GIVEN" if token.isupper() else "given" if token[0].isupper() else "w"
    if low in ("at", "dot"):
        return low
    if low in pii_table.STREET_BEFORE:
        return "street<"
    if low in pii_table.STREET_AFTER and token[0].isupper():
        return "street>"
    if low.endswith(pii_table.STREET_ENDINGS) and token[0].isupper() and len(low) > 5:
        return "street="
    if low in UNIT_WORDS:
        return "unit"
    if low in PHONE_WORDS:
        return "phone:"
    if low in ID_WORDS or low.startswith(ID_STEMS):
        return "id:"
    if low in ORG_WORDS:
        return "org"
    if low in METHOD_WORDS:
        return "method"
    if any(c.isdigit() for c in token):
        if not any(c.isalpha() for c in token):
            return "num" + re.sub(r"[^.+\-]", "", token)[:3] if "." in token and token.count(".") == 1 else "sep" + str(min(sum(c.isdigit() for c in token), 12))
        return "mix.lower" if token == low else "mix" + str(min(len(token), 10))
    if token in RESIDUES:
        return "residue"
    joined = any(c in "._+-" for c in token)
    if token == low:
        return "low.joined" if joined else "w" if low in words.ordinary else "low"
    if len(token) == 1:
        return "A"
    if token.isupper():
        return "AA.known" if low in words.ordinary else "AA.joined" if joined else "AA"
    return "Cap.known" if low in words.ordinary else "Cap.joined" if joined else "Cap.proper" if low in words.proper else "Cap"


def cue(token: str) -> int:
    """1 for a word that announces an identity number, 2 for a phone number, else 0."""
    low = token.lower()
    return 1 if low in ID_CUES or low.startswith(ID_STEMS) else 2 if low in PHONE_CUES else 0


def announced(cues: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """0..15 for each token: how far back, in four steps up to REACH words, the last cue of either kind stands in its text."""
    at = np.arange(len(cues))
    start = np.maximum.accumulate(np.where(breaks, at, -1))
    out = np.zeros(len(cues), np.int64)
    for kind, weight in ((1, 4), (2, 1)):
        last = np.maximum.accumulate(np.where(cues == kind, at, -1))
        gap = np.where((last > start) & (last < at), at - last, REACH + 1)
        out += weight * np.where(gap <= 3, 1, np.where(gap <= 7, 2, np.where(gap <= REACH, 3, 0)))
    return out


def token_features(token: str, words: Lexicon, listed: bool = True) -> tuple[str, tuple[str, ...]]:
    low, c = token.lower(), token_class(token, words, listed)
    features = [f"c={c}", f"s={shape(token)}", f"n={min(len(token), 12) if token.isalpha() else 0}"]
    if digits := sum(x.isdigit() for x in token):
        features.append(f"d={min(digits, 14)}")
    if low in table_words():
        features.append(f"w={low}")
    return c, tuple(features)


@lru_cache(maxsize=1)
def table_words() -> frozenset[str]:
    """Words that may weigh by themselves: the grammar's own."""
    return frozenset(pii_table.table_words() | PHONE_WORDS | ID_WORDS | UNIT_WORDS | set(pii_table.TITLES) | set(pii_table.STREET_BEFORE))


class Model:
    """Weights by feature and offset, by neighbouring classes and cues, and between labels."""

    def __init__(self, words: Lexicon):
        self.words = words
        self.features: dict[str, int] = {}
        self.classes: dict[str, int] = {"": 0}
        self.grams: dict[tuple[int, int], int] = {}

    def learn(self, tokens: list[str], rng: np.random.Generator, forget: float) -> tuple[list[tuple[int, ...]], list[int]]:
        """Ids of a text's tokens: feature rows and class rows. The word itself is left out of a share of the tokens, and
        half of the given names aren't looked up, so that shape and surroundings carry weight of their own."""
        feats, classes = [], []
        for t, dropped, unlisted in zip(tokens, rng.random(len(tokens)) < forget, rng.random(len(tokens)) < 0.5, strict=True):
            c, names = token_features(t, self.words, not unlisted)
            feats.append(tuple(self.features.setdefault(n, len(self.features)) for n in names if not (dropped and n.startswith("w="))))
            classes.append(self.classes.setdefault(c, len(self.classes)))
        if len(self.classes) > 256:
            raise ValueError("more than 256 token classes")
        return feats, classes


def _grams(classes: list[int], cues: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """Keys (kind, packed classes) of the pairs and the triple around each place, and of its class and what announces it."""
    c, said = [0, *classes, 0], announced(cues, np.zeros(len(cues), bool)).tolist()
    return [((0, c[i - 1] << 8 | c[i]), (1, c[i] << 8 | c[i + 1]), (2, c[i - 1] << 16 | c[i] << 8 | c[i + 1]), (3, said[i - 1] << 8 | c[i])) for i in range(1, len(c) - 1)]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def bio(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    tokens, labels = [], []
    for m in TOKEN.finditer(text):
        hit = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1]), None)
        first = hit is not None and text[hit[0] : m.start()].strip() == ""
        tokens.append(m.group())
        labels.append(0 if hit is None else 1 + 2 * KINDS.index(hit[2]) + (0 if first else 1))
    return tokens, labels


def train(
    examples: list[tuple[str, list[tuple[int, int, str]]]], vocabularies: Sequence[str] = LEXICONS, epochs: int = 14, batch: int = 128, rate: float = 0.1, decay: float = 1.5e-4, forget: float = 0.3, seed: int = 5
) -> Model:
    """Maximum conditional likelihood by forward-backward and Adam, on a bounded table (a few thousand rows)."""
    model, rng = Model(lexicon(vocabularies)), np.random.default_rng(seed)
    rows = []
    for text, spans in examples:
        tokens, labels = bio(text, spans)
        if tokens:
            feats, classes = model.learn(tokens, rng, forget)
            rows.append((feats, _grams(classes, np.array([cue(t) for t in tokens])), labels))
    n_features = len(model.features)
    for _, grams, _ in rows:
        for keys in grams:
            for k in keys:
                model.grams.setdefault(k, len(model.grams))
    base = n_features * len(OFFSETS)
    total = base + len(model.grams) + 1  # the last row is padding
    width = max(len(f) for feats, _, _ in rows for f in feats)
    data = []
    for feats, grams, labels in rows:
        n = len(labels)
        ids = np.full((n, len(OFFSETS) * width + 4), total - 1)
        for i in range(n):
            col = 0
            for o, off in enumerate(OFFSETS):
                if 0 <= i + off < n:
                    f = feats[i + off]
                    ids[i, col : col + len(f)] = [o * n_features + x for x in f]
                col += width
            ids[i, -4:] = [base + model.grams[k] for k in grams[i]]
        data.append((ids, np.array(labels)))
    w, t = np.zeros((total, L)), np.zeros((L + 1, L))  # the last row of t: at the start
    moments = [np.zeros_like(x) for x in (w, w, t, t)]
    step, mean_w, mean_t, kept = 0, np.zeros_like(w), np.zeros_like(t), 0
    order = sorted(range(len(data)), key=lambda i: len(data[i][1]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            step += 1
            part = [data[i] for i in groups[g]]
            gw, gt = _gradient(part, w, t, total)
            for x, grad, m, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
                grad = grad / len(part) + decay * x
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                x -= rate * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w[-1] = 0
            if epoch >= epochs // 2:  # the mean of the later steps is steadier than the last one
                mean_w, mean_t, kept = mean_w + w, mean_t + t, kept + 1
    w, t = mean_w / max(kept, 1), mean_t / max(kept, 1)
    model.weights, model.transitions, model.start = w.astype(np.float32), t[:L].astype(np.float32), t[L].astype(np.float32)
    return model


def _gradient(part: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, t: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts of a batch."""
    b, steps = len(part), max(len(y) for _, y in part)
    ids = np.full((b, steps, part[0][0].shape[1]), total - 1)
    y, mask = np.zeros((b, steps), np.int64), np.zeros((b, steps), bool)
    for i, (x, labels) in enumerate(part):
        ids[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = x, labels, True
    emit = w[ids].sum(axis=2)
    alpha, beta = np.zeros((b, steps, L)), np.zeros((b, steps, L))
    alpha[:, 0] = emit[:, 0] + t[L]
    for s in range(1, steps):
        new = _logsumexp(alpha[:, s - 1, :, None] + t[None, :L], 1) + emit[:, s]
        alpha[:, s] = np.where(mask[:, s, None], new, alpha[:, s - 1])
    for s in range(steps - 2, -1, -1):
        new = _logsumexp(t[None, :L] + (emit[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        beta[:, s] = np.where(mask[:, s + 1, None], new, 0)
    z = _logsumexp(alpha[:, -1], 1)
    p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    p[np.arange(b)[:, None], np.arange(steps)[None], y] -= mask
    gt = np.zeros_like(t)
    gt[L] = p[:, 0].sum(0)
    for s in range(1, steps):
        on = mask[:, s]
        if on.any():
            pair = np.exp(alpha[on, s - 1, :, None] + t[None, :L] + (emit[on, s] + beta[on, s])[:, None, :] - z[on, None, None])
            gt[:L] += pair.sum(0)
            np.subtract.at(gt, (y[on, s - 1], y[on, s]), 1)
    flat, rows = ids[mask], p[mask]
    gw = np.stack([np.bincount(flat.ravel(), np.repeat(rows[:, k], flat.shape[1]), total) for k in range(L)], axis=1)
    return gw, gt


class Decoder:
    """Emission tables for token types met so far, and Viterbi over batches of segments."""

    CACHE = 300_000

    def __init__(self, model: Model):
        self.model = model
        nf, no = len(model.features), len(OFFSETS)
        self.by_offset = model.weights[: nf * no].reshape(no, nf, L)
        k = 256
        gram_rows = model.weights[nf * no :]
        self.gram_table = []
        for kind, size in ((0, k * k), (1, k * k), (3, 16 * k)):
            table = np.zeros((size, L), np.float32)
            for (g, key), i in model.grams.items():
                if g == kind:
                    table[key] = gram_rows[i]
            self.gram_table.append(table)
        self.n_classes = len(model.classes)
        c = self.n_classes
        self.triple = np.full(c * c * c, len(model.grams), np.int32)
        for (g, key), i in model.grams.items():
            if g == 2:
                self.triple[((key >> 16) * c + (key >> 8 & 255)) * c + (key & 255)] = i
        self.gram_rows = gram_rows
        self.types: dict[tuple, int] = {}
        self.cache: dict[str, int] = {}
        self.class_of, self.cue_of = [0], [0]
        self.tables = [np.zeros((1, L), np.float32) for _ in OFFSETS]  # type 0: outside a document
        self.fresh: list[tuple[int, ...]] = []
        t = model.transitions
        self.gain = (t.max(axis=0) - t[0, 0]).astype(np.float64)  # the most that stepping into each label can add over O
        self.leave = float((t[1:, 0] - t[0, 0]).max())

    def type_of(self, token: str) -> int:
        c, names = token_features(token, self.model.words)
        f, said = self.model.features, cue(token)
        key = (c, said, *(f[n] for n in names if n in f))
        at = self.types.get(key)
        if at is None:
            at = self.types[key] = len(self.types) + 1
            self.class_of.append(self.model.classes.get(c, 0))
            self.cue_of.append(said)
            self.fresh.append(key[2:])
        if len(self.cache) >= self.CACHE:
            self.cache.clear()
        self.cache[token] = at
        return at

    def grow(self) -> None:
        if self.fresh:
            for o in range(len(OFFSETS)):
                rows = np.stack([self.by_offset[o, list(k)].sum(axis=0) for k in self.fresh])
                self.tables[o] = np.concatenate([self.tables[o], rows])
            self.fresh = []

    def emissions(self, types: np.ndarray) -> np.ndarray:
        n = len(types)
        padded = np.concatenate([np.zeros(3, np.int64), types, np.zeros(3, np.int64)])
        out = self.tables[3][types]
        for o, off in enumerate(OFFSETS):
            if off:
                out += self.tables[o][padded[3 + off : 3 + off + n]]
        classes = np.array(self.class_of, np.int64)[padded]
        a, b, c = classes[2 : 2 + n], classes[3 : 3 + n], classes[4 : 4 + n]
        out += self.gram_table[0][a << 8 | b]
        out += self.gram_table[1][b << 8 | c]
        out += self.gram_rows[self.triple[(a * self.n_classes + b) * self.n_classes + c]]
        out += self.gram_table[2][announced(np.array(self.cue_of, np.int8)[types], types == 0) << 8 | b]
        out[types == 0] = -1e4
        out[types == 0, 0] = 0
        return out

    def label(self, types: np.ndarray) -> np.ndarray:
        """Best labels of the concatenated documents (type 0 parts them).

        A run of labels other than O on the best path can't be worth less than O all along it. What a token can add to such
        a run is bounded by its own emissions and the best step into each label; a token around which no window of these
        bounds, with the step out of the run, comes to 0 is O on the best path. The path falls apart there, so only the
        stretches between such tokens are decoded.
        """
        emit = self.emissions(types)
        most = (emit[:, 1:] + self.gain[1:]).max(axis=1) - emit[:, 0]
        total = np.concatenate([[0.0], np.cumsum(most)])
        left = total[1:] - np.minimum.accumulate(total[:-1])
        right = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        sure = (left + right - most + self.leave < -1e-3) | (types == 0)
        labels = np.zeros(len(types), np.int8)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return labels
        breaks = np.flatnonzero(np.diff(open_) > 1) + 1
        starts, ends = open_[np.concatenate([[0], breaks])], open_[np.concatenate([breaks - 1, [len(open_) - 1]])] + 1
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            longest = lengths[order[i]]
            top = max(8, int(longest * 1.3))
            j = int(np.searchsorted(lengths[order], top, "right"))
            j = max(min(j, i + max(1, 400_000 // max(top, 1))), i + 1)
            part = order[i:j]
            self._viterbi(emit, starts[part], lengths[part], labels)
            i = j
        return labels

    def _viterbi(self, emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> None:
        b, steps = len(starts), int(lengths.max())
        t = self.model.transitions
        score = emit[starts] + t[0][None]  # what stands before is O
        back = np.zeros((steps, b, L), np.int8)
        final = score + t[:, 0][None]
        last = np.where((lengths == 1)[:, None], final, 0)
        into = np.ascontiguousarray(t.T)
        for s in range(1, steps):
            on = lengths > s
            k = int(np.argmax(on)) if not on[0] else 0  # lengths ascend: those still running are the tail
            best, at = _best_before(score[k:], into)
            back[s, k:] = at
            score[k:] = best + emit[starts[k:] + s]
            ending = lengths == s + 1
            if ending.any():
                last[ending] = score[ending] + t[:, 0][None]
        state = last.argmax(axis=1)
        for s in range(steps - 1, -1, -1):
            on = lengths > s
            labels[starts[on] + s] = state[on]
            state = np.where(on, back[s, np.arange(b), state], state)


def _best_before(score: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of reaching each label and the label before it; label by label where there are many rows."""
    if len(score) < 48:
        x = score[:, None, :] + into[None]
        return x.max(axis=2), x.argmax(axis=2)
    best, at = score[:, :1] + into[:, 0], np.zeros((len(score), L), np.int8)
    for k in range(1, L):
        x = score[:, k : k + 1] + into[:, k]
        np.copyto(at, k, where=x > best)
        np.maximum(best, x, out=best)
    return best, at


def _checked(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without surrounding punctuation if it can be such a mention, else None."""
    while a < b and (text[a].isspace() or not (text[a].isalnum() or (text[a] in "+(" and kind == "phone"))):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    s = text[a:b]
    if kind == "phone" and s.startswith("(") and ")" not in s:
        a, s = a + 1, s[1:]
    digits = sum(c.isdigit() for c in s)
    if kind == "person" and s.isupper() and (_SHOUTED_BEFORE.search(text, max(0, a - 24), a) or _SHOUTED_AFTER.match(text, b)):
        return None  # part of a sentence in capitals
    good = {
        "email": "@" in s or bool(re.search(r"\bat\b.*\bdot\b|\(at\)|\[at\]", s, re.I | re.S)),
        "phone": 7 <= digits <= 20,
        "id_number": digits >= 5,
        "address": digits >= 1 and any(c.isalpha() for c in s),
        "person": digits == 0 and any(c.isupper() for c in s) and len(s) > 2 and (len(s.split()) > 1 or bool(_TITLED.search(text, max(0, a - 16), a))),
    }[kind]
    return (a, b) if good and a < b else None


def mentions(texts: list[str], decoder: Decoder) -> Iterator[tuple[int, str, int, int]]:
    """(index of the text, kind, start, end) of every mention."""
    types: list[int] = []
    starts = []
    get = decoder.cache.get
    for text in texts:
        starts.append(len(types))
        tokens = TOKEN.findall(text)
        found = list(map(get, tokens))
        if None in found:
            found = [decoder.type_of(t) if at is None else at for t, at in zip(tokens, found, strict=True)]
        types += found
        types += (0, 0, 0)
    decoder.grow()
    labels = decoder.label(np.array(types, np.int64))
    hit = np.flatnonzero(labels)
    if not len(hit):
        return
    rows, found = hit.tolist(), labels[hit].tolist()
    document = (np.searchsorted(np.array(starts), hit, "right") - 1).tolist()
    places: list[tuple[int, int]] = []
    i, current = 0, -1
    while i < len(rows):
        kind = (found[i] - 1) // 2
        j = i + 1
        while j < len(rows) and rows[j] == rows[j - 1] + 1 and found[j] == 2 * kind + 2:
            j += 1
        d = document[i]
        if d != current:  # places are worked out only for texts with mentions
            current, places = d, [m.span() for m in TOKEN.finditer(texts[d])]
        span = _checked(KINDS[kind], texts[d], places[rows[i] - starts[d]][0], places[rows[j - 1] - starts[d]][1])
        if span:
            yield d, KINDS[kind], *span
        i = j


@lru_cache(maxsize=2)
def default_model(copies: int = 22, seed: int = 11, vocabularies: Sequence[str] = LEXICONS) -> Model:
    """Trained from the table of ``copies`` rows a template."""
    return train(pii_table.labelled(copies, seed), vocabularies)


@lru_cache(maxsize=1)
def _fingerprint() -> str:
    parts = hashlib.sha256()
    for module in (__file__, pii_table.__file__, *LEXICONS):
        try:
            with open(module, "rb") as f:
                parts.update(f.read())
        except OSError:
            parts.update(b"-")
    return parts.hexdigest()[:24]


_KEPT: dict[str, Model] = {}


def stored_model(spark: SparkSession) -> Model:
    """The default model, trained once for a shared folder: it is kept there under a name made from the table, the code and
    the vocabularies, and read back by later processes."""
    name = _fingerprint()
    if name not in _KEPT:
        path = os.path.join(shared_dir(spark), f"personal-data-{name}")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            _KEPT[name] = pickle.loads(spark.read.parquet(path).first()[0])
        else:
            _KEPT[name] = default_model()
            spark.createDataFrame([(bytearray(pickle.dumps(_KEPT[name])),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _KEPT[name]


CHUNK_CHARS = 1_000_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts, up to a number of characters at a time; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, kind, start_pos, end_pos of every mention in the whole of every text.

    Null and empty texts have none; equal texts under other ids each give theirs; other columns are ignored. The model is
    broadcast (a few MB, bounded by the labelled table); one narrow pass whose memory is bounded by a chunk of texts or,
    if it is longer, one text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or stored_model(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for ids, texts in _chunks(batches):
            rows = [(ids[d], k, a, b) for d, k, a, b in mentions([t or "" for t in texts], decoder)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "kind", "start_pos", "end_pos"])

    return documents.select(id_col, text_col).mapInArrow(run, "doc_id long, kind string, start_pos int, end_pos int")


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id and text with every mention replaced by its kind's placeholder, the rest left as it is; null stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(model or stored_model(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for ids, texts in _chunks(batches):
            out: list[list[str]] = [[] for _ in texts]
            reached = [0] * len(texts)
            for d, kind, a, b in mentions([t or "" for t in texts], decoder):
                out[d] += [texts[d][reached[d] : a], PLACEHOLDERS[kind]]
                reached[d] = b
            clean = [None if t is None else "".join([*out[d], t[reached[d] :]]) for d, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return documents.select(id_col, text_col).mapInArrow(run, "doc_id long, text string")
