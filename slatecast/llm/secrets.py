"""Secret scans (operator 7): base rules, and a character convolutional network over every other candidate.

Base findings are those of three patterns: assignments to names like ``password``, access key ids, and long runs
of lower-case hex. They always stay. A candidate is a run of 12 or more of ``A-Za-z0-9+/_.=-`` that no base finding
touches, with a letter and a digit, or with letters of both cases, or with a letter and ``_LONG`` characters; shorter and
plainer runs are words and numbers. The network sees the candidate and the characters around it; a candidate longer than its field it sees in overlapping
windows, of which the highest score counts. Candidates scored at or over the threshold are added, as kind ``model``.

The network is trained on the driver, in numpy, on labelled findings drawn from fixed seeds: ``most`` made ones, half of
them keys of several families, half harmless runs (words, paths, addresses, versions, UUIDs, file digests, numbers);
and at most ``most`` findings of the base rules from the sampled texts as keys, half of the time without the words around them
and with their shape masked in turn (the key name goes, hex digits are redrawn from other alphabets). What the base rules don't
find in the corpus has no label and isn't learned from; but harmless runs are put together from the words of at most
11 small letters, ``_WORDS`` or so, of the first of these texts, besides made ones. It trains on windows (``_SHOWN`` at most of a candidate),
each labelled by whether it holds what makes the candidate a finding.

Whole families of keys and of harmless runs are held out: they calibrate, by their highest windows. Scores are scaled to
probabilities, and the threshold is the highest that keeps a recall of ``recall`` on each family of keys, so
the recall asked for is one on keys unlike those learned from.

Cases: null text counts as empty and has no findings. Offsets count code points, ends are exclusive. Spans of
one start are in the order of the kinds. Repeated rows are scanned alike. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, pieces

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LETTER, _LOW, _HIGH, _DIGIT = (re.compile(p) for p in ("[A-Za-z]", "[a-z]", "[A-Z]", "[0-9]"))
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
_WORD, _WORDS = re.compile(r"(?<![A-Za-z])[a-z]{2,11}(?![A-Za-z])"), 5000
_DRAWN, _PASSAGES = 50, 20
_NAMES = ("password", "passwd", "secret", "token", "api")
_LEFT, _FIELD, _RIGHT = 20, 40, 8
_STEP, _LONG, _SHOWN = 20, 20, 8
_WIDTH = _LEFT + _FIELD + _RIGHT
_CODES = 98  # 0 pads, 1 to 95 printable ASCII, 96 other letters, 97 the rest


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, kinds by their place in ``KINDS``."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if _LETTER.search(run) and (len(run) >= _LONG or _DIGIT.search(run) or _LOW.search(run) and _HIGH.search(run)):
            found.append((m.start(), m.end()))
    return found


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows of the field's width over a candidate, ``_STEP`` apart; the last ends with it."""
    if end - start <= _FIELD:
        return [(start, end)]
    return [(a, a + _FIELD) for a in (*range(start, end - _FIELD, _STEP), end - _FIELD)]


def _free(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether no base finding overlaps each span."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        out.append(reach <= a)
    return out


def _codes(s: str) -> list[int]:
    return [o - 31 if 32 <= o < 127 else 96 if c.isalpha() else 97 for c in s for o in (ord(c),)]


def view(text: str, start: int, end: int, bare: bool = False) -> np.ndarray:
    """What the network sees of a window (the first, of a longer span): characters before it, its own, and characters after it."""
    end = min(end, start + _FIELD)
    out = np.zeros(_WIDTH, dtype=np.int64)
    if not bare:
        left, right = _codes(text[max(0, start - _LEFT) : start]), _codes(text[end : end + _RIGHT])
        out[_LEFT - len(left) : _LEFT] = left
        out[_LEFT + _FIELD : _LEFT + _FIELD + len(right)] = right
    out[_LEFT : _LEFT + end - start] = _codes(text[start:end])
    return out


_PARTS = ((0, _LEFT), (_LEFT, _LEFT + _FIELD), (_LEFT + _FIELD, _WIDTH))


@dataclass
class Network:
    """Character embeddings, one convolution, its maximum over each part of the view and its mean over the candidate, and a logistic unit."""

    width: int = 10
    filters: int = 32
    reach: int = 5
    seed: int = 3
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        k = self.reach * self.width
        self.w = {"embed": rng.normal(0, 0.5, (_CODES, self.width)), "conv": rng.normal(0, (2 / k) ** 0.5, (k, self.filters)), "bias": np.zeros(self.filters), "out": rng.normal(0, 0.1, 4 * self.filters), "last": np.zeros(1)}
        self.w = {k: a.astype(np.float32) for k, a in self.w.items()}

    def _forward(self, x: np.ndarray) -> tuple:
        pad = np.pad(x, ((0, 0), (self.reach // 2, self.reach // 2)))
        seen = np.lib.stride_tricks.sliding_window_view(pad, self.reach, axis=1)
        flat = self.w["embed"][seen].reshape(len(x), _WIDTH, -1)
        act = np.maximum(flat @ self.w["conv"] + self.w["bias"], 0)
        best = [act[:, a:b].argmax(axis=1) + a for a, b in _PARTS]
        rows = np.arange(len(x))[:, None]
        own = x[:, _LEFT : _LEFT + _FIELD] > 0
        share = (own / np.maximum(own.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        inner = act[:, _LEFT : _LEFT + _FIELD]
        mean = np.matmul(share[:, None, :], inner)[:, 0]
        pooled = np.concatenate([*(act[rows, p, np.arange(self.filters)] for p in best), mean], axis=1)
        return seen, flat, best, pooled, pooled @ self.w["out"] + self.w["last"], share, inner

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -500, 500)))

    def _by_code(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by character code."""
        codes = codes.reshape(-1)
        return np.stack([np.bincount(codes, rows[:, k], _CODES) for k in range(self.width)], axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 3e-3) -> None:
        """Adam on the logistic loss."""
        self.start()
        rng, step, steps = np.random.default_rng(self.seed), 0, epochs * -(-len(x) // size)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), size):
                at = order[i : i + size]
                seen, flat, best, pooled, logit, share, inner = self._forward(x[at])
                error = ((1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[at]) / len(at)).astype(np.float32)
                grad = {k: np.zeros_like(a) for k, a in self.w.items()}
                grad["out"], grad["last"] = pooled.T @ error, np.array([error.sum()])
                back = np.outer(error, self.w["out"])
                spread = (share[:, :, None] * back[:, None, 3 * self.filters :]) * (inner > 0)
                back = back * (pooled > 0)
                whole = flat[:, _LEFT : _LEFT + _FIELD]
                grad["bias"] += spread.sum(axis=(0, 1))
                grad["conv"] += np.tensordot(whole, spread, axes=((0, 1), (0, 1)))
                lower = (spread @ self.w["conv"].T).reshape(-1, self.width)
                grad["embed"] += self._by_code(seen[:, _LEFT : _LEFT + _FIELD], lower)
                for p, place in enumerate(best):
                    part = back[:, p * self.filters : (p + 1) * self.filters]
                    grad["bias"] += part.sum(axis=0)
                    chosen = flat[np.arange(len(at))[:, None], place]
                    grad["conv"] += np.einsum("nfk,nf->kf", chosen, part)
                    lower = (part[:, :, None] * self.w["conv"].T[None]).reshape(-1, self.width)
                    grad["embed"] += self._by_code(seen[np.arange(len(at))[:, None], place], lower)
                step += 1
                for k, g in grad.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, groups: np.ndarray, recall: float) -> None:
        """Scale logits to probabilities, then set the threshold that keeps the recall in every group of positives."""
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            a, b = a - 0.05 * float(((p - y) * z).mean() / (1 + (z * z).mean())), b - 0.5 * float((p - y).mean())
        self.scale = (max(a, 1e-3), b)
        p = self.scaled(z)
        lows = [np.sort(p[(y == 1) & (groups == g)]) for g in np.unique(groups[y == 1])]
        self.threshold = float(min((s[int((1 - recall) * len(s))] for s in lows if len(s)), default=1.0))


_LOWER, _UPPER, _NUMBER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ONSETS = "b br bl c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p ph pl pr qu r s sc sch schl schw sh sk sl sm sn sp spr st str t th tr tw v w wh z zw".split()
_VOWELS = "a e i o u a e i o e ai au ea ee ei eu ia ie io oa oo ou y".split()
_CODAS = " , , , ,b,ck,ct,ch,cht,d,ft,g,gh,l,ld,ll,lt,m,mp,n,nd,ng,nk,ns,nt,p,r,rd,rk,rm,rn,rs,rt,s,sh,sk,ss,st,t,th,tion,tz,x,ft".replace(" ", "").split(",")
_SYLLABLES = "th er on an re he in ed nd ha at en es of or de la un ser vic ok con fig ur ation li ver now re port ing data ba se ac count man age ment user col lec tion schul ver wal tung ent wick lung cion sar rol pro gram me".split()


class _Draw:
    """Made candidates by family; each method gives one run."""

    def __init__(self, seed: int, vocabulary: Sequence[str] = ()):
        self.rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary

    def one(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def letters(self, alphabet: str, least: int, most: int) -> str:
        return "".join(alphabet[k] for k in self.rng.integers(0, len(alphabet), int(self.rng.integers(least, most + 1))))

    def word(self, least: int = 1, most: int = 4) -> str:
        """A word that can be said: common parts, syllables of any onset, vowel and coda, or words of the vocabulary."""
        n, out = int(self.rng.integers(least, most + 1)), ""
        while n > 0:
            kind = int(self.rng.integers(0, 3))
            n -= 1 + (kind == 0)
            out += self.one(self.vocabulary) if kind == 0 and self.vocabulary else self.one(_SYLLABLES) if kind == 1 else self.one(_ONSETS) + self.one(_VOWELS) + self.one(_CODAS)
        return out

    def number(self, most: int) -> str:
        return str(int(self.rng.integers(1, most)))

    # keys
    def base64(self) -> str:
        return self.letters(_LOWER + _UPPER + _NUMBER + "+/", 20, 64) + "=" * int(self.rng.integers(0, 3))

    def prefixed(self) -> str:
        return self.one(("pk", "key", "ghx", "live", "srv", "app", "v1", "ref")) + self.one("_-") + self.letters(_LOWER + _UPPER + _NUMBER, 18, 40)

    def high_hex(self) -> str:
        return self.letters("0123456789ABCDEF", 24, 48)

    def mixed(self) -> str:
        return self.letters(_LOWER + _UPPER + _NUMBER, 16, 40)

    def lower_digits(self) -> str:
        return self.letters(_LOWER + _NUMBER, 20, 40)

    def cases(self) -> str:
        return self.letters(_LOWER + _UPPER, 20, 44)

    def in_path(self) -> str:
        return self.one(("//", "")) + self.path(1, 5) + "/" + self.letters(_LOWER + _UPPER + _NUMBER, 20, 40) + self.one(("", "/" + self.word()))

    def dotted(self) -> str:
        return ".".join(self.letters(_LOWER + _UPPER + _NUMBER + "_-", 12, 40) for _ in range(3))

    def twice_prefixed(self) -> str:
        return self.one(("tk", "ab", "zz", "me")) + "_" + self.one(("test", "main", "prod")) + "_" + self.letters(_LOWER + _UPPER + _NUMBER, 20, 32)

    def grouped(self) -> str:
        return self.one("-_").join(self.letters(_UPPER + _NUMBER, 6, 6) for _ in range(int(self.rng.integers(3, 6))))

    def valued(self) -> str:
        return self.word() + "=" + self.letters(_LOWER + _UPPER + _NUMBER, 20, 36)

    def upper_digits(self) -> str:
        return self.letters(_UPPER + _NUMBER, 20, 32)

    # harmless runs
    def path(self, least: int = 3, most: int = 9) -> str:
        place = lambda: self.word() if self.rng.random() < 0.7 else self.letters(_UPPER + _NUMBER, 1, 1) + self.letters(_NUMBER, 1, 4)
        run = "".join(place() + "/-_."[k] for k in self.rng.choice(4, int(self.rng.integers(least, most + 1)), p=(0.5, 0.3, 0.1, 0.1))) + self.word()
        return self.one(("", "", "//", "/")) + run.replace("/", f"/{self.number(2030)}/0{self.number(9)}/", int(self.rng.random() < 0.2))

    def address(self) -> str:
        return f"{self.word(2, 4)}.{self.word()}{self.number(99)}.example.com"

    def compound(self) -> str:
        return "-".join(self.word(1, 3) for _ in range(int(self.rng.integers(2, 6)))) + self.one(("", "-" + self.number(2030)))

    def file(self) -> str:
        return f"{self.word()}/{self.word()}/{self.word(2, 4)}_{self.number(999)}.{self.one(('html', 'json', 'tar.gz', 'py'))}"

    def version(self) -> str:
        return f"v{self.number(20)}.{self.number(99)}.{self.number(99)}-{self.word()}.{self.number(9)}"

    def stamp(self) -> str:
        d = lambda n: self.letters(_NUMBER, n, n)
        return self.one((f"2{d(3)}-{d(2)}-{d(2)}T{d(2)}.{d(2)}Z", f"{d(4)}-{d(4)}-{d(4)}-{self.one('ABX')}", f"ISBN-{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"INV-{d(4)}-{d(8)}"))

    def long_word(self) -> str:
        return self.one((self.word(3, 9).capitalize(), self.word(4, 10), "".join(self.word(1, 3).capitalize() for _ in range(4)), self.word(1, 3) + "".join(self.word(1, 3).capitalize() for _ in range(3)), "_".join(self.word(1, 2).upper() for _ in range(4)), self.word(4, 6) + self.number(999)))

    def uuid(self) -> str:
        h = lambda n: self.letters("0123456789abcdef", n, n)
        out = f"{h(8)}-{h(4)}-{self.one('1457')}{h(3)}-{self.one('89ab')}{h(3)}-{h(12)}"
        return out.upper() if self.rng.random() < 0.3 else out

    def long_file(self) -> str:
        return f"{self.path(4, 9)}.{self.one(('html', 'txt', 'md', 'xml'))}"

    def snake(self) -> str:
        return "_".join(self.word(1, 3) for _ in range(int(self.rng.integers(3, 7)))) + self.one(("", "_" + self.number(99)))


_KEYS = ("base64", "prefixed", "twice_prefixed", "high_hex", "mixed", "lower_digits", "cases", "in_path", "grouped")
_HARMLESS = ("path", "address", "compound", "file", "version", "stamp", *["long_word"] * 5, "uuid", "uuid", "digest")
#: Families that only calibrate.
_HELD_KEYS, _HELD_HARMLESS = ("dotted", "valued", "upper_digits"), ("long_file", "snake")
_BEFORE = ("the ", "key: ", "Authorization: Bearer ", "auth=", "see ", "credential ", "export X=", "in ", "from ", '"', "(", "id ", "with ", "private_key ", "= ", "https:")
_DIGESTS = ("sha1 ", "sha256: ", "md5=", "checksum ", "digest: ", "etag ", "integrity ", "fingerprint ")


def made_findings(n: int, seed: int = 11, keys: tuple[str, ...] = _KEYS, harmless: tuple[str, ...] = _HARMLESS, vocabulary: Sequence[str] = (), around: Sequence[str] = ()) -> list[tuple[str, int, int, int, int, str]]:
    """(text, start, end, start and end of the key, family) of ``n`` made candidates, half of them keys; others have an empty key."""
    draw, out = _Draw(seed, vocabulary), []
    while len(out) < n:
        label = len(out) % 2
        family = draw.one(keys if label else harmless)
        before = draw.one(_BEFORE)
        if family == "digest":  # only the words around it say that it is harmless
            run, before = draw.letters("0123456789ABCDEF", 32, 64), draw.one(_DIGESTS)
        else:
            run = getattr(draw, family)()
        if candidates(run) != [(0, len(run))]:
            continue
        lead = f"{draw.word()} {draw.word()} {before}"
        after = draw.one((f" {draw.word()} {draw.word()}", f'" {draw.word()}', f"\n{draw.word()}", f", {draw.word()}"))
        if around and family != "digest" and draw.rng.random() < 0.6:  # between words of a real text
            page = draw.one(around)
            cut = page.find(" ", int(draw.rng.integers(0, max(1, len(page) - 100)))) + 1
            lead, after = page[max(0, cut - 60) : cut], draw.one((" ", "\n", ". ", ", ")) + page[cut : cut + 30]
        if family == "long_word" and draw.rng.random() < 0.4:  # runs end at other letters, too
            after = draw.one("éñäößüçèêà") + after
        if family == "long_word" and draw.rng.random() < 0.2:
            lead += draw.one("éñäößüçèêà")
        text = lead + run + after
        a, b = len(lead), len(lead) + len(run)
        inner = max(re.split(r"[/]", run), key=len) if family == "in_path" else run
        c = a + run.index(inner)
        out.append((text, a, b, c, c + len(inner) if label else c, family))
    return out


def _masked(text: str, start: int, kind: int, end: int, draw: _Draw) -> tuple[str, int, int] | None:
    """A base finding as a candidate of its own: without its key name, and every other time with other characters in its key."""
    if kind == 0:
        found = _ASSIGN.match(text, start)
        start = found.start(2) if found else start
    run = text[start:end]
    if draw.rng.random() < 0.5:
        alphabet = draw.one((_LOWER + _UPPER + _NUMBER, _UPPER + _NUMBER, _LOWER + _NUMBER, "0123456789ABCDEF"))
        run = "".join(draw.one(alphabet) if c.isalnum() else c for c in run)
    if candidates(run) != [(0, len(run))]:
        return None
    lead = f"{draw.word()} " if draw.rng.random() < 0.5 else re.sub(r"[A-Za-z0-9+/_.=-]+$", "", text[max(0, start - 60) : start])
    return lead + run + " " + text[end : end + 20].lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), len(lead), len(lead) + len(run)


def fit(texts: list[str], most: int = 4000, recall: float = 0.98, seed: int = 5) -> Network:
    """Train on made findings and those of the base rules in the texts, and calibrate on families held out."""
    seen: set[str] = set()
    for text in texts:
        if len(seen) < _WORDS:
            seen.update(w for w in _WORD.findall(text))
    vocabulary = sorted(seen)
    draw = _Draw(seed, vocabulary)
    x, told, owner, y, group = [], [], [], [], []

    def add(text: str, a: int, b: int, found: tuple[int, int] | None, family: str) -> None:
        """Windows of a candidate; ``found`` is what makes it a finding. Windows with a scrap of it don't train."""
        spans = windows(a, b)
        if len(spans) > _SHOWN:
            spans = [spans[k] for k in np.linspace(0, len(spans) - 1, _SHOWN).astype(int)]
        bare = bool(draw.rng.random() < 0.2) and family != "digest"
        for lo, hi in spans:
            held = min(hi, found[1]) - max(lo, found[0]) if found else 0
            x.append(view(text, lo, hi, bare))
            told.append(1 if found and held >= min(12, found[1] - found[0]) else 0 if held <= 0 else -1)
            owner.append(len(y))
        y.append(1 if found else 0)
        group.append(family)

    n = 0
    for text in texts:
        for start, kind, end in base_findings(text):
            if n < most and (made := _masked(text, start, kind, end, draw)):
                add(*made, made[1:], "base")
                n += 1
    for keys, harmless, count, s in ((_KEYS, _HARMLESS, 2 * most, 11), (_HELD_KEYS, _HELD_HARMLESS, most // 2, 12)):
        for text, a, b, c, d, family in made_findings(count, s, keys, harmless, vocabulary, [t for t in texts if " " in t]):
            add(text, a, b, (c, d) if c < d else None, family)
    x, told, owner = np.array(x), np.array(told, dtype=float), np.array(owner, dtype=np.int64)
    y, group = np.array(y, dtype=float), np.array(group)
    held = np.isin(group, _HELD_KEYS + _HELD_HARMLESS)
    learn = ~held[owner] & (told >= 0)
    net = Network()
    net.train(x[learn], told[learn])
    judged = held[owner]
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner[judged], net.logits(x[judged]))
    net.calibrate(best[held], y[held], group[held], recall)
    return net


def _sample(docs: DataFrame, id_col: str, text_col: str, most: int) -> list[str]:
    """Passages around base findings of at most ``most`` documents drawn by hash, ``_PASSAGES`` of each at most, spread over it.

    ``_DRAWN`` times as many documents are looked at, or all, if there are no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                places, texts = (x.to_pylist() for x in columns(batch, "place", "text"))
                out = []
                for place, text in zip(places, texts, strict=True):
                    found = base_findings(text) if text else []
                    if found:
                        taken = sorted({int(k) for k in np.linspace(0, len(found) - 1, _PASSAGES)})
                        out.append((place, [text[max(0, found[k][0] - 200) : found[k][2] + 60] for k in taken]))
                yield pa.RecordBatch.from_pydict({"place": pa.array([x for x, _ in out], pa.int64()), "texts": pa.array([x for _, x in out], pa.list_(pa.string()))})

    place = F.xxhash64(docs[id_col].cast("string"), docs[text_col])
    drawn = place.cast("double") / 2.0**64 + 0.5 < float(_DRAWN * most) / max(docs.count(), 1)
    rows = docs.where(drawn).select(place.alias("place"), docs[text_col].alias("text")).mapInArrow(run, "place bigint, texts array<string>")
    return [t for r in rows.orderBy("place", "texts").limit(most).collect() for t in r["texts"]]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1000, recall: float = 0.98) -> DataFrame:
    """For each document: counts of base findings by kind, a digest of them, all spans, and how many were added."""
    net = docs.sparkSession.sparkContext.broadcast(fit(_sample(docs, id_col, text_col, most), recall=recall))
    picked = docs.select(docs[id_col], docs[text_col])
    kind = picked.schema[id_col].dataType.simpleString()
    names = (id_col, "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                ids, column = columns(batch, id_col, text_col)
                texts = [t or "" for t in column.to_pylist()]
                base = [base_findings(t) for t in texts]
                asked = [(i, a, b) for i, t in enumerate(texts) for spans in (candidates(t),) for (a, b), free in zip(spans, _free(spans, base[i]), strict=True) if free]
                added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                best = np.zeros(len(asked))
                shown = ((k, i, lo, hi) for k, (i, a, b) in enumerate(asked) for lo, hi in windows(a, b))
                while part := list(islice(shown, 4096)):
                    p = net.value.probability(np.array([view(texts[i], lo, hi) for _, i, lo, hi in part]))
                    np.maximum.at(best, [k for k, *_ in part], p)
                for (i, a, b), keep in zip(asked, (best >= net.value.threshold).tolist(), strict=True):
                    if keep:
                        added[i].append((a, 3, b))
                out = [[sum(k == n for _, k, _ in b) for b in base] for n in range(3)]
                out += [[len(a) for a in added], [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], [_joined(sorted(a + b)) for a, b in zip(base, added, strict=True)]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names)

    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, base_sha256 string, spans string")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's base findings and the spans that the network adds."""
    from .shared import table

    return scan(table(spark, sf_dir, "documents"))
