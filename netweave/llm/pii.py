"""Personal data by weak supervision.

Base detectors (email, ip, card, phone) are fixed patterns whose matches always stay in the result. Beside them wider
patterns propose candidates, right ones and wrong ones alike: numbers that fail a checksum, assigned values of any key.
Seven labelers by regex, checksum, gazetteer and context vote on every span, base or not (yes, no, abstain).
Expectation-maximisation over the vote patterns estimates how reliable each labeler is, for all kinds together and then
for each kind, and how likely each pattern is personal data. On these posteriors a logistic span classifier is trained
that sees characters and context of a span, not the votes; it decides which candidates are added.

The model is fitted on two tables of counts over the whole corpus: vote patterns, at most ``len(KINDS) * 3**7`` rows, and
feature patterns, at most ``len(KINDS) * prod(CLASSES)``, whatever the corpus. Texts are scanned once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.llm.words import tidied
from netweave.plans.session import materialise

# fixed values: base kinds in their order, then kinds that only the method adds
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "national_id", "iban")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
# fixed values: gazetteers
SECRET_WORDS = frozenset("password passwd pwd secret token apikey api_key api-key auth bearer credential key passphrase private_key access_key client_secret".split())
PLAIN_WORDS = frozenset("version isbn issn order page line date time id ref checksum sha sha1 sha256 md5 digest hash etag uuid commit revision build width height size total count http https serial invoice tracking part sku".split())
CONTACT_WORDS = {
    0: frozenset("mail email e-mail contact write reach".split()),
    1: frozenset("ip host address server client from".split()),
    2: frozenset("card visa mastercard amex credit debit pay payment".split()),
    3: frozenset("phone tel telephone mobile cell fax call whatsapp telefon tfno telefono contact dial".split()),
    4: SECRET_WORDS,
    5: frozenset("ssn social security national id-number".split()),
    6: frozenset("iban account konto cuenta bank bic transfer".split()),
}
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl eu ca au jp cn ru br ch at be se no fi pl pt".split())
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

ASSIGN = re.compile(r"[=:]")
KEY_BEFORE = re.compile(r"([A-Za-z][A-Za-z0-9_-]{1,30})[\"']?[ \t]{0,3}$")
VALUE_AFTER = re.compile(r"[ \t]{0,3}[\"']?([A-Za-z0-9+/_~.-]{8,})")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])")
NATIONAL_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
HIDDEN_EMAIL = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?(?:\[at\]|\(at\)|\bat\b) ?([A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[A-Za-z0-9-]{2,63})+)")
WORD_BEFORE = re.compile(r"([A-Za-z][A-Za-z0-9_-]{0,30})[^A-Za-z0-9]{1,4}$")
WORDS = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
UNIT_AFTER = re.compile(r"\s?(?:%|(?:USD|EUR|GBP|kg|km|cm|mm|px|ms|KB|MB|GB|items|pages|times)\b)")

LABELERS = ("pattern", "checksum", "word before", "words near", "right side", "edges", "document")
NO, YES, ABSTAIN = 0, 1, 2
#: What is believed of a labeler before any corpus is seen: yes among right spans, and among wrong ones. A checksum that
#: is one (card, ip, iban) is believed more than a rule of thumb.
BELIEF = ((0.9, 0.5), (0.9, 0.5), (0.9, 0.1), (0.85, 0.3), (0.6, 0.4), (0.95, 0.6), (0.7, 0.4))
CHECKED_KINDS, CHECKED_BELIEF = (1, 2, 6), (0.97, 0.08)
#: Weight of the belief against what is counted, as a share of the spans; and of the belief in a checksum that is one,
#: since chance passes it seldom whatever the corpus.
BELIEF_SHARE, CHECKED_SHARE = 0.25, 4.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns' matches that pass their checks, by kind, then start."""
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text) is None:
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def candidate_spans(text: str) -> list[tuple[int, int, int]]:
    """Wider proposals; they may repeat each other and the base spans."""
    found = []
    for m in ASSIGN.finditer(text):
        key = KEY_BEFORE.search(text, max(0, m.start() - 40), m.start())
        value = VALUE_AFTER.match(text, m.end()) if key else None
        if value:
            found.append((4, value.start(1), value.end(1)))
    if "dot" in text or "[at]" in text or "(at)" in text:
        for m in re.finditer(r"\[at\]|\(at\)|\bat\b", text):
            h = HIDDEN_EMAIL.search(text, max(0, m.start() - 66), min(len(text), m.end() + 140))
            if h and h.start() <= m.start() < h.end() and ("dot" in h[2] or m[0] != "at"):
                found.append((0, h.start(), h.end()))
    if DIGIT.search(text) is not None:
        for kind, pattern in ((3, LOCAL_PHONE), (5, NATIONAL_ID), (6, IBAN), (1, IP), (2, CARD)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if kind != 2 or 13 <= len(NOT_DIGIT.sub("", m[0])) <= 19]
    return list(dict.fromkeys(found))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _pattern_vote(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        ok = re.fullmatch(r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span) or "dot" in span or "[at]" in span or "(at)" in span
    elif kind == 2:
        ok = span == digits or re.fullmatch(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}", span)
    elif kind == 3:
        ok = span[0] in "+("
    elif kind == 4:
        ok = len(span) >= 16 and len(digits) >= 3 and re.fullmatch(r"[A-Za-z0-9+/_.~-]+", span)
    elif kind == 6:
        ok = IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", ""))
    else:
        ok = True
    return YES if ok else NO


def _checks(kind: int, span: str, digits: str) -> bool:
    if kind == 0:
        return re.split(r"[^A-Za-z]+", span.lower().rstrip("])"))[-1] in TOP_DOMAINS
    if kind == 1:
        parts = [x.lstrip("0") or "0" for x in span.split(".")]
        return all(len(x) <= 3 and int(x) <= 255 for x in parts) and parts[0] != "0"
    if kind == 2:
        return span[0] in "23456" and luhn(digits)
    if kind == 3:
        local = digits[-10:]
        return 7 <= len(digits) <= 15 and (len(digits) not in (10, 11) or local[0] not in "01" and local[3] not in "01")
    if kind == 4:
        return _entropy(span) >= 3
    if kind == 5:
        return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    return _mod97(span)


class Around:
    """What the labelers and the classifier know of a span besides its own characters."""

    def __init__(self, text: str, kind: int, start: int, end: int, others: int, repeats: int):
        """``others``: base spans of the text besides this one; ``repeats``: how often the text proposes the same value."""
        before = text[max(0, start - 40) : start]
        word = WORD_BEFORE.search(before)
        self.span, self.kind, self.others, self.repeats = text[start:end], kind, others, repeats
        self.digits = NOT_DIGIT.sub("", self.span)
        self.word = word[1].lower() if word else ""
        self.near = {w.lower() for w in WORDS.findall(before)}
        self.left, self.right = before[-1:], text[end : end + 1]
        self.unit = UNIT_AFTER.match(text, end) is not None
        self.open = not (self.left.isalnum() or self.right.isalnum() or self.right == "_")
        self.quoted = self.left in "\"'" and self.left == self.right and self.left != ""
        self.checked = _checks(kind, self.span, self.digits)

    def wanted(self, word: str) -> bool:
        return word in CONTACT_WORDS[self.kind] or any(word.endswith("_" + w) for w in CONTACT_WORDS[self.kind])

    def votes(self) -> list[int]:
        """What the seven labelers say, in the order of ``LABELERS``."""
        yes_no = lambda x: YES if x else NO
        word = YES if self.wanted(self.word) else NO if self.word in PLAIN_WORDS else ABSTAIN
        near = YES if any(map(self.wanted, self.near)) else NO if self.near & PLAIN_WORDS else ABSTAIN
        right = NO if self.unit else YES if self.quoted else ABSTAIN
        document = NO if self.repeats >= 3 else YES if self.others else ABSTAIN
        return [_pattern_vote(self.kind, self.span, self.digits), yes_no(self.checked), word, near, right, yes_no(self.open), document]

    def features(self) -> list[int]:
        """Classes of characters and context, in the order of ``CLASSES``."""
        n = len(self.span)
        letters = [c for c in self.span if c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        left = 0 if not self.word else 1 if self.wanted(self.word) else 2 if self.word in PLAIN_WORDS else 3
        right = 0 if not self.right else 1 if self.unit else 2 if self.quoted else 3 if self.right.isspace() else 4
        case = 0 if not letters else 1 if not upper else 2 if upper == len(letters) else 3
        return [min(5, n // 8), min(4, len(self.digits) * 5 // n), min(3, int(_entropy(self.span))), case, left, right, int(self.checked), int(self.open)]


#: How many classes each feature has: length, share of digits, entropy, case, word before, right side, checksum, edges.
CLASSES = (6, 5, 4, 4, 4, 5, 2, 2)


def _code(values: list[int], bases: tuple[int, ...]) -> int:
    code = 0
    for v, base in zip(values, bases, strict=True):
        code = code * base + v
    return code


def _decode(code: np.ndarray, bases: tuple[int, ...]) -> np.ndarray:
    out = []
    for base in reversed(bases):
        out.append(code % base)
        code = code // base
    return np.stack(out[::-1], 1)


_VOTES = (3,) * len(LABELERS)


def spans_with_votes(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """``kind, start, end, base, votes, features`` of base spans and of candidates that overlap none, votes and features as codes."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    begins, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1]) if reach else e)
    rows = [(*x, True) for x in base]
    for k, s, e in candidate_spans(text):
        before = bisect_right(begins, e - 1)  # the base spans that begin before this one ends
        if not before or reach[before - 1] <= s:
            rows.append((k, s, e, False))
    often = Counter(text[s:e] for _, s, e, _ in rows)
    out = []
    for k, s, e, b in rows:
        around = Around(text, k, s, e, len(base) - b, often[text[s:e]])
        out.append((k, s, e, b, _code(around.votes(), _VOTES), _code(around.features(), CLASSES)))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "base", "votes", "features")
    kinds = pa.list_(pa.struct([(n, pa.bool_() if n == "base" else pa.int32()) for n in names]))
    for batch in batches:
        out = [[dict(zip(names, row, strict=True)) for row in spans_with_votes(text or "")] for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, kinds)], ["doc_id", "found"])


def _believed(kind: int | None) -> np.ndarray:
    """``labeler, truth, vote`` (no or yes) as believed beforehand; of no kind in particular if None."""
    belief = np.array(BELIEF)
    if kind in CHECKED_KINDS:
        belief[1] = CHECKED_BELIEF
    yes = belief[:, ::-1]  # truth 0 first
    return np.stack([1 - yes, yes], 2)


class LabelModel:
    """Reliabilities of the labelers and posteriors of vote patterns, by expectation-maximisation.

    An abstention says nothing. What is believed beforehand counts as much as ``BELIEF_SHARE`` of the spans, so that a
    labeler is thought right until the others show otherwise; a kind's belief is what all kinds together have shown.
    """

    def __init__(self, patterns: list[tuple[int, int, int]], rounds: int = 40):
        """``patterns``: kind, votes, and how many spans; of base spans and candidates alike."""
        self.reliability: dict[int, np.ndarray] = {}
        self.posterior: dict[tuple[int, int], float] = {}
        if not patterns:
            return
        table = np.array(sorted(patterns), np.int64)
        kind, code, count = table[:, 0], table[:, 1], table[:, 2].astype(float)
        vote = _decode(code, _VOTES)
        kinds = np.unique(kind).tolist()
        first = np.stack([_believed(k) for k in range(len(KINDS))])[kind]
        p = self._expect(vote, first, np.full(len(table), 0.5))
        for _ in range(rounds):
            pooled = self._maximise(vote, count, p, _believed(None), None)
            p = self._expect(vote, pooled[None].repeat(len(table), 0), np.full(len(table), (count @ p + 1) / (count.sum() + 2)))
        for k in kinds:
            here = kind == k
            v, n = vote[here], count[here]
            believed = pooled.copy()
            if k in CHECKED_KINDS:  # what other kinds' rules of thumb have shown says little of a checksum
                believed[1] = _believed(k)[1]
            theta, prior = believed, 0.5
            for _ in range(rounds):
                q = self._expect(v, theta[None].repeat(len(v), 0), np.full(len(v), prior))
                theta = self._maximise(v, n, q, believed, k)
                prior = (n @ q + 1) / (n.sum() + 2)
            self.reliability[k] = theta
            self.posterior |= {(k, int(c)): float(x) for c, x in zip(code[here], q, strict=True)}

    @staticmethod
    def _expect(vote: np.ndarray, theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
        odds = np.log(prior / (1 - prior))
        row = np.arange(len(vote))
        for i in range(vote.shape[1]):
            said = np.minimum(vote[:, i], YES)
            odds = odds + np.where(vote[:, i] == ABSTAIN, 0.0, np.log(theta[row, i, 1, said] / theta[row, i, 0, said]))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @staticmethod
    def _maximise(vote: np.ndarray, count: np.ndarray, p: np.ndarray, believed: np.ndarray, kind: int | None) -> np.ndarray:
        share = np.full(len(believed), BELIEF_SHARE)
        if kind in CHECKED_KINDS:
            share[1] = CHECKED_SHARE
        theta = believed * (4 + share * count.sum())[:, None, None]
        for y, share in ((1, count * p), (0, count * (1 - p))):
            for o in (NO, YES):
                theta[:, y, o] += share @ (vote == o)
        return theta / theta.sum(2, keepdims=True)


class SpanClassifier:
    """Logistic regression over the characters and context of a span, trained on posteriors."""

    def __init__(self, patterns: list[tuple[int, int, int, int]], steps: int = 600, rate: float = 1.0):
        """``patterns``: kind, features, number of spans and the sum of their posteriors in millionths."""
        self.scores: dict[tuple[int, int], float] = {}
        if not patterns:
            return
        table = np.array(sorted(patterns), np.int64)
        kind, code, count = table[:, 0], table[:, 1], table[:, 2].astype(float)
        target, weight = table[:, 3] / 1e6 / count, np.sqrt(count)
        x = self._columns(kind, _decode(code, CLASSES))
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= rate * (x.T @ (weight * (q - target)) / weight.sum() + 1e-4 * w)
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        self.scores = {(int(k), int(c)): float(v) for k, c, v in zip(kind, code, q, strict=True)}

    @staticmethod
    def _columns(kind: np.ndarray, feature: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(kind))] + [kind == k for k in range(len(KINDS))]
        columns += [feature[:, i] == c for i, classes in enumerate(CLASSES) for c in range(classes)]
        # what the checksum and the word before say depends on the kind
        columns += [(kind == k) & (feature[:, i] == c) for k in range(len(KINDS)) for i in (4, 6) for c in range(CLASSES[i])]
        return np.stack(columns, 1).astype(float)


def fit_spans(found: DataFrame) -> tuple[LabelModel, SpanClassifier]:
    """Both models from a table with ``found``, arrays of spans; what reaches the driver are counts of patterns."""
    spark = found.sparkSession
    spans = found.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.features")
    labels = LabelModel([tuple(r) for r in spans.groupBy("kind", "votes").count().collect()])
    rows = [(k, v, round(p * 1e6)) for (k, v), p in sorted(labels.posterior.items())]
    # as many rows as there are vote patterns, at most ``len(KINDS) * 3**7``
    posterior = spark.createDataFrame(rows, "kind int, votes int, p long")
    counts = spans.join(F.broadcast(posterior), ["kind", "votes"]).groupBy("kind", "features").agg(F.count("*"), F.sum("p"))
    return labels, SpanClassifier([tuple(r) for r in counts.collect()])


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    ``spans``: array of ``kind, start, end, base, score`` by kind in the order of ``KINDS``, then start; code points,
    end exclusive. Base spans stay whatever the classifier says; a candidate is added if it scores ``threshold`` or
    more and overlaps no base span and no added span that begins before it (of those that begin together the longest
    comes first). A null or empty text has no spans; a text of any length is scanned whole; ids may be null or repeat;
    an empty table gives an empty result.
    """
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    found = materialise(
        docs.select("doc_id", "text").mapInArrow(tidied(_scan), f"doc_id {kind_of}, found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:int>>"),
        "pii",
    )
    scores = fit_spans(found)[1].scores

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            out = []
            for spans in batch.column("found").to_pylist():
                kept, reach = [], -1
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
                    score = scores.get((s["kind"], s["features"]), 0.0)
                    if s["base"]:
                        kept.append((s, score))
                    elif score >= threshold and s["start"] >= reach:
                        kept.append((s, score))
                        reach = s["end"]
                kept.sort(key=lambda x: (x[0]["kind"], x[0]["start"], x[0]["end"]))
                out.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["base"], "score": score} for s, score in kept])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, made)], ["doc_id", "spans"])

    return found.mapInArrow(tidied(decide), f"doc_id {kind_of}, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
