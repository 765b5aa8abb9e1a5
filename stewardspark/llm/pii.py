"""Personal data by weak supervision.

Fixed patterns give the base spans. Looser patterns add candidates. Regex, gazetteer and
context labelers vote on every candidate: a pattern of the kind's rules, one of its usual
spelling, known values, and cue words before and after it. Expectation-maximisation over the
counted vote patterns estimates for every kind how reliable each labeler is; base spans are
known to be right. The resulting probabilities train a logistic span classifier that decides
which of the looser candidates are added.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .rows import column, field, with_results

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban", "birth_date")
# Candidates that the span classifier is fitted on.
SAMPLE_SPANS = 20_000
ROUNDS = 30
FEATURES = 1 << 12
EPOCHS = 8
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
# Looser patterns, all anchored at digits, marks or capitals so that prose is skipped fast.
_LOOSE = {
    "phone": re.compile(r"(?<![0-9+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "birth_date": re.compile(r"(?<![0-9])[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}(?![0-9])"),
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,24}){1,4}"
    ),
}
# Common top-level domains, calling codes, card prefixes, IBAN countries.
_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl pt".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
            "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91")
_CARDS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "36", "38")
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_IBAN_LENGTHS = dict(AT=20, BE=16, CH=21, CZ=24, DE=22, DK=18, ES=24, FI=18, FR=27, GB=22, IE=22, IT=27, LU=20, NL=18, NO=15,
                     PL=28, PT=25, SE=24)
_SHORTEST_IBAN, _LONGEST_IBAN = 15, 34
_IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy"),
    "national_id": ("ssn", "social", "id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "birth_date": ("born", "birth", "dob", "geboren", "nacid"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "ticket", "page", "section", "chapter")
LABELERS = ("pattern", "gazetteer", "context", "following", "spelling")
# Candidates that the rates of all kinds together weigh in the rates of one.
PRIOR = 4.0


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order of start, then kind."""
    spans = []
    last, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            spans.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and (not p or int(p) <= 255) for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _checks(iban: str) -> bool:
    """Whether an IBAN without blanks has remainder one by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of possible IBANs, spaced or not.

    The pattern may run on into capitals and digits that follow. The length that the country
    prescribes settles the end; without one at a word's edge, the longest end that meets the
    check digits. Where neither does, the whole match is a candidate, unless its length can
    be no country's. Settled spans go before the others.
    """
    pattern, settled, loose = _LOOSE["iban"], [], []
    m, free = pattern.search(text), 0
    while m:
        start, whole = m.span()
        ends = [e.end() for e in _IBAN_END.finditer(text, start, whole)]
        bodies = {e: text[start:e].replace(" ", "") for e in ends}
        ends = [e for e in ends if _SHORTEST_IBAN <= len(bodies[e]) <= _LONGEST_IBAN]
        by_country = [e for e in ends if len(bodies[e]) == _IBAN_LENGTHS.get(text[start : start + 2])]
        valid = [e for e in by_country or reversed(ends) if _checks(bodies[e])]
        if valid:
            settled.append((start, valid[0]))
            m = pattern.search(text, valid[0])
            continue
        if start >= free and ends:
            free = (by_country or [ends[-1]])[0]
            loose.append((start, free))
        m = pattern.search(text, start + 1)
    return sorted(settled + [s for s in loose if all(s[1] <= a or b <= s[0] for a, b in settled)])


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that touch no base span and no earlier candidate.

    An IBAN that meets its check digits may hold base spans: one in ten has digits that also
    pass for a card number.
    """
    out = []
    for kind, pattern in _LOOSE.items():
        if kind == "email" and "at]" not in text.lower() and "at)" not in text.lower():
            continue
        found = iban_spans(text) if kind == "iban" else [m.span() for m in pattern.finditer(text)]
        out += [(start, KINDS.index(kind), end) for start, end in found]
    kept, taken = [], sorted((s, e) for s, _, e in base)
    position, end = 0, 0
    for span in sorted(out):
        while position < len(taken) and taken[position][1] <= span[0]:
            position += 1
        touched = list(itertools.takewhile(lambda t: t[0] < span[2], itertools.islice(taken, position, None)))
        clear = not touched or (
            KINDS[span[1]] == "iban" and all(span[0] <= s and e <= span[2] for s, e in touched)
            and _checks(text[span[0] : span[2]].replace(" ", ""))
        )
        if clear and span[0] >= end:
            kept.append(span)
            end = span[2]
    return kept


_STRICT = {
    "phone": re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}"),
    "birth_date": re.compile(r"(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19[0-9]{2}|20[01][0-9])"),
    "email": re.compile(r"[A-Za-z][A-Za-z0-9._-]* ?[\[(](?:at|AT)[\])] ?[A-Za-z][A-Za-z0-9-]*(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z-]{2,24})+"),
}
_CUE = {kind: re.compile(rf"\b(?:{'|'.join(words)})") for kind, words in _CUES.items()}


def _pattern(kind: str, body: str, digits: str, is_base: bool) -> str:
    """The rules of the kind: check digits, ranges of its parts."""
    if is_base:
        return "+"
    if kind == "iban":
        return "+" if _checks(body.replace(" ", "")) else "-"
    if kind == "national_id":
        return "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    return "+" if _STRICT[kind].fullmatch(body) else "-"


def _gazetteer(kind: str, body: str, digits: str) -> str:
    """Known domains, calling codes, issuers and countries; nothing but placeholders against the rest."""
    if kind == "email":
        return "+" if re.split(r"[.\])\s]", body)[-1].lower() in _DOMAINS else "-"
    if kind == "phone":
        known = digits.startswith(_CALLING) if body[0] == "+" else digits[0] not in "01"
        return "+" if known else "-"
    if kind == "card":
        return "+" if digits.startswith(_CARDS) else "-"
    if kind == "iban":
        return "+" if body[:2] in _COUNTRIES else "-"
    if kind == "ip":
        return "-" if body.startswith(("0.", "255.", "1.0.", "1.2.3.")) else "+"
    return "-" if len(set(digits)) < 3 else "0"


def _cue(kind: str, around: str) -> str:
    if any(c in around for c in _AGAINST):
        return "-"
    return "+" if _CUE[kind].search(around) else "0"


def _spelling(kind: str, body: str) -> str:
    """Whether the span is written as its kind usually is: one separator, even groups."""
    marks = {c for c in body if not c.isalnum()}
    if kind == "phone":
        return "+" if "(" in body or len(marks - {"+"}) <= 1 else "-"
    if kind == "card":
        groups = [len(g) for g in re.split(r"[ -]", body)]
        return "+" if groups[:-1] == [4] * (len(groups) - 1) or groups == [4, 6, 5] or len(groups) == 1 else "-"
    if kind == "iban":
        groups = [len(g) for g in body.split(" ")]
        return "+" if len(groups) == 1 or set(groups[:-1]) == {4} else "-"
    if kind == "ip":
        return "-" if any(len(p) > 1 and p[0] == "0" for p in body.split(".")) else "+"
    if kind == "birth_date":
        return "+" if len(marks) == 1 else "-"
    return "0"


def votes(text: str, span: tuple[int, int, int], is_base: bool) -> str:
    """One sign per labeler: for, against, or nothing to say; ``!`` marks a base span."""
    start, kind_no, end = span
    kind, body = KINDS[kind_no], text[start:end]
    digits = _NOT_DIGIT.sub("", body)
    signs = (
        _pattern(kind, body, digits, is_base), _gazetteer(kind, body, digits),
        _cue(kind, text[max(0, start - CONTEXT) : start].lower()), _cue(kind, text[end : end + CONTEXT].lower()),
        _spelling(kind, body),
    )
    return f"{kind}|{''.join(signs)}" + "!" * is_base


def features(text: str, span: tuple[int, int, int]) -> list[int]:
    """Hashed features: kind, shape, length and the words around."""
    start, kind_no, end = span
    kind, body = KINDS[kind_no], text[start:end]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", body)))[:40]
    left = re.findall(r"\w+", text[max(0, start - CONTEXT) : start].lower())[-2:]
    right = re.findall(r"\w+", text[end : end + CONTEXT].lower())[:2]
    names = [f"k={kind}", f"s={kind}{shape}", f"n={kind}{min(9, len(body) // 4)}"]
    names += [f"l={w}" for w in left] + [f"r={w}" for w in right]
    return sorted({zlib.crc32(n.encode("utf-8", "replace")) % FEATURES for n in names})


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("first", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
    T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType())),
]))
_SPAN_ARROW = pa.list_(pa.struct([
    ("kind", pa.int32()), ("first", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
    ("votes", pa.string()), ("features", pa.list_(pa.int32())),
]))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and all candidate spans with votes and features, stored once without text."""

    def find(row):
        out = []
        for value in field(row, text):
            value = value or ""
            base = base_spans(value)
            every = [(s, True) for s in base] + [(s, False) for s in loose_spans(value, base)]
            out.append([
                {"kind": s[1], "first": s[0], "end": s[2], "base": b, "votes": votes(value, s, b),
                 "features": features(value, s)}
                for s, b in every
            ])
        return [pa.array(out, _SPAN_ARROW)]

    picked = docs.select(*{c: column(c) for c in (doc_id, text)}.values())
    rows = with_results(picked, find, [T.StructField("spans", _SPAN)]).select(
        F.col("row").getField(doc_id).alias("doc_id"), "spans"
    )
    spark = docs.sparkSession
    path = scratch_path(spark, "pii-candidates")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def reliabilities(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Probability of being personal data per vote pattern, and each labeler's accuracy.

    Expectation-maximisation on pattern counts: the prior per kind and, per kind and labeler,
    how often it votes each way on true and on false candidates. The rates of a kind lean on
    those of all kinds together, so that a rare kind learns from the others. Base spans (``!``)
    are true throughout, and tell nothing about how often the looser candidates are.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, {}
    n = np.array([counts[p] for p in patterns], float)
    known = np.array([p.endswith("!") for p in patterns])
    kinds = sorted({p.split("|")[0] for p in patterns})
    kind = np.array([kinds.index(p.split("|")[0]) for p in patterns], int)
    vote = np.array([["-0+".index(c) for c in p.split("|")[1].rstrip("!")] for p in patterns], int)
    mine = kind[None, :] == np.arange(len(kinds))[:, None]
    # Starting point: the majority of votes, undecided ones at one half.
    q = np.where(known, 1.0, 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1))))
    for _ in range(ROUNDS):
        loose = np.where(known, 0.0, n)
        prior = ((mine * loose) @ q + 1) / (mine @ loose + 2)
        log_odds = np.log(prior / (1 - prior))[kind]
        for j in range(vote.shape[1]):
            rates = []
            for weight, lean in ((n * q, [0.5, 1, 2]), (n * (1 - q), [2, 1, 0.5])):
                every = np.bincount(vote[:, j], weight, minlength=3) + np.array(lean)
                every = PRIOR * every / every.sum()
                own = np.array([np.bincount(vote[m, j], weight[m], minlength=3) for m in mine]) + every
                rates.append(own / own.sum(axis=1, keepdims=True))
            log_odds = log_odds + np.log(rates[0] / rates[1])[kind, vote[:, j]]
        q = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
    # A labeler that never speaks has no accuracy.
    accuracy = {}
    for j, name in enumerate(LABELERS[: vote.shape[1]]):
        said = vote[:, j] != 1
        right = np.where(vote[:, j] == 2, q, 1 - q)
        if said.any():
            accuracy[name] = float((n * right)[said].sum() / n[said].sum())
    return dict(zip(patterns, q.tolist())), accuracy


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def probability(self, features: list[int]) -> float:
        z = float(self.weights[features].sum()) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[list[int], float]], seed: int = 0) -> Classifier:
    """Logistic regression on soft labels; without rows nothing is added."""
    model = Classifier(np.zeros(FEATURES), -5.0 if not rows else 0.0)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS if rows else 0):
        rate = 0.3 / (1 + epoch)
        for k in rng.permutation(len(rows)):
            at, target = rows[k]
            step = rate * (target - model.probability(at))
            model.weights[at] += step
            model.bias += step
    return model


def fit(spans: DataFrame, sample_spans: int = SAMPLE_SPANS) -> Classifier:
    """Reliabilities from the votes of all candidates, the classifier from a bounded sample.

    Vote patterns are few (kinds times three signs per labeler), however many candidates there
    are; base and loose spans are drawn alike.
    """
    flat = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counts = {r["votes"]: r["count"] for r in flat.groupBy("votes").count().collect()}
    truth, _ = reliabilities(counts)
    total = sum(counts.values())
    draw = F.pmod(F.xxhash64("doc_id", "first", "end"), F.lit(1 << 30)) / float(1 << 30)
    rows = flat.where(draw < min(1.0, sample_spans / max(1, total))).select("features", "votes")
    sample = sorted((list(r["features"]), r["votes"]) for r in rows.limit(2 * sample_spans).collect())
    return train([(f, truth[v]) for f, v in sample])


def detect(spans: DataFrame, model: Classifier) -> DataFrame:
    """One row per document with its base counts, base digest and all spans.

    Null and empty texts have no spans. Base spans always stay; a looser candidate is added
    from a probability of one half. Texts are read whole, very long ones too.
    """
    shared = spans.sparkSession.sparkContext.broadcast(model)

    def decide(row):
        known = shared.value
        counts = [[] for _ in BASE]
        sha, written = [], []
        for found in field(row, "spans"):
            base = [s for s in found if s["base"]]
            for k in range(len(BASE)):
                counts[k].append(sum(s["kind"] == k for s in base))
            kept = [s for s in found if s["base"] or known.probability(s["features"]) >= 0.5]
            sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
            written.append(_written(sorted(kept, key=lambda s: (s["first"], s["kind"], s["end"]))))
        return [*[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(written, pa.string())]

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("found", T.StringType())]
    return with_results(spans, decide, fields).select(
        "row.doc_id", *[f"n_{k}" for k in BASE], "base_sha256", F.col("found").alias("spans")
    )


def _written(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['first']}:{s['end']}" for s in spans)
