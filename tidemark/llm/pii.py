"""Personal data: base patterns, plus spans found by weak supervision.

Base spans (email, ip, card, phone) are exact patterns and always stay. Further
candidates come from looser patterns of the same four kinds (spelled-out
addresses, telephone numbers without "+", grouped card numbers, ...). Labelers of three
families vote on every candidate, base ones included: patterns and checksums,
gazetteers (issuer prefixes, mail domains, calling codes), and context words
near the span. Expectation-maximisation estimates each labeler's reliability
and each vote pattern's probability from the counts of vote patterns over all
documents; a logistic span classifier is then trained on the span features
against those probabilities. Candidates that it scores at ``ACCEPT`` or more, and
that overlap no base span, are added.

What reaches the driver is the table of distinct (kind, votes, features)
signatures: at most ``4 x 3^LABELERS x 2^FEATURES`` rows, in practice some hundreds.

Edge cases: null text is empty and has no spans; overlapping extra candidates
resolve to the leftmost, then longest; without candidates the classifier accepts nothing;
repeated rows each get their own result row; other columns are ignored by ``find`` and
carried unchanged by ``redact``; long digit or letter runs cost linear time.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
CONTEXT = 40
STEP = 1 << 19  # bytes of text that a worker holds as Python objects
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit run that fails from its first digit fails from every later one, so a
# match never starts inside a run: the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

# looser candidates, same kinds
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}"
                         r"(?:\s?[\[({]\s?dot\s?[\])}]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I), "({["),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"), None),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])00[1-9][0-9 .-]{7,16}[0-9](?![0-9A-Za-z-])"), "00"),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])(?:[0-9]{4}[ .-]){3}[0-9]{4}(?![0-9A-Za-z-])"), None),
)

# gazetteers (short public lists of fixed values)
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info")
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "351")
NEAR = {
    "email": ("mail", "contact", "write", "address", "kontakt", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("version", "isbn", "issn", "license", "section", "order", "invoice", "page", "chapter", "rfc")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches, each tried at the start of the run before an "@"."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def extra_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser candidates that overlap no base span nor each other (leftmost, longest)."""
    found = []
    for kind, pattern, needs in _LOOSE:
        if needs is None or (needs in text if needs == "00" else any(c in text for c in needs)):
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    if not found:
        return found
    found.sort(key=lambda x: (x[0], -x[2]))
    taken, out, i = sorted((s, e) for s, _, e in base), [], 0
    last = -1
    for s, k, e in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not (i < len(taken) and taken[i][0] < e):
            out.append((s, k, e))
            last = e
    return out


def votes_and_features(text: str, span: tuple[int, int, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes (1, 0 = abstains, -1) of the labelers and binary span features."""
    s, k, e = span
    kind, body = KINDS[k], text[s:e]
    digits = _DIGITS.sub("", body)
    around = (text[max(0, s - CONTEXT):s] + " " + text[e:e + CONTEXT]).lower()
    words = set(re.findall(r"\w+", around))
    near, against = any(w.startswith(x) for w in words for x in NEAR[kind]), any(w.startswith(x) for w in words for x in AGAINST)
    before, after = text[s - 1:s], text[e:e + 1]
    glued = before.isalnum() or after.isalnum()
    if kind == "email":
        checks, ending = "@" in body, re.split(r"[^A-Za-z0-9]+", body.rstrip("])} "))[-1].lower()
        listed = ending in MAIL_ENDINGS
        shape = bool(re.search(r"(?i)@|[\[({]\s?at\s?[\])}]", body))
    elif kind == "ip":
        parts = body.split(".")
        checks, listed, shape = True, parts[0] not in ("0", "255"), all(p == "0" or p[0] != "0" for p in parts)
    elif kind == "card":
        checks, listed = luhn(digits), digits.startswith(CARD_PREFIXES)
        shape = bool(re.fullmatch(r"[0-9]{13,19}|([0-9]{4}[ .-]){3}[0-9]{4}", body))
    else:
        bare = digits.lstrip("0") if body[0] != "(" else digits
        checks, listed = 10 <= len(digits) <= 15, bare.startswith(CALLING_CODES) or len(digits) == 10
        shape = bool(re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", body))
    votes = (1 if checks else -1, 1 if listed else -1, 1 if shape else 0, 1 if near else 0,
             -1 if against else 0, -1 if glued else 0)
    features = (checks, listed, shape, near, against, glued, "+" in body or "@" in body, " " in body,
                before in ("", " ", "\n"), after in ("", " ", "\n", ".", ","))
    return votes, tuple(int(x) for x in features)


LABELERS, FEATURES = 6, 10


class SpanModel:
    """Labeler reliabilities from expectation-maximisation and the span classifier."""

    def __init__(self, prior, reliability, weights):
        self.prior, self.reliability, self.weights = prior, reliability, weights

    def probability(self, span, features) -> float:
        x = np.zeros(len(KINDS) + FEATURES)
        x[span[1]] = 1
        x[len(KINDS):] = features
        return float(1 / (1 + math.exp(-float(np.clip(x @ self.weights, -30, 30)))))


def fit_model(rows: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], rounds: int = 200) -> SpanModel | None:
    """``rows``: (kind, votes, features, count) signatures. None without any."""
    if not rows:
        return None
    kind = np.array([r[0] for r in rows])
    votes = np.array([r[1] for r in rows], float)
    feats = np.array([r[2] for r in rows], float)
    n = np.array([r[3] for r in rows], float)
    # start: the share of labelers in favour
    p = np.clip((votes.sum(1) + LABELERS) / (2 * LABELERS), 0.05, 0.95)
    prior = np.full(len(KINDS), 0.5)
    table = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            at = kind == k
            prior[k] = (n[at] @ p[at] + 1) / (n[at].sum() + 2)
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(LABELERS):
                # pseudo-counts say that a labeler is right more often than not
                prefer = (2.0, 1.0, 0.5) if y == 0 else (0.5, 1.0, 2.0)
                for v in (-1, 0, 1):
                    table[y, j, v + 1] = w[votes[:, j] == v].sum() + prefer[v + 1]
                table[y, j] /= table[y, j].sum()
        log = np.log(np.stack([1 - prior[kind], prior[kind]], 1))
        for j in range(LABELERS):
            v = votes[:, j].astype(int) + 1
            log += np.log(table[:, j, :].T[v])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    x = np.concatenate([np.eye(len(KINDS))[kind], feats], 1)
    w = np.zeros(x.shape[1])
    scale = n / n.sum() * len(n)
    for _ in range(50):  # Newton steps of the ridge logistic fit to soft labels
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (q - p)) + 0.1 * w
        curve = (x * (scale * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(prior, table, w)


def _signature_counts(batches):
    seen: dict = {}
    for batch in small_batches(batches, STEP):
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for span in base + extra_candidates(text, base):
                v, f = votes_and_features(text, span)
                key = (span[1], ",".join(map(str, v)), "".join(map(str, f)))
                seen[key] = seen.get(key, 0) + 1
    yield pa.RecordBatch.from_pylist(
        [{"kind": k, "votes": v, "features": f, "n": n} for (k, v, f), n in seen.items()],
        schema=pa.schema([("kind", pa.int32()), ("votes", pa.string()), ("features", pa.string()), ("n", pa.int64())]))


def train(docs: DataFrame) -> SpanModel | None:
    """Labeler votes counted over every text; reliabilities and classifier fitted."""
    counts = (docs.select(text_of().alias("text"))
              .mapInArrow(_signature_counts, "kind int, votes string, features string, n long")
              .groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
              .orderBy("kind", "votes", "features").collect())
    return fit_model([(r.kind, tuple(map(int, r.votes.split(","))), tuple(map(int, r.features)), r.n) for r in counts])


def all_spans(text: str, model: SpanModel | None) -> tuple[list, list]:
    """Base spans, and base plus accepted spans, each sorted by start, then kind."""
    base = base_spans(text)
    if model is None:
        return base, base
    added = [c for c in extra_candidates(text, base)
             if model.probability(c, votes_and_features(text, c)[1]) >= ACCEPT]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: SpanModel | None = None, accept_model: bool = True) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    ready(docs.sparkSession)
    if model is None and accept_model:
        model = train(docs)

    def run(batches):
        for batch in small_batches(batches, STEP):
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, model)
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(n[:, i]) for i in range(4)),
                                   pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                  names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the tag of its first span."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], TAGS[KINDS[k]]]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def _redacted(model: SpanModel | None):
    def run(batches):
        for batch in small_batches(batches, STEP):
            texts = batch.column("text").to_pylist()
            new = [t if t is None else redact_text(t, all_spans(t, model)[1]) for t in texts]
            names, columns = batch.schema.names, list(batch.columns)
            columns[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                was = columns[at].to_pylist()
                columns[at] = pa.array([w if t is None or t == o else len(t) for t, o, w in zip(new, texts, was)],
                                       columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The input rows with every span in ``text`` replaced by its kind's tag;
    ``n_chars``, where present, follows the new text. Null stays null."""
    spark = docs.sparkSession
    ready(spark)
    model = model or train(docs)
    return docs.mapInArrow(_redacted(model), docs.schema)
