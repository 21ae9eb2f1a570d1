"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base) and looser ones.  Three
labelers vote on each candidate, for, against or not at all: a pattern
labeler, a gazetteer and one that looks at the words in front.
Expectation-maximisation over the votes estimates how reliable each labeler is
and how likely each pattern of votes is right, and these soft labels train the
final span classifier, a logistic regression on a span's own features.  It
needs no more than the number of candidates by votes and features, a table of
bounded size counted over all documents.  Base spans always stay; a looser
candidate becomes a span if the classifier is sure.  Looser candidates are
written around a filter (numbers in other groups, "name [at] host [dot] org",
"10[.]0[.]0[.]1"), or are keys and passwords, a kind that has no strict form.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans, in the order in which they are listed.
ALL_KINDS = (*KINDS, "secret")
#: Probability from which a looser candidate is a span.
SURE = 0.9
#: Code points in front of a span that the context labeler sees.
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot|DOT)[\])] ?[0-9]{1,3}){3}(?![0-9.])")
_LOOSE_CARD = re.compile(r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./_])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?:ghp_|sk_live_|xoxb-)[A-Za-z0-9-]{16,})")
_ASSIGNED = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)

# Top-level domains, card issuer prefixes, country calling codes.
_TLDS = frozenset("com org net edu gov io info biz eu us uk de fr es it nl ch at be pt pl se no dk fi ie ca au nz jp cn in br mx".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38")
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421")
_CUES = {
    "email": re.compile(r"mail|contact|write|reach|schreib|écri|correo", re.I),
    "ip": re.compile(r"\bip\b|server|host|login|from|logged|adress|address|client", re.I),
    "card": re.compile(r"card|visa|credit|pay|karte|carte|tarjeta", re.I),
    "secret": re.compile(r"passw|pwd|secret|token|key|login", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobil|ring|appel|llam|ruf", re.I),
}
_KEY_HEADS = ("AKIA", "ASIA", "ghp_", "sk_live_", "xoxb-")
_PLACEHOLDERS = frozenset("changeme example required password optional string secret token default yourpassword username".split())
_AGAINST = re.compile(r"version|isbn|license|section|chapter|figure|\bno\.|\bv$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Strict matches of each kind: leftmost, non-overlapping, failing ones dropped.  Linear in the text."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts = m.group().split(".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    out["ip"].append((at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns that touch no base span and no candidate before them."""
    taken = [s for spans in base.values() for s in spans]
    found = []
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        found += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
    if "[" in text or "(" in text:
        found += [("ip", *m.span()) for m in _LOOSE_IP.finditer(text) if all(int(x) <= 255 for x in re.findall("[0-9]+", m.group()))]
        if "at" in text or "AT" in text:
            found += [("email", *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    found += [("secret", *m.span()) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    out = []
    for f in found:
        if all(f[2] <= a or f[1] >= b for a, b in taken):
            out.append(f)
            taken.append(f[1:])
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int, int]:
    """Of the pattern labeler, the gazetteer and the context labeler: 1, -1, or 0 for none."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    front = text[max(0, start - CONTEXT) : start]
    context = 1 if _CUES[kind].search(front) else -1 if _AGAINST.search(front) else 0
    if kind == "secret":
        mixed = bool(digits) and any(c.isalpha() for c in span)
        known = 1 if span.startswith(_KEY_HEADS) or (len(span) in (32, 40, 64) and re.fullmatch("[0-9a-fA-F]+", span)) else -1 if span.lower().strip("<>*.") in _PLACEHOLDERS else 0
        return 1 if _KEY.fullmatch(span) else 0 if mixed else -1, known, context
    if kind == "email":
        known = 1 if re.split(r"[.\])\s]+", span.lower())[-1] in _TLDS else -1
    elif kind == "ip":
        known = -1 if re.split("[^0-9]", span)[0] in ("0", "127", "255") else 1
    elif kind == "card":
        known = 1 if digits.startswith(_ISSUERS) else -1
    elif span.startswith("+"):
        known = 1 if digits.startswith(_COUNTRIES) else -1
    else:
        known = 1 if digits[:1] not in ("0", "1") else -1
    regular = 1 if strict else -1 if len(set(digits)) <= 2 and kind != "email" else -1 if kind == "card" and not luhn(digits) else 0
    return regular, known, context


FEATURES = 8


def features(text: str, kind: str, start: int, end: int, strict: bool) -> int:
    """A span's own features, one bit each."""
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    front = text[max(0, start - CONTEXT) : start]
    if kind == "secret":
        strict = bool(_KEY.fullmatch(span)) or (bool(digits) and digits < len(span))
    elif kind == "card":
        strict = strict or luhn("".join(c for c in span if c in "0123456789"))
    flags = (strict, bool(_CUES[kind].search(front)), bool(_AGAINST.search(front)), start == 0 or text[start - 1].isspace(), end == len(text) or not text[end].isalnum(), digits * 2 > len(span), any(c in " -()[]" for c in span), len(span) > 16)
    return sum(bool(f) << i for i, f in enumerate(flags))


def em(counts: dict[tuple[int, int, int], float], rounds: int = 50) -> tuple[float, np.ndarray, dict[tuple[int, int, int], float]]:
    """(share of true candidates, reliability [labeler, truth, vote + 1], posterior by votes), Dawid-Skene with a mild prior."""
    patterns = list(counts)
    v = np.array(patterns, dtype=np.int64).reshape(-1, 3) + 1
    n = np.array([counts[p] for p in patterns], dtype=float)
    post = np.clip(0.5 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95)
    prior, table = 0.5, np.full((3, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        for lab in range(3):
            for truth in range(2):
                got = np.bincount(v[:, lab], weights=weight[truth], minlength=3)
                got = got + (np.array([0.2, 0.5, 1.0]) if truth else np.array([1.0, 0.5, 0.2]))
                table[lab, truth] = got / got.sum()
        like = np.stack([np.prod([table[lab, truth, v[:, lab]] for lab in range(3)], axis=0) for truth in range(2)])
        post = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
    return prior, table, dict(zip(patterns, post.tolist(), strict=True))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * np.clip(p * (1 - p), 1e-6, None))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _row(feature_bits: int) -> list[float]:
    return [1.0, *[float(feature_bits >> i & 1) for i in range(FEATURES)]]


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """Reliabilities and classifier weights by kind, from all candidates of all texts.

    Only counts by (kind, votes, features) leave the executors: at most
    5 x 27 x 256 rows whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    every = [(k, s, e, True) for k, spans in base.items() for s, e in spans] + [(*f, False) for f in loose_spans(text, base)]
                    for k, s, e, strict in every:
                        seen[ALL_KINDS.index(k), votes(text, k, s, e, strict), features(text, k, s, e, strict)] += 1
        rows = [(k, *v, f, n) for (k, v, f), n in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["kind", "a", "b", "c", "bits", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind long, a long, b long, c long, bits long, n long")
    table = counted.groupBy("kind", "a", "b", "c", "bits").agg(F.sum("n").alias("n")).orderBy("kind", "a", "b", "c", "bits").collect()
    model: dict = {}
    for k, kind in enumerate(ALL_KINDS):
        own = [r for r in table if r["kind"] == k]
        if not own:
            continue
        counts: dict = {}
        for r in own:
            counts[r["a"], r["b"], r["c"]] = counts.get((r["a"], r["b"], r["c"]), 0) + r["n"]
        prior, reliability, post = em(counts)
        n = np.array([r["n"] for r in own], dtype=float)
        scale = min(1.0, 10_000 / n.sum())  # so that the ridge weighs alike at every size beyond that
        w = logistic(np.array([_row(r["bits"]) for r in own]), np.array([post[r["a"], r["b"], r["c"]] for r in own]), n * scale)
        model[kind] = {"prior": prior, "reliability": reliability.tolist(), "weights": w.tolist()}
    return model


def spans(text: str, model: dict) -> list[tuple[str, int, int]]:
    """Base spans and what the classifier adds, by kind as listed, then start."""
    base = base_spans(text)
    out = {k: list(base.get(k, ())) for k in ALL_KINDS}
    for kind, s, e in loose_spans(text, base):
        w = model.get(kind, {}).get("weights")
        if w is not None and 1 / (1 + np.exp(-np.dot(w, _row(features(text, kind, s, e, False))))) >= SURE:
            out[kind].append((s, e))
    return [(k, s, e) for k in ALL_KINDS for s, e in sorted(out[k])]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (joined) and n_spans of every whole text.

    A null text counts as empty; null ids stay; repeated rows are read alike;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                rows.append((*[len(base[k]) for k in KINDS], _joined([(k, s, e) for k in KINDS for s, e in base[k]]), _joined(own := spans(text or "", model)), len(own)))
            *n, b, s, total = zip(*rows, strict=True) if rows else ((),) * 7
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in b]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(digest, pa.string()), pa.array(s, pa.string()), pa.array(total, pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(text: str, model: dict) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in sorted(spans(text, model), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        elif e > at:
            out.append("")
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns, with personal data in the text replaced; a null text stays null, repeated rows change alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: personal data in the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))
