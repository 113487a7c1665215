"""Personal data by weak-supervision aggregation.

Base spans of four kinds come from fixed patterns and checks and always stay.
Further candidates (numbers that look like phones without a plus, social
security numbers, account numbers, spelled-out e-mail addresses, keys and
passwords, titled names, street addresses) are judged: labelers that look at the
form, at the entropy, at gazetteers and at the words around vote or abstain on
each.  The votes of all candidates, counted by
vector, feed an expectation-maximisation that estimates how reliable each
labeler is; its posteriors are the soft labels of a logistic regression over
features of the span, the final classifier.  Candidates that it accepts are
added where they touch no other span.

Both passes stream over the documents; between them only counts by vector of
votes and features (a few thousand at most) reach the driver.

The scanners take time linear in the text: an address is found from its @ and a
number from the start of its run of digits, so no pattern is tried again inside
a run that has failed.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; overlapping spans of different base kinds are all kept; repeated rows
are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.session import bound_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret", "name", "address")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates beyond the base, by kind.
MORE = (
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,4}\b", re.I), "at"),
    ("phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), "digit"),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), "digit"),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), "digit"),
    # A long run of letters and digits; the run is taken whole, so that a failed one is not tried again inside.
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"), "digit"),
    # The value after a word for a secret.
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|passwort|contraseña|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<span>[^\s\"',;]{6,256})"), "="),
    ("name", re.compile(r"(?<![A-Za-zÀ-ÿ])(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Don|Doña)\.?[ ](?P<span>[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:[ -][A-ZÀ-Þ][a-zß-ÿ]{1,30}){0,2})(?![A-Za-zÀ-ÿ])"), "title"),
    ("address", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]?,?[ ](?:[A-ZÀ-Þ][a-zß-ÿ'-]{1,30}[ ]){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square)(?![A-Za-z])"), "digit"),
    ("address", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]?,?[ ](?:rue|avenue|boulevard|place|chemin|quai)(?:[ ](?:de|du|des|la|le|les)){0,2}(?:[ ][A-ZÀ-Þ][a-zß-ÿ'-]{1,30}){1,3}"), "digit"),
    ("address", re.compile(r"(?<![A-Za-zÀ-ÿ])[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:straße|strasse|str\.|weg|platz|allee|gasse)[ ][0-9]{1,5}(?![0-9])"), "digit"),
    ("address", re.compile(r"(?<![A-Za-zÀ-ÿ])(?:Calle|Avenida|Plaza|Paseo)(?:[ ](?:de|del|la|las|los|el)){0,2}(?:[ ][A-ZÀ-Þ][a-zß-ÿ]{1,30}){1,3},?[ ][0-9]{1,5}(?![0-9])"), "digit"),
)
TITLE = re.compile(r"(?:Mr|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Sr|Don|Doña)")
#: Gazetteers and context words (fixed values).
MAIL_ENDS = frozenset("com org net edu gov de fr es uk io info eu".split())
IBAN_LANDS = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
AREA_CODES_BAD = frozenset("000 111 123 999".split())
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "kontakt", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "tel.", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "konto", "account", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "api-key", "credential", "credentials", "auth", "bearer", "passwort", "contraseña"),
    "name": ("name", "dear", "regards", "from", "contact", "patient", "born", "lives", "liebe", "cher", "querido"),
    "address": ("address", "lives", "street", "adresse", "dirección", "wohnt", "habite", "vive", "zip", "home"),
}
#: How known kinds of keys begin, and given names (fixed values).
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "ya29.")
GIVEN_NAMES = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna hans peter klaus ursula petra jürgen sabine jean marie pierre michel nathalie isabelle philippe françois josé maría antonio carmen manuel francisco juan ana luis pedro".split())
HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
AGAINST = ("version", "isbn", "page", "order", "article", "chapter", "serial", "commit", "sha1", "sha256", "md5", "checksum", "digest", "hash")
ROUNDS = 30
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_holds(s: str) -> bool:
    """The check of an international bank account number: letters as 10 to 35, modulo 97."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        else:
            end = max(end, at)  # the next local part can't reach over this @
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost, non-overlapping matches of each kind that pass its check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans beyond the base that may be personal data."""
    low = None
    out = []
    digit = bool(DIGIT.search(text))
    for kind, pattern, needs in MORE:
        if needs == "digit" and not digit:
            continue
        if needs == "at":
            low = text.lower() if low is None else low
            if "[at]" not in low and "(at)" not in low:
                continue
        if needs == "=" and "=" not in text and ":" not in text:
            continue
        if needs == "title" and not TITLE.search(text):
            continue
        part = "span" if "span" in pattern.groupindex else 0
        out += [(kind, *m.span(part)) for m in pattern.finditer(text)]
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def near_words(text: str, start: int, end: int) -> set[str]:
    around = text[max(0, start - 60) : start] + " " + text[end : end + 30]
    return {w.strip(".,:;=\"'()").lower() for w in around.split()}


def vote(kind: str, text: str, start: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The labelers' votes (1 personal, -1 not, 0 abstains) and the classifier's features."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    near = near_words(text, start, end)
    share = len(digits) / max(1, len(s))
    mixed = bool(digits) and any(c.isalpha() for c in s)
    hexa = bool(HEX.match(s))
    words = s.lower().replace("-", " ").split()
    form = {
        "email": 1,
        "ip": 1 if len(digits) >= 7 else 0,
        "card": 1 if luhn(digits) else -1,
        "phone": 1 if 8 <= len(digits) <= 15 else -1,
        "ssn": -1 if digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1,
        "iban": 1 if kind == "iban" and iban_holds(s) else -1,
        "secret": 1 if s.startswith(KEY_STARTS) else (1 if len(s) in DIGEST_LENGTHS else 0) if hexa else 1 if mixed and len(digits) >= 3 and "/" not in s else 0 if digits and len(s) < 20 else -1,
        "name": 1 if len(words) >= 2 else 0,
        "address": 1,
    }[kind]
    gazetteer = {
        "email": 1 if s.rsplit(".", 1)[-1].strip().lower() in MAIL_ENDS else 0,
        "phone": -1 if digits[:3] in AREA_CODES_BAD else 1 if s.startswith("+") or digits[:1] in "23456789" else 0,
        "card": 1 if digits[:1] in ("3", "4", "5", "6") else -1,
        "iban": 1 if s[:2] in IBAN_LANDS else -1,
        "ip": -1 if s.startswith(("0.", "127.", "255.")) else 0,
        "secret": 1 if s.startswith(KEY_STARTS) else 0,
        "name": 1 if words[:1] and words[0] in GIVEN_NAMES else 0,
    }.get(kind, 0)
    # Of random characters a key has much entropy, a path or a ruler little.
    random = 0 if kind != "secret" else 1 if len(s) >= 20 and entropy(s) >= 3.0 else -1 if entropy(s) < 2.2 else 0
    context = 1 if near & set(CONTEXT[kind]) else 0
    contrary = -1 if near & set(AGAINST) else 0
    repeat = -1 if kind not in ("name", "address") and len(set(s if kind == "secret" else digits or s)) <= 2 else 0
    votes = (form, gazetteer, context, contrary, repeat, random)
    features = (*(int(kind == k) for k in KINDS), int(mixed), int(share > 0.5), int(len(s) >= 12), int("." in s), int(context > 0), int(contrary < 0), int(repeat < 0), int(form > 0), int(form < 0), int(gazetteer > 0), int(gazetteer < 0), int(random > 0), int(random < 0))
    return votes, features


class Taken:
    """Disjoint intervals in order; an overlap is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.ends, a + 1)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _vectors(batches):
    seen: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if isinstance(text, str) and text:
                found = [(k, a, b) for k, spans in base_spans(text).items() for a, b in spans] + candidates(text)
                for k, a, b in found:
                    seen[vote(k, text, a, b)] += 1
    if seen:
        yield pd.DataFrame({"votes": [list(v) for v, _ in seen], "features": [list(f) for _, f in seen], "n": list(seen.values())})


def reliabilities(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The posterior that candidates with each vector of votes are personal data; EM over two classes."""
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    # What is believed of a labeler's votes (-1, 0, 1) in each class, worth a tenth of the candidates.
    believed = {1: np.array([0.02, 0.38, 0.6]), 0: np.array([0.5, 0.4, 0.1])}
    weight = 0.1 * n.sum() + 1
    for _ in range(ROUNDS):
        odds = np.log((n @ p + weight * 0.5) / (n @ (1 - p) + weight * 0.5))
        score = np.full(len(n), odds)
        for j in range(votes.shape[1]):
            like = {}
            for c, q in ((1, p), (0, 1 - p)):
                mass = np.array([(n * q)[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                like[c] = (mass + weight * believed[c]) / (mass.sum() + weight)
            ratio = np.log(like[1]) - np.log(like[0])
            ratio[1] = 0.0  # an abstention says nothing
            score += ratio[votes[:, j] + 1]
        p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    return p


def span_classifier(features: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method with a ridge."""
    x = np.hstack([features, np.ones((len(features), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    ridge = np.full(x.shape[1], 1e-3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - p)) + ridge * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame) -> tuple[np.ndarray, float] | None:
    """The final classifier, from all documents; None if there are no candidates."""
    bound_batches(docs.sparkSession)
    counted = docs.select("text").mapInPandas(_vectors, "votes array<int>, features array<int>, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return None
    counted.sort(key=lambda r: (r.votes, r.features))
    n = np.array([r.n for r in counted], float)
    p = reliabilities(np.array([r.votes for r in counted]), n)
    return span_classifier(np.array([r.features for r in counted]), p, n)


def all_spans(text, model) -> tuple[dict, list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans by kind and start."""
    if not isinstance(text, str) or not text:
        return {k: [] for k in BASE_KINDS}, []
    base = base_spans(text)
    taken = Taken([s for spans in base.values() for s in spans])
    out = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
    if model is not None:
        w, b0 = model
        for kind, a, b in candidates(text):
            if not taken.meets(a, b):
                z = b0 + float(np.dot(w, vote(kind, text, a, b)[1]))
                if 1 / (1 + np.exp(-z)) >= ACCEPT:
                    taken.add(a, b)
                    out.append((kind, a, b))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone: base spans; base_sha256, spans, n_spans, n_secret) of each row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, spans = all_spans(text, model)
                code = joined((k, a, b) for k in BASE_KINDS for a, b in base[k])
                rows.append((*(len(base[k]) for k in BASE_KINDS), hashlib.sha256(code.encode()).hexdigest(), joined(spans), len(spans), sum(k == "secret" for k, _, _ in spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_secret"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long")


def redact(docs: DataFrame, model) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if not isinstance(text, str):
                return None
            out, at = [], 0
            for kind, a, b in sorted(all_spans(text, model)[1], key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", clean("text"))
